"""Stored datasets by key, of which one key can be replaced while others read.

Every write of a key goes to a folder of its own. Which folder a key is read from says a numbered
manifest, a small file that is committed last by renaming it. So a reader sees the old rows or the new
ones, never some of both, and a write that fails on the way changes nothing. Folders of earlier
versions stay, for readers that have them open, until ``forget_earlier`` is called.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from encore.sources import hadoop

MANIFESTS = "_manifests"


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """(number, folder by key) of the last commit."""
    numbers = [n for n in hadoop.names(spark, f"{path}/{MANIFESTS}") if n.endswith(".json")]
    if not numbers:
        return 0, {}
    last = numbers[-1]
    return int(last.removesuffix(".json")), json.loads(hadoop.get(spark, f"{path}/{MANIFESTS}/{last}"))


def stage(df: DataFrame, path: str, key: str) -> str:
    """Write a key's rows to a new folder that nobody reads yet; gives back its name."""
    folder = f"key={key}/version={uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/{folder}")
    return folder


def commit(spark: SparkSession, path: str, folders: dict[str, str]) -> None:
    """Make the given folders what their keys are read from, all at once; other keys stay.

    Of two writers that commit at the same time, one gets an error and can try again.
    """
    path = path.rstrip("/")
    number, keys = _manifest(spark, path)
    hadoop.put(spark, f"{path}/{MANIFESTS}/{number + 1:09d}.json", json.dumps({**keys, **folders}))


def replace_keys(spark: SparkSession, path: str, rows: dict[str, DataFrame]) -> None:
    """Write or replace keys of a dataset; they change together."""
    commit(spark, path, {key: stage(df, path, key) for key, df in rows.items()})


def read_key(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The key's rows as of now; other keys' files are not listed."""
    path = path.rstrip("/")
    _, keys = _manifest(spark, path)
    if key not in keys:
        raise KeyError(f"{path} has no {key}")
    return spark.read.parquet(f"{path}/{keys[key]}")


def forget_earlier(spark: SparkSession, path: str) -> list[str]:
    """Remove folders that no key is read from any more; gives back their names."""
    path = path.rstrip("/")
    number, keys = _manifest(spark, path)
    gone = [
        f"{key}/{version}" for key in hadoop.names(spark, path) if key.startswith("key=")
        for version in hadoop.names(spark, f"{path}/{key}") if f"{key}/{version}" not in keys.values()
    ]
    earlier = [f"{MANIFESTS}/{n}" for n in hadoop.names(spark, f"{path}/{MANIFESTS}")
               if n.endswith(".json") and n != f"{number:09d}.json"]
    for name in [*gone, *earlier]:
        hadoop.remove(spark, f"{path}/{name}")
    return gone
