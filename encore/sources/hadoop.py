"""Small steps on any Hadoop file system: existence, atomic small files, joining of parts."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, place = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def listing(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """(name, size, time) of a file, or of the files in a folder; empty if there is none."""
    fs, place = _at(spark, path)
    if not fs.exists(place):
        return ()
    return tuple(sorted(
        (s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(place)))


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename; an existing target is an error and stays as it is."""
    fs, place = _at(spark, target)
    if fs.exists(place) or not fs.rename(_at(spark, source)[1], place):
        raise FileExistsError(target)


def put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that is either not there or whole; an existing one is an error."""
    fs, place = _at(spark, path)
    waiting = f"{path}.{uuid.uuid4().hex}.tmp"
    out = fs.create(_at(spark, waiting)[1])
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.mkdirs(place.getParent())
    move(spark, waiting, path)


def get(spark: SparkSession, path: str) -> str:
    fs, place = _at(spark, path)
    stream = fs.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def join_parts(spark: SparkSession, folder: str, path: str, header: str = "") -> None:
    """Join a folder's part files, in the order of their names, behind a header into one file.

    Bytes go from stream to stream with a small buffer. The file gets its name when it is whole.
    """
    fs, _ = _at(spark, path)
    waiting = f"{path}.{uuid.uuid4().hex}.tmp"
    out = fs.create(_at(spark, waiting)[1])
    try:
        out.write(bytearray(header.encode()))
        for name in names(spark, folder):
            if name.startswith("part-"):
                part = fs.open(_at(spark, f"{folder}/{name}")[1])
                try:
                    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
                finally:
                    part.close()
    finally:
        out.close()
    move(spark, waiting, path)
