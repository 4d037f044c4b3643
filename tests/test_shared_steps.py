"""Steps of the matrix that category_codes shares: what Spark moves for them, and what they return."""

from datetime import datetime

from pyspark.sql import functions as F

from encore.config import CATEGORICAL
from encore.operators import matrix, prepare
from encore.sources import star


def lines(df, *words):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if all(word in line for word in words)]


def test_codes_move_no_counts_by_user_and_category(retail):
    codes = prepare.category_dictionary(retail.matrix("train"))
    assert not lines(codes, "Join", "aisle_id") and not lines(codes, "Generate")
    assert lines(retail.matrix("train"), "Join", "aisle_id")


def test_codes_are_those_of_a_count_by_feature(retail):
    rows = retail.matrix("train")
    want = set()
    for name in CATEGORICAL:
        counts = rows.filter(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("v")).count()
        ranked = sorted(counts.collect(), key=lambda r: (-r["count"], r["v"]))
        want |= {(name, row["v"], code, row["count"]) for code, row in enumerate(ranked)}
    found = [tuple(row) for row in prepare.category_dictionary(rows).collect()]
    assert set(found) == want and len(found) == len(want)


def test_codes_of_text_numbers_and_nulls(spark):
    rows = spark.createDataFrame(
        [("a", 1.0, 2, True), ("b", -0.0, None, None), ("b", 0.0, 2, True), (None, None, 10, False),
         ("", 0.0, 10, None)], "t string, d double, i int, b boolean")
    found = prepare.category_dictionary(rows, ["t", "d", "i", "b"])
    assert found.columns == ["feature", "value", "code", "rows"]
    assert {tuple(row) for row in found.collect()} == {
        ("t", "b", 0, 2), ("t", "", 1, 1), ("t", "a", 2, 1),
        ("d", "0.0", 0, 2), ("d", "-0.0", 1, 1), ("d", "1.0", 2, 1),
        ("i", "10", 0, 2), ("i", "2", 1, 2), ("b", "true", 0, 2), ("b", "false", 1, 1)}
    one = prepare.category_dictionary(rows, ["t"]).collect()
    assert {tuple(row) for row in one} == {("t", "b", 0, 2), ("t", "", 1, 1), ("t", "a", 2, 1)}
    assert prepare.category_dictionary(rows.limit(0), ["t"]).collect() == []


def test_pairs_without_category_stay_out(spark):
    history = spark.createDataFrame(
        [(1, p, o, n, r, n, 3, 3.0, 3.0 * n, 5, 6, 0) for p, o, n, r in [
            (7, 10, 1, 0), (8, 10, 1, 0), (9, 10, 1, 0), (7, 11, 2, 1), (8, 11, 2, 1), (6, 11, 2, 0)]],
        "user_id long, product_id long, order_id long, order_number int, reordered int, order_dow int, "
        "order_hour_of_day int, days_since_prior_order double, interval_accu double, target_dow int, "
        f"target_hour int, {matrix.TEST} int")
    targets = spark.createDataFrame(
        [(1, 12, 3, 5, 6, 3.0, 9.0, "train")],
        "user_id long, order_id long, target_number int, target_dow int, target_hour int, "
        "target_interval double, target_days double, eval_set string")
    products = spark.createDataFrame(
        [(6, 1, 1), (7, 1, 2), (8, None, 2), (9, 1, None)],
        "product_id long, aisle_id int, department_id int")
    tables = matrix.feature_tables(history, targets, products, None)
    assert tables.pairs.count() == 4
    rows = matrix.matrix_of(tables, "train").collect()
    # One reorder of the user's in aisle 1, one more that has no aisle.
    assert [(r.product_id, r.aisle_user_reorder_prob) for r in sorted(rows, key=lambda r: r.product_id)] == [
        (6, 2 / 136), (7, 2 / 136)]


def test_a_users_days_take_one_window(spark):
    day = [None, datetime(2020, 1, 1, 5), datetime(2020, 1, 3), datetime(2020, 1, 3, 9)]
    placed = [(1, 5, day[0]), (2, 5, day[1]), (4, 5, day[3]), (3, 5, day[2]), (9, 5, day[3]),
              (6, 6, day[0]), (7, 7, day[0]), (8, 7, day[1]), (10, 9, day[1]), (10, 9, day[1]), (11, None, day[1])]
    orders = spark.createDataFrame(placed, "o_orderkey long, o_custkey long, o_orderdate timestamp")
    items = spark.createDataFrame(
        [(key, 1, 1) for key in (1, 2, 3, 4, 6, 7, 8, 10, 11)], "l_orderkey long, l_partkey long, l_linenumber int")
    found = star.canonical_orders(star.Star(orders, items, None))
    # Those along a user's days, and the numbers inside a day.
    assert len(lines(found, "Window [")) == 2
    assert sorted((r.order_id, r.user_id, r.eval_set, r.order_number, r.days_since_prior_order)
                  for r in found.collect()) == [
        (2, 5, "prior", 2, None), (3, 5, "prior", 3, 2.0), (4, 5, "train", 4, 0.0),
        (8, 7, "train", 2, None), (10, 9, "prior", 1, None), (10, 9, "test", 2, 0.0)]
