"""What the steps that most queries share move and store: each row once for each key."""

import datetime

import pytest

from conftest import SF_DIR
from encore.operators import baseline, earlier, matrix, prepare
from encore.plans import catalog
from encore.sources import star

DAY = datetime.datetime(2024, 1, 1)


@pytest.fixture
def shuffled(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield spark
    spark.conf.set(key, before)


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def exchanges(df, *keys):
    """Columns of each exchange of the plan that is dealt by just these keys."""
    plan = df._jdf.queryExecution().executedPlan().initialPlan()
    found = []
    for node in _nodes(plan):
        if node.nodeName() == "Exchange":
            dealt = node.outputPartitioning().toString()
            names = [part.split("#")[0].strip() for part in dealt.partition("(")[2].split(",")]
            if [name for name in names if not name.isdigit()][:len(keys)] == list(keys) and (
                    len([n for n in names if n and not n.rstrip(")").isdigit()]) == len(keys)):
                found.append([c.split("#")[0] for c in node.output().mkString(",").split(",")])
    return found


def raw(spark, tmp_path):
    """Lines that repeat, a line of no order, one without a number, a null product and a null user."""
    orders = [(1, 7, DAY), (2, 7, DAY + datetime.timedelta(3)), (3, 7, DAY + datetime.timedelta(3)),
              (4, 8, None), (5, None, DAY), (6, 9, DAY)]
    lines = [(1, 1, 2), (1, 1, 1), (1, 2, 3), (2, 1, None), (2, 1, 5), (2, 3, 6), (3, 2, 1), (3, 1, 4),
             (5, 1, 1), (6, 1, 1), (None, 1, 1), (99, 1, 1), (4, 1, 1)]
    parts = [(1, "Brand#12", "SMALL"), (2, "Brand#12", "SMALL"), (3, None, "LARGE")]
    tables = {
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_linenumber int"),
        "part": (parts, "p_partkey long, p_brand string, p_type string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return star.Star.load(spark, str(tmp_path))


def test_purchases_of_odd_rows(spark, tmp_path):
    tables = raw(spark, tmp_path)
    orders = star.canonical_orders(tables)
    assert sorted(orders.select("order_id", "order_number", "days_since_prior_order").collect()) == [
        (1, 1, None), (2, 2, 3.0), (3, 3, 0.0), (6, 1, None)]
    bought = star.all_purchases(tables, orders, cart=True)
    assert sorted(bought.select("order_id", "product_id", "first_line", "reordered").collect()) == [
        (1, 124, 1, 0), (2, 124, 5, 1), (3, 124, 1, 1), (6, 124, 1, 0)]
    plain = star.all_purchases(tables, orders)
    assert "first_line" not in plain.columns
    assert sorted(plain.select("order_id", "reordered").collect()) == [(1, 0), (2, 1), (3, 1), (6, 0)]


def test_lines_are_moved_once_for_the_order_and_once_for_the_pair(shuffled, retail):
    bought = star.all_purchases(retail.star, retail.orders)
    assert len(exchanges(bought, "user_id", "product_id")) == 1
    assert len(exchanges(bought, "order_id")) == 2  # lines and orders
    assert exchanges(bought, "order_id", "product_id") == []


def test_orders_are_moved_once(shuffled, retail):
    orders = star.canonical_orders(retail.star)
    orders.collect()
    final = orders._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and final.count("FileScan parquet [o_orderkey") == 1


def test_user_features_are_not_moved_by_category(shuffled, retail):
    rows = matrix.matrix_of(retail.tables, "train")
    by_category = exchanges(rows, "user_id", "aisle_id", "department_id")
    assert by_category and not any("user_norder" in columns for columns in by_category)


def test_pairs_are_not_moved_again_after_their_rate(shuffled, retail):
    scored = baseline.reorder_rate_scores(retail.labelled, retail.history)
    by_pair = exchanges(scored, "user_id", "product_id")
    assert not any("pred_prob" in columns or "orders" in columns for columns in by_pair)


@pytest.mark.parametrize("name", ["test_frame", "dataset_replaced_key"])
def test_training_rows_are_not_stored_twice(spark, monkeypatch, name):
    stored = []

    def recorded(df, name, by=None, real=catalog.materialise):
        stored.append(name)
        return real(df, name, by)

    monkeypatch.setattr(catalog, "materialise", recorded)
    catalog.queries()[name](spark, SF_DIR)
    assert "matrix" not in stored


def test_lines_by_slot_are_added_up_once_for_a_product(retail):
    rows = earlier.legacy_matrix(retail.labelled, retail.orders, retail.history)
    assert "lambdafunction" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_first_rows_without_the_features_of_all(retail, monkeypatch):
    """The same rows as from the whole matrix, from the users of some orders; orders are added where rows lack."""
    whole, users = retail.matrix("train"), retail.tables.targets.filter("eval_set = 'train'").count()
    for rows, per_order in ((40, 8), (300, 200), (10**6, 8)):
        monkeypatch.setattr(matrix, "ROWS_PER_ORDER", per_order)
        few = matrix.of_first_orders(retail.tables, "train", rows)
        assert rows > 300 or few.targets.count() < users
        wanted = prepare.debug_sample(whole, rows).collect()
        assert retail.first_rows("train", rows).collect() == wanted
        assert len(wanted) == min(rows, whole.count())
