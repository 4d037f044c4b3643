"""Hand-worked cases (see FIXTURES.md, section 3)."""

import pytest
from shop import Shop, rows

from encore.operators import candidates as C
from encore.operators import earlier, users
from encore.operators.categories import id_features
from encore.operators.history import purchase_occurrence, user_product_last
from encore.operators.matrix import feature_matrix, single_targets
from encore.operators.pairs import user_product_features
from encore.operators.products import product_features
from encore.operators.targets import target_order_features
from encore.operators.timeofweek import time_features


@pytest.fixture(scope="module")
def shop(spark):
    return Shop(spark)


@pytest.fixture(scope="module")
def pairs(shop):
    return rows(user_product_features(shop.history), "user_id", "product_id")


@pytest.fixture(scope="module")
def cands(shop):
    bought = C.user_products(C.user_order_products(shop.prior_lines, shop.orders))
    return C.candidates(shop.orders, bought, "train").unionByName(
        C.candidates(shop.orders, bought, "test")
    )


def test_accumulated_days(shop):
    days = [r["interval_accu"] for r in shop.orders.orderBy("order_id").collect()]
    assert days == [0, 5, 12, 12, 20, 30, 0, 0, 0, 0, 3, 0, 4, 10]


def test_occurrence_counts_purchases_of_a_pair(shop):
    got = rows(purchase_occurrence(shop.history), "user_id", "product_id", "order_number")
    assert [got[1, 1, n]["order_time"] for n in (1, 3, 5)] == [0, 1, 2]


def test_last_purchase(shop):
    last = rows(user_product_last(shop.history), "user_id", "product_id")[1, 1]
    assert (last["last_order_number"], last["interval_accu"]) == (5, 20)


def test_pair_bought_in_orders_1_3_5(pairs):
    pair = pairs[1, 1]
    assert pair["user_prod_norder"] == 3
    assert pair["user_prod_order_interval"] == 2.0
    assert pair["user_prod_days_interval"] == 10.0
    assert pair["user_prod_reorder_rate"] == 2 / 4
    assert pair["user_prod_reordered"] == 1


def test_pair_bought_once_gets_stand_ins_over_known_averages(pairs):
    pair = pairs[1, 2]
    assert (pair["user_prod_order_interval"], pair["user_prod_days_interval"]) == (100, 366)
    # The user's average order gap is over products 1 (2.0) and 4 (1.0).
    assert pair["user_prod_order_interval_user_ratio"] == 100 / 1.5
    assert pair["user_prod_days_interval_user_ratio"] == 366 / 1.5
    # Nobody bought product 2 twice.
    assert pair["user_prod_order_interval_prod_ratio"] == 80
    assert pair["user_prod_days_interval_prod_ratio"] == 366
    assert pair["user_prod_reorder_rate"] == 0


def test_first_purchase_in_latest_prior_order(pairs):
    assert pairs[1, 3]["user_prod_recentlydiscovered"] == 1
    assert pairs[1, 3]["user_prod_reorder_rate"] == 0
    assert pairs[1, 2]["user_prod_recentlydiscovered"] == 0


def test_user_without_repeats_has_no_average_to_divide_by(shop, pairs):
    assert pairs[4, 1]["user_prod_order_interval_user_ratio"] == 80
    assert pairs[4, 1]["user_prod_days_interval_user_ratio"] == 366
    user = rows(users.user_features(shop.history), "user_id")[4,]
    assert (user["user_order_interval_avg"], user["user_days_interval_avg"]) == (0, 0)


def test_user_features(shop):
    got = rows(users.user_features(shop.history), "user_id")
    assert set(got) == {(1,), (2,), (4,)}, "a user with a single prior order has no features"
    user = got[1,]
    assert user["user_norder"] == 5
    assert (user["user_nitems"], user["user_ndistinctitems"]) == (8, 5)
    assert (user["user_nritems"], user["user_nrdistinctitems"]) == (3, 2)
    assert user["user_interval"] == 20 / 4
    assert user["user_second_order_rate"] == 2 / 5
    # Orders 2 to 5 hold 0, 2/2, 0 and 1/2 reorders.
    assert user["user_avg_reorder_ratio"] == 1.5 / 4
    assert user["user_nritem_per_order"] == 3 / 4


def test_product_never_reordered(shop):
    product = rows(product_features(shop.history), "product_id")[2,]
    assert (product["prod_nruser"], product["prod_nrorder"]) == (0, 0)
    assert (product["prod_days_interval_avg"], product["prod_order_interval_avg"]) == (366, 100)
    assert product["prod_rorder_per_ruser"] == 0
    assert product["prod_nuser"] == 3
    assert (2,) not in rows(earlier.product_user_reorder(shop.history), "product_id")


def test_zero_intervals_become_the_stand_in(shop, cands):
    got = rows(
        target_order_features(cands, shop.orders, shop.history), "user_id", "product_id"
    )
    assert got[2, 1]["user_lastorder_interval_ratio"] == 1600
    assert got[2, 1]["user_prod_lastdays_interval_rate"] == 1600
    assert got[2, 1]["user_prod_lastorder_interval_rate"] == 1.0
    pair = got[1, 1]
    assert (pair["user_prod_lastorder_interval"], pair["user_prod_lastdays_interval"]) == (1, 10)
    assert pair["user_prod_lastdays_interval_rate"] == 1.0
    assert pair["user_lastorder_interval_ratio"] == 2.0


def test_candidates_and_labels(shop, cands):
    train = cands.join(shop.orders.filter("eval_set = 'train'").select("order_id"), "order_id")
    labels = rows(C.labelled(train, shop.truth_lines), "user_id", "product_id")
    assert set(labels) == {(1, p) for p in (1, 2, 3, 4, 5)} | {(3, 2), (3, 7)}
    assert [labels[1, p]["label"] for p in (1, 2, 3, 4, 5)] == [1, 0, 0, 0, 0]
    assert labels[3, 2]["label"] == 1


def test_time_features(shop, cands):
    got = rows(time_features(cands, shop.orders, shop.history), "user_id", "product_id")
    # Hour 23 is unseen in the history.
    assert got[2, 1]["prod_hour_prob"] is None
    assert got[2, 1]["hour_user_reorder_prob"] == 1 / (1 + 24)
    # User 1's target: day 2, hour 8. Product 1 has 6 lines, 3 of them at hour 8.
    pair = got[1, 1]
    assert pair["prod_hour_prob"] == 3 / 7
    assert pair["hour_prod_prob"] == 4 / (6 + 7)
    assert pair["week_prod_prob"] == 2 / (6 + 24)
    assert pair["week_prod_user_reorder_prob"] == 2 / (2 + 7)


def test_id_features(shop, cands):
    got = rows(id_features(cands, shop.products, shop.history), "user_id", "product_id")
    assert got[1, 3]["prod_aisle_reorder_prob"] is None
    assert got[1, 1]["prod_aisle_reorder_prob"] == 3 / 4
    assert got[1, 1]["aisle_user_reorder_prob"] == (3 + 1) / (3 + 134)
    assert got[4, 1]["dep_user_reorder_prob"] == 1 / 21


@pytest.mark.parametrize("eval_set", ["train", "test"])
def test_matrix_joins_the_same_features(shop, cands, eval_set):
    """The fused matrix against the blocks computed one by one."""
    wanted = shop.orders.filter(f"eval_set = '{eval_set}'").select("order_id")
    some = cands.join(wanted, "order_id")
    truth = shop.truth_lines if eval_set == "train" else None
    matrix = rows(
        feature_matrix(
            shop.prior_lines, shop.plain_orders, shop.products, eval_set, truth
        ),
        "user_id", "product_id",
    )
    blocks = [
        rows(users.user_features(shop.history), "user_id"),
        rows(product_features(shop.history), "product_id"),
        rows(user_product_features(shop.history), "user_id", "product_id"),
        rows(target_order_features(some, shop.orders, shop.history), "user_id", "product_id"),
        rows(time_features(some, shop.orders, shop.history), "user_id", "product_id"),
        rows(id_features(some, shop.products, shop.history), "user_id", "product_id"),
    ]
    # Users without features (a single prior order) have no rows.
    assert set(matrix) == {k for k in rows(some, "user_id", "product_id") if k[0] != 3}
    for (user, product), row in matrix.items():
        expected = {}
        for block, key in zip(blocks, [(user,), (product,), *[(user, product)] * 4]):
            expected |= block[key]
        assert len(expected) == 3 + 62
        assert {k: row[k] for k in expected} == expected
    if truth is not None:
        assert matrix[1, 1]["label"] == 1 and matrix[1, 2]["label"] == 0


def test_matrix_of_given_candidates(shop, cands):
    one = cands.filter("user_id = 1 AND product_id = 2").withColumnRenamed("eval_set", "x")
    got = feature_matrix(
        shop.prior_lines, shop.plain_orders, shop.products, "train", candidates=one
    )
    assert [(r.user_id, r.product_id) for r in got.collect()] == [(1, 2)]


def test_two_targets_of_a_user_are_refused(shop):
    doubled = shop.orders.unionByName(
        shop.orders.filter("order_id = 16").selectExpr("order_id + 100 AS order_id", *[
            c for c in shop.orders.columns if c != "order_id"
        ])
    )
    with pytest.raises(Exception, match="more than one target order"):
        single_targets(doubled).collect()
