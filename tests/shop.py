"""A hand-made shop: orders and lines small enough to work features out on paper."""

from encore.operators.history import order_interval_accu, purchase_history
from encore.sources import schemas

# user: [(order_id, eval_set, dow, hour, days since the order before, products)]
ORDERS = {
    # Product 1 in orders 1, 3 and 5; product 2 once; product 3 first bought in the last
    # prior order; the target holds a repeat (1) and a first purchase (9).
    1: [
        (11, "prior", 0, 8, None, [1, 2]), (12, "prior", 1, 9, 5.0, [4]),
        (13, "prior", 2, 8, 7.0, [1, 4]), (14, "prior", 3, 8, 0.0, [5]),
        (15, "prior", 4, 10, 8.0, [1, 3]), (16, "train", 2, 8, 10.0, [1, 9]),
    ],
    # All orders on one day; product 1 twice on it.
    2: [
        (21, "prior", 5, 20, None, [1]), (22, "prior", 5, 20, 0.0, [1, 6]),
        (23, "test", 5, 23, 0.0, []),
    ],
    # A single prior order.
    3: [(31, "prior", 6, 7, None, [2, 7]), (32, "train", 6, 7, 3.0, [2])],
    # Nothing bought twice.
    4: [
        (41, "prior", 0, 8, None, [2]), (42, "prior", 0, 8, 4.0, [1]),
        (43, "test", 0, 8, 6.0, []),
    ],
}
# product: (aisle, department); no product of aisle 3 is ever reordered.
PRODUCTS = {1: (1, 1), 2: (2, 1), 3: (3, 2), 4: (1, 1), 5: (3, 2), 6: (3, 2), 7: (3, 2), 9: (3, 2)}


class Shop:
    def __init__(self, spark):
        orders, lines = [], {"prior": [], "train": [], "test": []}
        for user, placed in ORDERS.items():
            seen = set()
            for number, (order, eval_set, dow, hour, days, basket) in enumerate(placed, 1):
                orders.append((order, user, eval_set, number, dow, hour, days))
                for position, product in enumerate(basket, 1):
                    lines[eval_set].append((order, product, position, int(product in seen)))
                seen |= set(basket)
        self.plain_orders = spark.createDataFrame(orders, schemas.ORDERS)
        self.orders = order_interval_accu(self.plain_orders)
        self.prior_lines = spark.createDataFrame(lines["prior"], schemas.ORDER_PRODUCTS)
        self.truth_lines = spark.createDataFrame(lines["train"], schemas.ORDER_PRODUCTS)
        self.products = spark.createDataFrame(
            [(p, f"product {p}", a, d) for p, (a, d) in PRODUCTS.items()], schemas.PRODUCTS
        )
        self.history = purchase_history(self.prior_lines, self.orders)


def rows(df, *keys):
    """Rows as dicts, by key."""
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}
