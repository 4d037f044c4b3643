"""Fixed schemas of the input and output tables.

Keys are 64-bit and small codes 32-bit: Spark has no unsigned types, and at scale an order
or product key does not fit 32 bits. Missing values are NULL, never NaN.
"""

from pyspark.sql import types as T


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_L, _I, _D, _S = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()

ORDERS = _struct(
    ("order_id", _L), ("user_id", _L), ("eval_set", _S), ("order_number", _I),
    ("order_dow", _I), ("order_hour_of_day", _I), ("days_since_prior_order", _D),
)
ORDER_PRODUCTS = _struct(
    ("order_id", _L), ("product_id", _L), ("add_to_cart_order", _I), ("reordered", _I)
)
PRODUCTS = _struct(
    ("product_id", _L), ("product_name", _S), ("aisle_id", _I), ("department_id", _I)
)
TRAIN_CANDIDATES = _struct(
    ("order_id", _L), ("user_id", _L), ("product_id", _L), ("label", _I), ("seed", _I)
)
TEST_CANDIDATES = _struct(("order_id", _L), ("user_id", _L), ("product_id", _L))
SCORED = _struct(
    ("order_id", _L), ("user_id", _L), ("product_id", _L), ("label", _I), ("pred_prob", _D),
    ("pred", _I),
)
SUBMISSION = _struct(("order_id", _L), ("products", _S))
