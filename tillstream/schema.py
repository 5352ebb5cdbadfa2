"""Record layouts: the order line, its wire form, the keyed table and the result messages."""

from __future__ import annotations

from pyspark.sql import types as T

# The 21 fields of an order line, in wire order, each with its kind and the
# column family that holds it in the keyed table.
ORDER_FIELDS = (
    ("product_id", "id", "product_data"),
    ("product_name", "text", "product_data"),
    ("unit", "text", "product_data"),
    ("product_type", "text", "product_data"),
    ("brand_name", "text", "product_data"),
    ("manufacturer_name", "text", "product_data"),
    ("l0_category", "text", "product_data"),
    ("l1_category", "text", "product_data"),
    ("l2_category", "text", "product_data"),
    ("l0_category_id", "id", "product_data"),
    ("l1_category_id", "id", "product_data"),
    ("l2_category_id", "id", "product_data"),
    ("date_", "text", "metadata"),
    ("city_name", "text", "metadata"),
    ("order_id", "id", "order_data"),
    ("cart_id", "id", "order_data"),
    ("dim_customer_key", "id", "customer_data"),
    ("procured_quantity", "quantity", "pricing"),
    ("unit_selling_price", "money", "pricing"),
    ("total_discount_amount", "money", "pricing"),
    ("total_weighted_landing_price", "money", "pricing"),
)
FAMILIES = ("product_data", "order_data", "customer_data", "pricing", "metadata")

# The format of date_, the length of a trend window in minutes and the size of a top list.
DATE_FORMAT = "yyyy-MM-dd HH:mm:ss"
TREND_MINUTES = 10
TOP_N = 10

# The cell texts a CSV reader takes as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

FIELD_NAMES = tuple(name for name, _, _ in ORDER_FIELDS)

# Decimal money makes sums exact and free of the order in which tasks finish.
EXACT_MONEY = T.DecimalType(18, 4)


def order_schema(money: T.DataType | None = None) -> T.StructType:
    """The typed order line. Ids are long: an id above 2^31 is a valid id."""
    kinds = {
        "id": T.LongType(),
        "text": T.StringType(),
        "quantity": T.IntegerType(),
        "money": money or T.DoubleType(),
    }
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind, _ in ORDER_FIELDS])


def strict_schema() -> T.StructType:
    """Numbers must be JSON numbers and ids must fit an int; anything else reads as NULL."""
    kinds = {
        "id": T.IntegerType(),
        "text": T.StringType(),
        "quantity": T.IntegerType(),
        "money": T.DoubleType(),
    }
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind, _ in ORDER_FIELDS])


# Quoted and bare numbers both arrive as text under a string field.
WIRE_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in FIELD_NAMES])

# Columns of a message log, as the Kafka source names them.
TOPIC_SCHEMA = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
])

# The names of the topics.
ORDER_TOPIC, RESULT_TOPIC = "ecommerce", "eda_results"

# The envelope of a result message: what it tells, which run of a job published it, as which
# snapshot and when, and what tells it from all other messages. A message that is sent again keeps
# its id.
ENVELOPE = ("metric", "run_id", "epoch_id", "published_at", "message_id")

# Every field a result message of the jobs can carry; `metric` tells which ones are set.
RESULT_SCHEMA = T.StructType([
    T.StructField("metric", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("epoch_id", T.LongType()),
    T.StructField("published_at", T.TimestampType()),
    T.StructField("message_id", T.StringType()),
    T.StructField("l1_category", T.StringType()),
    T.StructField("city_name", T.StringType()),
    T.StructField("brand_name", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("dim_customer_key", T.LongType()),
    T.StructField("window", T.StructType([
        T.StructField("start", T.TimestampType()),
        T.StructField("end", T.TimestampType()),
    ])),
    T.StructField("total_sales", T.DoubleType()),
    T.StructField("total_procured_quantity", T.LongType()),
    T.StructField("brand_count", T.LongType()),
    T.StructField("sales", T.DoubleType()),
    T.StructField("avg_unit_selling_price", T.DoubleType()),
    T.StructField("total_discount_amount", T.DoubleType()),
    T.StructField("total_orders", T.LongType()),
    T.StructField("total_quantity_sold", T.LongType()),
    T.StructField("total_spent", T.DoubleType()),
    T.StructField("order_count", T.LongType()),
    T.StructField("average_order_value", T.DoubleType()),
    T.StructField("error", T.StringType()),
])
