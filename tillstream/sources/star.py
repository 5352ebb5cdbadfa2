"""Order lines from a star schema (lineitem, part, supplier, orders, customer, nation)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream.schema import DATE_FORMAT, EXACT_MONEY, FIELD_NAMES, order_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _exact(amount: str) -> Column:
    return F.col(amount).cast("decimal(18,2)")


def _is_broadcast(lookup: DataFrame) -> bool:
    """Does the planner broadcast this table, going by its estimate of all it holds?"""
    query = lookup._jdf.queryExecution()
    limit = query.sparkSession().sessionState().conf().autoBroadcastJoinThreshold()
    return query.optimizedPlan().stats().sizeInBytes() <= limit


def _field_sources() -> dict[str, tuple[str | None, Column]]:
    """Per field the lookup it needs (None: lineitem itself) and its expression."""
    kind = F.split_part("p_name", F.lit(" "), F.lit(2))
    return {
        "product_id": (None, F.col("l_partkey")),
        "product_name": ("part", F.col("p_name")),
        "unit": ("part", F.col("p_size").cast("string")),
        "product_type": ("part", kind),
        "brand_name": ("part", F.col("p_brand")),
        "manufacturer_name": ("supplier", F.col("s_name")),
        "l0_category": ("part", kind),
        "l1_category": ("part", F.col("p_type")),
        "l2_category": ("part", F.col("p_name")),
        "l0_category_id": ("part", F.col("p_size")),
        "l1_category_id": ("part", F.col("p_size")),
        "l2_category_id": (None, F.col("l_partkey")),
        "date_": ("orders", F.col("o_date")),
        "timestamp": ("orders", F.date_trunc("second", "o_orderdate")),
        "city_name": ("customer", F.col("n_name")),
        "order_id": (None, F.col("l_orderkey")),
        "cart_id": (None, F.col("l_orderkey")),
        "dim_customer_key": ("orders", F.col("o_custkey")),
        "procured_quantity": (None, F.col("l_quantity").cast("int")),
        "unit_selling_price": (None, _exact("l_extendedprice")),
        "total_discount_amount": (None, _exact("l_extendedprice") * _exact("l_discount")),
        "total_weighted_landing_price": (
            "part", _exact("p_retailprice") * F.col("l_quantity").cast("decimal(10,0)")),
    }


def order_lines(
    spark: SparkSession,
    sf_dir: str,
    *fields: str,
    first_before: str | None = None,
    rest: bool = False,
) -> DataFrame:
    """Order lines with the asked fields (default: all 21), exact money. `timestamp` may be
    asked for too, instead of reading it from `date_`. `first_before` keeps the lines ordered
    before that date, or with `rest` the others.

    Lookups go by primary key and are left joins, so a line never gets lost or doubled and a
    lookup no asked field needs can be left out without changing the others. That leaves,
    for most metrics, one join or none. Times become text once per order, not per line. Customers
    join the orders, of which there are fewer than lines. Orders join the lines last: where that
    shuffles, the lines of an order end up side by side, so keyed jobs fold them in the task that
    reads them. No broadcast is forced: the planner broadcasts a
    lookup only below its size threshold, and otherwise sorts and merges with hot keys split.

    Lines move without what can be looked up after the move. Lookups that shuffle come before those
    that are broadcast, suppliers with their one name before parts; and if all are broadcast, the
    lines move to their orders first, of which none holds many lines, and take up texts there.
    """
    wanted = fields or FIELD_NAMES
    known = _field_sources()
    sources = {name: known[name] for name in wanted}
    needed = {lookup for lookup, _ in sources.values() if lookup}
    if first_before:
        needed.add("orders")

    lines = table(spark, sf_dir, "lineitem")
    lookups = []
    if "supplier" in needed:
        supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
        lookups.append((_is_broadcast(supplier), supplier, "l_suppkey", "s_suppkey"))
    if "part" in needed:
        part = table(spark, sf_dir, "part")
        lookups.append((_is_broadcast(part), part, "l_partkey", "p_partkey"))
    orders = None
    if needed & {"orders", "customer"}:
        date = F.date_format("o_orderdate", DATE_FORMAT)
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
        moves = "customer" in needed or not _is_broadcast(orders)  # joined tables count as large
        if moves and lookups and all(found[0] for found in lookups):
            lines = lines.repartition("l_orderkey")
        orders = orders.withColumn("o_date", date)
        if "customer" in needed:
            customer = table(spark, sf_dir, "customer")
            nation = table(spark, sf_dir, "nation")
            orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
            orders = orders.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    for _, lookup, key, lookup_key in sorted(lookups, key=lambda found: found[0]):
        lines = lines.join(lookup, F.col(key) == F.col(lookup_key), "left")
    if orders is not None:
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")

    if first_before:
        early = F.col("o_orderdate") < F.lit(first_before).cast("timestamp_ntz")
        # A line without a date belongs to the later part.
        lines = lines.where(~F.coalesce(early, F.lit(False)) if rest else early)
    types = {f.name: f.dataType for f in order_schema(EXACT_MONEY)} | {"timestamp": "timestamp"}
    return lines.select(*[
        expression.cast(types[name]).alias(name) for name, (_, expression) in sources.items()
    ])


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as order lines with a time of day: type as category, value as price. Has the
    event time as `timestamp` too."""
    event_fields = {
        "l1_category": F.col("event_type"),
        "date_": F.date_format("ts", DATE_FORMAT),
        "order_id": F.col("event_id"),
        "dim_customer_key": F.col("user_id"),
        "unit_selling_price": F.col("value").cast("decimal(18,2)"),
    }
    types = order_schema(EXACT_MONEY)
    return table(spark, sf_dir, "events").select(
        *[event_fields.get(name, F.lit(None)).cast(types[name].dataType).alias(name)
          for name in FIELD_NAMES],
        F.date_trunc("second", "ts").alias("timestamp"),
    )
