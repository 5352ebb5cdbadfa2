"""The registered queries in SQL, to check results against another engine."""

from __future__ import annotations

from tillstream.schema import FIELD_NAMES, MISSING_TOKENS, ORDER_FIELDS

_FAMILY_OF = {name: family for name, _, family in ORDER_FIELDS}
_MONEY = [name for name, kind, _ in ORDER_FIELDS if kind == "money"]

_LINES = """order_lines AS (
  SELECT l_partkey AS product_id,
         p_name AS product_name,
         CAST(p_size AS VARCHAR) AS unit,
         split_part(p_name, ' ', 2) AS product_type,
         p_brand AS brand_name,
         s_name AS manufacturer_name,
         split_part(p_name, ' ', 2) AS l0_category,
         p_type AS l1_category,
         p_name AS l2_category,
         CAST(p_size AS BIGINT) AS l0_category_id,
         CAST(p_size AS BIGINT) AS l1_category_id,
         l_partkey AS l2_category_id,
         strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS date_,
         n_name AS city_name,
         l_orderkey AS order_id,
         l_orderkey AS cart_id,
         o_custkey AS dim_customer_key,
         CAST(l_quantity AS INTEGER) AS procured_quantity,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS unit_selling_price,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2))
              AS DECIMAL(18,4)) AS total_discount_amount,
         CAST(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(l_quantity AS DECIMAL(10,0))
              AS DECIMAL(18,4)) AS total_weighted_landing_price
  FROM lineitem
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
)"""

_FIRST_LINES = (
    "first_lines AS (SELECT * FROM order_lines WHERE 2 * order_id < "
    "(SELECT min(l_orderkey) + max(l_orderkey) FROM lineitem))"
)


def _sum_as_double(field: str) -> str:
    return f"CAST(sum({field}) AS DOUBLE)"


def _trend(source: str, time: str, price: str) -> str:
    start = f"time_bucket(INTERVAL '10 minutes', {time})"
    return (
        f"SELECT {start} AS window_start, {start} + INTERVAL '10 minutes' AS window_end, "
        f"l1_category, {_sum_as_double(price)} AS sales FROM {source} "
        f"WHERE {time} IS NOT NULL GROUP BY ALL"
    )


def _top(key: str, measure: str) -> str:
    return f"ORDER BY {measure} DESC NULLS LAST, {key} ASC NULLS FIRST LIMIT 10"


def _metric(name: str, lines: str = "order_lines") -> str:
    price = "unit_selling_price"
    return {
        "sales_by_category":
            f"SELECT l1_category, {_sum_as_double(price)} AS total_sales "
            f"FROM {lines} GROUP BY l1_category",
        "quantity_by_city":
            "SELECT city_name, CAST(sum(procured_quantity) AS BIGINT) "
            f"AS total_procured_quantity FROM {lines} GROUP BY city_name",
        "top_brands":
            f"SELECT brand_name, count(brand_name) AS brand_count FROM {lines} "
            f"GROUP BY brand_name {_top('brand_name', 'brand_count')}",
        "sales_trend": _trend(lines, "CAST(date_ AS TIMESTAMP)", price),
        "avg_price_by_category":
            f"SELECT l1_category, {_sum_as_double(price)} / nullif(count({price}), 0) "
            f"AS avg_unit_selling_price FROM {lines} GROUP BY l1_category",
        "discount_by_brand":
            f"SELECT brand_name, {_sum_as_double('total_discount_amount')} "
            f"AS total_discount_amount FROM {lines} GROUP BY brand_name",
        "orders_by_city":
            f"SELECT city_name, count(order_id) AS total_orders FROM {lines} GROUP BY city_name",
        "top_products":
            "SELECT product_name, CAST(sum(procured_quantity) AS BIGINT) "
            f"AS total_quantity_sold FROM {lines} GROUP BY product_name "
            f"{_top('product_name', 'total_quantity_sold')}",
        "aov_by_customer":
            f"SELECT dim_customer_key, {_sum_as_double(price)} AS total_spent, "
            f"count(order_id) AS order_count, {_sum_as_double(price)} "
            f"/ nullif(count(order_id), 0) AS average_order_value FROM {lines} "
            "GROUP BY dim_customer_key",
    }[name]


_METRIC_NAMES = (
    "sales_by_category", "quantity_by_city", "top_brands", "sales_trend",
    "avg_price_by_category", "discount_by_brand", "orders_by_city", "top_products",
    "aov_by_customer",
)


def _stacked(names: tuple[str, ...], lines: str = "order_lines", extra: str = "") -> str:
    return "\nUNION ALL BY NAME\n".join(
        f"(SELECT '{name}' AS metric{extra}, * FROM ({_metric(name, lines)}))" for name in names
    )


_RESULTS = (
    _stacked(_METRIC_NAMES, "first_lines", ", CAST(0 AS BIGINT) AS epoch_id")
    + "\nUNION ALL BY NAME\n"
    + _stacked(_METRIC_NAMES, "order_lines", ", CAST(1 AS BIGINT) AS epoch_id")
)


def _with_lines(select: str) -> str:
    return f"WITH {_LINES}\n{select}"


def _with_results(select: str) -> str:
    return f"WITH {_LINES},\n{_FIRST_LINES},\nresults AS (\n{_RESULTS}\n)\n{select}"


def _typed(name: str) -> str:
    return f"CAST({name} AS DOUBLE) AS {name}" if name in _MONEY else name


_TYPED_FIELDS = ", ".join(_typed(name) for name in FIELD_NAMES)
_TEXT_FIELDS = ", ".join(f"CAST({name} AS VARCHAR) AS {name}" for name in FIELD_NAMES)
# Fields as the text of a message; the values are compared before.
_SENT_FIELDS = ", ".join(f"CAST({name} AS VARCHAR) AS {name}" for name in FIELD_NAMES)
_ORDER_BY_FIELDS = ", ".join(f"{name} DESC NULLS LAST" for name in FIELD_NAMES)
_JSON = "json_object(" + ", ".join(
    f"'{name}', CAST({name} AS VARCHAR)" for name in FIELD_NAMES) + ")"


_STRICT_TYPES = {"id": "INTEGER", "quantity": "INTEGER", "money": "DOUBLE"}
_TOKENS = ", ".join(f"'{token}'" for token in MISSING_TOKENS)
_COMPLETE = " AND ".join(
    f"{name} NOT IN ({_TOKENS})" if kind == "text" else f"{name} IS NOT NULL"
    for name, kind, _ in ORDER_FIELDS
)


def _last_line_per_order(fields: str, lines: str) -> str:
    return (
        f"SELECT CAST(order_id AS VARCHAR) AS row_key, {fields} FROM (SELECT *, row_number() "
        f"OVER (PARTITION BY order_id ORDER BY {_ORDER_BY_FIELDS}) AS place FROM {lines}) "
        "WHERE place = 1 AND order_id IS NOT NULL"
    )


def _dash(metric: str, key: str, measure: str, mode: str, tail: str = "") -> str:
    newest = f"AND epoch_id = (SELECT max(epoch_id) FROM results WHERE metric = '{metric}')"
    kind = "DOUBLE" if measure == "total_sales" else "BIGINT"
    return _with_results(
        f"SELECT {key}, CAST(coalesce(sum({measure}), 0) AS {kind}) AS {measure} FROM results "
        f"WHERE metric = '{metric}' AND {key} IS NOT NULL "
        f"{newest if mode == 'latest' else ''} GROUP BY {key} {tail}"
    )


def _aov(mode: str) -> str:
    newest = "AND epoch_id = (SELECT max(epoch_id) FROM results)" if mode == "latest" else ""
    return (
        "SELECT dim_customer_key, avg(average_order_value) AS average_order_value FROM results "
        f"WHERE metric = 'aov_by_customer' AND dim_customer_key IS NOT NULL {newest} "
        "GROUP BY dim_customer_key"
    )


_EVENT_LINES = (
    "(SELECT event_type AS l1_category, ts, CAST(value AS DECIMAL(18,2)) AS price FROM events)"
)

def _all_values(mode: str) -> str:
    """The mean order values a histogram is of: one per customer, or one per message."""
    return _aov(mode) if mode == "latest" else (
        "SELECT average_order_value FROM results WHERE metric = 'aov_by_customer'")


def _histogram(mode: str) -> str:
    return f"""
SELECT bin, count(*) AS customers,
       round(any_value(low) + (bin - 1) * any_value(width), 6) AS bin_start,
       round(CASE WHEN any_value(low) = any_value(high) THEN any_value(high)
                  ELSE any_value(low) + bin * any_value(width) END, 6) AS bin_end
FROM (
  SELECT low, high, width,
         CAST(CASE WHEN low = high THEN 1
                   ELSE least(20, floor((average_order_value - low) / width) + 1) END
              AS INTEGER) AS bin
  FROM ({_all_values(mode)}),
       (SELECT min(average_order_value) AS low, max(average_order_value) AS high,
               (max(average_order_value) - min(average_order_value)) / 20 AS width
        FROM ({_all_values(mode)}))
  WHERE average_order_value IS NOT NULL
) GROUP BY bin
"""


def all_sql() -> dict[str, str]:
    sql = {name: _with_lines(_metric(name)) for name in _METRIC_NAMES if name != "sales_trend"}
    trend_over_events = _trend(_EVENT_LINES, "ts", "price")
    one_pass = tuple(name for name in _METRIC_NAMES if name != "sales_trend")
    last_messages = (
        "SELECT event_type AS metric, event_id, user_id, value FROM events "
        "WHERE event_type <> ''"
    )
    sql |= {
        "sales_trend": trend_over_events,
        "sales_trend_orders": _with_lines(_metric("sales_trend")),
        "multi_metric_one_pass": _with_lines(_stacked(one_pass)),
        "metric_log": _with_lines(_stacked(_METRIC_NAMES)),
        "prep_sales": _with_lines(
            f"SELECT {_TYPED_FIELDS} FROM order_lines "
            f"WHERE total_discount_amount <> 0 AND unit <> '1' AND {_COMPLETE}"),
        "publish_orders": _with_lines(f"SELECT CAST({_JSON} AS VARCHAR) AS value FROM order_lines"),
        "parse_orders": _with_lines(
            f'SELECT {_TYPED_FIELDS}, CAST(date_ AS TIMESTAMP) AS "timestamp" FROM order_lines'),
        "parse_orders_strict": _with_lines(
            "SELECT " + ", ".join(
                name if kind == "text" else f"CAST(NULL AS {_STRICT_TYPES[kind]}) AS {name}"
                for name, kind, _ in ORDER_FIELDS
            ) + ', CAST(date_ AS TIMESTAMP) AS "timestamp" FROM order_lines'),
        "upsert_orders": _with_lines(_last_line_per_order(_TYPED_FIELDS, "order_lines")),
        "upsert_orders_stream": _with_lines(_last_line_per_order(
            ", ".join(FIELD_NAMES), f"(SELECT {_TEXT_FIELDS} FROM order_lines)")),
        "order_families": _with_lines(
            "SELECT CAST(order_id AS VARCHAR) AS row_key, " + ", ".join(
                f"{'CAST(' + name + ' AS DOUBLE)' if name in _MONEY else name} "
                f"AS {_FAMILY_OF[name]}_{name}" for name in FIELD_NAMES
            ) + " FROM order_lines"),
        "land_raw_orders": _with_lines(
            f"SELECT CAST({_JSON} AS VARCHAR) AS raw, {_TYPED_FIELDS}, "
            'CAST(date_ AS TIMESTAMP) AS "timestamp" FROM order_lines'),
        "replay_results": _with_results("SELECT * FROM results"),
        "export_results": _with_results("SELECT * FROM results"),
        "metric_streams": _with_results("SELECT * FROM results"),
        "one_pass_stream": _with_lines(_stacked(_METRIC_NAMES)),
        "replay_counts": _with_results(
            "SELECT metric, CAST(grouping(metric) AS TINYINT) AS is_total, "
            "count(*) AS messages FROM results GROUP BY ROLLUP (metric)"),
        "metric_names": _with_results("SELECT DISTINCT metric FROM results"),
        "dash_product_frequency": _with_results(
            "SELECT product_name, count(*) AS count FROM results "
            "WHERE metric = 'top_products' AND product_name IS NOT NULL "
            f"GROUP BY product_name {_top('product_name', 'count')}"),
        "dash_aov": _with_results(_aov("latest")),
        "dash_aov_cumulative": _with_results(_aov("cumulative")),
        "aov_histogram": _with_results(_histogram("latest")),
        "category_share": _with_results(
            "SELECT l1_category, total_sales, "
            "round(total_sales / nullif(sum(total_sales) OVER (), 0), 9) AS share FROM results "
            "WHERE metric = 'sales_by_category' AND l1_category IS NOT NULL AND epoch_id = "
            "(SELECT max(epoch_id) FROM results)"),
        "last_100_per_metric": (
            f"SELECT metric, event_id, user_id, value FROM ({last_messages}) QUALIFY "
            "row_number() OVER (PARTITION BY metric ORDER BY event_id DESC) <= 100"),
        "last_100_messages": f"{last_messages} ORDER BY event_id DESC LIMIT 100",
        "sales_trend_bounded_stream": trend_over_events,
        "result_feed_stream": f"{last_messages} AND event_type NOT IN ('error', 'signup')",
        "result_feed_errors_stream": (
            "SELECT props AS error, event_id, user_id, value FROM events "
            "WHERE event_type = 'error' AND props IS NOT NULL"),
        "recent_messages_stream": (
            f"SELECT metric, event_id, user_id, value FROM ({last_messages} "
            "AND event_type NOT IN ('error', 'signup')) QUALIFY "
            "row_number() OVER (PARTITION BY metric ORDER BY event_id DESC) <= 100"),
    }
    stored = _last_line_per_order(
        ", ".join(FIELD_NAMES), f"(SELECT {_TEXT_FIELDS} FROM order_lines)")
    kind = "split_part(p_name, ' ', 2)"
    product = {
        "product_id": "p_partkey", "product_name": "p_name",
        "unit": "CASE WHEN p_size <> 1 THEN CAST(p_size AS VARCHAR) ELSE '' END",
        "product_type": kind, "brand_name": "p_brand", "l0_category": kind,
        "l1_category": "p_type", "l2_category": "p_name", "l0_category_id": "p_size",
        "l1_category_id": "p_size", "l2_category_id": "p_partkey",
    }
    cells = ", ".join(f"'{name}', coalesce(CAST({source} AS VARCHAR), '')"
                      for name, source in product.items())
    sql |= {
        "one_pass_discount_only": _with_lines(_metric("discount_by_brand")),
        "one_pass_two_counts": _with_lines(
            f"SELECT l1_category, {_sum_as_double('unit_selling_price')} / "
            "nullif(count(unit_selling_price), 0) AS avg_unit_selling_price, "
            "count(procured_quantity) AS lines, "
            f"{_sum_as_double('total_discount_amount')} AS discount "
            "FROM order_lines GROUP BY l1_category"),
        "upsert_orders_new_checkpoint_stream": _with_lines(stored),
        "compacted_orders": _with_lines(stored),
        "keyed_table_view": _with_lines(stored),
        "order_lookup": _with_lines(
            f"SELECT * FROM ({stored}) WHERE row_key IN "
            "((SELECT CAST(min(l_orderkey) AS VARCHAR) FROM lineitem), "
            "(SELECT CAST(max(l_orderkey) AS VARCHAR) FROM lineitem))"),
        "metric_log_new_checkpoint_stream": _with_lines(_stacked(_METRIC_NAMES)),
        "result_feed_repeated_stream": _with_lines(_stacked(_METRIC_NAMES)),
        "replay_unknown_fields": (
            "SELECT event_type AS metric, event_id, user_id AS customer, value AS amount "
            "FROM events WHERE event_type NOT IN ('error', 'purchase')"),
        "malformed_orders": (
            "SELECT 'failed: ' || event_id AS malformed FROM events "
            "WHERE event_type = 'error'"),
        "non_numeric_measures": (
            "SELECT 'unit_selling_price' AS field, count(*) AS non_numeric FROM events "
            "WHERE event_type = 'purchase' AND user_id % 10 = 0 HAVING count(*) > 0"),
        "publish_csv_rows": f"SELECT CAST(json_object({cells}) AS VARCHAR) AS value FROM part",
        "dash_brands_without_measure": _with_results(
            "SELECT brand_name, count(*) AS brand_count FROM results "
            "WHERE metric = 'discount_by_brand' AND brand_name IS NOT NULL "
            "GROUP BY brand_name"),
    }
    purchases = "FROM events WHERE event_type = 'purchase'"
    sql |= {
        "replay_repeated_unknown_metrics": (
            "SELECT 'purchases_by_event' AS metric, event_id, value, 't' || user_id AS topic, "
            f"CAST(event_id % 7 AS BIGINT) AS partition, user_id AS offset, event_type AS key {purchases}"),
        "prep_sales_stream": sql["prep_sales"],
        "top_brands_best_stream": sql["top_brands"],
        "top_products_best_stream": sql["top_products"],
        "sales_trend_corrected_stream": sql["sales_trend"],
        "reject_reasons": (
            "SELECT reason, count(*) AS rows FROM (SELECT unnest(['read', CASE WHEN event_type = "
            "'error' THEN 'not_json' WHEN event_type <> 'purchase' THEN 'no_key' WHEN user_id % 10 "
            "= 0 THEN 'unread:unit_selling_price' ELSE 'kept' END]) AS reason FROM events) "
            "GROUP BY reason"),
        "incomplete_sales": _with_lines(
            "SELECT reason, count(*) AS rows FROM (SELECT unnest(['read', CASE WHEN "
            "total_discount_amount = 0 THEN 'missing:total_discount_amount' ELSE 'kept' END]) "
            "AS reason FROM order_lines) GROUP BY reason"),
        "aov_histogram_sketch": _with_results(
            f"SELECT *, true AS close FROM ({_histogram('cumulative')})"),
        "replay_repeated_errors":
            "SELECT 'e' || event_id AS error FROM events WHERE event_type = 'error'",
        "result_feed_deduplicated_stream": _with_lines(_stacked(_METRIC_NAMES)),
        "recent_state_stream": sql["recent_messages_stream"],
        "keyed_source_sink_stream": _with_lines(stored),
        "throttled_feed_stream": (
            "SELECT CAST(count(*) AS BIGINT) AS messages, true AS within_limit FROM events "
            "WHERE (event_type = 'error' AND props IS NOT NULL) "
            "OR event_type NOT IN ('error', 'signup', '')"),
        "land_variant_orders": sql["parse_orders"],
        "totals_during_rerun_stream": _with_lines(_stacked(_METRIC_NAMES)),
        "compacted_totals_stream": _with_lines(_stacked(_METRIC_NAMES)),
        "lines_per_order_bucketed": _with_lines(
            "SELECT row_key, city_name, lines, quantity FROM "
            f"({_last_line_per_order('city_name', '(SELECT ' + _TEXT_FIELDS + ' FROM order_lines)')}) "
            "JOIN (SELECT CAST(order_id AS VARCHAR) AS row_key, count(*) AS lines, "
            "CAST(sum(procured_quantity) AS BIGINT) AS quantity FROM order_lines GROUP BY order_id) "
            "USING (row_key)"),
        "keyed_table_restated": _with_lines(_last_line_per_order(_SENT_FIELDS, "order_lines")),
        "keyed_table_lookup": _with_lines(
            f"SELECT * FROM ({_last_line_per_order(_SENT_FIELDS, 'order_lines')}) WHERE row_key = "
            "(SELECT CAST(max(l_orderkey) AS VARCHAR) FROM lineitem)"),
    }
    sql |= {f"{name}_changes_stream": _with_lines(_metric(name)) for name in _METRIC_NAMES}
    for suffix, mode in (("", "latest"), ("_cumulative", "cumulative")):
        sql |= {
            f"dash_top_products{suffix}": _dash(
                "top_products", "product_name", "total_quantity_sold", mode,
                _top("product_name", "total_quantity_sold")),
            f"dash_top_brands{suffix}": _dash(
                "top_brands", "brand_name", "brand_count", mode,
                _top("brand_name", "brand_count")),
            f"dash_sales_by_category{suffix}": _dash(
                "sales_by_category", "l1_category", "total_sales", mode),
            f"dash_quantity_by_city{suffix}": _dash(
                "quantity_by_city", "city_name", "total_procured_quantity", mode,
                "ORDER BY total_procured_quantity DESC"),
        }
    sql |= {f"{name}_stream": _with_lines(_metric(name)) for name in _METRIC_NAMES}
    return sql
