import json
import random
from datetime import datetime

import pytest

from tillstream.operators import metrics
from tillstream.operators.metrics import METRICS


def compute(name, table):
    return METRICS[name].compute(table)


def test_sales_are_prices_not_prices_times_quantity(lines, rows):
    table = lines({"l1_category": "a", "unit_selling_price": 2.5, "procured_quantity": 4},
                  {"l1_category": "a", "unit_selling_price": 1.0, "procured_quantity": 9})
    assert rows(compute("sales_by_category", table)) == [("a", 3.5)]


def test_orders_are_lines_with_an_order(lines, rows):
    table = lines({"city_name": "x", "order_id": 1}, {"city_name": "x", "order_id": 1},
                  {"city_name": "x", "order_id": None})
    assert rows(compute("orders_by_city", table)) == [("x", 2)]


def test_null_brand_is_a_group_with_count_zero(lines, rows):
    table = lines({"brand_name": None}, {"brand_name": None}, {"brand_name": "b"})
    assert rows(compute("top_brands", table)) == [("b", 1), (None, 0)]


def test_average_order_value_without_orders_is_null(lines, rows):
    table = lines({"dim_customer_key": 1, "unit_selling_price": 5.0},
                  {"dim_customer_key": 2, "unit_selling_price": 5.0, "order_id": 1},
                  {"dim_customer_key": 2, "unit_selling_price": 2.0, "order_id": 1})
    assert rows(compute("aov_by_customer", table)) == [(1, 5.0, 0, None), (2, 7.0, 2, 3.5)]


def test_mean_ignores_missing_prices(lines, rows):
    table = lines({"l1_category": "a", "unit_selling_price": 1.0},
                  {"l1_category": "a", "unit_selling_price": 2.0},
                  {"l1_category": "a"}, {"l1_category": "b"})
    assert rows(compute("avg_price_by_category", table)) == [("a", 1.5), ("b", None)]


@pytest.mark.parametrize("name, field", [("top_brands", "brand_name"),
                                         ("top_products", "product_name")])
def test_ties_at_the_cut_go_to_the_lower_name(lines, name, field):
    table = lines(*[{field: f"n{i:02d}", "procured_quantity": 3}
                    for i in reversed(range(11))])
    assert [row[0] for row in compute(name, table).collect()] == [f"n{i:02d}" for i in range(10)]


def test_trend_windows(lines, rows):
    table = lines(
        {"l1_category": "a", "date_": "2022-04-01 10:09:59", "unit_selling_price": 1.0},
        {"l1_category": "a", "date_": "2022-04-01 10:10:00", "unit_selling_price": 2.0},
        {"l1_category": "a", "date_": "2022-04-01", "unit_selling_price": 4.0},
        {"l1_category": "a", "date_": None, "unit_selling_price": 8.0},
    )
    assert rows(compute("sales_trend", table).select("window.start", "window.end", "sales")) == [
        (datetime(2022, 4, 1, 10, 0), datetime(2022, 4, 1, 10, 10), 1.0),
        (datetime(2022, 4, 1, 10, 10), datetime(2022, 4, 1, 10, 20), 2.0),
    ]
    assert rows(compute("sales_by_category", table)) == [("a", 15.0)]


def test_one_pass_equals_the_single_metrics(lines, rows):
    rng = random.Random(1)
    # A third of the lines share one customer, brand and city; keys may be missing.
    hot = {"dim_customer_key": 1, "brand_name": "hot", "city_name": "hot"}
    table = lines(*[
        {
            "l1_category": rng.choice(["a", "b", None]),
            "city_name": rng.choice(["x", "y", None]),
            "brand_name": rng.choice([f"b{i}" for i in range(14)] + [None]),
            "product_name": rng.choice([f"p{i}" for i in range(14)] + [None]),
            "dim_customer_key": rng.choice([1, 2, 3, None]),
            "order_id": rng.choice([1, 2, None]),
            "procured_quantity": rng.choice([1, 2, 3, None]),
            "unit_selling_price": rng.choice([0.1, 0.2, 99.99, None]),
            "total_discount_amount": rng.choice([0.0, 0.01, None]),
            "date_": rng.choice(["2022-04-01 10:09:59", "2022-04-01 10:10:00",
                                 "1969-12-31 23:59:59", "2022-04-01", None]),
            **(hot if i % 3 == 0 else {}),
        }
        for i in range(600)
    ])
    totals = metrics.compute_all(table)
    for metric in metrics.ALL:
        assert rows(metrics.pick(totals, metric)) == rows(metric.compute(table)), metric.name


def test_one_pass_of_some_metrics_keeps_totals_in_a_table(lines, rows, tmp_path):
    table = lines({"l1_category": "a", "unit_selling_price": 1.0}, {"l1_category": None})
    wanted = [METRICS["sales_by_category"], METRICS["sales_trend"]]
    found = metrics.compute_all_once(table, str(tmp_path / "totals"), wanted)
    assert rows(found["sales_by_category"]) == [("a", 1.0), (None, None)]
    assert rows(found["sales_trend"]) == []
    assert {p.name for p in (tmp_path / "totals").glob("key_set=*")} == {"key_set=l1_category"}


def test_messages_leave_null_keys_out(lines, rows):
    table = lines({"brand_name": None}, {"brand_name": "b"})
    sent = metrics.result_messages({"top_brands": compute("top_brands", table)}, 3, "r")
    found = [(m, run, epoch, json.loads(value)) for m, run, epoch, value in rows(sent)]
    times = {value.pop("published_at") for *_, value in found}
    assert len(times) == 1
    ids = {value.pop("message_id") for *_, value in found}
    assert len(ids) == 2  # every message has its own
    envelope = {"metric": "top_brands", "run_id": "r", "epoch_id": 3}
    assert [value for *_, value in found] == [
        {"brand_count": 0, **envelope}, {"brand_name": "b", "brand_count": 1, **envelope}]


def test_no_lines_no_groups(lines):
    table = lines({"l1_category": "a"}).where("false")
    for metric in METRICS.values():
        assert metric.compute(table).count() == 0


EXTRA = (
    metrics.Metric("lines_by_brand", "brand_name",
                   (metrics.Measure("n", "count", "procured_quantity"),
                    metrics.Measure("mean", "mean", "total_discount_amount"))),
    metrics.Metric("landing_by_city", "city_name",
                   (metrics.Measure("landing", "money", "total_weighted_landing_price"),)),
)


@pytest.mark.parametrize("first", range(11))
def test_one_pass_gives_any_two_metrics(lines, tmp_path, rows, first):
    """Over just the fields the two read, as a job selects them."""
    every = [*metrics.ALL, *EXTRA]
    table = lines(*[
        {"order_id": i if i % 3 else None, "l1_category": "ab"[i % 2], "city_name": "xyz"[i % 3],
         "brand_name": "pq"[i % 2] if i % 5 else None, "product_name": "uv"[i % 2],
         "dim_customer_key": i % 4, "procured_quantity": i if i % 4 else None,
         "unit_selling_price": 0.75 * i, "total_discount_amount": 0.75 if i % 2 else None,
         "total_weighted_landing_price": 1.25 * i, "date_": "2022-04-01 10:00:00"}
        for i in range(1, 13)]).persist()
    for second in range(first, len(every)):
        wanted = list(dict.fromkeys([every[first], every[second]]))
        fields = [f if f != "date_" else "timestamp" for f in metrics.fields_of(wanted)]
        totals = metrics.compute_all(table.select(*fields), wanted)
        for metric in wanted:
            assert rows(metrics.pick(totals, metric)) == rows(metric.compute(table)), (
                metric.name, wanted)


def test_one_pass_refuses_lines_without_a_field(lines):
    with pytest.raises(ValueError, match="total_discount_amount"):
        metrics.compute_all(lines().select("brand_name"), [metrics.METRICS["discount_by_brand"]])
