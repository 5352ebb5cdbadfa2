from datetime import datetime
from decimal import Decimal

from tillstream.operators.parse import malformed_messages, parse_orders, wire_lines
from tillstream.schema import EXACT_MONEY, FIELD_NAMES
from tillstream.sources.topics import order_payload


def one(table):
    (row,) = table.collect()
    return row


def test_quoted_numbers_are_read_unless_strict(messages):
    sent = messages({"order_id": "5", "unit_selling_price": "1.5", "city_name": "Pune"})
    row = one(parse_orders(sent))
    assert (row.order_id, row.unit_selling_price, row.city_name) == (5, 1.5, "Pune")
    row = one(parse_orders(sent, strict=True))
    assert (row.order_id, row.unit_selling_price, row.city_name) == (None, None, "Pune")


def test_bare_numbers_are_read_either_way(messages):
    sent = messages({"order_id": 5, "unit_selling_price": 1.5})
    for strict in (False, True):
        row = one(parse_orders(sent, strict=strict))
        assert (row.order_id, row.unit_selling_price) == (5, 1.5)


def test_large_and_fractional_ids(messages):
    sent = messages({"order_id": 3000000000, "cart_id": "7.0", "product_id": "7.5"})
    row = one(parse_orders(sent))
    assert (row.order_id, row.cart_id, row.product_id) == (3000000000, 7, None)
    assert one(parse_orders(sent, strict=True)).order_id is None


def test_malformed_message_is_a_row_of_nulls_and_quarantined(messages):
    sent = messages("not json", {"order_id": "1"})
    parsed = parse_orders(sent)
    assert parsed.count() == 2
    assert parsed.where("order_id IS NULL").count() == 1
    assert one(malformed_messages(sent)).malformed == "not json"


def test_text_that_is_no_number_is_null(messages):
    row = one(parse_orders(messages({"order_id": "x", "procured_quantity": "", "unit": "1 kg"})))
    assert (row.order_id, row.procured_quantity, row.unit) == (None, None, "1 kg")


def test_date_without_time(messages):
    sent = messages({"date_": "2022-04-01"})
    assert one(parse_orders(sent)).timestamp is None
    row = one(parse_orders(sent, accept_date_only=True))
    assert row.timestamp == datetime(2022, 4, 1)
    row = one(parse_orders(messages({"date_": "2022-04-01 10:20:30"})))
    assert row.timestamp == datetime(2022, 4, 1, 10, 20, 30)


def test_exact_money(messages):
    row = one(parse_orders(messages({"unit_selling_price": "0.1"}), EXACT_MONEY))
    assert row.unit_selling_price == Decimal("0.1000")


def test_only_asked_fields(messages):
    parsed = parse_orders(messages({"order_id": "1", "unit": "kg"}), fields=["order_id"])
    assert parsed.columns == ["order_id"]
    assert one(parsed).order_id == 1


def test_payload_round_trip(lines):
    table = lines(
        {"order_id": 1, "product_name": 'a "b", ü\n', "unit_selling_price": 1.25,
         "date_": "2022-04-01 00:00:00"},
        {"order_id": None, "product_name": "", "unit_selling_price": None},
    )
    sent = table.select(order_payload(table.select(*FIELD_NAMES)).alias("value"))
    back = parse_orders(sent, EXACT_MONEY)
    assert back.exceptAll(table).count() == 0
    assert table.exceptAll(back).count() == 0


def test_payload_keeps_null_fields_and_quotes_numbers(lines):
    table = lines({"order_id": 1}).select("order_id", "unit")
    assert one(table.select(order_payload(table).alias("v"))).v == '{"order_id":"1","unit":null}'


def test_wire_lines_are_text(messages):
    row = one(wire_lines(messages({"order_id": 1, "unit_selling_price": "1.50"})))
    assert (row.order_id, row.unit_selling_price) == ("1", "1.50")
