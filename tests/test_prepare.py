from functools import partial

import pytest

from tillstream.operators.prepare import prepare, with_types
from tillstream.schema import EXACT_MONEY, MISSING_TOKENS
from tillstream.sources.csv_files import read_csv, write_csv


@pytest.fixture
def files(spark, tmp_path):
    def make(sales, products, **options):
        (tmp_path / "s.csv").write_text(sales, encoding="utf-8")
        (tmp_path / "p.csv").write_text(products, encoding="utf-8")
        return (read_csv(spark, str(tmp_path / "s.csv"), **options),
                read_csv(spark, str(tmp_path / "p.csv"), **options))

    return make


def test_join_without_index_columns(files, rows):
    sales, products = files(
        "Unnamed: 0,product_id,order_id\n0,1,10\n1,2,11\n2,1,12\n3,9,13\n",
        ",Unnamed: 0.1,product_id,unit\n0,0,1,kg\n1,1,2,l\n",
    )
    table = prepare(sales, products)
    assert table.columns == ["product_id", "order_id", "unit"]
    assert rows(table) == [("1", "10", "kg"), ("1", "12", "kg"), ("2", "11", "l")]


def test_every_missing_token_removes_its_row(files):
    tokens = "".join(f"{i},{token}\n" for i, token in enumerate(MISSING_TOKENS))
    sales, products = files("product_id,city_name\n" + tokens + "99,Pune\n",
                            "product_id,unit\n" + "".join(f"{i},kg\n" for i in range(100)))
    assert prepare(sales, products).collect() == [("99", "Pune", "kg")]
    assert len(MISSING_TOKENS) == 19


def test_token_with_blanks_is_a_value(files):
    sales, products = files("product_id,city_name\n1, NA\n", "product_id,unit\n1,kg\n")
    assert prepare(sales, products).collect() == [("1", " NA", "kg")]


def test_missing_index_value_does_not_matter(files):
    sales, products = files("Unnamed: 0,product_id\n,1\n", "product_id,unit\n1,kg\n")
    assert prepare(sales, products).count() == 1


def test_null_keys_do_not_meet(files):
    sales, products = files("product_id,order_id\n,1\n", "product_id,unit\n,kg\n")
    assert prepare(sales, products).count() == 0


def test_numeric_keys_meet_by_value(files, rows):
    sales, products = files("product_id,order_id\n5,1\n05,2\n5.0,3\nx,4\n",
                            "product_id,unit\n5,kg\nx,l\n")
    assert rows(prepare(sales, products)) == [
        ("05", "2", "kg"), ("5", "1", "kg"), ("5.0", "3", "kg"), ("x", "4", "l")]


def test_shared_columns_get_suffixes(files):
    sales, products = files("product_id,price\n1,5\n", "product_id,price\n1,7\n")
    (row,) = prepare(sales, products).collect()
    assert row.asDict() == {"product_id": "1", "price_x": "5", "price_y": "7"}


def test_column_names_with_dots_and_blanks(files):
    sales, products = files("product_id,a.b,c d\n1,5,x\n1,,x\n", "product_id,a.b\n1,7\n")
    (row,) = prepare(sales, products).collect()
    assert row.asDict() == {"product_id": "1", "a.b_x": "5", "c d": "x", "a.b_y": "7"}


def test_cells_with_commas_quotes_and_line_breaks(spark, files, tmp_path, rows):
    sales, products = files('product_id,city_name\n1,"a, ""b"""\n2,"two\nlines"\n',
                            "product_id,unit\n1,kg\n2,l\n", multi_line=True)
    table = prepare(sales, products)
    write_csv(table, str(tmp_path / "out"))
    back = read_csv(spark, str(tmp_path / "out"), multi_line=True)
    assert rows(back) == rows(table) == [("1", 'a, "b"', "kg"), ("2", "two\nlines", "l")]


def test_csv_keeps_blank_and_empty_apart(spark, tmp_path, rows):
    table = spark.createDataFrame([(None, "a"), ("", "b"), (" x ", "c")], "t string, k string")
    write_csv(table, str(tmp_path / "out"))
    assert rows(read_csv(spark, str(tmp_path / "out"))) == rows(table)


def test_types(files):
    sales, products = files("product_id,procured_quantity,unit_selling_price\n1,2.0,3.5\n",
                            "product_id,unit\n1,kg\n")
    (row,) = with_types(prepare(sales, products)).collect()
    assert row.asDict() == {
        "product_id": 1, "unit": "kg", "procured_quantity": 2, "unit_selling_price": 3.5}


def test_cells_read_before_the_join_give_the_same_rows(files, rows):
    sales, products = files(
        "product_id,order_id,unit,unit_selling_price,other\n05,1.0,a,2.5,x\n5.0,x,b,3.12345,y\n"
        "x,3,c,1e2,z\n5,NA,d,1,w\n7,8,e,words,v\n",
        "product_id,unit,brand_name,l0_category_id\n5,kg,B,1.0\nx,l,C,two\n7,m,D,3\n7,n,D,4\n")
    after = with_types(prepare(sales, products), EXACT_MONEY)
    before = prepare(sales, products, read=partial(with_types, money=EXACT_MONEY))
    assert rows(before.select(*after.columns)) == rows(after) and after.count() == 5
    assert dict(before.dtypes) == dict(after.dtypes)
