from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marketlens.schema import table_schema  # noqa: E402
from marketlens.tables import Tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    import tempfile

    from marketlens.session import get_session
    s = get_session("local[4]", shuffle_partitions=4, extra={
        "spark.driver.memory": "8g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="marketlens-tests-")})
    yield s
    s.stop()


def ts(text: str | None):
    return None if text is None else dt.datetime.fromisoformat(text)


def d(text: str) -> Decimal:
    return Decimal(text)


@pytest.fixture(scope="session")
def fixture_tables(spark) -> Tables:
    """The hand-made data set of FIXTURES.md section 3 (declared types, string ids)."""
    def frame(name, rows, columns):
        schema = table_schema(name)
        full = [{c: None for c in schema.fieldNames()} | dict(zip(columns, r)) for r in rows]
        return spark.createDataFrame([tuple(r[c] for c in schema.fieldNames()) for r in full], schema)

    customers = frame("customers", [("c1", "u1", "SP"), ("c2", "u1", "SP"), ("c3", "u2", "RJ"),
                                    ("c4", "u3", "MA"), ("c5", "u4", "RJ")],
                      ["customer_id", "customer_unique_id", "customer_state"])
    sellers = frame("sellers", [("s1", "campinas", "SP"), ("s2", "niteroi", "RJ")],
                    ["seller_id", "seller_city", "seller_state"])
    products = frame("products", [("p1", "beleza"), ("p2", "esporte"), ("p3", None), ("p4", "perfume")],
                     ["product_id", "product_category_name"])
    translation = frame("category_translation",
                        [("beleza", "health_beauty"), ("perfume", "health_beauty"), ("unused", "unused_en")],
                        ["product_category_name", "product_category_name_english"])
    orders = frame("orders", [
        ("o1", "c1", "delivered", ts("2017-01-31 23:59:59"), ts("2017-02-05 12:00"), ts("2017-02-05 12:00")),
        ("o2", "c2", "delivered", ts("2017-02-01 00:00"), ts("2017-02-11 06:00"), ts("2017-02-10 00:00")),
        ("o3", "c3", "delivered", ts("2016-12-31 10:00"), ts("2017-01-02 10:00"), ts("2017-01-20 00:00")),
        ("o4", "c4", "delivered", ts("2017-02-15 08:00"), ts("2017-02-20 08:00"), None),
        ("o5", "c5", "delivered", ts("2017-03-01 00:00"), None, ts("2017-03-10 00:00")),
        ("o6", "c3", "canceled", ts("2017-03-02 00:00"), None, ts("2017-03-12 00:00")),
    ], ["order_id", "customer_id", "order_status", "order_purchase_timestamp",
        "order_delivered_customer_date", "order_estimated_delivery_date"])
    items = frame("order_items", [
        ("o1", 1, "p1", "s1", d("10.00"), d("1.50")), ("o1", 2, "p2", "s1", d("20.01"), d("2.00")),
        ("o2", 1, "p1", "s2", d("100.00"), d("10.00")), ("o3", 1, "p3", "s1", d("5.00"), d("1.00")),
        ("o4", 1, "p4", "s2", d("0.00"), d("7.00")), ("o4", 2, "p3", "s2", d("60.00"), d("6.00")),
        ("o5", 1, "p2", "s1", d("80.00"), d("8.05")), ("o6", 1, "p1", "s1", d("33.33"), d("3.33")),
    ], ["order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value"])
    payments = frame("order_payments", [
        ("o1", 1, "credit_card", 3, d("33.51")), ("o2", 1, "boleto", 1, d("100.00")),
        ("o2", 2, "voucher", 1, d("10.00")), ("o3", 1, "credit_card", 2, d("6.00")),
        ("o4", 1, "credit_card", 10, d("73.00")), ("o5", 1, "boleto", 1, d("88.05")),
    ], ["order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value"])
    reviews = frame("order_reviews", [("r1", "o1", 5), ("r2", "o2", 1), ("r3", "o2", 2), ("r4", "o3", 4),
                                      ("r5", "o4", 3), ("r6", "o6", 5)],
                    ["review_id", "order_id", "review_score"])
    return Tables(customers=customers, sellers=sellers, products=products, orders=orders,
                  order_items=items, order_payments=payments, order_reviews=reviews,
                  category_translation=translation)


def rows(df):
    """Collected rows as plain tuples, in the frame's order."""
    return [tuple(r) for r in df.collect()]
