"""CSV scan, manifest load, conform, append, report sink, SQL, and the audits."""

from __future__ import annotations

import pytest
from conftest import rows

from marketlens.operators import audit as A
from marketlens.schema import DEFAULT_MANIFEST, table_schema
from marketlens.session import scratch_path
from marketlens.sources import files as IO
from marketlens.sources.sql import run_sql
from marketlens.tables import Tables

REVIEWS_CSV = '''order_id,review_id,review_score,review_comment_message,review_creation_date
o1,r1,5,"great, fast
arrived on a ""Sunday""",2017-02-06 10:00:00
o2,r2,1,,2017-02-12 08:30:00
'''


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_csv_by_header_name_quoted_multiline(spark, tmp_path):
    path = write(tmp_path, "reviews.csv", REVIEWS_CSV)
    df = IO.read_csv(spark, path, table_schema("order_reviews"))
    assert df.columns == [f.name for f in table_schema("order_reviews").fields]
    got = {r.review_id: r for r in df.collect()}
    assert got["r1"].order_id == "o1" and got["r1"].review_score == 5
    assert got["r1"].review_comment_message == 'great, fast\narrived on a "Sunday"'
    assert got["r2"].review_comment_message is None and got["r2"].review_answer_timestamp is None
    assert str(got["r2"].review_creation_date) == "2017-02-12 08:30:00"


def test_zip_codes_keep_leading_zeros_and_rename(spark, tmp_path):
    path = write(tmp_path, "c.csv", "id,customer_zip_code_prefix,customer_state\nc1,01310,SP\n")
    df = IO.read_csv(spark, path, table_schema("customers"),
                     rename={"id": "customer_id", "customer_zip_code_prefix": "customer_zip_code"},
                     required=["customer_id"])
    r = df.collect()[0]
    assert (r.customer_id, r.customer_zip_code, r.customer_state) == ("c1", "01310", "SP")


def test_conform_rejects_unknown_and_missing_key_columns(spark, tmp_path):
    path = write(tmp_path, "x.csv", "customer_id,shoe_size\nc1,42\n")
    with pytest.raises(ValueError, match="not in the declared schema"):
        IO.read_csv(spark, path, table_schema("customers"))
    path = write(tmp_path, "y.csv", "customer_state\nSP\n")
    with pytest.raises(ValueError, match="required"):
        IO.read_csv(spark, path, table_schema("customers"), required=["customer_id"])


def test_cast_failures_counts_bad_values(spark):
    raw = spark.createDataFrame([("o1", "3", "12.50"), ("o2", "x", "1e400"), ("o3", None, "abc")],
                                "order_id string, payment_installments string, payment_value string")
    got = dict(rows(IO.cast_failures(raw, table_schema("order_payments"))))
    assert got == {"order_id": 0, "payment_installments": 1, "payment_value": 2}


def test_manifest_load_append_and_report_sink(spark, fixture_tables):
    base = scratch_path(spark, "test-manifest")
    frames = fixture_tables.as_dict()
    for filename, name in DEFAULT_MANIFEST:
        IO.write_csv(frames[name], f"{base}/{filename}")
    loaded = IO.load_tables(spark, base)
    counts = dict(rows(A.load_counts(loaded)))
    assert counts == {n: frames[n].count() for n in frames}
    assert rows(loaded["order_items"].orderBy("order_id", "order_item_id").select("price"))[4][0] == 0

    target = scratch_path(spark, "test-append")
    IO.append_table(frames["order_payments"], target)
    IO.append_table(frames["order_payments"], target)
    assert spark.read.parquet(target).count() == 12

    out = IO.write_report(frames["sellers"], scratch_path(spark, "test-reports"), "sellers")
    IO.write_report(frames["sellers"], out.rsplit("/", 1)[0], "sellers")      # overwrite, not append
    assert spark.read.parquet(out).count() == 2


def test_run_sql_with_placeholders_and_views(spark, fixture_tables):
    text = "SELECT payment_type, COUNT(*) AS n FROM {p} GROUP BY payment_type ORDER BY n DESC, payment_type"
    got = rows(run_sql(spark, text, {"p": fixture_tables.order_payments}))
    assert got == [("credit_card", 3), ("boleto", 2), ("voucher", 1)]
    got = rows(run_sql(spark, "SELECT COUNT(*) FROM ml_test_reviews", {"ml_test_reviews": fixture_tables.order_reviews},
                       views=True))
    assert got == [(6,)]


def test_audits_find_duplicates_orphans_and_long_values(spark, fixture_tables):
    t = fixture_tables.as_dict()
    extra_order = spark.createDataFrame([("o1", "c9", "delivered"), (None, "c1", "shipped")],
                                        "order_id string, customer_id string, order_status string")
    t["orders"] = t["orders"].unionByName(extra_order, allowMissingColumns=True)
    pk = {r.table_name: r for r in A.check_primary_keys(t).collect()}
    assert (pk["orders"].row_count, pk["orders"].null_keys, pk["orders"].duplicate_keys,
            pk["orders"].duplicate_rows) == (8, 1, 1, 2)
    assert pk["customers"].duplicate_keys == 0
    fk = {(r.child_table, r.child_column): r.orphan_rows for r in A.check_foreign_keys(t).collect()}
    assert fk[("orders", "customer_id")] == 1          # c9 has no customer
    assert fk[("order_items", "order_id")] == 0
    ln = {(r.table_name, r.column_name): (r.declared_bound, r.max_length, r.over_bound_rows)
          for r in A.check_lengths(Tables.from_dict(t).as_dict()).collect()}
    assert ln[("customers", "customer_state")] == (2, 2, 0)
    assert ln[("orders", "order_status")] == (20, 9, 0)


def _csv(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)


def test_csv_files_with_other_column_order_raise(spark, tmp_path):
    from marketlens.sources.files import read_csv
    for second in ("payment_type,order_id\nboleto,o2\n", "value,order_id\n3,o2\n"):
        folder = tmp_path / second[:5]
        _csv(folder, "a.csv", "order_id," + ("payment_type" if second.startswith("p") else "value") + "\no1,9\n")
        _csv(folder, "b.csv", second)
        with pytest.raises(Exception, match="header|CSV"):
            read_csv(spark, str(folder)).collect()


def test_plain_csv_is_read_in_splits_and_free_text_whole(spark, tmp_path):
    from marketlens.schema import FREE_TEXT
    from marketlens.sources.files import read_csv
    _csv(tmp_path / "big", "a.csv", "id,v\n" + "".join(f"{i},{'x' * 50}\n" for i in range(40_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        df = read_csv(spark, str(tmp_path / "big"))
        assert df.rdd.getNumPartitions() > 1 and df.count() == 40_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    _csv(tmp_path / "text", "a.csv", 'id,v\n1,"two\nlines"\n')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "text"), multi_line=True).collect()] == [("1", "two\nlines")]
    assert FREE_TEXT == {"review_comment_message"}


def test_csv_report_has_a_header(spark, tmp_path):
    from marketlens.sources.files import read_report, write_report
    path = write_report(spark.createDataFrame([(1, "a")], "n int, s string"), str(tmp_path), "r", "csv")
    assert [r.asDict() for r in read_report(spark, path, "csv").collect()] == [{"n": "1", "s": "a"}]


def test_settings_of_the_caller_survive(spark):
    from marketlens.session import apply_report_conf
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "false")
    try:
        apply_report_conf(spark)
        assert spark.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "false"
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == before
        assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    finally:
        spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")


def test_money_must_be_decimal_and_declared_name_is_accepted(fixture_tables):
    frames = fixture_tables.as_dict()
    renamed = {("product_category_translation" if n == "category_translation" else n): f for n, f in frames.items()}
    assert type(fixture_tables).from_dict(renamed).category_translation is frames["category_translation"]
    items = frames["order_items"].withColumn("price", frames["order_items"].price.cast("double"))
    with pytest.raises(TypeError, match="DECIMAL"):
        type(fixture_tables).from_dict({**frames, "order_items": items})


def test_chart_k_is_not_capped(spark, fixture_tables):
    from marketlens.plans import charts
    many = spark.range(30).selectExpr("concat('p', id) AS product_id", "concat('c', id) AS product_category_name")
    items = spark.range(30).selectExpr("'o1' AS order_id", "int(id) AS order_item_id", "concat('p', id) AS product_id",
                                       "'s1' AS seller_id", "cast(id + 1 as decimal(10,2)) AS price",
                                       "cast(1 as decimal(10,2)) AS freight_value")
    t = type(fixture_tables).from_dict({**fixture_tables.as_dict(), "products": many, "order_items": items})
    assert charts.chart_category_bars(t, k=30).count() == 30
    assert charts.chart_review_bars(t, min_reviews=0, k=30).count() == 30


def test_params_parse_booleans():
    from marketlens.__main__ import parse_params
    assert parse_params(["q01_monthly_revenue.narrow=False"]) == {"q01_monthly_revenue": {"narrow": False}}
