"""Property test of the exact rounding helpers, and the incremental streaming load."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketlens.functions import numeric as N
from marketlens.schema import table_schema
from marketlens.session import scratch_path
from marketlens.streaming.ingest import load_new_files

pairs = st.lists(st.tuples(st.integers(-10**24, 10**24), st.integers(1, 10**20)), min_size=1, max_size=200)

# a few quotients far beyond the BIGINT range, checked on every run
BIG = [(922_367_660_157_564, 1), (10**24, 3), (-(10**24) + 1, 7), (5, 2), (-5, 2), (1, 10**20)]


def test_round_ratio_large_quotients(spark):
    df = spark.createDataFrame([(str(n), str(d)) for n, d in BIG], "n string, d string")
    for places in (0, 4):
        got = df.select(N.round_ratio(F.col("n").cast("decimal(38,0)"), F.col("d").cast("decimal(38,0)"),
                                      places).alias("v")).collect()
        s = 10 ** places
        want = [float(Decimal((-1 if n < 0 else 1) * ((2 * s * abs(n) + d) // (2 * d))).scaleb(-places))
                for n, d in BIG]
        assert [r.v for r in got] == want


def half_up(num: int, den: int, places: int) -> float:
    """Python Decimal reference (inputs small enough for its 28-digit context)."""
    return float((Decimal(num) / Decimal(den)).quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP))


@settings(max_examples=6, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(pairs, st.integers(0, 4))
def test_round_ratio_matches_decimal_half_up(spark, rows, places):
    # exact references through integer arithmetic (Decimal context has 28 digits)
    def exact(n, d):
        s = 10 ** places
        q = (2 * s * abs(n) + d) // (2 * d)
        return float(Decimal(-q if n < 0 else q).scaleb(-places))
    df = spark.createDataFrame([(str(n), str(d)) for n, d in rows], "n string, d string")
    got = df.select(N.round_ratio(F.col("n").cast("decimal(38,0)"), F.col("d").cast("decimal(38,0)"),
                                  places).alias("v")).collect()
    assert [r.v for r in got] == [exact(n, d) for n, d in rows]


@settings(max_examples=6, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(st.lists(st.tuples(st.integers(0, 10**9), st.integers(1, 10**6)), min_size=1, max_size=100))
def test_mean_of_matches_decimal_half_up(spark, rows):
    df = spark.createDataFrame([(Decimal(c).scaleb(-2), n) for c, n in rows], "total decimal(20,2), n bigint")
    got = df.select(N.mean_of("total", "n", 2).alias("v")).collect()
    assert [r.v for r in got] == [half_up(c, 100 * n, 2) for c, n in rows]


def test_streaming_load_appends_each_file_once(spark, tmp_path):
    base = scratch_path(spark, "test-stream")
    src = tmp_path / "incoming"
    src.mkdir()
    header = "order_id,payment_type,payment_installments,payment_value\n"
    (src / "a.csv").write_text(header + "o1,credit_card,3,33.51\no2,boleto,1,100.00\n")
    schema = table_schema("order_payments")
    cols = ["order_id", "payment_type", "payment_installments", "payment_value"]
    run = lambda: load_new_files(spark, str(src), schema, f"{base}/table", f"{base}/ckpt",
                                 header=cols, required=["order_id"])
    run()
    assert spark.read.parquet(f"{base}/table").count() == 2
    run()                                                    # nothing new: nothing appended
    assert spark.read.parquet(f"{base}/table").count() == 2
    (src / "b.csv").write_text(header + "o3,voucher,1,10.00\n")
    run()
    got = sorted((r.order_id, r.payment_value, r.payment_sequential)
                 for r in spark.read.parquet(f"{base}/table").collect())
    assert got == [("o1", Decimal("33.51"), None), ("o2", Decimal("100.00"), None),
                   ("o3", Decimal("10.00"), None)]


@settings(max_examples=4, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(st.lists(st.text(alphabet="abcXYZ019 _-#'.çãé", max_size=30), min_size=1, max_size=200))
def test_title_case_matches_python_title(spark, words):
    from marketlens.functions.exprs import title_case
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    got = [r.t for r in df.orderBy("i").select(title_case("w").alias("t")).collect()]
    assert got == [w.title() for w in words]
