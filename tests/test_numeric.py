"""Rounding, averages, day spans and display helpers (half away from zero, exact)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from marketlens.functions import numeric as N
from marketlens.functions.exprs import (display_int, display_millions, display_pct, segment_expr,
                                        title_case)


def one(spark, col):
    return spark.range(1).select(col.alias("v")).collect()[0].v


def test_round_ratio_half_away_from_zero(spark):
    assert one(spark, N.round_ratio(F.lit(5), F.lit(2), 0)) == 3.0
    assert one(spark, N.round_ratio(F.lit(-5), F.lit(2), 0)) == -3.0
    assert one(spark, N.round_ratio(F.lit(1), F.lit(3), 2)) == 0.33
    assert one(spark, N.round_ratio(F.lit(2), F.lit(3), 2)) == 0.67
    assert one(spark, N.round_ratio(F.lit(-1), F.lit(8), 2)) == -0.13
    assert one(spark, N.round_ratio(F.lit(7), F.lit(0), 2)) is None


def test_round_ratio_is_exact_for_huge_sums(spark):
    # 10**30 + 5 over 10**31: 0.1000...05 rounds to 0.1, not to a float artefact
    num = F.lit("1000000000000000000000000000005").cast("decimal(38,0)")
    den = F.lit("10000000000000000000000000000000").cast("decimal(38,0)")
    assert one(spark, N.round_ratio(num, den, 1)) == 0.1


def test_mean_of_rounds_ties_up_once(spark):
    df = spark.createDataFrame([(Decimal("16.75"),), (Decimal("16.76"),)], "x decimal(12,2)")
    assert df.agg(N.avg_exact("x", 2).alias("v")).collect()[0].v == 16.76      # 16.755
    df = spark.createDataFrame([(Decimal("0.01"),), (Decimal("0.00"),)], "x decimal(12,2)")
    assert df.agg(N.avg_exact("x", 2).alias("v")).collect()[0].v == 0.01       # 0.005


def test_avg_exact_skips_nulls_and_empty_is_null(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    assert df.agg(N.avg_exact("x", 1, integral=True).alias("v")).collect()[0].v == 1.5
    empty = spark.createDataFrame([(None,)], "x int")
    assert empty.agg(N.avg_exact("x", 1, integral=True).alias("v")).collect()[0].v is None


def test_pct(spark):
    assert one(spark, N.pct(F.lit(1), F.lit(3))) == 33.33
    assert one(spark, N.pct(F.lit(2), F.lit(3))) == 66.67
    assert one(spark, N.pct(F.lit(1), F.lit(8))) == 12.5


def test_days_between_fractional_and_negative(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2, 12))],
                               "a timestamp_ntz, b timestamp_ntz")
    r = df.select(N.days_between("a", "b").alias("f"), N.days_between("b", "a").alias("g")).collect()[0]
    assert (r.f, r.g) == (1.5, -1.5)


def test_title_case_matches_python(spark):
    words = ["health_beauty", "UNITED STATES", "cat_3", "Brand#15", "they're 3rd", "são paulo",
             "x-ray o'neil", "", "a1b2"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.t for r in df.select("w", title_case("w").alias("t")).collect()}
    assert got == {w: w.title() for w in words}


def test_display_strings(spark):
    df = spark.createDataFrame([(Decimal("12349999.99"), 99441, 10.45), (Decimal("12350000.00"), 7, 0.0)],
                               "m decimal(22,2), n bigint, p double")
    rows = df.select(display_millions("m").alias("a"), display_int("n").alias("b"),
                     display_pct("p").alias("c")).collect()
    assert [tuple(r) for r in rows] == [("R$ 12.3M", "99,441", "10.5%"), ("R$ 12.4M", "7", "0.0%")]


def test_segments(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 5, 6, None)], "n bigint")
    got = [r.s for r in df.select(segment_expr("n").alias("s")).collect()]
    assert got == ["One-time buyer", "Repeat (2 orders)", "Loyal (3-5 orders)", "Loyal (3-5 orders)",
                   "Champion (6+ orders)", "Champion (6+ orders)"]


def test_money_of_any_scale_is_not_cut(spark):
    df = spark.createDataFrame([("a", Decimal("0.0099")), ("a", Decimal("0.0099")), ("b", None)], "k string, x decimal(18,4)")
    got = {r.k: (r.s, r.m) for r in df.groupBy("k").agg(N.sum_money("x").alias("s"), N.avg_exact("x", 4).alias("m")).collect()}
    assert got == {"a": (0.02, 0.0099), "b": (None, None)}


def test_to_ts_and_cluster_conf(spark):
    from marketlens.functions.exprs import to_ts
    from marketlens.session import cluster_conf
    r = spark.range(1).select(to_ts(F.lit("2017-01-31 23:59:59")).alias("t")).collect()[0]
    assert r.t == dt.datetime(2017, 1, 31, 23, 59, 59)
    c = cluster_conf(30 * 2**40)                      # a 30 TiB shuffle
    assert c["spark.sql.shuffle.partitions"] == str(30 * 2**40 // (256 << 20))
    assert c["spark.sql.adaptive.enabled"] == "true" and c["spark.sql.session.timeZone"] == "UTC"
    assert cluster_conf(1)["spark.sql.shuffle.partitions"] == "200"
