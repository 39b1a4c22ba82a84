"""K1 and chart data on the hand-made fixture."""

from __future__ import annotations

from conftest import rows

from marketlens.plans import charts as C
from marketlens.plans.catalog import CATALOG, build_reports, count_rows, digest, run_reports, write_reports
from marketlens.plans.kpi import kpi_summary


def test_kpi_summary(fixture_tables):
    r = kpi_summary(fixture_tables).collect()[0].asDict()
    assert r == {
        "total_revenue": 304.56, "total_orders": 4,
        "avg_late_pct": 16.7,                       # plain mean of 50.00, 0.00, 0.00
        "top_category": "health_beauty",
        "total_revenue_label": "R$ 0.0M", "total_orders_label": "4",
        "avg_late_label": "16.7%", "top_category_label": "Health_Beauty",
    }


def test_category_bars_reverse_order(fixture_tables):
    assert rows(C.chart_category_bars(fixture_tables)) == [
        ("Unknown", 65.0, 2, 1), ("esporte", 100.01, 2, 2), ("health_beauty", 110.0, 3, 3)]


def test_review_bars(fixture_tables):
    assert rows(C.chart_review_bars(fixture_tables, min_reviews=1)) == [
        ("health_beauty", 3.2, 5, 1), ("Unknown", 3.5, 2, 2)]


def test_score_distribution_pivot(fixture_tables):
    assert rows(C.chart_score_distribution(fixture_tables)) == [
        (1, None, 1), (2, None, 1), (3, None, 1), (4, 1, None), (5, 1, None)]


def test_payment_share(fixture_tables):
    assert rows(C.chart_payment_share(fixture_tables)) == [
        ("credit_card", 3, 37.5, 50.0), ("boleto", 2, 94.03, 33.33), ("voucher", 1, 10.0, 16.67)]


def test_segment_share(fixture_tables):
    assert rows(C.chart_segment_share(fixture_tables)) == [("One-time", 3, 75.0), ("Repeat (2x)", 1, 25.0)]


def test_monthly_trend_and_scatters(fixture_tables):
    assert [r[0].month for r in rows(C.chart_monthly_trend(fixture_tables))] == [1, 2, 3]
    assert rows(C.chart_delivery_scatter(fixture_tables))[0] == ("SP", 2, 50.0, 7.4)
    assert rows(C.chart_state_bars(fixture_tables))[0] == ("RJ", 2, 85.0)
    assert rows(C.chart_freight_scatter(fixture_tables, min_avg_price=30))[0] == ("Unknown", 32.5, 3.5, 15.0)


def test_run_reports_counts_every_catalog_entry(fixture_tables):
    reports = run_reports(fixture_tables)
    got = dict(rows(count_rows(reports)))
    assert list(got) == list(CATALOG)
    assert got["q05_payment_methods"] == 3 and got["kpi_summary"] == 1
    # what is derived from written reports is what the tables give
    assert sorted(rows(digest(reports))) == sorted(rows(digest(build_reports(fixture_tables))))


def test_write_reports_one_output_per_report(spark, fixture_tables):
    from marketlens.session import scratch_path
    names = ["q05_payment_methods", "q09_repeat_customers", "kpi_summary", "chart_category_bars"]
    paths = write_reports(fixture_tables, scratch_path(spark, "test-write-reports"), names)
    assert list(paths) == names
    counts = dict(rows(count_rows(run_reports(fixture_tables, names))))
    assert {n: spark.read.parquet(p).count() for n, p in paths.items()} == counts


def test_command_line_writes_reports(spark, capsys):
    import os

    from marketlens.__main__ import main
    from marketlens.session import scratch_path
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    out = scratch_path(spark, "test-cli")
    assert main(["--generated", sf, "--reports", "q05_payment_methods", "kpi_summary",
                 "--param", "q07_reviews_by_category.min_reviews=1500", "--out", out]) == 0
    assert spark.read.parquet(f"{out}/kpi_summary").count() == 1
    assert spark.read.parquet(f"{out}/q05_payment_methods").count() == 5
    assert "q05_payment_methods" in capsys.readouterr().out
