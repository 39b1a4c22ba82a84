"""The report graph: each part computed once, parameters kept apart, results as from the tables."""

from __future__ import annotations

import os

import pytest
from conftest import rows

from marketlens.plans import graph as G
from marketlens.plans.catalog import build_reports, digest, run_reports
from marketlens.session import scratch_path
from marketlens.sources.driver import driver_tables
from marketlens.sources.staging import stage_tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="generated data not present")


@pytest.fixture(scope="module")
def staged(spark):
    return stage_tables(spark, driver_tables(spark, SF), scratch_path(spark, "test-graph"))


def scans(df) -> list[str]:
    """Names of the tables scanned by a plan, one per scan."""
    leaves, out = df._jdf.queryExecution().optimizedPlan().collectLeaves(), []
    for i in range(leaves.size()):
        relation = leaves.apply(i).relation() if hasattr(leaves.apply(i), "relation") else None
        if relation is not None:
            out.append(relation.location().rootPaths().head().getName())
    return out


def test_the_catalog_scans_each_fact_table_as_often_as_its_base_reports_need(spark, staged, monkeypatch):
    seen = []
    write = G.write_report

    def noted(df, directory, name, *rest):
        seen.extend(scans(df))
        return write(df, directory, name, *rest)

    monkeypatch.setattr(G, "write_report", noted)
    run_reports(staged)
    facts = {t: seen.count(t) for t in ("order_items", "order_reviews", "order_payments", "orders")}
    # items: totals per order, Q2, Q6 (and its sketch, for both sides of the join), Q7, Q10; reviews: totals per order, Q8b
    assert facts["order_items"] <= 7 and facts["order_reviews"] == 2 and facts["order_payments"] == 1
    assert facts["orders"] == 9
    lazy = [t for df in build_reports(staged).values() for t in scans(df)]
    assert all(facts[t] < lazy.count(t) for t in facts)


def test_orders_derived_by_a_join_are_made_once(spark, monkeypatch):
    seen = []
    write = G.write_report

    def noted(df, directory, name, *rest):
        seen.extend(scans(df))
        return write(df, directory, name, *rest)

    monkeypatch.setattr(G, "write_report", noted)
    t = driver_tables(spark, SF)
    names = ["q04_delivery_delay", "q06_top_sellers", "q08_delay_vs_reviews", "q08b_review_distribution"]
    made = run_reports(t, names)
    # delivery dates, and the items of Q6 with their sketch for both sides of its join
    assert seen.count("lineitem.parquet") <= 4 and seen.count("orders.parquet") == 1
    assert sorted(rows(digest(made))) == sorted(rows(digest(build_reports(t, names))))


def test_parameters_of_derived_entries_get_their_own_base(spark, staged):
    names = ["q02_revenue_by_category", "chart_category_bars", "kpi_summary", "chart_monthly_trend"]
    params = {"chart_category_bars": {"k": 3}, "chart_monthly_trend": {"since": "1998-01-01"}, "kpi_summary": {"since": "1997-01-01"}}
    bases, links = G.plan(names, params)
    assert sorted(n for n, _ in bases) == ["q01_monthly_revenue"] * 2 + ["q02_revenue_by_category"] * 2 + ["q04_delivery_delay"]
    assert len(links["kpi_summary"]) == 3
    made = run_reports(staged, names, params)
    assert list(made) == names
    assert sorted(rows(digest(made))) == sorted(rows(digest(build_reports(staged, names, params))))


def test_other_formats_keep_values(spark, staged):
    base = scratch_path(spark, "test-graph-csv")
    paths = G.write_graph(staged, base, ["q05_payment_methods", "chart_payment_share"], fmt="csv")
    back = spark.read.options(header="true", inferSchema="true").csv(paths["chart_payment_share"])
    want = build_reports(staged, ["chart_payment_share"])["chart_payment_share"]
    assert [(r.payment_type, r.share) for r in back.collect()] == [(r.payment_type, r.share) for r in want.collect()]
    assert spark.read.options(header="true").csv(paths["q05_payment_methods"]).count() == 5


def test_digest_shows_swapped_columns_and_wrong_values(spark):
    a = spark.createDataFrame([(1, 2, 0.5), (3, 4, None)], "x long, y long, z double")
    same = spark.createDataFrame([(3, 4, None), (1, 2, 0.5)], "x long, y long, z double")
    swapped = spark.createDataFrame([(2, 1, 0.5), (4, 3, None)], "x long, y long, z double")
    wrong = spark.createDataFrame([(1, 2, 0.51), (3, 4, None)], "x long, y long, z double")
    of = lambda df: rows(digest({"t": df}))
    assert of(a) == of(same) and of(a) != of(swapped) and of(a) != of(wrong)
