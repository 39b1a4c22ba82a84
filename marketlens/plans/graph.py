"""The report graph: what each catalog entry is made from, so that nothing is computed twice.

Base reports come from the tables; the KPI row, the charts and the short loyalty labels
come from base reports. Two aggregates of the fact tables serve several base reports:
item totals per order (Q1, Q3, hot orders of Q6) and review totals per order (Q6, Q7, Q8). A run writes the
shared aggregates (and the orders, if they are derived by a join that several reports would repeat), then every base report it needs once (per distinct set of parameters),
then what is derived from the written ones.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable, Mapping
from dataclasses import replace
from typing import NamedTuple

from pyspark.sql import DataFrame

from marketlens.plans import charts as C
from marketlens.plans import reports as R
from marketlens.plans.kpi import kpi_from, kpi_summary
from marketlens.sources.files import write_report
from marketlens.tables import Tables

CATALOG = {**R.REPORTS, "kpi_summary": kpi_summary, **C.CHARTS}

#: Aggregates that several base reports take: argument -> function of the tables.
SHARED = {"per_order": R.item_totals, "reviews": R.review_totals}


#: Base reports that read every column of the orders, so that no join behind these can be pruned.
WHOLE_ORDERS = {"q04_delivery_delay", "q08_delay_vs_reviews", "q08b_review_distribution"}


class Derived(NamedTuple):
    """Base reports with the parameters they get from the entry's own, and the function of their frames."""

    bases: Mapping[str, tuple[str, ...]]
    build: Callable[..., DataFrame]
    own: tuple[str, ...] = ()       # parameters of the entry that the function takes


DERIVED = {
    "q09b_loyalty_short_labels": Derived({"q09_repeat_customers": ("status",)}, R.short_labels),
    "kpi_summary": Derived({"q01_monthly_revenue": ("status", "since"), "q04_delivery_delay": ("status",),
                            "q02_revenue_by_category": ("status", "k")}, kpi_from),
    "chart_monthly_trend": Derived({"q01_monthly_revenue": ("since",)}, C.monthly_trend),
    "chart_category_bars": Derived({"q02_revenue_by_category": ("k",)}, C.category_bars, ("k",)),
    "chart_state_bars": Derived({"q03_orders_by_state": ("k",)}, C.state_bars),
    "chart_delivery_scatter": Derived({"q04_delivery_delay": ()}, C.delivery_scatter),
    "chart_payment_share": Derived({"q05_payment_methods": ()}, C.payment_share),
    "chart_review_bars": Derived({"q07_reviews_by_category": ("min_reviews", "k")}, C.review_bars, ("k",)),
    "chart_score_distribution": Derived({"q08b_review_distribution": ()}, C.score_distribution),
    "chart_segment_share": Derived({"q09_repeat_customers": ()}, lambda report: C.segment_share(R.short_labels(report))),
    "chart_freight_scatter": Derived({"q10_freight_by_category": ("min_avg_price", "k")}, C.freight_scatter),
}


def _key(name: str, params: Mapping) -> tuple:
    """A base report with all its parameters, defaults filled in."""
    defaults = {n: p.default for n, p in inspect.signature(R.REPORTS[name]).parameters.items()
                if p.default is not inspect.Parameter.empty and n not in SHARED}
    return name, tuple(sorted({**defaults, **params}.items(), key=lambda x: x[0]))


def plan(names: Iterable[str], params: Mapping[str, Mapping] | None = None) -> tuple[dict, dict]:
    """Entries -> the base reports to compute (key -> whether an entry asks for it by name) and,
    per derived entry, the keys of its bases in order."""
    params, bases, links = params or {}, {}, {}
    for name in names:
        own = dict(params.get(name, {}))
        if name in DERIVED:
            links[name] = [_key(base, {n: own[n] for n in taken if n in own}) for base, taken in DERIVED[name].bases.items()]
            for key in links[name]:
                bases.setdefault(key, None)
        else:
            bases[_key(name, own)] = name
    return bases, links


def write_graph(t: Tables, directory: str, names: Iterable[str] | None = None,
                params: Mapping[str, Mapping] | None = None, fmt: str = "parquet") -> dict[str, str]:
    """Writes the named entries (all by default) to ``{directory}/{name}``, each part computed once; what
    only others need goes to ``{directory}/_shared``. Returns entry -> path."""
    names, params, spark = list(names or CATALOG), params or {}, t.orders.sparkSession
    bases, links = plan(names, params)
    derived = t.orders._jdf.queryExecution().optimizedPlan().collectLeaves().size() > 1
    if derived and sum(name in WHOLE_ORDERS for name, _ in bases) > 1:
        t = replace(t, orders=spark.read.parquet(write_report(t.orders, f"{directory}/_shared", "orders")))
    takes = {a for name, _ in bases for a in inspect.signature(R.REPORTS[name]).parameters if a in SHARED}
    shared = {a: spark.read.parquet(write_report(SHARED[a](t), f"{directory}/_shared", a)) for a in sorted(takes)}
    paths, frames = {}, {}
    for n, ((name, key), asked) in enumerate(bases.items()):
        report = R.REPORTS[name]
        given = {a: shared[a] for a in inspect.signature(report).parameters if a in shared}
        df = report(t, **dict(key), **given)
        # a written report keeps its types for what is derived from it, whatever the format asked for
        if asked and fmt == "parquet":
            paths[asked] = write_report(df, directory, asked)
            frames[name, key] = spark.read.parquet(paths[asked])
        else:
            frames[name, key] = spark.read.parquet(write_report(df, f"{directory}/_shared", f"{name}-{n}"))
            if asked:
                paths[asked] = write_report(_in_order(frames[name, key], name), directory, asked, fmt)
    for name, keys in links.items():
        own = params.get(name, {})
        df = DERIVED[name].build(*[frames[k] for k in keys], **{a: own[a] for a in DERIVED[name].own if a in own})
        paths[name] = write_report(df, directory, name, fmt)
    return {n: paths[n] for n in names}


def _in_order(df: DataFrame, name: str) -> DataFrame:
    return df.orderBy(*R.sort_cols(R.ORDER[name.split("_")[0]]))
