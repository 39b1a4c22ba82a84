"""Command line: load the eight tables, run reports, write and/or print them.

    python -m marketlens --tables DIR [--format csv|parquet] [--reports NAME ...]
                         [--out DIR [--out-format parquet|json|csv]] [--show]
                         [--param REPORT.NAME=VALUE ...]
    python -m marketlens --generated /root/testdata/sf0.01 --show \\
        --param q07_reviews_by_category.min_reviews=1500
    python -m marketlens load --source DIR --target DIR [--file TABLE=NAME ...] [--format csv|parquet] [--load-id ID]
    python -m marketlens audit --target DIR
    python -m marketlens --target DIR --reports q01_monthly_revenue --show

``load`` appends a folder of files to a versioned target in one pass, tells the counts,
lengths and failures gathered on the way, and keeps rows that do not cast in a quarantine;
``audit`` checks keys and references of what is loaded.

Works the same under ``spark-submit`` on a cluster (the session comes from
``getOrCreate``). Row counts of the run are printed; ``--show`` also prints
each report (they are aggregated results, bounded by their group counts).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from marketlens.operators import audit
from marketlens.plans.catalog import CATALOG, count_rows, write_reports
from marketlens.schema import TABLE_NAMES
from marketlens.session import apply_report_conf, scratch_path
from marketlens.sources import load
from marketlens.sources.driver import driver_tables
from marketlens.sources.files import load_tables, read_report
from marketlens.tables import Tables


def _value(text: str):
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for cast in (int, float):
        try:
            return cast(text)
        except ValueError:
            pass
    return text


def parse_params(items: list[str]) -> dict[str, dict]:
    params: dict[str, dict] = {}
    for item in items:
        key, _, value = item.partition("=")
        report, _, name = key.partition(".")
        if report not in CATALOG or not name or not value:
            raise SystemExit(f"bad --param {item!r}: expected REPORT.NAME=VALUE")
        params.setdefault(report, {})[name] = _value(value)
    return params


def _session(ui: bool = False) -> SparkSession:
    builder = SparkSession.builder.appName("marketlens")
    if not ui:
        builder = builder.config("spark.ui.enabled", "false")
    spark = builder.getOrCreate()
    apply_report_conf(spark)
    return spark


def _print(title: str, df: DataFrame) -> None:
    rows = df.collect()      # a few rows per table and column
    print(f"== {title}")
    print("\t".join(df.columns))
    for r in rows:
        print("\t".join("" if v is None else str(v) for v in r))


def load_main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="marketlens load", description="Append files to a versioned target, audited in one pass")
    p.add_argument("--source", required=True, help="folder with one file or folder per table")
    p.add_argument("--target", required=True, help="versioned folder of the loaded tables")
    p.add_argument("--file", action="append", default=[], help="TABLE=NAME: a file name other than TABLE.FORMAT")
    p.add_argument("--format", default="csv", choices=["csv", "parquet"])
    p.add_argument("--load-id", help="id of this load (default: a fingerprint of the files)")
    args = p.parse_args(argv)
    names = {n: f"{n}.{args.format}" for n in TABLE_NAMES}
    for item in args.file:
        table, _, name = item.partition("=")
        if table not in names or not name:
            raise SystemExit(f"bad --file {item!r}: expected TABLE=NAME")
        names[table] = name
    spark = _session()
    metrics = load.load(spark, args.source, args.target, [(f, t) for t, f in names.items()], args.load_id, fmt=args.format)
    _print("rows", load.counts(spark, metrics))
    _print("lengths", load.lengths(spark, metrics))
    _print("null keys and values that do not cast", load.failures(spark, metrics))
    for table, m in metrics.items():
        if m["quarantined"]:
            print(f"== quarantine of {table}: {m['quarantined']} rows")
    return 0


def audit_main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="marketlens audit", description="Check the keys and references of a loaded target")
    p.add_argument("--target", required=True)
    args = p.parse_args(argv)
    spark = _session()
    tables = load.loaded_tables(spark, args.target).as_dict()
    _print("keys", audit.check_primary_keys(tables))
    _print("references", audit.check_foreign_keys(tables))
    _print("lengths", audit.check_lengths(tables))
    return 0


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv and argv[0] in ("load", "audit"):
        return {"load": load_main, "audit": audit_main}[argv[0]](argv[1:])
    p = argparse.ArgumentParser(prog="marketlens", description=__doc__.split("\n")[0])
    src = p.add_mutually_exclusive_group(required=True)
    src.add_argument("--tables", help="folder with one file or folder per table (manifest names)")
    src.add_argument("--target", help="versioned folder filled by load")
    src.add_argument("--generated", help="folder of the generated TPC-H-style parquet (stand-in tables)")
    p.add_argument("--format", default="csv", choices=["csv", "parquet"], help="format of --tables")
    p.add_argument("--reports", nargs="*", choices=list(CATALOG), help="catalog entries (default: all)")
    p.add_argument("--out", help="write each report to OUT/<report>")
    p.add_argument("--out-format", default="parquet", choices=["parquet", "json", "csv"])
    p.add_argument("--show", action="store_true", help="print every report")
    p.add_argument("--show-rows", type=int, help="print at most so many rows of a report (default: all)")
    p.add_argument("--param", action="append", default=[], help="REPORT.NAME=VALUE")
    p.add_argument("--ui", action="store_true", help="keep the Spark web UI on (off by default)")
    args = p.parse_args(argv)

    spark = _session(args.ui)
    if args.generated:
        tables = driver_tables(spark, args.generated)
    elif args.target:
        tables = load.loaded_tables(spark, args.target)
    else:
        manifest = [(f"{n}.{args.format}", n) for n in TABLE_NAMES]
        tables = Tables.from_dict(load_tables(spark, args.tables, manifest, fmt=args.format))
    params = parse_params(args.param)
    names = args.reports or list(CATALOG)

    # each report runs once: it is written, and counted and shown from what was written
    out = args.out or scratch_path(spark, "reports")
    paths = write_reports(tables, out, names, params, args.out_format)
    written = {n: read_report(spark, p, args.out_format) for n, p in paths.items()}
    count_rows(written).show(len(names), truncate=False)
    if args.show:
        for name, df in written.items():
            print(f"== {name}")
            df.show(args.show_rows or max(df.count(), 1), truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
