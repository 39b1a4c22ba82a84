"""The load command: one pass, quarantine, versions, repeated and killed loads."""

from __future__ import annotations

import pytest
from conftest import rows

from marketlens.operators import audit as A
from marketlens.plans import reports as R
from marketlens.schema import DEFAULT_MANIFEST, string_bounds
from marketlens.sources import files as IO
from marketlens.sources import load as L
from marketlens.sources import versions as V


@pytest.fixture(scope="module")
def source(spark, fixture_tables, tmp_path_factory):
    folder = tmp_path_factory.mktemp("source")
    for filename, name in DEFAULT_MANIFEST:
        IO.write_csv(fixture_tables.as_dict()[name], str(folder / filename))
    return str(folder)


def test_files_to_audited_tables_to_report(spark, source, tmp_path, fixture_tables):
    target = str(tmp_path / "target")
    metrics = L.load(spark, source, target)
    t = L.loaded_tables(spark, target)
    assert rows(R.monthly_revenue(t)) == rows(R.monthly_revenue(fixture_tables))
    # the audits gathered while writing are those of a scan
    assert dict(rows(L.counts(spark, metrics).select("table_name", "row_count"))) == dict(rows(A.load_counts(t.as_dict())))
    assert sorted(rows(L.lengths(spark, metrics)), key=str) == sorted(rows(A.check_lengths(t.as_dict())), key=str)
    assert all(r.null_keys in (0, None) and r.uncast_values in (0, None) for r in L.failures(spark, metrics).collect())


def test_audits_take_no_scan_beside_the_load(spark, source, tmp_path, monkeypatch):
    jobs = []
    kind = type(spark.range(1))
    write = kind.write.fget
    monkeypatch.setattr(kind, "write", property(lambda df: jobs.append(df) or write(df)))
    metrics = L.load(spark, source, str(tmp_path / "t"))
    loads = [df for df in jobs if "quarantine" in df.columns]
    assert len(loads) == len(DEFAULT_MANIFEST)          # one write per table
    for df in loads:
        assert df._jdf.queryExecution().optimizedPlan().toString().count("CollectMetrics") == 1
    for made in (L.counts(spark, metrics), L.lengths(spark, metrics), L.failures(spark, metrics)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "FileScan" not in plan and "BatchScan" not in plan


def test_bad_rows_are_kept_back_with_column_and_value(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.csv").write_text("order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
                                           "o1,1,boleto,1,10.50\no2,x,boleto,two,3.00\no3,1,a very long kind of payment,1,abc\no4,,,,\n")
    target = str(tmp_path / "t")
    metrics = L.load(spark, str(tmp_path / "in"), target, [("p.csv", "order_payments")])["order_payments"]
    assert metrics["rows"] == 2 and metrics["quarantined"] == 2
    assert (metrics["uncast:payment_sequential"], metrics["uncast:payment_installments"], metrics["uncast:payment_value"]) == (1, 1, 1)
    assert metrics["longest:payment_type"] == 6 and metrics["over:payment_type"] == 0    # of the rows that were loaded
    assert sorted(r.order_id for r in L.loaded(spark, target, "order_payments").collect()) == ["o1", "o4"]
    bad = {(r.order_id, r.column, r.value) for r in L.quarantined(spark, target, "order_payments").collect()}
    assert bad == {("o2", "payment_sequential", "x"), ("o2", "payment_installments", "two"), ("o3", "payment_value", "abc")}


def test_bounds_and_null_keys_are_counted(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.csv").write_text("seller_id,seller_state\ns1,SPX\n,RJ\ns3,SP\n")
    m = L.load(spark, str(tmp_path / "in"), str(tmp_path / "t"), [("s.csv", "sellers")])["sellers"]
    assert (m["rows"], m["null:seller_id"], m["longest:seller_state"], m["over:seller_state"]) == (3, 1, 3, 1)
    assert {c for c, _ in string_bounds("sellers")} == {n.split(":")[1] for n in m if n.startswith("over:")}


def test_a_repeated_load_changes_nothing_and_another_appends(spark, source, tmp_path):
    target = str(tmp_path / "t")
    first = L.load(spark, source, target)
    before = V.current(spark, target)
    assert L.load(spark, source, target) == first and V.current(spark, target) == before
    n = L.loaded(spark, target, "order_items").count()
    L.load(spark, source, target, load_id="again")
    assert V.current(spark, target)["version"] == before["version"] + 1
    assert L.loaded(spark, target, "order_items").count() == 2 * n


def test_a_killed_load_leaves_readers_on_the_old_version(spark, source, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    L.load(spark, source, target, load_id="one")
    old = L.loaded(spark, target, "orders").count()
    tables = iter(range(100))
    checked = L.checked

    def dies(*args):
        if next(tables) == 4:
            raise KeyboardInterrupt
        return checked(*args)

    monkeypatch.setattr(L, "checked", dies)
    with pytest.raises(KeyboardInterrupt):
        L.load(spark, source, target, load_id="two")
    assert V.current(spark, target)["version"] == 1 and L.loaded(spark, target, "orders").count() == old
    monkeypatch.setattr(L, "checked", checked)
    L.load(spark, source, target, load_id="two")         # the same load again completes it, once
    assert L.loaded(spark, target, "orders").count() == 2 * old
    assert V.drop_unnamed(spark, target) == []


def test_a_killed_publish_leaves_the_old_report_and_races_lose_nothing(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "r")
    V.publish(spark.range(3), base, "report", "a")
    commit = V.commit
    monkeypatch.setattr(V, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        V.publish(spark.range(9), base, "report", "b")
    monkeypatch.setattr(V, "commit", commit)
    assert spark.read.parquet(*V.folders(spark, base, "report")).count() == 3
    assert V.drop_unnamed(spark, base) == ["report-b"]
    # another writer takes the next number between reading and committing
    current, raced = V.current, []

    def slow(spark_, base_):
        now = current(spark_, base_)
        if not raced:
            raced.append(True)
            commit(spark_, base_, "other", {"other": "data/other"}, append=False)
        return now

    monkeypatch.setattr(V, "current", slow)
    V.publish(spark.range(5), base, "report", "c")
    monkeypatch.setattr(V, "current", current)
    now = V.current(spark, base)
    assert set(now["ids"]) == {"a", "other", "c"} and set(now["tables"]) == {"report", "other"}
    assert spark.read.parquet(*V.folders(spark, base, "report")).count() == 5


def test_load_and_audit_from_the_command_line(spark, source, tmp_path, capsys):
    from marketlens.__main__ import main
    target = str(tmp_path / "t")
    assert main(["load", "--source", source, "--target", target, "--file", "orders=orders.csv"]) == 0
    out = capsys.readouterr().out
    assert "orders\t6\t0" in out and "customers\tcustomer_state\t2\t2\t0" in out
    assert main(["audit", "--target", target]) == 0
    out = capsys.readouterr().out
    assert "orders\t6\t0\t0\t0" in out and "order_items\torder_id\torders\t0" in out
    assert main(["--target", target, "--reports", "q05_payment_methods", "--show", "--out", str(tmp_path / "o")]) == 0
    assert "credit_card" in capsys.readouterr().out
