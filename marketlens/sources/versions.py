"""Versioned folders: readers see a version whole, or the one before it.

Writers put their files under ``data/`` in a folder of their own and then commit: a
small JSON file ``versions/<number>.json`` that names the folders of every table. It is
written beside and renamed into place, so a version exists whole or not at all; a writer
that dies leaves only folders no version names. Every commit carries an id; committing the
same id again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

_EMPTY = {"version": 0, "tables": {}, "ids": {}}


def _fs(spark: SparkSession, base: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))


def current(spark: SparkSession, base: str) -> dict:
    """The newest version: ``version, tables`` (name -> folders) and ``ids`` (id -> what its commit noted)."""
    fs, folder = _fs(spark, base), _path(spark, base, "versions")
    if not fs.exists(folder):
        return _EMPTY
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
    if not numbers:
        return _EMPTY
    lines = spark.read.option("wholetext", "true").text(f"{base.rstrip('/')}/versions/{max(numbers):08d}.json").collect()
    return json.loads(lines[0].value)


def commit(spark: SparkSession, base: str, commit_id: str, tables: Mapping[str, str], append: bool, note: dict | None = None,
           attempts: int = 20) -> dict:
    """Adds ``tables`` (name -> folder, relative to ``base``) to the newest version's folders, or puts
    them in their place. A commit id already there, or a lost race against another commit, is seen."""
    fs = _fs(spark, base)
    fs.mkdirs(_path(spark, base, "versions"))
    for _ in range(attempts):
        now = current(spark, base)
        if commit_id in now["ids"]:
            return now
        merged = {n: list(f) for n, f in now["tables"].items()}
        for name, folder in tables.items():
            merged[name] = [*merged.get(name, []), folder] if append else [folder]
        new = {"version": now["version"] + 1, "tables": merged, "ids": {**now["ids"], commit_id: note or {}}}
        beside = _path(spark, base, "versions", f".{uuid.uuid4().hex}")
        final = _path(spark, base, "versions", f"{new['version']:08d}.json")
        out = fs.create(beside, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if not fs.exists(final) and fs.rename(beside, final):
            return new
        fs.delete(beside, False)
    raise RuntimeError(f"{base}: {attempts} commits in a row were overtaken by others")


def folders(spark: SparkSession, base: str, table: str) -> list[str]:
    """Absolute folders of a table in the newest version."""
    return [f"{base.rstrip('/')}/{f}" for f in current(spark, base)["tables"].get(table, [])]


def drop_unnamed(spark: SparkSession, base: str) -> list[str]:
    """Deletes folders under ``data/`` that no table of the newest version names (of killed or replaced
    writes), and returns them. Run it when nobody writes or reads an older version."""
    fs, data = _fs(spark, base), _path(spark, base, "data")
    if not fs.exists(data):
        return []
    named = {f.split("/")[1] for fs_ in current(spark, base)["tables"].values() for f in fs_}
    gone = [s.getPath().getName() for s in fs.listStatus(data) if s.getPath().getName() not in named]
    for name in gone:
        fs.delete(_path(spark, base, "data", name), True)
    return gone


def publish(df: DataFrame, base: str, name: str, commit_id: str | None = None, append: bool = False, fmt: str = "parquet") -> str:
    """Writes ``df`` as (a part of) table ``name`` and commits it; returns the folder written. A repeated
    ``commit_id`` writes nothing."""
    spark, commit_id = df.sparkSession, commit_id or uuid.uuid4().hex
    if commit_id not in current(spark, base)["ids"]:
        folder = f"data/{name}-{commit_id}"
        writer = df.write.mode("overwrite").format(fmt)      # what a killed write of the same id left
        if fmt == "csv":
            writer = writer.options(header="true", escape='"')
        writer.save(f"{base.rstrip('/')}/{folder}")
        commit(spark, base, commit_id, {name: folder}, append)
    return folders(spark, base, name)[-1]
