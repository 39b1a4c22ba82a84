"""Split reading of CSV files whose quoted fields may hold line breaks.

A quote either opens a field, closes it or is doubled, so a line feed ends a record
exactly where the number of quotes before it in the file is even. A split cannot know
that number for its own start, but its parity follows from the splits before it:

1. One pass notes of every split its parity of quotes and, for either possible start,
   what would belong to a record of its neighbours: the lines up to its first odd one,
   and those from its last odd one on.
2. A running sum of the parities over a file's splits gives the true state at each start.
3. The second pass cuts each split at its true line ends and keeps the records that start
   and end in it; records across splits are put together from the pieces of step 1.

So a file is read by as many tasks as it has splits, and only pieces of records at split
borders are shuffled. The driver sees one small row per split of a file with several.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.session import scratch_path

_LINES = ["file", "block", "value"]
_SPLIT_DDL = "file string, block long, parity int, lines long, odd boolean, head binary, tail binary"


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines (cut at line feeds alone) in file order within a split, with their file and split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array, bool]]:
    """(file, block, some of its lines, whether it goes on from what came before)."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block, value = batch.columns
        change = np.ones(batch.num_rows, bool)
        change[1:] = np.diff(block.to_numpy()) != 0
        change[1:] |= pc.not_equal(file.slice(1), file.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        at = [*np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(at, at[1:]):
            here = (file[a].as_py(), block[a].as_py())
            yield *here, value.slice(a, b - a), here == before
            before = here


def _odd(lines: pa.Array) -> np.ndarray:
    return pc.count_substring(lines, pattern=b'"').to_numpy(zero_copy_only=False) % 2 == 1


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: its parity, and its lines up to the first and from the last odd one."""
    names = ["file", "block", "parity", "lines", "odd", "head", "tail"]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
    state: dict | None = None

    def row(s: dict) -> pa.RecordBatch:
        head, tail = (b"\n".join(s[k]) if s["odd"] else None for k in ("head", "tail"))
        values = [s["file"], s["block"], s["parity"], s["lines"], s["odd"], head, tail]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

    for file, block, lines, goes_on in _by_split(batches):
        if not goes_on:
            if state:
                yield row(state)
            state = {"file": file, "block": block, "parity": 0, "lines": 0, "odd": False, "head": [], "tail": []}
        at = np.flatnonzero(_odd(lines))
        state["lines"] += len(lines)
        state["parity"] = (state["parity"] + len(at)) % 2
        if not state["odd"]:
            state["head"] += lines.slice(0, int(at[0]) + 1 if len(at) else None).to_pylist() if len(at) else lines.to_pylist()
        if len(at):
            state["odd"], state["tail"] = True, []
        if state["odd"]:
            state["tail"] += lines.slice(int(at[-1]) if len(at) else 0).to_pylist()
    if state:
        yield row(state)


def _records(starts: dict, columns: list[str], sep: str):
    """Lines -> the records that start and end in their split, headers checked and dropped."""

    def begins_inside(file: str, block: int) -> bool:
        if block == 0:
            return False
        known = starts.get(file)
        at = -1 if known is None else int(np.searchsorted(known[0], block))
        if at < 0 or at == len(known[0]) or known[0][at] != block:
            raise ValueError(f"{file}: the split at {block} is not one the file was measured with; "
                             "read the file again after changing split settings or files")
        return bool(known[1][at])

    def header(file: str, record: bytes) -> None:
        found = next(csv.reader([record.decode().removeprefix("﻿")], delimiter=sep), [])
        if found != columns:
            raise ValueError(f"{file}: header {found} differs from {columns}")

    def out(records: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([records], names=["record"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, held, top, skip = 0, [], False, False
        for file, block, lines, goes_on in _by_split(batches):
            if not goes_on:
                inside, held, top = int(begins_inside(file, block)), [], block == 0
                skip = bool(inside)          # lines of a record that started in an earlier split
            odd = _odd(lines)
            before = (inside + np.cumsum(odd) - odd) % 2
            first = np.flatnonzero(before == 0)      # lines that start a record
            inside = int((before[-1] + odd[-1]) % 2)
            if len(first) and first[0] == 0 and held:    # what was held ended with the last batch's last line
                yield out(pa.array([b"\n".join(held)], pa.binary()))
                held = []
            lead = int(first[0]) if len(first) else len(lines)
            if lead and not skip:
                held += lines.slice(0, lead).to_pylist()
                if len(first):
                    yield out(pa.array([b"\n".join(held)], pa.binary()))
                    held = []
            if not len(first):
                continue
            skip = False
            if top:      # the first record of the file
                end = int(first[1]) if len(first) > 1 else len(lines)
                header(file, b"\n".join(lines.slice(0, end).to_pylist()).rstrip(b"\r"))
                first, top = first[1:], False
                if not len(first):
                    continue
            ends = np.append(first[1:], len(lines))
            last = ends[-1] - first[-1]
            if inside:       # the last record goes on
                held = lines.slice(int(first[-1]), int(last)).to_pylist()
                first, ends = first[:-1], ends[:-1]
            one = ends - first == 1
            if one.any():
                yield out(lines.take(pa.array(first[one])))
            if not one.all():
                yield out(pa.array([b"\n".join(lines.slice(a, b - a).to_pylist()) for a, b in
                                    zip(first[~one].tolist(), ends[~one].tolist())], pa.binary()))
        # what is held at the end of a split goes on in the next one, and comes from its pieces
    return run


def _inner(starts: dict):
    """Lines of the splits that lie wholly inside one field -> ``file, block, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, where = [], None
        for file, block, lines, goes_on in _by_split(batches):
            if not goes_on and held:
                yield pa.RecordBatch.from_pydict({"file": [where[0]], "block": [where[1]], "text": [b"\n".join(held)]})
                held = []
            where = (file, block)
            if block in starts.get(file, ()):
                held += lines.to_pylist()
        if held:
            yield pa.RecordBatch.from_pydict({"file": [where[0]], "block": [where[1]], "text": [b"\n".join(held)]})
    return run


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def read_quoted(spark: SparkSession, path: str | list[str], columns: list[str], sep: str = ",", **options: str) -> DataFrame:
    """Header CSV (UTF-8, quote and escape ``"``) in splits -> text columns, every file's header checked.

    ``columns`` is the header. Files must be well formed: a quote inside an unquoted field
    makes a record of the wrong length, which raises. The first pass runs at once and leaves
    its table in the session's shared work folder; the frame itself is lazy.
    """
    at = scratch_path(spark, "csv-splits")
    _lines(spark, path).mapInArrow(_measure, _SPLIT_DDL).write.parquet(at)
    order = Window.partitionBy("file").orderBy("block")
    splits = (spark.read.parquet(at)
              .withColumn("inside", F.coalesce(F.sum("parity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2)
              .withColumn("leaves", (F.col("inside") + F.col("parity")) % 2)
              .withColumn("last", F.lead("block").over(order).isNull()))
    starts: dict[str, tuple] = {}
    several = splits.where("block > 0").select("file", "block", "inside").orderBy("file", "block").toArrow()
    files = several.column("file").combine_chunks().dictionary_encode()
    for i, file in enumerate(files.dictionary.to_pylist()):
        mine = files.indices.to_numpy() == i
        starts[file] = (several.column("block").to_numpy()[mine], several.column("inside").to_numpy()[mine].astype(bool))
    open_end = splits.where("last and leaves = 1").select("file").limit(1).collect()
    if open_end:
        raise ValueError(f"{open_end[0].file}: a quoted field is not closed")

    records = (_lines(spark, path).mapInArrow(_records(starts, columns, sep), "record binary")
               .select(F.col("record").cast("string").alias("record")))
    if any(inside.any() for _, inside in starts.values()):
        pieces = (splits.where("inside = 1 and odd").select("file", "block", F.lit(False).alias("opens"), F.col("head").alias("text"))
                  .unionByName(splits.where("leaves = 1 and odd").select("file", "block", F.lit(True).alias("opens"), F.col("tail").alias("text"))))
        whole = splits.where("inside = 1 and not odd").select("file", "block").collect()
        if whole:      # a field longer than a split
            inner: dict[str, set] = {}
            for r in whole:
                inner.setdefault(r.file, set()).add(r.block)
            text = _lines(spark, path).mapInArrow(_inner(inner), "file string, block long, text binary")
            pieces = pieces.unionByName(text.select("file", "block", F.lit(False).alias("opens"), "text"))
        # a record opens in one split and goes on in the next ones up to the split that closes it
        run = Window.partitionBy("file").orderBy("block", "opens").rowsBetween(Window.unboundedPreceding, 0)
        joined = (pieces.withColumn("n", F.sum(F.col("opens").cast("int")).over(run)).groupBy("file", "n")
                  .agg(F.sort_array(F.collect_list(F.struct("block", "opens", F.col("text").cast("string").alias("text")))).alias("p"))
                  .select(F.array_join("p.text", "\n").alias("record")))
        records = records.unionByName(joined)
    records = records.select(F.regexp_replace("record", "\r$", "").alias("record")).where("record <> ''")
    schema = ", ".join(f"{_quote(c)} STRING" for c in columns)
    parsed = F.from_csv("record", schema, {"escape": '"', "mode": "FAILFAST", "multiLine": "true", "sep": sep, **options})
    return records.select(parsed.alias("r")).select(*[F.col(f"r.{_quote(c)}").alias(c) for c in columns])
