"""WARC archives: write records with Spark's text sink, read them back by boundary chains.

Writing. A record is a header block, an empty line and the payload, and every
record ends in CR LF CR LF; with that as line separator the text sink's output
is a valid uncompressed WARC file, committed by Spark's own protocol on any
file system. Payloads equal in digest (of at least ``min_revisit`` bytes) are
stored once, in the record with the smallest id; the others become ``revisit``
records without payload that refer to it.

Reading. Files are read in splits with the magic line as separator, so that
each piece starts at a *candidate* offset; magic text inside a payload yields
false candidates. Every task parses its pieces and follows the
record-to-successor offsets inside its own split; pointer jumping over the
splits' entry points, from each file's start, then keeps only the records that
the chain reaches. Payloads are hashed in the same scan; only records that
span several pieces (magic inside the payload, or a split boundary) are read a
second time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import sized_broadcast, written

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
_ID = "<urn:marketlens:page:%s>"

_PIECE = pa.schema([("file", pa.string()), ("block", pa.int64()), ("rel", pa.int64()), ("size", pa.int64()),
                    ("succ", pa.int64()), ("exit", pa.int64()), ("record_id", pa.string()),
                    ("record_type", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()),
                    ("head", pa.int64()), ("length", pa.int64()), ("payload_digest", pa.string())])
_PIECE_DDL = ("file string, block long, rel long, size long, succ long, exit long, record_id string, "
              "record_type string, refers_to string, digest string, head long, length long, payload_digest string")


# --------------------------------------------------------------------------- writing
def assign_records(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """``(id, uri, payload)`` -> the same with ``bytes, digest, first_id``: ``first_id`` is
    the smallest id of an equal payload for a revisit, null for a response.

    Only digests and ids are shuffled; payloads stay in their scan. The list of
    revisits is joined by broadcast when its counted size allows, else by shuffle.
    """
    pages = pages.select(F.col("id").cast("long").alias("id"), "uri",
                         F.coalesce("payload", F.lit("")).alias("payload"))
    pages = pages.select("*", F.octet_length("payload").cast("long").alias("bytes"),
                         F.sha2(F.col("payload").cast("binary"), 256).alias("digest"))
    small = pages.where(F.col("bytes") >= min_revisit).select("id", "digest")
    groups = (small.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
              .where("n > 1 and first_id is not null"))
    revisits = written(small.join(groups, "digest").where("not (id <=> first_id)")
                       .select("id", "digest", "first_id").distinct(), "warc-revisits")
    r = sized_broadcast(revisits.select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), "first_id"),
                        revisits.count())
    return (pages.join(r, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
            .drop("r_id", "r_digest"))


def write_archives(pages: DataFrame, path: str, min_revisit: int = 100, records_per_file: int = 200_000) -> str:
    """Write one record per row of ``(id, uri, payload)`` as WARC files under ``path``.

    Null payload: an empty one. Null uri: no target header; line breaks in a uri
    are percent-encoded. Null id: record id ``null``. Repeated rows are each
    written; rows that share the smallest id of a payload are all responses.
    """
    p = assign_records(pages, min_revisit)
    uri = F.regexp_replace(F.regexp_replace("uri", "\r", "%0D"), "\n", "%0A")
    rid = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    line = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(F.col("first_id").isNull(), "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: "), F.format_string(_ID, rid),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), uri), F.lit("")),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha256:"), "digest",
        F.when(F.col("first_id").isNull(), "").otherwise(F.concat(
            F.lit("\r\nWARC-Refers-To: "), F.format_string(_ID, F.col("first_id").cast("string")),
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.when(F.col("first_id").isNull(), F.col("bytes")).otherwise(0).cast("string"), F.lit(END),
        F.when(F.col("first_id").isNull(), F.col("payload")).otherwise(""))
    (p.select(line.alias("value")).write.option("lineSep", END)
     .option("maxRecordsPerFile", records_per_file).text(path))
    return path


# --------------------------------------------------------------------------- reading
def _parse(piece: bytes) -> tuple | None:
    """Header fields and lengths of a piece (bytes after the magic line); None if no record starts here."""
    cut = piece.find(b"\r\n\r\n")
    if cut < 0:
        return None
    fields = {}
    for line in piece[:cut].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    length = fields.get(b"content-length", "")
    if not re.fullmatch(r"\d{1,18}", length):
        return None
    return (fields.get(b"warc-record-id"), fields.get(b"warc-type"), fields.get(b"warc-refers-to"),
            fields.get(b"warc-payload-digest"), cut + 4, int(length))


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, block, offset in the block's pieces, bytes) in file order."""
    at, rel = None, 0
    for batch in batches:
        files, blocks, values = (batch.column(i) for i in range(3))
        for i in range(batch.num_rows):
            key = (files[i].as_py(), blocks[i].as_py())
            if key != at:
                at, rel = key, 0
            piece = values[i].as_py()
            yield *key, rel, piece
            rel += len(piece) + len(MAGIC)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces -> one row per piece: where it is, what starts there, and where the chain of
    records that starts there leaves the split (``exit``, relative to the split)."""

    def finished(rows: list[dict], end: int) -> Iterator[pa.RecordBatch]:
        leaves: dict[int, int | None] = {}
        for row in reversed(rows):   # successors lie further on
            succ = row["succ"]
            leaves[row["rel"]] = row["exit"] = None if succ is None else succ if succ >= end else leaves.get(succ)
        for i in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_pylist(rows[i:i + 20_000], schema=_PIECE)

    rows: list[dict] = []
    at, end = None, 0
    for file, block, rel, piece in _positions(batches):
        if (file, block) != at:
            yield from finished(rows, end)
            at, rows = (file, block), []
        end = rel + len(piece) + len(MAGIC)
        row = {"file": file, "block": block, "rel": rel, "size": len(piece) + len(MAGIC), "succ": None, "exit": None}
        if found := _parse(piece):
            row |= dict(zip(("record_id", "record_type", "refers_to", "digest", "head", "length"), found))
            full = row["head"] + row["length"]
            row["succ"] = rel + len(MAGIC) + full + len(END)
            if full + len(END) == len(piece):
                row["payload_digest"] = hashlib.sha256(memoryview(piece)[row["head"]:full]).hexdigest()
        rows.append(row)
    yield from finished(rows, end)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Bytes between magic lines. The piece before a file's first magic line (empty in a
    valid archive) counts as a piece too, so that offsets add up."""
    return (spark.read.option("lineSep", MAGIC).text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.col("value").cast("binary").alias("piece")))


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file, block, rel, piece in _positions(batches):
        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([rel], pa.int64()),
                                          pa.array([piece], pa.binary())], names=["file", "block", "rel", "piece"])


def _walk(key, rows):
    """Records of one split that the chain reaches, from the entry it comes in by."""
    rows = rows.sort_values("rel", kind="stable")
    succ = dict(zip(rows["off"], rows["next"]))
    entries = rows.loc[rows["entry"], "off"]
    reached, at = set(), entries.min() if len(entries) else None
    while at in succ and at not in reached:
        reached.add(at)
        at = succ[at]
    return rows.loc[rows["off"].isin(reached), ["file", "off"]]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records that the boundary chain reaches from each file's start.

    -> ``file, off, record_id, record_type, refers_to, digest, length, payload_digest``:
    ``digest`` is the header's, ``payload_digest`` the SHA-256 of the payload bytes
    read. A chain that breaks (a damaged file) ends there. No files: no rows.
    """
    m = len(MAGIC)
    pieces = written(_pieces(spark, path).mapInArrow(_scan, _PIECE_DDL), "warc-pieces")
    # a split's place in its file, from the splits before it (a few per file)
    spans = pieces.groupBy("file", "block").agg(F.sum("size").alias("total"))
    spans = written(spans.selectExpr(
        "file", "block", "total",
        "sum(total) over (partition by file order by block) - total as base"), "warc-spans")
    # a record's offset is that of its magic line, which precedes its piece
    cand = pieces.join(spans, ["file", "block"]).selectExpr(
        "*", f"base + rel - {m} as off", f"base + succ - {m} as next", f"base + exit - {m} as leaves")

    # pointer jumping over entry points: file starts, and offsets where a chain leaves a split
    enters = (cand.where("leaves is not null").select("file", F.col("leaves").alias("off"))
              .unionByName(cand.where("off = 0").select("file", "off")).distinct())
    jump = (cand.where("succ is not null").join(enters, ["file", "off"])
            .select("file", F.col("off").alias("node"), F.col("leaves").alias("to")).checkpoint())
    reach = jump.where("node = 0").select("file", "node").checkpoint()
    count = reach.count()
    while count:
        ahead = (reach.join(jump, ["file", "node"]).where("to is not null")
                 .select("file", F.col("to").alias("node")))
        grown = reach.unionByName(ahead).join(jump.select("file", "node"), ["file", "node"], "left_semi")
        reach = grown.distinct().checkpoint()
        now = reach.count()
        if now == count:
            break
        count = now
        nxt = jump.select("file", F.col("node").alias("to"), F.col("to").alias("to2"))
        jump = jump.join(nxt, ["file", "to"], "left").select("file", "node", F.col("to2").alias("to")).checkpoint()

    # inside a split the chain is followed from its entry; a split bounds the group
    marked = (cand.where("succ is not null").select("file", "block", "rel", "off", "next")
              .join(reach.select("file", F.col("node").alias("off"), F.lit(True).alias("entry")),
                    ["file", "off"], "left").withColumn("entry", F.coalesce("entry", F.lit(False))))
    kept = marked.groupBy("file", "block").applyInPandas(_walk, "file string, off long")
    records = written(cand.join(kept, ["file", "off"]).select(
        "file", "off", "next", "head", "record_id", "record_type", "refers_to", "digest", "length",
        "payload_digest"), "warc-records")
    out = ["file", "off", "record_id", "record_type", "refers_to", "digest", "length", "payload_digest"]
    spread = records.where("payload_digest is null")
    n = spread.count()
    if not n:
        return records.select(*out)
    return records.where("payload_digest is not null").select(*out).unionByName(
        _rejoined(spark, path, spread, spans, n).select(*out))


def _rejoined(spark: SparkSession, path: str, spread: DataFrame, spans: DataFrame, n: int) -> DataFrame:
    """Records of several pieces: their pieces are read again, put together and hashed.
    A record that the file cuts short has no payload digest."""
    m = len(MAGIC)
    at = spread.join(spans, "file").where("base < next and base + total > off").select(
        "file", "block", "base", "off", "next", "head", "length")
    raw = _pieces(spark, path).mapInArrow(_raw, "file string, block long, rel long, piece binary")
    parts = (raw.join(sized_broadcast(at, n), ["file", "block"])
             .where(f"base + rel - {m} >= off and base + rel - {m} < next")
             .groupBy("file", "off", "head", "length")
             .agg(F.sort_array(F.collect_list(F.struct((F.col("base") + F.col("rel")).alias("p"), "piece"))).alias("ps")))
    # the magic line that stands between two pieces belongs to the payload
    body = F.array_join(F.transform("ps", lambda x: x["piece"].cast("string")), MAGIC).cast("binary")
    whole = parts.select("file", "off", "head", "length", body.alias("body"))
    digests = whole.where("octet_length(body) >= head + length").select(
        "file", "off", F.sha2(F.expr("substring(body, int(head + 1), int(length))"), 256).alias("d"))
    return (spread.join(digests, ["file", "off"], "left")
            .withColumn("payload_digest", F.col("d")).drop("d"))


def page_records(records: DataFrame) -> DataFrame:
    """Records read back -> one row per page, revisits resolved through what they refer to.

    -> ``page_id, payload_bytes, payload_digest, record_type, refers_to, intact``; ``intact``
    tells whether the header's digest is that of the payload read.
    """
    page = F.regexp_extract("record_id", r"page:(-?\d+|null)>", 1).try_cast("long")
    first = F.regexp_extract("refers_to", r"page:(-?\d+)>", 1).try_cast("long")
    r = records.select(page.alias("page_id"), first.alias("refers_to"), "record_type", "length", "payload_digest",
                       F.substring_index("digest", ":", -1).alias("claimed"))
    own = r.where("record_type <> 'revisit'")
    again = r.where("record_type = 'revisit'").drop("length", "payload_digest")
    targets = (own.groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("claimed"))
               .agg(F.min("length").alias("length")))
    again = again.join(targets, ["refers_to", "claimed"], "left").withColumn("payload_digest", F.col("claimed"))
    both = own.unionByName(again)
    return both.select("page_id", F.col("length").alias("payload_bytes"), "payload_digest", "record_type",
                       "refers_to", (F.col("payload_digest").eqNullSafe(F.col("claimed"))
                                     & F.col("length").isNotNull()).alias("intact"))


def archive_pages(pages: DataFrame, path: str, min_revisit: int = 100) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives under ``path``, read them back, one row per page.
    An empty table gives no rows; other columns are ignored."""
    write_archives(pages.select(F.col("page_id").alias("id"), F.col("url").alias("uri"),
                                F.col("html").alias("payload")), path, min_revisit)
    return page_records(read_archives(pages.sparkSession, path))
