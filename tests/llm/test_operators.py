"""The training-data operators against brute force, the libraries they must equal, and odd tables."""

from __future__ import annotations

import hashlib
import os
import string
import zlib

import numpy as np
import pytest

pytest.importorskip("marketlens.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from marketlens.llm import ann, bpe, common, langid, lines, packing, quality, simhash, token_files, topk, warc  # noqa: E402

SF = "/root/testdata/sf0.001"
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long, fp string, row string"
LONG = " ".join(f"word{i % 7000}" for i in range(40_000))
ODD = [(1, None, None, None, None, "x", "y"), (2, "", "en", "a", 0, "x", "y"), (3, LONG, "en", "a", len(LONG), None, None),
       (3, LONG, "en", "a", len(LONG), None, None), (None, "one two three four five six", "de", "b", 27, "x", "y"),
       (5, "\n\n... 123 !!\n", "en", None, 13, "x", "y"), (6, "one two three four five six", None, "b/c", 27, "x", "y"),
       (7, "漢字 ñandú ΑΣ <|endoftext|> é é H̱ 😀\tx\x0by", "es", "", 40, "x", "y")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --------------------------------------------------------------------------- components
def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


# --------------------------------------------------------------------------- 1
PAGE = [(1, "u", "x" * 99), (2, "u", "x" * 99), (5, "u", "y" * 200), (3, "v", "y" * 200), (4, None, "y" * 200),
        (8, "a\r\nb", None), (9, "u", "é" * 60 + "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:marketlens:page:77>"
                         "\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nrest WARC/1.0\r\nWARC/1.0\r\n"), (None, "u", "z" * 150)]


def expected_pages(rows):
    out = []
    for pid, _, html in rows:
        body = (html or "").encode()
        ids = [p for p, _, h in rows if p is not None and (h or "").encode() == body]
        first = min(ids) if len(body) >= 100 and ids else None
        again = first is not None and first != pid
        out.append((pid, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None, True))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", ["64", "300", "128m"])
def test_warc_round_trip_with_magic_inside_payloads_and_any_split(spark, tmp_path, split):
    rows = PAGE + [(100 + i, "u", f"page {i} " * 30) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = warc.archive_pages(pages, str(tmp_path / "w")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
    assert sorted((tuple(r[c] for c in cols) for r in got), key=str) == expected_pages(rows)


def test_warc_of_an_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string, file string")
    assert warc.archive_pages(none, str(tmp_path / "w")).count() == 0


# --------------------------------------------------------------------------- 2
def plain_fingerprint(text):
    import xxhash
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_by_brute_force(fps, ids, bits):
    root = list(range(len(fps)))
    for _ in range(len(fps)):
        old = root[:]
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= bits:
                    root[i] = min(root[i], root[j])
        if root == old:
            break
    return [min((ids[j] for j in range(len(ids)) if root[j] == root[i] and ids[j] is not None), default=None) for i in range(len(ids))]


def test_simhash_groups_equal_brute_force(spark, odd):
    base = [(r.doc_id, r.text) for r in docs(spark).select("doc_id", "text").limit(120).collect()]
    near = [(1000 + i, (t or "") + " extra") for i, (_, t) in enumerate(base[:40])]
    rows = base + near + [(r[0], r[1]) for r in ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.fp & (2 ** 64 - 1), r.component_id) for r in simhash.near_duplicates(df).collect()}
    fps = [plain_fingerprint(t) for _, t in rows]
    assert got == set(zip([i for i, _ in rows], fps, groups_by_brute_force(fps, [i for i, _ in rows], 2)))


def test_simhash_links_of_a_dense_group(spark):
    rng = np.random.default_rng(0)
    fps = sorted({0} | {1 << i for i in range(40)} | {(1 << i) ^ (1 << j) ^ (1 << k) for i, j, k in rng.integers(0, 64, (200, 3)).tolist()}
                 | {int(x) for x in rng.integers(0, 2 ** 63, 100)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    levels = simhash.build_index(spark.createDataFrame([(f,) for f in signed], "fp long"))
    found = simhash.links(levels, 2).collect()
    assert all(((r.a ^ r.b) & (2 ** 64 - 1)).bit_count() <= 2 for r in found)
    roots = {r.node: r.root for r in common.connected_components(simhash.links(levels, 2)).collect()}
    want = groups_by_brute_force(fps, signed, 2)
    have = [roots.get(f, f) for f in signed]
    assert len({*zip(want, have)}) == len(set(want)) == len(set(have))


def test_simhash_of_an_empty_table(none):
    assert simhash.near_duplicates(none).count() == 0


# --------------------------------------------------------------------------- 3, 10
def library_ids(path, text, end):
    return [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, *end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5, 5, 9, 1000, 10 ** 12], list(range(0, 5000, 7)), [2 ** 60] * 200])
def test_elias_fano_round_trip_and_select(values):
    ef = token_files.EliasFano.from_bytes(token_files.EliasFano.encode(np.array(values, np.uint64)).to_bytes())
    assert ef.all().tolist() == values and [ef.select(i) for i in range(len(values))] == values


def test_token_files_equal_the_library(spark, odd, tmp_path):
    df = odd.select("doc_id", "text").unionByName(docs(spark).select(F.col("doc_id") + 100, "text").toDF("doc_id", "text"))
    path = token_files.write_tokens(df, str(tmp_path / "t"), WORDS, end_id=1)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_tokens(spark, path).collect()))
    rows = [(r.doc_id, library_ids(WORDS, r.text, [1])) for r in df.collect()]
    ids = [d for _, d, _, _ in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    assert [s for s, _, _, _ in got] == np.concatenate([[0], np.cumsum([n for _, _, n, _ in got])[:-1]]).tolist()
    assert sorted((str(d), n, c) for _, d, n, c in got) == sorted((str(d), len(x), crc(x)) for d, x in rows)
    some = {r.doc_id: r.ids for r in token_files.document_ids(spark, path, [3, 7, 150]).collect()}
    assert all(some[d] == x for d, x in rows if d in (3, 7, 150))


def test_token_files_of_an_empty_table(spark, none, tmp_path):
    path = token_files.write_tokens(none, str(tmp_path / "t"), WORDS)
    assert token_files.read_tokens(spark, path).count() == 0


def test_packing_loses_no_id_and_pads_little(spark, odd):
    df = docs(spark).select("doc_id", "text").repartition(40).unionByName(odd.where("doc_id is not null").select("doc_id", "text").distinct())
    got = packing.pack(df, WORDS, end_id=2, size=1024, windows=4).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    lib = {}
    for r in df.collect():
        lib.setdefault(r.doc_id, []).append(library_ids(WORDS, r.text, [2]))
    for d, texts in lib.items():
        if len(texts) == 1:
            at = 0
            for p in sorted(by_doc[d], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(texts[0]) and p.ids_crc32 == crc(texts[0][at:at + p.length])
                at += p.length
            assert at == len(texts[0])
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    total = sum(len(x) for t in lib.values() for x in t)
    assert sum(p.length for p in got) == total and len(by_seq) * 1024 <= 1.05 * total + 1024


def test_packing_of_odd_and_empty_tables(odd, none):
    assert packing.pack(none, WORDS).count() == 0
    assert sum(r.length for r in packing.pack(odd, WORDS).collect()) == sum(len(library_ids(WORDS, r[1], [2])) for r in ODD)


# --------------------------------------------------------------------------- 4
def test_language_is_learned_and_empty_texts_are_undetermined(spark, odd, none):
    df = docs(spark)
    got = langid.evaluate(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    proto = langid.learn(df)
    pred = [(r.lang_pred, r.row) for r in langid.identify(odd, proto).where("doc_id in (1, 2, 5)").collect()]
    assert {p for p, _ in pred} == {"und"}
    assert langid.identify(odd, proto).columns == [*odd.columns, "lang_pred", "score"]
    assert langid.evaluate(none).count() == 0 and langid.identify(odd, {}).where("lang_pred <> 'und'").count() == 0


# --------------------------------------------------------------------------- 5, 7
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:200] = x[100]
    rows = [(i, x[i].tolist()) for i in range(600)]
    rows += [(700, None), (800, [0.0] * 16), (900, [float("nan")] * 16), (1000, [None] * 16), (None, x[1].tolist()), (1100, []),
             (50, x[50].tolist()), (1200, [float("inf")] * 16)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("g", F.lit("clash"))


def test_nearest_recall_ties_and_odd_vectors(spark):
    rows, df = vectors(spark)
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    got = {}
    for r in ann.nearest(df, every=50, k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in ok if i % 50 == 0}
    hits = 0
    for q, found in got.items():
        cos = {i: float(v @ ok[q] / np.linalg.norm(v) / np.linalg.norm(ok[q])) for i, v in ok.items() if i != q}
        want = sorted(cos, key=lambda i: (-round(cos[i], 12), i))[:5]
        found = sorted(found)
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(abs(s - cos[i]) < 1e-9 for _, i, s in found)
        hits += len(set(want) & {i for _, i, _ in found})
    assert hits >= 0.9 * 5 * len(got)
    assert [i for _, i, _ in sorted(got[150])] == [100, 101, 102, 103, 104]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (3, [1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r.vec_id) for r in ann.nearest(few).collect()) == [(0, 50), (50, 0)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_nearest_recall_of_the_given_vectors(spark):
    from marketlens.llm import registry
    sf = os.path.join(os.path.dirname(SF), "sf0.1")
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = np.array(sorted(i for i, v in rows.items() if i is not None and v and len(v) == 64 and np.isfinite(v).all() and any(v)))
    unit = np.array([np.array(rows[i], float) / np.linalg.norm(np.array(rows[i], float)) for i in ids])
    got, hits = {}, 0
    for r in registry.op5_nearest(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q, found in got.items():
        cos = np.where(ids == q, -9, np.round(unit @ unit[np.searchsorted(ids, q)], 12))
        hits += len(found & set(ids[np.lexsort((ids, -cos))[:5]].tolist()))
    assert len(got) >= 40 and hits >= 0.95 * 5 * len(got)


def test_top_k_products_run_in_more_than_two_tasks(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 16)
    x = np.random.default_rng(11).normal(size=(400, 8))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    v = topk.integers(df)
    rows = v.mapInArrow(topk._blocks(16, 2), topk._BLOCK_DDL).withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(4)).cast("int"))
    queries = v.where("vec_id % 100 = 0").mapInArrow(topk._blocks(512, 2), topk._BLOCK_DDL)
    q = queries.select("node", "d", F.col("ids").alias("q_ids"), F.col("x").alias("q_x"))
    met = topk._met(rows, q, 4)
    assert met.count() == sum(queries.where(F.col("node") == n).count() * rows.where(F.col("node") == n).count() for n in (0, 1))
    assert met.select(F.spark_partition_id()).distinct().count() > 2
    ints = np.floor(x * 1024).astype(np.int64)
    want = set()
    for a in range(0, 400, 100):
        best = sorted(((-int(ints[a] @ ints[b]), b) for b in range(400) if b != a))[:10]
        want |= {(a, r + 1, b, -s) for r, (s, b) in enumerate(best)}
    assert {tuple(r) for r in topk.top_k(df).collect()} == want


def test_top_k_equals_brute_force(spark):
    rows, df = vectors(spark)
    ok = {i: np.floor(1024 * np.array(v, np.float64)).astype(int) for i, v in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in ok if i % 100 == 0):
        s = {i: int(v @ ok[q]) for i, v in ok.items() if i != q}
        want |= {(q, r + 1, i, s[i]) for r, i in enumerate(sorted(s, key=lambda i: (-s[i], i))[:10])}
    assert {tuple(r) for r in topk.top_k(df).collect()} == want
    few = spark.createDataFrame([(0, [-1.0, 0.5]), (1, [1.0, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few).collect()] == [(0, 1, 1, -1024 * 1024 + 512 * 512)]
    assert topk.top_k(df.limit(0)).count() == 0


# --------------------------------------------------------------------------- 6
def test_quality_separates_labelled_documents_and_shrinks_sites(spark, odd, none):
    sf = os.path.join(os.path.dirname(SF), "sf0.01")
    df, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.classify(df, labels).join(labels, "doc_id").collect()
    assert np.mean([(r.p_good >= 0.5) == (r.quality == 1) for r in judged]) > 0.98
    got = {(r.doc_id, r.p_good > 0) for r in quality.classify(odd, labels).collect()}
    assert (1, False) in got and (2, False) in got and (3, True) in got
    assert quality.classify(odd, labels).count() == len(ODD) and quality.classify(none, labels).count() == 0
    assert quality.classify(odd, labels.limit(0)).count() == len(ODD)
    scored = spark.createDataFrame([("h", "h/a", 4.0)] * 200 + [("h", "h/b", -4.0)] + [("i", "i/c", -4.0)] * 200, "host string, path string, e double")
    share = {r.path: r.share for r in quality.site_counts(scored, 0.5).select("path", quality.site_share().alias("share")).collect()}
    assert share["h/a"] > 0.9 > share["h/b"] > share["i/c"]


def test_quality_equals_plain_empirical_bayes(spark):
    """Grouped sums, moments and posteriors written out, for weights fitted on all labelled rows."""
    df, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    df = df.withColumn("P_Good", F.lit("clash"))
    rows = df.select("doc_id", "source", "lang", quality.statistics(F.col("text")).alias("x"),
                     (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).alias("some")).collect()
    label = {r.doc_id: r.quality for r in labels.where("quality in (0, 1)").collect()}
    sample = [(list(r.x), label[r.doc_id]) for r in rows if r.some and r.doc_id in label]
    w, base = quality.fit(sample), np.mean([q for _, q in sample])
    logit = np.log(base / (1 - base))
    docs_ = []
    for r in rows:
        e = min(max(w[0] + sum(a * b for a, b in zip(w[1:], r.x)), -30.0), 30.0)
        docs_.append((r.doc_id, (r.source or "").split("/")[0], f"{r.source or ''}/{r.lang or ''}", e, 1 / (1 + np.exp(-(e + logit))), r.some))

    def grouped(key):
        out = {}
        for d in docs_:
            if d[5]:
                n, s = out.get(d[key], (0.0, 0.0))
                out[d[key]] = n + 1, s + d[4]
        return out

    def strength(groups, mean):
        n, s, m = (np.array(v) for v in zip(*[(n, s, mean(k)) for k, (n, s) in groups.items()]))
        between = max(((n * (s / n - m) ** 2).sum() - (m * (1 - m)).sum()) / max(n.sum() - (n * n).sum() / n.sum(), 1e-9), 1e-9)
        return min(max((n * m * (1 - m)).sum() / n.sum() / between - 1, quality._LIMITS[0]), quality._LIMITS[1])

    hosts, paths, host_of = grouped(1), grouped(2), {d[2]: d[1] for d in docs_}
    mean = sum(s for _, s in hosts.values()) / sum(n for n, _ in hosts.values())
    hk = strength(hosts, lambda k: mean)
    pk = strength(paths, lambda k: (hk * mean + hosts[host_of[k]][1]) / (hk + hosts[host_of[k]][0]))
    got = {r.doc_id: r.p_good for r in quality.classify(df, labels).collect()}
    for doc, host, path, e, p, some in docs_:
        if not some:
            assert got[doc] == 0
            continue
        h = (hk * mean + hosts[host][1] - p) / (hk + hosts[host][0] - 1)
        share = min(max((pk * h + paths[path][1] - p) / (pk + paths[path][0] - 1), 1e-6), 1 - 1e-6)
        assert got[doc] == pytest.approx(1 / (1 + np.exp(-(e + np.log(share / (1 - share))))), abs=1e-6)


def test_a_lone_document_of_a_site_does_not_count_twice(spark):
    counts = spark.createDataFrame([("h", "h/a", 3.0)] * 50 + [("h", "h/b", -3.0)], "host string, path string, e double")
    of = quality.site_counts(counts, 0.5).where("path = 'h/b'")
    own = 1 / (1 + np.exp(3.0))
    with_own, without = of.select(quality.site_share(), quality.site_share(F.lit(float(own)))).first()
    host = of.select(((F.col("hk") * F.col("mean") + F.col("hs") - own) / (F.col("hk") + F.col("hn") - 1))).first()[0]
    assert without == pytest.approx(host) and with_own < without      # nothing is left of the path: its host's share


@pytest.mark.parametrize("column", ["removed_lines", "Removed_Lines", "p_good", "P_GOOD", "LANG_PRED", "Score"])
def test_clashing_columns_do_not_crash(spark, odd, column):
    df = odd.withColumn(column, F.lit(7))
    labels = spark.createDataFrame([(6, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    made = [lines.dedup_lines(df), quality.classify(df, labels), langid.identify(df, langid.learn(odd.where("doc_id is not null")))]
    for out in made:
        names = [c.lower() for c in out.columns]
        assert len(names) == len(set(names)) and out.count() == len(ODD)


def test_stages_of_empty_tables(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs(spark).select(*corpus_pipeline.COLUMNS).limit(0), SF).count() == 0, name


# --------------------------------------------------------------------------- 8
def test_bpe_equals_the_library(spark, odd, none):
    df = odd.select("doc_id", "text").unionByName(docs(spark).select("doc_id", "text").limit(80))
    lib = Tokenizer.from_file(BYTES)
    want = []
    for r in df.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want.append((str(r.doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in bpe.round_trip(df, BYTES).collect()) == sorted(want)
    assert bpe.round_trip(none, BYTES).count() == 0
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(odd, BYTES), BYTES).collect()}
    assert back[3] == LONG and back[1] == ""


def test_bpe_exact_merge_is_needed_and_right():
    coder, lib = bpe.coder(BYTES), Tokenizer.from_file(BYTES)
    words = ["a" * 300, "thethethe" * 20, "abcabd" * 9, "\n" * 90, "xyzzy", " indivisible", "é" * 70]
    assert [x.tolist() for x in coder.encode(words)] == [lib.encode(w, add_special_tokens=False).ids for w in words]
    assert any(coder.propose(w.encode()) != coder.merge(w.encode()) for w in words)


# --------------------------------------------------------------------------- 9
def plain_line_words(line):
    cut = set(" \t\r\x0b\x0c\xa0¡«»¿·" + string.punctuation) | {chr(c) for c in range(0x2010, 0x2028)}
    return "".join(" " if c in cut else c for c in line.lower()).split(" ")


def test_line_simhash_and_candidates_equal_brute_force(spark):
    sized = [(-n, " ".join(f"w{i * n % 97}…" for i in range(n))) for n in (4, 5, 62, 63, 64, 65, 126, 127, 128, 254, 255, 900)]
    texts = docs(spark).select("doc_id", "text").limit(150).unionByName(spark.createDataFrame(sized, "doc_id long, text string")).collect()
    got = {(r.doc_id, r.pos): r.sim for r in lines.occurrences(spark.createDataFrame(texts, "doc_id long, text string"), 5).collect()}
    want = {}
    for r in texts:
        for pos, line in enumerate((r.text or "").split("\n")):
            if len([w for w in plain_line_words(line) if w]) >= 5:
                v = lines_sim(line)
                want[r.doc_id, pos] = v - 2 ** 64 if v >> 63 else v
    assert got == want and len(want) > 150
    rng = np.random.default_rng(1)
    base = rng.integers(-2 ** 63, 2 ** 63, 40).tolist()
    fps = [b ^ int(np.bitwise_xor.reduce(np.int64(1) << rng.integers(0, 63, rng.integers(0, 5)).astype(np.int64), initial=0)) for b in base for _ in range(4)]
    got = [(r.a, r.b) for r in lines.candidates(spark.createDataFrame(list(enumerate(fps)), "id long, sim long")).collect()]
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if ((fps[i] ^ fps[j]) & (2 ** 64 - 1)).bit_count() <= 3}
    assert len(got) == len(set(got)) and set(got) == want


def test_lines_keep_the_first_of_each_group(spark, none):
    long = " ".join(f"alpha{i} beta{i}" for i in range(40))
    near = long.replace("beta39", "gamma39")
    while (lines_sim(long) ^ lines_sim(near)).bit_count() > 3:
        near += "x"
    rows = [(2, f"own line with five words\n{long}\nshort one", "x"), (1, f"{long.upper()}!\n{near}\nshort one", "y"),
            (3, None, "z"), (None, f"{near}\nnothing else here is ever said", "w"), (4, "", "v"), (4, "", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, drop string")
    got = {(r.doc_id, r.text, r.drop, r.removed_lines) for r in lines.dedup_lines(df).collect()}
    assert got == {(2, "own line with five words\nshort one", "x", 1), (1, f"{long.upper()}!\nshort one", "y", 1), (3, None, "z", 0),
                   (None, "nothing else here is ever said", "w", 1), (4, "", "v", 0)}
    assert lines.dedup_lines(none).count() == 0


def lines_sim(line):
    import xxhash
    words = [w for w in plain_line_words(line) if w]
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_edit_similarity_equals_brute_force(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng, pairs = np.random.default_rng(5), [("", ""), ("", "a"), ("é" * 10, "é" * 8), ("abcde", "abcdx")]
    for n in (1, 2, 3, 5, 9, 10, 11, 20, 40, 77):
        for _ in range(30):
            a = list(rng.choice(list("abcé "), n))
            b = list(a)
            for _ in range(rng.integers(0, n // 2 + 2)):   # edits at the start, at the end or anywhere
                at = int(rng.choice([0, len(b), rng.integers(0, len(b) + 1)]))
                b[at:at + int(rng.integers(0, 2))] = list(rng.choice(list("abcé "), rng.integers(0, 2)))
            pairs.append(("".join(a), "".join(b)))
    got = [r.s for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i")
           .select(lines.similar(F.col("a"), F.col("b"), 0.8).alias("s")).collect()]
    want = [5 * distance(a, b) <= max(len(a), len(b)) for a, b in pairs]
    assert got == want and 20 < sum(want) < len(want) - 20


def test_a_dense_group_of_lines_keeps_one(spark):
    words = [f"term{i}" for i in range(60)]
    copies = [" ".join(words[:i] + [f"{words[i]}x"] + words[i + 1:]) for i in range(60)]
    sims = {c: lines_sim(c) for c in copies}
    group = {c: c for c in copies}

    def top(c):
        while group[c] != c:
            c = group[c]
        return c

    for a in copies:
        for b in copies:
            if (sims[a] ^ sims[b]).bit_count() <= 3:   # one word apart each: similar
                group[max(top(a), top(b))] = min(top(a), top(b))
    df = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string")
    assert lines.dedup_lines(df).where("removed_lines = 0").count() == len({top(c) for c in copies})


def test_lines_of_the_odd_table(odd):
    got = {(r.doc_id, r.removed_lines) for r in lines.dedup_lines(odd).collect()}
    assert {(1, 0), (2, 0), (3, 0), (5, 0), (6, 0), (None, 1)} <= got


def op9(spark, tmp_path, texts):
    from marketlens.llm import registry
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return {r.doc_id: r.removed_lines for r in registry.op9_lines(spark, str(tmp_path)).collect()}


def test_lines_with_a_changed_word_or_letter_are_found(spark, tmp_path):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list(string.ascii_lowercase), rng.integers(3, 9)))
    base = [[word() for _ in range(n)] for n in (10, 20, 40) for _ in range(30)]
    changed = [[*w[:4], w[4] + "q" if i % 2 else word(), *w[5:]] for i, w in enumerate(base)]
    got = op9(spark, tmp_path, [" ".join(w) for w in base + changed])
    assert not any(got[i] for i in range(90))
    assert all(sum(got[90 + g + i] for i in range(30)) >= 24 for g in (0, 30, 60))


def test_a_group_of_near_lines_makes_few_pairs_and_stays_whole(spark, monkeypatch):
    rng, sizes = np.random.default_rng(8), {}
    words = [f"term{i}" for i in range(60)]
    copies = [" ".join(f"other{rng.integers(10 ** 6)}" if rng.random() < 0.05 else w for w in words) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string")

    def counted(rows, name):
        out = common.written(rows, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(lines, "written", counted)
    _, repeated = lines.line_groups(df, whole=True)
    kept = repeated.select("first").distinct().count() + len(set(copies)) - repeated.count()
    assert kept <= 3 and sizes["lines-star"] <= 300 * 8 and sizes["lines-pairs"] <= 900   # with all pairs but those of two shared blocks: 2842


def test_components_leave_no_shuffle_files_of_their_rounds(spark):
    import time

    def files():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    edges = common.written(spark.range(300).selectExpr("id a", "id + 1 b"), "test-path")
    common.swept(edges)
    time.sleep(2)
    before = files()
    roots = common.connected_components(edges)
    for _ in range(20):
        if files() <= before + 60:
            break
        time.sleep(0.5)
    assert files() <= before + 60
    assert roots.count() == 301 and roots.where("root <> 0").count() == 0


def test_line_dedup_leaves_only_what_its_result_reads(spark):
    import pathlib

    top = pathlib.Path(common.shared_dir(spark).removeprefix("file:")) / "marketlens-llm"
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    df = spark.createDataFrame([(1, words + " one"), (2, words + " one\nother things are said here"), (3, words + " two")],
                               "doc_id long, text string")
    before = set(top.iterdir()) if top.exists() else set()
    out = lines.dedup_lines(df, whole=True)
    left = sorted(x.name.rpartition("-")[0] for x in set(top.iterdir()) - before)
    assert left == ["lines-drop"]
    assert {r.doc_id: r.text for r in out.collect()} == {1: words + " one", 2: "other things are said here", 3: ""}


def test_line_pairs_of_shared_blocks_equal_brute_force(spark):
    texts = [(i, "the same nine words of a line but number " + str(i % 3) * (1 + i % 2)) for i in range(12)] + [(99, "nothing like any of these at all")]
    runs = common.written(lines.class_votes(spark.createDataFrame(texts, "doc_id long, text string"), 5), "test-votes")
    marked = common.written(lines.class_prints(runs).withColumn("id", F.col("doc_id")), "test-prints")
    keys = {}
    for r in marked.where("n > 0").select(lines._block_keys(), "id").collect():
        keys.setdefault(r.key, set()).add(r.id)
    shared = lines.shared_blocks(marked)
    assert {r.key for r in shared.collect()} == {k for k, ids in keys.items() if len(ids) > 1}
    members = lines.block_members(marked, shared, 0)
    assert sorted((r.key, r.id) for r in members.collect()) == sorted((k, i) for k, ids in keys.items() if len(ids) > 1 for i in ids)
    near = members.withColumn("root", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")))
    got = {(r.a, r.b) for r in lines.block_candidates(near, 0.8, star=False).collect()}
    every = {(r.a, r.b) for r in lines.block_candidates(members.withColumn("root", F.col("id")), 0.8, star=False).collect()}
    assert got == {(a, b) for a, b in every if a % 2 or b % 2} and got and got != every


def test_letters_refuse_no_similar_line(spark):
    rng, rows = np.random.default_rng(9), []
    for i in range(400):
        a = list(rng.choice(list("abcdeé "), rng.integers(20, 200), p=[.4, .2, .1, .1, .1, .05, .05]))
        b = list(a)
        for _ in range(int(rng.integers(0, len(a) // 3 + 1))):
            at = int(rng.integers(0, len(b) + 1))
            b[at:at + int(rng.integers(0, 2))] = list(rng.choice(list("hldcé"), rng.integers(0, 2)))
        b = b if i % 4 else list(rng.choice(list("hldcmu "), len(a)))
        rows.append((i, "".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "id int, a string, b string")
    of = lambda c: F.struct(F.length(c).alias("chars"), *[x.alias(f"l{i}") for i, x in enumerate(lines._letter_counts(F.col(c)))])
    got = (df.select("a", "b", of("a").alias("x"), of("b").alias("y"))
           .select(lines.similar(F.col("a"), F.col("b"), 0.8).alias("s"), lines._letters_allow(0.8).alias("may")).collect())
    assert not [r for r in got if r.s and not r.may]
    assert sum(not r.may for r in got) > 20 and sum(r.s for r in got) > 20


def test_line_blocks_by_class_equal_brute_force(spark):
    import xxhash
    texts = [(n, " ".join(f"w{i * 7919 % 100003}" for i in range(n)) + " w0 w0") for n in (5, 31, 32, 126, 127, 128, 300, 2500)]
    runs = common.written(lines.class_votes(spark.createDataFrame(texts, "doc_id long, text string"), 5), "test-votes")
    got = {r.doc_id: r for r in lines.class_prints(runs).collect()}
    signed = lambda v: v - (1 << 64) if v >> 63 else v

    def prints(hashes, classes):   # class c, bit b of byte k
        out = [0, 0]
        for c in range(classes):
            mine = [h for h in hashes if (h >> 5 & 7) % classes == c]
            for k in range(8):
                for half in (0, 1):
                    if 2 * sum(h >> 8 * k + half & 1 for h in mine) > len(mine):
                        out[c // 4] |= 1 << 8 * k + half + 2 * (c % 4)
        return [signed(v) for v in out]

    for n, text in texts:
        hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in dict.fromkeys(text.split())]
        assert [got[n].f0, got[n].f1] == prints(hashes, 8) and got[n].n == len(hashes)
        assert got[n].f4 == (prints(hashes, 4)[0] if len(hashes) < 32 else None)
    assert len(got) == len(texts)


def test_short_lines_and_lines_without_spaces_are_deduplicated(spark, tmp_path):
    han = ["".join(chr(0x4E00 + c) for c in np.random.default_rng(i).integers(0, 3000, 40)) for i in range(10)]
    near = [h[:20] + "龜" + h[21:] for h in han]
    texts = ["Contents\n \n---\nown", "contents:\n\n\t\n---\n***\nother", *han, *han, *near]
    got = op9(spark, tmp_path, texts)
    assert got[0] == 0 and got[1] == 2
    assert [got[i] for i in range(2, 12)] == [0] * 10 and [got[i] for i in range(12, 22)] == [1] * 10
    assert sum(got[i] for i in range(22, 32)) >= 8


def test_the_bound_by_pieces_is_no_less_than_the_distance(spark):
    rng, rows = np.random.default_rng(11), []
    word = lambda: "".join(rng.choice(list("abcdefghé"), rng.integers(2, 9)))
    for i in range(24):
        a = [word() for _ in range(int(rng.integers(1, 500)))]
        b = [word() if rng.random() < 0.03 else w for w in a]
        at = int(rng.integers(0, len(b) + 1))
        b[at:at] = [word() for _ in range(len(a) // 10 if i % 3 else 0)]   # one long insertion moves all that follows
        rows.append((i, *(" ".join(x) for x in ((a, b) if i % 2 else (b, a)))))
    rows += [(90, "", "abc"), (91, "", ""), (92, "x" * 801, "x" * 799), (93, "a" * 2400, "b" * 2000)]
    got = spark.createDataFrame(rows, "i int, a string, b string").select("i", F.greatest(F.length("a"), F.length("b")).alias("n"), F.levenshtein("a", "b").alias(
        "d"), lines._piecewise(F.col("a"), F.col("b")).alias("p"), lines.similar(F.col("a"), F.col("b"), 0.8).alias("s")).collect()
    assert all(r.p >= r.d and r.s == (5 * r.d <= r.n) for r in got)
    assert sum(5 * r.p <= r.n for r in got if r.i < 90) >= 16


def test_blocks_of_other_words_with_equal_bits_are_not_shared(spark):
    rng = np.random.default_rng(12)
    texts = [(i, " ".join(f"{rng.integers(10 ** 9)}x" for _ in range(30))) for i in range(4000)]   # no two lines have a word in common
    runs = common.written(lines.class_votes(spark.createDataFrame(texts, "doc_id long, text string"), 5), "test-votes")
    marked = common.written(lines.class_prints(runs).withColumn("id", F.col("doc_id")), "test-prints")
    assert lines.shared_blocks(marked).count() <= 40   # by the bits and numbers of words alone: 940


def test_the_bound_by_words_is_no_less_than_the_distance(spark):
    rng, rows = np.random.default_rng(14), [("", "abc"), ("", ""), ("a", "b c d"), ("x" * 50, "y" * 41 + " z"), ("b c d", "a")]
    word = lambda: "".join(rng.choice(list("abcdefghé"), rng.integers(2, 9)))
    for i in range(60):
        a = [word() for _ in range(int(rng.integers(1, 80)))]
        b = [word() if rng.random() < 0.08 else w[1:] if rng.random() < 0.05 else w for w in a]
        at = int(rng.integers(0, len(b) + 1))
        b[at:at] = [word() for _ in range(len(a) // 12 if i % 3 else 0)]
        rows.append(tuple(" ".join(x) for x in ((a, b) if i % 2 else (b, a))))
    got = spark.createDataFrame(rows, "a string, b string").select(F.greatest(F.length("a"), F.length("b")).alias("n"), F.levenshtein("a", "b").alias(
        "d"), lines._wordwise(F.col("a"), F.col("b")).alias("w"), lines.similar(F.col("a"), F.col("b"), 0.8).alias("s")).collect()
    assert all(r.w >= r.d and r.s == (5 * r.d <= r.n) for r in got)
    assert sum(5 * r.w <= r.n for r in got) >= 0.8 * sum(r.s for r in got) > 20


def test_a_block_of_a_frequent_word_is_divided_and_near_lines_in_it_are_found(spark):
    rng = np.random.default_rng(15)
    base = [[f"{rng.integers(10 ** 9)}x" for _ in range(29)] for _ in range(1500)]
    texts = [["often", *w] for w in base] + [["often", *w[:7], f"new{i}", *w[8:20], f"other{i}", *w[21:]] for i, w in enumerate(base[:100])]
    runs = common.written(lines.class_votes(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string"), 5, 96), "test-votes")
    marked = common.written(lines.class_prints(runs).withColumn("id", F.col("doc_id")), "test-prints")
    members = lines.block_members(marked, lines.shared_blocks(marked), 10 ** 9).withColumn("root", F.col("id"))
    # one block for all, as a class that holds one word alone makes
    near = common.written(members.dropDuplicates(["id"]).withColumn("key", F.lit(7).cast("long")), "test-near")
    pairs = lines._divided(near).groupBy("key").count().selectExpr("sum(count * (count - 1) / 2)").first()[0]
    assert pairs < 40 * 1600   # of 1.28 million in the block
    got = {(r.a, r.b) for r in lines.block_candidates(near, 0.8, star=False).collect()}
    assert sum((i, 1500 + i) in got for i in range(100)) == 100 and len(got) <= 110


def test_lines_around_the_limits_of_their_keys_are_found(spark, tmp_path):
    rng = np.random.default_rng(13)
    base = [[f"{rng.integers(10 ** 7)}w" for _ in range(n)] for n in (24, 31, 32, 95, 96, 125, 126, 127, 254)]
    got = op9(spark, tmp_path, [" ".join(w) for w in base] + [" ".join([*w[:5], f"new{i}", *w[5:]]) for i, w in enumerate(base)])
    assert [got[i] for i in range(18)] == [0] * 9 + [1] * 9


# --------------------------------------------------------------------------- pipeline
def test_pipeline_stages_take_effect(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = os.path.join(os.path.dirname(SF), "sf0.01")
    df, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, df, sf), f"test-{name}")
        seen.append((name, out.count()))
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
        if name == "near_duplicates":
            kept = {r.doc_id for r in out.collect()}
            fps = simhash.near_duplicates(df).collect()
            assert kept == {r.doc_id for r in fps if r.doc_id == r.component_id}
        if name == "lines":
            assert out.where("n_chars <> length(text)").count() == 0
        df = out
    counts = dict(seen)
    assert 1000 > counts["quality"] >= counts["language"] == counts["lines"] > counts["near_duplicates"]
    total = df.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t"))
    assert total.where("n <> t").count() == 0


def test_language_stage_drops_foreign_texts_and_letter_junk(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(4)
    junk = ["".join(rng.choice(list(a + "    "), 400)) for a in (string.ascii_lowercase, "абвгдежзийклмнопрстуфхцчшщъыьэюя") for _ in range(20)]
    junk += ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
             "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью."]
    clean = docs(spark).select(*corpus_pipeline.COLUMNS).where("n_chars >= 100")
    rows = spark.createDataFrame([(10 ** 9 + i, t, None, "x", len(t)) for i, t in enumerate(junk)], clean.schema)
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, clean.unionByName(rows), SF).collect()}
    assert not [i for i in kept if i >= 10 ** 9]
    assert len(kept) >= 0.9 * clean.select("doc_id").distinct().count()


def test_language_stage_keeps_short_texts_and_all_real_ones(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    clean = docs(spark).select(*corpus_pipeline.COLUMNS)
    words = [w for r in clean.limit(5).collect() for w in r.text.split()][:30]
    short = [" ".join(words[i:i + 1 + i % 3]) for i in range(0, 27, 3)] + ["Ok", "Zażółć gęślą", "123 45"]
    rows = spark.createDataFrame([(10 ** 9 + i, t, None, "x", len(t)) for i, t in enumerate(short)], clean.schema)
    kept = {r.doc_id: r.lang for r in corpus_pipeline.language_stage(spark, clean.unionByName(rows), SF).collect()}
    assert [10 ** 9 + i in kept for i in range(len(short))] == [True] * (len(short) - 1) + [False]     # no letter: goes
    real = {r.doc_id for r in clean.where("text rlike '[a-zA-Z]{3}'").collect()}
    assert len(real & set(kept)) >= 0.995 * len(real)


def test_near_duplicate_stage_keeps_one_row_of_a_group(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in ("alpha", "beta", "gamma"))
    rows = [(3, a, "en", "s", 1), (3, a, "en", "s", 1), (None, a, "en", "s", 1), (2, b, "en", "s", 1), (3, b, "en", "s", 1),
            (None, c, "en", "s", 1), (None, c, "en", "t", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, df, SF).collect()), key=lambda r: r[1])
    assert got == [(3, a), (2, b), (None, c)]
