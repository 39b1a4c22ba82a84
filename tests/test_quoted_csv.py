"""Split reading of quoted CSV: equal to the one-task read, whatever the splits."""

from __future__ import annotations

import csv
import io
import random

import pytest

from marketlens.schema import table_schema
from marketlens.sources.files import read_csv
from marketlens.sources.quoted import read_quoted


def conf(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.fixture
def splits(spark):
    yield lambda size: conf(spark, size)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def text_of(rows, end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["id", "note", "n"])
    writer.writerows(rows)
    return out.getvalue()


def generated(n, seed=1):
    rng = random.Random(seed)
    bits = ["plain", 'say ""', 'a "b" c', "one\ntwo", "\n", "x,y", "é", "\n\n\"q\"\n", "end\r\nof", "", '"', "tab\t", "a" * 30]
    return [[str(i), "".join(rng.choice(bits) for _ in range(rng.randint(0, 4))), str(rng.randint(0, 9))] for i in range(n)]


def got(df):
    return sorted((r.id, r.note or "", r.n) for r in df.collect())


@pytest.mark.parametrize("size,end", [("64", "\n"), ("257", "\r\n"), ("1k", "\n")])
def test_any_split_gives_the_records(spark, tmp_path, splits, size, end):
    rows = generated(60)
    (tmp_path / "a.csv").write_bytes(text_of(rows[:35], end).encode())
    (tmp_path / "b.csv").write_bytes(text_of(rows[35:], end).encode())
    splits(size)
    df = read_quoted(spark, str(tmp_path), ["id", "note", "n"])
    assert got(df) == sorted(map(tuple, rows))


def test_quoted_file_is_read_by_several_tasks_and_equals_the_one_task_read(spark, tmp_path, splits):
    rows = generated(20_000, seed=2)
    path = tmp_path / "big.csv"
    path.write_bytes(text_of(rows).encode())
    whole = spark.read.options(header="true", escape='"', multiLine="true").csv(str(path))
    assert whole.rdd.getNumPartitions() == 1
    want = got(whole)
    splits("64k")
    df = read_csv(spark, str(path), multi_line=True)
    assert df.rdd.getNumPartitions() > 4
    assert got(df) == want
    assert df.select("n").count() == 20_000


def test_a_field_longer_than_several_splits(spark, tmp_path, splits):
    long = "word\n" * 2_000
    rows = [["1", "a", "1"], ["2", long, "2"], ["3", 'x\n"y"', "3"], ["4", long + '"', "4"]]
    (tmp_path / "a.csv").write_bytes(text_of(rows).encode())
    splits("1k")
    assert got(read_quoted(spark, str(tmp_path), ["id", "note", "n"])) == sorted(map(tuple, rows))


def test_empty_quoted_null_and_blank_lines(spark, tmp_path, splits):
    (tmp_path / "a.csv").write_text('id,note,n\n1,,x\n\n2,"",y\n3,"a\n\nb",z')
    splits("8")
    want = [("1", None, "x"), ("2", None, "y"), ("3", "a\n\nb", "z")]      # as the one-task read has them
    assert sorted(map(tuple, spark.read.options(header="true", escape='"', multiLine="true").csv(str(tmp_path)).collect())) == want
    assert sorted(map(tuple, read_quoted(spark, str(tmp_path), ["id", "note", "n"]).collect())) == want


def test_bad_files_raise(spark, tmp_path, splits):
    (tmp_path / "open").mkdir()
    (tmp_path / "open" / "a.csv").write_text('id,note,n\n1,"never closed,2\n')
    with pytest.raises(ValueError, match="not closed"):
        read_quoted(spark, str(tmp_path / "open"), ["id", "note", "n"])
    (tmp_path / "head").mkdir()
    (tmp_path / "head" / "a.csv").write_text("id,n,note\n1,2,3\n")
    with pytest.raises(Exception, match="header"):
        read_quoted(spark, str(tmp_path / "head"), ["id", "note", "n"]).collect()
    (tmp_path / "long").mkdir()
    (tmp_path / "long" / "a.csv").write_text("id,note,n\n1,2\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_quoted(spark, str(tmp_path / "long"), ["id", "note", "n"]).collect()


def test_changed_splits_raise_and_do_not_misread(spark, tmp_path, splits):
    (tmp_path / "a.csv").write_bytes(text_of(generated(200)).encode())
    splits("500")
    df = read_quoted(spark, str(tmp_path), ["id", "note", "n"])
    splits("300")
    with pytest.raises(Exception, match="measured"):
        df.collect()


def test_reviews_with_line_breaks_are_typed(spark, tmp_path, splits):
    lines = ["order_id,review_id,review_score,review_comment_message"]
    lines += [f'o{i},r{i},{i % 5 + 1},"line one\nline ""two"", {i}"' for i in range(3_000)]
    (tmp_path / "r.csv").write_text("\n".join(lines) + "\n")
    splits("8k")
    df = read_csv(spark, str(tmp_path / "r.csv"), table_schema("order_reviews"))
    assert df.rdd.getNumPartitions() > 2
    r = df.where("review_id = 'r1234'").first()
    assert (r.order_id, r.review_score, r.review_comment_message) == ("o1234", 5, 'line one\nline "two", 1234')
    assert df.count() == 3_000
