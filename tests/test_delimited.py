"""Quoted line breaks across splits: equal to reading each file in one task, whatever the splits."""

import random

import pytest
from pyspark.sql import functions as F

from kiteloom.sources import delimited, readers

PIECES = ["a", "bc", '"', '""', "\t", "\n", "\r\n", "é", "漢", " ", "NA", ",", "x y"]


def sound_cell(rng):
    text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 6)))
    quoted = rng.random() < 0.4 or any(c in text for c in '"\t\n\r')
    return '"' + text.replace('"', '""') + '"' if quoted else text


def made_file(rng, rows, columns=3):
    end = rng.choice(["\n", "\r\n"])
    lines = ["\t".join(f"c{i}" for i in range(columns))]
    for _ in range(rows):
        lines.append("\t".join([f"k{rng.randint(0, 99)}", *(sound_cell(rng) for _ in range(columns - 1))]))
        if rng.random() < 0.05:
            lines.append("")
    return end.join(lines) + (end if rng.random() < 0.5 else "")


def one_task(spark, path, columns):
    """Each file by Spark's own reader, in one task a file."""
    raw = spark.read.options(sep="\t", quote='"', escape='"', multiLine=True, header=True, inferSchema=False).csv(str(path))
    return [tuple(v or "" for v in r) for r in raw.collect()]


@pytest.fixture
def splits_of(spark):
    names = {"spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"}
    before = {n: spark.conf.get(n) for n in names}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("seed", range(3))
def test_any_split_equals_one_task(spark, tmp_path, splits_of, seed):
    rng = random.Random(seed)
    path = tmp_path / "a.tsv"
    path.write_bytes(made_file(rng, 60).encode())
    want = one_task(spark, path, 3)
    size = path.stat().st_size
    for step in (size + 1, size // 3, 90):
        splits_of(step)
        rows = readers.read_delimited(spark, path).orderBy("raw_row_number").collect()
        assert [r.raw_row_number for r in rows] == list(range(2, len(want) + 2))
        assert [tuple(r)[:3] for r in rows] == want


def test_many_tasks_read_one_file(spark, tmp_path, splits_of):
    path = tmp_path / "a.tsv"
    path.write_bytes(("id\ttext\n" + "".join(f'{i}\t"line\n""{i}""\n\n\tend"\n' for i in range(3000))).encode())
    splits_of(4096)
    records = delimited.quoted_records(spark, str(path), "\t")
    found = records.withColumn("task", F.spark_partition_id())
    assert found.select("task").distinct().count() >= 10
    rows = readers.read_delimited(spark, path).orderBy("raw_row_number").collect()
    assert [(r.id, r.text, r.raw_row_number) for r in rows] == [(str(i), f'line\n"{i}"\n\n\tend', i + 2) for i in range(3000)]


def test_records_over_many_splits_and_files(spark, tmp_path, splits_of):
    folder = tmp_path / "parts"
    folder.mkdir()
    long = "\n".join(f"line {i} \"x\"" for i in range(300))
    quoted = '"' + long.replace('"', '""') + '"'
    (folder / "a.tsv").write_text(f'id\ttext\n1\t{quoted}\n2\tshort\n')
    (folder / "b.tsv").write_text("id\ttext\n")  # a header alone
    (folder / "c.tsv").write_text(f"id\ttext\n3\t{quoted}")
    (folder / "d.tsv").write_text('id\ttext\n4\t"never closed\n5\tx\n\n6')
    for step in (1 << 20, 500, 64):
        splits_of(step)
        rows = readers.read_delimited(spark, folder).orderBy("raw_row_number").collect()
        assert [(r.id, r.text, r.raw_row_number) for r in rows] == [("1", long, 2), ("2", "short", 3), ("3", long, 4), ("4", "never closed\n5\tx\n\n6", 5)]


def test_stray_quotes_and_other_separators(spark, tmp_path, splits_of):
    path = tmp_path / "a.csv"
    text = 'a,b,c\n5" pipe,x"y,z\n"q,""r""",s"t"\n,"",""""\nx,"""",\n"l\nm","n\n",o\n'
    path.write_text(text)
    raw = spark.read.options(sep=",", quote='"', escape='"', multiLine=True, header=True).csv(str(path))
    want = [tuple(v or "" for v in r) for r in raw.collect()]
    for step in (1000, 25, 9):
        splits_of(step)
        got = readers.read_delimited(spark, path, sep=",").orderBy("raw_row_number").collect()
        assert [tuple(r)[:3] for r in got] == want


def test_more_splits_than_are_broadcast(spark, tmp_path, splits_of, monkeypatch):
    monkeypatch.setattr(delimited, "SPLITS", 3)
    rng = random.Random(9)
    path = tmp_path / "a.tsv"
    path.write_bytes(made_file(rng, 80).encode())
    want = one_task(spark, path, 3)
    splits_of(120)
    got = readers.read_delimited(spark, path).orderBy("raw_row_number").collect()
    assert [tuple(r)[:3] for r in got] == want


def test_byte_order_mark_and_nothing(spark, tmp_path):
    (tmp_path / "a.tsv").write_bytes('﻿"i\nd"\tt\n1\tx\n'.encode())
    rows = readers.read_delimited(spark, tmp_path / "a.tsv", encoding="utf-8-sig").collect()
    assert [tuple(r) for r in rows] == [("1", "x", 2)]
    (tmp_path / "b.tsv").write_text("id\ttext\n")
    assert readers.read_delimited(spark, tmp_path / "b.tsv").count() == 0
