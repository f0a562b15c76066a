"""Removal of long repeated byte strings by suffix arrays.

A suffix array of all text would sort every position. Two exact steps come
before it, so that only text around the ends of repeats is sorted:

1. Every window of ``length`` bytes is owned by its anchor, the least of the
   hashed 32-byte strings in it, the leftmost of equal ones. Equal windows have
   equal anchors at equal places. So text is cut into spans, the windows of one
   anchor, and a window repeats only within the spans of one anchor string.
2. A span that occurs again as a whole repeats in all its windows. An anchor
   string with one distinct span repeats in none but these.

What is left, distinct spans that share an anchor string, is sorted by the
difference-cover algorithm in each task, and neighbours in that order that agree
in ``length`` bytes are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, few, id_and_text, raw_texts, schema_of, slices

#: Bytes of the strings that anchors are chosen from: a power of two.
GRAM = 32


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose low bits depend on all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every ``size`` bytes, from those of half the size."""
    h, width = _mixed(data.astype(np.uint64) + np.uint64(1)), 1
    while width < size:
        h = _mixed(h[:-width] * np.uint64(0x9E3779B97F4A7C15) + h[width:])
        width *= 2
    return h


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row, from least values up to and from block borders."""
    n = len(x)
    blocks = -(-n // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    grid = full.reshape(blocks, width)
    upto = np.minimum.accumulate(grid, axis=1).ravel()
    since = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(since[: n - width + 1], upto[width - 1 : n])


def spans_of(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, span hash, first window, windows) of a text's spans; of none if it is shorter than ``length``."""
    if len(data) < length:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    grams = gram_hashes(data)
    if len(grams) >> 32:
        raise ValueError("texts of 4 GB and more aren't supported")
    ranked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_sliding_least(ranked, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    count = np.diff(np.r_[first, len(anchor)])
    place = anchor[first]
    # A span is hashed by where its anchor stands in it, its size and its bytes: grams that cover it, folded in order.
    ends = first + count - 1 + length
    whole = _mixed((place - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + count.astype(np.uint64))
    for at in range(0, 2 * length - GRAM, GRAM):
        here = np.minimum(first + at, ends - GRAM)
        whole = _mixed(whole * np.uint64(0x9E3779B97F4A7C15) + grams[here])
    return grams[place], whole, first, count


def _anchor_rows(length: int):
    names = ["doc", "anchor", "span", "first", "windows"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            found = [spans_of(np.frombuffer(t, np.uint8), length) for t in raw_texts(batch.column(1))]
            row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            columns = [np.concatenate([f[i] for f in found]) for i in range(4)]
            arrays = [pa.array(columns[0].view(np.int64)), pa.array(columns[1].view(np.int64)), *(pa.array(c.astype(np.int32)) for c in columns[2:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *arrays], names=names)

    return run


# The difference-cover algorithm: positions whose number isn't a multiple of 3 are the sample.


def _order(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of rows of small keys, the first the most significant; where a row in that order differs from the one before)."""
    base = max(int(k.max()) for k in keys) + 1
    if base ** len(keys) < 1 << 63:
        packed = keys[0].astype(np.int64)
        for k in keys[1:]:
            packed = packed * base + k
        order = np.argsort(packed)
        packed = packed[order]
        return order, packed[1:] != packed[:-1]
    order = np.lexsort(keys[::-1])
    return order, np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])


def _names(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorts rows of keys; (order, name of each row, number of names), names from 1."""
    order, fresh = _order(*keys)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.r_[1, np.cumsum(fresh) + 1]
    return order, rank, int(fresh.sum()) + 1


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The order of all suffixes of ``s``, values from 1: sampled triples are sorted and named, names are sorted by recursion, the rest is merged."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    pad = np.r_[s.astype(np.int64), 0, 0, 0, 0]
    ones = np.arange(1, n + (n % 3 == 1), 3)  # a suffix of nothing but padding ends the first half, where its triples would run into the second
    twos = np.arange(2, n, 3)
    sample = np.r_[ones, twos]
    order, name, distinct = _names(pad[sample], pad[sample + 1], pad[sample + 2])
    if distinct < len(sample):
        order = suffix_array(name)
        name = np.empty(len(sample), np.int64)
        name[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = name
    rank[n:] = 0
    sampled = sample[order]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    rest = rest[_order(pad[rest], rank[rest + 1])[0]]
    return _merged(pad, rank, sampled, rest)


def _merged(pad: np.ndarray, rank: np.ndarray, sampled: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Places each of the rest among the sampled suffixes.

    Against a sampled suffix one past a multiple of 3 a character and the rank of
    what follows decide, against one two past it two characters and a rank.
    """
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    base, ranks = int(pad.max()) + 1, len(rank)
    if base * base * ranks >= 1 << 63:
        raise ValueError("too long a text for packed keys")
    by_one = lambda i: pad[i] * ranks + rank[i + 1]
    by_two = lambda i: (pad[i] * base + pad[i + 1]) * ranks + rank[i + 2]
    at = np.searchsorted(by_one(ones), by_one(rest)) + np.searchsorted(by_two(twos), by_two(rest)) + np.arange(len(rest))
    out = np.empty(len(sampled) + len(rest), np.int64)
    taken = np.ones(len(out), bool)
    taken[at] = False
    out[at], out[taken] = rest, sampled
    return out


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text the places whose ``length`` bytes also begin at another place of these texts. Shorter and empty texts have none; equal texts find each other."""
    marks = [np.zeros(0, np.int64) for _ in texts]
    if not texts:
        return marks
    # Every text ends in a separator; what follows one is never compared, as no window reaches over its end.
    sizes = np.array([len(t) for t in texts])
    starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    data = np.zeros(int((sizes + 1).sum()), np.int64) + 1
    for t, at in zip(texts, starts):
        data[at : at + len(t)] = np.frombuffer(t, np.uint8).astype(np.int64) + 2
    order = suffix_array(data)
    owner = np.searchsorted(starts, order, side="right") - 1
    whole = order + length <= starts[owner] + sizes[owner]
    order = order[whole]
    if len(order) < 2:
        return marks
    alike = np.zeros(len(order) - 1, bool)
    packed = data.astype(np.uint16)
    alike[:] = True
    for at in (length - 1, length // 2):  # most neighbours differ at one of these
        alike &= packed[order[:-1] + at] == packed[order[1:] + at]
    view, asked = np.lib.stride_tricks.sliding_window_view(packed, length), np.flatnonzero(alike)
    for at in range(0, len(asked), 1 << 13):
        some = asked[at : at + (1 << 13)]
        alike[some] = (view[order[some]] == view[order[some + 1]]).all(axis=1)
    hit = np.sort(order[np.r_[alike, False] | np.r_[False, alike]])
    owner = np.searchsorted(starts, hit, side="right") - 1
    for k in np.unique(owner):
        marks[k] = hit[owner == k] - starts[k]
    return marks


def _repeats(length: int, batch_bytes: int = 1 << 19):
    """Sorted rows (anchor, text, id, first) to repeated runs (id, low, high), anchor by anchor."""

    def runs(rows: list[tuple]) -> pa.RecordBatch:
        out: list[tuple] = []
        for (_, _, doc, first), places in zip(rows, repeated_windows([r[1] for r in rows], length)):
            if len(places):
                cut = np.flatnonzero(np.diff(places) > 1)
                for lo, hi in zip(places[np.r_[0, cut + 1]], places[np.r_[cut, len(places) - 1]]):
                    out.append((doc, int(first + lo), int(first + hi + length)))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), *(pa.array([r[i] for r in out], pa.int32()) for i in (1, 2))], names=["doc", "low", "high"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > batch_bytes and row[0] != held[-1][0]:
                    yield runs(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[1])
        if held:
            yield runs(held)

    return run


def _cut_out(length: int):
    """(doc, text, spans of (anchor, first, windows)) to (anchor, bytes, doc, first)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 << 20):
            out: list[tuple] = []
            for doc, raw, wanted in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), batch.column(2).to_pylist()):
                out += [(w["anchor"], raw[w["first"] : w["first"] + w["windows"] - 1 + length], doc, w["first"]) for w in wanted]
            types = (pa.int64(), pa.binary(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["anchor", "bytes", "doc", "first"])

    return run


def _kept(id_col: str):
    """(id, text, runs) to the row's result: the union of the runs is taken out."""

    def one(raw: bytes, runs: list[dict]) -> tuple[int, int, int, str]:
        keep, removed, spans, at = [], 0, 0, 0
        reach = -1
        for low, high in sorted((r["low"], r["high"]) for r in runs):
            if low > reach:
                keep.append(raw[at:low])
                spans += 1
                removed += high - low
                at = reach = high
            elif high > reach:
                removed += high - reach
                at = reach = high
        keep.append(raw[at:])
        return len(raw), removed, spans, hashlib.sha256(b"".join(keep)).hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            done = [one(*x) for x in zip(raw_texts(batch.column(1)), batch.column(2).to_pylist())]
            arrays = [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _window_rows(length: int):
    """(anchor, bytes, doc, first) to a row for each window: (a, b, doc, first), a and b a digest of 128 bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 17):
            out: list[list[np.ndarray]] = [[], [], [], []]
            for raw, doc, first in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                grams = gram_hashes(np.frombuffer(raw, np.uint8))
                n = len(raw) - length + 1
                a, b = np.zeros(n, np.uint64), np.full(n, 7, np.uint64)
                for at in (*range(0, length - GRAM, GRAM), length - GRAM):
                    a = _mixed(a * np.uint64(0x9E3779B97F4A7C15) + grams[at : at + n])
                    b = _mixed(b * np.uint64(0xC2B2AE3D27D4EB4F) + (grams[at : at + n] ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                for column, x in zip(out, (a.view(np.int64), b.view(np.int64), np.full(n, doc), first + np.arange(n))):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["a", "b", "doc", "first"])

    return run


def _named_texts(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, text, doc), doc naming the text, and the written table (id, doc, sha256, n_bytes).

    doc is a 64-bit hash, under a salt for which no two different texts share one.
    """
    for salt in range(16):
        own = id_and_text(df, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.lit(salt), text_col).alias("doc"))
        table = Table(own.select("id", "doc", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes")), "texts", narrow=True).df
        clash = table.groupBy("doc").agg(F.min("sha256").alias("l"), F.max("sha256").alias("m")).where("l <> m")
        if clash.isEmpty():
            return own, table
    raise RuntimeError("no salt keeps all texts apart")


def remove_repeats(df: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", group_limit: int = 20_000) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256): each text without the bytes of repeated strings.

    A byte goes if a string of ``length`` UTF-8 bytes over it also begins at
    another place of any text, its own included, in the input as it is. n_spans
    counts the removed runs, kept_sha256 is the digest of the other bytes.

    Spans are counted by anchor and content, so copies meet as counts. Those that
    stay (one of each content) go to the task of their anchor, are sorted there
    by suffixes and compared; groups of more than ``group_limit`` spans go by the
    128-bit digests of their windows instead, which spreads them over all tasks.
    A null text counts as empty; repeated rows are repeats of each other; null
    ids pass through; an empty table gives none; other columns are ignored.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    own, table = _named_texts(df, id_col, text_col)
    copies = table.groupBy("doc").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    again = Table(copies.where("n > 1"), "copies").df
    spans = own.select("doc", "text").mapInArrow(_anchor_rows(length), "doc long, anchor long, span long, first int, windows int")
    spans = Table(spans, "spans").df
    shared = spans.groupBy("anchor").count().where("count > 1").select("anchor")
    spans = Table(spans.join(shared, "anchor", "left_semi"), "shared").df
    place = F.min(F.struct("doc", "first", "windows")).alias("at")
    distinct = Table(spans.groupBy("anchor", "span").agg(F.count("*").alias("n"), place), "distinct").df

    whole = spans.join(distinct.where("n > 1").select("anchor", "span"), ["anchor", "span"], "left_semi")
    whole = whole.select("doc", F.col("first").alias("low"), (F.col("first") + F.col("windows") - 1 + length).alias("high"))

    groups = distinct.groupBy("anchor").count().where("count > 1").select("anchor", (F.col("count") > group_limit).alias("large"))
    wanted = distinct.join(groups, "anchor").select("anchor", "at.*", "large")
    lists = Table(wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "first", "windows", "large")).alias("wanted")), "wanted").df
    one_row = lists.select("doc").join(copies.select("doc", "id"), "doc")
    texts = own.join(few(one_row), own["doc"].eqNullSafe(one_row["doc"]) & own["id"].eqNullSafe(one_row["id"]), "left_semi")
    texts = texts.select("doc", "text").join(lists, "doc")

    def cut(large: bool) -> DataFrame:
        part = texts.select("doc", "text", F.filter("wanted", lambda x: x["large"] == large).alias("wanted")).where(F.size("wanted") > 0)
        return part.mapInArrow(_cut_out(length), "anchor long, bytes binary, doc long, first int")

    runs = cut(False).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_repeats(length), "doc long, low int, high int")
    if not groups.where("large").isEmpty():
        windows = Table(cut(True).mapInArrow(_window_rows(length), "a long, b long, doc long, first int"), "windows").df
        met = windows.join(windows.groupBy("a", "b").count().where("count > 1").select("a", "b"), ["a", "b"], "left_semi")
        runs = runs.union(met.select("doc", F.col("first").alias("low"), (F.col("first") + length).alias("high")))
    found = whole.union(runs).join(again.select("doc"), "doc", "left_anti")
    found = Table(found.groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("runs")), "runs").df

    touched = own.join(few(found.select("doc")), "doc", "left_semi").join(found, "doc").select(F.col("id").alias(id_col), "text", "runs")
    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    done = touched.mapInArrow(_kept(id_col), schema_of(touched, id_col, fields))
    rest = table.join(found.select("doc"), "doc", "left_anti").join(again.select("doc", "n"), "doc", "left")
    gone = F.col("n").isNotNull() & (F.col("n_bytes") >= length)
    rest = rest.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.lit(0)).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.col("sha256")).alias("kept_sha256"),
    )
    return done.union(rest)


#: Every window of 200 bytes, counted; the runs that repeated windows cover; what lies between those runs.
REMOVED_SQL = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, encode(COALESCE(text, '')) AS b FROM documents),
n AS (SELECT k, doc_id, b, octet_length(b)::BIGINT AS n_bytes FROM d),
w AS (SELECT k, s, md5(b[s + 1 : s + 200]) AS m FROM (SELECT k, b, unnest(range(0, n_bytes - 199)) AS s FROM n WHERE n_bytes >= 200)),
r AS (SELECT k, s FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
g AS (SELECT k, s, sum(new) OVER (PARTITION BY k ORDER BY s) AS run
      FROM (SELECT k, s, CASE WHEN s - lag(s) OVER (PARTITION BY k ORDER BY s) <= 200 THEN 0 ELSE 1 END AS new FROM r)),
runs AS (SELECT k, min(s)::BIGINT AS a, max(s)::BIGINT + 200 AS e FROM g GROUP BY k, run),
cuts AS (SELECT k, a, e, lag(e, 1, 0) OVER (PARTITION BY k ORDER BY a) AS since FROM runs),
kept AS (SELECT c.k, count(*)::BIGINT AS n_spans, sum(e - a)::BIGINT AS n_removed, max(e) AS last,
                string_agg(CASE WHEN a > since THEN hex(b[since + 1 : a]) ELSE '' END, '' ORDER BY a) AS front
         FROM cuts c JOIN n ON c.k = n.k GROUP BY c.k)
SELECT doc_id, n_bytes, COALESCE(n_removed, 0)::BIGINT AS n_removed, COALESCE(n_spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN n_spans IS NULL THEN b
              WHEN last < n_bytes THEN unhex(front || hex(b[last + 1 : n_bytes]))
              ELSE unhex(front) END) AS kept_sha256
FROM n LEFT JOIN kept ON n.k = kept.k
"""
