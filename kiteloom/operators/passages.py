"""Held-out passages inside documents: all places of all texts are tested against a small filter, and only what it lets through becomes rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiteloom.sources.shared import settled

#: Passages are known by one window of so many bytes, the widest that fits; shorter ones are searched for by an automaton.
WIDTHS = (32, 8)
_BASE = 0x9E3779B97F4A7C15 | 1


def window_hashes(raw: np.ndarray) -> dict[int, np.ndarray]:
    """For each of ``WIDTHS`` the polynomial hashes of all windows of some bytes: those of twice a width are two of the width put together."""
    out, have, width = {}, raw.astype(np.uint64) + np.uint64(1), 1
    power = _BASE
    with np.errstate(over="ignore"):
        while True:
            if width in WIDTHS:
                out[width] = have
            if width == max(WIDTHS):
                return out
            have = have[:-width] * np.uint64(power) + have[width:] if len(have) > width else have[:0]
            width, power = 2 * width, power * power % (1 << 64)


def _spread(hashes: np.ndarray) -> np.ndarray:
    """Polynomial hashes mixed, so that any of their bits may be taken."""
    with np.errstate(over="ignore"):
        return (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def key_of(passage: bytes) -> tuple[int, int]:
    """The width and the hash by which a passage is looked for: of its windows the one with the least hash, so that common beginnings don't count; (0, 0) for a short one."""
    width = next((w for w in WIDTHS if len(passage) >= w), 0)
    return (width, int(_spread(window_hashes(np.frombuffer(passage, np.uint8))[width]).min())) if width else (0, 0)


class Filter:
    """The keys of all passages: a table of bits, then sorted arrays; and an automaton of the short ones."""

    def __init__(self, keys: dict[int, np.ndarray], short: list[str], most_bits: int = 24) -> None:
        self.keys = {w: np.unique(k) for w, k in keys.items() if len(k)}
        bits = min(most_bits, max([10, *(len(k).bit_length() + 5 for k in self.keys.values())]))
        self.shift = np.uint64(64 - bits)
        self.table = {}
        for width, own in self.keys.items():
            self.table[width] = np.zeros(1 << bits, bool)
            self.table[width][(own >> self.shift).astype(np.int64)] = True
        self.short = short
        self.automaton: Any = None

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, key), each once: whose windows have the hash of a passage's."""
        raws = [t.encode() for t in texts]
        ends = np.cumsum([len(r) for r in raws])
        found_text, found_key = [], []
        for width, hashes in window_hashes(np.frombuffer(b"".join(raws), np.uint8)).items():
            if width not in self.keys:
                continue
            hashes = _spread(hashes)
            at = np.flatnonzero(self.table[width][(hashes >> self.shift).astype(np.int64)])
            own = hashes[at]
            place = np.minimum(np.searchsorted(self.keys[width], own), len(self.keys[width]) - 1)
            at, own = (x[self.keys[width][place] == own] for x in (at, own))
            text = np.searchsorted(ends, at, "right")
            inside = at + width <= ends[text] if len(at) else np.zeros(0, bool)
            found_text.append(text[inside])
            found_key.append(own[inside])
        if not found_text:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        both = np.unique(np.stack([np.concatenate(found_text).astype(np.uint64), np.concatenate(found_key)]), axis=1)
        return both[0].astype(np.int64), both[1]

    def short_hits(self, text: str) -> set[str]:
        """The short passages in a text."""
        if not self.short:
            return set()
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for passage in self.short:
                self.automaton.add_word(passage, passage)
            self.automaton.make_automaton()
        return {p for _, p in self.automaton.iter(text)}


def _keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item, passage) with the passage's width and key."""
    for batch in batches:
        keys = [key_of(p.encode()) for p in batch.column(1).to_pylist()]
        longs = np.array([k for _, k in keys], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([w for w, _ in keys], pa.int32()), pa.array(longs)], names=["item", "passage", "width", "key"])


def _pieces(batch: pa.RecordBatch, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def contained_passages(docs: DataFrame, held_out: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, most_keys: int = 1 << 22, most_bytes: int = 32 << 20) -> DataFrame:
    """(id, item) where a document holds a held-out passage word for word, each pair once.

    Every passage is known by the hash of one of its windows of 32 bytes, or 8 if
    it is shorter. Tasks go over all windows of their texts, tell those with a
    passage's hash from a table of bits and a sorted array, and make rows of
    these alone. Passages under 8 bytes are found by one automaton. All passages
    go to every task if they have ``most_bytes`` at most, and are compared in
    place, so nothing is shuffled but the pairs; beyond that only hashes go
    there, and pairs that they propose are joined to texts and passages and
    compared; beyond ``most_keys`` hashes or ``most_bytes`` of short passages, one pass is made
    for each share of them. Null texts and passages match nothing; an empty
    passage is in every text; rows that repeat an id are asked each, a pair
    comes once.
    """
    every = held_out.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("passage")).where("passage IS NOT NULL")
    item_type, id_type = every.schema["item"].dataType, docs.schema[id_col].dataType
    keyed = settled(every.mapInArrow(_keyed, T.StructType([T.StructField("item", item_type), *T.StructType.fromDDL("passage string, width int, key long").fields])), "passages")
    count, size = keyed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("passage")), F.lit(0))).first()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    pair = T.StructType([T.StructField("id", id_type), T.StructField("item", item_type)])
    if size <= most_bytes and count <= most_keys:
        found = _in_place(texts, keyed, pair)
    else:
        shares = max(-(-count // most_keys), -(-size // most_bytes))
        found = None
        for share in range(shares):
            part = _by_keys(texts, keyed.where(F.pmod(F.xxhash64("passage"), F.lit(shares)) == share))
            found = part if found is None else found.union(part)
    return found.distinct().select(F.col("id").alias(id_col), F.col("item").alias(item_col))


def _filter_of(table: pa.Table) -> Filter:
    """A filter of rows (passage, width, key)."""
    width, key = table.column("width").to_numpy(), table.column("key").to_numpy().view(np.uint64)
    short = [p for p, w in zip(table.column("passage").to_pylist(), width.tolist()) if not w and p]
    return Filter({w: key[width == w] for w in WIDTHS}, sorted(set(short)))


def _in_place(texts: DataFrame, keyed: DataFrame, pair: T.StructType) -> DataFrame:
    table = keyed.toArrow().combine_chunks()
    sent = texts.sparkSession.sparkContext.broadcast((table.column("item").combine_chunks(), table.column("passage").to_pylist(), _filter_of(table), table.column("key").to_numpy().view(np.uint64), table.column("width").to_numpy()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, passages, own, keys, width = sent.value
        by_key: dict[int, list[int]] = {}
        by_text: dict[str, list[int]] = {}
        for i, (k, w) in enumerate(zip(keys.tolist(), width.tolist())):
            if w:
                by_key.setdefault(k, []).append(i)
            else:
                by_text.setdefault(passages[i], []).append(i)
        empty = by_text.get("", [])
        for whole in batches:
            for batch in _pieces(whole):
                given = batch.column(1).to_pylist()
                rows, found = [], []
                for row, key in zip(*(x.tolist() for x in own.hits(given))):
                    met = [i for i in by_key[key] if passages[i] in given[row]]
                    rows += [row] * len(met)
                    found += met
                for row, text in enumerate(given) if own.short or empty else ():
                    met = empty + [i for p in own.short_hits(text) for i in by_text[p]]
                    rows += [row] * len(met)
                    found += met
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), items.take(pa.array(found, pa.int64()))], names=["id", "item"])

    return texts.mapInArrow(run, pair)


def _by_keys(texts: DataFrame, keyed: DataFrame) -> DataFrame:
    """As ``_in_place``, with passages in a table of their own: rows that the filter lets through meet them by key, then the texts of their id."""
    # Windows and short passages are known by hash, the short ones by that of their whole text.
    asked = keyed.withColumn("key", F.when(F.col("width") > 0, F.col("key")).otherwise(F.xxhash64("passage")))
    table = keyed.select(F.when(F.col("width") == 0, F.col("passage")).otherwise("").alias("passage"), "width", "key").distinct().toArrow()
    sent = texts.sparkSession.sparkContext.broadcast(_filter_of(table))
    has_empty = not keyed.where("passage = ''").isEmpty()
    has = T.StructType([texts.schema["id"], *T.StructType.fromDDL("key long, short string").fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for whole in batches:
            for batch in _pieces(whole):
                given = batch.column(1).to_pylist()
                text, key = own.hits(given)
                short = [(i, p) for i, t in enumerate(given) for p in [*own.short_hits(t), *[""] * has_empty]]
                at = np.concatenate([text, np.array([i for i, _ in short], np.int64)])
                keys = pa.array([*key.view(np.int64).tolist(), *[None] * len(short)], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), keys, pa.array([None] * len(text) + [p for _, p in short], pa.string())], names=["id", "key", "short"])

    hits = texts.mapInArrow(run, has).select(F.col("id").alias("of"), F.coalesce("key", F.xxhash64("short")).alias("key"))
    near = settled(hits.join(asked, "key").select("of", "item", "passage").distinct(), "near")
    return texts.join(near, F.col("id").eqNullSafe(F.col("of"))).where(F.contains("text", "passage")).select("id", "item")
