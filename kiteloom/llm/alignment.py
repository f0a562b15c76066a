"""Two tokenizers' tokens laid side by side: groups between common ends, and how often ids overlap."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table, id_and_text, releasing, schema_of, slices
from .packing import Encoder
from .tokencount import SPACE, commonest
from .transducer import byte_names

#: A place that both tokenizers cut at: before a space between two other characters.
_CUT = re.compile(f"[^\\s{SPACE}] (?=[^\\s{SPACE}])")


class Pair:
    """Tokenizers A, byte-level BPE of space + text, and B, sentence pieces of text, whose model puts the space in front."""

    def __init__(self, a_file: str, b_file: str, a_ranks: str | None = None) -> None:
        import sentencepiece

        self.a = Encoder(a_file, a_ranks)
        self.a.slow.encode_special_tokens = True
        self.a.special = []
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        with open(a_file, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_names())}
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(map(byte_of.__getitem__, token))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("the vocabulary has pieces across spaces, so long texts can't be cut there")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        number = lambda n, mark: np.array([b"%d%c" % (i, mark) for i in range(n)], object)
        #: Ids in decimal with what stands behind them: inside a group, and at the end of their side of it.
        self.a_texts = [number(len(self.a_bytes), mark) for mark in b",|"]
        self.b_texts = [number(len(self.b_bytes), mark) for mark in b",;"]

    def pieces(self, text: str, size: int = 1 << 19) -> list[str]:
        """Space + text, cut where both tokenizers cut, into parts of about ``size`` characters that begin with a space."""
        text, out, at = " " + text, [], 0
        while len(text) - at > size and (cut := _CUT.search(text, at + size)):
            out.append(text[at : cut.end() - 1])
            at = cut.end() - 1
        return [*out, text[at:]]

    def encode(self, parts: list[str]) -> list[tuple[bool, np.ndarray, np.ndarray]]:
        """Of each part, which begins with a space, whether the bytes of both sides are the part's, and the ids of A and of B."""
        out = []
        for part, b in zip(parts, self.b.encode([p[1:] for p in parts], num_threads=1)):
            raw, a = part.encode(), self.a.encode(part)
            sound = b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw == b"".join(map(self.b_bytes.__getitem__, b))
            out.append((sound, a.astype(np.int64), np.fromiter(b, np.int64, len(b))))
        return out


@lru_cache(maxsize=2)
def pair(a_file: str, b_file: str, a_ranks: str | None) -> Pair:
    return Pair(a_file, b_file, a_ranks)


class Aligned:
    """The tokens of many texts, one after the other, cut where tokens of A and of B both end.

    ``a`` and ``b`` are the ids of all texts, ``ends`` where each text's bytes
    end. One count of ends for each side marks the bytes after which a token of A
    (1), of B (2) or of both (3) ends. Between two marks lies what one token of A
    and one of B have in common, so marks are links; those of both are groups.
    Running sums of the marks give each mark its tokens, and their values at
    ``ends`` split everything by text.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, ends: np.ndarray) -> None:
        total = int(ends[-1])
        marks = np.bincount(np.cumsum(a_sizes[a]), minlength=total + 1) + 2 * np.bincount(np.cumsum(b_sizes[b]), minlength=total + 1)
        places = np.flatnonzero(marks)
        kind = marks[places]
        self.a, self.b = a, b
        ends_a, ends_b, ends_both = (kind & 1).astype(bool), kind >= 2, kind == 3
        self.link_a, self.link_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b  # of each link, which token
        group = np.cumsum(ends_both) - ends_both
        self.group_a, self.group_b = group[ends_a], group[ends_b]  # of each token, its group
        at = np.searchsorted(places, ends, "right")
        sums = lambda x: np.r_[0, np.cumsum(x)][at]
        #: Up to each text's end: links, tokens of A, tokens of B, groups.
        self.links, self.n_a, self.n_b, self.groups = at, sums(ends_a), sums(ends_b), sums(ends_both)

    def written(self, of: Pair) -> np.ndarray:
        """All tokens in the order of groups, A before B, as text with what stands behind each."""
        groups = int(self.groups[-1])
        in_a, in_b = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        out = np.empty(len(self.a) + len(self.b), object)
        place_a = np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[self.group_a]
        out[place_a] = np.where(self._last(self.group_a), of.a_texts[1][self.a], of.a_texts[0][self.a])
        out[np.arange(len(self.b)) + np.cumsum(in_a)[self.group_b]] = np.where(self._last(self.group_b), of.b_texts[1][self.b], of.b_texts[0][self.b])
        return out

    @staticmethod
    def _last(group: np.ndarray) -> np.ndarray:
        return np.r_[group[1:] != group[:-1], True] if len(group) else np.zeros(0, bool)


class _Row:
    """What is known of one text so far."""

    def __init__(self) -> None:
        self.sound, self.counts, self.digest, self.held, self.pairs = True, np.zeros(4, np.int64), hashlib.sha256(), b"", []

    def add(self, counts: np.ndarray, groups: bytes, keys: np.ndarray, times: np.ndarray) -> None:
        self.counts += counts
        self.digest.update(self.held + groups[:-1])
        self.held = groups[-1:]  # nothing stands behind the last group
        self.pairs.append((keys, times))
        if sum(len(k) for k, _ in self.pairs[1:]) > len(self.pairs[0][0]):
            self.pairs = [self.distinct()]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pairs) == 1:
            return self.pairs[0]
        keys, at = np.unique(np.concatenate([k for k, _ in self.pairs]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([t for _, t in self.pairs])).astype(np.int64)


def _blocks(of: Pair, texts: list[str], size: int = 1 << 19) -> Iterator[list[tuple[int, str]]]:
    """(row, part) of all parts of all texts, in blocks of about ``size`` characters."""
    block, held = [], 0
    for row, text in enumerate(texts):
        for part in of.pieces(text, size) if text else []:
            block.append((row, part))
            held += len(part)
            if held >= size:
                yield block
                block, held = [], 0
    if block:
        yield block


def aligned_rows(of: Pair, texts: list[str]) -> list[_Row]:
    """Counts, digest and distinct pairs of each text; nothing for empty ones and those whose bytes a side doesn't give back."""
    rows = [_Row() for _ in texts]
    width = len(of.b_bytes)
    for block in _blocks(of, texts):
        found = of.encode([part for _, part in block])
        for (row, _), (sound, _, _) in zip(block, found):
            rows[row].sound &= sound
        kept = [(row, a, b) for (row, _), (_, a, b) in zip(block, found) if rows[row].sound]
        if not kept:
            continue
        a, b = (np.concatenate([x[i] for x in kept]) for i in (1, 2))
        laid = Aligned(a, b, of.a_sizes, of.b_sizes, np.cumsum([int(of.a_sizes[x].sum()) for _, x, _ in kept]))
        written = laid.written(of).tolist()
        upto = np.c_[laid.n_a, laid.n_b, laid.groups, laid.links]
        counts = np.diff(upto, axis=0, prepend=np.zeros((1, 4), np.int64))
        key = a[laid.link_a] * width + b[laid.link_b]
        part = np.repeat(np.arange(len(kept)), counts[:, 3])
        both, times = np.unique(part * (len(of.a_bytes) * width) + key, return_counts=True)
        keys, cuts = both % (len(of.a_bytes) * width), np.searchsorted(both, np.arange(len(kept) + 1) * (len(of.a_bytes) * width))
        at = 0
        for i, (row, own_a, own_b) in enumerate(kept):
            n = len(own_a) + len(own_b)
            rows[row].add(counts[i], b"".join(written[at : at + n]), keys[cuts[i] : cuts[i + 1]], times[cuts[i] : cuts[i + 1]])
            at += n
    return [row if row.sound and row.pairs else _Row() for row in rows]


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.r_[0, np.cumsum([len(p) for p in parts])]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]), pa.int64()).cast(kind))


def alignments(df: DataFrame, a_file: str, b_file: str, a_ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, keys, times) for every row.

    Both tokenizers' ids of space + text are laid over its bytes. A group ends
    where tokens of both end; a link is a token of A and one of B that share
    bytes. keys are the distinct linked id pairs, a * (size of B) + b, in order,
    times how often each is linked. groups_sha256 is of `a1,a2|b1;a3|b2,b3`, ids
    in decimal. Special tokens' strings are plain text.

    Null and empty texts, and texts that either side doesn't give back byte by
    byte (B writes U+2581 as a space), have zeros, no keys and the digest ''.
    Repeated rows, null ids and empty tables pass through; other columns are
    ignored. Long texts are taken in parts, cut where both tokenizers cut. The
    files must be on every executor.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pair(a_file, b_file, a_ranks)
        for batch in slices(batches, 1 << 20):
            rows = aligned_rows(of, batch.column(1).to_pylist())
            counts = np.array([r.counts for r in rows]).T
            pairs = [r.distinct() if r.pairs else (np.zeros(0, np.int64),) * 2 for r in rows]
            digests = [r.digest.hexdigest() if r.pairs else "" for r in rows]
            lists = [_lists([p[0] for p in pairs], pa.int64()), _lists([p[1] for p in pairs], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(digests, pa.string()), *lists], names=[id_col, *_COUNTS, "groups_sha256", "keys", "times"])

    fields = ", ".join(f"{c} long" for c in _COUNTS) + ", groups_sha256 string, keys array<bigint>, times array<int>"
    return id_and_text(df, id_col, text_col).mapInArrow(releasing(run), schema_of(df, id_col, fields))


def pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """(key, n, best): how many links of all ``rows`` (keys, times) hold a pair, and whether no pair of its B id has more.

    Counts are combined in each task before they move, and so is each B id's greatest.
    """
    each = rows.select(F.explode(F.arrays_zip("keys", "times")).alias("p")).groupBy(F.col("p.keys").alias("key")).agg(F.sum(F.col("p.times").cast("long")).alias("n"))
    table = Table(each, "pairs", narrow=True).df
    b = F.col("key") % b_size
    most = table.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return table.join(most, b == F.col("b")).select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def link_counts(rows: DataFrame, b_size: int, most: int = 1 << 20) -> DataFrame:
    """``rows`` of ``alignments`` with n_best and count_sum in place of keys and times.

    count_sum adds up, over a text's links, how often their pair is linked in
    all rows; n_best counts the links whose pair is the commonest of its B id,
    ties included. The ``most`` commonest pairs at most (17 bytes each) are sent
    to all tasks, which look up most links in place; the others, which are
    spread over many keys of few rows, are joined by a shuffle.
    """
    spark = rows.sparkSession
    rows = Table(rows.withColumn("row", F.monotonically_increasing_id()), "aligned").df
    table = Table(pair_counts(rows, b_size), "counted", narrow=True).df
    least = commonest(table.withColumnRenamed("n", "seen"), most)
    common = table.where(F.col("n") >= least).toArrow().sort_by("key")
    looked_up = spark.sparkContext.broadcast(tuple(common.column(c).to_numpy() for c in ("key", "n", "best")))
    kept = [c for c in rows.columns if c not in ("keys", "times")]
    entry = pa.list_(pa.struct([("key", pa.int64()), ("times", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = looked_up.value
        for batch in slices(batches, 8 << 20):
            lists = batch.column("keys")
            keys, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            ends = np.cumsum(lists.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            met = known[at] == keys if len(known) else np.zeros(len(keys), bool)
            sums = lambda x: np.diff(np.r_[0, np.cumsum(x)][np.r_[0, ends]])
            n_best, total = (sums(np.where(met, times * x[at], 0)) if len(known) else sums(np.zeros(len(keys), np.int64)) for x in (best, n))
            left = pa.StructArray.from_arrays([pa.array(keys[~met]), pa.array(times[~met])], ["key", "times"])
            lefts = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sums(~met))], pa.int32()), left).cast(entry)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n_best), pa.array(total), lefts], names=[*kept, "n_best", "count_sum", "left"])

    fields = T.StructType.fromDDL("n_best long, count_sum long, left array<struct<key: bigint, times: bigint>>").fields
    partly = rows.select(*kept, "keys", "times").mapInArrow(releasing(run), T.StructType([*rows.select(kept).schema.fields, *fields]))
    rare = table.where(F.col("n") < least)
    if rare.isEmpty():
        whole = F.when(F.size("left") == 0, F.col("count_sum")).otherwise(F.raise_error(F.lit("a pair without a count")).cast("long"))
        return partly.withColumn("count_sum", whole).drop("left", "row")
    partly = Table(partly, "partly").df
    rest = partly.select("row", F.explode("left").alias("p")).select("row", "p.key", "p.times").join(rare, "key")
    more = rest.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.count("*").alias("met"))
    done = partly.join(more, "row", "left")
    complete = F.coalesce("met", F.lit(0)) == F.size("left")
    whole = F.when(complete, F.col("count_sum") + F.coalesce("more", F.lit(0))).otherwise(F.raise_error(F.lit("a pair without a count")).cast("long"))
    return done.withColumns({"count_sum": whole, "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0))}).drop("left", "row", "more", "more_best", "met")


def align(df: DataFrame, a_file: str, b_file: str, a_ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", most: int = 1 << 20) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) for every row: ``alignments``, then ``link_counts``."""
    import sentencepiece

    size = sentencepiece.SentencePieceProcessor(model_file=b_file).vocab_size()
    return link_counts(alignments(df, a_file, b_file, a_ranks, id_col, text_col), size, most)
