"""SimHash near-duplicates: fingerprints, trie self-join, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, hex64, id_and_text, kept_rows, raw_texts, schema_of, slices
from .components import components

#: Node pairs of the tries that one step of the traversal holds at once.
FRONTIER = 1 << 19


def simhash(raw: bytes, width: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a UTF-8 text; 0 if it has no word."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, seed)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    return majority(np.fromiter((digest(joined[s : e - 1], seed) for s, e in zip(starts, starts[width:])), np.uint64, len(words) - width + 1))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of 64-bit hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8)
        ones += np.unpackbits(part).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): fp holds the fingerprint's 64 bits in a signed long.

    ASCII letters are folded, shingles of ``width`` words count with repeats, a
    shorter text is one shingle; a bit is set if more than half the hashes set it.
    Null, empty and wordless texts have fingerprint 0; repeated rows and null
    ids pass through; an empty table gives none; other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = np.array([simhash(t, width) for t in raw_texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=[id_col, "fp"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, schema_of(df, id_col, "fp long"))


def _join_nodes(keys: np.ndarray, labels: np.ndarray, budget: int, bits: int) -> None:
    """Traverses all tries that lie side by side in ``keys`` with themselves.

    ``keys`` are sorted and distinct: a trie's number above ``bits`` bits. A node
    is a range of keys with a common prefix. Pairs of nodes go down together
    and add up the bits in which they differ; a pair over ``budget`` is dropped.
    ``labels`` receives the least index that each key is linked with.
    """
    tries = keys >> np.uint64(bits)
    edges = np.flatnonzero(np.r_[True, tries[1:] != tries[:-1]]) if len(keys) else np.empty(0, np.int64)
    ends = np.r_[edges[1:], len(keys)]
    many = ends - edges > 1
    lo, hi = edges[many], ends[many]
    stack = [(lo, hi, lo, hi, np.zeros(len(lo), np.int8), 0)]
    while stack:
        al, ah, bl, bh, used, depth = stack.pop()
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack += [tuple(x[:half] for x in (al, ah, bl, bh, used)) + (depth,), tuple(x[half:] for x in (al, ah, bl, bh, used)) + (depth,)]
            continue
        alone = (ah - al == 1) & (bh - bl == 1)
        if alone.any():
            a, b, so_far = al[alone], bl[alone], used[alone]
            rest = np.uint64((1 << (bits - depth)) - 1)
            near = (a != b) & (so_far + np.bitwise_count((keys[a] ^ keys[b]) & rest) <= budget)
            _unite(labels, a[near], b[near])
            al, ah, bl, bh, used = (x[~alone] for x in (al, ah, bl, bh, used))
        if not len(al):
            continue
        bit = np.uint64(1 << (bits - depth - 1))
        below = np.uint64((1 << (bits - depth)) - 1)
        am = np.clip(np.searchsorted(keys, (keys[al] & ~below) | bit), al, ah)
        bm = np.clip(np.searchsorted(keys, (keys[bl] & ~below) | bit), bl, bh)
        same = al == bl
        parts = [
            (al, am, bl, bm, used),
            (am, ah, bm, bh, used),
            (al, am, bm, bh, used + 1),
            *([tuple(x[~same] for x in (am, ah, bl, bm, used + 1))] if not same.all() else []),
        ]
        nxt = [np.concatenate(x) for x in zip(*parts)]
        keep = (nxt[1] > nxt[0]) & (nxt[3] > nxt[2]) & (nxt[4] <= budget) & ~((nxt[0] == nxt[2]) & (nxt[1] - nxt[0] == 1))
        stack.append((*(x[keep] for x in nxt), depth + 1))


def _unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a and b; afterwards every label is its set's least index."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def _join_sorted(bits: int, budget: int):
    """Batches (head, rest, fp) sorted by head and rest to links (u, v), a star for each connected part of a trie."""

    def links(head: np.ndarray, rest: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        number = np.cumsum(np.r_[False, head[1:] != head[:-1]]).astype(np.uint64)
        keys = (number << np.uint64(bits)) | rest.astype(np.uint64)
        labels = np.arange(len(keys))
        _join_nodes(keys, labels, budget, bits)
        moved = np.flatnonzero(labels != np.arange(len(keys)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[labels[moved]])], names=["u", "v"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            kept.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
            rows += batch.num_rows
            if rows < 50_000:
                continue
            head, rest, fp = (np.concatenate(x) for x in zip(*kept))
            last = len(head) - int((head[::-1] != head[-1]).argmax()) if head[0] != head[-1] else 0
            if last:
                yield links(head[:last], rest[:last], fp[:last])
            kept, rows = [(head[last:], rest[last:], fp[last:])], len(head) - last
        if rows:
            yield links(*(np.concatenate(x) for x in zip(*kept)))

    return run


def _routes(value: Column, bits: int, blocks: int, budget: int) -> Column:
    """Tries to look in: an array of (head, rest), by which ``blocks - budget`` blocks of the value go first.

    Values that differ in at most ``budget`` bits agree in at least that many
    blocks, so some trie holds both below one head, reached without error.
    """
    size = bits // blocks
    block = [F.shiftrightunsigned(value, bits - size * (i + 1)).bitwiseAND(F.lit((1 << size) - 1)) for i in range(blocks)]

    def joined(of: tuple[int, ...]) -> Column:
        out = F.lit(0).cast("long")
        for i in of:
            out = F.shiftleft(out, size).bitwiseOR(block[i])
        return out

    picks = list(combinations(range(blocks), blocks - budget))
    return F.array(
        *(
            F.struct(F.lit(n).alias("route"), joined(p).alias("head"), joined(tuple(i for i in range(blocks) if i not in p)).alias("rest"))
            for n, p in enumerate(picks)
        )
    )


def trie_links(fps: DataFrame, budget: int = 2, trie_limit: int = 1 << 16) -> DataFrame:
    """Links (u, v) whose connected parts are those of all fingerprints at most ``budget`` bits apart.

    ``fps`` (fp) must be distinct. The trie is laid out once for each choice of
    the 16-bit blocks in which a pair agrees; the traversal then starts below
    that common head, where a pair still has its whole budget. Each head is a
    trie of its own and goes to one task. A head with more than ``trie_limit``
    fingerprints is laid out again by 8-bit blocks of its rest, which bounds a
    trie at 65,536 keys. Each trie emits at most one link a key. A link may come
    from several tries; no or one fingerprint gives no link.
    """
    if budget != 2:
        raise ValueError("block layouts are given for a budget of 2")
    routed = fps.select("fp", F.explode(_routes(F.col("fp"), 64, 4, 2)).alias("r")).select(
        "fp", F.col("r.route").cast("long").alias("route"), F.col("r.head").alias("top"), "r.rest"
    )
    head = F.shiftleft(F.col("route"), 32).bitwiseOR(F.col("top")).alias("head")
    routed = routed.select("fp", head, "rest")
    large = routed.groupBy("head").count().where(F.col("count") > trie_limit).select("head")

    def joined(rows: DataFrame, bits: int) -> DataFrame:
        return rows.select("head", "rest", "fp").repartition("head").sortWithinPartitions("head", "rest").mapInArrow(_join_sorted(bits, budget), "u long, v long")

    if large.isEmpty():
        return joined(routed, 32)
    deeper = routed.join(large, "head", "left_semi").select("fp", "head", F.explode(_routes(F.col("rest"), 32, 4, 2)).alias("r"))
    inner = F.shiftleft(F.col("head"), 19).bitwiseOR(F.shiftleft(F.col("r.route").cast("long"), 16)).bitwiseOR(F.col("r.head"))
    return joined(routed.join(large, "head", "left_anti"), 32).union(joined(deeper.select("fp", inner.alias("head"), "r.rest"), 16))


def _rooted(fps: DataFrame, budget: int, id_col: str) -> DataFrame:
    """(fp, root, component_id) of a written table with ids and fps."""
    first = fps.groupBy("fp").agg(F.min(id_col).alias("least"))
    stars = components(trie_links(first.select("fp"), budget))
    grouped = first.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return grouped.select("fp", "root").join(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "root")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``df``.

    Texts whose fingerprints differ in at most ``budget`` bits are linked, and
    component_id is the least id that links reach. A null or wordless text has
    fingerprint zero and is linked as any other; a row with a null id keeps it
    and takes its group's least id, null if there is none; repeated rows stay
    repeated; an empty table gives none; other columns are ignored. Texts are
    read whole, in a few bytes of memory for each of their words.
    """
    own = Table(fingerprints(df, id_col, text_col, width), "fingerprints", narrow=True).df
    found = own.join(_rooted(own, budget, id_col).select("fp", "component_id"), "fp")
    return found.select(id_col, hex64(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 2) -> DataFrame:
    """The rows of ``df`` that stay: of each group the row with the least id, one of equal ones.

    All columns are kept. Groups are those of fingerprints, so rows of one id
    with different texts are decided each by itself, told apart by their texts'
    64-bit hashes. A row with a null id can't be named by a decision and stays.
    Null, empty and wordless texts are one group; an empty table gives no rows.
    """
    named = df.where(F.col(id_col).isNotNull()).select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    key = F.struct(F.col(id_col), F.xxhash64(text_col).alias("hash"))
    own = Table(fingerprints(named.select(key.alias("key"), text_col), "key", text_col, width).select(f"key.{id_col}", "key.hash", "fp"), "fingerprints", narrow=True).df
    rooted = _rooted(own, budget, id_col).select("fp", "root")
    least = own.join(rooted, "fp").groupBy("root").agg(F.min(F.struct(id_col, "hash")).alias("at"))
    found = own.join(rooted.join(least, "root"), "fp").groupBy(id_col, "hash").agg(F.max(F.struct(F.col(id_col), F.col("hash")) == F.col("at")).alias("first"), F.count("*").alias("n"))
    return kept_rows(df, Table(found, "groups", narrow=True).df, id_col, text_col)
