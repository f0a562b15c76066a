"""Token counts: distinct pre-tokens are counted once and joined to each document's frequencies."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, id_and_text, schema_of, slices, whole_runs

#: U+2581, which stands for a space in the pieces.
SPACE = "\u2581"


class PieceCounter:
    """Counts pieces of texts by distinct pre-tokens.

    A merge of this model only ever makes a piece of its vocabulary, so no merge
    crosses two characters that are adjacent in no piece. A text may therefore
    be cut between a character and a following space mark: apart from runs of
    the mark itself, no piece has it after its start (checked when the model is
    loaded). Each part is one pre-token, and a text's count is the sum over them.
    """

    def __init__(self, model_file: str, cache: int = 1 << 19) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("the vocabulary has pieces across spaces, so counts can't be added up by pre-tokens")
        if self.model.encode("  a  b ", out_type=str) != [SPACE * 2, SPACE + "a", SPACE, SPACE + "b", SPACE]:
            raise ValueError("the model drops or folds spaces")
        self.cache, self.known = cache, {}

    def pieces(self, parts: list[str]) -> list[int]:
        """The number of pieces of each pre-token."""
        # The model puts a mark before every text: a part gives its first one up, and one without gets none.
        found = list(map(len, self.model.encode([p[1:] for p in parts], num_threads=1)))
        for i, part in enumerate(parts):
            if len(part) == 1:
                found[i] = 1 if part in (" ", SPACE) else len(self.model.encode(part)) - 1
        return found

    def count(self, texts: list[str]) -> list[int]:
        """The counts of a few texts by themselves, without Spark; up to ``cache`` pre-tokens are remembered."""
        split = [Counter(pretokens(t)) for t in texts]
        parts = set().union(*split)
        if len(self.known) + len(parts) > self.cache:
            self.known = {}
        new = [p for p in parts if p not in self.known]
        self.known.update(zip(new, self.pieces(new), strict=True))
        return [sum(self.known[p] * n for p, n in own.items()) for own in split]


_SPLIT = re.compile(f"[ {SPACE}]+[^ {SPACE}]*|[^ {SPACE}]+")


def pretokens(text: str) -> list[str]:
    """The parts of a text, the mark put before it as the model does."""
    return _SPLIT.findall(" " + text) if text else []


def key_of(part: str, salt: int) -> int:
    """The 64-bit hash that stands for a pre-token; tables hold it as a signed long."""
    return xxhash.xxh3_64_intdigest(part, salt)


def _longs(keys: list[int]) -> pa.Array:
    return pa.array(np.array(keys, np.uint64).view(np.int64))


@lru_cache(maxsize=4)
def counter(model_file: str) -> PieceCounter:
    return PieceCounter(model_file)


def _odd(text: str) -> bool:
    """Whether cutting at spaces doesn't give the pre-tokens."""
    return SPACE in text or "  " in text or text[:1] in ("", " ")


def frequencies(text: str) -> Counter[str]:
    """How often each pre-token occurs, under its text without the leading space where that is all that sets it off."""
    if _odd(text):
        return Counter(p[1:] if p[0] == " " and p[1:2] not in (" ", SPACE) else SPACE + p for p in pretokens(text))
    return Counter(text.split(" "))


def spelt_out(short: str) -> str:
    """The pre-token of a key of ``frequencies``."""
    return short[1:] if short[:1] == SPACE else " " + short


def _distinct(salt: int, most_bytes: int = 32 << 20):
    """Texts to rows (key, part), each pre-token once for as many texts as ``most_bytes`` of them allow."""

    def rows(seen: set[str]) -> Iterator[pa.RecordBatch]:
        parts = [spelt_out(p) for p in seen]
        for at in range(0, len(parts), 50_000):
            some = parts[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([_longs([key_of(p, salt) for p in some]), pa.array(some, pa.string())], names=["key", "part"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        size = 0
        for batch in slices(batches):
            for text in batch.column(1).to_pylist():
                new = set(frequencies(text) if _odd(text) else text.split(" ")).difference(seen)
                seen |= new
                size += len("".join(new)) + 100 * len(new)
                if size > most_bytes:
                    yield from rows(seen)
                    seen, size = set(), 0
        yield from rows(seen)

    return run


def _counted(model_file: str):
    """Rows (key, part), sorted, to a row for each key: its pieces, how often it came, and whether two pre-tokens share it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_runs((p for batch in batches for p in slices([batch], 4 << 20))):
            key, part = columns[0].to_numpy(), columns[1]
            new_key = np.r_[True, key[1:] != key[:-1]]
            new_part = new_key | np.r_[True, pc.not_equal(part[1:], part[:-1]).to_numpy(zero_copy_only=False)]
            at = np.flatnonzero(new_key)
            pieces = np.array(counter(model_file).pieces(part.filter(pa.array(new_key)).to_pylist()), np.int64)
            clash = np.add.reduceat(new_part.astype(np.int64), at) > 1
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(pieces), pa.array(np.diff(np.r_[at, len(key)])), pa.array(clash)], names=["key", "pieces", "seen", "clash"])

    return run


def piece_table(texts: DataFrame, model_file: str) -> tuple[DataFrame, int]:
    """The written table (key, pieces, seen) of the distinct pre-tokens of ``texts`` (id, text), each counted once, and the salt of its keys.

    seen says how often a key was met by tasks. Should two pre-tokens share a key,
    all are hashed again under another salt.
    """
    for salt in range(16):
        parts = texts.mapInArrow(_distinct(salt), "key long, part string").repartition("key").sortWithinPartitions("key", "part")
        table = Table(parts.mapInArrow(_counted(model_file), "key long, pieces long, seen long, clash boolean"), "pieces").df
        if table.where("clash").isEmpty():
            return table.drop("clash"), salt
    raise RuntimeError("no salt keeps all pre-tokens apart")


class _Keys(dict):
    """Keys by the short names of pre-tokens, made when first asked for."""

    def __init__(self, salt: int) -> None:
        self.salt = salt

    def __missing__(self, short: str) -> int:
        key = self[short] = key_of(spelt_out(short), self.salt)
        return key


def _frequencies(salt: int, cache: int = 1 << 18):
    """(id, text) to (id, n_bytes, parts): the key of each distinct pre-token and how often it occurs."""
    entry = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Keys(salt)
        for batch in slices(batches, 4 << 20):
            texts = batch.column(1).to_pylist()
            if len(known) > cache:
                known = _Keys(salt)
            keys, times, ends = [], [], [0]
            for text in texts:
                own = frequencies(text)
                keys += map(known.__getitem__, own)
                times += own.values()
                ends.append(len(keys))
            sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            entries = pa.StructArray.from_arrays([_longs(keys), pa.array(np.array(times, np.int64))], ["key", "n"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries).cast(entry)], names=["id", "n_bytes", "parts"])

    return run


def commonest(table: DataFrame, most: int) -> int:
    """The least ``seen`` that at most ``most`` rows of ``table`` reach, found by its counts on a scale of eighths of powers of two."""
    step = F.floor(F.log2("seen") * 8)
    least, total = 1 << 62, 0
    for n, lowest in table.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("seen").alias("lowest")).orderBy(F.desc("step")).select("n", "lowest").collect():
        total += n
        if total > most:
            break
        least = lowest
    return least


def token_counts(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", most: int = 1 << 20) -> DataFrame:
    """(id, n_bytes, n_tokens) for every row of ``df``, as the library would encode the text.

    All distinct pre-tokens are gathered and their pieces counted once, over the
    whole table. Each document's pre-token frequencies are joined to these counts
    and summed. The commonest pre-tokens, ``most`` at most (2^20 rows of two
    longs), are broadcast, so frequent words aren't shuffled; the rows of others,
    which few tasks meet, are joined by a shuffle on their key. Pre-tokens are told apart
    by 64-bit hashes that are checked to be unique. No ids are kept.

    Null and empty texts have 0 tokens; texts without any space are one
    pre-token; repeated rows, null ids and empty tables pass through; other
    columns are ignored. ``model_file`` must exist on every executor.
    """
    texts = id_and_text(df, id_col, text_col).withColumnsRenamed({id_col: "id"}).withColumnRenamed(text_col, "text")
    table, salt = piece_table(texts, model_file)
    least = commonest(table, most)
    common, rare = table.where(F.col("seen") >= least).select("key", "pieces"), table.where(F.col("seen") < least).select("key", "pieces")
    named = texts.mapInArrow(_frequencies(salt), schema_of(texts, "id", "n_bytes long, parts array<struct<key: long, n: long>>"))
    each = named.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "n_bytes", F.explode_outer("parts").alias("p")).select("row", "id", "n_bytes", "p.key", "p.n")
    joined = each.join(F.broadcast(common), "key", "left")
    whole = F.coalesce(F.sum(F.col("n") * F.col("pieces")), F.lit(0))
    if rare.isEmpty():
        known = F.when(F.col("key").isNotNull() & F.col("pieces").isNull(), F.raise_error(F.lit("a pre-token without a count")).cast("long")).otherwise(F.col("pieces"))
        counted = joined.withColumn("pieces", known).groupBy("row", "id", "n_bytes").agg(whole.alias("n_tokens"))
        return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
    left = F.collect_list(F.when(F.col("pieces").isNull() & F.col("key").isNotNull(), F.struct("key", "n")))
    partly = Table(joined.groupBy("row", "id", "n_bytes").agg(whole.alias("n_tokens"), left.alias("left")), "partly").df
    rest = partly.select("row", F.explode("left").alias("p")).select("row", "p.key", "p.n").join(rare, "key").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"), F.count("*").alias("met"))
    done = partly.join(rest, "row", "left")
    complete = F.coalesce("met", F.lit(0)) == F.size("left")
    total = F.when(complete, F.col("n_tokens") + F.coalesce("more", F.lit(0))).otherwise(F.raise_error(F.lit("a pre-token without a count")).cast("long"))
    return done.select(F.col("id").alias(id_col), "n_bytes", total.alias("n_tokens"))


def with_limit(counts: DataFrame, limit: int = 4096) -> DataFrame:
    """Adds over_limit, whether a document has more than ``limit`` tokens."""
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
