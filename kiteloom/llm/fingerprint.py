"""Canonical exact digests, in built-in functions only."""

from __future__ import annotations

from math import ceil, isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Table, hex64

#: White space of any kind, as Java writes it.
_SPACE = "[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+"
_LEAST = -(1 << 63)


def _ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def canonical(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: the text in one form for all spellings that count as equal.

    Compatibility composition (NFKC), case folding, composition again, and white
    space folded to single spaces without any at the ends. The first three are
    static methods of the Unicode library that Spark itself brings for its
    collations, called in the JVM; ASCII texts, which they leave alone but for
    case, skip them. They are separate projections, so each runs once a row.
    """
    compose = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    out = df.withColumn(name, F.when(_ascii(F.col(text)), F.lower(text)).otherwise(compose(F.col(text))))
    for step in (fold, compose):
        out = out.withColumn(name, F.when(_ascii(F.col(text)), F.col(name)).otherwise(step(F.col(name))))
    return out.withColumn(name, F.trim(F.regexp_replace(name, _SPACE, " ")))


def wide_digest(text: Column) -> Column:
    """128 bits in 32 hex digits: xxhash64 under two seeds."""
    return F.concat(hex64(F.xxhash64(text)), hex64(F.xxhash64(F.lit("wide"), text)))


def _places(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` aren't above the key, less one; found in two steps of about a square root each."""
    size = max(1, isqrt(len(bounds)))
    groups = [bounds[i : i + size] for i in range(0, len(bounds), size)]
    count = lambda values: F.size(F.filter(values, lambda x: x <= key))
    first = F.greatest(count(F.array(*(F.lit(g[0]) for g in groups))), F.lit(1))
    inner = F.element_at(F.array(*(F.array(*map(F.lit, g)) for g in groups)), first)
    return (first - 1) * size + count(inner) - 1


def with_next(df: DataFrame, id_col: str, text_col: str, rows_each: int = 4000, most: int = 10_000) -> DataFrame:
    """Rows (id, text, digest) with those of the next row, ascending id, as next_text and next_digest; after the last comes the first.

    Rows are dealt by ranges of the id, whose bounds are ids that occur; the first
    row of a range is also dealt to the one before, as its end. So no task sees
    more than one range, of about ``rows_each`` rows while ``most`` ranges do.
    Null ids come first; rows with one id are ordered by text.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST))
    count = df.select(F.count("*"), F.min(key)).first()
    if not count[0]:
        return df.select(id_col, text_col, "digest", F.col(text_col).alias("next_text"), F.col("digest").alias("next_digest"))
    ranges = max(1, min(most, ceil(count[0] / rows_each)))
    cuts = df.select(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], F.lit(max(10_000, 4 * ranges)))).first()[0] if ranges > 1 else []
    bounds = sorted({count[1], *cuts})
    dealt = df.withColumn("_key", key).withColumn("_place", _places(F.col("_key"), bounds))
    first = F.col("_key") == F.element_at(F.array(*map(F.lit, bounds)), F.col("_place") + 1)
    own = F.struct(F.col("_place").alias("range"), F.lit(False).alias("end"))
    before = F.struct(F.pmod(F.col("_place") - 1, F.lit(len(bounds))).alias("range"), F.lit(True).alias("end"))
    dealt = dealt.withColumn("_in", F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own)))).select(id_col, text_col, "digest", "_key", F.col("_in.range").alias("_range"), F.col("_in.end").alias("_end"))
    w = W.partitionBy("_range").orderBy("_end", "_key", text_col)
    found = dealt.withColumn("next_text", F.lead(text_col).over(w)).withColumn("next_digest", F.lead("digest").over(w))
    return found.where(~F.col("_end")).drop("_key", "_range", "_end")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's digest beside that of its edited text, its last quarter replaced by the next one's beginning.

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next). Likeness is 1 if the canonical texts are equal byte for byte,
    which is asked where digests are equal, else 0. Documents with one digest are
    compared too: should their canonical texts differ, all but the first in byte
    order get their place there behind the digest. A null text counts as empty;
    a null id comes first and is left out of that last comparison; repeated rows
    stay and are each other's next; a sole row is its own next; an empty table
    gives none; other columns are ignored.
    """
    own = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hashed = canonical(own, "text", "canon").select(id_col, "text", wide_digest(F.col("canon")).alias("digest"))
    rows = with_next(hashed, id_col, "text")
    quarter = F.floor(F.length("text") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - quarter), F.substring(F.col("next_text"), F.lit(1), quarter)))
    rows = canonical(rows, "edited", "edited_canon").withColumn("edited_digest", wide_digest(F.col("edited_canon")))
    as_edited, as_next = F.col("digest") == F.col("edited_digest"), F.col("digest") == F.col("next_digest")
    rows = rows.withColumn("asked", F.when(as_edited | as_next, F.col("text")).otherwise("")).withColumn("asked_next", F.when(as_next, F.col("next_text")).otherwise(""))
    rows = canonical(canonical(rows, "asked", "canon"), "asked_next", "next_canon")
    found = rows.select(
        id_col,
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("digest").alias("fingerprint"),
        F.col("edited_digest").alias("edited_fingerprint"),
        F.when(as_edited & (F.col("canon") == F.col("edited_canon")), 1.0).otherwise(0.0).alias("near_edited"),
        F.when(as_next & (F.col("canon") == F.col("next_canon")), 1.0).otherwise(0.0).alias("near_next"),
    )
    return told_apart(Table(found, "fingerprints", narrow=True).df, own, id_col)


def told_apart(found: DataFrame, own: DataFrame, id_col: str, broadcast_rows: int = 1 << 20) -> DataFrame:
    """``found`` with the fingerprints of unequal canonical texts told apart, whatever the digest says.

    Only texts whose digest occurs again are read; which these are is broadcast
    up to ``broadcast_rows`` ids (16 MB) and joined by a shuffle beyond. Of a
    bucket only the least and greatest text leave a task, so its size is no matter.
    """
    again = found.groupBy("fingerprint").count().where("count > 1").select("fingerprint")
    members = Table(found.join(again, "fingerprint", "left_semi").where(F.col(id_col).isNotNull()).select(id_col).distinct(), "members", narrow=True).df
    few = members.count() <= broadcast_rows
    texts = own.join(F.broadcast(members) if few else members.hint("merge"), id_col, "left_semi")
    texts = canonical(texts, "text", "canon").select(id_col, "canon", wide_digest(F.col("canon")).alias("fingerprint"))
    unequal = texts.groupBy("fingerprint").agg(F.min("canon").alias("least"), F.max("canon").alias("most")).where("least <> most").select("fingerprint")
    unequal = Table(unequal, "unequal").df
    if unequal.isEmpty():
        return found
    distinct = texts.join(unequal, "fingerprint", "left_semi").select("fingerprint", "canon").distinct()
    numbered = distinct.withColumn("n", F.row_number().over(W.partitionBy("fingerprint").orderBy("canon")))
    named = texts.join(numbered, ["fingerprint", "canon"]).where("n > 1").select(F.col(id_col).alias("_id"), F.concat_ws("-", "fingerprint", "n").alias("_named")).distinct()
    return found.join(named, F.col(id_col) == F.col("_id"), "left").withColumn("fingerprint", F.coalesce("_named", "fingerprint")).drop("_id", "_named")
