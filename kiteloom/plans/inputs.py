"""Stand-ins for a parallel corpus, made from general tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiteloom.functions import text as X
from kiteloom.operators import clean

#: Letters are to be ASCII here, nine of ten.
DOC_RULES = clean.Rules(min_script_ratio=0.90, blocks=X.ASCII)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pairs: the source is the first half of the normalized text, the target the second, the group is where it comes from."""
    x = X.normalize(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", x.alias("x"))
    half = F.floor(F.length("x") / 2).cast("int")
    return docs.select(
        F.col("doc_id").cast("string").alias("record_id"),
        F.col("source").alias("group_id"),
        F.trim(F.substring(F.col("x"), F.lit(1), half)).alias("source"),
        F.trim(F.substring(F.col("x"), half + 1, F.length("x"))).alias("target"),
        F.col("doc_id").alias(clean.ROW),
    )


def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.cascade(doc_pairs(spark, sf_dir), DOC_RULES, normalized=False)


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn and the assistant's turn right after it, found by an equi-join on the next turn's number."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", X.metric_text(F.col("text")).alias("text"))
    user = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    answer = rows.where("role = 'assistant'").select(F.col("conv_id").alias("c"), (F.col("turn") - 1).alias("t"), F.col("text").alias("target"))
    pairs = user.join(answer, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")))
    return pairs.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("record_id"), F.col("conv_id").cast("string").alias("group_id"), "source", "target")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made systems over the turn pairs: the base drops every 7th character of the source, the tuned ones the target's last 12 or 4."""
    head = lambda n: F.substring(F.col("target"), F.lit(1), F.greatest(F.length("target") - n, F.lit(0)))
    made = F.array(
        F.struct(F.lit("base").alias("system"), F.regexp_replace("source", "(?s)(.{6}).", "$1").alias("prediction")),
        F.struct(F.lit("tuned_700").alias("system"), head(12).alias("prediction")),
        F.struct(F.lit("tuned").alias("system"), head(4).alias("prediction")),
        F.struct(F.lit("copy_source").alias("system"), F.col("source").alias("prediction")),
    )
    return turn_pairs(spark, sf_dir).withColumn("p", F.explode(made)).select("record_id", "group_id", "source", "target", "p.system", "p.prediction")


# The same in DuckDB's SQL, as parts of WITH clauses.

WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"

DOC_PAIRS = rf"""
doc_pairs AS (
  SELECT CAST(doc_id AS VARCHAR) AS record_id, source AS group_id, trim(substr(x, 1, length(x) // 2)) AS source, trim(substr(x, length(x) // 2 + 1)) AS target, doc_id AS raw_row_number
  FROM (SELECT doc_id, source, trim(regexp_replace(regexp_replace(nfc_normalize(COALESCE(text, '')), '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{2060}}\x{{FEFF}}]', '', 'g'), '{WS}+', ' ', 'g')) AS x FROM documents))"""

CASCADE = (
    DOC_PAIRS
    + r""",
measured AS (
  SELECT *, length(source)::INT AS source_chars, length(target)::INT AS target_chars,
    length(regexp_replace(source, '[^\p{L}\p{N}]', '', 'g')) AS sc, length(regexp_replace(target, '[^\p{L}\p{N}]', '', 'g')) AS tc,
    length(source)::DOUBLE / greatest(length(target), 1) AS length_ratio,
    CASE WHEN length(regexp_replace(source, '\P{L}', '', 'g')) = 0 THEN 0.0::DOUBLE
      ELSE length(regexp_replace(source, '[^a-zA-Z]', '', 'g'))::DOUBLE / length(regexp_replace(source, '\P{L}', '', 'g')) END AS source_script_ratio
  FROM doc_pairs),
own AS (
  SELECT *, CASE WHEN source = '' THEN 'empty_source' WHEN target = '' THEN 'empty_target' WHEN sc < 2 THEN 'source_too_short' WHEN tc < 2 THEN 'target_too_short'
    WHEN source_script_ratio < 0.9 THEN 'low_source_script_ratio' WHEN NOT length_ratio BETWEEN 0.25 AND 2.0 THEN 'extreme_length_ratio' ELSE '' END AS r1
  FROM measured),
second AS (
  SELECT *, CASE WHEN r1 <> '' THEN r1 WHEN count(DISTINCT target) OVER (PARTITION BY source, r1) > 1 THEN 'conflicting_source_translation' ELSE '' END AS r2 FROM own),
rules AS (
  SELECT *, CASE WHEN r2 <> '' THEN r2 WHEN row_number() OVER (PARTITION BY source, target, r2 ORDER BY raw_row_number) > 1 THEN 'exact_duplicate_pair' ELSE '' END AS reason FROM second)"""
)

TURN_PAIRS = rf"""
said AS (SELECT conv_id, turn, role, trim(regexp_replace(COALESCE(text, ''), '{WS}+', ' ', 'g')) AS text FROM conversations),
turn_pairs AS (
  SELECT u.conv_id || '-' || u.turn AS record_id, CAST(u.conv_id AS VARCHAR) AS group_id, u.text AS source, a.text AS target
  FROM said u JOIN said a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant')"""

PREDICTIONS = (
    TURN_PAIRS
    + r""",
predictions AS (
  SELECT record_id, group_id, source, target, 'base' AS system, regexp_replace(source, '(?s)(.{6}).', '\1', 'g') AS prediction FROM turn_pairs
  UNION ALL SELECT record_id, group_id, source, target, 'tuned_700', substr(target, 1, greatest(length(target) - 12, 0)) FROM turn_pairs
  UNION ALL SELECT record_id, group_id, source, target, 'tuned', substr(target, 1, greatest(length(target) - 4, 0)) FROM turn_pairs
  UNION ALL SELECT record_id, group_id, source, target, 'copy_source', source FROM turn_pairs)"""
)


def chrf_counts(rows: str, name: str, hypothesis: str = "prediction", reference: str = "target", key: str = "record_id, system") -> str:
    """CTEs that end in ``name``: (key, kind, n, h, r, m) n-gram counts of chrF++, by listing and grouping all n-grams."""
    marks = r"[!-/:-@\[-`{-~]"
    split = f"""list_transform(list_filter(string_split(x, ' '), lambda w: w <> ''), lambda w: CASE
      WHEN length(w) > 1 AND regexp_matches(w[-1:], '{marks}') THEN [w[:-2], w[-1:]]
      WHEN length(w) > 1 AND regexp_matches(w[1:1], '{marks}') THEN [w[1:1], w[2:]] ELSE [w] END)"""
    return rf"""
{name}_sides AS (
  SELECT {key}, side, replace(x, ' ', '') AS c, flatten({split}) AS w
  FROM (SELECT {key}, 'h' AS side, trim(regexp_replace({hypothesis}, '{WS}+', ' ', 'g')) AS x FROM {rows}
        UNION ALL SELECT {key}, 'r', trim(regexp_replace({reference}, '{WS}+', ' ', 'g')) FROM {rows})),
{name}_orders AS (SELECT unnest(range(1, 7)) AS n),
{name}_grams AS (
  SELECT {key}, side, 'c' AS kind, n, substr(c, i::INT, n::INT) AS g
  FROM (SELECT {key}, side, c, n, unnest(range(1, length(c) - n + 2)) AS i FROM {name}_sides, {name}_orders WHERE length(c) >= n)
  UNION ALL SELECT {key}, side, 'w', n, list_aggregate(w[i:i + n - 1], 'string_agg', chr(1))
  FROM (SELECT {key}, side, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM {name}_sides, {name}_orders WHERE n <= 2 AND len(w) >= n)),
{name}_bags AS (SELECT {key}, side, kind, n, g, count(*) AS k FROM {name}_grams GROUP BY ALL),
{name}_met AS (
  SELECT {key}, kind, n, COALESCE(a.k, 0) AS h, COALESCE(b.k, 0) AS r, least(COALESCE(a.k, 0), COALESCE(b.k, 0)) AS m
  FROM (SELECT * EXCLUDE (side) FROM {name}_bags WHERE side = 'h') a FULL JOIN (SELECT * EXCLUDE (side) FROM {name}_bags WHERE side = 'r') b USING ({key}, kind, n, g)),
{name} AS (
  SELECT {key}, kind, n, CASE WHEN sum(r) > 0 THEN sum(h) ELSE 0 END::DOUBLE AS h, sum(r)::DOUBLE AS r, sum(m)::DOUBLE AS m FROM {name}_met GROUP BY ALL)"""


def chrf_formula(stats: str, by: str, name: str, digits: int = 4) -> str:
    """CTEs that end in ``name``: (by, chrfpp) from summed counts."""
    return f"""
{name}_sums AS (SELECT {by}, kind, n, sum(h) AS h, sum(r) AS r, sum(m) AS m FROM {stats} GROUP BY ALL),
{name}_parts AS (
  SELECT {by}, sum(CASE WHEN h > 0 AND r > 0 THEN m / h ELSE 0 END) / nullif(count(*) FILTER (h > 0 AND r > 0), 0) AS p,
    sum(CASE WHEN h > 0 AND r > 0 THEN m / r ELSE 0 END) / nullif(count(*) FILTER (h > 0 AND r > 0), 0) AS q FROM {name}_sums GROUP BY {by}),
{name} AS (SELECT {by}, round(CASE WHEN 4 * p + q > 0 THEN 500 * p * q / (4 * p + q) ELSE 0 END::DOUBLE, {digits}) AS chrfpp FROM {name}_parts)"""
