"""Every query of the engine by name, with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kiteloom.functions import arrays as A
from kiteloom.functions import metrics as M
from kiteloom.functions import text as X
from kiteloom.operators import clean, encode, evaluate, history, quantiles, resample, split, summary
from kiteloom.sources import readers, sinks, tensors
from kiteloom.sources.shared import deleted_at_exit, settled, shared_path

from .inputs import CASCADE, DOC_RULES, PREDICTIONS, TURN_PAIRS, WS, cascade, chrf_counts, chrf_formula, doc_pairs, predictions, table, turn_pairs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function as the query of its name."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


# Text


@query(rf"""
SELECT doc_id, x AS text, length(x)::INT AS chars, len(list_filter(string_split(x, ' '), lambda w: w <> ''))::INT AS words
FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(nfc_normalize(COALESCE(text, '')), '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{2060}}\x{{FEFF}}]', '', 'g'), '{WS}+', ' ', 'g')) AS x FROM documents)""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", X.normalize(F.col("text")).alias("text"))
    return rows.select("doc_id", "text", F.length("text").alias("chars"), X.word_count(F.col("text")).alias("words"))


@query(r"""
SELECT doc_id, round(CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE a::DOUBLE / n END, 6) AS ratio, c::INT AS content FROM (
  SELECT doc_id, length(regexp_replace(text, '\P{L}', '', 'g')) AS n, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS a, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS c FROM documents)""")
def script_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.round(X.script_ratio(F.col("text"), X.ASCII), 6).alias("ratio"), X.content_chars(F.col("text")).alias("content"))


@query(f"WITH {TURN_PAIRS} SELECT record_id, round(length(source)::DOUBLE / greatest(length(target), 1), 6) AS ratio FROM turn_pairs")
def length_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).select("record_id", F.round(X.length_ratio(F.col("source"), F.col("target")), 6).alias("ratio"))


@query(f"""WITH {TURN_PAIRS} SELECT record_id, 'Translate the following text into German:' || chr(10) || chr(10) || source AS prompt, 2 AS n_messages, 'user,assistant' AS roles, target AS answer
FROM turn_pairs WHERE source <> ''""")
def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turn_pairs(spark, sf_dir).where("source <> ''")
    chat = rows.select("record_id", X.messages(X.prompt(F.col("source"), "German"), F.col("target")).alias("m"))
    return chat.select("record_id", F.col("m")[0]["content"].alias("prompt"), F.size("m").alias("n_messages"), F.array_join(F.transform("m", lambda t: t["role"]), ",").alias("roles"), F.col("m")[1]["content"].alias("answer"))


@query("SELECT p_partkey, p_name FROM part WHERE NOT (contains(lower(p_name), 'green') OR contains(lower(p_name), 'almond') OR contains(lower(p_name), '1'))")
def name_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments = X.ordered_distinct(F.array(F.lit("GREEN"), F.lit("almond")), F.array(F.lit("Green"), F.lit("1")))
    return table(spark, sf_dir, "part").where(~X.contains_any(F.col("p_name"), fragments)).select("p_partkey", "p_name")


@query("""SELECT page_id, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS url,
  replace(html, '</', '<\\/') AS script, array_extract(string_split(url, '/'), -1) AS last, CASE WHEN regexp_matches(url, '^(\\w+)://') THEN regexp_extract(url, '^(\\w+)://', 1) END AS scheme FROM pages""")
def page_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", X.escape_html(url).alias("url"), X.escape_script(F.col("html")).alias("script"), X.last_segment(url, "/").alias("last"), X.capture(url, "^(\\w+)://").alias("scheme"))


@query(f"WITH {TURN_PAIRS} SELECT record_id FROM turn_pairs WHERE contains(lower(source), 'the') OR contains(lower(target), 'the')")
def search_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).where(X.search([F.col("source"), F.col("target")], "THE")).select("record_id")


# Cleaning


@query(f"""WITH {CASCADE} SELECT raw_row_number, record_id, group_id, CASE WHEN reason = '' THEN 'kept' ELSE 'dropped' END AS status, reason, source_chars, target_chars,
  round(length_ratio, 6) AS length_ratio, round(source_script_ratio, 6) AS source_script_ratio FROM rules""")
def drop_reason_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.audit(cascade(spark, sf_dir))


@query(f"WITH {CASCADE} SELECT reason, count(*) AS rows FROM rules WHERE reason <> '' GROUP BY reason")
def drop_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_counts(cascade(spark, sf_dir))


@query(f"WITH {CASCADE} SELECT raw_row_number, record_id, group_id, source, target, 'en' AS source_language, 'de' AS target_language, 'documents' AS dataset_source FROM rules WHERE reason = ''")
def clean_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.kept(cascade(spark, sf_dir), "en", "de", "documents")


@query(f"WITH {CASCADE} SELECT source, count(DISTINCT target) AS targets FROM rules WHERE r1 = '' GROUP BY source HAVING count(DISTINCT target) > 1")
def conflicting_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean.profile(doc_pairs(spark, sf_dir), DOC_RULES, normalized=False)
    return clean.conflicting_sources(rows.where(clean.first_reason(DOC_RULES) == ""))


@query(f"WITH {CASCADE} SELECT source, target, count(*) AS copies, min(raw_row_number) AS first_row FROM doc_pairs GROUP BY source, target HAVING count(*) > 1")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.duplicate_pairs(doc_pairs(spark, sf_dir))


@query("SELECT conv_id, count(*) AS rows, min(conv_id) AS first_row FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def key_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.repeated_keys(table(spark, sf_dir, "conversations").select("conv_id"), "conv_id")


@query(rf"SELECT count(*) FILTER (regexp_replace(COALESCE(text, ''), '^{WS}+|{WS}+$', '', 'g') = '') AS text, count(*) FILTER (regexp_replace(COALESCE(role, ''), '^{WS}+|{WS}+$', '', 'g') = '') AS role FROM conversations")
def blank_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.blank_keys(table(spark, sf_dir, "conversations"), "text", "role")


# Sources


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, COALESCE(source, '') AS source, length(COALESCE(text, ''))::INT AS chars, md5(COALESCE(text, '')) AS text FROM documents")
def quoted_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents written as delimited text, with their line breaks in quotes, and read back by splits."""
    path = shared_path(spark, "delimited")
    sinks.write_delimited(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), path)
    rows = readers.read_delimited(spark, deleted_at_exit(spark, path))
    return rows.select("doc_id", "source", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("text"))


@query("""SELECT CAST(label AS VARCHAR) AS tensor, sum(len(embedding))::BIGINT AS "values", sum(len(list_filter(embedding, lambda x: isfinite(x))))::BIGINT AS finite, sum(len(list_filter(embedding, lambda x: x <> 0)))::BIGINT AS nonzero,
  round(sqrt(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS norm FROM embeddings GROUP BY label""")
def tensor_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors written as tensor files, one tensor a label and task, and summed up by slices."""
    path = shared_path(spark, "tensors")
    tensors.write_tensors(table(spark, sf_dir, "embeddings"), path, "label", "embedding")
    return tensors.tensor_summary(tensors.read_slices(spark, deleted_at_exit(spark, path))).withColumn("norm", F.round("norm", 6))


# Summaries


def _summary_sql(column: str, source: str) -> str:
    x = f"CAST({column} AS DOUBLE)"
    q = lambda p, name: f"round(quantile_cont({x}, {p}), 4) AS {name}"
    return f"SELECT '{column}' AS \"column\", count({column}) AS count, round(min({x}), 4) AS min, {q(0.25, 'p25')}, {q(0.5, 'median')}, {q(0.75, 'p75')}, {q(0.95, 'p95')}, round(avg({x}), 4) AS mean, round(max({x}), 4) AS max FROM {source}"


@query(_summary_sql("n_chars", "documents") + " UNION ALL " + _summary_sql("l_extendedprice", "lineitem") + " UNION ALL " + _summary_sql("l_quantity", "lineitem"))
def numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.numeric_summary(table(spark, sf_dir, "documents"), "n_chars").union(summary.numeric_summary(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity"))


@query("""SELECT round(quantile_cont(l_extendedprice::DOUBLE, 0.5), 6) AS price, round(quantile_cont(l_quantity::DOUBLE, 0.95), 6) AS quantity, round(quantile_cont(l_extendedprice::DOUBLE * (1 - l_discount::DOUBLE), 0.999), 6) AS revenue FROM lineitem""")
def selected_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles by selection at any size of the table: brackets, counts, then the few values left."""
    x = lambda c: F.col(c).cast("double")
    rows = table(spark, sf_dir, "lineitem").select(x("l_extendedprice").alias("price"), x("l_quantity").alias("quantity"), (x("l_extendedprice") * (1 - x("l_discount"))).alias("revenue"))
    wanted = {"price": 0.5, "quantity": 0.95, "revenue": 0.999}
    values = [round(quantiles.exact_quantiles(rows, [c], [p])[c][0], 6) for c, p in wanted.items()]
    return spark.createDataFrame([tuple(values)], ", ".join(f"{c} double" for c in wanted))


@query(f"""WITH {CASCADE} SELECT count(*) AS raw_rows, count(DISTINCT record_id) AS unique_record_ids, count(DISTINCT group_id) AS unique_group_ids, count(*) FILTER (reason = '') AS rows_kept,
  count(DISTINCT group_id) FILTER (reason = '') AS unique_groups_kept, count(*) FILTER (reason = '' AND source = target) AS identical_rows_kept,
  count(*) FILTER (reason <> '') AS rows_dropped, round(count(*) FILTER (reason = '')::DOUBLE / count(*), 6) AS retention_fraction FROM rules""")
def retention_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cascade(spark, sf_dir)
    return summary.retention(clean.audit(rows), clean.kept(rows, "en", "de", "documents"))


@query(f"WITH {TURN_PAIRS} SELECT count(*) AS rows, round(avg((source = target)::INT::DOUBLE), 4) AS equal_rate, round(avg((length(source) > length(target))::INT::DOUBLE), 4) AS longer_rate FROM turn_pairs")
def pair_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).agg(F.count("*").alias("rows"), summary.rate(F.col("source") == F.col("target")).alias("equal_rate"), summary.rate(F.length("source") > F.length("target")).alias("longer_rate"))


# Splits

_FOLD = (
    "WITH RECURSIVE "
    + CASCADE
    + """,
pairs AS (SELECT * FROM rules WHERE reason = ''),
sized AS (SELECT group_id AS g, count(*) AS n, md5('42:' || group_id) AS h FROM pairs GROUP BY group_id),
placed AS (SELECT *, row_number() OVER (ORDER BY h, g, n) AS k FROM sized),
total AS (SELECT sum(n)::DOUBLE AS t FROM sized),
dealt AS (
  SELECT 0::BIGINT AS k, NULL::VARCHAR AS g, 0::BIGINT AS n, NULL::VARCHAR AS split, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c
  UNION ALL
  SELECT k, g, n, s, a + CASE WHEN s = 'train' THEN n ELSE 0 END, b + CASE WHEN s = 'dev' THEN n ELSE 0 END, c + CASE WHEN s = 'test' THEN n ELSE 0 END FROM (
    SELECT p.k, p.g, p.n, d.a, d.b, d.c, CASE
      WHEN (t * 0.8::DOUBLE - d.a) / (t * 0.8::DOUBLE) >= (t * 0.1::DOUBLE - d.b) / (t * 0.1::DOUBLE) AND (t * 0.8::DOUBLE - d.a) / (t * 0.8::DOUBLE) >= (t * 0.1::DOUBLE - d.c) / (t * 0.1::DOUBLE) THEN 'train'
      WHEN (t * 0.1::DOUBLE - d.b) / (t * 0.1::DOUBLE) >= (t * 0.1::DOUBLE - d.c) / (t * 0.1::DOUBLE) THEN 'dev' ELSE 'test' END AS s
    FROM dealt d JOIN placed p ON p.k = d.k + 1, total)),
map AS (SELECT g AS group_id, split FROM dealt WHERE k > 0)"""
)


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean pairs, written once: a split reads them to size groups, to deal them and to join."""
    return settled(clean.kept(cascade(spark, sf_dir), "en", "de", "documents"), "pairs")


@query(_FOLD + " SELECT record_id, group_id, split FROM pairs JOIN map USING (group_id)")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_groups(_clean(spark, sf_dir), rng="hash").select("record_id", "group_id", "split")


@query(_FOLD + ", rows AS (SELECT * FROM pairs JOIN map USING (group_id)) SELECT split, count(*) AS rows, count(DISTINCT group_id) AS groups, round(count(*)::DOUBLE / (SELECT count(*) FROM rows), 6) AS row_fraction FROM rows GROUP BY split")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.split_summary(split.split_groups(_clean(spark, sf_dir), rng="hash"))


@query("""SELECT 'text' AS "key", md5(text) AS value, array_to_string(list_sort(list(DISTINCT source)), ',') AS splits FROM documents GROUP BY text HAVING count(DISTINCT source) > 1""")
def leakage_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("split"), F.md5(F.col("text").cast("binary")).alias("text"))
    return split.overlaps(rows, ["text"]).select("key", "value", F.array_join("splits", ",").alias("splits"))


@query("SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def leakage_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.contained_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


# Stores and alignment


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.remaining(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("e"))
    return last.select("user_id", "e.event_id", "e.event_type", "e.value")


_PARTIAL = PREDICTIONS + ", part AS (SELECT * FROM predictions WHERE NOT (system = 'tuned_700' AND length(target) < length(source)))"


def _partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).where(~((F.col("system") == "tuned_700") & (F.length("target") < F.length("source"))))


@query(f"WITH {_PARTIAL} SELECT record_id, system, prediction FROM part WHERE record_id IN (SELECT record_id FROM part GROUP BY record_id HAVING count(DISTINCT system) = (SELECT count(DISTINCT system) FROM part))")
def common_across_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.common(_partial(spark, sf_dir)).select("record_id", "system", "prediction")


@query(f"WITH {_PARTIAL} SELECT system, (SELECT count(DISTINCT record_id) FROM turn_pairs) - count(DISTINCT record_id) AS missing FROM part GROUP BY system")
def missing_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.missing_predictions(turn_pairs(spark, sf_dir), _partial(spark, sf_dir))


@query(f"WITH {CASCADE} SELECT record_id, source, row_number() OVER (ORDER BY md5('42:' || record_id), record_id)::INT AS sample_pos FROM rules WHERE reason = '' ORDER BY sample_pos LIMIT 300")
def test_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.sample(_clean(spark, sf_dir), 300, 42).select("record_id", "source", "sample_pos")


@query("""WITH a AS (SELECT doc_id, toxic::VARCHAR AS v FROM labels), b AS (SELECT doc_id, CASE WHEN contains(text, 'idiot') THEN '1' ELSE '0' END AS v FROM documents)
SELECT doc_id, a.v AS "left", b.v AS "right" FROM a FULL JOIN b USING (doc_id) WHERE a.v IS DISTINCT FROM b.v""")
def settings_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Two maps that share some keys, as two versions of settings do: given labels, and what one word says.
    given = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("string").alias("v"))
    guessed = table(spark, sf_dir, "documents").select("doc_id", F.when(F.contains(F.col("text"), F.lit("idiot")), "1").otherwise("0").alias("v"))
    return summary.differences(given, guessed, "doc_id", "v")


# Scores

_STATS = PREDICTIONS + "," + chrf_counts("predictions", "stats")
_SENTENCES = _STATS + "," + chrf_formula("stats", "record_id, system", "found") + """,
sentences AS (SELECT record_id, system, source, target, COALESCE(chrfpp, 0.0::DOUBLE) AS chrfpp FROM predictions LEFT JOIN found USING (record_id, system))"""


def _scored(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return evaluate.scored(predictions(spark, sf_dir), keep)


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.spread(predictions(spark, sf_dir))
    return rows.select("record_id", "system", "source", "target", M.chrf_stats(X.metric_text(F.col("prediction")), X.metric_text(F.col("target"))).alias("chrf")).withColumn("chrfpp", F.round(M.chrf_score(F.col("chrf")), 4)).drop("chrf")


@query(f"WITH {_STATS}, {chrf_formula('stats', 'system', 'scores')} SELECT system, n AS sentences, chrfpp FROM scores JOIN (SELECT system, count(*) AS n FROM predictions GROUP BY system) USING (system)")
def corpus_chrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.corpus_scores(_scored(spark, sf_dir), "system").select("system", "sentences", "chrfpp")


@query(f"WITH {PREDICTIONS}, {chrf_counts('predictions', 'stats', reference='source')}, {chrf_formula('stats', 'system', 'scores')} SELECT system, chrfpp AS chrfpp_vs_source FROM scores")
def chrf_vs_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.corpus_scores(_scored(spark, sf_dir), "system").select("system", "chrfpp_vs_source")


@query(f"WITH {_SENTENCES} SELECT record_id, system, chrfpp FROM sentences")
def sentence_chrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir).select("record_id", "system", "chrfpp")


def _bleu_sql(tokens: Callable[[str], str]) -> str:
    words = lambda c: rf"list_filter(regexp_split_to_array({tokens(c)}, '{WS}+'), lambda w: w <> '')"
    return rf"""WITH {PREDICTIONS},
sides AS (SELECT record_id, system, 'h' AS side, {words('prediction')} AS w FROM predictions
  UNION ALL SELECT record_id, system, 'r', {words('target')} FROM predictions),
orders AS (SELECT unnest(range(1, 5)) AS n),
bags AS (SELECT record_id, system, side, n, g, count(*) AS k FROM (
  SELECT record_id, system, side, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sides, orders WHERE len(w) >= n)) GROUP BY ALL),
met AS (SELECT system, n, COALESCE(a.k, 0) AS h, least(COALESCE(a.k, 0), COALESCE(b.k, 0)) AS m FROM (SELECT * EXCLUDE (side) FROM bags WHERE side = 'h') a
  FULL JOIN (SELECT * EXCLUDE (side) FROM bags WHERE side = 'r') b USING (record_id, system, n, g)),
sums AS (SELECT system, n, sum(h)::DOUBLE AS h, sum(m)::DOUBLE AS m FROM met GROUP BY ALL),
misses AS (SELECT *, count(*) FILTER (m = 0 AND h > 0) OVER (PARTITION BY system ORDER BY n) AS z, sum(m) OVER (PARTITION BY system) AS every FROM sums),
logs AS (SELECT system, any_value(every) AS every, sum(ln(CASE WHEN m = 0 THEN 100 / (pow(2, z) * h) ELSE 100 * m / h END)) / 4 AS l FROM misses GROUP BY system),
sizes AS (SELECT system, sum(len(w)) FILTER (side = 'h')::DOUBLE AS a, sum(len(w)) FILTER (side = 'r')::DOUBLE AS b FROM sides GROUP BY system)
SELECT system, round(CASE WHEN every = 0 THEN 0 ELSE CASE WHEN a < b THEN exp(1 - b / a) ELSE 1 END * exp(l) END, 4) AS bleu FROM logs JOIN sizes USING (system)"""


def _marks_apart(c: str) -> str:
    """The tokens called 13a, spaces between, in SQL."""
    for mark, char in (("<skipped>", "''"), ("-\n", "''"), ("\n", "' '"), ("&quot;", "'\"'"), ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'")):
        written = "'" + mark.replace("\n", "' || chr(10) || '") + "'"
        c = f"replace({c}, {written}, {char})"
    c = f"(' ' || {c} || ' ')"
    for pattern, by in M.MARKS_APART:
        c = "regexp_replace({}, '{}', '{}', 'g')".format(c, pattern, by.replace("$", "\\"))
    return c


def _corpus_bleu(rows: DataFrame, stats: Column) -> DataFrame:
    stats = evaluate.spread(rows).select("system", stats.alias("bleu"))
    return stats.groupBy("system").agg(M.summed(F.col("bleu"), M.BLEU_COUNT).alias("b")).select("system", F.round(M.bleu_score(F.col("b")), 4).alias("bleu"))


@query(_bleu_sql(lambda c: c))
def corpus_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus_bleu(predictions(spark, sf_dir), M.bleu_word_stats("prediction", "target"))


@query(_bleu_sql(_marks_apart))
def corpus_bleu_13a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus_bleu(predictions(spark, sf_dir), M.bleu_stats("prediction", "target"))


@query(f"""WITH {PREDICTIONS} SELECT system, round(avg((prediction_n = source)::INT::DOUBLE), 4) AS exact_copy_rate, round(avg((prediction_n = target)::INT::DOUBLE), 4) AS exact_match_rate,
  round(avg((prediction_n = '')::INT::DOUBLE), 4) AS empty_rate FROM (SELECT *, trim(regexp_replace(prediction, '{WS}+', ' ', 'g')) AS prediction_n FROM predictions) GROUP BY system""")
def copy_match_empty_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.metric_text(F.col("prediction"))
    rates = {"exact_copy_rate": p == F.col("source"), "exact_match_rate": p == F.col("target"), "empty_rate": p == ""}
    return predictions(spark, sf_dir).groupBy("system").agg(*(summary.rate(c).alias(n) for n, c in rates.items()))


_DRAWS = 200


_REPLICATES = f"""{_STATS},
placed AS (SELECT record_id, row_number() OVER (ORDER BY record_id) - 1 AS place FROM turn_pairs),
size AS (SELECT count(*) AS c FROM placed),
draws AS (SELECT b, ('0x' || substr(md5('7:' || b || ':' || i), 1, 8))::BIGINT % c AS place FROM (SELECT unnest(range({_DRAWS})) AS b), (SELECT unnest(range(c)) AS i, c FROM size)),
weights AS (SELECT b, record_id, count(*) AS w FROM draws JOIN placed USING (place) GROUP BY ALL),
drawn AS (SELECT b, system, kind, n, sum(h * w) AS h, sum(r * w) AS r, sum(m * w) AS m FROM weights JOIN stats USING (record_id) WHERE system IN ('base', 'tuned') GROUP BY ALL),
{chrf_formula('drawn', 'b, system', 'scores', 12)},
replicates AS (SELECT b, max(chrfpp) FILTER (system = 'tuned') - max(chrfpp) FILTER (system = 'base') AS delta FROM scores GROUP BY b)"""


@query(f"WITH {_REPLICATES} SELECT b AS replicate, round(delta, 6) AS delta FROM replicates")
def bootstrap_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.bootstrap_replicates(_scored(spark, sf_dir), "base", "tuned", _DRAWS, 7).select("replicate", F.round("delta", 6).alias("delta"))


@query(
    f"""WITH {_REPLICATES}, {chrf_formula('stats', 'system', 'overall', 12)}
SELECT 'base' AS baseline, 'tuned' AS system, round((SELECT chrfpp FROM overall WHERE system = 'tuned') - (SELECT chrfpp FROM overall WHERE system = 'base'), 4) AS observed_delta,
  round(quantile_cont(delta, 0.025), 4) AS ci95_low, round(quantile_cont(delta, 0.975), 4) AS ci95_high, round((count(*) FILTER (delta <= 0) + 1)::DOUBLE / (count(*) + 1), 4) AS p_value, count(*) AS samples FROM replicates"""
)
def bootstrap_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.significance(_scored(spark, sf_dir), "base", "tuned", _DRAWS, 7)


_TREE = f"""{_STATS},
placed AS (SELECT record_id, row_number() OVER (ORDER BY record_id) - 1 AS place FROM turn_pairs),
{resample.weights_sql('SELECT count(*) FROM placed', _DRAWS, 11, 64, 12, 'drawn_places')},
drawn AS (SELECT replicate AS b, system, kind, n, sum(h * w) AS h, sum(r * w) AS r, sum(m * w) AS m FROM drawn_places JOIN placed USING (place) JOIN stats USING (record_id) WHERE system IN ('base', 'tuned') GROUP BY ALL),
{chrf_formula('drawn', 'b, system', 'scores', 12)}"""


@query(f"WITH {_TREE} SELECT b AS replicate, round(max(chrfpp) FILTER (system = 'tuned') - max(chrfpp) FILTER (system = 'base'), 6) AS delta FROM scores GROUP BY b")
def bootstrap_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.tree_replicates(_scored(spark, sf_dir), "base", "tuned", _DRAWS, 11, leaf=64).select("replicate", F.round("delta", 6).alias("delta"))


def _bucket_sql(words: str) -> str:
    return f"CASE WHEN {words} BETWEEN 1 AND 5 THEN '1-5' WHEN {words} BETWEEN 6 AND 10 THEN '6-10' WHEN {words} BETWEEN 11 AND 20 THEN '11-20' WHEN {words} >= 21 THEN '21+' ELSE '0' END"


@query(f"""WITH {_STATS}, buckets AS (SELECT record_id, {_bucket_sql("len(list_filter(string_split(source, ' '), lambda w: w <> ''))")} AS length_bucket FROM turn_pairs),
joined AS (SELECT stats.*, length_bucket FROM stats JOIN buckets USING (record_id)), {chrf_formula('joined', 'length_bucket, system', 'scores')}
SELECT length_bucket, system, n AS sentences, chrfpp FROM scores JOIN (SELECT length_bucket, system, count(*) AS n FROM predictions JOIN buckets USING (record_id) GROUP BY ALL) USING (length_bucket, system)""")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).withColumn("source_words", X.word_count(F.col("source")))
    return evaluate.by_length(evaluate.scored(rows, ["source_words"]))


_DELTAS = _SENTENCES + """,
deltas AS (SELECT record_id, max(chrfpp) FILTER (system = 'base') AS chrfpp_base, max(chrfpp) FILTER (system = 'tuned') AS chrfpp_system FROM sentences GROUP BY record_id),
moved AS (SELECT *, round(chrfpp_system - chrfpp_base, 4) AS delta FROM deltas)"""


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.deltas(_sentences(spark, sf_dir), "base", "tuned")


@query(f"WITH {_DELTAS} SELECT * FROM moved")
def sentence_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir)


@query(f"WITH {_DELTAS} SELECT * FROM moved ORDER BY delta DESC, record_id LIMIT 20")
def top_improved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.extremes(_deltas(spark, sf_dir), "delta", "record_id")


@query(f"WITH {_DELTAS} SELECT * FROM moved ORDER BY delta, record_id LIMIT 20")
def top_regressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.extremes(_deltas(spark, sf_dir), "delta", "record_id", highest=False)


@query(f"WITH {_DELTAS} SELECT * FROM moved ORDER BY chrfpp_system DESC, record_id LIMIT 50")
def browse_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.browsed(_deltas(spark, sf_dir), "chrfpp_base", "chrfpp_system", "record_id", "high")


@query(f"WITH {_DELTAS} SELECT * FROM moved ORDER BY chrfpp_system, record_id LIMIT 50")
def browse_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.browsed(_deltas(spark, sf_dir), "chrfpp_base", "chrfpp_system", "record_id", "low")


@query(f"""WITH {_DELTAS}, ranked AS (SELECT *, row_number() OVER (ORDER BY chrfpp_system, record_id) AS k, count(*) OVER () AS c FROM moved),
fixed AS (SELECT record_id, CASE WHEN k = 1 THEN 'hardest' ELSE 'typical' END AS pick FROM ranked WHERE k IN (1, c // 2 + 1)),
gains AS (SELECT record_id, 'gain' AS pick FROM moved WHERE record_id NOT IN (SELECT record_id FROM fixed) ORDER BY delta DESC, record_id LIMIT 6)
SELECT * FROM gains UNION ALL SELECT * FROM fixed""")
def representative_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.representative(_deltas(spark, sf_dir), "delta", "chrfpp_system", "record_id", 8)


@query(f"WITH {_SENTENCES} SELECT system, count(*) FILTER (chrfpp < 30) AS below, count(*) FILTER (chrfpp >= 80) AS from_high, round(sum(round(chrfpp * 10000)::BIGINT)::DOUBLE / count(*)) / 10000 AS mean FROM sentences GROUP BY system")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.bands(_sentences(spark, sf_dir))


@query(f"""WITH {_SENTENCES} SELECT CASE WHEN length(target) >= length(source) * 1.5 THEN 'longer_reference' ELSE 'similar_length' END AS cohort, system, count(*) AS sentences, round(sum(round(chrfpp * 10000)::BIGINT)::DOUBLE / count(*)) / 10000 AS mean
FROM sentences GROUP BY ALL""")
def score_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.cohorts(_sentences(spark, sf_dir))


@query(f"""WITH {_SENTENCES} SELECT s.record_id, min(s.source) AS source, min(s.target) AS target, max(prediction) FILTER (s.system = 'base') AS prediction_base, max(chrfpp) FILTER (s.system = 'base') AS chrfpp_base,
  max(prediction) FILTER (s.system = 'tuned') AS prediction_tuned, max(chrfpp) FILTER (s.system = 'tuned') AS chrfpp_tuned FROM sentences s JOIN predictions p USING (record_id, system) GROUP BY s.record_id""")
def wide_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.wide(predictions(spark, sf_dir), _sentences(spark, sf_dir), ["base", "tuned"])


@query(f"""WITH {PREDICTIONS} SELECT count(*) AS rows, count(DISTINCT record_id) AS unique_ids, count(*) - count(DISTINCT record_id) AS duplicate_ids, count(*) FILTER (p = '') AS empty, count(*) FILTER (p = source) AS copies,
  count(*) FILTER (p = target) AS matches, count(*) FILTER (length(prediction) >= 100) AS limit_hits, round(avg(0.0::DOUBLE), 6) AS mean_script_ratio, round(sum(length(prediction))::DOUBLE / sum(length(target)), 6) AS length_ratio
FROM (SELECT *, trim(regexp_replace(prediction, '{WS}+', ' ', 'g')) AS p FROM predictions WHERE system = 'tuned')""")
def prediction_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).where("system = 'tuned'").withColumn("hit_token_limit", F.length("prediction") >= 100)
    return summary.profile_predictions(rows)


# Histories


def _events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select(F.col("event_id").alias("step"), "value")


@query("""WITH t AS (SELECT event_id AS step, value FROM events WHERE event_type = 'click'), e AS (SELECT event_id AS step FROM events WHERE event_type = 'purchase')
SELECT e.step, count(t.value) AS n, round(avg(t.value), 6) AS mean FROM e LEFT JOIN t ON t.step > e.step - 50 AND t.step <= e.step GROUP BY e.step""")
def trailing_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.trailing_mean(_events(spark, sf_dir, "click"), _events(spark, sf_dir, "purchase"))
    return found.select("step", "n", F.round("mean", 6).alias("mean"))


@query("""WITH e AS (SELECT event_id AS step, value FROM events WHERE event_type = 'purchase'), b AS (SELECT *, min(value) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM e)
SELECT step, value, best_before, best_before IS NULL OR value < best_before AS improved FROM b""")
def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.running_best(_events(spark, sf_dir, "purchase"))


@query("SELECT event_id AS step, value FROM events WHERE event_type = 'click' AND value IS NOT NULL ORDER BY event_id DESC LIMIT 1")
def latest_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest(_events(spark, sf_dir, "click"), "value")


@query("""SELECT min(event_id) AS x_min, max(event_id) AS x_max, min(value) AS y_min, max(value) AS y_max, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last FROM events WHERE event_type = 'click'""")
def loss_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.bounds(_events(spark, sf_dir, "click"))


@query("SELECT (event_id // 8 + 1)::BIGINT AS step, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def accumulated_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.accumulated(table(spark, sf_dir, "events"), 8, "event_id", "value").select("step", F.round("mean", 6).alias("mean"))


# Vectors and parameters


@query("SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.round(A.norm(F.col("embedding")), 6).alias("norm"))


@query("""WITH v AS (SELECT label, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS s, len(embedding) AS n FROM embeddings)
SELECT label, round(sqrt(sum(s)), 6) AS norm, sum(n)::BIGINT AS weights, round(sqrt(sum(s)) / sqrt(sum(n)), 6) AS rms_per_weight FROM v GROUP BY label""")
def norms_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", A.norm(F.col("embedding")).alias("n"), F.size("embedding").alias("w"))
    return summary.norms(rows, "label", "n", "w").select("label", F.round("norm", 6).alias("norm"), "weights", F.round("rms_per_weight", 6).alias("rms_per_weight"))


@query("""SELECT label, count(*) AS vectors, count(*) FILTER (list_bool_and(list_transform(embedding, lambda x: isfinite(x)))) AS finite,
  count(*) FILTER (list_bool_or(list_transform(embedding, lambda x: x <> 0))) AS nonzero FROM embeddings GROUP BY label""")
def vector_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").groupBy("label")
    return rows.agg(F.count("*").alias("vectors"), F.count_if(A.all_finite(F.col("embedding"))).alias("finite"), F.count_if(A.any_nonzero(F.col("embedding"))).alias("nonzero"))


@query("""SELECT sum(p_size)::BIGINT AS total, sum(p_size) FILTER (p_partkey % 3 = 0)::BIGINT AS trainable, count(*) FILTER (p_partkey % 3 = 0) AS trainable_tensors,
  md5(COALESCE(array_to_string(list_sort(list(DISTINCT p_name) FILTER (p_partkey % 3 = 0 AND contains(lower(p_name), 'a'))), ','), '')) AS violations, round(sum(p_size) FILTER (p_partkey % 3 = 0) * 100.0::DOUBLE / sum(p_size), 4) AS percentage FROM part""")
def param_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("numel"), (F.col("p_partkey") % 3 == 0).alias("trainable"))
    return summary.parameter_census(rows, forbidden=["A"]).withColumn("violations", F.md5(F.array_join("violations", ",").cast("binary")))


# Token arrays, with code points for tokens

_CODES = TURN_PAIRS + """,
codes AS (SELECT record_id, list_transform(string_split(source, ''), lambda c: ord(c)) AS prompt, list_transform(string_split(source || target, ''), lambda c: ord(c)) AS full_ids FROM turn_pairs
  WHERE source <> '' AND target <> '')"""


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turn_pairs(spark, sf_dir).where("source <> '' AND target <> ''")
    return rows.select("record_id", A.code_points(F.col("source")).alias("prompt"), A.code_points(F.concat("source", "target")).alias("full_ids"))


@query(f"""WITH {_CODES} SELECT record_id, array_to_string(list_concat(list_transform(range(len(prompt)), lambda i: -100), full_ids[len(prompt) + 1:]), ',') AS labels, (len(full_ids) - len(prompt))::INT AS supervised,
  array_to_string(full_ids[len(prompt) + 1:], ',') AS completion, len(full_ids) >= 512 AS hit_limit FROM codes""")
def label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _codes(spark, sf_dir).withColumn("labels", A.label_mask(F.col("prompt"), F.col("full_ids")))
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    return rows.select("record_id", joined(F.col("labels")).alias("labels"), A.supervised(F.col("labels")).alias("supervised"), joined(A.completion(F.col("prompt"), F.col("full_ids"))).alias("completion"), A.hit_limit(F.col("full_ids"), 512).alias("hit_limit"))


@query(rf"""WITH {TURN_PAIRS},
chats AS (SELECT record_id, '<bos><start_of_turn>user' || chr(10) || 'Translate the following text into German:' || chr(10) || chr(10) || source || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) AS p,
  regexp_replace(target, '^{WS}+|{WS}+$', '', 'g') || '<end_of_turn>' || chr(10) AS a FROM turn_pairs WHERE source <> ''),
ids AS (SELECT record_id, length(p)::INT AS prompt_tokens, length(p || a)::INT AS full_tokens, list_transform(string_split(a, ''), lambda c: ord(c)) AS answer FROM chats)
SELECT record_id, prompt_tokens, full_tokens, CASE WHEN full_tokens <= 1024 THEN len(answer) END::INT AS supervised_tokens, CASE WHEN full_tokens > 1024 THEN 'sequence_too_long' END AS skip_reason,
  CASE WHEN full_tokens <= 1024 THEN md5(array_to_string(list_concat(list_transform(range(prompt_tokens), lambda i: -100), answer), ',')) END AS labels FROM ids""")
def chat_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole chats encoded on the executors by a tokenizer named as a setting names it, masked up to the answer."""
    rows = turn_pairs(spark, sf_dir).where("source <> ''").select("record_id", X.prompt(F.col("source"), "German").alias("prompt"), "target")
    done = encode.training_examples(rows, 1024, "kiteloom.operators.encode:code_points")
    labels = F.md5(F.array_join(F.col("labels").cast("array<string>"), ",").cast("binary"))
    return done.select("record_id", "prompt_tokens", "full_tokens", "supervised_tokens", "skip_reason", labels.alias("labels"))


def _pad_sql(left: bool) -> str:
    fill = lambda v: f"list_transform(range(w - len(full_ids)), lambda i: {v})"
    both = lambda own, v: f"array_to_string(list_concat({fill(v)}, {own}), ',')" if left else f"array_to_string(list_concat({own}, {fill(v)}), ',')"
    return f"""WITH {_CODES}, sized AS (SELECT *, len(prompt) % 4 AS batch FROM codes), wide AS (SELECT *, max(len(full_ids)) OVER (PARTITION BY batch) AS w FROM sized)
SELECT record_id, batch::INT AS batch, {both('full_ids', 0)} AS input_ids, {both('list_transform(full_ids, lambda x: 1)', 0)} AS attention_mask FROM wide"""


def _padded(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    rows = _codes(spark, sf_dir).select("record_id", (F.size("prompt") % 4).alias("batch"), F.col("full_ids").alias("input_ids"), F.transform("full_ids", lambda x: F.lit(1)).alias("attention_mask"))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return A.pad_batches(rows, "batch", side=side).select("record_id", "batch", joined("input_ids"), joined("attention_mask"))


@query(_pad_sql(left=False))
def pad_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _padded(spark, sf_dir, "right")


@query(_pad_sql(left=True))
def pad_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _padded(spark, sf_dir, "left")


@query(f"WITH {TURN_PAIRS} SELECT record_id, n::INT AS tokens, ((row_number() OVER (ORDER BY n, record_id) - 1) // 8)::BIGINT AS batch FROM (SELECT record_id, length(source) AS n FROM turn_pairs)")
def length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turn_pairs(spark, sf_dir).select("record_id", F.length("source").alias("tokens"))
    return A.batches(rows, 8, "tokens", "record_id").select("record_id", "tokens", "batch")


@query(f"WITH {TURN_PAIRS} SELECT record_id FROM (SELECT record_id, row_number() OVER (ORDER BY record_id) AS k FROM turn_pairs) WHERE (k - 1) % 60 = 0")
def every_60th(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.every(turn_pairs(spark, sf_dir), 60, "record_id").select("record_id")


@query(f"""WITH {_CODES} SELECT reason, count(*) AS rows FROM (SELECT CASE WHEN len(full_ids) > 512 THEN 'sequence_too_long' WHEN len(full_ids) = len(prompt) THEN 'no_supervised_tokens' END AS reason FROM codes)
WHERE reason IS NOT NULL GROUP BY reason""")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _codes(spark, sf_dir).withColumn("labels", A.label_mask(F.col("prompt"), F.col("full_ids")))
    return summary.reason_histogram(rows, A.fit_reason(F.col("full_ids"), F.col("labels"), 512))


@query(f"""WITH {_CODES} SELECT record_id FROM codes WHERE len(full_ids) <= 512 ORDER BY md5('42:' || record_id), record_id LIMIT 50""")
def first_fitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _codes(spark, sf_dir).withColumn("labels", A.label_mask(F.col("prompt"), F.col("full_ids")))
    return summary.first_fitting(rows, A.fit_reason(F.col("full_ids"), F.col("labels"), 512), 50, 42).select("record_id")


@query("SELECT vec_id, printf('%.2f', label / 3.0::DOUBLE) AS fixed, printf('%.1f%%', label * 12.5::DOUBLE) AS percent, printf('%+.2f', label - 2.5::DOUBLE) AS signed FROM embeddings")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("label")
    return table(spark, sf_dir, "embeddings").select("vec_id", X.fixed(n / 3.0).alias("fixed"), X.percent(n * 0.125).alias("percent"), X.signed(n - 2.5).alias("signed"))
