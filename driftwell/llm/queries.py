"""Queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm import encoding, leaks, packing, quantiles
from driftwell.session import stage
from driftwell.sources import table

PROBS = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
EPS = 0.001
_LIKELIHOODS = (("kalman_output", "sliding_likelihood"), ("gaussian_mixture_output", "loglikelihood"))


def _likelihoods(spark: SparkSession, d: str) -> DataFrame:
    """Both columns as one, keyed by table and state key."""
    parts = [table(spark, d, t).select(F.struct(F.lit(t).alias("src"), "state_key").alias("source"), "event_time", F.col(c).alias("likelihood")) for t, c in _LIKELIHOODS]
    return parts[0].unionByName(parts[1])


def _named(found: DataFrame) -> DataFrame:
    return found.select("key.src", "key.state_key", "p", "value", "n")


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _named(quantiles.percentiles(_likelihoods(spark, d), "likelihood", PROBS, key="source"))


def p6_percentiles_all_rounds(spark: SparkSession, d: str) -> DataFrame:
    """As ``p6_percentiles``, with rounds of pivots down to ranges of a few rows."""
    return _named(quantiles.percentiles(_likelihoods(spark, d), "likelihood", PROBS, key="source", small=16))


def p6_percentiles_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles combined from states that were written day by day, beside the exact ones: whether each is within the bound."""
    rows = _likelihoods(spark, d)
    days = stage(quantiles.day_states(rows, "likelihood", key="source", eps=EPS), "day")
    near = _named(quantiles.multi_select(quantiles.combine_days(days), PROBS)).withColumnRenamed("value", "near")
    exact = p6_percentiles(spark, d)
    on = (near["src"] == exact["src"]) & near["state_key"].eqNullSafe(exact["state_key"]) & (near["p"] == exact["p"])
    within = (F.col("near") == F.col("value")) | (F.abs(F.col("near") - F.col("value")) <= EPS * F.abs("value"))
    return exact.join(near, on, "left").select(exact["src"], exact["state_key"], exact["p"], exact["n"], F.coalesce(within & (near["n"] == exact["n"]), F.lit(False)).alias("within_bound"))


P6_PERCENTILES = " UNION ALL ".join(
    f"""SELECT '{t}' AS src, state_key, p, v AS value, n FROM (SELECT state_key, {c} AS v, row_number() OVER (PARTITION BY state_key ORDER BY {c}) AS r, count(*) OVER (PARTITION BY state_key) AS n
    FROM {t} WHERE {c} IS NOT NULL AND NOT isnan({c})), (SELECT unnest([{", ".join(f"{p}::DOUBLE" for p in PROBS)}]) AS p) WHERE r = greatest(1, ceil(p * n))"""
    for t, c in _LIKELIHOODS
)
P6_BY_DAY = f"SELECT src, state_key, p, n, TRUE AS within_bound FROM ({P6_PERCENTILES})"


def p7_packs(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_sizes")).withColumnRenamed("item_id", "doc_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_packs(spark, d).where("n_pieces > 1 AND piece_no = 0").select("pack_id", "doc_id")


P7_FOUND = "SELECT pack_id, doc_id FROM documents JOIN pack_sizes ON octet_length(encode(text)) > capacity"


def p7_utilisation(spark: SparkSession, d: str) -> DataFrame:
    return packing.utilisation(p7_packs(spark, d), table(spark, d, "pack_sizes"))


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every assignment, beside figures that the tables alone give."""
    u = packing.utilisation(p7_packs(spark, d).withColumnRenamed("doc_id", "item_id"), table(spark, d, "pack_sizes"))
    return u.select("pack_id", "n_items", "n_pieces", "n_tokens", (F.col("fullest") <= F.col("capacity")).alias("none_too_full"), (F.col("n_bins") <= F.col("fit_bins")).alias("no_worse_than_best_fit"), (F.col("n_bins") >= F.col("least_bins")).alias("above_bound"))


P7_INVARIANTS = """
SELECT pack_id, count(*) AS n_items, CAST(sum(greatest(1, ceil(n / capacity))) AS BIGINT) AS n_pieces, CAST(sum(n) AS BIGINT) AS n_tokens, TRUE AS none_too_full, TRUE AS no_worse_than_best_fit, TRUE AS above_bound
FROM (SELECT coalesce(octet_length(encode(text)), 0) AS n FROM documents), pack_sizes GROUP BY 1
"""


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Passages and questions that leaked, and answers beside them, with their places in the text."""
    return leaks.find(table(spark, d, "documents"), table(spark, d, "eval_items"), whole=("question", "answer"), beside=("answer",))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_entire(spark: SparkSession, d: str) -> DataFrame:
    """Passages and questions that stand in a document in full, and whether the search by runs finds each such passage, too."""
    items = table(spark, d, "eval_items").withColumn("entire", F.col("passage"))
    hits = leaks.find(table(spark, d, "documents"), items, whole=("entire", "question")).select("doc_id", "item_id", "field").distinct()
    return hits.groupBy("doc_id", "item_id").agg(F.max(F.col("field") == "entire").alias("entire"), F.max(F.col("field") == "question").alias("question"), F.max(F.col("field") == "passage").alias("run")).where("entire OR question").select("doc_id", "item_id", "entire", "question", (F.col("run") | ~F.col("entire")).alias("run_found"))


#: Case folded, signs that are misread letters put back, letters and digits only.
_LETTERS = r"regexp_replace(regexp_replace(regexp_replace(replace(lower({}), 'ß', 'ss'), '[!|]([\p{{L}}\p{{N}}])', 'l\1', 'g'), '\(([\p{{L}}\p{{N}}])', 'c\1', 'g'), '[^\p{{L}}\p{{N}}]', '', 'g')"
P8_ENTIRE = f"""
WITH d AS (SELECT doc_id, {_LETTERS.format("text")} AS t FROM documents), i AS (SELECT item_id, {_LETTERS.format("passage")} AS p, {_LETTERS.format("question")} AS q FROM eval_items)
SELECT doc_id, item_id, contains(t, p) AS entire, contains(t, q) AS question, TRUE AS run_found FROM d JOIN i ON contains(t, p) OR contains(t, q)
"""


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repair(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_restored(spark, d).select("doc_id")


def p9_certain(spark: SparkSession, d: str) -> DataFrame:
    """Documents with signs that only wrong decoding leaves, and whether each is found."""
    docs = table(spark, d, "documents")
    certain = docs.where(F.col("text").rlike("[\ufffd\x80-\x9f]")).select("doc_id")
    found = p9_found(spark, d).select("doc_id", F.lit(True).alias("found"))
    return certain.join(found, "doc_id", "left").select("doc_id", F.coalesce("found", F.lit(False)).alias("found"))


P9_CERTAIN = "SELECT doc_id, TRUE AS found FROM documents WHERE regexp_matches(text, '[\ufffd\x80-\x9f]')"

QUERIES = {f.__name__: f for f in (p6_percentiles, p6_percentiles_all_rounds, p6_percentiles_by_day, p7_found, p7_packs, p7_utilisation, p7_invariants, p8_found, p8_leaks, p8_entire, p9_found, p9_restored, p9_certain)}
SQL = {"p6_percentiles": P6_PERCENTILES, "p6_percentiles_all_rounds": P6_PERCENTILES, "p6_percentiles_by_day": P6_BY_DAY, "p7_found": P7_FOUND, "p7_invariants": P7_INVARIANTS, "p8_entire": P8_ENTIRE, "p9_certain": P9_CERTAIN}
