"""The problems of training text (p8 to p10) over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import leaks, mixing, reading
from chronolith.session import written
from chronolith.sources.tables import table

def _corpus(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "documents").select(*cols)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(_corpus(spark, d, "doc_id", "text"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("item_id", "doc_id").distinct()


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items: in how many pages, the longest run and the longest verbatim match, and where they stand (page and word places)."""
    first = lambda what: F.max(F.struct(
        f"{what}_words", (-F.col("doc_id")).alias("doc_id"), f"{what}_item_at", f"{what}_page_at"
    )).alias(what)
    g = _leaks(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), first("run"), first("verbatim"))
    place = lambda what: [
        (-F.col(f"{what}.doc_id")).alias(f"{what}_doc_id"), f"{what}.{what}_item_at", f"{what}.{what}_page_at"
    ]
    return g.select(
        "item_id", "n_docs", F.col("run.run_words").alias("longest_run"), *place("run"),
        F.col("verbatim.verbatim_words").alias("longest_verbatim"), *place("verbatim")
    )


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """The corpus without affected pages."""
    return leaks.without_leaks(_corpus(spark, d, "doc_id", "source", "n_chars"), written(_leaks(spark, d), "leaks"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = _corpus(spark, d, "doc_id", "source", "text")
    wanted = mixing.listed(table(spark, d, "mix_targets")).select("source_key")
    only = docs.withColumn("source_key", mixing.source_key("source")).join(wanted, "source_key", "left_semi")
    return mixing.token_counts(only, "text", ["doc_id", "source"])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    plan = mixing.plan(_sizes(spark, d), table(spark, d, "mix_targets"))
    return plan.where("NOT reachable").select("source")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = written(_sizes(spark, d), "sizes")
    plan = mixing.plan(sizes, table(spark, d, "mix_targets"))
    return mixing.mix(sizes, plan), plan


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the mix and how often each is taken."""
    return _mixed(spark, d)[0].select("doc_id", "source", "n_tokens", "copies")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached."""
    return mixing.shares(*_mixed(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    rated = reading.rated(_corpus(spark, d, "doc_id", "text", "lang"), table(spark, d, "graded_docs"))
    return rated.select("doc_id", "band").distinct()


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """Pages and mean level per source and band."""
    r = reading.rated(_corpus(spark, d, "doc_id", "text", "lang"), table(spark, d, "graded_docs"))
    s = _corpus(spark, d, "doc_id", "source").select("doc_id", F.coalesce(mixing.source_key("source"), F.lit("")).alias("source"))
    level = F.round(F.avg("level"), 3).alias("mean_level")
    return r.join(s, "doc_id").groupBy("source", "band").agg(F.count(F.lit(1)).alias("n_pages"), level)


def p10_fit(spark: SparkSession, d: str) -> DataFrame:
    """How the fit went: objective of an occurrence and greatest change of a difficulty, by round."""
    _, scale = reading.scaled(_corpus(spark, d, "doc_id", "text", "lang"))
    rows = [(*h, scale.converged) for h in scale.history]
    return spark.createDataFrame(rows, "round int, objective double, moved double, converged boolean")


def p10_held_out(spark: SparkSession, d: str) -> DataFrame:
    """Grades of half of the graded pages against bands fitted to the other half."""
    scored, _ = reading.scaled(_corpus(spark, d, "doc_id", "text", "lang"))
    return reading.held_out(scored, table(spark, d, "graded_docs"))


QUERIES = {f.__name__: f for f in (
    p8_found, p8_items, p8_clean, p9_found, p9_mix, p9_shares, p10_found, p10_profile, p10_fit, p10_held_out
)}

#: p9_found holds for any measure of size (TESTDATA); the SQL takes characters.
SQL = {
    "p9_found": """WITH d AS (SELECT lower(trim(source)) AS k, sum(coalesce(length(text), 0)) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1),
      t AS (SELECT trim(m.source) AS source, target_share, max_repeats, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER () AS total FROM mix_targets m LEFT JOIN d ON d.k = lower(trim(m.source)))
      SELECT source FROM t WHERE max_repeats * n < target_share * total""",
}
