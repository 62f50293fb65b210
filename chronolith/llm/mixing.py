"""Mixing sources of text to target weights.

Method: tokens are summed per source (partial sums in each task, so a source
with a third of all rows costs a row per task).  The repetition rate of a
source is its share of the total over its own size, at most ``max_repeats``; a
document is emitted floor(rate) times plus once more with the probability of
the fraction, decided by a seeded hash of its id: the same on every run.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
_ENCODERS: dict = {}


def encoder(folder: str, name: str = "byte_bpe_50k.tiktoken"):
    """The public byte-level BPE, once a process."""
    if (folder, name) not in _ENCODERS:
        import importlib.util

        import tiktoken

        spec = importlib.util.spec_from_file_location("_public_tokenizers", f"{folder}/__init__.py")
        pub = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(pub)
        with open(f"{folder}/{name}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[folder, name] = tiktoken.Encoding("own", pat_str=pub.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[folder, name]


def token_counts(df: DataFrame, text: str, keep: list[str], folder: str = TOKENIZERS) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of the whole text; null text has none."""
    schema = df.select(*keep).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    from pyspark.sql.types import LongType, StructType

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(count, StructType([*schema.fields]).add("n_tokens", LongType()))


def source_key(col: Column | str) -> Column:
    """Source names compare trimmed and without case."""
    return F.lower(F.trim(F.col(col) if isinstance(col, str) else col))


def listed(targets: DataFrame) -> DataFrame:
    """(source_key, source, target_share, max_repeats), one row per source; shares of spellings of one source add up."""
    t = targets.where("source IS NOT NULL").groupBy(source_key("source").alias("source_key"))
    return t.agg(
        F.min(F.trim("source")).alias("source"), F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"),
        F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats")
    )


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """The mix: (source_key, source, target_share, max_repeats, own_tokens, total_tokens, rate, reachable).

    sizes: (source, n_tokens) of documents or parts of sources.  The total is
    the size of all listed sources, once each.  A source without documents has
    size 0 and can't reach a positive share.  Documents of no or an unlisted
    source count nowhere.  The targets are a small list, one row a source.
    """
    t = listed(targets)
    own = sizes.where("source IS NOT NULL").groupBy(source_key("source").alias("source_key")).agg(F.sum("n_tokens").alias("own_tokens"))
    both = t.join(own, "source_key", "left").withColumn("own_tokens", F.coalesce("own_tokens", F.lit(0).cast("long")))
    total = both.agg(F.sum("own_tokens").alias("total_tokens"))
    wanted = F.col("target_share") * F.col("total_tokens")
    # `total` is one row
    return both.join(F.broadcast(total)).withColumn(
        "rate",
        F.when(F.col("own_tokens") > 0, F.least(wanted / F.col("own_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    ).withColumn("reachable", F.col("max_repeats") * F.col("own_tokens") >= wanted)


def copies(doc_id: Column, rate: Column, seed: int) -> Column:
    """floor(rate) plus a Bernoulli copy from a seeded hash; never more than ceil(rate)."""
    u = F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 52)) / float(1 << 52)
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(documents: DataFrame, mixing: DataFrame, doc_id: str = "doc_id", source: str = "source", seed: int = 1) -> DataFrame:
    """Documents with the number of copies each gets (those with none left out).

    The plan has a row per listed source, a small list; it is joined by key.
    """
    d = documents.withColumn("_key", source_key(source))
    m = mixing.select(F.col("source_key").alias("_key"), F.col("rate").alias("_rate"))
    return d.join(m, "_key").withColumn("copies", copies(F.col(doc_id), F.col("_rate"), seed)).where("copies > 0").drop("_key", "_rate")


def emitted(mixed: DataFrame) -> DataFrame:
    """One row per copy, with ``copy`` from 1."""
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")


def shares(mixed_sizes: DataFrame, mixing: DataFrame) -> DataFrame:
    """Shares reached: mixed_sizes has (source, n_tokens, copies) of each document in the mix."""
    got = mixed_sizes.groupBy(source_key("source").alias("source_key")).agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("got_tokens"), F.sum("copies").alias("n_copies")
    )
    x = mixing.join(got, "source_key", "left").na.fill(0, ["got_tokens", "n_copies"])
    total = x.agg(F.sum("got_tokens").alias("got_total"))
    return x.join(F.broadcast(total)).select(
        "source", "target_share", "max_repeats", "rate", "n_copies", "got_tokens",
        F.when(F.col("got_total") > 0, F.col("got_tokens") / F.col("got_total")).otherwise(0.0).alias("got_share")
    )
