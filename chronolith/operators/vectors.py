"""Exact vector search and geometry.

Single queries stay in the JVM: a fold over the components in order, in double,
then TakeOrderedAndProject.  Searches with many queries go in blocks: a bounded
block of query vectors is sent to all tasks, each keeps the k best of its rows
per query, and these are merged; no pair of rows ever becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.errors import EngineError
from chronolith.operators.prefix import running_sums
from chronolith.session import scratch, written

COSINE, EUCLIDEAN = "cosine_distance", "euclidean"
MAX_K = 1000
#: Query vectors in one block, and results that a task keeps for it; queries and rows of one matrix product.
BLOCK, KEPT = 16_384, 1 << 22
PIECE, CHUNK = 1024, 4096
#: Milliseconds after all valid times.
NEVER = 2**62


def _fold(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str) -> Column:
    """Distance of two arrays of equal length; cosine clamped to [0, 2], null for a zero vector or unequal lengths."""
    ok = F.size(a) == F.size(b)
    if metric == EUCLIDEAN:
        return F.when(ok, F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y))))
    if metric != COSINE:
        raise EngineError("E_METRIC", metric)
    dot, aa, bb = _fold(a, b, lambda x, y: x * y), _fold(a, a, lambda x, y: x * y), _fold(b, b, lambda x, y: x * y)
    return F.when(ok & (aa > 0) & (bb > 0), F.least(F.greatest(1.0 - dot / (F.sqrt(aa) * F.sqrt(bb)), F.lit(0.0)), F.lit(2.0)))


def nearest(
    vectors: DataFrame, query: Sequence[float] | None, k: int, metric: str = COSINE, id_col: str = "id", vec: str = "vector",
    candidates: DataFrame | None = None, exclude: object = None, of: object = None, subject: str | None = None,
    valid_at: int | None = None, valid: tuple[str, str] = ("valid_start", "valid_end"),
) -> DataFrame:
    """(id, score, rank) of the k nearest by (score, id); candidates (id) restricts the rows before ranking.

    Instead of a ``query``, ``of`` names an embedding, whose own subject (``subject``
    column; without one, itself) is left out; a missing or hidden one is
    E_EMBEDDING.  ``valid_at`` keeps embeddings that hold then, by the columns
    ``valid``, before ranking.  Rows of another length, null or zero vectors are no
    candidates.  The final rank is over k rows at most."""
    if not 1 <= k <= MAX_K:
        raise EngineError("E_K", f"1 to {MAX_K}")
    if (query is None) == (of is None):
        raise EngineError("E_QUERY", "a vector or an embedding")
    rows = vectors.where(F.col(vec).isNotNull())
    if valid_at is not None:
        lo, hi = (F.col(c) for c in valid)
        rows = rows.where((lo <= valid_at) & (hi.isNull() | (hi > valid_at)))
    if of is not None:
        own = rows.where(F.col(id_col) == F.lit(of)).select(
            F.col(vec).alias("v"), (F.col(subject) if subject else F.col(id_col)).alias("s")
        ).first()
        if own is None:
            raise EngineError("E_EMBEDDING", str(of))
        query, exclude = own["v"], of
        if subject and own["s"] is not None:
            rows = rows.where(F.col(subject).isNull() | (F.col(subject) != F.lit(own["s"])))
    if candidates is not None:
        rows = rows.join(candidates.select(F.col("id").alias(id_col)), id_col, "left_semi")
    if exclude is not None:
        rows = rows.where(F.col(id_col) != F.lit(exclude))
    q = F.array(*(F.lit(float(x)) for x in query))
    top = rows.select(
        F.col(id_col).alias("id"), distance(F.col(vec), q, metric).alias("score")
    ).where("score IS NOT NULL").orderBy("score", "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("score", "id")))


def nearest_vectors(nodes: DataFrame, query: Sequence[float], k: int, space: str, metric: str = COSINE, vec: str = "vector") -> DataFrame:
    """(id, entity_id, space_id, distance) of the k nodes of a space whose vector property is nearest, by (distance, id).

    Nodes without the property are passed over; a vector of another length, with
    a coordinate that is no number, or (cosine) of zeros fails the query
    (E_VECTOR).  Cosine is taken of vectors scaled by their greatest coordinate,
    so that no square overflows."""
    if k < 1 or not len(query) or not np.isfinite(query).all() or (metric == COSINE and not np.any(query)):
        raise EngineError("E_VECTOR", "query")
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    biggest = F.array_max(F.transform(v, F.abs))
    bad = (F.size(v) != len(query)) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if metric == COSINE:
        top = max(abs(float(x)) for x in query)
        q = np.array(query, float) / top
        q = F.array(*(F.lit(float(x)) for x in q / np.sqrt((q * q).sum())))
        scaled = F.transform(v, lambda x: x / biggest)
        norm = F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x * x))
        cosine = F.aggregate(F.zip_with(scaled, q, lambda x, y: x / norm * y), F.lit(0.0), lambda s, x: s + x)
        found, bad = 1.0 - F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)), bad | (biggest == 0)
    elif metric == EUCLIDEAN:
        q = F.array(*(F.lit(float(x)) for x in query))
        found = F.aggregate(F.zip_with(v, q, lambda x, y: x - y), F.lit(0.0), F.hypot)
    else:
        raise EngineError("E_METRIC", metric)
    checked = F.when(bad, F.raise_error(F.lit("E_VECTOR")).cast("double")).otherwise(found)
    rows = nodes.where((F.col("space_id") == space) & F.col(vec).isNotNull())
    return rows.select("id", "entity_id", "space_id", checked.alias("distance")).orderBy("distance", "id").limit(k)


def embedding_facts(nodes: DataFrame, vec: str, dimensions: int) -> DataFrame:
    """(id, subject, vector array<float>, valid_start, valid_end, readers) from a vector property: what a conversion would write.

    A vector that is not of the space, or does not fit single precision, fails it (E_VECTOR)."""
    v = F.transform(F.col(vec), lambda x: x.cast("float"))
    bad = (F.size(F.col(vec)) != dimensions) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    checked = F.when(bad, F.raise_error(F.lit("E_VECTOR")).cast("array<float>")).otherwise(v)
    rows = nodes.where(F.col(vec).isNotNull())
    return rows.select(
        F.concat(F.lit("embedding:"), "id").alias("id"), F.col("id").alias("subject"), checked.alias("vector"),
        "valid_start", "valid_end", "readers"
    )


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.sqrt((m * m).sum(axis=1))
    return m / np.where(n > 0, n, 1)[:, None], n > 0


def knn(
    vectors: DataFrame, queries: DataFrame, k: int, metric: str = COSINE, id_col: str = "id", vec: str = "vector",
    block: int = BLOCK, subject: str | None = None, valid: tuple[str, str] | None = None
) -> DataFrame:
    """(query_id, id, score, rank): the k nearest others of every query row, exactly.

    ``queries`` are the sources, ``vectors`` the targets.  With ``subject``, rows
    of the query's own subject take no place among the k; with ``valid`` (names of start
    and end in ms, end null = open), nor do rows whose valid time doesn't
    overlap the query's.  A null subject is no one's; a null start is never valid.

    Ids are long and unique, vectors of one length (others, nulls and - for
    cosine - zero vectors are left out).  Queries are written once, in blocks of
    ids; a block at a time comes to the driver and is sent to the tasks, bounded by
    ``block`` and by the k best it keeps in each.  One block gives a lazy result;
    of several, each is searched and written before the next is sent.  Ties go
    to the lesser id.
    """
    if not 1 <= k <= MAX_K:
        raise EngineError("E_K", f"1 to {MAX_K}")
    spark = vectors.sparkSession
    who = F.col(subject).cast("string") if subject else F.lit(None).cast("string")
    # no valid time asked for: all hold always; null start: an interval that overlaps none
    start = F.coalesce(F.col(valid[0]).cast("long"), F.lit(NEVER)) if valid else F.lit(-NEVER)
    end = F.coalesce(F.col(valid[1]).cast("long"), F.lit(NEVER)) if valid else F.lit(NEVER)
    cols = [F.col(id_col).cast("long").alias("id"), F.col(vec).alias("v"), who.alias("who"), start.alias("vs"), end.alias("ve")]
    here = F.col(id_col).isNotNull() & F.col(vec).isNotNull()
    rows = vectors.where(here).select(*cols)
    asked = queries.where(here).select(*cols)
    block = max(1, min(block, KEPT // k))
    n = asked.count()
    if n > block:
        # blocks of at most `block` queries, by rank of id, each a folder of its own
        ranks = running_sums(asked.select("id", F.lit(1).alias("_one")), [], "id", {"_rank": "_one"}, block=10**6)
        numbered = asked.join(ranks.select("id", F.floor((F.col("_rank") - 1) / block).alias("part")), "id")
        path = scratch(spark, "queries")
        numbered.repartition("part").write.partitionBy("part").parquet(path)
        blocks = [spark.read.schema(asked.schema).parquet(f"{path}/part={i}") for i in range(-(-n // block))]
    else:
        blocks = [asked] if n else []
    out = None
    for part in blocks:
        got = part.orderBy("id").toArrow()
        ids, lists = got.column("id").to_numpy(), got.column("v").to_pylist()
        dim = max(map(len, lists))
        ok = np.array([len(x) == dim for x in lists])
        codes: dict[str, int] = {}
        own = np.array([-2 if x is None else codes.setdefault(x, len(codes)) for x in got.column("who").to_pylist()], np.int64)
        limits = [got.column(c).to_numpy()[ok] for c in ("vs", "ve")]
        shared = spark.sparkContext.broadcast((
            ids[ok], np.array([x for x, o in zip(lists, ok) if o], np.float64).reshape(-1, dim), codes, own[ok], *limits
        ))
        w = Window.partitionBy("query_id").orderBy("score", "id")
        best = _block(rows, shared, k, metric).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        if len(blocks) > 1:
            best = written(best, "nearest")
            shared.unpersist()
        out = best if out is None else out.unionAll(best)
    return out if out is not None else spark.createDataFrame([], "query_id long, id long, score double, rank int")


def _best(s0: np.ndarray, i0: np.ndarray, s: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of those kept and the new ones, by (score, id)."""
    s, i = np.concatenate((s0, s), axis=1), np.concatenate((i0, np.broadcast_to(i, (len(s), len(i)))), axis=1)
    if s.shape[1] <= k:
        return s, i
    # all that tie with the k-th stay in the running until the ids decide
    kth = np.partition(s, k - 1, axis=1)[:, k - 1]
    width = int((s <= kth[:, None]).sum(axis=1).max())
    order = np.argsort(s, axis=1, kind="stable")[:, :width]
    s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
    order = np.lexsort((i, s), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def _block(rows: DataFrame, shared, k: int, metric: str) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q, codes, own, qs, qe = shared.value
        dim = q.shape[1]
        if metric == COSINE:
            q, live = _unit(q)
            qid, q, own, qs, qe = qid[live], q[live], own[live], qs[live], qe[live]
        qq = (q * q).sum(axis=1)
        best = {}  # by the first query of a stretch of PIECE
        for b in batches:
            col = b.column(1)
            off = np.asarray(col.offsets)
            good = np.flatnonzero(np.diff(off) == dim)
            flat = col.values.to_numpy(zero_copy_only=False)
            ids = b.column(0).to_numpy()
            who = np.array([codes.get(x, -1) for x in b.column(2).to_pylist()], np.int64) if codes else np.full(len(ids), -1)
            vs, ve = b.column(3).to_numpy(), b.column(4).to_numpy()
            for c in range(0, len(good), CHUNK):
                at = good[c : c + CHUNK]
                m = flat[off[at][:, None] + np.arange(dim)].astype(np.float64)
                i, o, s0, s1 = ids[at], who[at], vs[at], ve[at]
                if metric == COSINE:
                    m, live = _unit(m)
                    m, i, o, s0, s1 = m[live], i[live], o[live], s0[live], s1[live]
                for p in range(0, len(qid), PIECE):
                    of = slice(p, p + PIECE)
                    if metric == COSINE:
                        s = np.clip(1.0 - q[of] @ m.T, 0.0, 2.0)
                    else:
                        s = np.sqrt(np.maximum(qq[of, None] - 2 * (q[of] @ m.T) + (m * m).sum(axis=1)[None, :], 0.0))
                    apart = np.maximum(qs[of, None], s0) >= np.minimum(qe[of, None], s1)
                    s[(qid[of, None] == i) | (own[of, None] == o) | apart] = np.inf
                    best[p] = _best(*best.get(p, (s[:, :0], np.zeros((len(s), 0), np.int64))), s, i, k)
        for p, (s, i) in best.items():
            keep = np.isfinite(s)
            of = np.repeat(qid[p : p + PIECE], keep.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(i[keep]), pa.array(s[keep])], names=["query_id", "id", "score"])

    return rows.mapInArrow(search, "query_id long, id long, score double")


def similar_candidates(hits: DataFrame, max_score: float | None = None, linked: DataFrame | None = None) -> DataFrame:
    """Pairs (low, high, score) from knn hits: first the k nearest (of those that may be paired: ``subject`` and ``valid`` of knn), then ``max_score``, then oriented and
    deduplicated, then without pairs already linked (low, high) either way."""
    x = hits if max_score is None else hits.where(F.col("score") <= max_score)
    p = x.groupBy(F.least("query_id", "id").alias("low"), F.greatest("query_id", "id").alias("high")).agg(F.min("score").alias("score"))
    if linked is not None:
        k = linked.select(F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high")).distinct()
        p = p.join(k, ["low", "high"], "left_anti")
    return p


# geometry -------------------------------------------------------------------------------------

#: Metres in a unit.
UNITS = {"m": 1.0, "cm": 0.01, "mm": 0.001}


def geometry_distance(
    a: DataFrame, b: DataFrame, on: str, frame: str = "frame", unit: str = "unit", role: str = "role",
    value: str = "value"
) -> DataFrame:
    """(on, distance) of two positions; descriptors must be equal field by field and no side a direction, else null."""
    j = a.select(on, *(F.col(c).alias(f"a_{c}") for c in (frame, unit, role, value))).join(
        b.select(on, *(F.col(c).alias(f"b_{c}") for c in (frame, unit, role, value))), on
    )
    same = (F.col(f"a_{frame}") == F.col(f"b_{frame}")) & (F.col(f"a_{unit}") == F.col(f"b_{unit}")) & (F.col(f"a_{role}") == F.col(f"b_{role}")) & (F.col(f"a_{role}") != "direction")
    return j.select(on, F.when(same, distance(F.col(f"a_{value}"), F.col(f"b_{value}"), EUCLIDEAN)).alias("distance"))


def rigid_transform(
    value: Column, rotation: Sequence[Sequence[float]], translation: Sequence[float], from_unit: str, to_unit: str,
    direction: bool = False
) -> Column:
    """Rotate, scale to the new unit and (positions only) move; the rotation must be orthonormal and right-handed to 1e-10."""
    r = np.array(rotation, float)
    if r.shape != (3, 3) or np.abs(r @ r.T - np.eye(3)).max() > 1e-10 or abs(np.linalg.det(r) - 1) > 1e-10:
        raise EngineError("E_TRANSFORM", "not a rotation")
    s = UNITS[from_unit] / UNITS[to_unit]
    at = lambda i: F.element_at(value, i + 1).cast("double")
    return F.array(*(sum(
        (F.lit(float(r[i, j])) * at(j) for j in range(1, 3)), F.lit(float(r[i, 0])) * at(0)
    ) * s + (0.0 if direction else float(translation[i])) for i in range(3)))


def project_axes(value: Column, axes: Sequence[int]) -> Column:
    """Three different components, for display."""
    if len(axes) != 3 or len(set(axes)) != 3 or min(axes) < 0:
        raise EngineError("E_AXES", str(axes))
    return F.array(*(F.element_at(value, a + 1) for a in axes))
