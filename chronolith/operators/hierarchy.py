"""Parent-child links of unknown depth: paths, depths, roots, descendants, cycles.

Method: level-wise frontier joins.  The frontier starts at the roots; a join
with the links yields the next levels.  A job takes several levels at once: the
links are first joined with themselves to ways of up to ``WIDTH`` links, so that
one join of the frontier with the ways extends it by as many levels.  What a
job reaches is written to the shared folder.  When half of the links have been
passed, the ways are made anew of those that are left, so long tails of few
trees don't read all links again.  As a node has one parent, a node is met at
most once; linked nodes that are never met go round in circles or hang below a
circle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.session import scratch, written

CYCLE = "cycle"
#: Levels of the first job, which passes most links of shallow trees, and of later ones: more where few links are left.
FIRST, WIDTH, WIDE, FEW = 4, 16, 64, 1 << 20
#: The ways are made anew when at least this share of their links has been passed.
PASSED = 0.5


def hierarchy(links: DataFrame, levels_per_job: int | None = None, with_path: bool = False, max_levels: int | None = None) -> DataFrame:
    """From links (child, parent), text, to one row per linked child: (child, root, depth[, path]).

    A child with several different parents keeps the least one; rows with a
    null, and repeats, are dropped; a child that is its own parent is a circle.
    Children whose way up enters a circle get root ``cycle``, depth -1 (and a
    null path).  ``path`` is the array of nodes from the root to the child.
    A tree deeper than ``max_levels`` is E_DEPTH; None: any depth.
    ``levels_per_job`` is rounded down to a power of two; None: by the links left.
    """
    spark = links.sparkSession
    clean = links.where("child IS NOT NULL AND parent IS NOT NULL")
    edges = written(clean.groupBy("child").agg(F.min("parent").alias("parent")), "links")
    tops = edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")
    path = [F.array("node").alias("path")] if with_path else []
    frontier = tops.select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), *path)
    schema, parts, since, level = frontier.schema, [], 0, 0
    read = lambda *p: spark.read.schema(schema).parquet(*p)
    left, n_left, n_passed = edges, edges.count(), 0
    ways, width = _ways(left, min(FIRST, levels_per_job or FIRST))
    while True:
        parts.append(scratch(spark, "levels"))
        _below(frontier, ways, with_path).write.parquet(parts[-1])
        n, deepest = read(parts[-1]).agg(F.count(F.lit(1)), F.max("depth")).first()
        level += width
        if max_levels is not None and n and deepest > max_levels:
            raise ValueError(f"E_DEPTH: trees are deeper than {max_levels} levels")
        if not n or deepest < level:
            break
        frontier, n_passed = read(parts[-1]).where(F.col("depth") == level), n_passed + n
        if len(parts) == 1 or n_passed >= PASSED * n_left:
            done = read(*parts[since:]).select(F.col("node").alias("child"))
            left = written(left.join(done, "child", "left_anti"), "links")
            n_left, n_passed, since = n_left - n_passed, 0, len(parts)
            ways, width = _ways(left, levels_per_job or (WIDE if n_left <= FEW else WIDTH))
    reached = read(*parts).withColumnRenamed("node", "child")
    none = [F.lit(None).cast("array<string>").alias("path")] if with_path else []
    circling = edges.join(reached.select("child"), "child", "left_anti")
    circling = circling.select("child", F.lit(CYCLE).alias("root"), F.lit(-1).cast("long").alias("depth"), *none)
    return reached.select(*circling.columns).unionAll(circling)


def _ways(edges: DataFrame, width: int) -> tuple[DataFrame, int]:
    """(top, way): every way down of ``width`` links, and every shorter one that ends with them; and the width.

    There are at most ``width`` times as many as links.  A way that has ended
    looks for a name that no node has, so that ended ways are spread over the
    tasks of the next join."""
    ways, length = edges.select(F.col("parent").alias("top"), F.array("child").alias("way")), 1
    while 2 * length <= width:
        more = ways.select(F.col("top").alias("_end"), F.col("way").alias("_more"))
        none = F.concat(F.lit("\u0000"), F.element_at("way", -1))
        end = F.when(F.size("way") == length, F.element_at("way", -1)).otherwise(none)
        longer = F.when(F.col("_more").isNull(), F.col("way")).otherwise(F.concat("way", "_more"))
        ways = written(ways.join(more, end == F.col("_end"), "left").select("top", longer.alias("way")), "ways")
        length *= 2
    return ways, length


def _below(frontier: DataFrame, ways: DataFrame, with_path: bool) -> DataFrame:
    """The nodes on the ways down from the frontier, each once."""
    far = frontier.join(ways, F.col("node") == F.col("top")).select(
        "root", "depth", *(["path"] if with_path else []), "way", F.posexplode("way").alias("_i", "node")
    )
    below = [F.concat("path", F.slice("way", F.lit(1), F.col("_i") + 1)).alias("path")] if with_path else []
    return far.select("node", "root", (F.col("depth") + F.col("_i") + 1).alias("depth"), *below).dropDuplicates(["node"])


def ancestor_pairs(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for every node below another, from hierarchy(with_path=True).

    The size is the sum of all depths: as large as the answer, and no larger.
    """
    above = F.slice("path", F.lit(1), F.size("path") - 1)
    pairs = tree.where("path IS NOT NULL").select(F.posexplode(above).alias("pos", "ancestor"), F.col("child").alias("descendant"), "depth")
    return pairs.select("ancestor", "descendant", (F.col("depth") - F.col("pos")).cast("long").alias("distance"))
