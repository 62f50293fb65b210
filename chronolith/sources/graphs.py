"""The test tables as graphs: the star schema (business) and the hardware fleet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions.refs import holding, millis, reference
from chronolith.model import ATTACHMENT_COLS, EDGE_COLS, NODE_COLS, Graph
from chronolith.operators.access import reader_list
from chronolith.operators.facts import changes
from chronolith.sources.tables import table

THIRTY_DAYS = 30 * 86_400_000


def _id(kind: str, *cols: str) -> Column:
    return F.concat_ws(":", F.lit(kind), *(F.col(c).cast("string") for c in cols))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def _node(
    df: DataFrame, id_: Column, entity: Column, space: str, type_: str, start: Column | None = None,
    end: Column | None = None, readers: Column | None = None
) -> DataFrame:
    none = F.lit(None).cast("long")
    cols = [
        id_, entity, F.lit(space), F.lit(type_), start if start is not None else none, end if end is not None else none,
        readers if readers is not None else F.array().cast("array<string>")
    ]
    return df.select(*(c.alias(n) for c, n in zip(cols, NODE_COLS)))


def _edge(
    df: DataFrame, id_: Column, predicate: str, src: Column, dst: Column, start: Column | None = None,
    end: Column | None = None, polarity: Column | None = None, context: Column | None = None,
    readers: Column | None = None
) -> DataFrame:
    cols = [
        id_, F.lit(predicate), src, dst, start if start is not None else F.lit(0).cast("long"), end if end is not None else F.lit(None).cast("long"),
        polarity if polarity is not None else F.lit("positive"), context if context is not None else F.lit(None).cast("string"), readers if readers is not None else F.array().cast("array<string>"),
    ]
    return df.select(*(c.alias(n) for c, n in zip(cols, EDGE_COLS)))


def star(spark: SparkSession, d: str) -> Graph:
    """Nodes of regions, nations, customers, suppliers (in two spaces), parts and orders; edges from the keys.

    An edge is a projection of its table with constants, so a condition on
    ``predicate`` drops the other tables from the plan."""
    t = {n: table(spark, d, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    order_ms, ship_ms = millis("o_orderdate"), millis("l_shipdate")
    plain = lambda n, k, c: _node(t[n], _id(k, c), _id(k, c), "biz", k)
    nodes = _all([
        plain("region", "region", "r_regionkey"), plain("nation", "nation", "n_nationkey"), plain("supplier", "supplier", "s_suppkey"), plain("part", "part", "p_partkey"),
        _node(
            t["customer"], _id("customer", "c_custkey"), _id("customer", "c_custkey"), "biz", "customer",
            readers=F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("alice"))).otherwise(F.array().cast("array<string>"))
        ),
        _node(t["orders"], _id("order", "o_orderkey"), _id("order", "o_orderkey"), "biz", "order", order_ms),
        _node(t["supplier"], _id("geo:supplier", "s_suppkey"), _id("supplier", "s_suppkey"), "geo", "supplier"),
    ])
    line = _id("", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    edges = _all([
        _edge(t["nation"], _id("in_region:nation", "n_nationkey"), "in_region", _id("nation", "n_nationkey"), _id("region", "n_regionkey")),
        _edge(
            t["customer"], _id("in_nation:customer", "c_custkey"), "in_nation", _id("customer", "c_custkey"),
            _id("nation", "c_nationkey")
        ),
        _edge(
            t["supplier"], _id("in_nation:supplier", "s_suppkey"), "in_nation", _id("supplier", "s_suppkey"),
            _id("nation", "s_nationkey")
        ),
        _edge(t["orders"], _id("placed_by", "o_orderkey"), "placed_by", _id("order", "o_orderkey"), _id("customer", "o_custkey"), order_ms),
        _edge(
            t["lineitem"], F.concat(F.lit("contains"), line), "contains", _id("order", "l_orderkey"),
            _id("part", "l_partkey"), ship_ms, ship_ms + THIRTY_DAYS,
            F.when(F.col("l_returnflag") == "R", "negative").otherwise("positive"),
            F.when(F.col("l_linestatus") == "O", "open")
        ),
        _edge(
            t["lineitem"], F.concat(F.lit("supplied_by"), line), "supplied_by", _id("part", "l_partkey"),
            _id("supplier", "l_suppkey"), ship_ms
        ),
        _edge(
            t["supplier"], _id("bridge:supplier", "s_suppkey"), "same_entity", _id("supplier", "s_suppkey"),
            _id("geo:supplier", "s_suppkey")
        ),
    ])
    return Graph(nodes, edges)


def unit_records(g: Graph) -> DataFrame:
    """(unit, kind, id, content) of the edges that touch a unit, the attachments on it and itself."""
    e = g.edges.select(
        F.explode(F.array("src", "dst")).alias("unit"), F.lit("edge").alias("kind"), "id",
        F.to_json(F.struct(*EDGE_COLS)).alias("content")
    )
    n = g.nodes.select(F.col("id").alias("unit"), F.lit("node").alias("kind"), "id", F.to_json(F.struct(*NODE_COLS)).alias("content"))
    both = e.unionAll(n)
    if g.attachments is not None:
        body = F.to_json(F.struct(*ATTACHMENT_COLS)).alias("content")
        both = both.unionAll(g.attachments.where("host_kind = 'node'").select(
            F.col("host_id").alias("unit"), F.lit("attachment").alias("kind"), "id", body
        ))
    return both.where("unit LIKE 'unit:%'").distinct()


def unit_changes(before: Graph, after: Graph) -> DataFrame:
    """(unit, kind, id, change): records of each unit that were added, removed or corrected between two states."""
    found = changes(unit_records(before), unit_records(after), ["unit", "kind", "id"])
    name = F.when(F.col("change") == "asserted", "added").when(F.col("change") == "retracted", "removed").otherwise("corrected")
    return found.select("unit", "kind", "id", name.alias("change"))


def fleet(spark: SparkSession, d: str, recorded_by: int | None = None) -> Graph:
    """Units, parts, firmware and sensors; installed_in, runs and measured_by over the rows that hold, with their
    intervals; maintenance notes as attachments of units.  Rows without an interval, or whose reference means
    none, give no edge.  ``recorded_by``: as rows recorded by that time (ms) told."""
    def told(name: str) -> DataFrame:
        t = table(spark, d, name)
        return t if recorded_by is None else t.where(millis("recorded_at") <= recorded_by)

    def rows(name: str, key: str, *cols: str) -> DataFrame:
        h = holding(told(name), key, "recorded_at", [key, "serial", "valid_from", "valid_to", "readers", "recorded_at", *cols])
        return h.withColumn("lo", millis("valid_from")).withColumn("hi", millis("valid_to")).where("lo IS NOT NULL AND (hi IS NULL OR hi > lo) AND serial IS NOT NULL")

    pi, fi, sm = rows("part_installs", "install_id", "part_serial"), rows(
        "firmware_installs", "install_id", "firmware_id"
    ).withColumn(
        "fw", reference("firmware_id", lower=True)
    ), rows("sensor_mounts", "mount_id", "sensor_id").withColumn("sn", reference("sensor_id"))
    lo, hi, rd = F.col("lo"), F.col("hi"), reader_list("readers")
    edges = _all([
        _edge(
            pi.where("part_serial IS NOT NULL"), _id("installed_in", "install_id"), "installed_in",
            _id("part", "part_serial"), _id("unit", "serial"), lo, hi, readers=rd
        ),
        _edge(fi.where("fw IS NOT NULL"), _id("runs", "install_id"), "runs", _id("unit", "serial"), _id("fw", "fw"), lo, hi, readers=rd),
        _edge(
            sm.where("sn IS NOT NULL"), _id("measured_by", "mount_id"), "measured_by", _id("unit", "serial"),
            _id("sensor", "sn"), lo, hi, readers=rd
        ),
    ])
    ends = edges.select(F.explode(F.array("src", "dst")).alias("x")).distinct()
    nodes = _node(ends, F.col("x"), F.col("x"), "fleet", "thing").withColumn("type_id", F.substring_index("id", ":", 1))
    notes = holding(
        told("maintenance"), "work_order", "recorded_at",
        ["work_order", "serial", "note", "started_at", "readers", "deleted_at", "recorded_at"]
    ).where("note IS NOT NULL AND started_at IS NOT NULL AND deleted_at IS NULL")
    att = notes.select(
        _id("note", "work_order").alias("id"), F.lit("node").alias("host_kind"), _id("unit", "serial").alias("host_id"),
        F.lit("hw:note").alias("key"), F.col("note").alias("value"), millis("started_at").alias("valid_start"),
        F.lit(None).cast("long").alias("valid_end"), reader_list("readers").alias("readers")
    )
    return Graph(nodes, edges, att)


def heads(spark: SparkSession, d: str) -> DataFrame:
    """One row per recorded revision of the fact log."""
    return table(spark, d, "fact_log").groupBy("graph_id", "branch_id", "line", "seq").agg(
        F.max("recorded_at_ms").alias("recorded_at_ms"), F.max("revision").alias("revision")
    )
