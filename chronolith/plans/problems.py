"""The general data problems (p1 to p7) over the fleet tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions.refs import holding, micros, millis, reference
from chronolith.functions.times import text_millis
from chronolith.operators import asknown, hierarchy, incremental, intervals, orphans
from chronolith.sources.tables import table
from chronolith.session import scratch, shared_dir, written
from chronolith.streaming import changes, late


# 1. references to records that do not exist ---------------------------------------------------


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return orphans.orphans(
        [
            orphans.Parent("maintenance", t("maintenance"), "work_order"),
            orphans.Parent("sensors", t("sensors"), "sensor_id"),
            orphans.Parent("firmware", t("firmware"), "firmware_id", lower=True)
        ],
        [
            orphans.Child("part_installs", t("part_installs"), "install_id", "work_order", "maintenance"),
            orphans.Child("sensor_mounts", t("sensor_mounts"), "mount_id", "sensor_id", "sensors"),
            orphans.Child("firmware_installs", t("firmware_installs"), "install_id", "firmware_id", "firmware")
        ],
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("src_table", "record_key", "ref_month", "reason").distinct()


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(_orphans(spark, d))


# 2. applying changes --------------------------------------------------------------------------


def _facts_in_force(spark: SparkSession, d: str) -> DataFrame:
    s = changes.file_stream(spark, f"{d}/fact_log.parquet").select(
        "line", "kind", "id", "position", "received_at", "seq", "op", "valid_from", "valid_to"
    )
    state = changes.apply_changes(
        s, ["line", "kind", "id"], ["position", "received_at"], F.lower(F.trim("op")) == "retract",
        ["seq", "valid_from", "valid_to"]
    )
    return state.where("NOT removed")


def _deliveries_in_force(spark: SparkSession, d: str) -> DataFrame:
    """The newest delivery of each seq, from the stream of deliveries."""
    s = changes.file_stream(spark, f"{d}/updates.parquet").select(
        "seq", "received_at", "kind",
        F.transform("tables.maintenance", lambda m: reference(m["work_order"])).alias("work_orders")
    )
    withdrawn = F.regexp_replace(F.lower(F.trim("kind")), "-", "_") == "withdrawal"
    return changes.apply_changes(s, ["seq"], ["received_at"], F.coalesce(withdrawn, F.lit(False)), ["work_orders"])


def _work_orders_in_force(spark: SparkSession, d: str) -> DataFrame:
    each = _deliveries_in_force(spark, d).select(
        "seq", "removed", F.explode("work_orders").alias("work_order")
    ).where("work_order IS NOT NULL")
    top = each.groupBy("work_order").agg(F.max(F.struct("seq", "removed")).alias("t"))
    return top.where("NOT t.removed").select("work_order", "t.seq")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    facts = _facts_in_force(spark, d).select(
        F.lit("fact_log").alias("feed"), F.col("line").cast("long").alias("line"), "kind", "id",
        F.col("seq").cast("long").alias("seq")
    )
    orders = _work_orders_in_force(spark, d).select(
        F.lit("updates").alias("feed"), F.lit(0).cast("long").alias("line"), F.lit("maintenance").alias("kind"),
        F.col("work_order").alias("id"), F.col("seq").cast("long").alias("seq")
    )
    return facts.unionAll(orders)


def p2_lines(spark: SparkSession, d: str) -> DataFrame:
    """Facts in force per line and kind."""
    return _facts_in_force(spark, d).groupBy("line", "kind").agg(F.count(F.lit(1)).alias("n_facts"), F.max("seq").alias("last_seq"))


# 3. hierarchies -------------------------------------------------------------------------------


def _replacement_links(spark: SparkSession, d: str) -> DataFrame:
    held = holding(table(spark, d, "part_installs"), "install_id", "recorded_at", ["install_id", "part_serial", "replaces", "recorded_at"])
    part = held.where("part_serial IS NOT NULL").groupBy(F.upper(F.trim("part_serial")).alias("part")).agg(F.min("install_id").alias("parent"))
    return held.select(
        F.col("install_id").alias("child"), reference("replaces").alias("part")
    ).where("part IS NOT NULL").join(part, "part").select("child", "parent")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy.hierarchy(_replacement_links(spark, d))
    return tree.select(
        F.col("child").alias("install_id"), F.col("root").alias("root_install_id"),
        F.col("depth").cast("long").alias("depth")
    )


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every linked install with its path from the first install, as text."""
    tree = hierarchy.hierarchy(_replacement_links(spark, d), with_path=True)
    return tree.select(
        F.col("child").alias("install_id"), F.col("root").alias("root_install_id"), "depth",
        F.array_join("path", ">").alias("path")
    )


def p3_later(spark: SparkSession, d: str) -> DataFrame:
    """For each install with later ones: how many, and how far the last of them is."""
    pairs = hierarchy.ancestor_pairs(hierarchy.hierarchy(_replacement_links(spark, d), with_path=True))
    return pairs.groupBy(F.col("ancestor").alias("install_id")).agg(F.count(F.lit(1)).alias("n_later"), F.max("distance").alias("height"))


def p3_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Links whose way up runs in a circle."""
    links = _replacement_links(spark, d)
    return hierarchy.hierarchy(links).where("depth = -1").select(F.col("child").alias("install_id")).join(
        links.withColumnRenamed("child", "install_id"), "install_id"
    ).select("install_id", F.col("parent").alias("replaced_install_id"))


# 4. attributes as known at event time ----------------------------------------------------------


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    orders = holding(
        table(spark, d, "maintenance"), "work_order", "recorded_at", ["work_order", "serial", "started_at", "deleted_at", "recorded_at"]
    )
    events = written(orders.where("deleted_at IS NULL").select("work_order", "serial", micros("started_at").alias("at")), "events")

    def versions(name: str, field: str, value) -> DataFrame:
        times = (micros(c).alias(n) for c, n in (("valid_from", "lo"), ("valid_to", "hi"), ("recorded_at", "rec")))
        rows = table(spark, d, name).select("serial", "install_id", *times, value.alias("value"))
        return asknown.effective_versions(rows, "serial", "install_id", "lo", "hi", "rec", ["value"]).withColumn("field", F.lit(field))

    both = versions("firmware_installs", "firmware_id", reference("firmware_id", lower=True))
    both = both.unionAll(versions("part_installs", "part_serial", F.trim("part_serial")))
    known = asknown.as_known(events, both, "serial", "at")
    number = F.regexp_extract("v_key", r"([0-9]+)\s*$", 1).try_cast("decimal(38,0)")
    # of a work order's firmware the greatest counts, of its parts each: parts are told apart by their value
    order = F.struct("v_valid_lo", number.alias("n"), "v_key", "v_value")
    apart = F.when(F.col("v_field") == "part_serial", F.col("v_value")).alias("part")
    best = known.where("v_field = 'firmware_id' OR v_value IS NOT NULL").groupBy("work_order", F.col("v_field").alias("field"), apart)
    best = best.agg(F.max(order).alias("b")).where("b.v_value IS NOT NULL")
    return best.select("work_order", "field", F.col("b.v_value").alias("known_value"))


# 5. intervals ---------------------------------------------------------------------------------


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    def of(name: str, key: str, entity) -> DataFrame:
        rows = holding(
            table(spark, d, name), key, "recorded_at",
            sorted({key, "serial", "valid_from", "valid_to", "recorded_at", *(["sensor_id"] if name == "sensor_mounts" else [])})
        )
        return rows.select(
            F.lit(name).alias("src_table"), entity.alias("entity"), micros("valid_from").alias("lo"),
            micros("valid_to").alias("hi")
        )

    both = of("firmware_installs", "install_id", F.col("serial")).unionAll(of("sensor_mounts", "mount_id", reference("sensor_id")))
    out = intervals.periods_and_gaps(both, ["src_table", "entity"], "lo", "hi")
    ms = lambda c: F.floor(F.col(c) / 1000).cast("long")
    return out.select(
        "src_table", "entity", "what", ms("start").alias("start_ms"),
        F.coalesce(ms("end"), F.lit(-1).cast("long")).alias("end_ms")
    )


# 6. late events -------------------------------------------------------------------------------


#: Files the reports are laid out in by their time; the stream takes half of them a batch.
REPORT_FILES = 16


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """Maintenance entries of the deliveries that hold, as a stream of files in the order of their reports."""
    cols = ["seq", "source", "reported_at", "tables", "received_at"]
    rows = holding(table(spark, d, "updates").select(*cols), "seq", "received_at", cols)
    each = rows.select("seq", "source", text_millis("reported_at").alias("reported"), F.explode("tables.maintenance").alias("m"))
    at, ended = text_millis("m.started_at"), text_millis("m.ended_at")
    hours = F.when(F.col("ended") >= F.col("at"), (F.col("ended") - F.col("at")) / 3_600_000.0).otherwise(0.0)
    each = each.select("seq", "source", "reported", reference("m.work_order").alias("work_order"), at.alias("at"), ended.alias("ended"))
    path = scratch(spark, "reports")
    each.withColumn("hours", hours).repartitionByRange(REPORT_FILES, "reported").write.parquet(path)
    stream = spark.readStream.schema(each.withColumn("hours", hours).schema)
    return stream.option("maxFilesPerTrigger", REPORT_FILES // 2).parquet(path)


def _late(spark: SparkSession, d: str) -> tuple[late.LateEvents, DataFrame]:
    events = late.LateEvents(spark, scratch(spark, "late"), "hours")
    return events, events.run(_reports(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    _, verdicts = _late(spark, d)
    return verdicts.where("verdict <> 'on_time'").select(F.col("seq").cast("long").alias("seq"), "work_order", "verdict").distinct()


def p6_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Weekly counts and hours of work: as first known, corrected up to the cut-off, and diverted."""
    events, _ = _late(spark, d)
    hours = (F.round(f"sum_{c}", 4).alias(f"hours_{c}") for c in ("first", "corrected"))
    return events.periods().select("period_start", "n_first", "n_corrected", "n_diverted", *hours)


def p6_closings(spark: SparkSession, d: str) -> DataFrame:
    """When each week could be closed: every source past the bound, or silent for four weeks."""
    return _late(spark, d)[0].closings()


# 7. new or changed records only ---------------------------------------------------------------


#: Form of the content state; a state of another form is not read.
STATE_FORM = 1


def _runs(spark: SparkSession, d: str) -> DataFrame:
    cols = ["run_id", "feed", "scope", "run_status", "after_pos", "upto_pos", "started_at", "logged_at"]
    runs = holding(table(spark, d, "sync_runs"), "run_id", "logged_at", cols)
    ok = runs.where("lower(trim(run_status)) = 'succeeded' AND scope <> ''")
    return ok.select("feed", "scope", "after_pos", "upto_pos", micros("started_at").alias("started"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The state lies in the shared folder under a name made of the tables' folder, and is taken up by the next call."""
    facts, ups = table(spark, d, "fact_log"), table(spark, d, "updates")

    def hashed(t: DataFrame, feed: str, scope, pos: str) -> DataFrame:
        content = incremental.content_hash([c for c in t.columns if c != "received_at"], t)
        return t.select(
            F.lit(feed).alias("feed"), scope.alias("scope"), F.col(pos).cast("long").alias("pos"),
            micros("received_at").alias("received"), *content
        )

    records = hashed(
        facts, "fact_log", F.col("line").cast("string"), "position"
    ).unionAll(hashed(ups, "updates", F.coalesce("source", F.lit("")), "seq"))
    current = incremental.content_versions(records.where("scope IS NOT NULL AND pos IS NOT NULL"))
    tops = records.groupBy("feed", "scope").agg(F.max("pos").alias("top"))
    name = hashlib.sha256(d.encode()).hexdigest()[:16]
    state = incremental.ContentState(spark, f"{shared_dir(spark)}/content-state-{STATE_FORM}-{name}")
    return incremental.take_up(state, current, _runs(spark, d), tops)


QUERIES = {f.__name__: f for f in (
    p1_found, p1_counts, p2_found, p2_lines, p3_found, p3_paths, p3_later, p3_cycles, p4_found, p5_found, p6_found,
    p6_weeks, p6_closings, p7_found
)}
