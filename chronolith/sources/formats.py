"""Reading and writing files: fleet CSV directories, JSON batches, update lines, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from chronolith.errors import EngineError
from chronolith.functions.times import text_millis
from chronolith.operators.access import reader_list
from chronolith.session import scratch

SHARED = ("readers", "source", "evidence_uri", "evidence_digest")


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], key: str, multi_line: bool = False) -> DataFrame:
    """One table of text cells with a header.  Unknown columns are an error (E_COLUMN), known ones that are
    absent are null; malformed rows fail the read.  Rows without a key are an error when met (E_KEY).

    Cells may not hold line ends unless ``multi_line``, which reads each file in one task."""
    with_header = spark.read.option("header", True).option("inferSchema", False)
    head = with_header.csv(path).columns
    known = [*columns, *SHARED]
    if bad := [c for c in head if c not in known]:
        raise EngineError("E_COLUMN", ", ".join(bad))
    strict = with_header.schema(StructType([StructField(c, StringType()) for c in head])).option("mode", "FAILFAST").option("escape", '"')
    df = strict.option("multiLine", multi_line).csv(path)
    df = df.select(*(F.col(c) if c in head else F.lit(None).cast("string").alias(c) for c in known))
    return df.withColumn(key, F.when(F.trim(key) != "", F.trim(key)).otherwise(F.raise_error(F.lit("E_KEY"))))


def _names(schema: StructType) -> list[str]:
    return [f.name for f in schema.fields]


def read_updates(spark: SparkSession, path: str, schema: StructType, columns: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """JSON lines of updates with a declared schema.  Fields not declared, at the top, among the tables, or (``columns``)
    in their rows, and lines that are no JSON object, fail the read when met (E_FIELD)."""
    raw = spark.read.text(path).where("trim(value) <> ''")
    rows = F.from_json("value", "tables map<string,array<map<string,string>>>")["tables"]
    declared = lambda names: F.array(*(F.lit(n) for n in names)).cast("array<string>")
    beyond = lambda keys, names: F.size(F.array_except(keys, declared(names))) > 0
    top = F.json_object_keys("value")
    bad = top.isNull() | beyond(top, _names(schema))
    tables = next((f.dataType for f in schema.fields if f.name == "tables"), None)
    if isinstance(tables, StructType):
        bad = bad | F.coalesce(beyond(F.map_keys(rows), _names(tables)), F.lit(False))
        for name, cols in (columns or {f.name: _names(f.dataType.elementType) for f in tables.fields}).items():
            used = F.flatten(F.transform(rows[name], lambda r: F.map_keys(r)))
            bad = bad | F.coalesce(beyond(used, cols), F.lit(False))
    checked = F.when(bad, F.raise_error(F.lit("E_FIELD")).cast("string")).otherwise(F.col("value"))
    return raw.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("u")).select("u.*")


def read_batch(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A JSON batch {source?, tables: {name: [row]}}, a file each: (source, tables), as strict as read_updates."""
    whole = spark.read.text(path, wholetext=True)
    flat = scratch(spark, "batch")
    whole.select(F.regexp_replace("value", r"[\r\n]+", " ")).write.text(flat)
    return read_updates(spark, flat, schema)


def update_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def edge_rows(
    df: DataFrame, table: str, key: str, edges: Sequence[tuple[str, str, str, str]], start: str | None = None,
    end: str | None = None
) -> DataFrame:
    """Rows as edges: (predicate, source column, target column, gating column) each; the gate null means no such edge."""
    lo = text_millis(start) if start else F.lit(0).cast("long")
    hi = text_millis(end) if end else F.lit(None).cast("long")
    made = F.array(*(
        F.when(
            F.col(gate).isNotNull(),
            F.struct(F.concat_ws(":", F.lit(p), key).alias("id"), F.lit(p).alias("predicate"), F.col(a).alias("src"), F.col(b).alias("dst"))
        ) for p,
        a, b, gate in edges
    ))
    readers = reader_list("readers") if "readers" in df.columns else F.array().cast("array<string>")
    return df.select(
        F.explode(F.filter(made, lambda x: x.isNotNull())).alias("e"), lo.alias("valid_start"), hi.alias("valid_end"),
        readers.alias("readers"), F.lit(table).alias("from_table")
    ).select(
        "e.*", "valid_start", "valid_end", F.lit("positive").alias("polarity"),
        F.lit(None).cast("string").alias("context"), "readers", "from_table"
    )


def node_rows(
    df: DataFrame, kind: str, key: str, space: str, properties: Sequence[str], start: str | None = None,
    end: str | None = None
) -> DataFrame:
    """Rows as nodes (model.NODE) with ``properties``, a map of the cells that are not empty."""
    none = F.lit(None).cast("long")
    cells = F.map_from_entries(F.filter(
        F.array(*(F.struct(F.lit(p).alias("k"), F.col(p).cast("string").alias("v")) for p in properties)),
        lambda e: e["v"].isNotNull()
    ))
    readers = reader_list("readers") if "readers" in df.columns else F.array().cast("array<string>")
    name = F.concat_ws(":", F.lit(kind), key)
    return df.select(
        name.alias("id"), name.alias("entity_id"), F.lit(space).alias("space_id"), F.lit(kind).alias("type_id"), (text_millis(start) if start else none).alias("valid_start"),
        (text_millis(end) if end else none).alias("valid_end"), readers.alias("readers"), cells.alias("properties"),
    )


def note_rows(df: DataFrame, kind: str, key: str, note: str, name: str, start: str) -> DataFrame:
    """Rows with a note as attachments of their node (model.ATTACHMENT); a row without one, or without a time, gives none."""
    readers = reader_list("readers") if "readers" in df.columns else F.array().cast("array<string>")
    rows = df.withColumn("_at", text_millis(start)).where(F.col(note).isNotNull() & F.col("_at").isNotNull())
    return rows.select(
        F.concat_ws(":", F.lit("note"), key).alias("id"), F.lit("node").alias("host_kind"), F.concat_ws(":", F.lit(kind), key).alias("host_id"), F.lit(name).alias("key"),
        F.col(note).alias("value"), F.col("_at").alias("valid_start"), F.lit(None).cast("long").alias("valid_end"), readers.alias("readers"),
    )


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with nested cells as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
