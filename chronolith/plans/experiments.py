"""Experiments: programs that are saved with what they gave, and replayed to see whether they still give it."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.errors import EngineError
from chronolith.model import Graph
from chronolith.plans import program
from chronolith.session import claim, listed, read_text


def digest(value: Graph | DataFrame) -> dict:
    """Rows and a sum of row hashes of each frame of a result: independent of order and partitions."""
    frames = {"rows": value} if isinstance(value, DataFrame) else {"nodes": value.nodes, "edges": value.edges}
    if isinstance(value, Graph) and value.attachments is not None:
        frames["attachments"] = value.attachments
    out = {}
    for name, df in frames.items():
        row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
        n, total = df.agg(F.count(F.lit(1)), F.sum(row)).first()
        out[name] = [n, str(total or 0)]
    return out


class Experiments:
    """Named experiments in a folder; a name is saved once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def names(self) -> list[str]:
        return sorted(n for n in listed(self.spark, self.path) if not n.startswith("."))

    def save(self, name: str, text: str, catalog: program.Catalog, pins: dict[str, int] | None = None) -> list[dict]:
        """Run a program and keep it with the digests of its results and the heads it was run at (``pins``)."""
        found = [digest(v) for v in program.run(text, catalog)]
        body = {"program": text, "program_sha256": hashlib.sha256(text.encode()).hexdigest(), "pins": pins or {}, "results": found}
        if not claim(self.spark, f"{self.path}/{name}", json.dumps(body)):
            raise EngineError("E_EXPERIMENT", f"{name} exists")
        return found

    def replay(self, name: str, catalog: program.Catalog, pins: dict[str, int] | None = None) -> dict:
        """Run it again: {moved: inputs whose head is another, drifted: places of results that differ}."""
        if name not in self.names():
            raise EngineError("E_EXPERIMENT", f"{name} is unknown")
        kept = json.loads(read_text(self.spark, f"{self.path}/{name}"))
        if hashlib.sha256(kept["program"].encode()).hexdigest() != kept["program_sha256"]:
            raise EngineError("E_EXPERIMENT", "the program was altered")
        now = [digest(v) for v in program.run(kept["program"], catalog)]
        moved = sorted(k for k, v in kept["pins"].items() if (pins or {}).get(k) != v)
        return {"moved": moved, "drifted": [i for i, (a, b) in enumerate(zip(kept["results"], now)) if a != b]}
