"""Live views: registered expressions whose stored results are refreshed, compared and read only while current.

A view is a plan that gives (id, content).  A refresh writes the result of
the whole plan to a folder of its own and claims the next generation of the view
with one file that tells the folder, the tick and the heads of its inputs; what
changed is the difference of two generations.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.errors import EngineError
from chronolith.operators.accepted import next_tick
from chronolith.session import claim, listed, read_text

RESULT = "id string, content string"
#: Views and events that one call of the scheduler looks at, at most.
MAX_VIEWS, MAX_EVENTS = 256, 1024


class Views:
    """Views of a session, with their generations in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._plans: dict[str, tuple[Callable[[int], DataFrame], tuple[str, ...]]] = {}

    def register(self, name: str, plan: Callable[[int], DataFrame], inputs: Iterable[str]) -> None:
        """A view over named inputs; ``plan`` takes the tick.  A name is registered once (E_VIEW)."""
        if name in self._plans:
            raise EngineError("E_VIEW", f"{name} is registered")
        self._plans[name] = (plan, tuple(inputs))

    def generation(self, name: str) -> int:
        """The last generation of a view; 0 before the first."""
        return max((int(n) for n in listed(self.spark, f"{self.path}/{name}/generations") if n.isdigit()), default=0)

    def told(self, name: str, generation: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/{name}/generations/{generation}"))

    def result(self, name: str, generation: int | None = None) -> DataFrame:
        g = self.generation(name) if generation is None else generation
        if not g:
            return self.spark.createDataFrame([], RESULT)
        return self.spark.read.schema(RESULT).parquet(f"{self.path}/{name}/results/{self.told(name, g)['result']}")

    def current(self, name: str, tick: int, heads: dict[str, int]) -> DataFrame:
        """The stored result, if it is of this tick and of these heads of its inputs (else E_VIEW_STALE)."""
        g = self.generation(name)
        told = self.told(name, g) if g else None
        if told is None or told["tick"] != tick or any(heads.get(i) != h for i, h in told["inputs"].items()):
            raise EngineError("E_VIEW_STALE", name)
        return self.result(name, g)

    def refresh(self, name: str, tick: int, heads: dict[str, int]) -> int:
        """Run the plan anew and make its result the next generation; ticks only move on (E_CLOCK)."""
        if name not in self._plans:
            raise EngineError("E_VIEW", f"{name} is not registered")
        plan, inputs = self._plans[name]
        g = self.generation(name)
        next_tick(self.told(name, g)["tick"] if g else None, tick)
        folder = uuid.uuid4().hex
        plan(tick).select(
            "id", F.col("content").cast("string").alias("content")
        ).distinct().write.parquet(f"{self.path}/{name}/results/{folder}")
        body = {"result": folder, "tick": tick, "inputs": {i: heads.get(i) for i in inputs}}
        if not claim(self.spark, f"{self.path}/{name}/generations/{g + 1}", json.dumps(body)):
            raise EngineError("E_VIEW", f"generation {g + 1} was made by another run")
        return g + 1

    def changes(self, name: str, generation: int | None = None) -> DataFrame:
        """(id, change): what a generation added, removed or changed against the one before."""
        g = self.generation(name) if generation is None else generation
        side = lambda df, a: df.select("id", F.col("content").alias(a), F.lit(1).alias(f"in_{a}"))
        b = side(self.result(name, g - 1) if g > 1 else self.result(name, 0), "b").join(side(self.result(name, g), "a"), "id", "full")
        what = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "removed").when(
            ~F.col("a").eqNullSafe(F.col("b")), "changed"
        )
        return b.select("id", what.alias("change")).where("change IS NOT NULL")

    def drain(self, events: Iterable[tuple[str, int]], tick: int, heads: dict[str, int]) -> list[str]:
        """Refresh the views that an input event (input, seq) has made stale, in order of name; more events or stale views
        than one call may look at are E_BACKPRESSURE, before anything is run."""
        events = list(events)
        touched = {name for name, _ in events}
        stale = sorted(n for n, (_, inputs) in self._plans.items() if touched & set(inputs) and self._behind(n, heads))
        if len(events) > MAX_EVENTS or len(stale) > MAX_VIEWS:
            raise EngineError("E_BACKPRESSURE", f"{len(events)} events, {len(stale)} views")
        for name in stale:
            self.refresh(name, tick, heads)
        return stale

    def _behind(self, name: str, heads: dict[str, int]) -> bool:
        g = self.generation(name)
        return not g or any(heads.get(i) != h for i, h in self.told(name, g)["inputs"].items())
