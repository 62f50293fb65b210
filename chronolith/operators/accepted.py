"""Governed views: accepted versions, typed contexts, views that are current."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.errors import EngineError

AXES = {
    "boolean": r"true|false", "integer": r"[+-]?[0-9]{1,18}", "string": r"(?s).*",
    "decimal": r"[+-]?[0-9]{1,18}([.][0-9]{1,18})?", "enum": r"(?s).*"
}


def accepted_at(decisions: DataFrame, view: Sequence[str], at: int | None = None) -> DataFrame:
    """The version in force of each view: the last accepting decision (decided_at, decision_id, revision, accepted) not after ``at``; None: latest."""
    d = decisions.where("accepted")
    if at is not None:
        d = d.where(F.col("decided_at") <= at)
    return d.groupBy(*view).agg(F.max(F.struct("decided_at", "decision_id", "revision")).alias("d")).select(
        *view, "d.revision", "d.decision_id", "d.decided_at"
    )


def accepted_by(decisions: DataFrame, decision_id: object) -> DataFrame:
    """The version one decision accepted; refused or unknown gives no row."""
    return decisions.where(F.col("accepted") & (F.col("decision_id") == F.lit(decision_id)))


def accepted_range(decisions: DataFrame, view: Sequence[str], start: int, end: int) -> DataFrame:
    """Versions in force at some time in ``[start, end)``, with the one in force at the start."""
    first = accepted_at(decisions, view, start)
    later = decisions.where(F.col("accepted") & (F.col("decided_at") > start) & (F.col("decided_at") < end)).select(
        *view, "revision", "decision_id", "decided_at"
    )
    return first.unionByName(later)


def typed_context(contexts: DataFrame, definition: dict[str, dict], axes: str = "axes") -> DataFrame:
    """Contexts (context, axes map<string,string>) that fit a definition axis -> {type, required, values}.

    An axis that is not defined, a required one that is absent, or a value that
    is not of its type leaves the context out."""
    ok = F.size(F.array_except(F.map_keys(axes), F.array(*(F.lit(a) for a in definition)).cast("array<string>"))) == 0
    for name, d in definition.items():
        if d["type"] not in AXES:
            raise EngineError("E_CONTEXT_TYPE", d["type"])
        v = F.col(axes)[name]
        fits = v.rlike(f"^({AXES[d['type']]})$")
        if d["type"] == "enum":
            fits = v.isin(*d["values"])
        ok = ok & F.coalesce(fits, F.lit(not d.get("required", False)))
    return contexts.where(ok)


def current_view(stored: dict, tick: int, heads: DataFrame) -> bool:
    """Is a stored view current: same tick, complete, and every input still at the head it was made from.

    stored: {tick, coverage, inputs: {(graph_id, branch_id): seq}}; heads (graph_id, branch_id, seq).  Reads only the inputs' heads."""
    if stored["tick"] != tick or stored["coverage"] != "complete":
        return False
    names = list(stored["inputs"])
    if not names:
        return True
    mine = heads.where(F.concat_ws("\u0000", "graph_id", "branch_id").isin(*("\u0000".join(n) for n in names)))
    now = {(r["graph_id"], r["branch_id"]): r["s"] for r in mine.groupBy("graph_id", "branch_id").agg(F.max("seq").alias("s")).collect()}
    return all(now.get(n) == s for n, s in stored["inputs"].items())


def next_tick(last: int | None, tick: int) -> int:
    """View clocks only move on (E_CLOCK)."""
    if last is not None and tick < last:
        raise EngineError("E_CLOCK", f"{tick} is before {last}")
    return tick
