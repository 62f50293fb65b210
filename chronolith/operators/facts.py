"""The append-only fact log: states at a revision, recorded time, changes, writes."""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.errors import EngineError
from chronolith.operators.prefix import successor
from chronolith.session import claim, listed, read_text, remove, written

MAX_CHANGES, MAX_RANGE = 100_000, 1000


def op(col: Column | str = "op") -> Column:
    return F.lower(F.trim(F.col(col) if isinstance(col, str) else col))


def live(
    log: DataFrame, line: Sequence[str], key: Sequence[str], order: Sequence[str], payload: Sequence[str],
    until: Column | None = None, removed: Column | None = None
) -> DataFrame:
    """Facts in force on each line after all operations with ``until``: one aggregate, the latest by ``order`` wins.

    The condition is pushed to the scan.  Retracted facts are left out."""
    rows = log if until is None else log.where(until)
    gone = removed if removed is not None else op() == "retract"
    last = rows.withColumn("_gone", gone).groupBy(*line, *key).agg(F.max(F.struct(
        *order, "_gone", *(c for c in payload if c not in order)
    )).alias("_l"))
    return last.where("NOT _l._gone").select(*line, *key, *(F.col(f"_l.{c}").alias(c) for c in payload))


def head_at(heads: DataFrame, branch: Sequence[str], at: int) -> DataFrame:
    """As-of selection: the last head of each branch recorded at or before ``at`` (none: no row, the empty state)."""
    return heads.where(F.col("recorded_at_ms") <= at).groupBy(*branch).agg(F.max(F.struct("recorded_at_ms", "seq")).alias("h")).select(
        *branch, F.col("h.seq").alias("head_seq"), F.col("h.recorded_at_ms").alias("head_ms")
    )


def versions(log: DataFrame, key: Sequence[str]) -> DataFrame:
    """Liveness of each version: ``[from_seq, until_seq)`` (until null = still in force).

    Revision and position make one order number (positions below 2**32), whose
    successor is found block by block, so a fact with very many versions is no hot task."""
    at = F.shiftleft(F.col("seq").cast("long"), 32) + F.col("position")
    told = successor(log.withColumn("_at", at), key, "_at", "_next", block=2**38)
    return told.withColumn("until_seq", F.shiftright("_next", 32)).drop("_at", "_next").withColumnRenamed("seq", "from_seq").where(op() != "retract")


def recorded_range(heads: DataFrame, start: int, end: int, limit: int = MAX_RANGE) -> DataFrame:
    """Heads recorded in ``[start, end)``, without a start state; more than the limit is E_BUDGET."""
    got = heads.where((F.col("recorded_at_ms") >= start) & (F.col("recorded_at_ms") < end))
    if got.limit(limit + 1).count() > limit:
        raise EngineError("E_BUDGET", "recorded range")
    return got


def recorded_history(heads: DataFrame, branch: Sequence[str], start: int, end: int, limit: int = MAX_RANGE) -> DataFrame:
    """(branch, seq, recorded_at_ms, is_start): the heads of ``recorded_range`` and, marked as the start state, the
    head of each branch in force before ``start`` (none: no row, the empty state).  The limit counts the range only."""
    before = head_at(heads, branch, start - 1).select(
        *branch, F.col("head_seq").alias("seq"), F.col("head_ms").alias("recorded_at_ms"), F.lit(True).alias("is_start")
    )
    return before.unionAll(recorded_range(heads, start, end, limit).select(*branch, "seq", "recorded_at_ms", F.lit(False)))


def changes(before: DataFrame, after: DataFrame, key: Sequence[str], content: str = "content") -> DataFrame:
    """Net content difference of two states: (key, change, before, after), change in asserted, retracted, corrected.

    One aggregate over both states in long form; equal contents leave no row."""
    both = before.select(
        *key, F.col(content).alias("b"), F.lit(None).cast("string").alias("a"), F.lit(1).alias("nb"),
        F.lit(0).alias("na")
    ).unionAll(after.select(*key, F.lit(None).cast("string"), F.col(content), F.lit(0), F.lit(1)))
    g = both.groupBy(*key).agg(F.max("b").alias("before"), F.max("a").alias("after"), F.max("nb").alias("nb"), F.max("na").alias("na"))
    kind = F.when(F.col("nb") == 0, "asserted").when(F.col("na") == 0, "retracted").when(
        ~F.col("before").eqNullSafe(F.col("after")), "corrected"
    )
    return g.withColumn("change", kind).where("change IS NOT NULL").select(*key, "change", "before", "after")


def changed_keys(log: DataFrame, key: Sequence[str], after_seq: int, to_seq: int) -> DataFrame:
    """Keys touched in ``(after_seq, to_seq]``: reads that stretch of the log only, to narrow ``changes``."""
    return log.where((F.col("seq") > after_seq) & (F.col("seq") <= to_seq)).select(*key).distinct()


def reconcile(current: DataFrame, desired: DataFrame, key: Sequence[str], content: str = "content") -> DataFrame:
    """(key, action, content): what to write so that the desired facts hold: assert, correct or unchanged (facts not named stay)."""
    c = current.select(*key, F.col(content).alias("_was"), F.lit(True).alias("_have"))
    j = desired.select(*key, F.col(content).alias("content")).join(c, list(key), "left")
    return j.select(
        *key,
        F.when(F.col("_have").isNull(), "assert").when(
            F.col("_was").eqNullSafe(F.col("content")), "unchanged"
        ).otherwise("correct").alias("action"),
        "content"
    )


def selected(
    log: DataFrame, kind: str | None = None, entity: str | None = None, subject: str | None = None, object_: str | None = None,
    predicate: str | None = None, valid_at: int | None = None, recorded: tuple[int, int] | None = None,
    unanchored: bool = False,
) -> DataFrame:
    """Rows of the log by its key columns; every condition is a plain comparison, so it reaches the scan.

    ``recorded`` is a half-open range of ``recorded_at_ms``; ``valid_at`` keeps
    rows whose valid time holds the instant and those without a valid time;
    ``unanchored`` keeps facts that belong to no entity and have no ends.
    """
    named = {"kind": kind, "entity": entity, "subject": subject, "object": object_, "predicate": predicate}
    for name, value in named.items():
        if value is not None:
            log = log.where(F.col(name) == value)
    if valid_at is not None:
        holds = (F.col("valid_from") <= valid_at) & (F.col("valid_to").isNull() | (F.col("valid_to") > valid_at))
        log = log.where(F.col("valid_from").isNull() | holds)
    if recorded is not None:
        log = log.where((F.col("recorded_at_ms") >= recorded[0]) & (F.col("recorded_at_ms") < recorded[1]))
    if unanchored:
        log = log.where("entity IS NULL AND subject IS NULL AND object IS NULL")
    return log


#: Columns of a stored segment.
SEGMENT = "seq long, kind string, id string, op string, content string"
MAIN = "main"
NO_CHECK = object()


class FactStore:
    """Fact logs of several graphs in a folder, one commit order for all.

    A commit writes its facts to a segment of its own name first and is then
    claimed by one head file ``heads/<seq>`` that names the segments (session.claim:
    made once, never replaced).  Who loses the claim has touched nothing that
    is read; a writer that dies before it leaves a segment nobody names.  Each
    head tells the last commit of every graph, and each commit the one before
    it on its graph, so a state is read from the segments of its graph alone.
    """

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], int] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self._clock = clock or (lambda: int(time.time() * 1000))
        self._heads: dict[int, dict] = {}

    # heads ------------------------------------------------------------------------------------

    def tip(self) -> int | None:
        """The number of the last commit on any graph."""
        names = listed(self.spark, f"{self.path}/heads")
        return max((int(n) for n in names if n.isdigit()), default=None)

    def commit_of(self, seq: int) -> dict:
        """What a head file says: revision, recorded_at_ms, segments, before and last by graph."""
        if seq not in self._heads:
            self._heads[seq] = json.loads(read_text(self.spark, f"{self.path}/heads/{seq}"))
        return self._heads[seq]

    def head(self, graph: str = MAIN) -> int | None:
        """The last commit of a graph; None before its first."""
        tip = self.tip()
        return None if tip is None else self.commit_of(tip)["last"].get(graph)

    def floor(self, graph: str = MAIN) -> int | None:
        """The oldest revision of a graph that can still be read; None: all."""
        kept = [int(n.rpartition("-")[2]) for n in listed(self.spark, f"{self.path}/floors") if n.rpartition("-")[0] == graph]
        return max(kept, default=None)

    def recorded(self, at: int, graph: str = MAIN) -> dict | None:
        """The commit of a graph in force at a recorded time: {seq, revision, recorded_at_ms}; None before its first.

        A time to come is E_HISTORY_TIME, one before the floor E_HISTORY_EXPIRED.
        Commits are in order of their clock, so it is found by bisection."""
        if at > self._clock():
            raise EngineError("E_HISTORY_TIME", "not recorded yet")
        tip = self.tip()
        low, high = -1, tip if tip is not None else -1  # the last commit recorded at or before `at` is in (low, high]
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.commit_of(mid)["recorded_at_ms"] <= at else (low, mid - 1)
        seq = self.commit_of(low)["last"].get(graph) if low >= 0 else None
        floor = self.floor(graph)
        if floor is not None and (seq is None or seq < floor):
            raise EngineError("E_HISTORY_EXPIRED", f"kept from {floor}")
        if seq is None:
            return None
        return {"seq": seq, **{k: self.commit_of(seq)[k] for k in ("revision", "recorded_at_ms")}}

    # reads ------------------------------------------------------------------------------------

    def _checkpoints(self, graph: str) -> dict[int, str]:
        """Revision -> folder of the states kept of a graph."""
        found = {}
        for name in listed(self.spark, f"{self.path}/checkpoints"):
            g, _, seq = name.rpartition("-")
            if g == graph:
                found[int(seq)] = name
        return found

    def log(self, until: int | None = None, graph: str = MAIN) -> DataFrame:
        """Changes of a graph up to a revision, from the last kept state on (its facts have op base)."""
        seq = self.head(graph)
        floor, kept = self.floor(graph), self._checkpoints(graph)
        if until is not None and floor is not None and until < floor:
            raise EngineError("E_HISTORY_EXPIRED", f"kept from {floor}")
        while seq is not None and until is not None and seq > until:
            seq = self.commit_of(seq)["before"].get(graph)
        paths = []
        while seq is not None and seq not in kept:
            paths.append(f"{self.path}/segments/{self.commit_of(seq)['segments'][graph]}")
            seq = self.commit_of(seq)["before"].get(graph)
        if seq is not None:
            paths.append(f"{self.path}/states/{read_text(self.spark, f'{self.path}/checkpoints/{kept[seq]}')}")
        if not paths:
            return self.spark.createDataFrame([], SEGMENT)
        return self.spark.read.schema(SEGMENT).parquet(*paths)

    def state(self, until: int | None = None, graph: str = MAIN, with_seq: bool = False) -> DataFrame:
        """Facts in force at a revision: (kind, id, content[, seq])."""
        return live(self.log(until, graph), [], ["kind", "id"], ["seq"], ["content", *(["seq"] if with_seq else [])])

    def as_of(self, at: int, graph: str = MAIN) -> DataFrame:
        """The state recorded at a time; before the first commit the empty one."""
        found = self.recorded(at, graph)
        return self.state(found["seq"], graph) if found else self.spark.createDataFrame([], "kind string, id string, content string")

    def recorded_query(self, readable: Column, at: int | None = None, seq: int | None = None, graph: str = MAIN) -> tuple[DataFrame, dict]:
        """A whole recorded revision, by time or by number, with its witness {seq, revision, recorded_at_ms}.

        ``readable`` is a condition on (kind, id, content).  One fact that may not be
        read makes it unavailable (E_HISTORY_UNAVAILABLE), as if it were not there."""
        if (at is None) == (seq is None):
            raise EngineError("E_HISTORY_SELECTOR", "a time or a revision")
        found = self.recorded(at, graph) if at is not None else None
        if seq is not None and (self.tip() is None or not 0 <= seq <= self.tip() or graph not in self.commit_of(seq)["segments"]):
            raise EngineError("E_HISTORY_UNAVAILABLE")
        if seq is not None:
            found = {"seq": seq, **{k: self.commit_of(seq)[k] for k in ("revision", "recorded_at_ms")}}
        if found is None:
            raise EngineError("E_HISTORY_UNAVAILABLE")
        state = self.state(found["seq"], graph)
        if not state.where(~F.coalesce(readable, F.lit(False))).isEmpty():
            raise EngineError("E_HISTORY_UNAVAILABLE")
        return state, found

    def _keep(self, seq: int, graph: str) -> None:
        """Write the state at a revision, once."""
        if seq in self._checkpoints(graph):
            return
        name = uuid.uuid4().hex
        state = self.state(seq, graph, with_seq=True)
        state.select("seq", "kind", "id", F.lit("base").alias("op"), "content").write.parquet(f"{self.path}/states/{name}")
        claim(self.spark, f"{self.path}/checkpoints/{graph}-{seq}", name)

    def checkpoint(self, graph: str = MAIN) -> None:
        """Keep the state of the head, so that later reads start there."""
        h = self.head(graph)
        if h is not None:
            self._keep(h, graph)

    def drop_checkpoint(self, seq: int, graph: str = MAIN) -> None:
        """Forget a kept state; one that a floor rests on stays (E_CHECKPOINT)."""
        if self.floor(graph) is not None and seq <= self.floor(graph):
            raise EngineError("E_CHECKPOINT", "earlier segments are gone")
        name = self._checkpoints(graph).get(seq)
        if name:
            folder = read_text(self.spark, f"{self.path}/checkpoints/{name}")
            remove(self.spark, f"{self.path}/checkpoints/{name}")
            remove(self.spark, f"{self.path}/states/{folder}")

    def compact(self, floor: int, graph: str = MAIN) -> None:
        """Retention: keep the state at ``floor`` and drop the segments up to it; earlier reads are E_HISTORY_EXPIRED.

        The floor is published before anything is deleted, and what is deleted is
        never needed from the floor on, so a run that dies half-way can be repeated."""
        seq = self.head(graph)
        if seq is None or floor > seq:
            raise EngineError("E_HISTORY_UNAVAILABLE", str(floor))
        while seq is not None and seq > floor:
            seq = self.commit_of(seq)["before"].get(graph)
        if seq is None:
            return
        self._keep(seq, graph)
        claim(self.spark, f"{self.path}/floors/{graph}-{seq}", "")
        while seq is not None:
            remove(self.spark, f"{self.path}/segments/{self.commit_of(seq)['segments'][graph]}")
            seq = self.commit_of(seq)["before"].get(graph)

    def graphs(self) -> list[str]:
        """Names of the graphs that have a commit."""
        tip = self.tip()
        return [] if tip is None else sorted(self.commit_of(tip)["last"])

    def lookup(self, kind: str, id_: str, graph: str = MAIN) -> str | None:
        """The content of one fact in force; None if there is none."""
        hit = self.state(graph=graph).where((F.col("kind") == kind) & (F.col("id") == id_)).first()
        return hit["content"] if hit else None

    def audit(self, after: int = -1, limit: int = 256) -> tuple[list[dict], int | None]:
        """A page of commits in order, {seq, revision, recorded_at_ms, graphs}, and where the next begins (None: at the end)."""
        if not 1 <= limit <= 256:
            raise EngineError("E_PAGE", str(limit))
        tip = self.tip()
        upto = min(after + limit, tip if tip is not None else -1)
        seqs = range(after + 1, upto + 1)
        rows = [{
            "seq": i, **{k: self.commit_of(i)[k] for k in ("revision", "recorded_at_ms")},
            "graphs": sorted(self.commit_of(i)["segments"])
        } for i in seqs]
        return rows, upto if tip is not None and upto < tip else None

    def export(self, path: str, graph: str = MAIN) -> dict:
        """Write the state of a graph's head to a folder that can be carried elsewhere, with its count and digest."""
        head = self.head(graph)
        if head is None:
            raise EngineError("E_HISTORY_UNAVAILABLE", graph)
        self.state(head, graph).write.parquet(f"{path}/facts")
        told = {
            "graph": graph, "head": head, "revision": self.commit_of(head)["revision"],
            **_digest(self.spark.read.parquet(f"{path}/facts"))
        }
        if not claim(self.spark, f"{path}/manifest.json", json.dumps(told)):
            raise EngineError("E_CAPSULE", "there is one already")
        return told

    def import_export(self, path: str, graph: str, max_changes: int = MAX_CHANGES) -> dict:
        """Make an exported state a new graph; one whose facts are not those of its manifest is E_CAPSULE."""
        told = json.loads(read_text(self.spark, f"{path}/manifest.json"))
        facts = self.spark.read.schema("kind string, id string, content string").parquet(f"{path}/facts")
        if any(told[k] != v for k, v in _digest(facts).items()):
            raise EngineError("E_CAPSULE", "the facts are not those of the manifest")
        return self.write(facts.withColumn("op", F.lit("assert")), None, max_changes, graph)

    # writes -----------------------------------------------------------------------------------

    def fork(self, graph: str, to: str) -> dict:
        """A new graph that begins with the state of another's head (E_STALE_HEAD if it exists)."""
        n = self.state(graph=graph)
        return self.write(n.withColumn("op", F.lit("assert")), None, n.count() + 1, to)

    def integrate(self, proposal: str, base: int, graph: str = MAIN, max_changes: int = MAX_CHANGES) -> dict:
        """Write what a fork changed since it was made from revision ``base`` of a graph.

        A fact that the graph has changed since then too is E_STALE_FACT, and nothing is written."""
        changed = changes(self.state(base, graph), self.state(graph=proposal), ["kind", "id"])
        since = changes(self.state(base, graph), self.state(graph=graph), ["kind", "id"]).select("kind", "id", F.col("after").alias("now"))
        both = changed.join(since, ["kind", "id"]).where(~F.col("after").eqNullSafe(F.col("now")))
        if not both.isEmpty():
            raise EngineError("E_STALE_FACT", "changed on both sides")
        done = since.select("kind", "id")
        op_ = F.when(F.col("change") == "retracted", "retract").otherwise("assert")
        todo = changed.join(done, ["kind", "id"], "left_anti").select("kind", "id", op_.alias("op"), F.col("after").alias("content"))
        return self.write(todo, self.head(graph), max_changes, graph)

    def write(self, facts: DataFrame, expected: object = NO_CHECK, max_changes: int = MAX_CHANGES, graph: str = MAIN) -> dict:
        """Atomic write of (kind, id, op, content[, expected]); op assert or retract.

        ``expected`` absent: no check; None: the graph must be new; else the head
        it must have (E_STALE_HEAD).  A column ``expected`` does the same for each
        fact: null no check, -1 the fact must be absent, n it must be unchanged
        since revision n.  Asserting what already holds is no change; nothing
        changed gives ``unchanged`` and no revision.  An edge must find its
        endpoints (content JSON src/dst; E_ENDPOINT), a node with edges can't be
        retracted (E_DEPENDENT_FACT), a corrected edge keeps its ends (E_CONFLICT).
        """
        return self.commit_batch({graph: facts}, {} if expected is NO_CHECK else {graph: expected}, max_changes)[graph]

    def commit(self, facts: DataFrame, expected: object = NO_CHECK, max_changes: int = MAX_CHANGES, graph: str = MAIN) -> dict:
        """Make (kind, id, content) the whole content of a graph: what is not among them is retracted."""
        gone = self.state(graph=graph).join(facts.select("kind", "id"), ["kind", "id"], "left_anti")
        wanted = facts.select("kind", "id", F.lit("assert").alias("op"), "content")
        both = wanted.unionAll(gone.select("kind", "id", F.lit("retract"), F.lit(None).cast("string")))
        head = self.head(graph) if expected is NO_CHECK else expected
        return self.write(both, head, max_changes, graph)

    def commit_batch(
        self, changes: dict[str, DataFrame], expected: dict[str, object] | None = None, max_changes: int = MAX_CHANGES
    ) -> dict[str, dict]:
        """Writes to several graphs that become visible together, or not at all."""
        if bad := [g for g in changes if not re.fullmatch(r"[A-Za-z0-9_.]+(-[A-Za-z0-9_.]+)*", g)]:
            raise EngineError("E_GRAPH", ", ".join(bad))
        expected, tip = expected or {}, self.tip()
        heads = {g: None if tip is None else self.commit_of(tip)["last"].get(g) for g in changes}
        for g, want in expected.items():
            if want != heads[g]:
                raise EngineError("E_STALE_HEAD", f"{g} is at {heads[g]}")
        seq = 0 if tip is None else tip + 1
        segments = {}
        for g, facts in changes.items():
            real = self._checked(facts, g, max_changes)
            if real is not None:
                segments[g] = uuid.uuid4().hex
                rows = real.select(F.lit(seq).cast("long").alias("seq"), "kind", "id", "op", "content")
                rows.write.parquet(f"{self.path}/segments/{segments[g]}")
        out = {g: {"status": "written", "head": seq} if g in segments else {"status": "unchanged", "head": heads[g]} for g in changes}
        if not segments:
            return out
        last = {} if tip is None else self.commit_of(tip)["last"]
        now = max(self._clock(), 0 if tip is None else self.commit_of(tip)["recorded_at_ms"])
        body = {"before": {g: last.get(g) for g in segments}, "segments": segments, "recorded_at_ms": now}
        body["revision"] = hashlib.sha256(json.dumps([seq, body], sort_keys=True).encode()).hexdigest()
        body["last"] = {**last, **dict.fromkeys(segments, seq)}
        if not claim(self.spark, f"{self.path}/heads/{seq}", json.dumps(body)):
            for name in segments.values():
                remove(self.spark, f"{self.path}/segments/{name}")
            raise EngineError("E_STALE_HEAD", "another writer was first")
        return out

    def _checked(self, facts: DataFrame, graph: str, max_changes: int) -> DataFrame | None:
        """The changes that change something, written once, after all checks; None if there are none."""
        want = F.col("expected").cast("long") if "expected" in facts.columns else F.lit(None).cast("long")
        new = facts.select("kind", "id", op().alias("op"), "content", want.alias("expected")).distinct()
        state = self.state(graph=graph, with_seq=True)
        cur = state.select("kind", "id", F.col("content").alias("was"), F.col("seq").alias("since"))
        j = written(new.join(cur, ["kind", "id"], "left"), "write")
        ends = lambda c: F.struct(F.get_json_object(c, "$.src"), F.get_json_object(c, "$.dst"))
        edge, have = F.col("kind") == "edge", F.col("since").isNotNull()
        moved = edge & (F.col("op") == "assert") & have & ~ends("was").eqNullSafe(ends("content"))
        stale = ((F.col("expected") == -1) & have) | ((F.col("expected") >= 0) & (~have | (F.col("since") > F.col("expected"))))
        change = (F.col("op") == "retract") | ~have | ~F.col("was").eqNullSafe(F.col("content"))
        some = lambda c: F.coalesce(F.max(c.cast("int")), F.lit(0))
        seen = j.agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("kind", "id").alias("keys"), some((F.col("op") == "retract") & ~have).alias("unknown"),
            some(~F.col("op").isin("assert", "retract") | F.col("op").isNull()).alias("op"), some(moved).alias("moved"), some(stale).alias("stale"),
            some(change).alias("change"), some((F.col("kind") == "node") & (F.col("op") == "retract")).alias("gone"),
        ).first()
        for failed, code, text in (
            (seen["n"] > max_changes, "E_BUDGET", "changes"), (seen["op"], "E_OP", "assert or retract"), (
                seen["keys"] < seen["n"], "E_CONFLICT", "a fact is written twice"
            ),
            (
                seen["stale"], "E_STALE_FACT", "a fact is not as expected"
            ), (seen["unknown"], "E_UNKNOWN_FACT", "retract"), (seen["moved"], "E_CONFLICT", "an edge keeps its ends"),
        ):
            if failed:
                raise EngineError(code, text)
        if not seen["change"]:
            return None
        real = j.where(change).select("kind", "id", "op", "content")
        gone = real.where("kind = 'node' AND op = 'retract'").select(F.col("id").alias("n"))
        both_ends = lambda df: df.where("kind = 'edge'").select(
            "id",
            F.explode(F.array(F.get_json_object("content", "$.src"), F.get_json_object("content", "$.dst"))).alias("n")
        )
        nodes = cur.where("kind = 'node'").select(F.col("id").alias("n")).join(gone, "n", "left_anti").unionAll(real.where("kind = 'node' AND op = 'assert'").select("id"))
        asked = both_ends(real.where("op = 'assert'"))
        if not asked.where("n IS NULL").unionAll(asked.join(nodes, "n", "left_anti").select("id", "n")).isEmpty():
            raise EngineError("E_ENDPOINT" if asked.join(gone, "n", "left_semi").isEmpty() else "E_DEPENDENT_FACT")
        if seen["gone"]:  # edges that stay must not lose an end
            stay = state.join(real.select("kind", "id"), ["kind", "id"], "left_anti")
            if not both_ends(stay).join(gone, "n", "left_semi").isEmpty():
                raise EngineError("E_DEPENDENT_FACT", "a node with edges")
        return real


def _digest(facts: DataFrame) -> dict:
    """Rows and a sum of row hashes, whatever their order."""
    row = F.xxhash64("kind", "id", "content", F.col("content").isNull()).cast("decimal(38,0)")
    n, total = facts.agg(F.count(F.lit(1)), F.sum(row)).first()
    return {"n": n, "digest": str(total or 0)}


def imported(store: FactStore, wanted: DataFrame, chunk: int = MAX_CHANGES, graph: str = MAIN) -> dict:
    """Idempotent import of (kind, id, content): only what differs is written, nodes before edges, ``chunk`` changes at most at a time.

    Gives {assert, correct, unchanged, commits}.  Run again, it writes nothing; a run
    that died is simply run again.  Facts not named stay."""
    plan = written(reconcile(store.state(graph=graph), wanted.distinct(), ["kind", "id"]), "import")
    counts = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
    done = 0
    todo = plan.where("action <> 'unchanged'").select("kind", "id", F.lit("assert").alias("op"), "content")
    for is_node in (True, False):
        part = todo.where(F.col("kind") == "node") if is_node else todo.where(F.col("kind") != "node")
        n = part.count()
        blocks = max(1, -(-2 * n // chunk)) if n > chunk else 1  # hash blocks of about half a chunk
        for b in range(blocks if n else 0):
            of = part if blocks == 1 else part.where(F.pmod(F.xxhash64("kind", "id"), F.lit(blocks)) == b)
            done += store.write(of, max_changes=chunk, graph=graph)["status"] == "written"
    return {**{k: counts.get(k, 0) for k in ("assert", "correct", "unchanged")}, "commits": done}
