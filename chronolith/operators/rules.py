"""Bounded rules over signed, timed facts: semi-naive fixpoint.

A rule joins its body atoms on shared variables; the head holds in the
intersection of the body's intervals.  No negation as failure: a negative atom
matches negative facts.  Each round joins what the last one added with all that
is known, so a fact is derived from new ones only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.errors import EngineError
from chronolith.model import ALL, Graph
from chronolith.session import checkpointed

KEY = ["predicate", "src", "dst", "negative", "valid_start", "valid_end"]
MAX_RULES, MAX_BODY, MAX_VARS, MAX_ROUNDS = 64, 8, 16, 128


@dataclass(frozen=True)
class Atom:
    """predicate(src, dst); terms that begin with ``?`` are variables."""

    predicate: str
    src: str
    dst: str
    negative: bool = False


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Atom, ...]


def check(rules: Sequence[Rule]) -> None:
    if not 1 <= len(rules) <= MAX_RULES:
        raise EngineError("E_RULE_BUDGET", "rules")
    for r in rules:
        names = {t for a in r.body for t in (a.src, a.dst) if t.startswith("?")}
        if not 1 <= len(r.body) <= MAX_BODY or len(names) > MAX_VARS:
            raise EngineError("E_RULE_BUDGET", "body")
        if any(t.startswith("?") and t not in names for t in (r.head.src, r.head.dst)):
            raise EngineError("E_RULE_UNSAFE", "a head variable is not in the body")


def _match(facts: DataFrame, a: Atom) -> DataFrame:
    x = facts.where((F.col("predicate") == a.predicate) & (F.col("negative") == a.negative))
    for col, term in (("src", a.src), ("dst", a.dst)):
        if not term.startswith("?"):
            x = x.where(F.col(col) == term)
    if a.src == a.dst and a.src.startswith("?"):
        x = x.where("src = dst")
    cols = {t: c for c, t in (("dst", a.dst), ("src", a.src)) if t.startswith("?")}
    return x.select(*(F.col(c).alias(t) for t, c in cols.items()), F.col("valid_start").alias("_s"), F.col("valid_end").alias("_e"))


def _derive(rule: Rule, sides: Sequence[DataFrame]) -> DataFrame:
    acc = _match(sides[0], rule.body[0])
    for a, side in zip(rule.body[1:], sides[1:]):
        m = _match(side, a).withColumnRenamed("_s", "_s2").withColumnRenamed("_e", "_e2")
        on = [c for c in m.columns if c in acc.columns]
        if not on:
            raise EngineError("E_RULE_PRODUCT", "body atoms must share a variable with those before")
        acc = acc.join(m, on).withColumn("_s", F.greatest("_s", "_s2")).withColumn("_e", F.least("_e", "_e2")).drop("_s2", "_e2").where("_e IS NULL OR _s < _e")
    term = lambda t: F.col(f"`{t}`") if t.startswith("?") else F.lit(t)
    return acc.select(
        F.lit(rule.head.predicate).alias("predicate"), term(rule.head.src).alias("src"),
        term(rule.head.dst).alias("dst"), F.lit(rule.head.negative).alias("negative"), F.col("_s").alias("valid_start"),
        F.col("_e").alias("valid_end")
    )


def reason(facts: DataFrame, rules: Sequence[Rule], max_rounds: int = MAX_ROUNDS, max_facts: int | None = None) -> DataFrame:
    """All facts derived (KEY columns), without repeats; complete, or E_RULE_BUDGET.

    facts: (predicate, src, dst, polarity, valid_start, valid_end).  A fact both
    given and derived is among the results too."""
    check(rules)
    used = sorted({a.predicate for r in rules for a in r.body})
    base = checkpointed(facts.where(F.col("predicate").isin(*used)).select(
        "predicate", "src", "dst", (F.col("polarity") == "negative").alias("negative"), "valid_start", "valid_end"
    ).distinct())
    derived = base.limit(0)
    known, fresh = base, base
    for n in range(max_rounds):
        out = None
        for r in rules:
            for i in range(len(r.body)):
                # fresh facts at place i, everything elsewhere
                d = _derive(r, [fresh if j == i else known for j in range(len(r.body))])
                out = d if out is None else out.unionAll(d)
        keyed = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in KEY]
        new = out.distinct()
        old = derived.select(*(F.col(c).alias(f"_k_{c}") for c in KEY))
        new = checkpointed(new.join(old, keyed, "left_anti"))
        if new.isEmpty():
            return derived
        derived = checkpointed(derived.unionAll(new))
        if max_facts is not None and derived.count() > max_facts:
            raise EngineError("E_RULE_BUDGET", "facts")
        fresh = checkpointed(new.join(known.select(*(F.col(c).alias(f"_k_{c}") for c in KEY)), keyed, "left_anti"))
        known = checkpointed(known.unionAll(fresh))
        if fresh.isEmpty():
            return derived
    raise EngineError("E_RULE_BUDGET", "rounds")


def reasoned(g: Graph, rules: Sequence[Rule], allow_cross_space: bool = False, **limits) -> Graph:
    """The graph with one ``rule:`` edge more for each derived fact; given edges stay, also where they are derived too.

    A head between two spaces is E_RULE_SPACE unless allowed."""
    facts = reason(g.edges, rules, **limits)
    name = F.concat(F.lit("rule:"), F.substring(F.sha2(F.to_json(F.struct(*KEY), {"ignoreNullFields": "false"}), 256), 1, 32))
    made = facts.select(
        name.alias("id"), "predicate", "src", "dst", "valid_start", "valid_end", F.when(F.col("negative"), "negative").otherwise("positive").alias("polarity"),
        F.lit(None if g.selection == ALL else g.selection).cast("string").alias("context"), F.array().cast("array<string>").alias("readers"),
    )
    if not allow_cross_space:
        space = g.nodes.select("id", "space_id").distinct()
        of = lambda end, as_: space.select(F.col("id").alias(end), F.col("space_id").alias(as_))
        if not made.join(of("src", "_a"), "src").join(of("dst", "_b"), "dst").where("_a <> _b").isEmpty():
            raise EngineError("E_RULE_SPACE", "a derived edge joins two spaces")
    return g.with_(edges=g.edges.unionByName(made, allowMissingColumns=True))
