"""Operators of the general data problems against brute force, and their edge cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chronolith.functions.refs import holding, reference
from chronolith.functions.times import text_millis
from chronolith.operators import asknown, hierarchy, incremental, intervals, orphans
from chronolith.operators.dyadic import cover_nodes, interval_nodes, point_nodes, step_nodes
from chronolith.operators.prefix import running_sums, successor
from chronolith.streaming import changes, late

T0 = dt.datetime(2024, 1, 1)


def day(n):
    return None if n is None else T0 + dt.timedelta(days=n)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# shared pieces


def test_reference_spellings(spark):
    df = spark.createDataFrame([(x,) for x in ["  ab-1 ", "N/A", "-", "", "   ", "None", None, "x"]], "r string")
    assert [r[0] for r in df.select(reference("r")).collect()] == ["AB-1", None, None, None, None, None, None, "X"]


def test_holding_takes_the_latest_and_is_independent_of_order(spark):
    data = [("a", 1, day(1)), ("a", 2, day(3)), ("a", 3, day(2)), ("b", 5, None), ("b", 4, None), (None, 1, day(1)), ("a", 2, day(3))]
    for _ in range(2):
        random.shuffle(data)
        got = holding(
            spark.createDataFrame(data, "k string, v int, recorded_at timestamp_ntz"), "k", "recorded_at",
            ["k", "v", "recorded_at"]
        )
        assert [(r["k"], r["v"]) for r in got.orderBy("k").collect()] == [("a", 2), ("b", 5)]


def test_running_sums_and_successor_across_blocks(spark):
    data = sorted({(random.choice("ab"), random.randrange(-50, 200)) for _ in range(150)})
    df = spark.createDataFrame(data, "k string, o long").withColumn("one", F.lit(1))
    got = {(r["k"], r["o"]): (r["n"], r["nx"]) for r in successor(
        running_sums(df, ["k"], "o", {"n": "one"}, block=7), ["k"], "o", "nx", block=11
    ).collect()}
    for k in "ab":
        os = [o for x, o in data if x == k]
        for i, o in enumerate(os):
            assert got[k, o] == (i + 1, os[i + 1] if i + 1 < len(os) else None)


def test_times_as_text(spark):
    cases = {
        "1700000000123": 1700000000123, "2024-02-29": 1709164800000, "2023-02-29": None,
        "2024-01-01T00:00:00Z": 1704067200000, "2024-01-01 01:00:00+01:00": 1704067200000,
        "2024-01-01T00:00:00": 1704067200000, " 2024-01-01T00:00:00.5z": 1704067200500,
        "2023-12-31T19:00:00-0500": 1704067200000, "yesterday": None, "": None, None: None, "24/07": None,
        "2024-13-45T00:00:00Z": None
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text_millis("t").alias("m"))
    assert {r["t"]: r["m"] for r in df.collect()} == cases


# 1


def brute_orphans(parents, children):
    out = []
    for key, ref, t in children:
        if ref is None:
            continue
        mine = [(a, b) for k, a, b in parents if k == ref]
        if any(a is not None and t is not None and a <= t and (b is None or t < b) for a, b in mine):
            continue
        seen = any(a is not None and t is not None and a <= t for a, b in mine)
        out.append((key, t and t.strftime("%Y-%m"), "missing" if not mine else "deleted" if seen else "late"))
    return sorted(out, key=str)


def test_orphans_against_brute_force_with_a_hot_key(spark):
    rnd = random.Random(3)
    parents = [(
        rnd.choice("ABCD"), day(rnd.randrange(60)), rnd.choice([None, day(rnd.randrange(70))])
    ) for _ in range(25)] + [("E", None, None)]
    children = [(
        f"c{i}", "A" if rnd.random() < 0.5 else rnd.choice(["B", "C", "D", "E", "Z", None]),
        rnd.choice([day(rnd.randrange(80)), day(rnd.randrange(80)), None])
    ) for i in range(200)]
    p = spark.createDataFrame(parents, "key string, recorded_at timestamp_ntz, deleted_at timestamp_ntz").withColumn("at", F.lit(1))
    c = spark.createDataFrame(
        children, "id string, ref string, recorded_at timestamp_ntz"
    ).withColumn("at", F.lit("clash")).withColumn("step", F.lit(9))
    got = orphans.orphans([orphans.Parent("p", p, "key")], [orphans.Child("c", c, "id", "ref", "p")])
    assert rows(got.select("record_key", "ref_month", "reason")) == brute_orphans(parents, children)
    assert orphans.orphan_counts(got).agg(F.sum("n_rows")).first()[0] == got.count()


def test_orphans_of_empty_tables(spark):
    p = spark.createDataFrame([], "key string, recorded_at timestamp_ntz, deleted_at timestamp_ntz")
    c = spark.createDataFrame([("x", "A", day(1))], "id string, ref string, recorded_at timestamp_ntz")
    f = lambda p, c: rows(orphans.orphans(
        [orphans.Parent("p", p, "key")], [orphans.Child("c", c, "id", "ref", "p")]
    ).select("reason"))
    assert f(p, c) == [("missing",)] and f(p, c.limit(0)) == []


# 2


def test_changes_in_any_order_with_repeats_and_in_two_runs(spark, tmp_path):
    rnd = random.Random(5)
    data = [(rnd.choice("abc") if i % 9 else None, i, rnd.choice(["put", "put", "del"]), f"v{i}") for i in range(60)]
    data += rnd.sample(data, 20)
    rnd.shuffle(data)
    best = {}
    for k, s, o, v in data:
        if k is not None and s > best.get(k, (-1,))[0]:
            best[k] = (s, o, v)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k string, s int, o string, v string"
    for part in (data[:30], data[30:]):
        spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(src)
        got = changes.apply_changes(changes.file_stream(spark, src), ["k"], ["s"], F.col("o") == "del", ["v"], path=out)
    assert {r["k"]: (r["s"], "del" if r["removed"] else "put", r["v"]) for r in got.collect()} == best
    again = changes.apply_changes(changes.file_stream(spark, src), ["k"], ["s"], F.col("o") == "del", ["v"], path=out)
    assert rows(again) == rows(got)


def test_changes_are_compacted_between_runs(spark, tmp_path):
    src, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "k string, s int, o string"
    run = lambda: changes.apply_changes(changes.file_stream(spark, src), ["k"], ["s"], F.col("o") == "del", [], path=out)
    spark.createDataFrame([("a", 1, "put"), ("b", 5, "del")], schema).write.mode("append").parquet(src)
    run()
    spark.createDataFrame([("a", 3, "put")], schema).write.mode("append").parquet(src)
    want = rows(run())
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert want == [("a", 3, False), ("b", 5, True)] and "RocksDB" not in before
    assert changes.compact(spark, out, ["k"], ["s"], []) == 2 and changes.compact(spark, out, ["k"], ["s"], []) == 1
    spark.createDataFrame([("b", 4, "put"), ("c", 1, "put")], schema).write.mode("append").parquet(src)
    assert rows(run()) == [*want, ("c", 1, False)]


def test_changes_of_one_file_and_of_nothing(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1)], "k string, s int").coalesce(1).write.parquet(src)
    import glob

    f = glob.glob(f"{src}/part*")[0]
    assert rows(changes.apply_changes(changes.file_stream(spark, f), ["k"], ["s"], F.lit(False), [])) == [("a", 1, False)]


# 3


def brute_tree(links):
    par = {}
    for c, p in links:
        if c is not None and p is not None:
            par[c] = min(p, par.get(c, p))
    out = {}
    for c in par:
        path, x = [c], c
        while x in par and len(path) <= len(par) + 1:
            x = par[x]
            path.append(x)
        out[c] = ("cycle", -1) if x in par else (x, len(path) - 1)
    return out


def test_hierarchy_with_cycles_long_chains_and_a_hot_parent(spark):
    links = [(f"n{i}", f"n{i - 1}") for i in range(1, 45)] + [(f"h{i}", "n3") for i in range(60)] + [
        ("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("s", "s"), ("x", None), (None, "x"), ("n1", "n0"), ("h1", "n4")
    ]
    got = hierarchy.hierarchy(spark.createDataFrame(links, "child string, parent string"), levels_per_job=4, with_path=True)
    assert {r["child"]: (r["root"], r["depth"]) for r in got.collect()} == brute_tree(links)
    pairs = hierarchy.ancestor_pairs(got)
    assert pairs.count() == sum(d for r, d in brute_tree(links).values() if d > 0)
    assert pairs.where("ancestor = 'n0' AND descendant = 'n44'").first()["distance"] == 44
    few = spark.createDataFrame(links, "child string, parent string")
    for wide in (1, 2, None):
        again = hierarchy.hierarchy(few, levels_per_job=wide)
        assert {r["child"]: (r["root"], r["depth"]) for r in again.collect()} == brute_tree(links)


def test_hierarchy_depth_limit_is_exact(spark):
    chain = spark.createDataFrame([(f"n{i:02}", f"n{i - 1:02}") for i in range(1, 15)], "child string, parent string")
    for limit in (13, 8, 1):
        with pytest.raises(ValueError, match="E_DEPTH"):
            hierarchy.hierarchy(chain, max_levels=limit)
    assert hierarchy.hierarchy(chain, max_levels=14).count() == 14


def test_hierarchy_of_nothing(spark):
    assert hierarchy.hierarchy(spark.createDataFrame([], "child string, parent string")).count() == 0


# 4


def test_dyadic_nodes_cover_exactly(spark):
    rnd = random.Random(1)
    cases = [(a, a + rnd.randrange(1, 60)) for a in (rnd.randrange(0, 200) for _ in range(40))]
    iv = spark.createDataFrame(cases, "lo long, hi long").select(
        "lo", "hi", F.explode(interval_nodes(F.col("lo"), F.col("hi"), 0, 8)).alias("n")
    )
    pt = spark.range(0, 256).select("id", F.explode(point_nodes(F.col("id"), 0, 8)).alias("n"))
    hits = iv.join(pt, "n").groupBy("lo", "hi", "id").count().collect()
    assert all(r["count"] == 1 for r in hits)
    assert {(r["lo"], r["hi"], r["id"]) for r in hits} == {(a, b, p) for a, b in cases for p in range(a, min(b, 256))}


def test_covering_nodes_are_met_once(spark):
    rnd = random.Random(2)
    cases = [(a, a + rnd.randrange(1, 120)) for a in (rnd.randrange(0, 200) for _ in range(60))]
    iv = spark.createDataFrame(cases, "lo long, hi long").select(
        "lo", "hi", F.explode(cover_nodes(F.col("lo"), F.col("hi"), (1, 3, 5, 8), 0, 8)).alias("n")
    )
    pt = spark.range(0, 256).select("id", F.explode(step_nodes(F.col("id"), (1, 3, 5, 8), 0, 8)).alias("n"))
    hits = [tuple(r) for r in iv.distinct().join(pt, "n").select("lo", "hi", "id").collect()]
    assert len(hits) == len(set(hits)) and {h for h in hits if h[0] <= h[2] < h[1]} == {
        (a, b, p) for a, b in cases for p in range(a, min(b, 256))
    }


def test_attributes_as_known_against_brute_force(spark):
    rnd = random.Random(7)
    U = 10**11
    v = [(
        rnd.choice(["u1", "u1", "u2", None]), rnd.choice(["k1", "k2", "k3"]), rnd.choice([None, rnd.randrange(40) * U]),
        rnd.choice([None, rnd.randrange(60) * U]), rnd.randrange(50) * U, f"a{i}"
    ) for i in range(60)]
    e = [(i, rnd.choice(["u1", "u2", None]), rnd.choice([None, rnd.randrange(70) * U + rnd.randrange(3) - 1])) for i in range(80)]
    want = set()
    for i, u, s in e:
        for k in ("k1", "k2", "k3"):
            known = [x for x in v if u is not None and s is not None and x[0] == u and x[1] == k and x[4] <= s]
            if known:
                top = max(x[4] for x in known)
                x = max((x for x in known if x[4] == top), key=lambda x: (x[2] is not None, x[2] or 0, x[3] is not None, x[3] or 0, x[5]))
                if x[2] is not None and (x[3] is None or x[3] > x[2]) and x[2] <= s and (x[3] is None or s < x[3]):
                    want.add((i, x[5]))
    ev = spark.createDataFrame(e, "i long, u string, s long").withColumn("key", F.lit("clash")).withColumn("since", F.lit(0))
    vs = spark.createDataFrame(v, "u string, k string, lo long, hi long, rec long, a string")
    got = asknown.as_known(ev, asknown.effective_versions(vs, "u", "k", "lo", "hi", "rec", ["a"]), "u", "s")
    assert {(r["i"], r["v_a"]) for r in got.collect()} == want and got.count() == len(want)
    assert asknown.as_known(ev, asknown.effective_versions(vs.limit(0), "u", "k", "lo", "hi", "rec", ["a"]), "u", "s").count() == 0


# 5


def brute_periods(xs):
    out = []
    for k in sorted({x[0] for x in xs if x[0] is not None}):
        iv = sorted((s, float("inf") if e is None else e) for kk, s, e in xs if kk == k and s is not None and (e is None or e > s))
        per = []
        for s, e in iv:
            if per and s <= per[-1][1]:
                per[-1][1] = max(per[-1][1], e)
            else:
                per.append([s, e])
        fin = lambda e: None if e == float("inf") else e
        out += [(k, "period", s, fin(e)) for s, e in per] + [(k, "gap", a[1], b[0]) for a, b in zip(per, per[1:])]
    return sorted(out, key=str)


def test_periods_and_gaps_against_brute_force(spark):
    rnd = random.Random(11)
    xs = [(
        "hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", None]),
        rnd.choice([None] + [rnd.randrange(900) * 10**11] * 6),
        None if rnd.random() < 0.004 else rnd.randrange(900) * 10**11
    ) for _ in range(700)]
    xs = [(k, s, e if s is None or e is None or rnd.random() < 0.1 else s + (e % (12 * 10**11))) for k, s, e in xs]
    xs += xs[:50] + [("t", 0, 10**12), ("t", 10**12, 2 * 10**12), ("t", 3 * 10**12, None)]
    df = spark.createDataFrame(xs, "entity string, s0 long, e0 long").withColumn("k", F.lit(1)).withColumn("n", F.lit(1))
    assert rows(intervals.periods_and_gaps(df, ["entity"], "s0", "e0")) == brute_periods(xs)
    assert intervals.periods_and_gaps(df.limit(0), ["entity"], "s0", "e0").count() == 0


# 6


def late_records():
    W, D = late.WEEK_MS, late.DAY_MS
    mon = late.WEEK_MS * 2800 + 4 * D  # a Monday
    recs = [
        ("a", mon, mon + 1), ("a", mon + 1, mon + W), ("a", mon + 2, mon + W + 21 * D),
        ("a", mon + 3, mon + W + 21 * D + 1), (None, mon, mon + 2 * W), ("b", None, mon), ("b", mon, None),
        ("a", mon + W - 1, mon + 60 * D)
    ]
    return mon, recs


def stream_of(spark, path, recs, files):
    """The records in so many files, a micro-batch each."""
    for i in range(files):
        spark.createDataFrame(
            recs[i::files], "source string, at long, reported long"
        ).withColumn("h", F.lit(1.0)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("source string, at long, reported long, h double").option("maxFilesPerTrigger", 1).parquet(path)


def told(events, out):
    v = sorted(((r["source"], r["at"], r["reported"], r["verdict"]) for r in out.collect()), key=str)
    return v, rows(events.periods()), rows(events.closings())


def test_late_records_and_closings(spark, tmp_path):
    mon, recs = late_records()
    W, D = late.WEEK_MS, late.DAY_MS
    events = late.LateEvents(spark, str(tmp_path / "s"), "h")
    out = events.run(stream_of(spark, str(tmp_path / "in"), recs, 1))
    assert sorted((r["source"], r["reported"] - mon, r["verdict"]) for r in out.collect()) == sorted([
        ("a", 1, "on_time"), ("a", W, "corrects"), ("a", W + 21 * D, "corrects"), ("a", W + 21 * D + 1, "too_late"),
        ("", 2 * W, "corrects"), ("a", 60 * D, "too_late")
    ])
    # source a passes the bound at its own report; the nameless source has been silent for four weeks by then
    assert rows(events.closings()) == [(mon + W, mon + 2 * W + 28 * D, 2)]
    p = events.periods().first()
    assert (p["n_first"], p["n_corrected"], p["n_diverted"], p["sum_corrected"]) == (1, 4, 2, 4.0)


def test_late_records_in_any_order_of_arrival_and_in_two_runs(spark, tmp_path):
    rnd = random.Random(21)
    W, D = late.WEEK_MS, late.DAY_MS
    mon, few = late_records()
    recs = few + [(
        rnd.choice(["a", "a", "b", "c", None]), at, at + rnd.randrange(0, 70 * D)
    ) for at in (mon + rnd.randrange(6 * W) for _ in range(120))]
    want = None
    for k in range(3):
        events = late.LateEvents(spark, str(tmp_path / f"s{k}"), "h")
        at = str(tmp_path / f"in{k}")
        out = events.run(stream_of(spark, at, recs[:90], 1 + k))
        out = events.run(stream_of(spark, at, recs[90:], 1))
        got = told(events, out)
        want = want or got
        assert got == want and len(got[0]) == len(recs) - 2
        rnd.shuffle(recs)
    bound = lambda at: (at - 4 * D) // W * W + 4 * D + W
    for _, at, rep, verdict in want[0]:
        assert verdict == ("on_time" if rep < bound(at) else "corrects" if rep <= bound(at) + 21 * D else "too_late")
    # without idle time-outs a week closes no earlier, and only by reports
    slow = {r["period_end"]: r["closed_at"] for r in late.LateEvents(spark, str(tmp_path / "s0"), "h", idle_ms=10**15).closings().collect()}
    assert all(slow[end] is None or slow[end] >= at for end, at, _ in want[2] if at is not None) and len(slow) == len(want[2])


def test_late_events_survive_a_killed_run(spark, tmp_path, monkeypatch):
    mon, recs = late_records()
    whole = late.LateEvents(spark, str(tmp_path / "a"), "h")
    want = told(whole, whole.run(stream_of(spark, str(tmp_path / "in"), recs, 3)))
    stream = spark.readStream.schema("source string, at long, reported long, h double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    events, calls = late.LateEvents(spark, str(tmp_path / "b"), "h"), []
    real = late.claim

    def dies(spark_, path, text):
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("killed before the swap")
        done = real(spark_, path, text)
        if len(calls) == 4:
            raise RuntimeError("killed after the swap")
        return done

    monkeypatch.setattr(late, "claim", dies)
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            events.run(stream)
    assert told(events, events.run(stream)) == want and len(calls) == 4


def test_late_events_of_nothing(spark, tmp_path):
    events = late.LateEvents(spark, str(tmp_path / "s"), "h")
    out = events.run(stream_of(spark, str(tmp_path / "in"), late_records()[1][5:7], 1))
    assert told(events, out) == ([], [], [])
    assert rows(late.LateEvents(spark, str(tmp_path / "none")).closings()) == []


# 7


def content_case(rnd, n_runs=12, n_recs=300):
    runs = [(
        "f", rnd.choice(["s", "t"]), a, a + rnd.randrange(0, 30), rnd.randrange(100)
    ) for a in (rnd.randrange(0, 80) for _ in range(n_runs))] + [("f", None, 0, 9, 5), ("f", "s", None, 9, 5)]
    recs = [("f", rnd.choice(["s", "t", ""]), rnd.randrange(1, 90), rnd.randrange(100), rnd.randrange(3)) for _ in range(n_recs)]
    return runs, recs


def brute_unprocessed(runs, recs):
    want = set()
    for key in {r[:3] for r in recs}:
        mine = [r for r in recs if r[:3] == key]
        last = max((r[3], r[4] * 7, r[4]) for r in mine)
        first = min(r[3] for r in mine if r[4] == last[2])
        if not any(sc == key[1] and a is not None and a < key[2] <= b and first <= st for _, sc, a, b, st in runs):
            want.add(key)
    return want


def taken_up(spark, state, runs, recs):
    df = spark.createDataFrame(
        [(f, s, p, t, c * 7, c) for f, s, p, t, c in recs],
        "feed string, scope string, pos long, received long, h1 long, h2 long"
    )
    rs = spark.createDataFrame(runs, "feed string, scope string, after_pos long, upto_pos long, started long")
    got = incremental.take_up(state, incremental.content_versions(df), rs, df.groupBy("feed", "scope").agg(F.max("pos").alias("top")))
    out = [tuple(r) for r in got.collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_incremental_over_several_runs_with_changes_and_crashes(spark, tmp_path, monkeypatch):
    rnd = random.Random(13)
    runs, recs = content_case(rnd)
    path = str(tmp_path / "state")
    state = lambda: incremental.ContentState(spark, path)
    assert state().version() == 0 and state().read().count() == 0
    assert taken_up(spark, state(), runs, recs) == brute_unprocessed(runs, recs) and state().version() == 1
    held = rows(state().read())
    assert taken_up(spark, state(), runs, recs) == brute_unprocessed(runs, recs) and state().version() == 1
    # more runs and changed records; the run dies between write and swap and leaves what holds as it was
    more_runs, more = [r[:4] + (r[4] + 100,) for r in content_case(rnd)[0][:5]], [
        (f, s, p, t + 100, c) for f, s, p, t, c in content_case(rnd)[1][:80]
    ]
    real = incremental.claim

    def dies(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(incremental, "claim", dies)
    with pytest.raises(RuntimeError, match="killed"):
        taken_up(spark, state(), runs + more_runs, recs + more)
    monkeypatch.setattr(incremental, "claim", real)
    assert state().version() == 1 and rows(state().read()) == held
    assert taken_up(spark, state(), runs + more_runs, recs + more) == brute_unprocessed(runs + more_runs, recs + more)
    assert state().version() == 2 and len(rows(state().read())) > len(held)
    # a run that was taken back: contents are judged anew
    fewer = runs[3:] + more_runs
    assert taken_up(spark, state(), fewer, recs + more) == brute_unprocessed(fewer, recs + more)
    before = rows(state().read())
    state().forget(keep=1)
    assert rows(state().read()) == before
    assert taken_up(spark, state(), fewer, recs + more) == brute_unprocessed(fewer, recs + more)
    monkeypatch.setattr(incremental, "FOLDERS", 1)
    last = [*fewer, ("f", "s", 0, 90, 500)]
    assert taken_up(spark, state(), last, recs + more) == brute_unprocessed(last, recs + more)
    assert taken_up(spark, state(), last, recs + more) == brute_unprocessed(last, recs + more)


def test_of_two_runs_at_a_time_the_first_to_swap_wins(spark, tmp_path):
    runs, recs = content_case(random.Random(3))
    a, b = (incremental.ContentState(spark, str(tmp_path / "state")) for _ in range(2))
    taken_up(spark, a, runs, recs)
    held = rows(a.read())
    with pytest.raises(ValueError, match="E_STALE_STATE"):
        b.publish("other", spark.createDataFrame([], incremental.RUN), 0)
    assert rows(a.read()) == held and b.version() == 1


def test_incremental_of_nothing(spark, tmp_path):
    runs, recs = content_case(random.Random(3))
    none = incremental.ContentState(spark, str(tmp_path / "state"))
    df = spark.createDataFrame([], "feed string, scope string, pos long, received long, h1 long, h2 long")
    tops = df.groupBy("feed", "scope").agg(F.max("pos").alias("top"))
    assert incremental.take_up(none, incremental.content_versions(df), spark.createDataFrame(runs, incremental.RUN), tops).count() == 0
    assert len(taken_up(
        spark, incremental.ContentState(spark, str(tmp_path / "other")), runs[:0] or runs[-2:], recs
    )) == len({r[:3] for r in recs})


def test_content_hash_tells_nulls_apart(spark):
    df = spark.createDataFrame(
        [("a", None, None), (None, "a", None), ("a", "", None), ("a", None, [1])], "x string, y string, z array<int>"
    )
    assert df.select(*incremental.content_hash(["x", "y", "z"], df)).distinct().count() == 4
