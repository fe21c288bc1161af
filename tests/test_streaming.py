"""Live flows: machines against the plans for bounded data, and Structured Streaming end to end."""

import random

import pytest

from flowspark import Engine
from flowspark.lang.parser import parse_pipeline
from flowspark.streaming.flows import LandingFolder, start, start_flow
from flowspark.streaming.machines import machine

PIPELINES = [
    "s | summarize { k, n: count(), total: sum(v), last: v } by k emit every 3",
    "s | summarize { n: count(), mean: sum(v) / count() } emit when v > 7",
    "s | summarize { k, n: count() } by k emit on change v",
    "s | summarize { k, n: count() } by k emit on group change",
    "s | summarize { n: count(), hi: max(v) } emit on update",
    "s | summarize { n: count() } emit every 5 using t",
    "s | summarize { n: count() } emit every_count(4)",
    "s | summarize { k, n: count(), va: variance(v), sd: stddev(v) } by k",
    "s | summarize { k, me: median(v), p9: percentile(v, 0.9) } by k",
    "s | scan(step a: true => a.n = abs(neg(v)) + [v, 2].map(x => x * 2)[0], emit({ t: t, n: a.n }))",
    "s | summarize { k, id: w._id, n: count(), total: sum(v) } by k over w = tumbling_window(4)",
    "s | summarize { n: count(), ...w } over w = count_window(5)",
    "s | summarize { id: w._id, n: count() } over w = hopping_window(6, 2)",
    "s | summarize { id: w._id, n: count() } over w = session_window(3, t)",
    "s | scan(step a: v > 3 => a.n = (a.n || 0) + v; step b: v < 2 => b.m = v, emit({ t: t, m: b.m }))",
    "s | scan(step a: true => a.n = (a.n || 0) + v, emit({ t: t, n: a.n }))",
]


def rows(seed, n=40):
    rng = random.Random(seed)
    out, t = [], 0
    for _ in range(n):
        t += rng.randint(0, 5)
        out.append({"t": t, "k": rng.choice("xyz"), "v": rng.randint(0, 9)})
    return out


@pytest.mark.parametrize("pipeline", PIPELINES)
def test_machines_agree_with_plans(spark, pipeline):
    p = parse_pipeline(pipeline)
    data = rows(len(pipeline))
    m = machine(p.ops[0])
    made = [r for d in data for r in m.push(d)] + m.flush()
    e = Engine(spark)
    e.run_script("create stream s")
    e.insert("s", data)
    got = [r.asDict(recursive=True) for r in e.query(pipeline, sort=True).collect()]
    number = lambda v: round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    plain = lambda rs: [{k: number(v) for k, v in r.items()} for r in rs]
    if "over" in pipeline:  # windows may close in another order than they are listed
        order = lambda rs: sorted(map(repr, (sorted(r.items()) for r in plain(rs))))
        assert order(got) == order(made)
    else:
        assert plain(got) == plain(made)


def collect(into):
    return lambda df, _: into.extend(r.asDict(recursive=True) for r in df.collect())


def test_stateless_flow_and_inserts(spark, tmp_path):
    land, seen, teed = LandingFolder(str(tmp_path / "in")), [], []
    land.insert(rows(1))
    q = start("s | where v > 4 | select { t, double: v * 2 } | insert_into(big) | where double > 14", land.stream(spark, "t long, k string, v long"), str(tmp_path / "c"), collect(seen), lambda name, df: teed.extend((name, r.double) for r in df.collect()), availableNow=True)
    q.awaitTermination(120)
    want = [r["v"] * 2 for r in rows(1) if r["v"] > 4]
    assert sorted(d for _, d in teed) == sorted(want) and {n for n, _ in teed} == {"big"}
    assert sorted(r["double"] for r in seen) == sorted(x for x in want if x > 14)


def test_state_outlives_a_restart_and_flush_emits(spark, tmp_path):
    land, seen = LandingFolder(str(tmp_path / "in")), []
    pipeline = "s | summarize { k, n: count(), total: sum(v) } by k emit every 4"
    data = rows(2, 20)
    for part in (data[:9], data[9:]):
        land.insert(part)
        q = start(pipeline, land.stream(spark, "t long, k string, v long"), str(tmp_path / "c"), collect(seen), order_by=["t"], availableNow=True)
        q.awaitTermination(120)
    land.flush()
    start(pipeline, land.stream(spark, "t long, k string, v long"), str(tmp_path / "c"), collect(seen), order_by=["t"], availableNow=True).awaitTermination(120)
    m = machine(parse_pipeline(pipeline).ops[0])
    want = [r for d in data for r in m.push(d)] + m.flush()
    assert seen == want


def test_event_time_windows_are_sparks_own(spark, tmp_path):
    land, seen = LandingFolder(str(tmp_path / "in")), []
    land.insert([{"at": f"2024-01-01T00:{i:02}:00", "v": i} for i in range(0, 40)])
    q = start("s | summarize { start: w.start, n: count(), total: sum(v) } over w = tumbling_window_by(10m, epoch(at))", land.stream(spark, "at timestamp, v long"), str(tmp_path / "c"), collect(seen), watermark="1 minute", availableNow=True)
    q.awaitTermination(120)
    assert sorted((r["start"] - 1704067200, r["n"], r["total"]) for r in seen) == [(600 * i, 10, sum(range(10 * i, 10 * i + 10))) for i in range(3)]


def test_engine_flow_feeds_subscribers(spark, tmp_path):
    e, heard = Engine(spark), []
    e.run_script("create stream s; create stream out; create flow f as s | where v > 5 | insert_into(out)")
    e.catalog.subscribe("out", lambda stream, d: heard.append(d["v"]))
    land = LandingFolder(str(tmp_path / "in"))
    land.insert(rows(3))
    q = start_flow(e, "f", land.stream(spark, "t long, k string, v long"), str(tmp_path / "c"), availableNow=True)
    q.awaitTermination(120)
    assert sorted(heard) == sorted(r["v"] for r in rows(3) if r["v"] > 5)
    e.stop_flow("f")


def test_clock_intervals_and_a_bounded_backlog(spark, tmp_path):
    """``every_interval`` counts the clock, so a first row fires and one soon after doesn't; files come one a batch."""
    m = machine(parse_pipeline("s | summarize { n: count() } emit every_interval(50)").ops[0])
    assert [len(m.push({}, now)) for now in (0.0, 0.04, 0.05, 0.09, 0.2)] == [1, 0, 1, 0, 1]
    land, batches = LandingFolder(str(tmp_path / "in")), []
    for i in range(3):
        land.insert([{"v": i}])
    q = start("s | summarize { n: count() } emit every 3600000", land.stream(spark, "v long", max_files=1), str(tmp_path / "c"), lambda df, n: batches.append(df.count()), availableNow=True)
    q.awaitTermination(120)
    assert len(batches) >= 3 and sum(batches) == 1


def test_a_live_flow_that_ends_hands_out_what_it_holds(spark, tmp_path):
    e, heard = Engine(spark), []
    e.run_script("create stream s; create stream out; create flow f as s | summarize { n: count(), me: median(v) } | insert_into(out)")
    e.catalog.subscribe("out", lambda stream, d: heard.append(d))
    land = LandingFolder(str(tmp_path / "in"))
    land.insert([{"v": 1}, {"v": 2}])
    start_flow(e, "f", land.stream(spark, "v long"), str(tmp_path / "c"), landing=land)
    assert e.execute("delete stream s").success
    assert heard == [{"n": 2, "me": 1.5}] and not e.catalog.flows
