"""Registered queries over the driver's tables: pipelines of the language, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.sorter import sorter
from .plans.engine import Engine
from .storage import remove_at_end, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Tables with a total order that is part of their data.
ORDERS = {"events": ["ts", "event_id"], "conversations": ["conv_id", "turn"], "orders": ["o_orderkey"], "customer": ["c_custkey"], "embeddings": ["vec_id"]}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "conversations")


def engine(spark: SparkSession, sf_dir: str, script: str = "events") -> Engine:
    """An engine with the tables that ``script`` names; each costs a look at its files."""
    e = Engine(spark)
    for name in sorted(set(TABLES) & set(re.findall(r"\w+", script))):
        e.register_stream(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), ORDERS.get(name))
    return e


def register(name: str, pipeline: str, sql: str, setup: str = "", rounded: dict[str, int] | None = None) -> None:
    """A query from a pipeline; ``setup`` runs first, ``rounded`` names columns of doubles and their digits."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, f"{setup} {pipeline}")
        for r in e.run_script(setup):
            if not r.success:
                raise ValueError(r.message)
        df = e.query(pipeline)
        return df.withColumns({c: F.round(c, n) for c, n in (rounded or {}).items()})

    QUERIES[name] = run
    SQL[name] = sql


E_ = "floor(epoch_us(ts) / 1000000)::BIGINT"
N_ = "(row_number() OVER (ORDER BY ts, event_id) - 1)"

# Filters and expressions

register("where_basic", 'events | where value > 50 && event_type == "purchase" | select { event_id, value }', "SELECT event_id, value FROM events WHERE value > 50 AND event_type = 'purchase'")
register("where_or_not", 'events | where (user_id < 5 || value >= 400) && !(event_type == "click") | select { event_id, user_id, event_type }', "SELECT event_id, user_id, event_type FROM events WHERE (user_id < 5 OR value >= 400) AND event_type <> 'click'")
register("where_words_in_null", 'events | where event_type in ("click", "view") and value is not null and not value > 300 | select { event_id }', "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND value IS NOT NULL AND NOT value > 300")
register("iff_ternary", 'events | select { event_id, size: iff(value > 300, "large", value > 100 ? "middle" : "small"), odd: user_id % 2 == 1 }', "SELECT event_id, CASE WHEN value > 300 THEN 'large' WHEN value > 100 THEN 'middle' ELSE 'small' END AS size, user_id % 2 = 1 AS odd FROM events")
register("select_spread_exclude", "events | select { ...*, -props, -ts, doubled: value * 2 }", "SELECT event_id, user_id, event_type, value, value * 2 AS doubled FROM events")
register("select_shorthand_lookup", "events | where value > threshold | select { event_id, limit: threshold, label: names.high }", "SELECT event_id, 450 AS \"limit\", 'top' AS label FROM events WHERE value > 450", 'create lookup threshold = 450; create lookup names = { high: "top", low: "rest" }')
register("text_concat", 'nation | select { n_nationkey, shown: n_name + " (" + n_regionkey + ")" }', "SELECT n_nationkey, n_name || ' (' || n_regionkey || ')' AS shown FROM nation")
register("value_or_and", 'customer | select { c_custkey, bal: c_acctbal > 0 && c_acctbal, seg: null || c_mktsegment }', "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal <> 0 ELSE false END AS bal, c_mktsegment AS seg FROM customer")
register("object_array", "part | select { p_partkey, o: { k: p_size, half: p_size / 2 }, a: [p_size, p_size + 1] } | select { p_partkey, half: o.half, second: a[1], none: a[9], n: a.length }", "SELECT p_partkey, p_size / 2 AS half, p_size::BIGINT + 1 AS second, NULL::BIGINT AS none, 2::BIGINT AS n FROM part")
register("array_index", "embeddings | select { vec_id, e0: embedding[0], dyn: embedding[label], oob: embedding[9999], n: embedding.length }", "SELECT vec_id, embedding[1] AS e0, embedding[label + 1] AS dyn, NULL::FLOAT AS oob, len(embedding)::BIGINT AS n FROM embeddings")
register(
    "scalar_fns_arithmetic",
    "events | select { event_id, a: add(user_id, 2, 3), s: sub(user_id, 1), m: mul(user_id, 2), d: div(value, 4), r: mod(user_id, 7), p: pow(user_id, 2), n: neg(user_id), b: abs(neg(value)) }",
    "SELECT event_id, user_id + 5 AS a, user_id - 1 AS s, user_id * 2 AS m, value / 4 AS d, user_id % 7 AS r, user_id::DOUBLE ** 2 AS p, -user_id AS n, value AS b FROM events",
)
register(
    "scalar_fns_logic",
    'events | select { event_id, e: eq(user_id, 3), ne: ne(user_id, 3), l: lt(value, 100), le: le(value, 100), g: gt(value, 100), ge: ge(value, 100), lo: min(user_id, 10), hi: max(user_id, 10), both: and(value, user_id > 5), any: or(user_id > 5, value > 400), no: not(user_id > 5) }',
    "SELECT event_id, user_id = 3 AS e, user_id <> 3 AS ne, value < 100 AS l, value <= 100 AS le, value > 100 AS g, value >= 100 AS ge, least(user_id, 10) AS lo, greatest(user_id, 10) AS hi, value <> 0 AND user_id > 5 AS \"both\", user_id > 5 OR value > 400 AS \"any\", NOT user_id > 5 AS \"no\" FROM events",
)
register("scalar_fns_math", "events | select { event_id, x: exp(value / 1000), p: pi() }", "SELECT event_id, round(exp(value / 1000), 9) AS x, round(pi(), 9) AS p FROM events", rounded={"x": 9, "p": 9})
register("documented_fns", 'customer | select { c_custkey, u: to_upper(c_mktsegment), n: length(c_name), e: exists(c_name), i: if(c_acctbal > 0, "plus", "minus") }', "SELECT c_custkey, upper(c_mktsegment) AS u, length(c_name) AS n, c_name IS NOT NULL AS e, CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END AS i FROM customer")
register("array_lambdas", "part | select { p_partkey, a: [p_size, 5, 10] } | select { p_partkey, d: a.map(x => x * 2)[0], f: a.filter(x => x > 5).length, r: a.reduce((s, x) => s + x, 0) }", "SELECT p_partkey, p_size::BIGINT * 2 AS d, (CASE WHEN p_size > 5 THEN 2 ELSE 1 END)::BIGINT AS f, p_size::DOUBLE + 15 AS r FROM part")


register("unary_signs", "events | select { event_id, m: -value, p: +user_id, t: -(user_id + 1) }", "SELECT event_id, -value AS m, user_id AS p, -(user_id + 1) AS t FROM events")
register("select_spread_expr", "nation | select { ...{ k: n_nationkey, name: n_name }, r: n_regionkey }", "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation")
register("select_conditional_spread", 'events | select { event_id, ...(value > 300 ? { size: "large" } : { size: "small" }) }', "SELECT event_id, CASE WHEN value > 300 THEN 'large' ELSE 'small' END AS size FROM events")
register("index_then_field", "part | select { p_partkey, a: [{ s: p_size * 2 }, { s: p_size + 1 }] } | select { p_partkey, s: a[1].s, none: a[5].s }", "SELECT p_partkey, p_size::BIGINT + 1 AS s, NULL::BIGINT AS none FROM part")
register("date_text", 'events | select { event_id, month: format_date(ts, "yyyy-MM"), recent: now() > epoch(ts) }', "SELECT event_id, strftime(ts, '%Y-%m') AS month, true AS recent FROM events")


def _nested_path_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.register_stream("events", events.withColumn("props", F.from_json("props", "k int")), ORDERS["events"])
    return e.query("events | where props.k > 50 | select { event_id, k: props.k, missing: props.none.deeper }").withColumn("missing", F.col("missing").cast("string"))


QUERIES["nested_path_json"] = _nested_path_json
SQL["nested_path_json"] = "SELECT event_id, json_extract(props, '$.k')::INTEGER AS k, NULL::VARCHAR AS missing FROM events WHERE json_extract(props, '$.k')::INTEGER > 50"


def _variant_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemaless rows: paths into a variant column."""
    e = Engine(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("doc", F.parse_json("props")).select("event_id", "doc", "ts")
    e.register_stream("docs", events, ["ts", "event_id"])
    return e.query("docs | select { event_id, k: doc.k }").withColumn("k", F.col("k").cast("int"))


QUERIES["variant_path"] = _variant_path
SQL["variant_path"] = "SELECT event_id, json_extract(props, '$.k')::INTEGER AS k FROM events"

# Aggregation

register("summarize_global", "events | summarize { total: sum(value), n: count() }", "SELECT round(sum(value), 2) AS total, count(*) AS n FROM events", rounded={"total": 2})
register("summarize_by", "events | summarize { event_type, total: sum(value), n: count() } by event_type", "SELECT event_type, round(sum(value), 2) AS total, count(*) AS n FROM events GROUP BY event_type", rounded={"total": 2})
register("summarize_multi_by", "lineitem | summarize { l_returnflag, l_linestatus, qty: sum(l_quantity), n: count(), revenue: sum(l_extendedprice * (1 - l_discount)) } by l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ALL", rounded={"revenue": 2})
register("summarize_key_hidden", "orders | summarize { n: count(), total: sum(o_totalprice) } by o_orderstatus", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus", rounded={"total": 2})
register("summarize_last", "events | summarize { event_type, value, who: user_id } by event_type", "SELECT event_type, arg_max(value, (ts, event_id)) AS value, arg_max(user_id, (ts, event_id)) AS who FROM events GROUP BY event_type")
register("summarize_post_agg", "events | summarize { event_type, mean: sum(value) / count(), ratio: div(sum(value), count() * 2), kind: iff(count() > 100, \"many\", \"few\") } by event_type", "SELECT event_type, round(sum(value) / count(*), 6) AS mean, round(sum(value) / (count(*) * 2), 6) AS ratio, CASE WHEN count(*) > 100 THEN 'many' ELSE 'few' END AS kind FROM events GROUP BY event_type", rounded={"mean": 6, "ratio": 6})
register("summarize_literal_exclude", 'events | summarize { tag: "all", n: count(), extra: sum(value), -extra }', "SELECT 'all' AS tag, count(*) AS n FROM events")
register("summarize_key_expr", "events | summarize { band: floor(value / 100), n: count() } by floor(value / 100)", "SELECT floor(value / 100)::BIGINT AS band, count(*) AS n FROM events GROUP BY 1")
register("summarize_object_key", "orders | summarize { n: count() } by { s: o_orderstatus, p: o_orderpriority }", "SELECT count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority")
register("summarize_nested_output", "events | summarize { event_type, stats: { n: count(), total: sum(user_id) } } by event_type | select { event_type, n: stats.n, total: stats.total }", "SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS total FROM events GROUP BY event_type")
register("having_as_where", "orders | summarize { o_custkey, n: count() } by o_custkey | where n > 10", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10")
register(
    "summarize_tier2",
    'events | summarize { event_type, a: avg(value), lo: min(value), hi: max(value), users: count_distinct(user_id), sd: stddev(value), va: variance(value), me: median(value), p9: percentile(value, 0.9), big: count_if(value > 100), bs: sum_if(value, value > 100), ba: avg_if(value, value > 100) } by event_type',
    "SELECT event_type, round(avg(value), 6) AS a, min(value) AS lo, max(value) AS hi, count(DISTINCT user_id) AS users, round(stddev(value), 6) AS sd, round(variance(value), 4) AS va, round(median(value), 6) AS me, round(quantile_cont(value, 0.9), 6) AS p9, count(*) FILTER (value > 100) AS big, round(sum(value) FILTER (value > 100), 2) AS bs, round(avg(value) FILTER (value > 100), 6) AS ba FROM events GROUP BY event_type",
    rounded={"a": 6, "sd": 6, "va": 4, "me": 6, "p9": 6, "bs": 2, "ba": 6},
)

register("summarize_last_scalar", "events | summarize { event_type, twice: user_id * 2, sum: add(user_id, event_id) } by event_type", "SELECT event_type, arg_max(user_id, (ts, event_id)) * 2 AS twice, arg_max(user_id + event_id, (ts, event_id)) AS \"sum\" FROM events GROUP BY event_type")
register("summarize_unnamed", "events | summarize { event_type, count(), sum(user_id) } by event_type", "SELECT event_type, count(*) AS count, sum(user_id)::BIGINT AS sum_user_id FROM events GROUP BY event_type")

# Windows

_W = "_id: w._id, start: w.start, end: w.end"
register("win_tumbling_count", f"events | summarize {{ {_W}, n: count(), total: sum(value) }} over w = tumbling_window(100)", f"SELECT i // 100 AS _id, i // 100 * 100 AS start, i // 100 * 100 + 100 AS \"end\", count(*) AS n, round(sum(value), 2) AS total FROM (SELECT *, {N_} AS i FROM events) GROUP BY i // 100", rounded={"total": 2})
register("win_count", "events | summarize { event_type, start: w.start, size: w.count, n: count() } by event_type over w = count_window(250)", f"SELECT event_type, i // 250 * 250 AS start, 250 AS size, count(*) AS n FROM (SELECT *, {N_} AS i FROM events) GROUP BY event_type, i // 250")
register("win_tumbling_by", "events | summarize { start: w.start, event_type, n: count(), total: sum(value) } by event_type over w = tumbling_window_by(3600, epoch(ts))", f"SELECT {E_} // 3600 * 3600 AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2", rounded={"total": 2})
register("win_tumbling_duration", "events | summarize { start: w.start, n: count() } over w = tumbling_window_by(1d, epoch(ts))", f"SELECT {E_} // 86400 * 86400 AS start, count(*) AS n FROM events GROUP BY 1")
register("win_hopping_count", f"events | summarize {{ {_W}, n: count() }} over w = hopping_window(500, 200)", f"SELECT k AS _id, k * 200 AS start, k * 200 + 500 AS \"end\", count(*) AS n FROM (SELECT {N_} AS i FROM events), generate_series(0, (SELECT count(*) // 200 FROM events)) g(k) WHERE i >= k * 200 AND i < k * 200 + 500 GROUP BY k")
register("win_hopping_by", "events | summarize { start: w.start, n: count(), total: sum(value) } over w = hopping_window_by(7200, 3600, epoch(ts))", f"SELECT start, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT value, unnest([{E_} // 3600 * 3600, {E_} // 3600 * 3600 - 3600]) AS start FROM events) GROUP BY start", rounded={"total": 2})
register("win_sliding_count", "events | summarize { event_id, n: count(), total: sum(value) } over w = sliding_window(10)", "SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 2) AS total FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)", rounded={"total": 2})
register("win_sliding_by", "events | summarize { event_id, n: count(), hi: max(value) } over w = sliding_window_by(3600, epoch(ts))", f"SELECT max(event_id) OVER w AS event_id, count(*) OVER w AS n, max(value) OVER w AS hi FROM (SELECT *, {E_} AS e FROM events) WINDOW w AS (ORDER BY e RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW)")
register("win_session", "events | summarize { start: w.start, end: w.end, id: w._id, n: count() } over w = session_window(300, epoch(ts))", f"WITH f AS (SELECT e, sum(open) OVER (ORDER BY ts, event_id) AS sid FROM (SELECT ts, event_id, {E_} AS e, CASE WHEN {E_} - lag({E_}) OVER (ORDER BY ts, event_id) <= 300 THEN 0 ELSE 1 END AS open FROM events)) SELECT min(e) AS start, max(e) + 300 AS \"end\", sid::BIGINT AS id, count(*) AS n FROM f GROUP BY sid")
register("win_spread", "events | summarize { n: count(), ...w } over w = tumbling_window(1000)", f"SELECT count(*) AS n, i // 1000 AS _id, i // 1000 AS \"windowId\", i // 1000 * 1000 AS start, i // 1000 * 1000 + 1000 AS \"end\", 1000 AS size, 'tumbling' AS type, 'count' AS mode FROM (SELECT {N_} AS i FROM events) GROUP BY i // 1000")

register("win_tumbling_value", "events | summarize { start: w.start, n: count() } over w = tumbling_window(7, user_id)", "SELECT user_id // 7 * 7 AS start, count(*) AS n FROM events GROUP BY 1")
register("win_hopping_value", "events | summarize { start: w.start, n: count() } over w = hopping_window(20, 10, user_id)", "SELECT start, count(*) AS n FROM (SELECT unnest([user_id // 10 * 10, user_id // 10 * 10 - 10]) AS start FROM events) GROUP BY start")
register("win_hopping_time", "events | summarize { start: w.start, event_type, n: count() } over w = hopping_window(2h, 1h, epoch(ts)) by event_type", f"SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([{E_} // 3600 * 3600, {E_} // 3600 * 3600 - 3600]) AS start FROM events) GROUP BY ALL")
register("win_sliding_value", "events | summarize { id: w._id, n: count(), hi: max(value) } over w = sliding_window(3, user_id)", "SELECT user_id AS id, count(*) OVER w AS n, max(value) OVER w AS hi FROM events WINDOW w AS (ORDER BY user_id RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)")
_SESSIONS = f"f AS (SELECT *, sum(open) OVER (ORDER BY ts, event_id) AS sid FROM (SELECT *, {E_} AS e, CASE WHEN {E_} - lag({E_}) OVER (ORDER BY ts, event_id) <= 300 THEN 0 ELSE 1 END AS open FROM events))"
register("win_session_by", "events | summarize { event_type, id: w._id, start: w.start, end: w.end, n: count() } by event_type over w = session_window(300, epoch(ts))", f"WITH {_SESSIONS}, b AS (SELECT sid, min(e) AS start, max(e) + 300 AS \"end\" FROM f GROUP BY sid) SELECT event_type, sid::BIGINT AS id, start, \"end\", count(*) AS n FROM f JOIN b USING (sid) GROUP BY ALL")
register("win_session_row_bounds", "events | summarize { id: w._id, late: sum(epoch(ts) - w.start) } over w = session_window(300, epoch(ts))", f"WITH {_SESSIONS}, b AS (SELECT sid, min(e) AS start FROM f GROUP BY sid) SELECT sid::BIGINT AS id, sum(e - start)::BIGINT AS late FROM f JOIN b USING (sid) GROUP BY sid")

# Emitting


def _emit_sql(hit: str, epoch: str | None = None) -> str:
    e = epoch or "sum(hit::INT) OVER (ORDER BY ts, event_id) - hit::INT"
    return f"""WITH r AS (SELECT *, {N_} AS i FROM events), h AS (SELECT *, {hit} AS hit FROM r), e AS (SELECT *, {e} AS e FROM h),
t AS (SELECT unnest(generate_series(0, (SELECT coalesce(sum(hit::INT), 0) FROM e)::BIGINT)) AS t),
s AS (SELECT event_type, e, count(*) AS n, sum(user_id) AS u, arg_max(event_id, i) AS l FROM e GROUP BY event_type, e)
SELECT event_type, sum(n)::BIGINT AS n, sum(u)::BIGINT AS users, arg_max(l, e) AS last FROM t JOIN s ON s.e <= t.t GROUP BY t.t, event_type"""


_EMIT = "events | summarize { event_type: event_type, n: count(), users: sum(user_id), last: event_id } by event_type emit "
register("emit_every_n", _EMIT + "every 50", _emit_sql("i % 50 = 0"))
register("emit_every_count", _EMIT + "every_count(50)", _emit_sql("(i + 1) % 50 = 0"))
register("emit_variance", "events | summarize { n: count(), va: variance(user_id), sd: stddev(user_id) } emit on update", "SELECT count(*) OVER w AS n, round(var_samp(user_id) OVER w, 6) AS va, round(stddev_samp(user_id) OVER w, 6) AS sd FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) UNION ALL SELECT count(*), round(var_samp(user_id), 6), round(stddev_samp(user_id), 6) FROM events", rounded={"va": 6, "sd": 6})
register("emit_when", _EMIT + "when value > 450", _emit_sql("value > 450"))
register("emit_on_change", _EMIT + "on change user_id", _emit_sql("i = 0 OR user_id <> lag(user_id) OVER (ORDER BY ts, event_id)"))
register("emit_on_group_change", _EMIT + "on group change", _emit_sql("i = 0 OR event_type <> lag(event_type) OVER (ORDER BY ts, event_id)"))
register("emit_on_update", "events | summarize { n: count(), users: sum(user_id) } emit on update", "SELECT count(*) OVER w AS n, sum(user_id) OVER w::BIGINT AS users FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) UNION ALL SELECT count(*), sum(user_id)::BIGINT FROM events")
register(
    "emit_every_using",
    "events | summarize { n: count() } emit every 3600 using epoch(ts)",
    f"""WITH RECURSIVE r AS (SELECT {N_} AS i, {E_} AS x FROM events), t(i, x) AS (SELECT i, x FROM r WHERE i = 0 UNION ALL
SELECT (nxt).i, (nxt).x FROM (SELECT arg_min({{'i': r.i, 'x': r.x}}, r.i) AS nxt FROM t, r WHERE r.i > t.i AND r.x - t.x >= 3600) WHERE nxt IS NOT NULL)
SELECT i + 1 AS n FROM t UNION ALL SELECT count(*) FROM events""",
)

# Scans

register("scan_running_total", "events | scan(step s: true => s.total = (s.total || 0) + user_id, emit({ event_id: event_id, total: s.total }))", "SELECT event_id, sum(user_id) OVER (ORDER BY ts, event_id)::BIGINT AS total FROM events")
register(
    "scan_fold_max",
    "events | scan(step s: true => s.top = s.top > value ? s.top : value, s.n = (s.n || 0) + 1, emit({ event_id: event_id, top: s.top, n: s.n }))",
    "SELECT event_id, max(value) OVER w AS top, count(*) OVER w AS n FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
)
register(
    "scan_by_key",
    "events | scan by user_id (step s: value > 100 => s.n = (s.n || 0) + 1, emit({ event_id: event_id, user_id: user_id, n: s.n }))",
    "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE value > 100",
)
register(
    "scan_funnel",
    'events | scan(step a: event_type == "signup" => a.n = 1; step b: event_type == "purchase" => b.n = (b.n || 0) + 1, emit({ event_id: event_id, n: b.n }))',
    # The last step's slot stays: each purchase after the first match emits; a signup before it starts the count anew.
    f"""WITH r AS (SELECT *, {N_} AS i FROM events), c AS (SELECT i, event_id, event_type,
  (SELECT count(*) FROM r q WHERE q.i < r.i AND q.event_type = 'signup' AND q.i > coalesce((SELECT max(p.i) FROM r p WHERE p.i < r.i AND p.event_type = 'purchase'), -1)) > 0 AS fresh
  FROM r WHERE event_type = 'purchase'), g AS (SELECT *, sum(fresh::INT) OVER (ORDER BY i) AS g FROM c)
SELECT event_id, count(*) OVER (PARTITION BY g ORDER BY i) AS n FROM g WHERE g > 0""",
)

# Streams of streams, sinks and sources

register("insert_into_chain", "totals | where n > 1500", "SELECT * FROM (SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE value > 10 GROUP BY event_type) WHERE n > 1500", "create stream big; create stream totals; create flow f1 as events | where value > 10 | insert_into(big); create flow f2 as big | summarize { event_type, n: count(), total: sum(value) } by event_type | insert_into(totals)", {"total": 2})
register("fanout_union", "both | summarize { kind, n: count(), total: sum(amount) } by kind", "SELECT kind, count(*) AS n, round(sum(amount), 2) AS total FROM (SELECT 'e' AS kind, value AS amount FROM events UNION ALL SELECT 'o', o_totalprice FROM orders) GROUP BY kind", 'create stream both; create flow a as events | select { kind: "e", amount: value } | insert_into(both); create flow b as orders | select { kind: "o", amount: o_totalprice } | insert_into(both)', {"total": 2})
register("tee_midway", "tee | summarize { n: count() }", "SELECT count(*) AS n FROM events WHERE value > 100", "create stream tee; create flow f as events | where value > 100 | insert_into(tee) | where value > 200")


def _sorter_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their place in the sorter's own output: the place in a partition, and the sizes of those before it."""
    out = sorter(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value"), "value", "event_id")
    # The upper bits of the running number are the partition's, the lower 33 the place in it.
    numbered = out.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33))
    sizes = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return numbered.join(F.broadcast(before), "part").select("event_id", "value", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).alias("rank"))


QUERIES["sorter_batch"] = _sorter_batch
SQL["sorter_batch"] = "SELECT event_id, value, row_number() OVER (ORDER BY value, event_id) AS rank FROM events"


def _map_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python function over rows, and the language over what it makes."""
    e = engine(spark, sf_dir)
    e.register_map("events", "large", lambda r: {"event_id": r["event_id"], "word": r["event_type"][::-1]} if r["value"] > 250 else None, "event_id long, word string")
    return e.query("large | summarize { word, n: count(), last: event_id } by word")


QUERIES["map_rows"] = _map_rows
SQL["map_rows"] = "SELECT reverse(event_type) AS word, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last FROM events WHERE value > 250 GROUP BY event_type"


def _sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows through the NDJSON sink and back, in a folder that the cluster shares."""
    path = shared_folder(spark)
    e = engine(spark, sf_dir)
    e.query(f'events | where value > 250 | select {{ event_id, event_type, value }} | write_to_file("{path}", {{ mode: "overwrite" }})')
    remove_at_end(spark, path)
    return spark.read.schema("event_id long, event_type string, value double").json(path)


QUERIES["sink_roundtrip"] = _sink_roundtrip
SQL["sink_roundtrip"] = "SELECT event_id, event_type, value FROM events WHERE value > 250"


def _registered_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.register_function("half", lambda c: c / 2)
    e.register_aggregate("spread", lambda c: F.max(c) - F.min(c))
    return e.query("events | summarize { event_type, s: spread(user_id), h: sum(half(user_id)) } by event_type")


QUERIES["registered_functions"] = _registered_functions
SQL["registered_functions"] = "SELECT event_type, max(user_id) - min(user_id) AS s, sum(user_id / 2) AS h FROM events GROUP BY event_type"
