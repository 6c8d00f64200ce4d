"""Queries over walks, queues and writes that depend on what was decided before: chains, budgets, states of a search, jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.dates import micros
from factloom.operators import graph as G
from factloom.operators.stored import place, stored
from factloom.operators.versions import Versions
from factloom.operators import snapshots as S
from factloom.operators import stateful

from .registry import QUERIES, query, table
from .verdicts import TREE, _tree

_HOUR = 3_600_000_000


@query("""WITH RECURSIVE e AS (SELECT event_id AS node, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS up FROM events),
w AS (SELECT node, up, [up] AS ups FROM e WHERE up IS NOT NULL UNION ALL SELECT w.node, e.up, list_append(w.ups, e.up) FROM w JOIN e ON e.node = w.up WHERE e.up IS NOT NULL AND len(w.ups) < 8)
SELECT node AS event_id, array_to_string(list_reverse(arg_max(ups, len(ups))), '>') AS chain FROM w GROUP BY 1""")
def g4_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").select(before.alias("source"), F.col("event_id").alias("target"), F.lit(0).alias("ord")).where("source IS NOT NULL")
    return G.provenance(e, 8).select(F.col("node").alias("event_id"), F.array_join(F.transform("chain", lambda x: x.cast("string")), ">").alias("chain"))


#: A walk of each region: from it to its nations, from those to their customers and, as files, their suppliers; a rich one is an item of a repository.
_PAGES, _NODES, _FILES = 4, 120, 3
WALK = f"""l AS (SELECT n_regionkey AS run, 'r' || n_regionkey AS source, 'n' || n_nationkey AS target, n_nationkey AS pos, false AS file, false AS listed FROM nation UNION ALL SELECT n_regionkey, 'n' || n_nationkey, 'c' || c_custkey, c_custkey, false, false FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_regionkey, 'n' || n_nationkey, 's' || s_suppkey, s_suppkey, true, s_acctbal > 5000 FROM supplier JOIN nation ON s_nationkey = n_nationkey),
w0 AS (SELECT r_regionkey AS run, 'r' || r_regionkey AS node, 0 AS depth, 1 AS place, false AS file, false AS listed, true AS opened FROM region),
w1 AS (SELECT * FROM (SELECT run, target AS node, 1 AS depth, 1 + row_number() OVER (PARTITION BY run ORDER BY pos, target) AS place, false AS file, false AS listed FROM l JOIN w0 USING (run) WHERE l.source = w0.node) WHERE place <= {_NODES}),
o1 AS (SELECT *, place <= {_PAGES} AS opened FROM w1), h AS (SELECT run, count(*) AS held FROM (SELECT run FROM w0 UNION ALL SELECT run FROM o1) GROUP BY 1),
w2 AS (SELECT * FROM (SELECT run, target AS node, 2 AS depth, held + row_number() OVER (PARTITION BY run ORDER BY o1.place, pos, target) AS place, l.file, l.listed FROM l JOIN o1 USING (run) JOIN h USING (run) WHERE l.source = o1.node AND opened) WHERE place <= {_NODES}),
u AS (SELECT *, row_number() OVER (PARTITION BY run, file ORDER BY listed DESC, place) AS turn FROM (SELECT * FROM w0 UNION ALL SELECT * FROM o1 UNION ALL SELECT *, false FROM w2)),
w AS (SELECT run, node, depth, place, file, opened OR (file AND turn <= {_FILES}) AS opened, CASE WHEN opened OR (file AND turn <= {_FILES}) THEN 'OPENED' WHEN file THEN 'FILE_BUDGET' WHEN depth = 2 THEN 'DEPTH_LIMIT' ELSE 'PAGE_BUDGET' END AS state FROM u)"""


def _walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    links = n.select(F.col("n_regionkey").alias("run"), name("r", "n_regionkey").alias("source"), name("n", "n_nationkey").alias("target"), F.col("n_nationkey").cast("long").alias("pos")).union(
        c.join(n, "n_nationkey").select("n_regionkey", name("n", "n_nationkey"), name("c", "c_custkey"), "c_custkey")
    )
    links = links.withColumns({"file": F.lit(False), "listed": F.lit(False)})
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", "s_acctbal").join(n, "n_nationkey")
    links = links.union(s.select("n_regionkey", name("n", "n_nationkey"), name("s", "s_suppkey"), "s_suppkey", F.lit(True), F.col("s_acctbal") > 5000))
    roots = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("run"), name("r", "r_regionkey").alias("node"))
    return G.walk(links, roots, 2, _PAGES, _NODES, _FILES)


@query(f"WITH {WALK} SELECT run, node, CAST(depth AS INTEGER) AS depth, CAST(place AS BIGINT) AS place, file, opened, state FROM w")
def g5_bounded_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk(spark, sf_dir)


@query(f"WITH {WALK} SELECT run, state AS reason, count(*) AS n FROM w WHERE NOT opened GROUP BY 1, 2")
def g7_skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk(spark, sf_dir).where("NOT opened").groupBy("run", F.col("state").alias("reason")).agg(F.count("*").alias("n"))


SEARCH = f"""{WALK}, k AS (SELECT n_regionkey AS run, 'c' || c_custkey AS node, c_mktsegment AS role, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey),
r AS (SELECT k.run, role, bool_or(w.node IS NOT NULL AND c_acctbal > 9900) AS sure, bool_or(w.node IS NOT NULL AND c_acctbal > 9700) AS maybe, bool_or(w.node IS NOT NULL AND c_acctbal < -900) AS unreadable, count(w.node) AS seen, count(*) AS every FROM k LEFT JOIN w ON w.run = k.run AND w.node = k.node GROUP BY 1, 2)"""


@query(f"""WITH {SEARCH} SELECT run, role, CASE WHEN sure THEN 'FOUND_VERIFIED' WHEN maybe THEN 'FOUND_AMBIGUOUS' WHEN unreadable THEN 'FOUND_UNREADABLE' WHEN seen = 0 THEN 'NOT_SEARCHED' WHEN seen = every THEN 'NOT_FOUND_AFTER_DISCOVERY' ELSE 'SEARCH_INCOMPLETE' END AS state FROM r""")
def g8_search_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be said of each role of each run: it is absent only where everything that could hold it was read."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("run"))
    k = table(spark, sf_dir, "customer").join(n, "c_nationkey").select("run", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.col("c_mktsegment").alias("role"), "c_acctbal")
    met = k.join(_walk(spark, sf_dir).select("run", "node", F.lit(True).alias("seen")), ["run", "node"], "left")
    seen, b = F.coalesce("seen", F.lit(False)), F.col("c_acctbal")
    r = met.groupBy("run", "role").agg(F.bool_or(seen & (b > 9900)).alias("sure"), F.bool_or(seen & (b > 9700)).alias("maybe"), F.bool_or(seen & (b < -900)).alias("unreadable"), F.count("seen").alias("read"), F.count("*").alias("every"))
    state = (
        F.when(F.col("sure"), "FOUND_VERIFIED").when(F.col("maybe"), "FOUND_AMBIGUOUS").when(F.col("unreadable"), "FOUND_UNREADABLE").when(F.col("read") == 0, "NOT_SEARCHED")
        .when(F.col("read") == F.col("every"), "NOT_FOUND_AFTER_DISCOVERY").otherwise("SEARCH_INCOMPLETE")
    )
    return r.select("run", "role", state.alias("state"))


@query(f"WITH {WALK} SELECT run, count(*) FILTER (opened) AS opened, count(*) FILTER (NOT opened) AS unread, CAST(max(depth) AS INTEGER) AS depth FROM w GROUP BY 1")
def g9_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk(spark, sf_dir).groupBy("run").agg(F.count_if("opened").alias("opened"), F.count_if(~F.col("opened")).alias("unread"), F.max("depth").alias("depth"))


@query(f"""WITH {TREE}, k AS (SELECT *, node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL) AS leaf FROM t), p AS (SELECT parent AS node, count(*) AS n, bool_and(leaf) AS flat FROM k WHERE parent IS NOT NULL GROUP BY 1)
SELECT node AS topic, least(n, 40) AS subtopics FROM p WHERE flat UNION ALL SELECT k.node, 0 FROM k LEFT JOIN p ON p.node = k.parent WHERE leaf AND (k.parent IS NULL OR NOT flat)""")
def g14_flat_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.flat_topics(_tree(spark, sf_dir))


@query("""WITH s AS (SELECT s_nationkey, CASE WHEN s_acctbal > 6000 THEN 2 WHEN s_acctbal > 1000 THEN 1 ELSE 0 END AS r FROM supplier), n AS (SELECT n_nationkey, n_regionkey, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN max(r) ELSE min(r) END, 1) AS r FROM nation LEFT JOIN s ON s_nationkey = n_nationkey GROUP BY 1, 2), g AS (SELECT r_regionkey, coalesce(min(r), 1) AS r FROM region LEFT JOIN n ON n_regionkey = r_regionkey GROUP BY 1),
a AS (SELECT 'n' || n_nationkey AS node, r FROM n UNION ALL SELECT 'r' || r_regionkey, r FROM g UNION ALL SELECT 's' || s_suppkey, CASE WHEN s_acctbal > 6000 THEN 2 WHEN s_acctbal > 1000 THEN 1 ELSE 0 END FROM supplier)
SELECT node, (['FAIL', 'UNKNOWN', 'OK'])[r + 1] AS state FROM a""")
def g15_rule_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("s_acctbal")
    own = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"), F.when(b > 6000, "OK").when(b > 1000, "UNKNOWN").otherwise("FAIL").alias("state"))
    number = F.regexp_extract("node", "[0-9]+", 0).cast("int")
    op = F.when(F.col("node").startswith("n") & (number % 2 == 0), "ANY").otherwise("ALL")
    return G.fold_rules(_tree(spark, sf_dir).join(own, "node", "left").withColumn("op", op))


IN_TURN = "n AS (SELECT event_id, user_id, event_type AS kind, epoch_us(ts) AS t_us, CAST(round(value * 1e9) AS BIGINT) AS takes, event_type = 'error' AS fails, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"
_ACTIVE = "len(list_filter(f.until, lambda u: u.kind = n.kind AND u.t > n.t_us)) > 0"
_TOOK = "(n.takes + CASE WHEN n.fails THEN 25000000 + 2 * n.takes ELSE 0 END)"
_BUSY = f"greatest(n.t_us, f.busy) + {_TOOK}"


@query(f"""WITH RECURSIVE {IN_TURN}, f AS (SELECT user_id, i, event_id, t_us + {_TOOK} AS busy, [{{'kind': kind, 't': t_us + {_TOOK}}}] AS until, t_us AS started FROM n WHERE i = 1
UNION ALL SELECT n.user_id, n.i, n.event_id, CASE WHEN {_ACTIVE} THEN f.busy ELSE {_BUSY} END, CASE WHEN {_ACTIVE} THEN f.until ELSE list_append(list_filter(f.until, lambda u: u.kind <> n.kind), {{'kind': n.kind, 't': {_BUSY}}}) END, CASE WHEN {_ACTIVE} THEN NULL ELSE greatest(n.t_us, f.busy) END
FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1) SELECT event_id, started FROM f""")
def k5_job_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each request's job starts; null where it is answered by one of its kind that is queued or running."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", micros(F.col("ts")).alias("at"), F.round(F.col("value") * 1e9).cast("long").alias("takes"), (F.col("event_type") == "error").alias("fails"))
    return stateful.fold(e, "user_id", ["at", "event_id"], stateful.job_queue(), ["at", "event_type", "takes", "fails"], "started", "long").select("event_id", "started")


@query(f"""WITH RECURSIVE {IN_TURN}, f AS (SELECT user_id, i, event_id, t_us AS last, true AS checked FROM n WHERE i = 1
UNION ALL SELECT n.user_id, n.i, n.event_id, CASE WHEN n.t_us - f.last <= {12 * _HOUR} THEN f.last ELSE n.t_us END, n.t_us - f.last > {12 * _HOUR} FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1) SELECT event_id, checked FROM f""")
def k6_link_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", micros(F.col("ts")).alias("at"))
    return stateful.fold(e, "user_id", ["at", "event_id"], stateful.debounced(12 * _HOUR), ["at"], "checked", "boolean").select("event_id", "checked")


@query("SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC) = 1")
def k8_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "value")
    return S.last_write(e, ["user_id", "k"], ["ts", "event_id"]).select("event_id", "user_id", "k", "value")


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders), f AS (SELECT min(day) - 10 AS first_run FROM d),
w AS (SELECT o_orderkey, days, day - CAST(days AS INTEGER) AS due, day - CAST(until AS INTEGER) AS until, first_run FROM d, f, (VALUES (7, 3), (3, 1), (1, 0)) v(days, until)),
s AS (SELECT *, due + CAST(((due - first_run) % 2) AS INTEGER) AS sent FROM w)
SELECT o_orderkey, CAST(days AS INTEGER) AS days, strftime(sent, '%Y-%m-%d') AS sent FROM s WHERE sent < until""")
def k10_sent_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reminders as a run every other day sends them: once each, at the first run in its window, never after it."""
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    first = F.broadcast(d.agg(F.date_sub(F.min("day"), 10).alias("first_run")))  # one row
    rules = F.explode(F.array(*[F.struct(F.lit(a).alias("days"), F.lit(b).alias("until")) for a, b in ((7, 3), (3, 1), (1, 0))]))
    w = d.select("o_orderkey", "day", rules.alias("r")).crossJoin(first).select("o_orderkey", "r.days", F.expr("date_sub(day, r.days)").alias("due"), F.expr("date_sub(day, r.until)").alias("until"), "first_run")
    sent = w.withColumn("sent", F.expr("date_add(due, datediff(due, first_run) % 2)")).where(F.col("sent") < F.col("until"))
    return sent.select("o_orderkey", "days", F.date_format("sent", "yyyy-MM-dd").alias("sent"))


@query("""WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), p AS (SELECT event_id, user_id, ts FROM e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM e a WHERE a.event_type = 'purchase' AND a.user_id = e.user_id AND a.k = e.k AND a.ts > e.ts))
SELECT event_id, user_id FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50""")
def k12_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports not yet acknowledged, of each user the newest 50: what is sent again."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.get_json_object("props", "$.k").cast("long").alias("k"))
    answered = e.where("event_type = 'purchase'").groupBy("user_id", "k").agg(F.max("ts").alias("answered"))
    open_ = e.where("event_type = 'error'").join(answered, ["user_id", "k"], "left").where(F.col("answered").isNull() | (F.col("answered") <= F.col("ts")))
    return S.newest(open_, ["user_id"], [F.desc("ts"), F.desc("event_id")], 50).select("event_id", "user_id")


@query(f"SELECT user_id, count(*) AS profiles, CAST(sum(n_merged) AS BIGINT) AS merged, CAST(sum(n_conflict) AS BIGINT) AS conflicts FROM ({QUERIES['w6_attempt_merge'].sql}) GROUP BY 1")
def w7_sync_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = QUERIES["w6_attempt_merge"].run(spark, sf_dir)
    return merged.groupBy("user_id").agg(F.count("*").alias("profiles"), F.sum("n_merged").alias("merged"), F.sum("n_conflict").alias("conflicts"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type IN ('click', 'purchase')),
c AS (SELECT *, max(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY k ORDER BY event_id) AS claim FROM e),
f AS (SELECT c.*, o.user_id AS holder, row_number() OVER (PARTITION BY c.k, c.claim, c.user_id, c.event_type ORDER BY c.event_id) AS nth FROM c LEFT JOIN events o ON o.event_id = c.claim)
SELECT event_id, coalesce(holder = user_id AND nth = 1, false) AS finished FROM f WHERE event_type = 'purchase'""")
def w15_compare_and_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a finish holds: the job's last claim before it is the worker's own, and it is the first finish of that claim by it."""
    e = table(spark, sf_dir, "events").where("event_type IN ('click', 'purchase')").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    claim = F.when(F.col("event_type") == "click", F.struct("event_id", "user_id"))
    held = e.withColumn("claim", F.max(claim).over(Window.partitionBy("k").orderBy("event_id")))
    nth = F.row_number().over(Window.partitionBy("k", "claim", "user_id", "event_type").orderBy("event_id"))
    done = held.withColumn("nth", nth).where("event_type = 'purchase'")
    return done.select("event_id", F.coalesce((F.col("claim.user_id") == F.col("user_id")) & (F.col("nth") == 1), F.lit(False)).alias("finished"))


_STALE, _WAITS = 43_200_000_000, (600_000_000, 7_200_000_000)
_KINDS = {"signup": "SUBMIT", "click": "CLAIM", "view": "HEARTBEAT", "purchase": "DONE", "error": "FAIL"}
_KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{k}'" for e, k in _KINDS.items()) + " END"
_LEASED = f"""WITH RECURSIVE n AS (SELECT event_id, user_id, epoch_us(ts) AS t, {_KIND_SQL} AS kind, CAST(event_id % 2 AS VARCHAR) AS hand, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, 'NONE' AS status, '' AS worker, 0 AS retries, CAST(0 AS BIGINT) AS heard, CAST(0 AS BIGINT) AS waits, '' AS note FROM n
UNION ALL SELECT user_id, i, event_id,
  CASE WHEN kind = 'SUBMIT' AND s NOT IN ('QUEUED', 'RUNNING') THEN 'QUEUED' WHEN kind = 'CLAIM' AND s = 'QUEUED' AND t >= w THEN 'RUNNING' WHEN own AND kind = 'DONE' THEN 'SUCCEEDED' WHEN own AND kind = 'FAIL' THEN CASE WHEN r < {len(_WAITS)} THEN 'QUEUED' ELSE 'FAILED' END ELSE s END,
  CASE WHEN kind = 'CLAIM' AND s = 'QUEUED' AND t >= w THEN hand WHEN (own AND kind IN ('DONE', 'FAIL')) OR s <> 'RUNNING' THEN '' ELSE worker END,
  CASE WHEN kind = 'SUBMIT' AND s NOT IN ('QUEUED', 'RUNNING') THEN 0 WHEN own AND kind = 'FAIL' AND r < {len(_WAITS)} THEN r + 1 ELSE r END,
  CASE WHEN (kind = 'CLAIM' AND s = 'QUEUED' AND t >= w) OR (own AND kind = 'HEARTBEAT') THEN t ELSE heard END,
  CASE WHEN kind = 'SUBMIT' AND s NOT IN ('QUEUED', 'RUNNING') THEN t WHEN own AND kind = 'FAIL' AND r < {len(_WAITS)} THEN t + CASE r {" ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(_WAITS))} END ELSE w END, note
FROM (SELECT *, s = 'RUNNING' AND worker = hand AS own FROM (SELECT n.user_id, n.i, n.event_id, n.t, n.kind, n.hand, f.worker, f.heard,
    CASE WHEN gone THEN CASE WHEN f.retries < {len(_WAITS)} THEN 'QUEUED' ELSE 'FAILED' END ELSE f.status END AS s, CASE WHEN gone AND f.retries < {len(_WAITS)} THEN f.retries + 1 ELSE f.retries END AS r, CASE WHEN gone AND f.retries < {len(_WAITS)} THEN 0 ELSE f.waits END AS w,
    CASE WHEN gone THEN CASE WHEN f.retries < {len(_WAITS)} THEN 'RECOVERED' ELSE 'INTERRUPTED' END ELSE '' END AS note
  FROM (SELECT f.*, n.t AS now, f.status = 'RUNNING' AND n.t > f.heard + {_STALE} AS gone FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1) f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)))
SELECT event_id, status || ':' || retries || ':' || note AS state FROM f WHERE i > 0"""


@query(_LEASED)
def k5_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as those of a job that two workers hold in turn: claims, signs of life, failures with waits, and leases that end."""
    kind = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])[F.col("event_type")]
    e = table(spark, sf_dir, "events").select("event_id", "user_id", micros(F.col("ts")).alias("at"), kind.alias("kind"), (F.col("event_id") % 2).cast("string").alias("worker"))
    return stateful.fold(e, "user_id", ["at", "event_id"], stateful.leases(_STALE, _WAITS), ["at", "kind", "worker"], "state", "string").select("event_id", "state")


#: Manifests of users' events: three versions, one for each ten days; of a user and type each has the last event and how many there were.
MANIFESTS = "m AS (SELECT user_id, event_type, least(3, 1 + (day(ts) - 1) // 10) AS version, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1, 2, 3)"


def manifests(spark: SparkSession, sf_dir: str) -> Versions:
    """The manifests, saved one after the other."""
    days = F.least(F.lit(3), F.lit(1) + F.floor((F.dayofmonth("ts") - 1) / 10)).cast("int")
    told = stored(table(spark, sf_dir, "events").groupBy("user_id", "event_type", days.alias("part")).agg(F.count("*").alias("n"), F.max("event_id").alias("last")), "parts")
    saved = Versions(spark, place(spark, "manifests"))
    for part in range(1, 4):
        saved.save(told.where(F.col("part") == part).drop("part"))
    return saved


@query(f"WITH {MANIFESTS} SELECT CAST(version AS INTEGER) AS version, count(*) AS entries, CAST(sum(n) AS BIGINT) AS events, max(last) AS last FROM m GROUP BY 1")
def w17_manifest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only manifests as they are read back from where they were saved."""
    return manifests(spark, sf_dir).every().groupBy(F.col("version").cast("int").alias("version")).agg(F.count("*").alias("entries"), F.sum("n").alias("events"), F.max("last").alias("last"))


@query(f"WITH {MANIFESTS} SELECT user_id, event_type, CAST(max(version) AS INTEGER) AS version, arg_max(n, version) AS n, arg_max(last, version) AS last FROM m WHERE version <= 2 GROUP BY 1, 2")
def s22_replayed_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was held when the second of three versions was the latest."""
    return manifests(spark, sf_dir).replay(["user_id", "event_type"], upto=2).select("user_id", "event_type", F.col("version").cast("int").alias("version"), "n", "last")


@query(f"WITH {WALK} SELECT run, CAST(2 AS INTEGER) AS version, count(*) AS nodes, count(*) FILTER (opened) AS opened, CAST(max(place) AS BIGINT) AS last_place FROM w GROUP BY 1")
def w16_stored_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks as they are loaded from where they were stored: the latest of two."""
    saved, whole = Versions(spark, place(spark, "walks")), _walk(spark, sf_dir)
    saved.save(whole.where("depth < 2"))
    saved.save(whole)
    return saved.load().groupBy("run", "version").agg(F.count("*").alias("nodes"), F.count_if("opened").alias("opened"), F.max("place").alias("last_place"))
