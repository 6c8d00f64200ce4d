"""Queries whose rows depend on earlier ones: queues, feeds, islands, limiters, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.dates import micros
from factloom.functions.text import figures
from factloom.operators import stateful

from .registry import QUERIES, query, table

_HOUR = 3_600_000_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", micros(F.col("ts")).alias("at"), "value", "props")


@query(f"""WITH r AS (SELECT max(epoch_us(ts)) AS ref FROM events), f AS (SELECT user_id, max(epoch_us(ts)) FILTER (event_type <> 'error') AS good, max(epoch_us(ts)) FILTER (event_type = 'error') AS bad FROM events GROUP BY 1)
SELECT user_id, good, CASE WHEN good >= ref - {6 * _HOUR} THEN 'FRESH' WHEN bad >= ref - {_HOUR // 4} AND good IS NOT NULL THEN 'LAST_COPY' WHEN good IS NOT NULL THEN 'REFRESH' ELSE 'FETCH' END AS action FROM f, r""")
def k1_feed_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    failed = F.col("event_type") == "error"
    last = e.groupBy("user_id").agg(F.max(F.when(~failed, F.col("at"))).alias("good"), F.max(F.when(failed, F.col("at"))).alias("bad"))
    ref = F.broadcast(e.agg(F.max("at").alias("ref")))
    action = (
        F.when(F.col("good") >= F.col("ref") - 6 * _HOUR, "FRESH").when((F.col("bad") >= F.col("ref") - _HOUR // 4) & F.col("good").isNotNull(), "LAST_COPY")
        .when(F.col("good").isNotNull(), "REFRESH").otherwise("FETCH")
    )
    return last.crossJoin(ref).select("user_id", "good", action.alias("action"))


@query("""WITH d AS (SELECT event_type, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts) AS took FROM events)
SELECT event_type, count(took) AS n, CAST(sum(took) AS BIGINT) AS total FROM d GROUP BY 1""")
def k5_stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    took = F.lead("at").over(Window.partitionBy("user_id").orderBy("at", "event_id")) - F.col("at")
    return _events(spark, sf_dir).select("event_type", took.alias("took")).groupBy("event_type").agg(F.count("took").alias("n"), F.sum("took").alias("total"))


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), i AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM d)
SELECT user_id, strftime(min(day), '%Y-%m-%d') AS first_day, count(*) AS days FROM i GROUP BY user_id, island""")
def n11_day_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("day"))
    return d.withColumn("island", F.date_sub("day", nth)).groupBy("user_id", "island").agg(F.date_format(F.min("day"), "yyyy-MM-dd").alias("first_day"), F.count("*").alias("days")).drop("island")


@query("""SELECT conv_id, turn, role, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""")
def n9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))


IN_TURN = "n AS (SELECT event_id, user_id, epoch_us(ts) AS t_us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


@query(f"""WITH RECURSIVE {IN_TURN}, f AS (SELECT user_id, i, event_id, t_us, [t_us] AS hits, true AS allowed FROM n WHERE i = 1
UNION ALL SELECT n.user_id, n.i, n.event_id, n.t_us, CASE WHEN len(list_filter(f.hits, lambda h: n.t_us - h <= {24 * _HOUR})) < 3 THEN list_append(list_filter(f.hits, lambda h: n.t_us - h <= {24 * _HOUR}), n.t_us) ELSE list_filter(f.hits, lambda h: n.t_us - h <= {24 * _HOUR}) END,
  len(list_filter(f.hits, lambda h: n.t_us - h <= {24 * _HOUR})) < 3 FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)
SELECT event_id, user_id, t_us AS "at", allowed FROM f""")
def k4_sliding_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", "user_id", "at")
    return stateful.fold(e, "user_id", ["at", "event_id"], stateful.sliding_limiter(3, 24 * _HOUR), ["at"], "allowed", "boolean")


@query(f"SELECT user_id, count(*) FILTER (allowed) AS allowed, count(*) FILTER (NOT allowed) AS denied FROM ({QUERIES['k4_sliding_limiter'].sql}) GROUP BY 1")
def n15_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that a sliding window lets through and denies; only those let through count in it."""
    return k4_sliding_limiter(spark, sf_dir).groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("denied"))


_REFILL = f"least(4.0::DOUBLE, f.tokens + CAST(n.t_us - f.t_us AS DOUBLE) * 4.0::DOUBLE / {48 * _HOUR}::DOUBLE)"


@query(f"""WITH RECURSIVE {IN_TURN}, f AS (SELECT user_id, i, event_id, t_us, 3.0::DOUBLE AS tokens, true AS allowed FROM n WHERE i = 1
UNION ALL SELECT n.user_id, n.i, n.event_id, n.t_us, CASE WHEN {_REFILL} < 1 THEN {_REFILL} ELSE {_REFILL} - 1 END, {_REFILL} >= 1 FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)
SELECT event_id, user_id, t_us AS "at", allowed FROM f""")
def k3_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", "user_id", "at")
    return stateful.fold(e, "user_id", ["at", "event_id"], stateful.token_bucket(4.0, 48 * _HOUR), ["at"], "allowed", "boolean")


NEWEST = "n AS (SELECT event_id, user_id, CAST(round(value) AS BIGINT) AS size, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events)"


def _newest_first(spark: SparkSession, sf_dir: str, make, out: str, kind: str) -> DataFrame:
    """user_id, event_id and what a fold over all events of each user says, newest first."""
    e = _events(spark, sf_dir).select("event_id", "user_id", "at", F.round("value").cast("long").alias("size"))
    return stateful.fold(e, "user_id", [F.desc("at"), F.desc("event_id")], make, ["size"], out, kind).select("user_id", "event_id", out)


@query(f"""WITH RECURSIVE {NEWEST}, f AS (SELECT user_id, i, event_id, CASE WHEN size <= 100 THEN size ELSE 0 END AS used, size <= 100 AS taken FROM n WHERE i = 1
UNION ALL SELECT n.user_id, n.i, n.event_id, f.used + CASE WHEN f.used + n.size <= 100 THEN n.size ELSE 0 END, f.used + n.size <= 100 FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)
SELECT user_id, event_id, taken FROM f""")
def n7_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _newest_first(spark, sf_dir, stateful.budget(100), "taken", "boolean")


@query(f"""WITH RECURSIVE {NEWEST}, f AS (SELECT user_id, i, event_id, CASE WHEN size > 60 THEN 0 ELSE size END AS used, CASE WHEN size > 60 THEN 0 ELSE 1 END AS held, 0 AS batch, size > 60 AS over FROM n WHERE i = 1
UNION ALL SELECT n.user_id, n.i, n.event_id, CASE WHEN n.size > 60 THEN f.used WHEN f.held = 0 OR f.used + n.size <= 40 THEN f.used + n.size ELSE n.size END, CASE WHEN n.size > 60 THEN f.held WHEN f.held = 0 OR f.used + n.size <= 40 THEN f.held + 1 ELSE 1 END,
  CASE WHEN n.size > 60 OR f.held = 0 OR f.used + n.size <= 40 THEN f.batch ELSE f.batch + 1 END, n.size > 60
FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1) SELECT user_id, event_id, CAST(CASE WHEN over THEN -1 ELSE batch END AS INTEGER) AS batch FROM f""")
def w24_sync_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of at most 40; what is larger travels alone, and over 60 not at all."""
    return _newest_first(spark, sf_dir, stateful.batches(40, 60), "batch", "int")


_FIGURES = "list_distinct(regexp_extract_all(regexp_replace({t}, '([0-9]),([0-9])', '\\1\\2', 'g'), '[0-9]+'))"
_LINK = "'(?i)https?://[^\\s<>\"'')\\]]+'"


@query(f"""WITH s AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations),
e AS (SELECT conv_id, list_distinct(flatten(list({_FIGURES.format(t='t')}))) AS figs, list_distinct(flatten(list(regexp_extract_all(t, {_LINK})))) AS links, list_distinct(flatten(list(regexp_extract_all(t, '[A-Z]+_[0-9]+')))) AS names FROM s WHERE role = 'system' GROUP BY 1),
a AS (SELECT conv_id, turn, t, {_FIGURES.format(t="regexp_replace(t, " + _LINK + ", ' ', 'g')")} AS figs, regexp_extract_all(t, {_LINK}) AS links, regexp_extract_all(t, '[A-Z]+_[0-9]+') AS names FROM s WHERE role = 'assistant'),
j AS (SELECT a.conv_id, turn, trim(t) = '' AS empty, len(list_filter(a.figs, lambda x: NOT list_contains(coalesce(e.figs, []), x))) AS n, len(list_filter(a.links, lambda x: NOT list_contains(coalesce(e.links, []), x))) AS l, len(list_filter(a.names, lambda x: NOT list_contains(coalesce(e.names, []), x))) AS m FROM a LEFT JOIN e USING (conv_id))
SELECT conv_id, turn, CAST(n AS BIGINT) AS n_unsupported, array_to_string(list_filter([CASE WHEN empty THEN 'EMPTY' END, CASE WHEN n > 0 THEN 'FIGURE' END, CASE WHEN l > 0 THEN 'LINK' END, CASE WHEN m > 0 THEN 'NAME' END], lambda x: x IS NOT NULL), ',') AS reasons FROM j""")
def x47_answer_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an answer is not accepted (no reason: it is): it is empty, or has figures outside its links, links or catalogue
    names that no system turn of the conversation has; a user's turn is no evidence."""
    link, name = r"(?i)https?://[^\s<>\"')\]]+", r"[A-Z]+_[0-9]+"
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("t"))
    every = lambda of: F.regexp_extract_all("t", F.lit(of), F.lit(0))
    of_kind = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("v")))
    tagged = lambda figs: F.concat(of_kind("FIGURE", figs), of_kind("LINK", every(link)), of_kind("NAME", every(name)))
    known = s.where("role = 'system'").select("conv_id", F.explode(tagged(figures(F.col("t")))).alias("x")).select("conv_id", "x.*").distinct()
    said = s.where("role = 'assistant'").withColumn("uid", F.monotonically_increasing_id())
    claims = said.select("uid", "conv_id", F.explode(tagged(figures(F.regexp_replace("t", link, " ")))).alias("x")).select("uid", "conv_id", "x.*")
    open_ = claims.join(known, ["conv_id", "kind", "v"], "left_anti").groupBy("uid").agg(F.count_if(F.col("kind") == "FIGURE").alias("n"), F.collect_set("kind").alias("kinds"))
    empty = F.when(F.trim("t") == "", F.array(F.lit("EMPTY"))).otherwise(F.array().cast("array<string>"))
    reasons = F.concat(empty, F.sort_array(F.coalesce("kinds", F.array().cast("array<string>"))))
    return said.join(open_, "uid", "left").select("conv_id", "turn", F.coalesce("n", F.lit(0)).cast("long").alias("n_unsupported"), F.array_join(reasons, ",").alias("reasons"))


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders), r AS (SELECT max(day) - 20 AS ref FROM d)
SELECT o_orderkey, CAST(days AS INTEGER) AS days FROM d, r, (VALUES (7, 3), (3, 1), (1, 0)) w(days, until) WHERE ref >= day - days AND ref < day - until""")
def p22_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    ref = F.broadcast(d.agg(F.date_sub(F.max("day"), 20).alias("ref")))
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("days"), F.lit(b).alias("until")) for a, b in ((7, 3), (3, 1), (1, 0))]))
    rows = d.select("o_orderkey", "day", offsets.alias("w")).crossJoin(ref)
    return rows.where((F.col("ref") >= F.expr("date_sub(day, w.days)")) & (F.col("ref") < F.expr("date_sub(day, w.until)"))).select("o_orderkey", "w.days")
