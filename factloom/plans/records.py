"""Queries over records as they are built, checked and shown: pages in blocks, tables, overlays, projections, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions import urls as U
from factloom.operators import links, reads
from factloom.operators import reconcile as R
from factloom.operators import snapshots as S
from factloom.operators.stored import place
from factloom.sources import records, registry

from .facts import WHITE
from .reads import _HOST
from .reconcile import FACTS, _facts
from .registry import QUERIES, query, table


def _plain(x: str) -> str:
    for pattern in ("(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->", "(?s)<[^>]*>"):
        x = f"regexp_replace({x}, '{pattern}', ' ', 'g')"
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{sign}')"
    return f"trim(regexp_replace({x}, '{WHITE}', ' ', 'g'))"


@query(rf"""WITH p AS (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6]\b[^>]*>.*?</h[1-6]\s*>|<a[\s/][^>]*>.*?</a\s*>') AS parts FROM pages), e AS (SELECT page_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS pos, unnest(parts) AS part FROM p),
h AS (SELECT *, last_value(CASE WHEN regexp_matches(part, '(?i)^<h[1-6]') THEN {_plain("part")} END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos) AS heading FROM e)
SELECT page_id, pos, {_plain("part")} AS text, heading FROM h WHERE regexp_matches(part, '(?i)^<a')""")
def s12_links_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.links_in_context(table(spark, sf_dir, "pages").select("page_id", "html"))


def _files(spark: SparkSession, sf_dir: str) -> str:
    """Where parts are written as JSON lines; of some the line is cut off or has no key."""
    key = F.col("p_partkey")
    whole = F.to_json(F.struct(F.when(key % 13 != 0, key).alias("key"), F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("brand"), F.col("p_size").cast("int").alias("size")).alias("make")))
    path = place(spark, "records")
    table(spark, sf_dir, "part").select(F.when(key % 11 == 0, F.substring(whole, F.lit(1), F.length(whole) - 2)).otherwise(whole).alias("value")).write.text(path)
    return path


_JSON = "key long, name string, make struct<brand:string,size:int>"


@query("""WITH f AS (SELECT p_partkey AS key, p_name AS name, p_brand AS brand, p_size AS size FROM part WHERE p_partkey % 13 <> 0 AND p_partkey % 11 <> 0),
r AS (SELECT s_suppkey AS key, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS name FROM supplier UNION ALL SELECT CAST(-1 AS BIGINT), 'registered' FROM region WHERE r_regionkey = 0)
SELECT coalesce(r.key, f.key) AS key, coalesce(r.name, f.name) AS name, brand, CAST(size AS INTEGER) AS size, CASE WHEN f.key IS NULL THEN 'REGISTRY' WHEN r.key IS NULL THEN 'FILE' ELSE 'BOTH' END AS origin FROM f FULL JOIN r ON f.key = r.key""")
def s6_registry_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of JSON files, with a registry's rows over them."""
    held, _ = registry.read_records(spark, _files(spark, sf_dir), _JSON, "key")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"))
    extra = table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.lit(-1).cast("long").alias("key"), F.lit("registered").alias("name"))
    return registry.with_registry(held, s.unionByName(extra), "key").select("key", "name", "make.brand", "make.size", "origin")


@query("""SELECT CASE WHEN p_partkey % 11 = 0 THEN 'no JSON' ELSE 'no key' END AS reason, count(*) AS n FROM part WHERE p_partkey % 11 = 0 OR p_partkey % 13 = 0 GROUP BY 1""")
def s6_rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON files that are no records, by why."""
    _, rejects = registry.read_records(spark, _files(spark, sf_dir), _JSON, "key")
    return rejects.groupBy("reason").agg(F.count("*").alias("n"))


_BASIC = "replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query(rf"""WITH f AS (SELECT page_id, 'Files of ' || page_id AS head, page_id || '/24 Posts Notice Addendum' AS row, html FROM pages), n AS (SELECT page_id, head, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1)) AS said FROM f)
SELECT page_id, trim(regexp_replace({_BASIC.format(x="said")}, '{WHITE}', ' ', 'g')) AS text, head AS heading, CAST(NULL AS VARCHAR) AS row, CAST(NULL AS VARCHAR) AS table_heading, head AS context, false AS unlinked FROM n
UNION ALL SELECT page_id, 'Notice', head, row, head, row, false FROM f UNION ALL SELECT page_id, 'Addendum', head, row, head, row, true FROM f UNION ALL SELECT page_id, 'Inner', head, 'Inner', head, 'Inner', false FROM f""")
def s12_links_in_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page, below a table of files with a table in it, with its row, heading and context, and rows' entries without a file."""
    n = F.col("page_id").cast("string")
    files = F.concat(F.lit("<h2>Files of "), n, F.lit('</h2><table><tr><th>No.</th><th>File</th></tr><tr><td>'), n, F.lit('/24 Posts</td><td><a href="/f/'), n, F.lit('.pdf">Notice</a> <a href="#">Addendum</a><table><tr><td><a href="in">Inner</a></td></tr></table></td></tr></table>'))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.concat(files, F.coalesce("html", F.lit(""))).alias("html"))
    return links.links_in_rows(pages).select("page_id", "text", "heading", "row", "table_heading", "context", "unlinked")


@query("""SELECT doc_id, 1 AS row, unnest(['Lang', 'Chars']) AS header, unnest([coalesce(lang, '-'), CAST(n_chars AS VARCHAR)]) AS value FROM documents""")
def s13_headed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit("<table><tr><th>Lang</th><th>Chars</th></tr><tr><td>"), F.coalesce("lang", F.lit("-")), F.lit("</td><td><b>"), F.col("n_chars").cast("string"), F.lit("</b></td></tr></table>"))
    return records.headed_rows(table(spark, sf_dir, "documents").select("doc_id", html.alias("html")))


@query(rf"""WITH p AS (SELECT page_id, string_split_regex(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '{records.BLOCK}') AS parts FROM pages), e AS (SELECT page_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS pos, unnest(parts) AS part FROM p),
t AS (SELECT page_id, pos, {_plain("part")} AS text, CAST(len(regexp_extract_all(part, '(?i)<a[\s/]')) AS INTEGER) AS links FROM e) SELECT * FROM t WHERE text <> ''""")
def s14_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.blocks(table(spark, sf_dir, "pages").select("page_id", "html"))


@query("""WITH f AS (SELECT user_id, list(event_id ORDER BY ts DESC, event_id DESC)[1:4] AS e FROM events GROUP BY 1) SELECT user_id, CAST(generate_subscripts(e, 1) - 1 AS INTEGER) AS pos, 'No. ' || unnest(e) || ' & more' AS title FROM f""")
def s19_feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four entries of each user's feed, newest first."""
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    few = table(spark, sf_dir, "events").select("user_id", "event_id", newest.alias("nth")).where("nth <= 4")  # cut before the shuffle, so a hot user is no heavy group
    own = F.transform(F.array_sort(F.collect_list(F.struct("nth", "event_id"))), lambda x: F.concat(F.lit("<entry><title>No. "), x["event_id"].cast("string"), F.lit(" &amp; more</title></entry>")))
    feeds = few.groupBy("user_id").agg(F.concat(F.lit("<feed>"), F.array_join(own, "\n"), F.lit("</feed>")).alias("xml"))
    return records.feed_entries(feeds, "xml").select("user_id", "pos", "title")


@query(f"""WITH g AS ({QUERIES['x22_gate'].sql}) SELECT o_orderkey, unnest(['dates', 'fee']) AS domain, unnest([strftime(o_orderdate, '%Y-%m-%d'), CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)]) AS value FROM g JOIN orders USING (o_orderkey) WHERE decision = 'PASS'""")
def x18_overlays_of_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that pass the gate, as overlays: one for each field they state."""
    passed = QUERIES["x22_gate"].run(spark, sf_dir).where("decision = 'PASS'").select("o_orderkey")
    fields = F.array(*[F.struct(F.lit(d).alias("domain"), v.alias("value")) for d, v in (("dates", F.date_format("o_orderdate", "yyyy-MM-dd")), ("fee", F.floor("o_totalprice").cast("string")))])
    return table(spark, sf_dir, "orders").join(passed, "o_orderkey").select("o_orderkey", F.explode(fields).alias("x")).select("o_orderkey", "x.*")


_NAMES = ("apache", "mit license", "general public license", "cc by")


@query(f"""WITH d AS (SELECT doc_id, {list(_NAMES)}[CAST(doc_id % 4 AS INTEGER) + 1] AS target, lower(coalesce(text, '')) AS t FROM documents), r AS (SELECT doc_id, target, list_filter({list(_NAMES)}, lambda n: contains(t, n)) AS named, list_filter({list(_NAMES)}, lambda n: contains(substr(t, 1, 1500), n)) AS title FROM d)
SELECT doc_id, CASE WHEN len(named) = 0 THEN 'UNNAMED' WHEN (list_contains(title, target) AND len(title) = 1) OR (list_contains(named, target) AND len(named) = 1) THEN 'MATCH' WHEN list_contains(named, target) THEN 'AMBIGUOUS' ELSE 'MISMATCH' END AS identity FROM r""")
def x23_document_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document is about its target: named alone in its first 1500 characters, or with no rival anywhere."""
    every = F.array(*map(F.lit, _NAMES))
    d = table(spark, sf_dir, "documents").select("doc_id", F.element_at(every, (F.col("doc_id") % 4 + 1).cast("int")).alias("target"), F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    in_ = lambda t: F.filter(every, lambda n: F.contains(t, n))
    r = d.select("doc_id", "target", in_(F.col("t")).alias("named"), in_(F.substring("t", 1, 1500)).alias("title"))
    has = lambda c: F.array_contains(c, F.col("target"))
    alone = (has("title") & (F.size("title") == 1)) | (has("named") & (F.size("named") == 1))
    return r.select("doc_id", F.when(F.size("named") == 0, "UNNAMED").when(alone, "MATCH").when(has("named"), "AMBIGUOUS").otherwise("MISMATCH").alias("identity"))


@query(rf"""WITH c AS (SELECT regexp_extract(url, '://[^/]*/([a-z]+)/', 1) AS role, regexp_extract({_HOST}, '([^.]+\.[^.]+)\z', 1) AS body FROM pages), b AS (SELECT role, body, count(*)::DOUBLE AS score, body = 'example.org' AS named FROM c GROUP BY 1, 2),
s AS (SELECT *, score / sum(score) OVER (PARTITION BY role) AS share, row_number() OVER (PARTITION BY role ORDER BY score DESC, body) AS place FROM b), m AS (SELECT *, count(*) FILTER (share >= 0.25) OVER (PARTITION BY role) AS many FROM s), p AS (SELECT * FROM m WHERE share >= 0.25 OR (many = 0 AND place = 1)),
g AS (SELECT role, count(*) AS plausible, min(body) AS one, count(*) FILTER (named) AS n, min(body) FILTER (named) AS told FROM p GROUP BY 1)
SELECT role, plausible, CASE WHEN plausible = 1 THEN one WHEN n = 1 THEN told END AS chosen, CASE WHEN plausible = 1 OR n = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS decision FROM g""")
def x26_resolve_estates(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    b = table(spark, sf_dir, "pages").groupBy(F.regexp_extract(u, "://[^/]*/([a-z]+)/", 1).alias("role"), U.estate(u).alias("body")).agg(F.count("*").cast("double").alias("score"))
    return R.decide(b.withColumn("named", F.col("body") == "example.org"), ["role"])


@query("""SELECT l_orderkey, CAST(row_number() OVER w AS INTEGER) AS ordinal, 'item ' || l_partkey || ' of ' || l_suppkey AS name, CAST(l_quantity AS BIGINT) * 1000 AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)""")
def x27_numbered_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of tables that are printed as text, with a heading, a total and a line out of the run."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    s = lambda c: F.col(c).cast("string")
    line = F.concat(F.lit("  "), s("i"), F.lit(". item "), s("l_partkey"), F.lit(" of "), s("l_suppkey"), F.lit("   "), F.format_number(F.col("l_quantity").cast("long") * 1000, 0))
    rows = table(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(w)).select("l_orderkey", "i", line.alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    texts = rows.groupBy("l_orderkey").agg(F.concat(F.lit("No. item count\n"), body, F.lit("\nTotal 99\n  77. from elsewhere 5")).alias("text"))
    return records.numbered_rows(texts, "l_orderkey", "text")


@query(r"""SELECT page_id, regexp_extract(url, '://[^/]*/([a-z]+)/', 1) AS lang, coalesce(regexp_extract(url, '/([0-9]+)', 1), '') AS number, regexp_extract(url, '[?&]page=([0-9]+)', 1) AS session FROM pages""")
def x35_paper_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", part("://[^/]*/([a-z]+)/").alias("lang"), part("/([0-9]+)").alias("number"), part("[?&]page=([0-9]+)").alias("session"))


@query(f"""WITH f AS (SELECT l_partkey, l_returnflag, status FROM ({QUERIES['x16_merge_facts'].sql}) WHERE status = 'VERIFIED'), m AS (SELECT l_partkey, l_returnflag FROM f QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag) <= 1)
SELECT l_partkey, l_returnflag FROM f EXCEPT ALL SELECT * FROM m""")
def x42_projection_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found facts that a record which holds one fact a key does not show: losses, which must be held with a reason."""
    found = QUERIES["x16_merge_facts"].run(spark, sf_dir).where("status = 'VERIFIED'").select("l_partkey", "l_returnflag")
    shown = S.newest(found, ["l_partkey"], [F.col("l_returnflag")], 1).select("l_partkey", "l_returnflag")
    return found.exceptAll(shown)


@query("""WITH e AS (SELECT user_id, event_type AS kind, strftime(ts, '%Y-%m-%d') AS day, bool_or(value < 3) AS tentative FROM events GROUP BY 1, 2, 3)
SELECT user_id, kind, day, tentative FROM e UNION ALL SELECT user_id, 'view_opens', strftime(CAST(day AS DATE) - 7, '%Y-%m-%d'), tentative FROM e WHERE kind = 'view'""")
def x43_date_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as they are shown: one row a kind and day, and a row of its own for the opening of a window."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("kind"), F.to_date("ts").alias("d")).agg(F.bool_or(F.col("value") < 3).alias("tentative"))
    row = lambda kind, d: F.struct(kind.alias("kind"), F.date_format(d, "yyyy-MM-dd").alias("day"))
    each = F.array_compact(F.array(row(F.col("kind"), F.col("d")), F.when(F.col("kind") == "view", row(F.lit("view_opens"), F.date_sub("d", 7)))))
    return e.select("user_id", "tentative", F.explode(each).alias("x")).select("user_id", "x.kind", "x.day", "tentative")


@query(f"""WITH {FACTS} SELECT event_id, array_to_string(list_filter([CASE WHEN trim(value) = '' THEN 'value' END, CASE WHEN source_url IS NULL OR NOT starts_with(source_url, 'http') THEN 'source' END, CASE WHEN NOT reachable THEN 'reachable' END], lambda x: x IS NOT NULL), ',') AS problems FROM f""")
def x44_evidence_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"value": reads.present(F.trim("value")), "source": F.col("source_url").rlike("^https?://"), "reachable": F.col("reachable")}
    return _facts(spark, sf_dir).select("event_id", reads.problems(**rules).alias("problems"))


@query("""WITH c AS (SELECT event_id, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events), d AS (SELECT *, value < 2 AS failed, event_type = 'error' AS down FROM c),
f AS (SELECT user_id, k, min(event_id) FILTER (NOT failed AND NOT down) AS first FROM d GROUP BY 1, 2), v AS (SELECT d.*, first, s.value AS asked FROM d JOIN f USING (user_id, k) LEFT JOIN d s ON s.event_id = first)
SELECT event_id, CASE WHEN failed THEN 'NEEDS_REVIEW' WHEN first IS NULL OR event_id < first THEN 'NEEDS_REVIEW' WHEN asked > 10 THEN 'VERIFIED' ELSE 'NEEDS_REVIEW' END AS verdict, NOT failed AND coalesce(event_id = first, false) AS consulted FROM v""")
def x45_cached_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims judged: a rule that fails decides alone, else the verdict first given for the claim's fingerprint; a verifier that
    is down gives none and leaves none behind."""
    c = table(spark, sf_dir, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "value", (F.col("value") < 2).alias("failed"), (F.col("event_type") == "error").alias("down"))
    asked = F.when(~F.col("failed") & ~F.col("down"), F.struct("event_id", "value"))
    first = F.min(asked).over(Window.partitionBy("user_id", "k"))
    v = c.withColumn("first", first)
    known = F.col("first").isNotNull() & (F.col("event_id") >= F.col("first.event_id"))
    verdict = F.when(~F.col("failed") & known & (F.col("first.value") > 10), "VERIFIED").otherwise("NEEDS_REVIEW")
    return v.select("event_id", verdict.alias("verdict"), (~F.col("failed") & F.coalesce(F.col("event_id") == F.col("first.event_id"), F.lit(False))).alias("consulted"))


@query("""WITH r AS (SELECT o_custkey, max(o_orderdate) AS last, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN status IS NULL THEN 'WAIT' WHEN status = 'F' AND c_acctbal > 0 THEN 'NEXT_STAGE' WHEN status = 'F' THEN 'CHECK_RECORD' WHEN status = 'O' THEN 'RESULT_DUE' ELSE 'NOT_STATED' END AS step FROM customer LEFT JOIN r ON o_custkey = c_custkey""")
def x53_next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))
    s = F.col("status")
    step = F.when(s.isNull(), "WAIT").when((s == "F") & (F.col("c_acctbal") > 0), "NEXT_STAGE").when(s == "F", "CHECK_RECORD").when(s == "O", "RESULT_DUE").otherwise("NOT_STATED")
    return table(spark, sf_dir, "customer").join(r, "c_custkey", "left").select("c_custkey", step.alias("step"))


@query("""WITH a AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS nm, CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS code FROM part), b AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS nm, p_brand AS code, min(p_retailprice) AS least, count(*) AS n FROM part GROUP BY 1, 2)
SELECT p_partkey, CAST(count(b.nm) AS BIGINT) AS rows_met, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM a LEFT JOIN b ON a.nm = b.nm AND (a.code = '' OR a.code = b.code) GROUP BY 1""")
def j12_rows_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of another table under the same name; where both state a code, codes must agree too."""
    p = table(spark, sf_dir, "part")
    a = p.select("p_partkey", T.slug(F.col("p_name")).alias("nm"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("").alias("own"))
    b = p.groupBy(T.slug(F.col("p_name")).alias("nm"), F.col("p_brand").alias("code")).agg(F.count("*").alias("n"))
    every = b.groupBy("nm").agg(F.count("*").alias("rows_any"), F.sum("n").alias("n_any"))
    met = a.join(every, "nm", "left").join(b.withColumnRenamed("code", "own"), ["nm", "own"], "left")
    free = F.col("own") == ""
    return met.select("p_partkey", F.when(free, F.coalesce("rows_any", F.lit(0))).otherwise(F.col("n").isNotNull().cast("long")).alias("rows_met"), F.when(free, F.coalesce("n_any", F.lit(0))).otherwise(F.coalesce("n", F.lit(0))).alias("n"))


@query("""WITH b AS (SELECT o_orderkey, o_custkey, o_orderpriority AS name, CAST(floor(o_totalprice / 1000) AS BIGINT) AS total FROM orders), p AS (SELECT o_orderpriority AS name, CAST(floor(o_totalprice / 1000) AS BIGINT) AS total, count(*) AS n, min(o_orderkey) AS post FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
m AS (SELECT b.*, CASE WHEN n = 1 THEN post END AS post FROM b LEFT JOIN p USING (name, total)), u AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, post) AS used FROM m), w AS (SELECT o_custkey, bool_and(post IS NOT NULL AND used = 1) AS whole FROM u GROUP BY 1)
SELECT o_orderkey, CASE WHEN whole THEN post END AS post FROM u JOIN w USING (o_custkey)""")
def j20_break_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a break-up and the one post each belongs to by name and total: all of a document's rows, no post twice, or none."""
    total = F.floor(F.col("o_totalprice") / 1000)
    b = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("name"), total.alias("total"), "o_orderstatus")
    p = b.where("o_orderstatus = 'F'").groupBy("name", "total").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("post"))
    m = b.join(p.where("n = 1").select("name", "total", "post"), ["name", "total"], "left")
    used = F.count("*").over(Window.partitionBy("o_custkey", "post"))
    u = m.withColumn("ok", F.col("post").isNotNull() & (used == 1)).withColumn("whole", F.bool_and("ok").over(Window.partitionBy("o_custkey")))
    return u.select("o_orderkey", F.when(F.col("whole"), F.col("post")).alias("post"))


@query(rf"""WITH n AS (SELECT page_id, {_HOST} AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, CASE WHEN '.' || host NOT LIKE '%.example.org' THEN 'NOT_OFFICIAL' WHEN regexp_matches(path, '/en/') THEN 'THIS_EXAM' WHEN regexp_matches(path, '/(de|fr)/') THEN 'OTHER_EXAM' WHEN regexp_matches(path, '[0-9]') THEN 'NOT_THIS_EXAM' ELSE 'UNIDENTIFIABLE' END AS relation FROM n""")
def g10_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    path = F.regexp_extract(u, "://[^/?#]*([^?#]*)", 1)
    relation = (
        F.when(U.trust(u) != "official", "NOT_OFFICIAL").when(path.rlike("/en/"), "THIS_EXAM").when(path.rlike("/(de|fr)/"), "OTHER_EXAM").when(path.rlike("[0-9]"), "NOT_THIS_EXAM").otherwise("UNIDENTIFIABLE")
    )
    return table(spark, sf_dir, "pages").select("page_id", relation.alias("relation"))


@query("""WITH h AS (SELECT user_id AS lead, 'search' AS via FROM events WHERE event_type = 'view' UNION ALL SELECT CAST(json_extract(props, '$.k') AS BIGINT), 'social' FROM events WHERE event_type = 'click')
SELECT lead, count(*) AS signals, count(DISTINCT via) AS ways, lead IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS resolved FROM h GROUP BY 1""")
def g11_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads from search and social signals, and whether each resolves to a node that is known."""
    e = table(spark, sf_dir, "events")
    h = e.where("event_type = 'view'").select(F.col("user_id").alias("lead"), F.lit("search").alias("via")).union(e.where("event_type = 'click'").select(F.get_json_object("props", "$.k").cast("long"), F.lit("social")))
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("lead"), F.lit(True).alias("known"))
    g = h.groupBy("lead").agg(F.count("*").alias("signals"), F.count_distinct("via").alias("ways"))
    return g.join(known, "lead", "left").select("lead", "signals", "ways", F.coalesce("known", F.lit(False)).alias("resolved"))


@query("""WITH c AS (SELECT l_partkey, max(l_returnflag) FILTER (l_suppkey % 7 = 0) AS official, max(l_returnflag) FILTER (l_suppkey % 7 = 1) AS reviewed FROM lineitem GROUP BY 1)
SELECT l_partkey, CASE WHEN reviewed IS NULL THEN 'NO_SECONDARY' WHEN official IS NULL THEN 'SECONDARY_ONLY' WHEN official = reviewed THEN 'CORROBORATED' ELSE 'CONTRADICTED' END AS cross_check, official AS stated FROM c""")
def x38_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reviewed secondary sources say beside the official ones: they corroborate or contradict, and never state."""
    of = lambda n: F.max(F.when(F.col("l_suppkey") % 7 == n, F.col("l_returnflag")))
    c = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(of(0).alias("official"), of(1).alias("reviewed"))
    check = F.when(F.col("reviewed").isNull(), "NO_SECONDARY").when(F.col("official").isNull(), "SECONDARY_ONLY").when(F.col("official") == F.col("reviewed"), "CORROBORATED").otherwise("CONTRADICTED")
    return c.select("l_partkey", check.alias("cross_check"), F.col("official").alias("stated"))


@query("""WITH v AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS version FROM events), p AS (SELECT user_id, event_type, count(*) // 2 AS pinned FROM events GROUP BY 1, 2)
SELECT user_id, event_type, count(event_id) AS replayed, max(event_id) AS last FROM p LEFT JOIN v USING (user_id, event_type) WHERE version <= pinned GROUP BY 1, 2""")
def s22_manifest_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a manifest pinned at half of its versions replays: the versions up to it, whatever came later."""
    v = S.versions(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"], "event_id")
    pinned = F.floor(F.count("*").over(Window.partitionBy("user_id", "event_type")) / 2)
    return v.withColumn("pinned", pinned).where("version <= pinned").groupBy("user_id", "event_type").agg(F.count("*").alias("replayed"), F.max("event_id").alias("last"))


@query(rf"""WITH n AS (SELECT page_id AS run, regexp_extract({_HOST}, '([^.]+\.[^.]+)\z', 1) AS estate, len(regexp_extract_all(html, '(?i)<a\s')) AS links FROM pages), l AS (SELECT estate, max(run) AS run FROM n GROUP BY 1)
SELECT n.estate, n.run, CAST(links AS INTEGER) AS links FROM n JOIN l ON n.estate = l.estate AND n.run = l.run""")
def w16_latest_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored walks of each estate, of which the latest is loaded."""
    n = table(spark, sf_dir, "pages").select(F.col("page_id").alias("run"), U.estate(F.col("url")).alias("estate"), F.regexp_count("html", F.lit(r"(?i)<a\s")).alias("links"))
    return S.last_write(n, ["estate"], ["run"]).select("estate", "run", "links")


@query("""SELECT o_orderkey, '{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '","lines":[' || coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey), '') || ']}' AS staged FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""")
def w19_staged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as the JSON lines of a staging artifact."""
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list("l_partkey")).alias("lines"))
    met = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(own, "o_orderkey", "left")
    record = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.coalesce("lines", F.array().cast("array<bigint>")).alias("lines"))
    return met.select("o_orderkey", F.to_json(record).alias("staged"))


#: The contract's fields: name, the column that holds it, and whether a record needs it.
CONTRACT = (("name", "c_name", True), ("segment", "c_mktsegment", True), ("balance", "c_acctbal", False))


@query("""WITH f AS (SELECT c_nationkey, unnest(['name', 'segment', 'balance']) AS field, unnest([c_name <> '', c_mktsegment <> 'HOUSEHOLD', c_acctbal >= 0]) AS held FROM customer)
SELECT c_nationkey, field, field <> 'balance' AS required, count(*) FILTER (held) AS held, count(*) FILTER (NOT held) AS missing FROM f GROUP BY 1, 2""")
def d2_contract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = {"name": F.col("c_name") != "", "segment": F.col("c_mktsegment") != "HOUSEHOLD", "balance": F.col("c_acctbal") >= 0}
    each = F.array(*[F.struct(F.lit(name).alias("field"), F.lit(needed).alias("required"), test[name].alias("held")) for name, _, needed in CONTRACT])
    f = table(spark, sf_dir, "customer").select("c_nationkey", F.explode(each).alias("x")).select("c_nationkey", "x.*")
    return f.groupBy("c_nationkey", "field", "required").agg(F.count_if("held").alias("held"), F.count_if(~F.col("held")).alias("missing"))


@query("""WITH b AS (SELECT page_id % 50 AS slot, min(page_id) AS first FROM pages WHERE url LIKE '%/en/%' GROUP BY 1) SELECT page_id, coalesce(first, page_id) AS since FROM pages LEFT JOIN b ON slot = page_id % 50""")
def j25_carried_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the first page that the snapshot before (the English ones) had in their slot, their own where it had none."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") % 50).alias("slot"))
    before = p.where(F.col("url").like("%/en/%")).groupBy("slot").agg(F.min("page_id").alias("since"))
    return records.carried(p.withColumn("since", F.lit(None).cast("long")), before, "slot", "since", F.col("page_id")).select("page_id", "since")
