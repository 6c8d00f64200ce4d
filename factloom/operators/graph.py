"""Links between pages and trees as node and edge tables."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from factloom.functions import urls as U

from .stored import place, stored


def merge_nodes(seen: DataFrame, rank: dict[str, int]) -> DataFrame:
    """One node for each normalised URL: strongest trust, known role before unknown, least depth, first page, readings."""
    order = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])[F.col("trust")]
    return seen.groupBy("node").agg(
        F.min_by("trust", order).alias("trust"), F.min("role").alias("role"), F.min("depth").alias("depth"), F.min("page_id").alias("first_page"), F.count("*").alias("n_seen")
    )


def edges_of(links: DataFrame) -> DataFrame:
    """Distinct (source, target) without loops, with how often each was seen."""
    return links.where("source != target").groupBy("source", "target").agg(F.count("*").alias("n"))


def without_chrome(links: DataFrame, share: float = 0.5) -> DataFrame:
    """links (estate, page_id, target) without the targets that at least that share of an estate's linking pages link to.

    Pages are read once: the narrow links are dealt by target, and what is counted and what is kept both read that exchange.
    Keys are never null there, so that no reader of it asks for other rows than the next; a null target is none to count.
    """
    keys = [F.coalesce(c, F.lit("")).alias(c) for c in ("estate", "target")]
    dealt = links.select("page_id", *keys).repartition("estate", "target")
    of = dealt.select("estate", "page_id").distinct().groupBy("estate").agg(F.count("*").alias("pages"))
    each = dealt.distinct().groupBy("estate", "target").agg(F.count("*").alias("n"))
    common = each.join(of, "estate").where((F.col("pages") > 1) & (F.col("n") >= share * F.col("pages")) & (F.col("target") != ""))
    kept = dealt.join(common.select("estate", "target"), ["estate", "target"], "left_anti")
    return kept.select("estate", "page_id", F.nullif("target", F.lit("")).alias("target"))


def ancestors(tree: DataFrame) -> DataFrame:
    """node, root, level and path (root first) of a table (node, parent) of any depth; a loop ends where it closes.

    Each round a node takes over the way of the node that its own way has reached, so ways double in length and the
    rounds grow with the logarithm of the depth; each round's ways are stored.  A parent without a row of its own is a root.
    """
    every = tree.select("node", "parent").unionByName(tree.select(F.col("parent").alias("node"), F.lit(None).cast(dict(tree.dtypes)["parent"]).alias("parent")).where("node IS NOT NULL"))
    way = every.groupBy("node").agg(F.max("parent").alias("at")).select("node", "at", F.array("node").alias("path"))
    while True:
        way = stored(way, "ways")
        if not way.where("at IS NOT NULL").limit(1).count():
            break
        up = way.select(F.col("node").alias("_n"), F.col("at").alias("_at"), F.col("path").alias("_path"))
        met = way.join(up, F.col("at") == F.col("_n"), "left")
        closed = F.arrays_overlap("path", "_path")  # a loop: the way ends at what is not on it yet
        longer = F.when(F.col("at").isNull(), F.col("path")).otherwise(F.concat(F.array_except("_path", "path"), "path"))
        way = met.select("node", F.when(F.col("at").isNotNull() & ~closed, F.col("_at")).alias("at"), longer.alias("path"))
    own = tree.select("node").distinct()
    return way.join(own, "node").select("node", F.element_at("path", 1).alias("root"), (F.size("path") - 1).alias("level"), F.array_join("path", "/").alias("path"))


#: An anchor up to its href, and the value in double quotes, single quotes or none, as the reference reads it.
_BEFORE = r"<a[\s/][^>]*?\bhref\s*=\s*"
_HREF = rf"""(?i){_BEFORE}(?:"[^"]*"|'[^']*'|[^\s>]+)"""


def _value(anchor: Column) -> Column:
    bare = F.regexp_replace(anchor, rf"(?i)\A{_BEFORE}", "")
    quoted = bare.startswith('"') | bare.startswith("'")
    return F.when(quoted, F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)


@F.pandas_udf(StringType())
def _unescape(c: pd.Series) -> pd.Series:
    return c.map(lambda s: (html.unescape(s) if "&" in s else s).strip())


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, pos, href and the absolute, normalised target of every anchor with an href, in page order.

    Any letter case, blanks at the equals sign, either quotes or none; entities in the value are resolved.
    """
    found = F.regexp_extract_all("html", F.lit(_HREF), F.lit(0))
    at = pages.select("page_id", "url", F.posexplode(found).alias("pos", "raw")).withColumn("href", _unescape(_value(F.col("raw"))))
    return at.select("page_id", "url", "pos", "href", U.normalise(U.resolve(F.col("href"), F.col("url"))).alias("target"))


def provenance(edges: DataFrame, hops: int = 8) -> DataFrame:
    """node and chain (the way by which it was first reached, root first, at most ``hops`` steps) of every target.

    edges: source, target, ord.  Of a node's edges the first counts.  Ways double in length each round, so eight hops
    take three joins; a way ends where it meets a node again.
    """
    if hops & (hops - 1):
        raise ValueError("hops is a power of two")
    way = edges.groupBy(F.col("target").alias("node")).agg(F.min_by("source", "ord").alias("up")).select("node", F.array("up").alias("ups"))
    for _ in range(hops.bit_length() - 1):
        more = way.select(F.col("node").alias("_n"), F.col("ups").alias("_more"))
        way = way.join(more, F.element_at("ups", -1) == F.col("_n"), "left").select("node", F.concat("ups", F.coalesce("_more", F.slice("ups", 1, 0))).alias("ups"))
    again = F.exists(F.sequence(F.lit(1), F.size("ups")), lambda i: F.array_contains(F.concat(F.array("node"), F.slice("ups", F.lit(1), i - 1)), F.element_at("ups", i)))
    ends = F.element_at(F.filter(F.sequence(F.lit(1), F.size("ups")), lambda i: F.array_contains(F.concat(F.array("node"), F.slice("ups", F.lit(1), i - 1)), F.element_at("ups", i))), 1)
    return way.select("node", F.reverse(F.when(again, F.slice("ups", F.lit(1), ends)).otherwise(F.col("ups"))).alias("chain"))


#: What ends a node's part in a walk, in the order in which it is looked at.
OPENED, LEVEL_LIMIT, PAGE_LIMIT, FILE_LIMIT = "OPENED", "DEPTH_LIMIT", "PAGE_BUDGET", "FILE_BUDGET"


def walk(links: DataFrame, roots: DataFrame, depth: int = 2, pages: int = 25, nodes: int = 600, files: int = 40) -> DataFrame:
    """What a walk of each run reaches: run, node, depth, place (in queue order), file, opened and state.

    links: run, source, target, pos and, if there are files, file (the target is a document) and listed (it is an item
    of a repository); roots: run, node.  Level by level: of a level the pages within the run's budget are opened in
    queue order, and their links are followed in page order; of what they lead to for the first time as much is
    recorded as the run's budget of nodes allows.  Files have a budget of their own: those that a repository lists are fetched
    first, in queue order, and loose ones only with what is left when the walk has ended.

    A level is one join over the links of the opened, and it is stored.  A run's frontier is cut to its budget by a group
    limit before it is numbered, so no task sorts more of a run than a partition's share and the budgets.
    """
    spark, queue = links.sparkSession, Window.partitionBy("run").orderBy("_from", "pos", "node")
    for name in ("file", "listed"):
        if name not in links.columns:
            links = links.withColumn(name, F.lit(False))
    seen = roots.select("run", "node", F.lit(0).alias("depth"), F.lit(1).cast("long").alias("place"), F.lit(False).alias("file"), F.lit(False).alias("listed"), F.lit(True).alias("opened"))
    at = place(spark, "walk")
    seen.write.parquet(f"{at}/level=0")
    for d in range(1, depth + 1):
        before = spark.read.schema(seen.schema).parquet(*[f"{at}/level={i}" for i in range(d)])
        level = spark.read.schema(seen.schema).parquet(f"{at}/level={d - 1}")
        spent = before.groupBy("run").agg(F.count_if("opened").alias("_opened"), F.count("*").alias("_held"))
        out = level.where("opened").select("run", F.col("node").alias("source"), F.col("place").alias("_from")).join(links, ["run", "source"])
        first = out.groupBy("run", F.col("target").alias("node")).agg(F.min(F.struct("_from", "pos")).alias("x"), F.bool_or("file").alias("file"), F.bool_or("listed").alias("listed"))
        new = first.select("run", "node", "x.*", "file", "listed").join(before.select("run", "node"), ["run", "node"], "left_anti")
        new = new.withColumn("_nth", F.row_number().over(queue)).where(F.col("_nth") <= nodes).join(spent, "run")
        new = new.withColumn("place", F.col("_held") + F.col("_nth")).where(F.col("place") <= nodes)
        page = F.sum((~F.col("file")).cast("long")).over(queue.rowsBetween(Window.unboundedPreceding, 0))
        opened = ~F.col("file") & (F.col("_opened") + page <= pages) & F.lit(d < depth)
        new.select("run", "node", F.lit(d).alias("depth"), "place", "file", "listed", opened.alias("opened")).write.parquet(f"{at}/level={d}")
    every = spark.read.schema(seen.schema).parquet(*[f"{at}/level={i}" for i in range(depth + 1)])
    # at most ``nodes`` rows of a run are left
    turn = F.row_number().over(Window.partitionBy("run", "file").orderBy(F.desc("listed"), "place"))
    fetched = F.col("file") & (turn <= files)
    state = F.when(F.col("opened") | fetched, OPENED).when(F.col("file"), FILE_LIMIT).when(F.col("depth") >= depth, LEVEL_LIMIT).otherwise(PAGE_LIMIT)
    return every.select("run", "node", "depth", "place", "file", (F.col("opened") | fetched).alias("opened"), state.alias("state"))


def flat_topics(tree: DataFrame, most: int = 40) -> DataFrame:
    """topic and its number of subtopics: a node whose children are all leaves, and every leaf whose siblings are not all leaves."""
    leaf = tree.join(tree.select(F.col("parent").alias("node")).where("node IS NOT NULL").distinct(), "node", "left_anti").select("node", F.lit(True).alias("leaf"))
    own = tree.join(leaf, "node", "left").withColumn("leaf", F.coalesce("leaf", F.lit(False)))
    kids = own.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n"), F.bool_and("leaf").alias("flat"))
    whole = kids.where("flat").select("node", F.least(F.col("n"), F.lit(most)).cast("long").alias("subtopics"))
    mixed = kids.where("NOT flat").select(F.col("node").alias("parent"))
    alone = own.where("leaf AND parent IS NULL").select("node").unionByName(own.where("leaf").join(mixed, "parent", "left_semi").select("node"))
    return whole.unionByName(alone.select("node", F.lit(0).cast("long").alias("subtopics"))).withColumnRenamed("node", "topic")


def fold_rules(tree: DataFrame) -> DataFrame:
    """node and state of a tree of rule groups (node, parent, op ALL / ANY, state of leaves): three-valued, bottom up.

    ALL: FAIL beats UNKNOWN beats OK; ANY the other way round; a group without members is UNKNOWN.  A level reads the
    states of the level below it and no others, and is stored, so the work of a level does not grow with the depth.
    """
    spark = tree.sparkSession
    rank = F.create_map(*[F.lit(x) for pair in (("FAIL", 0), ("UNKNOWN", 1), ("OK", 2)) for x in pair])
    placed = stored(tree.join(ancestors(tree.select("node", "parent")).select("node", "level"), "node"), "placed")
    deepest = placed.agg(F.max("level").alias("d")).first()["d"]
    if deepest is None:
        return tree.select("node", "state").where("false")
    at, below = place(spark, "states"), None
    for d in range(deepest, -1, -1):
        here = placed.where(F.col("level") == d)
        if below is None:
            here = here.withColumns({"low": F.lit(None).cast("int"), "high": F.lit(None).cast("int")})
        else:
            here = here.join(below.groupBy(F.col("parent").alias("node")).agg(F.min("r").alias("low"), F.max("r").alias("high")), "node", "left")
        r = F.when(F.col("state").isNotNull(), rank[F.col("state")]).when(F.col("op") == "ALL", F.col("low")).otherwise(F.col("high"))
        told = here.select("node", "parent", F.coalesce(r, F.lit(1)).alias("r"))
        told.write.parquet(f"{at}/level={d}")
        below = spark.read.schema(told.schema).parquet(f"{at}/level={d}")
    done = spark.read.schema(told.schema).parquet(*[f"{at}/level={d}" for d in range(deepest + 1)])
    return done.select("node", F.element_at(F.array(F.lit("FAIL"), F.lit("UNKNOWN"), F.lit("OK")), F.col("r") + 1).alias("state"))
