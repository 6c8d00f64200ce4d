"""Links of pages with what they stand in: their row, list item, heading and table, from the pages' tags in order.

A page's tags and texts are rows; what is open at a place follows from running counts of what began and ended before
it, so elements nest to any depth and everything stays in the JVM.  A page is read in one sorted group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import urls as U
from factloom.functions.text import squash
from factloom.sources.records import unescape

#: A row of more text or more links is a layout or a menu, and names none of its links.
ROW_CHARS, ROW_LINKS = 600, 8
_SKIPPED = r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->"
_TOKEN = r"<[^>]*>|[^<]+"
_HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))"


def tokens(pages: DataFrame) -> DataFrame:
    """page_id, url, pos, tag (with a slash if it ends an element; empty for text), href (null for none) and text of each token."""
    parts = F.regexp_extract_all(F.regexp_replace(F.coalesce("html", F.lit("")), _SKIPPED, " "), F.lit(_TOKEN), F.lit(0))
    at = pages.select("page_id", "url", F.posexplode(parts).alias("pos", "t"))
    tag = F.lower(F.regexp_extract("t", r"^<\s*(/?[A-Za-z][A-Za-z0-9]*)", 1))
    href = F.when((tag == "a") & F.col("t").rlike(r"(?i)\bhref\s*="), F.concat(*[F.regexp_extract("t", _HREF, i) for i in (1, 2, 3)]))
    return at.select("page_id", "url", "pos", tag.alias("tag"), F.trim(unescape(href)).alias("href"), F.when(tag.isin("td", "th"), " ").when(~F.col("t").startswith("<"), unescape(F.col("t"))).alias("text"))


def _inside(rows: DataFrame, tag: str) -> DataFrame:
    """rows with the place at which the innermost open element of that tag began (null outside), as ``_<tag>``."""
    page = Window.partitionBy("page_id").orderBy("pos")
    deep, own = f"_{tag}_deep", f"_{tag}"
    begins, ends = F.col("tag") == tag, F.col("tag") == f"/{tag}"
    rows = rows.withColumn(deep, F.sum(F.when(begins, 1).when(ends, -1).otherwise(0)).over(page.rowsBetween(Window.unboundedPreceding, 0)))
    level = Window.partitionBy("page_id", deep).orderBy("pos")
    return rows.withColumn(own, F.when(F.col(deep) > 0, F.last(F.when(begins, F.col("pos")), ignorenulls=True).over(level))).drop(deep)


def _texts(rows: DataFrame, key: str, where: Column) -> DataFrame:
    """page_id, key and the text of the rows of each key, in order."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(where, F.struct("pos", "text")))), lambda x: x["text"]), "")
    return rows.where(F.col(key).isNotNull()).groupBy("page_id", key).agg(squash(said).alias(f"{key}_text"))


def links_in_rows(pages: DataFrame) -> DataFrame:
    """page_id, pos, target, text, heading, label, row, table_heading, context and unlinked of each link (pages: page_id, url, html).

    A link's row is the innermost table row that it stands in, its label the text of its list item before the item's
    first link, its heading the last one that ended before it, and its table's heading the one in force where the table
    began; its context is its row, after its label if the row does not say it, else its label, else its heading.  An
    anchor without an address, or with one that only begins with #, is listed as unlinked where it stands in a row.
    """
    page = Window.partitionBy("page_id").orderBy("pos")
    upto = page.rowsBetween(Window.unboundedPreceding, 0)
    rows = tokens(pages)
    edge = lambda *tags: F.when(F.col("tag").isin(*tags), F.struct("pos", "tag", "href"))
    rows = rows.withColumn("_edge", F.last(edge("a", "/a"), ignorenulls=True).over(upto)).withColumn("_a", F.when(F.col("_edge.tag") == "a", F.col("_edge.pos")))
    heads = [f"h{i}" for i in range(1, 7)]
    rows = rows.withColumn("_hedge", F.last(edge(*heads, *[f"/{h}" for h in heads]), ignorenulls=True).over(upto)).withColumn("_h", F.when(~F.startswith(F.col("_hedge.tag"), F.lit("/")), F.col("_hedge.pos")))
    for tag in ("tr", "li", "table"):
        rows = _inside(rows, tag)
    told = F.col("text").isNotNull()
    # what ends an anchor is the next edge; one that another anchor overtakes is none
    anchors = rows.where(F.col("tag").isin("a", "/a")).withColumn("_next", F.lead("tag").over(page)).where((F.col("tag") == "a") & (F.col("_next") == "/a"))
    first = rows.where((F.col("tag") == "a") & F.col("href").isNotNull() & F.col("_li").isNotNull()).groupBy("page_id", "_li").agg(F.min("pos").alias("_first"))
    labels = _texts(rows.join(first, ["page_id", "_li"], "left"), "_li", told & F.col("_a").isNull() & (F.col("pos") < F.coalesce("_first", F.lit(1 << 30))))
    by_row = _texts(rows, "_tr", told).join(anchors.where("href IS NOT NULL AND _tr IS NOT NULL").groupBy("page_id", "_tr").agg(F.count("*").alias("_links")), ["page_id", "_tr"], "left")
    by_row = by_row.where((F.col("_tr_text") != "") & (F.length("_tr_text") <= ROW_CHARS) & (F.coalesce("_links", F.lit(0)) <= ROW_LINKS)).drop("_links")
    headings = _texts(rows, "_h", told).where("_h_text <> ''").select("page_id", F.col("_h").alias("pos"), F.col("_h_text").alias("_said"))
    marks = anchors.select("page_id", "pos", F.lit(None).cast("string").alias("_said")).unionByName(headings).unionByName(rows.where("tag = 'table'").select("page_id", "pos", F.lit(None).cast("string").alias("_said")))
    in_force = marks.withColumn("heading", F.last("_said", ignorenulls=True).over(upto)).where("_said IS NULL").select("page_id", "pos", "heading")
    tables = in_force.select("page_id", F.col("pos").alias("_table"), F.col("heading").alias("table_heading"))
    out = anchors.join(_texts(rows, "_a", told).select("page_id", F.col("_a").alias("pos"), F.col("_a_text").alias("said")), ["page_id", "pos"], "left")
    out = out.join(labels, ["page_id", "_li"], "left").join(by_row, ["page_id", "_tr"], "left").join(in_force, ["page_id", "pos"], "left").join(tables, ["page_id", "_table"], "left")
    said, label, row = F.coalesce("said", F.lit("")), F.nullif("_li_text", F.lit("")), F.col("_tr_text")
    bare = (F.col("href") == "") | F.startswith(F.col("href"), F.lit("#"))
    scheme = F.col("href").rlike(r"(?i)^(?:mailto|tel|javascript|data):")
    kept = out.where(F.col("href").isNotNull() & ~scheme & (~bare | ((said != "") & F.col("_tr").isNotNull())))
    both = F.when(label.isNotNull() & ~F.contains(row, label), F.concat(label, F.lit(" · "), row)).otherwise(row)
    return kept.select(
        "page_id", "pos", F.when(~bare, U.normalise(U.resolve(F.col("href"), F.col("url")))).alias("target"), said.alias("text"), "heading", label.alias("label"), row.alias("row"),
        F.when(F.col("_table").isNotNull(), F.col("table_heading")).alias("table_heading"), F.coalesce(both, label, F.col("heading"), F.lit("")).alias("context"), bare.alias("unlinked"),
    )
