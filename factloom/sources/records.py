"""Sources beyond Parquet: feeds and profiles of JSON, XML entries, web pages as text and table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

from factloom.functions.text import squash


def feed_items(raw: DataFrame, body: str, item: DataType, field: str = "data") -> tuple[DataFrame, DataFrame]:
    """Items of JSON bodies and the rows that were refused: a body without a list is a failed read, not an empty one."""
    path = F.get_json_object(body, f"$.{field}")
    read = raw.withColumn("_items", F.when(path.startswith("["), F.from_json(path, ArrayType(item))))
    keys = [c for c in raw.columns if c != body]
    good = read.where(F.col("_items").isNotNull()).select(*keys, F.posexplode("_items").alias("pos", "item")).select(*keys, "pos", "item.*")
    return good, read.where(F.col("_items").isNull()).drop("_items")


def checked(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that break no rule, and the others with the names of the rules they break."""
    problems = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    told = rows.withColumn("problems", problems)
    return told.where(F.size("problems") == 0).drop("problems"), told.where(F.size("problems") > 0)


def feed_entries(raw: DataFrame, xml: str, most: int = 4) -> DataFrame:
    """The first entries of XML feeds: title, link and published."""
    entry = F.slice(F.regexp_extract_all(xml, F.lit(r"(?s)<entry\b[^>]*>(.*?)</entry>"), F.lit(1)), 1, most)
    part = lambda tag: unescape(squash(F.regexp_extract("entry", rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1)))
    at = raw.select(*[c for c in raw.columns if c != xml], F.posexplode(entry).alias("pos", "entry"))
    return at.withColumns({"title": part("title"), "link": F.regexp_extract("entry", r'<link\b[^>]*href="([^"]*)"', 1), "published": part("published")}).drop("entry")


def carried(now: DataFrame, before: DataFrame, key: str, seen: str, today: Column) -> DataFrame:
    """now with the day each key was first seen, from the snapshot before where it has one."""
    return now.join(before.select(key, F.col(seen).alias("_seen")), key, "left").withColumn(seen, F.coalesce("_seen", today)).drop("_seen")


def unescape(c: Column) -> Column:
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def visible_text(html: Column) -> Column:
    """A page's text without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return squash(unescape(F.regexp_replace(bare, r"(?s)<[^>]*>", " ")))


def table_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """Rows of HTML tables: the page's columns, row number and cells as text."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))
    cells = F.transform(F.regexp_extract_all("_row", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1)), visible_text)
    keys = [c for c in pages.columns if c != html]
    return pages.select(*keys, F.posexplode(rows).alias("row", "_row")).select(*keys, "row", cells.alias("cells"))


def kind_of(content: Column) -> Column:
    """pdf or html, by the first bytes of binary content."""
    return F.when(F.substring(content, 1, 4) == F.lit(b"%PDF"), "pdf").otherwise("html")


def unreadable(text: Column, least_words: int = 40, most: float = 0.2) -> Column:
    """Whether too many words have no vowel: the mark of a font without an encoding.

    Only words of three letters and more that are not all capitals count (capitals are abbreviations), and a text
    with fewer than least_words of them is not judged.
    """
    words = F.filter(F.regexp_extract_all(text, F.lit(r"[A-Za-z]{3,}"), F.lit(0)), lambda w: w != F.upper(w))
    bare = F.size(F.filter(words, lambda w: ~w.rlike("(?i)[aeiouy]")))
    return (F.size(words) >= least_words) & (bare > most * F.size(words))


#: What ends one block of a page and begins the next.
BLOCK = r"(?i)</?(?:p|li|div|article|nav|ul|ol|table|tr|h[1-6]|br|section)\b[^>]*>"


def blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """Blocks of a page that have text, in order: pos (of all blocks), text and links."""
    keys = [c for c in pages.columns if c != html]
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    each = pages.select(*keys, F.posexplode(F.split(bare, BLOCK)).alias("pos", "_b"))
    return each.select(*keys, "pos", visible_text(F.col("_b")).alias("text"), F.regexp_count("_b", F.lit(r"(?i)<a[\s/]")).alias("links")).where("text != ''")


def links_in_context(pages: DataFrame, html: str = "html") -> DataFrame:
    """Anchors of a page in order, with their text and the heading they stand under (null: none)."""
    keys = [c for c in pages.columns if c != html]
    parts = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]\s*>|<a[\s/][^>]*>.*?</a\s*>"), F.lit(0))
    each = pages.select(*keys, F.posexplode(parts).alias("pos", "_p"))
    under = F.last(F.when(F.col("_p").rlike(r"(?i)^<h[1-6]"), visible_text(F.col("_p"))), ignorenulls=True).over(Window.partitionBy(*keys).orderBy("pos"))
    return each.select(*keys, "pos", "_p", visible_text(F.col("_p")).alias("text"), under.alias("heading")).where(F.col("_p").rlike(r"(?i)^<a")).drop("_p")


def headed_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """Cells of tables whose first row is a header: row (from 1), header and value."""
    rows = table_rows(pages, html)
    keys = [c for c in pages.columns if c != html]
    head = rows.where("row = 0").select(*keys, F.col("cells").alias("_head"))
    met = rows.where("row > 0").join(head, keys)
    return met.select(*keys, "row", F.explode(F.arrays_zip(F.col("_head").alias("header"), F.col("cells").alias("value"))).alias("x")).select(*keys, "row", "x.*")


def numbered_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of a table that a text prints as numbered lines: ordinal, name and count.

    A line is a row where its number goes on from the row before (the first is 1 or 2); totals, headings and numbers
    out of the run are none.
    """
    line = texts.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "l"))
    form = r"^\s*([0-9]{1,4})[.)]\s+(.*?)\s+([0-9][0-9,]*)\s*$"
    part = lambda n: F.regexp_extract("l", form, n)
    rows = line.where(F.col("l").rlike(form)).select(key, "pos", part(1).cast("int").alias("ordinal"), part(2).alias("name"), F.replace(part(3), F.lit(","), F.lit("")).cast("long").alias("n"))
    w = Window.partitionBy(key).orderBy("pos")
    run = rows.withColumn("_shift", F.col("ordinal") - F.row_number().over(w)).withColumn("_first", F.first("_shift").over(w))
    return run.where((F.col("_shift") == F.col("_first")) & F.col("_first").isin(0, 1)).select(key, "ordinal", "name", "n")
