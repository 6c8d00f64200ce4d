"""Statements about one thing brought together: which belong together, what they say in sum, and what stays open.

Nothing is chosen by its place in a list: a value gives way only to a statement that says it revises, or to the later
word on what is extended; everything else stays and is marked for review.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ladders import rivals
from .stateful import fold


SEP = "\u001f"


def _key(keys: list[str]) -> Column:
    return F.concat_ws(SEP, *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])


def first_fitting() -> Callable[[], Callable[[str], int]]:
    """Numbers the bucket of each cycle: the first bucket whose first member has the same cycle, or where one is blank."""

    def make() -> Callable[[str], int]:
        heads: list[str] = []

        def step(cycle: str) -> int:
            for i, head in enumerate(heads):
                if not head or not cycle or head == cycle:
                    return i
            heads.append(cycle)
            return len(heads) - 1

        return step

    return make


def bucketed(statements: DataFrame, keys: list[str], cycle: str, order: list[str]) -> DataFrame:
    """statements with the bucket of their event: same keys, and a cycle that fits the bucket's first.

    Which bucket a blank cycle joins depends on what came before, so this is a fold; it holds a key's distinct cycles.
    """
    told = statements.withColumn("_key", _key(keys)).withColumn(cycle, F.coalesce(cycle, F.lit("")))
    return fold(told, "_key", order, first_fitting(), [cycle], "bucket", "int").drop("_key")


def reconcile_dates(statements: DataFrame, keys: list[str], cycle: str, order: str, extendable: list[str], kind: str) -> DataFrame:
    """Each statement (keys, cycle, order, date, rank, revises) with its bucket and what became of it.

    KEPT: alone, or the first of statements that all give one date; MERGED: agrees with what is kept; GOVERNS: says it
    revises (the first that does), or is the later word on a window that can be extended; CORROBORATES: gives the
    governing date too; SUPERSEDED: gives another; NEEDS_REVIEW: dates differ and none says it corrects the others.
    A statement without a date is a date of its own kind: silence beside a date is not agreement.
    """
    b = bucketed(statements, keys, cycle, [order])
    every = Window.partitionBy(*keys, "bucket")
    over = lambda c: c.over(every)
    first_of = lambda test: over(F.min(F.when(test, F.col(order))))
    dated, notice = F.col("date").isNotNull(), 2
    b = b.withColumns({
        "_n": over(F.count("*")), "_dated": over(F.count("date")), "_low": over(F.min("date")), "_high": over(F.max("date")), "_first": over(F.min(order)),
        "_revision": first_of(F.col("revises") & dated), "_best": over(F.min("rank")),
    })
    top = (F.col("rank") == F.col("_best")) & dated
    b = b.withColumns({
        "_top_low": over(F.min(F.when(top, F.col("date")))), "_top_high": over(F.max(F.when(top, F.col("date")))), "_top": first_of(top),
        "_between": over(F.count_if((F.col("rank") > F.col("_best")) & (F.col("rank") < notice))), "_lower": over(F.max(F.when(F.col("rank") > F.col("_best"), F.col("date")))),
    })
    one = ((F.col("_dated") == F.col("_n")) & (F.col("_low") == F.col("_high"))) | (F.col("_dated") == 0)
    revised = (F.col("_dated") >= 2) & F.col("_revision").isNotNull()
    extended = (
        F.col(kind).isin(*extendable) & (F.col("_best") < notice) & (F.col("_top_low") == F.col("_top_high")) & (F.col("_between") == 0)
        & ~F.coalesce(F.col("_lower") > F.col("_top_low"), F.lit(False))
    )
    governing = F.when(revised, F.col("_revision")).when(F.coalesce(extended, F.lit(False)), F.col("_top"))
    b = b.withColumn("_governing", governing).withColumn("_date", over(F.max(F.when(F.col(order) == F.col("_governing"), F.col("date")))))
    outcome = (
        F.when(one, F.when(F.col(order) == F.col("_first"), "KEPT").otherwise("MERGED"))
        .when(F.col("_governing").isNull(), "NEEDS_REVIEW").when(F.col(order) == F.col("_governing"), "GOVERNS")
        .when(F.col("date") == F.col("_date"), "CORROBORATES").otherwise("SUPERSEDED")
    )
    return b.withColumn("outcome", outcome).select(*statements.columns, "bucket", "outcome")


#: A window and the kinds that name one of its ends are about the same thing.
WINDOWS = {"APPLICATION_WINDOW": ("APPLICATION_START", "APPLICATION_END"), "CORRECTION_WINDOW": ("CORRECTION_START", "CORRECTION_END")}
_FAMILY = {kind: window for window, ends in WINDOWS.items() for kind in (window, *ends)}


def aligned(a: str, b: str) -> bool:
    return a == b or (_FAMILY.get(a) is not None and _FAMILY.get(a) == _FAMILY.get(b) and (a in WINDOWS or b in WINDOWS))


def pair_off() -> Callable[[], Callable[[bool, str, str, int], int | None]]:
    """Gives each existing milestone the first incoming one not yet taken that is about the same thing."""

    def make() -> Callable[[bool, str, str, int], int | None]:
        free: list[tuple[str, str, int]] = []

        def step(incoming: bool, kind: str, cycle: str, number: int) -> int | None:
            if incoming:
                free.append((kind, cycle, number))
                return None
            for i, (other, own, partner) in enumerate(free):
                if aligned(kind, other) and (not cycle or not own or cycle == own):
                    del free[i]
                    return partner
            return None

        return step

    return make


def pair_milestones(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """existing (id, kind, cycle, keys) with ``partner``, the id of the incoming milestone that it is matched with.

    Greedy, in the order of ids, so it is a fold over each scope: incoming first, then existing.
    """
    family = F.create_map(*[F.lit(x) for pair in _FAMILY.items() for x in pair])
    names = ["id", "kind", "cycle", *keys]
    both = incoming.select(F.lit(True).alias("_in"), *names).unionByName(existing.select(F.lit(False).alias("_in"), *names))
    both = both.withColumn("_key", F.concat_ws(SEP, F.coalesce(family[F.col("kind")], "kind"), _key(keys))).withColumn("cycle", F.coalesce("cycle", F.lit("")))
    paired = fold(both, "_key", [F.desc("_in"), F.col("id")], pair_off(), ["_in", "kind", "cycle", "id"], "partner", "long")
    return paired.where("NOT _in").select(*names, "partner")


def merge_milestones(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The decision on each milestone (id, kind, cycle, keys, date; incoming also revises): nothing that stands is removed.

    existing_id, incoming_id and action: UNCHANGED (none concerns it, or none with a date), CONFIRMED, SUPERSEDED (both
    kept), CONFLICTED (both kept, both for review), ADDED.
    """
    pairs = pair_milestones(existing, incoming, keys).select(F.col("id").alias("existing_id"), F.col("partner").alias("incoming_id"))
    old = existing.select(F.col("id").alias("existing_id"), F.col("date").alias("old"))
    new = incoming.select(F.col("id").alias("incoming_id"), F.col("date").alias("new"), "revises")
    met = pairs.join(old, "existing_id").join(new, "incoming_id", "full")
    action = (
        F.when(F.col("existing_id").isNull(), "ADDED").when(F.col("new").isNull(), "UNCHANGED").when(F.col("old") == F.col("new"), "CONFIRMED")
        .when(F.col("revises"), "SUPERSEDED").otherwise("CONFLICTED")
    )
    return met.select("existing_id", "incoming_id", action.alias("action"))


def merge_results(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Decisions on incoming declarations (keys, order, incoming, value, cancels, revised, published), in order.

    The first of an identity stands (ADDED if it came in); later ones with its value confirm it; they supersede it if
    they say so or were published after it and all that confirmed it by then; else they conflict with it.
    """
    w = Window.partitionBy(*keys).orderBy(F.col("incoming"), order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("value").over(w.rowsBetween(Window.unboundedPreceding, 0))
    r = rows.withColumn("_nth", F.row_number().over(w)).withColumn("_first", first)
    same = F.col("value").eqNullSafe(F.col("_first")) & ~F.col("cancels")
    r = r.withColumn("_by_then", F.max(F.when((F.col("_nth") == 1) | (same & F.col("incoming")), F.col("published"))).over(before))
    decision = (
        F.when(F.col("_nth") == 1, "ADDED").when(same, "CONFIRMED")
        .when(F.col("revised") | F.col("cancels") | (F.col("published") > F.col("_by_then")), "SUPERSEDED").otherwise("CONFLICTED")
    )
    return r.where("incoming").select(*rows.columns, decision.alias("decision"))


def merge_facts(facts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One fact a key from facts (status, value, order): only VERIFIED ones with a value count.

    All alike: VERIFIED with the confidence min(1, 0.6 + 0.2 n); else NEEDS_REVIEW.  None: NOT_PUBLISHED if one says so.
    """
    good = (F.col("status") == "VERIFIED") & F.col("value").isNotNull()
    v = F.when(good, F.col("value"))
    g = facts.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.min_by("value", F.when(good, F.col(order))).alias("said"), F.count_if(F.col("status") == "NOT_PUBLISHED").alias("silent"))
    status = F.when(F.col("n") == 0, F.when(F.col("silent") > 0, "NOT_PUBLISHED").otherwise("NOT_EXTRACTED")).when(F.col("low") == F.col("high"), "VERIFIED").otherwise("NEEDS_REVIEW")
    return g.select(*keys, status.alias("status"), "said", F.when(status == "VERIFIED", F.round(F.least(F.lit(1.0), 0.6 + 0.2 * F.col("n")), 2)).alias("confidence"))


def validate_facts(facts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """facts (keys, value, kind, source, source_url, confidence, reachable, order) with status and reason, by seven rules in turn.

    Required, address, typed value, duplicate, conflict, reachability, confidence.  A fact conflicts with one of its
    key that differs in value and in source; both stay and none is chosen.
    """
    web = r"^(?i:https?)://[^/?#\s]+"
    value = F.lower(F.trim(F.col("value")))
    missing = F.coalesce(F.trim("value"), F.lit("")) == ""
    bad_url = ~F.coalesce(F.col("source_url").rlike(web), F.lit(False)) | ((F.col("kind") == "URL") & ~F.col("value").rlike(web))
    bad_date = (F.col("kind") == "DATE") & F.try_to_date("value", "yyyy-MM-dd").isNull()
    f = facts.withColumn("_why", F.when(missing | F.col("source_url").isNull(), "required").when(bad_url, "url").when(bad_date, "date")).withColumn("_value", value)
    nth = F.row_number().over(Window.partitionBy(*keys, "value", "source_url", F.col("_why").isNull()).orderBy(order))
    f = f.withColumn("_why", F.coalesce("_why", F.when(nth > 1, "duplicate")))
    f = rivals(f, keys, "_value", "source_url", F.col("_why").isNull()).withColumnRenamed("rivals", "_rivals")
    status = (
        F.when(F.col("_why") == "duplicate", "duplicate").when(F.col("_why").isNotNull(), "rejected").when(F.col("_rivals") > 0, "conflicting")
        .when(F.col("reachable") & (F.col("confidence") >= 0.6), "validated").otherwise("pending")
    )
    reason = F.coalesce("_why", F.when(F.col("_rivals") > 0, "rivals").when(~F.col("reachable"), "unreachable").when(F.col("confidence") < 0.6, "confidence").otherwise(""))
    return f.select(*facts.columns, status.alias("status"), reason.alias("reason"))


def decide(candidates: DataFrame, keys: list[str], least: float = 0.25) -> DataFrame:
    """Which body a name means, from candidates (keys, body, score, named): never by a gap between scores.

    Bodies with at least that share of the scores are plausible (if none is, the first); one plausible body, or one
    that the name itself tells apart (named), is RESOLVED; else AMBIGUOUS.
    """
    w = Window.partitionBy(*keys)
    share = F.greatest(F.col("score"), F.lit(0.0)) / F.greatest(F.sum(F.greatest(F.col("score"), F.lit(0.0))).over(w), F.lit(1e-9))
    c = candidates.withColumn("_share", share).withColumn("_place", F.row_number().over(w.orderBy(F.desc("score"), "body")))
    c = c.withColumn("_many", F.count_if(F.col("_share") >= least).over(w))
    plausible = (F.col("_share") >= least) | ((F.col("_many") == 0) & (F.col("_place") == 1))
    g = c.where(plausible).groupBy(*keys).agg(F.count("*").alias("plausible"), F.min("body").alias("_only"), F.count_if("named").alias("_named"), F.min(F.when(F.col("named"), F.col("body"))).alias("_told"))
    chosen = F.when(F.col("plausible") == 1, F.col("_only")).when(F.col("_named") == 1, F.col("_told"))
    return g.select(*keys, "plausible", chosen.alias("chosen"), F.when(chosen.isNull(), "AMBIGUOUS").otherwise("RESOLVED").alias("decision"))
