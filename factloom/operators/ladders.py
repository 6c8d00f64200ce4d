"""Merges and verdicts that never choose a winner in silence: each keeps what stands and says how it was decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rival_groups(facts: DataFrame, keys: list[str], value: str, source: str) -> DataFrame:
    """For each key: facts, values, sources, and whether two facts differ in value and in source.

    Pairs of a value and a source that pairwise share one of them all share one and the same, so there are rivals
    where the facts that state both have several values and several sources: one aggregate, no self-join.  Whether
    there are several is told by 64-bit hashes, which aggregate without sorting.
    """
    v, s = (F.when(F.col(value).isNotNull() & F.col(source).isNotNull(), F.xxhash64(c)) for c in (value, source))
    return facts.groupBy(*keys).agg(
        F.count("*").alias("n_facts"), F.count_distinct(value).alias("n_values"), F.count_distinct(source).alias("n_sources"),
        F.coalesce((F.min(v) != F.max(v)) & (F.min(s) != F.max(s)), F.lit(False)).alias("conflicting"),
    )


def rivals(facts: DataFrame, keys: list[str], value: str, source: str, told: Column | None = None) -> DataFrame:
    """facts with ``rivals``: how many other facts of the key differ in value and in source, without joining pairs.

    All of the key's facts less those of its value, less those of its source, and those of both counted back.  Facts
    are counted by (key, value, source) first, in the map step too, and the other counts are sums of these; so a hot key
    is no group of rows, and facts are read once more to be given their number.  Only facts that tell both (or, if
    given, those of told) are counted and have rivals.
    """
    told = F.col(value).isNotNull() & F.col(source).isNotNull() if told is None else told
    by = [*keys, value, source]
    one = facts.where(told).groupBy(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)]).agg(F.count("*").alias("_n"))
    names = [f"_{i}" for i in range(len(by))]
    k, v, s = names[: len(keys)], names[-2], names[-1]

    def with_sum(df: DataFrame, cols: list[str], name: str) -> DataFrame:
        part = one.groupBy(*[F.col(c).alias(f"{c}_") for c in cols]).agg(F.sum("_n").alias(name))
        same = F.lit(True)
        for c in cols:
            same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
        return df.join(part, same).drop(*[f"{c}_" for c in cols])

    counted = with_sum(with_sum(with_sum(one, k, "_all"), [*k, v], "_v"), [*k, s], "_s")
    counted = counted.select(*names, (F.col("_all") - F.col("_v") - F.col("_s") + F.col("_n")).alias("rivals"))
    same = told
    for name, c in zip(names, by, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(name))
    return facts.join(counted, same, "left").drop(*names).withColumn("rivals", F.coalesce("rivals", F.lit(0).cast("long")))


def reconcile_claims(claims: DataFrame, keys: list[str], value: str, klass: str, order: str) -> DataFrame:
    """One verdict for each key from claims of class official, secondary, lead or unverified.

    UNSUPPORTED without a verified claim (LEADS_ONLY if there are leads), SECONDARY_ONLY without an official one,
    OFFICIAL_CONFLICT with several official values, OFFICIAL_CONTESTED if a secondary value differs, CORROBORATED if
    one agrees, else OFFICIAL.  Values are compared in lower case and trimmed, but what is returned is what a source
    said: of the value that stands the official claim first in that order (a number), and of a conflict all of them.
    """
    kind = F.col(klass)
    # rows of one wording first, by counts and numbers alone, which aggregate without sorting
    worded = claims.groupBy(*keys, F.lower(F.trim(value)).alias("v"), F.col(value).alias("w")).agg(
        F.count_if(kind == "official").alias("official"), F.count_if(kind == "secondary").alias("secondary"), F.count_if(kind == "lead").alias("leads"), F.min(F.when(kind == "official", F.col(order))).alias("at")
    ).repartition(*keys)  # what follows needs no other exchange
    each = worded.groupBy(*keys, "v").agg(
        *[F.sum(c).alias(c) for c in ("official", "secondary", "leads")], F.min_by("w", F.when(F.col("at").isNotNull(), F.struct("at", "w"))).alias("said")
    )
    told, other = F.col("official") > 0, (F.col("official") == 0) & (F.col("secondary") > 0)
    got = each.groupBy(*keys).agg(
        F.count_if(told).alias("n_official"), F.count_if(other).alias("n_other"), F.count_if(told & (F.col("secondary") > 0)).alias("n_agreed"), F.sum("leads").alias("n_leads"),
        F.min(F.when(told, F.col("said"))).alias("said"), F.array_join(F.sort_array(F.collect_list(F.when(told, F.col("said")))), " | ").alias("rivals"),
    )
    state = (
        F.when((F.col("n_official") == 0) & (F.col("n_other") == 0), F.when(F.col("n_leads") > 0, "LEADS_ONLY").otherwise("UNSUPPORTED"))
        .when(F.col("n_official") == 0, "SECONDARY_ONLY").when(F.col("n_official") > 1, "OFFICIAL_CONFLICT")
        .when(F.col("n_other") > 0, "OFFICIAL_CONTESTED").when(F.col("n_agreed") > 0, "CORROBORATED").otherwise("OFFICIAL")
    )
    return got.select(*keys, state.alias("state"), F.when(F.col("n_official") == 1, F.col("said")).alias("value"), F.when(F.col("n_official") > 1, F.col("rivals")).alias("conflict"))


def merge_dated(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Ladder of a dated merge (key, value; incoming also revises): nothing that stands is ever removed."""
    new = incoming.select(key, F.col("value").alias("new_value"), "revises", F.lit(True).alias("_in"))
    met = existing.withColumn("_was", F.lit(True)).join(new, key, "full")
    state = (
        F.when(F.col("_was").isNull(), "ADDED").when(F.col("new_value").isNull(), "UNCHANGED").when(F.col("value").eqNullSafe(F.col("new_value")), "CONFIRMED")
        .when(F.col("revises"), "SUPERSEDED").otherwise("CONFLICTED")
    )
    effective = F.when(state.isin("ADDED", "SUPERSEDED"), F.col("new_value")).when(state == "CONFLICTED", F.lit(None)).otherwise(F.col("value"))
    return met.select(key, state.alias("state"), effective.alias("effective"), (state == "CONFLICTED").alias("needs_review"))


def figure(old: Column, new: Column) -> Column:
    """A stated figure against the record's: KEPT, ADDED, CONFIRMED or UNDER_REVIEW."""
    return F.when(new.isNull(), "KEPT").when(old.isNull() | (old == 0), "ADDED").when(old == new, "CONFIRMED").otherwise("UNDER_REVIEW")


def apply_overlays(base: DataFrame, overlays: DataFrame, key: str) -> DataFrame:
    """base (key, value) after overlays (key, kind ADD / AMEND / SUPERSEDE, value, seq, active), in order.

    ADD and SUPERSEDE set the value, AMEND sets it only where the row exists by then; kind RETIRE does nothing.
    The last of what applies holds.  Inactive overlays never apply; applying twice changes nothing.
    """
    live = overlays.where(F.col("active") & F.col("kind").isin("ADD", "AMEND", "SUPERSEDE"))
    first_made = live.where("kind != 'AMEND'").groupBy(key).agg(F.min("seq").alias("made"))
    known = base.select(key, F.lit(-1).cast("long").alias("made")).unionByName(first_made).groupBy(key).agg(F.min("made").alias("made"))
    fits = live.join(known, key).where((F.col("kind") != "AMEND") | (F.col("seq") > F.col("made")))
    last = fits.groupBy(key).agg(F.max_by("value", "seq").alias("new"), F.count("*").alias("n_applied"), F.bool_or(F.col("kind") == "SUPERSEDE").alias("superseded"))
    return base.join(last, key, "full").select(
        key, F.when(F.col("n_applied").isNotNull(), F.col("new")).otherwise(F.col("value")).alias("value"), F.coalesce("n_applied", F.lit(0)).alias("n_applied"), F.coalesce("superseded", F.lit(False)).alias("superseded")
    )


def apply_revisions(base: DataFrame, revisions: DataFrame, key: str) -> DataFrame:
    """base (key, value) after revisions (key, kind ADD / AMEND / RETIRE, value, seq) in order; what is retired is gone.

    AMEND needs a row that stands; after a RETIRE only an ADD brings one back.
    """
    every = base.select(key, "value", F.lit(-1).cast("long").alias("seq"), F.lit("ADD").alias("kind")).unionByName(revisions.select(key, "value", "seq", "kind"))
    retired = F.max(F.when(F.col("kind") == "RETIRE", F.col("seq"))).over(Window.partitionBy(key))
    since = every.withColumn("_gone", retired).where(F.col("_gone").isNull() | (F.col("seq") > F.col("_gone")))
    made = since.withColumn("_made", F.min(F.when(F.col("kind") == "ADD", F.col("seq"))).over(Window.partitionBy(key)))
    return made.where((F.col("seq") >= F.col("_made")) & (F.col("kind") != "RETIRE")).groupBy(key).agg(F.max_by("value", "seq").alias("value"), F.count("*").alias("n_applied"))


#: States of a field or section, the weakest first.
STATES = ("INFRASTRUCTURE_FAILURE", "EXTRACTION_FAILED", "NEEDS_REVIEW", "SOURCE_NOT_FOUND_AFTER_SEARCH", "NOT_YET_PUBLISHED", "NOT_APPLICABLE", "VERIFIED_AVAILABLE")


def weakest(sections: DataFrame, keys: list[str]) -> DataFrame:
    """Of each section (keys, field, state) the state of its weakest field, and how many of its fields are verified."""
    rank = F.create_map(*[F.lit(x) for i, s in enumerate(STATES) for x in (s, i)])
    return sections.groupBy(*keys).agg(F.min_by("state", rank[F.col("state")]).alias("state"), F.count_if(F.col("state") == STATES[-1]).alias("verified"), F.count("*").alias("fields"))


def gate(records: DataFrame, key: str, **blockers: Column) -> DataFrame:
    """PASS where nothing blocks a record; else BLOCK, with what does, in order."""
    told = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in blockers.items()]))
    return records.select(key, F.when(F.size(told) == 0, "PASS").otherwise("BLOCK").alias("decision"), F.array_join(told, ",").alias("blockers"))


def fact_state(flagged: Column, superseded: Column, official: Column, url: Column, page: Column, quote: Column, claim: Column) -> Column:
    """How far a fact is verified by its provenance: only a quote that states the claim verifies it."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    web = F.coalesce(url.rlike("^https?://"), F.lit(False))
    return (
        F.when(~web & blank(quote), "UNVERIFIED").when(flagged, "UNSUPPORTED").when(superseded, "SUPERSEDED").when(~official, "UNDER_VERIFICATION")
        .when(~web | (page.isNull() & blank(quote)), "UNVERIFIED").when(F.coalesce(F.contains(quote, claim), F.lit(False)), "VERIFIED").otherwise("UNSUPPORTED")
    )


def reviewed(fields: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """fields (keys, status, cited) after a person's decisions (keys, decision, reviewer).

    A decision without a reviewer is none.  WITHHOLD leaves a gap that no later approval fills; APPROVE holds for a
    cited reading that was found or is for review.
    """
    signed = reviews.where(F.coalesce(F.trim("reviewer"), F.lit("")) != "")
    said = signed.groupBy(*keys).agg(F.count_if(F.col("decision") == "WITHHOLD").alias("_no"), F.count_if(F.col("decision") == "APPROVE").alias("_yes"))
    can = F.col("cited") & F.col("status").isin("NEEDS_REVIEW", "FOUND")
    status = F.when(F.col("_no") > 0, "NOT_EXTRACTED").when((F.col("_yes") > 0) & can, "FOUND").otherwise(F.col("status"))
    return fields.join(said, keys, "left").select(*keys, status.alias("status"))
