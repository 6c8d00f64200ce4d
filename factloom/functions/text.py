"""Text functions as columns: spacing, sentences, figures, identifiers.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode, spelt so that every regular-expression engine reads it alike.
WHITE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def squash(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, WHITE, " "))


def trimmed(c: Column) -> Column:
    """Without white space at the ends; a text that has none there is not searched."""
    ends = F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1)))
    return F.when(ends.rlike(WHITE), F.regexp_replace(c, rf"^{WHITE}|{WHITE}\z", "")).otherwise(c)


def once(c: Column, read) -> Column:
    """read(c), where c is computed once however often it is read, in the steps of a transform too; there a column of an earlier select is not."""
    return F.get(F.transform(F.array(c), read), F.lit(0))


def in_blocks(c: Column, step: int, read) -> Column:
    """read(blocks) of a text's consecutive blocks of ``step`` characters; the text is cut once, however often blocks are read."""
    blocks = F.regexp_extract_all(c, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    return F.when(c.isNotNull(), F.get(F.transform(F.array(blocks), read), F.lit(0)))


def joined(blocks: Column, first: Column, last: int) -> Column:
    """The blocks from first on, ``last`` of them or as many as there are, as one text."""
    return F.concat(*[F.coalesce(F.get(blocks, first + i), F.lit("")) for i in range(last)])


def windows(c: Column, step: int = 160) -> Column:
    """Overlapping windows of a text, two steps wide, each (start, piece); a text up to that width has one."""

    def read(blocks: Column) -> Column:
        each = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(blocks) - 2))
        return F.transform(each, lambda i: F.struct((i * step).alias("start"), joined(blocks, i, 2).alias("piece")))

    return in_blocks(c, step, read)


def sentences(c: Column) -> Column:
    """Parts that end in a full stop, question or exclamation mark before white space."""
    parts = F.split(F.regexp_replace(c, r"([.!?])\s+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, squash), lambda s: s != "")


def figures(c: Column) -> Column:
    """Distinct groups of digits, thousands separators dropped, in order."""
    plain = F.regexp_replace(c, r"([0-9]),([0-9])", "$1$2")
    return F.array_distinct(F.regexp_extract_all(plain, F.lit(r"[0-9]+"), F.lit(0)))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+\z", "")


def acronym(c: Column) -> Column:
    words = F.filter(F.split(squash(c), " "), lambda w: w != "")
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def words(c: Column, least: int = 2) -> Column:
    """Distinct lower-case alphanumeric words of at least that many characters."""
    every = F.split(F.lower(c), r"[^a-z0-9]+")
    return F.array_distinct(F.filter(every, lambda w: F.length(w) >= least))


def cell_count(c: Column) -> Column:
    """A count cell: a dash is 0, blanks between digits go, sums are added; null if it holds anything else."""
    bare = F.regexp_replace(c, r"\s+", "")
    addends = F.split(bare, r"\+")
    total = F.aggregate(addends, F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x.try_cast("long"), F.lit(0)))
    return F.when(bare == "-", F.lit(0).cast("long")).when(bare.rlike(r"^[0-9]+(\+[0-9]+)*\z"), total)


def minutes(c: Column) -> Column:
    """Minutes of a duration such as ``2 hours 30 minutes``; null if none is stated."""

    def told(low: Column) -> Column:
        n = lambda unit: F.regexp_extract(low, r"([0-9]+)\s*" + unit, 1).try_cast("int")
        both = F.struct(n("h(?:ou)?rs?").alias("h"), n("min").alias("m"))
        read = once(both, lambda t: F.when(t["h"].isNotNull() | t["m"].isNotNull(), F.coalesce(t["h"], F.lit(0)) * 60 + F.coalesce(t["m"], F.lit(0))))
        return F.when(low.rlike(r"[0-9]\s*(?:h(?:ou)?r|min)"), read)

    return once(F.lower(c), told)


def name_score(a: Column, b: Column, common: tuple[str, ...] = (), one: float = 0.5, share: float = 0.4) -> Column:
    """How far two names (arrays of words) agree: 1 equal, 0 none shared, 0.9 (or ``one``, by one word alone) if one holds
    the other, else a part."""
    own = [F.array_except(x, F.array(*map(F.lit, common)).cast("array<string>")) for x in (a, b)]
    shared = F.size(F.array_intersect(*own))
    least, most = (f(F.size(own[0]), F.size(own[1])) for f in (F.least, F.greatest))
    return (
        F.when(shared == 0, F.lit(0.0))
        .when((shared == least) & (shared == most), F.lit(1.0))
        .when(shared == least, F.when(shared >= 2, F.lit(0.9)).otherwise(F.lit(one)))
        .otherwise(share * shared / most)
    )


def clock(c: Column) -> Column:
    """The first time of day as HH:MM: 24-hour, or 12-hour with am or pm; null if none is stated."""
    low = F.lower(c)
    part = lambda n: F.regexp_extract(low, r"\b([0-9]{1,2})[:.]([0-9]{2})(?:\s*(am|pm|a\.m\.|p\.m\.))?", n)
    h, m, half = part(1).try_cast("int"), part(2).try_cast("int"), F.substring(part(3), 1, 1)
    hour = F.when(half == "p", F.when(h < 12, h + 12).otherwise(h)).when((half == "a") & (h == 12), 0).otherwise(h)
    return F.when((hour <= 23) & (m <= 59), F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(m.cast("string"), 2, "0")))


def western(n: Column) -> Column:
    """A whole number with a comma before every three digits."""
    return F.format_number(n, 0)


def lakhs(n: Column) -> Column:
    """A whole number as it is grouped in India: the last three digits, then twos."""
    digits = n.cast("string")
    head, tail = F.substring(digits, F.lit(1), F.greatest(F.lit(0), F.length(digits) - 3)), F.right(digits, F.lit(3))
    even = F.when(F.length(head) % 2 == 1, F.concat(F.lit("0"), head)).otherwise(head)
    twos = F.array_join(F.regexp_extract_all(even, F.lit("([0-9]{2})"), F.lit(1)), ",")
    return F.when(head == "", tail).otherwise(F.concat(F.regexp_replace(twos, "^0", ""), F.lit(","), tail))


ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}


def number_of(c: Column) -> Column:
    """A number printed in figures or as a Roman numeral up to ten; null if it is neither."""
    roman = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    bare = F.lower(F.trim(c))
    return F.coalesce(F.when(bare.rlike("^[0-9]+$"), bare.try_cast("int")), F.when(bare.isin(*ROMAN), roman[bare]))


#: Words for a level of education, the highest last; the first pattern that fits counts.
LEVELS = (
    (r"\bbelow (class )?12", "BELOW_CLASS_12"), (r"final[- ]year|appearing|pursuing", "GRADUATION_APPEARING"), (r"\b(master|post[- ]?graduat|mba\b|phd\b)", "POST_GRADUATION"),
    (r"\b(bachelor|graduat|degree|bba\b|llb\b)", "GRADUATION"), (r"\b(12th|class 12|xii\b|intermediate)", "CLASS_12"), (r"\b(10th|class 10|matric)", "CLASS_10"),
)


def level(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, name in reversed(LEVELS):
        out = F.when(F.lower(c).rlike(pattern), name).otherwise(out)
    return out


CATEGORIES = {"GENERAL": ("general", "ur", "unreserved"), "OBC": ("obc", "bc"), "SC": ("sc",), "ST": ("st",), "EWS": ("ews",)}


def category_codes(label: Column) -> Column:
    """The codes of the categories that a printed label names, sorted."""
    parts = F.transform(F.split(F.lower(label), r"[,/()&]"), lambda p: F.trim(p))
    held = [F.when(F.arrays_overlap(parts, F.array(*map(F.lit, words))), F.lit(code)) for code, words in sorted(CATEGORIES.items())]
    return F.array_compact(F.array(*held))


def penalty(c: Column) -> Column:
    """Marks taken off for a wrong answer: 0 where none is stated to be, a figure or a fraction (four decimals), else null."""

    def told(low: Column) -> Column:
        flat = F.regexp_extract(low, r"(?:negative|deduct\w*|minus)[^0-9/]*([0-9]+\.[0-9]+)", 1).try_cast("double")
        top, bottom = (F.regexp_extract(low, r"(?:negative|deduct\w*|minus)[^0-9/]*([0-9]+)\s*/\s*([0-9]+)", i).try_cast("double") for i in (1, 2))
        held = F.when(low.rlike(r"no (?:negative|penalty)"), 0.0).when(~low.rlike("negative|deduct|minus"), F.lit(None)).otherwise(F.coalesce(flat, F.when(bottom > 0, F.round(top / bottom, 4))))
        return F.when(low.contains("negative") | low.contains("penalty") | low.contains("deduct") | low.contains("minus"), held)

    return once(F.lower(c), told)


def distinctive(c: Column, common: tuple[str, ...]) -> Column:
    """The words of a name that are not common to its kind, in order."""
    return F.array_except(F.filter(F.split(F.lower(squash(c)), " "), lambda w: w != ""), F.array(*map(F.lit, common)))
