"""Question papers and their answer keys as rows: questions by a run of numbers that must go on by one, keys aligned to them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from factloom.functions.text import squash

_NUMBER = r"^\s*(?:Q(?:uestion)?\.?\s*(?:No\.?\s*)?)?([0-9]{1,3})\s*[.):]\s+"
_OPTION = r"(?:^|\s)\(?([A-Ea-e])[).]\s+(.*?)(?=\s\(?[A-Ea-e][).]\s|\z)"
_ANSWER = r"\b([0-9]{1,3})\s*[-.:)=]\s*\(?([A-Ea-e*])\b\)?|\b([0-9]{1,3})\s*[-.:)=]\s*(\*)"


@F.pandas_udf(ArrayType(BooleanType()))
def _in_run(numbers: pd.Series) -> pd.Series:
    """Whether each number goes on with the run 1, 2, 3, ...: it is one more than the last that did."""

    def run(own) -> list[bool]:
        last, out = 0, []
        for n in own:
            out.append(n is not None and n == n and int(n) == last + 1)
            last += out[-1]
        return out

    return numbers.map(lambda own: None if own is None else run(own))


def questions(papers: DataFrame, paper: str, text: str) -> DataFrame:
    """paper, n, question, options (label, text), and in_run of each numbered entry of each paper.

    An entry that does not go on with the run (a number printed twice, left out or in a question's own list) is no
    question of its own: it is kept as a row with in_run false, and its lines belong to the question before it.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    own = papers.select(F.col(paper), lines.alias("_l")).withColumn("_n", F.transform("_l", lambda x: F.nullif(F.regexp_extract(x, _NUMBER, 1), F.lit("")).cast("int")))
    own = own.withColumn("_run", _in_run("_n"))
    at = F.filter(F.sequence(F.lit(1), F.size("_l")), lambda i: F.get("_run", i - 1))
    own = own.withColumn("_at", F.when(F.size("_l") > 0, at))

    def entry(i: Column, k: Column) -> Column:
        upto = F.coalesce(F.get("_at", k + 1), F.size("_l") + 1)
        whole = F.array_join(F.slice("_l", i, upto - i), "\n")
        return F.struct(F.get("_n", i - 1).alias("n"), F.regexp_replace(whole, _NUMBER, "").alias("body"), F.lit(True).alias("in_run"))

    stray = F.transform(F.filter(F.sequence(F.lit(0), F.size("_l") - 1), lambda i: F.get("_n", i).isNotNull() & ~F.get("_run", i)), lambda i: F.struct(F.get("_n", i).alias("n"), F.regexp_replace(F.get("_l", i), _NUMBER, "").alias("body"), F.lit(False).alias("in_run")))
    rows = own.select(paper, F.explode(F.concat(F.transform("_at", entry), stray)).alias("x")).select(paper, "x.*")
    flat = squash(F.col("body"))
    labels, said = F.regexp_extract_all(flat, F.lit(_OPTION), F.lit(1)), F.regexp_extract_all(flat, F.lit(_OPTION), F.lit(2))
    options = F.zip_with(labels, said, lambda a, b: F.struct(F.upper(a).alias("label"), b.alias("text")))
    asked = squash(F.regexp_extract(flat, r"(?s)^(.*?)(?:(?:^|\s)\(?[Aa][).]\s|\z)", 1))
    return rows.select(paper, "n", asked.alias("question"), options.alias("options"), "in_run")


def answers(keys: DataFrame, paper: str, text: str) -> DataFrame:
    """paper, n and answer (a label; * where the question is withdrawn) of each entry of each key; an entry printed twice with two answers has none."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(_ANSWER), F.lit(0))
    rows = keys.select(F.col(paper), F.explode(found).alias("x")).select(paper, F.regexp_extract("x", "[0-9]+", 0).cast("int").alias("n"), F.upper(F.regexp_extract("x", r"[A-Ea-e*]", 0)).alias("a"))
    return rows.groupBy(paper, "n").agg(F.when(F.min("a") == F.max("a"), F.min("a")).alias("answer"), F.count("*").alias("stated"))


def aligned(asked: DataFrame, told: DataFrame, paper: str, options: int = 4) -> DataFrame:
    """paper, n, options (how many), answer and state of each question and key entry.

    ANSWERED, WITHDRAWN (*), NO_KEY, KEY_ONLY (an answer without a question), HELD where a number breaks the run, the
    options are not as many as they should be or stand twice, or the key's answer is none of them.
    """
    labels = F.transform("options", lambda o: o["label"])
    q = asked.select(paper, "n", "in_run", labels.alias("labels"))
    both = q.join(told.withColumnRenamed("n", "_n").withColumnRenamed(paper, "_p"), (F.col(paper) == F.col("_p")) & (F.col("n") == F.col("_n")), "full")
    whole = (F.size("labels") == options) & (F.size(F.array_distinct("labels")) == options)
    state = (
        F.when(F.col("n").isNull(), "KEY_ONLY").when(~F.col("in_run") | ~whole, "HELD").when(F.col("_n").isNull(), "NO_KEY")
        .when(F.col("answer") == "*", "WITHDRAWN").when(F.array_contains("labels", F.col("answer")), "ANSWERED").otherwise("HELD")
    )
    return both.select(F.coalesce(paper, "_p").alias(paper), F.coalesce("n", "_n").alias("n"), F.when(F.col("n").isNotNull(), F.size("labels")).alias("options"), "answer", state.alias("state"))
