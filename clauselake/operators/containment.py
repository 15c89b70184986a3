"""Which texts hold which terms of a dictionary, as an equi-join.

Each term is filed under one run of ``q`` characters that it has, the one that the fewest
terms share; a text that holds the term has that run. Pairs that meet on a run are then
held against each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _runs(text: Column, n: Column | int) -> Column:
    """The distinct runs of ``n`` characters, in one pass: a substring by its place is looked for from the text's start."""
    n = F.lit(n) if isinstance(n, int) else n
    pattern = F.concat(F.lit("(?s)(?=(.{"), n.cast("string"), F.lit("}))."))
    return F.array_distinct(F.regexp_extract_all(text, pattern, F.lit(1)))


def filed(terms: DataFrame, term: str, q: int = 2) -> DataFrame:
    """``terms`` with ``_run``, the rarest run of ``q`` characters of each (of all, where it is shorter); empty and null terms go."""
    own = terms.where(F.length(term) > 0)
    runs = own.select(F.col(term).alias("_term")).distinct().select("_term", F.explode(_runs(F.col("_term"), F.least(F.length("_term"), F.lit(q)))).alias("_run"))
    shared = runs.groupBy("_run").agg(F.count("*").alias("_shared"))
    rarest = runs.join(shared, "_run").groupBy("_term").agg(F.min_by("_run", F.struct("_shared", "_run")).alias("_run"))
    return own.join(rarest, F.col(term) == F.col("_term")).drop("_term")


def holding(texts: DataFrame, terms: DataFrame, text: str, term: str, q: int = 2) -> DataFrame:
    """Rows of ``texts`` with those of ``terms`` whose ``term`` their ``text`` contains; each such pair once.

    Runs go without their text, by its hash, and meet it again where a term is filed under
    one of them; so ``texts`` is read twice. The driver learns which lengths of runs there
    are, at most ``q`` numbers.
    """
    keyed = filed(terms, term, q)
    lengths = sorted(r[0] for r in terms.where(F.length(term) > 0).select(F.least(F.length(term), F.lit(q))).distinct().collect())
    runs = F.concat(F.array().cast("array<string>"), *[_runs(F.col(text), n) for n in lengths])
    met = texts.select(F.xxhash64(text).alias("_text"), F.explode(runs).alias("_run")).join(keyed.select("_run").distinct(), "_run", "left_semi").distinct()
    # Hashes that meet only bring more pairs, which the text itself decides.
    return texts.withColumn("_text", F.xxhash64(text)).join(met, "_text").join(keyed, "_run").where(F.contains(text, term)).drop("_run", "_text")
