"""Fund names given with misspellings (B1): nearest listed names, found exactly.

Names within ``max_distance`` edits of a given one are found through an inverted
index of q-grams. An edit changes at most ``q`` of a name's positioned q-grams, so of
two names within ``d`` edits the ``q * d + 1`` rarest q-grams of either hold one that
both have, at places at most ``d`` apart: only these rare q-grams are indexed, and the
common ones never meet. Names too short to have more than ``q * d`` q-grams are found by
the strings that up to ``d`` deletions leave, of which such names share one. What is
found is verified by ``levenshtein``, so the result is that of comparing all pairs.

Names are compared as they are but for case and outer blanks. A given name is
``exact``, ``corrected`` (one nearest listed name), ``ambiguous`` (several equally
near) or ``unknown``. All given names come out; null ones are unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Q = 2
MAX_DISTANCE = 2


def _normal(name: str) -> Column:
    return F.lower(F.trim(F.col(name)))


def _grams(text: Column, q: int) -> Column:
    """The q-grams of the padded text, with their places."""
    padded = F.concat(F.lit("\x01" * (q - 1)), text, F.lit("\x02" * (q - 1)))
    places = F.sequence(F.lit(1), F.length(padded) - q + 1)
    return F.transform(places, lambda i: F.struct(F.substring(padded, i, F.lit(q)).alias("gram"), i.alias("place")))


def _rare(texts: DataFrame, frequency: DataFrame, most: int, q: int) -> DataFrame:
    """The ``most`` rarest q-grams of each ``text``: of one frequency by name and place."""
    grams = texts.select("text", F.inline(_grams(F.col("text"), q))).join(frequency, "gram")
    rank = F.row_number().over(Window.partitionBy("text").orderBy("n", "gram", "place"))  # a name's own q-grams
    return grams.withColumn("rank", rank).filter(F.col("rank") <= most).select("text", "gram", "place")


def _shortened(texts: DataFrame, deletions: int) -> DataFrame:
    """``text`` and every string that up to ``deletions`` deletions leave of it."""
    out = texts.select("text", F.col("text").alias("left"))
    for _ in range(deletions):
        places = F.sequence(F.lit(1), F.length("left"))
        cut = F.transform(places, lambda i: F.concat(F.substring("left", F.lit(1), i - 1), F.substring("left", i + 1, F.length("left"))))
        out = out.select("text", F.explode(F.concat(F.array("left"), F.when(F.length("left") > 0, cut).otherwise(F.array().cast("array<string>")))).alias("left")).distinct()
    return out


def near_names(given: DataFrame, listed: DataFrame, max_distance: int = MAX_DISTANCE, q: int = Q) -> DataFrame:
    """Pairs ``given``, ``listed``, ``distance`` of normal forms (``text`` columns,
    distinct) within ``max_distance`` edits."""
    most = q * max_distance + 1
    frequency = given.union(listed).select(F.inline(_grams(F.col("text"), q))).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    a = _rare(given, frequency, most, q).withColumnsRenamed({"text": "given", "place": "i"})
    b = _rare(listed, frequency, most, q).withColumnsRenamed({"text": "listed", "place": "j"})
    close = F.abs(F.col("i") - F.col("j")) <= max_distance
    near_size = F.abs(F.length("given") - F.length("listed")) <= max_distance
    pairs = a.join(b, "gram").filter(close & near_size).select("given", "listed")
    # a text of n characters has n + q - 1 q-grams; one with q * d or fewer shares none for sure
    short = F.length("text") + q - 1 <= q * max_distance + max_distance
    left = _shortened(given.filter(short), max_distance).withColumnRenamed("text", "given")
    right = _shortened(listed.filter(short), max_distance).withColumnRenamed("text", "listed")
    both = pairs.union(left.join(right, "left").select("given", "listed")).distinct()
    found = both.withColumn("distance", F.levenshtein("given", "listed", max_distance))
    return found.filter(F.col("distance") >= 0)


def resolve_names(given: DataFrame, schemes: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row a distinct given ``scheme_name``: ``status``, and where there is one
    nearest listed name its ``matched_name`` and ``scheme_code`` (the smallest of the
    schemes of that name), ``distance`` and ``n_candidates`` (nearest listed names)."""
    asked = given.select("scheme_name").distinct().withColumn("text", _normal("scheme_name"))
    known = schemes.filter("scheme_name IS NOT NULL").withColumn("text", _normal("scheme_name"))
    known = known.groupBy("text").agg(F.min(F.struct("scheme_code", "scheme_name")).alias("s"))
    pairs = near_names(asked.filter("text IS NOT NULL").select("text").distinct(), known.select("text"), max_distance)
    best = pairs.groupBy("given").agg(F.min("distance").alias("distance"))
    nearest = pairs.join(best, ["given", "distance"]).groupBy("given", "distance").agg(F.count(F.lit(1)).alias("n_candidates"), F.min("listed").alias("listed"))
    nearest = nearest.join(known.withColumnRenamed("text", "listed"), "listed").withColumnRenamed("given", "text")
    one = F.col("n_candidates") == 1
    status = F.when(F.col("n_candidates").isNull(), "unknown").when(~one, "ambiguous").when(F.col("distance") == 0, "exact").otherwise("corrected")
    return asked.join(nearest, "text", "left").select(
        "scheme_name",
        status.alias("status"),
        F.when(one, F.col("s.scheme_code")).alias("scheme_code"),
        F.when(one, F.col("s.scheme_name")).alias("matched_name"),
        "distance",
        F.coalesce("n_candidates", F.lit(0)).cast("bigint").alias("n_candidates"),
    )


def positions_by_name(positions: DataFrame, schemes: DataFrame, max_distance: int = MAX_DISTANCE) -> tuple[DataFrame, DataFrame]:
    """(positions with the ``scheme_code`` of their name, positions whose name is
    ambiguous or unknown, with the ``status``). No position is lost: the two hold
    every row of ``positions`` between them."""
    resolved = resolve_names(positions, schemes, max_distance).withColumnRenamed("scheme_name", "_name")
    joined = positions.join(resolved.select("_name", "status", "scheme_code"), F.col("scheme_name").eqNullSafe(F.col("_name")), "left").drop("_name")
    found = F.col("status").isin("exact", "corrected")
    return joined.filter(found).drop("status", "scheme_name"), joined.filter(~found).drop("scheme_code")
