"""Retrieval quality: hit rate, reciprocal rank, noise; per case and averaged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_hit(names: Column, wanted: Column) -> Column:
    """Whether a wanted name is contained in one of the names."""
    return F.exists(names, lambda n: F.contains(n, wanted))


def _share(top: Column, wanted: Column, none: float) -> Column:
    met = F.size(F.filter(wanted, lambda w: is_hit(top, w)))
    return F.when(F.size(F.coalesce(wanted, F.array().cast("array<string>"))) == 0, none).otherwise(met / F.size(wanted))


def hit(top: Column, expected: Column) -> Column:
    """Share of the expected names met; 1 if none are expected."""
    return _share(top, expected, 1.0)


def noise(top: Column, forbidden: Column) -> Column:
    """Share of the forbidden names met; 0 if none are forbidden."""
    return _share(top, forbidden, 0.0)


def reciprocal_rank(top: Column, expected: Column) -> Column:
    """1 over the first rank whose name contains an expected one; 0 if there is none."""
    flags = F.transform(top, lambda n: F.exists(expected, lambda w: F.contains(n, w)))
    at = F.array_position(flags, F.lit(True))
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.lit(1.0) / at).otherwise(0.0)


def evaluate_cases(cases: DataFrame) -> DataFrame:
    """``cases`` (top_names, expected, must_not) with hit, rr, noise, missed and unexpected."""
    top = F.col("top_names")
    return cases.withColumns({
        "hit": hit(top, F.col("expected")), "rr": reciprocal_rank(top, F.col("expected")), "noise": noise(top, F.col("must_not")),
        "missed": F.filter("expected", lambda w: ~is_hit(top, w)), "unexpected": F.filter("must_not", lambda w: is_hit(top, w)),
    })


def aggregate(results: DataFrame) -> DataFrame:
    """type, difficulty, n, hit_rate, mrr, noise_rate: overall, by type and by difficulty, in one pass."""
    means = [F.count(F.lit(1)).alias("n"), F.avg("hit").alias("hit_rate"), F.avg("rr").alias("mrr"), F.avg("noise").alias("noise_rate")]
    level = F.grouping_id().alias("level")
    sets = results.groupingSets([[], [F.col("type")], [F.col("difficulty")]], "type", "difficulty").agg(level, *means)
    by = F.when(F.col("level") == 3, "overall").when(F.col("level") == 1, "type").otherwise("difficulty")
    return sets.select(by.alias("by"), F.coalesce(F.when(F.col("level") == 1, F.col("type")).when(F.col("level") == 2, F.col("difficulty")), F.lit("all")).alias("value"), "n", "hit_rate", "mrr", "noise_rate")


def worst_cases(results: DataFrame, n: int = 3) -> DataFrame:
    """kind, case_id, value: the lowest hits, and the highest noises above 0."""
    low = results.orderBy("hit", "case_id").limit(n).select(F.lit("hit").alias("kind"), "case_id", F.col("hit").alias("value"))
    high = results.filter("noise > 0").orderBy(F.desc("noise"), "case_id").limit(n).select(F.lit("noise").alias("kind"), "case_id", F.col("noise").alias("value"))
    return low.unionByName(high)


def report(results: DataFrame, top_k: int) -> DataFrame:
    """One row: the averages as JSON texts, and how many cases there are."""
    rounded = aggregate(results).select("by", "value", F.struct("n", *(F.round(c, 4).alias(c) for c in ("hit_rate", "mrr", "noise_rate"))).alias("m"))
    pick = lambda by: F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("by") == by, F.struct("value", "m"))))))
    return rounded.agg(F.lit(top_k).alias("top_k"), pick("overall").alias("overall"), pick("type").alias("by_type"), pick("difficulty").alias("by_difficulty"))
