"""Grouping of name variants under a canonical name, and merging of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.config import Groups
from placeloom.functions.text import or_empty, split_tags
from placeloom.operators import patterns
from placeloom.operators.itinerary import contained


def shortest_substring(names: DataFrame, column: str = "name", shards: int = patterns.SHARDS) -> DataFrame:
    """name, canonical: the shortest name of the table that is a substring of it (itself at least), ties by name.

    Instead of comparing all pairs, every name is scanned once by an automaton of them all; beyond
    ``shards`` automata names look up their own substrings by an equi-join.
    """
    vocab = names.select(F.col(column).alias("name")).filter("name <> ''").distinct()
    hits = contained(vocab.select("name", F.col("name").alias("text")).withColumnRenamed("name", "whole"), vocab, "whole", shards=shards)
    return hits.groupBy(F.col("whole").alias("name")).agg(F.min_by("name", F.struct(F.length("name"), F.col("name"))).alias("canonical"))


def canonical_map(names: DataFrame, groups: Groups = Groups(), column: str = "name") -> DataFrame:
    """name, canonical: itself if it must not merge, its manual group, else its shortest substring's group or name."""
    auto = shortest_substring(names, column)
    manual = groups.canonical_of()
    chain = F.create_map(*(F.lit(x) for kv in manual.items() for x in kv)) if manual else None
    own = F.try_element_at(chain, F.col("name")) if manual else F.lit(None).cast("string")
    after = F.coalesce(F.try_element_at(chain, F.col("canonical")), F.col("canonical")) if manual else F.col("canonical")
    keep = F.col("name").isin(*groups.no_merge) if groups.no_merge else F.lit(False)
    return auto.select("name", F.when(keep, F.col("name")).when(own.isNotNull(), own).otherwise(after).alias("canonical"))


def merge_groups(pois: DataFrame, canon: DataFrame, order: str = "ord") -> DataFrame:
    """One row per canonical name, from rows with name, rating, description, tags, behaviors and an order.

    The row of the best rating, then the longest description, then the first stands for the group;
    the rating is the group's best, aliases are the other names, tags and behaviors are united in
    order. ``position`` is where the group was first seen. Rows without a name are dropped. Only
    distinct names and tags of a group are brought together, after they have been combined on the
    map side: a group of a third of all rows under a few names is no burden, one of that many
    different names brings all of them into one row.
    """
    rows = pois.filter(or_empty(F.col("name")) != "").join(canon, "name")
    own = [c for c in pois.columns if c not in ("tags", "behaviors", "rating")]
    best = F.struct("rating", F.length(or_empty(F.col("description"))), -F.col(order))
    merged = rows.groupBy("canonical").agg(F.max_by(F.struct(*own), best).alias("_rep"), F.max("rating").alias("rating"), F.min(order).alias("position"))

    def in_order(values: DataFrame, into: str) -> DataFrame:
        """canonical and the array of its distinct values (canonical, at, x), first seen first."""
        first = values.groupBy("canonical", "x").agg(F.min("at").alias("at"))
        return first.groupBy("canonical").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda v: v["x"]).alias(into))

    names = rows.filter(F.col("name") != F.col("canonical")).select("canonical", F.struct(F.col(order), F.lit(0)).alias("at"), F.col("name").alias("x"))
    merged = merged.join(in_order(names, "aliases"), "canonical", "left")
    for c in ("tags", "behaviors"):
        each = rows.select("canonical", order, F.posexplode(split_tags(F.col(c))).alias("_i", "x"))
        merged = merged.join(in_order(each.select("canonical", F.struct(order, "_i").alias("at"), "x"), c), "canonical", "left")
    filled = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    return merged.select("_rep.*", "rating", F.col("canonical").alias("group"), filled("aliases"), filled("tags"), filled("behaviors"), "position")


def attractions(df: DataFrame, column: str = "is_attraction") -> DataFrame:
    """Rows that are attractions; unknown counts as yes."""
    return df.filter(F.coalesce(F.col(column), F.lit(True)))
