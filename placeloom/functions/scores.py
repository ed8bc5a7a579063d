"""Scores of places for a request, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeloom.config import CROWD_WEIGHTS, DEFAULT_STYLE, RECALL_A_DAY, RECALL_LEAST, RECALL_MOST, STYLES, Style


def recall_count(days: Column) -> Column:
    """Places to recall for a trip of so many days."""
    return F.least(F.greatest(F.lit(RECALL_LEAST), days * RECALL_A_DAY), F.lit(RECALL_MOST))


def rating_norm(rating: Column) -> Column:
    """Rating over 5, at most 1; 0.6 where there is none."""
    return F.when(rating.isNull() | (rating < 0), 0.6).otherwise(F.least(rating / 5, F.lit(1.0)))


def interest_match(tags: Column, interests: Column) -> Column:
    """Share of the interests that the tags meet, tags counted as often as they occur; 0.5 without interests."""
    hits = F.size(F.filter(tags, lambda t: F.array_contains(interests, t)))
    return F.when(F.size(interests) == 0, 0.5).when(F.size(tags) == 0, 0.0).otherwise(F.least(hits / F.size(interests), F.lit(1.0)))


def crowd_map(weights: Mapping[str, Mapping[str, float]] = CROWD_WEIGHTS) -> Column:
    """companion -> (behaviour -> weight)."""
    inner = lambda w: F.create_map(*(F.lit(x) for kv in w.items() for x in kv))
    return F.create_map(*(x for k, w in weights.items() for x in (F.lit(k), inner(w))))


def behavior_norm(behaviors: Column, companion: Column, weights: Mapping[str, Mapping[str, float]] = CROWD_WEIGHTS) -> Column:
    """How well behaviours suit a companion: 0.7 max + 0.3 mean of the weights met, over the companion's largest."""
    own = F.try_element_at(crowd_map(weights), companion)
    met = F.filter(F.transform(behaviors, lambda b: F.try_element_at(own, b)), lambda w: w.isNotNull())
    best = F.array_max(F.map_values(own))
    mean = F.aggregate(met, F.lit(0.0), lambda s, w: s + w) / F.size(met)
    score = (F.lit(0.7) * F.array_max(met) + F.lit(0.3) * mean) / best
    return F.when(own.isNull() | (F.size(met) <= 0), 0.0).otherwise(F.least(score, F.lit(1.0)))


def level_norm(level: Column) -> Column:
    return F.when(level.isin("5A", "4A"), 1.0).otherwise(0.0)


def style_weight(style: Column, term: str, styles: Mapping[str, Style] = STYLES, default: str = DEFAULT_STYLE) -> Column:
    """A style's weight or target; an unknown style counts as the default one."""
    value = F.lit(getattr(styles[default], term))
    for name, s in styles.items():
        value = F.when(style == name, F.lit(getattr(s, term))).otherwise(value)
    return value


def md5_uniform(key: Column) -> Column:
    """A number from 0 to 1 out of a text's digest, the same in any engine."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def base_score(style: Column, rating: Column, interest: Column, draw: Column, core: Column, behavior: Column, level: Column, styles: Mapping[str, Style] = STYLES, default: str = DEFAULT_STYLE) -> Column:
    """The weighted sum of six terms; ``core`` is a boolean, the others lie between 0 and 1."""
    w = lambda term: style_weight(style, term, styles, default)
    return w("rating") * rating + w("interest") * interest + w("random") * draw + w("core") * core.cast("double") + w("behavior") * behavior + w("level") * level


def distance_factor(km: Column, core: Column) -> Column:
    """Penalty by the distance to the nearest stop picked (null: none yet); a core spot suffers half of it."""
    plain = F.when(km < 0.5, 0.1).when(km < 1.5, 0.6).when(km < 2.0, 0.8).otherwise(1.0)
    return F.when(km.isNull(), 1.0).when(core, F.lit(1.0) - (F.lit(1.0) - plain) / 2).otherwise(plain)
