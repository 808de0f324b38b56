"""Composite scores and ladders as native columns. Constants are fixed values of the score definitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight and base threat of a competitive class.
CLASS_WEIGHT = {"C1": 3, "C2": 2, "A1": 2, "T1": 1}
CLASS_THREAT = {"C1": 55, "C2": 30, "T1": 10}
DEFAULT_THREAT = 15


def lookup(c: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def ratio(n: Column, d: Column, places: int = 4) -> Column:
    """n / d, null where nothing is counted below the line."""
    return F.when(d != 0, F.round(n / d, places))


def review_priority(klass: Column, impact: Column, confidence: Column) -> Column:
    """Class weight times impact times uncertainty; unknown confidence counts one and a half."""
    doubt = F.when(confidence.isNull(), 1.5).otherwise(1 + (1 - confidence))
    return F.round(lookup(klass, CLASS_WEIGHT, 1) * impact * doubt, 3)


def confidence_score(validated: Column, total: Column, verbatim: Column, cited: Column, published: Column, dated: Column, verified: Column) -> Column:
    share = lambda n, d: F.coalesce(n / F.nullif(d, F.lit(0)), F.lit(0.0))
    score = 100 * (0.35 * share(validated, total) + 0.25 * share(verbatim, cited) + 0.25 * share(published, dated) + 0.15 * verified.cast("double"))
    return F.when(validated > 0, F.round(clamp(score), 1))


def threat_score(klass: Column, facts: Column, recent: Column, active: Column, reference: Column, periods: Column) -> Column:
    """Recent facts count only if there are several periods: else what is new can't be told from what is seen first."""
    velocity = F.when(periods > 1, F.least(F.lit(20.0), 4.0 * recent)).otherwise(0.0)
    score = lookup(klass, CLASS_THREAT, DEFAULT_THREAT) + F.least(F.lit(25.0), 1.5 * facts) + velocity - F.when(active, 0).otherwise(15)
    return F.when(reference, F.lit(0.0)).otherwise(F.round(clamp(score), 1))


def intensity_score(existing: Column, radar: Column, actors: Column, production: Column, total: Column) -> Column:
    part = lambda n, top: F.least(F.lit(1.0), n / F.lit(float(top)))
    share = F.coalesce(production / F.nullif(total, F.lit(0)), F.lit(0.0))
    return F.round(clamp(100 * (0.35 * part(existing, 8) + 0.15 * part(radar, 8) + 0.25 * part(actors, 5) + 0.25 * share)), 1)


def freshness(days: Column) -> Column:
    """Step function of completed days; unknown is least."""
    return F.when(days.isNull(), 0.3).when(days <= 30, 1.0).when(days <= 90, 0.85).when(days <= 180, 0.6).otherwise(0.35)


def intensity_level(score: Column) -> Column:
    return F.when(score >= 55, "high").when(score >= 25, "medium").otherwise("low")


def coverage_level(n: Column) -> Column:
    return F.when(n >= 10, "good").when(n >= 1, "partial").otherwise("weak")


def crawl_decision(priority: Column, documents: Column, blocks: Column, errors: Column, sources: Column, unchanged: Column) -> tuple[Column, Column]:
    """(strategy, anomaly) of a visit: adaptive for priority actors and where nothing was read or half of the sources failed.

    Pages that answer "unchanged" are healthy, though they give no document.
    """
    anomaly = (documents + unchanged == 0) | ((unchanged == 0) & (blocks == 0)) | (errors >= F.greatest(F.lit(1), F.floor(sources / 2)))
    return F.when(priority | anomaly, "adaptive").otherwise("generic"), anomaly
