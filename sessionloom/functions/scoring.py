"""Session scores: significance, recency-weighted significance, triviality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import has_artifact


def closing_text() -> Column:
    return F.concat_ws(" ", F.coalesce("closing_user", F.lit("")), F.coalesce("closing_assistant", F.lit("")))


def significance(messages: Column, files: Column, closing: Column) -> Column:
    """Log-damped message volume, capped edits, a bonus for something shipped."""
    bonus = F.when(has_artifact(closing), F.lit(K.ARTIFACT_BONUS)).otherwise(F.lit(0.0))
    return F.log2(messages + 1) + F.lit(K.FILES_WEIGHT) * F.least(files, F.lit(K.FILES_CAP)) + bonus


def is_trivia(messages: Column, files: Column, closing: Column) -> Column:
    return (messages <= 2) & (files == 0) & ~has_artifact(closing)


def blended_score(score: Column, day: Column, now: str) -> Column:
    """Half the weight every week; an undated session sinks."""
    age_ms = F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(day.cast("timestamp"))
    age = F.coalesce(F.greatest(age_ms / F.lit(float(K.DAY_MS)), F.lit(0.0)), F.lit(K.UNDATED_AGE_DAYS))
    return score * F.pow(F.lit(0.5), age / F.lit(K.HALF_LIFE_DAYS))
