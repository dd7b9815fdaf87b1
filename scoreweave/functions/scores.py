"""Numbers: grades, confidences, quantizers. Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def effective_score(final: Column, ai: Column) -> Column:
    """The reviewed score, else the model's, else 0."""
    return F.coalesce(final, ai, F.lit(0.0))


def quantize_quarter(x: Column) -> Column:
    """To quarters, halves to the even quarter."""
    return F.bround(x * 4) / 4


def parse_decimal(text: Column, default: Column | None = None) -> Column:
    """A number written with a comma or a point; else the default."""
    value = F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")
    return value if default is None else F.coalesce(value, default)


def clamp_grade(text: Column) -> Column:
    """struct(score, invalid): the nearest of 0, .25, .5, .75, 1, ties to the lower; invalid unless equal.

    What is no finite number scores 0 and is invalid.
    """
    x = parse_decimal(text)
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.ceil(x * 4 - 0.5) / 4))
    return F.struct(F.when(finite, near).otherwise(0.0).alias("score"), F.when(finite, near != x).otherwise(True).alias("invalid"))


def clamp_unit(text: Column) -> Column:
    """A number cut to [0, 1]; null if it is none."""
    x = text.try_cast("double")
    return F.when(x.isNotNull(), F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))))


def int_or(text: Column, default: Column) -> Column:
    return F.coalesce(text.try_cast("int"), default)


def float_or(text: Column, default: Column) -> Column:
    return F.coalesce(text.try_cast("double"), default)


def normalize_confidence(text: Column) -> Column:
    """alta, media or baixa; anything unknown is baixa."""
    word = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(word.isin("alta", "media", "baixa"), word).when(word.isin("média", "medio", "médio"), "media").otherwise("baixa")


def needs_fallback(words: Column, confidence: Column) -> Column:
    """Fewer than three words, or a known confidence below 0.70."""
    return (words < 3) | F.coalesce(confidence < 0.70, F.lit(False))


def sheet_score(total: Column, questions: Column) -> Column:
    """The mean over the exam's questions, in quarters; 0 without questions."""
    return F.when(questions > 0, quantize_quarter(total / questions)).otherwise(0.0)
