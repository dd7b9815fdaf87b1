"""First, last and numbered rows per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the largest order columns of each key: an aggregate, so a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the smallest order columns of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def first_answers(df: DataFrame, page: str, number: str, order: list[str]) -> DataFrame:
    """page, number, the other columns of each page's first answer to a question, kept, n_warnings and warning, by one aggregate.

    Answers without a positive number are dropped: their row is not kept, its other columns are null. What is dropped
    is counted with its warning, not repeated, so that a page with very many repeats is one row. warning is null where
    n_warnings is 0. The smallest order columns are first.
    """
    rest = [c for c in df.columns if c not in (page, number)]
    valid = F.col(number) > 0
    asked = df.withColumn(number, F.when(valid, F.col(number)))
    groups = asked.groupBy(page, number).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"), F.count("*").alias("_n"))
    kept, at = F.col(number).isNotNull(), F.coalesce(F.col(page).cast("string"), F.lit("?"))
    told = F.when(~kept, F.concat(F.lit("Questão sem número válido na página "), at, F.lit("."))).otherwise(F.concat(F.lit("Questão duplicada na leitura visual (Q"),
        F.col(number).cast("string"), F.lit(", página "), at, F.lit("); mantendo primeira ocorrência.")))
    dropped = F.col("_n") - kept.cast("int")
    return groups.select(page, number, *(F.when(kept, F.col(f"_row.`{c}`")).alias(c) for c in rest), kept.alias("kept"), dropped.alias("n_warnings"),
        F.when(dropped > 0, told).alias("warning"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str, start: int = 1) -> DataFrame:
    """Consecutive numbers within each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) + (start - 1))


def first_usable(responses: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, of responses (model_rank, model, ok, raw, error), the first that succeeded.

    fallback_used: its rank is above 0. With none, error joins all errors in rank order.
    """
    good = F.min_by(F.when(F.col("ok"), F.struct("model_rank", "model", "raw")), F.when(F.col("ok"), F.col("model_rank")))
    errors = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("ok"),
        F.struct("model_rank", F.coalesce("error", F.lit("")).alias("error"))))), lambda e: e["error"]), " | ")
    out = responses.groupBy(*keys).agg(good.alias("good"), errors.alias("errors"))
    return out.select(*keys, F.col("good.model").alias("model_used"), F.col("good.raw").alias("raw"),
        F.coalesce(F.col("good.model_rank") > 0, F.lit(False)).alias("fallback_used"), F.when(F.col("good").isNull(), F.col("errors")).alias("error"))
