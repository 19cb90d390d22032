"""Prompts, predictions and accuracies of an evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thinwell.functions.texts import extract_answer, prompt, strip

IMAGE_COLUMNS = tuple(f"image_{i}" for i in range(1, 8))


def sample_images(samples: DataFrame, columns: tuple[str, ...] = IMAGE_COLUMNS) -> Column:
    """The images of a sample that are not null, in the order of their columns."""
    return F.array_compact(F.array(*(F.col(c) for c in columns if c in samples.columns)))


def prompts(samples: DataFrame) -> DataFrame:
    """id, subject, gt, images (their number), prompt of every sample."""
    n = F.size(sample_images(samples))
    return samples.select("id", "subject", F.upper(strip(F.col("answer"))).alias("gt"), n.alias("images"), prompt(F.col("question"), F.col("options"), n).alias("prompt"))


def scored(answers: DataFrame) -> DataFrame:
    """`answers` (raw, gt, error) with pred and correct; both null for a row with an error."""
    pred = F.when(F.col("error").isNull(), extract_answer(F.col("raw")))
    return answers.withColumn("pred", pred).withColumn("correct", pred == F.col("gt"))


def percent(correct: Column, total: Column) -> Column:
    """Share in percent; 0 where there is nothing to count."""
    return F.coalesce(F.try_divide(100.0 * correct, total), F.lit(0.0))


def _right() -> Column:
    return F.count_if(F.col("error").isNull() & F.col("correct"))


def accuracy(predictions: DataFrame, *by: str) -> DataFrame:
    """by..., total (rows without an error), right, errors, accuracy; one row for an empty table where `by` is empty."""
    total = F.count_if(F.col("error").isNull())
    sums = predictions.groupBy(*by).agg(total.alias("total"), _right().alias("right"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    return sums.withColumn("accuracy", percent(F.col("right"), F.col("total")))


def accuracy_by_subject(predictions: DataFrame, *by: str) -> DataFrame:
    """The same for each subject, "unknown" where it is null, in the subjects' order; subjects with errors only have no row."""
    named = predictions.withColumn("subject", F.coalesce("subject", F.lit("unknown")))
    return accuracy(named, *by, "subject").where("total > 0").orderBy(*by, "subject")


def running_accuracy(predictions: DataFrame, run: str, order: list[str], every: int = 50) -> DataFrame:
    """run, seen, right, total, accuracy after each `every`-th row of a run, unless that row is an error."""
    window = Window.partitionBy(run).orderBy(*order)
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fine = F.col("error").isNull()
    rows = predictions.withColumn("seen", F.row_number().over(window)).withColumn("total", F.count_if(fine).over(so_far)).withColumn("right", F.count_if(fine & F.col("correct")).over(so_far))
    return rows.where(fine & (F.col("seen") % every == 0)).select(run, "seen", "right", "total", percent(F.col("right"), F.col("total")).alias("accuracy"))
