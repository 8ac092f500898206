"""Benchmark results: positional and equi joins of answers, win rates, ratings, and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The categories of the comparison benchmark.
CATEGORIES = ["Attribute reasoning", "Coarse Perception", "Creative generation", "Fine-grained perception", "Mechanical logical reasoning", "OCR", "Relation reasoning", "Time series inference"]


def match_last(left: DataFrame, right: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Left join with one row a key of the right side: the last by ``pos``."""
    rest = [c for c in right.columns if c not in keys]
    last = right.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(pos)).alias("_r"))
    return left.join(last, keys, "left").select(*left.columns, *[F.col(f"_r.{c}").alias(f"right_{c}") for c in rest])


def zip_rows(left: DataFrame, right: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows at the same position; positions that one side lacks give no row."""
    return left.join(right, pos)


def win_totals(reviews: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Wins, losses, ties, their total and (win + tie / 2) / total of each group and, with nulls, of all rows together.

    Scores other than -1, 0 and 1, and null, count in none; a group without valid rows has a null score.
    """
    n = lambda v: F.coalesce(F.sum((F.col(score) == v).cast("bigint")), F.lit(0))
    out = reviews.rollup(*by).agg(n(-1).alias("win"), n(1).alias("loss"), n(0).alias("tie"))
    total = F.col("win") + F.col("loss") + F.col("tie")
    return out.withColumn("total", total).withColumn("win_rate", F.try_divide(F.col("win") + F.col("tie") / 2, total))


def by_category(reviews: DataFrame, kind: str = "type_name", score: str = "score") -> DataFrame:
    """Win totals of each of the fixed categories, those without rows included."""
    dim = reviews.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    got = reviews.where(F.col(score).isin(-1, 0, 1)).groupBy(F.col(kind).alias("category")).pivot(score, [-1, 0, 1]).count()
    joined = dim.join(got, "category", "left")
    return joined.select("category", *[F.coalesce(F.col(str(v)), F.lit(0)).alias(name) for v, name in ((-1, "win"), (1, "loss"), (0, "tie"))])


def model_totals(reviews: DataFrame, model: str = "modela", score: str = "score") -> DataFrame:
    """Wins and losses against each model A, with the sums of wins, losses, ties and of all over the categories as a check.

    Scores other than -1, 0 and 1, and null, count in none; a null model is one of its own.
    """
    n = lambda v: F.coalesce(F.sum((F.col(score) == v).cast("bigint")), F.lit(0))
    named = lambda v: F.coalesce(F.sum(((F.col(score) == v) & F.col("type_name").isin(CATEGORIES)).cast("bigint")), F.lit(0))
    out = reviews.groupBy(model).agg(n(1).alias("win"), n(-1).alias("loss"), n(0).alias("tie"), named(1).alias("win_check"), named(-1).alias("loss_check"), named(0).alias("tie_check"))
    return out.withColumn("all_check", F.col("win_check") + F.col("loss_check") + F.col("tie_check"))


def caption_summary(rates: DataFrame) -> DataFrame:
    """Rates times 100 and their harmonic means, from (model, step, chair_s_refine, chair_i, recall, n_object_captions); null without a base.

    object_f1 is of recall and the share of right objects, response_f1 of right captions and a third of the captions with objects.
    """
    right, recall, captions, some = 100 * (1 - F.col("chair_i")), 100 * F.col("recall"), 100 * (1 - F.col("chair_s_refine")), F.col("n_object_captions") / 3
    mean = lambda a, b: F.try_divide(2 * a * b, a + b)
    return rates.select("model", "step", (100 * F.col("chair_s_refine")).alias("response_hall"), (100 * F.col("chair_i")).alias("object_hall"), captions.alias("response_correct"), right.alias("object_correct"), recall.alias("object_recall"), mean(recall, right).alias("object_f1"), mean(some, captions).alias("response_f1"))


def match_answers(left: DataFrame, right: DataFrame, keys: list[str], pos: str, reverse: bool = False) -> DataFrame:
    """(keys, answer_a, answer_b): answers of model A (left, with ``answer``) beside the last ones of model B by ``pos``.

    ``reverse`` swaps the two where both are there; unmatched rows of A keep a null answer_b.
    """
    met = match_last(left, right.select(*keys, pos, "answer"), keys, pos)
    swap = F.col("right_answer").isNotNull() if reverse else F.lit(False)
    return met.select(*keys, F.when(swap, F.col("right_answer")).otherwise(F.col("answer")).alias("answer_a"), F.when(swap, F.col("answer")).otherwise(F.col("right_answer")).alias("answer_b"))


def served_by(response_model: Column, wanted: str) -> Column:
    """Whether a judge's response comes from the model asked for, whose name may go on with a version; false for null."""
    return F.coalesce(F.contains(response_model, F.lit(wanted)), F.lit(False))


def win_score(score: Column) -> Column:
    """Mean of (score + 1) / 2, an aggregate."""
    return F.avg((score + 1) / 2)


def rating_summary(rows: DataFrame, rating: Column, kind: Column) -> DataFrame:
    """Mean rating, share below 3, and informativeness (3 and more count less 3, of 3) of each kind and of all."""
    r = rows.select(rating.alias("r"), kind.alias("kind"))
    info = F.avg(F.when(F.col("r") >= 3, F.col("r") - 3).otherwise(F.col("r"))) / 3 * 100
    return r.rollup("kind").agg(F.count("*").alias("n"), F.avg("r").alias("mean_rating"), F.avg((F.col("r") < 3).cast("int")).alias("hall_rate"), info.alias("informativeness"))


def usage_totals(rows: DataFrame, usage: str, ok: str) -> DataFrame:
    """Token sums over all attempts and over the successful ones."""
    names = ["total_tokens", "prompt_tokens", "completion_tokens"]
    return rows.agg(*[F.sum(F.col(f"{usage}.{n}")).alias(n) for n in names], *[F.sum(F.when(F.col(ok), F.col(f"{usage}.{n}"))).alias(f"ok_{n}") for n in names])
