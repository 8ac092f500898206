"""Arithmetic on logits and log-probabilities that are given as arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.text import bound

IGNORED = -100


def _log_total(logits: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use`` of the values as doubles and of ln(sum(exp)); each is worked out once, so the work is linear."""

    def with_top(x: Column) -> Column:
        sums = bound(F.array_max(x), lambda top: top + F.ln(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))))
        return bound(sums, lambda total: use(x, total))

    return bound(F.transform(logits, lambda v: v.cast("double")), with_top)


def log_softmax_at(logits: Column, label: Column) -> Column:
    """Log-probability of index ``label``, with the maximum taken out first; null outside the array and for an empty one."""
    return _log_total(logits, lambda x, total: F.get(x, label) - total)


def softmax(logits: Column) -> Column:
    """Probabilities; they sum to one."""
    return _log_total(logits, lambda x, total: F.transform(x, lambda v: F.exp(v - total)))


def token_probabilities(logits: Column, ids: dict[str, int]) -> list[Column]:
    """The probability of each named token id, as a column of that name; null outside the array."""
    return [F.exp(log_softmax_at(logits, F.lit(i))).alias(name) for name, i in ids.items()]


def argmax(values: Column) -> Column:
    """First index of the maximum, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def token_logps(logits: Column, labels: Column, shift: bool = True) -> Column:
    """Per-token log-probability of the labels, each predicted one position before (``shift``) or at its own.

    Ignored positions hold the value of label 0, unmasked.
    """
    n = F.least(F.size(logits), F.size(labels)) - (1 if shift else 0)
    used = F.slice(labels, F.lit(2 if shift else 1), F.greatest(n, F.lit(0)))
    return F.zip_with(F.slice(logits, F.lit(1), F.greatest(n, F.lit(0))), used, lambda v, k: log_softmax_at(v, F.when(k == IGNORED, F.lit(0)).otherwise(k)))


def masked_sums(logps: Column, labels: Column) -> list[Column]:
    """Sum over the positions that count, and mean; the mean of none is null."""
    kept = F.filter(F.arrays_zip(logps.alias("p"), labels.alias("k")), lambda x: x["k"] != IGNORED)
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["p"])
    return [total.alias("logp_sum"), F.try_divide(total, F.size(kept)).alias("logp_mean")]


def sequence_logp(total: Column, mean: Column, weighted: Column | None = None, *, use_average: bool = False, token_weighted: bool = False) -> Column:
    """Which log-probability of a sequence counts: the weighted one if ``token_weighted``, else the mean or the sum."""
    if token_weighted:
        if weighted is None:
            raise ValueError("token weights need the weighted log-probability")
        return weighted
    return mean if use_average else total


def weighted_logp(logps: Column, weights: Column, mask: Column, average: bool = False) -> Column:
    """Sum of log-probability, weight and mask; divided by that of weight and mask if ``average``."""
    both = F.zip_with(weights, mask, lambda w, m: w.cast("double") * m.cast("double"))
    total = F.aggregate(F.zip_with(logps, both, lambda p, w: p.cast("double") * w), F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(total, F.aggregate(both, F.lit(0.0), lambda a, x: a + x)) if average else total


def softplus(x: Column) -> Column:
    """ln(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def dpo_terms(policy_win: Column, policy_lose: Column, ref_win: Column, ref_lose: Column, beta: float, reference_free: bool = False) -> list[Column]:
    """Loss and both rewards of a preference pair; ``reference_free`` leaves the reference out of the loss only."""
    ratio = (policy_win - policy_lose) - (F.lit(0.0) if reference_free else ref_win - ref_lose)
    return [softplus(-F.lit(beta) * ratio).alias("loss"), (F.lit(beta) * (policy_win - ref_win)).alias("reward_win"), (F.lit(beta) * (policy_lose - ref_lose)).alias("reward_lose")]


def training_metrics(rows: DataFrame, dpo_weight: float = 1.0, sft_weight: float = 0.0) -> DataFrame:
    """Mean loss (mixed with the win log-probability), rewards, margin and accuracy of (loss, reward_win, reward_lose, logp_win)."""
    return rows.agg(
        (F.lit(dpo_weight) * F.avg("loss") - F.lit(sft_weight) * F.avg("logp_win")).alias("loss"),
        F.avg("reward_win").alias("reward_win"),
        F.avg("reward_lose").alias("reward_lose"),
        F.avg((F.col("reward_win") > F.col("reward_lose")).cast("int")).alias("accuracy"),
        F.avg(F.col("reward_win") - F.col("reward_lose")).alias("margin"),
    )


def pad_to(ids: Column, size: Column, pad: int, left: bool = False) -> Column:
    """Array padded to ``size`` on the right, or left; longer ones stay."""
    fill = F.array_repeat(F.lit(pad), F.greatest(size - F.size(ids), F.lit(0)))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def pad_batch(rows: DataFrame, ids: str, batch: str, pad: int, left: bool = False) -> DataFrame:
    """Adds ``padded``: the array filled up to the longest of its batch; null arrays stay null.  A batch is a group of bounded size."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    return rows.withColumn("padded", pad_to(F.col(ids), longest, pad, left))
