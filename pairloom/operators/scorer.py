"""External models behind one interface, called on Arrow batches."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.text import facts_from_text


class Scorer(Protocol):
    """What a model must offer; it is made in each worker by a factory, never shipped."""

    def generate(self, prompts: list[str]) -> list[str]: ...

    def yes_no(self, prompts: list[str]) -> list[tuple[float, float, float, float]]: ...


class StubScorer:
    """A scorer whose answers are functions of the prompt."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [f"echo {p}" for p in prompts]

    def yes_no(self, prompts: list[str]) -> list[tuple[float, float, float, float]]:
        out = []
        for p in prompts:
            h = hashlib.sha256(p.encode()).digest()
            total = sum(h[:4]) or 1
            out.append(tuple(x / total for x in h[:4]))
        return out


class OtherModel(Exception):
    """A response from another model than the one asked for; such a try is repeated, at most ``FREE_TRIES`` times, without counting as a failure."""


FREE_TRIES = 100


def _tried(call, batch: list[str], attempts: int, wait: float, timeout: float | None = None) -> tuple[list, str | None]:
    """What the call returns for a batch, or nulls and the last error after so many failures; waits grow by a second each.

    A call that takes longer than ``timeout`` seconds has failed; its thread is left behind.
    """
    failed = free = 0
    error = None
    while failed < attempts and free < FREE_TRIES:
        try:
            if timeout is None:
                got = call(batch)
            else:
                pool = ThreadPoolExecutor(1)
                try:
                    got = pool.submit(call, batch).result(timeout)
                finally:
                    pool.shutdown(wait=False)
            if len(got) != len(batch):
                raise ValueError(f"{len(got)} results for {len(batch)} prompts")
            return got, None
        except OtherModel as e:
            free, error = free + 1, f"OtherModel: {e}"
        except Exception as e:
            failed, error = failed + 1, f"{type(e).__name__}: {e}"
            if failed < attempts and wait:
                time.sleep(wait + failed - 1)
    return [None] * len(batch), error


def generated(rows: DataFrame, prompt: str, factory, batch: int = 8, attempts: int = 3, wait: float = 0.0, timeout: float | None = None) -> DataFrame:
    """Adds ``output`` and ``error``; a batch that fails ``attempts`` times gives null outputs and its error.  Null prompts count as ''."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for f in frames:
            out, errors = [], []
            for at in range(0, len(f), batch):
                got, error = _tried(model.generate, f[prompt].iloc[at : at + batch].fillna("").tolist(), attempts, wait, timeout)
                out += got
                errors += [error] * len(got)
            yield f.assign(output=pd.Series(out, index=f.index, dtype=object), error=pd.Series(errors, index=f.index, dtype=object))

    schema = T.StructType([*rows.schema.fields, T.StructField("output", T.StringType()), T.StructField("error", T.StringType())])
    return rows.mapInPandas(run, schema)


def divided(rows: DataFrame, prompt: Column, key: str, factory, **options) -> DataFrame:
    """Adds ``raw_<key>``, the output for a prompt, and ``<key>``, the facts listed in it; a null output has a null list, and ``error`` says why."""
    out = generated(rows.withColumn("_prompt", prompt), "_prompt", factory, **options)
    return out.withColumnRenamed("output", f"raw_{key}").withColumn(key, facts_from_text(F.col(f"raw_{key}"))).drop("_prompt")


def facts_and_questions(answers: DataFrame, fact_prompt: Column, question_prompt: Callable[[Column], Column], factory, **options) -> DataFrame:
    """The two turns that divide an answer: its facts, then a question for each of them, with the raw texts of both.

    Rows whose first turn failed ask nothing further and keep null questions.
    """
    facts = divided(answers, fact_prompt, "facts", factory, **options).withColumnRenamed("error", "facts_error")
    return divided(facts, F.coalesce(question_prompt(F.col("facts")), F.lit("")), "changed_facts", factory, **options).withColumn("changed_facts", F.when(F.col("facts").isNotNull(), F.col("changed_facts")))


def yes_no_scores(rows: DataFrame, prompt: str, factory, batch: int = 8, attempts: int = 3, wait: float = 0.0, timeout: float | None = None) -> DataFrame:
    """Adds yes, yes_cap, no and no_cap, the probabilities of the four first tokens, and ``error``; a batch that fails has nulls."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for f in frames:
            out, errors = [], []
            for at in range(0, len(f), batch):
                got, error = _tried(model.yes_no, f[prompt].iloc[at : at + batch].fillna("").tolist(), attempts, wait, timeout)
                out += got
                errors += [error] * len(got)
            four = {n: pd.Series([None if x is None else x[k] for x in out], index=f.index, dtype="float64") for k, n in enumerate(("yes", "yes_cap", "no", "no_cap"))}
            yield f.assign(**four, error=pd.Series(errors, index=f.index, dtype=object))

    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, T.DoubleType()) for n in ("yes", "yes_cap", "no", "no_cap")], T.StructField("error", T.StringType())])
    return rows.mapInPandas(run, schema)
