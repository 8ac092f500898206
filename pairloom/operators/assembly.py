"""Preference pairs put together from candidate answers, their facts, and the judges' labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import base_name, word_count
from pairloom.operators.preference import facts_match

_NO_LABELS = "map<string,string>"


def with_judges(answers: DataFrame, judges: DataFrame, key: str = "question_id") -> DataFrame:
    """Answers with the judge map of (key, judge); an answer that no judge saw gets an empty map.  Null keys meet none."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return answers.join(judges.select(key, F.col("judge").cast(_NO_LABELS).alias("judge")), key, "left").withColumn("judge", F.coalesce("judge", empty))


def assembled_pairs(pairs: DataFrame, answers: DataFrame, judges: DataFrame) -> DataFrame:
    """Pairs of (ds_question_id, chosen, rejected: ids, chosen_score, rejected_score) with both answers and their judgements.

    ``answers`` has question_id, ds_question_id, question, answer, image_path, reference, facts,
    changed_facts, one row a question_id.  Both sides are looked up by id, so the answers
    meet the pairs twice, each time on the key they are distributed by.  ``kept`` says whether both
    sides have a label for each of their facts; pairs not kept count in the sums of words only.
    """
    known = with_judges(answers, judges)

    def side(name: str) -> DataFrame:
        fields = [F.col(c).alias(f"{name}_{c}") for c in ("question", "answer", "image_path", "reference", "facts", "changed_facts", "judge")]
        return known.select(F.col("question_id").alias(name), *fields)

    both = pairs.join(side("chosen"), "chosen").join(side("rejected"), "rejected")
    kept = facts_match(F.col("chosen_judge"), F.col("chosen_facts")) & facts_match(F.col("rejected_judge"), F.col("rejected_facts"))

    def infos(name: str) -> Column:
        return F.struct(F.col(f"{name}_facts").alias("facts"), F.col(f"{name}_changed_facts").alias("changed_facts")).alias(f"{name}_infos")

    def score(name: str) -> Column:
        return F.struct(F.col(f"{name}_judge").alias("judge"), F.col(f"{name}_score").cast("string").alias("score")).alias(name)

    org = F.struct("ds_question_id", F.coalesce("chosen_reference", F.lit("")).alias("reference"), infos("chosen"), infos("rejected"), F.struct(score("chosen"), score("rejected")).alias("scores"))
    return both.select(
        F.col("chosen").alias("chosen_id"),
        F.col("rejected").alias("rejected_id"),
        base_name(F.col("chosen_image_path")).alias("image_id"),
        F.col("chosen_image_path").alias("image_path"),
        "ds_question_id",
        F.col("chosen_question").alias("question"),
        F.col("chosen_answer").alias("chosen"),
        F.col("rejected_answer").alias("rejected"),
        org.alias("org_infos"),
        kept.alias("kept"),
    )


def mean_words(pairs: DataFrame) -> DataFrame:
    """Pairs kept and mean words of both sides in two ways: words of all pairs over the pairs kept, and of the kept ones only; null without any."""
    n = F.sum(F.col("kept").cast("int"))
    means = []
    for side in ("chosen", "rejected"):
        w = F.coalesce(word_count(F.col(side)), F.lit(0))
        means += [F.try_divide(F.sum(w).cast("double"), n).alias(f"{side}_words_all"), F.avg(F.when(F.col("kept"), w)).alias(f"{side}_words_kept")]
    return pairs.agg(F.coalesce(n, F.lit(0)).alias("n_kept"), *means)


def cardinality_breaks(rows: DataFrame, unique: list[str], same: list[tuple[str, str]] = (), n_rows: int | None = None, distinct: dict[str, int] | None = None) -> DataFrame:
    """(rule, n) of the expectations that do not hold: rows with a repeated key, rows whose two columns differ, and wrong numbers.

    An empty result means that all hold.  Nulls are equal to each other; null keys count as one key.
    """
    checks = [F.sum((~F.col(a).eqNullSafe(F.col(b))).cast("bigint")).alias(f"{a} differs from {b}") for a, b in same]
    checks += [F.when(F.count("*") != n_rows, F.count("*")).alias(f"rows are not {n_rows}")] if n_rows is not None else []
    checks += [F.when(F.count_distinct(c) != n, F.count_distinct(c)).alias(f"distinct {c} are not {n}") for c, n in (distinct or {}).items()]
    repeated = rows.groupBy(*unique).count().agg(F.sum(F.col("count") - 1).alias(f"repeated {', '.join(unique)}")) if unique else None
    out = None
    for part in ([rows.agg(*checks)] if checks else []) + ([repeated] if repeated is not None else []):
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("n")) for c in part.columns]))
        found = part.select(pairs.alias("x")).select("x.rule", "x.n").where("n > 0 or (n = 0 and rule like '%are not%')")
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no expectation given")
    return out


def with_logps(rows: DataFrame, logps: DataFrame, pos: str = "pos", overwrite: bool = False) -> DataFrame:
    """Rows that have log-probabilities (pos, logps), with the text of ``{"logps": ...}``; rows beyond them are left out.

    Rows that hold log-probabilities already are an error unless ``overwrite``.
    """
    if "logps" in rows.columns and not overwrite and rows.where("logps is not null and logps <> ''").limit(1).count():
        raise ValueError("the rows already hold log-probabilities")
    return rows.drop("logps").join(logps.select(pos, F.to_json(F.struct("logps")).alias("logps")), pos)
