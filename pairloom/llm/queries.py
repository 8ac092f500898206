"""The pN_ queries of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.core.staging import table
from pairloom.llm import bpe_automaton, leakage, pair_defects, pairwise_ranking, reading_level, similarity_join, truncation


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_strengths(spark, folder).select("model_id", "rank_no")


def p1_strengths(spark: SparkSession, folder: str) -> DataFrame:
    return pairwise_ranking.ranking(table(spark, folder, "comparison_reviews"), table(spark, folder, "model_registry"))


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "candidate_answers").where(F.col("question_id").isNotNull())
    return rows.select(F.col("question_id").alias("id"), F.col("answer").alias("text"), truncation.source_key().alias("source")).dropDuplicates(["id"])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_texts(_answers(spark, folder)).select(F.col("id").alias("question_id"))


def p3_copies(spark: SparkSession, folder: str) -> DataFrame:
    """The cut answers, what tells that each is no complete one, and an answer that goes on where it stops."""
    return truncation.cut_texts(_answers(spark, folder)).select(F.col("id").alias("question_id"), "evidence", "copy_id")


def p3_sources(spark: SparkSession, folder: str) -> DataFrame:
    """For each source the number of its answers, how many are cut, and the share."""
    answers = _answers(spark, folder)
    cut = truncation.cut_texts(answers).select("id", F.lit(1).alias("cut"))
    return answers.select("id", "source").join(cut, "id", "left").groupBy("source").agg(F.count("*").alias("n_answers"), F.count("cut").alias("n_cut"), F.avg(F.coalesce("cut", F.lit(0))).alias("share_cut"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return pair_defects.defects(table(spark, folder, "preference_pairs"))


def p4_totals(spark: SparkSession, folder: str) -> DataFrame:
    return p4_found(spark, folder).groupBy("side", "defect").agg(F.count("*").alias("n"))


def _similar_answers(spark: SparkSession, folder: str) -> similarity_join.SimilarSets:
    return similarity_join.similar_sets(similarity_join.answer_sets(table(spark, folder, "candidate_answers"), 3, 40), 0.6)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _similar_answers(spark, folder).pairs().select(F.col("a").alias("question_id_a"), F.col("b").alias("question_id_b"))


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each answer with its class of exact copies and the number of classes linked to it, at the stricter default of five words and 0.8.

    Every question_id has a row; question and answer of fewer than five words together are in the class of the same words.
    """
    sets = similarity_join.answer_sets(table(spark, folder, "candidate_answers"), 5, 0, short=True)
    return similarity_join.similar_sets(sets, 0.8).classes().withColumnRenamed("id", "question_id")


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The groups of p5_found: each answer of 40 words or more, its class of exact copies, the number of classes linked to
    that, and the least question_id of all it is linked with directly or through others."""
    return _similar_answers(spark, folder).groups().withColumnRenamed("id", "question_id")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_automaton.encode_table(table(spark, folder, "documents"), "doc_id", "text")


def p6_token_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens and documents of each source, over the whole corpus."""
    documents = table(spark, folder, "documents")
    counts = p6_ids(spark, folder).select("doc_id", F.size("ids").alias("n_tokens"))
    return documents.select("doc_id", "source").join(counts, "doc_id").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_leaks(spark, folder).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked(table(spark, folder, "documents"), table(spark, folder, "heldout_items"))


def p7_reordered(spark: SparkSession, folder: str) -> DataFrame:
    """As p7_leaks, with tiles of six words or more: also documents whose tiles cover half of an item, in whatever order."""
    return leakage.leaked(table(spark, folder, "documents"), table(spark, folder, "heldout_items"), tile=6)


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """For each leaked item the number of documents that hold it and the largest share of it that one holds."""
    return p7_leaks(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("coverage").alias("coverage"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_levels(spark, folder).select("doc_id", "level_no")


def p8_levels(spark: SparkSession, folder: str) -> DataFrame:
    return reading_level.reading_levels(table(spark, folder, "documents"), table(spark, folder, "doc_grades"))


def p8_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each level in each source."""
    levels = p8_found(spark, folder)
    return table(spark, folder, "documents").select("doc_id", "source").join(levels, "doc_id").groupBy("source", "level_no").agg(F.count("*").alias("n_docs"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_strengths": p1_strengths,
    "p3_found": p3_found,
    "p3_copies": p3_copies,
    "p3_sources": p3_sources,
    "p4_found": p4_found,
    "p4_totals": p4_totals,
    "p5_found": p5_found,
    "p5_classes": p5_classes,
    "p5_groups": p5_groups,
    "p6_ids": p6_ids,
    "p6_token_totals": p6_token_totals,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p7_reordered": p7_reordered,
    "p7_items": p7_items,
    "p8_found": p8_found,
    "p8_levels": p8_levels,
    "p8_profile": p8_profile,
}

_RUNS = """select question_id, r from (select question_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]))) r
from (select question_id, regexp_extract_all(lower(coalesce(raw_question, '') || ' ' || answer), '[\\p{L}\\p{N}]+') w from (select distinct on (question_id) * from candidate_answers where question_id is not null)
where len(regexp_extract_all(lower(answer), '[\\p{L}\\p{N}]+')) >= 40))"""

SQL: dict[str, str] = {
    "p5_found": f"with s as ({_RUNS}), n as (select question_id, count(*) n from s group by 1) select question_id_a, question_id_b from (select a.question_id question_id_a, b.question_id question_id_b, count(*) o from s a join s b using (r) where a.question_id < b.question_id group by 1, 2) join n a on a.question_id = question_id_a join n b on b.question_id = question_id_b where o >= 0.6 * (a.n + b.n - o) - 1e-9"
}
