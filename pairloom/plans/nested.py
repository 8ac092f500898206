"""Flat tables of the nested pair records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.core.staging import table
from pairloom.operators import pair_records


def _tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    pairs, lines = table(spark, folder, "preference_pairs"), table(spark, folder, "raw_pairs")
    return pair_records.flat_tables(pair_records.all_records(pairs, lines))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return pair_records.fact_verdicts(table(spark, folder, "preference_pairs"), table(spark, folder, "raw_pairs"))


def p2_typed(spark: SparkSession, folder: str) -> DataFrame:
    """The verdicts of the typed table alone, which SQL can state."""
    return pair_records.fact_verdicts(table(spark, folder, "preference_pairs"), table(spark, folder, "raw_pairs").where("false"))


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _tables(spark, folder)["pairs"]


def p2_sides(spark: SparkSession, folder: str) -> DataFrame:
    return _tables(spark, folder)["sides"]


def p2_facts(spark: SparkSession, folder: str) -> DataFrame:
    return _tables(spark, folder)["facts"]


def p2_judgements(spark: SparkSession, folder: str) -> DataFrame:
    return _tables(spark, folder)["judgements"]


_BLANK = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SIDE = """select pair_id, '{0}' side, unnest(range(0, len(org_infos.{0}_infos.facts)))::int fact_no, org_infos.{0}_infos.facts f, org_infos.{0}_infos.changed_facts q, org_infos.scores.{0}.judge j
from (select distinct on (pair_id) pair_id, org_infos from preference_pairs where pair_id is not null)"""
QUERIES = {"p2_found": p2_found, "p2_typed": p2_typed, "p2_pairs": p2_pairs, "p2_sides": p2_sides, "p2_facts": p2_facts, "p2_judgements": p2_judgements}
SQL: dict[str, str] = {
    "p2_typed": f"select pair_id, side, fact_no, coalesce(j[q[fact_no + 1]], 'none') verdict from ({_SIDE.format('chosen')} union all {_SIDE.format('rejected')}) where regexp_replace(f[fact_no + 1], '{_BLANK}', '', 'g') <> ''"
}
