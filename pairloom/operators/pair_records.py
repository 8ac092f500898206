"""Pair records of several layouts brought to one nested type, then shredded into linked tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import is_blank
from pairloom.operators.shredding import assemble, shred

SIDES = ("chosen", "rejected")
RECORD = (
    "struct<reference:string,origin_file:string,sides:array<struct<side:string,score:string,"
    "facts:array<struct<fact:string,question:string,label:string>>,changed_facts:array<string>,"
    "judge:array<struct<question:string,label:string>>>>>"
)
_STRICT = {"allowSingleQuotes": "false"}


def _label(c: Column) -> Column:
    """A label given as text or number as '0' or '1', else null."""
    number = F.trim(c).try_cast("double")
    return F.when(number == 0, F.lit("0")).when(number == 1, F.lit("1"))


def _side(name: str, facts: Column, questions: Column, judge: Column, score: Column) -> Column:
    return F.struct(F.lit(name).alias("side"), score.cast("string").alias("score"), facts.alias("facts"), questions.alias("changed_facts"), judge.alias("judge"))


def typed_records(pairs: DataFrame) -> DataFrame:
    """(pair_id, record) of the typed table, one row for each pair_id that is not null."""
    info = F.col("org_infos")

    def side(name: str) -> Column:
        none = F.lit(None).cast("string")
        facts = F.transform(info[f"{name}_infos"]["facts"], lambda f: F.struct(f.alias("fact"), none.alias("question"), none.alias("label")))
        judge = F.transform(F.map_entries(info["scores"][name]["judge"]), lambda e: F.struct(e["key"].alias("question"), _label(e["value"]).alias("label")))
        return _side(name, facts, info[f"{name}_infos"]["changed_facts"], judge, info["scores"][name]["score"])

    record = F.struct(info["reference"].alias("reference"), info["origin_file"].alias("origin_file"), F.array(*[side(s) for s in SIDES]).alias("sides"))
    return pairs.where(F.col("pair_id").isNotNull()).select("pair_id", "org_infos").dropDuplicates(["pair_id"]).select("pair_id", record.cast(RECORD).alias("record"))


def parsed_records(lines: DataFrame) -> DataFrame:
    """(pair_id, record) of JSON lines, one row for each pair_id in a readable line.

    Every part may be an object, a list holding objects, text holding either, null or absent.  A
    line that is no JSON, or has no whole number as pair_id, is unreadable and gives no row.
    Of a pair_id in several lines the first readable line counts.
    """
    top = F.explode(F.from_json("line", "array<struct<pair_id:string,org_infos:string>>", _STRICT)).alias("top")
    rows = lines.where(F.col("line").isNotNull()).select("line_no", top).select("line_no", F.col("top.pair_id").try_cast("bigint").alias("pair_id"), F.col("top.org_infos").alias("o"))
    rows = rows.where(F.col("pair_id").isNotNull()).groupBy("pair_id").agg(F.min_by(F.struct("o"), F.col("line_no"))["o"].alias("o"))

    def inner(c: Column, fields: str) -> Column:
        """The first object of an object, or of a list of objects, with ``fields`` as text."""
        return F.get(F.from_json(c, f"array<struct<{fields}>>", _STRICT), 0)

    rows = rows.withColumn("o", inner(F.col("o"), "reference:string,origin_file:string,chosen_infos:string,rejected_infos:string,scores:string"))
    rows = rows.withColumn("scores", inner(F.col("o.scores"), "chosen:string,rejected:string"))

    def texts(c: Column) -> Column:
        """A list of texts; a single text or object is a list of one."""
        return F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>", _STRICT)).when(c.isNotNull(), F.array(c))

    def own_label(c: Column) -> Column:
        """The label of ``{"label": 1}``, or of a bare label."""
        return _label(F.when(F.ltrim(c).startswith("{"), F.get_json_object(c, "$.label")).otherwise(c))

    def fact(c: Column) -> Column:
        parsed = F.when(F.ltrim(c).startswith("{"), F.from_json(c, "struct<fact:string,changed_fact:string,judge:string>", _STRICT))
        return F.struct(F.when(parsed.isNull(), c).otherwise(parsed["fact"]).alias("fact"), parsed["changed_fact"].alias("question"), own_label(parsed["judge"]).alias("label"))

    def judge(c: Column) -> Column:
        listed = F.transform(F.from_json(c, "array<struct<question:string,label:string>>", _STRICT), lambda e: F.struct(e["question"].alias("question"), _label(e["label"]).alias("label")))
        mapped = F.transform(F.map_entries(F.from_json(c, "map<string,string>", _STRICT)), lambda e: F.struct(e["key"].alias("question"), _label(e["value"]).alias("label")))
        return F.when(F.ltrim(c).startswith("["), listed).when(F.ltrim(c).startswith("{"), mapped)

    def side(name: str) -> Column:
        infos, score = F.col(f"{name}_i"), F.col(f"{name}_s")
        return _side(name, F.transform(texts(infos["facts"]), fact), texts(infos["changed_facts"]), judge(score["judge"]), score["score"])

    for name in SIDES:
        rows = rows.withColumn(f"{name}_i", inner(F.col(f"o.{name}_infos"), "facts:string,changed_facts:string"))
        rows = rows.withColumn(f"{name}_s", inner(F.col(f"scores.{name}"), "judge:string,score:string"))
    record = F.struct(F.col("o.reference").alias("reference"), F.col("o.origin_file").alias("origin_file"), F.array(*[side(s) for s in SIDES]).alias("sides"))
    return rows.select("pair_id", record.cast(RECORD).alias("record"))


def flat_tables(records: DataFrame) -> dict[str, DataFrame]:
    """The linked tables of (pair_id, record): pairs, sides, facts, questions, judgements and verdicts.

    ``pairs`` has pair_id, reference and origin_file.  Every other table has pair_id, side_no and,
    below a side, its ordinal; these link a row to its parent.  ``verdicts`` has one row for each
    fact that is not null or blank, with the label it carries itself, or else the label of the
    question at its place, or ``none``.  Of a question judged twice the last label counts.
    """
    dtype = records.schema["record"].dataType
    records = records.repartition("pair_id")  # the only exchange below; it also keeps the parsed record from being computed for each leaf

    def rebuilt(ancestor: str) -> DataFrame:
        return assemble(shred(records, "pair_id", "record", below=ancestor), dtype, ancestor)

    pairs = shred(records, "pair_id", "record", below="").groupBy("key").agg(
        F.max(F.when(F.col("path") == "reference", F.col("v"))).alias("reference"), F.max(F.when(F.col("path") == "origin_file", F.col("v"))).alias("origin_file")
    )
    link = [F.col("key").alias("pair_id"), F.col("n1").alias("side_no")]
    sides = rebuilt("sides").select(*link, "side", "score")
    facts = rebuilt("sides.facts").select(*link, F.col("n2").alias("fact_no"), "fact", F.col("question").alias("own_question"), F.col("label").alias("own_label"))
    questions = rebuilt("sides.changed_facts").select(*link, F.col("n2").alias("fact_no"), F.col("value").alias("question"))
    judged = rebuilt("sides.judge").select(*link, F.col("n2").alias("judge_no"), "question", "label")
    last = judged.where(F.col("label").isNotNull()).groupBy("pair_id", "side_no", "question").agg(F.max_by("label", "judge_no").alias("label"))
    verdicts = (
        facts.where(~is_blank(F.col("fact")))
        .join(questions, ["pair_id", "side_no", "fact_no"], "left")
        .withColumn("question", F.coalesce("own_question", "question"))
        .join(last, ["pair_id", "side_no", "question"], "left")
        .select("pair_id", "side_no", "fact_no", F.coalesce("own_label", "label", F.lit("none")).alias("verdict"))
    )
    return {"pairs": pairs.withColumnRenamed("key", "pair_id"), "sides": sides, "facts": facts, "questions": questions, "judgements": judged, "verdicts": verdicts}


def all_records(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The records of both tables; the typed one counts where they share a pair_id."""
    typed = typed_records(pairs)
    return typed.unionByName(parsed_records(lines).join(pairs.select("pair_id"), "pair_id", "left_anti"))


def fact_verdicts(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """pair_id, side, fact_no, verdict of both tables."""
    tables = flat_tables(all_records(pairs, lines))
    names = F.element_at(F.array(*[F.lit(s) for s in SIDES]), F.col("side_no") + 1)
    return tables["verdicts"].select("pair_id", names.alias("side"), "fact_no", "verdict")
