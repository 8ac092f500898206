"""Queries of readers and writers: tables of fixed size written in each format and read back, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.core.staging import shared_folder, table
from pairloom.operators import assembly, judging
from pairloom.plans.reference import _ONCE, _REVIEWS, _reviews, _strip
from pairloom.plans.registered import Plans
from pairloom.sources import files

PLANS = Plans()
query = PLANS.query


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _items(spark: SparkSession, folder: str) -> DataFrame:
    """The held-out items, a table of fixed size, in one partition and in order."""
    return table(spark, folder, "heldout_items").coalesce(1).sortWithinPartitions("item_id")


@query("select item_id, question, pos from (select item_id, question, row_number() over (order by item_id) - 1 pos from heldout_items) where pos >= 10 and pos < 30")
def jsonl_slice(spark, folder):
    path = _path(spark, "items.jsonl")
    files.write_jsonlines(_items(spark, folder).select("item_id", "question"), path)
    return files.read_jsonlines(spark, path, "item_id bigint, question string", 10, 20)


@query("select model_id, model_name, org, row_number() over (order by model_id) - 1 pos from model_registry")
def json_document(spark, folder):
    path = _path(spark, "models.json")
    files.write_json(table(spark, folder, "model_registry").orderBy("model_id"), path)
    return files.read_json_any(spark, path, "model_id int, model_name string, org string")


@query("select item_id, type_name, row_number() over (order by item_id) - 1 pos from heldout_items")
def json_one_line(spark, folder):
    path = _path(spark, "line.jsonl")
    one = _items(spark, folder).agg(F.to_json(F.array_sort(F.collect_list(F.struct("item_id", "type_name")))).alias("value"))
    one.write.text(path)
    return files.read_json_any(spark, path, "item_id bigint, type_name string")


@query("select item_id, item_id % 3 <> 0 readable from heldout_items")
def tolerant_lines(spark, folder):
    path = _path(spark, "tolerant.jsonl")
    _items(spark, folder).select(F.concat(F.lit('{"item_id": '), F.col("item_id").cast("string"), F.when(F.col("item_id") % 3 == 0, F.lit("")).otherwise(F.lit("}")))).write.text(path)
    good, bad = files.read_tolerant(spark, path, "item_id bigint")
    lost = F.regexp_extract("value", r"(\d+)", 1).cast("bigint").alias("item_id")
    return good.select("item_id", F.lit(True).alias("readable")).unionByName(bad.select(lost, F.lit(False).alias("readable")))


@query("select vec_id, (vec_id // 100)::int shard, label first_logp, label * 2 second_logp from embeddings")
def logps_cached(spark, folder):
    path = _path(spark, "logps")
    e = table(spark, folder, "embeddings").select("vec_id", "label")
    logps = e.select("vec_id", F.array("label", F.col("label") * 2).alias("logps"))
    files.write_logps(assembly.with_logps(e, logps, "vec_id"), path, "pairs", 100, pos="vec_id")
    at = lambda k: F.coalesce(F.get_json_object("logps", f"$.logps[{k}]"), F.get_json_object("logps", f"$[{k}]")).cast("int")
    return files.read_logps(spark, path).select("vec_id", "shard", at(0).alias("first_logp"), at(1).alias("second_logp"))


@query("select pos, 'items' source, suite c1, type_name c2 from (select row_number() over (order by item_id) - 1 pos, suite, type_name from heldout_items) where pos % 2 = 0 union all select pos, 'items', suite, type_name from (select row_number() over (order by item_id) - 1 pos, suite, type_name from heldout_items) where pos % 3 = 0")
def tsv_by_row(spark, folder):
    path = _path(spark, "items-240.tsv")
    _items(spark, folder).select(F.concat(F.lit("items\t "), "suite", F.lit("\t"), "type_name", F.lit(" "))).write.text(path)
    rows = files.read_tsv(spark, path, 3)
    places = rows.select("pos")
    return files.tsv_rows(rows, places.where("pos % 2 = 0").unionByName(places.where("pos % 3 = 0"))).select("pos", "source", "c1", "c2")


@query("select * from (values ('a/b/hall_x.json', 'deep'), ('hall_y.json', 'deep'), ('hall_y.json', 'glob')) t(name, how)")
def found_files(spark, folder):
    path = _path(spark, "found")
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    for name in ("hall_y.json", "a/b/hall_x.json", "a/other.json", "hall_z.txt"):
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        p.getFileSystem(jsc.hadoopConfiguration()).create(p).close()
    rows = [(f.split("found-")[1].split("/", 1)[1], "deep") for f in files.find_files(spark, path, ".json", "hall")]
    rows += [(f.rsplit("/", 1)[1], "glob") for f in files.find_files(spark, path, pattern="*.json")]
    return spark.createDataFrame(rows, "name string, how string")


@query("select c category, count(*) filter (score = -1) win, count(*) filter (score = 1) loss, count(*) filter (score = 0) tie from (select unnest([" + ", ".join(f"'{c}'" for c in judging.CATEGORIES) + f"]) c) left join {_REVIEWS} on type_name = c group by 1")
def statistics_sink(spark, folder):
    path = _path(spark, "statistics")
    files.write_statistics({"wins": judging.by_category(_reviews(spark, folder))}, path)
    return spark.read.option("header", True).schema("category string, win bigint, loss bigint, tie bigint").csv(f"{path}/wins.csv")


@query("select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)")
def remaining_rows(spark, folder):
    done = table(spark, folder, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return files.remaining(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), done, "o_custkey").select("o_orderkey")


@query("select item_id, (item_id % 3)::int shard, row_number() over (order by item_id % 3, item_id) - 1 pos from heldout_items")
def concatenated_shards(spark, folder):
    paths = []
    for k in range(3):
        paths.append(_path(spark, f"shard-{k}"))
        files.write_jsonlines(_items(spark, folder).where(F.col("item_id") % 3 == k).select("item_id"), paths[-1])
    return files.concat_shards(spark, paths, "item_id bigint")


@query("select ds_question_id, case when length(to_base64(encode(question || question))) > 100 then question || question end decoded from questions where question is not null")
def image_payloads(spark, folder):
    q = table(spark, folder, "questions").where("question is not null").select("ds_question_id", F.regexp_replace(F.base64(F.concat("question", "question")), "[\r\n]", "").alias("image"))
    return q.select("ds_question_id", files.image_bytes(F.col("image")).cast("string").alias("decoded"))


@query(f"select question_id::varchar question_id, coalesce(i, ds) image_id, raw_question question, {_strip('answer')} caption from (select distinct a.question_id, a.raw_question, a.answer, a.metainfos.image_path i, a.ds_question_id ds from candidate_answers a)")
def captions_read(spark, folder):
    a = table(spark, folder, "candidate_answers").select("question_id", "raw_question", "answer", F.col("metainfos.image_path").alias("image"), "ds_question_id").distinct()
    rows = a.select(F.col("question_id").alias("pos"), "question_id", "image", "raw_question", F.concat(F.lit(" Assistant: "), "answer").alias("answer"))
    return files.read_captions(rows, a.select(F.col("question_id").alias("pos"), F.col("ds_question_id").alias("image_id")))


@query(f"select pair_id::varchar question_id, null::varchar image_id, question, case when pair_id % 2 = 0 then {_strip('chosen')} else {_strip('rejected')} end caption from {_ONCE} where chosen is not null and rejected is not null")
def captions_in_a_map(spark, folder):
    p = table(spark, folder, "preference_pairs").select("pair_id", "question", "chosen", "rejected").distinct().where("chosen is not null and rejected is not null")
    marked = F.when(F.col("pair_id") % 2 == 0, F.concat(F.lit("x The following is a response without hallucination. "), "chosen")).otherwise(F.concat("rejected", F.lit(" Generate a response with errors. y")))
    entry = F.struct(F.col("pair_id").alias("question_id"), "question", marked.alias("caption"))
    return files.read_captions(p.select(F.create_map(F.col("pair_id").cast("string"), entry).alias("imgToEval")), contrast=True)


QUERIES, SQL = PLANS.queries, PLANS.sql
