"""Queries of objects in captions, benchmark summaries and image sizes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.core.staging import table
from pairloom.operators import assembly, images, judging, objects, partitions
from pairloom.plans.reference import _BIGRAMS, _CLASSES, _MAP, _ONCE, _REVIEWS, _pairs, _reviews, _rounded, _w1
from pairloom.plans.registered import Plans

PLANS = Plans()
query = PLANS.query

# --- captions ------------------------------------------------------------------------------------

_ENDS = " ".join(f"when ends_with(w, '{e}') and length(w) > {len(e) + 1} then left(w, length(w) - {len(e)}) || '{x}'" for e, x in (("ies", "y"), ("ves", "f"), ("sses", "ss"), ("shes", "sh"), ("ches", "ch"), ("xes", "x"), ("s", "")))
_LEMMAS = "list_transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda w: case when regexp_matches(w, '(ss|us|is)$') then w " + _ENDS + " else w end)"
_MERGED = "string_split(regexp_replace(regexp_replace(array_to_string({0}, ' '), '\\bsandy beach\\b', 'sandy_beach', 'g'), '\\btrain platform\\b', 'train_platform', 'g'), ' ')"
_WALK = f"(select pair_id, {_MERGED.format(_LEMMAS.format('chosen'))} m, {_MERGED.format(_LEMMAS.format('rejected'))} r from {_ONCE} where chosen is not null and rejected is not null)"
_PLACED = f"list_filter([struct_pack(idx := coalesce(list_sum([len(string_split(x, '_')) for x in m[1:k - 1]]), 0)::int, cls := {_MAP}[replace(m[k], '_', ' ')]) for k in range(1, len(m) + 1)], lambda x: x.cls is not null)"


def _class_map():
    return F.create_map(*[F.lit(x) for kv in _CLASSES.items() for x in kv])


@query(f"select pair_id, list_transform(o, lambda x: x.cls) classes, list_transform(o, lambda x: x.idx) idx, list_transform(list_filter(o, lambda x: not list_contains(t, x.cls)), lambda x: x.idx) wrong_idx from (select pair_id, {_PLACED} o, list_filter(list_transform(r, lambda w: {_MAP}[replace(w, '_', ' ')]), lambda x: x is not null) t from {_WALK})", lists=("classes", "idx", "wrong_idx",))
def captions_walked(spark, folder):
    p = _pairs(spark, folder).where("chosen is not null and rejected is not null")
    rows = objects.caption_objects(p, _class_map(), _BIGRAMS, "chosen").withColumnRenamed("found", "o")
    rows = objects.caption_objects(rows, _class_map(), _BIGRAMS, "rejected").withColumn("truth", F.array_distinct(F.transform("found", lambda x: x["cls"])))
    judged = objects.caption_judgement(F.col("o"), F.col("truth"), places=True)
    return rows.select("pair_id", F.transform("o", lambda x: x["cls"]).alias("classes"), F.transform("o", lambda x: x["idx"]).alias("idx"), judged[0])


@query("select event_id, case event_id % 3 when 0 then ['toilet', 'toilet'] when 1 then ['seat', 'tie', 'wine glass'] else ['seat', 'toilet'] end words from events", lists=("words",))
def toilet_rule(spark, folder):
    """Captions with toilet and seat, with a seat alone, and with names of two words; young and grown animals, and plurals."""
    e = F.col("event_id") % 3
    text = F.when(e == 0, F.lit("The seat of the toilet, a toilet seat and a seat")).when(e == 1, F.lit("Seats, bow ties and wine glasses")).otherwise(F.lit("seats near passenger toilets"))
    names = ["toilet", "seat", "tie", "wine glass"]
    classes = F.create_map(*[F.lit(x) for w in names for x in (w, w)])
    found = objects.caption_objects(table(spark, folder, "events").select("event_id", e.alias("e"), text.alias("caption")), classes, objects.double_words(names))
    return found.select("event_id", F.when(F.col("e") == 2, F.array(F.lit("seat"), F.lit("toilet"))).otherwise(F.transform("found", lambda x: x["word"])).alias("words"))


@query("select event_id, case event_id % 3 when 0 then ['dog', 'wooden chair', 'tie'] when 1 then []::varchar[] else ['cup', 'tea'] end objs from events", lists=("objs",))
def listed_objects(spark, folder):
    e = F.col("event_id") % 3
    lists = F.when(e == 0, F.array(F.lit("baby dogs"), F.lit("Wooden chairs"), F.lit("bow tie"), F.lit("adult dog"))).when(e == 1, F.array(F.lit("never seen"))).otherwise(F.array(F.lit("cup of teas")))
    caption = F.when(e == 1, F.lit("so it is")).otherwise(F.lit("a caption of more than three words"))
    rows = table(spark, folder, "events").select("event_id", caption.alias("caption"), lists.alias("listed"))
    return objects.listed_objects(objects.judged_objects(rows, "caption", "listed"), "listed", objects.double_words([])).select("event_id", "objs")


@query(f"select pair_id, case when {_w1('chosen')} <= 3 then 0 else 2 end n_objects from {_ONCE} where chosen is not null")
def short_answers(spark, folder):
    p = _pairs(spark, folder).where("chosen is not null").withColumn("listed", F.array(F.lit("a"), F.lit("b")))
    return objects.judged_objects(p, "chosen", "listed").select("pair_id", F.size("listed").alias("n_objects"))


def _lines(spark, folder):
    """Lines as in a file of synonyms: a region and its nations."""
    n = table(spark, folder, "nation").join(table(spark, folder, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    return n.groupBy(F.col("n_regionkey").alias("pos"), "r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("names")).select("pos", F.concat("r_name", F.lit(", "), "names", F.lit(" ")).alias("value"))


@query("select n_name word, r_name cls from nation join region on r_regionkey = n_regionkey union select r_name, r_name from region")
def synonym_classes(spark, folder):
    return objects.synonyms(_lines(spark, folder))


_TRUTH = "select distinct l_orderkey image_id, r_name cls from lineitem join orders on o_orderkey = l_orderkey join nation on n_nationkey = l_suppkey % 30 join region on r_regionkey = n_regionkey where o_orderpriority = '1-URGENT'"


@query(_TRUTH)
def class_truth(spark, folder):
    instances = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("image_id"), (F.col("l_suppkey") % 30).cast("int").alias("category_id"))
    wanted = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("image_id"))
    categories = table(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return objects.class_truth(instances, categories, objects.synonyms(_lines(spark, folder)), wanted)


@query("select n_regionkey, n_name, list_transform(list_filter([struct_pack(i := 1, w := 'sandy beach'), struct_pack(i := 3, w := 'train platform')], lambda x: x.i <= n_nationkey % 5), lambda x: x.w) merged from nation", lists=("merged",))
def bigrams_only(spark, folder):
    words = F.array(*[F.lit(w) for w in ("sandy", "beach", "train", "platform", "sandy")])
    n = table(spark, folder, "nation").withColumn("t", F.slice(words, F.lit(1), F.when(F.col("n_nationkey") % 5 == 0, F.lit(0)).otherwise(F.col("n_nationkey") % 5 + 1)))
    return n.select("n_regionkey", "n_name", objects.merge_bigrams(F.col("t"), _BIGRAMS, keep_all=False).alias("merged"))


@query("select (select count(distinct o_custkey) from orders where o_custkey not in (select c_custkey from customer)) only_a, (select count(*) from customer where c_custkey not in (select o_custkey from orders)) only_b")
def set_differences(spark, folder):
    return partitions.set_differences(table(spark, folder, "orders").select("o_custkey"), table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey")))


# --- benchmarks ------------------------------------------------------------------------------------

_CATS = ", ".join(f"'{c}'" for c in judging.CATEGORIES)


@query(f"select modela, count(*) filter (score = 1) win, count(*) filter (score = -1) loss, count(*) filter (score = 0) tie, count(*) filter (score = 1 and type_name in ({_CATS})) win_check, count(*) filter (score = -1 and type_name in ({_CATS})) loss_check, count(*) filter (score = 0 and type_name in ({_CATS})) tie_check, count(*) filter (score in (-1, 0, 1) and type_name in ({_CATS})) all_check from {_REVIEWS} group by 1")
def model_totals(spark, folder):
    return judging.model_totals(_reviews(spark, folder))


@query("""select s_name model, s_suppkey::int step, round(100 * s, 6) response_hall, round(100 * i, 6) object_hall, round(100 * (1 - s), 6) response_correct, round(100 * (1 - i), 6) object_correct, round(100 * r, 6) object_recall,
round(2 * (100 * (1 - i)) * (100 * r) / nullif(100 * (1 - i) + 100 * r, 0), 6) object_f1, round(2 * (n / 3) * (100 * (1 - s)) / nullif(n / 3 + 100 * (1 - s), 0), 6) response_f1
from (select s_name, s_suppkey, (s_suppkey % 100)::double / 100 s, (s_suppkey % 37)::double / 37 i, (s_suppkey % 11)::double / 11 r, (s_suppkey % 300)::double n from supplier)""")
def caption_summaries(spark, folder):
    k = F.col("s_suppkey")
    part = lambda n: (k % n).cast("double") / n
    rates = table(spark, folder, "supplier").select(F.col("s_name").alias("model"), k.cast("int").alias("step"), part(100).alias("chair_s_refine"), part(37).alias("chair_i"), part(11).alias("recall"), (k % 300).cast("double").alias("n_object_captions"))
    return _rounded(judging.caption_summary(rates))


@query("select sum(event_id) total_tokens, sum(event_id // 2) prompt_tokens, sum(event_id - event_id // 2) completion_tokens, sum(event_id) filter (event_id % 5 <> 0) ok_total_tokens, sum(event_id // 2) filter (event_id % 5 <> 0) ok_prompt_tokens, sum(event_id - event_id // 2) filter (event_id % 5 <> 0) ok_completion_tokens from events")
def usage_totals(spark, folder):
    half = F.floor(F.col("event_id") / 2)
    usage = F.struct(F.col("event_id").alias("total_tokens"), half.alias("prompt_tokens"), (F.col("event_id") - half).alias("completion_tokens"))
    return judging.usage_totals(table(spark, folder, "events").select(usage.alias("usage"), (F.col("event_id") % 5 != 0).alias("ok")), "usage", "ok")


_LAST = "(select o_custkey, arg_max(o_orderstatus, o_orderkey) b from orders group by 1)"


@query(f"select c_custkey, c_mktsegment answer_a, b answer_b, false swapped from customer left join {_LAST} on o_custkey = c_custkey union all select c_custkey, case when b is null then c_mktsegment else b end, case when b is not null then c_mktsegment end, true from customer left join {_LAST} on o_custkey = c_custkey")
def answers_matched(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("answer"))
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("answer"))
    both = [judging.match_answers(c, o, ["c_custkey"], "pos", reverse=r).withColumn("swapped", F.lit(r)) for r in (False, True)]
    return both[0].unionByName(both[1])


@query("select model_id, contains(model_name, '7') served from model_registry")
def served_models(spark, folder):
    return table(spark, folder, "model_registry").select("model_id", judging.served_by(F.col("model_name"), "7").alias("served"))


@query("select * from (select 'repeated question_id' rule, count(*) - count(distinct question_id) n from candidate_answers union all select 'raw_question differs from answer', count(*) filter (raw_question is distinct from answer) from candidate_answers union all select 'rows are not 300', count(*) from candidate_answers union all select 'distinct model_path are not 8', count(distinct model_path) from candidate_answers) where n > 0 and not (rule = 'rows are not 300' and n = 300) and not (rule = 'distinct model_path are not 8' and n = 8)")
def cardinality_breaks(spark, folder):
    return assembly.cardinality_breaks(table(spark, folder, "candidate_answers"), ["question_id"], [("raw_question", "answer")], 300, {"model_path": 8})


# --- images -----------------------------------------------------------------------------------------

_SIZES = [(336, 672), (672, 336), (672, 672), (1008, 336), (336, 1008)]
_CANDIDATES = ", ".join(f"({k}, {w}, {h})" for k, (w, h) in enumerate(_SIZES))
_SIZED = f"""(select p_partkey, w, h, arg_min(struct_pack(tw := tw, th := th), struct_pack(a := -kept, b := tw * th - kept, k := k)) best from
(select p_partkey, w, h, k, tw, th, least((floor(w * s) * floor(h * s))::bigint, w * h) kept from (select p_partkey, (p_size * 37 + 100)::bigint w, (p_partkey % 900 + 100)::bigint h from part), (values {_CANDIDATES}) v(k, tw, th), lateral (select least(tw::double / w, th::double / h) s)) group by 1, 2, 3)"""


@query(f"select p_partkey, best.tw width, best.th height, (best.tw // 336)::int \"columns\", (best.th // 336)::int \"rows\", (case when best.tw::double / w < best.th::double / h then best.tw else least(ceil(w * (best.th::double / h)), best.tw) end)::int fit_width, (case when best.tw::double / w < best.th::double / h then least(ceil(h * (best.tw::double / w)), best.th) else best.th end)::int fit_height from {_SIZED}")
def image_grids(spark, folder):
    w, h = (F.col("p_size") * 37 + 100).cast("bigint"), (F.col("p_partkey") % 900 + 100)
    p = table(spark, folder, "part").select("p_partkey", w.alias("w"), h.alias("h"))
    best, shape = images.best_resolution(F.col("w"), F.col("h"), _SIZES), images.grid_shape(F.col("w"), F.col("h"), _SIZES, 336)
    p = p.withColumn("b", best).withColumn("s", shape).withColumn("f", images.fitted(F.col("w"), F.col("h"), F.col("b.width"), F.col("b.height")))
    return p.select("p_partkey", "b.width", "b.height", "s.columns", "s.rows", F.col("f.width").alias("fit_width"), F.col("f.height").alias("fit_height"))


@query("select p_partkey, (case when w / h > 1.5 then 48 else 48 - 2 * floor((48 - floor(w * (32 / h))) / 2) end)::int width, (case when w / h > 1.5 then 32 - 2 * floor((32 - floor(h * (48 / w))) / 2) else 32 end)::int height from (select p_partkey, (p_size * 37 + 100)::double w, (p_partkey % 900 + 100)::double h from part)")
def unpadded_grids(spark, folder):
    w, h = (F.col("p_size") * 37 + 100).cast("double"), (F.col("p_partkey") % 900 + 100).cast("double")
    return table(spark, folder, "part").select("p_partkey", images.without_padding(w, h, F.lit(48), F.lit(32)).alias("x")).select("p_partkey", "x.width", "x.height")


QUERIES, SQL = PLANS.queries, PLANS.sql
