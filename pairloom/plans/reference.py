"""Queries of the preference, judging, object, log-probability and partition operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.core.staging import running_sum, table
from pairloom.functions import text as X
from pairloom.plans.registered import Plans
from pairloom.operators import assembly, conversation, judging, logprob, objects, partitions, preference, scorer, sequences

PLANS = Plans()
query = PLANS.query


_WS = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _w1(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array({c}, '{_WS}+'), lambda w: w <> ''))"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


_ONCE = "(select distinct pair_id, question, chosen, rejected from preference_pairs)"
_LENGTHS = f"(select {_w1('chosen')} c, {_w1('rejected')} r, {_strip('chosen')} = {_strip('rejected')} same from {_ONCE} where chosen is not null and rejected is not null)"


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "preference_pairs").select("pair_id", "question", "chosen", "rejected").distinct()


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[_r(F.col(n), digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


# --- text -----------------------------------------------------------------------------------


@query(f"select question_id, {_w1('answer')}::int n_words, len(string_split({_strip('answer')}, ' '))::int n_pieces, {_strip('answer')} stripped from (select distinct question_id, answer from candidate_answers)")
def text_words(spark, folder):
    a = table(spark, folder, "candidate_answers").select("question_id", "answer").distinct()
    return a.select("question_id", F.when(F.col("answer").isNotNull(), X.word_count(F.col("answer"))).alias("n_words"), F.when(F.col("answer").isNotNull(), X.word_count_single_space(F.col("answer"))).alias("n_pieces"), X.strip_all(F.col("answer")).alias("stripped"))


@query("select ds_question_id, string_split(image_path, '/')[-1] image_id, question || ' Please answer yes or no.' prompt, array_to_string(string_split(question, ' ')[1:5], ' ') head from questions")
def text_prompts(spark, folder):
    q = table(spark, folder, "questions")
    return q.select("ds_question_id", X.base_name(F.col("image_path")).alias("image_id"), X.yes_no_prompt(F.col("question")).alias("prompt"), X.first_tokens(F.col("question"), 5).alias("head"))


@query("select v verdict, count(*) n from (select case regexp_extract(review, '\\[\\[([ABC])\\]\\]', 1) when 'A' then -1 when 'B' then 1 when 'C' then 0 end v from (select distinct review_id, review from comparison_reviews)) group by 1")
def judge_verdicts(spark, folder):
    r = table(spark, folder, "comparison_reviews").select("review_id", "review").distinct()
    return r.groupBy(X.verdict(F.col("review")).alias("verdict")).agg(F.count("*").alias("n"))


_RATED = "select event_id, case event_id % 4 when 0 then 'Rating: ' || (event_id % 9) when 1 then 'rating: 2 or Rating: 5' when 2 then 'RATING: 10' else 'none' end t from events"


def _rated(spark, folder):
    e = F.col("event_id")
    t = F.when(e % 4 == 0, F.concat(F.lit("Rating: "), (e % 9).cast("string"))).when(e % 4 == 1, F.lit("rating: 2 or Rating: 5")).when(e % 4 == 2, F.lit("RATING: 10")).otherwise(F.lit("none"))
    return table(spark, folder, "events").select("event_id", t.alias("t"))


_RATING = "(case when len(list_filter(range(0, 7), lambda k: contains(lower(t), 'rating: ' || k))) = 1 then list_filter(range(0, 7), lambda k: contains(lower(t), 'rating: ' || k))[1] else 0 end)::int"


@query(f"select event_id, {_RATING} rating from ({_RATED})")
def judge_ratings(spark, folder):
    return _rated(spark, folder).select("event_id", X.rating(F.col("t")).alias("rating"))


@query(f"""select kind, count(*) n, round(avg(r), 6) mean_rating, round(avg((r < 3)::int), 6) hall_rate, round(avg(case when r >= 3 then r - 3 else r end) / 3 * 100, 6) informativeness
from (select {_RATING} r, (event_id % 8)::int kind from ({_RATED})) group by rollup(kind)""")
def judge_rating_summary(spark, folder):
    return _rounded(judging.rating_summary(_rated(spark, folder), X.rating(F.col("t")), (F.col("event_id") % 8).cast("int")))


def _between(a: str, b: str) -> str:
    rest = f"substr(prompt, nullif(instr(prompt, '{a}'), 0) + {len(a.replace(chr(39) * 2, chr(39)))})"
    return _strip(f"(case when instr({rest}, '{b}') > 0 then substr({rest}, 1, instr({rest}, '{b}') - 1) end)")


_PARTS = {k: (f"[Beginning of {v}]".replace("'", "''"), f"[End of {v}]".replace("'", "''")) for k, v in X.SECTIONS.items()}


@query("select distinct review_id, " + ", ".join(f"{_between(a, b)} {k}" for k, (a, b) in _PARTS.items()) + " from comparison_reviews")
def judge_prompt_sections(spark, folder):
    p = F.col("prompt")
    return table(spark, folder, "comparison_reviews").select("review_id", *[X.judge_section(p, k).alias(k) for k in X.SECTIONS]).distinct()


# --- preference pairs -------------------------------------------------------------------------


@query("select event_type, sum((value + value / 2 > (100 - value) + (event_id % 50))::int)::bigint n_yes, count(*) n from events group by 1")
def fact_labels(spark, folder):
    v, e = F.col("value"), F.col("event_id")
    label = preference.yes_label(v, v / 2, F.lit(100) - v, (e % 50).cast("double"))
    return table(spark, folder, "events").groupBy("event_type").agg(F.sum(label).alias("n_yes"), F.count("*").alias("n"))


_SIDES = "(select pair_id, s side, case s when 'chosen' then org_infos.scores.chosen.judge else org_infos.scores.rejected.judge end j, case s when 'chosen' then org_infos.chosen_infos.facts else org_infos.rejected_infos.facts end f, case s when 'chosen' then org_infos.chosen_infos.changed_facts else org_infos.rejected_infos.changed_facts end q from (select distinct pair_id, org_infos from preference_pairs), (select unnest(['chosen', 'rejected']) s))"
_FACTS = f"select pair_id, side, e.key question, e.value::int label from (select pair_id, side, unnest(map_entries(j)) e from {_SIDES})"


def _sides(spark, folder):
    """(pair_id, side, judge, facts, changed_facts) of both sides of each pair."""
    p = table(spark, folder, "preference_pairs").dropDuplicates(["pair_id"])
    sides = [F.struct(F.lit(s).alias("side"), F.col(f"org_infos.scores.{s}.judge").alias("judge"), F.col(f"org_infos.{s}_infos.facts").alias("facts"), F.col(f"org_infos.{s}_infos.changed_facts").alias("changed_facts")) for s in ("chosen", "rejected")]
    return p.select("pair_id", F.explode(F.array(*sides)).alias("s")).select("pair_id", "s.*")


@query(f"select pair_id, side, count(*) n_facts, (coalesce(sum(label), 0) - count(*))::bigint score from ({_FACTS}) group by 1, 2")
def answer_scores(spark, folder):
    facts = _sides(spark, folder).select(F.struct("pair_id", "side").alias("key"), F.explode("judge").alias("question", "label")).withColumn("label", F.col("label").cast("int"))
    return preference.answer_scores(facts, "key", "label").select("key.*", "n_facts", "score")


@query("select user_id, array_to_string(list_sort(list(event_type || '=' || l)), ',') judge from (select user_id, event_type, arg_max(event_id % 2, event_id) l from events group by 1, 2) group by 1")
def judge_maps(spark, folder):
    e = table(spark, folder, "events").withColumn("label", (F.col("event_id") % 2).cast("string"))
    m = preference.judge_maps(e, "user_id", "event_type", "label", "event_id")
    return m.select("user_id", F.array_join(F.array_sort(F.transform(F.map_entries("judge"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ",").alias("judge"))


@query("select o_custkey, array_to_string(list_sort(list(distinct o_orderpriority)), '|') ids from orders group by 1")
def ids_by_group(spark, folder):
    return preference.ids_by_group(table(spark, folder, "orders"), ["o_custkey"], "o_orderpriority").select("o_custkey", F.array_join("ids", "|").alias("ids"))


_SCORED = "(select o_custkey, o_orderkey i, left(o_orderpriority, 1)::int s from orders)"


@query(f"select o_custkey, case when a.s >= b.s then a.i else b.i end chosen, case when a.s >= b.s then b.i else a.i end rejected, greatest(a.s, b.s) chosen_score, least(a.s, b.s) rejected_score from {_SCORED} a join {_SCORED} b using (o_custkey) where a.i < b.i and abs(a.s - b.s) >= 2")
def score_pairs(spark, folder):
    o = table(spark, folder, "orders").withColumn("s", F.substring("o_orderpriority", 1, 1).cast("int"))
    return preference.score_pairs(o, ["o_custkey"], "o_orderkey", "s", 2)


@query("select o_orderkey, o_custkey from (select *, max(f) over (order by o_orderkey) m from (select *, min(o_orderkey) over (partition by o_custkey) f from orders)) where f = m")
def first_runs(spark, folder):
    return preference.first_runs(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], "o_orderkey").select("o_orderkey", "o_custkey")


@query("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def kept_rows(spark, folder):
    c = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey")
    return preference.kept_rows(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey").select("o_orderkey")


@query(f"select pair_id, side, coalesce(cardinality(j) = len(list_filter(f, lambda x: x <> '')), false) ok from {_SIDES}")
def facts_match(spark, folder):
    return _sides(spark, folder).select("pair_id", "side", preference.facts_match(F.col("judge"), F.col("facts")).alias("ok"))


@query(f"select count(*) n_pairs, round(avg(c), 6) avg_win, round(avg(r), 6) avg_lose, round(avg((c < r)::int), 6) p_shorter, round(avg((c > r)::int), 6) p_longer from {_LENGTHS} where not same and r > 0 and (r - c) / r <= 0.2")
def pairs_balanced_stats(spark, folder):
    kept = _pairs(spark, folder).where(preference.length_kept(F.col("chosen"), F.col("rejected"), 0.2))
    return _rounded(preference.pair_statistics(preference.pair_lengths(kept)))


_GRID = f"""select k step_no, k * 0.02::double ratio, count(*) n_pairs, avg(c) avg_win, avg(r) avg_lose, avg((c < r)::int) p_shorter, avg((c > r)::int) p_longer
from (select unnest(range(0, 50))::int k) g join {_LENGTHS} l on not same and r > 0 and (r - c)::double / r <= k * 0.02::double group by k"""


@query(f"select step_no, round(ratio, 6) ratio, n_pairs, round(avg_win, 6) avg_win, round(avg_lose, 6) avg_lose, round(p_shorter, 6) p_shorter, round(p_longer, 6) p_longer, round(abs(avg_win - avg_lose) / avg_lose, 6) objective from ({_GRID})")
def balance_grid(spark, folder):
    return _rounded(preference.balance_grid(_pairs(spark, folder)))


@query(f"select round(ratio, 6) ratio, n_pairs, round(abs(avg_win - avg_lose) / avg_lose, 6) objective from ({_GRID}) order by abs(avg_win - avg_lose) / avg_lose, ratio limit 1")
def balance_best(spark, folder):
    return _rounded(preference.best_ratio(preference.balance_grid(_pairs(spark, folder))))


@query("select coalesce(ds_question_id, '') grp, least(count(distinct pair_id), 2) n from preference_pairs group by 1")
def sample_per_group(spark, folder):
    p = table(spark, folder, "preference_pairs").select("pair_id", "ds_question_id").distinct().withColumn("grp", F.coalesce("ds_question_id", F.lit("")))
    return preference.sample_per_group(p, "grp", ["pair_id"], 2).groupBy("grp").agg(F.count("*").alias("n"))


@query(f"""select pair_id, side, (k - 1)::int fact_no, f[k] origin_fact, q[k] || ' Please answer yes or no.' question_text
from (select pair_id, side, f, q, unnest(range(1, case when f is null or q is null then 0 else least(len(f), len(q)) end + 1)) k from {_SIDES})""")
def yes_no_questions(spark, folder):
    return preference.yes_no_questions(_sides(spark, folder)).select("pair_id", "side", "fact_no", "origin_fact", "question_text")


_ANSWERS = f"(select pair_id * 2 + (s = 'rejected')::int question_id, pair_id, s side, j, f, q from (select pair_id, side s, j, f, q from {_SIDES}))"


def _divided(spark, folder):
    """Answers of the pairs as rows of their own, the judge maps that some of them have, and the pairs as ids."""
    p = table(spark, folder, "preference_pairs").dropDuplicates(["pair_id"])
    one = lambda s, k: F.struct((F.col("pair_id") * 2 + k).alias("question_id"), F.col(s).alias("answer"), F.col(f"org_infos.{s}_infos.facts").alias("facts"), F.col(f"org_infos.{s}_infos.changed_facts").alias("changed_facts"), F.col(f"org_infos.scores.{s}.judge").alias("judge"))
    rows = p.select("ds_question_id", "question", "image_path", F.col("org_infos.reference").alias("reference"), F.explode(F.array(one("chosen", 0), one("rejected", 1))).alias("s")).select("ds_question_id", "question", "image_path", "reference", "s.*")
    ids = p.select("ds_question_id", (F.col("pair_id") * 2).alias("chosen"), (F.col("pair_id") * 2 + 1).alias("rejected"), F.lit(0).alias("chosen_score"), F.lit(-1).alias("rejected_score"))
    return ids, rows.drop("judge"), rows.where("judge is not null").select("question_id", "judge")


_KEPT = "coalesce(coalesce(cardinality(org_infos.scores.chosen.judge), 0) = len(list_filter(org_infos.chosen_infos.facts, lambda x: x <> '')), false) and coalesce(coalesce(cardinality(org_infos.scores.rejected.judge), 0) = len(list_filter(org_infos.rejected_infos.facts, lambda x: x <> '')), false)"


@query(f"select pair_id * 2 chosen_id, string_split(image_path, '/')[-1] image_id, question, chosen, rejected, coalesce(org_infos.reference, '') reference, coalesce(cardinality(org_infos.scores.rejected.judge), 0)::int n_rejected_labels, '-1' rejected_score, {_KEPT} kept from (select distinct on (pair_id) * from preference_pairs)")
def assembled_pairs(spark, folder):
    got = assembly.assembled_pairs(*_divided(spark, folder))
    return got.select("chosen_id", "image_id", "question", "chosen", "rejected", "org_infos.reference", F.cardinality("org_infos.scores.rejected.judge").alias("n_rejected_labels"), F.col("org_infos.scores.rejected.score").alias("rejected_score"), "kept")


@query(f"select count(*) filter (kept) n_kept, round(sum(c) / count(*) filter (kept), 6) chosen_words_all, round(avg(c) filter (kept), 6) chosen_words_kept, round(sum(r) / count(*) filter (kept), 6) rejected_words_all, round(avg(r) filter (kept), 6) rejected_words_kept from (select coalesce({_w1('chosen')}, 0) c, coalesce({_w1('rejected')}, 0) r, {_KEPT} kept from (select distinct on (pair_id) * from preference_pairs))")
def assembled_words(spark, folder):
    return _rounded(assembly.mean_words(assembly.assembled_pairs(*_divided(spark, folder))))


@query(f"select question_id, coalesce(cardinality(j), 0)::int n_judged from {_ANSWERS}")
def answers_with_judges(spark, folder):
    _, answers, judges = _divided(spark, folder)
    return assembly.with_judges(answers, judges).select("question_id", F.cardinality("judge").alias("n_judged"))


# --- benchmarks -------------------------------------------------------------------------------

_REVIEWS = "(select distinct review_id, type_name, score, modela from comparison_reviews)"


def _reviews(spark, folder):
    return table(spark, folder, "comparison_reviews").select("review_id", "type_name", "score", "modela").distinct()


@query(f"select type_name, win, loss, tie, win + loss + tie total, round((win + tie / 2) / nullif(win + loss + tie, 0), 6) win_rate from (select type_name, coalesce(sum((score = -1)::bigint), 0)::bigint win, coalesce(sum((score = 1)::bigint), 0)::bigint loss, coalesce(sum((score = 0)::bigint), 0)::bigint tie from {_REVIEWS} group by rollup(type_name))")
def win_totals(spark, folder):
    return _rounded(judging.win_totals(_reviews(spark, folder), ["type_name"]))


@query("select c category, count(*) filter (score = -1) win, count(*) filter (score = 1) loss, count(*) filter (score = 0) tie from (select unnest([" + ", ".join(f"'{c}'" for c in judging.CATEGORIES) + f"]) c) left join {_REVIEWS} on type_name = c group by 1")
def win_by_category(spark, folder):
    return judging.by_category(_reviews(spark, folder))


@query(f"select modela, round(avg((score + 1) / 2), 6) win_score from {_REVIEWS} where score in (-1, 0, 1) group by 1")
def win_scores(spark, folder):
    return _reviews(spark, folder).where(F.col("score").isin(-1, 0, 1)).groupBy("modela").agg(_r(judging.win_score(F.col("score"))).alias("win_score"))


@query("select c_custkey, o.k right_o_orderkey, o.s right_o_orderstatus from customer left join (select o_custkey, max(o_orderkey) k, arg_max(o_orderstatus, o_orderkey) s from orders group by 1) o on o_custkey = c_custkey")
def match_last(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return judging.match_last(table(spark, folder, "customer").select("c_custkey"), o, ["c_custkey"], "o_orderkey")


@query("select s_suppkey pos, s_name, c_name from supplier join customer on s_suppkey = c_custkey")
def zip_rows(spark, folder):
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("pos"), "s_name")
    return judging.zip_rows(s, table(spark, folder, "customer").select(F.col("c_custkey").alias("pos"), "c_name"))


# --- objects in captions ------------------------------------------------------------------------

_CLASSES = {"sailboat": "boat", "canoe": "boat", "ferry": "boat", "bicycle": "bicycle", "scooter": "bicycle", "pony": "horse", "donkey": "horse", "kettle": "pot", "teapot": "pot", "tram": "train", "sandy beach": "beach", "train platform": "station"}
_BIGRAMS = {"sandy beach": "sandy beach", "train platform": "train platform"}


def _captions(spark, folder):
    p = _pairs(spark, folder).where("chosen is not null and rejected is not null")
    tokens = lambda c: objects.merge_bigrams(F.regexp_extract_all(F.lower(F.col(c)), F.lit("[a-z]+"), F.lit(0)), _BIGRAMS)
    classes = F.create_map(*[F.lit(x) for kv in _CLASSES.items() for x in kv])
    rows = p.select("pair_id", F.col("chosen").alias("caption"), tokens("chosen").alias("t"), tokens("rejected").alias("u"))
    rows = rows.select("pair_id", "caption", objects.known_objects(F.col("t"), classes).alias("objects"), objects.known_objects(F.col("u"), classes).alias("v"))
    return rows.select("pair_id", "caption", "objects", F.array_distinct(F.transform("v", lambda x: x["cls"])).alias("truth"))


_MAP = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in _CLASSES.items()) + "}"


def _found(c: str) -> str:
    merged = f"replace(replace(array_to_string(regexp_extract_all(lower({c}), '[a-z]+'), ' '), 'sandy beach', 'sandy_beach'), 'train platform', 'train_platform')"
    named = f"list_transform(string_split({merged}, ' '), lambda w: {_MAP}[replace(w, '_', ' ')])"
    return f"list_filter({named}, lambda x: x is not null)"


_CAPTIONS = f"(select pair_id, chosen caption, {_found('chosen')} o, list_distinct({_found('rejected')}) t from {_ONCE} where chosen is not null and rejected is not null)"


@query(f"select pair_id, len(o)::int n_objects, len(list_filter(o, lambda x: not list_contains(t, x)))::int n_wrong, len(list_distinct(list_filter(o, lambda x: list_contains(t, x))))::int n_right from {_CAPTIONS}")
def caption_objects(spark, folder):
    rows = _captions(spark, folder)
    judged = rows.select("pair_id", "objects", *objects.caption_judgement(F.col("objects"), F.col("truth")))
    return judged.select("pair_id", F.size("objects").alias("n_objects"), F.size("wrong").alias("n_wrong"), F.size("right").alias("n_right"))


@query(f"""select count(*) n_captions, round(avg((w > 0)::int), 6) chair_s, round(sum((w > 0)::int) / nullif(sum((n > 0)::int), 0), 6) chair_s_refine, round(sum(w) / nullif(sum(n), 0), 6) chair_i, round(sum(r) / nullif(sum(g), 0), 6) recall, round(avg(words), 6) avg_words
from (select len(o) n, len(list_filter(o, lambda x: not list_contains(t, x))) w, len(list_distinct(list_filter(o, lambda x: list_contains(t, x)))) r, len(t) g, len(string_split({_strip('caption')}, ' ')) words from {_CAPTIONS})""")
def caption_rates(spark, folder):
    return _rounded(objects.micro_averages(_captions(spark, folder)))


@query("select p_size image_id, array_to_string(list_sort(list(distinct cls)), ',') truth from (select p_size, p_brand cls from part union all select p_size, p_type from part) where cls is not null group by 1")
def truth_sets(spark, folder):
    p = table(spark, folder, "part").withColumnRenamed("p_size", "image_id")
    sets = objects.truth_sets(p.withColumnRenamed("p_brand", "cls"), p.withColumnRenamed("p_type", "cls"))
    return sets.select("image_id", F.array_join("truth", ",").alias("truth"))


# --- log-probabilities -----------------------------------------------------------------------------

_E = "list_transform(embedding, lambda v: v::double)"
_LSE = f"(list_max({_E}) + ln(list_sum(list_transform({_E}, lambda v: exp(v - list_max({_E}))))))"


@query(f"select vec_id, round({_E}[label + 1] - {_LSE}, 6) logp, (list_position(embedding, list_max(embedding)) - 1)::int best, round(exp(list_max({_E}) - {_LSE}), 6) p_best from embeddings")
def label_logps(spark, folder):
    e = table(spark, folder, "embeddings")
    return e.select("vec_id", _r(logprob.log_softmax_at(F.col("embedding"), F.col("label"))).alias("logp"), logprob.argmax(F.col("embedding")).alias("best"), _r(F.array_max(logprob.softmax(F.col("embedding")))).alias("p_best"))


_W = "list_sum(list_transform(range(1, len(embedding) + 1), lambda k: embedding[k]::double * (1 + k % 3) * (k % 2)))"


@query(f"select vec_id, round({_W}, 6) total, round({_W} / list_sum(list_transform(range(1, len(embedding) + 1), lambda k: (1 + k % 3) * (k % 2))), 6) mean from embeddings")
def weighted_logps(spark, folder):
    k = F.sequence(F.lit(1), F.size("embedding"))
    w, m = F.transform(k, lambda x: (1 + x % 3).cast("double")), F.transform(k, lambda x: x % 2)
    return table(spark, folder, "embeddings").select("vec_id", _r(logprob.weighted_logp(F.col("embedding"), w, m)).alias("total"), _r(logprob.weighted_logp(F.col("embedding"), w, m, True)).alias("mean"))


_DPO = "select vec_id, embedding[1]::double * 10 pw, embedding[2]::double * 10 pl, embedding[3]::double * 10 rw, embedding[4]::double * 10 rl from embeddings"
_LOSS = f"select vec_id, pw, greatest(-x, 0) + ln(1 + exp(-abs(x))) loss, 0.1::double * (pw - rw) win, 0.1::double * (pl - rl) lose from (select *, 0.1::double * ((pw - pl) - (rw - rl)) x from ({_DPO}))"


def _dpo(spark, folder):
    v = [F.get("embedding", F.lit(k)).cast("double") * 10 for k in range(4)]
    return table(spark, folder, "embeddings").select("vec_id", v[0].alias("logp_win"), *logprob.dpo_terms(*v, beta=0.1))


@query(f"select vec_id, round(loss, 6) loss, round(win, 6) reward_win, round(lose, 6) reward_lose from ({_LOSS})")
def dpo_losses(spark, folder):
    return _rounded(_dpo(spark, folder).drop("logp_win"))


@query(f"select round(avg(loss) - 0.5 * avg(pw), 6) loss, round(avg(win), 6) reward_win, round(avg(lose), 6) reward_lose, round(avg((win > lose)::int), 6) accuracy, round(avg(win - lose), 6) margin from ({_LOSS})")
def training_metrics(spark, folder):
    return _rounded(logprob.training_metrics(_dpo(spark, folder), 1.0, 0.5))


# --- partitions ------------------------------------------------------------------------------------


def _positions(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("pos"))
    return o, o.count()


@query("select chunk, count(*) n, min(pos) first_pos, max(pos) last_pos from (select o_orderkey pos, floor(o_orderkey / ceil((select count(*) from orders) / 7))::int chunk from orders) group by 1")
def chunks(spark, folder):
    o, n = _positions(spark, folder)
    return o.groupBy(partitions.chunk_of(F.col("pos"), n, 7).alias("chunk")).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query("select ntile - 1 shard, count(*) n, min(pos) first_pos, max(pos) last_pos from (select o_orderkey pos, ntile(7) over (order by o_orderkey)::int ntile from orders) group by 1")
def shards(spark, folder):
    o, n = _positions(spark, folder)
    return o.groupBy(partitions.shard_of(F.col("pos"), n, 7).alias("shard")).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query("select pos, s source, ((pos // 6) * w + k) % n \"inner\" from (select unnest(range(0, 60)) pos) join (values (0, 0, 0, 3, 30), (1, 0, 1, 3, 30), (2, 0, 2, 3, 30), (3, 1, 0, 1, 7), (4, 2, 0, 2, 11), (5, 2, 1, 2, 11)) t(o, s, k, w, n) on pos % 6 = o")
def interleaved(spark, folder):
    return partitions.interleave(spark, [(30, 3), (7, 1), (11, 2)])


@query("with s as (select o_custkey n, count(*) c from orders group by 1), f as (select n, sum(c) over (order by n) - c lo, sum(c) over (order by n) hi from s) select pos, n file_no, (pos - lo)::bigint row_no from (select row_number() over (order by o_orderkey) - 1 pos from orders) join f on pos >= lo and pos < hi")
def border_lookup(spark, folder):
    o = table(spark, folder, "orders")
    sizes = o.groupBy(F.col("o_custkey").alias("file_no")).agg(F.count("*").alias("n_rows"))
    places = running_sum(o.select("o_orderkey", F.lit(1).alias("one")), [F.col("o_orderkey")], "one", "pos").select("pos")
    return partitions.border_lookup(places, sizes)


@query("select r_regionkey * 3 + c + 6 question_id, r_name, c copy from region, (select unnest(range(0, 3))::int c)")
def repeated(spark, folder):
    r = table(spark, folder, "region").withColumn("pos", F.col("r_regionkey"))
    return partitions.repeat_rows(r, 3, start=2).select("question_id", "r_name", "copy")


@query()
def shuffled(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderkey").alias("pos"))
    return partitions.shuffle_order(o, 500).orderBy("order_key").select("o_orderkey")


# --- conversations and sequences --------------------------------------------------------------------


@query("select pair_id, '" + conversation.TEMPLATES["two"].system.replace("'", "''") + " USER: ' || question || ' ASSISTANT: ' || chosen || '</s>' prompt from " + _ONCE + " where question <> '' and chosen <> ''")
def rendered(spark, folder):
    p = _pairs(spark, folder).where("question <> '' and chosen <> ''")
    t = F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role"), F.col("question").alias("text")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.col("chosen").alias("text")))
    return p.select("pair_id", conversation.render(t, conversation.TEMPLATES["two"]).alias("prompt"))


@query("select user_id, event_id, r from (select user_id, event_id, r, lag(r) over (partition by user_id order by event_id) b from (select user_id, event_id, case event_id % 3 when 0 then 'user' else 'assistant' end r from events)) where r = b or (b is null and r <> 'user')")
def alternation_breaks(spark, folder):
    e = table(spark, folder, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.lit("human")).otherwise(F.lit("gpt")).alias("role"))
    return conversation.alternation_breaks(e, "user_id", "event_id", "role").select("user_id", "event_id", conversation.normal_role(F.col("role")).alias("r"))


@query()
def modification_weights(spark, folder):
    p = _pairs(spark, folder).select("pair_id", F.split("rejected", " ").alias("r"), F.split("chosen", " ").alias("c"))
    return sequences.modification_weights(p, "r", "c", 3.0).select("pair_id", F.aggregate("rej_weights", F.lit(0.0), lambda a, x: a + x).alias("rej"), F.aggregate("win_weights", F.lit(0.0), lambda a, x: a + x).alias("win"))


@query("select ds_question_id, question || '' back, to_base64(encode(question)) b64 from questions")
def base64_round_trip(spark, folder):
    q = table(spark, folder, "questions").select("ds_question_id", "question", F.regexp_replace(F.base64("question"), "[\r\n]", "").alias("b64"))
    return q.select("ds_question_id", F.unbase64("b64").cast("string").alias("back"), "b64")


@query("select ds_question_id, 'echo ' || question as output from questions where question is not null")
def stub_generation(spark, folder):
    q = table(spark, folder, "questions").where("question is not null").select("ds_question_id", "question")
    return scorer.generated(q, "question", scorer.StubScorer).select("ds_question_id", "output")


QUERIES, SQL = PLANS.queries, PLANS.sql
