"""Queries of prompts, conversations, masks, padding, log-probabilities and partitions, each with its SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from pairloom.core.staging import running_sum, table
from pairloom.functions import text as X
from pairloom.operators import conversation, logprob, partitions, preference, scorer, sequences
from pairloom.plans.reference import _DPO, _ONCE, _SIDES, _pairs, _r, _rounded, _sides, _strip
from pairloom.plans.registered import Plans

PLANS = Plans()
query = PLANS.query


def _q(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


# --- prompts and parsers ------------------------------------------------------------------------


@query(f"select distinct question_id, array_to_string(string_split({_q(X.FACTS_HEAD)} || raw_question || chr(10) || 'Answer: ' || answer, ' ')[1:300], ' ') prompt from candidate_answers")
def fact_prompts(spark, folder):
    a = table(spark, folder, "candidate_answers").select("question_id", "raw_question", "answer").distinct()
    return a.select("question_id", X.fact_prompt(F.col("raw_question"), F.col("answer")).alias("prompt"))


_LISTED = "'### Facts:' || chr(10) || array_to_string(list_transform(list_filter(f, lambda x: x is not null), lambda x: '- ' || x), chr(10))"


@query(f"select pair_id, side, list_transform(list_filter(string_split({_strip('t')}, chr(10)), lambda x: x <> '' and not contains(x, '###')), lambda x: {_strip('substr(x, 2)')}) facts from (select pair_id, side, {_LISTED} t from {_SIDES})", lists=("facts",))
def facts_parsed(spark, folder):
    listed = F.concat(F.lit("### Facts:\n"), F.array_join(F.transform(F.filter("facts", lambda f: f.isNotNull()), lambda f: F.concat(F.lit("- "), f)), "\n"))
    return _sides(spark, folder).select("pair_id", "side", X.facts_from_text(listed).alias("facts"))


@query(f"select pair_id, side, 'Modify:' || array_to_string(list_transform(f, lambda x: chr(10) || '- ' || x || chr(10)), '') prompt from {_SIDES}")
def question_prompts(spark, folder):
    return _sides(spark, folder).select("pair_id", "side", X.facts_prompt(F.col("facts"), "Modify:").alias("prompt"))


@query("select item_id, 'Judge.' || " + " || ".join(f"chr(10) || chr(10) || {_q(f'[Beginning of {X.SECTIONS[k]}]')} || chr(10) || {c} || chr(10) || {_q(f'[End of {X.SECTIONS[k]}]')}" for k, c in (("description", "gt_answer"), ("question", "question"), ("answer_a", "suite"), ("answer_b", "type_name"))) + f" prompt, {_strip('gt_answer')} description, {_strip('type_name')} answer_b from heldout_items")
def judge_prompts(spark, folder):
    h = table(spark, folder, "heldout_items").withColumn("prompt", X.judge_prompt("Judge.", description=F.col("gt_answer"), question=F.col("question"), answer_a=F.col("suite"), answer_b=F.col("type_name")))
    return h.select("item_id", "prompt", X.judge_section(F.col("prompt"), "description").alias("description"), X.judge_section(F.col("prompt"), "answer_b").alias("answer_b"))


@query("select event_id, case event_id % 4 when 0 then ['a', 'b'] when 1 then [event_type] end objects from events", lists=("objects",))
def object_lists(spark, folder):
    e = F.col("event_id") % 4
    t = F.when(e == 0, F.lit('["a", "b"]')).when(e == 1, F.concat(F.lit('I see:\n["'), "event_type", F.lit('"]'))).when(e == 2, F.lit("nothing"))
    return table(spark, folder, "events").select("event_id", X.object_list(t).alias("objects"))


@query(f"select distinct question_id, replace({_strip('answer')}, '</s>', '<EOT>') cleaned, {_strip('answer')} after, {_strip('answer')} before from candidate_answers where answer not like '%endoftext%' and answer not like '%Assistant:%'")
def cleaned_responses(spark, folder):
    a = table(spark, folder, "candidate_answers").select("question_id", "answer").distinct().where("answer not like '%endoftext%' and answer not like '%Assistant:%'")
    c = F.col("answer")
    after, before = F.concat(F.lit("x Generate a response without errors. "), c), F.concat(c, F.lit(" Generate a response with errors. y"))
    return a.select("question_id", X.clean_response(F.concat(F.lit(" Assistant: "), F.replace(c, F.lit("</s>"), F.lit("<|endoftext|>")))).alias("cleaned"), X.without_contrast(after).alias("after"), X.without_contrast(before).alias("before"))


_BARE = "regexp_replace(model_path || tail, '^/+|/+$', '', 'g')"


@query(f"select distinct model_path || tail path, case when last like 'checkpoint-%' and len(p) > 1 then p[-2] || '_' || last else last end model, coalesce(try_cast(nullif(regexp_extract(model_path || tail, 'checkpoint-(\\d+)', 1), '') as int), -1) step from (select model_path, tail, string_split({_BARE}, '/') p, string_split({_BARE}, '/')[-1] \"last\" from (select distinct model_path from candidate_answers where model_path is not null), (values (''), ('/checkpoint-120'), ('/checkpoint-x/')) v(tail))")
def model_names(spark, folder):
    tails = F.explode(F.array(F.lit(""), F.lit("/checkpoint-120"), F.lit("/checkpoint-x/"))).alias("tail")
    p = table(spark, folder, "candidate_answers").where("model_path is not null").select("model_path").distinct().select("model_path", tails).select(F.concat("model_path", "tail").alias("path"))
    return p.select("path", X.model_name(F.col("path")).alias("model"), X.checkpoint_step(F.col("path")).alias("step")).distinct()


_CLAUSE = "list_filter(string_split(regexp_replace(answer, '([.,!?;()\"])" + r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]" + "+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


@query(f"select distinct question_id, {_CLAUSE} clauses from candidate_answers", lists=("clauses",))
def answer_clauses(spark, folder):
    return table(spark, folder, "candidate_answers").select("question_id", "answer").distinct().select("question_id", X.clauses(F.col("answer")).alias("clauses"))


@query(lists=("marked",))
def marked_answers(spark, folder):
    return sequences.marked_differences(_pairs(spark, folder), "rejected", "chosen", by_clause=True).select("pair_id", "marked")


# --- conversations --------------------------------------------------------------------------------


def _rendered_sql(name: str) -> str:
    t = conversation.TEMPLATES[name]
    user, bot, s, s2, system = (_q(x) for x in (*t.roles, t.sep, t.sep2 or "", t.system))
    if t.style == "single":
        text = f"{system} || {s} || {user} || ': ' || question || {s} || {bot} || ': ' || gt_answer || {s} || {user} || ':'"
    elif t.style == "two":
        text = f"{system} || {s} || {user} || ': ' || question || {s} || {bot} || ': ' || gt_answer || {s2} || {user} || ':'"
    elif t.style == "mpt":
        text = f"{system} || {s} || {user} || question || {s} || {bot} || gt_answer || {s} || {user}"
    elif t.style == "plain":
        text = f"question || {s} || gt_answer"
    else:
        head = _q(f"<<SYS>>\n{t.system}\n<</SYS>>\n\n" if t.system else "")
        text = f"'[INST] ' || {head} || question || ' [/INST] ' || gt_answer || ' ' || {s2}"
    return f"select item_id, '{name}' template, {text} prompt from heldout_items where question <> '' and gt_answer <> ''"


def _conversation(question: str, answer: str):
    return F.array(F.struct(F.lit("human").alias("role"), F.col(question).alias("text")), F.struct(F.lit("gpt").alias("role"), F.col(answer).alias("text")), F.struct(F.lit("human").alias("role"), F.lit("").alias("text")))


@query(" union all ".join(_rendered_sql(n) for n in conversation.TEMPLATES))
def rendered_templates(spark, folder):
    h = table(spark, folder, "heldout_items").where("question <> '' and gt_answer <> ''").select("item_id", _conversation("question", "gt_answer").alias("c"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("template"), conversation.render(F.col("c"), t).alias("prompt")) for n, t in conversation.TEMPLATES.items()])).alias("x")
    return h.select("item_id", each).select("item_id", "x.template", "x.prompt")


@query(f"select ds_question_id, '<image>' || chr(10) || {_strip('question')} first, case when question is not null then 'Human|<Image><image></Image>;Assistant|Received.;human|' || {_strip('question')} end tagged from questions")
def images_first(spark, folder):
    turns = F.array(F.struct(F.lit("human").alias("role"), F.concat(F.lit(" <image> "), "question").alias("text")))
    q = table(spark, folder, "questions").select("ds_question_id", conversation.image_first(turns, conversation.TEMPLATES["v1"]).alias("a"), conversation.image_first(turns, conversation.TEMPLATES["v0_mmtag"]).alias("b"))
    text = F.array_join(F.transform("b", lambda x: F.concat(x["role"], F.lit("|"), x["text"])), ";")
    return q.select("ds_question_id", F.col("a")[0]["text"].alias("first"), F.when(F.col("a")[0]["text"].isNotNull(), text).alias("tagged"))


@query("select event_id, case event_id % 4 when 0 then 'system|be kind;user|' || event_type || ';assistant|ok' when 2 then 'system|be kind;assistant|' || event_type || ';user|ok' end turns from events")
def system_turns(spark, folder):
    e = F.col("event_id") % 4
    first = F.when(e == 0, F.lit("human")).when(e == 1, F.lit("gpt")).when(e == 2, F.lit("assistant")).otherwise(F.lit("system"))
    second = F.when(e == 0, F.lit("gpt")).when(e == 1, F.lit("assistant")).otherwise(F.lit("user"))
    turns = F.array(F.struct(first.alias("role"), F.col("event_type").alias("text")), F.struct(second.alias("role"), F.lit("ok").alias("text")))
    done = table(spark, folder, "events").select("event_id", conversation.with_system(turns, "be kind").alias("t"))
    return done.select("event_id", F.when(F.col("t").isNotNull(), F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("|"), x["text"])), ";")).alias("turns"))


@query("select ds_question_id, 'see <s><p><p><p><e> ' || question inside, '<s><p><p><p><e>' || chr(10) || question in_front from questions where question not like '%<image>%'")
def image_tags(spark, folder):
    q = table(spark, folder, "questions").where("question not like '%<image>%'")
    return q.select("ds_question_id", X.image_tags(F.concat(F.lit("see <image> "), "question"), 3, "<s>", "<p>", "<e>").alias("inside"), X.image_tags(F.col("question"), 3, "<s>", "<p>", "<e>").alias("in_front"))


# --- token sequences ---------------------------------------------------------------------------------


def _word_lengths(s: str) -> list[int]:
    return [7, *(len(w) for w in s.split())]


_LENGTHS = "list_transform(list_filter(string_split(regexp_replace({0}, '\\s', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: len(w)::int)"


@query(f"select item_id, list_concat(list_concat([7], {_LENGTHS.format('question')}), list_concat([-200], {_LENGTHS.format('suite')})) ids from heldout_items", lists=("ids",))
def image_token_ids(spark, folder):
    h = table(spark, folder, "heldout_items").withColumn("text", F.concat("question", F.lit("<image>"), "suite"))
    return sequences.image_token_ids(h, "text", _word_lengths, 7).select("item_id", "ids")


@query("select vec_id, [case when k % 3 = 0 then k else -100 end for k in range(0, 12)]::int[] by_role, [case when k < 2 or (k >= 4 and k < 5) or (k >= 10 and k < 11) then -100 else label + k end for k in range(0, 12)]::int[] by_length from embeddings", lists=("by_role", "by_length",))
def role_labels(spark, folder):
    at = F.sequence(F.lit(0), F.lit(11))
    roles = F.transform(at, lambda k: F.when(k % 3 == 0, F.lit("assistant")).otherwise(F.lit("user")))
    ids = F.transform(at, lambda k: (F.col("label") + k).cast("int"))
    # a header of two tokens, then turns of 3, 3, 3 and 1: human turns show their first two
    lengths, speakers = F.array(*[F.lit(n) for n in (2, 3, 3, 3, 1)]), F.array(*[F.lit(s) for s in ("human", "gpt", "human", "gpt")])
    by_length = conversation.masked_by_lengths(ids, lengths, speakers)
    return table(spark, folder, "embeddings").select("vec_id", conversation.response_labels(at, roles).alias("by_role"), by_length.alias("by_length"))




@query("select event_id, (case event_id % 3 when 0 then [-100, -100, -100, -100, 9, 9, 9, -100, -100, -100, 8, 8, -100, -100] when 1 then [-100, -100, -100, -100, 9, 9] else [-100, -100, -100] end)::int[] labels from events", lists=("labels",))
def marked_labels(spark, folder):
    e = F.col("event_id") % 3
    arrays = [F.array(*[F.lit(x) for x in v]) for v in ([1, 5, 5, 2, 9, 9, 9, 1, 5, 2, 8, 8, 1, 4], [1, 5, 5, 2, 9, 9], [1, 6, 6])]
    ids = F.when(e == 0, arrays[0]).when(e == 1, arrays[1]).otherwise(arrays[2])
    return table(spark, folder, "events").select("event_id", conversation.masked_by_marks(ids, [1], [2]).alias("labels"))


@query("select item_id, list_concat(list_transform(range(0, 3 + len(list_filter(string_split(question, ' '), lambda w: w <> ''))), lambda k: -100), list_transform(range(0, 2), lambda k: 1))::int[] shape from heldout_items where question not like '%ASSISTANT%' and question <> '' and question not like '%</s>%'", lists=("shape",))
def round_labels(spark, folder):
    t = conversation.Template("two", "", ("USER", "ASSISTANT"), " ", "</s>")
    h = table(spark, folder, "heldout_items").where("question not like '%ASSISTANT%' and question <> '' and question not like '%</s>%'")
    q = F.regexp_replace("question", r"\s+", " ")
    prompts = h.select("item_id", F.concat(F.lit("USER: "), F.trim(q), F.lit(" ASSISTANT: done</s>")).alias("prompt"))

    def tokenize(s: str) -> list[int]:
        # a begin, one token a word, and one each for a closing separator and a blank at the end
        return [0, *(len(w) for w in s.replace("</s>", " </s>").split()), *([1] if s.endswith(" ") else [])]

    got = conversation.masked_rounds(prompts, "prompt", tokenize, t)
    return got.select("item_id", F.transform("labels", lambda x: F.when(x == -100, F.lit(-100)).otherwise(F.lit(1))).alias("shape"))


@query("select vec_id, list_concat(list_concat([label], [-100, -100, -100]), [label + 2])::int[] spliced, list_concat([label], [-100, -100])::int[] cut from embeddings", lists=("spliced", "cut",))
def image_labels(spark, folder):
    labels = F.array("label", F.lit(-200), F.col("label") + 2)
    return table(spark, folder, "embeddings").select("vec_id", conversation.with_image_labels(labels, F.lit(1), 3).alias("spliced"), conversation.with_image_labels(labels, F.lit(1), 3, 3).alias("cut"))


@query("select vec_id, list_concat(list_transform(range(0, label % 4), lambda k: k), list_transform(range(0, m - label % 4), lambda k: -1))::int[] padded, list_concat(list_transform(range(0, m - label % 4), lambda k: -1), list_transform(range(0, label % 4), lambda k: k))::int[] padded_left from (select vec_id, label, max(label % 4) over (partition by vec_id // 8) m from embeddings)", lists=("padded", "padded_left",))
def padded_batches(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 8).alias("batch"), F.slice(F.sequence(F.lit(0), F.lit(3)), F.lit(1), F.col("label") % 4).alias("ids"))
    right = logprob.pad_batch(e, "ids", "batch", -1)
    return logprob.pad_batch(right.withColumnRenamed("padded", "p"), "ids", "batch", -1, left=True).select("vec_id", F.col("p").alias("padded"), F.col("padded").alias("padded_left"))


@query("select pair_id, question || '>' || chosen win, question || '>' || rejected rej, pair_id + 0.5::double win_logp, -pair_id - 0.5::double rej_logp from " + _ONCE)
def pair_encodings(spark, folder):
    p = _pairs(spark, folder).withColumn("ref_win", F.col("pair_id") + F.lit(0.5)).withColumn("ref_rej", -F.col("pair_id") - F.lit(0.5))
    both = conversation.pair_encodings(p, "question", "chosen", "rejected", lambda q, a: [F.concat(q, F.lit(">"), a).alias("text")], {"logp": "ref_{side}"})
    return both.select("pair_id", F.col("win.text").alias("win"), F.col("rej.text").alias("rej"), F.col("win.logp").alias("win_logp"), F.col("rej.logp").alias("rej_logp"))


# --- log-probabilities ------------------------------------------------------------------------------

_ROW = "list_transform(embedding[{0} * 16 + 1:{0} * 16 + 16], lambda v: v::double)"


def _at(row: int, label: str) -> str:
    r = _ROW.format(row)
    return f"({r}[{label} + 1] - ln(list_sum(list_transform({r}, lambda v: exp(v)))))"


@query(f"select vec_id, round({_at(0, '3')}, 6) logp_1, round({_at(1, '0')}, 6) logp_2, round({_at(2, '15')}, 6) logp_3, round({_at(0, 'label')} + {_at(1, '3')} + {_at(3, '15')}, 6) logp_sum, round(({_at(0, 'label')} + {_at(1, '3')} + {_at(3, '15')}) / 3, 6) logp_mean from embeddings")
def token_logps(spark, folder):
    logits = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("embedding", k * 16 + 1, F.lit(16)))
    labels = F.array(F.col("label"), F.lit(3), F.lit(-100), F.lit(15))
    e = table(spark, folder, "embeddings").select("vec_id", labels.alias("labels"), logprob.token_logps(logits, labels).alias("shifted"), logprob.token_logps(logits, labels, shift=False).alias("own"))
    total, mean = logprob.masked_sums(F.col("own"), F.col("labels"))
    return e.select("vec_id", *[_r(F.col("shifted")[k]).alias(n) for k, n in enumerate(("logp_1", "logp_2", "logp_3"))], _r(total).alias("logp_sum"), _r(mean).alias("logp_mean"))


@query(f"select vec_id, (list_position(embedding, list_max(embedding)) - 1)::int best, {', '.join(f'round(exp({_at(0, str(i))}), 6) {n}' for n, i in (('yes', 1), ('yes_cap', 5), ('no', 9), ('no_cap', 14)))} from embeddings")
def four_probabilities(spark, folder):
    e = table(spark, folder, "embeddings").withColumn("first", F.slice("embedding", 1, 16))
    four = logprob.token_probabilities(F.col("first"), {"yes": 1, "yes_cap": 5, "no": 9, "no_cap": 14})
    return _rounded(e.select("vec_id", logprob.argmax(F.col("embedding")).alias("best"), *four))


@query(f"select vec_id, case label % 3 when 0 then pw when 1 then pl else rw end logp from (select vec_id, label, embedding[1]::double * 10 pw, embedding[2]::double * 10 pl, embedding[3]::double * 10 rw from embeddings)")
def logp_switches(spark, folder):
    v = [F.get("embedding", F.lit(k)).cast("double") * 10 for k in range(3)]
    modes = [logprob.sequence_logp(*v), logprob.sequence_logp(*v, use_average=True), logprob.sequence_logp(*v, token_weighted=True)]
    return table(spark, folder, "embeddings").select("vec_id", F.when(F.col("label") % 3 == 0, modes[0]).when(F.col("label") % 3 == 1, modes[1]).otherwise(modes[2]).alias("logp"))


@query(f"select vec_id, round(greatest(-x, 0) + ln(1 + exp(-abs(x))), 6) loss from (select vec_id, 0.1::double * (pw - pl) x from ({_DPO}))")
def reference_free_losses(spark, folder):
    v = [F.get("embedding", F.lit(k)).cast("double") * 10 for k in range(4)]
    return _rounded(table(spark, folder, "embeddings").select("vec_id", logprob.dpo_terms(*v, beta=0.1, reference_free=True)[0]))


# --- scorers ------------------------------------------------------------------------------------------

_BYTE = "('0x' || substr(sha256(question), {0}, 2))::int"
_FOUR = [_BYTE.format(2 * k + 1) for k in range(4)]


@query(f"select ds_question_id, {', '.join(f'round({b} / greatest(1, {' + '.join(_FOUR)}), 6) {n}' for b, n in zip(_FOUR, ('yes', 'yes_cap', 'no', 'no_cap'), strict=True))}, null::varchar error from questions where question is not null")
def yes_no_probabilities(spark, folder):
    q = table(spark, folder, "questions").where("question is not null").select("ds_question_id", "question")
    return _rounded(scorer.yes_no_scores(q, "question", scorer.StubScorer).drop("question"))


def _parsed(t: str) -> str:
    return f"list_transform(list_filter(string_split({_strip(t)}, chr(10)), lambda x: x <> '' and not contains(x, '###')), lambda x: {_strip('substr(x, 2)')})"


@query(f"select item_id, facts, {_parsed(chr(39) + 'echo Ask:' + chr(39) + ' || array_to_string(list_transform(facts, lambda x: chr(10) || ' + chr(39) + '- ' + chr(39) + ' || x || chr(10)), ' + chr(39) + chr(39) + ')')} changed_facts from (select item_id, {_parsed(chr(39) + 'echo ' + chr(39) + ' || question || chr(10) || ' + chr(39) + '- ' + chr(39) + ' || suite')} facts from heldout_items)", lists=("facts", "changed_facts",))
def facts_and_questions(spark, folder):
    h = table(spark, folder, "heldout_items").select("item_id", F.concat("question", F.lit("\n- "), "suite").alias("p"))
    return scorer.facts_and_questions(h, F.col("p"), lambda facts: X.facts_prompt(facts, "Ask:"), scorer.StubScorer).select("item_id", "facts", "changed_facts")


# --- partitions -----------------------------------------------------------------------------------------


@query("select n_nationkey * 3 + c question_id, n_name, c::int copy from nation, (select unnest(range(0, 3)) c) where n_nationkey >= 2 and n_nationkey < 10")
def repeated_then_sliced(spark, folder):
    n = table(spark, folder, "nation").withColumn("pos", F.col("n_nationkey"))
    return partitions.repeat_then_slice(n, 3, 2, 10, 25).select("question_id", "n_name", "copy")


@query("select 'a' dialect, n_nationkey from nation where n_nationkey >= 3 and n_nationkey < 7 union all select 'b', n_nationkey from nation where n_nationkey >= 20")
def sliced(spark, folder):
    n = table(spark, folder, "nation").select("n_nationkey")
    a, b = partitions.slice_rows(n, 3, 7, 25, "a", "n_nationkey"), partitions.slice_rows(n, 20, 99, 25, "b", "n_nationkey")
    return a.select(F.lit("a").alias("dialect"), "n_nationkey").unionByName(b.select(F.lit("b").alias("dialect"), "n_nationkey"))


@query("select distinct question_id, metainfos.ds_question_id kept, metainfos.metainfos.reference reference, model_path is not null has_model from candidate_answers")
def metainfos_without_keys(spark, folder):
    a = table(spark, folder, "candidate_answers").select("question_id", "metainfos", "model_path").distinct()
    fields = a.schema["metainfos"].dataType.names
    m = a.withColumn("m", partitions.without_keys(F.col("metainfos"), fields, ("image_path",)))
    return m.select("question_id", F.col("m.ds_question_id").alias("kept"), F.col("m.metainfos.reference").alias("reference"), F.col("model_path").isNotNull().alias("has_model")).distinct()


@query("select (o_orderkey // 500)::bigint chunk, count(*) n, true together from orders group by 1")
def shuffled_chunks(spark, folder):
    """Of each chunk its rows and whether they stand together in the shuffled order, all before the incomplete chunk."""
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("pos"))
    placed = running_sum(partitions.shuffle_order(o, 500).withColumn("one", F.lit(1)), [F.col("order_key")], "one", "place")
    chunk = F.floor(F.col("pos") / 500)
    out = placed.groupBy(chunk.alias("chunk")).agg(F.count("*").alias("n"), F.min("place").alias("low"), F.max("place").alias("high"))
    return out.select("chunk", "n", (F.col("high") - F.col("low") + 1 == F.col("n")).alias("together"))


@query("select 50 n, true distinct_rows, true from_table")
def sampled_rows(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey")
    s = partitions.global_sample(o, 50, ["o_orderkey"], 3)
    joined = s.join(o.withColumn("known", F.lit(1)), "o_orderkey", "left")
    return joined.agg(F.count("*").cast("int").alias("n"), (F.count_distinct("o_orderkey") == F.count("*")).alias("distinct_rows"), (F.count("known") == F.count("*")).alias("from_table"))


@query("select coalesce(ds_question_id, '') grp, pair_id from (select pair_id, any_value(ds_question_id) ds_question_id from preference_pairs group by 1) where pair_id is not null")
def sample_of_all(spark, folder):
    """With as many rows a group as there are, the sample is the table."""
    p = table(spark, folder, "preference_pairs").where("pair_id is not null").dropDuplicates(["pair_id"]).select("pair_id", F.coalesce("ds_question_id", F.lit("")).alias("grp"))
    return preference.sample_per_group(p, "grp", ["pair_id"], 1 << 30)


QUERIES, SQL = PLANS.queries, PLANS.sql
