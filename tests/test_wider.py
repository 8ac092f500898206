"""Edge rows of pair assembly, objects in captions, masks, scorers, images and files."""

import difflib
import time

import pytest
from pyspark.sql import functions as F

from pairloom.core.staging import running_sum
from pairloom.operators import assembly, conversation, images, judging, logprob, objects, partitions, scorer, sequences
from pairloom.plans.registered import Plans
from pairloom.sources import files


def test_assembly_keeps_what_both_sides_judge(spark):
    answers = [(1, "g", "Q?", "a b c", "/x/i.jpg", None, ["f", ""], ["f?"]), (2, "g", "Q?", "d", "/x/i.jpg", "r", ["g"], None), (3, "g", "Q?", None, None, None, None, None)]
    a = spark.createDataFrame(answers, "question_id int, ds_question_id string, question string, answer string, image_path string, reference string, facts array<string>, changed_facts array<string>").withColumn("judge", F.lit("clash")).drop("judge")
    j = spark.createDataFrame([(1, {"f?": "1"}), (2, {"g?": "0"}), (9, {"x": "1"})], "question_id int, judge map<string,string>")
    p = spark.createDataFrame([("g", 1, 2, 0, -1), ("g", 1, 3, 0, 0), ("g", 1, 77, 0, 0)], "ds_question_id string, chosen int, rejected int, chosen_score int, rejected_score int")
    got = {r.rejected_id: r for r in assembly.assembled_pairs(p, a, j).collect()}
    assert got.keys() == {2, 3} and got[2].kept and not got[3].kept
    assert got[2].image_id == "i.jpg" and got[2].org_infos.scores.rejected.score == "-1" and got[2].org_infos.reference == ""
    m = assembly.mean_words(assembly.assembled_pairs(p, a, j)).first()
    assert (m.n_kept, m.chosen_words_all, m.chosen_words_kept, m.rejected_words_all) == (1, 6, 3, 1)
    assert assembly.mean_words(assembly.assembled_pairs(p.limit(0), a, j)).first().chosen_words_kept is None


def test_cardinality_and_logps(spark):
    rows = spark.createDataFrame([(1, "a", "a"), (1, "a", None), (2, None, None)], "k int, x string, y string")
    got = {r.rule: r.n for r in assembly.cardinality_breaks(rows, ["k"], [("x", "y")], 3, {"x": 2}).collect()}
    assert got == {"repeated k": 1, "x differs from y": 1, "distinct x are not 2": 1}
    assert assembly.cardinality_breaks(rows, ["k", "x", "y"], n_rows=3).count() == 0
    with pytest.raises(ValueError):
        assembly.with_logps(rows.withColumn("logps", F.lit("{}")), rows, "k")


def test_objects_in_captions(spark):
    lines = spark.createDataFrame([(0, "person, man,  skier"), (1, ""), (2, "cup, wine glass, skier")], "pos int, value string")
    assert {r.word: r.cls for r in objects.synonyms(lines).collect()} == {"person": "person", "man": "person", "skier": "cup", "cup": "cup", "wine glass": "cup"}
    classes = F.create_map(*[F.lit(x) for x in ("dog", "dog", "tie", "tie", "chair", "chair")])
    rows = spark.createDataFrame([("Baby dogs and chairs, a bow tie.",), (None,), ("",), ("dog",)], "caption string")
    got = [[tuple(x) for x in r.found] for r in objects.caption_objects(rows, classes, objects.double_words(["dog", "chair"])).collect()]
    assert got == [[(0, "dog", "dog"), (3, "chair", "chair"), (5, "tie", "tie")], [], [], [(0, "dog", "dog")]]
    assert [sequences.simple_lemma(w) for w in ("glasses", "leaves", "boxes", "bus", "cities")] == ["glass", "leaf", "box", "bus", "city"]
    words = spark.createDataFrame([(["glasses", "leaves", "boxes", "bus", "cities", "s"],)], "w array<string>")
    assert sequences.simple_lemmas(words, "w", "l").first().l == ["glass", "leaf", "box", "bus", "city", "s"]


def test_long_rows_of_logits_and_tokens_are_linear(spark):
    n = 32_000
    row = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: k.cast("double") / n).alias("x"))
    began = time.time()
    assert row.select(logprob.log_softmax_at(F.col("x"), F.lit(5))).first()[0] < -9
    tokens = spark.range(1).select(F.array_repeat(F.lit("a"), 20_000).alias("t"))
    assert tokens.select(F.size(objects.merge_bigrams(F.col("t"), {"a a": "b"}))).first()[0] == 10_000
    assert time.time() - began < 30
    empty = spark.createDataFrame([([], 0), (None, 0), ([1.0, None], 0)], "x array<double>, k int")
    assert [r[0] for r in empty.select(logprob.log_softmax_at(F.col("x"), F.col("k"))).collect()][:2] == [None, None]


def test_masks(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    ids = F.array(*[F.lit(k) for k in (5, 1, 7, 2, 8, 1, 7)])
    assert one(conversation.masked_by_marks(ids, [1], [2])) == [-100, -100, -100, -100, 8, -100, -100]
    assert one(conversation.masked_by_marks(ids, [9], [2])) == [-100] * 7
    t = conversation.Template("two", "", ("USER", "ASSISTANT"), " ", "</s>")
    rows = spark.createDataFrame([("USER: a ASSISTANT: b</s>USER: c",), (None,)], "p string")
    got = conversation.masked_rounds(rows, "p", lambda s: [len(w) for w in s.replace("</s>", " | ").split()], t, first=False).collect()
    assert set(got[0].labels) == {-100} and got[1].labels is None  # a round without an answer
    broken = F.array(F.struct(F.lit("user").alias("role"), F.lit("x").alias("text")), F.struct(F.lit("human").alias("role"), F.lit("y").alias("text")))
    assert one(conversation.with_system(broken, "s")) is None
    assert one(conversation.render(F.array(F.struct(F.lit("hi").alias("text"))), conversation.Template("llama_2", "", sep=".*", sep2="</s>"))) == "[INST] hi [/INST]"


def test_weights_equal_difflib(spark):
    a, b = "the red tram stands near the old wall today".split(), "the blue tram stands near the tall new wall today".split()
    got = sequences.modification_weights(spark.createDataFrame([(a, b), (None, b)], "r array<string>, w array<string>"), "r", "w", 3.0).collect()
    # only common runs of three or more words separate the spans
    blocks = [m for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks() if m.size >= 3]
    assert blocks and [k for k, x in enumerate(got[0].rej_weights) if x == 3.0] == sorted(set(range(len(a))) - {m.a + k for m in blocks for k in range(m.size)})
    assert got[1].rej_weights == [] and set(got[1].win_weights) == {1.0}


def test_scorers_try_again_and_time_out(spark):
    class Flaky:
        """Fails twice, then answers; says first that another model answered."""

        def __init__(self):
            self.calls = 0

        def generate(self, prompts):
            self.calls += 1
            if self.calls == 1:
                raise scorer.OtherModel("other")
            if self.calls < 4:
                raise RuntimeError("busy")
            return ["x"] * len(prompts)

        def yes_no(self, prompts):
            time.sleep(2)
            return [(0.1, 0.2, 0.3, 0.4)] * len(prompts)

    rows = spark.createDataFrame([("p",)], "p string").coalesce(1)
    assert scorer.generated(rows, "p", Flaky, attempts=3).first().output == "x"
    failed = scorer.generated(rows, "p", Flaky, attempts=2).first()
    assert failed.output is None and failed.error == "RuntimeError: busy"
    late = scorer.yes_no_scores(rows, "p", Flaky, attempts=1, timeout=0.2).first()
    assert late.yes is None and late.error.startswith("TimeoutError")


def test_images(spark):
    rows = spark.createDataFrame([(1000, 300), (0, 5), (None, 5)], "w int, h int")
    got = rows.select(images.best_resolution(F.col("w"), F.col("h"), [(336, 672), (672, 336), (1008, 336)]).alias("b")).collect()
    assert tuple(got[0].b) == (1008, 336) and got[1].b is None and got[2].b is None


def test_lookup_and_sums(spark):
    sizes = spark.createDataFrame([(0, 3), (1, 0), (2, 40), (3, 1)], "file_no int, n_rows bigint")
    got = {r.pos: (r.file_no, r.row_no) for r in partitions.border_lookup(spark.range(-2, 60).withColumnRenamed("id", "pos"), sizes).collect()}
    assert got == {p: (0, p) if p < 3 else (2, p - 3) if p < 43 else (3, 0) for p in range(44)}
    assert partitions.border_lookup(spark.range(3).withColumnRenamed("id", "pos"), sizes.limit(0)).count() == 0
    sums = {r.id: r.before for r in running_sum(spark.range(50), [F.col("id")], "id").collect()}
    assert sums == {k: k * (k - 1) // 2 for k in range(50)}


def test_files_and_registry(spark, tmp_path):
    files.write_logps(spark.range(7), str(tmp_path), "n", 3, pos="id")
    assert sorted(r.shard for r in files.read_logps(spark, str(tmp_path)).collect()) == [0, 0, 0, 1, 1, 1, 2]
    with pytest.raises(ValueError):
        files.write_logps(spark.range(7), str(tmp_path), "n")
    files.write_json(spark.range(0), str(tmp_path / "e.json"))
    assert files.read_json_any(spark, str(tmp_path / "e.json"), "id int").count() == 0
    plans = Plans()
    plans.query()(test_images)
    with pytest.raises(KeyError):
        plans.query()(test_images)
    match = judging.match_answers(spark.createDataFrame([(1, "a"), (2, "b")], "k int, answer string"), spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "k int, pos int, answer string"), ["k"], "pos", reverse=True)
    assert sorted(tuple(r) for r in match.collect()) == [(1, "y", "a"), (2, "b", None)]
