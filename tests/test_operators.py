"""Edge rows of the core operators."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.core.staging import ranked, shared_folder
from pairloom.functions import text as X
from pairloom.operators import conversation, logprob, objects, partitions, preference, scorer, sequences
from pairloom.sources import files
from pairloom.streaming.resume import run_once


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column).first()[0]


@pytest.mark.parametrize("text", ["", " a", "a\xa0b　c", "x\x85y\x1cz ", "one  two"])
def test_words_and_strip_equal_python(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(X.word_count(F.col("t")).alias("n"), X.word_count_single_space(F.col("t")).alias("m"), X.strip_all(F.col("t")).alias("s")).first()
    assert (df.n, df.m, df.s) == (len(text.split()), len(text.strip().split(" ")), text.strip())


def test_text_parsers(spark):
    rows = spark.createDataFrame([("[[B]] [[A]]", "rating: 10", '["a", "b"]'), ("none", "Rating: 2 rating: 3", 'say\n["c"]'), (None, None, None)], "v string, r string, o string")
    got = rows.select(X.verdict(F.col("v")), X.rating(F.col("r")), X.object_list(F.col("o"))).collect()
    assert [tuple(x) for x in got] == [(1, 1, ["a", "b"]), (None, 0, ["c"]), (None, 0, None)]
    assert one(spark, X.facts_from_text(F.lit("\n- a\n### h\nbc\n   \n- d "))) == ["a", "c", "", "d"]


def test_labels_and_pairs(spark):
    half = F.lit(0.5)
    assert one(spark, preference.yes_label(half, F.lit(0.0), half, F.lit(0.0))) == 0
    rows = spark.createDataFrame([("g", 1, 0), ("g", 2, -1), ("g", 3, None), (None, 4, -5), ("h", 5, 0)], "g string, id int, s int")
    assert [tuple(r) for r in preference.score_pairs(rows, ["g"], "id", "s", 1).collect()] == [("g", 1, 2, 0, -1)]
    assert preference.score_pairs(rows.limit(0), ["g"], "id", "s", 1).count() == 0


def test_first_runs_equal_a_loop(spark):
    rng = random.Random(3)
    for _ in range(3):
        keys = [rng.randint(0, 6) for _ in range(60)]
        seen, last, want = set(), None, []
        for p, k in enumerate(keys):
            if k not in seen:
                seen.add(k)
                last = k
            if k == last:
                want.append(p)
        got = preference.first_runs(spark.createDataFrame(list(enumerate(keys)), "pos int, k int"), ["k"], "pos", 7)
        assert sorted(r.pos for r in got.collect()) == want


def test_length_filter(spark):
    rows = [("a b", "a b c d"), ("same", " same "), ("x", ""), (None, "a"), ("a b c", "a b")]
    got = spark.createDataFrame(rows, "c string, r string").select(preference.length_kept(F.col("c"), F.col("r"), 0.5)).collect()
    assert [r[0] for r in got] == [True, False, False, False, True]


def test_map_keeps_the_last_label(spark):
    rows = spark.createDataFrame([(1, "q", "0", 1), (1, "q", "1", 2), (1, None, "1", 3)], "id int, q string, l string, p int")
    assert preference.judge_maps(rows, "id", "q", "l", "p").first()["judge"] == {"q": "1"}


def test_partitions(spark):
    for n, w in [(10, 8), (7, 7), (3, 5), (100, 9)]:
        rows = spark.range(n).select(F.col("id").alias("pos"))
        got = [r[0] for r in rows.orderBy("pos").select(partitions.shard_of(F.col("pos"), n, w)).collect()]
        q, r = divmod(n, w)
        assert got == [s for s in range(w) for _ in range(q + (s < r))]
    rows = spark.range(10).select(F.col("id").alias("pos"))
    assert partitions.slice_rows(rows, 2, 0, 10).count() == 0
    assert partitions.slice_rows(rows, 2, -1, 10).count() == 8 == partitions.slice_rows(rows, 2, 99, 10, "b").count()
    with pytest.raises(ValueError):
        partitions.interleave(spark, [(0, 1)])
    mixed = [(r.source, r.inner) for r in partitions.interleave(spark, [(4, 2), (1, 1)]).orderBy("pos").collect()]
    assert mixed == [(0, 0), (0, 1), (1, 0), (0, 2), (0, 3), (1, 0)]


def greedy(tokens, pairs):
    out, i = [], 0
    while i < len(tokens):
        two = " ".join(tokens[i : i + 2])
        if i + 1 < len(tokens) and two in pairs:
            out.append(pairs[two])
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


def test_bigram_merge_equals_a_loop(spark):
    pairs = {"a b": "AB", "b a": "BA", "b b": "BB"}
    rng = random.Random(5)
    rows = [([rng.choice("abc") for _ in range(rng.randint(0, 7))],) for _ in range(60)] + [(None,)]
    got = spark.createDataFrame(rows, "t array<string>").select("t", objects.merge_bigrams(F.col("t"), pairs).alias("m")).collect()
    assert all(r.m == (None if r.t is None else greedy(r.t, pairs)) for r in got)


def test_toilet_seat(spark):
    classes = F.create_map(F.lit("toilet"), F.lit("toilet"), F.lit("seat"), F.lit("chair"))
    assert [x.word for x in one(spark, objects.known_objects(F.array(F.lit("toilet"), F.lit("seat"), F.lit("x")), classes))] == ["toilet"]


def test_logprobs(spark):
    logits, labels = [[1.0, 2.0, 3.0], [0.5, 0.1, 0.2], [9.0, 0.0, 1.0]], [0, 2, -100]
    lp = one(spark, logprob.token_logps(F.col("x"), F.col("y")), x=logits, y=labels)
    want = [logits[0][2] - math.log(sum(map(math.exp, logits[0]))), logits[1][0] - math.log(sum(map(math.exp, logits[1])))]
    assert lp == pytest.approx(want)
    df = spark.createDataFrame([([1.0, 2.0], [-100, -100])], "p array<double>, k array<int>").select(*logprob.masked_sums(F.col("p"), F.col("k"))).first()
    assert df.logp_sum == 0 and df.logp_mean is None
    loss = spark.range(1).select(*logprob.dpo_terms(F.lit(-800.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), 1.0)).first().loss
    assert loss == pytest.approx(800)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=25))
def test_replaced_spans_lie_outside_common_runs(a, b):
    x, y = sequences.replaced_spans(a, b)
    assert x == sorted(set(x)) and y == sorted(set(y)) and bool(x) == bool(y)
    if a == b and len(a) >= 3:
        assert not x


def test_rendering(spark):
    t = F.array(F.struct(F.lit("hi").alias("text")), F.struct(F.lit("").alias("text")))
    assert one(spark, conversation.render(t, conversation.Template("two", "S", ("U", "A"), " ", "</s>"))) == "S U: hi A:"
    assert one(spark, conversation.render(t, conversation.Template("llama_2", "S", sep="<s>", sep2="</s>"))) == "[INST] <<SYS>>\nS\n<</SYS>>\n\nhi [/INST]"


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.jsonl").write_text('{"x": 1}\nbroken\n{"x": 3}\n')
    (tmp_path / "c.json").write_text('[\n {"x": 1},\n {"x": 5}\n]')
    assert [r.x for r in files.read_json_any(spark, str(tmp_path / "a.jsonl"), "x int").orderBy("pos").collect()] == [1, 2]
    assert [r.x for r in files.read_json_any(spark, str(tmp_path / "c.json"), "x int").orderBy("pos").collect()] == [1, 5]
    good, bad = files.read_tolerant(spark, str(tmp_path / "b.jsonl"), "x int")
    assert sorted(r.x for r in good.collect()) == [1, 3] and [r.value for r in bad.collect()] == ["broken"]
    (tmp_path / "t-2.tsv").write_text("ds\t a \tb\nds\tc\td \n")
    assert [(r.pos, r.c1, r.c2) for r in files.read_tsv(spark, str(tmp_path / "t-2.tsv"), 3).orderBy("pos").collect()] == [(0, "a", "b"), (1, "c", "d")]
    assert files.rows_in_name("t-2.tsv") == 2 and files.find_files(spark, str(tmp_path), ".tsv") and files.read_logps(spark, str(tmp_path)) is None
    files.write_logps(spark.range(12), str(tmp_path), "n", 5)
    assert files.read_logps(spark, str(tmp_path)).count() == 12


def test_resumed_run_has_each_key_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    args = (spark, str(source), "k int", lambda d: scorer.generated(d.withColumn("p", F.col("k").cast("string")), "p", scorer.StubScorer), str(tmp_path / "out"), str(tmp_path / "cp"), "k")
    (source / "1.json").write_text('{"k": 1}\n{"k": 1}\n{"k": 2}\n')
    run_once(*args)
    (source / "2.json").write_text('{"k": 2}\n{"k": 3}\n')
    run_once(*args)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_ranks_and_folder(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    assert all(r.n == r.v + 1 for r in ranked(rows, [F.asc("v")], "n").collect())
    assert shared_folder(spark) == shared_folder(spark)
