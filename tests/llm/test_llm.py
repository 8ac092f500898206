"""The operators for training data against brute force, exact round trips and held-out grades, on small fixtures."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import bpe_automaton, languages, leakage, pair_defects, pairwise_ranking, queries, reading_level, similarity_join, truncation
from pairloom.llm.plain_words import plain_words

SMALL = "/root/testdata/sf0.01"


# --- p1 ---------------------------------------------------------------------------------------


def test_ranking_recovers_strengths(spark):
    rng = np.random.default_rng(0)
    strength = np.linspace(2, -2, 7)
    rows, k = [], 0
    for i in range(7):
        for j in range(i + 1, 7):
            if (i, j) == (0, 6):
                continue  # a pair that never meets
            for _ in range(int(rng.integers(40, 400))):
                won = rng.random() < 1 / (1 + np.exp(strength[j] - strength[i]))
                rows.append((k, f" /ckpt/Model_{i}/ " if k % 3 else f"model {i}", f"MODEL-{j}", -1 if won else 1))
                k += 1
    rows += [(k, None, "model-1", 1), (k + 1, "model-1", "MODEL 1", 1), (k + 2, "model-1", "model-2", None), (k + 3, "model-1", "model-2", 9), (k + 4, "stranger", "model-2", 1), rows[0]]
    reviews = spark.createDataFrame(rows, "review_id bigint, modela string, modelb string, score int")
    registry = spark.createDataFrame([(i, f"Model-{i}") for i in range(9)] + [(None, "x")], "model_id int, model_name string")
    got = pairwise_ranking.ranking(reviews, registry).orderBy("rank_no").collect()
    assert [r.model_id for r in got] == list(range(7)) and [r.rank_no for r in got] == list(range(1, 8))
    assert pairwise_ranking.ranking(reviews.limit(0), registry).count() == 0


def test_ranking_of_many_items_with_few_meetings(spark):
    rng = np.random.default_rng(4)
    n = 200
    strength = rng.normal(0, 1.5, n)
    rows = []
    for i in range(n):
        for j in {int(x) for x in rng.integers(0, n, 14)} | {(i + 1) % n}:
            if i != j:
                k = int(rng.integers(4, 60))
                won = int(rng.binomial(k, 1 / (1 + np.exp(strength[j] - strength[i]))))
                rows.append((min(i, j), max(i, j), k, (2 * won - k) * (1 if i < j else -1)))
    pairs = spark.createDataFrame(rows, "i int, j int, n bigint, net bigint").groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("net").alias("net"))
    got = pairwise_ranking.spectral_strengths(pairs).collect()
    assert len(got) == n and all(r.converged for r in got)
    mine = np.array([r.strength for r in sorted(got, key=lambda r: r.item)])
    assert np.corrcoef(mine, strength)[0, 1] > 0.98
    assert np.corrcoef(mine.argsort().argsort(), strength.argsort().argsort())[0, 1] > 0.97


# --- p3, p4 -------------------------------------------------------------------------------------


def sentence(rng):
    return f"The {rng.choice(['red', 'old', 'tall'])} {rng.choice(['kettle', 'tram', 'parrot'])} stands {rng.choice(['near', 'behind'])} the {rng.choice(['market', 'harbour'])} wall."


def test_cut_texts(spark):
    rng = random.Random(1)
    whole = [" ".join(sentence(rng) for _ in range(3)) for _ in range(80)] + ["Yes", "42", "red kettle", "- red tram\n- old kettle", "Total: 31.7", "", "  ", None, "All of it is fine. 🙂", "He left.</s>"] * 3
    cut = ["The red ket", "The old tram stands", "The old tram stands near the market wall. The tall", "The red kettle stands near the harbour wall. The old parrot sta", "The tall parrot stands (near the", "The red tram stands…", "The red tram stands near the ma�"]
    rows = spark.createDataFrame(list(enumerate(whole + cut)), "id bigint, text string")
    got = {r.id for r in truncation.cut_texts(rows).collect()}
    assert got == set(range(len(whole), len(whole) + len(cut)))
    assert truncation.cut_texts(rows.limit(0)).count() == 0


def test_copies_of_a_cut_text_do_not_hide_it(spark):
    longer = [f"Several shadows cross the {a} {b}." for a in ("red", "old", "tall") for b in ("tram", "kettle", "parrot")]
    cut = ["Several shadows cross"] * 40 + ["Several shadows cross the red", "Quiet bells ring over the"]
    whole = ["red kettle", "red kettle, old tram", *longer, "Quiet bells ring over the harbour wall"]
    rows = spark.createDataFrame(list(enumerate(whole + cut)), "id bigint, text string")
    got = {r.id: r.evidence for r in truncation.cut_texts(rows).collect()}
    assert got.keys() == set(range(len(whole), len(whole) + len(cut)))
    assert got[len(whole) + 40] == "segment" and got[len(whole) + 41] == "copy"


def test_every_cut_text_has_a_longer_copy(spark):
    rng = random.Random(8)
    whole = [" ".join(sentence(rng) for _ in range(2)) for _ in range(60)]
    cut = [t[: rng.randint(len(t) // 2, len(t) - 3)] for t in whole[:20]] + ["Zebras quarrel loudly bec"]  # nothing continues the last one
    texts = dict(enumerate(whole + cut))
    got = {r.id: r.copy_id for r in truncation.cut_texts(spark.createDataFrame(list(texts.items()), "id bigint, text string")).collect()}
    assert set(range(60, 80)) - got.keys() <= {k for k in range(60, 80) if texts[k].strip().endswith(".")} and 80 not in got
    for k, c in got.items():
        assert c != k and " ".join(texts[k].lower().split(".")[-1].split()[-2:]) in texts[c].lower().replace(".", " ").replace("  ", " ")


def test_strict_prefixes(spark):
    texts = ["a", "ab", "abc", "b", "ca", "ca", None, ""]
    got = truncation.strict_prefixes(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert sorted(r.text for r in got.collect()) == ["a", "ab"]


def test_pair_defects(spark):
    good = "The red kettle stands near the market wall. The old tram stands behind it."
    q = "What is near the market wall?"
    sides = {
        "empty": [None, "", " &nbsp;<br/> ", "...", "</s>", "​"],
        "copies_question": [q, q.upper(), f'You asked: "{q}"', f"{q}\n{q}", f"USER: {q} ASSISTANT:"],
        "refusal": ["I'm sorry, but I can't help with that.", "I cannot answer that. Please try another question.", "抱歉，我无法回答。"],
        "other_language": ["En la imagen se ve una mesa grande cerca de la cocina.", "光线照在一把雨伞上，车站显得很干净。"],
        "truncated": ["The red kettle stands near the market wall. The old tram st"],
        None: [good, "Yes", 'The sign says "Sorry, we are closed" and the kettle is red.', "The face cannot be seen because the kettle blocks it.", "I cannot make out the brand, but the kettle is red."],
    }
    rows = [(k, q, good, a) for k, (_, a) in enumerate((d, a) for d, xs in sides.items() for a in xs)]
    want = {(k, "rejected", d) for k, d in enumerate(d for d, xs in sides.items() for _ in xs) if d}
    rows += [(100, q + " Answer in Spanish.", "En la imagen se ve una mesa grande cerca de la cocina.", good), (None, q, "", ""), rows[0]]
    df = spark.createDataFrame(rows, "pair_id bigint, question string, chosen string, rejected string").withColumn("side", F.lit("clash"))
    assert {tuple(r) for r in pair_defects.defects(df).collect()} == want
    assert pair_defects.defects(df.limit(0)).count() == 0


def test_a_cue_followed_by_other_content_is_no_refusal(spark):
    good = "The red kettle stands near the market wall."
    said = ["I cannot say what brand the mug is. The red mug stands on the table.", "I cannot say what brand the mug is. Please ask someone else."]
    df = spark.createDataFrame([(k, f"What is it, {k}?", good, a) for k, a in enumerate(said)], "pair_id bigint, question string, chosen string, rejected string")
    assert {tuple(r) for r in pair_defects.defects(df).collect()} == {(1, "rejected", "refusal")}


def test_long_refusals_that_recur(spark):
    good = "The red kettle stands near the market wall."
    opening = "I must decline to answer this question about the attached photo."
    policy = " ".join(f"The service that answers here keeps to rule {w} of the terms that hold for all of its users." for w in ("one", "two", "three"))
    said = [f"{opening} {policy}"] * 4 + [f"{opening} A tall parrot sits on the harbour wall."]
    df = spark.createDataFrame([(k, f"What is it, {k}?", good, a) for k, a in enumerate(said)], "pair_id bigint, question string, chosen string, rejected string")
    assert {tuple(r) for r in pair_defects.defects(df).collect()} == {(k, "rejected", "refusal") for k in range(4)}


def test_templates_without_cue_words(spark):
    rng = random.Random(9)
    topics = [f"{a} {b} of the {c} {k}?" for k, (a, b, c) in enumerate((a, b, c) for a in ("What", "Describe", "Count", "Where", "Name") for b in ("is", "all", "any") for c in ("wall", "market", "tram", "kettle"))]
    template = "Matters of such a kind stay firmly between me and my makers."
    rows = [(k, q, " ".join(sentence(rng) for _ in range(4)), template) for k, q in enumerate(topics)]
    rows += [(100 + k, f"What is number {k}?", sentence(rng), " ".join(sentence(rng) for _ in range(3))) for k in range(60)]
    df = spark.createDataFrame(rows, "pair_id bigint, question string, chosen string, rejected string")
    assert {tuple(r) for r in pair_defects.defects(df).collect()} == {(k, "rejected", "refusal") for k in range(len(topics))}


def test_long_and_foreign_refusals_and_languages(spark):
    rng = random.Random(10)
    long = "I'm sorry, but I can't help with that. " + " ".join(f"The team behind this service keeps to rule {w} of its terms at all times and for all of its users." for w in ("one", "two", "three", "four"))
    refusals = [long] * 20 + ["Mi dispiace, ma non posso aiutarti con questa richiesta.", "申し訳ありませんが、お答えできません。", "죄송하지만 도와드릴 수 없습니다.", "Desculpe, não posso ajudar com isso."]
    foreign = ["Na obrazku widać czerwony czajnik stojący obok ściany targu, a za nim stary tramwaj.", "Trong hình có một chiếc ấm đun nước màu đỏ đứng gần bức tường của chợ.", "चित्र में एक लाल केतली बाजार की दीवार के पास खड़ी है।"]
    rows = [(k, f"What is number {k}?", sentence(rng), a) for k, a in enumerate(refusals + foreign)]
    rows += [(1000 + k, f"What is near the wall number {k}?", " ".join(sentence(rng) for _ in range(3)), sentence(rng)) for k in range(300)]
    df = spark.createDataFrame(rows, "pair_id bigint, question string, chosen string, rejected string")
    want = {(k, "rejected", "refusal") for k in range(len(refusals))} | {(len(refusals) + k, "rejected", "other_language") for k in range(len(foreign))}
    assert {tuple(r) for r in pair_defects.defects(df).collect()} == want


@pytest.mark.parametrize("direct", [64, 2])
def test_clusters_link_all_similar_members_of_a_band(spark, monkeypatch, direct):
    monkeypatch.setattr(pair_defects, "DIRECT", direct)
    rng = random.Random(direct)
    core = [f"w{k:02d}" for k in range(40)]
    openings = set()
    for _ in range(60):  # with one band of no hash rows all openings share it; many are far from the least
        w = list(core)
        for k in rng.sample([0, 1, 2, 20, 37, 38, 39], rng.randint(0, 4)):
            w[k] = rng.choice("ab") + str(k)
        openings.add(" ".join(w))
    runs = {o: {tuple(o.split()[k : k + 5]) for k in range(36)} for o in openings}
    want = {o: o for o in openings}
    for _ in openings:
        want = {o: min(want[p] for p in openings if len(runs[o] & runs[p]) >= 0.8 * len(runs[o] | runs[p]) - 1e-9) for o in openings}
    df = spark.createDataFrame([(o,) for o in openings], "opening string")
    got = {r.opening: r.cluster for r in pair_defects.opening_clusters(df, bands=1, rows=0).collect()}
    assert got == want and len(set(want.values())) > 1


def test_large_bands_are_split_without_rounds(spark, monkeypatch):
    # 1,350 openings of one band: dissimilar ones share single runs, similar ones all but a few; a round for each few of them took hundreds
    rng = random.Random(4)
    words, openings = [f"w{k}" for k in range(12)], set()
    for k in range(450):
        a = rng.choices(words, k=rng.choice([5, 7, 9, 13, 20, 31])) + [f"x{k}"]
        openings |= {" ".join(a), " ".join([*a, "y"]), " ".join([*a, "y", "z"])}
    runs = {o: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for o in openings for w in [o.split()]}
    parent = {o: o for o in openings}

    def root(o):
        while parent[o] != o:
            o = parent[o]
        return o

    for a in sorted(openings):
        for b in openings:
            if a < b and len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b]) - 1e-9 and root(a) != root(b):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    rounds, stage = [], pair_defects.stage
    monkeypatch.setattr(pair_defects, "stage", lambda df, name: (rounds.append(name), stage(df, name))[1])
    df = spark.createDataFrame([(o,) for o in openings], "opening string")
    got = {r.opening: r.cluster for r in pair_defects.opening_clusters(df, bands=1, rows=0).collect()}
    assert got == {o: root(o) for o in openings} and len(set(got.values())) < len(openings)
    assert rounds.count("judged") == 2


def test_languages_are_learnt_from_the_whole_corpus(spark):
    polish = "na tym zdjęciu widać czerwony czajnik obok ściany"
    texts = ["The red kettle stands near the market wall."] * 50 + ["Ein alter Mann sitzt auf der Bank und liest die Zeitung."]
    for order in (texts, texts[::-1]):
        known = languages.fitted(spark.createDataFrame([(t,) for t in order], "text string").repartition(3), 7)
        want = np.bincount(languages._Flat(["Ein alter Mann sitzt auf der Bank und liest die Zeitung"]).trigrams() + 1, minlength=64**3 + 1)[1:]
        assert np.array_equal(known.tables[0], languages.Languages._trained("de", want))  # the one German text counts, wherever it stands
        assert known.main(["Eine alte Frau liest die Zeitung.", "The old kettle stands here.", polish])[:2] == ["de", "en"]
    assert languages.fitted(spark.createDataFrame([], "text string")).main(["The kettle is on the wall."]) == ["en"]


def test_a_piece_without_a_leading_language_teaches_none():
    known = languages.Languages(np.zeros((6, 64**3), int))
    flat = languages._Flat(["- umbrella", "Das ist ein Haus und es ist sehr alt"])
    assert known.labels(flat, np.array([-1, 1])).tolist() == [known._scores(flat)[0].argmin(), 1]
    known.tables = known.tables[:1] * 6
    assert known.labels(flat, np.array([-1, 1])).tolist() == [-1, 1]


# --- p5 -----------------------------------------------------------------------------------------


def brute_pairs(sets, t):
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("list_size", [4096, 8])
def test_similarity_join_equals_brute_force(spark, list_size, monkeypatch):
    monkeypatch.setattr(similarity_join, "CROWDED", 0.6 if list_size == 8 else 0.0)  # both ways of counting elements
    rng = random.Random(list_size)
    sets = {}
    for base in range(12):
        core = [rng.getrandbits(63) for _ in range(rng.randint(5, 40))]
        for v in range(6):
            sets[base * 6 + v] = {x for x in core if rng.random() > 0.15 * (v % 3)} | {rng.getrandbits(63) for _ in range(v)}
    for k in range(30):
        sets[100 + k] = set(core)  # a group of copies that holds many rows
    rows = [(k, [x - (1 << 62) for x in s] + [x - (1 << 62) for x in list(s)[:1]]) for k, s in sets.items()] + [(None, [1]), (900, []), (901, None)]
    df = spark.createDataFrame(rows, "id bigint, tokens array<bigint>")
    got = similarity_join.similar_sets(df, 0.6, list_size=list_size)
    assert {tuple(r) for r in got.pairs(block=7).collect()} == brute_pairs(sets, 0.6)
    if list_size == 8:
        assert got.classes().count() == len(sets)
        group = {k: k for k in sets}
        for _ in sets:
            for a, b in brute_pairs(sets, 0.6):
                group[a] = group[b] = min(group[a], group[b])
        assert {r.id: r.group_id for r in got.groups().collect()} == group
        assert {r.o == len(sets[r.a] & sets[r.b]) for r in got.links.collect()} == {True}
        assert similarity_join.similar_sets(df.limit(0), 0.6).pairs().count() == 0


def test_classes_keep_every_answer(spark, tmp_path):
    rows = [(1, "What colour is the tram?", "Unclear"), (2, "What colour is the tram?", "unclear."), (3, "Why?", "Yes"), (4, "why", "Yes."), (5, "Why?", "No"), (6, "Why?", None), (7, None, None), (8, "What is it?", "The red kettle stands near the wall."), (None, "Why?", "Yes"), (1, "What colour is the tram?", "Unclear")]
    spark.createDataFrame(rows, "question_id bigint, raw_question string, answer string").write.parquet(f"{tmp_path}/candidate_answers.parquet")
    got = sorted(tuple(r) for r in queries.p5_classes(spark, str(tmp_path)).select("question_id", "class_id", "n_links").collect())
    assert got == [(1, 1, 0), (2, 1, 0), (3, 3, 0), (4, 3, 0), (5, 5, 0), (6, 6, 0), (7, 7, 0), (8, 8, 0)]


# --- p6 -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return bpe_automaton.Encoder(*bpe_automaton.read_merges(f"{bpe_automaton.TOKENIZERS}/byte_bpe_50k.json"))


def test_encoding_equals_a_public_tokenizer(encoder):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{bpe_automaton.TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    rng = random.Random(2)
    texts = ["", " ", "<|endoftext|>", "a" * 3000, "\n\n \t x", "naïve café 中文 🙂👩‍🌾", "It's 100,000.50 m²"]
    for alphabet in ("ab", "aA 1'", "中文é ", "".join(map(chr, range(32, 900)))):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == other.encode(t, add_special_tokens=False).ids
        assert encoder.automaton.decode(ids) == t.encode()
    assert encoder.encode(None) == []


def merged(word, merges):
    parts = [bytes([b]) for b in word]
    for x, y in merges:
        i = 0
        while i + 1 < len(parts):
            if (parts[i], parts[i + 1]) == (x, y):
                parts[i : i + 2] = [x + y]
            i += 1
    return parts


def test_automaton_equals_merging_by_rank():
    rng = random.Random(7)
    for _ in range(40):
        merges, known = [], [b"a", b"b", b"c"]
        for _ in range(12):
            x, y = rng.choice(known), rng.choice(known)
            if x + y not in known:
                merges.append((x, y))
                known.append(x + y)
        a = bpe_automaton.Automaton({t: i for i, t in enumerate([bytes([b]) for b in range(256)] + known[3:])}, merges)
        for _ in range(60):
            w = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12)))
            assert [a.labels[i] for i in a.encode_word(w)] == merged(w, merges)


def test_encode_table(spark):
    rows = spark.createDataFrame([(1, "hello world", "x"), (2, None, "y"), (3, "", "z"), (1, "hello world", "x")], "doc_id bigint, text string, ids string")
    got = bpe_automaton.encode_table(rows, "doc_id", "text").collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in got) == [(1, (31373, 995)), (1, (31373, 995)), (2, ()), (3, ())]
    assert bpe_automaton.encode_table(rows.limit(0), "doc_id", "text").count() == 0


# --- p7 -----------------------------------------------------------------------------------------


def test_plain_words():
    assert plain_words("The <b>Uzj\xaddyx</b>&nbsp;pill​ow,<br/>ＴＨＥ été") == ["the", "uzjdyx", "pillow", "the", "ete"]
    assert plain_words(None) == plain_words(" <p> ") == []


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(30))) for k in range(12)] + [(50, "short item"), (51, None), (None, "x " * 20)]
    docs = []
    for d in range(60):
        words = [rng.choice(vocabulary) for _ in range(50)]
        own = items[d % 12][1].split()
        n = rng.choice([5, 11, 12, 13, 30])
        at = rng.randint(0, 30 - n)
        passage = [w.upper() for w in own[at : at + n]]
        docs.append((d, ", ".join(words[:20] + passage + words[20:])))
    docs.append((98, " ".join(items[0][1].split()[15:] + ["zz"] + items[0][1].split()[:15])))
    docs += [(99, None), (97, "")]
    got = leakage.leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, gt_answer string"), block_words=100).collect()
    runs = defaultdict(set)
    for i, t in items:
        if i is not None and t and len(t.split()) >= 12:
            for k in range(len(t.split()) - 11):
                runs[tuple(t.split()[k : k + 12])].add(i)
    want = {(d, i) for d, t in docs if t for w in [t.lower().replace(",", "").split()] for k in range(len(w) - 11) for i in runs.get(tuple(w[k : k + 12]), ())}
    assert {(r.doc_id, r.item_id) for r in got} == want and want
    assert next(r.coverage for r in got if (r.doc_id, r.item_id) == (98, 0)) == 1.0  # both halves, in another order


def test_passages_in_short_reordered_pieces(spark):
    words = [f"w{k}" for k in range(40)]
    pieces = [words[k : k + 8] for k in range(0, 40, 8)]
    shuffled = [w for k in (3, 0, 4, 2, 1) for w in [*pieces[k], "zz", "yy"]]
    documents = spark.createDataFrame([(1, " ".join(shuffled)), (2, " ".join(words[:9])), (3, " ".join(words[:13]))], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(words))], "item_id bigint, gt_answer string")
    assert {r.doc_id for r in leakage.leaked(documents, items).collect()} == {3}
    assert {r.doc_id: (r.longest, r.coverage) for r in leakage.leaked(documents, items, tile=6).collect()} == {1: (8, 1.0), 3: (13, 13 / 40)}


# --- p8 -----------------------------------------------------------------------------------------


def test_isotonic_fit():
    x, fit = reading_level.isotonic(np.array([3.0, 1, 2, 4, 4]), np.array([2.0, 1, 3, 5, 7]))
    assert x.tolist() == [1, 2, 3, 4] and fit.tolist() == [1, 2.5, 2.5, 6]


def test_levels_agree_with_grades_of_documents_not_seen(spark):
    documents, grades = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "doc_grades"))
    got = {r.doc_id: r.level_no for r in reading_level.reading_levels(documents, grades).collect()}
    given = defaultdict(list)
    for r in grades.where("level_no between 1 and 4").distinct().collect():
        given[r.doc_id].append(r.level_no)
    same = [got[d] == g[0] for d, g in given.items() if d in got and len(set(g)) == 1]
    assert len(same) > 60 and np.mean(same) > 0.9  # each document is scored by models of the other parts
    assert reading_level.reading_levels(documents.union(documents), grades).count() == len(got)
    assert reading_level.language_models(documents, 2000).main(["Außerdem gibt es einen Regenschirm neben ein Gemälde, alles ist sauber.", "The red kettle stands near the wall."]) == ["de", "en"]
    assert reading_level.reading_levels(documents.limit(0), grades).count() == 0 == reading_level.reading_levels(documents, grades.limit(0)).count()


# --- all -----------------------------------------------------------------------------------------


def test_every_problem_has_its_query():
    assert {f"p{n}_{'ids' if n == 6 else 'found'}" for n in (1, 3, 4, 5, 6, 7, 8)} <= queries.QUERIES.keys()
