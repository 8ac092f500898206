"""Defects of the answers in question and answer pairs.

Refusals are found by their openings.  The first sentences of all answers are reduced to distinct
texts; their five-word runs get MinHash signatures; of the openings that share a band all pairs at
least 0.8 similar are linked, and what is linked forms a cluster.  A cluster is a stock text, and so
a refusal whatever its words, if

* it recurs across unrelated prompts: at least ``template_prompts`` different ones, no two first words
  of which hold most, and it repeats few of their words;
* it is fixed: of the answers that begin with the first half of its words, nearly all go on as it
  does, while a sentence of a description goes on with what is shown;
* it stands at the head of answers only, while what describes a picture is also said further down.

A cluster seen under ``least_prompts`` prompts or more is a refusal as well if most of its openings decline by cue
words; an opening too rare to tell must decline by its own words.  In all cases the sentences after the opening may say nothing of the
picture: each declines too, is a courtesy, or recurs across prompts after openings of the same
cluster.  Copy, language and termination checks label the other defects.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.core.components import connected
from pairloom.core.staging import stage
from pairloom.llm import languages
from pairloom.llm.plain_words import without_markup
from pairloom.llm.similarity_join import word_runs
from pairloom.llm.truncation import cut_texts

#: Cues by which an opening declines, as patterns over lower-case text with straight apostrophes.
REFUSAL_CUES = [
    r"\b(?:i|we) (?:am|'m|are)? ?(?:sorry|afraid)\b.*\b(?:can't|cannot|can not|unable|won't|not able)\b",
    r"\b(?:sorry|unfortunately|regrettably|apologi[sz]e|as an? (?:ai|language model|assistant))\b.*\b(?:unable|not able|can't|cannot|can not|won't|no way|rather not|pass|decline|not allowed)\b",
    r"\b(?:i|we) (?:really )?(?:can't|cannot|can not|am unable to|am not able to|'m unable to|'m not able to|won't be able to|won't|will not|am not allowed to|must decline to|decline to|refuse to|have to decline|must refuse)(?: (?:be able to|really|possibly|help|to|with))* ?(?:answer|assist|help|respond|describe|provide|discuss|comment|share|say|see|view|look|open|access|fulfil|fulfill|comply|do (?:that|this)|talk|identify|process)\b",
    r"\bi (?:must|have to) (?:decline|refuse|pass)\b",
    r"\b(?:i|we) (?:do not|don't) have (?:the )?(?:ability|permission|access)\b",
    r"\b(?:unable|not able) to (?:assist|help|answer|respond|comply|fulfil|fulfill)\b",
    r"\brequest (?:can't|cannot|can not|could not) be (?:fulfilled|answered|processed|completed)\b",
    r"\b(?:guidelines|policy|policies|rules) (?:do|does)(?: not|n't) (?:allow|permit|let)\b",
    r"\bno (?:image|picture|photo|attachment|file) (?:was|has been|is) (?:provided|attached|given|uploaded)\b",
    r"\b(?:outside|beyond) (?:of )?(?:what|the scope of what) i (?:am|can|'m)\b",
    r"\b(?:isn't|is not|it's not|not) possible for me to\b",
    r"\bno way for me to\b",
    r"\b(?:i'd|i would) rather not\b",
    r"(?:抱歉|对不起|不好意思|很遗憾).*(?:无法|不能|没法|不可以)|我(?:无法|不能)(?:回答|查看|帮助|协助|描述|提供)",
    r"\b(?:no me es posible|no puedo|no podemos|no es posible para mí) (?:responder|ayudar|contestar|describir|ver|proporcionar|asistir|hacer)",
    r"\b(?:lo siento|lamento|lamentablemente|me temo)\b.*\bno (?:puedo|me es|es)\b",
    r"\b(?:leider|tut mir leid|entschuldigung)\b.*\b(?:nicht|kein|keine|unmöglich)\b|\bich kann (?:ihnen |dir |diese |dabei |das )*.*nicht (?:beantworten|helfen|beschreiben|sehen)",
    r"\b(?:désolée?|malheureusement|je regrette)\b.*\b(?:pas|impossible)\b|\b(?:il m'est impossible|je ne peux pas|je ne suis pas en mesure)\b",
    r"(?:извините|простите|к сожалению|сожалею).*(?:не могу|не мог|невозможно|нельзя)|\bя не могу (?:ответить|помочь|описать|посмотреть|увидеть)|\bне могу (?:ответить|помочь)",
    r"\b(?:mi dispiace|purtroppo|spiacente)\b.*\bnon (?:posso|è|sono|mi)\b|\bnon (?:posso|sono in grado di) (?:aiutar|rispondere|descrivere|vedere|assister)",
    r"\b(?:desculpe|lamento|infelizmente|sinto muito)\b.*\bnão (?:posso|consigo|é|estou)\b|\bnão (?:posso|consigo) (?:ajudar|responder|descrever|ver)\b",
    r"(?:申し訳|すみません|ごめんなさい|残念ながら).*(?:できません|できかねます|お答え|ません)|(?:お答え|お手伝い|説明|対応)(?:することは|は)?でき(?:ません|かねます)",
    r"(?:죄송|미안|유감).*(?:없습니다|어렵습니다|없어요|못합니다)|(?:답변|도와|도움|설명).*(?:수 없습니다|수 없어요)",
]
#: Words of which every Latin cue has one; only openings that have one, or characters from ``_OTHER_SCRIPTS`` on, are tried for cues.
CUE_WORDS = frozenset("able afraid ai apologise apologize assistant beyond dispiace désolé désolée entschuldigung guidelines i ich il je language leid leider malheureusement no non não lamentablemente infelizmente outside policies policy possible purtroppo regrettably request rules sorry spiacente unable unfortunately we".split())
_OTHER_SCRIPTS = "\u0400"
#: Words by which a copied question may be introduced or followed.
FRAMES = frozenset("a answer answered asked assistant bot human prompt q question said system the user you human's".split())

_HAN = "⺀-⻿⼀-⿕々〇〡-〩〸-〻㐀-䶿一-鿿豈-﫿\U00020000-\U000323af"
_cue = re.compile("|".join(f"(?:{c})" for c in REFUSAL_CUES), re.DOTALL).search
_special = re.compile(r"<\|[^<>|]*\|>|</?s>|\[/?(?:INST|PAD|EOS|BOS)\]")
_token = re.compile(rf"[{_HAN}]|[^\W_{_HAN}]+").findall
_tokens = re.compile(rf"[{_HAN}]|[^\W_{_HAN}]+").finditer
_any_token = re.compile(r"[^\W_]").search
#: Words, line ends and the marks that end a sentence, in one pass.
_parts = re.compile(rf"[{_HAN}]|[^\W_{_HAN}]+|\n|[.!?]+(?=[\s\"'”)]|\Z)|[。！？]").findall
_unseen = regex.compile(r"\p{Cf}")
_first = re.compile(r"\A[^\n]*?(?:[.!?]+(?=[\s\"'”)]|\Z)|[。！？]|(?=\n|\Z))").match
_detail = re.compile(r"\bbut (?!i\b|i'm|can't|cannot|unable)(?:the|it|there|you can|what)\b").search
_sentence = re.compile(r"[^\n]+?(?:[.!?]+(?=[\s\"'”)]|\Z)|[。！？]|(?=\n|\Z))").finditer
#: Sentences that speak to the user and not of the picture, over lower-case text with straight apostrophes.
_courtesy = re.compile(
    r"\A\W*(?:please|thanks?|sorry|(?:i|we) apologi[sz]e|i(?:'m| am) (?:very |really |truly |so )?sorry|if you|you (?:can|could|may|might) (?:try|ask|upload|contact|rephrase)|por favor|gracias|bitte|danke|merci|s'il (?:vous|te)|пожалуйста|спасибо|请|谢谢|抱歉|对不起)"
    r"|\b(?:let me know|feel free|thank you for|(?:my|our) (?:guidelines|policy|policies|rules))\b"
    r"|\b(?:i|we)(?:'m|'d|'ll| am| are| would| will| can| could)(?: be)?(?: only| still| always)? (?:happy|glad|able to|here to|help|assist)\b"
    r"|\bi(?:'m| am) (?:just |only )?an? (?:ai|assistant|language model)\b|[?？]\W*\Z",
).search
#: Words of a run, and of a sentence that is looked for further down.
RUN = 5
#: Members of a band, rejected by its least one, up to which all their pairs are compared at once; 64 times as many after the split.
DIRECT = 64
#: Repetitions of what a hot opening is joined with.
SALTS = 16
SIDES = ("chosen", "rejected")


def _normal(text: str) -> str:
    return text.lower().replace("’", "'")


def _hash(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63)


def examine(question: str | None, answer: str | None) -> dict | None:
    """What the pair shows by itself but for its languages: None if the answer is empty, else

    text: the answer without markup; opening: the words of its first sentence; half: hash of the first half of
    these, place: hash of all; declines: whether it does by its own words; rest: what follows it;
    later: hashes of the sentences of ``RUN`` words or more in it; head: the question's first two
    words; echo: share of the opening's words that the question has; copies: whether the answer copies the question.
    """
    text = without_markup(answer or "")
    if "<" in text or "[" in text:
        text = _special.sub(" ", text)
    if not text.isascii():
        text = _unseen.sub("", text)
    text = text.strip()
    lower = text.lower()
    if not _any_token(lower):
        return None
    first = _first(text)
    low = _normal(first[0].strip())
    asked = _token((question or "").lower())
    own, copies = set(asked), False
    if asked and all(m[0] in own or m[0] in FRAMES for m in _tokens(lower)):
        said = [w for w in _token(lower) if w not in FRAMES or w in own]
        copies = bool(said) and len(set(said)) >= 0.8 * len(own) and _in_order(asked, said)
    opening, rest = _token(low), text[first.end() :]
    later, words = [], []
    for p in _parts(rest.lower()):
        if p[0].isalnum():
            words.append(p)
        elif words:
            if len(words) >= RUN:
                later.append(_hash(words))
            words = []
    if len(words) >= RUN:
        later.append(_hash(words))
    echo = sum(w in own for w in opening) / max(1, len(opening))
    return {"text": text, "opening": " ".join(opening), "half": _hash(opening[: max(1, len(opening) // 2)]), "place": _hash(opening), "declines": _declines(low, opening), "rest": rest, "later": later, "head": " ".join(asked[:2]), "echo": echo, "copies": copies}


def other_language(texts: list[str], questions: list[str], known: languages.Languages) -> list[bool]:
    """Whether at least half of each text is in a language that is neither its question's nor named in it."""
    out = []
    distinct = list(dict.fromkeys(questions))
    asked = {q: (code, {code, None} | languages.requested_languages(q)) for q, code in zip(distinct, known.main(distinct), strict=True)}
    for shares, question in zip(known.shares(texts), questions, strict=True):
        language, wanted = asked[question]
        out.append(bool(language) and language != languages.FOREIGN and sum(v for k, v in shares.items() if k not in wanted) >= 0.5)
    return out


def _declines(low: str, words: list[str]) -> bool:
    may = not CUE_WORDS.isdisjoint(words) or (bool(low) and max(low) >= _OTHER_SCRIPTS)
    return may and bool(_cue(low)) and not _detail(low)


def other_content(rest: str) -> list[str]:
    """The distinct sentences, as words, that neither decline nor are a courtesy."""
    said = (_normal(m[0]) for m in _sentence(rest))
    return list(dict.fromkeys(" ".join(w) for s in said if (w := _token(s)) and not _courtesy(s.strip()) and not _declines(s, w)))


def _in_order(asked: list[str], said: list[str]) -> bool:
    """Whether what is said runs through the question's words in their order, once or more."""
    at = 0
    for w in said:
        try:
            at = asked.index(w, at) + 1
        except ValueError:
            try:
                at = asked.index(w) + 1
            except ValueError:
                return False
    return len(said) <= (len(said) // max(1, len(asked)) + 1) * len(asked)


def band_keys(runs: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """MinHash band keys (sets, bands) of sets of hashed runs laid end to end; none may be empty."""
    rng = np.random.default_rng(5)
    x = runs.view(np.uint64)
    out = np.zeros((len(starts), bands), np.uint64)
    for b in range(bands):
        for _ in range(rows):
            factor, plus = rng.integers(1, 1 << 63, 2, dtype=np.uint64)
            y = x * (factor | np.uint64(1)) + plus
            y = (y ^ (y >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            least = np.minimum.reduceat(y ^ (y >> np.uint64(32)), starts)
            out[:, b] = (out[:, b] ^ least) * np.uint64(0x9E3779B97F4A7C15) + (least >> np.uint64(31))
    return out.view(np.int64)


def opening_clusters(openings: DataFrame, *, run: int = RUN, similarity: float = 0.8, bands: int = 16, rows: int = 4) -> DataFrame:
    """(opening, cluster) of the distinct openings; an opening shorter than ``run`` words stands for itself.

    The members of a band are compared with its least member; those it accepts are linked through
    it.  Those it rejects are compared with each other, where they are many after a split by the rarest runs they share
    (and only in what is larger still in rounds with a new least member), and with the accepted ones that can be similar: as 1 - similarity is a metric, only
    members rejected at 2 * ``similarity`` - 1 or more have such.  So no similar pair of a band is
    lost, and a band of copies in all but a few words gives one link a member.  The probability that
    two openings of similarity 0.8 share no band of 16 is 2e-4.  A cluster is a connected component of the
    links, named by its least opening.
    """
    words = openings.select(F.monotonically_increasing_id().alias("o"), "opening", F.split("opening", " ").alias("w"))
    base = stage(words.select("o", "opening", word_runs(F.col("w"), run).alias("runs")), "openings")
    sets = base.where(F.size("runs") > 0).select("o", "runs")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lists = b.column(1)
                starts = lists.offsets.to_numpy()[:-1]
                h = band_keys(lists.values.to_numpy()[: lists.offsets[-1].as_py()], starts, bands, rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), bands)), pa.array(np.tile(np.arange(bands, dtype=np.int32), b.num_rows)), pa.array(h.ravel())], names=["o", "band", "h"])

    keyed = stage(sets.mapInArrow(keys, "o bigint, band int, h bigint"), "bands")

    def compared(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets, "o").join(sets.select(F.col("o").alias("head"), F.col("runs").alias("other")), "head")
        shared = F.size(F.array_intersect("runs", "other"))
        return both.select("o", "head", (shared / (F.size("runs") + F.size("other") - shared)).alias("alike"))

    def refined(large: DataFrame) -> DataFrame:
        """The same members in one band for each few runs that a similar set shares.

        In an order of all runs, rarest first, the first ``k`` runs that two similar sets share are among the first
        size - ceil(similarity * size) + k of each.  Sets of up to 14 runs meet by three, up to 29 by two, larger ones and those
        that may share fewer than three by one; the smaller of a pair also has the keys of the class above.
        """
        members = sets.join(large.select("o").distinct(), "o", "left_semi")
        counts = members.select(F.explode("runs").alias("r")).groupBy("r").agg(F.count("*").alias("n"))
        rare = members.select("o", F.explode("runs").alias("r")).join(counts, "r").groupBy("o").agg(F.array_sort(F.collect_list(F.struct("n", "r"))).alias("x")).select("o", F.col("x.r").alias("x"))
        size, least = F.size("x"), int(int(2 / similarity) / similarity)
        ones = "transform(p, a -> xxhash64(1, a))"
        twos = "flatten(transform(p, (a, i) -> transform(slice(p, i + 2, size(p)), b -> xxhash64(2, a, b))))"
        threes = "flatten(transform(p, (a, i) -> flatten(transform(slice(p, i + 2, size(p)), (b, j) -> transform(slice(p, i + j + 3, size(p)), c -> xxhash64(3, a, b, c))))))"
        classes = [
            (1, ones, (size <= least) | (size >= int(similarity * 30))),
            (2, twos, (size > least) & size.between(int(similarity * 15), 29)),
            (3, threes, (size > int(2 / similarity)) & (size <= 14)),
        ]
        prefix = lambda k: F.slice("x", F.lit(1), size - F.ceil(size * F.lit(similarity) - 1e-9).cast("int") + k)
        keys = reduce(DataFrame.unionByName, [rare.where(which).select("o", prefix(k).alias("p")).select("o", F.explode(F.expr(subsets)).alias("h")) for k, subsets, which in classes])
        return keys.select(F.lit(-1).alias("band"), "h", "o").distinct()

    found: list[DataFrame] = []
    accepted, least_alike = F.col("alike") >= F.lit(similarity) - 1e-9, 2 * similarity - 1 - 1e-9
    left, rounds = keyed, 0
    while True:
        heads = left.groupBy("band", "h").agg(F.min("o").alias("head"), F.count("*").alias("n")).where("n > 1")
        pairs = left.join(heads, ["band", "h"]).where("o <> head").select("band", "h", "o", "head")
        judged = stage(pairs.join(compared(pairs.select("o", "head").distinct()), ["o", "head"]), "judged")
        found.append(judged.where(accepted).select("o", "head"))
        rejected = judged.where(~accepted)
        sizes = rejected.groupBy("band", "h").agg(F.count("*").alias("n"))
        most = sizes.agg(F.max("n")).first()[0]
        if most is None:
            break
        taken = judged.where(accepted).select("band", "h", F.col("o").alias("y"), F.col("alike").alias("near"))
        across = rejected.where(F.col("alike") >= least_alike).join(taken, ["band", "h"]).where(F.col("near") <= F.col("alike") + (1 - similarity) + 1e-9).select("o", F.col("y").alias("head"))
        most_direct = DIRECT if rounds == 0 else 64 * DIRECT
        few = rejected.join(sizes.where(F.col("n") <= most_direct), ["band", "h"]).select("band", "h", "o")
        within = few.join(few.withColumnRenamed("o", "head"), ["band", "h"]).where("o > head").select("o", "head")
        more = across.unionByName(within).select(F.greatest("o", "head").alias("o"), F.least("o", "head").alias("head")).distinct()
        found.append(stage(compared(more).where(accepted).select("o", "head"), "across"))
        if most <= most_direct:
            break
        left = rejected.join(sizes.where(F.col("n") > most_direct), ["band", "h"]).select("band", "h", "o")
        left, rounds = stage(refined(left) if rounds == 0 else left, "left"), rounds + 1
    links = reduce(DataFrame.unionByName, found).select(F.col("o").alias("a"), F.col("head").alias("b"))
    named = base.select("o", "opening").join(connected(links).withColumnRenamed("node", "o"), "o", "left").withColumn("component", F.coalesce("component", "o"))
    names = named.groupBy("component").agg(F.min("opening").alias("cluster"))
    return named.join(names, "component").select("opening", "cluster")


_SEEN = "question string, own string, foreign boolean, opening string, half bigint, place bigint, declines boolean, rest string, later array<bigint>, head string, echo double"


def refusing_openings(seen: DataFrame, *, least_prompts: int = 3, template_prompts: int = 5, fixed: float = 0.9, further_down: float = 0.1, one_head: float = 0.6, echoed: float = 0.5) -> DataFrame:
    """(opening, cluster) of the openings that are stock texts, decline in a recurring cluster, or decline by their own words."""
    openings = stage(seen.where("opening <> ''").groupBy("opening").agg(F.count("*").alias("n"), F.max("declines").alias("declines"), F.first("half").alias("half"), F.first("place").alias("place")), "distinct-openings")
    clusters = stage(openings.join(opening_clusters(openings.select("opening")), "opening"), "clusters")
    many = clusters.groupBy("cluster").agg(F.sum("n").alias("n"), F.avg(F.col("declines").cast("int")).alias("declining")).where(F.col("n") >= least_prompts)
    members = clusters.join(many.select("cluster"), "cluster", "left_semi").select("opening", "cluster", "half", "place", F.col("n").alias("own_n"))
    # hot openings (a template of a third of all answers) meet a side that is never larger than the distinct openings
    spread = members.select("opening", "cluster").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = seen.select("id", "opening", "question", "head", "echo").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(spread, ["opening", "salt"])
    asked = stage(rows.groupBy("cluster", "question").agg(F.count("*").alias("n"), F.first("head").alias("head"), F.sum("echo").alias("echo")), "asked")
    prompts = asked.groupBy("cluster").agg(F.count("question").alias("prompts"), (F.sum("echo") / F.sum("n")).alias("echo"))
    heads = asked.groupBy("cluster", "head").agg(F.sum("n").alias("n")).groupBy("cluster").agg((F.max("n") / F.sum("n")).alias("one_head"))
    begun = openings.groupBy("half").agg(F.sum("n").alias("begun")).join(members.select("cluster", "half").distinct(), "half").groupBy("cluster").agg(F.sum("begun").alias("begun"))
    further = seen.select(F.explode("later").alias("place")).groupBy("place").agg(F.count("*").alias("further")).join(members.select("cluster", "place"), "place").groupBy("cluster").agg(F.sum("further").alias("further"))
    told = many.join(prompts, "cluster").join(heads, "cluster").join(begun, "cluster").join(further, "cluster", "left")
    stock = (
        (F.col("prompts") >= template_prompts)
        & (F.size(F.split("cluster", " ")) >= RUN)
        & (F.col("n") >= F.lit(fixed) * F.col("begun"))
        & (F.coalesce("further", F.lit(0)) <= F.lit(further_down) * F.col("n"))
        & (F.col("one_head") <= one_head)
        & (F.col("echo") < echoed)
    )
    recurring = told.where(stock | ((F.col("prompts") >= least_prompts) & (F.col("declining") >= 0.5))).select("cluster", F.lit(True).alias("recurs"))
    return stage(clusters.join(recurring, "cluster", "left").where("recurs or declines").select("opening", "cluster"), "refusing")


def defects(pairs: DataFrame, *, least_prompts: int = 3, template_prompts: int = 5) -> DataFrame:
    """(pair_id, side, defect) of each defective side of (pair_id, question, chosen, rejected); at most one a side.

    In order: empty, copies_question, refusal, other_language, truncated.  A pair_id counts once
    (rows with a null one are dropped); a null question allows only empty, refusal and truncated.
    Extra columns are ignored, and an empty table gives an empty table.  The character models of
    languages are trained on all questions and answers.
    """
    once = pairs.where(F.col("pair_id").isNotNull()).select("pair_id", "question", *SIDES).dropDuplicates(["pair_id"])
    sides = once.select("pair_id", "question", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("answer")) for s in SIDES])).alias("s"))
    sides = stage(sides.select(F.struct("pair_id", "s.side").alias("id"), "question", F.col("s.answer").alias("text")), "sides")
    texts = sides.select("text").unionByName(sides.where("id.side = 'chosen'").select(F.col("question").alias("text")))
    known = sides.sparkSession.sparkContext.broadcast(languages.fitted(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["own", "foreign", "opening", "half", "place", "declines", "rest", "later", "head", "echo"]
        types = [pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.int64()), pa.string(), pa.float64()]
        blank = ("empty", False, "", 0, 0, False, "", [], "", 0.0)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                questions = [q or "" for q in b.column(1).to_pylist()]
                got = [examine(q, a) for q, a in zip(questions, b.column(2).to_pylist(), strict=True)]
                foreign = other_language([g["text"] if g else "" for g in got], questions, known.value)
                rows = [("copies_question" if g["copies"] else None, f, *[g[n] for n in names[2:]]) if g else blank for g, f in zip(got, foreign, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], names=["id", "question", *names])

    kind = sides.schema["id"].dataType.simpleString()
    seen = stage(sides.mapInArrow(run, f"id {kind}, {_SEEN}"), "examined")
    refusing = refusing_openings(seen, least_prompts=least_prompts, template_prompts=template_prompts)
    cut = cut_texts(sides.select("id", "text")).select("id", F.lit(True).alias("cut"))
    spread = refusing.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = seen.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(spread, ["opening", "salt"])

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            others = [other_content(x) for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(others, pa.list_(pa.string()))], names=["id", "question", "cluster", "others"])

    found = stage(found.select("id", "question", "cluster", "rest").mapInArrow(contents, f"id {kind}, question string, cluster string, others array<string>"), "declining")
    said = found.select("id", "question", "cluster", F.explode("others").alias("sentence"))
    usual = said.groupBy("cluster", "sentence").agg(F.count_distinct("question").alias("prompts")).where(F.col("prompts") >= least_prompts).select("cluster", "sentence")
    telling = said.join(usual, ["cluster", "sentence"], "left_anti").select("id").distinct()
    refusals = found.select("id").join(telling, "id", "left_anti").withColumn("refusal", F.lit(True))
    rows = seen.select("id", "own", "foreign").join(refusals, "id", "left").join(cut, "id", "left")
    defect = (
        F.when(F.col("own").isNotNull(), F.col("own"))
        .when(F.col("refusal"), F.lit("refusal"))
        .when(F.col("foreign"), F.lit("other_language"))
        .when(F.col("cut"), F.lit("truncated"))
    )
    return rows.withColumn("defect", defect).where("defect is not null").select("id.pair_id", "id.side", "defect")
