"""Conversations as arrays of (turn, role, text): rendering, role names, and label masks by role."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.text import bound, strip_all


@dataclass(frozen=True)
class Template:
    """How a conversation is written: separator style, system text, role names and separators."""

    style: str
    system: str = ""
    roles: tuple[str, str] = ("USER", "ASSISTANT")
    sep: str = " "
    sep2: str | None = None
    tagged: bool = False


#: System texts, and templates by name; several names may share one.
_CHAT = "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."
_HUMAN = "A chat between a curious human and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the human's questions."
_TAGGED = (
    "A chat between a curious user and an artificial intelligence assistant. The assistant is able to understand the visual content that the user provides, "
    "and assist the user with a variety of tasks using natural language.The visual content will be provided with the following format: <Image>visual content</Image>."
)
_SAFE = (
    "You are a helpful, respectful and honest assistant. Always answer as helpfully as possible, while being safe.  Your answers should not include any harmful, unethical, racist, sexist, toxic, dangerous, or illegal content. "
    "Please ensure that your responses are socially unbiased and positive in nature.\n\nIf a question does not make any sense, or is not factually coherent, explain why instead of answering something not correct. "
    "If you don't know the answer to a question, please don't share false information."
)
_VISION = "You are a helpful language and vision assistant. You are able to understand the visual content that the user provides, and assist the user with a variety of tasks using natural language."
_CHATML = ("<|im_start|>user\n", "<|im_start|>assistant\n")
_MPT = "<|im_start|>system\nA conversation between a user and an LLM-based AI assistant. The assistant gives helpful and honest answers."
_NAMES = ("Human", "Assistant")
TEMPLATES = {
    "single": Template("single", _HUMAN, _NAMES, "###"),
    "default": Template("single", _HUMAN, _NAMES, "###"),
    "v0": Template("single", _HUMAN, _NAMES, "###"),
    "llava_v0": Template("single", _HUMAN, _NAMES, "###"),
    "v0_mmtag": Template("single", _TAGGED, _NAMES, "###", tagged=True),
    "two": Template("two", _CHAT, sep2="</s>"),
    "v1": Template("two", _CHAT, sep2="</s>"),
    "vicuna_v1": Template("two", _CHAT, sep2="</s>"),
    "llava_v1": Template("two", _HUMAN, sep2="</s>"),
    "v1_mmtag": Template("two", _TAGGED, sep2="</s>", tagged=True),
    "llama_2": Template("llama_2", _SAFE, sep="<s>", sep2="</s>"),
    "llava_llama_2": Template("llama_2", _VISION, sep="<s>", sep2="</s>"),
    "mistral_instruct": Template("llama_2", "", sep="", sep2="</s>"),
    "mpt": Template("mpt", _MPT, _CHATML, "<|im_end|>"),
    "chatml_direct": Template("mpt", "<|im_start|>system\nAnswer the questions.", _CHATML, "<|im_end|>"),
    "mistral_direct": Template("mpt", "<|im_start|>system\nAnswer the questions.", _CHATML, "<|im_end|>"),
    "plain": Template("plain", "", ("", ""), "\n"),
    "v0_plain": Template("plain", "", ("", ""), "\n"),
}


def turns(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(key, turns): the turns of each conversation in order."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")))).alias("turns"))


def render(conversation: Column, template: Template) -> Column:
    """The text of a conversation whose turns alternate, the user's first.

    A turn without text is left open, with its role name only.  The style decides where
    separators go: after every turn (single, mpt, plain), alternately (two), or around pairs with
    instruction marks (llama_2).
    """
    t, user = template, F.lit(template.roles[0])

    def name(i: Column) -> Column:
        return F.when(i % 2 == 0, user).otherwise(F.lit(t.roles[1]))

    def has(x: Column) -> Column:
        return F.coalesce(x["text"] != "", F.lit(False))

    if t.style == "single":
        parts = F.transform(conversation, lambda x, i: F.when(has(x), F.concat(name(i), F.lit(": "), x["text"], F.lit(t.sep))).otherwise(F.concat(name(i), F.lit(":"))))
        return F.concat(F.lit(t.system + t.sep), F.array_join(parts, ""))
    if t.style == "two":
        parts = F.transform(conversation, lambda x, i: F.when(has(x), F.concat(name(i), F.lit(": "), x["text"], F.when(i % 2 == 0, F.lit(t.sep)).otherwise(F.lit(t.sep2)))).otherwise(F.concat(name(i), F.lit(":"))))
        return F.concat(F.lit(t.system + t.sep), F.array_join(parts, ""))
    if t.style == "mpt":
        parts = F.transform(conversation, lambda x, i: F.when(has(x), F.concat(name(i), x["text"], F.lit(t.sep))).otherwise(name(i)))
        return F.concat(F.lit(t.system + t.sep), F.array_join(parts, ""))
    if t.style == "plain":
        parts = F.transform(F.filter(conversation, has), lambda x, i: F.concat(x["text"], F.when(i % 2 == 0, F.lit(t.sep)).otherwise(F.lit(t.sep2 or ""))))
        return F.concat(F.lit(t.system), F.array_join(parts, ""))
    if t.style == "llama_2":
        system = f"<<SYS>>\n{t.system}\n<</SYS>>\n\n" if t.system else ""

        def part(x: Column, i: Column) -> Column:
            said = F.when(i == 0, F.concat(F.lit(system), x["text"])).otherwise(x["text"])
            asked = F.concat(F.lit(t.sep + "[INST] "), said, F.lit(" [/INST]"))
            return F.when(~has(x), F.lit("")).when(i % 2 == 0, asked).otherwise(F.concat(F.lit(" "), said, F.lit(" " + t.sep2)))

        whole = F.array_join(F.transform(conversation, part), "")
        return F.when(F.startswith(whole, F.lit(t.sep)), F.substring(whole, F.lit(len(t.sep) + 1), F.length(whole))).otherwise(whole)
    raise ValueError(f"unknown style {t.style}")


def image_first(conversation: Column, template: Template) -> Column:
    """(role, text) turns with the image tag taken out of the first turn and put before it; for tagged templates in turns of their own."""
    first = F.get(conversation, F.lit(0))
    bare = strip_all(F.replace(first["text"], F.lit("<image>"), F.lit("")))
    turn = lambda role, text: F.struct(role.cast("string").alias("role"), text.cast("string").alias("text"))
    rest = F.transform(F.slice(conversation, F.lit(2), F.size(conversation)), lambda x: turn(x["role"], x["text"]))
    if template.tagged:
        head = F.array(turn(F.lit(template.roles[0]), F.lit("<Image><image></Image>")), turn(F.lit(template.roles[1]), F.lit("Received.")), turn(first["role"], bare))
    else:
        head = F.array(turn(first["role"], F.concat(F.lit("<image>\n"), bare)))
    return F.when(F.size(conversation) > 0, F.concat(head, rest)).otherwise(F.transform(conversation, lambda x: turn(x["role"], x["text"])))


def with_system(conversation: Column, system: str) -> Column:
    """(role, text) turns with names of roles normalised and a system turn in front; null if a turn is of another role or two in a row are of one.

    A system turn that is there already is of another role, too.  An empty conversation is left to its system turn.
    """
    named = F.transform(conversation, lambda x: F.struct(normal_role(x["role"]).alias("role"), x["text"].alias("text")))

    def checked(c: Column) -> Column:
        known = F.forall(c, lambda x: x["role"].isin("user", "assistant"))
        breaks = F.exists(F.zip_with(c, F.slice(c, F.lit(2), F.size(c)), lambda x, y: x["role"] == y["role"]), lambda b: b)
        head = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("text")))
        return F.when(F.coalesce(known, F.lit(False)) & ~F.coalesce(breaks, F.lit(False)), F.concat(head, c))

    return bound(named, checked)


def normal_role(role: Column) -> Column:
    """human and gpt as user and assistant; other names stay."""
    return F.when(role == "human", F.lit("user")).when(role == "gpt", F.lit("assistant")).otherwise(role)


def alternation_breaks(rows: DataFrame, key: str, turn: str, role: str) -> DataFrame:
    """Turns that repeat the role before them, or begin a conversation not as the user."""
    r = normal_role(F.col(role))
    before = F.lag(r).over(Window.partitionBy(key).orderBy(turn))
    return rows.withColumn("role_before", before).where((r == F.col("role_before")) | (F.col("role_before").isNull() & (r != "user")))


def response_labels(ids: Column, roles: Column, responder: str = "assistant") -> Column:
    """Token ids of the responder; -100 at those of others.  ``roles`` names the role of each token."""
    return F.zip_with(ids, roles, lambda i, r: F.when(r == responder, i).otherwise(F.lit(-100)))


def with_image_labels(labels: Column, at: Column, n: int, longest: int | None = None) -> Column:
    """Labels with the one at place ``at`` (from 0) replaced by n ignored ones, as for the features of an image, cut to ``longest``."""
    spliced = F.concat(F.slice(labels, F.lit(1), at), F.array_repeat(F.lit(-100), n), F.slice(labels, at + 2, F.greatest(F.size(labels) - at - 1, F.lit(0))))
    return spliced if longest is None else F.slice(spliced, F.lit(1), F.lit(longest))


def masked_by_lengths(ids: Column, lengths: Column, speakers: Column, human: str = "human", shown: int = 2) -> Column:
    """Labels of ids: -100 for the header (the first length) and, after the first ``shown`` tokens of each, for turns of ``human``.

    ``lengths`` has the header's and each turn's number of tokens; what lies beyond all turns keeps its ids.
    """

    def masked(n: Column) -> Column:
        ends = F.transform(n, lambda x, i: F.aggregate(F.slice(n, F.lit(1), i + 1), F.lit(0), lambda a, v: a + v))

        def label(e: Column) -> Column:
            turns = F.zip_with(F.zip_with(e, F.slice(e, F.lit(2), F.size(e)), lambda low, high: F.struct(low.alias("low"), high.alias("high"))), speakers, lambda t, s: F.struct(t["low"].alias("low"), t["high"].alias("high"), s.alias("who")))

            def with_turns(ts: Column) -> Column:
                hidden = lambda i: (i < F.get(e, F.lit(0))) | F.exists(ts, lambda t: F.coalesce((t["who"] == human) & (i >= t["low"] + shown) & (i < t["high"]), F.lit(False)))
                return F.transform(ids, lambda x, i: F.when(hidden(i), F.lit(-100)).otherwise(x))

            return bound(turns, with_turns)

        return bound(ends, label)

    return bound(lengths, masked)


def _found_at(ids: Column, mark: list[int]) -> Column:
    """The places at which the run ``mark`` begins."""
    at = F.transform(ids, lambda x, i: F.when((x == mark[0]) & (F.slice(ids, i + 1, len(mark)) == F.array(*[F.lit(m) for m in mark])), i))
    return F.filter(at, lambda i: i.isNotNull())


def masked_by_marks(ids: Column, ask: list[int], answer: list[int]) -> Column:
    """Labels of ids in which runs of tokens mark where a question begins (``ask``) and an answer is to begin (``answer``).

    What lies before the end of the first answer mark, and from each later question mark to the end of the answer mark of
    the same number, is -100; so is a last question without an answer.  Without either mark all is.
    """
    none = F.transform(ids, lambda x: F.lit(-100))

    def masked(asks: Column) -> Column:
        def with_answers(answers: Column) -> Column:
            both = F.filter(F.zip_with(asks, answers, lambda a, b: F.struct(a.alias("low"), b.alias("high"))), lambda t: t["low"].isNotNull() & t["high"].isNotNull())
            ranges = F.transform(both, lambda t, k: F.struct(F.when(k == 0, F.lit(0)).otherwise(t["low"]).alias("low"), t["high"].alias("high")))
            tail = F.when(F.size(answers) < F.size(asks), F.element_at(asks, -1))
            hidden = lambda i: F.exists(ranges, lambda t: (i >= t["low"]) & (i < t["high"])) | F.coalesce(i >= tail, F.lit(False))
            return F.when((F.size(asks) == 0) | (F.size(answers) == 0), none).otherwise(F.transform(ids, lambda x, i: F.when(hidden(i), F.lit(-100)).otherwise(x)))

        return bound(F.transform(_found_at(ids, answer), lambda i: i + len(answer)), with_answers)

    return F.when(F.size(ids) == 0, ids).otherwise(bound(_found_at(ids, ask), masked))


def masked_rounds(rows: DataFrame, prompt: str, tokenize: Callable[[str], list[int]], template: Template, first: bool = True) -> DataFrame:
    """Adds ids and labels of a rendered ``two`` conversation: -100 wherever the assistant does not speak.

    Each round between closing separators is told apart by its own number of tokens; if these don't
    add up to the whole, or a round has no or two answers, everything from there on is -100, and all of it if the
    sum differs.  ``first``: the tokenizer puts one id before every text.
    """
    mark, extra = template.sep + template.roles[1] + ": ", 1 if first else 0

    def labels(text: str) -> tuple[list[int], list[int]]:
        ids = tokenize(text)
        out, at = list(ids), extra
        out[:at] = [-100] * min(at, len(out))
        for piece in text.split(template.sep2):
            parts = piece.split(mark)
            if piece == "" or len(parts) != 2:
                break
            # the closing separator is one token; the blank before an answer belongs to the answer
            whole, asked = len(tokenize(piece)), len(tokenize(parts[0] + mark)) - 1 - extra
            out[at : at + asked] = [-100] * max(0, min(asked, len(out) - at))
            at += whole if first else whole + 1
        out[at:] = [-100] * max(0, len(out) - at)
        return ids, out if at == len(ids) else [-100] * len(ids)

    @F.pandas_udf("struct<ids:array<int>,labels:array<int>>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            yield pd.DataFrame([labels(t) if t is not None else (None, None) for t in s], columns=["ids", "labels"])

    return rows.withColumn("_x", run(prompt)).select(*rows.columns, F.col("_x.ids").alias("ids"), F.col("_x.labels").alias("labels"))


def pair_encodings(rows: DataFrame, question: str, chosen: str, rejected: str, encode: Callable[[Column, Column], list[Column]], logps: dict[str, str] | None = None) -> DataFrame:
    """Two structs a row, ``win`` and ``rej``: what ``encode`` makes of the question and each answer, with the given log-probabilities.

    ``logps`` names, for fields of the structs, the columns they come from, with ``{side}`` for win or rej.
    """
    sides = {"win": chosen, "rej": rejected}
    made = {s: F.struct(*encode(F.col(question), F.col(a)), *[F.col(c.format(side=s)).alias(f) for f, c in (logps or {}).items()]) for s, a in sides.items()}
    return rows.select("*", *[c.alias(s) for s, c in made.items()])
