"""Sequence comparison that Spark's expressions cannot state, in Arrow batches."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import clauses, words_any_space

IMAGE_SLOT = -200


def replaced_spans(a: list, b: list, least: int = 3) -> tuple[list[int], list[int]]:
    """Places of a and of b in spans that replace one another, between common runs of at least ``least`` elements.

    What is only inserted or only deleted is in neither list.
    """
    blocks = [m for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks() if m.size >= least or m.size == 0]
    at_a = at_b = 0
    in_a, in_b = [], []
    for m in blocks:
        if m.a > at_a and m.b > at_b:
            in_a.extend(range(at_a, m.a))
            in_b.extend(range(at_b, m.b))
        at_a, at_b = m.a + m.size, m.b + m.size
    return in_a, in_b


def modification_weights(rows: DataFrame, rejected: str, chosen: str, weight: float) -> DataFrame:
    """Adds rej_weights and win_weights: ``weight`` at replaced tokens, 1 elsewhere; null arrays count as empty."""

    @F.pandas_udf("struct<rej:array<double>,win:array<double>>")
    def run(r: pd.Series, w: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(r, w):
            x, y = list(x) if x is not None else [], list(y) if y is not None else []
            in_x, in_y = map(set, replaced_spans(x, y))
            out.append(([weight if k in in_x else 1.0 for k in range(len(x))], [weight if k in in_y else 1.0 for k in range(len(y))]))
        return pd.DataFrame(out, columns=["rej", "win"])

    return rows.withColumn("_w", run(rejected, chosen)).select(*rows.columns, F.col("_w.rej").alias("rej_weights"), F.col("_w.win").alias("win_weights"))


def marked_differences(rows: DataFrame, a: str, b: str, by_clause: bool = False) -> DataFrame:
    """Adds ``marked``: the lines of a comparison by words, or by clauses ('  ' in both, '- ' only in a, '+ ' only in b); null counts as empty."""

    @F.pandas_udf("array<string>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        compare = difflib.Differ().compare
        parts = lambda p: [] if p is None else list(p)
        return pd.Series([[d for d in compare(parts(p), parts(q)) if d[0] != "?"] for p, q in zip(x, y)])

    split = clauses if by_clause else words_any_space
    return rows.withColumn("marked", run(split(F.col(a)), split(F.col(b))))


def image_token_ids(rows: DataFrame, text: str, tokenize: Callable[[str], list[int]], first: int | None = None) -> DataFrame:
    """Adds ``ids``: tokens of the pieces around ``<image>``, with one image slot for each tag.

    ``first`` is the id that the tokenizer puts before every text; it is kept once.
    """

    @F.pandas_udf("array<int>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            out = []
            for t in s:
                ids: list[int] = []
                for k, piece in enumerate((t or "").split("<image>")):
                    part = tokenize(piece)
                    head = first is not None and part[:1] == [first]
                    ids += ([IMAGE_SLOT] if k else []) + (part[1:] if head and k else part)
                out.append(ids)
            yield pd.Series(out)

    return rows.withColumn("ids", run(text))


def noun_runs(tags: list[tuple[str, str]]) -> list[str]:
    """Joined runs of tokens tagged as nouns."""
    out, run = [], []
    for word, tag in [*tags, ("", "")]:
        if tag.startswith("NN"):
            run.append(word)
        elif run:
            out.append(" ".join(run))
            run = []
    return out


def simple_lemmas(rows: DataFrame, words: str, name: str) -> DataFrame:
    """Adds the words of an array reduced to their singulars by rule, inside the JVM; a null array stays null."""

    def singular(w: Column) -> Column:
        ends = lambda e: F.endswith(w, F.lit(e)) & (F.length(w) > len(e) + 1)
        out = w
        for ending, left in reversed(_PLURALS):
            out = F.when(ends(ending), F.concat(F.substring(w, F.lit(1), F.length(w) - len(ending)), F.lit(left))).otherwise(out)
        return F.when(F.rlike(w, F.lit("(?:ss|us|is)$")), w).otherwise(out)

    return rows.withColumn(name, F.transform(words, singular))


#: Words that are no nouns where a name begins or joins.
_NO_NOUNS = frozenset("a an and at by for from in near of on or the to under with".split())


def noun_objects(rows: DataFrame, texts: str, name: str, tag: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """Adds, for each text of an array, (words, nouns): its words in the singular and its runs of nouns.

    ``tag`` gives a tag for each word of a text; without one, every word but articles and prepositions is a noun.
    """

    def plain(words: list[str]) -> list[str]:
        return ["DT" if w in _NO_NOUNS else "NN" for w in words]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for texts in s:
                found = []
                for t in texts if texts is not None else []:
                    words = (t or "").split()
                    singular = [simple_lemma(w) for w in words]
                    found.append({"words": singular, "nouns": noun_runs(list(zip(singular, (tag or plain)(words), strict=True)))})
                out.append(found)
            yield pd.Series(out)

    return rows.withColumn(name, F.pandas_udf(run, "array<struct<words:array<string>,nouns:array<string>>>")(texts))


_PLURALS = (("ies", "y"), ("ves", "f"), ("sses", "ss"), ("shes", "sh"), ("ches", "ch"), ("xes", "x"), ("s", ""))


def simple_lemma(word: str) -> str:
    """A noun without its plural ending, by rule; results differ from those of a trained lemmatizer."""
    for ending, left in _PLURALS:
        if word.endswith(ending) and len(word) > len(ending) + 1 and not word.endswith(("ss", "us", "is")):
            return word[: -len(ending)] + left
    return word
