"""Text expressions with the exact white-space, word and parse rules the pipeline relies on.

All functions take and return Columns and stay inside the JVM.  Null in gives null out unless a
docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Any Unicode white space, with the four information separators that Java's class leaves out.
SPACE = r"[\s\x1c-\x1f\x85​]"
_PY_SPACE = r"(?U)[\s\x1c-\x1f]"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once; used as it is, an expression is worked out anew wherever a lambda names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_all(c: Column) -> Column:
    """Trim every kind of Unicode white space (``trim`` removes blanks only)."""
    return F.regexp_replace(c, f"{_PY_SPACE}+\\z|\\A{_PY_SPACE}+", "")


def is_blank(c: Column) -> Column:
    """True for null and for text of white space only."""
    return F.coalesce(strip_all(c) == "", F.lit(True))


def words_any_space(c: Column) -> Column:
    """Words between runs of any white space; '' gives an empty array."""
    return F.filter(F.split(c, f"{_PY_SPACE}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Number of words between runs of any white space."""
    return F.size(words_any_space(c)).cast("int")


def word_count_single_space(c: Column) -> Column:
    """Pieces between single blanks after stripping; '' counts as one piece."""
    return F.size(F.split(strip_all(c), " ")).cast("int")


def base_name(c: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(c, "/", -1)


def first_tokens(c: Column, n: int) -> Column:
    """The first n pieces between single blanks."""
    return F.array_join(F.slice(F.split(c, " "), 1, n), " ")


def yes_no_prompt(c: Column) -> Column:
    """A question with the request for a yes or no."""
    return F.concat(c, F.lit(" Please answer yes or no."))


#: The head of the request for facts and of that for questions, and the parts of a judge's prompt.
FACTS_HEAD = (
    "You are an expert in extracting facts from the given question-answer pair for an image. Your task is to extract and rewrite the facts mentioned in the question-answer pair into self-contained sentences. "
    "Exclude opinions or subjective statements.\n\nYou should present your result in the following format:\n### Facts:\n- {Extracted fact 1}\n- {Extracted fact 2}\n- ...\n\n### Question-answer pair:\nQuestion: "
)
SECTIONS = {"description": "the detailed description of the picture", "question": "the user's question", "answer_a": "Model A's answer", "answer_b": "Model B's answer"}
#: Contrast marks, and whether what counts stands after the mark.
CONTRAST_MARKS = {"The following is a response without hallucination.": True, "The following is a response with hallucination.": False, "Generate a response without errors.": True, "Generate a response with errors.": False}


def fact_prompt(question: Column, answer: Column, tokens: int = 300) -> Column:
    """The request for the facts of an answer, cut to so many pieces between single blanks."""
    return first_tokens(F.concat(F.lit(FACTS_HEAD), question, F.lit("\nAnswer: "), answer), tokens)


def judge_prompt(system: str, **parts: Column) -> Column:
    """A judge's prompt: the system text and a marked section for each part of ``SECTIONS`` given; null parts make it null."""
    blocks = [F.concat(F.lit(f"\n\n[Beginning of {SECTIONS[k]}]\n"), v, F.lit(f"\n[End of {SECTIONS[k]}]")) for k, v in parts.items()]
    return F.concat(F.lit(system), *blocks)


def judge_section(prompt: Column, part: str) -> Column:
    """One part of a judge's prompt, stripped; null where a mark is missing."""
    return section(prompt, f"[Beginning of {SECTIONS[part]}]", f"[End of {SECTIONS[part]}]")


def without_contrast(c: Column) -> Column:
    """What a contrast mark leaves of a text: the part after its last, or before its first, place; the first mark that occurs decides."""
    out = c
    for mark, after in reversed(CONTRAST_MARKS.items()):
        kept = F.substring_index(c, mark, -1) if after else F.substring_index(c, mark, 1)
        out = F.when(F.contains(c, F.lit(mark)), strip_all(kept)).otherwise(out)
    return out


def verdict(c: Column) -> Column:
    """The first ``[[A]]``, ``[[B]]`` or ``[[C]]`` as -1, 1 or 0; null where there is none."""
    letter = F.regexp_extract(c, r"\[\[([ABC])\]\]", 1)
    return F.when(letter == "A", F.lit(-1)).when(letter == "B", F.lit(1)).when(letter == "C", F.lit(0))


def rating(c: Column) -> Column:
    """The one k in 0..6 for which ``rating: k`` occurs, else 0 (null text gives 0)."""
    low = F.lower(F.coalesce(c, F.lit("")))
    hits = F.filter(F.sequence(F.lit(0), F.lit(6)), lambda k: F.contains(low, F.concat(F.lit("rating: "), k.cast("string"))))
    return F.when(F.size(hits) == 1, F.element_at(hits, 1)).otherwise(F.lit(0))


def section(c: Column, begin: str, end: str) -> Column:
    """Text between the first ``begin`` and the next ``end``, stripped; null where either is missing."""
    after = F.when(F.locate(begin, c) > 0, F.substring(c, F.locate(begin, c) + F.lit(len(begin)), F.length(c)))
    return strip_all(F.when(F.locate(end, after) > 0, F.substring(after, F.lit(1), F.locate(end, after) - F.lit(1))))


def object_list(c: Column) -> Column:
    """A JSON list of strings, from the whole text or else from its last line."""
    whole = F.from_json(strip_all(c), "array<string>")
    last = F.from_json(F.element_at(F.split(strip_all(c), "\n"), -1), "array<string>")
    return F.coalesce(whole, F.when(F.contains(c, F.lit('["')), last))


def clean_response(c: Column) -> Column:
    """Drop the speaker tag, strip, and name the end-of-text mark ``<EOT>``."""
    return F.replace(strip_all(F.replace(c, F.lit("Assistant:"), F.lit(""))), F.lit("<|endoftext|>"), F.lit("<EOT>"))


def facts_from_text(c: Column) -> Column:
    """Listed facts: one a line, heading and empty lines dropped, the first character removed.

    The first character goes even if it is no dash.  A line of white space only gives an empty fact.
    """
    lines = F.filter(F.split(strip_all(c), "\n"), lambda x: (x != "") & ~F.contains(x, F.lit("###")))
    return F.transform(lines, lambda x: strip_all(F.substring(x, F.lit(2), F.length(x))))


def facts_prompt(facts: Column, head: str) -> Column:
    """``head`` with a dashed line for each fact."""
    return F.concat(F.lit(head), F.array_join(F.transform(facts, lambda f: F.concat(F.lit("\n- "), f, F.lit("\n"))), ""))


def model_name(path: Column) -> Column:
    """Model name of a checkpoint path: the last part, with its parent for ``checkpoint-N``."""
    parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    last = F.element_at(parts, -1)
    return F.when(last.startswith("checkpoint-") & (F.size(parts) > 1), F.concat_ws("_", F.element_at(parts, -2), last)).otherwise(last)


def checkpoint_step(path: Column) -> Column:
    """N of ``checkpoint-N``, else -1."""
    return F.coalesce(F.regexp_extract(path, r"checkpoint-(\d+)", 1).try_cast("int"), F.lit(-1))


def image_tags(question: Column, patches: int, start: str = "<im_start>", patch: str = "<im_patch>", end: str = "<im_end>") -> Column:
    """Replace ``<image>`` by its patch tokens; put them in front where the tag is absent."""
    tags = start + patch * patches + end
    return F.when(F.contains(question, F.lit("<image>")), F.replace(question, F.lit("<image>"), F.lit(tags))).otherwise(F.concat(F.lit(tags + "\n"), question))


def clauses(c: Column) -> Column:
    """Split at white space after sentence and clause marks, brackets and quotation marks."""
    return F.filter(F.split(c, r"(?U)(?<=[.,!?;()\"])\s+"), lambda x: x != "")
