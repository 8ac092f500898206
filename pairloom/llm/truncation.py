"""Texts that stop before they were finished, by self-joins on prefixes.

Every distinct text is scanned once into segments (sentences or lines) of words.

* Longer copies: the values are windows of ``WINDOW`` words, one from each place of each segment,
  with ``^`` for the begin of a segment and ``.`` for its full stop; a window that an unfinished
  end touches is left out.  The last words of an unfinished text (three, else two) are sorted
  among them across the cluster.  Between a value and its extensions lie only extensions, so the
  next window tells whether the end is a strict prefix of a longer copy, and of which text.  A
  text is cut only if there is one.
* Completeness: what is a prefix of something longer may yet be complete (labels, items of lists,
  numbers).  Segments are grouped by hashes of prefixes of fixed length (one to three words): where
  those of a group run to a full stop, one without is unfinished.  Single words count as complete
  unless they run on more often than they stand alone.  A last word that is never a whole word, an end in a transfer
  mark or an open bracket, and a begin after a full stop that nothing else begins with, tell as well;
  so does an end of three words that continues elsewhere in a segment longer than a label.

Statistics are over all texts and summed in each batch before they are shuffled.  Openings count
each distinct text once, so that copies of one cut text don't outvote the others; segments of one
word count every row, as copies tell a label.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.core.staging import stage

_segment = regex.compile(r"[^\n]+?(?:[.!?…]+[\"')\]»”’]*(?=\s|$)|[。！？]+[”」』）]*|(?=\n|\Z))")
_token = regex.compile(r"\p{Han}|[^\W_\p{Han}]+(?:['’][^\W_]+)?").findall
_HAN = "⺀-⻿⼀-⿕々〇〡-〩〸-〻㐀-䶿一-鿿豈-﫿\U00020000-\U000323af"
#: Words, stops and line ends of a text, in one pass.
_pieces = re.compile(rf"[{_HAN}]|[^\W_{_HAN}]+(?:['’][^\W_]+)?|\n|[.!?…]+[\"')\]»”’]*(?=\s|\Z)|[。！？]+[”」』）]*").findall
#: What may follow a finished text: pictographs, white space, whole tags and end-of-text tokens.
_ornament = regex.compile(r"(?:[\p{So}\p{Sk}️‍​]|\s|</?[a-zA-Z][^<>]*>|<\|[^<>|]*\|>|&nbsp;)+\Z")
_mark = regex.compile(r"(?:\s*(?:\.{2,}|…|\[[a-z]{0,9}\.*|�|\\u?[0-9a-fA-F]{0,4}|&#?\w{0,6}|<[^<>\n]{0,20}))+\Z")
_may_mark = re.compile(r"[…\[�\\&<]|\.\.\Z").search
_closed = regex.compile(r"[.!?。！？][\"')\]»”’」』）]*\Z")
_item = regex.compile(r"\s*(?:[-*•–]|\d+[.)])\s")
#: Words up to which a segment without a full stop may be a label.
LABEL_WORDS = 3
#: Words of a window, the begin and the full stop of a segment counting as one.
WINDOW = 4
#: Repetitions of what a hot key is joined with, to spread it over tasks.
SALTS = 16
_CLOSERS = "\"')]»”’」』）"


def trimmed(text: str) -> tuple[str, bool]:
    """The text without ornaments and cut marks at its end, and whether there was a mark."""
    bare = text
    if not (bare[-1:].isalnum() or bare[-1:] in ".!?\"'"):
        bare = _ornament.sub("", bare)
    if _may_mark(bare) and (m := _mark.search(bare)):
        return bare[: m.start()].rstrip(), True
    return bare, False


def scan(bare: str) -> list[tuple[list[str], bool]]:
    """The segments that have words, as (words, ends with a full stop)."""
    out: list[tuple[list[str], bool]] = []
    words: list[str] = []
    for p in _pieces(bare.lower()):
        if p[0].isalnum():
            words.append(p)
        elif words:
            out.append((words, p.rstrip(_CLOSERS)[-1:] in (".", "!", "?", "。", "！", "？")))
            words = []
    if words:
        out.append((words, False))
    return out


def tail(bare: str, marked: bool, segments: list[tuple[list[str], bool]]) -> tuple | None:
    """(sure, after, long, opening, alone, last, three, two) of an unfinished end; None for a finished one.

    sure: a cut mark or an open bracket or quotation; after: the segment before ends with a
    full stop; long: the segment is no label; opening: the longest prefix of one to three words
    short of the last word; alone: the one word of a segment of one; last: the last word if the
    text ends right after it; three, two: so many last words, ``^`` counting as one.
    """
    if not segments or segments[-1][1]:
        return None
    words = segments[-1][0]
    line = next(m[0] for m in reversed(list(_segment.finditer(bare))) if _token(m[0]))
    broken = line.count('"') % 2 == 1 or any(line.count(a) > line.count(b) for a, b in ("()", "[]", "“”"))
    item = bool(_item.match(line))
    after = len(segments) > 1 and segments[-2][1] and not item
    long = len(words) > LABEL_WORDS and not item
    opening = " ".join(words[: min(3, len(words) - 1)]) if len(words) > 1 else None
    ends = ["^", *words]
    return marked or broken, after, long, opening, words[0] if len(words) == 1 else None, words[-1] if bare[-1:].isalnum() else None, " ".join(ends[-3:]), " ".join(ends[-2:])


def windows(segments: list[tuple[list[str], bool]]) -> Iterator[str]:
    """Windows of the segments; those that reach a segment's end without a full stop are left out."""
    for words, closed in segments:
        line = ["^", *words, "."] if closed else ["^", *words[:-1]]
        yield from map(" ".join, zip(*[line[k:] for k in range(WINDOW)]))  # noqa: B905
        if closed:
            yield from (" ".join(line[i:]) for i in range(max(0, len(line) - WINDOW + 1), len(line) - 1))


def count_openings(out: Counter, segments: list[tuple[list[str], bool]], copies: int) -> None:
    """Adds the counts of (kind, key): o/c openings of open and closed segments; and over all copies r closed
    segments that run on after a word, s whole segments of one word."""
    for words, closed in segments:
        kind = "c" if closed else "o"
        for n in range(1, min(3, len(words) - 1) + 1):
            out[kind, " ".join(words[:n])] += 1
        if len(words) == 1:
            out["s", words[0]] += copies
        elif closed:
            out["r", words[0]] += copies


_PARTS = "kind string, key string, n bigint, sure boolean, after boolean, long boolean, alone string, last string, three string, two string, text string"
_TAIL = ("sure", "after", "long", "alone", "last", "three", "two", "text")


def _parsed(distinct: DataFrame, kind: str) -> DataFrame:
    """Rows of several kinds from (text, copies, id): w windows with their least and greatest id, t unfinished ends, and counts."""
    types = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), *[pa.string()] * 5]
    names = ["kind", "key", "n", *_TAIL, "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: Counter = Counter()
            first: dict[str, int] = {}
            final: dict[str, int] = {}
            rows: list[tuple] = []
            at: list[tuple[int, int]] = []
            for i, (text, copies) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                bare, marked = trimmed(text)
                segments = scan(bare)
                count_openings(total, segments, copies)
                own = list(windows(segments))
                deque(map(first.setdefault, own, repeat(i)), 0)
                final.update(zip(own, repeat(i)))  # noqa: B905
                if t := tail(bare, marked, segments):
                    sure, after, long, opening, *rest = t
                    rows.append(("t", opening, None, sure, after, long, *rest, text))
                    at.append((i, i))
            rows += [(k, x, n, *[None] * 8) for (k, x), n in total.items()]
            at += [(None, None)] * len(total)
            ids = b.column(2)
            if rows:
                low, high = (ids.take(pa.array([p[k] for p in at], pa.int32())) for k in (0, 1))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, low, high], names=names)
            if first:
                # both have the windows in the order they were first met
                low, high = (ids.take(pa.array(list(x.values()), pa.int32())) for x in (first, final))
                columns = [pa.array(["w"] * len(first), types[0]), pa.array(list(first), types[1]), *[pa.nulls(len(first), t) for t in types[2:]]]
                yield pa.RecordBatch.from_arrays([*columns, low, high], names=names)

    return distinct.select("text", "copies", "id").mapInArrow(run, f"{_PARTS}, low {kind}, high {kind}")


def continued(values: DataFrame, longer: DataFrame) -> DataFrame:
    """(value, low, high) of the distinct values that are strict prefixes of one of (window, low, high), by one sort of both.

    Values and windows are distinct.  Between a value and its extensions lie only extensions, so the window that
    follows decides.  One window for each partition goes to the driver, to bridge partitions.
    """
    both = longer.select(F.col("window").alias("v"), F.struct("window", "low", "high").alias("w")).unionByName(values.select(F.col("value").alias("v")).withColumn("w", F.lit(None)))
    ordered = stage(both.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "sorted")
    heads = {r["part"]: r["w"] for r in ordered.where("w is not null").groupBy("part").agg(F.min_by("w", "v").alias("w")).collect()}
    parts = sorted(r["part"] for r in ordered.select("part").distinct().collect())
    following = [(p, next((heads[q] for q in parts if q > p and q in heads), None)) for p in parts]
    bridge = ordered.sparkSession.createDataFrame(following, f"part int, head {ordered.schema['w'].dataType.simpleString()}")
    # from the greatest value down, a value before the window equal to it: the last window seen is the one that follows
    seen = F.last("w", ignorenulls=True).over(Window.partitionBy("part").orderBy(F.desc("v"), F.col("w").isNull().desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = ordered.withColumn("next", seen).where("w is null").join(F.broadcast(bridge), "part", "left").withColumn("next", F.coalesce("next", "head"))
    return near.where(F.startswith("next.window", "v")).select(F.col("v").alias("value"), "next.low", "next.high")


def _spread(rows: DataFrame, key: str, small: DataFrame, by: str) -> DataFrame:
    """Left join on a key that may be hot or null: ``small``, distinct in the key, is repeated for each salt."""
    salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"], "left").drop("salt")


def may_be_open(text: Column) -> Column:
    """Whether a text may lack its end: false only where it has no cut mark and ends with a word and a full stop."""
    return ~F.rlike(text, F.lit(r"[\p{L}\p{N}][.!?。！？]\s*\z")) | F.rlike(text, F.lit(r"[…\[�\\&<]"))


def cut_texts(df: DataFrame, least_share: float = 0.5) -> DataFrame:
    """(id, evidence, copy_id) of the rows of (id, text) whose text is cut; copy_id is the id of a longer copy of its end.

    evidence names what tells that the end is no complete one.  copy_id is the row's own id only where
    no other text has the copy.  Null, blank and unworded texts, and texts that end with a full
    stop, are never cut.  Ids may be of any type and may repeat; rows keep their number.  An empty
    table gives an empty table.
    """
    kind = df.schema["id"].dataType.simpleString()
    source = df.where(F.col("text") != "").select("id", "text")
    distinct = source.groupBy("text").agg(F.count("*").alias("copies"), F.min("id").alias("id"))
    parsed = stage(_parsed(distinct, kind), "parsed")
    ends = parsed.where("kind = 't'").select(F.col("key").alias("opening"), *_TAIL)
    counts = parsed.where(F.col("kind").isin("c", "o", "s", "r")).groupBy("kind", "key").agg(F.sum("n").alias("n"))
    n_of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0))
    known = parsed.where(F.col("kind").isin("c", "o", "s", "r")).groupBy("key").agg(n_of("c").alias("closed"), n_of("o").alias("open"), n_of("s").alias("singles"), n_of("r").alias("runs_on"))

    longer = parsed.where("kind = 'w'").groupBy(F.col("key").alias("window")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    asked = ends.select(F.explode(F.array("three", "two", F.concat("last", F.lit(" ")))).alias("value")).where("value is not null").distinct()
    found = stage(continued(asked, longer), "continued")
    copy = lambda key, name: found.select(F.col("value").alias(key), F.struct("low", "high").alias(name))
    rows = _spread(ends, "three", copy("three", "by_three"), "text")
    rows = _spread(rows, "two", copy("two", "by_two"), "text").where("by_three is not null or by_two is not null")
    whole = found.select(F.expr("rtrim(value)").alias("last"), F.endswith("value", F.lit(" ")).alias("whole")).where("whole")
    rows = _spread(rows, "last", whole, "text")
    rows = _spread(rows, "opening", known.select(F.col("key").alias("opening"), "closed", (F.col("closed") + F.col("open")).alias("all")), "text")
    rows = _spread(rows, "alone", known.where("closed + open > 0").select(F.col("key").alias("alone"), "singles", "runs_on"), "text")
    evidence = (
        F.when(F.col("sure"), F.lit("mark"))
        .when(F.col("last").isNotNull() & F.col("whole").isNull(), F.lit("word"))
        .when(F.col("closed") / F.col("all") >= least_share, F.lit("segment"))
        .when(F.col("runs_on") > F.col("singles"), F.lit("segment"))
        .when(F.col("after") & (F.coalesce("all", F.lit(0)) < 5) & F.coalesce(F.col("singles") == 0, F.lit(True)), F.lit("style"))
        .when(F.col("long") & F.col("by_three").isNotNull(), F.lit("copy"))
    )
    cut = rows.withColumn("evidence", evidence).where("evidence is not null").select("text", "evidence", F.coalesce("by_three", "by_two").alias("copy"))
    other = F.when(F.col("copy.low") == F.col("id"), F.col("copy.high")).otherwise(F.col("copy.low"))
    return _spread(source.where(may_be_open(F.col("text"))), "text", stage(cut, "cut"), "id").where("evidence is not null").select("id", "evidence", other.alias("copy_id"))


def strict_prefixes(texts: DataFrame) -> DataFrame:
    """The distinct values of (text), but null and "", that are strict prefixes of another one."""
    distinct = texts.where(F.col("text") != "").select("text").distinct()
    longer = distinct.select(F.col("text").alias("window"), F.lit(0).alias("low"), F.lit(0).alias("high"))
    return continued(distinct.select(F.col("text").alias("value")), longer).select(F.col("value").alias("text"))


def source_key(path: str = "model_path"):
    """A source's name without closing slashes; null and blank give null."""
    return F.nullif(F.regexp_replace(F.trim(F.col(path)), "/+$", ""), F.lit(""))
