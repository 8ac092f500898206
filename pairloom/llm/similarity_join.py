"""Exact similarity join of texts as sets of word runs, with set-relation skipping.

1. Texts become sets of hashed runs of words.  Equal sets form one class; its answers are those of
   its representative, so only representatives go on.
2. Elements get one global order, rare ones first, by their numbers of occurrences.  These come
   from a table of 2**21 cells, each the number of occurrences that fall in it, which is
   broadcast; where the elements would crowd it, each is counted by itself and its number joined to it.
   The order is a function of the element alone.
3. Sets at least t similar share an element within their prefixes.  The inverted list of each
   prefix element is kept in blocks sorted by set size.  Pairs of blocks are skipped whole if
   their sizes, or the positions of the element in them, rule out an overlap large enough; the
   pairs left are compared by 256-bit parity sketches, whose distance never exceeds that of the
   sets.  All three tests are safe: no similar pair is lost.
4. Overlaps are counted exactly.  A set that differs little from a representative already compared
   (its anchor) takes the anchor's overlap, plus what it gained and minus what it lost.

A list longer than ``list_size`` by those numbers is split: its sets fall in s parts, and each
pair of parts is a list of its own.  So one element, and one group of copies, is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.core.components import connected
from pairloom.core.staging import stage

#: Cells of the count table, 16 MB, and the share of them in use from which elements are counted one by one.
CELL_BITS, CROWDED = 21, 0.6
#: Columns of a posting: list, part, set, its size, the element's position, and the set's sketch.
POSTING = ["list", "part", "id", "size", "pos", "s0", "s1", "s2", "s3"]
_BLOCK = 256


def words(c: Column) -> Column:
    """Runs of letters and digits, in lower case; an empty array for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def word_runs(w: Column, size: int) -> Column:
    """The distinct hashes of ``size`` consecutive words; empty for fewer words.  ``w`` should be a plain column."""
    places = F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1)))
    runs = F.transform(places, lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(size)]))
    return F.when(F.size(w) >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def _cell_counts(reps: DataFrame) -> np.ndarray | None:
    """Occurrences in each cell of the count table; None where too many cells are in use."""
    cells = reps.select(F.explode("tokens").alias("t")).groupBy(F.shiftrightunsigned("t", 64 - CELL_BITS).cast("int").alias("cell")).agg(F.count("*").alias("n")).toArrow()
    if cells.num_rows > CROWDED * (1 << CELL_BITS):
        return None
    counts = np.zeros(1 << CELL_BITS, np.int64)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return counts


def _with_frequencies(reps: DataFrame) -> DataFrame:
    """(id, tokens, freq): tokens with their own numbers of occurrences, by a join on the element."""
    each = reps.select("id", F.explode("tokens").alias("t"))
    counted = each.join(each.groupBy("t").agg(F.count("*").alias("n")), "t").groupBy("id").agg(F.collect_list(F.struct("t", "n")).alias("x"))
    return counted.select("id", F.col("x.t").alias("tokens"), F.col("x.n").alias("freq"))


def _postings(reps: DataFrame, counts: np.ndarray | None, threshold: float, list_size: int) -> DataFrame:
    """(list, part, id, size, pos, s0 to s3) for the prefix elements of every set."""
    shared = None if counts is None else reps.sparkSession.sparkContext.broadcast(counts)
    source = reps.select("id", "tokens") if shared else _with_frequencies(reps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value if shared else None
        for b in batches:
            out: list[list[np.ndarray]] = []
            for k, (rep, tokens) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
                x = np.asarray(tokens.values, np.int64).view(np.uint64)
                n = len(x)
                freq = counts[x >> np.uint64(64 - CELL_BITS)] if shared else np.asarray(b.column(2)[k].values, np.int64)
                order = np.lexsort((x, freq))[: n - math.ceil(threshold * n - 1e-9) + 1]
                bits = np.bincount((x & np.uint64(255)).astype(np.int64), minlength=256) & 1
                sketch = np.packbits(bits.astype(np.uint8)).view(np.int64)
                x, freq, pos = x[order], freq[order], np.arange(len(order))
                parts = np.maximum(1, -(-freq // list_size))
                own = ((rep * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 33) % parts
                every = np.repeat(np.arange(len(x)), parts)
                other = np.arange(len(every)) - np.repeat(np.cumsum(parts) - parts, parts)
                mine = own[every]
                low, high = np.minimum(mine, other), np.maximum(mine, other)
                key = x[every] ^ ((low * 1_000_003 + high).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                k = len(every)
                out.append([key.view(np.int64), np.where(low == high, 2, (mine == high).astype(np.int64)), np.full(k, rep), np.full(k, n), pos[every], *[np.full(k, s) for s in sketch]])
            if out:
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                kinds = [np.int64, np.int8, np.int64, np.int32, np.int32, *[np.int64] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(columns, kinds, strict=True)], names=POSTING)

    return source.mapInArrow(run, "list bigint, part tinyint, id bigint, size int, pos int, s0 bigint, s1 bigint, s2 bigint, s3 bigint")


def _pairs_of(rows: dict[str, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of one list, sorted by size, that the block, position and sketch tests leave."""
    share = threshold / (1 + threshold)
    size, left, ids = rows["size"], rows["size"] - rows["pos"], rows["id"]
    n, out_a, out_b = len(size), [], []
    starts = range(0, n, _BLOCK)
    most_left = [int(left[i : i + _BLOCK].max()) for i in starts]
    for bi, i in enumerate(starts):
        ei = min(n, i + _BLOCK)
        for bj in range(bi, len(most_left)):
            j = bj * _BLOCK
            ej = min(n, j + _BLOCK)
            if size[ei - 1] < threshold * size[j] - 1e-9:
                break  # sizes only grow: all later blocks are too large
            if min(most_left[bi], most_left[bj]) < share * (int(size[i]) + int(size[j])) - 1e-9:
                continue
            total = size[i:ei, None] + size[None, j:ej]
            ok = np.minimum(left[i:ei, None], left[None, j:ej]) >= share * total - 1e-9
            if bi == bj:
                ok &= np.arange(i, ei)[:, None] < np.arange(j, ej)[None, :]
            p, q = rows["part"][i:ei, None], rows["part"][None, j:ej]
            ok &= (p != q) | (p == 2)
            a, b = np.nonzero(ok)
            a, b = a + i, b + j
            apart = sum(np.bitwise_count(rows[s][a] ^ rows[s][b]).astype(np.int64) for s in POSTING[5:])
            near = apart <= (1 - 2 * share) * (size[a] + size[b]) + 1e-9
            out_a.append(ids[a[near]])
            out_b.append(ids[b[near]])
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return np.minimum(a, b), np.maximum(a, b)


def _candidates(postings: DataFrame, threshold: float) -> DataFrame:
    """Distinct (a, b), a < b, of the pairs that no test rules out."""
    names = POSTING
    kinds = [np.int64, np.int64, np.int64, np.int64, np.int64, *[np.uint64] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None

        def work(rows: dict[str, np.ndarray], whole: bool) -> tuple[dict | None, list]:
            keys = rows["list"]
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            bounds = np.concatenate([[0], cuts, [len(keys)]])
            last = len(bounds) - 1 if whole else len(bounds) - 2
            found = []
            for k in np.flatnonzero(np.diff(bounds[: last + 1]) > 1):
                a, b = _pairs_of({n: c[bounds[k] : bounds[k + 1]] for n, c in rows.items()}, threshold)
                if len(a):
                    found.append((a, b))
            return (None if whole else {n: c[bounds[-2] :] for n, c in rows.items()}), found

        def batch(found: list) -> pa.RecordBatch:
            both = np.unique(np.stack([np.concatenate(c) for c in zip(*found, strict=True)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for b in batches:
            rows = {n: b.column(i).to_numpy(zero_copy_only=False).astype(k, copy=False) if k is not np.uint64 else b.column(i).to_numpy().view(np.uint64) for i, (n, k) in enumerate(zip(names, kinds, strict=True))}
            if not b.num_rows:
                continue
            if held is not None:
                rows = {n: np.concatenate([held[n], c]) for n, c in rows.items()}
            held, found = work(rows, False)
            if found:
                yield batch(found)
        if held is not None and (found := work(held, True)[1]):
            yield batch(found)

    spread = postings.repartition("list").sortWithinPartitions("list", "size", "id")
    return spread.mapInArrow(run, "a bigint, b bigint").distinct()


def _overlaps(candidates: DataFrame, reps: DataFrame, close: float) -> DataFrame:
    """(a, b, o): exact overlaps, those of sets close to an anchor derived from the anchor's.

    The anchor of a set is the least of its candidate partners that differs from it by at most
    (1 - close) of their elements and has no anchor itself.
    """
    left, right = reps.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), reps.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    sized = candidates.join(reps.select(F.col("id").alias("a"), F.size("tokens").alias("na")), "a").join(reps.select(F.col("id").alias("b"), F.size("tokens").alias("nb")), "b")
    # of a chain of close sets only those whose sizes agree can be anchored; their difference is then counted
    linked = sized.where(F.least("na", "nb") >= F.lit(close) * F.greatest("na", "nb")).groupBy(F.col("b").alias("id")).agg(F.min("a").alias("anchor"))
    roots = linked.join(linked.select(F.col("id").alias("anchor")), "anchor", "left_anti")
    diffs = (
        roots.join(reps.select("id", F.col("tokens").alias("t")), "id")
        .join(reps.select(F.col("id").alias("anchor"), F.col("tokens").alias("u")), "anchor")
        .select("id", "anchor", F.array_except("t", "u").alias("gained"), F.array_except("u", "t").alias("lost"), F.size("t").alias("n"))
        .where(F.size("gained") + F.size("lost") <= F.lit(1 - close) * 2 * F.col("n"))
    )
    diffs = stage(diffs, "anchored")
    anchored = candidates.join(diffs.select(F.col("id").alias("b"), "anchor", "gained", "lost", "n"), "b")
    # overlap with the anchor itself, and with partners that are candidates of the anchor, follows from it
    to_anchor = anchored.where("a = anchor").select("a", "b", (F.col("n") - F.size("gained")).alias("o"))
    others = anchored.where("a <> anchor").select("a", "b", "anchor", "gained", "lost", F.least("a", "anchor").alias("x"), F.greatest("a", "anchor").alias("y"))
    derivable = stage(others.join(candidates.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"]), "derivable")
    direct = candidates.join(to_anchor.select("a", "b").unionByName(derivable.select("a", "b")), ["a", "b"], "left_anti").unionByName(derivable.select(F.col("x").alias("a"), F.col("y").alias("b"))).distinct()
    counted = stage(direct.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("o")), "counted")
    base = counted.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("o").alias("base"))
    derived = derivable.join(base, ["x", "y"]).join(left, "a").select("a", "b", (F.col("base") + F.size(F.array_intersect("ta", "gained")) - F.size(F.array_intersect("ta", "lost"))).alias("o"))
    return to_anchor.unionByName(derived).unionByName(counted).dropDuplicates(["a", "b"])


class SimilarSets:
    """Members (id, rep) and links (a, b, o, jaccard) between the representatives of different sets."""

    def __init__(self, members: DataFrame, links: DataFrame):
        self.members, self.links = members, links

    def pairs(self, block: int = 1000) -> DataFrame:
        """(a, b), a < b: every two different ids that are linked or copies of each other.

        Copies of one representative are paired in parts of about ``block`` ids, so no task holds a
        whole group; the result itself has all pairs.
        """
        sizes = self.members.groupBy("rep").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
        sides = self.members.join(sizes.select("rep", "parts"), "rep").select(F.col("rep").alias("ra"), F.col("id").alias("x"), F.pmod(F.xxhash64("id"), "parts").cast("int").alias("pa"))
        ends = self.links.select(F.col("a").alias("ra"), F.col("b").alias("rb")).unionByName(sizes.where("n > 1").select(F.col("rep").alias("ra"), F.col("rep").alias("rb")))
        cells = ends.join(sizes.select(F.col("rep").alias("ra"), F.col("parts").alias("na")), "ra").join(sizes.select(F.col("rep").alias("rb"), F.col("parts").alias("nb")), "rb")
        cells = cells.select("ra", "rb", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("pa"), "nb").select("ra", "rb", "pa", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("pb"))
        # copies meet once: parts in order, and within a part ids in order
        cells = cells.where("ra <> rb or pa <= pb")
        full = cells.join(sides, ["ra", "pa"]).join(sides.select(F.col("ra").alias("rb"), F.col("pa").alias("pb"), F.col("x").alias("y")), ["rb", "pb"])
        return full.where("ra <> rb or pa <> pb or x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def groups(self) -> DataFrame:
        """(id, group_id, class_id, n_links): classes with the least id of all that are linked with each other, directly or through others."""
        named = connected(self.links.select("a", "b")).select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
        return self.classes().join(named, "class_id", "left").select("id", F.coalesce("group_id", "class_id").alias("group_id"), "class_id", "n_links")

    def classes(self) -> DataFrame:
        """(id, class_id, n_links): the representative of each row's exact copies, and its linked representatives."""
        both = self.links.select(F.col("a").alias("rep")).unionByName(self.links.select(F.col("b").alias("rep")))
        return self.members.join(both.groupBy("rep").count(), "rep", "left").select("id", F.col("rep").alias("class_id"), F.coalesce("count", F.lit(0)).alias("n_links"))


def similar_sets(sets: DataFrame, threshold: float, *, list_size: int = 4096, close: float = 0.9) -> SimilarSets:
    """Join (id bigint, tokens array<bigint>) with itself at a Jaccard similarity of ``threshold`` or more.

    Ids are distinct; null ids, and null or empty sets, are in no result.  Ties of similarity with
    the threshold count as similar.  An empty table gives empty results.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    # sort_array compares natively; the filter and the hash read what was written, or the sets would be made three times
    sets = stage(sets.where(F.col("id").isNotNull()).select("id", F.sort_array(F.array_distinct("tokens")).alias("tokens")), "sets")
    # sets are one if their sizes and two hashes agree, 128 bits of which the second is over salted elements
    same = [F.size("tokens").alias("n"), F.xxhash64("tokens").alias("one"), F.xxhash64(F.lit(0x5DEECE66D), "tokens", F.size("tokens")).alias("two")]
    sets = sets.where(F.size("tokens") > 0)
    keyed = sets.select("id", *same)
    first = keyed.groupBy("n", "one", "two").agg(F.min("id").alias("rep"))
    members = stage(keyed.join(first, ["n", "one", "two"]).select("id", "rep"), "members")
    reps = sets.join(members.where("id = rep").select("id"), "id", "left_semi").select("id", "tokens")
    reps = stage(reps, "reps")
    candidates = stage(_candidates(_postings(reps, _cell_counts(reps), threshold, list_size), threshold), "candidates")
    sizes = reps.select("id", F.size("tokens").alias("n"))
    found = _overlaps(candidates, reps, close).join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    jaccard = F.col("o") / (F.col("na") + F.col("nb") - F.col("o"))
    links = found.where(F.col("o") >= F.lit(threshold) * (F.col("na") + F.col("nb") - F.col("o")) - 1e-9).select("a", "b", "o", jaccard.alias("jaccard"))
    return SimilarSets(members, stage(links, "links"))


def answer_sets(answers: DataFrame, run: int, least_words: int, *, short: bool = False) -> DataFrame:
    """(id, tokens) of candidate answers: runs of words of the question, a blank and the answer.

    A question_id counts once; null ids and answers under ``least_words`` words are left out.  A null
    answer has no words.  With ``short``, a row without a run gets one hash of all its words as its set.
    """
    rows = answers.where(F.col("question_id").isNotNull()).select(F.col("question_id").alias("id"), "raw_question", "answer")
    rows = rows.withColumn("w", words(F.col("answer"))).where(F.size("w") >= least_words).dropDuplicates(["id"])
    # the words are a column of their own, or they would be extracted anew for each run
    rows = rows.select("id", F.concat(words(F.col("raw_question")), "w").alias("w"))
    tokens = word_runs(F.col("w"), run)
    if short:
        tokens = F.when(F.size("w") < run, F.array(F.xxhash64("w"))).otherwise(tokens)
    return rows.select("id", tokens.alias("tokens"))
