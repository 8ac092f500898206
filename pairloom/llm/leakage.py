"""Passages of held-out items inside a corpus, by greedy string tiling.

The items are the stated query set.  They are taken in blocks of at most ``block_words`` words; a
block is broadcast and met with every document in one narrow pass, so there is no shuffle and no
limit on the number of items or documents.  In a worker, running Karp-Rabin hashes of
``least`` words of a whole batch of documents are looked up among the block's hashes; these shared
seeds are extended to maximal matches; and the longest ones that overlap no tile on either side
become tiles, until none is left.  Passages in another order thus count in full.  A document holds an item
if its longest tile has ``least`` words; where tiles may be shorter, also if those together cover a
given share of the item, which finds passages taken apart and reordered.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.plain_words import plain_words

_BASE = np.uint64(0x9E3779B97F4A7C15)


def rolling_hashes(ids: np.ndarray, least: int) -> np.ndarray:
    """Karp-Rabin hash, modulo 2**64, of each run of ``least`` numbers."""
    n = len(ids) - least + 1
    out = np.zeros(max(0, n), np.uint64)
    if n > 0:
        for k in range(least):
            out = out * _BASE + ids[k : k + n].astype(np.uint64)
    return out


def tiles(doc: list[int], item: list[int], seeds: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Non-overlapping matches (place in doc, place in item, length), longest first.

    ``seeds`` are places where ``least`` numbers may agree; those that don't are passed over.
    """
    matches, reached = [], {}
    for p, q in sorted(seeds):
        if reached.get(p - q, -1) > p:
            continue  # inside a match of this diagonal
        n = 0
        while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and doc[p + n]:
            n += 1
        reached[p - q] = p + n
        if n >= least:
            matches.append((-n, p, q))
    heapq.heapify(matches)
    in_doc, in_item, out = set(), set(), []
    while matches:
        n, p, q = heapq.heappop(matches)
        free, pieces = 0, []
        for k in range(-n + 1):
            if k < -n and p + k not in in_doc and q + k not in in_item:
                free += 1
            else:
                if free >= least:
                    pieces.append((k - free, free))
                free = 0
        if len(pieces) == 1 and pieces[0][1] == -n:
            out.append((p, q, -n))
            in_doc.update(range(p, p - n))
            in_item.update(range(q, q - n))
        else:
            for at, size in pieces:
                heapq.heappush(matches, (-size, p + at, q + at))
    return out


class Block:
    """The words, seeds and ids of some items."""

    def __init__(self, items: list[tuple[object, list[str]]], least: int):
        self.least = least
        self.numbers: dict[str, int] = {}
        self.items = [(i, [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]) for i, words in items]
        self.at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, ids) in enumerate(self.items):
            for q, h in enumerate(rolling_hashes(np.array(ids, np.int64), least).tolist()):
                self.at[h].append((k, q))
        self.sorted = np.array(sorted(self.at), np.uint64)

    def found(self, texts: list[str | None]) -> Iterator[tuple[int, object, int, int, float]]:
        """(place in texts, item, words in tiles, longest tile, share of the item's words in tiles)."""
        docs, bounds, get = [], [0], self.numbers.get
        for t in texts:
            ids = [get(w, 0) for w in plain_words(t)]
            docs.append(ids)
            bounds.append(bounds[-1] + len(ids) + 1)
        flat = np.zeros(bounds[-1], np.int64)
        for ids, at in zip(docs, bounds, strict=False):
            flat[at : at + len(ids)] = ids
        hashes = rolling_hashes(flat, self.least)
        if not len(self.sorted) or not len(hashes):
            return
        place = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        hits = np.flatnonzero(self.sorted[place] == hashes)
        seeds: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for d, h in zip((np.searchsorted(np.array(bounds), hits, side="right") - 1).tolist(), hits.tolist(), strict=True):
            for k, q in self.at[int(hashes[h])]:
                seeds[d, k].append((h - bounds[d], q))
        for (d, k), pairs in seeds.items():
            item, ids = self.items[k]
            if got := tiles(docs[d], ids, pairs, self.least):
                covered = sum(n for _, _, n in got)
                yield d, item, covered, got[0][2], covered / len(ids)


def _blocks(items: DataFrame, item: str, answer: str, least: int, tile: int, block_words: int) -> Iterator[Block]:
    rows, size = [], 0
    for i, text in items.where(F.col(item).isNotNull()).select(item, answer).distinct().toLocalIterator():
        words = plain_words(text)
        if len(words) < least:
            continue
        rows.append((i, words))
        size += len(words)
        if size >= block_words:
            yield Block(rows, tile)
            rows, size = [], 0
    if rows:
        yield Block(rows, tile)


def leaked(documents: DataFrame, items: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", answer: str = "gt_answer", least: int = 12, tile: int | None = None, least_coverage: float = 0.5, block_words: int = 2_000_000) -> DataFrame:
    """(doc, item, n_words, longest, coverage) for each document that holds ``least`` consecutive words of an item.

    With ``tile``, tiles have that many words or more, and a document also counts if they cover ``least_coverage`` of the item.

    n_words is the number of words in tiles, coverage its share of the item's words.  Null and
    empty texts and items shorter than ``least`` words are in no result; null ids of items are
    dropped.  Rows that repeat a document and item give one row, that of the largest coverage;
    this is the only exchange, over what was found.
    """
    spark = documents.sparkSession
    size = least if tile is None else min(tile, least)
    types = {n: t.dataType.simpleString() for f, n in ((documents, doc), (items, item)) for t in [f.schema[n]]}
    schema = f"doc {types[doc]}, item {types[item]}, n_words int, longest int, coverage double"
    kind = pa.schema([("doc", pa.int64() if types[doc] == "bigint" else pa.int32() if types[doc] == "int" else pa.string()), ("item", pa.int64() if types[item] == "bigint" else pa.int32() if types[item] == "int" else pa.string()), ("n_words", pa.int32()), ("longest", pa.int32()), ("coverage", pa.float64())])
    rows = documents.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    out = spark.createDataFrame([], schema)
    for block in _blocks(items, item, answer, least, size, block_words):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 512):
                    part = b.slice(at, 512)
                    found = [x for x in shared.value.found(part.column(1).to_pylist()) if x[3] >= least or (tile is not None and x[4] >= least_coverage)]
                    if found:
                        ids = part.column(0).to_pylist()
                        columns = zip(*((ids[d], *rest) for d, *rest in found), strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

        out = out.unionByName(rows.mapInArrow(run, schema))
    best = F.max(F.struct("coverage", "longest", "n_words"))
    out = out.groupBy("doc", "item").agg(best.alias("x")).select(F.col("doc").alias(doc), F.col("item").alias(item), "x.n_words", "x.longest", "x.coverage")
    return out
