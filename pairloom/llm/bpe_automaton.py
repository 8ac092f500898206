"""Encoding of texts by a byte-level BPE vocabulary through a tokenization automaton.

The merges are compiled, one gadget after the other in rank order, into a deterministic automaton
over token labels.  A state is the token just emitted.  The gadget of merge k, (x, y) -> z, adds
the label z and forbids the arc that would leave x and y side by side: from every state whose
right edge is x when rank k applies, on every label whose left edge is y at that time.  As x
and y stand for whole classes of states and labels, each gadget is stored once, and a state is
described by the chain of pieces at its right edge (each with the rank at which it is merged
away), a label by the chain at its left edge.  An arc is allowed if no gadget fires along the two
chains.  Arcs are tabulated on first use, as a lazily determinised automaton does.

Every text has exactly one path, and so has every prefix of it; the encoder therefore scans a
word once, keeps for each position the single state that can end there, and reads the path back.
The work is linear in the word's length, whatever its size.  Decoding emits the arcs' labels.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public pre-split pattern of this vocabulary.
PRE_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Folder of the public tokenizers; a parameter of every function that reads it.
TOKENIZERS = "/opt/tokenizers"
_NEVER = 1 << 60


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, by its public rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_merges(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """Token ids and ranked merges of a vocabulary file, both in bytes; special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    symbols = byte_symbols()

    def to_bytes(s: str) -> bytes | None:
        return bytes(symbols[c] for c in s) if all(c in symbols for c in s) else None

    merges = [tuple(to_bytes(p) for p in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    parts = {a + b for a, b in merges} | {bytes([b]) for b in range(256)}
    ids = {t: i for s, i in model["vocab"].items() if (t := to_bytes(s)) is not None and t in parts}
    return ids, merges


class Automaton:
    """The compiled automaton; ``ids`` maps label bytes to token ids."""

    def __init__(self, ids: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ids = ids
        self.labels = {i: t for t, i in ids.items()}
        self.longest = max(map(len, ids))
        self.gadgets: dict[tuple[bytes, bytes], int] = {}
        #: Pieces at an edge, first to last, each with the rank at which the next one swallows it.
        self.right: dict[bytes, tuple[tuple[bytes, int], ...]] = {bytes([b]): ((bytes([b]), _NEVER),) for b in range(256)}
        self.left = dict(self.right)
        for rank, (x, y) in enumerate(merges):
            self._add(rank, x, y)
        self.arcs: dict[tuple[bytes, bytes], bool] = {}

    def _add(self, rank: int, x: bytes, y: bytes) -> None:
        """The gadget of one merge, onto what the earlier merges built."""
        if (x, y) in self.gadgets or x not in self.right or y not in self.right or self._fires(self.right[x], self.left[y]):
            return  # earlier merges leave x and y never side by side, so the label can't be reached this way
        self.gadgets[x, y] = rank
        z = x + y
        if z in self.right:  # a second way to the same label can't be reached by correct merging
            return
        (*rest, (last, _)) = self.right[y]
        self.right[z] = (*rest, (last, rank), (z, _NEVER))
        (*rest, (first, _)) = self.left[x]
        self.left[z] = (*rest, (first, rank), (z, _NEVER))

    def arc(self, state: bytes, label: bytes) -> bool:
        """Whether ``label`` may follow ``state``."""
        known = self.arcs.get((state, label))
        if known is None:
            known = self.arcs[state, label] = not self._fires(self.right[state], self.left[label])
        return known

    def _fires(self, right: tuple, left: tuple) -> bool:
        i = j = 0
        while True:
            a, a_ends = right[i]
            b, b_ends = left[j]
            rank = self.gadgets.get((a, b))
            # of merges of one rank the leftmost applies first: a's own wins, b's own loses
            if rank is not None and rank < a_ends and rank <= b_ends:
                return True
            if a_ends == b_ends == _NEVER:
                return False
            if a_ends <= b_ends:
                i += 1
                j += a_ends == b_ends
            else:
                j += 1

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one pre-split word."""
        whole = self.ids.get(word)
        if whole is not None and word in self.right:
            return [whole]  # a label that correct merging reaches is the path of its own bytes
        state: list[bytes | None] = [None] * (len(word) + 1)
        known, reached, arc = self.ids, self.right, self.arc
        for end in range(1, len(word) + 1):
            for begin in range(max(0, end - self.longest), end):
                label = word[begin:end]
                if label in reached and (begin == 0 or (state[begin] is not None and arc(state[begin], label))):
                    state[end] = label
                    break
        out, at = [], len(word)
        while at:
            label = state[at]
            out.append(known[label])
            at -= len(label)
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes along the path: the labels of its arcs, in order."""
        return b"".join(self.labels[i] for i in ids)


class Encoder:
    """An automaton with the pre-split pattern and a table of the words seen, emptied at ``keep`` words."""

    def __init__(self, ids: dict[bytes, int], merges: list, pattern: str = PRE_SPLIT, keep: int = 200_000):
        self.automaton = Automaton(ids, merges)
        self.split = regex.compile(pattern).findall
        self.keep = keep
        self.words: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text; an empty list for null and empty."""
        if not text:
            return []
        out: list[int] = []
        words = self.words
        for w in self.split(text):
            ids = words.get(w)
            if ids is None:
                if len(words) >= self.keep:
                    words.clear()
                    self.automaton.arcs.clear()
                ids = self.automaton.encode_word(w.encode("utf-8", "surrogatepass"))
                if len(w) <= 64:
                    words[w] = ids
            out.extend(ids)
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


def encode_table(df: DataFrame, id_column: str, text_column: str, tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k", pattern: str = PRE_SPLIT) -> DataFrame:
    """Rows (id, ids): the token ids of each row's text, without special tokens.

    Strings of special tokens inside a text are ordinary text.  Null and empty texts give an empty
    list; white space is text.  Repeated rows stay repeated, null ids stay, and an empty table
    gives an empty table.  Only the two columns named are read, whatever else the table holds.
    There is no shuffle: the vocabulary file, of fixed size, is broadcast; each Python worker
    compiles it once.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(read_merges(f"{tokenizers}/{name}.json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (f"{tokenizers}/{name}", pattern)
        encoder = _encoders.get(key)
        if encoder is None:
            encoder = _encoders[key] = Encoder(*shared.value, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = [encoder.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").select(F.col("id").alias(id_column), "ids")
