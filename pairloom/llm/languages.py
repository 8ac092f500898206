"""The language of short texts, by script and by character models trained on the corpus (numpy, for use in workers).

Pieces between sentence and quotation marks are told apart by script where one language uses it
here.  Latin pieces are scored by interpolated models of three characters, one a language.  They are
trained on the distinct pieces of the whole corpus, which are first labelled by function words and then, once
more, by the models themselves.  A piece that the best model finds stranger than anything of its
language seen in training (each part scored by models of the other part) is in a language unknown
to all, ``??``: foreign to each of them.

Training counts in the workers: only the counts of three characters, at most 64^3 a language and part whatever the
size of the corpus, and one greatest value a language reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.core.staging import drop_stage, stage
from pairloom.llm.plain_words import without_markup

#: Function words by language, the first labels of the pieces.
FUNCTION_WORDS = {
    "de": "aber alle alles als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer eines er es etwas für gibt hat ich im in ist kann man mit nach neben nicht noch oder ohne sehr sich sie sieht sind so steht über um und unter vom von vor war was wie wird zu zum zur außerdem jemand wirkt fällt".split(),
    "en": "a about across after all an and another any are around as at be because been before behind below beneath beside besides between both but by can cannot could did do does each for from further has have he her here him his how i if in is it its itself just like look looks me most my near next no not of off on one only or other our out over put rather she should so some such than that the their them there these they this those through to too toward two under until up upon was we were what when where which while who whose will with without would you your".split(),
    "es": "a al algo algunas alguna alguno algunos ante aquí así casi cerca como con cuando de del dentro desde donde dónde e el ella ellas ellos en entre era es esa ese eso esta está estaba están este esto fue ha hacia hasta hay junto la las le les lo los más mi muy no nos o para parece pero por porque puede que qué se ser si sin sobre son su sus también tan tanto todo todos tras un una unas uno unos y ya lado fondo imagen ve".split(),
    "fr": "à a aussi au aux avec ce ces cette comme dans de des du elle en entre est et été être eux il ils je la le les leur lui mais même mon ne nous on ont ou où par pas plus pour près qu que quelqu quelque qui sa sans se ses si son sont sous sur tout très un une vers vous voit y côté fond tombe semble".split(),
    "it": "a ai al alla alle anche che chi ci come con così da dal dalla dei del della delle di dove e è era gli ha i il in io la le lo ma mi molto nel nella non o per più qui se si sono su sul sulla tra un una uno vicino".split(),
    "pt": "a ao aos as até com como da das de do dos e é ela ele em entre era essa esse esta está este eu foi há isso já mais mas me mesmo muito na nas não no nos o os ou para pela pelo perto por que quem se sem ser seu sua são também um uma uns".split(),
}
#: Names of languages in requests for an answer in one.
LANGUAGE_NAMES = {
    "ar": ["arabic"],
    "de": ["german", "deutsch", "alemán", "德语", "德文", "немецком"],
    "en": ["english", "inglés", "englisch", "anglais", "英语", "英文", "английском"],
    "es": ["spanish", "español", "castellano", "spanisch", "espagnol", "西班牙语", "испанском"],
    "fr": ["french", "francés", "französisch", "français", "法语", "法文", "французском"],
    "hi": ["hindi"],
    "it": ["italian", "italiano"],
    "ja": ["japanese", "日语", "日文"],
    "ko": ["korean"],
    "pt": ["portuguese", "portugués"],
    "ru": ["russian", "ruso", "russisch", "russe", "俄语", "俄文", "русском"],
    "zh": ["chinese", "mandarin", "chino", "chinesisch", "chinois", "中文", "汉语", "китайском"],
    "??": ["czech", "danish", "dutch", "finnish", "hungarian", "indonesian", "norwegian", "polish", "romanian", "swedish", "turkish", "vietnamese"],
}
FOREIGN = "??"
#: Ranges of letters of the scripts that tell a language here.
SCRIPTS = {
    "zh": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)],
    "ja": [(0x3041, 0x3096), (0x30A1, 0x30FA), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)],
    "ru": [(0x400, 0x52F)],
    "ko": [(0x1100, 0x11FF), (0x3131, 0x318E), (0xAC00, 0xD7A3)],
    "ar": [(0x620, 0x64A), (0x66E, 0x6D3), (0x750, 0x77F)],
    "el": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "he": [(0x5D0, 0x5EA)],
    "hi": [(0x904, 0x939), (0x958, 0x961)],
    "th": [(0xE01, 0xE30)],
}
_LATIN = [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF)]
#: Weights of the probabilities given two, one and no characters before, and of a uniform one.
WEIGHTS = (0.6, 0.27, 0.12, 0.01)
#: Latin letters a piece must have to be told at all, and to be called foreign; and the least lead, in nats, of the best language.
TOLD_LETTERS, FOREIGN_LETTERS, LEAD = 8, 20, 3.0
#: How much stranger than all of its language a piece must be to be foreign, in nats a character: at least,
#: and by the inverse square root of the number of pieces the language was learnt from.
STRANGER = (0.1, 10.0)
_CODES = list(SCRIPTS)
_TABLE = np.zeros(0x110000, np.int8)
for _k, _c in enumerate(_CODES):
    for _a, _b in SCRIPTS[_c]:
        _TABLE[_a : _b + 1] = _k + 2
for _a, _b in _LATIN:
    _TABLE[_a : _b + 1] = 1
_SIZE = 64
#: Latin letters by place: the basic and accented ones of the first blocks, folded together beyond them.
_SLOT = np.zeros(0x110000, np.int16)
for _c in range(0x2000):
    if _TABLE[_c] == 1:
        _low = ord(chr(_c).lower()[0])
        _SLOT[_c] = _low - 96 if _low < 123 else 27 + (_low - 0xDF) if _low < 0x100 else 60 + _low % 4
_split = regex.compile(r"[.!?。！？…\n\"“”«»]+").split
_words = regex.compile(r"\p{L}+").findall
_ascii_words = re.compile(r"[a-z]+").findall
_request = regex.compile(r"(?:\b(?:in|en|auf|на)\s+|用)(\p{L}+)", regex.IGNORECASE)


class _Flat:
    """Pieces laid end to end: their characters, where each begins, and the number of letters of each script."""

    def __init__(self, pieces: list[str]):
        self.n, self.pieces = len(pieces), pieces
        codes = np.frombuffer("\n".join([*pieces, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.script = _TABLE[codes]
        self.starts = np.cumsum([0, *[len(p) + 1 for p in pieces]])[:-1]
        self.slot = _SLOT[codes].astype(np.int64)
        kinds = np.flatnonzero(np.bincount(self.script, minlength=len(_CODES) + 2)[1:]) + 1
        self.letters = {int(k): np.add.reduceat((self.script == k).astype(np.int32), self.starts) for k in kinds} if self.n else {}

    def of(self, places: np.ndarray) -> _Flat:
        """The pieces at some places by themselves."""
        return _Flat([self.pieces[k] for k in places.tolist()])

    def trigrams(self) -> np.ndarray:
        """The key of the three characters that end at each place; a run of other characters counts as one blank, as does what is before a piece."""
        padded = np.concatenate([[0, 0], self.slot])
        one, two = padded[1:-1], padded[:-2].copy()
        two[self.starts] = 0
        key = (two * _SIZE + one) * _SIZE + self.slot
        return np.where((self.slot == 0) & (one == 0), -1, key)


class Languages:
    """Trained character models; ``shares``, ``main`` and ``is_mainly`` tell the languages of texts."""

    def __init__(self, counts: np.ndarray):
        """``counts``: for each language the number of each three characters, besides those of its function words."""
        self.codes = list(FUNCTION_WORDS)
        self.tables = [self._trained(code, n) for code, n in zip(self.codes, counts, strict=True)]
        #: For each language the surprisal of a character from which a piece is foreign.
        self.strangest = np.full(len(self.codes), np.inf)

    @staticmethod
    def _lengths(flat: _Flat) -> np.ndarray:
        return np.add.reduceat((flat.trigrams() >= 0).astype(np.int32), flat.starts) if flat.n else np.zeros(0, int)

    @staticmethod
    def _trained(code: str, counts: np.ndarray) -> np.ndarray:
        """The surprisal of each three characters, in nats; 0 in a last place for those that count as none."""
        own = _Flat([" ".join(FUNCTION_WORDS[code])]).trigrams()
        three = (counts + np.bincount(own[own >= 0], minlength=_SIZE**3)).reshape(_SIZE, _SIZE, _SIZE).astype(np.float64)
        two = three.sum(0)
        one = two.sum(0)
        p = WEIGHTS[0] * three / np.maximum(three.sum(2, keepdims=True), 1) + (WEIGHTS[1] * two / np.maximum(two.sum(1, keepdims=True), 1) + WEIGHTS[2] * one / one.sum())[None]
        return np.append(-np.log(p + WEIGHTS[3] / _SIZE).astype(np.float32).ravel(), np.float32(0))

    def _scores(self, flat: _Flat) -> np.ndarray:
        """Surprisal of each piece under each language."""
        if not flat.n:
            return np.zeros((0, len(self.tables)))
        at = flat.trigrams()
        return np.stack([np.add.reduceat(t[at], flat.starts, dtype=np.float64) for t in self.tables], 1)

    def labels(self, flat: _Flat, by_words: np.ndarray) -> np.ndarray:
        """The place of each piece's language: by function words, else the best by these models where it leads; -1 if none."""
        first, latin, total = _first_labels(flat, by_words)
        ask = np.flatnonzero((first < 0) & (latin >= TOLD_LETTERS) & (2 * latin >= total))
        if len(ask):
            score = self._scores(flat.of(ask))
            order = np.sort(score, 1)
            first[ask] = np.where(order[:, 1] - order[:, 0] >= LEAD, score.argmin(1), -1)
        return first

    def of_pieces(self, pieces: list[str]) -> tuple[list[str | None], np.ndarray]:
        """The language of each piece (None if it can't be told), and its letters (one of Han or Kana counts three)."""
        flat = _Flat(pieces)
        codes: np.ndarray = np.full(flat.n, None, object)
        if not flat.n or not flat.letters:
            return codes.tolist(), np.zeros(flat.n, int)
        total = sum(flat.letters.values())
        latin = flat.letters.get(1)
        if latin is not None:
            some = np.flatnonzero((latin > 0) & (2 * latin >= total))
            score, n = self._scores(flat)[some], self._lengths(flat)[some]
            order = np.sort(score, 1)
            best = score.argmin(1)
            strange = (order[:, 0] / np.maximum(n, 1) > self.strangest[best]) & (latin[some] >= FOREIGN_LETTERS)
            names = np.array(self.codes, object)[best]
            codes[some] = np.where(strange, FOREIGN, np.where((order[:, 1] - order[:, 0] >= LEAD) & (latin[some] >= TOLD_LETTERS), names, None))
        for k, n in flat.letters.items():
            if k > 1:
                codes[(2 * n >= total) & (n > 0)] = _CODES[k - 2]
        kana = flat.letters.get(_CODES.index("ja") + 2)
        if kana is not None:
            codes[kana > 0] = "ja"
        return codes.tolist(), np.where(np.isin(codes, ["zh", "ja"]), 3 * total, total)

    def shares(self, texts: list[str]) -> list[dict[str | None, float]]:
        """For each text the share of its letters in each language, by pieces."""
        parts = [pieces_of(t) for t in texts]
        codes, weights = self.of_pieces([p for x in parts for p in x])
        weights, out, at = weights.tolist(), [], 0
        for x in parts:
            total: dict[str | None, float] = {}
            for k in range(at, at + len(x)):
                if weights[k]:
                    total[codes[k]] = total.get(codes[k], 0) + weights[k]
            at += len(x)
            whole = sum(total.values())
            out.append({k: v / whole for k, v in total.items()})
        return out

    def main(self, texts: list[str]) -> list[str | None]:
        """For each text the language, if it can be told, with the largest share."""
        known = [{k: v for k, v in s.items() if k} for s in self.shares(texts)]
        return [max(s, key=s.get) if s else None for s in known]


def pieces_of(text: str) -> list[str]:
    """Sentences and parts of them between quotation marks."""
    return [p for p in _split(text) if p]


def _by_words(piece: str) -> int:
    """The place of the language with clearly the most function words, or -1."""
    low = piece.lower()
    packed = sum(map(_hits, _ascii_words(low) if low.isascii() else _words(low), repeat(0)))
    if not packed:
        return -1
    hits = sorted(((packed >> 32 * k & 0xFFFFFFFF, -k) for k in range(len(FUNCTION_WORDS))), reverse=True)
    return -hits[0][1] if hits[0][0] >= 2 and hits[0][0] >= 1.5 * hits[1][0] else -1


#: For each function word one in the place, of 32 bits, of each of its languages.
_hits = {w: sum(1 << 32 * k for k, s in enumerate(FUNCTION_WORDS.values()) if w in s) for s in FUNCTION_WORDS.values() for w in s}.get


def _first_labels(flat: _Flat, by_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The labels by function words of the pieces mostly of Latin letters, -1 for others; the Latin and all letters of each."""
    latin = flat.letters.get(1, np.zeros(flat.n, int))
    total = sum(flat.letters.values()) if flat.letters else latin
    return np.where(2 * latin >= np.maximum(1, total), by_words, -1), latin, total


def _counted(pieces: DataFrame, labels: Callable[[_Flat, np.ndarray], np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """By part and label the number of each three characters, and the number of pieces."""
    n, size = len(FUNCTION_WORDS), _SIZE**3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, of_label = np.zeros(2 * n * size, np.int64), np.zeros(2 * n, np.int64)
        for flat, by_words, part in _flats(batches, rows):
            label = labels(flat, by_words)
            group = np.where(label < 0, -1, part * n + label)
            of_label += np.bincount(group[group >= 0], minlength=2 * n)
            keys, of = flat.trigrams(), np.repeat(group, np.diff(np.append(flat.starts, len(flat.slot))))
            ok = (keys >= 0) & (of >= 0)
            found, times = np.unique(of[ok] * size + keys[ok], return_counts=True)
            counts[found] += times
        some = np.flatnonzero(counts)
        # numbers of pieces follow after all keys
        keys, values = np.concatenate([some, 2 * n * size + np.arange(2 * n)]), np.concatenate([counts[some], of_label])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.int64())], names=["key", "n"])

    got = pieces.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * n * size + 2 * n, np.int64)
    out[got["key"].to_numpy()] = got["n"].to_numpy()
    return out[: 2 * n * size].reshape(2, n, size), out[2 * n * size :].reshape(2, n)


def _flats(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[_Flat, np.ndarray, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            yield _Flat(part.column(0).to_pylist()), part.column(1).to_numpy().astype(int), part.column(2).to_numpy().astype(int)


def fitted(texts: DataFrame, rows: int = 4096) -> Languages:
    """Models trained on the distinct pieces of all texts of (text); ``rows`` pieces are held at once in a worker.

    Four scans: pieces, counts by function words, counts by the models of these, and the strangest piece of
    each language under models of the part, by a hash, that it is not in.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = list(dict.fromkeys(p for t in b.column(0).to_pylist() if t for p in pieces_of(without_markup(t))))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([_by_words(p) for p in own], pa.int8())], names=["piece", "by_words"])

    distinct = texts.select("text").mapInArrow(split, "piece string, by_words tinyint").distinct()
    pieces = stage(distinct.withColumn("part", F.pmod(F.xxhash64("piece"), F.lit(2)).cast("tinyint")), "pieces")
    context = pieces.sparkSession.sparkContext
    by_words, _ = _counted(pieces, lambda flat, first: _first_labels(flat, first)[0], rows)
    first = context.broadcast(Languages(by_words.sum(0)))
    counts, of_label = _counted(pieces, lambda flat, words: first.value.labels(flat, words), rows)
    parts = context.broadcast([Languages(counts[1]), Languages(counts[0])])

    def strangest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.full(len(FUNCTION_WORDS), -np.inf)
        tables = [np.concatenate(known.tables) for known in parts.value]
        for flat, words, part in _flats(batches, rows):
            if not flat.n:
                continue
            label = first.value.labels(flat, words)
            use = (label >= 0) & (flat.letters.get(1, np.zeros(flat.n, int)) >= FOREIGN_LETTERS)
            keys, size, sizes = flat.trigrams(), _SIZE**3 + 1, np.diff(np.append(flat.starts, len(flat.slot)))
            at = np.where(keys < 0, size - 1, keys) + np.repeat(np.maximum(label, 0) * size, sizes)
            surprisal = np.where(np.repeat(part, sizes) == 0, tables[0][at], tables[1][at])
            mean = np.add.reduceat(surprisal, flat.starts, dtype=np.float64) / np.maximum(Languages._lengths(flat), 1)
            np.maximum.at(most, label[use], mean[use])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(most)), pa.int32()), pa.array(most, pa.float64())], names=["k", "most"])

    known = Languages(counts.sum(0))
    for k, most in pieces.mapInArrow(strangest, "k int, most double").groupBy("k").agg(F.max("most")).collect():
        if most > -np.inf:
            known.strangest[k] = most
    known.strangest += STRANGER[0] + STRANGER[1] / np.sqrt(np.maximum(1, of_label.sum(0)))
    drop_stage(pieces)
    return known


def requested_languages(question: str) -> set[str]:
    """Languages that a question names as the one to answer in."""
    names = {m[1].lower() for m in _request.finditer(question)}
    return {code for code, own in LANGUAGE_NAMES.items() for n in own if n in names or (not n.isascii() and f"用{n}" in question)}
