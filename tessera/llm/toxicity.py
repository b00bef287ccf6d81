"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding makes disguised spellings equal to plain ones: case, homoglyphs of
other scripts, digits and signs that stand for letters, letters set apart or
repeated, zero-width characters and marks strewn over letters.  Accented letters stay: they tell words apart.  The lexicon (word stems and whole words with weights)
and its exception phrases are learned from labelled texts; the match weights,
normalised by the text's length, go through a fitted logistic curve.

Training uses at most ``max_labelled`` labelled rows (those with the least hash
of doc_id), a documented bound on what the one task that learns holds; the
driver gets the lexicon alone.  Everything else
covers whole texts and all rows.

Defined results: null and empty texts get the score of a text without matches;
a table without labels of both kinds gives an empty lexicon and score 0;
texts of any length are scored whole; words of over 40 letters are matched but
never enter the lexicon; an empty table gives an empty one; equal texts get equal
scores; labels, ids, languages, sources and other
columns are never inputs of a score.
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe",
}
#: Digits that stand for letters; l and i are one class, as 1 stands for both.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "l": "i"}
#: Signs that stand for letters inside a word; the first three at its edges too, next to a letter.
SIGNS = {"@": "a", "$": "s", "€": "e", "!": "i", "|": "i", "+": "t"}
_SIGN_IN_WORD = re.compile(r"(?<=\w)[@$!|€+]+(?=\w)|(?<![\w@$€])[@$€]+(?=[^\W\d_])|(?<=[^\W\d_])[@$€]+(?![\w@$€])")
#: Four letters or more, each set apart by the same sign or space.
_SPACED = re.compile(r"(?<!\w)\w([.\-_*·,/ ])\w(?:\1\w){2,}(?!\w)")
#: A letter three times or more in a row.
_ROW = re.compile(r"([^\W\d_])\1{2,}")
_WORD = re.compile(r"\w+")
SHORTEST, LONGEST = 3, 10


class _Fold(dict):
    """Code points to folded letters; what is neither letter nor digit separates words."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Cf", "Mn", "Me"):
            out = None
        elif kind[0] not in "LN":
            out = " "
        else:
            plain = unicodedata.normalize("NFKC", c).lower()
            out = "".join(DIGITS.get(y, y) for x in plain for y in HOMOGLYPHS.get(x, x)) or " "
        self[code] = out
        return out


_FOLD = _Fold()


def _spellings(word: str) -> str:
    """The word, or if it is stretched its spellings with two letters of a row and with one."""
    one = _ROW.sub(r"\1", word)
    return word if one == word else _ROW.sub(r"\1\1", word) + " " + one


def fold(text: str | None) -> str:
    """The text in folded letters, words set apart by spaces, one at either end."""
    text = unicodedata.normalize("NFC", text or "").lower()
    if any(s in text for s in SIGNS):
        text = _SIGN_IN_WORD.sub(lambda m: "".join(SIGNS[c] for c in m[0]), text)
    text = _SPACED.sub(lambda m: m[0].replace(m[1], ""), text)
    if _ROW.search(text):
        text = _WORD.sub(lambda m: _spellings(m[0]), text)
    return f" {text.translate(_FOLD)} "


def units(folded: str) -> set[str]:
    """What may enter the lexicon: word stems (' abc') and whole words (' abc ')."""
    out = set()
    for w in set(folded.split()):
        if len(w) <= 40:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in range(SHORTEST, min(len(w), LONGEST + 1)))
    return out


@dataclass
class Lexicon:
    """Weights by pattern, exception phrases, and the curve (offset, slopes)."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    curve: tuple[float, ...] = ()

    def __post_init__(self) -> None:
        self._machine = None

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "_machine": None}

    def machine(self) -> ahocorasick.Automaton | None:
        if self._machine is None and self.weights:
            self._machine = ahocorasick.Automaton()
            for p in self.exceptions:
                self._machine.add_word(p, (len(p), 0.0))
            for p, w in self.weights.items():
                self._machine.add_word(p, (len(p), w))
            self._machine.make_automaton()
        return self._machine

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the lexicon's matches; one for each word, none inside an exception."""
        machine = self.machine()
        if machine is None:
            return []
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for last, (n, w) in machine.iter(folded):
            start = last - n + 1
            if not w:
                spared.append((start, last))
            elif start not in best or w > best[start][1]:
                best[start] = (last, w)
        found = [(a, b, w) for a, (b, w) in best.items()]
        if spared:
            found = [x for x in found if not any(a <= x[0] and x[0] < b for a, b in spared)]
        return found

    def features(self, folded: str) -> tuple[float, float]:
        total = sum(w for _, _, w in self.matches(folded))
        return (math.log1p(total), math.log1p(100 * total / (folded.count(" ") + 20))) if total else (0.0, 0.0)

    def score(self, text: str | None) -> float:
        """From 0 to 1; higher: more likely toxic."""
        if not self.curve:
            return 0.0
        x = self.features(fold(text))
        z = self.curve[0] + sum(a * b for a, b in zip(self.curve[1:], x))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def families(folded: list[str], kept: int = 8) -> list[list[str]]:
    """The texts in groups of near copies, which share some of their least shingle hashes."""
    root = list(range(len(folded)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    first: dict[int, int] = {}
    for i, t in enumerate(folded):
        w = t.split()
        for h in sorted({zlib.crc32(" ".join(w[j : j + 3]).encode()) for j in range(len(w) - 2)})[:kept]:
            a, b = find(first.setdefault(h, i)), find(i)
            root[max(a, b)] = min(a, b)
    groups: dict[int, list[str]] = {}
    for i, t in enumerate(folded):
        groups.setdefault(find(i), []).append(t)
    return list(groups.values())


def learn(texts: list[str], toxic: list[int], least_gain: float = 16.0, least_weight: float = 4.0) -> Lexicon:
    """A lexicon from labelled texts.

    A unit enters if its log-likelihood gain over the share of toxic texts is at
    least ``least_gain`` (chance, over all units seen, would not give that) and
    its log-odds at least ``least_weight``.  A stem that nearly always
    continues in one way gives way to the longer form, which spares innocent
    words; otherwise a stem as telling as its longer forms replaces them.
    """
    folded = dict(zip((fold(t) for t in texts), toxic))  # equal texts count once
    bad, good = [t for t, y in folded.items() if y], [t for t, y in folded.items() if not y]
    if not bad or not good:
        return Lexicon()
    prior = len(bad) / len(folded)
    # near copies count once: else each word of a copied toxic text would look telling
    grouped = families(bad)
    in_bad: Counter = Counter()
    for group in grouped:
        in_bad.update(set().union(*map(units, group)))
    least = max(4, math.ceil(least_gain / -math.log(prior)))
    in_bad = Counter({u: n for u, n in in_bad.items() if n >= least})
    in_good: Counter = Counter()
    for t in good:
        in_good.update(in_bad.keys() & units(t))
    weights = {}
    longer: dict[str, list[str]] = {u: [] for u in in_bad}
    for v in in_bad:
        for k in range(SHORTEST + 1, len(v)):
            if v[:k] in longer:
                longer[v[:k]].append(v)
    for u, n in in_bad.items():
        m = in_good[u]
        gain = n * math.log(n / (n + m) / prior) + (m and m * math.log(m / (n + m) / (1 - prior)))
        odds = math.log((n + 0.5) / (len(grouped) + 1)) - math.log((m + 0.5) / (len(good) + 1))
        if gain >= least_gain and odds >= least_weight and n / (n + m) > 0.5:
            weights[u] = odds
    for u in sorted(weights, key=len):
        if any(v in weights and in_bad[v] >= 0.97 * in_bad[u] for v in longer[u]):
            del weights[u]
    for u in sorted(weights, key=len, reverse=True):
        stems = [u[:k] for k in range(SHORTEST + 1, len(u))]
        if any(s in weights and weights[s] >= weights[u] - 0.5 for s in stems):
            del weights[u]
    # phrases around matches that only clean texts have
    lexicon, phrases, toxic_phrases = Lexicon(weights), Counter(), set()
    for t, y in folded.items():
        own = set()
        for a, b, _ in lexicon.matches(t):
            end = t.find(" ", max(b, a + 1))
            after = t.find(" ", end + 1)
            before = t.rfind(" ", 0, a)
            own.update(p for p in (t[a : after + 1] if after > 0 else "", t[before : end + 1] if before >= 0 else "") if len(p.split()) == 2)
        if y:
            toxic_phrases |= own
        else:
            phrases.update(own)
    lexicon = Lexicon(weights, {p for p, n in phrases.items() if n >= 3 and p not in toxic_phrases})
    x = np.array([(1.0, *lexicon.features(t)) for t in folded])
    y = np.array(list(folded.values()), float)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.02, 0.02]), x.T @ (y - p) - np.array([1e-3, 0.02, 0.02]) * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    lexicon.curve = tuple(w.tolist())
    return lexicon


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are never learned from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 8_000) -> Lexicon:
    """A lexicon from at most max_labelled labelled rows that are not held out."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id").select("text", "toxic")
    common.bounded_batches(docs.sparkSession)
    found = rows.repartition(1).mapInArrow(_learned, "lexicon binary").first()
    return pickle.loads(found["lexicon"]) if found else Lexicon()


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lexicon, pickled, from rows (text, toxic) in any order."""
    rows = [row for batch in batches for row in zip(common.values_of(batch, "text"), common.values_of(batch, "toxic"))]
    rows.sort(key=lambda row: (row[0] is None, row[0] or "", row[1]))
    lexicon = learn([t or "" for t, _ in rows], [int(y > 0) for _, y in rows])
    yield pa.RecordBatch.from_pydict({"lexicon": pa.array([pickle.dumps(lexicon)], pa.binary())})


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of each row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batch: pa.RecordBatch) -> dict:
        scores = [lexicon.score(t) for t in common.texts_of(batch)]
        return {"doc_id": batch.column(batch.schema.get_field_index("doc_id")), "score": scores, "predicted": [int(s >= threshold) for s in scores]}

    return common.map_batches(docs.select("doc_id", "text"), run, schema)


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score is below the threshold, all columns as they are."""
    common.bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            kept = [lexicon.score(t) < threshold for t in batch.column(at).to_pylist()]
            if any(kept):
                yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
