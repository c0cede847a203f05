"""Toxicity by a learned lexicon, misspellings included (operator 6).

The lexicon is learned from labelled documents: words, and stems that words begin
with, that occur far more often in toxic than in other documents.  It is kept as
a trie; a word is looked up by running the trie against the word's Levenshtein
automaton (one edit for words of five letters and more).  The product automaton
is made deterministic as words visit it, so that a word costs a step a letter and
most leave it after two or three.  Each hit is weighed by its context - in
quotation marks or after a word of reporting it counts less - and the hits of a
document, with the densest window of them, make the features of a logistic
regression.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripple.llm.common import fields, lean, quote, quoted, raw_texts, slices, small_batches
from ripple.llm.labelled import SAMPLE_BYTES, SAMPLE_ROWS, held_out, logistic, sigmoid, training_rows

WORD = re.compile(r"\w+")
MIN_STEM, MAX_STEM = 4, 12
MIN_TOXIC_DOCS = 5  # of the sample, that a term must occur in
MIN_RATIO = 6.0  # of its rates in toxic and in other documents
MAX_TERMS, CANDIDATES = 500, 20_000  # terms that are taken, and that are looked at, those in most toxic texts first
EDIT_FROM = 5  # letters from which a term admits one edit
WINDOW = 12  # words, for the densest window of hits
QUOTED = 0.25  # weight of a hit that is quoted or reported
# Opening and closing quotation marks, and words that report another's speech.
QUOTES = "\"“”„«»‘’‹›"
MARK = re.compile(f"[\n{QUOTES}]")
REPORTING = frozenset("said says called calls wrote writes quote quoted quotes word words term slur reported zitat sagte nannte dit écrit appelé citation dijo llamó escribió cita".split())

NONE, EXACT, FUZZY, STEM = range(4)


class Lexicon:
    """A trie of words and stems, run against words with at most one edit."""

    def __init__(self, words: list[str], stems: list[str]) -> None:
        self.words, self.stems = sorted(words), sorted(stems)
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, int]] = [(0, 0)]  # (length of the word that ends here, length of the stem)
        for term, kind in [(w, 0) for w in self.words] + [(s, 1) for s in self.stems]:
            at = 0
            for c in term:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ends.append((0, 0))
                at = self.next[at][c]
            ends = list(self.ends[at])
            ends[kind] = len(term)
            self.ends[at] = (ends[0], ends[1])
        # A state of the product: the trie nodes reached with no edit and with one.
        start = self._closed({(0, 0)})
        self.ids: dict[frozenset, int] = {start: 0}
        self.states: list[frozenset] = [start]
        self.steps: list[dict[str, int]] = [{}]
        self.marks = [self._mark(start)]

    def _closed(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With what leaving out a letter of the term reaches."""
        more = {(n, 1) for at, edits in pairs if edits == 0 for n in self.next[at].values()}
        return frozenset(pairs | {(n, 1) for n, _ in more if (n, 0) not in pairs})

    def _mark(self, state: frozenset) -> tuple[bool, int]:
        """(whether a stem ends here, the kind of hit if the word ends here)."""
        stem = any(edits == 0 and self.ends[at][1] for at, edits in state)
        if any(edits == 0 and self.ends[at][0] for at, edits in state):
            return stem, EXACT
        return stem, FUZZY if any(edits == 1 and self.ends[at][0] >= EDIT_FROM for at, edits in state) else NONE

    def _step(self, k: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for at, edits in self.states[k]:
            same = self.next[at].get(c)
            if same is not None:
                out.add((same, edits))
            if edits == 0:
                out.add((at, 1))  # a letter too many
                out.update((n, 1) for n in self.next[at].values())  # another letter
        state = self._closed(out)
        if not state:
            found = -1
        elif state in self.ids:
            found = self.ids[state]
        else:
            found = self.ids[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            self.marks.append(self._mark(state))
        self.steps[k][c] = found
        return found

    def kind(self, word: str) -> int:
        """EXACT, FUZZY, STEM or NONE."""
        at, stem = 0, False
        for c in word:
            step = self.steps[at].get(c)
            at = self._step(at, c) if step is None else step
            if at < 0:
                return STEM if stem else NONE
            stem = stem or self.marks[at][0]
        return self.marks[at][1] or (STEM if stem else NONE)


class Kinds(dict):
    """Remembers words' kinds, so many at a time."""

    def __init__(self, lexicon: Lexicon, limit: int = 60_000) -> None:
        super().__init__()
        self.lexicon, self.limit = lexicon, limit

    def __missing__(self, word: str) -> int:
        kind = self[word] = self.lexicon.kind(word)
        return kind


FEATURES = 7


def describe(text: str, kinds: Kinds) -> list[float]:
    """The features of one text."""
    low = text.lower()
    words = WORD.findall(low)
    if len(kinds) > kinds.limit:
        kinds.clear()
    found = np.fromiter(map(kinds.__getitem__, words), np.int8, len(words))
    hits = np.flatnonzero(found)
    if not len(hits):
        return [0.0] * FEATURES
    weights, wanted = np.ones(len(hits)), iter(hits.tolist())
    nth = next(wanted)
    if any(q in low for q in QUOTES) or not REPORTING.isdisjoint(words):
        # Less for a hit inside quotation marks of its line, or soon after a word of reporting.
        k, quoted, marks = 0, False, MARK.finditer(low)
        mark = next(marks, None)
        for i, m in enumerate(WORD.finditer(low)):
            if i == nth:
                while mark and mark.start() < m.start():
                    quoted = mark[0] != "\n" and not quoted
                    mark = next(marks, None)
                if quoted or not REPORTING.isdisjoint(words[max(0, i - 4) : i]):
                    weights[k] = QUOTED
                k, nth = k + 1, next(wanted, -1)
                if nth < 0:
                    break
    kind = found[hits]
    sums = [float(weights[kind == x].sum()) for x in (EXACT, FUZZY, STEM)]
    strong = np.cumsum(np.where(kind == FUZZY, 0.5, 1.0) * weights)
    first = np.searchsorted(hits, hits - WINDOW + 1)
    densest = float((strong - np.where(first > 0, strong[first - 1], 0)).max())
    distinct = len({words[i] for i in hits.tolist()})
    return [math.log1p(sums[0]), math.log1p(sums[1]), math.log1p(sums[2]), math.log1p(densest), math.log1p(distinct), min(1.0, 20 * float(strong[-1]) / len(words)), float((weights < 1).mean())]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the sample with their occurrences and documents by label."""
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            for word, n in Counter(WORD.findall(text.lower())).items():
                x = counts.setdefault(word, [0, 0, 0, 0])
                x[2 * label] += n
                x[2 * label + 1] += 1
    rows = list(counts.items())
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows]), *(pa.array([x[i] for _, x in rows], pa.int64()) for i in range(4))], names=["word", "n0", "d0", "n1", "d1"])


def learn_lexicon(sample: DataFrame, most: int = MAX_TERMS, candidates: int = CANDIDATES) -> Lexicon:
    """Terms of the bounded sample whose rate in toxic documents is MIN_RATIO times that in others.

    The ``candidates`` most frequent in toxic texts are looked at, and ``most`` are
    taken by the signed root of their likelihood ratio.  A word that begins with a
    stem already taken stands beside it and does not count towards ``most``: stems are met exactly, and its misspellings are met by the word.
    """
    words = sample.mapInArrow(lean(_counted), "word string, n0 long, d0 long, n1 long, d1 long")
    stems = [F.substring("word", 1, n) for n in range(MIN_STEM, MAX_STEM + 1)]
    terms = words.select("*", F.explode(F.array_distinct(F.array(F.concat(F.lit("="), "word"), *stems))).alias("term"))
    terms = terms.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n0", "d0", "n1", "d1")], F.countDistinct("word").alias("forms")).where(F.col("d1") >= MIN_TOXIC_DOCS)
    share = sample.agg(F.count_if(F.col("label") == 0).alias("a"), F.count_if(F.col("label") == 1).alias("b")).first()
    rate = (F.col("n1") / max(1, share["b"])) / ((F.col("n0") + 0.5) / max(1, share["a"]))
    rows = terms.withColumn("rate", rate).where(F.col("rate") >= MIN_RATIO).orderBy(F.desc("n1"), "term").limit(candidates).collect()

    def surprise(r) -> float:
        n, expected = r["n1"] + r["n0"], (r["n1"] + r["n0"]) * share["b"] / (share["a"] + share["b"])
        return 2 * (r["n1"] * math.log(r["n1"] / expected) + (r["n0"] * math.log(r["n0"] / (n - expected)) if r["n0"] else 0))

    whole, begun, covered = [], [], []
    for r in sorted(rows, key=lambda r: (-round(surprise(r), 6), r["term"][0] != "=", -len(r["term"]), r["term"])):
        word = r["term"].removeprefix("=")
        if any(word.startswith(s) for s in begun):
            if r["term"][0] == "=":
                covered.append(word)
            continue
        if word in whole or len(whole) + len(begun) >= most:
            continue
        if r["term"][0] == "=":
            whole.append(word)
        elif r["forms"] > 1 and not any(w.startswith(word) for w in whole) and not any(s.startswith(word) for s in begun):
            begun.append(word)
    return Lexicon(whole + covered, begun)


def _described(batch: pa.RecordBatch, kinds: Kinds) -> np.ndarray:
    return np.array([describe(t.decode("utf-8", "replace"), kinds) for t in raw_texts(batch, "text")])


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES, most: int = MAX_TERMS, candidates: int = CANDIDATES
) -> tuple[Lexicon, np.ndarray]:
    """(lexicon, weights) learned from labelled documents outside the held-out fold.

    The bounds of the fit are ``rows`` documents of ``size`` bytes in all, ``candidates``
    terms that are looked at and ``most`` that are taken.
    """
    small_batches(docs.sparkSession)
    sample = training_rows(docs, labels, label, key, text, rows, size)
    lexicon = learn_lexicon(sample, most, candidates)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.words, lexicon.stems))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = Kinds(Lexicon(*shared.value))
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(_described(batch, kinds).tolist(), pa.list_(pa.float64())), batch.column("label")], names=["x", "label"])

    got = sample.select("text", "label").mapInArrow(lean(run), "x array<double>, label int").toArrow()
    if not got.num_rows:
        return lexicon, np.append(np.zeros(FEATURES), -3.0)
    order = sorted(zip(got.column("x").to_pylist(), got.column("label").to_pylist(), strict=True))  # the same sums for any partitioning
    return lexicon, logistic(np.array([x for x, _ in order]), np.array([y for _, y in order], dtype=float))


def score(docs: DataFrame, model: tuple[Lexicon, np.ndarray], key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1, higher: likelier toxic), ``predicted`` and ``any_hit``.

    Null and empty texts have no hits and the score of such texts.  Repeated
    rows have equal scores; columns named as the results are replaced; an empty
    table gives an empty one.  Without any labelled row the lexicon is empty and
    every text scores the same.  The model, of a bounded number of terms, is sent to
    all tasks; the automaton's states are made and dropped within a task.
    """
    small_batches(docs.sparkSession)
    lexicon, weights = model
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.words, lexicon.stems))
    others = [c for c in docs.columns if c not in ("score", "predicted", "any_hit")]
    wide = docs.select(F.struct(*quoted(others)).alias("row"), F.col(quote(text)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = Kinds(Lexicon(*shared.value))
        for batch in slices(batches, "text"):
            x = _described(batch, kinds)
            p = sigmoid(x @ weights[:-1] + weights[-1])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(x[:, 4] > 0)], names=["row", "score", "predicted", "any_hit"])

    done = wide.mapInArrow(lean(run), fields(row=wide.schema["row"].dataType, score="double", predicted="int", any_hit="boolean"))
    return done.select(*[F.col("row." + quote(c)).alias(c) for c in others], "score", "predicted", "any_hit")


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) for each document."""
    plain = docs.select(*quoted([key, text]))
    done = score(plain, fit(docs, labels, "toxic", key, text), key, text)
    return done.select(F.col(quote(key)), held_out(F.col(quote(key))).alias("held_out"), "score", "predicted")
