"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, look-alike letters, digit substitutions,
invisible characters) and matched with Aho-Corasick against a learned lexicon
of words and word beginnings.  Matches inside an exception phrase do not
count.  The weight sum, also normalised by text length, goes through a
logistic calibration.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipcast.llm.common import bounded_sample, giving_back, ship_package, staged

#: Letters that look like a Latin letter, and digits and signs
#: written in place of one.
LOOK_ALIKES = dict(
    zip(
        "аеорсухіѕјкмтнвԁһ"
        "αεοικνρτυχı",
        "aeopcyxisjkmthbdh" "aeoikvptuxi",
        strict=True,
    )
)
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
PREFIX_LENGTHS = (4, 5, 6, 7, 8)


class Folding(dict):
    """Translation table that fills itself: a letter folds to its plain small
    form, an invisible character goes, anything else parts words."""

    def __missing__(self, point: int) -> str:
        char = chr(point)
        kind = unicodedata.category(char)
        if kind in ("Cf", "Mn", "Me"):
            found = ""
        else:
            plain = [c for c in unicodedata.normalize("NFKD", char).lower() if unicodedata.category(c) != "Mn"]
            found = "".join(
                SUBSTITUTES.get(c) or LOOK_ALIKES.get(c) or (c if c.isalpha() else " ") for c in plain
            )
        self[point] = found
        return found


_FOLDING = Folding()


def fold(text: str) -> str:
    """Folded words of a text, each with one blank before and after."""
    return f" {' '.join(text.translate(_FOLDING).split())} "


def terms_of(folded: str) -> set[str]:
    """`` word `` for every word and `` beginning`` for its beginnings."""
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in PREFIX_LENGTHS if len(w) >= n}


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    #: calibration: intercept, then one weight for each of ``features``
    weights: tuple[float, ...] = (-3.0, 1.0, 1.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for term, weight in self.lexicon.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            phrase = fold(phrase)
            found.add_word(phrase, (len(phrase), -1.0))
        if not len(found):
            return None
        found.make_automaton()
        return found


def matches(folded: str, automaton) -> dict[int, float]:
    """Best weight per matched word, by its place; exceptions taken out."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    if automaton is not None:
        for end, (length, weight) in automaton.iter(folded):
            start = end - length + 1
            if weight < 0:
                spared.append((start, end))
            elif weight > best.get(start, 0):
                best[start] = weight
    if spared:
        # a place is spared if, of the exceptions that begin up to it, the one that reaches furthest goes beyond it
        spared.sort()
        begins = [a for a, _ in spared]
        reach = list(accumulate((b for _, b in spared), max))

        def kept(s: int) -> bool:
            i = bisect_right(begins, s)
            return i == 0 or reach[i - 1] <= s

        best = {s: w for s, w in best.items() if kept(s)}
    return best


def features(folded: str, automaton) -> tuple[float, float, float]:
    """log of the weight sum, weight per 50 words, log of the word count."""
    total = sum(matches(folded, automaton).values())
    words = folded.count(" ") - 1
    return math.log1p(total), min(50 * total / max(words, 1), 50.0) / 10, math.log1p(max(words, 0)) / 10


def _texts(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of few rows, with their folded texts."""
    for whole in batches:
        for at in range(0, whole.num_rows, size):
            part = whole.slice(at, size)
            yield part, [fold(t or "") for t in part.column(part.schema.get_field_index("text")).to_pylist()]


def _counted(sample: DataFrame, keys_of) -> DataFrame:
    """Documents with and without the label for every key, counted per
    partition before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for part, folded in _texts(batches):
            for label, text in zip(part.column(0).to_pylist(), folded):
                counts[int(label)].update(keys_of(text))
        keys = sorted(set(counts[0]) | set(counts[1]))
        for at in range(0, len(keys), 50_000):
            some = keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.string()),
                    pa.array([counts[1][k] for k in some], pa.int64()),
                    pa.array([counts[0][k] for k in some], pa.int64()),
                ],
                ["term", "pos", "neg"],
            )

    return (
        sample.select("toxic", "text")
        .mapInArrow(giving_back(run), "term string, pos long, neg long")
        .groupBy("term")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 12_000,
    least_weight: float = 2.0,
    exceptions: tuple[str, ...] = (),
) -> ToxicityModel:
    """Learn lexicon, exception phrases and calibration.

    Fitted on at most ``max_rows`` labelled documents (those with the smallest
    hashed ids); scoring is not bounded.  Copies of a text are one piece of
    evidence, toxic if one of them is.  Every term of at least ``least_weight``
    counts, so their number is bounded by the sample.  A term's weight is the
    lower end of a one-sided 95 % interval of its log odds.  Repeated labels of
    a document count once (the larger one).
    """
    ship_package(docs.sparkSession)
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .join(docs.where(F.col("text").isNotNull()).select("doc_id").distinct(), "doc_id", "left_semi")
    )
    ids = bounded_sample(known, "doc_id", max_rows)
    picked = known.join(ids, "doc_id", "left_semi").collect()  # at most max_rows ids and labels
    if not picked:
        return ToxicityModel({}, list(exceptions))
    spark = docs.sparkSession
    small = spark.createDataFrame([(r.doc_id, r.toxic) for r in sorted(picked)], "doc_id long, toxic int")
    sample = staged(
        spark,
        docs.select("doc_id", "text")
        .where(F.col("text").isNotNull())
        .join(F.broadcast(small), "doc_id")  # bounded by max_rows
        .groupBy("text")
        .agg(F.max("toxic").alias("toxic"))
        .select("toxic", "text"),
        "toxicity-sample",
    )
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    positives, negatives = sizes.get(1, 0), sizes.get(0, 0)
    odds = F.log((F.col("pos") + 0.5) / (positives + 1)) - F.log((F.col("neg") + 0.5) / (negatives + 1))
    error = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    found = (
        _counted(sample, terms_of)
        .where(F.col("pos") >= 3)
        .withColumn("weight", odds - 1.64 * error)
        .where(F.col("weight") >= least_weight)
        .collect()  # terms of a bounded sample
    )
    raw = {r.term: r.weight for r in found}
    # a word says no more than a beginning of it that weighs as much
    lexicon = {
        t: w
        for t, w in raw.items()
        if not any(raw.get(t[: n + 1], 0) >= w and t != t[: n + 1] for n in PREFIX_LENGTHS)
    }
    model = ToxicityModel(lexicon, list(exceptions))
    model.exceptions += _learn_exceptions(sample, model)
    rows = _sample_features(sample, model)
    if rows:
        model.weights = _calibrate(np.array([r[1:] for r in rows], float), np.array([r[0] for r in rows], float))
    return model


def _learn_exceptions(sample: DataFrame, model: ToxicityModel, least: int = 5) -> list[str]:
    """Two-word phrases around a lexicon match seen in at least ``least``
    unlabelled-toxic documents and in no toxic one."""
    if not model.lexicon:
        return []

    def phrases(folded: str) -> set[str]:
        hits = matches(folded, phrases.automaton)
        out = set()
        for at in hits:
            stop = folded.index(" ", at + 1)
            before = folded.rfind(" ", 0, at)
            if at and before >= 0:
                out.add(folded[before : stop + 1])
            after = folded.find(" ", stop + 1)
            if after > 0:
                out.add(folded[at : after + 1])
        return out

    def lazily(folded: str) -> set[str]:
        if not hasattr(phrases, "automaton"):
            phrases.automaton = model.automaton()
        return phrases(folded)

    found = _counted(sample, lazily).where((F.col("neg") >= least) & (F.col("pos") == 0))
    return sorted(r.term.strip() for r in found.collect())  # phrases of a bounded sample


def _sample_features(sample: DataFrame, model: ToxicityModel) -> list[tuple]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for part, folded in _texts(batches):
            cols = list(zip(*(features(t, automaton) for t in folded)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, pa.float64()) for c in cols)], ["toxic", "a", "b", "c"]
            )

    rows = sample.select("toxic", "text").mapInArrow(giving_back(run), "toxic int, a double, b double, c double").collect()
    return sorted(tuple(r) for r in rows)  # max_rows rows of four numbers


def _calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``doc_id, text``.

    Whole texts are matched.  Null and empty texts have no match and get the
    calibrated score of that.  Repeated rows each get a row.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        w = np.array(model.weights)
        for part, folded in _texts(batches):
            x = np.array([features(t, automaton) for t in folded])
            score = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        giving_back(run), "doc_id long, score double, predicted int"
    )


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is below the
    threshold; a row is judged where it lies."""
    ship_package(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        w = np.array(model.weights)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                part = whole.slice(start, 256)
                folded = [fold(t or "") for t in part.column(at).to_pylist()]
                z = w[0] + np.array([features(t, automaton) for t in folded]) @ w[1:]
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield part.filter(pa.array(score < threshold))

    return docs.mapInArrow(giving_back(run), docs.schema)
