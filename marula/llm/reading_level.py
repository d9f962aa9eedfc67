"""Problem 10: reading level of each document.

Method: from graded texts, each word gets an acquisition grade, the mean grade of
its relative frequencies over the grades. A document is then known by quantiles of
the grades of its known words, and these are calibrated: for each grade, the median
of each quantile over the graded texts, whose words are graded without themselves.
The grade whose calibrated quantiles are nearest is the document's level.

The model is a word table bounded by the graded texts, of which at most ``SAMPLES``
are read for each grade (by hash, the same at every corpus size). Documents are
read whole, words parted at a line's end are joined, and nothing is shuffled.

Defined results: a null text, or one without a known word, has a null level; empty
graded texts teach nothing; repeated documents come out each; ties go to the easier level.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most graded texts of one grade that the model is fitted on.
SAMPLES = 20_000
#: Fewer occurrences than this say nothing about a word's grade.
LEAST = 3
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
_word = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_parted = re.compile(r"([^\W\d_])[-‐]\s*\n\s*([^\W\d_])")


def tokens(text: str) -> list[str]:
    text = text.lower()
    if "-\n" in text or "‐\n" in text or "- \n" in text:
        text = _parted.sub(r"\1\2", text)
    return _word.findall(text)


class LevelModel:
    """Word grades and calibrated quantiles; levels are ordered from the easiest."""

    def __init__(self, samples: Sequence[tuple[str, str]], levels: Sequence[str]):
        self.levels = list(levels)
        counted = [(Counter(tokens(t)), self.levels.index(v)) for t, v in samples]
        counts: dict[str, np.ndarray] = {}
        totals = np.ones(len(self.levels))
        for words, g in counted:
            for w, n in words.items():
                if w not in counts:
                    counts[w] = np.zeros(len(self.levels))
                counts[w][g] += n
                totals[g] += n
        weight = totals.mean() / totals
        scale = np.arange(len(self.levels))

        def grade(n: np.ndarray) -> float:
            p = (n + 0.2) * weight
            return float((p * scale).sum() / p.sum())

        self.grades = {w: grade(n) for w, n in counts.items() if n.sum() >= LEAST}
        own: list[list[np.ndarray]] = [[] for _ in self.levels]
        for words, g in counted:
            known = {}
            for w, n in words.items():
                left = counts[w].copy()
                left[g] -= n
                if left.sum() >= LEAST:
                    known[w] = (grade(left), n)
            if known:
                own[g].append(self._quantiles(list(known.values())))
        middle = [np.median(x, axis=0) if x else np.full(len(QUANTILES), float(g)) for g, x in enumerate(own)]
        self.calibrated = np.maximum.accumulate(np.array(middle), axis=0)

    @staticmethod
    def _quantiles(graded: list[tuple[float, int]]) -> np.ndarray:
        graded.sort()
        ends = np.cumsum([n for _, n in graded])
        at = np.searchsorted(ends, np.ceil(np.array(QUANTILES) * ends[-1]))
        return np.array([graded[i][0] for i in at])

    def score(self, text: str) -> tuple[str, float, int] | None:
        """Level, mean grade and number of known words of a text."""
        grades = self.grades
        known = Counter(v for w in tokens(text) if (v := grades.get(w)) is not None)
        if not known:
            return None
        n = sum(known.values())
        q = self._quantiles(list(known.items()))
        level = int(np.abs(self.calibrated - q).sum(axis=1).argmin())
        return self.levels[level], sum(v * k for v, k in known.items()) / n, n


def fit(samples: DataFrame, text: str, level: str, levels: Sequence[str]) -> LevelModel:
    """The model of graded samples, read up to SAMPLES for each level in the order of their hash."""
    rows = []
    for v in levels:
        own = samples.where((F.col(level) == v) & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(level).alias("v"))
        rows += own.orderBy(F.xxhash64("t"), "t").limit(SAMPLES).collect()
    return LevelModel([(r.t, r.v) for r in rows], levels)


def _scoring(model: LevelModel):
    levels, grades, calibrated = model.levels, model.grades, model.calibrated

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = LevelModel.__new__(LevelModel)
        m.levels, m.grades, m.calibrated = levels, grades, calibrated
        for b in batches:
            done = [None if t is None else m.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("_id"),
                    pa.array([d and d[0] for d in done], pa.string()),
                    pa.array([d and d[1] for d in done], pa.float64()),
                    pa.array([d[2] if d else 0 for d in done], pa.int64()),
                ],
                ["doc_id", "reading_level", "mean_grade", "n_known"],
            )

    return run


def estimate(docs: DataFrame, doc_id: str, text: str, model: LevelModel) -> DataFrame:
    """One row (doc_id, reading_level, mean_grade, n_known) for each document."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_scoring(model), "doc_id bigint, reading_level string, mean_grade double, n_known bigint")
