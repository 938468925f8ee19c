"""Cumulative-link ordinal regression on hashed text features.

``P(grade <= k) = sigmoid(threshold_k - w . x)``: one weight vector is shared by all ordered thresholds. Features of a text are its
words and their heads (first letters), hashed; x holds their presence and a few shape ratios. Features whose share
of rows does not differ between the two sides of any threshold (z below ``MIN_Z``) are left out: they only remember single texts.

The model is fitted on a bounded sample of labelled rows: at most ``PER_GRADE`` rows of each grade by the hash of their id, each
different text once. These texts come to the driver, where a few hundred gradient steps over their sparse rows are taken. The weights
(``FEATURES`` numbers) go to the tasks. Every document is scored from its whole text, in place, with no shuffle.

Defined cases: a null or empty text has no features and gets the grade probabilities of the thresholds alone; labels that are
null or belong to no document are passed over; with fewer than two grades the result is null; repeated rows score alike; empty
tables give an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwatch.llm.common import hash_limit

FEATURES, HEADS, PRESENT, PER_GRADE, STEPS, RATE, RIDGE, MIN_Z = 1 << 18, (4, 5), 0.2, 4000, 300, 0.08, 1e-4, 4.0
SHAPES = 6
WORD = re.compile(r"\w+")


def bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % FEATURES


class Features:
    """Features of texts; remembers the buckets of words met lately (a fixed number of them)."""

    def __init__(self, most: int = 200_000):
        self.most, self.known = most, {}

    def of_word(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= self.most:
                self.known.clear()
            found = self.known[word] = bucket(word), *(bucket("^" + word[:k]) for k in HEADS)
        return found

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, values): presence, then the shape ratios."""
        text = text or ""
        words = set(WORD.findall(text.lower()))
        own = np.fromiter({b for w in words for b in self.of_word(w)}, np.int64)
        length = max(len(text), 1)
        lines = text.split("\n")
        shapes = np.array([
            sum(map(text.count, "#*$%&|<>")) / length * 10, sum(map(text.count, "!?")) / length * 10,
            sum(c.isupper() for c in text) / length if text else 0.0, 1 - len(set(lines)) / len(lines),
            len(words) / max(len(text) / 6, 1), min(np.log1p(len(text)) / 10, 2),
        ])
        values = np.concatenate([np.full(len(own), PRESENT), shapes])
        return np.concatenate([own, np.arange(FEATURES, FEATURES + SHAPES)]), values


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: list

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """Rows of grade probabilities."""
        below = 1 / (1 + np.exp(np.clip(score[:, None] - self.thresholds[None, :], -60, 60)))
        return np.diff(np.column_stack([np.zeros(len(score)), below, np.ones(len(score))]), axis=1)


def telling(ids: np.ndarray, grade: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For every feature whether its share of rows differs between the two sides of some threshold. The shape ratios
    always stay. ``rows`` counts the rows of each grade."""
    counts = np.stack([np.bincount(ids[grade == k], minlength=FEATURES + SHAPES) for k in range(len(rows))], axis=1)
    keep = np.arange(FEATURES + SHAPES) >= FEATURES
    for k in range(1, len(rows)):
        low, high, n_low, n_high = counts[:, :k].sum(axis=1), counts[:, k:].sum(axis=1), rows[:k].sum(), rows[k:].sum()
        share = (low + high + 1) / (n_low + n_high + 2)
        keep |= np.abs(low / max(n_low, 1) - high / max(n_high, 1)) >= MIN_Z * np.sqrt(share * (1 - share) * (1 / max(n_low, 1) + 1 / max(n_high, 1)))
    return keep


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, names: list) -> Model:
    """Maximum likelihood, rare grades with more weight (the root of their odds), by Adam steps over all rows."""
    ids, values = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
    often = telling(ids, grades.astype(np.int8)[owner], np.bincount(grades, minlength=len(names)))[ids]
    ids, values, owner = ids[often], values[often], owner[often]
    used, where = np.unique(ids, return_inverse=True)
    n, levels = len(rows), len(names)
    share = np.sqrt(n / levels / np.bincount(grades, minlength=levels))[grades] / n
    weights = np.zeros(len(used))
    gaps = np.zeros(levels - 1)  # the first threshold, then logarithms of the distances
    state = [np.zeros(len(used) + levels - 1) for _ in range(2)]
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for step in range(1, STEPS + 1):
        cuts = np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))
        score = np.bincount(owner, values * weights[where], n)
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        upper, lower = edge[grades + 1] - score, edge[grades] - score
        up, down = sigmoid(upper), sigmoid(lower)
        chance = np.maximum(up - down, 1e-9)
        d_up, d_down = np.where(np.isinf(upper), 0, up * (1 - up)), np.where(np.isinf(lower), 0, down * (1 - down))
        to_score = share * (d_up - d_down) / chance  # of the negative log likelihood
        g_weights = np.bincount(where, values * to_score[owner], len(used)) + RIDGE * weights
        g_edge = np.zeros(levels + 1)
        np.add.at(g_edge, grades + 1, -share * d_up / chance)
        np.add.at(g_edge, grades, share * d_down / chance)
        g_cuts = g_edge[1:-1]
        g_gaps = np.concatenate([[g_cuts.sum()], [g_cuts[k:].sum() * np.exp(gaps[k]) for k in range(1, levels - 1)]])
        grad = np.concatenate([g_weights, g_gaps])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.999 * state[1] + 0.001 * grad ** 2
        move = RATE * (state[0] / (1 - 0.9 ** step)) / (np.sqrt(state[1] / (1 - 0.999 ** step)) + 1e-8)
        weights -= move[:len(used)]
        gaps -= move[len(used):]
    full = np.zeros(FEATURES + SHAPES, np.float32)
    full[used] = weights
    return Model(full, np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])])), names)


def fit(docs: DataFrame, graded: DataFrame, per_grade: int = PER_GRADE) -> Model | None:
    """Model for ``graded`` (doc_id, grade) over the texts of ``docs``; grades are ordered by value."""
    known = graded.select("doc_id", "grade").filter("doc_id is not null and grade is not null")
    totals = {r["grade"]: r["count"] for r in known.groupBy("grade").count().collect()}
    if len(totals) < 2:
        return None
    limit = F.create_map(*[x for g, n in sorted(totals.items()) for x in (F.lit(g), F.lit(hash_limit(per_grade / n)).cast("long"))])
    drawn = known.filter(F.xxhash64("doc_id") <= F.element_at(limit, F.col("grade")))
    texts = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(drawn.distinct()), "doc_id")  # about per_grade x grades ids
    rows, grades, seen = [], [], set()

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Features()
        for batch in batches:
            found = [own.of(t.as_py()) for t in batch.column("text")]
            packed = [[f[0][:-SHAPES].astype(np.int32).tobytes() for f in found], [f[1][-SHAPES:].astype(np.float32).tobytes() for f in found]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.string()), batch.column("grade").cast(pa.int64()), *(pa.array(p, pa.binary()) for p in packed)],
                names=["doc_id", "grade", "ids", "shapes"],
            )

    got = texts.mapInArrow(rows_of, "doc_id string, grade bigint, ids binary, shapes binary")
    for r in sorted(got.collect(), key=lambda r: (r["doc_id"], r["grade"])):
        if bytes(r["ids"]) not in seen:
            seen.add(bytes(r["ids"]))
            ids = np.frombuffer(bytes(r["ids"]), np.int32)
            values = np.concatenate([np.full(len(ids), PRESENT, np.float32), np.frombuffer(bytes(r["shapes"]), np.float32)])
            rows.append((np.concatenate([ids, np.arange(FEATURES, FEATURES + SHAPES, dtype=np.int32)]), values))
            grades.append(r["grade"])
    names = sorted(set(grades))
    if len(names) < 2:
        return None
    return fit_rows(rows, np.searchsorted(names, grades), names)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, expected (grade), tail (probability of the highest grade) and probabilities, one row for each row of ``docs``."""
    id_field = docs.select("doc_id").schema.fields[0].dataType.simpleString()
    schema = f"doc_id {id_field}, expected double, tail double, probabilities array<double>"
    if model is None:
        return docs.select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("expected", "double"), ("tail", "double"), ("probabilities", "array<double>"))])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES + SHAPES weights

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, model = Features(), shared.value
        grades = np.array(model.grades, float)
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for k, t in enumerate(batch.column("text")):
                ids, values = own.of(t.as_py())
                scores[k] = (model.weights[ids] * values).sum()
            p = model.probabilities(scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p @ grades), pa.array(p[:, -1]), pa.array(p.tolist(), pa.list_(pa.float64()))],
                names=["doc_id", "expected", "tail", "probabilities"],
            )

    return docs.select("doc_id", "text").mapInArrow(predict, schema)
