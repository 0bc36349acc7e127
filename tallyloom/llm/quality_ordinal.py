"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features gives a document's score s; ordered thresholds t1 < t2 < ... cut it into
grades: P(grade <= k) = 1 / (1 + exp(s - t_k+1)). From these come the expected grade and, for selection, the tail
probability P(grade >= k).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 20
SLICE = 128
LEAST = 0.8  # tail probability from which a document is selected
MEMO_TOKENS = 200_000
PREFIXES = (4, 5, 6, 7)
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def _place(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature.encode("utf-8", "surrogatepass"), 1) & ((1 << BITS) - 1)


def token_places(token: str) -> list[int]:
    """The hashed features of one token: itself in lower case, how its beginning reads, and its shape."""
    low = token.lower()
    out = [_place("w" + low)]
    out += [_place("p" + low[:n]) for n in PREFIXES if len(low) > n]
    if not token[0].isalnum():
        out += [_place("c" + c) for c in set(token)]
    elif len(token) > 1 and token.isupper():
        out.append(_place("upper"))
    return out


def text_places(tokens: list[str]) -> list[int]:
    """Features of the whole text, in steps: repetition, variety, capitals, length."""
    n = len(tokens)
    if not n:
        return [_place("empty")]
    repeated = sum(a == b for a, b in zip(tokens, tokens[1:])) / n
    upper = sum(len(t) > 1 and t.isupper() for t in tokens) / n
    variety = len(set(tokens)) / math.sqrt(n)
    return [_place(f"repeated{int(10 * repeated)}"), _place(f"upper{int(5 * upper)}"), _place(f"variety{min(12, int(2 * variety))}"), _place(f"length{n.bit_length()}")]


@dataclass(frozen=True)
class OrdinalModel:
    """Weights of the hashed features and the thresholds between the grades, in ascending order."""

    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and the tail probabilities P(grade >= 1), P(grade >= 2), ... of scores."""
        tails = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))
        return tails.sum(axis=1), tails


class Scorer:
    """Scores texts; remembers the weight sums of tokens, the newer half of them at least."""

    def __init__(self, model: OrdinalModel):
        self.model, self.memo, self.older = model, {}, {}

    def _token(self, token: str) -> tuple[float, int]:
        value = self.older.get(token)
        if value is None:
            places = token_places(token)
            value = math.fsum(map(float, self.model.weights[places])), len(places)
        if len(self.memo) >= MEMO_TOKENS:
            self.older, self.memo = self.memo, {}
        self.memo[token] = value
        return value

    def score(self, text: str | None) -> float:
        tokens = _TOKEN.findall(text or "")
        known = []
        for token in set(tokens):
            value = self.memo.get(token)
            known.append(self._token(token) if value is None else value)
        total = math.fsum([k[0] for k in known])  # exact, whatever the set's order
        n = sum([k[1] for k in known])
        return (total / math.sqrt(n) if n else 0.0) + math.fsum(map(float, self.model.weights[text_places(tokens)]))


def features(text: str | None) -> tuple[list[int], list[int]]:
    """(token features of the distinct tokens, features of the text)."""
    tokens = _TOKEN.findall(text or "")
    return [p for t in sorted(set(tokens)) for p in token_places(t)], text_places(tokens)


def _slopes(scores: np.ndarray, grade: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the log-likelihood by the scores, and summed by the cuts."""
    below = 1 / (1 + np.exp(np.clip(scores[:, None] - cuts, -500, 500)))
    upto = np.concatenate([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))], axis=1)
    rows = np.arange(len(scores))
    high, low = upto[rows, grade + 1], upto[rows, grade]
    chance = np.maximum(high - low, 1e-9)
    by_cut = np.zeros(len(cuts) + 2)
    np.add.at(by_cut, grade + 1, high * (1 - high) / chance)
    np.add.at(by_cut, grade, -low * (1 - low) / chance)
    return high + low - 1, by_cut[1:-1]


def _cuts(base: float, gaps: np.ndarray) -> np.ndarray:
    return base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def _chosen(examples: list[tuple[int, np.ndarray, np.ndarray]], grades: int, epochs: int, rate: float, lasso: float, most: int) -> np.ndarray:
    """Features with a clear tendency: those that follow-the-regularised-leader steps with an L1 penalty keep."""
    tendency, squares = np.zeros(1 << BITS), np.zeros(1 << BITS)
    base, gaps, seen = 0.0, np.zeros(max(0, grades - 2)), np.full(grades - 1, 1e-2)
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for e in order.permutation(len(examples)):
            grade, tokens, own = examples[e]
            at, value = np.unique(np.concatenate([tokens, own]), return_counts=True)
            z, n = tendency[at], squares[at]
            weights = np.sign(z) * np.minimum(0.0, lasso - np.abs(z)) / ((1.0 + np.sqrt(n)) / rate)
            slope, by_cut = _slopes(np.array([float(weights @ value)]), np.array([grade]), _cuts(base, gaps))
            step = -slope[0] * value
            more = n + step * step
            tendency[at] = z + step - (np.sqrt(more) - np.sqrt(n)) / rate * weights
            squares[at] = more
            tail = np.cumsum(by_cut[::-1])[::-1]  # a lower distance moves all cuts above it
            move = np.concatenate([[tail[0]], tail[1:] * np.exp(gaps)])
            seen += move * move
            change = 0.1 * move / np.sqrt(seen)
            base, gaps = base + change[0], gaps + change[1:]
    strength = np.abs(tendency)
    kept = np.flatnonzero(strength > lasso)
    return np.sort(kept[np.argsort(-strength[kept], kind="stable")[:most]])


def fit(
    examples: list[tuple[int, np.ndarray, np.ndarray]], grades: int, epochs: int = 3, rate: float = 0.3, lasso: float = 30.0, most: int = 2000,
    rounds: int = 1000, ridge: float = 1e-4,
) -> OrdinalModel:
    """Maximum likelihood in two passes: a sparse online pass chooses at most ``most`` features, and full gradient
    steps over all examples fit their weights and the thresholds, with a small ridge penalty.

    ``examples``: (grade, token features, text features). A token feature counts 1/sqrt(number of token features) for
    each distinct token that has it, a text feature 1. Thresholds are kept in order by fitting the logarithms of their distances.
    """
    chosen = _chosen(examples, grades, epochs, rate, lasso, most)
    table = np.zeros((len(examples), len(chosen)), np.float32)
    column = np.full(1 << BITS, -1, np.int32)
    column[chosen] = np.arange(len(chosen), dtype=np.int32)
    for row, (_, places, own) in zip(table, examples, strict=True):
        for at, value in ((places, 1 / math.sqrt(max(1, len(places)))), (own, 1.0)):
            at = column[at]
            np.add.at(row, at[at >= 0], np.float32(value))
    scale = np.maximum(np.sqrt((table**2).mean(axis=0)), 1e-3)
    table /= scale
    grade = np.array([g for g, _, _ in examples])
    point = np.zeros(len(chosen) + grades - 1)  # scaled weights, lowest threshold, logarithms of the distances
    mean, power = np.zeros_like(point), np.zeros_like(point)
    for t in range(1, rounds + 1):
        weights, base, gaps = point[: len(chosen)], point[len(chosen)], point[len(chosen) + 1 :]
        slope, by_cut = _slopes((table @ weights.astype(np.float32)).astype(np.float64), grade, _cuts(base, gaps))
        tail = np.cumsum(by_cut[::-1])[::-1]
        up = np.concatenate([(slope.astype(np.float32) @ table) / len(examples) - ridge * weights, [tail[0] / len(examples)], tail[1:] * np.exp(gaps) / len(examples)])
        mean, power = 0.9 * mean + 0.1 * up, 0.999 * power + 0.001 * up * up
        point = point + 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(power / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(1 << BITS)
    weights[chosen] = point[: len(chosen)] / scale
    return OrdinalModel(weights, _cuts(point[len(chosen)], point[len(chosen) + 1 :]))


SAMPLE = 12_000


def learn(docs: DataFrame, ratings: DataFrame, grades: int, sample: int = SAMPLE) -> OrdinalModel:
    """Fit on at most ``sample`` rated documents, those with the smallest hash of their id.

    ``ratings``: (doc_id, grade), grade from 0; null, negative and too high grades take no part, several ratings of a
    document count each. The ids of the sample are broadcast (``sample`` rows at most), the features of the sample
    reach the driver, where the fit runs; texts do not. Without ratings every grade is as likely as the next.
    """
    chosen = (
        ratings.where(f"doc_id is not null and grade between 0 and {grades - 1}").select("doc_id", F.col("grade").cast("int").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                part = batch.slice(begin, SLICE)
                tokens, texts = zip(*map(features, part["text"].to_pylist()), strict=True) if part.num_rows else ((), ())
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["grade"], pa.array(tokens, kind), pa.array(texts, kind)], ["doc_id", "grade", "tokens", "texts"])

    rated = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")
    shape = f"doc_id {rated.schema['doc_id'].dataType.simpleString()}, grade int, tokens array<int>, texts array<int>"
    found = rated.mapInArrow(extract, shape).toArrow().combine_chunks()
    ids, grade = found["doc_id"].to_numpy(), found["grade"].to_numpy()
    flat = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (found[n].combine_chunks() for n in ("tokens", "texts"))]
    examples = [  # views of the columns
        (int(grade[e]), *(values[offsets[e] : offsets[e + 1]] for values, offsets in flat)) for e in np.lexsort((grade, ids))
    ]
    pa.default_memory_pool().release_unused()
    return fit(examples, grades) if examples else OrdinalModel(np.zeros(1 << BITS), np.arange(grades - 1) - (grades - 2) / 2)


def graded(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, expected_grade, tails): of every document; null text is empty text."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = sent.value
        scorer = Scorer(OrdinalModel(weights, thresholds))
        for batch in batches:
            scores = [scorer.score(t) for begin in range(0, batch.num_rows, SLICE) for t in batch["text"].slice(begin, SLICE).to_pylist()]
            expected, tails = scorer.model.grades(np.array(scores, np.float64))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(expected), pa.array(list(tails), pa.list_(pa.float64()))], ["doc_id", "expected_grade", "tails"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rate, f"doc_id {kind}, expected_grade double, tails array<double>")


def selected(docs: DataFrame, model: OrdinalModel, grade: int, least: float = LEAST) -> DataFrame:
    """The documents whose P(grade >= ``grade``) is at least ``least``; rows and columns stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = sent.value
        scorer = Scorer(OrdinalModel(weights, thresholds))
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                part = batch.slice(begin, SLICE)
                _, tails = scorer.model.grades(np.array([scorer.score(t) for t in part["text"].to_pylist()], np.float64))
                yield part.filter(pa.array(tails[:, grade - 1] >= least))

    return docs.mapInArrow(choose, docs.schema)
