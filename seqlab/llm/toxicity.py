"""Toxicity grades by cumulative-link ordinal regression on sparse term counts.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector serves all thresholds, which are kept in
order by learning their gaps. x holds log(1 + count) of the terms of a lexicon. Terms are words and word
beginnings of a few lengths; the lexicon is chosen from the labels: terms that occur in enough labelled
documents and are far more frequent in toxic ones.

The labels only tell toxic from not. Grade 0 is not toxic; toxic documents are graded 1 to 3 by the number
of lexicon terms they hold, cut at thirds of the toxic sample. Fitted on a bounded sample of labelled
documents (SAMPLE_ROWS per class, thresholds corrected for the shares taken); every document is scored whole in one narrow pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.labelled import labelled_sample
from seqlab.llm.staging import staged
from seqlab.llm.words import ALNUM, Words, blocks, mix, signed

SAMPLE_ROWS = {0: 10_000, 1: 6_000}
PREFIX_BYTES = (5, 6, 7, 8)
MAX_TERMS, MIN_DOCUMENTS, MIN_LOG_ODDS = 2048, 4, 1.5
GRADES = 4
#: Least probability of any grade above 0 at which a document counts as toxic.
TOXIC_FROM = 0.25
STEPS, RATE, DECAY = 400, 0.05, 2e-4


def term_hashes(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text, hash) of the words and of their beginnings, kind by kind."""
    text, length = words.text_of, words.end - words.start
    found = [(text, words.hashes())]
    for size in PREFIX_BYTES:
        long = length > size
        found.append((text[long], words.prefixes(size)[long]))
    return found


class OrdinalModel:
    """Sorted term hashes with their weights, and ordered thresholds."""

    def __init__(self, terms: np.ndarray, grades: int = GRADES):
        self.terms = np.sort(terms.astype(np.uint64))
        self.weights = np.ones(len(self.terms))
        self.base, self.gaps = 1.0, np.zeros(grades - 2)

    @property
    def thresholds(self) -> np.ndarray:
        return self.base + np.concatenate([[0.0], np.cumsum(np.exp(self.gaps))])

    def counts(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count) of the terms in a block."""
        size = max(len(self.terms), 1)
        maybe = np.zeros(1 << 16, dtype=bool)
        maybe[(self.terms >> np.uint64(48)).astype(np.int64)] = True
        cells = []
        for text, hashes in term_hashes(words) if len(self.terms) else []:
            near = np.flatnonzero(maybe[(hashes >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.terms, hashes[near]), size - 1)
            hit = self.terms[at] == hashes[near]
            cells.append(text[near[hit]] * size + at[hit])
        cells, n = np.unique(np.concatenate(cells) if cells else np.zeros(0, dtype=np.int64), return_counts=True)
        return cells // size, cells % size, n

    def grade_probabilities(self, s: np.ndarray) -> np.ndarray:
        upto = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - s[:, None], -40, 40)))
        return np.diff(np.concatenate([np.zeros((len(s), 1)), upto, np.ones((len(s), 1))], axis=1), axis=1)

    def fit(self, text: np.ndarray, term: np.ndarray, x: np.ndarray, grades: np.ndarray) -> "OrdinalModel":
        """Gradient descent with adaptive steps on the mean log likelihood of the sparse rows (text, term, x)."""
        n, size = len(grades), len(self.terms)
        params = np.concatenate([self.weights, [self.base], self.gaps])
        one, two = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, STEPS + 1):
            self.weights, self.base, self.gaps = params[:size], params[size], params[size + 1:]
            s = np.bincount(text, weights=x * self.weights[term], minlength=n)
            cuts = np.concatenate([[-1e9], self.thresholds, [1e9]])
            sig = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
            high, low = sig(cuts[grades + 1] - s), sig(cuts[grades] - s)
            p = np.maximum(high - low, 1e-12)
            up, down = high * (1 - high) / p, low * (1 - low) / p
            to_s = (up - down) / n  # minus the gradient of the log likelihood
            to_cut = np.zeros(len(cuts))
            np.add.at(to_cut, grades + 1, -up / n)
            np.add.at(to_cut, grades, down / n)
            inner = to_cut[1:-1]
            to_gaps = np.exp(self.gaps) * np.cumsum(inner[::-1])[::-1][1:]
            g = np.concatenate([np.bincount(term, weights=x * to_s[text], minlength=size) + DECAY * self.weights, [inner.sum()], to_gaps])
            one, two = 0.9 * one + 0.1 * g, 0.999 * two + 0.001 * g * g
            params = params - RATE * (one / (1 - 0.9 ** step)) / (np.sqrt(two / (1 - 0.999 ** step)) + 1e-8)
        self.weights, self.base, self.gaps = params[:size], params[size], params[size + 1:]
        return self


def choose_terms(sample: DataFrame) -> np.ndarray:
    """Hashes of at most MAX_TERMS terms whose smoothed log odds of toxic documents stand out, the largest evidence first."""
    def run(batches):
        for part, data, offsets in blocks(batches):
            words = Words(data, offsets, ALNUM)
            label = part.column(1).to_numpy(zero_copy_only=False)
            for text, hashes in term_hashes(words):
                once = np.unique(mix(hashes) ^ text.astype(np.uint64), return_index=True)[1]
                # one row per term of the block, not one per document
                found, inverse = np.unique(hashes[once], return_inverse=True)
                toxic = np.bincount(inverse, weights=label[text[once]] == 1, minlength=len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(np.bincount(inverse, minlength=len(found)).astype(np.int64)), pa.array(toxic)],
                                                 names=["term", "n", "toxic"])

    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    counted = sample.select("text", "label").mapInArrow(run, "term bigint, n bigint, toxic bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    clean = F.col("n") - F.col("toxic")
    odds = F.log((F.col("toxic") + 0.5) / (totals["toxic"] + 1.0)) - F.log((clean + 0.5) / (totals["n"] - totals["toxic"] + 1.0))
    strong = counted.withColumn("odds", odds).where((F.col("n") >= MIN_DOCUMENTS) & (F.col("odds") >= MIN_LOG_ODDS))
    rows = strong.orderBy((F.col("odds") * F.col("toxic")).desc(), "term").limit(MAX_TERMS).collect()
    return np.array([r["term"] for r in rows], dtype=np.int64).view(np.uint64)


def fit_toxicity(documents: DataFrame, labels: DataFrame, rows: dict[int, int] = SAMPLE_ROWS) -> OrdinalModel:
    """Lexicon, grades and regression from a sample of labelled documents; without labels nothing is toxic."""
    sample, shares = labelled_sample(documents, labels, "toxic", rows)
    sample = staged(sample)
    model = OrdinalModel(choose_terms(sample))
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part, data, offsets in blocks(batches):
            text, term, n = shared.value.counts(Words(data, offsets, ALNUM))
            edges = np.searchsorted(text, np.arange(part.num_rows + 1))
            lists = [(term[i:j].tolist(), n[i:j].tolist()) for i, j in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([a for a, _ in lists], pa.list_(pa.int32())), pa.array([b for _, b in lists], pa.list_(pa.int64()))],
                                             names=["doc_id", "label", "terms", "counts"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    found = sample.mapInArrow(run, f"doc_id {kind}, label int, terms array<int>, counts array<bigint>").toPandas().sort_values("doc_id")
    sizes = found["terms"].map(len).to_numpy()
    toxic = found["label"].to_numpy() == 1
    if not toxic.any() or not len(model.terms):
        model.weights[:], model.base = 0.0, 10.0
        return model
    hits = found["counts"].map(sum).to_numpy()
    cuts = np.quantile(hits[toxic & (hits > 0)] if (toxic & (hits > 0)).any() else [1], [1 / 3, 2 / 3])
    grades = np.where(toxic, 1 + np.searchsorted(cuts, hits, side="left"), 0)
    text = np.repeat(np.arange(len(found)), sizes)
    term = np.array([t for ts in found["terms"] for t in ts], dtype=np.int64)
    x = np.log1p(np.array([c for cs in found["counts"] for c in cs], dtype=float))
    model.fit(text, term, x, grades)
    # the classes were thinned by different shares; the thresholds go back to the mix of all labelled rows
    model.base += float(np.log(shares[1] / shares[0]))
    return model


def grade_toxicity(documents: DataFrame, model: OrdinalModel) -> DataFrame:
    """One row per row: doc_id, expected_severity (0 to 3), grade, p_toxic, toxic, n_terms.

    Expected severity is the mean of the grade's distribution, ``grade`` its median, ``toxic`` holds if
    p_toxic reaches TOXIC_FROM. Null and empty texts hold no terms. Repeated rows each give a row; null
    ids stay null; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part, data, offsets in blocks(batches):
            m = shared.value
            text, term, n = m.counts(Words(data, offsets, ALNUM))
            s = np.bincount(text, weights=np.log1p(n) * m.weights[term], minlength=part.num_rows) if len(m.terms) else np.zeros(part.num_rows)
            p = m.grade_probabilities(s)
            columns = [part.column(0), pa.array(p @ np.arange(p.shape[1])), pa.array((np.cumsum(p, axis=1) < 0.5).sum(1).astype(np.int32)), pa.array(1 - p[:, 0]),
                       pa.array(1 - p[:, 0] >= TOXIC_FROM), pa.array(np.bincount(text, weights=n, minlength=part.num_rows).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "expected_severity", "grade", "p_toxic", "toxic", "n_terms"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, expected_severity double, grade int, p_toxic double, toxic boolean, n_terms bigint")


def classify_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return grade_toxicity(documents, fit_toxicity(documents, labels))
