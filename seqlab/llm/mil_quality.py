"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded from its own measurements, gated
attention (the product of a tanh and a sigmoid branch) weighs the passages within the document, and the
weighted mean of the encodings is scored. Weights of all parts are learned together from document labels.

The fit runs on a bounded sample of labelled documents (SAMPLE_ROWS), as a full-batch gradient descent on
the driver; every document is scored whole, in one narrow pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.labelled import labelled_sample
from seqlab.llm.staging import training_row
from seqlab.llm.words import NOT_SPACE, U64, Words, blocks, mix

PASSAGE_WORDS = 64
SAMPLE_ROWS = {0: 3_000, 1: 5_000}
FOLDS = 5
PREDICT_FROM = 0.3
HIDDEN, GATE, STEPS, RATE, DECAY = 16, 8, 400, 0.02, 1e-4

_CLASSES = [(65, 91), (97, 123), (48, 58), (128, 256)]
_SYMBOLS = [b"#*$%&<>", b"|", b"!?", b".", b",;:", b"\n"]


def _class_tables() -> np.ndarray:
    tables = np.zeros((len(_CLASSES) + len(_SYMBOLS), 256), dtype=bool)
    for i, (a, b) in enumerate(_CLASSES):
        tables[i, a:b] = True
    for i, chars in enumerate(_SYMBOLS, len(_CLASSES)):
        tables[i, list(chars)] = True
    return tables


_TABLES = _class_tables()
FEATURES = len(_TABLES) + 6


def passage_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages of the block, first passage of each text); a text without words is one empty passage."""
    counts = words.counts
    passages = np.maximum((counts + PASSAGE_WORDS - 1) // PASSAGE_WORDS, 1)
    first = np.concatenate([[0], np.cumsum(passages)])
    text = np.repeat(np.arange(len(counts)), passages)
    within = np.arange(first[-1]) - first[text]
    a = np.minimum(words.first[text] + within * PASSAGE_WORDS, words.first[text + 1])
    z = np.minimum(a + PASSAGE_WORDS, words.first[text + 1])
    n = z - a
    # a passage's bytes reach to the next passage's first word, the first one starts with its text
    starts = np.append(words.start, len(words.data))
    low = np.where(within == 0, words.offsets[text], starts[a])
    high = np.where(within == passages[text] - 1, words.offsets[text + 1], starts[np.minimum(z, len(starts) - 1)])
    size = np.maximum(high - low, 1)
    out = np.zeros((first[-1], FEATURES), dtype=np.float32)
    for i, members in enumerate(_TABLES):
        total = np.concatenate([[0], np.cumsum(members[words.data], dtype=np.int32)])
        share = (total[high] - total[low]) / (size if i < len(_CLASSES) else np.maximum(n, 1))
        out[:, i] = np.minimum(share, 4.0)
    out[:, -6] = np.log1p(n)
    out[:, -5] = np.minimum((high - low) / np.maximum(n, 1), 30) / 10
    hashes = words.hashes()
    text_of = words.text_of
    per = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])[np.stack([a, z])], axis=0)[0] / np.maximum(n, 1)
    if len(hashes):
        same = np.zeros(len(hashes), dtype=bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (text_of[1:] == text_of[:-1])
        out[:, -4] = per(same)
        place = text_of.astype(np.uint64) * U64(0x9E3779B97F4A7C15)
        passage = np.repeat(np.arange(first[-1]), n).astype(np.uint64)
        out[:, -3] = per(_seen_twice(mix(hashes + passage)))
        out[:, -2] = per(_seen_twice(mix(words.grams(3) + place)))
        out[:, -1] = per(_seen_twice(mix(words.grams(5) + place)))
    return out, first


def _seen_twice(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    equal = keys[order][1:] == keys[order][:-1]
    flags = np.zeros(len(keys), dtype=bool)
    flags[order[1:][equal]] = True
    flags[order[:-1][equal]] = True
    return flags


class AttentionModel:
    """Passage encoder, gated attention and document score; arrays only, so it is sent to workers as it is."""

    def __init__(self, inputs: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)
        self.weights = {"W": draw(inputs, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(1)}

    def forward(self, features: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        x = np.clip((features - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        sizes = np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), sizes))
        a = e / np.repeat(np.add.reduceat(e, first[:-1]), sizes)
        z = np.add.reduceat(a[:, None] * h, first[:-1])
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -40, 40)))}

    def gradients(self, f: dict[str, np.ndarray], first: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        p, sizes = self.weights, np.diff(first)
        g = (f["score"] - labels) / len(labels)
        to_z = np.repeat(g[:, None] * p["c"], sizes, axis=0)
        to_a = (to_z * f["h"]).sum(1)
        to_e = f["a"] * (to_a - np.repeat(np.add.reduceat(f["a"] * to_a, first[:-1]), sizes))
        to_t = to_e[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2)
        to_s = to_e[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        to_h = (f["a"][:, None] * to_z + to_t @ p["V"].T + to_s @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ to_h, "b": to_h.sum(0), "V": f["h"].T @ to_t, "U": f["h"].T @ to_s, "w": (f["t"] * f["s"]).T @ to_e, "c": f["z"].T @ g, "d": np.array([g.sum()])}

    def fit(self, features: np.ndarray, first: np.ndarray, labels: np.ndarray) -> "AttentionModel":
        self.mean, self.scale = features.mean(0), features.std(0) + 1e-3
        one = {k: np.zeros_like(v) for k, v in self.weights.items()}
        two = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, STEPS + 1):
            grads = self.gradients(self.forward(features, first), first, labels)
            for k, value in self.weights.items():
                g = grads[k] + DECAY * value
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.999 * two[k] + 0.001 * g * g
                value -= RATE * (one[k] / (1 - 0.9 ** step)) / (np.sqrt(two[k] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def scores(self, words: Words) -> np.ndarray:
        features, first = passage_features(words)
        return self.forward(features, first)["score"]


def fit_quality(documents: DataFrame, labels: DataFrame, folds: int = FOLDS, rows: dict[int, int] = SAMPLE_ROWS) -> AttentionModel:
    """Fit on a sample of the labelled documents outside the held-out fold; without labels every score is one half."""
    sample, _ = labelled_sample(documents, labels, "quality", rows, training_row("doc_id", folds))

    def run(batches):
        for part, data, offsets in blocks(batches):
            features, first = passage_features(Words(data, offsets, NOT_SPACE, lower=False))
            bags = [features[i:j].tobytes() for i, j in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(bags, pa.binary())], names=["doc_id", "label", "bag"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    found = sample.mapInArrow(run, f"doc_id {kind}, label int, bag binary").toPandas().sort_values(["doc_id", "label"])
    model = AttentionModel(FEATURES)
    if not len(found):
        model.weights["c"][:] = 0
        return model
    bags = [np.frombuffer(b, dtype=np.float32).reshape(-1, FEATURES) for b in found["bag"]]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return model.fit(np.concatenate(bags).astype(np.float64), first, found["label"].to_numpy(dtype=float))


def score_quality(documents: DataFrame, model: AttentionModel, folds: int = FOLDS, threshold: float = PREDICT_FROM, carry: list[str] | None = None) -> DataFrame:
    """One row per row: doc_id, held_out, score, predicted, then the columns named in ``carry``. Only the text enters the score.

    Null and empty texts are scored as one empty passage. Null ids count as the id '' for the fold. Repeated
    rows each give a row. Other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    carry = carry or []

    def run(batches):
        for part, data, offsets in blocks(batches, "_text"):
            scores = shared.value.scores(Words(data, offsets, NOT_SPACE, lower=False))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), *part.columns[3:]],
                                             names=["doc_id", "held_out", "score", "predicted", *carry])

    kinds = {name: documents.schema[name].dataType.simpleString() for name in ["doc_id", *carry]}
    rows = documents.select("doc_id", F.col("text").alias("_text"), (~training_row("doc_id", folds)).alias("_held"), *carry)
    schema = f"doc_id {kinds['doc_id']}, held_out boolean, score double, predicted int" + "".join(f", `{c}` {kinds[c]}" for c in carry)
    return rows.mapInArrow(run, schema)


def classify_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score_quality(documents, fit_quality(documents, labels))
