"""Leaf-wise boosted trees over binned features: a grid of fits in parallel tasks, stored as a table of nodes.

Every fit reads all labelled rows. Cut points are order statistics of whole features, one task for each feature; rows are
binned once, in parallel, and sorted by a hash of their values. Each (name, seed) of the grid is one task that takes the bins of
its features as a stream and passes over them level by level; bins beyond ``HELD_BYTES`` lie in an unnamed file of the task, so
that memory holds a few numbers per row (23 bytes) and not its features. Scoring reads every row of any table with the nodes,
of which there are at most trees * (2 * leaves - 1) per model.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir, materialise, shuffle_width

#: bins that a fit holds in memory, and rows that it counts at once
HELD_BYTES, BLOCK_ROWS = 1 << 25, 1 << 17
#: rows that travel as one, so that a batch of Arrow rows stays small
_TRAVEL, _VALUES = 64, 512


@dataclass(frozen=True)
class Boosting:
    """Settings of one ensemble."""

    trees: int = 300
    rate: float = 0.05
    leaves: int = 31
    depth: int = 5
    rows: float = 0.9  # share of the rows that each tree sees
    bins: int = 64
    least: int = 10  # rows of a leaf
    ridge: float = 1.0


NODES = pa.schema([
    ("name", pa.string()), ("seed", pa.int32()), ("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("threshold", pa.float64()),
    ("left", pa.int32()), ("right", pa.int32()), ("value", pa.float64()), ("gain", pa.float64())])
_NODES = "name string, seed int, tree int, node int, feature int, threshold double, left int, right int, value double, gain double"


def _best_split(hist: np.ndarray, s: Boosting) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best cut 'bin or below' of a leaf with sums (gradient, curvature, rows) per feature and bin."""
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    total = hist.sum(axis=2)[:, :, None]
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[0] ** 2 / (left[1] + s.ridge) + right[0] ** 2 / (right[1] + s.ridge) - total[0] ** 2 / (total[1] + s.ridge)
    gain[(left[2] < s.least) | (right[2] < s.least)] = -np.inf
    at = int(np.argmax(gain))
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


#: fewer rows count all features in one call, others two features at once
_FEW_ROWS = 4096


def _paired(binned: np.ndarray, bins: int) -> np.ndarray:
    """Bins of two neighbouring features as one number."""
    even = binned[0::2].astype(np.uint16 if bins <= 256 else np.int64) * bins
    even[:len(binned) // 2] += binned[1::2]
    return even


def _level_sums(paired: np.ndarray, d: int, rows: np.ndarray, sums: np.ndarray, bins: int, leaf: np.ndarray, leaves: int) -> np.ndarray:
    """(gradient, curvature, rows) of some rows per leaf, feature and bin; ``sums`` and ``leaf`` belong to these rows."""
    if len(rows) <= _FEW_ROWS:
        pairs = paired[:, rows].astype(np.intp)
        binned = np.stack([pairs // bins, pairs % bins], axis=1).reshape(-1, len(rows))[:d]
        flat = (binned + (np.arange(d)[:, None] + leaf * d) * bins).ravel()
        return np.stack([np.bincount(flat, weights=np.tile(w, d), minlength=leaves * d * bins) for w in sums]).reshape(3, leaves, d, bins).swapaxes(0, 1)
    out = np.empty((leaves, 3, len(paired) * 2, bins))
    begin, mine, at = leaf.astype(np.intp) * (bins * bins), np.empty(len(rows), dtype=paired.dtype), np.empty(len(rows), dtype=np.intp)
    for f, pair in enumerate(paired):
        np.take(pair, rows, out=mine, mode="clip")
        np.add(begin, mine, out=at)
        for k, w in enumerate((sums[0], sums[1], None)):
            both = np.bincount(at, weights=w, minlength=leaves * bins * bins).reshape(leaves, bins, bins)
            out[:, k, 2 * f], out[:, k, 2 * f + 1] = both.sum(axis=2), both.sum(axis=1)
    return out[:, :, :d]


def _sums(binned: np.ndarray, paired: np.ndarray, rows: np.ndarray, sums: np.ndarray, bins: int) -> np.ndarray:
    """(gradient, curvature, rows) of some rows, all of one leaf, per feature and bin."""
    return _level_sums(paired, len(binned), rows, sums[:, rows], bins, np.zeros(len(rows), dtype=np.intp), 1)[0]


class _Blocks:
    """Paired bins of blocks of rows: the first in memory, others in a file without a name that ends with the fit."""

    def __init__(self):
        self.shapes, self.held, self.file, self.kind = [], [], None, None

    def append(self, paired: np.ndarray) -> None:
        self.kind = paired.dtype
        self.shapes.append(paired.shape)
        if self.file is None and sum(h.nbytes for h in self.held) + paired.nbytes <= HELD_BYTES:
            self.held.append(paired)
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        np.ascontiguousarray(paired).tofile(self.file)

    def __iter__(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first row, end, paired bins) of each block."""
        end = 0
        if self.file is not None:
            self.file.flush()
            self.file.seek(0)
        for i, shape in enumerate(self.shapes):
            begin, end = end, end + shape[1]
            yield begin, end, self.held[i] if i < len(self.held) else np.fromfile(self.file, self.kind, shape[0] * shape[1]).reshape(shape)


class _Tree:
    """Nodes of one tree, level by level: cuts, children, sums. Cuts count only if best-first growth reaches them in ``leaves``."""

    def __init__(self, hist: np.ndarray, s: Boosting):
        self.s, self.depth, self.level = s, 0, [0]
        self.best, self.left, self.total = [], [], []
        self._add(hist, True)

    def _add(self, hist: np.ndarray, divisible: bool) -> None:
        self.total.append(hist[:2, 0].sum(axis=1))
        self.best.append((*(_best_split(hist, self.s) if divisible else (-np.inf, 0, 0)), hist if divisible else None))
        self.left.append(-1)

    def cut(self) -> list[int]:
        """Cut the nodes of the last level where it gains; returns them. Children are placed, their sums are not."""
        cut = [i for i in self.level if self.depth < self.s.depth and self.best[i][0] > 1e-9]
        for k, i in enumerate(cut):
            self.left[i] = len(self.left) + 2 * k
        return cut

    def smaller(self, cut: list[int]) -> list[int]:
        """The child of each cut node with fewer rows."""
        out = []
        for i in cut:
            _, feature, at, hist = self.best[i]
            low = hist[2, feature, :at + 1].sum()
            out.append(self.left[i] + int(low > hist[2, feature].sum() - low))
        return out

    def grow(self, cut: list[int], counted: np.ndarray | None) -> None:
        """Sums of the children: of the smaller ones as counted, of the others by difference; of the last level only totals."""
        self.depth += 1
        small = self.smaller(cut)
        for k, i in enumerate(cut):
            _, feature, at, hist = self.best[i]
            if counted is None:
                both = [hist[:, feature:feature + 1, :at + 1], hist[:, feature:feature + 1, at + 1:]]
            else:
                both = [counted[k], hist - counted[k]]
                if small[k] != self.left[i]:
                    both.reverse()
            for part in both:
                self._add(part, counted is not None)
            self.best[i] = (*self.best[i][:3], None)
        self.level = [self.left[i] + side for i in cut for side in (0, 1)]

    def route(self, cut: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, bin, left child) of every node placed before this level; feature -1 where rows stay."""
        size = len(self.best)
        feature, at, left = np.full(size, -1, dtype=np.int32), np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int32)
        for i in cut:
            feature[i], at[i], left[i] = self.best[i][1], self.best[i][2], self.left[i]
        return feature, at, left

    def nodes(self, cuts: list[np.ndarray]) -> tuple[list[tuple], np.ndarray]:
        """Node rows in the order of best-first growth, and the value that rows of each placed node get."""
        number, made, leaves = {0: 0}, [0], {0}
        while len(leaves) < self.s.leaves:
            open_leaves = [i for i in leaves if self.left[i] >= 0]
            if not open_leaves:
                break
            node = max(open_leaves, key=lambda i: (self.best[i][0], -number[i]))
            leaves.remove(node)
            for child in (self.left[node], self.left[node] + 1):
                number[child] = len(made)
                made.append(child)
                leaves.add(child)
        values, out = np.zeros(len(self.left)), []
        for i, (g, h) in enumerate(self.total):
            values[i] = -self.s.rate * g / (h + self.s.ridge)
        for i in made:
            gain, feature, at, _ = self.best[i]
            if i in leaves:
                out.append((number[i], -1, 0.0, -1, -1, float(values[i]), 0.0))
            else:
                out.append((number[i], feature, float(cuts[feature][min(at, len(cuts[feature]) - 1)]), number[self.left[i]], number[self.left[i] + 1], 0.0, gain))
        for i, left in enumerate(self.left):  # parents stand before their children
            if left >= 0 and (i in leaves or i not in number):
                values[left:left + 2] = values[i]
        return out, values


def _routed(slot: np.ndarray, paired: np.ndarray, bins: int, feature: np.ndarray, at: np.ndarray, left: np.ndarray) -> None:
    """Rows of cut nodes go on to their children, in place."""
    rows = np.flatnonzero(feature[slot] >= 0)
    here = slot[rows]
    of = feature[here]
    pair = paired[of >> 1, rows]
    value = np.where(of & 1, pair % bins, pair // bins)
    slot[rows] = left[here] + (value > at[here])


def _fit_blocks(blocks: _Blocks, d: int, cuts: list[np.ndarray], y: np.ndarray, seed: int, s: Boosting) -> list[tuple]:
    """(tree, node, feature, threshold, left, right, value, gain) of every node; tree -1 holds the base score.

    A tree takes one pass over the blocks for each level; the first pass also ends the tree before.
    """
    rng = np.random.default_rng(seed)
    n = len(y)
    share = min(max(float(y.mean(dtype=np.float64)), 1e-6), 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    nodes = [(-1, 0, -1, 0.0, -1, -1, base, 0.0)]
    score, p, seen = np.full(n, base), np.empty(n), np.empty(n, dtype=bool)
    slot = np.zeros(n, dtype=np.int16 if s.depth < 14 else np.int32)
    last = None

    def weights(begin: int, rows: np.ndarray) -> np.ndarray:
        mine = p[begin:][rows]
        return np.stack([mine - y[begin:][rows], mine * (1 - mine), np.ones(len(rows))])

    for tree in range(s.trees):
        hist = 0.0
        for begin, end, paired in blocks:
            if last is not None:
                _routed(slot[begin:end], paired, s.bins, *last[0])
                score[begin:end] += last[1][slot[begin:end]]
            p[begin:end] = 1 / (1 + np.exp(-score[begin:end]))
            seen[begin:end] = rng.random(end - begin) < s.rows
            slot[begin:end] = 0
            # sums are taken over the rows that the tree sees
            rows = np.flatnonzero(seen[begin:end])
            hist = hist + _level_sums(paired, d, rows, weights(begin, rows), s.bins, np.zeros(len(rows), dtype=np.intp), 1)
        grown = _Tree(hist[0], s)
        cut = grown.cut()
        while cut and grown.depth + 1 < s.depth:
            small, route = grown.smaller(cut), grown.route(cut)
            rank = np.full(grown.left[cut[-1]] + 2, -1, dtype=np.intp)
            rank[small] = np.arange(len(small))
            counted = 0.0
            for begin, end, paired in blocks:
                _routed(slot[begin:end], paired, s.bins, *route)
                leaf = rank[slot[begin:end]]
                rows = np.flatnonzero((leaf >= 0) & seen[begin:end])
                counted = counted + _level_sums(paired, d, rows, weights(begin, rows), s.bins, leaf[rows], len(small))
            grown.grow(cut, counted)
            cut = grown.cut()
        route = grown.route(cut)
        if cut:
            grown.grow(cut, None)
        made, values = grown.nodes(cuts)
        nodes += [(tree, *node) for node in made]
        last = route, values
    return nodes


def _cuts(column: np.ndarray, s: Boosting) -> np.ndarray:
    """Distinct order statistics that part the values, which are put in another order, into ``bins`` of about equal rows."""
    at = (np.linspace(0, 1, s.bins + 1)[1:-1] * (len(column) - 1)).astype(np.int64)
    column.partition(np.unique(at))
    return np.unique(column[at])


def _bin_kind(s: Boosting) -> type:
    return np.uint8 if s.bins <= 256 else np.int32


def fit_columns(columns: Sequence, y: np.ndarray, seed: int, s: Boosting) -> list[tuple]:
    """Nodes of a fit on features that are given one after the other; only their bins are held for all rows."""
    cuts, binned = [], np.empty((len(columns), len(y)), dtype=_bin_kind(s))
    for f, column in enumerate(columns):
        cuts.append(_cuts(np.array(column, dtype=np.float64), s))
        binned[f] = np.searchsorted(cuts[f], column, side="left")
    blocks = _Blocks()
    for at in range(0, len(y), BLOCK_ROWS):
        blocks.append(_paired(binned[:, at:at + BLOCK_ROWS], s.bins))
    return _fit_blocks(blocks, len(columns), cuts, y, seed, s)


def fit_trees(x: np.ndarray, y: np.ndarray, seed: int, s: Boosting) -> list[tuple]:
    return fit_columns(list(x.T), y, seed, s)


class _Columns(Sequence):
    """Features of an Arrow column of arrays, one at a time, in a given order of rows."""

    def __init__(self, column: pa.ChunkedArray, positions: Sequence[int]):
        self.parts = [np.asarray(c.flatten()).reshape(len(c), -1) for c in column.chunks if len(c)]
        self.positions, self.order = positions, None

    def __len__(self) -> int:
        return len(self.positions)

    def __getitem__(self, f: int) -> np.ndarray:
        if f >= len(self):
            raise IndexError(f)
        values = np.concatenate([part[:, self.positions[f]] for part in self.parts])
        return np.nan_to_num(values if self.order is None else values[self.order])

    def arrange(self, y: np.ndarray) -> np.ndarray:
        """The order of rows by label, then the features from the last one on; features are read only while rows tie."""
        order = np.argsort(y, kind="stable")
        tied = np.append(False, y[order][1:] == y[order][:-1])
        for f in range(len(self) - 1, -1, -1):
            rows = np.flatnonzero(tied | np.append(tied[1:], False))
            if not len(rows):
                break
            values = self[f][order[rows]]
            run = np.cumsum(~tied[rows])
            by = np.lexsort((values, run))
            order[rows] = order[rows][by]
            values = values[by]
            tied[rows] &= np.append(False, values[1:] == values[:-1])
        self.order = order
        return order


def _bytes_of(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    raw = np.ascontiguousarray(rows)
    ends = np.arange(len(raw) + 1, dtype=np.int32) * (raw.shape[1] * raw.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(raw)])


def feature_cuts(rows: DataFrame, used: Sequence[int], s: Boosting) -> dict[int, np.ndarray]:
    """Cut points of each used position of ``x``, from all rows. A feature's values meet in one task, eight bytes each."""
    def part(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = _Columns(pa.chunked_array([batch.column(0)]), used)
            for f, column in enumerate(columns):
                pieces = [column[at:at + _VALUES].tobytes() for at in range(0, len(column), _VALUES)]
                yield pa.RecordBatch.from_arrays([pa.array([f] * len(pieces), pa.int32()), pa.array(pieces, pa.binary())], names=["f", "part"])

    def cut(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            of = batch.column(0).to_numpy()
            for f in np.unique(of):
                mine = batch.column(1).filter(pa.array(of == f)).to_pylist()
                held.setdefault(int(f), []).append(np.frombuffer(b"".join(mine)))
        for f in list(held):
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([_cuts(np.concatenate(held.pop(f)), s).tolist()], pa.list_(pa.float64()))], names=["f", "cuts"])

    parts = rows.select("x").mapInArrow(part, "f int, part binary").repartitionById(max(len(used), 1), F.col("f"))
    return {used[r.f]: np.array(r.cuts) for r in parts.mapInArrow(cut, "f int, cuts array<double>").collect()}  # bins - 1 numbers of each feature


def binned_rows(rows: DataFrame, used: Sequence[int], cuts: Mapping[int, np.ndarray], s: Boosting) -> DataFrame:
    """(at, y, bins): labels and bins of a few rows each, as bytes. In order of ``at`` rows follow a hash of their values, however they came."""
    width = shuffle_width(rows)

    def bins(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = _Columns(pa.chunked_array([batch.column(1)]), used)
            binned = np.empty((batch.num_rows, len(used)), dtype=_bin_kind(s))
            for f, column in enumerate(columns):
                binned[:, f] = np.searchsorted(cuts[used[f]], column, side="left")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), _bytes_of(binned)], names=["key", "y", "bins"])

    def pack(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            y, each = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            starts = range(0, len(each), _TRAVEL)
            columns = [pa.array(np.arange(number, number + len(starts))), pa.array([y[i:i + _TRAVEL].tobytes() for i in starts], pa.binary()),
                       pa.array([b"".join(each[i:i + _TRAVEL]) for i in starts], pa.binary())]
            number += len(starts)
            yield pa.RecordBatch.from_arrays(columns, names=["at", "y", "bins"])

    keyed = rows.select(F.xxhash64("x", "y").alias("key"), "x", "y").mapInArrow(bins, "key long, y double, bins binary")
    # partition k holds the k-th range of the hash
    order = F.pmod(F.floor((F.col("key") / F.lit(2.0 ** 64) + 0.5) * width), F.lit(width)).cast("int")
    # rows of one hash have one label and the same bins, or else these put them in order
    sorted_rows = keyed.repartitionById(width, order).sortWithinPartitions("key", "y", "bins")
    return materialise(sorted_rows.mapInArrow(pack, "at long, y binary, bins binary"))


def fit_ensembles(df: DataFrame, jobs: Mapping[str, Sequence[int]], seeds: Sequence[int], settings: Boosting = Boosting(), features: str = "features",
                  label: str = "label") -> DataFrame:
    """Nodes of one model per job and seed. ``jobs`` names the positions of the feature array that a model may use.

    All rows with features and label take part in every model.
    """
    rows = df.where(F.col(features).isNotNull() & F.col(label).isNotNull()).select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"))
    jobs = {name: [int(f) for f in columns] for name, columns in jobs.items()}
    used = sorted({f for columns in jobs.values() for f in columns})
    place = {f: i for i, f in enumerate(used)}
    grid = [(name, seed) for name in jobs for seed in seeds]
    cuts = feature_cuts(rows, used, settings)
    if not cuts:
        return df.sparkSession.createDataFrame([], _NODES)
    binned = binned_rows(rows, used, cuts, settings)
    kind = np.dtype(_bin_kind(settings))

    def deal(batches):
        """Each model gets the bins of its features."""
        for batch in batches:
            if not batch.num_rows:
                continue
            blobs = [np.frombuffer(b, dtype=kind).reshape(-1, len(used)) for b in batch.column(2).to_pylist()]
            ends = np.cumsum([len(b) for b in blobs])[:-1]
            whole = np.concatenate(blobs)
            for name, columns in jobs.items():
                bins = pa.array([part.tobytes() for part in np.split(whole[:, [place[f] for f in columns]], ends)], pa.binary())
                for j, (other, _) in enumerate(grid):
                    if other == name:
                        yield pa.RecordBatch.from_arrays([pa.array([j] * batch.num_rows, pa.int32()), batch.column(0), batch.column(1), bins], names=["j", "at", "y", "bins"])

    def fit(batches):
        j, blocks, labels, waiting = None, _Blocks(), [], []

        def block():
            whole = np.concatenate(waiting)
            waiting.clear()
            for at in range(0, len(whole), BLOCK_ROWS):
                blocks.append(_paired(np.ascontiguousarray(whole[at:at + BLOCK_ROWS].T), settings.bins))

        def model():
            if waiting:
                block()
            name, seed = grid[j]
            columns, y = jobs[name], np.concatenate(labels)
            small = y.astype(np.float32)
            out = _fit_blocks(blocks, len(columns), [cuts[f] for f in columns], small if (small == y).all() else y, seed, settings)
            tree, node, feature, threshold, left, right, value, gain = zip(*out)
            feature = [columns[f] if f >= 0 else -1 for f in feature]
            values = [[name] * len(out), [seed] * len(out), tree, node, feature, threshold, left, right, value, gain]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, NODES.types)], schema=NODES)

        for batch in batches:
            model_of = batch.column(0).to_numpy()
            for begin, end in zip(*(lambda c: (c[:-1], c[1:]))([0, *(np.flatnonzero(np.diff(model_of)) + 1), len(model_of)])):
                if begin == end:
                    continue
                if j is not None and model_of[begin] != j:
                    yield model()
                    blocks, labels, waiting = _Blocks(), [], []
                j = int(model_of[begin])
                labels.append(np.frombuffer(b"".join(batch.column(2).slice(begin, end - begin).to_pylist())))
                waiting.append(np.frombuffer(b"".join(batch.column(3).slice(begin, end - begin).to_pylist()), dtype=kind).reshape(-1, len(jobs[grid[j][0]])))
                if sum(map(len, waiting)) >= BLOCK_ROWS:
                    block()
        if j is not None:
            yield model()

    dealt = binned.mapInArrow(deal, "j int, at long, y binary, bins binary")
    return dealt.repartitionById(len(grid), F.col("j")).sortWithinPartitions("j", "at").mapInArrow(fit, _NODES)


def store(models: DataFrame, path: str | None = None) -> str:
    """Write the nodes to ``path``, by default a new folder beside the checkpoints that every executor reaches."""
    spark = models.sparkSession
    if path is None:
        ensure_checkpoint_dir(spark)
        path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/ensembles-{uuid.uuid4().hex}"
    models.write.parquet(path)
    return path


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_NODES).parquet(path)


def _packed(models: DataFrame) -> dict[tuple, list]:
    """{(name, seed): [base, (feature, threshold, left, right, value) of each tree]}; size bounded by trees and leaves."""
    out: dict[tuple, dict] = {}
    for r in models.collect():
        out.setdefault((r.name, r.seed), {}).setdefault(r.tree, {})[r.node] = (r.feature, r.threshold, r.left, r.right, r.value)
    return {key: [trees[-1][0][4], *(tuple(np.array(c) for c in zip(*(nodes[i] for i in range(len(nodes))))) for t, nodes in sorted(trees.items()) if t >= 0)]
            for key, trees in out.items()}


def predict_trees(x: np.ndarray, model: list) -> np.ndarray:
    score = np.full(len(x), model[0])
    rows = np.arange(len(x))
    for feature, threshold, left, right, value in model[1:]:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            low = x[rows, np.maximum(f, 0)] <= threshold[at]
            at = np.where(inner, np.where(low, left[at], right[at]), at)
        score += value[at]
    return 1 / (1 + np.exp(-score))


def score(df: DataFrame, models: DataFrame, keep: Sequence[str], features: str = "features") -> DataFrame:
    """(keep, name, seed, prob): every row scored by every model; rows without features are left out."""
    packed = df.sparkSession.sparkContext.broadcast(_packed(models))
    narrow = df.where(F.col(features).isNotNull()).select(*keep, F.col(features).cast("array<double>").alias("_x"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.select(*keep).schema)

    def scan(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.nan_to_num(np.asarray(batch.column(len(keep)).flatten()).reshape(batch.num_rows, -1))
            for (name, seed), model in packed.value.items():
                columns = [*(batch.column(i) for i in range(len(keep))), pa.array([name] * len(x)), pa.array([seed] * len(x), pa.int32()), pa.array(predict_trees(x, model))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "name", "seed", "prob"])

    return narrow.mapInArrow(scan, f"{types}, name string, seed int, prob double")


def gains(models: DataFrame, names: Sequence[str]) -> DataFrame:
    """(name, seed, feature, gain): share of a model's gain that each feature brings, zeros included."""
    spark = models.sparkSession
    features = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "position int, feature string")
    sums = models.where("feature >= 0").groupBy("name", "seed", F.col("feature").alias("position")).agg(F.sum("gain").alias("g"))
    fits = models.select("name", "seed").distinct()
    every = fits.withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    joined = every.join(sums, ["name", "seed", "position"], "left").na.fill({"g": 0.0})
    total = fits.join(sums.groupBy("name", "seed").agg(F.sum("g").alias("total")), ["name", "seed"], "left").na.fill({"total": 0.0})
    return joined.join(total, ["name", "seed"]).join(features, "position").select("name", "seed", "feature", F.when(F.col("total") > 0, F.col("g") / F.col("total")).otherwise(F.lit(0.0)).alias("gain"))
