"""Bootstrap, permutation and McNemar tests with deterministic hash-keyed replicates.

Every row gets its draws from a hash of its id, so all models and metrics share the replicates, and a lost task
recomputes the same numbers. One md5 serves eight bootstrap weights (four hex digits each) or 32 swaps. A row's
draws are one array of numbers that is added to its group's (a cell of the confusion table, or a score and label);
a task sends one sum per group and replicate, so replicates cost arithmetic but no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import safe_ratio
from ..session import materialise, shuffle_width
from .metrics import confusion, threshold_metrics


def poisson_cuts(mean: float = 1.0, width: int = 16) -> list[str]:
    """Hex cut points of the Poisson distribution function; the weight is the number of cuts passed."""
    cuts, total, term, k = [], 0.0, math.exp(-mean), 0
    while True:
        total += term
        point = round(total * 2**width)
        if point >= 2**width:
            return cuts
        cuts.append(f"{point:04x}")
        k += 1
        term *= mean / k


#: numbers that a task holds for its groups before it sends them
_HELD = 1 << 22
#: weights of scores that are ranked at once
_AT_ONCE = 1 << 19
#: messages hashed at once
_HASHED = 1 << 13
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))


def md5_words(messages: np.ndarray) -> np.ndarray:
    """md5 digests, rows of 16 bytes, of padded messages of one block, rows of 64 bytes: all rows take each step together."""
    out = np.empty((len(messages), 4), dtype="<u4")
    for at in range(0, len(messages), _HASHED):
        words = np.ascontiguousarray(messages[at:at + _HASHED].view("<u4").T)
        start = [np.full(words.shape[1], v, dtype=np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
        a, b, c, d = start
        for i in range(64):
            if i < 16:
                mixed, k = d ^ (b & (c ^ d)), i
            elif i < 32:
                mixed, k = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif i < 48:
                mixed, k = b ^ c ^ d, (3 * i + 5) % 16
            else:
                mixed, k = c ^ (b | ~d), (7 * i) % 16
            mixed = mixed + a
            mixed += words[k]
            mixed += np.uint32(_SINES[i])
            turn = _TURNS[i // 16][i % 4]
            turned = mixed << np.uint32(turn)
            turned |= mixed >> np.uint32(32 - turn)
            turned += b
            a, b, c, d = d, turned, b, c
        for i, (x, y) in enumerate(zip(start, (a, b, c, d))):
            out[at:at + _HASHED, i] = x + y
    return out.view(np.uint8)


def _digests(ids: Sequence[bytes], blocks: int) -> np.ndarray:
    """md5 of each id followed by each block number, rows of 16 bytes."""
    import hashlib

    endings = [str(n).encode() for n in range(blocks)]
    sizes = np.array([len(i) for i in ids], dtype=np.int64)
    if len(ids) == 0 or int(sizes.max()) + len(endings[-1]) > 55:  # longer than one block
        return np.frombuffer(b"".join(hashlib.md5(i + n).digest() for i in ids for n in endings), dtype=np.uint8).reshape(-1, 16)
    heads = np.frombuffer(b"".join(i.ljust(64, b"\0") for i in ids), dtype=np.uint8).reshape(-1, 64)
    messages, rows = np.repeat(heads[:, None, :], blocks, axis=1), np.arange(len(ids))
    for n, ending in enumerate(endings):
        for j, byte in enumerate((*ending, 0x80)):
            messages[rows, n, sizes + j] = byte
        bits = (sizes + len(ending)) * 8
        messages[:, n, 56], messages[:, n, 57] = bits & 255, bits >> 8
    return md5_words(messages.reshape(-1, 64))


def _codes(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each group, group of each row) by the first ``n`` columns."""
    code = np.zeros(batch.num_rows, dtype=np.int64)
    for i in range(n):
        held = batch.column(i).dictionary_encode(null_encoding="encode")
        code = np.unique(code * len(held.dictionary) + held.indices.to_numpy(), return_inverse=True)[1]
    return np.unique(code, return_index=True)[1], code


def _grouped_draws(df: DataFrame, groups: Sequence[str], key: str, replicates: int, prefix: str, lanes: int, decode: Callable[[np.ndarray], np.ndarray],
                   packed: bool = False) -> DataFrame:
    """Sum of the rows' draws per group and replicate: (groups, replicate, w).

    ``decode`` turns md5 digests (rows of 16 bytes) into ``lanes`` draws each. ``packed`` gives the tasks' own sums, one row
    per group with the numbers of all replicates in one binary ``w`` (see ``_unpacked``).
    """
    narrow = df.select(*groups, F.col(key).cast("string").alias("_key"))
    fields = narrow.select(*groups).schema
    blocks = -(-replicates // lanes)

    def scan(batches):
        sums: dict[tuple, np.ndarray] = {}
        types = None

        def send():
            names = list(sums)
            if packed:
                rows = [pa.array([_as_bytes(sums[n]) for n in names], pa.binary())]
                columns = [pa.array([n[i] for n in names], t) for i, t in enumerate(types)]
                sums.clear()
                return pa.RecordBatch.from_arrays(columns + rows, names=[*groups, "w"])
            columns = [pa.array([n[i] for n in names for _ in range(replicates)], t) for i, t in enumerate(types)]
            columns += [pa.array(np.tile(np.arange(replicates, dtype=np.int32), len(names))), pa.array(np.concatenate([sums[n] for n in names]))]
            sums.clear()
            return pa.RecordBatch.from_arrays(columns, names=[*groups, "replicate", "w"])

        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.column(i).type for i in range(len(groups))]
            leader, code = _codes(batch, len(groups))
            name = lambda g: tuple(batch.column(i)[int(leader[g])].as_py() for i in range(len(groups)))
            names: dict[int, tuple] = {}
            ids = [f"{prefix}|{k}|".encode() if k is not None else f"{prefix}|".encode() for k in batch.column(len(groups)).to_pylist()]
            step = max(1, _HELD // (blocks * lanes))
            for at in range(0, len(ids), step):
                some = ids[at:at + step]
                # rows of one key often follow each other, one per model: they share the draws
                new = np.array([i == 0 or some[i] != some[i - 1] for i in range(len(some))])
                draws = decode(_digests([some[i] for i in np.flatnonzero(new)], blocks)).reshape(-1, blocks * lanes)[:, :replicates]
                drawn = np.cumsum(new) - 1
                part = code[at:at + step]
                order = np.argsort(part, kind="stable")
                first = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1]))
                if packed:  # a row of its own needs no sum
                    sizes = np.diff(np.append(first, len(order)))
                    alone = order[first[sizes == 1]]
                    if len(alone):
                        columns = [batch.column(i).take(pa.array(alone + at)) for i in range(len(groups))]
                        yield pa.RecordBatch.from_arrays([*columns, _half_bytes(draws[drawn[alone]])], names=[*groups, "w"])
                    order, sizes = order[np.repeat(sizes > 1, sizes)], sizes[sizes > 1]
                    if not len(order):
                        continue
                    first = np.cumsum(sizes) - sizes
                added = np.add.reduceat(draws[drawn[order]], first, axis=0, dtype=np.int64)
                for g, row in zip(part[order][first].tolist(), added):
                    key_of = names[g] if g in names else names.setdefault(g, name(g))
                    held = sums.get(key_of)
                    sums[key_of] = row if held is None else held + row
                if len(sums) * replicates > _HELD:
                    yield send()
        if sums:
            yield send()

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    if packed:
        return narrow.mapInArrow(scan, f"{types}{', ' if types else ''}w binary")
    parts = narrow.mapInArrow(scan, f"{types}{', ' if types else ''}replicate int, w long")
    return parts.groupBy(*groups, "replicate").agg(F.sum("w").alias("w"))


def _half_bytes(numbers: np.ndarray) -> pa.Array:
    """Rows of numbers below 16, two to a byte."""
    even = np.pad(numbers, ((0, 0), (0, 1))) if numbers.shape[1] % 2 else numbers
    raw = np.ascontiguousarray(even[:, ::2] | even[:, 1::2] << 4, dtype=np.uint8)
    ends = np.arange(len(raw) + 1, dtype=np.int32) * raw.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(raw)])


def _as_bytes(numbers: np.ndarray) -> bytes:
    """Numbers below 16 take half a byte each, others eight."""
    if numbers.max(initial=0) < 16:
        return _half_bytes(numbers[None])[0].as_py()
    return numbers.astype("<i8").tobytes()


def _unpacked(column: pa.Array, n: int) -> np.ndarray:
    """Rows of ``n`` numbers from their bytes."""
    out, half = np.empty((len(column), n), dtype=np.int64), (n + 1) // 2
    if not len(column):
        return out
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    data, sizes = np.frombuffer(data, dtype=np.uint8), np.diff(ends)
    for wide, width in ((False, half), (True, 8 * n)):
        rows = np.flatnonzero(sizes == width)
        raw = data[ends[rows][:, None] + np.arange(width)]
        if wide:
            out[rows] = raw.view("<i8")
        else:
            out[rows] = np.stack([raw & 15, raw >> 4], axis=2).reshape(len(rows), 2 * half)[:, :n]
    return out


#: weight of each of the 65,536 values of a lane
_WEIGHTS = np.searchsorted([int(cut, 16) for cut in poisson_cuts()], np.arange(1 << 16), side="right").astype(np.uint8)


def _poisson(digests: np.ndarray) -> np.ndarray:
    return _WEIGHTS[digests.reshape(-1).view(">u2")]


def bootstrap_weights(df: DataFrame, groups: Sequence[str], key: str, replicates: int, seed: int) -> DataFrame:
    """Sum of the rows' Poisson(1) weights per group and replicate: (groups, replicate, w), positive sums only."""
    return _grouped_draws(df, groups, key, replicates, f"{seed}|boot", 8, _poisson).where("w > 0")


def bootstrap_metrics(df: DataFrame, by: Sequence[str], key: str, threshold: float, replicates: int, seed: int,
                      ranking: bool = False) -> DataFrame:
    """Metrics of every bootstrap replicate, from the summed weights of the cells and, for rankings, of the scores."""
    groups = [*by, "replicate"]
    cells = bootstrap_weights(df.withColumn("_hit", F.col("prob") >= threshold), [*by, "label", "_hit"], key, replicates, seed)
    out = threshold_metrics(confusion(cells, groups, F.col("_hit"), F.col("w")))
    if ranking:
        out = out.join(bootstrap_ranking(df, by, key, replicates, seed), groups)
    return out


def _score_runs(batches, by: Sequence[str], replicates: int):
    """(group, positives, negatives) of rows sorted by group and score: weights of each distinct score, a row per score, of one group at a time."""
    held = None  # (group, score, positives, negatives): the last score may go on in the next rows
    step = max(1, _AT_ONCE // replicates)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            rows = batch.slice(at, step)
            names = list(zip(*(rows.column(i).to_pylist() for i in range(len(by))))) or [()] * rows.num_rows
            score = rows.column(len(by))
            missing = score.is_null().to_numpy(zero_copy_only=False)
            value = score.fill_null(0.0).to_numpy(zero_copy_only=False) if len(score) > score.null_count else np.zeros(len(score))
            weights, label = _unpacked(rows.column(len(by) + 2), replicates), rows.column(len(by) + 1).fill_null(-1).to_numpy(zero_copy_only=False)[:, None]
            same = ((value[1:] == value[:-1]) | (np.isnan(value[1:]) & np.isnan(value[:-1]))) & (missing[1:] == missing[:-1])
            cut = np.array([a != b for a, b in zip(names[1:], names)], dtype=bool)  # another group
            first = np.flatnonzero(np.append(True, cut | ~same))
            pos, neg = weights * (label == 1), weights * (label == 0)
            if len(first) < len(weights):
                pos, neg = np.add.reduceat(pos, first, axis=0), np.add.reduceat(neg, first, axis=0)
            at_first = (names[0], None if missing[0] else "nan" if value[0] != value[0] else value[0])
            if held is not None:
                if held[:2] == at_first:
                    pos[0] += held[2]
                    neg[0] += held[3]
                else:
                    yield held[0], held[2][None], held[3][None]
            ends = np.flatnonzero(np.append(False, cut)[first])  # scores that begin a group
            for begin, end in zip([0, *ends], [*ends, len(first)]):
                upto = end - (end == len(first))
                if upto > begin:
                    yield names[first[begin]], pos[begin:upto], neg[begin:upto]
            held = names[-1], None if missing[-1] else "nan" if value[-1] != value[-1] else value[-1], pos[-1].copy(), neg[-1].copy()
    if held is not None:
        yield held[0], held[2][None], held[3][None]


def bootstrap_ranking(df: DataFrame, by: Sequence[str], key: str, replicates: int, seed: int) -> DataFrame:
    """ROC-AUC and average precision of every replicate, from the summed weights of each score and label.

    The weights of all replicates of a score travel as one packed row. Rows are sorted into slices of the score axis once; a
    first pass adds up each slice, a second one ranks inside it above the sums of the higher slices (a row per slice and group).
    """
    rows = _grouped_draws(df, [*by, "prob", "label"], key, replicates, f"{seed}|boot", 8, _poisson, packed=True)
    order = [*[F.col(b).asc() for b in by], F.col("prob").desc()]
    slices = materialise(rows.repartitionByRange(shuffle_width(df), *order).sortWithinPartitions(*order).select(*by, "prob", "label", "w", F.spark_partition_id().alias("_slice")))
    kinds = [(f.name, f.dataType.simpleString()) for f in slices.select(*by).schema]
    types = "".join(f"`{n}` {t}, " for n, t in kinds)

    def number(batches, seen):
        for batch in batches:
            if batch.num_rows:
                seen.append(batch.column(len(by) + 3)[0].as_py())
            yield batch

    def total(batches):
        sums, seen = {}, []
        for group, pos, neg in _score_runs(number(batches, seen), by, replicates):
            held = sums.setdefault(group, np.zeros((2, replicates), dtype=np.int64))
            held += np.stack([pos.sum(axis=0), neg.sum(axis=0)])
        for group, held in sums.items():
            yield pa.RecordBatch.from_pydict({**{n: pa.array([g], t) for (n, _), g, t in zip(kinds, group, key_types)}, "_slice": pa.array([seen[0]], pa.int32()),
                                              "sums": pa.array([held.ravel().tolist()], pa.list_(pa.int64()))})

    from pyspark.sql.pandas.types import to_arrow_type

    key_types = [to_arrow_type(f.dataType) for f in slices.select(*by).schema]
    above: dict[tuple, np.ndarray] = {}
    start: dict[tuple, np.ndarray] = {}
    for row in slices.mapInArrow(total, f"{types}_slice int, sums array<bigint>").orderBy("_slice").collect():  # slices and groups: a row each
        group = tuple(row[b] for b in by)
        before = above.get(group, np.zeros((2, replicates), dtype=np.int64))
        start[(*group, row["_slice"])] = before
        above[group] = before + np.array(row["sums"], dtype=np.int64).reshape(2, -1)
    higher = df.sparkSession.sparkContext.broadcast(start)

    def rank(batches):
        state, seen = {}, []
        for group, pos, neg in _score_runs(number(batches, seen), by, replicates):
            if group not in state:
                state[group] = [*higher.value[(*group, seen[0])].astype(np.float64), *np.zeros((4, replicates))]
            held = state[group]
            p, n = pos.astype(np.float64), neg.astype(np.float64)
            tp = held[0] + np.cumsum(p, axis=0)  # this score included
            fp = held[1] + np.cumsum(n, axis=0)
            held[4] += (n * (tp - p / 2)).sum(axis=0)
            held[5] += (p * np.divide(tp, tp + fp, out=np.zeros_like(tp), where=tp + fp > 0)).sum(axis=0)
            held[0], held[1] = tp[-1], fp[-1]
            held[2] += p.sum(axis=0)
            held[3] += n.sum(axis=0)
        for group, held in state.items():
            columns = [pa.array([g] * replicates, t) for g, t in zip(group, key_types)]
            columns += [pa.array(np.arange(replicates, dtype=np.int32)), *[pa.array(x) for x in held[2:]]]
            yield pa.RecordBatch.from_arrays(columns, names=[*by, "replicate", "p", "n", "wins", "ap"])

    sums = slices.mapInArrow(rank, f"{types}replicate int, p double, n double, wins double, ap double").groupBy(*by, "replicate").agg(
        *[F.sum(x).alias(x) for x in ("p", "n", "wins", "ap")])
    p, n = F.col("p"), F.col("n")
    return sums.select(*by, "replicate", F.when((p > 0) & (n > 0), F.col("wins") / p / n).alias("roc_auc"), safe_ratio(F.col("ap"), p).alias("pr_auc"))


def interval(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """95 percent percentile interval per group."""
    return df.groupBy(*by).agg(F.percentile(value, F.lit(0.025)).alias("low"), F.percentile(value, F.lit(0.975)).alias("high"))


def paired_deltas(boot: DataFrame, model: str, target: str, other: str, keys: Sequence[str], value: str) -> DataFrame:
    pick = lambda m: F.max(F.when(F.col(model) == m, F.col(value)))
    return boot.groupBy(*keys).agg((pick(target) - pick(other)).alias("delta"))


def one_sided_p(deltas: DataFrame, observed: Column) -> DataFrame:
    """(replicates without gain + 1) / (replicates + 1); 1 when nothing was gained."""
    return deltas.agg(F.when(observed <= 0, F.lit(1.0)).otherwise(
        (F.count_if(F.col("delta") <= 0) + 1) / (F.count("*") + 1)).alias("p_value"))


def swap_counts(df: DataFrame, groups: Sequence[str], key: str, replicates: int, seed: int) -> DataFrame:
    """Rows of every group that a replicate swaps, each row with probability one half: (groups, replicate, w)."""
    decode = lambda digests: np.stack([digests >> 7, (digests >> 3) & 1], axis=2).astype(np.uint8)
    return _grouped_draws(df, groups, key, replicates, f"{seed}|swap", 32, decode)


def permutation_deltas(pairs: DataFrame, key: str, threshold: float, replicates: int, seed: int) -> DataFrame:
    """(replicate, metric, delta): every threshold metric of a minus that of b after swapping both per row with probability one half.

    ``pairs`` holds label, prob_a and prob_b. Replicate -1 is the observed order. Rows are counted by (label,
    prediction of a, prediction of b); a replicate is known by how many rows of each cell it swaps.
    """
    cell = ["label", "_a", "_b"]
    marked = pairs.withColumn("_a", F.col("prob_a") >= threshold).withColumn("_b", F.col("prob_b") >= threshold)
    swapped = swap_counts(marked, cell, key, replicates, seed)
    swapped = swapped.unionByName(marked.select(*cell).distinct().select(*cell, F.lit(-1).alias("replicate"), F.lit(0).cast("long").alias("w")))
    sizes = marked.groupBy(*cell).agg(F.count("*").alias("n"))
    # at most two labels by two by two predictions
    counts = swapped.join(F.broadcast(sizes), cell)
    kept = F.col("n") - F.col("w")
    part = lambda model, hit, w: F.struct(F.lit(model).alias("model"), hit.alias("hit"), w.alias("w"))
    parts = F.array(part("a", F.col("_a"), kept), part("a", F.col("_b"), F.col("w")), part("b", F.col("_b"), kept), part("b", F.col("_a"), F.col("w")))
    long = counts.select("replicate", "label", F.explode(parts).alias("p")).select("replicate", "label", "p.model", "p.hit", "p.w")
    values = threshold_metrics(confusion(long, ["replicate", "model"], F.col("hit"), F.col("w")))
    names = [n for n in values.columns if n not in ("replicate", "model", "tp", "fp", "tn", "fn", "n")]
    return paired_deltas(values.unpivot(["replicate", "model"], names, "metric", "value"), "model", "a", "b", ["replicate", "metric"], "value")


def permutation_p(deltas: DataFrame) -> DataFrame:
    """Per metric the observed delta and (exceeding + 1) / (n + 1), with a slack for float noise; 1 when nothing was gained."""
    observed = F.max(F.when(F.col("replicate") == -1, F.col("delta"))).over(Window.partitionBy("metric"))  # one row per replicate
    joined = deltas.withColumn("observed", observed).where("replicate >= 0")
    return joined.groupBy("metric").agg(
        F.max("observed").alias("observed"),
        F.when(F.max("observed") <= 0, F.lit(1.0)).otherwise(
            (F.count_if(F.col("delta") >= F.col("observed") - 1e-12) + 1) / (F.count("*") + 1)).alias("p_value"))


def discordant_counts(pairs: DataFrame, by: Sequence[str], threshold: float) -> DataFrame:
    right = lambda k: (F.col(k) >= threshold).cast("int") == F.col("label")
    a, b = right("prob_a"), right("prob_b")
    return pairs.groupBy(*by).agg(F.count_if(a & ~b).alias("a_only"), F.count_if(~a & b).alias("b_only"))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series eight steps on."""
    z = x + 8.0
    series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return series - sum((F.ln(x + float(i)) for i in range(1, 8)), F.ln(x))


def half_beta(a: Column, b: Column) -> Column:
    """Regularised incomplete beta function at 1/2, by its continued fraction; a, b > 0.

    The fraction settles in a number of steps near the square root of the larger argument.
    """
    turned = 0.5 >= (a + 1) / (a + b + 2)  # the other side of the mean converges faster
    p, q = F.when(turned, b).otherwise(a), F.when(turned, a).otherwise(b)
    front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) - (p + q) * math.log(2.0)) / p
    steps = F.sequence(F.lit(1), (30 + 4 * F.ceil(F.sqrt(F.greatest(a, b)))).cast("int"))
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def fraction(x: Column) -> Column:
        p, q = x["p"], x["q"]

        def step(s: Column, i: Column) -> Column:
            m = i.cast("double")
            even = m * (q - m) * 0.5 / ((p - 1 + 2 * m) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * 0.5 / ((p + 2 * m) * (p + 1 + 2 * m))
            c1, d1 = 1 + even / s["c"], 1 / (1 + even * s["d"])
            c2, d2 = 1 + odd / c1, 1 / (1 + odd * d1)
            return state(c2, d2, s["h"] * c1 * d1 * c2 * d2)

        d0 = 1 / (1 - (p + q) * 0.5 / (p + 1))
        return F.aggregate(steps, state(F.lit(1.0), d0, d0), step, lambda s: s["h"])

    value = front * F.get(F.transform(F.array(F.struct(p.alias("p"), q.alias("q"))), fraction), F.lit(0))
    return F.when(turned, 1 - value).otherwise(value)


def with_mcnemar_p(counts: DataFrame) -> DataFrame:
    """Exact one-sided binomial tail P(X >= a_only), X ~ Bin(a_only + b_only, 1/2); 1 without discordant pairs.

    The tail is the regularised incomplete beta function I(1/2; a_only, b_only + 1), so no table of terms is needed.
    """
    hit = F.greatest(F.col("a_only"), F.lit(1)).cast("double")
    tail = half_beta(hit, F.col("b_only").cast("double") + 1)
    return counts.withColumn("p_value", F.when(F.col("a_only") == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail))))
