"""Katz back-off language model of order 2: Good-Turing discounted counts, exactly normalised back-off weights.

P(w | h) = d(r) r / (c(h) + 1) for a bigram seen r times, else alpha(h) P(w); P(w) = d(r) r / (N + 1) for a known
word and the rest of the mass for the one unknown word; alpha(h) = (1 - sum of seen P(. | h)) / (1 - sum of
their P(.)), so each context sums to one. Counts up to K are discounted by Good-Turing's formula; where the
counts of counts do not allow it, by half a count. The one added to each total keeps some mass to back off
with where no count is small enough to be discounted.

Tables and rows that grow with the corpus stay distributed:

1. Word counts are one table, hashed by word. The at most FREQUENT most frequent words reach every task
   as a sorted array (4 MB whatever the corpus); it only shortens what is sent.
2. Every text is cut into bigrams once. A chunk of texts sends each bucket its distinct bigrams with the
   places of the texts that hold them. A bucket owns contexts (frequent ones are dealt out by bigram), so it has
   the whole bigram table of its contexts and scores all their occurrences where they are, first counting, then
   chunk by chunk. Buckets are as many as the corpus has tokens for, so their size does not grow.
3. What discounts depend on (counts of counts) is known only after all buckets, so sums keep the number of
   bigrams seen once, twice, ... and the discounts are applied at the end. Back-off needs the probabilities of
   rare words: those few rows are joined with the table of word counts.

The bigram of a hot pair is sent once per chunk with its texts; sums come back for the texts of a chunk that hold
a bigram of the bucket. Words and bigrams are 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.blobs import pack, runs, small, unpack
from seqlab.llm.staging import staged, training_row, width
from seqlab.llm.words import NOT_SPACE, U64, Words, blocks, mix, signed

K = 5
FOLDS = 10
FREQUENT = 1 << 18
CHUNK_BYTES, CHUNK_TEXTS = 6 << 20, 60_000
START, END = U64(0x5747A37B00000001), U64(0xE2D0F5EE00000002)
RARE = np.uint32(0xFFFFFFFF)
#: Tokens a bucket is meant to hold, and bigrams that wait until they are merged with those of their bucket.
BUCKET_TOKENS, PENDING = 3 << 20, 1 << 18


def discounts(of_counts: list[int], k: int = K) -> list[float]:
    """d(1) .. d(k) from the numbers of types seen 1, 2, ... k + 1 times."""
    n = of_counts
    if min(n[:k + 1]) > 0:
        tail = (k + 1) * n[k] / n[0]
        d = [((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail) if tail < 1 else 0.0 for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            return d
    return [1 - 0.5 / r for r in range(1, k + 1)]


def of_counts(df: DataFrame, column: str) -> list[int]:
    row = df.agg(*[F.coalesce(F.sum((F.col(column) == r).cast("long")), F.lit(0)).alias(f"n{r}") for r in range(1, K + 2)]).first()
    return [int(x) for x in row]


# --- word counts ------------------------------------------------------------------------------------

def word_counts(documents: DataFrame, folds: int) -> DataFrame:
    """(word, n) over the texts outside the held-out fold; a text ends with the word END."""
    def run(batches):
        held = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        for part, data, offsets in blocks(batches):
            words = Words(data, offsets, NOT_SPACE)
            train = part.column(1).to_numpy(zero_copy_only=False)
            found, n = np.unique(words.hashes()[train[words.text_of]], return_counts=True)
            keys = np.concatenate([held[0], found, [END]])
            keys, where = np.unique(keys, return_inverse=True)
            held = keys, np.bincount(where, weights=np.concatenate([held[1], n, [int(train.sum())]]), minlength=len(keys)).astype(np.int64)
            if len(keys) > 1 << 21:
                yield pa.RecordBatch.from_arrays([pa.array(signed(held[0])), pa.array(held[1])], names=["word", "n"])
                held = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed(held[0])), pa.array(held[1])], names=["word", "n"])

    rows = documents.select("text", training_row("doc_id", folds).alias("train"))
    return rows.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def frequent_words(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the most frequent words, at most FREQUENT of them."""
    level = F.floor(F.log2("n"))
    sizes = sorted(((r["level"], r["words"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()), reverse=True)
    taken, least = 0, 1 << 62
    for power, words in sizes:
        if taken + words > FREQUENT:
            break
        taken, least = taken + words, 1 << int(power)
    found = counts.where(F.col("n") >= least).toArrow()
    hashes = found.column("word").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found.column("n").to_numpy()[order]


class Model:
    """What every task needs of the word counts."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, types: int, unigram: list[float], documents: int, buckets: int):
        self.hashes, self.counts, self.total, self.types, self.unigram, self.buckets = hashes, counts, total, types, unigram, buckets
        self.documents = documents
        # contexts above this share of the corpus are dealt out by bigram
        self.hot_from = max(total // (8 * buckets), 1000)

    def index(self, words: np.ndarray) -> np.ndarray:
        """Place in the table of frequent words, or RARE."""
        if not len(self.hashes):
            return np.full(len(words), RARE)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, at.astype(np.uint32), RARE)

    def count_of(self, words: np.ndarray) -> np.ndarray:
        at = self.index(words)
        known = at != RARE
        out = np.full(len(words), -1, dtype=np.int64)
        out[known] = self.counts[at[known]]
        return out

    def hot(self, contexts: np.ndarray) -> np.ndarray:
        return (contexts == START) | (self.count_of(contexts) >= self.hot_from)

    def context_total(self, contexts: np.ndarray) -> np.ndarray:
        """c(h) of frequent contexts: every text begins with START once, and a word is followed by one token."""
        return np.where(contexts == START, self.documents, self.count_of(contexts))

    def probability(self, n: np.ndarray) -> np.ndarray:
        """P(w) of words with count n > 0."""
        d = np.array([0.0, *self.unigram, 1.0])
        return d[np.minimum(n, K + 1)] * n / (self.total + 1)


# --- chunks to buckets --------------------------------------------------------------------------------

def _bigrams(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, context, word) with START before and END after each text."""
    counts = words.counts
    size = counts + 1
    first = np.concatenate([[0], np.cumsum(size)])
    context = np.full(first[-1], START)
    word = np.full(first[-1], END)
    at = np.arange(len(words.start)) + words.text_of
    word[at] = words.hashes()
    context[at + 1] = words.hashes()
    return np.repeat(np.arange(len(counts)), size), context, word


def _send(model: Model, chunk: int, ids: pa.Array, train: np.ndarray, text: np.ndarray, context: np.ndarray, word: np.ndarray):
    """(chunk, bucket, blob) rows of one chunk of texts; the blob of the last row describes the texts."""
    order = np.lexsort((word, context))
    text, context, word = text[order], context[order], word[order]
    pair = runs(context, word)
    h, w = context[pair], word[pair]
    per = np.diff(np.append(pair, len(context)))
    run = runs(h)
    hot = np.repeat(model.hot(h[run]), np.diff(np.append(run, len(h))))
    bucket = ((np.where(hot, mix(mix(h) + w), mix(h)) >> U64(32)) * U64(model.buckets) >> U64(32)).astype(np.int64)
    by_bucket = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[by_bucket], np.arange(model.buckets + 1))
    flags = np.packbits(train)
    for b in range(model.buckets):
        mine = by_bucket[edges[b]:edges[b + 1]]
        if not len(mine):
            continue
        hs, ws, n = h[mine], w[mine], per[mine]
        starts = runs(hs)
        place = np.repeat(pair[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        hi, wi = model.index(hs[starts]), model.index(ws)
        yield chunk, b, pack(hi, hs[starts][hi == RARE], small(np.diff(np.append(starts, len(hs)))), wi, ws[wi == RARE], small(n), small(text[place]), flags)
    sizes = np.bincount(text, minlength=len(train))
    yield chunk, int(mix(np.array([chunk], dtype=np.uint64))[0] % U64(model.buckets)), b"T" + _texts(ids, train, sizes)


def _texts(ids: pa.Array, train: np.ndarray, sizes: np.ndarray) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([ids, pa.array(~train), pa.array(sizes.astype(np.int64))], names=["doc_id", "held_out", "n_tokens"])
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _chunks(documents: DataFrame, shared, folds: int) -> DataFrame:
    def run(batches):
        model, part_no, number = shared.value, TaskContext.get().partitionId(), 0
        texts, size, count = [], 0, 0

        def flush():
            offset, text, context, word = 0, [], [], []
            for ids, train, t, c, w in texts:
                text.append(t + offset)
                context.append(c)
                word.append(w)
                offset += len(ids)
            ids = pa.concat_arrays([x[0] for x in texts])
            rows = list(_send(model, part_no << 20 | number, ids, np.concatenate([x[1] for x in texts]), *map(np.concatenate, (text, context, word))))
            for row in rows:
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), pa.array([row[1]], pa.int32()), pa.array([row[2]], pa.binary())], names=["chunk", "bucket", "blob"])

        for part, data, offsets in blocks(batches):
            texts.append((part.column(0), part.column(2).to_numpy(zero_copy_only=False), *_bigrams(Words(data, offsets, NOT_SPACE))))
            size, count = size + len(data), count + part.num_rows
            if size >= CHUNK_BYTES or count >= CHUNK_TEXTS:
                yield from flush()
                texts, size, count, number = [], 0, 0, number + 1
        if texts:
            yield from flush()

    rows = documents.select("doc_id", "text", training_row("doc_id", folds).alias("train"))
    return rows.mapInArrow(run, "chunk bigint, bucket int, blob binary")


# --- buckets ------------------------------------------------------------------------------------------

#: kind: T texts of a chunk, S sums for them, N counts of counts, C a context, Y a rare word that follows one,
#: A a text that backs off from a context, R a rare or unknown word that a text backs off to.
_OUT = "kind string, chunk bigint, text bigint, h bigint, w bigint, n bigint, x double, m array<bigint>, blob binary"
_OUT_ARROW = pa.schema([("kind", pa.string()), ("chunk", pa.int64()), ("text", pa.int64()), ("h", pa.int64()), ("w", pa.int64()), ("n", pa.int64()), ("x", pa.float64()),
                        ("m", pa.list_(pa.int64())), ("blob", pa.binary())])


def _rows(kind: str, count: int, **columns) -> pa.Table:
    full = [pa.array([kind] * count, pa.string()) if f.name == "kind" else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in _OUT_ARROW]
    return pa.Table.from_arrays(full, schema=_OUT_ARROW)


class _Chunk:
    """The distinct bigrams of one chunk that fall into one bucket, and the texts that hold them."""

    def __init__(self, model: Model, blob: bytes):
        hi, hr, hn, wi, wr, n, text, bits = unpack(blob)
        contexts = np.zeros(len(hi), dtype=np.uint64)
        contexts[hi == RARE], contexts[hi != RARE] = hr, model.hashes[hi[hi != RARE]]
        self.w = np.zeros(len(wi), dtype=np.uint64)
        self.w[wi == RARE], self.w[wi != RARE] = wr, model.hashes[wi[wi != RARE]]
        self.h = np.repeat(contexts, hn.astype(np.int64))
        self.key = mix(mix(self.h) + self.w)
        self.n, self.text = n.astype(np.int64), text.astype(np.int64)
        train = np.unpackbits(bits).astype(bool)
        self.trained = np.add.reduceat(train[self.text].astype(np.int64), np.concatenate([[0], np.cumsum(self.n)[:-1]]))


class _Bigrams:
    """The training bigrams of a bucket, sorted by hash: h, w, count r, and their contexts with totals c(h)."""

    def __init__(self, model: Model, blobs: list[bytes]):
        self.key = self.h = self.w = np.zeros(0, dtype=np.uint64)
        self.r = np.zeros(0, dtype=np.int64)
        waiting, size = [], 0
        for blob in blobs:
            chunk = _Chunk(model, blob)
            seen = chunk.trained > 0
            waiting.append((chunk.key[seen], chunk.h[seen], chunk.w[seen], chunk.trained[seen]))
            size += int(seen.sum())
            if size > max(len(self.key), PENDING):
                self._merge(waiting)
                waiting, size = [], 0
        self._merge(waiting)
        self.contexts, self.context_of = np.unique(self.h, return_inverse=True)
        self.hot = model.hot(self.contexts)
        self.total = np.bincount(self.context_of, weights=self.r, minlength=len(self.contexts)).astype(np.int64)
        self.total[self.hot] = model.context_total(self.contexts[self.hot])

    def _merge(self, waiting: list[tuple]) -> None:
        key, h, w, r = (np.concatenate(c) for c in zip((self.key, self.h, self.w, self.r), *waiting))
        self.key, first, where = np.unique(key, return_index=True, return_inverse=True)
        self.h, self.w = h[first], w[first]
        self.r = np.bincount(where, weights=r, minlength=len(self.key)).astype(np.int64)

    def count(self, chunk: _Chunk) -> np.ndarray:
        return _look_up(self.key, self.r, chunk.key)

    def context_totals(self, model: Model, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """c(h), 0 for contexts not seen in training, and the place of h among the bucket's contexts or -1."""
        place = _look_up(self.contexts, np.arange(len(self.contexts)), h, missing=-1)
        total = np.where(place >= 0, np.append(self.total, 0)[place], 0)
        away = np.flatnonzero(place < 0)  # the bigrams of a frequent context may all lie in other buckets
        away = away[model.hot(h[away])]
        total[away] = model.context_total(h[away])
        return total, place


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: int = 0) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def _score_bucket(model: Model, table: pa.Table) -> pa.Table:
    """Counts first, then one chunk at a time: memory holds the bucket's packed rows, its bigram types and one chunk."""
    out, chunks, blobs = [], [], []
    for chunk, blob in zip(table.column("chunk").to_pylist(), table.column("blob").to_pylist()):
        if blob[:1] == b"T":
            out.append(_rows("T", 1, chunk=[chunk], blob=[blob[1:]]))
        else:
            chunks.append(chunk)
            blobs.append(blob)
    if not chunks:
        return pa.concat_tables(out) if out else _rows("N", 0)
    seen = _Bigrams(model, blobs)
    asked = seen.hot.copy()
    sums = []
    for chunk, blob in zip(chunks, blobs):
        part = _Chunk(model, blob)
        sums.append(_sum_chunk(model, seen, part, asked, chunk, out))
    out.append(_rows("S", len(chunks), chunk=chunks, blob=sums))
    out.append(_rows("N", 1, m=[[int((seen.r == i).sum()) for i in range(1, K + 2)]]))

    # contexts that a text backs off from, and the rare words that follow them
    asked &= seen.total > 0
    wn = model.count_of(seen.w)
    mass = np.bincount(seen.context_of, weights=np.where(wn > 0, model.probability(np.maximum(wn, 0)), 0.0), minlength=len(seen.contexts))
    few = np.stack([np.bincount(seen.context_of[seen.r == i], minlength=len(seen.contexts)) for i in range(1, K + 1)], axis=1)
    picked = np.flatnonzero(asked)
    discounted = pa.ListArray.from_arrays(np.arange(len(picked) + 1, dtype=np.int32) * K, pa.array(few[picked].reshape(-1).astype(np.int64)))
    out.append(_rows("C", len(picked), h=signed(seen.contexts[picked]), n=seen.total[picked], x=mass[picked], m=discounted))
    follow = np.flatnonzero((wn < 0) & asked[seen.context_of])
    out.append(_rows("Y", len(follow), h=signed(seen.h[follow]), w=signed(seen.w[follow])))
    return pa.concat_tables(out)


def _sum_chunk(model: Model, seen: _Bigrams, part: _Chunk, asked: np.ndarray, chunk: int, out: list[pa.Table]) -> bytes:
    """Sums for the texts of a chunk that hold a bigram of this bucket; events of backing off go to ``out``, their contexts to ``asked``."""
    r = seen.count(part)
    total, place = seen.context_totals(model, part.h)
    backs = r == 0
    wn = model.count_of(part.w)
    seen_log = np.where(backs, 0.0, np.log10(np.maximum(r, 1) / (total + 1)))
    back_log = np.where(backs & (wn > 0), np.log10(np.maximum(model.probability(np.maximum(wn, 0)), 1e-300)), 0.0)
    base_log = np.where(part.h == START, 0.0, np.log10(total + 0.1))
    known = (part.h != START) & (total > 0)
    asked[place[backs & (place >= 0)]] = True

    used, cell = np.unique(part.text, return_inverse=True)
    pair = np.repeat(np.arange(len(part.n)), part.n)
    s, base = (np.bincount(cell, weights=x[pair], minlength=len(used)) for x in (seen_log + back_log, base_log))
    tallies = [np.bincount(cell[flag[pair]], minlength=len(used)) for flag in (known, *(r == i for i in range(1, K + 1)))]

    event = np.flatnonzero(backs[pair])
    where = (chunk << 22) | part.text[event]
    rare, trained = wn[pair[event]] < 0, total[pair[event]] > 0
    out.append(_rows("R", int(rare.sum()), text=where[rare], w=signed(part.w[pair[event][rare]])))
    out.append(_rows("A", int(trained.sum()), text=where[trained], h=signed(part.h[pair[event][trained]])))
    return pack(small(used), s, base, *map(small, tallies))


def _gather(table: pa.Table) -> pa.Table:
    """Sums of one chunk's texts over all buckets, with what describes the texts."""
    chunk = table.column("chunk")[0].as_py()
    kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
    texts = pa.ipc.open_stream(blobs[kinds.index("T")]).read_next_batch()
    size = texts.num_rows
    total = np.zeros((K + 3, size))
    for kind, blob in zip(kinds, blobs):
        if kind == "S":
            used, *columns = unpack(blob)
            total[:, used.astype(np.int64)] += np.stack([c.astype(np.float64) for c in columns])
    s, base, known, *few = total
    ints = [pa.array(np.rint(c).astype(np.int64)) for c in (known, *few)]
    return pa.Table.from_arrays([pa.array((chunk << 22) | np.arange(size)), *texts.columns, pa.array(s), pa.array(base), *ints],
                                names=["text", "doc_id", "held_out", "n_tokens", "s", "base", "known", *[f"k{i}" for i in range(1, K + 1)]])


def score_documents(documents: DataFrame, folds: int = FOLDS) -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are the one token END. Null ids count as the id '' for the fold. Repeated rows each
    give a row. Without training texts every word is the unknown word, of probability one. Other columns are
    ignored.
    """
    counts = staged(word_counts(documents, folds))
    ending = F.max(F.when(F.col("word") == int(END.view(np.int64)), F.col("n")))
    stats = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(ending, F.lit(0)).alias("ends")).first()
    total, types = int(stats["n"]), int(stats["v"])
    unigram = discounts(of_counts(counts, "n"))
    model = Model(*frequent_words(counts), total, types, unigram, int(stats["ends"]), max(width(documents), -(-total // BUCKET_TOKENS)))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    scored = staged(_chunks(documents, shared, folds).groupBy("bucket").applyInArrow(lambda t: _score_bucket(shared.value, t), _OUT))

    found = scored.where("kind = 'N'").agg(*[F.coalesce(F.sum(F.element_at("m", i)), F.lit(0)) for i in range(1, K + 2)]).first()
    bigram = discounts([int(x) for x in found])
    one = F.lit(1.0)
    discount = lambda n, d: F.element_at(F.array(*[F.lit(x) for x in d], one), F.least(n, F.lit(K + 1)).cast("int"))
    probabilities = counts.select("word", (discount(F.col("n"), unigram) * F.col("n") / float(total + 1)).alias("p"))
    seen = counts.groupBy(F.least("n", F.lit(K + 1)).alias("r")).agg(F.sum("n").alias("n")).collect()
    unknown = 1.0 - sum((unigram[r["r"] - 1] if r["r"] <= K else 1.0) * r["n"] / (total + 1) for r in seen)

    of = lambda kind: scored.where(F.col("kind") == kind)
    follow = of("Y").select("h", F.col("w").alias("word")).join(probabilities, "word").groupBy("h").agg(F.sum("p").alias("rare"))
    parts = of("C").groupBy("h").agg(F.max("n").alias("n"), F.sum("x").alias("x"), *[F.sum(F.element_at("m", i)).alias(f"m{i}") for i in range(1, K + 1)])
    kept_back = sum((F.col(f"m{r}") * float(r * (1 - bigram[r - 1])) for r in range(1, K + 1)), F.lit(0.0))
    left = (kept_back + 1.0) / (F.col("n") + 1)
    alpha = parts.join(follow, "h", "left").select("h", F.log10(left / (1.0 - F.col("x") - F.coalesce("rare", F.lit(0.0)))).alias("x"))
    backed = of("A").select("text", "h").join(alpha, "h").select("text", "x")
    rare = of("R").select("text", F.col("w").alias("word")).join(probabilities, "word", "left").select("text", F.log10(F.coalesce("p", F.lit(unknown))).alias("x"))
    extra = backed.unionByName(rare).groupBy("text").agg(F.sum("x").alias("x"))

    kind = documents.schema["doc_id"].dataType.simpleString()
    sums = scored.where("kind in ('T', 'S')").groupBy("chunk").applyInArrow(
        _gather, f"text bigint, doc_id {kind}, held_out boolean, n_tokens bigint, s double, base double, known bigint, " + ", ".join(f"k{i} bigint" for i in range(1, K + 1)))
    rows = sums.join(extra, "text", "left")
    discounted = sum((F.col(f"k{r}") * math.log10(bigram[r - 1]) for r in range(1, K + 1)), F.lit(0.0))
    ends = model.documents
    base = F.col("base") + math.log10(ends + 0.1) - F.col("n_tokens") * math.log10(total + 0.1 * (types + 1))
    return rows.select("doc_id", "held_out", "n_tokens", (F.col("known") + int(ends > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
                       base.alias("base_score"), (F.col("s") + discounted + F.coalesce("x", F.lit(0.0))).alias("score"))
