"""Masked pseudo-likelihood: a bidirectional window network predicts every word from both sides.

Words are lower-cased and cut at white space. One pass counts every distinct word of all documents, in a table that
grows with the corpus. The KNOWN most frequent words are the network's vocabulary: the first SINGLE are predicted as
themselves, the others in bands of about equal mass within which the corpus counts speak; every word beyond the
vocabulary is of one class, and its own count, joined from the table, speaks there, less what the document itself holds
of it. The network reads the words at OFFSETS around a masked position. A document's score is the sum over all its words
of log P(class | both sides) + log P(word | class).

Training is data-parallel numpy: rows are dealt to shards by a hash of id and text and sorted by it, so that neither the
input's partitions nor a lost executor changes what a shard learns. In each of ROUNDS rounds every shard starts from the
common weights, runs Adagrad over one in ROUNDS of the positions of all its documents, and sends its weights in blocks;
blocks are averaged by the number of positions behind them. The rounds together hide every position once. The number of
shards follows the bytes of text; the size of the network does not, and is what driver and tasks hold. Sums of floats in
another order may move a score by a relative 1e-6.

Null, empty and blank texts have no words: score 0 and a null mean. Equal texts get equal scores, as often as they are
repeated (each repeat counts as another document). Very long texts are a step of their own, read whole. An empty table
gives an empty result. Only doc_id and text are read. Words of equal count are ranked by hash.
"""

from __future__ import annotations

from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_signed, discard, flat, keep, lower_ascii, mix, span_hashes, steps, table, text_or_empty, words

#: Words of the vocabulary, those predicted as themselves, all classes (the last one: words beyond the vocabulary).
KNOWN, SINGLE, CLASSES, HIDDEN = 1 << 15, 48, 80, 16
#: Context inputs: the first OWN words have their own, others share the rest; one more stands for no word.
OWN, INPUTS = 3072, 4096
OFFSETS = (-2, -1, 1, 2)
ROUNDS, BATCH, RATE, BLOCK, SHARD_BYTES = 2, 8192, 0.1, 4096, 16 << 20
SHAPE = (len(OFFSETS) * (INPUTS + 1) * HIDDEN, HIDDEN * CLASSES, CLASSES)
#: Positions whose classes fit a core's cache together; values beyond this are brought down before they are raised to powers.
CHUNK, HIGH = 1024, 60
#: What every word has beside its occurrences in other documents.
UNSEEN = 0.5


class Vocabulary:
    """The most frequent words (hashes and counts, most frequent first), the classes, and log P(word | class).

    floor and last: the count and the (signed) hash of its last word."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.order = np.argsort(hashes)
        self.hashes, n = hashes[self.order], len(hashes)
        # where the hashes with each value of their leading bits begin
        bits = max(1, n.bit_length())
        self.far = np.uint64(64 - bits)
        self.begin = np.searchsorted(self.hashes >> self.far, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.begin).max())
        self.cls = np.full(n + 1, CLASSES - 1, np.int64)
        self.cls[: min(n, SINGLE)] = np.arange(min(n, SINGLE))
        rest, bands = counts[SINGLE:].astype(float), CLASSES - 1 - SINGLE
        if len(rest):
            mass = np.cumsum(rest)
            self.cls[SINGLE:n] = SINGLE + np.minimum((mass - 1e-9) / mass[-1] * bands, bands - 1).astype(np.int64)
        whole = np.bincount(self.cls[:n], weights=counts, minlength=CLASSES)
        self.floor, self.last = (int(counts[-1]), int(hashes[-1:].view(np.int64)[0])) if n else (0, 0)
        self.within = np.append(np.log(counts / whole[self.cls[:n]]) if n else np.zeros(0), 0.0)

    def rank(self, h: np.ndarray) -> np.ndarray:
        """The place of each word in the vocabulary, or its size for a word beyond it."""
        n = len(self.hashes)
        if not n:
            return np.zeros(len(h), np.int64)
        slot = (h >> self.far).astype(np.intp)
        at, end = self.begin[slot], self.begin[slot + 1]
        for _ in range(self.most):
            less = (at < end) & (self.hashes.take(at, mode="clip") < h)
            if not less.any():
                break
            at += less
        at = np.minimum(at, n - 1)
        return np.where(self.hashes[at] == h, self.order[at], n)


def initial(seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    flat_weights = np.zeros(sum(SHAPE), np.float32)
    flat_weights[: SHAPE[0]] = rng.normal(0, 0.3, SHAPE[0])
    flat_weights[SHAPE[0] : SHAPE[0] + SHAPE[1]] = rng.normal(0, 0.1, SHAPE[1])
    return flat_weights


def parts(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = SHAPE[0], SHAPE[0] + SHAPE[1]
    return weights[:a].reshape(len(OFFSETS), INPUTS + 1, HIDDEN), weights[a:b].reshape(HIDDEN, CLASSES), weights[b:]


def hashed_words(col: pa.Array):
    """Yields (first row, rows, hash of each word, row of each word) for a step of texts."""
    data, offsets = flat(col)
    low = lower_ascii()
    for lo, hi in steps(offsets):
        part = offsets[lo : hi + 1]
        piece, part = low[data[part[0] : part[-1]]], part - part[0]
        at, end, own = words(piece, part)
        yield lo, hi - lo, span_hashes(piece, at, end), own


def contexts(h: np.ndarray, rank: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The inputs at OFFSETS around each word; the last input: no word there."""
    around = np.where(rank < OWN, rank, OWN + (h % np.uint64(INPUTS - OWN)).astype(np.int64))
    out = np.full((len(OFFSETS), len(h)), INPUTS, np.int64)
    for k, d in enumerate(OFFSETS):
        n = len(h) - abs(d)
        if n > 0:
            to, of = (slice(-d, None), slice(0, n)) if d < 0 else (slice(0, n), slice(d, None))
            same = own[to] == own[of]
            out[k, to][same] = around[of][same]
    return out


def hidden(tables: np.ndarray, context: np.ndarray) -> np.ndarray:
    h = tables[0].take(context[0], axis=0)
    for k in range(1, len(OFFSETS)):
        h += tables[k].take(context[k], axis=0)
    return np.tanh(h, out=h)


def lowered(z: np.ndarray, out: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """z, less its rows' largest values if the weights let any value pass HIGH (hidden values are 1 at most)."""
    if np.abs(out).sum(axis=0).max() + np.abs(bias).max() > HIGH:
        z -= z.max(axis=1, keepdims=True)
    return z


def forward(weights, context: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hidden state and log-probabilities of the classes for each position.

    exact: products are summed in double precision, so that a position's result does not hang on its place in the batch.
    """
    tables, out, bias = parts(weights)
    h = hidden(tables, context)
    z = h.astype(np.float64) @ out.astype(np.float64) if exact else h @ out
    z += bias
    z = lowered(z.astype(h.dtype, copy=False), out, bias)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return h, z


def gradient(weights, context: np.ndarray, target: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """Of the mean negative log-likelihood: (inputs, rows of the gradient) for each offset, output matrix, bias."""
    n, (tables, out, bias) = len(target), parts(weights)
    dh, d_out, d_bias = np.empty((n, HIDDEN), out.dtype), np.zeros_like(out), np.zeros_like(bias)
    for lo in range(0, n, CHUNK):
        y = target[lo : lo + CHUNK]
        h = hidden(tables, context[:, lo : lo + CHUNK])
        d = h @ out
        d += bias
        np.exp(lowered(d, out, bias), out=d)
        d *= 1 / d.sum(axis=1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d_out += h.T @ d
        d_bias += d.sum(axis=0)
        dh[lo : lo + CHUNK] = (d @ out.T) * (1 - h * h)
    dh /= n
    rows = []
    for k in range(len(OFFSETS)):
        order = np.argsort(context[k].astype(np.int16), kind="stable")  # few values: a radix sort
        ids = context[k].take(order)
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        rows.append((ids[first], np.add.reduceat(dh.take(order, axis=0), first, axis=0)))
    return rows, d_out / n, d_bias / n


class Trainer:
    """Adagrad over batches of masked positions."""

    def __init__(self, weights: np.ndarray):
        self.w = weights.copy()
        self.g = np.full(len(weights), 1e-3, np.float32)
        self.n = 0

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        if not len(target):
            return
        self.n += len(target)
        scale = np.float32(np.sqrt(len(target)))
        rows, *dense = gradient(self.w, context, target)
        tables, *values = parts(self.w)
        past_tables, *pasts = parts(self.g)
        for value, grad, past in zip(values, dense, pasts):
            past += (scale * grad) ** 2
            value -= RATE * scale * grad / np.sqrt(past)
        for k, (at, grad) in enumerate(rows):
            grad *= scale
            past = past_tables[k].take(at, axis=0) + grad * grad
            past_tables[k][at] = past
            tables[k][at] = tables[k].take(at, axis=0) - np.float32(RATE) * grad / np.sqrt(past)


def masked(h: np.ndarray, own: np.ndarray, turn: int) -> np.ndarray:
    """The positions that this round hides: chosen by a hash of the word and its place in the text, so that the rounds
    share all positions out, and a rerun or other batches hide the same."""
    if not len(own):
        return np.zeros(0, np.int64)
    nth = np.arange(len(own)) - np.searchsorted(own, np.arange(own[-1] + 1))[own]
    seed = nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + h
    return np.flatnonzero((mix(seed) >> np.uint64(44)) % np.uint64(ROUNDS) == turn % ROUNDS)


def _counts(batches):
    """(word, n) of the words of some texts, combined as far as memory allows."""
    held, size = [], 0

    def told():
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(as_signed(h)), pa.array(n.astype(np.int64))], ["word", "n"])

    for batch in batches:
        for _, _, h, _ in hashed_words(batch.column(0)):
            held.append(h)
            size += len(h)
            if size > 2_000_000:
                yield told()
                held, size = [], 0
    if held:
        yield told()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (a hash), n: occurrences in all documents, kept in the shared folder."""
    got = docs.select(F.col("text").cast("string")).mapInArrow(_counts, "word long, n long")
    return keep(got.groupBy("word").agg(F.sum("n").alias("n")), "words")


def vocabulary(counts: DataFrame) -> Vocabulary:
    got = counts.orderBy(F.desc("n"), "word").limit(KNOWN).toArrow()  # bound: KNOWN rows
    return Vocabulary(got["word"].to_numpy().view(np.uint64), got["n"].to_numpy())


def _learnt(weights: np.ndarray, vocab: Vocabulary, turn: int, texts) -> pa.RecordBatch | None:
    """The blocks of weights that a shard's texts (arrays) lead to."""
    t = Trainer(weights)
    c, y = np.zeros((len(OFFSETS), 0), np.int64), np.zeros(0, np.int64)
    for col in texts:
        for _, _, h, own in hashed_words(col):
            rank, hide = vocab.rank(h), masked(h, own, turn)
            c, y = np.concatenate([c, contexts(h, rank, own)[:, hide]], axis=1), np.concatenate([y, vocab.cls[rank[hide]]])
            stop = len(y) - len(y) % BATCH  # full batches alone, so that it does not matter in what pieces the texts come
            for k in range(0, stop, BATCH):
                t.step(c[:, k : k + BATCH], y[k : k + BATCH])
            c, y = c[:, stop:], y[stop:]
    t.step(c, y)
    if not t.n:
        return None
    blocks = [t.w[k : k + BLOCK] for k in range(0, len(t.w), BLOCK)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([t.n] * len(blocks), pa.int64()), pa.array([b.tobytes() for b in blocks], pa.binary())], ["block", "n", "weights"])


def _pieces(batches):
    """Batches of (shard, text), shard after shard, as (shard, texts)."""
    for batch in batches:
        shard = batch.column(0).to_numpy()
        cut = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for lo, hi in pairwise(cut):
            if hi > lo:
                yield int(shard[lo]), batch.column(1).slice(lo, hi - lo)


def _train(weights: np.ndarray, vocab: Vocabulary, turn: int):
    def run(batches):
        for _, pieces in groupby(_pieces(batches), key=lambda p: p[0]):
            if (out := _learnt(weights, vocab, turn, (col for _, col in pieces))) is not None:
                yield out

    return run


def _average(batches):
    """Streams blocks and holds one sum for each of the (few) blocks of this task."""
    sums: dict[int, list] = {}
    for batch in batches:
        for block, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
            s = sums.setdefault(block, [0, 0.0])
            s[0] += n
            s[1] = s[1] + n * np.frombuffer(raw, np.float32).astype(np.float64)
    keys = sorted(sums)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([(sums[k][1] / sums[k][0]).astype(np.float32).tobytes() for k in keys], pa.binary())], ["block", "weights"])


def dealt(docs: DataFrame) -> DataFrame:
    """shard, text: shards of about SHARD_BYTES, each in an order of its own that the input's partitions don't change."""
    slim = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64(text_or_empty(), F.col("doc_id").cast("long")).alias("deal")).where("text <> ''")
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // SHARD_BYTES))
    rows = slim.withColumn("shard", F.pmod("deal", F.lit(n))).repartition(n, "shard")
    return rows.sortWithinPartitions("shard", "deal", F.xxhash64("text")).select("shard", "text")


def train(docs: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    weights, shards = initial(), keep(dealt(docs), "shards")
    n_blocks = -(-len(weights) // BLOCK)
    for turn in range(rounds):
        sent = shards.mapInArrow(_train(weights, vocab, turn), "block int, n long, weights binary")
        got = sent.repartition(min(n_blocks, 16), "block").mapInArrow(_average, "block int, weights binary").toArrow()  # one row a block: the size of the network
        for block, raw in zip(got["block"].to_pylist(), got["weights"].to_pylist()):
            weights[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(raw, np.float32)
    discard(shards.sparkSession, shards.kept_at)
    return weights


def _score(weights: np.ndarray, vocab: Vocabulary):
    def run(batches):
        first = TaskContext.get().partitionId() << 40 if TaskContext.get() else 0
        for batch in batches:
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            rare, again, many = [], [], np.zeros(batch.num_rows, np.int64)
            for lo, rows, h, own in hashed_words(batch.column(1)):
                rank = vocab.rank(h)
                context, y = contexts(h, rank, own), vocab.cls[rank]
                gain = np.empty(len(h))
                for k in range(0, len(h), CHUNK):
                    s = slice(k, k + CHUNK)
                    logp = forward(weights, context[:, s], True)[1]
                    gain[s] = logp[np.arange(len(y[s])), y[s]]
                gain += vocab.within[rank]
                total[lo : lo + rows] = np.bincount(own, weights=gain, minlength=rows)
                n[lo : lo + rows] = np.bincount(own, minlength=rows)
                # the words beyond the vocabulary, once a row
                out = rank == len(vocab.hashes)
                order = np.lexsort((h[out], own[out]))
                word, of = h[out][order], own[out][order]
                new = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (of[1:] != of[:-1])))) if len(word) else np.zeros(0, np.int64)
                rare.append(as_signed(word[new]))
                again.append(np.diff(np.append(new, len(word))))
                many[lo : lo + rows] = np.bincount(of[new], minlength=rows)
            off = pa.array(np.concatenate(([0], np.cumsum(many))), pa.int32())
            of_rows = lambda x: pa.ListArray.from_arrays(off, pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first + np.arange(batch.num_rows)), pa.array(n), pa.array(np.round(total, 6)), of_rows(rare), of_rows(again)], ["doc_id", "row", "n_words", "known", "rare", "again"])
            first += batch.num_rows

    return run


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, log_likelihood (summed over all words), per_word, for every row."""
    counts = word_counts(docs)
    vocab = vocabulary(counts)
    weights = train(docs, vocab)
    met = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_score(weights, vocab), "doc_id long, row long, n_words long, known double, rare array<long>, again array<long>")
    met = keep(met, "scored")
    # log P(word | beyond the vocabulary): its occurrences in other documents over all such occurrences
    least = F.lit(int(vocab.floor))
    tail = counts.where((F.col("n") < least) | ((F.col("n") == least) & (F.col("word") > F.lit(int(vocab.last)))))
    mass, size = tail.agg(F.sum("n"), F.count("*")).first()
    whole = float(np.log((mass or 0) + UNSEEN * (size or 0) + 1))
    words_of = met.select("row", F.explode(F.arrays_zip("rare", "again")).alias("r")).select("row", F.col("r.rare").alias("of"), F.col("r.again").alias("again"))
    seen = words_of.join(tail, F.col("of") == F.col("word")).groupBy(F.col("row").alias("in_row")).agg(F.sum(F.col("again") * (F.log(F.col("n") - F.col("again") + UNSEEN) - whole)).alias("told"))
    out = met.join(seen, F.col("row") == F.col("in_row"), "left").withColumn("log_likelihood", F.col("known") + F.coalesce("told", F.lit(0.0)))
    return out.select("doc_id", "n_words", "log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")).alias("per_word"))


def query(spark, sf_dir):
    return scores(table(spark, sf_dir, "documents"))
