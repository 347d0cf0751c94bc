"""Substring dedup: passages of WINDOW words that a document with a smaller doc_id has go, by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the least hash of the GRAM-word sequences in it. Consecutive windows
that share their minimiser form a super-k-mer: one stretch of words, which belongs to the minimiser's bucket as a whole.

1. One pass over the text gives each super-k-mer's place, minimiser and 128-bit hash (slim rows, no text).
2. Equal super-k-mers need no bucket: all but those of the smallest doc_id are repeats from end to end. So a crowd of copies
   meets an aggregate that combines before its shuffle.
3. Those of the smallest doc_id whose minimiser other documents have too travel as one packed string of word hashes to
   their bucket, where windows are sorted and counted: a window goes wherever its smallest doc_id is smaller than its own.
4. Buckets of over CROWD super-k-mers (a passage in very many surroundings) are dealt out again by the windows' own 128-bit
   hashes: the least doc_id of each is again an aggregate that combines first.

Windows are judged on the input. Equality in buckets is of sequences of 64-bit word hashes; elsewhere of 128-bit hashes.

Words are runs of anything but ASCII white space, unchanged. Null and empty texts have no words; texts of fewer than WINDOW
words keep all. Repeated rows and rows that share a doc_id never remove from one another (no id is smaller), nor does a
passage that repeats within one document. A row without doc_id has no place in the order: it keeps all and removes nothing
elsewhere. Very long texts are cut into super-k-mers of at most SPAN windows. An empty table gives no rows; columns of any
name pass through `deduplicated`.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_signed, flat, keep, kept_bytes, mix, quoted, row_key, span_hashes, steps, table, words

WINDOW, GRAM, SPAN, CROWD = 50, 8, 256, 4096
#: Bytes of packed strings in a slab of buckets, and in a task.
SLAB, TASK = 4 << 20, 48 << 20
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def sequences(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of each stretch of values, from one cumulative polynomial."""
    n, back = len(values), pow(base, -1, 1 << 64)

    def powers(x: int, k: int) -> np.ndarray:
        out = np.full(k, x, np.uint64)
        out[:1] = 1
        return np.cumprod(out, dtype=np.uint64)

    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(back, n + 1)[starts])


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def super_kmers(hashes: np.ndarray, doc: np.ndarray, window: int, gram: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words' hashes and documents: first word, number of windows and minimiser of each super-k-mer."""
    n = len(hashes) - window + 1
    e = np.zeros(0, np.int64)
    if n <= 0:
        return e, e, e.view(np.uint64)
    grams = np.zeros(len(hashes) - gram + 1, np.uint64)
    for k in range(gram):
        grams = grams * np.uint64(BASES[0]) + hashes[k : k + len(grams)]
    low = least(mix(grams), window - gram + 1)
    at = np.flatnonzero(doc[:n] == doc[window - 1 :])
    if not len(at):
        return e, e, e.view(np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (low[at[1:]] != low[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
    begins = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    new |= (np.arange(len(at)) - begins[run]) % span == 0
    begins = np.flatnonzero(new)
    return at[begins], np.diff(np.append(begins, len(at))), low[at[begins]]


def _runs(window: int, gram: int, span: int):
    """doc_id, row_key, text -> doc_id, row_key, start, n, mini, h1, h2 of each super-k-mer."""

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column(2))
            for lo, hi in steps(offsets):
                here, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, doc = words(here, own)
                hashes = span_hashes(here, starts, ends)
                at, n, mini = super_kmers(hashes, doc, window, gram, span)
                of = doc[at]
                pick = pa.array(lo + of)
                cols = [batch.column(0).take(pick), batch.column(1).take(pick), pa.array((at - np.searchsorted(doc, of)).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(as_signed(mini))]
                cols += [pa.array(as_signed(sequences(hashes, at, at + n + window - 1, b))) for b in BASES]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row_key", "start", "n", "mini", "h1", "h2"])

    return run


def _packed(window: int):
    """doc_id, row_key, text, runs -> one row a super-k-mer, with its words' hashes as bytes."""

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column(2))
            lists = batch.column(3)
            sizes, first, inner = np.diff(lists.offsets.to_numpy()), lists.offsets.to_numpy(), lists.values
            of_row = np.repeat(np.arange(len(sizes)), sizes)
            inner = inner.slice(first[0], first[-1] - first[0])
            start, n, mini, crowded = (inner.field(c) for c in ("start", "n", "mini", "crowded"))
            start_, n_ = start.to_numpy().astype(np.int64), n.to_numpy().astype(np.int64)
            for lo, hi in steps(offsets):
                here, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, doc = words(here, own)
                hashes = span_hashes(here, starts, ends)
                a, b = np.searchsorted(of_row, [lo, hi])
                at = np.searchsorted(doc, of_row[a:b] - lo) + start_[a:b]
                size = n_[a:b] + window - 1
                ends_of = np.cumsum(size)
                index = np.repeat(at - (ends_of - size), size) + np.arange(ends_of[-1] if len(ends_of) else 0)
                packed = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(8 * np.append(0, ends_of)), pa.py_buffer(np.ascontiguousarray(hashes[index]))]).cast(pa.binary())
                pick = pa.array(of_row[a:b])
                cols = [batch.column(0).take(pick), batch.column(1).take(pick), *(c.slice(a, b - a) for c in (start, n, mini, crowded)), packed]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row_key", "start", "n", "mini", "crowded", "packed"])

    return run


def _unpacked(packed: pa.Array, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All word hashes; of each window its super-k-mer, its number in it, and its first word."""
    off = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64) // 8
    hashes = np.frombuffer(packed.buffers()[2], np.uint64)[off[0] : off[-1]]
    of = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return hashes, of, k, (off - off[0])[of] + k


def repeats(hashes: np.ndarray, at: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Which windows (beginning at words `at`) also begin in a document with a smaller id; windows are compared word by word."""
    h1, h2 = (sequences(hashes, at, at + window, b) for b in BASES)
    order = np.lexsort((doc, h2, h1))
    a, b, d = h1[order], h2[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    heads = np.flatnonzero(new)
    head = heads[np.cumsum(new) - 1]
    found = np.flatnonzero(d > d[head])
    words_of = np.arange(window)
    for lo in range(0, len(found), 8192):
        x = found[lo : lo + 8192]
        same = (hashes[at[order[x]][:, None] + words_of] == hashes[at[order[head[x]]][:, None] + words_of]).all(axis=1)
        for h in np.unique(head[x[~same]]):  # hashes of different windows met: the group is settled by the windows themselves
            group = np.arange(h, heads[np.searchsorted(heads, h) + 1] if h != heads[-1] else len(order))
            first: dict[bytes, int] = {}
            for g in group:
                first.setdefault(hashes[at[order[g]] + words_of].tobytes(), d[g])
            d[group] = [d[h] + (d[g] > first[hashes[at[order[g]] + words_of].tobytes()]) for g in group]
    out = np.zeros(len(order), bool)
    out[order] = d > d[head]
    return out


def _ranges(of: np.ndarray, k: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring hits of one super-k-mer together: super-k-mer, first window, number of windows."""
    at = np.flatnonzero(hit)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (of[at[1:]] != of[at[:-1]])
    begins = np.flatnonzero(new)
    return of[at[begins]], k[at[begins]], np.diff(np.append(begins, len(at)))


def _buckets(window: int, slab: int):
    """Rows sorted by minimiser -> doc_id, row_key, start, n of windows that go. Holds a slab of whole buckets."""

    def settled(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        n = t["n"].to_numpy().astype(np.int64)
        packed = t["packed"].chunk(0) if t["packed"].num_chunks else pa.array([], pa.binary())
        doc = t["doc_id"].to_numpy()
        hashes, of, k, at = _unpacked(packed, n, window)
        # equal windows have equal minimisers, so buckets need no walls between them
        which, first, size = _ranges(of, k, repeats(hashes, at, doc[of], window))
        cols = [pa.array(doc[which]), pa.array(t["row_key"].to_numpy()[which]), pa.array((t["start"].to_numpy()[which] + first).astype(np.int32)), pa.array(size.astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "row_key", "start", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("packed").nbytes
            if size >= slab:
                t = pa.Table.from_batches(held).combine_chunks()
                cut = int(np.searchsorted(t["mini"].to_numpy(), t["mini"][-1].as_py()))  # the last bucket may go on
                if cut:
                    yield settled(t.slice(0, cut))
                rest = t.slice(cut)
                held, size = rest.to_batches(), rest["packed"].nbytes
        if held:
            yield settled(pa.Table.from_batches(held))

    return run


def _windows(window: int):
    """Super-k-mers of crowded buckets -> doc_id, row_key, at, w1, w2 of each window."""

    def run(batches):
        for batch in batches:
            total = batch.column("n").to_numpy().astype(np.int64)
            ends = np.append(0, np.cumsum(total))
            for lo, hi in steps(ends, 100_000):
                part = batch.slice(lo, hi - lo)
                hashes, of, k, at = _unpacked(part.column("packed"), total[lo:hi], window)
                pick = pa.array(of)
                cols = [part.column("doc_id").take(pick), part.column("row_key").take(pick), pa.array((part.column("start").to_numpy()[of] + k).astype(np.int32))]
                cols += [pa.array(as_signed(sequences(hashes, at, at + window, b))) for b in BASES]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row_key", "at", "w1", "w2"])

    return run


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, span: int = SPAN, crowd: int = CROWD) -> DataFrame:
    """doc_id, row_key (row_key() of the text), ranges: array of (start, n), the windows of the document that go."""
    if not 0 < gram <= window:
        raise ValueError("gram must be between 1 and window")
    slim = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), F.col("text").cast("string").alias("text"))
    runs = keep(slim.mapInArrow(_runs(window, gram, span), "doc_id long, row_key long, start int, n int, mini long, h1 long, h2 long"), "super-kmers", "zstd")
    same = ["mini", "h1", "h2"]
    firsts = runs.groupBy(*same).agg(F.min("doc_id").alias("first"))
    placed = keep(runs.join(firsts, same).select("doc_id", "row_key", "start", "n", "mini", (F.col("doc_id") > F.col("first")).alias("whole")), "super-kmers-placed", "zstd")
    whole = placed.where("whole").select("doc_id", "row_key", "start", "n")
    first = placed.where("not whole").drop("whole").distinct()
    contested = first.groupBy("mini").agg(F.count("*").alias("_n"), F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi")).where("_lo < _hi").select("mini", (F.col("_n") > crowd).alias("crowded"))
    some = first.join(contested, "mini").groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("start", "n", "mini", "crowded")).alias("runs"))  # at most the words of a text
    texts = slim.dropDuplicates(["doc_id", "row_key"])
    packed = texts.join(some, ["doc_id", "row_key"]).select("doc_id", "row_key", "text", "runs").mapInArrow(_packed(window), "doc_id long, row_key long, start int, n int, mini long, crowded boolean, packed binary")
    packed = keep(packed, "super-kmers-packed")

    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-kept_bytes(packed) // TASK))
    ranges = "doc_id long, row_key long, start int, n int"
    sorted_buckets = packed.where("not crowded").drop("crowded").repartition(tasks, "mini").sortWithinPartitions("mini")
    out = whole.unionByName(sorted_buckets.mapInArrow(_buckets(window, SLAB), ranges))
    crowded = packed.where("crowded")
    if not crowded.isEmpty():
        each = crowded.select("doc_id", "row_key", "start", "n", "packed").mapInArrow(_windows(window), "doc_id long, row_key long, at int, w1 long, w2 long")
        low = each.groupBy("w1", "w2").agg(F.min("doc_id").alias("_first"))
        out = out.unionByName(each.join(low, ["w1", "w2"]).where("doc_id > _first").select("doc_id", "row_key", F.col("at").alias("start"), F.lit(1).cast("int").alias("n")))
    return out.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("start", "n")).alias("ranges"))


def _kept(window: int):
    """row, text, ranges -> row, n_words, n_removed, kept."""

    def run(batches):
        for batch in batches:
            texts, ranges = batch.column("_text"), batch.column("_ranges")
            rows: list[tuple[int, int, bytes]] = []
            begun, size = 0, 0

            def out(end, begun, rows):
                cols = [batch.column("row").slice(begun, end - begun), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())]
                return pa.RecordBatch.from_arrays(cols, ["row", "n_words", "n_removed", "kept"])

            for k in range(batch.num_rows):
                own = texts[k].as_buffer().to_pybytes().split() if texts[k].is_valid else []
                if ranges[k].is_valid:
                    edges = np.zeros(len(own) + 1, np.int32)
                    start, n = (ranges[k].values.field(c).to_numpy() for c in ("start", "n"))
                    np.add.at(edges, start, 1)
                    np.add.at(edges, start + n + window - 1, -1)
                    stays = np.cumsum(edges[:-1]) == 0
                    kept = b" ".join(compress(own, stays.tolist()))
                    rows.append((len(own), len(own) - int(stays.sum()), kept))
                else:
                    kept = b" ".join(own)
                    rows.append((len(own), 0, kept))
                size += len(kept)
                if size > 1 << 24:
                    yield out(k + 1, begun, rows)
                    rows, begun, size = [], k + 1, 0
            if rows:
                yield out(batch.num_rows, begun, rows)

    return run


def deduplicated(docs: DataFrame, window: int = WINDOW, carry: list[str] | None = None, **how) -> DataFrame:
    """n_words, n_removed and kept (the words that stay, joined by one space) of every row, and docs' columns as the struct `row`.

    carry: the columns that `row` holds (all of docs, if not given).
    """
    found = repeated(docs, window, **how).select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), F.col("ranges").alias("_ranges"))
    row = F.struct(*[F.col(quoted(c)) for c in (docs.columns if carry is None else carry)])
    slim = docs.select(row.alias("row"), F.col("text").cast("string").alias("_text"), F.col("doc_id").cast("long").alias("_doc"), row_key().alias("_row_key"))
    met = slim.join(found, (F.col("_doc") == F.col("_id")) & (F.col("_row_key") == F.col("_key")), "left").select("row", "_text", "_ranges")
    more = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.StringType())]
    return met.mapInArrow(_kept(window), T.StructType([slim.schema["row"], *[T.StructField(c, t) for c, t in more]]))


def query(spark, sf_dir):
    out = deduplicated(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS said FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
first AS (SELECT said, min(doc_id) AS doc FROM windows GROUP BY said),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM windows JOIN first USING (said) WHERE first.doc < doc_id),
lost AS (SELECT doc_id, list(i) AS lost FROM gone GROUP BY doc_id),
left_over AS (
  SELECT doc_id, w, coalesce(len(lost), 0) AS n, CASE WHEN lost IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(lost, i)) END AS kept FROM words LEFT JOIN lost USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, n::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM left_over
"""
