"""SimHash near-duplicates: fingerprints of 3-word shingles, linked by a Gray-order hierarchical index.

fingerprints() gives one 64-bit fingerprint a row. links() finds all pairs of distinct fingerprints that differ in
at most 3 bits: the 64 bits are cut into five blocks, two fingerprints within 3 bits agree on at least two blocks,
so ten keys (one for each pair of blocks) bring every such pair together in some bucket. A bucket's fingerprints
are sorted by Gray rank and indexed from the leaves up; an upper node holds the bits that all below it share, as a
mask and a pattern. Pairs of nodes are descended together; the differences in the shared bits add up on the way
down and a pair of nodes is dropped, with all below it, once they exceed 3.

A bucket of more than CHUNK fingerprints is keyed again by the same rule: the bits that its key leaves open are cut into
five blocks, and so on until buckets are small or at most FEW bits are open (2 ** FEW fingerprints at most). So a
fingerprint is written ten times a level, however many stand near it, no task holds more than a slab of buckets, and
nothing is capped.

Null text counts as empty; a text without words has fingerprint zero. Equal rows share a fingerprint. Very long texts are
hashed whole. Rows without doc_id link like any other. An empty table gives no rows. Columns other than doc_id and text
are ignored by near_duplicates(); keep_one() gives them back as they are, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_signed, by_row_key, keep, mix, quoted, row_key
from .graph import components

BITS = 3
BLOCKS = 5
#: Larger buckets are keyed again, unless so few bits are open; rows that one step indexes, and about those of a task.
CHUNK, FEW, SLAB, TASK = 512, 8, 200_000, 1_000_000
FAN = 8


def fingerprint(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of consecutive runs of hashes (counts: their lengths): each bit that is set in over half of a run."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    begin = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
    # sums of bits, by byte planes: eight bits at a time spread over the eight bytes of a word
    step = np.uint64(0x0101010101010101)
    twice = np.zeros((len(full), 64), np.int64)
    for k in range(8):
        plane = (hashes >> np.uint64(k)) & step  # byte j holds bit 8 * j + k
        got = np.add.reduceat(plane.view(np.uint8).reshape(-1, 8), begin, axis=0, dtype=np.int64)
        twice[:, k::8] = 2 * got
    bits = twice > counts[full][:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def shingle_hashes(text: str) -> list[int]:
    import xxhash

    h = xxhash.xxh64_intdigest
    found = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space alone
    if len(found) < 3:
        return [h(b" ".join(found), 42)] if found else []
    line = b" ".join(found)
    ends, at = [], -1
    for w in found:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    return [h(line[a:b], 42) for a, b in zip(starts, ends[2:])]


def _fingerprints(batches):
    """doc_id, row_key, text -> doc_id, row_key, fp."""
    for batch in batches:
        texts = batch.column(2).fill_null("")
        out, part, sizes, held = [], [], [], 0
        for t in texts:
            got = shingle_hashes(t.as_py())
            part.append(np.array(got, np.uint64))
            sizes.append(len(got))
            held += len(got)
            if held > 200_000:
                out.append(fingerprint(np.concatenate(part), np.array(sizes)))
                part, sizes, held = [], [], 0
        if sizes:
            out.append(fingerprint(np.concatenate(part), np.array(sizes)))
        fp = as_signed(np.concatenate(out)) if out else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], ["doc_id", "row_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (a hash of the text), fp (the 64 bits as a signed long) of every row."""
    return docs.select(F.col("doc_id").cast("long"), row_key().alias("row_key"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, row_key long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a code in Gray order: each bit is the parity of the bits from the top down to it."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _expand(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n: owner and running number of each of sum(n) items."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


class GrayIndex:
    """Levels of nodes over codes sorted by (bucket, Gray rank); level 0 has the codes, the last one node a bucket."""

    def __init__(self, bucket: np.ndarray, codes: np.ndarray):
        order = np.lexsort((gray_rank(codes), bucket))
        self.order, ones = order, np.uint64(0xFFFFFFFFFFFFFFFF)
        group, pattern = bucket[order], codes[order]
        mask = np.full(len(codes), ones)
        self.levels = [(mask, pattern, None, None, group)]
        while len(group) and np.any(group[1:] == group[:-1]):
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            inside = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
            cut = np.flatnonzero(inside % FAN == 0)
            count = np.diff(np.append(cut, len(group)))
            every, some = np.bitwise_and.reduceat(pattern, cut), np.bitwise_or.reduceat(pattern, cut)
            shared = np.bitwise_and.reduceat(mask, cut) & ~(every ^ some)
            mask, pattern, group = shared, every & shared, group[cut]
            self.levels.append((mask, pattern, cut, count, group))

    def pairs(self, most: int, slab: int = 400_000):
        """Yields arrays (i, j) of places in the given arrays whose codes differ in at most `most` bits, i and j apart."""
        mask, pattern, _, _, _ = self.levels[-1]
        n = len(mask)
        seed = np.arange(n)
        stack = [(len(self.levels) - 1, seed, seed, np.zeros(n, np.int64), np.zeros(n, np.uint64))]
        while stack:
            level, a, b, acc, seen = stack.pop()
            if not len(a):
                continue
            if len(a) > slab // FAN and level:
                for k in range(0, len(a), slab // FAN):
                    s = slice(k, k + slab // FAN)
                    stack.append((level, a[s], b[s], acc[s], seen[s]))
                if len(a) > slab // FAN:
                    continue
            if level == 0:
                yield self.order[a], self.order[b]
                continue
            cut, count = self.levels[level][2:4]
            mask, pattern = self.levels[level - 1][:2]
            own, k = _expand(count[a] * count[b])
            ca, cb = cut[a][own] + k // count[b][own], cut[b][own] + k % count[b][own]
            last = level == 1
            ok = (a[own] != b[own]) | ((ca < cb) if last else (ca <= cb))
            own, ca, cb = own[ok], ca[ok], cb[ok]
            common = mask[ca] & mask[cb]
            fresh = common & ~seen[own]  # bits that the upper nodes did not settle
            total = acc[own] + np.bitwise_count((pattern[ca] ^ pattern[cb]) & fresh)
            ok = total <= most
            stack.append((level - 1, ca[ok], cb[ok], total[ok], common[ok]))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of the component of each of n items that links (i, j) join."""
    root = np.arange(n)
    while len(i):
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        np.minimum.at(root, high, low)
        while np.any((up := root[root]) != root):
            root = up
        live = root[i] != root[j]
        i, j = i[live], j[live]
    return root


def _tied(key: np.ndarray, node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    """Star edges between nodes of a bucket whose fingerprints link; keys are sorted and their buckets whole."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, len(key)))
    more = np.repeat(size > 1, size)
    key, node, fp = key[more], node[more], fp[more]
    got_i, got_j, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for i, j in GrayIndex(key, fp.view(np.uint64)).pairs(BITS) if len(key) else ():
        got_i.append(i)
        got_j.append(j)
        held += len(i)
        if held > 2_000_000:  # only the forest matters
            root = forest(len(key), np.concatenate(got_i), np.concatenate(got_j))
            tied = np.flatnonzero(root != np.arange(len(key)))
            got_i, got_j, held = [tied], [root[tied]], 0
    root = forest(len(key), np.concatenate(got_i), np.concatenate(got_j))
    tied = np.flatnonzero(root != np.arange(len(key)))
    return pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(node[root[tied]])], ["a", "b"])


def _join_batches(batches):
    """Rows (key, node, fp) sorted by key; holds a slab of whole buckets at a time."""
    held, size = [], 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size >= SLAB:
            key, node, fp = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
            if cut:
                yield _tied(key[:cut], node[:cut], fp[:cut])
            held, size = [[key[cut:], node[cut:], fp[cut:]]], len(key) - cut
    if size:
        yield _tied(*(np.concatenate(x) for x in zip(*held)))


PAIRS = list(combinations(range(BLOCKS), 2))


def open_bits(path: int) -> tuple[int, ...]:
    """The bits that a path of block pairs leaves open; path: 1 and a digit for each level."""
    bits = tuple(range(64))
    for digit in str(path)[1:]:
        chosen = PAIRS[int(digit)]
        bits = tuple(b for k, block in enumerate(np.array_split(bits, BLOCKS)) if k not in chosen for b in block.tolist())
    return bits


#: The levels after which more than FEW bits are open, whatever the path.
LEVELS = next(k for k in range(1, 18) if max(len(open_bits(int("1" + d * k))) for d in "0123456789") <= FEW)


def _keys(batches):
    """(path, node, fp) to ten rows (key, path, node, fp), one for each pair of blocks of the open bits."""
    for batch in batches:
        path, node, fp = (c.to_numpy() for c in batch.columns)
        out = []
        for p in np.unique(path).tolist():
            at = path == p
            kept = np.uint64((1 << 64) - 1) ^ np.uint64(sum(1 << b for b in open_bits(p)))
            blocks = [np.uint64(sum(1 << int(b) for b in block)) for block in np.array_split(open_bits(p), BLOCKS)]
            for k, (x, y) in enumerate(PAIRS):
                new = 10 * p + k
                agreed = fp[at].view(np.uint64) & (kept | blocks[x] | blocks[y])
                out.append((as_signed(mix(agreed ^ mix(np.full(len(agreed), new, np.uint64)))), np.full(len(agreed), new), node[at], fp[at]))
        cols = [np.concatenate(c) for c in zip(*out)] or [np.zeros(0, np.int64)] * 4
        yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["key", "path", "node", "fp"])


def links(distinct: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """distinct: node, fp with each fp once. Returns edges a, b that join exactly the components of all links."""
    rows = distinct.select(F.lit(1).cast("long").alias("path"), "node", "fp")
    total, small = distinct.count() * len(PAIRS), None
    while True:
        keyed = rows.mapInArrow(_keys, "key long, path long, node long, fp long")
        hot = keyed.groupBy("key", "path").count().where((F.col("count") > chunk) & (F.length(F.col("path").cast("string")) <= LEVELS)).select(F.col("key").alias("hot_key"))
        hot = keep(hot, "hot-buckets")
        if hot.isEmpty():
            cool, rows = keyed, None
        else:
            cool = keyed.join(hot, keyed.key == hot.hot_key, "left_anti")
            rows = keep(keyed.join(hot, keyed.key == hot.hot_key, "left_semi").select("path", "node", "fp"), "crowded")
        small = cool.select("key", "node", "fp") if small is None else small.unionByName(cool.select("key", "node", "fp"))
        if rows is None:
            break
        total += rows.count() * len(PAIRS)
    n = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK))
    return small.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_join_batches, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, with_key: bool = False) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (smallest doc_id reachable over links), of every row; with_key: row_key too.

    A row without doc_id links like any other; component_id is null where no doc_id is reachable.
    """
    prints = keep(fingerprints(docs), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    distinct = keep(distinct, "distinct-fingerprints")
    if distinct.where("node is null").isEmpty():
        found = components(links(distinct))
        classes = distinct.join(found, distinct.node == found.v, "left").select(F.col("fp").alias("of"), F.coalesce("component", "node").alias("component_id"))
    else:  # the fingerprints themselves name the nodes, and each component takes its least doc_id at the end
        found = components(links(distinct.select(F.col("fp").alias("node"), "fp")))
        of = keep(distinct.join(found, distinct.fp == found.v, "left").select(F.col("fp").alias("of"), "node", F.coalesce("component", "fp").alias("part")), "parts")
        least = of.groupBy(F.col("part").alias("whole")).agg(F.min("node").alias("component_id"))
        classes = of.join(least, of.part == least.whole).select("of", "component_id")
    classes = keep(classes, "classes")
    return prints.join(classes, prints.fp == classes.of, "left").select("doc_id", *["row_key"][: with_key], F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component stays: of those with its smallest doc_id that the one whose text's hash is least; of rows
    that share both, the one with the least hash of all columns.

    Rows that share a doc_id but not a text are judged each by its own component. Rows without doc_id cannot name a
    component's document; they stay.
    """
    known = docs.where("doc_id is not null")
    found = keep(near_duplicates(known, with_key=True).where("doc_id = component_id").groupBy("doc_id", "row_key").agg(F.first("component_id").alias("component"), F.count("*").alias("n_rows")), "heads")
    heads = keep(found.groupBy("component").agg(F.min_by(F.struct(F.col("doc_id").alias("row_id"), "row_key", "n_rows"), "row_key").alias("h")).select("h.*"), "heads")
    one = by_row_key(known, heads.where("n_rows = 1").select("row_id", "row_key"), "left_semi")
    many = heads.where("n_rows > 1").select("row_id", "row_key")
    if not many.isEmpty():
        row = F.struct(*[F.col(quoted(c)) for c in docs.columns])
        same = by_row_key(known, many, "left_semi").select(F.col("doc_id").alias("_d"), row_key().alias("_k"), row.alias("row"))
        one = one.unionByName(same.groupBy("_d", "_k").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*"))
    return one.unionByName(docs.where("doc_id is null"))
