"""Sharding by balanced label propagation over a graph of linked documents, under the law `rows`.

Documents link through the least hashes of their 5-word shingles; a link is never written out as a pair, it is a row
(unit, feature), where a unit is the set of documents with one text. Each round a unit asks how the units that share
its features lie over the shards (features weigh by one over their size) and wishes to move to the best shard. The
wishes of each pair of shards are summed by gain, and only as many rows move, best gains first, as come back the other
way or as the receiving shard lacks: a capacity quota. After the rounds the rows beyond a shard's share, at the end of
its order, fill what others lack, so that counts differ by one at most. A shard's order keeps the rows of a unit
together; slots number it without gaps.

A unit may hold any share of all rows: its rows are spread over tasks by a hash of the row's number in the table, so rows
without doc_id or with one and the same are spread as well, and over shards only by the final filling. Null and empty
texts are one unit without features; texts of fewer than five words link by equality alone. Very long texts are read
whole, as a step of their own. Equal rows get different slots, ties in a shard's order go by hash. An empty table gives
no rows. sharded() gives all columns back as they are, whatever their names: if shard or slot is taken, the new column is
shard_2 or slot_2, and so on. The rows must come in an order that reading them again repeats, as those of a table do.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_signed, discard, flat, keep, lower_ascii, mix, quoted, span_hashes, steps, table, text_or_empty, words

FEATURES, LINE, ROUNDS = 6, 1024, 4
BINS = 16
#: Units of over one in HOT of all rows are joined in parts; there are at most HOT of them. Lanes that one task adds up.
HOT, STRETCH = 1000, 1024


def _sketch(batches):
    low = lower_ascii()
    for batch in batches:
        data, offsets = flat(batch.column(2))
        crc = np.array([zlib.crc32(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], np.int64)
        features = []
        for lo, hi in steps(offsets):
            part = offsets[lo : hi + 1]
            piece, part = low[data[part[0] : part[-1]]], part - part[0]
            at, end, own = words(piece, part)
            h = span_hashes(piece, at, end)
            k = 5
            if len(h) >= k:
                run = h[: len(h) - k + 1].copy()
                for j in range(1, k):
                    run = mix(run + h[j : len(h) - k + 1 + j])
                who = own[: len(run)]
                inside = who == own[k - 1 :]
                run, who = run[inside], who[inside]
            else:
                run, who = h[:0], own[:0]
            order = np.lexsort((run, who))
            run, who = run[order], who[order]
            new = np.ones(len(run), bool)
            new[1:] = (run[1:] != run[:-1]) | (who[1:] != who[:-1])
            run, who = run[new], who[new]
            least = np.arange(len(who)) - np.searchsorted(who, who) < FEATURES
            run, who = run[least], who[least]
            features += np.split(as_signed(run), np.searchsorted(who, np.arange(1, hi - lo))) if hi > lo else []
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets) + 1), pa.array(crc), pa.array(features, pa.list_(pa.int64()))], ["doc_id", "unit", "size", "text_crc32", "features"])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, unit (hash of the text), size, text_crc32, features of every row."""
    slim = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_or_empty()).alias("unit"), F.col("text").cast("string"))
    return slim.mapInArrow(_sketch, "doc_id long, unit long, size long, text_crc32 long, features array<long>")


def _quotas(wishes: list, size: list[int], share: float, slack: float) -> dict[tuple[int, int], tuple[int, float, int]]:
    """For each pair of shards the gain bin above which all may move, the share of the bin at it, and the rows that may
    move in all, which no unit may exceed.

    What may move from a to b: what wishes to come from b to a, and what b lacks to its capacity.
    """
    wish: dict[tuple[int, int], dict[int, int]] = {}
    for a, b, g, n in wishes:
        wish.setdefault((a, b), {})[g] = n
    every = {k: sum(v.values()) for k, v in wish.items()}
    room = {b: max(0.0, share * (1 + slack) - n) for b, n in enumerate(size)}
    out = {}
    for (a, b), bins in wish.items():
        come = sum(n for (x, y), n in every.items() if y == b)
        may = min(every[a, b], every.get((b, a), 0) + room[b] * every[a, b] / max(come, 1))
        edge, part, quota = BINS, 0.0, int(may)
        for g in sorted(bins, reverse=True):
            if bins[g] <= may:
                may -= bins[g]
                edge, part = g, 1.0
            else:
                edge, part = g, may / bins[g]
                break
        out[a, b] = (edge, part, quota)
    return out


def labels(rows: DataFrame, shards: int, rounds: int = ROUNDS, slack: float = 0.03) -> DataFrame:
    """unit, n, shard: balanced label propagation over units; rows is a kept table of sketches."""
    units = rows.groupBy("unit").agg(F.count("*").alias("n"), F.min("features").alias("features"))
    units = keep(units, "units")
    total = units.agg(F.sum("n")).first()[0] or 0
    share = max(total / shards, 1.0)
    pairs = units.select("unit", "n", F.explode("features").alias("feature"))
    degree = pairs.groupBy("feature").agg(F.count("*").alias("units"), F.min("unit").alias("first")).where("units > 1")
    degree = keep(degree, "features")
    links = keep(pairs.join(degree.withColumnRenamed("feature", "f"), pairs.feature == F.col("f")).select("unit", "n", "feature", "first", (1 / F.col("units")).alias("weight")), "links")
    # linked units begin where their least common partner does
    start = links.groupBy("unit").agg(F.min("first").alias("first")).withColumnRenamed("unit", "u")
    now = units.join(start, units.unit == start.u, "left").select("unit", "n", F.pmod(F.xxhash64(F.coalesce("first", "unit")), F.lit(shards)).cast("int").alias("shard"))
    now = keep(now, "labels")
    for turn in range(rounds):
        size = [0] * shards
        for s, n in now.groupBy("shard").agg(F.sum("n")).collect():  # one row a shard
            size[s] = n
        placed = links.join(now.select(F.col("unit").alias("u"), "shard"), links.unit == F.col("u")).drop("u")
        lie = placed.groupBy("feature").agg(*[F.sum(F.when(F.col("shard") == s, F.col("n") * F.col("weight")).otherwise(0.0)).alias(f"h{s}") for s in range(shards)])
        lie = keep(lie.withColumnRenamed("feature", "f"), "lie")
        seen = placed.join(lie, placed.feature == lie.f)
        own = F.col("n") * F.col("weight")
        pull = seen.groupBy("unit", "n", "shard").agg(*[F.sum(F.col(f"h{s}") - F.when(F.col("shard") == s, own).otherwise(0.0)).alias(f"p{s}") for s in range(shards)])
        best = F.greatest(*[F.col(f"p{s}") for s in range(shards)]) if shards > 1 else F.col("p0")
        here = F.coalesce(*[F.when(F.col("shard") == s, F.col(f"p{s}")) for s in range(shards)])
        goal = F.coalesce(*[F.when(F.col(f"p{s}") >= best, F.lit(s)) for s in range(shards)])
        gain = (best - here) / (best + F.lit(1e-9))
        want = keep(pull.where(gain > 1e-6).select("unit", "n", "shard", goal.alias("goal"), F.least(F.floor(gain * BINS), F.lit(BINS - 1)).cast("int").alias("bin")), "wishes")
        wishes = [tuple(r) for r in want.groupBy("shard", "goal", "bin").agg(F.sum("n")).collect()]  # at most shards ** 2 * BINS rows
        allowed = _quotas(wishes, size, share, slack)
        if not allowed:
            break
        luck = F.pmod(F.xxhash64("unit", F.lit(turn)), F.lit(1_000_000)) / 1e6
        goes = F.lit(False)
        for (a, b), (edge, part, quota) in allowed.items():
            goes = goes | ((F.col("shard") == a) & (F.col("goal") == b) & (F.col("n") <= quota) & ((F.col("bin") > edge) | ((F.col("bin") == edge) & (luck < part))))
        moved = want.where(goes).select(F.col("unit").alias("u"), "goal")
        then = keep(now.join(moved, now.unit == moved.u, "left").select("unit", "n", F.coalesce("goal", "shard").alias("shard")), "labels")
        for old in (now, lie, want):
            discard(rows.sparkSession, old.kept_at)
        now = then
    return now


def with_units(rows: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """rows (unit, number, ...) with _n and _label of their unit. Units of over total / HOT rows meet theirs in parts."""
    large = found.where(F.col("n") > total / HOT).select(F.col("unit").alias("u1"), F.ceil(F.col("n") * HOT / F.lit(max(total, 1))).cast("int").alias("_pieces"))
    dealt = rows.join(F.broadcast(large), rows.unit == F.col("u1"), "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64("number"), F.col("_pieces")).cast("int"), F.lit(0))).drop("u1", "_pieces")  # bound: HOT rows
    pieces = F.when(F.col("n") > total / HOT, F.sequence(F.lit(0), F.ceil(F.col("n") * HOT / F.lit(max(total, 1))).cast("int") - 1)).otherwise(F.array(F.lit(0)))
    f = found.select(F.col("unit").alias("u2"), F.col("n").alias("_n"), F.col("shard").alias("_label"), F.explode(pieces).alias("p2"))
    return dealt.join(f, (F.col("unit") == F.col("u2")) & (F.col("_piece") == F.col("p2"))).drop("u2", "p2", "_piece")


def placed(rows: DataFrame, found: DataFrame, shards: int) -> DataFrame:
    """rows (unit, doc_id, number and any other columns) with _shard and _slot: counts differ by one at most, slots have no gaps."""
    total = found.agg(F.sum("n")).first()[0] or 0
    lanes = max(64, total // 2000)
    lane = F.pmod(F.xxhash64("unit"), F.lit(lanes))
    part = F.when(F.col("_n") <= LINE, F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("number", F.lit(7)), F.ceil(F.col("_n") / F.lit(LINE))))
    met = with_units(rows, found, total).withColumn("_lane", lane).withColumn("_part", part.cast("long"))
    # how many rows each lane has, known from the units but for those in parts
    small = found.where(F.col("n") <= LINE).groupBy(F.col("shard").alias("_label"), lane.alias("_lane")).agg(F.sum("n").alias("_m")).select("_label", "_lane", F.lit(0).cast("long").alias("_part"), F.lit(None).cast("long").alias("_u"), "_m")
    many = with_units(rows.select("unit", "number"), found, total).withColumn("_lane", lane).withColumn("_part", part.cast("long"))
    large = many.where(F.col("_part") > 0).groupBy("_label", "_lane", "_part", F.col("unit").alias("_u")).agg(F.count("*").alias("_m"))
    lanes_of = keep(small.unionByName(large).withColumn("_stretch", F.floor(F.col("_lane") / STRETCH)), "lanes")
    # the rows before each stretch of lanes, then before each lane and part in it
    upto = lambda key, *order: Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    stretch = lanes_of.groupBy(F.col("_label").alias("s1"), F.col("_stretch").alias("s2")).agg(F.sum("_m").alias("_all"))
    stretch = stretch.select("s1", "s2", F.coalesce(F.sum("_all").over(upto(["s1"], "s2")), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_m").over(upto(["_label", "_stretch"], "_lane", "_part", "_u")), F.lit(0))
    begin = lanes_of.withColumn("_inside", inside).join(stretch, (F.col("_label") == F.col("s1")) & (F.col("_stretch") == F.col("s2")))
    begin = begin.select(F.col("_label").alias("l1"), F.col("_lane").alias("l2"), F.col("_part").alias("l3"), F.col("_u").alias("l4"), (F.col("_before") + F.col("_inside")).alias("_begin"))
    met = met.withColumn("_pu", F.when(F.col("_part") > 0, F.col("unit")))
    within = Window.partitionBy("_label", "_lane", "_part", "_pu").orderBy("unit", "doc_id", "number")
    met = met.withColumn("_at", F.row_number().over(within) - 1)
    met = met.join(begin, (met._label == begin.l1) & (met._lane == begin.l2) & (met._part == begin.l3) & met._pu.eqNullSafe(begin.l4))
    place = F.col("_begin") + F.col("_at")
    size = [0] * shards
    for s, n in lanes_of.groupBy("_label").agg(F.sum("_m")).collect():  # one row a shard
        size[s] = n
    fair = [total // shards + (s < total % shards) for s in range(shards)]
    at = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("_label") + 1)
    spare = [max(0, n - m) for n, m in zip(size, fair)]
    lack = [max(0, m - n) for n, m in zip(size, fair)]
    before = [sum(spare[:s]) for s in range(shards)]
    over = at(before) + place - at(fair)  # the number of the row among all that are to move
    shard, slot, upto = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(shards):
        here = (over >= upto) & (over < upto + lack[s])
        shard = F.when(here, F.lit(s)).otherwise(shard)
        slot = F.when(here, over - upto + size[s]).otherwise(slot)
        upto += lack[s]
    stays = place < at(fair)
    out = met.withColumn("_shard", F.when(stays, F.col("_label")).otherwise(shard).cast("int")).withColumn("_slot", F.when(stays, place).otherwise(slot).cast("long"))
    return out.drop("_n", "_label", "_lane", "_part", "_pu", "_at", "_begin", "l1", "l2", "l3", "l4")


def assign(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, unit, size, text_crc32, shard, slot of every row."""
    rows = keep(sketches(docs).withColumn("number", F.monotonically_increasing_id()), "sketches")
    out = placed(rows.drop("features"), labels(rows, shards), shards)
    return out.select("doc_id", "unit", "size", "text_crc32", F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs with shard and slot; all columns stay."""
    found = labels(keep(sketches(docs), "sketches"), shards)
    # the numbers are read twice and must be the same
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("unit"), F.monotonically_increasing_id().alias("number"))
    out = placed(keep(rows, "numbered"), found, shards)
    free = lambda name: next(n for n in (name, *(f"{name}_{k}" for k in range(2, 2 + len(docs.columns) + 1))) if n not in docs.columns)
    return out.select("row.*", F.col("_shard").alias(free("shard")), F.col("_slot").alias(free("slot")))


def query(spark, sf_dir):
    out = assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("unit").alias("text_group"))
