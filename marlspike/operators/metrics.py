"""Retrieval metrics and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..store import settled

# The quality gate.
THRESHOLDS = {"search_recall_at_5": 1.0, "search_mrr": 0.75, "context_required_recall": 1.0, "context_precision": 1.0, "candidate_precision": 1.0, "candidate_recall": 1.0, "candidate_type_accuracy": 1.0}


def half_up(c: Column) -> Column:
    return F.floor(F.round(c * 1000, 6) + 0.5) / 1000


def fraction(part: Column, whole: Column) -> Column:
    """part / whole to three places; nothing of nothing is all of it."""
    return F.when(whole == 0, F.lit(1.0)).otherwise(half_up(part / whole))


def retrieval(ranks: DataFrame) -> DataFrame:
    """ranks: one row a case, rank null if not found. One row: cases, recall_at_1, recall_at_5, mrr."""
    n = F.count("*")
    at = lambda k: fraction(F.count_if(F.col("rank") <= k), n)
    return ranks.agg(n.alias("cases"), at(1).alias("recall_at_1"), at(5).alias("recall_at_5"), F.when(n == 0, F.lit(0.0)).otherwise(half_up(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))))).alias("mrr"))


def first_ranks(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """hits: query_id, id, rank; truth: query_id, id. Each query of truth with the rank of its first right hit."""
    met = truth.join(hits, ["query_id", "id"], "left")
    return met.groupBy("query_id").agg(F.min("rank").alias("rank"))


#: Splitters of a round of selection, the error of their ranks (one in so many), and how many rows one task may sort at the end.
SPLITTERS, ACCURACY, FEW = 256, 10_000, 100_000


def percentiles(values: DataFrame, column: str, by: list[str], at: list[float], few: int = FEW) -> DataFrame:
    """Nearest-rank percentiles by selection: by, n (all rows), p50, ... (null for a group without values).

    A round takes approximate quantiles of what is left of a group, a sketch that combines before its shuffle, puts two of
    them around the rank and counts exactly what lies below, at and between them. That is the answer or a range of about a
    hundredth of the rows, until `few` are left, which are sorted. So no group is ever gathered in one task, ties included.
    """
    keys = [F.col(c) for c in by]
    rows = values.select(*by, F.col(column).alias("_v"))
    sized = settled(rows.groupBy(*by).agg(F.count("*").alias("n"), F.count("_v").alias("_m")))
    asked = sized.where("_m > 0").withColumn("_p", F.explode(F.array(*map(F.lit, at))))
    none = F.lit(None).cast(rows.schema["_v"].dataType)
    state = asked.select(*by, "_p", F.greatest(F.lit(1), F.ceil(F.col("_p") * F.col("_m"))).cast("long").alias("_k"), F.col("_m"), none.alias("_lo"), none.alias("_hi"), none.alias("_got"))
    names = [f"_b{i}" for i in range(len(by))]

    def inside(some: DataFrame) -> DataFrame:
        """The values of the open ranges (both ends excluded) of some states."""
        s = some.select(*[k.alias(n) for k, n in zip(keys, names)], "_p", "_k", "_m", "_lo", "_hi")
        on = F.lit(True)
        for c, n in zip(by, names):
            on = on & F.col(c).eqNullSafe(F.col(n))
        met = rows.where("_v is not null").join(s, on)
        return met.where((F.col("_lo").isNull() | (F.col("_v") > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") < F.col("_hi"))))

    done = None
    while True:
        state = settled(state)
        found = state.where(f"_got is not null or _m <= {few}")
        done = found if done is None else done.unionByName(found)
        open_ = state.where(f"_got is null and _m > {few}")
        if open_.isEmpty():
            break
        parts = [k / SPLITTERS for k in range(SPLITTERS + 1)]
        own = [*names, "_p", "_k", "_m", "_lo", "_hi"]
        cut = inside(open_).groupBy(*own).agg(F.percentile_approx("_v", parts, ACCURACY).alias("_s"))
        nth = F.floor(F.col("_k") * SPLITTERS / F.col("_m")).cast("int")
        a, b = F.get("_s", F.greatest(nth - 2, F.lit(0))), F.get("_s", F.least(nth + 2, F.lit(SPLITTERS)))
        cut = settled(cut.select(*own, a.alias("_a"), b.alias("_b")))
        two = cut.select(*[F.col(n).alias(c) for c, n in zip(by, names)], "_p", "_k", "_m", "_lo", "_hi")
        ends = cut.select(*[F.col(n).alias(f"{n}x") for n in names], F.col("_p").alias("_px"), "_a", "_b")
        on = F.col("_p") == F.col("_px")
        for n in names:
            on = on & F.col(n).eqNullSafe(F.col(f"{n}x"))
        v, lo, hi = F.col("_v"), F.col("_a"), F.col("_b")
        counts = inside(two).join(ends, on).groupBy(*own, "_a", "_b").agg(F.count_if(v < lo).alias("_below"), F.count_if(v == lo).alias("_at"), F.count_if((v > lo) & (v < hi)).alias("_in"), F.count_if((v == hi) & (hi != lo)).alias("_end"))
        k, below, low, mid = F.col("_k"), F.col("_below"), F.col("_at"), F.col("_in")
        where = F.when(k <= below, 0).when(k <= below + low, 1).when(k <= below + low + mid, 2).when(k <= below + low + mid + F.col("_end"), 3).otherwise(4)
        w = F.col("_w")
        state = counts.withColumn("_w", where).select(
            *[F.col(n).alias(c) for c, n in zip(by, names)], "_p",
            F.when(w == 0, k).when(w == 2, k - below - low).when(w == 4, k - below - low - mid - F.col("_end")).otherwise(k).alias("_k"),
            F.when(w == 0, below).when(w == 2, mid).when(w == 4, F.col("_m") - below - low - mid - F.col("_end")).otherwise(F.col("_m")).alias("_m"),
            F.when(w == 2, lo).when(w == 4, hi).otherwise(F.col("_lo")).alias("_lo"), F.when(w == 0, lo).when(w == 2, hi).otherwise(F.col("_hi")).alias("_hi"),
            F.when(w == 1, lo).when(w == 3, hi).alias("_got"),
        )
    order = Window.partitionBy(*names, "_p").orderBy("_v")
    last = inside(done.where("_got is null")).withColumn("_rn", F.row_number().over(order)).where("_rn = _k").select(*[F.col(n).alias(c) for c, n in zip(by, names)], "_p", F.col("_v").alias("_got"))
    got = done.where("_got is not null").select(*by, "_p", "_got").unionByName(last)
    each = got.groupBy(*by).agg(*[F.max(F.when(F.col("_p") == p, F.col("_got"))).alias(f"p{round(p * 100)}") for p in at])
    each = each.select(*[F.col(c).alias(n) for c, n in zip(by, names)], *[f"p{round(p * 100)}" for p in at])
    on = F.lit(True)
    for c, n in zip(by, names):
        on = on & F.col(c).eqNullSafe(F.col(n))
    return sized.join(each, on, "left").select(*by, "n", *[f"p{round(p * 100)}" for p in at])


def passes(metrics: dict[str, float], budget_respected: bool = True, thresholds: dict[str, float] = THRESHOLDS) -> bool:
    return budget_respected and all(metrics[k] >= v for k, v in thresholds.items())
