"""Rollups: counts, status tables, file types, portraits, consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """metric, n: one row a table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def status_counts(rows: DataFrame, entity: str) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n")).select(F.lit(entity).alias("entity"), "status", "n")


def file_types(sources: DataFrame, limit: int = 10) -> DataFrame:
    """extension, n, bytes: the most common, then the largest."""
    e = T.extension(F.col("path"))
    rows = sources.groupBy(F.when(e == "", "[no extension]").otherwise(e).alias("extension")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))
    return rows.orderBy(F.desc("n"), F.desc("bytes"), "extension").limit(limit)


def top(rows: DataFrame, section: str, order: list[Column], limit: int) -> DataFrame:
    """section, id: the first `limit` rows of an order (make it total)."""
    return rows.orderBy(*order).limit(limit).select(F.lit(section).alias("section"), F.col("id").cast("string").alias("id"))


def portrait(sources: DataFrame, memories: DataFrame, tasks: DataFrame, candidates: DataFrame) -> DataFrame:
    """section, id of the largest sources, the newest memories, tasks and candidates."""
    newest = [F.desc("updated_at"), F.col("id")]
    parts = [
        top(sources.withColumn("id", F.col("path")), "sources", [F.desc("size_bytes"), F.col("path")], 8),
        top(memories.where("status = 'active'"), "active memories", newest, 6),
        top(memories.where("status = 'stale'"), "stale memories", newest, 6),
        top(tasks.where("status = 'in_progress'"), "active tasks", newest, 6),
        top(tasks.where("status = 'completed'"), "completed tasks", newest, 4),
        top(candidates.where("status = 'pending'"), "pending candidates", [F.desc("created_at"), F.col("id")], 6),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max_by(F.struct(*runs.columns), F.struct("started_at", "id")).alias("run")).where("run is not null").select("run.*")


def guard_counts(memories: DataFrame, tasks: DataFrame, candidates: DataFrame) -> DataFrame:
    """What must be zero before a purge: active memories, tasks in progress, pending candidates."""
    rows = memories.select(F.lit("m").alias("e"), "status").unionByName(tasks.select(F.lit("t").alias("e"), "status")).unionByName(candidates.select(F.lit("c").alias("e"), "status"))
    n = lambda e, s: F.count_if((F.col("e") == e) & (F.col("status") == s))
    return rows.agg(n("m", "active").alias("active_memories"), n("t", "in_progress").alias("tasks_in_progress"), n("c", "pending").alias("pending_candidates"))


#: Bits of a key in a doctor's report: it stands in the entity, in what is derived from it, or is referred to.
CANONICAL, DERIVED, REFERRED = 1, 2, 4


def doctor(pairs: dict[str, tuple[DataFrame, DataFrame]], references: dict[str, tuple[DataFrame, DataFrame]] | None = None) -> DataFrame:
    """name, canonical, derived, missing, orphaned, dangling: how far derived tables lie from their entities, and references
    that lead nowhere.

    pairs: by name, an entity and what is derived from it (an index, files on disk); references: by name, the table that is
    referred to and the references. All are tables of one column, their key; nulls are no keys. Every key becomes a bit,
    the bits of a key come together in one aggregate that combines first, and all names are counted at once.
    """
    marked = None
    for names, (low, high) in ((pairs, (CANONICAL, DERIVED)), (references or {}, (CANONICAL, REFERRED))):
        for name, tables in names.items():
            for df, bit in zip(tables, (low, high)):
                rows = df.select(F.lit(name).alias("name"), df[df.columns[0]].cast("string").alias("_key"), F.lit(bit).alias("_bit"))
                marked = rows if marked is None else marked.unionByName(rows)
    keys = marked.groupBy("name", "_key").agg(F.bit_or("_bit").alias("_m")).where("_key is not null")
    has = lambda bit: F.col("_m").bitwiseAND(bit) > 0
    own, derived, referred = has(CANONICAL), has(DERIVED), has(REFERRED)
    kind = F.col("name").isin(*(references or {"": None}))
    counts = {"canonical": own, "derived": derived, "missing": own & ~derived & ~kind, "orphaned": derived & ~own, "dangling": referred & ~own}
    return keys.groupBy("name").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def consistency(pairs: dict[str, tuple[DataFrame, DataFrame]], key: str = "id") -> DataFrame:
    """name, canonical, derived, missing, orphaned of the keys of some pairs."""
    return doctor({n: (a.select(key), b.select(key)) for n, (a, b) in pairs.items()}).drop("dangling")


def unsafe_paths(sources: DataFrame) -> DataFrame:
    """Indexed paths that leave the project: absolute ones, and those that climb above it."""
    from .graph import folded

    return sources.where(F.col("path").startswith("/") | folded(F.col("path")).rlike(r"^\.\.(/|$)")).select("path")
