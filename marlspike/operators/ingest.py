"""Incremental ingestion: chunks, snapshot differences, keyed merges, and the writing of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def chunks(sources: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Line-aligned chunks of at most 4000 characters: key, chunk_no, start_line, end_line, content. No shuffle."""
    cut = sources.select(key, T.lines(F.col(content)).alias("_lines")).withColumn("_starts", T.chunk_starts(F.col("_lines")))
    out = cut.select(key, "_lines", "_starts", F.posexplode("_starts").alias("chunk_no", "_start"))
    end = F.coalesce(F.get("_starts", F.col("chunk_no") + 1), F.size("_lines"))
    return out.select(key, "chunk_no", (F.col("_start") + 1).alias("start_line"), end.alias("end_line"), F.array_join(F.slice("_lines", F.col("_start") + 1, end - F.col("_start")), "\n").alias("content"))


def reassembled(chunk_rows: DataFrame, key: str = "path") -> DataFrame:
    """A source's content: its chunks by line, joined by line ends."""
    parts = F.array_sort(F.collect_list(F.struct("start_line", "content")))
    return chunk_rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda c: c["content"]), "\n").alias("content"), F.count("*").alias("n_chunks"))


def source_with_chunks(sources: DataFrame, chunk_rows: DataFrame, path: str) -> DataFrame:
    """One source and its ordered chunks as an array."""
    own = chunk_rows.where(F.col("path") == path).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "content"))).alias("chunks"))
    return sources.where(F.col("path") == path).join(own, "path", "left")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new: path, content_hash (path unique). path, old_hash, new_hash, change: added, updated, unchanged or removed."""
    a = old.select(F.col("path").alias("op"), F.col("content_hash").alias("old_hash"))
    b = new.select(F.col("path").alias("np"), F.col("content_hash").alias("new_hash"))
    change = F.when(F.col("op").isNull(), "added").when(F.col("np").isNull(), "removed").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("updated")
    return a.join(b, F.col("op") == F.col("np"), "full_outer").select(F.coalesce("op", "np").alias("path"), "old_hash", "new_hash", change.alias("change"))


def removed_paths(old: DataFrame, seen: DataFrame) -> DataFrame:
    return old.join(seen.select("path"), "path", "left_anti")


def run_counts(scanned: DataFrame, old: DataFrame) -> DataFrame:
    """scanned: path, content_hash, skip_reason. One row: scanned, indexed, skipped, removed, as one index run reports them.

    A skipped source leaves the index but counts as skipped, and so does an unchanged one.
    """
    met = scanned.join(old.select(F.col("path").alias("op"), F.col("content_hash").alias("old_hash")), F.col("path") == F.col("op"), "full_outer")
    present = F.col("path").isNotNull()
    passes = present & F.col("skip_reason").isNull() & ~F.col("content_hash").eqNullSafe(F.col("old_hash"))
    return met.agg(F.count_if(present).alias("scanned"), F.count_if(passes).alias("indexed"), F.count_if(present & ~passes).alias("skipped"), F.count_if(~present).alias("removed"))


def upsert_latest(old: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Both together, the last row of each key by `order` (make it total). Combines before the shuffle."""
    rows = old.unionByName(new)
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(key, "_row.*")


def insert_ignore(old: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The rows of new that a unique key lets in: the first of each key by `order`, if old has none."""
    rest = [c for c in new.columns if c != key]
    first = new.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(key, "_row.*")
    return first.join(old.select(key), key, "left_anti").select(*new.columns)


def replaced(old: DataFrame, changed: DataFrame, fresh: DataFrame, key: str = "path") -> DataFrame:
    """A derived table after an incremental run: what stays (not changed, not removed) and what was derived anew."""
    return old.join(changed.select(key).distinct(), key, "left_anti").unionByName(fresh)


def cascade(gone: DataFrame, derived: dict[str, DataFrame], bindings: DataFrame | None = None) -> dict[str, DataFrame]:
    """Derived tables without the rows of removed paths; bindings keep their rows and lose their source."""
    out = {n: d.join(gone.select("path"), "path", "left_anti") for n, d in derived.items()}
    if bindings is not None:
        mark = gone.select(F.col("path").alias("_gone")).distinct()
        out["bindings"] = bindings.join(mark, bindings.source_path == F.col("_gone"), "left").withColumn("source_path", F.when(F.col("_gone").isNull(), F.col("source_path"))).drop("_gone")
    return out


def orphans(index_rows: DataFrame, canonical: DataFrame, key: str = "id") -> DataFrame:
    """Index rows whose item is gone (an anti join: a null id is an orphan)."""
    return index_rows.join(canonical.select(key), key, "left_anti")


def page(rows: DataFrame, where: Column, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A filtered, sorted page; make the order total."""
    return rows.where(where).orderBy(*order).offset(offset).limit(limit)


def write_snapshot(df: DataFrame, path: str, partitions: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*partitions) if partitions else w).parquet(path)


def export_jsonl(entities: dict[str, tuple[DataFrame, list[Column]]], directory: str) -> DataFrame:
    """Writes each entity as JSON lines in its order, into folders that must not exist; the manifest counts rows."""
    counts = []
    for name, (df, order) in entities.items():
        df.orderBy(*order).write.mode("errorifexists").json(f"{directory}/{name}.jsonl")
        counts.append(df.select(F.lit(name).alias("file"), F.lit(1).alias("x")).groupBy("file").agg(F.count("x").alias("rows")))
    manifest = counts[0]
    for c in counts[1:]:
        manifest = manifest.unionByName(c)
    manifest.coalesce(1).write.mode("errorifexists").json(f"{directory}/manifest")  # one row an entity
    return manifest


def moved_projects(known: DataFrame, found: DataFrame) -> DataFrame:
    """Projects whose identity shows up at exactly one new path that no other project holds: id, old_path, new_path."""
    one = found.groupBy("id").agg(F.count("*").alias("_n"), F.min("root_path").alias("new_path")).where("_n = 1").select("id", "new_path")
    free = one.join(known.select(F.col("root_path").alias("_held")), F.col("new_path") == F.col("_held"), "left_anti")
    return known.select("id", F.col("root_path").alias("old_path")).join(free, "id").where("old_path <> new_path")


