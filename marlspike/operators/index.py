"""The stored search index: grams, postings and blocks of postings in parts by item, and the items that they stand for.

A part holds whole items, so a changed item touches one part: an update derives what is new or changed, takes the other
rows of the touched parts over, and overwrites those partitions alone. Within a part rows are sorted by term, so a search
skips the row groups of other terms. An item's digest tells whether it has changed; a chunk's id is derived from its path,
place and content, so that ids alone are compared and no content is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blockmax, search

SCHEMAS = {
    "grams": "kind string, id string, term string, part int",
    "postings": "kind string, id string, d long, col string, weight double, place int, term string, part int",
    "blocks": f"kind string, {blockmax.SCHEMA}, part int",
    "items": "kind string, id string, d long, digest long, part int",
}
#: State of the whole: the table versions that it stands for, and the parts that are being written (none: it is complete).
MARKER = "versions map<string,int>, fine int, parts int, open array<int>"
#: Parts of an index; files of a part that terms are dealt over (more for indexes whose parts outgrow a task).
PARTS, SPREAD = 64, 1
#: What tells that an item has changed.
DIGESTS = search.COLUMNS | {"chunk": ["id"]}


def part_of(item: Column, parts: int) -> Column:
    """A part holds whole blocks, as both numbers are powers of two and of one hash."""
    return blockmax.block_of(item, parts).cast("int")


def fineness(items: int, parts: int = PARTS) -> int:
    return max(parts, blockmax.fineness(items))


def digests(kinds: dict[str, DataFrame], parts: int = PARTS) -> DataFrame:
    """kind, id, digest, part of all items."""
    out = None
    for k, df in kinds.items():
        each = df.select(F.lit(k).alias("kind"), "id", F.xxhash64(*DIGESTS[k]).alias("digest"), part_of(F.col("id"), parts).alias("part"))
        out = each if out is None else out.unionByName(each)
    return out


def entries(kinds: dict[str, DataFrame], parts: int = PARTS) -> dict[str, DataFrame]:
    """grams, postings and items of some items: by kind, tables with id and the columns of that kind."""
    out: dict[str, DataFrame] = {}
    for k, df in kinds.items():
        weights, kind, part = search.WEIGHTS[k], F.lit(k).alias("kind"), part_of(F.col("id"), parts).alias("part")
        digest = df.select(F.col("id").alias("of"), F.xxhash64(*DIGESTS[k]).alias("digest"))
        sizes = search.lengths(df, weights)
        made = {
            "grams": search.grams(df.withColumn("kind", F.lit(k)), search.COLUMNS[k]).withColumn("part", part),
            "postings": search.postings(df, weights).select(kind, "id", "d", "col", "weight", "place", "term", part),
            "items": sizes.join(digest, sizes.id == digest.of).select(kind, "id", "d", "digest", part),
        }
        out = {t: made[t] if t not in out else out[t].unionByName(made[t]) for t in made}
    return out


def blocked(postings: DataFrame, fine: int, parts: int = PARTS) -> DataFrame:
    """The blocks of postings of whole parts."""
    held = blockmax.blocks(postings, fine, ["kind"])
    return held.select("kind", "term", "block", "n", "pairs", "posts", F.pmod("block", F.lit(parts)).cast("int").alias("part"))


def derived(kinds: dict[str, DataFrame], fine: int, parts: int = PARTS) -> dict[str, DataFrame]:
    """All tables of an index."""
    made = entries(kinds, parts)
    return made | {"blocks": blocked(made["postings"], fine, parts)}


def difference(have: DataFrame, kinds: dict[str, DataFrame], parts: int = PARTS) -> tuple[DataFrame, DataFrame]:
    """(kind, id, part) of the items that the index lacks or holds in another form, and of those that it should not hold as it does."""
    now, key = digests(kinds, parts), ["kind", "id", "digest"]
    have = have.where(F.col("kind").isin(*kinds))
    return now.join(have, key, "left_anti").select("kind", "id", "part"), have.join(now, key, "left_anti").select("kind", "id", "part")


def updated(have: dict[str, DataFrame], kinds: dict[str, DataFrame], fresh: DataFrame, gone: DataFrame, touched: list[int], parts: int = PARTS) -> dict[str, DataFrame]:
    """grams, postings and items of the touched parts after a difference. Rows of fresh items that an interrupted update left go too."""
    new = entries({k: df.join(fresh.where(F.col("kind") == k).select("id"), "id", "left_semi") for k, df in kinds.items()}, parts)
    out = fresh.select("kind", "id").unionByName(gone.select("kind", "id")).distinct()
    stay = lambda t: have[t].where(F.col("part").isin(touched)).join(out, ["kind", "id"], "left_anti")
    return {t: stay(t).select(*new[t].columns).unionByName(new[t]) for t in new}


def arranged(df: DataFrame, spread: int = SPREAD) -> DataFrame:
    """Rows as they are stored: a part together, sorted by term."""
    if "term" not in df.columns:
        return df.repartition("part")
    return df.repartition("part", F.pmod(F.xxhash64("term"), F.lit(spread))).sortWithinPartitions("part", "term")
