"""Helpers shared by the training-data operators: shared tables, Arrow text access, word hashes.

Workers may not have this package on their path, so it is pickled by value.
"""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules["marlspike"])

#: Bytes of text that one vectorised step holds at a time; a longer text is a step of its own.
STEP_BYTES = 1 << 20
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, if the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="marlspike-")
    return _OWN["dir"]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that keep() wrote."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def keep(df: DataFrame, name: str, codec: str = "lz4") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage, survives lost executors.

    The path stays in the attribute kept_at until the session ends or discard() is called.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    atexit.register(_late, spark, path)
    return out


def _late(spark: SparkSession, path: str) -> None:
    try:
        discard(spark, path)
    except Exception:  # the session has ended: its folder is the cluster's to clean
        pass


def kept_bytes(df: DataFrame) -> int:
    """The size of a table that keep() wrote."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.kept_at)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def unused(df: DataFrame) -> str:
    """A name that no column of df has."""
    return "_" * (1 + max(map(len, df.columns), default=0))


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and where each begins (n + 1 offsets). Nulls are empty."""
    col = col.fill_null("")
    if pa.types.is_large_string(col.type):
        col = col.cast(pa.string())
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES):
    """Row ranges of at most limit bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def white_space() -> np.ndarray:
    is_ws = np.zeros(256, bool)
    is_ws[[9, 10, 11, 12, 13, 32]] = True
    return is_ws


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of anything but ASCII white space, never across texts: starts, ends, and the text that each is in."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    solid = ~white_space()[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = solid[:-1]
    start = solid & (~before | edge[:-1])
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    end = solid & (~after | edge[1:])
    at = np.flatnonzero(start)
    return at, np.flatnonzero(end) + 1, np.searchsorted(offsets, at, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    """base to the 0 to n, modulo 2 ** 64, as products of a few."""

    def some(of: int, most: int) -> np.ndarray:
        x = np.full(most, of, np.uint64)
        x[0] = 1
        return np.cumprod(x, dtype=np.uint64)

    return np.multiply.outer(some(pow(base, 1024, 1 << 64), n // 1024 + 1), some(base, 1024)).ravel()[: n + 1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one cumulative polynomial over all bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15 | 1
    back = pow(base, -1, 1 << 64)
    n = len(data)
    up = powers(base, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(back, n)[starts])


def lower_ascii() -> np.ndarray:
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return low


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def by_hash(df: DataFrame, columns: list[str], about: int) -> DataFrame:
    """About `about` rows of df (all, if it has no more): those whose columns' hash is under a threshold that its count sets.

    Narrow but for the count; equal rows go together, so drop duplicates where they may be many.
    """
    share = min(1.0, about / max(df.count(), 1))
    return df if share == 1 else df.where(F.pmod(F.xxhash64(F.lit("sample"), *columns), F.lit(1 << 30)) < int(share * (1 << 30)))


def labelled(docs: DataFrame, labels: DataFrame, about: int) -> DataFrame:
    """_id, text and the other columns of labels for about 2 * `about` rows of docs at most; labels: _id (each few times) and labels.

    About `about` labelled ids are picked by hash, and of their rows, if an id has very many, again so many by hash.
    Equal rows count once. Docs are read twice; what is shuffled is the picked rows.
    """
    slim = docs.select(F.col("doc_id").alias("_doc"), text_or_empty().alias("text"))
    some = by_hash(labels.where("_id is not null"), ["_id"], about)
    met = slim.join(F.broadcast(some), F.col("_doc") == F.col("_id")).drop("_doc")  # bound: about `about` rows of a few numbers
    return by_hash(met, ["_id", "text"], 2 * about).dropDuplicates()


def row_key() -> Column:
    """A hash of the text: with doc_id it names a row's content (equal rows are alike)."""
    return F.xxhash64(text_or_empty())


def by_row_key(docs: DataFrame, slim: DataFrame, how: str) -> DataFrame:
    """Joins docs with slim (row_id, row_key, ...) on doc_id and the hash of the text; null ids meet null ids."""
    key = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(slim, docs["doc_id"].cast("long").eqNullSafe(slim["row_id"]) & (key == slim["row_key"]), how)
