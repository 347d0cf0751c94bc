"""Fill-in-the-middle transformation: a numpy kernel over whole Arrow batches of UTF-8.

A 256-entry table gives each byte its class. A table of class pairs, looked up for every byte and the one before it, says
where a unit (a code point, or a word with the blanks after it) begins; where a document begins, a unit begins. One
cumulative sum, less its value at each document's first byte, counts units within documents, and one searchsorted finds
the byte of every cut of every row. Rows go through in steps of about STEP_BYTES, a longer text in a step of its own.

Where the cuts fall and which form a row takes come from the SHA-256 of "seed:doc_id", so they do not depend on
partitions or order. Null texts are empty; empty texts and texts that hold a mark are plain: nothing is moved. A null
doc_id hashes like an empty one. Repeated rows give equal rows, an empty table gives no rows, other columns are left out
of `digests` and pass through `infilled`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat, quoted, steps, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PLAIN_FROM, SPM_BELOW = 1, 90, 20
#: Classes of bytes.
CONTINUES, BLANK, OPENS, SOLID = range(4)


def byte_classes() -> np.ndarray:
    of = np.full(256, SOLID, np.uint8)
    of[0x80:0xC0] = CONTINUES
    of[[9, 10, 11, 12, 13, 32]] = BLANK
    of[ord("<")] = OPENS
    return of


def boundary_table(unit: str) -> np.ndarray:
    """[class before, class here] -> whether a unit begins here."""
    begins = np.zeros((4, 4), bool)
    if unit == "chars":
        begins[:, [BLANK, OPENS, SOLID]] = True
    elif unit == "words":
        begins[BLANK, [OPENS, SOLID]] = True
    else:
        raise ValueError(f"no such unit: {unit}")
    return begins


def marked(data: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold one of the three marks."""
    n = len(offsets) - 1
    if len(data) < 3:
        return np.zeros(n, bool)
    letter = np.zeros(256, bool)
    letter[[ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]] = True
    at = np.flatnonzero((kind[:-2] == OPENS) & letter[data[1:-1]] & (data[2:] == ord(">")))
    of = np.searchsorted(offsets, at, "right") - 1
    at_end = at + 3 > offsets[of + 1]  # goes on in the next text
    return np.bincount(of[~at_end], minlength=n) > 0


def cuts(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, draws: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text; units before its two cuts (2 rows); bytes of data before them (2 rows)."""
    mask = np.ones(len(data), bool)
    mask[1:] = begins.ravel()[4 * kind[:-1] + kind[1:]]
    starts = offsets[:-1]
    mask[starts[starts < offsets[1:]]] = True
    total = np.cumsum(mask, dtype=np.int32)  # a batch's text is below 2 GB
    before = np.append(0, total[offsets[1:] - 1] * (offsets[1:] > 0)) if len(total) else np.zeros(len(offsets), np.int64)  # units before each text
    n = np.diff(before)
    chosen = np.sort(draws % (n + 1), axis=0)
    # the byte at which unit number k + 1 of its text begins, or the text's end
    at = np.searchsorted(total, before[:-1] + chosen + 1)
    return n, chosen, np.where(chosen < n, at, offsets[1:])


def joined(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, form: np.ndarray) -> pa.Array:
    """The output texts; form: 0 plain, 1 psm, 2 spm."""
    view = memoryview(np.ascontiguousarray(data))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    out = []
    for kind, lo, x, y, hi in zip(form.tolist(), offsets[:-1].tolist(), at[0].tolist(), at[1].tolist(), offsets[1:].tolist()):
        if kind == 0:
            out.append(view[lo:hi])
        elif kind == 1:
            out += (p, view[lo:x], s, view[y:hi], m, view[x:y])
        else:
            out += (s, view[y:hi], p, view[lo:x], m, view[x:y])
    size = np.diff(offsets) + np.where(form > 0, len(p) + len(s) + len(m), 0)
    ends = np.concatenate([[0], np.cumsum(size)])
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(b"".join(out))])


def _kernel(unit: str):
    def run(batches):
        of_byte, begins = byte_classes(), boundary_table(unit)
        for batch in batches:
            data, offsets = flat(batch.column("_text"))
            draws, roll = (np.stack([batch.column(c).to_numpy() for c in cs]) for cs in (("_h1", "_h2"), ("_h3", "_h4")))
            for lo, hi in steps(offsets):
                own = offsets[lo : hi + 1] - offsets[lo]
                here = data[offsets[lo] : offsets[hi]]
                kind = of_byte[here]
                n, chosen, at = cuts(here, own, kind, draws[:, lo:hi], begins)
                form = np.where((n == 0) | marked(here, kind, own) | (roll[0, lo:hi] >= PLAIN_FROM), 0, np.where(roll[1, lo:hi] < SPM_BELOW, 2, 1))
                plain = form == 0
                cols = [
                    batch.column("row").slice(lo, hi - lo), joined(here, own, at, form).cast(pa.string()), pa.array(n), pa.array(np.array(["plain", "psm", "spm"], object)[form], pa.string()),
                    pa.array(chosen[0], mask=plain), pa.array(chosen[1] - chosen[0], mask=plain),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["row", "output", "n", "form", "prefix_chars", "middle_chars"])

    return run


def infilled(docs: DataFrame, unit: str = "chars", seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """output, n (units), form (plain, psm or spm), prefix_chars and middle_chars (units; null if plain), and docs' columns as the struct `row`.

    carry: the columns that `row` holds (all of docs, if not given).
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    group = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    slim = docs.select(
        F.struct(*[F.col(quoted(c)) for c in (docs.columns if carry is None else carry)]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"),
        group[0].alias("_h1"), group[1].alias("_h2"), (group[2] % 100).alias("_h3"), (group[3] % 100).alias("_h4"),
    )
    more = [("output", T.StringType()), ("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType())]
    return slim.mapInArrow(_kernel(unit), T.StructType([slim.schema["row"], *[T.StructField(c, t) for c, t in more]]))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of: the marks stand nowhere in it, so a split gives the three parts."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every row."""
    out = infilled(docs, carry=["doc_id"])
    return out.select(
        F.col("row.doc_id").cast("long").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


def query(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))


ORACLE = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(sha256('1:' || doc_id), k, 8))::BIGINT) AS h
  FROM documents),
cut AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS x, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS y,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
              WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
part AS (
  SELECT *, substr(t, 1, x) AS p, substr(t, x + 1, y - x) AS m, substr(t, y + 1) AS s FROM cut)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN x::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (y - x)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM part
"""
