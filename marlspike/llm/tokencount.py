"""Token counts of byte-level BPE by rank-synchronous array merging.

A text is cut at the vocabulary's special strings (each is one token) and into pre-tokens. The distinct pre-tokens of a
batch lie side by side in one ragged array of symbols, with an owner for each. Every round looks up the rank of each
neighbouring pair, takes the lowest rank of every sequence and merges that pair wherever it stands in the sequence, all
sequences at once; sequences without a pair leave the array. What survives is the count. Counts of pre-tokens seen
before in a task are looked up; the memory of them is emptied when it grows beyond REMEMBER entries.

Null and empty texts have no tokens; a text of over PART characters is counted piece by piece, to its end. Rows are counted
one by one, so repeated rows and ids (null ones too) give a row each, and there are no ties to break: equal ranks within a
sequence are one pair and merge from the left. An empty table gives no rows; columns beside doc_id and text, whatever their
names, are left out. The vocabulary file is a parameter; it is read by path on every worker.
"""

from __future__ import annotations

import json
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

LIMIT, REMEMBER, PART = 1024, 400_000, 1 << 20
#: The pre-tokeniser's pattern (fixed value of the byte-level BPE format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1 << 40)


def printable_bytes() -> dict[str, int]:
    """The format writes each byte as one character: printable Latin-1 as itself, the others from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Merges:
    """The vocabulary as arrays: the symbol of each byte; sorted pairs with their rank and the symbol they merge to."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        vocab = held["model"]["vocab"]
        self.byte = np.zeros(256, np.int64)
        for c, b in printable_bytes().items():
            self.byte[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in held["model"]["merges"]]
        key = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        new = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.new = key[order], order.astype(np.int64), new[order]
        self.special = [t["content"] for t in held.get("added_tokens", [])]
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.find = regex.compile(PATTERN)
        self.seen: dict[str, int] = {}

    def surviving(self, tokens: list[str]) -> np.ndarray:
        """How many symbols are left of each non-empty pre-token."""
        raw = [t.encode() for t in tokens]
        size = np.array([len(r) for r in raw], np.int64)
        symbol = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), size)
        left = size.copy()
        while len(symbol) > 1:
            rank, at = np.full(len(symbol), NONE), np.zeros(len(symbol), np.int64)
            near = np.flatnonzero(owner[1:] == owner[:-1])
            key = (symbol[near] << 32) | symbol[near + 1]
            where = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            known = self.key[where] == key
            rank[near[known]], at[near[known]] = self.rank[where[known]], where[known]
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            length = np.diff(np.append(first, len(owner)))
            least = np.repeat(np.minimum.reduceat(rank, first), length)
            hit = (rank == least) & (rank < NONE)
            # a run of overlapping hits (one symbol repeated) merges every other one, from the left
            begin = hit.copy()
            begin[1:] &= ~hit[:-1]
            place = np.arange(len(hit))
            hit &= (place - np.maximum.accumulate(np.where(begin, place, 0))) % 2 == 0
            merged = np.flatnonzero(hit)
            if not len(merged):
                break
            symbol[merged] = self.new[at[merged]]
            np.subtract.at(left, owner[merged], 1)
            stay = least < NONE
            stay[merged + 1] = False
            symbol, owner = symbol[stay], owner[stay]
        return left

    def learn(self, tokens: set[str]) -> None:
        fresh = [t for t in tokens if t not in self.seen]
        for k in range(0, len(fresh), 50_000):
            part = fresh[k : k + 50_000]
            self.seen.update(zip(part, self.surviving(part).tolist()))

    def pieces(self, text: str):
        """Lists of pre-tokens of the text between special strings, and the number of those as an int."""
        if self.cut is not None and any(s in text for s in self.special):
            parts = self.cut.split(text)
            yield len(parts) - 1
        else:
            parts = [text]
        for p in parts:
            if len(p) <= PART:
                yield self.find.findall(p)
            else:
                it = self.find.finditer(p)
                while some := [m.group() for m in islice(it, PART // 4)]:
                    yield some

    def counts(self, texts: list[str]) -> list[int]:
        out, k = [], 0
        while k < len(texts):
            size, rows = 0, []
            while k < len(texts) and (not rows or size < PART):
                size += len(texts[k])
                rows.append(texts[k])
                k += 1
            if len(rows) == 1 and size > PART:
                total = 0
                for p in self.pieces(rows[0]):
                    if isinstance(p, list):
                        self.learn(set(p))
                        total += sum(map(self.seen.__getitem__, p))
                        self.forget()
                    else:
                        total += p
                out.append(total)
                continue
            cut = [list(self.pieces(t)) for t in rows]
            self.learn({t for row in cut for p in row if isinstance(p, list) for t in p})
            get = self.seen.__getitem__
            out += [sum(sum(map(get, p)) if isinstance(p, list) else p for p in row) for row in cut]
            self.forget()
        return out

    def forget(self) -> None:
        if len(self.seen) > REMEMBER:
            self.seen.clear()


def _count(path: str, limit: int):
    def run(batches):
        merges = Merges(path)
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            n = merges.counts(texts)
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_count(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
