"""Media columns: interleaved sequences of text and media references, resolved by digest.

sequences() parses HTML into an ordered array of structs: position, kind (text or media), text, reference, digest and
caption. A media struct's caption is its figure's caption, before or after it, or else its alt text; a caption without
any media in its figure, or outside a figure, is text. Positions count both kinds, so text, media and captions stay
aligned. What stands in script, style, template or noscript is not part of the page. store() keeps payloads under the SHA-256 of their stored form; resolve() joins the
references with what was read back from the store.

The stored form is a binary greyscale image (PGM) of 64 samples a row, 8 bits a sample; a comment in its header holds
the number of bytes before padding. Null text or HTML counts as empty: an empty payload is one row of zeros, an empty
page an empty sequence. References without a stored payload keep nulls. Equal payloads share one stored form; equal rows
give equal rows. Long texts and pages are held whole, one at a time in Python. Empty tables give empty tables. Only the
key and the content column are read.
"""

from __future__ import annotations

import hashlib
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, table

WIDTH = 64
ITEM = "array<struct<position:int,kind:string,text:string,ref:string,digest:string,caption:string>>"
INFO = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
MARK = "sha256:"


def encode(raw: bytes) -> bytes:
    rows = max(1, -(-len(raw) // WIDTH))
    return b"P5\n# bytes %d\n%d %d\n255\n" % (len(raw), WIDTH, rows) + raw + bytes(rows * WIDTH - len(raw))


def decode(media: bytes) -> tuple[int, np.ndarray]:
    """Bytes before padding, and the samples (rows x WIDTH)."""
    magic, note, shape, depth, samples = media.split(b"\n", 4)
    width, rows = map(int, shape.split())
    if magic != b"P5" or depth != b"255" or len(samples) != width * rows:
        raise ValueError("not a stored payload")
    return int(note.split()[2]), np.frombuffer(samples, np.uint8).reshape(rows, width)


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and entropy of the samples, and the mean of each of eight column bands."""
    count = np.bincount(samples.ravel(), minlength=256)
    n, level = samples.size, np.arange(256)
    mean = float(count @ level) / n
    p = count[count > 0] / n
    spread = max(float(count @ (level * level)) / n - mean * mean, 0.0) ** 0.5
    bands = samples.sum(axis=0, dtype=np.int64).reshape(8, -1).sum(axis=1) / (samples.shape[0] * 8)
    return f"{mean:.4f},{spread:.4f},{-(p * np.log2(p)).sum() + 0.0:.4f};" + ",".join(f"{b:.2f}" for b in bands)


class _Parser(HTMLParser):
    BLOCK = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "figure", "br", "tr", "td", "th", "ul", "ol", "table", "nav", "header", "footer", "body", "html", "title", "blockquote", "pre", "img", "video", "audio", "figcaption", "main", "aside"}
    SILENT = {"script", "style", "template", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # figures that are open: where their items begin, and their captions so far
        self.items, self.words, self.silent, self.figures, self.caption = [], [], 0, [], None

    def flush(self):
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append(self.text_item(text))

    @staticmethod
    def text_item(text: str) -> dict:
        return {"kind": "text", "text": text, "ref": None, "digest": None, "caption": None}

    def handle_starttag(self, tag, attrs):
        if tag in self.SILENT:
            self.silent += 1
        if tag in self.BLOCK and self.caption is None:
            self.flush()
        if tag == "figure":
            self.end_caption()
            self.figures.append((len(self.items), []))
        elif tag == "figcaption" and not self.silent:
            self.end_caption()
            self.caption = []
        elif tag in ("img", "video", "audio", "source") and not self.silent:
            got = dict(attrs)
            if ref := got.get("src"):
                digest = ref[len(MARK) :] if ref.startswith(MARK) else None
                self.items.append({"kind": "media", "text": None, "ref": ref, "digest": digest, "caption": got.get("alt") or None})

    def end_caption(self):
        """A caption ends: it waits for the end of its figure, or is text if it has none."""
        if self.caption is None:
            return
        said, self.caption = " ".join("".join(self.caption).split()), None
        if said and self.figures:
            self.figures[-1][1].append((len(self.items), said))
        elif said:
            self.items.append(self.text_item(said))

    def end_figure(self):
        begin, captions = self.figures.pop()
        media = [item for item in self.items[begin:] if item["kind"] == "media"]
        for item in media if captions else ():
            item["caption"] = " ".join(said for _, said in captions)
        if not media:
            for at, said in reversed(captions):
                self.items.insert(at, self.text_item(said))

    def handle_endtag(self, tag):
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        if tag == "figcaption":
            self.end_caption()
        elif tag == "figure" and self.figures:
            self.end_caption()
            self.flush()
            self.end_figure()
        elif tag in self.BLOCK and self.caption is None:
            self.flush()

    def handle_data(self, data):
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)


def parse(html: str) -> list[dict]:
    p = _Parser()
    p.feed(html)
    p.close()
    p.end_caption()
    p.flush()
    while p.figures:
        p.end_figure()
    return [{"position": k} | item for k, item in enumerate(p.items)]


def _sequences(batches):
    kind = pa.list_(pa.struct([("position", pa.int32()), *[(c, pa.string()) for c in ("kind", "text", "ref", "digest", "caption")]]))
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse(h) for h in batch.column(1).fill_null("").to_pylist()], kind)], ["id", "items"])


def sequences(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """id, items: the interleaved sequence of each page."""
    return pages.select(F.col(key).cast("long").alias("id"), F.col(html).cast("string").alias("html")).mapInArrow(_sequences, f"id long, items {ITEM}")


def _store(batches):
    held: set[bytes] = set()
    for batch in batches:
        digests, media = [], []
        for raw in batch.column(0).fill_null(b"").to_pylist():
            form = encode(raw)
            digest = hashlib.sha256(form)
            if digest.digest() not in held:
                held.add(digest.digest())
                digests.append(digest.hexdigest())
                media.append(form)
        if len(held) > 200_000:  # only a saving: what is stored twice is read as one
            held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["digest", "media"])


def store(payloads: DataFrame) -> DataFrame:
    """The media table of a binary column `payload`: digest, media; written to the shared folder."""
    return keep(payloads.select("payload").mapInArrow(_store, "digest string, media binary"), "media", "zstd")


def _info(batches):
    for batch in batches:
        rows = []
        for digest, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n, samples = decode(media)
            payload = samples.tobytes()
            rows.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
        cols = list(zip(*rows)) or [[]] * 8
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [c.split()[0] for c in INFO.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)


def read_back(media: DataFrame) -> DataFrame:
    """What the stored bytes hold, one row a digest."""
    return keep(media.mapInArrow(_info, INFO).dropDuplicates(["digest"]), "media-info")


def resolve(found: DataFrame, info: DataFrame) -> DataFrame:
    """One row for each media reference, in place: id, position, ref, caption and what its digest resolves to."""
    at = found.select("id", F.explode("items").alias("item")).where("item.kind = 'media'").select("id", "item.position", "item.ref", "item.caption", F.col("item.digest").alias("of"))
    return at.join(info, F.col("of") == F.col("digest"), "left").drop("of")


def _pages(batches):
    for batch in batches:
        html = []
        for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).fill_null(b"").to_pylist()):
            digest = hashlib.sha256(encode(raw)).hexdigest()
            html.append(f'<article><p>document {key}</p><figure><img src="{MARK}{digest}" alt="bytes"><figcaption>text of document {key}</figcaption></figure></article>')
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(html, pa.string())], ["page_id", "html"])


def document_media(docs: DataFrame) -> DataFrame:
    """Each document's text as a payload on a page of its own, stored, parsed, resolved and read back."""
    raw = docs.select(F.col("doc_id").cast("long").alias("page_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("payload"))
    info = read_back(store(raw))
    pages = raw.mapInArrow(_pages, "page_id long, html string")
    return resolve(sequences(pages), info)


def query(spark, sf_dir):
    out = document_media(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def page_sequences(spark, sf_dir):
    """page_id, n_items, n_media, captions, sequence_sha256 of every page of `pages`.

    The digest is of the items in order, one line each: kind, then the text or else the reference, then the caption.
    """
    items = sequences(table(spark, sf_dir, "pages"))
    media = F.filter("items", lambda i: i["kind"] == "media")
    line = lambda i: F.concat_ws("\t", i["kind"], F.coalesce(i["text"], i["ref"]), F.coalesce(i["caption"], F.lit("")))
    digest = F.sha2(F.concat_ws("\n", F.transform("items", line)), 256)
    return items.select(F.col("id").alias("page_id"), F.size("items").cast("long").alias("n_items"), F.size(media).cast("long").alias("n_media"), F.transform(media, lambda i: i["caption"]).alias("captions"), digest.alias("sequence_sha256"))
