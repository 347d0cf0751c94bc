"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

A logistic classifier (style features and hashed words, trained on a bounded sample of labelled rows) gives each
document a log-likelihood ratio. Hosts and paths get beta priors whose strength is estimated from how much sites
differ (method of moments); a path shrinks towards its host and a host towards the global rate, so a site with few
documents adds little. The site rates are posterior sums, found by a few rounds of expectation and maximisation over
grouped aggregates of all documents. A document's posterior is its path's rate updated by its own evidence. Quality
and toxicity are two such targets; a document stays if it is probably good and probably not toxic.

Null or empty text has the evidence of the prior alone. A null host or path is a site of its own, and so is one that is
no column. Equal rows get equal results. Very long texts are described whole, as a step of their own. Without any
labelled row both targets fall back to the default rates and every document stays; an empty table gives an empty one.
Labels of unknown documents are ignored; labels of one document are averaged. Other columns are not read, and
keep_good() gives them back as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_row_key, flat, keep, labelled, row_key, span_hashes, steps, table, words

#: About so many labelled documents train the classifier (those whose hash is under a threshold).
SAMPLE = 8000
BUCKETS = 1 << 18
#: Bytes of a word's beginning that count as its stem, and the rest of the letter there.
STEM = 5
#: What every round takes off a word weight: words that tell little end at nothing.
SPARSE = 0.015
#: Rates of the targets where nothing is known.
DEFAULT = {"quality": 0.9, "toxic": 0.1}
N_STYLE = 12


def describe(col: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Style features of each text and the hash buckets of its distinct words and stems."""
    data, offsets = flat(col)
    style, ids = np.zeros((len(col), N_STYLE), np.float32), []
    kind = np.full(256, 7, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 blank, 4 bang, 5 bar, 6 symbol, 7 other
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    kind[[9, 10, 11, 12, 13, 32]] = 3
    kind[ord("!")], kind[ord("|")] = 4, 5
    kind[[ord(c) for c in "*&$%#@^~<>{}[]\\/=+_`"]] = 6
    for lo, hi in steps(offsets):
        part = offsets[lo : hi + 1]
        piece, part = data[part[0] : part[-1]], part - part[0]
        n = hi - lo
        row = np.repeat(np.arange(n), np.diff(part))
        count = np.bincount(row * 8 + kind[piece], minlength=8 * n).reshape(n, 8)
        at, end, own = words(piece, part)
        h = span_hashes(piece, at, end)
        n_words = np.bincount(own, minlength=n)
        again = np.zeros(len(h))
        if len(h) > 1:
            again[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
        order = np.lexsort((h, own))
        ho, oo = h[order], own[order]
        new = np.ones(len(ho), bool)
        new[1:] = (ho[1:] != ho[:-1]) | (oo[1:] != oo[:-1])
        distinct = np.bincount(oo[new], minlength=n)
        size, safe = np.maximum(np.diff(part), 1), np.maximum(n_words, 1)
        s = style[lo:hi]
        s[:, :8] = count / size[:, None]
        s[:, 8] = np.bincount(own, weights=again, minlength=n) / safe
        s[:, 9] = distinct / safe
        s[:, 10] = np.log1p(n_words) / 10
        s[:, 11] = np.bincount(own, weights=end - at, minlength=n) / safe / 10
        s[n_words == 0] = 0
        # words, and their first letters: what one stem gives in many forms is seen as one
        until = np.minimum(end, at + STEM)
        for _ in range(3):  # a letter is not split
            until += (until < end) & ((piece[np.minimum(until, len(piece) - 1)] & 0xC0) == 0x80)
        stem = span_hashes(piece, at, until) ^ np.uint64(0x5BD1E995)
        both = np.concatenate([h, stem]) & np.uint64(BUCKETS - 1)
        seen = np.unique(np.concatenate([own, own]).astype(np.uint64) * np.uint64(BUCKETS) + both)
        owner, bucket = (seen // np.uint64(BUCKETS)).astype(np.int64), (seen % np.uint64(BUCKETS)).astype(np.int32)
        ids += np.split(bucket, np.searchsorted(owner, np.arange(1, n)))
    return style, ids


def fit(style: np.ndarray, flat_ids: np.ndarray, sizes: np.ndarray, y: np.ndarray, rounds: int = 150) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by Adam with a soft threshold on word weights. Style weights, word weights, offset.

    flat_ids: the word buckets of all texts, one text after the other; sizes: how many each has."""
    mid, spread = style.mean(0), style.std(0) + 1e-3
    x = (style - mid) / spread
    rows = np.repeat(np.arange(len(sizes)), sizes)
    seen = np.bincount(flat_ids, minlength=BUCKETS)
    use = seen[flat_ids] >= 5
    flat_ids, rows = flat_ids[use], rows[use]
    n = len(y)
    w, v, b = np.zeros(x.shape[1]), np.zeros(BUCKETS), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    m = [0.0, np.zeros(x.shape[1]), np.zeros(BUCKETS)]
    s = [0.0, np.zeros(x.shape[1]), np.zeros(BUCKETS)]
    for t in range(1, rounds + 1):
        z = x @ w + np.bincount(rows, weights=v[flat_ids], minlength=n) + b
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        grads = [r.sum(), x.T @ r + 1e-4 * w, np.bincount(flat_ids, weights=r[rows], minlength=BUCKETS)]
        for k, g in enumerate(grads):
            m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.99 * s[k] + 0.01 * g * g
            move = 0.1 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-4)
            if k == 0:
                b -= move
            elif k == 1:
                w -= move
            else:
                v -= move
                v = np.sign(v) * np.maximum(np.abs(v) - SPARSE, 0)
    return w / spread, v, b - float((w / spread) @ mid)


def _score(models):
    def run(batches):
        for batch in batches:
            style, ids = describe(batch.column(2))
            owner = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
            every = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            out = []
            for model in models:
                if model is None:
                    out.append(np.zeros(len(style)))
                    continue
                w, v, b, base = model
                z = style @ w + np.bincount(owner, weights=v[every], minlength=len(style)) + b - base
                out.append(np.where(style[:, 10] > 0, np.clip(z, -30, 30), 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), *map(pa.array, out)], ["row_id", "row_key", "host", "path", "llr_quality", "llr_toxic"])

    return run


def _sampled(batches):
    for batch in batches:
        style, ids = describe(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(style), pa.list_(pa.float32())), pa.array(ids, pa.list_(pa.int32())), batch.column(1), batch.column(2)], ["style", "ids", "quality", "toxic"])


def _fit(batches):
    """All sampled rows, about 2 * SAMPLE of them at most: one row a target with its base rate and weights (none if there is nothing to learn)."""
    parts = [(np.array(b.column(0).flatten(), np.float32).reshape(-1, N_STYLE), b.column(1).flatten().to_numpy(), b.column(1).value_lengths().to_numpy(), b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)) for b in batches]
    for k, target in enumerate(("quality", "toxic")):
        rate, raw = DEFAULT[target], None
        if parts:
            style, ids, sizes = (np.concatenate([p[j] for p in parts]) for j in range(3))
            y = np.concatenate([p[3 + k] for p in parts]).astype(float)
            ok = ~np.isnan(y)
            ids, style, sizes, y = ids[np.repeat(ok, sizes)], style[ok], sizes[ok], y[ok]
            if len(ids) and 0 < y.sum() < len(y):
                rate = float(np.clip(y.mean(), 0.001, 0.999))
                w, v, b = fit(style, ids, sizes, y)
                raw = np.concatenate([w, v, [b]]).astype(np.float32).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([rate]), pa.array([raw], pa.binary())], ["target", "rate", "weights"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list, dict]:
    """A model (or None) and the base rate for each target, from about `sample` labelled documents.

    One task fits the models on that sample; the driver gets the weights alone."""
    each = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))
    rows = labelled(docs, each, sample).select("text", "quality", "toxic")
    rows = rows.mapInArrow(_sampled, "style array<float>, ids array<int>, quality double, toxic double")
    models, rates = [], {}
    for target, rate, raw in rows.repartition(1).mapInArrow(_fit, "target string, rate double, weights binary").orderBy("target").collect():
        rates[target] = rate
        held = None if raw is None else np.frombuffer(raw, np.float32)
        models.append(None if held is None else (held[:N_STYLE].astype(float), held[N_STYLE:-1], float(held[-1]), float(np.log(rate / (1 - rate)))))
    return models, rates


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _posterior(rate: Column, llr: str) -> Column:
    return 1 / (1 + F.exp(-(_logit(rate) + F.col(llr))))


def _strength(sites: DataFrame, rate: str, total: str) -> float:
    """Method of moments over all sites: how many documents a site's prior counts for, from 1 to 1000.

    The share of the variance that lies between sites is what their spread, weighted by their documents, exceeds chance by.
    """
    x, n = F.col(rate) / F.col(total), F.col(total)
    k, whole, square, mean, spread = sites.agg(F.count("*"), F.sum(n), F.sum(n * n), F.sum(F.col(rate)) / F.sum(n), F.sum(n * x * x)).first()
    if not k:
        return 1000.0
    chance, room = mean * (1 - mean), whole - square / whole - (k - 1)
    between = (spread - whole * mean * mean - (k - 1) * chance) / (chance * room) if chance * room > 1e-12 else 0.0
    return float(min(max(1 / between - 1, 1.0), 1000.0)) if between > 1e-3 else 1000.0


def site_rates(scored: DataFrame, rates: dict, rounds: int = 2) -> DataFrame:
    """host, path, and for each target the host's and the path's rate, after some rounds over all documents."""
    now = {t: None for t in rates}
    sites = None
    for _ in range(rounds):
        met = scored if sites is None else scored.join(sites, scored.host.eqNullSafe(sites.site_host) & scored.path.eqNullSafe(sites.site_path), "left")
        p = {t: _posterior(F.lit(rates[t]) if sites is None else F.col(f"path_{t}"), f"llr_{t}") for t in rates}
        paths = keep(met.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(p[t]).alias(f"s_{t}") for t in rates]), "paths")
        hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), *[F.sum(f"s_{t}").alias(f"h_{t}") for t in rates])
        total = hosts.agg(F.sum("host_n"), *[F.sum(f"h_{t}") for t in rates]).first()
        out = hosts.withColumnRenamed("host", "host_of")
        out = paths.join(out, paths.host.eqNullSafe(out.host_of))
        columns = [F.col("host").alias("site_host"), F.col("path").alias("site_path")]
        for k, t in enumerate(rates):
            every = (total[k + 1] or 0) / total[0] if total[0] else rates[t]
            kh, kp = _strength(hosts, f"h_{t}", "host_n"), _strength(paths, f"s_{t}", "n")
            host = (F.col(f"h_{t}") + kh * every) / (F.col("host_n") + kh)
            columns += [host.alias(f"host_{t}"), ((F.col(f"s_{t}") + kp * host) / (F.col("n") + kp)).alias(f"path_{t}")]
        sites = keep(out.select(*columns), "sites")
    return sites


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """row_id, row_key, host, path, p_quality, p_toxic, host and path rates, keep: one row for each row of docs."""
    models, rates = train(docs, labels, sample)
    site = [(F.col(c) if c in docs.columns else F.lit(None)).cast("string") for c in (host, path)]
    keyed = docs.select(F.col("doc_id").cast("long"), row_key().alias("key"), F.col("text").cast("string"), site[0].alias("host"), site[1].alias("path"))
    scored = keep(keyed.mapInArrow(_score(models), "row_id long, row_key long, host string, path string, llr_quality double, llr_toxic double"), "evidence")
    sites = site_rates(scored, rates)
    met = scored.join(sites, scored.host.eqNullSafe(sites.site_host) & scored.path.eqNullSafe(sites.site_path), "left")
    met = met.withColumn("p_quality", _posterior(F.col("path_quality"), "llr_quality")).withColumn("p_toxic", _posterior(F.col("path_toxic"), "llr_toxic"))
    return met.withColumn("keep", (F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5)).drop("site_host", "site_path")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects."""
    return by_row_key(docs, keep(judge(docs, labels).where("keep").select("row_id", "row_key").distinct(), "good-rows"), "left_semi")


def query(spark, sf_dir):
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(F.col("row_id").alias("doc_id"), F.col("host").alias("source"), F.col("path").alias("lang"), *[F.round(c, 6).alias(c) for c in ("p_quality", "p_toxic", "host_quality", "path_quality")], "keep")
