"""Mixing to target weights, in DataFrame operations alone.

A labelled table trains a naive Bayes classifier on hashed words; each document gets soft domain posteriors from its
mean word evidence, sharpened by SHARP. Projected gradient descent then finds document rates r >= at_least that bring
the expected tokens of each domain, sum of tokens * posterior * rate, to the targets: every step is one grouped sum
over all documents, the gradient lies in the small space of domains, and a document's rate is an expression of its
own posterior. Rates start at 1, so they stay as near to the natural mix as the targets allow.

A rate becomes whole copies: its floor, and one more for a share of documents chosen by a hash of id and text.
Null or empty texts have no tokens; their posterior is the prior and no target depends on them. Equal rows get equal
rates. Rows without doc_id are rows like others. Very long texts are one row of words in memory, like any Spark string.
Of domains with the same posterior the first in the targets names the document. Labelled rows whose domain has no target
train nothing; without labelled rows the posterior is uniform; an empty table gives an empty one. Only doc_id and text
are read, and mixed() gives all columns back as they are, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_row_key, keep, labelled, quoted, row_key, table, unused

#: The model has BUCKETS rows of one double a domain (at most 64 domains): the bound of what is broadcast.
BUCKETS, SAMPLE, SHARP, ALPHA = 4096, 20000, 4.0, 0.1
TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


def _words(docs: DataFrame, *columns: str) -> DataFrame:
    found = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    return docs.select(*columns, F.posexplode_outer(found).alias("place", "word")).select(*columns, "place", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).alias("bucket"), F.col("word").isNotNull().alias("real"))


def train(docs: DataFrame, labels: DataFrame, domains: list[str], sample: int = SAMPLE) -> tuple[DataFrame, list[float], list[float]]:
    """Word evidence by bucket (bucket, w0, w1, ...), evidence of an unseen bucket, log priors; from about `sample` labelled documents."""
    each = labels.select(F.col("doc_id").alias("_id"), F.col("domain").cast("string").alias("domain")).where(F.col("domain").isin(domains)).distinct()
    rows = keep(labelled(docs, each, sample).select("text", "domain"), "labelled")
    counts = keep(_words(rows, "domain").where("real").groupBy("bucket", "domain").count(), "word-counts")
    got = {r[0]: r[1] for r in counts.groupBy("domain").agg(F.sum("count")).collect()}  # one row a domain
    n = {r[0]: r[1] for r in rows.groupBy("domain").count().collect()}
    unseen, prior, columns = [], [], []
    for k, d in enumerate(domains):
        base = math.log(got.get(d, 0) + ALPHA * BUCKETS)
        unseen.append(math.log(ALPHA) - base)
        prior.append(math.log((n.get(d, 0) + 1) / (sum(n.values()) + len(domains))))
        columns.append((F.log(F.sum(F.when(F.col("domain") == d, F.col("count")).otherwise(0)) + ALPHA) - base).alias(f"w{k}"))
    return counts.groupBy("bucket").agg(*columns), unseen, prior


def posteriors(docs: DataFrame, labels: DataFrame, domains: list[str], sample: int = SAMPLE) -> DataFrame:
    """row_id, row_key, n_rows (equal rows), n_tokens, p0, p1, ... for each content of docs."""
    if not 0 < len(domains) <= 64:
        raise ValueError("1 to 64 domains")
    model, unseen, prior = train(docs, labels, domains, sample)
    words = _words(docs.select(F.col("doc_id").cast("long").alias("row_id"), row_key().alias("_key"), "text"), "row_id", "_key")
    met = words.join(F.broadcast(model.withColumnRenamed("bucket", "of")), words.bucket == F.col("of"), "left")  # bound: BUCKETS rows
    sums = met.groupBy("row_id", "_key").agg(
        F.count_if((F.col("place") == 0) | F.col("place").isNull()).alias("n_rows"), F.count_if("real").alias("n"),
        *[F.sum(F.when(F.col("real"), F.coalesce(f"w{k}", F.lit(u)))).alias(f"s{k}") for k, u in enumerate(unseen)],
    )
    score = [F.coalesce(F.col(f"s{k}") / F.col("n") * SHARP, F.lit(0.0)) + F.lit(b) for k, b in enumerate(prior)]
    top = F.greatest(*score) if len(score) > 1 else score[0]
    sums = sums.select(F.col("row_id"), F.col("_key").alias("row_key"), "n_rows", (F.col("n") / F.col("n_rows")).cast("long").alias("n_tokens"), *[F.exp(s - top).alias(f"e{k}") for k, s in enumerate(score)])
    whole = sum((F.col(f"e{k}") for k in range(1, len(domains))), F.col("e0"))
    return sums.select("row_id", "row_key", "n_rows", "n_tokens", *[(F.col(f"e{k}") / whole).alias(f"p{k}") for k in range(len(domains))])


def fit_rates(post: DataFrame, weights: list[float], budget: float | None = None, at_least: float = 0.0, rounds: int = 60, near: float = 1e-4) -> tuple[Column, dict]:
    """The rate as an expression of p0, p1, ..., and the totals that it gives.

    budget: expected tokens in all; None: as many as there are, or with at_least 1 as few as let every domain grow.
    """
    size = len(weights)
    share = [w / sum(weights) for w in weights]
    tokens = F.col("n_rows") * F.col("n_tokens")
    p = [F.col(f"p{k}") for k in range(size)]
    first = post.agg(*[F.sum(tokens * a * b) for a in p for b in p], *[F.sum(tokens * a) for a in p]).first()
    gram = [[float(first[i * size + j] or 0) for j in range(size)] for i in range(size)]
    have = [float(first[size * size + k] or 0) for k in range(size)]
    whole = sum(have)
    if budget is None:
        budget = whole if at_least < 1 else max([whole, *[h / s for h, s in zip(have, share) if s]])
    target = [budget * s for s in share]
    scale = [1 / max(h, 1.0) for h in have]  # unit residuals: tokens over tokens there
    # the step: one over a bound of the largest eigenvalue of the scaled Gram matrix
    bound = max([sum((scale[i] * scale[j]) ** 0.5 * gram[i][j] for j in range(size)) for i in range(size)] + [1e-9])
    moves, total, n = [], list(have), 0

    def rate_after(steps: list) -> Column:
        """The projected steps folded over a literal array: the plan and its compiled code stay the same from round to round."""
        if not steps:
            return F.lit(1.0)
        held = F.array(*[F.array(*[F.lit(float(x)) for x in m]) for m in steps])
        return F.aggregate(held, F.lit(1.0), lambda r, m: F.greatest(F.lit(float(at_least)), r + sum((p[k] * m[k] for k in range(1, size)), p[0] * m[0])))

    for n in range(1, rounds + 1):
        gap = [t - x for t, x in zip(target, total)]
        if whole == 0 or max(abs(g) for g in gap) <= near * budget:
            break
        moves.append([g * s / bound for g, s in zip(gap, scale)])
        paid = post.select(*p, (tokens * rate_after(moves)).alias("paid"))
        row = paid.agg(*[F.sum(F.col("paid") * a) for a in p]).first()
        was, total = total, [float(x or 0) for x in row]
        if max(abs(x - y) for x, y in zip(was, total)) <= near * budget / 10:  # the bounds hold the rest of the gap
            n += 1
            break
    rate = rate_after(moves)
    return rate, {"target": target, "total": total, "have": have, "rounds": n}


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], **how) -> DataFrame:
    """row_id, row_key, n_tokens, p0, ..., domain, rate, copies for each content of docs."""
    domains = list(targets)
    post = keep(posteriors(docs, labels, domains), "posteriors")
    rate, _ = fit_rates(post, list(targets.values()), **how)
    top = F.greatest(*[F.col(f"p{k}") for k in range(len(domains))]) if len(domains) > 1 else F.col("p0")
    domain = F.coalesce(*[F.when(F.col(f"p{k}") == top, F.lit(d)) for k, d in enumerate(domains)])
    out = post.withColumn("domain", domain).withColumn("rate", rate)
    luck = F.pmod(F.xxhash64(F.lit("copies"), "row_id", "row_key"), F.lit(1_000_000)) / 1e6
    return out.withColumn("copies", (F.floor(F.col("rate") + 1e-9) + F.when(luck < F.col("rate") - F.floor(F.col("rate") + 1e-9), 1).otherwise(0)).cast("int"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], **how) -> DataFrame:
    """docs with each row as often as its copies say; all columns stay."""
    got = keep(rates(docs, labels, targets, **how).where("copies > 0").select("row_id", "row_key", "copies"), "copies")
    out = by_row_key(docs, got, "inner")
    spare = unused(docs)
    return out.select(*[docs[quoted(c)] for c in docs.columns], F.explode(F.sequence(F.lit(1), got["copies"])).alias(spare)).drop(spare)


def clean_languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the queries: documents labelled good and not toxic, with their language as domain."""
    good = labels.where("quality = 1 and toxic = 0").select(F.col("doc_id").alias("of")).distinct()
    return docs.select("doc_id", F.col("lang").alias("domain")).distinct().join(good, F.col("doc_id") == F.col("of"), "left_semi")


def query(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = rates(docs, clean_languages(docs, labels), TARGETS)
    known = [F.round(f"p{k}", 6).alias(f"p_{d}") for k, d in enumerate(TARGETS)]
    return out.select(F.col("row_id").alias("doc_id"), "n_rows", "n_tokens", *known, "domain", F.round("rate", 6).alias("rate"), "copies")
