"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Both models are bags of hashed words and word pairs. A document's log weight is the sum over its n-grams of
log p_target - log p_raw; with Gumbel noise added, the largest keys are a sample without replacement in
proportion to the weights.
"""

from __future__ import annotations

import zlib
from math import ceil, inf, nextafter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HELD_ROWS, documents, map_batches, stored, text_rows, words

BUCKETS, FRACTION, SEED = 10_000, 0.5, 17
#: Labelled rows, at most, that stand for the target.
TARGET_ROWS = 20_000


class Hashes(dict):
    """crc32 of words, remembered up to a number of them."""

    def __missing__(self, w):
        if len(self) > 300_000:
            self.clear()
        self[w] = h = zlib.crc32(w)
        return h


def ngram_buckets(data: bytes, seen: Hashes, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of each word and of each pair of neighbours."""
    w = words(data)
    h = np.fromiter(map(seen.__getitem__, w), np.uint64, len(w))
    mixed = np.concatenate([h * np.uint64(0x9E3779B97F4A7C15), (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:]) * np.uint64(0x9E3779B97F4A7C15)])
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


class _Counts:
    def __init__(self, buckets: int):
        self.raw, self.target, self.seen, self.buckets = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), Hashes(), buckets

    def __call__(self, b):
        for text, target in zip(b.column("text").to_pylist(), b.column("target").to_pylist(), strict=True):
            n = np.bincount(ngram_buckets(text, self.seen, self.buckets), minlength=self.buckets)
            self.raw += n
            if target:
                self.target += n

    def end(self):
        at = np.flatnonzero(self.raw)
        yield {"bucket": at, "raw": self.raw[at], "target": self.target[at]}


def log_ratios(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw by bucket, add-one smoothed; all documents are raw, those in ``target`` target."""
    ids = target.select(F.col("doc_id").alias("_rk_t")).where("_rk_t is not null").distinct()
    ids = F.broadcast(ids) if ids.limit(HELD_ROWS + 1).count() <= HELD_ROWS else ids.hint("merge")
    flagged = docs.join(ids, F.col("doc_id") == F.col("_rk_t"), "left")
    rows = text_rows(flagged, F.col("_rk_t").isNotNull().alias("target")).drop("doc_id")
    found = map_batches(rows, lambda: _Counts(buckets), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    at = found["bucket"].to_numpy()
    raw, own = np.zeros(buckets), np.zeros(buckets)
    raw[at], own[at] = found["raw"].to_numpy(), found["target"].to_numpy()
    return np.log((own + 1) / (own.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value (k from 1 to the number of rows), by counting above ever closer edges."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    above = nextafter(hi, inf)
    while True:  # the value lies in [lo, above)
        edges = sorted({float(x) for x in np.linspace(lo, above, 65)[1:-1] if lo < x < above})
        if not edges:
            return lo
        n = df.agg(*[F.count_if(F.col(column) >= x).alias(f"n{i}") for i, x in enumerate(edges)], F.count_if((F.col(column) >= lo) & (F.col(column) < above)).alias("inside")).first()
        if n["inside"] <= 1000:
            over = df.where(F.col(column) >= above).count()
            inside = df.where((F.col(column) >= lo) & (F.col(column) < above)).select(column).collect()  # at most 1000
            return sorted((r[0] for r in inside), reverse=True)[k - over - 1]
        low = [x for i, x in enumerate(edges) if n[i] >= k]
        high = [x for i, x in enumerate(edges) if n[i] < k]
        lo, above = (low[-1] if low else lo), (high[0] if high else above)


def resample(docs: DataFrame, target: DataFrame, fraction: float = FRACTION, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_ngrams, log_weight, gumbel_key, selected of every row.

    ``target`` (doc_id) names the documents of the target: up to HELD_ROWS ids are broadcast, more are joined in a
    shuffle; null and repeated ids add nothing. selected: the key is among the ceil(fraction x rows) largest, ties
    with the last included, so equal rows fare alike. Noise depends on doc_id and seed. Null and empty texts weigh 0;
    no target gives near-uniform weights; an empty table gives no rows. Texts count whole, however long.
    """
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, target, buckets))

    def make():
        seen = Hashes()

        def f(b):
            own = [ngram_buckets(t, seen, buckets) for t in b.column("text").to_pylist()]
            return {"doc_id": b.column("doc_id"), "n_ngrams": [len(x) for x in own], "log_weight": [float(ratios.value[x].sum()) for x in own]}

        return f

    rows = text_rows(docs)
    scored = map_batches(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_ngrams long, log_weight double")
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    scored = stored(scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u))), "weights")
    n = scored.count()
    least = kth_largest(scored, "gumbel_key", max(1, ceil(n * fraction))) if n and fraction > 0 else inf
    return scored.withColumn("selected", F.col("gumbel_key") >= F.lit(least))


def target_sample(labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """doc_id of at most ``rows`` labels of good quality, those of the least hashes."""
    return labels.where("quality = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), target_sample(spark.read.parquet(f"{sf_dir}/labels.parquet")))
