"""Toxicity by a classifier chain.

Categories are predicted in a fixed order by linear (logistic) models over hashed words; every later model
also sees the probabilities of the earlier categories. In training these come from models of other folds,
so that a later model learns from probabilities as uncertain as those it will meet.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import documents, map_batches, plain_words, text_rows

#: Category and the rule that reads it from a labels row.
CHAIN = {"low_quality": "1 - quality", "toxic": "toxic"}
BITS, FOLDS, L2, MIN_DOCS, CHANCE, THRESHOLD = 18, 5, 0.3, 5, 3.3, 0.35
#: Labelled rows, at most, that train the chain.
TRAIN_ROWS = 8_000


_MARKS = re.compile(rb"[!-/:-@\[-`{-~]{2,3}")


class Seen(dict):
    """Feature number of words, remembered up to a number of them."""

    def __missing__(self, w):
        if len(self) > 300_000:
            self.clear()
        self[w] = h = zlib.crc32(w) & ((1 << BITS) - 1)
        return h


def features(text: str, seen: Seen) -> np.ndarray:
    """The distinct hashed words and runs of marks of a whole text, sorted."""
    w = set(plain_words(text))
    w.update(_MARKS.findall(text.encode("utf-8", "replace")))
    return np.unique(np.fromiter(map(seen.__getitem__, w), np.int32, len(w)))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Linear:
    """L2-regularised logistic regression over sparse binary rows and a few dense columns (logits)."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, y: np.ndarray, l2: float = L2, rounds: int = 200):
        n = len(y)
        self.w, self.d, self.b = np.zeros(1 << BITS), np.zeros(dense.shape[1]), 0.0
        rate = float(y.mean()) if n else 0.0
        if rate in (0.0, 1.0):  # nothing to tell apart: the share itself
            self.b = 40.0 if rate else -40.0
            return
        used, at = np.unique(cols, return_inverse=True)
        # only features whose share among positives differs from that among negatives beyond chance
        own, other = np.bincount(at, weights=y[rows]), np.bincount(at, weights=1 - y[rows])
        pos, neg = y.sum(), n - y.sum()
        odds = np.log((own + 0.5) * (neg - other + 0.5) / ((other + 0.5) * (pos - own + 0.5)))
        error = np.sqrt(1 / (own + 0.5) + 1 / (other + 0.5) + 1 / (pos - own + 0.5) + 1 / (neg - other + 0.5))
        enough = (own + other >= MIN_DOCS) & (np.abs(odds) >= CHANCE * error)
        keep = enough[at]
        place = np.cumsum(enough) - 1
        rows, at, used = rows[keep], place[at[keep]], used[enough]
        theta = np.zeros(len(used) + dense.shape[1] + 1)
        theta[-1] = np.log(rate / (1 - rate))
        m = v = 0.0
        k = len(used)
        for t in range(1, rounds + 1):  # Adam over all rows at once: the same result every time
            z = np.bincount(rows, weights=theta[at], minlength=n) + dense @ theta[k:-1] + theta[-1]
            r = _sigmoid(z) - y
            g = np.concatenate([np.bincount(at, weights=r[rows], minlength=k), r @ dense, [r.sum()]])
            g[:-1] += l2 * theta[:-1]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta -= 0.1 * min(1.0, 20 / t) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.w[used], self.d, self.b = theta[:k], theta[k:-1], float(theta[-1])

    def logits(self, rows, cols, dense) -> np.ndarray:
        return np.bincount(rows, weights=self.w[cols], minlength=len(dense)) + dense @ self.d + self.b


class Chain:
    """Models in the order of the categories; ``labels`` is rows x categories."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, labels: np.ndarray, folds: np.ndarray):
        self.models, dense = [], np.zeros((len(labels), 0))
        for c in range(labels.shape[1]):
            y = labels[:, c].astype(np.float64)
            self.models.append(Linear(rows, cols, dense, y))
            out = np.zeros(len(y))
            for k in range(FOLDS):  # out-of-fold probabilities for the models that follow
                test = folds == k
                if not test.any():
                    continue
                number = np.cumsum(~test) - 1
                mine = ~test[rows]
                model = Linear(number[rows[mine]], cols[mine], dense[~test], y[~test], rounds=100) if c + 1 < labels.shape[1] else None
                if model:
                    number = np.cumsum(test) - 1
                    out[test] = model.logits(number[rows[~mine]], cols[~mine], dense[test])
            dense = np.column_stack([dense, _sigmoid(out)])

    def __call__(self, rows, cols, n) -> np.ndarray:
        dense = np.zeros((n, 0))
        for model in self.models:
            dense = np.column_stack([dense, _sigmoid(model.logits(rows, cols, dense))])
        return dense

    def weights(self) -> Chain:
        for m in self.models:
            m.w = m.w.astype(np.float32)
        return self


def flat(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and feature numbers of a list of feature arrays."""
    return np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate([*own, np.zeros(0, np.int32)]).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, chain: dict[str, str] | None = None) -> Chain:
    """Fit on at most ``limit`` labelled documents, those with the least hash of doc_id.

    Labels without a doc_id and labels that are null are left out; of several labels for one doc_id the
    highest counts, of several documents with one doc_id the text with the least 64-bit hash. Null and empty texts
    have no words. Without labelled documents every probability is next to 0.
    """
    chain = chain or CHAIN
    named = labels.where("doc_id is not null").select(F.col("doc_id").alias("_rk_id"), *[F.expr(rule).cast("int").alias(f"_rk_y{i}") for i, rule in enumerate(chain.values())])
    named = named.groupBy("_rk_id").agg(*[F.max(f"_rk_y{i}").alias(f"_rk_y{i}") for i in range(len(chain))]).dropna()
    sample = named.orderBy(F.xxhash64("_rk_id"), "_rk_id").limit(limit)
    joined = text_rows(docs.join(F.broadcast(sample), F.col("doc_id") == F.col("_rk_id")), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_rk_th"), *[F.col(f"_rk_y{i}") for i in range(len(chain))])

    def make():
        seen = Seen()

        def f(b):
            own = [features(t.decode("utf-8", "replace"), seen) for t in b.column("text").to_pylist()]
            return {"doc_id": b.column("doc_id"), "th": b.column("_rk_th"), "y": [list(y) for y in zip(*(b.column(f"_rk_y{i}").to_pylist() for i in range(len(chain))), strict=True)], "x": own}

        return f

    each = map_batches(joined, make, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, th long, y array<int>, x array<int>")
    found = each.groupBy("doc_id").agg(F.min_by("y", "th").alias("y"), F.min_by("x", "th").alias("x")).toArrow()
    order = np.argsort(np.array(found["doc_id"].to_pylist(), dtype=object), kind="stable")  # the same sums every time
    found = found.take(pa.array(order))
    y = np.array(found["y"].to_pylist(), np.int64).reshape(len(found), len(chain))
    rows, cols = flat([np.asarray(x, np.int32) for x in found["x"].to_pylist()])
    folds = np.array([zlib.crc32(str(i).encode()) % FOLDS for i in found["doc_id"].to_pylist()], np.int64)
    return Chain(rows, cols, y, folds).weights()


def classify(docs: DataFrame, model: Chain, names: list[str] | None = None) -> DataFrame:
    """The documents with a column p_<category> for each of the chain (named by ``names``).

    Null and empty texts have no words: the models' intercepts decide. Equal texts have equal probabilities, repeated
    rows stay, an empty table gives no rows, and a very long text counts whole, by its distinct words.
    """
    names = names or [f"p_{c}" for c in CHAIN]
    held = docs.sparkSession.sparkContext.broadcast(model)
    text_at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    own = docs.columns

    def make():
        seen = Seen()

        def f(b):
            x = [features(t or "", seen) for t in b.column(text_at).to_pylist()]
            p = held.value(*flat(x), len(x))
            return {c: b.column(i) for i, c in enumerate(own)} | {n: p[:, i] for i, n in enumerate(names)}

        return f

    return map_batches(docs, make, StructType([*docs.schema.fields, *(StructField(n, DoubleType()) for n in names)]))


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, toxic of every document."""
    docs = documents(spark, sf_dir)
    scored = classify(docs.select("doc_id", "text"), train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= THRESHOLD).alias("toxic"))
