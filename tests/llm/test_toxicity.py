import zlib

import numpy as np
import pytest

from reckon.llm import toxicity

SCHEMA = "doc_id long, text string, p_toxic string, toxic int"


def table(spark, pairs):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in pairs], SCHEMA)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def texts(n=120):
    out = []
    for i in range(n):
        words = [f"w{i % 7}", f"v{i % 5}", "the"] + (["scum"] if i % 4 == 0 else []) + (["junk", "!!"] if i % 3 == 0 else [])
        out.append((i, " ".join(words * (1 + i % 3))))
    return out


def dense_chain(rows, labels, folds):
    """The chain over a dense matrix, step by step: later categories see earlier out-of-fold probabilities."""
    vocab = sorted({f for r in rows for f in r})
    x = np.array([[f in r for f in vocab] for r in rows], float)

    def fit(dense, y, sel, rounds):
        xs, ds, ys = x[sel], dense[sel], y[sel]
        n, rate = len(ys), ys.mean() if len(ys) else 0.0
        if rate in (0.0, 1.0):
            return np.zeros(len(vocab)), np.zeros(dense.shape[1]), 40.0 if rate else -40.0
        own, other = xs.T @ ys, xs.T @ (1 - ys)
        pos, neg = ys.sum(), n - ys.sum()
        odds = np.log((own + 0.5) * (neg - other + 0.5) / ((other + 0.5) * (pos - own + 0.5)))
        error = np.sqrt(1 / (own + 0.5) + 1 / (other + 0.5) + 1 / (pos - own + 0.5) + 1 / (neg - other + 0.5))
        keep = (own + other >= toxicity.MIN_DOCS) & (np.abs(odds) >= toxicity.CHANCE * error)
        full = np.column_stack([xs[:, keep], ds, np.ones(n)])
        theta = np.zeros(full.shape[1])
        theta[-1] = np.log(rate / (1 - rate))
        m = v = 0.0
        for t in range(1, rounds + 1):
            g = full.T @ (sigmoid(full @ theta) - ys)
            g[:-1] += toxicity.L2 * theta[:-1]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - 0.1 * min(1.0, 20 / t) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w = np.zeros(len(vocab))
        w[keep] = theta[: keep.sum()]
        return w, theta[keep.sum() : -1], theta[-1]

    dense, models = np.zeros((len(rows), 0)), []
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        models.append(fit(dense, y, np.ones(len(y), bool), 200))
        out = np.zeros(len(y))
        if c + 1 < labels.shape[1]:
            for k in range(toxicity.FOLDS):
                test = folds == k
                w, d, b = fit(dense, y, ~test, 100)
                out[test] = x[test] @ w + dense[test] @ d + b
        dense = np.column_stack([dense, sigmoid(out)])
    p = np.zeros((len(rows), 0))
    for w, d, b in models:
        p = np.column_stack([p, sigmoid(x @ w + p @ d + b)])
    return p


def test_query_against_a_chain_over_a_dense_matrix(spark, tmp_path):
    docs = texts()
    labels = [(i, int(i % 3 != 0), int(i % 4 == 0)) for i, _ in docs]
    table(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r for r in toxicity.op10_toxicity_chain(spark, str(tmp_path)).collect()}
    seen = toxicity.Seen()
    rows = [set(toxicity.features(t, seen).tolist()) for _, t in docs]
    y = np.array([[1 - q, t] for _, q, t in labels])
    want = dense_chain(rows, y, np.array([zlib.crc32(str(i).encode()) % toxicity.FOLDS for i, _ in docs]))
    for i, _ in docs:
        assert abs(got[i].p_low_quality - want[i, 0]) < 1e-4 and abs(got[i].p_toxic - want[i, 1]) < 1e-4
        assert got[i].toxic == (got[i].p_toxic >= toxicity.THRESHOLD) == (i % 4 == 0)


def test_ties_of_doc_id_do_not_depend_on_the_run(spark):
    docs = texts(60) + [(3, "scum other text"), (3, None), (5, texts(60)[5][1])]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(60)] + [(3, 1, 0)], "doc_id long, quality int, toxic int")
    p = []
    for parts in (1, 5):
        df = table(spark, docs[::-1] if parts == 5 else docs).repartition(parts)
        out = toxicity.classify(df, toxicity.train(df, labels), ["_rk_low", "_rk_toxic"])
        assert out.columns == [*df.columns, "_rk_low", "_rk_toxic"]
        p.append(sorted((r.doc_id, r.text or "", round(r._rk_low, 9), round(r._rk_toxic, 9)) for r in out.collect()))
    assert p[0] == p[1] and len(p[0]) == 63


@pytest.mark.parametrize("labelled", [True, False])
def test_empty_tables(spark, labelled):
    labels = spark.createDataFrame([(1, 1, 0)] if labelled else [], "doc_id long, quality int, toxic int")
    model = toxicity.train(table(spark, []), labels)
    assert toxicity.classify(table(spark, []), model, ["_rk_low", "_rk_toxic"]).collect() == []
    assert all(r._rk_toxic < 0.01 for r in toxicity.classify(table(spark, [(1, "a"), (2, None)]), model, ["_rk_low", "_rk_toxic"]).collect())
