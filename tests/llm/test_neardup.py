import random
from itertools import combinations

import numpy as np

from reckon.llm import neardup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], SCHEMA)


def brute_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(texts):
    sets, group = [brute_shingles(t) for t in texts], list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a, b in combinations(range(len(texts)), 2):
            if group[a] != group[b] and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                group[a] = group[b] = min(group[a], group[b])
                changed = True
    return set(group)


def varied(seed):
    r, out = random.Random(seed), [None, "", " \n", "one", "two words", "One", "a b c d e", "a b c d e f"]
    for k in range(40):
        base = [f"w{k}x{i}" for i in range(r.randint(5, 200))]
        out.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            copy = list(base)
            for _ in range(r.randint(1, max(1, len(base) // 20))):
                copy[r.randrange(len(copy))] = f"n{r.random()}"
            out.append(" ".join(copy))
    return out


def test_near_dedup_against_all_pairs(spark, monkeypatch):
    texts = varied(1)
    df = table(spark, enumerate(texts))
    want = brute_kept(texts)
    assert {r.doc_id for r in neardup.near_dedup(df).collect()} == want and len(want) < len(texts)
    monkeypatch.setattr(neardup, "BLOCK", 50)  # every group meets in pairs of blocks
    assert {r.doc_id for r in neardup.near_dedup(df).collect()} == want


def test_links_at_the_limit_of_similarity():
    a = np.arange(90, dtype=np.int64)
    for moved, linked in ((10, True), (11, False)):  # 80 of 100 in common, 79 of 101
        b = np.concatenate([a[moved:], 1000 + np.arange(moved)])
        assert bool(neardup.similar_links(np.array([90, 90]), np.concatenate([a, b]))) == linked


def test_stage_drops_a_text_with_one_word_changed(spark):
    import corpus_pipeline

    body = lambda k: "\n".join(" ".join(f"d{k}w{j}x{i}" for i in range(10)) for j in range(8))
    # 41 as in test_pipeline; 50 has one word in 90 changed, too far for four bits of a fingerprint
    long = [f"l{i}" for i in range(900)]
    texts = {1: body(1), 2: body(2), 41: body(1).replace("d1w3x3", "changed"), 49: " ".join(long), 50: " ".join("zz" if i % 90 == 7 else w for i, w in enumerate(long))}
    got = {r.doc_id for r in corpus_pipeline.dedup_near(spark, table(spark, texts.items()), "").collect()}
    assert got == {1, 2, 49}
