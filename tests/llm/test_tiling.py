import random

import pytest

from reckon.llm import tiling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item_id int, coverage string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), 5, "x") for i, t in enumerate(texts)], SCHEMA)


def brute_tiles(a, b, least):
    """Longest free common run first, ties by item, then document place."""
    ua, ub, covered = [False] * len(a), [False] * len(b), 0
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ua[i + k] and not ub[j + k]:
                    k += 1
                if k >= least and (best is None or k > best[0]):
                    best = (k, i, j)
        if not best:
            return covered
        for k in range(best[0]):
            ua[best[1] + k] = ub[best[2] + k] = True
        covered += best[0]


def brute_hits(items, text, least=5, share=0.8):
    doc, out = tiling.plain_words(text or ""), []
    for name, item in items:
        w = tiling.plain_words(item or "")
        n = brute_tiles(w, doc, min(least, len(w))) if w else 0
        if w and n >= (share if len(w) >= least else 1) * len(w) - 1e-9:
            out.append((name, n / len(w)))
    return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, -x[1]))


def test_tiling_against_brute_force():
    r = random.Random(11)
    for _ in range(300):
        letters = "abcdef"[: r.randint(1, 6)]  # few letters: many windows repeat
        item = [r.choice(letters) for _ in range(r.randint(3, 14))]
        doc = [r.choice(letters) for _ in range(r.randint(0, 10))] + item[4:] + ["q"] + item[:5] + [r.choice(letters + "z") for _ in range(8)]
        known = tiling.Items([(1, " ".join(item))], 3)
        want = brute_tiles(item, doc, 3)
        assert known.find(" ".join(doc)).get(0, 0) == (want if want >= known.items[0].needed else 0)


@pytest.mark.parametrize("held", [8 << 20, 10])
def test_hits_against_brute_force_held_and_shuffled(spark, monkeypatch, held):
    monkeypatch.setattr(tiling, "HELD_BYTES", held)
    r = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    phrase = " ".join(f"p{i}" for i in range(8))
    items = [(i, phrase + " " + " ".join(r.choice(words) for _ in range(r.randint(2, 30)))) for i in range(30)]
    items += [(None, None), (90, ""), (91, "Short item!"), (91, "short item"), (92, items[0][1]), (None, items[1][1]), (0, items[0][1]), (93, "a a a a a a a a"), (94, "...")]
    whole = [x.split() for _, x in items[:30]]
    noise = lambda n: [r.choice(words) for _ in range(n)]
    docs = [noise(50) + x + noise(20) for x in whole[:6]] + [x[len(x) // 2 :] + noise(9) + x[: len(x) // 2] for x in whole] + [x[:12] for x in whole] + [[w.upper() + "," for w in whole[0]], (phrase.split() + ["x"]) * 40, ["a"] * 300]
    texts = [None, "", " \n ", *[" ".join(d) for d in docs], "a short item here", " ".join(docs[0])]
    bench = spark.createDataFrame([(i, x, 1) for i, x in items], "item_id long, text string, doc_id int")
    got = tiling.decontaminate(table(spark, texts), bench)
    assert got.columns == [*table(spark, texts[:1]).columns, "_rk_hits"]
    distinct = list(dict.fromkeys(items))
    for row in got.collect():
        assert [(h.item_id, round(h.coverage, 9)) for h in row._rk_hits] == [(n, round(c, 9)) for n, c in brute_hits(distinct, texts[row.doc_id])]
    named = spark.createDataFrame([("i-1", "Short item!"), (None, "short item")], "item_id string, text string")
    last = {x.doc_id: [h.item_id for h in x._rk_hits] for x in tiling.decontaminate(table(spark, texts), named).collect()}
    assert last[len(texts) - 2] == ["i-1", None] and last[0] == []


@pytest.mark.parametrize("held", [8 << 20, -1])
def test_empty_tables(spark, monkeypatch, held):
    monkeypatch.setattr(tiling, "HELD_BYTES", held)
    bench = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    assert tiling.decontaminate(table(spark, []), bench).collect() == []
    assert [x._rk_hits for x in tiling.decontaminate(table(spark, ["a b", None]), bench.where("item_id > 1")).collect()] == [[], []]


def test_a_long_text_of_equal_words_takes_linear_memory():
    assert tiling.Items([(1, "a " * 200)]).find("a " * 1_000_000) == {0: 200}


def test_a_phrase_that_many_items_share_proposes_none_of_them():
    r = random.Random(13)
    phrase = " ".join(f"p{i}" for i in range(8))
    items = [(i, phrase + " " + " ".join(f"w{r.randrange(100_000)}" for _ in range(32))) for i in range(20_000)]
    known = tiling.Items(items)
    assert known.find((phrase + " x ") * 300) == {}
    assert known.find(items[77][1]) == {77: 40}


def test_query(spark, tmp_path):
    r = random.Random(14)
    items = [(i, " ".join(f"b{r.randrange(60)}" for _ in range(20))) for i in range(8)]
    texts = [None, "", *[f"start {x} end" for _, x in items[:3]], " ".join(items[3][1].split()[10:] + ["cut"] + items[3][1].split()[:10]), "clean text of some words"]
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x.doc_id: x for x in tiling.op8_decontamination_tiling(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(len(texts)))
    for i, t in enumerate(texts):
        want = brute_hits(items, t)
        assert (got[i].contaminated, got[i].n_items, got[i].item_ids) == (bool(want), len(want), [n for n, _ in want])
        assert abs(got[i].best_coverage - max([c for _, c in want], default=0.0)) < 1e-9
