"""Each operator against brute force on small tables that hold nulls, empties, repeats and long texts."""

import hashlib
import io
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from reckon.llm import audio, bpe, linededup, pii, resampling, sharding, simhash, toxicity
from reckon.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part long, total string"


def table(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), None, "x") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def awkward(seed=0, n=60):
    r = random.Random(seed)
    vocab = ["alpha", "Beta", "gamma", "né", "delta.", "x1", "the", "of", "漢字", "a@b.co"]
    out = [None, "", " \n\t ", "one", "two words", "word " * 3000, "x" * 5000]
    while len(out) < n:
        out.append(r.choice(["", "\n"]).join(r.choice(vocab) + r.choice([" ", "  ", "\n"]) for _ in range(r.randint(1, 60))))
    return out + out[-3:]


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- SimHash


def test_masks_cover_every_pair_in_the_radius():
    ms = [m & (1 << 64) - 1 for m in simhash.masks(4)]
    assert len(ms) == 31
    r = random.Random(1)
    for _ in range(5000):
        d = sum(1 << i for i in r.sample(range(64), r.randint(1, 4)))
        assert any(d & m == 0 for m in ms)


def brute_fingerprint(text):
    w = [x for x in (text or "").encode().lower().replace(b"\r", b" ").replace(b"\n", b" ").replace(b"\t", b" ").split(b" ") if x]
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h)) if h else 0


def test_simhash_components_against_all_pairs(spark):
    texts = awkward(3)
    base = " ".join(f"w{i}" for i in range(400))
    texts += [base.replace(f"w{i} ", "zz ") for i in range(3, 40, 4)] + [base]
    fps = [brute_fingerprint(t) for t in texts]
    near = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a, b in combinations(range(len(texts)), 2):
            if (fps[a] ^ fps[b]).bit_count() <= 4 and near[a] != near[b]:
                near[a] = near[b] = min(near[a], near[b])
                changed = True
    got = {r[0]: (r[1], r[2]) for r in rows(simhash.simhash_groups(table(spark, texts)))}
    assert got == {i: (f"{fps[i]:016x}", near[i]) for i in range(len(texts))}
    left = {r.doc_id for r in simhash.simhash_dedup(table(spark, texts)).collect()}
    assert left == set(near)


def test_simhash_dedup_of_repeated_rows_and_null_ids(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    df = table(spark, [one, two, one, one, two, three, three, None, "", three + " x"], [5, 5, 3, None, None, None, None, 8, None, 9])
    got = sorted(((x.doc_id, x.text) for x in simhash.simhash_dedup(df).collect()), key=str)
    near = (simhash.fingerprint(three.encode()) ^ simhash.fingerprint((three + " x").encode())).bit_count() <= 4
    assert near
    assert got == sorted([(3, one), (5, two), (9, three + " x"), (8, None)], key=str)
    alone = table(spark, [three, three, one], [None, None, 7])
    assert sorted((x.doc_id or 0, x.text) for x in simhash.simhash_dedup(alone).collect()) == sorted([(0, three), (0, three), (7, one)])


def test_large_buckets_lose_no_link(spark, monkeypatch):
    r = random.Random(5)
    fps = {0}
    while len(fps) < 300:
        fps.add(r.choice(sorted(fps)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    fps |= {r.getrandbits(64) for _ in range(50)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    monkeypatch.setattr(simhash, "BLOCK", 40)
    root = dict(rows(components(simhash.links(df))))
    seen, want = set(), {}
    for x in signed:
        if x in seen:
            continue
        group, todo = {x}, [x]
        while todo:
            y = todo.pop()
            new = {z for z in signed if z not in group and ((y ^ z) & (1 << 64) - 1).bit_count() <= 4}
            group |= new
            todo += new
        seen |= group
        want |= {z: min(group) for z in group}
    assert {x: root.get(x, x) for x in signed} == want


def test_components_of_a_long_chain(spark):
    order = list(range(200))
    random.Random(2).shuffle(order)
    e = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:], strict=False)] + [(500, 500), (900, 901)], "u long, v long")
    got = dict(rows(components(e)))
    assert got == {i: 0 for i in range(1, 200)} | {901: 900}


# --- BPE


def test_other_split_patterns_are_refused():
    with pytest.raises(ValueError, match="split pattern"):
        bpe.TreeBPE(pattern=r"\S+|\s+")


@pytest.mark.parametrize("leaf", [1, 3, 50, 1024])
def test_tree_equals_one_go(leaf):
    tree, r = bpe.TreeBPE(leaf=leaf, window=2), random.Random(leaf)
    for _ in range(300):
        text = "".join(r.choice("ab C1 2'st.,!\n\té ß漢字 　x's ll\r😀") for _ in range(r.randint(0, 200)))
        ids = tree.encode(text)
        assert ids.tolist() == tree.enc.encode_ordinary(text)
        assert tree.decode(ids) == text.encode()
    for text in ("a" * 20000, " " * 5000 + "b", "漢" * 3000, "don't" * 500):
        assert tree.encode(text).tolist() == tree.enc.encode_ordinary(text) if leaf > 3 else True


def test_bpe_query(spark):
    texts, enc = awkward(4), bpe.TreeBPE().enc
    got = {r[0]: tuple(r)[1:] for r in bpe.bpe_digests(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


# --- PII

import re  # noqa: E402

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            s = m[0]
            d = re.sub("[^0-9]", "", s)
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")[:4] if x.isdigit()), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_spans_against_plain_patterns(spark):
    r, texts = random.Random(7), [None, "", "mail a.b@c.de, d@e", "é😀 4539 1488 0343 6467 card", "ip 10.0.0.256 1.2.3.4.5.6.7.8", "+1 (555) 010-9999 tel", "a" * 30000, "1" * 20000, "a@b." * 2000, "x@y.z%q@r.s", "IBAN GB82 WEST 1234 5698 7654 32 and DE89370400440532013000.", "1 " * 5000, "+" * 3000, "@" * 2000]
    texts += ["".join(r.choice(["1", "4", "0", "9", ".", "-", " ", "+", "(", "@", "a", "Z", "b.c", "é", "25"]) for _ in range(r.randint(1, 120))) for _ in range(300)]
    digits = "".join(str(r.randrange(10)) for _ in range(15))
    texts += [digits + str(k) for k in range(10)]
    got = rows(pii.pii_spans(table(spark, texts)).select("doc_id", "_rk_spans"))
    for i, spans in got:
        assert [(s.kind, s.start, s.end) for s in spans if s.kind in PLAIN] == brute_spans(texts[i]), texts[i][:200]
    extra = [(s.kind, texts[10][s.start : s.end]) for s in dict(got)[10] if s.kind == "iban"]
    assert extra == [("iban", "GB82 WEST 1234 5698 7654 32"), ("iban", "DE89370400440532013000")]
    assert [s.score for s in dict(got)[5]] == [0.5] and [s.score for s in dict(got)[2]] == [1.0]
    red = dict(rows(pii.redact(table(spark, texts[:6]))))
    assert red[2] == "mail [email], d@e" and red[1] == ""


def test_pii_running_sums(spark):
    for n in (0, 1, 2, 7, 100):
        got = spark.range(1).select(pii.running(F.array(*[F.lit(i).cast("long") for i in range(n)]) if n else F.array().cast("array<bigint>"))).first()[0]
        assert got == np.cumsum(np.arange(n)).tolist()


# --- Sharding


def test_shards_move_only_into_the_new_one(spark):
    texts = awkward(8) * 5
    ids = [None if i % 50 == 0 else i // 2 for i in range(len(texts))]
    got = sharding.shard_rows(table(spark, texts, ids)).collect()
    assert len(got) == len(texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts, strict=True))
    by, key = {}, {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert key.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_rows_that_repeat_often_are_numbered_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 7)
    texts, ids = ["same"] * 100 + [None] * 50 + [f"t{i}" for i in range(60)] + ["", "same"], [1] * 100 + [None] * 50 + [i // 3 for i in range(60)] + [None, 2]
    got = sharding.shard_rows(table(spark, texts, ids), 3).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(t or "") + 16) for i, t in zip(ids, texts, strict=True))
    for s in range(3):
        mine = [r.slot for r in got if r.shard == s]
        assert sorted(mine) == list(range(len(mine)))


def test_weighted_shards_share_in_proportion(spark):
    s = sharding.rendezvous(F.col("id"), 3, [1.0, 2.0, 5.0])
    n = dict(rows(spark.range(20000).groupBy(s.alias("s")).count()))
    assert abs(n[0] / 20000 - 1 / 8) < 0.02 and abs(n[2] / 20000 - 5 / 8) < 0.02
    more = spark.range(20000).select(s.alias("a"), sharding.rendezvous(F.col("id"), 4, [1.0, 2.0, 5.0, 4.0]).alias("b"))
    assert more.where("a <> b and b <> 3").count() == 0 and 0.28 < more.where("b = 3").count() / 20000 < 0.39


# --- Audio


def test_audio_round_trip(spark, tmp_path):
    texts = awkward(9)
    table(spark, texts).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in audio.op2_audio_features(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        p = data + bytes(-len(data) % 64) if data else bytes(64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_sha256 == hashlib.sha256(audio.write_wav(p)).hexdigest() and r.media_bytes == len(p) + 44
    assert got[0].feature == got[1].feature and got[len(texts) - 1].feature == got[len(texts) - 4].feature


def test_audio_features_of_known_sound():
    f, t = audio.Features(), np.arange(32000) / 16000
    tone = np.where((t > 0.5) & (t < 1.5), 100 * np.sin(2 * np.pi * 1000 * t), 0)
    samples = np.clip(128 + tone, 0, 255).astype(np.uint8).tobytes()
    y = f.resample((np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128)
    want = np.where((np.arange(20000) / 10000 > 0.5) & (np.arange(20000) / 10000 < 1.5), 100 / 128 * np.sin(2 * np.pi * 1000 * np.arange(20000) / 10000), 0)
    assert len(y) == 20000 and np.abs(y[6000:14000] - want[6000:14000]).max() < 0.02
    mel, energy = f.frames(samples)
    (a, z), *rest = f.segments(energy)
    assert not rest and abs(a - 0.5) < 0.04 and abs(z - 1.5) < 0.04
    batch = pa.ipc.open_stream(io.BytesIO(f.tensors(mel))).read_all()
    assert batch["mel"].type.shape == [audio.FRAMES, audio.MELS] and batch["start"].to_pylist()[1] == 0.5
    assert np.array_equal(batch["mel"].combine_chunks().to_numpy_ndarray().reshape(-1, audio.MELS)[: len(mel)], mel)


# --- Line dedup


def brute_lines(docs, least):
    """docs: (id, text); delete line j if a run with enough words that holds it occurs earlier."""
    seqs = [(i, t.split("\n")) for i, t in docs if t]
    seqs.sort(key=lambda x: (x[0] is None, x[0]))
    first, out = {}, {}
    for d, (_, lines) in enumerate(seqs):
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[s:e]) >= least:
                    first.setdefault(tuple(lines[s:e]), (d, s))
    for d, (i, lines) in enumerate(seqs):
        dead = set()
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                if first.get(tuple(lines[s:e]), (d, s)) != (d, s):
                    dead |= set(range(s, e))
        out[i] = "\n".join(x for j, x in enumerate(lines) if j not in dead), len(dead)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_against_all_runs(spark, seed):
    r = random.Random(seed)
    pool = ["a b", "c", "d e f", "g h i j", "", "k l", "unique"]
    docs = [(i, "\n".join(r.choice(pool) if r.random() < 0.9 else f"only {r.random()}" for _ in range(r.randint(0, 12)))) for i in range(25)]
    docs += [(100, None), (101, ""), (102, "g h i j\ng h i j\ng h i j\ng h i j")]
    got = {x.doc_id: (x.text, x._rk_dead) for x in linededup.dedup_lines(table(spark, [t for _, t in docs], [i for i, _ in docs]), 8).collect()}
    want = {i: (t, 0) for i, t in docs} | brute_lines(docs, 8)
    assert got == want


def test_line_dedup_of_repeated_rows_and_null_ids(spark):
    run = "one two three four five\nsix seven eight"
    df = table(spark, [run, run, run, "x\n" + run + "\ny", None], [5, 5, None, 2, None])
    got = sorted(((x.doc_id, x.text, x.n_chars) for x in linededup.dedup_lines(df, 8).collect()), key=str)
    assert got == sorted([(5, "", 0), (5, "", 0), (None, "", 0), (2, "x\n" + run + "\ny", len(run) + 4), (None, None, None)], key=str)


def test_overlapping_runs_cost_their_lines_only(spark):
    runs = spark.range(50_000).selectExpr("1L as doc_id", "2L as th", "cast(id as int) as s", "cast(id + 20000 as int) as e")
    more = spark.createDataFrame([(1, 3, 5, 8), (1, 3, 0, 2), (1, 3, 6, 7), (None, 3, 1, 2)], "doc_id long, th long, s int, e int")
    got = {(r.doc_id, r.th): sorted(r.dead) for r in linededup.covered(runs.union(more)).collect()}
    assert got.pop((1, 2)) == list(range(69_999))
    assert got == {(1, 3): [0, 1, 5, 6, 7], (None, 3): [1]}


def test_line_dedup_of_many_blank_lines(spark):
    text = "\n" * 3000 + " ".join(f"w{i}" for i in range(25))
    got = {r.doc_id: (r.text, r._rk_dead) for r in linededup.dedup_lines(table(spark, [text, text], [1, 2])).collect()}
    assert got == {1: (text, 0), 2: ("", 3001)}


# --- Importance resampling


def test_resampling_weights_and_exact_top(spark):
    r = random.Random(15)
    good, bad = [f"g{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    texts = [" ".join(r.choice(good if i % 2 else bad) for _ in range(40)) for i in range(400)] + [None, ""]
    df = table(spark, texts)
    out = resampling.resample(df, spark.createDataFrame([(i,) for i in range(1, 200, 2)], "doc_id long"), 0.5).collect()
    n, raw, target = 1000, Counter(), Counter()
    seen = resampling.Hashes()
    for i, t in enumerate(texts):
        b = resampling.ngram_buckets((t or "").encode(), seen).tolist()
        raw.update(b)
        if i in range(1, 200, 2):
            target.update(b)
    n = resampling.BUCKETS
    ratio = lambda b: np.log((target[b] + 1) / (target.total() + n)) - np.log((raw[b] + 1) / (raw.total() + n))
    for x in out:
        b = resampling.ngram_buckets((texts[x.doc_id] or "").encode(), seen).tolist()
        assert x.n_ngrams == len(b) and abs(x.log_weight - sum(map(ratio, b))) < 1e-6
    top = {x.doc_id for x in sorted(out, key=lambda x: -x.gumbel_key)[:201]}
    assert {x.doc_id for x in out if x.selected} == top and sum(i % 2 for i in top if i < 400) > 195


def test_resampling_by_a_shuffle_and_of_empty_tables(spark, monkeypatch):
    df, target = table(spark, ["a b", "c d", None, "a b"], [1, 2, None, 1]), spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")
    held = sorted(map(str, rows(resampling.resample(df, target))))
    monkeypatch.setattr(resampling, "HELD_ROWS", 0)
    assert sorted(map(str, rows(resampling.resample(df, target)))) == held and len(held) == 4
    assert resampling.resample(table(spark, []), target).count() == 0
    assert resampling.resample(df, target.limit(0)).count() == 4


def test_kth_largest(spark):
    r = random.Random(16)
    xs = [r.gauss(0, 1) for _ in range(3000)] + [5.0] * 1500 + [-1e9, 1e9]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for k in (1, 2, 700, 1502, 1503, len(xs)):
        assert resampling.kth_largest(df, "x", k) == sorted(xs, reverse=True)[k - 1]


# --- Toxicity


def test_chain_learns_and_uses_earlier_categories(spark):
    r = random.Random(17)
    clean, rude, junk = [f"c{i}" for i in range(300)], ["scum", "oaf", "lout"], ["%%%", "@@"]
    texts, labels = [], []
    for i in range(900):
        w = [r.choice(clean) for _ in range(r.randint(5, 60))]
        low, tox = r.random() < 0.3, r.random() < 0.3
        texts.append(" ".join([*w, *r.sample(junk, 1) * low, *r.sample(rude, 1) * tox]))
        labels.append((i, int(not low), int(tox)))
    texts += [None, ""]
    df = table(spark, texts)
    lab = spark.createDataFrame([*labels[:600], (None, 1, 1), (5000, 1, 1), (601, None, 1)], "doc_id long, quality int, toxic int")
    out = {x.doc_id: x for x in toxicity.classify(df, toxicity.train(df, lab)).collect()}
    right = sum((out[i].p_toxic >= 0.5) == bool(t) for i, _, t in labels[600:])
    assert right >= 290 and sum((out[i].p_low_quality >= 0.5) != bool(q) for i, q, _ in labels[600:]) >= 290
    assert len(out) == 902 and out[900].p_toxic < 0.5
    model = toxicity.train(df, lab)
    assert model.models[1].d.shape == (1,) and model.models[0].d.shape == (0,)


def test_chain_without_labels(spark):
    df = table(spark, ["a b", None])
    out = toxicity.classify(df, toxicity.train(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert all(x.p_toxic < 0.5 for x in out.collect())


# --- All


@pytest.mark.parametrize("f", [simhash.simhash_groups, simhash.simhash_dedup, sharding.shard_rows, bpe.bpe_digests, linededup.dedup_lines, pii.redact, audio.audio_columns])
def test_empty_tables_and_odd_names(spark, f):
    assert f(table(spark, [])).count() == 0
    assert f(table(spark, ["a b c d e", None, "a b c d e"], [1, None, 1])).count() >= 1
