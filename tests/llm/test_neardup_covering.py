import xxhash

import corpus_pipeline
from reckon.llm import neardup, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def bits(a, b):
    return (simhash.fingerprint(a.encode(), neardup.SHINGLE) ^ simhash.fingerprint(b.encode(), neardup.SHINGLE)).bit_count()


def test_stage_proposes_by_covering_simhash(spark, monkeypatch):
    monkeypatch.setattr(neardup, "band_keys", lambda h: [xxhash.xxh64_intdigest(h.tobytes()) >> 1])  # bands propose no pair of different sets
    texts = [" ".join(f"d{k}w{i}" for i in range(600)) for k in range(30)]
    phrase = " ".join(f"p{i}" for i in range(10))
    texts += [" ".join([phrase] * 300 + [f"q{k}x{i}" for i in range(20)]) for k in range(2)]  # few bits apart, but not similar
    assert bits(*texts[30:]) <= simhash.RADIUS
    copies = {100 + k: t + " changed" for k, t in enumerate(texts[:30])}
    twice = {200: texts[0] + " " + texts[0]}  # the same shingles but four, another SimHash or the same
    rows = dict(enumerate(texts)) | copies | twice
    near = {100 + k for k in range(30) if bits(texts[k], copies[100 + k]) <= simhash.RADIUS}
    near |= {200} if min(bits(twice[200], texts[0]), bits(twice[200], copies[100])) <= simhash.RADIUS else set()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], SCHEMA)
    got = {r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, "").collect()}
    assert len(near) > 20 and got == set(rows) - near
