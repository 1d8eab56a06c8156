"""The registered queries over a small table, each column against plain Python."""

import hashlib
import zlib

import duckdb
import pytest
from test_operators import PLAIN, awkward, brute_fingerprint, brute_lines, brute_spans, table

from reckon.llm import bpe, linededup, registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    run = "\n".join(f"line {i} with several words of its own {i}" for i in range(6))
    texts = awkward(21, 40) + [run, "head\n" + run + "\ntail", "call +1.2.3.4.5.6.7.8 or 1.2.3.4", "4539 1488 0343 6467 and a@b.co, x@y.z", "IBAN BE68 5390 0754 7034 Please"]
    path = tmp_path_factory.mktemp("queries")
    table(spark, texts).repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path), texts


def rows(spark, folder, name):
    got = registry.QUERIES[name](spark, folder[0]).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(folder[1])))
    return {r.doc_id: r for r in got}


def test_op3(spark, folder):
    want = {i: (t, 0) for i, t in enumerate(folder[1])}
    short = [(i, t) for i, t in enumerate(folder[1]) if t and t.count("\n") < 60 and len(t) < 3000]
    got = rows(spark, folder, "op3_line_dedup_suffix")
    want |= brute_lines(short, linededup.MIN_WORDS)
    assert {i: (got[i].text, got[i].n_deleted) for i, _ in short} == {i: want[i] for i, _ in short}
    assert got[len(folder[1]) - 4].text == "head\ntail"


def test_op3_equals_its_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder[0]}/documents.parquet/*.parquet'")
    got = rows(spark, folder, "op3_line_dedup_suffix")
    assert {r[0]: tuple(r[1:]) for r in con.execute(registry.ORACLES["op3_line_dedup_suffix"]).fetchall()} == {i: (r.text, r.n_deleted) for i, r in got.items()}


def test_op4(spark, folder):
    enc = bpe.TreeBPE().enc
    for i, r in rows(spark, folder, "op4_bpe_tree").items():
        ids = enc.encode_ordinary(folder[1][i] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((folder[1][i] or "").encode()).hexdigest()


def test_op5(spark, folder):
    fps = [brute_fingerprint(t) for t in folder[1]]
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for a in range(len(fps)):
            for b in range(a):
                if root[a] != root[b] and (fps[a] ^ fps[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    got = rows(spark, folder, "op5_simhash_covering")
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fps[i]:016x}", root[i]) for i in got}


def test_op6(spark, folder):
    for i, r in rows(spark, folder, "op6_pii_checksums").items():
        spans = brute_spans(folder[1][i])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in spans) for x in PLAIN)
        told = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("iban")] == told
        assert 0 <= r.top_score <= 1 and (r.top_score > 0) == bool(r.spans)


def test_op9(spark, folder):
    got, by = rows(spark, folder, "op9_rendezvous_sharding"), {}
    for i, r in got.items():
        data = (folder[1][i] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "key")
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
