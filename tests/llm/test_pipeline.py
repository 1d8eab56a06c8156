import hashlib

from reckon.llm import bpe


def test_pipeline_end_to_end(spark, tmp_path):
    import __spark_entry__
    import corpus_pipeline

    line = " ".join(f"passage{i}" for i in range(60))
    body = lambda k, n=80: "\n".join(" ".join(f"d{k}w{j}x{i}" for i in range(10)) for j in range(n // 10))
    texts = {i: body(i) for i in range(40)}
    texts |= {40: body(0), 41: body(1).replace("d1w3x3", "changed"), 42: body(50) + "\n" + line, 43: body(51) + "\n" + line, 44: body(52) + " secret " + " ".join(f"bench{i}" for i in range(30))}
    texts |= {100 + i: body(100 + i) + (" vile" if i % 2 else "") for i in range(60)}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100 + i, 1, i % 2) for i in range(50)] + [(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(f"bench{i}" for i in range(30)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in __spark_entry__.queries()["pipeline"](spark, str(tmp_path)).collect()}
    toxic = {100 + i for i in range(60) if i % 2}
    assert set(got) == set(texts) - toxic - {40, 44}
    enc = bpe.TreeBPE().enc
    kept = texts | {43: body(51), 41: texts[41].split("\n")[3]}  # line dedup leaves the one changed line of 41
    for i in got:
        ids = enc.encode_ordinary(kept[i])
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and got[i].n_tokens == len(ids)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
