import random

import pytest

from reckon.llm import simhash


@pytest.fixture
def no_broadcast(spark):
    """Every broadcast of a row fails, as one too large for the driver does; Spark's own threshold stays."""
    key = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(key)
    spark.conf.set(key, "1b")
    yield
    spark.conf.set(key, before)


def near_copies(spark):
    """400 texts, and 100 with a word more at the end of 500."""
    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(5000)}" for _ in range(500)) for _ in range(400)]
    texts += [t + " more" for t in texts[:100]] + [None, "", texts[0]]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def test_simhash_broadcasts_nothing(spark, no_broadcast):
    with pytest.raises(Exception, match="(?i)broadcast"):  # the limit is in force
        spark.range(10).join(spark.range(20).hint("broadcast"), "id").collect()
    docs = near_copies(spark)
    got = {x.doc_id: x for x in simhash.simhash_groups(docs).collect()}
    fps = {i: int(x.fingerprint, 16) for i, x in got.items()}
    near = {i for i in range(100) if (fps[i] ^ fps[400 + i]).bit_count() <= 4}
    assert len(near) > 50 and all(got[400 + i].component_id == i for i in near)
    assert got[501].component_id == 500 and got[502].component_id == 0
    left = {x.doc_id for x in simhash.simhash_dedup(docs).collect()}
    assert left == {x.component_id for x in got.values()}
