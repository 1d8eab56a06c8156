"""Near-duplicates by the Jaccard similarity of word shingles: covering SimHash and MinHash propose, exact sets decide.

Each text is the set of its shingles' 64-bit hashes, and has a SimHash of them. The covering masks of op5 propose
every pair of texts whose SimHashes differ in up to ``radius`` bits. Texts at similarity 0.8 may differ in some 10
of 64 bits, and masks that cover 13 or more leave too few to tell texts apart, so that ``BANDS`` band keys of
``ROWS`` minimum hashes each propose as well: a pair at similarity s shares no key with probability
(1 - s^ROWS)^BANDS, which is 3e-6 at 0.8. Chains of what is proposed form groups, and within a group the sets are
compared exactly.
"""

from __future__ import annotations

from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, map_batches, met, numbered, stored, words

SHINGLE, BANDS, ROWS, SEED = 5, 24, 4, 42
#: A pair is linked from this similarity on: numerator and denominator, so that the test is in whole numbers.
SIMILAR = (4, 5)
#: Shingles of a group compared at once; larger groups are split into pairs of such blocks.
BLOCK = 4 << 20
_R = np.random.default_rng(SEED)
_XOR, _ODD = (_R.integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False) for _ in range(2))
_ODD |= np.uint64(1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingles(data: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than a shingle are one, no words are none."""
    w = words(data)
    if not w:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(islice(w, k, None) for k in range(SHINGLE)), strict=False)) if len(w) >= SHINGLE else [b" ".join(w)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed key a band; equal keys in a band are equal minimum hashes."""
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 4096):
        v = (hashes[at : at + 4096, None] ^ _XOR) * _ODD
        v ^= v >> np.uint64(29)
        v *= _MIX
        np.minimum(least, v.min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64).tolist()


def similar_links(lengths: np.ndarray, values: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of the sets laid end to end in ``values``: pairs of places, all similar enough."""
    m, owner = len(lengths), np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(values, kind="stable")
    _, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
    holders, first, start = owner[order], np.cumsum(count) - count, np.cumsum(lengths) - lengths
    over, under = SIMILAR
    free, out = np.ones(m, bool), []
    for root in range(m):
        if not free[root]:
            continue
        free[root], todo = False, [root]
        while todo and free.any():
            x = todo.pop()
            ids = inverse[start[x] : start[x] + lengths[x]]
            n = count[ids]
            at = np.repeat(first[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(holders[at], minlength=m)
            new = np.flatnonzero(free & (under * common >= over * (lengths + lengths[x] - common)))
            out += [(x, int(y)) for y in new]
            todo += new.tolist()
            free[new] = False
    return out


def _sign(docs: DataFrame) -> DataFrame:
    """(_rk_row, doc_id, fp, sim, n, keys): fp names the set of shingles, n is its size, sim is the text's SimHash."""

    def make():
        def f(b):
            fps, sims, sizes, keys, memo = [], [], [], [], {}
            for t in b.column("text").to_pylist():
                h = shingles(t)
                fp = xxhash.xxh64_intdigest(h.tobytes(), SEED)
                if fp not in memo:
                    memo[fp] = band_keys(h) if len(h) else []
                fps.append(fp), sims.append(simhash.fingerprint(t, SHINGLE)), sizes.append(len(h)), keys.append(memo[fp])
            fps, sims = (np.array(x, np.uint64).view(np.int64) for x in (fps, sims))
            return {"_rk_row": b.column("_rk_row"), "doc_id": b.column("doc_id"), "fp": fps, "sim": sims, "n": sizes, "keys": keys}

        return f

    rows = docs.select("_rk_row", "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return map_batches(rows, make, f"_rk_row struct<file:long,at:long>, doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long, sim long, n long, keys array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """(fp, root, blocks, set): the shingles of each text, as signed numbers."""

    def make():
        def f(b):
            return {c: b.column(c) for c in ("fp", "root", "blocks")} | {"set": [shingles(t).view(np.int64) for t in b.column("text").to_pylist()]}

        return f

    return map_batches(docs.select("fp", "root", "blocks", F.col("text").cast("binary").alias("text")), make, "fp long, root long, blocks int, set array<long>")


def _compare(group: pa.Table) -> pa.Table:
    sets = group.column("set").combine_chunks()
    sets = pa.concat_arrays(sets.chunks) if isinstance(sets, pa.ChunkedArray) else sets
    found = similar_links(np.diff(sets.offsets.to_numpy()), sets.flatten().to_numpy())
    fps = group.column("fp").to_pylist()
    return pa.table({"u": pa.array([fps[a] for a, _ in found], pa.int64()), "v": pa.array([fps[b] for _, b in found], pa.int64())})


def _covered(signed: DataFrame, radius: int) -> DataFrame:
    """(u, v): pairs of sets that join all whose texts have SimHashes within the radius, by op5's covering masks."""
    sims = stored(signed.where("n > 0").select("fp", "sim").distinct(), "sims")
    named = stored(sims.groupBy("sim").agg(F.min("fp").alias("least")), "named")  # a SimHash goes by the least of its sets
    near = simhash.links(named.select(F.col("sim").alias("fp")), radius)
    for c in ("u", "v"):
        near = near.join(named.select(F.col("sim").alias(c), F.col("least").alias(f"{c}_least")).hint("merge"), c)
    own = sims.join(named.hint("merge"), "sim").select(F.col("least").alias("u"), F.col("fp").alias("v"))
    return near.select(F.col("u_least").alias("u"), F.col("v_least").alias("v")).unionByName(own).where("u <> v")


def _links(docs: DataFrame, signed: DataFrame, radius: int) -> DataFrame:
    """(u, v): links between sets that join all that are similar enough."""
    one = stored(signed.where("n > 0").groupBy("fp").agg(F.min("_rk_row").alias("_rk_row"), F.min("n").alias("n"), F.min("keys").alias("keys")), "sets")
    # joins here are merges at every size, so that what they cost grows with the input alone
    keyed = one.select("fp", F.posexplode("keys").alias("t", "k")).select("fp", F.xxhash64("t", "k").alias("key"))
    least = keyed.groupBy("key").agg(F.min("fp").alias("u"), F.count("*").alias("c")).where("c > 1").select("key", "u")
    banded = keyed.join(least.hint("merge"), "key").select("u", F.col("fp").alias("v")).where("u <> v")
    root = components(_covered(signed, radius).unionByName(banded).distinct())
    rooted = root.unionByName(root.select(F.col("root").alias("node"), "root").distinct()).join(one.drop("keys").hint("merge"), F.col("node") == F.col("fp")).select("_rk_row", "fp", "n", "root")
    rooted = stored(rooted, "rooted")
    size = rooted.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    members = stored(rooted.join(size.hint("merge"), "root"), "members")
    each = _sets(met(docs.select("_rk_row", "text"), members, "inner"))
    each = each.withColumn("b", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = each.select("fp", "set", "root", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select("fp", "set", "root", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    return dealt.groupBy("root", "i", "j").applyInArrow(_compare, "u long, v long")


def near_dedup(docs: DataFrame, radius: int = simhash.RADIUS) -> DataFrame:
    """One row of each group linked at Jaccard similarity 0.8 or more of 5-word shingles: that with the least doc_id, nulls last.

    ``radius`` is that of the covering SimHash, which proposes beside MinHash. Texts without words are one group. Rows are told apart by a number of their own, so that of repeated
    rows, and of copies whose doc_id is null, one stays.
    """
    rows = numbered(docs)
    signed = stored(_sign(rows), "signed")
    root = components(_links(rows, signed, radius))
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_rk_row")
    each = signed.groupBy("fp").agg(F.min(place).alias("p"))
    group = each.join(root.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "p", F.coalesce("root", "fp").alias("root"))
    low = group.groupBy("root").agg(F.min("p").alias("low"))
    first = stored(group.join(low.hint("merge"), "root").select("fp", F.col("low._rk_row").alias("_rk_first")), "first")
    lost = signed.select("fp", "_rk_row").join(first.hint("merge"), "fp").where("_rk_row <> _rk_first").select("_rk_row")
    return met(rows, stored(lost, "lost"), "left_anti").select(*docs.columns)
