"""SimHash near-duplicates: covering locality-sensitive hashing finds every pair within the radius.

A fingerprint has 64 bits over the shingles of a text. Masks: each bit position i gets a non-zero
vector f(i) of radius+1 bits, and mask v (of 2^(radius+1)-1) keeps the positions with an odd f(i)&v.
Up to ``radius`` differing positions span at most ``radius`` dimensions, so some v is orthogonal to
all of them: in that table the pair agrees on the whole mask. No link is missed.
"""

from __future__ import annotations

from itertools import islice, repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, documents, map_batches, stored, text_rows, words

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Distinct fingerprints compared at once; larger buckets are split into pairs of such blocks.
BLOCK = 8192


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash, unsigned. No words: zero; fewer words than a shingle: the whole sequence is one."""
    w = words(data)
    if not w:
        return 0
    if len(w) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)  # the only h: its bits are the majority
    n = len(w) - shingle + 1
    hashes = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(islice(w, k, None) for k in range(shingle)), strict=False)), repeat(SEED))
    ones, left = np.zeros(64, np.int64), n
    while left:
        h = np.fromiter(hashes, "<u8", min(left, 1 << 16))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        left -= len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, fp) and the columns in ``more``: fp as a signed 64-bit number."""

    def make():
        def f(b):
            fps = np.fromiter((fingerprint(t) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
            return {x: b.column(x) for x in kept} | {"fp": fps.view(np.int64)}

        return f

    rows = text_rows(docs, *more)
    kept = [c for c in rows.columns if c != "text"]
    return map_batches(rows, make, ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept), "fp long"]))


def masks(radius: int = RADIUS) -> list[int]:
    """Signed 64-bit masks that cover every set of up to ``radius`` bits."""
    n = 2 ** (radius + 1) - 1
    out = []
    for v in range(1, n + 1):
        m = sum(1 << i for i in range(64) if ((i % n + 1) & v).bit_count() % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _apart(a: np.ndarray, b) -> np.ndarray:
    """Differing bits; unsigned, since bitwise_count takes the absolute value of signed numbers."""
    return np.bitwise_count((a ^ b).view(np.uint64))


class _Links:
    """Spanning links of the buckets in rows sorted by bucket; keeps a union-find of its own."""

    def __init__(self, radius: int):
        self.radius, self.parent, self.keys, self.fps = radius, {}, None, None

    def find(self, x: int) -> int:
        p = self.parent
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = x = p[p[x]]
        return x

    def join(self, us, vs) -> list[tuple[int, int]]:
        if len(self.parent) > 2_000_000:
            self.parent.clear()  # only costs repeated links
        out = []
        for u, v in zip(us.tolist(), vs.tolist(), strict=True):
            a, b = self.find(u), self.find(v)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                out.append((u, v))
        return out

    def __call__(self, batch):
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j")], axis=1)
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        if self.keys is not None:
            keys, fps = np.concatenate([self.keys, keys]), np.concatenate([self.fps, fps])
        if (keys[0] == keys[-1]).all():
            last = 0
        else:
            last = int(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))[-1]) + 1
        self.keys, self.fps = keys[last:], fps[last:]
        return self.out(keys[:last], fps[:last])

    def end(self):
        if self.keys is not None:
            yield self.out(self.keys, self.fps)

    def out(self, keys, fps):
        found = []
        if len(fps) > 1:
            starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1])
            sizes = np.diff(np.append(starts, len(fps)))
            size = np.repeat(sizes, sizes)
            place = np.arange(len(fps)) - np.repeat(starts, sizes)
            for k in range(1, 33):  # small buckets, all at once
                at = np.flatnonzero((size <= 32) & (place + k < size))
                if not len(at):
                    break
                at = at[_apart(fps[at], fps[at + k]) <= self.radius]
                found += self.join(fps[at], fps[at + k])
            for s, n in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist(), strict=True):
                found += self.large(fps[s : s + n])
        return {"u": [x[0] for x in found], "v": [x[1] for x in found]}

    def large(self, fps):
        """Grow one component at a time: each fingerprint is compared once with all that are still free."""
        free, out = np.unique(fps), []
        while len(free) > 1:
            todo, free = [free[0]], free[1:]
            while todo and len(free):
                x = todo.pop()
                near = _apart(free, x) <= self.radius
                new = free[near]
                if len(new):
                    out += self.join(np.full(len(new), x), new)
                    todo += new.tolist()
                    free = free[~near]
        return out


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) that join all within the radius.

    A bucket with more than BLOCK fingerprints is dealt in blocks, and pairs of blocks meet.
    """
    table = fps.select("fp").distinct()
    keyed = table.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(radius)])).alias("t", "k")).select("fp", F.xxhash64("t", "k").alias("key"))
    met = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    n = F.ceil(F.col("n") / BLOCK).cast("int")
    # joins here are merges at every size: a broadcast goes through the driver, which 10 MB of packed rows can fill
    hit = keyed.join(met.hint("merge"), "key").withColumn("n", n).withColumn("b", F.pmod(F.xxhash64("fp", "key"), F.col("n")).cast("int"))
    split = hit.select("fp", "key", "b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o")).select("fp", "key", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    dealt = split.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return map_batches(dealt.select("key", "i", "j", "fp"), lambda: _Links(radius), "u long, v long").distinct()


def simhash_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents linked at ``radius`` or fewer differing bits.

    Equal rows get equal values; null or empty texts have fingerprint zero; component_id is the least
    doc_id reachable (null only if all are null). An empty table gives no rows.
    """
    rows = stored(fingerprints(docs), "simhash")
    named = _lowest(rows, F.col("doc_id"), radius)
    return rows.join(named.hint("merge"), F.col("fp") == F.col("_rk_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("_rk_low").alias("component_id"))


def _lowest(rows: DataFrame, place: Column, radius: int) -> DataFrame:
    """(_rk_fp, _rk_low): the least ``place`` in the component of each fingerprint."""
    root = components(links(rows, radius))
    each = rows.groupBy("fp").agg(F.min(place).alias("_rk_own"))
    rooted = each.join(root.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "_rk_own", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    low = rooted.groupBy("root").agg(F.min("_rk_own").alias("_rk_low"))
    return rooted.join(low.hint("merge"), "root").select(F.col("fp").alias("_rk_fp"), "_rk_low")


def simhash_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents, one of each linked group: that with the least doc_id (nulls last), then hash of the text.

    Rows that agree in doc_id and text are one document, and stay or go alike. Null and empty texts have
    fingerprint zero and are one group. An empty table gives no rows.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = stored(fingerprints(docs, text.alias("_rk_th")), "simhash")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_rk_th")
    named = _lowest(rows, place, radius)
    lost = rows.join(named.hint("merge"), F.col("fp") == F.col("_rk_fp")).where(place != F.col("_rk_low")).select(F.col("doc_id").alias("_rk_lost"), "_rk_th").distinct()
    own = docs.withColumn("_rk_own_th", text)
    return own.join(lost.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_rk_lost")) & (F.col("_rk_own_th") == F.col("_rk_th")), "left_anti").drop("_rk_own_th")


def op5_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))
