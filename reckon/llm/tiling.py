"""Benchmark decontamination by greedy string tiling.

Karp-Rabin: every window of MIN_MATCH tokens of a test item is hashed, and windows that a document shares with it
seed the search. The longest run of free tokens that both share is marked again and again, found by window hashes
of falling length. An item counts as leaked when its marked tokens cover enough of it, in whatever order the
passages stand.

An item of n tokens needs ceil(COVERAGE * n) of them covered, and a tile of l tokens holds l - MIN_MATCH + 1 >= l /
MIN_MATCH windows, so r = ceil(needed / MIN_MATCH) of its windows must stand in the document. All but its r - 1
commonest windows are its seeds: no leak misses them all, while phrases that many items share propose nothing.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import documents, map_batches, plain_words, stored

MIN_MATCH, COVERAGE = 5, 0.8
#: Bytes of test items that every task may hold; beyond, documents and items meet in a shuffle of window hashes.
HELD_BYTES = 8 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mixed(ids: np.ndarray) -> np.ndarray:
    """Token numbers as random-looking 64-bit numbers."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running Karp-Rabin sums (mod 2^64) and the powers of the base, for windows of any length."""
    power = np.full(len(values) + 1, np.uint64(_BASE))
    power[0] = 1
    power = np.multiply.accumulate(power)
    # sum of value[i] * base^i: windows are compared after a shift to a common power
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[:-1], dtype=np.uint64)]), power


def windows(sums: np.ndarray, power: np.ndarray, at: np.ndarray, length: int, top: int) -> np.ndarray:
    """Hashes of the windows of ``length`` that start ``at``, all raised to the power ``top``."""
    return (sums[at + length] - sums[at]) * power[top - at]


def window_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k tokens, given as 64-bit numbers."""
    n = len(tokens) - k + 1
    h = np.zeros(max(0, n), np.uint64)
    for j in range(k):
        h = h * np.uint64(_BASE) + tokens[j : j + n]
    return h


def _runs(free: np.ndarray) -> np.ndarray:
    """For each position how many free ones follow on it, itself included."""
    taken = np.flatnonzero(~free)
    at = np.arange(len(free))
    following = np.searchsorted(taken, at)
    return np.append(taken, len(free))[following] - at


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> int:
    """How many item tokens greedy tiling covers; negative tokens of the document match nothing.

    The longest common run of free tokens is marked first; of equally long ones the first in the item, then the
    first in the document. Memory is linear in both, whatever repeats.
    """
    item_free, doc_free = np.ones(len(item), bool), doc >= 0
    both = np.concatenate([mixed(item), mixed(doc)])
    sums, power = prefixes(both)
    top, n = len(both), len(item)

    def common(length: int) -> tuple[int, int] | None:
        i, j = np.flatnonzero(item_runs >= length), np.flatnonzero(doc_runs >= length)
        if not len(i) or not len(j):
            return None
        a, b = windows(sums, power, i, length, top), windows(sums, power, j + n, length, top)
        hit = i[np.isin(a, b)]
        for at in hit.tolist():  # hashes only propose
            for to in j[b == a[np.searchsorted(i, at)]].tolist():
                if (item[at : at + length] == doc[to : to + length]).all():
                    return at, to
        return None

    longest = min(len(item), len(doc))
    while longest >= least:
        item_runs, doc_runs = _runs(item_free), _runs(doc_free)
        low, high, found = least, min(longest, int(item_runs.max(initial=0)), int(doc_runs.max(initial=0))), None
        while low <= high:  # a common run of some length holds one of each shorter length
            middle = (low + high + 1) // 2 if found else low
            if place := common(middle):
                found, low = (middle, *place), middle + 1
            else:
                if not found:
                    break
                high = middle - 1
        if not found:
            break
        longest, i, j = found
        item_free[i : i + longest] = False
        doc_free[j : j + longest] = False
    return int(len(item) - item_free.sum())


class Item:
    """One test item: its tokens, and how many must be covered."""

    def __init__(self, words: list[bytes], least: int, coverage: float):
        self.vocab: dict[bytes, int] = {}
        self.ids = np.fromiter((self.vocab.setdefault(w, len(self.vocab)) for w in words), np.int64, len(words))
        self.size, self.least = len(words), min(least, len(words))
        self.needed = max(1, int(np.ceil(coverage * self.size - 1e-9)))
        if len(words) < least:  # stands whole, or not at all
            self.needed = self.size
        self.hashes = window_hashes(token_hashes(words), self.least)

    def seeds(self, common: np.ndarray) -> np.ndarray:
        """Places of the windows that propose this item, given how common each is."""
        spare = -(-self.needed // self.least) - 1
        order = np.argsort(common, kind="stable")
        return order[: max(1, len(order) - spare)]

    def covered(self, words: list[bytes], hashes: np.ndarray) -> int:
        """Tokens of the item that tiles of a document cover, 0 if they are surely too few."""
        present = np.flatnonzero(np.isin(self.hashes, hashes))
        if not len(present):
            return 0
        reach = np.zeros(self.size + 1, np.int64)
        np.add.at(reach, present, 1)
        np.add.at(reach, present + self.least, -1)
        if np.count_nonzero(np.cumsum(reach)[:-1]) < self.needed:  # all that tiles could ever cover
            return 0
        places = np.flatnonzero(np.isin(hashes, self.hashes))
        near = np.zeros(len(words) + 1, np.int64)
        np.add.at(near, places, 1)
        np.add.at(near, places + self.least, -1)
        use = np.flatnonzero(np.cumsum(near)[:-1])
        gaps = np.flatnonzero(np.diff(use) > 1) + 1  # a token that matches nothing stands between stretches
        doc = np.fromiter((self.vocab.get(words[i], -1) for i in use.tolist()), np.int64, len(use))
        return tile(self.ids, np.insert(doc, gaps, -1), self.least)


def token_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Items:
    """Test items, ready to be sought in documents."""

    def __init__(self, items: list[tuple[object, str]], least: int = MIN_MATCH, coverage: float = COVERAGE):
        self.names, self.items, self.least = [], [], least
        for name, text in items:
            if w := plain_words(text or ""):
                self.names.append(name)
                self.items.append(Item(w, least, coverage))
        #: by length of window: the seeds in order, with the items they propose, and all known words
        self.index: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.known = {w for x in self.items for w in x.vocab}
        for k in sorted({x.least for x in self.items}):
            own = [i for i, x in enumerate(self.items) if x.least == k]
            each, count = np.unique(np.concatenate([np.unique(self.items[i].hashes) for i in own]), return_counts=True)
            seeds, where = [], []
            for i in own:
                h = self.items[i].hashes
                seeds.append(np.unique(h[self.items[i].seeds(count[np.searchsorted(each, h)])]))
                where.append(np.full(len(seeds[-1]), i))
            order = np.argsort(np.concatenate(seeds), kind="stable")
            self.index[k] = np.concatenate(seeds)[order], np.concatenate(where)[order]

    def find(self, text: str) -> dict[int, int]:
        """Item number to covered tokens, for items that are covered enough."""
        w = plain_words(text)
        mark = np.fromiter(map(self.known.__contains__, w), bool, len(w))
        out: dict[int, int] = {}
        for k, (seeds, where) in self.index.items():
            unknown = np.concatenate([[0], np.cumsum(~mark)])
            at = np.flatnonzero(unknown[k:] == unknown[:-k]) if len(w) >= k else np.zeros(0, np.int64)
            if not len(at):
                continue
            hashes = np.zeros(len(w) - k + 1, np.uint64)
            use = np.flatnonzero(np.bincount((at[:, None] + np.arange(k)).ravel(), minlength=len(w)))
            tokens = np.zeros(len(w), np.uint64)
            tokens[use] = token_hashes([w[i] for i in use.tolist()])
            hashes[at] = window_hashes(tokens, k)[at]
            mine = np.unique(hashes[at])
            lo, hi = np.searchsorted(seeds, mine, "left"), np.searchsorted(seeds, mine, "right")
            n = hi - lo
            if not n.any():
                continue
            proposed = np.unique(where[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
            for i in proposed.tolist():
                n = self.items[i].covered(w, hashes)
                if n >= self.items[i].needed:
                    out[i] = n
        return out


def _hits_kind(items: DataFrame) -> ArrayType:
    return ArrayType(StructType([StructField("item_id", items.schema["item_id"].dataType), StructField("coverage", DoubleType())]))


def _ordered(hits: list[dict]) -> list[dict]:
    return sorted(hits, key=lambda x: (x["item_id"] is None, x["item_id"] or 0, -x["coverage"]) if not isinstance(x["item_id"], str) else (False, x["item_id"], -x["coverage"]))


def decontaminate(docs: DataFrame, items: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE, column: str = "_rk_hits") -> DataFrame:
    """The documents with a column of hits: array of (item_id, coverage), by item_id, nulls last.

    A hit is an item (item_id of any type, text) of whose tokens the share ``coverage`` or more is tiled. Items that
    agree in item_id and text are one; null and empty items match nothing, items shorter than ``least`` tokens count
    when they stand whole. Null and empty documents have no hits, equal rows have equal ones, and empty tables give
    no rows, or no hits. Very long texts take memory in proportion to their length. Up to HELD_BYTES of items go to
    every task; more meet the documents by a shuffle.
    """
    items = items.select("item_id", "text").where("text is not null and text <> ''").dropDuplicates(["item_id", "text"])
    size = items.select(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > HELD_BYTES:
        return _shuffled(docs, items, least, coverage, column)
    held = docs.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in items.toLocalIterator()])
    text_at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    names = docs.columns

    def make():
        known = Items(held.value, least, coverage)

        def f(b):
            hits = []
            for text in b.column(text_at).to_pylist():
                found = known.find(text) if text else {}
                hits.append(_ordered([{"item_id": known.names[i], "coverage": n / known.items[i].size} for i, n in found.items()]))
            return {c: b.column(i) for i, c in enumerate(names)} | {column: hits}

        return f

    return map_batches(docs, make, StructType([*docs.schema.fields, StructField(column, _hits_kind(items))]))


def _hash_rows(rows: DataFrame, number: str, sizes: list[int]) -> DataFrame:
    """(number, k, h): the distinct hashes of windows of k tokens of each text."""

    def make():
        def f(b):
            for at, text in zip(b.column(number).to_pylist(), b.column("text").to_pylist(), strict=True):
                tokens = token_hashes(plain_words(text))
                for k in sizes:
                    h = np.unique(window_hashes(tokens, k)).view(np.int64)
                    if len(h):
                        yield {number: np.full(len(h), at), "k": np.full(len(h), k, np.int32), "h": h}

        return f

    return map_batches(rows.select(number, "text"), make, f"{number} long, k int, h long")


def _seed_rows(items: DataFrame, least: int, coverage: float) -> DataFrame:
    """(item, k, h): the seeds of each item."""

    def windows_of():
        def f(b):
            for at, text in zip(b.column("_rk_item").to_pylist(), b.column("text").to_pylist(), strict=True):
                if w := plain_words(text):
                    x = Item(w, least, coverage)
                    n = len(x.hashes)
                    yield {"_rk_item": np.full(n, at), "k": np.full(n, x.least, np.int32), "h": x.hashes.view(np.int64), "spare": np.full(n, min(n - 1, -(-x.needed // x.least) - 1), np.int32)}

        return f

    each = stored(map_batches(items.select("_rk_item", "text"), windows_of, "_rk_item long, k int, h long, spare int"), "windows")
    common = each.groupBy("k", "h").agg(F.count_distinct("_rk_item").alias("n"))
    place = F.row_number().over(Window.partitionBy("_rk_item").orderBy(F.col("n").desc(), "h"))
    return each.join(common, ["k", "h"]).withColumn("place", place).where("place > spare").select("_rk_item", "k", "h").distinct()


def _shuffled(docs: DataFrame, items: DataFrame, least: int, coverage: float, column: str) -> DataFrame:
    """As decontaminate(), for any amount of items: hashes meet in a join, then each proposed pair is tiled."""
    numbered = stored(docs.withColumn("_rk_row", F.monotonically_increasing_id()), "numbered")
    listed = stored(items.withColumn("_rk_item", F.monotonically_increasing_id()), "items")
    seeds = stored(_seed_rows(listed, least, coverage), "seeds")
    sizes = [r[0] for r in seeds.select("k").distinct().collect()]  # of 1 to least
    texts = numbered.where("text is not null").select("_rk_row", "text")
    met = _hash_rows(texts, "_rk_row", sizes).join(seeds, ["k", "h"]).select("_rk_row", "_rk_item").distinct()
    pairs = stored(met.join(listed.withColumnRenamed("text", "item"), "_rk_item").select("_rk_row", F.lit(1).alias("_rk_o"), "item_id", F.col("item").alias("text")), "pairs")
    own = texts.join(pairs.select("_rk_row").distinct(), "_rk_row", "left_semi").select("_rk_row", F.lit(0).alias("_rk_o"), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), "text")
    # the document first, then its items one by one, so that a task holds one of each
    laid = own.unionByName(pairs).repartition("_rk_row").sortWithinPartitions("_rk_row", "_rk_o")
    kind = items.schema["item_id"].dataType

    def make():
        held: dict = {}

        def f(b):
            out = {"_rk_row": [], "item_id": [], "coverage": []}
            for row, order, name, text in zip(*(b.column(c).to_pylist() for c in ("_rk_row", "_rk_o", "item_id", "text")), strict=True):
                if order == 0:
                    words = plain_words(text)
                    held.clear()
                    held.update(words=words, tokens=token_hashes(words))
                    continue
                x = Item(plain_words(text), least, coverage)
                if x.least not in held:
                    held[x.least] = window_hashes(held["tokens"], x.least)
                n = x.covered(held["words"], held[x.least])
                if n >= x.needed:
                    out["_rk_row"].append(row), out["item_id"].append(name), out["coverage"].append(n / x.size)
            return out

        return f

    schema = StructType([laid.schema["_rk_row"], StructField("item_id", kind), StructField("coverage", DoubleType())])
    hits = map_batches(laid, make, schema)
    order = F.struct(F.col("item_id").isNull().alias("n"), "item_id", (-F.col("coverage")).alias("c"), "coverage")
    listed_hits = hits.groupBy("_rk_row").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: F.struct(x["item_id"].alias("item_id"), x["coverage"].alias("coverage"))).alias(column))
    none = F.array().cast(_hits_kind(items))
    return numbered.join(listed_hits, "_rk_row", "left").withColumn(column, F.coalesce(column, none)).drop("_rk_row")


def op8_decontamination_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, n_items, best_coverage, item_ids of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    hits = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    h = F.col("_rk_hits")
    return hits.select(
        "doc_id",
        (F.size(h) > 0).alias("contaminated"),
        F.size(h).cast("long").alias("n_items"),
        F.coalesce(F.array_max(F.transform(h, lambda x: x["coverage"])), F.lit(0.0)).alias("best_coverage"),
        F.transform(h, lambda x: x["item_id"]).alias("item_ids"),
    )
