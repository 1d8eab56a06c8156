"""Language-model scoring with a weighted backoff automaton of order three over words.

States: the root, the start of a text, each word of the training texts, and each pair of words that follow on one
another there (the start among them). The arcs of a state are the words seen after it; a state without an arc for
the next word takes its failure arc, at the cost of a backoff weight, to the state of one word less, down to the
root, whose arcs are the smoothed unigrams with one class for all words that training did not hold. A text is one
left-to-right walk that carries the state and adds log10 probabilities; for every state they sum to one.

With m(c) = WEIGHT * c ** POWER pseudo-tokens, the arc of w after a state s seen c(s) times weighs
(c(s w) + m * P(w | one word less)) / (c(s) + m), the failure arc m / (c(s) + m): states seen often are trusted more.

Counts: documents form blocks of some BLOCK_BYTES in the order of their partition. A block tokenises its texts, and
asks for the training counts of its words, pairs and triples by 64-bit (pairs and triples: 56-bit) hashes, packed by
ranges of the hash, as many ranges as the texts have RANGE_BYTES. Totals of a range go back to the blocks in the
order of their hashes, where they meet the block's texts. Nothing is broadcast or collected but five totals.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, documents, freed, map_batches, stored, text_rows

#: m(c) of the states of one and of two words, chosen on a ninth of the training texts of the 0.1 scale (remainder 1).
WEIGHT, POWER = (16.0, 1.0), (0.7, 0.85)
#: Rows of one Arrow batch, on the way to Python and back.
BATCH_ROWS = 256
#: Bytes of text of one block, which takes some 40 times as much memory, and those whose hashes share a range.
BLOCK_BYTES, RANGE_BYTES = 4 << 20, 8 << 20
_END, _START = (np.uint64(xxhash.xxh64_intdigest(x, 42)) for x in (b"\n", b"\r"))  # no word holds white space
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


class Tokens:
    """The tokens of some texts laid end to end, each text closed by an end: hashes of words, pairs and triples."""

    def __init__(self, texts: pa.Array):
        n = len(texts)
        texts = texts.cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        own = data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if data else b""  # the buffer may hold more texts
        lower = pa.py_buffer(own.lower())  # of bytes: A-Z alone
        split = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets - offsets[0]), lower]))
        flat, ends = split.flatten(), split.offsets.to_numpy()
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # white space at an edge leaves an empty part
        starts = np.concatenate([[0], np.cumsum(full)])[ends - ends[0]]  # of each text among the words
        named = (flat if full.all() else flat.filter(pa.array(full))).dictionary_encode()
        held = named.dictionary
        raw, at = (held.buffers()[2] or pa.py_buffer(b"")).to_pybytes(), np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1].tolist()
        own = np.fromiter((xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in pairwise(at)), np.uint64, len(held))
        #: tokens of each text, the end among them, and the place of its first
        self.sizes = np.diff(starts) + 1
        self.first = np.cumsum(self.sizes) - self.sizes
        last = self.first + self.sizes - 1
        k, total = len(held), int(self.sizes.sum())
        self.ids = np.full(total, k, np.int64)
        inner = np.ones(total, bool)
        inner[last] = False
        self.ids[inner] = named.indices.to_numpy()
        self.words = np.append(own, _END)
        here = self.words[self.ids]
        before = np.roll(here, 1)
        before[self.first] = _START
        #: pair of each place (with the start at a text's first) and triple of each place but a text's first
        self.pairs = _mix(before * _A ^ (here + _B)) >> np.uint64(8)
        two = np.roll(before, 1)
        self.triples = _mix(_mix(two * _C ^ (before + _A)) * _A ^ (here + _C)) >> np.uint64(8)
        self.inner = np.ones(total, bool)
        self.inner[self.first] = False

    def counted(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes in order, with their counts in the texts of ``train``: words, then pairs and triples."""
        mine = np.repeat(train, self.sizes)
        n = np.bincount(self.ids[mine], minlength=len(self.words))
        order = np.argsort(self.words, kind="stable")
        # the lowest bit says whether a place is of a training text, so that one sort tells both
        both = np.concatenate([self.pairs << np.uint64(1) | mine, (self.triples << np.uint64(1) | mine)[self.inner]])
        both.sort()
        at = np.flatnonzero(np.diff(both >> np.uint64(1), prepend=np.uint64(0xFFFFFFFFFFFFFFFF)))
        count = np.add.reduceat((both & np.uint64(1)).astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
        return self.words[order], n[order], both[at] >> np.uint64(1), count

    def spread(self, words: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts given in the order of counted(), laid on the places: of words, pairs, triples (0 at a text's first)."""
        each = np.empty(len(self.words), np.int64)
        each[np.argsort(self.words, kind="stable")] = words
        both = np.concatenate([self.pairs, self.triples[self.inner]])
        held = np.sort(both)
        held = held[np.flatnonzero(np.diff(held, prepend=~held[:1]))]
        if len(held) != len(grams):
            raise _moved()
        laid = grams[places(held, both)]
        triples = np.zeros(len(self.ids), np.int64)
        triples[self.inner] = laid[len(self.ids) :]
        return each[self.ids], laid[: len(self.ids)], triples


def places(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key, a 56-bit hash, stands among the distinct held ones in order: from its high bits, then on."""
    if not len(keys):
        return np.zeros(0, np.int64)
    bits = min(24, max(1, len(held).bit_length()))
    shift = np.uint64(56 - bits)
    start = np.concatenate([[0], np.cumsum(np.bincount((held >> shift).view(np.int64), minlength=1 << bits))])
    at = start[(keys >> shift).view(np.int64)]
    todo = np.flatnonzero(held[at] != keys)
    while len(todo):
        at[todo] += 1
        todo = todo[held[at[todo]] != keys[todo]]
    return at


def _moved() -> RuntimeError:
    return RuntimeError("the documents' partitions changed between passes; write them to a table first")


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as their planes of bytes, as many as the largest needs, after the number of planes."""
    planes = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([planes]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").reshape(-1)


def _edge(bucket: int, bits: int, ranges: int) -> int:
    """The least hash of a range."""
    return -(-(bucket << bits) // ranges)


def _steps(hashes: np.ndarray, bits: int, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """From each hash to the next, from its range's least to the first of it; and where the ranges begin and end."""
    edges = np.array([_edge(j, bits, ranges) for j in range(ranges)], np.uint64)
    cuts = np.append(np.searchsorted(hashes, edges), len(hashes))
    out = np.diff(hashes, prepend=np.uint64(0))
    full = np.flatnonzero(np.diff(cuts))
    out[cuts[full]] = hashes[cuts[full]] - edges[full]
    return out, cuts


class _Blocks:
    """Rows of a partition in blocks of some BLOCK_BYTES of text, each given a number that both passes agree on."""

    def __init__(self, limit: int):
        self.limit, self.rows, self.size, self.number = limit, [], 0, TaskContext.get().partitionId() << 32

    def __call__(self, b):
        each = pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False)
        at = 0
        while at < b.num_rows:
            to = at + int(np.searchsorted(np.cumsum(each[at:]), max(1, self.limit - self.size), "left")) + 1
            part = b.slice(at, to - at)
            self.rows.append(part)
            self.size += int(each[at:to].sum())
            at = to
            if self.size >= self.limit:
                yield from self.end()

    def end(self):
        if self.rows:
            t = pa.Table.from_batches(self.rows).combine_chunks()
            self.rows = []
            yield self.block(self.number, t)
            freed()
        self.rows, self.size, self.number = [], 0, self.number + 1


class _Counts(_Blocks):
    """Per block: its distinct hashes with their training counts, packed, by range."""

    def __init__(self, limit: int, ranges: int):
        super().__init__(limit)
        self.ranges = ranges

    def block(self, number, t):
        words, n, grams, m = Tokens(t["text"].combine_chunks()).counted(t["train"].to_numpy())
        (words, cw), (grams, cg) = _steps(words, 64, self.ranges), _steps(grams, 56, self.ranges)
        full = np.flatnonzero((np.diff(cw) > 0) | (np.diff(cg) > 0))
        out = {"part": np.full(len(full), number), "bucket": full, "words": [], "n": [], "grams": [], "m": []}
        for j in full.tolist():
            w, g = slice(cw[j], cw[j + 1]), slice(cg[j], cg[j + 1])
            out["words"].append(pack(words[w]))
            out["grams"].append(pack(grams[g]))
            out["n"].append(pack(n[w]))
            out["m"].append(pack(m[g]))
        return out


class _Texts(_Blocks):
    """Per block: its documents in one row, the texts compressed."""

    def block(self, number, t):
        texts = t["text"].combine_chunks()
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        data = b"".join(texts.to_pylist())
        return {"part": [number], "ids": pa.array([t["doc_id"].to_pylist()], pa.list_(t.schema.field("doc_id").type)), "train": [t["train"].to_pylist()], "sizes": [sizes], "size": [len(data)], "data": [pa.compress(data, "zstd", asbytes=True)]}


def _summed(packed: list[bytes], counts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct hashes, their totals, and the totals in the order of each block's hashes."""
    sizes = [(len(x) - 1) // x[0] for x in packed]
    ends = np.cumsum(sizes)
    each, n = np.empty(sum(sizes), np.uint64), np.empty(sum(sizes), np.int64)
    for end, size, x, y in zip(ends.tolist(), sizes, packed, counts, strict=True):
        np.cumsum(unpack(x), dtype=np.uint64, out=each[end - size : end])
        each[end - size : end] += np.uint64(least)
        n[end - size : end] = unpack(y)
    order = np.argsort(each, kind="stable")
    each = each[order]
    at = np.flatnonzero(np.diff(each, prepend=~each[:1])) if len(each) else np.zeros(0, np.int64)
    total = np.add.reduceat(n[order], at) if len(at) else np.zeros(0, np.int64)
    n[order] = np.repeat(total, np.diff(np.append(at, len(each))))
    return each[at], total, np.split(n, ends[:-1])


def _totals(t: pa.Table, ranges: int) -> pa.Table:
    """The totals of one range for each block, and one row more (part -1) with sums over the range's words."""
    bucket = t["bucket"][0].as_py()
    words, total, own = _summed(t["words"].to_pylist(), t["n"].to_pylist(), _edge(bucket, 64, ranges))
    grams = _summed(t["grams"].to_pylist(), t["m"].to_pylist(), _edge(bucket, 56, ranges))[2]
    end = int(total[words == _END].sum())
    freed()
    sums = np.array([total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum(), end], np.int64)
    return pa.table({
        "part": pa.array([*t["part"].to_pylist(), -1], pa.int64()),
        "bucket": pa.array([bucket] * (t.num_rows + 1), pa.int64()),
        "n": pa.array([*map(pack, own), b""], pa.binary()),
        "m": pa.array([*map(pack, grams), b""], pa.binary()),
        "sums": pa.array([*[None] * t.num_rows, sums.tolist()], pa.list_(pa.int64())),
    })


class Root:
    """The unigrams: n training tokens, v distinct, and the count of texts."""

    def __init__(self, n: int, v: int, starts: int, discount: float):
        self.n, self.v, self.starts, self.discount = n, v, starts, discount

    def unigram(self, c: np.ndarray) -> np.ndarray:
        """Probabilities of words with these training counts; 0 is the class of all unknown."""
        if not self.n:
            return np.ones(len(c))
        return np.where(c > 0, (c - self.discount) / self.n, self.discount * self.v / self.n)


def arcs(order: int, state: np.ndarray, seen: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the arcs out of states of ``order`` words, and the weights of their failure arcs.

    ``state`` and ``seen`` are training counts of the state and of the state with the next word, ``lower`` is that
    word's probability from the state that the failure arc leads to. A state never seen is none: its failure arc
    costs nothing, so that the walk stands in the next lower one.
    """
    m = WEIGHT[order - 1] * np.maximum(state, 1).astype(np.float64) ** POWER[order - 1]
    total = np.where(state > 0, state + m, m)
    return (seen + m * lower) / total, m / total


def walk(root: Root, tokens: Tokens, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray) -> np.ndarray:
    """log10 probability of each text, from the training counts of the word, pair and triple at each place.

    The walk stands, before each word, in the state of the two words before it if training held that pair, else in
    that of the word before it, else at the root. As this state depends on two words alone, the walks of all texts
    are taken at once: the states first, then the arc of each, or its failure arcs down to a state that has one.
    """
    before = np.roll(words, 1)
    before[tokens.first] = root.starts
    two = np.roll(pairs, 1)
    two[tokens.first] = 0
    low = root.unigram(words)
    out = np.log10(low)
    arc, fail = arcs(1, before, pairs, low)
    has = pairs > 0
    out = np.where(has, np.log10(arc), np.log10(fail) + out)
    arc, fail = arcs(2, two, triples, np.where(has, arc, fail * low))
    out = np.where(triples > 0, np.log10(arc), np.log10(fail) + out)
    return np.add.reduceat(out, tokens.first) if len(out) else np.zeros(0)


def score(docs: DataFrame, scanned: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Training documents: crc32(doc_id as text) mod 10 is not 0 (a null doc_id counts as an empty text, and is
    held out). A null or empty text is its end alone. Nothing to train on: every word is unknown, at log10
    probability 0. Equal rows score alike; an empty table gives no rows. A text is held whole by one task. Two passes
    must see the same partitions, so the documents are written to a table first, unless they are ``scanned`` from one.
    """
    with batches_of(docs.sparkSession, BATCH_ROWS):
        return stored(_scored(docs, scanned), "scores")


def _scored(docs: DataFrame, scanned: bool) -> DataFrame:
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0
    rows = text_rows(docs, train.alias("train"))
    if not scanned:
        rows = stored(rows, "texts")
    size = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    limit = BLOCK_BYTES
    ranges = -(-size // RANGE_BYTES) or 1
    asked = map_batches(rows.select("doc_id", "text", "train"), lambda: _Counts(limit, ranges), "part long, bucket long, words binary, n binary, grams binary, m binary")
    given = stored(asked.groupBy("bucket").applyInArrow(lambda t: _totals(t, ranges), "part long, bucket long, n binary, m binary, sums array<long>"), "counts")
    sums = given.where("part = -1").agg(*[F.sum(F.get("sums", F.lit(i))) for i in range(5)]).first()
    n, v, n1, n2, starts = (int(x or 0) for x in sums)
    root = Root(n, v, starts, min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5)
    kind = rows.schema["doc_id"].dataType.simpleString()
    texts = map_batches(rows.select("doc_id", "text", "train"), lambda: _Texts(limit), f"part long, ids array<{kind}>, train array<boolean>, sizes array<int>, size long, data binary")

    def block(own: pa.Table, counts: pa.Table) -> pa.Table:
        freed()
        counts = counts.sort_by("bucket")
        sizes = own["sizes"].combine_chunks().flatten().to_numpy()
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        data = pa.decompress(own["data"][0].as_py(), own["size"][0].as_py(), "zstd", asbytes=True)
        t = Tokens(pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)]))
        words, grams = (np.concatenate([np.zeros(0, np.uint64), *(unpack(x) for x in counts[c].to_pylist())]).astype(np.int64) for c in ("n", "m"))
        if len(words) != len(t.words):
            raise _moved()
        words, pairs, triples = t.spread(words, grams)
        base = np.log10((words + 0.1) / (root.n + 0.1 * (root.v + 1)))
        add = lambda x: np.add.reduceat(x, t.first)
        return pa.table({
            "doc_id": own["ids"].combine_chunks().flatten(),
            "held_out": pc.invert(own["train"].combine_chunks().flatten()),
            "n_tokens": pa.array(t.sizes, pa.int64()),
            "n_known": pa.array(add((words > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array(np.full(len(sizes), root.n), pa.int64()),
            "base_score": pa.array(add(base), pa.float64()),
            "score": pa.array(walk(root, t, words, pairs, triples), pa.float64()),
        })

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    wanted = given.where("part >= 0").select("part", "bucket", "n", "m")
    return texts.groupBy("part").cogroup(wanted.groupBy("part")).applyInArrow(block, schema)


def op7_ngram_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), scanned=True)
