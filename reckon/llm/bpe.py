"""Byte-level BPE by monoid tree reduction.

A text is halved until a part is at most LEAF characters; each part is encoded alone, and neighbours
are joined: a window around the boundary is encoded anew and grows on either side until it ends at a
certain cut, or at the part's own end. A certain cut lies between two characters that no match of the
split pattern can hold together, whatever stands around them: matches before it end there, and since
the pattern never looks back, matches after it do not depend on what came before. Tokens outside the
window are those of the whole text, so the join is associative and equals encoding in one go.
"""

from __future__ import annotations

import base64
import os
from functools import cache

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, text_rows

LEAF, WINDOW = 1024, 32
#: Cuts: from any character but white space to white space, between letters and digits, from letters
#: or digits to other marks, and from marks but the apostrophe to letters and digits. Only ASCII and
#: Latin letters count as letters here, so that no table of character classes needs to agree.
_SP, _L, _N, _O = r" \t\n\r", r"A-Za-zÀ-ÖØ-öø-ɏ", "0-9", r"!\"#$%&()*+,\-./:;<=>?@\[\]^_{|}~"
_CUT = regex.compile(rf"[{_L}{_N}{_O}'](?=[{_SP}])|[{_L}](?=[{_N}{_O}'])|[{_N}](?=[{_L}{_O}'])|[{_O}](?=[{_L}{_N}])")


def _files():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@cache
def codec(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class TreeBPE:
    """encode and decode of whole texts; spans are (start, end, ids)."""

    def __init__(self, path: str | None = None, pattern: str | None = None, leaf: int = LEAF, window: int = WINDOW):
        known = _files()
        if pattern not in (None, known[1]):
            raise ValueError("the certain cuts hold for the split pattern of public_tokenizers alone")
        self.enc, self.leaf, self.window = codec(path or known[0], pattern or known[1]), max(1, leaf), max(1, window)
        top = max(self.enc._mergeable_ranks.values()) + 1
        self.bytes_of = [b""] * top
        for b, i in self.enc._mergeable_ranks.items():
            self.bytes_of[i] = b
        self.length = np.fromiter(map(len, self.bytes_of), np.int64, top)

    def encode(self, text: str) -> np.ndarray:
        return self._span(text, 0, len(text))

    def _plain(self, text: str) -> np.ndarray:
        return np.asarray(self.enc.encode_ordinary(text), np.int32)

    def _span(self, text: str, start: int, end: int) -> np.ndarray:
        if end - start <= self.leaf:
            return self._plain(text[start:end])
        mid = (start + end) // 2
        return self.join(text, start, mid, end, self._span(text, start, mid), self._span(text, mid, end))

    def join(self, text: str, start: int, mid: int, end: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of text[start:end] from those of its two parts."""
        size = self.window
        while True:  # the last cut of the left window
            a = max(start, mid - size)
            cuts = [m.end() for m in _CUT.finditer(text, a, mid)]
            if cuts or a == start:
                lo = cuts[-1] if cuts else start
                break
            size *= 2
        size = self.window
        while True:  # the first cut of the right window
            b = min(end, mid + size)
            m = _CUT.search(text, mid, min(b + 1, end))
            if m or b == end:
                hi = m.end() if m else end
                break
            size *= 2
        middle = self._plain(text[lo:hi])
        return np.concatenate([left[: self._before(left, text[lo:mid])], middle, right[self._after(right, text[mid:hi]) :]])

    def _before(self, ids: np.ndarray, tail: str) -> int:
        """How many ids stand before the tail, which starts at a token."""
        n = len(tail.encode())
        k = min(len(ids), n)
        sums = np.cumsum(self.length[ids[len(ids) - k :]][::-1])
        at = int(np.searchsorted(sums, n)) if n else -1
        if n and (at >= k or sums[at] != n):
            raise AssertionError("the cut does not start a token")
        return len(ids) - at - 1

    def _after(self, ids: np.ndarray, head: str) -> int:
        n = len(head.encode())
        if not n:
            return 0
        sums = np.cumsum(self.length[ids[:n]])
        at = int(np.searchsorted(sums, n))
        if at >= len(sums) or sums[at] != n:
            raise AssertionError("the cut does not end a token")
        return at + 1

    def decode(self, ids) -> bytes:
        """Concatenate up the tree."""
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist() if hasattr(ids, "tolist") else ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def bpe_encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id, ids (array of int), decoded (the ids' bytes).

    A null or empty text has no ids; equal texts have equal ids, repeated rows stay, an empty table gives no rows. A very
    long text is encoded whole by one task, in memory that grows with its length. Other columns are left out. ``path``
    names another file of ranks; another ``pattern`` than public_tokenizers.PATTERN is refused.
    """

    def make():
        tree = TreeBPE(path, pattern, leaf)

        def f(b):
            ids = [tree.encode(t.decode("utf-8", "replace")) for t in b.column("text").to_pylist()]
            return {"doc_id": b.column("doc_id"), "ids": ids, "decoded": [tree.decode(x) for x in ids]}

        return f

    rows = text_rows(docs)
    return map_batches(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")


def bpe_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns, from the ids and bytes of bpe_encode, by SQL functions."""
    return bpe_encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir))
