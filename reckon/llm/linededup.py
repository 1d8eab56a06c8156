"""Line dedup: repeated runs of lines, found with a suffix array over line-ID sequences.

A document is a sequence of line IDs; only lines that occur twice or more matter, so unique lines end a
sequence. Distributed prefix doubling ranks the suffixes: level k holds the dense rank of each suffix by
its first 2^k lines, from the ranks of level k-1 at its start and 2^(k-1) lines on. Suffixes that share a
prefix of m lines form a longest-common-prefix interval; the interval of any m is named by two ranks of
level floor(log2 m), at the start and at the end of the prefix. A run qualifies from MIN_WORDS words on.
Every qualifying run is the union of the shortest qualifying windows that start or end at its lines,
so each position looks up two intervals, and all but the first copy of an interval is deleted.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, map_batches, stored, text_rows

MIN_WORDS = 25


def windows(counts: list[int], least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line: lines of the shortest window with ``least`` words that starts, or ends, there (0: none)."""
    sums = np.fromiter(accumulate(counts, initial=0), np.int64, len(counts) + 1)
    n = np.arange(len(counts))
    end = np.searchsorted(sums, sums[:-1] + least, "left")
    start = np.searchsorted(sums, sums[1:] - least, "right") - 1
    return np.where(end <= len(counts), end - n, 0), np.where(sums[1:] >= least, n - start + 1, 0)


def line_rows(docs: DataFrame, least: int) -> DataFrame:
    """One row a line: doc_id, th (hash of the text), pos, a and b (128 bits of the line), mf, mb."""

    def make():
        def f(b):
            ids, texts = b.column("doc_id"), b.column("text").to_pylist()
            th = b.column("th").to_numpy(zero_copy_only=False)
            step = 2000
            for at in range(0, len(texts), step):
                rep, lo, hi, mf, mb, pos = [], [], [], [], [], []
                for r, text in enumerate(texts[at : at + step]):
                    if not text:
                        continue
                    lines = text.split(b"\n")
                    counts = [len(x.split()) for x in lines]
                    if sum(counts) < least:
                        continue
                    fwd, back = windows(counts, least)
                    digests = [xxhash.xxh3_128_intdigest(x) for x in lines]
                    rep.append(np.full(len(lines), at + r))
                    hi += [(d >> 64) - (1 << 63) for d in digests]
                    lo += [(d & (1 << 64) - 1) - (1 << 63) for d in digests]
                    mf.append(fwd)
                    mb.append(back)
                    pos.append(np.arange(len(lines)))
                if rep:
                    rows = np.concatenate(rep)
                    yield {"doc_id": ids.take(pa.array(rows)), "th": th[rows], "pos": np.concatenate(pos), "a": np.array(hi, np.int64), "b": np.array(lo, np.int64), "mf": np.concatenate(mf), "mb": np.concatenate(mb)}

        return f

    rows = text_rows(docs, F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, make, f"doc_id {kind}, th long, pos int, a long, b long, mf int, mb int")


def dense_rank(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """The distinct values of the columns with their dense rank in sorted order, by range partitions."""
    ranged = df.select(*by).distinct().repartitionByRange(*by).select(*by, F.spark_partition_id().alias("_rk_p"))
    ranged = stored(ranged, "rank")
    counts = ranged.groupBy("_rk_p").agg(F.count("*").alias("_rk_n"))  # one row for each partition
    before = counts.withColumn("_rk_o", F.sum("_rk_n").over(Window.orderBy("_rk_p")) - F.col("_rk_n")).select("_rk_p", "_rk_o")
    inside = F.row_number().over(Window.partitionBy("_rk_p").orderBy(*by))
    return ranged.withColumn("_rk_i", inside).join(F.broadcast(before), "_rk_p").select(*by, (F.col("_rk_o") + F.col("_rk_i")).alias(name))


def _same(left: dict[str, str]) -> Column:
    out = F.lit(True)
    for x, y in left.items():
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


DOC = {"doc_id": "_rk_doc", "th": "_rk_th"}


def suffix_ranks(lines: DataFrame, levels: int) -> DataFrame:
    """doc_id, th, pos, last (the end of its run of repeated lines), mf, mb, r0 ... r<levels>.

    r<k> is null where fewer than 2^k repeated lines follow on one another.
    """
    often = lines.groupBy("a", "b").agg(F.count("*").alias("_rk_c")).where("_rk_c > 1").drop("_rk_c")
    rank = dense_rank(often, ["a", "b"], "r0")
    rows = lines.join(rank, ["a", "b"]).drop("a", "b")
    doc = Window.partitionBy("doc_id", "th").orderBy("pos")
    rows = rows.withColumn("_rk_s", F.col("pos") - F.row_number().over(doc))
    rows = rows.withColumn("last", F.max("pos").over(Window.partitionBy("doc_id", "th", "_rk_s"))).drop("_rk_s")
    rows = stored(rows, "lines")
    for k in range(1, levels + 1):
        half = 1 << (k - 1)
        paired = rows.withColumn("_rk_x", F.when(F.col("pos") + 2 * half - 1 <= F.col("last"), F.lead(f"r{k - 1}", half).over(doc)))
        paired = stored(paired, "lines")
        pairs = dense_rank(paired.where("_rk_x is not null").select(F.col(f"r{k - 1}").alias("_rk_a"), F.col("_rk_x").alias("_rk_b")), ["_rk_a", "_rk_b"], f"r{k}")
        rows = stored(paired.join(pairs, (F.col(f"r{k - 1}") == F.col("_rk_a")) & (F.col("_rk_x") == F.col("_rk_b")), "left").drop("_rk_a", "_rk_b", "_rk_x"), "lines")
    return rows


def repeated_lines(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, th, dead: the positions of lines in later copies of qualifying runs."""
    lines = stored(line_rows(docs, least).distinct(), "lines")  # rows with one doc_id and text are one document
    top = lines.select(F.greatest(F.max("mf"), F.max("mb"))).first()[0] or 0
    rows = suffix_ranks(lines, max(0, int(top).bit_length() - 1))
    # windows of repeated lines alone, with the rank at their start and that at their end
    fwd = rows.where("mf > 0 and pos + mf - 1 <= last").select("doc_id", "th", F.lit("f").alias("d"), F.col("pos").alias("s"), F.col("mf").alias("m"))
    rows_first = rows.withColumn("_rk_first", F.min("pos").over(Window.partitionBy("doc_id", "th", "last")))
    back = rows_first.where("mb > 0 and pos - mb + 1 >= _rk_first").select("doc_id", "th", F.lit("b").alias("d"), (F.col("pos") - F.col("mb") + 1).alias("s"), F.col("mb").alias("m"))
    level = F.floor(F.log2(F.col("m"))).cast("int")
    spans = fwd.unionByName(back).withColumn("k", level).withColumn("e", (F.col("s") + F.col("m") - F.pow(F.lit(2), F.col("k"))).cast("int"))
    ranks = rows.select(F.col("doc_id").alias("_rk_doc"), F.col("th").alias("_rk_th"), F.col("pos").alias("_rk_pos"), F.array(*[c for c in rows.columns if c[0] == "r" and c[1:].isdigit()]).alias("_rk_r"))
    named = spans.join(ranks, _same(DOC) & (F.col("s") == F.col("_rk_pos"))).withColumn("x", F.get("_rk_r", F.col("k"))).drop("_rk_doc", "_rk_th", "_rk_pos", "_rk_r")
    named = named.join(ranks, _same(DOC) & (F.col("e") == F.col("_rk_pos"))).withColumn("y", F.get("_rk_r", F.col("k"))).select("doc_id", "th", "d", "s", "m", "x", "y")
    named = stored(named, "windows")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th", "s")
    first = named.groupBy("d", "m", "x", "y").agg(F.min(place).alias("_rk_f"), F.count("*").alias("_rk_c")).where("_rk_c > 1").drop("_rk_c")
    first = stored(first, "first")  # so that both sides of the join are dealt anew, and a hot name can be split
    later = named.join(first, ["d", "m", "x", "y"]).where(place != F.col("_rk_f"))
    return covered(later.select("doc_id", "th", "s", (F.col("s") + F.col("m")).alias("e")))


def covered(runs: DataFrame) -> DataFrame:
    """doc_id, th, dead: the positions that the runs from s to e (exclusive) hold, each once.

    A run adds the positions beyond the furthest end before it, so that the work is that of the lines, however the
    runs overlap.
    """
    longest = runs.groupBy("doc_id", "th", "s").agg(F.max("e").alias("e"))
    before = F.max("e").over(Window.partitionBy("doc_id", "th").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    new = longest.withColumn("s", F.greatest("s", F.coalesce(before, F.lit(0)))).where("s < e")
    return new.groupBy("doc_id", "th").agg(F.flatten(F.collect_list(F.sequence(F.col("s"), F.col("e") - 1))).alias("dead"))


def dedup_lines(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """The documents, later copies of repeated runs of lines deleted from their texts; _rk_dead counts lines.

    A run of whole lines (ends are newlines) with ``least`` words or more goes wherever it has occurred
    before, in order of doc_id (nulls last), then of position. Rows that agree in doc_id and text are one
    document and change alike. Null and empty texts stay; a document may end up empty; n_chars, where
    there is such a column, follows the text.
    """
    dead = repeated_lines(docs, least).select(F.col("doc_id").alias("_rk_doc"), F.col("th").alias("_rk_th"), F.col("dead").alias("_rk_l"))
    keyed = docs.withColumn("_rk_h", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(dead, F.col("doc_id").eqNullSafe(F.col("_rk_doc")) & (F.col("_rk_h") == F.col("_rk_th")), "left").drop("_rk_doc", "_rk_th", "_rk_h")
    lines = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_rk_l"))
    text = F.when(F.col("_rk_l").isNull(), F.col("text")).otherwise(_pick("text", kept))
    out = joined.withColumn("text", text).withColumn("_rk_dead", F.coalesce(F.size("_rk_l"), F.lit(0)).cast("long")).drop("_rk_l")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def _pick(text: str, kept: Column) -> Column:
    # one lambda argument holds the split lines, so that a text is split once
    return F.array_join(F.flatten(F.transform(F.array(F.split(text, "\n", -1)), lambda ls: F.transform(kept, lambda i: F.get(ls, i)))), "\n")


def op3_line_dedup_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text after deletion, n_deleted lines of every document."""
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "text", F.col("_rk_dead").alias("n_deleted"))


#: The same by window texts in place of ranks: the shortest windows with enough words that start or end at each line,
#: grouped by what they say; all but the first of a group go.
ORACLE = rf"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE text <> ''),
ids AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS d, doc_id, text, string_split(text, chr(10)) AS ls FROM docs),
lines AS (SELECT d, unnest(range(len(ls))) AS pos, unnest(ls) AS line, unnest(list_transform(ls, lambda x: len(regexp_extract_all(x, '[^ \t\n\r\x0b\x0c]+')))) AS n FROM ids),
sums AS (SELECT d, pos, sum(n) OVER (PARTITION BY d ORDER BY pos) AS upto, sum(n) OVER (PARTITION BY d ORDER BY pos) - n AS before FROM lines),
ends AS (SELECT d, upto, min(pos) AS pos FROM sums GROUP BY d, upto),
starts AS (SELECT d, before, max(pos) AS pos FROM sums GROUP BY d, before),
spans AS (
 SELECT 'f' AS way, l.d, l.pos AS s, r.pos AS e FROM sums l ASOF JOIN ends r ON l.d = r.d AND l.before + {MIN_WORDS} <= r.upto
 UNION ALL SELECT 'b', l.d, r.pos, l.pos FROM sums l ASOF JOIN starts r ON l.d = r.d AND l.upto - {MIN_WORDS} >= r.before),
said AS (SELECT way, d, s, e, array_to_string(ls[s + 1:e + 1], chr(10)) AS w FROM spans JOIN ids USING (d)),
later AS (SELECT d, s, e FROM (SELECT *, row_number() OVER (PARTITION BY way, e - s, w ORDER BY d, s) AS rn FROM said) WHERE rn > 1),
dead AS (SELECT DISTINCT d, unnest(range(s, e + 1)) AS pos FROM later),
gone AS (SELECT l.d, count(g.pos) AS n, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS new FROM lines l LEFT JOIN dead g ON l.d = g.d AND l.pos = g.pos GROUP BY l.d HAVING count(g.pos) > 0),
kept AS (SELECT doc_id, text, n, new FROM ids JOIN gone USING (d))
SELECT x.doc_id, CASE WHEN k.n IS NULL THEN x.text ELSE coalesce(k.new, '') END AS text, CAST(coalesce(k.n, 0) AS BIGINT) AS n_deleted
FROM documents x LEFT JOIN kept k ON x.doc_id IS NOT DISTINCT FROM k.doc_id AND x.text = k.text
"""
