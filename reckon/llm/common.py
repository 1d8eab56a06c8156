"""What the operators of this folder share: stored tables, tokenising, batches, components.

Every operator reads two columns of its documents, ``doc_id`` and ``text``. A null text counts as an
empty one, a null doc_id is an ordinary value, and other columns, whatever their names, are left
alone: internal columns start with ``_rk_``.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Input of one Python batch is cut into pieces of about this many bytes of text.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a private one only where none is set and all runs on one machine."""
    key = "spark.checkpoint.dir"
    named = spark.sparkContext.getConf().get(key) or spark.conf.get(key, None)
    if not named:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="reckon-")
        spark.conf.set(key, named)
    return named.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Row numbers that every task may hold; beyond, rows meet them in a shuffle.
HELD_ROWS = 1_000_000


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with _rk_row, which tells rows apart in every later pass.

    Rows of a plain file scan have their place in the file; anything else is written first.
    """
    nodes = [line.lstrip(" :+-").split(" ")[0] for line in docs._jdf.queryExecution().analyzed().toString().splitlines() if line.strip()]
    if [x for x in nodes if x not in ("Project", "Filter")] == ["Relation"] and "_metadata" not in docs.columns:
        return docs.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("_rk_row"))
    return stored(docs.withColumn("_rk_row", F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))), "numbered")


def met(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Semi, anti or inner join on _rk_row with stored ``rows``: by broadcast up to HELD_ROWS, else by a shuffle."""
    return docs.join(F.broadcast(rows) if rows.count() <= HELD_ROWS else rows.hint("merge"), "_rk_row", how)


def words(data: bytes) -> list[bytes]:
    """Lower-case A-Z, then the runs of bytes outside 0x20 and 0x09-0x0D."""
    return data.lower().split()


_PUNCT = bytes(0x20 if c < 0x30 or 0x3A <= c < 0x41 or 0x5B <= c < 0x61 or 0x7B <= c < 0x80 else c for c in range(256))


def plain_words(text: str) -> list[bytes]:
    """Unicode lower case; words end at ASCII punctuation and white space."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PUNCT).split()


def text_rows(docs: DataFrame, *more) -> DataFrame:
    """doc_id and the text as UTF-8 bytes, null as empty."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *more)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict] | dict | None]], schema: str) -> DataFrame:
    """mapInArrow with input batches cut to about BATCH_BYTES, by a function made once a task.

    The function takes a RecordBatch and returns columns as a dict (or an iterator of such, or None).
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches):
        f = make()
        for whole in batches:
            rows = max(1, min(whole.num_rows, whole.num_rows * BATCH_BYTES // max(1, whole.nbytes)))
            for at in range(0, whole.num_rows, rows):
                out = f(whole.slice(at, rows))
                for cols in [out] if isinstance(out, dict) else out or ():
                    yield pa.RecordBatch.from_arrays([_array(cols[x.name], x.type) for x in arrow], schema=arrow)
        if hasattr(f, "end"):
            for cols in f.end():
                yield pa.RecordBatch.from_arrays([_array(cols[x.name], x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows at most, for what is run inside: texts and packed arrays make wide rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def freed() -> None:
    """Hand free memory back to the system: Python workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def _array(values, kind):
    return values.cast(kind) if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values, kind)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (u, v) by alternating large and small stars: (node, root), root the least node.

    Each round is written to the shared folder; the driver sees one count a round. The rounds grow with
    the logarithm of the longest chain.
    """
    e = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_rk_m")).select(F.col("u").alias("_rk_u"), F.least("u", "_rk_m").alias("_rk_m"))
        large = both.where("v > u").join(least.hint("merge"), F.col("u") == F.col("_rk_u")).select(F.col("v").alias("u"), F.col("_rk_m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("_rk_m")).select(F.col("u").alias("_rk_u"), "_rk_m")
        joined = large.join(least.hint("merge"), F.col("u") == F.col("_rk_u"))
        small = joined.where("v > _rk_m").select(F.col("v").alias("u"), F.col("_rk_m").alias("v")).unionByName(least.select(F.col("_rk_u").alias("u"), F.col("_rk_m").alias("v"))).distinct()
        e = stored(small, "edges")
        # done when every node has one link and no root is a node: a forest of stars
        n, nodes, inner = e.select(F.count("*"), F.count_distinct("u"), F.lit(0)).first()
        if n == nodes and e.join(e.select(F.col("u").alias("_rk_n")).hint("merge"), F.col("v") == F.col("_rk_n"), "left_semi").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
