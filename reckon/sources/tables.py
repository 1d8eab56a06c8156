"""Tables to compare: CSV, ndjson, Parquet or a DataFrame, each with its header and the order of its rows."""

from __future__ import annotations

import csv
import io
import json
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.options import DiffError, Options

DELIMITERS = (",", ";", "\t", "|")
#: Bytes in which the header of a CSV file ends.
HEADER_BYTES = 1 << 18


def _bytes_at_ends(spark: SparkSession, path: str, n: int) -> tuple[str, bytes, bytes]:
    """The first data file of the path that is not empty, its first n bytes and its last four, through Spark's file systems."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise DiffError(f"no such file: {path}")
    status = fs.getFileStatus(p)
    if status.isDirectory():
        inside = sorted((s for s in fs.listStatus(p) if s.isFile() and s.getPath().getName()[0] not in "._"), key=lambda s: s.getPath().getName())
        if not inside:
            raise DiffError(f"no files in {path}")
        status = next((s for s in inside if s.getLen()), inside[0])  # a writer leaves an empty file of an empty first partition
    size = status.getLen()

    def read(at: int, count: int) -> bytes:
        stream = fs.open(status.getPath())
        try:
            stream.seek(at)
            buffer = jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, count))
            return bytes(buffer)
        finally:
            stream.close()

    return status.getPath().toString(), read(0, min(n, size)), read(max(0, size - 4), min(4, size))


def sniff_format(spark: SparkSession, path: str) -> str:
    """parquet by its magic at both ends, ndjson by a leading brace, else csv; content beats the name."""
    file, head, tail = _bytes_at_ends(spark, path, 64)
    if head[:4] == b"PAR1":
        if tail != b"PAR1" or len(head) < 12:
            raise DiffError(f"truncated Parquet file: {file}")
        return "parquet"
    return "ndjson" if head.removeprefix(b"\xef\xbb\xbf").lstrip()[:1] == b"{" else "csv"


def sniff_delimiter(line: str) -> str:
    """The commonest of the known delimiters on the header line; of equals the first."""
    return max(DELIMITERS, key=lambda d: (line.count(d), -DELIMITERS.index(d)))


def quoted(name: str) -> str:
    """A column name with dots, blanks or backticks in it, for Spark's parser."""
    return f"`{name.replace('`', '``')}`"


@dataclass
class Table:
    spark: SparkSession
    names: list[str]
    path: str | None = None
    kind: str = "dataframe"
    df: DataFrame | None = None
    delimiter: str = ","
    physical: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        for i, n in enumerate(self.names):  # by place, so that no name can clash with another or with _ord
            self.physical.setdefault(n, f"f{i}")

    def column(self, name: str) -> str:
        """The physical column of a name; a name that repeats means its first."""
        return self.physical[name]

    def by_cells(self, opt: Options) -> bool:
        """Whether _ord is the cells read, in the order of keys and compared columns."""
        return self.kind == "dataframe" and not opt.order_by

    def read(self, key: tuple[str, ...], compared: tuple[str, ...], opt: Options) -> DataFrame:
        """The columns asked for, and _ord, which orders rows as they stand."""
        wanted = list(dict.fromkeys([*key, *compared]))
        own = [F.col(quoted(n)) for n in wanted]
        named = [c.alias(self.column(n)) for c, n in zip(own, wanted, strict=True)]
        if self.kind == "dataframe":
            return self.df.select(*named, F.struct(*([F.col(quoted(c)) for c in opt.order_by] or own)).alias("_ord"))
        if self.kind == "parquet":
            return self.spark.read.parquet(self.path).select(*named, F.struct("_metadata.file_path", "_metadata.row_index").alias("_ord"))
        cols = [F.col(self.column(n)) for n in wanted]
        place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("_ord")
        if self.kind == "csv":
            return self._csv(opt).select(*cols, place)
        lines = self.spark.read.text(self.path).where(F.trim("value") != "").select("value", place)
        return _json_rows(lines, wanted, set(key), self.physical)

    def _csv(self, opt: Options) -> DataFrame:
        lines = self.spark.read.option("lineSep", "\n").text(self.path)
        odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
        found = lines.agg(F.bool_or(odd).alias("odd"), F.bool_or(F.col("value").rlike(r"\r(?!\z)")).alias("lone")).first()
        schema = T.StructType([T.StructField(f"f{i}", T.StringType()) for i in range(len(self.names))])
        reader = self.spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("sep", self.delimiter).option("quote", '"').option("escape", '"')
        if opt.encoding:
            reader = reader.option("encoding", opt.encoding)
        lone = bool(found["lone"]) and not (opt.encoding or "").lower().startswith(("utf-16", "utf-32"))
        if lone:  # rows end at the newline alone
            reader = reader.option("lineSep", "\n")
        # a quoted newline makes a file unsplittable, so only where there may be one
        rows = reader.option("multiLine", bool(found["odd"])).option("mode", "PERMISSIVE").option("nullValue", "").option("maxCharsPerColumn", -1).csv(self.path)
        return _without_ends(rows, schema.names) if lone else rows

    def count(self) -> int | None:
        return self.spark.read.parquet(self.path).count() if self.kind == "parquet" else None

    def _single(self) -> bool:
        """Whether the path is one file that is read in order from its start."""
        return len(self.spark.read.format("binaryFile").load(self.path).select("path").head(2)) == 1

    def head(self, n: int, opt: Options) -> list[list[str | None]]:
        """The first n rows as text, in file order."""
        from ..functions.cells import canonical_text

        names = tuple(dict.fromkeys(self.names))
        df = self.read(names, (), opt)
        if self.kind == "dataframe":
            rows = df.limit(n)
        else:  # the first rows of each file are a prefix of it, so that one task stops early in place of sorting all
            rows = df.limit(n) if self._single() else df.orderBy("_ord").limit(n)
        return [list(r) for r in rows.select(*[F.nullif(canonical_text(F.col(self.column(c)), df.schema[self.column(c)].dataType, c), F.lit("")) for c in names]).collect()]


def _without_ends(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows cut at newlines alone, less the carriage return that ends the last cell there is."""
    cut, last = {}, F.lit(True)
    for n in reversed(names):
        cut[n] = F.nullif(F.when(last, F.regexp_replace(n, r"\r\z", "")).otherwise(F.col(n)), F.lit(""))
        last = last & F.col(n).isNull()
    blank = F.col(names[0]) == "\r"
    for n in names[1:]:
        blank = blank & F.col(n).isNull()
    return rows.where(~F.coalesce(blank, F.lit(False))).withColumns(cut)


def _json_rows(lines: DataFrame, wanted: list[str], keys: set[str], physical: dict[str, str]) -> DataFrame:
    """Members as text: numbers as written, nested values and null absent; of a repeated member keys take the
    first, other columns the last. A line that is no object is a row of absent cells."""
    schema = T.StructType([*(T.StructField(physical[n], T.StringType()) for n in wanted), lines.schema["_ord"]])

    def text(v):
        if isinstance(v, bool):
            return "true" if v else "false"
        if not isinstance(v, str):
            return None
        return v if v.isascii() else v.encode("utf-8", "surrogatepass").decode("utf-8", "replace")  # lone surrogates

    def run(batches):
        for b in batches:
            cells = {n: [] for n in wanted}
            for line in b.column(0).to_pylist():
                try:
                    pairs = json.loads(line, object_pairs_hook=_Pairs, parse_int=str, parse_float=str, parse_constant=str)
                except (ValueError, RecursionError):
                    pairs = None
                pairs = pairs if isinstance(pairs, _Pairs) else ()
                last = dict(pairs)
                first = dict(reversed(pairs)) if keys else last
                for n in wanted:
                    cells[n].append(text((first if n in keys else last).get(n)))
            yield pa.RecordBatch.from_arrays([*(pa.array(cells[n], pa.string()) for n in wanted), b.column(1)], names=[*(physical[n] for n in wanted), "_ord"])

    return lines.mapInArrow(run, schema)


class _Pairs(list):
    """Members of an object, in order."""


def open_table(spark: SparkSession, source: str | DataFrame, opt: Options | None = None) -> Table:
    """Sniff a path, or wrap a DataFrame.

    Rows of a DataFrame are ordered by ``order_by``; without it by the cells themselves, so that which of
    several rows of one key comes first does not depend on the run.
    """
    opt = opt or Options()
    if isinstance(source, DataFrame):
        return Table(spark, source.columns, df=source)
    kind = sniff_format(spark, source)
    if kind == "parquet":
        return Table(spark, spark.read.parquet(source).columns, source, kind)
    reader = spark.read.option("lineSep", "\n") if kind == "ndjson" else spark.read
    first = next((r[0] for r in reader.text(source).where(F.trim("value") != "").head(1)), "").removeprefix("﻿")
    if kind == "ndjson":
        try:
            names = list(dict.fromkeys(k for k, _ in json.loads(first, object_pairs_hook=_Pairs)))
        except (ValueError, TypeError, RecursionError):
            raise DiffError(f"the first line is not a JSON object: {source}") from None
        return Table(spark, names, source, kind, physical={n: f"f{i}" for i, n in enumerate(names)})
    try:  # from the bytes, so that encodings and quoted newlines in names hold
        head = _bytes_at_ends(spark, source, HEADER_BYTES)[1].decode(opt.encoding or "utf-8", "replace").removeprefix("\ufeff").lstrip("\r\n")
    except LookupError:
        raise DiffError(f"unknown encoding: {opt.encoding}") from None
    head = head if head.strip() else first
    sep = opt.delimiter or sniff_delimiter(head.split("\n", 1)[0])
    names = next((r for r in csv.reader(io.StringIO(head, newline=""), delimiter=sep) if r), [])
    physical: dict[str, str] = {}
    for i, n in enumerate(names):
        physical.setdefault(n, f"f{i}")
    return Table(spark, names, source, kind, delimiter=sep, physical=physical)
