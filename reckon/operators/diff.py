"""The keyed diff: first occurrence per key, null-safe full outer join, one counting aggregate.

Plan: keys are encoded without nulls; each side is reduced to the least row of its row order (partial aggregation
before the one shuffle on the key), the sides meet in an equi join on the same keys and partitions, and counts and column statistics come from one
aggregate over the join. Sections are lazy: sorted and capped only when asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce
from itertools import groupby
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import canonical_text, differs, normalise, packed, unpackable, unpacked
from ..plans.options import DiffError, Options
from ..plans.resolve import Resolved, resolve
from ..sources.tables import Table, open_table

COUNTS = ("a_rows", "b_rows", "a_keys", "b_keys", "a_dup_keys", "a_dup_rows", "b_dup_keys", "b_dup_rows", "matched", "unchanged", "changed", "added", "removed")
#: From so many compared columns on, their statistics are grouped from exploded cells, and their texts packed.
WIDE = 64


def first_occurrence(table: Table, res: Resolved, opt: Options, side: str) -> DataFrame:
    """k0.. (encoded), <side>v (struct of the first row's cells as normalised text), <side>n (rows of the key).

    A task sorts its rows by key, so they are kept small until then: rows that their own cells order are kept once, not once
    more as their order, and texts of wide tables are packed.
    """
    df = table.read(res.key, res.compared, opt)
    kind = {n: df.schema[table.column(n)].dataType for n in (*res.key, *res.compared)}
    text = lambda n, col: normalise(canonical_text(col, kind[n], n), opt)
    by_cells = table.by_cells(opt)
    names = list(dict.fromkeys([*res.key, *res.compared] if by_cells else res.compared))
    runs = [(False, [n]) for n in names]
    if len(res.compared) >= WIDE:  # texts that stand side by side make one field
        runs = [(texts, [*g]) for texts, g in groupby(names, lambda n: kind[n] == T.StringType())]
        runs = [r for texts, g in runs for r in ([(True, g)] if texts else [(False, [n]) for n in g])]
    own = lambda g: [F.col(table.column(n)) for n in g]
    df = df.withColumns({f"_text{j}": packed(own(g)) for j, (texts, g) in enumerate(runs) if texts})
    parts = [(unpackable(F.col(f"_text{j}"), own(g)) if texts else own(g)[0]).alias(f"p{j}") for j, (texts, g) in enumerate(runs)] or [F.lit(1).alias("p0")]
    keys = [f"k{i}" for i in range(len(res.key))]
    rows = df.select(*[_encoded(text(n, F.col(table.column(n))), opt).alias(k) for k, n in zip(keys, res.key, strict=True)], F.struct(*parts).alias("_row"), *([] if by_cells else ["_ord"]))
    first = F.min("_row") if by_cells else F.min_by("_row", "_ord")
    t = rows.groupBy(*keys).agg(first.alias("_row"), F.count(F.lit(1)).alias(f"{side}n")).select(*keys, f"{side}n", "_row.*")
    t = t.withColumns({f"p{j}": unpacked(F.col(f"p{j}")) for j, (texts, _) in enumerate(runs) if texts})
    raw = {n: F.get(F.col(f"p{j}"), F.lit(i)) if texts else F.col(f"p{j}") for j, (texts, g) in enumerate(runs) for i, n in enumerate(g)}
    cells = [text(n, raw[n]).alias(f"c{i}") for i, n in enumerate(res.compared)] or [F.lit(1).alias("_")]
    return t.select(*keys, F.struct(*cells).alias(f"{side}v"), f"{side}n")


def prepared(table: Table, res: Resolved, opt: Options) -> DataFrame:
    """Positional columns k0.., c0.. as normalised text, and _ord."""
    df = table.read(res.key, res.compared, opt)
    schema = df.schema
    cell = lambda n: normalise(canonical_text(F.col(table.column(n)), schema[table.column(n)].dataType, n), opt)
    return df.select(*[cell(k).alias(f"k{i}") for i, k in enumerate(res.key)], *[cell(c).alias(f"c{i}") for i, c in enumerate(res.compared)], "_ord")


def _encoded(key: Column, opt: Options) -> Column:
    """A key cell without nulls, in the same order, so that grouping and joining share one partitioning."""
    if opt.trim and not opt.empty_is_null:  # trimming may leave an empty text, which is not an absent one
        return F.when(key.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), key))
    return F.coalesce(key, F.lit(""))


def _decoded(key: Column, opt: Options) -> Column:
    if opt.trim and not opt.empty_is_null:
        return F.when(key != "", F.substring(key, F.lit(2), F.length(key)))
    return F.nullif(key, F.lit(""))


@dataclass
class Result:
    """Counts are computed once; sections and statistics are DataFrames."""

    resolved: Resolved
    options: Options
    joined: DataFrame
    a: DataFrame
    b: DataFrame
    a_names: list[str]
    b_names: list[str]
    _held: bool = field(default=False)

    def _key(self) -> list[str]:
        return [f"k{i}" for i in range(len(self.resolved.key))]

    @property
    def _d(self) -> list[Column]:
        both = F.col("an").isNotNull() & F.col("bn").isNotNull()
        return [both & differs(F.col(f"av.c{i}"), F.col(f"bv.c{i}"), self.options.tolerance) for i in range(len(self.resolved.compared))]

    @property
    def _any(self) -> Column:
        return reduce(or_, self._d, F.lit(False))

    def _narrow(self) -> list[Column]:
        out = []
        if len(self.resolved.compared) < WIDE:
            for i, d in enumerate(self._d):
                out += [F.count_if(d).alias(f"s{i}"), F.count_if(d & F.col(f"bv.c{i}").isNull()).alias(f"b{i}"), F.count_if(d & F.col(f"av.c{i}").isNull()).alias(f"f{i}")]
        return out

    def counts_frame(self) -> DataFrame:
        """One row with the thirteen counts."""
        return self._totals().select(*COUNTS)

    def _totals(self) -> DataFrame:
        a, b = F.col("an"), F.col("bn")
        both = a.isNotNull() & b.isNotNull()
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        changed = F.count_if(self._any)
        return self.joined.agg(
            total(a).alias("a_rows"), total(b).alias("b_rows"), F.count_if(a.isNotNull()).alias("a_keys"), F.count_if(b.isNotNull()).alias("b_keys"),
            F.count_if(a > 1).alias("a_dup_keys"), total(F.when(a > 1, a)).alias("a_dup_rows"), F.count_if(b > 1).alias("b_dup_keys"), total(F.when(b > 1, b)).alias("b_dup_rows"),
            F.count_if(both).alias("matched"), (F.count_if(both) - changed).alias("unchanged"), changed.alias("changed"),
            F.count_if(a.isNull()).alias("added"), F.count_if(b.isNull()).alias("removed"), *self._narrow(),
        )

    @cached_property
    def _row(self) -> dict:
        row = self._totals().first().asDict()
        check_identities(row)
        return row

    @property
    def counts(self) -> dict[str, int]:
        return {k: self._row[k] for k in COUNTS}

    @property
    def identical(self) -> bool:
        return not (self.counts["changed"] or self.counts["added"] or self.counts["removed"])

    def column_stats_frame(self) -> DataFrame:
        """column, changed, blanked (absent in B), filled (absent in A), in compared order by idx."""
        spark = self.joined.sparkSession
        names = spark.createDataFrame([(i, c) for i, c in enumerate(self.resolved.compared)], "idx int, column string")
        cells = self.joined.where(self._any).select(F.explode(self._diffs()).alias("x")).groupBy(F.col("x.col").alias("idx")).agg(F.count("*").alias("changed"), F.count_if(F.col("x.b").isNull()).alias("blanked"), F.count_if(F.col("x.a").isNull()).alias("filled"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
        return names.join(F.broadcast(cells), "idx", "left").select("idx", "column", zero("changed"), zero("blanked"), zero("filled"))

    @cached_property
    def column_stats(self) -> list[dict]:
        if len(self.resolved.compared) < WIDE:
            r = self._row
            return [{"column": c, "changed": r[f"s{i}"], "blanked": r[f"b{i}"], "filled": r[f"f{i}"]} for i, c in enumerate(self.resolved.compared)]
        return [{k: r[k] for k in ("column", "changed", "blanked", "filled")} for r in sorted(self.column_stats_frame().collect(), key=lambda r: r["idx"])]

    def _diffs(self) -> Column:
        each = [F.struct(F.lit(i).alias("col"), F.col(f"av.c{i}").alias("a"), F.col(f"bv.c{i}").alias("b"), d.alias("d")) for i, d in enumerate(self._d)]
        if not each:
            return F.array().cast("array<struct<col:int,a:string,b:string>>")
        return F.transform(F.filter(F.array(*each), lambda x: x["d"]), lambda x: F.struct(x["col"], x["a"], x["b"]))

    def _sorted(self, df: DataFrame, capped: bool) -> DataFrame:
        df = df.orderBy(*[F.col(k).asc_nulls_last() for k in self._key()])
        return df.limit(self.options.max_rows) if capped else df

    def _named_keys(self) -> list[Column]:
        return [F.col(k).alias(n) for k, n in zip(self._key(), self.resolved.key, strict=True)]

    def changed(self, capped: bool = True) -> DataFrame:
        """Keys and diffs: the differing cells as (col, a, b), col an index of the compared columns."""
        return self._sorted(self.joined.where(self._any).select(*self._key(), self._diffs().alias("diffs")), capped).select(*self._named_keys(), "diffs")

    def changed_wide(self, capped: bool = False) -> DataFrame:
        """Keys and a pair of columns, "c (A)" and "c (B)", for each compared column."""
        pairs = [F.col(f"{s}v.c{i}").alias(f"{c} ({s.upper()})") for i, c in enumerate(self.resolved.compared) for s in "ab"]
        return self._sorted(self.joined.where(self._any), capped).select(*self._named_keys(), *pairs)

    def _one_side(self, side: str, capped: bool) -> DataFrame:
        gone = "bn" if side == "a" else "an"
        return self._sorted(self.joined.where(F.col(gone).isNull()), capped).select(*self._named_keys(), *[F.col(f"{side}v.c{i}").alias(c) for i, c in enumerate(self.resolved.compared)])

    def added(self, capped: bool = True) -> DataFrame:
        return self._one_side("b", capped)

    def removed(self, capped: bool = True) -> DataFrame:
        return self._one_side("a", capped)

    def duplicates(self, side: str, capped: bool = True) -> DataFrame:
        """Keys seen more than once and how often, most first, then by key."""
        n = F.col(f"{side}n")
        df = self.joined.where(n > 1).orderBy(n.desc(), *[F.col(k).asc_nulls_last() for k in self._key()])
        return (df.limit(self.options.max_rows) if capped else df).select(*self._named_keys(), n.alias("rows"))

    def truncated(self) -> dict[str, bool]:
        top = self.options.max_rows
        return {"changed": self.counts["changed"] > top, "added": self.counts["added"] > top, "removed": self.counts["removed"] > top, "dup_a": self.counts["a_dup_keys"] > top, "dup_b": self.counts["b_dup_keys"] > top}

    def hold(self) -> Result:
        """Keep the join for several actions; release() lets it go."""
        self.joined = self.joined.persist()
        self._held = True
        return self

    def release(self) -> None:
        if self._held:
            self.joined.unpersist()
            self._held = False


def check_identities(c: dict) -> None:
    """The arithmetic that any result obeys."""
    ok = {
        "matched = unchanged + changed": c["matched"] == c["unchanged"] + c["changed"],
        "removed = a_keys - matched": c["removed"] == c["a_keys"] - c["matched"],
        "added = b_keys - matched": c["added"] == c["b_keys"] - c["matched"],
        "a_rows - a_keys = a_dup_rows - a_dup_keys": c["a_rows"] - c["a_keys"] == c["a_dup_rows"] - c["a_dup_keys"],
        "b_rows - b_keys = b_dup_rows - b_dup_keys": c["b_rows"] - c["b_keys"] == c["b_dup_rows"] - c["b_dup_keys"],
    }
    if bad := [k for k, v in ok.items() if not v]:
        raise AssertionError(f"counts break {', '.join(bad)}: {c}")


def compare(spark: SparkSession, a: str | DataFrame, b: str | DataFrame, options: Options) -> Result:
    """Compare two tables, each a path or a DataFrame."""
    opt = options.validate()
    ta, tb = open_table(spark, a, opt), open_table(spark, b, opt)
    res = resolve(ta.names, tb.names, opt)
    pa_, pb = prepared(ta, res, opt), prepared(tb, res, opt)
    n = len(res.key)
    left, right = first_occurrence(ta, res, opt, "a"), first_occurrence(tb, res, opt, "b")
    right = right.select(*[F.col(f"k{i}").alias(f"_k{i}") for i in range(n)], "bv", "bn")
    if opt.hint:
        right = right.hint(opt.hint)
    on = reduce(and_, [F.col(f"k{i}") == F.col(f"_k{i}") for i in range(n)])
    joined = left.join(right, on, "full_outer").select(*[_decoded(F.coalesce(f"k{i}", f"_k{i}"), opt).alias(f"k{i}") for i in range(n)], "av", "an", "bv", "bn")
    return Result(res, opt, joined, pa_, pb, ta.names, tb.names)


__all__ = ["COUNTS", "DiffError", "Result", "check_identities", "compare", "first_occurrence", "prepared"]
