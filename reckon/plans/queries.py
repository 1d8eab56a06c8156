"""The queries of the diff engine over the driver's tables, and their SQL.

Side B of a pair is derived from side A by the same rule in both engines; rules use integers and text
alone, so that both agree to the bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.diff import COUNTS, Result, compare
from ..sources.sinks import shared_folder
from ..sources.tables import open_table
from . import datagen
from .options import Options

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ORDERS = "CAST(o_orderkey AS STRING) AS k, CAST(o_custkey AS STRING) AS cust, o_orderstatus AS status, CAST(CAST(ROUND(o_totalprice * 100) AS BIGINT) AS STRING) AS cents, o_orderpriority AS priority"
ORDERS_B = """CAST(o_orderkey + CASE WHEN o_orderkey % 1000 = 1 THEN 10000000 ELSE 0 END AS STRING) AS k, CAST(o_custkey AS STRING) AS cust,
 CASE WHEN o_orderkey % 33 = 0 THEN 'X' ELSE o_orderstatus END AS status,
 CASE WHEN o_orderkey % 71 = 0 THEN NULL WHEN o_orderkey % 67 = 0 THEN CAST(CAST(ROUND(o_totalprice * 100) AS BIGINT) + 1234 AS STRING) ELSE CAST(CAST(ROUND(o_totalprice * 100) AS BIGINT) AS STRING) END AS cents, o_orderpriority AS priority"""
LINES = "CAST(l_orderkey AS STRING) AS k1, CAST(l_linenumber AS STRING) AS k2, CAST(l_partkey AS STRING) AS part, CAST(l_suppkey AS STRING) AS supp, CAST(CAST(ROUND(l_quantity) AS BIGINT) AS STRING) AS qty, l_returnflag AS flag"
LINES_B = LINES.replace("l_returnflag AS flag", "CASE WHEN l_partkey % 29 = 0 THEN 'Z' ELSE l_returnflag END AS flag")

#: name: (A, B) as SELECTs that both engines read
PAIRS = {
    "orders": (f"SELECT {ORDERS} FROM orders", f"SELECT {ORDERS_B} FROM orders WHERE o_orderkey % 1000 <> 7"),
    "lineitem": (f"SELECT {LINES} FROM lineitem", f"SELECT {LINES_B} FROM lineitem WHERE l_orderkey % 500 <> 3"),
    "nullkey": ("SELECT CASE WHEN c_custkey % 400 = 0 THEN NULL ELSE CAST(c_custkey AS STRING) END AS k, c_mktsegment AS seg, CAST(c_nationkey AS STRING) AS nation FROM customer", "SELECT CASE WHEN c_custkey % 400 = 0 THEN NULL ELSE CAST(c_custkey AS STRING) END AS k, CASE WHEN c_custkey % 9 = 0 THEN 'moved' ELSE c_mktsegment END AS seg, CAST(c_nationkey AS STRING) AS nation FROM customer WHERE c_custkey % 70 <> 1"),
    "padded": ("SELECT CAST(p_partkey AS STRING) AS k, p_name AS name, p_brand AS brand, p_type AS type FROM part", "SELECT CASE WHEN p_partkey % 5 = 0 THEN concat('  ', CAST(p_partkey AS STRING), ' ') ELSE CAST(p_partkey AS STRING) END AS k, CASE WHEN p_partkey % 3 = 0 THEN concat(' ', p_name, '  ') ELSE p_name END AS name, CASE WHEN p_partkey % 4 = 0 THEN upper(p_brand) WHEN p_partkey % 4 = 1 THEN lower(p_brand) ELSE p_brand END AS brand, CASE WHEN p_partkey % 6 = 0 THEN '   ' WHEN p_partkey % 6 = 1 THEN '' ELSE p_type END AS type FROM part"),
    "typed": ("SELECT event_id AS k, user_id AS u, event_type AS t, ts AS stamp FROM events", "SELECT event_id AS k, CASE WHEN event_id % 13 = 0 THEN user_id + 1 ELSE user_id END AS u, event_type AS t, ts AS stamp FROM events WHERE event_id % 101 <> 5"),
    "texts": ("SELECT doc_id AS k, text, lang, source FROM documents", "SELECT doc_id AS k, CASE WHEN doc_id % 10 = 0 THEN concat(text, '.') ELSE text END AS text, lang, CASE WHEN doc_id % 4 = 0 THEN 'moved' ELSE source END AS source FROM documents WHERE doc_id % 50 <> 9"),
    "talks": ("SELECT conv_id AS k1, turn AS k2, role, text FROM conversations", "SELECT conv_id AS k1, turn AS k2, CASE WHEN turn % 3 = 1 THEN upper(role) ELSE role END AS role, text FROM conversations WHERE conv_id % 40 <> 2"),
    "asym": ("SELECT s_suppkey AS k, s_name AS name, s_nationkey AS nation, 'x' AS left_only FROM supplier", "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN 'renamed' ELSE s_name END AS name, s_nationkey AS nation, 'y' AS right_only FROM supplier"),
}
TABLES = {"orders": "orders", "lineitem": "lineitem", "nullkey": "customer", "padded": "part", "typed": "events", "texts": "documents", "talks": "conversations", "asym": "supplier"}


def _pair(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    table = TABLES[name]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return tuple(spark.sql(sql.replace(f"FROM {table}", "FROM {src}"), src=df) for sql in PAIRS[name])


def _diff(name: str, **opt) -> Callable[[SparkSession, str], Result]:
    return lambda spark, d: compare(spark, *_pair(spark, d, name), Options(**opt))


def _norm(col: str, trim: bool = False, ignore_case: bool = False, empty_is_null: bool = False, **_) -> str:
    out = f"nullif(CAST({col} AS VARCHAR), '')"
    if trim:
        out = f"trim({out})"
    if ignore_case:
        out = f"lower({out})"
    return f"nullif({out}, '')" if trim and empty_is_null else out


def _ctes(name: str, key: tuple[str, ...], cols: tuple[str, ...], **opt) -> str:
    """a, b: the first row (by all cells) and the count of each key; j: their full join with d<i>."""
    sides = []
    for side, sql in zip("ab", PAIRS[name], strict=True):
        sql = sql.replace("AS STRING", "AS VARCHAR")
        keys = ", ".join(f"{_norm(k, **opt)} AS k{i}" for i, k in enumerate(key))
        cells = "".join(f", {_norm(c, **opt)} AS c{i}" for i, c in enumerate(cols))
        raw = ", ".join(f"{x} AS o{i}" for i, x in enumerate(dict.fromkeys([*key, *cols])))
        order = ", ".join(f"o{i} ASC NULLS FIRST" for i in range(len(dict.fromkeys([*key, *cols]))))
        part = ", ".join(f"k{i}" for i in range(len(key)))
        sides.append(f"{side}0 AS (SELECT {keys}{cells}, {raw} FROM ({sql})), {side} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS rn, count(*) OVER (PARTITION BY {part}) AS n FROM {side}0) WHERE rn = 1)")
    on = " AND ".join(f"a.k{i} IS NOT DISTINCT FROM b.k{i}" for i in range(len(key)))
    ks = ", ".join(f"CASE WHEN a.n IS NOT NULL THEN a.k{i} ELSE b.k{i} END AS k{i}" for i in range(len(key)))
    cs = "".join(f", a.c{i} AS a{i}, b.c{i} AS b{i}, (a.n IS NOT NULL AND b.n IS NOT NULL AND {_apart(i, opt.get('tolerance', 0))}) AS d{i}" for i in range(len(cols)))
    return f"WITH {', '.join(sides)}, j AS (SELECT {ks}, a.n AS an, b.n AS bn{cs} FROM a FULL JOIN b ON {on})"


def _apart(i: int, tolerance: float) -> str:
    plain = f"a.c{i} IS DISTINCT FROM b.c{i}"
    if not tolerance:
        return plain
    x, y = f"TRY_CAST(a.c{i} AS DOUBLE)", f"TRY_CAST(b.c{i} AS DOUBLE)"
    return f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN abs({x} - {y}) > {tolerance} ELSE {plain} END"


def _any(cols) -> str:
    return "(" + (" OR ".join(f"d{i}" for i in range(len(cols))) or "FALSE") + ")"


def _counts_sql(name, key, cols, **opt) -> str:
    ch = f"count(*) FILTER (WHERE {_any(cols)})"
    both = "count(*) FILTER (WHERE an IS NOT NULL AND bn IS NOT NULL)"
    s = lambda c, w="": f"CAST(coalesce(sum({c}) {w}, 0) AS BIGINT)"
    each = {"a_rows": s("an"), "b_rows": s("bn"), "a_keys": "count(an)", "b_keys": "count(bn)", "a_dup_keys": "count(*) FILTER (WHERE an > 1)", "a_dup_rows": s("an", "FILTER (WHERE an > 1)"), "b_dup_keys": "count(*) FILTER (WHERE bn > 1)", "b_dup_rows": s("bn", "FILTER (WHERE bn > 1)"), "matched": both, "unchanged": f"{both} - {ch}", "changed": ch, "added": "count(*) FILTER (WHERE an IS NULL)", "removed": "count(*) FILTER (WHERE bn IS NULL)"}
    return f"{_ctes(name, key, cols, **opt)} SELECT {', '.join(f'{each[k]} AS {k}' for k in COUNTS)} FROM j"


def _stats_sql(name, key, cols, **opt) -> str:
    rows = " UNION ALL ".join(f"SELECT {i} AS idx, '{c}' AS \"column\", count(*) FILTER (WHERE d{i}) AS changed, count(*) FILTER (WHERE d{i} AND b{i} IS NULL) AS blanked, count(*) FILTER (WHERE d{i} AND a{i} IS NULL) AS filled FROM j" for i, c in enumerate(cols))
    return f"{_ctes(name, key, cols, **opt)} {rows}"


def _add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


def _add_counts(query: str, pair: str, key: tuple[str, ...], cols: tuple[str, ...], **opt) -> None:
    made = {k: v for k, v in opt.items() if k not in ("sql_cols",)}
    _add(query, lambda s, d: _diff(pair, key=key, **made)(s, d).counts_frame(), _counts_sql(pair, key, cols, **{k: v for k, v in made.items() if k in ("trim", "ignore_case", "empty_is_null", "tolerance")}))


_O, _L = ("cust", "status", "cents", "priority"), ("part", "supp", "qty", "flag")
_add_counts("diff_counts_orders", "orders", ("k",), _O)
_add_counts("diff_counts_lineitem_dups", "lineitem", ("k1", "k2"), _L)
_add_counts("diff_composite_key", "lineitem", ("k1", "k2", "part"), ("supp", "qty", "flag"))
_add_counts("diff_null_key", "nullkey", ("k",), ("seg", "nation"))
_P = ("name", "brand", "type")
_add_counts("diff_plain_text", "padded", ("k",), _P)
_add_counts("diff_trim", "padded", ("k",), _P, trim=True)
_add_counts("diff_ignore_case", "padded", ("k",), _P, ignore_case=True)
_add_counts("diff_empty_is_null", "padded", ("k",), _P, empty_is_null=True)
_add_counts("diff_all_flags", "padded", ("k",), _P, trim=True, ignore_case=True, empty_is_null=True)
_add_counts("diff_tolerance", "orders", ("k",), _O, tolerance=1300.0)
_add_counts("diff_tolerance_tight", "orders", ("k",), _O, tolerance=1000.0)
_add_counts("diff_ignore_columns", "orders", ("k",), ("cust", "status", "priority"), ignore=("cents",))
_add_counts("diff_compare_subset", "orders", ("k",), ("cents", "status", "cents"), compare=("cents", "status", "cents", "k"))
_add_counts("diff_no_compared_columns", "orders", ("k",), (), compare=("cents",), ignore=("cents",))
_add_counts("diff_asymmetric_schema", "asym", ("k",), ("name", "nation"))
_add_counts("diff_documents_text", "texts", ("k",), ("text", "lang", "source"))
_add_counts("diff_conversations", "talks", ("k1", "k2"), ("role", "text"))
_add_counts("diff_events_typed", "typed", ("k",), ("u", "t", "stamp"))
_add_counts("diff_strategy_sortmerge", "orders", ("k",), _O, strategy="sortmerge")
_add_counts("diff_strategy_shuffle_hash", "orders", ("k",), _O, strategy="shuffle_hash")
_add("diff_column_stats_orders", lambda s, d: _diff("orders", key=("k",))(s, d).column_stats_frame(), _stats_sql("orders", ("k",), _O))
_add("diff_column_stats_lineitem", lambda s, d: _diff("lineitem", key=("k1", "k2"))(s, d).column_stats_frame(), _stats_sql("lineitem", ("k1", "k2"), _L))


def _changed_long(s: SparkSession, d: str) -> DataFrame:
    r = _diff("orders", key=("k",))(s, d)
    names = F.array(*[F.lit(c) for c in r.resolved.compared])
    return r.changed(False).select("k", F.explode("diffs").alias("x")).select("k", F.get(names, F.col("x.col")).alias("column"), F.col("x.a").alias("a"), F.col("x.b").alias("b"))


_J = _ctes("orders", ("k",), _O)
_add("diff_changed_long", _changed_long, _J + " " + " UNION ALL ".join(f"SELECT k0 AS k, '{c}' AS \"column\", a{i} AS a, b{i} AS b FROM j WHERE d{i}" for i, c in enumerate(_O)))
_add("diff_changed_wide_export", lambda s, d: _diff("orders", key=("k",))(s, d).changed_wide(), _J + " SELECT k0 AS k, " + ", ".join(f'a{i} AS "{c} (A)", b{i} AS "{c} (B)"' for i, c in enumerate(_O)) + f" FROM j WHERE {_any(_O)}")
_add("diff_added", lambda s, d: _diff("orders", key=("k",))(s, d).added(False), _J + " SELECT k0 AS k, " + ", ".join(f"b{i} AS {c}" for i, c in enumerate(_O)) + " FROM j WHERE an IS NULL")
_add("diff_removed", lambda s, d: _diff("orders", key=("k",))(s, d).removed(False), _J + " SELECT k0 AS k, " + ", ".join(f"a{i} AS {c}" for i, c in enumerate(_O)) + " FROM j WHERE bn IS NULL")
_add("diff_sections_capped", lambda s, d: _diff("orders", key=("k",), max_rows=25)(s, d).changed().select("k", F.size("diffs").alias("n")), _J + " SELECT k0 AS k, " + " + ".join(f"CAST(d{i} AS INTEGER)" for i in range(4)) + f" AS n FROM j WHERE {_any(_O)} ORDER BY k0 LIMIT 25")
_JL = _ctes("lineitem", ("k1", "k2"), _L)
_add("diff_dup_keys_lineitem", lambda s, d: _diff("lineitem", key=("k1", "k2"))(s, d).duplicates("a", False), _JL + ' SELECT k0 AS k1, k1 AS k2, an AS "rows" FROM j WHERE an > 1')
_add("diff_dup_keys_top", lambda s, d: _diff("lineitem", key=("k1", "k2"), max_rows=40)(s, d).duplicates("b"), _JL + ' SELECT k0 AS k1, k1 AS k2, bn AS "rows" FROM j WHERE bn > 1 ORDER BY bn DESC, k0, k1 LIMIT 40')


def _first(s: SparkSession, d: str) -> DataFrame:
    r = _diff("lineitem", key=("k1", "k2"))(s, d)
    return r.joined.where("an is not null").select(F.col("k0").alias("k1"), F.col("k1").alias("k2"), *[F.col(f"av.c{i}").alias(c) for i, c in enumerate(_L)], F.col("an").alias("n"))


_add("diff_first_occurrence_lineitem", _first, _JL + " SELECT k0 AS k1, k1 AS k2, " + ", ".join(f"c{i} AS {c}" for i, c in enumerate(_L)) + ", n FROM a")
_ALL = ("k", *_O)
_add("diff_all_columns_key_except", lambda s, d: _diff("orders", key=_ALL)(s, d).removed(False), " EXCEPT ".join(PAIRS["orders"]).replace("AS STRING", "AS VARCHAR"))
_add("diff_intersect", lambda s, d: _matched(_diff("orders", key=_ALL)(s, d)), " INTERSECT ".join(PAIRS["orders"]).replace("AS STRING", "AS VARCHAR"))


def _matched(r: Result) -> DataFrame:
    return r.joined.where("an is not null and bn is not null").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(r.resolved.key)])


def _identical(s: SparkSession, d: str) -> DataFrame:
    a, _ = _pair(s, d, "orders")
    return compare(s, a, a, Options(key=("k",))).counts_frame().select("changed", "added", "removed")


_add("diff_identical", _identical, "SELECT CAST(0 AS BIGINT) AS changed, CAST(0 AS BIGINT) AS added, CAST(0 AS BIGINT) AS removed")


def _identities(s: SparkSession, d: str) -> DataFrame:
    c = _diff("lineitem", key=("k1", "k2"))(s, d).counts_frame()
    return c.selectExpr("matched = unchanged + changed as matched_ok", "removed = a_keys - matched as removed_ok", "added = b_keys - matched as added_ok", "a_rows - a_keys = a_dup_rows - a_dup_keys as a_ok", "b_rows - b_keys = b_dup_rows - b_dup_keys as b_ok")


_add("contract_identities", _identities, f"SELECT matched = unchanged + changed AS matched_ok, removed = a_keys - matched AS removed_ok, added = b_keys - matched AS added_ok, a_rows - a_keys = a_dup_rows - a_dup_keys AS a_ok, b_rows - b_keys = b_dup_rows - b_dup_keys AS b_ok FROM ({_counts_sql('lineitem', ('k1', 'k2'), _L)})")


def _head(s: SparkSession, d: str) -> DataFrame:
    """The first rows of a file, as the engine shows them."""
    t = open_table(s, f"{d}/nation.parquet")
    return s.createDataFrame(t.head(10, Options()), ", ".join(f"{n} string" for n in t.names))


_add("head_nation", _head, "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM (SELECT *, row_number() OVER () AS rn FROM nation) WHERE rn <= 10")


def _parquet_paths(s: SparkSession, d: str) -> DataFrame:
    """Keys that repeat, read by path: rows count, and the first row of a key in file order meets that of the other side."""
    opt = Options(key=("l_orderkey", "l_linenumber"), compare=("l_returnflag", "l_suppkey"))
    return compare(s, f"{d}/lineitem.parquet", f"{d}/lineitem.parquet", opt).counts_frame()


_K = "(SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)"
_EACH = {"rows": "sum(n)", "keys": "count(*)", "dup_keys": "count(*) FILTER (WHERE n > 1)", "dup_rows": "coalesce(sum(n) FILTER (WHERE n > 1), 0)"}
_add("diff_parquet_paths", _parquet_paths, "SELECT " + ", ".join(f"CAST({_EACH[k[2:]] if k[2:] in _EACH else 'count(*)' if k in ('matched', 'unchanged') else '0'} AS BIGINT) AS {k}" for k in COUNTS) + f" FROM {_K}")


def _from_text(kind: str) -> Query:
    """A table written as text and read back by path, against its Parquet file, on columns that have one text."""

    def run(s: SparkSession, d: str) -> DataFrame:
        cols = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
        folder = shared_folder(s, f"diff-{kind}")
        drifted = s.read.parquet(f"{d}/customer.parquet").where("c_custkey % 50 <> 3").selectExpr("cast(c_custkey as string) as c_custkey", "c_name", "cast(c_nationkey as string) as c_nationkey", "case when c_custkey % 20 = 0 then concat(c_mktsegment, ', \"q\"') else c_mktsegment end as c_mktsegment")
        datagen.write(drifted, folder, kind)
        return compare(s, f"{d}/customer.parquet", folder, Options(key=("c_custkey",), compare=tuple(cols[1:]))).changed(False).select("c_custkey", F.size("diffs").alias("n"), F.col("diffs")[0]["b"].alias("b"))

    return run


for _kind in ("csv", "ndjson"):
    _add(f"diff_{_kind}_path", _from_text(_kind), "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, 1 AS n, c_mktsegment || ', \"q\"' AS b FROM customer WHERE c_custkey % 20 = 0 AND c_custkey % 50 <> 3")


def _wide(s: SparkSession, d: str) -> DataFrame:
    """A hundred compared columns: statistics are grouped from the differing cells."""
    df = s.read.parquet(f"{d}/part.parquet")
    a = df.selectExpr("p_partkey AS k", *[f"cast(p_partkey % {i + 2} as string) AS w{i}" for i in range(100)])
    b = df.selectExpr("p_partkey AS k", *[f"case when p_partkey % 97 = {i % 97} then null else cast(p_partkey % {i + 2} as string) end AS w{i}" for i in range(100)])
    return compare(s, a, b, Options(key=("k",))).column_stats_frame()


_add("diff_wide_column_stats", _wide, " UNION ALL ".join(f"SELECT {i} AS idx, 'w{i}' AS \"column\", count(*) FILTER (WHERE p_partkey % 97 = {i % 97}) AS changed, count(*) FILTER (WHERE p_partkey % 97 = {i % 97}) AS blanked, CAST(0 AS BIGINT) AS filled FROM part" for i in range(100)))


def _stamps(s: SparkSession, d: str) -> DataFrame:
    """Timestamps that differ, as text."""
    df = s.read.parquet(f"{d}/events.parquet")
    b = df.selectExpr("event_id", "case when event_id % 17 = 0 then ts + interval 1500 milliseconds else ts end as ts")
    return compare(s, df.select("event_id", "ts"), b, Options(key=("event_id",))).changed(False).select("event_id", F.col("diffs")[0]["b"].alias("b"))


_STAMP = "ts + INTERVAL 1500 MILLISECONDS"
_add("diff_timestamp_text", _stamps, f"SELECT CAST(event_id AS VARCHAR) AS event_id, regexp_replace(strftime({_STAMP}, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') AS b FROM events WHERE event_id % 17 = 0")
