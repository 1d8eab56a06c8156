import csv
import gzip
import io
import json
import random
from base64 import b64decode
from datetime import date, datetime
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oracle import diff
from reckon import cli
from reckon.functions.cells import as_number, differs, number_text
from reckon.operators.diff import compare
from reckon.plans import datagen
from reckon.plans.options import DiffError, Options, parse_count, parse_list, parse_size, profiles, with_profile
from reckon.plans.resolve import resolve
from reckon.sources import sinks
from reckon.sources.tables import open_table, sniff_delimiter

FLAGS = ("trim", "ignore_case", "empty_is_null")


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(text.encode())
    return str(p)


def both(spark, tmp_path, a, b, **opt):
    return compare(spark, put(tmp_path, "a.csv", a), put(tmp_path, "b.csv", b), Options(**opt))


SIMPLE = ("tree,leaf,rings\noak,lobed,120\nfir,needle,44\nash,pinnate,61\n", "tree,leaf,rings\noak,lobed,120\nfir,needle,45\nelm,toothed,9\n")


def test_simple_pair_and_sections(spark, tmp_path):
    r = both(spark, tmp_path, *SIMPLE, key=("tree",))
    assert {k: r.counts[k] for k in ("a_rows", "b_keys", "matched", "unchanged", "changed", "added", "removed")} == {"a_rows": 3, "b_keys": 3, "matched": 2, "unchanged": 1, "changed": 1, "added": 1, "removed": 1}
    assert [(x["tree"], [tuple(d) for d in x["diffs"]]) for x in r.changed().collect()] == [("fir", [(1, "44", "45")])]
    assert [tuple(x) for x in r.added().collect()] == [("elm", "toothed", "9")]
    assert [tuple(x) for x in r.removed().collect()] == [("ash", "pinnate", "61")]
    assert not r.identical
    assert r.column_stats == [{"column": "leaf", "changed": 0, "blanked": 0, "filled": 0}, {"column": "rings", "changed": 1, "blanked": 0, "filled": 0}]


def test_identical_and_quoted_empty(spark, tmp_path):
    assert both(spark, tmp_path, SIMPLE[0], SIMPLE[0], key=("tree",)).identical
    assert both(spark, tmp_path, 'river,town\n"Elbe",""\nOder,\nRhine,Bonn\n', 'river,town\nElbe,\nOder,""\nRhine,Bonn\n', key=("river",)).counts["changed"] == 0


def test_first_occurrence_wins_in_file_order(spark, tmp_path):
    r = both(spark, tmp_path, "hut,guest\nwest,Ida\nnorth,Otto\neast,Uwe\nnorth,Ada\nnorth,Bo\n", "hut,guest\nnorth,Otto\neast,Uwe\nwest,Ida\n", key=("hut",))
    assert (r.counts["changed"], r.counts["a_dup_keys"], r.counts["a_dup_rows"]) == (0, 1, 3)
    assert [tuple(x) for x in r.duplicates("a").collect()] == [("north", 3)]


def test_normalising_and_tolerance(spark, tmp_path):
    assert both(spark, tmp_path, "lot,kg,mark\nx7,3.250,  Blue Star\n", "lot,kg,mark\nx7,3.25401,blue star \n", key=("lot",), tolerance=0.005, trim=True, ignore_case=True).counts["changed"] == 0
    r = both(spark, tmp_path, "gate,sign\nA,stop\nB,\n", "gate,sign\nA,\nB,slow\n", key=("gate",))
    assert r.column_stats == [{"column": "sign", "changed": 2, "blanked": 1, "filled": 1}]


@pytest.mark.parametrize(("trim", "empty", "n"), [(True, False, 1), (True, True, 0), (False, False, 3)])
def test_trim_to_empty(spark, tmp_path, trim, empty, n):
    r = both(spark, tmp_path, "port,pilot,tide\nKiel,   ,low\nBrake,Jan,ebb\nEmden,  ,high\nHusum,\tPia ,low\n", "port,pilot,tide\nKiel,,low\nBrake,Jan,ebb\nEmden,\t,high\nHusum,Pia,low\n", key=("port",), trim=trim, empty_is_null=empty)
    assert r.counts["changed"] == n


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("quoted", ["", '"two\nlines"'])
def test_a_lone_carriage_return_is_part_of_its_cell(spark, tmp_path, end, quoted):
    lines = ["pond,fish,depth", "east,carp\rpike,3", "west,eel,", "", 'north,"tench",4', "south,rudd", f"mid,{quoted or 'x'},5", 'low,roach,"6"', "far,bream,7,extra"]
    t = open_table(spark, put(tmp_path, "p.csv", end.join(lines) + end))
    assert t.head(20, Options()) == [["east", "carp\rpike", "3"], ["west", "eel", None], ["north", "tench", "4"], ["south", "rudd", None], ["mid", quoted.strip('"') or "x", "5"], ["low", "roach", "6"], ["far", "bream", "7"]]
    r = both(spark, tmp_path, end.join(lines) + end, "\n".join(lines).replace("carp\rpike", "carp") + "\n", key=("pond",))
    assert (r.counts["a_rows"], r.counts["matched"], r.counts["changed"], r.counts["removed"]) == (7, 7, 1, 0)


def test_delimiter_ragged_crlf_and_quoted_newline(spark, tmp_path):
    assert both(spark, tmp_path, "dish;spice\nsoup;salt\n", "dish;spice\nsoup;dill\n", key=("dish",)).counts["changed"] == 1
    assert sniff_delimiter("a|b|c,d") == "|" and sniff_delimiter("a,b;c") == ","
    assert both(spark, tmp_path, "k,v,w\r\n1,x,p\r\n\r\n2,y\r\n3,z,q,extra\r\n", "k,v,w\n1,x,CHANGED\n2,y,\n3,z,q\n", key=("k",)).counts["changed"] == 1
    r = both(spark, tmp_path, 'k,v\n"a\nb","say ""hi"", ok"\n', 'k,v\n"a\nb","say ""hi"", no"\n', key=("k",))
    assert [x["diffs"][0]["a"] for x in r.changed().collect()] == ['say "hi", ok']
    assert both(spark, tmp_path, "room,floor,wing\nblue,2,left\nred,5,right\n", "room,wing,floor\nblue,left,2\nred,5,right\n", key=("room",)).counts["changed"] == 1


def test_null_keys_match_and_sort_last(spark, tmp_path):
    r = both(spark, tmp_path, "k,v\n,x\nb,1\n", "k,v\n,y\na,1\n", key=("k",))
    assert (r.counts["matched"], r.counts["changed"], r.counts["added"]) == (1, 1, 1)


def test_keys_that_trim_to_nothing_are_not_absent(spark, tmp_path):
    a, b = "k,j,v\n  ,1,x\n,1,y\n =,1,z\n", "k,j,v\n\t,1,x\n,1,changed\n=,1,z\n"
    r = both(spark, tmp_path, a, b, key=("k", "j"), trim=True)
    assert (r.counts["a_keys"], r.counts["matched"], r.counts["changed"], r.counts["added"]) == (3, 3, 1, 0)
    assert [x["k"] for x in r.changed().collect()] == [None]
    assert {x["k0"] for x in r.joined.collect()} == {"", None, "="}
    one = both(spark, tmp_path, a, b, key=("k", "j"), trim=True, empty_is_null=True)
    assert (one.counts["a_keys"], one.counts["a_dup_rows"], one.counts["matched"]) == (2, 2, 2)


def test_one_shuffle_a_side(spark, tmp_path):
    plan = both(spark, tmp_path, *SIMPLE, key=("tree",)).joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_cap_is_the_smallest_keys(spark, tmp_path):
    keys = "jihgfedcba"
    r = both(spark, tmp_path, "k,v\n" + "".join(f"{k},x\n" for k in keys), "k,v\n" + "".join(f"{k},y\n" for k in keys), key=("k",), max_rows=3)
    assert [x["k"] for x in r.changed().collect()] == ["a", "b", "c"]
    assert r.truncated()["changed"] and not r.truncated()["added"] and r.counts["changed"] == 10


def test_export_json_and_page(spark, tmp_path):
    r = both(spark, tmp_path, *SIMPLE, key=("tree",))
    sinks.export(r, str(tmp_path / "deep" / "out"))
    rows = {n: list(csv.reader(open(tmp_path / "deep" / "out" / f"{n}.csv"))) for n in ("added", "removed", "changed")}
    assert all(len(x) == 2 for x in rows.values())
    assert rows["changed"][0] == ["tree", "leaf (A)", "leaf (B)", "rings (A)", "rings (B)"]
    doc = sinks.to_json(r, "x/<a>.csv", "b.csv", 1.0)
    assert set(doc) == {"meta", "counts", "columns"} and doc["meta"]["compared"] == ["leaf", "rings"]
    page = sinks.render_html(r, "x/<a>.csv", "b</script>.csv", 1.0)
    assert "<a>" not in page and "http" not in page.replace("http-equiv", "") and page.count("</script>") == 2
    packed = page.split('id="data">')[1].split("<")[0]
    assert json.loads(gzip.decompress(b64decode(packed)))["sections"]["changed"]["rows"] == [["fir", [[1, "44", "45"]]]]
    plain = sinks.render_html(r, "a", "b", 1.0, compress=False)
    assert '[1,"44","45"]' in plain and len(plain) > 0


def test_column_resolution():
    a, b = ["id", "x", "y", "id2"], ["id", "x", "y", "z"]
    assert resolve(a, b, Options(key=("id",))).compared == ("x", "y")
    r = resolve(a, b, Options(key=("id",), ignore=("z",), compare=("y", "x", "y", "id")))
    assert (r.compared, r.only_in_a, r.only_in_b) == (("y", "x", "y"), ("id2",), ("z",))
    assert resolve(a, b, Options(key=("id",), ignore=("x",), compare=("x",))).compared == ()
    for opt, word in ((Options(key=("nope",)), "nope"), (Options(key=("id", "id2")), "id2"), (Options(key=("id",), ignore=("zz",)), "zz"), (Options(key=("id",), compare=("z",)), "z")):
        with pytest.raises(DiffError, match=word):
            resolve(a, b, opt)


@pytest.mark.parametrize("bad", [{"key": ()}, {"tolerance": -1}, {"max_rows": 0}, {"strategy": "x"}, {"delimiter": ",,"}])
def test_option_validation(bad):
    with pytest.raises(DiffError):
        Options(**({"key": ("k",)} | bad)).validate()


def test_parsing_and_profiles(tmp_path, monkeypatch):
    assert parse_list(" a, ,b ") == ("a", "b")
    assert (parse_count("10k"), parse_count("2.5m"), parse_count("1g")) == (10_000, 2_500_000, 10**9)
    assert (parse_size("8G"), parse_size("512MiB"), parse_size("7")) == (8 << 30, 512 << 20, 7)
    p = tmp_path / "x.toml"
    p.write_text('[profiles.bank]\nkey = ["a", "b"]\ntrim = true\nother = 1\n')
    assert with_profile(Options(), profiles(str(p))["bank"]) == Options(key=("a", "b"), trim=True)
    with pytest.raises(DiffError):
        profiles(str(tmp_path / "none.toml"))


@pytest.mark.parametrize(("x", "text"), [(3.0, "3"), (1e10, "10000000000"), (1e-10, "1e-10"), (2e23, "2e+23"), (5e-324, "5e-324"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-7, "1e-7"), (1e-6, "0.000001"), (-0.0, "0"), (float("nan"), "NaN"), (float("-inf"), "-Infinity"), (-1234.5, "-1234.5"), (1.5e300, "1.5e+300"), (123456789012345680000.0, "123456789012345680000")])
def test_number_text(x, text):
    assert number_text(x, repr(x)) == text


def test_cells_truth_table(spark):
    rows = [("1", "1.0", True), ("1", None, True), (None, None, False), ("x", "x", False), ("1e2", "100.4", False), ("inf", "infinity", True), ("1d", "1", True), (" 5 ", "5.4", False), ("1e400", "1", True), ("+.5", "0.9", False), ("5.", "5.6", True)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "a string, b string")
    plain = [r[0] for r in df.select(differs(F.col("a"), F.col("b"))).collect()]
    assert plain == [a != b for a, b, _ in rows]
    near = [r[0] for r in df.select(differs(F.col("a"), F.col("b"), 0.5)).collect()]
    assert near == [False, True, False, False, False, True, True, False, True, False, True]
    assert [r[0] for r in df.limit(1).select(as_number(F.lit("1e400"))).collect()] == [None]


def test_typed_parquet_equals_its_text(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("big", T.LongType()), T.StructField("r", T.DoubleType()), T.StructField("f", T.FloatType()), T.StructField("ok", T.BooleanType()), T.StructField("day", T.DateType()), T.StructField("at", T.TimestampNTZType()), T.StructField("utc", T.TimestampType()), T.StructField("m", T.DecimalType(12, 2))])
    rows = [("a", 1, -(2**31), 3.0, 0.1, True, date(1969, 12, 30), datetime(2024, 1, 1), datetime(2024, 1, 1, 2, 3, 4, 500000), Decimal("12345")), ("b", None, 2**62, 1e-10, 2.5, False, date(2024, 2, 29), datetime(2024, 1, 1, 0, 0, 0, 120), None, Decimal("-0.5"))]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "t.parquet"))
    text = "id,n,big,r,f,ok,day,at,utc,m\na,1,-2147483648,3,0.1,true,1969-12-30,2024-01-01T00:00:00,2024-01-01T02:03:04.5Z,12345.00\nb,,4611686018427387904,1e-10,2.5,false,2024-02-29,2024-01-01T00:00:00.00012,,-0.50\n"
    r = compare(spark, str(tmp_path / "t.parquet"), put(tmp_path, "t.csv", text), Options(key=("id",)))
    assert (r.counts["matched"], r.counts["changed"]) == (2, 0), r.changed().collect()


def test_nested_columns_are_refused(spark):
    df = spark.sql("select 1 as k, array(1) as v")
    with pytest.raises(DiffError, match="v"):
        compare(spark, df, df, Options(key=("k",)))
    assert compare(spark, df, df, Options(key=("k",), ignore=("v",))).identical


def _formats():
    base = [[f"ship {i}", "at sea", f"{i}.25", f"berth {i}, \"east\"", None if i % 3 else "tug"] for i in range(240)]
    other = [list(r) for r in base]
    for i, r in enumerate(other):
        if i % 5 == 0:
            r[1] = "moored"
        if i % 60 == 0:
            r[2] = None
    return [*base, ["ship gone", "x", "1", "n", None]], [*other, ["ship new", "x", "1", "n", None], list(other[0])]


NAMES = ["vessel", "state", "draught", "berth", "helper"]


def _write(path, rows, kind):
    if kind == "csv":
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([NAMES, *[["" if x is None else x for x in r] for r in rows]])
        path.write_text(out.getvalue())
    elif kind == "ndjson":
        path.write_text("".join(json.dumps(dict(zip(NAMES, r, strict=True))) + "\n" for r in rows))
    else:
        t = pa.table({n: pa.array([r[i] for r in rows], pa.string()) for i, n in enumerate(NAMES)})
        pq.write_table(t, path, compression=kind, row_group_size=64)
    return str(path)


@pytest.mark.parametrize(("x", "y"), [("csv", "csv"), ("ndjson", "ndjson"), ("snappy", "snappy"), ("csv", "gzip"), ("zstd", "ndjson"), ("none", "csv")])
def test_formats_agree_whatever_the_name(spark, tmp_path, x, y):
    a, b = _formats()
    r = compare(spark, _write(tmp_path / "a.dat", a, x), _write(tmp_path / "b.csv", b, y), Options(key=("vessel",)))
    assert tuple(r.counts.values()) == (241, 242, 241, 241, 0, 0, 1, 2, 240, 192, 48, 1, 1)
    assert [(s["changed"], s["blanked"], s["filled"]) for s in r.column_stats] == [(48, 0, 0), (4, 4, 0), (0, 0, 0), (0, 0, 0)]


def test_ndjson_members(spark, tmp_path):
    a = put(tmp_path, "a", '{"k":1,"k":2,"v":"x","n":1.50}\n{"v":"\\u00e9\\nz","k":"3","n":{"deep":1}}\n\nnot json\n')
    b = put(tmp_path, "b", '{"k":1,"v":"w","v":"y","n":1.50}\n{"k":"3","v":"é\\nz","n":null,"later":1}\n[1]\n')
    r = compare(spark, a, b, Options(key=("k",)))
    assert (r.counts["a_rows"], r.counts["matched"], r.counts["changed"]) == (3, 3, 1)
    assert open_table(spark, b).names == ["k", "v", "n"]


def test_a_folder_whose_first_file_is_empty(spark, tmp_path):
    rows = spark.createDataFrame([(f"pier {i}", str(i)) for i in range(40)], "pier string, depth string")
    for kind in ("ndjson", "csv"):
        folder = str(tmp_path / kind)
        datagen.write(rows.repartition(3, "pier").where(F.spark_partition_id() > 0), folder, kind)
        if kind == "csv":  # Spark puts a header there, others may not
            put(tmp_path, "csv/part-00000-0.csv", "")
        first = min(f for f in (tmp_path / kind).iterdir() if f.name.startswith("part-"))
        assert first.stat().st_size == 0
        t = open_table(spark, folder)
        assert (t.kind, t.names) == (kind, ["pier", "depth"])
        assert compare(spark, folder, rows.repartition(3, "pier").where(F.spark_partition_id() > 0), Options(key=("pier",))).identical


def test_truncated_parquet_and_missing_file(spark, tmp_path):
    p = _write(tmp_path / "t.parquet", _formats()[0], "snappy")
    data = open(p, "rb").read()
    open(p, "wb").write(data[:-10])
    with pytest.raises(DiffError, match="truncated"):
        open_table(spark, p)
    with pytest.raises(DiffError, match="no such file"):
        open_table(spark, str(tmp_path / "none.csv"))


def test_all_columns_as_key_is_except(spark, tmp_path):
    r = both(spark, tmp_path, "a,b\n1,\n2,x\n2,x\n", "a,b\n1,\n3,x\n", key=("a", "b"))
    assert r.resolved.compared == () and [tuple(x) for x in r.removed().collect()] == [("2", "x")]


@pytest.mark.parametrize("seed", range(6))
def test_random_pairs_against_plain_python(spark, tmp_path, seed):
    rnd = random.Random(seed)
    cols = [f"c{i}" for i in range(rnd.randint(2, 5))]
    word = lambda: rnd.choice(["", "a", "A", " a", "b,c", 'q"q', "x\ny", "é", "ß", "1.0", "1.2", "1", "-3e1", "  "])
    a = [[rnd.choice(["k1", "k2", "", "K3", " k4", f"u{i}"]), *[word() for _ in cols]] for i in range(rnd.randint(1, 40))]
    b = [[x if rnd.random() < 0.7 else word() for x in r] for r in a if rnd.random() < 0.9] + [[f"new{i}", *[word() for _ in cols]] for i in range(rnd.randint(0, 4))]
    rnd.shuffle(b)
    flags = {f: rnd.random() < 0.5 for f in FLAGS}
    tol = rnd.choice([0.0, 0.5])
    paths = []
    for n, rows in (("a.csv", a), ("b.csv", b)):
        out = io.StringIO()
        csv.writer(out, lineterminator=rnd.choice(["\n", "\r\n"])).writerows([["id", *cols], *rows])
        paths.append(put(tmp_path, n, out.getvalue()))
    clean = lambda rows: [r for r in rows if any(x for x in r)]
    counts, stats = diff(["id", *cols], clean(a), ["id", *cols], clean(b), ["id"], cols, tol, **flags)
    for parts in ("1", "3"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            r = compare(spark, *paths, Options(key=("id",), tolerance=tol, **flags))
            assert r.counts == counts
            assert [[s["changed"], s["blanked"], s["filled"]] for s in r.column_stats] == stats
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_wide_tables_use_grouped_cells(spark):
    a, b = datagen.pair(spark, 400, columns=100)
    r = compare(spark, a, b, Options(key=("depot", "parcel"), ignore=("touched_at",)))
    assert len(r.resolved.compared) == 97 and len(r.column_stats) == 97
    assert {s["column"]: s["changed"] for s in r.column_stats}["remark"] == 0


def _sorted_width(df):
    """Bytes that Spark reckons for a row of each sort of a sort aggregate, at its 20 a text."""
    todo, out = [df._jdf.queryExecution().sparkPlan()], []
    while todo:
        node = todo.pop()
        kids = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "SortAggregate":
            out += [sum(k.output().apply(i).dataType().defaultSize() for i in range(k.output().size())) for k in kids]
        todo += kids
    return out


@pytest.mark.parametrize(("n", "most"), [(10, 300), (100, 300)])
def test_rows_are_small_when_they_are_sorted_by_key(spark, n, most):
    df = spark.range(5).selectExpr("id", *[f"cast(id % {i + 2} as string) as w{i}" for i in range(n)])
    width = _sorted_width(compare(spark, df, df, Options(key=("id",))).joined)
    assert len(width) == 4 and max(width) <= most


@pytest.mark.parametrize("kind", ["dataframe", "order_by", "parquet", "csv"])
@pytest.mark.parametrize("flags", [{}, {"trim": True}])
def test_packed_texts_are_the_same_cells(spark, tmp_path, monkeypatch, kind, flags):
    rnd = random.Random(len(kind) + len(flags))
    odd = [None, "", "\x00", "\x01", "\x01\x01", "\x01\x02", "\x00\x01", "\x02", "=", " ", "a", "A ", "a\x00", "aé", "é", "😀", "\uffff", "1.50"] if kind != "csv" else [None, "a", "A ", "é", "1.50", "=", "b,c"]
    names = ["k", "w0", "n1", "w2", "w3", "w4", "d5", "w6", "n7"]
    kinds = {"n": "long", "d": "double", "w": "string", "k": "string"}
    value = {"n": lambda: rnd.choice([None, -5, 10, 9]), "d": lambda: rnd.choice([None, 0.1, -3.0, 1e21]), "w": lambda: rnd.choice(odd)}
    base = [[None if rnd.random() < 0.7 else value[n[0]]() for n in names[1:]] for _ in range(60)]
    rows = [[rnd.choice(["", None, "x", "y", " y", f"u{i}"]), *r] for i, r in enumerate(base)]
    sides = []
    for s in "ab":
        df = spark.createDataFrame([r for r in rows if rnd.random() < 0.9], ", ".join(f"{n} {kinds[n[0]]}" for n in names)).coalesce(1)
        if kind in ("dataframe", "parquet"):  # bytes that are no UTF-8
            df = df.withColumns({"w3": F.when(F.col("n1").isNotNull(), F.expr("cast(X'61ff' as string)")).otherwise(F.col("w3")), "w6": F.when(F.col("n7").isNotNull(), F.expr("cast(X'e2' as string)")).otherwise(F.col("w6"))})
        if kind in ("parquet", "csv"):
            datagen.write(df, str(tmp_path / s), kind)
        sides.append(str(tmp_path / s) if kind in ("parquet", "csv") else df)
    opt = Options(key=("k",), order_by=tuple(reversed(names)) if kind == "order_by" else (), **flags)

    def found():
        r = compare(spark, *sides, opt)
        cells = [f"hex({s}v.c{i})" for s in "ab" for i in range(8)]
        return sorted(map(str, r.joined.selectExpr("hex(k0)", "an", "bn", *cells).collect())), r.counts, r.column_stats

    plain = found()
    monkeypatch.setattr("reckon.operators.diff.WIDE", 2)
    assert plain == found() and plain[1]["a_dup_keys"] > 1


def test_generator_shape(spark):
    a, b = datagen.pair(spark, 10_000)
    r = compare(spark, a, b, Options(key=("depot", "parcel")))
    c = r.counts
    assert (c["a_rows"], c["b_rows"], c["added"], c["removed"], c["a_dup_keys"], c["b_dup_keys"]) == (10_001, 10_001, 10, 10, 1, 1)
    assert c["changed"] == c["matched"] == 9_990
    s = {x["column"]: x for x in r.column_stats}
    assert 200 < s["state"]["changed"] < 400 and s["due_on"]["changed"] == s["due_on"]["blanked"] > 5


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    a, b = put(tmp_path, "a.csv", SIMPLE[0]), put(tmp_path, "b.csv", SIMPLE[1])
    run = lambda *x: cli.main([str(y) for y in x], spark)
    assert run("compare", a, b, "-k", "tree", "--json", "s.json") == 1
    assert (tmp_path / "a__vs__b.html").exists() and json.load(open("s.json"))["counts"]["changed"] == 1
    assert run("compare", a, a, "-k", "tree", "--summary") == 0
    assert run("compare", a, b, "-k", "tree", "--summary", "--json", "t.json") == 2 and not (tmp_path / "t.json").exists()
    assert run("compare", a, b, "-k", "zz") == 2 and "zz" in capsys.readouterr().err
    assert run("compare", a, b) == 2 and run("compare", a, b, "-k", "tree", "--engine", "no") == 2 and run("compare", a, b, "-k", "tree", "--bogus") == 2
    dup = put(tmp_path, "d.csv", "tree,leaf,rings\nyew,a,1\nyew,b,2\n")
    assert run("compare", dup, dup, "-k", "tree", "--summary", "--fail-on-dups") == 3
    capsys.readouterr()
    assert run("columns", a) == 0 and capsys.readouterr().out == "tree\nleaf\nrings\n"
    assert run("head", a, "-n", 2, "--csv") == 0 and capsys.readouterr().out == "tree,leaf,rings\noak,lobed,120\nfir,needle,44\n"
    assert run("head", a) == 0 and capsys.readouterr().out.splitlines()[1].split() == ["oak", "lobed", "120"]
    assert run("gen-data", tmp_path / "g", "--rows", "1k", "--format", "ndjson") == 0
    assert run("compare", tmp_path / "g/a.ndjson", tmp_path / "g/b.ndjson", "-k", "depot,parcel", "-i", "touched_at", "--summary") == 1


def test_every_error_ends_with_two(spark, tmp_path, capsys):
    a = put(tmp_path, "a.csv", SIMPLE[0])
    bad = put(tmp_path, "bad.parquet", "PAR1" + "x" * 60 + "PAR1")
    put(tmp_path, "broken.toml", "[profiles.x\nkey=1")
    put(tmp_path, "odd.toml", "[profiles]\nx = 3\n")
    run = lambda *x: cli.main([str(y) for y in x], spark)
    assert run("compare", bad, a, "-k", "tree", "--summary") == 2
    for name in ("broken", "odd"):
        assert run("compare", a, a, "-k", "tree", "--summary", "--config", tmp_path / f"{name}.toml", "--profile", "x") == 2
    assert run("compare", a, a, "-k", "tree", "--summary", "--threads", "-1") == 2
    assert run("compare", a, a, "-k", "tree", "--summary", "--memory", "0") == 2
    assert "threads" in capsys.readouterr().err
    assert run("compare", a, a, "-k", "tree", "--summary", "--timings") == 0 and "scan, join, count" in capsys.readouterr().err


def test_part_files_are_written_by_executors(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    a, b = put(tmp_path, "a.csv", SIMPLE[0]), put(tmp_path, "b.csv", SIMPLE[1])
    assert cli.main(["compare", a, b, "-k", "tree", "--export-dir", str(tmp_path / "out"), "--part-files"], spark) == 1
    assert spark.read.csv(str(tmp_path / "out" / "changed.csv"), header=True).collect()[0]["rings (B)"] == "45"


def test_profile_engine_is_the_strategy():
    assert with_profile(Options(), {"engine": "sortmerge", "key": "a, b"}) == Options(key=("a", "b"), strategy="sortmerge")


def test_odd_column_names(spark):
    df = spark.createDataFrame([("1", "x", "p", "q"), ("2", "y", "p", "q")], ["a.b", "_ord", "c`d", "f0"])
    other = df.withColumn("_ord", F.lit("x"))
    r = compare(spark, df, other, Options(key=("a.b",), order_by=("_ord", "c`d")))
    assert r.column_stats == [{"column": c, "changed": n, "blanked": 0, "filled": 0} for c, n in (("_ord", 1), ("c`d", 0), ("f0", 0))]
    assert [x["a.b"] for x in r.changed().collect()] == ["2"]


def test_ndjson_lone_surrogates_and_deep_nesting(spark, tmp_path):
    deep = '{"k":"2","v":' + "[" * 100_000 + "]" * 100_000 + "}"
    a = put(tmp_path, "a", '{"k":"1","v":"\\ud800x"}\n' + deep + "\n")
    r = compare(spark, a, put(tmp_path, "b", '{"k":"1","v":"y"}\n{"k":"2","v":null}\n'), Options(key=("k",)))
    assert r.counts["a_rows"] == 2 and r.counts["changed"] >= 1


def test_encoding_reaches_the_header(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_bytes("schlüssel,größe\nä,1\n".encode("latin-1"))
    r = compare(spark, str(p), str(p), Options(key=("schlüssel",), encoding="ISO-8859-1"))
    assert r.identical and r.resolved.compared == ("größe",) and r.counts["matched"] == 1
    with pytest.raises(DiffError, match="no-such"):
        open_table(spark, str(p), Options(encoding="no-such"))


def test_a_newline_in_a_name(spark, tmp_path):
    r = both(spark, tmp_path, '\n"key\nname",v\n1,x\n', 'v,"key\nname"\ny,1\n', key=("key\nname",))
    assert (r.counts["matched"], r.counts["changed"]) == (1, 1)
