import datetime
import math
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest

import sparkframe as sf
from sparkframe import DataFrame, concat


@pytest.fixture
def make(spark):
    sf.set_session(spark)
    return lambda rows, schema: DataFrame(spark.createDataFrame(rows, schema))


@pytest.fixture
def sides(make):
    left = make([(1, 10, 1), (2, 20, 2), (None, 30, 3), (3, 40, 4)], "k int, a long, v long")
    right = make([(1, 5, 0), (1, 6, 0), (None, 7, 0), (9, 8, 0)], "k int, b long, v long")
    return left, right


@pytest.mark.parametrize(("how", "n"), [("inner", 2), ("left_outer", 5), ("right_outer", 4), ("full_outer", 7), ("left_semi", 1), ("right_semi", 2), ("left_anti", 3), ("right_anti", 2), ("left", 5), ("outer", 7)])
def test_join_kinds_with_null_keys(sides, how, n):
    left, right = sides
    out = left.merge(right, on="k", how=how)
    assert out.size() == n
    side = {"l": ["k", "a", "v"], "r": ["k", "b", "v"]}.get(how[0] if "_semi" in how or "_anti" in how else "")
    assert out.columns == (side or ["k_l", "a", "v_l", "k_r", "b", "v_r"])


def test_join_arguments(sides):
    left, right = sides
    for bad in ({}, {"left_on": ["k"]}, {"on": ["k"], "how": "sideways"}, {"left_on": ["k", "a"], "right_on": ["k"]}):
        with pytest.raises(ValueError):
            left.merge(right, **bad)
    with pytest.raises(KeyError):
        left.merge(right, on="nope")
    chained = left.merge(left, on="k")
    with pytest.raises(ValueError):
        chained.merge(DataFrame(chained.sdf.withColumnRenamed("k_r", "k_l_l").withColumnRenamed("k_l", "k_l")), on="k_l")


def test_self_join(sides):
    assert sides[1].merge(sides[1], on="k").size() == 5


def test_groups_with_nulls(make):
    g = make([("a", 1, True), ("a", None, None), (None, 3, False), ("b", None, True)], "g string, x int, b boolean")
    rows = {r["g"]: r for r in g.groupby("g").aggregate({"x": ["sum", "count"], "b": ["all", "any"]}).sdf.collect()}
    assert {k: (r["sum(x)"], r["count(x)"]) for k, r in rows.items()} == {"a": (1, 1), None: (3, 1), "b": (None, 0)}
    assert rows["a"]["all(b)"] is True and rows[None]["any(b)"] is False
    nulls = make([("a", None)], "g string, b boolean").groupby("g").aggregate({"b": ["all", "any"]}).sdf.first()
    assert nulls["all(b)"] is None and nulls["any(b)"] is None
    for op in (g.groupby("g").sum, g.groupby("g").count):
        with pytest.raises(NotImplementedError):
            op()
    with pytest.raises(ValueError):
        g.groupby("g")["x"].aggregate("variance")
    with pytest.raises(ValueError):
        g.groupby("g")["x"].aggregate(3)


def test_first_last_by_an_order(make):
    f = make([("a", 3, 1), ("a", 4, 2), ("a", None, 3)], "g string, x int, t int")
    out = f.groupby("g").aggregate({"x": ["first", "last", "first_last"]}, order_by="t").sdf.first()
    assert (out["first(x)"], out["last(x)"], tuple(out["first_last(x)"])) == (3, 4, (3, 4))
    plain = f[f["x"] == 3].groupby("g").aggregate({"x": ["first", "last", "distinct", "count_distinct"]}).sdf.first()
    assert list(plain)[1:] == [3, 3, [3], 1]


@pytest.mark.parametrize(("ascending", "want"), [(True, [-2.0, 0.0, 1.0, 3.0]), (False, [3.0, 1.0, 0.0, -2.0])])
def test_sort_puts_nan_and_null_last(make, ascending, want):
    out = [r[0] for r in make([(3.0,), (None,), (float("nan"),), (1.0,), (0.0,), (-2.0,)], "x double").sort_values("x", ascending).sdf.collect()]
    assert out[:4] == want and math.isnan(out[4]) and out[5] is None


def test_division(make):
    f = make([(1.0, 0.0), (0.0, 0.0), (-2.0, 0.0), (-2.0, -0.0), (float("nan"), 3.0), (None, 2.0), (6.0, 3.0)], "x double, y double")
    f["q"] = f["x"] / f["y"]
    out = [r["q"] for r in f.sdf.collect()]
    assert out[0] == math.inf and math.isnan(out[1]) and out[2] == -math.inf and out[3] == math.inf and math.isnan(out[4]) and out[5] is None and out[6] == 2
    i = make([(-7,)], "x int")
    i["h"] = i["x"] / 2
    assert i.sdf.first()["h"] == -3
    i["z"] = i["x"] / 0
    with pytest.raises(Exception, match="ZERO|zero"):
        i.sdf.collect()


def test_nan_compares_false(make):
    f = make([(float("nan"),), (1.0,), (None,)], "x double")
    assert [f[f["x"] > 0].size(), f[f["x"] == float("nan")].size(), f[f["x"] != 1].size(), f[f["x"] <= 5].size()] == [1, 0, 1, 1]


def test_literal_widths_and_types(make):
    f = make([(1, 2.0)], "i int, f float")
    f["a"], f["b"], f["c"] = f["i"] + 2, f["f"] + 2, f["f"] * 2.0
    assert [t for _, t in f.sdf.dtypes] == ["int", "float", "bigint", "float", "double"]
    for bad in (None, datetime.date(2024, 1, 1), object()):
        with pytest.raises(ValueError):
            f["i"] == bad  # noqa: B015
    f["n"] = f["i"] + np.int64(3)
    f["k"] = 7
    assert f.sdf.first()["n"] == 4 and f.sdf.first()["k"] == 7
    with pytest.raises(TypeError):
        f[f["i"] + 1]


def test_overflow_raises(make):
    f = make([(2**63 - 1,)], "x long")
    f["y"] = f["x"] + 1
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        f.sdf.collect()


def test_timestamp_literal_ignores_the_session_zone(make, spark):
    f = DataFrame(spark.sql("select timestamp_ntz'2024-01-15 00:00:01' t union all select timestamp_ntz'2024-01-14 23:59:59'"))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert f[f["t"] > datetime.datetime(2024, 1, 15)].size() == 1
        assert f[f["t"] > np.datetime64("2024-01-15")].size() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_expressions_bind_late_and_frames_keep_snapshots(make):
    f = make([(1,), (2,)], "a long")
    later, kept = f["a"] + 1 > 10, f[f["a"] > 0]
    f["a"] = f["a"] * 10
    assert f[later].size() == 2
    assert sorted(kept.get()["a"]) == [1, 2]


def test_positions(make):
    a, b = make([(i,) for i in range(10)], "x long").sort_values("x"), make([(i * 10,) for i in range(10)], "y long").sort_values("y", False)
    a["z"] = a["x"] + b["y"]
    assert [r["z"] for r in a.sdf.collect()] == [i + (9 - i) * 10 for i in range(10)]
    assert [r["x"] for r in a[b["y"] > 60].sdf.collect()] == [0, 1, 2]
    with pytest.raises(ValueError, match="position"):
        a["w"] = a["x"] + make([(1,), (2,), (3,)], "y long")["y"]


def test_concat_rules(make):
    a, b = make([(1, "x")], "i int, s string"), make([("x", 1)], "s string, i int")
    assert concat(None) is None and concat([a, a]).size() == 2
    for bad in ([], [a, b], [a, make([(1, "x")], "i long, s string")]):
        with pytest.raises(ValueError):
            concat(bad)


def test_empty_and_tiny_tables(make):
    e = make([], "k int, x double, s string")
    assert e.size() == 0 and e.get().columns.tolist() == ["k", "x", "s"]
    assert e.merge(e, on="k").size() == 0 and e.groupby("k")["x"].sum().size() == 0 and e.sort_values("x").size() == 0
    assert e["x"].sum() is None and e["x"].count() == 0 and concat([e, e]).size() == 0
    one = make([(1, 2.5, "é")], "k int, x double, `名前` string").sort_values("k")
    assert one.get()["名前"].tolist() == ["é"] and one["名前"].count() == 1


def test_scalars(make):
    f = make([(1, 0.5), (None, 1.5)], "i int, d double")
    assert (f["i"].sum(), f["d"].sum(), f["i"].count(), (f["i"] * 3).sum()) == (1, 2.0, 1, 3)


def test_regex_paths(make, spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for n, v in (("part_0", [1]), ("part_1", [2, 3]), ("other", [9])):
        pq.write_table(pa.table({"x": v}), tmp_path / f"{n}.parquet")
    assert sorted(sf.read_parquet(f"{tmp_path}/part_[01]\\.parquet").get()["x"]) == [1, 2, 3]
    with pytest.raises(FileNotFoundError):
        sf.read_parquet(f"{tmp_path}/none_.*")
    pq.write_table(pa.table({"x": ["a"]}), tmp_path / "part_2.parquet")
    with pytest.raises(ValueError):
        sf.read_parquet(f"{tmp_path}/part_[0-9].parquet")
    nanos = np.array(["2024-01-01T00:00:00.123456789"], dtype="datetime64[ns]")
    pq.write_table(pa.table({"t": nanos, "v": [1]}), tmp_path / "nanos.parquet")
    assert sf.read_parquet(f"{tmp_path}/nanos.parquet").sdf.first()["t"] == datetime.datetime(2024, 1, 1, 0, 0, 0, 123456)


def test_print_and_session(make, capsys, spark):
    f = make([(1,)], "x int")
    f.print()
    assert "|1" in capsys.readouterr().out
    assert sf.get_interface() is spark
    sf.set_interface(sf.Session(spark))
    sf.Session(spark).barrier(f)
    assert sf.Session(spark).rescale(2) is False
    with pytest.raises(NotImplementedError):
        DataFrame(3)


def test_pushdown_reaches_the_scan(spark):
    f = sf.read_parquet("/root/testdata/sf0.01/lineitem.parquet", spark)
    plan = f[f["l_quantity"] > 40.0][["l_orderkey", "l_quantity"]].sdf._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,40.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_positional_columns_that_clash(make):
    """Names that the alignment could use itself are the user's."""
    names = ["__id", "__part", "__start", "__position", "__other0_0", "x"]
    left = make([(*range(k, k + 5), k) for k in range(20)], ", ".join(f"{n} long" for n in names)).sort_values("x", ascending=False)
    right = make([(k, 100 + k) for k in range(20)], "__other0_0 long, __position long").sort_values("__position", ascending=False)
    left["t"] = left["__id"] + right["__position"] + right["__other0_0"]
    out = left.get()
    assert out.columns.tolist() == [*names, "t"]
    assert out["t"].tolist() == [k + 100 + k + k for k in range(19, -1, -1)] and out["x"].tolist() == list(range(19, -1, -1))


def test_groups_of_a_join_by_its_keys(make):
    """Sums and counts of either side equal those over the pairs, and no pairs are made."""
    left = make([(1, "a", 2, None), (1, "a", 3, 1.5), (2, "b", 5, 2.0), (None, "a", 7, 1.0), (1, None, 1, 1.0), (3, "c", 1, 1.0)], "k int, s string, v int, w double")
    right = make([(1, "a", 10), (1, "a", None), (2, "b", 4), (2, "b", 6), (None, "a", 1), (9, "z", 1)], "k int, s string, u int")
    both = left.merge(right, on=["k", "s"])
    spec = {"v": ["sum", "count"], "w": ["sum", "count"], "u": ["sum", "count"], "k_r": "count"}
    early = both.groupby(["s_l", "k_r"]).aggregate(spec)
    both["again"] = both["v"]  # not a plain join any more
    plain = both.groupby(["s_l", "k_r"]).aggregate(spec)
    assert early.columns == plain.columns
    assert sorted(early.sdf.collect()) == sorted(plain.sdf.collect()) and early.size() == 2
    plan = early.sdf._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")
    assert both.merge(right, left_on=["k_l"], right_on=["k"]).groupby("s_l")["again"].sum().size() == 2


def test_groups_of_a_join_with_itself_by_its_keys(make):
    """One aggregate and no join, and the same sums and counts as over the pairs."""
    one = make([(1, "a", 2, None), (1, "a", 3, 1.5), (1, "a", None, 2.5), (2, "b", 5, 2.0), (None, "a", 7, 1.0), (None, "a", 7, 1.0), (1, None, 1, 1.0), (3, "c", None, None), (3, "c", None, None)], "k int, s string, v int, w double")
    spec = {"v_l": ["sum", "count"], "v_r": "sum", "w_r": ["sum", "count"], "k_r": "count"}
    for keys, others, group, n, joins in ((["k", "s"], ["k", "s"], ["s_r", "k_l"], 3, 0), (["k"], ["k"], ["k_r"], 3, 0), (["k", "v"], ["v", "k"], ["k_l", "v_l"], 1, 1)):
        both = one.merge(one, left_on=keys, right_on=others)
        early = both.groupby(group).aggregate(spec)
        both["again"] = both["v_l"]  # not a plain join any more
        plain = both.groupby(group).aggregate(spec)
        assert early.columns == plain.columns and early.sdf.schema.simpleString() == plain.sdf.schema.simpleString()
        assert sorted(map(str, early.sdf.collect())) == sorted(map(str, plain.sdf.collect())) and early.size() == n
        plan = early.sdf._jdf.queryExecution().optimizedPlan().toString()
        assert (plan.count("Join"), plan.count("Aggregate")) == (joins, 1 + joins)


def test_memory_size_and_dry_runs(spark, make, capsys):
    f = make([(k,) for k in range(100)], "x long")
    assert f.memory_size() >= 800
    try:
        s = sf.DebugSession(spark)
        assert f[f["x"] > 3].size() == 0 and f.get().empty and f.get().columns.tolist() == ["x"]
        f.print()
        s.barrier(f)
        assert capsys.readouterr().out.count("Physical Plan") == 5
    finally:
        sf.set_session(spark)
    assert f.size() == 100


def test_regex_paths_with_a_scheme(spark, tmp_path):
    for k in range(3):
        spark.range(k + 1).coalesce(1).write.parquet(str(tmp_path / f"t{k}"))
        part = next((tmp_path / f"t{k}").glob("part-*.parquet"))
        part.rename(tmp_path / f"part_{k}.parquet")
    assert sf.read_parquet(f"file://{tmp_path}/part_[01]\\.parquet", spark).size() == 3
    assert sf.read_parquet(f"file://{tmp_path}/part_2.parquet", spark).size() == 3
    with pytest.raises(FileNotFoundError):
        sf.read_parquet(f"file://{tmp_path}/none_[0-9]+\\.parquet", spark)


def test_sessions(spark):
    with pytest.raises(RuntimeError):
        sf.LocalCluster(1, 97)
    here = sf.LocalCluster(1, 4)
    assert here.spark is spark and here.rescale(3) is False and sf.get_session() is spark
    with pytest.raises(ValueError):
        here.rescale(0)
    with pytest.raises(ValueError):
        sf.LocalCluster(3, 2)


def test_a_session_ends(tmp_path):
    """In a process of its own: connect by master, over-decompose, disconnect."""
    code = "import sparkframe as sf\nfrom sparkframe.session import Session\ns = Session(master='local[2]', odf=3)\nassert s.spark.conf.get('spark.sql.shuffle.partitions') == '6'\nassert sf.DataFrame(s.spark.range(5)).persist().unpersist().size() == 5\ns.disconnect()\nassert s.spark.sparkContext._jsc is None\nc = sf.LocalCluster(1, 2, activity_timeout=7)\nassert c.spark.conf.get('spark.dynamicAllocation.executorIdleTimeout') == '7s' and c.spark.sparkContext.master == 'local[2]'\nprint('ended well')"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, timeout=120)
    assert "ended well" in done.stdout, done.stderr[-2000:]


def test_frames_of_pandas_come_back(spark):
    sf.set_session(spark)
    given = pd.DataFrame({"i": [3, 1, 2], "s": ["x", None, "z"], "t": pd.to_datetime(["2024-01-01", "2024-02-03 04:05:06.789", "1999-12-31"], format="ISO8601"), "b": [True, False, True]})
    f = DataFrame(given)
    got = f.sort_values("i").get()
    assert got["i"].tolist() == [1, 2, 3] and got["s"].isna().tolist() == [True, False, False]
    assert (got["t"].to_numpy() == given.sort_values("i")["t"].to_numpy()).all() and got["b"].tolist() == [False, True, True]
    assert len(f) == 3 and f[f["i"] > 5].get().empty
