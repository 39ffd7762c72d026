"""Queries over the test tables, one or more for each operator, with the SQL that must agree."""

from __future__ import annotations

import datetime
import functools

import numpy as np
from pyspark.sql import functions as F

from sparkframe.operators.align import numbered
from sparkframe.operators.frame import DataFrame
from sparkframe.operators.setops import concat
from sparkframe.sources.parquet import read_parquet

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None, *tables: str):
    """Register the function under its name; it gets a frame for each table."""

    def register(f):
        @functools.wraps(f)
        def run(spark, sf_dir):
            out = f(*[read_parquet(f"{sf_dir}/{t}.parquet", spark) for t in tables])
            return out.sdf if isinstance(out, DataFrame) else out

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query('SELECT c_mktsegment, count(o_orderkey) AS "count(o_orderkey)" FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment', "orders", "customer")
def flagship_join_group_count(orders, customer):
    return orders.merge(customer, left_on=["o_custkey"], right_on=["c_custkey"]).groupby(["c_mktsegment"])["o_orderkey"].count()


@query("SELECT n_nationkey, n_name FROM nation", "nation")
def scan_project(nation):
    return nation[["n_nationkey", "n_name"]]


@query("SELECT * FROM lineitem WHERE l_quantity > 40.0", "lineitem")
def filter_gt(lineitem):
    return lineitem[lineitem["l_quantity"] > 40.0]


@query("SELECT * FROM part WHERE p_size <= 10", "part")
def filter_le(part):
    return part[part["p_size"] <= 10]


@query("SELECT * FROM part WHERE p_size >= 10 AND p_size < 20", "part")
def filter_chain(part):
    part = part[part["p_size"] >= 10]
    return part[part["p_size"] < 20]


@query("SELECT * FROM lineitem WHERE l_linenumber = 3", "lineitem")
def filter_eq(lineitem):
    return lineitem[lineitem["l_linenumber"] == 3]


@query("SELECT * FROM nation WHERE n_nationkey = n_regionkey", "nation")
def filter_eq_cols(nation):
    return nation[nation["n_nationkey"] == nation["n_regionkey"]]


@query("SELECT * FROM customer WHERE c_nationkey <> 3", "customer")
def filter_ne(customer):
    return customer[customer["c_nationkey"] != 3]


@query("SELECT * FROM nation WHERE n_nationkey <> n_regionkey", "nation")
def filter_ne_cols(nation):
    return nation[nation["n_nationkey"] != nation["n_regionkey"]]


@query("SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-15'", "events")
def filter_timestamp(events):
    return events[events["ts"] > datetime.datetime(2024, 1, 15)]


@query("SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-15'", "events")
def filter_timestamp_numpy(events):
    return events[events["ts"] > np.datetime64("2024-01-15")]


@query("SELECT *, p_size + CAST(2 AS BIGINT) AS bigger FROM part", "part")
def setcol_add_int(part):
    part["bigger"] = part["p_size"] + 2
    return part


@query("SELECT *, p_retailprice - p_size AS less FROM part", "part")
def setcol_sub(part):
    part["less"] = part["p_retailprice"] - part["p_size"]
    return part


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount AS off, l_extendedprice * l_discount - 2 * l_tax AS net FROM lineitem", "lineitem")
def setcol_mul_expr(lineitem):
    lineitem["off"] = lineitem["l_extendedprice"] * lineitem["l_discount"]
    lineitem["net"] = lineitem["l_extendedprice"] * lineitem["l_discount"] - 2 * lineitem["l_tax"]
    return lineitem[["l_orderkey", "l_linenumber", "off", "net"]]


@query("SELECT p_partkey, CAST(p_size // 2 AS BIGINT) AS half FROM part", "part")
def setcol_div_int(part):
    part["half"] = part["p_size"] / 2
    return part[["p_partkey", "half"]]


@query("SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS each FROM lineitem", "lineitem")
def setcol_div_float(lineitem):
    lineitem["each"] = lineitem["l_extendedprice"] / lineitem["l_quantity"]
    return lineitem[["l_orderkey", "l_linenumber", "each"]]


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size * CAST(2 AS BIGINT) AS p_size, p_retailprice FROM part", "part")
def setcol_replace(part):
    part["p_size"] = part["p_size"] * 2
    return part


@query("SELECT o_orderkey, l_linenumber, epoch_us(l_shipdate) - epoch_us(o_orderdate) AS us FROM lineitem JOIN orders ON l_orderkey = o_orderkey", "lineitem", "orders")
def ts_difference(lineitem, orders):
    joined = lineitem.merge(orders, left_on="l_orderkey", right_on="o_orderkey")
    joined["gap"] = joined["l_shipdate"] - joined["o_orderdate"]
    micros = F.expr("cast(extract(day from gap) as bigint) * 86400000000 + extract(hour from gap) * 3600000000 + extract(minute from gap) * 60000000 + cast(extract(second from gap) * 1000000 as bigint)")
    return joined.sdf.select("o_orderkey", "l_linenumber", micros.cast("bigint").alias("us"))


@query(
    "WITH a AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS i FROM part), b AS (SELECT p_size, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey DESC) AS i FROM part) SELECT a.p_partkey, a.p_size + 2 * CAST(b.p_size AS BIGINT) AS total FROM a JOIN b USING (i)",
    "part",
    "part",
)
def setcol_positional(part, again):
    part, other = part.sort_values("p_partkey"), again.sort_values(["p_retailprice", "p_partkey"], ascending=False)
    part["total"] = part["p_size"] + 2 * other["p_size"]
    return part[["p_partkey", "total"]]


@query("SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey", "supplier", "nation")
def join_inner(supplier, nation):
    return supplier.merge(nation, left_on=["s_nationkey"], right_on=["n_nationkey"])


def _keyed(frame, name):
    """The frame with the column ``k``, a copy of a key."""
    frame["k"] = frame[name]
    return frame


_SIDES = "WITH l AS (SELECT *, s_nationkey AS k FROM supplier{}), r AS (SELECT *, n_nationkey AS k FROM nation{}) SELECT l.* EXCLUDE (k), l.k AS k_l, r.* EXCLUDE (k), r.k AS k_r FROM l {} JOIN r ON l.k = r.k"


@query(_SIDES.format("", " WHERE n_regionkey < 2", "LEFT"), "supplier", "nation")
def join_left(supplier, nation):
    return _keyed(supplier, "s_nationkey").merge(_keyed(nation[nation["n_regionkey"] < 2], "n_nationkey"), on=["k"], how="left_outer")


@query(_SIDES.format(" WHERE s_suppkey <= 10", "", "RIGHT"), "supplier", "nation")
def join_right(supplier, nation):
    return _keyed(supplier[supplier["s_suppkey"] <= 10], "s_nationkey").merge(_keyed(nation, "n_nationkey"), on="k", how="right_outer")


@query(_SIDES.format(" WHERE s_suppkey <= 10", " WHERE n_regionkey < 2", "FULL"), "supplier", "nation")
def join_full(supplier, nation):
    return _keyed(supplier[supplier["s_suppkey"] <= 10], "s_nationkey").merge(_keyed(nation[nation["n_regionkey"] < 2], "n_nationkey"), on=["k"], how="full_outer")


@query("SELECT * FROM customer SEMI JOIN orders ON c_custkey = o_custkey", "customer", "orders")
def join_left_semi(customer, orders):
    return customer.merge(orders, left_on=["c_custkey"], right_on=["o_custkey"], how="left_semi")


@query("SELECT * FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey <= 10)", "supplier", "nation")
def join_right_semi(supplier, nation):
    return supplier[supplier["s_suppkey"] <= 10].merge(nation, left_on=["s_nationkey"], right_on=["n_nationkey"], how="right_semi")


@query("SELECT * FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey", "customer", "orders")
def join_left_anti(customer, orders):
    return customer.merge(orders[orders["o_totalprice"] > 300000], left_on=["c_custkey"], right_on=["o_custkey"], how="left_anti")


@query("SELECT * FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey <= 10)", "supplier", "nation")
def join_right_anti(supplier, nation):
    return supplier[supplier["s_suppkey"] <= 10].merge(nation, left_on=["s_nationkey"], right_on=["n_nationkey"], how="right_anti")


@query(
    "WITH k AS (SELECT l_orderkey, l_suppkey, count(l_linenumber) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY ALL) SELECT l.l_orderkey, l.l_suppkey, l.l_linenumber, l.l_partkey, k.n FROM lineitem l JOIN k ON l.l_orderkey = k.l_orderkey AND l.l_suppkey = k.l_suppkey",
    "lineitem",
)
def join_composite(lineitem):
    keys = lineitem[lineitem["l_quantity"] > 45].groupby(["l_orderkey", "l_suppkey"])["l_linenumber"].count()
    keys["n"] = keys["count(l_linenumber)"]
    out = lineitem.merge(keys, on=["l_orderkey", "l_suppkey"])
    out["l_orderkey"], out["l_suppkey"] = out["l_orderkey_l"], out["l_suppkey_l"]
    return out[["l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "n"]]


@query('SELECT o_orderdate, count(l_orderkey) AS "count(l_orderkey)" FROM orders JOIN lineitem ON o_orderdate = l_shipdate GROUP BY o_orderdate', "orders", "lineitem")
def join_timestamp(orders, lineitem):
    return orders.merge(lineitem, left_on=["o_orderdate"], right_on=["l_shipdate"]).groupby("o_orderdate")["l_orderkey"].count()


@query('SELECT l_orderkey AS l_orderkey_l, sum(l.l_quantity) AS "sum(l_quantity_l)", count(r.l_tax) AS "count(l_tax_r)" FROM lineitem l JOIN lineitem r USING (l_orderkey, l_suppkey) GROUP BY l_orderkey, l_suppkey', "lineitem")
def join_many_to_many_sums(lineitem):
    both = lineitem.merge(lineitem, on=["l_orderkey", "l_suppkey"])
    return both.groupby(["l_orderkey_l", "l_suppkey_r"]).aggregate({"l_quantity_l": "sum", "l_tax_r": "count"})[["l_orderkey_l", "sum(l_quantity_l)", "count(l_tax_r)"]]


@query("SELECT a.n_nationkey AS n_nationkey_l, a.n_name AS n_name_l, a.n_regionkey AS n_regionkey_l, b.n_nationkey AS n_nationkey_r, b.n_name AS n_name_r, b.n_regionkey AS n_regionkey_r FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey", "nation")
def join_self(nation):
    return nation.merge(nation, on=["n_regionkey"])


@query("SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey", "supplier", "nation")
def join_method(supplier, nation):
    nation["s_nationkey"] = nation["n_nationkey"]
    out = supplier.join(nation, ["s_nationkey"])
    out["s_nationkey"] = out["s_nationkey_l"]
    return out[["s_suppkey", "s_name", "s_nationkey", "s_acctbal", "n_nationkey", "n_name", "n_regionkey"]]


@query('SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS "sum(p_size)" FROM part GROUP BY p_brand', "part")
def group_sum_int(part):
    return part.groupby(["p_brand"])["p_size"].sum()


@query('SELECT l_returnflag, sum(l_quantity) AS "sum(l_quantity)" FROM lineitem GROUP BY l_returnflag', "lineitem")
def group_sum_double(lineitem):
    return lineitem.groupby(["l_returnflag"])["l_quantity"].sum()


@query('SELECT l_returnflag, l_linestatus, sum(l_quantity) AS "sum(l_quantity)", count(l_quantity) AS "count(l_quantity)", count(l_orderkey) AS "count(l_orderkey)" FROM lineitem GROUP BY ALL', "lineitem")
def group_agg_dict(lineitem):
    return lineitem.groupby(["l_returnflag", "l_linestatus"]).aggregate({"l_quantity": ["sum", "count"], "l_orderkey": "count"})


@query('SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS "sum(p_size)" FROM part GROUP BY p_brand', "part")
def group_agg_by_name(part):
    return part.groupby("p_brand")["p_size"].aggregate("sum")


@query('SELECT o_orderdate, count(o_orderkey) AS "count(o_orderkey)" FROM orders GROUP BY o_orderdate', "orders")
def group_timestamp_key(orders):
    return orders.groupby(["o_orderdate"])["o_orderkey"].count()


@query('SELECT p_brand, bool_and(p_size > 1) AS "all(big)", bool_or(p_size > 49) AS "any(huge)" FROM part GROUP BY p_brand', "part")
def group_all_any(part):
    part["big"], part["huge"] = part["p_size"] > 1, part["p_size"] > 49
    return part.groupby(["p_brand"]).aggregate({"big": "all", "huge": "any"})


@query('SELECT l_returnflag, count(DISTINCT l_suppkey) AS "count_distinct(l_suppkey)" FROM lineitem GROUP BY l_returnflag', "lineitem")
def group_count_distinct(lineitem):
    return lineitem.groupby(["l_returnflag"])["l_suppkey"].aggregate("count_distinct")


@query('SELECT c_mktsegment, list_sort(list_distinct(list(c_nationkey))) AS "distinct(c_nationkey)" FROM customer GROUP BY c_mktsegment', "customer")
def group_distinct(customer):
    return customer.groupby(["c_mktsegment"])["c_nationkey"].aggregate("distinct")


@query('SELECT l_returnflag, median(l_quantity) AS "median(l_quantity)" FROM lineitem GROUP BY l_returnflag', "lineitem")
def group_median_exact(lineitem):
    return lineitem.groupby(["l_returnflag"])["l_quantity"].aggregate("median")


@query('SELECT p_brand, CAST(quantile_disc(p_size, 0.5) AS DOUBLE) AS "approximate_median(p_size)" FROM part GROUP BY p_brand', "part")
def group_median_approx(part):
    return part.groupby(["p_brand"])["p_size"].aggregate("approximate_median")


@query("SELECT o_custkey, min_by(o_totalprice, o_orderkey) AS first_price, max_by(o_totalprice, o_orderkey) AS last_price, min_by(o_orderstatus, o_orderkey) AS first_status, max_by(o_orderstatus, o_orderkey) AS last_status FROM orders GROUP BY o_custkey", "orders")
def group_first_last(orders):
    out = orders.groupby(["o_custkey"]).aggregate({"o_totalprice": ["first", "last"], "o_orderstatus": "first_last"}, order_by="o_orderkey")
    return out.sdf.select("o_custkey", F.col("`first(o_totalprice)`").alias("first_price"), F.col("`last(o_totalprice)`").alias("last_price"), F.col("`first_last(o_orderstatus)`.first").alias("first_status"), F.col("`first_last(o_orderstatus)`.last").alias("last_status"))


@query("SELECT CAST(sum(p_size) AS BIGINT) AS total, count(p_size) AS n, CAST(sum(p_size * 2 + 1) AS BIGINT) AS derived FROM part", "part")
def scalar_sum_count(part):
    row = (part["p_size"].sum(), part["p_size"].count(), (part["p_size"] * 2 + 1).sum())
    return part.sdf.sparkSession.createDataFrame([row], "total long, n long, derived long")


def _ranked(frame, *keys):
    """The rank in key order, so that an order shows in a comparison that ignores rows' order."""
    ranked, _ = numbered(frame.sdf.select(*keys), "rn")
    return ranked.withColumn("rn", F.col("rn") + 1)


@query("SELECT p_retailprice, p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS rn FROM part", "part")
def sort_asc(part):
    return _ranked(part.sort_values(["p_retailprice", "p_partkey"]), "p_retailprice", "p_partkey")


@query("SELECT p_retailprice, p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey DESC) AS rn FROM part", "part")
def sort_desc(part):
    return _ranked(part.sort_values(["p_retailprice", "p_partkey"], ascending=False), "p_retailprice", "p_partkey")


@query("SELECT p_brand, p_size, p_partkey, row_number() OVER (ORDER BY p_brand, p_size, p_partkey) AS rn FROM part", "part")
def sort_multi(part):
    return _ranked(part.sort_values(["p_brand", "p_size", "p_partkey"]), "p_brand", "p_size", "p_partkey")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS rn FROM part", "part")
def sort_one_name(part):
    return _ranked(part.sort_values("p_partkey"), "p_partkey")


@query(
    "WITH t AS (SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN NULL WHEN c_acctbal < 0 THEN 'NaN'::DOUBLE ELSE c_acctbal END AS v FROM customer) SELECT c_custkey, v, row_number() OVER (ORDER BY v IS NULL, isnan(v), v DESC, c_custkey DESC) AS rn FROM t",
    "customer",
)
def sort_nan_null(customer):
    c = F.col("c_acctbal")
    derived = DataFrame(customer.sdf.select("c_custkey", F.when(c <= 9000, F.when(c < 0, float("nan")).otherwise(c)).alias("v")))
    return _ranked(derived.sort_values(["v", "c_custkey"], ascending=False), "c_custkey", "v")


@query("SELECT * FROM customer UNION ALL SELECT * FROM customer", "customer")
def concat_dups(customer):
    return concat([customer, customer])


@query("SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region UNION ALL SELECT n_nationkey FROM nation", "nation", "region")
def concat_three(nation, region):
    nation, region = _keyed(nation, "n_nationkey")[["k"]], _keyed(region, "r_regionkey")[["k"]]
    return concat([nation, region, nation])


@query("SELECT count(*) AS n FROM lineitem", "lineitem")
def table_size(lineitem):
    return lineitem.sdf.sparkSession.createDataFrame([(lineitem.size(),)], "n long")
