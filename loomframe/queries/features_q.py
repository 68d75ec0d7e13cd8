"""Feature engineering."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loomframe.functions.hashing import hash_hex
from loomframe.operators import features as ft
from loomframe.queries.frames import LINE_KEY, cust_nulls
from loomframe.queries.sql import CUST_NULLS, LINE_KEY as KEY_SQL, line_hash
from loomframe.registry import query

TRAIN_SQL = f"substr({line_hash('split')}, 1, 1) < 'd'"


def train_flag():
    return F.substring(hash_hex("split", *LINE_KEY), 1, 1) < "d"


def lines(t, *columns):
    return t.lineitem.select(*LINE_KEY, *columns).withColumn("train", train_flag())


@query("f1_labelled_bins", """
SELECT p_partkey, CASE WHEN p_size > 0 AND p_size <= 10 THEN 'small' WHEN p_size > 10 AND p_size <= 25 THEN 'medium'
            WHEN p_size > 25 AND p_size <= 45 THEN 'large' END AS size_bin FROM part""")
def labelled_bins(t):
    return t.part.select("p_partkey", ft.cut(F.col("p_size"), [0, 10, 25, 45], ["small", "medium", "large"]).alias("size_bin"))


@query("f2_equal_width_bins", f"""
WITH s AS (SELECT {KEY_SQL}, l_extendedprice AS x, {TRAIN_SQL} AS train FROM lineitem),
e AS (SELECT train, min(x) AS lo, max(x) AS hi FROM s GROUP BY train)
SELECT {KEY_SQL}, train, least(3, greatest(0, ceil((x - lo) / ((hi - lo) / 4)) - 1))::INT AS bin FROM s JOIN e USING (train)""")
def equal_width_bins(t):
    df, parts = lines(t, "l_extendedprice"), []
    for flag in (True, False):
        part = df.filter(F.col("train") == flag)
        edges = ft._params(ft.fit_equal_width(part, ["l_extendedprice"]))["l_extendedprice"]
        parts.append(part.withColumn("bin", ft.equal_width_bin(F.col("l_extendedprice"), edges["min"], edges["max"], 4)))
    return parts[0].unionByName(parts[1]).drop("l_extendedprice")


@query("f3_whisker_cap", f"""
WITH s AS (SELECT {KEY_SQL}, l_extendedprice * pow(l_linenumber, 2) AS x, {TRAIN_SQL} AS train FROM lineitem),
q AS (SELECT quantile_cont(x, 0.26) AS a, quantile_cont(x, 0.76) AS b FROM s WHERE train)
SELECT {KEY_SQL}, round(least(greatest(x, a - 1.5 * (b - a)), b + 1.5 * (b - a)), 4) AS x FROM s, q""")
def whisker_cap(t):
    df = lines(t, (F.col("l_extendedprice") * F.pow("l_linenumber", F.lit(2))).alias("x"))
    return ft.cap(df, ft.fit_whiskers(df.filter("train"), ["x"])).select(*LINE_KEY, F.round("x", 4).alias("x"))


@query("f4_one_hot", f"""
WITH {CUST_NULLS}, c AS (SELECT DISTINCT c_mktsegment FROM cust_nulls)
SELECT c_custkey, string_agg((u.c_mktsegment IS NOT DISTINCT FROM c.c_mktsegment)::INT::VARCHAR, '' ORDER BY c.c_mktsegment NULLS LAST) AS bits
FROM cust_nulls u CROSS JOIN c GROUP BY c_custkey""")
def one_hot(t):
    df = cust_nulls(t).select("c_custkey", "c_mktsegment")
    hot = ft.one_hot(df, {"c_mktsegment": ft.fit_categories(df, "c_mktsegment")}, "hot")
    return hot.select("c_custkey", _bits("hot").alias("bits"))


def _bits(vector):
    return F.array_join(F.transform(vector_to_array(vector), lambda x: x.cast("int").cast("string")), "")


@query("f5_top_label_indicators", """
WITH c AS (SELECT 1 AS part_no, p_brand AS label, count(*) AS n FROM part GROUP BY 2
           UNION ALL SELECT 2, p_type, count(*) FROM part GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY part_no ORDER BY n DESC, label) AS rn,
             count(*) OVER (PARTITION BY part_no) AS k FROM c),
kept AS (SELECT * FROM r WHERE rn <= floor(0.8 * k))
SELECT p_partkey, string_agg(((CASE part_no WHEN 1 THEN p_brand ELSE p_type END) = label)::INT::VARCHAR, '' ORDER BY part_no, rn) AS bits
FROM part CROSS JOIN kept GROUP BY p_partkey""")
def top_label_indicators(t):
    df = t.part.select("p_partkey", "p_brand", "p_type")
    hot = ft.one_hot(df, {c: ft.fit_top_labels(df, c, 0.8) for c in ("p_brand", "p_type")}, "hot")
    return hot.select("p_partkey", _bits("hot").alias("bits"))


_SCALED = ["l_quantity", "l_extendedprice"]


def _scaled(t, kind: str, digits: int = 5):
    df = lines(t, *_SCALED)
    out = ft.scale(df, ft.fit_scaler(df.filter("train"), _SCALED, kind))
    return out.select(*LINE_KEY, *[F.round(c, digits).alias(c) for c in _SCALED])


def _scaled_sql(center: str, scale: str) -> str:
    stats = ", ".join(f"{center.format(c=c)} AS c_{c}, {scale.format(c=c)} AS s_{c}" for c in _SCALED)
    cells = ", ".join(f"round(({c} - c_{c}) / s_{c}, 5) AS {c}" for c in _SCALED)
    return f"WITH p AS (SELECT {stats} FROM lineitem WHERE {TRAIN_SQL}) SELECT {KEY_SQL}, {cells} FROM lineitem, p"


@query("f6_standard_scale", _scaled_sql("avg({c})", "stddev_pop({c})"))
def standard_scale(t):
    return _scaled(t, "standard")


@query("f7_minmax_scale", _scaled_sql("min({c})", "(max({c}) - min({c}))"))
def minmax_scale(t):
    return _scaled(t, "minmax")


@query("f8_robust_scale", _scaled_sql("median({c})", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"))
def robust_scale(t):
    return _scaled(t, "robust")


@query("f9_impute", f"""
WITH {CUST_NULLS},
m AS (SELECT median(c_acctbal) AS med FROM cust_nulls),
f AS (SELECT c_mktsegment AS mode FROM cust_nulls WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT c_custkey, round(coalesce(c_acctbal, med), 4) AS c_acctbal, coalesce(c_mktsegment, mode) AS c_mktsegment
FROM cust_nulls, m, f""")
def impute(t):
    df = cust_nulls(t).select("c_custkey", "c_acctbal", "c_mktsegment")
    filled = ft.impute(df, ft.fit_median(df, ["c_acctbal"]))
    filled = ft.impute(filled, ft.fit_most_frequent(df, "c_mktsegment"))
    return filled.withColumn("c_acctbal", F.round("c_acctbal", 4))


@query("f9_impute_marker", f"""
WITH {CUST_NULLS}, s AS (SELECT c_custkey, coalesce(c_acctbal, -0.5::DOUBLE) AS bal FROM cust_nulls),
m AS (SELECT median(bal) AS med FROM s WHERE bal <> -0.5)
SELECT c_custkey, round(CASE WHEN bal = -0.5 THEN med ELSE bal END, 4) AS bal FROM s, m""")
def impute_marker(t):
    df = cust_nulls(t).select("c_custkey", F.coalesce("c_acctbal", F.lit(-0.5)).alias("bal"))
    return ft.impute(df, ft.fit_median(df, ["bal"], -0.5), -0.5).withColumn("bal", F.round("bal", 4))


def _yj_sql(x: str, lam: float) -> str:
    return (f"CASE WHEN {x} >= 0 THEN (pow({x} + 1, {lam}::DOUBLE) - 1) / {lam}::DOUBLE "
            f"ELSE -(pow(1 - {x}, {2 - lam}::DOUBLE) - 1) / {2 - lam}::DOUBLE END")


@query("f10_yeo_johnson_fixed", f"""
SELECT c_custkey, round({_yj_sql('c_acctbal', 0.4)}, 4) AS y FROM customer""")
def yeo_johnson_fixed(t):
    return t.customer.select("c_custkey", F.round(ft.yeo_johnson(F.col("c_acctbal"), 0.4), 4).alias("y"))


def _yj_round(no: int, step: float, span: int) -> str:
    """One grid round around the best exponent of the round before."""
    return f"""
g{no} AS (SELECT round(c + i * {step}::DOUBLE, 10) AS lam FROM b{no - 1}, (SELECT unnest(range(-{span}, {span + 1})) AS i)),
l{no} AS (SELECT lam, -count(*) / 2 * ln(var_pop(CASE WHEN lam = 0 THEN ln(x + 1) ELSE (pow(x + 1, lam) - 1) / lam END))
                 + (lam - 1) * sum(ln(x + 1)) AS ll FROM s CROSS JOIN g{no} WHERE train GROUP BY lam),
b{no} AS (SELECT arg_max(lam, ll) AS c FROM l{no}),"""


@query("f10_yeo_johnson_fit", f"""
WITH s AS (SELECT {KEY_SQL}, l_extendedprice AS x, {TRAIN_SQL} AS train FROM lineitem),
b0 AS (SELECT 1.0::DOUBLE AS c), {_yj_round(1, 0.5, 6)} {_yj_round(2, 0.05, 10)} {_yj_round(3, 0.005, 10)} {_yj_round(4, 0.0005, 10)}
y AS (SELECT {KEY_SQL}, train, (pow(x + 1, c) - 1) / c AS y FROM s, b4),
m AS (SELECT avg(y) AS m, stddev_pop(y) AS sd FROM y WHERE train)
SELECT {KEY_SQL}, round((y - m) / sd, 4) AS y FROM y, m""")
def yeo_johnson_fit(t):
    df = lines(t, "l_extendedprice")
    params = ft.fit_yeo_johnson(df.filter("train"), ["l_extendedprice"])
    return ft.apply_yeo_johnson(df, params).select(*LINE_KEY, F.round("l_extendedprice", 4).alias("y"))


_CONDITIONS = ["l_returnflag = 'N'", "l_quantity <= 10", "l_discount = 0", "l_tax = 0", "l_linenumber = 1", "l_linestatus = 'O'"]


@query("f11_count_status", f"""
WITH c AS (SELECT {KEY_SQL}, {" + ".join(f"({c})::INT" for c in _CONDITIONS)} AS n FROM lineitem)
SELECT {KEY_SQL}, n, CASE WHEN n >= 5 THEN 1 WHEN n >= 3 THEN 2 WHEN n >= 1 THEN 3 ELSE 0 END AS status FROM c""")
def count_status(t):
    df = t.lineitem.withColumn("n", ft.count_true([F.expr(c) for c in _CONDITIONS]))
    return df.select(*LINE_KEY, "n", ft.count_status(F.col("n")).alias("status"))


_HIGH = ["o_orderpriority = '1-URGENT'", "o_orderstatus = 'F'", "o_totalprice > 300000"]
_LOW = ["o_orderpriority = '5-LOW'", "o_totalprice < 100000"]
_COUNTERS_SQL = f"""SELECT o_orderkey, {" + ".join(f"({c})::INT" for c in _HIGH)} AS high,
  {" + ".join(f"({c})::INT" for c in _LOW)} AS low FROM orders"""


def _counters(t):
    return t.orders.select(
        "o_orderkey",
        ft.count_true([F.expr(c) for c in _HIGH]).alias("high"),
        ft.count_true([F.expr(c) for c in _LOW]).alias("low"),
    )


@query("f12_two_counters", _COUNTERS_SQL)
def two_counters(t):
    return _counters(t)


@query("f13_sign_code", f"WITH c AS ({_COUNTERS_SQL}) SELECT o_orderkey, sign(high - low)::INT AS code, high - low AS raw FROM c")
def sign_code(t):
    high, low = F.col("high"), F.col("low")
    return _counters(t).select("o_orderkey", ft.sign_code(high, low).alias("code"), (high - low).alias("raw"))


_GROUP_CODES = {1: 1, 2: -1, 4: 1, 6: -1}  # fixed values: likely groups 1 and 4, unlikely groups 2 and 6


@query("f14_first_set_code", """
SELECT p_partkey, CASE WHEN p_size > 0 AND p_size <= 7 THEN 1 WHEN p_size > 7 AND p_size <= 14 THEN -1
                       WHEN p_size > 21 AND p_size <= 28 THEN 1 WHEN p_size > 35 AND p_size <= 42 THEN -1 ELSE 0 END AS code
FROM part""")
def first_set_code(t):
    groups = [(g, ((F.col("p_size") > 7 * (g - 1)) & (F.col("p_size") <= 7 * g)).cast("int")) for g in range(1, 8)]
    return t.part.select("p_partkey", ft.first_set_code(groups, _GROUP_CODES).alias("code"))


@query("f15_row_sum", f"""
SELECT {KEY_SQL}, round(l_quantity + coalesce(CASE WHEN l_discount > 0.02 THEN l_discount END, 0) + l_tax, 6) AS total
FROM lineitem""")
def row_sum(t):
    df = t.lineitem.withColumn("l_discount", F.when(F.col("l_discount") > 0.02, F.col("l_discount")))
    return df.select(*LINE_KEY, F.round(ft.row_sum(["l_quantity", "l_discount", "l_tax"]), 6).alias("total"))


@query("f16_polynomial", f"""
SELECT {KEY_SQL}, 1.0::DOUBLE AS bias, l_quantity AS a, l_tax AS b, l_quantity * l_quantity AS aa,
       round(l_quantity * l_tax, 6) AS ab, round(l_tax * l_tax, 6) AS bb FROM lineitem""")
def polynomial(t):
    terms = ft.polynomial(["l_quantity", "l_tax"])
    names = ["bias", "a", "b", "aa", "ab", "bb"]
    df = t.lineitem.select(*LINE_KEY, *[e.alias(n) for n, e in zip(names, terms.values())])
    return df.withColumns({c: F.round(c, 6) for c in ("ab", "bb")})


@query("f21_fit_apply_train_only", f"""
WITH s AS (SELECT {KEY_SQL}, CASE WHEN l_discount = 0.05 THEN NULL ELSE l_discount END AS d, l_extendedprice AS x,
                  {TRAIN_SQL} AS train FROM lineitem),
m AS (SELECT median(d) AS med FROM s WHERE train),
i AS (SELECT * REPLACE (coalesce(d, med) AS d) FROM s, m),
q AS (SELECT quantile_cont(x, 0.26) AS a, quantile_cont(x, 0.76) AS b FROM i WHERE train),
c AS (SELECT * REPLACE (least(greatest(x, a - 1.5 * (b - a)), b + 1.5 * (b - a)) AS x) FROM i, q),
z AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, min(d) AS d0, max(d) - min(d) AS dr FROM c WHERE train)
SELECT {KEY_SQL}, train, round((x - mx) / sx, 5) AS x, round((d - d0) / dr, 5) AS d FROM c, z""")
def fit_apply_train_only(t):
    missing = F.when(F.col("l_discount") != 0.05, F.col("l_discount")).alias("d")
    df = lines(t, missing, F.col("l_extendedprice").alias("x"))
    first = ft.fit_together(df.filter("train"), medians=["d"], whiskers=["x"])
    df = ft.cap(ft.impute(df, first["medians"]), first["whiskers"])
    df = ft.scale(df, ft.fit_together(df.filter("train"), scalers={"x": "standard", "d": "minmax"})["scalers"])
    return df.withColumns({c: F.round(c, 5) for c in ("x", "d")})
