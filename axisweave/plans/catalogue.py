"""Named queries over the standard tables and their DuckDB equivalents.

Matrices: M1 users x event types (counts), M2 customers x parts and M3 parts x suppliers (sums of
quantities), M4 order priorities x states (counts), E embeddings. Figures that are not whole numbers are
rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisweave import api
from axisweave.functions import distance, hashing
from axisweave.matrix import COLUMNS, ROWS, Matrix
from axisweave.operators import index
from axisweave.operators.graph import components, strong_components

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def m1(spark, d) -> Matrix:
    return api.from_occurrence(_t(spark, d, "events"), "user_id", "event_type")


def m2(spark, d) -> Matrix:
    j = _t(spark, d, "orders").join(_t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return api.from_cells(j, "o_custkey", "l_partkey", "l_quantity")


def m3(spark, d, where: str = "true") -> Matrix:
    return api.from_cells(_t(spark, d, "lineitem").filter(where), "l_partkey", "l_suppkey", "l_quantity")


def m4(spark, d) -> Matrix:
    return api.from_occurrence(_t(spark, d, "orders"), "o_orderpriority", "o_orderstatus")


M1 = "m1 as (select user_id as r, event_type as c, count(*)::double as v from events group by all)"
M2 = "m2 as (select o_custkey as r, l_partkey as c, sum(l_quantity)::double as v from orders join lineitem on o_orderkey = l_orderkey group by all having sum(l_quantity) <> 0)"
M3 = "m3 as (select l_partkey as r, l_suppkey as c, sum(l_quantity)::double as v from lineitem group by all having sum(l_quantity) <> 0)"
M4 = "m4 as (select o_orderpriority as r, o_orderstatus as c, count(*)::double as v from orders group by all)"
EARLY, LATE = "l_shipdate < timestamp '1998-05-01'", "l_shipdate >= timestamp '1998-05-01'"
HALVES = ", ".join(f"{k} as (select l_partkey as r, l_suppkey as c, sum(l_quantity)::double as v from lineitem where {w} group by all having sum(l_quantity) <> 0)" for k, w in (("a", EARLY), ("b", LATE)))


def query(name: str, sql: str | None = None):
    """Registers f(spark, sf_dir) as a query, with its SQL where there is one."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def flat(m: Matrix, digits: int | None = None) -> DataFrame:
    return m.cells.select("r", "c", F.round("v", digits).alias("v") if digits is not None else "v")


def line(d: DataFrame, digits: int = 6) -> DataFrame:
    return d.select("label", F.round("v", digits).alias("v"))


# -- sources -----------------------------------------------------------------

query("occurrence", f"with {M1} select r, c, v from m1")(lambda s, d: flat(m1(s, d)))
for _name, _agg in {"sum": "sum(value)", "min": "min(value)", "max": "max(value)", "mean": "avg(value)", "std": "stddev_pop(value)", "first": "arg_min(value, event_id)", "last": "arg_max(value, event_id)"}.items():
    query(f"pivot_{_name}", f"select user_id as r, event_type as c, round({_agg}, 9) as v from events where value is not null group by all having {_agg} <> 0")(
        lambda s, d, a=_name: flat(api.from_pivot(_t(s, d, "events"), "user_id", "event_type", "value", a, "event_id" if a in ("first", "last") else None), 9)
    )
query("pivot_two_keys", "select user_id as r, event_type as c1, hour(ts) as c2, count(*)::double as v from events group by all")(
    lambda s, d: api.from_pivot(_t(s, d, "events").withColumn("h", F.hour("ts").cast("long")), "user_id", ["event_type", "h"]).cells.select("r", F.col("c.event_type").alias("c1"), F.col("c.h").alias("c2"), "v")
)
query("from_lists", "select l_orderkey as r, l_partkey as c, count(*)::double as v from lineitem group by all")(
    lambda s, d: flat(api.from_lists(_t(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts")), "l_orderkey", "parts"))
)
query("from_dense", "select vec_id as r, (i - 1)::int as c, round(embedding[i]::double, 5) as v from embeddings, (select unnest(generate_series(1, 64)) as i) where embedding[i] <> 0")(
    lambda s, d: flat(api.from_dense(_t(s, d, "embeddings"), "vec_id", "embedding"), 5)
)
query("from_diagonal", "select c_custkey as r, c_custkey as c, c_acctbal as v from customer where c_acctbal <> 0")(
    lambda s, d: flat(api.from_diagonal(_t(s, d, "customer").select(F.col("c_custkey").alias("label"), F.col("c_acctbal").alias("v"))))
)
query("from_random")(lambda s, d: flat(api.from_random(s, (200, 50), 0.1, 7)))

# -- exports -----------------------------------------------------------------

query("to_wide", f"with {M4} select r as row, coalesce(sum(v) filter (c = 'F'), 0)::double as F, coalesce(sum(v) filter (c = 'O'), 0)::double as O, coalesce(sum(v) filter (c = 'P'), 0)::double as P from m4 group by r")(
    lambda s, d: m4(s, d).to_wide().select("row", *[F.col(k) for k in "FOP"])
)
query("to_lists", f"with {M1} select r as col, string_agg(c, ',' order by v desc, c) as list_of_col from m1 group by r")(
    lambda s, d: m1(s, d).to_lists().select("col", F.array_join("list_of_col", ",").alias("list_of_col"))
)
query("describe", f"with {M3}, s as (select (select count(distinct l_partkey) from lineitem) as n_rows, (select count(distinct l_suppkey) from lineitem) as n_cols, count(*) as nnz, max(v) as hi, min(v) as lo, sum(v) as sum from m3) "
      "select n_rows, n_cols, nnz, round(nnz / (n_rows * n_cols), 9) as density, case when nnz = n_rows * n_cols then lo else least(lo, 0) end::double as min, hi as max, sum from s")(
    lambda s, d: m3(s, d).describe().withColumn("density", F.round("density", 9))
)

# -- labels ------------------------------------------------------------------

_SOME_PARTS, _SOME_SUPP = "select p_partkey from part where p_size <= 10", "select s_suppkey from supplier where s_nationkey < 5"


def _some(s, d):
    return _t(s, d, "part").filter("p_size <= 10").select("p_partkey"), _t(s, d, "supplier").filter("s_nationkey < 5").select("s_suppkey")


query("restrict", f"with {M3} select r, c, v from m3 where r in ({_SOME_PARTS}) and c in ({_SOME_SUPP})")(lambda s, d: flat(m3(s, d).restrict(*_some(s, d))))
query("exclude", f"with {M3} select r, c, v from m3 where r not in ({_SOME_PARTS}) and c not in ({_SOME_SUPP})")(lambda s, d: flat(m3(s, d).exclude(*_some(s, d))))
query("without_zeros", f"with {M3}, x as (select * from m3 where r in (select r from m3 group by r having count(*) >= 4)) select r, c, v from x where c in (select c from x group by c having count(*) >= 4)")(
    lambda s, d: flat(m3(s, d).without_zeros(min_nonzero=4))
)
query("diagonal", f"with {M3} select r, c, v from m3 where r = c")(lambda s, d: flat(m3(s, d).diagonal()))
query("without_diagonal", f"with {M3} select r, c, v from m3 where r <> c")(lambda s, d: flat(m3(s, d).without_diagonal()))
query("without_mask", f"with {M3} select r, c, v from m3 where not exists (select 1 from lineitem where l_returnflag = 'R' and l_quantity <> 0 and l_partkey = r and l_suppkey = c)")(
    lambda s, d: flat(m3(s, d).without_mask(m3(s, d, "l_returnflag = 'R'")))
)
query("nonzero_mask", f"with {M3} select r, c, 1.0::double as v from m3")(lambda s, d: flat(m3(s, d).nonzero_mask()))
query("cutoff", f"with {M3} select r, c, v from m3 where v >= 60")(lambda s, d: flat(m3(s, d).truncate_with_cutoff(60)))
query("transpose", f"with {M4} select c as r, r as c, v from m4")(lambda s, d: flat(m4(s, d).transpose()))
query("symmetrize", "select l_partkey as label from lineitem union select l_suppkey from lineitem")(lambda s, d: m3(s, d).symmetrize().rows.select("label"))
query("symmetrize_common", f"with {M3}, k as (select l_partkey as x from lineitem intersect select l_suppkey from lineitem) select r, c, v from m3 where r in (select x from k) and c in (select x from k)")(
    lambda s, d: flat(m3(s, d).symmetrize(True))
)
query("tril", f"with {M3}, p as (select x, row_number() over (order by x) as n from (select distinct l_partkey as x from lineitem)), q as (select x, row_number() over (order by x) as n from (select distinct l_suppkey as x from lineitem)) select r, c, v from m3 join p on r = p.x join q on c = q.x where q.n <= p.n + 2")(
    lambda s, d: flat(m3(s, d).tril(2))
)
query("slice", f"with {M3}, p as (select x, row_number() over (order by x) - 1 as n from (select distinct l_partkey as x from lineitem)) select r, c, v from m3 join p on r = p.x where n between 10 and 49")(
    lambda s, d: flat(m3(s, d).slice_positions(rows=(10, 50)))
)
query("rename", f"with {M4} select 'p:' || case when r = '1-URGENT' then 'now' else r end || '!' as r, c, v from m4")(lambda s, d: flat(m4(s, d).rename(ROWS, "p:", "!", {"1-URGENT": "now"})))
query("align_inner", f"with {HALVES} select r, c, v from a where r in (select l_partkey from lineitem where {LATE}) and c in (select l_suppkey from lineitem where {LATE})")(
    lambda s, d: flat(m3(s, d, EARLY).align(m3(s, d, LATE))[0])
)
query("sample_values", f"with {M3} select c_custkey as r, c_custkey % 7 + 1 as c, coalesce(v, 0)::double as v from customer left join m3 on r = c_custkey and c = c_custkey % 7 + 1")(
    lambda s, d: m3(s, d).sample_values(_t(s, d, "customer").select(F.col("c_custkey").alias("r"), (F.col("c_custkey") % 7 + 1).alias("c")))
)
query("hstack", "select o_orderpriority as r, k as part, o_orderstatus as c, count(*)::double as v from (select *, (o_orderdate >= timestamp '1998-05-01')::int as k from orders) group by all")(
    lambda s, d: api.hstack([api.from_occurrence(_t(s, d, "orders").filter(w), "o_orderpriority", "o_orderstatus") for w in ("o_orderdate < timestamp '1998-05-01'", "o_orderdate >= timestamp '1998-05-01'")]).cells.select("r", "c.part", F.col("c.label").alias("c"), "v")
)

# -- arithmetic --------------------------------------------------------------


def _halves(s, d):
    return m3(s, d, EARLY), m3(s, d, LATE)


_FULL = f"with {HALVES}, j as (select coalesce(a.r, b.r) as r, coalesce(a.c, b.c) as c, coalesce(a.v, 0) as x, coalesce(b.v, 0) as y from a full join b on a.r = b.r and a.c = b.c)"
for _name, _f in {"add": "x + y", "subtract": "x - y", "maximum": "greatest(x, y)", "minimum": "least(x, y)"}.items():
    query(_name, f"{_FULL} select r, c, ({_f})::double as v from j where ({_f}) <> 0")(lambda s, d, n=_name: flat(getattr(_halves(s, d)[0], n)(_halves(s, d)[1])))
query("multiply", f"with {HALVES} select a.r, a.c, a.v * b.v as v from a join b on a.r = b.r and a.c = b.c")(lambda s, d: flat(_halves(s, d)[0] * _halves(s, d)[1]))
query("divide", f"with {HALVES} select a.r, a.c, round(a.v / b.v, 6) as v from a join b on a.r = b.r and a.c = b.c")(lambda s, d: flat(_halves(s, d)[0] / _halves(s, d)[1], 6))
query("reduce_sum", f"with {M3} select r, c, v from m3")(lambda s, d: flat(api.reduce_sum([m3(s, d, f"l_returnflag = '{k}'") for k in "ANR"])))
query("reduce_product", "with f as (select l_partkey as r, l_suppkey as c, l_returnflag as k, sum(l_quantity)::double as v from lineitem group by all) select r, c, product(v) as v from f group by r, c having count(*) = 3")(
    lambda s, d: flat(api.reduce_product([m3(s, d, f"l_returnflag = '{k}'") for k in "ANR"]))
)
query("scale_rows", f"with {M3} select r, c, round(v * p_size, 4) as v from m3 join part on r = p_partkey where p_size <> 0")(
    lambda s, d: flat(m3(s, d).scale(ROWS, _t(s, d, "part").select(F.col("p_partkey").alias("label"), F.col("p_size").cast("double").alias("v"))), 4)
)
query("add_vector", f"with {M4}, g as (select distinct r, c, length(r)::double as x from (select distinct r from m4), (select distinct c from m4)) select r, c, coalesce(v, 0) + x as v from g left join m4 using (r, c)")(
    lambda s, d: flat(m4(s, d).add_vector(ROWS, m4(s, d).rows.select("label", F.length("label").cast("double").alias("v"))))
)
for _name, _f, _run in (
    ("scalar_add", "v + 2", lambda m: m + 2),
    ("scalar_divide", "v / 7", lambda m: m / 7),
    ("log", "ln(v)", lambda m: m.log()),
    ("log1p", "ln(1 + v)", lambda m: m.log1p()),
    ("exp", "exp(v / 100)", lambda m: (m / 100).exp()),
    ("power", "pow(v, 2)", lambda m: m**2),
    ("sqrt", "sqrt(v)", lambda m: m.sqrt()),
    ("inverse", "3 / v", lambda m: m.inverse(3.0)),
    ("clip", "least(greatest(v, 20), 60)", lambda m: m.clip(20, 60)),
    ("logistic", "1 / (1 + exp(-(v - 50) / 10))", lambda m: m.logistic(50, 10)),
    ("trunc", "trunc(v / 7)", lambda m: (m / 7).trunc()),
    ("sign", "sign(v - 50)", lambda m: m.map_cells(lambda v: v - 50).sign()),
    ("abs", "abs(v - 50)", lambda m: m.map_cells(lambda v: v - 50).abs()),
    ("round", "round_even(v / 7, 0)", lambda m: (m / 7).round()),
    ("apply", "v * 2 + 1", lambda m: m.apply(lambda v: v * 2 + 1)),
):
    query(_name, f"with {M3} select r, c, round({_f}, 6)::double as v from m3 where ({_f}) <> 0")(lambda s, d, f=_run: flat(f(m3(s, d)), 6))
query("compatibility", f"with {M3} select r, c, v * case when r % 5 = c % 5 then 2 else 0.5 end as v from m3")(
    lambda s, d: flat(m3(s, d).compatibility(*[a.select("label", (F.col("label") % 5).alias("g")) for a in (m3(s, d).rows, m3(s, d).cols)], 2.0, 0.5))
)

# -- products ----------------------------------------------------------------

query("dot", f"with {M1} select a.c as r, b.c as c, sum(a.v * b.v)::double as v from m1 a join m1 b on a.r = b.r group by all")(lambda s, d: flat(m1(s, d).transpose().dot(m1(s, d))))
query("dot_top", f"with {M1}, p as (select a.r as r, b.r as c, sum(a.v * b.v)::double as v from m1 a join m1 b on a.c = b.c group by all) select r, c, v from p qualify row_number() over (partition by r order by v desc, c) <= 3")(
    lambda s, d: flat(m1(s, d).dot(m1(s, d).transpose(), top=3))
)
query("mask_dot", f"with {M3}, {M2} select m2.r, m2.c, sum(x.v * y.v)::double as v from m2 join m2 x on m2.r = x.r join m3 y on x.c = y.r and y.c = m2.c group by all")(
    lambda s, d: flat(m2(s, d).dot(m3(s, d), mask=m2(s, d)))
)
query("mask_dot_divide", f"with {M1}, g as (select a.c as r, b.c as c, sum(a.v * b.v)::double as v from m1 a join m1 b on a.r = b.r group by all), p as (select m.r, m.c, m.v, sum(x.v * g.v) as d from m1 m join m1 x on m.r = x.r join g on g.r = x.c and g.c = m.c group by all) select r, c, round(v / d, 9) as v from p where round(v / d, 9) <> 0 or v <> 0")(
    lambda s, d: flat(m1(s, d).mask_dot(m1(s, d).second_moment(), m1(s, d), "divide"), 9)
)
query("shadow", f"with {M1} select a.c as r, b.c as c, max(a.v * b.v)::double as v from m1 a join m1 b on a.r = b.r group by all")(lambda s, d: flat(m1(s, d).transpose().shadow(m1(s, d))))
for _op, _f in (("min", "least"), ("max", "greatest")):
    query(f"pairwise_{_op}", f"with {M1}, p as (select a.r as r, b.r as c, sum({_f}(a.v, b.v))::double as v from m1 a join m1 b on a.c = b.c group by all) select r, c, v from p where v > 20 qualify row_number() over (partition by r order by v desc, c) <= 4")(
        lambda s, d, o=_op: flat(m1(s, d).pairwise_top(m1(s, d).transpose(), o, 4, 20))
    )
query("second_moment", f"with {M3} select a.c as r, b.c as c, sum(a.v * b.v)::double as v from m3 a join m3 b on a.r = b.r group by all")(lambda s, d: flat(m3(s, d).second_moment()))
_W1 = "w as (select c as label, length(c)::double as v from (select distinct c from m1))"


def _w1(s, d):
    return m1(s, d).cols.select("label", F.length("label").cast("double").alias("v"))


query("dot_vector", f"with {M1}, {_W1} select r as label, sum(m1.v * w.v)::double as v from m1 join w on c = label group by r")(lambda s, d: line(m1(s, d).dot_vector(_w1(s, d))))
query("dot_vector_dot", f"with {M1}, {_W1}, g as (select a.c as r, b.c as c, sum(a.v * b.v)::double as v from m1 a join m1 b on a.r = b.r group by all) select r as label, sum(g.v * g.v * w.v)::double as v from g join w on c = label group by r")(
    lambda s, d: line(m1(s, d).transpose().dot_vector_dot(m1(s, d), _w1(s, d), 2))
)
query("shadow_vector_dot", f"with {M1}, {_W1}, g as (select a.c as r, b.c as c, max(a.v * b.v)::double as v from m1 a join m1 b on a.r = b.r group by all) select r as label, sum(g.v * w.v)::double as v from g join w on c = label group by r")(
    lambda s, d: line(m1(s, d).transpose().shadow_vector_dot(m1(s, d), _w1(s, d)))
)
query("row_kron", f"with {M1} select a.r, a.c as c1, b.c as c2, a.v * b.v as v from m1 a join m1 b on a.r = b.r")(
    lambda s, d: m1(s, d).row_kron(m1(s, d)).cells.select("r", F.col("c.a").alias("c1"), F.col("c.b").alias("c2"), "v")
)
query("row_kron_dot", f"with {M1} select a.r as label, sum(a.v * b.v * (length(a.c) + length(b.c)))::double as v from m1 a join m1 b on a.r = b.r where a.c <= b.c group by a.r")(
    lambda s, d: line(m1(s, d).row_kron_dot(m1(s, d), m1(s, d).cols.select(F.col("label").alias("c1")).join(m1(s, d).cols.select(F.col("label").alias("c2")), F.col("c1") <= F.col("c2")).withColumn("v", (F.length("c1") + F.length("c2")).cast("double"))))
)
query("row_kron_dot_transpose", f"with {M1} select a.c as c1, b.c as c2, sum(a.v * b.v * (a.r % 3 + 1))::double as v from m1 a join m1 b on a.r = b.r group by all")(
    lambda s, d: m1(s, d).row_kron_dot_transpose(m1(s, d), m1(s, d).rows.select("label", (F.col("label") % 3 + 1).cast("double").alias("v")))
)
query("kron", f"with {M4} select a.r as r1, b.r as r2, a.c as c1, b.c as c2, a.v * b.v as v from m4 a, m4 b")(
    lambda s, d: m4(s, d).kron(m4(s, d)).cells.select(F.col("r.a").alias("r1"), F.col("r.b").alias("r2"), F.col("c.a").alias("c1"), F.col("c.b").alias("c2"), "v")
)
query("pairwise_l2square", f"with {M1}, g as (select a.r as r, b.r as c, sum(a.v * b.v) as x from m1 a join m1 b on a.c = b.c group by all), n as (select r, sum(v * v) as n from m1 group by r) select a.r as r, b.r as c, (a.n + b.n - 2 * coalesce(x, 0))::double as v from n a cross join n b left join g on g.r = a.r and g.c = b.r where a.n + b.n - 2 * coalesce(x, 0) > 0")(
    lambda s, d: flat(m1(s, d).pairwise_l2square())
)
query("linear_error", f"with {M1}, g as (select a.c as r, b.c as c, sum(a.v * b.v)::double as v from m1 a join m1 b on a.r = b.r group by all), p as (select u.r, k.c, coalesce(sum(m1.v * g.v), 0) as x from (select distinct r from m1) u cross join (select distinct c from m1) k left join m1 on m1.r = u.r left join g on g.r = m1.c and g.c = k.c group by all) select c as label, sum(pow(x + length(c) - 1, 2))::double as v from p group by c")(
    lambda s, d: line(m1(s, d).linear_error(m1(s, d).second_moment(), _w1(s, d), m1(s, d).cols.select("label", F.lit(-1.0).alias("v"))))
)

# -- figures -----------------------------------------------------------------

_WIDE = f"with {M3}, n as (select count(distinct l_suppkey) as n from lineitem), h as (select count(distinct l_partkey) as h from lineitem)"
query("row_sum", f"with {M3} select r as label, sum(v) as v from m3 group by r")(lambda s, d: line(m3(s, d).sum()))
query("col_mean", f"{_WIDE} select c as label, round(sum(v) / any_value(h), 6) as v from m3, h group by c")(lambda s, d: line(m3(s, d).mean(COLUMNS)))
query("row_max", f"{_WIDE} select r as label, case when count(*) = any_value(n) then max(v) else greatest(max(v), 0) end::double as v from m3, n group by r")(lambda s, d: line(m3(s, d).max()))
query("row_min", f"{_WIDE} select r as label, case when count(*) = any_value(n) then min(v) else least(min(v), 0) end::double as v from m3, n group by r")(lambda s, d: line(m3(s, d).min()))
query("row_var", f"{_WIDE} select r as label, round(sum(v * v) / any_value(n) - pow(sum(v) / any_value(n), 2), 6) as v from m3, n group by r")(lambda s, d: line(m3(s, d).variance()))
query("row_std", f"{_WIDE} select r as label, round(sqrt(sum(v * v) / any_value(n) - pow(sum(v) / any_value(n), 2)), 6) as v from m3, n group by r")(lambda s, d: line(m3(s, d).deviation()))
query("total_min", f"{_WIDE} select case when count(*) = any_value(n * h) then min(v) else least(min(v), 0) end::double as v from m3, n, h")(lambda s, d: m3(s, d).min(None))
query("sum_power", f"with {M3} select c as label, round(sum(pow(v, 3)), 4) as v from m3 group by c")(lambda s, d: line(m3(s, d).sum_power(3, COLUMNS), 4))
query("count_nonzero", f"with {M3} select r as label, count(*) as n from m3 group by r")(lambda s, d: m3(s, d).count_nonzero().select("label", F.col("v").alias("n")))
for _k, _f in {"l1": "sum(abs(v))", "l2": "sqrt(sum(v * v))", "linf": "max(abs(v))"}.items():
    query(f"norm_{_k}", f"with {M3} select r as label, round({_f}, 6)::double as v from m3 group by r")(lambda s, d, k=_k: line(m3(s, d).norm(ROWS, k)))
    query(f"normalize_{_k}", f"with {M3}, n as (select r, {_f} as n from m3 group by r) select r, c, round(v / n, 12) as v from m3 join n using (r)")(lambda s, d, k=_k: flat(m3(s, d).normalize(ROWS, k), 12))
query("normalize_damped", f"with {M3}, n as (select r, sum(abs(v)) as n from m3 group by r) select r, c, round(v / (sqrt(n) * ln(1 + n) * (1 + exp(-(n - 100) / 50))), 6) as v from m3 join n using (r)")(
    lambda s, d: flat(m3(s, d).normalize(ROWS, "l1", 0.5, 1.0, 100, 50), 6)
)
query("argmax", f"with {M1} select r as label, arg_max(c, (v, -p)) as arg from m1 join (select c, row_number() over (order by c) as p from (select distinct c from m1)) using (c) group by r")(lambda s, d: m1(s, d).arg_extreme())
query("argmin", f"with {M4} select r as label, arg_min(c, (v, c)) as arg from m4 group by r having count(*) = (select count(distinct o_orderstatus) from orders)")(lambda s, d: m4(s, d).arg_extreme(largest=False))
for _k, _f in {"sum": "sum(v)", "mean": "sum(v) / any_value(n)", "max": "max(v)"}.items():
    query(f"group_rows_{_k}", f"with {M3}, g as (select l_partkey % 10 as g, count(distinct l_partkey) as n from lineitem group by 1) select r % 10 as r, c, round({_f}, 6)::double as v from m3 join g on g = r % 10 group by r % 10, c")(
        lambda s, d, k=_k: flat(m3(s, d).group_rows(m3(s, d).rows.select("label", (F.col("label") % 10).alias("g")), k), 6)
    )
query("kl_div", f"{_FULL}, n as (select r, c, x / sum(x) over () as x, y / sum(y) over () as y from j) select round(sum(case when x > 0 then x * ln(x / greatest(y, 1e-11)) else 0 end - x + y), 6) as v from n")(
    lambda s, d: _halves(s, d)[0].normalize(None).divergence(_halves(s, d)[1].normalize(None)).select(F.round("v", 6).alias("v"))
)
query("cosine_gram", f"with {M1}, n as (select c, sqrt(sum(v * v)) as n from m1 group by c) select a.c as a, b.c as b, round(sum(a.v * b.v) / any_value(x.n * y.n), 6) as v from m1 a join m1 b on a.r = b.r join n x on x.c = a.c join n y on y.c = b.c where a.c < b.c group by a.c, b.c")(
    lambda s, d: m1(s, d).cosine_gram().select("a", "b", F.round("v", 6).alias("v"))
)
query("coherence", f"with {M1}, n as (select c, sqrt(sum(v * v)) as n from m1 group by c), g as (select sum(a.v * b.v) / any_value(x.n * y.n) as v from m1 a join m1 b on a.r = b.r join n x on x.c = a.c join n y on y.c = b.c where a.c < b.c group by a.c, b.c) select round(max(v), 6) as v from g")(
    lambda s, d: m1(s, d).coherence().select(F.round("v", 6).alias("v"))
)
query("gini", f"with {M1}, n as (select count(distinct event_type) as n from events), k as (select r, v, n - count(*) over (partition by r) + row_number() over (partition by r order by v, c) as k, n from m1, n), g as (select r, sum((2 * k - n - 1) * v) / (sum(v) * any_value(n)) as g from k group by r) select round(sum(g) / (select count(distinct user_id) from events), 6) as v from g")(
    lambda s, d: m1(s, d).row_mean_gini().select(F.round("v", 6).alias("v"))
)
query("volume_at_cutoff", f"with {M1}, k as (select c, sum(v) over (partition by c order by v desc, r rows unbounded preceding) / sum(v) over (partition by c) as s from m1) select c as label, round(count(*) filter (s < 0.8) / (select count(distinct user_id) from events), 6) as v from k group by c")(
    lambda s, d: line(m1(s, d).volume_at_cutoff(0.8))
)
query("anomaly", f"with {M4}, t as (select sum(v) as t from m4), rs as (select r, sum(v) as rs from m4 group by r), cs as (select c, sum(v) / any_value(t) as f from m4, t group by c), "
      "g as (select rs.r, cs.c, rs, f, coalesce(v, 0) as v, rs * f as e from rs cross join cs left join m4 on m4.r = rs.r and m4.c = cs.c), "
      "x as (select *, v + least(0.5 * sqrt(greatest(e, v)), abs(e - v)) * sign(e - v) as fixed from g), y as (select *, fixed / sum(e) over (partition by r) as q from x) "
      "select r, c, round(ln(q * (1 - f) / f / (1 - q)), 6) as v from y where abs(ln(q * (1 - f) / f / (1 - q))) > 1e-9")(
    lambda s, d: m4(s, d).anomaly(0.5).cells.filter(F.abs("v") > 1e-9).select("r", "c", F.round("v", 6).alias("v"))
)

# -- ranks and truncations ---------------------------------------------------

query("rank_stored", f"with {M3} select r, c, row_number() over (partition by r order by v, c)::int as v from m3")(lambda s, d: m3(s, d).rank())
query("rank_reverse", f"with {M3} select r, c, row_number() over (partition by c order by v desc, r)::int as v from m3")(lambda s, d: m3(s, d).rank(COLUMNS, True))
query("rank_grid", f"with {M1}, g as (select u.r, t.c, coalesce(v, 0) as v from (select distinct r from m1) u cross join (select distinct c from m1) t left join m1 on m1.r = u.r and m1.c = t.c) select r, c, (row_number() over (partition by r order by v, c) - 1)::int as v from g")(
    lambda s, d: m1(s, d).rank(whole_grid=True)
)
query("truncate_rows", f"with {M2} select r, c, v from m2 qualify row_number() over (partition by r order by v desc, c) <= 5")(lambda s, d: flat(m2(s, d).truncate(nb_h=5)))
query("truncate_columns", f"with {M2} select r, c, v from m2 qualify row_number() over (partition by c order by v desc, r) <= 5")(lambda s, d: flat(m2(s, d).truncate(nb_v=5)))
query("truncate_all", f"with {M2} select r, c, v from m2 order by v desc, r, c limit 100")(lambda s, d: flat(m2(s, d).truncate(nb=100)))
query("truncate_by_label", f"with {M4} select r, c, v from m4 qualify row_number() over (partition by r order by v desc, c) <= case r when '1-URGENT' then 1 when '2-HIGH' then 2 else 0 end")(
    lambda s, d: flat(m4(s, d).truncate_by_count({"1-URGENT": 1, "2-HIGH": 2}))
)
_CUM = "coalesce(sum(v) over (partition by {p} order by v desc, {q} rows between unbounded preceding and 1 preceding), 0) as before, row_number() over (partition by {p} order by v desc, {q}) as k, sum(v) over (partition by {p}) as total"
query("truncate_cumulative", f"with {M2}, k as (select *, {_CUM.format(p='r', q='c')} from m2) select r, c, v from k where k = 1 or before < 0.7 * total - 1e-9")(lambda s, d: flat(m2(s, d).truncate(cum_h=0.3)))
query("truncate_chain", f"with {M2}, k as (select *, {_CUM.format(p='r', q='c')} from m2), a as (select r, c, v from k where k = 1 or before < 0.8 * total - 1e-9), b as (select * from a where v >= 20), e as (select * from b qualify row_number() over (partition by r order by v desc, c) <= 6) select r, c, v from e qualify row_number() over (partition by c order by v desc, r) <= 4")(
    lambda s, d: flat(m2(s, d).truncate(cum_h=0.2, cutoff=20, nb_h=6, nb_v=4))
)
query("truncate_budget", f"with {M2}, w as (select c, sum(v) as w from m2 group by c), k as (select m2.*, row_number() over (partition by r order by v desc, c) as k, coalesce(sum(w) over (partition by r order by v desc, c rows between unbounded preceding and 1 preceding), 0) as before from m2 join w using (c)) select r, c, v from k where k = 1 or before < 2000")(
    lambda s, d: flat(m2(s, d).truncate_by_budget(m2(s, d).sum(COLUMNS), 2000))
)
query("truncate_groups", f"with {M2} select r, c, v from m2 qualify c % 4 = 0 or row_number() over (partition by r, c % 4 order by v desc, c) <= 2")(
    lambda s, d: flat(m2(s, d).truncate_by_groups(m2(s, d).cols.select("label", F.when(F.col("label") % 4 == 0, -1).otherwise(F.col("label") % 4).alias("g")), 2))
)
query("median_stored", f"with {M2}, l as (select r, list_sort(list(v)) as x from m2 group by r) select r as label, case when len(x) % 2 = 0 then (x[len(x) // 2] + x[len(x) // 2 + 1]) / 2 else x[len(x) // 2 + 1] end as v from l")(
    lambda s, d: line(m2(s, d).median(ROWS, True))
)
query("quantile_all", f"with {M1}, n as (select count(distinct event_type) as n from events), l as (select r, list_sort(list_concat(list(v), list_transform(range(any_value(n) - count(*)), lambda i: 0.0::double))) as x, any_value(n) as n from m1, n group by r) select r as label, case when n % 2 = 0 and floor(n * 0.75) > 0 then (x[floor(n * 0.75)::int] + x[floor(n * 0.75)::int + 1]) / 2 else x[floor(n * 0.75)::int + 1] end as v from l")(
    lambda s, d: line(m1(s, d).quantile(0.75))
)
query("quantile_boundaries", f"with {M2}, l as (select r, list_sort(list(v)) as x from m2 group by r), j as (select r, i, x[least(greatest(floor(i * len(x) / 4 + 0.5), 1), len(x))::int] as b from l, (select unnest([1, 2, 3]) as i)) select r as label, i::int as i, b as v from j")(
    lambda s, d: m2(s, d).quantile_boundaries(4).select("label", F.posexplode("v").alias("i", "v")).withColumn("i", F.col("i") + 1)
)
query("quantile_bins", f"with {M2}, l as (select r, list_sort(list(v)) as x from m2 group by r), b as (select r, [x[least(greatest(floor(i * len(x) / 4 + 0.5), 1), len(x))::int] for i in [1, 2, 3]] as b from l) select r, c, (len(list_filter(b, lambda y: y < v)) + 1)::double as v from m2 join b using (r)")(
    lambda s, d: flat(m2(s, d).quantile_bins(4))
)

# -- similarity and allocation -----------------------------------------------

query("similarity_users", f"with {M1}, n as (select r, c, v / sum(v) over (partition by r) as v from m1), s as (select a.r as r, b.r as c, round(sum(least(a.v, b.v)), 6) as v from n a join n b on a.c = b.c group by all) select r, c, v from s where v > 0.005 qualify row_number() over (partition by r order by v desc, c) <= 5")(
    lambda s, d: _similar_users(m1(s, d))
)


def _similar_users(m: Matrix) -> DataFrame:
    """Rounds before it ranks, so equal overlaps tie the same way whatever the order of the sums."""
    return flat(m.normalize().similarity(nb_keep=5, top=None, cumtop=None, digits=6))


query("similarity_parts", f"with {M3}, a as (select *, {_CUM.format(p='r', q='c')} from m3), t as (select r, c, v from a where k = 1 or before < 0.98 * total - 1e-9), u as (select * from t qualify row_number() over (partition by c order by v desc, r) <= 20), s as (select x.r as r, y.r as c, sum(least(x.v, y.v)) as v from u x join u y on x.c = y.c group by all) select r, c, v from s where v > 0.005 qualify row_number() over (partition by r order by v desc, c) <= 10")(
    lambda s, d: flat(m3(s, d).similarity(nb_keep=10, top=20))
)
query("jaccard", f"with {M1}, n as (select r, count(*) as n from m1 group by r) select a.r as r, b.r as c, round(count(*) / (any_value(x.n + y.n) - count(*)), 6) as v from m1 a join m1 b on a.c = b.c join n x on x.r = a.r join n y on y.r = b.r group by a.r, b.r")(
    lambda s, d: flat(m1(s, d).jaccard(digits=6))
)
query("top_values_similarity", f"with {M1}, t as (select r, c from m1 qualify row_number() over (partition by c order by v desc, r) <= 20) select a.c as r, b.c as c, count(*) / 20 as v from t a join t b on a.r = b.r group by a.c, b.c")(
    lambda s, d: flat(m1(s, d).top_values_similarity(top=20))
)
query("reco", f"with {M2} select c as label, v, null::varchar as deco from m2 where r = 1 order by v desc, c limit 20")(lambda s, d: m2(s, d).reco(1, 20))
_RANKED = "k as (select r, c, v, row_number() over (partition by c order by v desc, r) as k from m1)"
query("round_robin", f"with {M1}, {_RANKED} select r, c, v from k where k <= 60 qualify row_number() over (partition by r order by k, c) <= 2")(lambda s, d: flat(m1(s, d).round_robin_allocation(2, 60)))
query("argmax_allocation", f"with {M1}, {_RANKED} select r, c, v from k where k <= 60 qualify row_number() over (partition by r order by v desc, c, r) <= 2")(lambda s, d: flat(m1(s, d).argmax_allocation(2, 60)))
query("round_robin_bounded")(lambda s, d: flat(m1(s, d).round_robin_allocation(2, 60, 25)))
query("argmax_bounded")(lambda s, d: flat(m1(s, d).argmax_allocation(2, 60, 25)))

# -- distances ---------------------------------------------------------------


def _e(s, d):
    return _t(s, d, "embeddings").select(F.col("vec_id").alias("r"), F.col("embedding").cast("array<double>").alias("val"))


_E = "e as (select vec_id as r, embedding::double[] as x from embeddings)"
for _k, _f in {
    "euclidean": "list_distance(a.x, b.x)",
    "cityblock": "list_sum([abs(p[1] - p[2]) for p in list_zip(a.x, b.x)])",
    "chebychev": "list_max([abs(p[1] - p[2]) for p in list_zip(a.x, b.x)])",
    "scalar_product": "list_inner_product(a.x, b.x)",
}.items():
    query(f"distance_{_k}", f"with {_E} select a.r as a, b.r as b, round({_f}, 4) + 0 as v from e a join e b on a.r < b.r ")(
        lambda s, d, k=_k: distance.pairwise(_e(s, d), k, digits=4)
    )
query("nearest_row", f"with {_E}, p as (select a.r as r, b.r as b, list_distance(a.x, b.x) as v from e a join e b on a.r <> b.r) select r, arg_min(b, v) as nearest, round(min(v), 4) as v from p group by r")(
    lambda s, d: distance.nearest_row(_e(s, d), "euclidean").select("r", "nearest", F.round("v", 4).alias("v"))
)
query("vector_distance", f"with {_E} select r, round(list_sum([pow(y - 0.5, 2) for y in x]), 4) as v from e")(lambda s, d: distance.vector_distance(_e(s, d), [0.5] * 64).select("r", F.round("v", 4).alias("v")))

# -- indexes -----------------------------------------------------------------


def _ev(s, d):
    return _t(s, d, "events").select("event_id", "user_id", "event_type", "value")


query("factorize", "with f as (select event_type, (row_number() over (order by min(event_id)) - 1)::int as code from events group by 1) select event_id, code from events join f using (event_type)")(
    lambda s, d: index.factorize(_ev(s, d), "event_type", "event_id").select("event_id", "code")
)
query("index_counts", "select user_id, event_type, count(*) as count from events group by all")(lambda s, d: index.counts(_ev(s, d), ["user_id", "event_type"]))
query("index_lookup", "with l as (select user_id, string_agg(event_id::varchar, ',' order by event_id) as x from events group by 1) select c_custkey as user_id, coalesce(x, '') as x from customer left join l on user_id = c_custkey")(
    lambda s, d: index.lookup(_ev(s, d), "user_id", _t(s, d, "customer").select(F.col("c_custkey").alias("user_id")), "event_id").select("user_id", F.array_join("indices", ",").alias("x"))
)
query("index_first", "with l as (select user_id, min(event_id) as x from events group by 1) select c_custkey as user_id, coalesce(x, -1) as first from customer left join l on user_id = c_custkey")(
    lambda s, d: index.first_of(_ev(s, d), "user_id", _t(s, d, "customer").select(F.col("c_custkey").alias("user_id")), "event_id")
)
query("index_matching", "select event_id from events where user_id in (select c_custkey from customer where c_nationkey = 1)")(
    lambda s, d: index.matching(_ev(s, d), "user_id", _t(s, d, "customer").filter("c_nationkey = 1").select(F.col("c_custkey").alias("user_id"))).select("event_id")
)
query("deduplicate_first", "select event_id, user_id, event_type, value from events qualify row_number() over (partition by user_id, event_type order by event_id) = 1")(
    lambda s, d: index.deduplicate(_ev(s, d), ["user_id", "event_type"], "first", "event_id")
)
query("deduplicate_last", "select event_id, user_id, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1")(lambda s, d: index.deduplicate(_ev(s, d), "user_id", "last", "event_id"))
query("argsort", "select event_id from events order by value desc nulls last, event_id limit 50")(lambda s, d: index.argsort(_ev(s, d), "value", 50, True, "event_id").select("event_id"))
query("bisect", "select distinct p_retailprice as x, (select count(*) from customer where c_acctbal < p_retailprice) as at from part")(
    lambda s, d: index.bisect_left(_t(s, d, "customer").select(F.col("c_acctbal").alias("v")), _t(s, d, "part").select(F.col("p_retailprice").alias("x")).distinct())
)
query("column_quantiles", "with c as (select l_quantity as x, count(*) as n from lineitem group by 1), k as (select x, n, sum(n) over (order by x) as run, sum(n) over () as t from c) select least(floor((run - 1) * 5 / t), 4)::int as bin, max(x) as value from k group by 1")(
    lambda s, d: index.column_quantiles(_t(s, d, "lineitem"), "l_quantity", 5)
)

# -- more of the same families ------------------------------------------------

query("idiv", f"{_FULL}, n as (select r, c, x / sum(x) over () as x, y / sum(y) over () as y from j) select round(sum(case when x > 0 then x * ln(x / greatest(y, 1e-11)) else 0 end), 6) as v from n")(
    lambda s, d: _halves(s, d)[0].normalize(None).divergence(_halves(s, d)[1].normalize(None), kl=False).select(F.round("v", 6).alias("v"))
)
query("gram_quantiles", f"with {M1}, n as (select c, sqrt(sum(v * v)) as n from m1 group by c), g as (select abs(sum(a.v * b.v) / any_value(x.n * y.n)) as v from m1 a join m1 b on a.r = b.r join n x on x.c = a.c join n y on y.c = b.c where a.c < b.c group by a.c, b.c), k as (select v, row_number() over (order by v) as k, count(*) over () as n from g), a as (select *, 0.4 + 0.3 * (n + 0.2) as spot from k) select round(sum(v * case when k = floor(spot) then 1 - (spot - floor(spot)) when k = floor(spot) + 1 then spot - floor(spot) else 0 end), 6) as v from a")(
    lambda s, d: m1(s, d).gram_quantiles(0.3).select(F.round("v", 6).alias("v"))
)
query("default_row", f"{_WIDE} select c as label, round(sum(v) / any_value(h), 6) as v from m3, h group by c")(lambda s, d: line(m3(s, d).default_row()))
query("take", f"with {M4}, p as (select r, row_number() over (order by r) - 1 as n from (select distinct r from m4)) select t.k as r, m4.c, v from (select * from (values (0, 4), (1, 0), (2, 4)) t(k, n)) t join p on p.n = t.n join m4 on m4.r = p.r")(
    lambda s, d: flat(m4(s, d).take(ROWS, [4, 0, 4]))
)
query("extend", "select o_orderpriority as label from orders union select c_mktsegment from customer")(lambda s, d: m4(s, d).extend(rows=_t(s, d, "customer").select("c_mktsegment")).rows.select("label"))
query("truncate_grid", f"with {M1}, g as (select u.r, t.c, coalesce(v, 0) - 8 * (m.v is not null)::int as v from (select distinct r from m1) u cross join (select distinct c from m1) t left join m1 m on m.r = u.r and m.c = t.c) select r, c, v::double as v from g qualify row_number() over (partition by r order by v desc, c) <= 3 and v <> 0")(
    lambda s, d: flat(m1(s, d).map_cells(lambda v: v - 8).truncate_by_count(3, ROWS, whole_grid=True))
)
query("group_rows_first", f"with {M3}, f as (select l_partkey % 10 as g, min(l_partkey) as r from lineitem group by 1) select g as r, c, v from m3 join f using (r)")(
    lambda s, d: flat(m3(s, d).group_rows(m3(s, d).rows.select("label", (F.col("label") % 10).alias("g")), "first"))
)
query("stream_occurrence", f"with {M1} select r, c, v from m1")(lambda s, d: _streamed(s, d))


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """The occurrence matrix as a stream over the events has it once all files are read."""
    import uuid

    from axisweave.functions.checkpoints import folder
    from axisweave.streaming.occurrence import occurrence_stream

    name = f"occurrence_{uuid.uuid4().hex}"
    # as a pattern, because a stream takes the path of a single file for a folder
    events = s.readStream.schema(_t(s, d, "events").schema).parquet(f"{d}/events.parque[t]")
    stream = occurrence_stream(events, "user_id", "event_type").writeStream.format("memory").queryName(name).outputMode("complete")
    stream.option("checkpointLocation", f"{folder(s)}/{name}").trigger(availableNow=True).start().awaitTermination()
    return s.table(name)


# -- what SQL cannot say: hashes, graphs, learners (checked in tests) ---------

query("hash_string")(lambda s, d: _t(s, d, "customer").select("c_custkey", hashing.hash_string(F.col("c_name"), 1234).alias("h")))
query("random_group")(lambda s, d: _t(s, d, "customer").select("c_custkey", hashing.random_group(F.col("c_name"), (1, 1, 2), 7).alias("g")))
query("increments")(lambda s, d: hashing.increments(_t(s, d, "customer"), "c_name", "c_nationkey", ["c_acctbal"], [1, 2], (80, 20)))


def _edges(s, d):
    """Customers to their nations, nations to their regions."""
    c = _t(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("n"), "c_nationkey").alias("b"))
    return c.unionByName(_t(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b")))


query("components", "with x as (select 'c' || c_custkey as id, n_regionkey as g from customer join nation on c_nationkey = n_nationkey union all select 'n' || n_nationkey, n_regionkey from nation union all select distinct 'r' || n_regionkey, n_regionkey from nation) select id, min(id) over (partition by g) as component from x")(
    lambda s, d: components(_edges(s, d))
)
query("strong_components")(lambda s, d: strong_components(_t(s, d, "nation").select((F.col("n_nationkey") % 7).alias("a"), ((F.col("n_nationkey") * 3 + 1) % 7).alias("b"))))
query("ward")(lambda s, d: flat(m1(s, d).hierarchical_clustering(None, 4)))
query("tail_clustering")(lambda s, d: flat(m1(s, d).tail_clustering(m1(s, d).sum(), 5)))
query("affinity")(lambda s, d: flat(m1(s, d).transpose().dot(m1(s, d)).affinity_clusters("median", 50)))
query("spectral")(lambda s, d: flat(m1(s, d).second_moment().spectral_clusters(2)))
query("co_clustering")(lambda s, d: flat(m1(s, d).co_clustering((3, 2), preruns=5)[0]))
query("svd")(lambda s, d: flat(m1(s, d).svd(2)[0], 4))
query("svd_approximation")(lambda s, d: flat(m1(s, d).svd_approximation(2), 4))
query("nmf")(lambda s, d: flat(m1(s, d).nmf(2, 5)[1], 6))
query("nmf_fold")(lambda s, d: flat(m1(s, d).nmf_fold(m1(s, d).nmf(2, 3)[1], 10), 6))
query("sample_rows")(lambda s, d: flat(m3(s, d).sample_labels(ROWS, 50, 3)))
