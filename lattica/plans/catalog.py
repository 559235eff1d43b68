"""Queries over the relational tables, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import columns as C
from lattica.operators import diff, graph, ranking, view
from lattica.plans import fills, registry, report
from lattica.plans.book import Book
from lattica.sources import workbook

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: Rows that tell a table's order; lineitem has no shorter key.
_ORDER = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "documents": ["doc_id"], "labels": ["doc_id"]}


def query(sql: str):
    """Register the function as a query that must agree with the SQL."""

    def add(f):
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def book(spark: SparkSession, sf_dir: str, *tables: str) -> Book:
    out = Book(spark)
    for name in tables:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        out.bind(name, df, _ORDER.get(name, df.columns))
    return out


def _rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """Doubles rounded, error columns dropped."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if not c.endswith("_err")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of each part by a fill, with the part's brand looked up."""
    b = book(spark, sf_dir, "lineitem", "part")
    b.fill("lineitem", "rev", "=[@l_extendedprice]*(1-[@l_discount])")
    b.fill("lineitem", "brand", "=INDEX(part[p_brand],MATCH([@l_partkey],part[p_partkey],0))")
    rows = b.table("lineitem", brand="brand", brand_err="brand", rev="rev")
    return rows.groupBy("brand", "brand_err").agg(F.round(F.sum("rev"), 2).alias("revenue"), F.count("*").alias("n_rows"))


@query("""
    select round(sum(l_extendedprice), 2) as total, round(avg(l_quantity), 2) as mean, min(l_extendedprice) as least, max(l_extendedprice) as most,
           count(l_tax)::double as n, count(l_returnflag)::double as n_filled from lineitem""")
def table_column_agg(spark, d):
    return _rounded(
        book(spark, d, "lineitem").scalars(
            total="=SUM(lineitem[l_extendedprice])", mean="=AVERAGE(lineitem[l_quantity])", least="=MIN(lineitem[l_extendedprice])", most="=MAX(lineitem[l_extendedprice])",
            n="=COUNT(lineitem[l_tax])", n_filled="=COUNTA(lineitem[l_returnflag])",
        )
    )


@query("select l_orderkey::double as k, l_linenumber::double as line, l_extendedprice * (1 - l_discount) as rev from lineitem")
def fill_revenue(spark, d):
    b = book(spark, d, "lineitem")
    b.fill("lineitem", "rev", "=[@l_extendedprice]*(1-[@l_discount])")
    return b.table("lineitem", k="l_orderkey", line="l_linenumber", rev="rev")


@query("select round(sum(l_extendedprice * (1 - l_discount)), 2) as total from lineitem")
def fill_then_sum(spark, d):
    b = book(spark, d, "lineitem")
    b.fill("lineitem", "rev", "=[@l_extendedprice]*(1-[@l_discount])")
    return _rounded(b.scalars(total="=SUM(lineitem[rev])"))


@query("""
    with a as (select *, l_extendedprice * (1 - l_discount) as rev from lineitem), b as (select *, rev * (1 + l_tax) as charge from a)
    select l_orderkey::double as k, charge - rev as tax_paid from b""")
def fill_chain_three_levels(spark, d):
    b = book(spark, d, "lineitem")
    b.fill("lineitem", "rev", "=[@l_extendedprice]*(1-[@l_discount])")
    b.fill("lineitem", "charge", "=[@rev]*(1+[@l_tax])")
    b.fill("lineitem", "tax", "=[@charge]-[@rev]")
    return b.table("lineitem", k="l_orderkey", tax_paid="tax")


@query("""
    select c_custkey::double as k, case when c_nationkey = 5 then null else c_acctbal / (c_nationkey - 5) end as q, case when c_nationkey = 5 then '#DIV/0!' end as q_err,
           case when c_nationkey = 5 then null when c_nationkey < 5 then null else round(pow(c_nationkey - 5, 0.5), 9) end as p,
           case when c_nationkey < 5 then '#NUM!' when c_nationkey = 5 then null end as p_err
    from customer where c_nationkey <> 5
    union all select c_custkey, null, '#DIV/0!', 0.0, null from customer where c_nationkey = 5""")
def arith_error_values(spark, d):
    b = book(spark, d, "customer")
    b.fill("customer", "q", "=[@c_acctbal]/([@c_nationkey]-5)")
    b.fill("customer", "p", "=([@c_nationkey]-5)^0.5")
    out = b.table("customer", k="c_custkey", q="q", q_err="q", p="p", p_err="p")
    return out.withColumn("p", F.round("p", 9))


@query("""
    select c_custkey::double as k, c_acctbal >= 0 as ge, c_name = 'x' as eq, false as cross_eq, '#VALUE!' as cross_lt_err,
           c_mktsegment < 'C' as text_lt from customer""")
def comparison_ops(spark, d):
    b = book(spark, d, "customer")
    for name, f in (("ge", "=[@c_acctbal]>=0"), ("eq", '=[@c_name]="x"'), ("cross", "=[@c_name]=[@c_custkey]"), ("lt", "=[@c_name]<[@c_custkey]"), ("tlt", '=[@c_mktsegment]<"C"')):
        b.fill("customer", name, f)
    return b.table("customer", k="c_custkey", ge="ge", eq="eq", cross_eq="cross", cross_lt_err="lt", text_lt="tlt")


@query("select n_name || '-' || n_nationkey || '/TRUE' as s from nation")
def concat_op(spark, d):
    b = book(spark, d, "nation")
    b.fill("nation", "s", '=[@n_name]&"-"&[@n_nationkey]&"/"&TRUE')
    return b.table("nation", s="s")


@query("""
    select c_custkey::double as k, case when c_acctbal >= 5000 and c_nationkey <> 3 then 'A' when c_acctbal < 0 or c_nationkey = 3 then 'C' else 'B' end as grade,
           not (c_acctbal > 0) as down from customer""")
def logic_if_and_or_not(spark, d):
    b = book(spark, d, "customer")
    b.fill("customer", "g", '=IF(AND([@c_acctbal]>=5000,[@c_nationkey]<>3),"A",IF(OR([@c_acctbal]<0,[@c_nationkey]=3),"C","B"))')
    b.fill("customer", "n", "=NOT([@c_acctbal]>0)")
    return b.table("customer", k="c_custkey", grade="g", down="n")


@query("select c_custkey::double as k, case when c_nationkey = 5 then -1.0 else c_acctbal / (c_nationkey - 5) end as q from customer")
def iferror_guard(spark, d):
    b = book(spark, d, "customer")
    b.fill("customer", "q", "=IFERROR([@c_acctbal]/([@c_nationkey]-5),-1)")
    return b.table("customer", k="c_custkey", q="q")


@query("""
    select l_quantity as q, round(l_quantity * 0.3331, 1) as r, ceil(l_quantity * 0.3331 * 10) / 10 as up, floor(l_quantity * 0.3331 * 10) / 10 as down,
           round(l_quantity * 37.31 / 10) * 10 as tens from (select distinct l_quantity from lineitem)""")
def round_family(spark, d):
    """Fills over every row; the SQL has each quantity once, so equal results are then united."""
    b = book(spark, d, "lineitem")
    for name, f in (("r", "ROUND([@l_quantity]*0.3331,1)"), ("u", "ROUNDUP([@l_quantity]*0.3331,1)"), ("v", "ROUNDDOWN([@l_quantity]*0.3331,1)"), ("t", "ROUND([@l_quantity]*37.31,-1)")):
        b.fill("lineitem", name, "=" + f)
    return b.table("lineitem", q="l_quantity", r="r", up="u", down="v", tens="t").distinct()


@query("select c_custkey::double as k, floor(c_acctbal) as whole, c_acctbal - (-7.0) * floor(c_acctbal / (-7.0)) as rest, abs(c_acctbal) as size from customer")
def int_mod_abs(spark, d):
    b = book(spark, d, "customer")
    b.fill("customer", "i", "=INT([@c_acctbal])")
    b.fill("customer", "m", "=MOD([@c_acctbal],-7)")
    b.fill("customer", "a", "=ABS([@c_acctbal])")
    return b.table("customer", k="c_custkey", whole="i", rest="m", size="a")


@query("""
    select p_partkey::double as k, left(p_name, 4) as l, right(p_name, 3) as r, substring(p_name, 3, 5) as m, length(p_name)::double as n,
           substring(p_name, 900, 2) as beyond from part""")
def text_left_right_mid_len(spark, d):
    b = book(spark, d, "part")
    for name, f in (("l", "LEFT([@p_name],4)"), ("r", "RIGHT([@p_name],3)"), ("m", "MID([@p_name],3,5)"), ("n", "LEN([@p_name])"), ("b", "MID([@p_name],900,2)")):
        b.fill("part", name, "=" + f)
    return b.table("part", k="p_partkey", l="l", r="r", m="m", n="n", beyond="b")


@query("""
    select doc_id::double as k, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
           translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') as up from documents""")
def text_lower_upper_ascii(spark, d):
    b = book(spark, d, "documents")
    b.fill("documents", "l", "=LOWER([@text])")
    b.fill("documents", "u", "=UPPER([@text])")
    return b.table("documents", k="doc_id", low="l", up="u")


@query("select doc_id::double as k, regexp_replace(trim('  ' || text || ' ', ' '), ' +', ' ', 'g') as s from documents")
def text_trim_collapse(spark, d):
    b = book(spark, d, "documents")
    b.fill("documents", "s", '=TRIM("  "&[@text]&" ")')
    return b.table("documents", k="doc_id", s="s")


@query("select string_agg(r_name, '' order by r_regionkey) || '.' as s from region")
def concat_range(spark, d):
    return book(spark, d, "region").scalars(s='=CONCAT(region[r_name],".")').select("s")


@query("""
    with c as (select c_custkey, row_number() over (order by c_custkey) as pos from customer)
    select o_orderkey::double as k, pos::double as place, case when pos is null then '#N/A' end as place_err from orders left join c on c_custkey = o_custkey""")
def match_exact(spark, d):
    b = book(spark, d, "orders", "customer")
    b.fill("orders", "m", "=MATCH([@o_custkey],customer[c_custkey],0)")
    return b.table("orders", k="o_orderkey", place="m", place_err="m")


@query("""
    with l as (select doc_id, arg_min(quality, doc_id) as quality from labels group by doc_id)
    select d.doc_id::double as k, quality::double as quality, case when l.doc_id is null then '#N/A' end as quality_err from documents d left join l using (doc_id)""")
def index_match_lookup(spark, d):
    b = book(spark, d, "documents", "labels")
    b.fill("documents", "q", "=INDEX(labels[quality],MATCH([@doc_id],labels[doc_id],0))")
    return b.table("documents", k="doc_id", quality="q", quality_err="q")


@query("select max(case when pos = 3 then n_name end) as name, '#REF!' as beyond_err from (select n_name, row_number() over (order by n_nationkey) as pos from nation)")
def index_2d(spark, d):
    return book(spark, d, "nation").scalars(name="=INDEX(nation[#Data],3,2)", beyond="=INDEX(nation[#Data],3,9)").select("name", "beyond_err")


@query("select o_orderkey::double as k, year(o_orderdate)::double as y, month(o_orderdate)::double as m, day(o_orderdate)::double as dd from orders")
def date_parts(spark, d):
    b = book(spark, d, "orders")
    for name in ("YEAR", "MONTH", "DAY"):
        b.fill("orders", name, f"={name}([@o_orderdate])")
    return b.table("orders", k="o_orderkey", y="YEAR", m="MONTH", dd="DAY")


@query("""
    with t as (select n_nationkey, try_cast('2023-' || lpad(n_nationkey::varchar, 2, '0') || '-30' as date) as day from nation)
    select n_nationkey::double as k, day::varchar as day, case when day is null then '#NUM!' end as day_err from t""")
def date_build(spark, d):
    b = book(spark, d, "nation")
    b.fill("nation", "day", "=DATE(2023,[@n_nationkey],30)")
    return b.table("nation", k="n_nationkey", day="day", day_err="day").withColumn("day", F.col("day").cast("string"))


@query("""
    select c_custkey::double as k, c_nationkey = 5 as err, c_nationkey <> 5 as num, true as txt, false as blank from customer""")
def inspect_kinds(spark, d):
    b = book(spark, d, "customer")
    b.fill("customer", "x", "=[@c_acctbal]/([@c_nationkey]-5)")
    for name, f in (("e", "ISERROR([@x])"), ("n", "ISNUMBER([@x])"), ("t", "ISTEXT([@c_name])"), ("b", "ISBLANK([@c_name])")):
        b.fill("customer", name, "=" + f)
    return b.table("customer", k="c_custkey", err="e", num="n", txt="t", blank="b")


_FIELDS = ["", "'", "'12", "12", "-0.5", "00123", " 1", "1e3", "Infinity", "1d", "true", "TRUE", "#N/A", "2026-02-28", "2026-02-30", "plain", "1.", "-"]


@query(
    "with t(f) as (values " + ", ".join("('" + f.replace("'", "''") + "')" for f in _FIELDS) + r""")
    select f, case when f = '' then 'blank' when f like '''%' then 'text' when f in ('#DIV/0!', '#N/A', '#NAME?', '#NUM!', '#REF!', '#VALUE!', '#CIRC!') then 'error'
                   when f in ('true', 'false') then 'boolean' when regexp_full_match(f, '-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?') then 'number'
                   when regexp_full_match(f, '\d{4}-\d{2}-\d{2}') and try_cast(f as date) is not null then 'date' else 'text' end as kind from t"""
)
def scalar_inference(spark, d):
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, _FIELDS))).alias("f"))
    v = C.infer(F.col("f"))
    return rows.select("f", F.when(v.err.isNotNull(), "error").otherwise(v.kind).alias("kind"))


@query("select 3.0::double as n, 'r_regionkey' as first from (select 1)")
def headers_region(spark, d):
    return book(spark, d, "nation", "region").scalars(n="=COUNTA(nation[#Headers])", first="=INDEX(region[#Headers],1)").select("n", "first")


@query("select round(sum(p_retailprice), 2) as total, max(p_size)::double as most from part")
def named_range_resolve(spark, d):
    b = book(spark, d, "part")
    b.name("prices", "part[p_retailprice]")
    b.name("sizes", "part[p_size]")
    return _rounded(b.scalars(total="=SUM(prices)", most="=MAX(sizes)"))


@query("select round((select sum(o_totalprice) from orders) / (select sum(c_acctbal) from customer), 4) as ratio from (select 1)")
def cross_table_scalar(spark, d):
    return _rounded(book(spark, d, "orders", "customer").scalars(ratio="=SUM(orders[o_totalprice])/SUM(customer[c_acctbal])"), 4)


@query("""
    with t as (select o_orderkey, o_totalprice, lag(o_totalprice) over (order by o_orderkey) as before from orders)
    select o_orderkey::double as k, o_totalprice - before as step, case when before is null then '#VALUE!' end as step_err from t""")
def relative_fill_lag(spark, d):
    b = Book(spark)
    b.bind("t", spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    fills.fill_down(b, "t", "step", "=B2-B1")
    return b.table("t", k="o_orderkey", step="step", step_err="step")


@query("select o_orderkey::double as k, round(sum(o_totalprice) over (order by o_orderkey), 2) as total from orders")
def running_total_fill(spark, d):
    b = book(spark, d, "orders")
    fills.running_fill(b, "orders", "total", "o_totalprice")
    return _rounded(b.table("orders", k="o_orderkey", total="total"))


@query("select s_suppkey::double as k, s_acctbal - (select arg_min(s_acctbal, s_suppkey) from supplier) as over from supplier")
def absolute_mixed_refs(spark, d):
    b = Book(spark)
    b.bind("t", spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_acctbal"), ["s_suppkey"])
    fills.fill_down(b, "t", "over", "=$B2-B$2")
    return b.table("t", k="s_suppkey", over="over")


@query("""
    select 'n3' as node union all select 'c' || c_custkey from customer where c_nationkey = 3
    union all select 'o' || o_orderkey from orders join customer on c_custkey = o_custkey where c_nationkey = 3""")
def dirty_closure(spark, d):
    c, o = spark.read.parquet(f"{d}/customer.parquet"), spark.read.parquet(f"{d}/orders.parquet")
    edges = c.select(F.concat(F.lit("c"), "c_custkey").alias("dst"), F.concat(F.lit("n"), "c_nationkey").alias("src"))
    edges = edges.unionByName(o.select(F.concat(F.lit("o"), "o_orderkey").alias("dst"), F.concat(F.lit("c"), "o_custkey").alias("src")))
    return graph.closure(edges, spark.range(1).select(F.lit("n3").alias("node")))


def _edges(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(a).alias("dst"), F.lit(b).alias("src")) for a, b in pairs))).alias("e")).select("e.*")


_DAG = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("e", "a"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s"), ("f", "g")]
_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in _DAG)


@query(f"""
    with recursive e(dst, src) as (values {_PAIRS}), n(node) as (select dst from e union select src from e),
    reach(dst, src) as (select dst, src from e union select r.dst, e.src from reach r join e on e.dst = r.src),
    bad as (select dst as node from reach where src in (select dst from reach where dst = src)),
    depth(node, level) as (select node, 0::bigint from n where node not in (select dst from e) union select e.dst, depth.level + 1 from depth join e on e.src = depth.node where e.dst not in (select node from bad))
    select n.node, coalesce(max(level), -1)::bigint as level from n left join depth using (node) group by n.node""")
def eval_levels(spark, d):
    edges = _edges(spark, _DAG)
    nodes = edges.select(F.col("dst").alias("node")).unionByName(edges.select(F.col("src").alias("node")))
    return graph.levels(edges, nodes).withColumn("level", F.coalesce("level", F.lit(-1).cast("long")))  # in or behind a cycle


@query(f"""
    with recursive e(dst, src) as (values {_PAIRS}), reach(dst, src) as (select dst, src from e union select r.dst, e.src from reach r join e on e.dst = r.src)
    select a.dst as node, min(a.src) as scc from reach a join reach b on a.dst = b.src and a.src = b.dst group by a.dst""")
def scc_cycles(spark, d):
    return graph.components(_edges(spark, _DAG))


@query("select round(sum(case when s_nationkey < 5 then 100.0 else s_acctbal end), 2) as total from supplier")
def apply_override(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    changes = s.where("s_nationkey < 5").select("s_suppkey", F.lit(100.0).alias("value"))
    b = Book(spark)
    b.bind("t", diff.override(s, changes, "s_suppkey", "s_acctbal"))
    return _rounded(b.scalars(total="=SUM(t[s_acctbal])"))


_CELLS = ["p_name", "p_brand", "p_type"]
_CELLS_SQL = "select p_partkey as row, 1::bigint as col, p_name as txt from part union all select p_partkey, 2, p_brand from part union all select p_partkey, 3, p_type from part"


def _part_cells(spark: SparkSession, d: str) -> DataFrame:
    return view.cells(spark.read.parquet(f"{d}/part.parquet"), F.col("p_partkey"), _CELLS)


@query(f"select * from ({_CELLS_SQL}) where row between 10 and 60 and col between 2 and 3")
def viewport_rectangle(spark, d):
    return view.viewport(_part_cells(spark, d), 10, 2, 60, 3)


_APPLIES = [(1, 1, 50, 3, 1, "red", None), (20, 2, 2000, 2, 2, None, "true"), (30, 1, 40, 3, 3, "blue", "false"), (35, 3, 35, 3, 4, None, "true")]
_APPLIES_SQL = "(values " + ", ".join("(" + ", ".join("null" if v is None else repr(v) for v in a) + ")" for a in _APPLIES) + ") a(r0, c0, r1, c1, source_order, fill, bold)"


@query(f"""
    select p.row, p.col, arg_max(fill, case when fill is not null then source_order end) filter (fill is not null) as fill,
           arg_max(bold, case when bold is not null then source_order end) filter (bold is not null) as bold
    from ({_CELLS_SQL}) p join {_APPLIES_SQL} on p.row between r0 and r1 and p.col between c0 and c1 group by 1, 2""")
def style_precedence(spark, d):
    applies = spark.createDataFrame(_APPLIES, "r0 long, c0 long, r1 long, c1 long, source_order int, fill string, bold string")
    return view.styles(_part_cells(spark, d), applies, ["fill", "bold"])


_WIDTHS = [(1, 10, 64.0, 1), (5, 7, 100.0, 2), (7, 20, 80.0, 3), (30, 30, 64.0, 4), (31, 33, 64.0, 5)]


@query(
    "with i(first, last, size, source_order) as (values " + ", ".join(map(str, _WIDTHS)) + """),
    spots as (select unnest(range(1, 41)) as x), s as (select x, (select arg_max(size, source_order) from i where x between first and last) as size from spots)
    , r as (select x, size, x - row_number() over (partition by size order by x) as g from s where size is not null)
    select min(x)::bigint as first, max(x)::bigint as last, size::double as size from r group by size, g"""
)
def geometry_effective(spark, d):
    return view.geometry(spark.createDataFrame(_WIDTHS, "first long, last long, size double, source_order int"))


@query(f"""
    select source_order::bigint as k, greatest(r0, 25)::bigint as r0, greatest(c0, 2)::bigint as c0, least(r1, 34)::bigint as r1, least(c1, 9)::bigint as c1
    from {_APPLIES_SQL} where greatest(r0, 25) <= least(r1, 34) and greatest(c0, 2) <= least(c1, 9)""")
def style_regions_clip(spark, d):
    applies = spark.createDataFrame([(a[4], *a[:4]) for a in _APPLIES], "k long, r0 long, c0 long, r1 long, c1 long")
    return view.clip(applies, 25, 2, 34, 9)


@query("""
    select s_suppkey, case when s_suppkey % 10 = 1 then 'removed' else 'changed' end as change, s_acctbal as before, case when s_suppkey % 10 = 1 then null else s_acctbal + 1 end as after
    from supplier where s_suppkey % 10 in (1, 2) union all select -s_suppkey, 'added', null, s_acctbal from supplier where s_suppkey % 10 = 3 and s_suppkey > 0""")
def semantic_diff_cells(spark, d):
    before = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_acctbal")
    after = before.where("s_suppkey % 10 <> 1").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 10 == 2, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")))
    after = after.unionByName(before.where("s_suppkey % 10 = 3 and s_suppkey > 0").withColumn("s_suppkey", -F.col("s_suppkey")))
    return diff.rows(before, after, ["s_suppkey"], "s_acctbal")


@query("select * from (values ('b', 'relabelled'), ('b', 'moved'), ('c', 'moved'), ('a', 'removed'), ('d', 'added')) t(sheet, change)")
def diff_sheet_membership(spark, d):
    before = spark.createDataFrame([("a", 1, "A"), ("b", 2, "B"), ("c", 3, "C")], "sheet string, o int, label string")
    after = spark.createDataFrame([("c", 1, "C"), ("b", 3, "Bee"), ("d", 2, "D")], "sheet string, o int, label string")
    return diff.membership(before, after, "sheet", "o", "label")


@query("select r_regionkey, r_name from region union all select 99, 'NOWHERE'")
def append_row(spark, d):
    """region as a workbook's table; the row is appended by an edit of the text, and the table read back."""
    lines = F.array_sort(F.collect_list(F.concat(F.lpad(F.col("r_regionkey").cast("string"), 3, " "), F.lit(',"'), "r_name", F.lit('"'))))  # five regions
    source = F.concat(F.lit('#!lattica 0.1\n@sheet s "S"\n@table region A1 csv\nkey,name\n'), F.array_join(F.transform(lines, lambda x: F.ltrim(x)), "\n"), F.lit("\n@end\n"))
    text = spark.read.parquet(f"{d}/region.parquet").agg(source.alias("source"))
    cells = workbook.cells(text.select(F.lit(0).alias("key"), workbook.edited(F.col("source"), "append_row", "region", [99.0, "NOWHERE"]).alias("source")))
    rows = cells.where("row > 1").groupBy("row").agg(F.max("num").cast("int").alias("r_regionkey"), F.max("txt").alias("r_name"))
    return rows.drop("row")


@query(f"select (row + case when row between 5 and 9 and col between 2 and 3 then 100000 else 0 end)::bigint as row, (col + case when row between 5 and 9 and col between 2 and 3 then 7 else 0 end)::bigint as col, txt from ({_CELLS_SQL})")
def move_block(spark, d):
    return diff.move(_part_cells(spark, d), 100_000, 7, 5, 2, 9, 3).withColumns({c: F.col(c).cast("long") for c in ("row", "col")})


@query("""
    with f as (select p_partkey as id, 's' || (p_size % 3) as sheet, p_partkey * 7 % 500 as r0, p_partkey * 3 % 40 as c0, p_partkey * 7 % 500 + p_size % 4 as r1, p_partkey * 3 % 40 + 1 as c1 from part)
    select a.id as a, b.id as b from f a join f b on a.sheet = b.sheet and a.id < b.id and a.r0 <= b.r1 and b.r0 <= a.r1 and a.c0 <= b.c1 and b.c0 <= a.c1""")
def footprint_overlap(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    r0, c0 = F.col("p_partkey") * 7 % 500, F.col("p_partkey") * 3 % 40
    return view.overlaps(p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("s"), F.col("p_size") % 3).alias("sheet"), r0.alias("r0"), c0.alias("c0"), (r0 + F.col("p_size") % 4).alias("r1"), (c0 + 1).alias("c1")))


@query("select o_orderkey::double as k, round(sum(o_totalprice) over (order by o_orderkey), 2) as total, round(sum(o_totalprice) over (order by o_orderkey), 2) as grown, round(o_totalprice + coalesce(lag(o_totalprice) over (order by o_orderkey), 0), 2) as two from orders")
def running_total_a1(spark, d):
    """Three templates in A1 references: own cell above, a growing range, a sliding range."""
    b = Book(spark)
    b.bind("t", spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    for name, f in (("total", "=C1+B2"), ("grown", "=SUM(B$2:B2)"), ("two", "=SUM(B1:B2)")):
        fills.fill_down(b, "t", name, f)
    return _rounded(b.table("t", k="o_orderkey", total="total", grown="grown", two="two"))


def _workbooks(spark: SparkSession, d: str) -> DataFrame:
    """nation as workbook texts, one for each region: key, source."""
    n = spark.read.parquet(f"{d}/nation.parquet")
    rows = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))  # a region's nations
    body = F.array_join(F.transform("rows", lambda r: F.concat(r["n_nationkey"].cast("string"), F.lit(',"'), r["n_name"], F.lit('",'))), "\n")
    head = '#!lattica 0.1\n# kept\n@style big bold=true\n@name first = s!A2\n@sheet s "Nations"\n@table t A1 csv\nkey,name,twice\n'
    tail = '\n@end\n@fill t[twice] =[@key]*2\n@apply t[name] big\n@column A:B width=12.5\n@sheet u "Sums"\n@block A1 csv\n=SUM(t[twice]),=first,=s!B2,=1/0,2026-02-28,true\n@end\n'
    return rows.select(F.col("n_regionkey").cast("long").alias("key"), F.concat(F.lit(head), body, F.lit(tail)).alias("source"))


@query("""
    with r as (select *, row_number() over (partition by n_regionkey order by n_nationkey) + 1 as row from nation),
    f as (select n_regionkey, arg_min(n_nationkey, n_nationkey) as k, arg_min(n_name, n_nationkey) as n, sum(n_nationkey) * 2 as s from nation group by 1)
    select n_regionkey::bigint as key, 's' as sheet, row, 3::bigint as col, 'number' as kind, (2 * n_nationkey)::double as num, null::varchar as txt from r
    union all select n_regionkey, 'u', 1, 1, 'number', s::double, null from f union all select n_regionkey, 'u', 1, 2, 'number', k::double, null from f
    union all select n_regionkey, 'u', 1, 3, 'text', null, n from f union all select n_regionkey, 'u', 1, 4, 'error', null, '#DIV/0!' from f""")
def workbook_calculated(spark, d):
    """Fills, names, cells of another sheet and aggregates, as calculated from workbook text."""
    cells = workbook.cells(_workbooks(spark, d), calculated=True)
    made = ((F.col("sheet") == "s") & (F.col("col") == 3) & (F.col("row") > 1)) | ((F.col("sheet") == "u") & (F.col("col") <= 4))
    return cells.where(made).select("key", "sheet", "row", "col", "kind", "num", F.coalesce("txt", "err").alias("txt"))


@query("""
    with r as (select *, row_number() over (partition by n_regionkey order by n_nationkey) + 1 as row from nation), g as (select distinct n_regionkey from nation)
    select n_regionkey::bigint as key, row, 1::bigint as col, 'number' as kind from r union all select n_regionkey, row, 2, 'text' from r union all select n_regionkey, row, 3, 'blank' from r
    union all select n_regionkey, 1, unnest([1, 2, 3]), 'text' from g""")
def workbook_authored(spark, d):
    """The kinds of the fields of a table as authored."""
    return workbook.cells(_workbooks(spark, d)).where("sheet = 's'").select("key", "row", "col", "kind")


@query("select distinct n_regionkey::bigint as key, true as same, true as stable, 7::bigint as n_lines_kept from nation")
def workbook_canonical(spark, d):
    """fmt: canonical text means the same, is its own canonical text and keeps comments and directives."""
    text = workbook.canonical_text(F.col("source"))
    rows = _workbooks(spark, d).withColumn("canon", text).withColumn("again", workbook.canonical_text(F.col("canon")))
    kept = F.size(F.filter(F.split("canon", "\n"), lambda x: x.rlike("^(# kept|@style|@name|@sheet|@fill|@column)")))
    means = lambda c: workbook.cells(rows.select("key", F.col(c).alias("source")), calculated=True)
    other = means("source").exceptAll(means("canon")).unionByName(means("canon").exceptAll(means("source"))).select("key").distinct()
    rows = rows.join(other.withColumn("differs", F.lit(True)), "key", "left")
    return rows.select("key", F.col("differs").isNull().alias("same"), (F.col("canon") == F.col("again")).alias("stable"), kept.cast("long").alias("n_lines_kept"))


@query("""
    select n_regionkey::bigint as key, code from (select distinct n_regionkey from nation), (values (0, 'MS1001'), (1, 'MS1101'), (2, 'MS2101'), (2, 'MS2102'), (3, 'MS1302'), (3, 'MS2101'), (4, 'MS2202')) t(k, code) where k = n_regionkey""")
def workbook_diagnostics(spark, d):
    """Each region's workbook is spoilt in another way."""
    s, k = F.col("source"), F.col("key")
    bad = F.when(k == 0, F.replace(s, F.lit("0.1"), F.lit("0.2"))).when(k == 1, F.replace(s, F.lit("@column"), F.lit("@colum")))
    bad = bad.when(k == 2, F.replace(F.replace(s, F.lit("= s!A2"), F.lit("= z!A2")), F.lit("] big"), F.lit("] tall")))
    bad = bad.when(k == 3, F.replace(F.replace(s, F.lit("@name first = s!A2"), F.lit("@name first = z!A2")), F.lit("@sheet u"), F.lit("@block B2 csv\nx\n@end\n@sheet u"))).otherwise(F.replace(s, F.lit("=SUM("), F.lit("=SUM((")))
    return workbook.diagnostics(_workbooks(spark, d).select("key", bad.alias("source"))).select("key", "code").distinct()


@query("""
    with r as (select n_regionkey, n_nationkey, n_name from nation union all select r_regionkey, 99, 'NO,WHERE' from region)
    select n_regionkey::bigint as key, n_nationkey::double as num, case when n_nationkey = 99 then 'NO,WHERE' else n_name end as txt from r""")
def workbook_append_row(spark, d):
    """A row appended to each workbook's table by an edit of its text, then read back."""
    grown = _workbooks(spark, d).select("key", workbook.edited(F.col("source"), "append_row", "t", [99.0, "NO,WHERE", None]).alias("source"))
    cells = workbook.cells(grown).where("sheet = 's' and row > 1")
    return cells.groupBy("key", "row").agg(F.max("num").alias("num"), F.max(F.when(F.col("col") == 2, F.col("txt"))).alias("txt")).drop("row")


@query("""
    select s_suppkey, 'MS3201' as code, case when s_acctbal >= 0 then 's_nationkey <= 20' else 's_acctbal >= 0' end as failed from supplier where s_acctbal < 0 and s_nationkey <= 20
    union all select s_suppkey, 'MS3201', 's_nationkey <= 20' from supplier where s_nationkey > 20
    union all select s_suppkey, 'MS3201', 's_acctbal >= 0' from supplier where s_nationkey > 20 and s_acctbal < 0""")
def assertions_report(spark, d):
    b = book(spark, d, "supplier")
    return report.assertions(b, "supplier", "s_suppkey", [("s_acctbal", ">=", 0.0), ("s_nationkey", "<=", 20.0)])


@query("""
    select p_brand as feature, case when max(p_size) > 49 then 'unsupported' when max(p_size) > 48 then 'lossy' else 'lossless' end as fidelity, count(*) as n from part group by p_brand""")
def fidelity_report(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    outcome = F.when(F.col("p_size") > 49, "omitted").when(F.col("p_size") > 48, "approximated").otherwise("preserved")
    return report.fidelity(p.select(F.col("p_brand").alias("feature"), outcome.alias("outcome")))


@query(r"""
    with t as (select doc_id, case when regexp_matches(text, '^\s*[=+\-@]') then '''' || text else text end as s from documents)
    select doc_id, case when regexp_matches(s, '[,"\r\n]') then '"' || replace(s, '"', '""') || '"' else s end as field from t""")
def csv_spelling(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet")
    return t.select("doc_id", report.csv_field(report.neutral(F.col("text"))).alias("field"))


@query("select n_name, row_number() over (order by n_nationkey) as pos from nation")
def row_positions(spark, d):
    return ranking.positions(spark.read.parquet(f"{d}/nation.parquet"), ["n_nationkey"], "pos").select("n_name", "pos")


@query("""
    select o_orderkey, case when o_orderkey % 4 = 3 then case when o_orderkey % 27 < 24 and try_cast(f[:10] as date) is not null and z = 'Z' then 'datetime' else 'invalid' end
                                 when try_cast(f as date) is not null then 'date' else 'invalid' end as kind
    from (select o_orderkey, z, case when o_orderkey % 4 = 3 then day || 'T' || lpad((o_orderkey % 27)::varchar, 2, '0') || ':30:00' || z else day end as f
          from (select o_orderkey, case when o_orderkey % 5 = 0 then '' else 'Z' end as z, '2023-' || lpad((1 + o_orderkey % 13)::varchar, 2, '0') || '-' || lpad((1 + o_orderkey % 31)::varchar, 2, '0') as day from orders))""")
def strict_scalars(spark, d):
    """Dates and datetimes made from order keys, some of which are none."""
    k, two = F.col("o_orderkey"), lambda c: F.lpad(c.cast("string"), 2, "0")
    day = F.concat(F.lit("2023-"), two(1 + k % 13), F.lit("-"), two(1 + k % 31))
    field = F.when(k % 4 == 3, F.concat(day, F.lit("T"), two(k % 27), F.lit(":30:00"), F.when(k % 5 == 0, "").otherwise("Z"))).otherwise(day)
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", workbook.strict_kinds(field).alias("kind"))


@query("""
    select n_regionkey::bigint as key, (2 * count(*) + 5)::bigint as nodes, (2 * count(*) + 2)::bigint as edges, 0::bigint as cyclic_cells, 0::bigint as cyclic_components, 0::bigint as dirty, (count(*) + 4)::bigint as evaluated
    from nation group by 1""")
def workbook_stats(spark, d):
    """Size of each workbook's graph, and the cells that one calculation evaluates."""
    return workbook.graph_stats(_workbooks(spark, d))


@query("""
    select n_regionkey::bigint as key, 'u!A1:F1' || chr(10) || (2 * sum(n_nationkey))::bigint || chr(9) || '|' || chr(9) || min(n_nationkey) || chr(9) || '|' || chr(9) || arg_min(n_name, n_nationkey)
           || chr(9) || '|' || chr(9) || '#DIV/0!' || chr(9) || '|' || chr(9) || '2026-02-28' || chr(9) || '|' || chr(9) || 'true' || chr(10) as shown from nation group by 1""")
def workbook_text(spark, d):
    """Calculated values as lines of text."""
    return _workbooks(spark, d).select("key", workbook.calculated_text(F.col("source"), "u!A1:F1").alias("shown"))


@query("""
    with g as (select n_regionkey::bigint as key, count(*) as n, 2 * sum(n_nationkey) as total, min(n_nationkey) as least from nation group by 1)
    select key, 'MS3201' as code, (n + 17)::bigint as line from g where total <= 100 union all select key, 'MS3201', n + 18 from g where least <> 0
    union all select key, 'MS3202', n + 20 from g union all select key, 'MS3201', n + 22 from g union all select key, 'MS3202', n + 24 from g""")
def workbook_assertions(spark, d):
    """Assertions in each workbook, some false, some malformed."""
    lines = ["assert A1 > 100", "assert B1 = 0", "assert Z9 = blank", "assert A1 >> 3", "assert D1 = #DIV/0!", "assert F1 < true", "# a comment", "assert s!A1 = 1"]
    source = F.replace(F.col("source"), F.lit("# kept"), F.lit("@use assertions@1"))
    source = F.concat(source, F.lit("\n".join(["@extension assertions@1", *lines, "@end", ""])))
    return registry.extension_diagnostics(_workbooks(spark, d).select("key", source.alias("source"))).select("key", "code", "line")


@query("""
    with b as (select n_regionkey::bigint as key, string_agg(n_nationkey || ',"' || n_name || '",', chr(10) order by n_nationkey) as body from nation group by 1),
    t as (select key, replace('#!lattica 0.1|# kept|@style big bold=true|@style red text-color="#ff0000"|@name first = s!B2|@sheet s "Nations"|@table t A1 csv|key,name,twice|', '|', chr(10)) || body
          || replace('|@end|@fill t[twice] =[@key]*2|@apply t[name] big|@apply A2 red big|@column A:B width=12.5|@column C width=20|@row 1:3 height=30.25|@sheet u "Sums"|@block A1 csv|=SUM(t[twice]),=first,=s!B2,=1/0,2026-02-28,true|@end|', '|', chr(10)) as source from b)
    select key, source from t""")
def workbook_declarations(spark, d):
    """A name's target, a style, its application and sizes, set by edits of the text; what is so already changes nothing."""
    source = F.col("source")
    for verb, *args in (
        ("set_name", "first", "s!B2"), ("define_style", "red", {"text-color": "#ff0000"}), ("define_style", "big", {"bold": True}), ("apply_style", "s", "A2", ["red", "big"]),
        ("set_width", "s", 3, 3, 20.0), ("set_width", "s", 1, 2, 12.5), ("set_height", "s", 1, 3, 30.25), ("set_height", "s", 2, 3, 30.25),
    ):
        source = workbook.edited(source, verb, *args)
    return _workbooks(spark, d).select("key", source.alias("source"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
