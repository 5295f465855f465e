"""Registered graph queries over the driver's tables, and their SQL forms."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..core.graph import numbered
from ..core.rng import draws, linksort_frame
from ..core.store import stored
from ..operators import algorithms as A
from ..operators import circuits as C
from ..operators import generators as G
from ..operators import tables as T
from ..operators import transforms as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sp(spark, sf_dir, flag):
    """Supplier-part arcs of lineitems with a return flag, len the quantity."""
    return table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").cast("long").alias("len"))


SP = "select l_suppkey as src, l_partkey as dst, cast(l_quantity as bigint) as len from lineitem where l_returnflag = '{}'"


def nation_flow(spark, sf_dir):
    """Nation to nation: quantity from suppliers to customers."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(s, l.l_suppkey == s.s_suppkey).join(c, o.o_custkey == c.c_custkey)
    return j.groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).agg(F.sum(F.col("l_quantity").cast("long")).alias("len"))


NF = """nf as (select cast(s_nationkey as bigint) as src, cast(c_nationkey as bigint) as dst, cast(sum(cast(l_quantity as bigint)) as bigint) as len
  from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join customer on o_custkey = c_custkey group by 1, 2)"""


@query(f"select src, dst, min(len) as len from ({SP.format('R')} union all {SP.format('N')}) group by src, dst")
def union_min(spark, sf_dir):
    return X.gunion(sp(spark, sf_dir, "R"), sp(spark, sf_dir, "N"))


@query(f"{SP.format('R')} union all {SP.format('N')}")
def union_multi(spark, sf_dir):
    return X.gunion(sp(spark, sf_dir, "R"), sp(spark, sf_dir, "N"), multi=True)


@query(f"""with a as (select src, dst, min(len) as len from ({SP.format('R')}) group by 1, 2), b as (select src, dst, min(len) as len from ({SP.format('A')}) group by 1, 2)
select a.src, a.dst, greatest(a.len, b.len) as len from a join b on a.src = b.src and a.dst = b.dst""")
def intersect_max(spark, sf_dir):
    return X.intersection(sp(spark, sf_dir, "R"), sp(spark, sf_dir, "A"))


@query(f"""with a as (select src, dst, min(len) as la, count(*) as na from ({SP.format('R')}) group by 1, 2),
b as (select *, row_number() over (partition by src, dst order by len) as nth from ({SP.format('A')}))
select a.src, a.dst, greatest(b.len, a.la) as len from a join b on a.src = b.src and a.dst = b.dst where nth <= na""")
def intersect_multi(spark, sf_dir):
    return X.intersection(sp(spark, sf_dir, "R"), sp(spark, sf_dir, "A"), multi=True)


def _served(spark, sf_dir):
    l, o, c = (table(spark, sf_dir, x) for x in ("lineitem", "orders", "customer"))
    return l.filter("l_quantity = 50").join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).select(F.col("l_suppkey").alias("src"), F.col("c_nationkey").cast("long").alias("dst"))


SERVED = "p as (select distinct l_suppkey as src, cast(c_nationkey as bigint) as dst from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where l_quantity = 50), v as (select s_suppkey as src, cast(n_nationkey as bigint) as dst from supplier, nation)"


def _complement(spark, sf_dir, copy):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vid"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("vid"))
    return X.complement(_served(spark, sf_dir), s, n, copy, self_loops=True)


@query(f"with {SERVED} select src, dst, cast(1 as bigint) as len from v anti join p using (src, dst)")
def complement(spark, sf_dir):
    return _complement(spark, sf_dir, False)


@query(f"with {SERVED} select src, dst, cast(1 as bigint) as len from v semi join p using (src, dst)")
def complement_copy(spark, sf_dir):
    return _complement(spark, sf_dir, True)


@query(f"""with {NF}, e as (select * from nf where len * 25 * 25 > (select sum(len) from nf))
select a.src || '->' || a.dst as src, b.src || '->' || b.dst as dst, cast(1 as bigint) as len from e a join e b on a.dst = b.src""")
def lines_directed(spark, sf_dir):
    nf = nation_flow(spark, sf_dir)
    return X.lines_directed(nf.crossJoin(nf.agg(F.sum("len").alias("t"))).filter("len * 625 > t").select("src", "dst", "len"))


@query("""with e as (select cast(n_nationkey as bigint) as eid, cast(n_nationkey as bigint) as u, 1000 + cast(n_regionkey as bigint) as v from nation)
select a.eid as src, b.eid as dst, cast(1 as bigint) as len from e a join e b on a.eid < b.eid and a.v = b.v""")
def lines_undirected(spark, sf_dir):
    return X.lines_undirected(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("eid"), F.col("n_nationkey").cast("long").alias("u"), (1000 + F.col("n_regionkey").cast("long")).alias("v")))


REG = "rv as (select cast(r_regionkey as bigint) as vid from region), ra as (select a.vid as src, b.vid as dst, 1 + (a.vid * b.vid) % 3 as len from rv a, rv b where a.vid <> b.vid and (a.vid + b.vid) % 2 = 1), pv as (select x as vid from range(5) t(x)), pa as (select x as src, (x + 1) % 5 as dst, 2 + x as len from range(5) t(x))"
CART = "select i.vid * 5 + e.src as src, i.vid * 5 + e.dst as dst, e.len from rv i, pa e union all select e.src * 5 + j.vid, e.dst * 5 + j.vid, e.len from ra e, pv j"
DIRECT = "select e.src * 5 + f.src as src, e.dst * 5 + f.dst as dst, least(e.len, f.len) as len from ra e, pa f"


def _product(spark, sf_dir, kind):
    rv = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("vid"))
    ra = rv.select(F.col("vid").alias("src")).crossJoin(rv.select(F.col("vid").alias("dst"))).filter("src <> dst and (src + dst) % 2 = 1").withColumn("len", 1 + (F.col("src") * F.col("dst")) % 3)
    pv = spark.range(5).withColumnRenamed("id", "vid")
    return X.product(rv, ra, pv, pv.select(F.col("vid").alias("src"), ((F.col("vid") + 1) % 5).alias("dst"), (F.col("vid") + 2).alias("len")), kind, 5)


@query(f"with {REG} {CART}")
def product_cartesian(spark, sf_dir):
    return _product(spark, sf_dir, "cartesian")


@query(f"with {REG} {DIRECT}")
def product_direct(spark, sf_dir):
    return _product(spark, sf_dir, "direct")


@query(f"with {REG} {CART} union all {DIRECT}")
def product_strong(spark, sf_dir):
    return _product(spark, sf_dir, "strong")


@query(f"""with e as ({SP.format('R')}) select s_nationkey * 10000000 as src, dst, min(len) as len from (select cast(s_nationkey as bigint) as s_nationkey, 1000 + dst % 7 as dst, len from e join supplier on src = s_suppkey) group by 1, 2""")
def induced_merge(spark, sf_dir):
    e = sp(spark, sf_dir, "R")
    part = e.select("dst").distinct().select(F.col("dst").alias("vid"), (1000 + F.col("dst") % 7).alias("image"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vid"), (F.col("s_nationkey").cast("long") * 10000000).alias("image"))
    # parts and suppliers have numbers of their own, so each end has its own mapping
    m = e.join(s.select(F.col("vid").alias("src"), F.col("image").alias("s")), "src").join(part.select(F.col("vid").alias("dst"), F.col("image").alias("d")), "dst")
    return X.gunion(m.select(F.col("s").alias("src"), F.col("d").alias("dst"), "len"), m.select(F.col("s").alias("src"), F.col("d").alias("dst"), "len").limit(0))


@query(f"""with {NF}, c as (select x as vid, x % 4 as code from range(25) t(x)),
m as (select vid, j, cast(vid as varchar) || case when j = 0 then '' when j = 1 then '''' else ':' || j end as image from c, range(4) r(j) where j < code)
select a.image as src, b.image as dst, len from nf join m a on a.vid = src join m b on b.vid = dst where a.image <> b.image""")
def induced_split(spark, sf_dir):
    codes = spark.range(25).select(F.col("id").alias("vid"), (F.col("id") % 4).alias("code"))
    return X.induced(nation_flow(spark, sf_dir), X.mapping_of(codes))


GRID = "with c as (select x as i, y as j from range(6) a(x), range(7) b(y))"


@query(f"{GRID} select a.i * 7 + a.j as src, b.i * 7 + b.j as dst, cast(1 as bigint) as len from c a, c b where (a.i - b.i) ** 2 + (a.j - b.j) ** 2 = 1")
def board_wazir(spark, sf_dir):
    return G.board(spark, 6, 7).arcs.select("src", "dst", "len")


@query(f"{GRID} select a.i * 7 + a.j as src, b.i * 7 + b.j as dst, abs(a.i - b.i) as len from c a, c b where abs(a.i - b.i) = abs(a.j - b.j) and a.i <> b.i")
def board_bishop(spark, sf_dir):
    return G.board(spark, 6, 7, piece=-2).arcs.select("src", "dst", "len")


@query(f"{GRID}, m(x, y) as (values (1, 2), (1, -2), (2, 1), (2, -1)), e as (select i * 7 + j as u, ((i + x + 6) % 6) * 7 + (j + y + 7) % 7 as v from c, m) select u as src, v as dst, cast(1 as bigint) as len from e union all select v, u, 1 from e")
def board_wrap(spark, sf_dir):
    return G.board(spark, 6, 7, piece=5, wrap=3).arcs.select("src", "dst", "len")


@query(f"{GRID} select a.i * 7 + a.j as src, b.i * 7 + b.j as dst, cast(1 as bigint) as len from c a, c b where (a.i - b.i) ** 2 + (a.j - b.j) ** 2 = 2 and b.i > a.i")
def board_directed(spark, sf_dir):
    return G.board(spark, 6, 7, piece=2, directed=True).arcs.select("src", "dst", "len")


@query("select a as src, b as dst, abs(a - b) as len from range(60) t(a), range(60) u(b) where a <> b")
def complete(spark, sf_dir):
    return G.complete(spark, 60).arcs.select("src", "dst", "len")


@query("select a as src, b as dst, b - a as len from range(60) t(a), range(60) u(b) where a < b")
def transitive(spark, sf_dir):
    return G.transitive(spark, 60).arcs.select("src", "dst", "len")


@query("select a as src, b as dst, cast(1 as bigint) as len from range(50) t(a), range(50) u(b) where (a - b + 50) % 50 in (1, 49)")
def circuit(spark, sf_dir):
    return G.circuit(spark, 50).arcs.select("src", "dst", "len")


@query("select a as src, (a + 1) % 50 as dst, cast(1 as bigint) as len from range(50) t(a)")
def cycle(spark, sf_dir):
    return G.cycle(spark, 50).arcs.select("src", "dst", "len")


@query("select a as src, a as dst from range(1) t(a) where a > 0")
def empty(spark, sf_dir):
    return G.empty(spark, 50).arcs.select("src", "dst")


@query("with e as (select a, 7 + b as b from range(7) t(a), range(9) u(b)) select a as src, b as dst from e union all select b, a from e")
def bi_complete(spark, sf_dir):
    return G.bi_complete(spark, 7, 9).arcs.select("src", "dst")


@query("with e as (select a, (a + 1) % 12 as b from range(12) t(a) union all select 12 + h, a from range(2) u(h), range(12) t(a)) select a as src, b as dst from e union all select b, a from e")
def wheel(spark, sf_dir):
    return G.wheel(spark, 12, 2).arcs.select("src", "dst")


BITS = "v as (select concat_ws('.', a, b, c, d, e) as name, [a, b, c, d, e] as x from range(2) a(a), range(2) b(b), range(2) c(c), range(2) d(d), range(2) e(e) where a + b + c + d + e = 2)"


@query(f"with {BITS} select p.name as low, q.name as high from v p, v q where p.name <= q.name and list_sum(list_transform(list_zip(p.x, q.x), lambda z: least(z[1], z[2]))) = 0")
def petersen(spark, sf_dir):
    return G.petersen(spark).arcs.filter("slot % 2 = 0").select("low", "high")


@query("""with v as (select concat_ws('.', a, b, c, 6 - a - b - c) as name, [a, b, c, 6 - a - b - c] as x from range(4) a(a), range(4) b(b), range(4) c(c) where a + b + c between 3 and 6)
select p.name as low, q.name as high from v p, v q where p.name < q.name and list_sum(list_transform(list_zip(p.x, q.x), lambda z: abs(z[1] - z[2]))) = 2""")
def simplex(spark, sf_dir):
    return G.simplex(spark, 6, 3, -3).arcs.filter("slot % 2 = 0").select("low", "high")


@query("""with v as (select concat_ws('.', a, b, 4 - a - b) as name, [a, b, 4 - a - b] as x from range(4) a(a), range(4) b(b) where 4 - a - b between 0 and 3)
select p.name as low, q.name as high from v p, v q where p.name <= q.name and list_sum(list_transform(list_zip(p.x, q.x), lambda z: least(z[1], z[2]))) in (0, 2)""")
def subsets(spark, sf_dir):
    return G.subsets(spark, 4, 3, -2, size_bits=5).arcs.filter("slot % 2 = 0").select("low", "high")


@query("""with recursive p(rest, last, name) as (select 9, 9, '' union all select rest - k, k, name || case when name = '' then '' else '+' end || k from p, range(1, 10) t(k) where k <= least(rest, last)),
v as (select name from p where rest = 0), x as (select name, row_number() over (order by name) as id, unnest(string_split(name, '+'))::int as part from v),
c as (select name, part, count(*) as n from x group by 1, 2), s as (select distinct c.name, c.part, a from c, range(1, 9) t(a) where a * 2 <= c.part),
y as (select s.name, s.part as p, s.a, d.part, d.n - (d.part = s.part)::int as n from s join c d on d.name = s.name union all select name, part, a, a, 1 from s union all select name, part, a, part - a, 1 from s),
z as (select name, p, a, part, sum(n)::int as n from y group by 1, 2, 3, 4 having sum(n) > 0),
o as (select name, p, a, string_agg(rtrim(repeat(part || '+', n), '+'), '+' order by part desc) as high from z group by 1, 2, 3)
select distinct name as low, high from o""")
def parts(spark, sf_dir):
    return G.parts(spark, 9).arcs.filter("slot % 2 = 0").select("low", "high")


@query("""with recursive p(name) as (select '' union all select name || l from p, (values ('0'), ('1'), ('2')) t(l) where length(name) < 5 and length(name) - length(replace(name, l, '')) < case l when '0' then 2 when '1' then 2 else 1 end),
v as (select name from p where length(name) = 5)
select name as low, substr(name, 1, k - 1) || substr(name, k + 1, 1) || substr(name, k, 1) || substr(name, k + 2) as high from v, range(1, 5) t(k) where substr(name, k, 1) < substr(name, k + 1, 1)""")
def perms(spark, sf_dir):
    return G.perms(spark, [2, 2, 1]).arcs.filter("slot % 2 = 0").select("low", "high")


def _tree_sql(n: int) -> str:
    """Codes t of trees with 0 to n inner nodes and rotations r between them, each built from those with fewer."""
    out = ["t0 as (select 'x' as code)", "r0 as (select '' as low, '' as high where false)"]
    for k in range(1, n + 1):
        two = [(i, k - 1 - i) for i in range(k)]
        three = [(i, j, k - 2 - i - j) for i in range(k - 1) for j in range(k - 1 - i)]
        out.append(f"t{k} as (" + " union all ".join(f"select '.' || a.code || b.code as code from t{i} a, t{j} b" for i, j in two) + ")")
        below = [f"select '.' || a.low || b.code as low, '.' || a.high || b.code as high from r{i} a, t{j} b union all select '.' || a.code || b.low, '.' || a.code || b.high from t{i} a, r{j} b" for i, j in two]
        here = [f"select '..' || a.code || b.code || c.code, '.' || a.code || '.' || b.code || c.code from t{i} a, t{j} b, t{m} c" for i, j, m in three]
        out.append(f"r{k} as (" + " union all ".join(below + here) + ")")
    return "with " + ", ".join(out) + f" select low, high from r{n}"


@query(_tree_sql(5))
def binary_trees(spark, sf_dir):
    return G.binary(spark, 5).arcs.filter("slot % 2 = 0").select("low", "high")


def _raman_sql(p: int, q: int, rest: str) -> str:
    """gen: the generators from the sums of four squares; inv: inverses modulo q, 0 of 0."""
    r, odd = int(p**0.5) + 1, p % 4 == 1
    mod = lambda x: f"((({x}) % {q}) + {q}) % {q}"
    return f"""with r as (select unnest(range({-r}, {r + 1})) as x), o as (select a.x as g, b.x as h from range({q}) a(x), range({q}) b(x) where (a.x * a.x + b.x * b.x + 1) % {q} = 0 order by 1, 2 limit 1),
s as (select a.x as a0, b.x as a1, c.x as a2, d.x as a3 from r a, r b, r c, r d where a.x * a.x + b.x * b.x + c.x * c.x + d.x * d.x = {p} and abs(a.x) % 2 = {int(odd)} and abs(b.x) % 2 = {int(not odd)} and abs(c.x) % 2 = {int(not odd)} and abs(d.x) % 2 = {int(not odd)}
  and (a.x > 0 or a.x = 0 and (b.x > 0 or b.x = 0 and (c.x > 0 or c.x = 0 and d.x > 0)))),
gen as (select row_number() over (order by a0, a1, a2, a3) - 1 as gen, {mod("a0 + a1 * g + a3 * h")} as ga, {mod("a2 + a3 * g - a1 * h")} as gb, {mod("-a2 + a3 * g - a1 * h")} as gc, {mod("a0 - a1 * g - a3 * h")} as gd from s, o),
inv as (select a.x as of, b.x as inv from range(1, {q}) a(x), range(1, {q}) b(x) where a.x * b.x % {q} = 1 union all select 0, 0), {rest}"""


def _line_sql(q: int) -> str:
    return f"""f as (select x, gen, case x when {q} then ga else (ga * x + gb) % {q} end as num, case x when {q} then gc else (gc * x + gd) % {q} end as den from range({q + 1}) t(x), gen),
line as (select x, gen, case den when 0 then {q} else num * inv % {q} end as y from f join inv on of = den)"""


@query(_raman_sql(5, 31, _line_sql(31) + " select x as src, y as dst, gen from line"))
def raman_line(spark, sf_dir):
    return G.raman(spark, 5, 31, 1)


@query(_raman_sql(5, 13, _line_sql(13) + " select a.x * 14 + b.x as src, least(a.y, b.y) * 14 + greatest(a.y, b.y) as dst, a.gen from line a join line b on a.gen = b.gen and a.x < b.x"))
def raman_pairs(spark, sf_dir):
    return G.raman(spark, 5, 13, 2)


@query(
    _raman_sql(
        3,
        7,
        """v as (select (b * 7 + c) * 6 + k - 1 as id, 1 as a, b, c, (b * c + k) % 7 as d from range(7) x(b), range(7) y(c), range(1, 7) z(k)
  union all select 294 + (k - 1) * 7 + d, 0, 1, 7 - k, d from range(1, 7) z(k), range(7) x(d)),
w as (select id, gen, (a * ga + b * gc) % 7 as a, (a * gb + b * gd) % 7 as b, (c * ga + d * gc) % 7 as c, (c * gb + d * gd) % 7 as d from v, gen),
n as (select id, gen, a * inv % 7 as a, b * inv % 7 as b, c * inv % 7 as c, d * inv % 7 as d from w join inv on of = case when a > 0 then a else b end)
select n.id as src, v.id as dst, gen from n join v using (a, b, c, d)""",
    )
)
def raman_matrices(spark, sf_dir):
    return G.raman(spark, 3, 7, 0)


def words5(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).filter(F.length("word") == 5)
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


W5 = "w as (select word, count(*) as n from (select unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as word from documents) where length(word) = 5 group by 1)"
HAM = "h as (select a.word as a, b.word as b, k as pos from w a join range(5) t(k) on true join w b on a.word < b.word and substr(a.word, 1, k) = substr(b.word, 1, k) and substr(a.word, k + 2) = substr(b.word, k + 2))"


@query(f"with {W5}, {HAM} select a, b, cast(pos as bigint) as pos from h")
def hamming_edges(spark, sf_dir):
    return T.hamming_edges(words5(spark, sf_dir).select("word"))


@query(f"with {W5}, s as (select word, cast(n * 3 + case when word like '%e%' then 100 else 0 end as bigint) as weight from w), r as (select *, row_number() over (order by weight desc, word) as rank from s where weight >= 10) select word, weight, rank from r where rank <= 100")
def word_weight_top(spark, sf_dir):
    return T.weighted_top(words5(spark, sf_dir), "word", F.col("n") * 3 + F.when(F.col("word").contains("e"), 100).otherwise(0), 100, 10).select("word", "weight", "rank")


@query(f"""with recursive {W5}, {HAM}, e as (select a, b from h union all select b, a from h), s as (select min(word) as w from w where word in (select a from e)),
d(w, dist) using key (w) as (select w, 0 from s union (select e.b, min(d.dist) + 1 from d join e on e.a = d.w left join recurring.d o on o.w = e.b where o.w is null or d.dist + 1 < o.dist group by e.b))
select w as word, dist from d""")
def ladder(spark, sf_dir):
    w = words5(spark, sf_dir).select("word")
    e = T.hamming_edges(w).cache()
    arcs = e.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(e.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    return A.bfs_layers(arcs, arcs.agg(F.min("src").alias("vid"))).select(F.col("vid").alias("word"), "dist")


@query(f"""with recursive {W5}, {HAM}, e as (select a, b from h union all select b, a from h),
cc(w, c) using key (w) as (select word, word from w union (select e.b, min(cc.c) from cc join e on e.a = cc.w join recurring.cc o on o.w = e.b where cc.c < o.c group by e.b))
select w as word, c as component from cc""")
def word_components(spark, sf_dir):
    w = words5(spark, sf_dir).select("word")
    e = T.hamming_edges(w)
    return A.connected_components(w.withColumnRenamed("word", "vid"), e.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("vid", "word")


def page_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("href"))
    return p.select("src", F.conv(F.substring(F.md5("href"), 1, 7), 16, 10).cast("long").alias("dst")).withColumn("dst", F.col("dst") % 1000)


@query("""with p as (select page_id as src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href from pages), l as (select src, cast('0x' || substr(md5(href), 1, 7) as bigint) % 1000 as dst from p)
select src, dst from l where abs(src - dst) >= 100""")
def link_filter(spark, sf_dir):
    return T.link_filter(page_links(spark, sf_dir), 100)


COST = "pr as (select a.s_suppkey as u, b.s_suppkey as v, abs(cast(round(a.s_acctbal * 100) as bigint) - cast(round(b.s_acctbal * 100) as bigint)) as len from supplier a, supplier b where a.s_suppkey < b.s_suppkey and a.s_suppkey < 100 and b.s_suppkey < 100)"


def supplier_line(spark, sf_dir):
    """All suppliers u by their balance x in cents; those without a number can't be vertices."""
    return table(spark, sf_dir, "supplier").filter("s_suppkey is not null").select(F.col("s_suppkey").alias("u"), F.round(F.col("s_acctbal") * 100).cast("long").alias("x"))


def near_pairs(spark, sf_dir, k):
    """Pairs of suppliers among which are the k nearest of each, ties by the other's number: the next k in either order of balances, and the first k + 1 of one balance."""
    s = supplier_line(spark, sf_dir)
    both = [s.select(F.col("u").alias("a"), F.col("x").alias("ax"), F.array(*(F.lead(F.struct("u", "x"), i).over(w) for i in range(1, k + 1))).alias("ahead")) for w in (Window.orderBy("x", "u"), Window.orderBy(F.desc("x"), "u"))]
    pairs = both[0].unionByName(both[1]).select("a", "ax", F.explode("ahead").alias("b")).filter("b is not null").select("a", "ax", F.col("b.u").alias("b"), F.col("b.x").alias("bx"))
    first = s.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy("u"))).filter(F.col("r") <= k + 1).select(F.col("u").alias("b"), "x")
    same = s.join(first, "x").filter("u <> b").select(F.col("u").alias("a"), F.col("x").alias("ax"), "b", F.col("x").alias("bx"))
    return pairs.unionByName(same).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.abs(F.col("ax") - F.col("bx")).alias("len")).distinct()


def supplier_steps(spark, sf_dir):
    """Edges (u, v, len) in order of balances: from each supplier whose place is a multiple of 16 ** k to the next 15 such places, for all k.

    Costs add up along a line, so distances are those of the graph of all pairs, over at most 2 log16 n + 1 edges, of which there are some 16 n.
    """
    s = numbered(supplier_line(spark, sf_dir).filter("x is not null"), ["x", "u"], "p")
    n, step, levels = s.count(), 1, []
    while step < n or not levels:
        levels.append(s.filter(F.col("p") % step == 0).select("u", "x", F.explode(F.sequence(F.col("p") + step, F.col("p") + 15 * step, F.lit(step).cast("long"))).alias("p")))
        step *= 16
    ahead = s.select(F.col("u").alias("v"), F.col("x").alias("y"), "p")
    return functools.reduce(DataFrame.unionByName, levels).join(ahead, "p").select("u", "v", (F.col("y") - F.col("x")).alias("len"))


@query(f"""with {COST}, n as (select * from pr where len <= 100000), e as (select u as a, v as b, len from n union all select v, u, len from n),
k as (select * from (select *, row_number() over (partition by a order by len, b) as r from e) where r <= 4)
select x.a as u, x.b as v, x.len from k x join k y on x.a = y.b and x.b = y.a where x.a < x.b""")
def degree_cap(spark, sf_dir):
    return T.degree_cap(near_pairs(spark, sf_dir, 4), 100_000, 4)


@query("with m as (select distinct l_orderkey as g, l_partkey as p from lineitem) select a.p as u, b.p as v, min(a.g) as first from m a join m b on a.g = b.g and a.p < b.p group by 1, 2")
def clique_first(spark, sf_dir):
    return T.clique_edges(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query("select l_partkey as item, count(distinct case when l_orderkey between 1000 and 9000 then l_orderkey end) as n_in, count(distinct case when l_orderkey not between 1000 and 9000 then l_orderkey end) as n_out from lineitem group by 1")
def in_out_counts(spark, sf_dir):
    return T.in_out_counts(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 1000, 9000)


@query("with m as (select distinct l_orderkey as grp, l_partkey as item from lineitem) select grp, count(*) filter (item % 3 = 0) as kept, count(*) filter (item % 3 <> 0) as dropped from m group by 1")
def bi_chapter(spark, sf_dir):
    kept = table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("item"))
    return T.bipartite_groups(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", kept)


@query(f"""with {NF}, r as (select cast(n_nationkey as bigint) as vid, cast(n_regionkey as bigint) as image from nation),
g as (select a.image as src, b.image as dst, cast(sum(len) as bigint) as flow from nf join r a on a.vid = src join r b on b.vid = dst group by 1, 2), t as (select dst, sum(flow) as total from g group by 1)
select src, g.dst, flow from g join t on t.dst = g.dst where flow <> 0 and flow * 65536 > total * 13000""")
def flow_merge(spark, sf_dir):
    m = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("vid"), F.col("n_regionkey").cast("long").alias("image"))
    return T.flow_merge(nation_flow(spark, sf_dir), m, 13000)


@query()
def hier_greedy(spark, sf_dir):
    nf = nation_flow(spark, sf_dir).groupBy("src").agg(F.sum("len").alias("t"))
    n = table(spark, sf_dir, "nation").join(nf, F.col("n_nationkey") == F.col("src")).select("n_nationkey", "n_regionkey", "t").collect()  # 25 rows
    totals: dict[int, int] = {}
    for r in n:
        totals[r.n_regionkey] = totals.get(r.n_regionkey, 0) + r.t
    rows = [(-1, None, sum(totals.values())), *((1000 + k, -1, v) for k, v in totals.items()), *((r.n_nationkey, 1000 + r.n_regionkey, r.t) for r in n)]
    return spark.createDataFrame([(x,) for x in T.greedy_hierarchy(rows, 12)], "node long")


GAMES = """g as (select cast(dayofyear(o_orderdate) as bigint) as day, cast(c_nationkey as bigint) as a, cast(s_nationkey as bigint) as b, cast(l_quantity as bigint) as sa, cast(l_linenumber as bigint) as sb, case when l_returnflag = 'N' then 2 else 1 end as venue
  from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join customer on o_custkey = c_custkey where c_nationkey <> s_nationkey),
w as (select * from g where day between 100 and 128), m as (select day, a as src, b as dst, sa as len, venue, sb as mate from w union all select day, b, a, sb, 4 - venue, sa from w)"""


def games(spark, sf_dir):
    l, o, s, c = (table(spark, sf_dir, x) for x in ("lineitem", "orders", "supplier", "customer"))
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(s, l.l_suppkey == s.s_suppkey).join(c, o.o_custkey == c.c_custkey).filter("c_nationkey <> s_nationkey")
    day = F.dayofyear("o_orderdate").cast("long")
    g = j.select(day.alias("day"), F.col("c_nationkey").cast("long").alias("a"), F.col("s_nationkey").cast("long").alias("b"), F.col("l_quantity").cast("long").alias("score_a"), F.col("l_linenumber").cast("long").alias("score_b"), F.when(F.col("l_returnflag") == "N", 2).otherwise(1).alias("venue"))
    return g.filter("day between 100 and 128")


@query(f"with {GAMES} select day, src, dst, len, venue from m")
def match_pairs(spark, sf_dir):
    return T.match_pairs(games(spark, sf_dir)).select("day", "src", "dst", "len", "venue")


@query(f"with {GAMES} select src, dst, max(len - mate) as del from m group by 1, 2")
def margin(spark, sf_dir):
    return T.match_pairs(games(spark, sf_dir)).groupBy("src", "dst").agg(F.max(F.col("len") - F.col("mate")).alias("del"))


@query()
def chain_greedy(spark, sf_dir):
    chain = A.greedy_chain(margin(spark, sf_dir), 0, 1)
    return spark.createDataFrame([(k, *x) for k, x in enumerate(chain)], "step int, src long, dst long, del long")


@query()
def chain_beam(spark, sf_dir):
    chain = A.beam_chain(margin(spark, sf_dir), 0, 1, 20)
    return spark.createDataFrame([(k, *x) for k, x in enumerate(chain)], "step int, src long, dst long, del long")


CELLS = "cl as (select i, j, coalesce(n, 0) as val from range(28) a(i) cross join range(24) b(j) left join (select (day(ts) - 1) % 28 as di, hour(ts) as hj, count(*) as n from events group by 1, 2) e on di = i and hj = j)"


def cells(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(((F.dayofmonth("ts") - 1) % 28).cast("long").alias("i"), F.hour("ts").cast("long").alias("j")).agg(F.count(F.lit(1)).alias("val"))
    g = spark.range(28).select(F.col("id").alias("i")).crossJoin(spark.range(24).select(F.col("id").alias("j")))
    return g.join(e, ["i", "j"], "left").select("i", "j", F.coalesce("val", F.lit(0)).cast("long").alias("val"))


@query(f"""with {CELLS}, o as (select r, c, sum(val * (least((i + 1) * 10, (r + 1) * 28) - greatest(i * 10, r * 28)) * (least((j + 1) * 7, (c + 1) * 24) - greatest(j * 7, c * 24))) as s
  from cl, range(10) x(r), range(7) y(c) where least((i + 1) * 10, (r + 1) * 28) > greatest(i * 10, r * 28) and least((j + 1) * 7, (c + 1) * 24) > greatest(j * 7, c * 24) group by 1, 2)
select r, c, cast(least(255, greatest(0, s * 255 // (200 * 28 * 24))) as bigint) as val from o""")
def regrid(spark, sf_dir):
    return T.regrid(cells(spark, sf_dir), 28, 24, 10, 7, 0, 200, 255)


BUCKETS = f"{CELLS}, k as (select i * 24 + j as cell, i, j, val % 3 as v from cl), e as (select a.cell as a, b.cell as b from k a join k b on a.v = b.v and abs(a.i - b.i) + abs(a.j - b.j) = 1)"


@query(f"with recursive {BUCKETS}, cc(w, c) using key (w) as (select cell, cell from k union (select e.b, min(cc.c) from cc join e on e.a = cc.w join recurring.cc o on o.w = e.b where cc.c < o.c group by e.b)) select w as cell, c as region from cc")
def regions(spark, sf_dir):
    return T.regions(cells(spark, sf_dir).withColumn("val", F.col("val") % 3), 24)


@query(f"with {CELLS} select i as src, j as dst, val as b from cl where val >= 2")
def threshold_bipartite(spark, sf_dir):
    return T.threshold_bipartite(cells(spark, sf_dir), 2)


SPB = "b as (select distinct l_suppkey as s, 1000000 + l_partkey as p from lineitem where l_quantity > 40), e as (select s as x, p as y from b union all select p, s from b)"


def bipartite_arcs(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_suppkey").alias("src"), (1000000 + F.col("l_partkey")).alias("dst")).distinct()
    return b.unionByName(b.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query(f"with recursive {SPB}, d(w, dist) using key (w) as (select cast(1 as bigint), 0 union (select e.y, min(d.dist) + 1 from d join e on e.x = d.w left join recurring.d o on o.w = e.y where o.w is null or d.dist + 1 < o.dist group by e.y)) select dist, count(*) as n from d group by 1")
def bfs_layers(spark, sf_dir):
    one = spark.range(1).select(F.lit(1).cast("long").alias("vid"))
    return A.bfs_layers(bipartite_arcs(spark, sf_dir).cache(), one).groupBy("dist").agg(F.count(F.lit(1)).alias("n"))


@query("select cast(4 as bigint) as girth")
def girth(spark, sf_dir):
    return spark.createDataFrame([(A.girth_from(bipartite_arcs(spark, sf_dir).cache(), 1),)], "girth long")


STRONG = f"{NF}, t as (select dst, sum(len) as total from nf group by 1), e as (select src, nf.dst from nf join t on t.dst = nf.dst where src <> nf.dst and len * 21 > total)"


def strong_arcs(spark, sf_dir):
    nf = nation_flow(spark, sf_dir)
    t = nf.groupBy("dst").agg(F.sum("len").alias("total"))
    return nf.join(t, "dst").filter("src <> dst and len * 21 > total").select("src", "dst").cache()


REACH = "r(a, b) as (select n_nationkey::bigint, n_nationkey::bigint from nation union select r.a, e.dst from r join e on e.src = r.b), c as (select x.a as vid, min(x.b) as component from r x join r y on x.a = y.b and x.b = y.a group by 1)"


def nations(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("vid"))


@query(f"with recursive {STRONG}, {REACH} select vid, component from c")
def scc(spark, sf_dir):
    return A.strong_components(nations(spark, sf_dir), strong_arcs(spark, sf_dir))


@query(f"with recursive {STRONG}, {REACH} select a.component as from_comp, b.component as to_comp, min([e.src, e.dst])[1] as src, min([e.src, e.dst])[2] as dst from e join c a on a.vid = e.src join c b on b.vid = e.dst where a.component <> b.component group by 1, 2")
def scc_links(spark, sf_dir):
    arcs = strong_arcs(spark, sf_dir)
    return A.component_links(arcs, A.strong_components(nations(spark, sf_dir), arcs))


@query("with n as (select n_regionkey as r, count(*) as k from nation group by 1) select 1000 + cast(r_regionkey as bigint) as vid from region left join n on r = r_regionkey where k > 0 or (r_regionkey > (select min(r_regionkey) from region) and r_regionkey < (select max(r_regionkey) from region))")
def articulation(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("src"), (1000 + F.col("n_regionkey").cast("long")).alias("dst"))
    r = table(spark, sf_dir, "region").select((1000 + F.col("r_regionkey").cast("long")).alias("src"))
    chain = r.withColumn("dst", F.col("src") + 1).join(r.select(F.col("src").alias("dst")), "dst").select("src", "dst")
    return A.articulation_points(n.unionByName(chain))


@query("select cast(max(x) - min(x) as bigint) as total from (select cast(round(s_acctbal * 100) as bigint) as x from supplier where s_suppkey < 100)")
def mst_total(spark, sf_dir):
    # on a line the least edges join neighbours
    e = near_pairs(spark, sf_dir, 1).withColumn("eid", F.shiftleft("u", 31) + F.col("v"))
    # each supplier by itself is a tree of length 0, or null without a balance
    alone = supplier_line(spark, sf_dir).select((F.col("x") - F.col("x")).alias("len"))
    return A.minimum_spanning_forest(e).select("len").unionByName(alone).agg(F.sum("len").alias("total"))


@query(f"""with recursive {NF}, c as (select src, dst, len from nf where src < 6 and dst < 6), p(k, used, total) as (select 0, [-1]::bigint[], 0::hugeint union all select k + 1, list_append(used, dst), total + len from p join c on src = k where not list_contains(used, dst))
select cast(min(total) as bigint) as total from p where k = 6""")
def assignment(spark, sf_dir):
    m = np.zeros((6, 6), np.int64)
    for r in nation_flow(spark, sf_dir).filter("src < 6 and dst < 6").collect():  # 36 rows
        m[r.src, r.dst] = r.len
    return spark.createDataFrame([(A.assignment(m)[0],)], "total long")


@query()
def assignment_whole(spark, sf_dir):
    """assignment over all nations; brute force in SQL ends at a few."""
    n = table(spark, sf_dir, "nation").count()
    m = np.zeros((n, n), np.int64)
    for r in nation_flow(spark, sf_dir).collect():  # 25 x 25 cells
        m[r.src, r.dst] = r.len
    return spark.createDataFrame([(A.assignment(m)[0],)], "total long")


@query(f"with {NF} select cast(sum(least(a.len, b.len)) as bigint) as bound from nf a join nf b on a.src = b.dst and a.dst = b.src where a.src < a.dst")
def feed_forward_bound(spark, sf_dir):
    return A.feed_forward_bound(nation_flow(spark, sf_dir))


@query(f"with {NF} select cast(sum(len) as bigint) as score from nf where (src * 7) % 25 > (dst * 7) % 25")
def order_score(spark, sf_dir):
    return A.order_score(nation_flow(spark, sf_dir), spark.range(25).select(F.col("id").alias("vid"), ((F.col("id") * 7) % 25).alias("place")))


@query()
def order_descent(spark, sf_dir):
    m = np.zeros((25, 25), np.int64)
    for r in nation_flow(spark, sf_dir).collect():  # 25 x 25 cells
        m[r.src, r.dst] = r.len
    score, order, steps = A.descend(m, list(range(25)))
    return spark.createDataFrame([(k, v, score, steps) for k, v in enumerate(order)], "place int, vid long, score long, steps int")


@query("select l_orderkey, l_linenumber, l_suppkey % 256 as a, cast(l_linenumber as bigint) * 31 % 256 as b, (l_suppkey % 256) * (cast(l_linenumber as bigint) * 31 % 256) as product from lineitem")
def circuit_mult(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 256).alias("a"), (F.col("l_linenumber").cast("long") * 31 % 256).alias("b"))
    return C.multiply_frame(l, "a", "b", 8, 8)


@query("select x as a, x * 201 as product from range(256) t(x)")
def circuit_partial(spark, sf_dir):
    c = C.freeze(C.product(8, 8), {8 + k: 201 >> k & 1 for k in range(8)})
    bits = np.concatenate([(np.arange(256)[:, None] >> np.arange(8)) & 1, np.zeros((256, 8), int)], axis=1)
    value = c.evaluate(bits) @ (1 << np.arange(16))
    return spark.createDataFrame([(a, int(v)) for a, v in enumerate(value)], "a long, product long")


@query()
def circuit_depth(spark, sf_dir):
    return spark.createDataFrame([(m, n, len(c.gates), c.depth()) for m, n in ((2, 3), (3, 3), (8, 8), (10, 12)) for c in (C.product(m, n),)], "m int, n int, gates int, depth int")


@query("select cast(12 as bigint) as r4")
def risc_run(spark, sf_dir):
    word = lambda op, d=0, s=0, imm=0: op << 12 | d << 9 | s << 6 | imm
    rom = [word(0, 1, imm=3), word(0, 2, imm=4), word(0, 4, imm=0), word(0, 3, imm=1), word(4, 1, imm=8), word(1, 4, 2), word(2, 1, 3), word(4, 5, imm=4)]
    return spark.createDataFrame([(C.run_machine(rom)[4],)], "r4 long")


@query()
def random_native(spark, sf_dir):
    return G.random_native(spark, 5000, 60_000, -1, False, 100, 7)


@query()
def random_exact(spark, sf_dir):
    return G.random_graph(spark, 300, 2000, -1, False, False, 1, 50, 1009).arcs


@functools.cache
def _draws(n: int, seed: int) -> str:
    from ..core.rng import Stream

    s = Stream(seed)
    return ", ".join(f"({k}, {s.next()})" for k in range(n))


@query(f"""with d(k, r) as (values {_draws(400, 314159)}), i as (select c_custkey as pos, cast(floor(c_acctbal / 1000) as bigint) as key from customer where c_custkey < 200),
a as (select i.*, r >> 23 as k1 from i join d on k = pos), b as (select a.*, row_number() over (order by k1 desc, pos desc) - 1 + (select count(*) from a) as turn from a)
select pos, key, row_number() over (order by key desc, r >> 23 desc, k1, pos) - 1 as rank from b join d on k = turn""")
def linksort(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_custkey < 200").select(F.col("c_custkey").alias("pos"), F.floor(F.col("c_acctbal") / 1000).cast("long").alias("key"))
    return linksort_frame(c, draws(spark, 314159, 400)).select("pos", "key", "rank")


@query()
def linksort_whole(spark, sf_dir):
    """linksort over all customers, in order of their numbers; its draws are too many for a literal list."""
    c = table(spark, sf_dir, "customer").select((F.row_number().over(Window.orderBy("c_custkey")) - 1).cast("long").alias("pos"), "c_custkey", F.floor(F.col("c_acctbal") / 1000).cast("long").alias("key"))
    return linksort_frame(c, draws(spark, 314159, 2 * c.count())).select("c_custkey", "pos", "key", "rank")


@query(f"with {COST} select v as vid, min(len) as dist from (select v, len from pr where u = 1 union all select u, len from pr where v = 1 union all select 1, 0) group by 1")
def shortest_paths(spark, sf_dir):
    e = supplier_steps(spark, sf_dir)
    arcs = stored(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "len")).select(F.col("u").alias("src"), F.col("v").alias("dst"), "len"), "steps")
    found = A.shortest_paths(arcs, 1).select("vid", "dist")
    # without a balance, its own or the source's, a supplier's distance is null
    s = supplier_line(spark, sf_dir).select(F.col("u").alias("vid"))
    lost = s.join(found, "vid", "left_anti").crossJoin(s.filter("vid = 1").distinct().select(F.lit(None).cast("long").alias("dist")))
    return found.unionByName(lost)
