"""The engine's own queries over the standard tables, each with the SQL that says the same.

Every query takes (spark, sf_dir). Inputs: ``M`` part x supplier with summed quantity, ``T`` a
three-dimensional tensor of depth 2, ``Z`` entries with zero values, ``G`` a bipartite
graph part -> supplier (and its reverse), ``G2`` a sparse graph of many components.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import ceil_div, encode_size, log2_floor
from .meta import MatrixType, TensorMeta
from .operators import access, algebra, compare, dense, encode, ingest, layout
from .plans.components import component_sizes, connected_components
from .plans.pagerank import out_degrees, pagerank, top_k
from .plans.star import star_components
from .storage import cut, parts_of, spread
from .tensor import CooTensor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

OFFSET = 1_000_000


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _sizes(spark: SparkSession, sf: str) -> tuple[int, int]:
    return _table(spark, sf, "part").count(), _table(spark, sf, "supplier").count()


def matrix(spark: SparkSession, sf: str) -> CooTensor:
    """M: part x supplier, summed quantity; column-major."""
    lines = _table(spark, sf, "lineitem")
    df = spread(lines.select(F.col("l_partkey").alias("d0"), F.col("l_suppkey").alias("d1"), "l_quantity"), lines.count(), "d0", "d1").groupBy("d0", "d1").agg(F.array(F.sum("l_quantity")).alias("vals"))
    return CooTensor(df, TensorMeta(MatrixType("CRG"), "f64", (*_sizes(spark, sf), 1), (1, 0, 2)))


M_SQL = "m as (select l_partkey as d0, l_suppkey as d1, sum(l_quantity) as val from lineitem group by 1, 2), sz as (select (select count(*) from part) as n0, (select count(*) from supplier) as n1)"


def tensor(spark: SparkSession, sf: str) -> CooTensor:
    """T: (part mod 50, supplier, line number) of all line items, depth 2; stored in order 0, 2, 1."""
    df = _table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 50).alias("d0"), F.col("l_suppkey").alias("d1"), F.col("l_linenumber").cast("long").alias("d2")).agg(F.array(F.sum("l_quantity"), F.round(F.sum("l_extendedprice"), 2)).alias("vals"))
    return CooTensor(df, TensorMeta(MatrixType("CRG"), "f64", (50, _sizes(spark, sf)[1], 8, 2), (0, 2, 1, 3)))


T_SQL = "sz as (select count(*) as n1 from supplier), t as (select l_partkey % 50 as d0, l_suppkey as d1, l_linenumber::bigint as d2, sum(l_quantity) as v0, round(sum(l_extendedprice), 2) as v1 from lineitem group by 1, 2, 3)"


def entries(spark: SparkSession, sf: str) -> CooTensor:
    """Z: (order, line number) with the discount, zeros included."""
    df = _table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("d0"), F.col("l_linenumber").cast("long").alias("d1"), F.array("l_discount").alias("vals"))
    return CooTensor(df, TensorMeta(MatrixType("CRG"), "f64", (1 << 40, 1 << 10, 1), (0, 1, 2)))


def graph(spark: SparkSession, sf: str, backwards: bool = False) -> tuple[DataFrame, int]:
    """G: distinct links part -> n_part + supplier, or the other way round."""
    n_part, n_supp = _sizes(spark, sf)
    a, b = F.col("l_partkey"), F.col("l_suppkey") + n_part
    pair = (b, a) if backwards else (a, b)
    lines = _table(spark, sf, "lineitem")
    return spread(lines.select(pair[0].alias("src"), pair[1].alias("dst")), lines.count(), "src", "dst").distinct(), n_part + n_supp


def sparse_graph(spark: SparkSession, sf: str) -> DataFrame:
    """G2: order -> OFFSET + part for large quantities."""
    return _table(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") + OFFSET).alias("dst"))


# Ingest and metadata


@query("select l_orderkey as d0, l_linenumber::bigint as d1, l_discount as val from lineitem where l_discount <> 0")
def ingest_zero_drop(spark, sf):
    return ingest.drop_zeros(entries(spark, sf)).scalar


@query("select l_partkey as d0, l_suppkey as d1, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def ingest_duplicate_report(spark, sf):
    df = _table(spark, sf, "lineitem").select(F.col("l_partkey").alias("d0"), F.col("l_suppkey").alias("d1"))
    return ingest.duplicates(df, ["d0", "d1"])


@query(f"with {M_SQL} select d0, d1, val from m, sz where d0 >= n0 // 2 or d1 >= n1 // 2")
def ingest_out_of_bounds(spark, sf):
    t = matrix(spark, sf)
    half = TensorMeta(t.meta.matrix_type, "f64", (t.meta.shape[0] // 2, t.meta.shape[1] // 2, 1), t.meta.order)
    return CooTensor(ingest.out_of_bounds(CooTensor(t.df, half)), half).scalar


@query(f"with {M_SQL} select n0 as rows, n1 as cols, (select count(*) from m) as nnz, greatest(n0, n1, 1) as max_dim_size, (select max(d1) + 1 from m) as index_pos_end, n0 * n1 as elems, 1::bigint as index_dim, 0::bigint as non_index_dim from sz")
def tensor_meta(spark, sf):
    t = matrix(spark, sf)
    m = t.meta
    long = lambda x, n: F.lit(x).cast("long").alias(n)
    return t.df.agg(F.count("*").alias("nnz"), access.index_pos_end(t)).select(long(m.rows, "rows"), long(m.cols, "cols"), "nnz", long(m.max_dim_size, "max_dim_size"), "index_pos_end", long(m.elems, "elems"), long(m.index_dim, "index_dim"), long(m.non_index_dim, "non_index_dim"))


# Access and traversal


@query(f"with {M_SQL}, p as (select p_partkey as a, (p_partkey * 7) % n1 as b from part, sz) select a, b, coalesce(val, 0) as val from p left join m on a = d0 and b = d1")
def lookup_batch(spark, sf):
    t = matrix(spark, sf)
    probes = _table(spark, sf, "part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") * 7 % t.meta.shape[1]).alias("b"))
    return access.lookup(t, probes, ["a", "b"])


@query("select p_partkey + 100000000 as a, p_partkey as b, 0::double as val from part")
def lookup_missing_zero(spark, sf):
    probes = _table(spark, sf, "part").select((F.col("p_partkey") + 100_000_000).alias("a"), F.col("p_partkey").alias("b"))
    return access.lookup(matrix(spark, sf), probes, ["a", "b"])


@query(f"with {M_SQL} select row_number() over (order by d1, d0) - 1 as idx, d0, d1, val from m")
def ordinal_access(spark, sf):
    return access.ordinals(matrix(spark, sf)).select("idx", "d0", "d1", "val")


@query(f"with {T_SQL}, r as (select *, row_number() over (order by d0, d2, d1) - 1 as o from t) select o * 2 as idx, v0 as val from r union all select o * 2 + 1, v1 from r")
def ordinal_access_depth(spark, sf):
    return access.ordinals(tensor(spark, sf)).select("idx", "val")


@query(f"with {T_SQL} select d0 || ' ' || d1 || ' ' || d2 as line from t")
def nonzero_positions(spark, sf):
    return access.position_lines(tensor(spark, sf))


@query(f"with {M_SQL} select d0, d1, val from m where d1 = 7")
def index_slice(spark, sf):
    t = matrix(spark, sf)
    return CooTensor(access.index_slice(t, 7), t.meta).scalar


@query(f"with {M_SQL}, r as (select *, row_number() over (order by d1, d0) as o from m) select d0, d1, val from r where o < coalesce((select min(o) from r where val >= 90), (select max(o) + 1 from r))")
def scan_until(spark, sf):
    t = matrix(spark, sf)
    return CooTensor(access.take_while(t, F.element_at("vals", 1) < 90), t.meta).scalar


# Dense forms

_GRID = "g as (select a as d0, b as d1, c as d2, k as depth from range(50) x(a), range((select n1 from sz)) y(b), range(8) z(c), range(2) w(k))"
_CELL = "coalesce(case depth when 0 then v0 else v1 end, 0) as val"


@query(f"with {T_SQL}, {_GRID} select ((g.d0 * 8 + g.d2) * n1 + g.d1) * 2 + depth as idx, g.d0, g.d1, g.d2, depth, {_CELL} from sz, g left join t on g.d0 = t.d0 and g.d1 = t.d1 and g.d2 = t.d2")
def dense_full(spark, sf):
    return dense.to_dense(tensor(spark, sf))


_SLICE = "s as (select distinct d1, d2, depth from g)"


@query(f"with {T_SQL}, {_GRID}, {_SLICE} select (s.d2 * n1 + s.d1) * 2 + depth as idx, s.d1, s.d2, depth, {_CELL} from sz, s left join t on t.d0 = 3 and s.d1 = t.d1 and s.d2 = t.d2")
def dense_slice(spark, sf):
    return dense.dense_slice(tensor(spark, sf), 3)


@query(f"with {T_SQL}, {_GRID}, {_SLICE} select depth * 8 * n1 + s.d2 * n1 + s.d1 as idx, s.d1, s.d2, depth, {_CELL} from sz, s left join t on t.d0 = 3 and s.d1 = t.d1 and s.d2 = t.d2")
def dense_slice_split_depth(spark, sf):
    return dense.dense_slice(tensor(spark, sf), 3, split_depths=True)


@query(f"with {T_SQL}, {_GRID} select ((g.d0 * 8 + g.d2) * n1 + g.d1) * 2 + depth as idx, g.d0, g.d1, g.d2, depth, {_CELL} from sz, g left join t on g.d0 = 3 and g.d0 = t.d0 and g.d1 = t.d1 and g.d2 = t.d2")
def dense_slice_with_index(spark, sf):
    return dense.dense_slice(tensor(spark, sf), 3, omit_index=False)


@query(f"with {T_SQL}, {_GRID}, {_SLICE}, l as (select d1, d2, arg_max(v0, d0) as v0, arg_max(v1, d0) as v1 from t where d0 in (1, 3, 5) group by 1, 2) select (s.d2 * n1 + s.d1) * 2 + depth as idx, s.d1, s.d2, depth, {_CELL} from sz, s left join l on s.d1 = l.d1 and s.d2 = l.d2")
def dense_slice_accumulate(spark, sf):
    return dense.accumulate_slices(tensor(spark, sf), [1, 3, 5])


@query(f"with {T_SQL} select d0, d1, d2, ((d0 * 8 + d2) * n1 + d1) * 2 + 1 as joined, (d0 * 8 + d2) * n1 + d1 + 400 * n1 as split from t, sz")
def linear_index(spark, sf):
    t = tensor(spark, sf)
    return t.df.select("d0", "d1", "d2", dense.linear_index(t.meta, 1).alias("joined"), dense.linear_index(t.meta, 1, split_depths=True).alias("split"))


@query("with sz as (select count(*) as n1 from supplier) select id as idx, id // (16 * n1) as d0, (id // 2) % n1 as d1, (id // (2 * n1)) % 8 as d2, id % 2 as depth from sz, range((select 800 * n1 from sz)) r(id)")
def linear_unindex(spark, sf):
    m = tensor(spark, sf).meta
    cols = dense.linear_unindex(m, F.col("id"))
    return spark.range(m.elems * m.depths).select(F.col("id").alias("idx"), *(c.alias(n) for n, c in cols.items()))


@query("select vec_id as d0, (i - 1)::bigint as d1, embedding[i]::double as val from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings) where embedding[i] <> 0")
def dense_to_sparse(spark, sf):
    df = _table(spark, sf, "embeddings")
    t = dense.from_arrays(df, "vec_id", "embedding", 64, 1 << 40)
    return t.scalar.withColumn("val", F.col("val").cast("double"))


@query(f"with {T_SQL} select d0, d1, d2, v0, v1 from t")
def dense_round_trip(spark, sf):
    t = tensor(spark, sf)
    back = dense.from_dense(dense.to_dense(t), t.meta)
    return back.df.select("d0", "d1", "d2", F.get("vals", F.lit(0)).alias("v0"), F.get("vals", F.lit(1)).alias("v1"))


@query(f"with {M_SQL} select d1, n0 as width, sum(val) as total from m, sz group by d1, n0")
def dense_rows(spark, sf):
    blocks = dense.to_blocks(matrix(spark, sf))
    each = blocks.select("d1", F.size("row").cast("long").alias("width"), F.aggregate("row", F.lit(0.0), lambda a, x: a + x).alias("total"))
    return each.groupBy("d1").agg(F.sum("width").alias("width"), F.sum("total").alias("total"))


@query("select true as same, 0::bigint as differing")
def sparse_equal(spark, sf):
    t = matrix(spark, sf)
    t = CooTensor(cut(t.df, "matrix"), t.meta)
    parts = parts_of(spark, t.count())
    once = layout.reindex(t, partitions=parts)
    again = layout.reindex(CooTensor(cut(once.df, "reindexed"), once.meta), partitions=parts)
    again = CooTensor(cut(again.df, "reindexed"), again.meta)
    n = compare.differences(t.df, again.df).count()
    return spark.range(1).select(F.lit(compare.equal(t, again)).alias("same"), F.lit(n).cast("long").alias("differing"))


# Layout and ranges


@query(f"with {M_SQL} select d0, d1, val from m")
def reindex_csr(spark, sf):
    return layout.reindex(matrix(spark, sf)).scalar


@query(f"with {M_SQL} select id as pos, count(d0) as n from range((select n0 from sz)) r(id) left join m on id = d0 group by id")
def dim_histogram(spark, sf):
    return layout.histogram(matrix(spark, sf), 0)


_OFFSETS = "off as (select id as pos, (coalesce(sum(n) over (order by id rows between unbounded preceding and 1 preceding), 0))::bigint as start from (select id, count(d0) as n from range((select max(d0) + 2 from m)) r(id) left join m on id = d0 group by id))"


@query(f"with {M_SQL}, {_OFFSETS} select pos, start from off")
def csr_offsets(spark, sf):
    return layout.offsets(matrix(spark, sf), 0)


@query(f"with {M_SQL} select d0, d1, row_number() over (order by d0, d1) - 1 as at from m")
def reindex_positions(spark, sf):
    return layout.positions(matrix(spark, sf), 0).select("d0", "d1", "at")


@query(f"with {M_SQL}, w as (select (n0 + 6) // 7 as w, n0 from sz) select id as range_id, id * w as min_pos, least((id + 1) * w, n0) as max_pos from w, range(7) r(id) where id * w < n0")
def range_equal_width(spark, sf):
    return layout.equal_width(spark, _sizes(spark, sf)[0], 7)


@query(f"with {M_SQL}, c as (select d1 as pos, count(*) as n from m group by d1), s as (select *, (sum(n) over (order by pos) - n)::bigint as start from c) select (start * 8 // (select count(*) from m))::bigint as range_id, min(pos) as min_pos, max(pos) + 1 as max_pos, sum(n)::bigint as nnz from s group by 1")
def range_nnz_balanced(spark, sf):
    return layout.nnz_balanced(matrix(spark, sf), 8)


@query(f"with {M_SQL}, c as (select d1 as pos, count(*) as n from m group by d1), s as (select *, (sum(n) over (order by pos) - n)::bigint as start from c), r as (select (start * 8 // (select count(*) from m))::bigint as range_id, sum(n)::bigint as nnz from s group by 1) select range_id, nnz, (sum(nnz) over (order by range_id) - nnz)::bigint as \"offset\" from r")
def range_offsets(spark, sf):
    return layout.range_offsets(layout.nnz_balanced(matrix(spark, sf), 8)).select("range_id", "nnz", "offset")


# Encoding

_WIDTH = lambda x: "case " + " ".join(f"when {x} < {1 << (8 * k)} then {k}" for k in range(1, 8)) + " else 8 end"


@query(f"with s as (select count(*) as n, min(o_orderkey + 70000) as lo, max(o_orderkey + 70000) as hi from orders), w as (select *, {_WIDTH('hi')} as a, {_WIDTH('(hi - lo)')} as b from s) select n, lo as min_value, hi as max_value, b < a as shifted, least(a, b)::bigint as width, n * least(a, b)::bigint as bytes from w")
def encode_width(spark, sf):
    df = _table(spark, sf, "orders").select((F.col("o_orderkey") + 70_000).alias("v"))
    return encode.width_stats(df, "v").select("n", "min_value", "max_value", "shifted", "width", "bytes")


_SKETCH = f"b as (select unnest(range(1, 64)) as bits), k as (select bits, pos >> bits as blk, arg_min(start, pos) as f, arg_max(start, pos) as l, count(*) as n from off, b where bits <= 1 or (1::bigint << (bits - 1)) <= (select max(pos) from off) group by 1, 2), c as (select bits, count(*) as blocks, {_WIDTH('greatest(max(l - f), 0)')}::bigint as width, bool_and(l >= f) as encodable, sum(n) as n from k group by bits)"


@query(f"with {M_SQL}, {_OFFSETS}, {_SKETCH} select bits, blocks, width, (n * width + blocks * 8)::bigint as bytes, encodable from c")
def encode_sketch_cost(spark, sf):
    return encode.sketch_costs(layout.offsets(matrix(spark, sf), 0), "pos", "start")


@query(f"with {M_SQL}, {_OFFSETS}, {_SKETCH}, p as (select 0::bigint as bits, {_WIDTH('max(start)')}::bigint as width, (count(*) * {_WIDTH('max(start)')})::bigint as bytes from off union all select bits, width, (n * width + blocks * 8)::bigint from c where encodable) select bits, width, bytes from p order by bytes, bits limit 1")
def encode_best(spark, sf):
    return encode.best_encoding(layout.offsets(matrix(spark, sf), 0), "pos", "start")


# Graphs

_G = "sz as (select (select count(*) from part) as np, (select count(*) from supplier) as ns), e as (select distinct l_partkey as src, l_suppkey + np as dst from lineitem, sz)"
_GB = "sz as (select (select count(*) from part) as np, (select count(*) from supplier) as ns), e as (select distinct l_suppkey + np as src, l_partkey as dst from lineitem, sz)"


def _pagerank_sql(g: str, k: int) -> str:
    steps = "".join(f", s{i} as (select s.page, s.deg, case when s.page <= (select max(dst) from e) then 0.15 / (np + ns) + 0.85 * coalesce(x.s, 0) else s.score end as score from sz, s{i - 1} s left join (select e.dst, sum(p.score / p.deg) as s from e join s{i - 1} p on p.page = e.src group by e.dst) x on x.dst = s.page)" for i in range(1, k + 1))
    return f"with {g}, d as (select src, count(*) as deg from e group by src), s0 as (select id as page, greatest(coalesce(deg, 1), 1) as deg, 1.0::double / (np + ns) as score from sz, range((select np + ns from sz)) r(id) left join d on d.src = id){steps}"


@query(f"with {_G} select src, count(*) as degree from e group by src")
def out_degree(spark, sf):
    return out_degrees(graph(spark, sf)[0])


@query(f"{_pagerank_sql(_G, 5)} select page, round(score, 9) as score from s5")
def pagerank_k5(spark, sf):
    r = pagerank(*graph(spark, sf), max_iterations=5, max_residual=0.0)
    return r.scores.select("page", F.round("score", 9).alias("score"))


@query(f"{_pagerank_sql(_GB, 5)} select page, round(score, 9) as score from s5")
def pagerank_frozen_tail(spark, sf):
    r = pagerank(*graph(spark, sf, backwards=True), max_iterations=5, max_residual=0.0)
    return r.scores.select("page", F.round("score", 9).alias("score"))


@query(f"{_pagerank_sql(_G, 3)} select page, round(score, 9) as score from s3 order by s3.score desc, page limit 20")
def pagerank_topk(spark, sf):
    r = pagerank(*graph(spark, sf), max_iterations=3, max_residual=0.0)
    return top_k(r.scores, 20).select("page", F.round("score", 9).alias("score"))


def _two_way(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """G with its reverse: scores that keep moving."""
    edges, n = graph(spark, sf)
    return edges.union(edges.select("dst", "src")), n


_G2WAY = _G.replace(", e as (", ", e1 as (") + ", e as (select src, dst from e1 union all select dst, src from e1)"


@query(f"{_pagerank_sql(_G2WAY, 5)} select page, round(score, 9) as score from s5")
def pagerank_two_way(spark, sf):
    r = pagerank(*_two_way(spark, sf), max_iterations=5, max_residual=0.0)
    return r.scores.select("page", F.round("score", 9).alias("score"))


@query(f"{_pagerank_sql(_G2WAY, 4)} select 4::bigint as iterations, round(sum(abs(s4.score - s3.score)), 9) as residual from s4 join s3 using (page)")
def pagerank_residual(spark, sf):
    r = pagerank(*_two_way(spark, sf), max_iterations=4, max_residual=0.0)
    return spark.range(1).select(F.lit(r.iterations).cast("long").alias("iterations"), F.round(F.lit(r.residual), 9).alias("residual"))


@query()
def pagerank_sweeps(spark, sf):
    """In-place sweeps to convergence: order-dependent, so no SQL; tests compare with a plain loop."""
    return pagerank(*graph(spark, sf), mode="gauss_seidel").scores


_CC = f"b as (select l_orderkey as s, l_partkey + {OFFSET} as d from lineitem where l_quantity >= 49 union select l_partkey + {OFFSET}, l_orderkey from lineitem where l_quantity >= 49), cc(n, l) using key (n) as (select s, s from b group by s union select b.d, min(cc.l) from cc join b on b.s = cc.n join recurring.cc r on r.n = b.d where cc.l < r.l group by b.d)"


@query(f"with recursive {_CC} select n as node, l as component from cc")
def components(spark, sf):
    return star_components(sparse_graph(spark, sf), "src", "dst")


@query(f"with recursive {_CC} select count(distinct l) as n from cc")
def component_count(spark, sf):
    return star_components(sparse_graph(spark, sf), "src", "dst").agg(F.count_distinct("component").alias("n"))


@query(f"with recursive {_CC} select l as component, count(*) as size from cc group by l")
def component_sizes_sparse(spark, sf):
    return component_sizes(star_components(sparse_graph(spark, sf), "src", "dst"))


@query("select id as node, 0::bigint as component from range((select count(*) from part) + (select count(*) from supplier)) r(id)")
def components_min_label(spark, sf):
    return connected_components(*graph(spark, sf), method="min_label").labels


@query("select o_orderkey % 40 as node, o_orderkey % 40 % 8 as component from orders group by 1")
def components_with_isolated(spark, sf):
    """Links n -> n + 8 below 40: chains by remainder; every node is a row."""
    edges = _table(spark, sf, "orders").select((F.col("o_orderkey") % 32).alias("src"), (F.col("o_orderkey") % 32 + 8).alias("dst"))
    return connected_components(edges, 40).labels


# Extensions


@query(f"with {M_SQL} select d0 as pos, sum(val * (d1 + 1)) as val from m group by d0")
def spmv(spark, sf):
    x = _table(spark, sf, "supplier").select(F.col("s_suppkey").alias("pos"), (F.col("s_suppkey") + 1.0).alias("val"))
    return algebra.spmv(matrix(spark, sf), x)


@query("with h as (select l_suppkey as d0, l_linenumber::bigint as d1, sum(l_quantity) as val from lineitem where l_suppkey >= l_linenumber group by 1, 2) select d0, d1, val from h union all select d1, d0, val from h where d0 <> d1")
def symmetric_expand(spark, sf):
    df = _table(spark, sf, "lineitem").where("l_suppkey >= l_linenumber").groupBy(F.col("l_suppkey").alias("d0"), F.col("l_linenumber").cast("long").alias("d1")).agg(F.array(F.sum("l_quantity")).alias("vals"))
    n = _sizes(spark, sf)[1]
    return ingest.expand_symmetric(CooTensor(df, TensorMeta(MatrixType("CRS"), "f64", (n, n, 1), (1, 0, 2)))).scalar


@query("with h as (select l_suppkey as d0, l_linenumber::bigint as d1, sum(l_quantity) as val from lineitem where l_suppkey > l_linenumber group by 1, 2) select d0, d1, val from h union all select d1, d0, -val from h")
def skew_expand(spark, sf):
    df = _table(spark, sf, "lineitem").where("l_suppkey > l_linenumber").groupBy(F.col("l_suppkey").alias("d0"), F.col("l_linenumber").cast("long").alias("d1")).agg(F.array(F.sum("l_quantity")).alias("vals"))
    n = _sizes(spark, sf)[1]
    return ingest.expand_symmetric(CooTensor(df, TensorMeta(MatrixType("CRK"), "f64", (n, n, 1), (1, 0, 2)))).scalar


# Scalar functions


@query("select o_orderkey as n, case when o_orderkey = 0 then 4294967295 else length(bin(o_orderkey)) - 1 end::bigint as log2 from orders")
def log2_floor_orders(spark, sf):
    return _table(spark, sf, "orders").select(F.col("o_orderkey").alias("n"), log2_floor(F.col("o_orderkey")).alias("log2"))


@query("select o_orderkey as a, o_custkey % 5 as b, case when o_orderkey = 0 then 0 when o_custkey % 5 = 0 then 9223372036854775807 else (o_orderkey + o_custkey % 5 - 1) // (o_custkey % 5) end::bigint as q from orders")
def ceil_div_orders(spark, sf):
    b = F.col("o_custkey") % 5
    return _table(spark, sf, "orders").select(F.col("o_orderkey").alias("a"), b.alias("b"), ceil_div(F.col("o_orderkey"), b).alias("q"))


@query(f"select o_orderkey as v, {_WIDTH('o_orderkey * 1000')}::bigint as bytes from orders")
def encode_size_orders(spark, sf):
    return _table(spark, sf, "orders").select(F.col("o_orderkey").alias("v"), encode_size(F.col("o_orderkey") * 1000).alias("bytes"))


from . import format_queries  # noqa: E402, F401  registers its queries here
