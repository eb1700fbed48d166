"""Queries that write tables in each file format and read them back, and those of smaller helpers.

They register themselves beside the queries of :mod:`gridloom.queries`.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import functions as F

from .functions import text
from .functions.scalars import format_value, format_vector, parse_vector
from .meta import MatrixType, TensorMeta
from .operators import access, compare, dense, encode, layout
from .plans.components import connected_components
from .plans.pagerank import pagerank, top_k
from .queries import _CC, _G, _GRID, M_SQL, OFFSET, T_SQL, _OFFSETS, _pagerank_sql, _sizes, _table, entries, graph, matrix, query, sparse_graph, tensor
from .sources.mtx import read_meta as mtx_meta
from .sources.mtx import read_mtx, write_mtx, write_mtx_array
from .sources.prm import read_prm, read_prm_meta, write_prm
from .sources.store import convert, read_meta, read_tensor, write_tensor
from .storage import cut, fresh_path
from .tensor import CooTensor, from_columns


def _path(spark, name: str) -> str:
    return fresh_path(spark, "file") + name


def _pair(t: CooTensor):
    return t.df.select(*t.meta.coords, F.get("vals", F.lit(0)).alias("v0"), F.get("vals", F.lit(1)).alias("v1"))


def _told(spark, m: TensorMeta):
    """Metadata as one row."""
    return spark.createDataFrame([(m.matrix_type.long_name, m.value_type, str(list(m.shape)), str(list(m.order)), m.rows, m.cols, m.nnz, m.index_dim)], "type string, value_type string, shape string, storage string, rows long, cols long, nnz long, index_dim long")


# Matrix Market


@query(f"with {M_SQL} select d0, d1, val from m")
def mtx_round_trip(spark, sf):
    write_mtx(matrix(spark, sf), path := _path(spark, ".mtx"))
    return read_mtx(spark, path).scalar


@query("select l_orderkey as d0, l_linenumber::bigint as d1, max(l_discount) as val from lineitem group by 1, 2 having max(l_discount) <> 0")
def mtx_drops_zeros(spark, sf):
    t = entries(spark, sf)  # a line number may repeat in an order; a file may not
    once = t.df.groupBy("d0", "d1").agg(F.array(F.max(F.get("vals", F.lit(0)))).alias("vals"))
    write_mtx(CooTensor(once, t.meta), path := _path(spark, ".mtx"))
    return read_mtx(spark, path).scalar


@query(f"with {T_SQL} select d0, d1, d2, v0, v1 from t")
def mtx_tensor_round_trip(spark, sf):
    """Three dimensions and depth 2 by the header's extension."""
    write_mtx(tensor(spark, sf), path := _path(spark, ".mtx"))
    return _pair(read_mtx(spark, path))


@query("select o_orderkey as d0, o_custkey as d1, o_totalprice as re, (o_orderkey % 7)::double as im from orders")
def mtx_complex_round_trip(spark, sf):
    df = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("d0"), F.col("o_custkey").alias("d1"), F.array(F.struct(F.col("o_totalprice").alias("re"), (F.col("o_orderkey") % 7).cast("double").alias("im"))).alias("vals"))
    write_mtx(CooTensor(df, TensorMeta(MatrixType("CCG"), "c64", (1 << 40, 1 << 40, 1), (1, 0, 2))), path := _path(spark, ".mtx"))
    return read_mtx(spark, path).df.select("d0", "d1", F.col("vals")[0]["re"].alias("re"), F.col("vals")[0]["im"].alias("im"))


@query(f"with {_G} select src as d0, dst as d1 from e")
def mtx_pattern_round_trip(spark, sf):
    edges, n = graph(spark, sf)
    t = CooTensor(edges.select(F.col("src").alias("d0"), F.col("dst").alias("d1")), TensorMeta(MatrixType("CPG"), "f64", (n, n, 1), (1, 0, 2)))
    write_mtx(t, path := _path(spark, ".mtx"))
    return read_tensor(spark, path).df


@query(f"with {T_SQL} select 'coordinate real general' as type, 'f64' as value_type, '[50, ' || n1 || ', 8, 2]' as shape, '[0, 2, 1, 3]' as storage, 50::bigint as rows, 8::bigint as cols, (select count(*) from t) as nnz, 0::bigint as index_dim from sz")
def mtx_header_probe(spark, sf):
    write_mtx(tensor(spark, sf), path := _path(spark, ".mtx"))
    return _told(spark, mtx_meta(spark, path))


@query(f"with {M_SQL} select d0, d1, val from m where d0 <> d1")
def mtx_array_round_trip(spark, sf):
    """An array file: every cell a line in column-major order; zeros are dropped."""
    t = matrix(spark, sf)
    write_mtx_array(CooTensor(t.df.where("d0 <> d1"), t.meta), path := _path(spark, ".mtx"))
    return read_mtx(spark, path).scalar


# .prm and Parquet


@query(f"with {M_SQL} select d0, d1, val from m")
def prm_round_trip(spark, sf):
    write_prm(matrix(spark, sf), path := _path(spark, ".prm"))
    return read_prm(spark, path).scalar


@query(f"with {T_SQL} select d0, d1, d2, v0, v1 from t")
def prm_tensor_round_trip(spark, sf):
    write_prm(tensor(spark, sf), path := _path(spark, ".prm"))
    return _pair(read_tensor(spark, path))


@query(f"with {M_SQL} select 'coordinate real general' as type, 'f64' as value_type, '[' || n0 || ', ' || n1 || ', 1]' as shape, '[1, 0, 2]' as storage, n0 as rows, n1 as cols, (select count(*) from m) as nnz, 1::bigint as index_dim from sz")
def prm_header_probe(spark, sf):
    write_prm(matrix(spark, sf), path := _path(spark, ".prm"))
    return _told(spark, read_prm_meta(path))


@query(f"with {T_SQL} select d0, d1, d2, v0, v1 from t")
def parquet_round_trip(spark, sf):
    write_tensor(tensor(spark, sf), path := _path(spark, ""))
    return _pair(read_tensor(spark, path))


@query(f"with {M_SQL} select d0, d1, val from m where d1 = 7")
def parquet_lazy_slice(spark, sf):
    """A slice of a stored tensor: the filter and the columns reach the scan."""
    write_tensor(matrix(spark, sf), path := _path(spark, ""))
    t = read_tensor(spark, path)
    return CooTensor(access.index_slice(t, 7), t.meta).scalar


@query(f"with {M_SQL} select 'coordinate real general' as type, 'f64' as value_type, '[' || n0 || ', ' || n1 || ', 1]' as shape, '[0, 1, 2]' as storage, n0 as rows, n1 as cols, (select count(*) from m) as nnz, 0::bigint as index_dim from sz")
def convert_to_rows(spark, sf):
    """Matrix Market to Parquet laid out by the other dimension; its sidecar."""
    write_mtx(matrix(spark, sf), source := _path(spark, ".mtx"))
    convert(spark, source, target := _path(spark, ""), 0)
    return _told(spark, read_meta(spark, target))


@query(f"with {M_SQL} select row_number() over (order by d0, d1) - 1 as idx, d0, d1, val from m")
def convert_to_rows_order(spark, sf):
    write_prm(matrix(spark, sf), source := _path(spark, ".prm"))
    convert(spark, source, target := _path(spark, ""), 0)
    return access.ordinals(read_tensor(spark, target)).select("idx", "d0", "d1", "val")


@query(f"with {M_SQL}, h as (select *, row_number() over (order by d1, d0) as o from m), l as (select * from h where o <= 5), w as (select 0 as i, 'type: coordinate real general' as line union all select 1, 'data type: f64' union all select 2, 'shape: [' || n0 || ', ' || n1 || ', 1]' from sz union all select 3, 'order: [1, 0, 2]' union all select 4, 'nnz: ' || (select count(*) from m) union all select 5, 'd1: [' || string_agg(d1, ', ' order by o) || ', ...]' from l union all select 6, 'd0: [' || string_agg(d0, ', ' order by o) || ', ...]' from l union all select 7, 'data: [' || string_agg(val, ', ' order by o) || ', ...]' from l) select i::bigint as i, line from w")
def describe_lines(spark, sf):
    lines = compare.describe(matrix(spark, sf), 5).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "i long, line string")


@query(f"with {M_SQL} select count(*) as entries, (select max(d0) + 1 from m) as rows, (select max(d1) + 1 from m) as cols from m")
def tensor_from_columns(spark, sf):
    """A tensor from a table's columns, its shape found from them."""
    t = from_columns(matrix(spark, sf).scalar, ["d0", "d1"], ["val"])
    return spark.createDataFrame([(t.count(), t.meta.shape[0], t.meta.shape[1])], "entries long, rows long, cols long")


# Ranges


@query("select id as range_id, 3::bigint as min_pos, (select count(*) from part) as max_pos from range(4) r(id)")
def range_cloned(spark, sf):
    return layout.clone_range(spark, 4, _sizes(spark, sf)[0], 3)


@query(f"with {M_SQL}, n as (select count(*) as n from m) select x::bigint as most, greatest(1, least((n + x - 1) // x, 16))::bigint as ranges from n, (select unnest([1, 1000, 20000, 100000000]) as x)")
def range_count(spark, sf):
    n = matrix(spark, sf).count()
    return spark.createDataFrame([(x, layout.max_ranges(n, x, 16)) for x in (1, 1000, 20_000, 100_000_000)], "most long, ranges long")


@query(f"with {M_SQL} select count(*) as nnz, min(d0) as least, max(d0) + 1 as top, true as in_order from m")
def range_of_partitions(spark, sf):
    """What the partitions of a laid out tensor hold together; their ranges follow one another."""
    laid = layout.reindex(matrix(spark, sf), partitions=6)
    parts = cut(layout.partition_ranges(laid.df, "d0"), "parts").collect()
    parts.sort(key=lambda r: r["part"])
    ordered = all(a["max_pos"] <= b["min_pos"] + 1 for a, b in zip(parts, parts[1:], strict=False))
    return spark.createDataFrame([(sum(r["nnz"] for r in parts), min(r["min_pos"] for r in parts), max(r["max_pos"] for r in parts), ordered)], "nnz long, least long, top long, in_order boolean")


_GREEDY = """, o as (select id as pos, (coalesce(sum(n) over (order by id rows between unbounded preceding and 1 preceding), 0))::bigint as start from (select id, count(d1) as n from range((select max(d1) + 2 from m)) r(id) left join m on id = d1 group by id)),
top as (select max(pos) as fin, max(start) as total, (max(start) + 7) // 8 as most from o),
r(range_id, min_pos, max_pos) as (
  select 0::bigint, 0::bigint, (select coalesce(max(pos), 1) from o, top where pos > 0 and start <= most)
  union all
  select range_id + 1, max_pos, case when range_id + 1 = 7 then fin else coalesce((select max(pos) from o, top t2 where pos > r.max_pos and start <= t2.most + (select start from o o2 where o2.pos = r.max_pos)), r.max_pos + 1) end
  from r, top where r.max_pos < fin)
select range_id, min_pos, max_pos, (select start from o where pos = max_pos) - (select start from o where pos = min_pos) as nnz from r"""


@query(f"with recursive {M_SQL}{_GREEDY}")
def range_nnz_greedy(spark, sf):
    return layout.nnz_greedy(matrix(spark, sf), 8)


# Encoded arrays


@query(f"with {M_SQL}, {_OFFSETS} select pos, start as val from off")
def decode_sketched(spark, sf):
    """Every item of an index decoded from its block's first value and its difference."""
    off = cut(layout.offsets(matrix(spark, sf), 0), "offsets")
    stored = encode.sketched(off, "pos", "start", 5)
    return stored.select("pos", encode.decode(F.col("delta"), F.col("first"), F.lit(0)).alias("val"))


@query("with a as (select o_orderkey as idx, o_custkey as v from orders), n as (select max(idx) + 1 as n from a), b as (select c_custkey + n as idx, c_custkey * 3 as v from customer, n) select count(*) as n, min(v) as min_value, max(v) as max_value, max(idx) as last from (select * from a union all select * from b)")
def append_arrays(spark, sf):
    a = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_custkey").alias("v"))
    b = _table(spark, sf, "customer").select(F.col("c_custkey").alias("idx"), (F.col("c_custkey") * 3).alias("v"))
    both = encode.append(a, b)
    return encode.width_stats(both, "v").select("n", "min_value", "max_value").crossJoin(both.agg(F.max("idx").alias("last")))


@query("select o_custkey as pos, count(*)::bigint as n from orders group by 1")
def increment_items(spark, sf):
    return encode.increment(_table(spark, sf, "orders").select(F.col("o_custkey").alias("pos"), F.lit(1).cast("long").alias("n")), "pos")


@query(f"with {T_SQL}, {_GRID} select g.d0, g.d1, g.d2, depth, case when g.d0 = 3 and depth = 1 then (g.d1 * 100 + g.d2)::double else coalesce(case depth when 0 then v0 else v1 end, 0) end as val from g left join t on g.d0 = t.d0 and g.d1 = t.d1 and g.d2 = t.d2")
def dense_set_values(spark, sf):
    t = tensor(spark, sf)
    cells = dense.to_dense(t)
    new = cells.where("d0 = 3 and depth = 1").select("d0", "d1", "d2", "depth", (F.col("d1") * 100 + F.col("d2")).cast("double").alias("val"))
    return dense.set_value(cells, t.meta.coords, new).select("d0", "d1", "d2", "depth", "val")


# Text


@query("select o_orderkey as k, printf('%.6g', o_totalprice * 10) as price, printf('%.6g', o_totalprice / 100000000) as small, '(' || printf('%.6g', o_totalprice) || ', ' || printf('%.6g', (o_orderkey % 7)::double) || ')' as pair from orders")
def format_numbers(spark, sf):
    price = F.col("o_totalprice")
    pair = F.struct(price.alias("re"), (F.col("o_orderkey") % 7).cast("double").alias("im"))
    return _table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), format_value(price * 10).alias("price"), format_value(price / 100_000_000).alias("small"), format_value(pair, "c64").alias("pair"))


@query("select o_orderkey as k, '[' || o_orderkey || ', ' || o_custkey || ', ...]' as two, '[' || o_orderkey || ', ' || o_custkey || ', ' || (o_orderkey + 1) || ']' as whole from orders")
def format_vectors(spark, sf):
    xs = F.array("o_orderkey", "o_custkey", F.col("o_orderkey") + 1)
    return _table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), format_vector(xs, 2).alias("two"), format_vector(xs).alias("whole"))


@query("select o_orderkey as k, o_orderkey as a, o_custkey as b, 2::bigint as n from orders")
def parse_vectors(spark, sf):
    df = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.format_string("( %d,%d )", "o_orderkey", "o_custkey").alias("t"))
    return df.select("k", parse_vector(F.col("t")).alias("v")).select("k", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"), F.size("v").cast("long").alias("n"))


@query("select n_nationkey::bigint as k, replace(n_name, ' ', '') as squeezed, n_nationkey || ',' || n_regionkey as pair, 'name' || n_nationkey || '.i1.prm' as path, 'out/name' || n_nationkey || '.i0.prm' as other from nation")
def header_and_path_helpers(spark, sf):
    """The helpers that parse headers and name files, on each nation."""
    out = []
    for r in _table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").collect():
        d = text.parse_dict(f"[a:({r[0]},{r[2]});b:x]")
        a, b = text.parse_ints(d["a"])
        path = text.layout_path(f"dir/name{r[0]}.mtx", "out", 1)
        out.append((r[0], text.remove_white_space(r[1]), f"{a},{b}", posixpath.basename(path), text.layout_path_after_change(path)))
    return spark.createDataFrame(out, "k long, squeezed string, pair string, path string, other string")


# Results of the graph programs


@query("select true as converged, true as ran, 0::bigint as propagations, 1::bigint as components")
def components_run(spark, sf):
    r = connected_components(*graph(spark, sf), method="min_label")
    return r.labels.agg(r.components.alias("components")).select(F.lit(r.converged).alias("converged"), F.lit(r.iterations > 1).alias("ran"), F.lit(r.propagations).cast("long").alias("propagations"), "components")


@query(f"with recursive {_CC}, n as (select max(o_orderkey) as top from orders) select id as node, coalesce(l, id)::bigint as component from range((select {OFFSET} + count(*) from part)) r(id) left join cc on n = id where id <= (select top from n) or id >= {OFFSET}")
def components_with_isolated_orders(spark, sf):
    """Orders and parts with links of large quantities only: most orders have none and stand alone."""
    edges = sparse_graph(spark, sf)
    top = _table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0]
    labels = connected_components(edges, OFFSET + _sizes(spark, sf)[0]).labels
    return labels.where((F.col("node") <= top) | (F.col("node") >= OFFSET))


@query(f"with recursive {_CC}, f as (select n, l from cc order by n limit 25) select n || ',' || l as line from f")
def component_lines(spark, sf):
    """The first labels as lines of the command line's output."""
    labels = connected_components(sparse_graph(spark, sf), OFFSET + _sizes(spark, sf)[0]).labels
    touched = sparse_graph(spark, sf)
    nodes = touched.select(F.col("src").alias("node")).union(touched.select("dst")).distinct()
    return labels.join(nodes, "node").orderBy("node").limit(25).select(F.concat_ws(",", "node", "component").alias("line"))


@query(f"{_pagerank_sql(_G, 3)} select page || ',' || printf('%.6g', score) as line from (select page, score from s3 order by score desc, page limit 20)")
def pagerank_lines(spark, sf):
    """The best pages as lines of the command line's output."""
    r = pagerank(*graph(spark, sf), max_iterations=3, max_residual=0.0)
    return top_k(r.scores, 20).select(F.concat(F.col("page").cast("string"), F.lit(","), format_value(F.col("score"))).alias("line"))
