"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words. A document's expected number of copies is its
source's target over its source's size. Along each source's documents the expected copies
are summed up, one random offset is added, and a document is emitted once for each
integer that its step of the sum crosses: at most one copy off its expectation. The offset
comes from the seed and the source's place; nothing is tried out.

Documents are laid out by size, largest first, so that what a document gets too much its
neighbour of about the same size gets too little, and a source's words miss its target by
about one large document at most. A prefix sum over a source would put a hot source in one
task; as the expectation is the same in all of a source, the sum is a rank. Ranks
are built from counts: documents per (source, size) are counted first and only these counts (one a distinct
size) are summed along the source. Within a cell of n documents, rows of one id count as units of up to UNIT rows; units
are dealt by a hash to lanes of about LANE rows or sqrt(n), whichever is more, the lanes' counts are summed, and only then
are units numbered, within a lane. No id, null or repeated or in even steps, makes a lane longer than its share.

Sources are numbered by a range-partitioned sort, and the level at which targets stop is found by a few
aggregations over the table of sources, so there may be as many sources as documents.

DataFrame functions only. Nulls: a null text has size 0; a null source is a source of its
own and comes last; a null doc_id comes first within its lane. Repeated rows are documents
of their own. A source of size 0 has target 0, its documents expect no copy. Ids may be of any type that sorts. An empty
table has an empty mix. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.access import with_ordinal
from ..storage import cut

WEIGHTS = (5, 2, 1)
MOST = 3  # times a source's size that its target may be
LANE = 1000  # rows that are numbered in one group, about, at least
UNIT = 1000  # rows of one id that are numbered as one
WORD = r"[^\x20\x09-\x0D]+"
SEED = 20_011


def n_words(text: Column) -> Column:
    """Number of words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source: source, place, weight, source_size, target, from rows (source, words).

    Sources by code point, null last, take the weights in turn and share all words. A
    target stops at ``most`` times its size and the excess is shared anew: the common level (words
    per weight) is the total over all weights at first, and then what stopped sources leave of the total over the
    weights of the others, until no further source stops. Each step is one aggregation.
    """
    placed = with_ordinal(sizes.select("source", "words", F.col("source").isNull().alias("none")), ["none", "source"], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    placed = cut(placed.select("source", (F.col("place") + 1).alias("place"), weight.alias("weight"), "words", (most * F.col("words")).alias("cap")), "sources")
    total, rest = placed.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1))).first()
    level, stopped = total / rest, 0
    while True:
        over = F.lit(level) * F.col("weight") > F.col("cap")
        n, held, free = placed.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == stopped or not free:
            break
        level, stopped = (total - held) / free, n
    return placed.select("source", "place", "weight", F.col("words").alias("source_size"), F.least(F.lit(level) * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def _draw(of: Column) -> Column:
    """A random whole number below 2**32 by a text."""
    return F.conv(F.substring(F.md5(of.cast("binary")), 1, 8), 16, 10).cast("long")


def offset(place: Column, seed: int) -> Column:
    """The random offset of a source, in [0, 1)."""
    return _draw(F.concat(F.lit(f"{seed}/"), place.cast("string"))) / F.lit(4294967296.0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, lane: int = LANE, unit: int = UNIT) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (copies times size)."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col).cast("string")).alias("size"))
    units = cut(sized.groupBy("source", "size", "doc_id").agg(F.count("*").alias("k")), "units")
    counts = units.groupBy("source", "size").agg(F.sum("k").alias("n"))
    plan = targets(counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words")), weights, most)
    down = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.withColumn("before", F.coalesce(F.sum("n").over(down), F.lit(0))).withColumn("lanes", F.ceil(F.col("n") / F.greatest(F.lit(float(lane)), F.sqrt("n")))).alias("c")
    cells = cells.join(plan.alias("p"), F.col("c.source").eqNullSafe(F.col("p.source"))).select("c.*", "place", "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    cells = cut(cells.withColumn("rate", rate).withColumn("u", offset(F.col("place"), seed)), "cells")

    rows = units.alias("s").join(cells.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")) & (F.col("s.size") == F.col("c.size"))).select("s.*", "before", "lanes", "place", "source_size", "target", "rate", "u")
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("k") - 1, F.lit(unit))))).withColumn("k", F.least(F.lit(unit), F.col("k") - F.col("part") * unit))
    hashed = _draw(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("part").cast("string")))
    rows = rows.withColumn("lane", F.when(F.col("lanes") > 1, hashed % F.col("lanes")).otherwise(F.lit(0)))
    many = rows.where("lanes > 1").groupBy("place", "size", "lane").agg(F.sum("k").alias("m"))
    along = Window.partitionBy("place", "size").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = many.select("place", "size", "lane", F.coalesce(F.sum("m").over(along), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("place", "size", "lane").orderBy(F.col("doc_id").asc_nulls_first(), "part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.join(lanes, ["place", "size", "lane"], "left").withColumn("first", F.col("before") + F.coalesce("ahead", F.lit(0)) + F.coalesce(F.sum("k").over(within), F.lit(0)))
    each = ranked.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k").cast("int")))).withColumn("rank", F.col("first") + F.col("i"))
    copies = F.floor(F.col("rate") * F.col("rank") + F.col("u")) - F.floor(F.col("rate") * (F.col("rank") - 1) + F.col("u"))
    return each.withColumn("copies", F.least(copies, F.lit(most)).cast("long")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: what the mix takes of every document."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", "taken")


ORACLE = f"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size from documents),
src as (
  select source, sum(size)::bigint as words, row_number() over (order by source asc nulls last) as place from sized group by source),
w as (
  select *, case (place - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight, {MOST} * words as cap from src),
lv as (
  select *, ((sum(words) over () - coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0))::double) as level from w),
cm as (
  select level as common from lv where level * weight <= cap order by cap / weight, place limit 1),
plan as (
  select source, place, words as source_size, least(coalesce((select common from cm) * weight, cap::double), cap::double) as target from lv),
parts as (
  select s.doc_id, s.source, s.size, count(*) over (partition by s.source, s.size) as n,
    (row_number() over (partition by s.source, s.size, s.doc_id) - 1) // {UNIT} as part from sized s),
lanes as (
  select *, case when k > 1 then ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || part), 1, 8))::bigint % k else 0 end as lane
  from (select *, ceil(n / greatest({LANE}::double, sqrt(n)))::bigint as k from parts)),
numbered as (
  select l.doc_id, l.size, p.place, p.source_size, p.target,
    row_number() over (partition by p.place order by l.size desc, l.lane, l.doc_id nulls first, l.part) as rk
  from lanes l join plan p on l.source is not distinct from p.source),
stepped as (
  select *, case when source_size > 0 then target / source_size else 0.0::double end as rate,
    ('0x' || substr(md5('{SEED}/' || place), 1, 8))::bigint / 4294967296.0::double as u from numbered)
select doc_id, size, source_size, target,
  (least(floor(rate * rk + u) - floor(rate * (rk - 1) + u), {MOST}) * size)::bigint as taken
from stepped
"""
