"""Benchmark decontamination by winnowing.

Documents and benchmark items are word sequences. Of a document's K-word hashes, the least
in each window of SPAN - K + 1 is kept as a fingerprint, so any run of SPAN words that a
document shares with an item holds at least one fingerprint of the document, and the
item's K-word hashes (all of them) contain it. The fingerprints are joined with the
item's; each hit is extended to the SPAN-word windows around it, and a window counts if its words are an
item's window word for word. Items of fewer than SPAN words are one window; for each such
length the document keeps all hashes of that many words (a winnowing window of one).

The benchmark side decides the work: a bit table of its hashes, of a size bounded by
BITS_MOST, is part of the scan and leaves, besides false hits, only documents that share a
fingerprint; words are written for these alone. The exact joins broadcast the benchmark's
side only where its counted size is below BROADCAST_ROWS and BROADCAST_BYTES.

A text is cut into segments of SEGMENT words before it is cut into words, each with the first SPAN - 1 words of the next, so
a window lies whole in the segment in which it starts and no row grows with a text: words, hashes and windows are
those of one segment. Hits are places, one row each, whatever number of items hold the window; items are looked up once for
each set of windows' item groups that some document has, so places are never multiplied by items.

DataFrame functions only. Arrays are unfolded with the outer forms: for the inner ones the
optimizer infers a filter on the array and copies the chain of array functions into it.

Nulls: a null text has no words. Every row is a document of its own,
repeated ids included; a null item_id counts for hits but is not listed. An empty
benchmark leaves everything clean. A text's length matters only to the number of its segments. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut

SPAN = 13
K = 4
BETWEEN = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
WORD = f"[^{BETWEEN}]+"
SEGMENT = 4096  # words of a segment
SHORT = 1 << 15  # bytes of a text that is one segment without a look
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_MOST = 1 << 22  # bits of the table in the scan, 512 KB
BITS_EACH = 32
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
SHARE = 20  # contaminated: at least one word in SHARE is hit


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; none for null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def segments(text: Column) -> tuple[Column, Callable[[Column], Column]]:
    """A text's parts, and what makes of such an array structs (own, next, last). Parts have A-Z lower-cased
    and SEGMENT words, the last fewer; next are the first SPAN - 1 words that follow.

    Runs are possessive, and a part starts with a word, so a scan never goes back over what it has read.
    """
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    run = f"(?:[^{BETWEEN}]++[{BETWEEN}]*+)"
    parts = F.when(F.octet_length(text) > SHORT, F.regexp_extract_all(low, F.lit(f"{run}{{1,{SEGMENT}}}+"), F.lit(0))).otherwise(F.array(low))
    return parts, lambda p: F.transform(p, lambda s, i: F.struct(s.alias("own"), F.coalesce(F.regexp_extract(F.get(p, i + 1), f"^{run}{{1,{SPAN - 1}}}+", 0), F.lit("")).alias("next"), (i + 1 == F.size(p)).alias("last")))


def _shifted(name: str, by: int, f) -> Column:
    """f of each element of an array column and the one ``by`` places on (null past the end)."""
    return F.transform(name, lambda x, i: f(x, F.get(F.col(name), i + by)))


def with_grams(df: DataFrame) -> DataFrame:
    """Adds ``gram``: for each place, the hash of the K = 4 words from there (fewer at the end)."""
    df = df.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    return df.withColumn("_g", _shifted("_h", 1, F.xxhash64)).withColumn("gram", _shifted("_g", 2, F.xxhash64)).drop("_h", "_g")


def with_prints(df: DataFrame) -> DataFrame:
    """Adds ``prints``: the winnowed fingerprints, least of each SPAN - K + 1 = 10 neighbouring grams."""
    df = with_grams(df).withColumn("_a", _shifted("gram", 1, F.least))
    df = df.withColumn("_b", _shifted("_a", 2, F.least)).withColumn("_c", _shifted("_b", 4, F.least))
    return df.withColumn("prints", F.array_distinct(_shifted("_c", 2, F.least))).drop("gram", "_a", "_b", "_c")


def _slices(n: int) -> Column:
    """The hash of the n words at each place where n words are; n is part of the hash."""
    last = F.size("words") - n
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.slice(F.col("words"), i + 1, n), F.lit(n))))


def _bit(h: Column, probe: int, bits: int) -> Column:
    """A place in the bit table; one of three, from different parts of the hash."""
    return F.shiftrightunsigned(h, 20 * probe).bitwiseAND(bits - 1)


def _bit_table(prints: DataFrame, n: int) -> tuple[list[int], int]:
    """The bit table of the benchmark's hashes as 64-bit words (at most BITS_MOST bits), and its size."""
    bits = 1 << 12
    while bits < min(BITS_EACH * n, BITS_MOST):
        bits *= 2
    places = prints.select(F.explode(F.array(*(_bit(F.col("fp"), p, bits) for p in range(3)))).alias("b")).distinct()
    rows = places.selectExpr("shiftright(b, 6) as at", "shiftleft(1L, cast(b & 63 as int)) as bit").groupBy("at").agg(F.bit_or("bit").alias("w")).collect()
    table = [0] * (bits // 64)
    for r in rows:
        table[r["at"]] = r["w"]
    return table, bits


def _may_hold(prints: str, table: list[int], bits: int) -> Column:
    """Whether any fingerprint has all its bits in the table."""
    lit = F.expr("array(" + ",".join(f"{x}L" if x != -(1 << 63) else "(-9223372036854775807L - 1L)" for x in table) + ")")
    has = lambda h, p: F.getbit(F.get(lit, F.shiftright(_bit(h, p, bits), 6).cast("int")), _bit(h, p, bits).bitwiseAND(63).cast("int")) == 1
    return F.exists(prints, lambda h: has(h, 0) & has(h, 1) & has(h, 2))


def _small(df: DataFrame, n_bytes: Column) -> DataFrame:
    """The frame, marked for broadcast if its counted size allows."""
    rows, size = df.agg(F.count("*"), F.sum(n_bytes)).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def _cut_up(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (rid, doc_id, seg, last, words, own): a segment's words with those that follow; own of them are its own."""
    parts, linked = segments(F.col("text"))
    df = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    df = df.withColumn("p", parts).select("rid", "doc_id", "p").withColumn("p", linked(F.col("p")))
    df = df.select("rid", "doc_id", F.posexplode_outer("p").alias("seg", "x"))
    last = F.coalesce("x.last", F.lit(True))
    df = df.select("rid", "doc_id", F.coalesce("seg", F.lit(0)).alias("seg"), last.alias("last"), words(F.concat("x.own", "x.next")).alias("words"))
    return df.withColumn("own", F.when(F.col("last"), F.size("words")).otherwise(F.lit(SEGMENT)))


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, spans, groups).

    base: rid, doc_id, n_words of every document. spans: rid, seg, own, start, n, gid of every place of a document at which
    a window starts; start counts within the segment, gid names the items that hold the window. groups: gid, item_id.
    """
    items = cut(benchmark.select(F.col(item_col).cast("string").alias("item_id"), words(F.col(item_text).cast("string")).alias("words")).where(F.size("words") > 0), "items")
    short = sorted(r[0] for r in items.where(F.size("words") < SPAN).select(F.size("words")).distinct().collect())
    long_items = items.where(F.size("words") >= SPAN)

    grams = with_grams(long_items).select(F.explode_outer(F.slice("gram", 1, F.size("words") - K + 1)).alias("fp")).where("fp is not null")
    windows = long_items.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - SPAN + 1), lambda i: F.array_join(F.slice(F.col("words"), i, SPAN), " "))).alias("w"))
    for n in short:
        own = items.where(F.size("words") == n)
        grams = grams.union(own.select(F.explode_outer(_slices(n)).alias("fp")).where("fp is not null"))
        windows = windows.union(own.select("item_id", F.array_join("words", " ").alias("w")))
    grams, windows = cut(grams.distinct(), "grams"), cut(windows.distinct(), "windows")
    table, bits = _bit_table(grams, grams.count())
    # A set of items is told by its size and two sums of hashes, so it is never collected.
    total = lambda *x: F.coalesce(F.sum(F.xxhash64(*x).cast("decimal(38,0)")), F.lit(0)).cast("string")
    listed = F.col("item_id").isNotNull()
    kinds = cut(windows.groupBy("w").agg(F.concat_ws(":", F.count("item_id").cast("string"), *(total(F.when(listed, F.xxhash64("item_id", F.lit(salt)))) for salt in (0, 1))).alias("gid")), "kinds")
    groups = cut(windows.where(listed).join(kinds, "w").select("gid", "item_id").distinct(), "groups")

    base = with_prints(_cut_up(docs, id_col, text_col))
    if short:
        base = base.withColumn("prints", F.concat("prints", *(F.array_distinct(_slices(n)) for n in short)))
    near = F.col("near")
    base = base.withColumn("near", _may_hold("prints", table, bits)).select("rid", "doc_id", "seg", "last", "own", F.when(near, F.col("words")).alias("words"), F.when(near, F.col("prints")).alias("prints"))
    base = cut(base, "screened")

    at = ["rid", "seg"]
    hits = cut(base.where("prints is not null").select(*at, F.explode("prints").alias("fp")).join(_small(grams, F.lit(8)), "fp", "left_semi").distinct(), "hits")
    found = base.where("words is not null").select(*at, "own", "words").join(hits.select(*at).distinct(), at, "left_semi")
    seeds = [(K, SPAN, with_grams(found).select(*at, F.posexplode_outer("gram").alias("pos", "fp")))] + [(n, n, found.select(*at, F.posexplode_outer(_slices(n)).alias("pos", "fp"))) for n in short]
    starts = None
    for k, n, places in seeds:
        met = places.join(hits, [*at, "fp"], "left_semi")
        one = met.select(*at, F.lit(n).alias("n"), F.explode(F.sequence(F.greatest(F.col("pos") - (n - k), F.lit(0)), F.col("pos"))).alias("start"))
        starts = one if starts is None else starts.union(one)
    starts = starts.groupBy(*at).agg(F.collect_set(F.struct("start", "n")).alias("starts"))  # of one segment
    whole = F.filter("starts", lambda s: (s["start"] < F.col("own")) & (s["start"] + s["n"] <= F.size("words")))
    tried = found.join(starts, at).select(*at, "own", F.explode(F.transform(whole, lambda s: F.struct(s["start"].alias("start"), s["n"].alias("n"), F.array_join(F.slice(F.col("words"), s["start"] + 1, s["n"]), " ").alias("w")))).alias("x")).select(*at, "own", "x.*")
    spans = cut(tried.join(_small(kinds, F.length("w") + 128), "w").select(*at, "own", "start", "n", "gid"), "spans")
    lengths = base.where("last").select("rid", "doc_id", (F.col("seg").cast("long") * SEGMENT + F.col("own")).alias("n_words"))
    return lengths, spans, groups


def judge(docs: DataFrame, benchmark: DataFrame, **cols: str) -> tuple[DataFrame, DataFrame]:
    """(found, sets): a row rid, doc_id, n_words, n_hit, n_spans, sid, contaminated per document; sid, items (sorted) per set of items.

    n_spans counts the windows of SPAN words; sid is null where nothing is hit.
    """
    base, spans, groups = find_hits(docs, benchmark, **cols)
    end = F.col("start") + F.col("n")
    range_ = lambda seg, lo, hi, full: F.struct(seg.alias("seg"), lo.alias("lo"), hi.alias("hi"), full.cast("long").alias("full"))
    both = F.array(range_(F.col("seg"), F.col("start"), F.least(end, F.col("own")), F.col("n") == SPAN), range_(F.col("seg") + 1, F.lit(0), end - F.col("own"), F.lit(False)))
    parts = spans.select("rid", F.explode(F.filter(both, lambda r: r["lo"] < r["hi"])).alias("r")).select("rid", "r.*")
    held = parts.groupBy("rid", "seg").agg(F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("lo"), F.col("hi") - 1))))).alias("n"), F.sum("full").alias("full"))
    covered = held.groupBy("rid").agg(F.sum("n").alias("n_hit"), F.sum("full").alias("n_spans"))

    gids = spans.select("rid", "gid").distinct().groupBy("rid").agg(F.array_sort(F.collect_list("gid")).alias("gids")).withColumn("sid", F.sha2(F.array_join("gids", ","), 256))
    gids = cut(gids, "gids")
    sets = gids.dropDuplicates(["sid"]).select("sid", F.explode("gids").alias("gid")).join(groups, "gid").select("sid", "item_id").distinct()
    sets = cut(sets.groupBy("sid").agg(F.array_sort(F.collect_list("item_id")).alias("items")), "sets")
    out = base.join(covered.join(gids.select("rid", "sid"), "rid"), "rid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select("rid", "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), "sid", ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated")), sets


def _with_sets(found: DataFrame, sets: DataFrame, n_bytes: Column) -> DataFrame:
    """``found`` with what ``sets`` says of its sid; rows without one have keys of their own, so that a shuffle spreads them."""
    key = F.coalesce("sid", F.concat(F.lit("-"), F.col("rid").cast("string")))
    return found.withColumn("key", key).join(_small(sets.withColumnRenamed("sid", "key"), n_bytes), "key", "left")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **cols: str) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_spans, n_items, items (sorted), contaminated."""
    found, sets = judge(docs, benchmark, **cols)
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return _with_sets(found, sets, F.size("items") * 24 + 80).select("doc_id", "n_words", "n_hit", "n_spans", F.size(listed).cast("long").alias("n_items"), listed.alias("items"), "contaminated")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: hit words and items of every document."""
    found, sets = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    told = sets.select("sid", F.size("items").cast("long").alias("k"), F.sha2(F.array_join("items", ","), 256).alias("digest"))
    none = F.sha2(F.lit(""), 256)
    return _with_sets(found, told, F.lit(160)).select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_hit", F.coalesce("k", F.lit(0)).alias("n_items"), F.coalesce("digest", none).alias("items_sha256"), "contaminated")


ORACLE = f"""
with d as (
  select doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}'), []) as w, row_number() over () as rid from documents),
b as (
  select item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') as w from benchmark where text is not null),
bw as (
  select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as g
  from (select item_id, w, least(len(w), {SPAN}) as n, unnest(range(1, len(w) - least(len(w), {SPAN}) + 2)) as i from b where len(w) > 0)),
lengths as (select distinct n from bw),
dw as (
  select rid, i, n, array_to_string(w[i : i + n - 1], ' ') as g
  from (select rid, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) as i from d, lengths where len(w) >= n)),
m as (select rid, i, dw.n, item_id from dw join bw on dw.g = bw.g and dw.n = bw.n),
c as (select rid, count(distinct pos) as n_hit from (select rid, unnest(range(i, i + n)) as pos from m) group by rid),
it as (select rid, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from m group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit > 0 and {SHARE} * n_hit >= len(w), false) as contaminated
from d left join c using (rid) left join it using (rid)
"""
