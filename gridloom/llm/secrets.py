"""Secret scanning with corpus-wide ownership frequency.

Base rules find assignments, access keys and hexadecimal keys. The method looks at who
holds a value: the hashes of all candidates are counted over the corpus by distinct owner
and repository. A value that OWNERS owners or REPOS repositories or more hold is a widely copied example; one
that fewer hold looks live. Candidates of no base rule that overlap no base span are added as ``owned`` spans if they
look live; base spans always stay and only carry the counts.

Such a candidate is a run of 20 to LONGEST letters, digits, plus, dash or underscore that looks drawn at random: it has
digits and letters, changes between lower case, upper case and digits TURNS times or more, has SEPARATORS dashes and
underscores at most, and 3 bits of collision entropy per character (8 times the sum of its characters' squared counts
is at most its squared length). Slashes and dots end a run, so paths and host names are not candidates; identifiers of words and
numbers turn too seldom, UUIDs have too many dashes, longer runs are data and not keys.

Places in code points come from splitting a text at a rule's matches and prefix sums over the
lengths of pieces and matches. DataFrame functions only. What is stored between steps is
each candidate's place and hash, never its text. A value held by a third of all rows is
reduced to one row per (value, owner, repository) before the shuffle, and the join of counts to
candidates is on an expression of the hash, so that both sides are shuffled for it and a hot hash is split.

Nulls: a null text is empty; null owners and repositories are values of their own. Every
row is a document of its own, repeated ids included. A very long text is one row with one entry a match. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import cut
from .arrays import with_prefix

#: Fixed rules: kind, pattern, group of the value, least length of that group.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
LONGEST = 200
OWNED = ("owned", r"[A-Za-z0-9+_-]{20,}", 0, 20)
OWNERS = 3
REPOS = 6
TURNS = 5
SEPARATORS = 3
#: Places at which a run turns from one kind of character to another.
TURN = "[a-z](?=[A-Z0-9])|[A-Z](?=[0-9])|[0-9](?=[A-Za-z])|[A-Z](?=[A-Z][a-z])"
_SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,hash:bigint>>"


def random_looking(value: Column) -> Column:
    """Whether a run looks drawn at random."""
    chars = F.split(value, "")
    square = F.aggregate(F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c))), F.lit(0), lambda a, n: a + n * n)
    mixed = (F.length(value) <= LONGEST) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.regexp_count(value, F.lit(TURN)) >= TURNS) & (F.regexp_count(value, F.lit("[_-]")) <= SEPARATORS)
    return F.when(mixed, 8 * square <= F.length(value) * F.length(value)).otherwise(F.lit(False))


def _matches(df: DataFrame, rank: int, kind: str, pattern: str, group: int, least: int) -> DataFrame:
    """Adds a column named ``kind``: the rule's spans, leftmost and not overlapping, failing matches dropped."""
    m, v, p, d, at = (f"_{c}{rank}" for c in "mvpda")
    rx = F.lit(pattern)
    df = df.withColumn(m, F.regexp_extract_all("text", rx, F.lit(0)))
    df = df.withColumn(v, F.when(F.size(m) > 0, F.regexp_extract_all("text", rx, F.lit(group))) if group else F.col(m))
    df = df.withColumn(p, F.when(F.size(m) > 0, F.transform(F.split("text", pattern, -1), F.length)))
    df = df.withColumn(d, F.when(F.size(m) > 0, F.zip_with(m, F.slice(p, 1, F.size(m)), lambda x, n: (F.length(x) + n).cast("long"))))
    df = with_prefix(df, d, at)

    def span(i: Column) -> Column:
        start = F.get(F.col(at), i) + F.get(F.col(p), i)
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (start + F.length(F.get(F.col(m), i))).alias("end"), F.xxhash64(F.get(F.col(v), i)).alias("hash"))

    value = lambda i: F.get(F.col(v), i)
    good = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (F.length(value(i)) >= least) & (random_looking(value(i)) if kind == OWNED[0] else F.lit(True)))
    return df.withColumn(kind, F.when(F.size(m) > 0, F.transform(good, span)).otherwise(F.array()).cast(_SPAN)).drop(m, v, p, d, at)


def _text(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), owners: int = OWNERS, repos: int = REPOS) -> DataFrame:
    """One row per document: doc_id, base and spans (sorted arrays of start, rank, kind, end, hash, owners, live)."""
    repo = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in repo_cols))
    df = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("\x00")).alias("owner"), repo.alias("repo"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for rank, rule in enumerate((*RULES, OWNED)):
        df = _matches(df, rank, *rule)
    df = df.withColumn("base", F.array_sort(F.concat(*(r[0] for r in RULES))))
    found = cut(df.select("rid", "doc_id", "owner", "repo", "base", F.col(OWNED[0]).alias("more")), "found")

    # What overlaps is seen from neighbours in the order of starts: the furthest end of bases before, the next base's start.
    who = ["rid", "owner", "repo"]
    both = found.where("size(more) > 0").select(*who, F.explode(F.concat("base", "more")).alias("s"))
    is_base = F.col("s.rank") < len(RULES)
    before = Window.partitionBy("rid").orderBy(F.col("s.start"), F.col("s.rank")).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("rid").orderBy(F.col("s.start").desc(), F.col("s.rank").desc()).rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("reach", F.max(F.when(is_base, F.col("s.end"))).over(before)).withColumn("next", F.min(F.when(is_base, F.col("s.start"))).over(after))
    clear = both.where(~is_base & (F.coalesce("reach", F.lit(0)) <= F.col("s.start")) & (F.coalesce(F.col("next"), F.col("s.end")) >= F.col("s.end")))
    each = found.where("size(base) > 0").select(*who, F.explode("base").alias("s")).union(clear.select(*who, "s"))
    held = each.select(F.col("s.hash").alias("hash"), "owner", "repo").distinct().groupBy("hash", "owner").agg(F.count("*").alias("repos")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    key = F.bitwise_not(F.col("hash"))
    counted = each.withColumn("key", F.bitwise_not("s.hash")).join(held.select(key.alias("key"), "owners", "repos"), "key")
    live = (F.col("owners") < owners) & (F.col("repos") < repos)
    kept = counted.where((F.col("s.rank") < len(RULES)) | live)
    spans = kept.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("s.start", "s.rank", "s.kind", "s.end", "s.hash", "owners", "repos", live.alias("live")))).alias("spans"))
    return found.select("rid", "doc_id", "base").join(spans, "rid", "left").drop("rid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: base counts and digest, and all spans, of every document."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    live = F.coalesce(F.size(F.filter("spans", lambda s: s["live"])).cast("long"), F.lit(0)).alias("n_live")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *(n(r[0]) for r in RULES), F.sha2(_text(F.col("base")), 256).alias("base_sha256"), F.coalesce(_text(F.col("spans")), F.lit("")).alias("spans"), F.when(F.col("spans").isNull(), F.lit(0)).otherwise(live).cast("long").alias("n_live"))


#: Places where a character and the next are of different kinds, as TURN counts them.
_SQL_TURNS = """len(list_filter(range(1, length(v)), lambda i:
      regexp_matches(v[i : i + 1], '[a-z][A-Z0-9]|[A-Z][0-9]|[0-9][A-Za-z]') or regexp_matches(v[i : i + 2], '^[A-Z][A-Z][a-z]')))"""


def _sql_spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    rx = pattern.replace("'", "''")
    n = lambda pattern: f"len(regexp_extract_all(v, '{pattern}'))"
    more = f""" and length(v) <= {LONGEST} and regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]') and {n('[_-]')} <= {SEPARATORS}
    and {_SQL_TURNS} >= {TURNS}
    and 8 * list_sum([pow(len(list_filter(string_split(v, ''), lambda x: x = c)), 2) for c in list_distinct(string_split(v, ''))]) <= pow(length(v), 2)""" if kind == OWNED[0] else ""
    return f"""
  select rid, {rank} as rank, '{kind}' as kind, s as start, s + length(m) as stop, v from (
    select rid, ms[i] as m, vs[i] as v, (list_sum([length(x) for x in ps[1:i]]) + coalesce(list_sum([length(x) for x in ms[1:i-1]]), 0))::bigint as s from (
      select rid, ms, vs, ps, unnest(range(1, len(ms) + 1)) as i from (
        select rid, regexp_extract_all(text, '{rx}') as ms, regexp_extract_all(text, '{rx}', {group}) as vs, string_split_regex(text, '{rx}') as ps from d)))
  where length(v) >= {least}{more}"""


ORACLE = f"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(source, chr(1)) as owner, coalesce(source, chr(1)) || '/' || coalesce(lang, chr(1)) as repo, coalesce(text, '') as text from documents),
base as ({" union all ".join(_sql_spans(r[0], i, *r[1:]) for i, r in enumerate(RULES))}),
gen as ({_sql_spans(OWNED[0], len(RULES), *OWNED[1:])}),
more as (select * from gen g where not exists (select 1 from base b where b.rid = g.rid and b.start < g.stop and g.start < b.stop)),
every as (select * from base union all select * from more),
held as (select v, count(distinct owner) < {OWNERS} and count(distinct (owner, repo)) < {REPOS} as live from every join d using (rid) group by v),
kept as (select every.*, live from every join held using (v) where rank < {len(RULES)} or live),
b as (
  select rid, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as s from base group by rid),
k as (select rid, string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as s, count(*) filter (live) as n_live from kept group by rid)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(b.s, '')) as base_sha256, coalesce(k.s, '') as spans, coalesce(n_live, 0)::bigint as n_live
from d left join b using (rid) left join k using (rid)
"""
