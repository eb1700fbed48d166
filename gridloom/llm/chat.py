"""Chat formatting: conversations to one training text each, with a loss mask.

A conversation's turns are collected as structs and sorted, adjacent turns of one role are
merged into a block (the places where the role changes, then the turns up to the next of them), and blocks are concatenated:

    <|im_start|>role<|im_sep|>text<|im_cont|>next text of the same role<|im_end|>

In roles and texts every ``<``, ``[`` and backslash is followed by a backslash, so
no control string of this template or of others (``</s>``, ``[INST]``) survives in them,
and dropping that backslash restores them. The loss mask covers assistant texts, not the marks.

Spark expressions only. Turns sort by (turn, role, text), null turns first; null roles and texts are
empty; rows of a null conv_id belong to no common conversation: each is one of its own; repeated rows are turns of their
own. A conversation is one output value and so is gathered in one row, whatever its length, in time in proportion to it;
rows are only spread over conversations. Other columns are ignored; an empty table has no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import with_prefix

START, SEP, CONT, END = "<|im_start|>", "<|im_sep|>", "<|im_cont|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(s: Column) -> Column:
    """A backslash after every ``<``, ``[`` and backslash."""
    return F.regexp_replace(s, r"([<\[\\])", r"$1\\")


def unescape(s: Column) -> Column:
    """The inverse of escape."""
    return F.regexp_replace(s, r"([<\[\\])\\", "$1")


def _merge(df: DataFrame) -> DataFrame:
    """``blocks`` (role, texts) of adjacent turns of one role, from sorted ``turns``."""
    turn = lambda i: F.get(F.col("turns"), i)
    new = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (turn(i)["role"] != turn(i - 1)["role"]))
    df = df.withColumn("new", new)
    run = lambda i, k: F.slice(F.col("turns"), i + 1, F.coalesce(F.get(F.col("new"), k + 1), F.size("turns")) - i)
    return df.withColumn("blocks", F.transform("new", lambda i, k: F.struct(turn(i)["role"].alias("role"), F.transform(run(i, k), lambda t: t["text"]).alias("texts")))).drop("turns", "new")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of start and end in code points of formatted)."""
    text = lambda c: escape(F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("raw_role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("raw"), text(role_col).alias("role"), text(text_col).alias("text"))
    sorted_ = F.array_sort(F.collect_list(F.struct("turn", "raw_role", "raw", "role", "text")))
    rows = rows.withColumn("lone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    turns_ = rows.groupBy("conv_id", "lone").agg(sorted_.alias("turns")).select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    blocks = _merge(turns_)

    def part(s: Column, loss: Column) -> Column:
        return F.struct(s.alias("s"), loss.alias("loss"))

    def laid(b: Column) -> Column:
        head = F.concat(F.lit(START), b["role"], F.lit(SEP))
        body = F.flatten(F.transform(b["texts"], lambda x, i: F.array(part(F.when(i == 0, head).otherwise(F.lit(CONT)), F.lit(False)), part(x, b["role"] == LOSS_ROLE))))
        return F.concat(body, F.array(part(F.lit(END), F.lit(False))))

    parts = blocks.select("conv_id", F.flatten(F.transform("blocks", laid)).alias("parts"))

    parts = with_prefix(parts.withColumn("n", F.transform("parts", lambda p: F.length(p["s"]).cast("long"))), "n", "at")
    lost = F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.get(F.col("parts"), i)["loss"])
    start = lambda i: F.get(F.col("at"), i).cast("int")
    spans = F.transform(lost, lambda i: F.struct(start(i).alias("start"), (start(i) + F.get(F.col("n"), i).cast("int")).alias("end")))
    return parts.select("conv_id", F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: str) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped, as an array."""
    quoted = lambda s: rf"\Q{s}\E"
    whole = F.split(F.col(formatted), quoted(END), -1)
    blocks = F.slice(whole, 1, F.size(whole) - 1)

    def turns(b: Column) -> Column:
        two = F.split(F.substring(b, len(START) + 1, 1 << 30), quoted(SEP), 2)
        return F.transform(F.split(F.get(two, F.lit(1)), quoted(CONT), -1), lambda x: F.struct(unescape(F.get(two, F.lit(0))).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def masked_text(formatted: str, spans: str) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(F.col(formatted), s["start"] + 1, s["end"] - s["start"]))), "")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: digests of every formatted conversation, read back from the format."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    say = "</s>[INST] ok [/INST]"
    own = spark.sql(f"select * from values (-1L, 0L, 'user', '{say}'), (-1L, 1L, 'assistant', '{say}') as t(conv_id, turn, role, text)")
    out = format_chats(turns.union(own))
    out = out.withColumn("turns", parse("formatted")).withColumn("loss", masked_text("formatted", "loss_spans"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, case when conv_id is null then row_number() over () end as lone from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]', null union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]', null),
l as (
  select *, lag(role) over w as before, row_number() over w as i,
    length(text) + length(regexp_replace(text, '[^<\[\\]', '', 'g')) as n, length(role) + length(regexp_replace(role, '[^<\[\\]', '', 'g')) as r
  from t window w as (partition by conv_id, lone order by turn nulls first, role, text))
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = '{LOSS_ROLE}'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = '{LOSS_ROLE}'), '')) as loss_sha256,
  sum(n + case when before is not distinct from role then {len(CONT)} else r + {len(START) + len(SEP) + len(END)} end)::bigint as formatted_chars
from l group by conv_id, lone
"""
