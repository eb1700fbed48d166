"""A training corpus from ``documents``: five stages, each one operator of ``gridloom.llm``.

quality rules -> near-duplicates -> benchmark decontamination -> mixing -> token ids. Every
stage but the last returns the columns it was given; its input is what its predecessor
kept, read back from Parquet.

Where an operator's verdict is joined back, rows are told apart by a SHA-256 digest of all their
columns, of nulls in their places and of types as they are: only rows equal in every column share it. Such
rows are one document whose copies are added up in the mix; near-duplicate removal keeps one of
them. Null and repeated ids, repeated ids with other texts and extra columns of any name and type are handled; a null
text is a document without words, which the first stage rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from gridloom.llm import decontam, mixture, quality, simhash, tokenfile
from gridloom.storage import cut

def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _digest(docs: DataFrame) -> Column:
    """SHA-256 over the digests of all columns; a null has a mark of its own. Structs, arrays and maps count by their JSON."""
    parts = []
    for f in docs.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (ArrayType, MapType, StructType)):
            c = F.when(c.isNotNull(), F.to_json(F.struct(c), {"ignoreNullFields": "false"}))
        parts.append(F.coalesce(F.sha2(c.cast("binary") if isinstance(f.dataType, (BinaryType, StringType)) else c.cast("string").cast("binary"), 256), F.lit("-")))
    return F.sha2(F.concat_ws(",", *parts), 256)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    key = _fresh(docs, "row_key")
    return docs.withColumn(key, _digest(docs)), key


def _kept(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the fertility bands reject go, those without text among them."""
    return quality.keep(docs, _tokenizer("piece_bpe_32k.model"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: of the least id (null last), then of the least digest.

    Rows of one id with different texts are documents of their own.
    """
    keyed, key = _keyed(docs)
    prints = cut(simhash.fingerprints(keyed, id_col=key, more=("doc_id",)), "prints")
    groups = simhash.grouped(prints)
    named = prints.withColumnRenamed("doc_id", key).withColumnRenamed("more_0", "id").join(groups, "fp")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", key))
    first = named.groupBy("group").agg(least.alias("least")).select(F.col(f"least.{key}").alias(key))
    return keyed.join(first, key, "left_semi").dropDuplicates([key]).select(_kept(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold any SPAN consecutive words of a benchmark item go, however long they are.

    An item of fewer words counts where it makes up a twentieth of a document or more, with what else is hit:
    one of a few common words says nothing about a long text.
    """
    keyed, key = _keyed(docs)
    found = decontam.decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    bad = found.where(F.col("contaminated") | (F.col("n_spans") > 0)).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(bad, key, "left_anti").select(_kept(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    keyed, key = _keyed(docs)
    n = _fresh(keyed, "copies")
    copies = mixture.mix(keyed, id_col=key).groupBy(F.col("doc_id").alias(key)).agg(F.sum("copies").alias(n)).where(f"`{n}` > 0")
    out = keyed.dropDuplicates([key]).join(copies, key)
    return out.withColumn(key, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(_kept(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as token shards, described as read back: doc_id, start, n_tokens, ids_crc32."""
    return tokenfile.tokenise(docs, _tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token ids", token_ids),
]

#: SQL can express neither the vocabularies nor the fingerprints; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
