"""SimHash near-duplicate detection by deletion-variant signatures.

A document's 64-bit fingerprint comes from the XXH64 hashes of its word shingles.
Two fingerprints within three bits are linked. Pairs are found without comparing all
with all: the fingerprint is cut into two 32-bit segments, of which one differs by at
most one bit, so each segment is indexed whole and with each of its bits left out (66
signatures). Linked fingerprints meet in at least one signature; there they are verified.

Equal fingerprints are one class, represented by its least doc_id, so thousands of
copies are one row of the index. A signature that many different fingerprints share is
searched a second time with the other segment's halves added in the same way; that
leaves at most 18 free bits, so no group has over 2**18 members whatever the input. In
a group, a breadth-first search compares pivots with what is still unreached and emits
one link per member reached, never all pairs.

Nulls: a null text has no words and the fingerprint zero, like an empty one. A row with
a null id gets a fingerprint but starts no component: its component is that of its
equals, or null. Rows with equal ids count as one document. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..plans.star import star_components
from ..storage import cut, ship

MAX_BITS = 3
SHINGLE = 3
SEED = 42
GROUP = 4096  # members of a signature that are searched at once; larger ones get second signatures
BLOCK = 1 << 16  # hashes that are turned into bits at once


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every word shingle of an UTF-8 text, repeats included, A-Z lower-cased."""
    words = text.lower().split()  # on bytes: A-Z only, and exactly \x20 \x09-\x0D
    if not words:
        return np.zeros(0, "<u8")
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(line, SEED)], "<u8")
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    return np.array([digest(line[a:b], SEED) for a, b in zip(start[: 1 - shingle].tolist(), end[shingle - 1 :].tolist(), strict=True)], "<u8")


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint: a bit is 1 if it is set in over half of the hashes."""
    h = shingle_hashes(text or b"", shingle)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), BLOCK):
        ones += np.unpackbits(h[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, more: tuple[str, ...] = ()) -> DataFrame:
    """One row (doc_id, fp) per document, then more_0, more_1, ... from other columns; fp is the fingerprint as a signed long."""
    names = ["doc_id", "fp", *(f"more_{i}" for i in range(len(more)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], names)

    ship(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(n) for n, c in zip(names[2:], more, strict=True)))
    fields = {f.name: f for f in narrow.schema.fields}
    schema = StructType([fields["doc_id"], StructField("fp", LongType()), *(fields[n] for n in names[2:])])
    return narrow.mapInArrow(run, schema)


def _reach(fp: np.ndarray, rep: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """A link from each member to its first reached neighbour's root, within one group."""
    u: list[int] = []
    v: list[int] = []
    left = np.arange(len(fp))
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        front = [root]
        while front and len(left):
            pivot = front.pop()
            near = np.bitwise_count(fp[left] ^ fp[pivot]) <= bits
            found, left = left[near], left[~near]
            front.extend(found.tolist())
            v.extend(rep[found].tolist())
            u.extend([int(rep[root])] * len(found))
    return u, v


def _search(bits: int, limit: int):
    """Arrow mapper over rows (key, fp, rep) sorted by key: links, and rows of groups over the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        carry, hot = (none, none, none), None

        def batch(u, v, rows) -> pa.RecordBatch:
            k, n = len(u), len(rows[0])
            miss = lambda m: pa.nulls(m, pa.int64())
            cols = [pa.concat_arrays([pa.array(np.asarray(x, np.int64)), miss(n)]) for x in (u, v)]
            cols += [pa.concat_arrays([miss(k), pa.array(x)]) for x in rows]
            return pa.RecordBatch.from_arrays(cols, ["u", "v", "key", "fp", "rep"])

        def groups(key, fp, rep) -> pa.RecordBatch:
            u, v, large = [], [], []
            if len(key):
                at = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
                size = np.diff(at)
                two = at[:-1][size == 2]
                two = two[np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= bits]
                u.extend(rep[two].tolist())
                v.extend(rep[two + 1].tolist())
                for i in np.flatnonzero(size > 2).tolist():
                    a, b = int(at[i]), int(at[i + 1])
                    if b - a > limit:
                        large.append(np.arange(a, b))
                        continue
                    x, y = _reach(fp[a:b].view(np.uint64), rep[a:b], bits)
                    u.extend(x)
                    v.extend(y)
            pick = np.concatenate(large) if large else np.zeros(0, np.int64)
            return batch(u, v, (key[pick], fp[pick], rep[pick]))

        for b in batches:
            key, fp, rep = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if hot is not None and len(key):
                n = int(np.searchsorted(key, hot, "right"))
                if n:
                    yield batch([], [], (key[:n], fp[:n], rep[:n]))
                    key, fp, rep = key[n:], fp[n:], rep[n:]
            key, fp, rep = (np.concatenate(x) for x in zip(carry, (key, fp, rep), strict=True))
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1], "left"))
            carry, hot = tuple(x[last:].copy() for x in (key, fp, rep)), None
            yield groups(key[:last], fp[:last], rep[:last])
            if len(carry[0]) > limit:
                yield batch([], [], carry)
                carry, hot = (none, none, none), int(key[-1])
        yield groups(*carry)

    return run


def _meet(signed: DataFrame, bits: int, limit: int) -> DataFrame:
    """Bring equal keys together and search each group."""
    ship(signed.sparkSession)
    return signed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_search(bits, limit), "u long, v long, key long, fp long, rep long")


def signatures(classes: DataFrame) -> DataFrame:
    """Rows (key, fp, rep): both 32-bit segments, whole (place 32) and with each bit left out."""
    at = classes.select("fp", "rep", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("j")).selectExpr("fp", "rep", "j div 33 as s", "cast(j % 33 as int) as p")
    cut_out = at.selectExpr("fp", "rep", "s", "p", "if(s = 0, fp & 4294967295L, shiftrightunsigned(fp, 32)) as seg")
    return cut_out.selectExpr("shiftleft(s, 38) | shiftleft(cast(p as bigint), 32) | if(p < 32, seg & ~shiftleft(1L, p), seg) as key", "fp", "rep")


def second_signatures(hot: DataFrame) -> DataFrame:
    """The same for a shared key's members, from the halves of the other segment; keys stay distinct."""
    at = hot.select("key", "fp", "rep", F.explode(F.sequence(F.lit(0), F.lit(33))).alias("j")).selectExpr("key", "fp", "rep", "j div 17 as s", "cast(j % 17 as int) as p", "if(shiftrightunsigned(key, 38) = 1, fp & 4294967295L, shiftrightunsigned(fp, 32)) as other")
    half = at.selectExpr("key", "fp", "rep", "s", "p", "if(s = 0, other & 65535L, shiftrightunsigned(other, 16)) as h")
    return half.selectExpr("shiftleft(key, 22) | shiftleft(s, 21) | shiftleft(cast(p as bigint), 16) | if(p < 16, h & ~shiftleft(1L, p), h) as key", "fp", "rep")


def links(classes: DataFrame, bits: int = MAX_BITS, limit: int = GROUP) -> DataFrame:
    """Links (u, v) between representatives that connect all classes within ``bits`` (3 at most)."""
    if not 0 <= bits <= 3:
        raise ValueError("two segments with one wildcard find up to three differing bits")
    first = cut(_meet(signatures(classes), bits, limit), "links")
    out = first.where("u is not null").select("u", "v")
    hot = first.where("key is not null").select("key", "fp", "rep")
    if not hot.isEmpty():
        out = out.union(_meet(second_signatures(hot), bits, 1 << 18).where("u is not null").select("u", "v"))
    return out


def grouped(prints: DataFrame, bits: int = MAX_BITS, limit: int = GROUP) -> DataFrame:
    """Every distinct ``fp`` of a table with its group: the least fingerprint reachable, as a signed long."""
    classes = cut(prints.select("fp").distinct(), "classes")
    component = star_components(links(classes.select("fp", F.col("fp").alias("rep")), bits, limit))
    return classes.join(component.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("group"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = MAX_BITS, limit: int = GROUP) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id (least doc_id reachable)."""
    fps = cut(fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), shingle=shingle), "fps")
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    component = star_components(links(classes.where("rep is not null"), bits, limit))
    named = classes.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: fingerprint and component of every document."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
