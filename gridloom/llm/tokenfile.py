"""Token-id shards: each document's ids compressed alone with one shared dictionary.

A zstandard dictionary is trained on the serialized id arrays of a bounded sample of
documents and shared by all shards, so that short documents compress well and are still
read one at a time. A shard holds documents in ascending doc_id order:

    magic 8 | sha256 of the dictionary 32 | id width in bytes 1 | zeros 7
    one zstandard frame per document (little-endian ids, end id included)
    index: doc_id i64[n] | has_id u8[n] | offset u64[n + 1] | n_tokens u64[n] | crc32 u32[n]
    index offset u64 | n u64 | magic 8

Shards are cut at quantiles of doc_id, so only compressed ids are shuffled. An id that fills several shards, and
rows without an id, are dealt to as many by checksum and place in their task. A shard is
written under a name of its own by each task attempt, and the manifest lists the attempt
that counts; a lost executor costs its shards only.

Encoding splits texts at spaces and line feeds and encodes each distinct piece once per
worker (bounded cache). That equals encoding whole texts for tokenizers that drop white
space before any merge, which ``splits_at_space`` checks from the tokenizer's file; for
others whole texts are encoded.

Nulls: a null text is empty and holds the end id only; rows with a null doc_id come
first. Rows with equal ids stay, ordered by length and bytes within a shard. A very long text is one frame. An empty table
has one shard of no documents at most. Other columns are ignored.

The dictionary is trained on a chunk of SAMPLE_CHARS characters, at a place that a hash of the id gives, of each of the SAMPLE_DOCS
documents with the least hash of their id (of rows with equal ids, the least chunk). It only affects the size of files: all documents are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import string
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import cut, fresh_path, ship

MAGIC = b"GLTOKEN1"
HEAD = 48
END_ID = 2
CACHE = 400_000  # pieces of a generation; a worker keeps two
GROUP = 1 << 20  # characters that are encoded together
ROWS = 256  # rows whose texts and ids a worker holds at once
MARKS = string.punctuation
LONG = 64  # pieces of more characters are not kept
SAMPLE_DOCS = 1024  # documents that the dictionary is trained on
SAMPLE_CHARS = 16_000  # characters of each of them
DICT_BYTES = 64 << 10
LEVEL = 3
DOCS_PER_SHARD = 8192
MOST_SHARDS = 50_000  # beyond it shards get larger

MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_bytes long"


def splits_at_space(path: str) -> bool:
    """Whether the tokenizer in ``path`` folds white space to a blank and drops it before merging."""
    with open(path) as f:
        j = json.load(f)
    steps = (j.get("pre_tokenizer") or {}).get("pretokenizers") or [j.get("pre_tokenizer") or {}]
    first = steps[0]
    pattern = first.get("pattern", {}).get("Regex", "")
    folds = any(n.get("type") == "Replace" and n.get("pattern", {}).get("Regex") == r"\s+" for n in (j.get("normalizer") or {}).get("normalizers", []))
    return folds and first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and r"[^\s" in pattern


def is_latin(text: str) -> bool:
    """Whether all characters are below U+0100, where lower-casing is by character and nothing composes."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, the end id appended.

    Encoded pieces are kept in two generations: a full one becomes the old one, from which
    pieces return when they are used.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = splits_at_space(path)
        self.end = struct.pack("<I", end_id)
        self.cache: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        with open(path) as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix")
        vocab = self.tokenizer.get_vocab() if suffix else {}
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.marked = bool(self.ends.any())
        # For lower-case words of letters, the normalizer changes nothing and the pattern splits at blanks.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _words(self, words: list[str]) -> None:
        """Learn words of letters: encoded as one text, whose ids are cut after each that ends a word."""
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.ends[ids]) + 1
        if len(at) == len(words) and at[-1] == len(ids):
            raw, at = ids.tobytes(), (4 * at).tolist()
            for w, i, j in zip(words, [0, *at], at, strict=False):
                self.cache[w] = raw[i:j]
        else:
            self._others(words)

    def _others(self, pieces: list[str]) -> None:
        for w, e in zip(pieces, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False), strict=True):
            self.cache[w] = np.array(e.ids, "<u4").tobytes()

    def _learn(self, pieces: set[str], folded: bool) -> list[str]:
        """Learn the pieces that are new; returns the long ones among what was learnt.

        A piece of Latin letters and closing ASCII punctuation is its lower-cased letters and its
        marks, which the tokenizer never merges with each other; each is encoded once. ``folded``
        pieces come from lower-cased Latin-1 texts.
        """
        cache, old, marked = self.cache, self.old, self.marked
        made, words, others, long = [], set(), set(), []

        def need(w: str, to: set[str]) -> None:
            if w in old:
                cache[w] = old[w]
            else:
                to.add(w)

        for w in pieces.difference(cache):
            if w in old:
                cache[w] = old[w]
                continue
            if len(w) > LONG:
                long.append(w)
            if folded and w.isalpha():
                words.add(w)
                continue
            core = w.rstrip(MARKS) if marked else ""
            low = core if folded else core.lower()
            if core.isalpha() and (folded or core.isascii() or (max(core) < "\u0250" and len(low) == len(core))):
                marks = w[len(core) :]
                made.append((w, low, marks))
                if low not in cache:
                    need(low, words)
                if marks not in cache:
                    need(marks, others)
                if len(low) > LONG:
                    long.append(low)
            else:
                others.add(w)
        if words:
            self._words(list(words))
        if others:
            self._others(list(others))
        for w, low, marks in made:
            cache[w] = cache[low] + cache[marks]
        return long

    def __call__(self, text: str | None) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[str | None]) -> list[bytes]:
        """The encoded texts; what is new in about GROUP characters of them is learnt at once."""
        if not self.pieces:
            return [np.array(self.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() + self.end for t in texts]
        out: list[bytes] = []
        split: list[list[str]] = []
        plain, other, size = [], [], 0
        for i, t in enumerate(texts):
            t = t or ""
            folded = self.marked and "<|" not in t and is_latin(t)
            if folded:
                t = t.lower()  # the tokenizer lower-cases anyway, but finds its special tokens first
            split.append(t.replace("\n", " ").split(" ") if t else [])
            (plain if folded else other).append(split[-1])
            size += len(t)
            if size >= GROUP or i == len(texts) - 1:
                if len(self.cache) > CACHE:
                    self.old, self.cache = self.cache, {"": b""}
                long = self._learn(set().union(*plain), True) + self._learn(set().union(*other), False)
                get = self.cache.__getitem__
                out.extend(b"".join(map(get, words)) + self.end for words in split)
                for w in long:
                    self.cache.pop(w, None)
                split, plain, other, size = [], [], [], 0
        return out


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int = END_ID) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path in it."""
    return pafs.FileSystem.from_uri(uri)


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary; from few or uniform samples, their bytes as a raw dictionary."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples)[-size:] or b"\x00" * 8).ljust(8, b"\x00")


def _sampled(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> list[bytes]:
    """Serialized ids of a chunk of each of the SAMPLE_DOCS documents with the least hash of doc_id."""
    ids = [r[0] for r in docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()]
    at = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    chunk = F.substr(F.coalesce("text", F.lit("")), F.coalesce(at, F.lit(1)), F.lit(SAMPLE_CHARS))
    rows = docs.where(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(F.min(chunk).alias("text")).collect() if ids else []
    encode = encoder(tokenizer, end_id)
    return [np.frombuffer(encode(r.text), "<u4").astype(f"<u{width}").tobytes() for r in sorted(rows, key=lambda r: r.doc_id)]


class Shards:
    """Which shard a row goes to.

    ``cuts`` are quantiles of doc_id: ids up to a cut and over the one before share a shard. A cut that occurs k > 1 times is an id of k - 1 shards'
    rows or more: it gets k of its own, after those of lesser ids. Rows without an id have ``nulls`` shards, which come first.
    """

    def __init__(self, cuts: list[int], nulls: int):
        self.nulls = nulls
        self.bounds, own = np.unique(np.array(cuts, np.int64), return_counts=True)
        self.own = np.where(own > 1, own, 0)
        self.first = nulls + np.concatenate([[0], np.cumsum(1 + self.own)]).astype(np.int64)
        self.count = int(self.first[-1]) + 1

    def of(self, ids: pa.Array, crcs: np.ndarray, seen: int) -> np.ndarray:
        """Shard of each row; ``seen`` rows of the task came before."""
        value, none = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
        spread = crcs + np.arange(seen, seen + len(value))
        at = np.searchsorted(self.bounds, value, "left")
        out = self.first[at]
        if len(self.bounds):
            i = np.minimum(at, len(self.bounds) - 1)
            hot = (self.bounds[i] == value) & (self.own[i] > 0)
            out = np.where(hot, out + 1 + spread % np.maximum(self.own[i], 1), out)
        return np.where(none, spread % max(self.nulls, 1), out).astype(np.int32)


class ShardWriter:
    """Writes one shard as a stream of compressed documents."""

    def __init__(self, root: str, shard: int, digest: bytes, width: int):
        self.path = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex[:12]}.tok"
        fs, at = open_fs(self.path)
        self.out = fs.open_output_stream(at)
        self.shard, self.at, self.tokens = shard, HEAD, 0
        self.ids, self.has, self.sizes, self.crcs, self.offsets = array("q"), array("B"), array("Q"), array("Q"), array("Q", [HEAD])
        self.out.write(MAGIC + digest + bytes([width]) + bytes(7))

    def add(self, doc_id: int | None, n_tokens: int, crc: int, frame: bytes) -> None:
        self.out.write(frame)
        self.at += len(frame)
        self.tokens += n_tokens
        for to, x in ((self.ids, doc_id or 0), (self.has, doc_id is not None), (self.sizes, n_tokens), (self.crcs, crc), (self.offsets, self.at)):
            to.append(x)

    def close(self) -> tuple:
        n = len(self.ids)
        self.out.write(np.array(self.ids, "<i8").tobytes() + np.array(self.has, "u1").tobytes())
        self.out.write(np.array(self.offsets, "<u8").tobytes() + np.array(self.sizes, "<u8").tobytes() + np.array(self.crcs, "<u4").tobytes())
        self.out.write(struct.pack("<QQ", self.at, n) + MAGIC)
        self.out.close()
        return self.shard, self.path, n, self.tokens, self.at


class ShardReader:
    """Reads a shard: its index first, then any document by its place."""

    def __init__(self, path: str, dictionary: bytes):
        fs, at = open_fs(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        head, foot = self.file.read_at(HEAD, 0), self.file.read_at(24, size - 24)
        if head[:8] != MAGIC or foot[16:] != MAGIC:
            raise ValueError(f"{path} is not a token shard")
        if head[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        self.width = head[40]
        begin, n = struct.unpack("<QQ", foot[:16])
        raw, self.n = self.file.read_at(size - 24 - begin, begin), n
        ids, has = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "u1", n, 8 * n)
        self.ids = [int(i) if h else None for i, h in zip(ids, has, strict=True)]
        self.offsets, self.sizes = np.frombuffer(raw, "<u8", n + 1, 9 * n), np.frombuffer(raw, "<u8", n, 17 * n + 8)
        self.crcs = np.frombuffer(raw, "<u4", n, 25 * n + 8)
        self.unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def document(self, place: int) -> np.ndarray:
        """The ids of the document at ``place``, end id included; reads that frame only."""
        a, b = int(self.offsets[place]), int(self.offsets[place + 1])
        raw = self.unzip.decompress(self.file.read_at(b - a, a), max_output_size=int(self.sizes[place]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def write_tokens(docs: DataFrame, tokenizer: str, root: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """Write all documents below ``root``; the manifest, one row per shard, is returned."""
    from tokenizers import Tokenizer

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    n, named = docs.agg(F.count("*"), F.count("doc_id")).first()
    wanted = lambda rows: min(-(-rows // docs_per_shard), MOST_SHARDS)
    cuts: list[int] = []
    if (k := wanted(named)) > 1:
        part = ", ".join(f"{i / k!r}D" for i in range(1, k))
        cuts = docs.selectExpr(f"percentile_approx(doc_id, array({part}), {max(10_000, 20 * k)})").first()[0] or []
    plan = Shards(cuts, wanted(n - named))
    shards = plan.count
    dictionary = train_dictionary(_sampled(docs, tokenizer, end_id, width))
    digest = hashlib.sha256(dictionary).digest()
    fs, at = open_fs(root)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/dictionary.zstd") as f:
        f.write(dictionary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, zip_ = encoder(tokenizer, end_id), zstandard.ZstdCompressor(LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        seen = 0
        for b in batches:
            sizes, crcs, frames = [], [], []
            for at in range(0, b.num_rows, ROWS):
                for raw in own.many(b.column(1).slice(at, ROWS).to_pylist()):
                    crcs.append(zlib.crc32(raw))
                    sizes.append(len(raw) // 4)
                    frames.append(zip_.compress(np.frombuffer(raw, "<u4").astype("<u2").tobytes() if width == 2 else raw))
            ids = b.column(0)
            shard = plan.of(ids, np.array(crcs, np.int64), seen)
            seen += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(shard), ids, pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(frames, pa.binary())], ["shard", "doc_id", "n_tokens", "crc", "frame"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, rows = None, []
        for b in batches:
            for shard, doc_id, size, crc, frame in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if writer is None or writer.shard != shard:
                    if writer is not None:
                        rows.append(writer.close())
                    writer = ShardWriter(root, shard, digest, width)
                writer.add(doc_id, size, crc, frame)
        if writer is not None:
            rows.append(writer.close())
        if rows:
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "path", "n_docs", "n_tokens", "n_bytes"])

    ship(docs.sparkSession)
    coded = docs.mapInArrow(encode, "shard int, doc_id long, n_tokens long, crc long, frame binary")
    placed = coded.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "n_tokens", "crc", "frame")
    return cut(placed.mapInArrow(write, MANIFEST), "manifest")


def read_tokens(manifest: DataFrame, root: str) -> DataFrame:
    """Read all shards back: doc_id, start (ids before the document), n_tokens, ids_crc32; all from the ids."""
    fs, at = open_fs(root)
    with fs.open_input_stream(f"{at}/dictionary.zstd") as f:
        dictionary = f.read()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = ShardReader(path, dictionary)
                sizes, crcs = np.zeros(shard.n, np.int64), np.zeros(shard.n, np.int64)
                for i in range(shard.n):
                    ids = shard.document(i)
                    sizes[i], crcs[i] = len(ids), zlib.crc32(ids.tobytes())
                    if crcs[i] != shard.crcs[i]:
                        raise ValueError(f"{path}: document {i} is damaged")
                start = base + np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays([pa.array(shard.ids, pa.int64()), pa.array(start), pa.array(sizes), pa.array(crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    ship(manifest.sparkSession)
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("path", before.alias("base"), "shard")
    return placed.repartitionById(max(1, manifest.count()), F.col("shard")).select("path", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenise(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` as token shards in the shared folder and read them back."""
    root = fresh_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, tokenizer, root), root)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document's place, length and checksum, read from the files written."""
    import public_tokenizers

    return tokenise(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
