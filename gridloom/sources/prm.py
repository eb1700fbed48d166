"""The binary ``.prm`` format: packed integer arrays and a compressed index, one file per tensor.

Layout, little-endian: ``#PRM`` | type tag 3 bytes and NUL | value tag 4 bytes, NUL padded |
shape u64 n, n u64 | order u64 n, n u32 | u32 index_dim_order | u64 nnz | index | positions |
data. Index and positions are packed integer arrays; data is u64 count and raw values, or a
child level without magic and tags. A packed array is u32 item size | u32 shift flag |
u64 min | u64 max | u32 sketch bits | u64 number of sketch items | sketch items | u64 bytes | items.

Tasks do the work, on chunks of 2**CHUNK_BITS items: writing, the driver only joins their bytes to one
file; reading, it only parses the heads, and a task reads the byte ranges of its chunks. The file is therefore opened
by driver and executors alike and has to lie where all of them see it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..meta import MatrixType, TensorMeta
from ..operators.access import with_ordinal
from ..operators.layout import offsets
from ..storage import cut, ship
from ..tensor import CooTensor

MAGIC = b"#PRM"
CHUNK_BITS = 16
TOGETHER = 32  # chunks that come to the driver at once
RAW = {"i64": "<i8", "f32": "<f4", "f64": "<f8", "c32": "<c8", "c64": "<c16"}


def width_of(top: int) -> int:
    """Bytes that hold an integer up to ``top``."""
    return max(1, (int(top).bit_length() + 7) // 8)


def _best_sketch(v: np.ndarray, sketch_width: int, plain: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits, first value of each block, differences to it) of the cheapest sketch, 0 bits if none beats ``plain`` bytes."""
    best, found = plain, (0, v[:0], v)
    for bits in range(1, max(2, len(v).bit_length())):
        first = v[:: 1 << bits]
        delta = v - np.repeat(first, 1 << bits)[: len(v)]
        if len(delta) and (delta.min() < 0 or int(first.max()) >> (8 * sketch_width)):
            continue
        cost = len(v) * width_of(int(delta.max()) if len(v) else 0) + len(first) * sketch_width
        if cost < best:
            best, found = cost, (bits, first, delta)
    return found


def pack(values: np.ndarray, sketch_width: int = 8) -> bytes:
    """A packed array of non-negative integers below 2**63.

    The minimum is subtracted if that saves a byte an item; instead, blocks of 2**bits items
    may store their first value in a sketch and each item its difference to it, if that is smaller.
    """
    v = np.asarray(values).astype(np.int64)
    low, high = (int(v.min()), int(v.max())) if len(v) else (0, 0)
    shift = width_of(high - low) < width_of(high)
    plain = width_of(high - low) if shift else width_of(high)
    bits, sketch, delta = _best_sketch(v, sketch_width, plain * len(v))
    if bits:
        shift, width = False, width_of(int(delta.max()))
    else:
        width, delta = plain, v - low if shift else v
    items = delta.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    return struct.pack("<IIQQIQ", width, int(shift), low, high, bits, len(sketch)) + sketch.astype(f"<u{sketch_width}").tobytes() + struct.pack("<Q", len(items)) + items


def unpack(f, sketch_width: int) -> np.ndarray:
    """Read a packed array; sketch items take ``sketch_width`` bytes each."""
    width, shift, low, _, bits, n_sketch = struct.unpack("<IIQQIQ", f.read(36))
    sketch = np.frombuffer(f.read(n_sketch * sketch_width), f"<u{sketch_width}").astype(np.uint64)
    (size,) = struct.unpack("<Q", f.read(8))
    raw = np.frombuffer(f.read(size), np.uint8).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    out = wide.view("<u8").ravel().astype(np.uint64)
    if n_sketch:
        out = out + sketch[np.arange(len(out)) >> bits]
    return out + np.uint64(low) if shift else out


def _reaches(first: np.ndarray, low: np.ndarray, high: np.ndarray, levels: int) -> tuple[list[int], list[int], list[int]]:
    """For blocks of 2, 4, ... 2**levels neighbours: least and largest difference to a block's first, and largest first."""
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    for _ in range(levels):
        at = np.arange(0, len(first), 2)
        first, low, high = first[::2], np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
        for to, x in zip(out, ((low - first).min(), (high - first).max(), first.max()), strict=True):
            to.append(int(x))
    return out


def _raw_values(vals: pa.ChunkedArray, value_type: str) -> bytes:
    flat = vals.combine_chunks().flatten()
    if value_type in ("c32", "c64"):
        flat = np.stack([x.to_numpy(zero_copy_only=False) for x in flat.flatten()], axis=1).astype(RAW[value_type].replace("c8", "f4").replace("c16", "f8"))
        return flat.tobytes()
    return flat.to_numpy(zero_copy_only=False).astype(RAW[value_type]).tobytes()


_SUMMARY = ["chunk", "n", "first", "low", "high", "least", "most", "top"]


def _chunked(df: DataFrame, idx: str, value: str, n: int, value_type: str | None = None) -> DataFrame:
    """A table with a row per chunk: its items in the order of ``idx``, what a choice of encoding needs to know of them, raw ``vals``."""
    bits = CHUNK_BITS

    def gather(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        v = rows["value"].to_numpy()
        raw = _raw_values(rows["vals"], value_type) if value_type else b""
        row = [rows["chunk"][0].as_py(), len(v), int(v[0]), int(v.min()), int(v.max()), *_reaches(v, v, v, bits), v.astype("<i8").tobytes(), raw]
        return pa.Table.from_pylist([dict(zip([*_SUMMARY, "items", "raw"], row, strict=True))], schema)

    big, many = pa.int64(), pa.list_(pa.int64())
    schema = pa.schema(list(zip([*_SUMMARY, "items", "raw"], [big] * 5 + [many] * 3 + [pa.binary()] * 2, strict=True)))
    ship(df.sparkSession)
    rows = df.select(F.shiftright(idx, bits).alias("chunk"), F.col(idx).alias("idx"), F.col(value).cast("long").alias("value"), *(["vals"] if value_type else []))
    dealt = rows.repartition(max(1, (n >> bits) // 8 + 1), "chunk")
    return cut(dealt.groupBy("chunk").applyInArrow(gather, "chunk long, n long, first long, low long, high long, least array<long>, most array<long>, top array<long>, items binary, raw binary"), "chunks")


def _in_order(chunks: DataFrame, column: str, many: int) -> Iterator[bytes]:
    """A column of bytes by ascending chunk, a few chunks at a time."""
    ranged = chunks.select("chunk", column).repartitionByRange(max(1, -(-many // TOGETHER)), "chunk").sortWithinPartitions("chunk")
    for row in ranged.toLocalIterator():
        yield bytes(row[1])


def _write_packed(f, chunks: DataFrame, sketch_width: int) -> None:
    """What :func:`pack` makes of the items of all chunks."""
    own = CHUNK_BITS
    known = chunks.select(*_SUMMARY).orderBy("chunk").toPandas()
    n, many = int(known["n"].sum()), len(known)
    low, high = (int(known["low"].min()), int(known["high"].max())) if n else (0, 0)
    first = known["first"].to_numpy(np.int64)
    shift = width_of(high - low) < width_of(high)
    width = width_of(high - low) if shift else width_of(high)
    best, bits, most_bits = width * n, 0, max(2, n.bit_length()) - 1
    if n:
        inner = [np.stack(known[c].to_numpy()) for c in ("least", "most", "top")]
        reach = [[int(x) for x in pick(a, axis=0)] for a, pick in zip(inner, (np.min, np.max, np.max), strict=True)]
        for to, more in zip(reach, _reaches(first, known["low"].to_numpy(np.int64), known["high"].to_numpy(np.int64), max(0, most_bits - own)), strict=True):
            to.extend(more)
        for b in range(1, most_bits + 1):
            least, most, top = (x[b - 1] for x in reach)
            cost = n * width_of(most) + -(-n >> b) * sketch_width
            if least >= 0 and not top >> (8 * sketch_width) and cost < best:
                best, bits, width, shift = cost, b, width_of(most), False
    minus = low if shift else 0

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, items in zip(batch["chunk"].to_pylist(), batch["items"], strict=True):
                v = np.frombuffer(items.as_buffer(), "<i8")
                sketch = v[: 0 if not bits or bits > own else None : 1 << min(bits, own)]
                if bits > own:
                    v = v - first[c >> (bits - own) << (bits - own)]
                elif bits:
                    v = v - np.repeat(sketch, 1 << bits)[: len(v)]
                packed = (v - minus).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
                yield pa.RecordBatch.from_pylist([{"chunk": c, "sketch": sketch.astype(f"<u{sketch_width}").tobytes(), "packed": packed}], pa.schema([("chunk", pa.int64()), ("sketch", pa.binary()), ("packed", pa.binary())]))

    made = cut(chunks.select("chunk", "items").mapInArrow(encode, "chunk long, sketch binary, packed binary"), "packed")
    f.write(struct.pack("<IIQQIQ", width, int(shift), low, high, bits, -(-n >> bits) if bits else 0))
    if bits > own:
        f.write(first[:: 1 << (bits - own)].astype(f"<u{sketch_width}").tobytes())
    elif bits:
        for x in _in_order(made, "sketch", many):
            f.write(x)
    f.write(struct.pack("<Q", n * width))
    for x in _in_order(made, "packed", many):
        f.write(x)


def write_prm(t: CooTensor, path: str) -> None:
    """Write a tensor as one file."""
    m = t.meta
    keys = m.storage_coords
    rows = with_ordinal(t.df, keys)
    n = rows.count()
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_output_stream(at, compression=None) as f:
        tag = "bool" if t.is_pattern else m.value_type
        f.write(MAGIC + m.matrix_type.tag.encode() + b"\x00" + tag.encode().ljust(4, b"\x00"))
        own, parents = None, 0
        for k in range(1, len(keys)):
            last = k == len(keys) - 1
            level = rows if last else with_ordinal(t.df.select(*keys[: k + 1]).distinct(), keys[: k + 1])
            size = n if last else level.count()
            if k == 1:
                index = cut(offsets(CooTensor(level, m), m.order[0]), "index")
            else:
                begun = with_ordinal(level.groupBy(*keys[:k]).agg(F.min("ordinal").alias("start")), keys[:k], "pos").select("pos", "start")
                index = begun.union(t.df.sparkSession.range(1).select(F.lit(parents).cast("long"), F.lit(size).cast("long")))
            own = _chunked(level, "ordinal", keys[k], size, m.value_type if last and not t.is_pattern else None)
            f.write(struct.pack(f"<Q{len(m.shape)}Q", len(m.shape), *m.shape) + struct.pack(f"<Q{len(m.order)}I", len(m.order), *m.order))
            f.write(struct.pack("<IQ", k - 1, size))
            _write_packed(f, _chunked(index, "pos", "start", index.count()), 8)
            _write_packed(f, own, 4)
            parents = size
        if t.is_pattern:
            f.write(struct.pack("<Q", 0))
        else:
            f.write(struct.pack("<Q", n * m.depths))
            for x in _in_order(own, "raw", -(-n >> CHUNK_BITS)):
                f.write(x)


def _read_level_head(f) -> tuple[tuple[int, ...], tuple[int, ...], int, int]:
    (n,) = struct.unpack("<Q", f.read(8))
    shape = struct.unpack(f"<{n}Q", f.read(8 * n))
    (k,) = struct.unpack("<Q", f.read(8))
    order = struct.unpack(f"<{k}I", f.read(4 * k))
    level, nnz = struct.unpack("<IQ", f.read(12))
    return shape, order, level, nnz


def read_prm_meta(path: str) -> TensorMeta:
    """Metadata from the header alone; nnz is the root level's, which with over two dimensions counts prefixes."""
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(at, compression=None) as f:
        return _read_head(f)


def _read_head(f) -> TensorMeta:
    if f.read(4) != MAGIC:
        raise ValueError("not a .prm file")
    kind = MatrixType(f.read(4)[:3].decode())
    value = f.read(4).rstrip(b"\x00").decode()
    shape, order, level, nnz = _read_level_head(f)
    return TensorMeta(kind, value, shape, order, nnz, level)


@dataclass(frozen=True)
class _Packed:
    """Where a packed array lies in its file; ``read`` gives any of its items without the others."""

    width: int
    minus: int
    bits: int
    sketch_at: int
    sketch_width: int
    sketched: bool
    items_at: int
    n: int

    @classmethod
    def find(cls, f, sketch_width: int) -> _Packed:
        """Parse the head of an array and go past it."""
        width, shift, low, _, bits, n_sketch = struct.unpack("<IIQQIQ", f.read(36))
        sketch_at = f.tell()
        f.seek(sketch_at + n_sketch * sketch_width)
        (size,) = struct.unpack("<Q", f.read(8))
        items_at = f.tell()
        f.seek(items_at + size)
        return cls(width, low if shift else 0, bits, sketch_at, sketch_width, n_sketch > 0, items_at, size // width)

    def read(self, f, a: int, b: int) -> np.ndarray:
        """Items a to b, b excluded."""
        f.seek(self.items_at + a * self.width)
        raw = np.frombuffer(f.read((b - a) * self.width), np.uint8).reshape(-1, self.width)
        wide = np.zeros((b - a, 8), np.uint8)
        wide[:, : self.width] = raw
        out = wide.view("<i8").ravel() + self.minus
        if self.sketched and b > a:
            lo, hi = a >> self.bits, ((b - 1) >> self.bits) + 1
            f.seek(self.sketch_at + lo * self.sketch_width)
            sketch = np.frombuffer(f.read((hi - lo) * self.sketch_width), f"<u{self.sketch_width}").astype(np.int64)
            out = out + sketch[(np.arange(a, b) >> self.bits) - lo]
        return out

    def last_up_to(self, f, x: int) -> int:
        """The last place of a sorted array whose item is at most ``x``."""
        lo, hi = 0, self.n
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if int(self.read(f, mid, mid + 1)[0]) <= x else (lo, mid)
        return lo


def _coords(f, levels: list[tuple[_Packed, _Packed]], k: int, a: int, b: int) -> list[np.ndarray]:
    """Coordinates in storage order of the entries a to b of level ``k``."""
    index, pos = levels[k]
    lo, hi = index.last_up_to(f, a), index.last_up_to(f, b - 1)
    parents = []
    for p in range(lo, hi + 1, 1 << CHUNK_BITS):  # empty positions may be many
        q = min(hi + 1, p + (1 << CHUNK_BITS))
        parents.append(np.repeat(np.arange(p, q), np.diff(np.clip(index.read(f, p, q + 1), a, b))))
    parent = np.concatenate(parents)
    above = _coords(f, levels, k - 1, int(parent[0]), int(parent[-1]) + 1) if k else None
    return [*([c[parent - parent[0]] for c in above] if above else [parent]), pos.read(f, a, b)]


def _arrow_values(raw: np.ndarray, depths: int, value_type: str) -> pa.Array:
    if value_type in ("c32", "c64"):
        flat = pa.StructArray.from_arrays([pa.array(raw.real.copy()), pa.array(raw.imag.copy())], ["re", "im"])
    else:
        flat = pa.array(raw)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(raw) + 1, depths), pa.int32()), flat)


def read_prm(spark: SparkSession, path: str) -> CooTensor:
    """Read a file as a tensor; it is read when its entries are."""
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(at) as f:
        m = _read_head(f)
        levels = []
        for i in range(m.non_depth_dims - 1):
            if i:
                _read_level_head(f)
            levels.append((_Packed.find(f, 8), _Packed.find(f, 4)))
        f.read(8)
        data_at = f.tell()
    n, bits = levels[-1][1].n if levels else 0, CHUNK_BITS
    names, valued = m.coords, m.value_type != "bool"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pafs.FileSystem.from_uri(path)
        with fs.open_input_file(at) as f:
            for batch in batches:
                for c in batch["id"].to_pylist():
                    a, b = c << bits, min(n, (c + 1) << bits)
                    found = {f"d{d}": pa.array(x) for d, x in zip(m.order[:-1], _coords(f, levels, len(levels) - 1, a, b), strict=True)}
                    cols = [found[x] for x in names]
                    if valued:
                        one = np.dtype(RAW[m.value_type]).itemsize * m.depths
                        f.seek(data_at + a * one)
                        cols.append(_arrow_values(np.frombuffer(f.read((b - a) * one), RAW[m.value_type]), m.depths, m.value_type))
                    yield pa.RecordBatch.from_arrays(cols, [*names, "vals"] if valued else names)

    kind = {"i64": "bigint", "f32": "float", "f64": "double", "c32": "struct<re:float,im:float>", "c64": "struct<re:double,im:double>"}.get(m.value_type)
    schema = ", ".join(f"{c} long" for c in names) + (f", vals array<{kind}>" if valued else "")
    ship(spark)
    many = -(-n >> bits)
    return CooTensor(spark.range(0, many, 1, max(1, -(-many // 4))).mapInArrow(decode, schema), replace(m, nnz=n))
