"""Metadata of a tensor: matrix type, value type, shape and storage order."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from math import prod

from pyspark.sql import types as T

#: Short tags of matrix types and their Matrix Market names.
MATRIX_TYPES = {
    "UNK": ("unknown", "unknown", "unknown"),
    "ACG": ("array", "complex", "general"),
    "ARG": ("array", "real", "general"),
    "CCG": ("coordinate", "complex", "general"),
    "CCH": ("coordinate", "complex", "Hermitian"),
    "CCS": ("coordinate", "complex", "symmetric"),
    "CIG": ("coordinate", "integer", "general"),
    "CIS": ("coordinate", "integer", "symmetric"),
    "CPG": ("coordinate", "pattern", "general"),
    "CPS": ("coordinate", "pattern", "symmetric"),
    "CRG": ("coordinate", "real", "general"),
    "CRK": ("coordinate", "real", "skew-symmetric"),
    "CRS": ("coordinate", "real", "symmetric"),
}

#: Value type tags and the Spark type of one value.
VALUE_TYPES: dict[str, T.DataType | None] = {
    "i64": T.LongType(),
    "f32": T.FloatType(),
    "f64": T.DoubleType(),
    "c32": T.StructType([T.StructField("re", T.FloatType()), T.StructField("im", T.FloatType())]),
    "c64": T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())]),
    "bool": None,
}


@dataclass(frozen=True)
class MatrixType:
    """A matrix type tag with its three parts."""

    tag: str = "UNK"

    def __post_init__(self):
        if self.tag not in MATRIX_TYPES:
            raise ValueError(f"unknown matrix type {self.tag!r}")

    @classmethod
    def of(cls, layout: str, field: str, symmetry: str) -> MatrixType:
        """The type of a Matrix Market banner; UNK for combinations that have no tag."""
        return cls(next((k for k, v in MATRIX_TYPES.items() if v == (layout, field, symmetry)), "UNK"))

    @property
    def layout(self) -> str:
        return MATRIX_TYPES[self.tag][0]

    @property
    def field(self) -> str:
        return MATRIX_TYPES[self.tag][1]

    @property
    def symmetry(self) -> str:
        return MATRIX_TYPES[self.tag][2]

    @property
    def long_name(self) -> str:
        return " ".join(MATRIX_TYPES[self.tag])

    @property
    def is_pattern(self) -> bool:
        return self.field == "pattern"

    @property
    def is_complex(self) -> bool:
        return self.field == "complex"

    @property
    def is_symmetric(self) -> bool:
        """Whether only half of the entries are stored (symmetric, skew or Hermitian)."""
        return self.symmetry in ("symmetric", "skew-symmetric", "Hermitian")


def infer_value_type(matrix_type: MatrixType, hint: str = "auto") -> str:
    """i64, f32, f64, c32 or c64 for a matrix type; ``hint`` f32 narrows real and complex values."""
    if hint not in ("auto", "f32", "f64"):
        raise ValueError(f"value type hint {hint!r} is none of auto, f32, f64")
    if matrix_type.field == "integer":
        return "i64"
    narrow = hint == "f32"
    if matrix_type.is_complex:
        return "c32" if narrow else "c64"
    return "f32" if narrow else "f64"


@dataclass(frozen=True)
class TensorMeta:
    """Shape, order and types; ``shape`` ends with the depth, the number of values at a coordinate."""

    matrix_type: MatrixType
    value_type: str
    shape: tuple[int, ...]
    order: tuple[int, ...]
    nnz: int | None = None
    index_dim_order: int = 0

    def __post_init__(self):
        n = len(self.shape)
        if n < 2 or sorted(self.order) != list(range(n)) or self.order[-1] != n - 1:
            raise ValueError(f"order {self.order} does not permute the {n} dimensions with the depth last")
        if self.value_type not in VALUE_TYPES:
            raise ValueError(f"unknown value type {self.value_type!r}")
        if self.matrix_type.is_pattern and self.depths != 1:
            raise ValueError("a pattern has depth 1")

    @property
    def depths(self) -> int:
        return self.shape[-1]

    @property
    def non_depth_dims(self) -> int:
        return len(self.shape) - 1

    @property
    def rows(self) -> int:
        return self.shape[min(self.order[:2])]

    @property
    def cols(self) -> int:
        return self.shape[max(self.order[:2])] if self.non_depth_dims > 1 else 1

    @property
    def index_dim(self) -> int:
        return self.order[self.index_dim_order]

    @property
    def non_index_dim(self) -> int:
        return self.order[self.index_dim_order + 1]

    @property
    def index_dim_size(self) -> int:
        return self.shape[self.order[0]]

    @property
    def non_index_dim_size(self) -> int:
        return self.shape[self.order[1]]

    @property
    def max_dim_size(self) -> int:
        """The largest entry of the shape, depth included."""
        return max(self.shape)

    @property
    def elems(self) -> int:
        return prod(self.shape[:-1])

    @property
    def coords(self) -> list[str]:
        """Coordinate columns d0, d1, ... by dimension."""
        return [f"d{i}" for i in range(self.non_depth_dims)]

    @property
    def storage_coords(self) -> list[str]:
        """Coordinate columns in storage order."""
        return [f"d{i}" for i in self.order[:-1]]

    def strides(self, split_depths: bool = False, omit_index: bool = False) -> tuple[dict[int, int], int]:
        """(stride of each non-depth dimension, stride of the depth) of the dense layout.

        Storage order decides, its first dimension is the slowest; with ``split_depths`` the
        depth is slower than all, else it is the fastest.
        """
        dims = [d for d in self.order[:-1] if not (omit_index and d == self.order[0])]
        at, out = 1 if split_depths else self.depths, {}
        for d in reversed(dims):
            out[d] = at
            at *= self.shape[d]
        return out, at if split_depths else 1

    def with_index_dim_changed(self) -> TensorMeta:
        """The first two dimensions of the order swapped."""
        a, b, *rest = self.order
        return replace(self, order=(b, a, *rest))

    def to_json(self) -> str:
        return json.dumps({**asdict(self), "matrix_type": self.matrix_type.tag})

    @classmethod
    def from_json(cls, text: str) -> TensorMeta:
        d = json.loads(text)
        return cls(MatrixType(d["matrix_type"]), d["value_type"], tuple(d["shape"]), tuple(d["order"]), d["nnz"], d["index_dim_order"])
