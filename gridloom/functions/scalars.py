"""Column functions: integer arithmetic, complex values, formatting and parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ceil_div(a: Column, b: Column) -> Column:
    """Ceiling of a / b for non-negative integers; 0 for a = 0, the largest long for b = 0."""
    a, b = a.cast("long"), b.cast("long")
    return F.when(a == 0, F.lit(0)).when(b == 0, F.lit((1 << 63) - 1)).otherwise(F.call_function("div", a - 1, F.nullif(b, F.lit(0))) + 1)


def log2_floor(n: Column) -> Column:
    """Floor of log2 of a positive integer, exact at powers of two; 4294967295 for 0."""
    return F.when(n == 0, F.lit((1 << 32) - 1)).otherwise(F.length(F.bin(n)) - 1).cast("long")


def encode_size(top: Column) -> Column:
    """Bytes that hold an integer up to ``top``: 1 to 8."""
    out = F.lit(8)
    for k in range(7, 0, -1):
        out = F.when(top < (1 << (8 * k)), F.lit(k)).otherwise(out)
    return out.cast("long")


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def complex_add(a: Column, b: Column) -> Column:
    return complex_of(a["re"] + b["re"], a["im"] + b["im"])


def complex_mul(a: Column, b: Column) -> Column:
    return complex_of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def complex_conj(a: Column) -> Column:
    return complex_of(a["re"], -a["im"])


def complex_abs(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def is_nonzero(x: Column, value_type: str) -> Column:
    """Whether a value is not zero; a complex value is zero if both parts are."""
    if value_type in ("c32", "c64"):
        return (x["re"] != 0) | (x["im"] != 0)
    return x != 0


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _six_digits(v: Column) -> Column:
    """A double rounded to six significant digits as C does it: by its exact binary value, ties to even."""
    high = lambda y: F.lit(134217729.0) * y - (F.lit(134217729.0) * y - y)

    def small(s: Column) -> Column:
        a, ten, p = s["a"], s["ten"], s["a"] * s["ten"]
        ah, th = high(a), high(ten)
        al, tl = a - ah, ten - th
        rest = al * tl - (((p - ah * th) - al * th) - ah * tl)  # what the product lost
        whole = F.floor(p).cast("double")
        up = (p - whole > 0.5) | ((p - whole == 0.5) & ((rest > 0) | ((rest == 0) & (whole % 2 == 1))))
        return (whole + F.when(up, 1.0).otherwise(0.0)) / ten

    def large(s: Column) -> Column:
        count = F.floor(s["a"] * 1.0 / s["step"]).cast("double")
        left = 2 * (s["a"] - count * s["step"])
        return (count + F.when((left > s["step"]) | ((left == s["step"]) & (count % 2 == 1)), 1.0).otherwise(0.0)) * s["step"]

    a, ten = F.abs(v), F.lit(10.0)
    places = F.lit(5) - F.floor(F.log10(a))
    parts = F.struct(a.alias("a"), places.alias("places"), F.pow(ten, places).alias("ten"), F.pow(ten, -places).alias("step"))
    out = _let(parts, lambda s: F.when((s["places"] >= 0) & (s["places"] <= 22), small(s)).when((s["places"] < 0) & (s["places"] >= -9), large(s)).otherwise(s["a"]))
    return F.when(v == 0, v).when(v < 0, -out).otherwise(out)


def format_value(x: Column, value_type: str = "f64") -> Column:
    """Text with six significant digits; complex as ``(re, im)``."""
    if value_type in ("c32", "c64"):
        return F.format_string("(%s, %s)", format_value(x["re"]), format_value(x["im"]))
    if value_type in ("i64", "bool"):
        return x.cast("string")

    def written(v: Column) -> Column:
        power = F.floor(F.log10(F.abs(v))).cast("int")
        sci = F.regexp_replace(F.format_string("%.5e", v), r"\.?0+e", "e")
        short = F.regexp_replace(F.format_string("%.6g", v), r"(\.\d*?)0+$", "$1")
        text = F.when((power < -4) | (power >= 6), sci).otherwise(F.regexp_replace(short, r"\.$", ""))
        return F.when(v == 0, F.lit("0")).when(F.isnan(v), F.lit("nan")).otherwise(text)

    return _let(_let(x.cast("double"), _six_digits), written)


def format_vector(xs: Column, most: int = -1) -> Column:
    """``[a, b, ...]`` with at most ``most`` items, then ``...``."""
    text = F.transform(xs, lambda x: x.cast("string"))
    if most < 0:
        return F.concat(F.lit("["), F.array_join(text, ", "), F.lit("]"))
    short = F.concat(F.lit("["), F.array_join(F.slice(text, 1, most), ", "), F.lit(", ...]") if most else F.lit("...]"))
    return F.when(F.size(xs) > most, short).otherwise(F.concat(F.lit("["), F.array_join(text, ", "), F.lit("]")))


def parse_vector(text: Column, kind: str = "long") -> Column:
    """Numbers of ``(1, 2, 3)`` or ``[1 2 3]`` as an array."""
    inner = F.trim(F.regexp_replace(text, r"[\[\]()]", ""))
    return F.when(inner == "", F.array().cast(f"array<{kind}>")).otherwise(F.transform(F.split(inner, r"[\s,]+"), lambda x: x.cast(kind)))
