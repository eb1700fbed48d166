"""Quality rules: base counts and tokeniser fertility.

A public vocabulary tells ordinary prose from junk by how it splits it: words of a language
it knows cost a usual number of tokens. Each whole text is measured by characters per token,
tokens per word (fertility), the share of byte-fallback tokens, how often a word has its most
common token and the entropy of its tokens, the last against what texts of as many tokens
usually have. Bands per language (else per script) reject what lies outside.

Words are encoded one by one, each distinct word once per worker (bounded cache), which is
what a vocabulary with word-start marks does to them in a text.

Nulls: a null text has no words and fails the base rule like every text of fewer than MIN_WORDS; a null or
unknown lang takes the band of the text's main script. Every row is judged on its own, repeated
rows included. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import ship

MIN_WORDS = 50
MOST_REPEATED = 50  # per cent of words in repeated windows
WINDOW = 3
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
CACHE = 300_000


class Band(NamedTuple):
    """Limits of a language or script; a text must keep within the hard ones, and not be below both soft ones.

    Hard: characters per token, tokens per word, byte-fallback share, most common token per word (of tokens
    that are neither bytes nor a bare word start). Soft together:
    characters per token under ``soft_chars`` and entropy more than ``deficit`` bits under the curve
    a + b log2(n) + c log2(n)**2 of the number of tokens n.
    """

    least_chars: float
    most_fertility: float
    most_bytes: float
    most_common: float
    soft_chars: float
    deficit: float
    curve: tuple[float, float, float]


#: Bands for the 32k vocabulary: what fit_band makes of the 3,534 labelled texts past the base rule in the sample tables of
#: 10,000 documents, rounded; the Latin one of all four languages, lang ignored. A soft limit of 0 is none: hard limits suffice there.
#: No rows of the other scripts are labelled: their bands are guesses.
BANDS = {
    "en": Band(1.665, 3.401, 0.05, 0.254, 0.0, 99.0, (1.32, 0.918, -0.037)),
    "de": Band(1.844, 3.368, 0.05, 0.273, 0.0, 99.0, (1.988, 0.776, -0.032)),
    "fr": Band(1.489, 3.867, 0.05, 0.29, 0.0, 99.0, (2.072, 0.756, -0.031)),
    "es": Band(1.618, 3.352, 0.05, 0.308, 0.0, 99.0, (1.303, 0.914, -0.038)),
    "Latin": Band(1.6, 3.6, 0.05, 0.36, 2.15, 0.40, (1.526, 0.876, -0.036)),
    "Cyrillic": Band(0.8, 8.0, 0.30, 0.90, 1.20, 0.90, (2.0, 0.75, -0.030)),
    "Greek": Band(0.5, 14.0, 0.60, 0.90, 0.70, 0.90, (2.0, 0.75, -0.030)),
    "other": Band(0.2, 1e9, 0.98, 1e9, 0.30, 0.90, (2.0, 0.75, -0.030)),
}


class Sample(NamedTuple):
    """Measures of labelled texts, a row each: characters per token, fertility, byte share, entropy, most common token, tokens."""

    good: np.ndarray
    bad: np.ndarray


def fit_band(sample: Sample, dear: int = 10) -> Band:
    """A band from labelled texts past the base rule.

    Hard limits are the good texts' extremes, widened by a tenth to a fifth. The curve is the good texts' entropy by
    least squares. Of all soft pairs on a grid of the texts' own values, the one that rejects most bad texts, a good one
    counting ``dear`` times; ties go to the narrower.
    """
    good, bad = sample
    x = np.log2(np.maximum(good[:, 5], 2.0))
    c, b, a = np.polyfit(x, good[:, 3], 2)
    hard = Band(0.9 * good[:, 0].min(), 1.1 * good[:, 1].max(), max(0.05, 1.5 * good[:, 2].max()), 1.2 * good[:, 4].max(), 0.0, 99.0, (float(a), float(b), float(c)))
    within_hard = lambda r: (r[:, 0] >= hard.least_chars) & (r[:, 1] <= hard.most_fertility) & (r[:, 2] <= hard.most_bytes) & (r[:, 4] <= hard.most_common)
    good, bad = good[within_hard(good)], bad[within_hard(bad)]

    def lack(r: np.ndarray) -> np.ndarray:
        n = np.log2(np.maximum(r[:, 5], 2.0))
        return a + b * n + c * n * n - r[:, 3]

    best = (0, 0.0, 99.0)
    chars = np.unique(np.quantile(np.concatenate([good[:, 0], bad[:, 0]]), np.linspace(0, 1, 80))) if len(bad) else []
    short = np.unique(np.quantile(np.concatenate([lack(good), lack(bad)]), np.linspace(0.3, 1, 80))) if len(bad) else []
    for soft in chars:
        for deficit in short:
            out = lambda r: int(((r[:, 0] < soft) & (lack(r) > deficit)).sum())
            gain = out(bad) - dear * out(good)
            if gain > best[0]:
                best = (gain, float(soft), float(deficit))
    return hard._replace(soft_chars=best[1], deficit=best[2])


def script_of(text: str) -> str:
    """The script of most letters: Latin, Greek, Cyrillic or other."""
    if text.isascii():
        return "Latin"
    n = dict.fromkeys(("Latin", "Greek", "Cyrillic", "other"), 0)
    for i in range(0, len(text), 1 << 20):
        c = np.frombuffer(text[i : i + (1 << 20)].encode("utf-32-le", "surrogatepass"), "<u4")
        latin = ((c >= 0x41) & (c <= 0x5A)) | ((c >= 0x61) & (c <= 0x7A)) | ((c >= 0xC0) & (c < 0x250))
        greek, cyrillic = (c >= 0x370) & (c < 0x400), (c >= 0x400) & (c < 0x530)
        for k, x in (("Latin", latin), ("Greek", greek), ("Cyrillic", cyrillic), ("other", c >= 0x530)):
            n[k] += int(x.sum())
    return max(n, key=n.get)


def repeated_words(words: list) -> int:
    """Words that lie in a window of WINDOW words which the list holds at least twice."""
    n = len(words)
    if n <= WINDOW:
        return 0
    first: dict = {}
    at = np.fromiter(map(first.setdefault, words, range(n)), np.int64, n)
    if n < 2_000_000:
        key = (at[:-2] * n + at[1:-1]) * n + at[2:]
    else:
        pair = np.unique(at[:-2] * n + at[1:-1], return_inverse=True)[1]
        key = pair * n + at[2:]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    if len(count) == len(key):
        return 0
    hit = np.zeros(n, bool)
    start = np.flatnonzero(count[back] > 1)
    for i in range(WINDOW):
        hit[start + i] = True
    return int(hit.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            if line in seen:
                n += 1
            seen.add(line)
    return n


class Fertility:
    """Token ids of words by a sentencepiece vocabulary, kept in two generations."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(size)])
        self.is_part = self.is_byte | np.array([self.model.id_to_piece(i) == "\u2581" for i in range(size)])
        self.width = "<u2" if size <= 1 << 16 else "<u4"
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def ids(self, words: list[bytes]) -> np.ndarray:
        try:
            raw = b"".join(map(self.new.__getitem__, words))
        except KeyError:
            if len(self.new) > CACHE:
                self.old, self.new = self.new, {}
            new, old = self.new, self.old
            fresh = []
            for w in set(words).difference(new):
                if w in old:
                    new[w] = old[w]
                else:
                    fresh.append(w)
            for w, i in zip(fresh, self.model.encode([w.decode("utf-8", "replace") for w in fresh], num_threads=1), strict=True):
                new[w] = np.array(i, self.width).tobytes()
            raw = b"".join(map(new.__getitem__, words))
            for w in fresh:
                if len(w) > 200:
                    del new[w]
        return np.frombuffer(raw, self.width)

    def measure(self, words: list[bytes], chars: int) -> tuple[float, float, float, float]:
        """(characters per token, tokens per word, byte share, entropy in bits)."""
        return self.measure_all(words, chars)[:4]

    def measure_all(self, words: list[bytes], chars: int) -> tuple[float, float, float, float, float]:
        """The same and the most common token per word."""
        ids = self.ids(words)
        n = len(ids)
        if not n:
            return 0.0, 0.0, 0.0, 0.0, 0.0
        kinds, count = np.unique(ids, return_counts=True)
        entropy = np.log2(n) - float((count * np.log2(count)).sum()) / n
        common = int(count[~self.is_part[kinds]].max(initial=0)) / len(words)
        return chars / n, n / len(words), float(count[self.is_byte[kinds]].sum()) / n, entropy, common


def within(band: Band, chars: float, fertility: float, share: float, entropy: float, common: float, n_tokens: float) -> bool:
    """Whether the measures lie in the band."""
    if chars < band.least_chars or fertility > band.most_fertility or share > band.most_bytes or common > band.most_common:
        return False
    x = np.log2(max(n_tokens, 2.0))
    usual = band.curve[0] + band.curve[1] * x + band.curve[2] * x * x
    return bool(chars >= band.soft_chars or entropy >= usual - band.deficit)


_MODELS: dict[str, Fertility] = {}

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_per_token double, fertility double, byte_share double, entropy double, base_failed boolean, kept boolean"


def judge_text(text: str | None, lang: str | None, model: Fertility, bands: dict[str, Band]) -> tuple:
    """All columns of SCHEMA but doc_id, of one text."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()  # on bytes: exactly \x20 \x09-\x0D
    chars = len(text) - sum(map(text.count, SPACES))
    symbols, lines, repeated = sum(map(text.count, SYMBOLS)), repeated_lines(text), repeated_words(words)
    *measures, common = model.measure_all(words, chars)
    failed = len(words) < MIN_WORDS or 100 * repeated > MOST_REPEATED * len(words)
    band = bands.get(lang) if lang else None
    kept = not failed and within(band or bands[script_of(text)], *measures, common=common, n_tokens=measures[1] * len(words))
    return (len(words), chars, symbols, lines, repeated, *measures, failed, kept)


def assess(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bands: dict[str, Band] = BANDS) -> DataFrame:
    """One row per document: base counts, measures, base_failed and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _MODELS.get(vocabulary) or _MODELS.setdefault(vocabulary, Fertility(vocabulary))
        kinds = [pa.int64()] * 5 + [pa.float64()] * 4 + [pa.bool_()] * 2
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            rows = [judge_text(t, g, model, bands) for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            cols = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    ship(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return narrow.mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, vocabulary: str, text_col: str = "text", lang_col: str = "lang", bands: dict[str, Band] = BANDS) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are; no shuffle and no join."""
    text_at, lang_at, names = docs.columns.index(text_col), docs.columns.index(lang_col), [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _MODELS.get(vocabulary) or _MODELS.setdefault(vocabulary, Fertility(vocabulary))
        for b in batches:
            kept = [judge_text(t, g, model, bands)[-1] for t, g in zip(b.column(text_at).to_pylist(), b.column(lang_at).to_pylist(), strict=True)]
            yield b.filter(pa.array(kept, pa.bool_()))

    ship(docs.sparkSession)
    plain = docs.toDF(*names)  # columns by place: their own names may hold anything
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: base counts and verdict of every document."""
    import public_tokenizers

    out = assess(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
