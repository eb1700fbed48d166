"""Toxicity by weak supervision.

Many voters look at a text: lexicons of insults, patterns, and lexicons of stems mined from
labelled rows. A generative label model (Dawid and Skene's, two classes) estimates by
expectation-maximisation how each voter votes given the class, with the given label as one
more voter, and how voters' errors correlate; a voter's evidence is divided by how much
of it others repeat. Its posteriors are the labels on which a logistic regression is trained,
whose features are hashes of words and word stems; the features that tell the
classes apart in the posteriors (at most FEATURES) have weights, all others none. Every whole text is scored by it.

Labels are taken from rows outside the held-out quarter (crc32 of the id mod 4 is 2) and
only from the TRAIN_MOST of them with the least hash of their id. Their features are written once and
counted on the executors; what the driver gets is at most CANDIDATES counted features, then
each row's votes and which of these features it has. Neither label, language, source nor id enters a score.

TRAIN_MOST bounds the rows: an id that documents repeat is trained on by its least text. CANDIDATES, FEATURES and MINED
are the model's size, as the width of a layer is: every whole text is scored by all features the model has.

Nulls: a null text is empty and gets the classifier's prior; null ids or labels are not trained on, and a null id is not
held out. Repeated label rows of an id count once, as toxic if any says so; repeated documents are scored one by one. Without labels
of both classes the lexicons decide: two insults make a text toxic, one does not. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, ship

HELD_OUT = (4, 2)  # crc32 of the id modulo the first is the second
TRAIN_MOST = 20_000  # labelled rows that are trained on
CANDIDATES = 20_000  # features that the driver gets to see
FEATURES = 3000
MINED = 240  # mined stems, dealt to MINED_VOTERS voters
MINED_VOTERS = 12
THRESHOLD = 0.3
LOOSE = 0.4  # the same among candidates, by given labels
PURE = 0.6  # share of positive rows that a telling feature needs
STEMS = (4, 5, 6, 7)

WORD = re.compile(r"[^\W\d_]+")
#: Lexicons of insulting words, by kind and language. Words that are common in another of the languages,
#: such as "die", "gross" and "rat" in German, are left out.
LEXICONS = {
    "stupidity": ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "imbecile", "cretin", "fool"),
    "contempt": ("pathetic", "worthless", "loser", "losers", "useless", "failure", "coward"),
    "dehumanising": ("scum", "trash", "vermin", "garbage", "filth", "subhuman", "parasites"),
    "ridicule": ("clown", "clowns", "joke", "freak", "weirdo", "buffoon"),
    "disgust": ("disgusting", "revolting", "vile", "repulsive", "nasty"),
    "threat": ("kill", "strangle", "murder", "hang", "shoot"),
    "french": ("imbécile", "crétin", "ordure", "minable", "débile", "connard"),
    "german": ("idioten", "trottel", "dummkopf", "abschaum", "arschloch", "versager"),
    "spanish": ("imbécil", "estúpido", "basura", "escoria", "cretino", "payaso"),
}


def features(text: str) -> set[int]:
    """Hashes of the distinct words of a text and of their stems (first letters)."""
    out: set[int] = set()
    crc = zlib.crc32
    for w in set(WORD.findall(text.lower())):
        b = w.encode("utf-8", "replace")
        out.add(crc(b))
        n = len(w)
        out.update(crc(b"%d~" % k + w[:k].encode("utf-8", "replace")) for k in STEMS if n >= k)
    return out


def fixed_votes(text: str) -> list[int]:
    """Votes of the lexicons (1 or 0, abstaining) and patterns (1 toxic, -1 clean, 0)."""
    words = WORD.findall(text.lower())
    have, n = set(words), max(1, len(words))
    votes = [int(not have.isdisjoint(x)) for x in LEXICONS.values()]
    insults = sum(votes)
    letters = sum(map(str.isalpha, text)) or 1
    votes.append(int(insults > 1))
    votes.append(int(insults > 0 and not have.isdisjoint(("you", "your", "u"))))
    votes.append(int(text.count("!") > 0.2 * n))
    votes.append(int(sum(map(str.isupper, text)) > 0.6 * letters))
    votes.append(int(max(Counter(words).values(), default=0) > 0.4 * n and n > 5))
    votes.append(-1 if insults == 0 else 0)
    votes.append(-1 if insults == 0 and re.search(r"(?i)licen[cs]e|copyright|https?://", text) else 0)
    return votes


def _counted(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, ...]:
    """(features, place of each occurrence, its row, rows with the feature, their sum of y, z-score of that sum).

    Only features found in two rows with y over 0.1 are counted: no others can tell the classes apart.
    """
    likely = np.concatenate([*(rows[i] for i in np.flatnonzero(y > 0.1)), np.zeros(0, np.uint32)])
    kinds, seen = np.unique(likely, return_counts=True)
    kinds = kinds[seen > 1]
    of, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for i, r in enumerate(rows if len(kinds) else []):
        place = np.minimum(np.searchsorted(kinds, r), len(kinds) - 1)
        place = place[kinds[place] == r].astype(np.int32)
        at.append(place)
        of.append(np.full(len(place), i, np.int32))
    of, at = np.concatenate(of), np.concatenate(at)
    every, pos = np.bincount(at, minlength=len(kinds)), np.bincount(at, y[of], len(kinds))
    share = y.mean()
    return kinds, at, of, every, pos, (pos - every * share) / np.sqrt(np.maximum(every * share * (1 - share), 1e-9))


def _telling(every: np.ndarray, pos: np.ndarray, z: np.ndarray, most: int) -> np.ndarray:
    """Places of the features with the highest z-scores, of those found mostly where y is 1."""
    best = np.argsort(-z, kind="stable")
    return best[(z[best] > 4) & (pos[best] >= 2.5) & (pos[best] >= PURE * (every[best] + 1))][:most]


def mine(rows: list[np.ndarray], y: np.ndarray, most: int) -> np.ndarray:
    """The features most over-represented in rows with y = 1."""
    kinds, _, _, every, pos, z = _counted(rows, y)
    return kinds[_telling(every, pos, z, most)]


def label_model(votes: np.ndarray, given: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(posteriors, evidence share of each voter) of a two-class generative model.

    ``votes`` has a row per text with -1, 0 or 1 per voter; column ``given`` is the label.
    """
    n, m = votes.shape
    post = np.where(votes[:, given] > 0, 0.9, 0.1) * 0.8 + 0.2 * ((votes == 1).sum(1) > 0)
    share = np.ones(m)
    for _ in range(rounds):
        prior = float(np.clip(post.mean(), 1e-3, 1 - 1e-3))
        odds = np.full(n, np.log(prior / (1 - prior)))
        seen = np.zeros((n, m))
        for j in range(m):
            p = np.array([[post[votes[:, j] == v].sum() + 0.5, (1 - post)[votes[:, j] == v].sum() + 0.5] for v in (-1, 0, 1)])
            p /= p.sum(axis=0)
            odds += share[j] * np.log(p[:, 0] / p[:, 1])[votes[:, j] + 1]
            mean = (p * np.array([[-1], [0], [1]])).sum(axis=0)
            seen[:, j] = votes[:, j] - (post * mean[0] + (1 - post) * mean[1])
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        size = np.sqrt((seen**2).mean(axis=0)) + 1e-6
        tied = np.abs(seen.T @ seen / n / np.outer(size, size)) - 0.1
        np.fill_diagonal(tied, 0)
        share = 1 / (1 + np.clip(tied, 0, 1).sum(axis=1))
        share[given] = 1.0
        if np.abs(new - post).max() < 1e-4:
            return new, share
        post = new
    return post, share


def fit_linear(rows: list[np.ndarray], y: np.ndarray, most: int = FEATURES, rounds: int = 300) -> tuple[dict[int, float], float]:
    """Logistic regression on presence of selected features with soft labels; (weights, bias)."""
    kinds, at, of, every, pos, z = _counted(rows, y)
    share = float(y.mean())
    pick = _telling(every, pos, z, most)
    place = np.full(len(kinds), -1)
    place[pick] = np.arange(len(pick))
    use = place[at] >= 0
    col, row = place[at][use], of[use]
    w, bias, size = np.zeros(len(pick)), np.log(share / (1 - share)), np.ones(len(pick))
    bsize, n = 1.0, len(rows)
    for _ in range(rounds):
        e = y - 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, w[col], n), -30, 30)))
        g, gb = np.bincount(col, e[row], len(pick)) - 0.5 * w, float(e.sum())
        size, bsize = size + g * g, bsize + gb * gb
        w, bias = w + 0.5 * g / np.sqrt(size), bias + 0.5 * gb / np.sqrt(bsize)
    return {int(k): float(x) for k, x in zip(kinds[pick], w, strict=True)}, float(bias)


def lexicon_model() -> tuple[dict[int, float], float]:
    """The model where labels of both classes are missing."""
    return {zlib.crc32(w.encode()): 2.0 for x in LEXICONS.values() for w in x}, -3.0


def fit(feats: list[np.ndarray], votes: np.ndarray, y: np.ndarray) -> tuple[dict[int, float], float]:
    """Mine stems, run the label model and train the classifier."""
    if not 0 < y.sum() < len(y):
        return lexicon_model()
    stems = mine(feats, y, MINED)
    more = np.zeros((len(feats), MINED_VOTERS), int)
    group = {int(s): i % MINED_VOTERS for i, s in enumerate(stems)}
    for i, f in enumerate(feats):
        for s in np.intersect1d(f, stems).tolist():
            more[i, group[s]] = 1
    votes = np.column_stack([votes, more, np.where(y > 0, 1, -1)])
    post, _ = label_model(votes, votes.shape[1] - 1)
    return fit_linear(feats, post)


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % HELD_OUT[0] == HELD_OUT[1], F.lit(False))


def _feature_rows(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (doc_id, toxic, features, votes) of the labelled documents, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            feats = [np.sort(np.fromiter(features(t), np.uint32)).tobytes() for t in texts]
            votes = [np.array(fixed_votes(t), np.int8).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(feats, pa.binary()), pa.array(votes, pa.binary())], ["doc_id", "toxic", "features", "votes"])

    ship(docs.sparkSession)
    one = docs.join(known, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return cut(one.mapInArrow(run, "doc_id long, toxic int, features binary, votes binary"), "training")


def _candidates(rows: DataFrame, n: int, positive: int) -> np.ndarray:
    """The features that tell the given labels apart best, at most CANDIDATES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = b.column(0).to_numpy(zero_copy_only=False)
            feats = [np.frombuffer(f, np.uint32) for f in b.column(1).to_pylist()]
            flat = np.concatenate([*feats, np.zeros(0, np.uint32)])
            kinds, at = np.unique(flat, return_inverse=True)
            pos = np.bincount(at, np.repeat(toxic, [len(f) for f in feats]), len(kinds)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int64)), pa.array(np.bincount(at, minlength=len(kinds))), pa.array(pos)], ["feature", "every", "pos"])

    counted = rows.select("toxic", "features").mapInArrow(run, "feature long, every long, pos long").groupBy("feature").agg(F.sum("every").alias("every"), F.sum("pos").alias("pos"))
    share = positive / n
    z = (F.col("pos") - F.col("every") * share) / F.sqrt(F.col("every") * (share * (1 - share)))
    best = counted.where((F.col("pos") >= 2) & (F.col("pos") >= LOOSE * (F.col("every") + 1))).withColumn("z", z).where("z > 3").orderBy(F.desc("z"), "feature").limit(CANDIDATES)
    return np.sort(np.array([r[0] for r in best.select("feature").collect()], np.uint32))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_MOST) -> tuple[dict[int, float], float]:
    """Fit voters, label model and classifier on at most ``most`` labelled rows that are not held out."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    rows = _feature_rows(docs, known)
    n, positive = rows.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not 0 < positive < n:
        return lexicon_model()
    chosen = _candidates(rows, n, positive)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            feats = [np.intersect1d(np.frombuffer(f, np.uint32), chosen, assume_unique=True).tobytes() for f in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(feats, pa.binary()), b.column(3)], ["doc_id", "toxic", "features", "votes"])

    got = rows.mapInArrow(narrow, rows.schema).collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["features"]), bytes(r["votes"])))
    feats = [np.frombuffer(r["features"], np.uint32) for r in got]
    votes = np.stack([np.frombuffer(r["votes"], np.int8) for r in got]).astype(int)
    return fit(feats, votes, np.array([r["toxic"] for r in got], float))


def score(docs: DataFrame, model: tuple[dict[int, float], float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, score) per document."""
    weights, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, known = zlib.crc32, {}
        for b in batches:
            out = np.zeros(b.num_rows)
            for i, text in enumerate(b.column(1).to_pylist()):
                hit: set[int] = set()
                for w in set(WORD.findall((text or "").lower())):
                    f = known.get(w)
                    if f is None:
                        raw = w.encode("utf-8", "replace")
                        f = tuple(k for k in (crc(raw), *(crc(b"%d~" % k + w[:k].encode("utf-8", "replace")) for k in STEMS if len(w) >= k)) if k in weights)
                        if len(known) > 500_000:
                            known.clear()
                        known[w] = f
                    if f:
                        hit.update(f)
                out[i] = bias + sum(weights[k] for k in sorted(hit))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))], ["doc_id", "score"])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = score(docs, train(docs, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: toxicity score of every document."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
