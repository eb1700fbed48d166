"""Hits against a plain search of every window in every document."""

import random
import re
from collections import Counter

import pytest

from conftest import prose
from gridloom.llm import decontam


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        x = words(t)
        n = min(13, len(x))
        windows = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if x else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def check(spark, docs, items, df=None):
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as doc_id", "'x' as words", "'x' as rid")
    df = df if df is not None else spark.createDataFrame(docs, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontam.decontaminate(df, bench).collect())
    assert got == Counter((d, n, h, tuple(f), c) for d, t in docs for n, h, f, c in [plain(t, items)])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_planted_passages(spark, seed):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.randint(13, 40))) for i in range(12)]
    docs = []
    for d in range(60):
        text = prose(rng, rng.randint(0, 80)).split()
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(items)[1].split()
            n = rng.randint(5, len(w))
            at = rng.randrange(len(w) - n + 1)
            k = rng.randrange(len(text) + 1)
            text = text[:k] + w[at : at + n] + text[k:]
        docs.append((d, rng.choice((" ", ", ", "\n")).join(text).upper() if d % 3 else " ".join(text)))
    check(spark, docs, items)


def test_every_window_of_thirteen_words_is_found(spark):
    rng = random.Random(9)
    item = prose(rng, 60)
    w = item.split()
    docs = [(i, " ".join([*prose(rng, 20).split(), *w[i : i + 13], *prose(rng, 20).split()])) for i in range(len(w) - 12)]
    docs += [(100 + i, " ".join(w[i : i + 12])) for i in range(10)]
    check(spark, docs, [(1, item)])


def test_short_items_repeated_words_and_overlaps(spark):
    items = [(1, "one"), (2, "two three"), (3, "a a a a a"), (4, "so it goes on and on and on"), (5, "two three"), (10, "b " * 20), (None, "four five six"), (6, ""), (7, None), (8, "...")]
    docs = [(1, "One, two-three!"), (2, "a a a a a a a x a a a a"), (3, "b " * 40), (4, "so it goes on and on and on and on"), (5, "three two"), (6, None), (7, ""), (8, "zzz four five six"), (8, "zzz four five six"), (None, "one")]
    check(spark, docs, items)


def test_edge_cases(spark, edge_docs, edge_rows, no_docs):
    long = next(r[1] for r in edge_rows if r[0] == 9)
    items = [(1, " ".join(long.split()[20_000:20_040])), (2, edge_rows[0][1]), (3, "É ü x")]
    check(spark, [(r[0], r[1]) for r in edge_rows], items, edge_docs)
    check(spark, [(r[0], r[1]) for r in edge_rows], [], edge_docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontam.decontaminate(no_docs, bench).count() == 0


def test_a_full_bit_table_changes_nothing(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, prose(rng, 30)) for i in range(40)]
    docs = [(i, prose(rng, 50) + (" " + items[i][1] if i % 2 else "")) for i in range(30)]
    monkeypatch.setattr(decontam, "BITS_MOST", 64)
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    check(spark, docs, items)


def test_no_python_in_the_plan(spark, edge_docs):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = decontam.decontaminate(edge_docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("seed", [5, 6])
def test_segments_change_nothing(spark, monkeypatch, seed):
    """Segments of 16 words: passages lie across one border, across several, and at the ends of texts."""
    monkeypatch.setattr(decontam, "SEGMENT", 16)
    monkeypatch.setattr(decontam, "SHORT", 40)
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.randint(14, 60))) for i in range(6)] + [(7, "a b"), (8, "q r s t u"), (9, "a b")]
    docs = []
    for d in range(60):
        words_ = prose(rng, rng.randint(0, 50)).split()
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(items)[1].split()
            a = rng.randrange(len(w))
            k = rng.randrange(len(words_) + 1)
            words_ = words_[:k] + w[a:] + words_[k:]
        docs.append((d, rng.choice((" ", "... ", "\n\n")).join(words_) + rng.choice(("", " ", "?!"))))
    docs += [(100, " " * 200), (101, items[0][1] * 3), (102, None), (103, "-" * 100 + items[1][1]), (104, "x" * 300)]
    check(spark, docs, items)


def test_a_long_text_that_one_item_covers(spark):
    rng = random.Random(7)
    item = prose(rng, 60)
    text = " ".join([item] * 400)
    got = decontam.decontaminate(spark.createDataFrame([(1, text), (2, "\n" * 300_000 + item + " " * 300_000)], "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string"))
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_spans, r["items"]) for r in got.collect()) == [(1, 24_000, 24_000, 24_000 - 12 - 399 * 12, ["5"]), (2, 60, 60, 48, ["5"])]


def test_many_items_and_documents_of_one_passage_are_not_multiplied(spark):
    rng = random.Random(8)
    shared = prose(rng, 15)
    items = [(i, f"{shared} {prose(rng, 14)}") for i in range(60)]
    docs = [(i, f"before{i} {shared} after{i}") for i in range(50)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    check(spark, docs, items)
    _, spans, groups = decontam.find_hits(df, bench)
    assert spans.count() == 50 * 3 and groups.groupBy("gid").count().where("count = 60").count() == 1
