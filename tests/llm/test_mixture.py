"""Targets by water-filling and copies by a plain prefix sum."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from gridloom.llm import mixture


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Reshare the excess over the caps again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return {**capped, **share}
        capped |= {s: most * sizes[s] for s in over}


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, docs):
    """Targets are right, copies follow one prefix sum with some offset, words come near the target."""
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += n_words(text)
    want = plain_targets(sizes)
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter((i, s, n_words(t)) for i, t, s in docs)
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert {r.source_size for r in own} == {sizes[s]}
        assert own[0].target == pytest.approx(want[s])
        rate = want[s] / sizes[s] if sizes[s] else 0
        assert all(r.copies in (math.floor(rate), math.ceil(rate)) and r.taken == r.copies * r.size <= 3 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own)
        assert abs(sum(r.copies for r in own) - rate * len(own)) < 1 + 1e-6


def made(rng, n, sources):
    return [(i, " ".join(["w"] * min(900, int(rng.expovariate(1 / 40)))), rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rng = random.Random(seed)
    docs = made(rng, 400, ["a", "B", "ä", "\U0001f600", None, "src", "hot", "hot", "hot"])
    rows = mixture.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    check(rows, docs)


def test_a_hot_cell_is_dealt_to_lanes(spark):
    docs = [(i, "one two three", "hot") for i in range(500)] + made(random.Random(3), 100, ["hot", "cold"])
    docs = [(i, *d[1:]) for i, d in enumerate(docs)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixture.mix(df, lane=16).collect()
    check(rows, docs)


def test_repeated_null_and_evenly_stepped_ids_are_dealt_to_lanes(spark):
    docs = [(None, "a b", "hot")] * 700 + [(7, "a b", "hot")] * 500 + [(40 * i, "a b", "hot") for i in range(800)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    check(mixture.mix(df, lane=100, unit=50).collect(), docs)
    cells = df.groupBy("doc_id").agg(F.count("*").alias("k"))
    units = cells.withColumn("part", F.explode(F.sequence(F.lit(0), ((F.col("k") - 1) / 50).cast("int"))))
    text = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("part").cast("string"))
    lanes = units.groupBy((mixture._draw(text) % 20).alias("lane")).agg(F.sum(F.least(F.lit(50), F.col("k") - F.col("part") * 50)).alias("m")).collect()
    assert len(lanes) == 20 and max(r.m for r in lanes) < 300


def test_one_offset_and_a_plain_prefix_sum(spark):
    """Copies are the integers that a prefix sum of expected copies crosses, started at the source's one offset."""
    import hashlib

    docs = made(random.Random(6), 150, ["a", "b"])
    rows = mixture.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    for place, source in enumerate(("a", "b"), 1):
        own = sorted((r for r in rows if r.source == source), key=lambda r: (-r.size, r.doc_id))
        u = int(hashlib.md5(f"{mixture.SEED}/{place}".encode()).hexdigest()[:8], 16) / 2**32
        rate = own[0].target / own[0].source_size
        assert [r.copies for r in own] == [math.floor(rate * (i + 1) + u) - math.floor(rate * i + u) for i in range(len(own))]


def test_reruns_agree(spark):
    docs = made(random.Random(5), 200, ["a", "b", "c"])
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    a, b = (sorted(map(tuple, mixture.mix(d).collect())) for d in (df, df.repartition(7)))
    assert a == b


def test_targets_are_capped(spark):
    sizes = {"a": 10, "b": 1000, "c": 1000, "d": 2, "e": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, words long")
    got = {r.source: r.target for r in mixture.targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes)) and got["a"] == 30 and got["e"] == 0


def test_edge_cases(spark, edge_docs, edge_rows, no_docs):
    rows = mixture.mix(edge_docs).collect()
    check(rows, [(r[0], r[1], r[3]) for r in edge_rows])
    assert mixture.mix(no_docs).count() == 0
    empty = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.target, r.taken) for r in mixture.mix(empty).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}


def test_no_python_in_the_plan(spark, edge_docs):
    plan = mixture.mix(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
