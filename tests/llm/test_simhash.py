"""Fingerprints and components against all-pairs comparison."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import simhash


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(fps, bits=3):
    """Least index reachable of each fingerprint."""
    n, parent = len(fps), list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= bits) + i + 1:
            x, y = root(i), root(int(j))
            parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


def by_classes(spark, fps, **kw):
    signed = [(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)]
    df = spark.createDataFrame(signed, "fp long, rep long")
    from gridloom.plans.star import star_components

    found = {r.node: r.component for r in star_components(simhash.links(df, **kw)).collect()}
    return [found.get(i, i) for i in range(len(fps))]


def flipped(rng, x, k):
    for b in rng.sample(range(64), k):
        x ^= 1 << b
    return x


def test_links_join_all_within_three_bits(spark):
    rng = random.Random(1)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    fps = list({*seeds, *(flipped(rng, s, k) for s in seeds for k in (1, 2, 3, 4))})
    assert by_classes(spark, fps) == components(fps)


def test_large_groups_take_second_signatures(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    places = rng.sample(range(64), 9)
    fps = list({base ^ sum(1 << p for p in places if rng.random() < 0.5) for _ in range(300)} | {flipped(rng, base, 12) for _ in range(40)} | {base ^ (rng.getrandbits(32) << 32) for _ in range(100)})
    want = components(fps)
    assert by_classes(spark, fps, limit=8) == want
    assert by_classes(spark, fps) == want


def test_a_chain_is_one_component(spark):
    rng = random.Random(4)
    fps = [rng.getrandbits(64)]
    for _ in range(25):
        fps.append(flipped(rng, fps[-1], 3))
    assert by_classes(spark, fps) == components(fps)


def test_edge_cases(spark, edge_docs, edge_rows):
    got = {(r.doc_id, r.fp & ((1 << 64) - 1), r.component_id) for r in simhash.near_duplicates(edge_docs).collect()}
    prints = [plain_fingerprint(r[1]) for r in edge_rows]
    ids = [r[0] for r in edge_rows]
    named = [i for i in range(len(ids)) if ids[i] is not None]
    comp = components([prints[i] for i in named])
    least = {}
    for i, c in zip(named, comp, strict=True):
        least[c] = min(least.get(c, ids[i]), ids[i])
    want = {(ids[i], prints[i], least[c]) for i, c in zip(named, comp, strict=True)}
    lone = next(i for i in range(len(ids)) if ids[i] is None)
    assert got == want | {(None, prints[lone], None)}
    assert len(simhash.near_duplicates(edge_docs).collect()) == len(edge_rows)
    by_id = {g[0]: g[2] for g in got}
    assert by_id[3] == 1 and by_id[4] == by_id[5] == by_id[6] == 4 and by_id[7] == 7 and by_id[8] == 7


def test_empty_table(spark, no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    fps = [plain_fingerprint(d.text) for d in docs]
    want = {(d.doc_id, f"{f:016x}", docs[c].doc_id) for d, f, c in zip(docs, fps, components(fps), strict=True)}
    assert {tuple(r) for r in simhash.query(spark, sf).collect()} == want


def test_long_texts_are_counted_in_blocks(monkeypatch):
    text = " ".join(map(str, range(500)))
    want = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text.encode()) == want == plain_fingerprint(text)


def test_signature_keys_do_not_collide(spark):
    df = spark.createDataFrame([(0, 1), (-1, 2)], "fp long, rep long")
    keys = simhash.signatures(df)
    assert keys.count() == 132 and keys.where("rep = 1").select("key").distinct().count() == 66
    second = simhash.second_signatures(keys)
    assert second.count() == 132 * 34 and second.agg(F.min("key")).first()[0] >= 0
