"""The label model on made-up voters, held-out accuracy, and what may not matter."""

import random

import numpy as np
from pyspark.sql import functions as F

from conftest import prose
from gridloom.llm import toxicity


def corpus(spark, n=600, seed=3):
    """Prose of which a fifth holds insults, some in a made-up language, with labels of which a few are wrong."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words, toxic = prose(rng, rng.randint(20, 80)).split(), i % 5 == 0
        if toxic:
            bad = ["idiot", "pathetic", "scum"] if i % 10 else ["grumplo" + rng.choice(("an", "ed", "or")), "grumploti"]
            for w in bad[: rng.randint(1, 3)]:
                words.insert(rng.randrange(len(words)), w)
        docs.append((i, " ".join(words), "xx", "s"))
        labels.append((i, int(toxic) if rng.random() > 0.02 else int(not toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_label_model_finds_accuracies_and_shared_evidence():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    vote = lambda hit, false: np.where(rng.random(4000) < np.where(y, hit, false), 1, 0)
    a, b = vote(0.8, 0.05), vote(0.7, 0.1)
    given = np.where(rng.random(4000) < 0.9, y, ~y) * 2 - 1
    post, share = toxicity.label_model(np.column_stack([a, a, a, b, given]), 4)
    assert ((post > 0.5) == y).mean() > ((given > 0) == y).mean()
    assert share[0] < 0.5 < share[3] and share[4] == 1


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    rows = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    held = [r for r in rows.values() if r.held_out]
    assert len(rows) == 600 and 100 < len(held) < 200
    assert np.mean([(r.predicted == 1) == (r.doc_id % 5 == 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())


def test_held_out_labels_are_not_used(spark):
    docs, labels = corpus(spark, 300)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, labels) == toxicity.train(docs, flipped)


def test_only_the_text_is_scored(spark):
    docs, labels = corpus(spark, 300)
    model = toxicity.train(docs, labels)
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None)).withColumn("doc_id", F.col("doc_id") + 7)
    a, b = ({r.doc_id - k: r.score for r in toxicity.score(d, model).collect()} for d, k in ((docs, 0), (other, 7)))
    assert a == b


def test_edge_cases(spark, edge_docs, edge_rows, no_docs):
    docs, labels = corpus(spark, 200)
    odd = labels.union(spark.createDataFrame([(None, 1), (3, None), (5, 0), (5, 1)], "doc_id long, toxic int"))
    got = toxicity.classify(docs.union(edge_docs.select(docs.columns)), odd.withColumn("text", F.lit("clash"))).collect()
    assert len(got) == 200 + len(edge_rows)
    empty = toxicity.score(edge_docs.where("doc_id in (4, 5, 6)"), toxicity.train(docs, labels)).collect()
    assert len({r.score for r in empty}) == 1 and empty[0].score < 0.3
    assert toxicity.classify(no_docs, labels).count() == 0


def test_without_labels_the_lexicons_decide(spark):
    docs = spark.createDataFrame([(1, "you pathetic idiot"), (2, "a calm day"), (3, None)], "doc_id long, text string")
    for labels in (spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")):
        assert {r.doc_id: r.predicted for r in toxicity.classify(docs, labels).collect()} == {1: 1, 2: 0, 3: 0}


def test_query_covers_every_document(spark):
    import zlib

    sf = "/root/testdata/sf0.001"
    out = toxicity.query(spark, sf)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_training_is_bounded_by_rows(spark):
    docs, labels = corpus(spark, 200)
    many = docs.union(docs.where("doc_id = 1")).union(docs.where("doc_id = 1").withColumn("text", F.lit("zz other text"))).repartition(3)
    assert toxicity.train(many, labels.union(labels)) == toxicity.train(docs, labels)
    assert toxicity._feature_rows(many, F.broadcast(labels)).count() == 200


def test_the_fallback_leaves_german_prose_alone(spark):
    texts = ["Die Stadt liegt am Fluss, und die alten Häuser sind groß (gross) und schön; der Rat tagt, die Frist endet.", "Er ist der Beste, die Burg ist hoch, und die Kinder hurten nicht.", "They die young and burn the letters; what a joke, a loser of a day", "Du Trottel, du Versager!", "vous êtes minable, connard"]
    got = {r.doc_id: r.predicted for r in toxicity.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")).collect()}
    assert got == {0: 0, 1: 0, 2: 0 if len({"joke", "loser"} & {w for x in toxicity.LEXICONS.values() for w in x}) < 2 else 1, 3: 1, 4: 1}


def plain_label_model(votes, given, rounds=30):
    """The same estimates by loops over rows and voters."""
    n, m = len(votes), len(votes[0])
    post = [(0.9 if v[given] > 0 else 0.1) * 0.8 + 0.2 * any(x == 1 for x in v) for v in votes]
    share = [1.0] * m
    for _ in range(rounds):
        prior = min(max(sum(post) / n, 1e-3), 1 - 1e-3)
        tables, seen = [], []
        for j in range(m):
            t = {v: [0.5 + sum(p for p, r in zip(post, votes, strict=True) if r[j] == v), 0.5 + sum(1 - p for p, r in zip(post, votes, strict=True) if r[j] == v)] for v in (-1, 0, 1)}
            tot = [sum(t[v][k] for v in t) for k in (0, 1)]
            t = {v: [t[v][0] / tot[0], t[v][1] / tot[1]] for v in t}
            tables.append(t)
            mean = [sum(v * t[v][k] for v in t) for k in (0, 1)]
            seen.append([r[j] - (p * mean[0] + (1 - p) * mean[1]) for p, r in zip(post, votes, strict=True)])
        new = []
        for r in votes:
            z = np.log(prior / (1 - prior)) + sum(share[j] * np.log(tables[j][r[j]][0] / tables[j][r[j]][1]) for j in range(m))
            new.append(1 / (1 + np.exp(-min(max(z, -30), 30))))
        size = [np.sqrt(sum(x * x for x in s) / n) + 1e-6 for s in seen]
        share = [1 / (1 + sum(min(max(abs(sum(a * b for a, b in zip(seen[i], seen[j], strict=True)) / n / (size[i] * size[j])) - 0.1, 0), 1) for i in range(m) if i != j)) for j in range(m)]
        share[given] = 1.0
        if max(abs(a - b) for a, b in zip(new, post, strict=True)) < 1e-4:
            return new, share
        post = new
    return post, share


def test_label_model_equals_loops():
    rng = np.random.default_rng(4)
    y = rng.random(120) < 0.3
    votes = np.column_stack([np.where(rng.random(120) < np.where(y, h, f), 1, z) for h, f, z in ((0.8, 0.05, 0), (0.6, 0.2, -1), (0.7, 0.1, 0))] + [np.where(rng.random(120) < 0.9, y, ~y) * 2 - 1])
    post, share = toxicity.label_model(votes, 3)
    want, shares = plain_label_model(votes.tolist(), 3)
    assert np.allclose(post, want, atol=1e-6) and np.allclose(share, shares, atol=1e-6)


def test_every_score_of_the_query_by_a_plain_sum(spark):
    """All documents of the smallest tables: the score is the logistic of the summed weights of a text's distinct features."""
    import math
    import re
    import zlib

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    weights, bias = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: r for r in toxicity.query(spark, sf).collect()}
    for r in docs.collect():
        z, seen = bias, set()
        for w in re.findall(r"[^\W\d_]+", (r.text or "").lower()):
            for f in (w, *(f"{k}~{w[:k]}" for k in (4, 5, 6, 7) if len(w) >= k)):
                seen.add(zlib.crc32(f.encode("utf-8", "replace")))
        z += sum(weights.get(k, 0.0) for k in seen)
        score = 1 / (1 + math.exp(-min(max(z, -30), 30)))
        assert abs(got[r.doc_id].score - score) < 1e-9 and got[r.doc_id].predicted == int(score >= 0.3)
