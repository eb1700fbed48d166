"""Each stage against brute force on its own input, and the whole run."""

import random

import pytest

import corpus_pipeline as pipeline
from conftest import prose
from gridloom.llm import simhash
from test_decontam import plain as plain_hits
from test_tokenfile import expected as expected_tokens
from test_simhash import components, plain_fingerprint

pytest.importorskip("public_tokenizers")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(8)
    items = [(i, prose(rng, 30)) for i in range(5)]
    docs = []
    for i in range(80):
        text = prose(rng, rng.randint(60, 200))
        if i % 10 == 1:
            text = docs[-1][1].replace(" ", "  ", 1)
        if i % 10 == 2:
            text += " " + items[i % 5][1]
        if i % 10 == 4:  # a passage in a text so long that it is not a twentieth of it
            text = f"{prose(rng, 700)} {' '.join(items[i % 5][1].split()[4:20])} {text}"
        if i % 10 == 3:
            text = " ".join(w + "#$%&*|~" for w in text.split())
        docs.append((i, text, ("en", None)[i % 7 == 0], ("a", "b", None)[i % 3], len(text)))
    docs += [(None, docs[0][1], "en", "a", 5), (None, prose(rng, 90), None, None, None), (90, None, "en", "a", None), (91, "", None, None, 0), docs[5], docs[5]]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, items


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages(spark, sf):
    path, _, items = sf
    docs = spark.read.parquet(f"{path}/documents.parquet")
    before, seen = rows(docs), []
    for name, stage in pipeline.STAGES[:-1]:
        out = pipeline.cut(stage(spark, docs, path), "test")
        assert out.columns == docs.columns, name
        after = rows(out)
        seen.append((name, before, after))
        docs, before = out, after
    quality, dedup, clean, mix = seen
    assert len(quality[2]) < len(quality[1]) and not any(r[1] is None or len(r[1].split()) < 50 or "#$%&*" in r[1] for r in quality[2])
    ordered = sorted(dedup[1], key=lambda r: (r[0] is None, r[0] or 0))
    roots = components([plain_fingerprint(r[1]) for r in ordered])
    assert sorted(map(str, dedup[2])) == sorted({str(ordered[c]) for c in roots})
    assert any(r[0] is None for r in dedup[2])
    hits = [plain_hits(r[1], items) for r in clean[1]]
    assert clean[2] == [r for r, h in zip(clean[1], hits, strict=True) if not h[1]] and len(clean[2]) < len(clean[1])
    assert any(h[1] and not h[3] for h in hits)
    assert set(mix[2]) <= set(mix[1])
    assert all(mix[2].count(r) <= 3 * mix[1].count(r) for r in set(mix[2]))
    total = sum(len(r[1].split()) for r in mix[1])
    assert abs(sum(len(r[1].split()) for r in mix[2]) - total) < 0.25 * total
    last = pipeline.token_ids(spark, docs, path).collect()
    assert sorted(map(tuple, last), key=lambda r: r[1]) == expected_tokens(mix[2])


def test_run(spark, sf):
    out = pipeline.run(spark, sf[0])
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    got = sorted(out.collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids)


def test_empty_table(spark, sf, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf[0]}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_group_keeps_one(spark, sf):
    docs = spark.read.parquet(f"{sf[0]}/documents.parquet").where("doc_id is not null")
    kept = pipeline.near_dedup(spark, docs, sf[0])
    groups = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(groups)


def test_quality_stage_rejects_the_same_mark_on_every_word(spark, sf):
    rng = random.Random(9)
    texts = [prose(rng, rng.randint(60, 200)) for _ in range(20)]
    docs = [(i, t, ("en", "de", None, "xx")[i % 4], "a", len(t)) for i, t in enumerate(texts)]
    docs += [(100 + i, " ".join(w + "###" for w in t.split()), g, "a", None) for i, t, g, _, _ in docs]
    kept = pipeline.quality_rules(spark, spark.createDataFrame(docs, COLUMNS), sf[0]).collect()
    assert sorted(r.doc_id for r in kept) == list(range(20))


@pytest.mark.parametrize("swap", [False, True])
def test_a_repeated_id_with_other_texts_loses_no_group(spark, sf, swap):
    rng = random.Random(12)
    a, b, c = (prose(rng, 100) for _ in range(3))
    docs = [(3, b, "en", "a", 1), (7, a, "en", "a", 2), (7, b, "en", "a", 3), (7, c, "en", "a", 4), (7, c, "en", "a", 4), (9, c, "en", "b", 5)]
    table = spark.createDataFrame(docs[::-1] if swap else docs, COLUMNS).coalesce(1)
    assert rows(pipeline.near_dedup(spark, table, sf[0])) == sorted([docs[0], docs[1], docs[3]], key=str)


def test_a_short_item_counts_only_as_a_share(spark, sf, tmp_path):
    rng = random.Random(13)
    spark.createDataFrame([(1, "the"), (2, "so it goes")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, f"{prose(rng, 100)} so it goes the", "en", "a", 1), (2, f"{prose(rng, 40)} so it goes", "en", "a", 2), (3, prose(rng, 50), "en", "a", 3)]
    kept = pipeline.decontamination(spark, spark.createDataFrame(docs, COLUMNS), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == [i for i, t, *_ in docs if not plain_hits(t, [(1, "the"), (2, "so it goes")])[3]]


def test_rows_with_nulls_in_other_places_and_clashing_names(spark, sf):
    """Rows that differ only in which column is null are two; extra columns of any name and type come back."""
    rng = random.Random(14)
    text = prose(rng, 90)
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_key string, copies array<int>, copy map<string, int>, Row_Key_ struct<a: int>, `a.b` binary"
    none = (None, None, None, None, None)
    docs = [(1, text, "x", None, 1, *none), (1, text, None, "x", 1, *none), (2, prose(rng, 90), "en", "a", 2, "k", [1, None], {"a": 1}, (None,), b"\xff"), (2, None, None, None, None, *none), (3, "", None, None, None, *none)]
    docs += [docs[2], docs[3], (4, prose(rng, 40_000), "en", "a", 9, *none)]
    table = spark.createDataFrame(docs, schema)
    same = lambda df: sorted(map(str, df.collect()))
    every = {str(r) for r in table.collect()}
    for stage in (pipeline.decontamination, pipeline.mixing, pipeline.near_dedup):
        out = stage(spark, table, sf[0])
        assert out.schema == table.schema and set(same(out)) <= every
    assert same(pipeline.decontamination(spark, table, sf[0])) == same(table)
    assert len(same(pipeline.near_dedup(spark, table, sf[0]))) == 4
    assert len(set(same(table.withColumn("k", pipeline._digest(table)).select("k").distinct()))) == 6
    assert not pipeline.quality_rules(spark, table.where("text is null or text = ''"), sf[0]).collect()
