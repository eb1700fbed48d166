"""Base counts against a plain count, and verdicts on prose and junk."""

import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import prose
from gridloom.llm import quality

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), lines, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def base(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_edge_cases(spark, edge_docs, edge_rows, no_docs):
    got = sorted(quality.assess(edge_docs, VOCABULARY).collect(), key=lambda r: (r.doc_id or -1, r.n_words))
    want = sorted(((r[0], *plain(r[1])) for r in edge_rows), key=lambda r: (r[0] or -1, r[1]))
    assert [(r.doc_id, *base(r)) for r in got] == want
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.assess(no_docs, VOCABULARY).count() == 0


@settings(max_examples=80, deadline=None)
@given(words=st.lists(st.sampled_from("a b c d \n e\n| #x  ".split(" ")), max_size=120))
def test_counts(words):
    text = " ".join(words)
    model = quality._MODELS.setdefault(VOCABULARY, quality.Fertility(VOCABULARY))
    got = quality.judge_text(text, "en", model, quality.BANDS)
    assert (*got[:5], got[9]) == plain(text)


def test_repeats_in_very_long_texts_use_pairs(monkeypatch):
    words = ["a", "b", "c", "d"] * 3 + ["e"]
    want = quality.repeated_words(words)
    assert want == 12 and quality.repeated_words(["x"] * 2_000_001) == 2_000_001


def test_verdicts(spark):
    rng = random.Random(2)
    good = prose(rng, 300)
    junk = " ".join(w + rng.choice(("###", "$$$", "%%%")) for w in prose(rng, 300).split())
    bars = " | ".join(prose(rng, 150).split())
    rows = [(1, good, "en"), (2, junk, "en"), (3, bars, "en"), (4, good, None), (5, good, "unknown"), (6, "漢字かな交じり文 " * 20 + prose(rng, 60), None)]
    got = {r.doc_id: r.kept for r in quality.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string"), VOCABULARY).collect()}
    assert got[1] and not got[2] and not got[3] and got[4] and got[5]


def test_keep_returns_whole_rows(spark, edge_docs):
    kept = quality.keep(edge_docs, VOCABULARY)
    assert kept.columns == edge_docs.columns
    flags = sorted(r.doc_id or -1 for r in quality.assess(edge_docs, VOCABULARY).where("kept").collect())
    assert sorted(r.doc_id or -1 for r in kept.collect()) == flags


def test_measures_are_those_of_the_vocabulary():
    import numpy as np
    import sentencepiece

    model, sp = quality.Fertility(VOCABULARY), sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    words = "the quick brown Straße \U0001f984 fox the".split()
    ids = [i for w in words for i in sp.encode(w)]
    chars, fertility, share, entropy = model.measure([w.encode() for w in words], sum(map(len, words)))
    n = np.array(list(Counter(ids).values()))
    assert (chars, fertility) == (sum(map(len, words)) / len(ids), len(ids) / len(words))
    assert share == pytest.approx(sum(map(sp.is_byte, ids)) / len(ids)) and share > 0
    assert entropy == pytest.approx(-(n / len(ids) * np.log2(n / len(ids))).sum())


def test_scripts():
    assert [quality.script_of(x) for x in ("abc é", "жук и", "λόγος", "漢字", "")] == ["Latin", "Cyrillic", "Greek", "other", "Latin"]


def test_query_equals_a_plain_count(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = quality.query(spark, sf).collect()
    assert {(r.doc_id, *base(r)) for r in got} == {(i, *plain(t)) for i, t in texts.items()} and len(got) == len(texts)


@pytest.mark.parametrize("lang", [None, "", "xx", "pl"])
def test_random_latin_letters_are_rejected_whatever_the_lang(lang):
    rng, model = random.Random(4), quality.Fertility(VOCABULARY)
    for n in (60, 200, 1000):
        text = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 10))) for _ in range(n))
        assert not quality.judge_text(text, lang, model, quality.BANDS)[-1]
        assert quality.judge_text(prose(rng, n), lang, model, quality.BANDS)[-1]


def test_labelled_rows_are_told_apart_without_their_lang(spark):
    sf, model = "/root/testdata/sf0.01", quality.Fertility(VOCABULARY)
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("text", "quality").collect()
    got = Counter()
    for r in rows:
        *_, failed, kept = quality.judge_text(r.text, None, model, quality.BANDS)
        got[r.quality, kept] += not failed
    assert got[1, False] <= 0.01 * (got[1, True] + got[1, False])
    assert got[0, True] <= 0.05 * (got[0, True] + got[0, False]) and got[0, False] > 20


@pytest.mark.parametrize("lang", ["en", "de", "fr", "es", None, "xx"])
@pytest.mark.parametrize("mark", ["###", "#", "$", "=", "!!!", "xyz"])
def test_the_same_mark_on_every_word_is_rejected(lang, mark):
    rng, model = random.Random(6), quality.Fertility(VOCABULARY)
    for n in (60, 200, 1000):
        text = prose(rng, n)
        assert quality.judge_text(text, lang, model, quality.BANDS)[-1]
        assert not quality.judge_text(" ".join(w + mark for w in text.split()), lang, model, quality.BANDS)[-1]


@pytest.mark.parametrize("letters", ["\u0430\u0431\u0432\u0433\u0434\u0435\u0436\u0437\u0438\u043a\u043b\u043c\u043d\u043e\u043f\u0440\u0441\u0442", "\u03b1\u03b2\u03b3\u03b4\u03b5\u03b6\u03b7\u03b8\u03b9\u03ba\u03bb\u03bc\u03bd\u03bf\u03c0\u03c1\u03c3\u03c4"])
def test_marked_words_of_other_alphabets_are_rejected(letters):
    rng, model = random.Random(7), quality.Fertility(VOCABULARY)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(200)]
    assert quality.judge_text(" ".join(words), None, model, quality.BANDS)[-1]
    assert not quality.judge_text(" ".join(w + "###" for w in words), None, model, quality.BANDS)[-1]


def test_word_by_word_ids_are_those_of_the_whole_text():
    import sentencepiece

    model, sp = quality.Fertility(VOCABULARY), sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    rng = random.Random(3)
    for text in (prose(rng, 300), "The quick, brown fox: 3.14 (and) Straße d'été — ñandú!", "жук λόγος naïve co-op 12ab"):
        assert model.ids([w.encode() for w in text.split()]).tolist() == sp.encode(" ".join(text.split()))


def test_kept_by_a_plain_computation_of_measures_and_bands(spark):
    """Every document of the smallest tables: measures from whole texts by the library, limits one by one."""
    import math

    import sentencepiece

    sf, sp = "/root/testdata/sf0.001", sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    got = {r.doc_id: r.kept for r in quality.query(spark, sf).collect()}
    seen = Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        want = not plain(r.text)[-1]
        if want:
            ids = [i for w in words for i in sp.encode(w)]
            n, count = len(ids), Counter(ids)
            letters = [c for c in r.text if c.isalpha()]
            script = "Latin" if all(ord(c) < 0x250 for c in letters) else quality.script_of(r.text)
            b = quality.BANDS[r.lang if r.lang in quality.BANDS else script]
            chars = sum(map(len, words)) / n
            entropy = -sum(k / n * math.log2(k / n) for k in count.values())
            common = max((k for i, k in count.items() if not sp.is_byte(i) and sp.id_to_piece(i) != "▁"), default=0) / len(words)
            x = math.log2(max(n, 2))
            usual = b.curve[0] + b.curve[1] * x + b.curve[2] * x * x
            bad = [chars < b.least_chars, n / len(words) > b.most_fertility, sum(k for i, k in count.items() if sp.is_byte(i)) / n > b.most_bytes, common > b.most_common, chars < b.soft_chars and entropy < usual - b.deficit]
            want = not any(bad)
        assert got[r.doc_id] == want
        seen[want] += 1
    assert len(got) == sum(seen.values()) and seen[True] > 100 and seen[False] > 20


def test_a_band_fitted_to_half_of_the_labelled_texts_tells_the_other_half_apart(spark):
    import numpy as np

    sf, model = "/root/testdata/sf0.1", quality.Fertility(VOCABULARY)
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("doc_id % 2 = 0").select("doc_id", "text", "quality").collect()
    measured = []
    for r in rows:
        n, _, _, _, _, *m, failed, _ = quality.judge_text(r.text, "en", model, quality.BANDS)
        if not failed:
            common = model.measure_all(r.text.encode().split(), 1)[4]
            measured.append((r.doc_id % 4 == 0, r.quality, (*m, common, round(m[1] * n))))
    part = lambda half, good: np.array([x for h, q, x in measured if h == half and q == good]).reshape(-1, 6)
    band = quality.fit_band(quality.Sample(part(True, 1), part(True, 0)))
    inside = lambda r: quality.within(band, *r[:4], common=r[4], n_tokens=r[5])
    good, bad = part(False, 1), part(False, 0)
    assert len(good) > 200 and len(bad) > 15
    assert sum(map(inside, good)) >= 0.98 * len(good) and sum(map(inside, bad)) <= 0.1 * len(bad)
    assert quality.fit_band(quality.Sample(part(True, 1), part(True, 0)[:0])).soft_chars == 0
