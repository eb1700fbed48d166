"""Archives that read back, digests, revisits and damaged files."""

import base64
import gzip
import hashlib
import os
import random

import pytest

from gridloom.llm import warc


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain(rows):
    data = [(p, (h or "").encode()) for p, _, h in rows]
    top = {}
    for p, b in data:
        top[b] = max(top.get(b, -1), -1 if p is None else p)
    out = []
    for p, b in data:
        first = top[b] == (-1 if p is None else p)
        out.append((p, len(b), sha(b), "response" if first else "revisit", None if first or top[b] == -1 else top[b]))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], "page_id long, url string, html string, record string, digest string, data string").repartition(3)


def run(spark, tmp_path, rows, **kw):
    df = frame(spark, rows)
    manifest = warc.write_warc(df, str(tmp_path / "w"), **kw)
    return sorted(map(tuple, warc.read_warc(manifest).collect()), key=str), manifest


def made():
    rng = random.Random(1)
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(300_000))
    rows = [(i, f"http://h/{i}", f"page {i % 7}") for i in range(40)]
    return [*rows, (100, None, None), (101, "u\r\nx: y", ""), (102, "u", noise), (103, "u", noise), (104, "u", noise + "!"), (5, "http://again", "page 5"), (105, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (106, "u", "x" * 65536), (None, "u", "only"), (None, "u", "page 3")]


def test_round_trip(spark, tmp_path):
    got, manifest = run(spark, tmp_path, made(), rows_per_file=10)
    assert got == plain(made())
    assert sum(r.n for r in manifest.collect()) == len(made())


def test_small_chunks_carry_the_digest(spark, tmp_path):
    rows = [(1, "u", "abcdefghij"), (2, "u", ""), (3, "u", "abc")]
    df = frame(spark, rows)
    chunks = warc.chunk_table(df, chunk=3)
    one = chunks.where("page_id = 1").orderBy("chunk_no").collect()
    assert [(r.chunk_no, r.n_bytes, r.last) for r in one] == [(0, 3, False), (1, 6, False), (2, 9, False), (3, 10, True)]
    assert [r.digest for r in one] == [sha(b"abc"), sha(b"abcdef"), sha(b"abcdefghi"), sha(b"abcdefghij")]
    assert chunks.where("page_id = 2").count() == 1
    assert run(spark, tmp_path, rows, chunk=3)[0] == plain(rows)


def test_repeated_rows_are_records(spark, tmp_path):
    rows = [(1, "u", "same")] * 3 + [(2, "u", "same")]
    got, _ = run(spark, tmp_path, rows)
    assert got == plain(rows) and len(got) == 4
    rows = [(2, "u", "same")] * 2
    assert {r[3] for r in run(spark, tmp_path / "b", rows)[0]} == {"response"}


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, [])[0] == []


def test_files_are_gzip_members_with_standard_fields(spark, tmp_path):
    _, manifest = run(spark, tmp_path, [(1, "http://a/", "hello"), (2, "http://b/", "hello")])
    text = b"".join(gzip.open(r.path).read() for r in manifest.collect()).decode()
    assert text.count("WARC/1.1\r\n") == 2 and "WARC-Type: revisit" in text and "WARC-Refers-To: <urn:page:2>" in text
    assert text.count("\r\nhello") == 1


def test_damage_is_noticed(spark, tmp_path):
    _, manifest = run(spark, tmp_path, [(1, "u", "hello world" * 50)])
    path = manifest.first().path
    raw = gzip.open(path).read()
    with open(path, "wb") as f:
        f.write(gzip.compress(raw.replace(b"hello", b"hallo")))
    crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
    assert not os.path.exists(crc)
    with pytest.raises(Exception, match="damaged"):
        warc.read_warc(manifest).collect()
    with open(path, "wb") as f:
        f.write(gzip.compress(raw)[:-20])
    with pytest.raises(Exception, match=r"cut short|Error"):
        warc.read_warc(manifest).collect()


@pytest.mark.parametrize("piece", [1, 7, 100, 1 << 16])
def test_reader_takes_any_piece_size(tmp_path, piece):
    w = warc.WarcWriter(str(tmp_path))
    bodies = [b"", b"x", b"\r\n\r\n" * 5, bytes(range(256)) * 9]
    for i, b in enumerate(bodies):
        w.start(i, "u", len(b), sha(b), False, None)
        w.feed(b)
    path, n = w.close()
    got = [(size, digest) for _, _, size, digest in warc.read_records(path, piece)]
    assert n == 4 and got == [(len(b), sha(b)) for b in bodies]


def test_query_equals_plain(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = warc.query(spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)
