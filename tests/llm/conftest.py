import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

CLASHING = ("fp", "rep", "key", "u", "v", "rid", "words", "size", "base", "copies", "shard", "start", "component_id", "hash", "kept", "score", "target", "lane", "gram")


def prose(rng: random.Random, n: int) -> str:
    parts = ("an", "re", "ti", "the", "lo", "mi", "sta", "ver", "qu", "ed", "ing", "or")
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Documents with nulls in any column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(11)
    one, two = prose(rng, 120), prose(rng, 80)
    near = one.split()
    near[60] = "changed"
    return [
        (1, one, "en", "a"),
        (2, " ".join(near), "en", "a"),
        (3, one, "en", "b"),
        (4, None, "en", "a"),
        (5, "", "de", None),
        (6, " \n\t ", None, "b"),
        (7, two, "fr", None),
        (7, two, "fr", None),
        (8, two.upper(), "es", "c"),
        (None, prose(rng, 60), "en", "a"),
        (9, prose(rng, 30_000), "en", "c"),
        (10, "one two", "en", "c"),
        (11, "É\u00a0ü\u2003x \U0001f600 ß\x1c\x85 " * 30, "xx", "c"),
        (12, "x" * 200_000, None, None),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The same as a table, with extra columns of names that operators use inside."""
    extra = ", ".join(f"{c} string" for c in CLASHING)
    rows = [(*r, None if r[1] is None else len(r[1]), *("?" for _ in CLASHING)) for r in edge_rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
