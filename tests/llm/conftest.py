"""Documents with planted cases, odd rows and clashing columns."""

from __future__ import annotations

import random

import pytest

SYLLABLES = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "ñó", "ß"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, key string, copies int, label string, row string, `text.x` string"


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    out = []
    for i, w in enumerate(words):
        out.append(w + ("." if i % 11 == 10 else ",") if i % 5 == 4 else w)
    return " ".join(out)


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(7)
    base = [prose(rng, rng.randint(20, 150)) for _ in range(40)]
    passage = prose(rng, 70)
    rows: list[tuple[int | None, str | None]] = list(enumerate(base))
    near = base[3].split()
    near[len(near) // 2] = "changed"
    rows += [(40, base[0]), (41, base[0]), (42, " ".join(near)), (43, base[5] + " " + passage), (44, passage + "\n" + base[6]), (45, passage.upper())]
    rows += [(46, ""), (47, None), (48, "   \n\t "), (49, "one"), (50, "one two"), (51, "la " * 300), (52, "x la " + "la " * 200)]
    rows += [(53, base[7]), (53, base[7]), (54, base[8]), (54, base[9]), (None, base[1]), (None, None), (None, "lone text without an id")]
    rows += [(55, prose(rng, 20000)), (60, base[2] + "\0" + base[4]), (-3, base[10]), (80, "Ünï \u2028 \x1c\x85\xa0 <|endoftext|> é́ 漢字 \U0001f600 a.b. 'S")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    rng = random.Random(3)
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["hot", "hot", "cold", None]), None if t is None else len(t), 1, 0.5, "k", 9, "l", "r", "t") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
