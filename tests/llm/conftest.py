from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _key string, item string"


def make_texts() -> list[str | None]:
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ner", "Su", "té") for b in ("ra", "d", "vin", "os", "ß", "q7")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = say(60)
    texts: list[str | None] = [None, "", " \n\t ", "one", "one two", "ONE  two", "a b c", "a\tb c ", say(3000)]
    base = say(120)
    texts += [base, base, base.upper(), base.replace(" ", "  ", 3)]
    for _ in range(6):
        near = base.split()
        near[rng.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    texts += [say(40) + passage + say(40), say(30) + " " + passage, passage + passage, "ab" * 300, "é" * 150]
    texts += [f"password = 'Abcdef123456' and AKIA{'Q7' * 8} {'0a' * 20} {say(5)}", "token:short API_KEY=\"zzzzzzzz\" é𝒳 secret: x.y/z=+_-"]
    return texts + [say(rng.randrange(1, 90)) for _ in range(20)]


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Awkward texts, with extra columns whose names the operators use themselves."""
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
