from __future__ import annotations

import random
import re

import pytest

LONG = " ".join(f"w{k % 977}" for k in range(60_000))


def words(text):
    """Runs of non-blanks, A-Z folded."""
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, lang, source): prose, copies, near copies, shared lines, and every awkward kind of text."""
    chance = random.Random(5)
    vocabulary = ["the", "of", "and", "Über", "niño", "été", "x1", *("".join(chance.choice("abcdeéñ") for _ in range(chance.randint(2, 8))) for _ in range(300))]
    line = lambda n: " ".join(chance.choice(vocabulary) for _ in range(n)).capitalize() + "."
    shared = [line(12) for _ in range(4)]
    texts = []
    for k in range(60):
        parts = [line(chance.randint(3, 25)) for _ in range(chance.randint(1, 6))]
        if k % 3 == 0:
            parts.insert(chance.randint(0, len(parts)), chance.choice(shared))
        texts.append("\n".join(parts))
    for k in range(0, 20, 2):
        texts.append(texts[k])
        near = texts[k].split(" ")
        near[chance.randrange(len(near))] = "changed"
        texts.append("  ".join(near))
    texts += ["", None, " \t\n ", "one", "One  TWO three four", "\n\n", "a\nb\na\n", LONG, "word " * 300, "日本語 のテキスト です", "🙂 " * 10]
    rows = [(k, text, ("en", "de", None)[k % 3], f"s{k % 4}" if k % 7 else None) for k, text in enumerate(texts)]
    return [*rows, rows[0], rows[1], (None, texts[2], "en", "s0"), (None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
