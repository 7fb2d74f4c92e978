import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """A maker of deterministic sentences."""

    def make(seed: int, words: int, vocabulary: int = 4000) -> str:
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(vocabulary):x}" + ("." if rng.random() < 0.1 else "") for _ in range(words))

    return make


ODD = [None, "", " \n\t ", "one", "a b c d", "a b c d e", "é" * 300, "x" * 5000, "-" * 700, "same line\n" * 40, "\U0001f600 中文 ﬁ ǅ", "<|endoftext|> it's"]


@pytest.fixture(scope="session")
def docs(spark, prose):
    """Odd texts, near and exact copies, shared passages, null and repeated keys, a column of a clashing name."""
    base = prose(1, 300)
    words = base.split()
    texts = list(ODD) + [base, base, base]
    for i in range(12):
        near = list(words)
        for j in range(1 + i % 3):
            near[(37 * i + 101 * j) % len(near)] = f"edit{i}"
        texts.append(" ".join(near))
    passage = prose(2, 80)
    texts += [f"{prose(10 + i, 60)} {passage} {prose(40 + i, 60)}" for i in range(10)]
    texts += [prose(100 + i, 120) for i in range(40)]
    texts += [" ".join(f"{w}###" for w in prose(200 + i, 90).split()) for i in range(4)]
    texts.append(prose(300, 60000))
    rows = [(i, t, "en" if i % 4 else "de", f"s{i % 3}" if i % 11 else None, len(t or ""), "clash") for i, t in enumerate(texts)]
    rows += [(None, "no key here " * 6, None, None, 72, None), (0, rows[15][1], "en", "s0", 1, "twice"), (0, rows[15][1], "en", "s0", 1, "twice")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rid string").repartition(5)


@pytest.fixture(scope="session")
def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
