import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, t long, id long, spans string, `a.b` string"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """Texts with exact and near copies, shared passages, repeated lines, odd ones."""
    rng = random.Random(5)
    base = [" ".join(words(rng, rng.randrange(5, 160), 4000)) for _ in range(30)]
    passage = " ".join(words(rng, 70, 4000))
    lines = "\n".join(" ".join(words(rng, 12, 4000)) for _ in range(6))
    out = [*base, *base[:3], base[4] + " tail", " ".join(base[5].split()[:-1]), base[6] + "\n" + passage, passage + " " + base[7], lines, lines + "\nnew line of six words here", "head\n" + lines]
    edited = passage.split()
    edited[35] = "changed"
    out.append(base[8] + " " + " ".join(edited) + " " + base[9])
    out.append(" ".join(["the"] * 300))
    out.append("déjà vu ÄÖÜ 日本語 🙂 " * 40)
    out.append("A <|endoftext|> B<|endoftext|>")
    out += ["", None, " \n\t ", "x", "a\nb\na\nb\na", "one two three four five\none two three four five"]
    out.append(" ".join(words(rng, 6000, 3000)))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t) if t else 0, 1.5, 7, 1, 2, "z", "d") for i, t in enumerate(texts)]
    rows += [rows[2], (None, "no id here", None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
