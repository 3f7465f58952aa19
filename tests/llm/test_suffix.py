"""Suffix dedup on periodic and hot texts, and its sorting steps."""

import numpy as np
import pytest

from inkgrid.llm import suffix_dedup

from .test_text_operators import brute_bytes, by_id


def test_quicksort_orders_rows():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 500):
        letters = rng.integers(0, 4, (n, 3)).astype(np.uint64)
        group = rng.integers(0, 5, n)
        order, segment = suffix_dedup.multikey_quicksort(letters, group)
        rows = [(int(group[i]), *letters[i].tolist()) for i in range(n)]
        assert [rows[i] for i in order] == sorted(rows)
        assert all(segment[k] == next(j for j in range(n) if rows[order[j]] == rows[order[k]]) for k in range(n))


def test_thinning_drops_what_lies_inside_periodic_stretches():
    text = [b"x" * 90 + b"abc" * 400 + b"y" * 90]
    which, at, h = suffix_dedup.anchors(text, 60, 16)
    keep = suffix_dedup.thinned(text, which, at, h, 60, 16)
    assert keep.sum() < 30 < len(at)


@pytest.mark.parametrize("hot", [1000, 2])
def test_periodic_texts(spark, hot):
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(90):
        parts = []
        for _ in range(rng.integers(1, 6)):
            unit = "".join(rng.choice(list("abc"), rng.integers(1, 9)))
            parts.append(unit * int(rng.integers(1, 9)) if rng.random() < 0.7 else "".join(rng.choice(list("abcdef"), rng.integers(0, 30))))
        texts.append("".join(parts))
    texts += ["ab" * 60, "z" + "ab" * 40 + "q", "abab" * 3, "abc" * 50 + "x" + "abc" * 50, "abc" * 50 + "x" + "abc" * 50]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(suffix_dedup.dedup(d, length=20, gram=6, hot=hot), "n_removed")
    for i, g in enumerate(brute_bytes([t.encode() for t in texts], 20)):
        assert got[i] == int(g.sum()), (i, texts[i])


def test_hot_passage_among_different_texts(spark):
    rng = np.random.default_rng(5)
    say = lambda n: "".join(rng.choice(list("abcdefghijklmnop "), n))
    passage = say(150)
    texts = [say(int(rng.integers(0, 80))) + passage + say(int(rng.integers(0, 80))) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [int(g.sum()) for g in brute_bytes([t.encode() for t in texts], 40)]
    for hot in (1000, 7):
        got = by_id(suffix_dedup.dedup(d, length=40, gram=12, hot=hot), "n_removed")
        assert [got[i] for i in range(60)] == want
