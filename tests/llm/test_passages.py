"""Near-duplicate passages against looking at all stretches of all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest

from inkgrid.llm import substring_dedup

from .test_text_operators import by_id, covered

WORDS, SHINGLE, WIDTH, LEAST = 12, 2, 11, 0.8


def shingles(text):
    w = text.lower().split()
    return [tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)]


def brute_marks(texts):
    """Words in stretches of ``WIDTH`` or more shingles, up to its reach, that have a near
    stretch in another text; longer ones begin and end in shingles that both texts have."""
    all_of = [shingles(t) for t in texts]
    reach = int(substring_dedup.REACH * WIDTH)
    out = []
    for i, x in enumerate(all_of):
        mine = set()
        for j, y in enumerate(all_of):
            if i == j or not set(x) & set(y):
                continue
            spans = [(a, b) for a in range(len(x)) for b in range(a + WIDTH, min(len(x), a + 2 * reach - 1) + 1) if len(set(x[a:b]) & set(y)) >= LEAST * (b - a)]
            others = [(set(y[a:b]), b - a) for a in range(len(y)) for b in range(a + WIDTH, min(len(y), a + 2 * reach - 1) + 1) if len(set(y[a:b]) & set(x)) >= LEAST * (b - a)]
            every = set(y)
            for a, b in spans:
                if b - a > WIDTH and not (x[a] in every and x[b - 1] in every):
                    continue
                own = set(x[a:b])
                for other, n in others:
                    m = len(own & other)
                    if m >= LEAST * (b - a + n - m) - 1e-9:
                        mine |= set(range(a, b + SHINGLE - 1))
                        break
        out.append(mine)
    return out


@pytest.fixture(scope="module")
def made():
    rng = random.Random(21)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for k in range(14):
        passage = say(rng.randrange(14, 26))
        for _ in range(2 + k % 3):
            copy = list(passage)
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], say(1), [copy[at], *say(1)]])
            texts.append(" ".join([*say(rng.randrange(25)), *copy, *say(rng.randrange(25))]))
    return texts + [" ".join(say(40)) for _ in range(6)]


def test_marks_against_all_stretches(spark, made):
    want = brute_marks(made)
    d = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = by_id(substring_dedup.passages(d, words=WORDS, shingle=SHINGLE), "spans")
    marks = [covered(got[i]) for i in range(len(made))]
    assert all(m <= w for m, w in zip(marks, want, strict=True))  # no word without a near stretch
    assert not any(marks[-6:])
    recall = sum(map(len, marks)) / sum(map(len, want))
    assert recall >= 0.9, recall


def test_large_groups_are_dealt_differently_with_equal_results(spark, made):
    rng = random.Random(22)
    passage = [f"p{k}" for k in range(16)]
    more = [" ".join([*(f"a{rng.randrange(10**6)}" for _ in range(12)), *passage[: 16 - k % 3], *(f"b{rng.randrange(10**6)}" for _ in range(12))]) for k in range(40)]
    texts = [*made, *more, more[0] + " tail", more[3], "the " * 60, "the " * 45 + "end", "a b " * 30, "x a b a b a b a b a b a b a b a b"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [by_id(substring_dedup.passages(d, words=WORDS, shingle=SHINGLE, group=g), "spans") for g in (1 << 14, 10, 3)]
    assert found[0] == found[1] == found[2]
    assert all(set(range(12, 26)) <= covered(found[0][len(made) + k]) for k in range(40))


def test_exact_passages_of_periodic_texts_are_found(spark):
    rng = np.random.default_rng(23)
    texts = []
    for _ in range(60):
        words = []
        for _ in range(rng.integers(1, 5)):
            unit = rng.choice(list("abcd"), rng.integers(1, 4)).tolist()
            words += unit * int(rng.integers(1, 14))
        texts.append(" ".join(words))
    owners = defaultdict(set)
    rows = [t.split() for t in texts]
    for i, w in enumerate(rows):
        for k in range(len(w) - WORDS + 1):
            owners[tuple(w[k : k + WORDS])].add(texts[i])
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(substring_dedup.passages(d, words=WORDS, shingle=SHINGLE), "spans")
    missed = total = 0
    for i, w in enumerate(rows):
        want = {k + j for k in range(len(w) - WORDS + 1) if len(owners[tuple(w[k : k + WORDS])]) > 1 or texts.count(texts[i]) > 1 for j in range(WORDS)}
        total += len(want)
        missed += len(want - covered(got[i]))
    assert total > 500 and missed == 0, (missed, total)


def test_crowds_are_compared_by_classes_with_equal_results(monkeypatch):
    rng = random.Random(24)
    reach = int(substring_dedup.REACH * WIDTH)
    say = lambda n, kinds: [rng.randrange(1, kinds) | 1 for _ in range(n)]
    groups = []
    for k in range(12):
        base = say(2 * reach - 1, 1 << 30)
        base[reach - 1] = 7
        around, members = {}, []
        for t in range(90):
            left, right = base[: reach - 1], base[reach:]
            for half in (left, right):
                for _ in range(rng.randrange(3 + k % 2)):
                    at = rng.randrange(len(half))
                    half[at : at + rng.randrange(3)] = say(rng.randrange(4), (1 << 30, 60)[k % 3 == 0])
            m, n = (rng.choice((reach - 1, reach - 1, rng.randrange(reach))) for _ in range(2))
            left, right = left[-m:] if m else [], right[:n]
            row = np.array([*left, 7, *right][:reach - 1 + len(left)], np.uint32)
            around.setdefault((min(len(left), reach - 1), row.tobytes()), (t // 2 if k % 4 == 1 else t, [t], t % 17 == 0))
        members = list(around.values())
        groups.append((list(around), members))
    found, spans = [], substring_dedup._Crowd.spans
    judged = []

    def counted(self, rare):
        judged.append(rare)
        return spans(self, rare)

    monkeypatch.setattr(substring_dedup._Crowd, "spans", counted)
    for rare in (None, 0, 1, 2, 8, 64):
        monkeypatch.setattr(substring_dedup._Crowd, "plan", lambda self, rare=rare: rare)
        held = substring_dedup._Batch(WIDTH, reach, LEAST)
        for rows, members in groups:
            held.add(list(rows), list(members))
        found.append([x.tolist() for x in held.compare()])
    assert all(f == found[0] for f in found[1:])
    assert len(judged) == 5 * len(groups) and sum(b >= 0 for b in found[0][1]) > 200


def test_work_of_a_crowd_grows_with_its_size_not_its_square(monkeypatch):
    """Near copies of one passage: pairs that are looked at, for each window."""
    near, pairs = substring_dedup.near, []

    def counted(at, *args):
        pairs.append(len(at))
        return near(at, *args)

    monkeypatch.setattr(substring_dedup, "near", counted)
    reach, rates = 69, []
    for n in (200, 1600):
        rng = random.Random(25)
        base = [rng.randrange(1, 1 << 30) | 1 for _ in range(2 * reach - 1)]
        held, pairs[:] = substring_dedup._Batch(46, reach, 0.8), []
        rows = []
        for _ in range(n):
            row = list(base)
            for _ in range(rng.randrange(1, 5)):
                at = rng.choice([x for x in range(2 * reach - 6) if not x <= reach - 1 < x + 5])
                row[at : at + 5] = [rng.randrange(1, 1 << 30) | 1 for _ in range(5)]
            rows.append((reach - 1, np.array(row, np.uint32).tobytes()))
        held.add(rows, [(t, [t], False) for t in range(n)])
        held.compare()
        rates.append(sum(pairs) / n)
    assert max(rates) < 20, rates  # in place of a part of all others
