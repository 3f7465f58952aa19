"""The queries' own columns against brute force on the smallest tables, and near copies."""

import hashlib
import random
import zlib
from collections import defaultdict

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from inkgrid.llm import queries, simhash

from .test_text_operators import brute_bytes, brute_components, brute_fingerprint, brute_spans

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tiny():
    t = pq.read_table(f"{TINY}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"], strict=True))


def found(spark, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, TINY).collect()}


def sha(raw):
    return hashlib.sha256(raw if isinstance(raw, bytes) else raw.encode()).hexdigest()


def test_op1(spark, tiny):
    texts = tiny
    got = found(spark, "op1_toxicity")
    for i in texts:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == int(got[i]["score"] >= 0.3)


def test_op2(spark, tiny):
    texts = tiny
    got = found(spark, "op2_sharding")
    size, slots = defaultdict(int), defaultdict(list)
    for i, t in texts.items():
        raw = (t or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["law"], got[i]["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        size[got[i]["shard"]] += got[i]["size"]
        slots[got[i]["shard"]].append(got[i]["slot"])
    assert set(size) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - sum(size.values()) / 40 <= max(r["size"] for r in got.values())


def test_op3(spark, tiny):
    texts = tiny
    known, got = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), found(spark, "op3_bpe")
    for i, t in texts.items():
        ids = known.encode(t or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert got[i]["decoded_sha256"] == sha(known.decode(ids, skip_special_tokens=False))


def test_op5(spark, tiny):
    texts = tiny
    got, fps = found(spark, "op5_simhash"), {i: brute_fingerprint(t) for i, t in texts.items()}
    roots = brute_components(fps)
    assert all((got[i]["fingerprint"], got[i]["component_id"]) == (f"{fps[i]:016x}", roots[i]) for i in texts)


def test_op8(spark, tiny):
    texts = tiny
    got, order = found(spark, "op8_suffix_dedup"), sorted(texts)
    for i, gone in zip(order, brute_bytes([(texts[k] or "").encode() for k in order], 200), strict=True):
        raw = (texts[i] or "").encode()
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(bool(g) and not (k and gone[k - 1]) for k, g in enumerate(gone))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(raw), int(gone.sum()), runs, sha(kept))


def test_op9(spark, tiny):
    texts = tiny
    got = found(spark, "op9_pii")
    for i, t in texts.items():
        base = brute_spans(t or "")
        digest = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i]["base_sha256"] == sha(digest) and got[i]["spans"].startswith(digest)
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[0] == k for x in base) for k in ("email", "ip", "card", "phone")]
        assert got[i]["n_found"] == len(base) + got[i]["n_term"]


def test_op10(spark, tiny):
    texts = tiny
    got = found(spark, "op10_substring_dedup")
    for i, t in texts.items():
        spans = [tuple(map(int, s.split(":"))) for s in got[i]["spans"].split(",") if s]
        assert got[i]["n_words"] == len((t or "").encode().lower().split())
        assert (got[i]["n_dup"], got[i]["n_passages"], got[i]["duplicated"]) == (sum(b - a for a, b in spans), len(spans), bool(spans))
        assert all(b - a >= 50 for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


# --- near copies by similarity


def jaccard(a, b):
    x, y = ({tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies(spark):
    rng = random.Random(31)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows, pairs = [], []
    for _ in range(150):
        base = say(rng.randrange(60, 400))
        copy = list(base)
        for _ in range(max(1, len(base) // rng.choice([60, 100, 200]))):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        pairs.append((len(rows), len(rows) + 1, jaccard(" ".join(base), " ".join(copy))))
        rows += [" ".join(base), " ".join(copy)]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.without_near_copies(d).collect()}
    near = [b not in kept for _, b, j in pairs if j >= 0.82]
    far = [b in kept for _, b, j in pairs if j < 0.7]
    assert all(a in kept for a, _, _ in pairs) and len(near) > 60
    assert sum(near) >= 0.9 * len(near) and all(far)


def test_near_copies_of_odd_rows(spark, docs, none):
    kept = simhash.without_near_copies(docs)
    assert kept.columns == docs.columns
    got = [r["doc_id"] for r in kept.collect()]
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    empty = sorted(i for i, t in rows if i is not None and not t.split())
    assert [i for i in got if i in empty] == empty[:1] and None in got
    assert len(set(got)) == len(got) and got.count(2) == 1
    by_text = defaultdict(list)
    for i, t in rows:
        if i is not None:
            by_text[t].append(i)
    assert all(len(set(ids) & set(got)) <= 1 for ids in by_text.values())
    assert simhash.without_near_copies(none).count() == 0


def test_near_copies_in_one_large_group(spark):
    rng = random.Random(32)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    rows = []
    for i in range(400):
        copy = list(base)
        copy[rng.randrange(200)] = f"e{i}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(f"o{rng.randrange(9**9)}" for _ in range(80))) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.without_near_copies(d).collect()) == [0, *range(1000, 1020)]


def test_near_copies_against_brute_force(spark):
    """Pairs at the threshold and a little above: whoever is as similar goes, others stay."""
    rng = random.Random(33)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    common, rows = say(40), []
    for k in range(160):
        base = say(rng.randrange(60, 200)) + (common if k % 3 == 0 else [])
        copy = list(base)
        shingles = len(base) - 4
        for i in rng.sample(range(0, len(base), 9), rng.choice([1, 2, 3, 4])):
            copy[i] = f"e{rng.randrange(10**6)}"
        if k % 2:  # one run of new words, just as long as may be, or one longer
            cut = int(shingles * 0.2 / 1.8) - 4 + k // 2 % 2
            copy = list(base)
            copy[10 : 10 + cut] = [f"e{rng.randrange(10**6)}" for _ in range(cut)]
        rows += [" ".join(base), " ".join(copy)]
    rows += ["a b c", "A  b\nc", "a b d", " ".join(common), "", " "]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in (t.lower().split() for t in rows)]
    near = [(i, j) for j in range(len(rows)) for i in range(j) if (not sets[i] and not sets[j]) or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = list(range(len(rows)))
    for _ in near:
        before = list(want)
        for i, j in near:
            want[i] = want[j] = min(want[i], want[j])
        if want == before:
            break
    want = dict(enumerate(want))
    groups = defaultdict(set)
    for r in simhash.near_copies(d).collect():
        groups[r["root"]].add(r["id"])
    assert {i: min(g) for g in groups.values() for i in g} == want
    assert len(near) > 80 and {r["doc_id"] for r in simhash.without_near_copies(d).collect()} == set(want.values())
