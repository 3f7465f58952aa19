"""Each operator against a brute-force version, and its odd cases."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkgrid.llm import bpe, common, decontaminate, line_dedup, pii, sharding, simhash, substring_dedup, suffix_dedup

PATH = public_tokenizers.path("byte_bpe_50k.json")


def by_id(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


# --- components


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 120), (120, 110), (7, 5), (300, 301), (5, 5)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 120: 100, 110: 100, 301: 300}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- sharding


@pytest.mark.parametrize("per_shard", [2, 32])
def test_shards(docs, per_shard):
    rows = sharding.shard(docs, 4, ranges_per_shard=per_shard, samples_per_range=3).collect()
    assert len(rows) == docs.count()
    assert {"a.b", "lang", "text"} <= set(rows[0].asDict()) and "__ink_k" not in rows[0].asDict()
    slots, size = defaultdict(list), defaultdict(int)
    for r in rows:
        assert r["shard_size"] == len((r["text"] or "").encode()) + 16
        slots[r["shard"]].append(r["shard_slot"])
        size[r["shard"]] += r["shard_size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    most = max(r["shard_size"] for r in rows)
    assert max(size.values()) - sum(size.values()) / 4 <= most


def test_shards_of_one_hot_text(spark):
    hot = spark.createDataFrame([(i, "same text") for i in range(400)], "doc_id long, text string")
    sizes = [r["n"] for r in sharding.shard(hot, 8, ranges_per_shard=4, samples_per_range=4).groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 1


def test_shards_of_one_repeated_row(spark):
    rows = [(7, "same text")] * 300 + [(i, f"text {i}") for i in range(50)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8, ranges_per_shard=4, samples_per_range=4).collect()
    slots, size = defaultdict(list), defaultdict(int)
    for r in found:
        slots[r["shard"]].append(r["shard_slot"])
        size[r["shard"]] += r["shard_size"]
    assert len(found) == 350 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) <= 60


def test_shards_of_nothing(none):
    assert sharding.shard(none, 4).count() == 0


# --- byte pair encoding


def test_encoding_is_that_of_the_library(docs, texts):
    known = Tokenizer.from_file(PATH)
    got = by_id(bpe.round_trip(docs, PATH, lexicon_words=300, keep_ids=True), "n_tokens", "ids_sha256", "decoded_sha256", "ids")
    for i, text in enumerate(texts):
        ids = known.encode(text or "", add_special_tokens=False).ids
        back = known.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), ids)
        assert back == (text or "")


def test_encode_and_decode(docs, texts, none):
    encoded = bpe.encode(docs.where("doc_id is not null"), PATH, lexicon_words=50)
    got = by_id(bpe.decode(encoded, PATH), "text")
    assert all(got[i] == (t or "") for i, t in enumerate(texts))
    assert bpe.round_trip(none, PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="ab \n'sth<|>19éß \x1c\x85日🙂", max_size=80)), min_size=1, max_size=4))
def test_any_text_encodes_alike(found):
    found = [t.encode("utf-8", "ignore").decode() for t in found]
    ids, ends = coder().encode(found)
    begin = 0
    for text, end in zip(found, ends.tolist(), strict=True):
        assert ids[begin:end].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
        begin = end


TOKENIZER = Tokenizer.from_file(PATH)


def coder(_held=[]):  # noqa: B006
    if not _held:
        v = bpe.Vocabulary(PATH)
        words = sorted({w.encode() for w in ("the", " the", "a", "ab", " éß", "\n\n", "there", "here", " here")})
        _held.append(bpe.Coder(v, bpe.compile_lexicon(words, v.merge(words))))
    return _held[0]


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from([chr(i) for i in range(128)] + list(" \t\n\x1c\x1f'strevmld") * 4)))
def test_ascii_texts_split_alike(text):
    assert bpe.split_words(text) == bpe.WORD.findall(text)


def test_lexicon_shares_suffixes_and_long_words_merge():
    v = bpe.Vocabulary(PATH)
    words = sorted(f"{a}{b}ing".encode() for a in "abcdefg" for b in "xyz")
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words, v.merge(words)))
    assert lexicon.index(words).tolist() == list(range(len(words)))
    assert lexicon.index([b"axin", b"axings", b"", b"zz"]).tolist() == [-1] * 4
    assert len(lexicon.final) == 6 and len(lexicon.key) == 7 + 3 + 3
    for word in (b"abc" * 500, b"aaaaaaaaaaaaaaaaab" * 9, b"x"):
        assert v.merge_long(word).tolist() == TOKENIZER.encode(word.decode(), add_special_tokens=False).ids
    empty = bpe.Lexicon(bpe.compile_lexicon([], []))
    assert empty.index([b"a"]).tolist() == [-1]


# --- SimHash


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def test_simhash(docs, texts, none):
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    roots = brute_components(fps)
    got = by_id(simhash.dedup(docs), "fp", "component")
    for i in fps:
        assert got[i][0] % (1 << 64) == fps[i] and got[i][1] == roots[i]
    kept = sorted(r["doc_id"] for r in simhash.one_of_each(docs).where("doc_id is not null").collect())
    assert kept == sorted(set(roots.values()))
    assert simhash.one_of_each(docs).columns == docs.columns
    assert simhash.dedup(none).count() == 0 and simhash.one_of_each(none).count() == 0


def test_links_in_large_buckets(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6, np.uint64)
    fps = {int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (40, 2))}
    fps = np.array(sorted(fps), np.uint64)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    a, b = simhash._pairs(fps, 2)
    got = {int(x): int(y) for x, y in zip(a, b, strict=True)}
    want = brute_components({int(f): int(f) for f in fps})
    assert {f: got.get(f, f) for f in want} == want


# --- decontamination


def brute_hits(text, windows):
    w = [x.decode() for x in decontaminate.words(text)]
    hit, items = set(), set()
    for n in {len(k) for k in windows}:
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                items |= windows[tuple(w[i : i + n])]
    return len(w), len(hit), sorted(items)


def test_decontamination_of_repeated_rows(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text), (1, text), (None, text), (None, text), (2, "short"), (2, "short"), (3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, text), (2, "short of words"), (3, "other words")], "item_id long, text string")
    found = [sorted((str(r["id"]), r["n_words"], str(r["spans"]), r["items"]) for r in decontaminate.hits(docs, items, block_chars=chars).collect()) for chars in (1 << 20, 5)]
    assert len(found[0]) == len(rows) and found[0] == found[1]


def test_decontamination(spark, docs, texts, none):
    long = texts[0].split()
    rows = [(1, " ".join(texts[1].split()[:14])), (2, texts[40] and texts[40][:90]), (3, "DÉJÀ vu"), (4, ""), (5, None), (10, " ".join(long[-12:]) + " other"), (11, "x"), (12, "the the the the the the the the the the the"), (1, texts[2])]
    items = spark.createDataFrame(rows, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in rows:
        w = [x.decode() for x in decontaminate.words(t)]
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    for chars in (1 << 20, 40):
        got = by_id(decontaminate.hits(docs, items, block_chars=chars), "n_words", "spans", "items")
        for i, t in enumerate(texts):
            n, spans, found = got[i]
            assert (n, sum(s["end"] - s["begin"] for s in spans), found) == brute_hits(t, windows), i
    clean = {r["doc_id"] for r in decontaminate.clean(docs, items).collect()}
    assert clean == {i for i, t in enumerate(texts) if not brute_hits(t, windows)[1]} | {None}
    empty = items.limit(0)
    assert decontaminate.hits(none, items).count() == 0
    assert decontaminate.hits(docs, empty).where(F.size("spans") > 0).count() == 0


# --- line dedup


def brute_lines(rows, least=5):
    """Lines of later copies, by looking at every run of lines."""
    seen, gone = set(), {}
    for i, text in rows:
        lines = (text or "").split("\n")
        mine, new = set(), []
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(lines[a:b])
                if sum(len(x.encode().split()) for x in run) >= least:
                    if run in seen:
                        mine |= set(range(a, b))
                    seen.add(run)
                    new.append(run)
        gone[i] = mine
    return gone


def test_line_dedup(docs, texts, none):
    rows = [(None, "no id here"), *enumerate(texts)]
    gone = brute_lines(rows)
    got = by_id(line_dedup.dedup(docs), "text", "n_lines", "n_removed", "spans")
    for i, t in rows:
        lines = (t or "").split("\n")
        want = "\n".join(x for k, x in enumerate(lines) if k not in gone[i]) if gone[i] else t
        assert got[i][:3] == (want, len(lines), len(gone[i])), i
        assert {k for s in got[i][3] for k in range(s["begin"], s["end"])} == gone[i]
    kept = line_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    whole = {i for i, t in rows if gone[i] and not got[i][0].strip()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - whole
    assert kept.where("n_chars <> length(text)").count() == 0
    assert line_dedup.dedup(none).count() == 0


def test_runs_of_many_short_lines(spark):
    block = ["a", "b", "", "c", "", "", "d", "e f", "g"]
    rows = [(1, "\n".join(block)), (2, "x\n" + "\n".join(block) + "\ny"), (3, "\n".join(block[:4])), (4, "\n".join(["z"] * 13)), (5, "\n".join(block[2:]))]
    gone = brute_lines(rows)
    got = by_id(line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")), "n_removed")
    assert got == {i: len(g) for i, g in gone.items()} and got[2] == 9 and got[3] == 0


# --- suffix dedup


def brute_bytes(texts, length):
    count = defaultdict(int)
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] += 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
def test_suffix_dedup(spark, docs, texts, none, hot):
    rows = [*enumerate(texts), (2, texts[2]), (None, "no id here")]
    gone = brute_bytes([(t or "").encode() for _, t in rows], 200)
    got = by_id(suffix_dedup.dedup(docs, hot=hot), "kept", "n_bytes", "n_removed", "spans")
    for (i, t), g in zip(rows, gone, strict=True):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        assert got[i][:3] == (raw[~g].tobytes(), len(raw), int(g.sum())), i
        assert len(got[i][3]) == int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
    assert sum(g.sum() for g in gone) > 3000
    assert suffix_dedup.dedup(none).count() == 0


@pytest.mark.parametrize("hot", [50, 2])
def test_suffix_dedup_of_short_strings(spark, hot):
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab"), rng.integers(0, 120))) for _ in range(40)] + ["ab" * 40, "a" * 70, "a" * 9]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(suffix_dedup.dedup(d, length=16, gram=5, hot=hot), "n_removed")
    for i, g in enumerate(brute_bytes([t.encode() for t in texts], 16)):
        assert got[i] == int(g.sum()), (i, texts[i])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=12), min_size=1, max_size=12, unique=True))
def test_blind_tries_sort(strings):
    assert [strings[i] for i in suffix_dedup.blind_trie_order(strings)] == sorted(strings)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.lists(st.sampled_from([0, 97, 98]), max_size=24).map(bytes)), min_size=1, max_size=30), st.sampled_from([0, 8, 16]))
def test_deep_shallow_order(found, shallow):
    group, strings = np.array([g for g, _ in found]), [s for _, s in found]
    matrix = np.frombuffer(b"".join(s.ljust(24, b"\0") for s in strings), np.uint8).reshape(-1, 24)
    order, lcp = suffix_dedup.deep_shallow(strings, matrix, group, 0, shallow)
    assert [(group[i], strings[i]) for i in order] == sorted((g, s) for g, s in found)
    for k in range(1, len(order)):
        a, b = order[k - 1], order[k]
        assert lcp[k] == (suffix_dedup.common_prefix(strings[a], strings[b]) if group[a] == group[b] else -1)


# --- personal data


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute_spans(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS for m in re.finditer(p, text) if holds(k, m[0])]


def test_base_findings(spark, none):
    rng = np.random.default_rng(2)
    pieces = list("ab@.-+ ()0123456789") + ["x@y.zz", "4111 1111 1111 1111", "10.0.0.1", "é", "🙂", "\n", "+49 (30) 1234-567", "256.1.1.1", "0010.1.1.1", "a@b.co_x@y.com"]
    texts = ["".join(rng.choice(pieces, rng.integers(1, 60))) for _ in range(300)]
    texts += ["a" * 30000 + "@b.cc", "1" * 40000, "1-" * 20000 + "1", "+" + "1 " * 9000 + "1", "x." * 15000 + "@", "", None, "1.2.3.4.5.6.7.8", "mail a.b@c-d.e.f. end"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(pii.find(d), "base")
    for i, t in enumerate(texts):
        assert [(s["kind"], s["start"], s["end"]) for s in got[i]] == brute_spans(t or ""), (i, t and t[:80])
    assert pii.find(none).count() == 0


def test_revealing_terms(spark):
    rows = [(i, f"note {'abcdefghij'[i] * 5} of Zarkonius Velt at zv.1@ex.org number {i}") for i in range(6)]
    rows += [(10 + i, f"plain note number {i} at home zzz{i}@ex{i}.org") for i in range(60)]
    rows += [(100, "Seen: ZARKONIUS in town"), (101, None), (102, ""), (103, "zarkoniusx zv.1@ex.org")]
    d = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    found = pii.find(d, min_bits=2)
    text = dict(rows)
    terms = {i: [text[i][s["start"] : s["end"]] for s in got] for i, got in by_id(found, "terms").items()}
    assert terms[0] == ["Zarkonius", "Velt"] and terms[100] == ["ZARKONIUS"]
    assert not any(terms[10 + i] for i in range(60)) and terms[101] == [] and terms[103] == []
    clean = by_id(pii.sanitise(d, found), "text")
    assert clean[0] == "note aaaaa of [TERM] [TERM] at [EMAIL] number 0" and clean[100] == "Seen: [TERM] in town"
    assert by_id(pii.sanitise(d, found, remove=True), "text")[100] == "Seen:  in town"
    assert found.where("id = 0").count() == 2


def brute_told(rows, min_texts=3, min_reveal=0.5, min_bits=6.0):
    """Terms beyond the threshold, by counting."""
    term = lambda t: set(re.findall(r"[^\W_]{4,}", t.lower()))
    near, holds_e, texts = defaultdict(int), defaultdict(int), defaultdict(set)
    n_t = defaultdict(int)
    for text in rows:
        for w in term(text):
            n_t[w] += 1
        pairs, mine = set(), set()
        for kind, a, b in brute_spans(text):
            value = text[a:b].lower()
            digits = re.sub("[^0-9]", "", value)
            wide = value.split("@", 1)[1] if kind == "email" else ".".join(value.split(".")[:2]) if kind == "ip" else digits[:6]
            own = value.split("@")[0] if kind == "email" else ""
            company = term(" ".join([text[max(0, a - 80) : a], text[b : b + 80], own]))
            for e in ((1, kind, value), (2, kind, wide)):
                mine.add(e)
                pairs |= {(w, e) for w in company}
        for e in mine:
            holds_e[e] += 1
        for p in pairs:
            near[p] += 1
            texts[p].add(text)
    out = set()
    for (w, e), n in near.items():
        if not n_t[w]:  # part of a word, where the context ends
            continue
        reveal, own = min(1.0, n / n_t[w]), np.log2(len(rows) / holds_e[e])
        if len(texts[w, e]) >= min_texts and reveal >= min_reveal and own >= 0.5 and np.log2(reveal) + own >= min(min_bits, 0.9 * own):
            out.add(w)
    return out


def test_disclosure_against_counting(spark):
    rng = random.Random(6)
    names = ["Ada", "Zarkon", "Velt", "Mirelle", "Quorra9", "agent47"]
    rows = []
    for i in range(240):
        w = [rng.choice(["alpha", "beta", "gamma", "delta", "river", "stone", f"u{i}x{rng.randrange(9)}yy"]) for _ in range(25)]
        if i % 4 == 0:
            k = rng.randrange(len(names))
            w[rng.randrange(25)] = f"{names[k].lower()}.{k}@mail{k % 2}.example.org"
            w[rng.randrange(25)] = names[k]
        if i % 9 == 0:
            w[rng.randrange(25)] = f"10.{i % 3}.{i % 200}.7"
            w[rng.randrange(25)] = f"subnet{i % 3}"
        if i % 3 == 0:  # an entity in a third of all rows
            w[3], w[5] = "+49 (30) 555-1234", "hotline"
        rows.append(" ".join(w))
    rows += ["", "Quorra9 without an address"]
    want = brute_told(rows)
    d = spark.createDataFrame([*enumerate(rows), (999, None)], "doc_id long, text string")
    told = {r["term"] for r in pii.revealing(d.where("text is not null")).collect()}
    assert told == want and {"zarkon", "quorra9", "agent47", "hotline"} <= told and "alpha" not in told
    found = [by_id(pii.find(d, in_place=k), "terms", "clean") for k in (4096, 2)]
    assert found[0] == found[1]
    assert found[0][241][1] == "[TERM] without an address" and found[0][999] == ([], "")
    for i, t in enumerate(rows):
        base = brute_spans(t)
        hits = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", t) if m[0].lower() in told and not any(a < m.end() and m.start() < b for _, a, b in base)]
        assert [(s["start"], s["end"]) for s in found[0][i][0]] == hits
    clean = by_id(pii.sanitise(d, pii.find(d)), "text")
    assert clean == {i: c for i, (_, c) in found[0].items()}


def test_many_matches_in_one_text(spark):
    text = "x " + "a@b.cc 1.2.3.4 " * 3000
    got = by_id(pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")), "base")[1]
    assert [(s["kind"], s["start"], s["end"]) for s in got] == [(k, a, b) for k in ("email", "ip") for j, a, b in brute_spans(text) if j == k]


# --- passages


def covered(spans):
    return {k for s in spans for k in range(s["begin"], s["end"])}


def test_passages(docs, texts, none):
    got = by_id(substring_dedup.passages(docs), "n_words", "spans")
    words = {i: (t or "").encode().lower().split() for i, t in enumerate(texts)}
    owners = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 49):
            owners[tuple(w[k : k + 50])].add(i)
    owners[tuple(words[2][:50])].add(-1)
    for i, w in words.items():
        want = {k + j for k in range(len(w) - 49) if len(owners[tuple(w[k : k + 50])]) > 1 for j in range(50)}
        assert got[i][0] == len(w) and want <= covered(got[i][1]), i
    edited = next(i for i, t in enumerate(texts) if t and "changed" in t)
    at = words[edited].index(b"changed")
    assert {at - 20, at, at + 20} <= covered(got[edited][1])
    alone = {i for i in range(10, 30) if not got[i][1]}
    assert len(alone) == 20
    assert substring_dedup.passages(none).count() == 0


def planted(n, change):
    """Texts with unrelated surroundings; 2 i and 2 i + 1 hold a passage and its copy."""
    rng = random.Random(11)
    say = lambda k: [f"x{rng.randrange(10**9)}" for _ in range(k)]
    out = []
    for _ in range(n):
        passage = say(50)
        for part in (passage, change(passage)):
            out.append(" ".join([*say(60), *part, *say(60)]))
    return out


def test_passages_recall_at_the_least_similarity(spark):
    # one word changed: 41 of 51 shingles are common, 0.804; three hash functions miss 0.8 %
    made = planted(300, lambda p: [*p[:25], "changed", *p[26:]])
    found = substring_dedup.passages(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"))
    got = {r["id"] for r in found.collect() if r["spans"]}
    both = sum(2 * i in got and 2 * i + 1 in got for i in range(300))
    assert both >= 0.97 * 300, both


def test_passages_with_moved_words(spark):
    # a copy without words 29-31 (49 of 60 shingles in common), one with its halves exchanged (42 of 50)
    rng = random.Random(12)
    say = lambda k: [f"y{rng.randrange(10**9)}" for _ in range(k)]
    made = []
    for i in range(60):
        passage = say(50 if i % 2 else 60)
        copy = [*passage[25:], *passage[:25]] if i % 2 else [*passage[:28], *passage[31:]]
        made += [" ".join([*say(60), *part, *say(60)]) for part in (passage, copy)]
    got = by_id(substring_dedup.passages(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")), "spans")
    both = [{80, 100} <= covered(got[2 * i]) and {80, 100} <= covered(got[2 * i + 1]) for i in range(60)]
    assert sum(both[::2]) >= 28 and sum(both[1::2]) >= 28, both


def test_passages_of_large_groups(spark):
    # c is shingle 6 of 46 and one word is changed such that shingles 9-13 differ; only the
    # passage's own words are in common, among 200 different surroundings
    rng = random.Random(13)
    say = lambda k: [f"z{rng.randrange(10**9)}" for _ in range(k)]

    def least(words):
        h, size, _ = substring_dedup.shingle_hashes([" ".join(words)], 5)
        return [c for rows in substring_dedup.compact_windows(h, size, 46, 1) for _, _, c, _, _ in rows.tolist()]

    edited = lambda p: [*p[:13], "changed", *p[14:]]
    while least(passage := say(50)) != [6] or least(edited(passage)) != [6]:
        pass
    made = [" ".join([*say(60), *(edited(passage) if i == 0 else passage), *say(60)]) for i in range(200)]
    got = by_id(substring_dedup.passages(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"), hashes=1), "spans")
    assert all(set(range(60, 110)) <= covered(got[i]) for i in range(200))


def test_compact_windows_hold_every_stretch():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 50, 90).astype(np.uint64)
    size = np.array([40, 0, 5, 45])
    for rows in substring_dedup.compact_windows(h, size, 8, 2):
        for text, length in enumerate(size.tolist()):
            mine = [(c, a, b) for i, _, c, a, b in rows.tolist() if i == text]
            for i in range(length - 7):
                # one node for each stretch, by one of its places if the least hash repeats
                assert len({(a, b) for c, a, b in mine if a <= i and i + 7 <= b and i <= c <= i + 7}) == 1


def test_written_tables_free_their_shuffles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common.shared_dir, "own", str(tmp_path), raising=False)
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f.getName() for f in map(local.getAllFiles().apply, range(local.getAllFiles().size())) if f.getName().startswith("shuffle")}
    before = held()
    table = common.materialize(spark.range(1000).repartition(7, "id"))
    assert not held() - before and table.count() == 1000
    assert spark.conf.get(common.FREED, None) in (None, "false")
