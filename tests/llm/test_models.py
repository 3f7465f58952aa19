"""Toxicity, embeddings, the pipeline and the registered queries."""

import importlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkgrid.llm import embed_dedup, queries, toxicity

TINY = "/root/testdata/sf0.001"


# --- toxicity


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        text = [f"w{rng.randrange(300)}" for _ in range(40)]
        if toxic:
            for _ in range(4):
                text[rng.randrange(40)] = "nasty" + rng.choice(["ly", "er", "ness", ""])
        rows.append((i, " ".join(text)))
        if i % 10 != 9:
            labels.append((i, int(toxic)))
    rows += [(1000, ""), (1001, None), (1002, "w1 " * 5000), rows[0]]
    labels += [(0, 1), (3, None), (4, 7), (None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_separates_held_out_texts(marked):
    docs, labels = marked
    got = {r["id"]: r["score"] for r in toxicity.score(docs, labels).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = [(got[i] >= 0.3) == (i % 5 == 0) for i in held]
    assert len(held) > 100 and np.mean(right) > 0.9
    assert all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001]
    assert toxicity.score(docs, labels).count() == docs.count()


def test_held_out_labels_are_not_read(marked):
    docs, labels = marked
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    turned = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r["id"]: r["score"] for r in toxicity.score(docs, labels).collect()}
    b = {r["id"]: r["score"] for r in toxicity.score(docs, turned).collect()}
    assert a == pytest.approx(b)


def test_toxicity_without_labels(marked):
    docs, labels = marked
    assert max(r["score"] for r in toxicity.score(docs, labels.limit(0)).collect()) < 1e-5
    assert toxicity.score(docs.limit(0), labels).count() == 0


def brute_ratio(word, counts, discount=2.0):
    """By the formula, over a list of (word, class, documents) with hand-made prefixes."""
    path = lambda w: [w[:k] for k in range(min(len(w), toxicity.DEPTH) + 1)] + [w + "$"]
    n = [{}, {}]
    below = {}
    for w, c, k in counts:
        for a, b in zip(path(w), path(w)[1:], strict=False):
            n[c][b] = n[c].get(b, 0) + k
            below.setdefault(a, set()).add(b)
    total = 0.0
    for a, b in zip(path(word), path(word)[1:], strict=False):
        if a not in below:
            break
        get = lambda c, y: n[c].get(y, 0)
        above = [sum(get(c, y) for y in below[a]) for c in (0, 1)]
        shared = (get(0, b) + get(1, b)) / sum(above) or 1e-12  # unknown ones are rarest of all
        p = []
        for c in (0, 1):
            freed = sum(min(get(c, y), discount) for y in below[a])
            p.append((max(get(c, b) - discount, 0) + freed * shared) / above[c] if above[c] else shared)
        total += float(np.log(p[1] / p[0]))
    return total


def test_ratios_are_those_of_the_formula(spark):
    rng = random.Random(3)
    rows, labels = [], []
    learnt = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    for i in learnt:
        rows.append((i, " ".join(rng.choice(["bad", "badly", "be", "bee", "hello", "extraordinarily", "rare" * (i % 17 == 0) or "x"]) for _ in range(6))))
        labels.append((i, int("bad" in rows[-1][1] and i % 3 > 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    mark = dict(labels)
    known = ["bad", "badly", "be", "bee", "hello", "extraordinarily", "rare"]
    held = toxicity.nodes(toxicity.labelled(docs, marks, "doc_id", "text", "toxic").where("toxic is not null"))
    more = spark.createDataFrame([(" ".join([*known, "badness", "unknown"]),)], "text string")
    found, table = {r["w"]: r for r in toxicity.word_ratios(more, held, "text").collect()}, held.toArrow()
    for r, b, out in zip(toxicity.STEPS, toxicity.RARE, (None, *toxicity.FOLDS), strict=True):
        model = toxicity.Model(table["node"].to_numpy(), table[r].to_numpy(), table[b].to_numpy())
        counts = [(w, mark[i], 1) for i, t in rows if zlib.crc32(str(i).encode()) % 4 != out for w in set(t.split())]
        for word in (*known, "badness", "unknown"):
            want = pytest.approx(brute_ratio(word, counts), abs=1e-4)
            assert found[int(toxicity.word_hashes([word])[0])][r] == want == model.ratio([word])[0], (r, word)


def test_rare_words_speak_for_neither():
    counts = [("common", 0, 100), ("common", 1, 100), ("rare", 1, 1)]
    assert abs(brute_ratio("rare", counts)) < 1.5 and brute_ratio("toxic", [*counts, ("toxic", 1, 60)]) > 1.5


def test_joined_ratios_give_equal_scores(marked):
    docs, labels = marked
    a = {r["id"]: r["score"] for r in toxicity.score(docs, labels).collect()}
    b = {r["id"]: r["score"] for r in toxicity.score(docs, labels, broadcast_nodes=3).collect()}
    assert a == pytest.approx(b, abs=1e-5)
    assert toxicity.score(docs, labels, broadcast_nodes=3).count() == docs.count()


def test_mapped_ratios_give_equal_scores(marked, monkeypatch):
    docs, labels = marked
    monkeypatch.setattr(toxicity, "PIECE", 50)
    a = {r["id"]: r["score"] for r in toxicity.score(docs, labels).collect()}
    monkeypatch.setattr(toxicity, "word_ratios", None)  # no join of all words for a large model
    b = {r["id"]: r["score"] for r in toxicity.score(docs, labels, broadcast_nodes=3).collect()}
    monkeypatch.undo()
    c = {r["id"]: r["score"] for r in toxicity.score(docs, labels, broadcast_nodes=3, mapped_nodes=3).collect()}
    assert a == pytest.approx(b, abs=1e-5) and a == pytest.approx(c, abs=1e-5) and len(a) > 50


# --- embeddings


def brute_links(vectors, threshold=0.95):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    same = x @ x.T >= threshold
    np.fill_diagonal(same, False)
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in zip(*np.nonzero(same), strict=True):
            root[ids[a]] = root[ids[b]] = min(root[ids[a]], root[ids[b]])
    return {i: int(n) for i, n in zip(ids, same.sum(1), strict=True)}, root


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "SHARD", 64)
    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(size=16) for i in range(400)}
    for i in range(400, 460):
        vectors[i] = vectors[i % 7] + rng.normal(size=16) * 0.12
    for i in range(460, 480):
        vectors[i] = vectors[3] * (1 if i % 2 else 2.0**300)
    vectors = {i: [float(np.float32(v)) if abs(v) < 1e30 else float(v) for v in x] for i, x in vectors.items()}
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, [None] + [1.0] * 15), (1004, [1.0]), (1005, []), (1006, [float("inf")] + [1.0] * 15)]
    rows = [(i, v, 0, 1) for i, v in vectors.items()] + [(i, v, 0, 1) for i, v in odd]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int, shard int").repartition(3)
    got = {r["id"]: (r["n_links"], r["component"]) for r in embed_dedup.dedup(d).collect()}
    links, root = brute_links(vectors)
    assert all(got[i] == (0, i) for i, _ in odd) and len(got) == len(rows)
    found, true = sum(got[i][0] for i in vectors), sum(links.values())
    assert all(got[i][0] <= links[i] for i in vectors) and found / true >= 0.9
    assert np.mean([got[i][1] == root[i] for i in vectors]) >= 0.98
    audit = {r["id"]: r["n_true"] for r in embed_dedup.true_links(d, block=7).collect()}
    assert all(audit[i] == links[i] for i in audit if i in links)
    assert embed_dedup.dedup(d.limit(0)).count() == 0


def test_embeddings_of_several_widths_and_repeated_ids(spark):
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(40)]
    rows += [(100, [1.0, 2.0]), (101, [1.0, 2.0]), (102, [2.0, 4.0]), (103, [2.0, -1.0])]
    rows += [(2, rows[5][1]), (2, (np.array(rows[7][1]) * 3).tolist()), (None, rows[9][1]), rows[11], rows[11]]
    rows += [(1000 + i, rows[3][1]) for i in range(30)]  # one hot vector
    d = spark.createDataFrame([(k, i, v) for k, (i, v) in enumerate(rows)], "row int, vec_id long, embedding array<double>")
    got = sorted(((r["id"] is None, r["id"] or 0, r["n_links"], -1 if r["component"] is None else r["component"]) for r in embed_dedup.dedup(d).collect()))
    want = []
    for k, (i, v) in enumerate(rows):
        near = [j for j, (_, u) in enumerate(rows) if len(u) == len(v) and np.dot(u, v) >= 0.95 * np.linalg.norm(u) * np.linalg.norm(v)]
        ids = [rows[j][0] for j in near if rows[j][0] is not None]
        want.append((i is None, i or 0, len(near) - 1, min(ids) if ids else -1))
    assert got == sorted(want)


def test_audit_widens_a_poor_search(spark, monkeypatch):
    rng = np.random.default_rng(13)
    base = rng.normal(size=(6, 12))
    d = spark.createDataFrame([(i, (base[i % 6] + rng.normal(size=12) * 0.1).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    turns = []
    monkeypatch.setattr(embed_dedup, "_recall", lambda *a: turns.append(1) or (0.5 if len(turns) < 2 else 1.0))
    assert embed_dedup.dedup(d).count() == 300 and len(turns) == 2


def test_pruning_keeps_the_nearest():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    src, dst = embed_dedup.pruned_edges(x)
    near = x @ x.T - 3 * np.eye(200)
    edges = set(zip(src.tolist(), dst.tolist(), strict=True))
    assert all((i, int(near[i].argmax())) in edges for i in range(200))
    assert np.bincount(src).max() <= embed_dedup.DEGREE < 199


# --- pipeline and queries


def test_pipeline(spark):
    docs = queries.table(spark, TINY, "documents")
    bench = [r["text"] for r in queries.table(spark, TINY, "benchmark").collect()]
    before, names = docs, []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialize(stage(spark, before, TINY))
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in before.select("doc_id").collect()} and ids
        if stage is not corpus_pipeline.encode:
            assert after.columns == docs.columns
            names.append(name)
        before = after
    assert len(names) == 4 and before.where("n_tokens <> size(ids)").count() == 0
    kept = {r["doc_id"] for r in before.collect()}
    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())
    windows = {tuple(words(t)[k : k + 10]) for t in bench for k in range(max(1, len(words(t)) - 9))}
    for r in docs.collect():
        w = words(r["text"])
        if any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9)):
            assert r["doc_id"] not in kept


def test_pipeline_on_odd_rows(spark, docs, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, rows in (("full", odd), ("none", odd.limit(0))):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        spark.createDataFrame([(1, "some item text"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "full")).count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    assert spark.read.schema(schema).parquet(str(tmp_path / "none" / "documents.parquet")).count() == 0


COLUMNS = {
    1: ["doc_id", "held_out", "score", "predicted"],
    2: ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    3: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    4: ["vec_id", "n_links", "component_id", "kept"],
    5: ["doc_id", "fingerprint", "component_id"],
    6: ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    8: ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    9: ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_return_every_row(spark, name):
    number = int(re.match(r"op(\d+)_", name)[1])
    df = queries.QUERIES[name](spark, TINY)
    assert df.columns[: len(COLUMNS.get(number, []))] == COLUMNS.get(number, [])
    assert df.count() == queries.table(spark, TINY, "embeddings" if number == 4 else "documents").count()


def test_personal_data_stays_native(spark):
    plan = queries.QUERIES["op9_pii"](spark, TINY)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_nothing_else_imports_this_package():
    root = Path(importlib.import_module("inkgrid").__file__).parent
    for file in root.rglob("*.py"):
        if "llm" not in file.parts:
            assert "llm" not in file.read_text(), file
