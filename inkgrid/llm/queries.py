"""The queries of this subpackage, one ``opN_<name>`` per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, embed_dedup, line_dedup, pii, sharding, simhash, substring_dedup, suffix_dedup, toxicity
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("id").cast("string")) % 4 == 2, F.lit(False))
    return toxicity.score(docs, labels).select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs, 40).select(
        "doc_id",
        F.col("shard_size").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("shard_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op4_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embed_dedup.dedup(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.size("spans").cast("long").alias("n_runs"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [pii.count_kind(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    digests = [F.sha2(pii.digest(F.col("base")), 256).alias("base_sha256"), pii.digest(F.concat("base", "terms")).alias("spans")]
    more = [F.size("terms").cast("long").alias("n_term"), (F.size("base") + F.size("terms")).cast("long").alias("n_found"), F.sha2("clean", 256).alias("clean_sha256")]
    return found.select(F.col("id").alias("doc_id"), *counts, *digests, *more)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.passages(table(spark, sf_dir, "documents"))
    n_dup = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["begin"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), "n_words", n_dup.alias("n_dup"), F.size("spans").cast("long").alias("n_passages"), spans.alias("spans"), (n_dup > 0).alias("duplicated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_sharding, op3_bpe, op4_embed_dedup, op5_simhash, op6_decontaminate, op7_line_dedup, op8_suffix_dedup, op9_pii, op10_substring_dedup)}
_COSINE = """WITH RECURSIVE v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
ok AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a, ok b WHERE a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach(id, too) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN link l ON l.a = r.too),
root AS (SELECT id, min(too) AS component_id FROM reach GROUP BY id), n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN root ON id = e.vec_id LEFT JOIN n ON a = e.vec_id"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_WINDOWS = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT item, array_to_string(w[k:k + 9], ' ') AS s, least(10, len(w)) AS n FROM b, unnest(range(1, greatest(2, len(w) - 8))) t(k) WHERE len(w) > 0),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM iw), unnest(range(1, len(w) - n + 2)) t(k) WHERE len(w) >= n),
hit AS (SELECT DISTINCT doc_id, k, dw.n, item FROM dw JOIN iw ON iw.s = dw.s AND iw.n = dw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS l FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""

#: The shortest sufficient runs from and up to each line; those seen before cover the copies.
_LINES = """WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
c AS (SELECT doc_id, l, list_transform(l, lambda x: len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'))) AS w FROM d),
p AS (SELECT doc_id, l, w, i, (SELECT min(j) FROM unnest(range(i, len(l) + 1)) t(j) WHERE list_sum(w[i:j]) >= 5) AS e, (SELECT max(j) FROM unnest(range(1, i + 1)) t(j) WHERE list_sum(w[j:i]) >= 5) AS b FROM c, unnest(range(1, len(l) + 1)) t(i)),
r AS (SELECT doc_id, i AS a, e AS z, l[i:e] AS k FROM p WHERE e IS NOT NULL UNION SELECT doc_id, b, i, l[b:i] FROM p WHERE b IS NOT NULL),
f AS (SELECT k, min((doc_id, a)) AS first FROM r GROUP BY k),
g AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS i FROM r JOIN f USING (k) WHERE (doc_id, a) > first),
n AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (NOT EXISTS (SELECT 1 FROM g h WHERE h.doc_id = g.doc_id AND h.i = g.i - 1)) AS n_runs, list(i) AS gone FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, sha256(array_to_string(CASE WHEN gone IS NULL THEN l ELSE list_filter(l, lambda x, i: NOT list_contains(gone, i)) END, chr(10))) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {"op4_embed_dedup": _COSINE, "op6_decontaminate": _WINDOWS, "op7_line_dedup": _LINES}
