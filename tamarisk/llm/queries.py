"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import (
    block_topk,
    chain_dedup,
    cutting_stock,
    ecoc_language,
    conversation_repair,
    embedding_forest,
    filter_audit,
    hilbert_shards,
    multi_index,
    ordinal_quality,
    prefix_bpe,
    secret_ownership,
    simhash_ring,
)
from .common import table


#: Probability of the highest grade from which a document is selected.
SELECT = 0.4


def op1_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_forest.link_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades from the labels: 0 toxic, 1 of low quality, 2 neither. ``selected``: likely of the highest grade."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    model = ordinal_quality.fit(docs, labels.select("doc_id", grade.cast("long").alias("grade")))
    return ordinal_quality.score(docs, model).withColumn("selected", F.col("tail") >= SELECT)


def op3_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    return prefix_bpe.digest_documents(table(spark, sf_dir, "documents"), path, P.PATTERN)


def op4_chain_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_ownership.scan(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest, "spans", "n_live", "n_copied")


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert_shards.hilbert_shards(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "cell",
    )


def op7_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = ecoc_language.fit(docs.where(~held_out))
    found = ecoc_language.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_simhash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_ring.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = block_topk.quantize(table(spark, sf_dir, "embeddings"))
    return block_topk.top_k(rows, F.col("vec_id") % 50 == 0)


def op10_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    out = cutting_stock.pack_digests(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))
    return found.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha256").alias("repaired_sha256")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op")}
    return {k: (lambda spark, sf_dir, f=f: f(ship(spark), sf_dir)) for k, f in found.items()}


_SOUND = """sound AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)"""


def _repair_sql() -> str:
    """The same shortest path with weights as strings: nine digits of cost, then the labels."""

    def plus(w: str, cost: str, label: str) -> str:
        return f"lpad(CAST(CAST(substr({w}, 1, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || substr({w}, 10) || '{label}'"

    crc = "CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, (c & 1) * 3988292384) END"
    name = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    steps = f"flatten(list_transform(str_split({name}, ''), lambda x: list_concat([CAST(ascii(x) AS BIGINT)], list_transform(range(8), lambda _: -1))))"
    near = f"""{plus("v0", "3", "I")}, {plus("v1", "3", "I")}, {plus("v3", "3", "I")}"""
    more = "CASE WHEN fault = 't' THEN 3 ELSE 0 END"
    closed = f"""SELECT * EXCLUDE (w2, w3), least(w2, {plus("w3", "3", "I")}) AS w2, least(w3, {plus("w2", "3", "I")}) AS w3
    FROM (SELECT *, least(v2, {near}) AS w2, least(v3, {plus("v2", "3", "I")}) AS w3 FROM"""
    return f"""WITH RECURSIVE base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce({steps}, lambda c, o: {crc}, CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS kind FROM conversations),
    rows AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN ''
    WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM base),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM rows),
    faulty AS (SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prior,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '' END AS fault FROM placed),
    walk AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS v0, CAST(NULL AS VARCHAR) AS v1, CAST(NULL AS VARCHAR) AS v2,
    CAST(NULL AS VARCHAR) AS v3 FROM base UNION ALL
    SELECT conv_id, i, {plus("v0", "4", "D")}, least({plus("v1", "4", "D")}, CASE WHEN sound AND initial = 's' THEN {plus("v0", more, "K")} END),
    least({plus("w2", "4", "D")}, CASE WHEN sound THEN {plus("least(v0, v1, w3)", "3 + " + more, "R")} END,
    CASE WHEN sound AND initial = 'u' THEN {plus("least(v0, v1, w3)", more, "K")} END),
    least({plus("w3", "4", "D")}, CASE WHEN sound THEN {plus("w2", "3 + " + more, "R")} END,
    CASE WHEN sound AND initial = 'a' THEN {plus("w2", more, "K")} END)
    FROM ({closed} (SELECT f.conv_id, f.i, initial, fault, fault NOT IN ('b', 'd') AS sound, v0, v1, v2, v3 FROM walk w
    JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)))),
    ends AS (SELECT conv_id, least(v0, w3) AS best FROM ({closed} walk)) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
    spelt AS (SELECT conv_id, CAST(substr(best, 1, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM ends),
    letters AS (SELECT conv_id, p, substr(audit, p, 1) AS x, length(replace(substr(audit, 1, p), 'I', '')) AS i,
    length(replace(substr(audit, 1, p), 'D', '')) AS o FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS p FROM spelt)),
    lines AS (SELECT l.conv_id, p, x, o, role, text, max(CAST(x = 'K' AND o = 1 AND initial = 's' AS INT)) OVER (PARTITION BY l.conv_id) AS led
    FROM letters l LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i),
    texts AS (SELECT conv_id, string_agg(CASE WHEN x = 'K' THEN role WHEN (o - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
    || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS t FROM lines WHERE x <> 'D' GROUP BY 1),
    counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (i > 1 AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY 1)
    SELECT s.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(t, '')) AS repaired_sha256
    FROM spelt s LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM s.conv_id"""


ORACLE = {
    "op13_conversation_repair": _repair_sql(),
    "op1_embedding_forest": f"""WITH RECURSIVE {_SOUND}, links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
    ON a.vec_id <> b.vec_id AND list_sum(list_transform(a.e, lambda x: x * x)) > 0 AND list_sum(list_transform(b.e, lambda x: x * x)) > 0
    WHERE list_cosine_similarity(a.e, b.e) >= 0.9), reach AS (SELECT a AS node, b AS other FROM links UNION
    SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a), counts AS (SELECT a, count(*) AS n FROM links GROUP BY 1),
    roots AS (SELECT node, min(other) AS root FROM reach GROUP BY 1)
    SELECT v.vec_id, coalesce(n, 0) AS n_links, coalesce(least(root, v.vec_id), v.vec_id) AS component_id,
    coalesce(least(root, v.vec_id), v.vec_id) = v.vec_id AS kept FROM (SELECT DISTINCT vec_id FROM embeddings) v
    LEFT JOIN counts ON a = v.vec_id LEFT JOIN roots ON node = v.vec_id""",
    "op12_filter_audit": r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
    f AS (SELECT part, w.doc_id, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
    FROM w LEFT JOIN (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1) l
    ON w.doc_id = l.doc_id),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    orders AS (SELECT p.x || q.x || r.x || s.x || u.x AS o FROM letters p, letters q, letters r, letters s, letters u
    WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
    runs AS (SELECT part, o, good, toxic, list_filter([CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END,
    CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END], lambda x: x IS NOT NULL) AS failed FROM f, orders),
    ends AS (SELECT *, list_min(list_transform(failed, lambda x: instr(o, x))) AS out_at FROM runs),
    steps AS (SELECT part, o AS filter_order, k AS step, substr(o, k, 1) AS x,
    count(*) FILTER (out_at IS NULL OR out_at > k) AS kept, count(*) FILTER (out_at = k) AS removed,
    count(*) FILTER (out_at < k AND list_contains(failed, substr(o, k, 1))) AS redundant,
    count(*) FILTER (failed = [substr(o, k, 1)]) AS unique_fails,
    count(*) FILTER (out_at = k AND good = 1) AS good_lost, count(*) FILTER (out_at = k AND toxic = 1) AS toxic_lost
    FROM ends, (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INT) AS k) GROUP BY 1, 2, 3)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM steps""",
    "op9_block_topk": f"""WITH {_SOUND}, ints AS (SELECT vec_id, list_transform(e, lambda x: CAST(floor(256 * x) AS BIGINT)) AS v FROM sound),
    scores AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda t: t[1] * t[2])) AS BIGINT) AS score
    FROM ints q JOIN ints c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM scores
    WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
