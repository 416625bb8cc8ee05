"""Nulls, empty and long texts, repeated rows, empty tables and clashing extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from tamarisk.llm import block_topk, chain_dedup, cutting_stock, ecoc_language, embedding_forest, hilbert_shards
from tamarisk.llm import ordinal_quality, prefix_bpe, secret_ownership, simhash_ring

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, hash string, count long"


@pytest.fixture(scope="module")
def docs(spark):
    long = "lorem ipsum dolor sit amet " * 4000
    texts = [None, "", "   ", "!!!", "the cat sat on the mat", "the cat sat on the mat", long, "token=Zx81Qm27Lk90"]
    rows = [(i, t, None if i == 4 else "en", None if i % 2 else "s", 1, "x", "y", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[4], rows[0]], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


PATH = {k: P.path(k) for k in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json")}
OPERATORS = {
    "tokens": lambda d: prefix_bpe.digest_documents(d, PATH["byte_bpe_multi_50k.tiktoken"], P.PATTERN),
    "secrets": secret_ownership.scan,
    "shards": hilbert_shards.hilbert_shards,
    "languages": lambda d: ecoc_language.predict(d, ecoc_language.fit(d)),
    "simhash": simhash_ring.near_duplicates,
    "quality": lambda d: ordinal_quality.score(d, ordinal_quality.fit(d, d.select("doc_id", (F.col("doc_id") % 3).alias("grade")))),
    "redact": secret_ownership.redact,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(docs, empty, name):
    got = OPERATORS[name](docs)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert OPERATORS[name](empty).count() == 0


def test_values_of_edge_cases(docs):
    lang = {r.doc_id: r.lang_pred for r in OPERATORS["languages"](docs).collect()}
    assert [lang[i] for i in range(5)] == ["und"] * 4 + ["en"]
    sim = {r.doc_id: (r.fp, r.component_id) for r in OPERATORS["simhash"](docs).collect()}
    assert [sim[i] for i in range(3)] == [(0, 0)] * 3 and sim[5][1] == 4
    found = {r.doc_id: r.base for r in secret_ownership.scan(docs).collect()}
    assert found[7] == "assign:0:18" and found[0] == ""
    red = {r.doc_id: r.text for r in secret_ownership.redact(docs).collect()}
    assert red[7] == "[SECRET]" and red[0] is None and red[4].startswith("the cat")


def test_passages_of_edge_cases(docs, empty, spark):
    assert chain_dedup.repeated_passages(docs).count() == 0
    assert chain_dedup.repeated_passages(empty).count() == 0
    assert chain_dedup.without_repeats(docs, chain_dedup.repeated_passages(docs)).count() == docs.count()
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"a b {text} c", "x"), (2, text, "x"), (3, f"q {text} r s", "x"), (3, f"q {text} r s", "x")]
    two = spark.createDataFrame(rows, "doc_id long, text string, pos string")
    got = chain_dedup.repeated_passages(two).dropDuplicates().toPandas().sort_values("doc_id")
    assert got[["doc_id", "start", "end", "source_id", "source_start"]].values.tolist() == [[2, 0, 60, 1, 2], [3, 1, 61, 1, 2]]
    kept = {r.doc_id: r.text for r in chain_dedup.without_repeats(two, chain_dedup.repeated_passages(two)).collect()}
    assert kept[1] == rows[0][1] and kept[3].split() == ["q", "r", "s"] and 2 not in kept


def test_packing_of_edge_cases(docs, empty):
    got = cutting_stock.pack(docs, PATH["byte_bpe_50k.json"]).toPandas()
    assert got.groupby("doc_id").length.sum()[1] == 1 and got.length.max() <= 1024
    assert (got.ids.str.len() == 4 * got.length).all()
    assert cutting_stock.pack(empty, PATH["byte_bpe_50k.json"]).count() == 0


def test_vectors_of_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0], [1.0, 0.0], [1.0, 0.01], [1.0, 0.0], [0.0, 1.0]]
    rows = [(i, v, 0) for i, v in enumerate(vectors)] + [(6, vectors[6], 0), (None, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_forest.link_vectors(df).collect()}
    assert got == {i: (2, 6) if i in (6, 7, 8) else (0, i) for i in range(10)}
    assert embedding_forest.link_vectors(df.limit(0)).count() == 0
    found = block_topk.top_k(block_topk.quantize(df), F.col("vec_id") == 6).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(found)] == [(1, 7, 65536), (2, 8, 65536), (3, 1, 0), (4, 9, 0)]
    assert block_topk.top_k(block_topk.quantize(df.limit(0)), F.col("vec_id") == 6).count() == 0
