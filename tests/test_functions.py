import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamarisk.functions import features as X
from tamarisk.functions import keys as K
from tamarisk.functions import pricing as P
from tamarisk.functions import similarity as S
from tamarisk.functions import text as T
from tamarisk.functions import vocabulary as V
from tamarisk.functions.html import product


def values(spark, inputs, make, kind="string"):
    """What an expression gives for each input."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x"))).collect()]


def test_sizes_genders_and_classes(spark):
    assert values(spark, ["عطر 100مل", "1 oz x", "50 ML", None, "no"], X.size_ml) == [100.0, pytest.approx(29.5735), 50.0, 0.0, 0.0]
    assert values(spark, ["عطر رجالي", "for women", "for him for her", None], X.gender) == [V.MALE, V.FEMALE, "", ""]
    names = ["sample 2ml", "gift set x", "tester x", "after shave", "shampoo", "body mist", "soap", "face cream", "oud 100ml"]
    want = ["rejected", "set", "tester", "after_shave", "shower_gel", "body_mist", "soap", "other", "retail"]
    assert values(spark, names, X.product_class) == want
    assert values(spark, ["x eau de parfum intense", "cologne", "x"], X.concentration) == ["EDP+INT", "EDC", ""]
    assert values(spark, ["dior sauvage 100ml", "x"], lambda c: X.known_brand(c, ["Chanel", "Dior"])) == ["Dior", ""]
    assert values(spark, ["212 vip 100ml 9", "no 5 x", "x 75"], X.product_numbers) == [["212", "9"], ["5"], []]


def test_normalising(spark):
    assert values(spark, ["  عطر  أحمد 100مل! "], T.normalize_name) == ["احمد"]
    assert values(spark, ["عطر ديور 100 oud xx"], T.bare) == ["ديور oud xx"]
    assert values(spark, ["كريد"], T.skeleton) == ["كرد"]
    assert values(spark, ["a b c"], lambda c: T.replace_words(c, {"a": "b", "b": "c", "b c": "d"})) == ["b d"]
    assert values(spark, ["ﬁ é", None], T.compatible) == ["fi é", None]
    assert values(spark, ["see https://x.y #tag now"], T.without_links) == ["see   now"]


def test_prices(spark):
    assert values(spark, ["1,299.50 SAR", "none", None], P.price_or_null) == [1299.5, None, None]
    assert values(spark, ["<b>10</b> then ٢٥", "x"], P.last_price) == [25.0, 0.0]
    assert values(spark, ["100.0", "0", "nan", "A1"], P.product_id) == ["100", "", "", "A1"]
    pairs = [(120.0, 100.0), (100.0, 120.0), (102.0, 100.0), (0.0, 100.0), (None, 5.0)]
    df = spark.createDataFrame(pairs, "a double, b double").select(P.decision("a", "b").alias("d")).select("d.*")
    assert [r.action for r in df.collect()] == ["raise", "lower", "approve", "review", "review"]
    limits = spark.createDataFrame([(500.0,), (150.0,), (50.0,)], "a double").select(P.threshold("a", "a"))
    assert [r[0] for r in limits.collect()] == [25.0, 5.0, 5.0]


def test_keys(spark):
    urls = ["https://www.X.com/A/b/?q=1#z", "http://x.com/", "", None]
    assert values(spark, urls, K.canonical_url) == ["x.com/A/b", "x.com", "", ""]
    assert values(spark, ["https://x.com/oud/p123?x"], K.url_id) == ["123"]


def test_page_fields(spark):
    ld = '<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"Oud","offers":{"price":"12.5","priceCurrency":"SAR"}}]}</script>'
    og = '<meta property="og:title" content="Rose"><meta property="product:price:amount" content="1,250">'
    usd = '<title> T </title><script type="application/ld+json">{"@type":"Product","offers":[{"price":3,"priceCurrency":"USD"}]}</script>'
    got = values(spark, [ld, og, usd, None, "{"], product)
    assert [(r.name, r.price) for r in got] == [("Oud", 12.5), ("Rose", 1250.0), ("T", None), (None, None), (None, None)]


words = st.text("ab c", max_size=12)


@settings(max_examples=150, deadline=None)
@given(words, words)
def test_kernels_are_bounded_and_symmetric(a, b):
    for kernel in (S.ratio, S.token_sort, S.token_set, S.partial, S.weighted):
        assert 0 <= kernel(a, b) <= 100 + 1e-9
        assert kernel(a, b) == pytest.approx(kernel(b, a))
    assert S.ratio(a, a) == 100
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b):
            last, row[k + 1] = row[k + 1], last + 1 if x == y else max(row[k + 1], row[k])
    assert S._common(a, b) == row[-1]


def test_token_set_rules(spark):
    assert S.token_set("oud royal", "royal oud intense") == 100
    assert S.token_set("", "x") == 0
    df = spark.createDataFrame([("a b", "b a"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(S.similarity("a", "b", "token_sort")).collect()] == [100.0, 0.0]
