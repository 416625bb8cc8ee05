"""Rows that repeat each other must not multiply pairs, nor expressions of one row each other: the results stay, the work doesn't grow."""

from tamarisk import queries as Q
from tamarisk.functions.html import META, product
from tamarisk.operators import brand_matching as B

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_equal_products_are_matched_once(spark, monkeypatch):
    met = []

    def scored(ours, theirs, pairs, least=60.0):
        met.append((ours.count(), theirs.count()))
        return plain(ours, theirs, pairs, least)

    plain = B.scored
    monkeypatch.setattr(B, "scored", scored)
    ours = [(1, "Sauvage edp 100ml", 80.0), (2, "Sauvage edp 100ml", 700.0), (3, "Hero edt 50ml", 80.0), (4, "Gift set hero 50ml", 80.0)]
    theirs = [(1, "sauvage edp 100ml", "a", 70.0), (2, "sauvage edp 101ml", "a", 60.0), (3, "sauvage edp 100ml", "b", 75.0), (4, "hero edt 50ml", "b", 0.0)]

    def run(times):
        x = [(i + 10 * k, n, "Dior", p) for k in range(times) for i, n, p in ours]
        y = [(i + 10 * k, n, "Dior", s, p) for k in range(times) for i, n, s, p in theirs]
        x = B.indexed(spark.createDataFrame(x, "our_id int, name string, brand string, price double"))
        y = B.indexed(spark.createDataFrame(y, "offer_id int, name string, brand string, store string, price double"))
        return {r.our_id: tuple(r)[1:] for r in B.matched(x, y).collect()}

    once, often = run(1), run(12)
    assert once[1][1] > 80
    assert often == {i + 10 * k: row for k in range(12) for i, row in once.items()}
    assert met[0] == met[1] == (3, 4)


def test_tags_of_a_page_are_searched_once(spark):
    page = '<meta property="og:title" content=""><META content="Rose" Name="Twitter:Title"><meta property="product:sale_price:amount" content="0">'
    page += '<meta property="product:price:amount" content="1,250.50"><meta name="description" content="a &gt; b > c">'
    pages = [(1, page), (2, page + '<meta property="og:price:currency" content="usd">'), (3, "<h1>Only <b>this</b></h1>"), (4, None)]
    df = spark.createDataFrame(pages, "id int, html string").select("id", product("html").alias("p")).select("id", "p.*")
    got = {r.id: (r.name, r.description, r.price, r.currency) for r in df.collect()}
    assert got == {1: ("Rose", "a &gt; b > c", 1250.5, "SAR"), 2: ("Rose", "a &gt; b > c", None, None), 3: ("Only this", None, None, None), 4: (None,) * 4}
    # Two patterns for each tag, and two for headings.
    assert plan_of(df).count("regexp_extract(") <= 2 * sum(map(len, META.values())) + 2


def test_reasons_are_found_once_for_a_name(spark):
    assert "Aggregate" in plan_of(Q.missing_reasons(spark, SF))


def test_names_are_looked_at_once(spark):
    from tamarisk.operators import matching

    rows = spark.createDataFrame([(1, "Rose 50ml", "Dior")] * 3, "offer_id int, name string, brand string")
    found = matching.featured(rows, "name", brand="brand")
    # The names come from storage: only the rows themselves are still to be computed.
    assert "Aggregate" not in plan_of(found) and found.count() == 3


def test_offers_meet_products_not_rows(spark, monkeypatch):
    """Rows of one product that differ in price alone: an offer is met once, and by each row only where their prices tell."""
    met = []

    def best(found, n=3):
        met.append(found.count())
        return plain(found, n)

    plain = B.best_per_store
    monkeypatch.setattr(B, "best_per_store", best)
    ours = [(i, "Sauvage edp 100ml", "Dior", 900.0 + i) for i in range(20)]
    # Between a fourth of 919 and of 900 an offer is far from some of the rows.
    theirs = [(i, "sauvage edp 100ml", "Dior", f"s{i}", 800.0 + i) for i in range(30)] + [(90, "sauvage edp 100ml", "Dior", "t", 227.6)]
    x = B.indexed(spark.createDataFrame(ours, "our_id int, name string, brand string, price double"))
    y = B.indexed(spark.createDataFrame(theirs, "offer_id int, name string, brand string, store string, price double"))
    got = {r.our_id: (r.candidates, r.comp_price, r.store) for r in B.matched(x, y).collect()}
    assert {p for n, p, _ in got.values()} == {227.6} and {n for n, _, _ in got.values()} == {31} and len(got) == 20
    assert met[0] <= 30 + 20
    stores = {r.our_id: {o.store: o.score for o in r.offers} for r in B.matched(x, y).collect()}
    assert all(stores[i]["s0"] > stores[i]["t"] if 900 + i > 4 * 227.6 else stores[i]["s0"] == stores[i]["t"] for i in range(20))
