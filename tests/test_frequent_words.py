"""A word that very many names of a brand hold must not keep an offer from its product: alike beside it without a near word."""

from tamarisk.operators import matching
from tamarisk.plans import analysis

#: 300 names of one brand; the offer's is one of them but for two letters.
OURS = [(i, f"velvet {chr(97 + i // 26)}{chr(97 + i % 26)}noir{i % 7}z 50ml", "Dior") for i in range(299)] + [(999, "velvet xbcdxf 50ml", "Dior")]
THEIRS = [(1, "velvet abcdef 50ml", "Dior", 90.0, "s"), (2, "velvet abcdef 50ml", "Dior", 80.0, "t")]


def tables(spark):
    return (
        spark.createDataFrame(OURS, "our_id int, name string, brand string"),
        spark.createDataFrame(THEIRS, "offer_id int, name string, brand string, price double, store string"),
    )


def test_offers_are_resolved_by_names_of_a_frequent_word(spark):
    ours, theirs = (matching.featured(x, "name", brand="brand") for x in tables(spark))
    got = matching.resolve(theirs, ours).collect()
    assert {(r.offer_id, r.our_id, r.ownership) for r in got} == {(1, 999, "owned"), (2, 999, "owned")}


def test_what_we_own_by_a_frequent_word_is_not_missing(spark):
    ours, theirs = tables(spark)
    assert analysis.missing_analysis(ours, theirs).count() == 0
    assert [tuple(r) for r in analysis.accounting(ours, theirs).collect()] == [("owned", 2)]
