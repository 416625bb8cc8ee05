import pytest
from pyspark.sql import functions as F

from tamarisk.operators.brand_index import with_brand
from tamarisk.operators import aggregates, export, filters, history, matching, merge, projections, routing
from tamarisk.sources import files


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_decisions_are_routed_and_balanced(spark):
    names = ["🔴 سعر أعلى", "🟢 سعر أقل", "✅ موافق", "⚠️ x", "🔍 y", "⚪ z", "", None, "?"]
    df = spark.createDataFrame([(x,) for x in names], "decision string")
    counts = {r.section: r.n for r in aggregates.count_by(routing.route(df), "section").collect()}
    assert counts == {"price_raise": 1, "price_lower": 1, "approved": 1, "review": 2, "excluded": 4}
    assert routing.assert_balanced(df).count() == 9
    both = df.union(spark.createDataFrame([("🔴 سعر أقل",)], "decision string"))
    with pytest.raises(routing.DataLossError):
        routing.assert_balanced(both)


def test_missing_rows_that_are_priced_go(spark):
    missing = spark.createDataFrame([("  Oud Royal ",), ("rose",), ("❌ bad",)], "name string")
    priced = spark.createDataFrame([("oud royal",), ("❌ bad",)], "name string")
    assert rows(routing.without_priced(missing, priced, "name", "name"), "name") == [("rose",), ("❌ bad",)]
    assert routing.overlap(missing, priced, "name", "name").first().n_both == 1


def test_filter_chain(spark):
    cases = [("sample 1ml", 50.0, "class"), ("gift set 100ml", 50.0, "set"), ("oud royal 100ml", 5.0, "price"), ("oud", 50.0, "short"),
             ("oud royal long", 50.0, "nosize"), ("oud royal 5ml", 50.0, "mini"), ("oud royal 100ml", 50.0, None)]
    df = spark.createDataFrame(cases, "name string, price double, want string")
    assert df.withColumn("got", filters.missing_reason("name", "price")).where("not (got <=> want)").count() == 0
    kept, rejected = filters.split_by(df, filters.missing_reason("name", "price"))
    assert kept.count() + rejected.count() == len(cases)
    found = filters.search(df, text="ROYAL", columns=("name",), price_min=10)
    assert found.count() == 3
    assert df.where(filters.is_phantom(F.lit("P12_x"), F.lit(0))).count() == len(cases)


def test_upserts_can_be_replayed(spark):
    old = spark.createDataFrame([("a", 1.0, "img"), ("b", 2.0, "")], "k string, price double, image string")
    batch = spark.createDataFrame([("a", 5.0, "", 1), ("a", 6.0, "", 2), ("c", 3.0, "new", 3)], "k string, price double, image string, n int")
    once = merge.upsert(old, batch, ["k"], "n", ["price"], ["image"])
    assert rows(once, "k") == [("a", 6.0, "img"), ("b", 2.0, ""), ("c", 3.0, "new")]
    assert rows(merge.upsert(once, batch, ["k"], "n", ["price"], ["image"]), "k") == rows(once, "k")


def test_crawl_state_gives_up_after_failures(spark):
    old = spark.createDataFrame([("u", "1", 2), ("v", "1", 0), ("w", "1", 1)], "url string, lastmod string, failures int")
    entries = spark.createDataFrame([("u", "2"), ("v", "2"), ("w", "2"), ("x", "2")], "url string, lastmod string")
    outcomes = spark.createDataFrame([("u", False), ("v", False), ("w", True)], "url string, ok boolean")
    got = rows(merge.crawl_state(old, entries, outcomes), "url")
    assert got == [("u", "2", 0), ("v", "", 1), ("w", "2", 0), ("x", "2", 0)]


def test_ledger_folds_and_sweeps(spark):
    log = [("a", "INGESTED", None, None, 1), ("a", "MATCHED_AUTO", None, 90.0, 2), ("b", "INGESTED", None, None, 1), ("a", "REVIEW", "r", None, 3)]
    df = spark.createDataFrame(log, "comp_id string, state string, reason_code string, last_score double, n int")
    want = [("a", "REVIEW", "r", 90.0), ("b", "REJECTED_LOW_CONFIDENCE", "not_selected_in_batch", None)]
    assert rows(merge.ledger(df, ["n"]), "comp_id") == want


def test_latest_by_url_keeps_blank_urls(spark):
    df = spark.createDataFrame([("https://x.com/a/", 1), ("http://x.com/a", 2), ("", 3), (None, 4)], "url string, n int")
    assert sorted(r.n for r in history.latest_by_url(df, "url", "n").collect()) == [2, 3, 4]


def test_matching_keeps_every_offer(spark):
    ours = spark.createDataFrame([(1, "Dior Sauvage Elixir 100ml", "Dior"), (2, "Creed Aventus 50ml", "Creed")], "our_id int, name string, brand string")
    theirs = [(1, "dior sauvage elixir 100 ml"), (2, "creed aventus 120ml"), (3, "unknown thing"), (4, ""), (5, None), (1, "dior sauvage elixir 100 ml")]
    theirs = spark.createDataFrame(theirs, "offer_id int, name string")
    got = matching.resolve(matching.featured(theirs, "name", ["Dior", "Creed"]), matching.featured(ours, "name", ["Dior", "Creed"]))
    assert rows(got.select("offer_id", "ownership", "reason", "our_id"), "offer_id") == [
        (1, "owned", "", 1), (1, "owned", "", 1), (2, "review", "size", 2), (3, "missing", "", None), (4, "missing", "", None), (5, "missing", "", None),
    ]


def test_payloads_and_posting(spark):
    rows_ = [("100.0", "oud", 120.0, 99.0, "s"), ("0", "x", 1.0, 1.0, "s"), ("5", "", 1.0, 1.0, "s"), ("6", "rose", 10.0, 0.0, "")]
    df = spark.createDataFrame(rows_, "product_id string, name string, our_price double, comp_price double, store string")
    sent = export.payloads(df, "lower")
    assert {r.product_id: r.payload for r in sent.collect()} == {
        "100": '{"product_id":"100","name":"oud","price":98.0,"competitor":"s"}',
        "6": '{"product_id":"6","name":"rose","price":10.0}',
    }
    log = export.send(export.batches(sent, 1), lambda products: "rose" not in products[0]).toPandas()
    assert log.n.sum() == 2 and sorted(log.attempts) == [1, 3] and log.sent.sum() == 1


def test_files(spark, tmp_path):
    (tmp_path / "meta.csv").write_text("بيانات المنتج,,\nNo.,أسم المنتج,سعر المنتج\n1,oud,12.5\n2,,3\n3,rose,x\n", encoding="utf-8")
    got = files.load_catalogue(files.read_csv(spark, str(tmp_path / "meta.csv")))
    assert rows(got.select("product_id", "name", "price"), "product_id") == [("1", "oud", 12.5), ("3", "rose", 0.0)]
    # Lines that are too long or short, and blank first cells, are rows like others.
    (tmp_path / "odd.csv").write_text("بيانات المنتج,,\nNo.,أسم المنتج,سعر المنتج\n4,d,8,9,10\n,b,6\n7\n", encoding="utf-8")
    odd = files.read_csv(spark, str(tmp_path / "odd.csv"), bad="line")
    assert sorted(((r["No."], r["أسم المنتج"], r["line"] is not None) for r in odd.collect()), key=str) == [("4", "d", True), ("7", None, True), (None, "b", False)]
    (tmp_path / "old.csv").write_bytes("المنتج,السعر\nعطر,5\n".encode("windows-1256"))
    assert files.encoding_of(spark, str(tmp_path / "old.csv")) == "windows-1256" and files.encoding_of(spark, str(tmp_path / "odd.csv")) == "UTF-8"
    assert files.read_csv(spark, str(tmp_path / "old.csv"), encoding=None).first()["المنتج"] == "عطر"
    (tmp_path / "twice.csv").write_text("a,b\nproduct_name,price\noud,5\n", encoding="utf-8")
    assert rows(files.promoted(files.read_csv(spark, str(tmp_path / "twice.csv"))).select("product_name", "price"), "price") == [("oud", "5")]
    (tmp_path / "shop.csv").write_text('name,price,link\noud,"1,200",https://x.com/p/1\n', encoding="utf-8")
    raw = files.read_csv(spark, str(tmp_path / "shop.csv"))
    assert rows(files.load_competitor(raw).select("store", "name", "price"), "name") == [("shop", "oud", 1200.0)]
    assert files.infer_roles(raw)["link"] == "link"
    assert files.read_table(spark, str(tmp_path / "none.csv"), ["a", "b"]).count() == 0
    pasted = spark.createDataFrame([("a | b\n\nc | d",)], "text string")
    assert [r.cells for r in files.parse_pasted(pasted).collect()] == [["a", "b"], ["c", "d"]]
    (tmp_path / "map.xml").write_text('<urlset><url><loc>https://x.com/p/12345</loc><lastmod>2024-01-01</lastmod></url><url><loc>https://x.com/blog/1</loc></url></urlset>')
    assert [r.url for r in files.read_sitemap(spark, str(tmp_path / "map.xml")).collect()] == ["https://x.com/p/12345"]


def test_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([("a", 1), ("b", 2)], "store string, n int")
    export.replace_partitions(one, path, "store")
    export.replace_partitions(spark.createDataFrame([("a", 9)], "store string, n int"), path, "store")
    assert rows(spark.read.parquet(path).select("store", "n"), "store") == [("a", 9), ("b", 2)]
    export.write_csv(spark.createDataFrame([([1, 2],)], "x array<int>"), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().x == "[1,2]"


def test_projections(spark):
    raw = spark.createDataFrame([("oud", "12", "/p/1", "s"), ("x", "5", "", "s"), ("rose", "", "https://y.z/p", "s")], "title string, price string, link string, store string")
    got = projections.scraped_row(raw, "https://shop.com/")
    assert [tuple(r)[:3] + (r.url,) for r in got.collect()] == [("s", "oud", 12.0, "https://shop.com/p/1")]
    df = spark.createDataFrame([("oud 50ml", ""), ("rose 10ml", "kept")], "name string, agg_name string")
    full = projections.with_features(df.drop("agg_name"), "name")
    assert rows(projections.fill_features(full.withColumn("agg_name", F.lit("")), "name").select("agg_name", "size_ml"), "agg_name") == [("oud", 50.0), ("rose", 10.0)]
    assert projections.rename_present(df, {"name": "title", "none": "x"}).columns == ["title", "agg_name"]
    twins = spark.createDataFrame([("a", "b", 1.0, 10.0, "green")] * 2 + [("c", "b", 1.0, 10.0, "review")], "name string, brand string, size_ml double, price double, confidence string")
    skus = sorted(r.sku for r in projections.upload_rows(twins).collect())
    assert len(skus) == 2 and skus[1] == skus[0] + "X"
    new = projections.brand_records(spark.createDataFrame([("Dior",), (" dior ",), ("Creed",)], "brand string"), spark.createDataFrame([("CREED",)], "brand string"))
    assert [r.key for r in new.collect()] == ["dior"]


def test_lines_and_variants(spark):
    from tamarisk.functions import features

    df = spark.createDataFrame([("Dior Sauvage Elixir 100ml for men", "Dior", "dior sauvage")], "a string, brand string, b string")
    variants = {"elixir": ("elixir", "اكسير"), "sport": ("sport",)}
    row = df.select(features.product_line("a", "brand").alias("line"), features.variants_differ("a", "b", variants).alias("apart")).first()
    assert row.line == "sauvage elixir" and row.apart


def test_features_of_names(spark):
    from tamarisk.functions import features as X

    cases = [
        ("Carolina Herrera 212 VIP number two 100ml", "212,2"), ("no 5 l'eau", "5"), ("Bleu 50ml", ""), ("p19x 75", "19"), (None, ""), ("رقم 9 عطر", "9"),
    ]
    df = spark.createDataFrame(cases, "name string, want string")
    for r in df.select("want", X.product_numbers("name").alias("n")).collect():
        assert set(r.n) == set(filter(None, r.want.split(","))), r
    kinds = spark.createDataFrame([("استشوار شعر", "other"), ("عطر ديور تستر", "tester"), ("hand cream", "other"), ("oud 50ml", "retail"), ("بخاخ شعر", "hair_mist")], "name string, want string")
    assert all(r.want == r.c for r in kinds.select("want", X.product_class("name").alias("c")).collect())
    shop = spark.createDataFrame([("Lipstick red", "💄 تجميل"), ("عود ملكي", "🌸 عطور"), ("شامبو", "🧴 عناية"), ("box", "📦 أخرى"), (None, "📦 أخرى")], "name string, want string")
    assert all(r.want == r.c for r in shop.select("want", X.category("name").alias("c")).collect())
    named = spark.createDataFrame([("diorr sauvage 100ml", "Dior"), ("eau by Creed", "Creed"), ("xx yy", ""), ("", "")], "name string, want string")
    table = spark.createDataFrame([(0, "Dior"), (1, "Creed")], "ordinal int, brand string")
    assert all(r.want == r.found_brand for r in with_brand(named, "name", table).collect())


def _plain_match(o, t):
    """One pair by the rules, without Spark: None if refused, else the score."""
    from tamarisk.functions import similarity as S

    if o["brand_key"] != t["brand_key"] or o["variant_key"] != t["variant_key"] or o["in_set"] != t["in_set"] or t["sample"]:
        return None
    if (o["size_ml"] > 0) != (t["size_ml"] > 0) or abs(o["size_ml"] - t["size_ml"]) > 2:
        return None
    if any(o[c] and t[c] and o[c] != t[c] for c in ("kind", "gender_key")) or o["numbers"] and t["numbers"] and o["numbers"] != t["numbers"]:
        return None
    if S.token_set(o["agg"], t["agg"]) < 45 or set(o["required"]) - set(t["required"]):
        return None
    base = S.blended(o["agg"], t["agg"]) + 10
    if o["line"] and t["line"]:
        line, n, m = S.token_sort(o["line"], t["line"]), len(o["line"].split()), len(t["line"].split())
        if line < 60 or line < 70 and min(n, m) < 0.5 * max(n, m):
            return None
        base -= 35 if line < 75 else 15 if line < 88 else 0
    else:
        base -= 20
    if o["size_ml"] > 0:
        base += 10 if o["size_ml"] == t["size_ml"] else -5
    if o["amount"] > 50 and t["amount"] > 0 and max(o["amount"] / t["amount"], t["amount"] / o["amount"]) > 4:
        base -= 45
    base -= 15 if o["gender_key"] != t["gender_key"] else 0
    score = round(max(0.0, min(100.0, base)), 1)
    return score if score >= 60 else None


def test_brand_matching_is_that_of_brute_force(spark):
    import random

    from tamarisk.operators import brand_matching as B
    from tamarisk.plans import analysis

    rnd = random.Random(3)
    lines, kinds, genders = ["sauvage", "hero", "london", "bloom night", "oud wood", "noir"], ["edp", "edt", "", "elixir"], ["for men", "for women", ""]
    name = lambda: " ".join(filter(None, (rnd.choice(lines), rnd.choice(["sport", "", "", "intense"]), rnd.choice(kinds), rnd.choice(["50ml", "100ml", "101ml", ""]), rnd.choice(genders))))
    ours = [(i, name(), rnd.choice(["Dior", "Gucci", ""]), rnd.choice([60.0, 300.0])) for i in range(60)]
    theirs = [(i, name(), rnd.choice(["Dior", "Gucci", ""]), rnd.choice(["a", "b"]), rnd.choice([50.0, 70.0, 0.0, 290.0])) for i in range(600)]
    variants = [("sport", "سبورت"), ("night",)]
    x = B.indexed(spark.createDataFrame(ours, "our_id int, name string, brand string, price double"), variants=variants)
    y = B.indexed(spark.createDataFrame(theirs, "offer_id int, name string, brand string, store string, price double"), variants=variants)
    got = {r.our_id: r for r in B.matched(x, y).collect()}
    assert len(got) == len(ours)
    left, right = x.collect(), y.collect()
    some = 0
    for o in left:
        scores = [s for t in right if t.brand_key and (s := _plain_match(o.asDict(), t.asDict())) is not None and _same_class(o, t)]
        row = got[o.our_id]
        if row.reason is None:
            assert row.score == pytest.approx(max(scores, default=0.0), abs=0.11), (o.name, row.score, max(scores, default=0.0))
            some += bool(scores)
    assert some > 10
    priced = analysis.matched_pricing(x, y).toPandas()
    assert sorted(priced.our_id) == list(range(60)) and set(priced.section) <= {"price_raise", "price_lower", "approved", "review", "excluded"}
    challenged = B.challenged(x, y).toPandas()
    assert sorted(challenged.offer_id) == list(range(600)) and set(challenged.verdict) <= {"confirmed", "review", "none"}


def _same_class(o, t):
    from tamarisk.functions import vocabulary as V

    if o["class"] != t["class"] and (o["class"] in V.NOT_PERFUME or t["class"] in V.NOT_PERFUME or (o["class"] == "tester") != (t["class"] == "tester")):
        return False
    return not (t.care and o["class"] in ("retail", "tester"))


def test_reanalysis_and_reverse_match(spark):
    ours = matching.featured(spark.createDataFrame([(1, "Dior Sauvage 100ml", "Dior"), (2, "Creed Aventus 50ml", "Creed")], "our_id int, name string, brand string"), "name", brand="brand")
    rows_ = [(1, "dior sauvage 100ml", "match"), (2, "creed avantus", "match"), (3, "", "missing"), (4, "nothing alike", "missing")]
    new = matching.featured(spark.createDataFrame(rows_, "offer_id int, name string, old_decision string"), "name")
    got = {r.offer_id: (r.decision, r.changed) for r in matching.reanalysed(new, ours).collect()}
    assert got[1] == ("match", False) and got[3] == ("invalid", True) and got[4] == ("missing", False)
    back = {r.offer_id: r.our_id for r in matching.reverse_match(new, ours).collect()}
    assert back[1] == 1 and back[4] is None


def test_audits_json_and_gates(spark):
    from tamarisk.functions.html import lenient_json
    from tamarisk.operators import routing

    df = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 5, "c": 7})], "s map<string,long>, r map<string,long>")
    assert df.select(routing.merged_audit(F.col("s"), F.col("r")).alias("m")).first().m == {"a": 1, "b": 5, "c": 7}
    texts = ['```json\n{"a": 1}\n```', 'so: [1, 2] ok', "none", None, '{"x": {"y": 1}} tail']
    got = [r.j for r in spark.createDataFrame([(x,) for x in texts], "t string").select(lenient_json("t").alias("j")).collect()]
    assert got == ['{"a": 1}', "[1, 2]", None, None, '{"x": {"y": 1}}']
    log = spark.createDataFrame([(i, "INGESTED" if i % 2 else "MATCHED", i) for i in range(60)], "id int, state string, ingested_at int")
    assert [r.id for r in filters.stuck(log).collect()] == list(range(1, 41, 2))


def test_doubtful_pairs(spark):
    df = spark.createDataFrame([("a", "b", 90.0), ("c", "d", 90.0), ("e", "f", 10.0)], "a string, b string, score double")
    said = lambda x, y: {"a": False, "e": True}.get(x)
    assert rows(matching.adjudicate(df, said).select("a", "verdict"), "a") == [("a", False), ("c", True), ("e", True)]
    assert rows(matching.adjudicate(df).select("a", "verdict"), "a") == [("a", True), ("c", True), ("e", False)]


def test_results_are_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3).toDF("n")

    for _ in range(2):
        assert export.cached(spark, str(tmp_path), "v1-3", make).count() == 3
    assert len(made) == 1
