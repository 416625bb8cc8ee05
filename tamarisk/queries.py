"""Registered queries of the price-intelligence operators over the star-schema tables, with their SQL equivalents.

Each query is added with ``@query(sql)``; without SQL it is tested against fixtures. All run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import features as X
from .functions import keys as K
from .functions import pricing as P
from .functions import text as T
from .functions.html import lenient_json, product, tag_text
from .functions.similarity import jaccard, similarity
from .functions.synonyms import replaced, term_table
from .operators import aggregates as A
from .operators import brand_index
from .operators import brand_matching as B
from .operators import export as E
from .operators import filters as Fl
from .operators import history as H
from .operators import matching as M
from .operators import merge as U
from .operators import projections as J
from .operators import routing as R
from .plans import analysis
from .session import shared_dir, ship
from .sources import files as S
from .sources import workbook as W
from .sources.tables import catalogue, events, offers, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
AS_OF = "1998-09-02"

OFFERS = """offers AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, s_name AS store, l_partkey AS product_id, l_extendedprice / l_quantity AS price,
         l_discount AS discount, CAST(l_shipdate AS DATE) AS seen, p_brand AS brand, p_name AS name
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey)"""
BEST = OFFERS + """, best AS (
  SELECT product_id, min(price) AS comp_price, count(*) AS offer_count FROM offers WHERE price > 0 GROUP BY 1)"""
PRICED = BEST + """, both_prices AS (
  SELECT p_partkey AS our_id, p_retailprice AS ours, comp_price, (p_retailprice + comp_price) / 2 AS mean
  FROM part LEFT JOIN best ON p_partkey = product_id), limits AS (
  SELECT *, round(ours::DECIMAL(18, 4) - comp_price::DECIMAL(18, 4), 2)::DOUBLE AS diff,
    CASE WHEN mean >= 300 THEN mean * 0.05 ELSE 5.0 END AS threshold FROM both_prices), priced AS (
  SELECT our_id, ours AS our_price, comp_price, coalesce(diff, 0.0) AS diff,
    CASE WHEN comp_price IS NULL THEN 'review' WHEN diff > threshold THEN 'raise' WHEN diff < -threshold THEN 'lower'
         ELSE 'approve' END AS action FROM limits)"""


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return add


# Pricing and routing.


@query(
    f"""WITH {PRICED} SELECT our_id, our_price, comp_price, diff AS diff_ours_minus_comp, action,
    CASE action WHEN 'raise' THEN 'price_raise' WHEN 'lower' THEN 'price_lower' WHEN 'approve' THEN 'approved' ELSE 'review' END
    AS section FROM priced"""
)
def pricing_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = analysis.pricing_analysis(catalogue(spark, d), offers(spark, d))
    return rows.select("our_id", "our_price", "comp_price", "diff_ours_minus_comp", "action", "section")


@query(
    f"""WITH {PRICED} SELECT CASE action WHEN 'raise' THEN 'price_raise' WHEN 'lower' THEN 'price_lower' WHEN 'approve' THEN
    'approved' ELSE 'review' END AS section, count(*) AS n FROM priced GROUP BY 1"""
)
def section_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.count_by(R.route(analysis.priced(catalogue(spark, d), offers(spark, d))), "section")


@query(f"WITH {PRICED} SELECT count(*) AS n_in, count(*) AS n_out, 0 AS gap FROM priced")
def section_balance(spark: SparkSession, d: str) -> DataFrame:
    return R.balance(analysis.priced(catalogue(spark, d), offers(spark, d)))


@query(
    f"""WITH {PRICED}, r AS (SELECT our_id, our_price, comp_price, CASE WHEN our_price - comp_price > 1 AND
    greatest(round((comp_price - 1)::DECIMAL(18, 4), 2)::DOUBLE, 1.0) < our_price THEN 'lower' WHEN comp_price - our_price > 1 THEN 'raise' ELSE 'keep' END
    AS action FROM priced) SELECT count(*) AS total, count(*) FILTER (action = 'lower') AS lower,
    count(*) FILTER (action = 'raise') AS raise, count(*) FILTER (action = 'keep') AS keep FROM r"""
)
def automation_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = analysis.priced(catalogue(spark, d), offers(spark, d))
    rows = rows.withColumn("r", P.rule("our_price", "comp_price", F.lit(100.0)))
    return A.automation_summary(rows.select("our_price", "r.*")).select("total", "lower", "raise", "keep")


@query(
    f"""WITH {BEST} SELECT p_partkey AS our_id, CASE WHEN comp_price > 0 THEN round((comp_price - 1)::DECIMAL(18, 4), 2)::DOUBLE ELSE 0.0 END AS undercut,
    CASE WHEN comp_price > 0 THEN round(comp_price * 1.15, 0) ELSE 0.0 END AS with_margin
    FROM part LEFT JOIN best ON p_partkey = product_id"""
)
def suggested_prices(spark: SparkSession, d: str) -> DataFrame:
    rows = analysis.priced(catalogue(spark, d), offers(spark, d))
    return rows.select("our_id", P.undercut("comp_price").alias("undercut"), P.with_margin("comp_price", 15).alias("with_margin"))


@query(
    f"""WITH {PRICED} SELECT our_id, CASE WHEN action IN ('raise', 'lower') THEN 'raise_or_lower' ELSE action END AS kind
    FROM priced WHERE comp_price IS NOT NULL AND our_price BETWEEN 900 AND 1200"""
)
def filtered_decisions(spark: SparkSession, d: str) -> DataFrame:
    rows = analysis.priced(catalogue(spark, d), offers(spark, d)).withColumn("price", F.col("our_price"))
    rows = Fl.search(rows.where("comp_price is not null"), price_min=900, price_max=1200)
    kind = F.when(F.col("action").isin("raise", "lower"), "raise_or_lower").otherwise(F.col("action"))
    return rows.select("our_id", kind.alias("kind"))


@query(
    f"""WITH {PRICED} SELECT CAST(our_id AS VARCHAR) AS product_id, CASE WHEN comp_price > 0
    THEN greatest(round((comp_price - 1)::DECIMAL(18, 4), 2)::DOUBLE, 0.0) ELSE our_price END AS price FROM priced WHERE action = 'raise' AND our_id <> 0"""
)
def raise_payloads(spark: SparkSession, d: str) -> DataFrame:
    rows = analysis.priced(catalogue(spark, d), offers(spark, d)).where("action = 'raise'")
    sent = E.payloads(rows.withColumn("product_id", F.col("our_id")), "raise")
    return sent.select("product_id", F.get_json_object("payload", "$.price").cast("double").alias("price"))


# Aggregates.


@query(
    f"""WITH {OFFERS} SELECT store, count(*) AS total, round(avg(price), 0) AS avg_price, round(min(price), 0) AS min_price,
    round(max(price), 0) AS max_price, count(*) FILTER (discount > 0) AS discounted,
    count(*) FILTER (seen >= DATE '{AS_OF}' - 7) AS new_products FROM offers GROUP BY store"""
)
def store_comparison(spark: SparkSession, d: str) -> DataFrame:
    return A.compare_stores(offers(spark, d), AS_OF)


@query(
    f"""WITH {OFFERS} SELECT count(*) AS offers, count(DISTINCT store) AS stores, count(DISTINCT brand) AS brands,
    count(DISTINCT product_id) AS products, count(DISTINCT product_id) FILTER (discount > 0) AS discounted_products,
    round(avg(price), 2) AS avg_price FROM offers"""
)
def offer_statistics(spark: SparkSession, d: str) -> DataFrame:
    return A.statistics(offers(spark, d))


@query(
    f"""WITH {OFFERS}, e AS (SELECT product_id, store, min(price) FILTER (price > 0) AS price, count(*) AS n FROM offers GROUP BY 1, 2)
    SELECT product_id, count(*) AS store_count, sum(n)::BIGINT AS offer_count, min(price) AS min_price, max(price) AS max_price,
    ((2 * CAST(sum(price::DECIMAL(18, 4)) * 10000 AS HUGEINT) + 1000 * count(price)) // (2000 * count(price)))::DOUBLE / 10 AS avg_price, string_agg(store, '، ' ORDER BY price, store) AS stores,
    greatest(0.0, round((min(price) - 1)::DECIMAL(18, 4), 2)::DOUBLE) AS suggested FROM e GROUP BY 1"""
)
def merged_offers(spark: SparkSession, d: str) -> DataFrame:
    return A.merge_offers(offers(spark, d), ["product_id"]).drop("details")


@query(
    """SELECT p_brand AS brand, count(*) AS n, round(max(p_retailprice), 2) AS top FROM part GROUP BY ROLLUP (p_brand)"""
)
def brand_totals(spark: SparkSession, d: str) -> DataFrame:
    return A.with_total(catalogue(spark, d), "brand", F.count("*").alias("n"), F.round(F.max("our_price"), 2).alias("top"))


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.count_by(events(spark, d), "status")


@query(
    f"""WITH {OFFERS}, c AS (SELECT name, arg_min(struct_pack(id := id, product_id := product_id, price := price), struct_pack(p := price, i := id, x := product_id)) AS r
    FROM offers GROUP BY 1) SELECT name, r.price AS price FROM c"""
)
def cheapest_by_name(spark: SparkSession, d: str) -> DataFrame:
    return A.cheapest(offers(spark, d), "name", "id").select("name", "price")


@query(
    """SELECT value, place FROM (SELECT DISTINCT trim(p_brand) AS value, 1 AS place FROM part WHERE trim(p_brand) <> ''
    UNION ALL SELECT 'الكل', 0)"""
)
def brand_options(spark: SparkSession, d: str) -> DataFrame:
    return A.options(catalogue(spark, d), "brand")


@query(
    """SELECT DISTINCT p_type AS value FROM part WHERE length(p_type) BETWEEN 2 AND 50 AND lower(p_type) NOT IN
    (SELECT lower(p_type) FROM part WHERE p_size < 5)"""
)
def new_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    c = catalogue(spark, d)
    return A.vocabulary(c, "kind", c.where("size < 5").select(F.col("kind").alias("value")))


@query(
    f"""WITH {OFFERS}, m AS (SELECT product_id, count(DISTINCT store) AS n, min(price) AS price FROM offers WHERE price > 0 GROUP BY 1), s AS (
    SELECT product_id, 40.0 * n / (SELECT max(n) FROM m) + 25 + CASE WHEN price BETWEEN 100 AND 500 THEN 20 WHEN price > 500 AND price <= 1000 THEN 14
    WHEN price >= 50 AND price < 100 THEN 8 ELSE 0 END + 5 AS score FROM m)
    SELECT product_id, least(100.0, round(score, 0)) AS priority, CASE WHEN least(100.0, round(score, 0)) >= 80 THEN 'urgent'
    WHEN round(score, 0) >= 60 THEN 'high' WHEN round(score, 0) >= 40 THEN 'medium' ELSE 'low' END AS level FROM s"""
)
def missing_priority(spark: SparkSession, d: str) -> DataFrame:
    m = A.merge_offers(offers(spark, d).where("price > 0"), ["product_id"]).withColumn("price", F.col("min_price"))
    more = {"confidence": F.lit("green"), "image": F.lit(""), "brand": F.lit("x"), "category": F.lit("")}
    return A.priority(m.withColumns(more)).select("product_id", "priority", "level")


# History, windows, order.


@query(
    f"""WITH {OFFERS}, t AS (SELECT product_id, store, min(price) AS price FROM offers GROUP BY 1, 2)
    SELECT product_id, store, price, row_number() OVER (PARTITION BY product_id ORDER BY price, store)::INT AS place FROM t
    QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY price, store) <= 3"""
)
def top_offers(spark: SparkSession, d: str) -> DataFrame:
    best = offers(spark, d).groupBy("product_id", "store").agg(F.min("price").alias("price"))
    return H.top_n(best, ["product_id"], [F.col("price"), F.col("store")], 3)


@query(
    f"""WITH {OFFERS}, p AS (SELECT n.product_id, n.store, n.id AS new_id, o.id AS old_id, round(n.price - o.price, 2) AS change
    FROM offers n JOIN offers o ON n.product_id = o.product_id AND n.store = o.store AND n.id > o.id AND abs(n.price - o.price) > 0.01
    WHERE n.seen >= DATE '{AS_OF}' - 200) SELECT abs(change) AS size, count(*) AS n FROM p GROUP BY 1 ORDER BY 1 DESC LIMIT 20"""
)
def price_change_sizes(spark: SparkSession, d: str) -> DataFrame:
    history = offers(spark, d).withColumn("day", F.col("seen"))
    pairs = H.price_pairs(history, AS_OF, 200)
    return pairs.groupBy(F.abs("change").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("size")).limit(20)


@query(
    f"""WITH {OFFERS} SELECT n.product_id, n.store, n.id AS new_id, o.id AS old_id, round(n.price - o.price, 2) AS change
    FROM offers n JOIN offers o ON n.product_id = o.product_id AND n.store = o.store AND n.id > o.id AND abs(n.price - o.price) > 0.01
    WHERE n.seen >= DATE '{AS_OF}' - 200 ORDER BY abs(change) DESC, 3, 4, 1, 2 LIMIT 100"""
)
def largest_price_changes(spark: SparkSession, d: str) -> DataFrame:
    return H.price_changes(offers(spark, d).withColumn("day", F.col("seen")), AS_OF, 200)


@query(
    f"""WITH {OFFERS}, t AS (SELECT product_id, store, seen AS day, max(price) AS price FROM offers GROUP BY 1, 2, 3), c AS (
    SELECT *, lag(price) OVER (PARTITION BY product_id, store ORDER BY day) AS previous FROM t)
    SELECT product_id, store, day, price, previous, coalesce(abs(price - previous) > 0.01, true) AS changed FROM c"""
)
def daily_prices(spark: SparkSession, d: str) -> DataFrame:
    return H.daily_history(offers(spark, d).withColumn("day", F.col("seen")), "price")


@query(
    """WITH m AS (SELECT event_id, user_id, event_type, ts, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS f FROM events), i AS (
    SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT event_id, user_id, (sum(f) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS run,
    sum(f) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) >= 2 AS tripped FROM i"""
)
def failure_runs(spark: SparkSession, d: str) -> DataFrame:
    out = H.failure_runs(events(spark, d), ["user_id"], ["ts", "event_id"], F.col("status") == "error", 2)
    return out.select("event_id", "user_id", "run", "tripped")


@query("SELECT p_partkey AS our_id, p_retailprice AS our_price FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25 OFFSET 25")
def product_page(spark: SparkSession, d: str) -> DataFrame:
    rows = catalogue(spark, d).select("our_id", "our_price")
    return H.page(rows, [F.col("our_price").desc(), F.col("our_id").asc()], 2, 25)


@query(
    f"""WITH {PRICED} SELECT our_id, diff AS diff_ours_minus_comp FROM priced ORDER BY abs(diff) DESC, our_id LIMIT 20"""
)
def largest_differences(spark: SparkSession, d: str) -> DataFrame:
    rows = analysis.priced(catalogue(spark, d), offers(spark, d)).select("our_id", "diff_ours_minus_comp")
    return rows.orderBy(F.abs("diff_ours_minus_comp").desc(), "our_id").limit(20)


@query(
    """SELECT user_id, event_id, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
)
def latest_status(spark: SparkSession, d: str) -> DataFrame:
    return H.latest(events(spark, d).select("user_id", "ts", "event_id", "status"), ["user_id"], ["ts", "event_id"]).drop("ts")


# Merging and state.

@query(
    """WITH t AS (SELECT *, 0 AS turn FROM events WHERE event_id % 2 = 0 UNION ALL SELECT * REPLACE (value + 1 AS value), 1 FROM events)
    SELECT event_id, value FROM t QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY turn DESC) = 1"""
)
def merged_latest(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("event_id", "value")
    return U.merge_latest(e.where("event_id % 2 = 0"), e.withColumn("value", F.col("value") + 1), [["sku"], ["event_id"]])


@query(
    f"""WITH {OFFERS}, b AS (SELECT product_id, arg_max(price, id * 1000000.0 + price) AS price FROM offers WHERE seen >= DATE '1995-01-01' GROUP BY 1)
    SELECT p_partkey AS our_id, coalesce(b.price, p_retailprice) AS our_price, p_brand AS brand FROM part LEFT JOIN b ON p_partkey = product_id"""
)
def upserted_prices(spark: SparkSession, d: str) -> DataFrame:
    old = catalogue(spark, d).select("our_id", "our_price", "brand")
    new = offers(spark, d).where("seen >= '1995-01-01'").withColumn("at", F.col("id") * 1000000.0 + F.col("price"))
    batch = new.select(F.col("product_id").alias("our_id"), F.col("price").alias("our_price"), F.lit("").alias("brand"), "at")
    return U.upsert(old, batch, ["our_id"], "at", ["our_price"], ["brand"])


@query(
    f"""WITH {OFFERS} SELECT product_id, min(seen) AS first_seen, max(seen) AS last_seen FROM offers GROUP BY 1"""
)
def seen_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = offers(spark, d).select("product_id", F.col("seen").alias("day"))
    early = rows.where("day < '1995-01-01'").groupBy("product_id").agg(F.min("day").alias("first_seen"), F.max("day").alias("last_seen"))
    return U.seen_dates(early, rows.where("day >= '1995-01-01'"), "product_id")


@query(
    """WITH o AS (SELECT url, 'a' || page_id % 3 AS lastmod FROM pages WHERE page_id % 5 <> 0),
    n AS (SELECT url, 'a' || page_id % 2 AS lastmod FROM pages WHERE page_id % 7 <> 0)
    SELECT coalesce(n.url, o.url) AS url, coalesce(n.lastmod, o.lastmod) AS lastmod, CASE WHEN o.url IS NULL THEN 'added' WHEN n.url IS NULL
    THEN 'removed' WHEN n.lastmod <> o.lastmod THEN 'modified' ELSE 'unchanged' END AS change FROM o FULL JOIN n ON o.url = n.url"""
)
def snapshot_changes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    mod = lambda n: F.concat(F.lit("a"), (F.col("page_id") % n).cast("string")).alias("lastmod")
    return U.snapshot_diff(p.where("page_id % 5 <> 0").select("url", mod(3)), p.where("page_id % 7 <> 0").select("url", mod(2)))


@query(
    """WITH s AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
    SELECT user_id, event_id, p AS from_status, event_type AS to_status FROM s WHERE p IS DISTINCT FROM event_type"""
)
def status_transitions(spark: SparkSession, d: str) -> DataFrame:
    return U.transitions(events(spark, d), "user_id", ["ts", "event_id"]).drop("ts")


@query(
    """WITH s AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
    SELECT user_id, arg_max(p, struct_pack(t := ts, e := event_id)) AS status FROM s WHERE p IS DISTINCT FROM event_type AND p IS NOT NULL GROUP BY 1"""
)
def undone_status(spark: SparkSession, d: str) -> DataFrame:
    return U.undo_last(U.transitions(events(spark, d), "user_id", ["ts", "event_id"]), "user_id", ["ts", "event_id"])


@query(
    """WITH e AS (SELECT user_id, arg_max(CASE WHEN event_type = 'view' THEN 'INGESTED' ELSE event_type END, struct_pack(t := ts, e := event_id)) AS s
    FROM events GROUP BY 1) SELECT user_id AS comp_id, CASE WHEN s = 'INGESTED' THEN 'REJECTED_LOW_CONFIDENCE' ELSE s END AS state FROM e"""
)
def intake_ledger(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("status") == "view", "INGESTED").otherwise(F.col("status")).alias("state")
    log = events(spark, d).select(
        F.col("user_id").alias("comp_id"), state, F.lit(None).cast("string").alias("reason_code"), F.col("value").alias("last_score"), "ts", "event_id"
    )
    return U.ledger(log, ["ts", "event_id"]).select("comp_id", "state")


@query(
    """WITH q AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS product_key FROM part WHERE p_partkey % 4 = 0)
    SELECT CAST(p_partkey AS VARCHAR) AS product_key, CASE WHEN p_partkey % 4 = 0 THEN 'sent' WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size > 48)
    THEN 'ready_to_send' ELSE 'waiting_brand' END AS status FROM part"""
)
def queued_products(spark: SparkSession, d: str) -> DataFrame:
    c = catalogue(spark, d).select(F.col("our_id").cast("string").alias("product_key"), "brand", F.col("our_price").alias("price"), "size")
    queue = c.where("product_key % 4 = 0").select("product_key", "brand", "price", F.lit("sent").alias("status"))
    return U.enqueue(queue, c.drop("size"), c.where("size > 48").select("brand")).select("product_key", "status")


@query("SELECT p_partkey AS our_id, p_partkey % 10 = 3 AS is_deleted FROM part")
def soft_deleted(spark: SparkSession, d: str) -> DataFrame:
    c = catalogue(spark, d).withColumn("label", F.concat_ws(" ", "name", "our_id"))
    hidden = c.where("our_id % 10 = 3").select(F.concat(F.lit("softdel_"), F.trim("label")).alias("key"))
    return Fl.soft_deleted(c, hidden, "label").select("our_id", "is_deleted")


@query(
    """SELECT p_partkey AS our_id, CASE WHEN p_partkey % 6 = 0 THEN 1.5 ELSE p_retailprice END AS our_price, p_brand AS brand FROM part"""
)
def overlaid_prices(spark: SparkSession, d: str) -> DataFrame:
    c = catalogue(spark, d).select("our_id", "our_price", "brand")
    o = c.where("our_id % 3 = 0").select("our_id", F.when(F.col("our_id") % 6 == 0, 1.5).otherwise(0.0).alias("our_price"), F.lit("").alias("brand"))
    return U.overlay(c, o, "our_id", ["our_price", "brand"])


# Joins and matching.


@query(
    f"""WITH {OFFERS}, k AS (SELECT DISTINCT brand || '|' || name AS fp FROM offers WHERE product_id % 3 = 0)
    SELECT lower(brand) || '|' || lower(name) || '|0' AS fp, count(*) AS n, min(price) AS min_price FROM offers
    WHERE brand || '|' || name NOT IN (SELECT fp FROM k) GROUP BY 1"""
)
def missing_by_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    o = offers(spark, d).withColumn("fp", K.fingerprint("brand", "name", F.lit(0)))
    left = M.not_in_catalogue(o, o.where("product_id % 3 = 0"), "fp")
    return left.groupBy("fp").agg(F.count("*").alias("n"), F.min("price").alias("min_price"))


@query(
    """WITH t AS (SELECT DISTINCT trim(lower(p_name)) AS k FROM part WHERE p_partkey % 2 = 0)
    SELECT p_partkey AS our_id FROM part WHERE p_partkey % 2 = 1 AND trim(lower(p_name)) NOT IN (SELECT k FROM t)"""
)
def missing_without_priced(spark: SparkSession, d: str) -> DataFrame:
    c = catalogue(spark, d)
    return R.without_priced(c.where("our_id % 2 = 1"), c.where("our_id % 2 = 0"), "name", "name").select("our_id")


@query(
    """WITH b AS (SELECT DISTINCT lower(p_name) AS k FROM part WHERE p_partkey % 2 = 1 INTERSECT SELECT DISTINCT lower(p_name) FROM part WHERE p_partkey % 2 = 0)
    SELECT count(*) AS n_both FROM b"""
)
def audit_overlap(spark: SparkSession, d: str) -> DataFrame:
    c = catalogue(spark, d)
    return R.overlap(c.where("our_id % 2 = 1"), c.where("our_id % 2 = 0"), "name", "name").select("n_both")


@query(
    """WITH ours AS (SELECT min(p_partkey) AS our_id, p_name, p_brand FROM part WHERE p_partkey % 2 = 0 GROUP BY 2, 3)
    SELECT p.p_partkey AS offer_id, CASE WHEN p.p_partkey % 10 = 1 THEN p.p_partkey - 1 ELSE o.our_id END AS our_id,
    CASE WHEN p.p_partkey % 10 = 1 THEN 'sku' WHEN o.our_id IS NOT NULL THEN 'name' END AS layer FROM part p
    LEFT JOIN ours o ON o.p_name = p.p_name AND o.p_brand = p.p_brand WHERE p.p_partkey % 2 = 1"""
)
def match_waterfall(spark: SparkSession, d: str) -> DataFrame:
    c = catalogue(spark, d).withColumn("name_key", T.key_text(F.concat_ws(" ", "brand", "name")))
    ours = c.where("our_id % 2 = 0").withColumn("sku_key", F.col("our_id").cast("string"))
    sku = F.when(F.col("our_id") % 10 == 1, (F.col("our_id") - 1).cast("string"))
    theirs = c.where("our_id % 2 = 1").select(F.col("our_id").alias("offer_id"), sku.alias("sku_key"), "name_key")
    return M.waterfall(theirs, ours, {"sku": ("sku_key", "sku_key"), "name": ("name_key", "name_key")}).select("offer_id", "our_id", "layer")


#: Store offers with the sold quantity as their size; by the order, some names are misspelt, shortened, unknown or of another first
#: word.
LABELLED = """labelled AS (
  SELECT l_orderkey * 10 + l_linenumber AS offer_id, l_partkey, CAST(l_quantity AS BIGINT) AS ml, s_name AS store, p_brand AS brand,
  l_extendedprice / l_quantity AS price, CASE l_orderkey % 8 WHEN 3 THEN substr(p_name, 1, 2) || substr(p_name, 4)
  WHEN 4 THEN split_part(p_name, ' ', 1) WHEN 5 THEN reverse(p_name) WHEN 6 THEN 'violet ' || split_part(p_name, ' ', 2) ELSE p_name END AS name
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey)"""

#: The token set ratio of all pairs of names with near words: equal ones, or such that lose one letter each. The longest common
#: subsequence goes row by row through a list.
LCS = """list_last(list_reduce(q, lambda acc, ch: list_transform(range(0, len(p) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE
  list_max(list_transform(range(1, j + 1), lambda i: greatest(acc[i + 1], CASE WHEN p[i] = ch[1] THEN acc[i] + 1 ELSE 0 END))) END),
  list_transform(range(0, len(p) + 1), lambda _: CAST(0 AS BIGINT))))"""
SCORED = """lists AS (SELECT n AS name, string_split(n, ' ') AS ws, flatten(list_transform(string_split(n, ' '), lambda w: list_concat(['w:' || w],
  CASE WHEN length(w) >= 3 THEN list_concat(['d:' || w], list_transform(range(1, length(w) + 1), lambda i: 'd:' || substr(w, 1, i - 1) || substr(w, i + 1)))
  ELSE [] END))) AS forms FROM (SELECT name AS n FROM labelled UNION SELECT p_name FROM part)),
  near AS (SELECT a.name, b.name AS our_name, list_sort(list_intersect(a.ws, b.ws)) AS c, list_sort(list_filter(a.ws, lambda w: NOT list_contains(b.ws, w))) AS x,
  list_sort(list_filter(b.ws, lambda w: NOT list_contains(a.ws, w))) AS y FROM lists a JOIN lists b ON list_has_any(a.forms, b.forms)
  WHERE a.name IN (SELECT name FROM labelled) AND b.name IN (SELECT p_name FROM part)),
  sides AS (SELECT *, array_to_string(c, ' ') AS b, array_to_string(list_concat(c, x), ' ') AS l, array_to_string(list_concat(c, y), ' ') AS r FROM near),
  spelt AS (SELECT *, list_transform(range(1, length(l) + 1), lambda i: CAST(ascii(substr(l, i, 1)) AS BIGINT)) AS p,
  list_transform(range(1, length(r) + 1), lambda i: [CAST(ascii(substr(r, i, 1)) AS BIGINT)]) AS q FROM sides),
  measured AS (SELECT *, """ + LCS + """ AS lcs FROM spelt),
  scored AS (SELECT name, our_name, round(CASE WHEN len(c) > 0 AND (len(x) = 0 OR len(y) = 0) THEN 100.0 ELSE greatest(200.0 * lcs / (length(l) + length(r)),
  CASE WHEN len(c) > 0 THEN 200.0 * length(b) / (length(b) + least(length(l), length(r))) ELSE 0.0 END) END, 4)::DOUBLE AS score FROM measured)"""


def _best_sql(key: str, given: str) -> str:
    """For every name (and brand) the best score, then the smallest id of ours."""
    return f"""best AS (SELECT {given}, score, our_id, p_size AS our_size FROM (SELECT DISTINCT {given} FROM labelled) g JOIN scored USING (name)
  JOIN (SELECT {key}, min(p_partkey) AS our_id FROM part GROUP BY ALL) o ON o.p_name = our_name {"AND o.p_brand = brand" if "brand" in given else ""}
  JOIN part ON p_partkey = our_id QUALIFY row_number() OVER (PARTITION BY {given} ORDER BY score DESC, our_id) = 1)"""


RESOLVED = f"""{LABELLED}, {SCORED}, {_best_sql("p_name, p_brand", "name, brand")}, resolved AS (SELECT l.*, coalesce(score, 0.0) AS score, our_id,
  CASE WHEN score >= 82 AND abs(ml - our_size) <= 8 THEN 'owned' WHEN score >= 65 THEN 'review' ELSE 'missing' END AS ownership,
  CASE WHEN score >= 82 AND abs(ml - our_size) <= 8 THEN '' WHEN score >= 82 THEN 'size' WHEN score >= 65 THEN 'unverified' ELSE '' END AS reason
  FROM labelled l LEFT JOIN best b USING (name, brand))"""


def _labelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The catalogue and every store offer, names with their sizes."""
    lines, parts = table(spark, d, "lineitem"), table(spark, d, "part")
    stores = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("store"))
    sized = lambda name, size: F.concat_ws(" ", name, F.concat(F.col(size).cast("long").cast("string"), F.lit("ml"))).alias("name")
    names = parts.select(F.col("p_partkey").alias("l_partkey"), "p_name", F.col("p_brand").alias("brand"))
    theirs = lines.join(stores, "l_suppkey").join(names, "l_partkey")
    kind, first, second = F.col("l_orderkey") % 8, F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    written = (
        F.when(kind == 3, F.concat(F.substring("p_name", 1, 2), F.substring("p_name", 4, 1000)))
        .when(kind == 4, first)
        .when(kind == 5, F.reverse("p_name"))
        .when(kind == 6, F.concat(F.lit("violet "), second))
        .otherwise(F.col("p_name"))
    )
    theirs = theirs.withColumn("written", written).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("offer_id"),
        sized("written", "l_quantity"),
        "brand",
        "store",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )
    ours = parts.select(F.col("p_partkey").alias("our_id"), sized("p_name", "p_size"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"))
    return ours, theirs


@query(f"WITH {RESOLVED} SELECT offer_id, score, our_id, ownership, reason FROM resolved")
def resolved_offers(spark: SparkSession, d: str) -> DataFrame:
    ours, theirs = _labelled(spark, d)
    found = M.resolve(M.featured(theirs, "name", brand="brand"), M.featured(ours, "name", brand="brand"))
    return found.select("offer_id", "score", "our_id", "ownership", "reason")


@query(
    f"""WITH {LABELLED}, {SCORED}, {_best_sql("p_name", "name")}, k AS (SELECT p_name || ' ' || p_size || 'ml' AS key, min(p_partkey) AS id FROM part GROUP BY 1)
    SELECT offer_id, coalesce(id, our_id) AS our_id, CASE WHEN id IS NOT NULL THEN 100.0 ELSE coalesce(score, 0.0) END AS score,
    CASE WHEN id IS NOT NULL OR (score >= 90 AND abs(ml - our_size) <= 2) THEN 'matched' WHEN score >= 65 THEN 'review' ELSE 'missing' END AS status,
    CASE WHEN id IS NOT NULL THEN 'name' ELSE 'fuzzy' END AS layer FROM labelled l LEFT JOIN k ON key = name || ' ' || ml || 'ml' LEFT JOIN best USING (name)"""
)
def closed_loop(spark: SparkSession, d: str) -> DataFrame:
    ours, theirs = (M.keyed(x.withColumns({"sku": F.lit(""), "url": F.lit("")}), "sku", "url", "name") for x in _labelled(spark, d))
    return analysis.closed_loop(ours, theirs)


@query(
    f"""WITH {RESOLVED}, t AS (SELECT CASE WHEN price > 0 AND (price < 20 OR price > 15000) THEN 'price' WHEN length(name || ' ' || ml || 'ml') < 8 THEN 'short'
    WHEN ml = 0 THEN 'nosize' WHEN ml < 10 THEN 'mini' ELSE ownership END AS outcome FROM resolved)
    SELECT outcome, count(*) AS n FROM t GROUP BY 1"""
)
def missing_accounting(spark: SparkSession, d: str) -> DataFrame:
    return analysis.accounting(*_labelled(spark, d))


@query(
    f"""WITH {RESOLVED}, t AS (SELECT * FROM resolved WHERE NOT (price > 0 AND (price < 20 OR price > 15000)) AND length(name || ' ' || ml || 'ml') >= 8
    AND ml >= 10 AND ownership <> 'owned'), e AS (SELECT lower(brand) AS brand_key, name AS bare, CASE WHEN ownership = 'missing' THEN 'green' ELSE 'review' END AS confidence,
    store, min(price) AS price, count(*) AS n FROM t GROUP BY ALL)
    SELECT brand_key, bare, confidence, count(*) AS store_count, sum(n)::BIGINT AS offer_count, min(price) AS min_price, max(price) AS max_price FROM e GROUP BY 1, 2, 3"""
)
def missing_products(spark: SparkSession, d: str) -> DataFrame:
    found = analysis.missing_analysis(*_labelled(spark, d))
    return found.select("brand_key", "bare", "confidence", "store_count", "offer_count", "min_price", "max_price")


@query(
    f"""WITH {LABELLED}, brands AS (SELECT p_name AS brand, min(p_partkey) AS ordinal FROM part GROUP BY 1), names AS (SELECT DISTINCT name FROM labelled),
    literal AS (SELECT name, arg_min(brand, ordinal) AS brand FROM names JOIN brands ON contains(name, brand) GROUP BY 1),
    runs AS (SELECT name, 1 AS place, name AS run FROM names UNION ALL SELECT name, 2, split_part(name, ' ', 1) FROM names WHERE contains(name, ' ')
    UNION ALL SELECT name, 3, split_part(name, ' ', 2) FROM names WHERE contains(name, ' ')),
    spelt AS (SELECT run, brand, ordinal, list_transform(range(1, length(run) + 1), lambda i: CAST(ascii(substr(run, i, 1)) AS BIGINT)) AS p,
    list_transform(range(1, length(brand) + 1), lambda i: [CAST(ascii(substr(brand, i, 1)) AS BIGINT)]) AS q
    FROM (SELECT DISTINCT run FROM runs WHERE length(run) >= 4), brands), measured AS (SELECT *, {LCS} AS lcs FROM spelt),
    best AS (SELECT run, brand FROM measured WHERE 200.0 * lcs / (length(run) + length(brand)) >= 85
    QUALIFY row_number() OVER (PARTITION BY run ORDER BY 200.0 * lcs / (length(run) + length(brand)) DESC, ordinal) = 1),
    repaired AS (SELECT name, arg_min(brand, place) AS brand FROM runs JOIN best USING (run) GROUP BY 1)
    SELECT offer_id, coalesce(a.brand, b.brand, '') AS found_brand FROM labelled l LEFT JOIN literal a USING (name) LEFT JOIN repaired b USING (name)"""
)
def repaired_brands(spark: SparkSession, d: str) -> DataFrame:
    """Product lines play the brands; the names of the offers contain them, misspelt, in part, or not at all."""
    brands = catalogue(spark, d).groupBy(F.col("name").alias("brand")).agg(F.min("our_id").alias("ordinal"))
    rows = _labelled(spark, d)[1].withColumn("line", F.regexp_replace("name", r" \S+$", ""))
    return brand_index.with_brand(rows, "line", brands).select("offer_id", "found_brand")


@query(
    """WITH w AS (SELECT split_part(p_name, ' ', 1) AS k, min(p_partkey) AS v FROM part GROUP BY 1), n AS (SELECT p_name || ' ' || p_size AS k, min(p_partkey) AS v FROM part GROUP BY 1)
    SELECT p_partkey AS our_id, 'all n' || n.v || '; ' || '-w' || w.v || 'x' || ', ' || p_brand AS text FROM part JOIN n ON n.k = p_name || ' ' || p_size
    JOIN w ON w.k = split_part(p_name, ' ', 1)"""
)
def replaced_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every name with its size, and every first word, is a term; of those that begin at one place the longest counts."""
    c = table(spark, d, "part")
    name, first = F.concat_ws(" ", "p_name", F.col("p_size").cast("string")), F.split("p_name", " ")[0]
    terms = c.select(name.alias("k"), F.lit("n").alias("t"), "p_partkey").union(c.select(first, F.lit("w"), "p_partkey"))
    terms = terms.groupBy("k", "t").agg(F.min("p_partkey").alias("v")).select("k", F.concat("t", F.col("v").cast("string")).alias("v"))
    text = F.concat(F.lit("all "), name, F.lit("; -"), first, F.lit("x, "), "p_brand")
    return c.select(F.col("p_partkey").alias("our_id"), replaced(text, term_table(terms, "k", "v")).alias("text"))


#: Groups of words of which a variant has one.
VARIANTS = (("hot", "cold"), ("small",), ("large",))


def _indexed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with their features; misspelt first words are synonyms of the right ones, from a table of all."""
    words = table(spark, d, "part").select(F.split("p_name", " ")[0].alias("v")).distinct()
    cut = F.concat(F.substring("v", 1, 2), F.substring("v", 4, 1000))
    terms = words.select(F.col("v").alias("k"), "v").union(words.select(F.concat(cut, F.lit(" ")), F.concat("v", F.lit(" "))))
    synonyms = dict(term_table(terms, "k", "v"))
    return tuple(B.indexed(x, synonyms=synonyms, variants=VARIANTS) for x in _labelled(spark, d))


@query()
def matched_pricing(spark: SparkSession, d: str) -> DataFrame:
    """The core matcher over the whole catalogue and all offers, with the decision on each price."""
    return analysis.matched_pricing(*_indexed(spark, d)).drop("offers")


@query()
def challenged_offers(spark: SparkSession, d: str) -> DataFrame:
    return B.challenged(*_indexed(spark, d))


@query("SELECT p_partkey AS our_id, CASE WHEN p_type = 'x' THEN '' ELSE '🌸 عطور' END AS category FROM part")
def shop_categories(spark: SparkSession, d: str) -> DataFrame:
    label = F.concat_ws(" ", "kind", F.lit("Body Mist 100ml"))
    return catalogue(spark, d).select("our_id", X.category(label).alias("category"))


@query(
    """WITH d AS (SELECT event_id, user_id, value, CASE WHEN event_type = 'click' THEN 'lower' WHEN event_type = 'purchase' THEN 'raise' ELSE 'keep' END AS action FROM events)
    SELECT event_id FROM d WHERE value >= 92 AND action IN ('lower', 'raise') AND user_id IS NOT NULL AND CAST(user_id AS VARCHAR) <> ''"""
)
def pushed_decisions(spark: SparkSession, d: str) -> DataFrame:
    action = F.when(F.col("status") == "click", "lower").when(F.col("status") == "purchase", "raise").otherwise("keep")
    rows = events(spark, d).select("event_id", F.col("user_id").cast("string").alias("product_id"), F.col("value").alias("score"), action.alias("action"))
    return Fl.push_ready(rows, 92.0).select("event_id")


@query(
    """SELECT CAST(user_id AS VARCHAR) AS product_id, arg_max(value, struct_pack(t := ts, e := event_id)) AS new_price FROM events GROUP BY 1"""
)
def last_sent_prices(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select(F.col("user_id").cast("string").alias("product_id"), F.col("value").alias("new_price"), "ts", "event_id")
    return H.last_prices(rows, ["ts", "event_id"])


@query(
    """SELECT event_id, CAST(CASE WHEN event_type = 'view' THEN 7 ELSE n_nationkey END AS BIGINT) AS resolved_id FROM events LEFT JOIN nation ON n_nationkey = user_id % 30"""
)
def resolved_ids(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").alias("id"))
    names = table(spark, d, "nation").select("n_nationkey", "n_name")
    rows = events(spark, d).join(F.broadcast(names), F.col("user_id") % 30 == F.col("n_nationkey"), "left")
    rows = rows.withColumn("given", F.when(F.col("status") == "view", "7.0"))
    return M.resolve_ids(rows, "given", "n_name", n).select("event_id", "resolved_id")


@query(
    """SELECT c_custkey AS id, n_name AS resolved FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def resolved_names(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    rows = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("c_custkey").alias("id"), F.upper("n_name").alias("raw"))
    return M.resolve_dictionary(rows, "raw", n.select(F.col("n_name").alias("key"), F.col("n_name").alias("value"))).select("id", "resolved")


@query(
    """WITH n AS (SELECT DISTINCT p_name FROM part), p AS (SELECT a.p_name AS x, b.p_name AS y FROM n a JOIN n b ON split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1)
    AND a.p_name < b.p_name) SELECT x AS a, y AS b, round(100.0 * len(list_intersect(string_split(x, ' '), string_split(y, ' '))) /
    len(list_distinct(list_concat(string_split(x, ' '), string_split(y, ' ')))), 4) AS jaccard FROM p"""
)
def name_jaccard(spark: SparkSession, d: str) -> DataFrame:
    n = catalogue(spark, d).select("name", F.split("name", " ")[0].alias("w")).distinct()
    pairs = n.alias("x").join(n.alias("y"), (F.col("x.w") == F.col("y.w")) & (F.col("x.name") < F.col("y.name")))
    return pairs.select(F.col("x.name").alias("a"), F.col("y.name").alias("b"), F.round(jaccard(F.col("x.name"), F.col("y.name")), 4).alias("jaccard"))


@query()
def name_similarity(spark: SparkSession, d: str) -> DataFrame:
    n = catalogue(spark, d).select("name", F.split("name", " ")[0].alias("w")).distinct()
    pairs = n.alias("x").join(n.alias("y"), (F.col("x.w") == F.col("y.w")) & (F.col("x.name") < F.col("y.name")))
    pairs = pairs.select(F.col("x.name").alias("a"), F.col("y.name").alias("b"))
    return pairs.select("a", "b", *(similarity("a", "b", k).alias(k) for k in ("ratio", "token_sort", "token_set", "partial", "weighted")))


@query("SELECT p_partkey AS offer_id FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 10 <> 1 AND p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 2 = 0)")
def barred_missing(spark: SparkSession, d: str) -> DataFrame:
    c = catalogue(spark, d).withColumn("sku", F.when(F.col("our_id") % 10 == 1, F.lit("s1")).otherwise(F.concat(F.lit("o"), "our_id")))
    ours = M.featured(c.where("our_id % 2 = 0").withColumn("sku", F.lit("s1")), "name")
    theirs = M.featured(c.where("our_id % 2 = 1").select(F.col("our_id").alias("offer_id"), "name", "sku"), "name")
    return M.barrier(theirs, ours, 100.0).select("offer_id")


@query(
    """SELECT s_name AS store, p_partkey AS part, round(p_retailprice * 2, 0) AS price FROM part JOIN supplier ON p_partkey % 10 = s_suppkey
    WHERE p_partkey % 3 <> 0"""
)
def scraped_rows(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("competitor"))
    c = catalogue(spark, d).join(s, F.col("our_id") % 10 == F.col("s_suppkey"))
    price = F.when(F.col("our_id") % 3 == 0, "x").otherwise(F.round(F.col("our_price") * 2, 0).cast("string"))
    rows = J.scraped_row(c.select("competitor", F.concat_ws(" ", "name", "our_id").alias("title"), price.alias("price")))
    return rows.select("store", F.regexp_extract("name", r"(\d+)$", 1).cast("long").alias("part"), "price")


@query("SELECT p_partkey AS our_id, 'MH-' || upper(substr(md5(lower(p_brand) || '|' || p_partkey || '|' || p_size), 1, 10)) AS sku, round(p_retailprice * 1.15, 0) AS price FROM part")
def upload_rows(spark: SparkSession, d: str) -> DataFrame:
    c = catalogue(spark, d).select(F.col("our_id").cast("string").alias("name"), "brand", F.col("size").alias("size_ml"), F.col("our_price").alias("price"), F.lit("green").alias("confidence"))
    return J.upload_rows(c).select(F.col("name").cast("long").alias("our_id"), "sku", "price")


# Scalars.


@query(
    """SELECT doc_id, md5(trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS key FROM documents"""
)
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.key_text("text").cast("binary")).alias("key"))


@query(
    """SELECT count(*) AS n, count(DISTINCT md5(text)) AS n_distinct FROM documents"""
)
def distinct_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.count("*").alias("n"), F.count_distinct(F.md5(F.col("text").cast("binary"))).alias("n_distinct"))


@query(
    """SELECT url, lower(split_part(regexp_replace(regexp_replace(regexp_replace(url, '^https?://(www\\.)?', ''), '[?#].*$', ''), '/+$', ''), '/', 1)) ||
    regexp_extract(regexp_replace(regexp_replace(regexp_replace(url, '^https?://(www\\.)?', ''), '[?#].*$', ''), '/+$', ''), '^[^/]*(/.*)?$', 1) AS canonical FROM pages"""
)
def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("url", K.canonical_url("url").alias("canonical"))


@query("SELECT p_partkey AS our_id, 'MH-' || upper(substr(md5(lower(p_brand) || '|' || lower(p_name) || '|' || p_size), 1, 10)) AS sku FROM part")
def product_skus(spark: SparkSession, d: str) -> DataFrame:
    return catalogue(spark, d).select("our_id", K.sku("brand", "name", "size").alias("sku"))


@query(
    """SELECT page_id, nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')), '') AS title FROM pages"""
)
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tag_text("html", "title").alias("title"))


#: A page for every part: a third with nested JSON-LD, a third with meta tags, the rest with both, of which JSON-LD counts.
_LD = """'{"@graph": [{"@type": "Organization", "name": "shop"}, {"@type": ["Thing", "Product"], "name": "' || p_name || '", "mpn": "' || p_partkey || '", "image": [{"url": "/' || p_size
  || '.png"}], "brand": {"name": "' || p_brand || '"}, "offers": [{"price": "' || p_size || ',000.50", "priceCurrency": "' || cur || '"}, {"price": 1}]}]}'"""


@query(
    """WITH p AS (SELECT *, CASE WHEN p_size % 5 = 0 THEN 'USD' ELSE 'SAR' END AS cur FROM part), t AS (SELECT p_partkey AS part, p_name AS name, p_size, p_brand,
    p_partkey % 3 <> 1 AND cur = 'SAR' AS ld, p_partkey % 3 <> 0 AS tags FROM p)
    SELECT part, CASE WHEN ld THEN name WHEN tags THEN 'og ' || name END AS name, CASE WHEN ld THEN p_brand WHEN tags THEN 'og ' || p_brand END AS brand,
    CASE WHEN ld THEN CAST(part AS VARCHAR) WHEN tags THEN 's' || part END AS sku, CASE WHEN ld THEN '/' || p_size || '.png' END AS image,
    CASE WHEN ld THEN p_size * 1000 + 0.5 WHEN tags THEN p_size + 0.25 END::DOUBLE AS price, CASE WHEN ld OR tags THEN 'SAR' END AS currency FROM t"""
)
def structured_products(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("cur", F.when(F.col("p_size") % 5 == 0, "USD").otherwise("SAR"))
    script = F.concat(F.lit('<script data-x="1" type="application/ld+json">'), F.expr(_LD), F.lit("</script>"))
    tag = lambda name, *value: F.concat(F.lit(f'<meta property="{name}" content="'), *value, F.lit('">'))
    tags = F.concat(
        tag("og:title", F.lit("og "), "p_name"),
        tag("og:brand", F.lit("og "), "p_brand"),
        tag("product:sku", F.lit("s"), F.col("p_partkey").cast("string")),
        tag("product:price:amount", F.col("p_size").cast("string"), F.lit(".75")),
        F.regexp_replace(tag("product:sale_price:amount", F.col("p_size").cast("string"), F.lit(".25")), r'<meta (\S+) (.*)>', "<meta $2 $1>"),
    )
    bad = F.lit('<script type="application/ld+json">{"@type": "Product", </script>')
    third = F.col("p_partkey") % 3
    page = F.concat(F.lit("<html><head>"), F.when(third != 0, tags).otherwise(""), bad, F.when(third != 1, script).otherwise(""), F.lit("</head></html>"))
    return p.select(F.col("p_partkey").alias("part"), product(page).alias("p")).select("part", *(f"p.{c}" for c in ("name", "brand", "sku", "image", "price", "currency")))


@query(
    """SELECT event_id, props AS json FROM events"""
)
def embedded_json(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("Here [as asked] it is:\n```json\n"), "props", F.lit("\n```\nor {this}: "), "props", F.lit(" }"))
    return table(spark, d, "events").select("event_id", lenient_json(said).alias("json"))


@query()
def page_products(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").withColumn("p", product("html")).select("page_id", "p.*")


@query(
    """SELECT p_partkey AS our_id, CAST(p_size AS DOUBLE) AS size_ml, 'retail' AS item_type FROM part"""
)
def product_features(spark: SparkSession, d: str) -> DataFrame:
    label = F.concat_ws(" ", F.lit("eau"), F.concat(F.col("size").cast("string"), F.lit(" ml")))
    return catalogue(spark, d).select("our_id", X.size_ml(label).alias("size_ml"), X.item_type(label).alias("item_type"))


#: What each kind of product adds to its name, and what must be found in it: size, item type, class, set, gender, concentration.
WORDED = {
    "ECONOMY": (" sample 5ml for men", 5.0, "sample", "rejected", False, "رجالي", ""),
    "SMALL": (" eau de parfum intense 1ml for women", 1.0, "sample", "retail", False, "نسائي", "EDP+INT"),
    "MEDIUM": (" cologne 2 oz", 59.147, "retail", "retail", False, "", "EDC"),
    "PROMO": (" tester edt 100ml", 100.0, "tester", "tester", False, "", "EDT"),
    "LARGE": (" gift set elixir 50ml", 50.0, "retail", "set", True, "", "ELIXIR"),
    "STANDARD": (" body mist 250ml", 250.0, "retail", "body_mist", False, "", ""),
}


def _case(n: int, quote: str = "'") -> str:
    return "CASE p_type " + " ".join(f"WHEN '{k}' THEN {quote}{str(v[n]).lower() if isinstance(v[n], bool) else v[n]}{quote}" for k, v in WORDED.items()) + " END"


def _worded(spark: SparkSession, d: str) -> DataFrame:
    words = F.create_map(*(F.lit(x) for k, v in WORDED.items() for x in (k, v[0])))
    return catalogue(spark, d).withColumn("label", F.concat("name", words[F.col("kind")]))


@query(
    f"""SELECT p_partkey AS our_id, CAST({_case(1, '')} AS DOUBLE) AS size_ml, {_case(2)} AS item_type, {_case(3)} AS product_class, {_case(4, '')} AS is_set,
    {_case(5)} AS gender, {_case(6)} AS concentration FROM part"""
)
def worded_features(spark: SparkSession, d: str) -> DataFrame:
    found = {
        "size_ml": F.round(X.size_ml("label"), 3), "item_type": X.item_type("label"), "product_class": X.product_class("label"),
        "is_set": X.is_set("label"), "gender": X.gender("label"), "concentration": X.concentration("label"),
    }
    return _worded(spark, d).select("our_id", *(c.alias(n) for n, c in found.items()))


@query(
    """SELECT p_partkey AS our_id, CASE p_type WHEN 'ECONOMY' THEN 'sample' WHEN 'SMALL' THEN 'tiny' END AS reason FROM part"""
)
def upload_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _worded(spark, d).select("our_id", Fl.strict_reason("label").alias("reason"))


@query(
    """SELECT p_partkey AS our_id, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'class' WHEN p_type = 'LARGE' THEN 'set'
    WHEN p_retailprice > 0 AND (p_retailprice < 20 OR p_retailprice > 15000) THEN 'price' WHEN p_type = 'SMALL' THEN 'mini' END AS reason FROM part"""
)
def missing_reasons(spark: SparkSession, d: str) -> DataFrame:
    return Fl.with_missing_reason(_worded(spark, d), "label", "our_price").select("our_id", "reason")


@query(
    """WITH t AS (SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'no image' ELSE 'https://x/' || p_partkey END AS image, trim(repeat(p_name || ' ', p_size)) AS text FROM part)
    SELECT p_partkey AS our_id, CASE WHEN image = 'no image' THEN 'image' WHEN length(text) < 60 THEN 'short_description' WHEN NOT contains(text, 'gear') THEN 'marker' END AS reason FROM t"""
)
def publishing_gates(spark: SparkSession, d: str) -> DataFrame:
    image = F.when(F.col("kind") == "ECONOMY", "no image").otherwise(F.concat(F.lit("https://x/"), "our_id"))
    text = F.repeat(F.concat(F.lit("<b>"), "name", F.lit("</b> ")), F.col("size"))
    return catalogue(spark, d).select("our_id", Fl.gate_reason(image, text, "gear").alias("reason"))


@query(
    """SELECT event_id, CASE WHEN event_type = 'click' OR value >= 95 THEN 'DUPLICATE' WHEN value >= 70 THEN 'REVIEW' ELSE 'NEW' END AS verdict FROM events"""
)
def duplicate_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", M.duplicate_verdict(F.col("value"), F.col("status") == "click").alias("verdict"))


@query(
    f"""WITH {PRICED} SELECT our_id, CASE WHEN action = 'review' THEN 'REVIEW' WHEN our_price > 1500 THEN 'MATCHED_AI' ELSE 'MATCHED_AUTO' END AS state FROM priced"""
)
def ledger_states(spark: SparkSession, d: str) -> DataFrame:
    rows = analysis.priced(catalogue(spark, d), offers(spark, d))
    return rows.select("our_id", R.ledger_state("decision", F.when(F.col("our_price") > 1500, "ai")).alias("state"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 0.0::DOUBLE ELSE value END AS price, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS value FROM events")
def json_rows(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("status") == "view", F.lit(float("nan"))).otherwise(F.col("value"))
    return E.json_safe(events(spark, d).select("event_id", value.alias("price"), value.alias("value")), ["price"])


@query(
    """SELECT p_partkey AS our_id, p_type IN ('ECONOMY', 'SMALL') AND p_size < 20 AS phantom FROM part"""
)
def phantom_rows(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("kind") == "ECONOMY", F.concat(F.lit("P"), "our_id", F.lit("_x"))).when(F.col("kind") == "SMALL", F.lit("  ")).otherwise(F.col("name"))
    price = F.when(F.col("size") < 20, F.lit("x")).otherwise(F.col("our_price").cast("string"))
    return catalogue(spark, d).select("our_id", Fl.is_phantom(name, price).alias("phantom"))


@query(
    """WITH t AS (SELECT *, trim(repeat(p_name || ' ', p_size)) AS text FROM part) SELECT p_name AS "أسم المنتج", p_brand AS "الماركة", 'kg' AS "وحدة الوزن",
    CASE WHEN p_retailprice > 1 THEN round((p_retailprice - 1)::DECIMAL(18, 4), 2)::DOUBLE END AS reduced, 'S' || p_partkey AS "رمز المنتج sku", 40 AS n_columns
    FROM t WHERE p_type <> 'ECONOMY' AND length(text) >= 60 AND contains(text, 'gear')"""
)
def upload_file(spark: SparkSession, d: str) -> DataFrame:
    c = catalogue(spark, d)
    rows = c.select(
        "name", "brand", F.col("kind").alias("category"), F.col("our_price").alias("price"), F.concat(F.lit("S"), "our_id").alias("sku"),
        F.when(F.col("kind") != "ECONOMY", F.concat(F.lit("https://x/"), "our_id")).alias("image"),
        F.repeat(F.concat(F.lit("<p>"), "name", F.lit("</p> ")), F.col("size")).alias("description"),
    )
    out, _ = E.upload_file(rows, "gear")
    return out.select("أسم المنتج", "الماركة", "وحدة الوزن", F.col("السعر المخفض").cast("double").alias("reduced"), "رمز المنتج sku", F.lit(len(out.columns)).alias("n_columns"))


@query(
    """SELECT p_partkey AS our_id, 'عطر ورد ' || p_partkey || CASE WHEN p_type = 'SMALL' THEN '' ELSE ' ' || p_size || ' مل' END AS title FROM part"""
)
def arabic_titles(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("ورد "), "our_id", F.lit(" "), "name")
    size = F.when(F.col("kind") != "SMALL", F.col("size").cast("string"))
    return catalogue(spark, d).select("our_id", T.title(F.lit("عطر"), name, F.lit("Brand's"), F.lit(None), size, F.lit(" ")).alias("title"))


# Files: what is written is read again by the file sources.


def _written(df: DataFrame) -> str:
    path = shared_dir(df.sparkSession)
    E.write_csv(df, path)
    return path


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS name, CASE WHEN p_type = 'SMALL' THEN 0.0 ELSE p_retailprice END AS price, p_brand AS brand FROM part
    WHERE p_type <> 'PROMO'"""
)
def catalogue_file(spark: SparkSession, d: str) -> DataFrame:
    """Nameless rows are dropped, unreadable prices are 0."""
    price = F.when(F.col("kind") == "SMALL", "n/a").otherwise(F.col("our_price").cast("string"))
    rows = catalogue(spark, d).select(
        F.col("our_id").alias("No."), F.when(F.col("kind") != "PROMO", F.col("name")).alias("أسم المنتج"), price.alias("سعر المنتج"), F.col("brand").alias("الماركة")
    )
    return S.load_catalogue(S.read_csv(spark, _written(rows)))


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS name, CASE WHEN p_type = 'SMALL' THEN 0.0 ELSE p_retailprice END AS price, p_brand AS brand FROM part
    WHERE p_type <> 'PROMO'"""
)
def workbook_file(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue as workbooks with a line above the header and typed cells, and back."""
    path, price = shared_dir(spark), F.when(F.col("kind") != "SMALL", F.col("our_price"))
    rows = catalogue(spark, d).select(
        F.col("our_id").alias("No."), F.when(F.col("kind") != "PROMO", F.col("name")).alias("أسم المنتج"), price.alias("سعر المنتج"), F.col("brand").alias("الماركة")
    )
    W.write_workbooks(rows, path, "المنتجات", S.META_ROW)
    return S.load_catalogue(W.read_workbook(spark, path, "المنتجات", S.META_ROW))


@query(
    f"""WITH {OFFERS} SELECT 'shop' AS store, name, CASE WHEN discount > 0.05 THEN NULL ELSE price END AS price, 'https://shop/p/' || product_id AS url FROM offers"""
)
def competitor_file(spark: SparkSession, d: str) -> DataFrame:
    price = F.when(F.col("discount") > 0.05, "").otherwise(F.col("price").cast("string"))
    rows = offers(spark, d).select(F.col("name").alias("product_name"), price.alias("price"), F.concat(F.lit("https://shop/p/"), "product_id").alias("link"))
    return S.load_competitor(S.read_csv(spark, _written(rows)), "shop").select("store", "name", "price", "url")


@query(
    """SELECT p_brand AS brand, count(*) AS n, max(CASE WHEN p_brand IN (SELECT max(p_brand) FROM part) THEN 1.0::DOUBLE ELSE p_retailprice END) AS top FROM part GROUP BY 1"""
)
def replaced_brands(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one brand are replaced in a partitioned table, the others stay."""
    c, path = catalogue(spark, d).select("our_id", "brand", "our_price"), shared_dir(spark)
    E.replace_partitions(c, path, "brand")
    last = c.agg(F.max("brand").alias("brand"))
    E.replace_partitions(c.join(F.broadcast(last), "brand").select("our_id", "brand", F.lit(1.0).alias("our_price")), path, "brand")
    back = spark.read.schema("our_id long, our_price double, brand string").parquet(path)
    return back.groupBy("brand").agg(F.count("*").alias("n"), F.max("our_price").alias("top"))


@query(
    f"""WITH {PRICED}, r AS (SELECT our_id FROM priced WHERE action = 'raise' AND our_id <> 0) SELECT count(*) AS n, true AS sent, 1 AS attempts FROM r"""
)
def posted_prices(spark: SparkSession, d: str) -> DataFrame:
    """Every payload is posted once, in batches."""
    rows = analysis.priced(catalogue(spark, d), offers(spark, d)).where("action = 'raise'")
    log = E.send(E.batches(E.payloads(rows.withColumn("product_id", F.col("our_id")), "raise")), lambda products: len(products) <= 20)
    return log.agg(F.sum("n").alias("n"), F.bool_and("sent").alias("sent"), F.max("attempts").alias("attempts"))


@query(
    """SELECT conv_id, turn, n - 1 AS row, trim(cell) AS first FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n,
    CASE WHEN contains(text, '|') THEN '|' WHEN contains(text, chr(9)) THEN chr(9) ELSE ',' END AS sep FROM conversations), LATERAL (SELECT split_part(line, sep, 1) AS cell)
    WHERE trim(line) <> ''"""
)
def pasted_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    lines = S.parse_pasted(rows, keep=("conv_id", "turn"))
    return lines.select("conv_id", "turn", F.col("row").cast("long").alias("row"), F.col("cells")[0].alias("first"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def event_properties(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", "k")


@query(
    """SELECT conv_id, turn, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n_lines FROM conversations"""
)
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return c.select("conv_id", "turn", F.size(lines).cast("long").alias("n_lines"))


def queries() -> dict[str, Query]:
    return {k: (lambda spark, sf_dir, f=f: f(ship(spark), sf_dir)) for k, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

