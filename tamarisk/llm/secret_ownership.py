"""Secrets in texts, told apart by who owns them, with DataFrame operations only.

Patterns find candidates and their code-point spans. The hashes of the candidates' values are counted over the corpus by
distinct repositories and owners: a value that many owners have is a copied example, one that a single owner has looks
live. Unkeyed tokens (``bare``) are reported only if they are one owner's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, join_frequent, materialize

#: Kinds in the order of the results: pattern, shortest value. A pattern's first group, if any, is the value.
KINDS = {
    "assign": (
        r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12,
    ),
    "access": (r"AKIA[A-Z0-9]{14,}", 18),
    "hex": (r"[0-9a-f]{16,}", 16),
    "bare": (
        r"(?<![A-Za-z0-9_-])(?=[a-z0-9_-]*[A-Z])(?=[A-Z0-9_-]*[a-z])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_-])",
        20,
    ),
}
BASE = ("assign", "access", "hex")
#: Owners from which on a value counts as copied.
COPIED = 3
#: Values that are plainly not secret.
PLACEHOLDER = r"(?i)example|sample|placeholder|changeme|your[_-]|(.)\1{7}|0123456789|abcdefgh"


def _found(text: Column, pattern: str) -> Column:
    """Array of (before, length, value) for a pattern's matches: the characters since the match before, and its own."""
    group = 1 if "([" in pattern else 0
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(gaps.alias("g"), whole.alias("m"), value.alias("v"))
    named = zipped.cast("array<struct<g:string,m:string,v:string>>")
    some = F.filter(named, lambda x: x["m"].isNotNull())
    sized = F.transform(
        some, lambda x: F.struct(F.length(x["g"]).alias("before"), F.length(x["m"]).alias("length"), x["v"].alias("value"))
    )
    none = F.array().cast("array<struct<before:int,length:int,value:string>>")
    return F.when(text.rlike(pattern), sized).otherwise(none)


def _numbered(kind: str, n: int) -> Column:
    return F.transform(F.col(kind), lambda x, i: F.struct(F.lit(n).alias("kind"), i.alias("nth"), x.alias("x")))


def candidates(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Two tables: (doc_id, text_hash) of every row, and (doc_id, text_hash, owner, repository, kind, start, end, value)
    of every candidate of the distinct rows. Null texts are empty; null owners are one owner."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        F.xxhash64(text, F.length(text)).alias("text_hash"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
        *(_found(text, pattern).alias(kind) for kind, (pattern, _) in KINDS.items()),
    )
    narrow = materialize(narrow)
    parts = [_numbered(kind, n) for n, kind in enumerate(KINDS)]
    some = narrow.where(" or ".join(f"size({kind}) > 0" for kind in KINDS))
    hits = some.dropDuplicates(["doc_id", "text_hash", "owner"]).select(
        "doc_id", "text_hash", "owner", "repository", F.explode(F.concat(*parts)).alias("hit")
    )
    hits = hits.select("doc_id", "text_hash", "owner", "repository", "hit.kind", "hit.nth", "hit.x.*")
    so_far = Window.partitionBy("doc_id", "text_hash", "owner", "kind").orderBy("nth")
    end = F.sum(F.col("before") + F.col("length")).over(so_far.rowsBetween(Window.unboundedPreceding, 0))
    hits = hits.withColumn("end", end).withColumn("start", F.col("end") - F.col("length"))
    long_enough = F.lit(False)
    for n, (_, least) in enumerate(KINDS.values()):
        long_enough |= (F.col("kind") == n) & (F.length("value") >= least)
    hits = hits.where(long_enough)
    # A bare token within a base span is not another finding.
    of_doc = Window.partitionBy("doc_id", "text_hash", "owner").orderBy("start", "kind", "end")
    base_end = F.when(F.col("kind") < len(BASE), F.col("end"))
    before = F.max(base_end).over(of_doc.rowsBetween(Window.unboundedPreceding, -1))
    base_start = F.when(F.col("kind") < len(BASE), F.col("start"))
    after = F.min(base_start).over(of_doc.rowsBetween(1, Window.unboundedFollowing))
    hits = hits.withColumns({"base_before": before, "base_after": after})
    clear = (F.coalesce("base_before", F.lit(-1)) <= F.col("start")) & (
        F.coalesce("base_after", F.col("end")) >= F.col("end")
    )
    hits = hits.where((F.col("kind") < len(BASE)) | clear)
    hits = hits.withColumn("value_hash", F.sha2(F.col("value").cast("binary"), 256))
    return narrow.select("doc_id", "text_hash", "owner"), materialize(hits.drop("base_before", "base_after", "before", "length", "nth"))


def ownership(hits: DataFrame, copied: int = COPIED) -> DataFrame:
    """(value_hash, n, repositories, owners, verdict) of every candidate value: ``copied`` with that many owners or the
    look of a placeholder, ``live`` with a single owner, ``shared`` between."""
    fake = F.col("value").rlike(PLACEHOLDER)
    each = hits.groupBy("value_hash", "owner", "repository").agg(F.count("*").alias("n"), F.max(fake).alias("fake"))
    by_owner = each.groupBy("value_hash", "owner").agg(
        F.sum("n").alias("n"), F.count("*").alias("repositories"), F.max("fake").alias("fake")
    )
    whole = by_owner.groupBy("value_hash").agg(
        F.sum("n").alias("n"), F.sum("repositories").alias("repositories"), F.count("*").alias("owners"), F.max("fake").alias("fake")
    )
    verdict = F.when(F.col("fake") | (F.col("owners") >= copied), "copied").when(F.col("owners") == 1, "live")
    return whole.withColumn("verdict", verdict.otherwise("shared")).drop("fake")


def findings(docs: DataFrame, owner: str = "source", repository: str = "doc_id", copied: int = COPIED) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, owner) of every row, and every finding with its start, end, kind, value, owners and verdict."""
    rows, hits = candidates(docs, owner, repository)
    known = materialize(ownership(hits, copied))
    judged = join_frequent(hits, known, "value_hash", "n", hits.count())
    judged = judged.where((F.col("kind") < len(BASE)) | (F.col("verdict") == "live"))
    return rows, judged


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", copied: int = COPIED) -> DataFrame:
    """One row for each document row: doc_id, n_assign, n_access, n_hex, base (string of base spans), spans (string of
    all), n_live, n_copied. Null and empty texts have none; repeated rows get the same; other columns are not read."""
    rows, judged = findings(docs, owner, repository, copied)
    names = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    text = F.concat_ws(":", names, "start", "end")
    spans = judged.groupBy("doc_id", "text_hash", "owner").agg(
        *(F.count(F.when(F.col("kind") == n, 1)).alias(f"n_{kind}") for n, kind in enumerate(BASE)),
        F.count(F.when(F.col("verdict") == "live", 1)).alias("n_live"),
        F.count(F.when(F.col("verdict") == "copied", 1)).alias("n_copied"),
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", text.alias("text")))).alias("found"),
    )
    join = lambda a: F.array_join(F.transform(a, lambda x: x["text"]), ",")
    spans = spans.withColumns(
        {"base": join(F.filter("found", lambda x: x["kind"] < len(BASE))), "spans": join(F.col("found"))}
    ).drop("found")
    same = rows.doc_id.eqNullSafe(spans.doc_id) & (rows.text_hash == spans.text_hash) & (rows.owner == spans.owner)
    out = rows.join(spans, same, "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_assign", "n_access", "n_hex", "n_live", "n_copied")]
    return out.select(rows.doc_id, *zero, *(F.coalesce(c, F.lit("")).alias(c) for c in ("base", "spans")))


def redact(docs: DataFrame, mark: str = "[SECRET]", owner: str = "source", copied: int = COPIED) -> DataFrame:
    """``docs`` with the columns it has, where ``mark`` stands in place of every finding that isn't a copied example.

    Only texts that match a pattern are shuffled. n_chars, if there, follows a text that changed. Null and empty texts stay as
    they are, repeated rows stay, an empty table stays empty; further columns, whatever their names, go along.
    """
    _, judged = findings(docs, owner, copied=copied)
    # Overlapping findings become one.
    ordered = Window.partitionBy("doc_id", "text_hash", "owner").orderBy("start", "end")
    reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    secret = judged.where("verdict <> 'copied'").withColumn("reach", reach)
    secret = secret.withColumn("part", F.sum(F.when(F.col("start") < F.col("reach"), 0).otherwise(1)).over(ordered))
    merged = secret.groupBy("doc_id", "text_hash", "owner", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = merged.groupBy("doc_id", "text_hash", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    text = F.coalesce(F.col("text"), F.lit(""))
    matches = F.lit(False)
    for pattern, _ in KINDS.values():
        matches |= text.rlike(pattern)
    own = fresh(docs.columns, "hash", "of", "doc", "text_hash", "owner", "cuts")
    some = docs.where(matches).withColumns(
        {own[0]: F.xxhash64(text, F.length(text)), own[1]: F.coalesce(F.col(owner).cast("string"), F.lit(""))}
    )
    cuts = cuts.toDF(*own[2:])
    same = F.col("doc_id").eqNullSafe(F.col(own[2])) & (F.col(own[0]) == F.col(own[3])) & (F.col(own[1]) == F.col(own[4]))
    some = some.join(cuts, same, "left")
    c, i = F.col(own[5]), F.sequence(F.lit(0), F.size(own[5]))
    begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.element_at(c, k)["end"]).cast("int")
    stop = lambda k: F.when(k == F.size(c), F.length("text")).otherwise(F.element_at(c, k + 1)["start"]).cast("int")
    kept = F.transform(i, lambda k: F.col("text").substr(begin(k) + 1, stop(k) - begin(k)))
    new = F.when(c.isNull(), F.col("text")).otherwise(F.array_join(kept, mark))
    if "n_chars" in docs.columns:
        n = F.when(c.isNull(), F.col("n_chars")).otherwise(F.length("text"))
        some = some.withColumn("text", new).withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    else:
        some = some.withColumn("text", new)
    return docs.where(~matches).unionByName(some.select(*docs.columns)).select(*docs.columns)
