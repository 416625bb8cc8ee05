"""Routing decisions to sections, and the law that no row is lost or counted twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import Name, column, key_text


class DataLossError(ValueError):
    """Rows went missing, or landed in several places."""


def matched_sections(decision: Name) -> Column:
    """Every section that a decision belongs to. Sections are told independently: one decision can match several."""
    d = F.trim(F.coalesce(column(decision).cast("string"), F.lit("")))
    parts = []
    for section, prefixes in V.SECTION_PREFIXES.items():
        hit = F.lit(False)
        for p in prefixes:
            hit |= d.startswith(p)
        if section == "price_lower":
            hit |= d.contains(V.LOWER_CONTAINS)
        parts.append(F.when(hit, section))
    found = F.array_compact(F.array(*parts))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("excluded")))


def route(df: DataFrame, decision: str = "decision") -> DataFrame:
    """One row for each section a row belongs to, in column ``section``; unknown decisions are excluded, not dropped."""
    return df.withColumn("section", F.explode(matched_sections(decision)))


def balance(df: DataFrame, decision: str = "decision") -> DataFrame:
    """One row: rows in, rows out over all sections, and the gap, which is 0 if every row has one section."""
    n = F.size(matched_sections(decision))
    out = df.agg(F.count("*").alias("n_in"), F.coalesce(F.sum(n), F.lit(0)).alias("n_out"))
    return out.withColumn("gap", F.col("n_in") - F.col("n_out"))


def balanced(df: DataFrame, decision: str = "decision") -> DataFrame:
    """``df`` as it is; a row with several sections fails the job that reads it, so that nothing has to be counted before."""
    found = matched_sections(decision)
    fails = F.raise_error(F.concat(F.lit("DataLossError: one row in several sections: "), F.col(decision)))
    return df.where(F.when(F.size(found) == 1, True).otherwise(fails.cast("boolean")))


def assert_balanced(df: DataFrame, decision: str = "decision") -> DataFrame:
    """``df`` as it is, or DataLossError."""
    row = balance(df, decision).first()
    if row.gap:
        raise DataLossError(f"{row.n_in} rows in, {row.n_out} in the sections")
    return df


def audited_keys(df: DataFrame, name: str, failed: bool = False) -> DataFrame:
    """Distinct trimmed lower-case names that count in an audit; failed ones (❌) only if asked for."""
    k = key_text(name)
    ok = ~k.isin("", "nan") & (F.lit(failed) | ~F.coalesce(column(name), F.lit("")).startswith("❌"))
    return df.where(ok).select(k.alias("key")).distinct()


def without_priced(missing: DataFrame, priced: DataFrame, missing_name: str, priced_name: str) -> DataFrame:
    """Missing rows whose name is in no priced section."""
    known = audited_keys(priced, priced_name)
    return missing.join(known, key_text(missing[missing_name]) == known.key, "left_anti")


def overlap(missing: DataFrame, priced: DataFrame, missing_name: str, priced_name: str, show: int = 10) -> DataFrame:
    """One row: how many names are both missing and priced, and the first few of them."""
    both = audited_keys(missing, missing_name, True).join(audited_keys(priced, priced_name), "key", "left_semi")
    first = both.orderBy("key").limit(show).agg(F.array_sort(F.collect_list("key")).alias("examples"))
    return both.agg(F.count("*").alias("n_both")).crossJoin(first)


def ledger_state(status: Name, source: Name) -> Column:
    """Where an intake row ends: the ledger's state for a decision and what made it."""
    s = F.coalesce(column(status), F.lit(""))
    review = s.startswith("⚠️") | s.startswith("🔍")
    priced = s.startswith("🔴") | s.startswith("🟢") | s.startswith("✅")
    by_model = F.coalesce(column(source), F.lit("")) == "ai"
    return (
        F.when(priced & by_model, "MATCHED_AI").when(priced, "MATCHED_AUTO").when(review, "REVIEW").otherwise("REJECTED_LOW_CONFIDENCE")
    )


def merged_audit(stats: Column, report: Column) -> Column:
    """An audit map with a reconciliation's counters (map of names to numbers) put in; counters of both are the report's."""
    kept = F.map_filter(F.coalesce(stats, F.create_map().cast("map<string,long>")), lambda k, _: ~F.array_contains(F.map_keys(report), k))
    return F.map_concat(kept, report)
