"""Terms of a table in texts: one automaton over all of them, sent to the executors once, one pass over each text.

Of terms that begin at one place the longest counts, the leftmost first; what a replacement yields is not looked at again. A table
is measured before it leaves the executors: an automaton holds ``LIMIT`` bytes of terms at most.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Bytes of terms and values that go into one automaton.
LIMIT = 64 << 20


def _automaton(pairs: list[tuple[str, object]]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, value in pairs:
        found.add_word(term, (len(term), value))
    found.make_automaton()
    return found


def term_table(df: DataFrame, term: str, value: str) -> list[tuple[str, object]]:
    """The rows of a bounded table, of repeated terms the least value; blank terms are left out."""
    rows = df.where(F.coalesce(term, F.lit("")) != "").groupBy(term).agg(F.min(value).alias(value))
    size = rows.agg(F.coalesce(F.sum(F.octet_length(term) + F.octet_length(F.col(value).cast("string"))), F.lit(0))).first()[0]
    if size > LIMIT:
        raise ValueError(f"{size} bytes of terms; an automaton takes {LIMIT}")
    return [(r[0], r[1]) for r in rows.collect()]


def replaced(text: Column, table: Mapping[str, str] | list[tuple[str, str]]) -> Column:
    """``text`` with every term replaced; null stays null. Without terms it is no work."""
    pairs = list(table.items()) if isinstance(table, Mapping) else list(table)
    pairs = [(k, v) for k, v in pairs if k]
    if not pairs:
        return text
    shared = SparkSession.active().sparkContext.broadcast(pairs)

    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = _automaton(shared.value)

        def one(x: str | None) -> str | None:
            if not x:
                return x
            out, at = [], 0
            for end, (size, value) in terms.iter_long(x):
                out += (x[at : end + 1 - size], value)
                at = end + 1
            return "".join([*out, x[at:]]) if at else x

        for s in batches:
            yield s.map(one, na_action="ignore")

    return run(text)


def contained(text: Column, terms: DataFrame, term: str, value: str) -> Column:
    """The values (longs) of all terms that a text contains, however they overlap."""
    shared = SparkSession.active().sparkContext.broadcast(term_table(terms, term, value))

    @pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = _automaton(shared.value) if shared.value else None
        for s in batches:
            yield s.map(lambda x: sorted({v for _, (_, v) in table.iter(x)}) if table is not None and x else [])

    return run(text)
