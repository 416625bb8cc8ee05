"""Product features from names: size, gender, concentration, class, brand."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import vocabulary as V
from .text import Name, column, fold_letters, normalize


def _text(c: Name) -> Column:
    return F.lower(F.coalesce(column(c).cast("string"), F.lit("")))


def any_of(text: Column, words) -> Column:
    """Whether a text holds any of the words, literally."""
    return text.rlike("|".join(re.escape(w) for w in words))


def size_ml(c: Name) -> Column:
    """The first volume in ounces, else in millilitres; 0 if there is none."""
    t = _text(c)
    # The patterns of volumes.
    ounces = F.regexp_extract(t, r"(\d+(?:\.\d+)?)\s*(?:fl\.?\s*oz|oz|ounce|fluid\s*oz)", 1)
    ml = F.regexp_extract(t, r"(\d+(?:\.\d+)?)\s*(?:ml|مل|ملي|milliliter)", 1)
    return F.coalesce(ounces.try_cast("double") * V.OUNCE_ML, ml.try_cast("double"), F.lit(0.0))


def gender(c: Name) -> Column:
    """Male or female if the words of exactly one side occur, else empty."""
    t = _text(c)
    male, female = any_of(t, V.MALE_WORDS), any_of(t, V.FEMALE_WORDS)
    return F.when(male & ~female, V.MALE).when(female & ~male, V.FEMALE).otherwise("")


def concentration(c: Name) -> Column:
    t = F.translate(_text(c), "أإآىـ", "اااي")
    kind = None
    for name, words in V.CONCENTRATIONS:
        kind = F.when(any_of(t, words), name) if kind is None else kind.when(any_of(t, words), name)
    kind = kind.when(t.contains("parfum") & ~t.contains("shop"), "EDP").otherwise("")
    return F.when((kind != "") & any_of(t, V.INTENSE_WORDS), F.concat(kind, F.lit("+INT"))).otherwise(kind)


def class_text(c: Name) -> Column:
    """What classes are told from: the raw and the normalised name."""
    return F.trim(F.concat_ws(" ", _text(c), normalize(c)))


def class_of(text: Name) -> Column:
    """The first class whose words occur in a ``class_text``; ``retail`` otherwise. Give it a column rather than an expression, which
    every class would evaluate again."""
    kind = None
    for name, pattern in V.CLASSES:
        hit = column(text).rlike("(?U)" + pattern)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return kind.otherwise("retail")


def product_class(c: Name) -> Column:
    """The class of a name; for large tables see ``class_of``."""
    return class_of(class_text(c))


def is_sample(c: Name) -> Column:
    return any_of(_text(c), V.SAMPLE_WORDS)


def is_tester(c: Name) -> Column:
    return any_of(_text(c), V.TESTER_WORDS)


def is_set(c: Name) -> Column:
    return any_of(_text(c), V.SET_WORDS)


def item_type(c: Name) -> Column:
    return F.when(is_sample(c), "sample").when(is_tester(c), "tester").otherwise("retail")


def known_brand(c: Name, brands: list[str]) -> Column:
    """The first brand of the list, in its order, that the name contains; empty if none. The list is a constant."""
    raw, norm = _text(c), normalize(c)
    table = F.array(*(F.struct(F.lit(b).alias("brand"), F.lit(b.lower()).alias("low")) for b in brands))
    hits = F.filter(table, lambda b: F.contains(raw, b["low"]) | F.contains(norm, fold_letters(b["low"])))
    return F.coalesce(F.get(hits, 0)["brand"], F.lit(""))


def product_numbers(c: Name) -> Column:
    """Numbers that name a product rather than a volume, sorted: after a word for number, as digits or in words; attached to a
    letter, unless a size; alone, if among the numbers that names have and no volume."""
    t = _text(c)
    all_of = lambda pattern: F.regexp_extract_all(t, F.lit(pattern), F.lit(1))
    words = [F.when(t.rlike(f"(?:نمبر|number|no|رقم) {w}"), F.lit(n)) for w, n in V.NUMBER_WORDS.items()]
    told = all_of(r"(?:no|num|number|نمبر|رقم|№|#)\s*(\d+)")
    named = F.array_compact(F.array(*words))
    stuck = F.filter(all_of(r"[a-z\u0600-\u06FF](\d+)"), lambda n: ~n.isin(*V.SIZE_NUMBERS))
    alone = F.filter(all_of(r"(?U)\b(\d{1,3})\b(?!\s{0,3}(?:ml|مل))"), lambda n: n.isin(*V.NAME_NUMBERS))
    return F.array_sort(F.array_distinct(F.concat(told, named, stuck, alone)))


def sizes_agree(a: Name, b: Name, tolerance: float = V.SIZE_TOLERANCE_ML) -> Column:
    a, b = F.coalesce(column(a), F.lit(0.0)), F.coalesce(column(b), F.lit(0.0))
    return (a == 0) | (b == 0) | (F.abs(a - b) <= tolerance)


def genders_clash(a: Name, b: Name) -> Column:
    a, b = F.coalesce(column(a), F.lit("")), F.coalesce(column(b), F.lit(""))
    return (a != "") & (b != "") & (a != b)


def confidence(score: Name, confirmed: float = V.MATCH_CONFIRMED, review: float = V.MATCH_REVIEW) -> Column:
    s = column(score)
    return F.when(s >= confirmed, "confirmed").when(s >= review, "review").otherwise("none")


def has_words(c: Name, groups: dict[str, tuple[str, ...]]) -> Column:
    """Which groups of variant words a name has, as a sorted array of their names."""
    t = _text(c)
    return F.array_compact(F.array(*(F.when(any_of(t, words), g) for g, words in sorted(groups.items()))))


def variants_differ(a: Name, b: Name, groups: dict[str, tuple[str, ...]]) -> Column:
    """Whether two names are different variants of a line: some group of words is in one of them only."""
    return has_words(a, groups) != has_words(b, groups)


def product_line(name: Name, brand: Name, synonyms: dict[str, str] | None = None) -> Column:
    """What is left of a name without its brand (and the brand's synonyms), prepositions, common words, sizes and symbols: the line
    it belongs to. Words are taken out one after another, the short ones only where they stand alone, so that the order
    matters: a vectorised Python function. Give it distinct names."""
    known: dict[str, list[str]] = {}
    for word, meant in (synonyms or {}).items():
        known.setdefault(meant, []).append(word)
    stop, prepositions = V.LINE_STOP, V.PREPOSITIONS
    fold = str.maketrans("أإآةىؤئ", "اااهيوي")

    @pandas_udf("string")
    def run(names: pd.Series, brands: pd.Series, folded: pd.Series) -> pd.Series:
        out = []
        for n, b, f in zip(names, brands, folded, strict=True):
            for x in filter(None, (b, f, *known.get(b, ()), *(known.get(f, ()) if f != b else ()))):
                n = n.replace(x, " ")
            out.append(n)
        t = pd.Series(out, dtype="object")
        for x in prepositions:
            t = t.str.replace(rf"\b{x}\b", " ", regex=True)
        for x in stop:
            t = t.str.replace(rf"(?:^|\s){x}(?:\s|$)", " ", regex=True) if len(x) <= 3 else t.str.replace(x, " ", regex=False)
        t = t.str.replace(r"\d+(?:\.\d+)?\s*(?:ml|مل|ملي)?", " ", regex=True)
        t = t.str.replace(r"[^\w\s\u0600-\u06FF]", " ", regex=True).str.translate(fold)
        return t.str.replace(r"\s+", " ", regex=True).str.strip()

    b = F.lower(F.coalesce(column(brand).cast("string"), F.lit("")))
    return run(_text(name), b, normalize(b, synonyms))


def category(c: Name) -> Column:
    """The shop's category of a name: the first whose words it has."""
    t, kind = _text(c), None
    for name, words in V.CATEGORIES:
        kind = F.when(any_of(t, words), name) if kind is None else kind.when(any_of(t, words), name)
    return kind.otherwise(V.OTHER_CATEGORY)
