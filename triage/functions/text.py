"""Text normalisation and fuzzy brand match."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from triage import config


def normalized(text: Column) -> Column:
    """Lower case, anything but 0-9 and a-z as one space, trimmed. Letters that fold to ASCII do."""
    folded = F.replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss")), F.lit("ſ"), F.lit("s"))
    for ligature, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬆ", "st"), ("ﬅ", "st")):
        folded = F.replace(folded, F.lit(ligature), F.lit(letters))
    return F.trim(F.regexp_replace(folded, "[^0-9a-z]+", " "))


def compacted(text: Column) -> Column:
    return F.replace(normalized(text), F.lit(" "), F.lit(""))


def normalized_py(text: str) -> str:
    return re.sub("[^0-9a-z]+", " ", (text or "").casefold()).strip()


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of a at a time."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Similarity of 0 to 100: twice the common subsequence over both lengths."""
    return 100.0 * 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with any stretch of the longer one, its ends cut short included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    n, best = len(a), 0.0
    for i in range(1 - n, len(b)):
        best = max(best, ratio(a, b[max(0, i) : i + n]))
        if best == 100.0:
            break
    return best


def term_table(terms: Iterable[str]) -> pd.DataFrame:
    """nth, term, form, pattern: each term that has MIN_TEXT letters, in its spaced and its glued form."""
    forms = pd.DataFrame({"term": list(terms)}, dtype=object).rename_axis("nth").reset_index()
    forms["spaced"] = [normalized_py(t) for t in forms["term"]]
    forms["glued"] = [t.replace(" ", "") for t in forms["spaced"]]
    long = forms[forms["glued"].str.len() >= config.MIN_TEXT] if len(forms) else forms
    return long.melt(["nth", "term"], ["spaced", "glued"], "form", "pattern")


def best_terms(values: Iterable[str], table: pd.DataFrame) -> pd.DataFrame:
    """score and term of each distinct value, by value: the arg-max over the table, of equals the first term.

    A value at least as long as the pattern is searched for it, a shorter one
    compared whole. Short values and weak matches score (0, '').
    """
    texts = pd.DataFrame({"value": pd.unique(pd.Series(list(values), dtype=object))})
    texts["spaced"] = [normalized_py(v) for v in texts["value"]]
    texts["glued"] = [v.replace(" ", "") for v in texts["spaced"]]
    usable = texts[texts["glued"].map(len) >= config.MIN_TEXT]
    pairs = usable.melt(["value"], ["spaced", "glued"], "form", "text").merge(table, on="form")
    pairs["score"] = [(partial_ratio if len(v) >= len(p) else ratio)(p, v) for p, v in zip(pairs["pattern"], pairs["text"], strict=True)]
    top = pairs.sort_values(["score", "nth"], ascending=[False, True], kind="stable").drop_duplicates("value").set_index("value")[["score", "term"]]
    top = top[top["score"] >= config.MIN_FUZZ].reindex(texts["value"])
    return top.assign(score=top["score"].astype(float).fillna(0.0), term=top["term"].fillna(""))


def brand_match(text: Column, terms: Iterable[str]) -> Column:
    """struct<score, term> of the best term; a pandas UDF, as no built-in has this similarity."""
    table = term_table(terms)

    @F.pandas_udf("score double, term string")
    def match(values: pd.Series) -> pd.DataFrame:
        values = values.fillna("")
        return best_terms(values, table).loc[values].reset_index(drop=True)

    return match(text)
