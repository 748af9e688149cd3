"""Scores of records: relevance, timeliness, importance, validity of full text, completeness, similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from weirstone.functions.fields import sentences, title_key
from weirstone.operators.lexicon import distinct_hits, total_hits


def relevance(title: Column, text: Column, core: list[str], support: list[str]) -> Column:
    """1 for a core term in the title, else 0.3 to 1 by weighted occurrences."""
    raw = total_hits(text, core) + total_hits(text, support) * 0.4
    return F.when(distinct_hits(title, core) > 0, 1.0).when(raw >= 4, 1.0).when(raw <= 0, 0.3).otherwise(F.round(0.3 + 0.7 * raw / 4, 2))


def downgraded(quality: Column, rel: Column) -> Column:
    """A, B or C lowered by two steps below 0.35, by one below 0.6; C at least."""
    level = F.when(quality == "A", 0).when(quality == "B", 1).otherwise(2)
    return F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.least(level + F.when(rel < 0.35, 2).when(rel < 0.6, 1).otherwise(0), F.lit(2)) + 1)


def timeliness(date: Column, as_of: str) -> Column:
    """2 within a year, 1 within two, else 0; unreadable dates 0."""
    days = F.datediff(F.lit(as_of).cast("date"), F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), date).try_cast("date"))
    return F.when(days <= 365, 2).when(days <= 730, 1).otherwise(0)


def importance(weight: Column, quality: Column, timely: Column, rel: Column) -> Column:
    q = F.when(quality == "A", 3).when(quality == "B", 2).otherwise(1)
    return F.round((weight + q * 0.7 + timely) * (rel * 0.6 + 0.4), 2)


def title_parts(title: Column, most: int = 24) -> Column:
    """Runs of letters, figures or Chinese of two or more; long ones also by threes; distinct, at most ``most``."""
    runs = F.filter(F.regexp_extract_all(F.lower(title), F.lit(r"[a-z0-9\x{4e00}-\x{9fff}]+"), F.lit(0)), lambda r: F.length(r) >= 2)
    cut = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) < 6, F.array(r)).otherwise(F.concat(F.array(r), F.transform(F.sequence(F.lit(1), F.length(r) - 2, F.lit(3)), lambda i: r.substr(i, F.lit(3)))))))
    return F.slice(F.array_distinct(cut), 1, most)


def validity(title: Column, content: Column, error_marks: list[str], risk_marks: list[str], least: int = 600) -> Column:
    """Why a full text can't be used, in this order: empty, error_page, risk_page, too_short, not_chinese, title_mismatch; else ok."""
    text = F.coalesce(content, F.lit(""))
    chinese = F.length(F.regexp_replace(text, r"[^\x{4e00}-\x{9fff}]", ""))
    parts = title_parts(title)
    hit = F.size(F.filter(parts, lambda p: F.lower(text).contains(p)))
    out = F.when((F.size(parts) > 0) & (hit / F.size(parts) < 0.34), "title_mismatch").otherwise("ok")
    out = F.when(title.rlike(r"[\x{4e00}-\x{9fff}]") & (chinese / F.length(text) < 0.25), "not_chinese").otherwise(out)
    out = F.when(F.length(text) < least, F.concat(F.lit("too_short:"), F.length(text))).otherwise(out)
    for kind, marks in (("risk_page", risk_marks), ("error_page", error_marks)):
        for m in reversed(marks):
            out = F.when(text.contains(m), f"{kind}:{m}").otherwise(out)
    return F.when(F.regexp_replace(text, r"\s+", "") == "", "empty").otherwise(out)


def articles(text: Column, pattern: str) -> Column:
    """Distinct numbered articles."""
    return F.size(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))))


@F.pandas_udf(DoubleType())
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of letters and figures; containment counts 0.85 at least; null without text."""
    from difflib import SequenceMatcher

    def one(x: str | None, y: str | None) -> float | None:
        if not x or not y:
            return None
        x, y = ("".join(c for c in s.lower() if c.isalnum()) for s in (x, y))
        r = SequenceMatcher(None, x, y, autojunk=False).ratio() if x and y else 0.0
        return max(r, 0.85) if x and y and (x in y or y in x) else r

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def overlap(a: Column, b: Column) -> Column:
    """Distinct tokens in both arrays."""
    return F.size(F.array_intersect(a, b))


def named_documents(title: Column, least: int = 6) -> Column:
    """Letters of the documents a title names in 《》, those of ``least`` letters or more."""
    names = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit("《([^》]{4,60})》"), F.lit(1))
    return F.filter(F.transform(names, lambda x: F.regexp_replace(x, r"[^\x{4e00}-\x{9fff}A-Za-z0-9]+", "")), lambda x: F.length(x) >= least)


def origin_score(title: Column, candidate: Column, match: Column, length: Column, authority: Column, is_file: Column, valid: Column, least: int = 600) -> Column:
    """How well a candidate serves as the original: 0 without a match of 0.45, ``least`` characters or a valid text, and where the title names
    documents none of which is the candidate (or only at a match below 0.8); else 0.4 authority + 0.3 completeness + 0.3 match, and 0.03 for a file."""
    own = F.regexp_replace(F.coalesce(candidate, F.lit("")), r"[^\x{4e00}-\x{9fff}A-Za-z0-9]+", "")
    named = named_documents(title)
    fits = (F.size(named) == 0) | (F.exists(named, lambda t: own.contains(t) | t.contains(own)) & (match >= 0.8))
    score = authority * 0.4 + F.least(F.lit(1.0), length / 4000.0) * 0.3 + match * 0.3 + F.when(is_file, 0.03).otherwise(0.0)
    return F.when(fits & (match >= 0.45) & (length >= least) & valid, F.round(score, 3)).otherwise(0.0)


__all__ = ["articles", "distinct_hits", "downgraded", "importance", "named_documents", "origin_score", "overlap", "relevance", "sentences", "timeliness", "title_key", "title_parts", "title_similarity", "validity"]
