"""Markup: titles, links, main text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weirstone.functions.fields import entities, strip_tags
from weirstone.functions.text import strip


def page_title(markup: Column, most: int = 80) -> Column:
    t = strip(entities(F.regexp_extract(markup, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return F.substring(strip(F.split(t, r"[_|—∷]", 2)[0]), 1, most)


def links(markup: Column) -> Column:
    """array<struct<href,text>> of anchors."""
    hrefs = F.regexp_extract_all(markup, F.lit(r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""), F.lit(1))
    texts = F.regexp_extract_all(markup, F.lit(r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""), F.lit(2))
    return F.zip_with(hrefs, texts, lambda h, t: F.struct(h.alias("href"), strip_tags(t).alias("text")))


def article_links(markup: Column, base: Column, least: int = 8, most: int = 130) -> Column:
    """Links that look like articles: title-like text, a page or date in the path, not another host; absolute, once each."""
    site = F.regexp_extract(base, r"^([A-Za-z]+://[^/]+)", 1)
    whole = F.transform(links(markup), lambda a: F.struct(absolute(a["href"], base).alias("href"), a["text"].alias("text")))
    return F.array_distinct(F.filter(whole, lambda a: F.length(a["text"]).between(least, most) & a["href"].startswith(site) & a["href"].rlike(r"(?i)\.s?html?$|/\d{4}[-/]?\d{2}|[?&]\w+=\w+")))


def absolute(href: Column, base: Column) -> Column:
    root = F.regexp_extract(base, r"^([A-Za-z]+://[^/]+)", 1)
    folder = F.concat(F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^([A-Za-z]+://[^/]+(?:/[^/]+)*)/[^/]*$", 1))
    return F.when(href.rlike(r"^[A-Za-z][\w+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z]+:)", 1), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(F.when(folder != "", folder).otherwise(root), F.lit("/"), F.regexp_replace(href, r"^\./", "")))


def file_links(markup: Column, ending: str = "pdf") -> Column:
    """Addresses of files with the ending: in href, else anywhere in quotes; once each."""
    a = F.array_distinct(F.regexp_extract_all(markup, F.lit(rf"""(?i)href\s*=\s*["']([^"']+\.{ending})(?:[?#][^"']*)?["']"""), F.lit(1)))
    b = F.array_distinct(F.regexp_extract_all(markup, F.lit(rf"""(?i)["']([^"'\s]+\.{ending})["']"""), F.lit(1)))
    return F.when(F.size(a) > 0, a).otherwise(b)


def image_links(markup: Column, base: Column, unwanted: str, most: int = 8) -> Column:
    """Absolute addresses of images, once each; ``unwanted`` is a pattern of addresses to leave out."""
    src = F.regexp_extract_all(markup, F.lit(r"""(?i)<img\b[^>]*?src\s*=\s*["']([^"']+)["']"""), F.lit(1))
    return F.slice(F.array_distinct(F.transform(F.filter(src, lambda s: ~s.rlike(unwanted)), lambda s: absolute(s, base))), 1, most)


def original_links(markup: Column, base: Column, words: str, paths: str, most: int = 6) -> Column:
    """Absolute addresses of links to an original document: words in the text of the link, or a pattern of its path."""
    hit = F.filter(links(markup), lambda a: a["text"].rlike(words) | a["href"].rlike(paths))
    return F.slice(F.array_distinct(F.transform(hit, lambda a: absolute(a["href"], base))), 1, most)


def page_lines(markup: Column, least: int = 12, most: int = 400) -> Column:
    """The text between tags in lines of ``least`` characters or more, at most ``most`` of them."""
    x = F.regexp_replace(markup, r"(?is)<!--.*?-->|<(script|style|head|noscript)\b.*?</\1\s*>", "")
    lines = F.transform(F.split(entities(F.regexp_replace(x, r"(?s)<[^>]*>", "\n")), "\n"), strip)
    return F.array_join(F.slice(F.filter(lines, lambda s: F.length(s) >= least), 1, most), "\n")


def run_text(markup: Column, noise: str, least: int = 4, line: int = 15) -> Column:
    """Text between tags, run by run: noise and short runs out; the longer runs where there are any, else all."""
    x = F.regexp_replace(markup, r"(?is)<!--.*?-->|<(script|style|head|noscript)\b.*?</\1\s*>", " ")
    runs = F.filter(F.transform(F.regexp_extract_all(x, F.lit(r"(?s)>([^<]+)<"), F.lit(1)), lambda t: strip(F.regexp_replace(entities(t), r"(?U)\s+", " "))), lambda t: (F.length(t) >= least) & ~t.rlike(noise))
    long = F.filter(runs, lambda t: F.length(t) >= line)
    return F.array_join(F.when(F.size(long) > 0, long).otherwise(runs), "\n")


_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SKIP = {"script", "style", "head", "noscript"}


class _Blocks(HTMLParser):
    """Text of each element whose id or class names one of the keys; unclosed elements end with the page."""

    def __init__(self, keys: list[str]):
        super().__init__(convert_charrefs=True)
        self.keys, self.open, self.blocks, self.skip = keys, [], [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            self.handle_data("\n" if tag in ("br", "hr") else "")
            return
        if tag in _SKIP:
            self.skip += 1
        a = dict(attrs)
        hit = any(k in (a.get("class") or "") or k == a.get("id") for k in self.keys)
        self.open.append((tag, [] if hit else None))
        if tag in ("p", "div", "li", "tr", "h1", "h2", "h3"):
            self.handle_data("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag not in [t for t, _ in self.open]:
            return
        while self.open:
            t, text = self.open.pop()
            if t in _SKIP:
                self.skip -= 1
            if text is not None:
                self.blocks.append("".join(text))
            if t == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        for _, text in self.open:
            if text is not None:
                text.append(data)

    def finish(self) -> list[str]:
        self.close()
        return self.blocks + ["".join(t) for _, t in self.open if t is not None]


def container_text(keys: list[str], least: int = 300):
    """A pandas UDF: the longest text of an element named by ``keys`` if over ``least`` characters, else null. Tags must balance, which no expression can count."""

    @F.pandas_udf(StringType())
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda m: one(m, keys, least))

    return udf


def one(markup: str | None, keys: list[str], least: int) -> str | None:
    if not markup:
        return None
    p = _Blocks(keys)
    p.feed(markup)
    texts = ["\n".join(x for x in (re.sub(r"\s+", " ", y).strip() for y in b.split("\n")) if x) for b in p.finish()]
    best = max(texts, key=len, default="")
    return best if len(best) > least else None
