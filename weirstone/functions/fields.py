"""Field normalisation: addresses, titles, keys, markup, codes. All Catalyst expressions; vocabularies are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weirstone.functions.text import SPACES, strip

# Fixed value: the class of characters that don't count when titles are compared (white space of all scripts by the flag).
TITLE_MARKS = r"(?U)[\s《》〈〉【】\[\]()（）\"'“”‘’·、,，。.：:;；!！?？—\-_/\\]+"


def remap(value: Column, mapping: dict[str, str]) -> Column:
    """Listed values renamed, all others as they are."""
    out = value
    for old, new in mapping.items():
        out = F.when(value == old, new).otherwise(out)
    return out


def clamp(value: Column, allowed: list[str], other: str) -> Column:
    """Values outside the list, null included, become ``other``."""
    return F.when(value.isin(allowed), value).otherwise(F.lit(other))


def url_key(url: Column) -> Column:
    """Address for comparison; the query stays, since it can name the page."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "/+$", ""))


def url_comparable(url: Column) -> Column:
    """An address without a query can be compared safely; null and empty can't."""
    return F.coalesce((url_key(url) != "") & ~url.contains("?"), F.lit(False))


def url_page(url: Column) -> Column:
    """Address up to the query or fragment."""
    return F.regexp_replace(F.trim(url), r"[?#].*$", "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]+)", 1))


def repair_doi(url: Column, resolver: str = r"doi\.(?:org|example)") -> Column:
    """A repeated resolver prefix collapsed to one; applying it twice changes nothing."""
    return F.regexp_replace(url, rf"^(?:https?://(?:dx\.)?{resolver}/)+(https?://(?:dx\.)?{resolver}/)", "$1")


def doi_of(url: Column) -> Column:
    """Like ``bare_doi`` for addresses in which the identifier is escaped."""
    return bare_doi(F.coalesce(F.try_url_decode(url), url))


def bare_doi(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"(10\.\d{4,9}/[^\s?#]+)", 1), r"\.+$", "")


def title_key(title: Column) -> Column:
    return F.lower(F.regexp_replace(title, TITLE_MARKS, ""))


def title_unspaced(title: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(F.coalesce(title, F.lit("")), f"[{SPACES}]+", "")


def title_unbracketed(title: Column) -> Column:
    """Without white space and brackets."""
    return F.regexp_replace(F.coalesce(title, F.lit("")), rf"[{SPACES}《》（）()【】\[\]]", "")


def title_letters(title: Column) -> Column:
    """Chinese characters, Latin letters and figures only."""
    return F.regexp_replace(F.coalesce(title, F.lit("")), r"[^\x{4e00}-\x{9fff}A-Za-z0-9]+", "")


def standard_name(name: Column, code: str) -> Column:
    """Letters of a standard's name, remarks in round brackets and codes (``code``, a pattern) taken out, in lower case."""
    return F.lower(title_letters(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[（(].{0,30}?[)）]", ""), code, " ")))


def standard_title(name: Column, replaced: str = "代替|替代") -> Column:
    """The name up to the note of what it replaces, white space squeezed, without brackets at its ends."""
    x = F.split(strip(F.coalesce(name, F.lit(""))), replaced, 2)[0]
    return F.regexp_replace(F.regexp_replace(x, f"[{SPACES}]+", " "), "^[ 《》]+|[ 《》]+$", "")


def standard_code(name: Column, code: str, prefix: str) -> Column:
    """The first code of the name (not of what it replaces), dashes made equal, one blank behind its prefix."""
    c = F.regexp_replace(F.translate(F.regexp_extract(standard_title(name), code, 0), "－—–", "---"), f"[{SPACES}]+", "")
    return F.regexp_replace(c, rf"^({prefix})(?=[0-9])", "$1 ")


def document_query(title: Column, news: str, endings: str) -> Column:
    """The name of a document that a title is about: what stands in 《》, else the title without news words, remarks, endings and the part before a colon."""
    named = F.regexp_extract(title, "《([^》]{4,60})》", 1)
    t = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), news, ""), r"[（(【\[].*?[)）】\]]", "")
    t = F.regexp_replace(F.regexp_replace(t, f"({endings})$", ""), f"^.{{0,12}}?[：:·｜|][{SPACES}]*", "")
    return F.when(named != "", named).otherwise(F.substring(strip(F.regexp_replace(t, f"[{SPACES}“”\"'《》]+", "")), 1, 60))


def cleaned_terms(terms: Column, noise: str, most: int = 14) -> Column:
    """Without names of disciplines (``noise``), Latin phrases, years, single characters and repetitions; the first ``most``."""
    t = F.transform(F.coalesce(terms, F.array().cast("array<string>")), strip)
    return F.slice(F.array_distinct(F.filter(t, lambda x: (F.length(x) > 1) & ~x.rlike(noise) & ~x.rlike(r"^[A-Za-z][A-Za-z\s\-&/]{2,}$") & ~x.rlike(r"^\d{4}$"))), 1, most)


def restamped(added: Column, date: Column, today: str, before: str) -> Column:
    """Rows added ``today`` whose date is before ``before`` count as added on their date."""
    return F.when((added == today) & (date < before), date).otherwise(added)


def first_name(*names: Column) -> Column:
    """The first name that isn't blank, stripped."""
    return F.coalesce(*[F.nullif(strip(n), F.lit("")) for n in names])


def standard_summary(name: Column, code: Column, effect: Column, text: Column, file: Column, page: Column, unknown: str = "-") -> Column:
    """One of four sentences on a standard, by what there is of it: the text of its file, the file, a page of more than 300 characters, nothing."""
    tail = F.concat(F.coalesce(F.nullif(code, F.lit("")), F.lit(unknown)), F.when(F.coalesce(effect, F.lit("")) != "", F.format_string("，%s 起实施", effect)).otherwise(""))
    title = standard_title(name)
    return (
        F.when(F.coalesce(text, F.lit("")) != "", F.format_string("《%s》全文 %d 字（%s）：%s", title, F.length(text), tail, F.substring(squeezed(join_cjk(text)), 1, 200)))
        .when(F.coalesce(file, F.lit("")) != "", F.format_string("《%s》原件 %s（%s）", title, file, tail))
        .when(F.length(page) > 300, F.format_string("《%s》页面文本 %d 字（%s）", title, F.length(page), tail))
        .otherwise(F.format_string("《%s》条目（%s）", title, tail))
    )


def squeezed(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"[{SPACES}]+", " "))


def event_key(title: Column) -> Column:
    return F.concat(F.lit("ti:"), F.substring(F.sha1(title_key(title)), 1, 16))


def record_id(url: Column, title: Column, date: Column) -> Column:
    """16 hex digits of the address, or of title and date where there is none."""
    bare = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    return F.substring(F.sha1(F.when(bare != "", bare).otherwise(F.concat(F.coalesce(title, F.lit("")), F.lit("|"), F.coalesce(date, F.lit(""))))), 1, 16)


def sanitize(text: Column) -> Column:
    """Control characters taken out; line feed and tab stay."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f\x{d800}-\x{dfff}]", "")


def sanitize_all(values: Column) -> Column:
    return F.transform(values, sanitize)


# The markup entities that are resolved.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&middot;": "·", "&amp;": "&"}


def entities(text: Column) -> Column:
    for name, ch in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(ch))
    return text


def strip_tags(markup: Column) -> Column:
    """Text of markup, scripts and styles left out, white space squeezed."""
    x = F.regexp_replace(markup, r"(?is)<!--.*?-->|<(script|style|head|noscript)\b.*?</\1\s*>", " ")
    x = entities(F.regexp_replace(x, r"(?s)<[^>]*>", " "))
    return strip(F.regexp_replace(x, f"[{SPACES}]+", " "))


def inline_text(markup: Column) -> Column:
    """Text with tags inside words (marks of search hits) taken out without a trace, white space squeezed."""
    return strip(F.regexp_replace(entities(F.regexp_replace(markup, r"(?s)<[^>]+>", "")), f"[{SPACES}]+", " "))


def join_cjk(text: Column) -> Column:
    """Single blanks between Chinese characters, left by extraction, taken out; runs of blanks and of line feeds squeezed."""
    x = F.regexp_replace(text, r"(?<=[\x{4e00}-\x{9fff}]) (?=[\x{4e00}-\x{9fff}])", "")
    return strip(F.regexp_replace(F.regexp_replace(x, r"[ \t\x{3000}]{2,}", " "), r"\n{2,}", "\n"))


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def deinvert(index: Column) -> Column:
    """Text of a map word -> positions; ties by word."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def first_match(text: Column, patterns: list[str], group: int = 0) -> Column:
    """The first pattern, in order, that is found; null if none is."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in patterns])


def date_of_path(url: Column) -> Column:
    """A date written in an address: tYYYYMMDD, YYYY-MM or YYYYMM (day 01), /YYYY/ (January 1)."""
    day, month, year = r"t((?:19|20)\d{6})", r"/((?:19|20)\d\d)-?(0[1-9]|1[0-2])/", r"/((?:19|20)\d\d)/"
    d = F.regexp_extract(url, day, 1)
    return F.coalesce(
        F.when(d != "", F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))),
        F.when(url.rlike(month), F.concat(F.regexp_extract(url, month, 1), F.lit("-"), F.regexp_extract(url, month, 2), F.lit("-01"))),
        F.when(url.rlike(year), F.concat(F.regexp_extract(url, year, 1), F.lit("-01-01"))),
    )


def sentences(text: Column, cjk: bool = True) -> Column:
    """Sentences of four characters or more; ``cjk`` drops all white space first and knows only Chinese stops."""
    if cjk:
        parts = F.split(F.regexp_replace(text, f"[{SPACES}]+", ""), r"(?<=[。！？；])")
    else:
        parts = F.transform(F.split(text, r"(?<=[.!?。！？；\n])"), strip)
    return F.filter(parts, lambda s: F.length(s) >= 4)


def make_summary(text: Column, most: int = 200) -> Column:
    """Whole sentences as long as they fit, else the beginning."""
    folded = F.aggregate(
        sentences(text), F.struct(F.lit("").alias("t"), F.lit(False).alias("full")),
        lambda a, s: F.when(a["full"] | (F.length(a["t"]) + F.length(s) > most), F.struct(a["t"].alias("t"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(a["t"], s).alias("t"), F.lit(False).alias("full"))),
        lambda a: a["t"],
    )
    return F.when(folded != "", folded).otherwise(F.substring(F.regexp_replace(text, f"[{SPACES}]+", ""), 1, most))


def chunks(text: Column, most: int = 320, cjk: bool = True) -> Column:
    """Greedy runs of sentences up to ``most`` characters; a run of several sentences lends its last to the next.

    Without ``cjk`` a line feed stands between sentences, so that words of two lines don't grow together; it isn't counted.
    """
    between = "" if cjk else "\n"
    none = F.array().cast("array<string>")
    folded = F.aggregate(
        sentences(text, cjk), F.struct(none.alias("out"), none.alias("cur"), F.lit(0).alias("n")),
        lambda a, s: F.when(
            (F.size(a["cur"]) > 0) & (a["n"] + F.length(s) > most),
            F.struct(
                F.concat(a["out"], F.array(F.array_join(a["cur"], between))).alias("out"),
                F.when(F.size(a["cur"]) > 1, F.array(F.element_at(a["cur"], -1), s)).otherwise(F.array(s)).alias("cur"),
                (F.when(F.size(a["cur"]) > 1, F.length(F.element_at(a["cur"], -1))).otherwise(0) + F.length(s)).alias("n"),
            ),
        ).otherwise(F.struct(a["out"].alias("out"), F.concat(a["cur"], F.array(s)).alias("cur"), (a["n"] + F.length(s)).alias("n"))),
        lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["out"], F.array(F.array_join(a["cur"], between)))).otherwise(a["out"]),
    )
    # Through a lambda, so that the fold is run once.
    return F.element_at(F.transform(F.array(folded), lambda x: F.when(F.size(x) > 0, x).when(F.length(text) > 0, F.array(text)).otherwise(none)), 1)


def tokens(text: Column) -> Column:
    """Latin words and figures first, then bigrams of each run of Chinese characters (a single one alone)."""
    low = F.lower(text)
    runs = F.regexp_extract_all(low, F.lit(r"[\x{4e00}-\x{9fff}]+"), F.lit(0))
    grams = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: r.substr(i, F.lit(2))))))
    return F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), grams)
