"""Labels of records: topics, levels, departments, regions, classes, tiers, tags. Rules are data of the caller; all are Catalyst expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirstone.functions.text import SPACES

#: No letter, figure or underline of any script: what ends a word.
NO_WORD = r"[^\p{L}\p{N}_]"


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def any_of(text: Column, terms: list[str]) -> Column:
    """Whether the text contains one of the terms; null counts as empty, no terms as no."""
    out = F.lit(False)
    for t in terms:
        out = out | blank(text).contains(t)
    return out


def word_pattern(term: str) -> str:
    """A pattern for the term as whole words, blanks in it of any width; the same in Java and RE2."""
    return f"(?i)(?:^|{NO_WORD})" + r"[ \t\n\r]+".join(re.escape(w).replace("\\-", "-") for w in term.split()) + f"(?:$|{NO_WORD})"


def has_word(text: Column, term: str) -> Column:
    return blank(text).rlike(word_pattern(term))


def first_group(text: Column, groups: dict[str, list[str]], default: Column) -> Column:
    """The first label with a term in the text."""
    out = default
    for label, terms in reversed(groups.items()):
        out = F.when(any_of(text, terms), label).otherwise(out)
    return out


def first_rule(text: Column, rules: list[tuple[str, str]], default: Column) -> Column:
    """The label of the first (label, pattern) that is found."""
    out = default
    for label, pattern in reversed(rules):
        out = F.when(blank(text).rlike(pattern), label).otherwise(out)
    return out


@dataclass
class Topic:
    """Core and weak terms of a topic, Chinese (as substrings) and English (as words)."""

    core: list[str] = field(default_factory=list)
    core_en: list[str] = field(default_factory=list)
    weak: list[str] = field(default_factory=list)
    weak_en: list[str] = field(default_factory=list)


#: Weights of a term in title, summary and content; scores from which on a topic is admitted, and is sure.
WEIGHTS = {"core": (4.0, 1.6, 0.9), "core_en": (3.2, 1.2, 0.6), "weak": (1.4, 0.5, 0.25), "weak_en": (1.0, 0.4, 0.2)}
KEEP, STRONG, SURE, OVERRIDE = 2.0, 6.0, 4.0, 9.9


def annotated_topics(df: DataFrame, key: str, title: str, summary: str, content: str, topics: dict[str, Topic], override: dict[str, list[str]], most: int = 3) -> DataFrame:
    """(key, topic, score, confidence, rank).

    The longest key of ``override`` in the title decides alone. Else each topic's terms are weighted by where
    they stand; admitted are topics with a core term in title or summary and KEEP points, with two core terms
    in the content alone and half as many again, or with STRONG points and no core term. Ties go to more core
    terms in title and summary, then to the order given. Blanks in the title don't count.
    """
    places = (F.regexp_replace(blank(F.col(title)), f"[{SPACES}]+", ""), blank(F.col(summary)), blank(F.col(content)))
    d = df.select(key, F.col(title).alias("_raw"), *[p.alias(f"_p{i}") for i, p in enumerate(places)])
    cols = []
    for o, (name, t) in enumerate(topics.items()):
        score, head, body = F.lit(0.0), F.lit(0), F.lit(0)
        for kind, weights in WEIGHTS.items():
            for term in dict.fromkeys(getattr(t, kind)):
                if kind.startswith("weak") and term in getattr(t, kind.replace("weak", "core")):
                    continue
                at = [has_word(F.col(f"_p{i}"), term) if kind.endswith("_en") else F.col(f"_p{i}").contains(term) for i in range(3)]
                for a, w in zip(at, weights):
                    score = score + F.when(a, w).otherwise(0.0)
                if kind.startswith("core"):
                    up = at[0] | at[1]
                    head, body = head + up.cast("int"), body + (at[2] & ~up).cast("int")
        cols.append(F.struct(F.round(score, 2).alias("score"), head.alias("head"), body.alias("body"), F.lit(o).alias("o"), F.lit(name).alias("topic")))
    given = F.lit(None).cast("array<string>")
    for k in sorted((k for k in override if k), key=lambda k: (len(k), k)):
        given = F.when(F.col("_raw").contains(k), F.array(*[F.lit(x) for x in override[k]])).otherwise(given)
    d = d.select(key, given.alias("given"), F.array(*cols).alias("all"))
    admitted = F.filter("all", lambda t: (t["score"] > 0) & (((t["head"] >= 1) & (t["score"] >= KEEP)) | ((t["head"] == 0) & (t["body"] >= 2) & (t["score"] >= KEEP * 1.5)) | ((t["head"] == 0) & (t["body"] == 0) & (t["score"] >= STRONG))))
    ordered = F.transform(F.array_sort(F.transform(admitted, lambda t: F.struct((-t["score"]).alias("s"), (-t["head"]).alias("h"), t["o"].alias("o"), t["topic"].alias("topic")))), lambda t: F.struct(t["topic"].alias("topic"), (-t["s"]).alias("score"), F.when(((-t["h"] >= 1) & (-t["s"] >= SURE)) | (-t["h"] >= 2), "high").otherwise("low").alias("confidence")))
    sure = F.transform("given", lambda t: F.struct(t.alias("topic"), F.lit(OVERRIDE).alias("score"), F.lit("high").alias("confidence")))
    out = F.when(F.col("given").isNotNull(), sure).otherwise(F.slice(ordered, 1, most))
    return d.select(key, F.posexplode(out).alias("p", "t")).select(key, "t.topic", "t.score", "t.confidence", (F.col("p") + 1).alias("rank"))


def level(current: Column, title: Column, known: list[str], rules: list[tuple[str, str]], academic: Column, paper: str, other: str) -> Column:
    """A level already in use stays; else the first rule on the title; papers; what stood there; ``other``."""
    rest = F.when(academic, paper).otherwise(F.coalesce(F.nullif(current, F.lit("")), F.lit(other)))
    return F.when(blank(current).isin(known), current).otherwise(first_rule(title, rules, rest))


def department(parts: list[Column], url: Column, terms: dict[str, list[str]], hosts: list[tuple[str, str]], current: Column, other: str) -> Column:
    """By terms in the joined parts, then by patterns of the address, then what stood there."""
    return first_group(F.concat_ws(" ", *[blank(p) for p in parts]), terms, first_rule(url, hosts, F.coalesce(F.nullif(current, F.lit("")), F.lit(other))))


def region(text: Column, url: Column, places: list[tuple[str, list[str], str]], academic: str, abroad: str, waters: list[str], basin: str, current: Column, other: str) -> Column:
    """The first (label, words, pattern of the address) that fits; then academic addresses, then names of waters, then what stood there."""
    out = F.when(any_of(text, waters), basin).otherwise(F.coalesce(F.nullif(current, F.lit("")), F.lit(other)))
    out = F.when(blank(url).rlike(academic), abroad).otherwise(out)
    for label, words, pattern in reversed(places):
        out = F.when(any_of(text, words) | blank(url).rlike(pattern), label).otherwise(out)
    return out


def knowledge_class(level: Column, text: Column, academic: Column, classes: list[tuple[str, list[str], list[str]]], research: str, other: str) -> Column:
    """The first (class, levels, words), in order of priority, that has the level or a word; academic addresses are ``research``."""
    out = F.lit(other)
    for name, levels, words in reversed(classes):
        out = F.when((blank(level) != "") & level.isin(levels) | any_of(text, words), name).otherwise(out)
    return F.when(academic, research).otherwise(out)


def content_class(academic: Column, level: Column, title: Column, summary: Column, category: Column, rules: dict) -> Column:
    """academic, policy_standard, report_bulletin, tech_method, case_practice, expert_org or news, in this order."""
    hay = F.concat(blank(title), F.lit(" "), blank(summary))
    out = F.when(any_of(hay, rules["expert"]) | blank(title).rlike(rules["body"]), "expert_org").otherwise("news")
    out = F.when(blank(category) == "tech", "tech_method").otherwise(out)
    out = F.when(any_of(hay, rules["borrow"]) & ~blank(title).rlike(rules["noise"]), "case_practice").otherwise(out)
    out = F.when(blank(level).isin(rules["guides"]), "tech_method").otherwise(out)
    out = F.when(blank(title).rlike(rules["report"]) | blank(level).isin(rules["reports"]), "report_bulletin").otherwise(out)
    return F.when(academic, "academic").otherwise(F.when(blank(level).isin(rules["policy"]), "policy_standard").otherwise(out))


def tier(journal: Column, reject: list[str], tiers: dict[str, list[str]], other: str = "ok") -> Column:
    """reject before the tiers in their order, by parts of the name in any case."""
    low = F.lower(blank(journal))
    return F.when(any_of(low, [x.lower() for x in reject if x]), "reject").otherwise(first_group(low, {k: [x.lower() for x in v if x] for k, v in tiers.items()}, F.lit(other)))


def authority(host: Column, rules: list[tuple[str, float, str]], default: tuple[float, str]) -> Column:
    """struct(score, label) of the first pattern that fits the host."""
    make = lambda s, n: F.struct(F.lit(float(s)).alias("score"), F.lit(n).alias("label"))
    out = make(*default)
    for pattern, score, label in reversed(rules):
        out = F.when(blank(host).rlike(pattern), make(score, label)).otherwise(out)
    return out


def importance_by_level(level: Column, category: Column, region: Column, title: Column, rel: Column, base: dict[str, float], regions: dict[str, float], issuers: str) -> Column:
    """0 to 10: a base by level (5 for literature, 5.5 for others), with additions for region, issuer and relevance."""
    b = F.when(category == "literature", 5.0).otherwise(5.5)
    for k, v in base.items():
        b = F.when(level == k, float(v)).otherwise(b)
    r = F.lit(0.0)
    for k, v in regions.items():
        r = F.when(region == k, float(v)).otherwise(r)
    total = b + r + F.when(blank(title).rlike(issuers), 0.3).otherwise(0.0) + F.coalesce(rel, F.lit(0.0)) * 0.3
    # Rounded twice, so that a sum a hair below a half counts as the half it stands for.
    return F.round(F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(10.0)), 6), 2)


def quality_by_level(level: Column, title: Column, quality: Column, first: list[str], second: list[str], signature: str, paper: str) -> Column:
    """A for the first levels or a signature in the title, B for the second; papers and others keep theirs, C without any."""
    kept = F.when(quality.isin("A", "B", "C"), quality).otherwise("C")
    out = F.when(level == paper, F.coalesce(F.nullif(quality, F.lit("")), F.lit("C"))).otherwise(kept)
    return F.when(blank(level).isin(first) | blank(title).rlike(signature), "A").otherwise(F.when(blank(level).isin(second), "B").otherwise(out))


def tags(df: DataFrame, key: str, text: Column, terms: list[str], stop: list[str], suffixes: str, most: int = 6) -> DataFrame:
    """(key, tag, rank): terms of the domain in their order; after them, up to ``most``, the record's most frequent pairs of letters that are no stop words and don't end a place name; ties as they come."""
    t = F.regexp_replace(blank(text), f"[{SPACES}]+", "")
    d = df.select(key, t.alias("_t"))
    own = F.array_compact(F.array(*[F.when(F.col("_t").contains(x), F.struct(F.lit(x).alias("tag"), F.lit(i).alias("i"))) for i, x in enumerate(dict.fromkeys(terms))]))
    listed = d.select(key, F.explode(own).alias("x")).select(key, "x.tag", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"), "x.i")
    pairs = d.select(key, F.posexplode(ingest_tokens(F.col("_t"))).alias("i", "tag")).where((F.length("tag") == 2) & ~F.col("tag").isin([*stop, *terms]) & ~F.substring("tag", 2, 1).isin(list(suffixes)))
    counted = pairs.groupBy(key, "tag").agg(F.count("*").alias("n"), F.min("i").alias("i")).select(key, "tag", F.lit(1).alias("kind"), "n", "i")
    w = Window.partitionBy(key).orderBy("kind", F.desc("n"), "i")
    return listed.unionByName(counted).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(key, "tag", "rank")


def _gapless_pairs(text: Column) -> Column:
    """Pairs of neighbouring Chinese characters, whatever stood between them left out."""
    c = F.array_join(F.regexp_extract_all(text, F.lit(r"[\x{4e00}-\x{9fff}]+"), F.lit(0)), "")
    return F.transform(F.array(c), lambda s: F.when(F.length(s) > 1, F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: s.substr(i, F.lit(2)))).otherwise(F.array().cast("array<string>")))[0]


def shard_tokens(text: Column) -> Column:
    """Pairs over all Chinese characters, then Latin words and figures of two letters or more, in lower case."""
    return F.concat(_gapless_pairs(blank(text)), F.regexp_extract_all(F.lower(blank(text)), F.lit("[a-z0-9]{2,}"), F.lit(0)))


def ingest_tokens(text: Column) -> Column:
    """Words of two letters or more in their case, blanks taken out before, then pairs over all Chinese characters."""
    t = F.regexp_replace(blank(text), f"[{SPACES}]+", "")
    return F.concat(F.regexp_extract_all(t, F.lit("[a-zA-Z0-9_]{2,}"), F.lit(0)), _gapless_pairs(t))


def priority(department: Column, groups: dict[str, list[str]]) -> Column:
    """The place, from 0, of the first group of terms found in the department; behind all of them where none is."""
    out = F.lit(len(groups))
    for i, terms in reversed(list(enumerate(groups.values()))):
        out = F.when(any_of(department, terms), i).otherwise(out)
    return out
