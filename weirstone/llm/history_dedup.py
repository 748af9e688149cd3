"""Problem 3: new batches against everything accepted before.

The history is an index in the shared folder, partitioned by a hash of the key: for each accepted record
its address key, title key and minwise band keys, and once per title the signature they come from. A batch computes its
own keys, probes only the buckets they fall into (their numbers are literals in the partition filter of the
scan, and within a bucket keys are sorted), verifies candidates and appends its keys with the items found.
Buckets are doubled when they hold more than FULL keys on average, so the bytes a batch reads follow
its own size and not that of the history. As an item is decided by the order of ``seq`` alone, several batches
may be probed at once with the same outcome.

Same address: scheme, www, host case, default port, fragment, closing slash, tracking parameters, escapes
and the spelling of a DOI are taken out. Same title: NFKC, lower case, letters and figures only, frames of
reposting taken off, the bracketed document number equal or missing on one side; or one slip of up to two
characters (one place where at most two characters differ) that touches neither figures nor place name.
Band keys hold the place name and all figures beside a minwise value of the title's bigrams, so a bucket
has the few titles of one place, and equal titles are folded before bands are joined: copies cost nothing.

Only keys that two records share go on to the steps behind: verification, links and items. A band
bucket of more than HOT titles isn't paired as a whole: its titles are paired where they agree in their first or
their last half, which titles one slip apart always do.

Links are joined to items by propagating the smallest ``seq`` between records and keys until nothing
changes, each round cut by a checkpoint.

Defined results: null, empty and non-address urls and titles shorter than 4 letters link nothing; ties
don't occur, ``seq`` being unique; repeated rows repeat the first one; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import parse_qsl, unquote, urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstone.sources.tables import cut, scratch

BANDS, SLIP = 6, 2
#: Fewest and most buckets of an index, keys in a bucket from which on their number is doubled, titles of a band key from which on it is split.
BUCKETS, MOST_BUCKETS, FULL, HOT = 64, 1 << 16, 100_000, 50
#: A table of at most so many rows (some MB) is broadcast; a larger one is joined by a shuffle. Names of sources that may be sent with a task.
BROADCAST_ROWS, MOST_SITES = 200_000, 100_000
# Query parameters that trace a visit and name no page.
_TRACKING = re.compile(r"^(?:utm_\w+|spm|from|isappinstalled|share\w*|fbclid|gclid|msclkid|yclid|mc_[ce]id|_ga|scm|ref|referrer|ref_src|weixin\w*|nsukey|wxshare\w*|timestamp|source|src|track\w*|trk|cmpid|campaign\w*)$", re.I)
# Words that end the name of a water body or place.
_WATER = "水库|湿地|江|河|湖|溪|湾|港|渠|海|岛|山|市|县|省|区"
_WATER_EN = "river|lake|stream|creek|bay|reservoir|wetland|basin|estuary|pond|canal|delta"
_REPOST = re.compile(r"^(?:[\[【(（]\s*(?:转|转载|转发|转帖|repost|fwd?|rt)\s*[\]】)）]|(?:转载|转发|repost|fwd|rt)\s*[:：])\s*", re.I)
_QUOTED = re.compile(r"^[《“\"「『‘'](.*)[》”\"」』’']$", re.S)
_NUMBERED = re.compile(r"[(（]\s*([^()（）]{0,24}[〔\[【(（]\s*(?:19|20)\d\d\s*[〕\]】)）]\s*第?\s*\d+\s*号)\s*[)）]")
_SEEDS = [(0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF for i in range(1, BANDS + 1)]


def _h(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def canonical_url(url: str | None) -> str | None:
    """The page an address names, or None."""
    u = unicodedata.normalize("NFKC", (url or "").strip())
    if not u:
        return None
    plain = u
    for _ in range(3):
        if (new := unquote(plain)) == plain:
            break
        plain = new
    if m := re.search(r"(?:^doi:\s*|doi\.[^/\s]+/|^)(10\.\d{4,9}/[^\s?#]+)", plain, re.I):
        return "doi:" + m.group(1).rstrip("/.").lower()
    if not re.match(r"^[A-Za-z][\w+.-]*://", u):
        u = "http://" + u.lstrip("/") if re.match(r"^(?://)?[\w-]+(?:\.[\w-]+)+(?:[:/?]|$)", u) else ""
    try:
        s = urlsplit(u)
        host, port = (s.hostname or "").lower(), s.port
    except ValueError:
        return None
    if not host:
        return None
    host = host.removeprefix("www.") + ("" if port in (None, 80, 443) else f":{port}")
    query = sorted((k, v) for k, v in parse_qsl(s.query, keep_blank_values=True) if not _TRACKING.match(k))
    path = re.sub(r"/{2,}", "/", unquote(s.path)).rstrip("/")
    path = re.sub(r"/(?:index|default)\.(?:s?html?|php|aspx?|jsp)$", "", path)
    if not path and not query:
        return None  # a home page names no item
    return host + path + "".join(f"|{k}={v}" for k, v in query)


def plain_title(title: str | None, sites: frozenset[str] = frozenset()) -> tuple[str, str, str, str]:
    """(letters and figures of the title, its document number, place name, figures)."""
    t = unicodedata.normalize("NFKC", title or "").strip()
    old = None
    while old != t:  # frames may be nested in any order
        old = t
        t = _REPOST.sub("", t).strip().strip("。.!！ ")
        if m := _QUOTED.match(t):
            t = m.group(1).strip()
        for sep in re.finditer(r"\s*[_|｜丨]\s*|\s+[-–—]+\s+|\s*——?\s*", t):
            if _letters(t[sep.end() :]) in sites:
                t = t[: sep.start()].strip()
                break
    number = ""
    if m := _NUMBERED.search(t):
        number, t = _letters(m.group(1)), t[: m.start()] + t[m.end() :]
    place = ""
    if m := re.search(rf"([一-鿿]{{3}})({_WATER})", t):
        place = m.group(0)
    elif m := re.search(rf"([a-z]{{3,}})\s*({_WATER_EN})\b", t.lower()):
        place = m.group(1) + m.group(2)
    return _letters(t), number, place, " ".join(re.findall(r"\d+", t))


def _letters(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", s).lower() if c.isalnum())


def same_but_for_a_slip(a: str, b: str, most: int = SLIP) -> bool:
    """One place where at most ``most`` characters were wrong, missing, extra or swapped, and no figures."""
    if abs(len(a) - len(b)) > most:
        return False
    n = min(len(a), len(b))
    p = 0
    while p < n and a[p] == b[p]:
        p += 1
    e = 0
    while e < n - p and a[-1 - e] == b[-1 - e]:
        e += 1
    x, y = a[p : len(a) - e], b[p : len(b) - e]
    if any(c.isdigit() for c in x + y):
        return False
    return max(len(x), len(y)) <= most or len(x) == len(y) == 3 and x[0] == y[2] and x[1] == y[1] and x[2] == y[0] or len(x) == len(y) and sorted(x) == sorted(y) and len(x) <= most + 1


def keys(df: DataFrame, sites: frozenset[str], key: str = "seq", url: str = "url", title: str = "title") -> DataFrame:
    """(seq, u, t, base, number, place, figures, sig): null where a record has no address or title."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = np.array(_SEEDS, np.uint64)[:, None]
        for b in batches:
            out: dict[str, list] = {n: [] for n in ("u", "t", "base", "number", "place", "figures", "sig")}
            for u, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                c = canonical_url(u)
                base, number, place, figures = plain_title(t, sites)
                out["u"].append(_h(c) if c else None)
                known = len(base) >= 4
                out["t"].append(_h(base + "\x01" + number) if known else None)
                for n, v in (("base", base), ("number", number), ("place", place), ("figures", figures)):
                    out[n].append(v if known else None)
                if known:
                    grams = np.array(sorted({xxhash.xxh3_64_intdigest(base[i : i + 2]) for i in range(len(base) - 1)}), np.uint64)
                    mixed = grams[None, :] * seeds
                    out["sig"].append(((mixed ^ (mixed >> np.uint64(31))).min(1) >> np.uint64(1)).astype(np.int64).tolist())
                else:
                    out["sig"].append(None)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(v, k) for v, k in zip(out.values(), kinds))], names=["seq", *out])

    return df.select(F.col(key).cast("long").alias("seq"), url, title).mapInArrow(work, "seq bigint, u bigint, t bigint, base string, number string, place string, figures string, sig array<bigint>")


def _entries(k: DataFrame) -> DataFrame:
    """Key rows (kind, h, seq, t, bare): kind 'u', 't' (title with number), 'b' (title without), '0'.. (bands)."""
    place = F.col("place")
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.cast("string").alias("kind"), F.xxhash64(i, F.element_at("sig", i + 1), place, F.col("figures"), F.when(place == "", F.element_at("sig", F.pmod(i + 1, F.lit(BANDS)) + 1))).alias("h")))
    named = F.array(F.struct(F.lit("u").alias("kind"), F.col("u").alias("h")), F.struct(F.lit("t").alias("kind"), F.col("t").alias("h")), F.struct(F.lit("b").alias("kind"), _words(F.col("base")).alias("h")))
    e = k.withColumn("e", F.explode(F.when(F.col("sig").isNull(), F.slice(named, 1, 1)).otherwise(F.concat(named, bands)))).where("e.h is not null")
    return e.select("e.kind", "e.h", "seq", "t", (F.col("number") == "").alias("bare"))


def _titles(k: DataFrame, *by: str) -> DataFrame:
    """(by..., t, base, number, place, sig), one row per title."""
    return k.where("t is not null").groupBy(*by, "t").agg(*(F.first(c).alias(c) for c in ("base", "number", "place", "sig")))


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def _sized(df: DataFrame) -> DataFrame:
    """A written table, broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


class History:
    """The index of accepted records in a folder all executors share: key rows, and one signature row per title.

    A key row holds the item (the smallest ``seq``) its record was found to belong to, so that an item is
    known by its first record however it was reached. ``state`` names the generation in use and its number of
    buckets; a generation is written whole before it is named, so a writer that dies leaves the old one valid.
    """

    def __init__(self, spark: SparkSession, path: str, sites: frozenset[str] = frozenset(), full: int = FULL):
        self.spark, self.path, self.sites, self.full = spark, path, sites, full

    def _state(self) -> tuple[int, int, int] | None:
        """(generation, buckets, keys), the latest."""
        try:
            r = self.spark.read.schema("generation long, buckets int, keys long").parquet(f"{self.path}/state").agg(F.max(F.struct("generation", "keys", "buckets")).alias("m")).first().m
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return (r.generation, r.buckets, r["keys"])

    def _name(self, generation: int, buckets: int, keys: int) -> None:
        self.spark.range(1).select(F.lit(generation).cast("long").alias("generation"), F.lit(buckets).cast("int").alias("buckets"), F.lit(keys).cast("long").alias("keys")).write.mode("append").parquet(f"{self.path}/state")

    def _read(self, part: str, wanted: DataFrame, *on: str) -> DataFrame | None:
        """The rows of ``part`` whose key is in ``wanted``; only the buckets of those keys are read. The numbers of the buckets, at most MOST_BUCKETS, come to the driver."""
        state = self._state()
        if state is None:
            return None
        buckets = sorted(r[0] for r in wanted.select(_bucket(F.col(on[0]), state[1])).distinct().collect())
        return self.spark.read.parquet(f"{self.path}/{part}-{state[0]}").where(F.col("bucket").isin(buckets)).join(_sized(wanted), list(on), "left_semi").drop("bucket")

    def _write(self, part: str, generation: int, buckets: int, rows: DataFrame, key: str) -> None:
        rows.sortWithinPartitions("bucket", key).write.mode("append").partitionBy("bucket").parquet(f"{self.path}/{part}-{generation}")

    def _decide(self, new: DataFrame) -> DataFrame:
        """(seq, item) of every record of ``new`` (keys), against the index and each other."""
        mine = _entries(new)
        old = self._read("keys", cut(mine.select("h", "kind").distinct()), "h", "kind") if self._state() else None
        both = mine if old is None else cut(old).unionByName(mine)
        shared = cut(both.groupBy("kind", "h").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).where("lo < hi").select("kind", "h"))
        both = cut(both.join(_sized(shared), ["kind", "h"], "left_semi"))
        asked = cut(both.where("kind not in ('u', 't', 'b')").select("t").distinct())
        titles = _titles(new.join(_sized(asked), "t", "left_semi"))
        if old is not None:
            titles = titles.unionByName(self._read("titles", asked, "t"))
        titles = cut(titles.groupBy("t").agg(*(F.first(c).alias(c) for c in ("base", "number", "place", "sig"))))
        pairs = cut(_candidates(both, titles))
        words = both.where("kind = 'b'")
        if old is not None:
            some = cut(titles.where("number = ''").select(_words(F.col("base")).alias("h")).distinct())
            words = words.unionByName(self._read("keys", some, "h").where("kind = 'b'").select(*words.columns))
        words = cut(_folded(words))
        return _items(both, words, _slips(pairs, titles, words), new.select("seq"))

    def accept(self, df: DataFrame) -> DataFrame:
        """Decides the records of ``df`` and adds their keys; only new files are written. Gives what ``probe`` does."""
        new = cut(keys(df, self.sites))
        items = cut(self._decide(new))
        n, state = new.count() * (BANDS + 3), self._state()
        if state is None:
            state = (1, min(MOST_BUCKETS, max(BUCKETS, 1 << (max(1, n // self.full) - 1).bit_length())), 0)
        elif state[2] + n > state[1] * self.full and state[1] < MOST_BUCKETS:
            state = self._split(state, n)
        generation, buckets, held = state
        moved = cut(items.where("item < seq"))
        entries = _entries(new.join(_sized(moved), "seq", "left").withColumn("seq", F.coalesce("item", "seq")).drop("item"))
        self._write("keys", generation, buckets, entries.withColumn("bucket", _bucket(F.col("h"), buckets)).repartition("bucket").distinct(), "h")
        titles = new.where("t is not null").select("t", "base", "number", "place", "sig").withColumn("bucket", _bucket(F.col("t"), buckets))
        self._write("titles", generation, buckets, _titles(titles.repartition("bucket"), "bucket"), "t")
        self._name(generation, buckets, held + n)
        return _repeats(items)

    def _split(self, state: tuple[int, int, int], more: int) -> tuple[int, int, int]:
        """The index written anew with as many buckets as it needs; done each time it has doubled, so a key is rewritten once on average."""
        generation, buckets, held = state
        while buckets * self.full < held + more and buckets < MOST_BUCKETS:
            buckets *= 2
        for part, key in (("keys", "h"), ("titles", "t")):
            rows = self.spark.read.parquet(f"{self.path}/{part}-{generation}").withColumn("bucket", _bucket(F.col(key), buckets))
            self._write(part, generation + 1, buckets, rows.repartition("bucket"), key)
        self._name(generation + 1, buckets, held)
        return generation + 1, buckets, held

    def probe(self, df: DataFrame) -> DataFrame:
        """(seq_1, seq_2) of the records of ``df`` that repeat an item of the index or of an earlier record in ``df``."""
        return _repeats(self._decide(cut(keys(df, self.sites))))


def _repeats(items: DataFrame) -> DataFrame:
    return items.where("item < seq").select(F.col("item").alias("seq_1"), F.col("seq").alias("seq_2"))


def _words(base: Column) -> Column:
    return F.xxhash64(base, F.lit("b"))


def _folded(both: DataFrame) -> DataFrame:
    """(kind, h, t, first, bare): titles once each, with their first record."""
    return both.where("kind <> 'u'").groupBy("kind", "h", "t").agg(F.min("seq").alias("first"), F.first("bare").alias("bare"))


def _candidates(both: DataFrame, titles: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs (a, b) of different titles that share a band key, and in keys of more than ``hot`` titles a half as well."""
    bands = cut(_folded(both.where("kind not in ('u', 't', 'b')")).select("kind", "h", "t"))
    many = _sized(cut(bands.groupBy("kind", "h").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("kind", "h")))
    few = bands.join(many, ["kind", "h"], "left_anti").withColumn("half", F.lit(0).cast("long"))
    # Of titles one slip apart the first or the last halves are equal, for one of three neighbouring lengths of a half.
    n = F.length("base")
    size = F.explode(F.sequence(F.greatest(F.floor((n - SLIP) / 2), F.lit(1)), F.greatest(F.floor(n / 2), F.lit(1)))).alias("size")
    halves = bands.join(many, ["kind", "h"], "left_semi").join(titles.select("t", "base"), "t").select("kind", "h", "t", "base", size)
    halves = halves.select("kind", "h", "t", F.explode(F.array(F.xxhash64(F.expr("left(base, cast(size as int))"), F.lit("first")), F.xxhash64(F.expr("right(base, cast(size as int))"), F.lit("last")))).alias("half"))
    each = few.unionByName(halves)
    return each.withColumnRenamed("t", "a").join(each.withColumnRenamed("t", "b"), ["kind", "h", "half"]).where("a < b").select("a", "b").distinct()


def _slips(pairs: DataFrame, titles: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs whose signatures agree enough, whose place and number fit, and that are one slip apart.

    A missing number fits any, but not where the same words stand with a number too: then that title is the one to compare with.
    """
    taken = words.join(words.where("not bare").select("h").distinct(), "h", "left_semi").where("bare").select("t")
    titles = titles.join(taken.withColumn("gone", F.lit(True)), "t", "left").withColumn("number", F.when(F.col("gone"), "\x01").otherwise(F.col("number")))
    side = lambda c: titles.select(F.col("t").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("base", "number", "place", "sig")))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    agree = F.size(F.filter(F.zip_with("a_sig", "b_sig", lambda p, q: p == q), lambda e: e))
    j = j.where((agree >= 1) & (F.col("a_place") == F.col("b_place")) & ((F.col("a_number") == F.col("b_number")) | (F.col("a_number") == "") | (F.col("b_number") == ""))).select("a", "b", "a_base", "b_base")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = [same_but_for_a_slip(p, q) for p, q in zip(x.column(2).to_pylist(), x.column(3).to_pylist())]
            rows = x.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1)], names=["a", "b"])

    return j.mapInArrow(work, "a bigint, b bigint")


def _items(both: DataFrame, words: DataFrame, slips: DataFrame, asked: DataFrame) -> DataFrame:
    """(seq, item) of the records ``asked``."""
    # A title without its document number belongs to the first title that has the same words.
    first = words.groupBy("h").agg(F.min_by("t", "first").alias("a"))
    dropped = words.where("bare").join(first, "h").where("a <> t").select("a", F.col("t").alias("b"))
    last = words.where("bare").join(words.where("not bare").groupBy("h").agg(F.min_by("t", "first").alias("n")), "h").select(F.col("t").alias("a"), F.col("n").alias("b"))
    links = cut(dropped.unionByName(last).unionByName(slips).distinct())
    edges = both.where("kind = 'u'").select("seq", F.concat(F.lit("u"), "h").alias("k")).unionByName(both.where("t is not null").select("seq", F.concat(F.lit("t"), "t").alias("k")))
    # A link joins the key nodes of two titles through a record-like node of its own.
    edges = edges.unionByName(links.select((-F.abs(F.xxhash64("a", "b")) - 1).alias("seq"), F.explode(F.array(F.concat(F.lit("t"), "a"), F.concat(F.lit("t"), "b"))).alias("k"))).distinct()
    edges = cut(edges)
    big = F.lit((1 << 63) - 1)
    nodes = edges.select("seq").distinct().withColumn("item", F.when(F.col("seq") >= 0, F.col("seq")).otherwise(big))
    while True:
        per_key = edges.join(nodes, "seq").groupBy("k").agg(F.min("item").alias("item"))
        best = edges.join(per_key, "k").groupBy("seq").agg(F.min("item").alias("best"))
        after = cut(nodes.join(best, "seq").select("seq", F.least("item", "best").alias("item"), (F.col("best") < F.col("item")).alias("moved")))
        nodes = after.select("seq", "item")
        if after.where("moved").isEmpty():
            break
    return asked.join(nodes, "seq", "left").select("seq", F.coalesce("item", "seq").alias("item"))


def site_names(sites: DataFrame) -> frozenset[str]:
    """Names of the sources, as letters; the table of sources is a dimension of at most MOST_SITES names, which is checked."""
    names = [_letters(r[0]) for r in sites.select("name").where("name is not null").distinct().limit(MOST_SITES + 1).collect()]
    if len(names) > MOST_SITES:
        raise ValueError(f"more than {MOST_SITES} names of sources")
    return frozenset(names)


def against_history(history: DataFrame, inbox: DataFrame, sites: DataFrame) -> DataFrame:
    """(seq_1, seq_2) for all of ``inbox`` against ``history`` and itself: an index is built, then probed once."""
    spark = inbox.sparkSession
    index = History(spark, scratch(spark, "history"), site_names(sites))
    index.accept(history)
    return index.probe(inbox)


def batch_by_batch(history: DataFrame, inbox: DataFrame, sites: DataFrame, batch: str = "batch_id") -> DataFrame:
    """What ``against_history`` gives, each batch accepted on its own into an index that stays: (seq_1, seq_2). The numbers of the batches, few by nature, come to the driver."""
    spark = inbox.sparkSession
    index = History(spark, scratch(spark, "history"), site_names(sites))
    index.accept(history)
    parts = [index.accept(inbox.where(F.col(batch) == r[0])) for r in inbox.select(batch).distinct().orderBy(batch).collect()]
    return functools.reduce(DataFrame.unionByName, parts) if parts else index.probe(inbox)
