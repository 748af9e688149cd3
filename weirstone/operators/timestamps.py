"""Problem 7: mixed timestamp formats and zones to one unambiguous form.

Values are parsed by whole-value patterns into local calendar fields (all in Catalyst). Local times
without offset meet the zone's offset intervals in an as-of join: intervals are exploded to one row
per (zone, local year) holding the few intervals that touch that year, so the join is an equi-join
on a table of bounded size, and the match is made inside the row. Two matching intervals mean an
ambiguous time, none a nonexistent one, one gives the offset.

Defined results: null stays null (status ``null``); empty, incomplete, impossible or non-date values
get status ``unreadable`` and norm null; a null or unknown zone counts as UTC; a null or unknown
number order leaves day-month dates readable only where just one order is possible.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST_YEAR, LAST_YEAR = 1900, 2100
#: Bound of the tables that are broadcast: zones in the public zone database, links included.
MAX_ZONES = 700

# Month names and the two halves of the day.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
AM, PM = ["上午", "早上", "凌晨", "am"], ["下午", "晚上", "pm"]

_HALF = "上午|下午|早上|晚上|凌晨|[AaPp][Mm]"
_ZONE = r"[Zz]|(?:UTC|GMT)?[+\-−]\d{1,2}(?::?\d{2})?|[A-Za-z]{2,5}"
_TIME = (
    rf"(?:(?:\s*[T,]?\s*)(?:({_HALF})\s*)?(\d{{1,2}})[:时点](\d{{2}})(?:[:分](\d{{2}})?秒?(?:[.,](\d{{1,9}}))?)?分?"
    rf"\s*({_HALF})?\s*\(?({_ZONE})?\)?)?"
)
_DOW, _MON = r"(?:[A-Za-z]{3,9}\.?,?\s+)?", r"([A-Za-z]{3,9})\.?"
# Groups: y, m, d, half, h, mi, s, frac, half, zone.
_PATTERNS = [
    ("named", rf"^(\d{{4}})\s*([-/.年])\s*(\d{{1,2}})\s*[-/.月]\s*(\d{{1,2}})\s*日?{_TIME}$", "$1|$3|$4|$5|$6|$7|$8|$9|$10|$11"),
    ("compact", r"^((?:1\d|20|21)\d{2})(\d{2})(\d{2})(?:T?(\d{2})(\d{2})(\d{2})?)?(Z)?$", "$1|$2|$3||$4|$5|$6|||$7"),
    ("numeric", rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}){_TIME}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    ("day_month", rf"^{_DOW}(\d{{1,2}})(?:st|nd|rd|th)?[-\s]+{_MON}[-,\s]+(\d{{4}}){_TIME}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    ("month_day", rf"^{_DOW}{_MON}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){_TIME}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    ("clock", rf"^{_DOW}{_MON}\s+(\d{{1,2}})\s+(\d{{2}}):(\d{{2}}):(\d{{2}})(?:\.(\d{{1,9}}))?\s+(?:({_ZONE})\s+)?(\d{{4}})$", "$8|$1|$2||$3|$4|$5|$6||$7"),
]
_NORMAL_DAY, _NORMAL_INSTANT = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z$"
_FULL = "".join(chr(0xFF01 + i) for i in range(94)) + "　 "
_HALFW = "".join(chr(0x21 + i) for i in range(94)) + "  "


def _intervals_of(zone: str) -> list[tuple[int, int, int, str]]:
    """(UTC start, UTC end, offset, abbreviation) in seconds, found by bisection between probes."""
    from zoneinfo import ZoneInfo

    tz, step = ZoneInfo(zone), timedelta(days=7)
    at, end = datetime(FIRST_YEAR, 1, 1, tzinfo=UTC), datetime(LAST_YEAR + 1, 1, 1, tzinfo=UTC)
    state = lambda t: (int(t.astimezone(tz).utcoffset().total_seconds()), t.astimezone(tz).tzname())
    out, start, now = [], at, state(at)
    while at < end:
        after = min(at + step, end)
        if state(after) != now:
            lo, hi = int(at.timestamp()), int(after.timestamp())
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if state(datetime.fromtimestamp(mid, UTC)) == now else (lo, mid)
            at = datetime.fromtimestamp(hi, UTC)
            out.append((int(start.timestamp()), hi, *now))
            start, now = at, state(at)
        else:
            at = after
    return [*out, (int(start.timestamp()), int(end.timestamp()), *now)]


def zone_intervals(zones: DataFrame) -> DataFrame:
    """zones(tz) -> (tz, year, spans array<struct<lo,hi,off>>, names map<abbreviation,offset>).

    ``lo``/``hi`` are local seconds since 1970; a year holds each interval that touches it or the days
    around it. At most MAX_ZONES x 201 rows. Unknown zones give no row.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for tz in b["tz"]:
                try:
                    spans = _intervals_of(tz)
                except Exception:  # not a zone: no row
                    continue
                names = {n.upper(): o for _, _, o, n in spans if n and n[0].isalpha()}
                per: dict[int, list] = {}
                for i, (lo, hi, off, _) in enumerate(spans):
                    before = spans[i - 1][2] if i else off
                    y0, y1 = (datetime.fromtimestamp(t, UTC).year for t in (lo - 2 * 86400, hi + 2 * 86400))
                    for y in range(max(FIRST_YEAR, y0), min(LAST_YEAR, y1) + 1):
                        per.setdefault(y, []).append({"lo": lo + off, "hi": hi + off, "off": off, "before": before})
                yield pd.DataFrame({"tz": tz, "year": list(per), "spans": list(per.values()), "names": [names] * len(per)})

    schema = "tz string, year int, spans array<struct<lo:bigint,hi:bigint,off:bigint,before:bigint>>, names map<string,bigint>"
    return zones.select("tz").where("tz is not null").distinct().mapInPandas(make, schema)


def _clean(value: Column) -> Column:
    return F.regexp_replace(F.translate(value, _FULL, _HALFW), r"(?U)^\s+|\s+$", "")


def _parts(v: Column) -> Column:
    """'kind|y|m|d|half|h|mi|s|frac|half|zone' of the first pattern that fits the whole value, else null."""
    out = F.lit(None).cast("string")
    for kind, pattern, order in reversed(_PATTERNS):
        out = F.when(v.rlike(pattern), F.concat(F.lit(kind + "|"), F.regexp_replace(v, pattern, order))).otherwise(out)
    return F.split(out, r"\|")


def _month(x: Column) -> Column:
    names = F.array(*[F.lit(m) for m in MONTHS])
    word = F.lower(x)
    by_name = F.array_position(names, F.substring(word, 1, 3)).cast("int")
    return F.when(x.rlike(r"^\d+$"), x.try_cast("int")).otherwise(F.nullif(by_name, F.lit(0)))


def parse_local(df: DataFrame, value: str, order: str) -> DataFrame:
    """Adds struct ``_t``: micros (local or UTC since 1970), day (date), zone, kind ('day', 'local', 'instant')."""
    v = _clean(F.col(value))
    df = df.withColumn("_v", v).withColumn("_p", _parts(F.col("_v")))
    p = lambda i: F.col("_p")[i]
    n = lambda i: F.nullif(p(i), F.lit("")).try_cast("int")
    a, b = p(2).try_cast("int"), p(3).try_cast("int")
    swap = F.when(F.col(order) == "dmy", True).when(F.col(order) == "mdy", False).when((a > 12) & (b <= 12), True).when((b > 12) & (a <= 12), False)
    numeric = p(0) == "numeric"
    month = F.when(numeric, F.when(swap, b).when(~swap, a)).otherwise(_month(p(2)))
    day = F.when(numeric, F.when(swap, a).when(~swap, b)).otherwise(b)
    half = F.lower(F.coalesce(F.nullif(p(4), F.lit("")), F.nullif(p(9), F.lit(""))))
    df = df.withColumns({"_y": n(1), "_m": month, "_d": day, "_half": half, "_h": n(5), "_mi": n(6), "_s": F.coalesce(n(7), F.lit(0)), "_us": F.substring(F.rpad(p(8), 6, "0"), 1, 6).try_cast("long"), "_z": F.nullif(F.upper(F.translate(p(10), "−", "-")), F.lit(""))})
    first = F.when((F.col("_y") >= 1) & F.col("_m").between(1, 12), F.make_date("_y", "_m", F.lit(1)))
    date = F.when((F.col("_d") >= 1) & (F.col("_d") <= F.dayofmonth(F.last_day(first))), F.date_add(first, F.col("_d") - 1))
    hour = (
        F.when(F.col("_half").isNull(), F.col("_h"))
        .when(F.col("_half").isin(AM), F.when(F.col("_h") == 12, 0).when(F.col("_h") < 12, F.col("_h")))
        .otherwise(F.when(F.col("_h") < 12, F.col("_h") + 12).when(F.col("_h") < 24, F.col("_h")))
    )
    good = (hour.between(0, 23)) & F.col("_mi").between(0, 59) & F.col("_s").between(0, 59)
    secs = F.datediff(date, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + hour * 3600 + F.col("_mi") * 60 + F.col("_s")
    local = F.when(good, secs * 1000000 + F.coalesce("_us", F.lit(0)))
    whole = F.regexp_extract(F.col("_v"), r"^(\d{9,19})(?:\.\d*)?$", 1)
    frac = F.substring(F.rpad(F.regexp_extract(F.col("_v"), r"^\d{9,11}\.(\d*)$", 1), 6, "0"), 1, 6).try_cast("long")
    num = whole.try_cast("long")
    count = F.when(F.length(whole) <= 11, num * 1000000 + F.coalesce(frac, F.lit(0))).when(F.length(whole) <= 14, num * 1000).when(F.length(whole) <= 17, num).otherwise(F.expr("_n div 1000"))
    df = df.withColumn("_n", num).withColumns({"_local": local, "_count": F.when(whole != "", count), "_day": date})
    timed = F.col("_h").isNotNull()
    read = F.col("_p").isNotNull() & F.col("_day").isNotNull()
    kind = F.when(read & timed & F.col("_local").isNotNull(), F.when(F.col("_z").isNull(), "local").otherwise("zoned")).when(read & ~timed & F.col("_z").isNull(), "day").when(F.col("_count").isNotNull() & F.coalesce(p(0) != "compact", F.lit(True)), "count")
    out = F.struct(kind.alias("kind"), F.when(kind == "count", F.col("_count")).otherwise(F.col("_local")).alias("micros"), F.date_format("_day", "yyyy-MM-dd").alias("day"), F.col("_z").alias("zone"))
    return df.withColumn("_t", out).drop("_v", "_p", "_y", "_m", "_d", "_half", "_h", "_mi", "_s", "_us", "_z", "_n", "_local", "_count", "_day")


def _offset_text(z: Column) -> Column:
    """Seconds of '+08:00', '-0330', 'UTC+8', 'Z', 'UTC', 'GMT'; null for other names."""
    sign = F.when(z.contains("-"), -1).otherwise(1)
    h, m = (F.regexp_extract(z, r"^(?:UTC|GMT)?[+-](\d{1,2}):?(\d{2})?$", i) for i in (1, 2))
    return F.when(z.isin("Z", "UTC", "GMT", "UT"), F.lit(0)).when(h != "", sign * (h.try_cast("int") * 3600 + F.coalesce(F.nullif(m, F.lit("")).try_cast("int"), F.lit(0)) * 60)).cast("long")


def _render(micros: Column) -> Column:
    """ISO text of UTC micros without going through the session's zone."""
    sec, us = F.floor((micros - F.pmod(micros, F.lit(1000000))) / 1000000).cast("long"), F.pmod(micros, F.lit(1000000))
    sod = F.pmod(sec, F.lit(86400))
    day = F.date_add(F.lit("1970-01-01").cast("date"), ((sec - sod) / 86400).cast("int"))
    pad = lambda c, n=2: F.lpad(c.cast("string"), n, "0")
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), pad(F.floor(sod / 3600)), F.lit(":"), pad(F.floor(F.pmod(sod, F.lit(3600)) / 60)), F.lit(":"), pad(F.pmod(sod, F.lit(60))), F.lit("."), pad(us, 6), F.lit("Z"))


def normalise_times(df: DataFrame, sites: DataFrame, fields: list[str], key: str, source: str = "source") -> DataFrame:
    """(key, field, raw, norm, status) for every row of ``df`` and every field.

    status: null, normal (already in normal form), day, instant, ambiguous (two intervals; the
    earlier instant is taken), nonexistent (none; the offset before the change), unreadable.
    No shuffle: both sides joined are dimensions (sites by Catalyst's own size check, the intervals
    within MAX_ZONES x 201 rows).
    """
    zones = zone_intervals(sites)
    dim = sites.groupBy(F.col("name").alias("_name")).agg(F.min_by("tz", F.struct("tz", "date_order")).alias("_tz"), F.min_by("date_order", F.struct("tz", "date_order")).alias("_order"))
    long = (
        df.select(F.col(key), F.col(source).alias("_source"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("raw")) for f in fields])).alias("_f"))
        .select(key, "_source", "_f.field", "_f.raw")
        .join(dim, F.col("_source") == F.col("_name"), "left")
    )
    p = parse_local(long, "raw", "_order")
    p = p.withColumns({"_loc": F.expr("(_t.micros - pmod(_t.micros, 1000000)) div 1000000"), "_yr": F.year(F.col("_t.day").try_cast("date"))})
    z = F.broadcast(zones.select(F.col("tz").alias("_z_tz"), F.col("year").alias("_z_year"), "spans", "names"))
    j = p.join(z, (F.col("_tz") == F.col("_z_tz")) & (F.col("_yr") == F.col("_z_year")), "left")
    hit = F.filter("spans", lambda s: (s["lo"] <= F.col("_loc")) & (F.col("_loc") < s["hi"]))
    # In a gap the interval that begins next in local time tells the offset before the change.
    skip = F.element_at(F.array_sort(F.filter("spans", lambda s: (F.col("_loc") < s["lo"]) & (F.col("_loc") >= s["lo"] - 86400))), 1)["before"]
    j = j.withColumn("_hit", hit)
    named = F.coalesce(_offset_text(F.col("_t.zone")), F.element_at("names", F.col("_t.zone")))
    offset = (
        F.when(F.col("_t.kind") == "zoned", named)
        .when(F.col("spans").isNull(), F.lit(0).cast("long"))
        .when(F.size("_hit") == 0, F.coalesce(skip, F.lit(0).cast("long")))
        .otherwise(F.array_max(F.transform("_hit", lambda s: s["off"])))
    )
    kind = F.col("_t.kind")
    instant = F.when(kind == "count", F.col("_t.micros")).otherwise(F.col("_t.micros") - offset * 1000000)
    norm = F.when(kind == "day", F.col("_t.day")).when(kind.isNotNull(), _render(instant))
    status = (
        F.when(F.col("raw").isNull(), "null")
        .when(F.col("norm").isNull(), "unreadable")
        .when(F.col("norm") == F.col("raw"), "normal")
        .when(kind == "day", "day")
        .when((kind == "local") & (F.size("_hit") > 1), "ambiguous")
        .when((kind == "local") & F.col("spans").isNotNull() & (F.size("_hit") == 0), "nonexistent")
        .otherwise("instant")
    )
    return j.withColumn("norm", norm).select(key, "field", "raw", "norm", status.alias("status"))


def times_found(df: DataFrame, sites: DataFrame) -> DataFrame:
    """(seq, field, norm) of the values that denote a day or instant and aren't in normal form yet."""
    out = normalise_times(df, sites, ["date", "added_at"], "seq")
    return out.where(~F.col("status").isin("null", "unreadable", "normal")).select(F.col("seq").cast("long").alias("seq"), "field", "norm")
