"""Problem 5: text that was decoded with the wrong character encoding.

Characters are counted over all values, apart for GROUPS groups of sources: common is what stands in a share of
the values of most groups, so a source that is damaged throughout can't make its own damage common. One
zstandard dictionary for each language (told by its script) is made of segments of the clean lines, chosen by the
COVER rule with counts over all lines: a first pass adds up how often every stretch of eight bytes occurs, a second
finds the best segment that starts with each of the most frequent ones (as many as a dictionary has bytes), and the driver covers the counts with them.
Lines that hold uncommon characters are decoded anew along chains (text -> bytes by the wrong encoding -> text by
the right one, up to three times); every candidate is compressed with every dictionary, and the BEAM shortest are
decoded further. The chain of least description length, its own cost included, wins; if none beats the
text as it is, it is left unchanged. Characters that were lost (replacement characters and the fill patterns
of damaged buffers) can't come back: such values are reported as damaged, with whatever else could be restored.

Defined results: null and empty values are unchanged; a value is compared line by line, whole; extra
columns are ignored; repeated rows are each reported.
"""

from __future__ import annotations

import functools
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirstone.sources.tables import cut

#: The share of a group's values a common character stands in; groups of sources; values from which on a group counts.
COMMON, GROUPS, GROUP_LEAST = 0.01, 32, 50
DICTIONARY_BYTES, LEAST_LINES = 48_000, 20
#: Bytes of the stretches that are counted, of a segment at most, and kept around what a segment adds; cells of the table of counts.
STRETCH, SEGMENT, MARGIN, CELLS = 8, 160, 16, 1 << 20
#: Characters that are looked at together; their arrays stay in the processor's cache.
PIECE = 1 << 16
#: Bytes that show zstandard how often each byte stands in all lines.
SINGLES = 1 << 19
#: Description length in bytes of a step to UTF-8 (few texts are valid UTF-8 by chance), of a step to another encoding, and of leaving a character lost.
STEP_COST, OTHER_COST, LOST_COST = 1.5, 6.0, 2.0
#: Candidates decoded further after each step, and how much longer than the line they may be.
BEAM, LONGER = 3, 1.1
#: Characters of lines (with 100 for each line), and of a stretch, whose results are remembered.
KEPT_LINES, KEPT_STRETCH = 1 << 22, 64

# Fixed values: (wrongly used, right) encodings, from everyday confusions; 'web' is windows-1252 with the C1 controls in its gaps.
CHAINS = [("web", "utf-8"), ("latin-1", "utf-8"), ("gb18030", "utf-8"), ("web", "gb18030"), ("latin-1", "gb18030"), ("big5", "gb18030"), ("gb18030", "big5"), ("cp932", "utf-8"), ("cp932", "gb18030"), ("euc_kr", "gb18030"), ("big5", "utf-8"), ("mac_roman", "utf-8"), ("cp1251", "utf-8"), ("koi8_r", "utf-8"), ("cp437", "utf-8"), ("web", "big5")]
# What is left where characters were lost: replacement characters, their bytes read as GBK, fill bytes of debug builds read as GBK.
LOST = re.compile("�|锟斤拷|锟斤|斤拷锟|烫烫|屯屯|锟(?=�)")
# Marks and letters beyond ASCII that are ordinary in clean text.
_ORDINARY = "·，。、；：？！“”‘’（）《》〈〉【】〔〕—…·～％　￥×÷°±µ²³©®™–‐‑•"

_C1252 = {bytes([b]).decode("cp1252", "ignore") or chr(b): bytes([b]) for b in range(256)}


def _encode(text: str, codec: str) -> bytes | None:
    try:
        if "�" in text:  # a lost character stems from no byte (GB 18030 has a code for it)
            return None
        if codec == "web":
            return b"".join([_C1252.get(c) or c.encode("latin-1") for c in text])
        return text.encode(codec)
    except UnicodeEncodeError:
        return None


def _decode(raw: bytes, codec: str) -> str | None:
    try:
        return raw.decode(codec)
    except UnicodeDecodeError:
        return None


_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
#: A stretch runs over characters beyond ASCII and the figures and marks between them.
_STRETCH = re.compile(r"[^\x00-\x7f](?:[\x20-\x7e]{0,24}[^\x00-\x7f]+)*")
_DENSE = re.compile(r"[^\x00-\x7f]+")


@functools.cache
def _encodable(codec: str) -> re.Pattern:
    """Runs of characters that the encoding can produce, found by sending the first plane through it once."""
    if codec == "gb18030":
        return re.compile("[^\ufffd\ud800-\udfff]+")
    plane = "".join(chr(c) for c in range(0x20, 0xFFF0) if not 0xD800 <= c < 0xE000)
    kept = set(_C1252) | {chr(c) for c in range(256)} if codec == "web" else set(plane.encode(codec, "ignore").decode(codec, "ignore"))
    good = sorted(ord(c) for c in kept if 0x20 <= ord(c) < 0xFFF0)
    runs: list[list[int]] = []
    for c in good:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return re.compile("[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs) + "]+")


def _whole(s: str, raw: bytes, wrong: str, right: str) -> str:
    """The stretch, whose bytes in the wrong encoding are ``raw``, decoded anew; itself where that fails."""
    out = _decode(raw, right)
    if out is None and right == "utf-8":
        # Valid sequences inside other bytes; a tail cut off in the middle of a character is lost.
        if wrong in ("web", "latin-1"):
            pieces, at = [], 0
            for u in _UTF8.finditer(raw):
                pieces += [s[at : u.start()], u.group().decode("utf-8", "replace")]
                at = u.end()
            out = "".join([*pieces, s[at:]]) if pieces else None
        else:
            out = raw.decode("utf-8", "replace")
            if out.count("�") * 4 > len(out):
                out = None
    elif out is None and len(s) > 3:
        for a, b in ((1, None), (None, -1), (1, -1)):
            if (out := _decode(raw[a:b], right)) is not None:
                out = ("�" if a else "") + out + ("�" if b else "")
                break
    return s if out is None else out


def _anew(s: str, wrong: str, right: str) -> str:
    """A stretch decoded anew, itself where it can't be."""
    raw = _encode(s, wrong)
    if raw is not None:
        return _whole(s, raw, wrong, right)
    # Only part of the stretch can stem from the wrong encoding: its encodable runs.
    return s if len(s) < 3 else _encodable(wrong).sub(lambda r: r.group() if (raw := _encode(r.group(), wrong)) is None else _whole(r.group(), raw, wrong, right), s)


#: Short stretches come again and again, in other lines and along other chains.
_anew_kept = functools.lru_cache(1 << 15)(_anew)


def _redecode(text: str, wrong: str, right: str) -> str | None:
    """The text with each stretch that can be decoded anew replaced; None if nothing changes."""
    out = (_STRETCH if wrong in _SINGLE else _DENSE).sub(lambda m: (_anew_kept if len(m.group()) <= KEPT_STRETCH else _anew)(m.group(), wrong, right), text)
    return None if out == text else out


@functools.lru_cache(1 << 12)
def _explaining(odd: str) -> tuple[tuple[str, str], ...]:
    """The chains that can have produced most of what is uncommon; another explains nothing."""
    most = {wrong: 5 * sum(map(len, _encodable(wrong).findall(odd))) >= 4 * len(odd) for wrong, _ in CHAINS}
    return tuple(c for c in CHAINS if most[c[0]])


_SINGLE = {"web", "latin-1", "mac_roman", "cp1251", "koi8_r", "cp437"}
_LATIN_RUN = re.compile("[\u0080-\u00ffŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]{2}")


def _may_be_wrong(line: str, strange: list[str]) -> bool:
    """False for lines no chain can change: lone accented letters, single rare characters."""
    if all(c < "\u2600" for c in strange):
        return bool(_LATIN_RUN.search(line)) or any(not ("\x80" <= c <= "ɏ") for c in strange) and len(strange) > 1
    return len(strange) > 1


class Model:
    """Common characters and per-language dictionaries; small enough to be sent with the task."""

    def __init__(self, common: str, dictionaries: list[bytes]):
        self.common, self.dictionaries, self._ready = common, dictionaries, None
        self._lines: dict[str, tuple[str, tuple[str, ...]]] = {}
        self._room = KEPT_LINES

    def ready(self):
        import zstandard as z

        if self._ready is None:
            odd = re.compile("[^\x00-\x7f" + re.escape(self.common) + "]")
            params = z.ZstdCompressionParameters.from_level(5, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, write_checksum=False)
            packers = []
            for d in self.dictionaries:
                d = z.ZstdCompressionDict(d)
                d.precompute_compress(compression_params=params)  # digested once, not at every call
                packers.append(z.ZstdCompressor(dict_data=d, compression_params=params))
            self._ready = odd, packers
        return self._ready

    def length(self, text: str) -> float:
        """Description length in bytes: the least over the languages, lost characters extra."""
        raw = text.encode("utf-8", "replace")
        return min(len(c.compress(raw)) for c in self.ready()[1]) + LOST_COST * text.count("�")

    def repair_line(self, line: str, deep: int = 3) -> tuple[str, tuple[str, ...]]:
        strange = self.ready()[0].findall(line)
        if not _may_be_wrong(line, strange):
            return line, ()
        best, best_cost, chain = line, self.length(line), ()
        whole = best_cost
        front, seen = [(best_cost, line, (), 0.0)], {line}
        for _ in range(deep):
            found = []
            for _, text, steps, paid in front:
                odd = "".join(dict.fromkeys(self.ready()[0].findall(text))).replace("�", "")
                for wrong, right in _explaining(odd):
                    new = _redecode(text, wrong, right)
                    if new is None or new in seen:
                        continue
                    seen.add(new)
                    cost = paid + (STEP_COST if right == "utf-8" else OTHER_COST)
                    found.append((self.length(new) + cost, new, (*steps, f"{wrong}>{right}"), cost))
            front = sorted(found, key=lambda x: x[0])[:BEAM]
            if front and front[0][0] < best_cost:
                best_cost, best, chain = front[0][0], front[0][1], front[0][2]
            # What holds nothing uncommon any more, or is clearly longer than the line itself, leads no further.
            front = [x for x in front if x[0] <= LONGER * whole and self.ready()[0].search(x[1])]
            if not front:
                break
        # A check behind the choice: what isn't UTF-8 must at least have fewer uncommon characters than before.
        if chain and not all(c in ("web>utf-8", "latin-1>utf-8") for c in chain) and 3 * len(self.ready()[0].findall(best)) > len(strange):
            return line, ()
        return best, chain

    def repair_known(self, line: str) -> tuple[str, tuple[str, ...]]:
        """repair_line, done once for a line that comes again soon; all are forgotten when there is no room."""
        out = self._lines.get(line)
        if out is None:
            out = self.repair_line(line)
            self._room -= len(line) + 100
            if self._room < 0:
                self._lines, self._room = {}, KEPT_LINES
            self._lines[line] = out
        return out

    def repair(self, value: str | None) -> tuple[str | None, str, bool]:
        """(restored, chains joined by ';', damaged)."""
        if not value or not self.ready()[0].search(value):
            return value, "", False
        lost, lines, chains = bool(LOST.search(value)), [], []
        for line in value.split("\n"):
            if self.ready()[0].search(line):
                line, chain = self.repair_known(line)
                if chain:
                    chains.append("+".join(chain))
            lines.append(line)
        return "\n".join(lines), ";".join(dict.fromkeys(chains)), lost or bool(chains)


# Scripts by their blocks, the first that has most letters of a text tells its language.
_SCRIPTS = {"han": "一-鿿", "kana": "ぁ-ヿ", "hangul": "가-힯", "cyrillic": "Ѐ-ӿ", "greek": "Ͱ-Ͽ", "arabic": "؀-ۿ", "hebrew": "֐-׿", "thai": "฀-๿", "devanagari": "ऀ-ॿ"}
_LANGUAGES = [*_SCRIPTS, "latin"]
#: Marks in the table of code points, above the numbers of scripts.
ODD, BROKEN = 16, 32
# Fixed value: the offsets 1, 4, 8, which end the header of a zstandard dictionary (RFC 8878, section 5).
_OFFSETS = bytes([1, 0, 0, 0, 4, 0, 0, 0, 8, 0, 0, 0])


def common_characters(df: DataFrame, fields: list[str], source: str | None) -> str:
    """Characters beyond ASCII in COMMON of the values of most groups of sources, counted over all values; at most characters per value / COMMON a group come to the driver."""
    group = F.pmod(F.xxhash64(F.coalesce(F.col(source).cast("string"), F.lit(""))), F.lit(GROUPS)).cast("int") if source else F.lit(0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter] = defaultdict(Counter)
        for b in batches:
            groups = b.column(0).to_pylist()
            for i in range(1, b.num_columns):
                for g, v in zip(groups, b.column(i).to_pylist()):
                    if v:
                        held[g][""] += 1
                        if not v.isascii():
                            held[g].update(set(v))
        cols = list(zip(*((g, c, n) for g, counts in held.items() for c, n in counts.items() if not c or c > "\x7f" and not "\ud800" <= c <= "\udfff"))) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["g", "c", "n"])

    counted = cut(df.select(group.alias("g"), *fields).mapInArrow(work, "g int, c string, n bigint").groupBy("g", "c").agg(F.sum("n").alias("n")))
    sizes = {r.g: r.n for r in counted.where("c = ''").collect()}  # GROUPS rows
    least = min(GROUP_LEAST, max(sizes.values(), default=0))
    counts = F.broadcast(counted.where("c = ''").where(F.col("n") >= least).select("g", F.col("n").alias("size")))
    need = F.greatest(F.lit(3), F.col("size") * COMMON)
    common = counted.where("c <> ''").join(counts, "g").where(F.col("n") >= need).groupBy("c").agg(F.count("*").alias("groups"))
    big = sum(n >= least for n in sizes.values())
    return "".join(sorted(r.c for r in common.where(F.col("groups") * 2 > big).toLocalIterator()))


def ordinary(common: str) -> str:
    """Without Latin letters beyond ASCII, signs and private characters, which tell damage; with marks that are always ordinary."""
    latin = lambda c: "\x80" <= c <= "ɏ" or "‐" <= c <= "™"
    return "".join(sorted({c for c in common if not latin(c) and not ("\ue000" <= c <= "\uf8ff") and c not in "�锟烫屯"} | set(_ORDINARY)))


def _kinds(common: str) -> np.ndarray:
    """For each code point the number of its script (from 1) in the low bits, ODD if it is uncommon, BROKEN if it tells damage alone."""
    kinds = np.full(0x110000, ODD, np.uint8)
    kinds[:0x80] = 0
    kinds[[ord(c) for c in common]] = 0
    for i, span in enumerate(_SCRIPTS.values(), 1):
        kinds[ord(span[0]) : ord(span[-1]) + 1] |= i
    kinds[[*range(0x80, 0xA0), *map(ord, "�ÂÃâ")]] |= BROKEN
    return kinds


def clean_lines(batches: Iterator[pa.RecordBatch], common: str, least: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """(language, bytes of clean lines of it, each with a line feed behind it), some ``least`` bytes at a time."""
    kinds = _kinds(common)
    held: dict[int, list[np.ndarray]] = defaultdict(list)
    size: Counter = Counter()
    for b in batches:
        for column in b.columns:
            for text in _pieces(column.to_pylist()):
                for g, lines in _clean(text, kinds):
                    held[g].append(lines)
                    size[g] += len(lines)
                    if size[g] >= least:
                        size[g] = 0
                        yield g, np.concatenate(held.pop(g))
    for g, lines in held.items():
        yield g, np.concatenate(lines)


def _pieces(values: list[str | None]) -> Iterator[str]:
    """All lines of the values, whole and each with a line feed behind it, some PIECE characters at a time."""
    some, size = [], 0
    for v in values:
        if v:
            at = 0
            while len(v) - at > PIECE and (end := v.find("\n", at + PIECE)) >= 0:
                yield v[at : end + 1]
                at = end + 1
            some.append(v[at:])
            size += len(v) - at
            if size >= PIECE:
                yield "\n".join([*some, ""])
                some, size = [], 0
    if some:
        yield "\n".join([*some, ""])


def _clean(text: str, kinds: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(language, bytes of the clean lines of it) of a text whose lines all end with a line feed."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    ends = np.flatnonzero(points == 10)
    sizes = np.diff(ends, prepend=-1)  # with the line feed
    kind = kinds[points]
    # Accented words belong in the dictionaries too; lines with two odd characters in a row don't.
    odd = kind & ODD
    hurt = kind & BROKEN
    hurt[1:] |= odd[1:] & odd[:-1]
    keep = sizes > 8
    keep[np.searchsorted(ends, np.flatnonzero(hurt))] = False
    script = kind & (ODD - 1)
    letters = np.flatnonzero(script)
    n = len(_SCRIPTS)
    # A line's language is the script that has most letters and a fifth of the characters, else Latin.
    counts = np.bincount(np.repeat(np.arange(0, n * len(ends), n), sizes)[letters] + script[letters] - 1, minlength=n * len(ends)).reshape(-1, n)
    language = counts.argmax(1)
    language[counts.max(1) * 5 <= sizes - 1] = n
    bytes_each = np.diff(np.flatnonzero(raw == 10), prepend=-1)
    for g in np.unique(language[keep]).tolist():
        yield g, raw[np.repeat(keep & (language == g), bytes_each)]


def _cells(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lines with a line feed behind each: for each place the cell of the STRETCH bytes from there on (CELLS where their line is over before), and the places of the line feeds."""
    padded = np.concatenate([raw, np.full(STRETCH, 10, np.uint8)])
    cells = np.empty(len(raw), np.int64)
    for a in range(0, len(raw), 1 << 15):  # so many stay in the processor's cache
        eight = np.ndarray((min(1 << 15, len(raw) - a),), "<u8", padded, a, (1,))
        cells[a : a + (1 << 15)] = (eight * np.uint64(0xCF1BBCDCB7A56463)) >> np.uint64(64 - CELLS.bit_length() + 1)
    feeds = np.flatnonzero(raw == 10)
    for back in range(STRETCH):
        cells[np.maximum(feeds - back, 0)] = CELLS
    return cells, feeds


def stretches(lines: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The lines in one buffer; for each place in it the cell of the STRETCH bytes from there on (-1 where their line is over before), and the end of its line."""
    raw = b"".join([x + b"\n" for x in lines])
    cells, feeds = _cells(np.frombuffer(raw, np.uint8))
    cells[cells == CELLS] = -1
    return raw, cells, np.repeat(feeds, np.diff(feeds, prepend=-1))


def count_stretches(df: DataFrame, common: str) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
    """Language -> (counts of the stretches by cell, counts of the bytes, clean lines), over all lines of all columns; at most CELLS numbers and a few a language come to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(CELLS + 1, np.int64))
        each: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(257, np.int64))
        for g, lines in clean_lines(batches, common):
            cells, feeds = _cells(lines)
            np.add.at(held[g], cells, 1)
            each[g][:-1] += np.bincount(lines, minlength=256)
            each[g][[ord("\n"), -1]] = 0, each[g][-1] + len(feeds)
        for g, n in held.items():
            n = np.concatenate([n[:CELLS], each[g]])
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["g", "cell", "n"])

    rows = df.mapInArrow(work, "g int, cell int, n bigint").groupBy("g", "cell").agg(F.sum("n").alias("n")).toArrow()
    g, cell, n = (c.to_numpy() for c in rows.columns)
    out = {}
    for k in np.unique(g):
        whole = np.zeros(CELLS + 257, np.int64)
        whole[cell[g == k]] = n[g == k]
        out[int(k)] = whole[:CELLS], whole[CELLS:-1], int(whole[-1])
    return out


def best_segments(df: DataFrame, common: str, counts: dict[int, np.ndarray]) -> dict[int, list[bytes]]:
    """Language -> for each of its DICTIONARY_BYTES most frequent stretches the segment, of all that start with it in any line, whose stretches have the greatest sum of counts."""
    tops = {g: np.argsort(-n, kind="stable")[: min(DICTIONARY_BYTES, np.count_nonzero(n))] for g, n in counts.items()}
    counted = {g: np.append(n, 0) for g, n in counts.items()}  # 0 for places without a stretch

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, best, found = {}, {}, {}
        for g, top in tops.items():
            place[g], best[g], found[g] = np.full(CELLS + 1, -1, np.int64), np.zeros(len(top), np.int64), {}
            place[g][top] = np.arange(len(top))
        for g, lines in clean_lines(batches, common):
            if g not in tops:
                continue
            cells, feeds = _cells(lines)
            start = place[g][cells]
            at = np.flatnonzero(start >= 0)
            end = np.minimum(at + SEGMENT, np.repeat(feeds, np.diff(feeds, prepend=-1))[at])
            n = counted[g][cells]
            # The sum of counts; among equal ones the bits of a sum of hashes decide, so any order of lines gives the same segment.
            sums, marks = (np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)]) for x in (n, (cells + 2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            stop = end - STRETCH + 1
            score = ((sums[stop] - sums[at]) << 20) | ((marks[stop] - marks[at]) >> np.uint64(44)).astype(np.int64)
            start = start[at]
            better = score > best[g][start]
            at, end, start, score = at[better], end[better], start[better], score[better]
            np.maximum.at(best[g], start, score)
            won = score == best[g][start]
            which, first = np.unique(start[won], return_index=True)
            for k, a, z in zip(which.tolist(), at[won][first].tolist(), end[won][first].tolist()):
                found[g][k] = lines[a:z].tobytes()
        for g, held in found.items():
            ks = list(held)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ks), g, np.int32)), pa.array(ks, pa.int32()), pa.array(best[g][ks]), pa.array([held[k] for k in ks], pa.binary())], names=["g", "start", "score", "segment"])

    rows = df.mapInArrow(work, "g int, start int, score bigint, segment binary").groupBy("g", "start").agg(F.max(F.struct("score", "segment")).alias("x")).select("g", "start", "x.segment").toArrow()
    out: dict[int, list[bytes]] = defaultdict(list)
    for g, _, segment in sorted(zip(*(c.to_pylist() for c in rows.columns))):
        out[g].append(segment)
    return out


def cover(segments: list[bytes], counts: np.ndarray, size: int) -> bytes:
    """At most ``size`` bytes: again and again the segment with the greatest sum of counts not yet covered, of it what isn't covered and MARGIN bytes around; the best stand last, where they are cheapest to refer to."""
    if not segments:
        return b""
    cells, n = stretches(segments)[1], len(segments)
    cells = cells[cells >= 0]
    sizes = np.fromiter(map(len, segments), np.int64, n) - STRETCH + 1
    begin = np.concatenate([[0], np.cumsum(sizes)])
    # The segments that hold each cell, cell after cell.
    held = np.sort(cells * n + np.repeat(np.arange(n), sizes))
    cell, who = (x.astype(np.int32) for x in np.divmod(held[np.diff(held, prepend=-1) > 0], n))
    first = np.searchsorted(cell, np.arange(CELLS + 1, dtype=np.int32))
    left = counts.copy()
    gain = np.bincount(who, counts[cell], n)
    out, room = [], size
    while room > 0:
        i = int(gain.argmax())
        mine = cells[begin[i] : begin[i + 1]]
        fresh = np.flatnonzero(left[mine])
        if not len(fresh):
            break
        out.append(segments[i][max(0, fresh[0] - MARGIN) : fresh[-1] + STRETCH + MARGIN])
        room -= len(out[-1])
        for x in np.unique(mine[fresh]):
            gain[who[first[x] : first[x + 1]]] -= left[x]
            left[x] = 0
    return b"".join(reversed(out))[-size:]


def with_tables(content: bytes, segments: list[bytes], each: np.ndarray) -> bytes:
    """The content behind zstandard's entropy tables: of lengths and offsets as the segments have them, of single bytes as often as in all lines (``each``); alone where there is too little text."""
    import zstandard as z

    # Bytes in their shares in all lines, in an order that repeats nothing, stand for what no segment holds.
    single = np.repeat(np.arange(256, dtype=np.uint8), np.ceil(each * (SINGLES / max(1, each.sum()))).astype(np.int64))
    single = np.random.default_rng(0).permutation(single).tobytes()
    samples = segments + [single[i : i + SEGMENT] for i in range(0, len(single), SEGMENT)]
    try:
        trained = z.train_dictionary(max(1024, len(content)), samples, k=SEGMENT, d=STRETCH).as_bytes()
    except z.ZstdError:
        return content
    return trained[: trained.index(_OFFSETS) + len(_OFFSETS)] + content


def dictionaries(df: DataFrame, common: str) -> list[bytes]:
    """One for each language that has LEAST_LINES clean lines, from all its lines; of whatever there is where no language has."""
    counted = count_stretches(df, common)
    enough = {g: x for g, x in counted.items() if x[2] >= LEAST_LINES} or counted
    segments = best_segments(df, common, {g: n for g, (n, _, _) in enough.items()}) if enough else {}
    out = []
    for g, some in sorted(segments.items()):
        counts, each, _ = enough[g]
        out.append(with_tables(cover(some, counts, max(1024, min(DICTIONARY_BYTES, int(each.sum()) // 6))), some, each))
    return out or [b"\n" * 8]


def fit(df: DataFrame, fields: list[str], source: str | None = None) -> Model:
    """Characters and dictionaries, both counted over all values."""
    common = ordinary(common_characters(df, fields, source))
    return Model(common, dictionaries(df.select(*fields), common))


def repair(df: DataFrame, fields: list[str], key: str = "seq", source: str = "source", model: Model | None = None) -> DataFrame:
    """(key, field, restored, chain, damaged) of every value in which a stretch was decoded wrongly or lost."""
    if model is None:
        model = fit(df, fields, source if source in df.columns else None)
    packed = pickle.dumps((model.common, model.dictionaries))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*pickle.loads(packed))
        for b in batches:
            out: list[tuple] = []
            keys = b.column(0).to_pylist()
            for i, f in enumerate(fields):
                for k, v in zip(keys, b.column(i + 1).to_pylist()):
                    new, chain, hurt = m.repair(v)
                    if hurt:
                        out.append((k, f, new.encode("utf-8", "replace").decode(), chain, bool(LOST.search(new))))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["k", "field", "restored", "chain", "damaged"]), schema=pa.schema([("k", b.schema[0].type), ("field", pa.string()), ("restored", pa.string()), ("chain", pa.string()), ("damaged", pa.bool_())]), preserve_index=False)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *fields).mapInArrow(work, f"k {kind}, field string, restored string, chain string, damaged boolean").withColumnRenamed("k", key)
