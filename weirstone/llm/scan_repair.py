"""Problem 6: noise in text read from scanned pages.

One averaged perceptron edits characters: at each spot that a reading error could have produced it
chooses keep, replace (one or two characters by one), delete (a speck read as a mark) or insert (a letter a
word lacks). A second one chooses for each line end between keep, join, join with a space, and join and
delete the mark of a broken word. A third and a fourth find page numbers and running headers from their form
and their position on the page (an interrupted sentence, neighbours, repetition in the document, words of the
title). All are trained on a bounded sample of clean texts into which the noise is put by rule, so labels
need no hand. Which character can be read as which is a fixed table; when, is learnt. Which pairs and
triples of characters and which words are usual is counted over all clean texts.

Defined results: null and empty content has no lines and comes out as it is; texts without noise are
only re-flowed into paragraphs; ties in a decision keep the text; repeated rows are handled each.
"""

from __future__ import annotations

import pickle
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirstone.llm.spread import bounded_sample
from weirstone.sources.tables import cut

#: Clean texts the perceptrons are trained on at most, their lengths, and passes over them.
SAMPLE, SHORTEST, LONGEST, PASSES = 800, 41, 3999, 3
#: Share of all characters (or words) from which on a pair, triple or word is usual, and the least count; at most 1 / USUAL of each kind are kept, whatever the size of the corpus.
USUAL, LEAST = 2e-6, 3
#: Share of all texts from which on a short line is a usual heading, and its longest length.
HEADINGS, HEADING_CHARS = 1e-3, 24
#: Words an inserted letter may complete: the most frequent ones.
KNOWN = 20_000

# Groups of characters (or pairs of letters) that scanners take for one another.
_ALIKE = ["0OoQ〇", "1lI|i", "2Z", "5S", "6G", "8B", "入人八", "千干于", "未末", "土士", "日曰目", "毫亳", "库厍", "积枳", "治冶", "第笫弟", "己已巳", "大太犬", "水永氷", "析折拆", "侯候", "拔拨", "戊戌戍", "洪供", "微徵", "晴睛", "免兔", "今令", "卷券", "密蜜", "刺剌", "王玉主", "木本术", "问间", "鸟乌", "暖暧", "苦若", "圆园", "测侧", "样祥", "徒徙", "汨汩", "沫沬", "遣遗", "诀决", "辩辨", "竟竞", "幕慕暮", "材村", "网岡", "贝见", "天夫", "士上", "口囗", "孑子", "办为"]
_PAIRS = [("rn", "m"), ("li", "h"), ("vv", "w"), ("cl", "d"), ("ri", "n"), ("tl", "d")]
_LETTERS = [("c", "e"), ("u", "n"), ("n", "u"), ("e", "c"), ("h", "b"), ("b", "h")]
_MARKS = "-¬­‐"
#: Marks that specks of dirt are read as, inside words.
_SPECKS = "`^~¨¸¦*"
# Forms in which page numbers are printed (features, one for each form).
_PAGE_FORMS = [r"\d{1,4}", r"[-–—·•*~]{1,3}\s*(?:\d{1,4}|[ivxl]{1,7})\s*[-–—·•*~]{1,3}", r"[(（\[【]\s*\d{1,4}\s*[)）\]】]", r"\d{1,4}\s*(?:/|of|\|)\s*\d{1,4}", r"第\s*\d{1,4}\s*页\s*[,，/、]?\s*(?:[共/]?\s*\d{1,4}\s*页)?", r"(?:[Pp]age|PAGE|[Pp][Pp]?\.?|P\s?a\s?g\s?e)\s*[:.]?\s*\d{1,4}(?:\s*(?:/|of)\s*\d{1,4})?", r"\d{1,4}\s*\|\s*P\s*a\s*g\s*e", r"[ivxl]{1,7}"]
_PAGE_FORMS = [re.compile(x) for x in _PAGE_FORMS]
#: A line whose last word can be broken.
_BROKEN = re.compile(rf"[A-Za-z]{{2}}[{_MARKS}]\s*$")
#: What can be a page number at all: a short line with a figure or made of Roman ones.
_NUMBERISH = re.compile(r"(?=.{1,24}$)(?:.*\d.*|\W*[ivxlIVXL]{1,7}\W*)")
#: A number of a volume, issue or part, as serials bear it.
_SERIAL = re.compile(r"第\s*[\d一二三四五六七八九十]+\s*[卷期册辑编集]|\b(?:[Vv]ol|[Nn]o)\.?\s*\d+")
_FOLIO = re.compile(r"(?:[\s·.…—\-|]{2,}|　+)(\d{1,4})$|^(\d{1,4})(?:\s{2,}|　+)")
_HEADING = re.compile(r"[\s　]*(?:[一二三四五六七八九十]{1,3}、|[（(][一二三四五六七八九十\d]{1,3}[)）]|第[一二三四五六七八九十\d]+[章节]|\d{1,2}(?:\.\d{1,2})*[.、\s]\s*\S|[·•\-*]\s)")
_TABLE = re.compile(r"\S(?:\s{2,}|　{1,}|\t)[\d.OlISBZ%]+(?:(?:\s{2,}|\t)[\d.OlISBZ%]+)+\s*$|\S\s{2,}[\d.OlIS]+\.[\dOlISB]+")
_END = "。．.！!？?；;：:”」』"


# Words by which books, serials and collections are named in general.
_COLLECTIONS = "学报 年鉴 年报 公报 会刊 期刊 集刊 丛刊 丛书 文集 论文集 资料集 资料选辑 资料汇编 选编 汇编 专辑 全书 手册 通讯 通报 简报 志 史料 档案".split()
_COLLECTIONS_EN = "Journal Proceedings Transactions Bulletin Annals Review Report Letters Series Papers Handbook Monographs Studies Yearbook Memoirs Records".split()
_COLLECTION = re.compile("(?:" + "|".join(_COLLECTIONS) + r")(?:$|[\s　·\d第（(])|^(?:" + "|".join(_COLLECTIONS) + r")·|\b(?:" + "|".join(_COLLECTIONS_EN) + r")\b")


def _spots() -> dict[str, list[str]]:
    """Observed -> what it may stand for."""
    out: dict[str, list[str]] = defaultdict(list)
    for group in _ALIKE:
        for a in group:
            for b in group:
                latin = a.isascii() and b.isascii()
                # Inside a group of figures and letters one side must be a figure or the digit-like letters themselves.
                if a != b and (not latin or a.isdigit() != b.isdigit() or a.isalpha() and b.isalpha() and {a, b} <= set("lI")):
                    out[a].append(b)
    for seen, meant in (*_PAIRS, *_LETTERS):
        out[seen].append(meant)
    return dict(out)


SPOTS = _spots()
_SPOT = re.compile("(?=" + "|".join(map(re.escape, SPOTS)) + ")")
_INSIDE = defaultdict(list)
for _k in SPOTS:
    _INSIDE[_k[0]].append(_k)
_SPECK = re.compile(rf"(?<=[一-鿿])[{re.escape(_SPECKS)}](?=[一-鿿])|(?<=[a-z])[{re.escape(_SPECKS)}](?=[a-z])")
#: A whole word inside a line, and no name; those at its ends may be parts.
_WORD = re.compile(rf"(?<=[^A-Za-z])[a-z]{{5,}}(?=[^A-Za-z{_MARKS}])")
_FIRST, _LAST = re.compile(r"\s*[A-Za-z]*"), re.compile(rf"[A-Za-z]*[{_MARKS}]?\s*$")


def _kind(c: str) -> str:
    if c.isdigit():
        return "0"
    if c.isascii():
        return "a" if c.islower() else "A" if c.isupper() else c if c in ".%,-/ " else "!"
    return "汉" if "一" <= c <= "鿿" else "．"


class Perceptron:
    """Averaged, over string features; classes are told apart by the features themselves."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.w = weights or {}
        self._total: dict[str, float] = defaultdict(float)
        self._at: dict[str, int] = defaultdict(int)
        self.n = 0

    def score(self, features: list[str]) -> float:
        get = self.w.get
        return sum([get(f, 0.0) for f in features])

    def learn(self, right: list[str], wrong: list[str] | None) -> None:
        self.n += 1
        if wrong is not None:
            for fs, d in ((right, 1.0), (wrong, -1.0)):
                for f in fs:
                    self._total[f] += (self.n - self._at[f]) * self.w.get(f, 0.0)
                    self._at[f] = self.n
                    self.w[f] = self.w.get(f, 0.0) + d

    def averaged(self) -> dict[str, float]:
        out = {}
        for f, v in self.w.items():
            t = (self._total[f] + (self.n - self._at[f]) * v) / max(1, self.n)
            if abs(t) > 1e-4:
                out[f] = t
        return out


class ScanModel:
    def __init__(self, grams: frozenset, words: dict[str, int], headings: frozenset, edit: dict, number: dict, page: dict, join: dict):
        self.grams, self.words, self.headings = grams, words, headings
        self.edit, self.number, self.page, self.join = Perceptron(edit), Perceptron(number), Perceptron(page), Perceptron(join)
        self._lacking: dict[str, tuple[int, str]] | None = None

    def lacking(self, word: str) -> tuple[int, str] | None:
        """(position, letter) that makes a known word of an unknown one; None if there is none or more than one."""
        if self._lacking is None:
            found: dict = {}
            for w in sorted(self.words, key=lambda x: -self.words[x])[:KNOWN]:
                if len(w) >= 6:
                    for i in range(1, len(w) - 1):
                        short = w[:i] + w[i + 1 :]
                        if w[i] != w[i - 1]:
                            found[short] = None if short in found else (i, w[i])
            self._lacking = {k: v for k, v in found.items() if v and k not in self.words}
        return self._lacking.get(word)

    def spots(self, line: str) -> list[tuple[int, str, list[tuple[str, int, int]]]]:
        """(position, what is seen, readings) in order; nothing is seen where a letter may lack, nothing is meant where a speck may be."""
        out = []
        for m in _SPOT.finditer(line):
            for seen in _INSIDE[line[m.start()]]:
                if line.startswith(seen, m.start()) and (r := self._readings(line, m.start(), seen)):
                    out.append((m.start(), seen, r))
        for m in _SPECK.finditer(line):
            out.append((m.start(), m.group(), [("", 1, 0)]))
        for m in _WORD.finditer(line):
            w = m.group().lower()
            if w not in self.words and (at := self.lacking(w)):
                out.append((m.start() + at[0], "", [(at[1], 1, 0)]))
        out.sort(key=lambda x: x[0])
        return out

    # Characters.
    def _readings(self, line: str, i: int, seen: str) -> list[tuple[str, int, int]]:
        """(meant, fit of it, fit of what is seen): the readings for which there is evidence at all.

        A letter is read as a figure only beside a figure; other Latin readings must make a known word
        of an unknown one; Chinese readings must suit their neighbours better than what is seen.
        """
        n = i + len(seen)
        p, q = line[i - 1 : i] or "^", line[n : n + 1] or "$"
        out = []
        if seen.isascii():
            if seen.isdigit() and (p.isdigit() or not (p.isascii() and p.isalpha()) and not (q.isascii() and q.isalpha())):
                return out
            beside = p.isdigit() or q.isdigit() or p == "." and line[i - 2 : i - 1].isdigit() or q == "." and line[n + 1 : n + 2].isdigit()
            s, e = i, n
            while s and line[s - 1].isascii() and line[s - 1].isalnum():
                s -= 1
            while e < len(line) and line[e].isascii() and line[e].isalnum():
                e += 1
            old = line[s:e].lower()
            for meant in SPOTS[seen]:
                if meant.isdigit():
                    if beside and not any(c.isalpha() and c not in "OlISBZGQoi|" for c in line[s:e]):
                        out.append((meant, 1, 0))
                elif meant.isascii() and len(old) > 2 and old not in self.words and (line[s:i] + meant + line[n:e]).lower() in self.words:
                    out.append((meant, 1, 0))
            return out
        g, d = self.grams, re.sub(r"\d", "0", line[max(0, i - 2) : n + 2])
        at = i - max(0, i - 2)
        a, b = d[:at], d[at + len(seen) :]
        fit = lambda c: (a[-1:] + c in g) + (c + b[:1] in g) + 2 * (a + c in g and len(a) > 1) + 2 * (c + b in g and len(b) > 1) + 2 * (bool(a and b) and a[-1] + c + b[0] in g)
        loses = fit(seen)
        if loses >= 6:
            return out
        for meant in SPOTS[seen]:
            f = fit(meant)
            if f >= 3 and f > loses:
                out.append((meant, f, loses))
        return out

    @staticmethod
    def _features(line: str, i: int, seen: str, meant: str, fits: int, loses: int) -> tuple[list[str], list[str]]:
        """Features of keeping and of replacing."""
        p, n = line[i - 1 : i] or "^", line[i + len(seen) : i + len(seen) + 1] or "$"
        kp, kn = _kind(p), _kind(n)
        act = f"{seen}>{meant}"
        return [f"s{seen}", f"S{kp}{kn}", f"K{loses}"], [f"a{act}", f"k{act}{kp}{kn}", f"r{fits}-{loses}", f"R{act}{min(fits, 4)}-{min(loses, 4)}", f"n{act}{n}", f"p{act}{p}", f"V{seen.isascii()}{meant.isdigit()}"]

    def fix_line(self, line: str, after_break: bool = False, broken: bool = False) -> tuple[str, int]:
        """(repaired, number of edits). The first word behind a broken one, and the broken one itself, are parts of words and stay."""
        out, at, n, best, where = [], 0, 0, None, -1
        low, high = _FIRST.match(line).end() if after_break else 0, _LAST.search(line).start() if broken else len(line)
        whole = [x for x in self.spots(line) if low <= x[0] and x[0] + len(x[1]) <= high]
        for i, seen, readings in [*whole, (len(line) + 1, "", [])]:
            if i != where:  # the best edit of a place is made when the next place comes
                if best:
                    out += [line[at : best[3]], best[2]]
                    at, n = best[3] + len(best[1]), n + 1
                best, where = None, i
            if i < at:
                continue
            for meant, f, loses in readings:
                keep, change = self._features(line, i, seen, meant, f, loses)
                s = self.edit.score(change) - self.edit.score(keep)
                if s > 0 and (best is None or s > best[0]):
                    best = s, seen, meant, i
        return "".join([*out, line[at:]]), n

    # Pages.
    def furniture(self, lines: list[str], title: str) -> list[str]:
        """'page_no', 'header' or '' of each line."""
        kinds = ["page_no" if fs and self.number.score(fs) > 0 else "" for fs in number_features(lines)]
        for i, fs in enumerate(page_features(lines, kinds, title, self)):
            if fs and not kinds[i] and self.page.score(fs) > 0:
                kinds[i] = "header"
        return kinds

    def line_end(self, line: str, after: str, width: int) -> str:
        fs = join_features(line, after, width)
        return max(("keep", "join", "space", "mend"), key=lambda a: (self.join.score([a + f for f in fs]), a == "keep"))


def _core(line: str) -> str:
    return re.sub(r"\d", "0", _FOLIO.sub("", line.strip()))


def _pairs(f: dict[str, bool]) -> list[str]:
    on = [k for k, v in f.items() if v]
    return ["bias", *on, *(f"{a}&{b}" for x, a in enumerate(on) for b in on[x + 1 :]), *(f"-{k}" for k, v in f.items() if not v)]


def number_features(lines: list[str]) -> list[list[str]]:
    """Features of the lines that may be page numbers."""
    form = [next((i for i, p in enumerate(_PAGE_FORMS) if p.fullmatch(x.strip())), None) if len(x) < 40 and _NUMBERISH.fullmatch(x.strip()) else None for x in lines]
    shapes = Counter(re.sub(r"\d+", "0", x.strip()) for x, f in zip(lines, form) if f is not None)
    out: list[list[str]] = []
    for i, line in enumerate(lines):
        s = line.strip()
        if not (len(line) < 40 and _NUMBERISH.fullmatch(s)):
            out.append([])
            continue
        before = next((lines[j].rstrip() for j in range(i - 1, -1, -1) if lines[j].strip() and form[j] is None), "")
        after = next((lines[j] for j in range(i + 1, len(lines)) if lines[j].strip() and form[j] is None), "")
        digits = re.findall(r"\d+", s)
        f = {
            "form": form[i] is not None, "bare": s.isdigit(), "big": bool(digits) and len(digits[0]) > 3, "cut": bool(before) and before[-1] not in _END,
            "goes": bool(after) and (after[0] in "，。、；）%" or after[0].islower()), "twice": form[i] is not None and shapes[re.sub(r"\d+", "0", s)] > 1,
            "indent": line[:1] in " 　", "table": bool(_TABLE.search(before) or _TABLE.search(after)), "first": not before, "last": not after, "end": s[-1] in _END + "，,、", "letters": len(re.findall(r"[^\W\d_]", s)) > 4,
        }
        out.append(_pairs(f) + [f"f{form[i]}", "s" + re.sub(r"\d+", "0", s)[:12]])
    return out


def page_features(lines: list[str], kinds: list[str], title: str, model: ScanModel) -> list[list[str]]:
    grams = model.grams
    cores = [_core(x) for x in lines]
    often = Counter(c for c in cores if c)
    widths = sorted(len(x) for x in lines)
    width = max(8, widths[int(len(widths) * 0.8)]) if lines else 8
    title = re.sub(r"\d", "0", title or "")
    out = []
    for i, line in enumerate(lines):
        s = line.strip()
        if not s or kinds[i] or len(s) > 60:
            out.append([])
            continue
        p = i - 1
        while p >= 0 and (kinds[p] or not lines[p].strip()):
            p -= 1
        n = i + 1
        while n < len(lines) and (kinds[n] or not lines[n].strip()):
            n += 1
        before, after = (lines[p].rstrip() if p >= 0 else ""), (lines[n] if n < len(lines) else "")
        c = cores[i]
        parts = [x for x in re.split(r"[·|—\-]+\s*", c) if len(x) >= 5]
        f = {
            "end": s[-1] in _END + "，,、", "comma": bool(re.search("[，。；]|, |\\b(?:the|of the|was|is|were)\\b", s)),
            "cut": bool(before) and before[-1] not in _END and not _TABLE.search(before) and len(before) >= 0.6 * width,
            "word": bool(re.search(f"[A-Za-z][{_MARKS}]$", before)) and after.lstrip()[:1].islower() and not s[0].islower(),
            "goes": bool(after) and (after[0] in "，。、；）%" or after[0].islower()),
            "near": any(0 <= j < len(lines) and kinds[j] == "page_no" for j in (i - 1, i + 1)),
            "folio": bool(_FOLIO.search(s)) and not _TABLE.search(s), "twice": often[c] > 1,
            "title": any(x[:12] in title for x in parts) and c != title, "serial": bool(_SERIAL.search(s)), "collection": bool(_COLLECTION.search(s)), "gap": bool(re.search(r"\S[\s　]{2,}\S|[\s　]\d+$", s)), "indent": line[:1] in " 　",
            "open": s[-1] not in _END, "heading": bool(_HEADING.match(line)) or s in model.headings, "table": bool(_TABLE.search(line)), "short": len(s) < 0.75 * width, "first": p < 0, "last": n >= len(lines),
        }
        # A short open line inside a sentence that goes on after it.
        f["wedge"] = f["open"] and f["short"] and f["cut"] and not (f["table"] or f["heading"])
        f["alone"] = f["open"] and f["short"] and not (f["cut"] or f["table"] or f["heading"] or f["comma"])
        f["same"] = c in title
        # Whether the lines around belong together, and this one with either, by the pairs of characters where they meet.
        first, last = re.sub(r"\d", "0", after.lstrip()[:1]), re.sub(r"\d", "0", before[-1:])
        f["bridge"] = f["cut"] and last + first in grams
        f["up"], f["down"] = f["cut"] and last + re.sub(r"\d", "0", s[:1]) in grams, f["open"] and re.sub(r"\d", "0", s[-1:]) + first in grams
        f["torn"] = f["bridge"] and not f["up"] and not f["down"] and f["open"]
        f["beside"] = f["near"] and f["open"] and (f["short"] or not f["up"]) and not (f["table"] or f["heading"] or f["comma"])
        f["upper"] = f["cut"] and s[0].isupper() and after[:1].islower()
        out.append(_pairs(f))
    return out


def join_features(line: str, after: str, width: int) -> list[str]:
    s, t = line.rstrip(), after.strip()
    last, first = (s[-1:] or "^"), (t[:1] or "$")
    full = "f" if len(s) >= 0.9 * width else "h" if len(s) >= 0.7 * width else "s"
    special = "t" if _TABLE.search(after) else "h" if _HEADING.match(after) else "i" if after[:1] in " 　" else "-"
    end = "." if last in _END else "m" if last in _MARKS else _kind(last)
    mine = "t" if _TABLE.search(line) else "h" if _HEADING.match(line) and len(s) < 12 else "-"
    return ["b", f"e{end}", f"f{full}", f"s{special}", f"x{end}{_kind(first)}", f"y{end}{full}{special}{mine}", f"z{end}{full}{_kind(first)}", f"m{mine}{special}"]


def _wrap(text: str, width: int, r: random.Random) -> list[tuple[str, str]]:
    """(line, what its end needs) of one paragraph as a printer breaks it."""
    out, at = [], 0
    while at < len(text):
        e = min(len(text), at + width)
        act = "join"
        if e < len(text):
            if text[e - 1].isascii() and text[e].isascii() and text[e - 1].isalpha() and text[e].isalpha():
                s = e
                while s > at and text[s - 1].isascii() and text[s - 1].isalpha():
                    s -= 1
                t = e
                while t < len(text) and text[t].isascii() and text[t].isalpha():
                    t += 1
                if t - s >= 6 and min(e - s, t - e) >= 2 and r.random() < 0.7:
                    out.append((text[at:e] + r.choice(_MARKS), "mend"))
                    at = e
                    continue
                if s > at:
                    e = s
            elif text[e] == " ":
                pass
            line = text[at:e]
            if line.endswith(" ") or text[e] == " ":
                act = "space"
                out.append((line.rstrip(" "), act))
                at = e + (text[e] == " ")
                continue
            out.append((line, act))
        else:
            out.append((text[at:e], "keep"))
        at = e
    return out


def count_usual(texts: list[str]) -> tuple[np.ndarray, np.ndarray, Counter, Counter]:
    """(codes of pairs, and of triples with a character of the table, their counts, counts of Latin words, texts of short lines).

    A code has 21 bits a character; figures are equal.
    """
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points[(points >= 48) & (points <= 57)] = 48
    part = np.isin(points, _TABLE_POINTS)
    line = points == 10
    codes = []
    for k in (2, 3):
        if len(points) < k:
            continue
        n = len(points) - k + 1
        code, some, none = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
        for j in range(k):
            code = code << 21 | points[j : j + n]
            some |= part[j : j + n]
            none |= line[j : j + n]
        codes.append(code[~none] if k == 2 else code[some & ~none])
    keys, counts = np.unique(np.concatenate(codes) if codes else np.empty(0, np.int64), return_counts=True)
    lines = Counter(x for t in texts for x in {y.strip() for y in t.split("\n") if len(y) <= HEADING_CHARS and y.strip() and y.rstrip()[-1] not in _END})
    return keys, counts, Counter(w for t in texts for w in re.findall("[a-z]+", t.lower())), lines


_TABLE_POINTS = np.array(sorted({ord(c) for c in "".join([*SPOTS, *(m for ms in SPOTS.values() for m in ms)]) if c > "\x7f"}), np.int64)


def _gram(code: int) -> str:
    return "".join(chr(code >> b & 0x1FFFFF) for b in (42, 21, 0) if code >> b)


Usual = tuple[frozenset, dict, frozenset]


def usual(clean: DataFrame, text: str, share: float = USUAL, headings: float = HEADINGS, least: int = LEAST) -> Usual:
    """(pairs and triples of characters, words with their counts, headings) that are usual in all of ``clean``, counted task by task and combined."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if t]
            keys, counts, words, lines = count_usual(texts)
            kinds = ["g"] * len(keys) + ["w"] * len(words) + ["l"] * len(lines) + ["G", "W", "L"]
            codes, names = [*keys.tolist(), *[None] * (len(words) + len(lines) + 3)], [*[None] * len(keys), *words, *lines, None, None, None]
            sums = [*counts.tolist(), *words.values(), *lines.values(), sum(map(len, texts)), sum(words.values()), len(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(codes, pa.int64()), pa.array(names, pa.string()), pa.array(sums, pa.int64())], names=["kind", "g", "w", "n"])

    counted = cut(clean.select(text).mapInArrow(work, "kind string, g bigint, w string, n bigint").groupBy("kind", "g", "w").agg(F.sum("n").alias("n")))
    total = {r.kind: r.n for r in counted.where("kind in ('G', 'W', 'L')").collect()}  # three rows
    need = {"g": share * total.get("G", 0), "w": share * total.get("W", 0), "l": headings * total.get("L", 0)}
    grams, words, lines = [], {}, []
    for r in counted.where(" or ".join(f"(kind = '{k}' and n >= {max(least, v)})" for k, v in need.items())).toLocalIterator():
        if r.kind == "g":
            grams.append(_gram(r.g))
        elif r.kind == "w":
            words[r.w] = r.n
        else:
            lines.append(r.w)
    return frozenset(grams), words, frozenset(lines)


def _printed(text: str) -> list[str]:
    """The paragraphs of a text as they would be printed: from the first sentence to the last, without the menus and lists of links of web pages."""
    x = [p for p in text.split("\n") if p.strip()]
    ended = [i for i, p in enumerate(x) if p.rstrip()[-1] in _END]
    x = x[max(0, ended[0] - 1) : ended[-1] + 1] if ended else x
    return [p for p in x if p.rstrip()[-1] in _END or _HEADING.match(p) or not re.search(r"[|>»/＞：:【]|\S[\s　]{2,}|^\s*\W|\d", p)]


def train(texts: list[tuple[str, str]], seed: int = 1, known: Usual | None = None) -> ScanModel:
    """A model from clean (title, text) pairs; noise is put in by rule. ``known`` is what ``usual`` gives, else it is counted in ``texts``."""
    r = random.Random(seed)
    if known is None:
        keys, counts, words, lines = count_usual([t for _, t in texts])
        known = frozenset(_gram(int(k)) for k, n in zip(keys, counts) if n >= LEAST), {w: n for w, n in words.items() if n >= LEAST}, frozenset(x for x, n in lines.items() if n >= max(LEAST, HEADINGS * len(texts)))
    model = ScanModel(*known, {}, {}, {}, {})
    wrong_of: dict[str, list[str]] = defaultdict(list)
    for seen, meants in SPOTS.items():
        for m in meants:
            wrong_of[m].append(seen)
    titles = [t for t, _ in texts if t] or ["Report"]
    docs = []
    for title, t in texts:
        width, rows = r.randint(24, 60) if re.search("[一-鿿]", t) else r.randint(50, 90), []
        paragraphs = _printed(t)
        if len(paragraphs) > 3 and r.random() < 0.1:
            paragraphs.insert(r.randrange(len(paragraphs)), r.choice(paragraphs))
        for x in paragraphs:
            lines = _wrap(x.strip(), width, r)
            if r.random() < 0.4 and not _HEADING.match(x):
                lines[0] = ("　　" + lines[0][0], lines[0][1])
            rows += [(a, b, "") for a, b in lines]
            if r.random() < 0.06:
                rows += [(f"{r.choice(titles)[:5]}  {r.random() * 300:.3f}  {r.random() * 300:.3f}", "keep", "") for _ in range(r.randint(1, 4))]
            if r.random() < 0.03:  # figures that are text: a cell, a year, a value at the end of a paragraph
                rows += [(r.choice([f"{r.random() * 300:.2f}", f"{r.randint(1990, 2030)}年", f"（{r.randint(1, 9)}）{r.choice(titles)[:4]}", f"{r.randint(1, 99)}%", f"{r.random():.3f} mg/L.", f"{r.randint(1, 300)}处。"]), "keep", "")]
        if r.random() < 0.7:
            every, page = r.randint(3, 18), r.randint(1, 90)
            numbered, headed, folio = r.random() < 0.5, r.random() < 0.85, r.random() < 0.3
            # Running headers: the title or a part of it, a heading, or the name of a collection, often with a serial number.
            other, heading = r.choice(titles), next((x.strip() for x in paragraphs if len(x) < 24), title)
            serial = r.choice(["", "", "　第%d卷" % r.randint(1, 40), " 第%d辑" % r.randint(1, 40), " Vol. %d" % r.randint(1, 40), " No. %d" % r.randint(1, 99)])
            name = r.choice([title[-24:-2], title[:18], heading, other[: r.randint(4, 10)], other[: r.randint(4, 10)], " ".join(other.split()[-2:]), " ".join(other.split()[:3])])
            if r.random() < 0.5:
                name = r.choice([name[:10] + r.choice(_COLLECTIONS), r.choice(_COLLECTIONS) + "·" + name]) if re.search("[一-鿿]", name) else name + r.choice([" — ", ", ", " "]) + r.choice(["", "Annual ", "Technical "]) + r.choice(_COLLECTIONS_EN)
            name = name + (serial if len(name) < 20 else "") if name.strip() else ""
            out = []
            for i, row in enumerate(rows):
                if i % every == every - 2:
                    page += 1
                    number = r.choice(["- %d -", "%d", "%d", "— %d —", "第%d页", "%d / 240", "Page %d", "·%d·", "（%d）", "[%d]", "%d of 202", "第 %d 页", "%d | P a g e", "~%d~"]) % page
                    head = name + (r.choice(["  %d", "······%d", "　　%d"]) % page if folio else "")
                    if numbered or not name:
                        out.append((number, "furniture", "page_no"))
                    if headed and name:
                        out.append((head, "furniture", "header"))
                out.append(row)
            rows = out
        if len(rows) > 12 and r.random() < 0.6:  # most texts are a page or two
            start = r.randrange(len(rows) - 10)
            rows = rows[start : start + r.randint(8, 20)]
        docs.append((title, width, rows))
    pages, numbers = [], []
    for title, _, rows in docs:
        lines = [a for a, _, _ in rows]
        kinds = [kind if kind == "page_no" else "" for _, _, kind in rows]
        numbers += [(fs, kind == "page_no") for fs, (_, _, kind) in zip(number_features(lines), rows) if fs]
        pages += [(fs, kind == "header") for fs, (_, _, kind) in zip(page_features(lines, kinds, title, model), rows) if fs and kind != "page_no"]
    for _ in range(2 * PASSES):
        r.shuffle(numbers)
        for fs, right in numbers:
            s = model.number.score(fs)
            if right:
                model.number.learn(fs, [] if s <= 1 else None)
            else:
                model.number.learn([], fs if s >= -1 else None)
        r.shuffle(pages)
        for fs, header in pages:
            s = model.page.score(fs)
            # Headers are few beside lines of text, so they get the wider margin.
            if header:
                model.page.learn(fs, [] if s <= 3 else None)
            else:
                model.page.learn([], fs if s >= -1 else None)
    for _ in range(PASSES):
        r.shuffle(docs)
        for title, _, rows in docs:
            body = [(a, act) for a, act, k in rows if not k]
            lengths = sorted(len(a) for a, _ in body)
            width = lengths[int(len(lengths) * 0.8)] if lengths else 1
            for (a, act), (b, _) in zip(body, body[1:]):
                fs = join_features(a, b, width)
                guess = model.line_end(a, b, width)
                model.join.learn([act + f for f in fs], [guess + f for f in fs] if guess != act else None)
            for a, _ in body:
                _learn_chars(model, a, wrong_of, r)
    return ScanModel(*known, model.edit.averaged(), model.number.averaged(), model.page.averaged(), model.join.averaged())


def _learn_chars(model: ScanModel, line: str, wrong_of: dict, r: random.Random) -> None:
    noisy, truth, size = [], {}, 0
    for i, c in enumerate(line):
        p, n = line[i - 1 : i], line[i + 1 : i + 2]
        options = wrong_of.get(c)
        if options and r.random() < (0.05 if c.isdigit() else 0.02 if c.isascii() else 0.25):
            w = r.choice(options)
            truth[size, w] = c
        elif "a" <= c <= "z" and "a" <= p <= "z" and "a" <= n <= "z" and r.random() < 0.01:  # a letter is lost
            w = ""
            truth[size, w] = c
        elif r.random() < 0.002:  # a speck is read
            w = r.choice(_SPECKS) + c
            truth[size, w[0]] = ""
        else:
            w = c
        noisy.append(w)
        size += len(w)
    text = "".join(noisy)
    for m, seen, readings in model.spots(text):
        right = truth.get((m, seen))
        for meant, f, loses in readings:
            keep, change = model._features(text, m, seen, meant, f, loses)
            s = model.edit.score(change) - model.edit.score(keep)
            # A margin on the side of keeping: a wrong repair is worse than a missed one.
            if meant == right:
                model.edit.learn(change, keep if s <= 0 else None)
            else:
                model.edit.learn(keep, change if s >= -1 else None)


def fit(clean: DataFrame, title: str, text: str, sample: int = SAMPLE, shortest: int = SHORTEST, longest: int = LONGEST) -> ScanModel:
    """Trained on at most ``sample`` clean texts, chosen by a hash (the only rows that reach the driver), with the usual words and pairs of all."""
    some = bounded_sample(clean.select(F.coalesce(F.col(title), F.lit("")).alias("a"), F.col(text).alias("b")), ["b", "a"], sample, F.length("b").between(shortest, longest))
    return train([(x.a, x.b) for x in some.toLocalIterator()], known=usual(clean, text))


def find_noise(lines: list[str], title: str, model: ScanModel) -> tuple[list[str], list[tuple[int, str]], str]:
    """(kind of furniture by line, (line index, kind) found, repaired text)."""
    kinds = model.furniture(lines, title)
    found = [(i, k) for i, k in enumerate(kinds) if k]
    body = [i for i, k in enumerate(kinds) if not k and lines[i].strip()]
    lengths = sorted(len(lines[i]) for i in body)
    width = lengths[int(len(lengths) * 0.8)] if lengths else 1
    out: list[str] = []
    broken = False
    for j, i in enumerate(body):
        before, line = broken, lines[i]
        after = lines[body[j + 1]] if j + 1 < len(body) else ""
        act = model.line_end(line, after, width) if after else "keep"
        broken = act == "mend" and bool(_BROKEN.search(line)) and after.strip()[:1].isalpha()
        line, n = model.fix_line(line, before, broken)
        if n:
            found.append((i, "misread"))
        if broken:
            found.append((i, "split_word"))
        elif act == "mend":
            act = "join"
        out.append({"keep": line + "\n", "join": line.rstrip(), "space": line.rstrip() + " ", "mend": line.rstrip()[:-1]}[act] if after else line)
    text = "".join(x if k == 0 or out[k - 1].endswith("\n") else x.lstrip() for k, x in enumerate(out))
    return kinds, found, text


def scan_noise(df: DataFrame, model: ScanModel, key: str = "seq", title: str = "title", content: str = "content") -> DataFrame:
    """(key, lines array<struct<line_no,kind>>, text): noise of each record and its text as continuous paragraphs."""
    packed = pickle.dumps((model.grams, model.words, model.headings, model.edit.w, model.number.w, model.page.w, model.join.w))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = ScanModel(*pickle.loads(packed))
        for b in batches:
            rows = []
            for k, t, c in zip(*(b.column(i).to_pylist() for i in range(3))):
                if not c:
                    rows.append((k, [], c))
                    continue
                _, found, text = find_noise(c.split("\n"), t or "", m)
                rows.append((k, [{"line_no": i + 1, "kind": kind} for i, kind in found], text))
            kind = pa.list_(pa.struct([("line_no", pa.int64()), ("kind", pa.string())]))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema[0].type), pa.array(cols[1], kind), pa.array(cols[2], pa.string())], names=["k", "lines", "text"])

    name = df.schema[key].dataType.simpleString()
    return df.select(key, title, content).mapInArrow(work, f"k {name}, lines array<struct<line_no:bigint,kind:string>>, text string").withColumnRenamed("k", key)
