"""Problem 2: page boilerplate mixed with main content.

The text of a page is read as a tree: page, sections (parted by the title and by runs of two or more link
lines, as menus are), blocks (parted by single link lines) and lines. Each line passes points for length and
commas to its block, discounted by its link density, and every block passes its points on to its section,
discounted by the link density of the whole block. Link density is the share of characters in pieces that are
links (separated short items, bullets, dated or labelled titles, paths) or that very many pages of the
corpus share. The best section and those of its siblings that have SIBLING of its points are kept; whatever
lies outside is frame, and inside them the lines that are links.

How many records share a line is counted over the whole corpus (the source's and the host's own names
taken out, numbers made equal where the line is no sentence), together with how often a paragraph comes
next: that tells section headings, which stand before paragraphs, from menu entries, which don't. Only
lines in a fixed share of all records are kept from these counts, at most lines-per-record / share of
them, whatever the size of the corpus.

Defined results: null and empty content has no lines; blank lines are neither frame nor body; the title's
own line is neither; texts without any paragraph keep what isn't frame; repeated rows are handled each.
"""

from __future__ import annotations

import functools
import pickle
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from http import HTTPStatus

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirstone.llm.residue import PHRASES, candidates, slot_label

#: A line in this share of all records (and at least FEW of them) is common; from this share of followers on it is a heading; the share of the best section's points that keeps a sibling.
COMMON, FEW, LEADS, SIBLING = 0.002, 4, 0.6, 0.15
#: The longest line in which words of frames count.
WORDY = 120
#: Distinct lines a task counts before it hands them on.
HELD = 150_000
_END = "。！？.!?；;”"
# Words of page frames (counters, consent, sharing, credits, notices, recommendations).
_WORDS = re.compile(
    "cookie|当前位置|您所在的位置|站内搜索|高级检索|浏览次数|阅读量|点击(?:数|量)?[:：]|打印本|关闭窗口|收藏本页|字体[:：]|分享到|扫一扫|二维码|朋友圈|点亮.?在看|责任编辑|责编|审核[:：].{0,20}校对|供稿|信息来源[:：]|来源[:：].{0,20}$|版权所有|转载|权属|与.{1,24}立场无关|备案|网站标识码|主办单位|技术支持|联系我们|网站地图|隐私声明|无障碍|分辨率|邮编[:：]|相关阅读|猜你喜欢|热点推荐|延伸阅读|推荐阅读|上一篇|下一篇|返回顶部|订阅|知道了|本地数据|"
    "all rights reserved|terms of (?:use|reuse)|privacy|accessibility statement|sitemap|subscribe|newsletter|you are here|skip to|share this|was this article|related articles|you may also like|most read|download citation|views:|text size|reproduced with permission|views expressed here|published by .{0,80}licence|copyright|©|accept all|menu\\s+search|follow us|print this"
)
_SEPARATED = re.compile(r"\s*[|｜│›»>/·•]+\s*|\s{2,}|　+|】\s*【")
_ITEM = re.compile(r"^(?:(?:read|see) also|related|推荐阅读|延伸阅读|相关链接)\s*[:：]|^(?:[·•▪◦\-*]|\d{1,2}[.、)])\s*\S|\[\d{1,2}-\d{1,2}\]$|^【[^】]{1,8}】|\(\d{4}-\d{2}-\d{2}\)$", re.I)
_HEADING = re.compile(r"^(?:[一二三四五六七八九十]{1,3}、|[（(][一二三四五六七八九十\d]{1,3}[)）]|第[一二三四五六七八九十\d]{1,3}[章节条]|附(?:件|录)?[:：]?|\d{1,2}(?:\.\d{1,2})*\.?\s)\s*\S{0,24}$")


# A text without any of these can't fit _WORDS, or PHRASES, or the form of a slot; they only save time.
_HINTS = (
    "cookie 位置 站内搜索 高级检索 浏览次数 阅读量 点击 打印 关闭窗口 收藏本页 字体 分享 扫一扫 二维码 朋友圈 点亮 编辑 责编 审核 供稿 来源 版权 转载 权属 立场无关 备案 网站标识码 主办 技术支持 联系我们 网站地图 隐私 无障碍 分辨率 邮编 相关阅读 猜你喜欢 热点推荐 延伸阅读 推荐阅读 上一篇 下一篇 返回顶部 订阅 知道了 本地数据".split(),
    ["all rights", "terms of", "privacy", "accessibility", "sitemap", "subscribe", "newsletter", "you are here", "skip to", "share this", "was this", "related art", "you may also", "most read", "download cit", "views", "text size", "reproduced", "published by", "copyright", "©", "accept all", "menu", "follow us", "print this"],
    "不存在 搬家 移除 没有找到 找不到 过期 失效 撤回 删除 尚未发布 不在此 很遗憾 抱歉 仅对 会员权限 权限 无法 登录 请 加载 正在 开小差 错误 出错 失败 跳转 升级 维护 敬请 暂无数据 建设中 网关 响应 脚本 浏览器 验证 滑块 抓取 过于频繁 浏览得太快 异常 占位 示例 没有实际 测试 勿发布 待录入 文章标题 作者姓名 正文内容 模板 被拒绝".split(),
    ["could not", "looked", "sorry", "not found", "no longer", "missing", "expired", "typed", "removed", "deleted", "moved", "located", "timed out", "did not", "unavailable", "unexpected", "permission", "log in", "sign in", "login", "signin", "members only", "turn on", "enable", "require", "support", "script", "too many", "retry", "robot", "captcha", "puzzle", "connection", "offline", "wait", "loading", "refused", "http", "denied", "subscription", "back ", "maintenance", "lorem", "enim", "dolor", "consectetur", "sample text", "dummy", "placeholder", "replace this", "goes here", "object", "undefined", "null", "nan", "none", "template", "server", "error", "status", "code", "40", "41", "42", "43", "45", "50", "51"],
    [str(x.phrase).lower() for x in HTTPStatus if x >= 400], list("{<%[【_＿×@#") + ["xx", "tbd", "tbc", "todo"],
)


@functools.cache
def _hints():
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, words in enumerate(_HINTS):
        for w in words:
            a.add_word(w, k if w not in a else a.get(w))
    a.make_automaton()
    return a


@functools.lru_cache(maxsize=60_000)
def _about(s: str) -> tuple[bool, bool]:
    """(words of a frame, remains of a response page or template) of a stripped line."""
    low = s.lower()
    if next(_hints().iter(low), None) is None:
        return False, False
    words = bool(_WORDS.search(low))
    return words, bool(PHRASES.search(low)) or any(slot_label(*c) == 1 for c in candidates(s))


def _flat(s: str) -> str:
    return "".join(unicodedata.normalize("NFKC", s).split()).lower()


def _is_paragraph(s: str) -> bool:
    """A sentence, or a long run of damaged text."""
    if len(s) < 8 or _ITEM.search(s) and s[-1] not in _END:
        return False
    if s[-1] in _END and not s.startswith("【"):
        return True
    if "。" in s and len(s) > 20 and "|" not in s:
        return True
    if s.isascii() or len(s) < 6:
        return False
    odd = sum("\x80" <= c <= "ɏ" or c == "�" or "" <= c <= "" for c in s)
    return odd * 4 > len(s) or len(s) > 40 and s.count(",") + s.count("，") + s.count("、") > 1 and "|" not in s


def _key(flat: str, source: str, host: str) -> str:
    for name, mark in ((source, "\x01"), (host, "\x02")):
        if name:
            flat = flat.replace(name, mark)
    return flat if flat[-1:] in _END and "\x01" not in flat and len(flat) > 12 else re.sub(r"\d+", "0", flat)


def _lines(content: str, source: str, host: str) -> list[tuple[int, str, str, int]]:
    """(index, stripped line in NFKC, the line without white space, hash of its key) of the lines that aren't blank."""
    out = []
    content = unicodedata.normalize("NFKC", content)
    for i, line in enumerate(content.split("\n")):
        s = line.strip()
        if s:
            flat = "".join(s.split()).lower()
            out.append((i, s, flat, xxhash.xxh3_64_intdigest(_key(flat, source, host)) - (1 << 63)))
    return out


def _names(source: str | None, url: str | None) -> tuple[str, str]:
    m = re.match(r"\s*[A-Za-z]+://(?:www\.)?([^/?#:.\s]+)", url or "")
    return _flat(source or ""), (m.group(1).lower() if m and len(m.group(1)) > 3 else "")


def common_lines(df: DataFrame, share: float = COMMON) -> dict[int, tuple[float, float]]:
    """hash -> (share of records, share of its places that a paragraph follows), counted over all records.

    Tasks combine their counts before the shuffle. At most mean lines per record / share come to the driver.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0])
        total = 0

        def out() -> pa.RecordBatch:
            cols = [pa.array(list(held), pa.int64())] + [pa.array([v[j] for v in held.values()], pa.int64()) for j in range(3)]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, names=["h", "n", "places", "leads"])

        for b in batches:
            for source, url, content in zip(*(b.column(i).to_pylist() for i in range(3))):
                if not content:
                    continue
                total += 1
                rows, seen = _lines(content, *_names(source, url)), set()
                for j, (_, s, _, h) in enumerate(rows):
                    v = held[h]
                    if h not in seen:
                        seen.add(h)
                        v[0] += 1
                    v[1] += 1
                    v[2] += j + 1 < len(rows) and (_is_paragraph(rows[j + 1][1]) or bool(_HEADING.match(rows[j + 1][1])))
            if len(held) >= HELD:
                yield out()
        if held:
            yield out()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), *(pa.array([total], pa.int64()) for _ in range(3))], names=["h", "n", "places", "leads"])

    counts = df.select("source", "url", "content").mapInArrow(work, "h bigint, n bigint, places bigint, leads bigint").groupBy("h").agg(F.sum("n").alias("n"), F.sum("places").alias("places"), F.sum("leads").alias("leads"))
    total = F.broadcast(df.where("content <> ''").agg(F.count("*").alias("total")))  # one row
    kept = counts.where("h is not null").crossJoin(total).where(F.col("n") >= F.greatest(F.lit(FEW), F.col("total") * share))
    return {r.h: (r.n / r.total, r.leads / r.places) for r in kept.toLocalIterator()}


def link_density(s: str, common: tuple[float, float] | None) -> float:
    """The share of a line's characters in links or in text that many pages share."""
    if _ITEM.search(s) and s[-1] not in _END:
        return 1.0
    if common and (s[-1] in _END or common[1] < LEADS):
        return 1.0
    pieces = [p for p in _SEPARATED.split(s.strip("【】")) if p]
    if len(pieces) >= 3 and s[-1] not in _END:
        return sum(len(p) for p in pieces if len(p) <= (24 if p.isascii() else 12)) / max(1, sum(map(len, pieces)))
    # Words of frames count in short lines only, so a paragraph that names them stays text.
    return 0.6 if len(s) <= WORDY and _about(s)[0] else 0.0


def frame_lines(content: str, title: str, source: str | None, url: str | None, common: dict[int, tuple[float, float]]) -> list[int]:
    """Indexes of the lines that are neither title nor body."""
    rows = _lines(content, *_names(source, url))
    own = _flat(title or "")
    kinds: list[str] = []
    density, points = [], []
    for j, (_, s, flat, h) in enumerate(rows):
        c = common.get(h)
        is_title = bool(own) and flat == own
        words, remains = _about(s)
        d = 0.0 if is_title else 1.0 if own and len(own) > 6 and own in flat and s[-1] not in _END else link_density(s, None if remains else c)
        if is_title:
            kind = "title"
        elif remains and not words:
            kind = "residue"
        elif d >= 0.5:
            kind = "link"
        elif _is_paragraph(s):
            kind = "text"
        elif _HEADING.match(s) or c is not None and c[1] >= LEADS and not re.search(r"[\d|:：]", s) and len(s) <= 30:
            kind = "heading"
        else:
            kind = "short"
        kinds.append(kind)
        density.append(d)
        points.append((1 + sum(map(s.count, "，,、;；")) + min(len(s) / 50, 3)) * (1 - d) if kind in ("text", "residue") else 0.0)
    keep: set[int] = set()
    sections = tree(kinds, density, points, [len(r[1]) for r in rows])
    best = max((w for _, w in sections), default=0.0)
    for lines, w in sections:
        if best > 0 and w >= SIBLING * best:
            last = max((j for j in lines if points[j] > 0), default=-1)
            first = min((j for j in lines if points[j] > 0), default=len(rows))
            for j in lines:
                # Loose short lines inside the body, and beside a message of a response page, stay with it; those before or after it, and menus, don't.
                beside = "residue" in kinds[max(0, j - 1) : j + 2] and rows[j][3] not in common
                if points[j] > 0 or kinds[j] == "heading" or kinds[j] == "short" and (beside or first < j < last and _lone(kinds, j)):
                    keep.add(j)
    if best == 0.0:
        keep = {j for j, k in enumerate(kinds) if k == "short" and not common.get(rows[j][3]) and not re.search(r"\S", own or "") or k == "short" and _bare(rows[j][1])}
    return [rows[j][0] for j, k in enumerate(kinds) if k != "title" and j not in keep]


def tree(kinds: list[str], density: list[float], points: list[float], sizes: list[int]) -> list[tuple[list[int], float]]:
    """(lines, points) of each section of the page.

    A line's points go to its block; a block's, times the share of its characters outside links, to its section.
    """
    sections: list[list[list[int]]] = [[[]]]
    run = 0
    for j, kind in enumerate(kinds):
        run = run + 1 if kind == "link" else 0
        if kind == "title" or run == 2:
            sections.append([[]])
        elif run == 1:
            sections[-1].append([])
        if kind != "title":
            sections[-1][-1].append(j)
    out = []
    for blocks in sections:
        worth = 0.0
        for b in blocks:
            size = sum(sizes[j] for j in b)
            if size:
                worth += sum(points[j] for j in b) * (1 - sum(density[j] * sizes[j] for j in b[1:] or b) / size)
        if any(blocks):
            out.append(([j for b in blocks for j in b], worth))
    return out


def _bare(s: str) -> bool:
    """What is left of a response page beside its message: a mark and a number."""
    return bool(re.search(r"[0-9a-f]{4,}|^\W+$", s))


def _lone(kinds: list[str], j: int) -> bool:
    return not (j and kinds[j - 1] == "short") and not (j + 1 < len(kinds) and kinds[j + 1] == "short")


def main_text(df: DataFrame, key: str = "seq", common: dict | None = None) -> DataFrame:
    """df(key, title, source, url, content) -> (key, frame array<bigint> of line numbers from 1, body string)."""
    packed = pickle.dumps(common_lines(df) if common is None else common)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = pickle.loads(packed)
        for b in batches:
            frames, bodies = [], []
            for title, source, url, content in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
                gone = frame_lines(content, title or "", source, url, shared) if content else []
                frames.append([i + 1 for i in gone])
                drop = set(gone)
                bodies.append(content if not drop else "\n".join(x for i, x in enumerate(content.split("\n")) if i not in drop))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(frames, pa.list_(pa.int64())), pa.array(bodies, pa.string())], names=["k", "frame", "body"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "title", "source", "url", "content").mapInArrow(work, f"k {kind}, frame array<bigint>, body string").withColumnRenamed("k", key)
