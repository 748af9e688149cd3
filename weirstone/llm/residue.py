"""Problem 1: error pages, script notices, filler and unfilled templates in place of content.

A value is cut into segments (lines, then sentences). An L2-regularised linear classifier over hashed
character n-grams, length and title features puts each into one of three classes: body, frame (the page
around it) or residue. Its weak labels come from response statuses (every reason phrase of HTTP, as such
pages word it) and from families of phrases, read in their context: a phrase that makes up its value is
residue, the same phrase among sentences of an article is body, so that reports on such pages are learnt
as what they are. A second classifier of the same kind judges slot candidates (bracketed words, runs of
blanks, marks around a name) by n-grams of what they hold, their delimiters, shape and neighbours; its weak
labels are forms of template languages and instructions on the one side, numbers, one-letter variables
and ordinary remarks in brackets on the other. Candidates of no listed form are left to the classifier.

The threshold of either is set on hosts that were kept out of training, where it agrees best with the weak
labels (F1). ``validate`` reports the agreement on such hosts, and ``validate_families`` how
much of a family of phrases is found by a model that was trained without it.

A value is a case if residue makes up its text apart from the frame, or if it holds an unfilled slot.

Defined results: null, empty and blank values are no cases; very long values are read whole; repeated
rows are each reported; ties between classes go to body.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from http import HTTPStatus

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirstone.llm.spread import bounded_sample

#: Values the classifier is trained on at most (and a third as many that hold a phrase); hash buckets; the share of values from which on a segment is frame; body segments kept for training.
SAMPLE, BUCKETS, SHARED, BODY_KEPT = 6_000, 1 << 15, 0.004, 12_000
BODY, FRAME, RESIDUE = 0, 1, 2

_REASONS = [s.phrase.lower() for s in HTTPStatus if s >= 400]
# Families of phrases by which pages without content are worded. They give weak labels only.
FAMILIES = {
    "status": r"(?:error|http|status|code)\W{0,3}[45]\d\d\b|\b[45]\d\d\W{1,3}(?:error|" + "|".join(map(re.escape, _REASONS)) + r")|^(?:" + "|".join(map(re.escape, _REASONS)) + r")\W*$|internal (?:server )?error|unexpected error|内部错误|页面出错|错误类型|网关|did not answer|refused the request|timed out|响应超时|连接失败",
    "missing": r"(?:页面|网页|内容|文章|资源|链接|文档|栏目).{0,16}(?:不存在|搬家|移除|没有找到|找不到|过期|失效|撤回|删除|尚未发布)|找不到|没有找到|不在此服务器|(?:page|link|item|content|file|article)\b.{0,40}(?:not found|no longer|missing|has expired|(?:was|been|be) (?:removed|deleted|moved|located|found))|could not be (?:located|found|loaded)|we looked everywhere|typed incorrectly|^\W*sorry\b|^\W*抱歉|很遗憾",
    "access": r"(?:请|需)(?:先|要)?(?:重新)?登录|登录状态|会员权限|无法(?:查看|阅读|打开)|仅对.{0,12}开放|权限设置|(?:log|sign) ?in (?:to|again)|members only|do(?:es)? not have permission|access (?:is )?denied|subscription required|访问被拒绝",
    "challenge": r"not a robot|connection is secure|too many requests|retry later|验证码|图形验证|滑块|自动抓取|访问(?:过于频繁|请求存在异常)|浏览得太快|complete the (?:puzzle|captcha)",
    "script": r"(?:turn on|enable|requires?|supports?).{0,24}(?:script|javascript)|script-capable|(?:需要|禁用了?|启用|不支持).{0,6}脚本|浏览器.{0,10}(?:版本|较旧|启用|升级)",
    "loading": r"加载中|正在(?:加载|跳转|转换|升级|维护|抢修)|升级维护|开小差|请(?:稍候|稍后)|敬请(?:谅解|期待)|暂无数据|建设中|^\W*loading\b|please wait|temporarily (?:offline|unavailable)|(?:service|page|content).{0,20}unavailable|back (?:soon|shortly)|under maintenance",
    "filler": r"lorem ipsum|dolor sit amet|consectetur|ut enim ad minim|sample text|dummy (?:copy|text)|placeholder|replace this (?:text|paragraph)|goes here|占位|示例(?:段落|文字|文本)|没有实际含义|(?:测试){2}|请勿发布|请输入正文|待录入|^文章标题$|^作者姓名$|正文内容",
    "literal": r"^\W*(?:\[object object\]|undefined|null|nan|none|template|【模板】)\W*$",
}
PHRASES = re.compile("|".join(f"(?:{p})" for p in FAMILIES.values()))
#: Texts of response pages as servers write them, and reports that name the same statuses: training segments that need no sample.
STATUS_TEXTS = [t for s in HTTPStatus if s >= 400 for t in (f"{s.value} {s.phrase}", f"{s.phrase}", f"HTTP Error {s.value}: {s.phrase}", f"{s.value} {s.phrase} nginx", f"Error {s.value}. {s.phrase}.")]
STATUS_TEXTS += [f.format(x) for x in ("page", "article", "link", "document", "file", "content") for f in ("{} not found", "{} missing", "This {} is unavailable.", "The {} you requested no longer exists.", "This {} has been removed.", "Please sign in to read this {}.", "Loading {}, please wait...")]
STATUS_TEXTS += [f.format(x) for x in ("页面", "文章", "链接", "文档", "内容") for f in ("{}不存在", "您访问的{}不存在或已删除。", "{}无法访问，请稍后再试", "{}加载失败，请刷新重试", "请登录后查看{}")]
REPORT_TEXTS = [t for i, s in enumerate(HTTPStatus) if s >= 400 for t in (f"The log of the station portal lists {37 * i} requests that ended in {s.value} {s.phrase} between {1990 + i % 30} and {2000 + i % 25}.", f"In 20{i % 25:02d}, {11 * i} users reported error {s.value} ({s.phrase.lower()}), and all were answered.", f"运行日志显示，第{i}周平台共返回{s.value}状态{29 * i}次，较上月减少{i % 9}次。")]
REPORT_TEXTS += [f.format(x, 13 * i + 5) for i, x in enumerate(("页面", "文章", "链接", "文档", "内容", "登录", "脚本", "升级")) for f in ("本月共收到“{}不存在”类反馈{}件，均已处理。", "第二季度{}异常共{}次，经维护后恢复正常。", "问卷显示，{}加载缓慢的情况占{}%。")]

# What may be a slot at all: bracketed words, names between doubled marks, blanks, words for no value.
_VOID = r"(?:undefined|null|NaN|None|%[sd])"
CANDIDATE = re.compile(
    r"[$#%@]?[{｛]{1,2}[^{}｛｝\n]{0,40}[}｝]{1,2}|%\([^()\n]{1,30}\)[sdrf]|<%[^%\n]{0,60}%>|\[{1,2}[^\[\]\n]{1,40}\]{1,2}|【[^【】\n]{1,30}】|[<＜〈][^<>＜＞〈〉\n]{1,40}[>＞〉]|[(（][^()（）\n]{1,30}[)）]|(?<![〔0-9])[×Xx]{2,}[〔\[（(][^〔〕\[\]()（）\n]{2,6}[〕\]）)]|〔[^〔〕\n]{1,20}〕"
    rf"|([%@#_＿~])\1[A-Za-z][\w ]{{1,30}}\1\1|[_＿]{{2,}}(?:TODO|TBD)?|[×Xx]{{2,}}年[×Xx]{{1,2}}月(?:[×Xx]{{1,2}}日)?|(?<![A-Za-z0-9])[×Xx]{{2,}}(?![A-Za-z0-9])|\b{_VOID}(?:[年月日/:.\-](?:{_VOID}|\d+)?)+|(?<!\d)%[sd]|\bT\.?B\.?[DC]\b\.?|\bTODO\b"
)
# Words that tell the writer to put something in.
_ORDER = re.compile(r"insert|\badd\b|\bfill|\benter\b|\byour\b|\btb[dc]\b|to ?do\b|placeholder|to be (?:added|completed|confirmed|determined|inserted|supplied)|待(?:补充|填|完善|核实|定|录|确认)|(?:请|此处|这里).{0,3}(?:插入|填|补|输入)|^(?:插入|填写|填入|补充|输入)", re.I)
# Names of the parts a form asks for.
_PART = re.compile(r"^(?:联系|单位|日期|姓名|作者|部门|地点|地址|电话|会议|标题|摘要|正文|附件|名称|要点)[一-鿿]{0,6}$|^(?:DATE|NAME|VALUE|UNIT|TITLE|AUTHOR|ADDRESS|YEAR)\b", re.I)
_SPLIT = re.compile(r"\n|(?<=[。！？!?])|(?<=[a-z)]\.) (?=[A-Z])")
_LINKS = re.compile(r"[|｜»›>]|\s{2,}|　|】\s*【|^[·•\-]\s|^\d{1,2}[.、)]\s?[^\d\s][^。.!?！？]*$|\[\d\d-\d\d\]$")


def slot_label(s: str, before: str, after: str) -> int:
    """Weak label of a candidate: 1 by a form of template languages or an instruction, 0 by an ordinary form, -1 if neither is known."""
    inner = s.strip("{}｛｝[]【】<>＜＞〈〉()（）〔〕$#%@_＿~= ").strip()
    if re.fullmatch(r"[$#%@]?\{\{.*\}\}|[$#@]\{.*\}|<%.*%>|%\(.*\)[sdrf]|([%@#_＿~])\1[A-Za-z].*\1\1|\[\[.*\]\]|\{\d{1,2}\}", s):
        return 1
    if _ORDER.search(inner) or _PART.search(inner) and s[0] in "[<【〈":
        return 1
    if re.fullmatch(rf"[_＿]{{2,}}.*|[×Xx]{{2,}}.*|{_VOID}([年月日/:.\-]({_VOID}|\d+)?)+|%[sd]|T\.?B\.?[DC]\.?|TODO", s):
        return 1
    if re.fullmatch(r"[A-Za-z一二三四五六七八九十]|[\d\s.,:/~–—+\-年月日第期号卷页条部分]+|[A-Z][A-Za-z\d₂-₉]{0,6}", inner):
        return 0
    return 0 if s[0] in "(（〔【" else -1


#: Candidates as template languages and formulas write them: training cases that need no sample.
_FIELDS = "name title date year month author unit place value station address number content summary email phone site_name user.name FIGURE_REF 单位名称 日期 联系电话".split()
SLOT_TEXTS = [(f.format(w), p, n) for w in _FIELDS for f in ("{{{{{}}}}}", "{{{{ {} }}}}", "${{{}}}", "#{{{}}}", "<%= {} %>", "%%{}%%", "@@{}@@", "__{}__", "[[{}]]", "%({})s", "{{{}}}") for p, n in ((" ", " "), ("，", "在"))]
NO_SLOT_TEXTS = [(f.format(w), p, n) for w in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" for f in ("{{{}}}", "[{}]", "<{}>") for p, n in ((" ", " "), ("中", "取"))]
_REMARKS = "see Part 3|Figure 2|in Chinese|in press|see below|n = 12|and others|or less|for example|approx. 5 km|Table 4, left|the upper reach|sic|EU|WHO|p < 0.05|total phosphorus|mean of three|since 2009|both banks|试行|见附件|暂行|含支流|以下简称|详见第3章|不含税|总则|修订版|左岸|上游|表2|单位：毫克|第二次|即枯水期|平均值|征求意见稿|节选|例如|约5公里".split("|")
NO_SLOT_TEXTS += [(f.format(w), p, n) for w in _REMARKS for f in ("({})", "（{}）", "[{}]", "【{}】") for p, n in ((" ", "."), ("在", "，"))]


def slot_features(found: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """(index, bucket) of the features of candidates (text, character before, character after)."""
    at, buckets = [], []
    for i, (s, p, n) in enumerate(found):
        m = re.match(r"(?s)([\W_]*)(.*?)([\W_]*)$", s)
        opens, inner, shuts = m.groups()
        low = "\x02" + re.sub(r"\d", "0", inner.lower())[:60] + "\x03"
        shape = re.sub(r"(.)\1+", r"\1", "".join("0" if c.isdigit() else "汉" if "一" <= c <= "鿿" else "A" if c.isupper() else "a" if c.isalpha() else c for c in inner))[:20]
        kind = lambda c: "^" if not c or c == "\n" else "0" if c.isdigit() else "汉" if "一" <= c <= "鿿" else "a" if c.isalpha() else c
        fs = {f"o{opens}", f"c{shuts}", f"d{opens[-2:]}{shuts[:2]}", f"s{shape}", f"S{opens}{shape}", f"l{min(len(inner), 12)}", f"p{kind(p)}", f"n{kind(n)}", f"D{opens}{shuts}l{len(inner) < 2}", f"w{bool(_ORDER.search(inner))}", f"1{len(inner) == 1 and inner.isalpha()}", f"2{len(inner) == 1 and inner.isalpha()}{opens[-1:]}", f"W{bool(_PART.search(inner))}{opens[-1:]}", *(f"g{low[a : a + k]}" for k in (2, 3) for a in range(len(low) - k + 1))}
        hs = {zlib.crc32(f.encode("utf-8", "replace")) % BUCKETS for f in fs}
        at += [i] * len(hs)
        buckets += hs
    return np.array(at, np.int64), np.array(buckets, np.int64)


def segments(text: str) -> list[str]:
    return [s for s in (x.strip() for x in _SPLIT.split(text)) if s]


def candidates(text: str) -> list[tuple[str, str, str]]:
    """(candidate, character before, character after)."""
    return [(m.group(), text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]) for m in CANDIDATE.finditer(text)]


def _plain(s: str) -> str:
    return unicodedata.normalize("NFKC", s).lower()


_SALT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint64)


def features(segs: list[str], titles: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(segment index, bucket) of each feature of each segment: n-grams of 1 to 3 characters with their edges, length, title."""
    texts = ["\x02" + _plain(s) + "\x03" for s in segs]
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points = np.where((points >= 48) & (points <= 57), np.uint64(48), points)
    owner = np.repeat(np.arange(len(segs)), lengths)
    rest = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))  # characters to the end of the segment
    at, buckets, h = [], [], np.zeros(len(points), np.uint64)
    for n in range(1, 4):
        if len(points) < n:
            break
        h = h[: len(points) - n + 1] * np.uint64(0x100000001B3) + (points[n - 1 :] + np.uint64(1)) * _SALT[n]
        keep = rest[: len(h)] >= n
        x = h[keep] ^ (h[keep] >> np.uint64(29))
        buckets.append(((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)) % np.uint64(BUCKETS - 64))
        at.append(owner[: len(h)][keep])
    size = np.minimum(np.log2(lengths).astype(np.int64), 11) + (BUCKETS - 64)
    titled = np.array([BUCKETS - 50 + (2 if t and t in s else 1 if t and s in t else 0) for s, t in zip(segs, titles)], np.int64)
    slot = np.array([BUCKETS - 40 + _is_slots(s) for s in segs], np.int64)
    linked = np.array([BUCKETS - 38 + bool(_LINKS.search(s)) for s in segs], np.int64)
    every = np.arange(len(segs))
    return np.concatenate([*at, every, every, every, every]), np.concatenate([*[b.astype(np.int64) for b in buckets], size, titled, slot, linked])


def _is_slots(s: str) -> bool:
    """Half of the segment or more is made of forms of slots."""
    return 2 * sum(len(c) for c, p, n in candidates(s) if slot_label(c, p, n) == 1) > len(s)


def _key(s: str, source: str) -> str:
    p = re.sub(r"\s+", "", _plain(s))
    if source:
        p = p.replace(re.sub(r"\s+", "", _plain(source)), "\x01")
    return p if p[-1:] in "。.!?" and not p.startswith("©") else re.sub(r"\d+", "0", p)


def _sentence(s: str) -> bool:
    return len(s) >= 20 or len(s) >= 12 and s[-1] in "。.!?！？；;"


def weak_labels(segs: list[str], title: str, source: str, shared: set[str], phrases: re.Pattern = PHRASES) -> list[int]:
    """Classes of one value's segments by rule, -1 where the rules say nothing.

    A phrase is residue where phrases outweigh the sentences beside them, and body among three or more
    sentences that have none; between these nothing is said.
    """
    kinds = []
    for s in segs:
        if _LINKS.search(s) and s[-1] not in "。.!?！？" or title and (s in title or title in s):
            kinds.append("frame")
        elif phrases.search(_plain(s)) or _is_slots(s):
            kinds.append("phrase")
        elif _key(s, source) in shared:
            kinds.append("frame")
        else:
            kinds.append("text" if _sentence(s) else "short")
    phrase = sum(len(s) for s, k in zip(segs, kinds) if k == "phrase")
    text = sum(len(s) for s, k in zip(segs, kinds) if k == "text")
    residue, body = phrase > 0 and phrase >= text, kinds.count("text") >= 3 and text >= 4 * phrase or phrase == 0 and text > 0
    names = {"frame": FRAME, "phrase": RESIDUE if residue else BODY if body else -1, "text": RESIDUE if residue else BODY if body else -1, "short": RESIDUE if residue else -1}
    return [names[k] for k in kinds]


class Linear:
    """Scores of hashed features by class; weights of shape (BUCKETS, classes)."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def scores(self, at: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        count = np.sqrt(np.maximum(np.bincount(at, minlength=n), 1))
        return np.stack([np.bincount(at, self.weights[bucket, c], n) / count for c in range(self.weights.shape[1])], 1)


def train(at: np.ndarray, bucket: np.ndarray, labels: np.ndarray, classes: int, heavy: np.ndarray | None = None, steps: int = 80, l2: float = 1e-4) -> Linear:
    """Multinomial logistic regression by full-batch gradient steps with momentum.

    Classes weigh the same; the rows marked ``heavy`` together weigh as much as the rest of their class.
    """
    n = len(labels)
    value = (1 / np.sqrt(np.maximum(np.bincount(at, minlength=n), 1)))[at]
    group = 2 * labels + (0 if heavy is None else heavy.astype(np.int64))
    share = np.bincount(group, minlength=2 * classes)
    parts = np.maximum(1, (share.reshape(-1, 2) > 0).sum(1))
    weight = 1 / (classes * parts[labels] * share[group]) if n else np.empty(0)
    w, speed, goal = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes)), np.eye(classes)[labels]
    for _ in range(steps if n else 0):
        z = np.stack([np.bincount(at, w[bucket, c] * value, n) for c in range(classes)], 1)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - goal) * weight[:, None]
        grad = np.stack([np.bincount(bucket, g[at, c] * value, BUCKETS) for c in range(classes)], 1) + l2 * w
        speed = 0.9 * speed - 20.0 * grad
        w = w + speed
    return Linear(w.astype(np.float32))


class ResidueModel:
    """Two linear classifiers and their thresholds."""

    def __init__(self, text: Linear, slot: Linear, margin: float = 0.0, slot_margin: float = 0.0):
        self.text, self.slot, self.margin, self.slot_margin = text, slot, margin, slot_margin

    def text_scores(self, segs: list[str], titles: list[str]) -> np.ndarray:
        out = [np.empty((0, 3))]
        for a in range(0, len(segs), 20_000):
            part = segs[a : a + 20_000]
            out.append(self.text.scores(*features(part, titles[a : a + 20_000]), len(part)))
        return np.concatenate(out)

    def classify(self, segs: list[str], titles: list[str]) -> np.ndarray:
        """The class of each segment; residue must be ahead of the others by the margin."""
        s = self.text_scores(segs, titles)
        return np.where(s[:, RESIDUE] - s[:, :RESIDUE].max(1) > self.margin, RESIDUE, s[:, :RESIDUE].argmax(1)) if len(s) else np.empty(0, np.int64)

    def slot_scores(self, found: list[tuple[str, str, str]]) -> np.ndarray:
        """By how much each candidate looks like a slot; equal ones are scored once."""
        one = list(dict.fromkeys(found))
        if not one:
            return np.empty(0)
        s = self.slot.scores(*slot_features(one), len(one))
        by = dict(zip(one, s[:, 1] - s[:, 0]))
        return np.array([by[f] for f in found])


def _sample(df: DataFrame, fields: list[str], title: str, source: str, url: str, sample: int) -> list[tuple]:
    """At most ``sample`` (value, title, source, host, even), and a third as many with a phrase: the only rows that reach the driver. ``even`` rows are chosen by a hash alone."""
    long = df.select(F.explode(F.array(*[F.col(f) for f in fields])).alias("v"), F.coalesce(F.col(title), F.lit("")).alias("t"), F.coalesce(F.col(source), F.lit("")).alias("s"), F.coalesce(F.regexp_extract(F.lower(F.col(url)), "^[a-z]+://([^/?#]+)", 1), F.lit("")).alias("h"))
    rows = [(*r, True) for r in bounded_sample(long, ["v", "t"], sample, F.length("v") > 0).toLocalIterator()]
    # Residue is rare: short values with a phrase in them make a sample of their own, again of bounded size.
    likely = F.length("v").between(1, 400) & F.col("v").rlike("(?im)" + PHRASES.pattern)
    more = bounded_sample(long, ["v", "t"], max(1, sample // 3), likely, wide=50)
    return list({r[:4]: r for r in [*((*r, False) for r in more.toLocalIterator()), *rows]}.values())


def _shared(rows: list[tuple]) -> set[str]:
    """Keys of segments that very many values have, counted in the even part of the sample alone."""
    often: Counter = Counter()
    even = [r for r in rows if r[4]]
    for v, _, src, _, _ in even:
        often.update({_key(s, src) for s in segments(v)})
    return {k for k, c in often.items() if c >= max(4, SHARED * len(even))}


def _training(rows: list[tuple], phrases: re.Pattern = PHRASES, status: bool = True) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """(segments, titles, labels, whether it is body with a phrase in it); body segments without a phrase up to BODY_KEPT."""
    shared, segs, titles, labels, near, plain = _shared(rows), [], [], [], [], 0
    for v, t, src, *_ in rows:
        cut = segments(v)
        for s, y in zip(cut, weak_labels(cut, t, src, shared, phrases)):
            report = y == BODY and bool(phrases.search(_plain(s)))
            if y == BODY and not report:
                plain += 1
                if plain > BODY_KEPT:
                    continue
            if y >= 0:
                segs.append(s)
                titles.append(t)
                labels.append(y)
                near.append(report)
    for more, y in ((STATUS_TEXTS, RESIDUE), (REPORT_TEXTS, BODY)) if status else ():
        segs, titles, labels, near = segs + more, titles + [""] * len(more), labels + [y] * len(more), near + [y == BODY] * len(more)
    return segs, titles, np.array(labels, np.int64), np.array(near, bool)


def _slot_training(rows: list[tuple]) -> tuple[list[tuple[str, str, str]], np.ndarray]:
    """Different candidates (numbers made equal) with their labels."""
    one: dict = {}
    for v, *_ in rows:
        for c in candidates(v):
            key = tuple(re.sub(r"\d+", "0", x) for x in c)
            if key not in one and (y := slot_label(*c)) >= 0:
                one[key] = (c, y)
    return [c for c, _ in one.values()], np.array([y for _, y in one.values()], np.int64)


def _fit(rows: list[tuple], phrases: re.Pattern = PHRASES, status: bool = True) -> ResidueModel:
    segs, titles, y, near = _training(rows, phrases, status)
    found, z = _slot_training(rows)
    found, z = found + SLOT_TEXTS + NO_SLOT_TEXTS, np.concatenate([z, np.ones(len(SLOT_TEXTS), np.int64), np.zeros(len(NO_SLOT_TEXTS), np.int64)])
    return ResidueModel(train(*features(segs, titles), y, 3, near) if segs else Linear(np.zeros((BUCKETS, 3), np.float32)), train(*slot_features(found), z, 2))


def _threshold(score: np.ndarray, right: np.ndarray) -> float:
    """The non-negative threshold of best agreement (F1) with ``right``; 0 if nothing is above 0."""
    found = np.sort(score[score > 0])
    best, at = -1.0, 0.0
    for t in np.concatenate([[0.0], found]):
        hit = int((right & (score > t)).sum())
        f = 2 * hit / max(1, int(right.sum()) + int((score > t).sum()))
        if f > best:
            best, at = f, float(t)
    return at


def _unseen(rows: list[tuple]) -> list[bool]:
    """Every fourth host, by its hash."""
    return [zlib.crc32(r[3].encode()) % 4 == 0 for r in rows]


def _values(rows: list[tuple], model: ResidueModel, phrases: re.Pattern = PHRASES) -> tuple[np.ndarray, np.ndarray]:
    """(margin of the clearest residue segment, weak label is residue) of the values that have a weak label."""
    shared, cut, y = _shared(rows), [], []
    for v, t, src, *_ in rows:
        s = segments(v)
        marks = weak_labels(s, t, src, shared, phrases)
        if RESIDUE in marks or BODY in marks:
            cut.append((s, t))
            y.append(RESIDUE in marks)
    s = model.text_scores([x for c, _ in cut for x in c], [t for c, t in cut for _ in c])
    ahead = s[:, RESIDUE] - s[:, :RESIDUE].max(1)
    ends = np.cumsum([len(c) for c, _ in cut])
    # A value's margin is that at which its residue stops outweighing its body; the clearest segment's is close to it and cheap.
    return np.array([ahead[e - len(c) : e].max() if _outweighs(c, s[e - len(c) : e]) else -1.0 for e, (c, _) in zip(ends, cut)]), np.array(y, bool)


def _outweighs(segs: list[str], scores: np.ndarray) -> bool:
    size, best = np.array([len(s) for s in segs]), scores.argmax(1)
    body = np.array([b == BODY and _sentence(s) for s, b in zip(segs, best)])
    return bool((best == RESIDUE).any() and size[best == RESIDUE].sum() >= size[body].sum())


def fit(df: DataFrame, fields: list[str], title: str = "title", source: str = "source", url: str = "url", sample: int = SAMPLE) -> ResidueModel:
    """Both classifiers, trained without every fourth host of the sample, with thresholds set on those hosts."""
    rows = _sample(df, fields, title, source, url, sample)
    out = _unseen(rows)
    return calibrated(_fit([r for r, o in zip(rows, out) if not o]), [r for r, o in zip(rows, out) if o])


def calibrated(model: ResidueModel, rows: list[tuple]) -> ResidueModel:
    if rows:
        model.margin = _threshold(*_values(rows, model))
        found, y = _slot_training(rows)
        model.slot_margin = _threshold(model.slot_scores(found), y == 1)
    return model


def _agreement(score: np.ndarray, y: np.ndarray, margin: float, name: str) -> dict[str, float]:
    hit = int(((score > margin) & y).sum())
    return {name: len(y), f"{name}_precision": hit / max(1, int((score > margin).sum())), f"{name}_recall": hit / max(1, int(y.sum()))}


def validate(df: DataFrame, fields: list[str], title: str = "title", source: str = "source", url: str = "url", sample: int = SAMPLE) -> dict[str, float]:
    """Agreement with the weak labels, of values and of slots, on hosts used neither for training nor for the thresholds."""
    rows = _sample(df, fields, title, source, url, sample)
    part = [zlib.crc32(r[3].encode()) % 4 for r in rows]
    model = calibrated(_fit([r for r, p in zip(rows, part) if p > 1]), [r for r, p in zip(rows, part) if p == 0])
    rest = [r for r, p in zip(rows, part) if p == 1]
    found, z = _slot_training(rest)
    return _agreement(*_values(rest, model), model.margin, "values") | _agreement(model.slot_scores(found), z == 1, model.slot_margin, "slots")


def validate_families(df: DataFrame, fields: list[str], title: str = "title", source: str = "source", url: str = "url", sample: int = SAMPLE) -> dict[str, float]:
    """For each family of phrases the share of its values that is found by a model trained without the family."""
    rows, got = _sample(df, fields, title, source, url, sample), {}
    for name, pattern in FAMILIES.items():
        others = re.compile("|".join(f"(?:{p})" for n, p in FAMILIES.items() if n != name))
        only = lambda v: re.search(pattern, _plain(v)) and not others.search(_plain(v))
        test = [r for r in rows if len(r[0]) < 400 and only(r[0])]
        model = _fit([r for r in rows if not re.search(pattern, _plain(r[0]))], others, name != "status")
        score, y = _values(test, model, re.compile(pattern))
        if y.sum():
            got[name] = float(((score > 0) & y).sum() / y.sum())
    return got


def find_values(values: list[str | None], titles: list[str], model: ResidueModel) -> np.ndarray:
    """Whether each value is a case."""
    cut = [segments(v) if v and not v.isspace() else [] for v in values]
    segs = [s for c in cut for s in c]
    owner = np.repeat(np.arange(len(values)), [len(c) for c in cut])
    kinds = model.classify(segs, [t for t, c in zip(titles, cut) for _ in c])
    size = np.array([len(s) for s in segs], np.float64)
    ends = np.array([_sentence(s) for s in segs], bool)
    residue = np.bincount(owner, size * (kinds == RESIDUE), len(values))
    body = np.bincount(owner, size * ((kinds == BODY) & ends), len(values))
    found = [(i, c) for i, v in enumerate(values) if v for c in candidates(v)]
    slots = np.zeros(len(values), bool)
    slots[[i for (i, _), s in zip(found, model.slot_scores([c for _, c in found])) if s > model.slot_margin]] = True
    return ((residue > 0) & (residue >= body)) | slots


def find(df: DataFrame, fields: list[str], key: str = "seq", title: str = "title", model: ResidueModel | None = None) -> DataFrame:
    """(key, field) of the values that are cases."""
    model = model or fit(df, fields, title)
    packed = pickle.dumps((model.text.weights, model.slot.weights, model.margin, model.slot_margin))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, slot, margin, slot_margin = pickle.loads(packed)
        m = ResidueModel(Linear(text), Linear(slot), margin, slot_margin)
        for b in batches:
            titles = [t or "" for t in b.column(1).to_pylist()]
            for i, f in enumerate(fields):
                hit = np.flatnonzero(find_values(b.column(i + 2).to_pylist(), titles, m))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(hit)), pa.array([f] * len(hit), pa.string())], names=["k", "field"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, title, *fields).mapInArrow(work, f"k {kind}, field string").withColumnRenamed("k", key)
