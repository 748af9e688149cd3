"""The training-data operators on small fixtures: brute force, exact round trips, held-out accuracy, odd inputs."""

import os
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weirstone.functions.text import line_key
from weirstone.llm import byte_bpe, encoding_repair, history_dedup, main_text, mixture, repeated_lines, residue, scan_repair, shared_spans

KB = "seq long, title string, source string, url string, content string, summary string, pdf string, key string, k string, n long, h long"
DIR = "/root/testdata/sf0.001"


def kb(spark, rows):
    """rows of (seq, title, source, url, content); the other columns clash with names used inside the operators."""
    return spark.createDataFrame([(*r, r[4], None, "x", "y", 7, 8) for r in rows], KB)


ODD = [(9001, None, None, None, None), (9002, "", "", "", ""), (9003, "长", "s", "http://a.example/x", "　\n \n"), (9004, "长文", "s", "http://a.example/y", "水质监测结果良好，数据齐全。" * 4000)]
SENTENCES = ["本次调查在上游布设监测断面{0}处，结果总体稳定。", "总磷年均值为{0}毫克/升，较上年下降。", "沿岸{0}户完成改造，退水去向可查。", "The survey logged {0} samples near the outlet.", "编号404的点位记录{0}条，数据有效。"]


def articles(n, seed=1):
    r = random.Random(seed)
    return [(i, f"第{i}期 水质监测月报", f"s{i % 3}", f"http://h{i % 5}.example/a{i}.html", "\n".join(r.choice(SENTENCES).format(r.randrange(10_000)) for _ in range(r.randint(3, 8)))) for i in range(n)]


# 4


def brute_lines(rows, least):
    count, out = Counter(), set()
    for seq, _, src, _, c in rows:
        count.update({(src or "", line_key(x)) for x in (c or "").split("\n") if len(line_key(x)) >= 10})
    for seq, _, src, _, c in rows:
        out |= {(seq, i + 1) for i, x in enumerate((c or "").split("\n")) if len(line_key(x)) >= 10 and count[src or "", line_key(x)] >= least}
    return out


def test_repeated_lines(spark):
    notice = ["版权所有，未经授权不得转载本站内容。", "Ｆｏｌｌｏｗ us on every channel", "follow  US on every channel"]
    rows = [(s, t, src, u, c + "\n" + notice[i % 3] + ("\n" + notice[0] if i % 2 else "")) for i, (s, t, src, u, c) in enumerate(articles(60))] + ODD
    rows.append((500, *rows[0][1:]))
    got = {(r.key, r.line_no) for r in repeated_lines.repeated_lines(kb(spark, rows)).collect()}
    assert got == brute_lines(rows, 5)
    stats = repeated_lines.line_statistics(repeated_lines.hashed_lines(kb(spark, rows), "seq", "source", "content", 10)).collect()
    assert stats and all(r.excess and r.n >= 5 for r in stats)
    clean = {r.key: r.content for r in repeated_lines.without_repeated_lines(kb(spark, rows)).collect()}
    assert clean[9001] is None and clean[9002] == "" and "版权所有" not in clean[1] and len(clean) == len(rows)
    gone = {}
    for k, line_no in got:
        gone.setdefault(k, set()).add(line_no)
    for seq, *_, c in rows:
        assert clean[seq] == (c if c is None else "\n".join(x for i, x in enumerate(c.split("\n")) if i + 1 not in gone.get(seq, ())))
    assert repeated_lines.repeated_lines(kb(spark, rows).limit(0)).count() == 0


# 8


def test_ids_equal_the_library_and_decode_exactly(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(byte_bpe.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = [None, "", " ", "a", "水文站网 监测\r\n\r\n  x", "<|endoftext|> is text", "🙂👩‍🔬 مرحبا 𐍈", "don't  stop   now", "0" * 3000, "水" * 3000, "ab" * 5000]
    r = random.Random(3)
    texts += ["".join(r.choice("abc dé水文0 \n.") for _ in range(r.randrange(200))) for _ in range(60)]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, k int")
    got = {x.doc_id: x.ids for x in byte_bpe.encode(df).collect()}
    assert got[0] == got[1] == []
    for i, x in enumerate(texts):
        if x:
            assert got[i] == t.encode(x, add_special_tokens=False).ids
    back = {x.doc_id: x.text for x in byte_bpe.decode(byte_bpe.encode(df)).collect()}
    assert all(back[i] == (x or "") for i, x in enumerate(texts))
    assert {x.doc_id: x.n_tokens for x in byte_bpe.token_counts(df).collect()} == {i: len(v) for i, v in got.items()}
    assert byte_bpe.encode(df.limit(0)).count() == 0


# 9


def test_mixture(spark):
    r = random.Random(5)
    docs = [(i, ["a", "a", "a", "b", "c", None][i % 6], None if i % 50 == 0 else "水质 report " * r.randint(1, 40)) for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    goals = spark.createDataFrame([("m", "a", 0.5, 2, 0.5), ("m", "b", 0.3, 3, 0.5), ("m", "c", 0.2, 1, 0.5), ("short", "c", 1.0, 2, 2.0), ("none", "z", 1.0, 3, 0.1)], "mix_id string, source string, target_share double, max_repeats int, total_ratio double")
    chosen, shares = mixture.select_mixture(df, goals)
    s = {(x.mix_id, x.source): x for x in shares.collect()}
    for k in (("m", "a"), ("m", "b")):
        assert abs(s[k].tokens - s[k].target_tokens) <= 130 and not s[k].short
    assert s["short", "c"].short and s["short", "c"].most_copies == 2 and s["none", "z"].tokens == 0
    rows = chosen.collect()
    assert len({(x.mix_id, x.doc_id) for x in rows}) == len(rows)
    assert all(x.copies <= {"m": {"a": 2, "b": 3, "c": 1}}.get(x.mix_id, {}).get(x.source, 2) for x in rows)
    again, _ = mixture.select_mixture(df, goals)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    assert mixture.select_mixture(df.limit(0), goals)[0].count() == 0


# 10


def brute_spans(docs, span):
    owners = {}
    for i, t in docs:
        for p in range(len(t or "") - span + 1):
            owners.setdefault(t[p : p + span], set()).add(i)
    out = set()
    for i, t in docs:
        start = None
        for p in range(len(t or "") - span + 1):
            if len(owners[t[p : p + span]]) > 1:
                if start is None:
                    start = p
                elif p > last + span:
                    out.add((i, start, last + span))
                    start = p
                last = p
        if start is not None:
            out.add((i, start, last + span))
    return out


@pytest.mark.parametrize("rare", [1, 12])
def test_shared_spans(spark, rare):
    r = random.Random(7)
    make = lambda n: "".join(r.choice("水文站监测数据abc 🙂é") for _ in range(n))
    quotes, docs = [make(n) for n in (30, 39, 40, 41, 90, 200)], [(0, None), (1, ""), (2, "短"), (3, "哈" * 500), (4, "哈" * 300), (5, "ab" * 60)]
    for i in range(10, 90):
        docs.append((i, "".join(x for _ in range(r.randint(1, 4)) for x in (make(r.randint(0, 120)), r.choice(quotes)))))
    docs += [(100, docs[20][1]), (101, docs[20][1]), (102, docs[21][1][:60])]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, id long, pos int")
    got = {tuple(x) for x in shared_spans.shared_spans(df, span=40, rare=rare).collect()}
    assert got == brute_spans(docs, 40)
    assert shared_spans.shared_spans(df.limit(0), span=40).count() == 0


@pytest.mark.parametrize("rare", [1, 12])
def test_passages_link_every_text_of_a_frequent_passage(spark, rare):
    r = random.Random(11)
    make = lambda n: "".join(r.choice("水文站监测数据abc 🙂é") for _ in range(n))
    quote, other = make(90), make(60)
    docs = [(i, make(50) + quote + make(r.randint(0, 80)) + (other + make(9) if i % 3 else "") + (quote if i % 7 == 0 else "")) for i in range(20, 45)]
    docs += [(0, None), (1, ""), (2, "哈" * 500), (3, "哈" * 300), (4, make(70) + (make(5) + docs[0][1][60:110]) * 20), (5, docs[0][1]), (6, make(300))]
    text = dict(docs)
    rows = shared_spans.fuzzy_passages(spark.createDataFrame(docs, "doc_id long, text string"), span=40, rare=rare).collect()
    assert len(rows) == len({tuple(x) for x in rows}) and not any(6 in (x.a, x.b) for x in rows)
    members = {}
    for x in rows:
        assert 0 <= x.a_start < x.a_end <= len(text[x.a]) and 0 <= x.b_start < x.b_end <= len(text[x.b]) and x.a <= x.b
        assert text[x.a][x.a_start : x.a_start + 8] == text[x.b][x.b_start : x.b_start + 8] and 0.5 < x.identity <= 1
        if x.passage is None:
            assert x.a < x.b
        else:
            members.setdefault(x.passage, {(x.a, x.a_start, x.a_end)}).add((x.b, x.a_start, x.a_end))
    linked = {(x.a, x.b) for x in rows if x.a < x.b}
    for m in members.values():
        linked |= {(i, j) for i, s, e in m for j, u, v in m if i < j and max(s, u) < min(e, v)}
    windows = {i: {t[p : p + 40] for p in range(len(t) - 39)} for i, t in docs if t and i != 20}  # 5 is the first copy of 20
    assert {(i, j) for i in windows for j in windows if i < j and windows[i] & windows[j]} <= linked
    assert shared_spans.fuzzy_passages(spark.createDataFrame(docs[:0], "doc_id long, text string"), span=40).count() == 0


def test_chains_are_collinear_and_whole():
    r = random.Random(2)
    for _ in range(30):
        n = r.randint(1, 25)
        a, b = [r.randrange(500) for _ in range(n)], [r.randrange(500) for _ in range(n)]
        got = shared_spans.chain(a, b, 20)
        assert sorted(i for c in got for i in c) == list(range(n))
        for c in got:
            assert all(a[x] < a[y] and b[x] < b[y] for x, y in zip(c, c[1:]))
    assert shared_spans.chain([0, 20, 40, 400], [5, 25, 45, 10], 20)[0] == [0, 1, 2]


def test_alignment():
    r = random.Random(4)
    for _ in range(400):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(2))
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            e = [i + 1]
            for j, y in enumerate(b):
                e.append(min(d[j] + (x != y), d[j + 1] + 1, e[j] + 1))
            d = e
        assert shared_spans.edits(a, b) == d[-1]
    x = "".join(r.choice("水文站监测数据abc") for _ in range(300))
    y = x[:40] + "#" + x[41:90] + x[91:200] + "##" + x[200:260] + "&" * 40
    # Seeds of 20 at 100 and 150 of x; y lacks one code point before them.
    s, e, u, v, n = shared_spans.align("...." + x, y, [104, 154], [99, 149], 20)
    assert (s, u) == (4, 0) and n == 2 and (e, v) == (204, 199)


# 5


def test_encoding_round_trips(spark):
    rows = articles(300) + [(700 + i, "Café survey", "s1", "http://h1.example/c", "Université de Genève reported 12 µg/L at ±3 °C.") for i in range(5)]
    good = "总磷年均值为0.25毫克/升，较上年下降。沿岸321户完成改造，退水去向可查。"
    wrong = {1001: good.encode().decode("latin-1"), 1002: good.encode("gb18030").decode("latin-1"), 1003: good.encode().decode("gb18030", "replace"), 1004: good.encode("gb18030").decode("utf-8", "replace"), 1005: "A 12 Â°C rise", 1006: "数据��缺失，烫烫。"}
    df = kb(spark, rows + [(s, "题", "s1", "http://h1.example/w", c) for s, c in wrong.items()] + ODD).drop("key")
    got = {r.seq: r for r in encoding_repair.repair(df, ["content"]).collect()}
    assert set(got) == set(wrong)
    assert got[1001].restored == good and got[1002].restored == good and got[1005].restored == "A 12 °C rise"
    assert got[1004].damaged and got[1006].damaged
    assert encoding_repair.repair(df.limit(0), ["content", "title"]).count() == 0


def test_dictionaries_come_from_all_values(spark):
    # The phrase stands only in values with a great hash, which the 6,000 of the smallest hashes never held.
    r = random.Random(6)
    words = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(n))
    phrase = "weir crest gauged at the lower sluice"
    some = spark.createDataFrame([(f"{words(4)} {phrase} {words(4)}",) for _ in range(1_200)], "content string").where(F.xxhash64("content") > 1 << 62)
    texts = [words(8) for _ in range(13_000)] + [x.content for x in some.collect()] + [None, "", "\n", "短"]
    df = spark.createDataFrame([(x,) for x in texts], "content string")
    model = encoding_repair.fit(df, ["content"])
    assert phrase.encode() in model.dictionaries[0]
    counts, each, lines = encoding_repair.count_stretches(df, "")[encoding_repair._LANGUAGES.index("latin")]
    whole = [x.encode() for x in texts if x and len(x) >= 8]
    assert lines == len(whole) and each.sum() == sum(map(len, whole)) and each[ord("a")] == sum(x.count(b"a") for x in whole)
    at = encoding_repair.stretches([phrase.encode()])[1][: len(phrase) - 7]
    exact = [sum(phrase[i : i + 8].encode() in x for x in whole) for i in range(len(at))]
    assert min(exact) > 200 and all(exact[i] <= counts[c] < exact[i] + 20 for i, c in enumerate(at))  # cells are shared by chance
    # The same from other parts, in another order.
    again = encoding_repair.fit(df.orderBy(F.xxhash64("content")).repartition(7), ["content"])
    assert (again.common, again.dictionaries) == (model.common, model.dictionaries)
    assert encoding_repair.fit(df.limit(0), ["content"]).dictionaries == [b"\n" * 8]


def test_cover():
    lines = [b"the lower sluice was opened", b"the upper sluice was closed", b"0123456789"]
    counts = encoding_repair.stretches(lines)[1]
    counts = np.bincount(counts[counts >= 0], minlength=encoding_repair.CELLS)
    got = encoding_repair.cover(lines, counts, 1000)
    assert all(x[:8] in got and x[-8:] in got for x in lines) and len(got) <= sum(map(len, lines))
    assert len(encoding_repair.cover(lines, counts, 20)) == 20 and encoding_repair.cover([], counts, 20) == b""


def _calls(f) -> int:
    """Calls of Python functions and methods that f makes."""
    n = 0

    def count(_, event, __):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        f()
    finally:
        sys.setprofile(None)
    return n


def test_clean_lines(monkeypatch):
    r = random.Random(9)
    common = "·，的水文"
    alphabet = "abc  xyz09" * 3 + "的水文，" * 6 + "站监測かナ가힣жяΩπ\u0600א\u0e01अé" + "Ã\u0085�𝒳\r"
    line = lambda: "".join(r.choice(alphabet[: r.choice((30, 54, 60, len(alphabet)))]) for _ in range(r.randrange(30)))
    values = ["\n".join(line() for _ in range(r.randrange(9))) for _ in range(3_000)] + [None, "", "\n", "a" * 7, "a" * 8, "的" * 8 + "\n\n", "é" * 9, "的水" + "a" * 8, "的水文" + "a" * 11, *(f"{c}a" * 5 for c in "監かナ가жπ\u0600א\u0e01अÄ")]
    # One line after the other.
    odd = re.compile(f"[^\x00-\x7f{common}]{{2}}|[�\u0080-\u009fÂÃâ]")
    scripts = {k: re.compile(f"[{v}]") for k, v in encoding_repair._SCRIPTS.items()}
    want = defaultdict(list)
    for x in "\n".join(v or "" for v in values).split("\n"):
        if len(x) >= 8 and not odd.search(x):
            counts = {k: len(p.findall(x)) for k, p in scripts.items()}
            best = max(counts, key=counts.get)
            want[encoding_repair._LANGUAGES.index(best if counts[best] * 5 > len(x) else "latin")].append(x.encode())
    assert len(want) == len(encoding_repair._LANGUAGES) and sum(map(len, want.values())) > 1_000
    batch = pa.RecordBatch.from_arrays([pa.array(values[:2_000]), pa.array(values[2_000:] + [None] * (4_000 - len(values)))], names=["content", "title"])

    def got(least):
        out = defaultdict(list)
        for g, raw in encoding_repair.clean_lines(iter([batch]), common, least):
            out[g] += raw.tobytes().split(b"\n")[:-1]
        return {g: sorted(x) for g, x in out.items()}

    for piece in (1, 100, 1 << 16):
        monkeypatch.setattr(encoding_repair, "PIECE", piece)
        assert got(1 << 20) == got(64) == {g: sorted(x) for g, x in want.items()}
    # Far fewer calls than lines: all lines of a piece are looked at together.
    many = pa.RecordBatch.from_arrays([pa.array(["\n".join(["the gauge at the weir, 水文站"] * 20)] * 500)], names=["content"])
    assert _calls(lambda: list(encoding_repair.clean_lines(iter([many]), common))) < 5_000


def test_repeated_lines_are_repaired_once(monkeypatch):
    good = "总磷年均值为0.25毫克/升，较上年下降。沿岸321户完成改造，退水去向可查。"
    model = lambda: encoding_repair.Model(encoding_repair.ordinary(good), [good.encode() * 20])
    texts = [f"{i % 7} " + good.encode().decode("latin-1") + "\nCafé ÄÖ survey\n" + good for i in range(300)]
    m, calls = model(), []
    once = m.repair_line
    monkeypatch.setattr(m, "repair_line", lambda x: calls.append(x) or once(x))
    got = [m.repair(x) for x in texts]
    assert len(calls) == len(set(calls)) == 8 and got[0][0] == "0 " + good + "\nCafé ÄÖ survey\n" + good
    # The same where nothing is remembered for long.
    monkeypatch.setattr(encoding_repair, "KEPT_LINES", 150)
    monkeypatch.setattr(encoding_repair, "KEPT_STRETCH", 0)
    assert [model().repair(x) for x in texts] == got


# 6


def test_scan_repair():
    clean = [(t, c) for _, t, _, _, c in articles(400)]
    m = scan_repair.train(clean)
    lines = ["沿岸32l户完成改造，退水去向可查。总磷年均", "值为0.25毫克/升，较上年下降。", "- 12 -", "水质资料选辑  13", "The survey logged 12 sam-", "ples near the outlet."]
    kinds, found, text = scan_repair.find_noise(lines, "第3期 水质监测月报", m)
    assert (2, "page_no") in found and (4, "split_word") in found and (0, "misread") in found and (3, "header") in found
    assert "总磷年均值为0.25" in text and "samples near" in text and "321户" in text
    for extreme in ([], [""], ["水" * 60_000]):
        scan_repair.find_noise(extreme, "", m)
    # Held out: characters put wrong by rule are found, clean lines stay.
    r = random.Random(9)
    hit = total = false = 0
    for _, _, _, _, c in articles(60, seed=77):
        for line in c.split("\n"):
            false += m.fix_line(line)[1] > 0
            at = [i for i, ch in enumerate(line) if ch in "0158" and 0 < i < len(line) - 1 and line[i - 1].isdigit()]
            if at:
                i = r.choice(at)
                total += 1
                hit += m.fix_line(line[:i] + {"0": "O", "1": "l", "5": "S", "8": "B"}[line[i]] + line[i + 1 :])[0] == line
    assert hit / total > 0.95 and false == 0


def test_scan_noise_frame(spark):
    m = scan_repair.train([(t, c) for _, t, _, _, c in articles(60)])
    df = kb(spark, ODD).drop("key")
    got = {r.seq: r for r in scan_repair.scan_noise(df, m).collect()}
    assert got[9001].text is None and got[9002].lines == [] and len(got) == 4
    assert scan_repair.scan_noise(df.limit(0), m).count() == 0
    assert scan_repair.fit(df.limit(0), "title", "content") is not None


# 1


def test_residue(spark):
    rows = articles(400)
    bad = ["抱歉，您要找的页面不存在，请返回首页。", "{{ page.title }}", "Please enable JavaScript to view this page.", "Lorem ipsum dolor sit amet.", rows[5][4] + "\n联系人：[联系电话]"]
    cases = [(2000 + i, "题目", "s1", f"http://h{i}.example/r{i}", bad[i % 5]) for i in range(50)]
    df = kb(spark, rows + cases + ODD).drop("key")
    got = {r.seq for r in residue.find(df, ["content"]).collect()}
    assert got == {c[0] for c in cases}
    v = residue.validate(df, ["content"])
    assert v["values_recall"] > 0.8 and v["values_precision"] > 0.8
    assert residue.find(df.limit(0), ["content", "summary"]).count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_residue_beyond_the_lists_and_reports_of_it():
    # Texts no phrase of which is listed, and slots of unlisted forms, beside sentences about pages and forms.
    bad = ["502 Bad Gateway nginx", "Page missing", "503 Service Unavailable", "504 Gateway Timeout", "该页面已不存在", "内容加载失败，请刷新重试", "The level was {LEVEL_M} m at noon on Monday.", "总磷年均值为@@VALUE@@毫克/升，较上年下降。", "Samples came from <add site> in May, as planned."]
    good = ["The portal was offline for two hours on Monday, and 32 users reported HTTP 500 errors.", "Operators could log in again after the credentials of 14 stations were renewed.", "运行日志显示，平台登录页面在汛期共收到214次访问，其中3次超时。", "系统升级维护于3月5日完成，数据传输恢复正常。", "Loads of total nitrogen fell by 12 percent after the upgrade. In the formula {k} is the decay rate of the wetland (see Part 3).", "文件（环发〔2020〕12号）印发后，【总则】部分未作修改。"]
    import pyarrow.parquet as pq

    rows = pq.read_table(DIR.replace("0.001", "0.1") + "/kb.parquet", columns=["title", "source", "content", "summary"]).slice(0, 4000).to_pylist()
    rows = [(v, x["title"] or "", x["source"] or "", x["source"] or "", True) for x in rows for v in (x["content"], x["summary"]) if v]
    out = residue._unseen(rows)
    m = residue.calibrated(residue._fit([r for r, o in zip(rows, out) if not o]), [r for r, o in zip(rows, out) if o])
    assert list(residue.find_values(bad, [""] * len(bad), m)) == [True] * len(bad)
    assert list(residue.find_values(good, [""] * len(good), m)) == [False] * len(good)


# 2


def test_main_text(spark):
    frame = ["首页 | 新闻 | 服务 | 专题", "版权所有 某站", "分享到：微信好友 | 微博"]
    rows = [(s, t, src, u, "\n".join([frame[0], t, "背景情况", *c.split("\n"), "", frame[2], frame[1], "相关阅读", "· 另一条足够长的标题（2024年第1期）"])) for s, t, src, u, c in articles(80)] + ODD
    df = kb(spark, rows).drop("key")
    got = {r.seq: r for r in main_text.main_text(df).collect()}
    for s, t, _, _, c in articles(80):
        n = len(c.split("\n"))
        assert got[s].frame == [1, n + 5, n + 6, n + 7, n + 8], got[s]
        assert got[s].body == "\n".join([t, "背景情况", *c.split("\n"), ""])
    assert got[9001].body is None and got[9002].frame == [] and got[9003].frame == []
    assert main_text.main_text(df.limit(0)).count() == 0


def test_sections_decide():
    body = "\n".join(f"本次调查在上游布设监测断面{i}处，结果总体稳定，数据齐全，均已复核。" for i in range(6))
    weak = "平台长期征集照片。"
    page = "\n".join([weak, "首页 | 新闻 | 服务 | 专题", "政务 | 公开 | 互动 | 下载", "监测月报", body, "首页 | 新闻 | 服务 | 专题", "政务 | 公开 | 互动 | 下载", weak])
    gone = main_text.frame_lines(page, "监测月报", None, None, {})
    assert gone == [0, 1, 2, 10, 11, 12]
    # The same sentence in the section of the body is body.
    inside = "\n".join(["监测月报", body, weak])
    assert main_text.frame_lines(inside, "监测月报", None, None, {}) == []


# 3

PAIRS = [
    (1, "http://a.example/x?id=1", "关于加强青岚江底泥清淤的通知（青环发〔2020〕12号）"), (2, "http://a.example/x?id=2", "关于加强青岚江底泥清淤的通知（青环发〔2021〕12号）"), (3, "https://doi.example/10.1000/ab.c", "Sediment Release in Lanwei Lake, Part 2"), (4, None, None), (5, "", ""),
    (10, "https://WWW.a.example:443/x/?utm_source=q&id=1#top", "另一个全新的标题"), (11, None, "【转载】关于加强青岚江底泥清淤的通知"), (12, "doi:10.1000%2FAB.c", "x"), (13, "http://b.example/1", "Sediment Relase in Lanwei Lake， Part 2"),
    (14, "http://b.example/2", "Sediment Release in Lanwei Lake, Part 3"), (15, "http://b.example/3", "Sediment Release in Lanwen Lake, Part 2"), (16, None, None), (17, "http://b.example/2#x", "unrelated words"), (18, "http://b.example/9", "关于加强青岚江底泥淤清的通知（青环发〔2021〕12号）"), (19, "http://b.example/", "首页甲乙丙丁"), (20, "http://b.example", "首页戊己庚辛"),
]
WANT = {(1, 10), (1, 11), (3, 12), (3, 13), (14, 17), (2, 18)}


def test_history(spark):
    rows = spark.createDataFrame([(*p, 1, "z") for p in PAIRS], "seq long, url string, title string, bucket int, kind string")
    sites = spark.createDataFrame([("某站",)], "name string")
    old, new = rows.where("seq < 10"), rows.where("seq >= 10")
    assert {tuple(r) for r in history_dedup.against_history(old, new, sites).collect()} == WANT
    # Batch by batch, with the index growing, the outcome is the same.
    assert {tuple(r) for r in history_dedup.batch_by_batch(old, new.withColumn("batch_id", (F.col("seq") / 8).cast("int")), sites).collect()} == WANT
    assert history_dedup.against_history(old, new.limit(0), sites).count() == 0


def test_a_batch_reads_its_buckets_only(spark):
    from weirstone.sources.tables import scratch

    make = lambda a, n: spark.createDataFrame([(i, f"http://a.example/p/{i}", f"关于第{i}号青岚江清淤的通知") for i in range(a, a + n)], "seq long, url string, title string")
    index = history_dedup.History(spark, scratch(spark, "pruned"), full=40)
    index.accept(make(0, 600))
    before = index._state()
    index.accept(make(1000, 1200))
    after = index._state()
    assert after[1] > before[1] and after[0] == before[0] + 1  # buckets have been doubled
    wanted = spark.createDataFrame([(5,), (9,)], "h long")
    old = index._read("keys", wanted, "h")
    plan = old._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN \(5,9\)", plan)
    files = spark.read.parquet(f"{index.path}/keys-{after[0]}")
    assert files.where("bucket in (5, 9)").count() < files.count() * 4 / after[1] + 60
    got = {tuple(r) for r in index.probe(make(5, 3).selectExpr("seq + 10000 as seq", "url", "title")).collect()}
    assert got == {(5, 10005), (6, 10006), (7, 10007)}


def test_hot_band_keys_lose_no_slip(spark):
    r = random.Random(8)
    words = ["".join(r.choice("水文站监测数据清淤通知方案河湖") for _ in range(r.randint(8, 12))) for _ in range(60)]
    slips = [w[: len(w) // 2] + "错" + w[len(w) // 2 + 1 :] for w in words] + [w[1:] for w in words] + [w + "甲乙" for w in words]
    titles = dict(enumerate(dict.fromkeys(words + slips)))
    base = spark.createDataFrame(list(titles.items()), "t long, base string")
    both = base.select(F.lit("0").alias("kind"), F.lit(1).cast("long").alias("h"), F.col("t").alias("seq"), "t", F.lit(True).alias("bare"))
    got = {tuple(x) for x in history_dedup._candidates(both, base, hot=10).collect()}
    want = {(a, b) for a in titles for b in titles if a < b and history_dedup.same_but_for_a_slip(titles[a], titles[b])}
    assert want <= got and len(got) < len(titles) ** 2 / 4


def test_slips():
    same = history_dedup.same_but_for_a_slip
    assert same("abcdef", "abdef") and same("abcdef", "abxxef") and same("abcdef", "abdcef") and same("运行维护", "运护")
    assert not same("abc1", "abc2") and not same("abcdef", "xbcdey") and not same("abcdef", "abcdefghi")


# Registered queries


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_registered_queries_run(spark):
    from weirstone.llm import queries

    for name, f in queries.queries().items():
        df = f(spark, DIR)
        assert df.count() >= 0, name
    cols = {"p1_found": ["seq", "field"], "p2_found": ["seq", "line_no"], "p3_found": ["seq_1", "seq_2"], "p4_found": ["seq", "line_no"], "p5_found": ["seq", "field"], "p6_found": ["seq", "line_no", "kind"], "p10_found": ["doc_id", "span_start", "span_end"], "p8_ids": ["doc_id", "ids"]}
    for name, want in cols.items():
        assert queries.queries()[name](spark, DIR).columns == want
