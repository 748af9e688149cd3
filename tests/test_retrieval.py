"""The retrieval queries over whole contents, against brute force on a small fixture."""

import math
import random
import re
from collections import Counter

import pytest

from weirstone.queries import corpus

TERMS = corpus._terms()


def sentences(text):
    return [s for s in (x.strip() for x in re.split(r"(?<=[.!?。！？；\n])", text)) if len(s) >= 4]


def chunks(text):
    out, cur, n = [], [], 0
    for s in sentences(text):
        if cur and n + len(s) > 320:
            out.append("\n".join(cur))
            cur = cur[-1:] if len(cur) > 1 else []
            n = sum(map(len, cur))
        cur.append(s)
        n += len(s)
    return [*out, "\n".join(cur)] if cur else [text] if text else []


def tokens(text):
    low = text.lower()
    return re.findall("[a-z0-9]+", low) + [g for r in re.findall("[一-鿿]+", low) for g in ([r] if len(r) == 1 else [r[i : i + 2] for i in range(len(r) - 1)])]


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    r = random.Random(3)
    words = ["总磷浓度偏高。", "水质总体稳定，无需处理；", "The sediment was sampled.", "Wetland area grew", "总磷下降，浓度为0.3毫克。", "附近湿地恢复良好！", "No change was seen here.", "短。"]
    make = lambda n: "".join(r.choice(words) + r.choice(["", "\n", f"第{r.randrange(99)}号断面。"]) for _ in range(n))
    rows = [(i, f"题目{i}", "总磷浓度 sediment", make(r.choice([3, 20, 120])), r.choice("ABC"), r.choice(["水利", "住建"])) for i in range(40)]
    rows += [(50, "t", "总磷浓度在摘要。", "", "A", "水利"), (51, "t", "sediment only here.", None, "B", "住建"), (52, "总磷", None, None, "A", "水利"), (53, "t", "", "", "A", "水利")]
    rows.append((54, "t", "", "无关内容在前。" * 200 + "末尾才有wetland与sediment，总磷浓度见表。", "A", "水利"))
    d = str(tmp_path_factory.mktemp("kb"))
    spark.createDataFrame(rows, "seq long, title string, summary string, content string, quality string, department string").write.parquet(f"{d}/kb.parquet")
    return d, {x[0]: x for x in rows}, {x[0] * 100000 + p: c for x in rows for p, c in enumerate(chunks(x[3] or x[2] or ""))}


def scores(index):
    tf = {i: Counter(tokens(t)) for i, t in index.items()}
    df, n, mean = Counter(t for c in tf.values() for t in c), len(index), sum(map(len, index.values())) / len(index)
    idf = lambda t: math.log((n - df[t] + 0.5) / (df[t] + 0.5)) + 1
    q = {t: (1 + math.log(k)) * idf(t) for t, k in Counter(TERMS).items() if df[t]}
    bm, cos = {}, {}
    for i, c in tf.items():
        hit = [t for t in dict.fromkeys(TERMS) if c[t]]
        if hit:
            bm[i] = sum(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * len(index[i]) / mean)) for t in hit)
            w = {t: (1 + math.log(k)) * idf(t) for t, k in c.items()}
            dot = sum(w[t] * q[t] for t in hit)
            if dot > 0:
                cos[i] = dot / math.sqrt(sum(x * x for x in w.values())) / math.sqrt(sum(x * x for x in q.values()))
    cut = lambda s: sorted(((round(v, 6), i) for i, v in s.items()), reverse=True)[:200]
    return cut(bm), cut(cos)


def fused(index):
    rrf = Counter()
    for ranking in scores(index):
        for k, (_, i) in enumerate(ranking):
            rrf[i] += 1 / (61 + k)
    return rrf


def test_whole_contents_are_ranked(spark, fixture):
    d, rows, index = fixture
    bm, cos = scores(index)
    assert max(len(t) for t in index.values()) > 300 and len(index) > 2 * len(rows)
    for name, want in (("bm25_chunks", bm), ("tfidf_chunks", cos)):
        got = {r.chunk_id: r.score for r in corpus.QUERIES[name](spark, d).collect()}
        assert got == pytest.approx({i: v for v, i in want}, abs=2e-6)
    kept = [(round(round(v, 8) * (1.6 if rows[i // 100000][5] == "水利" else 1), 6), i) for i, v in fused(index).items() if rows[i // 100000][4] in "AB"]
    assert [(r.score, r.chunk_id, r.seq) for r in corpus.rrf_chunks(spark, d).collect()] == [(v, i, i // 100000) for v, i in sorted(kept, reverse=True)[:12]]


def test_answers_come_from_contents(spark, fixture):
    d, rows, index = fixture
    hits = sorted(((round(round(v, 8), 6), i) for i, v in fused(index).items()), reverse=True)[:6]
    found = [(len(set(TERMS) & set(tokens(s))), len(s), i, -p, s) for _, i in hits for p, s in enumerate(sentences(index[i]))]
    best = {}
    for x in sorted((x for x in found if x[0]), reverse=True):
        best.setdefault(x[4][:20], x)
    got = corpus.ask_sentences(spark, d).orderBy("rank").collect()
    assert [(r.sentence, r.overlap) for r in got] == [(x[4], x[0]) for x in sorted(best.values(), reverse=True)[:5]]
    assert got and all(any(r.sentence in (x[3] or "") for x in rows.values()) for r in got)
