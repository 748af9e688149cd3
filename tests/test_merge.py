import random

from weirstone.operators.merge import merge


def sequential(kb, inbox):
    """The rule, row by row."""
    urls = {u for _, u, _, _, _ in kb if u and "?" not in u}
    rank = {"A": 3, "B": 2}
    holder = {}
    for s, _, t, q, ev in kb:
        holder.setdefault(ev, [s, rank.get(q, 1)])
    out, order = {}, {}
    for s, u, t, q, ev in inbox:
        plain = u if u and "?" not in u else None
        if plain in urls and plain:
            out[s] = "skipped"
        elif ev in holder:
            if rank.get(q, 1) > holder[ev][1]:
                prev = order.get(ev)
                if prev is not None:
                    out[prev] = "skipped" if out[prev] == "replaced" else "appended_then_replaced"
                holder[ev][1] = rank.get(q, 1)
                out[s], order[ev] = "replaced", s
            else:
                out[s] = "skipped"
        else:
            holder[ev] = [s, rank.get(q, 1)]
            out[s], order[ev] = "appended", s
            if plain:
                urls.add(plain)
    return out


def test_same_as_the_sequential_rule(spark):
    from weirstone.functions.fields import event_key
    from pyspark.sql import functions as F

    for seed in range(3):
        r = random.Random(seed)
        title = lambda: f"title {'abcdef'[r.randrange(6)]}"
        url = lambda: r.choice([None, "", "http://x/1", "http://x/2", "http://x/3", "http://x/4?id=1"])
        kb = [(i, url(), title(), r.choice("ABC"), None) for i in range(3)]
        inbox = [(100 + i, url(), title(), r.choice(["A", "B", "C", None]), None) for i in range(14)]
        k = spark.createDataFrame(kb, "seq long, url string, title string, quality string, _ev string")
        b = spark.createDataFrame(inbox, "seq long, url string, title string, quality string, _ev string")
        evs = {x.seq: x.e for x in k.unionByName(b).select("seq", event_key(F.col("title")).alias("e")).collect()}
        want = sequential([(*x[:4], evs[x[0]]) for x in kb], [(*x[:4], evs[x[0]]) for x in inbox])
        got = {x.seq: x.action for x in merge(k, b).collect()}
        assert got == want


def test_empty(spark):
    k = spark.createDataFrame([], "seq long, url string, title string, quality string, _ev string")
    assert merge(k, k).count() == 0
