"""Problem 10: long exact spans shared between records.

1. Exact copies are folded to the smallest id by a hash of the text.
2. Seeds: of every ``span`` code points the k-mers that are a window minimum (k = span / 2), so any two
   texts with a common stretch of ``span`` have at least one seed in common inside it. About one
   position in 25 is a seed.
3. Seeds found in more than one text are joined. Those with at most RARE occurrences give ordered matches per
   pair of texts; matches are chained collinearly with gap costs, the best predecessor found in a
   Fenwick tree over the other text's positions. Every match ends in exactly one chain (maybe of one).
   Frequent seeds (a passage quoted everywhere would make all pairs of its texts) aren't paired: the
   stretch around each such seed goes straight to the hashing of step 4, for any number of texts.
4. The two slices of each chain, widened by ``span``, are held against each other: every window of ``span``
   code points in both covers its positions. Around frequent seeds every window is hashed (128 bits), and
   windows in at least two texts cover theirs. Runs of covered positions come out.

5. ``fuzzy_passages`` aligns the chains: the stretches between neighbouring seeds by edit distance, both ends
   carried on over single edits, so that altered passages come out whole with the identity of their alignment.

Nothing is compared pairwise except through rare seeds, and no group of unbounded size is collected.

Defined results: null, empty and shorter texts share nothing; exact copies of at least ``span`` code
points are covered wholly; repetition inside one text alone doesn't count; ids are taken as unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirstone.llm.spread import spread
from weirstone.sources.tables import cut

SPAN = 100
#: A seed with more occurrences than this isn't paired; its surroundings go to the exact step directly.
RARE = 12
#: An alignment goes on over an edit if so many code points match behind it, and so many spans beyond the outer seeds.
RESUME, BEYOND = 8, 4
#: A written table of at most so many rows (a few MB) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 150_000
#: Code points of text hashed at once in Python.
BLOCK = 400_000
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 (base is odd), grown as needed."""
    size = 1 << max(10, (n - 1).bit_length())
    if (key := (int(base), size)) not in _POWERS:
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        make = lambda b: np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64)])
        _POWERS[key] = make(base), make(inverse)
    up, down = _POWERS[key]
    return up[:n], down[:n]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _window_hashes(points: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """A hash of each of the len - k + 1 windows, from prefix sums of c_i * base^i."""
    n = len(points)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = _powers(base, n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(points.astype(np.uint64) + base) * up, dtype=np.uint64)])
    return _mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (minimum or maximum) over each window of w, by doubling."""
    size, out = 1, x
    while size * 2 <= w:
        out = f(out[:-size], out[size:])
        size *= 2
    return f(out[: len(x) - w + 1], out[w - size : w - size + len(x) - w + 1]) if w > size else out[: len(x) - w + 1]


def _blocks(keys: list, texts: list[str]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Texts in blocks of about BLOCK code points."""
    ks: list = []
    ts: list = []
    size = 0
    for k, t in zip(keys, texts):
        p = _points(t)
        if ts and size + len(p) > BLOCK:
            yield ks, ts
            ks, ts, size = [], [], 0
        ks.append(k)
        ts.append(p)
        size += len(p)
    if ts:
        yield ks, ts


def _seeds(points: list[np.ndarray], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of text, position, hash) of the k-mers that are the minimum of some window inside their text."""
    k = span // 2
    w = span - k + 1
    whole = np.concatenate(points)
    if len(whole) < span:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    starts = np.cumsum([0, *map(len, points)])
    h = _window_hashes(whole, k, _B1) >> np.uint64(1)
    owner = np.repeat(np.arange(len(points)), [len(p) for p in points])
    least = _sliding(h, w, np.minimum)
    least[owner[: len(least)] != owner[span - 1 : span - 1 + len(least)]] = 0  # windows over a border count for nothing
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    chosen = np.flatnonzero((_sliding(padded, w, np.maximum) == h) & (h > 0))
    return owner[chosen], chosen - starts[owner[chosen]], h[chosen]


def _long_texts(df: DataFrame, key: str, text: str, span: int) -> DataFrame:
    return df.where(F.length(text) >= span).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.col(text), F.lit(3)).alias("t2"), F.length(text).alias("n"))


def seeds(texts: DataFrame, span: int = SPAN) -> DataFrame:
    """texts(id, text) -> (id, pos, h)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, points in _blocks(b.column(0).to_pylist(), b.column(1).to_pylist()):
                owner, pos, h = _seeds(points, span)
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(ids, np.int64)[owner]), pa.array(pos.astype(np.int32)), pa.array(h.astype(np.int64))], names=["id", "pos", "h"])

    return texts.select("id", "text").mapInArrow(work, "id bigint, pos int, h bigint")


def chain(a: list[int], b: list[int], k: int, gap: float = 0.1) -> list[list[int]]:
    """Chains (lists of indexes) of the matches (a[i], b[i]), each in one chain.

    A match adds up to k code points; joining two costs ``gap`` per code point of difference between
    their distances in the two texts and a tenth of that per code point skipped. The best predecessor
    to the left in both texts is the prefix maximum, in a Fenwick tree over b, of score plus the
    position terms of the cost.
    """
    n = len(a)
    if n == 1:
        return [[0]]
    order = sorted(range(n), key=lambda i: (a[i], b[i]))
    rank = {v: i + 1 for i, v in enumerate(sorted(set(b)))}
    size, skip = len(rank), gap / 10
    # Two trees: the predecessor's diagonal below or above; |d_j - d_i| is the larger of both signs, so the true cost is checked for the two bests.
    trees = [[(-1e18, -1)] * (size + 1) for _ in range(2)]
    score, parent = [0.0] * n, [-1] * n
    waiting: list[int] = []
    at = None
    for j in order:
        if a[j] != at:  # predecessors must lie strictly to the left
            for i in waiting:
                for s, tree in zip((1, -1), trees):
                    v, r = (score[i] + skip * (a[i] + b[i]) + s * gap * (b[i] - a[i]), i), rank[b[i]]
                    while r <= size:
                        if v > tree[r]:
                            tree[r] = v
                        r += r & -r
            waiting, at = [], a[j]
        score[j] = float(k)
        for tree in trees:
            best, r = (-1e18, -1), rank[b[j]] - 1
            while r > 0:
                if tree[r] > best:
                    best = tree[r]
                r -= r & -r
            if (i := best[1]) >= 0:
                da, db = a[j] - a[i], b[j] - b[i]
                s = score[i] + min(k, da, db) - gap * abs(da - db) - skip * max(0, min(da, db) - k)
                if s > score[j]:
                    score[j], parent[j] = s, i
        waiting.append(j)
    used, out = [False] * n, []
    for j in sorted(range(n), key=lambda i: -score[i]):
        path = []
        while j >= 0 and not used[j]:
            used[j] = True
            path.append(j)
            j = parent[j]
        if path:
            out.append(path[::-1])
    return out


def _shared(s: DataFrame) -> DataFrame:
    """The seeds found in more than one text, with ``n``, the number of their occurrences."""
    stats = s.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("h", "n")
    return s.join(stats, "h")


def _rare_matches(shared: DataFrame, rare: int) -> DataFrame:
    """(a, b, pa, pb), a < b: all matches of the seeds with at most ``rare`` occurrences."""
    both = shared.where(F.col("n") <= rare).groupBy("h").agg(F.collect_list(F.struct("id", "pos")).alias("at"))  # at most ``rare``
    x = both.select("at", F.explode("at").alias("x")).select("x", F.explode("at").alias("y")).where("x.id < y.id")
    return x.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.pos").alias("pa"), F.col("y.pos").alias("pb"))


def _class_matches(shared: DataFrame, k: int, rare: int) -> DataFrame:
    """(a, b, pa, pb), a <= b: each occurrence of a seed with more than ``rare`` of them, matched with its first one, in text a.

    Rows grow with the occurrences, not with their pairs; repetition inside the first text gives a = b.
    Occurrences that overlap (a period) are a run and matched one by one with the first run, over and over.
    """
    at = Window.partitionBy("h", "id").orderBy("pos")
    many = shared.where(F.col("n") > rare).select("h", "id", "pos")
    many = many.withColumn("run", F.sum(F.when(F.col("pos") - F.lag("pos").over(at) < k, 0).otherwise(1)).over(at))
    many = many.withColumn("i", F.row_number().over(Window.partitionBy("h", "id", "run").orderBy("pos")) - 1)
    first = many.where("run = 1").join(many.groupBy("h").agg(F.min("id").alias("a")), "h").where("id = a").select("h", "a", "i", F.col("pos").alias("pa"))
    x = many.join(first.groupBy("h").agg(F.count("*").alias("size")), "h").select("h", "id", "pos", (F.col("i") % F.col("size")).cast("int").alias("i"))
    return x.join(first, ["h", "i"]).where("id <> a or pos <> pa").select("a", F.col("id").alias("b"), "pa", F.col("pos").alias("pb"))


def chained_passages(shared: DataFrame, span: int = SPAN, rare: int = RARE) -> DataFrame:
    """(a, b, a_start, a_end, b_start, b_end, seeds, pas, pbs) of each chain of rare seeds; a < b; ends exclusive; pas, pbs the places of its seeds."""
    return _chains(_rare_matches(shared, rare), span)


def _chains(pairs: DataFrame, span: int) -> DataFrame:
    """Matches (a, b, pa, pb) chained within each (a, b)."""
    k = span // 2
    pairs = pairs.repartition("a", "b").sortWithinPartitions("a", "b", "pa", "pb")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        pas: list[int] = []
        pbs: list[int] = []
        out: list[tuple] = []

        def close() -> None:
            for c in chain(pas, pbs, k):
                xs, ys = [pas[i] for i in c], [pbs[i] for i in c]
                out.append((*held, xs[0], xs[-1] + k, ys[0], ys[-1] + k, len(c), xs, ys))

        def flush() -> pa.RecordBatch:
            cols = [pa.array([r[i] for r in out], pa.int64() if i < 2 else pa.int32() if i < 7 else pa.list_(pa.int32())) for i in range(9)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=["a", "b", "a_start", "a_end", "b_start", "b_end", "seeds", "pas", "pbs"])

        for batch in batches:
            for a, b, p, q in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held != (a, b):
                    if held:
                        close()
                    held, pas, pbs = (a, b), [], []
                pas.append(p)
                pbs.append(q)
            yield flush()
        if held:
            close()
            yield flush()

    return pairs.mapInArrow(work, "a bigint, b bigint, a_start int, a_end int, b_start int, b_end int, seeds int, pas array<int>, pbs array<int>")


def _exact_windows(texts: DataFrame, ranges: DataFrame, span: int) -> DataFrame:
    """(id, pos, h1, h2) of each window that starts inside a range of its text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t, spans in zip(*(b.column(c).to_pylist() for c in range(3))):
                p = _points(t)
                want = np.zeros(len(p) + 1, np.int32)
                for s in spans:
                    want[max(0, s["s"])] += 1
                    want[max(0, min(len(p), s["e"]))] -= 1
                pos = np.flatnonzero(np.cumsum(want)[: max(0, len(p) - span + 1)] > 0)
                if len(pos):
                    h1, h2 = (_window_hashes(p, span, base)[pos].astype(np.int64) for base in (_B1, _B2))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), i, np.int64)), pa.array(pos.astype(np.int32)), pa.array(h1), pa.array(h2)], names=["id", "pos", "h1", "h2"])

    return texts.join(ranges, "id").select("id", "text", "spans").mapInArrow(work, "id bigint, pos int, h1 bigint, h2 bigint")


def _common_runs(pairs: DataFrame, span: int) -> DataFrame:
    """pairs(a, b, a_at, b_at, a_text, b_text) -> (id, s, e): runs of windows that stand in both slices, for both texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids, starts, ends = [], [], []
            for a, b, a_at, b_at, ta, tb in zip(*(x.column(i).to_pylist() for i in range(6))):
                p, q = _points(ta), _points(tb)
                hp, hq = ([_window_hashes(v, span, base) for base in (_B1, _B2)] for v in (p, q))
                hp, hq = hp[0] ^ (hp[1] << np.uint64(1)), hq[0] ^ (hq[1] << np.uint64(1))
                for doc, at, mine, other in ((a, a_at, hp, hq), (b, b_at, hq, hp)):
                    pos = np.flatnonzero(np.isin(mine, other))
                    if len(pos):
                        gap = np.flatnonzero(np.diff(pos) > span)
                        first, last = np.concatenate([pos[:1], pos[gap + 1]]), np.concatenate([pos[gap], pos[-1:]])
                        ids += [doc] * len(first)
                        starts += (first + at).tolist()
                        ends += (last + at + span).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["id", "s", "e"])

    return pairs.mapInArrow(work, "id bigint, s bigint, e bigint")


def _sized(df: DataFrame, entries: str = "1") -> DataFrame:
    """A written table, broadcast if its rows (or the entries of its lists) are few enough, else joined by a shuffle."""
    size = df.agg(F.coalesce(F.sum(F.expr(entries)), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_ROWS else df


def edits(a: str, b: str) -> int:
    """Edit distance, a column of the table as the bits of a number."""
    if a == b or not a or not b:
        return 0 if a == b else max(len(a), len(b))
    n, at = len(a), {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every, top, more, less, d = (1 << n) - 1, 1 << n - 1, (1 << n) - 1, 0, n
    for c in b:
        x = at.get(c, 0)
        y = (((x & more) + more) ^ more) | x | less
        up, down = less | ~(y | more) & every, more & y
        d += bool(up & top) - bool(down & top)
        up = (up << 1 | 1) & every
        more, less = (down << 1 | ~(x | less | up)) & every, up & (x | less)
    return d


def carried(a: str, b: str) -> tuple[int, int, int]:
    """(code points of a, of b, edits) from the beginning of both as far as they agree but for single edits."""
    i = j = k = 0
    while True:
        while i < len(a) and j < len(b) and a[i] == b[j]:
            i, j = i + 1, j + 1
        # The edit behind which they agree again: another character, one more in a, one more in b.
        for di, dj in ((1, 1), (1, 0), (0, 1)):
            if i + di + RESUME <= len(a) and j + dj + RESUME <= len(b) and a[i + di : i + di + RESUME] == b[j + dj : j + dj + RESUME]:
                i, j, k = i + di, j + dj, k + 1
                break
        else:
            return i, j, k


def align(a: str, b: str, pas: list[int], pbs: list[int], k: int) -> tuple[int, int, int, int, int]:
    """(start in a, end in a, start in b, end in b, edits) of the chain of seeds of k at ``pas`` in a and ``pbs`` in b, aligned and carried on at both ends."""
    n = 0
    for p, p2, q, q2 in zip(pas, pas[1:], pbs, pbs[1:]):
        over = max(0, p + k - p2, q + k - q2)  # neighbours that overlap differ by what one of them is shorter
        n += edits(a[p + k : p2 + over], b[q + k : q2 + over])
    left = carried(a[: pas[0]][::-1], b[: pbs[0]][::-1])
    right = carried(a[pas[-1] + k :], b[pbs[-1] + k :])
    return pas[0] - left[0], pas[-1] + k + right[0], pbs[0] - left[1], pbs[-1] + k + right[1], n + left[2] + right[2]


def _aligned(chains: DataFrame, texts: DataFrame, span: int) -> DataFrame:
    """Chains (with passage) aligned: (a, b, a_start, a_end, b_start, b_end, seeds, identity, passage)."""
    k, far = span // 2, BEYOND * span
    c = cut(chains.withColumn("row", F.monotonically_increasing_id()))
    side = lambda x: F.struct(F.col(x).alias("id"), F.lit(x).alias("side"), F.greatest(F.col(f"{x}_start") - far, F.lit(0)).alias("at"), (F.col(f"{x}_end") + far).alias("to"))
    sides = cut(c.select("row", F.explode(F.array(side("a"), side("b"))).alias("x")).select("row", "x.*"))
    slices = texts.select("id", "text").join(_sized(sides), "id").select("row", "side", F.col("text").substr(F.col("at") + 1, F.col("to") - F.col("at")).alias("slice"))
    both = slices.groupBy("row").agg(F.max(F.when(F.col("side") == "a", F.col("slice"))).alias("a_text"), F.max(F.when(F.col("side") == "b", F.col("slice"))).alias("b_text"))
    low = lambda x: F.greatest(F.col(f"{x}_start") - far, F.lit(0))
    rows = c.join(both, "row").select("a", "b", "seeds", "passage", low("a").alias("a_at"), low("b").alias("b_at"), "pas", "pbs", "a_text", "b_text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out: list[tuple] = []
            for a, b, n, name, a_at, b_at, pas, pbs, ta, tb in zip(*(x.column(i).to_pylist() for i in range(10))):
                s, e, u, v, d = align(ta, tb, [p - a_at for p in pas], [p - b_at for p in pbs], k)
                out.append((a, b, s + a_at, e + a_at, u + b_at, v + b_at, n, round(1 - d / max(e - s, v - u), 4), name))
            kinds = [pa.int64()] * 2 + [pa.int32()] * 5 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["a", "b", "a_start", "a_end", "b_start", "b_end", "seeds", "identity", "passage"])

    # Chains that a larger edit parts may meet when they are carried on.
    return rows.mapInArrow(work, "a bigint, b bigint, a_start int, a_end int, b_start int, b_end int, seeds int, identity double, passage string").distinct()


def _merged(spans: DataFrame, *keys: str) -> DataFrame:
    """Overlapping and touching (s, e) of each key put together. A key's spans are bounded by its text."""
    before = Window.partitionBy(*keys).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)
    x = spans.distinct().withColumn("far", F.max("e").over(before)).withColumn("new", F.when(F.col("far") >= F.col("s"), 0).otherwise(1))
    return x.withColumn("g", F.sum("new").over(upto)).groupBy(*keys, "g").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("g")


def shared_spans(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, rare: int = RARE) -> DataFrame:
    """(key, span_start, span_end): maximal runs of positions inside a stretch of ``span`` that another record has too."""
    texts = _long_texts(df, key, text, span)
    same = cut(texts.select("id", "t1", "t2", "n").join(texts.groupBy("t1", "t2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), ["t1", "t2"]).select("id", "rep", "n"))
    later = _sized(same.where("id <> rep").select("id"))
    shared = cut(_shared(seeds(spread(texts), span).join(later, "id", "left_anti")))
    k = span // 2
    # Rare seeds: the passages of each chain, widened so that no window with a seed in it is cut, are held against each other.
    chains = chained_passages(shared, span, rare)
    near = cut(chains.select("a", "b", *(x for c in ("a", "b") for x in (F.greatest(F.col(f"{c}_start") - (span - k), F.lit(0)).alias(f"{c}_at"), (F.col(f"{c}_end") + (span - k)).alias(f"{c}_to")))))
    pair = F.struct("a", "b", "a_at", "b_at", "a_to", "b_to").alias("p")
    sides = near.select(F.explode(F.array(*[F.struct(F.col(c).alias("id"), pair, F.lit(c).alias("side"), F.col(f"{c}_at").alias("at"), F.col(f"{c}_to").alias("to")) for c in ("a", "b")])).alias("x")).select("x.*")
    slices = texts.select("id", "text").join(_sized(sides), "id").select("p", "side", F.col("text").substr(F.col("at") + 1, F.col("to") - F.col("at")).alias("slice"))
    both = slices.groupBy("p").agg(F.max(F.when(F.col("side") == "a", F.col("slice"))).alias("a_text"), F.max(F.when(F.col("side") == "b", F.col("slice"))).alias("b_text"))
    spans = _common_runs(both.select("p.a", "p.b", "p.a_at", "p.b_at", "a_text", "b_text"), span)
    # Frequent seeds: all windows around them are hashed; those of two texts or more cover their positions.
    around = shared.where(F.col("n") > rare).select("id", (F.col("pos") - (span - k)).alias("s"), (F.col("pos") + 1).alias("e"))
    ranges = cut(_merged(around, "id").groupBy("id").agg(F.collect_list(F.struct("s", "e")).alias("spans")))
    windows = cut(_exact_windows(texts.select("id", "text"), _sized(ranges, "size(spans)"), span))
    twice = windows.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h1", "h2")
    covered = windows.join(twice, ["h1", "h2"], "left_semi").select("id", F.col("pos").cast("long").alias("s"), (F.col("pos") + span).cast("long").alias("e"))
    runs = _merged(spans.unionByName(covered), "id").select("id", F.col("s").alias("span_start"), F.col("e").alias("span_end"))
    lone = runs.join(_sized(same.select("id")), "id", "left_anti")
    copies = same.select("id", F.lit(0).cast("long").alias("span_start"), F.col("n").cast("long").alias("span_end"))
    return lone.unionByName(copies).select(F.col("id").alias(key), "span_start", "span_end")


def fuzzy_passages(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, rare: int = RARE) -> DataFrame:
    """(a, b, a_start, a_end, b_start, b_end, seeds, identity, passage): chained and aligned passages between first copies of texts.

    identity is 1 less the edits of the alignment over the longer of its two stretches.

    Rare seeds give a row for each pair of texts, ``passage`` null. For frequent ones every text that has
    them is chained against the text with their first occurrence: a is that text, b the member, and
    ``passage`` ("a:start") the class, a run of overlapping stretches of a. Two members of a class share
    what their stretches of a have in common, so no pair is lost and none has to be made.
    """
    texts = _long_texts(df, key, text, span)
    firsts = texts.join(texts.groupBy("t1", "t2").agg(F.min("id").alias("id")).select("id"), "id", "left_semi").select("id", "text")
    shared = cut(_shared(seeds(spread(firsts), span)))
    pairs = chained_passages(shared, span, rare).withColumn("passage", F.lit(None).cast("string"))
    members = cut(_chains(_class_matches(shared, span // 2, rare), span))
    # The classes of a text: its distinct stretches, bounded by its length, in runs that overlap.
    at = Window.partitionBy("a").orderBy("a_start", "a_end")
    x = members.select("a", "a_start", "a_end").distinct().withColumn("far", F.max("a_end").over(at.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("g", F.sum(F.when(F.col("far") > F.col("a_start"), 0).otherwise(1)).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.select("a", "a_start", "a_end", F.concat_ws(":", "a", F.min("a_start").over(Window.partitionBy("a", "g"))).alias("passage"))
    return _aligned(pairs.unionByName(members.join(x, ["a", "a_start", "a_end"])), firsts, span)


def shared_share(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(key, n_chars, shared_chars, share) of every record; 0 for null, empty and short texts."""
    s = shared_spans(df, key, text, span).groupBy(key).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    return df.select(key, n.alias("n_chars")).join(s, key, "left").select(key, "n_chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.round(F.coalesce(F.col("shared_chars") / F.col("n_chars"), F.lit(0.0)), 6).alias("share"))
