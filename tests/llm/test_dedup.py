import hashlib
from collections import Counter, defaultdict

import pytest

from kindred.llm import blocks, exact_dedup, line_dedup, ngram_join, suffix_dedup, window_dedup

from .corpus import SPACE, corpus, frame, lower_ascii

ROWS = corpus()


def sha(x):
    return hashlib.sha256(x).hexdigest()


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact(spark, keep):
    best = min if keep == "smallest" else max
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[lower_ascii(t)].append(i)
    want = Counter()
    for text, ids in groups.items():
        real = [i for i in ids if i is not None]
        stays = best(real) if real else None
        left = True
        for i in ids:
            mine = i == stays and left
            left = left and not mine
            want[i, stays, len(ids), mine, sha(text.encode())] += 1
    got = Counter(tuple(r) for r in exact_dedup.exact_dedup(frame(spark, ROWS), keep=keep).collect())
    assert got == want


def test_exact_hot_group_over_many_partitions(spark):
    rows = [(i, "same" if i % 3 else f"text {i}") for i in range(3000)]
    got = exact_dedup.exact_dedup(frame(spark, rows).repartition(7), keep="smallest").collect()
    assert len(got) == 3000 and {r.keep_id for r in got if r.doc_id % 3} == {1} and sum(r.kept for r in got) == 1001
    assert {r.group_size for r in got if r.doc_id % 3} == {2000}


def lines_removed(rows):
    places = [(i is not None, i or 0, k, i, t, w) for i, t in rows for k, w in enumerate(zip(*[(t or "").split("\n")[j:] for j in range(3)]))]
    first = {}
    for p in sorted(places, key=lambda p: p[:3]):
        first.setdefault(p[5], p)
    gone = defaultdict(set)
    for p in places:
        if p[:3] != first[p[5]][:3]:
            gone[p[3], p[4]] |= {p[2], p[2] + 1, p[2] + 2}
    return gone


def test_lines(spark):
    rows = [r for r in ROWS if r != (5, "another text under an id that is taken")]  # one text for each id
    gone = lines_removed(rows)
    want = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone[i, t])
        want[i, None if t is None else kept, len(lines), len(gone[i, t])] += 1
    assert any(gone.values())
    out = line_dedup.line_dedup(frame(spark, rows))
    assert out.columns[:10] == frame(spark, rows).columns
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()) == want


def windows_removed(rows, width):
    first = {}
    for i, t in rows:
        words = SPACE.findall(t or "")
        for k in range(len(words) - width + 1):
            w = tuple(words[k : k + width])
            first[w] = min(first.get(w, (True, float("inf"))), (i is not None, i or 0))
    for i, t in rows:
        words = SPACE.findall(t or "")
        gone = [False] * len(words)
        for k in range(len(words) - width + 1):
            if first[tuple(words[k : k + width])] < (i is not None, i or 0):
                gone[k : k + width] = [True] * width
        yield i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)


@pytest.mark.parametrize("bucket, block", [(1 << 25, 1 << 20), (1 << 20, 100), (1500, 400), (400, 400)])
def test_windows(spark, bucket, block):
    want = Counter(windows_removed(ROWS, 50))
    got = Counter(tuple(r) for r in window_dedup.window_dedup(frame(spark, ROWS).repartition(5), bucket=bucket, block=block).collect())
    assert sum(x[2] for x in want) > 100
    assert got == want


def around_a_phrase(n, seed=2):
    """Texts that share one phrase, and some of them more of what stands around it: one minimiser has most strings."""
    import random

    r = random.Random(seed)
    prose = lambda k: " ".join(f"{r.choice('abcdefgh')}{r.randrange(3000)}" for _ in range(k))
    phrase, left, right = prose(24), [prose(60) for _ in range(9)], [prose(60) for _ in range(9)]
    texts = []
    for _ in range(n):
        a, b = r.choice(left).split(), r.choice(right).split()
        a, b = a[-r.randint(1, 60) :], b[: r.randint(1, 60)]
        texts.append(" ".join([prose(40), *a, phrase, *b, prose(40)]))
    return list(enumerate(texts))


class Bounded:
    """Looks for windows in blocks, and fails on one that is larger than allowed."""

    def __init__(self, find, most):
        self.find, self.most = find, most

    def __call__(self, block):
        assert len(block.data) <= self.most, len(block.data)
        return self.find(block)


def test_a_large_bucket_of_windows_is_divided(spark, monkeypatch):
    rows = around_a_phrase(2500)
    inner = window_dedup._find
    want = Counter(windows_removed(rows, 50))
    assert sum(x[2] for x in want) > 1000
    for bucket, block in ((1 << 30, 20_000), (300_000, 20_000), (20_000, 20_000)):
        monkeypatch.setattr(window_dedup, "_find", lambda width: Bounded(inner(width), 2 * block))  # noqa: B023
        assert Counter(tuple(r) for r in window_dedup.window_dedup(frame(spark, rows), bucket=bucket, block=block).collect()) == want


def test_a_large_bucket_of_bytes_is_divided(spark, monkeypatch):
    rows = around_a_phrase(700)
    inner = suffix_dedup._find
    want = Counter(bytes_removed(rows, 200))
    assert sum(x[2] for x in want) > 1000
    for bucket, block in ((1 << 30, 10_000), (20_000, 10_000)):
        monkeypatch.setattr(suffix_dedup, "_find", lambda width: Bounded(inner(width), 2 * block))  # noqa: B023
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(frame(spark, rows), bucket=bucket, block=block).collect())
        assert got == want


def bytes_removed(rows, width):
    count = Counter()
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, raw in raws:
        count.update(raw[k : k + width] for k in range(len(raw) - width + 1))
    for i, raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - width + 1):
            if count[raw[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        yield i, len(raw), sum(gone), runs, bytes(b for b, g in zip(raw, gone) if not g)


@pytest.mark.parametrize("bucket, block", [(1 << 25, 1 << 20), (1 << 20, 100), (1500, 400), (400, 400)])
def test_suffixes(spark, bucket, block):
    want = Counter(bytes_removed(ROWS, 200))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(frame(spark, ROWS).repartition(5), bucket=bucket, block=block).collect())
    assert sum(x[2] for x in want) > 1000
    assert got == want


def test_difference_cover():
    for period in (16, 64, 100):
        cover = suffix_dedup.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period)) and len(cover) <= 2 * period**0.5


def deal_texts(bits, buffer):
    import numpy as np
    import pyarrow as pa

    def run(batches):
        dealer = blocks.Dealer(bits, buffer)
        for b in batches:
            for i, hashes in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = np.array(hashes, np.int64).view(np.uint64)
                yield from dealer.add(np.array([i]), np.zeros(len(h), np.int64), h)
        yield from dealer.flush()

    return run


@pytest.mark.parametrize("bits, buffer", [(0, 10), (3, 50), (8, 1 << 20)])
def test_shared_hashes_are_counted(spark, bits, buffer):
    import random

    r = random.Random(6)
    values = [r.randrange(-(1 << 63), 1 << 63) for _ in range(500)]
    texts = [(i, sorted({r.choice(values[: 40 * (1 + i % 12)]) for _ in range(r.randint(0, 30))} | ({values[-1]} if i % 3 else set()))) for i in range(150)]
    times = Counter(h for _, t in texts for h in t)
    df = spark.createDataFrame(texts, "id long, hashes array<long>").repartition(6)
    dealt = df.mapInArrow(deal_texts(bits, buffer), blocks.SCHEMA)
    got = {x.id: x.n for x in blocks.shared_counts(dealt).collect()}
    assert got == {i: sum(times[h] > 1 for h in t) for i, t in texts}
    # blocks follow from hashes and chunks, not from the number of partitions
    more = {}
    for parts in ("2", "60"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        more[parts] = dealt.count()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert more["2"] == more["60"] <= sum(len(t) for _, t in texts) + 200


def test_lines_of_a_long_text(spark):
    """100,000 lines, three of which go: work in proportion to the lines."""
    import time

    long = "\n".join(f"line {k}" for k in range(100_000))
    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, "a\nb\nc\n" + long)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.line_dedup(docs).collect()}
    assert got == {1: ("a\nb\nc", 0), 2: (long, 3)} and time.time() - began < 60


def components(rows):
    sets = []
    for i, t in rows:
        w = SPACE.findall(lower_ascii(t))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return Counter((i, len(x), None if i is None else find(i)) for i, x in sets)


def test_join(spark):
    want = components(ROWS)
    assert sum(i != c for i, _, c in want) > 5
    assert Counter(tuple(r) for r in ngram_join.ngram_jaccard_join(frame(spark, ROWS).repartition(3)).collect()) == want


def test_join_of_a_large_near_group(spark):
    import random

    r = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(r.randint(0, 4)):
            words[r.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    assert Counter(tuple(r) for r in ngram_join.ngram_jaccard_join(frame(spark, rows)).collect()) == components(rows)
