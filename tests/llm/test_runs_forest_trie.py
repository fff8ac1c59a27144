"""Periodic runs, MinHash forest and prefix trie against brute force, and their defined edge cases."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelake.llm import minhash_forest, periodic_runs, prefix_trie
from stridelake.llm.queries import rebuilt

DOCS = "doc_id long, text string, n_words string, runs int, kept string, one int"


def brute_runs(x):
    best = {}
    for q in range(1, len(x) // 3 + 1):
        t = 0
        while t + q < len(x):
            a = t
            while t + q < len(x) and x[t] == x[t + q]:
                t += 1
            if t > a and t - a + q >= max(24, 3 * q):
                best.setdefault((a, t - a + q), q)
            t += 1
    return sorted(((s, m, q) for (s, m), q in best.items()), key=lambda r: (r[0], r[2]))


def looping_words(rng):
    out = []
    kind = rng.randrange(5)
    for _ in range(rng.randrange(0, 5)):
        unit = [f"w{rng.randrange(rng.choice([1, 2, 3, 50]))}" for _ in range(rng.randrange(1, rng.choice([4, 12, 40, 90])))]
        unit = unit * rng.randrange(1, 4) + ["x"] if kind == 0 else unit
        whole = unit * rng.randrange(1, 12)
        out += whole[: len(whole) - rng.randrange(0, len(unit))]
        out += out[-60:] * 2 if kind == 1 else []
    return out[:1200]


def test_runs_equal_brute_force():
    rng = random.Random(11)
    total = 0
    for _ in range(120):
        docs = [looping_words(rng) for _ in range(rng.randrange(1, 5))]
        number = {}
        x = np.array([number.setdefault(w, len(number)) for d in docs for w in d], np.int64)
        ends = np.cumsum([len(d) for d in docs])
        got = periodic_runs.find_runs(x, ends - [len(d) for d in docs], ends)
        want = [brute_runs(d) for d in docs]
        assert got == want
        total += sum(map(len, want))
    assert total > 300


def test_runs_of_words_that_recur_everywhere():
    """One word, a nine-word loop and a Fibonacci word: seeds grow with the words, not with pairs of occurrences."""
    zeros, loop = np.zeros(200_000, np.int64), np.tile(np.arange(9), 20_000)
    assert periodic_runs.find_runs(zeros, np.array([0]), np.array([len(zeros)])) == [[(0, 200_000, 1)]]
    assert periodic_runs.find_runs(loop, np.array([0]), np.array([len(loop)])) == [[(0, 180_000, 9)]]
    a, b = [0], [0, 1]
    while len(b) < 2000:
        a, b = b, b + a
    assert periodic_runs.find_runs(np.array(b), np.array([0]), np.array([len(b)])) == [brute_runs(b)]


@pytest.mark.parametrize("pack", [1, 50, 1 << 18])
def test_runs_rows(spark, pack):
    rng = random.Random(3)
    texts = [" ".join(looping_words(rng)) for _ in range(30)] + ["", "  \t\n ", "one", "é " * 24, "A a " * 12, "a\x85b " * 30]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (5, None), (None, "a " * 30)]
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], DOCS)
    got = sorted((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in periodic_runs.collapsed(docs, pack).collect())
    want = []
    for i, t in rows[:-1]:
        words = [w.decode() for w in (t or "").encode().split()]
        runs = brute_runs(words)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        want.append((i, len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert got == sorted(want)
    assert periodic_runs.collapsed(docs.limit(0)).collect() == []


def test_longest_run_compares_exactly(spark):
    runs = [(0, 24, 7), (50, 10**9, 3 * 10**8 + 1), (100, 10**9 + 1, 3 * 10**8 + 1), (200, 48, 14), (300, 24, 7)]
    df = spark.createDataFrame([(runs,), ([],), ([(9, 30, 10), (4, 60, 20)],)], "runs array<struct<start:long,length:long,period:long>>")
    got = [r.best and tuple(r.best) for r in df.select(periodic_runs.longest(F.col("runs")).alias("best")).collect()]
    assert got == [(0, 24, 7), None, (9, 30, 10)]


def near_copies(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "bcdfghjklm" for b in ("an", "en", "ir", "ost", "ul")]
    out, base = [], []
    for k in range(160):
        if k % 16 == 0:
            base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 30, 200]))]
        words = list(base)
        for _ in range(rng.randrange(0, 1 + len(base) // 25)):
            words[rng.randrange(len(base))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            base = words  # a chain whose ends are further apart than its links
        out.append((k, " ".join(words)))
    return out


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        sets.setdefault(i, []).append({tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else set())
    up = {i: i for i in sets}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a, b in combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return sorted((i, len(s), root(i)) for i in sets for s in sets[i])


@pytest.mark.parametrize("block", [(1024, 1 << 18), (3, 1 << 18), (1024, 600)])
def test_forest_finds_every_link(spark, block):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash_forest.classes(docs, *block).collect())
    assert got == brute_classes(rows)
    assert 8 < len({c for *_, c in got}) < 150


def test_forest_edges(spark):
    rows = [(7, "a b c d"), (3, "A B c  d"), (3, "A B c  d"), (9, None), (8, ""), (6, " \n"), (5, "one two"), (4, "One two"), (2, "two one"), (1, "x" * 200_000)]
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in [*rows, (None, "a b c d")]], DOCS)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_forest.classes(docs).collect())
    assert got == [(1, 1, 1, True), (2, 1, 2, True), (3, 2, 3, True), (3, 2, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True),
                   (7, 2, 3, False), (8, 0, 8, True), (9, 0, 9, True)]
    assert minhash_forest.classes(docs.limit(0)).collect() == []


def test_dense_group_yields_a_forest():
    """Hundreds of members of one class: fewer links than members."""
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 62, 400, dtype=np.uint64))
    sets = [np.unique(np.concatenate((base[rng.permutation(len(base))[:390]], rng.integers(0, 1 << 62, 5, dtype=np.uint64)))) for _ in range(300)]
    classes = minhash_forest._Classes()
    assert len(minhash_forest.link(sets, list(range(300)), 300, classes)) == 299
    assert {classes.root(i) for i in range(300)} == {0}


def test_findclose_by_scanning():
    rng = random.Random(8)
    for n in (1, 2, 40, 700):
        bits, open_now, left = [], 0, n
        while left or open_now:
            if left and (not open_now or rng.random() < 0.55):
                bits.append(1)
                open_now, left = open_now + 1, left - 1
            else:
                bits.append(0)
                open_now -= 1
        brackets = prefix_trie.Parentheses(np.array([1, *bits, 0], np.uint8))
        stack, want = [], {}
        for k, bit in enumerate(brackets.bits.tolist()):
            if bit:
                stack.append(k)
            else:
                want[stack.pop()] = k
        opens = np.flatnonzero(brackets.bits)
        assert brackets.closes(opens).tolist() == [want[k] for k in opens.tolist()]
        assert [brackets.findclose(k) for k in opens.tolist()] == [want[k] for k in opens.tolist()]


def brute_trie(talks):
    """talks: conv_id → rebuilt turns (role, text)."""
    members, ends = {}, {}
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    words = lambda k: len(k[-1][1].encode().split()) if k else 0
    out = []
    for k, convs in members.items():
        below = [u for u in members if u[: len(k)] == k]
        text = ",".join(map(str, sorted(ends.get(k, []))))
        out.append((min(convs), len(k), min(members[k[:-1]]) if k else None, len(convs), len(kids.get(k, [])),
                    sum(u not in kids for u in below), sum((len(members[u]) - 1) * words(u) for u in below), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def talks(seed=2, n=150):
    rng = random.Random(seed)
    out = {c: [(rng.choice("ua"), f"t{rng.randrange(3)} a" * rng.randrange(3)) for _ in range(rng.choice([1, 2, 3, 5, 9]))] for c in range(n)}
    out |= {n + c: list(out[0]) for c in range(20)} | {-5: out[3], n + 100: [("u", "long")] * 60, n + 101: [("u", "long")] * 59}
    return out


@pytest.mark.parametrize(("shard_nodes", "piece"), [(1, 1), (7, 4), (1 << 17, 1 << 14)])
def test_trie_equals_brute_force(spark, monkeypatch, shard_nodes, piece):
    monkeypatch.setattr(prefix_trie, "ID_PIECE", piece)
    talk = talks()
    rows = [(c, d, r, t, "x") for c, turns in talk.items() for d, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    seqs = prefix_trie.sequences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_convs string"))
    assert nodes(prefix_trie.trie(seqs, shard_nodes)) == brute_trie(talk)


def test_trie_of_turnless_conversations(spark):
    talk = {4: [], 2: [], 9: [("u", "a b")], 7: [("u", "a b")]}
    seqs = spark.createDataFrame([(c, []) for c in (4, 2)], "conv_id long, turns array<string>").unionByName(
        prefix_trie.sequences(spark.createDataFrame([(9, 0, "u", "a b"), (7, 0, "u", "a b")], "conv_id long, turn long, role string, text string")))
    assert nodes(prefix_trie.trie(seqs)) == brute_trie(talk)


def test_trie_edges(spark):
    ddl = "conv_id long, turn long, role string, text string"
    rows = [(20, 1, "u", "b"), (20, None, None, "a"), (21, 0, "", "a"), (21, 0, "", "a"), (22, 0, "u", None), (22, 1, "u", ""), (None, 0, "u", "a"), (23, 0, "u ", "x"), (24, 0, "u", " x")]
    df = spark.createDataFrame(rows, ddl)
    want = brute_trie({20: [("", "a"), ("u", "b")], 21: [("", "a")] * 2, 22: [("u", "")] * 2, 23: [("u ", "x")], 24: [("u", " x")]})
    assert nodes(prefix_trie.trie(prefix_trie.sequences(df))) == want
    assert nodes(prefix_trie.trie(prefix_trie.sequences(df.limit(0)))) == []


def test_rebuilt_conversations(spark):
    """The first turns come from the one of twenty; missing and short ones give what they have."""
    import zlib

    rows = [(c, d, "u", f"{c} {d}") for c in [*range(20, 40), *range(41, 60)] for d in range(1 + c % 4)]
    own = {}
    for c, _, r, t in rows:
        own.setdefault(c, []).append((r, t))
    want = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        want[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    seqs = prefix_trie.sequences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert any(not t for t in want.values())
    assert nodes(prefix_trie.trie(rebuilt(seqs), 5)) == brute_trie(want)
