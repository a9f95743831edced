"""Conversation trie, spelling variants and quantised vector dedup against brute force, and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from floe.llm import itq, trie, variants

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


# -- op11 --------------------------------------------------------------------------

def brute_trie(rows, group=100, most=6):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [said for _, said in sorted(turns, key=lambda t: t[0])] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        built[c] = tuple(own.get(c - int(math.fmod(c, group)), [])[:h] + turns[h:])
    members, kids = defaultdict(list), defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in kids[s]) or 1
        saved[s] = (len(members[s]) - 1) * (len(s[-1][1]) if s else 0) + sum(saved[k] for k in kids[s])
    return {(min(m), len(s)): (
        min(members[s[:-1]]) if s else None, len(m), len(kids[s]), leaves[s], saved[s],
        hashlib.sha256(",".join(map(str, sorted(c for c in m if built[c] == s))).encode()).hexdigest())
        for s, m in members.items()}


def made_trie(df):
    rows = trie.prefix_trie(*trie.borrow_openings(trie.ordered_turns(df))).collect()
    out = {(r.conv_id, r.depth): tuple(r)[2:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "CELL", 4)
    monkeypatch.setattr(trie, "PIECE", 3)
    rng = np.random.default_rng(4)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    for c in range(1_000, 1_300):        # few texts, so that many openings are shared
        rows += [(c, t, "user" if t % 2 else "assistant", str(rng.integers(0, 2))) for t in range(rng.integers(1, 6))]
    rows += [(5_000, t, "user", f"turn {t} äß") for t in range(60)] + [(5_001, t, "user", "same") for t in range(20)]
    rows += [(c, t, "user", "copy") for c in range(6_000, 6_040) for t in range(7)]
    assert made_trie(spark.createDataFrame(rows, TURNS).repartition(5)) == brute_trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, "user", "tie"), (1, 0, "user", "tie"), (2, 0, "", ""),
            (2, 1, "a", "bc"), (3, 0, "", None), (3, 1, "ab", "c"), (None, 0, "user", "no id"), (-7, 3, "user", "below"),
            (200, 0, "user", "x" * 200_000), (203, 0, "user", "only one"), (9, 1, "user", "é\U0001F600"), (9, 2, "user", "")]
    df = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit(7)).withColumn("ka", F.lit("x"))
    assert made_trie(df) == brute_trie(rows)
    assert made_trie(df.limit(0)) == {}


def test_nodes_carry_their_last_turn(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (2, 1, "bot", "c")], TURNS)
    turns = trie.ordered_turns(df)
    sizes = turns.filter("pos = 0").select("conv_id", F.col("size").alias("n_turns"))
    nodes = trie.node_turns(trie.prefix_trie(turns, sizes), turns, df)
    assert {(r.depth, r.role, r.text, r.n_convs) for r in nodes.collect()} == {
        (0, None, None, 2), (1, "user", "a", 2), (2, "bot", "b", 1), (2, "bot", "c", 1)}


# -- op12 --------------------------------------------------------------------------

def brute_words(docs, slip):
    n = Counter()
    for doc, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            n[w[:h % len(w)] + w[h % len(w) + 1:] if h % slip == 0 else w] += 1
    return dict(n)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(n, ratio=5):
    near = {w: [x for x in n if x != w and one_edit(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= ratio * n[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] is not None else w
    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] is not None else None) for w in n}


def made_variants(words):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_variants(words).collect()}


def test_word_counts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(variants, "TABLE", 50)
    monkeypatch.setattr(variants, "PIECE", 100)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(None, "ÀÉ Àé x"), (None, None), (1, ""), (1, "Ω×÷é ÿÿ"), (3, "ab" * 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("n", F.lit(3))
    for slip in (7, 10 ** 9):
        assert {r.word: r.n for r in variants.count_words(df, slip).collect()} == brute_words(rows, slip)
    assert variants.count_words(df.limit(0), 7).count() == 0


def test_variants_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    n = {}
    for word in ("alpha", "aab", "banana", "éclair", "zz", "a"):
        for _ in range(60):              # edits of edits, runs of equal letters, one-letter words
            w = list(word)
            for _ in range(rng.integers(0, 3)):
                at, kind = int(rng.integers(0, len(w) + 1)), rng.integers(0, 3)
                w[at:at + (kind > 0)] = ["abné"[rng.integers(0, 4)]] if kind < 2 else []
            if w:
                n["".join(w)] = int(5 ** rng.integers(0, 5)) + int(rng.integers(0, 2))
    for x in "abcdefghijklmnopqrstuvwxyz":
        n[f"hot{x}word"] = 10            # one key with a whole alphabet, all ties
    df = spark.createDataFrame(list(n.items()), "word string, n long").withColumn("key", F.lit(1))
    assert made_variants(df.repartition(7)) == brute_variants(n)
    assert made_variants(df.limit(0)) == {}


def test_roots_follow_long_chains(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(40)]
    got = {r.word: r.root for r in variants.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {f"w{i}": "w40" for i in range(40)}


# -- op13 --------------------------------------------------------------------------

def brute_near(rows, threshold=0.95):
    """[(vec_id, links, component)] of rows (vec_id, vector) with distinct ids."""
    usable = {}
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, float) / max(map(abs, v))
            usable[i] = x / math.sqrt(x @ x)
    links = {i: [j for j in usable if j != i and len(usable[i]) == len(usable[j])
                 and usable[i] @ usable[j] >= threshold] for i in usable}
    comp = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, others in links.items():
            low = min([comp[i], *(comp[j] for j in others)])
            if low < comp[i]:
                comp[i], changed = low, True
    return {i: (len(links.get(i, [])), comp[i], comp[i] == i) for i, _ in rows}


def made_near(df, **options):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in itq.near_vectors(df, **options).collect()}


def planted(seed, groups, spread):
    """Vectors around ``groups`` centres, at cosines on both sides of 0.95."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        centre = rng.normal(size=24)
        for _ in range(rng.integers(1, 9)):
            rows.append(centre + spread * rng.normal(size=24) * rng.uniform(0, 1))
    return [(7 * i, [float(x) for x in v]) for i, v in enumerate(rows)]


@pytest.mark.parametrize("block", [512, 4])
def test_near_vectors_reach_the_recall(spark, monkeypatch, block):
    monkeypatch.setattr(itq, "BLOCK", block)
    rows = planted(3, 150, 0.35) + [(100_000 + i, [1.0] * 24) for i in range(40)]
    rows += [(200_000 + i, [1.0 + 0.01 * ((i * k) % 5) for k in range(24)]) for i in range(60)]   # a hot bucket
    got = made_near(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6))
    want = brute_near([(i, [float(np.float32(x)) for x in v]) for i, v in rows])
    assert len(got) == len(rows)
    assert sum(n for n, _, _ in got.values()) >= 0.99 * sum(n for n, _, _ in want.values()) > 0
    assert all(got[i][0] <= want[i][0] and got[i][1] >= want[i][1] for i in want)       # no false link
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)


def test_codes_are_balanced_and_tables_reach_the_recall():
    rng = np.random.default_rng(0)
    x = itq.unit(rng.normal(size=(3_000, 32)) + 0.5)
    codes = itq.fit_codes(x, 3_000, 0.95)
    assert abs(codes.bits(x).mean(0) - 0.5).max() < 0.01
    near = x[:1_000]
    away = rng.normal(size=near.shape)
    away -= (away * near).sum(1, keepdims=True) * near
    made = 0.95 * near + math.sqrt(1 - 0.95 ** 2) * itq.unit(away)
    assert (codes.keys(near) == codes.keys(made)).any(1).mean() > 0.98


def test_near_vectors_of_odd_rows(spark):
    big = [1e300, 2e300, 3e300]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [0.0, 0.0, 0.0]), (5, [float("nan"), 1.0, 1.0]),
            (6, [float("inf"), 1.0, 1.0]), (7, [None, 1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (9, big), (10, [1.0, 2.0]),
            (11, [2.0, 4.0]), (12, [-1.0, -2.0, -3.0]), (13, [5.0]), (14, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cid", F.lit(1)).withColumn(
        "v", F.lit("x"))
    assert made_near(df) == brute_near(rows)
    assert made_near(df.limit(0)) == {}
    repeated = spark.createDataFrame(
        [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (None, [0.0, 1.0]), (None, [-1.0, 0.0]), (3, [1.0, 0.0])],
        "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in itq.near_vectors(repeated).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, False), (None, 0, None, True),
                          (3, 1, 1, False)], key=str)


def test_a_block_of_queries_goes_through_the_pages_together():
    """Same rows as brute force and as one query at a time, ties to the smaller id, fewer than k below a floor."""
    from floe.llm import mtree
    rng = np.random.default_rng(5)
    points = rng.integers(-4, 5, size=(700, 6)).astype(float)
    ids, pages = rng.permutation(700).astype(np.int64), mtree.build(points)
    asks = np.arange(0, 700, 9)
    for least in (-np.inf, 40.0):
        floors = np.full(len(asks), least)
        who, names, scores = mtree.search_block(pages, points, ids, points[asks], ids[asks], 5, floors)
        for i, at in enumerate(asks):
            all_of = sorted((-float(s), int(n)) for n, s in zip(ids, points @ points[at]) if n != ids[at] and s >= least)[:5]
            assert [(-s, n) for n, s in zip(names[who == i], scores[who == i])] == all_of
            one = mtree.search(pages, points, ids, points[at], int(ids[at]), 5, least)
            assert sorted((-s, n) for s, n in one) == all_of
