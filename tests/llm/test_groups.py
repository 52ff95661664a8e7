"""Near-duplicate documents and vectors, and connected components, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from foliolake.llm import embdedup, minhash
from foliolake.llm import textbytes as tb
from foliolake.llm.components import connected_components

DOCS = "doc_id long, text string, kept string, rep long, bands int"


def _roots(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def shingle_set(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_groups(rows):
    sets = {d: shingle_set(t) for d, t in rows if d is not None}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, _roots(ids, links)


def _corpus(seed=3, n=160):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["É", "ß", "Ab", "aB"]
    base = [[r.choice(words) for _ in range(r.choice([3, 5, 40, 120]))] for _ in range(25)]
    out = []
    for k in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            w[r.randrange(len(w))] = r.choice(words)
        out.append((k, r.choice([" ", "\n", "\t "]).join(w)))
    return [*out, (900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (905, "one"), (None, "one"), (906, "x " * 20_000)]


def test_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE_ROWS", 7)
    monkeypatch.setattr(minhash, "SIGNATURE_ROWS", 11)
    rows = _corpus()
    got = {(x.doc_id): x for x in minhash.near_duplicates(spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], DOCS)).collect()}
    sets, roots = brute_groups(rows)
    assert len(got) == len(rows)
    for d, s in sets.items():
        assert (got[d].n_shingles, got[d].component_id, got[d].kept) == (len(s), roots[d], roots[d] == d)
    assert got[None].component_id is None and got[None].kept


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
def test_a_repeated_id_has_its_least_text(spark, monkeypatch, broadcast):
    monkeypatch.setattr(minhash, "BROADCAST_IDS", broadcast)
    rows = [(1, "b b b b b b"), (1, "a a a a a a"), (1, None), (2, "b b b b b b"), (3, "a a a a a a"), (4, None), (4, None), (None, "b b b b b b")]
    got = sorted(((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 1, 1, True)] * 3 + [(2, 1, 2, True), (3, 1, 1, False)] + [(4, 0, 4, True)] * 2 + [(None, 1, None, True)], key=str)


@pytest.mark.parametrize("rows_", [4, 4096])
def test_hot_group_is_settled_in_tiles(spark, monkeypatch, rows_):
    monkeypatch.setattr(minhash, "TILE_ROWS", 5)
    monkeypatch.setattr(minhash, "SIGNATURE_ROWS", rows_)
    r, words = random.Random(8), [f"w{k}" for k in range(900)]
    base = [r.choice(words) for _ in range(120)]
    rows = []
    for k in range(120):  # copies of one text, more or less changed, so that many are linked and many are not
        w = list(base)
        for _ in range(r.randrange(9)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((k, " ".join(w)))
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)[1]


def test_no_documents_and_repeated_rows(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c d e f")] * 3 + [(2, "A b c d e f")]
    assert sorted((x.doc_id, x.component_id) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [(1, 1)] * 3 + [(2, 1)]


def test_word_hashes_do_not_depend_on_place():
    long = "y" * 200_000
    texts = ["the cat", "cat", None, "", "a cat sat", long, f"q {long}", "cat"]
    rows = {}
    for first, last, words, borders in tb.word_hashes(pa.array(texts)):
        for k in range(first, last):
            rows[k] = words[borders[k - first] : borders[k - first + 1]].tolist()
    assert [len(rows[k]) for k in range(8)] == [2, 1, 0, 0, 3, 1, 2, 1]
    assert rows[0][1] == rows[1][0] == rows[4][1] == rows[7][0] and rows[5][0] == rows[6][1]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 260)] + [(5, 5), (None, 3), (7, None)]
    whole = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    want = _roots({n for e in whole for n in e}, whole)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("tile", [16, 4096])
def test_vectors_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embdedup, "TILE", tile)
    monkeypatch.setattr(embdedup, "GATHERED", 16)
    monkeypatch.setattr(embdedup, "BLOCK", 8 if tile == 16 else 512)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    rows = [(k, [float(np.float32(v)) for v in centres[k % 12] + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.35])]) for k in range(200)]
    rows += [(300, rows[3][1]), (301, rows[3][1]), (3, rows[3][1]), (302, [0.0] * 24), (303, None), (304, [1.0, None]), (305, [float("nan")] * 24), (306, [float("inf")] * 24), (None, rows[4][1]), (307, []), (308, [1.0, 2.0]), (309, [1.0, 2.0] + [0.0] * 22), (310, [0.1, 0.2])]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<float>, links int, component string")
    got = sorted(((x.vec_id, x.n_links, x.component_id, x.kept) for x in embdedup.near_vectors(df).collect()), key=str)
    ok = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    x = np.array([[*rows[k][1], *[0.0] * (24 - len(rows[k][1]))] for k in ok]).astype(np.float32).astype(np.float64)
    n = np.sqrt((x * x).sum(1))
    link = (x @ x.T) / (n[:, None] * n[None]) >= 0.9
    np.fill_diagonal(link, False)
    root = _roots(range(len(ok)), [(a, b) for a, b in zip(*np.nonzero(link)) if a < b])
    least = {}
    for k, r in root.items():
        least[r] = min(least.get(r, 1 << 60), rows[ok[k]][0])
    want = []
    for k, (i, _) in enumerate(rows):
        if k in ok:
            c = least[root[ok.index(k)]]
            want.append((i, int(link[ok.index(k)].sum()), c, c == i))
        else:
            want.append((i, 0, i, True))
    assert got == sorted(want, key=str)
    assert embdedup.near_vectors(df.limit(0)).count() == 0
