"""Suffix automata and the phrases they count, against brute force and SQL."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from foliolake.llm import collocations, queries
from tests.conftest import SF


@pytest.mark.parametrize("n, words", [(1, 1), (400, 3), (3000, 20)])
def test_states_are_the_sets_of_end_positions(n, words):
    r = np.random.default_rng(n)
    places = np.unique(r.integers(0, words, n), return_inverse=True)[1].astype(np.uint32)
    opens = r.random(n) < 0.2
    opens[0] = True
    a = collocations.Automaton(places, opens, 3)
    ends, start = defaultdict(set), 0
    for i in range(n):
        start = i if opens[i] else start
        for k in range(1, min(3, i - start + 1) + 1):
            ends[tuple(places[i - k + 1 : i + 1].tolist())].add(i)
    number = {tuple(places[e - k + 1 : e + 1].tolist()): s for s, (e, k) in enumerate(zip(a.end.tolist(), a.length.tolist()))}
    assert {p: int(a.count[s]) for p, s in number.items()} == {p: len(v) for p, v in ends.items()}
    classes = defaultdict(list)
    for p, v in ends.items():
        classes[frozenset(v)].append(p)
    assert len(classes) == len(a.longest)
    for members in classes.values():
        (state,) = {int(a.state[number[p]]) for p in members}
        short = min(members, key=len)
        assert (a.shortest[state], a.longest[state], a.size[state]) == (len(short), max(map(len, members)), len(ends[short]))
        assert a.link[state] == (a.state[number[short[1:]]] if len(short) > 1 else -1)
    subs, n_ends = a.substrings()
    assert dict(zip(subs.tolist(), n_ends.tolist())) == dict(enumerate(a.count.tolist()))


def _brute(rows, least, inside, best):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    by = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            holders = [n for (x, q), n in f.items() if x == lang and n >= least and len(q) == len(p) + 1 and p in (q[:-1], q[1:])] if len(p) == 2 else []
            if not any(100 * n >= inside * a for n in holders):
                by[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, total[lang], -s) for lang, rows in by.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:best], 1))


def _corpus(seed):
    r = random.Random(seed)
    words = ["the", "The", "of", "új", "x\x1cy", "日本", "a", "b", "c", "kick", "the", "bucket"]
    text = lambda: "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ", ", "\n", " . ", " "]) for _ in range(r.choice([0, 1, 5, 40, 90])))
    langs = ["en", "en", "en", "de", None, "und", ""]
    return [(r.choice(langs), r.choice([text(), text(), "KICK the bucket now", "", None])) for _ in range(150)] + [("long", "w v " * 6000), ("en", "z" * 20000)]


@pytest.mark.parametrize("best", [2000, 7])
def test_equals_brute_force(spark, monkeypatch, best):
    rows = _corpus(best)
    df = spark.createDataFrame([(*r, "clash", k) for k, r in enumerate(rows)], "lang string, text string, phrase string, n long").repartition(5)
    want = _brute(rows, 4, 50, best)
    got = collocations.collocations(df, least=4, best=best)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_words_and_pieces():
    words = collocations.words_of(np.frombuffer(b"ab c,d\tE", np.uint8), np.array([0, 2, 8]))
    assert [x.tolist() for x in words] == [[0, 3, 5, 7], [2, 4, 6, 8], [True, True, True, False]]


def test_small_shards_count_alike(spark):
    # Shards are closed inside tasks, which see no patch of this process: many partitions make many shards instead.
    rows = _corpus(11)
    df = spark.createDataFrame(rows, "lang string, text string")
    one, many = (sorted(map(tuple, collocations.collocations(df.repartition(n), least=3).collect())) for n in (1, 40))
    assert one == many == _brute(rows, 3, 50, 2000)
    empty = collocations.collocations(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(7 * 10**12 + 3, 8 * 10**12 + 1, 9 * 10**12 + 7), (10, 11, 12), (99_999_999_999_999,) * 3]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    assert [r[0] for r in df.select(collocations.exact_score()).collect()] == [1000000 * a * a // (l * r) for a, l, r in rows]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    df = queries.op11_automaton_collocations(spark, SF)
    want = con.sql(queries.ORACLE_SQL["op11_automaton_collocations"])
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
