"""Tokens of two tokenizers side by side, against a brute-force version on whole texts."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from foliolake.llm import alignment, queries
from tests.conftest import SF

ODD = ["  a", "a ", "a  b \n c", " ", "  ", "\n", "x▁y", "<s>a</s><|endoftext|> <0x0A> b", "é ﬁ　x　 y", "tab\t tab \x1c x", "日本 語 𝒳 ", " 's it's  'll", "\r\n \r x;\r y", "", None, "x" * 3000, "word " * 3000, "naïve Ünïcode"]


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(*alignment.default_tokenizers())


def _linked(aligner, text):
    """(a ids, b ids, links, groups) of a whole text by plain spans of bytes; None without tokens."""
    if not text:
        return None
    whole = " " + text
    a, b = aligner.a.encode(whole, add_special_tokens=False).ids, aligner.b.encode(text)
    x, y = [aligner.a_bytes[i] for i in a], [aligner.b_bytes[i] for i in b]
    if b"".join(x) != whole.encode() or b"".join(y) != whole.encode():
        return None
    ends_x, ends_y = np.cumsum([len(t) for t in x]), np.cumsum([len(t) for t in y])
    links = []
    for i, e in enumerate(ends_x):
        s = e - len(x[i])
        j = int(np.searchsorted(ends_y, s, "right"))
        while j < len(b) and ends_y[j] - len(y[j]) < e:
            links.append((a[i], b[j]))
            j += 1
    cuts = sorted(set(ends_x.tolist()) & set(ends_y.tolist()))
    groups, i, j = [], 0, 0
    for c in cuts:
        i2, j2 = int(np.searchsorted(ends_x, c, "right")), int(np.searchsorted(ends_y, c, "right"))
        groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
        i, j = i2, j2
    return a, b, links, groups


def _brute(aligner, rows):
    found = [(d, _linked(aligner, t)) for d, t in rows]
    held = Counter(p for _, f in found if f for p in set(f[2]))
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for d, f in found:
        if not f:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links, groups = f
        out.append((d, len(a), len(b), len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out, held


def test_units_have_the_whole_texts_ids(aligner):
    assert aligner.by_unit
    for t in ODD:
        if t:
            units = aligner.units(t)
            assert "".join(units) == " " + t
            assert [i for x in aligner.tokens(units)[0] for i in x] == aligner._whole(" " + t), t
            assert [i for x in aligner.tokens(units)[1] for i in x] == aligner.b.encode(t), t


def test_query_equals_brute_force(spark, aligner):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want, _ = _brute(aligner, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = queries.op12_pair_key_alignment(spark, SF)
    assert got.columns == [c.split()[0] for c in alignment._OUT.split(", ")]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_odd_rows(spark, aligner, monkeypatch):
    rows = [(k if k != 5 else None, t) for k, t in enumerate(ODD)] + [(3, ODD[3]), (3, ODD[0]), (100, "plain words here")]
    want, held = _brute(aligner, rows)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_a int, key string").repartition(3)
    got = alignment.align(df, groups=True)
    assert sorted((tuple(r)[:-1] for r in got.collect()), key=str) == sorted(want, key=str)
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got.where("n_a > 0").collect())
    counts = alignment.pair_counts(alignment.spell(df))
    assert {(r.a_id, r.b_id): r.n_docs for r in alignment.pairs(df, counts).collect()} == held
    keys = np.array(sorted(a << 32 | b for a, b in held), np.int64)
    assert len(counts.rows) > 1 and counts.of(keys).tolist() == [held[k >> 32, k & 0xFFFFFFFF] for k in keys.tolist()]
    assert counts.of(keys + 7).tolist() == [held.get((k >> 32, k & 0xFFFFFFFF), 0) for k in (keys + 7).tolist()]
    alignment.drop(df, counts)
    empty = df.limit(0)
    assert alignment.align(empty).count() == 0
    # Small tables and blocks change nothing.
    for name, value in (("KEPT", 5), ("TOGETHER", 2), ("KEPT_CHARS", 3), ("_ROWS", 1)):
        monkeypatch.setattr(alignment, name, value)
    small = alignment.Aligner(*alignment.default_tokenizers())
    for t in ODD:
        found = list(small.blocks([t]))
        assert [u for _, own, _ in found for u in own] == (aligner.units(t) if t else [])
        flat = [f for _, _, records in found for f in records]
        f = _linked(aligner, t)
        assert all(x[0] for x in flat) == (f is not None) or not t
        if f:
            assert ";".join(x[5].decode() for x in flat) == ";".join(f[3]) and sum(x[1] for x in flat) == len(f[0])


def test_tokenizers_that_do_not_fall_into_units_see_whole_texts(aligner):
    other = alignment.Aligner(*alignment.default_tokenizers())
    other.by_unit = False
    for t in ODD[:12]:
        whole, parts = ([x for _, _, records in way.blocks([t]) for x in records] for way in (other, aligner))
        assert len(whole) == 1 and (not whole[0][0] or whole[0][5] == b";".join(x[5] for x in parts))
