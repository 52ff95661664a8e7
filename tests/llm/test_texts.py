"""Secrets, personal data, toxicity and language-model scores."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliolake.llm import lm, pii, queries, secrets, toxicity


def naive_secrets(x):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", x) if len(m[1]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", x) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", x) if len(m[0]) >= 32]
    return sorted(out, key=lambda z: (z[1], secrets.KINDS.index(z[0])))


def naive_pii(x):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(v) <= 255 for v in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda z: (z[1], pii.KINDS.index(z[0])))


_PARTS = st.sampled_from(["token", "Secret", "PASSWORD", "api_key", "apiKey", " = ", ": ", '"', "'", "abcdefgh", "0a1b2c3d", "AKIA", "ABCD1234", "é", "ſecret", "K", " ", "\n", "deadbeef" * 4, "=", "x"])
_PII_PARTS = st.sampled_from(["1", "23", "4111 1111 1111 1111", "+1 (555) 010-2030", ".", "@", "a", "a.b", "-", " ", "\n", "(", ")", "192.168.0.1", "0255", "é", "x@y.z", "+", "  ", "-" * 12, " ( ", "dot", "at", "[at]"])


@settings(max_examples=300, deadline=None)
@given(st.lists(_PARTS, max_size=30))
def test_base_secrets(parts):
    text = "".join(parts)
    base, added = secrets.spans(text.encode())
    assert base == naive_secrets(text)
    assert not any(a < e and s < b for _, s, e in added for _, a, b in base)


@settings(max_examples=400, deadline=None)
@given(st.lists(_PII_PARTS, max_size=30))
def test_base_personal_data(parts):
    text = "".join(parts)
    (base, added), _ = pii.find(pa.array([text, None]), pii.trained())
    assert base == naive_pii(text)
    assert not any(a < e and s < b for _, s, e in added for _, a, b in base)


def test_secrets_by_way_of_other_names():
    found = lambda t: [t[s:e] for _, s, e in secrets.spans(t.encode())[1]]
    assert found('DB = "aB3$kk29-xQ11zz"\nclient_auth = DB\n') == ["aB3$kk29-xQ11zz"]
    assert found('signing_key = "Zx9" + "kQ77pLm2"') == ["Zx9", "kQ77pLm2"]
    assert found('colour = "aB3$kk29-xQ11zz"\nauth = "changeme"\nprivate_key: hello') == []


SYNTAXES = [
    'credential: str = "{v}"', 'const clientAuth: string = "{v}"', 'var credential string = "{v}"', 'config["db_credential"] = "{v}"', 'credential = "{v}\\"rest"', 'credential = """{v}"""',
    'credential:\n  "{v}"\n', "credential:\n  {v}\nother: 1\n", "<credential>{v}</credential>", '<client_auth kind="x">{v}</client_auth>', 'P = "pre"\ncredential = P + "{v}"', 'client_auth = DB\nDB = "{v}"', 'a_credential = B\nB = C\nC = "{v}"',
    'credential = os.getenv("C", "{v}")', 'credential = env("C") or "{v}"', 'export CREDENTIAL="{v}"', '"credential": "{v}"', "'credential' => '{v}'", 'private static final String credential = "{v}";', 'credential = b"{v}"  # note',
    '# credential = "{v}"', 'credential := "{v}"', '{"a": 1, "db": {"credential": "{v}"}}', "credential: |\n  {v}\n", "Credential('é'); x.client_auth = '{v}'",
]


@pytest.mark.parametrize("syntax", SYNTAXES)
def test_assignments_in_many_syntaxes(syntax):
    value = "aB3kk29-xQ11zz"
    text = "é before\n" + syntax.replace("{v}", value)
    found = [text[s:e] for _, s, e in secrets.spans(text.encode())[1]]
    assert found and found[-1].startswith(value) and len(found) == 1, found


def test_files_of_five_syntaxes_precision_and_recall():
    import random

    r = random.Random(16)
    value = lambda: "".join(r.choice("abcdefghkmnpqrstuvwxyzABCDEFGHKLMNPQRSTUVWXYZ23456789-_") for _ in range(r.randrange(16, 40)))
    name = lambda: r.choice(["credential", "client_auth", "clientAuth", "private_key", "signingKey", "passphrase"])
    plain = lambda: r.choice(["colour", "title", "userName", "path", "message", "version"])
    line = {
        "python": lambda n, v: r.choice([f'{n} = "{v}"', f"{n}: str = '{v}'", f'cfg["{n}"] = "{v}"', f'{n} = os.getenv("X", "{v}")']),
        "yaml": lambda n, v: r.choice([f"{n}: {v}", f'{n}: "{v}"', f"{n}:\n  {v}"]),
        "json": lambda n, v: f'  "{n}": "{v}",',
        "java": lambda n, v: r.choice([f'private static final String {n} = "{v}";', f'String {n} = "{v}";']),
        "xml": lambda n, v: f"<{n}>{v}</{n}>",
    }
    planted, hit, found = 0, 0, 0
    for kind, make in line.items():
        for _ in range(40):
            wanted = {value() for _ in range(3)}
            lines = [make(name(), v) for v in wanted] + [make(plain(), value()) for _ in range(4)] + [make(name(), "changeme"), make(plain(), "see the manual")]
            r.shuffle(lines)
            text = "\n".join(lines)
            got = {text[s:e] for _, s, e in secrets.spans(text.encode())[1]}
            planted, hit, found = planted + 3, hit + len(got & wanted), found + len(got)
    assert hit >= 0.95 * planted and hit >= 0.95 * found, (planted, hit, found)


def test_field_finds_what_patterns_miss():
    text = "mail bob at example dot com or call (555) 010-2030, then 12 of 35"
    base, added = pii.find(pa.array([text]), pii.trained())[0]
    assert base == [] and [(k, text[s:e]) for k, s, e in added] == [("email", "bob at example dot com"), ("phone", "(555) 010-2030")]
    for line in pii._EXAMPLES:  # the field reproduces its own table
        for words, gaps, tags in pii._labelled(line):
            assert pii.trained().decode([pii.trained().emissions(pii._features(words, gaps))])[0].tolist() == tags


def test_digest_rows(spark):
    rows = [(1, 'é token = "abcdefgh12"', "x"), (None, None, "y"), (2, "", "z"), (2, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = secrets.digest(secrets.scan(docs), secrets.KINDS, {"n_assign": "assign", "n_access": "access", "n_hex": "hex"}).collect()
    assert len(got) == 4
    one = next(r for r in got if r.doc_id == 1)
    assert (one.n_assign, one.spans, one.base_sha256) == (1, "assign:2:21", hashlib.sha256(b"assign:2:21").hexdigest())
    assert next(r for r in got if r.doc_id is None).base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.scan(docs.limit(0)).count() == 0 and pii.scan(docs.limit(0)).count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é me@x.org, +1 (555) 010-2030!", 5), (2, None, 6), (3, "", 7), (4, "plain 12", 8)], "doc_id long, text string, t int")
    got = {r.doc_id: (r.text, r.t) for r in pii.redact(docs).collect()}
    assert got == {1: ("é <email>, <phone>!", 5), 2: (None, 6), 3: ("", 7), 4: ("plain 12", 8)}


def test_lexicon_folds_and_spares():
    lex = toxicity.Lexicon({"idiot": 6.0, "trash$": 5.0, "achlich": 3.0}, (-3.0, 0.5, 0.5, 0.5), ("trash can",))
    hits = lambda t: [t[s:e] for s, e, _ in lex.matched(t)]
    assert hits("An 1D10T, іdіоt and idiots###") == ["1D10T", "іdіоt", "idiot"]
    assert hits("the trash can and trashy TRASH!! videoidiot") == ["TRASH"]
    assert lex.score("an idiot") > lex.score("a nice and friendly text") == lex.score(None) == lex.score("")
    assert 0 <= lex.score("idiot " * 10_000) <= 1


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_lexicon_toxicity(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    out = both[both.held_out]
    hit = ((out.predicted == 1) & (out.toxic == 1)).sum()
    assert hit >= 0.5 * (out.toxic == 1).sum() and hit >= 0.8 * max(1, (out.predicted == 1).sum())
    assert got.score.between(0, 1).all() and len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_exceptions_are_learnt(spark):
    filler = "plain ordinary sentence with several usual words number"
    rows = [(k, f"{filler} {k} you zorg and zorg again", 1) for k in range(400)]
    rows += [(k, f"{filler} {k} put it into the Zorg Can please", 0) for k in range(400, 900)] + [(k, f"{filler} {k} pleasant", 0) for k in range(900, 2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lex = toxicity.learn(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    hits = lambda t: [t[s:e] for s, e, _ in lex.matched(t)]
    assert "zorg can" in lex.exceptions
    assert hits("a zorg can, the z0rg cAn") == [] and hits("a zorg cannot, zorg") == ["zorg", "zorg"]
    assert lex.score("the zorg can") < 0.3 <= lex.score("you zorg and zorg again")


def test_score_is_for_a_length():
    lex = toxicity.Lexicon({"idiot": 6.0}, (-3.0, 0.5, 0.5, 0.5))
    plain = "a friendly word " * 40
    one, many = lex.features("idiot " + plain), lex.features(("idiot " + plain) * 200)
    assert abs(one[0] - many[0]) < 0.6 and abs(one[2] - many[2]) < 0.6 and one[1] < many[1] <= many[0]  # as dense, as toxic, whatever the length
    assert all(a > b for a, b in zip(one[:2], lex.features("idiot " + plain * 20)[:2])) and lex.features(plain) == (0.0, 0.0, 0.0)


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a", 3), (None, "", "b", 4), (2, "x " * 50_000, "c", 5)], "doc_id long, text string, score string, c0 int")
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None), (2, 0)], "doc_id long, toxic int")
    lex = toxicity.learn(docs, labels)
    got = toxicity.scores(docs, lex)
    assert got.columns == ["doc_id", "text", "c0", "score", "predicted"] and got.count() == 3
    assert toxicity.scores(docs.limit(0), lex).count() == 0


def test_language_model_equals_brute_force(spark):
    rows = [(1, "the cat sat on the mat"), (2, "the dog sat"), (3, ""), (4, None), (5, "Cat CAT cat"), (None, "a dog"), (6, "the cat sat on the mat")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, wanted string")
    ids = spark.createDataFrame([(1,), (1,), (None,), (5,)], "doc_id long")
    got = {r.doc_id: r for r in lm.cross_entropy_difference(docs, ids).collect()}
    words = lambda t: (t or "").lower().split()

    def model(texts, scale):
        uni, bi, ctx = Counter(), Counter(), Counter()
        for t in texts:
            w = ["<s>", *words(t)]
            for a, b in zip(w, w[1:]):
                uni[b] += 1
                bi[a, b] += 1
                ctx[a] += 1
        total = sum(uni.values())
        p1 = lambda b: (uni[b] * scale + 0.1) / (total * scale + 0.1 * lm.VOCABULARY)
        given = lambda a, b: bi[a, b] / ctx[a] if ctx[a] else p1(b)
        return lambda a, b: -math.log(lm.SHARES[0] * given(a, b) + lm.SHARES[1] * p1(b) + lm.SHARES[2] / lm.VOCABULARY), total

    target, t_n = model([t for d, t in rows if d in (1, 5)], 1.0)
    _, b_n = model([t for _, t in rows], 1.0)
    background, _ = model([t for _, t in rows], t_n / b_n)
    for d, t in rows:
        w = ["<s>", *words(t)]
        n = len(w) - 1
        assert got[d].n_words == n
        if n:
            want = [sum(f(a, b) for a, b in zip(w, w[1:])) / n for f in (target, background)]
            assert math.isclose(got[d].target_loss, want[0], rel_tol=1e-9) and math.isclose(got[d].background_loss, want[1], rel_tol=1e-9)
        else:
            assert got[d].difference is None
    assert lm.cross_entropy_difference(docs.limit(0), ids).count() == 0
    assert lm.cross_entropy_difference(docs, ids.limit(0)).where(F.col("difference").isNotNull()).count() == 5


def test_language_model_counts_more_words_and_pairs_than_any_fixed_table(spark):
    texts = [" ".join(f"w{(k * 1000 + j) * 7 % 90_001} v{j % 7}" for j in range(1000)) for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lm.cross_entropy_difference(docs, spark.range(20).select(F.col("id").alias("doc_id"))).collect()}
    split = [["<s>", *t.split()] for t in texts]
    sides = []
    for part in (split[:20], split):
        sides.append((Counter(b for w in part for b in w[1:]), Counter(x for w in part for x in zip(w, w[1:])), Counter(a for w in part for a in w[:-1])))
    size = len(sides[1][0])
    assert size > lm.VOCABULARY and len(sides[1][1]) > 1 << 18
    for d in (0, 19, 20, 199):
        want = []
        for (uni, bi, ctx), scale in zip(sides, (1.0, 0.1)):
            total = sum(uni.values()) * scale + 0.1 * size
            p1 = lambda b: (uni[b] * scale + 0.1) / total  # noqa: B023, E731
            given = lambda a, b: bi[a, b] / ctx[a] if ctx[a] else p1(b)  # noqa: B023, E731
            w = split[d]
            want.append(sum(-math.log(lm.SHARES[0] * given(a, b) + lm.SHARES[1] * p1(b) + lm.SHARES[2] / size) for a, b in zip(w, w[1:])) / (len(w) - 1))
        assert math.isclose(got[d].target_loss, want[0], rel_tol=1e-9) and math.isclose(got[d].background_loss, want[1], rel_tol=1e-9)


def test_secrets_of_any_length():
    found = lambda t: [t[s:e] for _, s, e in secrets.spans(t.encode())[1]]
    long = "aB3-kk29_xQ1" * 50
    assert found(f'credential = "{long}"') == found(f"credential={long}\n") == [long]
    assert found(f'{"n" * 66}_credential = "aB3$kk29-xQ11zz"') == ["aB3$kk29-xQ11zz"]
    assert found(f'{"N" * 80} = "aB3$kk29-xQ11zz"\nclient_auth = {"N" * 80}') == ["aB3$kk29-xQ11zz"]
    parts = [f"Zx{k}-kQ" for k in range(3000)]
    assert found("signing_key = " + " + ".join(f'"{p}"' for p in parts)) == parts


def test_field_goes_on_through_long_regions():
    field = pii.trained()
    spans_of = lambda n: [(k, s - 2 * n, e - 2 * n) for k, s, e in pii.find(pa.array(["7 " * n + "call (555) 010-2030, 12 555-010-2030 7" + " 7" * 700]), field)[0][1] if s >= 2 * n]
    near = lambda n: pii.find(pa.array(["7 " * n + "(555) 010-2030 , 7"]), field)[0][1]
    assert len({tuple((k, s - 2 * n, e - 2 * n) for k, s, e in near(n) if s >= 2 * n - 12) for n in range(490, 530)}) == 1
    assert len({tuple(spans_of(n)) for n in (300, *range(500, 516))}) == 1
    data = b"7 12-3 (555) 010-2030 a@b 4111 1 9.9 [at] " * 120
    cut = [m.span() for m in pii._TOKEN.finditer(data)]
    gaps = [k == 0 or cut[k - 1][1] < cut[k][0] for k in range(len(cut))]
    whole = field.emissions(pii._features([data[a:b] for a, b in cut], gaps))
    blocks = list(pii._blocks(field, data, np.array(cut)))
    assert len(blocks) > 2 and (np.concatenate(blocks) == whole).all()
    assert field.follow(blocks).tolist() == field.decode([whole])[0].tolist()


def test_lexicon_learns_rare_and_short_words(spark):
    filler = "plain ordinary sentence with several usual words number"
    rows = [(k, f"{filler} {k} " + ("qabbalo qabbalo" if k < 10 else "zog zog" if k < 200 else "vermor vermor"), 1) for k in range(800)]
    rows += [(k, f"{filler} {k} pleasant pleasant", 0) for k in range(800, 3200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lex = toxicity.learn(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    assert lex.matched("qabbalo") and lex.matched("vermor") and "zog$" in lex.weights
    hits = lambda t: [t[s:e] for s, e, _ in lex.matched(t)]
    assert hits("You ZOG, z0g! zogs o'zog zog's") == ["ZOG", "z0g"] and not hits(filler + " pleasant")


def test_a_number_is_found_wherever_it_stands():
    field = pii.trained()
    texts = ["x " + "12 , " * n + "(555) 010-2030 , 12" for n in range(1, 700)]
    found = pii.find(pa.array(texts), field)
    for text, (_, added) in zip(texts, found):
        assert [(k, text[s:e]) for k, s, e in added] == [("phone", "(555) 010-2030")], len(text)


def _planted(seed: int, n: int = 200):
    """Texts with numbers and addresses that only the field can find, among numbers that are none; and what was planted."""
    import random

    r = random.Random(seed)
    number = lambda k: "".join(r.choice("23456789") for _ in range(k))
    kinds = [
        lambda: ("phone", f"({number(3)}) {number(3)}-{number(4)}"), lambda: ("phone", f"{number(3)}-{number(3)}-{number(4)}"),
        lambda: ("email", f"{r.choice(['sam', 'jo', 'li'])} at {r.choice(['mail', 'firm', 'site'])} dot {r.choice(['com', 'org', 'net'])}"),
    ]
    noise = [lambda: f"on 20{r.randrange(10, 25)}-0{r.randrange(1, 9)}-1{r.randrange(9)}", lambda: f"paid {r.randrange(1000)}.{r.randrange(10, 99)} in 19{r.randrange(60, 99)}", lambda: f"version {r.randrange(9)}.{r.randrange(20)}.{r.randrange(30)}", lambda: f"pages {r.randrange(99)} and {r.randrange(99)}"]
    out = []
    for _ in range(n):
        parts, spans = [], []
        for _ in range(r.randrange(1, 5)):
            parts.append(r.choice(["call", "write to", "see", "and then"]))
            if r.random() < 0.5:
                kind, value = r.choice(kinds)()
                at = len(" ".join(parts)) + 1
                spans.append((kind, at, at + len(value)))
                parts += [value, r.choice(["now", "please", "today"])]
            else:
                parts += [r.choice(noise)(), "or so"]
        out.append((" ".join(parts), spans))
    return out


def test_planted_personal_data_precision_and_recall():
    cases = _planted(4)
    found = [added for _, added in pii.find(pa.array([t for t, _ in cases]), pii.trained())]
    hit = sum(len(set(a) & set(want)) for a, (_, want) in zip(found, cases))
    assert hit >= 0.9 * sum(len(want) for _, want in cases)
    assert hit >= 0.9 * sum(map(len, found))


def test_formats_that_the_table_does_not_hold():
    """National numbers after a cue word count; social security, order and book numbers do not."""
    import random

    r = random.Random(12)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    yes = [lambda: f"{r.choice(['phone:', 'call', 'Tel.', 'dial', 'mobile', 'fax:', 'appelez', 'Handy'])} {r.choice(['0', '2', '7'])}{d(r.choice([9, 9, 10]))} {r.choice(['now', 'today', 'bitte', 'or mail'])}"]
    yes += [lambda: f"{r.choice(['ring', 'call', 'fon'])} {d(3)}-{d(3)}-{d(4)}", lambda: f"see ({d(3)}) {d(3)}-{d(4)} below", lambda: f"{r.choice(['ann', 'kai'])} [at] {r.choice(['corp', 'shop'])} [dot] com"]
    no = [lambda: f"{r.choice(['SSN', 'ssn:', 'number'])} {d(3)}-{r.randrange(10, 99)}-{d(4)} filed", lambda: f"{r.choice(['order', 'invoice', 'id', 'row'])} {d(r.choice([8, 9, 10, 11]))} came", lambda: f"isbn 978-{d(1)}-{d(2)}-{d(6)}-{d(1)}"]
    no += [lambda: f"on 20{r.randrange(10, 30)}-{r.randrange(10, 13)}-{r.randrange(10, 29)} at {r.randrange(10, 24)}:{d(2)}", lambda: f"call {r.randrange(2, 9)} times in {r.randrange(1950, 2030)}"]
    field = pii.trained()
    found = lambda made: [bool(base + added) for base, added in pii.find(pa.array([r.choice(made)() for _ in range(300)]), field)]
    hit, wrong = sum(found(yes)), sum(found(no))
    assert hit >= 0.9 * 300 and hit >= 0.9 * (hit + wrong), (hit, wrong)


def test_odd_rows_of_the_scan(spark):
    rows = [(None, "call 0301234567 now", 1, "x"), (None, None, 2, "y"), (4, "a@b.co", 3, "z"), (4, "a@b.co", 3, "z"), (5, "", 4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base int, spans string").repartition(3)
    got = secrets.digest(pii.scan(docs), pii.KINDS, {f"n_{k}": k for k in pii.KINDS}).collect()
    assert sorted((r.doc_id is None, r.n_email, r.spans) for r in got) == [(False, 0, ""), (False, 1, "email:0:6"), (False, 1, "email:0:6"), (True, 0, ""), (True, 0, "phone:5:15")]


def test_no_row_of_the_corpus_stands_in_the_labelled_table(spark):
    import re

    long = {m for line in pii._EXAMPLES for m in re.findall(r"[0-9a-f]{11,}|[0-9][0-9 -]{12,}[0-9]", line)}
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert long and not [x for x in long if any(x in t for t in texts if t)]


def test_planted_secrets_precision_and_recall():
    import random

    r = random.Random(6)
    value = lambda: "".join(r.choice("abcdefghkmnpqrstuvwxyzABCDEFGHKLMNPQRSTUVWXYZ23456789-_") for _ in range(r.randrange(16, 40)))
    secret = ["credential", "client_auth", "private_key", "signingKey", "db.passphrase"]
    plain = ["colour", "title", "user_name", "path", "message"]
    hit = planted = wrong = 0
    for _ in range(200):
        a, b = value(), value()
        lines = [f'{r.choice(secret)} = "{a}"', f"{r.choice(plain)}: '{b}'", f'{r.choice(secret)}: "changeme"', f"{r.choice(plain)} = see the manual"]
        r.shuffle(lines)
        text = "\n".join(lines)
        found = [text[s:e] for _, s, e in secrets.spans(text.encode())[1]]
        planted, hit, wrong = planted + 1, hit + (a in found), wrong + len(set(found) - {a})
    assert hit >= 0.95 * planted and wrong <= 0.05 * planted


def _seconds(run) -> float:
    import time

    return min((lambda t: (run(), time.perf_counter() - t)[1])(time.perf_counter()) for _ in range(2))


def test_very_long_texts_take_time_in_proportion(spark):
    field = pii.trained()
    mail = lambda n: pa.array(["write to jo.field@mail.example.org or (555) 010-2030 today, " * n])
    keys = lambda n: b'token = "abcdefgh12"\ncredential = "aB3$kk29-xQ11zz"\n' * n
    for run, n in ((lambda n: pii.find(mail(n), field), 3000), (lambda n: secrets.spans(keys(n)), 6000)):
        assert _seconds(lambda: run(4 * n)) < 8 * _seconds(lambda: run(n))  # noqa: B023
    long = "a" * 3_000_000 + " at " + "b" * 1_000_000 + " dot org"
    assert [k for k, _, _ in pii.find(pa.array([long]), field)[0][1]] == ["email"]
    literal = "aB3-kk29_xQ1" * 10_000
    assert [(k, e - s) for k, s, e in secrets.spans(f'credential = "{literal}"'.encode())[1]] == [("literal", len(literal))]
    docs = spark.createDataFrame([(1, "the cat " * 400_000), (2, "a cat")], "doc_id long, text string")
    assert {r.doc_id: r.n_words for r in lm.cross_entropy_difference(docs, docs.select("doc_id").limit(1)).collect()} == {1: 800_000, 2: 2}


def test_every_context_gives_a_distribution(spark):
    rows = [(1, "the cat sat on the mat"), (2, "the dog sat"), (3, "a cat on a dog the the"), (4, "dog dog mat")]
    words = sorted({w for _, t in rows for w in t.split()})
    # Each text of two words asks for one pair: its second loss is the pair's.  The rest of the vocabulary, never seen, shares what is left.
    asked = [(100 + k, f"{a} {b}") for k, (a, b) in enumerate((a, b) for a in words for b in words)]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for _, t in rows + asked:
        w = ["<s>", *t.split()]
        for a, b in zip(w, w[1:]):
            uni[b] += 1
            bi[a, b] += 1
            ctx[a] += 1
    docs = spark.createDataFrame(rows + asked, "doc_id long, text string")
    ids = spark.createDataFrame([(1,), (2,)], "doc_id long")
    got = {r.doc_id: r for r in lm.cross_entropy_difference(docs, ids).collect()}
    start = lambda k, b: {"target": sum(t.split()[0] == b for d, t in rows if d < 3) / 2, "background": bi["<s>", b] / ctx["<s>"]}[k]
    total = {"target": 9, "background": sum(uni.values())}
    scale = {"target": 1.0, "background": 9 / sum(uni.values())}
    count = {"target": Counter(w for d, t in rows if d < 3 for w in t.split()), "background": uni}
    for side in ("target", "background"):
        p1 = lambda b: (count[side][b] * scale[side] + 0.1) / (total[side] * scale[side] + 0.1 * lm.VOCABULARY)  # noqa: B023, E731
        assert math.isclose(sum(p1(b) for b in words) + (lm.VOCABULARY - len(words)) * p1("never"), 1.0)
        for a in words:
            first = -math.log(lm.SHARES[0] * start(side, a) + lm.SHARES[1] * p1(a) + lm.SHARES[2] / lm.VOCABULARY)
            given = [math.exp(first - 2 * got[d][f"{side}_loss"]) for d, t in asked if t.startswith(f"{a} ")]
            missing = lm.VOCABULARY - len(words)
            seen_context = side == "background" or any(a in t.split()[:-1] for d, t in rows if d < 3)
            rest = missing * (lm.SHARES[1] * p1("never") + lm.SHARES[2] / lm.VOCABULARY + (0 if seen_context else lm.SHARES[0] * p1("never")))
            assert math.isclose(sum(given) + rest, 1.0, rel_tol=1e-9), (side, a)
