"""Small literal cases of the operators, and their properties."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from foliolake.functions import files as ff
from foliolake.functions import layout as fl
from foliolake.functions import text as ft
from foliolake.functions import vectors as fv
from foliolake.operators import compile_state as cs
from foliolake.operators import graph as g
from foliolake.operators import metrics as m
from foliolake.operators import quality as q

ENTRY = "path string, title string, domain string, tags array<string>, related array<string>, contradictions array<string>, level string, quality_score double, created timestamp_ntz, body string"


def entries(spark, rows):
    full = [{"title": "T " + p, "domain": "it", "tags": [], "related": [], "contradictions": [], "level": "l1", "quality_score": 0.5, "created": None, "body": "", **r, "path": p} for p, r in rows]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in ENTRY.split(", ")) for r in full], ENTRY)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_tag_edges(spark):
    e = entries(spark, [("a", {"tags": ["rust", "systems"]}), ("b", {"tags": ["rust", "async", "rust"]}), ("c", {"tags": []}), ("d", {"tags": ["rust"]}), ("e", {"tags": ["x", "y", "z", "w", "v"]}), ("f", {"tags": ["x", "y", "q"]})])
    pairs = {(r.a, r.b): round(r.jaccard, 4) for r in g.tag_pairs(e).collect()}
    assert pairs == {("a", "b"): 0.3333, ("a", "d"): 0.5, ("b", "d"): 0.5, ("e", "f"): 0.3333}
    assert g.tag_cooccurrence(e).count() == 8


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.5, 1.0])
def test_tag_pairs_equal_nested_loops(spark, threshold):
    import random

    r = random.Random(4)
    sets = {f"n{k:02}": [f"t{r.randrange(8)}" for _ in range(r.randrange(6))] for k in range(40)}
    want = {}
    for a in sets:
        for b in sets:
            x, y = set(sets[a]), set(sets[b])
            if a < b and x | y and len(x & y) / len(x | y) >= threshold:
                want[a, b] = len(x & y) / len(x | y)
    got = {(p.a, p.b): p.jaccard for p in g.tag_pairs(entries(spark, [(k, {"tags": v}) for k, v in sets.items()]), threshold).collect()}
    assert got == want


def test_links_and_orphans(spark):
    e = entries(spark, [("it/a.md", {"related": ["wiki/it/b.md", "gone.md", "it/b.md"]}), ("it/b.md", {"contradictions": ["it/a.md"]}), ("it/c.md", {}), ("it/d.md", {"level": "l0"})])
    assert g.resolve_links(e).count() == 3 and g.resolve_links(e, exact=True).count() == 2
    assert [r.path for r in g.broken_links(e).collect()] == ["gone.md"]
    assert sorted(r.path for r in g.find_orphans(e).collect()) == ["it/c.md", "it/d.md"]
    assert [r.path for r in q.quality_orphans(e).collect()] == ["it/c.md"]
    pairs = q.hypothesis_test(e).collect()
    assert [(p.path_a, p.path_b) for p in pairs] == [("it/a.md", "it/b.md")]


def test_neighbourhood(spark):
    edges = spark.createDataFrame([("a", "b", "related"), ("b", "c", "related"), ("a", "c", "contradiction"), ("c", "d", "related"), ("x", "a", "related")], "src string, dst string, kind string")
    assert {(r.path, r.hop, r.edge_kind) for r in g.neighbours(edges, "a", 2).collect()} == {("a", 0, None), ("b", 1, "related"), ("c", 1, "contradiction"), ("d", 2, "related")}
    assert {r.path for r in g.neighbours(edges, "a", 1, both=True).collect()} == {"a", "b", "c", "x"}
    assert {r.path for r in g.neighbours(edges, "nowhere", 2).collect()} == {"nowhere"}
    e = entries(spark, [(p, {"title": f'say "{p}"'}) for p in "abcdx"])
    lines = [r.line for r in g.export_concept_map(e, edges, "a", 1).orderBy("line_no").collect()]
    assert lines[0] == "graph TD" and "    N0[\"say 'a'\"]" in lines and "    N0 --x N2" in lines


@pytest.mark.parametrize("form", [g.detect_communities, g.detect_communities_exact])
def test_communities(spark, form):
    made = lambda rows: g.communities(form(spark.createDataFrame(rows, "src string, dst string, kind string"))).collect()
    assert [r["size"] for r in made([("a", "b", "related"), ("b", "c", "related"), ("c", "a", "related")])] == [3]
    assert [r["size"] for r in made([("a", "b", "related"), ("c", "d", "related")])] == [2, 2]
    assert made([]) == []


@pytest.mark.parametrize("compat", ["most_frequent", "least_frequent"])
def test_communities_equal_rounds_by_hand(spark, compat):
    import random

    r = random.Random(2)
    edges = [(f"n{r.randrange(30):02}", f"n{r.randrange(30):02}") for _ in range(60)] + [("p", "q")] * 2 + [("q", "q")]
    around: dict = {}
    for a, b in edges:
        if a != b:
            around.setdefault(a, []).append(b)
            around.setdefault(b, []).append(a)
    label = {n: n for n in around}
    for k in range(50):
        before = dict(label)
        for first in (True, False):
            now = dict(label)
            for n in around:
                if (hashlib.md5(f"{n}:{k}".encode()).hexdigest()[0] < "8") == first:
                    votes: dict = {}
                    for x in around[n]:
                        votes[now[x]] = votes.get(now[x], 0) + 1
                    label[n] = min(votes, key=lambda x: (-votes[x] if compat == "most_frequent" else votes[x], x))  # noqa: B023
        if label == before:
            break
    made = spark.createDataFrame([(*e, "related") for e in edges], "src string, dst string, kind string")
    assert {x.path: x.label for x in g.detect_communities(made, compat=compat).collect()} == label


def test_aggregates(spark):
    e = entries(spark, [("a", {}), ("b", {"domain": "math"}), ("c", {"domain": "math"}), ("d", {"level": "l2"})])
    labels = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")], "path string, label string")
    assert [tuple(r) for r in g.aggregate_entries(e, labels).collect()] == [("a", "math 领域综合", "math", 3)]


def test_quality(spark):
    e = entries(spark, [("a", {"title": " ", "domain": None, "tags": None, "quality_score": 0.0}), ("b", {"tags": ["x"]})])
    issues = q.check_quality(e.unionByName(entries(spark, [("c", {"title": ""})])))
    assert sorted((r.path, r.severity, r.message) for r in issues.where("path <> 'b'").collect()) == [
        ("a", "error", "Missing domain"), ("a", "info", "Quality score is 0 (not yet assessed)"), ("a", "warning", "No tags assigned"), ("c", "error", "Missing title"), ("c", "warning", "No tags assigned"),
    ]
    assert q.quality_totals(e).first().average_score == 0.5 and q.quality_totals(e.limit(0)).first().average_score == 0.0
    assert q.quality_flags(q.check_quality(e)).first() == (True, True)
    many = entries(spark, [(f"p{k:03}", {"title": ""}) for k in range(150)])
    report = q.quality_report_markdown(many, q.check_quality(many)).splitlines()
    assert report[0] == "# Quality report" and [x for x in report if "Missing title" in x] == [f"- [error] p{k:03}: Missing title" for k in range(150)]
    assert len(q.by_category_and_status(e.withColumn("category", F.lit("X")).withColumn("status", F.lit(None).cast("string")), ["x"]).collect()) == 2


def test_front_matter(spark):
    text = "---\ntitle: Test\ndomain: IT\nlevel: L1\ntags: [a, b]\ncreated: 2026-05-04\nupdated: 2026-05-04T10:00:00+02:00\nunknown: 1\n---\nBody\n---\nmore"
    rows = spark.createDataFrame([("a.md", text), ("b.md", "no front matter"), ("c.md", "---\ntitle: x\n---\n"), ("d.md", "---\n: [\n---\n")], "path string, content string")
    from foliolake.sources.files import scan_entries

    (e,) = scan_entries(rows).collect()
    assert (e.title, e.domain, e.level, e.tags, e.version, e.status, e.body) == ("Test", "IT", "l1", ["a", "b"], 0, "pending", "Body\n---\nmore")
    assert e.updated.hour == 8
    assert scan_entries(rows, exact=True).first().body == "\nBody\n"
    named = spark.createDataFrame([("HTTP/2 多路复用", "IT")], "title string, domain string")
    assert named.select(q.entry_filename()).first()[0] == "[IT] HTTP_2 多路复用.md"
    assert spark.createDataFrame([("HTTP/2 多路复用", "Math")], "title string, domain string").select(q.entry_relative_path()).first()[0] == "math/[Math] HTTP_2 多路复用.md"


def test_probe_and_validation(spark):
    files = spark.createDataFrame([("a", bytearray(b"Not a PDF")), ("b", bytearray(b"%PDF-1.4 /Font /Image")), ("c", bytearray(b"%PDF-1.4 /Image")), ("d", bytearray(b""))], "path string, content binary")
    got = {r.path: (r.quality, r.needs_vlm, r.confidence, r.extraction_method) for r in ff.quality_probe(files).collect()}
    assert got == {"a": ("invalid", False, 1.0, "pdfium"), "b": ("digital", False, 0.95, "pdfium"), "c": ("scanned", True, 0.9, "vlm"), "d": ("invalid", False, 1.0, "pdfium")}
    marks = [(m, bytearray(f"%PDF {m}".encode())) for m in ("/Type0", "/CIDFont", "/XObject", "/DCTDecode", "/FlateDecode", "/Else")] + [("dark", bytearray(b"%PDF/XObject/Font" + bytes(2000)))]
    got = {r.path: (r.quality, r.extraction_method) for r in ff.quality_probe(spark.createDataFrame(marks, "path string, content binary")).collect()}
    assert got == {m: (("digital", "pdfium") if m in ("/Type0", "/CIDFont") else ("unknown", "pdfium") if m == "/Else" else ("low_quality", "hybrid") if m == "dark" else ("scanned", "vlm")) for m, _ in marks}
    assert value(spark, ff.determine_quality(F.lit(0.05), F.lit(False), F.lit(True))) == "scanned" and value(spark, ff.determine_quality(F.lit(0.5), F.lit(True), F.lit(False))) == "digital"
    c = spark.createDataFrame([("x.pdf", False, 1, b"%PDF"), ("x.txt", True, 1, b"%PDF"), ("x.PDF", True, 0, b""), ("x.pdf", True, 9, b"GIF8"), ("x.pdf", True, 9, b"%PDF-1")], "path string, exists boolean, length long, header binary")
    assert [r[0] for r in c.select(ff.validate_file()).collect()] == ["not_found", "bad_extension", "empty", "bad_magic", None]
    assert value(spark, ff.validate_upload(F.lit(""), F.lit(1))) == "no_name"
    assert value(spark, ff.validate_path_safety(F.lit("/database/x.pdf"), "/data")) == "outside_base"


def test_routing(spark):
    esc = lambda c, k, z: value(spark, fl.escalation_detect(F.lit(c), F.lit(k), z))
    assert [esc(50, 0.9, 50), esc(51, 0.9, 50), esc(500, 0.3, 0), esc(500, 0.299, 0)] == ["zero_text", "normal", "normal", "layout_chaos"]
    with pytest.raises(ValueError):
        fl.escalation_detect(F.lit(1), F.lit(1), chaos=1.5)
    assert [value(spark, fl.page_complexity(F.lit(a), F.lit(b))) for a, b in ((1000, 0.9), (200, 0.5), (10, 0.1))] == ["simple", "moderate", "complex"]
    r = value(spark, fl.parse_layout_text(F.lit("Table [1, 2, 11, 22] ... [5,5,6,7]")))
    assert [(x.region_type, x.width, x.height) for x in r] == [("table", 10.0, 20.0), ("table", 1.0, 2.0)]
    kinds = lambda t: [(x.region_type, x.content) for x in value(spark, fl.parse_layout_text(F.lit(t)))]
    assert kinds("caption of a table [1,2,3,4]") == [("caption", "[1,2,3,4]")] and kinds("heading, IMAGE [1, 2, 3, 4.5]") == [("body", "[1, 2, 3, 4.5]")] and kinds("figure [1,2,3,4]") == [("body", "[1,2,3,4]")]
    assert kinds("image [-1,2,3,4] [1,2,3]") == []
    assert kinds("[1,2,3,4]" + " " * 45 + "title") == [("title", "[1,2,3,4]")] and kinds("[1,2,3,4]" + " " * 46 + "title") == [("body", "[1,2,3,4]")]
    assert kinds("title" + " " * 45 + "[1,2,3,4]") == [("title", "[1,2,3,4]")] and kinds("title" + " " * 46 + "[1,2,3,4]") == [("body", "[1,2,3,4]")]
    assert value(spark, fl.parse_ocr_json(F.lit("broken"))) is None
    reply = '{"layout_details":[[{"label":"caption","bbox_2d":[1,2,4,8],"content":"c"},{"label":"image"},{"label":"figure","bbox_2d":[1,2,3,4],"content":"x"},{"label":"list","content":"no box"},{"label":"list","bbox_2d":[0,0,1,1],"content":""}]]}'
    assert [tuple(x) for x in value(spark, fl.parse_ocr_json(F.lit(reply)))] == [("caption", 1.0, 2.0, 3.0, 6.0, "c"), ("image", 0.0, 0.0, 0.0, 0.0, "[image]"), ("body", 0.0, 0.0, 1.0, 1.0, "")]
    assert value(spark, fl.hint_truncate(F.lit("é" * 6), 5)) == "éé" and value(spark, fl.hint_truncate(F.lit("日本語"), 8)) == "日本" and value(spark, fl.hint_truncate(F.lit("😀x"), 3)) == "" and value(spark, fl.hint_truncate(F.lit("abc"), 3)) == "abc"
    assert [round(value(spark, fl.retry_backoff(F.lit(k))), 2) for k in (0, 1, 10)] == [1.1, 2.2, 33.0]
    assert [round(value(spark, fl.backpressure_interval(F.lit(x))), 6) for x in (-1.0, 0.8, 2.0)] == [1000.0, 5000.0, 30000.0]


@pytest.mark.parametrize(("spec", "pages"), [("1-3,7", [1, 2, 3, 7]), ("3-1", []), ("x,2, 2", [2]), ("8-99", [8, 9]), ("12", []), ("", []), ("0-1", [0, 1])])
def test_page_ranges(spark, spec, pages):
    assert value(spark, ff.parse_page_range(F.lit(spec), F.lit(9))) == pages


def test_text(spark):
    docs = spark.createDataFrame([("a", "  hello  world  "), ("b", "Transformer 语言 模型, the the"), ("c", None)], "path string, body string")
    assert docs.select(ft.tokens(F.col("body"), "unicode")).collect()[1][0] == ["Transformer", "语言", "模型", ",", "the", "the"]
    assert [(r.term, r.n) for r in ft.term_frequency_topn(docs, 1).collect()] == [("the", 2)]
    weights = ft.tfidf_weights(docs.where("body is not null"))
    assert all(abs(r.s - 1) < 1e-9 for r in weights.groupBy("path").agg(F.sum(F.col("weight") ** 2).alias("s")).collect())
    v = ft.hashed_vectors(weights, 128).first().vector
    assert len(v) == 128 and abs(sum(x * x for x in v) - 1) < 1e-5
    assert value(spark, ft.snippet(F.lit("x" * 300 + "NEEDLE" + "y" * 300), "needle")) == "x" * 100 + "NEEDLE" + "y" * 200
    assert value(spark, ft.snippet(F.lit("abc"), "zzz")) == ""
    assert value(spark, ft.trigram_similarity(F.lit("word"), F.lit("word"))) == 1.0


def test_search(spark):
    e = entries(spark, [("a.md", {"title": "red apple", "body": "an apple a day"}), ("b.md", {"body": "apple pie and red wine"}), ("c.md", {"title": None, "body": "wine"}), ("d_e.md", {"title": None, "domain": None, "tags": ["wine", "x"]})])
    hits = lambda s, **k: [r.path for r in ft.search_knowledge(e, s, **k).collect()]
    assert set(hits("apple wine")) == {"a.md", "b.md", "c.md", "d_e.md"}
    assert hits('"red wine"') == ["b.md"] and hits("+red -pie") == ["a.md"] and hits("apple AND wine") == ["b.md"]
    assert hits("title:apple") == ["a.md"] and hits("tags:wine") == ["d_e.md"] and hits("Apple") == [] and hits("Apple", lowercase=True) != []
    assert hits("wine", k=0) == [] and hits("") == [] and hits("wine NOT pie AND domain:it") == ["c.md"]
    assert ft.search_knowledge(e, "wine", index=ft.rebuild_index(e)).count() == 3
    assert ft.search_knowledge(e.where("path = 'd_e.md'"), "wine").first().title == "d e"


def test_keywords(spark):
    pages = spark.createDataFrame([("p", 1, "a.b A.B aXb"), ("p", 2, "é a.b"), ("p", 3, None)], "path string, page_number int, text string")
    got = sorted((r.page_number, r.position, r.matched) for r in ft.search_keywords(pages, ["a.b", ""]).collect())
    assert got == [(1, 0, "a.b"), (1, 4, "A.B"), (2, 2, "a.b")]
    assert ft.search_keywords(pages, ["a.b"], case_sensitive=True).count() == 2 and ft.search_keywords(pages, []).count() == 0
    other = spark.createDataFrame([("p", "Éa éA ÉÉ жЖ"), ("q", None), ("r", "k K \u212a " * 400)], "path string, text string")
    assert sorted((r.keyword, r.position) for r in ft.search_keywords_client(other.where("path = 'p'"), ["é", "Ж"]).collect()) == [("é", 0), ("é", 3), ("é", 6), ("é", 7), ("Ж", 9), ("Ж", 10)]
    assert sorted(r.position for r in ft.search_keywords_client(other, ["k"]).collect()) == [2 * k for k in range(1200)]


def test_vectors(spark):
    cos = lambda a, b: value(spark, fv.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert cos([1.0, 0.0], [1.0, 0.0]) == 1.0 and cos([1.0, 0.0], [0.0, 1.0]) == 0.0 and cos([0.0, 0.0], [1.0, 0.0]) == 0.0 and cos([1.0], [1.0, 2.0]) == 0.0
    v = spark.createDataFrame([("a.md", [1.0, 0.0], "x"), ("b.md", [0.0, 1.0], "y")], "path string, vector array<double>, title string")
    query = spark.createDataFrame([([1.0, 0.0],)], "q array<double>")
    assert [r.path for r in fv.vector_search(v, query, 2).collect()] == ["a.md", "b.md"] and fv.vector_search(v, query, 0).count() == 0
    assert fv.vector_upsert(v, v.where("path = 'a.md'").withColumn("title", F.lit("z"))).where("title = 'z'").count() == 1


def test_compile_state(spark):
    sources = spark.createDataFrame([("n", bytearray(b"1")), ("same", bytearray(b"2")), ("changed", bytearray(b"3")), ("hollow", bytearray(b"4"))], "path string, content binary")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    state = spark.createDataFrame([("same", sha(b"2"), ["x"]), ("changed", sha(b"0"), ["x"]), ("hollow", sha(b"4"), [])], "path string, source_hash string, compiled_entries array<string>")
    assert {r.path: r.needs_compile for r in cs.needs_compile(sources, state).collect()} == {"n": True, "same": False, "changed": True, "hollow": True}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 70])
def test_merkle(spark, n):
    leaves = [(f"p{k:03}", hashlib.sha256(str(k).encode()).hexdigest()) for k in range(n)]
    level = [bytes.fromhex(h) for _, h in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(level[k] + level[k + 1]).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    df = spark.createDataFrame(leaves[::-1], "path string, source_hash string")
    assert cs.merkle_root(df, fan=8).first().root == level[0].hex()
    assert cs.has_changes(df, level[0].hex()).first().has_changes is False


def test_state_from_json(spark):
    one = '{"entries": {"a": {"source_hash": "h", "compiled_entries": ["x"]}}}'
    old = '{"b": {"source_hash": "i", "compiled_entries": []}}'
    rows = spark.createDataFrame([(one,), (old,), ("broken",)], "value string")
    assert sorted((r.path, r.source_hash) for r in cs.migrate_from_json(rows).collect()) == [("a", "h"), ("b", "i")]


def test_metrics(spark):
    s = spark.createDataFrame([(k, float(k), k) for k in range(100)], "ts long, value double, key long")
    r = m.metric_window_agg(s, 0).first()
    assert (r.p99, r["count"], r.min, r.max) == (99.0, 100, 0.0, 99.0)
    assert m.metric_window_agg(s, 10).first().min == 90.0 and m.metric_window_agg(s.limit(0), 5).first().asDict() == {"avg": 0.0, "min": 0.0, "max": 0.0, "p99": 0.0, "count": 0}
    calls = spark.createDataFrame([("a", 3, True), ("a", 4, False)], "tool string, latency_ms long, success boolean")
    assert m.tool_metrics(calls).first() == ("a", 2, 3, 1, 50.0) and m.tool_metrics(calls, False).first().avg_latency_ms == 3
    assert m.exec_log_stats(calls.limit(0)).first().success_rate == 100.0


def test_drift(spark):
    import datetime as dt

    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    e = entries(spark, [("a", {"tags": ["x", "y"], "created": day(0)}), ("b", {"tags": ["y", "x"], "created": day(90)}), ("c", {"tags": ["x"], "created": day(89)})])
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.0, 1.0])], "path string, vector array<double>")
    assert [tuple(r) for r in q.drift_pairs(e, v).collect()] == [("a", "b", "x", 90, 0.0)]
    more = entries(spark, [(f"n{k}", {"tags": ["x"], "created": day(100 * k)}) for k in range(6)])
    turned = spark.createDataFrame([(f"n{k}", [1.0, float(k * k)]) for k in range(6)], "path string, vector array<double>")
    found = [r.similarity for r in q.drift_pairs(more, turned).collect()]
    assert found == sorted(found) and len(found) == 4


def test_aggregated_entries_use_the_default_rounds(spark, monkeypatch):
    from foliolake.plans import queries
    from tests.conftest import SF

    asked = []
    monkeypatch.setattr(g, "detect_communities", lambda edges, *a, f=g.detect_communities, **b: asked.append((a, b)) or f(edges, *a, **b))
    assert queries.aggregate_entries(spark, SF).count() > 0 and asked == [((), {})]


def test_dictionary_tokenizer(spark):
    words = {"自然": 50, "自然语言": 30, "语言": 80, "语言模型": 20, "模型": 60, "处理": 40, "研究": 9, "研究生": 9, "生命": 9, "起源": 9}
    ft.register_tokenizer("dictionary", ft.dictionary_tokenizer(words))
    docs = spark.createDataFrame([("a", "自然语言处理 Transformer模型, it's 语言x"), ("b", None), ("c", "研究生命起源"), ("d", "龘 a1")], "path string, body string")
    got = {r.path: r.t for r in docs.select("path", ft.tokens(F.col("body"), "dictionary").alias("t")).collect()}
    assert got == {"a": ["自然语言", "处理", "Transformer", "模型", ",", "it", "'", "s", "语言", "x"], "b": None, "c": ["研究", "生命", "起源"], "d": ["龘", "a1"]}


def test_embeddings(spark, tmp_path):
    from foliolake.operators import embedding as em

    e = entries(spark, [("a", {"title": "red", "body": "apple pie"}), ("b", {"title": "blue", "body": "sky high"}), ("c", {"title": None, "body": None})])
    vectors, table = em.batch_embed_all(e)
    assert {r.path: any(r.vector) for r in vectors.collect()} == {"a": True, "b": True, "c": False}
    root = f"file://{tmp_path}/v"
    em.save_vectors(vectors.where("path = 'b'"), table, root)
    indexed, hit = em.embed_entry(e, "a", *em.load_vectors(spark, root))
    assert indexed.count() == 2 and [(r.path, r.title, round(r.score, 6)) for r in hit.collect()] == [("a", "red", 1.0)]
    assert em.embed_entry(e, "nowhere", vectors, table)[1].count() == 0
    em.register_embedding_model("ones", em.EmbeddingModel(lambda texts: texts.limit(0), lambda texts, _: texts.select("path", F.array(F.lit(1.0), F.lit(1.0)).alias("vector"))))
    assert [r.vector for r in em.batch_embed_all(e, "ones")[0].collect()] == [[1.0, 1.0]] * 3


def test_searching_many(spark):
    v = spark.createDataFrame([(f"p{k}", [float(k), 1.0]) for k in range(20)], "path string, vector array<double>")
    asked = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(20)] + [(99, None)], "query_id long, q array<double>")
    import foliolake.functions.vectors as module

    old, module.BLOCK = module.BLOCK, 4
    try:
        got = fv.vector_search_many(v, asked, 2).collect()
    finally:
        module.BLOCK = old
    assert {(r.query_id, r.path) for r in got if r["rank"] == 1 and r.query_id < 20} == {(k, f"p{k}") for k in range(20)} and len(got) == 42


def test_pages_by_position(spark):
    pages = spark.createDataFrame([("a", 1, " one "), ("a", 2, ""), ("a", 3, "three")], "path string, page_number int, text string")
    asked = spark.createDataFrame([("a", 0), ("a", 2), ("a", 3), ("a", 3), ("a", 99), ("a", -1), ("b", 0)], "path string, position int")
    assert sorted((r.position, r.page_number) for r in ft.find_page(pages, asked).collect()) == [(0, 1), (2, 1), (3, 3), (99, 3)]


def _regions_by_hand(text, reach):
    """Boxes by a plain regular expression, and the first word around each by its places."""
    import re

    out = []
    for m in re.finditer(r"\[\s*(\d+(?:\.\d+)?)\s*,\s*(\d+(?:\.\d+)?)\s*,\s*(\d+(?:\.\d+)?)\s*,\s*(\d+(?:\.\d+)?)\s*\]", text, re.A):
        word = re.search("|".join(fl.REGION_WORDS), text[max(0, m.start() - reach) : m.end() + reach], re.I)
        a, b, c, d = (float(m[k]) for k in range(1, 5))
        out.append((fl.REGION_WORDS[word[0].lower()] if word else "body", a, b, c - a, d - b, m[0]))
    return out


def test_layout_boxes_side_by_side(spark):
    import random

    r = random.Random(1)
    number = lambda: r.choice(["1", "22", "3.5", "100", "0"])
    box = lambda: "[" + ",".join(r.choice(["", " ", "\n"]) + number() + r.choice(["", " "]) for _ in range(4)) + "]"
    other = ["Title ", "TABLE", "image", "é𝒳", "." * 60, " x ", "heading", "[1,2,3]", "[-1,2,3,4]", "caption ", "日本" * 20]
    texts = ["".join(box() if r.random() < 0.5 else r.choice(other) for _ in range(r.randint(0, 25))) for _ in range(400)] + [""]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    for reach in (50, 7):
        got = {x.t: x.r for x in df.select("t", fl.parse_layout_text(F.col("t"), reach).alias("r")).collect()}
        assert got.pop(None) is None
        assert {t: [tuple(x) for x in v] for t, v in got.items()} == {t: _regions_by_hand(t, reach) for t in texts}


def test_similar_names_equal_the_full_join(spark):
    import random

    def grams(name):
        padded = "  " + name.lower() + " "
        return {padded[k : k + 3] for k in range(max(1, len(name)))}

    r = random.Random(4)
    base = ["Anna Berg", "anna bergh", "Órbita", "x", "", "ab", "long name of somebody else"]
    names = base + ["".join(c if r.random() > 0.2 else r.choice("abcxyz ") for c in r.choice(base[:3] + base[6:])) for _ in range(60)]
    alike = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    df = lambda x: spark.createDataFrame([(n, 1) for n in [*x, x[0], None]], "name string, left int")
    for least in (0.3, 0.4, 0.75, 1.0):
        got = {(x.left, x.right): round(x.similarity, 9) for x in ft.similar_names(df(names), least=least).collect()}
        assert got == {(a, b): round(alike(a, b), 9) for a in set(names) for b in set(names) if a < b and alike(a, b) >= least}
    got = {(x.left, x.right) for x in ft.similar_names(df(names[:30]), df(names[30:])).collect()}
    assert got == {(a, b) for a in set(names[:30]) for b in set(names[30:]) if a != b and alike(a, b) >= 0.4}
    with pytest.raises(ValueError, match="least"):
        ft.similar_names(df(names), least=0)


def test_a_thousand_keywords_in_one_pass(spark):
    import random
    import re

    r = random.Random(9)
    letters = ["a", "B", "s", "ſ", "K", "k", "ß", "Σ", "ς", "σ", "İ", "i", ".", "(", "é", "É", " "]
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 4))) for _ in range(1000)]
    pages = [(f"p{k}", 1, "".join(r.choice(letters) for _ in range(60))) for k in range(40)] + [("n", 1, None), ("e", 1, "")]
    df = spark.createDataFrame(pages, "path string, page_number int, text string")
    exact = [(x.path, x.keyword, x.position) for x in ft.search_keywords(df, words, case_sensitive=True).collect()]
    want = [(p, w, m.start()) for p, _, t in pages if t for w in words for m in re.finditer(re.escape(w), t)]
    assert sorted(exact) == sorted(want)
    # In any case: the same as each keyword's own pattern on every page.
    found = sorted((x.path, x.keyword, x.matched) for x in ft.search_keywords(df, words[:150]).collect())
    pattern = lambda w: "(?iu)" + re.sub(r"([\\^$.|?*+()\[\]{}-])", r"\\\1", w)
    every = df.select("path", F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.regexp_extract_all("text", F.lit(pattern(w)), F.lit(0)).alias("m")) for w in words[:150]])).alias("x")).select("path", "x.w", F.explode("x.m").alias("m"))
    assert found == sorted(map(tuple, every.collect()))


def test_drift_tiles_do_not_show(spark, monkeypatch):
    import datetime as dt
    import itertools
    import math
    import random

    r = random.Random(2)
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    rows = {f"p{k:02d}": (r.sample(["a", "b", "c", "d"], r.randint(0, 3)), r.randrange(400), r.choice([[r.gauss(0, 1) for _ in range(4)], [1.0, 2.0], [0.0] * 4, [1.0, None, 0.0, 0.0], []])) for k in range(60)}
    e = entries(spark, [(p, {"tags": t, "created": day(k)}) for p, (t, k, _) in rows.items()])
    v = spark.createDataFrame([(p, x) for p, (_, _, x) in rows.items()] + [("none", [1.0])], "path string, vector array<double>")

    def cosine(x, y):
        if None in x or None in y or len(x) != len(y) or not any(x) or not any(y):
            return 0.0
        return sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))

    want = set()
    for (p, (t, k, x)), (q_, (u, l, y)) in itertools.combinations(sorted(rows.items()), 2):
        if set(t) & set(u) and abs(k - l) >= 90 and cosine(x, y) < 0.6:
            want.add((p, q_, min(set(t) & set(u)), abs(k - l), round(cosine(x, y), 9)))
    for tile in (512, 5):
        monkeypatch.setattr(q, "TILE", tile)
        for ordered in (True, False):
            got = [(*x[:4], round(x[4], 9)) for x in map(tuple, q.drift_pairs(e, v, ordered=ordered).collect())]
            assert len(got) == len(set(got)) and set(got) == want
    assert q.drift_pairs(e.limit(0), v).count() == 0


@pytest.mark.parametrize("compat", ["most_frequent", "least_frequent"])
def test_a_sweep_by_colours_equals_the_sweep_on_the_driver(spark, compat):
    import random

    r = random.Random(6)
    links = [(f"n{r.randrange(12) + 12 * c}", f"n{r.randrange(12) + 12 * c}") for c in range(4) for _ in range(30)] + [("hub", f"n{k}") for k in range(0, 48, 3)] + [("n1", "n1"), (None, "n2"), ("n3", None), ("x", "y")]
    edges = spark.createDataFrame(links, "src string, dst string")
    deal = g.colours(edges)
    colour = {x.path: x.colour for x in deal.collect()}
    assert set(colour) == {n for a, b in links if a and b and a != b for n in (a, b)}
    assert all(colour[a] != colour[b] for a, b in links if a and b and a != b)
    got = {x.path: x.label for x in g.detect_communities_in_turn(edges, iterations=4, compat=compat).collect()}
    want = {x.path: x.label for x in g.detect_communities_exact(edges.where("src is not null and dst is not null"), iterations=4, compat=compat, order=deal).collect()}
    assert got == want
    assert g.detect_communities_in_turn(edges.limit(0)).count() == 0


def test_search_cuts_texts_and_queries_by_one_tokenizer(spark):
    ft.register_tokenizer("words_of_a_dictionary", ft.dictionary_tokenizer({"知识": 50, "图谱": 40, "知": 1, "模型": 30, "语言": 30}))
    e = entries(spark, [("a", {"title": "知识图谱", "body": "语言模型 and graphs"}), ("b", {"title": "x", "body": "知 识 图 谱"}), ("c", {"title": "y", "body": "语言 only"})])
    index = ft.rebuild_index(e, tokenizer="words_of_a_dictionary")
    for query, want in (("知识", ["a"]), ("+语言 -模型", ["c"]), ('"语言模型"', ["a"]), ("知", ["b"]), ("title:知识图谱", ["a"])):
        for held in (None, index):
            found = [r.path for r in ft.search_knowledge(e, query, 10, held, tokenizer="words_of_a_dictionary").collect()]
            assert found == want, (query, held is None, found)
