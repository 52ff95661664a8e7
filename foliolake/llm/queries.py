"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, collocations, embdedup, lm, minhash, mixing, packing, pii, pivots, secrets, shards, suffixes, toxicity
from .staging import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.allocation(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_concat_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    scored = lm.cross_entropy_difference(_table(spark, sf_dir, "documents"), good)
    return scored.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "difference")])


def op5_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    return toxicity.scores(docs, lexicon).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_assignment_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    return secrets.digest(found, secrets.KINDS, {"n_assign": "assign", "n_access": "access", "n_hex": "hex"})


def op7_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(_table(spark, sf_dir, "documents"))
    return secrets.digest(found, pii.KINDS, {f"n_{k}": k for k in pii.KINDS})


def op8_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op9_training_order_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/foliolake/shards-{uuid.uuid4().hex}"
    shards.write_shards(_table(spark, sf_dir, "documents"), path)
    return shards.manifest(spark, path)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op11_automaton_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_pair_key_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"))


def op13_suffix_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.without_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pareto_mix, op2_concat_pack, op3_minhash_near_dedup, op4_cross_entropy_difference, op5_lexicon_toxicity,
        op6_assignment_secrets, op7_crf_pii, op8_pivot_top_k, op9_training_order_shards, op10_embedding_near_dedup,
        op11_automaton_collocations, op12_pair_key_alignment, op13_suffix_radix_dedup,
    )
}

_OP1 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         (CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source
), f AS (
  SELECT *, source_size::DOUBLE * 3 AS most,
         source_size::DOUBLE * 3 < weight * ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(source_size::DOUBLE * 3) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS full_
  FROM s WINDOW b AS (ORDER BY source_size::DOUBLE * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, CASE WHEN full_ THEN most ELSE weight * (((sum(source_size) OVER ())::DOUBLE - sum(CASE WHEN full_ THEN most ELSE 0 END) OVER ()) / sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER ()) END AS target
  FROM f
), p AS (
  SELECT source, length(bin(size)) AS prefer, sum(size)::BIGINT AS words FROM d GROUP BY 1, 2
), v AS (
  SELECT p.source, prefer, (target - 3 * coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) / nullif(sum(words * prefer) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)::DOUBLE AS level
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source WINDOW o AS (PARTITION BY p.source ORDER BY prefer DESC)
), m AS (
  SELECT source, coalesce(arg_max(level, prefer) FILTER (level * prefer < 3), 'inf'::DOUBLE) AS level FROM v GROUP BY source
), x AS (
  SELECT d.doc_id, d.source, d.size, d.u, t.source_size, t.target, CASE WHEN t.target > 0 THEN least(m.level * length(bin(d.size)), 3) ELSE 0 END AS wanted
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN m ON d.source IS NOT DISTINCT FROM m.source
), r AS (
  SELECT *, floor(wanted)::BIGINT AS certain, wanted - floor(wanted) AS fraction FROM x
), k AS (
  SELECT *, CASE WHEN fraction > 0 THEN ((u / (1 - u)) * ((1 - fraction) / fraction)) / (1 + (u / (1 - u)) * ((1 - fraction) / fraction)) END AS rank_ FROM r
), w AS (
  SELECT *, target - sum(size * certain) OVER (PARTITION BY source) AS want,
         sum(size) OVER (PARTITION BY source ORDER BY rank_ NULLS LAST, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM k
), e AS (
  SELECT *, rank_ IS NOT NULL AND upto <= want AS head, max(CASE WHEN rank_ IS NOT NULL AND upto <= want THEN upto ELSE 0 END) OVER (PARTITION BY source) AS taken_head FROM w
), {closing}
SELECT e.doc_id, e.size, e.source_size, e.target, (e.size * (e.certain + CASE WHEN e.head OR (e.rank_ IS NOT NULL AND list_contains(c.closing, e.doc_id)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM e LEFT JOIN c{last} c ON e.source IS NOT DISTINCT FROM c.source
"""
_CLOSING = "c0 AS (SELECT source, any_value(want - taken_head) AS rest, []::BIGINT[] AS closing FROM e GROUP BY source)" + "".join(
    f""", n{k} AS (
  SELECT e.source, arg_min(e.doc_id, (abs(size - rest), rank_, e.doc_id)) AS doc_id, arg_min(size, (abs(size - rest), rank_, e.doc_id)) AS size
  FROM e JOIN c{k - 1} ON e.source IS NOT DISTINCT FROM c{k - 1}.source WHERE rank_ IS NOT NULL AND NOT head AND size > 0 AND NOT list_contains(closing, e.doc_id) AND abs(size - rest) < rest GROUP BY e.source
), c{k} AS (
  SELECT c.source, rest - coalesce(n.size, 0) AS rest, CASE WHEN n.doc_id IS NULL THEN closing ELSE list_append(closing, n.doc_id) END AS closing FROM c{k - 1} c LEFT JOIN n{k} n ON c.source IS NOT DISTINCT FROM n.source
)"""
    for k in range(1, mixing.CLOSING + 1)
)
_OP1 = _OP1.replace("{closing}", _CLOSING).replace("{last}", str(mixing.CLOSING))

_OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
), r AS (
  SELECT x AS node, x AS seen FROM l UNION SELECT r.node, l.y FROM r JOIN l ON r.seen = l.x
), c AS (
  SELECT node, min(seen) AS component_id FROM r GROUP BY node
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, w.doc_id = coalesce(c.component_id, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id
"""

_OP4 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS wanted,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), w AS (
  SELECT r, wanted, unnest(words) AS word, unnest(list_prepend('', words[1:len(words) - 1])) AS prev FROM d WHERE len(words) > 0
), uni AS (
  SELECT word, count(*) AS n, count(*) FILTER (wanted) AS t FROM w GROUP BY word
), bi AS (
  SELECT prev, word, count(*) AS n, count(*) FILTER (wanted) AS t FROM w GROUP BY prev, word
), ctx AS (
  SELECT prev, count(*) AS n, count(*) FILTER (wanted) AS t FROM w GROUP BY prev
), f AS (
  SELECT sum(n)::DOUBLE AS n, sum(t)::DOUBLE AS t, greatest({lm.VOCABULARY}, count(*))::DOUBLE AS v, CASE WHEN sum(n) > 0 AND sum(t) > 0 THEN sum(t)::DOUBLE / sum(n) ELSE 1 END AS scale FROM uni
), p AS (
  SELECT word, (uni.t + 0.1::DOUBLE) / (f.t + 0.1::DOUBLE * v) AS pt, (uni.n * scale + 0.1::DOUBLE) / (f.n * scale + 0.1::DOUBLE * v) AS pb FROM uni, f
), l AS (
  SELECT w.r, -ln({lm.SHARES[0]}::DOUBLE * CASE WHEN ctx.t > 0 THEN bi.t::DOUBLE / ctx.t ELSE pt END + {lm.SHARES[1]}::DOUBLE * pt + {lm.SHARES[2]}::DOUBLE / v) AS lt,
         -ln({lm.SHARES[0]}::DOUBLE * (bi.n::DOUBLE / ctx.n) + {lm.SHARES[1]}::DOUBLE * pb + {lm.SHARES[2]}::DOUBLE / v) AS lb
  FROM w JOIN bi ON bi.prev = w.prev AND bi.word = w.word JOIN ctx ON ctx.prev = w.prev JOIN p ON p.word = w.word, f
), m AS (
  SELECT r, avg(lt) AS lt, avg(lb) AS lb FROM l GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, round(lt, 6) AS target_loss, round(lb, 6) AS background_loss, round(lt - lb, 6) AS difference FROM d LEFT JOIN m ON m.r = d.r
"""

_VALID = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_OP8 = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings WHERE {_VALID}),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""

_OP10 = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE {_VALID} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT x AS node, x AS seen FROM l UNION SELECT r.node, l.y FROM r JOIN l ON r.seen = l.x),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN c ON c.node = vec_id
"""

_OP11 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3]) AS k FROM w))
), f AS (
  SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL
), t AS (
  SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10
), x AS (
  SELECT c.*, cut, l.n AS l, r.n AS r, (1000000::HUGEINT * a * a) // (l.n::HUGEINT * r.n) AS score FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN f l ON l.lang = c.lang AND l.k = cut AND l.phrase = array_to_string(w[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.k = c.k - cut AND r.phrase = array_to_string(w[cut + 1:c.k], ' ')
), s AS (
  SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), h AS (
  SELECT lang, phrase, max(a) AS held FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY lang, phrase
)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase)::BIGINT AS rank, s.phrase, a, l, r, t.n, score::BIGINT AS score
FROM s JOIN t ON t.lang = s.lang LEFT JOIN h ON h.lang = s.lang AND h.phrase = s.phrase WHERE NOT coalesce(100 * held >= 50 * a, false)
QUALIFY row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) <= 2000
"""

_OP13 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
c AS (SELECT doc_id, n, p, substr(h, 2 * p + 1, 1198) AS part FROM (SELECT *, unnest(range(0, n, 500)) AS p FROM d)),
s AS (SELECT doc_id, p, part, unnest(range(least(500, n - p - 99))) AS j FROM c),
w AS (SELECT doc_id, p + j AS i FROM s QUALIFY row_number() OVER (PARTITION BY substr(part, 2 * j + 1, 200) ORDER BY doc_id, p + j) > 1),
o AS (SELECT *, i > 100 + coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -101) AS opens FROM w),
r AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o) GROUP BY doc_id, run),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM (FROM r UNION ALL SELECT doc_id, n, n FROM d)),
k AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT - 1 AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a, b) AS kept FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN k USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op1_pareto_mix": _OP1, "op3_minhash_near_dedup": _OP3, "op4_cross_entropy_difference": _OP4, "op8_pivot_top_k": _OP8, "op10_embedding_near_dedup": _OP10, "op11_automaton_collocations": _OP11, "op13_suffix_radix_dedup": _OP13}
