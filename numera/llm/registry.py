"""The thin queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from numera.llm.common import dealt, table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from numera.llm import embedding

    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from numera.llm import bpe

    return bpe.encode_digests(dealt(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from numera.llm import html

    return html.extract(dealt(table(spark, sf_dir, "pages")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from numera.llm import lines

    found = lines.dedup(table(spark, sf_dir, "documents"), every_row=True)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from numera.llm import packing

    return packing.pack(dealt(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.json"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from numera.llm import topk

    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from numera.llm import pii

    found = pii.find(dealt(table(spark, sf_dir, "documents")))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start, x.stop)), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from numera.llm import suffixes

    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from numera.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(dealt(docs), toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from numera.llm import simhash

    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from numera.llm import variants

    return variants.spelling_forms(dealt(table(spark, sf_dir, "documents")), rewrite=variants.damaged)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from numera.llm import warc

    where = warc.fresh_folder(spark)
    warc.write(table(spark, sf_dir, "pages"), where)
    return warc.read(spark, where, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from numera.llm import periodic

    found = periodic.runs_and_rest(dealt(table(spark, sf_dir, "documents")), rewrite=periodic.planted)
    # exact order of length/period by cross products: the later run wins only if it is strictly longer, runs being in order
    best = F.expr("reduce(runs, get(runs, 0), (a, r) -> if(r.length * a.period > a.length * r.period, r, a))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = (op1_embedding_dedup, op2_byte_bpe, op3_html_text, op4_line_dedup, op5_best_fit_packing, op6_exact_top_k, op7_pii, op8_suffix_dedup, op9_toxicity, op10_simhash, op11_spelling_variants, op12_warc, op13_periodic_runs)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


_USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))"

# the CRC-32 of a list of bytes, by a table of the polynomial's remainders in column ``tab``
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {}), lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295)"
_CODES = "list_transform(string_split({}, ''), lambda s: CAST(unicode(s) AS BIGINT))"
_SPACE = "[ \\t-\\r]"

SQL = {
    "op1_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE label IS NOT NULL AND {_USABLE} AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
 u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
 r(id, c) AS (SELECT a, a FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
SELECT e.vec_id, coalesce(k.n, 0) AS n_links, coalesce(m.c, e.vec_id) AS component_id, coalesce(m.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = e.vec_id LEFT JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = e.vec_id""",
    "op6_exact_top_k": f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND {_USABLE}),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s) WHERE place <= 5""",
    # letters beyond ASCII are two bytes in UTF-8: 195 and the code less 64; words one edit apart share a pattern with one letter open, or one is the other without a letter
    "op11_spelling_variants": f"""
WITH {_CRC_TABLE},
 r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
 d AS (SELECT id, run, count(*) AS n FROM r WHERE length(run) >= 5 GROUP BY id, run),
 h AS (SELECT run, n, {_CRC.format("list_concat(" + _CODES.format("id") + ", flatten(list_transform(string_split(run, ''), lambda s: CASE WHEN unicode(s) < 128 THEN [CAST(unicode(s) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(s) - 64 AS BIGINT)] END)))")} AS h FROM d, crc),
 w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM h),
 v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
 k AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
 o AS (SELECT DISTINCT word, n, i, substr(word, 1, CAST(i - 1 AS INTEGER)) AS a, substr(word, CAST(i + 1 AS INTEGER)) AS b FROM k),
 s AS (SELECT x.word, y.word AS near, y.n AS near_n FROM o x JOIN o y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word),
 e AS (SELECT DISTINCT o.word AS long_word, o.n AS long_n, v.word AS short_word, v.n AS short_n FROM o JOIN v ON o.a || o.b = v.word),
 p AS (SELECT word, near, near_n FROM s UNION ALL SELECT long_word, short_word, short_n FROM e UNION ALL SELECT short_word, long_word, long_n FROM e),
 g AS (SELECT word, count(*) AS n_near, max(near_n) AS m FROM p GROUP BY word),
 t AS (SELECT p.word, min(p.near) AS near FROM p JOIN g ON g.word = p.word AND g.m = p.near_n GROUP BY p.word),
 f AS (SELECT v.word, v.n, coalesce(g.n_near, 0) AS n_near, CASE WHEN g.m >= 2 * v.n THEN t.near END AS form, CASE WHEN g.m >= 2 * v.n THEN g.m END AS form_n FROM v LEFT JOIN g USING (word) LEFT JOIN t USING (word))
 SELECT z.word, z.form, z.root, z.n, z.n_near, z.form_n FROM (
  WITH RECURSIVE c(word, last) AS (SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.last WHERE f.form IS NOT NULL)
  SELECT f.word, f.form, c.last AS root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word JOIN f l ON l.word = c.last AND l.form IS NULL) z""",
    "op12_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
 d AS (SELECT page_id, html, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
 list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, CAST(5 * (k // 4) + 1 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d""",
    # a run's words equal those a period on for 16 places or more, so stretches are made of windows of 16 words that recur; a period that holds in a longer stretch of a smaller one is a multiple of it
    "op13_periodic_runs": f"""
WITH {_CRC_TABLE},
 t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda s: s <> '') AS w, {_CRC.format(_CODES.format("coalesce(CAST(doc_id AS VARCHAR), ' ')"))} AS h FROM documents, crc),
 g AS (SELECT doc_id, w, len(w) AS n, h, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
 q AS (SELECT doc_id, w, n, h, a, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM g),
 u AS (SELECT doc_id, n, h, a, p, unnest(w) AS word, unnest(range(n)) AS i FROM q),
 d AS (SELECT m.doc_id, m.n, m.i, u.word FROM (SELECT doc_id, n, i, CASE WHEN h % 10 = 0 AND i >= a AND doc_id IS NOT NULL THEN a + (i - a) % p ELSE i END AS j FROM u) m JOIN u ON u.doc_id = m.doc_id AND u.i = m.j),
 x AS (SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS v FROM d WHERE n >= 24 QUALIFY i + 16 <= n),
 e AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.v = b.v AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
 s AS (SELECT doc_id, q, min(i) AS start, max(i) + 16 + q - min(i) AS length FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM e) GROUP BY doc_id, q, isle),
 l AS (SELECT * FROM s WHERE length >= greatest(24, 3 * q)),
 r AS (SELECT doc_id, start, length, q AS period FROM l WHERE NOT EXISTS (FROM l m WHERE m.doc_id = l.doc_id AND m.q < l.q AND l.q % m.q = 0 AND m.start <= l.start AND m.start + m.length >= l.start + l.length)),
 c AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY doc_id),
 b AS (SELECT DISTINCT ON (doc_id) doc_id, start, length, period FROM r ORDER BY doc_id, CAST(length AS DOUBLE) / period DESC, start, period),
 k AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS i FROM r) GROUP BY doc_id),
 z AS (SELECT doc_id, unnest(gone) AS i FROM k),
 y AS (SELECT d.doc_id, string_agg(d.word, ' ' ORDER BY d.i) AS rest FROM d LEFT JOIN z ON z.doc_id = d.doc_id AND z.i = d.i WHERE z.i IS NULL GROUP BY d.doc_id)
SELECT d.doc_id, coalesce(c.n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli, sha256(coalesce(c.runs, '')) AS runs_sha256, sha256(coalesce(y.rest, '')) AS collapsed_sha256
FROM q d LEFT JOIN c USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN y USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    """Only where SQL can express the method's result on whole tables; the others are held against brute force in tests."""
    return dict(SQL)
