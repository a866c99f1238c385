"""Every registered query over whole tables, and every stage of the pipeline, against brute force or SQL.

The tables are those of sf0.001 with rows added: nulls, empty and very long
texts, repeated rows and ids, ties, and columns whose names clash with those the
operators use.  Empty tables give empty results.
"""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from numera.llm import bpe, html, pii, registry, toxicity
from tests.llm.test_near_copies import five_words
from tests.llm.test_small import brute_lines, brute_pii, slow_fingerprint

SMALL = "/root/testdata/sf0.001"
EXTRA = ("id", "doc", "k", "v", "c", "rep", "node", "root", "key", "bucket", "at", "ats", "score", "spans", "length", "piece", "fp", "t", "b", "h", "ranges")


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


@pytest.fixture(scope="module")
def where(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(2)
    docs = table(spark, "documents")
    some = docs.orderBy("doc_id").limit(3).collect()
    long_line = " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(r.randrange(900)) for _ in range(30_000))
    added = [(900_001, None), (900_002, ""), (900_003, " \n\n "), (900_004, long_line), (900_005, long_line + " tail"), (900_006, "x" * 100_000), (900_008, "x <|endoftext|> y<|endoftext|>"), (None, "a text without an id, of seven more words"), (None, None)]
    added += [(x.doc_id, x.text) for x in some] + [(some[0].doc_id, "another text under an id in use"), (900_007, some[1].text)]
    vocab = sorted({w for x in docs.select("text").collect() for w in (x.text or "").split()})
    toxic = [(800_000 + i, " ".join(r.choices(vocab, k=25) + r.choices(["vilest", "vileness", "vilely"], k=3) + r.choices(vocab, k=25))) for i in range(120)]
    added += toxic
    more = spark.createDataFrame(added, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("added"), "n_chars": F.length("text")})
    every = docs.unionByName(more.select(*(F.col(c).cast(t) for c, t in docs.dtypes)))
    every.withColumns({c: F.lit(1) for c in EXTRA}).repartition(4).write.parquet(f"{out}/documents.parquet")
    vectors = table(spark, "embeddings")
    odd = [(None, [1.0] * 64, 1), (900_050, None, 1), (900_100, [0.0] * 64, 1), (900_150, [float("nan")] * 64, 1), (900_200, [], 1), (900_250, [0.5] * 64, None), (900_300, [0.5] * 64, 1), (900_301, [0.25] * 64, 1), (900_350, [1.0, 2.0], 1), (900_400, [1e30] + [0.0] * 63, 2)]
    odd = spark.createDataFrame(odd, "vec_id long, embedding array<float>, label int")
    every = vectors.unionByName(odd.select(*(F.col(c).cast(t) for c, t in vectors.dtypes)))
    every.withColumns({c: F.lit(1) for c in ("dim", "m", "n", "rep", "c", "key", "table", "tile", "side", "lo", "hi")}).repartition(3).write.parquet(f"{out}/embeddings.parquet")
    pages = table(spark, "pages")
    odd = [(900_001, None, None), (900_002, "u", ""), (900_003, "u", "<p>unclosed <a " * 3), (900_004, "u", '<a href="' * 50_000), (None, "u", "<p>one paragraph that stands alone</p>")]
    pages.unionByName(spark.createDataFrame(odd, pages.schema)).withColumn("linked", F.lit(1)).repartition(2).write.parquet(f"{out}/pages.parquet")
    labels = table(spark, "labels")
    labels.unionByName(spark.createDataFrame([(900_006, None, None), (None, 1, 1), (some[0].doc_id, 1, 0), *((i, 1, 1) for i, _ in toxic)], labels.schema)).write.parquet(f"{out}/labels.parquet")
    none = str(tmp_path_factory.mktemp("none"))
    for name in ("documents", "embeddings", "pages", "labels"):
        spark.read.parquet(f"{out}/{name}.parquet").limit(0).write.parquet(f"{none}/{name}.parquet")
    return out, none


@pytest.fixture(scope="module")
def rows(spark, where):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{where[0]}/documents.parquet").collect()]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def query(spark, where, name):
    run = registry.queries()[name]
    assert run(spark, where[1]).count() == 0
    return run(spark, where[0]).collect()


@pytest.mark.parametrize("name", ["op1_embedding_dedup", "op6_exact_top_k"])
def test_against_sql(spark, where, name):
    # SQL's longs cannot hold products with 1e30, so that row stays out of the comparison there
    got = query(spark, where, name)
    con = duckdb.connect()
    lost = "vec_id <> 900400 OR vec_id IS NULL" if name.startswith("op6") else "true"
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{where[0]}/embeddings.parquet/*.parquet' WHERE {lost}")
    want = con.sql(registry.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    keep = [r for r in got if 900_400 not in (r["vec_id"], r.asDict().get("query_id"))] if name.startswith("op6") else got
    assert Counter(tuple(r[c] for c in cols) for r in keep) == Counter(want.fetchall())


def test_byte_bpe(spark, where, rows):
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want[(i, len(ids), sha(" ".join(map(str, ids))), sha((t or "").encode()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in query(spark, where, "op2_byte_bpe")) == want


def test_html_text(spark, where):
    got = query(spark, where, "op3_html_text")
    source = {(r.page_id, r.url): r.html for r in spark.read.parquet(f"{where[0]}/pages.parquet").collect()}
    assert len(got) == len(source) and {(r.page_id, r.url) for r in got} == set(source)
    texts = {r.page_id: r.text for r in got}
    assert all(r.n_chars == len(r.text) for r in got) and texts[900_001] == texts[900_002] == "" and texts[None] == "one paragraph that stands alone"
    # pages as no training page is built: extraction keeps the article and nothing else
    body = ["The committee met on Tuesday and discussed the plan for the new bridge at length.", "Costs &amp; benefits were weighed by three experts, none of whom agreed with the others."]
    pages = [
        "<!doctype html><html><head><title>T</title><style>p{}</style></head><body><div class='site-header'><a href='/'>Home</a> <a href='/x'>News</a></div>"
        f"<div class='entry-content'><h1>A bridge is planned</h1><p>{body[0]}</p><p>{body[1]}</p></div><div id='comments'><p>Great reading, thanks for it!</p></div><footer>Copyright 2020</footer></body></html>",
        f"<html><body><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><main><article><h1>A bridge is planned</h1><p>{body[0]}<p>{body[1]}</article></main><aside class=sidebar><p>Related: <a href=c>other stories</a></aside></body></html>",
    ]
    want = "A bridge is planned\n" + "\n".join(body).replace("&amp;", "&")
    assert html.extract_texts(pages, html.train()) == [want, want]


def test_line_dedup(spark, where, rows):
    got = query(spark, where, "op4_line_dedup")
    # rows of repeated or missing ids: in the order of id (nulls last) and text hash
    ordered = spark.read.parquet(f"{where[0]}/documents.parquet").orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).select("doc_id", "text").collect()
    left = brute_lines([(k, r.text) for k, r in enumerate(ordered)])
    want = Counter()
    for k, r in enumerate(ordered):
        n = 0 if r.text is None else r.text.count("\n") + 1
        kept = None if r.text is None else sha(left[k])
        want[(r.doc_id, n, kept)] += 1
    assert Counter((r.doc_id, r.n_lines, r.kept_sha256) for r in got) == want and any(r.n_removed for r in got)


def check_packing(rows, got):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want, total = Counter(), 0
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        ends = np.cumsum([0, *(n for _, n in sorted(places))])
        assert [o for o, _ in sorted(places)] == ends[:-1].tolist() and ends[-1] <= 2048
    assert len(by) <= -(-total // 2048) + 1


def test_packing(spark, where, rows):
    check_packing(rows, query(spark, where, "op5_best_fit_packing"))


def test_pii(spark, where, rows):
    got = query(spark, where, "op7_pii")
    want = Counter()
    for i, t in rows:
        spans = brute_pii(t or "")
        want[(i, *(sum(k == kind for k, _, _ in spans) for kind in pii.KINDS), sha(",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), x[1])))))] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    for r in got:
        spans = [x for x in r.spans.split(",") if x]
        assert r.n_spans == len(spans) >= r.n_email + r.n_ip + r.n_card + r.n_phone


def test_suffix_dedup(spark, where, rows):
    seen, data = Counter(), [(t or "").encode() for _, t in rows]
    for b in data:
        seen.update(xxhash.xxh3_64_intdigest(b[i : i + 200]) for i in range(len(b) - 199))
    want = Counter()
    for (d, _), b in zip(rows, data):
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - 199):
            if seen[xxhash.xxh3_64_intdigest(b[i : i + 200])] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        want[(d, len(b), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), sha(np.frombuffer(b, np.uint8)[~gone].tobytes()))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in query(spark, where, "op8_suffix_dedup")) == want


def test_toxicity(spark, where, rows):
    got = query(spark, where, "op9_toxicity")
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    by_text = defaultdict(set)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1 if r.doc_id is not None else r.held_out)
    text = defaultdict(list)
    for i, t in rows:
        text[i].append(t)
    for r in got:
        if len(text[r.doc_id]) == 1:
            by_text[text[r.doc_id][0] or ""].add(round(r.score, 9))
    assert all(len(s) == 1 for s in by_text.values())  # the text alone makes the score


def test_toxicity_held_out(spark):
    """Over the labelled documents of sf0.1, those kept from training: most toxic ones found, clean ones left alone."""
    lab = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(lab.select("doc_id", "toxic"), "doc_id").repartition(8)
    model = toxicity.fit(docs.drop("toxic"), lab)
    got = toxicity.score(docs.where(toxicity.held_out(F.col("doc_id"))), model).join(lab, "doc_id").collect()
    toxic, clean = ([r.score >= toxicity.CUT for r in got if r.toxic == y] for y in (1, 0))
    print("held out: recall", np.mean(toxic), "of", len(toxic), "false positives", np.mean(clean), "of", len(clean))
    assert len(toxic) > 100 and np.mean(toxic) >= 0.85 and np.mean(clean) <= 0.02


def rank_quality(score, y):
    """The share of pairs of different labels that the scores put in order, ties half."""
    a, b = (np.array([s for s, t in zip(score, y) if t == k]) for k in (1, 0))
    return ((a[:, None] > b).sum() + (a[:, None] == b).sum() / 2) / (len(a) * len(b))


@pytest.mark.parametrize("sf, least", [("sf0.01", 0.85), ("sf0.1", 0.95)])
def test_toxicity_ranks_held_out(spark, sf, least):
    """The scores tell labels apart in documents kept from training, where many are labelled and where 33 toxic ones are."""
    lab = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").join(lab.select("doc_id", "toxic"), "doc_id").repartition(8)
    got = toxicity.score(docs.where(toxicity.held_out(F.col("doc_id"))), toxicity.fit(docs.drop("toxic"), lab)).join(lab, "doc_id").collect()
    assert rank_quality([r.score for r in got], [r.toxic for r in got]) >= least


def test_simhash(spark, where, rows):
    want = {i: None for i, _ in rows}
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    values = np.array(sorted({f for _, f in fps}), np.uint64)
    comp = np.arange(len(values))
    for a in range(len(values)):
        todo = [a] if comp[a] == a else []
        while todo:
            for j in np.flatnonzero((np.bitwise_count(values ^ values[todo.pop()]) <= 2) & (comp > a)).tolist():
                comp[j] = a
                todo.append(j)
    of = {int(v): int(c) for v, c in zip(values, comp)}
    least = defaultdict(lambda: 1 << 62)
    for i, f in fps:
        if i is not None:
            least[of[f]] = min(least[of[f]], i)
    want = Counter((i, f"{f:016x}", None if i is None else least[of[f]]) for i, f in fps)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in query(spark, where, "op10_simhash")) == want


def test_pipeline(spark, where):
    """Stage by stage over the same tables: each against brute force on what the stage before kept."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "PII", "best-fit packing"]
    assert corpus_pipeline.run(spark, where[1]).count() == 0
    docs, sf_dir = spark.read.parquet(f"{where[0]}/documents.parquet"), where[0]
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    plain = lambda df: df.select(*columns).collect()

    first = stages["toxicity"](spark, docs, sf_dir)
    assert first.columns == columns
    model = toxicity.fit(docs, spark.read.parquet(f"{where[0]}/labels.parquet"))
    before = plain(docs)
    kept = [r for r, s in zip(before, model.score([r.text for r in before])) if s < toxicity.CUT]
    after = plain(first)
    assert Counter(after) == Counter(kept) and 0 < len(after) < len(before)

    docs = spark.createDataFrame(after, first.schema).repartition(3)
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).collect()
    left = brute_lines([(k, r.text) for k, r in enumerate(ordered)])
    second = stages["line dedup"](spark, docs, sf_dir)
    assert second.columns == columns
    got = plain(second)
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, left[k]) for k, r in enumerate(ordered))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.source is not None for r in got)

    docs = spark.createDataFrame(got, second.schema).repartition(3)
    sets = [five_words(r.text) for r in got]
    comp = list(range(len(got)))
    own = [k for k, r in enumerate(got) if r.doc_id is not None]
    for a in own:
        for b in own:
            if a < b and comp[a] != comp[b] and (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = comp[a], comp[b]
                comp = [min(x, y) if c in (x, y) else c for c in comp]
    least = {c: min(got[k].doc_id for k in own if comp[k] == c) for c in {comp[k] for k in own}}
    want = Counter(r for k, r in enumerate(got) if r.doc_id is None or r.doc_id == least[comp[k]])
    third = stages["SimHash near-dedup"](spark, docs, sf_dir)
    got = plain(third)
    assert Counter(got) == want and len(got) < len(comp)

    docs = spark.createDataFrame(got, third.schema).repartition(3)
    fourth = stages["PII"](spark, docs, sf_dir)
    assert fourth.columns == columns
    hidden = plain(fourth)
    assert Counter(r.doc_id for r in hidden) == Counter(r.doc_id for r in got)
    assert not any(brute_pii(r.text or "") for r in hidden) and sum("[EMAIL]" in (r.text or "") for r in hidden)
    untouched = {r.text for r in got if not brute_pii(r.text or "")}
    assert len(untouched & {r.text for r in hidden}) > 0.8 * len(untouched)

    docs = spark.createDataFrame(hidden, fourth.schema).repartition(3)
    check_packing([(r.doc_id, r.text) for r in hidden], stages["best-fit packing"](spark, docs, sf_dir).collect())
    assert corpus_pipeline.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
