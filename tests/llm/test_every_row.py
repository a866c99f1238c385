"""Line dedup over repeated and missing ids: each row is a document of its own."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from numera.llm import lines, registry
from tests.llm.test_small import brute_lines


def test_repeated_and_missing_ids(spark, tmp_path):
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(40)]
    base = [" ".join(r.choices(vocab, k=r.randint(4, 20))) for _ in range(30)]
    ids = [r.choice([1, 1, 1, 2, 3, 5, 8, None]) for _ in range(120)]
    rows = [(i, "\n".join(r.choice(base) if r.random() < 0.6 else " ".join(r.choices(vocab, k=9)) for _ in range(r.randint(1, 6)))) for i in ids]
    rows += [rows[0]] * 5 + [(1, None), (None, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = df.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).collect()
    left = brute_lines([(k, x.text) for k, x in enumerate(order)])
    want = Counter((x.doc_id, left[k]) for k, x in enumerate(order))
    assert Counter((x.doc_id, x.text) for x in lines.dedup(df, every_row=True).collect()) == want
    assert Counter((x.doc_id, x.text) for x in corpus_pipeline.drop_repeated_lines(spark, df, "").collect()) == want
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.op4_line_dedup(spark, str(tmp_path)).collect()
    digests = Counter((x.doc_id, None if x.text is None else hashlib.sha256(left[k].encode()).hexdigest()) for k, x in enumerate(order))
    assert Counter((x.doc_id, x.kept_sha256) for x in found) == digests
