"""The pipeline's near-duplicate stage takes candidates from the byte-position index of SimHash fingerprints."""

from numera.llm import shingles


def test_two_bits_make_a_candidate(spark):
    f = 0x1234567890ABCDEF
    far = lambda i: (0x5555555555555555 * (i % 2)) ^ (0x0F0F0F0F << i)
    # two bits in two groups, three bits, two bits of a set too large
    rows = [(1, 100, f, far(0), [2, 4]), (2, 100, f ^ (1 << 3) ^ (1 << 40), far(1), [6, 8]), (3, 100, f ^ 7, far(2), [10, 12]), (4, 200, f ^ 3, far(3), [14, 16])]
    classes = spark.createDataFrame(rows, "node long, n int, f1 long, f2 long, ks array<long>").repartition(2)
    found = {tuple(sorted((x.src, x.dst))) for x in shingles._candidates(shingles.postings(classes), False).collect() if not x.open}
    assert found == {(1, 2)}
