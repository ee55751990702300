"""Removal of earlier copies against brute force."""

import random
from collections import Counter

import brute
import numpy as np
from strandline.llm import suffix_dedup

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as mark", "text as found", "'x' as block")


def test_removal(spark):
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    a, b, c = letters(200), letters(49), letters(50)
    odd = [
        (7000, a), (7001, a[:120] + letters(60) + a[100:]), (7002, letters(30) + a[60:140]), (7003, a + a), (6999, letters(10) + a[:75]),
        (7010, b), (7011, b), (7012, c), (7013, c), (7014, "x" + c + "y" + c), (7015, ""), (7016, None), (7016, None), (7017, "q" * 400), (7018, "q" * 60), (7019, "q" * 49),
        (7020, a[:90]), (7020, a[30:140]), (None, a), (7021, "\0" * 55), (7022, "\0" * 80), (7023, letters(20) + c + a[10:80]),
    ]
    odd += [(7100 + k, a[: rng.randint(40, 200)] + letters(rng.randint(0, 40)) + a[rng.randint(0, 150) :]) for k in range(40)]
    odd += [(7300 + k, a[:60] + str(k)) for k in range(80)]
    rows = base + odd
    found = suffix_dedup.remove_earlier_copies(frame(spark, rows), with_kept=True).collect()
    assert all(brute.sha(bytes(r.kept)) == r.kept_sha256 for r in found)
    got = Counter(tuple(r)[:5] for r in found)
    alone = [(i, t) for i, t in rows if i is None]
    want = brute.suffix_dedup([r for r in rows if r[0] is not None])
    want += Counter((None, len(t.encode()), 0, 0, brute.sha(t)) for _, t in alone)
    assert got == want
    assert suffix_dedup.remove_earlier_copies(frame(spark, [])).count() == 0
    again = suffix_dedup.remove_earlier_copies(frame(spark, rows))
    assert Counter(map(tuple, again.collect())) == want
    # Keys of more than two entries dealt out by window, and texts over many segments.
    split = suffix_dedup.remove_earlier_copies(frame(spark, rows), wide_from=2, block_bytes=1000)
    assert Counter(map(tuple, split.collect())) == want


def test_long_texts(spark):
    """A text over several blocks, and a run of five million equal bytes with an earlier copy of some."""
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_200_000))
    rows = [(1, "q" * 60), (2, "q" * 5_000_000), (3, "z" * 5_000_000), (4, "z" * 70 + "y"), (5, long), (6, long[600_000:] + "!" + long[:300])]
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_earlier_copies(frame(spark, rows)).collect()}
    assert found == {1: (60, 0, 0), 2: (5_000_000, 5_000_000, 1), 3: (5_000_000, 0, 0), 4: (71, 70, 1), 5: (1_200_000, 0, 0), 6: (600_301, 600_300, 2)}


def test_factors_of_windows():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 80))
        windows = rng.integers(0, 2, (n, 3)).astype(np.uint8)
        ids = rng.integers(0, 12, n)
        want = [any(ids[j] < ids[i] and (windows[j] == windows[i]).all() for j in range(n)) for i in range(n)]
        assert suffix_dedup.earlier_factors(windows, ids, 3).tolist() == want
