"""Operators that compare texts with other texts, against brute force."""

import random
from collections import Counter

import brute
import pytest
from strandline.llm import decontaminate, ngram_join

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as n", "text as words", "'x' as gram", "1 as rep")


def test_ngram_classes(spark, base):
    chain = [f"w{k}" for k in range(60)]
    odd = [(7000 + k, " ".join(chain[k : k + 40])) for k in range(20)]
    odd += [(8000, None), (8001, ""), (8002, "a b"), (8003, "A  B"), (8004, "a b c"), (8005, "x"), (8005, "x"), (None, "a b"), (8006, " \t"), (8007, "q " * 3000), (8008, "q " * 10)]
    odd += [(8100 + k, " ".join(chain[:20] + [f"own{k}"] + chain[21:])) for k in range(12)]
    rows = base + odd
    found = ngram_join.ngram_classes(frame(spark, rows), 4, 85)
    want = brute.ngram_classes(rows, 4, 85)
    got = Counter(map(tuple, found.collect()))
    got[None, 1, None], want[None, 1, None] = 0, 0  # the row without an id links with 8002
    assert {k: v for k, v in got.items() if v and k[0] is not None} == {k: v for k, v in want.items() if v}
    assert found.count() == len(rows)
    rows = base[:60] + odd[:20]
    assert {tuple(r) for r in ngram_join.ngram_classes(frame(spark, rows), 5, 80).collect()} == set(brute.ngram_classes(rows, 5, 80))
    assert ngram_join.ngram_classes(frame(spark, []), 4, 85).count() == 0


@pytest.mark.parametrize("held", [32, 2])
def test_group_of_near_copies(spark, monkeypatch, held):
    """Hundreds of copies with few and with many edits, some without an id: no link is lost."""
    monkeypatch.setattr(ngram_join, "HELD_AT_ONCE", held)
    rng = random.Random(held)
    first = [f"w{k}" for k in range(90)]
    rows = []
    for k in range(700):
        words = list(first)
        for _ in range(rng.choice((0, 1, 1, 2, 2, 3, 3, 4, 6))):
            at = rng.randrange(len(words))
            words[at : at + rng.choice((0, 1, 1, 1, 2))] = [rng.choice((f"x{rng.randrange(900)}", f"y{at % 9}"))]
        rows.append((None if k % 50 == 7 else 5000 + (k * 7919) % 700, " ".join(words)))
    for n, percent in ((4, 85), (5, 80)):
        named = [(-1 - k if i is None else i, t) for k, (i, t) in enumerate(rows)]  # brute force with ids for all
        parts = Counter()
        of = {}
        for i, _, c in brute.ngram_classes(named, n, percent):
            of[i] = c
        least = {}
        for i, c in of.items():
            if i >= 0:
                least[c] = min(least.get(c, i), i)
        for k, (i, t) in enumerate(rows):
            parts[i, len(brute.shingles(t, n)), least.get(of[named[k][0]])] += 1
        assert len(set(of.values())) > 50
        got = Counter(map(tuple, ngram_join.ngram_classes(frame(spark, rows), n, percent).collect()))
        assert got == parts


def test_pairs_are_tables(spark, monkeypatch):
    """No plan both finds pairs and counts their overlaps, so that the driver holds small plans."""
    calls, overlaps = [], ngram_join._overlaps

    def counted(pairs, sets, percent):
        calls.append(getattr(pairs, "_written_at", None))
        return overlaps(pairs, sets, percent)

    monkeypatch.setattr(ngram_join, "_overlaps", counted)
    rng = random.Random(5)
    rows = []
    for k in range(80):
        words = [f"w{j}" for j in range(90)]
        for _ in range(3):
            words[rng.randrange(90)] = f"x{rng.randrange(40)}"
        rows.append((k, " ".join(words)))
    got = {tuple(r) for r in ngram_join.ngram_classes(frame(spark, rows), 4, 85).collect()}
    assert got == set(brute.ngram_classes(rows, 4, 85))
    assert len(calls) >= 3 and all(calls)


def test_decontamination(spark, base):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    long = " ".join(f"t{k}" for k in range(40))
    items += [(900, "tiny item"), (901, ""), (902, None), (903, "solo"), (904, long), (905, "a a a a a a a a a a a a a a"), (905, "rep " * 20), (None, "no id but thirteen words are in this text so it is one window")]
    words = long.split()
    odd = [(7001, None), (7002, ""), (7003, "a TINY Item, here"), (7003, "a TINY Item, here"), (7003, "another under the same id"), (7004, " ".join(words[5:18])), (7005, " ".join(words[5:17])), (7006, "x " * 300 + " ".join(words[:14])), (7007, "a " * 40), (7008, "SOLO"), (None, "solo solo"), (7009, "no id but thirteen words are in this text so it is one window É"), (7010, "rep " * 3000), (7011, " ".join(words[1:15] + ["z"] + words[3:30]))]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as n", "1 as m")
    rows = base + odd
    found = decontaminate.decontaminate(frame(spark, rows), bench)
    got, want = Counter(map(tuple, found.collect())), brute.decontaminate(rows, [("" if i is None else i, t) for i, t in items])
    assert got == want
    assert sum(v for k, v in decontaminate.decontaminate(frame(spark, rows), bench.where("false")).selectExpr("n_hit").rdd.map(lambda r: (r[0], 1)).collect() if k) == 0
    assert decontaminate.decontaminate(frame(spark, []), bench).count() == 0
