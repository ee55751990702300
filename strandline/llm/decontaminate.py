"""Benchmark decontamination by winnowing.

Every K-gram of words is hashed, and of each SPAN consecutive ones the least hash is kept as a
fingerprint.  K + SPAN - 1 words are one window, so a window that a document shares with an item
has its fingerprint in both.  Fingerprints are joined; each hit is extended to the windows around
it, which are compared word by word.  Items shorter than a window are fingerprinted whole.

All of it is DataFrame operations: fingerprints are arrays made in their row, and only
fingerprints, never texts, go into the first join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

WINDOW = 13
K = 7
SPAN = WINDOW - K + 1

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased; empty for null."""
    ascii_only = F.length(text) == F.octet_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.array_remove(F.split(low, _SEPARATORS), ""), F.array().cast("array<string>"))


def _grams(words: str, n: str, size: int) -> Column:
    """Hash of the ``size`` words from each word on; empty when there are fewer."""
    each = ", ".join(f"element_at({words}, i + {k})" for k in range(size))
    return F.expr(f"if({n} < {size}, cast(array() as array<bigint>), transform(sequence(1, {n} - {size - 1}), i -> xxhash64({size}, {each})))")


def _winnowed(grams: str) -> Column:
    """The distinct least hashes of every SPAN consecutive ones."""
    each = ", ".join(f"element_at({grams}, i + {k})" for k in range(SPAN))
    return F.expr(f"if(size({grams}) < {SPAN}, cast(array() as array<bigint>), array_distinct(transform(sequence(1, size({grams}) - {SPAN - 1}), i -> least({each}))))")


def _fingerprints(rows: DataFrame, short: list[int], own_length_only: bool) -> DataFrame:
    """Add ``prints`` to rows with ``words`` and ``n``.  ``short``: lengths of short items; their
    whole-item grams count too, for an item only those of its own length."""
    rows = rows.withColumn("grams", _grams("words", "n", K)).withColumn("prints", _winnowed("grams"))
    for size in short:
        more = F.array_distinct(_grams("words", "n", size))
        if own_length_only:
            more = F.when(F.col("n") == size, more).otherwise(F.array().cast("array<bigint>"))
        rows = rows.withColumn("prints", F.concat("prints", more))
    return rows.drop("grams")


def decontaminate(docs: DataFrame, benchmark: DataFrame, with_mark: bool = False, with_runs: bool = False) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one for each row of
    ``docs`` (doc_id, text) against ``benchmark`` (item_id, text).

    A window is WINDOW consecutive words of an item; an item of fewer words is one window.  A
    document's word inside any occurrence of any window is hit.  ``contaminated``: some word is
    hit, and at least one in 20 words.  ``items_sha256`` is over the ids, as sorted strings joined
    by commas, of the items with windows that occur; a null item_id counts as an empty string.

    Null and empty texts have no words; an item without words has no window.  Repeated rows are
    all returned; rows with equal ids and different texts are told apart.  With an empty benchmark
    nothing is hit.  Other columns are not read.  ``with_mark`` adds ``mark``, the text's xxhash64,
    and ``with_runs`` adds ``runs``, the hit words as sorted runs from word s to before word e, from 1
    on; null where there are none.
    """
    items = materialise(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text").cast("string")).alias("words")).withColumn("n", F.size("words")).where("n > 0"), "items")
    short = sorted(r[0] for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect())  # WINDOW - 1 numbers at most
    marked = _fingerprints(items, short, own_length_only=True)
    prints = marked.select("item_id", F.explode("prints").alias("print")).distinct()

    text = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    worded = text.select("doc_id", "mark", words(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    rows = materialise(_fingerprints(worded, short, own_length_only=False).select("doc_id", "mark", F.col("n").cast("long").alias("n_words"), "prints"), "doc-prints")
    hits = rows.select("doc_id", "mark", F.explode("prints").alias("print")).join(prints, "print").select("doc_id", "mark", "item_id").distinct()
    hits = materialise(hits, "print-hits")

    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.mark") == F.col("h.mark"))
    suspects = text.alias("d").join(hits.select("doc_id", "mark").distinct().alias("h"), same, "left_semi").dropDuplicates(["doc_id", "mark"])
    suspects = suspects.select("doc_id", "mark", words(F.col("text")).alias("words")).withColumn("n", F.size("words")).withColumn("grams", _grams("words", "n", K))
    cut = f"least({WINDOW}, n)"
    whole = marked.withColumn("windows", F.expr(f"transform(sequence(1, n - {cut} + 1), i -> array_join(slice(words, i, {cut}), ' '))"))
    whole = whole.select("item_id", F.col("n").alias("m"), "windows", F.col("prints").alias("item_prints"))
    pairs = suspects.alias("d").join(hits.alias("h"), same).select("d.*", "h.item_id").join(whole, "item_id")
    # Windows around a hit, or for a short item all of its length, that stand in the item.
    around = F.expr(f"""
        if(m < {WINDOW}, if(n < m, cast(array() as array<int>), sequence(1, n - m + 1)),
           array_distinct(flatten(transform(
               filter(sequence(1, greatest(1, size(grams))), p -> array_contains(item_prints, element_at(grams, p))),
               p -> filter(sequence(p - {SPAN - 1}, p), i -> i >= 1 and i <= n - {WINDOW - 1})))))""")
    extended = pairs.where(f"m < {WINDOW} or size(grams) > 0").withColumn("around", around).withColumn("length", F.expr(f"least({WINDOW}, m)"))
    found = extended.select("doc_id", "mark", "item_id", F.expr("transform(filter(around, i -> array_contains(windows, array_join(slice(words, i, length), ' '))), i -> struct(i as s, i + length as e))").alias("runs")).where("size(runs) > 0")
    covered = """aggregate(array_sort(flatten(collect_list(runs))), named_struct('sum', 0L, 'end', 0),
        (a, r) -> named_struct('sum', a.sum + greatest(0, r.e - greatest(r.s, a.end)), 'end', greatest(a.end, r.e)), a -> a.sum)"""
    merged = """aggregate(array_sort(flatten(collect_list(runs))), cast(array() as array<struct<s: int, e: int>>),
        (a, r) -> if(size(a) > 0 and try_element_at(a, -1).e >= r.s,
            concat(slice(a, 1, size(a) - 1), array(named_struct('s', try_element_at(a, -1).s, 'e', greatest(try_element_at(a, -1).e, r.e)))),
            concat(a, array(named_struct('s', r.s, 'e', r.e)))))"""
    named = F.array_sort(F.collect_set("item_id"))
    more = [F.expr(merged).alias("runs")] if with_runs else []
    result = found.groupBy("doc_id", "mark").agg(*more, F.expr(covered).alias("n_hit"), F.size(named).cast("long").alias("n_items"), F.sha2(F.array_join(named, ","), 256).alias("items_sha256"))
    result = result.alias("h")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.alias("d").join(result, same, "left").select(
        "d.doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        *(["d.mark"] if with_mark else []),
        *(["runs"] if with_runs else []),
    )


def without_runs(text: Column, runs: Column) -> Column:
    """``text`` without the words of ``runs`` and what stands between them; the rest as it is."""
    own = words(text)
    gaps = F.split(F.translate(text, _UPPER, _LOWER), _WORDS, -1)
    total = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))
    places = F.transform(runs, lambda r: F.struct((total(own, r["s"] - 1) + total(gaps, r["s"])).alias("s"), (total(own, r["e"] - 1) + total(gaps, r["e"] - 1)).alias("e")))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, r: F.struct(r["e"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, r["s"] - a["at"])).alias("out"))
    return F.aggregate(places, begin, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
