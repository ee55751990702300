"""Best-fit packing of token sequences by matching large items.

Pieces longer than a third of the capacity fit at most twice in a sequence, so they are paired
greedily, each with the largest partner that still fits; the shorter ones then go best-fit into
the gaps that are left.  Which *lengths* meet depends only on how many pieces have each length, and
a length is at most the capacity.  So the corpus sends the driver one count per length (2,048 numbers at
most, whatever its size), the driver packs counted lengths, and its plan, a few thousand
runs of equal sequences, is applied to every piece by its rank within its length.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from struct import pack as pack_ids
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, sparing_batches
from .token_count import byte_symbols

#: Parts of texts whose ids a worker remembers.
CACHE_PARTS = 150_000
#: Buckets into which the pieces of one length are dealt to be ranked, so that no length is one task.
RANK_BUCKETS = 1024


class _Recent(dict):
    """Made values of the keys asked for of late: when full, the half not asked for again goes."""

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.before.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = found
        return found


class Encoder:
    """The ids of a text, as its library gives them, as little-endian 32-bit bytes.

    Where the vocabulary's pre-tokenizer drops white space, no pre-token spans a blank, so that
    ids are looked up word by word; of plain texts, whose case and marks are simple, words and
    marks are looked up apart.  A text for which that isn't certain goes through the library.
    """

    _NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
    #: Characters that NFC leaves alone and whose lower case is one character everywhere.
    _SIMPLE = r"\x21-\x7e\u00c0-\u012f\u0132-\u017f"
    _MARKS = r"!-/:-@\[-`{-~\u00d7\u00f7"

    def __init__(self, file: bytes, most: int = CACHE_PARTS) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(file.decode())
        spec = json.loads(file)
        cut, *coded = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        by_bytes = len(coded) == 1 and coded[0].get("type") == "ByteLevel" and not coded[0].get("add_prefix_space") and not coded[0].get("use_regex")
        self.by_word = spec["normalizer"] == self._NORMALIZER and cut.get("behavior") == "Removed" and cut.get("invert") is True and by_bytes
        if self.by_word:
            self.pieces = regex.compile(cut["pattern"]["Regex"]).findall
            self.simple = regex.compile(f"[{self._SIMPLE}]+").fullmatch
            self.uneven = regex.compile(rf"[^\x09-\x0d\x20{self._SIMPLE}]|[,.][{self._MARKS}]|[{self._MARKS}][,.]").search
            self.odd = regex.compile("|".join([*(regex.escape(t["content"]) for t in spec["added_tokens"]), r"[\x1c-\x1f\u180e\u200b]"])).search
            self.bytes = str.maketrans({b: s for b, s in enumerate(byte_symbols())})
            self.tokenize = self.library.model.tokenize
            self.part = _Recent(self._part, most).__getitem__
            self.word = _Recent(self._word, most).__getitem__

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        """Of a lower-case word of simple characters."""
        if not part.isalpha():
            cut = self.pieces(part)
            if len(cut) > 1:
                return b"".join(map(self.part, cut))
        ids = [t.id for t in self.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(self.bytes))]
        return pack_ids(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        return self.part(word.lower()) if self.simple(word) else self.whole(word)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word or self.odd(text):
            return self.whole(text)
        if self.uneven(text):
            return b"".join(map(self.word, text.split()))
        return b"".join(map(self.part, text.lower().replace(",", " ,").replace(".", " .").split()))


@lru_cache(maxsize=2)
def _encoder(file: bytes) -> Encoder:
    return Encoder(file)


class Run(NamedTuple):
    """``count`` sequences alike: pieces of ``length`` from rank ``rank`` on go, one each, to the
    sequences from ``sequence`` on, at ``offset``."""

    length: int
    rank: int
    sequence: int
    offset: int
    count: int


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Pack ``counts`` (length -> pieces) into sequences of ``capacity``."""
    left = {n: c for n, c in counts.items() if c > 0}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("a piece is empty or longer than a sequence")
    used = dict.fromkeys(left, 0)
    lengths = sorted(left)
    runs: list[Run] = []
    gaps: dict[int, list[list[int]]] = {}  # free space -> runs of sequences: first, how many
    free: list[int] = []
    fresh = 0

    def take(length: int, sequence: int, offset: int, count: int) -> None:
        runs.append(Run(length, used[length], sequence, offset, count))
        used[length] += count
        left[length] -= count
        if not left[length]:
            lengths.pop(bisect_left(lengths, length))

    def give(space: int, first: int, count: int) -> None:
        if space and count:
            if space not in gaps:
                gaps[space] = []
                free.insert(bisect_left(free, space), space)
            gaps[space].append([first, count])

    while lengths and 3 * lengths[-1] > capacity:
        big = lengths[-1]
        at = bisect_left(lengths, capacity - big + 1) - 1
        mate = lengths[at] if at >= 0 and 3 * lengths[at] > capacity else 0
        count = left[big] if not mate else min(left[big], left[mate]) if mate != big else left[big] // 2
        if not count:  # one last piece that would only fit with its like
            at -= 1
            mate = lengths[at] if at >= 0 and 3 * lengths[at] > capacity else 0
            count = 1
        take(big, fresh, 0, count)
        if mate:
            take(mate, fresh, big, count)
        give(capacity - big - mate, fresh, count)
        fresh += count

    while lengths:
        item = lengths[-1]
        at = bisect_left(free, item)
        if at == len(free):
            each = capacity // item
            count = -(-left[item] // each)
            give(capacity, fresh, count)
            fresh += count
            continue
        space = free[at]
        run = gaps[space][-1]
        count = min(run[1], left[item])
        take(item, run[0], capacity - space, count)
        give(space - item, run[0], count)
        run[0] += count
        run[1] -= count
        if not run[1]:
            gaps[space].pop()
            if not gaps[space]:
                del gaps[space]
                free.pop(bisect_left(free, space))
    return runs


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]): each text's ids and ``end_id``, cut
    after every ``capacity`` ids."""
    with open(vocabulary, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.asarray([end_id], "<u4").tobytes()
    wide = 4 * capacity

    @sparing_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(file.value)
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                coded = encode(text.as_py()) + end
                for number, at in enumerate(range(0, len(coded), wide)):
                    part = coded[at : at + wide]
                    row.append(k)
                    piece.append(number)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names=names + ["ids"] * with_ids)

    shape = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, shape)


def assign(items: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``items``, which have a ``length``.

    ``order`` names the columns that tell items apart.  An item's rank within its length is its
    rank within a hashed bucket plus the items in earlier buckets, so that a length that a third
    of all items have is dealt over many tasks.  Read ``items`` from files: they are read twice.
    """
    spark = items.sparkSession
    dealt = items.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(RANK_BUCKETS)).cast("int"))
    sizes = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = materialise(sizes.withColumn("_before", F.coalesce(F.sum("n").over(ahead), F.lit(0))), "pack-ranks")
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    by_length: dict[int, list[Run]] = {}
    for run in plan(counts, capacity):
        by_length.setdefault(run.length, []).append(run)
    shape = "_length long, _from array<long>, _sequence array<long>, _offset array<long>"
    rows = [(n, [r.rank for r in rs], [r.sequence for r in rs], [r.offset for r in rs]) for n, rs in by_length.items()]
    laid = F.broadcast(spark.createDataFrame(rows, shape))  # at most one row for each length up to the capacity
    own = Window.partitionBy("length", "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_own", F.row_number().over(own) - 1).join(before.drop("n"), ["length", "_bucket"]).withColumn("_rank", F.col("_own") + F.col("_before"))
    placed = ranked.join(laid, F.col("length") == F.col("_length"))
    # The last run that begins at or before the rank.
    at = F.size(F.filter("_from", lambda x: x <= F.col("_rank")))
    placed = placed.withColumn("_at", at).withColumn("sequence_id", F.element_at("_sequence", F.col("_at")) + F.col("_rank") - F.element_at("_from", F.col("_at"))).withColumn("offset", F.element_at("_offset", F.col("_at")))
    return placed.select(*items.columns, "sequence_id", "offset")


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): each piece of
    each text of ``docs`` (doc_id, text) and its place.

    A null or empty text is one piece that holds only the end id.  Only texts longer than the
    capacity are cut.  Repeated rows are packed each; a null doc_id stays null.  Other columns
    are not read; an empty table gives no rows.
    """
    return assign(materialise(pieces(docs, vocabulary, capacity, with_ids=with_ids), "pack-pieces"), capacity, ["doc_id", "piece", "ids_crc32"])
