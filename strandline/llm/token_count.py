"""Token counts of a byte-level BPE vocabulary without emitting identifiers.

A text is cut into pre-tokens; each pre-token's symbols stand in a linked list and its adjacent
pairs in a heap.  The pair of lowest rank is popped and merged again and again; the count is the
initial symbols minus the merges.  Counts of words seen before come from a bounded cache.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-token pattern of byte-level vocabularies (fixed value of the published format).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose counts a worker remembers.
CACHE_WORDS = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where
    it is visible Latin-1, else the next one from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class _Unspaced(Exception):
    """Blanks meet at the edge of a word, so its pre-tokens depend on its neighbours."""


class _Remembered(dict):
    def __init__(self, count, most: int) -> None:
        super().__init__()
        self.count, self.most = count, most

    def __missing__(self, key: str) -> int:
        n = self.count(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = n
        return n


class Counter:
    """Counts tokens as the vocabulary file's own library does, special strings included."""

    def __init__(self, file: bytes, most: int = CACHE_WORDS) -> None:
        spec = json.loads(file)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain byte-level BPE vocabularies are counted here")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with strip or word rules are not counted here")
        ids = model["vocab"]
        self.first = [ids[s] for s in byte_symbols()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left], ids[right]] = rank, ids[left + right]
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.pieces = regex.compile(PRE_TOKEN).findall
        self.pre_token = _Remembered(self.merged, most).__getitem__
        self.bare = _Remembered(self.word, most).__getitem__
        self.spaced = _Remembered(lambda w: self.word(w, " "), most).__getitem__

    def merged(self, pre_token: str) -> int:
        """Symbols left of one pre-token when no adjacent pair can be merged."""
        symbol = [self.first[b] for b in pre_token.encode()]
        n = len(symbol)
        merges, after, before = self.merges, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for k in range(n - 1):
            found = merges.get((symbol[k], symbol[k + 1]))
            if found:
                heap.append((found[0], k, symbol[k], symbol[k + 1], found[1]))
        heapify(heap)
        count = n
        while heap:
            _, k, left, right, whole = heappop(heap)
            follower = after[k]
            if symbol[k] != left or follower >= n or symbol[follower] != right:
                continue
            symbol[k], symbol[follower] = whole, -1
            after[k] = behind = after[follower]
            count -= 1
            if behind < n:
                before[behind] = k
                found = merges.get((whole, symbol[behind]))
                if found:
                    heappush(heap, (found[0], k, whole, symbol[behind], found[1]))
            ahead = before[k]
            if ahead >= 0:
                found = merges.get((symbol[ahead], whole))
                if found:
                    heappush(heap, (found[0], ahead, symbol[ahead], whole, found[1]))
        return count

    def word(self, word: str, lead: str = "") -> int:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Unspaced
        return sum(map(self.pre_token, self.pieces(lead + word)))

    def plain(self, text: str) -> int:
        """Tokens of a text without added tokens.  Words between single spaces have pre-tokens of
        their own, so that whole words are looked up; else pre-tokens are."""
        if not text:
            return 0
        head, *rest = text.split(" ")
        try:
            return self.bare(head) + sum(map(self.spaced, rest))
        except _Unspaced:
            return sum(map(self.pre_token, self.pieces(text)))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.added is None or not self.added.search(text):
            return self.plain(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@lru_cache(maxsize=2)
def _counter(file: bytes) -> Counter:
    return Counter(file)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one for each row of ``docs`` (doc_id, text).

    ``vocabulary`` is the path, on the driver, of a byte-level BPE file; its bytes (a fixed size,
    about 2 MB) are broadcast.  A null text counts as empty: 0 bytes, 0 tokens.  Texts of any
    length are counted whole.  Repeated rows are counted each; other columns are not read.
    """
    with open(vocabulary, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(file.value)
        for batch in batches:
            n = np.fromiter((count(t.as_py()) for t in batch.column(1)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
