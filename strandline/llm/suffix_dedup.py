"""Removal of long byte strings that an earlier document has, by longest-previous-factor arrays.

A suffix array of the corpus holds every position's suffix; here only the suffixes that can match
are sorted, and only as deep as a match must be.

1. *Keys.*  A window of ``size`` bytes has as its key the least hash of the K-byte strings in it.
   Equal windows have equal keys wherever they stand, and neighbouring windows mostly share one, so
   that a document has about one run of windows for every (size - K + 2) / 2 bytes.
2. *Runs that can match.*  Keys are dealt out by value, once for each block of documents that
   holds them, and come back as the runs whose key some other document has.  A key with more than
   ``WIDE`` entries is split: each of its windows is then a run with a key of its own.
3. *Suffix order.*  The bytes of those runs meet by key.  Runs that are equal as a whole are equal
   suffixes, so they are told apart by hash first and only the one of least doc_id is sorted.  The
   windows of the different runs of a key are put in suffix order, with the longest common
   prefixes of neighbours.  The previous and the next entry with a smaller doc_id bound the
   longest factor that stands in an earlier document; where that is ``size`` or more, the window
   goes.
4. *Removal.*  A document's windows come back to it and their bytes are cut out.

Equal copies of a whole text take no part but for the first: they go whole.  Within a block, a run
is sent once however many of its documents hold it, so that a run that a third of all documents
share reaches a task once a block.  Blocks, pieces of the key order and the entries of a key have
bounds in bytes or rows, so that a task's memory does not grow with the corpus; a longer text is a
block of its own, cut into runs a segment at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialise, partitions
from .textnum import Chunk, _codes, _powers, chunks, mix

K = 20
BLOCK_BYTES = 1 << 19
#: Bytes of text whose keys and runs go to one piece of the key order.
PIECE_BYTES = 8 << 20
#: Entries of a key, beyond which its windows are dealt out one by one.
WIDE = 1 << 12
#: Windows put in suffix order at a time, beyond which a task goes on with the next keys.
WINDOWS_AT_ONCE = 1 << 17

_SENT = "piece int, block long, kind int, ids binary, a binary, b binary, c binary, d binary, e binary"
_SENT_ARROW = pa.schema([("piece", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), *((n, pa.binary()) for n in ("ids", "a", "b", "c", "d", "e"))])
_BACK = "block long, kind int, ids binary, a binary, b binary"
_BACK_ARROW = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("ids", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])
#: Kinds of rows: a block's documents, what is dealt to a piece, and what goes back to a block.
_DOCS, _DEALT, _FOUND, _WIDE = 0, 1, 2, 3


class Runs:
    """Maximal runs of windows with one key: first window's position, one past the last one's,
    key, text, number within the text, and a hash of all its bytes.  A run ends at a segment's end
    as well."""

    def __init__(self, chunk: Chunk, size: int, segment: int) -> None:
        count = len(chunk.starts) - 1
        last_start = max(len(chunk.data) - size + 1, 0)
        parts = [self._segment(chunk, size, lo, min(lo + segment, last_start)) for lo in range(0, last_start, segment)]
        self.at, self.to, self.key, self.owner, self.same = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int32, np.uint64))
        self.first = np.searchsorted(self.owner, np.arange(count + 1))
        self.number = np.arange(len(self.at)) - self.first[self.owner]

    @staticmethod
    def _segment(chunk: Chunk, size: int, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        """The runs of the windows that begin in lo..hi."""
        data = chunk.data[lo : hi + size - 1]
        n = len(data)
        power, inverse = _powers(n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_codes(False)[data] * power[:n], out=total[1:])
        low = mix((total[K:] - total[:-K]) * inverse[: n - K + 1])
        span, whole = 1, size - K + 1
        while 2 * span <= whole:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if whole > span:
            low = np.minimum(low[: -(whole - span)], low[whole - span :])
        low = mix(low)  # least hashes are small ones; mixed, they spread evenly over the pieces
        owner = np.searchsorted(chunk.starts, np.arange(lo, lo + n), "right").astype(np.int32) - 1
        at = np.flatnonzero(owner[: n - size + 1] == owner[size - 1 :])
        key, who = low[at], owner[at]
        edge = np.concatenate(([True], (key[1:] != key[:-1]) | (who[1:] != who[:-1]) | (at[1:] != at[:-1] + 1))) if len(at) else np.zeros(0, bool)
        begin = np.flatnonzero(edge)
        last = at[np.append(begin[1:], len(at)) - 1] if len(at) else at
        first = at[begin]
        end = last + size
        same = mix((total[end] - total[first]) * inverse[first] + (end - first).astype(np.uint64))
        return first + lo, last + 1 + lo, key[begin], who[begin], same


def _one_by_one(at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of runs, and which run each is of."""
    count = to - at
    run = np.repeat(np.arange(len(at)), count)
    return np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + at[run], run


def _window_hashes(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    out = np.full(len(at), size, np.uint64)
    code = _codes(False)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + code[data[at + k]]
    return mix(out)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _cuts(pieces: int) -> np.ndarray:
    return np.array([(k << 64) // pieces for k in range(1, pieces)], np.uint64)


def _ids(batch: pa.RecordBatch, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    part = batch.slice(chunk.first, len(chunk.starts) - 1)
    return part.column(0).to_numpy(), part.column(1).to_numpy()


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted values: the number of each one's group, and where groups begin."""
    edge = np.concatenate(([True], values[1:] != values[:-1])) if len(values) else np.zeros(0, bool)
    return np.cumsum(edge) - 1, np.flatnonzero(edge)


def _deal_keys(size: int, pieces: int, block_bytes: int):
    cuts = _cuts(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for chunk in chunks(batch.column(2), block_bytes):
                block += 1
                ids, marks = _ids(batch, chunk)
                runs = Runs(chunk, size, block_bytes)
                order = np.argsort(runs.key, kind="stable")
                key, who, number = runs.key[order], runs.owner[order].astype(np.int32), runs.number[order].astype(np.int32)
                group, begin = _groups(key)
                many = np.zeros(len(begin), bool)
                if len(key):
                    many[group[who != who[begin][group]]] = True
                shared = many[group] if len(key) else np.zeros(0, bool)
                rows = [(block % pieces, block, _DOCS, None, ids.tobytes(), marks.tobytes(), None, None, None)]
                if shared.any():
                    rows.append((block % pieces, block, _FOUND, key[shared].tobytes(), who[shared].tobytes(), number[shared].tobytes(), None, None, None))
                one, one_who, one_number, both = key[~shared], who[~shared], number[~shared], key[begin][many] if len(key) else key
                at, to = np.searchsorted(one, cuts), np.searchsorted(both, cuts)
                for k, (x, y, z, m) in enumerate(zip(np.split(one, at), np.split(one_who, at), np.split(one_number, at), np.split(both, to), strict=True)):
                    if len(x) or len(m):
                        rows.append((k, block, _DEALT, None, x.tobytes(), y.astype(np.uint16 if len(ids) < 65536 else np.int32).tobytes(), z.tobytes(), m.tobytes(), None))
                yield _batch(rows, _SENT_ARROW)

    return run


def _numbers(data: bytes, count: int) -> np.ndarray:
    """Unsigned numbers written in two or in four bytes each."""
    return np.frombuffer(data, np.uint16 if len(data) == 2 * count else np.int32).astype(np.int32)


def _passed(table: pa.Table) -> list[tuple]:
    kept = table.filter(pa.array(table["kind"].to_numpy() != _DEALT))
    return [(r["block"], r["kind"], r["ids"], r["a"], r["b"]) for r in kept.select(["block", "kind", "ids", "a", "b"]).to_pylist()]


def _returned(rows: list[tuple]) -> pa.Table:
    if not rows:
        return _BACK_ARROW.empty_table()
    return pa.Table.from_batches([_batch(rows, _BACK_ARROW)])


def _find_shared(wide_from: int):
    """In one piece of the key order: the runs whose key stands in more than one document, as
    -1 - number where the key is wide, and for each block which of its shared keys are wide."""

    def run(table: pa.Table) -> pa.Table:
        out = _passed(table)
        dealt = table.filter(pa.array(table["kind"].to_numpy() == _DEALT)).to_pylist()
        if dealt:
            keys = [np.frombuffer(r["a"], np.uint64) for r in dealt]
            who = [_numbers(r["b"], len(k)) for r, k in zip(dealt, keys, strict=True)]
            source = np.concatenate([np.int64(n << 32) + w for n, w in enumerate(who)])
            number = np.concatenate([np.frombuffer(r["c"], np.int32) for r in dealt])
            many = [np.frombuffer(r["d"], np.uint64) for r in dealt]
            keys = np.concatenate(keys)
            distinct, entries = np.unique(np.concatenate([keys, *many]), return_counts=True)
            wide = distinct[entries > wide_from]
            order = np.argsort(keys, kind="stable")
            keys, source, number = keys[order], source[order], number[order]
            group, begin = _groups(keys)
            shared = np.zeros(len(begin), bool)
            if len(keys):
                shared[group[source != source[begin][group]]] = True
                held = np.unique(np.concatenate(many))
                if len(held):
                    shared |= held[np.minimum(np.searchsorted(held, keys[begin]), len(held) - 1)] == keys[begin]
                number = np.where(np.isin(keys, wide), -1 - number, number).astype(np.int32)
                source, number = source[shared[group]], number[shared[group]]
                order = np.argsort(source, kind="stable")
                source, number = source[order], number[order]
                where = np.searchsorted(source >> 32, np.arange(len(dealt) + 1))
                for r, lo, hi in zip(dealt, where[:-1], where[1:], strict=True):
                    if hi > lo:
                        out.append((r["block"], _FOUND, None, (source[lo:hi] & 0xFFFFFFFF).astype(np.int32).tobytes(), number[lo:hi].tobytes()))
            if len(wide):
                for r, own in zip(dealt, many, strict=True):
                    if (hot := own[np.isin(own, wide)]).size:
                        out.append((r["block"], _WIDE, hot.tobytes(), None, None))
        return _returned(out)

    return run


def _by_text(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """A block's ids and marks, and for each text what was found in it: arrays of ``width`` numbers."""
    kind = table["kind"].to_numpy()
    (doc,) = table.filter(pa.array(kind == _DOCS)).to_pylist()
    ids, marks = np.frombuffer(doc["a"], np.int64), np.frombuffer(doc["b"], np.int64)
    found = table.filter(pa.array(kind == _FOUND)).to_pylist()
    if not found:
        return ids, marks, np.zeros(0, np.int64), []
    wide = [np.frombuffer(x.as_py(), np.uint64) for x in table.filter(pa.array(kind == _WIDE))["ids"]]
    wide = np.concatenate(wide) if wide else np.zeros(0, np.uint64)
    who, what = [], []
    for r in found:
        part = np.frombuffer(r["b"], np.int32)
        if r["ids"] is not None and len(wide):
            part = np.where(np.isin(np.frombuffer(r["ids"], np.uint64), wide), -1 - part, part)
        who.append(np.frombuffer(r["a"], np.int32))
        what.append(part.reshape(-1, width))
    who, what = np.concatenate(who), np.concatenate(what)
    order = np.lexsort((what[:, 0], who))
    who, what = who[order], what[order]
    texts, begin = np.unique(who, return_index=True)
    return ids, marks, texts, np.split(what, begin[1:])


def _collect(width: int):
    def run(table: pa.Table) -> pa.Table:
        ids, marks, texts, parts = _by_text(table, width)
        return pa.table({"doc_id": pa.array(ids[texts] if len(texts) else ids[:0]), "mark": pa.array(marks[texts] if len(texts) else marks[:0]), "found": pa.array([np.ascontiguousarray(p).tobytes() for p in parts], pa.binary())})

    return run


def _deal_bytes(size: int, pieces: int, block_bytes: int):
    cuts = _cuts(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for chunk in chunks(batch.column(2), block_bytes):
                block += 1
                ids, marks = _ids(batch, chunk)
                runs = Runs(chunk, size, block_bytes)
                flagged = [np.frombuffer(f.as_py(), np.int32) for f in batch.column(3).slice(chunk.first, len(ids))]
                wide = np.concatenate(flagged) < 0
                pick = np.concatenate([runs.first[k] + np.where(f < 0, -1 - f, f) for k, f in enumerate(flagged)])
                rows = [(block % pieces, block, _DOCS, None, ids.tobytes(), marks.tobytes(), None, None, None)]
                if len(pick):
                    at, to, key, who, same = runs.at[pick], runs.to[pick], runs.key[pick], runs.owner[pick], runs.same[pick]
                    if wide.any():
                        alone, of = _one_by_one(at[wide], to[wide])
                        own = _window_hashes(chunk.data, alone, size)
                        at, to = np.concatenate((at[~wide], alone)), np.concatenate((to[~wide], alone + 1))
                        key, same, who = np.concatenate((key[~wide], own)), np.concatenate((same[~wide], own)), np.concatenate((who[~wide], who[wide][of]))
                    to = to + size - 1
                    order = np.lexsort((ids[who], same, key))
                    at, to, key, who, same = at[order], to[order], key[order], who[order], same[order]
                    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (same[1:] != same[:-1])))
                    least = ids[who][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
                    later = ids[who] > least
                    begin = at - chunk.starts[who]
                    if later.any():
                        spans = np.stack([begin[later], begin[later] + (to - at)[later]], 1).astype(np.int32)
                        rows.append((block % pieces, block, _FOUND, None, who[later].astype(np.int32).tobytes(), spans.tobytes(), None, None, None))
                    at, to, key, who, begin, same = at[~later], to[~later], key[~later], who[~later], begin[~later], same[~later]
                    where = np.concatenate(([0], np.searchsorted(key, cuts), [len(key)]))
                    long = to - at
                    for k, (lo, hi) in enumerate(zip(where[:-1], where[1:], strict=True)):
                        if hi > lo:
                            spots, _ = _one_by_one(at[lo:hi], to[lo:hi])
                            rows.append((k, block, _DEALT, who[lo:hi].astype(np.int32).tobytes(), key[lo:hi].tobytes() + same[lo:hi].tobytes(), ids[who[lo:hi]].tobytes(), begin[lo:hi].astype(np.int32).tobytes(), long[lo:hi].astype(np.int32).tobytes(), chunk.data[spots].tobytes()))
                yield _batch(rows, _SENT_ARROW)

    return run


def _toward_smaller(ids: np.ndarray, shared: np.ndarray, size: int) -> np.ndarray:
    """For entries in suffix order: the longest prefix, up to ``size``, shared with the nearest
    entry before that has a smaller id.  ``shared[i]``: common prefix of entries i - 1 and i."""
    here = np.arange(len(ids))
    prev, both = here - 1, shared.copy()
    while True:
        step = np.flatnonzero((prev >= 0) & (both >= size))
        step = step[ids[prev[step]] >= ids[step]]
        if not len(step):
            break
        over = prev[step]
        both[step] = np.minimum(both[step], both[over])
        prev[step] = prev[over]
    return np.where(prev >= 0, both, 0)


def earlier_factors(windows: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
    """For windows of ``size`` bytes (one row each) of texts ``ids``: is the longest factor that
    an earlier text shares with the suffix there at least ``size`` long?"""
    text = np.ascontiguousarray(windows).view(f"S{size}").ravel()
    order = np.argsort(text, kind="stable")
    near = windows[order]
    differ = near[1:] != near[:-1]
    shared = np.concatenate(([0], np.where(differ.any(1), differ.argmax(1), size)))
    docs = ids[order]
    before = _toward_smaller(docs, shared, size)
    after = _toward_smaller(docs[::-1], np.concatenate(([0], shared[:0:-1])), size)[::-1]
    out = np.zeros(len(ids), bool)
    out[order] = np.maximum(before, after) >= size
    return out


def _find_earlier(size: int):
    def run(table: pa.Table) -> pa.Table:
        out = _passed(table)
        dealt = table.filter(pa.array(table["kind"].to_numpy() == _DEALT)).to_pylist()
        if not dealt:
            return _returned(out)
        who = [np.frombuffer(r["ids"], np.int32) for r in dealt]
        source = np.repeat(np.arange(len(dealt)), [len(w) for w in who])
        who = np.concatenate(who)
        both = [np.frombuffer(r["a"], np.uint64).reshape(2, -1) for r in dealt]
        key, same = (np.concatenate([b[k] for b in both]) for k in (0, 1))
        ids = np.concatenate([np.frombuffer(r["b"], np.int64) for r in dealt])
        begin = np.concatenate([np.frombuffer(r["c"], np.int32) for r in dealt])
        long = np.concatenate([np.frombuffer(r["d"], np.int32) for r in dealt]).astype(np.int64)
        data = np.concatenate([np.frombuffer(r["e"], np.uint8) for r in dealt])
        at = np.concatenate(([0], np.cumsum(long)[:-1]))
        # Runs equal as a whole: all but the first document's go.
        order = np.lexsort((ids, same, key))
        fresh = np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (same[order][1:] != same[order][:-1])))
        least = np.empty(len(ids), np.int64)
        least[order] = ids[order][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        later = ids > least
        # One run of each kind goes into suffix order, where its key has several kinds.
        kinds = order[fresh]
        group, start = _groups(key[kinds])
        some = np.bincount(group)[group] > 1
        rep = kinds[some]
        gone = np.zeros(len(data) + 1, bool)
        windows = long[rep] - size + 1
        # Equal windows have one key, so whole keys are put in order apart, some windows at a time.
        cuts = np.flatnonzero(np.diff(key[rep])) + 1 if len(rep) else rep
        upto = np.cumsum(windows)
        lo = 0
        while lo < len(rep):
            far = np.searchsorted(upto, (upto[lo - 1] if lo else 0) + WINDOWS_AT_ONCE, "right")
            later_cuts = cuts[cuts > lo]
            within = later_cuts[later_cuts <= far]
            hi = int(within[-1]) if len(within) else int(later_cuts[0]) if len(later_cuts) else len(rep)
            if far >= len(rep):
                hi = len(rep)
            own, count = rep[lo:hi], windows[lo:hi]
            spot = np.repeat(at[own] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            view = np.lib.stride_tricks.sliding_window_view(data, size)
            gone[spot] = earlier_factors(view[spot], np.repeat(ids[own], count), size)
            lo = hi
        # A document's other runs of a kind fare as the one that was sorted.
        kind_of = np.empty(len(ids), np.int64)
        kind_of[order] = np.cumsum(fresh) - 1
        twin = kinds[kind_of]
        spans_who, spans_source, spans = [], [], []
        if later.any():
            spans_who.append(who[later])
            spans_source.append(source[later])
            spans.append(np.stack([begin[later], begin[later] + long[later]], 1))
        mine = np.flatnonzero(~later)
        mine = mine[np.isin(twin[mine], rep)] if len(rep) else mine[:0]
        if len(mine):
            count = long[mine] - size + 1
            base = np.repeat(at[twin[mine]] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            hit = gone[base]
            run_of = np.repeat(np.arange(len(mine)), count)
            edge = np.flatnonzero(hit & np.concatenate(([True], ~hit[:-1] | (run_of[1:] != run_of[:-1]))))
            last = np.flatnonzero(hit & np.concatenate((~hit[1:] | (run_of[1:] != run_of[:-1]), [True])))
            own = mine[run_of[edge]]
            inner = np.arange(len(hit)) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
            spans_who.append(who[own])
            spans_source.append(source[own])
            spans.append(np.stack([begin[own] + inner[edge], begin[own] + inner[last] + size], 1))
        if spans:
            source, who, spans = np.concatenate(spans_source), np.concatenate(spans_who), np.concatenate(spans).astype(np.int32)
            order = np.argsort(source, kind="stable")
            where = np.searchsorted(source[order], np.arange(len(dealt) + 1))
            for r, lo, hi in zip(dealt, where[:-1], where[1:], strict=True):
                if hi > lo:
                    out.append((r["block"], _FOUND, None, who[order[lo:hi]].astype(np.int32).tobytes(), np.ascontiguousarray(spans[order[lo:hi]]).tobytes()))
        return _returned(out)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, spans, sha, kept = [], [], [], []
        for text, found in zip(batch.column(2), batch.column(3), strict=True):
            data = np.frombuffer(text.as_py(), np.uint8)
            step = np.zeros(len(data) + 1, np.int32)
            pairs = np.frombuffer(found.as_py(), np.int32).reshape(-1, 2)
            np.add.at(step, pairs[:, 0], 1)
            np.add.at(step, pairs[:, 1], -1)
            gone = np.cumsum(step[:-1]) > 0
            removed.append(int(gone.sum()))
            spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            rest = data[~gone].tobytes()
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha), pa.array(kept, pa.binary())], names=["doc_id", "mark", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_earlier_copies(docs: DataFrame, size: int = 50, with_kept: bool = False, wide_from: int = WIDE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]), one for each row of
    ``docs`` (doc_id, text).

    Every byte of a text that a ``size``-byte string covers which also starts in a document with
    a smaller doc_id is removed; what counts is the input, not what is left.  Strings don't cross
    documents, and copies within one document stay.  ``kept`` (binary, as a cut may fall inside a
    character) has the remaining bytes.

    Null and empty texts have no bytes.  Documents with equal ids don't remove from each other.
    A row without doc_id is left whole and removes nothing.  Repeated rows are all returned; other
    columns are not read; an empty table gives no rows.
    """
    if size <= K:
        raise ValueError(f"matches must be longer than {K} bytes")
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    rows = materialise(text.select("doc_id", "mark", F.xxhash64(F.lit(1), "text").alias("mark2"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "suffix-rows")
    pieces = max(partitions(spark), (rows.agg(F.sum("n_bytes")).first()[0] or 0) // PIECE_BYTES + 1)
    key = ["n_bytes", "mark", "mark2"]
    firsts = materialise(rows.groupBy(*key).agg(F.min("doc_id").alias("first")), "suffix-firsts")

    bare = text.where(F.col("doc_id").isNotNull()).select("doc_id", "mark", F.col("text").cast("binary").alias("text"))
    keyed = bare.mapInArrow(_deal_keys(size, pieces, block_bytes), _SENT).groupBy("piece").applyInArrow(_find_shared(wide_from), _BACK)
    flags = keyed.groupBy("block").applyInArrow(_collect(1), "doc_id long, mark long, found binary")
    leads = firsts.select(F.col("first").alias("doc_id"), "mark")
    open_texts = materialise(flags.join(leads, ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"]), "suffix-flags")
    held = materialise(bare.join(open_texts, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]).select("doc_id", "mark", "text", "found"), "suffix-held")

    discard(open_texts)

    sent = held.mapInArrow(_deal_bytes(size, pieces, block_bytes), _SENT).groupBy("piece").applyInArrow(_find_earlier(size), _BACK)
    spans = materialise(sent.groupBy("block").applyInArrow(_collect(2), "doc_id long, mark long, found binary"), "suffix-spans")
    done = held.drop("found").join(spans, ["doc_id", "mark"]).mapInArrow(_cut, "doc_id long, mark long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    done = materialise(done if with_kept else done.drop("kept"), "suffix-done")
    discard(held, spans)

    whole = rows.join(firsts, key, "left").join(done, ["doc_id", "mark"], "left")
    copy = F.coalesce((F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= size), F.lit(False))
    out = whole.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *([copy.alias("_copy"), "mark", "kept"] if with_kept else []),
    )
    if not with_kept:
        return out
    untouched = text.select("doc_id", "mark", F.col("text").cast("binary").alias("_text")).dropDuplicates(["doc_id", "mark"])
    same = F.col("o.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("o.mark") == F.col("t.mark"))
    joined = out.alias("o").join(untouched.alias("t"), same, "left")
    return joined.select("o.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.when(F.col("_copy"), F.lit(b"")).otherwise(F.coalesce("kept", "_text")).alias("kept"))
