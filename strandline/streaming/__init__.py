"""The merge of overlapping ranges over a stream of them.

A source's ranges are folded in order of (start, end, order), as ``ranges.merge_ranges`` does over a
table.  A range waits in the source's state until the watermark has passed its start, when no earlier
one can come any more; a merged range leaves when the watermark has passed its end.  Ranges that
come later than the watermark allows are dropped by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

_TEXT = ("label", "needs_followup", "priority")
_RANK = {"high": 3, "medium": 2, "low": 1}


def _ratio(a: dict, b: dict) -> float:
    start, end = max(a["start"], b["start"]), min(a["end"], b["end"])
    return 0.0 if end <= start else (end - start) / min(a["end"] - a["start"], b["end"] - b["start"])


def _grow(last: dict, x: dict) -> dict:
    """``last`` with ``x`` merged into it."""
    label, more = last["label"] or "", x["label"] or ""
    mine, own = last["priority"] or "low", x["priority"] or "low"
    follow = (last["needs_followup"], x["needs_followup"])
    return {
        "start": min(last["start"], x["start"]), "end": max(last["end"], x["end"]), "count": last["count"] + 1,
        "label": x["label"] if not label else last["label"] if not more or label == more else f"{label}_{more}",
        "needs_followup": "yes" if "yes" in follow else follow[0] or follow[1],
        "priority": own if _RANK.get(own, 0) > _RANK.get(mine, 0) else mine,
    }


def fold(last: dict | None, rows: list[dict], threshold: float) -> tuple[list[dict], dict | None]:
    """What is finished and what is open after ``rows`` in order; null or NaN bounds are an error."""
    done = []
    for x in rows:
        if not (x["start"] == x["start"] and x["end"] == x["end"]):
            raise ValueError("range without bounds")
        if last is not None and _ratio(last, x) >= threshold:
            last = _grow(last, x)
        else:
            if last is not None:
                done.append(last)
            last = {**{k: x[k] for k in ("start", "end", *_TEXT)}, "count": 1}
    return done, last


def merge_stream(ranges: DataFrame, key: str, order: str, time: str, threshold: float = 0.5, late: str = "10 minutes") -> DataFrame:
    """(key, start, end, label, needs_followup, priority, merged_count) of merged ranges as they are
    finished, from a stream of ranges (key, order, start, end in seconds, label, needs_followup,
    priority) with their start as the timestamp ``time``; ``late`` is how far out of order they come.

    A source's state is the ranges that the watermark has not passed and one merged range."""
    kind = ranges.schema[key].dataType.simpleString()
    rows = ranges.select(key, F.col(order).cast("long").alias("_order"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), *(F.col(c).cast("string").alias(c) for c in _TEXT), F.col(time).alias("_time"))
    rows = rows.withWatermark("_time", late).withColumn("_ms", (F.unix_micros("_time") / 1000).cast("long"))

    def step(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        waiting, last, last_ms = json.loads(state.get[0]) if state.exists else ([], None, None)
        for batch in batches:
            plain = batch.astype(object).where(batch.notna(), None)
            for r in plain.to_dict("records"):
                waiting.append([r["start"], r["end"], int(r["_order"]), int(r["_ms"]), *(r[c] for c in _TEXT)])
        mark = state.getCurrentWatermarkMs()
        ready = sorted((r for r in waiting if r[3] < mark), key=lambda r: r[:3])
        waiting = [r for r in waiting if r[3] >= mark]
        done, last = fold(last, [{"start": r[0], "end": r[1], **dict(zip(_TEXT, r[4:], strict=True))} for r in ready], threshold)
        if ready:
            zero = ready[-1][3] - round(ready[-1][0] * 1000)  # a source's seconds as the stream's time
            last_ms = zero + round(last["end"] * 1000) + 1
        if last is not None and last_ms <= mark:
            done.append(last)
            last = None
        if waiting or last is not None:
            state.update((json.dumps((waiting, last, last_ms)),))
            due = min([r[3] + 1 for r in waiting] + ([last_ms] if last is not None else []))
            state.setTimeoutTimestamp(max(due, mark + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(*name, d["start"], d["end"], *(d[c] for c in _TEXT), d["count"]) for d in done], columns=[key, "start", "end", *_TEXT, "merged_count"])

    shape = f"{key} {kind}, start double, end double, label string, needs_followup string, priority string, merged_count long"
    return rows.groupBy(key).applyInPandasWithState(step, shape, "held string", "append", GroupStateTimeout.EventTimeTimeout)
