"""Quality rules as a bitmask ledger.

Every text is measured once and every rule evaluated once; the ledger keeps the measurements and
one failure bit a rule.  Policies are named, versioned masks over those bits, so that changing
one, comparing two or asking what a rule rejects on its own never reads a text again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import sparing_batches
from .textnum import BLANKS, Chunk, chunks, mix, ngrams, words


class Rule(NamedTuple):
    """``fails`` is SQL over the measurements; the rule's bit is its place in RULES."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("mostly_symbols", "n_symbols > 2 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 30 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("few_letters", "10 * n_letters < 3 * word_chars"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("adjacent_words", "5 * n_adjacent > n_words"),
)

#: Name of a policy version -> the rules whose failure rejects a text.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "corpus-1": ("few_words", "repeated_words", "mostly_symbols", "word_length", "repeated_lines", "few_letters"),
    "corpus-2": ("few_words", "repeated_words", "word_length", "repeated_lines", "few_letters", "many_symbols", "adjacent_words"),
}

_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_adjacent")
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC0, 256)]] = True
_WINDOW = 5


def _totals(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[starts[1:]] - total[starts[:-1]]


def _repeats(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For values of owners: which are equal to another of the same owner, and which to an
    earlier one."""
    own = mix(keys + mix(owner.astype(np.uint64)))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    later, shared = np.zeros(len(own), bool), np.zeros(len(own), bool)
    later[order[1:]] = same
    shared[order[1:]] = same
    shared[order[:-1]] |= same
    return shared, later


def measure(chunk: Chunk) -> dict[str, np.ndarray]:
    """The measurements of each text of a chunk."""
    count = len(chunk.starts) - 1
    text_of = np.arange(count)
    found = words(chunk, BLANKS, lower=False)
    n_words = np.diff(found.of_text)
    leads = (chunk.data & 0xC0) != 0x80
    inside = ~BLANKS[chunk.data]

    lines = words(chunk, _NEWLINE, lower=False)
    solid = np.concatenate(([0], np.cumsum(inside, dtype=np.int64)))
    worded = solid[lines.end] > solid[lines.start] if len(lines.start) else np.zeros(0, bool)
    line_of = np.repeat(text_of, np.diff(lines.of_text))[worded]
    _, later = _repeats(lines.hash[worded], line_of)

    word_of = np.repeat(text_of, n_words)
    again = (found.hash[1:] == found.hash[:-1]) & (word_of[1:] == word_of[:-1])
    repeated = np.zeros(len(word_of), np.int64)
    grams = ngrams(found.hash, _WINDOW)
    if len(grams):
        whole = word_of[: len(grams)] == word_of[_WINDOW - 1 :]
        at = np.flatnonzero(whole)
        shared, _ = _repeats(grams[at], word_of[at])
        step = np.zeros(len(word_of) + 1, np.int64)
        np.add.at(step, at[shared], 1)
        np.add.at(step, at[shared] + _WINDOW, -1)
        repeated = np.cumsum(step)[:-1] > 0
    return {
        "n_words": n_words,
        "word_chars": _totals(leads & inside, chunk.starts),
        "n_symbols": _totals(_SYMBOL[chunk.data], chunk.starts),
        "n_dup_lines": np.bincount(line_of[later], minlength=count),
        "n_repeat_words": np.bincount(word_of[repeated > 0], minlength=count),
        "n_lines": np.bincount(line_of, minlength=count),
        "n_letters": _totals(_LETTER[chunk.data], chunk.starts),
        "n_adjacent": np.bincount(word_of[1:][again], minlength=count),
    }


@sparing_batches
def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows' structs as they are, with the measurements of the ``text`` in them."""
    for batch in batches:
        row = batch.column(0)
        for chunk in chunks(row.field("text")):
            m = measure(chunk)
            part = row.slice(chunk.first, len(chunk.starts) - 1)
            yield pa.RecordBatch.from_arrays([part, *(pa.array(m[k].astype(np.int64)) for k in _MEASURES)], names=["row", *_MEASURES])


def _with_bits(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``rows`` as a struct, their measurements and failure bits."""
    if len(rules) > 62:
        raise ValueError("a ledger holds at most 62 rules")
    packed = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"))
    shape = f"row {packed.schema['row'].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in _MEASURES)
    bits = sum((F.when(F.expr(rule.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(rules)), F.lit(0).cast("long"))
    return packed.mapInArrow(_measured, shape).withColumn("fail_bits", bits)


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows (doc_id, measurements, fail_bits), one for each row of ``docs`` (doc_id, text).

    Words are runs of anything but blanks; n_adjacent of them equal the word before.  A null or empty text has no words, lines or symbols.
    Repeated rows are measured each; other columns are not read; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return _with_bits(rows, rules).select("row.doc_id", *_MEASURES, "fail_bits")


def mask(policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    """The bits of a policy's rules."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    place = {rule.name: k for k, rule in enumerate(rules)}
    return sum(1 << place[name] for name in set(names))


def passes(policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> Column:
    """True where a ledger row fails none of the policy's rules."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def ablation(rows: DataFrame, policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: texts that fail it, and texts that only it rejects, from a count
    of the ledger's distinct bit patterns (at most 2 to the number of rules).

    ``rows`` has ``fail_bits``; a null there counts for no rule, repeated rows count each, other
    columns are not read, and an empty table gives no rows."""
    whole = mask(policy, rules)
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    named = [F.struct(F.lit(rule.name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, rule in enumerate(rules) if whole >> k & 1]
    each = patterns.select("bits", "n", F.explode(F.array(*named)).alias("r"))
    has = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
    )


def judged(docs: DataFrame, policy: str = "corpus-2") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept``: the base rules and the policy's verdict.

    Null and empty texts have no words and so are not kept; a text of any length is read whole.
    Repeated rows are judged each; other columns are not read; an empty table gives no rows."""
    return ledger(docs).withColumn("base_failed", ~passes("base-1")).withColumn("kept", passes("base-1") & passes(policy))


def kept(docs: DataFrame, policy: str = "corpus-2") -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the policy, with all their columns, whatever
    their names.  Null and empty texts do not pass, repeated rows pass or fail together, and an
    empty table gives no rows."""
    passed = _with_bits(docs, RULES).where(passes("base-1") & passes(policy))
    return passed.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
