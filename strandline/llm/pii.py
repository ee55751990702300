"""Personal data and secrets: candidate spans scored by boosted trees, all in DataFrame operations.

1. *Base spans.*  Four exact kinds (email, ip, card, phone) are found and checked; they always stay.
2. *Candidates.*  High-recall generators propose further spans, which may overlap.
3. *Scores.*  Each candidate's format and the words before and after it are features of a
   gradient-boosted forest, compiled into one SQL expression.
4. *Selection.*  Scores are calibrated on held-out examples, and a threshold per generator, taken
   there at a stated precision, selects what is redacted; the best of overlapping spans wins.

A text's spans are arrays in its row: nothing is shuffled, and no text leaves the JVM.  The forest
is fitted on examples that ``training_examples`` makes, TRAINING_ROWS of them, a fixed bound that
doesn't depend on the corpus.
"""

from __future__ import annotations

import json
import random
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Examples the forest is fitted and calibrated on.
TRAINING_ROWS = 3000
HELD_OUT = 0.3
PRECISION = 0.97

_SPAN = "struct<start:int,end:int,str:string>"
_SPANS = f"array<{_SPAN}>"

#: Base kinds in their order, as patterns without needless backtracking: a match starts where a
#: run of its characters starts, or where the match before ended.
BASE = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)

#: Generators of candidates: kind and pattern.  Several may propose the same or overlapping spans,
#: of any length.  A long run of digits, blanks and hyphens without an end for ``account`` is matched
#: to its end, so that it is read once; ``with_candidates`` then drops it.
GENERATORS = (
    ("secret", r"(?i:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key)[\x20]?[=:][\x20]?[\"']?[^\s\"',;]{6,}+[\"']?"),
    ("key", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+"),
    ("tel", r"(?<![0-9+(-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9-])"),
    ("nationalid", r"(?<![0-9-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9-])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("account", r"(?<![0-9.-])[0-9](?:[0-9\x20-]{6,}[0-9](?![0-9.-])|(?=[0-9\x20-]{64})[0-9\x20-]*+\.?+)"),
    ("mac", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])"),
    ("birthdate", r"(?<![0-9./-])[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}(?![0-9./-])"),
)

KINDS = tuple(k for k, _ in BASE) + tuple(k for k, _ in GENERATORS)


def _spans(hits: str, gaps: str) -> Column:
    """Places of a pattern's matches, from the matches and what stands between them."""
    both = F.zip_with(F.col(hits), F.slice(F.col(gaps), F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("h"), F.length(g).alias("skip")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["skip"]
        end = start + F.length(x["h"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["h"].alias("str")))).alias("out"))

    return F.aggregate(both, begin, step, lambda acc: acc["out"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""

    def worth(c: Column, k: Column) -> Column:
        d = c.cast("int")
        return F.when(k % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
        return s.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        n = F.length(_digits(s))
        return F.when((n >= 14) & (n <= 19), luhn(_digits(s))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(s)).between(10, 15)
    return F.lit(True)


def _found(rows: DataFrame, patterns: tuple[tuple[str, str], ...], guards: dict[str, Column], prefix: str) -> DataFrame:
    """Add ``{prefix}{kind}``, the array of spans of each pattern, to rows with ``text``."""
    none = F.array().cast("array<string>")
    raw = {}
    for kind, pattern in patterns:
        guard = guards.get(kind, guards["*"])
        raw[f"_h_{kind}"] = F.when(guard, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none)
    rows = rows.withColumns(raw)
    rows = rows.withColumns({f"_g_{kind}": F.when(F.size(f"_h_{kind}") > 0, F.split("text", pattern, -1)).otherwise(none) for kind, pattern in patterns})
    rows = rows.withColumns({f"{prefix}{kind}": F.when(F.size(f"_h_{kind}") > 0, _spans(f"_h_{kind}", f"_g_{kind}")).otherwise(F.array().cast(_SPANS)) for kind, _ in patterns})
    return rows.drop(*(f"_{x}_{kind}" for kind, _ in patterns for x in "hg"))


def with_base(rows: DataFrame) -> DataFrame:
    """Add ``base``, the sorted base spans (start, kind, end, str), to rows with ``text``."""
    text = F.col("text")
    digit = text.rlike("[0-9]")
    guards = {"*": digit, "email": text.contains("@"), "ip": digit & text.contains("."), "phone": text.contains("+")}
    rows = _found(rows, BASE, guards, "_b_")

    def kept(k: int, kind: str) -> Column:
        fine = F.filter(F.col(f"_b_{kind}"), lambda s: _valid(kind, s["str"]))
        return F.transform(fine, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["str"].alias("str")))

    found = F.array_sort(F.concat(*(kept(k, kind) for k, (kind, _) in enumerate(BASE))))
    return rows.withColumn("base", found).drop(*(f"_b_{kind}" for kind, _ in BASE))


# Features of a candidate: its generator, format and context.
FEATURES = ("generator", "length", "digit_share", "upper_share", "lower_share", "mark_share", "distinct_share", "luhn", "hex", "said_secret", "said_contact", "said_person", "said_other", "joined_left", "joined_right", "switches")
_SAID = {
    "said_secret": r"(?i)(pass|pwd|secret|token|key|auth|credential|login|bearer|aws|akia)",
    "said_contact": r"(?i)(phone|tel|call|fax|mobile|cell|dial|whatsapp|sms)",
    "said_person": r"(?i)(ssn|social|tax|passport|licen[cs]e|iban|account|acct|card|bank|born|dob|birth|patient|member|mac|device|national|id\b)",
    "said_other": r"(?i)(version|release|order|invoice|isbn|commit|sha|md5|checksum|page|ref|figure|table|section|build|serial|sku|item|issue|ticket|posted|updated|published|since)",
}


def _features(c: Column, text: Column) -> Column:
    s, n = c["str"], F.length(c["str"]).cast("double")
    left = F.substring(text, F.greatest(F.lit(1), c["start"] - 23), F.least(F.lit(24), c["start"]))
    right = F.substring(text, c["end"] + 1, F.lit(1))
    body = F.regexp_replace(s, r"^(?i:[a-z _-]+)[=:][\x20]?[\"']?|[\"']$", "")
    share = lambda p: F.length(F.regexp_replace(s, p, "")) / n
    said = F.concat(left, F.when(c["gen"] == 0, F.substring(s, F.lit(1), F.lit(14))).otherwise(""))
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    digits = _digits(s)
    return F.array(
        c["gen"].cast("double"),
        n,
        share("[^0-9]"),
        share("[^A-Z]"),
        share("[^a-z]"),
        share("[A-Za-z0-9]"),
        F.size(F.array_distinct(F.split(s, ""))) / n,
        flag(F.when(F.length(digits).between(8, 19), luhn(digits)).otherwise(False)),
        flag(body.rlike("^[0-9a-fA-F]{8,}$")),
        *(flag(said.rlike(p)) for p in _SAID.values()),
        flag(left.rlike("[A-Za-z0-9]$")),
        flag(right.rlike("^[A-Za-z0-9]")),
        F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[0-9]+", "0"), "[A-Za-z]+", "a"), "[^0a]", "")) / n,
    )


def with_candidates(rows: DataFrame) -> DataFrame:
    """Add ``candidates``: (start, end, str, gen, f), f being the FEATURES, to rows with ``text``."""
    text = F.col("text")
    digit = text.rlike("[0-9]")
    guards = {"*": digit, "secret": text.contains("=") | text.contains(":"), "mac": text.contains(":")}
    rows = _found(rows, GENERATORS, guards, "_c_")

    def proposed(k: int, kind: str) -> Column:
        found = F.col(f"_c_{kind}")
        if kind == "account":
            found = F.filter(found, lambda s: s["str"].rlike("[0-9]$") & ~F.substring(text, s["end"] + 1, F.lit(1)).isin(".", "-"))
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["str"].alias("str"), F.lit(k).alias("gen")))

    rows = rows.withColumn("candidates", F.concat(*(proposed(k, kind) for k, (kind, _) in enumerate(GENERATORS)))).drop(*(f"_c_{kind}" for kind, _ in GENERATORS))
    return rows.withColumn("candidates", F.transform("candidates", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["str"].alias("str"), c["gen"].alias("gen"), _features(c, F.col("text")).alias("f"))))


class Forest(NamedTuple):
    """Trees as nested (feature, cut, low, high) or leaf values; a calibration, and for each
    generator the least probability at which a candidate is taken."""

    trees: tuple
    slope: float
    offset: float
    thresholds: tuple[float, ...]


def training_examples(n: int = TRAINING_ROWS, seed: int = 7) -> list[dict]:
    """Made-up sentences, each with one planted string and whether it should be redacted."""
    rng = random.Random(seed)
    pick = rng.choice
    number = lambda k: "".join(pick("0123456789") for _ in range(k))
    of = lambda letters, k: "".join(pick(letters) for _ in range(k))
    upper, low, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    word = lambda: of(low, rng.randint(2, 9))
    long = lambda a, b: rng.randint(65, 900) if rng.random() < 0.25 else rng.randint(a, b)
    sep = lambda: pick(" -.")

    def tel() -> str:
        s = pick(" -.")
        return pick(("{0}{3}{1}{3}{2}", "({0}) {1}-{2}")).format(number(3), number(3), number(4), s)

    def date() -> str:
        s = pick("./-")
        return f"{rng.randint(1, 28)}{s}{rng.randint(1, 12)}{s}{rng.randint(1930, 2020)}"

    def iban() -> str:
        return of(upper, 2) + number(2) + "".join(pick(("", " ")) + number(4) for _ in range(rng.randint(3, 5)))

    mac = lambda: ":".join(of(hexa, 2) for _ in range(6))
    good = (
        lambda: ("", pick(("AKIA", "ASIA")) + of(upper + "234567", 16)),
        lambda: ("", pick(("password", "passwd", "pwd", "secret")) + pick("=:") + of(hexa + low, long(8, 24))),
        lambda: ("", pick(("token", "api_key", "access_key", "secret")) + pick((" = ", "=", ": ")) + '"' + of(hexa, pick((32, 40, 48, long(48, 64)))) + '"'),
        lambda: (pick(("key ", "token ", "bearer ", "auth ", "secret ")), of(upper + low + "0123456789", long(20, 44))),
        lambda: (pick(("", "", "call ", "phone ", "tel: ", "mobile ")), tel()),
        lambda: (pick(("SSN ", "social security ", "ssn: ", "")), f"{number(3)}-{number(2)}-{number(4)}"),
        lambda: (pick(("IBAN ", "account ", "")), iban()),
        lambda: (pick(("account ", "bank account ", "card ", "acct ")), number(rng.randint(8, 18) if rng.random() < 0.8 else rng.randint(19, 60))),
        lambda: (pick(("mac ", "device ", "")), mac()),
        lambda: (pick(("born ", "born on ", "date of birth ", "dob: ")), date()),
    )
    bad = (
        lambda: (pick(("commit ", "sha ", "checksum ", "md5 ")), of(hexa, pick((32, 40, 64, 128)))),
        lambda: ("", of(low, rng.randint(16, 30))),
        lambda: ("", of(upper, rng.randint(16, 24))),
        lambda: ("", "-".join(word() for _ in range(rng.randint(3, 6))) + pick(("", "-" + number(2)))),
        lambda: ("", "/".join(word() for _ in range(pick((rng.randint(3, 6), rng.randint(3, 6), rng.randint(12, 90))))) + "/" + number(pick((1, 4)))),
        lambda: (pick(("order ", "invoice ", "ticket ", "ref ", "isbn ", "item ")), number(rng.randint(8, 13))),
        lambda: (pick(("", "", "published ", "updated ", "posted ", "since ")), date()),
        lambda: ("", " ".join(number(rng.randint(1, 3)) for _ in range(rng.randint(4, 8)))),
        lambda: (pick(("version ", "build ", "release ", "section ")), sep().join((number(3), number(3), number(4)))),
        lambda: (pick(("order ", "serial ", "sku ")), of(upper + "0123456789", rng.randint(16, 20))),
        lambda: ("", f"{rng.randint(1900, 2020)}-{rng.randint(1900, 2020)} {number(4)}"),
        lambda: ("", pick(("key", "token", "secret")) + ": " + word() + word()),
    )
    out = []
    for k in range(n):
        wanted = k % 2 == 0
        before, planted = pick(good if wanted else bad)()
        head = " ".join(word() for _ in range(rng.randint(0, 5)))
        head = (head + " " if head else "") + before
        text = head + planted + pick((" ", ". ", ", ", "\n", "")) + " ".join(word() for _ in range(rng.randint(0, 5)))
        out.append({"text": text, "s": len(head), "e": len(head) + len(planted), "y": int(wanted)})
    return out


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int):
    """One regression tree on gradients and curvatures; the leaf is a Newton step."""
    if depth:
        best = (1e-6, None, None)
        base = g.sum() ** 2 / (h.sum() + 1)
        for k, own in enumerate(cuts):
            for cut in own:
                low = x[:, k] <= cut
                a, b = h[low].sum(), h[~low].sum()
                if a < 3 or b < 3:
                    continue
                gain = g[low].sum() ** 2 / (a + 1) + g[~low].sum() ** 2 / (b + 1) - base
                if gain > best[0]:
                    best = (gain, k, cut)
        if best[1] is not None:
            low = x[:, best[1]] <= best[2]
            return best[1], float(best[2]), _grow(x[low], g[low], h[low], cuts, depth - 1), _grow(x[~low], g[~low], h[~low], cuts, depth - 1)
    return float(-0.4 * g.sum() / (h.sum() + 1))


def _value(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    k, cut, low, high = tree
    return np.where(x[:, k] <= cut, _value(low, x), _value(high, x))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 20, depth: int = 3, seed: int = 7) -> Forest:
    """Boost ``rounds`` trees on most rows; calibrate and set thresholds on those held out."""
    held = np.random.default_rng(seed).random(len(y)) < HELD_OUT
    a, b = x[~held], y[~held]
    cuts = [np.unique(np.quantile(a[:, k], np.linspace(0, 1, 12)[1:-1])) for k in range(a.shape[1])]
    score, trees = np.zeros(len(b)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(_grow(a, p - b, p * (1 - p), cuts, depth))
        score += _value(trees[-1], a)
    raw = sum(_value(t, x[held]) for t in trees)
    slope, offset, target = 1.0, 0.0, y[held]
    for _ in range(30):  # logistic calibration by Newton steps
        p = 1 / (1 + np.exp(-(slope * raw + offset)))
        w = p * (1 - p)
        grad = np.array([((p - target) * raw).sum() + 1e-3 * (slope - 1), (p - target).sum() + 1e-3 * offset])
        curve = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-3]])
        slope, offset = np.array([slope, offset]) - np.linalg.solve(curve, grad)
    p = 1 / (1 + np.exp(-(slope * raw + offset)))
    thresholds = []
    for k in range(len(GENERATORS)):
        own = x[held][:, 0] == k
        order = np.argsort(-p[own], kind="stable")
        right = np.cumsum(target[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= PRECISION)
        if not len(good):
            raise ValueError(f"generator {GENERATORS[k][0]}: none of {int(own.sum())} held-out candidates is taken at precision {PRECISION}; it would be off")
        thresholds.append(max(0.5, float(p[own][order][good[-1]])))
    return Forest(tuple(trees), float(slope), float(offset), tuple(thresholds))


#: Fitted forests by the number of training examples, from which they follow.
_FITTED: dict[int, Forest] = {}


def _fitted(spark: SparkSession, n: int) -> Forest:
    if n in _FITTED:
        return _FITTED[n]
    made = json.dumps(training_examples(n))
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(made), "array<struct<text: string, s: int, e: int, y: int>>")).alias("m")).select("m.*")
    got = with_candidates(rows).select("s", "e", "y", F.explode("candidates").alias("c")).select("s", "e", "y", "c.start", "c.end", "c.f").orderBy("s", "e", "c.start", "c.f").collect()
    x = np.array([r["f"] for r in got])
    y = np.array([r["y"] if r["start"] < r["e"] and r["end"] > r["s"] else 0 for r in got], float)
    return _FITTED.setdefault(n, fit(x, y))


def _tree_sql(tree, f: str) -> str:
    if isinstance(tree, float):
        return f"{tree!r}D"
    k, cut, low, high = tree
    return f"if(element_at({f}, {k + 1}) <= {cut!r}D, {_tree_sql(low, f)}, {_tree_sql(high, f)})"


def with_spans(rows: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """Add ``base`` and ``spans``, sorted arrays of (start, kind, end, str), to rows with ``text``."""
    forest = _fitted(rows.sparkSession, training_rows)
    rows = with_candidates(with_base(rows))
    total = " + ".join(_tree_sql(t, "c.f") for t in forest.trees)
    scored = f"transform(candidates, c -> struct(1 / (1 + exp(-({forest.slope!r}D * ({total}) + {forest.offset!r}D))) as p, -c.start as back, c.end as end, c.gen as gen, c.str as str))"
    limits = "array(" + ", ".join(f"{t!r}D" for t in forest.thresholds) + ")"
    rows = rows.withColumn("_scored", F.expr(scored))
    rows = rows.withColumn("_taken", F.expr(f"reverse(array_sort(filter(_scored, c -> c.p >= element_at({limits}, c.gen + 1))))"))
    # A part of a longer span that is taken too gives way, so that no rest of a secret stays.
    rows = rows.withColumn("_taken", F.expr("filter(_taken, c -> not exists(_taken, d -> d.back >= c.back and d.end >= c.end and d.end + d.back > c.end + c.back))"))
    chosen = f"""aggregate(_taken, base, (taken, c) -> if(exists(taken, s -> s.start < c.end and s.end > -c.back), taken,
        concat(taken, array(struct(-c.back as start, c.gen + {len(BASE)} as kind, c.end as end, c.str as str)))))"""
    rows = rows.withColumn("spans", F.array_sort(F.expr(chosen)))
    return rows.drop("candidates", "_scored", "_taken")


def _written(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def personal_data(docs: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more), one for each
    row of ``docs`` (doc_id, text).

    Places count code points, ends exclusive; a span is written kind:start:end, and spans are
    joined by commas in order of start, then of kind as in KINDS.  A null text counts as empty and
    has none.  Repeated rows are all returned; other columns are not read; an empty table gives
    no rows.
    """
    rows = with_spans(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), training_rows)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id",
        *(count(k).alias(f"n_{kind}") for k, (kind, _) in enumerate(BASE)),
        F.sha2(_written("base"), 256).alias("base_sha256"),
        _written("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_more"),
    )


def redacted(docs: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in square brackets; spans that
    overlap are replaced as one.  Null texts stay null, empty ones empty; other columns stay as they
    are, whatever their names; repeated rows change alike; an empty table gives no rows."""
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_spans(inner, training_rows)
    folded = f"""aggregate(spans, named_struct('at', 0, 'out', cast(array() as array<string>)),
        (a, s) -> if(s.start < a.at, named_struct('at', greatest(a.at, s.end), 'out', a.out),
            named_struct('at', s.end, 'out', concat(a.out, array(substring(text, a.at + 1, s.start - a.at), element_at({names}, s.kind + 1))))),
        a -> concat(array_join(a.out, ''), substring(text, a.at + 1)))"""
    clean = F.when(F.col("_row.text").isNull(), F.lit(None)).when(F.size("spans") == 0, F.col("text")).otherwise(F.expr(folded))
    kept = rows.withColumn("_clean", clean)
    return kept.select(*(F.col("_clean").alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


