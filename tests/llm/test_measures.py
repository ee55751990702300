"""Operators that look at one text at a time, and those that place texts."""

import random
import re
from collections import Counter, defaultdict

import brute
import public_tokenizers
import pytest
from strandline.llm import html_main, packing, quality, sharding, token_count

SF = "/root/testdata/sf0.001"
ODD = [
    (9001, None), (9002, ""), (9003, " \t\n"), (9004, "one"), (9005, "a b c d e f g h i j"),
    (9006, "the same five words here the same five words here"), (9007, "x\nx\n \nx \nX"),
    (9008, "tab\tsep\x0bv\x0cf\rc  two  spaces\n\nline ünï ÀÉ 中文字 é"), (9009, "<|endoftext|>a <|endoftext|> b<|startoftext|>"),
    (9010, "word " * 5000), (9011, "z" * 30000), (9012, "it's we'll I'M  don't nbsp \x1cfs\x1d ΑΣ ΟΔΟΣ İstanbul"), (9013, "# * $ %% && | <>"), (9013, "# * $ %% && | <>"),
    (None, "no id here at all"), (9014, " lead and trail "), (9015, "a\n b \n\n  c"), (9016, "1234 56.7 ½ ² ³ ٣٤"),
]


@pytest.fixture(scope="module")
def docs(spark):
    more = spark.createDataFrame(ODD, "doc_id long, text string")
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(more).selectExpr("*", "0 as n", "text as words", "1 as shard", "doc_id as length")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def empty(docs):
    return docs.where("false")


def test_quality_counts(docs, rows):
    got = quality.judged(docs)
    found = Counter(tuple(r) for r in got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    assert found == brute.quality(rows)
    assert got.where("base_failed and kept").count() == 0
    assert quality.judged(empty(docs)).count() == 0


def test_quality_ablation(docs):
    ledger = quality.ledger(docs).cache()
    for r in quality.ablation(ledger, "corpus-1").collect():
        k = [rule.name for rule in quality.RULES].index(r.rule)
        assert r.failed == ledger.where(quality.RULES[k].fails).count()
        others = tuple(n for n in quality.POLICIES["corpus-1"] if n != r.rule)
        assert r.failed_alone == ledger.where(quality.passes(others)).count() - ledger.where(quality.passes("corpus-1")).count()


def test_quality_junk(spark):
    """Table junk and words repeated at once fail; ordinary prose does not; labels agree."""
    words = [f"word{chr(97 + k)}" for k in range(20)]
    texts = [(1, " | ".join(words)), (2, " ".join(w for w in words for _ in range(2))), (3, " ".join(words)), (4, " ".join(words) + " wordt")]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [got[k].kept for k in (1, 2, 3, 4)] == [False, False, True, True]
    assert [got[k].n_adjacent for k in (1, 2, 3, 4)] == [0, 20, 0, 1]
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    seen = Counter((r.quality, r.kept) for r in quality.judged(docs).join(labels, "doc_id").select("quality", "kept").collect())
    old = Counter((r.quality, r.kept) for r in quality.judged(docs, "corpus-1").join(labels, "doc_id").select("quality", "kept").collect())
    assert seen[0, True] * 50 <= seen[0, False] + seen[0, True]
    assert seen[1, False] == old[1, False]


def test_token_counts(docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = Counter((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows)
    assert Counter(map(tuple, token_count.token_counts(docs, path).collect())) == want
    assert token_count.token_counts(empty(docs), path).count() == 0


def test_token_classes_match_the_library():
    """Every character alone and amid letters, digits and blanks."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    with open(path, "rb") as f:
        count = token_count.Counter(f.read())
    rng = random.Random(1)
    points = [c for c in range(1, 0x3400) if not 0xD800 <= c < 0xE000] + rng.sample(range(0x3400, 0xD800), 800) + rng.sample(range(0xE000, 0x110000), 1500)
    bad = [hex(c) for c in points for t in (f"a{chr(c)} 1{chr(c)}{chr(c)}b ",) if count(t) != len(library.encode(t).ids)]
    assert bad == []


def test_encoder_matches_the_library(rows):
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        encode = packing.Encoder(f.read())
    assert encode.by_word
    assert [encode(t) for _, t in rows] == [encode.whole(t) if t else b"" for _, t in rows]
    rng = random.Random(1)
    points = [c for c in range(1, 0x3400)] + rng.sample(range(0x3400, 0xD800), 500) + rng.sample(range(0xE000, 0x110000), 500)
    texts = [f"aB{chr(c)}a {chr(c)} Z{chr(c)}\u0301 {chr(c)}{chr(c)}'s x" for c in points]
    assert [hex(c) for c, t in zip(points, texts, strict=True) if encode(t) != encode.whole(t)] == []
    marks = [f"a{p}b {p}c d{p}{q} e{q}{p}'s 3{p}14" for p in "!,.-'&×÷<|" for q in "!,.-'&×÷>|"]
    assert [t for t in marks if encode(t) != encode.whole(t)] == []
    small = packing.Encoder(encode.library.to_str().encode(), most=3)
    assert [small(t) for _, t in rows] == [encode.whole(t) if t else b"" for _, t in rows]


def test_plan_is_valid_and_tight():
    rng = random.Random(2)
    for case in range(60):
        capacity = rng.choice((10, 64, 2048))
        counts = {n: rng.randint(1, 30) for n in rng.sample(range(1, capacity + 1), min(capacity, rng.randint(1, 60)))}
        fill, used = defaultdict(list), Counter()
        for r in packing.plan(counts, capacity):
            assert r.rank == used[r.length]
            used[r.length] += r.count
            for k in range(r.count):
                fill[r.sequence + k].append((r.offset, r.length))
        assert used == Counter(counts)
        for parts in fill.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        total = sum(n * c for n, c in counts.items())
        big = sum(c for n, c in counts.items() if 2 * n > capacity)
        assert len(fill) <= max(-(-total // capacity), big) * 1.25 + 2, case
    assert packing.plan({}, 8) == []


def test_packing(docs, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    found = packing.pack(docs, path, capacity=64, with_ids=True).collect()
    whole = Counter()
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
    with open(path, "rb") as f:
        encode = packing.Encoder(f.read())
    for i, t in rows:
        ids = encode.whole(t or "") + b"\0\0\0\0"
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            whole[i, k, at // 4, len(part) // 4, __import__("zlib").crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == whole
    fill = defaultdict(list)
    for r in found:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(fill) <= 1.02 * sum(r.length for r in found) / 64 + 1
    assert packing.pack(empty(docs), path).count() == 0


def test_sharding(docs, rows):
    found = sharding.sharded(docs, shards=7).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((i, 8 + len((t or "").encode()), brute.crc(t)) for i, t in rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(7)]
    assert max(sizes) - min(sizes) <= 1
    assert {(r.law, r.grown_shard) for r in found} == {("rows", None)}
    assert sharding.sharded(empty(docs)).count() == 0


def test_communication_matrix_sums_and_law():
    rows = [5, 0, 17, 3, 40]
    total = Counter()
    for seed in range(300):
        m = sharding.communication_matrix(rows, 3, seed)
        assert [sum(line) for line in m] == rows
        assert sorted(sum(line[k] for line in m) for k in range(3)) == [21, 22, 22]
        total[m[0][0]] += 1
    mean = sum(k * n for k, n in total.items()) / 300
    assert abs(mean - 5 * 22 / 65) < 0.3
    import numpy as np

    rng = np.random.default_rng(0)
    draws = [sharding._draw(rng, 3_000_000_000, 7_000_000_000, 1000) for _ in range(300)]
    assert abs(np.mean(draws) - 300) < 4 and 8 < np.std(draws) < 22


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = [(-1, None, None), (-2, "http://x.org/a", ""), (-3, "http://x.org/b", "plain text &amp; more"), (-4, "http://x.org/c", "<nav>menu</nav><footer>foot</footer>"), (None, "nonsense", "<article><p>kept &lt;b&gt;<p>a\n\n b<aside>no</aside></article>"), (-5, "http://x.org/e", "<article><p>cut off <b")]
    rows = pages.select("page_id", "url", "html").unionByName(spark.createDataFrame(odd, "page_id long, url string, html string"))
    found = {r.page_id: r for r in html_main.main_text(rows.withColumn("path", rows.url)).collect()}
    assert len(found) == rows.count()
    import html

    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br)>", inside)]
        assert found[r.page_id].text == "\n".join(b for b in blocks if b)
        assert found[r.page_id].n_chars == len(found[r.page_id].text)
    assert [found[k].text for k in (-1, -2, -3, -4, None, -5)] == ["", "", "plain text & more", "", "kept <b>\na b", "cut off"]
    assert html_main.main_text(rows.where("false")).count() == 0


PROSE = [f"Paragraph {w} says at some length what this page is about, with no link in it at all." for w in "one two three four five six".split()]
BODY = "".join(f"<p>{p}</p>" for p in PROSE)
ASIDE = "<nav><a href='/'>Home</a> <a href='/x'>More of this</a></nav>", "<footer>Owned by someone</footer>"


def text_of(html):
    page = html_main.Page(html)
    own = page.scores()
    return page.text(max(sorted(own), key=own.get) if own else None)


@pytest.mark.parametrize("start, end", [("<div class='content with-sidebar'>", "</div>"), ("<div class='no-sidebar'>", "</div>"), ("<div id='page' class='has-banner'>", "</div>"), ("<form action='/'>", "</form>"),
                                        ("<form><div id='header-wrap'>", "</div></form>"), ("<div class='layout-sidebar'><div>short note</div><article>", "</article></div>")])
def test_marked_wrappers(start, end):
    for before, after in (("", ""), ASIDE):
        got = text_of(f"<body>{before}{start}{BODY}<div class='sidebar'>Short side text</div>{end}{after}</body>")
        assert got.split("\n") == PROSE


def test_marks_that_stay():
    """Headings keep slugs; parts with marks of their own stay out, however long comments are."""
    slugs = "".join(f"<h2 id='{s}'>Heading {s}</h2><p>{p}</p>" for s, p in zip(("related-work", "search-trees", "notice-period"), PROSE))
    assert text_of(f"<body><div class='post'>{slugs}</div></body>").count("Heading") == 3
    assert text_of(f"<body><div class='post'><p>{PROSE[0]}</p></div><div id='comments'><article>{BODY * 5}</article></div></body>") == PROSE[0]
    assert text_of(f"<body><div class='post'><p>{PROSE[0]}</p></div><div class='sidebar'><p>{PROSE[1]}</p></div></body>") == PROSE[0]
    assert text_of(f"<body>{ASIDE[0]}<div class='cookie'>We use these</div></body>") == ""


def test_text_around_the_winning_path(spark):
    """Titles and leads beside the winning container stay, and a host's path that holds little of a page gives way."""
    section = f"<section>{BODY}</section>"
    lead = "<h1>Title</h1><p>The lead of it.</p>"
    want = ["Title", "The lead of it.", *PROSE, *PROSE]
    assert text_of(f"<body>{ASIDE[0]}<div class='post'>{lead}{section}{section}</div>{ASIDE[1]}</body>").split("\n") == want
    got = text_of(f"<body>{ASIDE[0]}<div class='post'><div class='lead'><p>{PROSE[0]}</p><p>{PROSE[1]}</p></div><div class='text'>{BODY}</div></div></body>")
    assert got.split("\n") == [*PROSE[:2], *PROSE]
    deep = text_of(f"<body>{ASIDE[0]}<article><h1>Title</h1><div class='a'><div class='b'><div class='c'>{BODY * 3}</div></div></div></article></body>")
    assert deep.split("\n") == ["Title", *PROSE * 3]
    linked = "<div class='box'><a href='/1'>One more page with a long name</a> <a href='/2'>Another</a></div>"
    assert text_of(f"<body><div class='post'>{BODY}</div>{linked}</body>").split("\n") == PROSE
    assert text_of(f"<body>{ASIDE[0]}<div class='post'>{BODY}</div><div class='box'><p>Something else here</p></div></body>").split("\n") == PROSE
    first = [(k, "http://a.org/", f"<body>{ASIDE[0]}<div class='story'>{BODY}</div></body>") for k in range(30)]
    second = (99, "http://a.org/", f"<body>{ASIDE[0]}<div class='story'><p>Summary</p></div><div class='report'>{BODY}</div></body>")
    found = {r.page_id: r.text for r in html_main.main_text(spark.createDataFrame([*first, second], "page_id long, url string, html string")).collect()}
    assert found[0].split("\n") == found[99].split("\n") == PROSE


def test_names_of_prose():
    """A paragraph's class is about its text; adverts and the like still go, and deep links are links."""
    body = "<p class='search-tips'>Tips.</p><p class='side-note'>Note.</p><p class='tags-explained'>Tags.</p><p class='ad'>Buy.</p><p class='advert-label'>Now.</p><ul class='share'><li>Share</li></ul><p>End.</p>"
    assert html_main.Page(f"<body><article><h1>T</h1>{body}</article></body>").text("/body/article") == "T\nTips.\nNote.\nTags.\nEnd."
    deep = html_main.Page("<div><a href=x><span><b><i><u><s>one two</s></u></i></b></span></a></div><p><a href=y>left open<p>after")
    assert [(t, n) for t, _, n in deep.blocks] == [("one two", 7), ("left open", 9), ("after", 0)]


def test_vote_against_a_page(spark):
    """A page whose comments-like list outweighs its text is read where its host's pages have theirs."""
    page = lambda text, more: f"<body>{ASIDE[0]}<div class='story'><p>{text}</p></div><div class='stream'><p>{more}</p></div></body>"
    rows = [(k, "http://h.org/x", page(f"Story {k} " + "words of it " * 20, "Short.")) for k in range(8)]
    rows.append((8, "http://h.org/x", page("Story 8 " + "words of it " * 10, "other talk " * 18)))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    own = html_main.Page(rows[8][2])
    assert max(own.scores(), key=own.scores().get) == "/body/div.stream"
    assert next(r.path for r in html_main.winning_paths(frame).collect()) == "/body/div.story"
    assert {r.page_id: r.text for r in html_main.main_text(frame).collect()}[8] == ("Story 8 " + "words of it " * 10).strip()
    assert own.text("/body/div.stream").startswith("other talk")


def test_long_and_repeated_pages(spark):
    long = "<body><article>" + "".join(f"<p>Line {k} of it.</p>" for k in range(60_000)) + "</article></body>"
    rows = [(1, "http://a.org", long), (2, "http://a.org", "<article><p>x</p></article>"), (2, "http://a.org", "<article><p>x</p></article>")] + [(k, "http://a.org", f"<article><p>Page {k}</p></article>") for k in range(10, 400)]
    found = html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == len(rows) and [r.text for r in found if r.page_id == 2] == ["x", "x"]
    assert next(r for r in found if r.page_id == 1).text == "\n".join(f"Line {k} of it." for k in range(60_000))
