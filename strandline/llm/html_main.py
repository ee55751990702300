"""Main text of web pages by consensus paths of their hosts.

Every page's containers are scored.  Their paths, tags and classes with digits and positions
taken off, are votes: summed over a host, they name the path that holds its articles even where
one page's own score would mislead.  Pages are then extracted anew at their host's winning path.
"""

from __future__ import annotations

import html as charrefs
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

# Element names of the HTML standard, by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes svg math object canvas select option button".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
AROUND = frozenset("nav header footer aside form menu dialog search head fieldset".split())
HOLDERS = frozenset("article main section div body td".split())
CLOSES_P = BLOCK - frozenset("caption tbody td tfoot th thead tr html body".split())
# Words in class, id and role that mark what is not the article.
_AROUND_WORDS = "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside rail widget widgets related recommended comment comments reply replies respond discussion disqus footer header masthead topbar toolbar share sharing social pagination pager skip search tags toc contentinfo complementary"
_MARK = frozenset(_AROUND_WORDS.split())
# Those that also name a page's layout, where they may stand on a wrapper of the article.
_LAYOUT = frozenset("banner notice notices alert overlay nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside rail header footer masthead topbar toolbar skip search tags toc".split())
# Those that mark an element of text by themselves, whatever other words stand with them.
_FOREIGN = frozenset("ad ads advert advertisement advertising sponsored promo cookie cookies consent gdpr newsletter disqus".split())
#: Elements of text, which a name marks only if all its words do: "search-tips" is about a search.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dl dt dd ol ul figure figcaption table caption span em strong b i a code".split())
_WRAPPERS = frozenset("div section td form".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A class that says whether the page has a part, not that the element is one.
_STATE = re.compile(r"(?:with|without|no|not|has|hide|show)[-_].*")
#: How an element's names mark it: not, as what may be a wrapper of the article, or as no content.
PLAIN, SOFT, HARD = 0, 1, 2

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S)
_WORDS = re.compile(r"[a-z]+")
_BLANKS = re.compile(r"\s+")


class Node:
    """An open element: its generalised path, whether it or one around it is no content, those of
    them, by number, that are softly marked, and whether it is in a link."""

    __slots__ = ("tag", "path", "around", "number", "soft", "link")

    def __init__(self, tag: str, path: str, around: bool, number: int, soft: tuple[int, ...] = (), link: bool = False) -> None:
        self.tag, self.path, self.around, self.number, self.soft, self.link = tag, path, around, number, soft, link


def _named(tag: str, attributes: str) -> tuple[str, int]:
    """The generalised class, and how names mark the element."""
    if "=" not in attributes:
        return "", PLAIN
    found: dict[str, str] = {}
    for name, *value in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), next(filter(None, value), ""))
    style = found.get("class", "")
    classes = (c for c in style.lower().split() if not _STATE.fullmatch(c))
    said = " ".join((*classes, "" if tag in _HEADINGS else found.get("id", ""), found.get("role", ""))).lower()
    if tag in _PROSE:
        names = ((name, _WORDS.findall(name)) for name in said.split())
        said = " ".join(name for name, own in names if own and (_MARK.issuperset(own) or own[0] in _FOREIGN))
    hidden = "display:none" in found.get("style", "").replace(" ", "").lower() or found.get("aria-hidden", "").lower() == "true"
    first = _WORDS.findall(style.lower())
    marks = _MARK.intersection(_WORDS.findall(said))
    if not marks and not hidden:
        return "-".join(first[:2]), PLAIN
    return "-".join(first[:2]), SOFT if tag in _WRAPPERS and not hidden and marks <= _LAYOUT else HARD


class Page:
    """Blocks of a page in order, each with the text, its innermost elements and link share."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[str, tuple[Node, ...], int]] = []
        #: The containers, by number, around each menu or the like; body only counts all of AROUND.
        self.furniture: list[tuple[int, ...]] = []
        self._soft: list[tuple[int, ...]] = []
        self._articles: list[tuple[int, ...]] = []
        self._text: list[str] = []
        self._linked = 0
        root = Node("", "", False, 0)
        self.stack = [root]
        self.count = 0
        at = 0
        end = len(source)
        while at < end:
            start = source.find("<", at)
            if start < 0:
                self._add(source[at:])
                break
            found = _TOKEN.match(source, start)
            if not found:
                step = source.find("<", start + 1)
                if re.match(r"</?[a-zA-Z]", source[start : start + 3]):  # a tag cut off by the page's end
                    self._add(source[at:start])
                    break
                step = end if step < 0 else step
                self._add(source[at:step])
                at = step
                continue
            if start > at:
                self._add(source[at:start])
            at = found.end()
            closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], "")
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                self._close(tag)
            elif tag in RAW and not attributes.endswith("/"):
                shut = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = shut.end() if shut else end
                if tag != "title":
                    self._text.append(" ")
            else:
                self._open(tag, attributes)
        self._cut()
        self._settle()

    def _settle(self) -> None:
        """Leave out the blocks of softly marked elements, but for those that hold nearly all of the
        page's unlinked text, or every article of it."""
        if any(self._soft):
            total, held = 0, {}
            for (text, _, linked), soft in zip(self.blocks, self._soft, strict=True):
                worth = max(0, len(text) - 2 * linked)
                total += worth
                for number in soft:
                    held[number] = held.get(number, 0) + worth
            free = {n for n, worth in held.items() if 4 * worth > 3 * total or worth and self._articles and all(n in a for a in self._articles)}
            self.blocks = [b for b, soft in zip(self.blocks, self._soft, strict=True) if free.issuperset(soft)]

    def _add(self, text: str) -> None:
        if self.stack[-1].around:
            return
        if "&" in text:
            text = charrefs.unescape(text)
        self._text.append(text)
        if self.stack[-1].link:
            self._linked += len(text.strip())

    def _cut(self) -> None:
        if self._text:
            text = _BLANKS.sub(" ", "".join(self._text)).strip()
            if text:
                holders = tuple(n for n in self.stack if n.tag in HOLDERS)
                self.blocks.append((text, holders, self._linked))
                self._soft.append(self.stack[-1].soft)
            self._text.clear()
        self._linked = 0

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self._cut()
            if tag in CLOSES_P:
                self._until("p", BLOCK - {"p"})
            if tag in ("li", "dt", "dd", "td", "th", "tr", "option"):
                self._until(tag, frozenset(("ul", "ol", "dl", "table", "div", "article", "section", "body")))
        elif tag == "br":
            self._text.append(" ")
        elif tag == "a":  # links don't nest: one that was left open ends here
            self._until("a", BLOCK)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            return
        name, marked = _named(tag, attributes)
        above = self.stack[-1]
        self.count += 1
        path = f"{above.path}/{tag}.{name}" if name else f"{above.path}/{tag}"
        # The marks of page, body and article say what the page is about, not that it is no content.
        around = above.around or tag in AROUND and tag != "form" or marked == HARD and tag not in ("html", "body", "article", "main")
        if tag in AROUND and tag != "form" and not above.around:
            wide = tag in ("nav", "menu", "search")
            self.furniture.append(tuple(n.number for n in self.stack if n.tag in HOLDERS and (wide or n.tag == "body")))
        soft = (*above.soft, self.count) if marked == SOFT or tag == "form" else above.soft
        if tag in ("article", "main") and not around:
            self._articles.append(soft)
        self.stack.append(Node(tag, path if tag in HOLDERS else above.path, around, self.count, soft, above.link or tag == "a"))

    def _until(self, tag: str, stops: frozenset[str]) -> None:
        """Close ``tag`` where its end tag may be left out."""
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return
            if self.stack[k].tag in stops:
                return

    def _close(self, tag: str) -> None:
        if tag in BLOCK:
            self._cut()
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return

    def scores(self) -> dict[str, float]:
        """A score for each container path: text in it that isn't links, much more where it stands
        close below, and less the more of it is links."""
        found: dict[str, float] = {}
        for text, holders, linked in self.blocks:
            worth = max(0, len(text) - 2 * linked)
            if not worth:
                continue
            for depth, node in enumerate(reversed(holders)):
                kind = 4.0 if node.tag == "article" else 2.0 if node.tag == "main" else 1.0
                found[node.path] = found.get(node.path, 0.0) + kind * worth * 0.5**depth
        return found

    def _under(self, path: str) -> list[int]:
        """Places of the blocks under a path and under what is around it and belongs to it: the
        highest element whose further text is mostly unlinked, short of one with menus or the like
        outside the path, unless that is the article; never what is around an article."""
        inside = {k for k, (_, holders, _) in enumerate(self.blocks) if any(n.path == path for n in holders)}
        around: dict[int, Node] = {}
        of_path: set[int] = set()
        for k in inside:
            chain = self.blocks[k][1]
            at = next(j for j, n in enumerate(chain) if n.path == path)
            of_path.add(chain[at].number)
            top = next((j for tag in ("article", "main") for j in range(at + 1) if chain[j].tag == tag), 0)
            around.update((n.number, n) for n in chain[top:at])
        under: dict[int, list[int]] = {number: [] for number in around}
        for k, (_, holders, _) in enumerate(self.blocks):
            for n in holders:
                if n.number in under:
                    under[n.number].append(k)
        took: set[int] = set()
        other = {number for chain in self.furniture if not of_path.intersection(chain) for number in chain}
        for number in sorted(around):  # the outer ones come first
            more = [self.blocks[k] for k in under[number] if k not in inside]
            if 2 * sum(linked for _, _, linked in more) > sum(len(t) for t, _, _ in more):
                continue
            if around[number].tag in ("article", "main") or number not in other:
                took.update(under[number])
                if len(took) == len(self.blocks):
                    break
        return sorted(inside | took)

    def _worth(self, places: list[int]) -> int:
        return sum(max(0, len(self.blocks[k][0]) - 2 * self.blocks[k][2]) for k in places)

    def text(self, path: str | None) -> str:
        """The blocks under a path and what belongs to it; under the page's own best one if that has
        more than twice as much, and of all the page if it has no such container."""
        if path is not None:
            found = self._under(path)
            if 2 * self._worth(found) < self._worth(range(len(self.blocks))) or not found:
                own = self.scores()
                best = self._under(max(sorted(own), key=own.get)) if own else []
                if self._worth(best) > 2 * self._worth(found):
                    found = best
            if found:
                return "\n".join(self.blocks[k][0] for k in found)
        return "\n".join(t for t, _, _ in self.blocks)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: dict[tuple[str, str], list[float]] = {}
        for site, source in zip(batch.column(0), batch.column(1), strict=True):
            for path, score in Page(source.as_py() or "").scores().items():
                vote = votes.setdefault((site.as_py(), path), [0.0, 0])
                vote[0] += np.log1p(score)
                vote[1] += 1
        if votes:
            sites, paths = zip(*votes, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(sites), pa.array(paths), pa.array([round(v[0], 6) for v in votes.values()]), pa.array([v[1] for v in votes.values()], pa.int64())], names=["site", "path", "score", "pages"])


def winning_paths(pages: DataFrame) -> DataFrame:
    """One row (site, path) for each host with any content: the path with most votes; ties go to
    the path that comes first.  Pages with null or empty html have no vote, a repeated page votes
    each time, pages without a url are one host, and an empty table gives no rows."""
    votes = pages.select(host(F.col("url")).alias("site"), F.col("html").cast("string").alias("html")).mapInArrow(_score, "site string, path string, score double, pages long")
    summed = votes.groupBy("site", "path").agg(F.sum(F.col("score").cast("decimal(30,6)")).alias("score"))
    best = summed.groupBy("site").agg(F.max("score").alias("score"))
    return summed.join(best, ["site", "score"]).groupBy("site").agg(F.min("path").alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each row of ``pages`` (page_id, url, html).

    Null or empty html, and pages with nothing but menus and the like, give an empty text.  A
    null url is a host of its own kind, with paths of its own.  A page without its host's winning
    path is read at its own best one.  Pages of any length are read whole; repeated rows are all
    returned; other columns are not read; an empty table gives no rows.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    # A table of one row a host: Spark broadcasts it if its size allows, and else splits large hosts.
    won = materialise(winning_paths(pages), "winning-paths")
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host(F.col("url")).alias("site"))
    told = rows.join(won, "site", "left").select("page_id", "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(h.as_py() or "").text(p.as_py()) for h, p in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return told.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
