"""HTML extraction by tag-path ratios.

Every text block of a page is filed under its root-to-leaf path of tags. Of each path the text length and the punctuation are
summed and divided by its blocks; both ratios are smoothed over the paths beside it in page order, fused by their product, and
paths below a share of the best are set aside. The content node is the article or main element that holds a chosen path, else the
deepest element that holds all of them; its blocks are the text. Elements that are never content by tag (menus, headers, footers,
asides, forms, scripts, styles) are left out before.

Names (of sidebars, notices, adverts, reader comments and the like) count by whole tokens of class, id or role. A container whose
token is such a name, or starts with one (share-buttons, but not comments-open), is left out too, as is such a span or link inside a
block, unless the container holds an article, main or more than half of the page's text; comments inside an article or main go
whatever their share. Any other block with such a token, and such a container that isn't left out, is doubtful: its own blocks have a
path of their own, and stay only if their ratios reach the share. A name later in a token (post-header) and ids of headings say nothing.

Defined cases. A null or empty html, or a page without any such text, gives an empty text. Unclosed and misnested tags are closed
where the next block starts; a page of any size is read once, paths are kept as a tree, so depth costs nothing. Repeated rows are
read alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the best fused ratio that chosen paths reach, and the weight of a path's own ratio beside its neighbours'.
SHARE, OWN = 0.2, 4
# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
NEVER = frozenset("aside audio button canvas dialog footer form head header iframe menu nav noscript object script select style svg template textarea title video".split())
CLOSED_BY_ITSELF = {"li": "li", "dt": "dt", "dd": "dd", "tr": "tr", "td": "td", "th": "th", "option": "option"}
NEVER_NAMED = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies disqus footer header masthead menu nav navbar navigation newsletter notice notices popup promo related replies search share sharing sidebar social sponsor sponsored subscribe widget".split())
#: Containers that a name alone may leave out; INLINE elements, which it leaves out whole; READERS among the names; words that make a token a state of something else.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMED = frozenset("div section ul ol dl table tbody tr td center details figure address".split())
INLINE = frozenset("a abbr b cite em i label small span strong sub sup time u".split())
READERS = frozenset("comment comments disqus replies".split())
STATES = frozenset("active allowed closed count disabled enabled hidden no none off on open opened visible yes".split())

_NAME = regex.compile(r"[a-z]+")
_PUNCTUATION = regex.compile(r"\p{P}")


def _named(tag: str, attrs: list[tuple[str, str | None]]) -> frozenset:
    """The names that tokens of class, id and role are or start with."""
    heads = set()
    for k, v in attrs:
        if k not in ("class", "id", "role") or not v or (k == "id" and tag in HEADINGS):
            continue
        for token in v.lower().split():
            words = _NAME.findall(token)
            if words and words[0] in NEVER_NAMED and STATES.isdisjoint(words[1:]):
                heads.add(words[0])
    return frozenset(heads)


class _Blocks(HTMLParser):
    """Text blocks with their paths; path k has parent parents[k] and tag tags[k]. Elements with names have paths of their own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parents, self.tags, self.known = [-1], [""], {}
        self.open: list[tuple[str, int, bool]] = [("", 0, False)]
        self.count: Counter = Counter()
        self.text: list[str] = []
        self.blocks: list[tuple[int, str]] = []
        self.heads: dict[int, frozenset] = {}
        self.doubtful: set[int] = set()

    def _end_block(self):
        found = " ".join("".join(self.text).split())
        if found:
            # a block belongs to the nearest block element around it
            path = self.open[-1][1]
            while path and self.tags[path] not in BLOCK and path not in self.doubtful:
                path = self.parents[path]
            self.blocks.append((path, found))
        self.text.clear()

    def _close(self, tag):
        while True:
            name, _, _ = self.open.pop()
            self.count[name] -= 1
            if name == tag:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._end_block()
            if self.count["p"]:
                self._close("p")
        if tag in CLOSED_BY_ITSELF and self.open[-1][0] == tag:
            self._close(tag)
        if tag in VOID:
            self.text.append(" " if tag == "br" else "")
            return
        _, parent, skipped = self.open[-1]
        heads = frozenset() if skipped or tag in ("html", "body", "article", "main") else _named(tag, attrs)
        inline, doubtful = bool(heads) and tag in INLINE, bool(heads) and tag not in INLINE
        path = None if doubtful else self.known.get((parent, tag))
        if path is None:
            path = len(self.tags)
            self.parents.append(parent)
            self.tags.append(tag)
            if doubtful:
                self.doubtful.add(path)
                if tag in NAMED:
                    self.heads[path] = heads
            else:
                self.known[parent, tag] = path
        self.open.append((tag, path, skipped or tag in NEVER or inline or (tag == "article" and any(v and "comment" in v.lower() for k, v in attrs if k == "class"))))
        self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self._end_block()
        if self.count[tag]:
            self._close(tag)

    def handle_data(self, data):
        if not self.open[-1][2]:
            self.text.append(data)

    def close(self):
        super().close()
        self._end_block()


def _content(page: _Blocks) -> list[tuple[int, str]]:
    """The blocks outside of elements that their names leave out."""
    if not page.heads:
        return page.blocks
    below, holds = [0] * len(page.tags), [tag in ("article", "main") for tag in page.tags]
    for path, text in page.blocks:
        below[path] += len(text)
    # only an article with text counts; a parent is always numbered before its children
    for k in range(len(below) - 1, 0, -1):
        holds[k] = holds[k] and below[k] > 0
        below[page.parents[k]] += below[k]
        holds[page.parents[k]] |= holds[k]
    inside, gone = [False] * len(page.tags), [False] * len(page.tags)
    for k in range(1, len(below)):
        up = page.parents[k]
        inside[k], gone[k] = inside[up] or page.tags[up] in ("article", "main"), gone[up]
        heads = page.heads.get(k)
        if heads and not holds[k] and (2 * below[k] <= below[0] or (inside[k] and not heads.isdisjoint(READERS) and below[k] < below[0])):
            gone[k] = True
    return [(path, text) for path, text in page.blocks if not gone[path]]


def main_text(html: str | None) -> str:
    page = _Blocks()
    page.feed(html or "")
    page.close()
    content = _content(page)
    if not content:
        return ""
    length, marks, blocks = Counter(), Counter(), Counter()
    for path, text in content:
        length[path] += len(text)
        marks[path] += len(_PUNCTUATION.findall(text))
        blocks[path] += 1
    order = list(blocks)
    ratios = [(length[p] / blocks[p], 1 + marks[p] / blocks[p]) for p in order]

    def smooth(k: int, part: int) -> float:
        beside = [ratios[i][part] for i in (k - 1, k + 1) if 0 <= i < len(ratios)]
        return (OWN * ratios[k][part] + sum(beside)) / (OWN + len(beside))

    fused = {p: smooth(k, 0) * smooth(k, 1) for k, p in enumerate(order)}
    least = SHARE * max(fused.values())
    chosen = [p for p in order if fused[p] >= least]
    # how many chosen paths lie at or below each path; a parent is always numbered before its children
    below, within = [0] * len(page.tags), [-1] * len(page.tags)
    for p in chosen:
        below[p] += 1
    for k in range(len(below) - 1, 0, -1):
        below[page.parents[k]] += below[k]
    tops = {k for k in range(len(below)) if below[k] and page.tags[k] in ("article", "main")} or {max(k for k in range(len(below)) if below[k] == len(chosen))}
    if len(tops) == 1 and page.tags[next(iter(tops))] in BLOCK - {"article", "main", "body", "html", "div", "section", "td"}:
        tops = {page.parents[next(iter(tops))]}
    for k in range(len(within)):
        within[k] = k in tops or (k > 0 and within[page.parents[k]])
    # blocks that a name makes doubtful stay by their own ratios
    keep = set(chosen)
    return "\n".join(text for path, text in content if within[path] and (path not in page.doubtful or path in keep))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars; one row per page, nothing shuffled."""
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    names = ["page_id", "url", "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a few pages at a time: a batch of long pages is not doubled in memory
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=names)

    kind = narrow.schema["page_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
