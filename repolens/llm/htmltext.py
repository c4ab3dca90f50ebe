"""HTML extraction: page structure first, then a host's suffix arrays.

A page is read once, into blocks, with a tolerant tag scanner. Several signals decide about a block. Elements that are no text by their tag or role
(scripts, styles, forms, menus, footers, asides) are out. A class or id puts an element out only if all its words say advert, notice, sidebar,
comments and the like, or are mere layout (``cookie-box``); where only some do (``legal-analysis``), the element's own text decides: its length,
sentences and share of links. Comments are known by their heading too. The main text is what is in articles, else in ``main``, else in a container
named as content, unless one of the others holds far more text. What is left is up to repetition on the host.

For that, the words of the blocks left form a page's token stream, with a mark between blocks. A host's streams are joined with a separator of its
own after each page and sorted as a suffix array; neighbours that share ``MIN_RUN`` tokens or more are the long repeated substrings. A token of
a page is boilerplate if it lies in a substring of ``MIN_RUN`` tokens or more that is on enough of the host's distinct pages, which is the case
if and only if it lies in a window of ``MIN_RUN`` tokens that is: so a run of any length is counted by its windows. Blocks too short for a window
count as a whole. A block that is covered goes; unique runs stay. Pages with equal streams count once: copies of an article are no template.
Blocks inside a marked article have to be nearly everywhere to go, since articles do share passages; others go if a good share of pages has them.

A large host is dealt into groups of about ``GROUP_PAGES`` pages or ``GROUP_BYTES`` of text by their streams, each with a suffix array of its own. What is on a share of the
host's pages is on that share of at least one group's, so the groups' arrays find every candidate; the candidates are then counted in all groups, and
the sums decide. So the decision is that of the whole host, however its pages are dealt.

Nulls: a null page or one without blocks gives the empty text, a null URL is a host of its own. Repeated rows each get a row. Pages of any length
are read whole. Extra columns aren't read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.common import cut, stash
from repolens.llm.substrings import _mixed

MIN_RUN, MIN_PAGES, MIN_SHARE, COVER = 12, 3, 0.3, 0.8
ARTICLE_PAGES, ARTICLE_SHARE = 10, 0.8  #: inside an article, a template's block has to be nearly everywhere
GROUP_PAGES, GROUP_BYTES = 500, 4_000_000  #: of distinct streams in a group, about
BYLINES = {"author", "byline", "credit", "date", "dateline", "meta", "published", "time", "updated"}  #: names of a paragraph there that is no lead
LEAD_WORDS, SENTENCE_ENDS = 8, ".!?\u2026\u3002\uff01\uff1f\"\u201d\u00bb"  #: of a paragraph in an article's own header
SUSPECT_WORDS, SUSPECT_LINKS = 25, 0.3  #: an element with a doubtful name stays if it has so many words, sentences, and fewer links
OTHER_TEXT = 3  #: articles are teasers if something else named as content has so many times their text
BROADCAST_BYTES = 8_000_000  #: of hosts, or of (stream, block numbers); more are joined by a shuffle

# Elements by what they mean for the text.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "svg", "math", "select", "button", "object", "audio", "video", "canvas", "datalist"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre",
    "search", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
HOLDERS = {"article", "aside", "details", "div", "li", "main", "section", "table", "ul", "ol", "dl", "blockquote", "body"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
NAMES_OUT = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adsbygoogle", "adbox", "banner", "sponsor", "sponsored", "promo", "promotion",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription",
    "signup", "login", "sidebar", "side", "rail", "widget", "widgets", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "header", "masthead",
    "topbar", "footer", "copyright", "legal", "share", "sharing", "social", "related", "recommended", "recommendations", "comment", "comments", "commentlist",
    "disqus", "respond", "replies", "reply", "responses", "discussion", "search", "pagination", "pager", "toolbar", "skip", "hidden", "disclaimer", "feedback",
}
NAMES_IN = {"content", "main", "article", "post", "entry", "story", "maincontent", "articlebody", "postbody", "text"}
#: Words that say nothing about what an element holds.
LAYOUT = {
    "list", "lists", "box", "boxes", "bar", "area", "wrap", "wrapper", "container", "block", "section", "button", "buttons", "btn", "link", "links", "item", "items", "inner", "outer", "left", "right",
    "top", "bottom", "primary", "secondary", "group", "panel", "form", "holder", "module", "slot", "unit", "title", "icon", "icons", "site", "page", "global", "post", "posts", "entry", "article",
    "articles", "wide", "small", "large", "row", "col", "column", "columns", "desktop", "mobile", "fixed", "sticky", "thread", "count", "meta", "view", "reader", "user", "users", "web", "main", "div",
}
#: Beside these a name tells what the page has or does, not what the element is (``no-sidebar``, ``comments-open``).
STATES = {"no", "not", "has", "have", "with", "without", "is", "js", "open", "closed", "enabled", "disabled", "hide", "show", "layout", "free", "less", "off", "ready"}
ROLES_OUT = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}

# Headings over reader comments, in the languages of most pages.
COMMENTS = re.compile(
    r"\W*(?:\d+\s+)?(?:(?:reader|user|all|latest)\s+)?(?:comments?|replies|kommentare?|commentaires?|comentarios?|coment[áa]rios|commenti|reacties|kommentarer|komentarze|комментарии)(?:\s*[(\[]?\d+[)\]]?)?\W*"
    r"|\W*(?:\d+\s+)(?:responses|réponses|respuestas|antworten)\W*|\W*(?:leave a (?:comment|reply)|post a comment|write a comment|join the (?:conversation|discussion)|laisser un commentaire|deja un comentario"
    r"|schreiben sie einen kommentar|what (?:do )?(?:you|readers) (?:think|say))\W*", re.I,
)
#: A quoted value ends where a tag or another attribute can go on; a quote that doesn't end so is a stray one, and the tag ends at the next ``>``.
_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z))*(?:[\"'][^>]*)?)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: What ``out`` says: no text, none but headings (an article's own header), out by name, where the text is kept in case nothing else is left, and
#: a paragraph in an article's own header, to be decided by its text.
NO_TEXT, HEADINGS_ONLY, BY_NAME, LEAD = 1, 2, 3, 4


class Block:
    __slots__ = ("text", "out", "article", "main", "named", "linked", "suspect", "holder", "tag")

    def __init__(self, text: str, linked: int, tag: str, out: int, article: bool, main: bool, named: int, suspect: int, holder: int):
        self.text, self.linked, self.tag, self.out, self.article, self.main, self.named, self.suspect, self.holder = text, linked, tag, out, article, main, named, suspect, holder


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2].strip("\"'")) if m[2] else "" for m in _ATTR.finditer(raw)}


def _names(attributes: dict[str, str]) -> tuple[set[str], bool, bool]:
    """The words in an element's classes and id, without labels that only tell a state; whether a label says "out", and whether one may."""
    found, says, may = set(), False, False
    for label in (attributes.get("class", "") + " " + attributes.get("id", "")).split():
        parts = {n.lower() for n in _NAME.findall(label)}
        whole = {n.lower() for n in re.split(r"[^A-Za-z0-9]+", label) if n}
        if (parts | whole) & STATES:
            continue
        found |= parts | whole
        for words in (parts, whole):
            if words & NAMES_OUT:
                rest = {w for w in words if not w.isdigit() and len(w) > 1} - NAMES_OUT - LAYOUT
                says, may = says or not rest, may or bool(rest)
    return found, says, may


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """The page's blocks that have text, in page order, and the holder around each holder (elements that can hold several blocks)."""
    found: list[Block] = []
    root = ("", 0, False, False, 0, 0, 0)
    stack: list[tuple[str, int, bool, bool, int, int, int]] = []  # name, out, article, main, number of a container named as content, of a suspect, of the holder
    parts: list[str] = []
    open_: Counter[str] = Counter()  # how often a name is on the stack, so that a stray end tag costs nothing
    lists: list[int] = []  # where lists and their items are on the stack
    around = [0]
    linked, in_link, named_last, suspect_last = 0, False, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                top = stack[-1] if stack else root
                found.append(Block(text, linked, *top))
            parts.clear()
        linked = 0

    def shut() -> str:
        """Take the innermost element off the stack."""
        name = stack.pop()[0]
        open_[name] -= 1
        if lists and lists[-1] == len(stack):
            lists.pop()
        return name

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        skipped = bool(stack) and stack[-1][1] in (NO_TEXT, HEADINGS_ONLY)  # what is out gives no text, also within a line
        if m is None:
            if not skipped:
                parts.append(page[at:])
            break
        if m.start() > at and not skipped:
            piece = page[at : m.start()]
            parts.append(piece)
            if in_link:
                linked += len(piece)
        at = m.end()
        if m[2] is None:
            continue
        name, closing, raw = m[2].lower(), bool(m[1]), m[3]
        if name in RAW and not closing:
            if raw.rstrip().endswith("/") and name not in ("script", "style"):
                continue
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name == "a":
            in_link = not closing
        if name in ("td", "th", "br", "img", "wbr", "hr") or name in VOID:
            if name in BLOCKS:
                flush()
            else:
                parts.append("" if name == "wbr" else " ")
            continue
        attributes = _attributes(raw) if raw and not closing and not raw.isspace() else {}
        boundary = name in BLOCKS
        if boundary:
            flush()
        if closing:
            while open_[name]:
                if shut() == name:
                    break
            continue
        if boundary and stack and stack[-1][0] in ("p", *HEADINGS) and name != "span":
            shut()
        if name == "li" and lists and stack[lists[-1]][0] == "li":
            for _ in range(len(stack) - lists[-1]):
                shut()
        names, says, may = _names(attributes) if attributes else (set(), False, False)
        before, out, article, main, named, suspect, holder = stack[-1] if stack else root
        role = attributes.get("role", "").lower()
        style = attributes.get("style", "").replace(" ", "").lower()
        if out in (NO_TEXT, BY_NAME):
            out = NO_TEXT if name in DROPPED or not boundary and says else out
        elif name in DROPPED or role in ROLES_OUT or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
            out = NO_TEXT
        elif name in ("html", "body", "main"):
            pass
        elif name in HEADINGS:
            out = 0 if out == HEADINGS_ONLY else out
        elif name == "p" and out == HEADINGS_ONLY and not says and not may and not names & BYLINES:
            out = LEAD
        elif name == "header" or says and names & NAMES_OUT == {"header"}:
            out = out or (HEADINGS_ONLY if article or main or named else NO_TEXT)
        elif says and not (name == "article" and not names & {"comment", "comments", "reply", "ad", "ads", "sponsored", "related"}):
            out = BY_NAME if boundary else NO_TEXT
        elif may and not says and name != "article" and boundary and not suspect:
            suspect_last += 1
            suspect = suspect_last
        if name == "article" and not out:
            article = True
        if name == "main" or role == "main":
            main = True
        if not out and names & NAMES_IN and name in ("div", "section", "td", "span"):
            named_last += 1
            named = named or named_last
        if name in HOLDERS:
            around.append(holder)
            holder = len(around) - 1
        if not (boundary or names or out != (stack[-1][1] if stack else 0)) and name in ("span", "b", "i", "em", "strong", "a", "u", "font", "small", "sup", "sub", "code", "label"):
            continue
        if name in ("ul", "ol", "menu", "li"):
            lists.append(len(stack))
        stack.append((name, out, article, main, named, suspect, holder))
        open_[name] += 1
    flush()
    # a paragraph in an article's own header is its lead if it reads like text; else it is a date or a name
    kept = [b for b in found if b.out != LEAD or _words(b.text) >= LEAD_WORDS and b.text[-1] in SENTENCE_ENDS]
    for b in kept:
        b.out = 0 if b.out == LEAD else b.out
    return kept, around


def _words(text: str) -> int:
    return text.count(" ") + 1


def _like_text(some: list[Block]) -> bool:
    """Whether blocks read like an article: enough words in sentences, and few of them links."""
    chars = sum(len(b.text) for b in some)
    sentences = any(_words(b.text) >= 8 and b.text[-1] in SENTENCE_ENDS for b in some)
    return sum(_words(b.text) for b in some) >= SUSPECT_WORDS and sentences and sum(b.linked for b in some) < SUSPECT_LINKS * chars


def _commented(found: list[Block], around: list[int]) -> set[int]:
    """The blocks of reader comments: from a heading that says so to the end of its section, or to the next heading of its level."""
    out: set[int] = set()
    for j, b in enumerate(found):
        if b.tag in HEADINGS - {"h1"} and j not in out and COMMENTS.fullmatch(b.text):
            own = not any(_within(x.holder, b.holder, around) for x in found[:j])
            for k in range(j, len(found)):
                if not _within(found[k].holder, b.holder, around) or (not own and k > j and found[k].tag in HEADINGS and found[k].tag <= b.tag):
                    break
                out.add(k)
    return out


def _within(holder: int, outer: int, around: list[int]) -> bool:
    while holder > outer:
        holder = around[holder]
    return holder == outer


def marked(found: list[Block], around: list[int]) -> tuple[list[bool], bool]:
    """Which blocks structure leaves in, and whether it found an article."""
    suspects: dict[int, list[Block]] = {}
    for b in found:
        if b.suspect and not b.out:
            suspects.setdefault(b.suspect, []).append(b)
    doubtful = {s for s, some in suspects.items() if not _like_text(some)}
    comments = _commented(found, around)
    fits = [not b.out and b.suspect not in doubtful and j not in comments for j, b in enumerate(found)]
    sizes: dict[int, int] = {}
    for b, fit in zip(found, fits, strict=True):
        if b.named and fit:
            sizes[b.named] = sizes.get(b.named, 0) + len(b.text) - b.linked
    best = max(sizes, key=lambda n: (sizes[n], -n)) if sizes else -1
    ways = [[fit and w for b, fit, w in zip(found, fits, ws, strict=True)] for ws in ([b.article for b in found], [b.main for b in found], [b.named == best for b in found])]
    text = [sum(len(b.text) - b.linked for b, i in zip(found, way, strict=True) if i) for way in ways]
    for k, way in enumerate(ways):
        if any(way) and text[k] * OTHER_TEXT >= max(text):
            return way, True
    # a paragraph stays although it is mostly a link; a menu's line doesn't
    inside = [fit and (2 * b.linked <= len(b.text) or b.tag == "p" and _words(b.text) >= 6) for b, fit in zip(found, fits, strict=True)]
    if not any(inside):
        named: dict[int, list[Block]] = {}
        for b in found:
            if b.out == BY_NAME:
                named.setdefault(b.holder, []).append(b)
        keep = {h for h, some in named.items() if _like_text(some)}
        inside = [b.out == BY_NAME and b.holder in keep and j not in comments for j, b in enumerate(found)]
    return inside, False


_PAGE = "page_id long, url string, host string, article boolean, key long, lead boolean, size long, blob binary"
_PAGE_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("article", pa.bool_()), ("key", pa.int64()), ("lead", pa.bool_()), ("size", pa.int64()), ("blob", pa.binary())])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A page's blocks that structure leaves in, a line each, packed; ``lead`` marks the first of equal ones of a host in the partition."""
    packer, seen = zstandard.ZstdCompressor(level=3), set()
    for batch in batches:
        article, keys, lead, sizes, blobs = [], [], [], [], []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            found, around = blocks(page.as_py() or "")
            inside, marks = marked(found, around)
            raw = "\n".join(b.text for b, i in zip(found, inside, strict=True) if i).encode("utf-8", "surrogatepass")
            key = xxhash.xxh3_64_intdigest(raw, seed=marks) >> 1
            article.append(marks), keys.append(key), lead.append(bool(raw) and (host, key) not in seen)
            seen.add((host, key)), sizes.append(len(raw))
            blobs.append(packer.compress(raw) if raw else b"")
        columns = [batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(article), pa.array(keys, pa.int64()), pa.array(lead), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, schema=_PAGE_ARROW)


def suffix_array(stream: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes by their first ``depth`` tokens at least, and each one's common prefix with the one before it."""
    n = len(stream)
    rank = np.unique(stream, return_inverse=True)[1].astype(np.int64)
    levels, width = [rank], 1
    order = np.argsort(rank, kind="stable")
    while width < depth and rank.max(initial=0) + 1 < n:
        ahead = np.full(n, -1, np.int64)
        ahead[: n - width] = rank[width:]
        key = rank * (n + 1) + ahead + 1
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, s[1:] != s[:-1]])
        width *= 2
        levels.append(rank)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(max(0, n - 1), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        w = 1 << level
        fits = (a + w <= n) & (b + w <= n)
        same = fits & (levels[level][np.minimum(a, n - 1)] == levels[level][np.minimum(b, n - 1)])
        common[same] += w
        a[same] += w
        b[same] += w
    return order, np.r_[0, common][:n]


_MARK = np.uint64(0x5BD1E9955BD1E995)  #: stands between blocks


class _Streams:
    """The distinct token streams of a group: per page a mark, the words of a block, a mark, and so on, then the page's separator."""

    def __init__(self, table: pa.Table):
        first: dict[int, bytes] = {}
        for key, blob in zip(table.column("key").to_pylist(), table.column("blob"), strict=True):
            if key not in first:
                first[key] = blob.as_py()
        unpack, numbers = zstandard.ZstdDecompressor(), {}
        self.keys = sorted(first)
        words, block, page = [], [], []
        self.n_blocks = []
        for k, key in enumerate(self.keys):
            lines = unpack.decompress(first[key]).split(b"\n")
            self.n_blocks.append(len(lines))
            for j, line in enumerate(lines):
                own = line.split(b" ")
                words.append(0), block.append(-1 - j), page.append(k)
                words += [numbers.setdefault(w, len(numbers) + 1) for w in own]
                block += [j] * len(own)
                page += [k] * len(own)
            words += [0, -1 - k]
            block += [-1 - len(lines)] * 2
            page += [k] * 2
        self.token, self.block, self.page = np.array(words, np.int64), np.array(block, np.int64), np.array(page, np.int64)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in numbers), np.uint64, len(numbers))
        value = np.r_[_MARK, hashes, np.zeros(0, np.uint64)][np.maximum(self.token, 0)]
        n = max(0, len(self.token) - MIN_RUN + 1)
        self.run = np.zeros(n, np.uint64)
        for k in range(MIN_RUN):
            self.run = self.run * np.uint64(0x9E3779B97F4A7C15) + value[k : n + k]
        self.run = _mixed(self.run)
        separators = np.cumsum(self.token < 0)
        self.whole = separators[:n] == separators[MIN_RUN - 1 :] if n else np.zeros(0, bool)  # windows within a page
        if n:
            self.whole &= self.token[:n] >= 0
        # blocks that are too short for a window, marks included, count as a whole
        edge = np.flatnonzero(self.token <= 0)
        length = np.diff(edge) - 1
        short = (length > 0) & (length + 2 < MIN_RUN)
        self.short_at, self.short_length = edge[:-1][short] + 1, length[short]
        self.short = np.zeros(len(self.short_at), np.uint64)
        for k in range(MIN_RUN):
            more = self.short_length > k
            self.short[more] = self.short[more] * np.uint64(0xBF58476D1CE4E5B9) + value[self.short_at[more] + k]
        self.short = _mixed(self.short + np.uint64(1))

    def pages_of(self, value: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values, and on how many pages each is."""
        order = np.lexsort((page, value))
        value, page = value[order], page[order]
        head = np.r_[True, value[1:] != value[:-1]][: len(value)]
        fresh = head | np.r_[True, page[1:] != page[:-1]][: len(value)]
        return value[head], np.bincount(np.cumsum(head) - 1, weights=fresh, minlength=int(head.sum())).astype(np.int64)


def needed(pages: int, article: bool) -> int:
    """On how many of a host's distinct pages a run has to be."""
    few, share = (ARTICLE_PAGES, ARTICLE_SHARE) if article else (MIN_PAGES, MIN_SHARE)
    return max(few, int(np.ceil(share * pages)))


_RUNS = "host string, article boolean, run long, pages long"


def _runs(host: str | None, article: bool, run: np.ndarray, pages: np.ndarray) -> pa.Table:
    return pa.table({"host": pa.array([host] * len(run), pa.string()), "article": pa.array([article] * len(run), pa.bool_()), "run": pa.array(run.view(np.int64)), "pages": pa.array(pages, pa.int64())})


def _candidates(table: pa.Table) -> pa.Table:
    """The runs that are on the host's share of this group's pages, from its suffix array."""
    host, article = table.column("host")[0].as_py(), table.column("article")[0].as_py()
    need = -(-needed(table.column("n")[0].as_py(), article) // table.column("groups")[0].as_py())
    s = _Streams(table)
    runs, pages = [], []
    if len(s.keys) >= need:
        order, common = suffix_array(s.token, MIN_RUN)
        group = np.cumsum(common < MIN_RUN)  # neighbours with so long a common prefix
        fits = np.flatnonzero((order < len(s.run)) & s.whole[np.minimum(order, max(len(s.run) - 1, 0))]) if len(s.run) else np.zeros(0, np.int64)
        at, group = order[fits], group[fits]
        distinct, count = s.pages_of(group, s.page[at])
        first = np.searchsorted(group, distinct)
        runs.append(s.run[at[first]][count >= need]), pages.append(count[count >= need])
        distinct, count = s.pages_of(s.short, s.page[s.short_at])
        runs.append(distinct[count >= need]), pages.append(count[count >= need])
    return _runs(host, article, np.concatenate([*runs, np.zeros(0, np.uint64)]), np.concatenate([*pages, np.zeros(0, np.int64)]))


def _counts(key: tuple, table: pa.Table, asked: pa.Table) -> pa.Table:
    """On how many of a group's pages each candidate of its host is."""
    if not table.num_rows or not asked.num_rows:
        return _runs(None, False, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    s, wanted = _Streams(table), np.unique(asked.column("run").to_numpy().view(np.uint64))
    hit, short = np.flatnonzero(s.whole & np.isin(s.run, wanted)), np.flatnonzero(np.isin(s.short, wanted))
    run, pages = s.pages_of(np.r_[s.run[hit], s.short[short]], np.r_[s.page[hit], s.page[s.short_at[short]]])
    return _runs(table.column("host")[0].as_py(), table.column("article")[0].as_py(), run, pages)


_GONE = "host string, key long, gone array<int>"


def _gone(key: tuple, table: pa.Table, boilerplate: pa.Table) -> pa.Table:
    """The blocks that the host's boilerplate covers in each of a group's streams that loses any."""
    keys, gone = [], []
    if table.num_rows and boilerplate.num_rows:
        s, runs = _Streams(table), np.unique(boilerplate.column("run").to_numpy().view(np.uint64))
        edge = np.zeros(len(s.token) + 1, np.int64)
        hit, short = np.flatnonzero(s.whole & np.isin(s.run, runs)), np.isin(s.short, runs)
        np.add.at(edge, hit, 1), np.add.at(edge, hit + MIN_RUN, -1)
        np.add.at(edge, s.short_at[short], 1), np.add.at(edge, (s.short_at + s.short_length)[short], -1)
        words = s.block >= 0
        starts = np.cumsum([0, *s.n_blocks])
        place = (starts[s.page] + s.block)[words]
        total = np.bincount(place, minlength=int(starts[-1]))
        covered = np.bincount(place, weights=(np.cumsum(edge[:-1]) > 0)[words], minlength=int(starts[-1]))
        out = covered >= COVER * total
        for k, (x, y) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
            if out[x:y].any():
                keys.append(s.keys[k]), gone.append(np.flatnonzero(out[x:y]).tolist())
    host = table.column("host")[0].as_py() if table.num_rows else None
    return pa.table({"host": pa.array([host] * len(keys), pa.string()), "key": pa.array(keys, pa.int64()), "gone": pa.array(gone, pa.list_(pa.int32()))})


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        texts = []
        for blob, gone in zip(batch.column("blob"), batch.column("gone"), strict=True):
            raw, out = blob.as_py(), set(gone.as_py() or ())
            lines = unpack.decompress(raw).decode("utf-8", "surrogatepass").split("\n") if raw else []
            texts.append("\n".join(t for j, t in enumerate(lines) if j not in out))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _few(df: DataFrame) -> DataFrame:
    """``df``, which is written, to be broadcast if it is small: its rows, texts and lists are measured."""
    size = F.lit(64)
    for name, kind in df.dtypes:
        size = size + F.coalesce(F.size(name) * 8 if kind.startswith("array") else F.octet_length(name) if kind == "string" else F.lit(8), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else df


def removed_blocks(parsed: DataFrame, group_pages: int = GROUP_PAGES) -> DataFrame:
    """(host, key, gone): what repetition on the hosts removes from the streams of ``_parse``; streams that lose nothing have no row."""
    leads = parsed.where("lead")
    own = ["host", "article"]
    sizes = leads.select(*own, "key", "size").distinct().groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    hosts = sizes.withColumn("groups", F.ceil(F.greatest(F.col("n") / group_pages, F.col("bytes") / GROUP_BYTES))).drop("bytes")
    hosts = _few(cut(hosts.where(F.col("n") >= F.when(F.col("article"), ARTICLE_PAGES).otherwise(MIN_PAGES))))
    dealt = leads.join(hosts, own).withColumn("group", F.concat_ws("#", F.pmod("key", "groups").cast("string"), F.col("article").cast("string"), "host"))
    streams = dealt.select("group", "host", "article", "n", "groups", "key", "blob")
    found = streams.groupBy("group").applyInArrow(_candidates, _RUNS).select(*own, "run").distinct()

    def sent(runs: DataFrame) -> DataFrame:
        """Runs of a host to each of its groups."""
        to = runs.join(hosts, own).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
        return to.select(F.concat_ws("#", F.col("part").cast("string"), F.col("article").cast("string"), "host").alias("group"), "run")

    counted = streams.groupBy("group").cogroup(sent(found).groupBy("group")).applyInArrow(_counts, _RUNS)
    totals = counted.groupBy(*own, "run").agg(F.sum("pages").alias("pages")).join(hosts, own)
    least = F.when(F.col("article"), F.greatest(F.lit(ARTICLE_PAGES), F.ceil(F.lit(ARTICLE_SHARE) * F.col("n")))).otherwise(F.greatest(F.lit(MIN_PAGES), F.ceil(F.lit(MIN_SHARE) * F.col("n"))))
    boilerplate = totals.where(F.col("pages") >= least).select(*own, "run")
    return streams.groupBy("group").cogroup(sent(boilerplate).groupBy("group")).applyInArrow(_gone, _GONE)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", group_pages: int = GROUP_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars): one row for each row of ``pages``."""
    address = F.col(f"`{url}`")
    host = F.lower(F.regexp_extract(F.coalesce(address, F.lit("")), r"^[^/?#]*//([^/?#]*)", 1))
    read = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), address.alias("url"), host.alias("host"), F.col(f"`{page}`").alias("html"))
    parsed = stash(read.mapInArrow(_parse, _PAGE), "pages")
    gone = _few(cut(removed_blocks(parsed, group_pages)))
    joined = parsed.select("page_id", "url", "host", "key", "blob").join(gone, ["host", "key"], "left")
    return joined.select("page_id", "url", "blob", "gone").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
