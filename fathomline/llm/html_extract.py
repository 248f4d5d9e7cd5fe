"""Main text of web pages.

A page is parsed into lines (the text of its blocks). All pages of a host are put in the order of their URLs' paths, and each is
differenced with pages near it: lines are aligned by a longest common subsequence, and shared ones, the template, go.

What a page says about its own structure refines that: what stands in <nav>, <footer>, <form>, scripts and the like, or in blocks whose whole
name is one of boilerplate, goes though no other page shares it, as adverts and menus here differ on every page of a host; what stands in a
marked article (<article>, <main>, role=main) stays though another page shares it, as copies of an article share all of its lines;
blocks in an article whose name only hints at boilerplate are left to differencing.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .mixing import ranked

# Elements by what they do to text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math canvas object audio video select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACED = frozenset("br td th".split())
SKIPPED = frozenset("nav footer aside form button dialog menu head datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form status".split())
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices
    notification notifications alert alerts popup popups modal overlay newsletter subscribe subscription signup sidebar sidebars rail aside widget widgets related recommended
    recommendations share sharing social breadcrumb breadcrumbs menu menus nav navbar navigation footer masthead topbar toolbar comment comments respond disqus replies
    pagination pager login search tags outbrain taboola paywall""".split()
)
HEADERS = frozenset("header heading hd".split())
OWN_HEADERS = frozenset("article entry post content story title".split())
#: Parts of a name that say nothing beside one of NAMES, and parts that turn it round.
PLACES = frozenset("site page main list slot box bar block wrap wrapper container section area top bottom left right inner outer panel unit region zone holder the my global primary secondary".split())
TURNED = frozenset("no not non without has have with hide free less off term item history text body content article post story".split())
ARTICLES = frozenset("comment comments ad ads advert promo related sponsored".split())
CLOSED_BY = {  # a start tag -> open elements that it ends, up to the nearest container
    **dict.fromkeys("address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(), ("p",)),
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
SCOPES = frozenset("article aside body blockquote div fieldset figure footer form header html li main nav ol section table td th ul dl".split())

#: How much speaks against an element: nothing, a hint in its name, its whole name, what it is.
BODY, HINTED, NAMED, APART = range(4)
#: Places in the order of URLs, from a page, of those that it is differenced with.
NEAREST = (1, -1, 2, -2)
#: Bits of a table of lines x lines that is kept whole.
TABLE = 1 << 26

OPEN = re.compile(r"</?[A-Za-z][^\s/>]*|<[!?/]")
IN_TAG = re.compile(r">|=\s*([\"'])")
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def against(tag: str, attrs: str, inside: bool) -> int:
    """What speaks against an element being of the article."""
    if tag in SKIPPED or tag == "header" and not inside:
        return APART
    if tag in ("html", "body", "main") or not attrs.strip():
        return BODY
    a = {k.lower(): html.unescape(d or s or u or "") for k, d, s, u in ATTR.findall(attrs)}
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")) or a.get("role", "").lower() in ROLES:
        return APART
    if tag not in BLOCKS:
        return BODY
    found = BODY
    for name in (a.get("class", "") + " " + a.get("id", "")).split():
        parts = {p.lower() for p in PARTS.findall(name)}
        if tag == "article":
            found = max(found, NAMED if parts & ARTICLES else BODY)
        elif parts & TURNED and parts & NAMES:
            found = max(found, HINTED if parts.isdisjoint(("no", "not", "non", "without", "has", "have", "with", "hide", "free", "less", "off")) else BODY)
        elif parts & NAMES:
            found = max(found, NAMED if parts <= NAMES | PLACES | HEADERS or all(p.isdigit() or p in NAMES or p in PLACES for p in parts) else HINTED)
        elif parts & HEADERS and not parts & OWN_HEADERS and not inside and parts <= HEADERS | PLACES:
            found = max(found, NAMED)
    return found


def tags(page: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, tag, attributes) of each tag, comment and declaration, in one pass; tag is lower-cased, begins with / for an end, and is empty for the others.

    A quoted value that nothing ends, and quotes behind a tag that nothing ends, are plain characters; a comment or a tag that nothing ends goes on to the
    end of the page.
    """
    at, size, quotes, endless = 0, len(page), True, set()
    while m := OPEN.search(page, at):
        start, at = m.span()
        if page.startswith("<!--", start):
            if page.startswith((">", "->"), start + 4):
                at = page.index(">", start) + 1
            else:
                end = re.compile(r"--!?>").search(page, start + 4)
                at = end.end() if end else size
            yield start, at, "", ""
            continue
        if m[0] in ("</", "<!", "<?"):
            end = page.find(">", at)
            at = end + 1 if end >= 0 else size
            yield start, at, "", ""
            continue
        name, pos, end = m[0][1:].lower(), at, -1
        while quotes and (q := IN_TAG.search(page, pos)):
            if q[0] == ">":
                end = q.start()
                break
            close = -1 if q[1] in endless else page.find(q[1], q.end())
            if close < 0:
                endless.add(q[1])
            pos = q.end() if close < 0 else close + 1
        if end < 0:
            quotes, end = False, page.find(">", at)
        if end < 0:
            yield start, size, "", ""
            return
        attrs, at = page[at:end], end + 1
        yield start, at, name, attrs
        if name in RAW and not (name in ("svg", "math") and attrs.rstrip().endswith("/")):
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I | re.A).search(page, at)
            at = stop.start() if stop else size
            yield end + 1, at, "", ""


def parse(page: str | None) -> list[tuple[str, int, bool]]:
    """(line, what speaks against it, whether it stands in a marked article), in page order; what stands apart has no lines. In proportion to the page's length."""
    if not page:
        return []
    lines: list[tuple[str, int, bool]] = []
    buffer: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # (tag, the most that speaks against it or one around it, inside a marked article)
    where: dict[str, list[int]] = {}  # tag -> its places in the stack
    scopes: list[int] = []
    grade, inside, at = BODY, False, 0

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                lines.append((text, grade, inside))
            buffer.clear()

    def cut(n: int) -> None:
        """Close the elements from place n on."""
        nonlocal grade, inside
        if any(t in BLOCKS for t, _, _ in stack[n:]):
            flush()
        for t, _, _ in reversed(stack[n:]):
            where[t].pop()
            if t in SCOPES:
                scopes.pop()
        del stack[n:]
        grade, inside = stack[-1][1:] if stack else (BODY, False)

    for start, end, tag, attrs in tags(page):
        if start > at and grade < APART:
            buffer.append(page[at:start])
        at = end
        if not tag:
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if tag in SPACED and grade < APART:
                buffer.append(" ")
            places = where.get(tag)
            if places and (tag in BLOCKS or not scopes or places[-1] > scopes[-1]):
                cut(places[-1])
            elif tag == "p" and grade < APART:
                flush()
            continue
        for closed in CLOSED_BY.get(tag, ()):
            places = where.get(closed)
            if places and (not scopes or places[-1] >= scopes[-1]):
                cut(places[-1])
        if tag in BLOCKS and grade < APART:
            flush()
        elif tag in SPACED and grade < APART:
            buffer.append(" ")
        if tag == "body" and stack:
            cut(0)
        if tag in VOID or tag in RAW:
            continue
        worse = max(grade, against(tag, attrs, inside))
        main = inside or worse < APART and (tag == "main" or tag == "article" and worse < NAMED or re.search(r"role\s*=\s*[\"']?main\b", attrs) is not None)
        if main != inside or worse != grade:
            flush()
        if main and not inside and worse == NAMED:
            worse = HINTED  # a name around the article says little
        where.setdefault(tag, []).append(len(stack))
        if tag in SCOPES:
            scopes.append(len(stack))
        stack.append((tag, worse, main))
        grade, inside = worse, main
    if at < len(page) and grade < APART:
        buffer.append(page[at:])
    flush()
    return lines


#: What a line is to its page: the others' to look at only, a part of the text, or one that goes where another page shares it.
OTHER, KEPT, LOOSE = range(3)


def roles(lines: list[tuple[str, int, bool]]) -> list[int]:
    """What each line is. The candidates are the article's lines, where one is marked, else all but named boilerplate, else all: no name can empty a page."""
    marked = any(g < NAMED and i for _, g, i in lines)
    plain = any(g < NAMED for _, g, _ in lines)
    out = []
    for _, g, i in lines:
        if marked:
            out.append(OTHER if g >= NAMED or not i else LOOSE if g == HINTED else KEPT)
        else:
            out.append(LOOSE if g < NAMED or not plain else OTHER)
    return out


def key(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def shared(a: list, b: list) -> list[bool]:
    """For each line of a, whether a longest common subsequence with b holds it.

    Rows of the usual table are kept as the bits of integers; a table of more than TABLE bits is halved by the middle of b first, so memory stays
    in proportion to the lines, time to lines x lines / 64.
    """
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return [True] * lead + _common(a[lead : len(a) - tail], b[lead : len(b) - tail]) + [True] * tail


def _rows(x: list, y: list) -> Iterator[int]:
    """For each line of y, the bits of x at which the length of the common subsequence doesn't grow."""
    where: dict = {}
    for i, s in enumerate(x):
        where[s] = where.get(s, 0) | 1 << i
    full = (1 << len(x)) - 1
    v = full
    for s in y:
        u = v & where.get(s, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(x: list, y: list) -> list[int]:
    """The length of a longest common subsequence of y and each beginning of x."""
    v = (1 << len(x)) - 1
    for v in _rows(x, y):  # noqa: B007
        pass
    out = [0]
    for bit in reversed(format(v, f"0{len(x)}b")):
        out.append(out[-1] + (bit == "0"))
    return out


def _common(x: list, y: list) -> list[bool]:
    if not x or not y:
        return [False] * len(x)
    if len(x) * len(y) > TABLE and len(y) > 1:
        mid = len(y) // 2
        f, g = _lengths(x, y[:mid]), _lengths(x[::-1], y[mid:][::-1])
        k = max(range(len(x) + 1), key=lambda i: f[i] + g[len(x) - i])
        return _common(x[:k], y[:mid]) + _common(x[k:], y[mid:])
    rows, hit = list(_rows(x, y)), [False] * len(x)
    col, row = len(x), len(y)
    while col and row:
        if rows[row - 1] >> (col - 1) & 1:
            col -= 1
        else:
            row -= 1
            if not row or rows[row - 1] >> (col - 1) & 1:
                col -= 1
                hit[col] = True
    return hit


def template(own: list, others: list[list]) -> list[bool]:
    """Of a page's lines those shared with the other page that shares the fewest (ties: the first), however many; none if there is no other."""
    return min((shared(own, other) for other in others), key=sum, default=[False] * len(own))


def _address(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    return pages.select("page_id", "url", "html", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text (blocks joined by a line feed, empty if none), n_chars.

    Null html has no text. A null or odd URL has the host and path that a simple split gives. The pages of a host, one of each list of lines, are put in
    the order of path, url and lines. Of the two before and the two after, the one that shares the fewest lines is the other page; of what is shared, a marked
    article's own lines stay, all else goes, however much it is. Copies, of other URLs or the same, are treated alike; a page alone on its host keeps what it has.
    Repeated rows come back as often. Other columns don't matter. Pages are parsed twice, so that only hashes of lines are dealt by host.
    """
    at = _address(pages)

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [parse(h) for h in batch["html"]]
            yield pd.DataFrame({"host": batch["host"], "path": batch["path"], "url": batch["url"], "lines": [[key(t) for t, _, _ in x] for x in found], "roles": [roles(x) for x in found]})

    each = at.mapInPandas(hashes, "host string, path string, url string, lines array<long>, roles array<int>")
    each = C.stored(each.withColumn("sig", F.xxhash64("lines", "roles")), "lines")
    gone = C.stored(templates(each), "templates")

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [[(t, r) for (t, _, _), r in zip(x, roles(x), strict=True) if r] for x in map(parse, batch["html"])]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "host": batch["host"], "text": ["\n".join(t for t, _ in x) for x in found]})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [parse(h) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "host": batch["host"], "lines": [[key(t) for t, _, _ in x] for x in found], "roles": [roles(x) for x in found], "texts": [[t for t, _, _ in x] for x in found]})

    if gone.isEmpty():
        d = at.mapInPandas(texts, "page_id long, url string, host string, text string")
    else:
        d = at.mapInPandas(whole, "page_id long, url string, host string, lines array<long>, roles array<int>, texts array<string>")
        d = d.withColumn("sig", F.xxhash64("lines", "roles")).drop("lines").join(gone, ["host", "sig"], "left")
        kept = F.expr("filter(texts, (t, i) -> element_at(roles, i + 1) > 0 AND (gone IS NULL OR NOT element_at(gone, i + 1)))")
        d = d.withColumn("text", F.array_join(kept, "\n"))
    return d.select("page_id", "url", "text").withColumn("n_chars", F.length("text").cast("long"))


def templates(each: DataFrame) -> DataFrame:
    """(host, sig, gone): of each list of lines (host, path, url, lines, roles, sig) of a host from which some go, whether each goes."""
    # One page of each list of lines a host takes part in the order: a copy is never a partner.
    first = each.groupBy("host", "sig").agg(F.min(F.struct("path", "url", "lines", "roles")).alias("f")).select("host", "sig", "f.*")
    order = ranked(first, "host", [F.asc("path"), F.asc_nulls_first("url"), F.asc("sig")])
    # Each row is sent to its own place in the order and to those near it; five rows meet at a place.
    near = order.select("host", F.col("rank"), "sig", "lines", "roles", F.explode(F.array(*[F.lit(k) for k in (0, *NEAREST)])).alias("k"))
    near = near.select("host", (F.col("rank") - F.col("k")).alias("place"), "k", "sig", "lines", F.when(F.col("k") == 0, F.col("roles")).alias("roles"))
    met = near.groupBy("host", "place").agg(F.collect_list(F.struct("k", "sig", "lines", "roles")).alias("rows")).filter("exists(rows, r -> r.k = 0) AND size(rows) > 1")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for host, rows in zip(batch["host"], batch["rows"], strict=True):
                by = {r["k"]: r for r in rows}
                own = by[0]
                hit = template(list(own["lines"]), [list(by[k]["lines"]) for k in NEAREST if k in by])
                goes = [bool(h) and r == LOOSE for h, r in zip(hit, own["roles"], strict=True)]
                if any(goes):
                    out.append((host, own["sig"], goes))
            yield pd.DataFrame(out, columns=["host", "sig", "gone"])

    return met.select("host", "rows").mapInPandas(align, "host string, sig long, gone array<boolean>")
