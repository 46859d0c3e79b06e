"""Main text of web pages with site template removal.

One pass over a page's markup gives its text blocks and, as ranges of blocks,
what its elements cover.  First *site templates* go: subtrees whose hash recurs on many pages of
the host, whatever their tags, roles and names.  Rules settle what recurs too
seldom: elements that say by tag, role, class or id that they are no article
text, and everything outside the main element, where a page marks one.

Subtree hashes are counted in Spark per host over pages with different main
content, so a thousand copies of one page count as one and don't turn their
article into a template.  Inside a marked main element only containers, and what the rules
name, can be templates: a sentence that many articles of a host quote stays.

Rules know two sizes.  A form or fieldset that holds more than half of a page is its wrapper, not a form
in it.  A page that is nothing but named boilerplate keeps the parts that hold more than half of it.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.scratch import materialize

#: Parts into which the rows of one (host, hash) are dealt where templates are joined.
SALTS = 64

_TAG = re.compile(
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"  # a tag with balanced quotes
    r"|<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?/][^>]*+(?:>|\Z)"  # a comment, a declaration, a stray end
    r"|<(/?)([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)",  # a tag whose quotes don't balance
    re.S,
)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

# Element names by their part in a page.
_RAW = frozenset("script style textarea title noscript template iframe noframes noembed xmp".split())
_SKIP = frozenset("svg math canvas audio video object select option datalist button applet map".split())
_NESTS = frozenset("svg math object applet".split())  # of these, one may stand in another
_ENDS_OPTION = frozenset("option optgroup select datalist".split())
_BOILER = frozenset("nav footer aside form menu dialog fieldset header".split())
_MAIN = frozenset(["main", "article"])
_BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table caption tbody thead tfoot tr ul search".split()
)
_CONTAINER = frozenset("div section ul ol dl table aside figure details center".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SPACED = frozenset("br td th option img input".split())
_ENDS_P = _BLOCK - {"html", "body", "tbody", "thead", "tfoot", "tr", "caption", "legend"}
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tooltip status".split())
_WORDS = frozenset(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar footer masthead topbar ad ads advert adverts advertisement advertising adsense adbox adslot banner promo promotion sponsor sponsored sponsors cookie cookies consent gdpr notice notices notification popup modal overlay lightbox newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus reply replies pagination pager toolbar widget widgets skip copyright paywall".split()
)
_HEAD_WORDS = frozenset(["header"])  # of a page, not of its article
_HAVING = frozenset(["with", "has", "without"])  # "with-sidebar" isn't the sidebar
_WRAPPERS = frozenset(["form", "fieldset"])  # may hold a whole page; these say nothing of their content

PARSED = (
    "page_id long, url string, host string, content long, n_blocks int, main array<int>, kept binary, "
    "templates array<struct<hash: long, first: int, stop: int>>"
)


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        out.setdefault(name.lower(), a or b or c)
    return out


def _says_boilerplate(attrs: dict[str, str], in_main: bool) -> bool:
    if attrs.get("role", "").lower() in _ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")):
        return True
    words: set[str] = set()
    for name in (attrs.get("class", "") + " " + attrs.get("id", "")).split():
        parts = [w.lower() for w in _WORD.findall(name)]
        words.update(w for w, before in zip(parts, ["", *parts]) if before not in _HAVING)
    return bool(words & _WORDS) or (not in_main and bool(words & _HEAD_WORDS))


def holds(ranges: list[tuple[int, int]]):
    """Test whether a range holds any of ``ranges`` whole."""
    ranges = sorted(ranges)
    starts, least = [a for a, _ in ranges], [z for _, z in ranges]
    for i in range(len(least) - 2, -1, -1):
        least[i] = min(least[i], least[i + 1])
    return lambda a, z: (i := bisect_left(starts, a)) < len(starts) and least[i] <= z


def within_any(ranges: list[tuple[int, int]]):
    """Test whether any of ``ranges`` holds a range whole."""
    ranges = sorted(ranges)
    starts, most = [a for a, _ in ranges], list(accumulate((z for _, z in ranges), max))
    return lambda a, z: (i := bisect_right(starts, a)) > 0 and most[i - 1] >= z


def covered(ranges: list[tuple[int, int]], n: int) -> list[bool]:
    """For each of ``n`` blocks whether any of the ranges covers it."""
    edge = [0] * (n + 1)
    for a, z in ranges:
        edge[a] += 1
        edge[z] -= 1
    return [x > 0 for x in accumulate(edge)][:n]


def parse_page(page: str) -> tuple[list[str], list[tuple[int, int, int]], int]:
    """Text blocks of a page's main part by the rules, its template candidates there (hash, first block, stop), and a hash of its content."""
    blocks, main, spans, content = read_page(page)
    kept = set(main)
    place = [0, *accumulate(int(i in kept) for i in range(len(blocks)))]
    inner = {(h, place[a], place[z]) for h, a, z in spans if place[z] > place[a]}
    return [blocks[i] for i in main], sorted(inner), content


def read_page(page: str) -> tuple[list[str], list[int], list[tuple[int, int, int]], int]:
    """All text blocks of a page, the numbers of those that the rules keep, its template candidates (hash, first block, stop), and a hash of what the rules keep.

    Any string gives a result, in time that grows with its length: markup that isn't closed ends with the page.
    """
    blocks: list[str] = []
    inline: list[str] = []
    dropped: list[tuple[int, int, bool]] = []  # first, stop, says what it holds
    mains: list[tuple[bool, int, int, bool, bool]] = []  # is it <main>, first, stop, says boilerplate, is of the page
    candidates: dict[tuple[int, int], tuple[int, int | None]] = {}
    # An open element: tag, first block, says boilerplate by name (2) or tag (1), is a main element of the page (2) or an article (1), hash parts
    stack: list[tuple[str, int, int, int, list[str]]] = []
    standing: Counter[str] = Counter()  # open elements by tag
    open_mains = at = 0
    # The outermost skipped element, where its content starts, and what is open in it: tag, content start
    skip, start = "", 0
    inside: list[tuple[str, int]] = []
    within: Counter[str] = Counter()
    later: dict[str, int] = {}  # where a pattern is found next
    unclosed: set[int] = set()  # where the content of elements of _SKIP without an end starts

    def unskip() -> int:
        """Where to read on when the skipped element turns out to have no end, so that it hides nothing."""
        nonlocal skip
        unclosed.update([start, *(i for _, i in inside)])
        inside.clear()
        within.clear()
        skip = ""
        return start

    def following(pattern: str, after: int) -> int:
        """Where the pattern is found next, or the page's end; each part of the page is searched once a pattern."""
        if later.get(pattern, -1) < after:
            found = re.compile(pattern, re.I).search(page, after)
            later[pattern] = found.start() if found else len(page)
        return later[pattern]

    def flush() -> None:
        if inline:
            text = " ".join(html_lib.unescape("".join(inline)).split())
            inline.clear()
            if text:
                blocks.append(text)
                if stack:
                    stack[-1][4].append(text)

    def close() -> None:
        nonlocal open_mains
        tag, first, boiler, main, parts = stack.pop()
        standing[tag] -= 1
        stop = len(blocks)
        if main:
            open_mains -= 1
            mains.append((tag == "main", first, stop, boiler > 0, main == 2))
        if not parts:
            return
        digest = xxhash.xxh64_intdigest("\0".join([tag, *parts]))
        if stack:
            stack[-1][4].append(f"\1{digest:x}")
        if boiler:
            dropped.append((first, stop, boiler == 2 or tag not in _WRAPPERS))
        # Of elements that hold the same blocks the innermost counts, as it recurs at least as often: of all, and of those that are no leaves.
        if stop > first and tag not in ("html", "body") and not main and (boiler or not open_mains or tag in _CONTAINER):
            inner, solid = candidates.get((first, stop), (digest, None))
            candidates[first, stop] = inner, digest if solid is None and (boiler or tag in _CONTAINER) else solid

    while True:
        found = _TAG.search(page, at)
        if not skip:
            inline.append(page[at : found.start() if found else len(page)])
        if found is None:
            if skip in ("", "option"):
                break
            at = unskip()
            continue
        at = found.end()
        name = found[2] or found[5]
        if not name:
            continue
        tag, ends, rest = name.lower(), bool(found[1] or found[4]), found[3] or ""
        if tag in _RAW and not ends:
            at = following(f"</{tag}(?=[\\s/>])", at)
            continue
        if skip == "option":  # its end tag may be left out, and it holds text only
            if tag in _ENDS_OPTION and (ends or tag in ("option", "optgroup")):
                skip = "" if ends else skip
                continue
            if ends and not standing[tag]:
                continue
            skip = ""
        elif skip:
            if ends and within[tag]:
                while inside[-1][0] != tag:
                    within[inside[-1][0]] -= 1
                    unclosed.add(inside.pop()[1])
                inside.pop()
                within[tag] -= 1
            elif ends and tag == skip:
                skip = ""
                inside.clear()
                within.clear()
            elif standing[tag] if ends else tag == skip not in _NESTS or (tag == "body" and skip not in ("svg", "math")):
                at = unskip()
            elif not ends and tag != "option" and (tag in _BLOCK or tag in _SKIP) and tag not in _VOID and not rest.rstrip().endswith("/"):
                inside.append((tag, at))
                within[tag] += 1
            continue
        if tag in _SKIP and not ends and at not in unclosed and not rest.rstrip().endswith("/"):
            skip, start = tag, at
            continue
        if tag in _SPACED:
            inline.append(" ")
        if tag not in _BLOCK:
            attrs = _attributes(rest) if rest and not ends and tag in ("span", "a", "label", "ins") else {}
            if not attrs or tag in _VOID or not _says_boilerplate(attrs, open_mains > 0):
                continue  # inline elements leave the block open
            end = following(f"</{tag}\\s*>", at)
            if end < len(page) and following(f"<{tag}", at) > end:
                at = page.index(">", end) + 1
            continue
        flush()
        if ends:
            if standing[tag]:
                while stack[-1][0] != tag:
                    close()
                close()
            continue
        if tag in _VOID:
            continue
        if tag in _ENDS_P and stack and stack[-1][0] == "p":
            close()
        if tag in ("li", "dt", "dd", "tr") and stack and stack[-1][0] in ({"dt", "dd"} if tag[0] == "d" else {tag}):
            close()
        attrs = _attributes(rest) if rest else {}
        of_page = tag == "main" or attrs.get("role") == "main" or attrs.get("itemprop", "").lower() == "articlebody"
        main = 2 if of_page else int(tag in _MAIN)
        boiler = 2 if tag not in ("html", "body") and _says_boilerplate(attrs, open_mains > 0) else 0
        boiler = boiler or int((tag in _BOILER and not (tag == "header" and open_mains)) or tag == "search")
        stack.append((tag, len(blocks), boiler, main, []))
        standing[tag] += 1
        open_mains += main > 0
    flush()
    while stack:
        close()

    sizes = [0]
    for b in blocks:
        sizes.append(sizes[-1] + len(b))

    def size(first: int, stop: int) -> int:
        return sizes[stop] - sizes[first]

    # What holds the page's main element is a wrapper, whatever its name.
    of_page = [m for m in mains if m[4] and not m[3] and m[2] > m[1]]
    spared = holds([(m[1], m[2]) for m in of_page])
    dropped = [d for d in dropped if not spared(d[0], d[1])]
    for strict in (True, False):  # named boilerplate goes at any size, unless nothing else is on the page
        def goes(a: int, z: int, named: bool) -> bool:
            return (strict and named) or 2 * size(a, z) <= size(0, len(blocks))

        hidden = within_any([d[:2] for d in dropped if goes(*d)])
        able_mains = [m for m in mains if not m[3] and not hidden(m[1], m[2])]
        root = max(able_mains, key=lambda m: (m[0], size(m[1], m[2]))) if able_mains else None
        if root is not None and size(root[1], root[2]):
            first, stop = root[1], root[2]
            cut = [(a, z) for a, z, _ in dropped if not (a <= first and stop <= z)]
        else:
            first, stop = 0, len(blocks)
            cut = [(a, z) for a, z, named in dropped if goes(a, z, named) or z - a < 2]
        kept = [i for i, gone in enumerate(covered(cut, len(blocks))) if first <= i < stop and not gone]
        if kept:
            break
    # What holds the whole of the main part is no template of the site, but the page.  Where a page marks its main part, leaves are no candidates.
    whole = (kept[0], kept[-1] + 1) if kept else (0, 0)
    able = [(inner, a, z) for (a, z), (inner, _) in candidates.items()]
    if root is not None:
        able = [(solid, a, z) for (a, z), (_, solid) in candidates.items() if solid is not None and not (kept and a <= whole[0] and whole[1] <= z)]
    spans = sorted((h - (1 << 63), a, z) for h, a, z in able)
    return blocks, kept, spans, xxhash.xxh64_intdigest("\n".join(blocks[i] for i in kept)) - (1 << 63)


def parse_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``PARSED`` for each page; a null page is empty, a null url belongs to the empty host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("hash", pa.int64()), ("first", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            n_blocks, main, kept, spans, content = [], [], [], [], []
            for page in batch.column(3):
                b, m, s, c = read_page(page.as_py() or "")
                n_blocks.append(len(b))
                main.append(m)
                # No other block's text is needed again; compressed, as it is written and shuffled.
                kept.append(zlib.compress("\n".join(b[i] for i in m).encode("utf-8", "surrogatepass"), 1))
                spans.append([{"hash": h, "first": a, "stop": z} for h, a, z in s])
                content.append(c)
            yield pa.record_batch([*(batch.column(i) for i in range(3)), pa.array(content, pa.int64()), pa.array(n_blocks, pa.int32()), pa.array(main, pa.list_(pa.int32())), pa.array(kept, pa.binary()), pa.array(spans, kind)], names=["page_id", "url", "host", "content", "n_blocks", "main", "kept", "templates"])

    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, PARSED)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 5) -> DataFrame:
    """Main text of every page: ``page_id, url, text, n_chars, n_template, n_rules`` (blocks that are a template's, and others that the rules take).

    A subtree is a template of its host if it stands on at least ``min_pages``
    pages with different content, however many the host has.  Null and
    empty pages give empty text; null ids and repeated rows stay rows; further columns are
    ignored; an empty table gives no rows.  A page of any length is parsed whole,
    in linear time and a few times its own size of memory.
    """
    parsed = materialize(parse_pages(pages, id_col, url_col, html_col).withColumn("row", F.monotonically_increasing_id()), "pages")
    spans = parsed.filter(F.size("templates") > 0).select("row", "host", "content", F.explode("templates").alias("t"))
    # A hash of 64 bits stands for the host and its subtree from here on.
    spans = spans.select("row", F.xxhash64("host", "t.hash").alias("hash"), "content", "t.first", "t.stop")
    counts = spans.select("hash", "content").distinct().groupBy("hash").agg(F.count("*").alias("n"))
    spans = spans.drop("content")
    often = counts.filter(F.col("n") >= min_pages)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    often = often.select("hash").withColumn("salt", salts)
    hits = spans.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(often, ["hash", "salt"])
    hits = hits.groupBy("row").agg(F.collect_list(F.struct("first", "stop")).alias("cuts"))  # at most a page's elements
    # Pages without candidates, which may be most, have nothing to look up and aren't shuffled.
    asked = parsed.filter(F.size("templates") > 0).select("row", "page_id", "url", "n_blocks", "main", "kept").join(hits, "row", "left").drop("row")
    plain = parsed.filter(F.size("templates") == 0).select("page_id", "url", "n_blocks", "main", "kept", F.lit(None).cast(asked.schema["cuts"].dataType).alias("cuts"))
    whole = asked.union(plain)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, by_template, by_rules = [], [], []
            for n, main, kept, cuts in zip(*(batch.column(i) for i in range(2, 6))):
                n, main = n.as_py(), main.as_py()
                gone = covered([(c["first"], c["stop"]) for c in cuts.as_py()], n) if cuts.is_valid else [False] * n
                blocks = zlib.decompress(kept.as_py()).decode("utf-8", "surrogatepass").split("\n") if main else []
                left = [b for b, i in zip(blocks, main) if not gone[i]]
                texts.append("\n".join(left))
                by_template.append(sum(gone))
                by_rules.append(n - sum(gone) - len(left))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(by_template, pa.int64()), pa.array(by_rules, pa.int64())], names=["page_id", "url", "text", "n_template", "n_rules"])

    out = whole.mapInArrow(cut, "page_id long, url string, text string, n_template long, n_rules long")
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_template", "n_rules")
