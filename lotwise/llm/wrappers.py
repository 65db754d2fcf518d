"""Operator 2: main text of web pages by wrappers inferred per host.

A page is a stream of tag tokens (name and class) and text tokens. For each host a wrapper, a union-free regular
expression, starts as one page's stream with adjacent repeats folded into (...)+ groups and is aligned with more
pages, one after another: equal tokens stay, what one side lacks becomes (...)?, and single occurrences of a known repeat
count as one turn of it. A text that all aligned pages, SAME of them at least, have at a position (in a repeat: in any
of its turns) is template; differing texts become slots, and so does a template text that any other page of the host has
not (Spark looks for them on all pages). Where most of a host's content would be template, its pages are copies of each other and no text is.

The main text is what stands in slots of content positions. A position is content if most aligned pages have it in a
content region: inside <article> or <main> where there is one, and outside navigation, headers, footers, sidebars,
notices, adverts, forms and comments. Class names count by all their words; those that articles use too ("menu") only where
links hold most of the text, and a label only where its block is not running text. A page is matched by the sets of wrapper
positions that can produce the rest of it, so every page that a wrapper was aligned with is matched. A page that its
host's wrapper does not match is split into regions by itself.

A wrapper is fitted on all different pages of its host: about PAGES of them (dealt out by a hash of the page) make a partial
wrapper, and FAN partial wrappers at a time are aligned with each other until one is left. A page or partial wrapper that
would take it beyond MAX_SYMBOLS tags and texts, with repeats of at most MAX_BODY tokens folded, is left out; every page is
extracted in whole. Wrappers go to the pages by broadcast while they take at most BROADCAST_BYTES together, else in
a join whose pages are dealt out to SALTS parts a host.

Cases: null and empty html give an empty text; a page without tags is text; a tag that does not end before the next "<"
is text; a null or odd url is a host of its own; repeated rows each give a row; ids may be null.
"""

from __future__ import annotations

import difflib
import html as html_lib
import json
import re
from functools import lru_cache
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import map_arrow, saved, small_batches, table, tidy

#: different pages of a partial wrapper, on average, and partial wrappers that are aligned at a time
PAGES, FAN = 24, 24
#: aligned pages that a template text must be equal on
SAME = 5
MAX_SYMBOLS = 4000
BROADCAST_BYTES = 32 << 20
SALTS = 32
#: longest body of a repeated group, in tokens
MAX_BODY = 48

# fixed values: element names and class words
RAW = "script|style|template|textarea|select|title"
BOILER_TAGS = frozenset("nav footer aside form button dialog menu fieldset header head".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_WORDS = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies copyright disqus feedback footer gdpr legal login menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion reactions recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar widget widgets".split())
#: words that change nothing beside a boilerplate word in one class name
NEUTRAL_WORDS = frozenset("area bar block bottom box container content fixed form global group inner item left links list main outer page primary right secondary section site small sticky text top wrap wrapper".split())
#: what compound names of boilerplate are made of besides: whose it is, and what it is
COMPOUND_WORDS = NEUTRAL_WORDS | frozenset(
    "article articles blog button buttons c card cards count entry feed heading holder icon icons js label placeholder post posts reader readers reading slot stories story thread title tools trail unit units user users zone".split())
#: names of an article's own parts as well; inside <article> or <main> they count only with links
WEAK_WORDS = frozenset("feedback legal menu search teaser".split())
CONTROLS = frozenset("button input".split())
PAGE_HEADER_WORDS = frozenset("header masthead topbar".split())
ROOTS = ("article", "main")
#: end tags that a page may leave out at its end: no part of a wrapper
IMPLIED = ("/body", "/html")

ATTRS = r"""(?>=\s*"[^"]*"|=\s*'[^']*'|[^<>])*+"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b{ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<attrs>{ATTRS})>|<[!?][^<>]*>",
    re.S | re.I)
ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
TEXT, SPACE = "#", ""


def tokens(page: str) -> list[tuple[str, str]]:
    """(symbol, text): a tag's symbol is its name and class words, "/name" for an end tag; texts have "#", white space
    between tags has "" and is no part of the symbol stream."""
    out, at = [], 0

    def text(part: str) -> None:
        if part:
            out.append((SPACE, " ") if part.isspace() else (TEXT, html_lib.unescape(part)))

    for m in TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name:
            if m["close"]:
                out.append(("/" + name.lower(), ""))
            else:
                attrs = m["attrs"]
                words = ".".join(x for a in ATTR.findall(attrs) for x in "".join(a).lower().split()) if attrs and ("=" in attrs) else ""
                out.append((f"{name.lower()}.{words}" if words else name.lower(), ""))
    text(page[at:])
    return out


def plain(text: str) -> str:
    return " ".join(text.split())


@lru_cache(maxsize=100_000)
def boilerplate(symbol: str, inside: bool) -> str:
    """"sure" if a start tag opens boilerplate, "weak" if it does where links hold most of its text, else "". ``inside``: in
    an article or main element."""
    name, *words = symbol.split(".")
    if name in VOID_TAGS or name in ("html", "body"):
        return ""
    parts = [set(filter(None, re.split(r"[^a-z0-9]+", w))) for w in words]
    named = [p & BOILER_WORDS for p in parts if p & BOILER_WORDS and p <= BOILER_WORDS | COMPOUND_WORDS]
    header = any(p & PAGE_HEADER_WORDS and p <= PAGE_HEADER_WORDS | NEUTRAL_WORDS for p in parts)
    if name not in ROOTS and (name in BOILER_TAGS and not (name == "header" and inside) or header and not inside):
        return "sure"
    if not named:
        return ""
    return "weak" if inside and all(p <= WEAK_WORDS for p in named) else "sure"


def form_labels(names: list[str]) -> set[int]:
    """Labels that are not part of running text: their block has a form control, or no text beside labels."""
    found, block, depth, control, text = set(), [], 0, False, False
    for k, name in enumerate([*names, "/body"]):
        if name.lstrip("/") in BLOCK_TAGS:
            if control or not text:
                found.update(block)
            block, depth, control, text = [], 0, False, False
        elif name == "label":
            block.append(k)
            depth += 1
        elif name == "/label":
            depth = max(0, depth - 1)
        elif name in CONTROLS:
            control = True
        elif name == TEXT and not depth:
            text = True
    return found


def regions(symbols: list[str], sizes: list[int] | None = None) -> list[bool]:
    """Whether each token stands in a content region; sizes: the lengths of the texts (tags have any)."""
    names = [s.split(".", 1)[0] for s in symbols]
    ends, start_of, open_ = {}, {}, {}
    for k, name in enumerate(names):
        if name.startswith("/"):
            if open_.get(name[1:]):
                start = open_[name[1:]].pop()
                ends[start], start_of[k] = k, start
        elif name != TEXT:
            open_.setdefault(name, []).append(k)
    labels = form_labels(names) if "label" in names else ()
    size = sizes or [1] * len(names)
    # texts before each token, and of these what stands in links
    read, linked, links = [0], [0], 0
    for name, n in zip(names, size):
        links = max(0, links + (name == "a") - (name == "/a"))
        read.append(read[-1] + (n if name == TEXT else 0))
        linked.append(linked[-1] + (n if name == TEXT and links else 0))
    skip, depth, k = [False] * len(names), dict.fromkeys(ROOTS, 0), 0
    where: list[tuple[bool, bool]] = []
    while k < len(names):
        name = names[k]
        if name.lstrip("/") in ROOTS:
            depth[name.lstrip("/")] = max(0, depth[name.lstrip("/")] + (-1 if name.startswith("/") else 1))
        inside = tuple(depth[r] > 0 for r in ROOTS)
        where.append(inside)
        kind = "" if name == TEXT or name.startswith("/") else "sure" if k in labels else boilerplate(symbols[k], any(inside))
        if kind == "weak":
            last = ends.get(k, len(names) - 1)
            kind = "sure" if 2 * (linked[last] - linked[k]) > read[last] - read[k] else ""
        if kind:
            if name in ROOTS:
                depth[name] -= 1
            # the element ends at its end tag, or with what holds it; without an end tag also where content begins
            last, closed = ends.get(k, len(names) - 1), k in ends
            j = k + 1
            while j <= last:
                if names[j] in ("/article", "/main", "/body") and start_of.get(j, -1) < k and j != ends.get(k) or not closed and names[j] in ("article", "main", "body"):
                    break
                j += 1
            skip[k:j] = [True] * (j - k)
            where += [inside] * (j - k - 1)
            k = j
        else:
            k += 1
    total = [sum(n for n, s, w, x in zip(size, symbols, where, skip) if s == TEXT and w[r] and not x) for r in range(len(ROOTS))]
    # main only where it holds far more than its articles
    root = None if not any(total) else 0 if 2 * total[0] >= total[1] else 1
    return [not x and (root is None or w[root]) for w, x in zip(where, skip)]


# A wrapper's items: ("t", symbol, (texts that every page has there, how often it stood in a content region, how often at
# all, pages, total length of its texts)), ("+", items) and ("?", items)


def leaves_of(page: str) -> list:
    got = [(s, plain(t)) for s, t in tokens(page) if s != SPACE]
    keep = regions([s for s, _ in got], [len(t) for _, t in got])
    return [("t", s, (frozenset([t] if t else []), int(k), 1, 1, len(t))) for (s, t), k in zip(got, keep) if s not in IMPLIED]


def key(item) -> str:
    return item[1] if item[0] == "t" else f"({''.join(key(i) + ' ' for i in item[1])}){item[0]}"


def merge(a, b, turn: bool = False):
    """Two items with equal keys as one: of two pages, or two turns of a repeat on one page."""
    if a[0] != "t":
        return (a[0], [merge(x, y, turn) for x, y in zip(a[1], b[1])])
    (t, k, n, p, z), (u, j, m, q, y) = a[2], b[2]
    return ("t", a[1], (t | u if turn else t & u, k + j, n + m, max(p, q) if turn else p + q, z + y))


def repeats(keys: list[str], size: int) -> bool:
    """Whether a body of ``size`` keys stands there twice in a row."""
    run = 0
    for a, b in zip(keys, keys[size:]):
        run = run + 1 if a == b else 0
        if run == size:
            return True
    return False


def fold(items: list, bodies: set[tuple[int, str]]) -> list:
    """Adjacent repeats become one ("+", body); so do single occurrences of bodies (size, key) that are known to repeat."""
    keys = [key(i) for i in items]
    for size in range(1, min(MAX_BODY, len(keys)) + 1):
        known_here = {b for n, b in bodies if n == size}
        if not known_here and not repeats(keys, size):
            continue
        heads = {b[1:].split(" ", 1)[0].lstrip("(") for b in known_here}  # how a known body begins
        starts = {k for k in range(len(keys) - size) if keys[k] == keys[k + size]}
        out, out_keys, at = [], [], 0
        while at < len(items):
            known = keys[at].lstrip("(").split(" ", 1)[0] in heads
            if at not in starts and not known:
                out.append(items[at])
                out_keys.append(keys[at])
                at += 1
                continue
            body = keys[at : at + size]
            turns = 1
            while body and len(body) == size and keys[at + turns * size : at + (turns + 1) * size] == body:
                turns += 1
            joined = f"({''.join(k + ' ' for k in body)})+"
            # what may be left out makes no body, as a repeat of it could be empty
            if len(body) == size and (turns > 1 or joined in known_here) and not (size == 1 and items[at][0] == "+") and all(i[0] != "?" for i in items[at : at + size]):
                # a body must not begin or end inside an element
                opens = sum(not k.startswith(("/", "#", "(")) for k in body)
                if turns > 1 or opens:
                    one = items[at : at + size]
                    for t in range(1, turns):
                        one = [merge(x, y, True) for x, y in zip(one, items[at + t * size : at + (t + 1) * size])]
                    out.append(("+", one))
                    out_keys.append(joined)
                    at += turns * size
                    continue
            out.append(items[at])
            out_keys.append(keys[at])
            at += 1
        items, keys = out, out_keys
    return items


def bodies_of(items: list) -> set[tuple[int, str]]:
    return {(len(i[1]), key(i)) for i in items if i[0] == "+"} | {b for i in items if i[0] != "t" for b in bodies_of(i[1])}


def align(wrapper: list, page: list) -> list:
    """The wrapper generalised to match the page too, or what another wrapper matches."""
    # optional items can be matched by the other side's: compare with the options opened; -1: of no option
    opened = lambda items: [(j if i[0] == "?" else -1, x) for j, i in enumerate(items) for x in (i[1] if i[0] == "?" else [i])]
    left, right = opened(wrapper), opened(page)
    match = difflib.SequenceMatcher(None, [key(x) for _, x in left], [key(x) for _, x in right], autojunk=False)
    out: list = []
    for op, a, b, c, d in match.get_opcodes():
        if op == "equal":
            # neighbouring options are taken or left apart
            for (j, k), of in groupby(zip(left[a:b], right[c:d]), lambda o: (o[0][0], o[1][0])):
                both = [merge(x, y) for (_, x), (_, y) in of]
                out += both if j < 0 and k < 0 else [("?", both)]
        else:
            # what every page had stays together, and so does what one option held
            for side in (left[a:b], right[c:d]):
                out += [("?", [x for _, x in of]) for _, of in groupby(side, lambda o: o[0])]
    return out


def leaves(items: list) -> list:
    return [x for i in items for x in ([i] if i[0] == "t" else leaves(i[1]))]


def is_content(leaf) -> bool:
    return 2 * leaf[2][1] > leaf[2][2]


def fixed_texts(items: list) -> list[str]:
    return sorted({t for x in leaves(items) if x[1] == TEXT and x[2][3] >= SAME for t in x[2][0]})


def laid_out(wrapper: list, number: dict[str, int]) -> tuple[list, list]:
    """The wrapper's items with [symbol, group] for a leaf (group -1: no content), and its groups: [kind, template texts],
    kind "c" for content and "r" for a repeat that is content in part: there each page's own regions hold."""
    texts = [x for x in leaves(wrapper) if x[1] == TEXT and is_content(x)]
    copies = 2 * sum(len(t) for x in texts if x[2][3] >= SAME for t in x[2][0]) > sum(x[2][4] / x[2][3] for x in texts)
    groups: list = []

    def simple(i, group: int) -> list:
        return [number[i[1]], group] if i[0] == "t" else [i[0], [simple(x, group) for x in i[1]]]

    def walk(items: list) -> list:
        out, now = [], -1
        for i in items:
            kinds = {is_content(x) for x in leaves([i])}
            fixed = [] if copies or i[0] == "?" or kinds == {False} else fixed_texts([i])
            if i[0] == "?":
                now = -1
                out.append(["?", walk(i[1])])
            elif len(kinds) > 1 or fixed:
                now = -1
                groups.append(["r" if len(kinds) > 1 else "c", fixed])
                out.append(simple(i, len(groups) - 1))
            else:
                if kinds == {False}:
                    now = -1
                elif now < 0:
                    groups.append(["c", []])
                    now = len(groups) - 1
                out.append(simple(i, now))
        return out

    return walk(wrapper), groups


class Matcher:
    """A wrapper as positions, one a leaf, with the positions that may follow and precede each; sets are bits of integers."""

    def __init__(self, items: list):
        self.group: list[int] = []
        self.follow: list[int] = []
        self.precede: list[int] = []
        self.having: dict[int, int] = {}
        self.first, self.last, self.nullable = self.chain(items)
        self.before: dict[int, int] = {}

    def part(self, item: list) -> tuple[int, int, bool]:
        """(first positions, last positions, whether it may be empty) of an item."""
        if isinstance(item[0], int):
            at = 1 << len(self.group)
            self.group.append(item[1])
            self.follow.append(0)
            self.precede.append(0)
            self.having[item[0]] = self.having.get(item[0], 0) | at
            return at, at, False
        first, last, nullable = self.chain(item[1])
        if item[0] == "+":
            self.link(last, first)
        return first, last, nullable or item[0] == "?"

    def link(self, ends: int, starts: int) -> None:
        for p in bits(ends):
            self.follow[p] |= starts
        for q in bits(starts):
            self.precede[q] |= ends

    def chain(self, items: list) -> tuple[int, int, bool]:
        parts = [self.part(i) for i in items]
        ends = 0
        for first, last, nullable in parts:
            for q in bits(first):
                self.precede[q] |= ends
            ends = last | (ends if nullable else 0)
        starts = 0
        for first, last, nullable in reversed(parts):
            for p in bits(last):
                self.follow[p] |= starts
            starts = first | (starts if nullable else 0)
        return starts, ends, all(n for _, _, n in parts)

    def groups_of(self, symbols: list[int]) -> list[int] | None:
        """The group of each symbol where the wrapper matches all of them, else None. A repeat takes as many turns as it
        can, an option is taken where it can be."""
        if not symbols:
            return [] if self.nullable else None
        can = [0] * len(symbols)  # the positions from which the rest of the page can be produced
        now = self.last
        for k in range(len(symbols) - 1, -1, -1):
            now &= self.having.get(symbols[k], 0)
            if not now:
                return None
            can[k] = now
            earlier = self.before.get(now)
            if earlier is None:
                earlier = 0
                for q in bits(now):
                    earlier |= self.precede[q]
                if len(self.before) > 10_000:
                    self.before.clear()
                self.before[now] = earlier
            now = earlier
        out, may = [], self.first
        for here in can:
            may &= here
            if not may:
                return None
            again = may & ((2 << at) - 1) if out else 0
            at = again.bit_length() - 1 if again else (may & -may).bit_length() - 1
            out.append(self.group[at])
            may = self.follow[at]
        return out


def bits(mask: int) -> list[int]:
    out = []
    while mask:
        low = mask & -mask
        out.append(low.bit_length() - 1)
        mask ^= low
    return out


def aligned(parts: list[list]) -> list:
    """The items of pages or of partial wrappers as those of one wrapper; empty where none can be made."""
    wrapper: list = []
    for items in parts:
        if len(leaves(items)) > MAX_SYMBOLS:
            continue
        wider = align(wrapper, items) if wrapper else items
        if len(leaves(wider)) <= MAX_SYMBOLS:
            wrapper = wider
    return wrapper


def partial(pages: list[str]) -> list:
    """The wrapper of some of a host's pages, as items."""
    streams = [leaves_of(p) for p in pages]
    bodies = {b for stream in streams for b in bodies_of(fold(stream, set()))}
    return aligned([fold(stream, bodies) for stream in streams])


def together(parts: list[list]) -> list:
    """Partial wrappers as one, which matches what each of them does; what repeats in one may stand once in another."""
    if len(parts) == 1:
        return parts[0]
    bodies = {b for items in parts for b in bodies_of(items)}
    return aligned([fold(items, bodies) for items in parts])


def packed(items: list) -> str:
    """Items as JSON, sets as sorted lists."""
    simple = lambda i: [*i[:2], [sorted(i[2][0]), *i[2][1:]]] if i[0] == "t" else [i[0], [simple(x) for x in i[1]]]
    return json.dumps([simple(i) for i in items], ensure_ascii=False, separators=(",", ":"))


def unpacked(text: str) -> list:
    whole = lambda i: ("t", i[1], (frozenset(i[2][0]), *i[2][1:])) if i[0] == "t" else (i[0], [whole(x) for x in i[1]])
    return [whole(i) for i in json.loads(text)]


def finished(wrapper: list) -> str:
    """A host's wrapper as JSON: symbols, items and groups; empty where there is none."""
    if not wrapper:
        return ""
    names = sorted({x[1] for x in leaves(wrapper)})
    items, groups = laid_out(wrapper, {s: k for k, s in enumerate(names)})
    return json.dumps({"symbols": names, "items": items, "groups": groups}, ensure_ascii=False, separators=(",", ":"))


def infer(pages: list[str]) -> str:
    """The wrapper of a host's pages as JSON."""
    return finished(partial(pages))


@lru_cache(maxsize=256)
def compiled(wrapper: str) -> tuple[dict[str, int], Matcher, list] | None:
    if not wrapper:
        return None
    got = json.loads(wrapper)
    return {s: k for k, s in enumerate(got["symbols"])}, Matcher(got["items"]), got["groups"]


def matched(symbols: list[str], wrapper: str) -> list[int] | None:
    """The wrapper's group of each symbol, -1 outside content; None if the wrapper does not match."""
    w = compiled(wrapper)
    of = w[1].groups_of([w[0].get(s, -1) for s in symbols if s not in IMPLIED]) if w else None
    if of is None or len(of) == len(symbols):
        return of
    rest = iter(of)
    return [-1 if s in IMPLIED else next(rest) for s in symbols]


def content(got: list[tuple[str, str]], wrapper: str, varied: frozenset = frozenset()) -> tuple[list[bool], bool]:
    """Which tokens (without white space) are content; whether the wrapper matched. varied: the template texts that some
    page of the host has not, as numbered by absent."""
    symbols = [s for s, _ in got]
    of = matched(symbols, wrapper)
    if of is None:
        return regions(symbols, [len(t) for _, t in got]), False
    groups, keep, own = compiled(wrapper)[2], [False] * len(symbols), None
    drop = {g: {t for k, t in enumerate(fixed) if g << 16 | k not in varied} for g, (_, fixed) in enumerate(groups) if fixed}
    for j, g in enumerate(of):
        if g < 0:
            continue
        if groups[g][0] == "r" and own is None:
            own = regions(symbols, [len(t) for _, t in got])
        keep[j] = (groups[g][0] == "c" or own[j]) and not (g in drop and symbols[j] == TEXT and plain(got[j][1]) in drop[g])
    return keep, True


def absent(page: str, wrapper: str) -> list[int]:
    """The wrapper's template texts that this page has not where they should be: group and place in its list as a number."""
    got = [x for x in tokens(page) if x[0] != SPACE]
    of = matched([s for s, _ in got], wrapper) or []
    here: dict[int, set[str]] = {g: set() for g in of if g >= 0}
    for (s, t), g in zip(got, of):
        if s == TEXT and g >= 0:
            here[g].add(plain(t))
    groups = compiled(wrapper)[2] if here else ()
    return [g << 16 | k for g, texts in here.items() for k, t in enumerate(groups[g][1]) if t not in texts]


def extract_page(page: str | None, wrapper: str = "", varied: frozenset = frozenset()) -> tuple[str, bool]:
    """(main text, whether the wrapper matched)."""
    if not page:
        return "", False
    got = tokens(page)
    keep, match = content([x for x in got if x[0] != SPACE], wrapper, varied)
    blocks, now, flags = [], [], iter(keep)
    for s, text in got:
        if s == SPACE:
            now.append(text)
            continue
        k = next(flags)
        if s == TEXT:
            if k:
                now.append(text)
        elif s.lstrip("/").split(".", 1)[0] in BLOCK_TAGS and now:
            blocks.append(now)
            now = []
    blocks.append(now)
    texts = [plain("".join(b)) for b in blocks]
    return "\n".join(t for t in texts if t), match


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def beside(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """pages (with host) left-joined with the wrappers of their hosts."""
    size = wrappers.agg(F.coalesce(F.sum(F.octet_length("wrapper")), F.lit(0)).alias("n")).first().n
    if size <= BROADCAST_BYTES:
        return pages.join(F.broadcast(wrappers), "host", "left")
    dealt = pages.withColumn("salt", F.pmod(F.xxhash64("url", "html"), F.lit(SALTS)).cast("int"))
    return dealt.join(wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")


def fit(pages: DataFrame, per_part: int = PAGES) -> DataFrame:
    """(host, wrapper, varied): pages (url, html); varied: the template texts that some page of the host has not."""
    rows = pages.select("url", host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"), F.xxhash64("html").alias("h")).filter("html is not null and html <> ''")
    counts = saved(rows.select("host", "h").distinct().groupBy("host").agg(F.ceil(F.count("*") / per_part).alias("parts")), "counts")
    size = counts.agg(F.count("*").alias("hosts"), F.coalesce(F.max("parts"), F.lit(0)).alias("parts")).first()
    dealt = rows.join(F.broadcast(counts) if size.hosts <= 100_000 else counts, "host").select("host", F.pmod("h", "parts").alias("part"), "h", "html")

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "part": [pdf["part"].iloc[0]], "items": [packed(partial(list(pdf.sort_values("h")["html"])))]})

    def go_on(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "part": [pdf["part"].iloc[0] // FAN], "items": [packed(together([unpacked(x) for x in pdf.sort_values("part")["items"]]))]})

    schema = "host string, part long, items string"
    def new_pages(batches):
        seen = set()  # copies go no further than their task
        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in (0, 2)))
            yield batch.filter(pa.array([k not in seen and not seen.add(k) for k in keys], pa.bool_()))

    # texts are shuffled once: the parts' pages are told apart where they are
    once = small_batches(dealt).mapInArrow(tidy(new_pages), dealt.schema).repartition("host", "part").dropDuplicates(["host", "part", "h"])
    parts, left = saved(once.groupBy("host", "part").applyInPandas(begin, schema), "partial"), size.parts
    while left > 1:
        parts, left = saved(parts.groupBy("host", F.floor(F.col("part") / FAN)).applyInPandas(go_on, schema), "partial"), -(-left // FAN)

    def end(batch: pa.RecordBatch) -> dict:
        return {"host": batch.column(0), "wrapper": [finished(unpacked(x)) for x in batch.column(1).to_pylist()]}

    wrappers = saved(map_arrow(parts.select("host", "items"), end, "host string, wrapper string"), "wrappers")

    def compare(batch: pa.RecordBatch) -> dict:
        found = {(h, g) for h, page, w in zip(*(batch.column(k).to_pylist() for k in range(3))) if w for g in absent(page, w)}
        return {"host": [h for h, _ in found], "group": pa.array([g for _, g in found], pa.int32())}

    # hosts without template texts have nothing to compare
    some = wrappers.filter(F.col("wrapper").rlike(r'\["[cr]",\["'))
    differ = map_arrow(beside(rows, some).select("host", "html", "wrapper").filter("wrapper is not null"), compare, "host string, group int", rows=10_000)
    return saved(wrappers.join(differ.groupBy("host").agg(F.collect_set("group").alias("varied")), "host", "left"), "templates")


def extract(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(page_id, url, text, matched) of every page (page_id, url, html)."""
    rows = pages.select("page_id", "url", F.col("html").cast("string"), host(F.col("url")).alias("host"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batch: pa.RecordBatch) -> dict:
        got = [extract_page(h, w or "", frozenset(v or ())) for h, w, v in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": [g[0] for g in got], "matched": [g[1] for g in got]}

    return map_arrow(beside(rows, wrappers).select("page_id", "url", "html", "wrapper", "varied"), run, f"page_id {kind['page_id']}, url {kind['url']}, text string, matched boolean")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "matched")
