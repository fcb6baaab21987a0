"""HTML extraction by wrapper induction.

The pages of a host are trees that mostly came out of one template.  All distinct pages of
a host are parsed and aligned by simple tree matching, in parts whose wrappers are then
aligned with each other; nodes with the same text on all pages that have them are the
template, nodes whose text varies are slots.  The
slots of the region with most running text are its content.  Every page of the host
is then aligned with the induced wrapper and gives the text of its content slots.

What marks and words say about a part (menus, forms, adverts, comments, ...) holds on every
page; a host with a single page has nothing else, and then its own slots stand for the
wrapper's.  Class names are hints, weighed against the page's running text: a block with half of it isn't sent away by a name that
may be an article's (side, related, tags, ...) or that says how a page looks (has-sidebar, menu-open), nor by any
other name if it also holds the page's heading, or nearly all of the text where neither a heading nor an article is around.
"""

from __future__ import annotations

import html
import json
import re
import sys
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, save

DENSE = 64 * 64  # pairs of children up to which they are weighed by what matches below them
NEARLY = 0.9  # share of a page's running text that outweighs a strong name
LEAST = 3  # distinct pages that a node is known to stand on; more need not be told apart
DEPTH = 2000  # elements within each other; deeper ones are part of their parents
HELD = 200_000  # nodes of wrappers that a task holds before it hands them on
FAN = 32  # partial wrappers that are merged at a time, about
SMALL = 32 << 20  # characters of wrappers that are sent to every task, at most
PAGES = 10_000  # pages of a host for one task where the wrappers are more than that
KEYS = 200_000  # copied pages that are told to every task, at most
sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEPTH))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_RAW = frozenset("script style noscript template textarea title svg iframe canvas select".split())
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img object math mi mn mo mrow ms mspace mtext mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mtable mtr mtd semantics".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = frozenset("ul ol dl table tbody thead tr article section main div body nav aside footer header form blockquote".split())
_AWAY = frozenset("nav header footer aside form button menu dialog".split())
_AWAY_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advert(?:isement|ising)?|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav(?:bar|igation)?|newsletter|notices?|overlay|pagination|pager|popup|promos?|related|recommended|share|sharing|sidebar|side|skip|social|sponsor(?:ed)?|subscribe|tags|toolbar|widget)(?:$|[\s_-])", re.I)
#: of those, names that an article's own block may have
_WEAK_NAMES = re.compile(r"(?:^|[\s_-])(?:banner|header|modal|notices?|overlay|popup|promos?|related|recommended|share|sharing|side|social|sponsor(?:ed)?|tags|widget)(?:$|[\s_-])", re.I)
#: parts of names that say how a page or block looks at the time
_STATES = frozenset("has no with without is sticky fixed show hide layout open closed active enabled visible left right on off".split())
_AWAY_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")


class Node:
    """A block element; items holds its inline texts and child blocks in page order."""

    __slots__ = ("tag", "label", "away", "named", "items", "link", "keep")

    def __init__(self, tag: str, label: str, away: bool, named: str = ""):
        self.tag, self.label, self.away, self.named = tag, label, away, named
        self.items: list = []
        self.link = 0
        self.keep = False


def parse(page: str | None) -> Node:
    """The block tree of a page; unclosed and stray tags are borne."""
    root = Node("", "", False)
    stack = [root]
    deep: dict[str, int] = {}  # open elements that are too deep to be nodes
    links = 0
    at = 0
    page = page or ""
    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            text = html.unescape(text)
            stack[-1].items.append(text)
            if links:
                stack[-1].link += len(text.strip())
        if not m:
            _weigh(root)
            return root
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "a":
                links = max(0, links - 1)
            elif deep.get(tag):
                deep[tag] -= 1
            elif tag not in _INLINE and tag not in _VOID:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
            continue
        attrs = m[3] or m[6] or ""
        if tag in _RAW:
            if not attrs.rstrip().endswith("/"):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in _INLINE:
            if tag == "br":
                stack[-1].items.append(" ")
            elif tag == "a" and not attrs.rstrip().endswith("/"):
                links += 1
            continue
        links = 0
        while len(stack) > 1 and stack[-1].tag == "p":  # a block ends a paragraph
            stack.pop()
        if tag in _CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _CLOSES[tag]:
                    del stack[k:]
                    break
                if stack[k].tag in _STOPS and not (tag in ("td", "th") and stack[k].tag == "tr"):
                    break
        if tag in ("html", "body", "head") and tag != "body":
            continue
        found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)} if attrs else {}
        name = f"{found.get('class', '')} {found.get('id', '')}".strip()
        hard = tag in _AWAY or found.get("role", "").lower() in _AWAY_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        if tag == "header" and any(n.tag in ("article", "main") for n in stack):
            hard = False
        named = "" if hard else _hint(name)
        if tag not in _VOID and len(stack) >= DEPTH:
            deep[tag] = deep.get(tag, 0) + 1
            stack[-1].items.append(" ")
            continue
        node = Node(tag, f"{tag}.{name}" if name else tag, hard or bool(named), named)
        stack[-1].items.append(node)
        if tag not in _VOID:
            stack.append(node)


def _hint(name: str) -> str:
    """What the class names and id of a block say of it: strong or weak, that it is no article's; nothing else."""
    found = ""
    for token in name.split():
        if _AWAY_NAMES.search(token):
            parts = re.split("[-_]", token.lower())
            if parts[0] not in _STATES and parts[-1] not in _STATES and _AWAY_NAMES.search(_WEAK_NAMES.sub(" ", token)):
                return "strong"
            found = "weak"
    return found


def _weigh(root: Node) -> None:
    """Blocks that only a name sends away stay if the page's running text says otherwise; strong names are weighed first."""
    for kind in ("strong", "weak"):
        found: list[tuple[Node, int, int, bool]] = []

        def mass(n: Node, within: bool) -> tuple[int, int]:
            """Running text, and headings or main parts, at and below a node, which may be within an article."""
            own = max(0, sum(len(x.strip()) for x in n.items if isinstance(x, str)) - 2 * n.link)
            heads = int(n.tag in ("h1", "main"))
            for x in n.items:
                if isinstance(x, Node):
                    a, b = mass(x, within or n.tag in ("article", "main"))
                    own, heads = own + a, heads + b
            if n.named == kind:  # noqa: B023
                found.append((n, own, heads, within))  # noqa: B023
            return (0, 0) if n.away and n.named in ("", "gone") else (own, heads)

        total, heads = mass(root, False)
        for n, held, own, within in found:
            most = total and 2 * held > total
            if most and (kind == "weak" or own or not heads and not within and held >= NEARLY * total):
                n.away = False
            n.named = "gone" if n.away else ""


class Run:
    """Consecutive siblings of one label, taken as one node: their texts and child runs."""

    __slots__ = ("label", "tag", "away", "nodes", "texts", "size", "link", "kids", "keys", "same")

    def __init__(self, nodes: list[Node], key: int = 0):
        self.nodes = nodes
        self.label, self.tag, self.away = nodes[0].label, nodes[0].tag, nodes[0].away
        self.texts = tuple(t for n in nodes if (t := _SPACE.sub(" ", "".join(x if isinstance(x, str) else " " for x in n.items)).strip()))
        self.size, self.link = sum(map(len, self.texts)), sum(n.link for n in nodes)
        self.kids: list[Run] = []
        self.keys, self.same = (key,), True
        held: list[Node] = []
        for n in nodes:
            for x in n.items:
                if isinstance(x, Node):
                    if held and held[-1].label != x.label:
                        self.kids.append(Run(held, key))
                        held = []
                    held.append(x)
        if held:
            self.kids.append(Run(held, key))


def _chain(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence of two lists of labels, as pairs; a row is a number with a bit for each of b."""
    at: dict[str, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    every = (1 << len(b)) - 1
    v, rows = every, []
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & every
        rows.append(v)
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            j -= 1
            pairs.append((i, j))
    return pairs[::-1]


def align(a: list, b: list, label=lambda r: r.label, kids=lambda r: r.kids, known: dict | None = None) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two lists of children: the order-preserving pairs of one
    label with the most matched nodes below them, and how many nodes that are.  Of lists with
    over ``DENSE`` pairs the most children are paired, whatever is below them."""
    if not a or not b:
        return 0, []
    known = {} if known is None else known
    la, lb = [label(x) for x in a], [y.label if isinstance(y, Run) else label(y) for y in b]

    def here(i: int, j: int) -> int:
        """Matched nodes of two children of one label."""
        x, y = a[i], b[j]
        at = id(x), id(y)
        if at not in known:
            known[at] = 1 + align(kids(x), y.kids if isinstance(y, Run) else kids(y), label, kids, known)[0]
        return known[at]

    if la == lb and len(set(la)) == len(la):  # there is only one way
        pairs = [(i, i) for i in range(len(la))]
        return sum(here(i, j) for i, j in pairs), pairs
    if len(a) * len(b) > DENSE:
        pairs = _chain(la, lb)
        return sum(here(i, j) for i, j in pairs), pairs
    w = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, lx in enumerate(la, 1):
        up, row = w[i - 1], w[i]
        for j, ly in enumerate(lb, 1):
            best = up[j] if up[j] >= row[j - 1] else row[j - 1]
            if lx == ly:
                best = max(best, up[j - 1] + here(i - 1, j - 1))
            row[j] = best
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if w[i][j] == w[i - 1][j]:
            i -= 1
        elif w[i][j] == w[i][j - 1]:
            j -= 1
        else:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
    return w[-1][-1], pairs[::-1]


def _merge(a: Run, b: Run) -> None:
    """Take another page's or part's node into a wrapper's node."""
    a.same = a.same and b.same and a.texts == b.texts
    a.away = a.away and b.away
    a.keys = tuple(sorted({*a.keys, *b.keys})[:LEAST])
    a.size, a.link = a.size + b.size, a.link + b.link
    _, pairs = align(a.kids, b.kids)
    mate = {j: i for i, j in pairs}
    kids, done = [], 0
    for j, y in enumerate(b.kids):
        if j in mate:
            i = mate[j]
            kids += a.kids[done : i + 1]
            done = i + 1
            _merge(a.kids[i], y)
        else:
            kids.append(y)
    a.kids = kids + a.kids[done:]


def _mass(r: Run, away: bool) -> dict[int, float]:
    """Characters of running text in the varying slots at and below each node."""
    out: dict[int, float] = {}

    def walk(r, away):
        away = away or r.away
        fixed = r.same and len(r.keys) > 1
        own = 0 if away or fixed else max(0, r.size - 2 * r.link)
        out[id(r)] = own + sum(walk(k, away) for k in r.kids)
        return out[id(r)]

    walk(r, away)
    return out


def _main(root: Run) -> Run:
    """The node that holds the article: article or main if one has half of all running text,
    else the deepest node that holds four fifths of it in more than one child."""
    mass = _mass(root, False)
    total = mass[id(root)]
    best = None

    def walk(r):
        nonlocal best
        if r.tag in ("article", "main") and mass[id(r)] >= 0.5 * total and total:
            best = r
        for k in r.kids:
            if not r.away:
                walk(k)

    walk(root)
    if best is not None:
        return best
    at = root
    while True:
        down = [k for k in at.kids if k.kids and mass[id(k)] >= 0.8 * mass[id(at)] and mass[id(at)]]
        if not down:
            return at
        at = down[0]


def _digest(x) -> int:
    return int.from_bytes(blake2b(repr(x).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


def _light(r: Run) -> None:
    """Leave a digest of a node's texts, and nothing of its page."""
    r.nodes = None
    r.texts = _digest(r.texts) if r.texts else 0
    for k in r.kids:
        _light(k)


def _join(runs) -> Run | None:
    root = None
    for r in runs:
        if root is None:
            root = r
        else:
            _merge(root, r)
    return root


def _grown(page: str | None, key: int) -> Run:
    r = Run([parse(page)], key)
    _light(r)
    return r


def _pack(r: Run) -> list:
    return [r.label, r.tag, int(r.away), r.texts, int(r.same), r.size, r.link, r.keys, [_pack(k) for k in r.kids]]


def _unpack(x: list) -> Run:
    r = Run.__new__(Run)
    r.nodes = None
    r.label, r.tag, r.away, r.texts, r.same, r.size, r.link = x[0], x[1], bool(x[2]), x[3], bool(x[4]), x[5], x[6]
    r.keys, r.kids = tuple(x[7]), [_unpack(k) for k in x[8]]
    return r


def _wrapper(root: Run | None) -> str:
    """A wrapper as JSON: [label, fixed, content, children] of each node.

    A node of one page only is as its parent says, so it is left out unless the content is in it."""
    if root is None:
        return "null"
    main = _main(root)

    def out(r, content):
        content = content or r is main
        least = LEAST if content else 2  # copied passages of a few near copies aren't a template
        kids = [x for k in r.kids if (x := out(k, content))]
        if len(r.keys) < 2 and not kids and r is not main and r is not root:
            return None
        return [r.label, int(bool(r.texts) and r.same and len(r.keys) >= least), int(content), kids]

    return json.dumps(out(root, False))


def induce(pages: list[str | None]) -> str:
    """The wrapper of a host's pages; copies of a page say nothing about the template."""
    return _wrapper(_join(_grown(p, _digest(p)) for p in dict.fromkeys(pages)))


def extract(page: str | None, wrapper: list | None) -> str:
    """The texts of a page's content slots, block by block in page order."""
    root = parse(page)
    run = Run([root])
    hit = 0

    def mark(r: Run, w: list | None, content: bool, fixed: bool):
        """Of nodes that the wrapper lacks, those inside its content are content."""
        nonlocal hit
        for n in r.nodes:
            n.keep = content and not fixed
        hit += content and not fixed and r.size > 0
        pairs = dict((j, i) for i, j in align(w[3], r.kids, lambda x: x[0], lambda x: x[3])[1]) if w else {}
        for j, k in enumerate(r.kids):
            x = w[3][pairs[j]] if j in pairs else None
            mark(k, x, bool(x[2]) if x else content, bool(x[1]) if x else False)

    if wrapper:
        mark(run, wrapper, bool(wrapper[2]), bool(wrapper[1]))
    if not hit:  # not of this template: its own slots stand for it
        main = _main(run)

        def own(r, content):
            content = content or r is main
            for n in r.nodes:
                n.keep = content
            for k in r.kids:
                own(k, content)

        own(run, False)
    blocks: list[str] = []

    def walk(n: Node, away: bool):
        away = away or n.away
        held: list[str] = []

        def flush():
            text = _SPACE.sub(" ", "".join(held)).strip()
            if text and n.keep and not away:
                blocks.append(text)
            held.clear()

        for x in n.items:
            if isinstance(x, Node):
                flush()
                walk(x, away)
            else:
                held.append(x)
        flush()

    walk(root, False)
    return "\n\n".join(blocks)


_PART = [pa.string(), pa.int64(), pa.string()]


def _part(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_PART)], names=["host", "key", "part"])


def _nodes(r: Run) -> int:
    return 1 + sum(map(_nodes, r.kids))


def _partial(copied):
    """host, key, part: wrappers of the distinct pages of each host in a task; key is their least page's.

    copied: page -> the row that stands for its copies; without it rows say so themselves."""

    def run(it):
        roots: dict[str, Run] = {}
        seen: set[int] = set()
        held = 0
        for batch in it:
            pages = batch.column("html")
            for i, (host, key, h, first) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("host", "key", "h", "first")), strict=True)):
                first = first if copied is None else copied.value.get(key, h)
                if first != h or key in seen or not pages[i].is_valid:
                    continue
                seen.add(key)
                r = _grown(pages[i].as_py(), key)
                if host not in roots:
                    roots[host] = r
                    held += _nodes(r)
                else:
                    _merge(roots[host], r)
                    held += 1 + len(r.kids)
                if held > HELD:
                    for at, root in roots.items():
                        yield _part([(at, root.keys[0], json.dumps(_pack(root)))])
                    roots, held = {}, 0
        for at, root in roots.items():
            yield _part([(at, root.keys[0], json.dumps(_pack(root)))])

    return run


def _merged(last: bool):
    """The wrapper of the parts of a host, or of a bucket of them; rows are sorted by host, bucket and key."""

    def out(at, parts):
        root = _join(_unpack(json.loads(x)) for x in parts)
        return _part([(at[0], root.keys[0], _wrapper(root) if last else json.dumps(_pack(root)))])

    def run(it):
        at, parts = None, []
        for batch in it:
            for host, bucket, part in zip(*(batch.column(n).to_pylist() for n in ("host", "bucket", "part")), strict=True):
                if (host, bucket) != at:
                    if parts:
                        yield out(at, parts)
                    at, parts = (host, bucket), []
                parts.append(part)
        if parts:
            yield out(at, parts)

    return run


def _extracted(wrappers):
    """The text of each page.  wrappers: host -> wrapper; without it a host's wrapper comes as a row before its pages."""

    def run(it):
        held: dict[str, list | None] = {}
        for batch in it:
            ids, urls, out = [], [], []
            columns = [batch.column(n).to_pylist() for n in ("page_id", "url", "host", "part")]
            pages = batch.column("html")
            for i, (page_id, url, host, part) in enumerate(zip(*columns, strict=True)):
                if part is not None:
                    held = {host: json.loads(part)}
                    continue
                if host not in held:
                    if len(held) > 500:
                        held.clear()
                    found = wrappers.value.get(host) if wrappers is not None else None
                    held[host] = json.loads(found) if found else None
                ids.append(page_id)
                urls.append(url)
                out.append(extract(pages[i].as_py(), held[host]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return run


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null or empty html gives an empty text; a null url is a host of its own; repeated rows
    are extracted each; other columns are ignored; an empty table gives no rows.
    Each task makes a wrapper of the distinct pages of a host that it reads; these are merged in a tree of
    about ``FAN`` at a time, so no task gets all of a host.  Copies over all tasks count once: the rows that stand for
    copied pages go to every task, or, if those are over ``KEYS``, are joined to the pages by their hash.  The hosts'
    wrappers go to every task too while they have ``SMALL`` characters; beyond that pages are dealt to
    the wrappers, a host in parts of about ``PAGES``.  Otherwise pages are not shuffled.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit("")))
    rows = rows.withColumns({"key": F.xxhash64("host", "html"), "h": F.xxhash64("page_id", "url")})
    copied = save(rows.where("html IS NOT NULL").groupBy("key").agg(F.min("h").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "copied")
    if copied.count() <= KEYS:
        told = spark.sparkContext.broadcast({r["key"]: r["first"] for r in copied.toLocalIterator()})
        marked = rows.withColumn("first", F.col("h"))
    else:
        told, marked = None, rows.join(copied, "key", "left").withColumn("first", F.coalesce("first", "h"))
    parts = save(marked.select("host", "key", "h", "first", "html").mapInArrow(_partial(told), "host string, key long, part string"), "parts")
    while True:
        most = parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        last = most <= FAN
        buckets = 1 if last else -(-most // FAN)
        dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("key", "part"), F.lit(buckets))).repartition("host", "bucket").sortWithinPartitions("host", "bucket", "key", "part")
        merged = save(dealt.mapInArrow(_merged(last), "host string, key long, part string"), "parts")
        discard(parts)
        parts = merged
        if last:
            break
    discard(copied)
    if (parts.agg(F.sum(F.length("part") + 100)).first()[0] or 0) <= SMALL:
        wrappers = spark.sparkContext.broadcast({r["host"]: r["part"] for r in parts.toLocalIterator()})
        out = rows.select("page_id", "url", "html", "host", F.lit(None).cast("string").alias("part")).mapInArrow(_extracted(wrappers), "page_id long, url string, text string")
        discard(parts)
    else:
        large = rows.groupBy("host").count().where(F.col("count") > PAGES).select("host", F.ceil(F.col("count") / PAGES).alias("k"))  # fewer than pages / PAGES
        salted = parts.join(F.broadcast(large), "host", "left").select("host", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("k", F.lit(1)) - 1)).alias("salt"))
        own = rows.join(F.broadcast(large), "host", "left").withColumn("salt", F.pmod("h", F.coalesce("k", F.lit(1))))
        none = [F.lit(None).cast(t).alias(n) for n, t in (("page_id", "long"), ("url", "string"), ("html", "string"))]
        both = own.select("page_id", "url", "html", "host", "salt", F.lit(None).cast("string").alias("part")).unionByName(salted.select(*none, "host", "salt", "part"))
        both = both.repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("part").isNull())
        out = both.mapInArrow(_extracted(None), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
