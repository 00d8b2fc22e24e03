"""Main text of web pages by site template removal.

Every element of a page is hashed twice: with all it holds, and by its structure alone (tags, names and links without
texts, runs of equal children once). Spark counts for each host on how many of its pages each hash stands and which share
of a page's text it holds. Subtrees that recur across many pages of their host are template and deleted: equal ones
anywhere, those of equal structure outside the main text. Recurring structures that hold much of the text of their pages
lead to the main text; where the main text's own structure varies from page to page, the element is taken that holds most
of the text outside links and template. Pages that copy one main text count once.

Elements that HTML itself marks as surroundings (menus, footers, asides, forms, scripts) are deleted by their tag. Names
such as ``sidebar`` or ``comments`` decide outside the main text; inside it only where the structure recurs. A host with
fewer than LEAST_PAGES different pages shows no template: there, ``article`` or ``main`` elements and whole names decide.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeline.llm.common import ascii_lower, batch, map_batches, read_table, settle

#: A subtree is template if it stands on so many pages of its host, and on this share of them; within the main text an
#: equal one must stand on the larger share, as pages of a series may share a passage.
LEAST_PAGES, SHARE, SHARE_WITHIN = 5, 0.1, 0.3

#: A recurring structure that holds so many thousandths of the text of its pages (mean) holds the main text.
CONTENT = 400
#: Elements nested deeper are read as siblings, as browsers do.
DEPTH = 512

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TAG_END = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
RAW = {"script", "style", "noscript", "iframe", "xmp", "noembed", "noframes", "textarea", "title", "template", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CONTAINERS = {"div", "section", "aside", "ul", "ol", "dl", "table", "nav", "header", "footer", "form", "details", "menu", "center", "fieldset", "figure"}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dt", "dd", "td", "th", "figcaption", "address", "summary", "caption"}
BLOCKS = CONTAINERS | PROSE | {"html", "body", "head", "article", "main", "tr", "tbody", "thead", "tfoot", "hr", "dialog", "hgroup", "legend", "option", "optgroup", "select", "dir", "search"}
SURROUNDINGS = {"head", "nav", "footer", "aside", "form", "button", "select", "input", "label", "dialog", "object", "embed", "canvas", "audio", "video", "menu", "search"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "tablist"}
NAMES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup "
    "modal overlay sidebar menu menus navbar nav navigation breadcrumb breadcrumbs footer masthead topbar comment comments disqus respond discussion share sharing social "
    "related recommended recommendations newsletter subscribe subscription signup login widget widgets pagination pager skip toolbar copyright disclaimer".split()
)
#: Start tags that close an open element of these names.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
STOPS = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "html"}


class Node:
    __slots__ = ("tag", "attrs", "items", "up", "depth")

    def __init__(self, tag: str, attrs: str = "", up: Node | None = None):
        self.tag, self.attrs, self.items, self.up, self.depth = tag, attrs, [], up, up.depth + 1 if up else 0

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(self.attrs)}

    def names(self) -> list[str]:
        """Its classes and id, lower case."""
        if not self.attrs:
            return []
        attrs = self.attributes()
        return f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()


def markup(source: str) -> Iterator[tuple[str, str, str]]:
    """Pieces ``(kind, value, attributes)`` of a page: text, start and end tags. Each character is looked at a bounded
    number of times: after the first tag with a quote that is never closed, quotes are no longer heeded."""
    place, end, heed = 0, len(source), True
    while place < end:
        at = source.find("<", place)
        if at < 0:
            yield "text", source[place:], ""
            return
        mark = source[at + 1 : at + 2]
        slash = mark == "/"
        name = NAME.match(source, at + 1 + slash) if slash or mark.isalpha() else None
        if not name and mark not in ("!", "?", "/"):  # a plain character
            nxt = source.find("<", at + 1)
            yield "text", source[place : nxt if nxt >= 0 else end], ""
            place = nxt if nxt >= 0 else end
            continue
        if at > place:
            yield "text", source[place:at], ""
        if not name:
            close = "-->" if source.startswith("<!--", at) else "]]>" if source.startswith("<![CDATA[", at) else ">"
            stop = source.find(close, at + 2)
            place = stop + len(close) if stop >= 0 else end
            continue
        stop = name.end()
        while heed:
            m = TAG_END.search(source, stop)
            if not m:
                heed, stop = False, -1
            elif m[0] == ">":
                stop = m.start()
                break
            else:
                stop = source.find(m[0], m.end()) + 1
                heed = stop > 0
        if not heed:
            stop = source.find(">", name.end())
        if stop < 0:  # no tag ends any more
            return
        place = stop + 1
        tag = name[0].lower()
        yield ("end" if slash else "start"), tag, source[name.end() : stop]
        if tag in RAW and not slash:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)", re.I).search(source, place)
            stop = source.find(">", close.end()) if close else -1
            place = stop + 1 if stop >= 0 else end


def parse(source: str) -> Node:
    """A tree of elements and texts; unclosed and stray tags are mended as far as the text's blocks need it."""
    root = at = Node("#root")
    opened: dict[str, int] = {}

    def leave(node: Node) -> Node:
        """Close all up to ``node``."""
        nonlocal at
        while True:
            opened[at.tag] -= 1
            done, at = at is node, at.up
            if done:
                return at

    def shut(tags: set[str]) -> None:
        """Close the nearest of these elements, if no container is in between."""
        if any(opened.get(t) for t in tags):
            node = at
            while node.up and node.tag not in tags and node.tag not in STOPS:
                node = node.up
            if node.up and node.tag in tags:
                leave(node)

    for kind, value, attrs in markup(source):
        if kind == "text":
            at.items.append(references.unescape(value) if "&" in value else value)
        elif kind == "end":
            if opened.get(value):
                node = at
                while node.tag != value:
                    node = node.up
                leave(node)
        elif value not in RAW:
            if value in BLOCKS and value != "option":  # a block ends an open paragraph
                shut({"p"})
            if value in CLOSES:
                shut(CLOSES[value])
            node = Node(value, attrs, at)
            at.items.append(node)
            if value not in VOID and not (attrs.endswith("/") and value not in BLOCKS) and node.depth < DEPTH:
                at = node
                opened[value] = opened.get(value, 0) + 1
    return root


def walk(node: Node) -> Iterator[Node]:
    """All elements below, parents first, without recursion: pages may be nested deeply."""
    todo = [node]
    while todo:
        node = todo.pop()
        own = [x for x in node.items if isinstance(x, Node)]
        yield from own
        todo += own


def split_name(name: str) -> list[str]:
    return re.split(r"[^a-z0-9]+", name)


def surrounding(node: Node, inside: bool) -> bool:
    """Whether HTML marks an element as something around the main text; ``inside``: within the main text."""
    if node.tag in SURROUNDINGS or node.tag == "header" and not inside:
        return True
    if not node.attrs or node.tag in ("article", "main", "body", "html"):
        return False
    attrs = node.attributes()
    return "hidden" in attrs or attrs.get("role", "").lower() in ROLES or attrs.get("aria-hidden") == "true"


def named(node: Node, whole: bool) -> bool:
    """Whether its classes or id are names of surroundings, ``whole`` or in one of their words."""
    if node.tag in ("main", "body", "html"):
        return False
    own = node.names()
    return any(n in NAMES for n in own) if whole or node.tag == "article" else any(not NAMES.isdisjoint(split_name(n)) for n in own)


def is_content(node: Node) -> bool:
    if node.tag == "article":
        return not named(node, True)
    return node.tag == "main" or "main" in node.attrs and node.attributes().get("role") == "main"


def content(root: Node) -> list[Node]:
    """The outermost articles, else the main element, else everything."""
    for test in (lambda n: n.tag == "article" and is_content(n), lambda n: n.tag != "article" and is_content(n)):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node is not root and test(node):
                found.append(node)
            elif node is root or not surrounding(node, False) and not (node.tag == "article" and named(node, True)):
                todo += reversed([x for x in node.items if isinstance(x, Node)])
        if found:
            return found
    return [root]


class Marks:
    """Of each element, by id(): the hash of all it holds, the hash of its structure, its characters of text, and those of
    them outside links."""

    def __init__(self, root: Node):
        self.exact: dict[int, int] = {}
        self.shape: dict[int, int] = {}
        self.chars: dict[int, int] = {}
        self.prose: dict[int, int] = {}
        inner: dict[int, list[str]] = {}
        self.order = list(walk(root))
        for node in reversed([root, *self.order]):
            parts, form, chars, prose = [node.tag], [], 0, 0
            for x in node.items:
                if isinstance(x, Node):
                    k = id(x)
                    parts.append(f"\x01{self.exact[k]:x}")
                    own = [f"\x01{self.shape[k]:x}"] if x.tag in BLOCKS or x.tag == "a" else inner[k]
                    chars += self.chars[k]
                    prose += self.prose[k]
                else:
                    words = " ".join(x.split())
                    parts.append(f"\x02{words}")
                    own = ["\x02"] if words else []
                    chars += len(words)
                    prose += len(words)
                form += [o for i, o in enumerate(own) if o != ((own[i - 1] if i else None) or (form[-1] if form else None))]
            k = id(node)
            self.exact[k] = xxhash.xxh64_intdigest("\x00".join(parts)) >> 1
            names = " ".join(sorted(re.sub("[0-9]+", "0", n) for n in node.names()))
            self.shape[k] = xxhash.xxh64_intdigest("\x00".join(["\x03", node.tag, names, *form])) >> 1
            self.chars[k], self.prose[k], inner[k] = chars, 0 if node.tag == "a" else prose, form


def counted(root: Node, marks: Marks) -> dict[int, int]:
    """The hashes of a page that are counted, with the thousandths of its text that they hold (0 for equal subtrees):
    containers and structures anywhere, equal prose too where a page marks no main text."""
    tags = CONTAINERS | PROSE if content(root) == [root] else CONTAINERS
    out: dict[int, int] = {}
    total = max(1, marks.chars[id(root)])
    for n in marks.order:
        k = id(n)
        if marks.chars[k] and n.tag in BLOCKS and n.tag not in ("html", "body", "head"):
            share = marks.chars[k] * 1000 // total
            out[marks.shape[k]] = min(1000, share + out.get(marks.shape[k], 0))
            if n.tag in tags:
                out.setdefault(marks.exact[k], 0)
    return out


def extract(source: str, template: set[int], main: set[int] = frozenset(), known: bool = False, firm: set[int] = frozenset()) -> str:
    """The blocks of the main text joined by newlines.

    ``template`` holds hashes that recur on the page's host, ``firm`` those that recur on many of its pages, ``main``
    structures that hold the main text there; ``known``: the host has pages enough to tell.
    """
    root = parse(source)
    marks = Marks(root) if known else None
    blocks: list[str] = []
    open_block: list[str] = []

    def flush() -> None:
        text = " ".join("".join(open_block).split())
        if text:
            blocks.append(text)
        open_block.clear()

    def deleted(x: Node, inside: bool) -> bool:
        if surrounding(x, inside):
            return True
        if not known:
            return named(x, inside)
        shape, equal = marks.shape[id(x)] in template, marks.exact[id(x)] in template
        if inside:
            return shape and named(x, False) or marks.exact[id(x)] in firm and x.tag in CONTAINERS
        if x.tag in ("article", "main", "body", "html"):
            return x.tag == "article" and named(x, True)
        return shape and x.tag in BLOCKS and x.tag not in PROSE or equal and x.tag in CONTAINERS | PROSE or named(x, False)

    def heart(node: Node) -> Node:
        """The deepest element that leads to the main text of the host."""
        while True:
            own = [x for x in node.items if isinstance(x, Node) and (x.tag in ("html", "body") or marks.shape[id(x)] in main and x.tag not in PROSE) and not surrounding(x, False)]
            if not own:
                return node
            node = max(own, key=lambda x: marks.chars[id(x)])

    def densest(node: Node) -> Node:
        """The deepest element that holds more than half of the prose of its parent, surroundings and template aside."""
        while True:
            own = [x for x in node.items if isinstance(x, Node) and not deleted(x, False)]
            best = max(own, key=lambda x: marks.prose[id(x)], default=None)
            if best is None or best.tag not in BLOCKS or best.tag in PROSE or 2 * marks.prose[id(best)] <= sum(marks.prose[id(x)] for x in own):
                return node
            node = best

    tops = content(root) if not known else [root]
    centre = None
    if known:
        centre = heart(root)
        if centre.tag in ("html", "body") or centre is root:
            centre = densest(root) if content(root) == [root] else None
            if centre is not None and (centre is root or centre.tag in ("html", "body")):
                centre = None
    for top in tops:
        # a page without statistics: inside the marked main text, or everywhere outside of it
        todo: list[tuple[Node | str | None, bool]] = [(top, top is not root)]
        while todo:
            x, inside = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                open_block.append(x)
            elif x is not top and deleted(x, inside):
                if x.tag in BLOCKS:
                    flush()
            elif x.tag == "br":
                open_block.append(" ")
            else:
                block = x.tag in BLOCKS or x is top
                if block:
                    flush()
                    todo.append((None, inside))
                beside = centre is not None and x.up is centre.up and x.tag not in PROSE and marks.shape[id(x)] in main
                within = inside or x is centre or beside or x is not root and is_content(x)
                todo += [(y, within) for y in reversed(x.items)]
        flush()
    return "\n".join(blocks)


SEEN = pa.schema([("host", pa.string()), ("body", pa.int64()), ("marks", pa.list_(pa.struct([("hash", pa.int64()), ("share", pa.int64())])))])


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """``(host, template array<long>, main array<long>, firm array<long>)`` of hosts with pages enough; the arrays are bounded, as each hash
    stands on at least ``share`` of the host's pages. Of pages with one main text one is counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body, found = [], []
            for source in b.column("html").to_pylist():
                root = parse(source or "")
                marks = Marks(root)
                body.append(xxhash.xxh64_intdigest(" ".join(f"{marks.exact[id(n)]:x}" for n in content(root))) >> 1)
                found.append([{"hash": h, "share": n} for h, n in sorted(counted(root, marks).items())])
            yield batch(SEEN, host=b.column("host"), body=body, marks=found)

    seen = map_batches(pages, run, "host string, body long, marks array<struct<hash:long,share:long>>")
    once = settle(seen.groupBy("host", "body").agg(F.min("marks").alias("marks")))
    total = once.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    counts = once.select("host", F.explode("marks").alias("m")).groupBy("host", "m.hash").agg(F.count("*").alias("n"), F.sum("m.share").alias("held"))
    often = counts.where(F.col("n") >= least_pages).join(total, "host").where(F.col("n") >= share * F.col("pages"))
    main = F.col("held") >= CONTENT * F.col("n")
    marked = often.groupBy("host").agg(F.collect_set(F.when(~main, F.col("hash"))).alias("template"), F.collect_set(F.when(main, F.col("hash"))).alias("main"), F.collect_set(F.when(~main & (F.col("n") >= SHARE_WITHIN * F.col("pages")), F.col("hash"))).alias("firm"))
    return total.select("host").join(marked, "host", "left")


TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
#: Hosts whose template is sent to every task; a larger table is joined, with each host dealt to so many tasks.
MOST_HOSTS, SALTS = 50_000, 16


def main_text(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``.

    A null or empty page gives an empty text; a null URL belongs to the host of the empty name; repeated rows each get
    their row and count as one page; an empty table gives an empty one; extra columns are not read. Every page is parsed
    twice, for the counts and for the text.
    """
    host = F.coalesce(ascii_lower(F.regexp_extract(F.col("url"), "://([^/?#]*)", 1)), F.lit(""))
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).withColumn("host", host)
    known = settle(templates(own.select("host", "html"), least_pages, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(n).to_pylist() for n in ("html", "template", "main", "known", "firm")))
            texts = [extract(s or "", set(t or ()), set(m or ()), bool(k), set(f or ())) for s, t, m, k, f in rows]
            yield batch(TEXT, page_id=b.column("page_id"), url=b.column("url"), text=texts, n_chars=list(map(len, texts)))

    told = known.withColumn("known", F.lit(True))
    if known.count() <= MOST_HOSTS:
        joined = own.join(F.broadcast(told), "host", "left")
    else:  # a host may hold a third of all pages
        told = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(told, ["host", "salt"], "left")
    return map_batches(joined.select("page_id", "url", "html", "template", "main", "known", "firm"), run, "page_id long, url string, text string, n_chars long")


def op9_html(spark, sf_dir: str) -> DataFrame:
    """``main_text`` on the whole table ``pages``; see there for odd rows."""
    return main_text(read_table(spark, sf_dir, "pages"))
