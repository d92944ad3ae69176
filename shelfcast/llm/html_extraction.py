"""Main text of web pages by removal of site templates.

Every block element's subtree is hashed, and Spark counts the pages of each host that hold a hash. There are
three kinds:

- the exact subtree (tag, class, id, texts, child hashes), inside of the main content (the outermost article or main
  element) and on pages without one: a whole container in half of the host's different articles, or of
  its different pages without main content, is the site's; copies of a page count once;
- the subtree with digits and marks of state left out of its texts and names, beside the main content: on at
  least ``MIN_PAGES`` pages and a ``SHARE`` of the host's it is the site's;
- the shape (tags and names alone, runs of like children as one), beside the main content, and of lists of links
  on any page: on ``MIN_PAGES`` and half of the host's pages it is the site's menu, footer or advert whatever it says today.

Subtrees of the site's template go first. Names come second, for what the counts leave open (hosts with few
pages, parts that do not recur): block elements that HTML, their role or a whole class or id name (only words for such parts,
besides words like list or box) as menus, headers, footers, sidebars, notices, adverts, forms or comments, unless they hold the
main content or its heading. Inside of the main content a name alone decides nothing: such a container goes if the same name
recurs there on half of the host's pages, or if its structure agrees (mostly linked text, a form, or a list of comments or of other articles).

The text is that of the articles left, unless more unlinked text is left beside them: then it is that of the main element
with the articles in it, or, if most is outside of that too, what is left of the body without the articles.

Host template sets are small (at most the elements of a page divided by the share), yet joined, not
assumed to fit: they are broadcast only up to ``BROADCAST_ROWS`` hashes.

Defined cases: null html is empty and has the empty text; a null url belongs to the host ''; equal
rows are pages of their own; text after an unclosed tag belongs to it; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.tables import mapped, stage, table

MIN_PAGES, SHARE, SHARE_INSIDE = 8, 0.05, 0.5
BROADCAST_ROWS = 500_000
#: Flags of the templates, and the sets of hashes that they make.
SETS = {"loose": "hashes", "strict": "inside", "body": "bodies", "shape": "shapes"}

# Names of HTML elements, and of the parts of pages that are not main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("br caption body dd dt html li option tbody td tfoot th thead tr".split())
CLOSED_BY_ITSELF = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = frozenset("ul ol dl table select article main section div body html nav aside footer header form".split())
DROPPED_TAGS = frozenset("nav footer aside form button select input menu dialog svg head canvas object audio video fieldset".split()) | RAW
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay newsletter "
    "subscribe subscription signup login sidebar widget widgets related recommended recommendations share sharing social comment comments reply replies disqus respond nav navbar navigation "
    "menu menus breadcrumb breadcrumbs header footer masthead toolbar pagination pager search alert disclaimer toc skip".split()
)
#: Words that may stand beside these in a name.
BESIDE_WORDS = frozenset("site page global main primary secondary top bottom left right list lists item items box boxes bar bars block area wrap wrapper container inner outer panel row link links button buttons icon icons group slot unit form thread posts articles".split())
OTHERS = frozenset("comment comments reply replies disqus respond related recommended recommendations".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
KEPT_TAGS = frozenset("html body article main".split())
#: What may be a site's part inside of the main content: whole containers, never their lines or cells.
CONTAINERS = frozenset("div section center details dl figure ol table ul".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_DIGITS = re.compile(r"\d+")
#: Names of a state.
STATES = frozenset("active current selected open closed first last odd even hover visited on off".split())
#: Where a raw element ends: the name alone, so that a longer name or an unclosed tag is told apart without looking further.
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


@dataclass(eq=False)
class Element:
    tag: str
    attributes: dict[str, str]
    main: Element | None  # the outermost element of main content around it, or itself
    parts: list = field(default_factory=list)  # texts and elements
    hash: int = 0
    loose: int = 0  # without digits and states, beside main content only
    shape: int = 0  # without texts
    aside: bool = False  # whether it or an element around it holds readers' comments or other articles by name
    holds_main: bool = False
    heading: bool = False  # whether a first-level heading is in it
    form: bool = False  # whether a form is in it
    chars: int = 0
    linked: int = 0  # characters inside of links
    links: int = 0


def _close(element: Element) -> None:
    """Hashes and sums once all parts are known."""
    own, outside = f"{element.tag}\0{element.attributes.get('class', '')}\0{element.attributes.get('id', '')}", element.main is None
    exact = xxhash.xxh3_64(own.encode("utf-8", "replace"))
    if outside:
        names = " ".join(w for w in _DIGITS.sub("", own).split() if w not in STATES).encode("utf-8", "replace")
        loose, shape = xxhash.xxh3_64(names), xxhash.xxh3_64(b"shape" + names)
    before = b""
    element.heading = element.tag == "h1"
    for part in element.parts:
        if isinstance(part, str):
            if text := " ".join(part.split()):
                exact.update(f"\1{text}".encode("utf-8", "replace"))
                element.chars += len(text)
                if outside:
                    loose.update(f"\1{_DIGITS.sub('', text)}".encode("utf-8", "replace"))
                now = b"\1"
            else:
                continue
        elif part.tag in RAW:
            continue
        else:
            exact.update(b"\2" + part.hash.to_bytes(8, "little"))
            if outside:
                loose.update(b"\2" + part.loose.to_bytes(8, "little"))
            element.chars, element.linked, element.links = element.chars + part.chars, element.linked + part.linked, element.links + part.links
            element.holds_main |= part.holds_main or part.main is part
            element.heading |= part.heading
            element.form |= part.form or part.tag == "form"
            now = b"\1" if part.tag not in BLOCK and part.tag != "a" else part.shape.to_bytes(8, "little")
        if outside and now != before:
            shape.update(now)
        before = now
    if element.tag == "a":
        element.linked, element.links = element.chars, 1
    element.hash = exact.intdigest()
    if outside:
        element.loose, element.shape = loose.intdigest(), shape.intdigest()


def _link_list(element: Element) -> bool:
    return element.links >= 3 and element.linked >= 0.8 * element.chars


def parse(source: str) -> tuple[Element, list[Element]]:
    """The root and all elements. Tags left open end with their parent; end tags of nothing only end a block."""
    root = Element("", {}, None)
    stack, found, at = [root], [], 0
    places: dict[str, list[int]] = {}  # of the open elements of each tag in the stack

    def pop(until: int) -> None:
        while len(stack) > until:
            element = stack.pop()
            if stack:
                places[element.tag].pop()
            _close(element)

    def innermost(tags: Iterable[str]) -> int:
        return max((places[tag][-1] for tag in tags if places.get(tag)), default=0)

    def within(tags: tuple[str, ...], stop: frozenset[str]) -> int | None:
        """Place in the stack of the innermost of these tags that nothing of ``stop`` encloses."""
        place = innermost(tags)
        return place if place and place > innermost(stop) else None

    while token := _TOKEN.search(source, at):
        if token.start() > at:
            stack[-1].parts.append(entities.unescape(source[at : token.start()]))
        at = token.end()
        if not token[2]:
            continue
        tag = token[2].lower()
        if token[1]:
            if (place := within((tag,), frozenset() if tag in HOLDS else HOLDS - {tag})) is not None:
                pop(place)
            elif tag in BLOCK:
                stack[-1].parts.append(" ")
            continue
        attributes = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(token[3])} if token[3] else {}
        if tag in CLOSES_P and (place := within(("p",), HOLDS)) is not None:
            pop(place)
        if tag in CLOSED_BY_ITSELF and (place := within(CLOSED_BY_ITSELF[tag], HOLDS)) is not None:
            pop(place)
        element = Element(tag, attributes, stack[-1].main)
        element.aside = stack[-1].aside or tag not in ("html", "body") and _of_others(element)
        if element.main is None and not element.aside and (tag in ("article", "main") or attributes.get("role", "") == "main"):
            element.main = element
        stack[-1].parts.append(element)
        found.append(element)
        if tag in RAW:
            end = _RAW_ENDS[tag].search(source, at)
            element.parts.append(source[at : end.start() if end else len(source)])
            at = source.find(">", end.end()) + 1 if end else 0
            at = at or len(source)
            _close(element)
        elif tag in VOID:
            _close(element)
        else:
            places.setdefault(tag, []).append(len(stack))
            stack.append(element)
    if at < len(source):
        stack[-1].parts.append(entities.unescape(source[at:]))
    pop(0)
    return root, found


@lru_cache(1 << 14)
def _apart_words(name: str) -> frozenset[str]:
    """The listed words of a class or id name if it has no words but such and those that stand beside them."""
    words = {w.lower() for w in _NAME_PARTS.findall(name)}
    return frozenset(words & DROPPED_WORDS if words <= DROPPED_WORDS | BESIDE_WORDS else ())


def _words(element: Element) -> frozenset[str]:
    if not element.attributes or element.tag not in BLOCK:
        return frozenset()
    names = f"{element.attributes.get('class', '')} {element.attributes.get('id', '')}".split()
    return frozenset().union(*map(_apart_words, names)) if names else frozenset()


def _of_others(element: Element) -> bool:
    """Whether it is named as readers' comments or as other articles."""
    return bool(element.attributes) and not OTHERS.isdisjoint(_words(element))


def _name_hash(element: Element) -> int:
    return xxhash.xxh3_64_intdigest(f"name\0{element.tag}\0{element.attributes.get('class', '')}\0{element.attributes.get('id', '')}".encode("utf-8", "replace"))


def _named_inside(element: Element) -> bool:
    """Whether it is a container of the main content with such a name, which counts or structure have to confirm."""
    return element.tag in CONTAINERS and not (element.heading or element.main is element) and bool(_words(element))


def _named_apart(element: Element) -> bool:
    """Whether tag, class, id or role say that it is no main text."""
    if element.tag in RAW:
        return True
    attributes = element.attributes
    if not attributes and element.tag not in DROPPED_TAGS and element.tag != "header":
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    if element.main is element or element.holds_main or element.tag in ("html", "body"):
        return False
    if element.tag in DROPPED_TAGS:
        return True
    if element.tag == "header":
        return not (element.main is not None and any(not isinstance(p, str) and p.tag in ("h1", "h2") for p in element.parts))
    if element.heading and element.main is not None:
        return False
    if attributes.get("role", "").lower() in DROPPED_ROLES:
        return True
    if element.main is not None:
        return _named_inside(element) and (element.form or 2 * element.linked > element.chars or _of_others(element))
    return bool(_words(element))


def _mains(element: Element, tags: tuple[str, ...], gone: set[int]) -> list[Element]:
    """The outermost elements of these tags that are not in a dropped one."""
    found = []
    todo = [p for p in reversed(element.parts) if not isinstance(p, str)]
    while todo:
        one = todo.pop()
        if id(one) in gone or _named_apart(one):
            continue
        if one.tag in tags or "main" in tags and one.attributes.get("role") == "main":
            found.append(one)
        else:
            todo += [p for p in reversed(one.parts) if not isinstance(p, str)]
    return found


def _text(elements: list[Element], gone: set[int], kept: list[Element] = ()) -> str:  # type: ignore[assignment]
    out: list[str] = []
    todo: list = list(reversed(elements))
    while todo:
        one = todo.pop()
        if isinstance(one, str):
            out.append(one)
        elif id(one) not in gone and not (one.tag not in KEPT_TAGS and one not in kept and _named_apart(one)) and not (one.tag == "article" and one not in elements and _named_apart(one)):
            edge = [" "] if one.tag in BLOCK else []
            todo += [*edge, *reversed(one.parts), *edge]
    return " ".join("".join(out).split())


def template_parts(elements: list[Element], hashes: set[int], inside: set[int], bodies: set[int], shapes: set[int]) -> set[int]:
    """Elements of the host's template: in the main content, and on pages without one, only whole containers and lists of links."""
    plain = all(e.main is None for e in elements)

    def counted(e: Element) -> bool:
        if e.main is not None:
            return e.tag in CONTAINERS and (e.hash in inside or bool(shapes) and _named_inside(e) and _name_hash(e) in shapes)
        if e.holds_main:
            return False
        if plain:
            return e.hash in bodies and e.tag in CONTAINERS or e.shape in shapes and _link_list(e)
        return e.loose in hashes or e.shape in shapes

    return {id(e) for e in elements if e.tag in BLOCK and e.tag not in KEPT_TAGS and counted(e)}


def _unlinked(elements: list[Element], gone: set[int], without: list[Element]) -> int:
    """Characters outside of links in what is left of ``elements`` without those of ``without``."""
    total, todo, skipped = 0, list(elements), {id(e) for e in without}
    while todo:
        one = todo.pop()
        if isinstance(one, str):
            total += len(" ".join(one.split()))
        elif id(one) not in gone and id(one) not in skipped and one.tag != "a" and (one.tag in KEPT_TAGS or not _named_apart(one)):
            todo += one.parts
    return total


def _within(element: Element, others: list[Element]) -> bool:
    todo = [p for o in others for p in o.parts]
    while todo:
        one = todo.pop()
        if one is element:
            return True
        if not isinstance(one, str):
            todo += one.parts
    return False


def main_text(source: str, hashes: set[int] = frozenset(), inside: set[int] = frozenset(), bodies: set[int] = frozenset(), shapes: set[int] = frozenset()) -> str:
    root, elements = parse(source)
    gone = template_parts(elements, hashes, inside, bodies, shapes)
    articles, mains = _mains(root, ("article",), gone), _mains(root, ("main",), gone)
    lone = [m for m in mains if m.tag != "article"]
    own = sum(a.chars - a.linked for a in articles)
    in_main = _unlinked(lone, gone, articles)
    chosen = articles
    if lone and in_main > own:
        order = {id(e): i for i, e in enumerate(elements)}
        chosen, own = sorted([*lone, *(a for a in articles if not _within(a, lone))], key=lambda e: order[id(e)]), own + in_main
    beside = _unlinked([root], gone, [*articles, *lone])
    if (articles or lone) and beside > own and (text := _text([root], gone | {id(a) for a in (*articles, *lone)})):
        return text
    for found in (chosen, lone):
        if found and (text := _text(found, gone)):
            return text
    if any(e.main is not None for e in elements):  # main content without text: what is beside it may be more than the template
        gone = {id(e) for e in elements if e.main is None and not e.holds_main and e.tag in CONTAINERS and e.hash in bodies}
    if text := _text([root], gone):
        return text
    # a form around the whole page is no form apart
    around = [e for e in elements if e.tag == "form" and id(e) not in gone and 2 * e.chars > root.chars]
    return _text(around[:1], gone, around[:1])


def removed(source: str, hashes: set[int] = frozenset(), inside: set[int] = frozenset(), bodies: set[int] = frozenset(), shapes: set[int] = frozenset()) -> tuple[int, int]:
    """Characters of the page that the counts remove, and those that names or the bounds of the main content remove then."""
    root, elements = parse(source)
    gone = template_parts(elements, hashes, inside, bodies, shapes)
    counted, todo = 0, list(root.parts)
    while todo:
        part = todo.pop()
        if isinstance(part, str) or part.tag in RAW:
            continue
        if id(part) in gone:
            counted += part.chars
        else:
            todo += part.parts
    kept = len("".join(main_text(source, hashes, inside, bodies, shapes).split()))
    whole = len("".join(_whole(root).split()))
    return counted, max(0, whole - counted - kept)


def _whole(root: Element) -> str:
    out, todo = [], [root]
    while todo:
        one = todo.pop()
        if isinstance(one, str):
            out.append(one)
        elif one.tag not in RAW:
            todo += reversed(one.parts)
    return " ".join(out)


def subtrees(pages: DataFrame) -> DataFrame:
    """(host, hash, main, body, plain, shape) for each page's distinct subtrees and the page itself.

    ``main`` is the hash of the main content around the subtree, or 0; outside of it ``body`` is that of the page; ``plain``: the
    page has no main content; ``shape``: the hash is one of shapes.
    """

    def of_page(source: str) -> set[tuple]:
        root, elements = parse(source)
        plain = all(e.main is None for e in elements)
        own = {(root.hash, 0, root.hash, plain, False)}
        for e in elements:
            if e.tag not in BLOCK or e.tag in VOID:
                continue
            if e.main is not None:
                own.add((e.hash, e.main.hash, 0, plain, False))
                if e.attributes and _named_inside(e):
                    own.add((_name_hash(e), 0, 0, plain, True))
            elif plain:
                own.add((e.hash, 0, root.hash, plain, False))
                if _link_list(e):
                    own.add((e.shape, 0, 0, plain, True))
            elif not e.holds_main:
                own |= {(e.loose, 0, root.hash, plain, False), (e.hash, 0, root.hash, plain, False), (e.shape, 0, 0, plain, True)}
        return own

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, found = [], []
            for host, source in zip(batch.column("host"), batch.column("html"), strict=True):
                own = of_page(source.as_py() or "")
                hosts += [host.as_py()] * len(own)
                found += own
            columns = list(zip(*found, strict=True)) or [()] * 5
            hashes = (pa.array(np.array(c, np.uint64).view(np.int64)) for c in columns[:3])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *hashes, *(pa.array(c, pa.bool_()) for c in columns[3:])], names=["host", "hash", "main", "body", "plain", "shape"])

    return mapped(pages.select("host", "html"), rows, "host string, hash bigint, main bigint, body bigint, plain boolean, shape boolean")


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, share_inside: float = SHARE_INSIDE) -> DataFrame:
    """(host, hash, loose, strict, body, shape): the flags say where subtrees with that hash, or of that shape, are the template's."""
    counted = subtrees(pages).groupBy("host", "hash", "main", "body", "plain", "shape").agg(F.count(F.lit(1)).alias("n"))
    each = stage(counted, "subtrees")
    exact, outside = each.where("NOT shape"), F.col("main") == 0
    counts = F.sum("n").alias("n"), F.count_if(~outside).alias("n_in"), F.count_if(outside).alias("n_out"), F.count_if(outside & F.col("plain")).alias("n_plain")
    held = exact.groupBy("host", "hash").agg(*counts).where(F.col("n") >= min_pages)
    total = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    whole = exact.where("main = hash OR body = hash").groupBy("host").agg(F.count_if(~outside).alias("n_articles"), F.count_if(outside).alias("n_bodies"), F.count_if(outside & F.col("plain")).alias("n_plain_bodies"))
    loose = F.col("n") >= share * F.col("n_pages")
    enough = lambda n, of: (F.col(n) >= min_pages) & (F.col(n) >= share_inside * F.col(of))
    body = enough("n_out", "n_bodies") | enough("n_plain", "n_plain_bodies")
    known = held.join(total, "host").join(whole, "host")
    known = known.select("host", "hash", loose.alias("loose"), (loose & enough("n_in", "n_articles")).alias("strict"), body.alias("body"), F.lit(False).alias("shape")).where("loose OR body")
    shapes = each.where("shape").groupBy("host", "hash").agg(F.sum("n").alias("n")).join(total, "host").where(enough("n", "n_pages"))
    return known.unionByName(shapes.select("host", "hash", F.lit(False).alias("loose"), F.lit(False).alias("strict"), F.lit(False).alias("body"), F.lit(True).alias("shape")))


def with_host(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    host = F.regexp_extract(F.lower(F.coalesce(F.col(url).cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return pages.select("page_id", F.col(url).alias("url"), host.alias("host"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, text) for each row of pages (page_id, url, html)."""
    source = with_host(pages)
    found = stage(templates(source), "templates")
    small = found.count() <= BROADCAST_ROWS
    sets = found.groupBy("host").agg(*[F.collect_list(F.when(F.col(flag), F.col("hash"))).alias(name) for flag, name in SETS.items()])
    # many sets are written, so that Spark may split the pages of a large host
    joined = source.join(F.broadcast(sets) if small else stage(sets, "sets"), "host", "left")
    kind = source.schema["page_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[set[int], ...]] = {}
        for whole in batches:
            for part in range(0, whole.num_rows, 256):
                batch = whole.slice(part, 256)
                texts = []
                for i, (host, source) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html"), strict=True)):
                    if host not in known:
                        if len(known) > 64:
                            known.clear()
                        known[host] = tuple({h & 0xFFFFFFFFFFFFFFFF for h in batch.column(c)[i].as_py() or ()} for c in SETS.values())
                    texts.append(main_text(source.as_py(), *known[host]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host")), pa.array(texts, pa.string())], names=["page_id", "url", "host", "text"])

    return mapped(joined.select("page_id", "url", "host", "html", *SETS.values()), rows, f"page_id {kind}, url string, host string, text string")


def op10_site_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
