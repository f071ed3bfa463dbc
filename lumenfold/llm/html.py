"""Main text of web pages, by equivalence classes of tokens over a host's pages.

A page is a sequence of tokens: element starts, told apart by the path of elements that
they stand in, and texts of blocks, with their path. Tokens of a host that occur equally often
on every page, that is, share their occurrence vector, are one class. A vector is kept as a
sum of hashes of (page, count), which is the same in any order, so that no host's pages ever
meet in one task; pages with equal html count once. A class is a candidate if it has MIN_CLASS tokens or more, element
starts among them, and stands on half of the host's pages and MIN_PAGES of them at least. It is valid if

- it is ordered: on every page its tokens come in one order, and in that order again for each time that they are repeated, and
- it is nested: with each better class (on more pages, then of more tokens) it has, on every page, all its
  occurrences in one and the same gap of that class, or all that class's in one of its own.

The valid classes together, one in the gaps of the other, are the host's template. What stands between
their tokens are slots, and these hold the data of a page (:func:`slots`). A text of a valid class whose path holds no other text on the host is
template text. Where the path has other texts too it is shared text, and the container that it stands in decides on each page: it is data beside much
data of the page's own (a paragraph that all articles have), and template beside little (a line below a page, next to one that changes).

A page's main text are the texts of its slots that aren't links for the most part. Elements break the tie between them: article and main elements that
hold more than links are taken before the rest, unless a container outside them holds more than twice their text, less links (then they are teasers). Slots in menus, page headers and footers, sidebars, forms, dialogs, scripts, styles and hidden elements are
left out by their elements and roles. Class names break ties that structure can't: notices, adverts and readers' comments within an
article are known by a name that says nothing else (``cookie-notice`` does, ``legal-analysis`` doesn't); of words within a text only adverts are
left out by name. Headings in an article's header are kept, the rest of that header isn't.

Defined results: a null, empty or textless page gives an empty text; so does one whose text
is all in left-out slots; unclosed elements end with their parent, and one that would be left out (an ``aside`` without an end) leaves out its first text
alone; a null or odd URL puts
a page on the host ""; hosts of fewer than MIN_PAGES different pages have no template, and markup
alone decides; where an article holds template texts alone these stay; equal pages give equal texts;
very long pages are read whole, in memory that grows with one page; an empty table gives an empty one. Columns
named text, n_chars and html are replaced or left out, all others are kept whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.batches import bounded_batches
from lumenfold.llm.columns import others, quoted, unused
from lumenfold.session import checkpointed, discard, stored

MIN_PAGES = 4
MIN_CLASS = 3
#: Tables of templates are sent to every task up to so many bytes; beyond, they are joined by host and one of SALTS parts of its pages.
BROADCAST_BYTES = 16 << 20
SALTS = 64

# Names of HTML elements, roles and usual class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe svg math object canvas textarea title head audio video".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe")
LEFT_OUT = frozenset("nav header footer aside form button select dialog menu".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
CELLS = frozenset(("td", "th"))
ENDED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option",)),
    "tr": frozenset(("tr", "tbody")), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")),
}
SCOPES = frozenset("article aside section div table ul ol dl main nav header footer form body html".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adbox adslot adunit sponsor sponsored sponsors promo promos promotion cookie cookies consent
    gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup paywall sidebar sidebars widget widgets related
    recommended recommendations share sharing social comment comments commentlist disqus respond replies breadcrumb breadcrumbs menu menus nav navbar
    navigation footer header masthead topbar pagination pager toolbar login signin register search banner alert skip copyright disclaimer
    announcement donate donation outbrain taboola""".split()
)
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adbox adslot adunit sponsor sponsored sponsors outbrain taboola".split())
GENERIC = frozenset(
    """box block container wrapper wrap section list area bar item items unit slot inner content body panel top bottom left right site page main reader
    readers user post posts article articles story stories link links button buttons icon icons form thread count header footer""".split()
)
WHOLE = frozenset(("article", "main"))
MAIN_NAMES = frozenset("article post entry story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^"'>]|"[^"]*"|'[^']*')*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\s(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_RAW_END = {t: re.compile(rf"</{t}\b", re.I) for t in RAW}


@lru_cache(50_000)
def _element(tag: str) -> tuple[str, str, bool, bool, bool]:
    """Of a start tag: name, step of the path, whether markup leaves it out, whether its names do, and whether it holds the main text."""
    name = re.match(r"<([a-zA-Z][^\s/>]*)", tag)[1].lower()
    attributes = {}
    if len(tag) > len(name) + 2:
        for m in _ATTRIBUTE.finditer(tag):
            attributes.setdefault(m[1].lower(), entities.unescape((m[2] or "").strip("\"'")))
    names = (attributes.get("class", "") + " " + attributes.get("id", "")).split()
    role = attributes.get("role", "").lower()
    out = name in LEFT_OUT or name in SILENT or role in ROLES or attributes.get("aria-hidden") == "true" or "hidden" in attributes
    out = out or re.search(r"display\s*:\s*none", attributes.get("style", "")) is not None
    whole = name in WHOLE or role in WHOLE
    named = False
    for part in names:
        words = {w.lower() for w in _NAME.findall(part)}
        # A name that says nothing but what is left out.
        left_out = ADVERTS if name in INLINE else NAMES
        if words & left_out and words <= left_out | GENERIC and name not in ("html", "body", "main") and name not in HEADINGS:
            named = True
        elif name in ("div", "section") and words & MAIN_NAMES and not words & NAMES:
            whole = True
    classes = ".".join(sorted({re.sub(r"\d+", "0", n) for n in attributes.get("class", "").split()}))
    return name, f"{name}.{classes}" if classes else name, out, named, whole and not out and not named


@dataclass
class Block:
    path: str
    out: bool
    whole: bool
    text: str
    linked: int
    #: The innermost container and the innermost article or main element, by number; 0 is none.
    scope: int = 0
    within: int = 0
    #: Elements around it that are left out, and the innermost of them.
    outs: int = 0
    owner: int = 0


@dataclass
class Page:
    #: Element starts, by path, and blocks of text, in the order of the page.
    items: list[str | Block] = field(default_factory=list)

    @property
    def blocks(self) -> list[Block]:
        return [x for x in self.items if isinstance(x, Block)]


@dataclass
class _Open:
    """An open element; ``header``: in an article's header, where only headings count."""

    name: str
    path: str
    out: bool = False
    whole: bool = False
    header: bool = False
    number: int = 0
    scope: int = 0
    within: int = 0
    outs: int = 0
    owner: int = 0
    #: Where its items begin.
    begin: int = 0


def _end_of(source: str, name: str, at: int) -> int:
    """Where an element that began before ``at`` ends, those of its name inside it counted; ``at`` if it doesn't."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(name)}(?![^\s/>])[^>]*>", re.I).finditer(source, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return at


def parse(source: str | None) -> Page:
    """Element starts and blocks of text with their paths, in order."""
    page = Page()
    if not source:
        return page
    stack = [_Open("", "")]
    pending: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if pending:
            text = " ".join("".join(pending).split())
            if text:
                top = stack[-1]
                out = top.out or top.header and top.name not in HEADINGS
                page.items.append(Block(top.path, out, top.whole, text, min(linked, len(text)), top.scope, top.within, top.outs, top.owner))
            pending.clear()
        linked = 0

    def unclosed(opened: list[_Open]) -> None:
        """Of elements that are left out and have no end, all but the first text is kept, unless another leaves it out."""
        for element in opened:
            if element.owner == element.number and element.name in LEFT_OUT:
                texts = [b for b in page.items[element.begin :] if isinstance(b, Block) and b.owner == element.number and b.outs == 1]
                for b in texts[1:]:
                    b.out = False

    at, size, number = 0, len(source), 0
    while at < size:
        m = _TOKEN.search(source, at)
        end = m.start() if m else size
        if end > at and stack[-1].name not in SILENT:
            text = entities.unescape(source[at:end]) if "&" in source[at:end] else source[at:end]
            pending.append(text)
            if links:
                linked += len(text.strip())
        if not m:
            break
        tag, at = m[0], m.end()
        if tag[1] in "!?":
            continue
        if tag[1] == "/":
            name = re.match(r"</([a-zA-Z][^\s/>]*)", tag)[1].lower()
            if name == "a":
                links = max(0, links - 1)
            if name in INLINE:
                if name == "br":
                    pending.append(" ")
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    flush() if name not in CELLS else pending.append(" ")
                    unclosed(stack[depth + 1 :])
                    del stack[depth:]
                    break
                if stack[depth].name in SCOPES and name not in SCOPES:
                    break
            continue
        name, step, out, named, whole = _element(tag)
        if name in INLINE:
            if out or named:  # its text, up to its own end, is no part of the block
                at = _end_of(source, name, at) if name not in VOID else at
            elif name == "a":
                links += 1
            elif name in ("br", "img"):
                pending.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in CELLS:
            pending.append(" ")
        else:
            flush()
        for depth in range(len(stack) - 1, 0, -1):
            if name in ENDED_BY.get(stack[depth].name, ()):
                if name not in CELLS:
                    flush()
                del stack[depth:]
                break
            if stack[depth].name in SCOPES:
                break
        top = stack[-1]
        path = f"{top.path}>{step}" if top.path else step
        page.items.append(path)
        if tag.endswith("/>") and name in ("svg", "math", "path"):
            continue
        header = name == "header" and top.whole and not named
        number += 1
        hides = named or out and not header
        stack.append(_Open(
            name, path, top.out or hides, whole or top.whole, top.header or header, number, number if name in SCOPES else top.scope,
            number if whole else top.within, top.outs + hides, number if hides else top.owner, len(page.items),
        ))
        links = 0 if name in SCOPES else links
        if name in _RAW_END:
            close = _RAW_END[name].search(source, at)
            at = close.start() if close else size
    flush()
    unclosed(stack)
    return page


def _hash(kind: str, *parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join((kind, *parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def token_of(item: str | Block) -> int:
    return _hash("e", item) if isinstance(item, str) else _hash("t", item.path, item.text)


def occurrences(page: Page) -> Iterator[tuple[str, int, int, list[int]]]:
    """Kind (e: element start, t: text), token, path and places on the page. Texts that are left out anyway have no part."""
    found: dict[tuple[str, int, int], list[int]] = {}
    for place, item in enumerate(page.items):
        if isinstance(item, str):
            found.setdefault(("e", token_of(item), _hash("p", item)), []).append(place)
        elif not item.out:
            found.setdefault(("t", token_of(item), _hash("p", item.path)), []).append(place)
    for key, places in found.items():
        yield *key, places


@dataclass(frozen=True)
class Template:
    """A host's template: tokens of element starts, of texts, and of texts whose path holds data too."""

    starts: frozenset[int] = frozenset()
    texts: frozenset[int] = frozenset()
    shared: frozenset[int] = frozenset()


NO_TEMPLATE = Template()


def slots(page: Page, template: Template = NO_TEMPLATE) -> list[tuple[list[Block], list[Block]]]:
    """What stands between two tokens of the template: the page's own blocks, and template texts that end the slot."""
    found: list[tuple[list[Block], list[Block]]] = [([], [])]
    for item in page.items:
        if isinstance(item, str):
            if template.starts and token_of(item) in template.starts:
                found.append(([], []))
        elif template.texts and token_of(item) in template.texts:
            found[-1][1].append(item)
            found.append(([], []))
        else:
            found[-1][0].append(item)
    return found


def _by(blocks: list[Block], key: str) -> dict[int, int]:
    """Text less links of the containers that ``key`` names."""
    found: dict[int, int] = {}
    for b in blocks:
        name = getattr(b, key)
        found[name] = found.get(name, 0) + len(b.text) - b.linked
    return found


def main_text(source: str | None, template: Template = NO_TEMPLATE) -> str:
    """The page's main text, given its host's template."""
    page = parse(source)
    between = slots(page, template)
    own = [b for data, _ in between for b in data if not b.out]
    fixed = {id(b) for _, texts in between for b in texts}
    if template.shared:
        shared = {id(b) for b in own if token_of(b) in template.shared}
        data = _by([b for b in own if id(b) not in shared], "scope")
        most = max(data.values(), default=0)
        # A container of an article's rank stands for itself; any other needs a quarter of what the fullest has.
        lost = {id(b) for b in own if id(b) in shared and b.scope != b.within and 4 * data.get(b.scope, 0) < most}
        own = [b for b in own if id(b) not in lost]
        fixed |= lost
    listed = [b for b in own if b.whole] or [b for b in page.blocks if b.whole and not b.out]
    chars: dict[int, int] = {}
    for b in listed:
        chars[b.within] = chars.get(b.within, 0) + len(b.text)
    told = _by(listed, "within")
    listed = [b for b in listed if 2 * told[b.within] > chars[b.within]]
    apart = [b for b in own if not b.whole and 2 * b.linked < len(b.text)]
    if listed and max(_by(apart, "scope").values(), default=0) <= 2 * sum(told[w] for w in {b.within for b in listed}):
        chosen = listed
    else:
        chosen = apart or own or [b for b in page.blocks if not b.out and id(b) not in fixed]
    return "\n".join(b.text for b in chosen)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


#: A class on one page: its order, and whether its tokens keep it; or two classes: in which gap of the first all of the second stand, and the other way round.
_RELATION = "first long, second long, a long, b long, holds boolean"


def relations(tokens: list[tuple[int, int, int, int, list[int]]]) -> list[tuple[int, int, int, int, bool]]:
    """Rows of _RELATION for one page, from (class, pages, size, token, places) of its tokens."""
    by_class: dict[tuple[int, int, int], list[tuple[int, list[int]]]] = {}
    for c, pages, size, token, places in tokens:
        by_class.setdefault((-pages, -size, c), []).append((token, places))
    rows, spans = [], []
    for (_, size, c), members in sorted(by_class.items()):
        size = -size
        at = np.concatenate([np.asarray(p, np.int64) for _, p in members])
        token = np.repeat(np.array([t for t, _ in members], np.int64), [len(p) for _, p in members])
        order = np.argsort(at)
        at, token = at[order], token[order]
        whole = len(members) == size and len(at) % size == 0 and bool((token.reshape(-1, size) == token[:size]).all())
        name = xxhash.xxh64_intdigest(token[:size].tobytes()) - (1 << 63)
        rows.append((c, c, name, name, whole))
        if whole:
            spans.append((c, size, at, at.reshape(-1, size)))

    def gap(outer: tuple, inner: tuple) -> int:
        """The one gap of ``outer`` that has all of ``inner``, or -1."""
        before, after = np.searchsorted(outer[2], inner[3][:, 0]), np.searchsorted(outer[2], inner[3][:, -1])
        place = before % outer[1]
        return int(place[0]) if (before == after).all() and (place == place[0]).all() else -1

    for i, one in enumerate(spans):
        for other in spans[i + 1 :]:
            a, b = gap(one, other), gap(other, one)
            rows.append((one[0], other[0], a, b, a >= 0 or b >= 0))
    return rows


def _with_small(rows: DataFrame, small: DataFrame, on: list[str], salt: str, n_bytes: int) -> DataFrame:
    """``rows`` joined with a table that is sent to every task if it is small, else by ``on`` and one of SALTS parts, so that no host's rows meet in one task."""
    if n_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(small), on)
    (part,) = unused([*rows.columns, *small.columns], "part")
    dealt = small.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(part, F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(dealt, [*on, part]).drop(part)


def templates(pages: DataFrame) -> DataFrame:
    """``host``, ``starts``, ``texts`` and ``shared`` (tokens of the template) of every host with a template. ``pages``: url, html."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(host, key, *token) for host, key, source in zip(pdf["host"], pdf["key"], pdf["html"], strict=True) for token in occurrences(parse(source))]
            yield pd.DataFrame(rows, columns=["host", "key", "kind", "token", "path", "at"])

    keyed = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("key"), "html")
    found = keyed.mapInPandas(run, "host string, key long, kind string, token long, path long, at array<int>")
    # Equal pages have equal rows; one of them stays.
    found = stored(found.groupBy("host", "key", "kind", "token", "path").agg(F.min("at").alias("at")))
    n_pages = found.groupBy("host", "key").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    times = F.size("at")
    vectors = stored(
        found.groupBy("host", "kind", "token", "path").agg(
            F.count(F.lit(1)).alias("support"),
            # Sums of 32-bit numbers can't overflow; two of them tell vectors apart.
            F.sum(F.hash("key", times).cast("long")).alias("v1"),
            F.sum(F.shiftright(F.xxhash64("key", times), 32)).alias("v2"),
        )
    )
    often = vectors.join(n_pages, "host").where((F.col("support") >= MIN_PAGES) & (F.col("support") * 2 >= F.col("n_pages")))
    often = often.withColumn("class", F.xxhash64("support", "v1", "v2"))
    sizes = often.groupBy("host", "class").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("kind") == "e").alias("n_starts"))
    members = checkpointed(
        often.join(sizes.where((F.col("size") >= MIN_CLASS) & (F.col("n_starts") > 0)), ["host", "class"]).select("host", "token", "kind", "path", "class", "support", "size")
    )
    n_bytes = members.agg(F.sum(F.length("host") + 64)).first()[0] or 0

    @F.pandas_udf(f"array<struct<{', '.join(x.replace(' ', ':') for x in _RELATION.split(', '))}>>")
    def related(tokens: pd.Series) -> pd.Series:
        return pd.Series([relations([(t["class"], t["support"], t["size"], t["token"], t["at"]) for t in page]) for page in tokens])

    small = members.select("host", "token", "class", "support", "size")
    on_page = _with_small(found.select("host", "key", "token", "at"), small, ["host", "token"], "key", n_bytes)
    by_page = on_page.groupBy("host", "key").agg(F.collect_list(F.struct("class", "support", "size", "token", "at")).alias("tokens"))  # of one page
    related_rows = by_page.select("host", F.explode(related("tokens")).alias("r")).select("host", "r.*")
    pairs = checkpointed(
        related_rows.groupBy("host", "first", "second").agg(
            F.bool_and("holds").alias("holds"), *[f(x).alias(f"{n}_{x}") for x in "ab" for n, f in (("least", F.min), ("most", F.max))]
        )
    )
    same = [(F.col(f"least_{x}") == F.col(f"most_{x}")) for x in "ab"]
    itself = F.col("first") == F.col("second")
    ordered = pairs.where(itself & F.col("holds") & same[0]).select("host", F.col("first").alias("class"))
    nested = (same[0] & (F.col("least_a") >= 0)) | (same[1] & (F.col("least_b") >= 0))
    # What overlaps a better class that is ordered is no part of the template.
    crossed = pairs.where(~itself & ~nested).join(ordered.withColumnRenamed("class", "first"), ["host", "first"], "left_semi")
    valid = ordered.join(crossed.select("host", F.col("second").alias("class")), ["host", "class"], "left_anti")
    tokens = checkpointed(members.join(valid, ["host", "class"]).select("host", "token", "kind", "path"))
    # A path that has other texts too holds data.
    held = vectors.where("kind = 't'").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n_texts"))
    fixed = tokens.where("kind = 't'").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n_fixed"))
    fixed = fixed.join(held, ["host", "path"]).select("host", "path", (F.col("n_fixed") == F.col("n_texts")).alias("alone"))
    of_text = tokens.where("kind = 't'").join(fixed, ["host", "path"])
    texts = of_text.groupBy("host").agg(*[
        F.sort_array(F.collect_set(F.when(which, F.col("token")))).alias(name) for name, which in (("texts", F.col("alone")), ("shared", ~F.col("alone")))
    ])
    starts = tokens.where("kind = 'e'").groupBy("host").agg(F.sort_array(F.collect_set("token")).alias("starts"))  # as many as a template has
    none = F.array().cast("array<long>")
    result = stored(starts.join(texts, "host", "left").select("host", "starts", *[F.coalesce(x, none).alias(x) for x in ("texts", "shared")]))
    discard(found)
    discard(vectors)
    return result


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``; the html is left out."""
    spark = pages.sparkSession
    bounded_batches(spark)
    table = templates(pages.select("url", "html"))
    n_bytes = table.agg(F.sum(F.length("host") + 8 * (F.size("starts") + F.size("texts") + F.size("shared")) + 64)).first()[0] or 0
    kept = [F.col(quoted(c)) for c in others(pages.columns, "text", "n_chars", "html")]
    if n_bytes <= BROADCAST_BYTES:
        known = {r.host: Template(frozenset(r.starts), frozenset(r.texts), frozenset(r.shared)) for r in table.collect()}
        shared = spark.sparkContext.broadcast(known)

        @F.pandas_udf("string")
        def of_known(sources: pd.Series, hosts: pd.Series) -> pd.Series:
            get = shared.value.get
            return pd.Series([main_text(s, get(h, NO_TEMPLATE)) for s, h in zip(sources, hosts, strict=True)], dtype=object)

        result = pages.select(*kept, of_known(F.col("html"), host_of(F.col("url"))).alias("text"))
    else:

        @F.pandas_udf("string")
        def of_joined(sources: pd.Series, starts: pd.Series, texts: pd.Series, shared: pd.Series) -> pd.Series:
            return pd.Series([
                main_text(s, NO_TEMPLATE if a is None else Template(*(frozenset(x.tolist()) for x in (a, *more))))
                for s, a, *more in zip(sources, starts, texts, shared, strict=True)
            ], dtype=object)

        host, part, other, dealt, *sets = unused(pages.columns, "host", "part", "of_host", "of_part", "starts", "texts", "shared")
        named = table.select(F.col("host").alias(other), *[F.col(x).alias(alias) for x, alias in zip(("starts", "texts", "shared"), sets, strict=True)])
        named = named.withColumn(dealt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = pages.select("*", host_of(F.col("url")).alias(host), F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int").alias(part))
        joined = salted.join(named, (F.col(host) == F.col(other)) & (F.col(part) == F.col(dealt)), "left")
        result = joined.select(*kept, of_joined(F.col("html"), *[F.col(x) for x in sets]).alias("text"))
    return result.withColumn("n_chars", F.length("text").cast("long"))
