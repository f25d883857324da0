"""Main text of web pages by site style trees.

Method: the elements of all pages of a host are merged by their place in the document,
the path of their elements with classes; containers without a class are told apart by
their number among their like.  A place is a branch: its content on a page is the text of
all blocks below it, its presentation the elements they are made of.  For each place the
pages give how content and presentation are spread: content that comes again on many
pages has a high entropy over them and little importance, and so has a place that looks
the same everywhere.  Branches below a least importance are noise of that host.  From
each page go the branches that are noise by their element or class (menus, adverts,
forms, comments), and the noisy branches.  Pages of one host whose articles have equal
text, or which show the same where no article is marked, count once: what comes again in
different articles goes, and an article that is mirrored stays.

A class is telling if one of its words, or the last part of one, names noise
(``user-comments``, not ``comments-open`` or ``with-sidebar``).  A marked article inside
a branch that only a class calls noise is shown where the page has nothing else.

The first scan sends hashes and counts, added up within a task before they move, and
the layouts of pages, the sets of places they have.  Noisy places, of which a host may
have any number, meet the layouts that have them; so a list never holds more places
than a page has.  The lists are written as a table and joined by host and layout, so
the texts themselves are not shuffled while the table is small.

Rows: null and empty pages have an empty text.  Pages without a url count as one
host.  Repeated pages count as often as they are there.  Unclosed elements end with
the page.  An empty table gives an empty result.  Other columns are not read and may
have any names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import small_batches, stored
from .urls import url_host

LEAST_IMPORTANCE = 0.6
#: Weight of content against presentation.
CONTENT_WEIGHT = 0.9
LEAST_PAGES = 8

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    # a quote that is never closed is no value: its tag ends at the next '>', or with the page
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+(?P<open>[\"'][^>]*+)?+)(?(open)(?:>|\Z)|>)"
    r"|<[!?][^>]*>",
    re.S,
)
_CLASS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_MAY_HIDE = re.compile(r"hidden|none", re.I)
_NOT_SHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)

#: Elements without an end, elements whose content is no text, elements that end a
#: block, elements that mark the main text, and those that are never part of it.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg math object select canvas".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot"
    " th thead tr ul".split()
)
_MAIN = frozenset(["article", "main"])
_NOISE_TAGS = frozenset("nav aside footer form menu dialog button head search".split())
#: Words of classes, ids and roles that name such parts, and what may stand before them
#: in a word that names something else.
_NOISE_WORDS = re.compile(
    r"(?:[^\s]*[_-])??(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|aside|breadcrumbs?|ads?|advert\w*|banner|sponsor\w*|promo\w*"
    r"|cookies?|consent|notice|popup|modal|newsletter|subscribe|signup|login|search|share|social|related|comments?|disqus|complementary|contentinfo)",
    re.I,
)
_ABOUT_OTHERS = re.compile(r"(?:with|without|has|have|no|not|is|before|after)[_-]", re.I)
#: Containers that are told apart by their number where they have no class.
_NUMBERED = frozenset("div section ul ol dl table blockquote header".split())
#: An open element that the start of another one ends, up to a container.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_DIGITS = re.compile(r"\d+")


def _named_noise(names: str) -> bool:
    return any(_NOISE_WORDS.fullmatch(word) and not _ABOUT_OTHERS.match(word) for word in names.split())


def _hides(rest: str) -> bool:
    """Whether the attributes of an element keep it from being shown."""
    if not _MAY_HIDE.search(rest):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), (a or b or c).strip().lower()
        if (name == "hidden" and value != "until-found") or (name == "aria-hidden" and value == "true") or (name == "style" and _NOT_SHOWN.search(value)):
            return True
    return False


@dataclass(frozen=True)
class Block:
    """A block of text: the places of the branches it lies in, down to its own, the inline
    elements in it, and what the elements around it say."""

    path: tuple[str, ...]
    style: str
    text: str
    main: bool
    #: Inside an element that is never shown as main text, or that a class calls noise.
    noise: bool
    named: bool

    @property
    def shown(self) -> bool:
        return not self.noise and not self.named


@dataclass
class _Open:
    """An open element, with what holds inside it."""

    tag: str
    path: tuple[str, ...]
    main: bool
    noise: bool
    named: bool
    #: An inline element around takes its text away.
    muted: bool
    children: Counter


def blocks(page: str | None) -> Iterator[Block]:
    """The blocks of a page that have text."""
    page = page or ""
    now = _Open("", (), False, False, False, False, Counter())
    open_tags = [now]
    parts: list[str] = []
    inline: list[str] = []
    at = 0

    def closed() -> Iterator[Block]:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            yield Block(now.path, ",".join(inline), text, now.main, now.noise, now.named)
        parts.clear()
        inline.clear()

    def left(n: int) -> None:
        nonlocal now
        del open_tags[n:]
        now = open_tags[-1]

    for found in iter(lambda: _TOKEN.search(page, at), None):
        if not now.muted:
            parts.append(page[at : found.start()])
        at = found.end()
        if found["tag"] is None:
            continue
        tag = found["tag"].lower()
        if found["end"]:
            n = next((i for i in range(len(open_tags) - 1, 0, -1) if open_tags[i].tag == tag), None)
            if n is not None:
                if any(t.tag in _BLOCK for t in open_tags[n:]):
                    yield from closed()
                left(n)
            elif tag == "p":
                yield from closed()
            continue
        rest = found["rest"]
        if tag in _RAW:
            if rest.endswith("/") and tag in ("svg", "math"):
                continue
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
        if tag in _BLOCK:
            yield from closed()
            ended = _ENDS.get(tag, set()) | {"p"}
            for i in range(len(open_tags) - 1, 0, -1):
                if open_tags[i].tag in ended:
                    left(i)
                    break
                if open_tags[i].tag in _BLOCK or open_tags[i].tag == "button":
                    break
        if tag in _VOID:
            continue
        names = " ".join(a or b or c for _, a, b, c in _CLASS.findall(rest)) if rest else ""
        named = bool(names) and tag not in ("html", "body") and _named_noise(names)
        noise = tag in _NOISE_TAGS or (tag == "header" and not now.main) or bool(rest and _hides(rest))
        if tag in _BLOCK:
            step = f"{tag}.{_DIGITS.sub('0', names)}" if names else tag
            if not names and tag in _NUMBERED:
                step = f"{tag}:{now.children[tag]}"
                now.children[tag] += 1
            now = _Open(tag, (*now.path, step), now.main or tag in _MAIN, now.noise or now.muted or noise, now.named or named, False, Counter())
        else:
            inline.append(tag)
            # inline elements have no place of their own, but may take away what is in them
            now = _Open(tag, now.path, now.main, now.noise, now.named, now.muted or noise or named, now.children)
        open_tags.append(now)
    if not now.muted:
        parts.append(page[at:])
    yield from closed()


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _places_of(path: tuple[str, ...]) -> list[int]:
    """The place of each branch that a block lies in."""
    return [_hash("/".join(path[: n + 1])) for n in range(len(path))]


def _layout(found: list[Block]) -> int:
    return _hash("\n".join(sorted({"/".join(b.path) for b in found})))


def _candidates(found: list[Block]) -> list[Block]:
    """The blocks of a page, or of its marked article, outside noise branches."""
    kept = [b for b in found if b.shown]
    # where a class hides all there is, it may have named something else than noise
    kept = kept or [b for b in found if b.main and not b.noise]
    marked = any(b.main for b in kept)
    return [b for b in kept if b.main == marked]


def main_text(page: str | None, noisy: set[int]) -> str:
    """The text of a page, or of its marked article, without noise."""
    return " ".join(b.text for b in _candidates(list(blocks(page))) if noisy.isdisjoint(_places_of(b.path)))


_PRESENT, _CONTENT, _STYLE, _LAYOUT = 0, 1, 2, 3


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages that have a place, and its contents, styles and layouts, counted by host;
    with the hash of what the page shows where pages that show the same count once."""
    names = ["host", "place", "kind", "value", "article", "n"]

    def made(counts: Counter) -> pa.RecordBatch:
        keys = list(counts)
        columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.int64())], names)

    counts: Counter = Counter()
    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = list(blocks(page))
            layout = _layout(found)
            shown = _candidates(found)
            marked = any(b.main for b in shown)
            whole = _hash("\0".join(b.text for b in shown))
            branches: dict[int, list] = {}
            for block in found:
                # a place is inside the article if all of its blocks are
                for place in _places_of(block.path) or [_hash("")]:
                    branch = branches.setdefault(place, [True, [], []])
                    branch[0] &= block.main
                    branch[1].append(block.text)
                    branch[2].append(f"{block.path[-1:]}{block.style}")
            seen = set()
            for place, (main, texts, styles) in branches.items():
                article = whole if main or not marked else None
                values = ((_PRESENT, 0), (_STYLE, _hash(" ".join(styles))), (_LAYOUT, layout), *((_CONTENT, v) for v in {_hash("\0".join(texts))}))
                seen |= {(host, place, kind, value, article) for kind, value in values}
            counts.update(seen)
            if len(counts) > 200_000:
                yield made(counts)
                counts.clear()
    if counts:
        yield made(counts)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The layout of each page and its blocks that may be shown."""
    parts = pa.list_(pa.struct([("places", pa.list_(pa.int64())), ("text", pa.string())]))
    for batch in batches:
        layouts, shown = [], []
        for page in batch.column(3).to_pylist():
            found = list(blocks(page))
            layouts.append(_layout(found))
            shown.append([{"places": _places_of(b.path) or [_hash("")], "text": b.text} for b in _candidates(found)])
        columns = [*[batch.column(i) for i in range(3)], pa.array(layouts, pa.int64()), pa.array(shown, parts)]
        yield pa.RecordBatch.from_arrays(columns, ["id", "url", "host", "layout", "parts"])


def place_values(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """How many pages of a ``host`` have each ``value`` of a ``kind`` at a ``place``.
    Pages of equal articles are one page for the places inside them."""
    small_batches(pages.sparkSession, 500)
    source = pages.select(url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    rows = source.mapInArrow(_places, "host string, place long, kind int, value long, article long, n long")
    each = rows.groupBy("host", "place", "kind", "value", "article").agg(F.sum("n").alias("n"))
    once = F.when(F.col("article").isNull(), F.col("n")).otherwise(1)
    return each.groupBy("host", "place", "kind", "value").agg(F.sum(once).alias("n"))


def style_tree(values: DataFrame) -> DataFrame:
    """``host``, ``place``, ``pages`` that have it, ``content`` and ``presentation``
    importance and their weighted ``importance``."""
    here = F.sum(F.when(F.col("kind") == _PRESENT, F.col("n")))

    def spread(kind: int):
        """Sum of n log n and sum of n over the values of a kind."""
        n = F.when(F.col("kind") == kind, F.col("n"))
        return F.coalesce(F.sum(n * F.log(n)), F.lit(0.0)), F.coalesce(F.sum(n), F.lit(0))

    content, style = spread(_CONTENT), spread(_STYLE)
    nodes = values.groupBy("host", "place").agg(here.alias("pages"), content[0].alias("c"), content[1].alias("cn"), style[0].alias("s"), style[1].alias("sn"))
    base = F.log("pages")
    # a value on n of m pages has the entropy log n / log m over them
    spread_out = (F.col("pages") > 1) & (F.col("cn") > 0)
    nodes = nodes.withColumn("content", F.when(spread_out, 1 - F.try_divide("c", "cn") / base).otherwise(1.0))
    nodes = nodes.withColumn("presentation", F.when(spread_out, (F.log("sn") - F.try_divide("s", "sn")) / base).otherwise(1.0))
    importance = CONTENT_WEIGHT * F.col("content") + (1 - CONTENT_WEIGHT) * F.col("presentation")
    return nodes.select("host", "place", "pages", "content", "presentation", importance.alias("importance"))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Id, url, ``text`` and ``n_chars`` of each page."""
    values = stored(place_values(pages, url_col, html_col))
    noisy = style_tree(values).filter((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LEAST_IMPORTANCE)).select("host", "place")
    layouts = values.filter(F.col("kind") == _LAYOUT).select("host", "place", F.col("value").alias("layout"))
    noise = stored(layouts.join(noisy, ["host", "place"]).groupBy("host", "layout").agg(F.collect_list("place").alias("places")))

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    read = source.mapInArrow(_read, f"id {kinds[0]}, url {kinds[1]}, host string, layout long, parts array<struct<places:array<long>,text:string>>")
    joined = read.join(noise, ["host", "layout"], "left")
    kept = F.filter("parts", lambda x: F.col("places").isNull() | ~F.arrays_overlap("places", x["places"]))
    text = F.array_join(F.transform(kept, lambda x: x["text"]), " ")
    done = joined.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("long"))
