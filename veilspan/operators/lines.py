"""Text lines with boxes: search index, mapping spans to boxes, address blocks.

Two forms are offered.  A *page row* carries its recognised lines as
``array<struct<text,bbox,confidence>>``, just as one recognition result
describes one image; it is processed inside its row, without a shuffle.  A
*line table* has one row per line ``(.., line_no, text, bbox, confidence)``
with dense zero-based ``line_no``; its operators split even a single huge page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import patterns as P
from veilspan.functions.arrays import distinct_by, indexes, let, let_sql, running_sql
from veilspan.functions.boxes import enclosing_bbox, make_bbox
from veilspan.functions.text import find_structured_sql, no_detections, strip
from veilspan.operators.chunks import (
    address_lines_in_chunks,
    line_chunks,
    line_rows,
    structured_in_chunks,
)
from veilspan.operators.scan import CHUNK, split_by_count
from veilspan.operators.scan import running as running_rows
from veilspan.schemas import BOX_DETECTIONS

# Lines looked at together, when they are searched and when hits are mapped to them.
_BLOCK_LINES = 128

# Lines of one page that are gathered into a row at most.
MAX_PAGE_LINES = 20_000

# --- predicates -------------------------------------------------------------


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def runs_line_semantics(text: Column | str) -> Column:
    """Short, non-blank lines are worth a second look on their own."""
    return let(
        strip(text),
        lambda t: (t != "")
        & (F.length(t) <= P.LINE_MAX_CHARS)
        & (F.size(F.split(t, rf"(?U){P.SPACE}+")) <= P.LINE_MAX_WORDS),
    )


def is_address_header(text: Column | str) -> Column:
    return _col(text).rlike(P.ADDRESS_HEADER)


def is_stop_header(text: Column | str) -> Column:
    """A new field; an address header wins where both would match."""
    return _col(text).rlike(P.STOP_HEADER) & ~is_address_header(text)


# --- page rows --------------------------------------------------------------


def no_boxes() -> Column:
    return F.array().cast(BOX_DETECTIONS)


def page_text_sql(items: str) -> str:
    return rf"array_join(transform({items}, i -> i.text), '\n')"


def page_text(items: str) -> Column:
    """The searchable text of a page: its lines joined by newlines."""
    return F.expr(page_text_sql(items))


def line_spans(items: str) -> Column:
    """Character range of every line inside ``page_text``."""

    def spans(lengths: str) -> str:
        return let_sql(
            running_sql(f"transform({lengths}, n -> n + 1)", "0", lambda a, b: f"{a} + {b}"),
            lambda starts: f"transform({lengths}, (n, i) -> named_struct("
            f"'start', {starts}[i], 'end', {starts}[i] + n))",
        )

    return F.expr(let_sql(f"transform({items}, i -> length(i.text))", spans))


def map_spans_to_boxes(detections: Column | str, items: str) -> Column:
    """Text detections of a page as box detections.

    A detection covers the lines its span overlaps; its box encloses them and
    its confidence is limited by theirs.  Spans over no line are dropped.
    Detections are visited in the order of ``detections``.
    """
    detections, lines = _col(detections), F.col(items)

    def overlaps(detection: Column, span: Column) -> Column:
        return (detection["start"] < span["end"]) & (span["start"] < detection["end"])

    def in_blocks(spans: Column) -> Column:
        """Lines with their spans, in blocks that know the span they cover."""
        paired = F.arrays_zip(lines.alias("item"), spans.alias("span"))
        first = F.sequence(
            F.lit(1), F.greatest(F.size(lines), F.lit(1)), F.lit(_BLOCK_LINES)
        )
        return let(
            paired,
            lambda rows: F.transform(
                first,
                lambda i: let(
                    F.slice(rows, i, F.lit(_BLOCK_LINES)),
                    lambda block: F.struct(
                        F.element_at(block, 1)["span"]["start"].alias("start"),
                        F.element_at(block, -1)["span"]["end"].alias("end"),
                        block.alias("rows"),
                    ),
                ),
            ),
        )

    def one(detection: Column, blocks: Column) -> Column:
        near = F.flatten(
            F.transform(
                F.filter(blocks, lambda b: overlaps(detection, b)), lambda b: b["rows"]
            )
        )
        hit = F.transform(
            F.filter(near, lambda r: overlaps(detection, r["span"])), lambda r: r["item"]
        )
        return let(
            hit,
            lambda covered: F.struct(
                detection["detection_type"].alias("detection_type"),
                enclosing_bbox(F.transform(covered, lambda i: i["bbox"])).alias("bbox"),
                F.least(
                    detection["confidence"],
                    F.array_min(F.transform(covered, lambda i: i["confidence"])),
                ).alias("confidence"),
            ),
        )

    return F.when(
        (F.size(detections) > 0) & (F.size(lines) > 0),
        let(
            let(line_spans(items), in_blocks),
            lambda blocks: F.filter(
                F.transform(detections, lambda d: one(d, blocks)),
                lambda d: d["bbox"].isNotNull(),
            ),
        ),
    ).otherwise(no_boxes())


def address_blocks(
    items: Column | str,
    following: int = P.ADDRESS_FOLLOWING_LINES,
    gap_ratio: float = P.ADDRESS_GAP_RATIO,
) -> Column:
    """Lines belonging to an address block, as box detections.

    A line belongs to one when it is a header, or when the nearest header lies
    at most ``following`` lines above and no line from there on opens another
    field or stands too far below its predecessor.
    """
    items = _col(items)

    def select(flags: Column) -> Column:
        def inside(i: Column) -> Column:
            first = F.greatest(F.lit(0), i - following)
            recent = F.slice(flags, first + 1, i - first + 1)
            marks = F.array_join(recent, "")
            # h header, b break, n neither; nothing but n may follow the header
            return marks.rlike("hn*$")

        return F.transform(
            F.filter(indexes(flags), inside),
            lambda i: F.struct(
                F.lit("address").alias("detection_type"),
                F.get(items, i)["bbox"].alias("bbox"),
                F.get(items, i)["confidence"].alias("confidence"),
            ),
        )

    def mark(item: Column, i: Column) -> Column:
        above = F.get(items, i - 1)["bbox"]
        return (
            F.when(is_address_header(item["text"]), "h")
            .when(is_stop_header(item["text"]), "b")
            .when((i > 0) & _too_far(above, item["bbox"], gap_ratio), "b")
            .otherwise("n")
        )

    has_header = F.exists(items, lambda i: is_address_header(i["text"]))
    return F.when(has_header, let(F.transform(items, mark), select)).otherwise(no_boxes())


def _too_far(above: Column, box: Column, gap_ratio: float) -> Column:
    reference = F.greatest(
        above["y2"] - above["y1"], box["y2"] - box["y1"], F.lit(1)
    )
    return (box["y1"] - above["y2"]) > reference * F.lit(gap_ratio)


def dedupe_box_array(boxes: Column | str) -> Column:
    """One detection per (type, box) with the highest confidence."""
    return distinct_by(
        _col(boxes),
        key=lambda d: F.struct(d["detection_type"], d["bbox"]),
        order=lambda d: -d["confidence"],
    )


def page_text_detections(
    items: str,
    semantic: Column | None = None,
    line_semantic: Column | None = None,
) -> Column:
    """All text detections of a page as boxes, deduplicated.

    ``semantic`` holds plug-in detections on the page text, ``line_semantic``
    box detections of the per-line second look.
    """
    structured = F.expr(let_sql(page_text_sql(items), find_structured_sql))
    parts = [
        let(structured, lambda found: map_spans_to_boxes(found, items)),
        address_blocks(items),
    ]
    if semantic is not None:
        parts.append(map_spans_to_boxes(F.coalesce(semantic, no_detections()), items))
    if line_semantic is not None:
        parts.append(F.coalesce(line_semantic, no_boxes()))
    return F.when(F.size(items) > 0, dedupe_box_array(F.concat(*parts))).otherwise(
        no_boxes()
    )


def pages_from_lines(
    lines: DataFrame, keys: Sequence[str], max_lines: int = MAX_PAGE_LINES
) -> tuple[DataFrame, DataFrame]:
    """Page rows of a line table, and the lines of pages too large for a row.

    The size of every page is counted before anything is gathered, so no task
    collects more than ``max_lines`` lines.  The rest goes through the
    line-table operators below, which give the same results.
    """
    keys = list(keys)
    small, large = split_by_count(lines, keys, max_lines)
    pages = small.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("line_no", "text", "bbox", "confidence"))),
            lambda l: F.struct(l["text"], l["bbox"], l["confidence"]),
        ).alias("items")
    )
    return pages, large


def lines_from_pages(pages: DataFrame, keys: Sequence[str], items: str = "items") -> DataFrame:
    return pages.select(*keys, F.posexplode(items).alias("line_no", "i")).select(
        *keys, "line_no", "i.text", "i.bbox", "i.confidence"
    )


# --- line tables ------------------------------------------------------------


def line_offsets(lines: DataFrame, keys: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """Add ``start`` and ``end`` of every line inside its page text."""
    return running_rows(
        lines, keys, "line_no", {"start": ("sum", F.length("text").cast("long") + 1)}, chunk
    ).withColumn("end", F.col("start") + F.length("text"))


def join_spans_to_lines(
    detections: DataFrame,
    lines: DataFrame,
    keys: Sequence[str],
    bucket: int = 4096,
) -> DataFrame:
    """Map span detections to enclosing boxes by an interval join.

    ``lines`` carries ``start`` and ``end``.  Both sides are cut into character
    buckets, which turns the overlap condition into an equi-join and spreads a
    large page over many tasks.  A pair that meets in several buckets does no
    harm, since only minima and maxima are taken afterwards.
    """
    keys = list(keys)
    det_keys = [*keys, "detection_type", "start", "end", "confidence"]

    def bucketed(df: DataFrame) -> DataFrame:
        return df.withColumn(
            "_bucket",
            F.explode(
                F.sequence(
                    F.floor(F.col("start") / bucket),
                    F.floor(F.greatest(F.col("end") - 1, F.col("start")) / bucket),
                )
            ),
        )

    spans = bucketed(detections.select(*det_keys))
    pieces = bucketed(lines.select(*keys, "start", "end", "bbox", "confidence"))
    pieces = pieces.select(
        *keys,
        "_bucket",
        F.col("start").alias("_ls"),
        F.col("end").alias("_le"),
        F.col("bbox").alias("_lb"),
        F.col("confidence").alias("_lc"),
    )
    met = spans.join(pieces.hint("merge"), [*keys, "_bucket"]).filter(
        (F.col("start") < F.col("_le")) & (F.col("_ls") < F.col("end"))
    )
    return met.groupBy(*det_keys).agg(
        make_bbox(
            F.min("_lb.x1"), F.min("_lb.y1"), F.max("_lb.x2"), F.max("_lb.y2")
        ).alias("bbox"),
        F.min("_lc").alias("_lc"),
    ).select(
        *keys,
        "detection_type",
        "start",
        "end",
        "bbox",
        F.least("confidence", "_lc").alias("confidence"),
    )


def address_lines(
    lines: DataFrame,
    keys: Sequence[str],
    following: int = P.ADDRESS_FOLLOWING_LINES,
    gap_ratio: float = P.ADDRESS_GAP_RATIO,
    chunk: int = CHUNK,
) -> DataFrame:
    """Lines of address blocks; looks at ``following`` lines above each line."""
    return _address_lines(line_chunks(lines, keys, chunk), keys, following, gap_ratio)


def _address_lines(chunks: DataFrame, keys: Sequence[str], following: int, gap_ratio: float) -> DataFrame:
    def mark(text: Column) -> Column:
        return F.when(is_address_header(text), "h").when(is_stop_header(text), "b").otherwise("n")

    return address_lines_in_chunks(
        chunks, keys, mark, lambda above, box: _too_far(above, box, gap_ratio), following
    )


def structured_in_lines(
    lines: DataFrame, keys: Sequence[str], chunk: int = CHUNK
) -> DataFrame:
    """Structured hits over a line table, offsets counted in the page text.

    Equal to searching the joined page, but no page is ever gathered; see
    ``operators.chunks``.
    """
    return structured_in_chunks(line_chunks(lines, keys, chunk), keys)


def text_detections_in_lines(
    lines: DataFrame, keys: Sequence[str], chunk: int = CHUNK
) -> DataFrame:
    """Structured hits and address blocks of a line table as box detections.

    Pages of every size go the same way, in chunks of lines.
    """
    keys = list(keys)
    columns = [*keys, "detection_type", "bbox", "confidence"]
    chunks = line_chunks(lines, keys, chunk)
    mapped = join_spans_to_lines(structured_in_chunks(chunks, keys), line_rows(chunks, keys), keys)
    blocks = _address_lines(chunks, keys, P.ADDRESS_FOLLOWING_LINES, P.ADDRESS_GAP_RATIO)
    found = mapped.select(*columns).unionByName(blocks.select(*columns))
    return found.groupBy(*keys, "detection_type", "bbox").agg(
        F.max("confidence").alias("confidence")
    )
