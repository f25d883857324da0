"""Pages of any length, searched in chunks of lines.

A page is a line table.  Its lines are gathered by chunk, a range of line numbers, and a
chunk is searched in its own row.  Three things reach over a chunk's ends, and each
comes from a short summary of the chunks around it, never from a whole page:

* labels of identity numbers, in the characters just before and after a chunk;
* marks of the lines above, for address blocks;
* hits that go on in later chunks.  Between its digits a number may have separators
  only, so it holds ``SOLID`` other characters at most.  A chunk looks that many of them
  ahead, over however many lines of separators they are spread.

Which hits count depends on where the search before them ended, and so on all hits
before: a hit is skipped if the one before it reaches into it.  Here every place where a
hit could start is listed first, whatever came before it.  A chunk's search is then a
function of the place at which the chunks before it ended.  Only ends of listed hits
that reach into the chunk can be that place, so the function is a small table, from each
such place to the end that the chunk hands on.  A run of chunks whose borders are
crossed composes these tables; every other chunk starts at its own beginning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspan.functions import patterns as P
from veilspan.functions.arrays import fresh_name, let, let_sql, running_sql, scanned_sql
from veilspan.functions.text import has_tckn_context_sql, is_valid_tckn_sql, match_spans_sql
from veilspan.operators.detections import add_once, explode_rows
from veilspan.operators.scan import CHUNK

#: Characters other than separators that a number can have: a prefix of four, a zero,
#: two brackets and ten digits.
SOLID = 17
#: An identity number with a separator between any two digits, and what a label may lie in.
_REACH = 2 * 11 + P.TCKN_CONTEXT_RADIUS

_LEAD = rf"(?U)^{P.SEPARATOR}*(?:[\d()+]{P.SEPARATOR}*){{0,{SOLID}}}"
_MARK = "\x01"


def line_chunks(lines: DataFrame, keys: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """Rows of ``_chunk`` with their lines as ``items``, ``body`` (the lines joined) and
    ``base``, the offset of the body in the page.

    ``line_no`` need not be dense; lines may be empty, and a null text is an empty line.
    """
    item = F.struct("line_no", F.coalesce("text", F.lit("")).alias("text"), "bbox", "confidence")
    # never null, so that both sides of a join over it read the same rows, and these once
    place = F.coalesce(F.floor(F.col("line_no") / chunk), F.lit(0))
    # chunks are few bytes and much work: a given number of partitions is not drawn together
    width = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.withColumn("_chunk", place).repartition(width, *keys, "_chunk")
    gathered = dealt.groupBy(*keys, "_chunk").agg(
        F.array_sort(F.collect_list(item)).alias("items")
    )
    body = F.array_join(F.transform("items", lambda i: i["text"]), "\n")
    return gathered.withColumn("body", body)


def _joined(chunks: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chunks and what belongs to each of them.

    Both have a row a chunk, and texts may be made of far smaller files, whose size is
    all that Spark's estimates know: neither side is to be broadcast.
    """
    return chunks.join(seen.hint("merge"), [*keys, "_chunk"])


def _with_neighbours(chunks: DataFrame, keys: Sequence[str], own: dict[str, Column], around: dict[str, Column]) -> DataFrame:
    """Add ``around``, computed over the ``own`` summaries of the chunks of a page.

    Only summaries are put side by side; bodies stay where they are.
    """
    keys = list(keys)
    summaries = chunks.select(*keys, "_chunk", *(c.alias(name) for name, c in own.items()))
    seen = summaries.select(*keys, "_chunk", *(c.alias(name) for name, c in around.items()))
    return _joined(chunks, seen, keys)


def _order(keys: Sequence[str], *more: str):
    return W.partitionBy(*keys, *more).orderBy("_chunk")


def with_offsets(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``base``, where the body starts in the page."""
    before = _order(keys).rowsBetween(W.unboundedPreceding, -1)
    base = F.coalesce(F.sum("_size").over(before), F.lit(0))
    return _with_neighbours(chunks, keys, {"_size": F.length("body").cast("long") + 1}, {"base": base})


def _with_surroundings(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``base``, the text just before and after, and the beginnings that a number may go on in."""
    radius = P.TCKN_CONTEXT_RADIUS
    own = {
        "_size": F.length("body").cast("long") + 1,
        "_tail": F.right("body", F.lit(radius)),
        "_head": F.left("body", F.lit(_REACH)),
        "_lead": F.regexp_extract("body", _LEAD, 0),
        "_solid": ~F.col("body").rlike(rf"(?U)^{P.SEPARATOR}*$"),
    }
    order = _order(keys)
    base = F.coalesce(F.sum("_size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # each chunk has one character at least, its line end
    before = F.array_join(F.collect_list("_tail").over(order.rowsBetween(-radius, -1)), "\n")
    after = F.array_join(F.collect_list("_head").over(order.rowsBetween(1, _REACH)), "\n")
    summaries = chunks.select(*keys, "_chunk", *(c.alias(name) for name, c in own.items())).select(
        *keys,
        "_chunk",
        base.alias("base"),
        F.when(base > 0, F.concat(F.right(before, F.lit(radius)), F.lit("\n"))).otherwise(F.lit("")).alias("_before"),
        F.when(F.lead(F.lit(True)).over(order), F.concat(F.lit("\n"), F.left(after, F.lit(_REACH)))).otherwise(F.lit("")).alias("_after"),
        "_solid",
        F.struct(base.alias("base"), F.col("_lead").alias("text"), (F.length("_lead") + 1 == F.col("_size")).alias("whole")).alias("_own"),
    )
    # a chunk of separators only is a longer gap and nothing else
    ahead = F.collect_list("_own").over(_order(keys, "_solid").rowsBetween(1, SOLID))
    # beyond a beginning that is not the whole chunk nothing can go on
    cut = F.when(
        F.exists("_ahead", lambda a: ~a["whole"]),
        F.expr("slice(_ahead, 1, array_position(transform(_ahead, a -> a.whole), false))"),
    ).otherwise(F.col("_ahead"))
    seen = summaries.withColumn("_ahead", ahead).withColumn("_ahead", F.filter(cut, lambda a: F.length(a["text"]) > 0))
    return _joined(chunks, seen.drop("_solid", "_own"), keys)


def _pieces_sql() -> str:
    """The body and the beginnings ahead with their place in the text that is searched.

    Where lines of separators lie between two pieces, two line ends stand for them.
    """
    gaps = (
        "transform(_ahead, (a, i) -> CASE WHEN a.base - CASE WHEN i = 0 THEN base + length(body)"
        " ELSE _ahead[i - 1].base + length(_ahead[i - 1].text) END > 1 THEN '\\n\\n' ELSE '\\n' END)"
    )
    return let_sql(
        gaps,
        lambda g: let_sql(
            running_sql(f"transform(_ahead, (a, i) -> length({g}[i]) + length(a.text))", "0", lambda a, b: f"{a} + {b}"),
            lambda sums: "concat(array(named_struct('at', 0, 'base', base, 'text', body)), transform(_ahead, (a, i) ->"
            f" named_struct('at', length(body) + {sums}[i] + length({g}[i]), 'base', a.base, 'text', concat({g}[i], a.text))))",
        ),
    )


def with_words_ahead(chunks: DataFrame, keys: Sequence[str], word: str, count: int) -> DataFrame:
    """Add ``base``, ``text`` (the body and the ``count`` words after it) and ``spots``, where
    each piece of the text stands in it and in the page."""
    first = F.regexp_extract("body", rf"(?s)^(?:.*?(?>{word})){{0,{count}}}", 0)
    words = F.regexp_count("body", F.lit(word))
    order = _order(keys)
    base = F.coalesce(F.sum("_size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = chunks.select(*keys, "_chunk", (F.length("body").cast("long") + 1).alias("_size"), first.alias("_first"), words.alias("_words"))
    placed = own.select(
        *keys, "_chunk", base.alias("base"), (F.col("_words") > 0).alias("_solid"),
        F.struct(base.alias("base"), F.col("_first").alias("text"), (F.col("_words") <= count).alias("whole")).alias("_own"),
    )
    # a chunk without words cannot be part of a phrase
    ahead = F.collect_list("_own").over(_order(keys, "_solid").rowsBetween(1, max(count, 1)))
    cut = F.when(
        F.exists("_ahead", lambda a: ~a["whole"]),
        F.expr("slice(_ahead, 1, array_position(transform(_ahead, a -> a.whole), false))"),
    ).otherwise(F.col("_ahead"))
    seen = placed.withColumn("_ahead", ahead).withColumn("_ahead", cut if count else F.slice("_ahead", 1, 0))
    joined = _joined(chunks, seen.drop("_solid", "_own"), keys)
    pieces = add_once(joined, _pieces=F.expr(_pieces_sql()))
    return pieces.select(
        *keys, "_chunk", "base", F.length("body").alias("_length"),
        F.transform("_pieces", lambda p: F.struct(p["at"].alias("at"), p["base"].alias("base"))).alias("spots"),
        F.array_join(F.transform("_pieces", lambda p: p["text"]), "").alias("text"),
    )


def listed_spans_sql(text: str, pattern: str) -> str:
    """``start``, ``end`` and ``match`` of every place where a match can start.

    Unlike ``match_spans_sql`` these may overlap.  Marks are put where a match starts,
    so the lengths between them give the offsets; ``text`` must not hold the mark.
    """

    def place(matches: str, pieces: str) -> str:
        starts = running_sql(f"transform({pieces}, p -> length(p))", "0", lambda a, b: f"{a} + {b}")
        return let_sql(
            starts,
            lambda before: f"transform({matches}, (m, i) -> named_struct('start', {before}[i + 1],"
            f" 'end', {before}[i + 1] + length(m), 'match', m))",
        )

    marked = f"split(regexp_replace({text}, r'(?={pattern})', '{_MARK}'), '{_MARK}', -1)"
    none = "cast(array() AS array<struct<start:int,end:int,match:string>>)"
    return let_sql(
        f"regexp_extract_all({text}, r'(?=({pattern}))', 1)",
        lambda matches: f"CASE WHEN size({matches}) > 0 THEN {let_sql(marked, lambda pieces: place(matches, pieces))} ELSE {none} END",
    )


def _unmarked(text: str) -> str:
    return let_sql(text, lambda t: f"CASE WHEN contains({t}, '{_MARK}') THEN translate({t}, '{_MARK}', '\x02') ELSE {t} END")


#: Hits that could start in a chunk, with their offsets in the page.
_LISTED = "array<struct<start:bigint,end:bigint,confidence:double>>"


def _listed_hits(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per chunk and type the hits that could start in its body, as ``listed``.

    A null confidence is that of a number that is no hit but hides others.
    """

    def real(n: str) -> str:
        return let_sql(
            f"element_at(filter(pieces, p -> p.at < {n}), -1)", lambda p: f"{p}.base + {n} - {p}.at"
        )

    def listed(pattern: str, guard: str, confidence: str) -> str:
        c = fresh_name()
        own = f"filter({listed_spans_sql('searched', pattern)}, {c} -> {c}.start < _length)"
        rows = (
            f"transform({own}, {c} -> named_struct('start', base + {c}.start, 'end', {real(f'{c}.end')},"
            f" 'confidence', {confidence.replace('CANDIDATE', c)}))"
        )
        return f"CASE WHEN searched RLIKE r'{guard}' THEN cast({rows} AS {_LISTED}) ELSE cast(array() AS {_LISTED}) END"

    start = "CANDIDATE.start + length(_before)"
    # the match is the same in both texts unless it reaches over lines of separators, which these numbers cannot
    labelled = has_tckn_context_sql("around", f"({start})", f"({start} + CANDIDATE.end - CANDIDATE.start)", P.TCKN_CONTEXT_RADIUS)
    tckn = f"CASE WHEN {is_valid_tckn_sql('CANDIDATE.match')} THEN 1.0D WHEN labels AND {labelled} THEN 0.95D END"
    mails = (
        f"CASE WHEN contains(body, '@') THEN cast(transform({match_spans_sql('body', P.EMAIL)}, m -> named_struct("
        f"'start', base + m.start, 'end', base + m.end, 'confidence', 1.0D)) AS {_LISTED}) ELSE cast(array() AS {_LISTED}) END"
    )
    placed = add_once(_with_surroundings(chunks, keys), pieces=F.expr(_pieces_sql()))
    prepared = add_once(
        placed,
        searched=F.expr(_unmarked("array_join(transform(pieces, p -> p.text), '')")),
        around=F.concat("_before", "body", "_after"),
    )
    # looked for once in a chunk, and only where there may be a number to label
    numbers = F.col("searched").rlike(P.TCKN_GUARD)
    # the length of a body takes a walk over it, so it is not taken again for every hit
    prepared = add_once(prepared, labels=numbers & F.col("around").rlike(P.TCKN_CONTEXT), _length=F.length("body"))
    kinds = F.array(
        *(
            F.struct(F.lit(kind).alias("detection_type"), F.expr(sql).alias("listed"))
            for kind, sql in (
                ("tckn", listed(P.TCKN_CANDIDATE, P.TCKN_GUARD, tckn)),
                ("phone", listed(P.PHONE, P.PHONE_GUARD, "1.0D")),
                ("email", mails),
            )
        )
    )
    next_base = (F.col("base") + F.length("body") + 1).alias("_next")
    rows = explode_rows(prepared.select("*", next_base), [*keys, "_chunk", "base", "_next"], kinds)
    return rows.select(*keys, "_chunk", "base", "_next", "d.detection_type", "d.listed").filter(F.size("listed") > 0)


def _end_after_sql(start: str, listed: str) -> str:
    """Where the search of a chunk ends that begins at ``start``."""
    return f"aggregate({listed}, {start}, (e, c) -> CASE WHEN c.start >= e THEN c.end ELSE e END)"


def structured_in_chunks(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Structured hits of the pages, with offsets in the page text."""
    keys = list(keys)
    groups = [*keys, "detection_type"]
    earlier = W.partitionBy(*groups).orderBy("_chunk").rowsBetween(-SOLID, -1)
    beyond = F.transform(F.filter("listed", lambda c: c["end"] > F.col("_next")), lambda c: c["end"])
    crossing = (
        _listed_hits(chunks, keys)
        .withColumn("_beyond", F.array_distinct(beyond))
        .withColumn("_reached", F.flatten(F.collect_list("_beyond").over(earlier)))
        .withColumn("_reached", F.array_distinct(F.filter("_reached", lambda e: e > F.col("base"))))
    )
    # tables of the chunks at crossed borders, composed page by page
    tables = crossing.filter((F.size("_beyond") > 0) | (F.size("_reached") > 0)).select(
        *groups,
        F.struct(
            "_chunk",
            F.col("base").alias("base"),
            F.concat(F.array("base"), "_reached").alias("starts"),
            F.expr(f"transform(concat(array(base), _reached), s -> {_end_after_sql('s', 'listed')})").alias("ends"),
        ).alias("t"),
    )
    step = lambda e, t: f"get({t}.ends, cast(array_position({t}.starts, greatest({e}, {t}.base)) - 1 AS int))"
    composed = tables.groupBy(*groups).agg(F.array_sort(F.collect_list("t")).alias("t"))
    handed = explode_rows(composed, groups, F.expr(f"arrays_zip(t, {scanned_sql('t', '0L', step)})"))
    starts = handed.select(*groups, F.col("d.t._chunk").alias("_chunk"), F.col("d.1").alias("_from"))
    # both sides are the same rows up to here, which are exchanged once
    placed = crossing.join(starts, [*groups, "_chunk"], "left").withColumn(
        "_from", F.when(F.size("_reached") > 0, F.col("_from")).otherwise(F.col("base"))
    )
    kept = F.expr(
        let_sql(
            scanned_sql("listed", "coalesce(_from, 0L)", lambda e, c: f"CASE WHEN {c}.start >= {e} THEN {c}.end ELSE {e} END"),
            lambda before: f"filter(listed, (c, i) -> c.start >= {before}[i] AND c.confidence IS NOT NULL)",
        )
    )
    hits = explode_rows(placed, groups, kept)
    return hits.select(*groups, "d.start", "d.end", "d.confidence")


def line_rows(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The lines again, with ``start`` and ``end`` in the page."""
    sizes = F.transform("items", lambda i: F.length(i["text"]) + 1)
    placed = with_offsets(chunks, keys).withColumn("_sizes", sizes)
    before = F.expr(running_sql("_sizes", "0", lambda a, b: f"{a} + {b}"))
    rows = placed.select(*keys, "base", F.inline(F.arrays_zip(F.col("items").alias("item"), before.alias("at"))))
    start = F.col("base") + F.col("at")
    return rows.select(*keys, "item.line_no", start.alias("start"), (start + F.length("item.text")).alias("end"), "item.bbox", "item.confidence")


def address_lines_in_chunks(chunks: DataFrame, keys: Sequence[str], mark, too_far, following: int) -> DataFrame:
    """Lines of address blocks.

    ``mark`` names a line by its text, and ``too_far`` tells whether a box is too far
    below another one.  A chunk sees the marks of ``following`` lines above it, and the
    box over these.
    """
    marked = F.transform("items", lambda i: F.struct(mark(i["text"]).alias("mark"), i["bbox"].alias("bbox")))

    def last(rows: str) -> Column:
        return F.slice(rows, F.greatest(F.size(rows) - following, F.lit(1)), F.lit(following + 1))

    earlier = F.flatten(F.collect_list("_last").over(_order(keys).rowsBetween(-following - 1, -1)))
    seen = _with_neighbours(
        chunks.withColumn("_marked", marked),
        keys,
        {"_last": last("_marked")},
        {"_above": earlier},
    ).withColumn("_above", last("_above"))

    def flags(rows: Column) -> Column:
        return F.transform(
            rows,
            lambda r, i: F.when((r["mark"] == "n") & (i > 0) & too_far(F.get(rows, i - 1)["bbox"], r["bbox"]), "b").otherwise(r["mark"]),
        )

    def inside(marks: Column, i: Column) -> Column:
        first = F.greatest(F.lit(0), i - following)
        return F.array_join(F.slice(marks, first + 1, i - first + 1), "").rlike("hn*$")

    skipped = F.size("_above")
    found = let(
        let(F.concat("_above", "_marked"), flags),
        lambda marks: F.filter(F.col("items"), lambda item, i: inside(marks, i + skipped)),
    )
    has_header = F.exists(F.concat("_above", "_marked"), lambda r: r["mark"] == "h")
    rows = explode_rows(seen, keys, F.when(has_header, found))
    return rows.select(*keys, "d.line_no", F.lit("address").alias("detection_type"), "d.bbox", "d.confidence")
