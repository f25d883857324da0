"""Names and addresses: plug-in models, raw predictions and a phrase list."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.arrays import indexes, let
from veilspan.functions.text import _col, match_spans, strip
from veilspan.operators.chunks import line_chunks, line_rows, with_words_ahead
from veilspan.operators.detections import explode_rows
from veilspan.operators.lines import join_spans_to_lines, runs_line_semantics, text_detections_in_lines
from veilspan.operators.scan import CHUNK
from veilspan.schemas import (
    BOX_DETECTIONS,
    RAW_ENTITIES,
    SCORE_THRESHOLDS,
    TEXT_DETECTIONS,
)

# --- fixed values -----------------------------------------------------------
SEMANTIC_LABELS = ("person", "address")
# ----------------------------------------------------------------------------

#: Bits that tell which first words a phrase list has: 128 KB for a list of any length.
WORD_BITS = 1 << 20

#: What counts as a word of a phrase, unless told otherwise.
WORD = r"(?U)\w+"


def check_thresholds(thresholds: dict[str, float]) -> dict[str, float]:
    for label, value in thresholds.items():
        if not 0.0 <= value <= 1.0:
            raise ValueError(f"threshold for {label} must lie between 0 and 1")
    return thresholds


def recognizer_udf(load: Callable[[], Callable[[str], list[dict]]]):
    """Wrap a model as a column function ``text -> array of raw entities``.

    ``load`` runs once per Python worker and returns a function from one text
    to ``[{"label", "start", "end", "score"}, ..]``.  Blank texts are skipped.
    """

    @F.pandas_udf(RAW_ENTITIES)
    def recognize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = load()
        for texts in batches:
            yield texts.map(lambda t: predict(t) if t and t.strip() else [])

    return recognize


def accept_entities(
    raw: Column | str,
    person: float = SCORE_THRESHOLDS["person"],
    address: float = SCORE_THRESHOLDS["address"],
) -> Column:
    """Raw predictions of a text as detections: known labels, enough score."""
    check_thresholds({"person": person, "address": address})

    def accepted(e: Column) -> Column:
        label, score = F.lower(e["label"]), F.coalesce(e["score"], F.lit(1.0))
        enough = ((label == "person") & (score >= person)) | (
            (label == "address") & (score >= address)
        )
        return enough & (e["end"] > e["start"])

    return F.array_sort(
        F.transform(
            F.filter(_col(raw), accepted),
            lambda e: F.struct(
                e["start"].alias("start"),
                e["end"].alias("end"),
                F.lower(e["label"]).alias("detection_type"),
                F.coalesce(e["score"], F.lit(1.0)).alias("confidence"),
            ),
        )
    ).cast(TEXT_DETECTIONS)


def filter_raw_predictions(
    predictions: DataFrame,
    label: str = "label",
    score: str = "score",
    thresholds: dict[str, float] = SCORE_THRESHOLDS,
) -> DataFrame:
    """Rows of a raw-prediction table that reach the threshold of their label.

    Labels without a threshold are dropped; a missing score counts as 1.
    """
    check_thresholds(thresholds)
    needed = F.create_map(
        *(F.lit(v) for pair in thresholds.items() for v in pair)
    )[F.lower(label)]
    return predictions.filter(F.coalesce(F.col(score), F.lit(1.0)) >= needed)


def line_entities_to_boxes(
    items: Column | str, recognized: Column | str
) -> Column:
    """Per-line detections (``array<array<detection>>``) as box detections.

    Lines that are too long or blank are ignored whatever was recognised.
    """
    items, recognized = _col(items), _col(recognized)

    def line(item: Column, i: Column) -> Column:
        found = F.filter(
            F.get(recognized, i),
            lambda d: (d["start"] < F.length(item["text"])) & (d["end"] > 0),
        )
        return F.when(
            runs_line_semantics(item["text"]),
            F.transform(
                found,
                lambda d: F.struct(
                    d["detection_type"].alias("detection_type"),
                    item["bbox"].alias("bbox"),
                    F.least(d["confidence"], item["confidence"]).alias("confidence"),
                ),
            ),
        ).otherwise(F.array().cast(BOX_DETECTIONS))

    return F.flatten(F.transform(items, line))


def phrase_key(text: Column | str, word: str = WORD) -> Column:
    """Words of a phrase joined by single blanks."""
    return F.array_join(F.regexp_extract_all(_col(text), F.lit(word), F.lit(0)), " ")


def names_in_chunks(
    chunks: DataFrame, keys: Sequence[str], gazetteer: DataFrame, max_words: int = 3, word: str = WORD
) -> DataFrame:
    """Accepted names of line tables as detections with offsets in the page text.

    A chunk is searched with the first words after it, so a phrase over its end is found.
    """
    keys = list(keys)
    texts = with_words_ahead(chunks, keys, word, max_words - 1)
    found = filter_raw_predictions(
        gazetteer_entities(texts, [*keys, "base", "_length", "spots"], gazetteer, max_words, "text", word)
    ).filter(F.col("start") < F.col("_length"))
    # the end may lie in one of the pieces behind the body
    end = F.expr("element_at(filter(spots, p -> p.at < end), -1)")
    return found.select(
        *keys,
        F.col("label").alias("detection_type"),
        (F.col("base") + F.col("start")).alias("start"),
        (end["base"] + F.col("end") - end["at"]).alias("end"),
        F.coalesce("score", F.lit(1.0)).alias("confidence"),
    )


def names_in_single_lines(
    lines: DataFrame, keys: Sequence[str], gazetteer: DataFrame, max_words: int = 3, word: str = WORD
) -> DataFrame:
    """The second look: accepted names of short lines, each searched for itself."""
    key = [*keys, "line_no"]
    looked_at = lines.filter(runs_line_semantics("text")).select(*key, "text", "bbox", "confidence")
    found = filter_raw_predictions(gazetteer_entities(looked_at, [*key, "bbox", "confidence"], gazetteer, max_words, "text", word))
    return found.select(
        *keys,
        F.col("label").alias("detection_type"),
        "bbox",
        F.least(F.coalesce("score", F.lit(1.0)), "confidence").alias("confidence"),
    )


def detections_with_names(
    lines: DataFrame,
    keys: Sequence[str],
    gazetteer: DataFrame,
    max_words: int = 3,
    word: str = WORD,
    chunk: int = CHUNK,
) -> DataFrame:
    """All text detections of a line table as boxes, names of a phrase list included.

    Structured hits, address blocks, names in the page text and names in single lines;
    pages of every size go in chunks of lines.
    """
    keys = list(keys)
    columns = [*keys, "detection_type", "bbox", "confidence"]
    chunks = line_chunks(lines, keys, chunk)
    names = join_spans_to_lines(names_in_chunks(chunks, keys, gazetteer, max_words, word), line_rows(chunks, keys), keys)
    alone = names_in_single_lines(lines, keys, gazetteer, max_words, word)
    every = text_detections_in_lines(lines, keys, chunk).select(*columns).unionByName(names.select(*columns)).unionByName(alone)
    return every.groupBy(*keys, "detection_type", "bbox").agg(F.max("confidence").alias("confidence"))


def _word_bit(word: Column | str) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(WORD_BITS)).cast("int")


def first_words(phrases: DataFrame, gram: str) -> Column:
    """The first words of a phrase list as ``WORD_BITS`` bits, in one scalar subquery.

    A Spark job sets the bits, and a task gets the same ``WORD_BITS / 64`` numbers
    however long the list is.  Words that share a bit only let more runs through.
    """
    none = phrases.sparkSession.range(WORD_BITS // 64).selectExpr("cast(id AS int) AS at", "0L AS bits")
    bit = _word_bit(F.substring_index(gram, " ", 1))
    bits = (
        phrases.select(bit.alias("b"))
        .selectExpr("cast(b div 64 AS int) AS at", "shiftleft(1L, b % 64) AS bits")
        .unionByName(none)
        .groupBy("at")
        .agg(F.bit_or("bits").alias("bits"))
    )
    return bits.select(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "bits"))), lambda s: s["bits"])
    ).scalar()


def word_grams(
    texts: DataFrame,
    keys: Sequence[str],
    phrases: DataFrame,
    gram: str,
    max_words: int,
    text: str = "text",
    word: str = WORD,
) -> DataFrame:
    """``keys, start, end, gram``: the runs of words that may be one of ``phrases``.

    Each word is looked up among the first words of the list before any run is
    put together, so only runs that may match are built and moved.
    """
    keys = list(keys)
    ahead = let(
        match_spans(text, word),
        lambda spans: F.transform(
            indexes(spans), lambda i: F.slice(spans, i + 1, F.lit(max_words))
        ),
    )
    bit = _word_bit(F.col("d")[0]["match"])
    known = F.getbit(F.get(first_words(phrases, gram), F.floor(bit / 64).cast("int")), bit % 64)
    begun = explode_rows(texts, keys, ahead).filter(known == 1)
    runs = begun.select(*keys, "d", F.explode(F.sequence(F.lit(1), F.size("d"))).alias("_n"))
    return runs.select(
        *keys,
        F.col("d")[0]["start"].alias("start"),
        F.get("d", F.col("_n") - 1)["end"].alias("end"),
        F.array_join(F.transform(F.slice("d", F.lit(1), F.col("_n")), lambda s: s["match"]), " ").alias(gram),
    )


def gazetteer_entities(
    texts: DataFrame,
    keys: Sequence[str],
    gazetteer: DataFrame,
    max_words: int = 3,
    text: str = "text",
    word: str = WORD,
    salts: int = 8,
) -> DataFrame:
    """Find the phrases of ``gazetteer(phrase, label, score)`` in texts.

    Runs of words that may match meet the phrases in an equi-join.  Either side may
    be of any size and is far larger than the files it comes from, which is all
    that Spark's estimates know; so both are shuffled and sorted, and neither goes
    through the driver.  The runs of one phrase are dealt over ``salts`` tasks, as
    a phrase may stand in most texts; each phrase goes to all of them.  Offsets
    are those of the words in the text, which match the pattern ``word``.  A
    phrase of more than ``max_words`` words raises an error rather than being
    missed silently.
    """
    keys = list(keys)
    listed = gazetteer.select(
        phrase_key("phrase", word).alias("_gram"), F.lower("label").alias("label"), "score"
    ).filter(F.col("_gram") != "")
    words = F.size(F.split("_gram", " "))
    checked = listed.withColumn(
        "_gram",
        F.when(words <= max_words, F.col("_gram")).otherwise(
            F.raise_error(F.lit(f"a phrase has more than {max_words} words"))
        ),
    )
    runs = word_grams(texts, keys, checked, "_gram", max_words, text, word)
    dealt = runs.withColumn("_salt", F.pmod(F.xxhash64(*keys, "start"), F.lit(salts)).cast("int"))
    salted = checked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(salted.hint("merge"), ["_gram", "_salt"]).drop("_gram", "_salt")
