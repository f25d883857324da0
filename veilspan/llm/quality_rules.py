"""Quality rules that look at lines first, in column expressions.

Method: every line of a text is judged on its own: too many symbols, a piece of
navigation, a boilerplate phrase, or a fragment without closing punctuation.  Lines
that fail are removed, and a document is rejected if too much of its text was in them.
Beside this the whole text is measured, and a document of too few words, or one that
repeats too many of its word windows, fails at once.

Every text is one row from scan to result; nothing is shuffled.  Windows of words are
compared by 64-bit hashes within their text.  Most texts repeat none, which a distinct
count shows; only the others sort their windows to place the repetitions.

Rows: a null or empty text has no words and fails.  Repeated rows get equal results.
An empty table gives an empty result.  Other columns are not read and may have any
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
#: Most words in repeated windows, most symbols of a line, and most text in failed
#: lines, in percent.
MOST_REPEATED, MOST_SYMBOLS, MOST_LOST = 20, 10, 50
#: A line of fewer words needs closing punctuation.
FRAGMENT_WORDS = 4

#: Navigation labels that are a whole line, separators of link lists, boilerplate
#: phrases, and punctuation that closes a line.
NAVIGATION = (
    r"(?i)^(?:home|menu|main menu|search|log ?in|log ?out|sign ?in|sign ?up|register|next|previous|prev|back|back to top|top|close|skip to (?:main )?content"
    r"|read more|more|see all|view all|share|print|contact(?: us)?|about(?: us)?|sitemap|subscribe)[ .:>»]*\z"
)
SEPARATED = r"(?:[^|»›•·]*[|»›•·]){2}"
SEPARATED_WORDS = 12
BOILERPLATE = (
    r"(?i)(?:all rights reserved|cookie policy|uses? cookies|privacy policy|terms (?:of|and) (?:use|service|conditions)|copyright (?:©|\(c\)|[0-9]{4})"
    r"|enable javascript|javascript is (?:disabled|required)|licensed under|lorem ipsum|click here|subscribe to our)"
)
CLOSED = r"[.!?…:;。！？]['\")\]’”»]*\z"


def count_of(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are among ``characters``."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def line_fails(line: Column) -> Column:
    """Whether a line, stripped and not blank, fails one of the rules."""
    words = F.size(F.split(line, r"[\x20\x09-\x0D]+"))
    symbols = 100 * count_of(line, SYMBOLS) > MOST_SYMBOLS * F.length(line)
    navigation = line.rlike(NAVIGATION) | ((words <= SEPARATED_WORDS) & line.rlike(SEPARATED))
    fragment = (words < FRAGMENT_WORDS) & ~line.rlike(CLOSED)
    return symbols | navigation | line.rlike(BOILERPLATE) | fragment


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_lost: int = MOST_LOST) -> DataFrame:
    """Id, measures, ``base_failed``, ``kept`` and the ``cleaned`` text of each row."""
    text = F.col("_text")
    source = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # each explode of one element keeps a list from being made again wherever it is used
    split = source.select("*", F.explode(F.array(words_of(text))).alias("_words"), F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS))).alias("_lines"))
    hashed = split.select("*", F.explode(F.array(F.transform("_words", lambda w: F.xxhash64(w)))).alias("_hashes")).drop("_words")
    n = F.size("_hashes")
    window = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)]))
    windowed = hashed.select("*", n.alias("n_words"), F.explode(F.array(F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>")))).alias("_windows")).drop("_hashes")
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    placed = windowed.select("*", F.explode(F.array(F.when(repeats, placed).otherwise(none))).alias("_placed")).drop("_windows")
    twice = "filter(_placed, (x, k) -> coalesce(get(_placed, k - 1).h = x.h, false) OR coalesce(get(_placed, k + 1).h = x.h, false))"
    step = f"(s, i) -> named_struct('n', s.n + i + {WINDOW} - greatest(s.to, i), 'to', i + {WINDOW})"
    repeated = F.expr(f"aggregate(array_sort(transform({twice}, x -> x.i)), named_struct('n', 0L, 'to', 0), {step}).n")
    failing = F.aggregate(F.filter("_lines", lambda x: (x != "") & line_fails(x)), F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    length = F.aggregate("_lines", F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    measured = placed.select(
        id_col,
        "_text",
        F.col("n_words").cast("long").alias("n_words"),
        (F.length(text) - count_of(text, BLANKS)).cast("long").alias("word_chars"),
        count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
        F.size(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")).alias("_full"),
        F.size(F.array_distinct(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))).alias("_different"),
        repeated.alias("n_repeat_words"),
        failing.alias("_failing"),
        length.alias("_length"),
    )
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    cleaned = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~line_fails(F.btrim(x, F.lit(BLANKS))) | (F.btrim(x, F.lit(BLANKS)) == "")), "\n")
    return measured.select(
        id_col,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.col("_full") - F.col("_different")).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & (100 * F.col("_failing") <= most_lost * F.col("_length"))).alias("kept"),
        cleaned.alias("cleaned"),
    )
