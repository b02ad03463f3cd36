"""Line-first quality rules, in DataFrame functions only.

Each line of a text is judged on its own: by its punctuation, as navigation and as
boilerplate. Failing lines go, repeats of a line go, and a document that loses too much
of its text goes as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingspark.llm.common import SPACES, WORD, let, spare

SYMBOLS = "#*$%&|<>"
WINDOW = 5
# Phrases of page furniture in the languages of the corpus; a line that has one is boilerplate.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "enable javascript", "licensed under", "lorem ipsum", "privacy policy", "subscribe to our", "terms of use",
    "alle rechte vorbehalten", "cookie-richtlinie", "javascript aktivieren", "datenschutzerklärung", "allgemeine geschäftsbedingungen",
    "tous droits réservés", "politique de confidentialité", "activer javascript", "conditions d'utilisation",
    "todos los derechos reservados", "política de privacidad", "habilitar javascript", "términos de uso",
)
#: What parts the entries of menus and breadcrumbs.
SEPARATORS = (" | ", " > ", " » ", " › ", " • ", " · ")
#: Ends of lines that lead on to another page.
LEADS_ON = ("...", "…", "»", "›")
#: Ends of sentences; a line of up to MENU_WORDS words without one is an entry of a menu.
SENTENCE_ENDS = ".!?:;,\"'”»)]"
MENU_WORDS = 3


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def symbol_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def repeated_window_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a ``width``-word window found twice or more in the text.

    Windows are compared by their 64-bit hash. Sorted with their positions, equal ones
    are neighbours; the positions of those, in order, cover words without double counts.
    """
    hashes = F.when(
        F.size(words) > width,
        F.transform(
            F.sequence(F.lit(1), F.size(words) - (width - 1)),
            lambda i: F.xxhash64(F.slice(words, i, F.lit(width))),
        ),
    )

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twin = lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | (x["h"] == F.get(s, i - 1)["h"])
            same = F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.lit(False)))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        add = lambda acc, p: F.struct(
            (acc["n"] + F.lit(width) - F.greatest(F.lit(0), acc["end"] - p)).alias("n"), (p + width).alias("end")
        )
        return F.aggregate(
            let(placed, positions), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), add, lambda acc: acc["n"]
        )

    return F.coalesce(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0)), F.lit(0)
    )


def line_fails(line: Column) -> Column:
    """Whether a line breaks a rule: punctuation, navigation or boilerplate.

    Punctuation: symbols in place of it, shouting, an end that leads on to another page.
    Navigation: a separator for every five words or more, or a few words without an end of a
    sentence. Boilerplate: a phrase of page furniture.
    """
    n = F.regexp_count(line, F.lit(WORD))
    bare = F.rtrim(F.translate(line, SPACES, " "))
    solid = F.length(F.translate(line, SPACES, ""))
    shouted = F.length(line) - F.length(F.translate(line, "!", ""))

    def judged(x: Column) -> Column:
        """By struct(n, bare): what more than one rule reads."""
        apart = F.lit(0)
        for mark in SEPARATORS:
            apart = apart + F.when(line.contains(mark), F.size(F.split(line, f"\\Q{mark}\\E", -1)) - 1).otherwise(0)
        leads = F.lit(False)
        for end in LEADS_ON:
            leads = leads | x["bare"].endswith(end)
        entry = (x["n"] <= MENU_WORDS) & ~F.contains(F.lit(SENTENCE_ENDS), F.right(x["bare"], F.lit(1)))
        return (
            (symbol_count(line) * 10 > solid)
            | ((shouted > 3) & (shouted * 3 > x["n"]))
            | (leads & (x["n"] <= 12))
            | (apart * 5 > x["n"])
            | entry
            | let(F.lower(line), lambda low: reduce(lambda a, p: a | F.contains(low, F.lit(p)), BOILERPLATE, F.lit(False)))
        )

    return let(F.struct(n.alias("n"), bare.alias("bare")), judged)


def clean_lines(docs: DataFrame, text_col: str = "text", most_lost: float = 0.5, most_repeats: float = 0.2, least_words: int = 10) -> DataFrame:
    """``docs`` with the measures, the cleaned text and the verdict of each row.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    cleaned, lost (share of the characters in words that went) and kept; input columns
    of those names are replaced. base_failed: under ``least_words`` words, or more than
    ``most_repeats`` of the words in repeated windows. kept: not base_failed, and lost
    is ``most_lost`` at most.

    Defined results: null and empty texts have no words, zeros, an empty cleaned text
    and are not kept. Other columns pass through, repeated rows stay as they are, an
    empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cleaned", "lost", "kept"]
    base = docs.drop(*[c for c in added if c in docs.columns and c != text_col])
    solid_lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def lines_of(lines: Column) -> Column:
        return F.struct(
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("dups"),
            F.array_join(F.filter(F.array_distinct(lines), lambda x: ~line_fails(x)), "\n").alias("cleaned"),
        )

    def words_of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n"), repeated_window_words(words).cast("long").alias("repeated")
        )

    lines, words, chars, symbols = spare(base, "lines", "words", "chars", "symbols")
    measured = base.withColumns(
        {
            lines: let(solid_lines, lines_of),
            words: let(word_array(text), words_of),
            chars: F.length(F.translate(text, SPACES, "")).cast("long"),
            symbols: symbol_count(text).cast("long"),
        }
    )
    n, repeated, cleaned = F.col(f"{words}.n"), F.col(f"{words}.repeated"), F.col(f"{lines}.cleaned")
    left = F.length(F.translate(cleaned, SPACES, ""))
    lost = F.when(F.col(chars) > 0, 1 - left / F.col(chars)).otherwise(F.lit(0.0))
    failed = (n < least_words) | (repeated > most_repeats * n)
    return measured.select(
        *[F.col(f"`{c}`") for c in base.columns],
        n.alias("n_words"),
        F.col(chars).alias("word_chars"),
        F.col(symbols).alias("n_symbols"),
        F.col(f"{lines}.dups").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        failed.alias("base_failed"),
        cleaned.alias("cleaned"),
        lost.alias("lost"),
        (~failed & (lost <= most_lost)).alias("kept"),
    )
