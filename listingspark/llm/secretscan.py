"""Secret scans: fixed patterns, and character Markov models of what looks random.

Two first-order Markov models over characters are counted, one from random strings and
one from ordinary identifiers. A token whose mean log-likelihood ratio per step favours
the random model is a further finding. All of it is DataFrame functions; the models are
one literal array of ratios.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingspark.llm.common import let, spare

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIDE = len(ALPHABET) + 1  # index 0 stands for any other character
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
WORDLIKE = r"[A-Za-z][A-Za-z_-]{7,}"
#: Documents and random strings, about, from which the models are counted.
SAMPLE = 20_000
#: Occurrences that each model's expectation counts as.
PRIOR = 4.0


def running(lengths: Column) -> Column:
    """Running sums of an array of whole numbers, by blocks of the root of its size."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)

    def within(xs: Column) -> Column:
        side = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(xs))).cast("int"))

        def by_block(side: Column) -> Column:
            blocks = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / side).cast("int"))
            sums = F.transform(blocks, lambda k: total(F.slice(xs, k * side + 1, side)))

            def placed(sums: Column) -> Column:
                before = F.transform(sums, lambda x, k: total(F.slice(sums, F.lit(1), k)))
                return let(before, lambda b: F.transform(xs, lambda x, i: F.get(b, F.floor(i / side).cast("int")) + total(F.slice(xs, F.floor(i / side).cast("int") * side + 1, i % side + 1))))

            return let(sums, placed)

        return let(side, by_block)

    return let(lengths, within)


def located(text: Column, pattern: str, value: int = 0) -> Column:
    """array<struct<start, stop, value>> of the leftmost non-overlapping matches.

    Start and stop count code points, stop is exclusive. The matches and the pieces of text
    between them, in turn, make up the text, so that running sums of their lengths place
    them; no match is searched for again. Of a match's groups ``value`` is its value.
    """
    kind = "array<struct<start:int,stop:int,value:string>>"

    def placed(hits: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), lambda p, i: F.length(p) + F.when(i > 0, F.length(F.get(hits, i - 1))).otherwise(0))
        held = lambda hit: hit if value == 0 else F.regexp_extract(hit, pattern, value)
        spans = F.zip_with(hits, running(gaps), lambda hit, at: F.struct(at.alias("start"), (at + F.length(hit)).alias("stop"), held(hit).alias("value")))
        return F.when(F.size(hits) > 0, spans).otherwise(F.array().cast(kind))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed).cast(kind)


def _codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.position(c, F.lit(ALPHABET)))


def sample_tokens(docs: DataFrame, text_col: str = "text", bound: int = SAMPLE) -> DataFrame:
    """(token, label) by the fixed patterns: 1 for their values, 0 for wordlike tokens.

    Values come from all documents. Wordlike tokens come from about ``bound`` documents,
    chosen by the hash of their text at a rate of ``bound`` over all rows.
    """
    text = F.col(text_col)
    # values of an assignment that are words themselves say nothing of randomness
    values = F.filter(
        F.concat(
            F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda x: x),
            F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)),
        ),
        lambda x: (F.length(x) >= 16) & x.rlike("[0-9]") & x.rlike("[A-Za-z]"),
    )
    random = docs.select(F.explode(values).alias("token"), F.lit(1).alias("label"))
    rate = max(1, docs.count() // bound)
    some = docs.filter(F.pmod(F.xxhash64(text), F.lit(rate)) == 0)
    plain = some.select(F.explode(F.regexp_extract_all(text, F.lit(WORDLIKE), F.lit(0))).alias("token"), F.lit(0).alias("label"))
    return random.unionAll(plain)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all character pairs, as one array of SIDE * SIDE.

    Counts are made by Spark; what comes to the driver is at most two tables of pairs.
    By the weight of ``PRIOR`` occurrences a pair's share leans on what its model expects
    anyway: of random strings any character alike, of identifiers the second character's
    share among all. So a first character that a model never saw still tells.
    """
    codes = samples.select("label", _codes(F.col("token")).alias("codes"))
    pairs = codes.select(
        "label",
        F.explode(
            F.when(
                F.size("codes") > 1,
                F.zip_with(
                    F.slice("codes", F.lit(1), F.size("codes") - 1),
                    F.slice("codes", F.lit(2), F.size("codes") - 1),
                    lambda a, b: a * SIDE + b,
                ),
            )
        ).alias("pair"),
    )
    n = [[0] * (SIDE * SIDE) for _ in range(2)]
    for label, pair, count in pairs.groupBy("label", "pair").count().collect():
        n[label][pair] += count

    def logs(counts: list[int], uniform: bool) -> list[float]:
        overall = [1.0 if uniform else sum(counts[b::SIDE]) + 0.5 for b in range(SIDE)]
        total = sum(overall)
        out = []
        for a in range(SIDE):
            row = counts[a * SIDE : (a + 1) * SIDE]
            out += [math.log((x + PRIOR * o / total) / (sum(row) + PRIOR)) for x, o in zip(row, overall, strict=True)]
        return out

    return [q - p for p, q in zip(logs(n[0], False), logs(n[1], True), strict=True)]


def mean_ratio(token: Column, ratios: Column) -> Column:
    """Mean log-likelihood ratio per step of a token; 0 under two characters."""

    def over(codes: Column) -> Column:
        total = F.aggregate(
            F.sequence(F.lit(0), F.size(codes) - 2),
            F.lit(0.0),
            lambda acc, i: acc + F.get(ratios, F.get(codes, i) * SIDE + F.get(codes, i + 1)),
        )
        return F.when(F.size(codes) > 1, total / (F.size(codes) - 1)).otherwise(0.0)

    return let(_codes(token), over)


def scan_secrets(docs: DataFrame, text_col: str = "text", samples: DataFrame | None = None, least_ratio: float = 0.5) -> DataFrame:
    """``docs`` with base_spans, random_spans and n_assign, n_access, n_hex.

    Spans are structs (kind, start, stop, value), ordered by start, then by kind as in
    ``KINDS``. random_spans are tokens of 20 characters and more, with a letter and a
    digit, outside every base span, whose mean ratio is ``least_ratio`` or more.
    ``samples`` (token, label 0 or 1) trains the models; without it, ``sample_tokens``.
    A token of few characters of either model alone has a ratio near 0.

    Defined results: null and empty texts have no spans. Other columns pass through,
    columns of the added names are replaced, repeated rows stay as they are, an empty
    table gives an empty result.
    """
    ratios = train(sample_tokens(docs, text_col) if samples is None else samples)
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    added = ["base_spans", "random_spans", "n_assign", "n_access", "n_hex"]
    base = docs.drop(*[c for c in added if c in docs.columns])
    assign, access, hex_, token, spans = spare(docs.drop(*[c for c in added if c in docs.columns]), "assign", "access", "hex", "token", "spans")
    found = base.withColumns(
        {
            assign: F.filter(located(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= 8),
            access: located(text, ACCESS),
            hex_: located(text, HEX),
            token: located(text, TOKEN),
        }
    )

    def named(column: str, kind: str) -> Column:
        return F.transform(
            column,
            lambda x: F.struct(
                x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), x["stop"].alias("stop"), x["value"].alias("value")
            ),
        )

    bases = F.array_sort(F.concat(named(assign, "assign"), named(access, "access"), named(hex_, "hex")))
    spanned = found.withColumn(spans, bases)
    free = lambda x: ~F.exists(spans, lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"]))
    mixed = lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]")
    randoms = F.filter(named(token, "random"), lambda x: mixed(x) & (mean_ratio(x["value"], table) >= least_ratio) & free(x))
    return spanned.select(
        *[F.col(f"`{c}`") for c in base.columns],
        F.col(spans).alias("base_spans"),
        randoms.alias("random_spans"),
        F.size(assign).cast("long").alias("n_assign"),
        F.size(access).cast("long").alias("n_access"),
        F.size(hex_).cast("long").alias("n_hex"),
    )


def joined(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ","
    )
