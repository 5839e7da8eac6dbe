"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a boolean expression that is true for a text to reject. ``rank_rules`` estimates each
rule's cost and the share that it rejects on a bounded sample, and the cascade evaluates the
rules in the order of rejections per cost; a text stops at the first rule that rejects it. The
order changes cost, never the verdict: ``kept`` is true when no rule rejects.

``quality_filter`` measures every text and judges by the measures; ``screen`` returns the verdict
alone and measures a text only as far as the cascade gets, so that dear rules run last.

Null or blank text has no words and is rejected by the length rule. Repeated rows are judged
alike; very long texts count whole; an empty table gives no rows. Rules of equal rank are
ordered by name. Columns of the input stay, whatever their names; the measures, ``kept`` and
``rejected_by`` replace columns of those names.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestlens.llm.common import SPACE_CHARS, free_names, table, word_count, words
from harvestlens.llm.registry import query

SYMBOLS = "#*$%&|<>"  # fixed value: characters counted as symbols
_POSITION_BITS = 28


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def word_chars(text: Column) -> Column:
    return F.char_length(F.translate(text, SPACE_CHARS, "")).cast("long")


def symbol_count(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def repeated_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text.

    Windows are packed as (36 hash bits, position) and sorted as plain longs; neighbours
    with equal hash bits are candidates, and only those are compared as strings, so the
    count is exact. Covered words follow from the sorted positions: each window adds the
    words that the one before it doesn't hold.
    """
    window = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    starts = F.sequence(F.lit(0), F.size(w) - 3)
    packed = F.array_sort(
        F.transform(
            starts,
            lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), _POSITION_BITS).bitwiseOR(
                i.cast("long")
            ),
        )
    )
    return F.aggregate(
        F.array(packed),
        F.lit(0).cast("long"),
        lambda acc, s: acc + _covered(_repeats(s, window)),
    )


def _repeats(s: Column, window) -> Column:
    """Sorted starts of the windows that occur twice or more; ``s`` holds sorted packed windows."""
    bits = lambda x: F.shiftright(x, _POSITION_BITS)
    near = F.filter(
        s,
        lambda x, i: (bits(x) == bits(F.get(s, i - 1))) | (bits(x) == bits(F.get(s, i + 1))),
    )
    mask = (1 << _POSITION_BITS) - 1
    named = F.array_sort(
        F.transform(
            near,
            lambda x: F.struct(
                window(x.bitwiseAND(F.lit(mask)).cast("int")).alias("g"), x.bitwiseAND(F.lit(mask)).cast("int").alias("p")
            ),
        )
    )
    same = F.aggregate(
        F.array(named),
        F.array().cast("array<int>"),
        lambda acc, g: F.concat(
            acc,
            F.transform(
                F.filter(
                    g,
                    lambda x, i: (x["g"] == F.get(g, i - 1)["g"]) | (x["g"] == F.get(g, i + 1)["g"]),
                ),
                lambda x: x["p"],
            ),
        ),
    )
    return F.array_sort(same)


def _covered(positions: Column) -> Column:
    state = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        positions,
        state,
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
Measures = dict[str, Column]


def measure_columns(text: Column, w: Column) -> Measures:
    """The base measures of a text that isn't null and its words ``w``."""
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": word_chars(text),
        "n_symbols": symbol_count(text),
        "n_dup_lines": duplicate_lines(text),
        "n_repeat_words": F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(repeated_words(w)),
    }


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The base measures as columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    (w,) = free_names(df, "word_list")
    found = measure_columns(text, F.col(w))
    return df.withColumn(w, words(text)).select(
        *[F.col(f"`{c}`") for c in df.columns if c not in MEASURES], *[x.alias(n) for n, x in found.items()]
    )


def measured() -> Measures:
    """The measures as columns of a table that has them."""
    return {n: F.col(n) for n in MEASURES}


def unmeasured(text_col: str = "text") -> Measures:
    """The measures as expressions on the text, worked out where a rule asks for them."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    w = words(text)
    # the words are made once and then looked at by place
    repeated = F.transform(F.array(w), lambda x: measure_columns(text, x)["n_repeat_words"])[0]
    return measure_columns(text, w) | {"n_words": word_count(text), "n_repeat_words": repeated}


def base_rules(m: Measures | None = None, min_words: int = 50, repeat_percent: int = 50) -> list[Rule]:
    m = m or measured()
    return [
        Rule("too_short", m["n_words"] < min_words),
        Rule("repetitive", 100 * m["n_repeat_words"] > repeat_percent * m["n_words"]),
    ]


def page_rules(
    m: Measures | None = None,
    symbol_percent: int = 10,
    duplicate_line_percent: int = 50,
    word_length: tuple[int, int] = (2, 12),
    upper_percent: int = 40,
    separator_percent: int = 20,
    text_col: str = "text",
) -> list[Rule]:
    """Rules on symbols, repeated lines, word length, capitals and table separators."""
    m = m or measured()
    n, text = m["n_words"], F.col(f"`{text_col}`")
    letters = F.char_length(F.regexp_replace(text, r"[^\p{L}]", ""))
    capitals = F.char_length(F.regexp_replace(text, r"[^\p{Lu}]", ""))
    lines = F.size(F.split(text, "\n"))
    bars = F.char_length(text) - F.char_length(F.translate(text, "|", ""))
    return [
        Rule("symbols", 100 * m["n_symbols"] > symbol_percent * m["word_chars"]),
        Rule("duplicate_lines", 100 * m["n_dup_lines"] > duplicate_line_percent * lines),
        Rule("short_words", m["word_chars"] < word_length[0] * n),
        Rule("long_words", m["word_chars"] > word_length[1] * n),
        Rule("capitals", 100 * capitals > upper_percent * letters),
        Rule("table", 100 * bars > separator_percent * n),
    ]


def draw_sample(df: DataFrame, text_col: str, rows: int) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of the text from the whole table; ``2 * rows`` at most."""
    share = rows / max(df.count(), 1)
    if share >= 1:
        return df
    h = F.pmod(F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), F.lit(1_000_000_000))
    return df.filter(h < int(share * 1_000_000_000)).limit(2 * rows)


def rank_rules(sample: DataFrame, rules: list[Rule], repeats: int = 5) -> list[Rule]:
    """Rules by rejections per cost on ``sample``, best first.

    A rule's cost is the least of ``repeats`` runs of it alone, less that of a constant
    expression (starting a job doesn't count), rounded to a power of two of milliseconds, so
    that noise seldom changes the order. Equal ranks go by name; rules that reject nothing go last,
    cheap first.
    """
    sample = sample.persist()
    try:
        def timed(expr: Column) -> tuple[float, int]:
            best, hits = math.inf, 0
            for _ in range(repeats):
                began = time.perf_counter()
                hits = sample.agg(F.count_if(F.coalesce(expr, F.lit(False)))).first()[0]
                best = min(best, time.perf_counter() - began)
            return best, hits

        timed(F.lit(True))
        idle = timed(F.lit(True))[0]
        found = []
        for rule in rules:
            seconds, hits = timed(rule.rejects)
            cost = 2 ** round(math.log2(max(1000 * (seconds - idle), 8.0)))
            found.append((-hits / cost, cost, rule.name, rule))
    finally:
        sample.unpersist()
    return [x[-1] for x in sorted(found, key=lambda x: x[:3])]


def cascade(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``rejected_by`` (the first rule, in the order given, that rejects) and ``kept``.

    One CASE expression: rules after the first hit aren't evaluated. A rule that gives
    null doesn't reject.
    """
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects, F.lit(rule.name)).otherwise(verdict)
    keep = [F.col(f"`{c}`") for c in df.columns if c not in ("rejected_by", "kept")]
    return df.select(*keep, verdict.alias("rejected_by")).withColumn("kept", F.col("rejected_by").isNull())


def quality_filter(
    df: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", sample_rows: int = 2000
) -> DataFrame:
    """Measure every text and run the cascade, ordered on a sample of about ``sample_rows`` rows.

    The sample decides the order of evaluation only; every row is judged by every rule
    that it reaches.
    """
    rules = rules if rules is not None else base_rules() + page_rules(text_col=text_col)
    sample = measures(draw_sample(df, text_col, sample_rows), text_col)
    return cascade(measures(df, text_col), rank_rules(sample, rules))


def screen(df: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", sample_rows: int = 2000) -> DataFrame:
    """The verdict alone: ``rejected_by`` and ``kept`` without measures of what no rule asks for."""
    m = unmeasured(text_col)
    rules = rules if rules is not None else base_rules(m) + page_rules(m, text_col=text_col)
    return cascade(df, rank_rules(draw_sample(df, text_col, sample_rows), rules))


@query(
    "op1_quality_rules",
    oracle=r"""
    WITH d AS (
        SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents
    ), w AS (
        SELECT k, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
               list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
    ), g AS (
        SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w)
    ), r AS (
        SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM g) WHERE n > 1
    ), c AS (
        SELECT k, count(DISTINCT i + j) AS n FROM r, (SELECT unnest([0, 1, 2]) AS j) GROUP BY k
    ), m AS (
        SELECT w.k, doc_id, text, CAST(len(w) AS BIGINT) AS n_words,
               CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
               CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
               CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
               CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
               len(string_split(text, chr(10))) AS n_lines,
               length(text) - length(replace(text, '|', '')) AS bars,
               length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters,
               length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS capitals
        FROM w LEFT JOIN c ON w.k = c.k
    ), b AS (
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT (base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 50 * n_lines
                OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 100 * capitals > 40 * letters
                OR 100 * bars > 20 * n_words) AS kept
    FROM b
    """,
)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_filter(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *MEASURES, failed.alias("base_failed"), "kept")
