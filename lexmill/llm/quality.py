"""Line-first quality rules in DataFrame functions only.

Every line is judged by itself (punctuation, navigation, boilerplate); lines that fail are removed, and a document
goes if the removed lines held too much of its text or if it fails the base rules.

Null texts count as empty and fail (no words). Empty tables give empty results, repeated rows are judged each, and very long texts whole. Other columns of the input stay as
they are and may have any name but the operator's own results, which replace equal names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, boxed, documents, let, unboxed

#: Phrases of page furniture, lower case.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "enable javascript",
    "click here",
    "subscribe to our newsletter",
    "sign up for our newsletter",
    "lorem ipsum",
    "skip to content",
)


#: A sentence ends somewhere in the line, or the line breaks off at a mark.
SENTENCE_END = r"""[.!?…。！？؟।][\x22'”’»)\]]*(?:[\x20\x09-\x0D]|$)|[:;,]$"""


#: Marks between entries of a menu. Closing quotes aren't among them, as texts in French or German have those in every sentence.
BARS = "|›•·"


@dataclass(frozen=True)
class QualityRules:
    """Thresholds. Shares are of characters in words or of words; see the rules in `line_passes`."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_lost_share: float = 0.5
    min_words_unpunctuated: int = 4
    max_symbols_per_word: float = 0.3
    max_shouts_per_word: float = 0.3
    max_bars_per_word: float = 0.2
    max_boilerplate_line_words: int = 25


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]", ""))


def line_passes(line: Column, rules: QualityRules) -> Column:
    """One line's verdict; blank lines pass and weigh nothing."""

    def judged(stripped: Column) -> Column:
        def with_words(n: Column) -> Column:
            punctuated = stripped.rlike(SENTENCE_END) | (n < rules.min_words_unpunctuated)
            symbols = _count(stripped, r"#*$%&<>~^") > n * rules.max_symbols_per_word
            shouts = F.length(stripped) - F.length(F.regexp_replace(stripped, "!!", "!")) > n * rules.max_shouts_per_word
            bars = (n >= 4) & (_count(stripped, BARS) > n * rules.max_bars_per_word)
            furniture = (n <= rules.max_boilerplate_line_words) & F.lower(stripped).rlike("|".join(BOILERPLATE))
            return punctuated & ~symbols & ~shouts & ~bars & ~furniture

        return (stripped == "") | let(F.size(F.split(stripped, SPACE_CLASS)), with_words)

    return let(F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), judged)


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window found twice or more, first occurrences included.

    Windows are compared by a 64-bit hash over the three words' hashes. Equal windows become neighbours by sorting
    (hash, position), so that a text of equal lines costs n log n and not n squared.
    """

    def windows(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(h) - 2), lambda i: F.xxhash64(F.element_at(h, i), F.element_at(h, i + 1), F.element_at(h, i + 2))
        )

    def from_sorted(s: Column) -> Column:
        def twin(e: Column, k: Column) -> Column:
            other = lambda j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
            return other(k - 1) | other(k + 1)

        starts = F.sort_array(F.transform(F.filter(s, twin), lambda e: e["i"]))
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).cast("long").alias("n"), i.alias("last"))
        return F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), step, lambda acc: acc["n"])

    def counted(t: Column) -> Column:
        pairs = F.transform(t, lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i")))
        return F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0).cast("long")).otherwise(let(F.sort_array(pairs), from_sorted))

    # A start covers three words; from the one before it takes those past it: least(3, gap) each, and the first all three.
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(let(hashes, windows), counted))


def quality(df: DataFrame, text: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_share, cleaned_text and kept."""
    t = F.coalesce(F.col(text), F.lit(""))

    def facts(t: Column) -> Column:
        def with_parts(p: Column) -> Column:
            worded = F.filter(p["lines"], lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
            kept = F.filter(p["lines"], lambda x: line_passes(x, rules))
            return F.struct(
                F.size(p["words"]).cast("long").alias("n_words"),
                F.length(F.regexp_replace(t, SPACE_CLASS, "")).cast("long").alias("word_chars"),
                _count(t, r"#*$%&|<>").cast("long").alias("n_symbols"),
                let(worded, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
                repeated_words(p["words"]).alias("n_repeat_words"),
                F.array_join(kept, "\n").alias("cleaned_text"),
            )

        words = F.array_remove(F.split(t, SPACE_CLASS), "")
        return let(F.struct(F.split(t, "\n", -1).alias("lines"), words.alias("words")), with_parts)

    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "cleaned_text")
    # A generator of one row is evaluated once: a filter on its columns isn't pushed below it with a second evaluation.
    out = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in own], F.inline(F.array(let(t, facts))))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    kept_chars = F.length(F.regexp_replace(F.col("cleaned_text"), SPACE_CLASS, ""))
    out = out.withColumns({"base_failed": failed, "lost_share": F.coalesce(1 - kept_chars / F.nullif(F.col("word_chars"), F.lit(0)), F.lit(0.0))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= rules.max_lost_share))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("lost_share", 6).alias("lost_share")
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, with the failed lines removed from their text and n_chars counted anew.

    Null and empty texts go; nulls in other columns stay. Very long texts are judged whole, line by line; repeated rows are judged each and alike, and no row depends on
    another, so there are no ties. An empty table stays empty. Columns that are named as the operator's results keep their own values."""
    text = F.col("cleaned_text")
    return unboxed(quality(boxed(docs, "text")).filter("kept"), docs, text=text, n_chars=F.length(text).cast("long"))
