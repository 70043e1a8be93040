"""Quality rules by cross-document line frequency. Built-in functions only.

Lines are normalised (lower case, one space for white space, digits as 0) and hashed. A line that stands in too many
distinct documents of one host is boilerplate and is removed; a document left with too few of its words is depleted.
Exact copies are one document here: else a large group of copies would make all its lines boilerplate, and with its
copies the one that should stay would go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitscape.llm.shared import stored

BLANK = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A table of hot lines up to this many rows (8 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def _has_word(line: Column) -> Column:
    return F.length(F.translate(line, BLANK_CHARS, "")) > 0


def _tidy(text: Column) -> Column:
    """Of a whole text, line by line, or of a line: lower case, one space for white space and 0 for a digit; spaces at a line's ends stay."""
    return F.regexp_replace(F.translate(F.lower(text), "\t\x0b\x0c\r123456789", "    000000000"), " {2,}", " ")


def _line_hashes(text: Column) -> Column:
    """Of the lines with a word."""
    return F.transform(F.filter(F.split(_tidy(text), "\n"), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(F.trim(x)))


def _word_stats(docs: DataFrame, text: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, and the lines with a word as __own."""
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.expr("cast(array() as array<bigint>)")
    pairs = F.expr("cast(array() as array<struct<h:bigint,i:int>>)")
    bare = F.translate(body, BLANK_CHARS, "")
    same = lambda x, k: F.coalesce(x["h"] == F.get("__sorted", k)["h"], F.lit(False))
    return (
        docs.withColumn("__words", F.array_remove(F.split(body, BLANK), ""))
        .withColumn("__n_words", F.size("__words").cast("long"))
        .withColumn("__word_chars", F.length(bare).cast("long"))
        .withColumn("__n_symbols", (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"))
        .withColumn("__own", F.filter(F.split(body, "\n"), _has_word))
        .withColumn("__n_dup_lines", (F.size("__own") - F.size(F.array_distinct("__own"))).cast("long"))
        # hashes of 8 words by doubling: 1, 2, 4, 8
        .withColumn("__h1", F.transform("__words", lambda x: F.xxhash64(x)))
        .withColumn("__h2", F.transform("__h1", lambda x, i: F.xxhash64(x, F.get("__h1", i + 1))))
        .withColumn("__h4", F.transform("__h2", lambda x, i: F.xxhash64(x, F.get("__h2", i + 2))))
        .withColumn("__h8", F.when(F.col("__n_words") >= 8, F.slice(F.transform("__h4", lambda x, i: F.xxhash64(x, F.get("__h4", i + 4))), F.lit(1), F.greatest(F.size("__h4") - 7, F.lit(0)))).otherwise(none))
        .withColumn("__twice", F.size("__h8") > F.size(F.array_distinct("__h8")))
        .withColumn("__sorted", F.when(F.col("__twice"), F.sort_array(F.transform("__h8", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(pairs))
        .withColumn("__at", F.sort_array(F.transform(F.filter("__sorted", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
        .withColumn("__n_repeat_words", F.aggregate(F.transform("__at", lambda p, k: F.least(F.lit(8), F.coalesce(F.get("__at", k + 1) - p, F.lit(8)))), F.lit(0), lambda a, x: a + x).cast("long"))
        .drop("__words", "__h1", "__h2", "__h4", "__h8", "__twice", "__sorted", "__at")
    )


def hot_lines(docs: DataFrame, text_col: str, host_col: str, min_docs: int, max_share: float) -> DataFrame:
    """__host and __hot: hashes of the lines in more than min_docs distinct documents of the host and in more than max_share of these."""
    copy = F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("copy")
    # explode_outer: a filter inferred from explode would compute all hashes once more
    rows = docs.select(F.coalesce(host_col, F.lit("")).alias("__host"), copy, F.explode_outer(F.array_distinct(_line_hashes(F.col(text_col)))).alias("line"))
    hosts = docs.select(F.coalesce(host_col, F.lit("")).alias("__host"), copy).distinct().groupBy("__host").agg(F.count("*").alias("docs"))
    of_line = rows.filter("line is not null").distinct().groupBy("__host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > min_docs)
    hot = of_line.join(hosts, "__host").filter(F.col("n") > max_share * F.col("docs"))
    return stored(hot.groupBy("__host").agg(F.collect_list("line").alias("__hot")), "hot-lines")


def judged(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", min_docs: int = 20, max_share: float = 0.02, min_left: float = 0.3) -> DataFrame:
    """docs with a column __quality: the fields of line_quality() and clean_text, the text without its lines over the limit (null if the text is)."""
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_hot_words", "hot_lines", "clean_text")
    columns = [F.col(f"`{x}`").alias(f"c{k}") for k, x in enumerate(docs.columns)]
    rows = docs.select(*columns, F.coalesce(host_col, F.lit("")).alias("__host"), F.col(text_col).alias("__text"))
    hot = hot_lines(docs, text_col, host_col, min_docs, max_share)
    if (hot.agg(F.sum(F.size("__hot") + 1)).first()[0] or 0) <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    rows = _word_stats(rows, "__text").join(hot, "__host", "left")
    rows = rows.withColumn("__line", F.when(F.col("__hot").isNotNull(), _line_hashes(F.col("__text"))))
    rows = rows.withColumn("__found", F.when(F.arrays_overlap("__line", "__hot"), F.array_intersect("__line", "__hot")))
    at = F.array_compact(F.transform("__line", lambda h, i: F.when(F.array_contains("__found", h), i)))
    rows = rows.withColumn("__hot_lines", F.when(F.col("__found").isNotNull(), at))
    words = F.aggregate("__hot_lines", F.lit(0), lambda n, i: n + F.regexp_count(F.get("__own", i), F.lit(r"[^\x20\x09-\x0D]+")))
    rows = rows.withColumn("__n_hot_words", F.coalesce(words, F.lit(0)).cast("long"))
    rows = rows.withColumn("__base_failed", (F.col("__n_words") < 20) | (100 * F.col("__n_repeat_words") > 30 * F.col("__n_words")))
    left = F.col("__n_words") - F.col("__n_hot_words")
    rows = rows.withColumn("__kept", ~F.col("__base_failed") & (left >= min_left * F.col("__n_words")))
    stays = lambda x: ~(_has_word(x) & F.array_contains("__found", F.xxhash64(F.trim(_tidy(x)))))
    rows = rows.withColumn("__clean_text", F.when(F.col("__found").isNull(), F.col("__text")).otherwise(F.array_join(F.filter(F.split("__text", "\n"), stays), "\n")))
    return rows.select(*[F.col(f"c{k}").alias(x) for k, x in enumerate(docs.columns)], F.struct(*[F.col(f"__{x}").alias(x) for x in fields]).alias("__quality"))


def line_quality(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 20, max_share: float = 0.02, min_left: float = 0.3
) -> DataFrame:
    """One row for each row of docs: its id, counts of words and lines, base_failed, kept, n_hot_words, hot_lines and clean_text.

    A line is over the limit if more than min_docs distinct documents of its host have it, and more than max_share of
    them; exactly as many aren't enough. clean_text is the text without these lines. Below the share min_left of its
    words a document is depleted, and kept is false. Null texts count as empty and fail; null hosts count as one host '';
    a null id is returned as it is; repeated rows each get their row; exact copies are one document; very long texts are
    counted like others; an empty table gives none. Extra columns of docs are ignored. hot_lines are positions (from 0)
    among the lines with a word, null if there is none.
    """
    found = judged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("source")), min_docs=min_docs, max_share=max_share, min_left=min_left)
    return found.select("doc_id", "__quality.*")
