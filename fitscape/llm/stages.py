"""The stages of corpus_pipeline.py: (spark, docs, sf_dir) -> docs of the next stage."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitscape.llm.decontaminate import contaminated, searched
from fitscape.llm.line_quality import judged
from fitscape.llm.packing import pack_documents
from fitscape.llm.prefix_join import similar_components
from fitscape.llm.shared import table
from fitscape.llm.substring_dedup import parsed


#: Columns that stages know; they use no other names of a table.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")
_Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _own_names(stage: _Stage) -> _Stage:
    """A stage that returns the columns of docs: all but KNOWN have other names meanwhile, so none can clash with those that operators add."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = docs.toDF(*[x if x in KNOWN else f"extra{k}" for k, x in enumerate(docs.columns)])
        return stage(spark, plain, sf_dir).toDF(*docs.columns)

    return run


def _with_text(docs: DataFrame, columns: list[str], text: Column, changed: Column) -> DataFrame:
    """Rows with another text, and n_chars to match, where it changed."""
    out = docs.withColumn("__text", text).withColumn("__changed", changed)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("__changed"), F.length("__text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return out.withColumn("text", F.when(F.col("__changed"), F.col("__text")).otherwise(F.col("text"))).select(columns)


def _row_key(docs: DataFrame) -> Column:
    """Of the values of all columns: equal for repeated rows only, null ids and one id with several texts included."""
    return F.xxhash64(*[F.col(x).isNull() for x in docs.columns], *docs.columns)


@_own_names
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their lines over the limit; n_chars follows the text. Null and repeated ids are judged row by row, very long texts like others; an empty table gives none; other columns stay, whatever their names."""
    # a random column keeps the filter where it is: pushed down, it would compute all measures again, inside each other
    found = judged(docs).withColumn("__here", F.rand()).filter("__quality.kept and __here >= 0")
    return _with_text(found, docs.columns, F.col("__quality.clean_text"), F.col("__quality.hot_lines").isNotNull())


@_own_names
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the row with the smallest id (null ids last, then by the row's hash).

    Rows are told apart by all their columns, so several texts with one id, or without one, each have their component; of
    repeated rows one stays. Documents without words are linked with nothing and stay; an empty table gives none.
    """
    keyed = docs.withColumn("__row", _row_key(docs))
    of_row = similar_components(keyed, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id").distinct()
    ids = keyed.select("__row", "doc_id").distinct().join(of_row, "__row")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("x")).select(F.col("x.__row").alias("__row"))
    return keyed.join(first, "__row", "left_semi").dropDuplicates(["__row"]).select(docs.columns)


@_own_names
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that a document with a smaller id has.

    A text that loses nothing stays as it is, one that loses all goes; rows with a null id stay as they are; an empty
    table gives none.
    """
    cut = parsed(docs).filter("__cut.n_removed = 0 or __cut.n_removed < __cut.n_words")
    return _with_text(cut, docs.columns, F.col("__cut.kept_text"), F.col("__cut.n_removed") > 0)


@_own_names
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the test items, row by row: null and repeated ids are judged like others; an empty table gives none."""
    found = searched(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(~contaminated(F.col("__found.n_hit"), F.col("__found.n_words"))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null text is its end alone, very long texts are cut into full windows; an empty table gives none; other columns are ignored."""
    return pack_documents(docs)
