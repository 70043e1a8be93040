"""Threaded sequences, per-position frequencies and their statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitscape.functions.alphabet import LETTERS, aa_index
from fitscape.functions.arrays import bound
from fitscape.operators.family import family_slices, with_columns


def _threaded(rows: DataFrame, columns: DataFrame, made: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """What `made` gives for rows of one family, the nodes of the family's columns (a few thousand, in their order), the code point at each column and whether the text has one."""
    kept = columns.groupBy("family_id").agg(F.array_sort(F.collect_list(F.struct("match_column", "node"))).alias("_cols"))
    rows, known = with_columns(rows.select("family_id", "seq_id", "match_states"), kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, cols, text in family_slices(batches, "match_states", known, 1 << 20):
            at = cols.field("match_column").fill_null(-1).to_numpy(zero_copy_only=False)
            inside = np.flatnonzero((at >= 0) & (at < text.shape[1]))
            letters = text[:, at[inside]]
            size = pc.fill_null(pc.utf8_length(part.column("match_states")), 0).to_numpy(zero_copy_only=False)
            yield made(part, cols.field("node").take(pa.array(inside)), letters, at[inside] < size[:, None])

    return rows.mapInArrow(run, schema)


def _text_of(letters: np.ndarray) -> pa.Array:
    """A string of one character for each code point."""
    if letters.max(initial=0) < 128:
        return pa.StringArray.from_buffers(len(letters), pa.py_buffer(np.arange(len(letters) + 1, dtype=np.int32)), pa.py_buffer(letters.astype(np.uint8).tobytes()))
    return pa.array([chr(x) for x in letters.tolist()], pa.string())


def _index_of(letters: np.ndarray) -> np.ndarray:
    """Place of each code point among the 20 letters; -1 for others."""
    place = np.full(129, -1, np.int32)
    place[[ord(x) for x in LETTERS]] = np.arange(len(LETTERS))
    return place[np.minimum(letters, 128)]


def _kinds(rows: DataFrame, columns: DataFrame) -> tuple[str, str, str]:
    kinds = dict(rows.dtypes)
    return kinds["family_id"], kinds["seq_id"], dict(columns.dtypes)["node"]


def thread_arrays(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """family_id, seq_id, sites: an array of (node, aa, aa_idx; -1 at gaps) for the kept columns of match_states, in the columns' order."""
    family, seq, kind = _kinds(rows, columns)

    def made(part: pa.RecordBatch, nodes: pa.Array, letters: np.ndarray, has: np.ndarray) -> pa.RecordBatch:
        own = letters[has]
        sites = pa.StructArray.from_arrays([nodes.take(pa.array(np.nonzero(has)[1])), _text_of(own), pa.array(_index_of(own))], ["node", "aa", "aa_idx"])
        ends = np.r_[0, np.cumsum(has.sum(axis=1))].astype(np.int32)
        return pa.RecordBatch.from_arrays([part.column("family_id"), part.column("seq_id"), pa.ListArray.from_arrays(pa.array(ends), sites)], ["family_id", "seq_id", "sites"])

    return _threaded(rows, columns, made, f"family_id {family}, seq_id {seq}, sites array<struct<node: {kind}, aa: string, aa_idx: int>>")


def thread_indices(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """family_id, seq_id, nodes and letters (-1 at gaps): thread_arrays' node and aa_idx as two arrays, for sample_masks."""
    family, seq, kind = _kinds(rows, columns)

    def made(part: pa.RecordBatch, nodes: pa.Array, letters: np.ndarray, has: np.ndarray) -> pa.RecordBatch:
        ends = pa.array(np.r_[0, np.cumsum(has.sum(axis=1))].astype(np.int32))
        arrays = [pa.ListArray.from_arrays(ends, x) for x in (nodes.take(pa.array(np.nonzero(has)[1])), pa.array(_index_of(letters[has])))]
        return pa.RecordBatch.from_arrays([part.column("family_id"), part.column("seq_id"), *arrays], ["family_id", "seq_id", "nodes", "letters"])

    return _threaded(rows, columns, made, f"family_id {family}, seq_id {seq}, nodes array<{kind}>, letters array<int>")


def thread_sequences(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """family_id, seq_id, node, aa, aa_idx (-1 at gaps) for each kept column of match_states."""
    family, seq, kind = _kinds(rows, columns)

    def made(part: pa.RecordBatch, nodes: pa.Array, letters: np.ndarray, has: np.ndarray) -> pa.RecordBatch:
        row, col = np.nonzero(has)
        own, row = letters[has], pa.array(row)
        return pa.RecordBatch.from_arrays([part.column("family_id").take(row), part.column("seq_id").take(row), nodes.take(pa.array(col)), _text_of(own), pa.array(_index_of(own))], ["family_id", "seq_id", "node", "aa", "aa_idx"])

    return _threaded(rows, columns, made, f"family_id {family}, seq_id {seq}, node {kind}, aa string, aa_idx int")


def thread_counts(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """family_id, node, aa, aa_idx, n: the letters of thread_sequences' rows, summed within each slice of rows, for pssm_counts."""
    family, _, kind = _kinds(rows, columns)

    def made(part: pa.RecordBatch, nodes: pa.Array, letters: np.ndarray, has: np.ndarray) -> pa.RecordBatch:
        index, col = _index_of(letters), np.arange(letters.shape[1])
        seen = has & (index >= 0)
        n = np.bincount((col * len(LETTERS) + index)[seen], minlength=letters.shape[1] * len(LETTERS))
        some = np.flatnonzero(n)
        first = part.column("family_id").take(pa.array(np.zeros(len(some), np.int64)))
        which = (some % len(LETTERS)).astype(np.int32)
        return pa.RecordBatch.from_arrays([first, nodes.take(pa.array(some // len(LETTERS))), pa.array([LETTERS[x] for x in which.tolist()], pa.string()), pa.array(which), pa.array(n[some].astype(np.int64))], ["family_id", "node", "aa", "aa_idx", "n"])

    return _threaded(rows, columns, made, f"family_id {family}, node {kind}, aa string, aa_idx int, n long")


def thread_homologs(aligned: DataFrame, n_nodes: int) -> DataFrame:
    """family_id, seq_id, sites of align_to_reference's rows: each homolog by its own alignment, with a gap at every node of the structure that has none of its letters."""
    sites = bound(F.split("on_reference", ""), lambda letters: F.transform(F.sequence(F.lit(0), F.lit(n_nodes - 1)), lambda n: bound(F.get(letters, n), lambda x: F.struct(n.cast("long").alias("node"), x.alias("aa"), aa_index(x).alias("aa_idx")))))
    return aligned.select("family_id", "seq_id", sites.alias("sites"))


def pssm_counts(threaded: DataFrame, residues: DataFrame) -> DataFrame:
    """family_id, node, aa, n: letters seen, one more for the structure's own (residues: family_id, node, aa). Other letters don't count. threaded: a row for each letter, or rows with their number n (thread_counts)."""
    seen = threaded.filter("aa_idx >= 0").groupBy("family_id", "node", "aa").agg((F.sum("n") if "n" in threaded.columns else F.count("*")).alias("n"))
    own = residues.filter(aa_index(F.col("aa")) >= 0).select("family_id", "node", "aa", F.lit(1).cast("long").alias("n"))
    return seen.unionByName(own).groupBy("family_id", "node", "aa").agg(F.sum("n").alias("n"))


def pssm_frequencies(counts: DataFrame, residues: DataFrame, pseudocount: float = 1.0) -> DataFrame:
    """family_id, node, aa, aa_idx, freq, n_observed over the whole grid of nodes and letters."""
    grid = residues.select("family_id", "node").distinct().select("family_id", "node", F.explode(F.array(*[F.struct(F.lit(a).alias("aa"), F.lit(i).alias("aa_idx")) for i, a in enumerate(LETTERS)])).alias("x")).select("family_id", "node", "x.*")
    full = grid.join(counts, ["family_id", "node", "aa"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("family_id", "node")
    return full.select("family_id", "node", "aa", "aa_idx", ((F.col("n") + pseudocount) / (F.sum("n").over(w) + 20 * pseudocount)).alias("freq"), F.sum("n").over(w).alias("n_observed"))


def position_entropy(pssm: DataFrame) -> DataFrame:
    """family_id, node, entropy in bits; a frequency of 0 adds nothing."""
    return pssm.groupBy("family_id", "node").agg((-F.sum(F.when(F.col("freq") > 0, F.col("freq") * F.log2("freq")).otherwise(0.0))).alias("entropy"))


def consensus_recovery(pssm: DataFrame, residues: DataFrame) -> DataFrame:
    """family_id, n_nodes, n_recovered, share: nodes whose most frequent letter (first in alphabet order on ties) is the structure's."""
    top = pssm.groupBy("family_id", "node").agg(F.max_by("aa", F.struct("freq", -F.col("aa_idx"))).alias("consensus"))
    hit = (F.col("consensus") == F.col("aa")).cast("int")
    return top.join(residues.select("family_id", "node", "aa"), ["family_id", "node"]).groupBy("family_id").agg(F.count("*").alias("n_nodes"), F.sum(hit).alias("n_recovered"), F.avg(hit).alias("share"))


def coverage_stats(pssm: DataFrame) -> DataFrame:
    n = pssm.select("family_id", "node", "n_observed").distinct()
    return n.groupBy("family_id").agg(F.min("n_observed").alias("min_observed"), F.avg("n_observed").alias("mean_observed"), F.max("n_observed").alias("max_observed"))


def homolog_stats(homologs: DataFrame) -> DataFrame:
    """family_id, n, and min, mean, max of length and identity."""
    n = F.length("sequence")
    return homologs.groupBy("family_id").agg(
        F.count("*").alias("n"), F.min(n).alias("min_length"), F.avg(n).alias("mean_length"), F.max(n).alias("max_length"),
        F.min("percent_identity").alias("min_identity"), F.avg("percent_identity").alias("mean_identity"), F.max("percent_identity").alias("max_identity"),
    )


def histogram(df: DataFrame, column: str, by: str, bins: int = 50) -> DataFrame:
    """by, bin, n: equal widths from least to greatest value; the greatest is in the last bin; a single value is in bin 0. Nulls don't count."""
    ends = df.groupBy(by).agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    place = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col(column) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins))).otherwise(0)
    return df.filter(F.col(column).isNotNull()).join(ends, by).withColumn("bin", F.least(place, F.lit(bins - 1)).cast("long")).groupBy(by, "bin").agg(F.count("*").alias("n"))


def frequency_percentile(pssm: DataFrame, q: float) -> DataFrame:
    """Linear interpolation, as numpy's."""
    return pssm.groupBy("family_id").agg(F.percentile("freq", F.lit(q)).alias("percentile"))


