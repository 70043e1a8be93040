"""Family sequences: cleaning, identity filter, match columns, match states."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitscape.functions.alphabet import LETTERS
from fitscape.operators.align import align_to_reference, codes

#: Fixed value: queries that agree less with the structure are reported.
LEAST_IDENTITY = 0.9


def clean_sequences(raw: DataFrame) -> DataFrame:
    """family_id, seq_id, sequence: gaps out, upper case; empty ones and those with other letters go; of one id the last (by ord) stays."""
    s = raw.withColumn("sequence", F.upper(F.translate("raw", "-.", ""))).filter(F.col("sequence").rlike(f"^[{LETTERS}]+$"))
    return s.groupBy("family_id", "seq_id").agg(F.max_by("sequence", "ord").alias("sequence"))


def filter_by_identity(sequences: DataFrame, reference: str, lo: float = 0.4, hi: float = 0.99) -> DataFrame:
    """Aligned sequences with lo <= equal / mapped <= hi; those that map nothing go."""
    return align_to_reference(sequences, reference).filter(F.col("percent_identity").between(lo, hi))


def cap_records(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n records in file order."""
    return df.orderBy(order).limit(n)


def match_columns(query: DataFrame) -> DataFrame:
    """family_id, col, match_column (upper case or a gap '-', numbered from 0), residue (of upper-case letters; counted over all letters). query: one row a family, `raw`."""
    c = query.select("family_id", F.posexplode(F.split("raw", "")).alias("col", "ch")).filter("ch != ''")
    w = Window.partitionBy("family_id").orderBy("col")
    is_match, is_letter = F.col("ch").rlike("^[A-Z-]$"), F.col("ch").rlike("^[A-Za-z]$")
    c = c.withColumn("_m", F.sum(is_match.cast("int")).over(w) - 1).withColumn("_r", F.sum(is_letter.cast("int")).over(w) - 1)
    return c.filter(is_match).select("family_id", "col", F.col("_m").alias("match_column"), F.when(F.col("ch") != "-", F.col("_r")).alias("residue"), F.col("ch").alias("letter"))


def query_mapping(queries: DataFrame, reference: str) -> DataFrame:
    """family_id, residue, node, percent_identity, low_identity (below 0.9): each family's query record (family_id, raw), all its letters aligned on the structure's. Null queries have no rows."""
    letters = F.upper(F.regexp_replace("raw", "[^A-Za-z]", ""))
    own = align_to_reference(queries.select("family_id", letters.alias("sequence")), reference, id_col="family_id")
    at = own.select("family_id", F.posexplode("node_of").alias("residue", "node"), "percent_identity", (F.col("percent_identity") < LEAST_IDENTITY).alias("low_identity"))
    return at.filter("node >= 0").withColumn("residue", F.col("residue").cast("long"))


def column_map(query_columns: DataFrame, query_mapping: DataFrame) -> DataFrame:
    """Columns whose query residue is on the structure, renumbered: family_id, match_column, col, node, query_residue. query_mapping: family_id, residue, node."""
    j = query_columns.filter("residue is not null").join(query_mapping, ["family_id", "residue"])
    number = (F.row_number().over(Window.partitionBy("family_id").orderBy("col")) - 1).cast("int")
    return j.select("family_id", number.alias("match_column"), "col", "node", F.col("residue").alias("query_residue"))


def extract_match_states(msa: DataFrame, columns: DataFrame, min_coverage: float = 0.5) -> DataFrame:
    """family_id, seq_id, match_states (letters at the kept columns; others '-') and coverage (4 decimals), if it is at least min_coverage. columns: a few thousand rows a family."""
    kept = columns.groupBy("family_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("match_column", "col"))), lambda x: x["col"].cast("long")).alias("_cols"))
    s, known = with_columns(msa.select("family_id", "seq_id", F.upper("raw").alias("_text")), kept)
    letter = np.full(128, ord("-"), np.uint8)
    letter[[ord(x) for x in LETTERS]] = [ord(x) for x in LETTERS]

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, cols, text in family_slices(batches, "_text", known):
            cols = cols.fill_null(-1).to_numpy(zero_copy_only=False)
            inside = (cols >= 0) & (cols < text.shape[1])
            out = np.full((len(text), len(cols)), ord("-"), np.uint8)
            own = text[:, cols[inside]]
            out[:, inside] = np.where(own < 128, letter[np.minimum(own, 127)], ord("-"))
            share = 1 - (out == ord("-")).sum(axis=1) / len(cols)
            enough = np.flatnonzero(share >= min_coverage)
            some = part.take(pa.array(enough))
            joined = pa.StringArray.from_buffers(len(enough), pa.py_buffer((np.arange(len(enough) + 1) * len(cols)).astype(np.int32)), pa.py_buffer(out[enough].tobytes()))
            yield pa.RecordBatch.from_arrays([some.column("family_id"), some.column("seq_id"), joined, pa.array(share[enough])], ["family_id", "seq_id", "match_states", "_c"])

    kinds = dict(msa.dtypes)
    rows = s.mapInArrow(states, f"family_id {kinds['family_id']}, seq_id {kinds['seq_id']}, match_states string, _c double")
    return rows.select("family_id", "seq_id", "match_states", F.round("_c", 4).alias("coverage"))


def with_columns(rows: DataFrame, kept: DataFrame, limit: int = 1000) -> tuple[DataFrame, Broadcast | None]:
    """For family_slices: rows, and the `_cols` of each family (kept: a row each) as a broadcast table; of more than `limit` families they are joined to the rows instead."""
    some = kept.filter("family_id is not null").limit(limit + 1).toArrow()
    if some.num_rows > limit:
        return rows.join(kept, "family_id"), None
    cols = {k: pa.concat_arrays([x.values]) for k, x in zip(some.column("family_id").to_pylist(), some.column("_cols"), strict=True)}
    return rows, rows.sparkSession.sparkContext.broadcast(cols)


def family_slices(batches: Iterator[pa.RecordBatch], text: str, known: Broadcast | None = None, cells: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """Rows of one family, of like length, with the family's `_cols` (of `known`, else the rows' own) and their texts as code points, a row each, filled up by 0; at most `cells` of these but for a longer text. A null text is empty; a family that isn't known has no rows."""
    for batch in batches:
        size = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        family = pc.dictionary_encode(batch.column("family_id"), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((-size, family))
        low = 0
        while low < len(order):
            same = np.searchsorted(family[order], family[order[low]], "right")
            high = min(same, low + max(1, cells // max(1, int(size[order[low]]))))
            part = batch.take(pa.array(order[low:high]))
            low = high
            cols = part.column("_cols")[0].values if known is None else known.value.get(part.column("family_id")[0].as_py())
            if cols is not None:
                yield part, cols, _points(part.column(text))


def _points(texts: pa.Array) -> np.ndarray:
    """A row of code points for each text, filled up by 0; ASCII texts of one length are taken from Arrow's buffer as they are."""
    size = pc.binary_length(texts)
    ends = pc.min_max(size).as_py()
    if not texts.null_count and ends["min"] and ends["min"] == ends["max"]:
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + 2]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[0] + len(texts) * ends["min"]].reshape(len(texts), -1)
        if data.max() < 128:
            return data
    return codes([x or "" for x in texts.to_pylist()])[0]


def msa_summary(rows: DataFrame, raw: DataFrame, columns: DataFrame) -> DataFrame:
    """family_id, n_total, n_kept, mean_coverage, n_nodes."""
    total = raw.groupBy("family_id").agg(F.count("*").alias("n_total"))
    kept = rows.groupBy("family_id").agg(F.count("*").alias("n_kept"), F.avg("coverage").alias("mean_coverage"))
    nodes = columns.groupBy("family_id").agg(F.countDistinct("node").alias("n_nodes"))
    return total.join(kept, "family_id", "left").join(nodes, "family_id", "left").select("family_id", "n_total", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), "mean_coverage", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"))


def drop_query(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows but for each family's query record (family_id, seq_id)."""
    return rows.join(queries.select("family_id", "seq_id"), ["family_id", "seq_id"], "left_anti")


def query_records(msa: DataFrame) -> DataFrame:
    """Each family's first record by ord."""
    return msa.groupBy("family_id").agg(F.min_by("seq_id", "ord").alias("seq_id"), F.min_by("raw", "ord").alias("raw"))
