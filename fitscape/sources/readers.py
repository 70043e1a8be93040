"""Readers of assay sheets, alignments, structures, property tables and triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fitscape.functions.alphabet import LETTERS, letter_of_name
from fitscape.operators.ordering import running_sum

# Column names of the sheets.
_SINGLE = {"Ambler Position": "position", "WT AA": "wt_aa", "Mutant AA": "mut_aa", "Fitness": "fitness", "Estimated error in fitness": "fitness_err"}
_PAIR = {
    "Ambler Position": "position", "WT AA 1": "wt_aa_1", "WT AA 2": "wt_aa_2", "Mut AA 1": "mut_aa_1", "Mut AA 2": "mut_aa_2", "Double Mutant Fitness": "fitness",
    "Double Mutant Fitness Error": "fitness_err", "Mut 1 Fitness": "mut1_fitness", "Mut 1 Fitness Error": "mut1_err", "Mut 2 Fitness": "mut2_fitness",
    "Mut 2 Fitness Error": "mut2_err", "Epistasis": "epistasis",
}
_KEYS = {"single": ["position", "wt_aa", "mut_aa"], "pair": ["position", "wt_aa_1", "wt_aa_2"]}


def clean_assay(df: DataFrame, kind: str) -> DataFrame:
    """Renames a sheet's columns and drops rows with a null (or NaN) key; a sheet without a position column is returned as it is."""
    names = {"single": _SINGLE, "pair": _PAIR}.get(kind)
    if names is None:
        raise ValueError(f"kind must be single or pair, not {kind}")
    if "Ambler Position" not in df.columns:
        return df
    out = df.withColumnsRenamed(names)
    for c, t in out.dtypes:
        if c in ("position", "fitness", "fitness_err", "mut1_fitness", "mut1_err", "mut2_fitness", "mut2_err", "epistasis") and t == "string":
            out = out.withColumn(c, F.col(c).try_cast("double"))
    return out.na.drop(subset=_KEYS[kind])


def drop_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """n_before, n_after."""
    return before.agg(F.count("*").alias("n_before")).join(after.agg(F.count("*").alias("n_after")), F.lit(True))


def read_assay(spark: SparkSession, path: str, kind: str, fmt: str = "csv") -> DataFrame:
    """A sheet exported as CSV (with a header) or Parquet, cleaned."""
    reader = spark.read.option("header", True).csv if fmt == "csv" else spark.read.parquet
    return clean_assay(reader(path), kind)


def _lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """name (file), line (ascending within a file), value."""
    return spark.read.text(path).select(F.input_file_name().alias(name), F.monotonically_increasing_id().alias("line"), "value")


def read_a2m(spark: SparkSession, path: str) -> DataFrame:
    """family_id (file), seq_id (header line), raw (case and gaps kept), is_query (a file's first record). Text before the first header is dropped."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("family_id"), "value")
    # only a file's first record still has its '>'; text before the first header makes a chunk without one at its begin
    first = F.regexp_extract("value", r"^\s*>", 0) != ""
    rows = rows.select("family_id", first.alias("is_query"), F.regexp_replace("value", r"^\s*>", "").alias("value"))
    parts = F.split("value", "\n", 2)
    body = F.translate(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "\n\r \t", "")
    return rows.select("family_id", F.rtrim(F.translate(F.get(parts, F.lit(0)), "\r", "")).alias("seq_id"), body.alias("raw"), "is_query").filter("seq_id != ''")


def a2m_of_lines(lines: DataFrame) -> DataFrame:
    """read_a2m() for a table of lines: family_id, line (orders a family's lines), value. The number of headers up to a line, counted by ranges of lines, is its record; null values are skipped."""
    rows = lines.filter("value is not null").select("family_id", "line", "value").withColumn("_head", F.col("value").rlike(r"^[ \t\r]*>"))
    rows = running_sum(rows, F.col("_head").cast("int"), ["line"], ["family_id"], "record").filter("record > 0")
    body = F.when(~F.col("_head"), F.struct("line", F.translate("value", "\r \t", "").alias("part")))
    head = F.rtrim(F.translate(F.regexp_replace("value", r"^[ \t\r]*>", ""), "\r", ""))
    whole = rows.groupBy("family_id", "record").agg(F.max(F.when(F.col("_head"), head)).alias("seq_id"), F.array_sort(F.collect_list(body)).alias("parts"))
    return whole.filter("seq_id != ''").select("family_id", "seq_id", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("raw"), (F.col("record") == 1).alias("is_query"))


def read_stockholm(spark: SparkSession, path: str) -> DataFrame:
    """family_id (file), seq_id, raw: names with their gapped sequences. Compressed files are read by their suffix."""
    return stockholm_of_lines(_lines(spark, path, "family_id"))


def stockholm_of_lines(lines: DataFrame) -> DataFrame:
    """family_id, seq_id, raw of lines (family_id, line, value): blocks of an interleaved file are joined in order of their lines; annotations, end marks, blank and null lines go."""
    rows = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "//") & (F.trim("value") != ""))
    words = F.split(F.trim("value"), r"\s+")
    rows = rows.select("family_id", "line", F.get(words, F.lit(0)).alias("seq_id"), F.get(words, F.lit(1)).alias("part")).filter("part is not null")
    whole = rows.groupBy("family_id", "seq_id").agg(F.array_sort(F.collect_list(F.struct("line", "part"))).alias("parts"))
    return whole.select("family_id", "seq_id", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("raw"))


def read_atoms(spark: SparkSession, path: str, fmt: str = "mmcif", ca_only: bool = False, no_altloc: bool = False, chain: str | None = None) -> DataFrame:
    """atoms_of_lines() of files; structure_id is the file."""
    return atoms_of_lines(_lines(spark, path, "structure_id"), fmt, ca_only, no_altloc, chain)


def atoms_of_lines(lines: DataFrame, fmt: str = "mmcif", ca_only: bool = False, no_altloc: bool = False, chain: str | None = None) -> DataFrame:
    """structure_id, atom_id, name, altloc, res_name, chain, res_seq, ins, occupancy, x, y, z of the first model's ATOM rows of lines (structure_id, line, value).

    no_altloc keeps alternatives ' ' and 'A' only; mmCIF rows have the usual 21 fields; null lines are skipped.
    """
    if fmt == "mmcif":
        f = F.split(F.trim("value"), r"\s+")
        at = lambda k: F.get(f, F.lit(k))
        rows = lines.filter(F.col("value").startswith("ATOM ")).select(
            "structure_id", at(1).cast("int").alias("atom_id"), F.regexp_replace(at(3), '"', "").alias("name"), F.translate(at(4), ".", " ").alias("altloc"), at(5).alias("res_name"), at(18).alias("chain"),
            at(16).cast("int").alias("res_seq"), F.translate(at(9), "?", "").alias("ins"), at(13).cast("double").alias("occupancy"), *[at(k).cast("double").alias(c) for k, c in ((10, "x"), (11, "y"), (12, "z"))], at(20).alias("_model"),
        )
        model = rows.groupBy("structure_id").agg(F.min(F.col("_model").cast("int")).alias("_first"))
        rows = rows.join(model, "structure_id").filter(F.col("_model").cast("int") == F.col("_first")).drop("_model", "_first")
    elif fmt == "pdb":
        cut = lambda a, n: F.trim(F.substring("value", a, n))
        end = lines.filter(F.col("value").startswith("ENDMDL")).groupBy("structure_id").agg(F.min("line").alias("_end"))
        rows = lines.filter(F.col("value").startswith("ATOM  ")).join(end, "structure_id", "left").filter("_end is null or line < _end").select(
            "structure_id", cut(7, 5).cast("int").alias("atom_id"), cut(13, 4).alias("name"), F.substring("value", 17, 1).alias("altloc"), cut(18, 3).alias("res_name"), F.substring("value", 22, 1).alias("chain"),
            cut(23, 4).cast("int").alias("res_seq"), cut(27, 1).alias("ins"), F.expr("try_cast(trim(substring(value, 55, 6)) as double)").alias("occupancy"), *[cut(k, 8).cast("double").alias(c) for k, c in ((31, "x"), (39, "y"), (47, "z"))],
        )
    else:
        raise ValueError(f"fmt must be mmcif or pdb, not {fmt}")
    if ca_only:
        rows = rows.filter("name = 'CA'")
    if no_altloc:
        rows = rows.filter("altloc in (' ', 'A')")
    return rows if chain is None else rows.filter(F.col("chain") == chain)


def atoms_to_residues(atoms: DataFrame, chain: str = "A") -> DataFrame:
    """structure_id, node (from 0 in chain order), res_seq, aa and ca, n, c, o (arrays of 3; null if missing) of standard residues; of alternatives the one of highest occupancy, then the first."""
    a = atoms.filter(F.col("chain") == chain).withColumn("aa", letter_of_name(F.col("res_name"))).filter("aa is not null and name in ('CA', 'N', 'C', 'O')")
    w = Window.partitionBy("structure_id", "res_seq", "ins", "name").orderBy(F.desc_nulls_last("occupancy"), "atom_id")
    a = a.withColumn("_r", F.row_number().over(w)).filter("_r = 1").withColumn("xyz", F.array("x", "y", "z"))
    r = a.groupBy("structure_id", "res_seq", "ins").agg(F.min_by("aa", "atom_id").alias("aa"), F.min("atom_id").alias("_at"), *[F.max(F.when(F.col("name") == n, F.col("xyz"))).alias(n.lower()) for n in ("CA", "N", "C", "O")])
    return r.withColumn("node", F.row_number().over(Window.partitionBy("structure_id").orderBy("_at")) - 1).select("structure_id", "node", "res_seq", "aa", "ca", "n", "c", "o")


def residue_sequence(residues: DataFrame) -> DataFrame:
    """structure_id, sequence."""
    return residues.groupBy("structure_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "aa"))), lambda x: x["aa"]), "").alias("sequence"))


def property_rows(wide: DataFrame) -> DataFrame:
    """prop_id, aa, value of a table with an id and a column for each letter; other columns are ignored."""
    x = wide.select(F.col("id").alias("prop_id"), *[F.col(a).cast("double").alias(a) for a in LETTERS])
    return x.unpivot(["prop_id"], list(LETTERS), "aa", "value")


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    return property_rows(spark.read.option("header", True).csv(path))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """triples_of_lines() of files; record is the file's name without suffix."""
    return triples_of_lines(spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("record"), "value"))


def triples_of_lines(lines: DataFrame) -> DataFrame:
    """record, subject, predicate, object of tab-separated triples (record, value) that end with a full stop; angle brackets go, lines of fewer fields too."""
    t = lines.select("record", F.split(F.regexp_replace("value", r"\s*\.\s*$", ""), "\t").alias("f"))
    bare = lambda k: F.regexp_replace(F.trim(F.get("f", F.lit(k))), "^<|>$", "")
    return t.filter(F.size("f") >= 3).select("record", bare(0).alias("subject"), bare(1).alias("predicate"), bare(2).alias("object"))
