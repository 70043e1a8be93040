"""The 20 amino acids and columns over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Index order of the letters, and the three-letter names in that order.
LETTERS = "ARNDCQEGHILKMFPSTWYV"
NAMES = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split()
LETTER_OF = dict(zip(NAMES, "ARNDCQEGHILKMFPSTWYV", strict=True))


def aa_index(letter: Column) -> Column:
    """Place of a letter from 0; -1 for a gap, an empty string, a null or another letter."""
    return F.when(F.length(letter) == 1, F.instr(F.lit(LETTERS), letter) - 1).otherwise(-1).cast("int")


def aa_letter(index: Column) -> Column:
    """The letter of an index; null outside 0 to 19."""
    return F.when(index.between(0, 19), F.substring(F.lit(LETTERS), index + 1, F.lit(1)))


def letter_of_name(name: Column) -> Column:
    """One letter of a three-letter name; null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LETTER_OF.items() for x in pair]), F.upper(F.trim(name)))


def letters_table(spark):
    """aa, aa_idx: 20 rows."""
    return spark.range(20).select(F.substring(F.lit(LETTERS), (F.col("id") + 1).cast("int"), F.lit(1)).alias("aa"), F.col("id").cast("int").alias("aa_idx"))
