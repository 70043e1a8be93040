"""Queries of the readers and sinks on lines made from the given tables, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitscape.functions.alphabet import LETTERS, NAMES
from fitscape.operators import splits
from fitscape.operators.checkpoints import with_checkpoints
from fitscape.plans import carriers as c
from fitscape.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = c.with_carriers(sql)
        return f

    return register


#: What the header is, in SQL; a document's own lines may be headers as well.
HEAD = r"regexp_matches(value, '^[ \t\r]*>')"


@query(f"""with lines as (select family_id, doc_id * {1 << 31} + i as line, parts[i] as value from (select lang as family_id, doc_id, string_split(concat('>', doc_id, ' ', source, chr(10), text), chr(10)) as parts from documents where text is not null) d,
 unnest(range(1, len(parts) + 1)) t(i)), records as (select *, sum(case when {HEAD} then 1 else 0 end) over (partition by family_id order by line) as record from lines)
select family_id, rtrim(replace(regexp_replace(max(value) filter ({HEAD}), '^[ \\t\\r]*>', ''), chr(13), '')) as seq_id, record = 1 as is_query,
 coalesce(string_agg(replace(replace(replace(value, chr(13), ''), ' ', ''), chr(9), ''), '' order by line) filter (not {HEAD}), '') as raw from records where record > 0 group by family_id, record having seq_id != ''""")
def a2m_sequences(s, d):
    """Each document is a record, its lines the body; the documents of a language are one file."""
    docs = c.table(s, d, "documents").filter("text is not null")
    lines = docs.select(F.col("lang").alias("family_id"), "doc_id", F.posexplode(F.split(F.concat(F.lit(">"), "doc_id", F.lit(" "), F.coalesce("source", F.lit("")), F.lit("\n"), "text"), "\n")).alias("k", "value"))
    return readers.a2m_of_lines(lines.select("family_id", (F.col("doc_id") * (1 << 31) + F.col("k") + 1).alias("line"), "value"))


@query(r"select lang as family_id, concat('d', doc_id) as seq_id, regexp_replace(text, '[ \t\n\x0B\f\r]', '-', 'g') as raw from documents where length(text) > 0")
def stockholm_sequences(s, d):
    """S3: the documents of a language are one interleaved file; its k-th block has each document's k-th 60 characters."""
    docs = c.table(s, d, "documents").select("lang", "source", F.concat(F.lit("d"), "doc_id").alias("name"), "doc_id", F.regexp_replace("text", r"[ \t\n\x0B\f\r]", "-").alias("gapped"))
    note = F.concat(F.lit("#=GS "), "name", F.lit(" SO "), F.coalesce("source", F.lit("")))
    parts = F.transform(F.regexp_extract_all("gapped", F.lit("(?s).{1,60}"), F.lit(0)), lambda x: F.concat("name", F.lit("  "), x))
    lines = docs.select(F.col("lang").alias("family_id"), "doc_id", F.posexplode(F.concat(F.array(note), parts)).alias("k", "value"))
    return readers.stockholm_of_lines(lines.select("family_id", (F.col("k").cast("long") * (1 << 40) + F.col("doc_id")).alias("line"), "value"))


#: Atoms of each residue: name, alternative, occupancy, model, and the column of its coordinates.
ATOMS = [("N", " ", 1.0, 1, "n"), ("CA", "A", 0.4, 1, "n"), ("CA", "B", 0.6, 1, "ca"), ("C", " ", 1.0, 1, "c"), ("O", " ", 1.0, 1, "o"), ("CA", " ", 1.0, 2, "o")]
#: Each eleventh residue is of another chain.
CHAIN = "case when node % 11 = 10 then 'B' else 'A' end"


def _thousandths(x: Column) -> Column:
    return F.floor(x * 1000) / 1000


def atom_lines(s: SparkSession, d: str, fmt: str) -> DataFrame:
    """structure_id, line, value: the carriers' residues as a file of two models."""
    name = F.element_at(F.array(*map(F.lit, NAMES)), F.instr(F.lit(LETTERS), F.col("aa")))
    r = c.residues(s, d).select("structure_id", "node", name.alias("res"), F.expr(CHAIN).alias("chain"), "n", "ca", "c", "o")
    sides = [F.struct(F.lit(k + 1).alias("k"), F.lit(a).alias("name"), F.lit(alt).alias("alt"), F.lit(occ).alias("occ"), F.lit(m).alias("model"), F.transform(xyz, _thousandths).alias("xyz")) for k, (a, alt, occ, m, xyz) in enumerate(ATOMS)]
    a = r.select("structure_id", "node", "res", "chain", F.explode(F.array(*sides)).alias("a")).select("structure_id", "node", "res", "chain", "a.*")
    number = F.col("node") * len(ATOMS) + F.col("k")
    xyz = [F.get("xyz", F.lit(j)) for j in range(3)]
    if fmt == "mmcif":
        value = F.format_string(
            "ATOM %d C %s %s %s %s 1 %d ? %.3f %.3f %.3f %.2f 9.0 ? %d %s %s %s %d", number, "name", F.when(F.col("alt") == " ", ".").otherwise(F.col("alt")), "res", "chain", F.col("node") + 1, *xyz, "occ", F.col("node") + 26, "res", "chain", "name", "model"
        )
    else:
        value = F.format_string("ATOM  %5d  %-3s%s%s %s%4d    %8.3f%8.3f%8.3f%6.2f  9.00", number, "name", "alt", "res", "chain", F.col("node") + 26, *xyz, "occ")
    line = F.col("model").cast("long") * (1 << 32) + number
    whole = F.forall("xyz", lambda x: x.isNotNull()) & (F.size("xyz") == 3)
    lines = a.filter(whole).select("structure_id", line.alias("line"), value.alias("value"))
    ends = r.select("structure_id").distinct().select("structure_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("m"))
    return lines.unionByName(ends.select("structure_id", (F.col("m").cast("long") * (1 << 32) + (1 << 31)).alias("line"), F.lit("ENDMDL" if fmt == "pdb" else "#").alias("value")))


def _sql_xyz(column: str, name: str = "") -> str:
    cells = [f"floor({column}[{j}] * 1000) / 1000" for j in (1, 2, 3)]
    return f"[{', '.join(cells)}] as {name}" if name else ", ".join(f"{x} as {n}" for x, n in zip(cells, "xyz", strict=True))


def _sql_atom(k: int) -> str:
    name, alt, _, _, column = ATOMS[k]
    return f"select structure_id, node * {len(ATOMS)} + {k + 1} as atom_id, '{name}' as name, '{alt}' as altloc, {CHAIN} as chain, node + 26 as res_seq, {_sql_xyz(column)} from residues"


@query(" union all ".join(_sql_atom(k) for k in (0, 1, 3, 4)))
def mmcif_atoms(s, d):
    """Atoms of the first model, alternatives but the first left out."""
    return readers.atoms_of_lines(atom_lines(s, d, "mmcif"), "mmcif", no_altloc=True).select("structure_id", "atom_id", "name", "altloc", "chain", "res_seq", "x", "y", "z")


@query(_sql_atom(1) + f" where {CHAIN} = 'B'")
def pdb_atoms(s, d):
    """Fixed columns; alpha carbons of one chain, up to the first model's end."""
    return readers.atoms_of_lines(atom_lines(s, d, "pdb"), "pdb", ca_only=True, no_altloc=True, chain="B").select("structure_id", "atom_id", "name", "altloc", "chain", "res_seq", "x", "y", "z")


RESIDUES = f"select structure_id, row_number() over (partition by structure_id order by vec_id) - 1 as node, node + 26 as res_seq, aa, {', '.join(_sql_xyz(x, x) for x in ('ca', 'n', 'c', 'o'))} from residues where {CHAIN} = 'A'"


@query(RESIDUES)
def mmcif_residues(s, d):
    """Of alternatives the one of highest occupancy."""
    return readers.atoms_to_residues(readers.atoms_of_lines(atom_lines(s, d, "mmcif"))).withColumn("node", F.col("node").cast("long"))


@query(f"select structure_id, string_agg(aa, '' order by vec_id) as sequence from residues where {CHAIN} = 'A' group by 1")
def pdb_sequence(s, d):
    """The chain's letters."""
    return readers.residue_sequence(readers.atoms_to_residues(readers.atoms_of_lines(atom_lines(s, d, "pdb"), "pdb")))


@query(f"select vec_id as prop_id, substr('{LETTERS}', 1 + cast(k as int), 1) as aa, embedding[k + 1]::double as value from embeddings, range(20) t(k)")
def property_table(s, d):
    """A wide table with a column for each letter, and others."""
    letters = [F.get("embedding", F.lit(k)).alias(a) for k, a in enumerate(LETTERS)]
    return readers.property_rows(c.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(0).alias("-"), *letters, "label"))


@query("select o_orderkey::varchar as record, concat('part/', l_partkey) as subject, concat('line/', l_linenumber) as predicate, concat('supplier/', l_suppkey) as object from lineitem join orders on o_orderkey = l_orderkey")
def triples(s, d):
    """A file for each order; comment lines have too few fields."""
    x = c.table(s, d, "lineitem").join(c.table(s, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    line = F.format_string("<part/%d>\t<line/%d>\t<supplier/%d> .", "l_partkey", "l_linenumber", "l_suppkey")
    return readers.triples_of_lines(x.select(F.col("o_orderkey").cast("string").alias("record"), F.explode(F.array(line, F.lit("# no triple"))).alias("value")))


@query("select o_orderkey, o_orderstatus from orders")
def written_table(s, d):
    """A table written in parts of one key each, and read back."""
    path = f"{with_checkpoints(s)}/written-{uuid.uuid4().hex}"
    writers.write_table(c.table(s, d, "orders").select("o_orderkey", "o_orderstatus"), path, partition_by=["o_orderstatus"])
    return s.read.parquet(path)


@query(f"""select o_orderkey, split from orders join (select o_custkey, case when r <= floor(0.8::double * n) then 'train' when r <= floor((0.8::double + 0.1::double) * n) then 'val' else 'test' end as split
 from (select o_custkey, row_number() over (order by md5(concat('1012:', o_custkey)), o_custkey::varchar) as r, count(*) over () as n from (select distinct o_custkey from orders))) using (o_custkey)""")
def cached_split(s, d):
    """Computed and written by the first use, read by the second."""
    path = f"{with_checkpoints(s)}/cached-{uuid.uuid4().hex}"
    build = lambda: splits.split_by_id(c.table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "split")
    writers.cached_table(s, path, build)
    return writers.cached_table(s, path, build)
