import gzip

import pytest
from pyspark.sql import functions as F

from fitscape.operators import family
from fitscape.sources import readers, writers


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_assay(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Ambler Position,WT AA,Mutant AA,Fitness,Estimated error in fitness\n26,H,A,0.5,0.1\n,H,A,0.5,0.1\n27,P,R,,\n")
    df = readers.read_assay(spark, str(tmp_path / "s.csv"), "single")
    assert got(df, "position", "wt_aa", "fitness") == [(26.0, "H", 0.5), (27.0, "P", None)]
    (tmp_path / "t.csv").write_text("Ambler Position,WT AA,Mutant AA,Fitness,Estimated error in fitness\n26,H,A,0.502826123456789,1.5e-05\n27,P,R,-2E+3,n/a\n")
    cells = readers.read_assay(spark, str(tmp_path / "t.csv"), "single")
    assert got(cells, "fitness", "fitness_err") == [(-2000.0, None), (0.502826123456789, 1.5e-05)]
    with pytest.raises(ValueError, match="kind"):
        readers.clean_assay(df, "triple")
    assert readers.clean_assay(df, "pair").columns == df.columns


def test_summary(spark, tmp_path):
    writers.write_table(spark.createDataFrame([("a", 3, 0.25), ("b", 1, None)], "model string, n long, rho double").coalesce(1), str(tmp_path / "s"), "json")
    lines = [x for p in (tmp_path / "s").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(lines) == ['{"model":"a","n":3,"rho":0.25}', '{"model":"b","n":1}']


def test_a2m(spark, tmp_path):
    (tmp_path / "f.a2m").write_text(">query one\nAC-d\nEF.\n>two\nA-\n\n>empty\n>last\nGG\n")
    df = readers.read_a2m(spark, str(tmp_path / "f.a2m"))
    assert got(df, "seq_id", "raw", "is_query") == [("empty", "", False), ("last", "GG", False), ("query one", "AC-dEF.", True), ("two", "A-", False)]
    columns = family.match_columns(df.filter("is_query"))
    assert got(columns, "col", "match_column", "residue") == [(0, 0, 0), (1, 1, 1), (2, 2, None), (4, 3, 3), (5, 4, 4)]


def test_a2m_of_lines(spark):
    text = {"f": "lost\n >query one\nAC-d\n\nEF.\n>two\nA- \t\n>empty\n>last\r\nGG\r", None: ">x\nA", "g": "no header", "h": ">\nAC\n>named\nD"}
    rows = [(f, k, x) for f, t in text.items() for k, x in enumerate(t.split("\n"))] + [("f", 99, None)]
    df = spark.createDataFrame(rows[::-1], "family_id string, line long, value string").withColumn("record", F.lit(7))
    assert got(readers.a2m_of_lines(df), "family_id", "seq_id", "raw", "is_query") == sorted(
        [("f", "query one", "AC-dEF.", True), ("f", "two", "A-", False), ("f", "empty", "", False), ("f", "last", "GG", False), (None, "x", "A", True), ("h", "named", "D", False)], key=repr
    )
    assert readers.a2m_of_lines(df.limit(0)).count() == 0


def test_lines_without_order(spark):
    lines = [(2, "a  GG"), (0, "a  AC"), (1, "//"), (3, None), (4, "# x"), (5, "b")]
    df = spark.createDataFrame([("f", *x) for x in lines], "family_id string, line long, value string")
    assert got(readers.stockholm_of_lines(df), "seq_id", "raw") == [("a", "ACGG")]
    atoms = spark.createDataFrame([("s", k, x) for k, x in enumerate([*PDB, None])][::-1], "structure_id string, line long, value string")
    assert got(readers.atoms_of_lines(atoms, "pdb"), "atom_id") == [(1,), (2,), (3,), (4,), (5,)]


def test_stockholm(spark, tmp_path):
    with gzip.open(tmp_path / "f.sto.gz", "wt") as f:
        f.write("# STOCKHOLM 1.0\n#=GF ID x\na/1-2  AC-\nb  .CD\n\na/1-2  GG\nb  HH\n//\n")
    assert got(readers.read_stockholm(spark, str(tmp_path / "f.sto.gz")), "seq_id", "raw") == [("a/1-2", "AC-GG"), ("b", ".CDHH")]


PDB = [
    "ATOM      1  N   HIS A  26      10.000  20.000  30.000  1.00 10.00           N",
    "ATOM      2  CA AHIS A  26      11.000  20.000  30.000  0.40 10.00           C",
    "ATOM      3  CA BHIS A  26      12.000  20.000  30.000  0.60 10.00           C",
    "ATOM      4  CA  PRO A  27      15.000  20.000  30.000  1.00 10.00           C",
    "ATOM      5  CA  PRO B  27      15.000  20.000  30.000  1.00 10.00           C",
    "HETATM    6  O   HOH A  99      15.000  20.000  30.000  1.00 10.00           O",
    "ENDMDL",
    "ATOM      7  CA  GLY A  28      15.000  20.000  30.000  1.00 10.00           C",
]


def test_pdb(spark, tmp_path):
    (tmp_path / "x.pdb").write_text("\n".join(PDB))
    atoms = readers.read_atoms(spark, str(tmp_path / "x.pdb"), "pdb")
    r = readers.atoms_to_residues(atoms)
    assert got(r, "node", "aa", "ca", "n") == [(0, "H", [12.0, 20.0, 30.0], [10.0, 20.0, 30.0]), (1, "P", [15.0, 20.0, 30.0], None)]
    assert readers.residue_sequence(r).first()["sequence"] == "HP"
    assert readers.read_atoms(spark, str(tmp_path / "x.pdb"), "pdb", ca_only=True, no_altloc=True, chain="A").count() == 2
    with pytest.raises(ValueError, match="fmt"):
        readers.read_atoms(spark, str(tmp_path / "x.pdb"), "xyz")


def test_mmcif(spark, tmp_path):
    line = "ATOM {i} C {n} {alt} HIS A 1 26 ? {x} 2.0 3.0 {occ} 9.0 ? 26 HIS A {n} {m}"
    rows = [line.format(i=1, n="CA", alt=".", x=1.0, occ=1.0, m=1), line.format(i=2, n="CA", alt=".", x=5.0, occ=1.0, m=2)]
    (tmp_path / "x.cif").write_text("data_x\nloop_\n" + "\n".join(rows) + "\n#\n")
    assert got(readers.atoms_to_residues(readers.read_atoms(spark, str(tmp_path / "x.cif"))), "node", "aa", "ca") == [(0, "H", [1.0, 2.0, 3.0])]


def test_properties_and_triples(spark, tmp_path):
    letters = "A,R,N,D,C,Q,E,G,H,I,L,K,M,F,P,S,T,W,Y,V"
    (tmp_path / "p.csv").write_text(f"id,-,{letters},description\nX1,0,{','.join(map(str, range(20)))},text\n")
    p = readers.read_properties(spark, str(tmp_path / "p.csv"))
    assert p.count() == 20 and p.filter("aa = 'V'").first()["value"] == 19.0
    (tmp_path / "CHAM.ttl").write_text("<s>\t<p>\t<o> .\nbad\n")
    assert got(readers.read_triples(spark, str(tmp_path / "CHAM.ttl")), "record", "subject", "predicate", "object") == [("CHAM", "s", "p", "o")]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    writers.write_table(df, str(tmp_path / "t"), partition_by=["k"])
    assert got(spark.read.parquet(str(tmp_path / "t")), "v", "k") == [(1, "a"), (2, "b")]
    built = []
    for _ in range(2):
        x = writers.cached_table(spark, str(tmp_path / "c"), lambda: built.append(1) or df)
        assert x.count() == 2
    assert built == [1]
