"""Domain tables derived from the given tables, once in Spark and once as SQL: the given tables hold no proteins."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitscape.functions.alphabet import LETTERS
from fitscape.operators.assay import combine_assays, run_index_at_scale
from fitscape.operators.ordering import with_ordinal
from fitscape.operators.structure import atom_distances

NODES = 264
#: Successive order keys of one position.
KEYS = 57


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _letter(i: Column) -> Column:
    return F.substring(F.lit(LETTERS), (1 + i % 20).cast("int"), F.lit(1))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    pos = (F.lit(26) + F.floor(F.col("o_orderkey") / 57)).cast("long")
    return o.select(
        F.concat(F.lit("a"), (F.col("o_custkey") % 3).cast("string")).alias("assay_id"), F.col("o_orderkey").alias("ord"), pos.alias("position"), (F.col("o_totalprice") / 100000).alias("fitness"),
        (0.01 * (1 + F.col("o_custkey") % 10)).alias("fitness_err"), F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(1).alias("single"),
    )


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_orders() with assays of one block of KEYS * NODES order keys each, so that every order has a position in 26 to 25 + NODES."""
    size = KEYS * NODES
    block, pos = F.floor(F.col("ord") / size), F.lit(26) + F.floor(F.pmod(F.col("ord"), F.lit(size)) / KEYS)
    return _orders(spark, sf_dir).withColumn("assay_id", F.concat("assay_id", F.lit("-"), block.cast("string"))).withColumn("position", pos.cast("long"))


def raw_single(spark: SparkSession, sf_dir: str, orders=_orders) -> DataFrame:
    return orders(spark, sf_dir).filter("single = 1").select("assay_id", "ord", "position", _letter(F.col("position") * 7).alias("wt_aa"), _letter(F.col("ord")).alias("mut_aa"), "fitness", "fitness_err")


def raw_pair(spark: SparkSession, sf_dir: str, orders=_orders) -> DataFrame:
    o = orders(spark, sf_dir).filter("single = 0")
    return o.select(
        "assay_id", "ord", "position", _letter(F.col("position") * 7).alias("wt_aa_1"), _letter((F.col("position") + 1) * 7).alias("wt_aa_2"), _letter(F.col("ord")).alias("mut_aa_1"),
        _letter(F.floor(F.col("ord") / 20)).alias("mut_aa_2"), "fitness", "fitness_err", (F.col("fitness") * 0.5).alias("mut1_fitness"), (F.col("fitness_err") * 2).alias("mut1_err"),
        (F.col("fitness") * 0.25).alias("mut2_fitness"), (F.col("fitness_err") * 3).alias("mut2_err"), (F.col("fitness") * 0.25).alias("epistasis"),
    )


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all orders; idx is the position within the block, so gaps between order keys don't shift it."""
    idx = lambda x: x(spark, sf_dir, _blocks).withColumn("idx", F.col("position") - 26)
    return combine_assays(idx(raw_single), idx(raw_pair))


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index idx of each experiment is position 26 + idx; each fortieth is unaligned."""
    keys = _blocks(spark, sf_dir).select("assay_id", "single").distinct()
    idx = keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(NODES - 1))).alias("idx")).filter("idx % 40 != 39").withColumn("idx", F.col("idx").cast("long"))
    return idx.select("assay_id", "single", "idx", (F.col("idx") - F.floor(F.col("idx") / 40)).cast("long").alias("node"), _letter((F.col("idx") + 26) * 7).alias("wt_aa"))


def run_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all orders; idx is the index of the run of equal positions, over the whole assay."""
    return combine_assays(*(run_index_at_scale(x(spark, sf_dir), "position", "ord", ["assay_id"]) for x in (raw_single, raw_pair)))


def run_mapping(variants: DataFrame) -> DataFrame:
    """For run_variants(): each NODES successive runs of an experiment are on the structure once more, up to its last one; each fortieth is unaligned."""
    ends = variants.groupBy("assay_id", "single").agg(F.max("idx").alias("_last"))
    idx = ends.select("assay_id", "single", F.explode(F.sequence(F.lit(0).cast("long"), (F.floor(F.col("_last") / NODES) + 1) * NODES - 1)).alias("idx"))
    idx = idx.withColumn("_at", F.col("idx") % NODES).filter("_at % 40 != 39")
    return idx.select("assay_id", "single", "idx", (F.col("_at") - F.floor(F.col("_at") / 40)).cast("long").alias("node"), _letter((F.col("idx") + 26) * 7).alias("wt_aa"))


def run_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all orders; idx is the index of the run of equal positions, over the whole assay."""
    return combine_assays(*(run_index_at_scale(x(spark, sf_dir), "position", "ord", ["assay_id"]) for x in (raw_single, raw_pair)))


def run_mapping(variants: DataFrame) -> DataFrame:
    """For run_variants(): each NODES successive runs of an experiment are on the structure once more, up to its last one; each fortieth is unaligned."""
    ends = variants.groupBy("assay_id", "single").agg(F.max("idx").alias("_last"))
    idx = ends.select("assay_id", "single", F.explode(F.sequence(F.lit(0).cast("long"), (F.floor(F.col("_last") / NODES) + 1) * NODES - 1)).alias("idx"))
    idx = idx.withColumn("_at", F.col("idx") % NODES).filter("_at % 40 != 39")
    return idx.select("assay_id", "single", "idx", (F.col("_at") - F.floor(F.col("_at") / 40)).cast("long").alias("node"), _letter((F.col("idx") + 26) * 7).alias("wt_aa"))


def run_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all orders; idx is the index of the run of equal positions, over the whole assay."""
    return combine_assays(*(run_index_at_scale(x(spark, sf_dir), "position", "ord", ["assay_id"]) for x in (raw_single, raw_pair)))


def run_mapping(variants: DataFrame) -> DataFrame:
    """For run_variants(): each NODES successive runs of an experiment are on the structure once more, up to its last one; each fortieth is unaligned."""
    ends = variants.groupBy("assay_id", "single").agg(F.max("idx").alias("_last"))
    idx = ends.select("assay_id", "single", F.explode(F.sequence(F.lit(0).cast("long"), (F.floor(F.col("_last") / NODES) + 1) * NODES - 1)).alias("idx"))
    idx = idx.withColumn("_at", F.col("idx") % NODES).filter("_at % 40 != 39")
    return idx.select("assay_id", "single", "idx", (F.col("_at") - F.floor(F.col("_at") / 40)).cast("long").alias("node"), _letter((F.col("idx") + 26) * 7).alias("wt_aa"))


def family_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """family_id, node, aa: the structure's letter at each node, of each family."""
    fam = table(spark, sf_dir, "documents").select(F.col("lang").alias("family_id")).distinct()
    return fam.select("family_id", F.explode(F.sequence(F.lit(0), F.lit(NODES - 1))).alias("node")).select("family_id", "node", _letter((F.col("node") + 26) * 7).alias("aa"))


def _pieces(spark: SparkSession, sf_dir: str, kept: bytes, become: bytes, size: int, fill: bytes = b"") -> DataFrame:
    """The `kept` characters (ASCII, each written as `become` has it) of each document in successive pieces of one size, a row each; the last may be shorter, or is filled up by `fill`. seq_id is doc_id * 2 ** 20 + piece. A document without such characters has none."""
    # a small table may be one block of one file, which a single task would cut, align and mask
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("family_id"), "doc_id", "text").repartition("doc_id")
    written, others = bytes.maketrans(kept, become), bytes(x for x in range(256) if x not in kept)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                texts = [(x or b"").translate(written, others) for x in batch.column("text").cast(pa.binary()).to_pylist()]
                row, piece, raw = [], [], []
                for k, text in enumerate(texts):
                    parts = [text[x : x + size] for x in range(0, len(text), size)]
                    if parts and fill:
                        parts[-1] = parts[-1].ljust(size, fill)
                    row += [k] * len(parts)
                    piece += range(len(parts))
                    raw += parts
                at = pa.array(row, pa.int64())
                seq_id = pc.add(pc.multiply(batch.column("doc_id").cast(pa.int64()).take(at), 1 << 20), pa.array(piece, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("family_id").take(at), seq_id, seq_id, pa.array(raw, pa.binary()).cast(pa.string())], ["family_id", "seq_id", "ord", "raw"])

    return d.mapInArrow(cut, f"family_id {dict(d.dtypes)['family_id']}, seq_id long, ord long, raw string")


_BOTH_CASES = (string.ascii_lowercase + string.ascii_uppercase).encode()


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of 300 letters."""
    return _pieces(spark, sf_dir, _BOTH_CASES, _BOTH_CASES.upper().translate(bytes.maketrans(b"BJOU", b"DLNC")), 300)


def msa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of NODES letters and spaces; a space, and what a last piece lacks, is a gap."""
    return _pieces(spark, sf_dir, _BOTH_CASES + b" ", _BOTH_CASES.upper() + b"-", NODES, b"-")


def msa_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column but each seventh is kept; its node is its place."""
    fam = table(spark, sf_dir, "documents").select(F.col("lang").alias("family_id")).distinct()
    c = fam.select("family_id", F.explode(F.sequence(F.lit(0), F.lit(NODES - 1))).alias("col")).filter("col % 7 != 6")
    return c.select("family_id", (F.col("col") - F.floor(F.col("col") / 7)).cast("int").alias("match_column"), "col", F.col("col").alias("node"))


def _atoms() -> list[Column]:
    at = lambda k: F.array(*[(F.get("embedding", F.lit(k + j)).cast("double") * 10) for j in range(3)])
    return [_letter(F.col("vec_id")).alias("aa"), at(0).alias("ca"), at(3).alias("n"), at(6).alias("c"), at(9).alias("o")]


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each NODES successive embeddings are one structure, so structures stay small and their number grows with the table."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / NODES).alias("structure_id"), (F.col("vec_id") % NODES).cast("long").alias("node"), *_atoms(), "vec_id")


def label_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's embeddings are one structure, whole: it grows with the table, and its pairs with the square."""
    e = with_ordinal(table(spark, sf_dir, "embeddings"), ["vec_id"], ["label"], name="_n")
    return e.select(F.col("label").alias("structure_id"), (F.col("_n") - 1).alias("node"), *_atoms(), "vec_id")


def chosen_of(residues: DataFrame) -> DataFrame:
    return residues.filter("node % 9 = 4").select("structure_id", "node")


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_of(residues(spark, sf_dir))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("key"), F.col("vec_id").alias("node"), (F.col("vec_id") % 20).cast("int").alias("label"), F.transform(F.slice("embedding", 1, 20), lambda x: x.cast("double")).alias("logits"))


def response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return response_of(residues(spark, sf_dir))


def response_of(residues: DataFrame) -> DataFrame:
    """A stand-in for the elastic network's matrix with an exact formula: (1 + i % 3) / (1 + distance)."""
    d = atom_distances(residues)
    return d.select("structure_id", "i", "j", ((1 + F.col("i") % 3) / (1 + F.col("d_ca"))).alias("value"))


def both_responses(i: np.ndarray, a: tuple[np.ndarray, ...], j: np.ndarray, b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """response_of()'s values of residues i at points a to j at b, and of j to i."""
    d = [x - y for x, y in zip(a, b, strict=True)]
    far = 1 + np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    return (1 + i % 3) / far, (1 + j % 3) / far


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    h = F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 1)
    split = F.when(h < "c", "train").when(h < "e", "val").otherwise("test")
    base = o.select(
        F.concat(F.lit("a"), (F.col("o_custkey") % 3).cast("string")).alias("assay_id"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(1).alias("single"),
        F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("code"), (F.col("o_totalprice") / 100000).alias("target"), split.alias("split"), "o_custkey",
    )
    models = F.explode(F.array(F.struct(F.lit("a").alias("model"), F.lit(97).alias("m")), F.struct(F.lit("b").alias("model"), F.lit(31).alias("m"))))
    return base.withColumn("x", models).select("x.model", "assay_id", "ord", "single", "code", "target", "split", ((F.col("o_custkey") % F.col("x.m")) / F.col("x.m").cast("double") + 0.25 * F.col("target")).alias("prediction"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("trial"), F.col("event_type").alias("seed"), F.col("value").cast("double").alias("score"), F.col("event_id").alias("run"), (F.col("event_id") % 80).alias("best_epoch"),
        ((F.col("event_id") % 7) / 10.0).alias("gap"), (1000 + F.col("user_id") * 10).alias("n_params"), F.concat(F.lit("{"), F.col("user_id").cast("string"), F.lit("}")).alias("config"),
        F.when(F.col("event_id") % 50 == 0, "confirm").otherwise("search").alias("stage"),
    )


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prop_id (family), aa, value: thousands of each letter in the family's sequences."""
    seen = sequences(spark, sf_dir).select(F.col("family_id").alias("prop_id"), F.explode(F.split("raw", "")).alias("aa")).groupBy("prop_id", "aa").agg(F.count("*").alias("n"))
    grid = table(spark, sf_dir, "documents").select(F.col("lang").alias("prop_id")).distinct().select("prop_id", F.explode(F.split(F.lit(LETTERS), "")).alias("aa")).filter("aa != ''")
    return grid.join(seen, ["prop_id", "aa"], "left").select("prop_id", "aa", (F.coalesce("n", F.lit(0)) / 1000.0).alias("value"))


_L = f"'{LETTERS}'"


def labelled(sql: str) -> str:
    """The SQL on structures of whole labels."""
    return re.sub(r"\b(residues|dist|response)\b", r"label_\1", sql)


def labelled(sql: str) -> str:
    """The SQL on structures of whole labels."""
    return re.sub(r"\b(residues|dist|response)\b", r"label_\1", sql)


def labelled(sql: str) -> str:
    """The SQL on structures of whole labels."""
    return re.sub(r"\b(residues|dist|response)\b", r"label_\1", sql)


def _sql_letter(x: str) -> str:
    return f"substr({_L}, 1 + cast(({x}) % 20 as int), 1)"


def _sql_pieces(letters: str, size: int, piece: str) -> str:
    parts = f"select lang, doc_id, s, unnest(range(0, (length(s) + {size - 1}) // {size})) as k from (select lang, doc_id, {letters} as s from documents)"
    return f"select lang as family_id, doc_id * {1 << 20} + k as seq_id, doc_id * {1 << 20} + k as ord, {piece} as raw from ({parts})"


_ORDERS = """select concat('a', o_custkey % 3) as assay_id, o_orderkey as ord, 26 + o_orderkey // 57 as position, o_totalprice / 100000 as fitness,
 0.01::double * (1 + o_custkey % 10) as fitness_err, case when o_orderkey % 3 = 0 then 0 else 1 end as single from orders"""

#: Each carrier's SQL; later ones use earlier ones.
CTES = {
    "o": _ORDERS,
    "raw_single": f"select assay_id, ord, position, {_sql_letter('position * 7')} as wt_aa, {_sql_letter('ord')} as mut_aa, fitness, fitness_err from o where single = 1",
    "raw_pair": f"""select assay_id, ord, position, {_sql_letter('position * 7')} as wt_aa_1, {_sql_letter('(position + 1) * 7')} as wt_aa_2, {_sql_letter('ord')} as mut_aa_1, {_sql_letter('ord // 20')} as mut_aa_2,
 fitness, fitness_err, fitness * 0.5::double as mut1_fitness, fitness_err * 2 as mut1_err, fitness * 0.25::double as mut2_fitness, fitness_err * 3 as mut2_err, fitness * 0.25::double as epistasis from o where single = 0""",
    "idx_single": "select *, cast(sum(n) over (partition by assay_id order by ord) - 1 as bigint) as idx from (select *, case when position is not distinct from lag(position) over (partition by assay_id order by ord) then 0 else 1 end as n from raw_single)",
    "idx_pair": "select *, cast(sum(n) over (partition by assay_id order by ord) - 1 as bigint) as idx from (select *, case when position is not distinct from lag(position) over (partition by assay_id order by ord) then 0 else 1 end as n from raw_pair)",
    "variants": """select assay_id, ord, 1 as single, idx, concat_ws('_', wt_aa, position, mut_aa) as code, fitness, fitness_err, -111::double as epistasis, mut_aa as m1, null as m2, wt_aa as w1, null as w2, position from block_single
 union all select assay_id, ord, 0, idx, concat_ws('_', wt_aa_1, wt_aa_2, position, mut_aa_1, mut_aa_2), fitness, fitness_err, epistasis, mut_aa_1, mut_aa_2, wt_aa_1, wt_aa_2, position from block_pair""",
    "mapping": f"select assay_id, single, idx, idx - idx // 40 as node, {_sql_letter('(idx + 26) * 7')} as wt_aa from (select distinct assay_id, single from ob), (select range as idx from range({NODES})) where idx % 40 != 39",
    "placed": """select v.*, a.node as node_1, a.wt_aa as wt_1, case when v.single = 0 then b.node end as node_2, case when v.single = 0 then b.wt_aa end as wt_2 from variants v
 left join mapping a on a.assay_id = v.assay_id and a.single = v.single and a.idx = v.idx left join mapping b on b.assay_id = v.assay_id and b.single = v.single and b.idx = v.idx + 1""",
    "flagged": "select *, node_1 is not null as aligned, node_1 is not null and (coalesce(m1 != wt_1, false) or coalesce(node_2 is not null and m2 != wt_2, false)) as really from placed",
    "nodes": """select assay_id, ord, single, idx, code, fitness, case when node_1 is null or (single = 0 and node_2 is null) then []::bigint[] when single = 1 then [node_1] else [node_1, node_2] end as nodes from placed""",
    "letters": f"select range as aa_idx, substr({_L}, 1 + cast(range as int), 1) as aa from range(20)",
    "family_residues": f"select family_id, node, {_sql_letter('(node + 26) * 7')} as aa from (select distinct lang as family_id from documents), (select range as node from range({NODES}))",
    "sequences": _sql_pieces("translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'BJOU', 'DLNC')", 300, "substr(s, 300 * k + 1, 300)"),
    "msa": _sql_pieces("translate(upper(regexp_replace(text, '[^A-Za-z ]', '', 'g')), ' ', '-')", NODES, f"rpad(substr(s, {NODES} * k + 1, {NODES}), {NODES}, '-')"),
    "msa_columns": f"select family_id, col - col // 7 as match_column, col, col as node from (select distinct lang as family_id from documents), (select range as col from range({NODES})) where col % 7 != 6",
    "states": f"""select family_id, seq_id, s as match_states, round(c, 4) as coverage from (select family_id, seq_id, s, 1 - (length(s) - length(replace(s, '-', ''))) / (select count(*) from range({NODES}) where range % 7 != 6) as c
 from (select m.family_id, m.seq_id, string_agg(case when contains({_L}, substr(m.raw, 1 + cast(k.col as int), 1)) then substr(m.raw, 1 + cast(k.col as int), 1) else '-' end, '' order by k.col) as s from msa m join msa_columns k using (family_id) group by 1, 2)) where c >= 0.5""",
    "threaded": f"select s.family_id, s.seq_id, k.node, substr(s.match_states, 1 + cast(k.match_column as int), 1) as aa, cast(strpos({_L}, substr(s.match_states, 1 + cast(k.match_column as int), 1)) - 1 as int) as aa_idx from states s join msa_columns k using (family_id)",
    "counts": "select family_id, node, aa, cast(sum(n) as bigint) as n from (select family_id, node, aa, 1 as n from threaded where aa_idx >= 0 union all select family_id, node, aa, 1 from family_residues) group by 1, 2, 3",
    "pssm": """select family_id, node, aa, aa_idx, (n + 1.0::double) / (sum(n) over (partition by family_id, node) + 20.0::double) as freq, cast(sum(n) over (partition by family_id, node) as bigint) as n_observed
 from (select g.family_id, g.node, l.aa, l.aa_idx, coalesce(c.n, 0) as n from (select distinct family_id, node from family_residues) g cross join letters l left join counts c on c.family_id = g.family_id and c.node = g.node and c.aa = l.aa)""",
    "residues": f"""select vec_id // {NODES} as structure_id, vec_id % {NODES} as node, {_sql_letter('vec_id')} as aa, vec_id,
 {', '.join(f"[{', '.join(f'embedding[{k + j + 1}]::double * 10' for j in range(3))}] as {a}" for a, k in (('ca', 0), ('n', 3), ('c', 6), ('o', 9)))} from embeddings""",
    "chosen": "select structure_id, node from residues where node % 9 = 4",
    "dist": "select a.structure_id, a.node as i, b.node as j, "
    + ", ".join("sqrt(" + " + ".join(f"(a.{x}[{k}] - b.{x}[{k}]) * (a.{x}[{k}] - b.{x}[{k}])" for k in (1, 2, 3)) + f") as d_{x}" for x in ("ca", "n", "c", "o"))
    + " from residues a join residues b using (structure_id)",
    "response": "select structure_id, i, j, (1 + i % 3) / (1 + d_ca) as value from dist",
    "logits": "select vec_id as key, vec_id as node, cast(vec_id % 20 as int) as label, list_transform(embedding[1:20], lambda x: x::double) as logits from embeddings",
    "probs": "select *, list_transform(logits, lambda x: x - list_max(logits) - ln(list_sum(list_transform(logits, lambda y: exp(y - list_max(logits)))))) as lp from logits",
    "predictions": """select model, assay_id, ord, single, code, target, split, (c % m) / m::double + 0.25::double * target as prediction from (select concat('a', o_custkey % 3) as assay_id, o_orderkey as ord,
 case when o_orderkey % 3 = 0 then 0 else 1 end as single, concat('c', o_orderkey) as code, o_totalprice / 100000 as target, o_custkey as c,
 case when substr(md5(o_orderkey::varchar), 1, 1) < 'c' then 'train' when substr(md5(o_orderkey::varchar), 1, 1) < 'e' then 'val' else 'test' end as split from orders), (values ('a', 97), ('b', 31)) t(model, m)""",
    "runs": """select user_id as trial, event_type as seed, value::double as score, event_id as run, event_id % 80 as best_epoch, (event_id % 7) / 10.0::double as gap, 1000 + user_id * 10 as n_params, concat('{', user_id, '}') as config,
 case when event_id % 50 = 0 then 'confirm' else 'search' end as stage from events""",
    "properties": """select g.prop_id, l.aa, coalesce(c.n, 0) / 1000.0::double as value from (select distinct lang as prop_id from documents) g cross join letters l
 left join (select family_id, ch, count(*) as n from (select family_id, unnest(string_split(raw, '')) as ch from sequences) group by 1, 2) c on c.family_id = g.prop_id and c.ch = l.aa""",
    "zprops": "select prop_id, aa, (value - avg(value) over (partition by prop_id)) / stddev_pop(value) over (partition by prop_id) as value from properties",
    "parr": "select aa, list(value order by prop_id) as p from zprops group by aa",
}

# each block of orders has its own assays, see _blocks()
_SIZE = KEYS * NODES
CTES["ob"] = f"select concat(assay_id, '-', ord // {_SIZE}) as assay_id, ord, 26 + (ord % {_SIZE}) // {KEYS} as position, fitness, fitness_err, single from o"
for _kind in ("single", "pair"):
    CTES[f"block_{_kind}"] = CTES[f"raw_{_kind}"].replace("select assay_id, ord,", "select assay_id, ord, position - 26 as idx,", 1).replace("from o where", "from ob where")
# definitions come before their uses
_FIRST = ("o", "ob", "block_single", "block_pair")
CTES = {**{k: CTES[k] for k in _FIRST}, **{k: v for k, v in CTES.items() if k not in _FIRST}}

# runs over whole assays, see run_variants() and run_mapping(); structures of whole labels, see label_residues()
_run = lambda sql: re.sub(r"\b(variants|mapping|placed)\b", r"run_\1", sql)
CTES["run_variants"] = CTES["variants"].replace("block_", "idx_")
CTES["run_mapping"] = f"""select assay_id, single, idx, idx % {NODES} - (idx % {NODES}) // 40 as node, {_sql_letter('(idx + 26) * 7')} as wt_aa
 from (select assay_id, single, unnest(range(0, (max(idx) // {NODES} + 1) * {NODES})) as idx from run_variants group by 1, 2) where idx % {NODES} % 40 != 39"""
CTES["run_placed"] = _run(CTES["placed"])
CTES["run_flagged"] = _run(CTES["flagged"])
CTES["run_nodes"] = CTES["nodes"].replace("from placed", "from run_placed")
CTES["label_residues"] = CTES["residues"].replace(f"vec_id // {NODES} as structure_id, vec_id % {NODES} as node", "label as structure_id, row_number() over (partition by label order by vec_id) - 1 as node")
CTES["label_dist"] = labelled(CTES["dist"])
CTES["label_response"] = labelled(CTES["response"])

# runs over whole assays, see run_variants() and run_mapping(); structures of whole labels, see label_residues()
_run = lambda sql: re.sub(r"\b(variants|mapping|placed)\b", r"run_\1", sql)
CTES["run_variants"] = CTES["variants"].replace("block_", "idx_")
CTES["run_mapping"] = f"""select assay_id, single, idx, idx % {NODES} - (idx % {NODES}) // 40 as node, {_sql_letter('(idx + 26) * 7')} as wt_aa
 from (select assay_id, single, unnest(range(0, (max(idx) // {NODES} + 1) * {NODES})) as idx from run_variants group by 1, 2) where idx % {NODES} % 40 != 39"""
CTES["run_placed"] = _run(CTES["placed"])
CTES["run_flagged"] = _run(CTES["flagged"])
CTES["run_nodes"] = CTES["nodes"].replace("from placed", "from run_placed")
CTES["label_residues"] = CTES["residues"].replace(f"vec_id // {NODES} as structure_id, vec_id % {NODES} as node", "label as structure_id, row_number() over (partition by label order by vec_id) - 1 as node")
CTES["label_dist"] = labelled(CTES["dist"])
CTES["label_response"] = labelled(CTES["response"])

# runs over whole assays, see run_variants() and run_mapping(); structures of whole labels, see label_residues()
_run = lambda sql: re.sub(r"\b(variants|mapping|placed)\b", r"run_\1", sql)
CTES["run_variants"] = CTES["variants"].replace("block_", "idx_")
CTES["run_mapping"] = f"""select assay_id, single, idx, idx % {NODES} - (idx % {NODES}) // 40 as node, {_sql_letter('(idx + 26) * 7')} as wt_aa
 from (select assay_id, single, unnest(range(0, (max(idx) // {NODES} + 1) * {NODES})) as idx from run_variants group by 1, 2) where idx % {NODES} % 40 != 39"""
CTES["run_placed"] = _run(CTES["placed"])
CTES["run_flagged"] = _run(CTES["flagged"])
CTES["run_nodes"] = CTES["nodes"].replace("from placed", "from run_placed")
CTES["label_residues"] = CTES["residues"].replace(f"vec_id // {NODES} as structure_id, vec_id % {NODES} as node", "label as structure_id, row_number() over (partition by label order by vec_id) - 1 as node")
CTES["label_dist"] = labelled(CTES["dist"])
CTES["label_response"] = labelled(CTES["response"])


def with_carriers(body: str) -> str:
    """SQL with the carriers that it uses, directly or not."""
    need, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name, sql in CTES.items():
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(sql)
    ctes = ", ".join(f"{name} as materialized ({sql})" for name, sql in CTES.items() if name in need)
    body = body.strip()
    if body.lower().startswith("with "):
        rest = body[5:]
        rest = rest[len("recursive ") :] if rest.lower().startswith("recursive ") else rest
        head = "with recursive " if body.lower().startswith("with recursive") else "with "
        return f"{head}{ctes}, {rest}" if ctes else body
    return f"with {ctes} {body}" if ctes else body
