"""Scores of variants by frequencies or model output, and batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitscape.functions.alphabet import LETTERS
from fitscape.functions.arrays import log_softmax, softmax
from fitscape.operators.assay import code_sites, real_mutations, unsent


def conservation_score(variants: DataFrame, mapping: DataFrame, pssm: DataFrame) -> DataFrame:
    """assay_id, ord, single, code, fitness, score of real mutations: sum over aligned sites of ln freq(mutant) - ln freq(experiment's wild type). pssm: node, aa, freq > 0; with family_id each family scores each variant, and rows have it too."""
    fam = [x for x in ("family_id",) if x in pssm.columns]
    v = real_mutations(variants, mapping).filter("real").withColumn("_s", code_sites(F.col("code")))
    site = lambda k: F.struct(F.col(f"node_{k}").alias("node"), F.col(f"wt_{k}").alias("wt"), F.get("_s", F.lit(k - 1))["mut"].alias("mut"))
    keys = ["assay_id", "ord", "single", "code", "fitness"]
    sites = v.select(*keys, F.inline(F.array(site(1), site(2)))).filter("node is not null and mut is not null")
    f = lambda x: pssm.select(*fam, "node", F.col("aa").alias(x), F.log("freq").alias(f"f_{x}"))
    return sites.join(f("wt"), ["node", "wt"]).join(f("mut"), [*fam, "node", "mut"]).groupBy(*fam, *keys).agg(F.sum(F.col("f_mut") - F.col("f_wt")).alias("score"))


def restrict_to(df: DataFrame, reference: DataFrame, key: str = "code") -> tuple[DataFrame, DataFrame]:
    """Rows whose key the reference has; and one row: n_reference (distinct keys), n_kept, n_missing."""
    keys = reference.select(key).distinct()
    kept = df.join(keys, key, "left_semi")
    counts = keys.agg(F.count("*").alias("n_reference")).join(kept.agg(F.count("*").alias("n_kept")), F.lit(True))
    return kept, counts.withColumn("n_missing", F.col("n_reference") - F.col("n_kept"))


def mutational_scan(pssm: DataFrame, residues: DataFrame, variants: DataFrame, mapping: DataFrame) -> DataFrame:
    """node, wt_aa, mut_aa, predicted (ln ratio to the structure's letter, 4 decimals), actual (the last measured single's fitness, or null) of each node and other letter. With family_id in pssm and residues, of each family."""
    fam = [x for x in ("family_id",) if x in pssm.columns]
    wt = residues.select(*fam, "node", F.col("aa").alias("wt_aa"))
    f = pssm.select(*fam, "node", F.col("aa").alias("mut_aa"), F.log("freq").alias("f"))
    own = f.select(*fam, "node", F.col("mut_aa").alias("wt_aa"), F.col("f").alias("f_wt"))
    grid = wt.join(f, [*fam, "node"]).filter("wt_aa != mut_aa").join(own, [*fam, "node", "wt_aa"]).select(*fam, "node", "wt_aa", "mut_aa", F.round(F.col("f") - F.col("f_wt"), 4).alias("predicted"))
    s = variants.filter("single = 1").join(unsent(mapping.select("assay_id", "single", "idx", "node")), ["assay_id", "single", "idx"])
    s = s.groupBy("node", F.get(code_sites(F.col("code")), F.lit(0))["mut"].alias("mut_aa")).agg(F.max_by("fitness", F.struct("ord", "assay_id")).alias("actual"))
    return grid.join(s, ["node", "mut_aa"], "left").select(*fam, "node", "wt_aa", "mut_aa", "predicted", F.round("actual", 4).alias("actual"))


def scan_matrix(scan: DataFrame, letters: str = LETTERS) -> DataFrame:
    """mut_aa and a column for each letter's normalised prediction by node range is left to the sink; here: node, mut_aa, predicted_norm (by the greatest absolute), actual_norm ((actual - 1) by the greatest absolute), row (place of the letter)."""
    fam = [x for x in ("family_id",) if x in scan.columns]
    own = Window.partitionBy(*fam) if fam else Window.partitionBy(F.lit(0))
    x = scan.withColumn("_p", F.max(F.abs("predicted")).over(own)).withColumn("_a", F.max(F.abs(F.col("actual") - 1)).over(own))  # nodes by letters: a few thousand rows
    return x.select(*fam, "node", "mut_aa", F.instr(F.lit(letters), F.col("mut_aa")).alias("row"), (F.col("predicted") / F.nullif("_p", F.lit(0.0))).alias("predicted_norm"), ((F.col("actual") - 1) / F.nullif("_a", F.lit(0.0))).alias("actual_norm"))


def scan_pivot(matrix: DataFrame, nodes: list[int], value: str = "predicted_norm") -> DataFrame:
    """The matrix as a sheet: a row for each letter, in the given order, a column for each of the given nodes."""
    return matrix.groupBy("row", "mut_aa").pivot("node", nodes).agg(F.first(value)).orderBy("row")


def zero_shot_score(logits: DataFrame, sites: DataFrame) -> DataFrame:
    """assay_id, ord, n_sites, score: sum over masked sites of log P(mutant) - log P(wild type). logits: node, logits; sites: assay_id, ord, node, label, mut_idx."""
    p = logits.select("node", log_softmax(F.col("logits")).alias("lp"))
    x = sites.join(p, "node").filter("label >= 0 and mut_idx >= 0")
    return x.groupBy("assay_id", "ord").agg(F.count("*").alias("n_sites"), F.sum(F.get("lp", F.col("mut_idx")) - F.get("lp", F.col("label"))).alias("score"))


def wild_type_recovery(logits: DataFrame, sites: DataFrame) -> DataFrame:
    """n_sites, accuracy: share of masked sites whose likeliest letter is the wild type's."""
    x = sites.filter("label >= 0").join(logits, "node")
    hit = (F.array_position("logits", F.array_max("logits")) - 1 == F.col("label")).cast("int")
    return x.agg(F.count("*").alias("n_sites"), F.avg(hit).alias("accuracy"))


def masked_predictions(logits: DataFrame) -> DataFrame:
    """key, true_aa, predicted_aa, true_aa_probability, correct and prob_<letter> of each masked position. logits: key, label, logits."""
    p = logits.withColumn("p", softmax(F.col("logits")))
    best = F.array_position("p", F.array_max("p")).cast("int")
    letter = lambda i: F.substring(F.lit(LETTERS), i, F.lit(1))
    probs = [F.get("p", F.lit(i)).alias(f"prob_{a}") for i, a in enumerate(LETTERS)]
    return p.select("key", letter(F.col("label").cast("int") + 1).alias("true_aa"), letter(best).alias("predicted_aa"), F.get("p", F.col("label").cast("int")).alias("true_aa_probability"), (best - 1 == F.col("label")).alias("correct"), *probs)


def masked_metrics(logits: DataFrame, k: int = 3) -> DataFrame:
    """n, accuracy, topk_accuracy, nll, perplexity over masked positions (label >= 0). Ties rank the smaller index first."""
    x = logits.filter("label >= 0").withColumn("_lp", log_softmax(F.col("logits")))
    own = F.get("logits", F.col("label").cast("int"))
    ahead = F.size(F.filter("logits", lambda v, i: (v > own) | ((v == own) & (i < F.col("label")))))
    x = x.select(ahead.alias("r"), F.get("_lp", F.col("label").cast("int")).alias("lp"))
    return x.agg(F.count("*").alias("n"), F.avg((F.col("r") == 0).cast("int")).alias("accuracy"), F.avg((F.col("r") < k).cast("int")).alias("topk_accuracy"), (-F.avg("lp")).alias("nll"), F.exp(-F.avg("lp")).alias("perplexity"))


def score_batches(features: DataFrame, predict: Callable[[np.ndarray], np.ndarray], width: int, key: list[str], column: str = "features") -> DataFrame:
    """key and prediction of each row: any function of a matrix of feature rows. Fails on a row of another width."""
    kinds = dict(features.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            sizes = pdf[column].map(len)
            if (sizes != width).any():
                raise ValueError(f"features have {sizes[sizes != width].iloc[0]} numbers, the model takes {width}")
            yield pdf[key].assign(prediction=predict(np.array(pdf[column].tolist(), float)) if len(pdf) else [])

    return features.select(*key, column).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in key) + ", prediction double")


def mlp(w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: float) -> Callable[[np.ndarray], np.ndarray]:
    """Linear, x * sigmoid(x), linear."""

    def predict(x: np.ndarray) -> np.ndarray:
        h = x @ w1.T + b1
        return (h / (1 + np.exp(-h))) @ w2 + b2

    return predict


