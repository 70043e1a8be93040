"""Hand-made edge cases, golden values and brute-force twins."""

import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitscape.functions.alphabet import LETTERS, aa_index, letter_of_name
from fitscape.operators import align, assay, cluster, dynamics, family, features, masking, metrics, ordering, pssm, scoring, splits, structure

STRUCTURE = (
    "HPETLVKVKDAEDQLGARVGYIELDLNSGKILESFRPEERFPMMSTFKVLLCGAVLSRIDAGQEQLGRRIHYSQNDLVEYSPVTEKHLTDGMTVRELCSAAITMSDNTAANLLLTTIGGPKELTAFLHNMGDHVTRLDRWEPELNEAIPNDERDTTMPVAMATTLRKLLTGELLTLASRQQLIDWMEADKVAGPLLRSALPAGWFIADKSGAGERGSRGIIAALGPDGKPSRIVVIYTTGSQATMDERNRQIAEIGASLIKHW"
)
DOUBLE = "MSIQHFRVALIPFFAAFCLPVFAHPETLVKVKDAEDQLGARVGYIELDLNSGKILESFRPEERFPMMSTFKVLLCGAVLSRVDAGQEQLGRRIHQNDLVEYSPVTEKHLTDGMTVRELCSAAITMSDNTAANLLLTTIGGPKELTAFLHNMGDHVTRLDRWEPELNEAIPNDERDTTMPAAMATTLRKTGELLTLASRQQLIDWMEADKVAGPLLRSALPAGWFIADKSGAGERGSRGIIAALGPDGKPSRIVVIYTTGSQATMDERNRQIAEIGASLIKH"
SINGLE = DOUBLE[:94] + "YS" + DOUBLE[94:188] + "LL" + DOUBLE[188:] + "W*"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def score(places, sequence, reference):
    """Of an alignment, with its gaps as they come."""
    steps, at = [], -1
    for p in places:
        if p >= 0:
            steps += ["L"] * (p - at - 1) + ["D"]
            at = p
        else:
            steps.append("U")
    steps += ["L"] * (len(reference) - at - 1)
    total = sum((1 if sequence[i] == reference[p] else -1) for i, p in enumerate(places) if p >= 0)
    return total + sum(-0.5 if x == y else -2 for x, y in zip(steps, ["", *steps], strict=False) if x != "D")


def best_score(a, b):
    low = -1e9
    m, x, y = (np.full((len(a) + 1, len(b) + 1), low) for _ in range(3))
    m[0, 0] = 0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i and j:
                m[i, j] = max(m[i - 1, j - 1], x[i - 1, j - 1], y[i - 1, j - 1]) + (1 if a[i - 1] == b[j - 1] else -1)
            if i:
                x[i, j] = max(max(m[i - 1, j], y[i - 1, j]) - 2, x[i - 1, j] - 0.5)
            if j:
                y[i, j] = max(max(m[i, j - 1], x[i, j - 1]) - 2, y[i, j - 1] - 0.5)
    return max(m[-1, -1], x[-1, -1], y[-1, -1])


def test_alphabet(spark):
    df = spark.createDataFrame([("A",), ("V",), ("-",), ("",), (None,), ("X",), ("AR",)], "aa string")
    assert [r[0] for r in df.select(aa_index(F.col("aa"))).collect()] == [0, 19, -1, -1, -1, -1, -1]
    assert spark.range(1).select(letter_of_name(F.lit("trp")), letter_of_name(F.lit("XYZ"))).first()[:] == ("W", None)


@pytest.mark.parametrize("sequence,expected,mapped,equal", [(DOUBLE, 234.0, 258, 256), (SINGLE, 244.0, 263, 261)])
def test_alignment_golden(sequence, expected, mapped, equal):
    (places,) = align.align_pairs([sequence], STRUCTURE)
    got = [(i, p) for i, p in enumerate(places) if p >= 0]
    assert len(got) == mapped
    assert sum(sequence[i] == STRUCTURE[p] for i, p in got) == equal
    assert score(places, sequence, STRUCTURE) == expected


def test_alignment_is_optimal():
    random.seed(4)
    for _ in range(60):
        reference = "".join(random.choices("ARN", k=random.randint(1, 12)))
        some = ["".join(random.choices("ARN", k=random.randint(0, 12))) for _ in range(4)]
        for s, places in zip(some, align.align_pairs(some, reference), strict=True):
            assert score(places, s, reference) == pytest.approx(best_score(s, reference))


def test_experiment_mapping(spark):
    experiments = [("a", 1, STRUCTURE[5:120]), ("a", 0, STRUCTURE[:40] + STRUCTURE[60:]), ("b", 1, None), ("c", 1, "")]
    df = spark.createDataFrame(experiments, "assay_id string, single int, sequence string")
    got = {}
    for r in align.experiment_mapping(df, STRUCTURE).collect():
        got.setdefault((r["assay_id"], r["single"]), {})[r["idx"]] = (r["node"], r["wt_aa"])
    assert set(got) == {("a", 1), ("a", 0)}
    for key, sequence in (("a", 1), experiments[0][2]), (("a", 0), experiments[1][2]):
        (places,) = align.align_pairs([sequence], STRUCTURE)
        assert got[key] == {i: (p, sequence[i]) for i, p in enumerate(places) if p >= 0}
    assert got["a", 1][0] == (5, STRUCTURE[5]) and got["a", 0][40] == (60, STRUCTURE[60])


def test_alignment_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "seq_id long, sequence string")
    assert rows(align.align_to_reference(df, "ARN"), "n_mapped", "percent_identity") == [(0, None), (0, None)]


def test_run_index(spark):
    data = [("a", 0, 5), ("a", 1, 5), ("a", 2, None), ("a", 3, None), ("a", 4, 5), ("b", 0, 1)]
    df = spark.createDataFrame(data, "assay_id string, ord long, position long")
    expected = [("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("a", 3, 1), ("a", 4, 2), ("b", 0, 0)]
    for f in (assay.run_index, assay.run_index_at_scale):
        assert rows(f(df, "position", "ord", ["assay_id"]), "assay_id", "ord", "idx") == expected


def test_codes(spark):
    df = spark.createDataFrame([("a", k, c) for k, c in enumerate(["A_5_R", "A_R_7_N_D", "A_R_7_20_N_D", "A_R_7_N", "A_x_R", None])], "assay_id string, ord long, code string")
    assert rows(assay.explode_sites(df), "ord", "site", "mut") == [(0, 5, "R"), (1, 7, "N"), (1, 8, "D"), (2, 20, "D"), (2, 7, "N")]
    assert [r[1] for r in rows(assay.explode_sites(df.filter("ord = 1"), "same_position"), "ord", "site")] == [7, 7]
    assert rows(assay.bad_codes(df), "ord") == [(3,), (4,), (5,)]


def variants(spark):
    data = [("a", 0, 1, 0, "A_5_R"), ("a", 1, 1, 0, "A_5_A"), ("a", 2, 1, 9, "A_5_A"), ("a", 3, 0, 0, "A_R_5_A_N"), ("a", 4, 0, 1, "R_N_6_R_D"), ("a", 5, 0, 0, "A_R_5_A_R")]
    v = spark.createDataFrame(data, "assay_id string, ord long, single int, idx long, code string")
    m = spark.createDataFrame([("a", s, i, i + 10, w) for s in (0, 1) for i, w in ((0, "A"), (1, "R"))], "assay_id string, single int, idx long, node long, wt_aa string")
    return v.withColumn("fitness", F.lit(1.0)), m


def test_real_mutations_and_positions(spark):
    v, m = variants(spark)
    assert rows(assay.real_mutations(v, m), "ord", "aligned", "real") == [(0, True, True), (1, True, False), (2, False, False), (3, True, True), (4, True, False), (5, True, False)]
    assert rows(assay.load_variants(v, m), "ord") == [(0,), (2,), (3,)]
    # a pair whose second site is unaligned has no positions, though it may be a real mutation
    assert rows(assay.structural_positions(v, m), "ord", "nodes") == [(0, [10]), (1, [10]), (2, []), (3, [10, 11]), (4, []), (5, [10, 11])]


def test_ordinals_and_cut(spark):
    random.seed(1)
    values = [random.randint(0, 50) for _ in range(500)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id long, v long")
    got = {r["id"]: r["ordinal"] for r in ordering.with_ordinal(df, ["v", "id"]).collect()}
    assert got == {k: n for n, k in enumerate(sorted(range(500), key=lambda k: (values[k], k)), 1)}
    sums = {r["id"]: r["running"] for r in ordering.running_sum(df, "v", ["v", "id"]).collect()}
    total = 0
    for k in sorted(range(500), key=lambda k: (values[k], k)):
        total += values[k]
        assert sums[k] == total
    n = {r["split"]: r["count"] for r in ordering.exact_cut(df, "id", 0.7, 0.2).groupBy("split").count().collect()}
    assert n == {"train": 350, "val": int((0.7 + 0.2) * 500) - 350, "test": 500 - int((0.7 + 0.2) * 500)}


def test_greedy_fill_skips_empty_share(spark):
    df = spark.createDataFrame([(0, k, 10 - k) for k in range(6)], "a int, g int, n int")
    got = rows(ordering.greedy_fill(df, "n", [("n", False)], (0.8, 0.0, 0.2), ["a"]), "g", "split")
    assert {s for _, s in got} == {"train", "test"}


def test_splits_share_no_group(spark):
    data = [("a", k, k % 2, [k % 30] if k % 2 else [k % 30, (k % 30) + 1]) for k in range(300)] + [("a", 999, 1, [])]
    v = spark.createDataFrame(data, "assay_id string, ord long, single int, nodes array<long>")
    got = splits.split_by_position(v, n_blocks=6).collect()
    by = {}
    for r in got:
        for n in r["nodes"]:
            by.setdefault(n, set()).add(r["split"])
    assert all(len(x) == 1 for x in by.values()) and 0 < len(got) < 301
    with pytest.raises(ValueError, match="scope"):
        splits.held_out_doubles(v, "some")
    with pytest.raises(ValueError, match="no single"):
        splits.held_out_doubles(v.filter("single = 0"))
    with pytest.raises(ValueError, match="fewer than two"):
        splits.held_out_doubles(v.filter("single = 1 or ord = 2"), "all")


def leaders(sequences, k, threshold, n):
    """The greedy rule, one sequence at a time: a cluster is reached by an anchor of any of its members so far."""
    sets = {i: {s[j : j + k] for j in range(len(s) - k + 1)} for i, s in sequences.items()}
    out, lead, doors = {}, [], {}
    for i in sorted(sequences, key=lambda i: (-len(sequences[i]), i)):
        own = sorted(sets[i])[:n]
        reached = set().union(*(doors.get(x, set()) for x in own))
        best, at = 0.0, i
        for j in lead:
            if j in reached:
                x = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                if x >= threshold and x > best:
                    best, at = x, j
        out[i] = at
        if at == i:
            lead.append(i)
        for x in own:
            doors.setdefault(x, set()).add(at)
    return out


def drifting(seed, n, length, letters, edits):
    """Chains in which each sequence is an edited, maybe shorter, copy of one before, and whole copies."""
    random.seed(seed)
    data = {}
    for i in range(n):
        if i < 4:
            s = random.choices(letters, k=length)
        else:
            s = list(data[random.randrange(max(0, i - 12), i)])
            for _ in range(random.choice([0, *edits])):
                s[random.randrange(len(s))] = random.choice(letters)
            s = s[: random.choice([len(s), len(s), len(s) - 1])] if len(s) > length * 0.6 else s
        data[i * 7 % n] = "".join(s) if i * 7 % n not in data else data[i * 7 % n]
        data.setdefault(i, "".join(s))
    return data


@pytest.mark.parametrize(("seed", "n", "length", "edits", "anchors", "threshold"), [(3, 60, 30, (1, 2), 8, 0.5), (5, 500, 24, (1, 2, 4), 2, 0.4), (6, 500, 18, (1, 3), 3, 0.3)])
def test_clusters_match_the_greedy_rule(spark, monkeypatch, seed, n, length, edits, anchors, threshold):
    monkeypatch.setattr(cluster, "BLOCK", 50)
    data = drifting(seed, n, length, "ACDE", edits) | {9000: "AR", 9001: "AR", 9002: "", 9003: None}
    df = spark.createDataFrame(list(data.items()), "seq_id long, sequence string")
    got = {r["seq_id"]: r["leader"] for r in cluster.cluster_sequences(df, 3, threshold, anchors).collect()}
    plain = leaders({i: s or "" for i, s in data.items()}, 3, threshold, anchors)
    assert got == plain and len(set(got.values())) > 4
    if n == 500:  # some join a leader with which they share no anchor
        own = {i: set(sorted({s[j : j + 3] for j in range(len(s) - 2)})[:anchors]) for i, s in data.items() if s}
        assert any(i != j and not own[i] & own[j] for i, j in got.items() if i in own)


def test_similar_pairs_of_long_lists(spark, monkeypatch):
    """Lists of several blocks: the pairs are those of a plain run."""
    monkeypatch.setattr(cluster, "BLOCK", 100)
    random.seed(11)
    base = ["".join(random.choices("ACDE", k=26)) for _ in range(150)]
    data = {i: "AAA" + base[i % 150][: 20 + i % 5] + random.choice("ACDE") * (i % 3) for i in range(900)}
    df = cluster.anchors(cluster.kmers(spark.createDataFrame(list(data.items()), "seq_id long, sequence string"), 3))
    got = {(r["a"], r["b"]): r["similarity"] for r in cluster.similar_pairs(df, 0.7).collect()}
    sets = {i: {s[j : j + 3] for j in range(len(s) - 2)} for i, s in data.items()}
    plain = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    own = {i: set(sorted(x)[:8]) for i, x in sets.items()}
    assert got == {(a, b): pytest.approx(x) for (a, b), x in plain.items() if own[a] & own[b]} and len(got) > 1000


def test_masks(spark):
    t = spark.createDataFrame([("f", 1, n, n % 5 if n % 4 else -1) for n in range(40)] + [("f", 2, 0, -1)], "family_id string, seq_id long, node long, aa_idx int")
    got = masking.sample_masks(t, 0.15, epochs=2).collect()
    for epoch in (0, 1):
        masked = [r for r in got if r["epoch"] == epoch and r["is_masked"]]
        assert len(masked) == 4 and all(r["label"] >= 0 and r["visible"] == -1 for r in masked)  # half-even round of 4.5
    assert {r["node"] for r in got if r["is_masked"] and r["epoch"] == 0} != {r["node"] for r in got if r["is_masked"] and r["epoch"] == 1}


def residues(spark, points, aa="A"):
    return spark.createDataFrame([(0, k, aa, p, p, p, p) for k, p in enumerate(points)], "structure_id int, node long, aa string, ca array<double>, n array<double>, c array<double>, o array<double>")


def test_edges(spark):
    r = residues(spark, [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [2.0, 0.0, 0.0], [9.0, 0.0, 0.0]])
    assert rows(structure.knn_edges(r, 1, directed=True), "src", "dst") == [(0, 1), (1, 0), (2, 1), (3, 2)]
    assert rows(structure.radius_edges(r, 1.0001), "src", "dst") == [(0, 1), (1, 0), (1, 2), (2, 1)]
    with pytest.raises(ValueError, match="no residues"):
        structure.radius_edges(r, 1.0).count()  # strictly below
    assert rows(structure.isolated_nodes(r, structure.radius_edges(r, 1.5)), "node") == [(3,)]
    with pytest.raises(ValueError, match="positive"):
        structure.knn_edges(r, 0)


def test_response_matches_loops(spark):
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.normal(0, 3, (12, 3)), axis=0)
    n = len(x)
    h = np.zeros((3 * n, 3 * n))
    for i in range(n):
        for j in range(n):
            if i != j:
                d = x[i] - x[j]
                r = d @ d
                b = 1e6 / r**3 * np.outer(d, d) / r
                h[3 * i : 3 * i + 3, 3 * i : 3 * i + 3] += b
                h[3 * i : 3 * i + 3, 3 * j : 3 * j + 3] -= b
    inverse = np.linalg.pinv(h, rcond=1e-10)
    p = np.zeros((n, n))
    for d in dynamics.DIRECTIONS:
        for j in range(n):
            f = np.zeros(3 * n)
            f[3 * j : 3 * j + 3] = d
            p[:, j] += np.linalg.norm((inverse @ f).reshape(n, 3), axis=1)
    p /= p.sum()
    got = dynamics.perturbation(residues(spark, x.tolist())).toPandas().pivot(index="i", columns="j", values="value").to_numpy()
    assert np.allclose(got, p, rtol=1e-4)


def test_correlations(spark):
    data = [("a", 1.0, 2.0), ("a", 2.0, 2.0), ("a", 3.0, 5.0), ("a", float("nan"), 1.0), ("a", None, 1.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0)]
    df = spark.createDataFrame(data, "g string, x double, y double")
    got = {r["g"]: r for r in metrics.pearson(df, "x", "y", ["g"]).collect()}
    assert got["a"]["n"] == 3 and got["a"]["r"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 2, 5])[0, 1]) and got["b"]["r"] is None
    rho = {r["g"]: r["rho"] for r in metrics.spearman(df, "x", "y", ["g"]).collect()}
    assert rho["a"] == pytest.approx(np.corrcoef([1, 2, 3], [1.5, 1.5, 3])[0, 1])
    whole = metrics.spearman(df.filter("g = 'a'"), "x", "y", []).first()
    assert whole["rho"] == pytest.approx(rho["a"])


def test_features(spark):
    v, m = variants(spark)
    props = spark.createDataFrame([("p", a, float(k)) for k, a in enumerate(LETTERS)], "prop_id string, aa string, value double")
    z = features.standardize_properties(props)
    assert z.agg(F.round(F.stddev_pop("value"), 9), F.round(F.avg("value"), 9)).first()[:] == (1.0, 0.0)
    got = {r["ord"]: r["features"] for r in features.variant_features(v, m, z).collect()}
    assert {len(x) for x in got.values()} == {2 * 43 + 1} and got[3][-1] == 1.0 and got[4][-1] == 0.0 and got[0][-1] == 0.0
    with pytest.raises(Exception, match="the model takes 5"):
        scoring.score_batches(features.variant_features(v, m, z), lambda x: x[:, 0], 5, ["ord"]).collect()


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([("f", 3), ("f", 3), ("f", None), ("g", 0), ("g", 10)], "g string, v int")
    assert rows(pssm.histogram(df, "v", "g", 5), "g", "bin", "n") == [("f", 0, 2), ("g", 0, 1), ("g", 4, 1)]


def test_masked_metrics(spark):
    df = spark.createDataFrame([(0, [2.0, 1.0, 0.0]), (2, [1.0, 1.0, 1.0]), (-100, [0.0, 0.0, 0.0])], "label int, logits array<double>")
    got = scoring.masked_metrics(df, 2).first()
    assert (got["n"], got["accuracy"], got["topk_accuracy"]) == (2, 0.5, 0.5)
    assert got["perplexity"] == pytest.approx(np.exp(got["nll"]))


def test_classes_and_weights(spark):
    df = spark.createDataFrame([("t", 1.0), ("t", 0.01), ("t", 0.5), ("t", None)], "split string, v double")
    assert rows(metrics.fitness_classes(df, "v", "split"), "class", "n") == [("beneficial", 1), ("dead", 1), ("deleterious", 1)]
    w = features.group_weights(spark.createDataFrame([("m", 1), ("m", 1), ("m", 1)], "m string, single int"), ["m"])
    assert rows(w, "single", "weight") == [(0, 0.0), (1, 0.5)]


@pytest.mark.parametrize("kind", ["one value", "common prefix", "nulls"])
def test_ranges_split_any_order_key(spark, kind):
    n = 4000
    first = {"one value": lambda k: "x", "common prefix": lambda k: f"a-long-common-prefix-{k * 7919 % n:05d}", "nulls": lambda k: None if k % 3 else str(k % 5)}[kind]
    df = spark.createDataFrame([(first(k), k * 31 % n, k % 3 == 0) for k in range(n)], "s string, id long, odd boolean").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one task's
    sizes = [r["count"] for r in ordering._ranged(df, ["s", "id"]).groupBy("_bucket").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 0.4 * n
    order = sorted(df.collect(), key=lambda r: (r["s"] is not None, r["s"] or "", r["id"]))
    assert {r["id"]: r["ordinal"] for r in ordering.with_ordinal(df, ["s", "id"]).collect()} == {r["id"]: k for k, r in enumerate(order, 1)}
    place, seen = {}, {}
    for r in order:
        place[r["id"]] = seen[r["odd"]] = seen.get(r["odd"], 0) + 1
    assert {r["id"]: r["ordinal"] for r in ordering.with_ordinal(df, ["s", "id"], ["odd"]).collect()} == place
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_runs_over_ranges(spark):
    random.seed(8)
    data = [("ab"[k % 50 == 0], k, random.choice([None, 1, 2]) if k % 9 == 0 else k // 700) for k in range(3000)]
    df = spark.createDataFrame(data, "assay_id string, ord long, position long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert rows(assay.run_index_at_scale(df, "position", "ord", ["assay_id"])) == rows(assay.run_index(df, "position", "ord", ["assay_id"]))
    sums = {r["ord"]: r["running"] for r in ordering.running_sum(df.withColumn("v", F.when(F.col("ord") > 2500, F.col("ord"))), "v", ["ord"]).collect()}
    assert sums[2500] is None and sums[2501] == 2501 and sums[2999] == sum(range(2501, 3000))
    assert ordering.with_ordinal(df.limit(0), ["ord"]).count() == 0 and assay.run_index_at_scale(df.limit(0), "position", "ord", ["assay_id"]).count() == 0
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nearest_by_cells(spark):
    """Even, clustered and flat clouds, far outliers, equal points and distances, k above N - 1, residues without coordinates."""
    rng = np.random.default_rng(2)
    clouds = {
        0: rng.normal(0, 5, (300, 3)), 1: np.vstack([rng.normal(0, 0.01, (150, 3)), rng.normal(900, 1, (5, 3)), [[1e6, 0, 0]]]), 2: np.repeat(np.arange(8.0), 4).reshape(32, 1) * [[1, 0, 0]], 3: np.zeros((9, 3)),
        4: np.array([(a, b, c) for a in range(5) for b in range(5) for c in range(5)], float), 5: rng.normal(0, 1, (3, 3)), 6: np.zeros((1, 3)),
    }
    data = [(s, k, x.tolist()) for s, p in clouds.items() for k, x in enumerate(p)]
    odd = [(0, 900, None), (0, 901, [1.0, None, 2.0]), (0, 902, [float("nan"), 0.0, 0.0]), (5, 903, [float("inf"), 0.0, 0.0])]
    r = spark.createDataFrame(data + odd, "structure_id int, node long, ca array<double>")
    got = rows(structure.knn_edges(r, 5, directed=True), "structure_id", "src", "dst")
    plain = []
    for s, p in clouds.items():
        for i in range(len(p)):
            d = np.sqrt(((p[i] - p) ** 2 @ np.ones(3)))
            d = [float(np.sqrt((x := p[i] - q)[0] * x[0] + x[1] * x[1] + x[2] * x[2])) for q in p]
            plain += [(s, i, j) for _, j in sorted((d[j], j) for j in range(len(p)) if j != i)[:5]]
    assert got == sorted(plain, key=repr)
    assert structure.knn_edges(r.limit(0), 5).count() == 0


def by_svd(ca):
    """The response matrix with free modes found by singular values."""
    n = len(ca)
    d = ca[:, None] - ca[None]
    r2 = (d * d).sum(axis=2) + np.eye(n)
    spring = 1e6 / r2**3 * (1 - np.eye(n))
    block = (spring / r2)[:, :, None, None] * d[:, :, :, None] * d[:, :, None, :]
    h = -block
    h[np.arange(n), np.arange(n)] = block.sum(axis=1)
    u, s, vt = np.linalg.svd(h.transpose(0, 2, 1, 3).reshape(3 * n, 3 * n), hermitian=True)
    assert (s < 1e-6).sum() == 6
    inverse = ((vt[:-6].T / s[:-6]) @ u[:, :-6].T).reshape(n, 3, n, 3)
    out = np.linalg.norm(np.einsum("ixjy,dy->dijx", inverse, dynamics.DIRECTIONS), axis=3).mean(axis=0)
    return out / out.sum()


def test_response_by_known_modes(spark):
    rng = np.random.default_rng(6)
    for n in (4, 30, 120):
        x = np.cumsum(rng.normal(0, 4, (n, 3)), axis=0)
        assert np.abs(dynamics.response_matrix(x) - by_svd(x)).max() < 1e-9
    with pytest.raises(ValueError, match="line"):
        dynamics.response_matrix(np.outer(np.arange(6.0), [1, 2, 3]))
    two = np.vstack([rng.normal(0, 3, (5, 3)), rng.normal(0, 3, (5, 3)) + 1e5])  # two bodies that hardly hold each other
    with pytest.raises(ValueError, match="more than six"):
        dynamics.response_matrix(two)


def test_chain_of_couplings(spark):
    """T8 to T18 against NumPy."""
    rng = np.random.default_rng(7)
    x = np.cumsum(rng.normal(0, 3, (30, 3)), axis=0)
    r = residues(spark, x.tolist())
    p = by_svd(x)
    c = p / p.mean(axis=1, keepdims=True)
    a = (c - c.T) * (1 - np.eye(30))
    clear = a - (a.mean(axis=0)[None] - a.mean(axis=0)[:, None])
    asym = dynamics.coupling_asymmetry(dynamics.perturbation(r))
    edges = dynamics.coupling_edges(dynamics.remove_driver_strength(asym), 4)
    top = {(j, i) for i in range(30) for j in sorted((j for j in range(30) if j != i), key=lambda j: (-round(clear[i, j], 9), j))[:4]}
    assert set(rows(edges, "src", "dst")) == top
    both = dynamics.union_edges(edges, structure.knn_edges(r, 3, directed=True))
    v = dynamics.edge_vector(dynamics.coupling_feature(structure.edge_features(r, both), asym)).collect()
    assert {len(e["features"]) for e in v} == {99} and len(v) == both.count()
    for e in v:
        i, j = e["dst"], e["src"]
        assert e["features"][96] == ((j, i) in top) and e["features"][98] == pytest.approx(a[i, j] / np.abs(a).max(), abs=1e-5)
        assert e["features"][0] == pytest.approx(np.exp(-((np.linalg.norm(x[i] - x[j]) - 2) ** 2) / (10 / 6) ** 2))


def test_long_alignment_in_bounded_memory():
    random.seed(9)
    long = "".join(random.choices(LETTERS, k=40_000))
    tracemalloc.start()
    (got,) = align.align_pairs([long], STRUCTURE[:60])
    assert tracemalloc.get_traced_memory()[1] < 12 << 20
    tracemalloc.stop()
    assert len(got) == 40_000 and score(got, long, STRUCTURE[:60]) == pytest.approx(best_by_rows(long, STRUCTURE[:60]))
    kept = align._kept(200)
    some = ["".join(random.choices("ARN", k=n)) for n in (kept - 1, kept, kept + 1, 2 * kept, 200, 0, 1)]
    for s, places in zip(some, align.align_pairs(some, "ARNNAR" * 5), strict=True):
        assert score(places, s, "ARNNAR" * 5) == pytest.approx(best_score(s, "ARNNAR" * 5))


def best_by_rows(a, b):
    low = np.full(len(b) + 1, -1e9)
    best, up = np.array([0.0] + [-2 - 0.5 * j for j in range(len(b))]), low
    for x in a:
        up = np.maximum(best - 2, up - 0.5)
        new = up.copy()
        new[1:] = np.maximum(new[1:], best[:-1] + np.where(np.array(list(b)) == x, 1, -1))
        left = -1e9
        for j in range(1, len(b) + 1):
            left = max(new[j - 1] - 2, left - 0.5)
            new[j] = max(new[j], left)
        best = new
    return best[-1]


def test_homologs_by_their_own_alignment(spark):
    data = [("f", 1, STRUCTURE[10:200]), ("f", 2, STRUCTURE[:90] + STRUCTURE[120:]), ("f", 3, "A" * 50), ("g", 4, STRUCTURE)]
    df = spark.createDataFrame(data, "family_id string, seq_id long, sequence string")
    aligned = family.filter_by_identity(df, STRUCTURE, 0.5, 1.0)
    got = {}
    for r in pssm.thread_homologs(aligned, len(STRUCTURE)).select("seq_id", F.inline("sites")).collect():
        got.setdefault(r["seq_id"], {})[r["node"]] = r["aa_idx"]
    plain = {}
    for _, i, s in data:
        (places,) = align.align_pairs([s], STRUCTURE)
        same = sum(STRUCTURE[p] == c for p, c in zip(places, s, strict=True) if p >= 0)
        if 0.5 <= same / sum(p >= 0 for p in places) <= 1:
            plain[i] = {n: -1 for n in range(len(STRUCTURE))} | {p: LETTERS.index(c) for p, c in zip(places, s, strict=True) if p >= 0}
    assert got == plain and 4 in got and min(got[1].values()) == -1
    queries = spark.createDataFrame([("f", STRUCTURE[:60].lower() + "--.." + STRUCTURE[60:100]), ("g", "ARND" * 30), ("h", None)], "family_id string, raw string")
    at = family.query_mapping(queries, STRUCTURE)
    report = {r["family_id"]: r["low_identity"] for r in at.select("family_id", "low_identity").distinct().collect()}
    assert report == {"f": False, "g": True}
    (places,) = align.align_pairs([STRUCTURE[:100]], STRUCTURE)
    columns = rows(family.column_map(family.match_columns(queries.filter("family_id = 'f'")), at), "match_column", "col", "node", "query_residue")
    assert columns == sorted(((k, 64 + k, places[60 + k], 60 + k) for k in range(40)), key=repr)


def test_masks_of_arrays_and_rows(spark):
    random.seed(12)
    states = spark.createDataFrame([("f", k, "".join(random.choice(LETTERS + "---") for _ in range(30))) for k in range(40)] + [("f", 99, "-" * 30), ("f", 100, "")], "family_id string, seq_id long, match_states string")
    columns = spark.createDataFrame([("f", k, 100 + k * 3) for k in range(30) if k % 7], "family_id string, match_column int, node long")
    arrays, flat = pssm.thread_arrays(states, columns), pssm.thread_sequences(states, columns)
    assert rows(masking.sample_masks(arrays, 0.3, epochs=3)) == rows(masking.sample_masks(flat, 0.3, epochs=3))
    assert "Exchange hash" not in masking.sample_masks(arrays)._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert flat.filter("seq_id = 0").count() == 25 and flat.filter("seq_id = 100").count() == 0


def test_alignment_takes_little_time_a_sequence():
    random.seed(8)
    some = ["".join(random.choices("ARNDCQEGHILKMFPSTWYV", k=300)) for _ in range(256)]
    spent = []
    for _ in range(3):
        start = time.process_time()
        align.align_pairs(some, STRUCTURE)
        spent.append(time.process_time() - start)
    assert min(spent) < 0.001 * len(some)


def test_alignment_of_other_letters_and_columns(spark):
    df = spark.createDataFrame([(1, "Aé\U0001f600R", "x"), (2, "ARN", None)], "seq_id long, sequence string, more string")
    got = rows(align.align_to_reference(df, "ARN"), "seq_id", "more", "on_reference", "n_mapped", "n_equal")
    assert got[1] == (2, None, "ARN", 3, 3) and got[0][:2] == (1, "x") and got[0][4] == 2


def test_letters_are_threaded_counted_and_masked_as_arrow_columns(spark):
    random.seed(13)
    raw = [(f, k, k, "".join(random.choice("ARNDarnd-.zé") for _ in range(random.randint(0, 25)))) for f, k in [("f", 1), ("f", 2), ("g", 3), ("g", 4), ("f", 5)]] + [("f", 6, 6, None)]
    msa = spark.createDataFrame(raw, "family_id string, seq_id long, ord long, raw string")
    at = {"f": [3, 0, 19, 7], "g": [1, 2, 30]}
    columns = spark.createDataFrame([(f, k, c, 100 + c) for f, cols in at.items() for k, c in enumerate(cols)], "family_id string, match_column int, col int, node long")
    expected = []
    for f, k, _, text in raw:
        up = (text or "").upper()
        letters = "".join(up[c] if c < len(up) and up[c] in LETTERS else "-" for c in at[f])
        expected.append((f, k, letters, round(1 - letters.count("-") / len(letters), 4)))
    states = family.extract_match_states(msa, columns, 0.0)
    assert rows(states) == sorted(expected, key=repr)
    flat = pssm.thread_sequences(states, columns)
    assert rows(flat, "seq_id", "node", "aa", "aa_idx") == sorted(((k, 100 + c, x, LETTERS.find(x)) for f, k, s, _ in expected for c, x in zip(at[f], s, strict=True)), key=repr)
    own = spark.createDataFrame([("f", 103, "A"), ("h", 0, "R"), ("h", 1, "-")], "family_id string, node long, aa string")
    assert rows(pssm.pssm_counts(pssm.thread_counts(states, columns), own)) == rows(pssm.pssm_counts(flat, own))
    masks = masking.sample_masks(flat.select("family_id", "seq_id", "node", "aa_idx"), 0.5)
    for x in (states, flat, masks):
        assert "MapInArrow" in x._jdf.queryExecution().executedPlan().toString()
    residues = spark.createDataFrame([("f", 103, "A"), ("f", 107, "R"), ("g", 101, "N")], "family_id string, node long, aa string")
    values = spark.createDataFrame([("p", a, float(k)) for k, a in enumerate(LETTERS)] + [("q", "A", 1.0)], "prop_id string, aa string, value double")
    plain = masking.property_delta(masks, residues, values).groupBy("family_id", "prop_id").agg(F.count("*").alias("n"), F.sum("delta").alias("s"))
    counted = masking.property_delta(masking.visible_counts(masks), residues, values).groupBy("family_id", "prop_id").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("delta")).alias("s"))
    assert rows(counted) == rows(plain) and plain.count() == 3


def test_few_groups_and_values_do_not_gather_rows(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("model"), (F.col("id") % 3).cast("double").alias("x"), F.sin("id").alias("y"))
    ranked = metrics.average_ranks(df, "x", ["model"], "r")
    assert ranked.agg(F.sum("r")).first()[0] == 2 * 1500 * 1501 / 2
    for x in (ranked, metrics.pearson(df, "x", "y", ["model"])):
        assert "BroadcastHashJoin" in x._jdf.queryExecution().executedPlan().toString()
    # scores are computed once, however often the ranks' steps read them
    seen = spark.sparkContext.accumulator(0)
    fitness = F.udf(lambda k: (seen.add(1), float(k))[1], "double").asNondeterministic()
    scores = spark.range(40).select((F.col("id") % 2).alias("single"), F.cos("id").alias("score"), fitness("id").alias("fitness"))
    assert {r["subset"]: r["n"] for r in metrics.subset_correlations(scores, "score", "fitness").collect()} == {"single": 20, "pair": 20, "all": 40}
    assert seen.value == 40


def test_pairs_are_not_stored_and_copies_are_compared_once(spark, monkeypatch):
    random.seed(14)
    texts = ["".join(random.choices("ARND", k=40)) for _ in range(30)]
    df = spark.createDataFrame([(k, texts[k % 30] if k < 90 else "ARN") for k in range(95)], "seq_id long, sequence string")
    sets = cluster.anchors(cluster.kmers(df)).cache()
    own = {r["seq_id"]: (set(r["kmers"]), set(r["anchors"])) for r in sets.collect()}
    meet = {(a, b) for a in own for b in own if a < b and own[a][1] & own[b][1] and min(len(own[a][0]), len(own[b][0])) >= 0.5 * max(len(own[a][0]), len(own[b][0]))}
    pairs = cluster.candidate_pairs(sets)
    assert rows(pairs, "a", "b") == sorted(meet, key=repr)
    assert "Aggregate" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    compared, plain = [], cluster._sketched
    monkeypatch.setattr(cluster, "_sketched", lambda x: (compared.append(x.count()), plain(x))[1])
    got = {(r["a"], r["b"]): r["similarity"] for r in cluster.similar_pairs(sets).collect()}
    like = {(a, b): len(own[a][0] & own[b][0]) / len(own[a][0] | own[b][0]) for a, b in meet}
    assert got == {k: pytest.approx(x) for k, x in like.items() if x >= 0.5} and compared == [30]
