"""The pipeline against its plain version, stage by stage, on small documents and on the smallest tables."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fitscape.llm import line_quality
from tests.llm.test_text_operators import WORD, odd_documents, plain_components, plain_contamination

DATA = "/root/testdata/sf0.001"


def plain_cut(rows, size=50):
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            first[key] = min(d, first.get(key, d))
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = {j for i in range(len(w) - size + 1) if first[tuple(w[i : i + size])] < d for j in range(i, i + size)}
        if not gone:
            out.append((d, t))
        elif len(gone) < len(w):
            out.append((d, " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def plain_pipeline(rows, kept, items):
    """rows: (doc_id, text), ids distinct; kept: ids that the quality rules keep."""
    rows = [x for x in rows if x[0] in kept]
    least = {d for d, _, c in plain_components(rows) if d == c}
    rows = plain_cut([x for x in rows if x[0] in least])
    return [(d, t) for d, t in rows if not plain_contamination(t, items)[3]]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with documents that hold copies, near copies, passages, test items and nulls."""
    rows = {d: (d, t, lang, s) for d, t, lang, s in odd_documents(7, 80)}
    random.seed(9)
    words = [f"t{k}" for k in range(400)]
    item = " ".join(random.choices(words, k=20))
    passage = " ".join(random.choices(words, k=60))
    for k in range(200, 230):
        own = " ".join(random.choices(words, k=80))
        rows[k] = (k, own + (" " + item if k % 5 == 0 else "") + (" " + passage if k % 3 == 0 else "") + " end", "x", "s1")
        rows[k + 100] = (k + 100, rows[k][1] + " again", "x", "s1")
    path = str(tmp_path_factory.mktemp("tables"))
    df = spark.createDataFrame(list(rows.values()), "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("given", [False, True])
def test_stages_match_the_plain_version(spark, tables, given):
    path = DATA if given else tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    if given:
        docs = docs.filter("n_chars < 3000")  # the plain version compares all pairs; the pipeline below gets the same rows
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    kept = {r["doc_id"] for r in line_quality.line_quality(docs).collect() if r["kept"]}
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, path)
        assert out.columns == docs.columns, name
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    none = [r["text"] for r in docs.collect() if r["doc_id"] is None]
    assert {k: v for k, v in got.items() if k is not None} == dict(plain_pipeline(rows, kept, items)) and (None not in got or got[None] in none)
    pieces = corpus_pipeline.STAGES[-1][1](spark, out, path).collect()
    assert {r["doc_id"] for r in pieces} == set(got)
    whole = Counter()
    for r in pieces:
        whole[r["doc_id"]] += r["length"]
    assert all(whole[r["doc_id"]] == r["doc_tokens"] for r in pieces)


def test_rows_without_an_id_of_their_own_stay(spark, tmp_path):
    """Null ids, and one id with several texts: each text is a row of its own in every stage; of repeated rows one stays."""
    own = lambda k: " ".join(f"w{'abcde'[k % 5]}{'f' * (k // 5 + 1)}x{'g' * (j + 1)}" for j in range(30))
    rows = [(None, own(1)), (None, own(2)), (7, own(3)), (7, own(4)), (7, own(4)), (9, own(1))]
    docs = spark.createDataFrame([(d, t, "s", len(t)) for d, t in rows], "doc_id long, text string, source string, n_chars long")
    spark.createDataFrame([(None, "no such words"), (1, own(8))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr) == sorted([(9, own(1)), (None, own(2)), (7, own(3)), (7, own(4))], key=repr)


def test_stages_keep_columns_of_any_name(spark, tables):
    """Names that stages and operators use themselves: rows and values are those without these columns."""
    docs = spark.read.parquet(f"{tables}/documents.parquet").filter("doc_id is not null")
    odd = docs
    for name in ("__key", "_key", "__found", "__quality", "__row", "__text", "__changed", "__here", "__cut", "__host", "c0", "extra0", "found", "component_id", "_text", "key"):
        odd = odd.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, got = stage(spark, docs, tables), stage(spark, odd, tables)
        assert got.columns == odd.columns, name
        assert sorted(map(repr, plain.collect())) == sorted(map(repr, got.select(plain.columns).collect())), name
        assert got.filter("__row != concat('__row', doc_id) or c0 != concat('c0', doc_id) or __cut != concat('__cut', doc_id)").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, tables).count() > 0


def test_run_and_empty_tables(spark, tables, tmp_path):
    assert corpus_pipeline.run(spark, tables).count() > 20
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stage_table():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "packing"]
    assert all(re.fullmatch(r"[a-z_]+", n) for n, _ in corpus_pipeline.STAGES)


def test_hot_lines_leave_kept_documents(spark):
    own = lambda k: " ".join(f"w{'abcde'[k % 5]}{'f' * (k // 5 + 1)}x{'g' * (j + 1)}" for j in range(30))
    rows = [(k, f"Read our terms {k % 10}\n\n{own(k)}\n  \nRead  our TERMS 5", "h") for k in range(40)] + [(100, f"{own(100)}\nnothing here", "other"), (40, own(41), "h"), (40, "too few", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    got = [(r["doc_id"], r["text"], r["n_chars"]) for r in corpus_pipeline.STAGES[0][1](spark, docs, "").collect()]
    expected = [(k, f"\n{own(k)}\n  ") for k in range(40)] + [(100, rows[40][1]), (40, own(41))]
    assert sorted(got) == sorted((k, t, len(t)) for k, t in expected)
