"""Brown class-based bigram model: exchange clustering, class transitions and word emissions.

Counts of all words come from the whole training corpus. The most frequent words are known to every task by hash; the
counts and classes of all others are joined to the documents that have them. The CLUSTERED most frequent words are
clustered by exchange on their bigram counts; every other word joins the class that gains most by the classes of its
neighbours, first the frequent words by clustered neighbours, then all others by frequent ones. Words without such a
neighbour and unknown words are one class of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitscape.llm import textkit as kit
from fitscape.llm.shared import Scratch, most_frequent, small_slices, stored

#: Words broadcast with their counts (16 bytes each), and words clustered by exchange. Both bound what a task holds.
FREQUENT, CLUSTERED = 1 << 17, 1 << 11
CLASSES, SWEEPS = 48, 4
END = np.uint64(0x5EED0E4D0F7E8715)


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(first, hashes) of the texts' words, each text closed by END."""
    first, _, _, h = kit.words(texts, lower=True)
    return first + np.arange(len(first)), np.insert(h, first[1:], END)


def word_counts(rows: DataFrame) -> DataFrame:
    """w (hash), c: counts of all tokens of `_text`, summed in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in small_slices(batches, "_text", 8 << 20):
            w, c = np.unique(_tokens(texts)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], ["w", "c"])

    return rows.select("_text").mapInArrow(count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each in the sorted keys; len(keys) if it isn't there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, len(keys))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each word (word x word counts): each in turn moves to the class that gives the bigrams the most likelihood.

    The gain of a class is measured as the sum of n log n over the class bigrams less that over the margins, with the
    word's own row and column added to it.
    """
    n = len(bigrams)
    own = np.arange(n) % classes
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-12)), 0.0)
    one = np.zeros((n, classes))
    one[np.arange(n), own] = 1
    out_by, in_by = bigrams @ one, bigrams.T @ one  # word x class of the neighbour
    joint = one.T @ out_by
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            a, self_n = own[w], bigrams[w, w]
            row, col = out_by[w].copy(), in_by[w].copy()
            row[a] -= self_n
            col[a] -= self_n
            joint[a] -= row
            joint[:, a] -= col
            joint[a, a] -= self_n
            left, right = joint.sum(axis=1), joint.sum(axis=0)
            more_row, more_col = joint + row, joint + col[:, None]
            gain = (f(more_row) - f(joint)).sum(axis=1) + (f(more_col) - f(joint)).sum(axis=0)
            d = np.arange(classes)
            gain += f(joint[d, d] + row + col + self_n) - f(more_row[d, d]) - f(more_col[d, d]) + f(joint[d, d])
            gain -= f(left + row.sum() + self_n) - f(left) + f(right + col.sum() + self_n) - f(right)
            b = int(gain.argmax())
            joint[b] += row
            joint[:, b] += col
            joint[b, b] += self_n
            if b != a:
                moved += 1
                own[w] = b
                out_by[:, a] -= bigrams[:, w]
                out_by[:, b] += bigrams[:, w]
                in_by[:, a] -= bigrams[w]
                in_by[:, b] += bigrams[w]
        if moved * 200 < n:
            break
    return own


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-12)), 0.0)


def best_classes(word: np.ndarray, k: np.ndarray, n: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """Class of each word (0 to word.max()) that gains most likelihood by the word's counts n of neighbours; k: class of the next token, or classes + class of the one before."""
    classes, words = len(joint), int(word.max()) + 1
    gain = np.zeros((words, classes))
    order = np.argsort(word, kind="stable")
    word, k, n = word[order], k[order], n[order].astype(float)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    grid = np.concatenate([joint.T, joint])  # count of each class with neighbour k
    at = 0
    while at < len(first):  # so many counts at a time that the temporaries stay small
        stop = max(at + 1, int(np.searchsorted(first, first[at] + (1 << 15))))
        low, high = first[at], first[stop] if stop < len(first) else len(word)
        own = grid[k[low:high]]
        gain[word[first[at:stop]]] = np.add.reduceat(_xlogx(own + n[low:high, None]) - _xlogx(own), first[at:stop] - low, axis=0)
        at = stop
    for side, margin in ((k < classes, joint.sum(axis=1)), (k >= classes, joint.sum(axis=0))):
        total = np.bincount(word[side], n[side], minlength=words)[:, None]
        gain -= _xlogx(margin + total) - _xlogx(margin)
    return gain.argmax(axis=1)


def _assigned(entries: DataFrame, joint: np.ndarray) -> DataFrame:
    """w, cls of the words of `entries` (w, k, n: neighbour counts, a row for each word and k)."""
    shared = entries.sparkSession.sparkContext.broadcast(joint)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = batch.column("x")
                word = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                k, n = (lists.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("k", "n"))
                yield pa.RecordBatch.from_arrays([batch.column("w"), pa.array(best_classes(word, k, n, shared.value).astype(np.int32))], ["w", "cls"])

    return entries.groupBy("w").agg(F.collect_list(F.struct("k", "n")).alias("x")).mapInArrow(assign, "w long, cls int")


@dataclass
class ClassModel:
    words: np.ndarray  # sorted hashes of the frequent words
    counts: np.ndarray
    classes: np.ndarray  # of the frequent words
    transition: np.ndarray  # log10 of the class of the next token, by class
    emission: np.ndarray  # log10 of each frequent word in its class
    total: int  # training tokens
    distinct: int
    rare_class: int
    unknown: float  # the count that unknown words, as one, have in the rare class
    mass: np.ndarray  # tokens of each class

    def rare_emission(self, c: Column, cls: Column) -> Column:
        """log10 of a rare word with count c within its class, or of an unknown one (0) within the rare class."""
        return F.log10(F.when(c > 0, c.cast("double")).otherwise(F.lit(self.unknown)) / F.get(F.lit(self.mass.tolist()), cls))


def _counted(w: np.ndarray, k: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """w, k (below width) and the count of each pair."""
    words, own = np.unique(w, return_inverse=True)
    pair, n = np.unique(own * width + k, return_counts=True)
    return words[pair // width], pair % width, n


def _scan(rows: DataFrame, count, kind: str, scratch: Scratch) -> DataFrame:
    """Rows (w, v, k, n) that count(before, token) gives for the tokens of each slice of texts, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in small_slices(batches, "_text"):
            h = _tokens(texts)[1]
            for w, v, k, n in count(np.append(END, h[:-1]), h):
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(v.view(np.int64)), pa.array(k.astype(np.int32)), pa.array(n.astype(np.int64))], ["w", "v", "k", "n"])

    return scratch.stored(rows.select("_text").mapInArrow(run, "w long, v long, k int, n long").groupBy("w", "v", "k").agg(F.sum("n").alias("n")), kind)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, and the lists of b and n as bytes of longs."""
    for batch in batches:
        if batch.num_rows:
            lists, parts = batch.column("x"), []
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for f in ("b", "n"):
                flat = lists.flatten().field(f).to_numpy(zero_copy_only=False)
                parts.append(pa.array([flat[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("a"), *parts], ["a", "b", "n"])


def train(rows: DataFrame) -> tuple[ClassModel, DataFrame]:
    """The model of `_text`'s words and the table of all words (w), their counts (c) and classes (cls)."""
    spark = rows.sparkSession
    scratch = Scratch(spark)
    counts = scratch.stored(word_counts(rows), "word-counts")
    total, once, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") == 1), F.count("*")).first()
    top = most_frequent(counts, "c", FREQUENT).toPandas().sort_values(["c", "w"], ascending=[False, True])
    by_rank = top["w"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(by_rank)
    words, c = by_rank[order], top["c"].to_numpy(np.int64)[order]
    rank = order
    chosen = min(CLUSTERED, len(words))
    used = min(CLASSES, max(1, chosen))
    rare = CLASSES
    seeds = spark.sparkContext.broadcast((words, np.append(np.where(rank < chosen, rank, chosen), chosen)))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, state = seeds.value
        sums = np.zeros(chosen * chosen, np.int64)  # at most CLUSTERED squared
        for _, texts in small_slices(batches, "_text"):
            s = state[_lookup(keys, np.append(END, _tokens(texts)[1]))]
            both = (s[:-1] < chosen) & (s[1:] < chosen)
            k, n = np.unique(s[:-1][both] * chosen + s[1:][both], return_counts=True)
            sums[k] += n
        k = np.flatnonzero(sums)
        for low in range(0, len(k), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(k[low : low + (1 << 16)]), pa.array(sums[k[low : low + (1 << 16)]])], ["k", "n"])

    grams = np.zeros((chosen, chosen), np.float64)  # at most CLUSTERED squared, whatever the corpus
    got = rows.select("_text").mapInArrow(pairs, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    got = got.groupBy(F.floor(F.col("k") / max(1, chosen)).alias("a")).agg(F.collect_list(F.struct((F.col("k") % max(1, chosen)).alias("b"), "n")).alias("x"))
    for x in scratch.stored(got.mapInArrow(_packed, "a long, b binary, n binary"), "seed-bigrams").toLocalIterator():  # a row for each clustered word, a partition at a time
        grams[x["a"], np.frombuffer(x["b"], np.int64)] = np.frombuffer(x["n"], np.int64)
    scratch.clear("seed-bigrams")
    own = exchange(grams, used)
    one = np.zeros((chosen, CLASSES))
    one[np.arange(chosen), own] = 1
    joint = one.T @ grams @ one
    del grams, top

    # the other frequent words, by their neighbours among the clustered ones
    seed_class = np.append(own, rare)
    first = spark.sparkContext.broadcast((words, seed_class[np.append(np.where(rank < chosen, rank, chosen), chosen)]))

    def beside_seeds(before: np.ndarray, h: np.ndarray):
        keys, cls = first.value
        x, y = _lookup(keys, before), _lookup(keys, h)
        cx, cy = cls[x], cls[y]
        nexts, befores = (cx == rare) & (x < len(keys)) & (cy != rare), (cy == rare) & (y < len(keys)) & (cx != rare)
        w = np.concatenate([before[nexts], h[befores]])
        w, k, n = _counted(w, np.concatenate([cy[nexts], CLASSES + cx[befores]]), 2 * CLASSES)
        yield w, np.zeros(len(w), np.int64), k, n

    classes = seed_class[np.where(rank < chosen, rank, chosen)]
    if len(words) > chosen:
        more = _assigned(_scan(rows, beside_seeds, "seed-neighbours", scratch), joint).toPandas()
        classes[_lookup(words, more["w"].to_numpy(np.int64).view(np.uint64))] = more["cls"].to_numpy(np.int64)
        scratch.clear("seed-neighbours")

    # all bigrams: of two frequent words by class, of one by class and word, of two others by both words
    states = CLASSES + 1
    known = spark.sparkContext.broadcast((words, np.append(classes, rare)))

    def all_bigrams(before: np.ndarray, h: np.ndarray):
        keys, cls = known.value
        x, y = _lookup(keys, before), _lookup(keys, h)
        cx, cy, fx, fy = cls[x], cls[y], x < len(keys), y < len(keys)
        k, n = np.unique(cx[fx & fy] * states + cy[fx & fy], return_counts=True)
        yield np.zeros(len(k), np.int64), np.zeros(len(k), np.int64), k, n
        w = np.concatenate([before[~fx & fy], h[fx & ~fy]])
        w, k, n = _counted(w, np.concatenate([cy[~fx & fy], states + cx[fx & ~fy]]), 2 * states)
        yield w, np.zeros(len(w), np.int64), k + states * states, n
        two, n = np.unique(np.stack([before[~fx & ~fy], h[~fx & ~fy]], axis=1), axis=0, return_counts=True)
        yield np.ascontiguousarray(two[:, 0]), np.ascontiguousarray(two[:, 1]), np.full(len(n), -1), n

    grams = _scan(rows, all_bigrams, "bigrams", scratch)
    joint = np.zeros((states, states))

    def add(sums: DataFrame) -> None:
        for x in sums.groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # at most states squared
            joint[x["a"], x["b"]] += x["n"]

    add(grams.filter(F.col("k").between(0, states * states - 1)).select(F.floor(F.col("k") / states).alias("a"), (F.col("k") % states).alias("b"), "n"))
    single = grams.filter(F.col("k") >= states * states).select("w", (F.col("k") - states * states).alias("k"), "n")

    def of_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, cls = known.value
        cls = np.append(cls[:-1], -1)
        for batch in batches:
            at = _lookup(keys, batch.column("w").to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column("w"), batch.column("c"), pa.array(cls[at].astype(np.int32))], ["w", "c", "own"])

    near = single.filter(F.col("k") % states != rare).select("w", F.when(F.col("k") < states, F.col("k")).otherwise(F.col("k") - 1).cast("int").alias("k"), "n")
    rest = _assigned(near, joint[:CLASSES, :CLASSES].copy())
    counts = stored(
        counts.mapInArrow(of_frequent, "w long, c long, own int").join(rest, "w", "left").select("w", "c", F.when(F.col("own") >= 0, F.col("own")).otherwise(F.coalesce("cls", F.lit(rare))).cast("int").alias("cls")), "word-classes"
    )
    named = lambda w, cls: counts.select(F.col("w").alias(w), F.col("cls").alias(cls))
    other = F.col("k") % states
    add(single.join(named("w", "cls"), "w").select(F.when(F.col("k") < states, F.col("cls")).otherwise(other).alias("a"), F.when(F.col("k") < states, other).otherwise(F.col("cls")).alias("b"), "n"))
    add(grams.filter("k = -1").join(named("w", "a"), "w").join(named("v", "b"), "v").select("a", "b", "n"))
    # tokens of unknown words are as frequent as words seen once (Good and Turing), behind any class
    unknown = max(0.5, float(once))
    joint[:, rare] += unknown * joint.sum(axis=1) / max(1.0, joint.sum())
    unigram = (joint.sum(axis=0) + 0.5) / (joint.sum() + 0.5 * states)
    strength = 20.0
    transition = np.log10((joint + strength * unigram) / (joint.sum(axis=1, keepdims=True) + strength))
    mass = np.zeros(states)
    for x in counts.groupBy("cls").agg(F.sum("c").alias("c")).collect():
        mass[x["cls"]] = x["c"]
    mass[rare] += unknown
    scratch.clear()
    emission = np.log10(c / mass[classes]) if len(c) else np.zeros(0)
    return ClassModel(words, c, classes, transition, emission, int(total), int(distinct), rare, unknown, mass), counts


def score(docs: DataFrame, model: ClassModel, counts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, n_known, base_score, score, and perplexity (10 to the mean negative score).

    score is the sum over tokens, the text's end included, of log10 P(class | class before) + log10 P(word | class);
    base_score is the unigram score with 0.5 added to each count. Null texts are empty: one token, the end. Null ids and
    repeated rows are scored like others; an empty table gives none; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        classes, emission = np.append(m.classes, m.rare_class), np.append(m.emission, 0.0)
        base = np.append(np.log10((m.counts + 0.5) / (m.total + 0.5 * (m.distinct + 1))), 0.0)
        for batch, texts in small_slices(batches, "_text"):
            first, h = _tokens(texts)
            at = _lookup(m.words, h)
            before = np.append(END, h[:-1])
            at_before = np.append(_lookup(m.words, np.array([END])), at[:-1])
            c, c_before = classes[at], classes[at_before]
            rare, rare_before = at == len(m.words), at_before == len(m.words)
            open_ = rare | rare_before  # bigrams whose classes aren't known here
            step = np.where(open_, 0.0, m.transition[c_before, c])
            sums = [np.add.reduceat(x, first[:-1]) for x in (base[at], step + emission[at], (at < len(m.words)).astype(np.int64))]
            own_w, own_n = [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                w, n = np.unique(h[a:b][rare[a:b]].view(np.int64), return_counts=True)
                own_w.append(w), own_n.append(n)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (own_w, own_n)]
            cut = pa.array(np.append(0, np.cumsum(np.add.reduceat(open_.astype(np.int64), first[:-1]))).astype(np.int32))
            side = lambda hashes, cls, is_rare: pa.ListArray.from_arrays(cut, pa.array(np.where(is_rare, hashes.view(np.int64), cls)[open_]))  # noqa: E731, B023
            kind_ = pa.ListArray.from_arrays(cut, pa.array((rare_before + 2 * rare)[open_].astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(first)), *(pa.array(x) for x in sums), *lists, side(before, c_before, rare_before), side(h, c, rare), kind_], ["doc_id", "n_tokens", "base", "lm", "known", "w", "n", "a", "b", "k"]
            )

    kind = f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, base double, lm double, known long, w array<long>, n array<long>, a array<long>, b array<long>, k array<int>"
    part = stored(rows.mapInArrow(known, kind).withColumn("_row", F.monotonically_increasing_id()), "scored")
    rare = part.select("_row", F.explode(F.arrays_zip("w", "n")).alias("x")).select("_row", F.col("x.w").alias("w"), F.col("x.n").alias("n")).join(counts, "w", "left")
    rare = rare.withColumn("c", F.coalesce("c", F.lit(0))).withColumn("cls", F.coalesce("cls", F.lit(model.rare_class)))
    more = rare.groupBy("_row").agg(
        F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / F.lit(model.total + 0.5 * (model.distinct + 1)))).alias("more_base"),
        F.sum(F.col("n") * model.rare_emission(F.col("c"), F.col("cls"))).alias("more_lm"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.collect_list("w").alias("_w"), F.collect_list("cls").alias("_c"),
    )
    end = counts.filter(F.col("w") == int(np.array([END]).view(np.int64)[0])).select("cls").first()
    end_class = int(end["cls"]) if end else model.rare_class

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the transitions of the bigrams left open."""
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = lambda x: batch.column(x).flatten().to_numpy(zero_copy_only=False)  # noqa: E731, B023
            words, place = np.unique(np.append(flat("_w"), np.array([END]).view(np.int64)), return_index=True)
            cls = np.append(flat("_c"), end_class)[place]
            a, b, k = flat("a"), flat("b"), flat("k")
            of = lambda x, is_rare: np.where(is_rare, cls[np.minimum(np.searchsorted(words, x), len(words) - 1)], np.where(is_rare, 0, x)).astype(np.int64)  # noqa: E731, B023
            step = m.transition[of(a, k % 2 == 1), of(b, k >= 2)]
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("a").offsets.to_numpy()))
            lm = batch.column("lm").to_numpy(zero_copy_only=False) + np.bincount(row, step, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "n_tokens", "n_known", "base_score")), pa.array(lm)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    none = lambda x, kind: F.coalesce(x, F.expr(f"cast(array() as array<{kind}>)")).alias(x)
    joined = part.join(more, "_row", "left").select(
        "doc_id", "n_tokens", add("known", "more_known").cast("long").alias("n_known"), add("base", "more_base").alias("base_score"), add("lm", "more_lm").alias("lm"), "a", "b", "k", none("_w", "long"), none("_c", "int")
    )
    out = joined.mapInArrow(steps, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def score_documents(docs: DataFrame, training: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score() under a model of all rows of `training`, with train_tokens added."""
    model, counts = train(training.select(F.col(text_col).alias("_text")))
    return score(docs, model, counts, id_col=id_col, text_col=text_col).withColumn("train_tokens", F.lit(model.total).cast("long"))
