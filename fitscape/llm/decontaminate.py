"""Benchmark decontamination with an FM-index for each training shard.

A shard is a few MB of a task's documents. Its text is written in the alphabet of the test phrases: a word that no
phrase has, and the end of a document, are one separator that no phrase can cross. Over that text the shard has a
Burrows-Wheeler transform (suffixes ordered by their first words, as far as the longest phrase goes), a wavelet tree
that answers ranks, and every SAMPLE-th text position. Phrases are searched backward, all at once; the occurrences
of a range are located by stepping back to a sampled position, and merged into spans of removed words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitscape.llm import textkit as kit
from fitscape.llm.shared import Scratch, delete, small_slices

SAMPLE = 8


class WaveletTree:
    """Ranks of symbols: one bit vector for each bit of a symbol, rows stably parted by the higher bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, self.zeros = [], []
        for shift in range(bits - 1, -1, -1):
            bit = (symbols >> shift) & 1
            ones = np.zeros(len(bit) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((shift, ones))
            self.zeros.append(len(bit) - int(ones[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        low, high = np.zeros_like(at), at
        for (shift, ones), zeros in zip(self.levels, self.zeros, strict=True):
            one = ((symbol >> shift) & 1).astype(bool)
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low


class FMIndex:
    def __init__(self, text: np.ndarray):
        """text: symbols from 1; 0 is put behind it. Suffixes are sorted by prefix doubling."""
        text = np.append(text, 0).astype(np.int64)
        n, done = len(text), 1
        rank = np.unique(text, return_inverse=True)[1]  # below n, as the keys need
        while True:
            key = rank * (n + 2)
            key[: max(0, n - done)] += rank[done:] + 1
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(0, key[1:] != key[:-1]))
            if rank[order[-1]] == n - 1:
                break
            done *= 2
        self.n = n
        self.bwt = text[order - 1]
        self.tree = WaveletTree(self.bwt, max(1, int(text.max()).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.sampled = np.where(order % SAMPLE == 0, order, -1)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each phrase (rows of symbols, padded on the right); empty if low == high."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            on = np.flatnonzero((lengths > k) & (low < high))
            s = phrases[on, k]
            known = s < len(self.before) - 1
            on, s, out = on[known], s[known], on[~known]
            low[on], high[on] = self.before[s] + self.tree.rank(s, low[on]), self.before[s] + self.tree.rank(s, high[on])
            low[out] = high[out] = 0
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: each steps back until it is at a sampled one."""
        rows, out, steps = rows.copy(), np.full(len(rows), -1, np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            at = self.sampled[rows[open_]]
            out[open_[at >= 0]] = at[at >= 0] + steps
            open_ = open_[at < 0]
            s = self.bwt[rows[open_]]
            rows[open_] = self.before[s] + self.tree.rank(s, rows[open_])
            steps += 1
        return out


class Phrases:
    """The distinct windows of test items, in the symbols 2.. of their own vocabulary (1 is the separator)."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int):
        first, _, _, h = kit.words([t for _, t in items], kit.ALNUM_WORDS, lower=True)
        self.vocabulary = np.unique(h)
        symbols = np.searchsorted(self.vocabulary, h) + 2
        owners: dict[bytes, set[str]] = {}
        for i, (name, _) in enumerate(items):
            own = symbols[first[i] : first[i + 1]].astype(np.int32)
            for j in range(max(1, len(own) - size + 1) if len(own) else 0):
                owners.setdefault(own[j : j + size].tobytes(), set()).update([name] if name is not None else [])
        self.owners = [sorted(x) for x in owners.values()]
        rows = [np.frombuffer(x, np.int32) for x in owners]
        self.lengths = np.array([len(x) for x in rows], np.int64)
        self.rows = np.zeros((len(rows), size), np.int64)
        for i, x in enumerate(rows):
            self.rows[i, : len(x)] = x
        self.likely = np.zeros(1 << 18, bool)
        self.likely[self.vocabulary & np.uint64((1 << 18) - 1)] = True

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """0 for words that no phrase has."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.likely[hashes & np.uint64((1 << 18) - 1)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 2, 0)
        return out


def search_shard(first: np.ndarray, hashes: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, list[set[str]]]:
    """Flags of the words (of all the shard's documents) inside an occurrence, and the items found in each document."""
    hit, items = np.zeros(len(hashes), bool), [set() for _ in first[1:]]
    if not len(hashes) or not len(phrases.rows):
        return hit, items
    symbols = phrases.symbols(hashes)
    change = np.diff(symbols > 0, prepend=False, append=False)
    change[first] |= np.append(symbols > 0, False)[first]
    change[first[1:]] |= symbols[np.maximum(first[1:] - 1, 0)] > 0
    # runs of the phrases' words inside one document; shorter ones than any phrase hold none
    edge = np.unique(np.concatenate([np.flatnonzero(change), first]))
    low, high = edge[:-1], edge[1:]
    use = (symbols[low] > 0) & (high - low >= phrases.lengths.min())
    low, high = low[use], high[use]
    if not len(low):
        return hit, items
    size = high - low + 1
    begin = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(low - begin[:-1], size) + np.arange(begin[-1])  # of each symbol among the words
    text = symbols[np.minimum(place, len(symbols) - 1)]
    text[begin[1:] - 1] = 1
    index = FMIndex(text)
    a, b = index.search(phrases.rows, phrases.lengths)
    found = np.flatnonzero(a < b)
    times = b[found] - a[found]
    which = np.repeat(found, times)
    rows = np.repeat(a[found] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum()) if len(found) else np.zeros(0, np.int64)
    at = place[index.locate(rows)] if len(rows) else rows
    lengths = phrases.lengths[which]
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + lengths, -1)
    hit = np.cumsum(change[:-1]) > 0
    pairs = np.unique(np.stack([np.searchsorted(first, at, side="right") - 1, which]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
    for d, p in pairs.T.tolist():
        items[d].update(phrases.owners[p])
    return hit, items


def searched(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_bytes: int = 8 << 20, blocks_at_once: int = 4) -> DataFrame:
    """docs with a column __found: n_words, n_hit, spans and items of decontaminate(). The docs aren't shuffled: up to blocks_at_once blocks of test items are searched for in one pass over them, and what each pass but the last finds is stored, so that no more blocks are on the driver and executors."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    tests = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t")).filter("t is not null").distinct()
    total = tests.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = 1 + total // block_bytes
    place = docs.columns.index(text_col)
    plain = [f"c{k}" for k in range(len(docs.columns))]
    out = docs.toDF(*plain).withColumn("__found", F.expr("cast(null as struct<n_words:bigint,n_hit:bigint,spans:array<struct<begin:int,end:int>>,items:array<string>>)"))
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    if blocks > 1:
        tests = scratch.stored(tests, "benchmark-items")
    live: list[Broadcast] = []

    def of_block(items: list[tuple[str | None, bytes]], rows: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)
        live.append(shared)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(shared.value, window)
            for batch, texts in small_slices(batches, plain[place]):
                first, _, _, h = kit.words(texts, kit.ALNUM_WORDS, lower=True)
                hit, found = search_shard(first, h, phrases)
                spans, names, n_hit = [], [], []
                for i, before in enumerate(batch.column("__found").to_pylist()):
                    own = hit[first[i] : first[i + 1]]
                    for x in before["spans"] if before else ():
                        own[x["begin"] : x["end"]] = True
                    n_hit.append(int(own.sum()))
                    low, high = kit.runs_of(own) if n_hit[-1] else ((), ())
                    spans.append([{"begin": int(a), "end": int(b)} for a, b in zip(low, high, strict=True)])
                    names.append(sorted(found[i].union(before["items"] if before else ())))
                fields = [pa.array(np.diff(first)), pa.array(n_hit, pa.int64()), pa.array(spans, span), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.StructArray.from_arrays(fields, ["n_words", "n_hit", "spans", "items"])], batch.schema.names)

        return rows.mapInArrow(search, rows.schema)

    for k in range(blocks):
        if k and k % blocks_at_once == 0:
            before = scratch.paths.pop("found", [])
            out = scratch.stored(out, "found")
            for path in before:
                delete(spark, path)
            while live:
                live.pop().destroy()
        part = tests.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()
        out = of_block([(x["i"], x["t"].encode()) for x in part], out)
    scratch.clear("benchmark-items")
    return out.toDF(*docs.columns, "__found")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, min_share: float = 0.05, block_bytes: int = 8 << 20
) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, spans (begin, end: word positions to remove), items (ids as strings, sorted), contaminated.

    Words are lower-cased runs of letters, digits and non-ASCII characters. A phrase is `window` successive words of an
    item, or a shorter item whole; contaminated is n_hit > 0 and n_hit >= min_share * n_words. Null texts have no words;
    items with a null text count as absent; one with a null id is searched for but not listed; items with one id are one
    item; a document with a null id is judged like any other; very long texts are a shard of their own; an empty
    benchmark hits nothing; repeated rows each get their row; extra columns are ignored. The test items are broadcast in
    blocks of about block_bytes of text, dealt by id and text, so that neither equal ids nor repeated items fill a block.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = searched(rows, benchmark, item_col=item_col, item_text_col=item_text_col, window=window, block_bytes=block_bytes).select("doc_id", "__found.*")
    return out.select("doc_id", "n_words", "n_hit", "spans", "items", contaminated(F.col("n_hit"), F.col("n_words"), min_share).alias("contaminated"))


def contaminated(n_hit: Column, n_words: Column, min_share: float = 0.05) -> Column:
    return (n_hit > 0) & (n_hit >= min_share * n_words)
