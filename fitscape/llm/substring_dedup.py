"""Substring deduplication by relative Lempel-Ziv parsing against the earlier documents.

Equal windows of `min_words` words hold the same anchor (the 8-word sequence of least hash), so a document is cut into
segments, each the words of successive windows with one anchor, and only segments whose anchor stands in several
documents can repeat anything. Segments are dealt to reference blocks by their anchor: a document is thus parsed against
every block that has a passage for it, and no window is cut by a block's border. A block is indexed by its suffix order,
and each of its segments is parsed greedily: at each place the longest factor that stands in a segment of a smaller id.
Factors of at least `min_words` words are duplicate spans; windows across a factor's end, which the greedy parse would
cut in two, are looked up by themselves.

Anchors that stand in more than HOT_SEGMENTS segments would make a block of any size. Their windows are counted
themselves, by hash, where equal ones fall together before anything is shuffled.

Which anchors repeat, and which of them are hot, goes to the tasks as Bloom filters of fixed size; what these let
through by mistake costs time, never a wrong result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitscape.llm import textkit as kit
from fitscape.llm.shared import Scratch, small_slices

SEED_WORDS = 8
#: Segments of one anchor that a block takes at most, words of a block, which one anchor's segments don't exceed either (about 6 MB of text), and rows of a broadcast table of hot windows (16 bytes each).
HOT_SEGMENTS, BLOCK_WORDS, BROADCAST_WINDOWS = 512, 1_000_000, 1_000_000


def _slide(a: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over every run of `width` values, by doubling."""
    done = 1
    while done * 2 <= width:
        a = op(a[:-done], a[done:])
        done *= 2
    return op(a[: len(a) - (width - done)], a[width - done :]) if width > done else a


def _anchored(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one document of at least `window` words, its segments: anchor, first window and end of the windows."""
    seed = min(SEED_WORDS, window)
    least = _slide(kit.ngrams(hashes, seed), window - seed + 1, np.minimum)
    begin = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    return least[begin], begin, np.append(begin[1:], len(least))


def bloom_of(keys: DataFrame, column: str, words: int) -> np.ndarray:
    """Two bits for each key in one of `words` 64-bit words; the result's size depends on `words` alone."""
    k = F.col(column)
    mask = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, 40) & 63 as int)) | shiftleft(1L, cast(shiftrightunsigned({column}, 46) & 63 as int))")
    rows = keys.select(F.pmod(k, F.lit(words)).alias("w"), mask.alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    out = np.zeros(words, np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["m"].to_numpy(np.int64)
    return out.view(np.uint64)


def in_bloom(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = filter_[np.mod(hashes.view(np.int64), len(filter_))]
    one = np.uint64(1)
    mask = (one << ((hashes >> np.uint64(40)) & np.uint64(63))) | (one << ((hashes >> np.uint64(46)) & np.uint64(63)))
    return (at & mask) == mask


def _key(id_col: str, text_col: str) -> Column:
    """Equal for rows of one id and text only."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


class Reference:
    """A block of segments in suffix order, with the longest match of each place in a segment of a smaller document, and that document."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, docs: np.ndarray):
        """hashes: the words of all segments, those of segment i at first[i]:first[i + 1], of document docs[i]."""
        size = np.diff(first)
        segment = np.repeat(np.arange(len(size)), size + 1)
        self.first = first + np.arange(len(first))  # each segment is closed by a symbol of its own
        n = len(segment)
        words = np.unique(hashes, return_inverse=True)[1]
        text = np.empty(n, np.int64)
        ends = self.first[1:] - 1
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside], text[ends] = words, (words.max() + 1 if len(words) else 0) + np.arange(len(ends))
        self.ranks, rank, order, done = [text.astype(np.int32)], text, np.argsort(text), 1
        while done < size.max(initial=1) and (done == 1 or rank[order[-1]] < n - 1):
            key = rank * (n + 2)
            key[: max(0, n - done)] += rank[done:] + 1
            order = np.argsort(key)
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(0, key[1:] != key[:-1]))
            self.ranks.append(rank.astype(np.int32))
            done *= 2
        own = docs[segment]
        self.length, self.source = np.zeros(n, np.int64), np.zeros(n, docs.dtype)
        for neighbour in (_before(own[order]), n - 1 - _before(own[order][::-1])[::-1]):
            has = (neighbour >= 0) & (neighbour < n)
            at, other = order[has], order[neighbour[has]]
            found = self._common(at, other)
            better = found > self.length[at]
            self.length[at[better]], self.source[at[better]] = found[better], own[other[better]]
        self.length[ends] = 0

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and b have in common."""
        n, out = len(self.length), np.zeros(len(a), np.int64)
        todo = np.arange(len(a))
        for level in range(len(self.ranks) - 1, -1, -1):
            while True:
                x, y = a[todo] + out[todo], b[todo] + out[todo]
                ok = (x < n) & (y < n)
                ok[ok] = self.ranks[level][x[ok]] == self.ranks[level][y[ok]]
                out[todo[ok]] += 1 << level
                if level < len(self.ranks) - 1 or not ok.any():
                    break
                todo = todo[ok]
            todo = np.arange(len(a))
        return out

    def parse(self) -> tuple[np.ndarray, np.ndarray]:
        """(segment, place of its start) of all factors of all segments, parsed greedily in step; a word without a match is a factor of its own."""
        at, segment = self.first[:-1].copy(), np.arange(len(self.first) - 1)
        end = self.first[1:] - 1
        owners, starts = [], []
        while len(segment):
            on = at < end[segment]
            at, segment = at[on], segment[on]
            owners.append(segment), starts.append(at)
            at = at + np.maximum(1, self.length[at])
        return np.concatenate(owners or [segment]), np.concatenate(starts or [at])

    def duplicates(self, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(segment, begin, length, source document) of the long factors, and of the long matches that begin near a factor's end; begin counts from the segment's first word."""
        segment, start = self.parse()
        length = np.maximum(1, self.length[start])
        # a window that begins in the last min_words - 1 words of a factor crosses its end
        near = np.minimum(length, min_words - 1)
        owner = np.repeat(segment, near)
        place = np.repeat(start + length, near) - 1 - (np.arange(near.sum()) - np.repeat(np.cumsum(near) - near, near))
        segment, start = np.concatenate([segment, owner]), np.concatenate([start, place])
        found = self.length[start] >= min_words
        segment, start = segment[found], start[found]
        return segment, start - self.first[segment], self.length[start], self.source[start]


def _before(values: np.ndarray) -> np.ndarray:
    """Of each place the nearest one before it with a smaller value, -1 if there is none."""
    values = np.append(values, np.iinfo(values.dtype).min)  # at place -1
    near = np.arange(-1, len(values) - 2)
    todo = np.arange(len(near))
    while True:
        todo = todo[(near[todo] >= 0) & (values[near[todo]] >= values[todo])]
        if not len(todo):
            return near
        near[todo] = near[near[todo]]


def duplicate_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, bloom_words: int = 1 << 20) -> DataFrame:
    """_key of a row (xxhash64 of id and text) and `found`: spans (begin, end: word positions; source: a smaller id that has them) that together cover the windows that also start in a smaller id."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"), _key(id_col, text_col).alias("_key"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("_text").isNotNull())

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in small_slices(batches, "_text"):
            first, _, _, h = kit.words(texts)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            parts = [(*_anchored(h[first[i] : first[i + 1]], min_words), i) for i in range(len(texts)) if first[i + 1] - first[i] >= min_words]
            if parts:
                a, d = np.concatenate([x[0] for x in parts]), np.repeat(ids[[x[3] for x in parts]], [len(x[0]) for x in parts])
                size = np.concatenate([x[2] - x[1] for x in parts]) + min_words - 1
                order = np.argsort(a, kind="stable")
                a, d, size = a[order], d[order], size[order]
                cut = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                columns = [a[cut].view(np.int64), np.minimum.reduceat(d, cut), np.maximum.reduceat(d, cut), np.diff(np.append(cut, len(a))), np.add.reduceat(size, cut)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a", "low", "high", "n", "words"])

    scratch = Scratch(spark)
    spread = rows.mapInArrow(anchors, "a long, low long, high long, n long, words long").groupBy("a")
    spread = spread.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.sum("words").alias("words")).filter("low < high").select("a", "n", "words")
    spread = scratch.stored(spread, "anchors")
    many = (F.col("n") > HOT_SEGMENTS) | (F.col("words") > BLOCK_WORDS)
    total, n_hot = spread.agg(F.coalesce(F.sum("words"), F.lit(0)), F.count_if(many)).first()
    shared = spark.sparkContext.broadcast((bloom_of(spread, "a", bloom_words), bloom_of(spread.filter(many), "a", bloom_words) if n_hot else None))
    scratch.clear()

    def segments(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Text, its word hashes, starts and ends, and of each segment whose anchor repeats: anchor, windows, and whether it is hot."""
        known, hot = shared.value
        first, start, end, h = kit.words(texts)
        for i in range(len(texts)):
            own = slice(first[i], first[i + 1])
            if first[i + 1] - first[i] < min_words:
                continue
            a, low, high = _anchored(h[own], min_words)
            on = in_bloom(known, a)
            if on.any():
                a, low, high = a[on], low[on], high[on]
                yield i, h[own], start[own], end[own], a, low, high, np.zeros(len(a), bool) if hot is None else in_bloom(hot, a)

    def places(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        size = high - low
        return np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())

    # windows of hot anchors: the smallest document of each that stands in several
    hot_windows, few = None, None
    if n_hot:

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in small_slices(batches, "_text"):
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                found = []
                for i, h, _, _, _, low, high, hot in segments(texts):
                    at = places(low[hot], high[hot])
                    w = kit.ngrams(h, min_words)[at] if len(at) else np.zeros(0, np.uint64)
                    found.append((w, np.full(len(w), ids[i], np.int64)))
                if found:
                    w, d = (np.concatenate(x) for x in zip(*found, strict=True))
                    order = np.lexsort((d, w))
                    w, d = w[order], d[order]
                    cut = np.flatnonzero(np.append(True, w[1:] != w[:-1])[: len(w)])
                    last = np.append(cut[1:], len(w))[: len(cut)] - 1
                    yield pa.RecordBatch.from_arrays([pa.array(w[cut].view(np.int64)), pa.array(d[cut]), pa.array(d[last])], ["w", "low", "high"])

        hot_windows = rows.mapInArrow(count, "w long, low long, high long").groupBy("w").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high").select("w", "low")
        hot_windows = scratch.stored(hot_windows, "hot-windows")
        if hot_windows.count() <= BROADCAST_WINDOWS:
            table = hot_windows.toPandas().sort_values("w")
            few = spark.sparkContext.broadcast((table["w"].to_numpy(np.int64), table["low"].to_numpy(np.int64)))

    span = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("source", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments with their words; hot ones as spans (few hot windows) or as windows."""
        for batch, texts in small_slices(batches, "_text"):
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "_key"))
            out: list[tuple] = []
            for i, h, start, end, a, low, high, hot in segments(texts):
                for anchor, at, last in zip(a[~hot].view(np.int64).tolist(), low[~hot].tolist(), (high[~hot] + min_words - 2).tolist(), strict=True):
                    out.append((anchor, ids[i], keys[i], at, texts[i][start[at] : end[last]], None))
                if hot.any():
                    at = places(low[hot], high[hot])
                    w = kit.ngrams(h, min_words)[at].view(np.int64)
                    if few is None:
                        out += [(x, ids[i], keys[i], y, None, None) for x, y in zip(w.tolist(), at.tolist(), strict=True)]
                        continue
                    table, smallest = few.value
                    if not len(table):
                        continue
                    place = np.minimum(np.searchsorted(table, w), len(table) - 1)
                    late = (table[place] == w) & (smallest[place] < ids[i])
                    at, source = at[late], smallest[place[late]]
                    new = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(source, prepend=0) != 0))
                    stop = at[np.append(new[1:], len(at))[: len(new)] - 1] + min_words
                    out += [(x, ids[i], keys[i], x, None, {"begin": x, "end": y, "source": z}) for x, y, z in zip(at[new].tolist(), stop.tolist(), source[new].tolist(), strict=True)]
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), span), strict=True)], ["a", "d", "_key", "at", "s", "span"])

    def parse(table: pa.Table) -> pa.Table:
        """The duplicate spans of a block's segments, besides those that are known."""
        known = table.filter(pc.is_valid(table.column("span"))).select(["_key", "span"])
        table = table.filter(pc.is_valid(table.column("s")))
        first, _, _, h = kit.words(table.column("s").to_pylist())
        segment, begin, length, source = Reference(h, first, table.column("d").to_numpy()).duplicates(min_words)
        begin = begin + table.column("at").to_numpy()[segment]
        spans = pa.StructArray.from_arrays([pa.array(begin.astype(np.int32)), pa.array((begin + length).astype(np.int32)), pa.array(source.astype(np.int64))], fields=list(span))
        return pa.concat_tables([known, pa.table({"_key": pa.array(table.column("_key").to_numpy()[segment]), "span": spans})])

    of_span = "struct<begin:int,end:int,source:bigint>"
    pieces = rows.mapInArrow(cut, f"a long, d long, _key long, at int, s binary, span {of_span}")
    if few is None and n_hot:
        late = pieces.filter("s is null").join(hot_windows.withColumnRenamed("w", "a"), "a").filter("low < d")
        late = late.select("_key", F.struct(F.col("at").alias("begin"), (F.col("at") + min_words).alias("end"), F.col("low").alias("source")).alias("span"))
        pieces = pieces.filter("s is not null")
    block = F.pmod(F.when(F.col("s").isNull(), F.col("_key")).otherwise(F.col("a")), F.lit(1 + total // BLOCK_WORDS))
    found = pieces.select("d", "_key", "at", "s", "span", block.alias("block")).groupBy("block").applyInArrow(parse, f"_key long, span {of_span}")
    if few is None and n_hot:
        found = found.unionByName(late)
    return found.groupBy("_key").agg(F.collect_list("span").alias("found"))


def merged(spans: np.ndarray) -> np.ndarray:
    """Rows of begin and end, in order, with those that touch or overlap joined."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    cut = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.stack([spans[cut, 0], reach[np.append(cut[1:], len(spans)) - 1]], axis=1)


def parsed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, bloom_words: int = 1 << 20) -> DataFrame:
    """docs with a column __cut: n_words, n_removed, spans, factors and kept_text of substring_dedup()."""
    place, plain = docs.columns.index(text_col), [f"c{k}" for k in range(len(docs.columns))]
    found = duplicate_spans(docs, id_col=id_col, text_col=text_col, min_words=min_words, bloom_words=bloom_words)
    rows = docs.toDF(*plain).withColumn("_key", _key(plain[docs.columns.index(id_col)], plain[place])).join(found, "_key", "left").select(*plain, "found")
    span, factor = pa.struct([("begin", pa.int32()), ("end", pa.int32())]), pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("source", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in small_slices(batches, plain[place]):
            n_words, n_removed, spans, kept = [], [], [], []
            for text, factors in zip(texts, batch.column("found").to_pylist(), strict=True):
                own = text.split()
                parts = merged(np.array([(x["begin"], x["end"]) for x in factors or []], np.int64).reshape(-1, 2)).tolist()
                n_words.append(len(own)), n_removed.append(sum(b - a for a, b in parts))
                spans.append([{"begin": a, "end": b} for a, b in parts])
                stays = [w for a, b in zip([0, *(b for _, b in parts)], [*(a for a, _ in parts), len(own)], strict=True) for w in own[a:b]]
                kept.append(b" ".join(stays).decode())
            fields = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(span)), batch.column("found").cast(pa.list_(factor)), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.StructArray.from_arrays(fields, ["n_words", "n_removed", "spans", "factors", "kept_text"])], [*plain, "cut"])

    of_cut = "cast(null as struct<n_words:bigint,n_removed:bigint,spans:array<struct<begin:int,end:int>>,factors:array<struct<begin:int,end:int,source:bigint>>,kept_text:string>)"
    schema = rows.drop("found").withColumn("cut", F.expr(of_cut)).schema
    return rows.mapInArrow(cut, schema).toDF(*docs.columns, "__cut")


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, bloom_words: int = 1 << 20) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, spans (begin, end: word positions, merged), factors (begin, end, source: the long factors of the parse and the smaller id that has each; null if none), kept_text.

    Words are runs without white space. Removed is each word inside a window of min_words words whose words also start
    in a row with a smaller id; ids are integers (others raise an error). kept_text joins the other words with one space.
    Null texts have no words and give a kept_text of ''; rows with a null id are neither reference nor shortened; rows
    with one id don't remove each other; very long texts are cut like others; an empty table gives none. Extra columns are
    ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return parsed(rows, min_words=min_words, bloom_words=bloom_words).select("doc_id", "__cut.*")
