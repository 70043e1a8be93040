"""N-gram Jaccard join: grouped prefix filter, then exact verification of the members, to components of links.

A set's shingles are put in one order for all documents: least known frequency first, then by hash. Two sets can only
be similar enough if their prefixes (the first n - ceil(t * n) + 1 shingles) share shingles, more the larger they are.
Documents with the same prefix and size form one group, a shingle's list holds groups, and pairs of groups are filtered
by size and place; what is left is expanded to pairs of member sets and verified.

A short list gives all its pairs at once. Long lists (and those of shingles known to be frequent, which no window ever
sees) are first compared with one leader for each class of sizes; when leaders have joined what they can, all their
pairs that still cross components are compared. Components need no pair whose ends are known to be connected, so a
group of n near copies takes about n comparisons instead of n * n / 2, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitscape.llm import textkit as kit
from fitscape.llm.components import components
from fitscape.llm.shared import Scratch, discard, most_frequent, small_slices, stored

#: Shingles of which a frequency is broadcast at most (16 bytes each). Others count as rare: the order stays the same for all.
FREQUENT = 1 << 18
#: Numbers broadcast at most to fetch the sets of pairs (8 MB); more are joined by shuffle.
BROADCAST_IDS = 1 << 20
#: Groups of a short list, and the known frequency from which a shingle's list counts as long without being read.
SHORT, HOT = 16, 64
#: Sets that are compared with one set in one task.
PARTNERS = 32


#: Columns of a set's parity bits.
BITS = ("b0", "b1", "b2", "b3")


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles: `size` words, or all words of a shorter text."""
    first, _, _, h = kit.words(texts, lower=True)
    grams = kit.ngrams(h, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(grams[a : b - size + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        else:
            out.append(kit.ngrams(h[a:b], b - a) if b > a else h[a:b])
    return out


def _digest(hashes: np.ndarray, seed: int) -> np.int64:
    """Of a set or sequence of hashes, with its place in it."""
    return (kit.mix(hashes + np.uint64(seed) + np.arange(len(hashes), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)).view(np.int64)


def _odd(hashes: np.ndarray, classes: int) -> np.ndarray:
    """Whether each of so many classes of hashes has an odd number of members, as longs. Two sets differ by at least as many members as bits."""
    odd = np.bincount((hashes >> np.uint64(20) & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _parity(hashes: np.ndarray) -> np.ndarray:
    """Parities of about four to eight classes a member; the first half and the second, put together, are those of half as many classes."""
    return _odd(hashes, 1 << max(8, int(4 * len(hashes) - 1).bit_length()))


def _folded(wide: np.ndarray) -> list[int]:
    """Parities of 256 classes."""
    while len(wide) > 4:
        wide = wide[: len(wide) // 2] ^ wide[len(wide) // 2 :]
    return wide.tolist()


def _frequent(rows: DataFrame, size: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that repeat inside some slice of a task, with the sum of these counts; the most frequent FREQUENT ones.

    A shingle in more sets than there are slices must repeat in one, so no very frequent one is missed. This sets the
    order of shingles only; the result is the same under any order.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in small_slices(batches, "_text"):
            sets = {_digest(x, 1): x for x in shingle_sets(texts, size) if len(x)}
            if sets:
                s, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(s[n > 1].view(np.int64)), pa.array(n[n > 1])], ["s", "n"])

    counts = scratch.stored(rows.mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter("n >= 8"), "frequent")
    top = most_frequent(counts, "n", FREQUENT).toPandas()
    s, n = top["s"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(s)
    return s[order], n[order]


def _prefixes(rows: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """doc_id, _key, n, gid (the set), grp (prefix and size), parity bits and, once a slice for each set, its prefix with the places from which its shingles have a known frequency (seen) and one of HOT and more (hot), and its parities (wide)."""
    common = rows.sparkSession.sparkContext.broadcast(_frequent(rows, size, scratch))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = common.value
        for batch, texts in small_slices(batches, "_text"):
            known, done = [], set()
            for own in shingle_sets(texts, size):
                if not len(own):
                    known.append((0, None, None, [None] * 4, None, None, None, None))
                    continue
                keep = len(own) - (percent * len(own) + 99) // 100 + 1
                order, rank = own, np.zeros(len(own), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, own), len(often) - 1)
                    rank = np.where(often[at] == own, times[at], 0)
                    by_rank = np.argsort(rank, kind="stable")
                    order, rank = own[by_rank], rank[by_rank]
                gid = int(_digest(own, 1))
                seen, hot = np.searchsorted(rank[:keep], [1, HOT]).tolist()
                wide, again = _parity(own), gid in done
                known.append((len(own), gid, int(_digest(order[:keep], 2 + len(own))), _folded(wide), None if again else order[:keep].view(np.int64), seen, hot, None if again else wide))
                done.add(gid)
            n, gids, grps, bits, prefixes, seen, hot, wide = zip(*known, strict=True)
            long = lambda x: pa.array(x, pa.int64())
            columns = [batch.column("doc_id"), batch.column("_key"), long(n), long(gids), long(grps), *(long([x[k] for x in bits]) for k in range(4)), pa.array(prefixes, pa.list_(pa.int64())), pa.array(seen, pa.int32()), pa.array(hot, pa.int32()), pa.array(wide, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_key", "n", "gid", "grp", *BITS, "prefix", "seen", "hot", "wide"])

    kind = f"doc_id {dict(rows.dtypes)['doc_id']}, _key long, n long, gid long, grp long, b0 long, b1 long, b2 long, b3 long, prefix array<long>, seen int, hot int, wide array<long>"
    return rows.mapInArrow(cut, kind)


def _links(rows: DataFrame, groups: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by the exact sizes of intersection and union.

    Only texts of pairs are read again. A text's set goes out once for each pair in which it is b, keyed by a and a part
    of a's partners, and once for each part of its own partners; one join then brings the two sets of each pair together.
    """
    scratch = Scratch(rows.sparkSession)
    pairs = scratch.stored(pairs, "pairs")
    many = pairs.groupBy("a").agg(F.count("*").alias("_m")).filter(F.col("_m") > PARTNERS)
    parts = F.ceil(F.coalesce("_m", F.lit(1)) / PARTNERS)
    pairs = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    lead = lambda part: F.struct(F.col("a").alias("a"), F.col("part").alias("part"), part.alias("own"))
    roles = pairs.select(F.col("b").alias("gid"), lead(F.lit(False)).alias("x")).union(pairs.select("a", lead(F.lit(True))))
    roles = roles.groupBy("gid").agg(F.collect_set("x").alias("roles")).join(groups.select("gid", "_key"), "gid")
    roles = scratch.stored(roles, "roles")
    asked = F.broadcast(roles) if (roles.agg(F.sum(F.size("roles") * 2 + 2)).first()[0] or 0) <= BROADCAST_IDS else roles

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in small_slices(batches, "_text", 1 << 20):
            out, held = [], 0
            for x, gid, roles in zip(shingle_sets(own, size), batch.column("gid").to_pylist(), batch.column("roles").to_pylist(), strict=True):
                if not len(x) or int(_digest(x, 1)) != gid:
                    continue
                for role in roles:
                    out.append((role["a"], role["part"], None if role["own"] else gid, x.view(np.int64)))
                    held += 8 * len(x)
                    if held > 4 << 20:  # a set of many roles goes out as often
                        yield made(out)
                        out, held = [], 0
            if out:
                yield made(out)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["a", "part", "b", "s"])

    sets = scratch.stored(rows.join(asked, "_key").select("_text", "gid", "roles").mapInArrow(fetch, "a long, part int, b long, s array<long>"), "sets")
    both = sets.filter("b is not null").withColumnRenamed("s", "sb").join(sets.filter("b is null").select("a", "part", F.col("s").alias("sa")), ["a", "part"])
    both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("o"), (F.size("sa") + F.size("sb")).alias("t"))
    links = stored(both.filter(100 * F.col("o") >= percent * (F.col("t") - F.col("o"))).select("a", "b").distinct(), "links")
    scratch.clear()
    return links


def similar_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, rounds: int = 2) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id.

    Words are lower-cased (A-Z) runs without white space; a set is the distinct runs of `size` words, or all words as one
    if there are fewer. Rows link when 100 * intersection >= percent * union; component_id is the least doc_id that a
    row reaches, itself included. Null or empty texts link with nothing and have their own id; a null id is never the
    least one, and a row that reaches only null ids has a null component_id; repeated rows are copies of each other and
    each get their row; an empty table gives none; extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).withColumn("_key", F.xxhash64("doc_id", "_text"))
    spark = docs.sparkSession
    scratch = Scratch(spark)
    of_docs = scratch.stored(_prefixes(rows, size, percent, scratch), "prefixes")
    groups = scratch.stored(of_docs.filter("gid is not null").groupBy("gid").agg(F.first("grp").alias("grp"), F.first("n").alias("n"), *[F.first(x).alias(x) for x in BITS], F.min("doc_id").alias("doc_id"), F.min("_key").alias("_key")), "groups")
    short, long = _lists(of_docs, groups, percent, scratch)
    link = lambda pairs: _links(rows, groups, _likely(pairs, of_docs, percent, scratch), size, percent)
    comps, tables, judged = None, [], None
    for k in range(rounds + 1):
        now = long.withColumn("comp", F.col("gid")) if comps is None else long.join(comps.withColumnRenamed("node", "gid"), "gid", "left").withColumn("comp", F.coalesce("comp", "gid"))
        pairs = _with_leaders(now, k, percent) if k < rounds else _all_crossing(now, percent, scratch)
        pairs = short.unionByName(pairs).distinct() if judged is None else pairs.join(judged, ["a", "b"], "left_anti")
        pairs = scratch.stored(pairs, "judged")
        judged = pairs.select("a", "b") if judged is None else judged.union(pairs.select("a", "b"))
        found = link(pairs)
        scratch.clear("candidates", "main-component")
        comps = _joined(comps, found)
        tables += [found, comps]

    known = groups.join(comps.withColumnRenamed("node", "gid"), "gid", "left").withColumn("comp", F.coalesce("comp", "gid"))
    least = known.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_set = known.join(least, "comp").select("gid", "component_id")
    out = of_docs.select("doc_id", "n", "gid").join(of_set, "gid", "left")
    out = stored(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("gid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")), "similar")
    scratch.clear()
    discard(*tables)
    return out


def _lists(of_docs: DataFrame, groups: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Likely pairs of sets of the short lists (a, b, na, nb), and the long lists' rows (tok, gid, n, i: place in the prefix, prev: the shingle before if its frequency is known, parity bits).

    The sets of one group are a list of their own. A pair comes up only where the shingle before isn't shared: by
    induction the first shingle of each run that two prefixes share gives the pair, in whatever list that one is.
    """
    shingle = F.transform("prefix", lambda x, i: F.struct(x.alias("tok"), i.cast("int").alias("i"), F.when(i > F.col("seen"), F.get("prefix", i - 1)).alias("prev"), (i >= F.col("hot")).alias("hot")))
    postings = of_docs.filter("prefix is not null").select("grp", "n", F.explode_outer(shingle).alias("x")).select("x.tok", "grp", "n", "x.i", "x.prev", "x.hot")
    by_token = Window.partitionBy("tok")
    cold = postings.filter("not hot").drop("hot").withColumn("_lo", F.min("grp").over(by_token)).withColumn("_hi", F.max("grp").over(by_token)).filter("_lo < _hi").drop("_lo", "_hi").distinct()
    # the nearest sizes in a list tell whether any is near enough
    by_size = by_token.orderBy("n", "grp")
    near = lambda x: F.coalesce(_sized(F.col("n"), F.col(x), percent), F.lit(False))
    cold = cold.withColumn("_below", F.lag("n").over(by_size)).withColumn("_above", F.lead("n").over(by_size)).filter(near("_below") | near("_above"))
    # the least size that a set of this list can be paired with still needs so many shingles from this place on
    smallest = F.greatest(F.min("n").over(by_token), F.floor((percent * F.col("n") + 99) / 100))
    cold = cold.withColumn("_least", smallest).filter(F.col("n") - F.col("i") >= _needed(F.col("n"), F.col("_least"), percent))
    one = F.struct("grp", "n", "i", "prev")
    cold = cold.withColumn("m", F.count("*").over(by_token)).withColumn("_next", F.collect_list(F.when(F.col("m") <= SHORT, one)).over(by_size.rowsBetween(1, SHORT)))
    fits = lambda x: _sized(F.col("n"), x["n"], percent) & _by_place(F.col("n"), F.col("i"), x["n"], x["i"], percent) & _starts(F.col("prev"), x["prev"])
    cold = cold.withColumn("with", F.transform(F.filter("_next", fits), lambda x: x["grp"])).filter((F.col("m") > SHORT) | (F.size("with") > 0))
    cold = scratch.stored(cold.select("tok", "grp", "n", "i", "prev", "m", "with"), "lists")

    members = groups.select("grp", "gid", "n", *BITS)
    sizes = groups.groupBy("grp").agg(F.count("*").alias("m")).filter("m > 1")
    within = scratch.stored(members.join(sizes, "grp"), "within")
    side = lambda x, bits: [F.col("grp").alias(f"g{x}"), F.col("gid").alias(x), F.col("n").alias(f"n{x}"), *[F.col(f"b{k}").alias(f"{bits}{k}") for k in range(4)]]
    pairs = cold.filter(F.col("m") <= SHORT).select(F.col("grp").alias("ga"), F.explode("with").alias("gb")).distinct()
    of_short = pairs.join(members.select(side("a", "a")), "ga").join(members.select(side("b", "b")), "gb").drop("ga", "gb")
    small = within.filter(F.col("m") <= SHORT)
    of_small = small.select(side("a", "a")).join(small.select(side("b", "b")), F.col("ga") == F.col("gb")).filter("a < b").drop("ga", "gb")
    likely = of_short.unionByName(of_small).filter(_by_parity(percent))
    short = scratch.stored(likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "na", "nb"), "short")

    long = cold.filter(F.col("m") > SHORT).select("tok", "grp", "i", "prev").unionByName(postings.filter("hot").select("tok", "grp", "i", "prev").distinct())
    long = long.join(members, "grp").drop("grp").unionByName(within.filter(F.col("m") > SHORT).select(F.col("grp").alias("tok"), "gid", "n", F.lit(0).alias("i"), F.lit(None).cast("long").alias("prev"), *BITS))
    return short, scratch.stored(long, "long")


def _sized(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _needed(na: Column, nb: Column, percent: int) -> Column:
    """Least number of shared shingles of similar sets: ceil(t (na + nb) / (1 + t))."""
    return F.floor((percent * (na + nb) + 99 + percent) / (100 + percent))


def _by_place(na: Column, ia: Column, nb: Column, ib: Column, percent: int) -> Column:
    """Whether a shingle can be the first that two similar sets share: from there on, enough must be left in both."""
    return F.least(na - ia, nb - ib) >= _needed(na, nb, percent)


def _starts(a: Column, b: Column) -> Column:
    """Whether the shingles before (null: not known) aren't the same."""
    return F.coalesce(a != b, F.lit(True))


def _by_parity(percent: int) -> Column:
    """Whether the sets of a pair row differ by few enough bits."""
    bits = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(1, 4)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    return bits <= F.col("na") + F.col("nb") - 2 * _needed(F.col("na"), F.col("nb"), percent)


def _fit(percent: int) -> Column:
    """Whether a row of a and b passes all filters and crosses components."""
    na, nb, ia, ib = (F.col(x) for x in ("na", "nb", "ia", "ib"))
    return (F.col("ca") != F.col("cb")) & _sized(na, nb, percent) & _by_place(na, ia, nb, ib, percent) & _by_parity(percent)


def _side(x: str) -> list[Column]:
    return [F.col("gid").alias(x), F.col("n").alias(f"n{x}"), F.col("i").alias(f"i{x}"), F.col("prev").alias(f"p{x}"), F.col("comp").alias(f"c{x}"), *[F.col(f"b{k}").alias(f"{x}{k}") for k in range(4)]]


def _with_leaders(long: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs of each long list's sets with the leader of their class of sizes: the one that has the shingle at the first place, with the fewest of its own before it, so that it is the most like the others; ties go by a hash of the round, so that few sets lead many lists."""
    size = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100)) + F.lit(0.5 * (k % 2))).cast("long").alias("_size")
    own = long.select("tok", size, *_side("b"))
    leaders = long.select("tok", size, F.struct(F.col("i").alias("place"), F.xxhash64("gid", F.lit(k)).alias("h"), *_side("a")).alias("x")).groupBy("tok", "_size").agg(F.min("x").alias("x")).select("tok", "_size", "x.*").drop("place", "h")
    return _ordered(own.join(leaders, ["tok", "_size"]).filter(_fit(percent)))


def _ordered(pairs: DataFrame) -> DataFrame:
    swap = F.col("a") > F.col("b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb")).distinct()


def _likely(pairs: DataFrame, of_docs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose sets differ by few enough parities."""
    gids = scratch.stored(pairs.select(F.col("a").alias("gid")).union(pairs.select("b")).distinct(), "candidates")
    asked = F.broadcast(gids) if gids.count() <= BROADCAST_IDS else gids
    own = of_docs.filter("wide is not null").select("gid", "wide").join(asked, "gid", "left_semi").groupBy("gid").agg(F.first("wide").alias("w"))
    both = pairs.join(own.select(F.col("gid").alias("a"), F.col("w").alias("wa")), "a").join(own.select(F.col("gid").alias("b"), F.col("w").alias("wb")), "b")
    size = F.least(F.size("wa"), F.size("wb"))  # similar sizes are a factor of two apart at most
    xor = lambda x, y: x.bitwiseXOR(y)
    half = lambda w: F.when(F.size(w) > size, F.zip_with(F.slice(w, F.lit(1), size), F.slice(w, size + 1, size), xor)).otherwise(F.col(w))
    bits = F.aggregate(F.zip_with(half("wa"), half("wb"), lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda n, x: n + x)
    return both.filter(bits <= F.col("na") + F.col("nb") - 2 * _needed(F.col("na"), F.col("nb"), percent)).select("a", "b")


def _all_crossing(long: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """All pairs of the long lists in different components that pass the filters.

    At least one set of such a pair is outside the list's most frequent component, so only those sets meet the whole list.
    """
    of_comp = long.groupBy("tok", "comp").agg(F.count("*").alias("m"))
    main = scratch.stored(of_comp.groupBy("tok").agg(F.max(F.struct("m", "comp")).alias("x"), F.count("*").alias("k")).filter("k > 1").select("tok", F.col("x.comp").alias("main")), "main-component")
    now = scratch.stored(long.join(main, "tok").withColumn("out", F.col("comp") != F.col("main")).drop("main"), "main-component")
    left = now.filter("out").select("tok", *_side("a"))
    right = now.select("tok", "out", *_side("b"))
    once = ~F.col("out") | (F.col("a") < F.col("b"))
    return _ordered(left.join(right, "tok").filter(once & _starts(F.col("pa"), F.col("pb")) & _fit(percent)))


def _joined(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links."""
    if comps is None:
        return components(links)
    of = lambda x: F.col(f"_{x}.comp")
    mapped = (
        links.join(comps.alias("_a"), F.col("a") == F.col("_a.node"), "left").join(comps.alias("_b"), F.col("b") == F.col("_b.node"), "left")
        .select(F.coalesce(of("a"), "a").alias("a"), F.coalesce(of("b"), "b").alias("b")).filter("a != b")
    )
    more = components(mapped)
    old = comps.join(more.select(F.col("node").alias("comp"), F.col("comp").alias("next")), "comp", "left").select("node", F.coalesce("next", "comp").alias("comp"))
    new = more.join(comps.select("node"), "node", "left_anti")
    return stored(old.unionByName(new), "comps")
