"""URL filters: rules by host and path, then naive Bayes over the words of host and path, split by unigram Viterbi."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitscape.llm.shared import Scratch, most_frequent, small_slices, stored, with_match

#: Words that mark a URL as unwanted; they label the URLs that the classifier learns from.
SEED_WORDS = (
    "ads", "adult", "bet", "bets", "betting", "bingo", "casino", "crack", "escort", "gambling", "jackpot", "keygen", "nude", "payday", "pharma",
    "pills", "poker", "porn", "roulette", "sex", "slots", "spam", "torrent", "viagra", "warez", "xxx",
)
#: Rules of the contract: (verdict, host, path prefix).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Longest word that a split of a name makes, so that a split takes time in proportion to the name.
LONGEST_WORD = 24
#: Words on the driver and in each task: unigrams of the split, and log odds. All other unigrams and log odds are joined.
VOCABULARY = 50_000
#: Begins of a long name whose words are listed at once.
BEGINS = 4096

_AUTHORITY = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_UPPER = {c: c + 32 for c in range(65, 91)}
_PIECE = re.compile(r"[a-z]+|[0-9]+")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): both empty without `://`."""
    m = _AUTHORITY.search(url or "")
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


def pieces_of(host: str, path: str) -> list[str]:
    """Runs of letters, and 0 for each number, of host and path."""
    return [x if x[0] > "9" else "0" for x in _PIECE.findall(f"{host} {path.translate(_UPPER)}")]


def plain_words(host: str, path: str) -> list[str]:
    """Pieces that are likely words by themselves: of the path, and of host labels with a hyphen."""
    return pieces_of(" ".join(x for x in host.split(".") if "-" in x), path)


def matching_rule(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits; rules by host: (path prefix, verdict)."""
    best = None
    parts = host.split(".")
    for k in range(len(parts)):
        suffix = ".".join(parts[k:])
        for prefix, verdict in rules.get(suffix, ()):
            if path.startswith(prefix) and (best is None or len(suffix + prefix) > len(best[0])):
                best = (suffix + prefix, verdict)
    return best


@dataclass
class Segmenter:
    """The split of a name into words with the greatest product of unigram probabilities; unknown words pay for each letter, and known ones of one or two letters don't split a name. Of equal splits the one with the longest last word is taken. Words longer than LONGEST_WORD are whole names only. `total` counts the unigrams that aren't in counts too."""

    counts: dict[str, int]
    total: int = 0
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self):
        self.total = self.total or max(1, sum(self.counts.values()))

    def words(self, name: str) -> tuple[str, ...]:
        if name not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[name] = self.split(name, {})
        return self.known[name]

    def split(self, name: str, rare: dict[str, int]) -> tuple[str, ...]:
        """rare: counts of the name's words that aren't in counts."""
        best, cut = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
        for end in range(1, len(name) + 1):
            begins = range(max(0, end - LONGEST_WORD), end)
            for begin in (0, *begins) if end == len(name) > LONGEST_WORD else begins:
                word = name[begin:end]
                n = (self.counts.get(word) or rare.get(word)) if end - begin > 2 or word == name else None
                p = math.log10(n / self.total) if n else math.log10(0.1 / self.total) - 0.5 * (end - begin)
                if best[begin] + p > best[end]:
                    best[end], cut[end] = best[begin] + p, begin
        out, end = [], len(name)
        while end:
            out.append(name[cut[end] : end])
            end = cut[end]
        return tuple(reversed(out))


@dataclass
class UrlModel:
    segmenter: Segmenter
    block: dict[str, float]  # log odds of the most frequent words for an unwanted URL
    prior: float
    rest: DataFrame | None = None  # w, odds: log odds of all other words
    rare: DataFrame | None = None  # w, n: unigrams that the segmenter doesn't hold

    def words(self, host: str, path: str, known: dict[str, list[str]]) -> list[str]:
        """known: splits of the names that hold rare unigrams."""
        return [w for x in pieces_of(host, path) for w in known.get(x) or self.segmenter.words(x)]

    def small(self) -> UrlModel:
        """What is broadcast."""
        return replace(self, rest=None, rare=None)

    def log_odds(self, words: list[str]) -> float:
        return self.prior + sum(self.block.get(w, 0.0) for w in words)


def _counted(rows: DataFrame, words_of, kind: str) -> DataFrame:
    """Counts of what words_of gives for each url, summed in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, urls in small_slices(batches, "_url"):
            seen: Counter = Counter(x for u in urls for x in words_of(u.decode(errors="replace")))
            yield pa.RecordBatch.from_pylist([dict(zip(("w", "label"), k, strict=True)) | {"n": n} for k, n in seen.items()], pa.schema([("w", pa.string()), ("label", pa.int32()), ("n", pa.int64())]))

    return rows.mapInArrow(count, kind).groupBy("w", "label").agg(F.sum("n").alias("n"))


def train_url_model(pages: DataFrame, *, url_col: str = "url", seeds: tuple[str, ...] = SEED_WORDS, smoothing: float = 1.0, seed_urls: int = 50, rounds: int = 2) -> UrlModel:
    """The classifier trains itself, as pages bear no labels: first the URLs with a seed word are the unwanted ones, then those that the model of the round before judges so.

    A seed word has seed_urls occurrences in unwanted URLs more, as a prior of its own. Unigrams of all URLs' plain words split the names; all words
    have log odds. Unigrams and log odds beyond the VOCABULARY most frequent are joined, for splits, labels of all rounds and verdicts alike.
    """
    spark, kind = pages.sparkSession, "w string, label int, n long"
    rows = pages.select(F.col(url_col).alias("_url")).filter("_url is not null")
    scratch = Scratch(spark)
    pieces = _counted(rows, lambda u: [(x, 0) for x in plain_words(*split_url(u))], kind)
    pieces = scratch.stored(pieces.select("w", "n"), "unigrams")
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    head = pieces.orderBy(F.desc("n"), "w").limit(VOCABULARY).collect()
    rare = None
    if len(head) == VOCABULARY:
        least = head[-1]
        rare = pieces.filter((F.col("n") < least["n"]) | (F.col("n") == least["n"]) & (F.col("w") > least["w"])).filter(~F.col("w").isin(list(seeds)))
        rare = None if rare.isEmpty() else rare
    floor = max(1, total // 10_000)
    own = {x["w"]: x["n"] for x in pieces.filter(F.col("w").isin(list(seeds))).collect()}
    counts = {x["w"]: x["n"] for x in head} | {w: max(own.get(w, 0), floor) for w in seeds}
    total += sum(counts[w] - own.get(w, 0) for w in set(seeds))
    seeds_ = frozenset(seeds)
    model = UrlModel(Segmenter(counts, total), {}, 0.0, rare=rare)
    for k in range(rounds):
        model = _trained(rows, model, frozenset() if k else seeds_, seeds_, smoothing, seed_urls, kind, scratch)
    return model


def _trained(rows: DataFrame, before: UrlModel, marks: frozenset[str], seeds: frozenset[str], smoothing: float, seed_urls: int, kind: str, scratch: Scratch) -> UrlModel:
    """The model of the labels that `marks` give, or, without marks, the model before."""
    shared = rows.sparkSession.sparkContext.broadcast(before.small())

    def labelled(url: str) -> list[tuple[str | None, int]]:
        words = shared.value.words(*split_url(url), {})
        label = int(any(w in marks for w in words) if marks else shared.value.log_odds(words) > 0)
        return [*((w, label) for w in words), (None, label)]

    if before.rest is None and before.rare is None:
        counted = _counted(rows, labelled, kind)
    else:
        found = filter_urls(rows.select(F.lit(0).alias("page_id"), F.col("_url").alias("url")), before, rules=())
        label = F.arrays_overlap("words", F.array(*[F.lit(w) for w in sorted(marks)])) if marks else F.col("log_odds") > 0
        counted = found.select(F.explode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("w"), label.cast("int").alias("label")).groupBy("w", "label").agg(F.count("*").alias("n"))
    by_label = lambda k: F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(f"n{k}")
    got = scratch.stored(counted.groupBy("w").agg(by_label(0), by_label(1)).withColumn("n", F.col("n0") + F.col("n1")), "url-words")
    words = got.filter("w is not null")
    distinct, *totals = words.agg(F.count("*"), F.coalesce(F.sum("n0"), F.lit(0)), F.coalesce(F.sum("n1"), F.lit(0))).first()
    seen = {x["w"]: (x["n0"], x["n1"]) for x in words.filter(F.col("w").isin(list(seeds))).collect()}
    vocabulary = distinct + len(seeds - set(seen))
    size = [n + smoothing * vocabulary for n in totals]
    head = most_frequent(words, "n", VOCABULARY)
    counted = {x["w"]: (x["n0"], x["n1"]) for x in head.collect()} | seen
    whole = distinct <= len(counted)
    counted |= {w: (counted.get(w, (0, 0))[0], counted.get(w, (0, 0))[1] + seed_urls) for w in seeds}
    odds = {w: math.log((n1 + smoothing) / size[1]) - math.log((n0 + smoothing) / size[0]) for w, (n0, n1) in counted.items()}
    rest = None
    if not whole:
        tail = F.log((F.col("n1") + smoothing) / F.lit(size[1])) - F.log((F.col("n0") + smoothing) / F.lit(size[0]))
        rest = words.join(head.select("w"), "w", "left_anti").filter(~F.col("w").isin(list(seeds))).select("w", tail.alias("odds"))
    urls = got.filter("w is null").first() or {"n0": 0, "n1": 0}
    return UrlModel(before.segmenter, odds, math.log((urls["n1"] + 1) / (urls["n0"] + 1)), rest, before.rare)


def _rare_splits(rows: DataFrame, model: UrlModel) -> DataFrame:
    """rows (with _row and _url, stored) with _known: name and words of each name of the url that holds a unigram of model.rare.

    The words that a name may be split into are listed once for each different name and joined with the rare unigrams;
    the names that have any are split with these, and rows find them by name.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model.segmenter)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, urls in small_slices(batches, "_url"):
            found = [list({x for x in pieces_of(*split_url(u.decode(errors="replace"))) if len(x) > 2}) for u in urls]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(found, pa.list_(pa.string()))], ["_row", "names"])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, ids, words = shared.value.counts, [], []
        for batch in batches:
            for k, name in zip(batch.column("_id").to_pylist(), batch.column("name").to_pylist(), strict=True):
                for low in range(0, len(name), BEGINS):
                    found = {name[b:e] for b in range(low, min(low + BEGINS, len(name))) for e in range(b + 3, min(b + LONGEST_WORD, len(name)) + 1)} | ({name} if low == 0 else set())
                    found -= counts.keys()
                    ids.extend([k] * len(found)), words.extend(found)
                    if len(ids) >= 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string())], ["_id", "w"])
                        ids, words = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string())], ["_id", "w"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in small_slices(batches, "name"):
            rare = [{x["w"]: x["n"] for x in r} for r in batch.column("rare").to_pylist()]
            words = [shared.value.split(t.decode(), r) for t, r in zip(texts, rare, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(words, pa.list_(pa.string()))], ["_key", "split"])

    of_row = stored(rows.select("_row", "_url").mapInArrow(names, "_row long, names array<string>").select("_row", F.explode("names").alias("name")), "url-names")
    ids = stored(of_row.select("name").distinct().withColumn("_id", F.monotonically_increasing_id()), "names")
    own = ids.mapInArrow(candidates, "_id long, w string").join(model.rare, "w").groupBy("_id").agg(F.collect_set(F.struct("w", "n")).alias("rare"))
    splits = stored(ids.join(own, "_id").select("name", "rare").mapInArrow(split, "_key string, split array<string>"), "rare-splits")
    found = with_match(of_row, F.col("name"), splits, "split", F.col("_row").cast("string")).filter("split is not null")
    return rows.join(found.groupBy("_row").agg(F.collect_list(F.struct("name", "split")).alias("_known")), "_row", "left")


def filter_urls(pages: DataFrame, model: UrlModel, *, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, words, log_odds.

    A rule fits its host and that host's subdomains if the path begins with the rule's path; the longest rule's verdict
    holds. Without a rule the verdict is block if log_odds > 0 (allow at 0). Long urls are split like others, in
    proportion to their length. A null url, or one without `://`, has empty host and path,
    no rule, no words and verdict allow unless most URLs are blocked. Null ids and repeated rows are judged like others;
    an empty table gives none; extra columns are ignored.
    """
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, host, prefix in rules:
        by_host.setdefault(host, []).append((prefix, verdict))
    shared = pages.sparkSession.sparkContext.broadcast((by_host, model.small()))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"))
    if model.rare is not None:
        rows = _rare_splits(stored(rows.withColumn("_row", F.monotonically_increasing_id()), "urls"), model).select("page_id", "_url", "_known")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_host, model = shared.value
        for batch, urls in small_slices(batches, "_url"):
            hosts, paths, names, verdicts, words, odds = [], [], [], [], [], []
            splits = batch.column("_known").to_pylist() if "_known" in batch.schema.names else [None] * len(urls)
            for url, own_splits in zip(urls, splits, strict=True):
                host, path = split_url(url.decode(errors="replace"))
                rule = matching_rule(host, path, by_host)
                own = model.words(host, path, {x["name"]: x["split"] for x in own_splits or ()})
                x = model.log_odds(own)
                hosts.append(host), paths.append(path), words.append(own), odds.append(x)
                names.append(rule and rule[0]), verdicts.append(rule[1] if rule else "block" if x > 0 else "allow")
            text = pa.string()
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(hosts, text), pa.array(paths, text), pa.array(names, text), pa.array(verdicts, text), pa.array(words, pa.list_(text)), pa.array(odds, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "words", "log_odds"])

    judged = rows.mapInArrow(judge, f"page_id {dict(rows.dtypes)['page_id']}, host string, path string, rule string, verdict string, words array<string>, log_odds double")
    if model.rest is None:
        return judged
    judged = stored(judged.withColumn("_row", F.monotonically_increasing_id()), "judged")
    more = judged.select("_row", F.explode("words").alias("w")).groupBy("_row", "w").agg(F.count("*").alias("n")).join(model.rest, "w").groupBy("_row").agg(F.sum(F.col("n") * F.col("odds")).alias("_more"))
    x = F.col("log_odds") + F.coalesce("_more", F.lit(0.0))
    verdict = F.when(F.col("rule").isNotNull(), F.col("verdict")).when(x > 0, "block").otherwise("allow")
    return judged.join(more, "_row", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "words", x.alias("log_odds"))
