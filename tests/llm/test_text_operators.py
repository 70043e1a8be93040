"""Operators on documents against plain versions, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fitscape.llm import bpe, class_lm, decontaminate, fst_tokens, language_id, line_quality, packing, prefix_join, queries, substring_dedup, textkit
from fitscape.llm.components import components

os.environ["TOKENIZERS_PARALLELISM"] = "false"
DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def odd_documents(seed=1, n=60):
    """(doc_id, text, lang, source) with every kind of trouble."""
    random.seed(seed)
    vocabulary = ["".join(random.choices("abcdeé", k=random.randint(1, 4))) for _ in range(60)]
    passage = " ".join(random.choices(vocabulary, k=70))
    rows = []
    for i in range(n):
        words = random.choices(vocabulary, k=random.randint(0, 150))
        if i % 4 == 0:
            at = random.randint(0, len(words))
            words[at:at] = passage.split()[random.randint(0, 15) :]
        text = "".join(w + random.choice(["\n", " ", "  ", "\t", " "]) for w in words)
        rows.append((i, text, random.choice(["x", "y"]), f"s{i % 3}"))
    rows += [(n + k, rows[k][1], "x", "s0") for k in range(10)]  # copies
    rows += [(n + 20 + k, rows[k][1] + " One more", "x", "s0") for k in range(10)]
    rows += [(900, None, "x", None), (901, "", None, "s0"), (902, " \n\t", "y", "s1"), (903, "a " * 3000, "y", "s1"), (904, "z" * 5000, "x", "s1"), (None, passage, "x", "s1"), (905, "A b C", "x", "s2"), (906, "a B c", "x", "s2")]
    rows += [rows[3], rows[3]]  # repeated rows
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("n", "w", "a", "b", "comp", "prefix", "starts", "_text", "_row", "_key", "host"):
        df = df.withColumn(name, F.lit(1))
    return rows, df.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def by_key(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_words_and_hashes():
    texts = [x[1].encode() if x[1] else b"" for x in odd_documents()] + [b"q " * 200_000, b"x" * 600_000 + b" y"]
    first, start, end, h = textkit.words(texts)
    for i, t in enumerate(texts):
        own = [t[start[k] : end[k]] for k in range(first[i], first[i + 1])]
        assert own == t.split()
    known = {}
    for i, t in enumerate(texts):
        for w, x in zip(t.split(), h[first[i] : first[i + 1]].tolist(), strict=True):
            assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)
    upper = textkit.words([b"AbC"], lower=True)[3]
    assert upper == textkit.words([b"abc"])[3] and upper != textkit.words([b"AbC"])[3]


def thue_morse(n=1024):
    """Two words whose polynomial hashes modulo 2**64 are the same, whatever the base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_words_of_one_form_are_told_apart(spark):
    x, y = thue_morse()
    h = textkit.words([x.encode(), y.encode()])[3]
    codes = textkit.sequence_hashes(np.frombuffer((x + y).encode("utf-32-le"), np.uint32), np.array([0, 1024]), np.array([1024, 2048]))
    assert h[0] != h[1] and codes[0] != codes[1]
    pair, bits = textkit.words([b"p q"])[3], np.array([bin(i).count("1") % 2 for i in range(1024)])
    assert textkit.ngrams(pair[bits], 1024)[0] != textkit.ngrams(pair[1 - bits], 1024)[0]
    docs = spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")
    assert [r["component_id"] for r in prefix_join.similar_components(docs).orderBy("doc_id").collect()] == [1, 2]
    found = decontaminate.decontaminate(docs, spark.createDataFrame([("i", x)], "item_id string, text string")).orderBy("doc_id").collect()
    assert [r["contaminated"] for r in found] == [True, False]
    library = bpe.library(public_tokenizers.path("word_bpe_49k.json"))
    ids, at = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json")).encode([x.encode(), y.encode()])
    assert [ids[at[i] : at[i + 1]].tolist() for i in (0, 1)] == [library.encode(t, add_special_tokens=False).ids for t in (x, y)]
    known = bpe.library(public_tokenizers.path("byte_bpe_50k.json"))
    assert [r["n_tokens"] for r in fst_tokens.count_tokens(docs).orderBy("doc_id").collect()] == [len(known.encode(t, add_special_tokens=False).ids) for t in (x, y)]
    many = spark.createDataFrame([(1, " ".join([x] * 60)), (2, " ".join([y] * 60)), (3, " ".join([x] * 60))], "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup.substring_dedup(many).orderBy("doc_id").collect()] == [0, 0, 60]


def test_line_quality(odd, empty):
    rows, df = odd
    got = by_key(line_quality.line_quality(df), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    expected = Counter()
    for d, text, _, _ in rows:
        t = text or ""
        w = WORD.findall(t)
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        expected[d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)] += 1
    assert got == expected
    assert line_quality.line_quality(empty).count() == 0


def test_hot_lines_deplete(spark):
    own = ["".join(chr(97 + (k * 7 + j * 3 + i) % 26) for i in range(5)) for k in range(40) for j in range(25)]
    docs = [(k, "Same   LINE 7 " + "x y z " * 40 * (k % 2) + f"\nsame line {k % 10}\n" + " ".join(own[25 * k : 25 * k + 25]), "h") for k in range(40)]
    docs += [(100 + k, "common words stand here in this line one two three four five six seven eight nine ten eleven twelve thirteen\nu" + "abcdefghij"[k % 10] * (k // 10 + 1), "h") for k in range(40)]
    docs += [(200 + k, docs[41][1], "other") for k in range(40)]  # copies count once
    got = {r["doc_id"]: r for r in line_quality.line_quality(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert all(not got[100 + k]["kept"] and not got[100 + k]["base_failed"] and got[100 + k]["hot_lines"] == [0] for k in range(40))
    assert all(got[200 + k]["n_hot_words"] == 0 and got[200 + k]["kept"] for k in range(40))
    assert all(got[k]["kept"] and got[k]["n_hot_words"] == 6 for k in range(0, 40, 2))


@pytest.mark.parametrize(("size", "hot", "broadcast"), [(50, 512, 10**6), (20, 2, 10**6), (20, 2, -1)])
def test_substring_dedup(odd, empty, monkeypatch, size, hot, broadcast):
    monkeypatch.setattr(substring_dedup, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(substring_dedup, "BROADCAST_WINDOWS", broadcast)
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", 2000)
    rows, df = odd
    first = {}
    for d, text, _, _ in rows:
        w = WORD.findall(text or "")
        for i in range(len(w) - size + 1) if d is not None else ():
            key = tuple(w[i : i + size])
            first[key] = min(d, first.get(key, d))
    expected = Counter()
    for d, text, _, _ in rows:
        w = WORD.findall(text or "")
        gone = {j for i in range(len(w) - size + 1) if d is not None and first[tuple(w[i : i + size])] < d for j in range(i, i + size)}
        expected[d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)] += 1
    found = substring_dedup.substring_dedup(df, min_words=size)
    assert by_key(found, "doc_id", "n_words", "n_removed", "kept_text") == expected
    assert sum(x[2] > 0 for x in expected) > 5
    # a full filter only sends more segments
    if hot == 512:
        small = substring_dedup.substring_dedup(df, min_words=size, bloom_words=1)
        assert by_key(small, "doc_id", "n_words", "n_removed", "kept_text") == expected
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_parse_against_a_block():
    random.seed(3)
    for _ in range(200):
        parts = [[random.choice("abc" if random.random() < 0.9 else "defgh") for _ in range(random.randint(1, 30))] for _ in range(random.randint(1, 9))]
        parts += [random.choice(parts)[random.randint(0, 3) :] or ["a"] for _ in range(3)]
        docs = np.array([random.randint(0, 4) for _ in parts])
        first = np.cumsum([0, *map(len, parts)])
        block = substring_dedup.Reference(np.array([ord(x) for p in parts for x in p], np.uint64), first, docs)

        def longest(i, at):
            p, best = parts[i], 0
            for j, q in enumerate(parts):
                for k in range(len(q)) if docs[j] < docs[i] else ():
                    n = 0
                    while at + n < len(p) and k + n < len(q) and p[at + n] == q[k + n]:
                        n += 1
                    best = max(best, n)
            return best

        assert [block.length[block.first[i] + at] for i, p in enumerate(parts) for at in range(len(p))] == [longest(i, at) for i, p in enumerate(parts) for at in range(len(p))]
        parse = sorted((int(i), int(at - block.first[i])) for i, at in zip(*block.parse(), strict=True))
        expected = []
        for i, p in enumerate(parts):
            at = 0
            while at < len(p):
                expected.append((i, at))
                at += max(1, longest(i, at))
        assert parse == expected
        covered = {(i, at + x) for i, at, n, source in zip(*(x.tolist() for x in block.duplicates(4)), strict=True) for x in range(n) if source < docs[i]}
        assert covered == {(i, at + x) for i, p in enumerate(parts) for at in range(len(p)) if longest(i, at) >= 4 for x in range(4)}


def test_merged_spans():
    assert substring_dedup.merged(np.array([[5, 9], [3, 6], [9, 10], [12, 13]])).tolist() == [[3, 10], [12, 13]]
    assert not len(substring_dedup.merged(np.zeros((0, 2), np.int64)))


def plain_contamination(text, items, size=13):
    phrases = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t)) if t is not None else []
        for j in range(max(1, len(w) - size + 1) if w else 0):
            phrases[tuple(w[j : j + size])].update([str(i)] if i is not None else [])  # one without an id is searched for, not listed
    w, hit, found = ALNUM.findall(lower(text or "")), set(), set()
    for n in {len(p) for p in phrases}:
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if key in phrases:
                hit |= set(range(i, i + n))
                found |= phrases[key]
    return len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_decontaminate(spark, odd, empty, block):
    rows, df = odd
    items = [(1, rows[0][1][:200]), (2, rows[4][1]), (3, "One more"), (4, None), (5, ""), (None, rows[8][1]), (7, "a a a"), (7, "b"), (11, "not there at all, ever")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    expected = Counter((d, *plain_contamination(t, items)) for d, t, _, _ in rows)
    found = decontaminate.decontaminate(df, tests, block_bytes=block)
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in found.collect()) == expected
    few = decontaminate.searched(df, tests, block_bytes=block, blocks_at_once=1).select("doc_id", "__found.*")  # each pass is stored
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in few.collect()) == Counter(x[:4] for x in expected.elements())
    assert decontaminate.decontaminate(empty, tests).count() == 0
    assert decontaminate.decontaminate(df, tests.limit(0)).filter("n_hit > 0").count() == 0


def test_items_of_one_id_are_dealt_to_all_blocks(spark, monkeypatch):
    words = [f"w{k}" for k in range(4000)]
    texts = [" ".join(words[k : k + 20]) for k in range(0, 3000, 20)]
    tests = spark.createDataFrame([(None, t) for t in texts] + [(1, texts[0])] * 200, "item_id long, text string")
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(-1, "none of it")], "doc_id long, text string")
    sizes = []
    monkeypatch.setattr(docs.sparkSession.sparkContext, "broadcast", lambda items, f=docs.sparkSession.sparkContext.broadcast: (sizes.append(sum(len(t) for _, t in items)), f(items))[1])
    found = decontaminate.decontaminate(docs, tests, block_bytes=2000).collect()
    assert {r["doc_id"] for r in found if r["contaminated"]} == set(range(len(texts))) and [r["items"] for r in found if r["doc_id"] == 0] == [["1"]]
    assert len(sizes) > 5 and max(sizes) < 8000


def test_equal_pieces_are_dealt_to_all_packs(spark):
    rows = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.lit(64).cast("long").alias("length"), F.lit(5).cast("long").alias("ids_crc32"), F.lit(64).cast("long").alias("doc_tokens"))
    got = packing.pack_pieces(rows, windows_per_pack=100).withColumn("pack", F.shiftright("sequence_id", 32))
    per_pack = [r["count"] for r in got.groupBy("pack").count().collect()]
    assert sum(per_pack) == 40_000 and len(per_pack) == 13 and max(per_pack) < 4500
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_fm_index_locates_all():
    random.seed(2)
    text = np.array([random.randint(1, 4) for _ in range(300)] + [1] * 40)
    index = decontaminate.FMIndex(text)
    for n in (1, 2, 5, 30):
        phrase = np.full((2, 30), 0)
        phrase[0, :n], phrase[1, :n] = text[50 : 50 + n], 9
        low, high = index.search(phrase, np.array([n, n]))
        assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == [i for i in range(len(text) - n + 1) if (text[i : i + n] == text[50 : 50 + n]).all()]
        assert low[1] == high[1]


def test_shards_of_any_size():
    """Few words against a large vocabulary of phrases, in any mix of documents."""
    random.seed(6)
    words = [f"w{k}" for k in range(900)]
    items = [(str(i), " ".join(random.choices(words, k=random.randint(5, 40)))) for i in range(30)]
    phrases = decontaminate.Phrases([(i, t.encode()) for i, t in items], 13)
    docs = []
    for _ in range(60):
        w = random.choices(words, k=random.randint(0, 40))
        if random.random() < 0.5:
            own = random.choice(items)[1].split()
            w[3:3] = own[random.randint(0, 4) :]
        docs.append(" ".join(w))
    expected = [plain_contamination(t, items)[1:3] for t in docs]
    for _ in range(40):
        some = random.sample(range(60), random.randint(1, 20))
        first, _, _, h = textkit.words([docs[i].encode() for i in some], textkit.ALNUM_WORDS, lower=True)
        hit, found = decontaminate.search_shard(first, h, phrases)
        assert [(int(hit[first[k] : first[k + 1]].sum()), tuple(sorted(found[k]))) for k in range(len(some))] == [expected[i] for i in some]


def plain_components(rows, size=5, percent=80):
    sets = []
    for _, text, *_ in rows:
        w = WORD.findall(lower(text or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for g, (d, *_) in zip(group, rows, strict=True):
        least[g] = min([x for x in (d, least.get(g)) if x is not None], default=None)
    return Counter((d, len(s), least[g]) for g, s, (d, *_) in zip(group, sets, rows, strict=True))


@pytest.mark.parametrize(("rounds", "short", "hot"), [(2, 16, 64), (1, 2, 2)])
def test_similar_components(spark, odd, empty, monkeypatch, rounds, short, hot):
    monkeypatch.setattr(prefix_join, "SHORT", short)
    monkeypatch.setattr(prefix_join, "HOT", hot)
    monkeypatch.setattr(prefix_join, "PARTNERS", 2 * short)
    rows, df = odd
    assert by_key(prefix_join.similar_components(df, rounds=rounds), "doc_id", "n_shingles", "component_id") == plain_components(rows)
    random.seed(5)
    base = [random.choices([f"w{k}" for k in range(200)], k=40) for _ in range(3)]
    near = []
    for i in range(90):
        w = list(random.choice(base))
        for _ in range(random.randint(0, 3)):
            w[random.randrange(len(w))] = f"n{random.randint(0, 5)}"
        near.append((i, " ".join(w[: random.randint(34, 40)])))
    df = spark.createDataFrame(near, "doc_id long, text string").repartition(4)
    assert by_key(prefix_join.similar_components(df, rounds=rounds), "doc_id", "n_shingles", "component_id") == plain_components(near)
    assert prefix_join.similar_components(empty).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 6), (6, 5), (20, 20)]
    df = spark.createDataFrame(links, "a long, b long")
    assert by_key(components(df), "node", "comp") == Counter([(1, 1), (2, 1), (3, 1), *((k, 4) for k in range(4, 10)), (20, 20)])


TEXTS = [
    "it's I'LL don't 'sx ''re 12345 x<|endoftext|>y <|startoftext|>", "", "  ", " \n x", "\n's 're\t'll  've!'s 'd'd'm", "ÀÉÎ ﬁ Σίσυφος ΣΑΣ áb İx ǅ", "x" * 500 + "y", "日本語 🎉🎉 ½ ²\u00a0\u2003 x", "'", "a'",
    "<|endoftext|><|endoftext|>", "'s's't're'l 'r 've", "a\x00b \x85 c",
]


def test_token_counts_match_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    random.seed(1)
    texts = TEXTS + ["".join(random.choices(["'", "s", "t", "r", "e", "v", "l", "d", " ", " ", "\n", "\t", "1", "é", "!", "<|endoftext|>"], k=random.randint(0, 300))) for _ in range(300)]
    expected = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert fst_tokens.token_counts([t.encode() for t in texts], fst_tokens.lexicon(path)).tolist() == expected


def test_lexicon_transitions_sum_to_the_library(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, random_ = bpe.library(path), random.Random(11)
    known = fst_tokens.Lexicon(path)
    runs = ["a" * 500, "ab" * 300, "!!!!" * 50, "0123456789" * 20, "é" * 77, "".join(thue_morse(300))]
    runs += ["".join(random_.choices("etaoinshr", k=random_.randint(1, 40))) for _ in range(400)]
    expected = [len(library.encode(x, add_special_tokens=False).ids) for x in runs]
    assert known.counts([x.encode() for x in runs]).tolist() == expected
    monkeypatch.setattr(known, "KEPT", 10)  # all is compiled anew
    assert known.counts([x.encode() for x in reversed(runs)]).tolist() == expected[::-1]
    assert known.counts([]).tolist() == []


def test_count_tokens(odd, empty):
    rows, df = odd
    assert fst_tokens.count_tokens(df).count() == len(rows) and fst_tokens.count_tokens(empty).count() == 0
    got = {r["doc_id"]: r for r in fst_tokens.count_tokens(df).collect()}
    assert got[900]["n_tokens"] == got[901]["n_tokens"] == got[900]["n_bytes"] == 0 and got[903]["over_limit"]


def test_ids_match_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = TEXTS + [t for _, t, *_ in odd_documents() if t]
    ids, at = packing.WordTokenizer(path).encode([t.encode() for t in texts])
    for k, x in enumerate(Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)):
        assert ids[at[k] : at[k + 1]].tolist() == x.ids


def test_best_fit():
    random.seed(3)
    lengths = np.array([random.randint(1, 64) for _ in range(300)])
    window, offset = packing.best_fit_decreasing(lengths, 64)
    room, expected = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = [(r, w) for w, r in enumerate(room) if r >= lengths[i]]
        if not fits:
            room.append(64)
            fits = [(64, len(room) - 1)]
        r = min(fits)[0]
        expected[i] = r  # any window with the least room that holds it
        room[next(w for w, x in enumerate(room) if x == r)] -= lengths[i]
    used = Counter()
    for i in np.argsort(-lengths, kind="stable"):
        assert offset[i] == used[window[i]] and 64 - used[window[i]] == expected[i]
        used[window[i]] += lengths[i]
    assert len(used) == len(room) and max(used.values()) <= 64


def test_pack_documents(odd, empty):
    from tokenizers import Tokenizer

    rows, df = odd
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack_documents(df, windows_per_pack=3).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    expected = defaultdict(list)
    for d, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for low in range(0, len(ids), 2048):
            part = ids[low : low + 2048]
            expected[d].append((low, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)))
    assert {d: sorted(x) for d, x in pieces.items()} == {d: sorted(x) for d, x in expected.items()}
    for x in windows.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty).count() == 0


def test_language_id(spark, odd, empty):
    rows, df = odd
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = queries.op3_language_id(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    n, right = found.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 20 and right >= 0.97 * n
    got = {r["doc_id"]: r for r in language_id.identify(df, language_id.train_centroids(df)).collect()}
    assert len(got) == len({r[0] for r in rows}) and {got[k]["lang_pred"] for k in (900, 901, 902)} == {"und"} and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[903]["lang_pred"] in ("x", "y")
    nothing = language_id.train_centroids(empty)
    assert {r["lang_pred"] for r in language_id.identify(df, nothing).collect()} == {"und"} and language_id.identify(empty, nothing).count() == 0
    assert not language_id.has_letter(b"12 !?") and language_id.has_letter("é".encode()) and not language_id.has_letter("½ 🎉".encode())


def test_language_id_against_the_plain_version(odd):
    rows, df = odd
    model = language_id.train_centroids(df)
    taught = [t for _, t, lang, _ in rows if t is not None and lang is not None]
    grams = {t: {k: n for k, n in enumerate(language_id.ngram_counts([t.encode()])[0].tolist()) if n} for t in {t for _, t, *_ in rows if t}}
    seen = Counter(k for t in taught if t for k in grams[t])
    idf = [math.log((1 + len(taught)) / (1 + seen[k])) + 0.1 for k in range(language_id.SIZE)]
    assert model.idf.tolist() == pytest.approx(idf, rel=1e-4)
    found = {(r["doc_id"], round(r["score"], 4)): r for r in language_id.identify(df, model).collect()}
    checked = 0
    for d, t, *_ in rows:
        if t and any(c.isalpha() for c in t) and len(t) < 2000:
            x = {k: math.log1p(n) * idf[k] for k, n in grams[t].items()}
            norm = math.sqrt(sum(v * v for v in x.values()))
            cosines = [sum(v * float(c[k]) for k, v in x.items()) / norm for c in model.vectors]
            best = max(cosines)
            r = next(found[key] for key in found if key[0] == d and abs(key[1] - best) < 2e-3)
            assert r["lang_pred"] in {lang for lang, c in zip(model.languages, cosines, strict=True) if c > best - 1e-4}
            checked += 1
    assert checked > 30
    # n-grams of a plain count
    for text in ("Abc  12 déF", "a", "x y x y x y"):
        b = re.sub(rb"[^a-z\x80-\xff]+", b" ", text.encode().lower())
        assert language_id.ngram_counts([text.encode()]).sum() == sum(max(0, len(b) - n + 1) for n in (1, 2, 3))


def test_class_lm(odd, empty):
    rows, df = odd
    model, counts = class_lm.train(df.select(F.col("text").alias("_text")))
    got = [r for r in class_lm.score(df, model, counts).collect() if r["doc_id"] is not None]
    c = Counter()
    tokens = {}
    for d, text, *_ in rows:
        w = [*WORD.findall(lower(text or "")), None]
        c.update(w)
        tokens[d] = w
    n, v = sum(c.values()), len(c)
    for r in got:
        w = tokens[r["doc_id"]]
        assert r["n_tokens"] == r["n_known"] == len(w)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert math.isfinite(r["score"]) and r["score"] <= 0
    # each state's transitions, and each class's emissions, are a distribution
    assert np.allclose((10.0**model.transition).sum(axis=1), 1)
    for k in set(model.classes.tolist()) - {model.rare_class}:
        assert (10.0 ** model.emission[model.classes == k]).sum() == pytest.approx(1)
    nothing, none = class_lm.train(empty.select(F.col("text").alias("_text")))
    assert class_lm.score(empty, nothing, none).count() == 0
    unknown = class_lm.score(df, nothing, none).collect()
    assert len(unknown) == len(rows) and all(r["n_known"] == 0 for r in unknown)


def test_class_lm_beats_the_base(spark):
    got = queries.op5_class_lm(spark, DATA).filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > got[0]


def test_exchange_finds_classes():
    rng = np.random.default_rng(1)
    truth = np.arange(40) % 4
    order = rng.permutation(40)
    follow = np.array([1, 2, 3, 0])
    bigrams = np.where(follow[truth[:, None]] == truth[None], 50, 0) + rng.integers(0, 2, (40, 40))
    own = class_lm.exchange(bigrams[np.ix_(order, order)].astype(float), 4, 8)
    groups = {}
    for i, k in zip(order, own, strict=True):
        groups.setdefault(k, set()).add(truth[i])
    assert all(len(x) == 1 for x in groups.values())


def test_rare_words_are_joined(odd, monkeypatch):
    rows, df = odd
    texts = df.select(F.col("text").alias("_text"))
    whole = {(r["doc_id"], r["n_tokens"]): r["base_score"] for r in class_lm.score(df, *class_lm.train(texts)).collect()}
    monkeypatch.setattr(class_lm, "FREQUENT", 12)
    monkeypatch.setattr(class_lm, "CLUSTERED", 8)
    model, counts = class_lm.train(texts)
    assert len(model.words) <= 12
    for r in class_lm.score(df, model, counts).collect():
        assert r["base_score"] == pytest.approx(whole[r["doc_id"], r["n_tokens"]]) and r["n_known"] == r["n_tokens"] and math.isfinite(r["score"])


@pytest.mark.parametrize("frequent", [1 << 17, 12])
def test_scores_against_the_plain_model(odd, monkeypatch, frequent):
    """Given the words' classes, the transitions, emissions and scores of a plain class bigram model."""
    rows, df = odd
    monkeypatch.setattr(class_lm, "FREQUENT", frequent)
    monkeypatch.setattr(class_lm, "CLUSTERED", 8)
    learn = df.filter("doc_id is null or doc_id % 3 > 0")
    model, counts = class_lm.train(learn.select(F.col("text").alias("_text")))
    known = {r["w"]: (r["c"], r["cls"]) for r in counts.collect()}
    end = int(np.array([class_lm.END]).view(np.int64)[0])
    key = lambda w: int(textkit.words([w.encode()], lower=True)[3].view(np.int64)[0])
    tokens = lambda t: [end, *map(key, WORD.findall(t or "")), end]
    states, joint = class_lm.CLASSES + 1, np.zeros((class_lm.CLASSES + 1,) * 2)
    seen = Counter()
    for d, t, *_ in rows:
        if d is None or d % 3:
            w = tokens(t)
            seen.update(w[1:])
            for a, b in zip(w, w[1:]):  # noqa: B905
                joint[known[a][1], known[b][1]] += 1
    assert {w: c for w, (c, _) in known.items()} == seen
    once = max(0.5, sum(c == 1 for c in seen.values()))
    joint[:, -1] += once * joint.sum(axis=1) / max(1, joint.sum())
    unigram = (joint.sum(axis=0) + 0.5) / (joint.sum() + 0.5 * states)
    follow = (joint + 20 * unigram) / (joint.sum(axis=1, keepdims=True) + 20)
    mass = np.bincount([k for _, k in known.values()], [c for c, _ in known.values()], minlength=states)
    mass[-1] += once
    expected = Counter()
    for d, t, *_ in rows:
        at = [known.get(w, (once, states - 1)) for w in tokens(t)]
        expected[d, round(sum(math.log10(follow[a[1], b[1]]) + math.log10(b[0] / mass[b[1]]) for a, b in zip(at, at[1:])), 6)] += 1  # noqa: B905
    got = Counter((r["doc_id"], round(r["score"], 6)) for r in class_lm.score(df, model, counts).collect())
    assert sum((got & expected).values()) >= 0.97 * len(rows) and sorted(x for _, x in got.elements()) == pytest.approx(sorted(x for _, x in expected.elements()), abs=1e-5)


def test_digest_columns(spark):
    r = queries.op6_substring_dedup(spark, DATA).filter("n_removed = 0").first()
    text = spark.read.parquet(f"{DATA}/documents.parquet").filter(F.col("doc_id") == r["doc_id"]).first()["text"]
    assert r["kept_sha256"] == hashlib.sha256(" ".join(WORD.findall(text)).encode()).hexdigest()


def test_all_words_get_a_class_of_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "FREQUENT", 24)
    monkeypatch.setattr(class_lm, "CLUSTERED", 12)
    monkeypatch.setattr(class_lm, "CLASSES", 3)
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(400):
        # words a0 to a29 stand before b0 to b29 and so on; those of small numbers are frequent
        texts.append(" ".join(f"{'ab'[i % 2]}{min(29, int(rng.exponential(6)))}" for i in range(20)))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model, counts = class_lm.train(df.select(F.col("text").alias("_text")))
    names = [f"{x}{i}" for x in "ab" for i in range(30)]
    hashes = dict(zip(class_lm._tokens([" ".join(names).encode()])[1].view(np.int64).tolist(), names, strict=False))
    got = {hashes[r["w"]]: r["cls"] for r in counts.collect() if r["w"] in hashes}
    assert len(got) > len(model.words) and model.rare_class not in got.values()
    assert not {k for w, k in got.items() if w[0] == "a"} & {k for w, k in got.items() if w[0] == "b"}
    # the score against the plain sum over tokens
    c = Counter(x for t in texts for x in [*t.split(), None])
    end = {r["w"]: r["cls"] for r in counts.collect()}[int(np.array([class_lm.END]).view(np.int64)[0])]
    cls = {**got, None: end}
    for r in class_lm.score(df, model, counts).collect():
        own = [None, *texts[r["doc_id"]].split(), None]
        assert r["score"] == pytest.approx(sum(model.transition[cls[a], cls[b]] + math.log10(c[b] / model.mass[cls[b]]) for a, b in zip(own, own[1:], strict=False)))


def test_long_pretokens(monkeypatch):
    """Words of any length cost time in proportion, and the library's counts stay as the table is dropped on the way."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    random.seed(4)
    texts = ["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for n in (63, 64, 65, 129, 5000)] + ["é" * 3000, "ab" * 4000, " " * 5000 + "x", "!" * 2000, "a " * 50 + "b" * 700]
    expected = [len(x.ids) for x in bpe.library(path).encode_batch(texts, add_special_tokens=False)]
    assert fst_tokens.token_counts([t.encode() for t in texts], fst_tokens.Lexicon(path)).tolist() == expected
    small = fst_tokens.Lexicon(path)
    monkeypatch.setattr(small, "KEPT", 300)
    assert fst_tokens.token_counts([t.encode() for t in texts], small).tolist() == expected and len(small.moves) <= 300
    began = time.process_time()
    fst_tokens.token_counts(["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=100_000)).encode()], fst_tokens.Lexicon(path))
    assert time.process_time() - began < 20


def test_anchor_of_many_words(spark, monkeypatch):
    """Texts of one repeated word are one segment each; an anchor of many words is counted by windows, with the same result."""
    rows = [(k, "same " * (200 + k % 3) + f"own{k} " * (k % 2)) for k in range(30)] + [(99, "same " * 49), (100, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    usual = sorted((r["doc_id"], r["n_removed"], r["kept_text"]) for r in substring_dedup.substring_dedup(df).collect())
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", 1000)
    assert usual == sorted((r["doc_id"], r["n_removed"], r["kept_text"]) for r in substring_dedup.substring_dedup(df).collect())
    assert usual[0][1] == 0 and all(n == 200 + d % 3 for d, n, _ in usual if 2 < d < 99)
