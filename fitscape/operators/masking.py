"""Masked training rows and masked-marginal scoring rows."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitscape.functions.alphabet import aa_index
from fitscape.operators.assay import code_sites, with_nodes

IGNORED = -100


def sample_masks(threaded: DataFrame, ratio: float = 0.15, seed: int = 1012, epochs: int = 1) -> DataFrame:
    """family_id, seq_id, epoch, node, visible (-1 if masked or a gap), is_masked, label (IGNORED elsewhere).

    max(1, half-even round of ratio * valid) nodes of each sequence and epoch, those of least md5 of
    seed:epoch:sequence:node. A sequence without valid nodes has none. threaded: rows with sites, which are masked
    inside their array, without any shuffle, or with nodes and letters (thread_indices); or a row for each node, gathered
    by sequence first.
    """
    if "letters" not in threaded.columns:
        if "sites" not in threaded.columns:
            threaded = threaded.groupBy("family_id", "seq_id").agg(F.collect_list(F.struct("node", "aa_idx")).alias("sites"))
        threaded = threaded.select("family_id", "seq_id", F.transform("sites", lambda x: x["node"]).alias("nodes"), F.transform("sites", lambda x: x["aa_idx"]).alias("letters"))
    kinds = dict(threaded.dtypes)
    node = threaded.schema["nodes"].dataType.elementType.simpleString()
    rows = threaded.select("family_id", "seq_id", F.col("seq_id").cast("string").alias("_name"), "nodes", "letters")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                batch = whole.slice(low, 1000)
                nodes, letters = batch.column("nodes"), pc.fill_null(batch.column("letters").flatten(), -1).to_numpy(zero_copy_only=False)
                ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(nodes), 0).to_numpy(zero_copy_only=False))]
                flat = nodes.flatten()
                # null nodes have no hash, as in SQL; texts are made once for each node of the batch
                place = pc.dictionary_encode(flat, null_encoding="encode")
                texts = [None if x is None else str(x).encode() for x in place.dictionary.to_pylist()]
                place = place.indices.to_numpy(zero_copy_only=False)
                named = np.array([x is not None for x in texts], bool)
                valid = (letters >= 0) & (named[place] if len(texts) else False)
                row = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(ends)))
                names = ["" if x is None else f"{x}:" for x in batch.column("_name").to_pylist()]
                every = np.flatnonzero(valid)
                cuts = np.searchsorted(every, ends)
                for epoch in range(epochs):
                    hidden = np.zeros(len(letters), bool)
                    prefixes = [f"{seed}:{epoch}:{x}".encode() for x in names]
                    first = _first_halves(prefixes, np.diff(cuts), texts, place[every])
                    for k, prefix in enumerate(prefixes):
                        own = every[cuts[k] : cuts[k + 1]]
                        if len(own):
                            n = max(1, round(len(own) * ratio))
                            near = first[cuts[k] : cuts[k + 1]]
                            out = near <= np.partition(near, n - 1)[n - 1]
                            # the first half alone may not tell
                            hidden[own] = out if np.count_nonzero(out) == n else _least(prefix, [texts[x] for x in place[own].tolist()], n)
                    visible, label = np.where(hidden, -1, letters).astype(np.int32), np.where(hidden, letters, IGNORED).astype(np.int32)
                    epoch_of = pa.array(np.full(len(letters), epoch, np.int32))
                    yield pa.RecordBatch.from_arrays([batch.column("family_id").take(row), batch.column("seq_id").take(row), epoch_of, flat, pa.array(visible), pa.array(hidden), pa.array(label)], ["family_id", "seq_id", "epoch", "node", "visible", "is_masked", "label"])

    return rows.mapInArrow(mask, f"family_id {kinds['family_id']}, seq_id {kinds['seq_id']}, epoch int, node {node}, visible int, is_masked boolean, label int")


def _least(prefix: bytes, texts: list[bytes], n: int) -> np.ndarray:
    """Which of the texts are the n of least md5 behind the prefix; equal texts go together."""
    digests = [hashlib.md5(prefix + x).digest() for x in texts]
    end = sorted(digests)[n - 1]
    return np.array([x <= end for x in digests], bool)


_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [np.uint32(int(abs(math.sin(k + 1)) * 2**32)) for k in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _first_halves(prefixes: list[bytes], sizes: np.ndarray, texts: list[bytes | None], place: np.ndarray, rows: int = 1 << 14) -> np.ndarray:
    """The first eight bytes, as a number in byte order, of the md5 of prefix + text: `sizes` texts (at `place` in texts) for each prefix in turn. All are computed in step where they fit one block of md5."""
    wide = max((len(x) for x in texts if x is not None), default=0)
    if max(map(len, prefixes), default=0) + wide > 55:
        ends = np.r_[0, np.cumsum(sizes)]
        digests = [hashlib.md5(p + texts[x]).digest()[:8] for p, low, high in zip(prefixes, ends[:-1], ends[1:], strict=True) for x in place[low:high].tolist()]
        return np.frombuffer(b"".join(digests), ">u8").astype(np.uint64)
    length = np.array([len(x or b"") for x in texts], np.uint32)
    ending = np.frombuffer(b"".join(((x or b"") + b"\x80").ljust(wide + 1, b"\0") for x in texts), np.uint8).reshape(len(texts), wide + 1)
    head = np.array([len(x) for x in prefixes], np.uint32)
    starts = np.frombuffer(b"".join(x.ljust(64, b"\0") for x in prefixes), np.uint8).reshape(-1, 64)
    which, out = np.repeat(np.arange(len(prefixes)), sizes), np.empty(len(place), np.uint64)
    for low in range(0, len(place), rows):
        mine, at = which[low : low + rows], place[low : low + rows]
        block = starts[mine]
        for size in np.unique(head[mine]).tolist():
            some = np.flatnonzero(head[mine] == size)
            block[some, size : size + wide + 1] = ending[at[some]]
        words = np.ascontiguousarray(block.view("<u4").T)
        words[14] = 8 * (head[mine] + length[at])
        a, b = _md5_start(words)
        out[low : low + rows] = a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()
    return out


def _md5_start(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the md5 of blocks of 16 words, a column each."""
    a, b, c, d = (np.full(words.shape[1], x) for x in _START)
    for k in range(64):
        turn = k // 16
        mixed = _mixed(turn, b, c, d)
        mixed += a
        mixed += words[(k, 5 * k + 1, 3 * k + 5, 7 * k)[turn] % 16]
        mixed += _SINES[k]
        shift = _SHIFTS[turn][k % 4]
        a, d, c, b = d, c, b, b + (mixed << np.uint32(shift) | mixed >> np.uint32(32 - shift))
    return a + _START[0], b + _START[1]


def _mixed(turn: int, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    if turn == 0:
        return d ^ (b & (c ^ d))
    if turn == 1:
        return c ^ (d & (b ^ c))
    return b ^ c ^ d if turn == 2 else c ^ (b | ~d)


def masked_marginals(variants: DataFrame, mapping: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """assay_id, ord, site_no, node, label (experiment wild type), mut_idx: the sites to mask of aligned rows. With `covered` (node), only covered sites."""
    sites = code_sites(F.col("code"))
    v = with_nodes(variants, mapping).filter("node_1 is not null").withColumn("_s", sites)
    pick = lambda k: F.struct(F.lit(k).alias("site_no"), F.col(f"node_{k}").alias("node"), aa_index(F.col(f"wt_{k}")).alias("label"), aa_index(F.get("_s", F.lit(k - 1))["mut"]).alias("mut_idx"), F.get("_s", F.lit(k - 1)).isNotNull().alias("has"))
    out = v.select("assay_id", "ord", F.inline(F.array(pick(1), pick(2)))).filter("has and node is not null").drop("has")
    return out if covered is None else out.join(covered.select("node").distinct(), "node", "left_semi").select("assay_id", "ord", "site_no", "node", "label", "mut_idx")


def property_delta(masked: DataFrame, residues: DataFrame, properties: DataFrame) -> DataFrame:
    """family_id, seq_id, epoch, node, prop_id, delta: property of the visible letter less that of the structure's; 0 where nothing is visible. masked: a row for each place, or (visible_counts) for each node and letter, whose number n is a column of the result then."""
    keys = [x for x in ("family_id", "seq_id", "epoch", "node", "n") if x in masked.columns]
    wt = residues.join(properties, "aa").select("family_id", "node", "prop_id", F.col("value").alias("wt_value"))
    seen = properties.select(aa_index(F.col("aa")).alias("visible"), "prop_id", "value")
    j = masked.join(wt, ["family_id", "node"]).join(seen, ["visible", "prop_id"], "left")
    return j.select(*keys, "prop_id", F.coalesce(F.col("value") - F.col("wt_value"), F.lit(0.0)).alias("delta"))


def visible_counts(masked: DataFrame) -> DataFrame:
    """family_id, node, visible, n: masked rows counted, for sums over sequences of what depends on these alone."""
    return masked.groupBy("family_id", "node", "visible").agg(F.count("*").alias("n"))


def covered_flag(masked: DataFrame) -> DataFrame:
    """Adds covered: 1 if a letter is visible or masked."""
    return masked.withColumn("covered", F.when((F.col("visible") >= 0) | F.col("is_masked"), 1).otherwise(0))
