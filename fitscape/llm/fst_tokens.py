"""Token counts by finite-state transducers compiled from a tokenizer file.

The first transducer cuts texts into pretokens. Its input is a character's class (letter, number, white space and so
on, with what follows where the cut depends on it); each transition says whether a pretoken ends before the character.
A character is then a map from states to states. These maps form a small monoid: it is listed once with its table of
products, so that a map is one number. Texts are laid out in chunks of equal length; all chunks are composed in step,
a parallel prefix scan over the chunks' maps gives each chunk its start state, and a second pass reads off the cuts.

The second transducer is the lexicon, compiled from the vocabulary's merges. Its input is a pretoken's bytes, and each
transition emits how many tokens more the pretoken so far has (less than none where a byte lets tokens merge), so that
the emissions of a pretoken sum to its count. A state is the longest end of what was read that still begins a token,
with the last token and the count at each place in it: the next last token is the one ending here that no merge joins
with the last token before it. States are numbered and transitions kept as texts need them. The distinct pretokens of a
slice go through it in step; a text's count is the sum of what its transitions emit.
"""

from __future__ import annotations

import json
import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitscape.llm import bpe
from fitscape.llm import textkit as kit
from fitscape.llm.shared import small_slices

# classes of characters: a space or other white space before a visible character stands alone; an apostrophe may begin
# a contraction of one or two letters; the edge stands between texts
LETTER, NUMBER, OTHER, SHORT, LONG, LAST_SPACE, LAST_BLANK, BLANK, EDGE = range(9)
# states: before a new pretoken, inside one of letters, numbers or others, behind the space that leads one, inside white
# space, and with one or two letters of a contraction to come
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, LED, IN_BLANKS, ONE_MORE, TWO_MORE = range(8)
CHUNK = 128


def _transition(state: int, kind: int) -> tuple[int, bool]:
    """(next state, whether a pretoken ends before the character)."""
    if kind == EDGE:
        return FRESH, True
    if state in (ONE_MORE, TWO_MORE):
        return (FRESH if state == ONE_MORE else ONE_MORE), False
    if kind == BLANK:
        return IN_BLANKS, state != IN_BLANKS
    if kind in (LAST_SPACE, LAST_BLANK):
        return (LED if kind == LAST_SPACE else FRESH), True
    if kind in (SHORT, LONG) and state not in (IN_OTHERS, LED):
        return (ONE_MORE if kind == SHORT else TWO_MORE), True
    inside = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS}.get(kind, IN_OTHERS)
    return inside, state not in (inside, LED)


class Segmenter:
    """The compiled cutter: transition tables, the monoid of state maps and its products."""

    def __init__(self):
        table = [[_transition(s, k) for k in range(9)] for s in range(8)]
        self.next = np.array([[x[0] for x in row] for row in table], np.uint8)
        self.ends = np.array([[x[1] for x in row] for row in table])
        maps = {tuple(range(8)): 0}
        letters = [tuple(self.next[:, k].tolist()) for k in range(9)]
        todo = list(maps)
        while todo:
            for m in letters:
                made = tuple(m[s] for s in todo[0])
                if made not in maps:
                    maps[made] = len(maps)
                    todo.append(made)
            todo.pop(0)
        rows = np.array(list(maps), np.uint8)
        self.map_of_class = np.array([maps[m] for m in letters], np.uint16)
        self.product = np.array([[maps[tuple(b[a].tolist())] for b in rows] for a in rows], np.uint16)
        self.from_fresh = rows[:, FRESH]
        kind = np.full(0x110000, OTHER, np.uint8)
        first = np.array([unicodedata.category(chr(i))[0] for i in range(0x110000)])
        kind[first == "L"], kind[first == "N"] = LETTER, NUMBER
        # fixed values: Unicode's White_Space
        kind[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
        self.kind = kind

    def classes(self, codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """edges: positions of the characters between texts; the last character is one."""
        out = self.kind[codes]
        out[edges] = EDGE
        blank = np.flatnonzero(out == BLANK)
        lone = blank[(out[blank + 1] != BLANK) & (out[blank + 1] != EDGE)]
        mark = np.flatnonzero((codes == 39) & (out == OTHER))
        a, b = codes[mark + 1], codes[np.minimum(mark + 2, len(codes) - 1)]
        a[out[mark + 1] == EDGE] = 0
        out[lone] = np.where(codes[lone] == 32, LAST_SPACE, LAST_BLANK)
        out[mark[np.isin(a, [ord(c) for c in "stmd"])]] = SHORT
        pairs = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        out[mark[pairs]] = LONG
        return out

    def starts(self, classes: np.ndarray) -> np.ndarray:
        """Positions at which pretokens begin (edges are pretokens of their own)."""
        n = len(classes)
        chunks = -(-n // CHUNK)
        laid = np.full(chunks * CHUNK, EDGE, np.uint8)
        laid[:n] = classes
        laid = np.ascontiguousarray(laid.reshape(chunks, CHUNK).T)
        whole = self.map_of_class[laid[0]]
        for row in laid[1:]:
            whole = self.product[whole, self.map_of_class[row]]
        step = 1
        while step < chunks:  # inclusive scan: each chunk's map after all before it
            whole[step:] = self.product[whole[:-step].copy(), whole[step:]]
            step *= 2
        state = np.concatenate([[np.uint8(FRESH)], self.from_fresh[whole[:-1]]])
        cut = np.empty(laid.shape, bool)
        for k, row in enumerate(laid):
            cut[k] = self.ends[state, row]
            state = self.next[state, row]
        return np.flatnonzero(cut.T.reshape(-1)[:n])


class Lexicon:
    """The compiled lexicon: states, and transitions with the tokens that they emit."""

    #: Transitions kept at once (with their states about 400 bytes each); beyond that all are compiled anew. Bytes of pretokens that are read in step; what few have behind them is read one by one.
    KEPT, IN_STEP = 1 << 19, 64

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        code = {c: b for b, c in enumerate(bpe.byte_letters())}
        raw = lambda x: bytes(code[c] for c in x)
        self.special = [x["content"] for x in spec["added_tokens"]]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(pairs)}
        tokens = {raw(x) for x in spec["model"]["vocab"] if x not in set(self.special)}
        self.longest = max(map(len, tokens))
        self.begins = {x[:k] for x in tokens for k in range(1, len(x) + 1)}
        self.tokens = tokens
        self.edges: dict[bytes, tuple | None] = {}
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.states = [(b"", ((None, 0),))]
        self.number = {self.states[0]: 0}
        self.apart.clear()
        self.moves: dict[int, tuple[int, int]] = {}
        self.keys, self.to, self.emits = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _edges(self, token: bytes) -> tuple | None:
        """The parts at the token's left and right edge while it is merged, each with the rank of the merge that ends it; None if merges don't make the token."""
        if token not in self.edges:
            parts: list[tuple] = [(token[i : i + 1], None) for i in range(len(token))]
            left, right = [[parts[0][0], None]], [[parts[-1][0], None]]
            while len(parts) > 1:
                ranks = [self.merges.get((a[0], b[0]), math.inf) for a, b in zip(parts, parts[1:])]  # noqa: B905
                rank = min(ranks)
                if rank == math.inf:
                    break
                i = ranks.index(rank)
                parts[i : i + 2] = [(parts[i][0] + parts[i + 1][0], rank)]
                if i == 0:
                    left[-1][1] = rank
                    left.append([parts[0][0], None])
                if i == len(parts) - 1:
                    right[-1][1] = rank
                    right.append([parts[-1][0], None])
            ends = lambda x: [(p, math.inf if r is None else r) for p, r in x]
            self.edges[token] = (ends(left), ends(right)) if len(parts) == 1 else None
        return self.edges[token]

    def stay_apart(self, a: bytes, b: bytes) -> bool:
        """Whether no merge ever joins the end of token a with the beginning of token b. Of equal ranks the merge on the left goes first."""
        if (a, b) not in self.apart:
            joins = ((self.merges.get((x, y), math.inf), ends_x, ends_y) for x, ends_x in self._edges(a)[1] for y, ends_y in self._edges(b)[0])
            self.apart[a, b] = not any(rank < ends_x and rank <= ends_y and rank < math.inf for rank, ends_x, ends_y in joins)
        return self.apart[a, b]

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, tokens emitted)."""
        own, places = self.states[state]
        text = own + bytes([byte])
        for begin in range(max(0, len(text) - self.longest), len(text)):
            last, before = text[begin:], places[begin]
            if last in self.tokens and self._edges(last) and (before[0] is None or self.stay_apart(before[0], last)):
                break
        more = before[1] + 1
        keep = next(k for k in range(len(text)) if text[k:] in self.begins)
        made = (text[keep:], (*((t, n - more) for t, n in places[keep:]), (last, 0)))
        return self._numbered(made), more

    def _numbered(self, made: tuple) -> int:
        if made not in self.number:
            self.number[made] = len(self.states)
            self.states.append(made)
        return self.number[made]

    def _read_on(self, state: int, data: bytes) -> int:
        """Tokens emitted from a state on; a new transition costs no more than itself, and too many of them are dropped on the way."""
        total = 0
        for byte in data:
            key = state << 8 | byte
            move = self.moves.get(key)
            if move is None:
                if len(self.moves) >= self.KEPT:
                    here = self.states[state]
                    self._clear()
                    state = self._numbered(here)
                    key = state << 8 | byte
                move = self.moves[key] = self._compile(state, byte)
            state, n = move
            total += n
        return total

    def counts(self, pretokens: list[bytes]) -> np.ndarray:
        """Tokens of each pretoken: their first IN_STEP bytes all in step, the others' rest by itself."""
        if len(self.keys) + len(self.moves) > self.KEPT:
            self._clear()
        size = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        order = np.argsort(-size, kind="stable")
        data, start = np.frombuffer(b"".join(pretokens), np.uint8), (np.cumsum(size) - size)[order]
        longest_first = size[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for place in range(min(self.IN_STEP, int(size.max(initial=0)))):
            on = int(np.searchsorted(-longest_first, -place))
            key = state[:on] << 8 | data[start[:on] + place]
            at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            known = self.keys[at] == key if len(self.keys) else np.zeros(on, bool)
            if not known.all():
                new = np.unique(key[~known])
                made = np.array([self._compile(int(k) >> 8, int(k) & 255) for k in new], np.int64)
                keys = np.concatenate([self.keys, new])
                by_key = np.argsort(keys)
                self.keys, self.to, self.emits = keys[by_key], np.concatenate([self.to, made[:, 0]])[by_key], np.concatenate([self.emits, made[:, 1]])[by_key]
                at = np.searchsorted(self.keys, key)
            state[:on] = self.to[at]
            total[:on] += self.emits[at]
        # by content, as numbers change if the table is dropped on the way
        rest = [self.states[x] for x in state[: int(np.searchsorted(-longest_first, -self.IN_STEP))].tolist()]
        for i, here in enumerate(rest):
            total[i] += self._read_on(self._numbered(here), pretokens[order[i]][self.IN_STEP :])
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out


@lru_cache(maxsize=4)
def lexicon(path: str) -> Lexicon:
    """Once for each Python worker."""
    return Lexicon(path)


@lru_cache(maxsize=1)
def segmenter() -> Segmenter:
    return Segmenter()


def token_counts(texts: list[bytes], model: Lexicon) -> np.ndarray:
    """Tokens of each text; the strings of special tokens count as one each, as the library's default has it."""
    whole, owner, extra = [], [], np.zeros(len(texts), np.int64)
    marks = [(x, x.encode()) for x in model.special]
    for i, raw in enumerate(texts):
        parts = [raw.decode(errors="replace")]
        for mark, coded in marks:
            if coded in raw:
                parts = [p for part in parts for p in part.split(mark)]
        extra[i] = len(parts) - 1
        whole += parts
        owner += [i] * len(parts)
    joined = "\n".join([*whole, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", errors="replace"), np.uint32)
    edges = np.cumsum(np.fromiter(map(len, whole), np.int64, len(whole)) + 1) - 1
    if not len(codes):
        return extra
    cutter = segmenter()
    classes = cutter.classes(codes, edges)
    start = cutter.starts(classes)
    end = np.append(start[1:], len(codes))
    own = np.flatnonzero(classes[start] != EDGE)
    start, end = start[own], end[own]
    h = kit.sequence_hashes(codes.astype(np.uint64) + np.uint64(0x1F123BB5), start, end)
    _, index, inverse = np.unique(h, return_index=True, return_inverse=True)
    distinct = [joined[a:b].encode() for a, b in zip(start[index].tolist(), end[index].tolist(), strict=True)]
    emitted = model.counts(distinct)[inverse]
    total = np.concatenate([[0], np.cumsum(emitted)])
    at = np.searchsorted(start, np.concatenate([[0], edges + 1]))
    np.add.at(extra, np.array(owner, np.int64), total[at[1:]] - total[at[:-1]])
    return extra


def count_tokens(docs: DataFrame, *, path: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    `path` is a tokenizer file of byte-level BPE (byte_bpe_50k.json by default); no tokens are added. A null or empty
    text has 0; null ids and repeated rows are counted like others; a very long text is a slice of its own; an empty table
    gives none; extra columns are ignored.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lexicon(path)
        for batch, texts in small_slices(batches, "_text"):
            n = token_counts(texts, model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(count, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")
