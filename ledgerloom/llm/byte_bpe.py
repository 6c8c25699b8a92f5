"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece exactly one token can end its encoding. The table of these last tokens is
the whole state: reading it backwards gives the ids, appending bytes adds entries, and after an edit only the
entries near it are recomputed. Tasks fill the tables of all new pieces of a batch side by side, a column for each
prefix length, from arrays that are made of the vocabulary once on the driver.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerloom.llm.common import text_batches
from ledgerloom.llm.lookup import Lookup

#: Entries that a worker keeps of what it has met: pieces (in each of two generations), token pairs (in a table of eight
#: bytes each, where a pair takes the place of the one before it), moves of the automaton.
PIECES, PAIRS, MOVES = 100_000, 524_287, 60_000
#: Longest piece in bytes that is remembered and encoded side by side with others, how many are at once, and texts split at once.
SHORT, TOGETHER = 64, 32_768
GROUP = 512


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks from the bytes of a rank file: a base64 token and its rank in each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


class PrefixEncoder:
    """Exact byte-pair encoding of one piece by the last token of each of its prefixes.

    The tokens that end at a byte are read off an automaton over the vocabulary: its state is the longest end of the
    bytes so far that begins a token, and each state lists the tokens that are ends of it, the longest first.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.reach = max(map(len, ranks), default=1)
        self.joins = array("q", [-1]) * PAIRS  # pair of tokens << 1 | whether they stay as they are
        self.split: dict[int, tuple[int, int] | None] = {}
        self.span = max(self.tokens, default=0) + 1
        self.tree: dict[int, int] = {}  # state << 8 | byte -> state, of the tree of tokens
        self.moves: dict[int, int] = {}  # the same where the tree ends, as far as met
        own, above = array("i", [-1]), array("i", [-1])  # by state: its token, the entry of the tree that leads to it
        for token, rank in ranks.items():
            state = 0
            for byte in token:
                key = state << 8 | byte
                state = self.tree.get(key, 0)
                if not state:
                    state = self.tree[key] = len(own)
                    own.append(-1)
                    above.append(key)
            own[state] = rank
        self.own, self.above = own, above
        self.shorter = array("i", [-1]) * len(own)  # by state: that of its longest proper end; -1: not looked up yet
        self.tails: list[tuple[tuple[int, int], ...] | None] = [None] * len(own)

    def move(self, state: int, byte: int) -> int:
        """The state after one more byte."""
        key = state << 8 | byte
        found = self.tree.get(key)
        if found is None:
            found = self.moves.get(key)
        if found is None:
            found = self.move(self.back(state), byte) if state else 0
            if len(self.moves) >= MOVES:
                self.moves.clear()
            self.moves[key] = found
        return found

    def back(self, state: int) -> int:
        if self.shorter[state] < 0:
            key = self.above[state]
            self.shorter[state] = self.move(self.back(key >> 8), key & 255) if key >> 8 else 0
        return self.shorter[state]

    def tail(self, state: int) -> tuple[tuple[int, int], ...]:
        """(token, length) of the tokens that end in ``state``, the longest first."""
        if not state:
            return ()
        if self.tails[state] is None:
            rest, token = self.tail(self.back(state)), self.own[state]
            self.tails[state] = rest if token < 0 else ((token, len(self.tokens[token])), *rest)
        return self.tails[state]

    def merged(self, piece: bytes, below: int | None = None) -> list[int]:
        """The ids by the definition: merge the pair of lowest rank (under ``below``), leftmost first. For tokens only."""
        rank, none = self.ranks.get, self.span if below is None else below
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            found = [rank(x + y, none) for x, y in zip(parts, parts[1:], strict=False)]
            best = min(found)
            if best >= none:
                break
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        if token not in self.split:
            raw = self.tokens[token]
            parts = self.merged(raw, token) if len(raw) > 1 else ()
            self.split[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.split[token]

    def may_start(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as the token."""
        return len(self.tokens[token]) == 1 or self.halves(token) is not None

    def may_follow(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are when their bytes are encoded together.

        Undo the merges on both sides of the border from the latest back. At each moment the two tokens that
        touch must not have had a merge of their own that came before the next merge of either.
        """
        if not (self.may_start(left) and self.may_start(right)):
            return False
        tokens, none, until = self.tokens, self.span, self.span
        while True:
            if self.ranks.get(tokens[left] + tokens[right], none) < until:
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                left, until = a[1], left
            else:  # of equal ranks the left one is merged first, so the right one is undone first
                right, until = b[0], right + 1

    def extend(self, piece: bytes, last: list[int], same: list[int] | None = None, shift: int = 0) -> list[int]:
        """Fill ``last`` (token that ends each prefix; entry 0 unused) up to the end of ``piece``.

        With ``same``, an earlier table of a piece that had these bytes ``shift`` places further on, filling
        stops as soon as it agrees with that table over the reach of the longest token; the rest is copied.
        """
        if not last:
            last.append(-1)
        agree, joins, span, tree, tails = 0, self.joins, self.span, self.tree, self.tails
        start, state = len(last) - 1, 0
        for byte in piece[max(0, start - self.reach) : start]:
            state = self.move(state, byte)
        for end, byte in enumerate(memoryview(piece)[start:], start + 1):
            found = tree.get(state << 8 | byte)
            state = self.move(state, byte) if found is None else found
            ends = tails[state]
            for token, size in self.tail(state) if ends is None else ends:
                if size == end:
                    ok = self.may_start(token)
                else:
                    pair = last[end - size] * span + token
                    known = joins[pair % PAIRS]
                    if known >> 1 == pair:
                        ok = known & 1
                    else:
                        ok = self.may_follow(last[end - size], token)
                        joins[pair % PAIRS] = pair << 1 | ok
                if ok:
                    last.append(token)
                    break
            else:
                raise ValueError("a byte of the text has no token")
            if same is not None and 0 < end + shift < len(same):
                agree = agree + 1 if same[end + shift] == last[end] else 0
                if agree > self.reach:
                    last.extend(same[end + shift + 1 :])
                    break
        return last

    def edit(self, old: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """Replace ``old[start:end]`` by ``new``; only prefixes from the edit on are looked at again."""
        piece, shift = old[:start] + new + old[end:], end - start - len(new)
        fresh = self.extend(piece[: start + len(new)], last[: start + 1])
        return piece, self.extend(piece, fresh, last, shift)

    def ids_of(self, piece: bytes, last: list[int]) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ids, end = [], len(piece)
        while end:
            ids.append(last[end])
            end -= len(self.tokens[last[end]])
        return ids[::-1]

    def encode(self, piece: bytes) -> list[int]:
        if not piece:
            return []
        if piece in self.ranks:
            return [self.ranks[piece]]
        return self.ids_of(piece, self.extend(piece, []))


class Vocabulary:
    """Arrays for filling the prefix tables of many pieces at once; made on the driver, as large as the vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        one = PrefixEncoder(ranks)
        self.ranks, self.span, n = ranks, one.span, len(one.own)
        self.own = np.array(one.own, np.int32)
        above = np.array(one.above, np.int64)
        up, byte = above >> 8, above & 255
        self.tree = Lookup(np.fromiter(one.tree.keys(), np.int64, n - 1), np.fromiter(one.tree.values(), np.int32, n - 1))
        self.depth, self.back, self.first = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        at = np.flatnonzero(up == 0)
        at, level = at[at > 0], 1
        while len(at):  # by level: the state of the longest proper end, and the nearest state along those that is a token
            self.depth[at] = level
            if level > 1:
                self.back[at] = self.move(self.back[up[at]], byte[at])
            self.first[at] = np.where(self.own[at] >= 0, at, self.first[self.back[at]])
            inside = np.zeros(n, bool)
            inside[at] = True
            inside[0] = False
            at, level = np.flatnonzero(inside[up] & (above >= 0)), level + 1
        self.next = self.first[self.back]
        self.left, self.right = np.full(self.span, -1, np.int32), np.full(self.span, -1, np.int32)
        self.starts, self.size = np.zeros(self.span, bool), np.zeros(self.span, np.int32)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            self.size[rank], self.starts[rank] = len(token), one.may_start(rank)
            if (parts := one.halves(rank)) is not None:
                self.left[rank], self.right[rank] = parts
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    pairs[a * self.span + b] = rank
        self.pairs = Lookup(np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        self.known = np.full(PAIRS, -1, np.int64)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"known": np.full(PAIRS, -1, np.int64)}

    def move(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after one more byte each."""
        found = self.tree.get(state.astype(np.int64) << 8 | byte, -1)
        open_ = np.flatnonzero((found < 0) & (state > 0))
        while len(open_):
            state = state.copy() if state.flags.owndata else np.array(state)
            state[open_] = self.back[state[open_]]
            found[open_] = self.tree.get(state[open_].astype(np.int64) << 8 | byte[open_], -1)
            open_ = open_[(found[open_] < 0) & (state[open_] > 0)]
        return np.maximum(found, 0)

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """As ``PrefixEncoder.may_follow`` for many pairs."""
        ok = self.starts[left] & self.starts[right]
        at = np.flatnonzero(ok)
        left, right, until = left[at], right[at], np.full(len(at), self.span)
        while len(at):
            broken = self.pairs.get(left.astype(np.int64) * self.span + right, self.span) < until
            ok[at[broken]] = False
            a, b = self.right[left], self.left[right]
            on = ~broken & ((a >= 0) | (b >= 0))
            at, left, right, a, b = at[on], left[on], right[on], a[on], b[on]
            by_left = (b < 0) | ((a >= 0) & (left > right))
            until = np.where(by_left, left, right + 1)
            left, right = np.where(by_left, a, left), np.where(by_left, right, b)
        return ok

    def stay(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``may_follow`` with a memory of earlier pairs."""
        pair = left.astype(np.int64) * self.span + right
        slot = pair % PAIRS
        found = self.known[slot]
        new = np.flatnonzero(found >> 1 != pair)
        if len(new):
            fresh, back = np.unique(pair[new], return_inverse=True)
            fresh = fresh << 1 | self.may_follow((fresh // self.span).astype(np.int32), (fresh % self.span).astype(np.int32))
            self.known[(fresh >> 1) % PAIRS] = fresh
            found[new] = fresh[back]
        return (found & 1).astype(bool)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece (not empty) as little-endian unsigned 32-bit integers."""
        n, size = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-size, kind="stable")
        flat, begin = np.frombuffer(b"".join(pieces), np.uint8), (np.cumsum(size) - size)[order]
        size, own = size[order], np.arange(n)
        longest = int(size[0]) if n else 0
        last, state = np.full((longest + 1, n), -1, np.int32), np.zeros(n, np.int32)
        for end in range(1, longest + 1):
            todo = own[: np.searchsorted(-size, -end, "right")]
            state = self.move(state[: len(todo)], flat[begin[todo] + end - 1].astype(np.int64))
            ending = self.first[state]
            while len(todo):
                if not ending.all():
                    raise ValueError("a byte of the text has no token")
                token, reach = self.own[ending], self.depth[ending]
                before = last[end - reach, todo]
                ok = self.starts[token] & (reach == end)
                inner = np.flatnonzero(reach < end)
                ok[inner] = self.stay(before[inner], token[inner])
                last[end, todo[ok]] = token[ok]
                todo, ending = todo[~ok], self.next[ending[~ok]]
        steps, at, left = [], size.copy(), own
        while len(left := left[at[left] > 0]):
            token = last[at[left], left]
            steps.append((left, token))
            at[left] -= self.size[token]
        count = np.zeros(n, np.int64)
        for left, _ in steps:
            count[left] += 1
        stop = np.empty(n, np.int64)
        stop[order] = count
        stop = np.cumsum(stop)  # in the order of the pieces
        place, ids = stop[order] - 1, np.empty(int(stop[-1]) if n else 0, "<u4")
        for i, (left, token) in enumerate(steps):
            ids[place[left] - i] = token
        raw, ends = ids.tobytes(), (4 * stop).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


#: Texts of these characters alone are split by a pattern that names them, which is several times as fast.
PLAIN_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
NOT_PLAIN = re.compile(f"[^\\t-\\r -~{PLAIN_LETTERS}]")


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """What splits a text as ``pattern`` does under the ``regex`` module."""
    import regex

    general = regex.compile(pattern).findall
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^\\t-\\r 0-9{PLAIN_LETTERS}]").replace(r"\p{L}", f"[{PLAIN_LETTERS}]").replace(r"\p{N}", "[0-9]").replace(r"\S", r"[^\t-\r ]").replace(r"\s", r"[\t-\r ]")
    if "\\p" in plain or "[[" in plain:
        return general
    fast, odd = re.compile(plain).findall, NOT_PLAIN.search
    return lambda t: general(t) if odd(t) else fast(t)


class _Pieces(dict):
    """From a piece of text to its ids as little-endian unsigned 32-bit integers.

    When the young generation is full it becomes the old one; pieces met again move back, so frequent ones stay.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.old: dict[str, bytes] = {}
        self.one: PrefixEncoder | None = None

    def learn(self, pieces: set[str]) -> None:
        """Take in all of ``pieces`` that are new; they stay until the next call."""
        new = [p for p in pieces if p not in self]
        if len(self) > PIECES:
            self.old = dict(self)
            self.clear()
        fresh = []
        for p in new:
            packed = self.old.get(p)
            if packed is None:
                fresh.append(p)
            else:
                self[p] = packed
        whole, ranks = [], self.vocabulary.ranks
        for p in fresh:
            raw = p.encode("utf-8", "surrogatepass")
            if (rank := ranks.get(raw)) is not None:
                self[p] = pack("<I", rank)
            elif len(raw) <= SHORT:
                whole.append((p, raw))
        for at in range(0, len(whole), TOGETHER):
            some = whole[at : at + TOGETHER]
            self.update(zip([p for p, _ in some], self.vocabulary.encode([raw for _, raw in some]), strict=True))

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:  # a long one
            if self.one is None:
                self.one = PrefixEncoder(self.vocabulary.ranks)
            ids = self.one.encode(piece.encode("utf-8", "surrogatepass"))
            packed = pack(f"<{len(ids)}I", *ids)
        return packed


@lru_cache(maxsize=2)
def vocabulary(ranks_file: bytes) -> Vocabulary:
    return Vocabulary(read_ranks(ranks_file))


_kept: list[_Pieces] = []


def _pieces(shared: Broadcast) -> _Pieces:
    """One table for all tasks of a query that a worker process runs."""
    if not _kept or _kept[0].vocabulary is not shared.value:
        _kept[:] = [_Pieces(shared.value)]
    return _kept[0]


def _encoder(shared: Broadcast, pattern: str) -> Callable[[list[str | None]], list[bytes]]:
    split, pieces = splitter(pattern), _pieces(shared)

    def run(texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), GROUP):
            parts = [split(t) if t else [] for t in texts[at : at + GROUP]]
            pieces.learn(set().union(*parts))
            out.extend(b"".join(map(pieces.__getitem__, p)) for p in parts)
        return out

    return run


def _decoder(shared: Broadcast) -> Callable[[list[bytes | None]], list[bytes]]:
    token = {rank: raw for raw, rank in shared.value.ranks.items()}.__getitem__
    return lambda packed: [b"".join(map(token, np.frombuffer(p, "<u4").tolist())) if p else b"" for p in packed]


def _add(batch: pa.RecordBatch, named: dict[str, list[bytes]], drop: tuple[str, ...]) -> pa.RecordBatch:
    columns = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in named and n not in drop]
    return pa.RecordBatch.from_arrays([c for _, c in columns] + [pa.array(v, pa.binary()) for v in named.values()], [n for n, _ in columns] + list(named))


def _mapped(df: DataFrame, run: Callable, named: tuple[str, ...], drop: tuple[str, ...]) -> DataFrame:
    text_batches(df.sparkSession)
    schema = T.StructType([f for f in df.schema.fields if f.name not in named + drop] + [T.StructField(n, T.BinaryType()) for n in named])
    return df.mapInArrow(run, schema)


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.names.index(name)).to_pylist()


def encode(df: DataFrame, ranks_file: bytes, pattern: str, text: str = "text", ids: str = "token_ids", keep_text: bool = False) -> DataFrame:
    """Add ``ids``: the token ids of the whole text as little-endian unsigned 32-bit integers.

    ``ranks_file``: the bytes of a rank file (a vocabulary is bounded); ``pattern`` splits a text into pieces.
    A null or empty text has no ids. Rows are handled one by one, so repeated rows and extra columns pass
    through; a column of the name ``ids`` is replaced. Texts of any length are read whole; a piece's table grows with the
    piece, not with the text.
    """
    shared, drop = df.sparkSession.sparkContext.broadcast(vocabulary(ranks_file)), () if keep_text else (text,)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _encoder(shared, pattern)
        for batch in batches:
            yield _add(batch, {ids: ids_of(_column(batch, text))}, drop)

    return _mapped(df, run, (ids,), drop)


def decode(df: DataFrame, ranks_file: bytes, ids: str = "token_ids", out: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """Add ``out``: the bytes that the ids of ``encode`` stand for. Null ids give no bytes."""
    shared, drop = df.sparkSession.sparkContext.broadcast(vocabulary(ranks_file)), () if keep_ids else (ids,)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = _decoder(shared)
        for batch in batches:
            yield _add(batch, {out: bytes_of(_column(batch, ids))}, drop)

    return _mapped(df, run, (out,), drop)


def round_trip(df: DataFrame, ranks_file: bytes, pattern: str, text: str = "text", ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` of what it gives, in one pass over ``df``: half as many Python workers hold tables."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(ranks_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, bytes_of = _encoder(shared, pattern), _decoder(shared)
        for batch in batches:
            packed = ids_of(_column(batch, text))
            yield _add(batch, {ids: packed, out: bytes_of(packed)}, (text,))

    return _mapped(df, run, (ids, out), (text,))
