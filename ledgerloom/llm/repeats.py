"""Repeated byte strings, by a depth-limited radix sort of all suffixes.

Every window of ``n`` bytes is a suffix cut at depth ``n``; those that are equal in all digits are the repeated ones. The
digits are taken from the most significant on. A window's first digit is its anchor: of its runs of n // 2 bytes the one
with the least hash, which equal windows share at the same place, and which all windows of a stretch of text share. So the
first passes sort stretches, about one for every 25 bytes when n is 100, instead of windows:

1. exchange by the leading bits of the anchor's hash, sort by the rest of it: an anchor that occurs once is done;
2. sort by the digest of the whole stretch: all but the first of equal stretches are repeated in every window;
3. windows of stretches that share an anchor and differ are sorted one by one, by digests of their n bytes.

Each task of a pass first sorts what it has itself and hands on the first of equals only. A string in any number of documents
reaches the pass's task once from each of them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import settle, text_batches

#: Bytes of text that one step of the rolling hash takes, bytes and windows that a task sorts at a time, rows of a run that is handed on.
CHUNK, BATCH_BYTES, BATCH_WINDOWS, PASS_ROWS = 1 << 18, 8 << 20, 200_000, 4096
#: Bytes of text that fall on one bucket of an exchange, at most.
BUCKET_BYTES = 4 << 20
#: Columns of a record and their bytes: leading digit, digest, document, its text, first window, windows less one, mark.
RECORD = (("g", 8), ("c", 8), ("d", 8), ("t", 4), ("lo", 4), ("w", 2), ("m", 1))
SPAN = (("d", 8), ("t", 4), ("lo", 4), ("hi", 4))
U64 = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each byte; powers of an odd number modulo 2^64 and of its inverse."""
    base = 0x9E3779B97F4A7C15
    powers = lambda b: np.concatenate(([U64(1)], np.cumprod(np.full(2 * CHUNK, b, U64))))
    return _mixed(np.arange(1, 257, dtype=U64) * U64(base)), powers(base), powers(pow(base, -1, 2**64))


def anchors(buf: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each stretch of one anchor, and the anchor's hash.

    buf: segments of text one after the other, ``lengths`` their bytes; windows don't cross segments. Ties of the hash go
    to the left, so which anchor a window has follows from its bytes alone.
    """
    k, size = max(1, n // 2), len(buf)
    if size < n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U64)
    table, powers, inverse = _tables()
    upto = np.zeros(size + 1, U64)
    np.cumsum(table[buf] * powers[:size], out=upto[1:])
    g = _mixed((upto[k:] - upto[:-k]) * inverse[: size - k + 1])
    bits = U64(2 * CHUNK - 1)
    least, width = (g & ~bits) | np.arange(len(g), dtype=U64), 1
    over = n - k + 1
    while 2 * width <= over:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < over:
        least = np.minimum(least[: len(least) - (over - width)], least[over - width :])
    ends = np.repeat(np.cumsum(lengths), lengths)[: size - n + 1]
    at = np.flatnonzero(np.arange(size - n + 1) + n <= ends)
    place = (least[at] & bits).astype(np.int64)
    cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(at) != 1)) + 1
    starts = np.concatenate(([0], cut)).astype(np.int64) if len(at) else np.empty(0, np.int64)
    stops = np.concatenate((cut, [len(at)])).astype(np.int64)[: len(starts)] - 1
    return at[starts], at[stops], _mixed(g[place[starts]] + U64(1))  # anew: the least of many hashes has small leading bits


def _digests(views: list) -> np.ndarray:
    """Two 64-bit halves of the XXH3 hash of each."""
    d = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([d(v) for v in views]), "<u8").reshape(-1, 2) if views else np.empty((0, 2), U64)


def _pack(columns: dict[str, np.ndarray], kind: tuple) -> bytes:
    """Columns as planes of bytes, the leading zeros of small numbers together, so that a shuffle compresses them."""
    return b"".join(np.ascontiguousarray(columns[name].astype(f"u{size}" if size in (1, 2, 4, 8) else None, copy=False).view(np.uint8).reshape(-1, size).T).tobytes() for name, size in kind)


def _unpack(blobs: list[bytes], kind: tuple) -> dict[str, np.ndarray]:
    width, out = sum(size for _, size in kind), {name: [] for name, _ in kind}
    for blob in blobs:
        rows, at = len(blob) // width, 0
        raw = np.frombuffer(blob, np.uint8)
        for name, size in kind:
            out[name].append(np.ascontiguousarray(raw[at : at + rows * size].reshape(size, rows).T).view(f"u{size}").ravel())
            at += rows * size
    whole = {name: np.concatenate(parts) if parts else np.empty(0, f"u{size}") for (name, size), parts in zip(kind, out.values())}
    whole["d"] = whole["d"].view(np.int64)
    return whole


def _sorted(r: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of rows sorted by digit, digest and place: order, first of its digit, first of its digest, repeated, differs.

    Rows whose digit occurs once come first, unsorted. repeated: an equal one stands at an earlier place. differs: its
    digit has several digests, or a row that says so of another task (mark).
    """
    by = np.argsort(r["g"], kind="stable")
    g = r["g"][by]
    alike = np.zeros(len(g), bool)
    alike[1:] = g[1:] == g[:-1]
    alike[:-1] |= alike[1:].copy()
    single, many = by[~alike], by[alike]
    many = many[np.lexsort([r[name][many] for name in ("lo", "t", "d", "c", "g")])]
    order = np.concatenate((single, many))
    new_g, new_c, repeated = np.ones(len(order), bool), np.ones(len(order), bool), np.zeros(len(order), bool)
    differs = r["m"][order] > 0
    if len(many):
        s = len(single)
        col = {name: r[name][many] for name in ("g", "c", "d", "t", "lo")}
        moved = lambda name: np.concatenate(([True], col[name][1:] != col[name][:-1]))
        new_g[s:] = moved("g")
        new_c[s:] = new_g[s:] | moved("c")
        head = np.maximum.accumulate(np.where(new_c[s:], np.arange(len(many)), 0))
        elsewhere = (col["d"] != col["d"][head]) | (col["t"] != col["t"][head]) | (col["lo"] != col["lo"][head])
        repeated[s:] = ~new_c[s:] & elsewhere
        group = np.cumsum(new_g[s:]) - 1
        kinds = np.bincount(group, new_c[s:]) > 1
        marked = np.bincount(group, differs[s:]) > 0
        differs[s:] = (kinds | marked)[group]
    return order, new_g, new_c, repeated, differs


def _runs(d: np.ndarray, t: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> dict[str, np.ndarray]:
    """Byte ranges, those that touch made one."""
    order = np.lexsort((lo, t, d))
    d, t, lo, hi = d[order], t[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    if not len(d):
        return {"d": d, "t": t, "lo": lo, "hi": hi}
    doc = np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])))
    shift = (np.cumsum(doc) - 1) << 32  # the farthest end so far, within a document
    far = np.maximum.accumulate(hi + shift) - shift
    new = doc | np.concatenate(([True], lo[1:] > far[:-1]))
    at = np.flatnonzero(new)
    return {"d": d[at], "t": t[at], "lo": lo[at], "hi": far[np.concatenate((at[1:], [len(d)])) - 1]}


class _Exchange:
    """What a task hands on: records to the bucket of their digit, and findings that need no further sort to any bucket."""

    def __init__(self, bits: int):
        self.bits, self.bucket, self.kind, self.data = bits, [], [], []

    def put(self, bucket: int, kind: int, data: bytes) -> None:
        self.bucket.append(bucket)
        self.kind.append(kind)
        self.data.append(data)

    def records(self, r: dict[str, np.ndarray]) -> None:
        """r: in order of g."""
        bucket = (r["g"] >> U64(64 - self.bits)).astype(np.int64)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                self.put(int(bucket[a]), 0, _pack({name: x[a:b] for name, x in r.items()}, RECORD))

    def findings(self, kind: int, r: dict[str, np.ndarray]) -> None:
        for a in range(0, len(r["d"]), PASS_ROWS):
            spread = xxhash.xxh3_64_intdigest(r["d"][a : a + 1].tobytes() + r["lo"][a : a + 1].tobytes()) >> (64 - self.bits)
            self.put(spread, kind, _pack({name: x[a : a + PASS_ROWS] for name, x in r.items()}, SPAN))

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"bucket": pa.array(self.bucket, pa.int64()), "kind": pa.array(self.kind, pa.int32()), "data": pa.array(self.data, pa.binary())})
        self.bucket, self.kind, self.data = [], [], []
        return out


EXCHANGE = "bucket long, kind int, data binary"
FOUND = "d long, t int, lo int, hi int, open boolean"


def _sort_here(r: dict[str, np.ndarray], n: int, out: _Exchange, windows: bool) -> None:
    """Sort a task's own rows; hand on what other tasks have to see. r: g, c, d, t, lo, w; with ``windows`` each row is one window."""
    r["m"] = np.zeros(len(r["g"]), np.uint8)
    order, new_g, new_c, repeated, differs = _sorted(r)
    at = lambda mask: {name: x[order[mask]] for name, x in r.items()}
    lost = at(repeated)
    out.findings(1, _runs(lost["d"], lost["t"], lost["lo"], lost["lo"].astype(np.int64) + lost["w"] + n))
    kept = new_c if windows else new_g
    sent = at(kept)
    sent["m"] = differs[kept].astype(np.uint8)
    by = np.argsort(sent["g"], kind="stable")
    out.records({name: x[by] for name, x in sent.items()})
    if not windows:
        more = at(new_c & ~new_g)  # their digit is known to have several digests
        out.findings(2, {"d": more["d"], "t": more["t"], "lo": more["lo"], "hi": more["lo"].astype(np.int64) + more["w"]})


def _text_key(raw: bytes, told_apart: bool) -> int:
    return xxhash.xxh3_64_intdigest(raw) & 0x7FFFFFFF if told_apart else 0


def _first_pass(n: int, bits: int, told_apart: bool) -> Callable:
    """Stretches of whole texts, sorted within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, parts, held = _Exchange(bits), [], 0
        segments: list[tuple[int, int, int, bytes]] = []  # document, text, where it begins, bytes
        waiting = 0

        def hashed() -> None:
            nonlocal segments, waiting
            if not segments:
                return
            whole = b"".join(s for *_, s in segments)
            lengths = np.array([len(s) for *_, s in segments])
            lo, hi, g = anchors(np.frombuffer(whole, np.uint8), lengths, n)
            view = memoryview(whole)
            c = _digests([view[a : b + n] for a, b in zip(lo.tolist(), hi.tolist())])
            which = np.searchsorted(np.cumsum(lengths), lo, side="right")
            begins = np.cumsum(lengths) - lengths
            of = lambda i, kind: np.array([s[i] for s in segments], kind)[which]
            parts.append({"g": g, "c": c[:, 0] ^ _mixed(c[:, 1]), "d": of(0, np.int64), "t": of(1, np.uint32), "lo": (lo - begins[which] + of(2, np.int64)).astype(np.uint32), "w": (hi - lo).astype(np.uint16)})
            segments, waiting = [], 0

        def sort() -> pa.RecordBatch:
            nonlocal parts, held
            hashed()
            if parts:
                _sort_here({name: np.concatenate([p[name] for p in parts]) for name in parts[0]}, n, out, windows=False)
            parts, held = [], 0
            return out.batch()

        for batch in batches:
            for d, text in zip(batch.column("d").to_pylist(), batch.column("text")):
                raw = text.as_py()
                t, step = _text_key(raw, told_apart), CHUNK - n
                for a in range(0, len(raw) - n + 1, step):
                    segments.append((d, t, a, raw[a : a + step + n - 1]))
                    waiting += len(segments[-1][-1])
                    held += len(segments[-1][-1])
                    if waiting >= CHUNK - n:
                        hashed()
                    if held >= BATCH_BYTES:
                        yield sort()
        yield sort()

    return run


def _window_pass(n: int, bits: int) -> Callable:
    """The single windows of stretches that are still open, sorted within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, parts, held = _Exchange(bits), [], 0

        def sort() -> pa.RecordBatch:
            nonlocal parts, held
            if parts:
                _sort_here({name: np.concatenate([p[name] for p in parts]) for name in parts[0]}, n, out, windows=True)
            parts, held = [], 0
            return out.batch()

        for batch in batches:
            for d, t, body, spans in zip(batch.column("d").to_pylist(), batch.column("t").to_pylist(), batch.column("body"), batch.column("spans")):
                raw = memoryview(zstandard.decompress(body.as_py()))
                lo, hi = (spans.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
                counts = hi - lo + 1
                where = np.unique(np.repeat(hi - np.cumsum(counts) + 1, counts) + np.arange(counts.sum()))
                for a in range(0, len(where), BATCH_WINDOWS):
                    some = where[a : a + BATCH_WINDOWS]
                    c = _digests([raw[i : i + n] for i in some.tolist()])
                    m = len(some)
                    parts.append({"g": c[:, 0].copy(), "c": c[:, 1].copy(), "d": np.full(m, d, np.int64), "t": np.full(m, t, np.uint32), "lo": some.astype(np.uint32), "w": np.zeros(m, np.uint16)})
                    held += m
                    if held >= BATCH_WINDOWS:
                        yield sort()
        yield sort()

    return run


def _bucket_pass(n: int, windows: bool) -> Callable:
    """One bucket's records of all tasks, sorted: repeated byte ranges (open: false) and stretches to be looked at window by window."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        of = lambda kind: pdf["data"][pdf["kind"] == kind].tolist()
        r, known, still = _unpack(of(0), RECORD), _unpack(of(1), SPAN), _unpack(of(2), SPAN)
        order, _, new_c, repeated, differs = _sorted(r)
        at = lambda mask: {name: x[order[mask]] for name, x in r.items()}
        lost = at(repeated)
        frames = [(lost["d"], lost["t"], lost["lo"], lost["lo"].astype(np.int64) + lost["w"] + n, False), (known["d"], known["t"], known["lo"], known["hi"], False)]
        if not windows:
            more = at(new_c & differs)
            frames += [(more["d"], more["t"], more["lo"], more["lo"].astype(np.int64) + more["w"], True), (still["d"], still["t"], still["lo"], still["hi"], True)]
        join = lambda i, kind: np.concatenate([f[i].astype(kind) for f in frames])
        return pd.DataFrame({"d": join(0, np.int64), "t": join(1, np.int32), "lo": join(2, np.int32), "hi": join(3, np.int32), "open": np.repeat([f[4] for f in frames], [len(f[0]) for f in frames])})

    return run


def _bodies(docs: DataFrame, told_apart: bool) -> DataFrame:
    """doc_id, d, t, body: texts compressed for their way through a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            raws = [x.as_py() or b"" for x in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "d": batch.column("d"), "t": pa.array([_text_key(x, told_apart) for x in raws], pa.int32()), "body": pa.array([pack.compress(x) for x in raws], pa.binary())})

    return docs.mapInArrow(run, "doc_id long, d long, t int, body binary")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "spans": [], "kept": []}
        for body, spans in zip(batch.column("body"), batch.column("spans")):
            raw = zstandard.decompress(body.as_py())
            runs, kept = [], raw
            if spans.is_valid:
                lo, hi = (spans.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
                zero = np.zeros(len(lo), np.int64)
                found = _runs(zero, zero, lo, hi)
                runs = list(zip(found["lo"].tolist(), found["hi"].tolist()))
                edges = [0, *(x for run in runs for x in run), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
            for name, x in (("n_bytes", len(raw)), ("n_removed", len(raw) - len(kept)), ("spans", [{"start": a, "stop": b} for a, b in runs]), ("kept", kept)):
                out[name].append(x)
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(out["n_bytes"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "spans": pa.array(out["spans"], spans_type), "kept": pa.array(out["kept"], pa.binary())})


def remove_repeats(docs: DataFrame, n: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed (long), spans (removed runs: start, stop) and kept (binary) of every row of ``docs``.

    A byte is removed if a string of ``n`` bytes that covers it also starts earlier: in a document of smaller doc_id or
    in the same one at an earlier place, judged on the texts as they were given. Overlaps count, and strings don't cross
    documents. ``kept`` is bytes, since a run may begin or end inside a character.

    Null texts are empty; texts shorter than ``n`` bytes keep all. A null doc_id comes before all others. Rows that repeat
    a doc_id stand in the order of a hash of their texts; rows equal in both are one document, and each of them gets its
    result. Texts of any length are taken whole, in steps of CHUNK bytes. An empty table gives no rows; other columns are left out.

    Windows are equal if 128 bits of XXH3 are; stretches of one anchor if 64 are.
    """
    if not 2 <= n <= 1 << 15:
        raise ValueError("n must lie between 2 and 32768")
    spark = docs.sparkSession
    text_batches(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("d"), F.col(text).cast("binary").alias("text"))
    told_apart = not docs.groupBy("d").count().where("count > 1").isEmpty()  # else no hash of the text need travel along
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES, 2).bit_length()

    dealt = docs.where(F.octet_length("text") >= n).select("d", "text").mapInArrow(_first_pass(n, bits, told_apart), EXCHANGE)
    found = settle(dealt.groupBy("bucket").applyInPandas(_bucket_pass(n, windows=False), FOUND))
    bodies = _bodies(docs, told_apart)
    spans = F.collect_list(F.struct("lo", "hi")).alias("spans")
    still = found.where("open").groupBy("d", "t").agg(spans)
    dealt = bodies.select("d", "t", "body").join(still, ["d", "t"]).mapInArrow(_window_pass(n, bits), EXCHANGE)
    more = dealt.groupBy("bucket").applyInPandas(_bucket_pass(n, windows=True), FOUND)
    lost = found.where("NOT open").unionByName(more).groupBy("d", "t").agg(spans)
    kept = bodies.join(lost, ["d", "t"], "left").select("doc_id", "body", "spans")
    return kept.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary")
