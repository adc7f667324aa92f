"""Exact substring deduplication with suffix arrays: every byte covered by a ``length``-byte string that also starts elsewhere goes.

1. *Anchors.* The smallest hash among the short strings inside a window of ``length`` bytes is its anchor. Equal windows have equal
   anchors at equal places, so only windows with one anchor can be equal. Neighbouring windows share their anchor; such a run of
   windows, with the bytes it covers, is a context. Contexts are range-partitioned by (anchor, content) and streamed; what holds an
   anchor nobody else holds ends here, which is most of the text.
2. *Classes.* Contexts of equal bytes are one class, however many there are. The windows of a class with two members repeat.
3. *Suffix arrays.* The distinct contexts of an anchor that has several are joined to bounded texts and sorted by linear grouping (see
   ``suffixes``). Equal windows are neighbours in that order. Before that, a context is trimmed to the bytes that can
   lie in a common window, by its longest common extensions left and right of the anchor with the other contexts.
4. An anchor with more than ``crowded`` distinct contexts is not gathered: its windows are counted by 128-bit hash instead, which spreads
   them over all tasks. Either way gives the same windows.
5. The repeated windows go back to all members of their classes and, per document, to its bytes.

All steps see the input as it is, not what is left of it. Defined cases: a null text is empty. Texts shorter than ``length`` lose nothing.
Repeated rows, also of one ``doc_id``, are documents of their own, so equal long rows repeat each other. Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import carried, text_or_empty, unpacked
from .shingles import mix, powers, prefix_sums
from .suffixes import suffix_array

ANCHOR = 64  # bytes of the strings that compete for anchor
BUCKET = 60_000  # symbols of one suffix array, unless a single anchor's contexts need more
CROWDED = 4096  # contexts of one anchor that one task sorts: at most about 1.4 MB

_CONTEXTS = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("row_hash", pa.int32()), ("start", pa.int32()), ("size", pa.int32())])
_CONTEXT_SQL = "anchor long, content long, doc_id long, row_hash int, start int, size int"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours."""
    n = len(h) - w + 1
    padded = np.concatenate([h, np.full(-len(h) % w, ~np.uint64(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def contexts_of(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, start, size) of the contexts of one text. Of equal smallest hashes in a window the leftmost is its anchor."""
    n, k = len(data), min(ANCHOR, length)
    if n < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    p = prefix_sums(np.frombuffer(data, np.uint8))
    keys = mix((p[k:] - p[:-k]) * powers(n + 1)[1][: n - k + 1])
    w, block = length - k + 1, 1 << 23
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, n - length + 1, block):  # places need 24 bits below the hash
        part = keys[at : at + block + w - 1]
        smallest = _sliding_min(part & ~np.uint64(0xFFFFFF) | np.arange(len(part), dtype=np.uint64), w)
        start = np.flatnonzero(np.concatenate([[True], smallest[1:] != smallest[:-1]]))
        windows = np.diff(np.append(start, len(smallest)))
        found.append((part[(smallest[start] & np.uint64(0xFFFFFF)).astype(np.int64)], start + at, windows + length - 1))
    return tuple(np.concatenate(x) for x in zip(*found))


def _contexts(length: int):
    def run(batches):
        for batch in batches:
            anchors, contents, docs, rows, starts, sizes = [], [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                data = text.encode()
                anchor, start, size = contexts_of(data, length)
                if len(anchor):
                    anchors.append(anchor)
                    contents += [xxhash.xxh3_64_intdigest(data[s : s + m]) for s, m in zip(start.tolist(), size.tolist())]
                    docs.append(np.full(len(anchor), i))
                    starts.append(start)
                    sizes.append(size)
            if anchors:
                at = pa.array(np.concatenate(docs))
                columns = [pa.array(_signed(np.concatenate(anchors))), pa.array(_signed(np.array(contents, np.uint64))), batch.column(0).take(at), batch.column(1).take(at)]
                columns += [pa.array(np.concatenate(x).astype(np.int32)) for x in (starts, sizes)]
                yield pa.RecordBatch.from_arrays(columns, schema=_CONTEXTS)

    return run


def _shared_anchors(batches):
    """Of rows sorted by anchor, those whose anchor has company; rows of the first and last anchor of a task may have it elsewhere."""
    first = prior = waiting = None
    for batch in batches:
        if not batch.num_rows:
            continue
        a = batch.column(0).to_numpy()
        if first is None:
            first = a[0]
        elif waiting is not None and a[0] == prior:
            yield waiting
        same = a[1:] == a[:-1]
        keep = np.concatenate([[a[0] == prior], same]) | np.append(same, False) | (a == first)
        if keep.any():
            yield batch.filter(pa.array(keep))
        waiting = None if keep[-1] else batch.slice(len(a) - 1)
        prior = a[-1]
    if waiting is not None:
        yield waiting


def _cut(batches):
    """Bytes of the contexts asked for of each text."""
    for batch in batches:
        anchors, contents, crowds, pieces = [], [], [], []
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = text.encode()
            for w in wanted:
                anchors.append(w["anchor"])
                contents.append(w["content"])
                crowds.append(w["crowded"])
                pieces.append(data[w["start"] : w["start"] + w["size"]])
        yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(contents, pa.int64()), pa.array(crowds, pa.bool_()), pa.array(pieces, pa.binary())], names=["anchor", "content", "crowded", "bytes"])


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common beginning."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _longest(parts: list[bytes]) -> list[int]:
    """Longest common beginning of each part with any other: with a neighbour in sorted order."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for x, y in zip(order, order[1:]):
        k = _common(parts[x], parts[y])
        out[x], out[y] = max(out[x], k), max(out[y], k)
    return out


def trimmed(anchor: int, texts: list[bytes], length: int) -> list[tuple[int, int]]:
    """Per context the bytes [from, to) that can lie in a window it shares with another; empty ones are (0, 0)."""
    k = min(ANCHOR, length)
    wanted, at = np.uint64(anchor % (1 << 64)), []
    for t in texts:
        p = prefix_sums(np.frombuffer(t, np.uint8))
        found = np.flatnonzero(mix((p[k:] - p[:-k]) * powers(len(t) + 1)[1][: len(t) - k + 1]) == wanted)
        if len(found) != 1:
            return [(0, len(t)) for t in texts]  # no single place to align at
        at.append(int(found[0]))
    right = _longest([t[i:] for t, i in zip(texts, at)])
    left = _longest([t[:i][::-1] for t, i in zip(texts, at)])
    return [(i - x, i + y) if x + y >= length else (0, 0) for i, x, y in zip(at, left, right)]


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """Starts of the windows of each text that start at another place too, in any of the texts, by a suffix array of them all."""
    m = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    symbols = np.zeros(int(sizes.sum()) + m + 1, np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if m else np.empty(0, np.int64)
    for i, t in enumerate(texts):
        symbols[begin[i] : begin[i] + sizes[i]] = np.frombuffer(t, np.uint8).astype(np.int64) + m + 1
        symbols[begin[i] + sizes[i]] = m - i  # a mark of its own ends each text
    order = np.array(suffix_array(symbols), np.int64)
    room = np.zeros(len(symbols), np.bool_)  # where a whole window fits
    for b, n in zip(begin.tolist(), sizes.tolist()):
        room[b : b + max(n - length + 1, 0)] = True
    p = prefix_sums(symbols)
    x, y = order[:-1], order[1:]
    both = np.flatnonzero(room[x] & room[y])
    x, y = x[both], y[both]
    inverse = powers(len(symbols) + 1)[1]
    like = (p[x + length] - p[x]) * inverse[x] == (p[y + length] - p[y]) * inverse[y]
    x, y = x[like], y[like]
    hit = np.zeros(len(symbols), np.bool_)
    step = np.arange(length)
    for at in range(0, len(x), 20_000):  # byte by byte, in bounded blocks
        a, b = x[at : at + 20_000], y[at : at + 20_000]
        same = (symbols[a[:, None] + step] == symbols[b[:, None] + step]).all(1)
        hit[a[same]] = hit[b[same]] = True
    return [np.flatnonzero(hit[b : b + n]) for b, n in zip(begin.tolist(), sizes.tolist())]


def spans_of(starts: np.ndarray, length: int) -> list[dict]:
    """Byte runs covered by windows at the given ascending starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    lo = starts[np.concatenate([[0], cut + 1])]
    hi = starts[np.append(cut, len(starts) - 1)] + length
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(lo, hi)]


_SPANS = "array<struct<lo:int,hi:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _sorted_anchors(length: int):
    """Contexts sorted by anchor; whole anchors are joined into texts of about BUCKET symbols."""

    def run(batches):
        pieces: list[tuple[int, int, int, bytes]] = []  # anchor, content, offset of the piece in its context, piece
        weight = 0
        group: list[tuple[int, bytes]] = []
        anchor = None

        def finish_group():
            nonlocal weight, group
            if len(group) > 0:
                texts = [t for _, t in group]
                ranges = trimmed(anchor, texts, length) if len(group) > 1 else [(0, len(t)) for t in texts]
                for (content, t), (lo, hi) in zip(group, ranges):
                    if hi - lo >= length:
                        pieces.append((anchor, content, lo, t[lo:hi]))
                        weight += hi - lo + 1
                group = []

        def flush():
            nonlocal pieces, weight
            rows = []
            if pieces:
                for (a, c, lo, _), starts in zip(pieces, repeated_windows([x[3] for x in pieces], length)):
                    if len(starts):
                        rows.append((a, c, spans_of(starts + lo, length)))
            pieces, weight = [], 0
            return rows

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], _SPAN_TYPE)], names=["anchor", "content", "spans"])

        for batch in batches:
            for a, c, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if a != anchor:
                    finish_group()
                    anchor = a
                    if weight >= BUCKET and (rows := flush()):
                        yield out(rows)
                group.append((c, t))
        finish_group()
        if rows := flush():
            yield out(rows)

    return run


def _windows(length: int):
    """One row per window of a context, with its 128-bit hash."""

    def run(batches):
        for batch in batches:
            for a, c, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n = len(t) - length + 1
                h = [xxhash.xxh3_128_intdigest(t[i : i + length]) for i in range(n)]
                columns = [[a] * n, [c] * n, list(range(n)), [(x >> 64) - (1 << 63) for x in h], [(x & ((1 << 64) - 1)) - (1 << 63) for x in h]]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["anchor", "content", "at", "h1", "h2"])

    return run


def _window_spans(length: int):
    def run(batches):
        for batch in batches:
            spans = [spans_of(np.array(sorted(at), np.int64), length) for at in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, _SPAN_TYPE)], names=["anchor", "content", "spans"])

    return run


def repeated_spans(docs: DataFrame, length: int = 200, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, row_hash, spans) of every document that loses bytes; spans may touch or overlap."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(text_or_empty()).alias("row_hash"), text_or_empty().alias("text"))
    found = rows.filter(F.octet_length("text") >= length).mapInArrow(_contexts(length), _CONTEXT_SQL)
    order = ["anchor", "content", "doc_id", "row_hash", "start"]
    shared = materialize(found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_shared_anchors, _CONTEXT_SQL))
    classes = shared.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("doc_id", "row_hash", "start", "size")).alias("one"))
    classes = materialize(classes)
    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    asked = classes.join(several, "anchor").select(
        F.col("one.doc_id").alias("doc_id"), F.col("one.row_hash").alias("row_hash"),
        F.struct("anchor", "content", F.col("one.start").alias("start"), F.col("one.size").alias("size"), (F.col("kinds") > crowded).alias("crowded")).alias("w"),
    )
    asked = asked.groupBy("doc_id", "row_hash").agg(F.collect_list("w").alias("wanted"))
    same = rows.doc_id.eqNullSafe(asked.doc_id) & (rows.row_hash == asked.row_hash)
    pieces = rows.join(asked, same).select("text", "wanted").mapInArrow(_cut, "anchor long, content long, crowded boolean, bytes binary")
    pieces = materialize(pieces)
    calm = pieces.filter("not crowded").select("anchor", "content", "bytes")
    by_suffix = calm.repartition("anchor").sortWithinPartitions("anchor", "content")
    by_suffix = by_suffix.mapInArrow(_sorted_anchors(length), f"anchor long, content long, spans {_SPANS}")
    windows = pieces.filter("crowded").select("anchor", "content", "bytes").dropDuplicates(["anchor", "content"]).mapInArrow(_windows(length), "anchor long, content long, at int, h1 long, h2 long")
    windows = materialize(windows)
    often = windows.groupBy("anchor", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor", "h1", "h2")
    by_count = windows.join(often, ["anchor", "h1", "h2"], "left_semi").groupBy("anchor", "content").agg(F.collect_set("at").alias("at")).mapInArrow(_window_spans(length), f"anchor long, content long, spans {_SPANS}")
    whole = classes.filter("members > 1").select("anchor", "content", F.array(F.struct(F.lit(0).alias("lo"), F.col("one.size").cast("int").alias("hi"))).alias("spans"))
    settled = whole.unionAll(by_suffix.unionAll(by_count).join(whole, ["anchor", "content"], "left_anti"))
    shifted = F.transform("spans", lambda s: F.struct((s["lo"] + F.col("start")).alias("lo"), (s["hi"] + F.col("start")).alias("hi")))
    of_rows = shared.join(settled, ["anchor", "content"]).select("doc_id", "row_hash", shifted.alias("spans"))
    return of_rows.groupBy("doc_id", "row_hash").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _apply(batches):
    for batch in batches:
        sizes, removed, runs, kept = [], [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            data = text.encode()
            turn = np.zeros(len(data) + 1, np.int32)
            if spans:
                np.add.at(turn, [s["lo"] for s in spans], 1)
                np.add.at(turn, [s["hi"] for s in spans], -1)
            gone = np.cumsum(turn[:-1]) > 0
            sizes.append(len(data))
            removed.append(int(gone.sum()))
            runs.append(int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum()))
            kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes() if spans else data)
        columns = [batch.column(0), *[pa.array(x, pa.int64()) for x in (sizes, removed, runs)], pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = 200, carry: list[str] | None = None, crowded: int = CROWDED) -> DataFrame:
    """``carry`` columns, ``n_bytes``, ``n_removed``, ``n_spans`` and the bytes ``kept`` of every document."""
    spans = repeated_spans(docs, length, crowded).select(F.col("doc_id").alias("d"), F.col("row_hash").alias("h"), "spans")
    left = docs.select(carried(carry), F.col("doc_id").cast("long").alias("doc"), text_or_empty().alias("text"), F.hash(text_or_empty()).alias("hash"))
    joined = left.join(spans, left.doc.eqNullSafe(spans.d) & (left.hash == spans.h), "left").select("row", "text", "spans")
    schema = joined.select("row").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
    return joined.mapInArrow(_apply, schema).select(*unpacked(carry), "n_bytes", "n_removed", "n_spans", "kept")
