"""Line deduplication: hashed lines, range-partitioned with secondary sort, streamed; the result is a keep bitmap per document.

Each document becomes one row per distinct long line (128-bit key, document, positions). Rows are range-partitioned by
(key, document descending), so a line held by a third of all documents spreads over many tasks and (key, document) never
straddles two. A task streams its sorted rows: of each key the first document seen is the one that keeps the line, and rows
flow out as soon as enough documents have been met, so nothing is buffered but the first few rows of a key. Only the first and
last key of a task can continue elsewhere; these leave one summary row each (at most two per task), which settle the rest.

Defined cases: a null or empty text is one empty line. Rows that repeat a ``doc_id`` count as one document; each is judged on its
own text. A null ``doc_id`` is one document, smaller than all others. Other columns are never read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import carried, text_or_empty, unpacked

BLANKS = b" \t\n\x0b\x0c\r"
KEYED = "hi long, lo long, doc_id long, row_hash long, n_lines int, positions array<int>"
STREAMED = "doc_id long, row_hash long, n_lines int, positions array<int>, hi long, lo long, docs long, top long, summary boolean"
BITMAPS = "doc_id long, row_hash long, n_lines long, n_dropped long, keep_bitmap binary"


def _keys(min_chars: int):
    def run(batches):
        for batch in batches:
            out = {n: [] for n in ("hi", "lo", "doc_id", "row_hash", "n_lines", "positions")}
            for doc, row, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                lines = text.encode().split(b"\n")
                found: dict[bytes, list[int]] = {}
                for at, line in enumerate(lines):
                    if len(line) >= min_chars:
                        key = line.strip(BLANKS).lower()
                        if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                            found.setdefault(key, []).append(at)
                for key, at in found.items():
                    h = xxhash.xxh3_128_intdigest(key)
                    out["hi"].append((h >> 64) - (1 << 63))
                    out["lo"].append((h & ((1 << 64) - 1)) - (1 << 63))
                    out["doc_id"].append(doc)
                    out["row_hash"].append(row)
                    out["n_lines"].append(len(lines))
                    out["positions"].append(at)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    return run


_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("row_hash", pa.int64()), ("n_lines", pa.int32()), ("positions", pa.list_(pa.int32())),
     ("hi", pa.int64()), ("lo", pa.int64()), ("docs", pa.int64()), ("top", pa.int64()), ("summary", pa.bool_())]
)


def _stream(min_docs: int):
    def run(batches):
        key, first_run, docs, top, last = None, False, 0, None, object()
        held: list[tuple] = []

        def close(at_end: bool) -> list[tuple]:
            """Rows that the run just ended still owes."""
            if key is None or not (first_run or at_end):
                return []
            undecided = [(*r, *key, None, None, False) for r in held]
            return [*undecided, (None, None, None, None, *key, docs, top, True)]

        for batch in batches:
            out: list[tuple] = []
            for hi, lo, doc, row, n, positions in zip(*(c.to_pylist() for c in batch.columns)):
                if (hi, lo) != key:
                    out += close(False)
                    first_run, key, docs, top, last, held = key is None, (hi, lo), 0, doc, object(), []
                if doc != last:
                    docs, last = docs + 1, doc
                if first_run:
                    out.append((doc, row, n, positions, hi, lo, None, None, False))
                elif docs < min_docs:
                    held.append((doc, row, n, positions))
                else:
                    out += [(*r, None, None, None, None, False) for r in held if r[0] != top]
                    held = []
                    out.append((doc, row, n, positions, None, None, None, None, False))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r)) for r in out], schema=_ARROW)
        if tail := close(True):
            yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r)) for r in tail], schema=_ARROW)

    return run


def _bitmaps(batches):
    for batch in batches:
        sizes, bits = [], []
        for n, dropped in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            keep = np.ones(n, np.bool_)
            keep[dropped] = False
            sizes.append(int(n - keep.sum()))
            bits.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())],
            names=["doc_id", "row_hash", "n_lines", "n_dropped", "keep_bitmap"],
        )


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per document that loses lines: ``n_lines``, ``n_dropped`` and the zlib-compressed bit per line (1 = keep).

    A line's key is the line stripped of ASCII blanks with A-Z lower-cased. Keys of at least ``min_chars`` code points found in at
    least ``min_docs`` documents keep their lines only in the largest ``doc_id`` holding them. ``row_hash`` tells apart rows that
    repeat a ``doc_id``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("row_hash"), text_or_empty().alias("text"))
    keyed = rows.mapInArrow(_keys(min_chars), KEYED)
    order = [F.col("hi"), F.col("lo"), F.col("doc_id").desc_nulls_last()]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order, "row_hash")
    streamed = materialize(placed.mapInArrow(_stream(min_docs), STREAMED))
    # at most two summary rows per task of the pass above, whatever the number of lines
    edges = streamed.filter("summary").groupBy("hi", "lo").agg(F.sum("docs").alias("all_docs"), F.max("top").alias("all_top")).filter(F.col("all_docs") >= min_docs)
    rows_ = streamed.filter("not summary").select("doc_id", "row_hash", "n_lines", "positions", "hi", "lo")
    settled = rows_.filter(F.col("hi").isNull()).select("doc_id", "row_hash", "n_lines", "positions")
    owed = (
        rows_.filter(F.col("hi").isNotNull())
        .join(F.broadcast(edges), ["hi", "lo"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("all_top")))
        .select("doc_id", "row_hash", "n_lines", "positions")
    )
    dropped = settled.unionAll(owed).groupBy("doc_id", "row_hash").agg(F.first("n_lines").alias("n_lines"), F.flatten(F.collect_set("positions")).alias("dropped"))
    return dropped.mapInArrow(_bitmaps, BITMAPS)


def _lines_of(batches):
    for batch in batches:
        n_lines, n_dropped, kept = [], [], []
        for text, bits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            lines = text.split("\n")
            keep = np.ones(len(lines), np.bool_) if bits is None else np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=len(lines)).astype(np.bool_)
            n_lines.append(len(lines))
            n_dropped.append(int(len(lines) - keep.sum()))
            kept.append(text if bits is None else "\n".join([x for x, k in zip(lines, keep) if k]))
        columns = [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "n_lines", "n_dropped", "kept_text"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, carry: list[str], nested: bool = False) -> DataFrame:
    """``carry`` columns of every document (or with ``nested`` one struct ``row`` of them) plus ``n_lines``, ``n_dropped`` and ``kept_text``.
    Documents without a bitmap keep all."""
    left = docs.select(carried(carry), F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text_or_empty()).alias("hash"), text_or_empty().alias("text"))
    right = bitmaps.select(F.col("doc_id").alias("other_doc"), F.col("row_hash").alias("other_hash"), F.col("keep_bitmap").alias("bits"))
    joined = left.join(right, F.col("doc").eqNullSafe(F.col("other_doc")) & (F.col("hash") == F.col("other_hash")), "left").select("row", "text", "bits")
    found = joined.mapInArrow(_lines_of, joined.select("row").schema.add("n_lines", "long").add("n_dropped", "long").add("kept_text", "string"))
    return found if nested else found.select(*unpacked(carry), "n_lines", "n_dropped", "kept_text")


def line_dedup(docs: DataFrame, carry: list[str], min_chars: int = 20, min_docs: int = 3, nested: bool = False) -> DataFrame:
    """Bitmaps and their application in one go."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs), carry, nested)
