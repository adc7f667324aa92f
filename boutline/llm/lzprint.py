"""Lempel-Ziv phrase fingerprints: a text is parsed into dictionary phrases, each the shortest one not seen before; the phrase set is
hashed, and its smallest hashes are the signature. The likeness of two signatures estimates the Jaccard similarity of the phrase
sets, which behaves like a compression distance.

``edited_neighbours`` pairs each document with the next one in descending ``doc_id``. Documents are range-partitioned and sorted once, and
each task streams its rows, so the neighbour is at hand; only the first and last row of a task leave their text, one of each per task, to
be paired across tasks.

Defined cases: a null text is empty; an empty text has the empty fingerprint, and two empty fingerprints are alike (1.0), an empty and
another are not (0.0). Rows that repeat a ``doc_id`` are ordered by the hash of their text and stay separate; null ids come last. A single
document is its own neighbour. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialize
from .common import text_or_empty
from .shingles import mix, powers, prefix_sums

KEPT = 64  # smallest hashes in a signature


def parse(text: str, start: int = 0, seen: set[str] | None = None) -> tuple[list[str], list[int]]:
    """New phrases from ``start`` on and their ends. Every beginning of a phrase is a phrase, so the search for the shortest new one may begin
    at any length."""
    seen = set() if seen is None else seen
    found, ends, n, length = [], [], len(text), 1
    while start < n:
        end = min(start + length, n)
        piece = text[start:end]
        if piece in seen:
            while piece in seen and end < n:
                end += 1
                piece = text[start:end]
            if piece in seen:
                break  # the rest is a known phrase
        else:
            while end - 1 > start and text[start : end - 1] not in seen:
                end -= 1
            piece = text[start:end]
        seen.add(piece)
        found.append(piece)
        ends.append(end)
        length = end - start
        start = end
    return found, ends


def signature(text: str, ends: list[int]) -> np.ndarray:
    """The smallest hashes of the phrases that end at ``ends`` (and begin where the one before ends)."""
    if not ends:
        return np.empty(0, np.uint32)
    e = np.array(ends, np.int64)
    s = np.concatenate([[0], e[:-1]])
    p = prefix_sums(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    h = (mix((p[e] - p[s]) * powers(len(p))[1][s] + (e - s).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    if len(h) > 4 * KEPT:
        h = np.partition(h, 2 * KEPT)[: 2 * KEPT]
    return np.unique(h)[:KEPT]


def fingerprint(text: str) -> np.ndarray:
    return signature(text, parse(text)[1])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity: the share of the union's smallest hashes that both have."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)
    if len(a) >= KEPT or len(b) >= KEPT:
        union = union[:KEPT]
    return float(len(np.intersect1d(np.intersect1d(union, a, True), b, True)) / len(union))


def written(a: np.ndarray) -> str:
    return a.astype(">u4").tobytes().hex()


def read(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


class _Document:
    __slots__ = ("doc_id", "text", "found", "ends", "print")

    def __init__(self, doc_id, text: str):
        self.doc_id, self.text = doc_id, text
        self.found, self.ends = parse(text)
        self.print = signature(text, self.ends)

    def result(self, following: str, following_print: np.ndarray) -> tuple:
        """Row of this document given the next one's text and fingerprint. The edited text shares the first phrases."""
        n = len(self.text)
        keep = n - n // 2
        edited = self.text[:keep] + following[: n - keep]
        shared = bisect_right(self.ends, keep)
        more = parse(edited, self.ends[shared - 1] if shared else 0, set(self.found[:shared]))[1]
        other = signature(edited, self.ends[:shared] + more)
        return (self.doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(self.print), written(other), likeness(self.print, other), likeness(self.print, following_print))


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
     ("near_edited", pa.float64()), ("near_next", pa.float64()), ("role", pa.string()), ("part", pa.int32()), ("text", pa.string())]
)


def _rows(rows: list[tuple], schema: pa.Schema = _ARROW) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _stream(batches):
    from pyspark import TaskContext

    part, before = TaskContext.get().partitionId(), None
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            now = _Document(doc_id, text)
            if before is None:
                out.append((doc_id, None, None, written(now.print), None, None, None, "head", part, text))
            else:
                out.append((*before.result(text, now.print), "", part, None))
            before = now
        if out:
            yield _rows(out)
    if before is not None:
        yield _rows([(before.doc_id, None, None, None, None, None, None, "tail", part, before.text)])


def _join_ends(batches):
    schema = pa.schema(list(_ARROW)[:7])
    for batch in batches:
        rows = [
            _Document(doc_id, text).result(following, read(print_))
            for doc_id, text, following, print_ in zip(*(batch.column(i).to_pylist() for i in range(4)))
        ]
        if rows:
            yield _rows(rows, schema)


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its text with the last half replaced by the next document's beginning, and their likenesses."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    placed = rows.repartitionByRange(F.col("doc_id").desc_nulls_last()).sortWithinPartitions(*order)
    names = [f.name for f in _ARROW]
    streamed = materialize(placed.mapInArrow(_stream, _RESULT + ", role string, part int, text string"))
    heads = streamed.filter("role = 'head'").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    tails = streamed.filter("role = 'tail'").select("part", "doc_id", "text")
    # one row per task: the task after each, the first after the last
    one = W.orderBy("part")
    after = heads.select("part").select("part", F.coalesce(F.lead("part").over(one), F.min("part").over(W.partitionBy())).alias("next_part"))
    ends = tails.join(after, "part").join(heads.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "text", "next_text", "next_print")
    return streamed.filter("role = ''").select(*names[:7]).unionAll(ends.mapInArrow(_join_ends, _RESULT))
