"""Token files with Re-Pair grammar compression and random access.

Documents are tokenized, sorted by ``doc_id`` and cut into shards of about ``shard_ids`` ids. In a shard, pairs of neighbouring symbols that
occur at least ``min_count`` times are replaced by nonterminals, round after round until no pair is that frequent (or ``max_rounds``
is met, which bounds the depth of the grammar and nothing else). A round counts all pairs and replaces, among overlapping ones, the
more frequent pair; rules only refer to earlier symbols. A shard stores its rules, the expansion length of every rule, the
remaining symbols and a table of its documents, so any range of ids is decoded from the symbols that cover it.

A file is one Parquet row per shard, written by Spark's own committer (a lost executor costs its tasks, never the file) with the columns
part, shard, n_docs, n_ids and the shard itself in the binary layout of ``pack_shard``. Order of (part, shard) is the order of the documents.

Defined cases: a null or empty text is the end id alone. Rows that repeat a ``doc_id`` stand next to each other, by the hash of their
text; a null ``doc_id`` comes first. An empty table gives a file without shards. Other columns are never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import shared_dir
from .common import slices, text_or_empty
from .tokens import encoder

_HEAD = struct.Struct("<4sIIIII")  # mark, first nonterminal, rules, symbols, documents, bytes a symbol
_MARK = b"RPR1"
_BUCKETS = 22


def _counted(pair: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places of pairs that occur often enough, index into the distinct ones of each, the distinct ones in order, their counts).

    A hash slot whose pairs are all the same is counted by its load; only slots that mix pairs are sorted.
    """
    bits = min(_BUCKETS, max(16, len(pair).bit_length()))
    slot = ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)
    load = np.bincount(slot, minlength=1 << bits)
    at = np.flatnonzero(load[slot] >= min_count)
    slot, pair = slot[at], pair[at]
    sample = np.zeros(1 << bits, np.uint64)
    sample[slot] = pair
    mixed = np.zeros(1 << bits, np.bool_)
    mixed[slot[sample[slot] != pair]] = True
    pure = np.flatnonzero((load >= min_count) & ~mixed)
    unsure = mixed[slot]
    others, count = np.unique(pair[unsure], return_counts=True)
    others, count = others[count >= min_count], count[count >= min_count]
    distinct = np.concatenate([sample[pure], others])
    order = np.argsort(distinct)
    distinct, count = distinct[order], np.concatenate([load[pure], count])[order]
    if not len(distinct):
        return at[:0], at[:0], distinct, count
    of_slot = np.full(1 << bits, -1, np.int64)
    of_slot[pure] = np.argsort(order)[: len(pure)]
    which = of_slot[slot]
    which[unsure] = np.minimum(np.searchsorted(distinct, pair[unsure]), len(distinct) - 1)
    often = distinct[which] == pair
    return at[often], which[often], distinct, count


def compress(ids: np.ndarray, min_count: int = 16, max_rounds: int = 24) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(first nonterminal, rules as pairs, their expansion lengths, symbols). Nonterminal first + i stands for rules[i].

    A pair's occurrences are all there once both its symbols are, and only get fewer. So a round looks at pairs that were frequent in the round
    before and at pairs next to new nonterminals; what was too rare once stays so.
    """
    seq = ids.astype(np.uint32)
    first = int(ids.max()) + 1 if len(ids) else 0
    rules: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    length = np.ones(first, np.int64)
    symbol = first
    live = np.ones(len(seq), np.bool_)  # of the pair that begins here
    for _ in range(max_rounds):
        if len(seq) < 2:
            break
        open_ = np.flatnonzero(live[:-1])
        at, which, distinct, count = _counted(seq[open_].astype(np.uint64) << np.uint64(32) | seq[open_ + 1], min_count)
        at = open_[at]
        live[:] = False
        live[at] = True
        rank = np.empty(len(distinct), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(1, len(distinct) + 1)
        # overlapping pairs: the more frequent one wins, of equals the first
        score, touch = rank[which], at[1:] == at[:-1] + 1
        wins = np.ones(len(at), np.bool_)
        wins[1:] &= ~touch | (score[1:] > score[:-1])
        wins[:-1] &= ~touch | (score[:-1] >= score[1:])
        at, which = at[wins], which[wins]
        used = np.bincount(which, minlength=len(distinct))
        worth = used[which] >= 3
        at, which = at[worth], which[worth]
        if not len(at):
            break
        kept = np.flatnonzero(used >= 3)
        name = np.zeros(len(distinct), np.uint32)
        name[kept] = symbol + np.arange(len(kept), dtype=np.uint32)
        symbol += len(kept)
        rules.append(np.stack([distinct[kept] >> np.uint64(32), distinct[kept] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        sizes.append(length[rules[-1][:, 0]] + length[rules[-1][:, 1]])
        length = np.concatenate([length, sizes[-1]])
        seq[at] = name[which]
        live[at] = True
        live[at[at > 0] - 1] = True
        keep = np.ones(len(seq), np.bool_)
        keep[at + 1] = False
        seq, live = seq[keep], live[keep]
    if not rules:
        return first, np.empty((0, 2), np.uint32), np.empty(0, np.int64), seq
    return first, np.concatenate(rules), np.concatenate(sizes), seq


def expansions(first: int, rules: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rules one after another, number of ids of each rule)."""
    owner = np.repeat(np.arange(len(rules)), 2)
    flat = rules.ravel().astype(np.int64)
    while (open_ := flat >= first).any():
        times = np.where(open_, 2, 1)
        begin = np.cumsum(times) - times
        wide = np.repeat(flat, times)
        spot = begin[open_]
        inner = rules[flat[open_] - first]
        wide[spot], wide[spot + 1] = inner[:, 0], inner[:, 1]
        owner, flat = np.repeat(owner, times), wide
    return flat.astype(np.uint32), np.bincount(owner, minlength=len(rules)).astype(np.int64)


def pack_shard(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, min_count: int = 16, max_rounds: int = 24) -> bytes:
    """Layout: head; rules (two u32 each); their expansion lengths (u32); symbols (little-endian, as few bytes each as all need);
    ids per document (u32); document ids (i64) and a byte each for null."""
    first, rules, sizes, symbols = compress(ids, min_count, max_rounds)
    top = first + len(rules)
    width = 2 if top <= 1 << 16 else 3 if top <= 1 << 24 else 4
    raw = np.ascontiguousarray(symbols.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :width]
    return b"".join(
        [
            _HEAD.pack(_MARK, first, len(rules), len(symbols), len(doc_ids), width),
            rules.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), raw.tobytes(), counts.astype("<u4").tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids),
        ]
    )


class Shard:
    """One shard opened for reading."""

    def __init__(self, blob: bytes):
        mark, self.first, n_rules, n_symbols, n_docs, width = _HEAD.unpack_from(blob)
        if mark != _MARK:
            raise ValueError("not a shard of this format")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.rule_sizes = take("<u4", n_rules).astype(np.int64)
        raw = np.zeros((n_symbols, 4), np.uint8)
        raw[:, :width] = take("u1", n_symbols * width).reshape(-1, width)
        self.symbols = raw.view("<u4").ravel().astype(np.int64)
        self.counts = take("<u4", n_docs).astype(np.int64)
        ids, null = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null)]
        self.starts = np.cumsum(self.counts) - self.counts
        self._flat, sizes = expansions(self.first, self.rules)
        self._begin = np.cumsum(sizes) - sizes
        self._upto: np.ndarray | None = None

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols >= self.first
        size = np.ones(len(symbols), np.int64)
        size[rule] = self.rule_sizes[symbols[rule] - self.first]
        source = np.zeros(len(symbols), np.int64)
        source[rule] = self._begin[symbols[rule] - self.first]
        # terminals are read from behind the rules' ids
        plain = symbols[~rule]
        source[~rule] = len(self._flat) + np.arange(len(plain))
        everything = np.concatenate([self._flat, plain.astype(np.uint32)])
        shift = source - (np.cumsum(size) - size)
        return everything[np.repeat(shift, size) + np.arange(int(size.sum()))]

    def ids(self) -> np.ndarray:
        return self._expand(self.symbols)

    def range(self, start: int, count: int) -> np.ndarray:
        """Ids start .. start + count of the shard, decoding only the symbols that cover them."""
        if self._upto is None:
            size = np.ones(len(self.symbols), np.int64)
            rule = self.symbols >= self.first
            size[rule] = self.rule_sizes[self.symbols[rule] - self.first]
            self._upto = np.concatenate([[0], np.cumsum(size)])
        lo = int(np.searchsorted(self._upto, start, side="right")) - 1
        hi = int(np.searchsorted(self._upto, start + count, side="left"))
        got = self._expand(self.symbols[lo:hi])
        return got[start - self._upto[lo] : start - self._upto[lo] + count]

    def document(self, i: int) -> np.ndarray:
        return self.range(int(self.starts[i]), int(self.counts[i]))


_FILE = "part int, shard int, n_docs long, n_ids long, data binary"


def _shards(path: str, end_id: int, shard_ids: int, min_count: int, max_rounds: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, tool = TaskContext.get().partitionId(), 0, encoder(path)
        docs: list = []
        sizes: list[np.ndarray] = []
        chunks: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal docs, sizes, chunks, held, number
            counts, ids = np.concatenate(sizes), np.concatenate(chunks)
            blob = pack_shard(docs, counts, ids, min_count, max_rounds)
            row = [[part], [number], [len(docs)], [len(ids)], [blob]]
            docs, sizes, chunks, held, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "shard", "n_docs", "n_ids", "data"])

        for batch in (x for whole in batches for x in slices(whole, 1, 32 << 20)):
            ids, counts = tool.encode(batch.column(1))
            ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
            counts = counts + 1
            names = batch.column(0).to_pylist()
            at, row = 0, 0
            ends = np.cumsum(counts)
            while row < len(names):
                # whole documents until the shard is full
                stop = min(int(np.searchsorted(ends, at + shard_ids - held, side="left")) + 1, len(names))
                upto = int(ends[stop - 1])
                docs += names[row:stop]
                sizes.append(counts[row:stop])
                chunks.append(ids[at:upto])
                held += upto - at
                row, at = stop, upto
                if held >= shard_ids:
                    yield close()
        if docs:
            yield close()

    return run


def write_files(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 2, shard_ids: int = 1 << 19, min_count: int = 16, max_rounds: int = 24) -> str:
    """Write all documents in ascending ``doc_id`` order; returns the folder."""
    folder = folder or f"{shared_dir(docs.sparkSession).rstrip('/')}/boutline-tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    placed = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    placed.mapInArrow(_shards(path, end_id, shard_ids, min_count, max_rounds), _FILE).write.parquet(folder)
    return folder


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_FILE).parquet(folder)


def _documents(with_ids: bool):
    def run(batches):
        for batch in batches:
            for part, number, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                shard = Shard(blob)
                ids = shard.ids()
                data = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(data[4 * s : 4 * (s + n)]) for s, n in zip(shard.starts.tolist(), shard.counts.tolist())]
                n = len(crc)
                columns = [pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(shard.starts), pa.array(shard.counts), pa.array(crc, pa.int64())]
                names = ["part", "shard", "doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    offsets = np.append(shard.starts, len(ids)).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def read_documents(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Documents of a folder: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, the ids."""
    files = read_files(spark, folder)
    schema = "part int, shard int, doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    docs = files.select("part", "shard", "data").mapInArrow(_documents(with_ids), schema)
    # ids before each task's shards (one row per task), and before each shard of a task
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = files.select("part", "shard", inside.alias("_inside")).join(parts.select("part", before.alias("_before")), "part")
    begins = begins.select("part", "shard", (F.col("_inside") + F.col("_before")).alias("_begin"))
    names = [c for c in docs.columns if c not in ("part", "shard", "start")]
    return docs.join(begins, ["part", "shard"]).select(*names, (F.col("start") + F.col("_begin")).alias("start"))
