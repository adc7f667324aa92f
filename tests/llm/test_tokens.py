import collections
import itertools
import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest

from boutline.llm import packing, repair
from boutline.llm.tokens import default_path, encoder
from llm_fixtures import frame, prose

TEXTS = [
    "It's we'll A<|endoftext|>b x", "É́ ﬁn² Ünï  code  \t x y", "<|startoftext|> foo.bar,baz ... l'été", "", None, "ΑΣ ΑΣ. ③ 12 a1b2 İstanbul K",
    "áb n\u0303 \u00f1", "a-b  (c) [d]!!\n\nnew\r\nline", "don't DON'T 'tis", "word " * 3000, "日本語 テキスト, 한국어", "\x00\x1c a\u200bb",
]


def library(text):
    return encoder(default_path()).library.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_librarys():
    e = encoder(default_path())
    for _ in range(2):
        ids, counts = e.encode(pa.array(TEXTS, pa.string()))
        assert counts.tolist() == [len(library(t)) for t in TEXTS]
        assert ids.tolist() == [i for t in TEXTS for i in library(t)]


@pytest.mark.parametrize("kind", ["random", "repeats", "one", "empty"])
def test_grammar_round_trip_and_random_access(kind):
    rng = np.random.default_rng(4)
    ids = {"random": rng.integers(0, 300, 20_000), "repeats": np.tile(rng.integers(0, 9, 50), 400), "one": np.full(5000, 7), "empty": np.empty(0, np.int64)}[kind].astype(np.uint32)
    cuts = np.sort(rng.integers(0, len(ids) + 1, 6))
    counts = np.diff(np.concatenate([[0], cuts, [len(ids)]]))
    blob = repair.pack_shard([None, *range(6)], counts, ids, min_count=4)
    shard = repair.Shard(blob)
    assert (shard.ids() == ids).all() and shard.doc_ids == [None, *range(6)]
    assert all((shard.document(i) == ids[s : s + n]).all() for i, (s, n) in enumerate(zip(shard.starts, counts)))
    assert kind != "repeats" or len(shard.symbols) < len(ids) / 20
    sizes = repair.expansions(shard.first, shard.rules)[1]
    assert (sizes == shard.rule_sizes).all() and (shard.rules < shard.first + np.arange(len(shard.rules))[:, None]).all()


def documents(n):
    rng = random.Random(n)
    return [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, prose(rng, rng.randrange(90))) for i in range(n)]


def test_files_round_trip(spark):
    rows = documents(60)
    folder = repair.write_files(frame(spark, rows + [(3, "again")], parts=5), default_path(), shard_ids=700)
    assert repair.read_files(spark, folder).count() > 3
    got = repair.read_documents(spark, folder).orderBy("start").collect()
    start = 0
    assert [r.doc_id for r in got] == sorted([d for d, _ in rows] + [3])
    texts = collections.defaultdict(list)
    for d, t in [*rows, (3, "again")]:
        texts[d].append([*library(t), 2])
    for r in got:
        assert r.ids in texts[r.doc_id] and r.start == start and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    assert repair.read_documents(spark, repair.write_files(frame(spark, []), default_path())).count() == 0


def least_bins(sizes, capacity):
    """Smallest number of bins by trying all placements."""
    best = [len(sizes)]

    def put(i, room):
        if len(room) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(room)
            return
        for r in sorted({x for x in room if x >= sizes[i]}):
            rest = list(room)
            rest.remove(r)
            put(i + 1, [*rest, r - sizes[i]])
        put(i + 1, [*room, capacity - sizes[i]])

    put(0, [])
    return best[0]


def test_packing_is_best_on_small_cases_and_exact_on_large():
    rng = random.Random(9)
    for _ in range(60):
        sizes = sorted((rng.randint(1, 20) for _ in range(rng.randrange(1, 11))), reverse=True)
        got = packing.solve(collections.Counter(sizes), 20)
        held = collections.Counter()
        for pattern, copies in got:
            assert sum(x * m for x, m in pattern) <= 20
            for x, m in pattern:
                held[x] += m * copies
        assert held == collections.Counter(sizes)
        assert sum(c for _, c in got) == least_bins(sizes, 20)
    # triplets that best fit by decreasing length does not solve: every sequence can be full
    sizes = []
    for _ in range(12):
        a = rng.randint(380, 490)
        b = rng.randint(250, (1000 - a) // 2)
        sizes += [a, b, 1000 - a - b]
    assert sum(c for _, c in packing.solve(collections.Counter(sizes), 1000)) <= 13
    counts = {rng.randint(1, 4096): rng.randint(1, 10**9) for _ in range(2000)}
    got = packing.solve(counts, 4096)
    held = collections.Counter()
    for pattern, copies in got:
        for x, m in pattern:
            held[x] += m * copies
    assert held == collections.Counter(counts)


def test_pack_places_every_piece(spark):
    rows = [*documents(80), (3, "again"), (3, "again"), (None, "no id")]
    got = packing.pack(frame(spark, rows, parts=6), default_path(), capacity=64, end_id=1).collect()
    pieces = collections.Counter()
    for d, t in rows:
        ids = [*library(t), 1]
        for k, s in enumerate(range(0, len(ids), 64)):
            pieces[(d, k, s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    for _, group in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packing.pack(frame(spark, []), default_path()).count() == 0


def test_every_letter_next_to_punctuation_gives_the_library_s_ids():
    """Letters may turn into several characters when lower-cased or composed."""
    import sys

    letters = [c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isalpha()]
    odd = [c for c in letters if not c.lower().isalpha() or not unicodedata.normalize("NFC", c).isalpha()]
    assert "\u0130" in odd
    tool = encoder(default_path())
    texts = [f"M{c}? {c}. x{c}\"" for c in odd] + [" ".join(f"{c}," for c in letters[i : i + 200]) for i in range(0, len(letters), 200)]
    texts += ["M\u0130?", "K\u0130.", "DE\u011e\u0130L M\u0130?", "a\u0307\u0323! \u1e9b\u0323."]
    ids, counts = tool.encode(pa.array(texts))
    at = 0
    for text, n in zip(texts, counts.tolist()):
        assert ids[at : at + n].tolist() == library(text), text[:40]
        at += n


def test_search_keeps_one_table_of_counts():
    import tracemalloc

    rng = random.Random(5)
    counts = {k: rng.randint(1, 150) for k in rng.sample(range(1, 4096), 2400)}
    tracemalloc.start()
    got = packing.solve(counts, 4096, nodes=1500)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    held = collections.Counter()
    for pattern, copies in got:
        assert sum(x * m for x, m in pattern) <= 4096
        for x, m in pattern:
            held[x] += m * copies
    assert held == collections.Counter(counts)


def test_packing_encodes_few_megabytes_at_once(monkeypatch):
    from types import SimpleNamespace

    from pyspark import TaskContext

    sizes = []

    class Spy:
        def encode(self, texts):
            sizes.append(sum(map(len, texts.to_pylist())))
            return np.zeros(len(texts), np.uint32), np.ones(len(texts), np.int64)

    monkeypatch.setattr(packing, "encoder", lambda path: Spy())
    monkeypatch.setattr(TaskContext, "get", staticmethod(lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(["word " * 1000] * 3000)], names=["doc_id", "text"])
    out = pa.Table.from_batches(packing._pieces("", 1, 4096)(iter([batch])))
    assert out["doc_id"].to_pylist() == list(range(3000)) and out["_rank"].to_pylist() == list(range(3000))
    assert sum(sizes) == 15_000_000 and max(sizes) < 5_000_000
