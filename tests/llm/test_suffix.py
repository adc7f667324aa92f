import collections
import hashlib
import random

import numpy as np
import pytest

from boutline.llm.suffixdedup import remove_repeats
from boutline.llm.suffixes import suffix_array
from llm_fixtures import frame, prose


def test_suffix_array_against_sorting():
    rng = random.Random(1)
    for _ in range(400):
        s = [rng.randint(1, rng.choice([1, 2, 4, 30])) for _ in range(rng.randrange(80))] + [0]
        assert suffix_array(np.array(s)) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(rows, n):
    c = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        c.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, np.int8)
        for i in range(len(b) - n + 1):
            if c[b[i : i + n]] > 1:
                gone[i : i + n] = 1
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("crowded", [512, 2])
def test_removal_against_brute_force(spark, crowded):
    rng = random.Random(7)
    base = [prose(rng, 200, 3000) for _ in range(5)]
    rows = []
    for i in range(60):
        a, b = rng.choice(base), rng.choice(base)
        x, y = rng.randrange(600), rng.randrange(600)
        rows.append((i, f"{i}ü{prose(rng, 10, 9999)} " + a[x : x + rng.randrange(150, 700)] + f"é{i}" + b[y : y + rng.randrange(190, 240)]))
    rows += [(100, base[0]), (101, base[0]), (101, base[0]), (102, "ab" * 400), (103, "LOUD!! " * 90), (104, None), (105, ""), (106, "z" * 199), (107, "q" * 201), (None, base[1]), (108, "short")]
    got = remove_repeats(frame(spark, rows, parts=4), 200, ["doc_id"], crowded)
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got.collect()], key=repr) == brute(rows, 200)


def test_empty_table_and_nothing_to_do(spark):
    assert remove_repeats(frame(spark, []), 200, ["doc_id"]).count() == 0
    got = remove_repeats(frame(spark, [(1, "alone"), (2, None)]), 200, ["doc_id"]).collect()
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in got) == [(1, 0, 0), (2, 0, 0)]
