import hashlib
import random

import pytest

from boutline.llm import lzprint
from llm_fixtures import frame, prose


def plain(text):
    seen, at = set(), 0
    for end in range(1, len(text) + 1):
        if text[at:end] not in seen:
            seen.add(text[at:end])
            at = end
    return seen


def test_phrases_against_plain_parser():
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("abä"[: rng.randint(1, 3)]) for _ in range(rng.randrange(200)))
        assert set(lzprint.parse(t)[0]) == plain(t)


def test_likeness_tracks_the_sets_and_is_symmetric():
    rng = random.Random(3)
    a = prose(rng, 900)
    b = a[: len(a) // 2] + prose(rng, 450)
    x, y = lzprint.fingerprint(a), lzprint.fingerprint(b)
    p, q = plain(a), plain(b)
    assert abs(lzprint.likeness(x, y) - len(p & q) / len(p | q)) < 0.2
    assert lzprint.likeness(x, y) == lzprint.likeness(y, x) and lzprint.likeness(x, x) == 1.0
    none = lzprint.fingerprint("")
    assert lzprint.likeness(none, none) == 1.0 and lzprint.likeness(none, x) == 0.0
    assert (lzprint.read(lzprint.written(x)) == x).all()


@pytest.mark.parametrize("n", [0, 1, 2, 40])
def test_neighbours_over_many_tasks(spark, n):
    rng = random.Random(n)
    rows = [(i * 3, prose(rng, rng.randrange(80))) for i in range(n)]
    if n == 40:
        rows += [(500, None), (501, ""), (502, "é😀" * 3000), (503, rows[1][1])]
    got = {r.doc_id: r for r in lzprint.edited_neighbours(frame(spark, rows, parts=7)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 2
        edited = t[: len(t) - k] + following[:k]
        r, x, y, z = got[d], lzprint.fingerprint(t), lzprint.fingerprint(edited), lzprint.fingerprint(following)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (lzprint.written(x), lzprint.written(y))
        assert (r.near_edited, r.near_next) == (lzprint.likeness(x, y), lzprint.likeness(x, z))


def test_repeated_rows_stay(spark):
    got = lzprint.edited_neighbours(frame(spark, [(1, "same text here"), (1, "same text here"), (None, "z")])).collect()
    assert sorted((r.doc_id is None, r.n_chars) for r in got) == [(False, 14), (False, 14), (True, 1)]
