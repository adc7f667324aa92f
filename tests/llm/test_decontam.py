import collections
import random
import re

from boutline.llm.decontam import contaminated
from llm_fixtures import frame, prose


def shingles(t, k=5):
    w = [x for x in re.split(r"[^\w]+|_", (t or "").lower()) if x]
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []


def brute(rows, items):
    out = set()
    for d, t in rows:
        s = shingles(t)
        for item, text in items:
            b = collections.Counter(shingles(text))
            m = sum(b.values())
            for at in range(max(1, len(s) - m + 1)):
                w = collections.Counter(s[at : at + m])
                inter = sum((w & b).values())
                if inter and inter / (sum(w.values()) + m - inter) >= 0.8:
                    out.add((d, item))
                    break
    return out


def test_hits_against_every_window(spark):
    rng = random.Random(11)
    items = [(i, prose(rng, rng.randrange(14, 50), 5000)) for i in range(25)] + [(50, None), (51, ""), (52, "one two"), (53, "same " * 30)]
    rows = []
    for i in range(120):
        text = items[rng.randrange(25)][1].split()
        for _ in range(rng.choice([0, 0, 0, 1])):
            text[rng.randrange(len(text))] = "changed"
        if rng.random() < 0.3:
            text = text[: rng.randrange(1, len(text))]
        rows.append((i, prose(rng, rng.randrange(60), 5000) + ". " + " ".join(text).upper() + "! " + prose(rng, rng.randrange(60), 5000)))
    rows += [(200, None), (201, ""), (202, "One, TWO!"), (203, "same " * 400), (204, items[3][1]), (204, items[3][1]), (None, items[4][1]), (205, prose(rng, 20_000, 5000) + " " + items[5][1])]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, shingles string")
    got = contaminated(frame(spark, rows), bench).collect()
    assert len({(r.doc_id, r.item_id) for r in got}) == len(got)
    assert {(r.doc_id, r.item_id) for r in got} == brute(rows, items)
    assert all(0.8 <= r.similarity <= 1 for r in got)


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert contaminated(frame(spark, []), bench).count() == 0
    assert contaminated(frame(spark, [(1, "a b c d e f g")]), bench.limit(0)).count() == 0


def test_passages_with_moved_parts(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, n, 5000)) for i, n in enumerate([59, 59, 75, 100, 140])]
    rows = []
    for i in range(40):
        item, text = items[i % 5]
        w = text.split()
        cuts = [0, *sorted(rng.sample(range(8, len(w) - 8), 1 if len(w) < 100 else 2)), len(w)]
        parts = [w[a:b] for a, b in zip(cuts, cuts[1:])][::-1]
        rows.append((i, prose(rng, rng.randrange(90), 5000) + " " + " ".join(sum(parts, [])) + " " + prose(rng, rng.randrange(90), 5000)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    assert len(want) > 30
    assert {(r.doc_id, r.item_id) for r in contaminated(frame(spark, rows), bench).collect()} == want


def test_items_without_id_or_with_equal_texts(spark):
    text = "eight words stand here in this very order"
    bench = spark.createDataFrame([(None, text), (3, text), (4, text + " and some more of them follow")], "item_id long, text string")
    got = contaminated(frame(spark, [(1, "before it " + text + " after"), (None, text), (2, "none of that")]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, None), (1, 3), (None, None), (None, 3)}
