import random
import re

import pytest

from boutline.llm.graph import merged
from boutline.llm.jaccard import similar_components
from llm_fixtures import frame, prose


def brute(rows, width=4, percent=85):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(low)) if x]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted([(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)], key=repr)


@pytest.mark.parametrize("slots", [3, 29])
def test_components_against_brute_force(spark, slots):
    rng = random.Random(slots)
    base = [prose(rng, 120) for _ in range(4)]
    rows = []
    for i in range(150):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, prose(rng, rng.choice([1, 2, 3, 4, 5, 30, 700]), 15)) for i in range(60)]
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "ONE two"), (304, "one TWO"), (305, rows[0][1]), (305, rows[0][1]), (None, rows[3][1]), (306, rows[5][1].upper())]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(slots))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = similar_components(frame(spark, rows))
        assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty_table_and_texts_without_words(spark):
    assert similar_components(frame(spark, [])).count() == 0
    got = similar_components(frame(spark, [(1, None), (2, ""), (3, " ")])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_link_at_the_threshold_between_groups_that_lead_in_different_buckets(spark):
    def some(name, n):
        return [f"{name}{i}" for i in range(n)]

    # 200 words each; x and y share 184 of 216 and just 15 of their 31 rarest words. The first seven of these are in x's edit, the other eight in y's
    base, common = some("base", 169), some("common", 15)
    x, y = some("x", 16), some("y", 16)
    sets = [base + common + x, base + common[:7] + x[:8] + some("p", 16), base + common + y, base + common[7:] + y[:8] + some("q", 15)]
    sets += [some("p", 16) + some("q", 15) + some(f"own{k}w", 60) for k in range(10)]  # the edits' other words are frequent, so both edits are central
    rows = [(i, " ".join(s)) for i, s in enumerate(sets)]
    want = brute(rows, 1)
    assert [c for _, _, c in want].count(0) == 4
    assert sorted(map(tuple, similar_components(frame(spark, rows), width=1).collect())) == sorted(want)


def test_small_joins_stay_off_the_driver(spark):
    a = spark.range(50).selectExpr("id AS u", "id % 7 AS v").repartition(2)
    b = spark.range(50).selectExpr("id AS u", "id AS m").repartition(2)
    joined = merged(a, b, "u")
    assert joined.count() == 50
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in similar_components(frame(spark, [(1, "a b c d e f"), (2, "a b c d e f")]))._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line and "strategy=merge" not in line]
