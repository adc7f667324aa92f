import collections
import random

from boutline.llm.linededup import keep_bitmaps, line_dedup
from llm_fixtures import frame

BLANK = " \t\n\x0b\x0c\r"


def brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = collections.defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            docs[line.strip(BLANK).translate(low)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            key = line.strip(BLANK).translate(low)
            held = docs[key]
            top = max((x for x in held if x is not None), default=None)
            if not (len(key) >= 20 and len(held) >= 3 and d != top):
                kept.append(line)
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def check(spark, rows, **kw):
    got = line_dedup(frame(spark, rows, **kw), ["doc_id"]).collect()
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got], key=repr) == brute(rows)


def test_lines_against_brute_force(spark):
    rng = random.Random(5)
    pool = [f"a common line number {i} of the pool" for i in range(12)] + ["short", "", "  Ä line with ümlauts, long enough  ", "x" * 19, "y" * 20]
    rows = [(i, "\n".join(rng.choice([rng.choice(pool), rng.choice(pool).upper() + " \t", f"own line {rng.randrange(10**9)} here"]) for _ in range(rng.randrange(9)))) for i in range(150)]
    check(spark, rows + [(900, None), (901, ""), (None, pool[0]), (902, "\n".join(pool))], parts=5)


def test_repeated_rows_are_one_document_and_each_keeps_its_own_text(spark):
    line = "the very same line in every document"
    check(spark, [(1, line), (1, line), (2, line)])  # two documents only
    check(spark, [(1, line), (1, line + "\nmore"), (2, line), (3, line), (3, "other\n" + line)])


def test_hot_line_over_many_tasks_and_empty_table(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        check(spark, [(i, f"one line that all documents share\nown text number {i // 2} of this document") for i in range(400)], parts=9)
        assert keep_bitmaps(frame(spark, [])).count() == 0
        assert line_dedup(frame(spark, []), ["doc_id"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
