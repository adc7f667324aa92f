import math

from boutline.llm import urlfilter
from boutline.llm.q_urlfilter import RULES
from pyspark.sql import functions as F

CASES = [
    ("https://Www.Example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
    ("http://example.com/EN/", "example.com", "/EN/", "com/", "allow"),
    ("http://a.NET/es/x?y#z", "a.net", "/es/x", "net/es/", "block"),
    ("http://a.net?u=http://b.com/", "a.net", "", None, None),
    ("http://com/", "com", "/", "com/", "allow"),
    ("http://xcom/", "xcom", "/", None, None),
    ("http://example.com#/en/", "example.com", "", None, None),
    ("x://y://z", "y:", "//z", None, None),
    ("no scheme", "", "", None, None),
    (None, "", "", None, None),
    ("", "", "", None, None),
    ("http://Ä.com/en/é/?q", "Ä.com", "/en/é/", "com/", "allow"),
]


def test_hosts_paths_rules_and_clashing_columns(spark):
    rows = [(i, c[0], "h", "p", "r") for i, c in enumerate(CASES)] + [(0, CASES[0][0], "h", "p", "r"), (99, "http://b.org/" + "x" * 5000, "h", "p", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string")
    got = urlfilter.judge(pages, RULES, carry=["page_id"]).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id < len(CASES):
            _, host, path, rule, verdict = CASES[r.page_id]
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
            assert (r.block_probability is None) == (rule is not None)


def test_scores_equal_plain_arithmetic(spark):
    weights, bias = [((i * 37) % 11 - 5) / 4 for i in range(64)], -0.3
    df = spark.createDataFrame([("a.org", "/bb"), ("", ""), ("x", "")], "host string, path string")
    grams = urlfilter.ngrams(F.col("host"), F.col("path"), (2, 3), 64)
    for g, p in df.select(grams.alias("g"), urlfilter.probability(grams, weights, bias).alias("p")).collect():
        want = 1 / (1 + math.exp(-(bias + sum(weights[b] for b in g) / math.sqrt(max(len(g), 1)))))
        assert abs(p - want) < 1e-12 and len(g) == len(set(g))


def test_model_separates_labelled_urls_and_empty_tables(spark):
    rows = [(f"spam{i}.win", "/buy/now", True) for i in range(40)] + [(f"news{i}.org", "/article/text", False) for i in range(40)]
    labelled = spark.createDataFrame(rows, "host string, path string, block boolean")
    pages = spark.createDataFrame([(1, "http://spam99.win/buy/it"), (2, "http://news77.org/article/a")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages, [], labelled, carry=["page_id"]).collect()}
    assert got == {1: "block", 2: "allow"}
    assert urlfilter.judge(pages.limit(0), RULES, carry=["page_id"]).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages, [], labelled.limit(0), carry=["page_id"]).collect()} == {"allow"}
