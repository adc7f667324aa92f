import itertools
import random

import numpy as np

from boutline.llm import langcrf
from llm_fixtures import frame

SYLLABLES = {"xx": ["ka", "to", "mi", "ru"], "yy": ["ble", "gra", "stu", "fle"], "zz": ["öl", "äm", "ür", "ßa"]}


def sentence(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


def test_posteriors_against_all_paths_and_long_texts():
    rng = np.random.default_rng(1)
    L, start, moves = 3, rng.normal(size=3), rng.normal(size=(3, 3))
    e = rng.normal(size=(6, L))
    p, x, total = np.zeros((6, L)), np.zeros((L, L)), 0.0
    for path in itertools.product(range(L), repeat=6):
        w = np.exp(start[path[0]] + sum(e[i, k] for i, k in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
        total += w
        for i, k in enumerate(path):
            p[i, k] += w
        for a, b in itertools.pairwise(path):
            x[a, b] += w
    got, pairs = langcrf.posteriors(e, np.array([6]), start, moves, total_moves=True)
    assert np.allclose(got, p / total) and np.allclose(pairs, x / total)
    lengths = np.array([1, 31, 32, 33, 64, 500])
    e = rng.normal(size=(lengths.sum(), L))
    together, at = langcrf.posteriors(e.copy(), lengths, start, moves), 0
    for n in lengths:
        a, b = np.zeros((n, L)), np.ones((n, L))
        for t in range(n):
            a[t] = np.exp(e[at + t]) * (np.exp(start) if t == 0 else a[t - 1] @ np.exp(moves))
            a[t] /= a[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = np.exp(moves) @ (np.exp(e[at + t + 1]) * b[t + 1])
            b[t] /= b[t].sum()
        q = a * b
        assert np.allclose(together[at : at + n], q / q.sum(1, keepdims=True))
        at += n


def test_learned_languages_switches_and_special_cases(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, lang, rng.randint(5, 40)), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 30)]
    rows += [(200, None, "xx"), (201, "", "yy"), (202, "12 ² !!", None), (203, sentence(rng, "yy", 9000), None), (204, rows[0][1], None), (204, rows[0][1], None), (None, rows[1][1], None)]
    docs = frame(spark, rows)
    model = langcrf.train(docs.filter("doc_id < 60"))
    got = langcrf.predict(docs, model, "text", ["doc_id", "lang", "n"]).collect()
    assert len(got) == len(rows)
    assert all(r.lang_pred == r.lang and 0.5 < r.score <= 1 for r in got if r.doc_id is not None and r.doc_id < 200)
    other = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert other[200] == other[201] == other[202] == ("und", 0.0)
    assert other[203][0] == "yy" and other[204][0] == "xx" and other[None][0] == "yy"
    mixed = model.label_words(sentence(rng, "xx", 12) + " " + sentence(rng, "yy", 12))
    right = [lang == ("xx" if i < 12 else "yy") for i, (_, lang, _) in enumerate(mixed)]
    assert sum(right) >= 22
    assert np.diag(model.moves).min() > model.moves[~np.eye(3, dtype=bool)].max()


def test_empty_tables(spark):
    none = langcrf.train(frame(spark, []))
    assert none.languages == []
    got = langcrf.predict(frame(spark, [(1, "some text")]), none, "text", ["doc_id"]).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert langcrf.predict(frame(spark, []), none, "text", ["doc_id"]).count() == 0


def test_the_fit_does_not_run_on_the_driver(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, sentence(rng, lang, 12), lang) for i, lang in enumerate(["xx", "yy"] * 6)]
    docs = frame(spark, rows)
    alone = langcrf.fit([(t, lang) for _, t, lang in rows])

    def refused(*_, **__):
        raise AssertionError("the driver fits")

    monkeypatch.setattr(langcrf, "posteriors", refused)  # workers import their own
    model = langcrf.train(docs)
    assert model.languages == alone.languages and model.lexicon == alone.lexicon
    assert np.allclose(model.weights, alone.weights, atol=1e-4)
