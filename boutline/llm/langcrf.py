"""Language identification by a linear-chain conditional random field over the words of a text.

Words are letter runs. A word's features are its affixes, its character n-grams and what a learned lexicon says of it, hashed into a
table of weights per language; transitions between the languages of neighbouring words are learned with them, so a text may switch
languages. Forward-backward gives every word's posterior; a document's language is the one with the largest mean posterior over
all its words, its score that mean.

The model is fitted on whole texts of at most ``per_language`` labelled documents of each language (those with the smallest hash of their
id, a bound that does not grow with the corpus); its size is fixed by ``buckets`` and that bound. Prediction is one pass without a shuffle: a long text
is cut into segments whose transfer matrices are computed side by side, then joined, so the result is exact for any length.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is everything when no labelled text exists. Ties go to
the first language by name. Repeated rows get equal results. Only the named columns are read.
"""

from __future__ import annotations

import pickle
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import carried, slices, unpacked

WORD = re.compile(r"[^\W\d_]+")
SEGMENT = 32
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def features(word: str, buckets: int, lexicon: dict[str, int]) -> list[int]:
    """Hashed affixes (1-3 letters), character 2- and 3-grams with borders, and the lexicon's language."""
    marked = f"^{word}$"
    parts = [f"p{word[:k]}" for k in (1, 2, 3)] + [f"s{word[-k:]}" for k in (1, 2, 3)]
    parts += [marked[i : i + 2] for i in range(len(marked) - 1)]
    parts += [marked[i : i + 3] for i in range(len(marked) - 2)]
    known = lexicon.get(word)
    if known is not None:
        parts.append(f"lex={known}")
    return [zlib.crc32(p.encode()) % buckets for p in parts]


@dataclass
class Crf:
    """Weights (buckets x languages), start and transition scores, lexicon."""

    languages: list[str]
    weights: np.ndarray
    start: np.ndarray
    moves: np.ndarray
    lexicon: dict[str, int]
    seen: dict[str, np.ndarray] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "seen": {}}

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of distinct words; remembered up to a fixed number of words."""
        if len(self.seen) > 100_000:
            self.seen.clear()
        new = [w for w in words if w not in self.seen]
        if new:
            spots = [features(w, len(self.weights), self.lexicon) for w in new]
            flat = np.fromiter((i for s in spots for i in s), np.int64)
            sizes = np.fromiter(map(len, spots), np.int64, len(spots))
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            scores = np.add.reduceat(self.weights[flat], starts) / np.sqrt(sizes)[:, None]
            self.seen.update(zip(new, scores.astype(np.float32)))
        return np.array([self.seen[w] for w in words], np.float32).reshape(len(words), len(self.languages))

    def posteriors(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Posterior of every word; ``scores`` are the words' emissions of consecutive texts of ``lengths`` (all positive)."""
        return posteriors(scores, lengths, self.start, self.moves)

    def label_words(self, text: str | None) -> list[tuple[str, str, float]]:
        """(word, language, posterior) of each word of a text, for code-switched texts."""
        w = words_of(text)
        if not w or not self.languages:
            return []
        p = self.posteriors(self.emissions(w), np.array([len(w)]))
        best = p.argmax(1)
        return [(x, self.languages[b], float(p[i, b])) for i, (x, b) in enumerate(zip(w, best))]


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def posteriors(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, moves: np.ndarray, total_moves: bool = False):
    """Forward-backward over many texts at once: per segment a transfer matrix, along each text the products of these, then the words
    inside all segments step by step. With ``total_moves`` also the expected number of each move between neighbours."""
    L = scores.shape[1]
    e = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float64)
    A, s0 = np.exp(moves - moves.max()), np.exp(start - start.max())
    per_text = -(-lengths // SEGMENT)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    text_of = np.repeat(np.arange(len(lengths)), per_text)
    rank = np.arange(len(text_of)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    begin = first[text_of] + rank * SEGMENT
    size = np.minimum(SEGMENT, first[text_of] + lengths[text_of] - begin)
    order = np.argsort(-size, kind="stable")
    live = [int(np.searchsorted(-size[order], -s, side="left")) for s in range(SEGMENT)]  # segments longer than s
    # transfer matrices: entering language x leaving language, without the first word's start score
    M = np.tile(np.eye(L), (len(size), 1, 1))
    for s in range(SEGMENT):
        k = order[: live[s]]
        if not len(k):
            break
        step = (M[k].reshape(-1, L) @ A).reshape(-1, L, L) * e[begin[k] + s][:, None, :]
        M[k] = step / step.max((1, 2), keepdims=True)
    # the language before a text is drawn so that one move gives the start scores
    into = np.empty((len(size), L))
    out = np.empty((len(size), L))
    seg0 = np.cumsum(per_text) - per_text
    into[seg0] = -1.0  # marks a text's first segment
    by_length = np.argsort(-per_text, kind="stable")
    longest = int(per_text.max())
    many = -per_text[by_length]
    alpha = np.empty((len(lengths), L))
    for r in range(longest):
        t = by_length[: int(np.searchsorted(many, -r, side="left"))]
        seg = seg0[t] + r
        if r == 0:
            k = begin[seg]
            alpha[t] = 0
            first_word = _normal(s0 * e[k])
            # leaving scores of the first segment from its first word on
            alpha[t] = _leave(first_word, seg, begin, size, e, A)
        else:
            into[seg] = alpha[t]
            alpha[t] = _normal(np.einsum("ni,nij->nj", alpha[t], M[seg]))
    beta = np.ones((len(lengths), L))
    for r in range(longest - 1, -1, -1):
        t = by_length[: int(np.searchsorted(many, -r, side="left"))]
        seg = seg0[t] + r
        out[seg] = beta[t]
        if r:
            beta[t] = _normal(np.einsum("nij,nj->ni", M[seg], beta[t]))
    P, forward = np.empty_like(e), np.empty_like(e) if total_moves else None
    a = np.empty((len(size), L))
    for s in range(SEGMENT):
        k = order[: live[s]]
        if not len(k):
            break
        before = (a[k] if s else into[k]) @ A
        if s == 0:
            before = np.where(into[k][:, :1] < 0, s0, before)
        a[k] = _normal(before * e[begin[k] + s])
        P[begin[k] + s] = a[k]
    b, ahead = out, np.empty_like(e) if total_moves else None
    for s in range(SEGMENT - 1, -1, -1):
        k = order[: live[s]]
        if not len(k):
            continue
        at = begin[k] + s
        if total_moves:
            ahead[at] = e[at] * b[k]
        fore = P[at]
        P[at] = _normal(fore * b[k])
        if total_moves:
            forward[at] = fore
        b[k] = _normal((b[k] * e[at]) @ A.T)
    if not total_moves:
        return P
    inner = np.ones(len(e), np.bool_)
    inner[first] = False
    t = np.flatnonzero(inner)
    pairs = forward[t - 1][:, :, None] * A[None] * ahead[t][:, None, :]
    return P, (pairs / pairs.sum((1, 2), keepdims=True)).sum(0)


def _leave(alpha, seg, begin, size, e, A):
    """Forward scores at the end of segments, from those of their first words."""
    for s in range(1, SEGMENT):
        k = np.flatnonzero(size[seg] > s)
        if not len(k):
            break
        alpha[k] = _normal((alpha[k] @ A) * e[begin[seg[k]] + s])
    return alpha


def fit(texts: list[tuple[str, str]], buckets: int = 1 << 15, steps: int = 40, rate: float = 0.3, ridge: float = 2e-6, seen_often: int = 3) -> Crf:
    """Maximise the conditional likelihood of the labelled texts' words by full-batch adaptive gradient steps."""
    languages = sorted({lang for _, lang in texts})
    L = len(languages)
    index = {x: i for i, x in enumerate(languages)}
    docs = [(w, index[lang]) for t, lang in texts if (w := words_of(t))]
    model = Crf(languages, np.zeros((buckets, max(L, 1)), np.float32), np.zeros(max(L, 1)), np.zeros((max(L, 1), max(L, 1))), {})
    if not docs or L < 1:
        return model
    counts: dict[str, np.ndarray] = {}
    for w, y in docs:
        for x in w:
            counts.setdefault(x, np.zeros(L, np.int64))[y] += 1
    # a word is in a language's lexicon when it is frequent there and hardly anywhere else
    model.lexicon = {x: int(c.argmax()) for x, c in counts.items() if c.sum() >= seen_often and c.max() >= 0.9 * c.sum()}
    vocabulary = {x: i for i, x in enumerate(counts)}
    ids = np.fromiter((vocabulary[x] for w, _ in docs for x in w), np.int64)
    lengths = np.array([len(w) for w, _ in docs])
    y = np.repeat([k for _, k in docs], lengths)
    spots = [features(x, buckets, model.lexicon) for x in vocabulary]
    flat = np.fromiter((i for s in spots for i in s), np.int64)
    sizes = np.fromiter(map(len, spots), np.int64, len(spots))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    scale = 1 / np.sqrt(sizes)
    word_of = np.repeat(np.arange(len(spots)), sizes)
    gold = np.eye(L)[y]
    ends = np.cumsum(lengths)
    begins = ends - lengths
    inner = np.ones(len(ids), np.bool_)
    inner[begins] = False
    inner = np.flatnonzero(inner)
    observed = np.zeros((L, L))
    np.add.at(observed, (y[inner - 1], y[inner]), 1)
    n = len(ids)
    weights, sw = np.zeros((buckets, L)), np.full((buckets, L), 1e-9)
    for _ in range(steps):
        e = (np.add.reduceat(weights[flat], starts) * scale[:, None])[ids]
        p, expected = posteriors(e, lengths, model.start, model.moves, total_moves=True)
        miss = (gold - p) / n
        by_word = np.stack([np.bincount(ids, miss[:, k], len(spots)) for k in range(L)], 1) * scale[:, None]
        g = np.stack([np.bincount(flat, by_word[word_of, k], buckets) for k in range(L)], 1) - ridge * weights
        sw += g * g
        weights += rate * g / np.sqrt(sw)
        model.moves += rate * ((observed - expected) / max(len(inner), 1) - 1e-3 * model.moves)
        model.start += rate * (gold[begins] - p[begins]).mean(0)
    model.weights = weights.astype(np.float32)
    return model


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", per_language: int = 100, **fitting) -> Crf:
    """Fit on at most ``per_language`` texts of each language; ids only decide which."""
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    rank = F.row_number().over(W.partitionBy(lang).orderBy(F.xxhash64(id), id))
    # Spark keeps only the first rows of each language per task before it shuffles; texts follow for the chosen ids alone
    chosen = rows.select(id, lang).withColumn("_rank", rank).filter(F.col("_rank") <= per_language).select(id)
    found = rows.join(F.broadcast(chosen), id, "left_semi").select(text, lang, id)
    # an id may repeat: still at most ``per_language`` texts of each language come back
    again = F.row_number().over(W.partitionBy(lang).orderBy(F.xxhash64(id), id, F.xxhash64(text)))
    got = found.withColumn("_again", again).filter(F.col("_again") <= per_language)
    order = [F.xxhash64(id), F.col(id), F.xxhash64(text)]
    texts = got.repartition(1).sortWithinPartitions(*order).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    # one task fits the bounded sample: only the model, not the texts and what the fit needs, is ever held by the driver
    fitted = texts.mapInArrow(_fitted(fitting), "model binary").collect()
    return pickle.loads(bytes(fitted[0][0])) if fitted else fit([], **fitting)


def _fitted(fitting: dict):
    def run(batches):
        texts = [pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, **fitting))], pa.binary())], names=["model"])

    return run


def predict(docs: DataFrame, model: Crf, text: str = "text", carry: list[str] | None = None, nested: bool = False) -> DataFrame:
    """``carry`` columns (or with ``nested`` one struct ``row`` of them) plus ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inside = text in (carry or [])  # the text travels once
    rows = docs.select(carried(carry)) if inside else docs.select(carried(carry), F.col(text).alias("text"))
    schema = rows.select("row").schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        crf = shared.value
        def pairs(batch):
            found = pc.struct_field(batch.column(0), text) if inside else batch.column(1)
            return pa.RecordBatch.from_arrays([batch.column(0), found], names=["row", "text"])

        for batch in (part for whole in batches for part in slices(pairs(whole), 1, 2 << 20)):
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            lists = [words_of(t) for t in batch.column(1).to_pylist()]
            known = [i for i, w in enumerate(lists) if any(c.isalpha() for x in w for c in x)]
            if known and crf.languages:
                coded = pa.array([x for i in known for x in lists[i]], pa.string()).dictionary_encode()
                e = crf.emissions(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
                lengths = np.array([len(lists[i]) for i in known])
                p = crf.posteriors(e, lengths)
                mean = np.add.reduceat(p, np.cumsum(lengths) - lengths) / lengths[:, None]
                for i, b, m in zip(known, mean.argmax(1), mean):
                    names[i], scores[i] = crf.languages[b], min(1.0, float(m[b]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores)], names=["row", "lang_pred", "score"])
        crf.seen.clear()  # the worker lives on and keeps the model

    found = rows.mapInArrow(run, schema)
    return found if nested else found.select(*unpacked(carry), "lang_pred", "score")
