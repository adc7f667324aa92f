"""Token ids of whole texts with the tokenizers library, each distinct word encoded once per worker.

White space separates words for this tokenizer family and yields no ids, so a text's ids are those of its words in order. Words of
letters with a tail of plain punctuation are split there as the tokenizer's own pattern does; all other words go to the library as they
are. What is remembered is bounded by ``REMEMBERED`` pieces.
"""

from __future__ import annotations

import itertools
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

REMEMBERED = 400_000
TAIL = ".,!?;:#*%$&|)]}\"-_=+~^@/\\"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Encoder:
    """Encodes batches of texts; only for tokenizers that drop white space and never join letters over it."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.letters: set[str] = set()
        self.flat, self.starts, self.sizes = np.empty(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _stays_letters(self, word: str) -> bool:
        stays = word.lower().isalpha() and unicodedata.normalize("NFC", word).isalpha()
        if stays:
            self.letters.add(word)
        return stays

    def _learn(self, single: list[str], other: list[str]) -> None:
        """Add pieces: ``single`` are known to be one word of the tokenizer's pattern each."""
        ids: list[list[int]] = []
        for at in range(0, len(single), 512):
            group = single[at : at + 512]
            joined = self.library.encode(" ".join(group), add_special_tokens=False)
            owner = np.array(joined.word_ids, np.float64)
            cuts = np.flatnonzero(np.diff(owner)) + 1 if len(owner) else []
            if len(owner) and not np.isnan(owner).any() and len(cuts) + 1 == len(group):
                bounds = [0, *cuts.tolist(), len(owner)]
                all_ids = joined.ids
                ids += [all_ids[a:b] for a, b in itertools.pairwise(bounds)]
            else:
                ids += [e.ids for e in self.library.encode_batch_fast(group, add_special_tokens=False)]
        if other:
            ids += [e.ids for e in self.library.encode_batch_fast(other, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        begin = len(self.flat) + np.cumsum(sizes) - sizes
        for i, piece in enumerate(itertools.chain(single, other)):
            self.known[piece] = len(self.sizes) + i
        self.flat = np.concatenate([self.flat, flat])
        self.starts = np.concatenate([self.starts, begin])
        self.sizes = np.concatenate([self.sizes, sizes])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another as uint32, number of ids of each text). Nulls are empty."""
        if len(self.known) > REMEMBERED:
            self._forget()
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        first, second = [], []
        single: dict[str, None] = {}
        other: dict[str, None] = {}
        for w in words:
            core = w.rstrip(TAIL)
            tail = w[len(core) :]
            ascii_ = core.isascii()
            # a letter may become a letter and a mark when lower-cased or composed, and the mark would join the punctuation
            if core.isalpha() and (ascii_ or core in self.letters or self._stays_letters(core)):
                if ascii_:
                    core = core.lower()
                if core not in self.known:
                    single[core] = None
            elif core:
                core, tail = w, ""
                if core not in self.known:
                    other[core] = None
            if tail and tail not in self.known:
                single[tail] = None
            first.append(core)
            second.append(tail)
        if single or other:
            self._learn(list(single), list(other))
        n = len(words)
        pieces = np.empty((n, 2), np.int64)
        pieces[:, 0] = np.fromiter((self.known[x] for x in first), np.int64, n)
        pieces[:, 1] = np.fromiter((self.known[x] for x in second), np.int64, n)
        index = coded.indices.to_numpy()
        used = pieces[index].ravel()
        size = self.sizes[used]
        word_sizes = size.reshape(-1, 2).sum(1)
        upto = np.concatenate([[0], np.cumsum(word_sizes)])
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        counts = upto[offsets[1:]] - upto[offsets[:-1]]
        keep = size > 0
        used, size = used[keep], size[keep]
        total = int(size.sum())
        shift = self.starts[used] - (np.cumsum(size) - size)
        return self.flat[np.repeat(shift, size) + np.arange(total)], counts
