"""Token ids of whole texts through the tokenizer's library, distinct words once.

A text is cut before single spaces into words, whose ids in order are the ids of
the text: no token and no rule of the vocabularies used here reaches over such a
place. This holds for byte-level vocabularies with the usual pre-tokenizer,
which starts a token at a space before a character that is no white space, and
for piece vocabularies whose pieces hold the space mark at their begin only.
Byte-level words are cut before punctuation as well. Words come again and again,
so most are known, and the library encodes the others.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A mark between words; texts that hold it are cut like awkward ones.
MARK = "\uffff"
_SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A space before white space or at the end; texts without one may be cut at every space, others only where `CUT` finds a place.
AWKWARD, CUT = rf" {_SPACES}| \z|{MARK}", re.compile(r"(?<=\S)(?= \S)")
#: Where a byte-level pre-tokenizer parts a word: after Latin letters or digits before ASCII punctuation, and after both before line ends.
BYTE_LEVEL_CUTS = (r"([0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([!-/:-@\[-^`{-~])", r"([!-~\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([\t\n\r])")
#: Bytes of texts that are split at a time; a table is full when it holds more words or ids.
SPLIT_BYTES, MOST_WORDS, MOST_IDS = 8 << 20, 450_000, 6_000_000


class _Table:
    """Ids of known strings, in one array. When it is full, a new one begins that takes over from the old one what comes again."""

    def __init__(self, old: _Table | None = None) -> None:
        self.old = old
        self.place: dict = {}
        self.n_ids, self.flat = 0, np.zeros(1 << 16, np.uint32)
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def add(self, keys: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        first, last, end = len(self.place), len(self.place) + len(keys), self.n_ids + len(ids)
        if end > len(self.flat):
            self.flat = np.resize(self.flat, max(end, 2 * len(self.flat)))
        if last > len(self.starts):
            self.starts, self.lengths = (np.resize(x, max(last, 2 * len(x))) for x in (self.starts, self.lengths))
        self.flat[self.n_ids : end], self.lengths[first:last] = ids, lengths
        self.starts[first:last] = self.n_ids + np.cumsum(lengths) - lengths
        self.place.update(zip(keys, range(first, last), strict=True))
        self.n_ids = end

    def places(self, keys: list, learn: Callable[[list], tuple[np.ndarray, np.ndarray]], most: int) -> np.ndarray:
        """Where the ids of each key are; ``learn`` gives those of unknown keys. Places hold until the next call."""
        if len(self.place) > most or self.n_ids > MOST_IDS:
            old = _Table()
            old.place, old.n_ids, old.flat, old.starts, old.lengths = self.place, self.n_ids, self.flat, self.starts, self.lengths
            self.__init__(old)
        index = np.fromiter(map(self.place.get, keys, repeat(-1)), np.int64, len(keys))
        unknown = np.flatnonzero(index < 0)
        if len(unknown):
            own = list(map(keys.__getitem__, unknown.tolist()))
            fresh = list(dict.fromkeys(own))
            if self.old is not None:
                before = np.fromiter(map(self.old.place.get, fresh, repeat(-1)), np.int64, len(fresh))
                self.add([fresh[k] for k in np.flatnonzero(before >= 0).tolist()], *self.old.ids(before[before >= 0]))
                fresh = [fresh[k] for k in np.flatnonzero(before < 0).tolist()]
            self.add(fresh, *learn(fresh))
            index[unknown] = np.fromiter(map(self.place.__getitem__, own), np.int64, len(own))
        return index

    def ids(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at some places in a row, and how many each has."""
        lengths = self.lengths[index]
        ends = np.cumsum(lengths)
        at = np.repeat((self.starts[index] - ends + lengths).astype(np.int32), lengths)
        at += np.arange(len(at), dtype=np.int32)
        return self.flat[at], lengths


class WordEncoder:
    """Ids of whole texts.

    ``encode`` is the library's function from texts to lists of ids. It gets
    words as they stand, with their space, or without it if ``adds_space``, which also needs a letter to be one token behind a space.
    With ``leading``, every text has a further space at its begin. ``cuts`` are
    patterns of two groups between which a word is cut too, but in texts that hold one of ``uncut``.
    """

    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[int]]], adds_space: bool = False, leading: bool = False, cuts: Sequence[str] = (), uncut: Sequence[str] = (), most: int = MOST_WORDS) -> None:
        self.library, self.adds_space, self.leading, self.cuts, self.most = encode, adds_space, leading, cuts, most
        self.awkward = "|".join([AWKWARD, *map(re.escape, uncut)])
        self.words = _Table()

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.library([w[1:] if w[:1] == " " else "a" + w for w in words] if self.adds_space else words)
        if self.adds_space:  # what follows a cut has no space; behind a letter its ids are those after the letter's
            found = [ids if w[:1] == " " else ids[1:] for w, ids in zip(words, found, strict=True)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _split(self, texts: pa.Array) -> pa.ListArray:
        """The words of each text with the spaces before them, one at least."""
        if self.leading:
            texts = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
        marked = pc.replace_substring(texts, " ", MARK + " ")
        for cut in self.cuts:
            marked = pc.replace_substring_regex(marked, cut, rf"\1{MARK}\2")
        words = pc.split_pattern(marked, MARK)
        awkward = np.flatnonzero(pc.match_substring_regex(texts, self.awkward).to_numpy(zero_copy_only=False))
        if not len(awkward):
            return words
        own = pa.array(map(CUT.split, texts.take(pa.array(awkward)).to_pylist()), words.type)
        order = np.arange(len(texts))
        order[awkward] = len(texts) + np.arange(len(awkward))
        return pa.concat_arrays([words, own]).take(pa.array(order))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all of a string array in a row, and how many each text has; null is empty."""
        lists = self._split(pc.fill_null(texts, "").cast(pa.large_string()))
        sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        places = self.words.places(coded.dictionary.to_pylist(), self._learn, self.most)
        ids, lengths = self.words.ids(places[coded.indices.to_numpy()])
        return ids, np.add.reduceat(lengths, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0, np.int64)


def byte_level(definition: str, special: bool, leading: bool = False, most: int = MOST_WORDS) -> WordEncoder:
    """Of a byte-level vocabulary of the tokenizers library; ``special``: strings of special tokens in texts are these tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = not special
    strings = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return WordEncoder(lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], leading=leading, cuts=BYTE_LEVEL_CUTS, uncut=strings if special else (), most=most)
