"""Token ids of texts by a tokenizers file, with a bounded memory of words seen before.

Both public tokenizers encode the words of a text independently of each other, so a word met
again need not be encoded again, whatever marks follow it; in a batch of texts each different word
is looked up once. The text is cut only where the tokenizer itself must cut:

* byte-level: before a single space that follows a non-space and precedes one;
* word-level: at spaces and line feeds, which that tokenizer drops.

A text in which this is not plain (a space before other white space, the strings of special
tokens) is encoded whole by the library.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sessionloom.llm.common import look_up

#: Letters that stay one piece in both tokenizers, and marks that follow as one piece of their own.
_LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x250)])).translate(dict.fromkeys([0xD7, 0xF7, 0x130]))
_MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{}~"

#: The letters that byte-level models spell bytes with, where they are not the byte's own.
_SPELLED = {b: chr(256 + k) for k, b in enumerate([*range(33), *range(127, 161), 173])}

_CHUNK = 8_000_000  # characters encoded at a time


class WordCodec:
    """``encode(texts)`` gives one bytes object per text: its ids as little-endian uint32.

    ``room`` bounds the words remembered (without the marks after them); further ones are forgotten after their batch.
    """

    def __init__(self, path: str, byte_level: bool, room: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.byte_level, self.room = Tokenizer.from_file(path), byte_level, room
        self.known = _table([], np.empty(0, "<u4"), [])

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """Ids of texts by the library one after another, and how many each has."""
        found = [e.ids for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), "<u4"), list(map(len, found))

    def _letters(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        """The same for words of letters: pieces of their own, so the library's model can take them one by one."""
        tokenize, number, ids, size = self.tok.model.tokenize, attrgetter("id"), [], []
        if self.byte_level:  # a space opens a word; a line feed is a piece before it
            feed, words = self.tok.model.token_to_id(_SPELLED[10]), [w if w[0] == "\n" else " " + w for w in words]
            for w in words:
                found = tokenize(_spelled(w[1:]) if w[0] == "\n" else _SPELLED[32] + _spelled(w[1:]))
                if w[0] == "\n":
                    ids.append(feed)
                ids += map(number, found)
                size.append(len(found) + (w[0] == "\n"))
        else:
            for w in words:
                found = tokenize(_spelled(w.lower()))
                ids += map(number, found)
                size.append(len(found))
        some, long = self._ids(words[:64])
        if long != size[:64] or some.tolist() != ids[:len(some)]:
            raise ValueError("the tokenizer parts words otherwise than expected")
        return np.array(ids, "<u4"), size

    def _learn(self, missing: set[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """A table of these words."""
        names, rest, whole = pa.array(list(missing), pa.large_string()), [], []
        plain = _plain(names)
        letters = _strings(names.filter(plain))
        for w in _strings(names.filter(pc.invert(plain))):
            if self.byte_level and (not w or w[0] != "\n" and not w[0].strip()) or w and ("<|" in w or not w[:2].strip()):
                whole.append(w)
            else:
                rest.append(w)
        ids, size = zip(self._letters(letters), self._ids([" " + w if self.byte_level and w[0] != "\n" else w for w in rest]))
        return _table(letters + rest + whole, np.concatenate(ids), [*size[0], *size[1], *[0] * len(whole)], len(whole))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the library gives them for the whole text."""
        return list(self.each(texts))

    def each(self, texts: list[str]) -> Iterator[bytes]:
        """The same one by one; some million characters are encoded at a time."""
        k = 0
        while k < len(texts):
            size, j = 0, k
            while j < len(texts) and size < _CHUNK:
                size, j = size + len(texts[j]), j + 1
            yield from self._encode(texts[k:j])
            k = j

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self.byte_level:  # a line feed opens a word of its own, and one is put before the text
            spaced = [("\n" + t).replace("\n", " \n") for t in texts]
        else:
            spaced = [" " + t.replace("\n", " ") for t in texts]
        ends = np.cumsum([t.count(" ") for t in spaced])  # every word has the space before it
        split = pc.split_pattern(pa.array(["".join(spaced)], pa.large_string()), " ")
        del spaced
        found = split.flatten()[1:].dictionary_encode()
        del split
        ids, size, whole = self._look_up(found.dictionary)
        place = found.indices.to_numpy()
        joined, starts = look_up(place, ids, size.cumsum() - size, size)
        data, bounds = joined.tobytes(), (4 * starts[np.append(0, ends)]).tolist()
        skip = 4 * self.byte_level
        out = [data[a + skip:b] for a, b in zip(bounds, bounds[1:])]
        odd = np.unique(np.searchsorted(ends, np.flatnonzero(whole[place]), "right")).tolist()
        ids, long = self._ids([texts[k] for k in odd])
        for k, x in zip(odd, np.split(ids, np.cumsum(long[:-1]).astype(int))):
            out[k] = x.tobytes()
        return out

    def _look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of different words one after another, how many each has, and whether texts with it are encoded whole."""
        letters = pc.utf8_rtrim(words, _MARKS)
        plain = _plain(letters)
        marks = pc.if_else(plain, pc.utf8_ltrim(words, "\n" + _LETTERS), "").dictionary_encode()
        cores = pc.if_else(plain, letters, words).dictionary_encode()
        at = pc.index_in(cores.dictionary, self.known[0])
        missing = cores.dictionary.filter(at.is_null())
        new = self._learn(set(_strings(missing)))
        marked = _strings(marks.dictionary)
        _, ids, size, whole = _joined([self.known, new, _table(marked, *self._ids(marked))])
        core = np.empty(len(at), np.int64)
        unknown = at.is_null().to_numpy(zero_copy_only=False)
        core[~unknown] = at.drop_null().to_numpy()
        core[unknown] = len(self.known[0]) + pc.index_in(missing, new[0]).to_numpy()
        core = core[cores.indices.to_numpy()]
        parts = np.stack([core, len(self.known[0]) + len(new[0]) + marks.indices.to_numpy()], axis=1).ravel()
        ids, starts = look_up(parts, ids, size.cumsum() - size, size)
        stays = max(0, self.room - len(self.known[0]))
        if stays and len(missing):
            n = int(new[2][:stays].sum())
            self.known = _joined([self.known, (new[0][:stays], new[1][:n], new[2][:stays], new[3][:stays])])
        return ids, np.diff(starts[::2]), whole[core]


def _table(words: list[str], ids: np.ndarray, size: list[int], whole: int = 0) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their ids one after another, how many each has, and whether texts with it are encoded whole (the last ``whole``)."""
    return pa.array(words, pa.large_string()), ids, np.array(size, np.int64), np.arange(len(words)) >= len(words) - whole


def _spelled(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(_SPELLED)


def _joined(tables: list[tuple]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    words, *rest = zip(*tables)
    return pa.concat_arrays(words), *map(np.concatenate, rest)


def _plain(words: pa.Array) -> pa.Array:
    return pc.match_substring_regex(words, f"^\n?[{_LETTERS}]+$")


def _strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()
