"""Token ids of whole texts by the tokenizers library, each distinct word of a task encoded once.

A text is cut before spaces, where no token of the given vocabularies can reach across; equal
pieces have equal ids wherever they stand. A piece that is one run of letters, or such a run and
one run of marks behind it, goes to the vocabulary's merges directly, word and marks apart, all others through the whole
tokenizer. Texts with white space before a space, where a cut could change ids, are encoded whole.
"""

from __future__ import annotations

import os
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words, marks and other pieces that one task remembers.
MEMORY = 200_000
_PLAIN = "^(?P<word>[A-Za-zªµºÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@[-`{-~]*)$"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts as flat arrays. ``spaced``: a leading space belongs to the token behind it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.lower = self.whole.normalizer is not None
        self.letters = _byte_letters()
        self._forget()

    def _forget(self) -> None:
        # numbers of words and marks, and of pieces that go through the whole tokenizer, in ``start`` and ``size``
        self.merged: dict[str, int] = {"": 0}
        self.other: dict[str, int] = {}
        self.ids, self.start, self.size = array("I"), array("q", [0]), array("q", [0])

    def _merges(self, parts: list[str]) -> tuple[list[int], list[int]]:
        """Ids of ``parts`` one behind the other, and their numbers."""
        tokens, letters, space = self.model.tokenize, self.letters, self.letters[32]
        ids: list[int] = []
        size = []
        for x in parts:
            found = tokens(x.replace(" ", space) if x.isascii() else x.encode().decode("latin-1").translate(letters))
            size.append(len(found))
            ids += [t.id for t in found]
        return ids, size

    def _encodings(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        found = [x.ids for x in self.whole.encode_batch(pieces, add_special_tokens=False)]
        return list(chain.from_iterable(found)), list(map(len, found))

    def _numbers(self, parts: pa.Array, known: dict[str, int], encode) -> np.ndarray:
        """Numbers of ``parts`` in ``known``, each new distinct one encoded first."""
        coded = parts.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        got = list(map(known.get, names))
        new = [i for i, number in enumerate(got) if number is None]
        if new:
            fresh = [names[i] for i in new]
            ids, size = encode(fresh)
            size = np.array(size, np.int64)
            start = len(self.ids) + np.cumsum(size) - size
            numbers = range(len(self.start), len(self.start) + len(new))
            known.update(zip(fresh, numbers))
            for i, number in zip(new, numbers):
                got[i] = number
            self.start.frombytes(start.tobytes())
            self.size.frombytes(size.tobytes())
            self.ids.frombytes(np.array(ids, np.uint32).tobytes())
        return np.array(got, np.int64)[np.asarray(coded.indices)]

    def _parts(self, pieces: pa.Array, space: int) -> np.ndarray:
        """Numbers of the two parts of each piece: its word and marks, or itself and nothing."""
        lead = " " if space and not self.lower else ""
        split = pc.extract_regex(pieces, _PLAIN)
        plain = np.asarray(split.is_valid(), bool)
        easy, odd = np.flatnonzero(plain), np.flatnonzero(~plain)
        word, marks = (pc.struct_field(split, i).take(pa.array(easy)) for i in (0, 1))
        if self.lower:
            word = pc.utf8_lower(word)
        elif lead:
            word = pc.binary_join_element_wise(pa.scalar("", word.type), word, pa.scalar(lead, word.type))
        out = np.zeros((len(pieces), 2), np.int64)
        out[easy, 0] = self._numbers(word, self.merged, self._merges)
        out[easy, 1] = self._numbers(marks, self.merged, self._merges)
        if len(odd):
            others = pieces.take(pa.array(odd))
            out[odd, 0] = self._numbers(pc.binary_join_element_wise(pa.scalar("", others.type), others, pa.scalar(lead, others.type)), self.other, self._encodings)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the offsets of the texts; a null text is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = np.asarray(pc.match_substring_regex(texts, r"[\s\x0B\x1C-\x1F\x{85}\pZ] |<\||^ "), bool)
        rows = np.flatnonzero(whole)
        easy = pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), texts)
        split = pc.split_pattern(easy, " ")
        counts = np.diff(np.asarray(split.offsets))
        flat = pc.list_flatten(split).dictionary_encode()
        codes = np.asarray(flat.indices).astype(np.int64)
        if len(self.start) >= MEMORY:
            self._forget()
        words = flat.dictionary
        if self.lower:
            numbers = self._parts(words, 1)[codes]
        else:
            # the first piece of a text has no space before it
            first = np.zeros(len(codes), bool)
            first[np.cumsum(counts) - counts] = True
            numbers = np.empty((len(codes), 2), np.int64)
            for space, mine in ((0, np.flatnonzero(first)), (1, np.flatnonzero(~first))):
                held = np.flatnonzero(np.bincount(codes[mine], minlength=len(words)))
                place = np.zeros(len(words), np.int64)
                place[held] = np.arange(len(held))
                numbers[mine] = self._parts(words.take(pa.array(held)), space)[place[codes[mine]]]
        numbers = numbers.ravel()
        start, size, table = np.frombuffer(self.start, np.int64), np.frombuffer(self.size, np.int64), np.frombuffer(self.ids, np.uint32)
        lengths = size[numbers]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(start[numbers] - ends[:-1], lengths) + np.arange(ends[-1])
        flat_ids = table[at]
        offsets = ends[2 * np.concatenate([[0], np.cumsum(counts)])]
        if not len(rows):
            return flat_ids, offsets
        hard = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch(texts.take(pa.array(rows)).to_pylist(), add_special_tokens=False)]
        parts, n = [], np.diff(offsets)
        done = 0
        for row, got in zip(rows.tolist(), hard):  # a row encoded whole has no ids in flat_ids but those of ""
            parts += [flat_ids[offsets[done]:offsets[row]], got]
            n[row] = len(got)
            done = row + 1
        parts.append(flat_ids[offsets[done]:])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(n)])


def appended(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end`` behind each text."""
    count = np.diff(offsets)
    out = np.full(len(ids) + len(count), end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(count)), count)] = ids
    return out, offsets + np.arange(len(offsets))
