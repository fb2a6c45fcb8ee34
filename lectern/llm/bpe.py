"""Exact byte-level BPE by the tokenizers library, with each worker remembering the words it has met.

A byte-level pre-tokenizer never joins characters across a single space or newline that stands between two
characters that are no white space. A text may be cut there: a word with the space before it, a newline alone and
the first word of a line encode as they do inside the text. Words that a worker does not know are encoded many to a
call, joined at such boundaries, and told apart again by the byte lengths of their tokens.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words a worker remembers; those met later are encoded for each batch.
WORD_CACHE = 1_000_000

#: Unknown words encoded in one text, and such texts in one call.
JOINED, CALL = 256, 64

#: Bytes of a text that is encoded whole where its white space is irregular; longer ones are cut at safe places.
WHOLE = 65_536

#: White space at an end, twice in a row, or other than spaces and newlines.
_IRREGULAR = "^[ \n]|[ \n][ \n]|[ \n]\\z|[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_SAFE = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Token ids of texts, as little-endian unsigned 16-bit (32-bit for large vocabularies) bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in json.loads(self.tokenizer.to_str())["added_tokens"]]
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 65536 else "<u4")
        #: In the byte-level alphabet a character stands for a byte.
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.widths[i] = len(token)
        self.newline = self._plain(["\n"])[0]
        self.spaced: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {"": b""}
        self.new_first: list[str] = []
        self.new_spaced: list[str] = []

    def _plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _words(self, words: list[str], mark: str) -> dict[str, bytes]:
        """Each word's ids: with the space before it (mark is a space), or as the first of a line (a newline)."""
        odd = [w for w in words if any(s in w for s in self.special)]
        out = dict(zip(odd, self._plain([(mark if mark == " " else "") + w for w in odd])))
        words = [w for w in words if w not in out] if odd else words
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        step, skip = self.dtype.itemsize, int(mark != " ")
        for i in range(0, len(groups), CALL):
            some = groups[i : i + CALL]
            texts = [mark + mark.join(g) for g in some]
            for group, e in zip(some, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, self.dtype)
                ends = np.cumsum(self.widths[ids])
                sizes = np.fromiter((len(w.encode()) + 1 for w in group), np.int64, len(group))
                cuts = (np.searchsorted(ends, np.cumsum(sizes)) + 1) * step
                data, at = ids.tobytes(), 0
                for w, to in zip(group, cuts.tolist()):
                    out[w] = data[at + skip * step : to]
                    at = to
        return out

    def _odd(self, text: str) -> bytes:
        """A text with irregular white space: whole, or where long, cut before single spaces."""
        if len(text) <= WHOLE:
            return self._plain([text])[0]
        parts, at = [], 0
        for m in _SAFE.finditer(text):
            if m.start() - at >= WHOLE:
                parts.append(text[at : m.start()])
                at = m.start()
        return b"".join(self._plain([*parts, text[at:]]))

    def tokens(self, column: pa.Array, ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """How many tokens each text of a string column has, and all their ids in order if asked for; null counts as empty."""
        texts = pc.fill_null(column, "")
        regular = np.asarray(pc.invert(pc.match_substring_regex(texts, _IRREGULAR)))
        rows = np.flatnonzero(regular)
        counts = np.zeros(len(texts), np.int64)
        own, flat = self._regular(texts.take(pa.array(rows)), ids)
        counts[rows] = own
        if len(rows) == len(texts):
            return counts, flat
        odd = {k: np.frombuffer(self._odd(texts[k].as_py()), self.dtype) for k in np.flatnonzero(~regular).tolist()}
        for k, x in odd.items():
            counts[k] = len(x)
        if not ids:
            return counts, None
        out, ends, at = np.empty(counts.sum(), self.dtype), np.cumsum(counts), 0
        place = np.repeat(regular, counts)
        out[place] = flat
        for k, x in odd.items():
            out[ends[k] - counts[k] : ends[k]] = x
        return counts, out

    def _regular(self, texts: pa.Array, ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """``tokens`` of texts whose white space is single spaces and newlines between other characters.

        Arrow cuts lines into words and numbers the distinct ones; each distinct word is looked up once for each of
        its uses: after a space, at a text's start, or after a newline, which then belongs to it.
        """
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, self.dtype)
        lines = pc.split_pattern(texts, "\n")
        words = pc.split_pattern(lines.flatten(), " ")
        of_text, of_line = np.asarray(lines.offsets), np.asarray(words.offsets)
        of_text, of_line = of_text - of_text[0], of_line - of_line[0]
        numbered = words.flatten().dictionary_encode()
        codes, distinct = np.asarray(numbered.indices), numbered.dictionary.to_pylist()
        use = np.zeros(len(codes), np.int64)
        use[of_line[:-1]] = 2
        use[of_line[of_text[:-1]]] = 1
        # Slots: all distinct words after a space, then all at a text's start, then all after a newline.
        n = len(distinct)
        slot = use * n + codes
        seen = np.flatnonzero(np.bincount(slot, minlength=3 * n))
        cut = np.searchsorted(seen, [n, 2 * n])
        after_space, at_start, after_newline = (list(map(distinct.__getitem__, (x % max(n, 1)).tolist())) for x in np.split(seen, cut))
        self._learn(at_start + after_newline, after_space)
        found = list(map(self.spaced.__getitem__, after_space))
        found += map(self.first.__getitem__, at_start)
        found += map(self.newline.__add__, map(self.first.__getitem__, after_newline))
        self._forget()
        width = np.zeros(3 * n, np.int64)
        width[seen] = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        per_word = width[slot]
        ends = np.concatenate([[0], np.cumsum(per_word)])
        at = of_line[of_text]
        counts = ends[at[1:]] - ends[at[:-1]]
        if not ids:
            return counts, None
        start = np.zeros(3 * n, np.int64)
        start[seen] = np.cumsum(width[seen]) - width[seen]
        table = np.frombuffer(b"".join(found), self.dtype)
        place = np.repeat(start[slot] - ends[:-1], per_word)
        place += np.arange(len(place))
        return counts, table[place]

    def _learn(self, first: list[str], spaced: list[str]) -> None:
        self.new_first, self.new_spaced = list(set(first).difference(self.first)), list(filterfalse(self.spaced.__contains__, spaced))
        self.first.update(self._words(self.new_first, "\n"))
        self.spaced.update(self._words(self.new_spaced, " "))

    def _forget(self) -> None:
        """A full memory takes no more words; which words are in it changes no result."""
        for known, new in ((self.first, self.new_first), (self.spaced, self.new_spaced)):
            if len(known) > WORD_CACHE:
                for w in new:
                    del known[w]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        counts, flat = self.tokens(pa.array(texts, pa.string()))
        data, ends = flat.tobytes(), np.cumsum(counts) * self.dtype.itemsize
        return [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


def slices(column: pa.Array, limit: int) -> Iterator[pa.Array]:
    """Consecutive parts of a string column of about ``limit`` bytes each; a longer text stands alone."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64))
    at = 0
    while at < len(column):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield column.slice(at, to - at)
        at = to
