"""An n-gram language model in Elias-Fano trie levels, and the log10 probability of whole texts under it.

The first level holds the words by their hash, with exact counts. A file of a longer level holds all contexts of a
range of numbers: each context's pointer to its first follower, and the followers' word ids, which are relative to
their context; both are monotone and Elias-Fano coded. A query takes its context by its number, and searches the
successor of its word among that context's followers only. Payloads are 16-bit log probabilities of followers and
16-bit shares that contexts leave to shorter n-grams. All levels are counted from one shuffle of windows of word ids.
Files lie in the shared folder; a worker opens one at a time, mapped into memory where the folder is a local path, and
keeps none of them.

Probabilities: words by adding one; longer n-grams by absolute discounting, with all mass that the stored n-grams
leave (also that of n-grams seen less than ``least`` times, which are not stored) given to the shorter one. A context
of two words and more occurs as often as it is counted itself.
"""

from __future__ import annotations

import math
import mmap
from collections.abc import Iterator
from functools import cached_property, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.bpe import slices
from lectern.llm.common import scratch, workroom

#: Unless asked for otherwise, words of an n-gram at most and times it must occur from two words on; what is taken off its count.
ORDER, LEAST, DISCOUNT = 3, 1, 0.75

#: Documents whose id's crc32 leaves this remainder are held out of training.
FOLDS, HELD_OUT = 7, 2

#: Tokens that a worker counts together, and scores together.
COUNT_TOKENS, SCORE_TOKENS = 1_000_000, 800_000

#: Bytes of texts that are split into words at a time.
SPLIT_BYTES = 1 << 20

#: Tokens of a range of pairs, whose windows a task holds at a time, and of a slice of words that ranges are made of.
RANGE_TOKENS, SLICE_TOKENS = 1 << 20, 1 << 16

#: Keys of a file, but for the followers of one context, which are never parted; words a worker remembers.
FILE_KEYS, PAIR_KEYS, WORD_CACHE = 2 << 20, 1 << 19, 150_000

#: Log probabilities are stored in steps over this range.
LOWEST, STEPS = -14.0, 65535

#: White space can't be in a word, so this is the end of a text.
END = b"\n"

_U = np.uint64


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 1


def quantised(p: np.ndarray) -> np.ndarray:
    return np.round(np.clip(np.log10(p) / LOWEST, 0, 1) * STEPS).astype("<u2")


_RESTORED = 10.0 ** (np.arange(STEPS + 1) * (LOWEST / STEPS))


def restored(q: np.ndarray) -> np.ndarray:
    return _RESTORED[q]


#: Where the k-th one of each byte is, at 256 k + byte.
_IN_BYTE = np.array([([b for b in range(8) if byte >> b & 1] + [0] * 8)[k] for k in range(8) for byte in range(256)], _U)
_EACH, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)


def nth_one(word: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The place of the nth one (from 0) of each word, which has that many: first its byte, by the ones up to each byte, then the place in it."""
    n = nth.astype(_U)
    ones = np.bitwise_count(np.ascontiguousarray(word).view(np.uint8)).view(_U) * _EACH
    byte = np.bitwise_count((n * _EACH | _TOPS) - ones & _TOPS).astype(_U) << _U(3)
    n -= ones << _U(8) >> byte & _U(255)
    return (byte + _IN_BYTE[n << _U(8) | word >> byte & _U(255)]).astype(np.int64)


class EliasFano:
    """A strictly rising sequence: the low bits of each value packed, the high parts in unary with a rank directory."""

    def __init__(self, n: int, first: int, width: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray) -> None:
        self.n, self.first, self.width, self.low, self.high, self.ranks = n, first, width, low, high, ranks

    @cached_property
    def zeros(self) -> np.ndarray:
        return (np.arange(len(self.ranks), dtype=np.int64) << 6) - self.ranks

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
        """first, width, low, high, ranks of a non-empty sorted array of distinct int64."""
        n, first = len(values), int(values[0])
        v = (values - first).astype(_U)
        width = max(0, (int(v[-1]) // n).bit_length() - 1)
        low = np.zeros(n * width // 64 + 2, "<u8")
        if width:
            bits = v & _U((1 << width) - 1)
            at = np.arange(n, dtype=_U) * _U(width)
            word, off = (at >> _U(6)).astype(np.int64), at & _U(63)
            np.bitwise_or.at(low, word, bits << off)
            over = off + _U(width) > _U(64)
            np.bitwise_or.at(low, word[over] + 1, bits[over] >> (_U(64) - off[over]))
        place = (v >> _U(width)) + np.arange(n, dtype=_U)
        high = np.zeros(int(place[-1]) // 64 + 2, "<u8")
        np.bitwise_or.at(high, (place >> _U(6)).astype(np.int64), _U(1) << (place & _U(63)))
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]).astype("<u4")
        return first, width, low, high, ranks

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), _U)
        at = i.astype(_U) * _U(self.width)
        word, off = (at >> _U(6)).astype(np.int64), at & _U(63)
        v = self.low[word] >> off
        v |= self.low[word + 1] << _U(1) << (_U(63) - off)
        return v & _U((1 << self.width) - 1)

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        """How many values have a high part below h: the h-th zero's place, less h."""
        k = np.searchsorted(self.zeros, h, "left") - 1
        k = np.clip(k, 0, len(self.high) - 1)
        place = nth_one(~self.high[k], np.maximum(h - self.zeros[k], 1) - 1)
        return np.where(h > 0, (k << 6) + place + 1 - h, 0)

    def _run(self, i: np.ndarray, h: np.ndarray, most: int) -> np.ndarray:
        """The end of the values from i on that have the high part h: they are ones up to the next zero, which most often is in the same word."""
        place = i + h
        k, off = place >> 6, place & 63
        gap = ~(self.high[np.minimum(k, len(self.high) - 1)] >> off.astype(_U))
        ones = np.bitwise_count((gap & (~gap + _U(1))) - _U(1)).astype(np.int64)
        end = i + ones
        over = np.flatnonzero((ones >= 64 - off) | (k >= len(self.high)))
        end[over] = np.maximum(i[over], self._bucket(np.minimum(h[over] + 1, most)))
        return np.minimum(end, self.n)

    def values(self) -> np.ndarray:
        """The whole sequence."""
        places = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))
        i = np.arange(self.n)
        return self.first + ((places - i) << self.width | self._low(i).astype(np.int64))

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values at some places: the place of the i-th one among the high bits, and the low bits."""
        k = np.clip(np.searchsorted(self.ranks, i, "right") - 1, 0, len(self.high) - 1)
        place = nth_one(self.high[k], i - self.ranks[k])
        return self.first + (((k << 6) + place - i) << self.width | self._low(i).astype(np.int64))

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the first value that is not below x, and whether it is x."""
        v = np.clip(x - self.first, 0, None)
        h, most = v >> self.width, len(self.high) * 64 - self.n - 1
        want = v.astype(_U) & _U((1 << self.width) - 1)
        i = np.where(h > most, self.n, self._bucket(np.minimum(h, most)))
        end = self._run(i, np.minimum(h, most), most)
        # Values of one high part are in order of their low bits.
        low, high = i, end.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            a, b = low[open_], high[open_]
            middle = (a + b) >> 1
            below = self._low(middle) < want[open_]
            a, b = np.where(below, middle + 1, a), np.where(below, b, middle)
            low[open_], high[open_] = a, b
            open_ = open_[a < b]
        same = np.flatnonzero((low < end) & (x >= self.first))
        hit = np.zeros(len(x), bool)
        hit[same] = self._low(low[same]) == want[same]
        return low, hit

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The index of the first value that is not below x; n where there is none."""
        return self.search(x)[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """The index of each value, -1 where it is not there."""
        i, hit = self.search(x)
        return np.where(hit, i, -1)


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _write(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """One file of arrays of 64-bit words; a task that runs again replaces it by the same bytes."""
    system, path = _filesystem(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/{name}.{xxhash.xxh64_hexdigest(np.random.default_rng().bytes(16))}"
    with system.open_output_stream(part) as out:
        for a in arrays:
            data = a.tobytes()
            out.write(data + b"\0" * (-len(data) % 8))
    system.move(part, f"{path}/{name}")


def _open(folder: str, name: str) -> np.ndarray:
    system, path = _filesystem(folder)
    if isinstance(system, fs.LocalFileSystem):
        with open(f"{path}/{name}", "rb") as f:
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)
    with system.open_input_stream(f"{path}/{name}") as f:
        return np.frombuffer(f.read(), np.uint8)


FILES = "level int, part int, n long, first long, last long, shapes array<long>"


def _packed(folder: str, name: str, sequences: list[np.ndarray], payloads: list[np.ndarray]) -> list[int]:
    """Writes monotone sequences and payloads as one file; what is needed to read it again: five numbers a sequence, then lengths."""
    arrays, shapes = [], []
    for v in sequences:
        first, width, low, high, ranks = EliasFano.encode(v)
        arrays += [low, high, ranks]
        shapes += [len(v), first, width, len(low), len(high)]
    _write(folder, name, [*arrays, *payloads])
    return [*shapes, *map(len, payloads)]


def _unpacked(folder: str, name: str, shapes: list[int], sequences: int, kinds: tuple[str, ...]) -> tuple[list[EliasFano], list[np.ndarray]]:
    data, at = _open(folder, name), 0

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        a = data[at : at + n * np.dtype(kind).itemsize].view(kind)
        at += -(-n * np.dtype(kind).itemsize // 8) * 8
        return a

    coded = []
    for k in range(sequences):
        n, first, width, low, high = shapes[5 * k : 5 * k + 5]
        coded.append(EliasFano(n, first, width, take("<u8", low), take("<u8", high), take("<u4", high + 1)))
    return coded, [take(kind, n) for kind, n in zip(kinds, shapes[5 * sequences :])]


class Level:
    """The files of a level, opened one by one as they are asked for; ``kinds`` are their payloads'."""

    def __init__(self, folder: str, level: int, files: tuple) -> None:
        self.folder, self.level = folder, level
        self.files = sorted(files, key=lambda f: f[3])
        self.lasts = np.array([f[4] for f in self.files], np.int64)
        self.base = np.concatenate([[0], np.cumsum([f[2] for f in self.files])]).astype(np.int64)
        self.n = int(self.base[-1])
        self.sequences, self.kinds = (1, ("<u4",)) if level == 1 else (2, ("<u2", "<u2"))

    def _opened(self, k: int) -> tuple[list[EliasFano], list[np.ndarray]]:
        f = self.files[k]
        return _unpacked(self.folder, f"{self.level}-{f[1]}", f[5], self.sequences, self.kinds)

    def _by_file(self, part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each file with the rows that ask for it."""
        part = part.astype(np.int32)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(len(self.files) + 1))
        for k in range(len(self.files)):
            if cuts[k] < cuts[k + 1]:
                yield k, order[cuts[k] : cuts[k + 1]]

    def counts(self, indexes: np.ndarray) -> np.ndarray:
        """How often what stands at each index occurs; 0 for -1."""
        out = np.zeros(len(indexes), np.float64)
        part = np.searchsorted(self.base, indexes, "right") - 1
        part[indexes < 0] = len(self.files)
        for k, rows in self._by_file(part):
            out[rows] = self._opened(k)[1][-1][indexes[rows] - self.base[k]]
        return out

    def words(self, keys: np.ndarray) -> np.ndarray:
        """Each word's index in the first level (-1: none)."""
        at = np.full(len(keys), -1, np.int64)
        for k, rows in self._by_file(np.searchsorted(self.lasts, keys, "left")):
            i = self._opened(k)[0][0].find(keys[rows])
            at[rows] = np.where(i >= 0, i + self.base[k], -1)
        return at

    def after(self, parent: np.ndarray, word: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word after its context: the n-gram's index (-1: none), its share of the context, and what the context leaves.

        Equal questions are asked once, in the order of the files, and each context is looked for once.
        """
        asked = np.flatnonzero(parent >= 0)
        keys, place = np.unique(parent[asked] * (span + 1) + word[asked] + 1, return_inverse=True)
        p, w = np.divmod(keys, span + 1)
        w -= 1
        new = changed([p])
        starts, group = np.append(np.flatnonzero(new), len(p)), np.cumsum(new) - 1
        own = p[starts[:-1]]
        found, share, left = np.full(len(p), -1, np.int64), np.zeros(len(p)), np.ones(len(p))
        cuts = np.searchsorted(np.searchsorted(self.lasts, own, "left"), np.arange(len(self.files) + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            (pointers, followers), (shares, rests) = self._opened(k)
            i = own[cuts[k] : cuts[k + 1]] - self.files[k][3]
            # Before the file's first context are those without followers, between two files.
            before = int(np.searchsorted(i, 0))
            rows, i = np.arange(starts[cuts[k] + before], starts[cuts[k + 1]]), i[before:]
            stops, of = pointers.at(i + 1) - i - 1, group[rows] - cuts[k] - before
            left[rows] = restored(rests[i])[of]
            known = w[rows] >= 0
            rows, of = rows[known], of[known]
            j, hit = followers.search(i[of] * span + w[rows])
            rows, of, j = rows[hit], of[hit], j[hit]
            # The context's followers stand from its pointer up to the next one's.
            inside = j < stops[of]
            rows, j = rows[inside], j[inside]
            found[rows], share[rows] = j + self.base[k], restored(shares[j])
        out = np.full(len(parent), -1, np.int64), np.zeros(len(parent)), np.ones(len(parent))
        for to, of in zip(out, (found, share, left)):
            to[asked] = of[place]
        return out


@lru_cache(maxsize=8)
def _level(folder: str, level: int, files: tuple) -> Level:
    return Level(folder, level, files)


class _Words(dict):
    """Ids of words in the first level, remembered up to a bound; -1 for words not in it."""

    def __init__(self, level: Level) -> None:
        self.level = level

    def ids(self, own: list[bytes]) -> np.ndarray:
        new = [w for w in own if w not in self]
        at = self.level.words(np.fromiter(map(word_hash, new), np.int64, len(new)))
        self.update(zip(new, at.tolist()))
        out = np.fromiter(map(self.__getitem__, own), np.int64, len(own))
        if len(self) > 2 * WORD_CACHE:
            for w in new:
                del self[w]
        return out


@lru_cache(maxsize=2)
def _words(folder: str, files: tuple) -> _Words:
    return _Words(_level(folder, 1, files))


class Model:
    """What workers need of a trie: where its files are, and its totals."""

    def __init__(self, folder: str, tokens: int, distinct: int, documents: int, order: int) -> None:
        self.folder, self.tokens, self.distinct, self.documents, self.order = folder, tokens, distinct, documents, order
        self.files: dict[int, tuple] = {}
        self.cuts: Cuts | None = None

    def words(self) -> _Words:
        return _words(self.folder, self.files[1])

    def level(self, k: int) -> Level:
        return _level(self.folder, k, self.files[k])

    def occurrences(self, parent: np.ndarray) -> np.ndarray:
        """How often each word occurs as a context; the start of a text is one."""
        n = self.level(1).counts(np.where(parent == self.distinct, -1, parent))
        return np.where(parent == self.distinct, max(self.documents, 1), n)

    @staticmethod
    def after(context: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """What stands at each token, moved on to the next one of its text."""
        out = np.concatenate([np.full(1, -1), context[:-1]])
        out[starts] = -1
        return out


class Texts(NamedTuple):
    """Texts as numbers of their distinct words: all tokens in one array, each text's end among them, and how many each text has."""

    doc_ids: list
    words: list[bytes]
    codes: np.ndarray
    sizes: np.ndarray


def _texts(rows: Iterator[pa.RecordBatch], most: int) -> Iterator[Texts]:
    """Rows ``doc_id, text``, about ``most`` tokens together. Arrow's white space is 0x20 and 0x09-0x0D, as a word's bounds are."""
    doc_ids: list = []
    split: list[pa.Array] = []
    sizes: list[np.ndarray] = []

    def held() -> Texts:
        coded = pa.chunked_array(split).dictionary_encode().combine_chunks()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        codes, n = coded.indices.to_numpy(), np.concatenate(sizes)
        own = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        if b"" in own:
            # White space at the start or end of a text leaves an empty piece there.
            full = codes != own.index(b"")
            stops = np.cumsum(n)
            before = np.append(0, np.cumsum(full))
            codes, n = codes[full], before[stops] - before[stops - n]
        out = Texts(doc_ids.copy(), [*own, END], np.insert(codes, np.cumsum(n), len(own)), n + 1)
        for c in (doc_ids, split, sizes):
            c.clear()
        return out

    size = 0
    for batch in rows:
        at = 0
        for some in slices(batch.column(1), SPLIT_BYTES):
            lists = pc.ascii_split_whitespace(pc.ascii_lower(some))
            doc_ids += batch.column(0).slice(at, len(some)).to_pylist()
            split.append(lists.flatten())
            sizes.append(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at += len(some)
            size += len(split[-1]) + len(some)
            if size >= most:
                yield held()
                size = 0
    if doc_ids:
        yield held()


def _emitted(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """``key, n``: each word's hash and count, the end's among them."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _texts(rows, COUNT_TOKENS):
            n = np.bincount(some.codes, minlength=len(some.words))
            # The empty piece is no word.
            yield _emitted(np.fromiter(map(word_hash, some.words), np.int64, len(n))[n > 0], n[n > 0])

    return docs.select("doc_id", "text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Cuts:
    """Ranges of pairs of words that hold about as many tokens each: words are cut where their counts add up, and pairs of a word that fills more than a range are cut by what the second words' counts add up to."""

    def __init__(self, slices: list[tuple[int, int]], distinct: int, documents: int, tokens: int) -> None:
        # The start of a text stands after all words.
        starts, sizes = zip(*slices, (distinct, documents))
        self.at, self.sizes = np.array(starts, np.int64), np.array(sizes, np.int64)
        self.before = np.cumsum(self.sizes) - self.sizes
        self.single = np.diff(self.at, append=distinct + 1) == 1
        self.tokens, self.size = max(tokens, 1), RANGE_TOKENS

    def ranges(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The range of each pair; they rise with the pairs."""
        i = np.searchsorted(self.at, first, "right") - 1
        j = np.searchsorted(self.at, second, "right") - 1
        part = np.where(self.single[i], self.sizes[i] * (self.before[j] / self.tokens), 0)
        return ((self.before[i] + part) / self.size).astype(np.int64)


class Windows:
    """Windows of ``order`` symbols as rows of few numbers, each holding as many symbols as fit; in their order, those of one start are together.

    Symbols are word ids, ``distinct`` for the start of a text and ``distinct + 1`` for what is after its end.
    """

    def __init__(self, order: int, distinct: int) -> None:
        self.order, self.none, self.span = order, distinct + 1, distinct + 2
        self.per = min(order, max(k for k in range(1, 63) if self.span**k < 1 << 63))
        self.columns = -(-order // self.per)

    def of(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """The symbols of the windows that start at each symbol of the texts but the last."""
        start, none = np.array([self.none - 1]), np.full(self.order, self.none)
        flat = np.concatenate([x for i in ids for x in (start, i, none)])
        # A text's windows start up to the symbol before its end.
        open_ = np.ones(len(flat), bool)
        stops = np.cumsum([len(i) + 1 + self.order for i in ids])
        for k in range(1, self.order + 2):
            open_[stops - k] = False
        at = np.flatnonzero(open_)
        return [flat[at + k] for k in range(self.order)]

    def packed(self, symbols: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for c in range(0, self.order, self.per):
            key = symbols[c].astype(np.int64)
            for s in symbols[c + 1 : c + self.per]:
                key = key * self.span + s
            out.append(key)
        return out

    def symbols(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for c, key in enumerate(rows):
            own = []
            for _ in range(min(self.per, self.order - c * self.per) - 1):
                key, s = np.divmod(key, self.span)
                own.append(s)
            out += [key, *own[::-1]]
        return out

    def counted(self, rows: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
        """The distinct rows in their order, and how often each is there."""
        if n is None and len(rows) == 1:
            rows = [np.sort(rows[0])]
        else:
            key = joined(rows)
            order = np.lexsort(rows[::-1]) if key is None else np.argsort(key)
            rows, n = [r[order] for r in rows], None if n is None else n[order]
        starts = np.flatnonzero(changed(rows))
        return [r[starts] for r in rows], np.diff(np.append(starts, len(rows[0]))) if n is None else np.add.reduceat(n, starts)


def joined(rows: list[np.ndarray]) -> np.ndarray | None:
    """One number for each row, in the rows' order; None where the columns' spans don't fit together."""
    spans = [(int(r.min()), int(r.max())) for r in rows]
    if math.prod(b - a + 1 for a, b in spans) >= 1 << 63:
        return None
    key = rows[0] - spans[0][0]
    for r, (a, b) in zip(rows[1:], spans[1:]):
        key = key * (b - a + 1) + (r - a)
    return key


def changed(rows: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the one before it; the first one does."""
    out = np.ones(len(rows[0]), bool)
    out[1:] = False
    for r in rows:
        out[1:] |= r[1:] != r[:-1]
    return out


def _planes(v: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the longest needs: the first bytes of all of them, then the second ones. Rising numbers are told by their steps, others by what they are above the least (a width below 0)."""
    steps = np.diff(v)
    first, sign = int(v[0]), 1
    if steps.min(initial=0) < 0:
        first, sign = int(v.min()), -1
        steps = v - first
    width = (int(steps.max(initial=0)).bit_length() + 7) // 8
    planes = np.ascontiguousarray(steps.astype("<i8").view(np.uint8).reshape(-1, 8).T[:width])
    return np.array([len(v), first, sign * width], "<i8").tobytes() + planes.tobytes()


def _from_planes(data: memoryview) -> list[np.ndarray]:
    """The sequences that stand one after the other."""
    out, at = [], 0
    while at < len(data):
        n, first, width = np.frombuffer(data[at : at + 24], "<i8").tolist()
        own, width = n if width < 0 else n - 1, abs(width)
        steps = np.zeros((own, 8), np.uint8)
        steps[:, :width] = np.frombuffer(data[at + 24 : at + 24 + width * own], np.uint8).reshape(width, own).T
        v = steps.view("<i8").ravel()
        out.append(v + first if own == n else np.cumsum(np.append(first, v)))
        at += 24 + width * own
    return out


def _sums(n: np.ndarray) -> bytes:
    """Counts, as what they add up to."""
    return _planes(np.cumsum(n))


def _from_sums(data: memoryview) -> np.ndarray:
    return np.diff(_from_planes(data)[0], prepend=0)


def _pressed(data: bytes) -> bytes:
    return np.array([len(data)], "<i8").tobytes() + pa.compress(data, "zstd", asbytes=True)


def _unpressed(data: memoryview) -> memoryview:
    return memoryview(pa.decompress(data[8:], int(np.frombuffer(data[:8], "<i8")[0]), "zstd"))


def windows(docs: DataFrame, model: Model) -> DataFrame:
    """``part, rows, n``: the distinct windows of about a million tokens of ``docs`` and their counts, by ranges of their first two symbols."""
    kind, cuts = Windows(model.order, model.distinct), model.cuts

    def told(ids: np.ndarray, some: Texts) -> tuple[list[np.ndarray], np.ndarray]:
        """The distinct windows in their order, as symbols, and their counts. They are sorted in the few words of these texts, which mostly makes a number of each."""
        own = np.unique(ids)
        small = Windows(model.order, len(own))
        codes = np.searchsorted(own, ids)[some.codes]
        rows, n = small.counted(small.packed(small.of(np.split(codes, np.cumsum(some.sizes)[:-1]))))
        all_ = np.concatenate([own, [model.distinct, model.distinct + 1]])
        return [all_[s] for s in small.symbols(rows)], n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _texts(batches, COUNT_TOKENS):
            symbols, n = told(model.words().ids(some.words), some)
            part = cuts.ranges(*symbols[:2])
            rows = kind.packed(symbols)
            del symbols
            starts = np.flatnonzero(changed([part]))
            stops = np.append(starts[1:], len(part))
            out = [[int(part[a]), _pressed(b"".join(_planes(r[a:b]) for r in rows)), _pressed(_sums(n[a:b]))] for a, b in zip(starts, stops)]
            for i in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 256]), (pa.int32(), pa.binary(), pa.binary()))], ["part", "rows", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "part int, rows binary, n binary")


def _by_part(rows: Iterator[pa.RecordBatch], add, ended) -> Iterator[pa.RecordBatch]:
    """Calls ``add`` with each row but its part, and yields what ``ended(part)`` gives once a part's rows have passed."""
    now = None
    for batch in rows:
        for i, part in enumerate(batch.column(0).to_pylist()):
            if part != now and now is not None:
                yield ended(now)
            now = part
            add(*(memoryview(c[i].as_buffer()) for c in batch.columns[1:]))
    if now is not None:
        yield ended(now)


def _ranged(counts: DataFrame, model: Model, by: Column, run) -> list:
    """The files that ``run`` writes of ``counts(key, n)`` dealt by ranges of ``by`` and sorted; one row a file comes back."""
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = counts.select("key", "n").repartitionByRange(n, by).sortWithinPartitions("key").select("key", "n", F.spark_partition_id().alias("part"))
    return sorted((r[0], r[1], r[2], r[3], r[4], tuple(r[5])) for r in ranged.mapInArrow(run, FILES).collect())


def _held(rows: Iterator[pa.RecordBatch], span: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sorted keys and counts in pieces of about a file, cut where ``key div span`` changes, each with its file's number."""
    keys, values, size, part = [], [], 0, 0
    for batch in rows:
        if not batch.num_rows:
            continue
        keys.append(batch.column(0).to_numpy())
        values.append(batch.column(1).to_numpy())
        size += batch.num_rows
        part = part or batch.column(2)[0].as_py() << 16
        if size >= FILE_KEYS:
            k, v = np.concatenate(keys), np.concatenate(values)
            cut = int(np.searchsorted(k, k[-1] // span * span))
            if cut:
                yield part, k[:cut], v[:cut]
                keys, values, size, part = [k[cut:]], [v[cut:]], len(k) - cut, part + 1
    if keys:
        yield part, np.concatenate(keys), np.concatenate(values)


_SCHEMA = pa.schema([("level", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("shapes", pa.list_(pa.int64()))])
_MADE = pa.schema([*_SCHEMA, ("keys", pa.binary()), ("counts", pa.binary())])


def write_words(counts: DataFrame, model: Model) -> None:
    """Writes the first level, and tells the model where words are cut into slices of about as many tokens."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, k, v in _held(rows, 1):
            shapes = _packed(model.folder, f"1-{part}", [k], [np.minimum(v, 2**32 - 1).astype("<u4")])
            # A word that fills a slice stands alone.
            step, full = np.cumsum(v) // SLICE_TOKENS, v >= SLICE_TOKENS
            cut = changed([step]) | full | np.append(False, full[:-1])
            at = np.flatnonzero(cut)
            slices = np.stack([at, np.add.reduceat(v, at)], 1).ravel().tolist()
            yield pa.RecordBatch.from_pylist([{"level": 1, "part": part, "n": len(k), "first": int(k[0]), "last": int(k[-1]), "shapes": [*shapes, *slices]}], _SCHEMA)

    files, slices, base = [], [], 0
    for f in sorted(_ranged(counts, model, F.col("key"), run), key=lambda f: f[3]):
        files.append((*f[:5], f[5][:6]))
        slices += [(base + i, n) for i, n in zip(f[5][6::2], f[5][7::2])]
        base += f[2]
    model.files[1] = tuple(files)
    model.cuts = Cuts(slices, model.distinct, model.documents, model.tokens)


def _level_file(model: Model, level: int, part: int, first: int, contexts: int, parent: np.ndarray, word: np.ndarray, n: np.ndarray, total) -> dict:
    """Writes n-grams in their order as a file: pointers of all contexts from ``first`` on, followers, their shares and the contexts' rests; ``total`` tells how often contexts occur."""
    at = parent - first
    sizes = np.bincount(at, minlength=contexts)
    times = np.maximum(total(np.arange(first, first + contexts)), 1)
    # A context without followers leaves all.
    rest = quantised(np.maximum(times - np.bincount(at, n - DISCOUNT, contexts), 1e-9) / times)
    share = quantised((n - DISCOUNT) / times[at])
    # Steps of one make pointers rise strictly.
    pointers = np.append(0, np.cumsum(sizes)) + np.arange(contexts + 1)
    shapes = _packed(model.folder, f"{level}-{part}", [pointers, at * (model.distinct + 1) + word], [share, rest])
    return {"level": level, "part": part, "n": len(parent), "first": first, "last": first + contexts - 1, "shapes": shapes}


def _ngrams(found: DataFrame, model: Model, least: int) -> DataFrame:
    """The files of three words and more of each range of windows, and a row of level 2 with its pairs and their counts.

    A range holds all windows that start with its pairs, so contexts of two words and more are whole in it; their
    numbers are those within the range.
    """
    kind = Windows(model.order, model.distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[np.ndarray], np.ndarray]] = []
        size = 0

        def merged() -> None:
            nonlocal held, size
            if len(held) > 1:
                rows, n = [np.concatenate(c) for c in zip(*(h[0] for h in held))], np.concatenate([h[1] for h in held])
                held.clear()
                held.append(kind.counted(rows, n))
            size = 0

        def add(rows, n) -> None:
            nonlocal size
            held.append((_from_planes(_unpressed(rows)), _from_sums(_unpressed(n))))
            size += len(held[-1][1])
            if size >= FILE_KEYS:
                merged()

        def ended(part: int) -> pa.RecordBatch:
            merged()
            rows, n = held.pop()
            s = kind.symbols(rows)
            out = []
            new = changed(s[:2])
            starts, index, times = np.flatnonzero(new), None, None
            for level in range(2, model.order + 1):
                if level > 2:
                    new = new | changed(s[level - 1 : level])
                    starts = np.flatnonzero(new)
                    # What is after the end is no word.
                    whole = s[level - 1][starts] != kind.none
                else:
                    whole = np.ones(len(starts), bool)
                c = np.add.reduceat(n, starts)
                stays = whole & (c >= least)
                kept, c = starts[stays], c[stays]
                if level == 2:
                    keys = s[0][kept] * (model.distinct + 1) + s[1][kept]
                    ends = [int(s[0][kept[i]]) for i in (0, -1)] if len(kept) else [-1, -1]
                    out.append({"level": 2, "part": part, "n": len(kept), "first": ends[0], "last": ends[1], "shapes": [], "keys": _pressed(_planes(keys)) if len(kept) else b"", "counts": _pressed(_sums(c)) if len(kept) else b""})
                elif len(kept):
                    out.append(_level_file(model, level, part, 0, len(times), index[kept], s[level - 1][kept], c, times.__getitem__))
                # The number of the n-gram that a window starts with; of those that are not stored none has a follower that is.
                mark = np.zeros(len(n), np.int64)
                mark[kept] = 1
                index, times = np.cumsum(mark) - 1, c
            return pa.RecordBatch.from_pylist(out, _MADE)

        yield from _by_part(batches, add, ended)

    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, FILES + ", keys binary, counts binary")


def _pairs(made: DataFrame, model: Model, groups: list[tuple[int, int]]) -> list:
    """The files of pairs: ranges in groups, so that the followers of a word are never parted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def ended(part: int) -> pa.RecordBatch:
            keys, n = (np.concatenate(c) for c in zip(*held))
            held.clear()
            parent, word = np.divmod(keys, model.distinct + 1)
            return pa.RecordBatch.from_pylist([_level_file(model, 2, part, int(parent[0]), int(parent[-1] - parent[0]) + 1, parent, word, n, model.occurrences)], _SCHEMA)

        yield from _by_part(batches, lambda keys, n: held.append((_from_planes(_unpressed(keys))[0], _from_sums(_unpressed(n)))), ended)

    spark = made.sparkSession
    of = spark.createDataFrame(groups, "part int, file int")  # one row a range
    rows = made.where("level = 2 AND n > 0").join(F.broadcast(of), "part").select("file", "part", "keys", "counts")
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file").sortWithinPartitions("file", "part").select("file", "keys", "counts")
    return sorted((r[0], r[1], r[2], r[3], r[4], tuple(r[5])) for r in rows.mapInArrow(run, FILES).collect())


def write_levels(docs: DataFrame, model: Model, least: int, keep) -> None:
    """Counts the windows of ``docs`` once, and writes all levels from two words on."""
    made = keep(_ngrams(windows(docs, model), model, least))
    told = sorted(made.select(*_SCHEMA.names).collect(), key=lambda r: (r.level, r.part))  # one row a file
    groups, size, last = [], PAIR_KEYS, -1
    for r in told:
        if r.level == 2 and r.n:
            if size + r.n > PAIR_KEYS and r.first != last:
                groups.append((r.part, r.part))
                size = 0
            else:
                groups.append((r.part, groups[-1][1]))
            size, last = size + r.n, r.last
    model.files[2] = tuple(_pairs(made, model, groups)) if groups else ()
    for level in range(3, model.order + 1):
        # Contexts are numbered within their range: the n-grams of the ranges before it come first.
        base, n = {}, 0
        for r in told:
            if r.level == level - 1:
                base[r.part] = n
                n += r.n
        files = [r for r in told if r.level == level]
        model.files[level] = tuple((level, r.part, r.n, r.first + (b := base[r.part]), r.last + b, tuple(r.shapes)) for r in files)


def train(docs: DataFrame, order: int = ORDER, least: int = LEAST) -> Model:
    """The model of all rows of ``docs(doc_id, text)``: n-grams of up to ``order`` words, from two words on those met ``least`` times.

    Null and empty texts are an end alone; repeated rows count each; an empty table gives a model that knows no word;
    other columns are ignored.
    """
    folder = scratch(docs.sparkSession)
    with workroom(docs.sparkSession) as keep:
        counts = keep(word_counts(docs))
        tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        model = Model(folder, tokens, distinct, docs.count(), order)
        write_words(counts, model)
    if order > 1:
        with workroom(docs.sparkSession) as keep:
            write_levels(docs, model, least, keep)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of each row of ``docs(doc_id, text)``.

    Scores are sums of log10 over a text's words and its end. A null or empty text has the end alone. Repeated rows
    are alike; an empty table gives none; other columns are ignored. A model of no text gives every token 1.
    """
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    bottom = model.tokens + model.distinct + 1

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _texts(rows, SCORE_TOKENS):
            own = model.words().ids(some.words)
            n = model.level(1).counts(own)
            w = own[some.codes]
            starts = np.cumsum(some.sizes) - some.sizes
            # The start of a text is the context V, in all levels: a text's first tokens have a shorter context.
            context = np.concatenate([[model.distinct], w[:-1]])
            context[starts] = model.distinct
            p = (n + 1) / bottom
            base, p, c = np.log10(p)[some.codes], p[some.codes], n[some.codes]
            for k in range(2, model.order + 1):
                at, share, left = model.level(k).after(context, w, model.distinct + 1)
                p = p * left + share
                context = model.after(at, starts)
            sums = [np.add.reduceat(x, starts) for x in (base, np.log10(p), (c > 0).astype(np.int64))]
            k = len(starts)
            yield pa.RecordBatch.from_arrays([pa.array(some.doc_ids, pa.int64()), pa.array(some.sizes), pa.array(sums[2]), pa.array(np.full(k, model.tokens)), pa.array(sums[0]), pa.array(sums[1])], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def scores(docs: DataFrame, order: int = ORDER, least: int = LEAST) -> DataFrame:
    """All rows scored by a model of those that are not held out, with ``held_out``."""
    model = train(docs.where(~held_out()), order, least)
    return scored(docs, model).withColumn("held_out", held_out())
