"""SentencePiece BPE with seeded merge-dropout.

Merges are taken from an agenda, best score first, one candidate a turn. A keyed hash of the seed, the document, its
copy, the word's place and the turn decides whether the candidate is skipped; a pair is proposed again only when a
neighbour merges. With dropout 0 the ids are the library's. Any segmentation decodes to the same text.

A piece holds spaces at its start only, so words are segmented one by one, each with the spaces before it. A word's
segmentation without a skip is remembered, and holds wherever none of its turns is skipped; elsewhere the word is
segmented with the skips of its place. Words of a batch are segmented together, those of one length as the rows of a
matrix that holds every row's agenda.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import batches, mix

#: Share of candidate merges that are skipped; words that a worker remembers.
DROPOUT, WORD_CACHE = 0.1, 500_000

SPACE = "▁"
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_M = (1 << 64) - 1

#: The rank of what is no piece; the longest word whose agenda is a plain list.
NEVER, SHORT = 1 << 30, 48

#: Words of one length that are worth a matrix, the longest of them, characters of texts that are encoded together.
ROWS, WIDEST, BATCH = 48, 24, 8 << 20

#: Turns in which a skip is looked for; a word with more merges is segmented each time.
TURNS = 64

#: Slots of the table of pairs, some twenty for each pair.
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS

_C1 = np.uint64(0x9E3779B97F4A7C15)


def _skipped(key: int, turn: int, limit: int) -> bool:
    h = (key + turn * 0x9E3779B97F4A7C15) & _M
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & _M
    h = (h ^ h >> 27) * 0x94D049BB133111EB & _M
    return (h ^ h >> 31) >> 32 < limit


def _skipped_all(keys: np.ndarray, turn: int, limit: int) -> np.ndarray:
    return mix(keys + np.uint64(turn * 0x9E3779B97F4A7C15 & _M)) >> np.uint64(32) < np.uint64(limit)


def _slot(pairs: np.ndarray) -> np.ndarray:
    return (pairs.view(np.uint64) * _C1 >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of stretches that start at ``starts``, one stretch after the other."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class Pieces:
    """A SentencePiece BPE model with byte fallback and an identity normalizer."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(n)]
        self.ids = {t: i for i, t in enumerate(self.texts) if not special[i]}
        #: Equal scores, as of pieces that the model forbids to part, are told by their ids.
        best = sorted(self.ids.items(), key=lambda x: (-model.get_score(x[1]), x[1]))
        self.ranks = {text: k for k, (text, _) in enumerate(best)}
        self.bytes = {int(self.texts[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = model.unk_id()
        #: A byte piece stands for its byte, control pieces for nothing.
        self.surface = [b"" if special[i] else t.replace(SPACE, " ").encode() for i, t in enumerate(self.texts)]
        for b, i in self.bytes.items():
            self.surface[i] = bytes([b])
        self.n = n
        #: Symbols: a piece is its id, any other character ``n`` and its code point. Pairs that make a piece, by value.
        self.symbols = np.arange(n, n + 0x110000, dtype=np.int64)
        for t, i in self.ids.items():
            if len(t) == 1:
                self.symbols[ord(t)] = i
        made = []
        for t, i in self.ids.items():
            for k in range(1, len(t)):
                x, y = self._symbol(t[:k]), self._symbol(t[k:])
                if x is not None and y is not None:
                    made.append((x << 21 | y, self.ranks[t], i))
        #: A table of pairs by hash: one that finds its slot taken stands in the next free one.
        self.slots, self.slot_ranks, self.slot_ids = np.full(SLOTS + len(made), -1, np.int64), np.full(SLOTS + len(made), NEVER, np.int32), np.zeros(SLOTS + len(made), np.int64)
        for slot, (pair, rank, i) in zip(_slot(np.array([m[0] for m in made], np.int64)).tolist(), made):
            while self.slots[slot] >= 0:
                slot += 1
            self.slots[slot], self.slot_ranks[slot], self.slot_ids[slot] = pair, rank, i

    def _symbol(self, text: str) -> int | None:
        return int(self.symbols[ord(text)]) if len(text) == 1 else self.ids.get(text)

    def _met(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each two symbols and the piece that they make."""
        key = x << 21 | y
        slot = _slot(key)
        held = self.slots[slot]
        apart = np.flatnonzero((held != key) & (held >= 0))
        while len(apart):
            slot[apart] += 1
            held = self.slots[slot[apart]]
            apart = apart[(held != key[apart]) & (held >= 0)]
        return np.where(self.slots[slot] == key, self.slot_ranks[slot], np.int32(NEVER)), self.slot_ids[slot]

    def segment_all(self, words: list[str], keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``segment`` of many words of one length: all ids in one array, how many each word has, and the merges done in it."""
        width, n = len(words[0]), len(words)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, width)
        symbol = self.symbols[points]
        # A word has a column more on each side, without a symbol. A place is the number of its cell in all the matrix.
        across = width + 2
        cells = np.full((n, across), -1, np.int64)
        cells[:, 1:-1] = symbol
        ranks, made = np.full((n, across), NEVER, np.int32), np.zeros((n, across), np.int64)
        ranks[:, 1:-2], made[:, 1:-2] = (m.reshape(n, width - 1) for m in self._met(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()))
        at, rank, piece = cells.ravel(), ranks.ravel(), made.ravel()
        after, before = np.arange(1, len(at) + 1), np.arange(-1, len(at) - 1)
        live, turn = np.arange(n), -1
        while len(live):
            turn += 1
            a = live * across + ranks[live].argmin(1)
            going = rank[a] != NEVER
            live, a = live[going], a[going]
            if limit:
                skip = _skipped_all(keys[live], turn, limit)
                rank[a[skip]] = NEVER
                a = a[~skip]
            b = after[a]
            c, z = after[b], before[a]
            at[a], at[b] = piece[a], -1
            rank[b] = NEVER
            after[a], before[c] = c, a
            left, right = np.concatenate([a, z]), np.concatenate([c, a])
            rank[left], piece[left] = self._met(at[left], at[right])
        held = cells >= 0
        counts = held.sum(1)
        return *self._spelled(cells[held], counts), width - counts

    def _spelled(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words' symbols: what is no piece becomes the pieces of its bytes."""
        odd = symbols >= self.n
        if odd.any():
            spelled = [[self.bytes.get(b, self.unknown) for b in chr(s - self.n).encode()] for s in symbols[odd].tolist()]
            times = np.ones(len(symbols), np.int64)
            times[odd] = [len(x) for x in spelled]
            counts = np.bincount(np.repeat(np.arange(len(counts)), counts), times, len(counts)).astype(np.int64)
            symbols, odd = np.repeat(symbols, times), np.repeat(odd, times)
            symbols[odd] = list(chain.from_iterable(spelled))
        return symbols.astype(np.int32), counts

    def segment(self, word: str, key: int = 0, limit: int = 0) -> list[int]:
        """Ids of one word; ``limit`` of 2^32 is the share of candidates that are skipped, ``key`` decides which."""
        symbols = self._long(word, key, limit) if len(word) > SHORT else self._short(word, key, limit)
        ids, out = self.ids, []
        for s in symbols:
            i = ids.get(s)
            if i is None:
                out += [self.bytes.get(b, self.unknown) for b in s.encode()]
            else:
                out.append(i)
        return out

    def _short(self, word: str, key: int, limit: int) -> list[str]:
        """The agenda as the list of neighbours' ranks: for a few characters the least is found faster than a heap is kept."""
        rank = self.ranks.get
        symbols, turn = list(word), -1
        agenda = [rank(x + y, NEVER) for x, y in zip(word, word[1:])]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            k = agenda.index(best)
            turn += 1
            if limit and _skipped(key, turn, limit):
                agenda[k] = NEVER
                continue
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del agenda[k]
            if k < len(agenda):
                agenda[k] = rank(symbols[k] + symbols[k + 1], NEVER)
            if k:
                agenda[k - 1] = rank(symbols[k - 1] + symbols[k], NEVER)
        return symbols

    def _long(self, word: str, key: int, limit: int) -> list[str]:
        rank = self.ranks.get
        symbols = list(word)
        n, turn = len(symbols), -1
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[int, int, int, str]] = []

        def propose(a: int, b: int) -> None:
            text = symbols[a] + symbols[b]
            if (r := rank(text, NEVER)) != NEVER:
                heapq.heappush(agenda, (r, a, b, text))

        for k in range(n - 1):
            propose(k, k + 1)
        while agenda:
            best, a, b, text = heapq.heappop(agenda)
            if right[a] != b or symbols[a] + symbols[b] != text:
                continue
            turn += 1
            if limit and _skipped(key, turn, limit):
                continue
            symbols[a], symbols[b] = text, ""
            r = right[a] = right[b]
            right[b] = -1
            if r >= 0:
                left[r] = a
                propose(a, r)
            if left[a] >= 0:
                propose(left[a], a)
        return [s for s in symbols if s]

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The UTF-8 text of a segmentation, without the space that stands before the first word."""
        return b"".join(map(self.surface.__getitem__, ids))[1:]

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Segmenter:
    """Whole texts by a model, a seed and a dropout."""

    def __init__(self, model: Pieces, dropout: float, seed: int) -> None:
        self.model, self.limit, self.seed = model, int(dropout * 2**32), seed
        self._forget()

    def _forget(self) -> None:
        #: Words by number; all their ids without a skip, where each word's start, how many they are, merges done.
        self.number: dict[str, int] = {}
        self.ids, self.starts, self.counts, self.merges = np.zeros(0, np.int32), *(np.zeros(0, np.int64) for _ in range(3))

    def words(self, text: str) -> list[str]:
        """The text's words with a space before the first, as the library adds it."""
        return _WORDS.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def _segmented(self, words: list[str], keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and of each word: where its ids start, how many they are, its merges or more."""
        counts, merges, starts = (np.zeros(len(words), np.int64) for _ in range(3))
        widths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(widths, kind="stable")
        parts, held = [np.zeros(0, np.int32)], 0
        for group in np.split(order, np.flatnonzero(np.diff(widths[order])) + 1) if words else ():
            some, width = [words[k] for k in group.tolist()], int(widths[group[0]])
            if width <= WIDEST and len(some) >= ROWS:
                ids, counts[group], merges[group] = self.model.segment_all(some, keys[group], limit)
            else:
                found = [self.model.segment(w, k, limit) for w, k in zip(some, keys[group].tolist())]
                ids, counts[group], merges[group] = np.array(list(chain.from_iterable(found)), np.int32), [len(x) for x in found], width - 1
            starts[group] = held + np.cumsum(counts[group]) - counts[group]
            parts.append(ids)
            held += len(ids)
        return np.concatenate(parts), starts, counts, merges

    def _keys(self, starts: np.ndarray, places: np.ndarray) -> np.ndarray:
        """What the skips of each word hang on: its text's key and its place there."""
        return mix(starts + places * _C1)

    def learn(self, words: list[str]) -> None:
        """Segments what is not remembered yet; a full memory starts anew."""
        met = set(words)
        new = list(met.difference(self.number))
        if len(self.number) + len(new) > WORD_CACHE and self.number:
            self._forget()
            new = list(met)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        ids, starts, counts, merges = self._segmented(new, np.zeros(len(new), np.uint64), 0)
        self.starts = np.concatenate([self.starts, starts + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])
        self.counts, self.merges = np.concatenate([self.counts, counts]), np.concatenate([self.merges, merges])

    def _skipping(self, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Places where a turn of the word's merges is skipped, and of the words with too many turns to tell here."""
        merges = self.merges[at]
        long = merges > TURNS
        found, live = [np.flatnonzero(long)], np.flatnonzero(~long)
        for turn in range(TURNS):
            live = live[merges[live] > turn]
            if not len(live):
                break
            hit = _skipped_all(keys[live], turn, self.limit)
            found.append(live[hit])
            live = live[~hit]
        return np.concatenate(found)

    def start(self, text: str | None, doc_id: int | None, copy: int = 0) -> int:
        """What the skips of a text hang on besides place and turn; the text tells rows apart that share an id."""
        return xxhash.xxh3_64_intdigest(f"{self.seed}:{doc_id}:{copy}:{text or ''}".encode("utf-8", "surrogatepass"))

    def encode_all(self, texts: list[str | None], doc_keys: list[int]) -> list[np.ndarray]:
        docs = [self.words(t or "") for t in texts]
        sizes = np.array([len(d) for d in docs], np.int64)
        words = list(chain.from_iterable(docs))
        self.learn(words)
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        ids, starts, counts, ends = self.ids, self.starts[at], self.counts[at], np.cumsum(sizes)
        if self.limit and words:
            places = (np.arange(len(words)) - np.repeat(ends - sizes, sizes)).astype(np.uint64)
            keys = self._keys(np.repeat(np.array(doc_keys, np.uint64), sizes), places)
            rows = self._skipping(at, keys)
            varied, first, counts[rows], _ = self._segmented([words[r] for r in rows.tolist()], keys[rows], self.limit)
            starts[rows] = first + len(ids)
            ids = np.concatenate([ids, varied])
        before = np.concatenate([[0], np.cumsum(counts)])
        return np.split(ids[_places(starts, counts)], before[ends[:-1]]) if texts else []

    def encode(self, text: str | None, doc_id: int | None, copy: int = 0) -> list[int]:
        return self.encode_all([text], [self.start(text, doc_id, copy)])[0].tolist()


def encoded(docs: DataFrame, path: str, dropout: float = DROPOUT, seed: int = 0, copy: Column | None = None) -> DataFrame:
    """``doc_id, copy, ids, n_words, n_chars, text_crc32, lossless`` of each row of ``docs(doc_id, text)``.

    ``lossless`` tells whether the ids decode to the text, ``text_crc32`` is of what they decode to. Reruns give the
    same ids: they depend on the id, the text, ``copy``, the seed and the dropout alone; rows that differ by ``copy``
    (a number of the row) are segmented on their own. A null or empty text has no ids and is lossless; the model's own
    space mark (U+2581) inside a text decodes as a space, and such a text is reported as not lossless. Repeated rows
    of one ``copy`` are alike; an empty table gives none; other columns are ignored.
    """
    schema = "doc_id long, copy long, ids array<int>, n_words long, n_chars long, text_crc32 long, lossless boolean"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        s = Segmenter(model, dropout, seed)
        for batch in rows:
            doc_ids, texts, copies = (c.to_pylist() for c in batch.columns)
            for i, j in batches(texts, BATCH):
                rest: list[list] = [[], [], [], []]
                found = s.encode_all(texts[i:j], list(map(s.start, texts[i:j], doc_ids[i:j], copies[i:j])))
                for text, ids in zip(texts[i:j], found):
                    text = text or ""
                    back = model.decode_bytes(ids.tolist())
                    for column, value in zip(rest, (text.count(" ") + 1 if text else 0, len(text), zlib.crc32(back), back == text.encode())):
                        column.append(value)
                columns = [pa.array(doc_ids[i:j], pa.int64()), pa.array(copies[i:j], pa.int64()), pa.array(found, pa.list_(pa.int32())), *(pa.array(c, t) for c, t in zip(rest, (pa.int64(), pa.int64(), pa.int64(), pa.bool_())))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "copy", "ids", "n_words", "n_chars", "text_crc32", "lossless"])

    return docs.select("doc_id", "text", (F.lit(0) if copy is None else copy).cast("long").alias("copy")).mapInArrow(run, schema)


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of ``rows(doc_id, ids)``; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            texts = [None if ids is None else model.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
