"""Elias-Fano sequences and the n-gram trie made of them, for large batches of queries.

Everything is kept in flat buffers, so a whole trie is one run of bytes that can be written,
sent, or opened in place from any memory map. Queries are answered in sorted order: a few
thousand entries are unpacked at a time, the rest stays as it is.
"""

import mmap
from dataclasses import dataclass

import numpy as np

from cardsieve.llm.common import by_value

by_value(__name__)

# Entries that are unpacked at one time.
SLICE = 1 << 14
ABSENT = 255


@dataclass
class EliasFano:
    """A sequence that never falls: low bits as plain numbers, high bits in unary.

    `starts` has the place among the high bits of each slice's first entry.
    """

    n: int
    bits: int
    low: np.ndarray
    high: np.ndarray
    starts: np.ndarray

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        n = len(values)
        values = values.astype(np.uint64)
        universe = int(values[-1]) + 1 if n else 1
        bits = max((universe // max(n, 1)).bit_length() - 1, 0)
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if bits <= 8 * np.dtype(k).itemsize)
        low = (values & np.uint64((1 << bits) - 1)).astype(kind)
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        flags[places] = 1
        return cls(n, bits, low, np.packbits(flags, bitorder="little"), places[::SLICE].copy())

    def _slice(self, number: int) -> np.ndarray:
        """The values of one slice."""
        first = number * SLICE
        size = min(SLICE, self.n - first)
        begin = int(self.starts[number])
        last = int(self.starts[number + 1]) if number + 1 < len(self.starts) else 8 * len(self.high)
        unpacked = np.unpackbits(self.high[begin // 8 : -(-last // 8)], bitorder="little")
        ones = np.flatnonzero(unpacked[begin % 8 :])[:size]
        tops = (begin - first + ones - np.arange(size)).astype(np.uint64)
        return (tops << np.uint64(self.bits)) | self.low[first : first + size]

    def get(self, index: np.ndarray) -> np.ndarray:
        """The values at some places, which are in ascending order."""
        out = np.empty(len(index), np.uint64)
        cuts = np.searchsorted(index, np.arange(len(self.starts) + 1) * SLICE)
        for number in np.flatnonzero(np.diff(cuts)):
            b, e = cuts[number], cuts[number + 1]
            out[b:e] = self._slice(number)[index[b:e] - number * SLICE]
        return out

    def successor(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ascending queries: the first place whose value is not below, and if it is equal."""
        place, equal = np.full(len(wanted), self.n, np.int64), np.zeros(len(wanted), bool)
        heads = (self.starts - np.arange(len(self.starts)) * SLICE).astype(np.uint64) << np.uint64(self.bits)
        heads |= self.low[::SLICE]
        # A slice answers all up to the head of the next one, which counts as its last value.
        cuts = np.append(np.searchsorted(wanted, heads[1:], "right"), len(wanted)) if self.n else []
        begin = 0
        for number, end in enumerate(cuts):
            if end > begin:
                values = np.append(self._slice(number), heads[number + 1 : number + 2])
                found = np.searchsorted(values, wanted[begin:end])
                place[begin:end] = found + number * SLICE
                inside = found < len(values)
                equal[begin:end][inside] = values[found[inside]] == wanted[begin:end][inside]
            begin = end
        return place, equal

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits], np.int64), self.low, self.high, self.starts]

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> "EliasFano":
        return cls(int(parts[0][0]), int(parts[0][1]), *parts[1:])


def numbers(words: np.ndarray, among: EliasFano) -> np.ndarray:
    """Numbers of ascending hashes, -1 where there is none."""
    place, equal = among.successor(words)
    return np.where(equal, place, -1)


class Level:
    """Successors of each context: pointers, and word numbers on top of the context before.

    Pointers say where a context's successors begin. A successor is kept as its word number
    plus the greatest value of the contexts before, so the level is one sequence that rises;
    a query adds that value of its own context and searches for a successor there.
    """

    def __init__(self, pointers: EliasFano, values: EliasFano):
        self.pointers, self.values = pointers, values

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, contexts: int) -> "Level":
        """Entries that are sorted by context and word number, none twice."""
        ends = np.cumsum(np.bincount(context, minlength=contexts))
        last = np.flatnonzero(np.diff(context, append=-1))
        greatest = np.cumsum(word[last] + 1)
        before = np.repeat(np.append(0, greatest)[: len(last)], np.diff(last, prepend=-1))
        return cls(EliasFano.build(np.append(0, ends)), EliasFano.build(word + 1 + before))

    def places(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of ascending (context, word number) queries, -1 where there is no entry."""
        heads = np.flatnonzero(np.diff(context, prepend=-1))
        runs = np.diff(np.append(heads, len(context)))
        begin = self.pointers.get(context[heads]).astype(np.int64)
        end = self.pointers.get(context[heads] + 1).astype(np.int64)
        before = np.zeros(len(heads), np.uint64)
        later = begin > 0
        before[later] = self.values.get(begin[later] - 1)
        wanted = np.repeat(before + np.uint64(1), runs) + word.astype(np.uint64)
        # A word number above all of its context's would be searched in the next context, and
        # might come after that one's first queries; it is put back to its own context's end.
        limit = np.zeros(len(heads), np.uint64)
        full = end > begin
        limit[full] = self.values.get(end[full] - 1)
        limit = np.repeat(limit, runs)
        place, equal = self.values.successor(np.maximum.accumulate(np.minimum(wanted, limit)))
        return np.where(equal & (wanted <= limit), place, -1)


class Trie:
    """Words, their successors, and the successors of those pairs, with codes for each.

    `roots` and `words` are hashes: those that begin an entry, and those that follow in one.
    `weights` are codes of what a root or a pair leaves to the next lower order.
    """

    def __init__(self, parts: list[np.ndarray]):
        self.roots, self.words, *levels = (EliasFano.of(parts[i : i + 4]) for i in range(0, 24, 4))
        self.pairs, self.triples = Level(*levels[:2]), Level(*levels[2:])
        self.root_weights, self.pair_codes, self.pair_weights, self.triple_codes = parts[24:]

    @classmethod
    def build(cls, roots, words, pairs, triples, codes) -> "Trie":
        """`pairs`: (root number, word number); `triples`: (pair number, word number), all
        sorted; `codes`: those of root weights, pairs, pair weights and triples."""
        two = Level.build(*pairs, len(roots))
        three = Level.build(*triples, len(pairs[0]))
        sequences = [EliasFano.build(roots), EliasFano.build(words), two.pointers, two.values]
        sequences += [three.pointers, three.values]
        return cls([part for s in sequences for part in s.parts()] + list(codes))

    def parts(self) -> list[np.ndarray]:
        sequences = [self.roots, self.words, self.pairs.pointers, self.pairs.values]
        sequences += [self.triples.pointers, self.triples.values]
        codes = [self.root_weights, self.pair_codes, self.pair_weights, self.triple_codes]
        return [part for s in sequences for part in s.parts()] + codes

    def mapped(self) -> "Trie":
        """The same trie in one memory map without a file; it goes when the trie does."""
        flat = self.parts()
        room = mmap.mmap(-1, sum(-(-p.nbytes // 8) * 8 for p in flat) + 8 * 3 * len(flat) + 8)
        write_parts(flat, room)
        return Trie(read_parts(room))


def write_parts(parts: list[np.ndarray], to) -> None:
    """Kind, size and bytes of each array, in steps of 8 bytes; a kind is its NumPy letter."""
    to.write(np.int64(len(parts)).tobytes())
    for part in parts:
        kind = part.dtype.newbyteorder("<").str.encode().ljust(8)
        to.write(kind + np.array([part.size, part.nbytes], np.int64).tobytes())
        to.write(part.tobytes() + bytes(-part.nbytes % 8))


def read_parts(buffer) -> list[np.ndarray]:
    """The arrays as views of a buffer, such as a memory map; nothing is copied."""
    view, at, out = memoryview(buffer), 8, []
    for _ in range(int.from_bytes(view[:8], "little")):
        kind = np.dtype(bytes(view[at : at + 8]).decode().strip())
        size, n = np.frombuffer(view, np.int64, 2, at + 8)
        out.append(np.frombuffer(view, kind, int(size), at + 24))
        at += 24 + -(-int(n) // 8) * 8
    return out
