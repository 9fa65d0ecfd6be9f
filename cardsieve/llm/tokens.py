"""Token ids of whole texts by a public vocabulary file, for the operators that need them."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cardsieve.llm.common import by_value, worker_memory

by_value(__name__)

END_ID = 0
# Pieces of text with known ids that one worker keeps; beyond that it starts over. This
# bounds memory only.
REMEMBERED_PIECES = 1_200_000
# Texts in which a cut before a space could fall inside a token: two white spaces side by
# side, or white space other than space and line feed.
_ODD_SPACE = (
    r"  | \n|\n |[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# Runs of letters, with or without the space before them. They are one unit of the
# pre-tokenizer, to which the merges alone apply.
_LETTERS = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+$"
_MARKS = np.zeros(256, bool)
_MARKS[[b for b in range(33, 127) if not chr(b).isalnum() and b != ord("'")]] = True
_ASCII_LETTERS = np.zeros(256, bool)
_ASCII_LETTERS[[b for b in range(128) if chr(b).isalpha()]] = True
# First bytes of two-byte letters, of which two code points are signs.
_LEADS = np.zeros(256, bool)
_LEADS[0xC3:0xC9] = True


def _byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level BPE writes each byte but the line feed."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(256 + i) for i, b in enumerate(others) if b != 10}


def _cuts(raw: np.ndarray) -> np.ndarray:
    """Where no token of byte-level BPE can reach across, as a flag for each byte that
    begins a unit: before a space or a run of line feeds, behind a single line feed, and
    between letters and marks. Quotes that may begin a contraction are no marks here."""
    begins = raw == 32
    if len(raw) < 3:
        return begins
    # Letters of two bytes, seen from their first byte and from their last.
    two = _LEADS[raw[:-1]] & ~((raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)))
    first = _ASCII_LETTERS[raw]
    last = first.copy()
    first[:-1] |= two
    last[1:] |= two
    mark = _MARKS[raw]
    begins[1:] |= (last[:-1] & mark[1:]) | (mark[:-1] & first[1:])
    feed = raw == 10
    begins[1:] |= feed[1:] & ~feed[:-1]
    begins[2:] |= feed[1:-1] & ~feed[2:] & ~feed[:-2]
    return begins


class Encoder:
    """Ids of texts, equal to those of `Tokenizer.encode(text, add_special_tokens=False)`.

    Texts are cut into units where no token of byte-level BPE spans the cut. Each different
    unit is encoded once and remembered by its number; ids of texts are put together by
    numpy. Texts with other white space or with the name of a special token are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([_ODD_SPACE, *[rf"\Q{name}\E" for name in names]])
        self.merges = self.tokenizer.model
        self.byte_letters = _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.begins = np.zeros(1, np.int64)

    def _letters(self, units: list[str]) -> list[str]:
        """Units as byte-level BPE writes their bytes."""
        text = "\n".join(units)
        if text.isascii():
            return text.replace(" ", self.byte_letters[32]).split("\n")
        return text.encode().decode("latin-1").translate(self.byte_letters).split("\n")

    def _learn(self, units: pa.Array) -> None:
        """Encode new units and number them on."""
        plain = pc.match_substring_regex(units, _LETTERS)
        simple = pc.string_is_ascii(units)
        flat, sizes, base = [], [], len(self.known)
        order = []
        merge = self.merges.tokenize
        for ascii_only in (True, False):
            some = units.filter(pc.and_(plain, simple if ascii_only else pc.invert(simple))).to_pylist()
            for letters in self._letters(some) if some else ():
                found = [token.id for token in merge(letters)]
                flat += found
                sizes.append(len(found))
            order += some
        others = units.filter(pc.invert(plain)).to_pylist()
        for encoding in self.tokenizer.encode_batch_fast(others, add_special_tokens=False):
            found = encoding.ids
            flat += found
            sizes.append(len(found))
        order += others
        self.known.update(zip(order, range(base, base + len(order))))
        self.ids = np.concatenate([self.ids, np.array(flat, np.uint32)])
        ends = self.begins[-1] + np.cumsum(np.array(sizes, np.int64))
        self.begins = np.concatenate([self.begins, ends])

    def _numbers(self, units: pa.Array) -> np.ndarray:
        """The numbers of different units."""
        if len(self.known) + len(units) > REMEMBERED_PIECES:
            self._forget()
        names, get = units.to_pylist(), self.known.get
        found = np.fromiter((get(name, -1) for name in names), np.int64, len(names))
        new = np.flatnonzero(found < 0)
        if len(new):
            self._learn(units.take(pa.array(new)))
            found[new] = [self.known[names[i]] for i in new]
        return found

    def _encode_plain(self, texts: pa.LargeStringArray) -> list[np.ndarray]:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        first, size = int(offsets[0]), int(offsets[-1] - offsets[0])
        if not size:
            return [np.zeros(0, np.uint32)] * len(texts)
        offsets = offsets - first
        data = texts.buffers()[2].slice(first, size)
        begins = _cuts(np.frombuffer(data, np.uint8))
        begins[offsets[:-1][offsets[:-1] < size]] = True
        at = np.flatnonzero(begins)
        units = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, size)), data]
        )
        units = units.cast(pa.large_string(), safe=False).dictionary_encode()
        numbers = self._numbers(units.dictionary)
        which = numbers[units.indices.to_numpy()]
        sizes = self.begins[which + 1] - self.begins[which]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.begins[which] - (ends - sizes), sizes)
        out = self.ids[shift + np.arange(len(shift))]
        # Units before each text, and the ids of those.
        before = np.searchsorted(at, offsets[1:-1])
        return np.split(out, np.concatenate([[0], ends])[before])

    def encode_all(self, texts: pa.LargeStringArray) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit numbers, with the end id behind them."""
        if not len(texts):
            return []
        odd = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        if not odd.all():
            plain = self._encode_plain(texts.filter(pa.array(~odd)))
            for i, ids in zip(np.flatnonzero(~odd), plain):
                out[i] = np.append(ids, np.uint32(END_ID))
        for i in np.flatnonzero(odd):
            ids = self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids
            out[i] = np.array([*ids, END_ID], np.uint32)
        return out


def encoder(path: str) -> Encoder:
    return worker_memory(f"encoder {path}", lambda: Encoder(path))
