"""Token ids of whole texts by the tokenizers library, with each distinct piece of text between spaces encoded once for a worker.

Encoder takes a text at a time, ColumnEncoder many at a time as flat bytes.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.llm.shared import steps

#: Distinct pieces that a worker remembers, about 170 bytes each; when there are more, it forgets them all and begins again.
REMEMBERED = 1_000_000
# White space and controls that the two splits below and the library's patterns may see differently.
ODD = re.compile("[\x00\x0b\x0c\x1c-\x1f\x85\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]")
#: Letters before this are Latin, composed and with simple lower cases.
LATIN_END = "\u0250"
# The signs that byte-level vocabularies write for bytes: a printable Latin-1 character for itself, the others from U+0100 on in order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_SIGNS = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
BYTE_PIECES = re.compile(r"\n| ?[^ \n]+")
#: Words on which a tokenizer's own result is compared with that of its merges alone, before letters go to them directly.
PROBES = ("the", "straße", "naïveté", "internationalisation", "zxqv", "łódź")
#: Pieces on which the result for all of them, with line feeds between, is compared with that for each.
JOINED_PROBES = ("The", " straße", ".", " naïveté.", " 12,5", "'s", " don't", " --", " łódź!", "x_1", ")", " 世界", " 🙂", "…")
#: Text bytes that ColumnEncoder cuts at a time; new pieces that go to the library in one text.
COLUMN_BYTES, JOINED_PIECES = 1 << 22, 4096
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


@lru_cache(4)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_padding()
    found.no_truncation()
    return found


class Encoder(dict):
    """Encodes texts to arrays of unsigned 32-bit ids, equal to those of Tokenizer.encode(text, add_special_tokens=False).

    by_words: the tokenizer drops white space and no token holds any, so white space can be cut anywhere; otherwise a token can
    begin with one space, as byte-level ones do, and only single spaces and line feeds between other characters are cut. Texts
    with other white space, or with the mark of a special token, go to the library whole. As a dict it holds the ids of pieces.
    """

    def __init__(self, path: str, by_words: bool, remembered: int = REMEMBERED):
        self.tokenizer, self.by_words, self.remembered = tokenizer(path), by_words, remembered
        marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = re.compile("|".join(map(re.escape, marks))) if marks else re.compile(r"(?!)")
        # The two ways past the patterns below hold for pre-tokenizers that keep runs of letters whole; others go without.
        self.plain = all(self.tokenizer.encode(w, add_special_tokens=False).ids == self._merged(w) for w in PROBES)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.remembered:
            self.clear()
        word = piece[1:] if piece[0] == " " else piece
        if len(word) > 1 and word[-1] in ".," and self.plain and self._letters(word[:-1]):  # a sign after letters, before white space, is a token of its own
            found = self[piece[:-1]] + self[piece[-1]]
        elif self.plain and (lower := self._letters(word)):  # letters alone go to the merges without the patterns
            found = array("I", self._merged(lower if self.by_words else piece)).tobytes()
        else:
            found = self._whole(piece)
        self[piece] = found
        return found

    def _merged(self, piece: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(BYTE_SIGNS))]

    @staticmethod
    def _letters(word: str) -> str:
        """The lower case of a word of Latin letters that stay letters, one for one, in lower case (U+0130 does not); else nothing."""
        if not word.isalpha() or not (word.isascii() or max(word) < LATIN_END):
            return ""
        lower = word.lower()
        return lower if lower.isalpha() and len(lower) == len(word) else ""

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if ODD.search(text) or self.mark.search(text):
            return self._whole(text)
        if self.by_words:
            return b"".join(map(self.__getitem__, text.split()))
        if "\t" in text or "\r" in text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return self._whole(text)
        return b"".join(map(self.__getitem__, BYTE_PIECES.findall(text)))


@lru_cache(4)
def encoder(path: str, by_words: bool, remembered: int = REMEMBERED) -> Encoder:
    return Encoder(path, by_words, remembered)


class ColumnEncoder(dict):
    """Encodes columns of texts to the ids that Encoder gives them.

    The texts of a step are cut as flat bytes, its distinct pieces are looked up once each, and new ones go to the library many at a
    time, with a line feed between. Tokenizers that see such a text otherwise than its pieces (JOINED_PROBES) get them one by one.
    As a dict it holds the number of each piece known, in UTF-8; known and lengths have their ids, one piece's after another's.
    """

    def __init__(self, path: str, by_words: bool, remembered: int = REMEMBERED):
        self.single, self.by_words, self.remembered = Encoder(path, by_words, remembered=10_000), by_words, remembered
        library = self.single.tokenizer
        self.feed = library.encode("\n", add_special_tokens=False).ids
        each = [library.encode(p, add_special_tokens=False).ids for p in JOINED_PROBES]
        self.joined = not by_words and len(self.feed) == 1 and self._split("\n".join(JOINED_PROBES), len(each)) == each
        # A full stop or comma after a letter, before white space, is cut off too: most words come with and without.
        self.signs = self.joined and self.single.plain
        uncut = [ODD.pattern, *([self.single.mark.pattern] if self.single.mark.pattern != "(?!)" else [])]
        self.uncut = "|".join(uncut if by_words else [*uncut, "[\t\r]", "[ \n][ \n]", r"\A[ \n]", r"[ \n]\z"])
        self.white = np.zeros(256, bool)
        self.white[[0x20, 0x0A, 0x09, 0x0D] if by_words else [0x20, 0x0A]] = True
        self.fresh: list[bytes] = []
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self[b"\n"] = 0
        self.known, self.lengths = np.array(self.feed, np.uint32), np.array([len(self.feed)])

    def __missing__(self, piece: bytes) -> int:
        self.fresh.append(piece)
        found = self[piece] = len(self)
        return found

    def _split(self, text: str, n: int) -> list[list[int]] | None:
        """The ids of the n pieces that text has between line feeds; None if they cannot be told apart."""
        ids = np.array(self.single.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        parts = np.split(ids, np.flatnonzero(ids == self.feed[0]))
        return [p[k > 0 :].tolist() for k, p in enumerate(parts)] if len(parts) == n else None

    def _one(self, piece: bytes) -> np.ndarray:
        text = piece.decode()
        return np.frombuffer(self.single.encode(text) if self.by_words else self.single[text], "<u4")

    def _learn(self) -> None:
        """Adds the ids of the fresh pieces."""
        ids, lengths, library = [self.known], [self.lengths], self.single.tokenizer
        for lo in range(0, len(self.fresh), JOINED_PIECES):
            part = self.fresh[lo : lo + JOINED_PIECES]
            if self.joined:
                found = np.array(library.encode_batch_fast([b"\n".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32)
                feeds = found == self.feed[0]
                ends = np.append(np.flatnonzero(feeds), len(found))
                if len(ends) == len(part):
                    ids.append(found[~feeds])
                    lengths.append(np.diff(ends, prepend=-1) - 1)
                    continue
            each = [self._one(p) for p in part]
            ids += each
            lengths.append(np.array([len(x) for x in each], np.int64))
        self.fresh = []
        self.known, self.lengths = np.concatenate(ids), np.concatenate(lengths)

    def _starts(self, data: np.ndarray, offsets: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """Where pieces start in data, and its end: at rows, white space, behind a line feed, at cut-off signs; odd rows stay whole."""
        white = self.white[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[:-1] = white
        edge[1:] |= data == 0x0A
        if self.signs:
            after = np.append(white[1:], True)
            after[offsets[1:] - 1] = True  # of an empty first row the last byte, which is before white space or the end anyway
            sign = np.flatnonzero(((data == 0x2E) | (data == 0x2C)) & after)
            sign = sign[sign > 0]
            edge[sign[_ASCII_LETTER[data[sign - 1]]]] = True
        for k in odd.tolist():
            edge[offsets[k] : offsets[k + 1]] = False
        edge[offsets] = True
        return np.flatnonzero(edge)

    def _cut(self, data: np.ndarray, offsets: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows, and their number in each."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        if len(self) >= self.remembered:
            self._forget()
        starts = self._starts(data, offsets, odd)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        names, at = pieces.dictionary.to_numpy(zero_copy_only=False), pieces.indices.to_numpy()
        row = np.searchsorted(starts, offsets)
        whole = np.unique(at[row[odd]])  # odd rows are one piece each, and are not remembered
        texts = [np.frombuffer(self.single.encode(names[k].decode()), "<u4") for k in whole.tolist()]
        some = np.ones(len(names), bool)
        some[whole] = False
        number = np.empty(len(names), np.int64)
        number[some] = np.fromiter(map(self.__getitem__, names[some]), np.int64, int(some.sum()))
        self._learn()
        number[whole] = len(self) + np.arange(len(whole))
        lengths = np.concatenate((self.lengths, np.array([len(x) for x in texts], np.int64)))
        lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32), np.concatenate([self.known, *texts]))
        number = number[at]
        ends = np.concatenate(([0], np.cumsum(lengths[number])))[row]
        return lists.take(pa.array(number)).flatten().to_numpy(), np.diff(ends)

    def _long(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """Parts of one row's bytes that begin at white space, of about COLUMN_BYTES."""
        lo = 0
        while lo < len(data):
            hi = lo + COLUMN_BYTES
            while hi < len(data) and not (white := np.flatnonzero(self.white[data[hi : hi + COLUMN_BYTES]])[:1]).size:
                hi += COLUMN_BYTES
            hi = len(data) if hi >= len(data) else hi + int(white[0])
            yield lo, hi
            lo = hi

    def encode(self, batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each step of the batch's rows, in order: their ids, one row's after another's, and how many each row has. Null texts are empty."""
        for rows, data, offsets in steps(batch, column, COLUMN_BYTES):
            odd = np.flatnonzero(pc.match_substring_regex(pc.fill_null(rows.column(column), ""), self.uncut).to_numpy(zero_copy_only=False))
            if len(data) <= COLUMN_BYTES:
                yield self._cut(data, offsets, odd)
            elif len(odd):  # one row
                ids = np.frombuffer(self.single.encode(data.tobytes().decode()), "<u4")
                yield ids, np.array([len(ids)])
            else:
                parts = [self._cut(data[lo:hi], np.array([0, hi - lo]), odd)[0] for lo, hi in self._long(data)]
                yield np.concatenate(parts), np.array([sum(map(len, parts))])


@lru_cache(4)
def column_encoder(path: str, by_words: bool) -> ColumnEncoder:
    return ColumnEncoder(path, by_words)
