"""Token ids of whole texts by the tokenizers library, with ids of parts that recur kept at hand.

encode() takes one text, encode_all() a column of texts: there numpy finds where words and signs start in the bytes of all
of them, and Arrow the distinct ones, so that Python sees a word once however often the column has it.
"""

from __future__ import annotations

import gc
import re
import unicodedata
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: Entries of each cache of a Python worker, about 200 bytes each, unless a caller has less room.
CACHE = 800_000
#: When a cache is full, entries of at most so many characters stay if they are less than half of it: short parts recur most.
SHORT = 7
#: Letters and signs behind them, once or on two lines. (Letters are tested again, as \w holds some numbers that are none.)
_SIGNS = r"([!-&(-/:-@\[-`{-~]*)"
_PLAIN = re.compile(rf"([^\W\d_]+){_SIGNS}(?:\n([^\W\d_]+){_SIGNS})?")
#: A blank beside other white space.
_ODD = re.compile(r" \s|\s ")

#: Classes of characters: letters, signs, other characters that are not white space, blanks, other white space of ASCII, rest.
_LETTER, _SIGN, _OTHER, _BLANK, _SPACE, _REST = range(6)
#: Units that are looked up at once.
UNITS = 1 << 20


@cache
def _classes() -> np.ndarray:
    """Class of each code point of two or three bytes in UTF-8, and below."""

    def of(x: str) -> int:
        if x.isascii():
            return _LETTER if x.isalpha() else _BLANK if x == " " else _SPACE if x in "\t\n\v\f\r" else _REST if x.isspace() else _OTHER if x.isalnum() or x == "'" or not x.isprintable() else _SIGN
        if x.isspace():
            return _REST
        return _LETTER if x.isalpha() and unicodedata.normalize("NFC", unicodedata.normalize("NFC", x).lower()).isalpha() else _OTHER

    return np.array([of(chr(code)) for code in range(1 << 16)], np.uint8)


@cache
def _rules() -> np.ndarray:
    """What follows from 8 * (class of a character) + class of the next: 1 a cut, 2 a cut if no white space is next, 3 one if what is before is known."""
    rules, seen, space = np.zeros(64, np.uint8), (_LETTER, _SIGN, _OTHER), (_BLANK, _SPACE)
    for a in range(6):
        for b in range(6):
            if (a in seen and b in space) or (a, b) in ((_LETTER, _SIGN), (_SIGN, _LETTER)):
                rules[8 * a + b] = 1
            elif a in space and b in space:
                rules[8 * a + b] = 2
            elif a == _SPACE and b in seen:
                rules[8 * a + b] = 3
    return rules


def unit_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where units start in texts in UTF-8 (bytes ``data``) that begin at ``starts``: no piece of either pre-tokenizer spans two units.

    White space is cut off from what is before it, its last character from the rest of it, and from what follows unless it
    is a blank; letters and signs of ASCII (but for apostrophes) are cut from each other. Nothing is cut beside white space outside of ASCII.
    """
    table = _classes()
    kinds = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        kinds[data >= 0x80] = _OTHER
        two, three = lead[data[lead] < 0xE0], lead[(data[lead] >= 0xE0) & (data[lead] < 0xF0)]
        for at, code in (
            (two, (data[two] & 31).astype(np.int32) << 6 | data[two + 1] & 63),
            (three, (data[three] & 15).astype(np.int32) << 12 | (data[three + 1] & 63).astype(np.int32) << 6 | data[three + 2] & 63),
        ):
            for k in range(2 if at is two else 3):
                kinds[at + k] = table[code]
    rule = _rules()[kinds[:-1] << 3 | kinds[1:]]
    cut = np.empty(len(data) + 1, bool)
    cut[0] = cut[-1] = True
    np.equal(rule, 1, out=cut[1:-1])
    first = np.zeros(len(data) + 1, bool)
    first[starts] = first[-1] = True
    at = np.flatnonzero(rule == 2) + 1
    cut[at] = ~first[at + 1] & (kinds[np.minimum(at + 1, len(data) - 1)] < _BLANK)
    at = np.flatnonzero(rule == 3) + 1
    cut[at] = first[at - 1] | (kinds[np.maximum(at - 2, 0)] != _REST)
    return np.flatnonzero(cut[:-1] | first[:-1])


class _Letters(dict):
    """Code point of a letter -> how the byte-level pre-tokenizer writes it, asked of the library once for each letter."""

    def __init__(self, pre_tokenizer: object) -> None:
        super().__init__()
        self.pre_tokenizer = pre_tokenizer

    def __missing__(self, code: int) -> str:
        self[code] = out = "".join(p for p, _ in self.pre_tokenizer.pre_tokenize_str(chr(code)))
        return out


def _room(cache: dict[str, bytes], entries: int) -> None:
    """Make room in a full cache."""
    short = {k: v for k, v in cache.items() if len(k) <= SHORT}
    cache.clear()
    if len(short) < entries // 2:
        cache.update(short)


@dataclass
class Encoder:
    """Texts to ids as little-endian unsigned 32-bit bytes.

    A blank between two other characters always starts a new piece of the pre-tokenizers used here, so the ids of a text
    are those of its parts. The library gives the ids of each part. Letters and signs behind them (but for apostrophes) are
    a piece each by the rules of either pre-tokenizer, and a line break between such, and go to the model at once; other
    parts go through the pre-tokenizer. Parts behind a blank are kept without it. Texts with a blank beside other white space, or with an added
    token of the vocabulary in them, are encoded whole.
    """

    path: str
    entries: int = CACHE
    parts: dict[str, bytes] = field(default_factory=dict)
    units: dict[bytes, bytes] = field(default_factory=dict)
    pieces: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(self.path)
        added = t.get_added_tokens_decoder().values()
        self.added = [x.content for x in added]
        self.normalized = any(x.normalized for x in added)  # these are sought in normalized texts
        self.model, self.pre_tokenizer, self.normalizer = t.model, t.pre_tokenizer, t.normalizer
        self.blank = " " if "ByteLevel" in str(t.pre_tokenizer)[:10] else ""
        self.letters = _Letters(t.pre_tokenizer)
        between = "".join(p for p, _ in t.pre_tokenizer.pre_tokenize_str("a\na"))[1:-1]  # how a line break is written, if at all
        self.line = array("I", [x.id for x in self.model.tokenize(between)]).tobytes() if between.strip() else b""
        self.lead = "".join(p for p, _ in t.pre_tokenizer.pre_tokenize_str(" a"))[:-1]  # how a blank before a letter is written

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= self.entries:
                _room(self.pieces, self.entries)
            self.pieces[piece] = ids = self.tokenized(piece)
        return ids

    def tokenized(self, piece: str) -> bytes:
        return array("I", [x.id for x in self.model.tokenize(piece)]).tobytes()

    def letters_of(self, word: str, blank: bool) -> bytes:
        """Ids of a run of letters, behind a blank or not."""
        raw = word if word.isascii() else word.translate(self.letters)
        if blank:
            raw = self.lead + raw
        return self.pieces.get(raw) or self.piece(raw)

    def part(self, text: str, blank: bool) -> bytes:
        """Ids of a part without a blank in it, behind a blank or not."""
        if self.normalizer is not None:
            text = text.lower() if text.isascii() else self.normalizer.normalize_str(text)
        if text.isalpha():
            return self.letters_of(text, blank)
        m = _PLAIN.fullmatch(text)
        if m:
            word, signs, below, last = m.groups()
            if word.isalpha() and (below is None or below.isalpha()):
                ids = self.letters_of(word, blank)
                if signs:
                    ids += self.pieces.get(signs) or self.piece(signs)
                if below:
                    ids += self.line + self.letters_of(below, False)
                    if last:
                        ids += self.pieces.get(last) or self.piece(last)
                return ids
        return b"".join(self.piece(p) for p, _ in self.pre_tokenizer.pre_tokenize_str(self.blank + text if blank else text))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.normalized or any(x in text for x in self.added):
            return self.whole(text)
        first, *rest = text.split(" ")
        if rest and (not first or first[-1].isspace()):
            return self.whole(text)
        known = self.parts
        try:
            ids = b"".join(map(known.__getitem__, rest))
        except KeyError:
            if text[-1] == " " or _ODD.search(text):  # so that no such part is ever known
                return self.whole(text)
            new = set(rest).difference(known)
            if len(known) + len(new) > self.entries:
                _room(known, self.entries)
                new = set(rest).difference(known)
            for x in new:
                known[x] = self.part(x, True)
            ids = b"".join(map(known.__getitem__, rest))
        return self.part(first, False) + ids

    def unit(self, raw: bytes) -> bytes:
        """Ids of a unit of unit_starts(). Without a normalizer hardly any other unit has a piece of its letters, so that is not kept."""
        text = raw.decode()
        blank = text[0] == " " and len(text) > 1
        text = text[1:] if blank else text
        if self.normalizer is None and text.isalpha():
            word = text if text.isascii() else text.translate(self.letters)
            return self.tokenized(self.lead + word if blank else word)
        return self.part(text, blank)

    def ids_of_units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each unit); each distinct unit is looked up once."""
        coded = units.dictionary_encode()
        distinct, place = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        found = list(map(self.units.get, distinct))
        new = [k for k, ids in enumerate(found) if ids is None]
        room = self.entries if self.normalizer is not None else 3 * self.entries // 2  # hardly any piece is kept
        if len(self.units) + len(new) > room:
            _room(self.units, room)
        for k in new:
            found[k] = self.units[distinct[k]] = self.unit(distinct[k])
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        ends = np.append(0, np.cumsum(sizes, dtype=np.int64)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<u4")))
        return lists.take(coded.indices).flatten().to_numpy(), sizes[place]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of a string array (null: none), as encode() gives them."""
        texts = texts.fill_null("").cast(pa.large_string())
        if self.normalized or any(pc.any(pc.match_substring(texts, x)).as_py() for x in self.added):
            return [self.whole(x) for x in texts.to_pylist()]
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if len(at) else b""
        if not len(data):
            return [b""] * len(texts)
        at = at - at[0]
        starts = np.append(unit_starts(data, at), len(data))
        ids, sizes = [], []
        for k in range(0, len(starts) - 1, UNITS):
            own = starts[k : k + UNITS + 1]
            raw = pa.py_buffer(data[own[0] : own[-1]])
            part, size = self.ids_of_units(pa.Array.from_buffers(pa.binary(), len(own) - 1, [None, pa.py_buffer((own - own[0]).astype(np.int32)), raw]))
            ids.append(part.tobytes())
            sizes.append(size)
        before = np.append(0, np.cumsum(np.concatenate(sizes), dtype=np.int64))[np.searchsorted(starts, at)] * 4
        joined = b"".join(ids)
        return [joined[a:b] for a, b in zip(before.tolist(), before[1:].tolist(), strict=False)]


@contextmanager
def collector_off() -> Iterator[None]:
    """Without the search for cycles, of which encoding makes none; it would walk over the caches time and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


_encoders: dict[str, Encoder] = {}


def forget() -> None:
    """Drop the encoders of this Python process: other operators run in the same workers and need the memory."""
    _encoders.clear()


def encoder(path: str, entries: int = CACHE) -> Encoder:
    """The encoder of this Python process for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, entries)
    return _encoders[path]
