"""Encoding whole texts piece by piece, each distinct piece once per worker.

A tokenizer splits a text by its pattern and merges inside each piece only, so a text's ids are the ids
of its pieces in a row. Words repeat: most pieces are found in the worker's table, and the tokenizers
library encodes the others. Ids are the machine's 32-bit integers, little-endian on all machines that Spark runs on here. The table is emptied when it is full, which bounds memory and changes no id.

Texts made of Latin characters alone are split here, with the pattern's classes written out. In any
other text the edge before white space, which no piece crosses, makes the cuts, and the library does the rest;
so nothing depends on which Unicode version a regex engine has.
"""

from __future__ import annotations

import json
import os
import re
from array import array

#: The characters with the Unicode property White_Space, as the tokenizers' engines take \s;
#: letters and numbers below U+0250.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LETTER = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
NUMBER = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
#: Not Latin; and, where lower case is taken first, also what is not Latin or several characters then.
OTHER = re.compile("[^\\x00-\\u024f]")
OTHER_FOLDED = re.compile("[^\\x00-\\u024f]|[" + "".join(c for c in map(chr, range(0x250)) if len(c.lower()) > 1 or c.lower() > "\u024f") + "]")
SPACED_WORD = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
WORD = re.compile(f"[^{SPACE}]+")


#: The pattern of the byte-level vocabularies, and how the one with word ends splits; for no other are the patterns below used.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_END_STEPS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
]


def _pieces(letter: str, number: str, word_end: bool) -> re.Pattern:
    """The pattern of the byte-level vocabularies, or that of the vocabulary with word ends. Words come first, since most pieces are words and no other
    branch begins as they do."""
    contraction = "'(?:[stmd]|re|ve|ll)"
    if word_end:
        return re.compile(f"[{letter}]+|{contraction}|[{number}]|[^{SPACE}{letter}{number}]+")
    return re.compile(f" ?[{letter}]+|{contraction}| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


BYTE_PIECE, WORD_PIECE = _pieces(LETTER, NUMBER, False), _pieces(LETTER, NUMBER, True)
#: The same for ASCII texts, whose classes are small and quick to test.
ASCII = {BYTE_PIECE: _pieces("A-Za-z", "0-9", False), WORD_PIECE: _pieces("A-Za-z", "0-9", True)}

#: Bytes of the worker's table of pieces, counted with what a Python object needs besides its content.
LIMIT, OBJECT = 96 << 20, 160


def byte_characters() -> str:
    """The printable character that stands for each byte in byte-level vocabularies: itself if it prints, else the next from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b if b in prints else next(rest)) for b in range(256))


BYTE_CHARACTERS = byte_characters()


class _Known(dict):
    """Ids by piece. A piece of a Latin text that is not there yet is encoded when it is looked up."""

    def __init__(self, tokenizer):
        self._tokenize = tokenizer.model.tokenize
        self.size = 0

    def put(self, piece: str, ids: list[int]) -> bytes:
        self[piece] = out = array("I", ids).tobytes()
        self.size += OBJECT + 5 * len(piece)
        return out

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # all but the space stand for themselves
            shown = piece.replace(" ", BYTE_CHARACTERS[32])
        else:
            shown = piece.encode().decode("latin-1").translate(BYTE_CHARACTERS)
        return self.put(piece, [t.id for t in self._tokenize(shown)])


class PieceEncoder:
    """Ids of whole texts. ``fold``: lower case first, as the vocabulary with word ends does."""

    def __init__(self, tokenizer, piece: re.Pattern, chunk: re.Pattern, fold: bool = False, limit: int = LIMIT):
        self._tokenizer, self._piece, self._chunk, self._fold, self._limit = tokenizer, piece, chunk, fold, limit
        self._other, self._ascii = OTHER_FOLDED if fold else OTHER, ASCII[piece]
        self._known = _Known(tokenizer)

    def _cut(self, text: str) -> list[str]:
        """The text's pieces; those of a text that is not Latin are known afterwards."""
        if text.isascii():
            return self._ascii.findall(text.lower() if self._fold else text)
        if not self._other.search(text):
            return self._piece.findall(text.lower() if self._fold else text)
        cut = self._chunk.findall(text)
        missing = [p for p in set(cut) if p not in self._known]
        for i in range(0, len(missing), 4096):
            some = missing[i : i + 4096]
            for p, e in zip(some, self._tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self._known.put(p, e.ids)
        return cut

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; null counts as empty."""
        out = []
        for text in texts:
            if self._known.size > self._limit:
                self._known = _Known(self._tokenizer)
            out.append(b"".join(map(self._known.__getitem__, self._cut(text))) if text else b"")
        return out


_encoders: dict[tuple, object] = {}


def once(key: tuple, make):
    """What ``make`` returns, made once per worker; it takes the place of what another operator left, so that a worker
    that serves several holds one table of words at a time."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = make()
    return _encoders[key]


SLICE = 256


def parts(batches):
    """The batches in runs of few rows, so that few texts are Python objects at a time."""
    for b in batches:
        for i in range(0, len(b), SLICE):
            yield b.slice(i, SLICE)


class WholeEncoder:
    """Ids of whole texts by the library alone, for tokenizers that split otherwise than the patterns here."""

    def __init__(self, tokenizer):
        self._tokenizer = tokenizer

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self._tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


class AddedTokens:
    """Texts that may hold the string of an added token, as <|endoftext|>, are given to the library whole, which reads it as that token; the others to ``pieces``."""

    def __init__(self, pieces: PieceEncoder, tokenizer, strings: list[str]):
        self._pieces, self._whole = pieces, WholeEncoder(tokenizer)
        self._held = re.compile("|".join(map(re.escape, strings)), re.IGNORECASE)  # the file may lower case first

    def encode(self, texts: list[str | None]) -> list[bytes]:
        held = [i for i, t in enumerate(texts) if t and self._held.search(t)]
        if not held:
            return self._pieces.encode(texts)
        rest = list(texts)
        for i in held:
            rest[i] = None
        out = self._pieces.encode(rest)
        for i in held:
            out[i] = self._whole.encode([texts[i]])[0]
        return out


def library(path: str):
    """A tokenizer file of the tokenizers library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _split_here(path: str, word_ends: bool) -> tuple[bool, list[str]]:
    """Whether a tokenizer file splits as the patterns here do, and the strings of its added tokens."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    strings = [t["content"] for t in file["added_tokens"]]
    steps = file["pre_tokenizer"] or {}
    steps = [{k: v for k, v in p.items() if k != "trim_offsets"} for p in steps.get("pretokenizers", [steps])]
    before = file["normalizer"] or {}
    plain = not file["model"].get("dropout") and not file["model"].get("continuing_subword_prefix") and (file["model"].get("end_of_word_suffix") or "") == ("</w>" if word_ends else "")
    if word_ends:
        folds = [n["type"] for n in before.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        return plain and folds and steps == WORD_END_STEPS, strings
    return plain and not before and steps == [{"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}], strings


def _encoder(path: str, word_ends: bool):
    tokenizer = library(path)
    known, strings = _split_here(path, word_ends)
    if not known:
        return WholeEncoder(tokenizer)
    pieces = PieceEncoder(tokenizer, WORD_PIECE, WORD, fold=True) if word_ends else PieceEncoder(tokenizer, BYTE_PIECE, SPACED_WORD)
    return AddedTokens(pieces, tokenizer, strings) if strings else pieces


def byte_level(path: str):
    return once(("byte", path), lambda: _encoder(path, False))


def word_end(path: str):
    return once(("word", path), lambda: _encoder(path, True))


def slices(texts: list[str | None], most: int = 1_000_000):
    """Runs of texts of about ``most`` characters, so that work on very long texts stays small."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
