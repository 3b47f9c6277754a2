"""Operator 12: exact encoding with a SentencePiece file of the merge type, by backtracking, and decoding.

The library joins the adjacent pair with the best score, again and again. A cut of a text into pieces is its result exactly if each two adjacent pieces,
merged anew on their own, come out as they are; and there is one such cut. So pieces are chosen from left to right: Aho-Corasick gives, for every place, all
pieces that begin there; the longest whose end has not failed and that stands with the piece before it is taken. If there is none, the place is marked in a field
of bits as failed for good, and the piece before it is given up for a shorter one. Which pieces stand together is kept in a bounded table per worker.

A text is cut beforehand at places that no piece crosses, worked out from the file: at characters that no piece holds, before a space behind anything else, and
behind Latin words, before signs that no piece has behind a Latin letter. Such cuts repeat, and each worker keeps a bounded table of their ids, emptied when full. A file whose
pieces have a space inside is not cut at spaces.

Characters without a piece become byte pieces if the file has them, else a run of them is one unknown piece. Normalisation other than
the identity and pieces of the types user-defined and unused are not supported; such files raise.

Cases: a null or empty text has the end id alone, if asked for, and decodes to an empty text; very long texts and runs without a space are read whole; repeated rows are coded
each; ids out of the vocabulary raise; other columns stay, and ``ids`` and ``decoded`` of the input are replaced.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from . import chunks
from .shared import ship

#: Fixed value: the mark for a space.
MARK = "▁"
LETTER = re.compile(f"[{chunks.LETTER}]")
LIMIT, PAIRS, OBJECT, NONE = 160 << 20, 1_000_000, 160, -float("inf")


def _fields(raw: bytes):
    """(number, value) of each field of a protocol buffer message."""
    i = 0

    def varint():
        nonlocal i
        out = shift = 0
        while True:
            byte = raw[i]
            i += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while i < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, raw[i : i + size]
            i += size


class Model:
    """What a SentencePiece file says: pieces with ids and scores, and ids of bytes, the unknown piece and the end.

    The file is a public protocol buffer: field 1 the pieces, 2 the trainer's settings (3 the model type, merge is 2), 3 the normaliser's (2 a table of characters,
    3 a space put in front, 4 and 5 how spaces are kept)."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = m = SentencePieceProcessor(model_file=path)
        top = list(_fields(m.serialized_model_proto()))
        trainer = {k: v for n, raw in top if n == 2 for k, v in _fields(raw)}
        normal = {k: v for n, raw in top if n == 3 for k, v in _fields(raw)}
        kinds = [dict(_fields(raw)).get(3, 1) for n, raw in top if n == 1]
        if trainer.get(3, 1) != 2:
            raise ValueError("not a file of the merge type")
        if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24, 0) or {4, 5} & set(kinds):
            raise ValueError("normalisation, a space behind words, user-defined and unused pieces are not supported")
        self.space_in_front = bool(normal.get(3, 1))
        self.ids = {m.id_to_piece(i): i for i, kind in enumerate(kinds) if kind == 1}
        self.scores = {p: m.get_score(i) for p, i in self.ids.items()}
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(m.is_byte(i) for i in range(m.get_piece_size())) else None
        self.unknown, self.end = m.unk_id(), m.eos_id()


    def ids_with_unknown(self, pieces: list[str]) -> list[int]:
        ids: list[int] = []
        for p in pieces:
            if (i := self.ids.get(p)) is not None:
                ids.append(i)
            elif self.bytes:
                ids += [self.bytes[b] for b in p.encode()]
            elif ids[-1:] != [self.unknown]:
                ids.append(self.unknown)
        return ids


class BacktrackingEncoder:
    """The cut of a run of characters into pieces, spaces written as ``MARK``."""

    def __init__(self, scores: dict[str, float]):
        import ahocorasick

        self._scores = scores
        self._together: dict[str | None, dict[str, bool]] = {}
        self._pairs = 0
        self._find = ahocorasick.Automaton()
        self._shorter: dict[str, str] = {}  # the next shorter piece with which a piece begins; a character alone always may be one
        made = {p for p in scores if len(p) > 1 and self.merged(p) == [p]}  # a piece that merging never makes can't be in a result
        for p in made:
            self._find.add_word(p, p)
            self._shorter[p] = next((p[:k] for k in range(len(p) - 1, 1, -1) if p[:k] in made), p[0])
        self._any = bool(made)
        self._find.make_automaton()

    def merged(self, text: str) -> list[str]:
        """Merging as defined: of adjacent parts, the pair whose whole has the best score is joined, the first of equal ones."""
        parts, score = list(text), self._scores.get
        pairs = [score(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while pairs and (best := max(pairs)) != NONE:
            at = pairs.index(best)
            parts[at] += parts.pop(at + 1)
            del pairs[at]
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at], NONE)
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1], NONE)
        return parts

    def together(self, left: str | None, right: str) -> bool:
        """Whether the two stay as they are when merged anew."""
        if self._pairs >= PAIRS:
            self._together.clear()
            self._pairs = 0
        self._pairs += 1
        known = self._together.setdefault(left, {})[right] = left is None or self.merged(left + right) == [left, right]
        return known

    def cut(self, text: str) -> list[str]:
        n, shorter, table = len(text), self._shorter.get, self._together
        # of the pieces that begin behind a place, the longest: it ends last
        longest = {last - len(p): p for last, p in self._find.iter(text)} if self._any else {}
        failed = None
        out: list[str] = []
        at, left, piece = 0, None, None
        while at < n:
            if piece is None:
                piece = longest.get(at - 1) or text[at]
            known = table.get(left, {})
            while piece:
                end = at + len(piece)
                if not (failed and failed[end >> 3] >> (end & 7) & 1):
                    if (good := known.get(piece)) or good is None and self.together(left, piece):
                        out.append(piece)
                        at, left, piece = end, piece, None
                        break
                piece = shorter(piece)
            else:  # no piece stands here: give up the one before
                failed = failed or bytearray(n // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                given = out.pop()
                at -= len(given)
                left, piece = out[-1] if out else None, shorter(given) or ""
        return out


class _Known(dict):
    """Ids by run, as little-endian unsigned 32-bit integers; a run that is not there yet is cut when it is looked up."""

    def __init__(self, model: Model, encoder: BacktrackingEncoder):
        self._model, self._cut, self.size = model, encoder.cut, 0

    def __missing__(self, run: str) -> bytes:
        m, pieces = self._model, self._cut(run.replace(" ", MARK))
        try:
            ids = [m.ids[p] for p in pieces]
        except KeyError:
            ids = m.ids_with_unknown(pieces)
        self[run] = out = array("I", ids).tobytes()
        self.size += OBJECT + 5 * len(run)
        return out


def run_patterns(pieces, byte_pieces: bool) -> tuple[re.Pattern, re.Pattern]:
    """The runs into which texts, and ASCII texts, may be cut: no piece holds characters of two runs. Spaces are spaces here."""
    pairs = {(a, b) for p in pieces for a, b in zip(p, p[1:])}
    if any(b == MARK and a != MARK for a, b in pairs):
        return re.compile("(?s).+"), re.compile("(?s).+")
    ascii_rest = [chr(c) for c in range(128) if chr(c) not in " " and not chr(c).isalpha()]
    held = set("".join(pieces))
    alone = {c for c in ascii_rest if c not in held} if byte_pieces else set()  # without byte pieces, runs of unknown characters count as one
    signs = {c for c in ascii_rest if c in held and not any(b == c and LETTER.match(a) for a, b in pairs)}
    each = lambda chars: "".join(map(re.escape, sorted(chars)))
    word = lambda letters: f" *[{letters}]++(?![^ {each(alone | signs)}])"  # noqa: E731  a word up to a space, a sign or the end
    rest = f"| *[^ {each(alone)}]+" + (f"|[{each(alone)}]" if alone else "") + "| +"
    return re.compile(word(chunks.LETTER) + rest), re.compile(word("A-Za-z") + rest)


class TextEncoder:
    def __init__(self, model: Model, limit: int = LIMIT):
        self._model, self._limit, self._encoder = model, limit, BacktrackingEncoder(model.scores)
        self._runs, self._ascii_runs = run_patterns(model.ids, model.bytes is not None)
        self._known = _Known(model, self._encoder)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._known.size > self._limit:
            self._known = _Known(self._model, self._encoder)
        runs = self._ascii_runs if text.isascii() else self._runs
        text = text.replace(MARK, " ")
        return b"".join(map(self._known.__getitem__, runs.findall(" " + text if self._model.space_in_front else text)))


class Decoder:
    """Pieces joined, and spaces for marks. Ids of control and unknown pieces and of bytes beyond ASCII, which may make up a character together, are left to the library."""

    def __init__(self, model: Model):
        self._library, self._front, self._end = model.library, model.space_in_front, model.end
        self._shown: list[str | None] = [None] * model.library.get_piece_size()
        for p, i in model.ids.items():
            self._shown[i] = p.replace(MARK, " ")
        for b, i in enumerate(model.bytes[:128] if model.bytes else []):
            self._shown[i] = chr(b)
        self._marked = {i for p, i in model.ids.items() if p[0] == MARK}

    def decode(self, ids: list[int]) -> str:
        body = ids[:-1] if ids and ids[-1] == self._end else ids
        try:
            text = "".join(map(self._shown.__getitem__, body))
        except (TypeError, IndexError):  # a piece that is not shown here
            return self._library.decode(ids)
        return text[1:] if self._front and body and body[0] in self._marked else text


def _worker(path: str) -> tuple[Model, TextEncoder]:
    def make():
        model = Model(path)
        return model, TextEncoder(model)

    return chunks.once(("pieces", path), make)


def encode(df: DataFrame, path: str, text: str = "text", end: bool = True) -> DataFrame:
    """Adds ``ids`` (array<int>), with ``end`` followed by the end id."""
    ship(df.sparkSession)
    df = df.drop(*[c for c in df.columns if c.lower() == "ids"])
    at, names = df.columns.index(text), [*df.columns, "ids"]

    def run(batches):
        model, encoder = _worker(path)
        tail = array("I", [model.end] if end else []).tobytes()
        for b in chunks.parts(batches):
            texts = b.column(at).to_pylist()
            for i, j in chunks.slices(texts):
                ids = [encoder.encode(t) + tail for t in texts[i:j]]
                places = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=places[1:])
                values = pa.ListArray.from_arrays(pa.array(places), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, values], names)

    return df.mapInArrow(run, StructType(list(df.schema)).add("ids", ArrayType(IntegerType())))


def decode(df: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``, the text of ``ids`` as the library decodes them; a null ``ids`` counts as none."""
    ship(df.sparkSession)
    df = df.drop(*[c for c in df.columns if c.lower() == "decoded"])
    at, names = df.columns.index("ids"), [*df.columns, "decoded"]

    def run(batches):
        decoder = chunks.once(("decode", path), lambda: Decoder(Model(path)))
        for b in chunks.parts(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([decoder.decode(x or []) for x in b.column(at).to_pylist()], pa.string())], names)

    return df.mapInArrow(run, StructType(list(df.schema)).add("decoded", "string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12_piece_bpe."""
    import public_tokenizers as P

    path = P.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decode(encode(docs, path).drop("text"), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
