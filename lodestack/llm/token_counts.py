"""Operator 2: token counts of a unigram model, without building tokens.

A unigram tokenizer cuts each word into vocabulary pieces so that the sum of their scores is largest. Counting needs only the
best score and the number of pieces up to each character. Aho-Corasick finds, in one pass, every vocabulary piece
that ends at a character, the longest first; dynamic programming takes the best. The tie rule is that of the tokenizers library: of equal
scores the piece that begins first stays, since a later one must be strictly better. A character that no piece
covers alone may be an unknown one, scored ten below the worst piece. A run of unknown characters counts one byte piece per UTF-8 byte if the
vocabulary has pieces for all these bytes (byte fallback), else it is one unknown token. The pieces and scores are those of a public SentencePiece file; its scores are whole numbers, so sums are exact.

A text is cut before each space, which becomes U+2581, with one put in front of a text that does not begin with one, as the library's Metaspace does. Words repeat: each
worker keeps a bounded table of counts by word, emptied when full.

Cases: null and empty texts count 0 tokens; very long texts and words are read whole; repeated rows are counted each; other
columns stay and ``n_tokens`` of the input is replaced.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from . import chunks
from .shared import ship

#: Fixed values of the tokenizer family: the mark for a space, how far an unknown character is below the worst piece.
SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0
LIMIT = 800_000


def read_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) by id of a SentencePiece file."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]], limit: int = LIMIT):
        import ahocorasick

        self._find = ahocorasick.Automaton()
        for piece, score in pieces:
            self._find.add_word(piece, (len(piece), score))
        self._find.make_automaton()
        self._unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self._bytes = frozenset(int(p[3:5], 16) for p, _ in pieces if re.fullmatch("<0x[0-9A-F]{2}>", p))
        self._known: dict[str, int] = {}
        self._limit = limit

    def word(self, word: str) -> int:
        """The number of pieces of the best cut of ``word``."""
        n = len(word)
        score, count = [0.0] + [None] * n, [0] * (n + 1)
        begun: list[int | None] = [None] * (n + 1)  # where the run of unknown characters begins that ends here
        found = self._find.iter(word)
        end, (length, s) = next(found, (n, (0, 0.0)))
        for i in range(n):
            best, pieces, run = None, 0, None
            alone = False
            while end == i:
                if (before := score[i + 1 - length]) is not None and (best is None or before + s > best):
                    best, pieces = before + s, count[i + 1 - length] + 1
                alone |= length == 1
                end, (length, s) = next(found, (n, (0, 0.0)))
            if not alone and (best is None or score[i] + self._unknown > best):
                run = i if begun[i] is None else begun[i]
                raw = word[run : i + 1].encode()
                best, pieces = score[i] + self._unknown, count[run] + (len(raw) if self._bytes.issuperset(raw) else 1)
            score[i + 1], count[i + 1], begun[i + 1] = best, pieces, run
        return count[n]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        known, total = self._known, 0
        words = text.replace(SPACE_MARK, " ").split(" ")
        if not words[0]:  # a text that begins with a space gets no other in front
            del words[0]
        for w, n in Counter(words).items():
            if (c := known.get(w)) is None:
                if len(known) >= self._limit:
                    known.clear()
                c = known[w] = self.word(SPACE_MARK + w)
            total += c * n
        return total


def count_tokens(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``n_tokens`` (long); ``path`` a SentencePiece file whose pieces and scores make the unigram model."""
    ship(df.sparkSession)
    df = df.drop(*[c for c in df.columns if c.lower() == "n_tokens"])
    at, names = df.columns.index(text), [*df.columns, "n_tokens"]

    def run(batches):
        counter = chunks.once(("unigram", path), lambda: UnigramCounter(read_pieces(path)))
        for b in chunks.parts(batches):
            n = pa.array([counter.text(t) for t in b.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, n], names)

    return df.mapInArrow(run, StructType(list(df.schema)).add("n_tokens", "long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_token_counts: doc_id and n_tokens of every whole text."""
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, P.path("piece_bpe_32k.model")).drop("text")
