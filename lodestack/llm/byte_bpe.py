"""Operator 1: byte-level BPE encoding and decoding.

The tokenizers library runs inside Arrow batches. A rank file (bytes and their rank) becomes a model of
that library: each byte is written as its printable character, and every way to join two entries into a
third is a merge, in the order of ranks. Offsets come from the entries' byte lengths and the byte-to-character
mapping of the text. Decoding reverses the table: entries are joined as bytes and read as UTF-8 only
at the end, so a character split over several ids comes back whole.

Cases: a null or empty text has no ids and decodes to an empty text; ids whose bytes are not UTF-8 decode with U+FFFD
in the text and unchanged in the bytes; very long texts are encoded alone; repeated rows and ids stay as they are; an id
out of the vocabulary raises. Other columns are kept; ``ids``, ``starts``, ``decoded`` and ``decoded_bytes`` of the
input are replaced.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from . import chunks
from .shared import ship


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file, by id."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def model_of_ranks(entries: list[bytes], pattern: str):
    """A tokenizer of the tokenizers library that splits by ``pattern`` and merges by rank."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    shown = [e.decode("latin-1").translate(chunks.BYTE_CHARACTERS) for e in entries]
    vocab = {s: i for i, s in enumerate(shown) if s}
    merges = [
        (s[:k], s[k:]) for s in shown for k in range(1, len(s)) if s[:k] in vocab and s[k:] in vocab
    ]
    t = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
    t.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return t


def _worker(path: str, pattern: str):
    def make():
        entries = read_ranks(path)
        model = model_of_ranks(entries, pattern)
        encoder = chunks.PieceEncoder(model, chunks.BYTE_PIECE, chunks.SPACED_WORD) if pattern == chunks.BYTE_PATTERN else chunks.WholeEncoder(model)
        return encoder, entries, np.array([len(e) for e in entries], np.int64)

    return chunks.once(("ranks", path, pattern), make)


def character_starts(text: str, lengths: np.ndarray) -> np.ndarray:
    """The character in which each token begins, of tokens of these byte lengths."""
    raw = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
    return character[np.cumsum(lengths) - lengths].astype(np.int32) if len(lengths) else np.zeros(0, np.int32)


def _others(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.lower() in names])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """Adds ``ids`` (binary: little-endian unsigned 32-bit) and, with ``offsets``, ``starts`` (first character of each token)."""
    ship(df.sparkSession)
    df = _others(df, "ids", "starts")
    at = df.columns.index(text)

    def run(batches):
        encoder, _, lengths = _worker(path, pattern)
        for b in chunks.parts(batches):
            texts = b.column(at).to_pylist()
            for i, j in chunks.slices(texts):
                ids = encoder.encode(texts[i:j])
                cols = [*b.slice(i, j - i).columns, pa.array(ids, pa.binary())]
                if offsets:
                    cols.append(pa.array([character_starts(t or "", lengths[np.frombuffer(x, "<u4")]) for t, x in zip(texts[i:j], ids)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = [*df.columns, "ids", *(["starts"] if offsets else [])]
    schema = StructType(list(df.schema)).add("ids", "binary")
    if offsets:
        schema = schema.add("starts", ArrayType(IntegerType()))
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, text: bool = True) -> DataFrame:
    """Adds ``decoded_bytes`` and, with ``text``, ``decoded``, from ``ids``; a null ``ids`` counts as none."""
    ship(df.sparkSession)
    df = _others(df, "decoded", "decoded_bytes")
    at = df.columns.index("ids")
    names = [*df.columns, "decoded_bytes", *(["decoded"] if text else [])]

    def run(batches):
        _, entries, _ = _worker(path, pattern)
        get = entries.__getitem__
        for b in chunks.parts(batches):
            raw = [b"".join(map(get, np.frombuffer(x or b"", "<u4").tolist())) for x in b.column(at).to_pylist()]
            cols = [*b.columns, pa.array(raw, pa.binary())]
            if text:
                cols.append(pa.array([r.decode("utf-8", "replace") for r in raw], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = StructType(list(df.schema)).add("decoded_bytes", "binary")
    return df.mapInArrow(run, schema.add("decoded", "string") if text else schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_byte_bpe."""
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode(docs, path, P.PATTERN).drop("text")
    return decode(coded, path, P.PATTERN, text=False).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded_bytes", 256).alias("decoded_sha256"),
    )
