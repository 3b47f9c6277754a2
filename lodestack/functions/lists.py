"""Posting lists made inside a task: of sorted pairs, and of the runs of three characters of many texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken together up to about so many characters: this bounds a task's arrays (about five of as many 64-bit integers).
TOGETHER = 1 << 22
#: A character is its code point plus one; 0 stands behind the end of a text of under three characters.
_CODES = 0x110001
_NAMES = ["gram", "block", "ids"]
GRAM_LISTS = "field string, gram string, block long, ids array<int>"


def of_pairs(batches):
    """The lists (terms, block, ids) of pairs (terms, block, id) sorted by all their columns; repeated pairs count once. A list may go over several batches."""
    left = None

    def gathered(t: pa.RecordBatch, last: bool) -> tuple[pa.RecordBatch, pa.RecordBatch | None]:
        new = np.zeros(len(t), bool)
        new[:1] = True
        for c in t.columns[:-1]:
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        ids = t.columns[-1].to_numpy()
        once = new.copy()
        once[1:] |= ids[1:] != ids[:-1]
        at = np.flatnonzero(once)
        starts = np.flatnonzero(new[at])
        whole = starts if last else starts[:-1]
        ends = np.append(starts, len(at))[: len(whole) + 1]
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids[at[: ends[-1]]]))
        first = pa.array(at[whole])
        out = pa.RecordBatch.from_arrays([*(c.take(first) for c in t.columns[:-1]), lists], [*t.schema.names[:-1], "ids"])
        return out, None if last else t.take(pa.array(at[starts[-1] :]))

    for b in batches:
        if len(b):
            both = b if left is None else pa.Table.from_batches([left, b.cast(left.schema)]).combine_chunks().to_batches()[0]
            out, left = gathered(both, False)
            if len(out):
                yield out
    if left is not None:
        yield gathered(left, True)[0]


def of_texts(ids: np.ndarray, texts: list[str], width: int):
    """Record batches (gram, block, ids) of the distinct grams of texts and the sorted distances of the ids that have them from their block's first. Texts that have too many
    different characters together for one 64-bit key are taken in halves; one text alone always fits."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64) + 1
    met = np.zeros(_CODES, bool)
    met[codes] = True
    alphabet = np.append(0, np.flatnonzero(met))
    different, of = np.unique(ids, return_inverse=True)
    per_char, per_id = (len(alphabet) - 1).bit_length(), (len(different) - 1).bit_length()
    if 3 * per_char + per_id > 63:
        half = len(texts) // 2
        yield from of_texts(ids[:half], texts[:half], width)
        yield from of_texts(ids[half:], texts[half:], width)
        return
    place = np.zeros(_CODES, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    # three empty places behind each text; a gram begins where three characters stand, and at the first place of a shorter text
    at = np.cumsum(lengths) - lengths + 3 * np.arange(len(texts))
    c = np.zeros(len(codes) + 3 * len(texts), np.int64)
    c[np.arange(len(codes)) + 3 * np.repeat(np.arange(len(texts)), lengths)] = place[codes]
    begins = np.zeros(len(c), bool)
    begins[:-2] = (c[:-2] > 0) & (c[2:] > 0)
    begins[at] = True
    first = np.flatnonzero(begins)
    whose = of[np.searchsorted(at, first, "right") - 1]
    gram = (c[first] << 2 * per_char) | (c[first + 1] << per_char) | c[first + 2]
    keys = np.sort((gram << per_id) | whose)
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    gram, held = keys >> per_id, different[keys & ((1 << per_id) - 1)]
    block = held // width  # rounds down, as Spark's floor
    starts = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])))
    low = (1 << per_char) - 1
    names = ["".join(chr(x - 1) for x in g if x) for g in zip(*(alphabet[(gram[starts] >> k * per_char) & low].tolist() for k in (2, 1, 0)))]
    values = pa.array((held - block * width).astype(np.int32))
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(block[starts]), pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)).astype(np.int32)), values)], _NAMES)


def of_grams(batches, width: int, together: int = TOGETHER):
    """The same, with their field, for batches (field, id, text) of a task, in any order; a gram and block may have several lists."""
    field, ids, texts, size = None, [], [], 0

    def taken():
        for b in of_texts(np.array(ids, np.int64), texts, width):
            yield pa.RecordBatch.from_arrays([pa.array([field] * len(b), pa.string()), *b.columns], ["field", *_NAMES])

    for b in batches:
        for i in range(0, len(b), 256):  # few texts are Python objects twice
            for f, d, t in zip(*(column.to_pylist() for column in b.slice(i, 256).columns)):
                if texts and (f != field or size >= together):
                    yield from taken()
                    ids, texts, size = [], [], 0
                field = f
                ids.append(d)
                texts.append(t)
                size += len(t) + 3
    if texts:
        yield from taken()
