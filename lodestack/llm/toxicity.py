"""Operator 4: toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

The kernel of two words is the gap-weighted subsequence kernel of three characters, with the word's begin as a character of its own: every common subsequence
counts, less for each character that it spans. Letters and digits that are spanned cost ``DECAY`` each, other characters only ``LOOSE``, and those are never matched, so
an insult with inserted characters (id-iot, i--d--i--o--t, idxiot) still resembles the insult. The kernel is scaled to 1 for a word with itself; what lies below
``CUT`` counts as 0. A sentence resembles a landmark as much as its most similar word does.

Landmarks are the words whose presence goes most with the label in distinct labelled sentences, those left out that resemble a better one. Nyström's map
(the inverse root of the landmarks' kernel matrix) makes sentences vectors, on which a squared-hinge SVM is trained, each sentence
labelled as its document. A document is scored by a logistic fit, on the training documents, of its worst sentence, the sum over its similar words, and its number of words.

Training reads at most ``TRAIN_DOCUMENTS`` labelled documents (the least by hash of the id), so what the driver holds is bounded; scoring reads every whole
text, with similarities of each distinct word computed once per worker (a bounded table). Runs of single characters ("a b c") and words with
stops inside ("a.b.c") are read as one word too; words of over ``LONGEST`` characters are read in overlapping windows.

Cases: null and empty texts score as a text without any similar word; without usable labels of both kinds every score is 0; null labels are left out, of several
labels of a document the largest counts; repeated rows score alike; very long texts are read whole; an empty table gives an empty table; other columns stay, and
``score`` and ``predicted`` of the input are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import chunks
from .shared import ship, written

DECAY, LOOSE, ORDER, CUT, LONGEST = 0.6, 0.95, 3, 0.3, 32
TRAIN_DOCUMENTS = 12_000
#: Landmarks: at most so many words, none resembling another by ALIKE, in at least SUPPORT sentences of toxic documents, LEAST_EXCESS deviations above
#: chance, out of the CONSIDERED ones with the largest excess.
LANDMARKS, ALIKE, SUPPORT, LEAST_EXCESS, CONSIDERED = 40, 0.7, 4, 8.0, 1000
COST = 1.0
_LIMIT = 500_000
_SENTENCE = re.compile(r"[.!?\n]+")
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
_STOPPED = re.compile(r"[^\s.!?]+(?:[.!?]+[^\s.!?]+)+")
_EDGE = ".,;:!?\"'()[]{}<>*_-#%&$~|/\\"
_INSIDE = re.compile(r"[.!?][^\s.!?]")
#: Stands before a word's first character.
_BEGIN = "\x02"


def sentence_words(sentence: str) -> list[str]:
    """The lower-case words of a sentence, punctuation around them included, and its runs of single characters as words."""
    lower = sentence.lower()
    return lower.split() + spaced_words(lower)


def spaced_words(lower: str) -> list[str]:
    return ["".join(m.split()) for m in _SPACED.findall(lower)]


def joined_words(lower: str, tokens: list[str]) -> list[str]:
    """Runs of single characters and words with stops inside; ``tokens`` are the text's words with stops as spaces."""
    out: list[str] = []
    if _INSIDE.search(lower):  # word by word, as the pattern takes time in the square of a run without stops
        for w in lower.split():
            if ("." in w or "!" in w or "?" in w) and _INSIDE.search(w):
                out += _STOPPED.findall(w)
    lengths = list(map(len, tokens))
    if lengths.count(1) > 2:
        at = [i for i, n in enumerate(lengths) if n == 1]
        if any(b - a == 2 for a, b in zip(at, at[2:])):
            out += spaced_words(" ".join(tokens))
    return out


def letters_of(word: str) -> str:
    return _BEGIN + (word if word.isalnum() else "".join(filter(str.isalnum, word)))


def _padded(words: list[str], n: int) -> np.ndarray:
    """The characters of words of at most ``n``, and zeros behind them."""
    return np.array(words, f"<U{n}").view(np.int32).reshape(len(words), n)


def _by_length(words: list[str]) -> dict[int, list[int]]:
    """The places of words whose lengths are alike; the key is their room."""
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w) + 3 & ~3, []).append(i)
    return out


def _spread(n: int) -> np.ndarray:
    """[j, k]: what a match at letter j is worth at letter k behind it."""
    gap = np.arange(n)[None, :] - np.arange(n)[:, None]
    return np.where(gap > 0, DECAY ** np.maximum(gap - 1, 0), 0.0)


def raw_kernels(codes: np.ndarray, decays: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Unscaled kernels of the words in the rows of ``codes`` (negative: never matched), whose characters cost ``decays`` to span, with the letters in ``other``."""
    n, m = codes.shape[1], other.shape[1]
    spread, prefix = _spread(m), [np.ones((len(codes), m))] + [np.zeros((len(codes), m)) for _ in range(ORDER - 1)]
    total = np.zeros(len(codes))
    for i in range(n):
        match = codes[:, i, None] == other
        total += DECAY**2 * (match * prefix[ORDER - 1]).sum(-1)
        for p in range(ORDER - 1, 0, -1):
            prefix[p] = decays[:, i, None] * prefix[p] + DECAY**2 * ((match * prefix[p - 1]) @ spread)
    return total


def self_kernels(words: list[str]) -> np.ndarray:
    """The kernel of each word's letters with themselves."""
    out = np.zeros(len(words))
    for n, at in _by_length(words).items():
        codes = _padded([words[i] for i in at], n)
        out[at] = raw_kernels(np.where(codes, codes, -2), np.full(codes.shape, DECAY), np.where(codes, codes, -1))
    return out


class WordKernel:
    """Similarities of words to landmarks, and a bounded table of those of words met before."""

    def __init__(self, landmarks: tuple[str, ...]):
        self.landmarks = landmarks
        letters = [letters_of(w) for w in landmarks]
        m = max(map(len, letters))
        self._codes = np.full((len(landmarks), m), -1, np.int32)
        for i, w in enumerate(letters):
            self._codes[i, : len(w)] = [ord(c) for c in w]
        #: Adjacent characters of landmarks; a similar word has some of them, with others between them at most. Characters by small numbers (0: in no landmark), pairs
        #: by theirs (0: none), and the landmarks of each pair in a row, with the bounds of their runs.
        of_pair: dict[tuple[str, str], list[int]] = {}
        for i, w in enumerate(letters):
            for p in sorted(set(zip(w, w[1:]))):
                of_pair.setdefault(p, []).append(i)
        some = {c: k for k, c in enumerate(sorted(set("".join(letters))), 1)}
        self._char = np.zeros(0x110000, np.int32)
        self._char[[ord(c) for c in some]] = list(some.values())
        self._pair = np.zeros((len(some) + 1, len(some) + 1), np.int64)
        for k, (x, y) in enumerate(of_pair, 1):
            self._pair[some[x], some[y]] = k
        self._run = np.cumsum([0, 0, *map(len, of_pair.values())])
        self._having = np.array([i for at in of_pair.values() for i in at], np.int64)
        self._own = self_kernels(letters)
        self._seen: set[str] = set()
        self._similar: dict[str, np.ndarray] = {}
        self._words: set[str] = set()

    def similarities(self, words: list[str], sieve: bool = True) -> dict[int, np.ndarray]:
        """By index of the word, its scaled kernels with all landmarks, where any is not below the cut.

        With ``sieve``, a pair is worked out if at least two of the landmark's pairs of adjacent letters stand in the word in order; others lie
        below the cut. A long word is as similar as its most similar window."""
        at, parts = list(range(len(words))), words
        if max(map(len, words), default=0) > LONGEST:
            windows = [(i, w[k : k + LONGEST]) for i, w in enumerate(words) for k in (range(0, len(w) - LONGEST // 2, LONGEST // 2) if len(w) > LONGEST else (0,))]
            at, parts = [i for i, _ in windows], [w for _, w in windows]
        letters = list(map(letters_of, parts))
        fit = [k for k, w in enumerate(letters) if len(w) >= ORDER]
        at, parts, letters = [at[k] for k in fit], [parts[k] for k in fit], [letters[k] for k in fit]
        if not at:
            return {}
        if sieve:
            part, to = self._sieved(letters)
        else:
            part, to = np.repeat(np.arange(len(at)), len(self.landmarks)), np.tile(np.arange(len(self.landmarks)), len(at))
        begins = np.append(True, part[1:] != part[:-1])[: len(part)]
        asked, row = part[begins].tolist(), np.cumsum(begins) - 1
        parts, letters, at = [parts[k] for k in asked], [letters[k] for k in asked], [at[k] for k in asked]
        different = {w: n for n, w in enumerate(dict.fromkeys(letters))}
        own = self_kernels(list(different))[[different[w] for w in letters]] if letters else np.zeros(0)
        first = np.searchsorted(row, np.arange(len(at) + 1))  # both ways give a word's landmarks in a row
        out: dict[int, np.ndarray] = {}
        for n, some in _by_length([_BEGIN + w for w in parts]).items():
            codes = _padded([_BEGIN + parts[k] for k in some], n)
            met = sorted(set("".join(parts[k] for k in some)))
            known = np.zeros(0x110000, bool)
            known[[ord(c) for c in (_BEGIN, *met) if c == _BEGIN or c.isalnum()]] = True
            solid = known[codes]
            codes, decays = np.where(solid, codes, -2), np.where(solid, DECAY, LOOSE)
            each = first[np.array(some) + 1] - first[some]
            rows = np.arange(each.sum()) + np.repeat(first[some] - np.cumsum(each) + each, each)
            of = np.repeat(np.arange(len(some)), each)
            for k in range(0, len(rows), 4096):
                mine, r = of[k : k + 4096], rows[k : k + 4096]
                s = raw_kernels(codes[mine], decays[mine], self._codes[to[r]]) / np.sqrt(np.maximum(own[row[r]] * self._own[to[r]], 1e-12))
                for x in np.flatnonzero(s >= CUT):
                    f = out.setdefault(at[row[r[x]]], np.zeros(len(self.landmarks), np.float32))
                    f[to[r[x]]] = max(f[to[r[x]]], s[x])
        return out

    def _sieved(self, letters: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words, by their place in ``letters``, and landmarks of which at least two different pairs stand in the word with at most two others between."""
        codes = np.frombuffer("".join(letters).encode("utf-32-le"), "<u4")
        word = np.repeat(np.arange(len(letters)), list(map(len, letters)))
        c = np.zeros(len(codes) + 3 * len(letters), np.int32)  # three empty places behind each word
        place = np.arange(len(codes)) + 3 * word
        c[place] = self._char[codes]
        keys = []
        for gap in (1, 2, 3):
            pair = self._pair[c[place], c[np.minimum(place + gap, len(c) - 1)]]
            held = np.flatnonzero(pair)
            keys.append(word[held] * len(self._run) + pair[held])
        keys = np.sort(np.concatenate(keys))
        has, pair = np.divmod(keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]], len(self._run))
        n = self._run[pair + 1] - self._run[pair]
        of = np.arange(n.sum()) + np.repeat(self._run[pair] - np.cumsum(n) + n, n)
        both, times = np.unique(np.repeat(has, n) * len(self.landmarks) + self._having[of], return_counts=True)
        return np.divmod(both[times > 1], len(self.landmarks))

    def near_words(self, words_of: list[set[str]]) -> list[dict[str, np.ndarray]]:
        """For each set of words those that are similar to a landmark, with their similarities."""
        missing = set().union(*words_of).difference(self._seen)
        if missing:
            if len(self._seen) + len(missing) > _LIMIT:
                self._seen.clear()
                self._similar.clear()
                self._words.clear()
                missing = set().union(*words_of)
            missing = list(missing)
            found = self.similarities([w.strip(_EDGE) for w in missing])
            self._seen.update(missing)
            self._similar.update((missing[i], f) for i, f in found.items())
            self._words.update(missing[i] for i in found)
        return [{w: self._similar[w] for w in words & self._words} for words in words_of]

    def near(self, words_of: list) -> list[np.ndarray | None]:
        """For each collection of words the largest similarity to each landmark; None if all are 0."""
        return [np.max(list(rows.values()), axis=0) if rows else None for rows in self.near_words([set(w) for w in words_of])]


def _kernel(landmarks: list[str]) -> WordKernel:
    """The worker's kernel for these landmarks."""
    return chunks.once(("kernel", *landmarks), lambda: WordKernel(tuple(landmarks)))


def unlike(words: list[str], most: int) -> list[str]:
    """The first ``most`` of ``words`` that resemble none taken before."""
    kernel, out = WordKernel(tuple(words)), []
    near = kernel.similarities(words)
    for i in range(len(words)):
        if len(out) < most and i in near and all(near[i][j] < ALIKE for j in out):
            out.append(i)
    return [words[i] for i in out]


@dataclass
class ToxicityModel:
    landmarks: list[str]
    weights: np.ndarray  # of the similarities: Nyström's map times the SVM's weights
    bias: float
    fit: np.ndarray  # of a document's traits and, last, of 1

    def traits(self, texts: list[str | None]) -> np.ndarray:
        """Each text's largest margin over its sentences (a joined word, wherever it stands, is a sentence of its own), the sum of its
        similar words' margins above the bias, and its number of distinct words; the latter two as logarithms."""
        kernel = _kernel(self.landmarks)
        lower = [(t or "").lower() for t in texts]
        # a stop or line end alone as a word between sentences
        marked = [t.replace(".", " . ").replace("!", " . ").replace("?", " . ").replace("\n", " . ").split() for t in lower]
        tokens = [[w for w in m if w != "."] for m in marked]
        words, joined = [set(t) for t in tokens], [set(joined_words(t, w)) for t, w in zip(lower, tokens)]
        out = np.zeros((len(texts), 3))
        out[:, 0] = self.bias
        similar = kernel.near_words(words + joined)
        for i, (near, more) in enumerate(zip(similar, similar[len(texts) :])):
            out[i, 2] = np.log1p(len(words[i]))
            if near or more:
                rows = np.stack([*near.values(), *more.values()])
                at, at_word, starts, fresh = {w: k for k, w in enumerate(near)}, [], [], True
                for w in marked[i] if near else ():
                    if w == ".":
                        fresh = True
                    elif w in at:
                        if fresh:
                            starts.append(len(at_word))
                            fresh = False
                        at_word.append(at[w])
                found = rows[len(near) :]
                if starts:
                    found = np.concatenate([found, np.maximum.reduceat(rows[at_word], starts)])
                out[i, 0] = max(self.bias, float((found @ self.weights).max()) + self.bias)
                out[i, 1] = np.log1p(np.maximum(rows @ self.weights, 0).sum())
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.traits(texts) @ self.fit[:-1] + self.fit[-1], -30, 30)))


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float, rounds: int = 50) -> np.ndarray:
    """Weights of a squared-hinge SVM whose last column is the bias, by Newton steps in the primal."""
    w = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1])
    keep[-1, -1] = 1e-3
    for _ in range(rounds):
        on = y * (x @ w) < 1
        xo = x[on] * weight[on, None]
        new = np.linalg.solve(keep + 2 * cost * xo.T @ x[on], 2 * cost * xo.T @ y[on])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Weights, the last of 1, of a logistic fit of y (0 or 1) on the columns of x, by Newton steps with a little ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = TRAIN_DOCUMENTS) -> ToxicityModel | None:
    """A model from the labelled documents that are not held out; None if they have not both labels."""
    spark = docs.sparkSession
    ship(spark)
    ids = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("_y")).where("_id IS NOT NULL AND _y IN (0, 1)")
    ids = ids.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").cast("int").alias("_y"))
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(most)  # a bounded sample of labelled rows
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).where("text IS NOT NULL AND text <> ''")
    sample = written(rows.join(F.broadcast(ids), "_id").select("text", "_y").repartition(max(spark.sparkContext.defaultParallelism, 1)), "labelled")

    def words(batches):
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sentences = [s.strip() for s in _SENTENCE.split(t) if s.strip()]
                yield pa.RecordBatch.from_arrays([pa.array(sentences, pa.string()), pa.array([sorted({w.strip(_EDGE) for w in sentence_words(s)}) for s in sentences], pa.list_(pa.string())), pa.array([y] * len(sentences), pa.int32())], ["sentence", "words", "y"])

    sentences = sample.mapInArrow(words, "sentence string, words array<string>, y int")
    distinct = sentences.groupBy(F.xxhash64("sentence").alias("h")).agg(F.max("y").alias("y"), F.first("words").alias("words"))
    distinct = written(distinct.select("words", "y"), "sentences")
    n1, n = distinct.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    if not 0 < n1 < n:
        return None
    per_word = distinct.select(F.explode("words").alias("w"), "y").groupBy("w").agg(F.sum("y").alias("pos"), F.count("*").alias("all"))
    expected = F.col("all") * (n1 / n)
    excess = (F.col("pos") - expected) / F.sqrt(expected)
    fits = F.length("w").between(ORDER, LONGEST) & F.col("w").rlike(r"^[\p{L}\p{N}]+$")
    top = per_word.where(fits & (F.col("pos") >= SUPPORT)).select("w", F.round(excess, 6).alias("z")).where(F.col("z") >= LEAST_EXCESS)
    landmarks = [r[0] for r in top.orderBy(F.desc("z"), "w").limit(CONSIDERED).collect()]
    if not landmarks:
        return None
    landmarks = unlike(landmarks, LANDMARKS)
    near = WordKernel(tuple(landmarks)).similarities(landmarks)
    gram = np.stack([near[i] for i in range(len(landmarks))]).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors @ np.diag(np.where(values > 1e-6, 1 / np.sqrt(np.maximum(values, 1e-6)), 0)) @ vectors.T
    def featured(batches):
        for b in batches:
            rows = [(np.round(f, 3).astype(np.float32).tobytes() if f is not None else b"", y) for f, y in zip(_kernel(landmarks).near(b.column(0).to_pylist()), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32())], ["f", "y"])

    # sentences alike in their similarities are one weighted row: at most as many as the bounded sample has sentences
    table = distinct.mapInArrow(featured, "f binary, y int").groupBy("f", "y").count().toArrow()
    x = np.stack([np.frombuffer(f, np.float32) if f else np.zeros(len(landmarks), np.float32) for f in table["f"].to_pylist()]).astype(float)
    y, weight = np.where(table["y"].to_numpy() > 0, 1.0, -1.0), table["count"].to_numpy().astype(float)
    w = svm(np.column_stack([x @ root, np.ones(len(x))]), y, weight, COST)
    model = ToxicityModel(landmarks, root @ w[:-1], float(w[-1]), np.zeros(4))

    def judged(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*map(pa.array, model.traits(b.column(0).to_pylist()).T), b.column(1)], ["worst", "sum", "words", "y"])

    fit = sample.mapInArrow(judged, "worst double, sum double, words double, y int").toArrow()  # the bounded sample's documents
    rows = np.column_stack([fit[c].to_numpy() for c in ("worst", "sum", "words", "y")]).astype(float)
    rows = rows[np.lexsort(rows.T)]  # the same sums whatever the order of the tasks
    model.fit = logistic(rows[:, :-1], rows[:, -1])
    return model


def score(df: DataFrame, model: ToxicityModel | None, text: str = "text") -> DataFrame:
    """Adds ``score`` (double, 0 to 1) and ``predicted`` (int)."""
    df = df.drop(*[c for c in df.columns if c.lower() in ("score", "predicted")])
    if model is None:
        return df.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    spark = df.sparkSession
    ship(spark)
    at, names, sent = df.columns.index(text), [*df.columns, "score"], spark.sparkContext.broadcast(model)

    def run(batches):
        for b in chunks.parts(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.score(b.column(at).to_pylist()))], names)

    return df.mapInArrow(run, StructType(list(df.schema)).add("score", "double")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_toxicity."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
