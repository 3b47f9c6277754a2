"""Operators 11 to 13 against brute force, the library and SQL, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lodestack.llm import piece_bpe, spelling, vector_codes

SF = "/root/testdata/sf0.001"
MODEL = P.path("piece_bpe_32k.model")


def brute_codes(rows, parts, entries, rounds):
    """By id: (code, error), and the codebooks, in Python's whole numbers."""
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    good.sort()
    width = len(good[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in good[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            got = defaultdict(list)
            for _, v in good:
                got[near(cut(v, p), books[p])[1]].append(cut(v, p))
            for e, xs in got.items():
                books[p][e] = [sum(x) // len(xs) for x in zip(*xs)]
    found = []
    for i, v in good:
        each = [near(cut(v, p), books[p]) for p in range(parts)]
        found.append((i, "".join(f"{e:02x}" for _, e in each), sum(d for d, _ in each)))
    return found, books


def test_op11_query_is_brute_force_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = vector_codes.query(spark, SF).collect()
    want, books = brute_codes(rows, 16, 64, 2)
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == want
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert {r["codebooks_sha256"] for r in got} == {sha}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    columns = "vec_id, code, error, label_error, codebooks_sha256"
    assert sorted(map(tuple, got)) == sorted(db.execute(f"SELECT {columns} FROM ({vector_codes.SQL})").fetchall())


def test_op11_ties_repeats_and_odd_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.5, -0.001, 0.0, 0.25, 1.0]) for _ in range(4)], rng.choice([None, 0, 1])) for i in range(300)]
    rows += [(300, rows[0][1], 1), (301, None, 1), (302, [1.0, None, 0.0, 0.0], 1), (303, [float("nan")] * 4, None), (304, [float("inf"), 0.0, 0.0, 0.0], 0), (305, [1.0], 0), (306, [], 0)]
    df = spark.createDataFrame([(*r, "old", 5) for r in rows], "vec_id long, embedding array<float>, label int, code string, error int").repartition(3)
    books = vector_codes.train(df, parts=2, entries=20)
    got = vector_codes.encode(df, books)
    assert got.columns == ["vec_id", "embedding", "label", "code", "error"]
    whole = [(i, v) for i, v, _ in rows if v is not None and len(v) == 4]
    want, brute = brute_codes(whole, 2, 20, 2)
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got.collect()) == want and books.entries.tolist() == brute
    back = {r["vec_id"]: r["decoded"] for r in vector_codes.decode(got, books).collect()}
    assert back[0] == [(x + 0.5) / 256 for p in range(2) for x in brute[p][int(want[0][1][2 * p : 2 * p + 2], 16)]]
    nameless = df.withColumn("vec_id", F.lit(None).cast("long"))
    assert vector_codes.encode(nameless, vector_codes.train(nameless, parts=2, entries=20)).count() == 301
    three = vector_codes.train(df, parts=3, entries=8)  # filled up with zeros
    assert three.entries.shape == (3, 8, 2) and set(three.entries[2].ravel()) == {0}
    assert vector_codes.train(df.where("vec_id > 300")) is not None and vector_codes.train(df.where("vec_id = 301")) is None
    with pytest.raises(Exception, match="larger than"):
        vector_codes.train(spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<double>"), parts=2)


def test_op11_query_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/embeddings.parquet").limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert vector_codes.query(spark, str(tmp_path)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes.query(spark, str(tmp_path)).count() == 0


def test_kd_tree_is_brute_force_where_distances_tie():
    rng = np.random.default_rng(0)
    for k in (1, 2, 5, 64, 200):
        entries, x = rng.integers(-3, 4, (k, 3)), rng.integers(-4, 5, (500, 3))
        d = ((x[:, None] - entries) ** 2).sum(2)
        index, best = vector_codes.KdTree(entries).nearest(x)
        assert (index == d.argmin(1)).all() and (best == d.min(1)).all()


def texts_for_pieces():
    rng = random.Random(5)
    model = piece_bpe.Model(MODEL)
    pieces = list(model.ids)
    for letters in ("ab", "▁ a", "aeiou nrst", " the.ing(){}\n\t'\"", "日本語の文字 é😀\0", "0123 4a", "$# .x"):
        for _ in range(400):
            yield "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
    for _ in range(3000):
        yield "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
    for n in range(1, 70):
        yield from (" " * n, "a" * n, " " * n + "a", "=" * n, "." * n, "\n" * n)
    yield from ("ab" * 3000 + "x" * 5000, "<s> </s> <unk> <0x41>", "ﬁ é ① 　", "é" * 40)


def test_op12_encoder_is_the_librarys():
    model = piece_bpe.Model(MODEL)
    encoder = piece_bpe.TextEncoder(model)
    tiny = piece_bpe.TextEncoder(model, limit=1)
    for t in texts_for_pieces():
        want = model.library.encode(t)
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == want
        if len(t) < 30:
            assert np.frombuffer(tiny.encode(t), "<u4").tolist() == want


def test_op12_backtracks_and_agrees_with_merging():
    rng = random.Random(6)
    failed = 0
    for _ in range(200):
        names = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 5))) for _ in range(rng.randrange(2, 12))}
        encoder = piece_bpe.BacktrackingEncoder({p: -float(i) for i, p in enumerate(sorted(names, key=lambda _: rng.random()))})
        for _ in range(30):
            t = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 20)))
            assert encoder.cut(t) == encoder.merged(t)
            longest = 0
            while longest < len(t) and any(t.startswith(p, longest) for p in encoder._shorter):
                longest += max(len(p) for p in encoder._shorter if t.startswith(p, longest))
            failed += longest == len(t) and len(encoder.cut(t)) > 1
    assert failed


def test_op12_decoder_is_the_librarys():
    model = piece_bpe.Model(MODEL)
    decoder, rng = piece_bpe.Decoder(model), random.Random(8)
    for low, high in ((3, 32000), (0, 400), (3, 131), (259, 275), (0, 32000)):
        for _ in range(1500):
            ids = [rng.randrange(low, high) for _ in range(rng.randrange(8))]
            assert decoder.decode(ids) == model.library.decode(ids)
            assert decoder.decode([*ids, model.end]) == model.library.decode([*ids, model.end])


def test_op12_query_and_odd_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = [None, "", " ", "the cat", "the cat", "x" * 3000 + " y", "word " * 5000, "ab\0cd", "é\n\n  日本 😀", "</s>"]
    extra = spark.createDataFrame([*[(10_000 + i, t) for i, t in enumerate(odd)], (None, "a"), (None, None)], "doc_id long, text string")
    docs.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    library = piece_bpe.Model(MODEL).library
    text = {r["doc_id"]: r["text"] for r in docs.unionByName(extra).where("doc_id IS NOT NULL").collect()}
    got = piece_bpe.query(spark, str(tmp_path)).collect()
    assert len(got) == len(text) + 2
    for r in got:
        if r["doc_id"] is not None:
            ids = library.encode(text[r["doc_id"]] or "", add_eos=True)
            assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    clash = extra.withColumns({"ids": F.lit(1), "decoded": F.lit(2)})
    plain = piece_bpe.decode(piece_bpe.encode(clash, MODEL, end=False), MODEL)
    assert plain.columns == ["doc_id", "text", "ids", "decoded"] and all(r["decoded"] == (r["text"] or "") for r in plain.collect())
    assert piece_bpe.encode(extra.limit(0), MODEL).count() == 0
    assert [r["decoded"] for r in piece_bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), MODEL).collect()] == [""]


LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def brute_spelling(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            n[run if h % 31 else run[:at] + run[at + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    holes, near = defaultdict(set), defaultdict(set)
    for w in n:  # two words one edit apart share one with a hole in it, or one is the other with a letter less
        for k in range(len(w)):
            holes[w[:k] + "\0" + w[k + 1 :]].add(w)
            if (less := w[:k] + w[k + 1 :]) in n:
                near[w].add(less)
                near[less].add(w)
    for words in holes.values():
        for w in words:
            near[w] |= words - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def rows_of(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_op13_query_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = brute_spelling([tuple(r) for r in docs.collect()])
    got = spelling.query(spark, SF)
    assert got.count() == len(want) and rows_of(got) == want


def test_op13_chains_ties_and_odd_texts(spark):
    words = {"aaaaaaa": 1200, "aaaaaaab": 100, "aaaaaab": 9, "aaaaaabb": 2, "ÉCOLESÉ": 3, "École÷é": 2, "ecolesé": 1, "beginning": 2, "begininng": 30, "Begining": 30, "beginninG": 1}
    rows = [(7, " ".join([w] * k)) for w, k in words.items()]
    rows += [(None, "nameless nameless nameless1nameless"), (None, None), (3, None), (4, ""), (5, "short words 1234567890123"), (6, "x" * 5000 + " " + "x" * 5000), (6, "x" * 4999 + "y"), (6, "x" * 4999 + "y")]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    want = brute_spelling(rows)
    got = spelling.variants(df)
    assert got.count() == len(want) and rows_of(got) == want
    assert any(r[2] not in (r[0], r[1]) for r in want)  # a chain of two forms
    assert rows_of(spelling.variants(df.limit(0))) == set()


def test_op13_a_full_bit_table_changes_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    words = spelling.written(spelling.vocabulary(docs), "words")
    want = {tuple(r) for r in spelling.forms(words).collect()}
    monkeypatch.setattr(spelling, "LEAST_BITS", 15)
    monkeypatch.setattr(spelling, "MOST_BITS", 15)  # more words than its bits are made for
    assert {tuple(r) for r in spelling.forms(words).collect()} == want


@pytest.mark.parametrize("at_once", [1, 7, 400_000])
def test_neighbourhoods_are_whole_and_distinct(monkeypatch, at_once):
    monkeypatch.setattr(spelling, "AT_ONCE", at_once)
    alphabet = "abc"
    for word in ("a", "aab", "abca", "bbbb"):
        codes = np.array([[ord(c) for c in word]], np.uint64)
        hashes = {}
        for length in (len(word) - 1, len(word), len(word) + 1):
            for i in range(3**length):
                w = "".join(alphabet[i // 3**k % 3] for k in range(length))
                hashes[int(spelling._hashes(np.array([[ord(c) for c in w]], np.uint64).reshape(1, length))[0])] = w
        found = []
        for h, out, *_ in spelling.neighbours(codes, np.array([ord(c) for c in alphabet], np.uint64)):
            found += [hashes[int(x)] for x in h[~np.broadcast_to(out, h.shape)]]
        want = {word[:k] + word[k + 1 :] for k in range(len(word))} | {word[:k] + c + word[k + j :] for k in range(len(word) + 1) for c in alphabet for j in (0, 1) if k + j <= len(word)}
        assert sorted(found) == sorted(want - {word})


def test_op9_where_ids_are_null_or_repeat(spark):
    from lodestack.llm import warc

    rows = [(1, "u", "same"), (2, "u", "same"), (None, "u", "same"), (3, "u", None), (4, None, ""), (5, "u", "own"), (5, "u", "other"), (5, "u", "same"), (None, "u", "alone")]
    got = warc.read(warc.write(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, _d int"))).collect()
    assert len(got) == len(rows)
    shown = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got), key=repr)
    want = [(1, 4, "revisit", 5), (2, 4, "revisit", 5), (5, 4, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 3, "response", None), (5, 5, "response", None), (None, 4, "revisit", 5), (None, 5, "response", None)]
    assert shown == sorted(want, key=repr)
