"""Operator 8: secret scans with a random forest that removes false positives.

Patterns propose candidates: known key formats, private key blocks, values assigned to telling names, long mixed tokens. A random
forest (Spark ML) trained on labelled findings then tells secrets from checksums, ids, placeholders and ordinary words, by length, character
transitions, dictionary coverage, the path and the neighbouring words. Labelled findings are a table (candidate, before, after, path,
is_secret); ``labelled_findings`` makes one by rule, of a fixed bounded size, where no real one is at hand. The trained trees are a
few thousand numbers, sent to tasks as arrays; each task scans, judges and, if asked, masks its texts in one pass without a shuffle.

Cases: null and empty texts have no findings; all candidates are judged, also
overlapping ones; overlapping secrets are one, from the first begin to the last end, under the rule of the longest; rejected candidates that
overlap a secret go, of the others the one that begins first stays, of these the longest; very long texts are scanned
whole and secrets have no greatest length; repeated rows are scanned each; an empty table gives an empty table; other columns stay with ``mask``.
"""

from __future__ import annotations

import bisect
import itertools
import math
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ship

#: Telling names; what follows a closing quote; what is not a value but a name with its own to come.
_TELLING = r"pass(?:word|wd)?|pwd|secret|token|api[_-]?key|auth|bearer|credential|private[_-]?key|access[_-]?key"
_CLOSED = r"[\s,;:)}\]>/\"'&]|\Z"
_OTHER_NAME = rf"(?i:(?:{_TELLING})[\w-]*+[\"']?\s{{0,3}}[:=])"
_MIXED, _SCHEME = r"(?:[0-9!@#$%^&*]|[a-z][A-Z])", r"(?:(?i:basic|bearer|token)\s{1,3})?"
# a value in quotes ends at the same quote unless that is escaped, and may hold spaces; any other ends at white space
_QUOTED = rf"(?:[bfruBFRU]{{1,2}}(?=[\"']))?(?P<q>[\"'])%s{_SCHEME}(?!{_OTHER_NAME})(?P<w>(?:\\.|(?!(?P=q))[^\\\n])*+)(?P=q)"
_OPEN = rf"[\"']?{_SCHEME}(?![\"'])(?!{_OTHER_NAME})(?P<v>(?=[^\s]{{6}})[^\s\"']++(?:[\"'](?!{_CLOSED})[^\s\"']*+)*+)"
#: Candidate patterns by rule. The value is the group named v or w, or all. Values have no greatest length: their runs
#: are possessive and begin once each, so the time stays in proportion to the text.
RULES = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?!-----)[\s\S]){16}[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----",
    "aws_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}+",
    "slack_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "google_key": r"\bAIza[A-Za-z0-9_-]{35}",
    "stripe_key": r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "url_password": r"://(?<=[A-Za-z0-9+.-]{2}://)[^\s:/@]*+:(?!\d{1,5}[/?#])(?P<v>(?:(?!://)[^\s\"'<>]){3,})@(?=[\w\[])",
    "assigned": rf"(?<![\w-])(?=[\w-]*?(?i:{_TELLING}))[\w-]++(?:[\"']?\s{{0,3}}[:=]{{1,2}}>?\s{{0,3}}(?:{_QUOTED % ''}|{_OPEN})|[ \t](?:{_QUOTED.replace('<q>', '<q2>').replace('<w>', '<w2>').replace('P=q', 'P=q2') % f'(?=[^\"\'\\n]*{_MIXED})'}|[\"']?(?=[^\s\"']*{_MIXED}){_OPEN.replace('<v>', '<v2>')}))",
    "long_token": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}+",
}
#: Words whose nearness speaks for a secret, against one; path parts against one; common words of code and prose.
FOR = ("token", "secret", "password", "passwd", "pwd", "key", "auth", "bearer", "credential", "login", "apikey", "access", "private", "authorization")
AGAINST = ("sha1", "sha256", "md5", "checksum", "digest", "hash", "commit", "revision", "integrity", "uuid", "guid", "example", "sample", "test", "dummy", "placeholder", "fake", "your", "changeme", "etag", "version", "isbn", "doi", "build", "id")
QUIET_PATHS = ("test", "spec", "fixture", "example", "sample", "doc", "vendor", "lock", "node_modules", "mock")
WORDS = (
    "able about access account action add address admin after all and any api app are array auth base before body build button call can change check class client close code "
    "color column come config content count create current data date day default delete description do document down each edit element end enter error event example false field "
    "file find first for form format from function get go group has have header home how html http if image import in index info input insert instance is item key label last left "
    "length level line link list load local log login make map max menu message method min mode model module more move name new next node not number object of off on open option or "
    "order out page parent part password path place point post print process project property public query read remove request response result return right row run sample save search "
    "secret section select server service session set show size source start state status step stop string style submit system table tag target test text the this time title to token "
    "true type update url use user value view was web when width will window with word work world you your"
).split()
_WORDS = frozenset(w for w in WORDS if len(w) >= 3)
_RULES = [(k, re.compile(v)) for k, v in RULES.items()]
_ASSIGNED = list(RULES).index("assigned")
_SEGMENT = re.compile("[^=]+={0,2}")
_NEAR, _NAME = 48, re.compile(r"[A-Za-z0-9]+")
MASK = "[secret]"


def candidates(text: str | None) -> list[tuple[int, int, int]]:
    """(begin, end, rule) of each candidate, by begin; they may overlap."""
    found = set()
    for r, (name, pattern) in enumerate(_RULES):
        groups = [g for g in ("v", "w", "v2", "w2") if g in pattern.groupindex]
        for m in pattern.finditer(text or ""):
            g = next((g for g in groups if m[g] is not None), 0)
            if name == "long_token" and "=" in m.group():
                found.update(_behind_names(m.start(), m.group(), r))
            elif name != "assigned" or m.end(g) - m.start(g) >= 6:
                found.add((m.start(g), m.end(g), r))
    return sorted(found, key=lambda x: (x[0], -x[1], x[2]))


def _behind_names(at: int, run: str, rule: int):
    """A run NAME=value is a candidate behind the name, short values as assigned ones; the name is one too if it is a long token itself."""
    for i, m in enumerate(_SEGMENT.finditer(run)):
        n = m.end() - m.start()
        if n >= 20 and (i or any(c.isdigit() for c in m.group())):
            yield at + m.start(), at + m.end(), rule
        elif i and n >= 6:
            yield at + m.start(), at + m.end(), _ASSIGNED


def settled(judged: list[tuple[int, int, int, float]], least: float) -> list[tuple[int, int, int, float]]:
    """Of one text's judged candidates those that stay, none overlapping."""
    order = lambda x: (x[0], -x[1], x[2])
    secrets, longest = [], 0
    for b, e, r, p in sorted((x for x in judged if x[3] >= least), key=order):
        if secrets and b < secrets[-1][1]:
            begin, end, rule, q = secrets[-1]
            secrets[-1] = (begin, max(end, e), r, p) if e - b > longest else (begin, max(end, e), rule, q)
            longest = max(longest, e - b)
        else:
            secrets.append((b, e, r, p))
            longest = e - b
    begins, out, last = [x[0] for x in secrets], list(secrets), -1
    for b, e, r, p in sorted((x for x in judged if x[3] < least), key=order):
        k = bisect.bisect_left(begins, e)
        if b >= last and not (k and secrets[k - 1][1] > b):
            out.append((b, e, r, p))
            last = e
    return sorted(out)


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def features(value: str, before: str, after: str, path: str | None, rule: int) -> list[float]:
    """Length, character transitions, dictionary coverage, path, neighbouring words, and the rule."""
    n = max(len(value), 1)
    kinds = [_kind(c) for c in value]
    steps = [0] * 16
    for a, b in zip(kinds, kinds[1:]):
        steps[4 * a + b] += 1
    lower, covered, i = value.lower(), 0, 0
    while i < len(lower):
        k = next((k for k in range(min(11, len(lower) - i), 2, -1) if lower[i : i + k] in _WORDS), 0)
        covered += k
        i += k or 1
    counts = [value.count(c) for c in set(value)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    near = {w.lower() for w in _NAME.findall(before)} | {w.lower() for w in _NAME.findall(after)}
    hexes = sum(c in "0123456789abcdefABCDEF" for c in value) / n
    shape = float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value)))
    last = [w.lower() for w in _NAME.findall(before)][-2:]
    return [
        math.log(n), entropy, len(counts) / n, hexes, shape, covered / n, value.count("-") / n, value.count("_") / n,
        *(kinds.count(k) / n for k in range(4)), *(s / n for s in steps),
        float(any(f in w for w in near for f in FOR)), float(any(f in w for w in last for f in FOR)),
        float(any(w in AGAINST for w in near)), float(any(w in AGAINST for w in last)), float(any(a in lower for a in ("example", "changeme", "your", "xxxx", "sample", "dummy"))),
        float(any(q in (path or "").lower() for q in QUIET_PATHS)), float("=" in before[-4:] or ":" in before[-4:]), float(rule == len(_RULES) - 1),
    ]


def labelled_findings(n: int = 4000, seed: int = 7) -> list[tuple[str, str, str, str, int]]:
    """(value, before, after, path, is_secret): ``n`` findings made by rule, half of them secrets."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexes, mixed = "0123456789abcdef", string.ascii_letters + string.digits
    prose = lambda: " ".join(pick("etaoinshrdlu", r.randint(2, 9)) for _ in range(r.randint(2, 6)))
    leet = lambda w: w.translate(str.maketrans("aeiost", "431057"))
    word = lambda: r.choice([str, str, str.title, leet])(r.choice([r.choice(WORDS), pick("etaoinshrdlu", r.randint(4, 8))]))
    chosen = lambda: "".join([word() + pick("!@#$%^&*", r.randint(0, 1)), pick(string.digits, r.randint(1, 4)), r.choice([word, lambda: pick("!@#$%^&*", 1)])()])
    out = []
    for i in range(n):
        secret = i % 2
        if secret:
            value = r.choice([
                lambda: pick(hexes, r.choice([32, 40, 64])), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(mixed, 36),
                lambda: pick(mixed + "+/", r.randint(24, 64)), lambda: "sk_live_" + pick(mixed, 24), lambda: pick(mixed + "!@#$%^&*", r.randint(8, 20)),
                lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(mixed, 24), lambda: "eyJ" + pick(mixed, 20) + "." + pick(mixed, 40) + "." + pick(mixed, 43),
                lambda: chosen().rjust(6, "7"),
            ])()
            name = r.choice(["token", "secret", "password", "api_key", "apikey", "auth_token", "access_key", "client_secret", "DB_PASSWORD", "private_key", "Authorization: Bearer"])
            before = prose() + r.choice([" ", "\n"]) + name + r.choice([" = \"", "=\"", ": \"", " = '", "=", ": ", " "])
            path = r.choice(["config/settings.py", "deploy/env.sh", "src/client.js", ".env", "main.tf", ""])
            if not set(value) & set("/@") and r.random() < 0.1:
                before = prose() + r.choice([" ", "\"", "="]) + r.choice(["redis", "postgres", "https", "ftp", "amqp", "mysql"]) + "://" + r.choice(["", "", pick("etaoinshrdlu", 5)]) + ":"
                out.append((value, before[-_NEAR:], ("@" + pick("etaoinshrdlu", 6) + r.choice(["", ":80", ".com/x", "\" " + prose()]))[:_NEAR], path, secret))
                continue
        else:
            kind = r.randrange(9)
            value = [
                lambda: pick(hexes, r.choice([32, 40, 64])), lambda: "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)),
                lambda: "_".join(r.choice(WORDS) for _ in range(r.randint(4, 7))) + str(r.randint(1, 99)), lambda: r.choice(["your", "example", "changeme", "dummy", "sample"]) + r.choice(["_", "-"]) + r.choice(["api-key", "token", "password"]) + "-" + pick("x0", 6),
                lambda: pick(string.digits, r.randint(20, 30)), lambda: "-".join(r.choice(WORDS) for _ in range(r.randint(4, 8))) + "-" + pick(string.digits, 4), lambda: "/".join(r.choice(WORDS) for _ in range(5)) + "/" + pick(string.digits, 3),
                lambda: r.choice([str, str.title])(pick("etaoinshrdlu", r.randint(5, 12))) + r.choice(["", ".", ",", ";"]),
                lambda: r.choice(["%s.%s", "%s_%s", "%s(%s)", "${%s_%s}", "<%s-%s>", "{{%s.%s}}", "$%s%s", "%s[%s]", "%s['%s", "%s::%s;", "%s.%s(),"]) % (r.choice(WORDS), r.choice([str, str.title])(r.choice(WORDS))),
            ][kind]()
            name = r.choice(["password", "token", "api_key"]) if kind in (3, 7, 8) else r.choice(["sha256", "sha1", "md5", "commit", "checksum", "integrity", "revision", "uuid", "digest", "id", "etag", "build"]) if kind < 2 else r.choice(["see", "title", "id", "url", "version", "name", "order"])
            before = prose() + " " + name + r.choice([" = \"", ": ", " ", "=", ":"])
            path = r.choice(["tests/fixtures/data.json", "package.lock", "docs/guide.md", "src/app.py", "vendor/x.js", ""])
        out.append((value, before[-_NEAR:], r.choice(["\"", "", " " + prose()])[:_NEAR], path, secret))
    return out


class Forest:
    """Trees as arrays, for batches of feature rows."""

    def __init__(self, trees: list[list[tuple[int, float, int, int, float]]]):
        self._trees = [[np.array(c) for c in zip(*t)] for t in trees]

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, value in self._trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                f = np.maximum(feature[at], 0)
                step = np.where(x[np.arange(len(x)), f] <= threshold[at], left[at], right[at])
                at = np.where(inner, step, at)
            total += value[at]
        return total / len(self._trees)


def train(spark: SparkSession, findings: list[tuple[str, str, str, str, int]] | None = None, trees: int = 20, depth: int = 8) -> Forest:
    """Fits Spark ML's random forest to labelled findings and takes its trees."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = [(features(v, b, a, p, _rule_of(v)), float(y)) for v, b, a, p, y in (findings or labelled_findings())]
    table = spark.createDataFrame(rows, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label").coalesce(2)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=1).fit(table)
    return Forest([_nodes(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode")) for t in model.trees])


def _rule_of(value: str) -> int:
    return next((r for r, (k, p) in enumerate(_RULES) if k not in ("url_password", "assigned") and p.fullmatch(value)), len(_RULES) - 2)


def _nodes(root) -> list[tuple[int, float, int, int, float]]:
    """(feature or -1, threshold, left, right, probability of a secret) of each node, the root first."""
    out: list = []

    def add(node) -> int:
        at = len(out)
        out.append(None)
        if node.getClass().getSimpleName() == "LeafNode":
            s = node.impurityStats().stats()
            out[at] = (-1, 0.0, 0, 0, float(s[1]) / max(float(s[0]) + float(s[1]), 1e-12))
        else:
            split = node.split()
            out[at] = (int(split.featureIndex()), float(split.threshold()), add(node.leftChild()), add(node.rightChild()), 0.0)
        return at

    add(root)
    return out


def _judged(forest: Forest, texts: list[str | None], paths: list[str | None], least: float = 0.5):
    """(row, begin, end, rule, probability) of the candidates of a batch that stay, in order."""
    at, x = [], []
    for i, t in enumerate(texts):
        for b, e, r in candidates(t):
            at.append((i, b, e, r))
            x.append(features(t[b:e], t[max(0, b - _NEAR) : b], t[e : e + _NEAR], paths[i], r))
    p = forest.probability(np.array(x)) if x else []
    rows = itertools.groupby(zip(at, p), key=lambda y: y[0][0])
    return [(i, *y) for i, some in rows for y in settled([(*a[1:], float(q)) for a, q in some], least)]


def scan(df: DataFrame, forest: Forest, doc_id: str = "doc_id", text: str = "text", path: str | None = None, least: float = 0.5) -> DataFrame:
    """A row per candidate that stays: doc_id, begin and end (characters), rule, probability, is_secret."""
    spark = df.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(forest)

    def run(batches):
        for b in batches:
            ids = b.column(0)
            rows = _judged(sent.value, b.column(1).to_pylist(), b.column(2).to_pylist(), least)
            i, begin, end, rule, p = zip(*rows) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(i, pa.int64())), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array([_RULES[r][0] for r in rule], pa.string()), pa.array(p, pa.float64()), pa.array([q >= least for q in p], pa.bool_())],
                ["doc_id", "begin", "end", "rule", "probability", "is_secret"],
            )

    cols = [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), (F.col(path) if path else F.lit(None)).cast("string").alias("path")]
    return df.select(*cols).mapInArrow(run, "doc_id long, begin int, end int, rule string, probability double, is_secret boolean")


def mask(df: DataFrame, forest: Forest, text: str = "text", path: str | None = None, least: float = 0.5) -> DataFrame:
    """``df`` with each secret in ``text`` replaced; rows and columns stay as they are."""
    spark = df.sparkSession
    ship(spark)
    sent, at, names = spark.sparkContext.broadcast(forest), df.columns.index(text), df.columns
    where = df.columns.index(path) if path else None

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            paths = b.column(where).cast(pa.string()).to_pylist() if where is not None else [None] * len(texts)
            found = (r for r in _judged(sent.value, texts, paths, least) if r[4] >= least)
            for i, spans in itertools.groupby(found, key=lambda r: r[0]):
                kept, at_end = [], 0
                for _, begin, end, _, _ in spans:
                    kept.append(texts[i][at_end:begin])
                    at_end = end
                texts[i] = MASK.join([*kept, texts[i][at_end:]])
            cols = list(b.columns)
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return df.mapInArrow(run, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8_secret_scan: the candidates of every whole text, with the forest's verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, train(spark))
