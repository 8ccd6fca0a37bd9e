"""Toxicity by noisy-channel deobfuscation.

A character model of the corpus (trigrams over all documents) is the source; the channel writes letters as
look-alikes, spaces them out, joins words, or repeats letters. Tokens that aren't plain letters or hold a doubled
letter, and rows of single characters, are decoded by Viterbi over the lattice of what each character may stand
for: a letter, one more of a repeated letter, nothing, or the end of a word. The restored text is scored by a word
and word-start model that is fitted on labelled documents outside the held-out third.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.llm.common import fresh, in_batches, staged

# What a character may stand for besides itself.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¥": "y",
    "*": "aeiou", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i",
}
#: Characters that the channel may put between letters.
FILLERS = set(".-_*~'`^,:;/\\#%&=​­")
#: Letters of the model; all others are the one symbol between words.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäãåçèéêëìíîïñòóôöõøùúûüýÿæœß"
N = len(LETTERS) + 1
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
#: Costs of the channel, in natural logarithms: a letter as it is, a look-alike, a filler or a space within a word or between two, one more of a repeated letter.
KEEP, SWAP, DROP, SPACED, PART, AGAIN = 0.0, 1.0, 0.2, 0.3, 4.0, 0.7

#: The classifier is fitted on at most so many labelled documents, those of the smallest hashes.
SAMPLE = 20_000
#: A feature counts if at least so many toxic documents of the sample hold it and its weight reaches LEAST.
SUPPORT, LEAST = 3, 1.0
STARTS = (4, 5, 6, 7)
#: Restored words count by features of at least this weight; weaker evidence has to stand in the text as it is.
STRONG = 3.0
#: Of these features, the model keeps so many at most, those of the most evidence.
FEATURES = 100_000
THRESHOLD = 0.7
#: Weighed tokens that a task remembers.
CACHE = 100_000

#: Three or more single characters in a row.
_SINGLES = re.compile(r"(?<!\S)\S(?:\s{1,2}\S){2,}(?!\S)")
_PARTS = re.compile(r"[^\W\d_]+")
_DOUBLED = re.compile(r"(.)\1")
_EDGE = ".,;:!?\"'()[]{}<>|&%$#*-_"


# --- source model ---------------------------------------------------------------------------------------------

_LUT = np.zeros(256 * 256, np.uint8)
for _c, _i in CODE.items():
    _LUT[ord(_c)] = _i
    if len(_c.upper()) == 1:
        _LUT[ord(_c.upper())] = _i


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of all letter trigrams, words being parted by code 0. Lines of texts are joined by a parting symbol."""
    raw = np.frombuffer("\n".join(texts).encode("utf-16-le", "surrogatepass"), np.uint16)
    code = _LUT[raw].astype(np.int64)
    code = np.concatenate([[0, 0], code, [0]])
    code = code[np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)])]  # one symbol between words
    code = np.repeat(code, 1 + (code == 0))  # and two as context of a first letter
    if len(code) < 3:
        return np.zeros(N**3, np.int64)
    return np.bincount((code[:-2] * N + code[1:-1]) * N + code[2:], minlength=N**3)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(N**3, np.int64)
    for b in batches:
        for lo in range(0, b.num_rows, 500):
            total += trigram_counts([t for t in b.column(0).slice(lo, 500).to_pylist() if t])
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(letter | two before) over every document; at most N ** 3 sums, whatever the corpus, come to the driver."""
    rows = in_batches(docs.select("text"), _count_rows, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(N**3)
    for r in rows:
        count[r["gram"]] = r["n"]
    return log_model(count)


def log_model(count: np.ndarray) -> np.ndarray:
    """Interpolated trigram, bigram and unigram probabilities, in logarithms."""
    tri = count.reshape(N, N, N)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1)) + 1.0
    p1 = uni / uni.sum()
    p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
    p3 = (tri + 5 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 5)
    return np.log(p3)


# --- channel and decoder --------------------------------------------------------------------------------------


_ARCS = {c: [(CODE[x], SWAP) for x in LOOKALIKES.get(c, "")] + ([(CODE[c], KEEP)] if c in CODE else []) for c in {*LOOKALIKES, *CODE}}


@functools.lru_cache(4096)
def arcs_of(c: str) -> tuple[list[tuple[int, float]], float | None]:
    """(letter, cost) of what a lower-case character may stand for, and the cost of its standing for nothing (None: it can't)."""
    arcs = _ARCS.get(c, [])
    return arcs, SPACED if c.isspace() else DROP if c in FILLERS or not arcs else None


def restore(token: str, model: np.ndarray | list) -> str:
    """The likeliest words behind lower-case characters: Viterbi over (last two letters, character that gave the last one).

    Fillers, spaces and unknown characters may also end a word. Paths are linked lists that share what they have in
    common, so the memory grows with the length alone, and no length is too long.
    """
    lm = model if isinstance(model, list) else model.tolist()
    states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
    for c in token:
        arcs, nothing = arcs_of(c)
        nxt: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
        for (a, b, last), (cost, path) in states.items():
            row = lm[a][b]
            offers = [((b, k, c), cost + price - row[k], (path, k)) for k, price in arcs]
            if nothing is not None:
                offers.append(((a, b, last), cost + nothing, path))
                offers.append(((0, 0, ""), cost + PART - row[0], (path, 0)) if b else ((0, 0, ""), cost, path))
            if last == c:
                offers.append(((a, b, last), cost + AGAIN, path))
            for state, price, way in offers:
                if state not in nxt or price < nxt[state][0]:
                    nxt[state] = price, way
        states = nxt
    _, path = min(((cost - (lm[a][b][0] if b else 0.0), path) for (a, b, _), (cost, path) in states.items()), key=lambda x: x[0])
    out = []
    while path:
        path, k = path
        out.append(LETTERS[k - 1] if k else " ")
    return "".join(reversed(out)).strip()


def is_suspect(token: str) -> bool:
    """Whether a lower-case token may stand for other words than it shows."""
    return not token.isalpha() or bool(_DOUBLED.search(token))


def _readings(token: str) -> list[str]:
    """What is decoded of a token: itself, without marks at its edges, with and without those that may be letters."""
    return [t for t in dict.fromkeys((token.strip(_EDGE), token.strip(".,;:?\"'[]"))) if t and is_suspect(t)]


def spaced_rows(low: str) -> list[str]:
    return [" ".join(m[0].split()) for m in _SINGLES.finditer(low)]


def words_behind(token: str, lm: list) -> tuple[str, ...]:
    """The letters of a token as they stand and, of a suspect one, the words restored."""
    plain = _PARTS.findall(token)
    for t in _readings(token):
        plain += restore(t, lm).split()
    return tuple(dict.fromkeys(plain))


def text_words(text: str, lm: list, cache: dict[str, tuple[str, ...]]) -> set[str]:
    """All words of a text, as they stand and restored."""
    low = text.lower()
    seen: set[str] = set()
    for token in [*low.split(), *spaced_rows(low)]:
        got = cache.get(token)
        if got is None:
            if len(cache) >= CACHE:
                cache.clear()
            got = cache[token] = words_behind(token, lm)
        seen.update(got)
    return seen


class Shapes:
    """Tells which tokens can't be restored to a word that has a weight, without decoding them.

    Characters that may stand for one another form one class, and a class in a row counts once. Whatever a token is
    restored to has the token's classes, so a weighted feature can only be the start of a word in it if its classes
    are there, after the token's start or a place where a word may end.
    """

    def __init__(self, features: list[str]) -> None:
        up: dict[str, str] = {}

        def top(c: str) -> str:
            while up.get(c, c) != c:
                c = up[c]
            return c

        for c, stand in LOOKALIKES.items():
            for x in stand:
                up[top(c)] = top(x)
        self.table = {ord(c): top(c) for c in {*LOOKALIKES, *CODE}}
        self.gap = re.compile("[^" + re.escape("".join(sorted({*LOOKALIKES, *CODE} - FILLERS))) + "]+")
        self.known = {x for x in (self._shape(f.removesuffix("$")) for f in features) if x}
        self.sizes = sorted({len(x) for x in self.known})

    def _shape(self, letters: str) -> str:
        return re.sub(r"(.)\1+", r"\1", letters.translate(self.table))

    def may_hold(self, token: str) -> bool:
        if not self.sizes:
            return False
        ways = [token]
        for c in FILLERS & set(LOOKALIKES) & set(token):  # these may be letters too
            ways += [w.replace(c, "a" if c == "*" else LOOKALIKES[c][0]) for w in ways]
        for way in ways:
            parts = [p for p in self.gap.split(way) if p]
            for i in range(len(parts)):
                have, j = "", i
                while j < len(parts) and len(have) < self.sizes[-1]:
                    have = self._shape(have + parts[j])
                    j += 1
                if any(have[:n] in self.known for n in self.sizes):
                    return True
        return False


# --- classifier -----------------------------------------------------------------------------------------------


def features_of(word: str) -> list[str]:
    return [word + "$", *(word[:k] for k in STARTS if len(word) >= k)]


def _feature_rows(model: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        lm = model.tolist()
        for b in batches:
            bad, good = Counter(), Counter()
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (bad if toxic else good).update({f for w in text_words(text or "", lm, cache) for f in features_of(w)})
            names = list(bad.keys() | good.keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([bad[x] for x in names], pa.int64()), pa.array([good[x] for x in names], pa.int64())], names=["feature", "bad", "good"])

    return rows


class Scale:
    """Weighs texts: the weight of a token is the largest one of its words' features."""

    def __init__(self, model: np.ndarray, weights: dict[str, float]) -> None:
        self.lm, self.weights = model.tolist(), weights
        self.strong = {f: w for f, w in weights.items() if w >= STRONG}
        self.shapes = Shapes(list(self.strong))
        self.met: dict[str, float] = {}

    def token(self, token: str) -> float:
        best = max((self.weights.get(f, 0.0) for w in _PARTS.findall(token) for f in features_of(w)), default=0.0)
        for t in _readings(token):
            if self.shapes.may_hold(t):
                best = max(best, *(self.strong.get(f, 0.0) for w in restore(t, self.lm).split() for f in features_of(w)), 0.0)
        return best

    def weigh(self, text: str | None) -> tuple[float, float, int]:
        """Sum of token weights, the largest one, and the number of tokens."""
        low, met = (text or "").lower(), self.met
        tokens = low.split()
        total, top, n = 0.0, 0.0, len(tokens)
        for token in tokens + spaced_rows(low):
            x = met.get(token)
            if x is None:
                if len(met) >= CACHE:
                    met.clear()
                x = met[token] = self.token(token)
            if x:
                total += x
                top = max(top, x)
        return total, top, n


def _inputs(total: np.ndarray, top: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Columns of the logistic model: evidence, evidence against length, and the strongest word."""
    return np.stack([np.ones_like(total), np.log1p(total), total / np.sqrt(n + 25.0), top, np.minimum(total, 10.0)], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps."""
    w = np.zeros(x.shape[1])
    pen = np.eye(x.shape[1]) * ridge
    pen[0, 0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pen @ w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + pen
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _weigh_rows(model: np.ndarray, weights: dict[str, float]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = Scale(model, weights)
        for b in batches:
            got = [scale.weigh(t) for t in b.column(0).to_pylist()]
            s, m, n = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(s, pa.float64()), pa.array(m, pa.float64()), pa.array(n, pa.int64())], names=["toxic", "total", "top", "n"])

    return rows


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, dict[str, float], np.ndarray]:
    """Character model, feature weights and logistic weights. Labels of held-out documents are not read."""
    model = character_model(docs)
    want = labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).filter(~held_out(F.col("doc_id")))
    want = want.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    want = staged(want.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE), "toxicity-sample")
    own = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(want), F.col("_id") == F.col("doc_id"))
    own = staged(own.select("text", (F.col("toxic") > 0).cast("int").alias("toxic")).distinct(), "toxicity-texts")
    n = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad:
        return model, {}, np.array([-4.0, 0, 0, 0, 0])
    rows = in_batches(own, _feature_rows(model), "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    kept = rows.select("feature", "bad", odds.alias("w")).filter((F.col("bad") >= SUPPORT) & (F.col("w") >= LEAST))
    kept = kept.orderBy((F.col("w") * F.col("bad")).desc(), "feature").limit(FEATURES).collect()
    weights = {r["feature"]: r["w"] for r in kept}
    got = in_batches(own, _weigh_rows(model, weights), "toxic int, total double, top double, n long").toPandas()
    x = _inputs(got["total"].to_numpy(float), got["top"].to_numpy(float), got["n"].to_numpy(float))
    return model, weights, fit_logistic(x, got["toxic"].to_numpy(float))


def _score_rows(model: np.ndarray, weights: dict[str, float], coef: np.ndarray, text_at: int, names: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = Scale(model, weights)
        for b in batches:
            got = np.array([scale.weigh(t) for t in b.column(text_at).to_pylist()], float).reshape(-1, 3)
            z = np.clip(_inputs(*got.T) @ coef, -30, 30)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-z)))], names=names)

    return rows


def scored(docs: DataFrame, labels: DataFrame, score: str = "score") -> DataFrame:
    """docs with one more column, the score in 0..1; all columns of docs pass through.

    Null and empty texts get the score of no evidence; rows alike get equal scores; without toxic labels every
    score is low; an empty table gives an empty result.
    """
    model, weights, coef = train(docs, labels)
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    rows = _score_rows(model, weights, coef, docs.columns.index("text"), [*docs.columns, score])
    return in_batches(docs, rows, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs; a null doc_id isn't held out. For all else see scored."""
    got = scored(docs.select("doc_id", "text"), labels)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted to be toxic, with the columns of docs. For null, empty and repeated rows see scored."""
    name = fresh("score", docs)
    return scored(docs, labels, name).filter(F.col(name) < THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])
