"""Toxicity by a subsequence string kernel (operator 12).

Two strings are as alike as the letter triples that both hold in order, gaps allowed and the two ends being letters too: each occurrence weighs
``DECAY`` to the power of the span that it takes, and the kernel of two strings is the product sum of these weights over all triples,
divided by the strings' own. So an insult with letters put in or left out stays near the insult itself. The support
vector machine works on Nyström features: kernels to ``LANDMARKS`` landmark strings, whitened by the kernel among
them. Since triples are explicit, its decision folds into one weight for each triple (``TRIPLES`` of them): a string costs as many
look-ups as it has triples, whatever the number of landmarks.

A sentence is read as windows of at most ``WIDTH`` letters: its words, small letters only, a word with signs or digits
in it also without them, and single letters that stand in a row as one word. A sentence is as toxic as its
worst window; a text is judged by the two worst different windows of its sentences, since one may be there by chance. Labels are those of documents, so that training is multiple-instance:
all sentences of clean documents are clean, and of toxic ones those windows are taken that the last round found
most toxic, at first those which documents of that label hold more often than chance explains. Taken windows are also trained with a
letter put in. A logistic curve makes the two decisions a probability.

The model is fitted on at most ``FIT_DOCS`` labelled documents of each label, those of smallest hash, and
``FIT_WINDOWS`` windows of each; all texts are scored, whole.

Defined results: a null or empty text, or one without windows, has the decisions ``FLOOR``, clean ones. Labels are looked up by doc_id; several of one
document count as the largest, null labels not at all, and each row of a repeated id is a document. Without documents of both labels every
text scores the share of label 1, or 0. Texts with equal words score alike. Extra columns are kept. An empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DECAY = 0.5
WIDTH = 24
LETTERS = 64
TRIPLES = LETTERS**3
LANDMARKS = 384
FIT_DOCS = 4000
FIT_WINDOWS = 2000
#: Clean windows in training, at most, at random and hard ones of each round.
CLEAN, HARD = 10_000, 3000
ROUNDS = 3
#: Decisions beyond these count as these.
FLOOR, CEILING = -0.5, 1.25
SLICE = 1 << 20
#: Words whose decisions a task remembers, and words that are worked on at once.
REMEMBERED, PENDING = 300_000, 100_000

_PARTS = re.compile(r"[^\W\d_]+")
_SPELLED = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S)){2,}")
_CUT = re.compile(r"\S\S\s")


def fold(key: Column, folds: int) -> Column:
    """A document's fold; that of a null id is 0."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def windows(word: str) -> list[str]:
    """What is judged of a word."""
    parts = _PARTS.findall(word.lower())
    whole = "".join(parts)
    out = []
    for part in [*parts, whole] if len(parts) > 1 else parts:
        if len(part) <= WIDTH:
            if len(part) >= 3:
                out.append(part)
        else:
            out += [part[i : i + WIDTH] for i in range(0, len(part) - WIDTH // 2, WIDTH // 2)]
    return out


def words(text: str) -> Iterator[set[str]]:
    """Distinct words of a text, by slices; single letters in a row are one word as well."""
    start = 0
    while start < len(text):
        cut = _CUT.search(text, start + SLICE)
        end = cut.end() if cut else len(text)
        part = text[start:end]
        found = set(part.split())
        found.update("".join(m[0].split()) for m in _SPELLED.finditer(part))
        yield found
        start = end


@lru_cache(maxsize=WIDTH + 3)
def _shape(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of all triples of n letters, and their weights."""
    i, j, k = (x.ravel() for x in np.meshgrid(*[np.arange(n)] * 3, indexing="ij"))
    keep = (i < j) & (j < k)
    i, j, k = i[keep], j[keep], k[keep]
    return i, j, k, DECAY ** (k - i + 1).astype(np.float64)


def triples(strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which strings, their triples, weight of each place) for strings of one length at a time, in parts of bounded size."""
    lengths = np.array([len(s) for s in strings], np.int64)
    for n in np.unique(lengths).tolist():
        i, j, k, weight = _shape(n + 2)
        own = np.flatnonzero(lengths == n)
        step = max(1, 500_000 // len(weight))
        for low in range(0, len(own), step):
            at = own[low : low + step]
            points = np.frombuffer("".join([strings[x] for x in at]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), n).astype(np.int64)
            # a to z by themselves, all other letters by a hash, and the two ends
            letter = np.where((points >= 97) & (points <= 122), points - 97, 26 + (points * 40503 >> 4) % (LETTERS - 28)).astype(np.int32)
            letter = np.pad(letter, ((0, 0), (1, 1)), constant_values=((0, 0), (LETTERS - 2, LETTERS - 1)))
            yield at, ((letter * LETTERS**2)[:, i] + (letter * LETTERS)[:, j] + letter[:, k]), weight


def norms(codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The length of each string's vector of triples; places of one triple add up."""
    order = np.argsort(codes, axis=1)
    held = np.take_along_axis(codes, order, 1)
    first = np.ones(held.shape, bool)
    first[:, 1:] = held[:, 1:] != held[:, :-1]
    sums = np.add.reduceat(weight[order].ravel(), np.flatnonzero(first.ravel()))
    return np.sqrt(np.add.reduceat(sums * sums, np.concatenate([[0], np.cumsum(first.sum(1))[:-1]])))


def product(strings: list[str], table: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """Normed triples of each string times a vector, or a matrix whose rows ``place`` names for each triple."""
    out = np.zeros((len(strings), *table.shape[1:]))
    for at, codes, weight in triples(strings):
        size = norms(codes, weight)
        if place is None:
            out[at] = (table[codes] @ weight) / size
        else:
            step = max(1, 2_000_000 // (codes.shape[1] * table.shape[1]))
            for low in range(0, len(at), step):
                out[at[low : low + step]] = np.einsum("bcm,c->bm", table[place[codes[low : low + step]]], weight) / size[low : low + step, None]
    return out


def above(strings: list[str], table: np.ndarray, bias: float, floor: float) -> np.ndarray:
    """``product`` with a bias, where it may be above the floor; else the floor.

    A string's length lies between those that it has if no triple repeats and if all are one, so that it is worked out for few.
    """
    out = np.full(len(strings), floor)
    for at, codes, weight in triples(strings):
        value = table[codes] @ weight
        low, high = np.sqrt((weight * weight).sum()), weight.sum()
        near = np.flatnonzero(np.where(value > 0, value / low, value / high) + bias > floor)
        if len(near):
            out[at[near]] = np.maximum(value[near] / norms(codes[near], weight) + bias, floor)
    return out


def spread(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, triple, weight) of all normed triples."""
    who, what, much = [], [], []
    for at, codes, weight in triples(strings):
        who.append(np.repeat(at, codes.shape[1]))
        what.append(codes.ravel())
        much.append((weight / norms(codes, weight)[:, None]).ravel())
    return np.concatenate(who), np.concatenate(what), np.concatenate(much)


def diverse(pool: list[str], n: int) -> list[str]:
    """At most n strings of the pool that span the others best: a Cholesky factor with pivots, column by column."""
    left, chosen, columns = np.ones(len(pool)), [], []
    while len(chosen) < min(n, len(pool)):
        p = int(np.argmax(left))
        if left[p] < 1e-3:
            break
        one = np.zeros(TRIPLES)
        _, codes, much = spread([pool[p]])
        np.add.at(one, codes, much)
        column = product(pool, one)
        for c in columns:
            column -= c * c[p]
        column /= np.sqrt(left[p])
        columns.append(column)
        left = np.maximum(left - column * column, 0)
        left[p] = 0
        chosen.append(pool[p])
    return chosen


class Nystrom:
    """Features of strings from their kernels to landmarks."""

    def __init__(self, landmarks: list[str]) -> None:
        who, what, much = spread(landmarks)
        held, column = np.unique(what, return_inverse=True)
        self.held, self.place = held, np.full(TRIPLES, len(held))
        self.place[held] = np.arange(len(held))
        self.table = np.zeros((len(held) + 1, len(landmarks)), np.float32)
        np.add.at(self.table, (column, who), much.astype(np.float32))
        values, vectors = np.linalg.eigh(product(landmarks, self.table, self.place))
        keep = values > 1e-6 * values.max()
        self.white = vectors[:, keep] / np.sqrt(values[keep])

    def features(self, strings: list[str]) -> np.ndarray:
        return product(strings, self.table, self.place) @ self.white

    def folded(self, w: np.ndarray) -> np.ndarray:
        """One weight for each triple, so that a string's decision is the sum over its triples."""
        out = np.zeros(TRIPLES)
        out[self.held] = self.table[:-1] @ (self.white @ w)
        return out


def machine(x: np.ndarray, y: np.ndarray, share: np.ndarray, cost: float = 20_000.0) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss by Newton's method, (weights, bias)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        on = y * (x @ w) < 1
        own = x[on] * (cost * share[on])[:, None]
        new = np.linalg.solve(ridge + own.T @ x[on], own.T @ y[on])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def logistic(decisions: np.ndarray, label: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """(slopes, offset) of the curve that makes a text's decisions probabilities; no slope is below 0."""
    n1, n0 = label.sum(), (1 - label).sum()
    goal = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    used = [0, 1]
    while True:
        x, w = np.hstack([decisions[:, used], np.ones((len(decisions), 1))]), np.zeros(len(used) + 1)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (share * (p - goal)) + 1e-6 * w
            w = w - np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(len(w)), slope).clip(-5, 5)
        if (w[:-1] >= 0).all():
            slopes = np.zeros(2)
            slopes[used] = w[:-1]
            return slopes, float(w[-1])
        used.pop(int(np.argmin(w[:-1])))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray | None  # of each triple; None: all texts score alike
    bias: float = 0.0
    slopes: np.ndarray | None = None
    offset: float = 0.0
    rate: float = 0.0

    def decisions(self, strings: list[str]) -> np.ndarray:
        """Of windows; those not above ``FLOOR`` are ``FLOOR``."""
        return above(strings, self.weights, self.bias, FLOOR) if self.weights is not None else np.full(len(strings), FLOOR)

    def probability(self, decisions: np.ndarray) -> np.ndarray:
        """Of each row of the two greatest decisions of a text."""
        if self.weights is None:
            return np.full(len(decisions), self.rate)
        return 1 / (1 + np.exp(-(np.clip(decisions, FLOOR, CEILING) @ self.slopes + self.offset)))


def greatest(values: np.ndarray) -> np.ndarray:
    """The two greatest, filled up."""
    return np.sort(np.concatenate([values, [FLOOR, FLOOR]]))[:-3:-1]


def altered(strings: list[str], rng: np.random.Generator) -> list[str]:
    """The strings, each with a letter put in."""
    out = []
    for s in strings:
        at, sign = int(rng.integers(1, len(s))), "abcdefghijklmnopqrstuvwxyz"[rng.integers(26)]
        out.append((s[:at] + sign + s[at:])[:WIDTH])
    return out


def trained(bags: list[tuple[int, np.ndarray]], strings: list[str], totals: tuple[int, int]) -> Model:
    """The model, from (label, windows by number) of each document and how many of label 0 and 1 there are in all."""
    n0, n1 = (sum(label == y for label, _ in bags) for y in (0, 1))
    rate = totals[1] / max(1, sum(totals))
    if not n0 or not n1 or not strings:
        return Model(None, rate=rate)
    rng = np.random.default_rng(12)
    held = [np.concatenate([own for label, own in bags if label == y]) for y in (0, 1)]
    c, t = (np.bincount(own, minlength=len(strings)).astype(float) for own in held)
    share = n1 / (n0 + n1)
    with np.errstate(divide="ignore", invalid="ignore"):
        evidence = np.where(t > 0, t * np.log(t / ((t + c) * share)), 0) + np.where(c > 0, c * np.log(c / ((t + c) * (1 - share))), 0)
    evidence = np.where(t * n0 > c * n1, evidence, 0)
    clean = np.flatnonzero(c > 0)
    if not (evidence > 0).any() or not len(clean):
        return Model(None, rate=rate)
    bar = min(np.log(len(strings)), np.sort(evidence)[-min(50, len(evidence))])
    decision = np.where((evidence >= bar) & (evidence > 0), evidence, FLOOR)
    usual = rng.choice(clean, CLEAN, replace=False, p=c[clean] / c.sum()) if len(clean) > CLEAN else clean
    strong = np.argsort(-evidence, kind="stable")[:1000]
    strong = strong[evidence[strong] > 0]
    pool = rng.choice(clean, min(len(clean), 1000), replace=False)
    landmarks = list(dict.fromkeys(diverse([strings[i] for i in strong], LANDMARKS // 3) + diverse([strings[i] for i in pool], LANDMARKS // 3)))
    nystrom = Nystrom(landmarks)
    hard, may = np.zeros(0, np.int64), (c == 0) | (evidence >= bar)  # what clean documents hold as often is no insult
    for _ in range(ROUNDS):
        worst = [own[np.argsort(-decision[own], kind="stable")[:5]] for label, own in bags if label == 1 and len(own)]
        worst = [own[(decision[own] > 0) & may[own]] for own in worst]
        taken, times = np.unique(np.concatenate([*worst, np.zeros(0, np.int64)]), return_counts=True)
        if not len(taken):
            break
        none = np.unique(np.concatenate([usual, hard]))
        none = none[~np.isin(none, taken)]
        if not len(none):
            break
        put_in = altered([strings[i] for i in taken], rng)
        x = nystrom.features([*(strings[i] for i in taken), *put_in, *(strings[i] for i in none)])
        y = np.concatenate([np.ones(2 * len(taken)), -np.ones(len(none))])
        weight = np.concatenate([times / times.sum() * 0.7, times / times.sum() * 0.3, np.full(len(none), 1 / len(none))])
        w, bias = machine(x, y, weight)
        weights = nystrom.folded(w)
        decision = above(strings, weights, bias, FLOOR)
        if not len(hard):  # landmarks where the first machine was wrong
            near = clean[np.argsort(-decision[clean], kind="stable")[:500]]
            nystrom = Nystrom([*landmarks, *diverse([s for s in (strings[i] for i in near) if s not in set(landmarks)], LANDMARKS // 3)])
        hard = np.union1d(hard, clean[np.argsort(-decision[clean], kind="stable")[:HARD]])
    else:
        top = np.array([greatest(decision[own]) for _, own in bags]).clip(FLOOR, CEILING)
        label = np.array([y for y, _ in bags])
        share = np.where(label == 1, totals[1] / n1, totals[0] / n0)
        slopes, offset = logistic(top, label, share / share.mean())
        return Model(weights, bias, slopes, offset, rate)
    return Model(None, rate=rate)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS, fit_windows: int = FIT_WINDOWS) -> Model:
    """The model of ``labels`` (doc_id, label 0 or 1), from a bounded sample of the labelled documents."""
    told = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    ids = docs.select(F.col(id_col).alias("doc_id")).where("doc_id is not null").distinct().join(told, "doc_id")
    totals = {r["label"]: r["count"] for r in ids.groupBy("label").count().collect()}
    parts = [ids.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs) for y in (0, 1)]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(parts[0].union(parts[1])), "doc_id").select("label", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for text in batch.column(1):
                found = {w for part in words(text.as_py() or "") for word in part for w in windows(word)}
                if len(found) > fit_windows:
                    found = sorted(found, key=lambda w: hash_of(w))[:fit_windows]
                own.append(sorted(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.string()))], ["label", "windows"])

    known: dict[str, int] = {}
    read = []
    for row in texts.mapInArrow(work, "label int, windows array<string>").toLocalIterator():
        read.append((row["label"], np.array([known.setdefault(w, len(known)) for w in row["windows"]], np.int32)))
    # by name, and documents by their windows, whatever task they came from
    strings = sorted(known)
    place = np.empty(len(strings), np.int32)
    place[[known[w] for w in strings]] = np.arange(len(strings), dtype=np.int32)
    known.clear()
    bags = sorted(((label, np.sort(place[own])) for label, own in read), key=lambda bag: (bag[0], bag[1].tobytes()))
    return trained(bags, strings, (totals.get(0, 0), totals.get(1, 0)))


def hash_of(word: str) -> int:
    """A hash that is the same in all processes."""
    x = 1469598103934665603
    for b in word.encode("utf-8", "surrogatepass"):
        x = (x ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return x


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1, and ``evidence``, the word that decides (null where none does)."""
    names = docs.columns
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("evidence", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, known = shared.value, {}  # word: (decision, window) of its worst window
        for batch in batches:
            best: list[list[tuple[float, str, str]]] = [[] for _ in range(batch.num_rows)]  # of the two worst windows, worst first
            waiting: list[tuple[int, set[str]]] = []

            def settle_up(best=best, waiting=waiting) -> None:
                fresh = [(w, windows(w)) for w in {w for _, own in waiting for w in own if w not in known}]
                places = list({p for _, own in fresh for p in own})
                values = dict(zip(places, judge.decisions(places).tolist(), strict=True)) if places else {}
                for word, own in fresh:
                    known[word] = max(((values[p], p) for p in own), default=(FLOOR, ""))
                for i, own in waiting:
                    two = {p: (v, p, w) for v, p, w in reversed(best[i])}
                    low = best[i][1][0] if len(best[i]) > 1 else FLOOR
                    for word in own:
                        v, p = known[word]
                        if v > low and (p not in two or word < two[p][2]):
                            two[p] = (v, p, word)
                    best[i] = sorted(two.values(), key=lambda t: (-t[0], t[1]))[:2]
                waiting.clear()
                if len(known) > REMEMBERED:
                    known.clear()

            held = 0
            for i, text in enumerate(batch.column(at)):
                for own in words(text.as_py() or ""):
                    waiting.append((i, own))
                    held += len(own)
                    if held > PENDING:
                        settle_up()
                        held = 0
            settle_up()
            decisions = np.array([[b[0][0] if b else FLOOR, b[1][0] if len(b) > 1 else FLOOR] for b in best]).reshape(-1, 2)
            shown = [b[0][2][:200] if b else None for b in best]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(judge.probability(decisions)), pa.array(shown, pa.string())], [f.name for f in schema.fields])

    out = rows.mapInArrow(work, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "score", "evidence")
