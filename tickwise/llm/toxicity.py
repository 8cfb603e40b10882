"""Toxic spans and document scores by a linear-chain conditional random field (operator 4).

Tokens are the runs of letters, digits and apostrophes of the lower-cased
text; a document is one chain of two labels, clean and toxic.  Features of a
token are its hashed form, its prefixes of 3 to 6 characters and its length; the transition weights are learned with them.

Training labels tokens from document labels: a form is toxic where it (or its
prefix) occurs in enough toxic documents and in next to no clean ones; in
toxic documents such tokens are labelled toxic, all others clean.  The field
is then fitted by gradient steps on the exact log likelihood of token windows,
and again with the windows of clean documents that it mistook for toxic.
``fit_labelled`` uses at most ``MAX_TOXIC`` toxic and ``MAX_CLEAN`` clean labelled
rows, in the order of a hash of their id, whole texts; the driver receives
only counts of forms with enough support and token windows, not texts.

``score`` runs forward-backward over every whole text.  The document score is
the largest marginal of a token, calibrated on the training documents; spans are the runs of tokens whose marginal
is at least ``SPAN``, as character offsets with the mean marginal.

Defined results: null, empty and token-free texts have score 0.0 and no span;
without toxic and clean training rows every score is 0.0.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.llm.common import appended, stash, text_slices, with_columns

TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
BUCKETS = 1 << 15
SPAN = 0.5
REJECT = 0.7
#: bounds of the labelled rows used for training
MAX_TOXIC, MAX_CLEAN = 1500, 4500
#: least toxic documents of a form that labels tokens; a quarter of the root of the toxic sample, if that is more
MIN_SUPPORT = 3
WINDOW = 6
#: rounds of learning from mistakes on clean documents, and windows taken from a document in each
MINING_ROUNDS, MINED = 4, 6
#: forms whose emission a worker keeps
CACHE_FORMS = 200_000


@lru_cache(maxsize=20_000)
def features(form: str) -> tuple[int, ...]:
    names = ["w:" + form, f"n:{min(len(form), 12)}"]
    names += ["p:" + form[:k] for k in range(3, 7) if len(form) > k]
    return tuple(sorted({xxhash.xxh3_64_intdigest(n) % BUCKETS for n in names}))


@dataclass
class Field:
    """emission: weight of the toxic label per feature; trans[a, b]: score of label b after label a; bias: of toxic."""

    emission: np.ndarray
    trans: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def emit(self, form: str) -> float:
        return float(self.emission[list(features(form))].sum() + self.bias)


def _carry(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log odds of the next label from the log odds of this one, through the transition scores."""
    return np.logaddexp(r + t[1, 1], t[0, 1]) - np.logaddexp(r + t[1, 0], t[0, 0])


class Chains:
    """Several chains laid out time-major, the longest first, so that they advance together."""

    def __init__(self, lengths: list[int]):
        self.order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
        self.lengths = np.array([lengths[i] for i in self.order], np.int64)
        steps = int(self.lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-self.lengths, -np.arange(1, steps + 1), side="right")  # chains that reach step t
        self.starts = np.concatenate([[0], np.cumsum(self.active)]).astype(np.int64)
        ends = np.cumsum(lengths) if lengths else np.zeros(0, np.int64)
        first = ends - np.array(lengths, np.int64)
        # place of each time-major element in the chains one after another
        step = np.repeat(np.arange(steps), self.active)
        rank = np.arange(self.starts[-1]) - self.starts[step] if steps else np.zeros(0, np.int64)
        self.place = first[np.array(self.order, np.int64)[rank]] + step if steps else np.zeros(0, np.int64)

    def odds(self, emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward log odds of the toxic label for every token, chains one after another."""
        flat = emit[self.place]
        ahead, back = np.empty_like(flat), np.zeros_like(flat)
        steps, starts, active = len(self.active), self.starts.tolist(), self.active.tolist()
        if steps:
            ahead[: active[0]] = r = flat[: active[0]]
        for t in range(1, steps):
            n, at = active[t], starts[t]
            ahead[at : at + n] = r = flat[at : at + n] + _carry(r[:n], trans)
        turned = trans.T
        for t in range(steps - 2, -1, -1):
            n, at = active[t + 1], starts[t + 1]
            back[starts[t] : starts[t] + n] = _carry(flat[at : at + n] + back[at : at + n], turned)
        out = np.empty_like(flat), np.empty_like(flat)
        out[0][self.place], out[1][self.place] = ahead, back
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def marginals(emit: np.ndarray, lengths: list[int], trans: np.ndarray) -> np.ndarray:
    """Toxic marginal of every token of chains that lie one after another."""
    ahead, back = Chains(lengths).odds(emit, trans)
    return _sigmoid(ahead + back)


def pair_counts(left: np.ndarray, right: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Expected label pairs of neighbours, from the log odds up to the left and from the right token on."""
    logs = np.array([[trans[a, b] + a * left + b * right for b in (0, 1)] for a in (0, 1)])
    weights = np.exp(logs - logs.max(axis=(0, 1)))
    return (weights / weights.sum(axis=(0, 1))).sum(axis=2)


def train(chains: list[tuple[list[str], list[int]]], before: Field | None = None, rounds: int = 50, rate: float = 1.0) -> Field:
    """Adagrad on the mean log likelihood of labelled chains, whose gradient forward-backward gives exactly.

    Goes on from the field ``before``, if there is one.
    """
    forms = sorted({f for words, _ in chains for f in words})
    number = {f: i for i, f in enumerate(forms)}
    row = np.concatenate([[i] * len(features(f)) for f, i in number.items()]).astype(np.int64)
    col = np.concatenate([features(f) for f in forms]).astype(np.int64)
    lengths = [len(words) for words, _ in chains]
    flat = np.array([number[w] for words, _ in chains for w in words])
    y = np.array([v for _, lab in chains for v in lab])
    inner = np.ones(len(flat), bool)  # tokens with a right neighbour in their chain
    inner[np.cumsum(lengths) - 1] = False
    left = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[left], y[left + 1]), 1)
    trans = np.log((seen + 1.0) / (seen.sum(axis=1, keepdims=True) + 2.0))  # starts at the observed transitions
    w, bias = np.zeros(BUCKETS), 0.0
    if before is not None:
        w, trans, bias = before.emission.astype(np.float64), before.trans, before.bias
    grad_w2, grad_t2, grad_b2 = np.full(BUCKETS, 1e-8), np.full((2, 2), 1e-8), 1e-8
    layout = Chains(lengths)
    for _ in range(rounds):
        emit = (np.bincount(row, weights=w[col], minlength=len(forms)) + bias)[flat]
        ahead, back = layout.odds(emit, trans)
        error = y - _sigmoid(ahead + back)
        by_form = np.bincount(flat, weights=error, minlength=len(forms))
        g = np.bincount(col, weights=by_form[row], minlength=BUCKETS) / len(flat) - 1e-7 * w
        gt = (seen - pair_counts(ahead[left], (emit + back)[left + 1], trans)) / max(len(left), 1)
        gb = error.mean()
        grad_w2 += g * g
        grad_t2 += gt * gt
        grad_b2 += gb * gb
        w += rate * g / np.sqrt(grad_w2)
        trans += 0.1 * rate * gt / np.sqrt(grad_t2)
        bias += rate * gb / np.sqrt(grad_b2)
    return Field(w.astype(np.float32), trans, float(bias))


def _forms(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def fit_labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Field | None:
    """Field learned from ``docs`` (key, text) and ``labels`` (key, label); None where one of the two labels is missing.

    The bounded sample is drawn among labels whose document is there.
    """
    there = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"))
    keys = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).dropDuplicates()
    keys = keys.join(there, "k", "left_semi")
    order = [F.xxhash64("k"), F.col("k")]
    chosen = keys.where("y = 1").orderBy(*order).limit(max_toxic).unionByName(keys.where("y = 0").orderBy(*order).limit(max_clean))
    chosen = stash(chosen, "chosen")
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).where("text IS NOT NULL")
    sample = stash(rows.join(F.broadcast(chosen), "k").dropDuplicates(["k", "y"]), "sample")

    def count(batches):
        for batch in text_slices(batches, "text"):
            out: dict[tuple[str, int], int] = {}
            for t, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                forms = set(_forms(t))
                for f in forms | {f[:5] + "*" for f in forms if len(f) > 5} | {f[:4] + "*" for f in forms if len(f) > 4}:
                    out[f, y] = out.get((f, y), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in out], pa.string()), pa.array([y for _, y in out], pa.int32()), pa.array(list(out.values()), pa.int64())], names=["form", "y", "n"])

    counts = sample.select("y", "text").mapInArrow(count, "form string, y int, n long").groupBy("form").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic"),
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean"),
    )
    support = max(MIN_SUPPORT, int(math.sqrt(chosen.where("y = 1").count()) / 4))
    # support and ratio alone decide; texts of a bounded sample have a bounded number of forms with such support
    seeds = sorted(r["form"] for r in counts.where(f"toxic >= {support} AND toxic >= 50 * clean").select("form").collect())
    if not seeds:
        return None
    known = frozenset(seeds)

    def around(forms: list[str], lab: list[int], hits: list[int]):
        for a, b in _merge([(max(0, i - WINDOW), min(len(forms), i + WINDOW + 1)) for i in hits]):
            yield forms[a:b], lab[a:b]

    def rows_of(found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.list_(pa.string())), pa.array([v for _, v in found], pa.list_(pa.int32()))], names=["words", "labels"])

    def seeded(batches):
        """Windows around the seeds of toxic documents, two windows of each clean one."""
        for batch in text_slices(batches, "text"):
            found = []
            for t, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                forms = _forms(t)
                lab = [int(y == 1 and (f in known or f[:5] + "*" in known or f[:4] + "*" in known)) for f in forms]
                found += around(forms, lab, [i for i, v in enumerate(lab) if v] if y == 1 else [len(forms) // 4, 3 * len(forms) // 4] if forms else [])
            yield rows_of(found)

    def mistaken(field: Field):
        """Windows of clean documents around their most suspect tokens under ``field``."""

        def run(batches):
            tagger = Tagger(field)
            for batch in text_slices(batches, "text"):
                docs = [_forms(t) for t in batch.column("text").to_pylist()]
                found = []
                for forms, p in zip(docs, tagger.marginals(docs)):
                    suspect = np.flatnonzero(p >= 0.02)
                    suspect = suspect[np.argsort(-p[suspect], kind="stable")][:MINED]
                    found += around(forms, [0] * len(forms), suspect.tolist())
                yield rows_of(found)

        return run

    def gathered(rows: DataFrame, run) -> list[tuple[list[str], list[int]]]:
        return sorted((list(r["words"]), list(r["labels"])) for r in rows.select("y", "text").mapInArrow(run, "words array<string>, labels array<int>").collect())

    chains = gathered(sample, seeded)
    if not any(any(y) for _, y in chains):
        return None
    field = train(chains)
    for _ in range(MINING_ROUNDS):  # a token in ten million may be wrong: learn from the mistakes on clean documents
        more = gathered(sample.where("y = 0"), mistaken(field))
        if not more:
            break
        chains += more
        field = train(chains, field)

    def strongest(batches):
        tagger = Tagger(field)
        for batch in text_slices(batches, "text"):
            found = tagger.marginals([_forms(t) for t in batch.column("text").to_pylist()])
            top = [_logit(p.max()) if len(p) else -60.0 for p in found]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(top, pa.float64())], names=["y", "top"])

    tops = sorted((r["top"], r["y"]) for r in sample.select("y", "text").mapInArrow(strongest, "y int, top double").collect())
    field.scale, field.shift = calibrate(np.array([t for t, _ in tops]), np.array([y for _, y in tops]))
    return field


def _logit(p) -> float:
    p = min(max(float(p), 1e-12), 1 - 1e-12)
    return math.log(p / (1 - p))


def calibrate(x: np.ndarray, y: np.ndarray, weight: float = 1e-3) -> tuple[float, float]:
    """Scale and shift of a one-variable logistic regression (Newton steps, documents weigh the same)."""
    cost = np.full(len(y), 1.0 / len(y))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * x + b)
        h = cost * p * (1 - p) + 1e-12
        g = np.array([(cost * (p - y) * x).sum() + weight * (a - 1), (cost * (p - y)).sum()])
        hess = np.array([[(h * x * x).sum() + weight, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-9]])
        step = np.clip(np.linalg.solve(hess, g), -2, 2)
        a, b = max(a - step[0], 0.1), b - step[1]
    return float(a), float(b)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Tagger:
    """Scoring inside a worker; the emission of each distinct form is computed once."""

    def __init__(self, field: Field):
        self.field, self.known = field, {}

    def marginals(self, docs: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > CACHE_FORMS:
            self.known = {}
        for f in set().union(*docs).difference(self.known):
            self.known[f] = self.field.emit(f)
        lengths = [len(d) for d in docs]
        emit = np.fromiter(map(self.known.__getitem__, chain.from_iterable(docs)), np.float64, sum(lengths))
        return np.split(marginals(emit, lengths, self.field.trans), np.cumsum(lengths)[:-1]) if docs else []

    def tag(self, texts: list[str | None]) -> tuple[list[float], list[list[tuple[int, int, float]]]]:
        lowered = [(t or "").lower() for t in texts]
        found = self.marginals([TOKEN.findall(t) for t in lowered])
        f = self.field
        scores = [float(_sigmoid(np.float64(f.scale * _logit(p.max()) + f.shift))) if len(p) else 0.0 for p in found]
        return scores, [self.spans(t, low, p) if len(p) and p.max() >= SPAN else [] for t, low, p in zip(texts, lowered, found)]

    @staticmethod
    def spans(text: str, lowered: str, p: np.ndarray) -> list[tuple[int, int, float]]:
        """Runs of offending tokens in the offsets of the text as given."""
        out: list[tuple[int, int, float]] = []
        run: list[float] = []
        for m, q in zip(TOKEN.finditer(lowered), p):
            if q >= SPAN:
                if run:
                    out[-1] = (out[-1][0], m.end(), 0.0)
                else:
                    out.append((m.start(), m.end(), 0.0))
                run.append(float(q))
                out[-1] = (*out[-1][:2], sum(run) / len(run))
            else:
                run = []
        if len(text) != len(lowered):  # a few characters lower to two: map the offsets back
            at = np.cumsum([0] + [len(c.lower()) for c in text])
            out = [(int(np.searchsorted(at, a, "right")) - 1, int(np.searchsorted(at, b)), q) for a, b, q in out]
        return out


SPANS = "array<struct<start:int,end:int,p:double>>"


def score(df: DataFrame, field: Field | None, text: str = "text", spans: bool = True) -> DataFrame:
    """All columns of ``df``, ``score`` and, with ``spans``, the offending ``spans``."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    added = [("score", pa.float64(), "double")] + ([("spans", kind, SPANS)] if spans else [])
    kept, schema = appended(df, added)
    shared = df.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        tagger = Tagger(shared.value) if shared.value is not None else None
        for batch in text_slices(batches, text):
            n = batch.num_rows
            scores, found = tagger.tag(batch.column(text).to_pylist()) if tagger else ([0.0] * n, [[]] * n)
            out = [("score", pa.array(scores, pa.float64()))]
            if spans:
                out.append(("spans", pa.array([[{"start": a, "end": b, "p": q} for a, b, q in s] for s in found], kind)))
            yield with_columns(batch, kept, out)

    return df.mapInArrow(run, schema)
