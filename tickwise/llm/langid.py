"""Language identification by hierarchical discrimination (operator 1).

A text becomes hashed counts of its 1-, 2- and 3-byte grams (lower-cased UTF-8,
ASCII characters that are no letters read as one space), square-rooted and
scaled to length 1.  First linear support vector machines vote on the language
family, then one-versus-one machines between the languages of that family vote
on the language; ties go to the larger sum of margins, then to the first name.
The score is the product of the two softmax shares of the summed margins.

``fit`` learns from at most ``MAX_ROWS`` labelled rows, taken evenly from the
languages in the order of a hash of their id, each with its whole text; only
their hashed vectors reach the driver.  ``predict`` reads whole texts in
bounded slices and shuffles nothing.

Defined results: a null text or one without a letter is ``und`` with score 0;
so is every text if no language could be learned.  Equal texts get equal
results; other columns are kept, added columns replace input columns of their
name.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.llm.common import appended, text_slices, with_columns

UNDETERMINED = "und"
DIMENSIONS = 2048
#: bound of the labelled rows that training may use, over all languages
MAX_ROWS = 2400
EPOCHS = 12
#: bytes of one long text that are hashed at a time
PIECE = 1 << 20
# Family of each language code that the hierarchy knows; any other code is in the family "other".
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "lb", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
}


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.lower().split("-")[0] in codes), "other")


def _byte_map() -> np.ndarray:
    keep = np.arange(256, dtype=np.uint8)
    letters = np.zeros(256, bool)
    letters[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
    return np.where(letters, keep, np.uint8(0x20))


BYTES = _byte_map()


def gram_counts(text: str) -> np.ndarray:
    """Hashed gram counts of one whole text, read in pieces that overlap by two bytes."""
    raw = BYTES[np.frombuffer(text.lower().encode(), np.uint8)]
    single = np.ones(len(raw), bool)
    single[1:] = (raw[1:] != 0x20) | (raw[:-1] != 0x20)
    raw = raw[single]
    out = np.zeros(DIMENSIONS)
    for at in range(0, len(raw), PIECE):
        b = raw[at : at + PIECE + 2].astype(np.uint32)
        one = b[: min(PIECE, len(b))]
        two = (b[:-1] * np.uint32(263) + b[1:])[:PIECE]
        three = ((b[:-2] * np.uint32(263) + b[1:-1]) * np.uint32(263) + b[2:])[:PIECE]
        for n, grams in enumerate((one, two, three)):
            hashed = (grams + np.uint32(n << 28)) * np.uint32(2654435761)
            out += np.bincount(hashed >> np.uint32(21), minlength=DIMENSIONS)
    return out


def vectors(texts: list[str]) -> np.ndarray:
    x = np.sqrt(np.array([gram_counts(t) for t in texts]).reshape(len(texts), DIMENSIONS))
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, seed: int, weight: float = 1e-4) -> tuple[np.ndarray, float]:
    """Hinge loss by averaged subgradient steps over seeded shuffles; y is -1 or 1, classes weigh the same."""
    rng = np.random.default_rng(seed)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    w, b, mean_w, mean_b, t = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0, 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            t += 1
            rate = 1.0 / (weight * (t + 1.0 / weight))
            miss = y[i] * (x[i] @ w + b) < 1
            w *= 1 - rate * weight
            if miss:
                w += rate * share[i] * y[i] * x[i]
                b += 0.1 * rate * share[i] * y[i]
            mean_w += w
            mean_b += b
    return mean_w / max(t, 1), mean_b / max(t, 1)


@dataclass
class Model:
    """families: names; members: family -> languages; a machine for each pair, whose positive side is the first name."""

    families: list[str]
    members: dict[str, list[str]]
    weights: np.ndarray
    bias: np.ndarray
    column: dict[tuple[str, str, str], int]

    def vote(self, margins: np.ndarray, group: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner and its softmax share for each row."""
        n = len(margins)
        votes, sums = np.zeros((n, len(names))), np.zeros((n, len(names)))
        for a, b in combinations(range(len(names)), 2):
            m = margins[:, self.column[(group, names[a], names[b])]]
            votes[:, a] += m > 0
            votes[:, b] += m <= 0
            sums[:, a] += m
            sums[:, b] -= m
        sums = np.clip(sums, -30, 30)
        best = np.argmax(votes * 1000 + sums, axis=1)
        share = np.exp(sums - sums.max(axis=1, keepdims=True))
        return best, (share / share.sum(axis=1, keepdims=True))[np.arange(n), best]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.families or not texts:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        margins = vectors(texts) @ self.weights + self.bias
        family, first = self.vote(margins, "", self.families)
        langs, scores = [""] * len(texts), first.copy()
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            if len(rows):
                own = self.members[name]
                best, share = self.vote(margins[rows], name, own)
                scores[rows] *= share
                for r, k in zip(rows, best):
                    langs[r] = own[k]
        return langs, scores.tolist()


def train(langs: list[str], x: np.ndarray) -> Model:
    names = sorted(set(langs))
    members: dict[str, list[str]] = {}
    for lang in names:
        members.setdefault(family_of(lang), []).append(lang)
    families = sorted(members)
    y = np.array(langs, dtype=object)
    fam = np.array([family_of(lang) for lang in langs], dtype=object)
    column, weights, bias = {}, [], []
    pairs = [("", a, b, fam) for a, b in combinations(families, 2)]
    pairs += [(f, a, b, y) for f in families for a, b in combinations(members[f], 2)]
    for group, a, b, names_of in pairs:
        rows = np.flatnonzero((names_of == a) | (names_of == b))
        w, c = linear_svm(x[rows].astype(np.float64), np.where(names_of[rows] == a, 1.0, -1.0), len(column))
        column[(group, a, b)] = len(weights)
        weights.append(w)
        bias.append(c)
    shape = (len(weights), DIMENSIONS)
    return Model(families, members, np.array(weights, np.float32).reshape(shape).T, np.array(bias, np.float32), column)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(rows: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS) -> Model:
    """Model of the labelled ``rows``; rows without language or letter are not learned from."""
    from pyspark.sql import Window

    usable = rows.where(F.col(lang).isNotNull() & has_letter(F.col(text))).select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_rows).collect()
    each = max(1, max_rows // max(1, len(counts)))
    # only hashes below a bound are ranked, some thousand rows of a language: the least ``each`` lie far below it
    bounds = [(r["lang"], min((1 << 63) - 1, int((4 * each + 1000) / r["n"] * 2.0**64) - (1 << 63))) for r in counts]
    bounds = rows.sparkSession.createDataFrame(bounds, "lang string, top long")
    order = F.struct(F.xxhash64("k"), F.col("k"))
    low = usable.select("k", "lang").join(F.broadcast(bounds), "lang").where(F.xxhash64("k") <= F.col("top"))
    chosen = low.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(order))).where(F.col("r") <= each).select("k", "lang")
    picked = usable.join(F.broadcast(chosen.dropDuplicates()), ["k", "lang"], "left_semi").dropDuplicates(["k", "lang"]).select("lang", "text")
    kept, schema = appended(picked.select("lang"), [("x", pa.binary(), "binary")])

    def run(batches):
        for batch in text_slices(batches, "text"):
            x = vectors(batch.column("text").to_pylist())
            yield with_columns(batch, kept, [("x", pa.array([row.tobytes() for row in x], pa.binary()))])

    # ordered so that the machines see the rows in the same order on every run
    learned = sorted((r["lang"], bytes(r["x"])) for r in picked.mapInArrow(run, schema).collect())
    x = np.array([np.frombuffer(v, np.float32) for _, v in learned], np.float32).reshape(len(learned), DIMENSIONS)
    return train([lang for lang, _ in learned], x)


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``df``, ``lang_pred`` and ``score``."""
    kept, schema = appended(df, [("lang_pred", pa.string(), "string"), ("score", pa.float64(), "double")])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in text_slices(batches, text):
            texts = batch.column(text)
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_pylist()
            rows = [i for i, yes in enumerate(letters) if yes]
            langs, scores = [UNDETERMINED] * batch.num_rows, [0.0] * batch.num_rows
            for i, lang, score in zip(rows, *shared.value.predict(texts.take(pa.array(rows, pa.int64())).to_pylist())):
                langs[i], scores[i] = lang, float(score)
            yield with_columns(batch, kept, [("lang_pred", pa.array(langs, pa.string())), ("score", pa.array(scores, pa.float64()))])

    return df.mapInArrow(run, schema)
