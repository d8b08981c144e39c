"""Language identification with error-correcting output codes.

Each language has a codeword; each bit has a binary classifier (logistic regression over hashed byte n-grams of one to three
bytes). A text's language is the one whose codeword has the least loss, the bits weighted by how well they were learnt. Up to seven
languages take all distinct splits as bits; more take the best of some seeded random codes.

Training reads at most ``MAX_TRAIN`` labelled texts (whole ones; one of each language, where there are more languages than that): the same
number of each language, or all it has, the first by a hash of doc_id. That is the only sample, and no language is left out of it.

Edge cases: a null or empty text or one without a letter is ``und`` with score 0 and is not learnt from; a very long text is read whole; a
null lang is not learnt from; of languages with equal loss the first in code point order is predicted (and the text flagged as
ambiguous); a null doc_id counts as held out; with no language to learn from everything is ``und``; repeated rows are rows like others;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import checked_broadcast, slices, written

BUCKETS, MAX_TRAIN, FOLDS, BITS = 2048, 2000, 5, 64
_LETTER = regex.compile(r"\p{L}")
#: ASCII letters stay, all other ASCII becomes a space; bytes above stay.
_TABLE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str) -> bool:
    return bool(_LETTER.search(text))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed n-grams of the lower-cased text."""
    raw = np.frombuffer(b" " + text.lower().encode().translate(_TABLE) + b" ", np.uint8).astype(np.uint32)
    two = raw[:-1] | raw[1:] << np.uint32(8)
    three = two[:-1] | raw[2:] << np.uint32(16)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    x = np.zeros(BUCKETS)
    for grams, m in ((raw, 2654435761), (two, 2246822519), (three, 3266489917)):
        x += np.bincount((grams * np.uint32(m) + np.uint32(m >> 7)) >> shift, minlength=BUCKETS)
    return np.sqrt(x / x.sum()).astype(np.float32)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1."""
    if k <= 1:
        return np.ones((k, 0))
    if k <= 7:
        # every split of the languages in two, the first language always on the same side
        return np.array([[1.0] * (2 ** (k - 1) - 1), *([1.0 if s >> (i - 1) & 1 else -1.0 for s in range(2 ** (k - 1) - 1)] for i in range(1, k))])
    rng, best, far = np.random.default_rng(7), None, -1.0
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (k, BITS))
        near = (BITS - np.max(code @ code.T - 2 * BITS * np.eye(k))) / 2
        if near > far and (np.abs(code.sum(0)) < k).all():
            best, far = code, near
    return best


class Model:
    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray) -> None:
        self.langs, self.code = langs, codewords(len(langs))
        bits = self.code[y]  # rows by bits
        self.mean = x.mean(0) if len(x) else np.zeros(BUCKETS)
        z = np.hstack([(x - self.mean) * 20, np.ones((len(x), 1))])
        w = v = np.zeros((BUCKETS + 1, self.code.shape[1]))
        if bits.size:
            rate, t = 4.0 / (np.linalg.norm(z, 2) ** 2 / len(z) + 1e-3), 1.0
            for _ in range(300):
                slope = -(z.T @ (bits / (1 + np.exp(np.clip(bits * (z @ v), -30, 30))))) / len(z) + 1e-3 * v
                new, t2 = v - rate * slope, (1 + (1 + 4 * t * t) ** 0.5) / 2
                v, w, t = new + (t - 1) / t2 * (new - w), new, t2
        self.weights = w.astype(np.float32)
        loss = np.log1p(np.exp(-bits * (z @ w))).mean(0) if bits.size else np.zeros(0)
        self.trust = np.maximum(0.05, 1 - loss / np.log(2))
        self.trust /= max(1e-9, self.trust.sum())

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the best language, its score in 0..1, and its lead over the next in weighted loss."""
        margin = np.hstack([(x - self.mean) * 20, np.ones((len(x), 1), np.float32)]) @ self.weights
        loss = np.stack([np.logaddexp(0, -margin * c) @ self.trust for c in self.code], 1)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        order = np.sort(loss, 1)
        lead = order[:, 1] - order[:, 0] if loss.shape[1] > 1 else np.full(len(x), np.inf)
        return loss.argmin(1), 1 / share.sum(1), lead


#: A lead below this is flagged as ambiguous.
AMBIGUOUS = 0.1


def sample(docs: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """lang, place and features of the texts to learn from."""
    lab = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = written(lab.groupBy("lang").agg(F.count("*").alias("n")), "lang-counts")
    k = counts.count()
    each = max(1, most // max(1, k))
    place = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)).cast("double") / float(1 << 30)
    # some more than are wanted of each language go on, all of a rare one; then the first of each are taken
    shares = counts.select(F.col("lang").alias("__lang"), F.least(F.lit(1.0), F.lit(1.3 * each + 30) / F.col("n")).alias("__share"))
    near = lab.select("lang", "text", place.alias("place")).join(checked_broadcast(shares, k, 100_000), F.col("lang") == F.col("__lang")).filter("place < __share").select("lang", "text", "place")

    def run(batches):
        for part in slices(batches):
            keep = [(lang, p, features(t)) for lang, t, p in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep], pa.string()), pa.array([k[1] for k in keep], pa.float64()), pa.array([k[2].tobytes() for k in keep], pa.binary())], names=["lang", "place", "x"])

    first = F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))
    return near.withColumn("i", first).filter(F.col("i") <= each).select("lang", "text", "place").mapInArrow(run, "lang string, place double, x binary")


def train(docs: DataFrame, most: int = MAX_TRAIN) -> Model:
    rows = sorted((r[0], r[1], bytes(r[2])) for r in sample(docs, most).collect())
    langs = sorted({r[0] for r in rows})
    place = {lang: i for i, lang in enumerate(langs)}
    x = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(-1, BUCKETS).astype(np.float64)
    return Model(langs, x, np.array([place[r[0]] for r in rows], int))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    def run(batches):
        for part in slices(batches, "text"):
            texts = part.column(2).to_pylist()
            known = [i for i, t in enumerate(texts) if t is not None and model.langs and has_letter(t)]
            lang, score, flag = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if known:
                best, s, lead = model.decide(np.stack([features(texts[i]) for i in known]))
                score[known], flag[known] = s, lead < AMBIGUOUS
                for i, b in zip(known, best.tolist()):
                    lang[i] = model.langs[b]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang), pa.array(score), pa.array(flag)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def op1(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", "lang")
    return predict(docs, train(docs))
