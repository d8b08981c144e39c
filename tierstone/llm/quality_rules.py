"""Quality rules with risk-controlled thresholds.

Every rule is a ratio where higher is worse. Labelled good documents are a holdout: for each stratum and rule
the cutoffs are tried from the mildest to the strictest, and one is accepted while an exact binomial test shows
that it rejects at most ``max_false_rejection / number of rules`` of the stratum's good documents. A stratum with too few labels for that
has the cutoffs of all rules tried in one fixed sequence (``SEQUENCE``), and all that they reject together is tested against
``max_false_rejection``; which of the two a stratum gets depends on its number of labels only. Trying cutoffs in a fixed order, up to the
first failure, needs no correction over cutoffs; strata and rules are corrected for by Bonferroni.
Hence, with probability ``1 - delta``, no stratum loses more than ``max_false_rejection`` of its good documents.

Edge cases: a null, empty or all-white text has no words and fails the base rules; a very long text is read whole; a score equal to its cutoff
passes; repeated rows of documents are judged alike, and each counts as a holdout document; a null stratum is a stratum of its own; a stratum with
too few labels gets no cutoffs, so only the base rules act there; null labels are ignored; labels repeated for a
document count once, and a document labelled both ways counts as good; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import cache, checked_broadcast, slices, texts_of, written

SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
MAX_FALSE_REJECTION, DELTA, JOINT = 0.05, 0.05, "all rules"
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs"]

#: rule -> (score, cutoffs from the mildest to the strictest); a document goes when its score is above the cutoff.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / n_words", [4, 3, 2, 1.5, 1, 0.75, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03]),
    "dup_lines": ("n_dup_lines / n_lines", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "repeats": ("n_repeat_words / n_words", [0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "upper": ("n_upper / word_chars", [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15]),
    "bangs": ("n_bangs / n_words", [2, 1.5, 1, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1]),
}

#: All cutoffs as (rule, place in its grid), from the mildest to the strictest; each rule's are spread evenly.
SEQUENCE = sorted(((r, i) for r, (_, grid) in RULES.items() for i in range(len(grid))), key=lambda x: ((x[1] + 1) / len(RULES[x[0]][1]), list(RULES).index(x[0])))


def text_metrics(b: bytes | None) -> tuple[int, ...]:
    """METRICS of one text; n_words to n_repeat_words as the contract has them."""
    if not b:
        return (0,) * len(METRICS)
    words = b.split()
    n = len(words)
    text = b.decode("utf-8")
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    lines = [x for x in b.split(b"\n") if x.strip()]
    repeats = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
        m = len(ids)
        pair = w[:-2] * m + w[1:-1]
        if m > 2_000_000:
            pair = np.unique(pair, return_inverse=True)[1]
        _, inverse, counts = np.unique(pair * m + w[2:], return_inverse=True, return_counts=True)
        if len(counts) < n - 2:
            again = counts[inverse] > 1
            hit = np.zeros(n, bool)
            hit[:-2] |= again
            hit[1:-1] |= again
            hit[2:] |= again
            repeats = int(hit.sum())
    return n, chars, sum(b.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeats, len(lines), len(b) - len(b.translate(None, _UPPER)), b.count(b"!")


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with METRICS appended (in place of columns of those names)."""
    docs = docs.drop(*METRICS)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(m, T.LongType()) for m in METRICS)])
    at = docs.columns.index(text)

    def run(batches):
        cache("metrics")
        for part in slices(batches, text):
            rows = np.array([text_metrics(b) for b in texts_of(part.column(at))], np.int64).reshape(-1, len(METRICS))
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(rows[:, i]) for i in range(len(METRICS)))], names=[*part.schema.names, *METRICS])

    return docs.mapInArrow(run, schema)


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def score(rule: str) -> Column:
    top, _, bottom = RULES[rule][0].split(" ")
    return F.expr(f"CASE WHEN {bottom} > 0 THEN {top} / {bottom} ELSE 0D END")


def tail(n: int, k: int, p: float) -> float:
    """P(Binomial(n, p) <= k), exactly."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def calibrate(metrics: DataFrame, labels: DataFrame, stratum: str = "lang", max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> list[tuple[str | None, dict[str, float]]]:
    """Cutoffs by stratum. Only counts by stratum, rule and cutoff reach the driver, of strata large enough to pass any test."""
    risk = max_false_rejection / len(RULES)
    good = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q")).filter("q = 1").select(F.col("doc_id").alias("__id"))
    held = metrics.filter(~base_failed()).join(good, metrics["doc_id"] == F.col("__id"), "left_semi")
    # the least count at which even no rejection among n documents can pass, before correction over strata
    fewest = math.ceil(math.log(delta) / math.log1p(-max_false_rejection))
    passed = [sum((F.when(score(r) <= float(c), 1).otherwise(0) for c in grid), F.lit(0)) for r, (_, grid) in RULES.items()]
    # a document passes the steps of SEQUENCE before the first one that rejects it
    place = {r: [SEQUENCE.index((r, i)) for i in range(len(grid))] + [len(SEQUENCE)] for r, (_, grid) in RULES.items()}
    joint = F.least(*(F.array(*map(F.lit, place[r]))[p] for r, p in zip(RULES, passed)))
    steps = F.array(*(F.struct(F.lit(r).alias("rule"), p.alias("kept_by")) for r, p in zip([*RULES, JOINT], [*passed, joint])))
    counts = held.select(F.col(stratum).alias("stratum"), F.explode(steps).alias("s")).groupBy("stratum", "s.rule", "s.kept_by").count()
    sizes = counts.filter(F.col("rule") == next(iter(RULES))).groupBy("stratum").agg(F.sum("count").alias("n")).filter(F.col("n") >= fewest)
    kept = counts.alias("c").join(sizes.alias("z"), F.expr("c.stratum <=> z.stratum")).select("c.stratum", "rule", "kept_by", "count", "n").collect()
    by: dict = {}
    for s, rule, kept_by, count, n in kept:
        by.setdefault(s, (n, {}))[1].setdefault(rule, {})[kept_by] = count
    level = delta / max(1, len(by))
    found = []
    for s, (n, rules) in sorted(by.items(), key=lambda x: (x[0] is None, x[0] or "")):
        cutoffs = {}
        apart = tail(n, 0, risk) <= level / len(RULES)
        for tried in [[(r, i) for i in range(len(grid))] for r, (_, grid) in RULES.items()] if apart else [SEQUENCE]:
            hist = rules[tried[0][0] if apart else JOINT]
            for step, (rule, i) in enumerate(tried):
                # cutoffs fall, so a document passes the first kept_by of them
                rejected = sum(c for k, c in hist.items() if k <= step)
                if tail(n, rejected, risk if apart else max_false_rejection) > (level / len(RULES) if apart else level):
                    break
                cutoffs[rule] = float(RULES[rule][1][i])
        found.append((s, cutoffs))
    return found


def judge(metrics: DataFrame, cutoffs: list[tuple[str | None, dict[str, float]]], stratum: str = "lang") -> DataFrame:
    """Append base_failed and kept."""
    spark = metrics.sparkSession
    names = [f"__{r}" for r in RULES]
    limits = spark.createDataFrame([(s, *(c.get(r) for r in RULES)) for s, c in cutoffs], "__stratum string, " + ", ".join(f"{n} double" for n in names))
    out = metrics.join(checked_broadcast(limits, len(cutoffs), 100_000), F.col(stratum).eqNullSafe(F.col("__stratum")), "left").withColumn("base_failed", base_failed())
    good = ~F.col("base_failed")
    for r, name in zip(RULES, names):
        good &= F.coalesce(score(r) <= F.col(name), F.lit(True))
    return out.withColumn("kept", good).drop("__stratum", *names)


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    metrics = written(with_metrics(docs.select("doc_id", "lang", "text")).drop("text"), "metrics")
    return judge(metrics, calibrate(metrics, labels)).select("doc_id", *METRICS[:5], "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, in their own columns. Texts are measured once; rows and their metrics are written together."""
    columns = docs.columns
    whole = docs.select(*(F.col(c).alias(f"__own_{c}") for c in columns), "doc_id", "lang")
    rows = written(with_metrics(whole, "__own_text"), "quality-rows")
    return judge(rows, calibrate(rows, labels)).filter("kept").select(*(F.col(f"__own_{c}").alias(c) for c in columns))
