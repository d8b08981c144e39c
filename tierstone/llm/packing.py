"""Best-fit packing by patterns of few documents, fitted with non-negative least squares.

1. Tokenise; cut only documents over ``SEQ`` tokens.
2. From the histogram of lengths (at most SEQ numbers reach the driver), put together to classes ``STEP`` tokens wide and rounded up, fit
   how often each pattern of at most three classes that fill a sequence is to be repeated (non-negative least squares), and round down.
   Exact lengths take the places; what is left, and the room left in those sequences, is packed by best fit decreasing on counts of
   exact lengths. Where best fit alone needs fewer sequences, its plan is taken.
3. Number the pieces of a length over all tasks (counts by task and length, then running sums), look the place up in the plan, and lay
   the pieces of a sequence end to end.

Full pieces are sequences by themselves, so a hot length needs no common counter. The plan holds some thousand
entries whatever the input.

Edge cases: a null or empty text is one piece of the closing id 0; a very long text is tokenised whole and cut into pieces; pieces of
equal length are alike, so a tie changes which of them shares a sequence and never the number of sequences; repeated rows are packed
each; a null doc_id stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import default_path, load
from .util import slices, texts_of, written

SEQ, STEP, END = 2048, 8, b"\0\0\0\0"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, k long"


def pieces(docs: DataFrame, path: str | None = None, seq: int = SEQ) -> DataFrame:
    """A row per piece, with its number among those of its length in its task; written once, so the numbers hold."""
    path = path or default_path()

    def run(batches):
        tokens, seen, task = load(path), Counter(), TaskContext.get().partitionId()
        for part in slices(batches):
            ids, texts = part.column(0).to_pylist(), texts_of(part.column(1))
            rows = []
            for i, raw in zip(ids, tokens.batch([t or b"" for t in texts])):
                raw += END
                n = len(raw) // 4
                for p, start in enumerate(range(0, n, seq)):
                    length = min(seq, n - start)
                    rows.append((i, p, start, length, zlib.crc32(raw[start * 4 : (start + length) * 4]), task, seen[length]))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)

    return written(docs.select("doc_id", "text").mapInArrow(run, PIECES), "pack-pieces")


NAMES = [x.split()[0] for x in PIECES.split(", ")]
TYPES = [pa.int32() if x.endswith(" int") else pa.int64() for x in PIECES.split(", ")]


def patterns(counts: np.ndarray, size: int) -> list[tuple[int, ...]]:
    """Patterns of two and three present classes that fill ``size`` classes."""
    have = [c for c in range(1, size) if counts[c]]
    present, out = set(have), []
    for a in have:
        if size - a <= a and size - a in present:
            out.append((a, size - a))
        for b in have:
            c = size - a - b
            if b > a or c < 1:
                break
            if c <= b and c in present:
                out.append((a, b, c))
    return out


def nnls(matrix: np.ndarray, target: np.ndarray, rounds: int = 1500) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradients."""
    gram, top = matrix.T, matrix @ np.ones(matrix.shape[1])
    rate = 1.0 / max(1e-9, float((gram @ top).max()))  # at most 1 / the largest eigenvalue, which the row sums of A'A bound
    x = y = np.zeros(matrix.shape[1])
    t = 1.0
    for _ in range(rounds):
        z = np.maximum(0.0, y - rate * (gram @ (matrix @ y - target)))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = z + (t - 1) / t2 * (z - x), z, t2
    return x


def best_fit(counts: np.ndarray, size: int, begun: Counter | None = None) -> Counter:
    """Best fit decreasing over counts: pattern -> repeats; ``begun`` sequences are filled up. Alike sequences are kept as one entry, so time
    follows the number of lengths."""
    open_: dict[int, list[list]] = {}  # room -> [pattern, repeats]
    for pattern, n in (begun or {}).items():
        open_.setdefault(size - sum(pattern), []).append([pattern, n])
    for c in range(size, 0, -1):
        left = int(counts[c])
        for room in range(c, size):
            while left and open_.get(room):
                # a sequence that has taken a piece has the least room of all, so it takes as many as fit before the next one does
                pattern, n = open_[room].pop()
                fit = min(room // c, left)
                take = min(left // fit, n)
                if n > take:
                    open_[room].append([pattern, n - take])
                left -= take * fit
                open_.setdefault(room - fit * c, []).append([pattern + (c,) * fit, take])
        if left:
            fit = size // c
            if left >= fit:
                open_.setdefault(size - fit * c, []).append([(c,) * fit, left // fit])
            if left % fit:
                open_.setdefault(size - left % fit * c, []).append([(c,) * (left % fit), 1])
    out: Counter = Counter()
    for entries in open_.values():
        for pattern, n in entries:
            out[pattern] += n
    return out


def fitted(counts: np.ndarray, size: int, step: int) -> tuple[Counter, np.ndarray]:
    """(pattern -> repeats) by the fit over classes of ``step`` lengths, and the counts left over."""
    left, plan = counts.copy(), Counter()
    top, cls = size // step, -(-np.arange(len(counts)) // step)
    totals = np.bincount(cls, left, top + 1).astype(np.int64)
    shapes = patterns(totals, top)
    if not shapes:
        return plan, left
    matrix = np.zeros((top, len(shapes)))
    for j, shape in enumerate(shapes):
        for c in shape:
            matrix[c, j] += 1
    # common and rare lengths weigh alike, long ones more: what is left of short ones finds room later
    scale = np.sqrt(np.maximum(totals[:top], 1.0)) / (np.arange(top) / top + 0.05)
    repeats = np.floor(nnls(matrix / scale[:, None], totals[:top] / scale) + 1e-6).astype(np.int64)
    lengths = {c: [i for i in range((c - 1) * step + 1, c * step + 1) if left[i]] for c in range(1, top)}

    def take(c: int, m: int, n: int) -> list[int]:
        """m pieces of class c for each of n sequences, longest first."""
        got = []
        while len(got) < m:
            i = lengths[c][-1]
            some = min(m - len(got), int(left[i]) // n)
            got += [i] * some
            left[i] -= some * n
            if not left[i]:
                lengths[c].pop()
        return got

    for j in np.argsort(-repeats, kind="stable"):
        need = Counter(shapes[j])
        n = min(int(repeats[j]), *(int(totals[c]) // m for c, m in need.items()))
        for c, m in need.items():
            totals[c] -= n * m
        while n > 0:
            # so many sequences alike that each class has its longest length for all; at a length's last pieces one sequence mixes lengths
            alike = max(1, min(n, *(int(left[lengths[c][-1]]) // m for c, m in need.items())))
            plan[tuple(i for c, m in need.items() for i in take(c, m, alike))] += alike
            n -= alike
    return plan, left


def make_plan(counts: np.ndarray, size: int, step: int = 1) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats), covering every count exactly; counts[c] for c in 1..size - 1."""
    counts = counts.astype(np.int64)
    begun, left = fitted(counts, size, step)
    return sorted(min(best_fit(left, size, begun), best_fit(counts, size), key=lambda plan: sum(plan.values())).items())


def places(plan: list[tuple[tuple[int, ...], int]], size: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: where each entry's slots start, pieces of the length per sequence, and the entry's first sequence."""
    by: dict[int, list] = {c: [] for c in range(1, size)}
    used, base = Counter(), 0
    for pattern, n in plan:
        for c, m in Counter(pattern).items():
            by[c].append((used[c], m, base))
            used[c] += n * m
        base += n
    return {c: tuple(np.array(x, np.int64) for x in zip(*rows)) for c, rows in by.items() if rows}


def pack(cut: DataFrame, seq: int = SEQ, step: int = STEP) -> DataFrame:
    """Place the rows of pieces()."""
    at = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(seq + 1, np.int64)
    for c, n in at.groupBy("length").agg(F.sum("n")).collect():
        counts[c] = n
    found = places(make_plan(np.where(np.arange(seq + 1) < seq, counts, 0), seq, step), seq)
    # Lengths and tasks are many, so the running sums are taken per length; the rows are tasks times lengths at most.
    first = at.withColumn("first", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).drop("n")
    numbered = cut.join(first, ["task", "length"])
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long"

    def run(batches):
        for b in batches:
            col = {n: b.column(b.schema.get_field_index(n)) for n in b.schema.names}
            length = np.asarray(col["length"])
            k = np.asarray(col["k"]) + np.asarray(col["first"])
            seqs = -1 - k  # full pieces: own numbers below zero
            order = np.argsort(length, kind="stable")
            for m in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if not len(m) or (c := int(length[m[0]])) == seq:
                    continue
                starts, per, base = found[c]
                e = np.searchsorted(starts, k[m], side="right") - 1
                seqs[m] = base[e] + (k[m] - starts[e]) // per[e]
            yield pa.RecordBatch.from_arrays([*(col[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seqs)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id"])

    dealt = numbered.mapInArrow(run, schema)
    inside = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "piece", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"))


def op4(docs: DataFrame, path: str | None = None) -> DataFrame:
    return pack(pieces(docs, path))
