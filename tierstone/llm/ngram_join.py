"""N-gram Jaccard join with vertical partitioning.

1. Every text's set of distinct 5-word shingles (64-bit hashes). Documents with equal sets are one class.
2. The number of sets that hold each shingle is counted over the whole corpus. It gives the global order: octaves of the number, rarest first, and
   within an octave the hash. Shingles of one set only cannot be shared and are dropped.
3. Two sets with similarity of at least 0.8 share one of their ``n - ceil(0.8 n) + 1`` first shingles in that order (prefix filter), so links
   only exist within a family: classes joined through shared prefix shingles.
4. The global order is cut into ``FRAGMENTS`` fragments of equal weight. Each class is cut into segments, one per fragment, and a family's segments of
   one fragment meet in a task of their own, which counts the partial overlaps of all pairs there as one matrix.
5. A family's matrices are summed over the fragments, pair by pair; sums that reach the threshold are links, of which a spanning star per
   component leaves the task, never pairs.
   A family over ``BLOCK`` classes (or ``BLOCK_BYTES``) is cut into blocks by set size, since sizes of linked sets differ by a quarter at
   most, and by hash; each pair of blocks that may hold links has its own tasks: that is the exact way for hot groups.
6. Components of the links, by large-star and small-star.

Edge cases: null, empty and all-white texts have no set and link with nothing; fewer than five words count as one shingle of
their own kind; very long texts are a chunk of their own; ties and repeated rows and a null doc_id are rows like others (the smallest
non-null doc_id names a component); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import chunks as C
from .components import LINKS, connected, local_components
from .util import cache, checked_broadcast, discard, mix64, powers, release, with_row_id, written

WORDS, PERCENT, BLOCK, BLOCK_BYTES, FRAGMENTS, COLUMNS, SEGMENT = 5, 80, 1024, 16 << 20, 4, 2048, 256 << 10
OCTAVES = 33
_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
_BASE = 0x2545F4914F6CDD1D
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))
_WHITE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words per text, and the 64-bit hashes of all words in turn; from prefix sums over some bytes at a time, never word by word."""
    raw = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)
    white = _WHITE[raw]
    edge = np.flatnonzero(np.diff(white, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    out, i = np.empty(len(starts), np.uint64), 0
    power, back = powers(_BASE, SEGMENT)
    while i < len(starts):
        low = starts[i]
        j = int(np.searchsorted(ends, low + SEGMENT, side="right"))
        if j <= i:  # a word longer than a segment
            out[i] = xxhash.xxh3_64_intdigest(raw[low : ends[i]].tobytes())
            i += 1
            continue
        n = ends[j - 1] - low
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw[low : low + n]] * power[:n], dtype=np.uint64)])
            out[i:j] = mix64((sums[ends[i:j] - low] - sums[starts[i:j] - low]) * back[starts[i:j] - low])
        i = j
    return np.diff(np.searchsorted(starts, bounds)), out


class Sets:
    """The shingle sets of a chunk's texts, end to end in ``rank``: places in ``values``, the sorted distinct shingle hashes of the chunk."""

    def __init__(self, texts: list[bytes]) -> None:
        lengths, h = words_of(texts)
        owners, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        begins = np.cumsum(lengths) - lengths
        for n in range(1, WORDS + 1):
            whose = np.flatnonzero(lengths == n if n < WORDS else lengths >= n)
            count = lengths[whose] - n + 1
            owner = np.repeat(whose, count)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + begins[owner]
            s = np.full(len(at), np.uint64(n))
            with np.errstate(over="ignore"):
                for k in range(n):
                    s += h[at + k] * _MULTIPLIERS[k]
            owners.append(owner)
            hashes.append(mix64(s))
        self.values, rank = np.unique(np.concatenate(hashes), return_inverse=True)
        both = np.sort(np.concatenate(owners) << 32 | rank)
        both = both[np.diff(both, prepend=-1) > 0]
        self.owner, self.rank = both >> 32, both & 0xFFFFFFFF
        self.sizes = np.bincount(self.owner, minlength=len(texts))
        self.ends = np.cumsum(self.sizes)
        flat, seen = self.values[self.rank], set()
        self.keys = [xxhash.xxh3_128_digest(flat[e - n : e].tobytes()) if n else None for n, e in zip(self.sizes.tolist(), self.ends.tolist())]
        #: Whether a text is the first of its class in the chunk.
        self.first = np.array([k is not None and k not in seen and not seen.add(k) for k in self.keys], bool)

    def held(self) -> np.ndarray:
        """How many distinct sets of the chunk hold each of ``values``."""
        return np.bincount(self.rank[self.first[self.owner]], minlength=len(self.values))


def _truncated(values: np.ndarray, held: np.ndarray, bits: int):
    cut, place = np.unique(values >> np.uint64(32 - bits), return_inverse=True)
    return cut, place, np.bincount(place, weights=held, minlength=len(cut)).astype(np.int64)


def _entries(chunks: DataFrame, bits: int) -> DataFrame:
    def run(batches):
        cache("ngrams")
        for row in C.rows_of(batches):
            sets = Sets(C.opened(row)[1])
            cut, _, counts = _truncated(sets.values, sets.held(), bits)
            yield C.entry_batch(list(C.dealt(cut, counts, bits, "<u4", row["chunk_id"])))

    return chunks.mapInArrow(run, C.ENTRY)


def prefix_length(n):
    """Of a set size, or of an array of them."""
    return n - -(-PERCENT * n // 100) + 1


def octave(freq: np.ndarray) -> np.ndarray:
    """0 for one set, 1 for two, 2 for three and four, 3 for five to eight, ..."""
    return np.ceil(np.log2(np.maximum(freq, 1))).astype(np.int64)


LISTS = "rid long, n_shingles long, set_key binary, prefix array<long>, shared binary, octaves array<int>"


def _lists(chunks: DataFrame, back: DataFrame, bits: int) -> DataFrame:
    """A row per document; the first of a class in its chunk carries prefix and shared shingles in the global order, if its prefix has any, and
    how many of the shared ones are in each octave."""

    def use(row, total):
        ids, texts = C.opened(row)
        sets = Sets(texts)
        cut, place, _ = _truncated(sets.values, sets.held(), bits)
        assert len(cut) == len(total)
        level = octave(total)[place][sets.rank] if len(place) else total
        n_twice = np.bincount(sets.owner[level > 0], minlength=len(ids))
        # shingles of one set only come first in the order, and may fill the prefix
        room = prefix_length(sets.sizes) - (sets.sizes - n_twice)
        rows = []
        for i, n, end, key, reach in zip(ids, sets.sizes.tolist(), sets.ends.tolist(), sets.keys, np.where(sets.first & (n_twice > 0), room, 0).tolist()):
            prefix = shared = octaves = None
            if reach > 0:
                at = np.flatnonzero(level[end - n : end]) + end - n
                at = at[np.argsort(level[at], kind="stable")]
                s = sets.values[sets.rank[at]]
                prefix, shared, octaves = s[:reach].view(np.int64), s.tobytes(), np.bincount(level[at], minlength=OCTAVES)
            rows.append((i, n, key, prefix, shared, octaves))
            if len(rows) == 512:
                yield batch(rows)
                rows = []
        yield batch(rows)

    def batch(rows):
        cols = list(zip(*rows)) or [()] * 6
        types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["rid", "n_shingles", "set_key", "prefix", "shared", "octaves"])

    return C.returned(chunks, [back], use, LISTS)


#: 56 bits of a set_key as a long.
SHORT = "cast(conv(hex(substring(set_key, 2, 7)), 16, 10) AS long)"


def families(classes: DataFrame) -> DataFrame:
    """node (a class's short key), root: classes that share prefix shingles, straight or through others, in families of two at least. A task joins its own
    classes first; then each shingle links the local families it is in. Should two short keys collide, families merge, which costs time only."""

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b.column(1).flatten())
            if n > LINKS:
                yield local(held)
                held, n = [], 0
        if held:
            yield local(held)

    def local(held):
        who = np.concatenate([np.asarray(b.column(0)) for b in held])
        each = np.concatenate([np.diff(np.asarray(b.column(1).offsets)) for b in held])
        shingles, at = np.unique(np.concatenate([np.asarray(b.column(1).flatten()) for b in held]), return_inverse=True)
        m = len(who)
        # the smallest node of a component is a class
        root = who[local_components(np.repeat(np.arange(m), each), m + at, m + len(shingles))]
        kind = np.repeat([False, True], [m, len(shingles)])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([who, shingles])), pa.array(root)], names=["shingle", "node", "root"])

    stars = written(classes.select("short", "prefix").mapInArrow(run, "shingle boolean, node long, root long"), "ngram-stars")
    # a shingle has a row per task at most, so no window is large
    least = F.min("root").over(Window.partitionBy("node"))
    links = stars.filter("shingle").select("root", least.alias("m")).filter("root > m").select(F.col("root").alias("a"), F.col("m").alias("b")).distinct()
    joined = written(connected(written(links, "ngram-local")), "ngram-joined").select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    found = stars.filter("NOT shingle").join(joined, F.col("root") == F.col("__node"), "left").select("node", F.coalesce("__root", "root").alias("root"))
    found = written(found, "ngram-found")
    discard(stars)
    several = written(found.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("root").alias("__root")), "ngram-several")
    return found.join(several, F.col("root") == F.col("__root"), "left_semi")


def fragment_of(shared: np.ndarray, octaves: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The fragment of each of a class's shingles: the global order is cut so that all classes together have as many shingles in each."""
    start = (np.cumsum(weights) - weights)[np.repeat(np.arange(OCTAVES), octaves)]
    own = weights[np.repeat(np.arange(OCTAVES), octaves)]
    place = start + own * (shared.astype(np.float64) / 2.0**64)
    return np.minimum((place * FRAGMENTS / max(1, weights.sum())).astype(np.int64), FRAGMENTS - 1)


def partial_overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of ``left`` has in common with each of ``right`` (distinct ones each), some columns at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = np.concatenate([*left, np.zeros(0, "<u8")]), np.concatenate([*right, np.zeros(0, "<u8")])
    common = np.intersect1d(a, b)
    sides = []
    for flat, parts in ((a, left), (b, right)):
        column = np.searchsorted(common, flat)
        keep = np.flatnonzero(common[np.minimum(column, len(common) - 1)] == flat) if len(common) else np.zeros(0, np.int64)
        keep = keep[np.argsort(column[keep], kind="stable")]
        sides.append((column[keep], np.repeat(np.arange(len(parts)), [len(p) for p in parts])[keep], len(parts)))
    for start in range(0, len(common), COLUMNS):
        width, ones = min(COLUMNS, len(common) - start), []
        for column, who, n in sides:
            i, j = np.searchsorted(column, [start, start + COLUMNS])
            ones.append(np.zeros((n, width), np.float32))
            ones[-1][who[i:j], column[i:j] - start] = 1
        out += ones[0] @ ones[1].T
    return out


def spanning_stars(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """(member, first member of its component) over a symmetric matrix of links; a row is read once, and pairs are never listed."""
    seen = np.zeros(len(linked), bool)
    for s in range(len(linked)):
        if seen[s]:
            continue
        seen[s], todo = True, [s]
        while todo:
            new = np.flatnonzero(linked[todo.pop()] & ~seen)
            seen[new] = True
            todo += (found := new.tolist())
            yield from ((j, s) for j in found)


SEGMENTS = "root long, block long, fragment int, set_key binary, n_shingles long, segment binary"
PARTIAL = "root long, x long, y long, fragment int, keys_x binary, sizes_x binary, keys_y binary, sizes_y binary, overlaps binary"


def _blocks(rows: DataFrame, block: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (root, ...) with their block, and for blocks of large families (root, block) the other blocks that may hold links with each: (root, block,
    other). A block is a range of set sizes (2 ** 20 codes each) and a hash within it; families of one block have no row there."""
    size = F.floor(F.log(F.col("n_shingles")) / float(np.log(1.26))).cast("long")  # over 1 / 0.8, so links reach the next range at most
    many = lambda: F.ceil(F.greatest(F.count("*") / block, F.sum(F.length("shared")) / block_bytes)).cast("long")
    large = written(rows.groupBy("root").agg(many().alias("n")).filter("n > 1").select(F.col("root").alias("__root")), "ngram-large")
    inside = rows.join(large, F.col("root") == F.col("__root"), "left_semi").groupBy("root", size.alias("size")).agg(many().alias("n"))
    inside = written(inside, "ngram-sizes")
    near = inside.select("root", (F.col("size") - 1).alias("size"), F.col("n").alias("n_other"), F.col("size").alias("s_other"))
    near = near.unionByName(inside.select("root", "size", F.col("n").alias("n_other"), F.col("size").alias("s_other")))
    codes = lambda s, n: F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), lambda i: F.col(s) * (1 << 20) + i))
    pairs = inside.join(near, ["root", "size"]).select("root", codes("size", "n").alias("x"), "s_other", "n_other").select("root", "x", codes("s_other", "n_other").alias("y"))
    pairs = pairs.filter("x <= y")
    pairs = pairs.select("root", F.col("x").alias("block"), "x", "y").unionByName(pairs.filter("x < y").select("root", F.col("y").alias("block"), "x", "y"))
    cut = inside.select(F.col("root").alias("__root"), F.col("size").alias("__size"), F.col("n").alias("__n"))
    rows = rows.withColumn("__s", size).join(cut, (F.col("root") == F.col("__root")) & (F.col("__s") == F.col("__size")), "left")
    own = F.when(F.col("__n").isNull(), F.lit(0)).otherwise(F.col("__s") * (1 << 20) + F.pmod(F.xxhash64("set_key"), F.col("__n"))).cast("long")
    rows = rows.withColumn("block", own).withColumn("large", F.col("__n").isNotNull()).drop("__s", "__root", "__size", "__n")
    return rows, written(pairs.select(F.col("root").alias("__root"), F.col("block").alias("__block"), "x", "y"), "ngram-pairs")


def _family_links(classes: DataFrame, family: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """Links a, b (set_key), written. ``classes`` is deleted as soon as the families have their own table."""
    weights = np.array([n or 0 for n in classes.agg(*(F.sum(F.col("octaves")[i]) for i in range(OCTAVES))).first()], np.float64)
    rows = classes.select("set_key", F.col("short").alias("__short"), "n_shingles", "shared", "octaves").join(family, F.col("__short") == F.col("node")).drop("node", "__short")
    members = written(rows, "ngram-family")
    discard(classes)
    release(members.sparkSession)
    rows, pairs = _blocks(members, block, block_bytes)

    def cut(batches):
        for b in batches:
            out = []
            for r in C.rows_of([b]):
                shared = np.frombuffer(r["shared"], "<u8")
                at = np.searchsorted(fragment_of(shared, np.array(r["octaves"]), weights), np.arange(FRAGMENTS + 1))
                out += [(r["root"], r["block"], r["large"], f, r["set_key"], r["n_shingles"], shared[at[f] : at[f + 1]].tobytes()) for f in range(FRAGMENTS) if at[f + 1] > at[f]]
            cols = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["root", "block", "large", "fragment", "set_key", "n_shingles", "segment"])

    segments = rows.select("root", "block", "large", "set_key", "n_shingles", "shared", "octaves").mapInArrow(cut, SEGMENTS.replace("fragment int", "large boolean, fragment int"))
    segments = segments.join(pairs, F.col("large") & (F.col("root") == F.col("__root")) & (F.col("block") == F.col("__block")), "left")
    segments = segments.select("root", F.coalesce("x", "block").alias("x"), F.coalesce("y", "block").alias("y"), "fragment", "block", "set_key", "n_shingles", "segment")

    def count(batches):
        cache("ngrams")
        held, at = [], None
        for r in C.rows_of(batches):
            here = (r["root"], r["x"], r["y"], r["fragment"])
            if held and here != at:
                yield from partial(at, held)
                held = []
            at = here
            held.append(r)
        if held:
            yield from partial(at, held)

    def partial(at, held):
        _, x, y, _ = at
        sides = [[r for r in held if r["block"] == side] for side in (x, y)]
        left, right = ([np.frombuffer(r["segment"], "<u8") for r in side] for side in sides)
        overlaps = partial_overlaps(left, right)
        if x == y:
            np.fill_diagonal(overlaps, 0)
        if not overlaps.any():
            return
        named = [v for side in sides for v in (b"".join(r["set_key"] for r in side), np.array([r["n_shingles"] for r in side], "<i8").tobytes())]
        cols = [*([v] for v in at), *([v] for v in named), [C.squeeze(overlaps.astype("<u4"))]]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in PARTIAL.split(", ")])

    def add(batches):
        held, at = [], None
        for r in C.rows_of(batches):
            here = (r["root"], r["x"], r["y"])
            if held and here != at:
                yield links(held)
                held = []
            at = here
            held.append(r)
        if held:
            yield links(held)

    def links(held):
        sides, places, sizes = [], [], []
        for side in "xy":
            keys = [np.frombuffer(r[f"keys_{side}"], "V16") for r in held]
            names = [k.tobytes() for k in np.concatenate(keys)]
            index = {k: i for i, k in enumerate(dict.fromkeys(names))}
            sides.append(list(index))
            places.append([np.array([index[k.tobytes()] for k in ks], np.int64) for ks in keys])
            sizes.append(np.zeros(len(index), np.int64))
            for r, p in zip(held, places[-1]):
                sizes[-1][p] = np.frombuffer(r[f"sizes_{side}"], "<i8")
        total = np.zeros((len(sides[0]), len(sides[1])), np.int64)
        for r, p, q in zip(held, *places):
            total[np.ix_(p, q)] += C.loosen(r["overlaps"], "<u4").reshape(len(p), len(q))
        linked = (100 + PERCENT) * total >= PERCENT * (sizes[0][:, None] + sizes[1][None, :])
        members = sides[0]
        if held[0]["x"] != held[0]["y"]:
            members, m = sides[0] + sides[1], len(sides[0])
            square = np.zeros((len(members), len(members)), bool)
            square[:m, m:], square[m:, :m] = linked, linked.T
            linked = square
        found = [(members[i], members[j]) for i, j in spanning_stars(linked)]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    counted = segments.repartition("root", "x", "y", "fragment").sortWithinPartitions("root", "x", "y", "fragment").mapInArrow(count, PARTIAL)
    found = written(counted.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y").mapInArrow(add, "a binary, b binary"), "ngram-links")
    discard(members, pairs)
    return found


def join(rows: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``rows``: __rid (non-null, unique) and text. Gives __rid, n_shingles, label (equal within a component, null: none)."""
    return join_chunks(C.write_chunks(rows.select("__rid", "text")), block, block_bytes)


def join_chunks(chunks: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """join() of texts that are in chunks, which it deletes."""
    spark = chunks.sparkSession
    bits = C.bucket_bits(chunks)
    lists = written(_lists(chunks, C.totals(_entries(chunks, bits), "<u4"), bits), "ngram-lists")
    discard(chunks)
    release(spark)
    classes = written(lists.filter("shared IS NOT NULL").dropDuplicates(["set_key"]).select("set_key", F.expr(SHORT).alias("short"), "n_shingles", "prefix", "shared", "octaves"), "ngram-classes")
    keys = written(lists.select(F.col("rid").alias("__rid"), "n_shingles", "set_key"), "ngram-keys")
    discard(lists)
    release(spark)
    links = _family_links(classes, families(classes), block, block_bytes)
    release(spark)
    linked = written(connected(links), "ngram-components")
    out = keys.join(linked, F.col("set_key") == F.col("node"), "left")
    return out.select("__rid", "n_shingles", F.coalesce("root", "set_key").alias("label"))


def op6(docs: DataFrame) -> DataFrame:
    rows = with_row_id(docs.select("doc_id", "text"), "ngram-rows")
    chunks, ids = C.write_chunks(rows.select("__rid", "text")), written(rows.select("__rid", "doc_id"), "ngram-ids")
    discard(rows)
    found = written(join_chunks(chunks).join(ids, "__rid"), "ngram-found")
    # only components of several rows need their smallest doc_id looked up
    least = written(found.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").select(F.col("label").alias("__label"), "least"), "ngram-least")
    out = found.join(least, F.col("label") == F.col("__label"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The row of each component that has the smallest doc_id (then the first), in the columns of ``docs``; rows without words stay."""
    rows = with_row_id(docs, "ngram-docs")
    found = written(join(rows).join(rows.select("__rid", "doc_id"), "__rid"), "ngram-found")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__rid")
    first = written(found.filter("label IS NOT NULL").groupBy("label").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("label").alias("__label"), F.col("first.__rid").alias("__first")), "ngram-first")
    gone = written(found.join(first, F.col("label") == F.col("__label")).filter("__rid <> __first").select("__rid"), "ngram-gone")
    return rows.join(checked_broadcast(gone, gone.count(), 1_000_000), "__rid", "left_anti").select(docs.columns)
