"""Removal of repeated byte strings by blockwise suffix sorting with a difference-cover sample.

Suffixes are compared as far as their 200-byte heads. Positions of a text whose residue modulo 31 is in the cover (a perfect
difference set of six residues) are the sample. Any two suffixes i and j have an offset d < 31 at which i + d and j + d are both in the sample.

1. Equal texts are made one first: of two or more copies every byte is covered.
2. Sample ranks: the 170-byte blocks at the sample positions are sorted, one bucket at a time, over the whole corpus. Blocks that occur once have rank 0,
   the others the number of their place.
3. Suffixes: only those with a sample of rank above 0 within their first 31 bytes can have a head that repeats. They are dealt into buckets and each
   bucket is sorted by the first and the last 30 bytes of the heads. Ties there are resolved by the ranks: two suffixes are equal when at their
   common offset d the ranks are equal, for the 30 bytes before, the block, and the 30 bytes after it cover the whole head. So a suffix
   goes with a few numbers instead of its head, however long the ties are, and a bucket's memory is bounded.
   Buckets are worked off in ``PASSES`` rounds over the chunks, which bounds what lies in shuffle files at once.
4. Bytes covered by repeated heads are removed.

Keys of blocks and of ends are 64-bit fingerprints, so the order of buckets and within them is that of fingerprints and not of letters; only
adjacency of equal heads matters here. A head is taken for repeated when the keys of its ends and of the block between agree.

Edge cases: null and empty texts have nothing to remove; texts under 200 bytes are kept whole; ties are what the operator looks for;
repeated rows and null doc_ids are rows like others; a very long text is a chunk of its own, at about 20 bytes of memory for each of its own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .util import cache, discard, mix64, powers, release, written

LENGTH, PERIOD = 200, 31
#: A perfect difference set modulo 31; every residue but 0 is the difference of exactly one pair.
COVER = (0, 1, 3, 8, 12, 18)
BLOCK, END = LENGTH - PERIOD + 1, PERIOD - 1
CHUNK, SEGMENT, PASSES = 4 << 20, 256 << 10, 4
#: Rounds in which ties are compared with the first of their group before all ranks are sorted.
LEADERS = 3
_BASE = 0x9E3779B97F4A7C15
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))
#: _AHEAD[r, k]: how far the next sample of residue COVER[k] lies ahead of a position with residue r.
_AHEAD = (np.array(COVER)[None, :] - np.arange(PERIOD)[:, None]) % PERIOD
RESULT = "sha binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
RANKS = "chunk_id long, bucket int, totals binary"
RANKED = C.CHUNK + ", at binary, rank binary"
SUFFIXES = "bucket int, chunk_id long, n int, keys binary, residues binary, ranks binary, twice binary"


class Piece:
    """Some positions of a chunk, with the bytes that their heads need and prefix sums from which any window's fingerprint follows."""

    def __init__(self, raw: np.ndarray, start: int, room: np.ndarray, local: np.ndarray) -> None:
        self.raw, self.start, self.room, self.local = raw, start, room, local
        self.power, self.back = powers(_BASE, SEGMENT + LENGTH + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * self.power[: len(raw)], dtype=np.uint64)])

    def prints(self, at: np.ndarray, size: int) -> np.ndarray:
        """Sums of the windows at ``at``, before mixing."""
        with np.errstate(over="ignore"):
            return (self.sums[at + size] - self.sums[at]) * self.back[at]


class Chunk:
    """A chunk's texts end to end, read some positions at a time, also inside a text."""

    def __init__(self, row: dict) -> None:
        self.row = row
        self.lengths = np.frombuffer(row["lengths"], "<i8")
        self.ends = np.cumsum(self.lengths)
        self.begins = self.ends - self.lengths
        self.bytes = zstandard.ZstdDecompressor().decompress(row["blob"], max_output_size=max(1, row["n_bytes"]))
        self.raw = np.frombuffer(self.bytes, np.uint8)

    def pieces(self, wanted: np.ndarray | None = None) -> Iterator[Piece]:
        """All pieces, or those with a wanted position."""
        for a in range(0, len(self.raw), SEGMENT):
            if wanted is not None and not wanted[a : a + SEGMENT].any():
                continue
            at = np.arange(a, min(a + SEGMENT, len(self.raw)))
            which = np.searchsorted(self.ends, at, side="right")
            yield Piece(self.raw[a : a + SEGMENT + LENGTH], a, self.ends[which] - at, at - self.begins[which])

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and block fingerprints of the sample."""
        member = np.zeros(PERIOD, bool)
        member[list(COVER)] = True
        at, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for p in self.pieces():
            i = np.flatnonzero(member[p.local % PERIOD] & (p.room >= BLOCK))
            at.append(i + p.start)
            keys.append(mix64(p.prints(i, BLOCK)))
        return np.concatenate(at), np.concatenate(keys)


class Suffixes:
    """The suffixes of a chunk that may repeat, of the buckets of one round, and the distinct ones among them in order of their keys."""

    def __init__(self, chunk: Chunk, bits: int, turn: int, turns: int) -> None:
        kind, n = rank_kind(bits), len(chunk.raw)
        at, rank_at = np.cumsum(C.loosen(chunk.row["at"], "<u4"), dtype=np.int64), np.zeros(n + LENGTH, kind)
        rank_at[at] = C.loosen(chunk.row["rank"], kind)
        wanted = _covered(at, n, PERIOD - 1, 1)
        found = [[np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8)]]
        for p in chunk.pieces(wanted):
            i = np.flatnonzero(wanted[p.start : p.start + len(p.room)] & (p.room >= LENGTH))
            with np.errstate(over="ignore"):
                ends = mix64(p.prints(i, END) * np.uint64(0xC2B2AE3D27D4EB4F) + p.prints(i + BLOCK, END))
            if turns > 1:
                mine = np.flatnonzero((ends >> np.uint64(64 - bits)) % np.uint64(turns) == turn)
                i, ends = i[mine], ends[mine]
            found.append([i + p.start, ends, (p.local[i] % PERIOD).astype(np.uint8)])
        at, keys, residues = (np.concatenate(x) for x in zip(*found))
        # stable, so that every reading of the chunk has the same order
        order = np.argsort(keys, kind="stable")
        self.at, keys, residues = at[order], keys[order], residues[order]
        ranks = np.empty((len(COVER), len(order)), kind)
        same = residues.astype(np.uint64)
        with np.errstate(over="ignore"):
            for k in range(len(COVER)):
                ranks[k] = rank_at[self.at + _AHEAD[residues, k]]
                same = same * np.uint64(0x9E3779B97F4A7C15) + ranks[k]
            same = mix64(same)
        # neighbours that agree in ends, residue and all ranks are equal; they go as one
        first = np.ones(len(order), bool)
        first[1:] = (keys[1:] != keys[:-1]) | (same[1:] != same[:-1])
        self.place = np.cumsum(first) - 1
        self.twice = np.bincount(self.place, minlength=int(first.sum())) > 1
        self.keys, self.residues, self.ranks = keys[first], residues[first], ranks[:, first]


#: _SLOT[(r - s) % PERIOD]: which sample of a suffix with residue r and which of one with residue s lie at one offset.
_SLOT = np.zeros((PERIOD, 2), np.int64)
for _k, _e in enumerate(COVER):
    for _m, _f in enumerate(COVER):
        if _e != _f:
            _SLOT[(_e - _f) % PERIOD] = _k, _m


def tied(keys: np.ndarray, residues: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Which of some suffixes have an equal one among them; ``ranks`` has a row per cover residue. They are sorted by key; suffixes of one key are equal when
    they have a sample of equal rank, not 0, at their common offset."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    group = np.cumsum(new) - 1
    for _ in range(LEADERS):
        # only groups of two or more are ties
        tie = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
        order, group = order[tie], group[tie]
        if not len(order):
            return out
        new = np.ones(len(order), bool)
        new[1:] = group[1:] != group[:-1]
        lead = order[new][np.cumsum(new) - 1]
        slots = _SLOT[(residues[lead].astype(np.int64) - residues[order]) % PERIOD]
        own = ranks[slots[:, 1], order]
        equal = (ranks[slots[:, 0], lead] == own) & (own > 0) & ~new
        out[order[equal]] = out[lead[equal]] = True
        order, group = order[~equal & ~new], group[~equal & ~new]
    # what is left has several different heads behind one key: sort by (key, offset, rank)
    tie = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
    order, group = order[tie], group[tie]
    slot, who = np.nonzero(ranks[:, order])
    rank = np.unique(ranks[slot, order[who]], return_inverse=True)[1]
    at = group[who] * PERIOD + _AHEAD[residues[order[who]], slot]
    by = np.lexsort((rank, at))
    same = (at[by][1:] == at[by][:-1]) & (rank[by][1:] == rank[by][:-1])
    out[order[who[by[1:][same]]]] = out[order[who[by[:-1][same]]]] = True
    return out


def _covered(starts: np.ndarray, n: int, back: int, ahead: int) -> np.ndarray:
    """Positions within ``back`` before or ``ahead`` after (exclusive) any start."""
    edge = np.bincount(np.maximum(starts - back, 0), minlength=n + 1).astype(np.int32)
    edge -= np.bincount(np.minimum(starts + ahead, n), minlength=n + 1).astype(np.int32)
    return np.cumsum(edge[:n]) > 0


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as differences, byte plane by byte plane."""
    gaps = keys.copy()
    gaps[1:] -= keys[:-1]
    return C.squeeze(np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T))


def unpack_sorted(packed: bytes) -> np.ndarray:
    planes = C.loosen(packed, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _ends(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket begins among ascending keys."""
    return np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def _sample_entries(chunks: DataFrame, bits: int) -> DataFrame:
    def run(batches):
        cache("substrings")
        for row in C.rows_of(batches):
            keys, counts = np.unique(Chunk(row).samples()[1], return_counts=True)
            at = _ends(keys, bits)
            yield C.entry_batch([(b, row["chunk_id"], pack_sorted(keys[at[b] : at[b + 1]]), C.squeeze(np.packbits(counts[at[b] : at[b + 1]] > 1))) for b in np.flatnonzero(np.diff(at)).tolist()])

    return chunks.mapInArrow(run, C.ENTRY)


def rank_kind(bits: int) -> str:
    """Ranks are 32-bit numbers as long as a bucket's number and the places in it fit."""
    return "<u4" if bits <= 9 else "<u8"


def _grouped(batches, add) -> Iterator[pa.RecordBatch]:
    """``add`` of the rows of each bucket, which come one after the other."""
    rows = []
    for r in C.rows_of(batches):
        if rows and r["bucket"] != rows[0]["bucket"]:
            yield add(rows)
            rows = []
        rows.append(r)
    if rows:
        yield add(rows)


def _ranks(entries: DataFrame, bits: int) -> DataFrame:
    """For each entry row the ranks of its blocks over all chunks."""
    kind = rank_kind(bits)

    def add(rows):
        parts = [unpack_sorted(r["keys"]) for r in rows]
        flat = np.concatenate(parts)
        twice = np.concatenate([np.unpackbits(C.loosen(r["counts"], np.uint8), count=len(p)) for r, p in zip(rows, parts)]).astype(np.int64)
        _, place = np.unique(flat, return_inverse=True)
        repeated = np.bincount(place, weights=1 + twice) > 1
        assert kind == "<u8" or repeated.sum() < 1 << 23
        rank = np.where(repeated, np.cumsum(repeated) + (rows[0]["bucket"] << (23 if kind == "<u4" else 40)), 0).astype(kind)
        back = np.split(rank[place], np.cumsum([len(p) for p in parts])[:-1])
        return pa.RecordBatch.from_arrays([pa.array([r["chunk_id"] for r in rows], pa.int64()), pa.array([r["bucket"] for r in rows], pa.int32()), pa.array([C.squeeze(b) for b in back], pa.binary())], names=["chunk_id", "bucket", "totals"])

    return entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: _grouped(batches, add), RANKS)


def _ranked(chunks: DataFrame, ranks: DataFrame, bits: int) -> DataFrame:
    """Chunks with the positions and ranks of their repeated sample blocks, so that a round reads one table and shuffles no text."""

    def use(row, rank):
        at, keys = Chunk(row).samples()
        _, place = np.unique(keys, return_inverse=True)
        own = rank[place] if len(at) else rank
        at, own = at[own > 0], own[own > 0]
        cols = [row["chunk_id"], row["n_bytes"], row["ids"], row["lengths"], row["blob"], C.squeeze(np.diff(at, prepend=0).astype("<u4")), C.squeeze(own)]
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in RANKED.split(", ")])

    return C.returned(chunks, [ranks], use, RANKED, rank_kind(bits))


def _suffix_entries(ranked: DataFrame, bits: int, turn: int, turns: int) -> DataFrame:
    """Rows of the buckets of one round."""

    def run(batches):
        cache("substrings")
        for row in C.rows_of(batches):
            s = Suffixes(Chunk(row), bits, turn, turns)
            at, out = _ends(s.keys, bits), []
            for b in np.flatnonzero(np.diff(at)).tolist():
                part = slice(at[b], at[b + 1])
                out.append((b, row["chunk_id"], int(at[b + 1] - at[b]), pack_sorted(s.keys[part]), C.squeeze(s.residues[part]), C.squeeze(np.ascontiguousarray(s.ranks[:, part])), C.squeeze(np.packbits(s.twice[part]))))
            cols = list(zip(*out)) or [()] * 7
            kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in SUFFIXES.split(", ")])

    return ranked.mapInArrow(run, SUFFIXES)


def _repeats(entries: DataFrame, bits: int) -> DataFrame:
    """For each entry row a bit per suffix: whether it is equal to another one."""
    kind = rank_kind(bits)

    def add(rows):
        sizes = [r["n"] for r in rows]
        keys, residues = np.concatenate([unpack_sorted(r["keys"]) for r in rows]), np.concatenate([C.loosen(r["residues"], np.uint8) for r in rows])
        ranks = np.concatenate([C.loosen(r["ranks"], kind).reshape(len(COVER), -1) for r in rows], axis=1)
        hit = tied(keys, residues, ranks)
        hit |= np.concatenate([np.unpackbits(C.loosen(r["twice"], np.uint8), count=n) for r, n in zip(rows, sizes)]).astype(bool)
        back = [C.squeeze(x.astype(np.uint8)) for x in np.split(hit, np.cumsum(sizes)[:-1])]
        return pa.RecordBatch.from_arrays([pa.array([r["chunk_id"] for r in rows], pa.int64()), pa.array([r["bucket"] for r in rows], pa.int32()), pa.array(back, pa.binary())], names=["chunk_id", "bucket", "totals"])

    return entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: _grouped(batches, add), RANKS)


def _removals(ranked: DataFrame, repeats: DataFrame, bits: int) -> DataFrame:
    def use(row, repeated):
        chunk = Chunk(row)
        s = Suffixes(chunk, bits, 0, 1)
        assert len(repeated) == len(s.keys)
        starts = s.at[repeated[s.place] > 0] if len(s.at) else s.at
        del s
        gone = _covered(starts, len(chunk.raw), 0, LENGTH)
        out = []
        for c, a, z in zip(np.frombuffer(row["ids"], "<i8").tolist(), chunk.begins.tolist(), chunk.ends.tolist()):
            t, g = chunk.bytes[a:z], gone[a:z]
            removed = int(g.sum())
            if c > 1 and len(t) >= LENGTH:
                removed, spans, kept = len(t), 1, b""
            elif removed:
                spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum())
                kept = chunk.raw[a:z][~g].tobytes()
            else:
                spans, kept = 0, t
            out.append((hashlib.sha256(t).digest(), len(t), removed, spans, hashlib.sha256(kept).hexdigest()))
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["sha", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return C.returned(ranked, [repeats], use, RESULT, np.uint8)


def op2(docs: DataFrame, chunk: int = CHUNK, passes: int = PASSES) -> DataFrame:
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("sha", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))
    ids = written(keyed.select("doc_id", "sha"), "substring-ids")
    # copies meet in the map tasks first, so a text with very many copies is one row per task
    chunks = C.write_chunks(keyed.groupBy("sha").agg(F.count("*").alias("copies"), F.first("text").alias("text")).select("copies", "text"), chunk)
    release(spark)
    bits = C.bucket_bits(chunks)
    ranks = written(_ranks(_sample_entries(chunks, bits), bits), "substring-ranks")
    release(spark)
    ranked = written(_ranked(chunks, ranks, bits), "substring-ranked")
    discard(chunks, ranks)
    release(spark)
    rounds = []
    for turn in range(passes):
        rounds.append(written(_repeats(_suffix_entries(ranked, bits, turn, passes), bits), "substring-repeats"))
        release(spark)
    repeats = rounds[0]
    for r in rounds[1:]:
        repeats = repeats.unionByName(r)
    found = written(_removals(ranked, repeats, bits), "substring-found")
    discard(ranked, *rounds)
    release(spark)
    return ids.join(found, "sha").drop("sha")
