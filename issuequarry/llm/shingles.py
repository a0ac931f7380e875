"""Word runs as hashed sets, their global order, and lossless candidate blocks for set-similarity joins.

Every text becomes the set of its runs of `width` words (letters and digits of the lower-cased consistent form). The set is a
sparse 0/1 vector; two sets of likeness t or more differ in at most (1 - t) / (1 + t) * (|A| + |B|) dimensions. Dimensions are
ordered from rare to frequent by a count sketch over all distinct sets. Two texts that agree on no dimension among the first
|A| - ceil(t |A|) + 1 of their own have used up that budget, so every pair sought meets in the block of a shared early dimension.
An early dimension is sent to its block only if a second sketch knows another set that has it early too, at a size that can pair with
this one. Both sketches may count too much and never too little: their collisions cost time and no pair.

Cold dimensions form blocks directly; equal blocks are kept once. Hot runs (a third of all rows may share one) that lead the same sets are joined to one family, so that
a boilerplate of many runs is walked once. A self-join that looks for groups compares a large family with a few hubs first and then only what these leave; a join of two sides,
which must find every pair, cuts it into chunks of bounded size, and every two chunks meet in one task.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuequarry.llm.lookalike import confusable_letters
from issuequarry.llm.textform import ConsistentForm
from issuequarry.session import Scratch

WIDE = 5  # bytes of a hashed run
MASK = (1 << 8 * WIDE) - 1
WORDS = 4  # of the parity vector that a set takes to its cold blocks
VECTOR = [f"v{i}" for i in range(WORDS)]
BITS = ", ".join(f"{x} bigint" for x in VECTOR)
BASE = "row_id bigint, side int, k bigint, n int, sh binary"
MERGED = 4096  # places up to which lists are put together
PIECE = 1 << 15  # cells of a sketch that are counted in one place


def pack(h: np.ndarray) -> bytes:
    """Values in WIDE bytes each."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDE]).tobytes()


def unpack(b: bytes) -> np.ndarray:
    n = len(b) // WIDE
    out = np.zeros((n, 8), np.uint8)
    out[:, :WIDE] = np.frombuffer(b, np.uint8).reshape(n, WIDE)
    return out.view("<u8").ravel()


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class RunHasher:
    """Texts of a batch to (content key, number of runs, packed sorted runs)."""

    def __init__(self, width: int, more: dict[str, str] | None = None):
        self.width, self.form, self.cache = width, ConsistentForm(None, more), {}
        self.words = re.compile(r"[^\W_]+")

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        cache, h64 = self.cache, xxhash.xxh3_64_intdigest
        if len(cache) > 1_000_000:
            cache.clear()
        ids, lens, whole = [], [], []
        for t in texts:
            low = self.form(t or "").lower()
            w = self.words.findall(low)
            for x in w:
                v = cache.get(x)
                if v is None:
                    v = cache[x] = h64(x.encode("utf-8", "surrogatepass"))
                ids.append(v)
            lens.append(len(w))
            whole.append(h64(low.encode("utf-8", "surrogatepass")) if len(w) < self.width else 0)
        lens = np.array(lens, np.int64)
        a = np.array(ids, np.uint64)
        doc = np.repeat(np.arange(len(texts)), lens)
        h = mix(a, 1)
        with np.errstate(over="ignore"):
            for i in range(1, self.width):
                h[: len(a) - i] = mix(h[: len(a) - i] * np.uint64(0x9E3779B97F4A7C15) + a[i:], 1 + i)
        ends = np.repeat(np.cumsum(lens), lens)
        ok = np.arange(len(a)) + self.width <= ends
        h, doc = h[ok] & np.uint64(MASK), doc[ok]
        o = np.lexsort((h, doc))
        h, doc = h[o], doc[o]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[first], doc[first]
        n = np.bincount(doc, minlength=len(texts))
        at = np.concatenate(([0], np.cumsum(n)))
        with np.errstate(over="ignore"):
            sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(h, 7))))  # wraps: differences are the sums of each text
            key = mix(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64), 9)
        empty = n == 0
        if empty.any():
            key[empty] = mix(np.array(whole, np.uint64)[empty], 11)
        return key.view(np.int64), n, [pack(h[at[i] : at[i + 1]]) for i in range(len(texts))]


def run_sets(df: DataFrame, key: str, text: str, width: int, side: int = 1) -> DataFrame:
    """row_id, side, k (64-bit key of the set, or of the text where it has no run), n, sh. A null text is an empty one."""

    more = confusable_letters(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RunHasher(width, more)
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                c = b.slice(i, 4096)
                k, n, sh = hasher(c.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [c.column(0), pa.array(np.full(len(n), side), pa.int32()), pa.array(k, pa.int64()), pa.array(n, pa.int32()), pa.array(sh, pa.binary())],
                    ["row_id", "side", "k", "n", "sh"],
                )

    return df.select(F.col(key).cast("bigint"), F.col(text).cast("string")).mapInArrow(work, BASE)


def cell_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix(h, 21) >> np.uint64(64 - bits)).astype(np.int64)


def copied_keys(base: DataFrame) -> DataFrame:
    """(side, k) of the sets that more than one row has."""
    return base.groupBy("side", "k").agg(F.count("*").alias("m")).filter("m > 1").select("side", "k")


def numbered(base: DataFrame) -> DataFrame:
    """base with an id a row, under which sets are known below: ids of neighbours are near, so they take little room where they are shuffled."""
    return base.withColumn("id", F.monotonically_increasing_id())


def distinct_sets(base: DataFrame, copied: DataFrame, scratch: Scratch) -> DataFrame:
    """(k, side, sh) with each set of a side once; k is the id of one of its rows. Only sets that have copies are shuffled; those without pass a bitmap of keys that have some."""
    bitmap = handed_out(base.sparkSession, bloom(copied.select(F.expr("k ^ bigint(side)"))))
    rows = base.filter("n > 0").select(F.expr("k ^ bigint(side)").alias("key"), "k", "side", "id", "sh")
    once = scratch.keep(only_in(rows, *bitmap).dropDuplicates(["k", "side"]).select(F.col("id").alias("k"), "side", "sh"))
    return only_in(rows, *bitmap, inside=False).select(F.col("id").alias("k"), "side", "sh").unionAll(once)


class CellCounts:
    """Counts by cell of one task, sorted and packed by piece: at most some millions of cells are held at a time."""

    def __init__(self, bits: int):
        self.bits, self.held, self.n = bits, [], 0

    def add(self, cells: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(np.unique(cells, return_counts=True))
        self.n += len(self.held[-1][0])
        if self.n > 4_000_000:
            yield from self.packed()

    def packed(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            c, where = np.unique(np.concatenate([x[0] for x in self.held]), return_inverse=True)
            m = np.bincount(where, weights=np.concatenate([x[1] for x in self.held]))
            m = np.minimum(m, 65535).astype("<u2")
            at = np.searchsorted(c, np.arange(0, (1 << self.bits) + PIECE, PIECE))
            ids = np.flatnonzero(np.diff(at)).tolist()
            gaps = [zlib.compress(np.diff(c[at[p] : at[p + 1]] - p * PIECE, prepend=0).astype("<u2").tobytes(), 1) for p in ids]  # small numbers pack well
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(gaps, pa.binary()), pa.array([zlib.compress(m[at[p] : at[p + 1]].tobytes(), 1) for p in ids], pa.binary())], ["p", "i", "c"])
        self.held, self.n = [], 0


def gathered(cells: DataFrame, bits: int, level: Callable[[np.ndarray], np.ndarray], width: int) -> bytes:
    """The levels of all cells, `width` bits each (a power of two up to 8), from packed counts."""
    each = 8 // width

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for p, i, c in zip(*[b.column(x).to_pylist() for x in range(3)], strict=True):
                s = sums.setdefault(p, np.zeros(PIECE, np.int64))
                s[np.cumsum(np.frombuffer(zlib.decompress(i), "<u2").astype(np.int64))] += np.frombuffer(zlib.decompress(c), "<u2")
        for p, s in sums.items():
            x = level(s).astype(np.uint8).reshape(-1, each)
            out = x[:, 0]
            for j in range(1, each):
                out = out | (x[:, j] << np.uint8(j * width))
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["p", "c"])

    size = PIECE // each
    levels = bytearray((1 << bits) // each)
    for r in cells.repartition("p").mapInArrow(merge, "p int, c binary").toLocalIterator():
        levels[r.p * size : (r.p + 1) * size] = r.c
    return bytes(levels)


def looked_up(levels: np.ndarray, cells: np.ndarray, width: int) -> np.ndarray:
    each = 8 // width
    return levels[cells // each] >> ((cells % each) * width).astype(np.uint8) & np.uint8((1 << width) - 1)


EDGES = np.array([1, 2, 3, 4, 6, 10, 20, 40, 100, 250, 512, 2048, 16384, 131072, 1048576])  # least count of the levels 1 to 15


def level_of(count: np.ndarray | int) -> np.ndarray:
    return np.searchsorted(EDGES, count, side="right")


def bits_for(total: int, most_bits: int) -> int:
    return min(most_bits, max(16, math.ceil(math.log2(1.45 * total + 1))))  # 0.35 to 0.7 keys a cell below the bound


def count_sketch(sets: DataFrame, total: int, most_bits: int = 26) -> tuple[bytes, int]:
    """Levels of the counts of all runs by hash cell, 4 bits each; cells grow with the corpus up to 2^most_bits, which bounds what the driver gets and hands out (32 MB)."""
    bits = bits_for(total, most_bits)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = CellCounts(bits)
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                blob = b"".join(x for x in b.column(0).slice(i, 4096).to_pylist() if x)
                yield from counts.add(cell_of(unpack(blob), bits))
        yield from counts.packed()

    return gathered(sets.select("sh").mapInArrow(partial, "p int, i binary, c binary"), bits, level_of, 4), bits


RATIO = math.log(1.1)


def size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / RATIO).astype(np.int64)


SLOTS, PLACES = 16, 4  # size classes of a run that stand side by side (classes that far apart can't pair, so one may serve both), and parts of the early places


def sized_cell(h: np.ndarray, side: np.ndarray, c: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
    return (cell_of(h.astype(np.uint64) ^ (side % 2).astype(np.uint64) << np.uint64(48), bits - 6) * SLOTS + c % SLOTS) * PLACES + place


def place_of(share: np.ndarray, t: float) -> np.ndarray:
    """The part of the early places that a place (as a share of the set) lies in."""
    return np.clip(np.floor(share / (1 - t) * PLACES + 1e-9).astype(np.int64), 0, PLACES - 1)


class EarlyRuns:
    """Of a batch of distinct sets the early runs whose cell counts more than one: run, row of the batch, size, place in the set's order, level."""

    def __init__(self, levels: bytes, bits: int, t: float):
        self.levels, self.bits, self.t = np.frombuffer(levels, np.uint8), bits, t

    def __call__(self, sh: list[bytes]) -> tuple[np.ndarray, ...]:
        n = np.array([len(x) // WIDE for x in sh], np.int64)
        h = unpack(b"".join(sh))
        doc = np.repeat(np.arange(len(sh)), n)
        lv = looked_up(self.levels, cell_of(h, self.bits), 4)
        o = np.lexsort((h, lv, doc))
        h, lv = h[o], lv[o]
        pos = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        early = n - np.ceil(self.t * n - 1e-9).astype(np.int64) + 1
        use = (pos < np.repeat(early, n)) & (lv > 1)
        return h[use], doc[use], n[doc[use]], pos[use], lv[use]


def partner_sketch(sets: DataFrame, sketch, bits: int, t: float, total: int, most_bits: int = 28) -> tuple[bytes, int]:
    """Counts (0, 1, 2, more) of early runs by hash cell of run and side, for each size class and part of the places, 2 bits each (at most 64 MB)."""
    own = bits_for(8 * total, most_bits)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        early, counts = EarlyRuns(sketch.value, bits, t), CellCounts(own)
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                c = b.slice(i, 2048)
                h, doc, n, pos, _ = early(c.column(1).to_pylist())
                yield from counts.add(sized_cell(h, c.column(0).to_numpy()[doc], size_class(n), place_of(pos / n, t), own))
        yield from counts.packed()

    return gathered(sets.select("side", "sh").mapInArrow(partial, "p int, i binary, c binary"), own, lambda s: np.minimum(s, 3), 2), own


def has_partner(h: np.ndarray, n: np.ndarray, pos: np.ndarray, side: np.ndarray, t: float, counts: np.ndarray, bits: int, two_sided: bool) -> np.ndarray:
    """Whether another set (of the other side, if there are two) may have this run early, at a size and place at which the two could reach t with it as their first common run."""
    lo = size_class(np.ceil(t * n - 1e-6))
    hi = size_class(np.floor(np.minimum(n / t, (n - pos) * (1 + t) / t - n) + 1e-6))
    mine, place, found = size_class(n), place_of(pos / n, t), np.zeros(len(h), bool)
    for j in range(int((hi - lo).max(initial=-1)) + 1):
        at = np.flatnonzero((lo + j <= hi) & ~found)
        c = lo[at] + j
        size = np.minimum(np.exp((c + 1) * RATIO), n[at] / t)  # the largest of the class can have it latest
        far = 1 - t / (1 + t) * (1 + n[at] / size)
        last = place_of(far, t)
        for p in range(PLACES):
            use = (far >= -1e-9) & (p <= last)
            x = at[use]
            m = looked_up(counts, sized_cell(h[x], side[x] + two_sided, c[use], np.full(len(x), p), bits), 2).astype(np.int64)
            found[x] |= m - ((c[use] == mine[x]) & (place[x] == p) & (not two_sided)) > 0
    return found


def early_runs(sets: DataFrame, sketch, bits: int, partners, own: int, t: float, hot: int, warm: bool, two_sided: bool) -> DataFrame:
    """The early runs of every distinct set that may have a partner, cold ones as (tok, k, side, n, pos, vector), hot ones as (tok, k, side, owner). pos: place in
    the set's order, owner: the least by hash of the set's hot runs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        early, counts = EarlyRuns(sketch.value, bits, t), np.frombuffer(partners.value, np.uint8)
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                c = b.slice(at, 2048)
                k, side, sh = c.column(0).to_numpy(), c.column(1).to_numpy(), c.column(2).to_pylist()
                h, doc, n, pos, lv = early(sh)
                use = (lv >= hot) == warm
                h, doc, n, pos = h[use], doc[use], n[use], pos[use]
                use = has_partner(h, n, pos, side[doc], t, counts, own, two_sided)
                h, doc, n, pos = h[use].astype(np.int64), doc[use], n[use], pos[use]
                if not len(h):
                    continue
                cols = [pa.array(h, pa.int64()), pa.array(k[doc], pa.int64()), pa.array(side[doc], pa.int32())]
                if warm:
                    first, o = np.zeros(len(k), np.int64), np.argsort(mix(h, 61))[::-1]
                    first[doc[o]] = h[o]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(first[doc], pa.int64())], ["tok", "k", "side", "owner"])
                else:
                    some = np.unique(doc)
                    v = folded(unpack(b"".join(sh[i] for i in some.tolist())), np.array([len(sh[i]) // WIDE for i in some.tolist()])).view(np.int64)[np.searchsorted(some, doc)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int32()), pa.array(pos, pa.int32()), *[pa.array(x, pa.int64()) for x in v.T]], ["tok", "k", "side", "n", "pos", *VECTOR])

    return sets.select("k", "side", "sh").mapInArrow(work, "tok bigint, k bigint, side int, " + ("owner bigint" if warm else f"n int, pos int, {BITS}"))


# Depths in bits at which the walk widens: several binary levels are taken at once, with the same nodes and sums as one by one.
DEPTHS = (4, 8, 16, 32, 64, 128, 192, 256, 320, 384, 448, 512)


def trie_self_join(v: np.ndarray, root: np.ndarray, roots: tuple[np.ndarray, np.ndarray], n: np.ndarray, t: float, budget: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, differing bits) of all pairs within budget. v: bit vectors, root: the trie of each, roots: the pairs of tries to walk, n: set sizes,
    budget: the most bits that may differ; without one it is that of the two sets' sizes."""
    c = (1 - t) / (1 + t)
    order = np.lexsort([*[v[:, i] for i in reversed(range(v.shape[1]))], root])
    v, root, n = v[order], root[order], n[order]
    change = np.ones(len(root), bool)
    change[1:] = root[1:] != root[:-1]
    ids = np.cumsum(change) - 1
    there = root[change]
    u, w = np.searchsorted(there, roots[0]), np.searchsorted(there, roots[1])
    known = (u < len(there)) & (w < len(there))
    u, w, r0, r1 = u[known], w[known], roots[0][known], roots[1][known]
    known = (there[u] == r0) & (there[w] == r1)
    u, w = u[known], w[known]
    acc = np.zeros(len(u), np.int64)
    depth = 0
    for d in (*(d for d in DEPTHS if d <= 64 * v.shape[1]), None):
        if not len(u):
            break
        parent = ids
        if d is None:
            change = np.ones(len(root), bool)  # the members below each leaf
        else:
            word, shift, width = depth // 64, 64 - (d - 64 * (depth // 64)), d - depth
            seg = (v[:, word] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            new = np.zeros(len(root), bool)
            new[1:] = seg[1:] != seg[:-1]
            change = change | new
            depth = d
        ids = np.cumsum(change) - 1
        first = np.flatnonzero(change)
        most, least = np.maximum.reduceat(n, first), np.minimum.reduceat(n, first)
        up = parent[first]  # parent of each node
        lo = np.searchsorted(up, np.arange(up[-1] + 2))
        kids = np.diff(lo)
        count = kids[u] * kids[w]
        rep = np.repeat(np.arange(len(u)), count)
        i = np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count)
        kw = kids[w][rep]
        a, b = lo[u][rep] + i // kw, lo[w][rep] + i % kw
        acc = acc[rep]
        ok = (u[rep] != w[rep]) | (a < b if d is None else a <= b)
        if d is not None:
            s = seg[first]
            acc = acc + np.bitwise_count(s[a] ^ s[b])
        ok &= (acc <= (c * (most[a] + most[b]) + 1e-9 if budget is None else budget)) & (most[a] >= t * least[b] - 1e-9) & (most[b] >= t * least[a] - 1e-9)
        u, w, acc = a[ok], b[ok], acc[ok]
    return order[u], order[w], acc


def fits(a: np.ndarray, b: np.ndarray, n: np.ndarray, pos: np.ndarray, t: float) -> np.ndarray:
    """Pairs whose sizes are within t and, if the block's run is the first that both have, that have enough runs left."""
    na, nb = n[a], n[b]
    return (np.minimum(na, nb) >= t * np.maximum(na, nb) - 1e-9) & (1 + np.minimum(na - 1 - pos[a], nb - 1 - pos[b]) >= t / (1 + t) * (na + nb) - 1e-9)


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives both rows of every pair the smallest label reached, in place."""
    while True:
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            return
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)


SMALL = 64  # runs up to which 128 parity bits tell sets apart well


def folded(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """256 parity bits a set as their halves' sum and the second half; small sets have the sum alone, which is their 128 parity bits."""
    v = parity_vectors(h, n, WORDS)
    half = WORDS // 2
    return np.concatenate((v[:, :half] ^ v[:, half:], np.where((n > SMALL)[:, None], v[:, half:], np.uint64(0))), axis=1)


def unfolded_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of the whole vectors of large sets."""
    d, half = a ^ b, WORDS // 2
    return np.bitwise_count(d[:, :half] ^ d[:, half:]).sum(axis=1, dtype=np.int64) + np.bitwise_count(d[:, half:]).sum(axis=1, dtype=np.int64)


def paired_rows(at: np.ndarray, size: np.ndarray, side: np.ndarray, n: np.ndarray, pos: np.ndarray, v: np.ndarray, t: float, two_sided: bool) -> np.ndarray:
    """A label for each row, -1 where no pair of its block (from `at`, of `size` rows each) passes the parity vectors' error budget and fits(); rows linked by passing
    pairs have one label. Of two sides, every block has a trie for each."""
    good = np.zeros(len(n), bool)
    label = np.arange(len(n))
    c = (1 - t) / (1 + t)
    part = np.cumsum(size.astype(np.int64) ** 2) // 2_000_000
    for x in np.unique(part).tolist():
        at_, size_ = at[part == x], size[part == x]
        rows = np.repeat(at_ - (np.cumsum(size_) - size_), size_) + np.arange(size_.sum())
        root = np.repeat(np.arange(len(at_)), size_) * 2 + (side[rows] % 2 if two_sided else 0)
        each = np.arange(len(at_)) * 2
        a, b, _ = trie_self_join(v[rows, : WORDS // 2], root, (each, each + two_sided), n[rows], t)
        a, b = rows[a], rows[b]
        ok = fits(a, b, n, pos, t)
        a, b = a[ok], b[ok]
        ok = (np.minimum(n[a], n[b]) <= SMALL) | (unfolded_distance(v[a], v[b]) <= c * (n[a] + n[b]) + 1e-9)
        a, b = a[ok], b[ok]
        good[a] = good[b] = True
        joined(label, a, b)
    return np.where(good, label, -1)


def whole_tokens(batches: Iterator[pa.RecordBatch], most: int = 100_000) -> Iterator[list[np.ndarray]]:
    """Columns of some whole tokens at a time, from batches sorted by token (first column). No more is held than `most` rows and one token."""
    held: list[list[np.ndarray]] = []
    n = 0
    for b in batches:
        cols = [c.to_numpy() for c in b.columns]
        tok = cols[0]
        if n >= most and len(tok):
            last = held[-1][0][-1]
            cut = len(tok) if tok[-1] == last else int(np.argmax(tok != last))
            held.append([c[:cut] for c in cols])
            cols, n = [c[cut:] for c in cols], n + cut
            if len(cols[0]):
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held, n = [], 0
        if len(cols[0]):
            held.append(cols)
            n += len(cols[0])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def cold_blocks(early: DataFrame, t: float, two_sided: bool, scratch: Scratch) -> DataFrame:
    """(block, k, side, part): the sets that share a cold run, without those that it can pair with no other; of a two-sided join across sides only.
    A cold run stands in few sets by the sketch, which never counts too little, so a task holds some thousand rows of sorted input."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for tok, k, side, n, pos, *v in whole_tokens(batches):
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            at = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
            size = np.diff(np.concatenate((at, [len(tok)])))
            label = paired_rows(at[size > 1], size[size > 1], side, n, pos, np.stack(v, axis=1).view(np.uint64), t, two_sided)
            o = np.lexsort((side, k, label))
            o = o[np.count_nonzero(label < 0) :]
            label, k, side = label[o], k[o], side[o]
            at = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1], [True]))).tolist() if len(label) else []
            out = []
            if len(seen) > 1_000_000:
                seen.clear()
            for i, j in zip(at[:-1], at[1:], strict=True):
                ks, ss = k[i:j], side[i:j]
                b = xxhash.xxh3_64_intdigest(ks.tobytes() + ss.tobytes()) - (1 << 63)
                if b not in seen:
                    seen.add(b)
                    out.append((b, ks.tolist(), ss.tolist()))
            if out:
                yield _lists(out)

    lists = scratch.keep(early.repartition("tok").sortWithinPartitions("tok").mapInArrow(work, "block bigint, ks array<bigint>, ss array<int>").dropDuplicates(["block"]))
    return starred(lists.select("block", F.col("ks")[0].alias("least"), F.explode(F.arrays_zip("ks", "ss")).alias("x")).select("block", "least", F.col("x.ks").alias("k"), F.col("x.ss").alias("side"))).withColumn("part", F.lit(2))


def starred(rows: DataFrame) -> DataFrame:
    """(block, k, side) of lists (block, least, k, side) that may overlap: lists with one least set are put together where they have no more than MERGED places."""
    wide = rows.groupBy("least").agg(F.count("*").alias("m")).filter(F.col("m") > MERGED)
    rows = rows.join(wide, "least", "left")
    return rows.select(F.when(F.col("m").isNull(), F.col("least")).otherwise(F.col("block")).alias("block"), "k", "side").distinct()


def gathered_lists(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(block, k, side) of lists (block, least, k, side), with lists that hang together in one block, so that a set stands in few blocks. The least set is handed on in two rounds; any labels
    will do, for all of a list goes to one block. Where a label has more than MERGED places its lists stay apart as in starred()."""
    rows = scratch.keep(rows)
    stars = scratch.keep(rows.select("least", "k").distinct())
    label = stars.select("least", F.col("least").alias("to")).distinct()
    for _ in range(2):
        of = stars.join(label, "least").groupBy("k").agg(F.min("to").alias("to"))
        label = scratch.keep(stars.join(of, "k").groupBy("least").agg(F.min("to").alias("to")))
    size = stars.join(label, "least").groupBy("to").agg(F.count("*").alias("m"))
    to = label.join(size, "to").select("least", F.when(F.col("m") <= MERGED, F.col("to")).alias("to"))
    rows = rows.join(to, "least")
    return rows.filter("to is not null").select(F.col("to").alias("block"), "k", "side").distinct().unionAll(starred(rows.filter("to is null").select("block", "least", "k", "side")))


def _lists(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.int32()))], ["block", "ks", "ss"])


def families(early: DataFrame) -> DataFrame:
    """(family, k, side): the sets that share a hot run. Runs of one boilerplate lead the same sets, so each run joins the family of the run that is the owner of at least half of its
    sets, if there is one. Two sets that share a run share its family; a set stands in a family once."""
    size = early.groupBy("tok", "owner").agg(F.count("*").alias("m"))
    family = size.groupBy("tok").agg(F.max_by("owner", "m").alias("o"), F.max("m").alias("most"), F.sum("m").alias("all")).select("tok", F.when(F.col("most") * 2 >= F.col("all"), F.col("o")).otherwise(F.col("tok")).alias("family"))
    return early.select("tok", "k", "side").join(family, "tok").select("family", "k", "side").distinct()


def hot_blocks(rows: DataFrame, chunk: int) -> DataFrame:
    """(block, k, side, part): every chunk of one side of a family with every chunk of the other. Families of one side only need no look."""
    n = rows.groupBy("family").agg(F.ceil(F.count_if(F.col("side") % 2 == 1) / chunk).cast("int").alias("c1"), F.ceil(F.count_if(F.col("side") % 2 == 0) / chunk).cast("int").alias("c0")).filter("c1 > 0 and c0 > 0")
    out = None
    for side, own, other in ((1, "c1", "c0"), (0, "c0", "c1")):
        mine = rows.filter(F.col("side") % 2 == side).join(n, "family").withColumn("me", F.pmod(F.xxhash64("k"), F.col(own)).cast("int")).withColumn("you", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        pair = ("me", "you") if side else ("you", "me")
        mine = mine.select(F.xxhash64("family", *pair).alias("block"), "k", "side", F.lit(2).alias("part"))
        out = mine if out is None else out.unionAll(mine)
    return out


class HubFinder:
    """(block, set, hub) of the sets (part 1) of each block that reach t with a hub (part 0): the first such hub, but every one for a set that is a hub itself."""

    def __init__(self, t: float):
        self.t = t

    def __call__(self, b: Batch) -> list[np.ndarray]:
        c, out = (1 - self.t) / (1 + self.t), []
        for x in np.unique(b.block).tolist():
            here = np.flatnonzero(b.block == x)
            hubs, sets = here[b.part[here] == 0], here[b.part[here] == 1]
            is_hub = np.isin(b.k[sets], b.k[hubs])
            done = np.zeros(len(sets), bool)
            for h in hubs.tolist():
                far = np.bitwise_count(b.v[sets] ^ b.v[h]).sum(axis=1, dtype=np.int64)
                for i in np.flatnonzero((far <= c * (b.n[sets] + b.n[h]) + 1e-9) & ~(done & ~is_hub)).tolist():
                    both = len(np.intersect1d(b.runs(sets[i]), b.runs(h), assume_unique=True))
                    if both >= self.t * (b.n[sets[i]] + b.n[h] - both) - 1e-9:
                        done[i] = True
                        out.append((int(b.name[h]), int(b.k[sets[i]]), int(b.k[h])))
        return [np.array([o[i] for o in out], np.int64) for i in range(3)]


def _classes(t: pa.Table) -> pa.Table:
    """Hubs of one family (at most HUBS squared rows) with the least hub that they are joined to."""
    a, b = t.column("k").to_numpy(), t.column("hub").to_numpy()
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    label = np.arange(len(ids))
    joined(label, at[: len(a)], at[len(a) :])
    return pa.table({"family": pa.array([t.column("family")[0].as_py()] * len(ids), pa.int64()), "hub": pa.array(ids, pa.int64()), "class": pa.array(ids[label], pa.int64())})


HUBS = 8


def hub_blocks(rows: DataFrame, sets: DataFrame, t: float, chunk: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(block, k, side, part) of the pairs of a family that a self-join has still to look at, and verified links (a, b).

    Of a family beyond one chunk every set is compared with a few hubs, sets of the family taken by hash. Sets that reach the same hub, or hubs that reach each other, are linked, so pairs among them
    need no look, and the work is in proportion to the family. What is left are pairs with a set outside the largest class: those sets' chunks meet all chunks.
    """
    size = rows.groupBy("family").agg(F.count("*").alias("m"))
    wide = size.filter(F.col("m") > chunk)
    one = rows.join(size.filter(F.col("m").between(2, chunk)), "family").select(F.xxhash64("family").alias("block"), "k", "side", F.lit(2).alias("part"))
    if wide.isEmpty():
        return one, None
    big = scratch.keep(rows.join(wide, "family").withColumn("c", F.ceil(F.col("m") / chunk).cast("int")).withColumn("me", F.pmod(F.xxhash64("k"), F.col("c")).cast("int")))
    least = [F.min(F.struct(F.xxhash64(F.lit(j), F.col("k")).alias("h"), F.col("k").alias("k")))["k"] for j in range(HUBS)]
    hubs = scratch.keep(big.groupBy("family").agg(F.array_distinct(F.array(*least)).alias("x"), F.first("c").alias("c"), F.first("side").alias("side")).select("family", "c", "side", F.explode("x").alias("k")))
    block = F.xxhash64("family", "me")
    near = hubs.withColumn("me", F.explode(F.sequence(F.lit(0), F.col("c") - 1))).select(block.alias("block"), F.lit(0).alias("part"), "side", "k").unionAll(big.select(block.alias("block"), F.lit(1).alias("part"), "side", "k"))
    hit = only_in(sets, *handed_out(sets.sparkSession, bloom(big.select("k")))).select("k", "sh")
    found = scratch.keep(each_batch(near.join(hit, "k").select("block", "part", "side", "k", "sh"), lambda: HubFinder(t), "block bigint, k bigint, hub bigint"))
    of = found.join(big.select(block.alias("block"), "family").distinct(), "block").select("family", "k", "hub")
    classes = of.join(hubs.select("family", "k"), ["family", "k"], "left_semi").groupBy("family").applyInArrow(_classes, "family bigint, hub bigint, class bigint")
    mine = scratch.keep(of.join(classes, ["family", "hub"]).groupBy("family", "k").agg(F.min("class").alias("class")))
    main = mine.groupBy("family", "class").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("class", F.struct("n", "class")).alias("class"))
    rest = scratch.keep(big.join(mine.join(main, ["family", "class"], "left_semi"), ["family", "k"], "left_anti"))
    few = rest.groupBy("family").agg(F.count("*").alias("u")).select("family", F.ceil(F.col("u") / chunk).cast("int").alias("d"))
    pair = F.xxhash64("family", "i", "me")
    left = rest.join(few, "family").withColumn("i", F.pmod(F.xxhash64(F.lit(1), F.col("k")), F.col("d")).cast("int")).withColumn("me", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    right = big.join(few, "family").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d") - 1)))
    cols = ["k", "side"]
    more = left.select(pair.alias("block"), *cols, F.lit(0).alias("part")).unionAll(right.select(pair.alias("block"), *cols, F.lit(1).alias("part")))
    return one.unionAll(more), found.filter("k <> hub").select(F.col("hub").alias("a"), F.col("k").alias("b"))


def bloom(keys: DataFrame, most_bits: int = 26) -> tuple[bytes, int]:
    """A bitmap of hashed 64-bit keys (one column), of 16 bits a key up to 2^most_bits bits (8 MB), which bounds what the driver gets and hands out."""
    bits = min(most_bits, max(16, math.ceil(math.log2(16 * keys.count() + 1))))
    piece = 1 << 12  # bytes

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros(1 << bits, bool)
        for b in batches:
            m[cell_of(b.column(0).to_numpy(), bits)] = True
        m = np.packbits(m)
        ids = [p for p in range(-(-len(m) // piece)) if m[p * piece : (p + 1) * piece].any()]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([zlib.compress(m[p * piece : (p + 1) * piece].tobytes(), 1) for p in ids], pa.binary())], ["p", "m"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_: dict[int, np.ndarray] = {}
        for b in batches:
            for p, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                m = np.frombuffer(zlib.decompress(m), np.uint8)
                all_[p] = all_[p] | m if p in all_ else m
        yield pa.RecordBatch.from_arrays([pa.array(list(all_), pa.int32()), pa.array([m.tobytes() for m in all_.values()], pa.binary())], ["p", "m"])

    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for r in keys.mapInArrow(partial, "p int, m binary").repartition("p").mapInArrow(merge, "p int, m binary").toLocalIterator():
        out[r.p * piece : r.p * piece + len(r.m)] = np.frombuffer(bytes(r.m), np.uint8)
    return out.tobytes(), bits


def in_bloom(h: np.ndarray, bitmap: bytes, bits: int) -> np.ndarray:
    c = cell_of(h, bits)
    return (np.frombuffer(bitmap, np.uint8)[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)


def only_in(df: DataFrame, bitmap, bits: int, inside: bool = True) -> DataFrame:
    """Rows whose first column may be in the bitmap, or those that surely are not."""
    names = df.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(b.filter(pa.array(in_bloom(b.column(0).to_numpy(), bitmap.value, bits) == inside)).columns, names)

    return df.mapInArrow(work, df.schema)


def blocks(base: DataFrame, copied: DataFrame, t: float, scratch: Scratch, two_sided: bool = False, chunk: int = 1024, hot_count: int = 512) -> tuple[DataFrame, tuple, DataFrame | None]:
    """(block, part, side, k, sh) of all candidate blocks, the broadcast sketch with its bits, and links (a, b) that need no block."""
    spark: SparkSession = base.sparkSession
    sets = distinct_sets(base, copied, scratch)
    total = base.agg(F.sum("n")).first()[0] or 0
    levels, bits = count_sketch(sets, total)
    sketch = spark.sparkContext.broadcast(levels)
    partners, own = handed_out(spark, partner_sketch(sets, sketch, bits, t, math.ceil((1 - t) * total)))
    hot = int(level_of(hot_count))
    early = lambda warm: early_runs(sets, sketch, bits, partners, own, t, hot, warm, two_sided)
    hot_rows, links = scratch.keep(families(scratch.keep(early(True)))), None
    if two_sided:
        warm = hot_blocks(hot_rows, chunk)
    else:
        warm, links = hub_blocks(hot_rows, sets, t, chunk, scratch)
    cold = cold_blocks(early(False), t, two_sided, scratch)
    found = scratch.keep(cold.select("block", "part", "k", "side").unionAll(warm.select("block", "part", "k", "side")))
    partners.destroy()  # nothing that is still to be computed reads it
    some = only_in(sets, *handed_out(spark, bloom(found.select("k"))))
    rows = found.join(long_vectors(some), "k").select("block", "part", "side", "k", "v")
    lists = each_batch(rows, lambda: ListFinder(t, two_sided), "block bigint, least bigint, k bigint, side int", VectorBatch, most_rows=20_000).distinct()
    last = scratch.keep(gathered_lists(lists, scratch))
    needed = only_in(sets, *handed_out(spark, bloom(last.select("k")))).select("k", "sh")
    return last.join(needed, "k").select("block", F.lit(2).alias("part"), "side", "k", "sh"), (sketch, bits), links


def handed_out(spark: SparkSession, x: tuple[bytes, int]) -> tuple:
    return spark.sparkContext.broadcast(x[0]), x[1]


def parity_vectors(h: np.ndarray, n: np.ndarray, words: int) -> np.ndarray:
    """words x 64 bits a set: each run flips one bit, so two vectors differ in at most as many bits as the sets in runs."""
    bits = words * 64
    doc = np.repeat(np.arange(len(n)), n)
    bit = (mix(h, 31) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(doc * bits + bit, minlength=len(n) * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(n), bits), axis=1).view(">u8").astype(np.uint64)


LONG = 8  # words of the parity vector that candidates walk again


def long_vectors(sets: DataFrame) -> DataFrame:
    """(k, v) of the sets: their sizes and 512 parity bits in one binary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                c = b.slice(i, 2048)
                sh = c.column(1).to_pylist()
                n = np.array([len(x) // WIDE for x in sh], np.int64)
                out = np.concatenate((n[:, None].astype(np.uint64), parity_vectors(unpack(b"".join(sh)), n, LONG)), axis=1)
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array([x.tobytes() for x in out], pa.binary())], ["k", "v"])

    return sets.select("k", "sh").mapInArrow(work, "k bigint, v binary")


class Batch:
    """Whole blocks side by side: block (its place), name, part, side, k, n of each row; h holds the runs of all rows, row i from at[i] to at[i + 1]."""

    def __init__(self, held: list[tuple]):
        ids: dict[int, int] = {}
        self.block = np.array([ids.setdefault(x[0], len(ids)) for x in held], np.int64)
        self.name, self.part, self.side, self.k = (np.array([x[i] for x in held], np.int64) for i in (0, 1, 2, 3))
        self.read([x[4] for x in held])

    def read(self, sets: list[bytes]) -> None:
        self.h = unpack(b"".join(sets))
        self.n = np.array([len(x) // WIDE for x in sets], np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.n)))
        self.v = parity_vectors(self.h, self.n, LONG)

    def runs(self, i: int) -> np.ndarray:
        return self.h[self.at[i] : self.at[i + 1]]

    def pairs(self, t: float, two_sided: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of rows of one block, across its two parts where it has two, that the walk over the parity bits leaves, and their differing bits. Two-sided: a trie a side."""
        root = self.block * 6 + self.part * 2
        if two_sided:
            root = root + self.side % 2
            here, at = np.unique(self.block * 3 + self.part, return_index=True)
            here, part = here // 3, self.part[at]
            roots = here * 6 + part * 2 + 1, here * 6 + np.where(part == 2, 2, 1 - part) * 2
        else:
            alone, has = np.unique(self.block[self.part == 2]), np.unique(self.block[self.part != 2])
            roots = np.concatenate((alone * 6 + 4, has * 6)), np.concatenate((alone * 6 + 4, has * 6 + 2))
        return trie_self_join(self.v, root, roots, self.n, t)


class VectorBatch(Batch):
    """Blocks of sizes and parity vectors instead of sets."""

    def read(self, sets: list[bytes]) -> None:
        x = np.frombuffer(b"".join(sets), np.uint64).reshape(len(sets), LONG + 1)
        self.n, self.v = x[:, 0].astype(np.int64), x[:, 1:]


class ListFinder:
    """Lists of sets that pairs left by the walk join: (list, its least set, set, side)."""

    def __init__(self, t: float, two_sided: bool):
        self.t, self.two_sided = t, two_sided

    def __call__(self, b: Batch) -> list[np.ndarray]:
        i, j, _ = b.pairs(self.t, self.two_sided)
        label = np.arange(len(b.n))
        joined(label, i, j)
        good = np.unique(np.concatenate((i, j)))
        o = good[np.lexsort((b.k[good], label[good]))]
        label, k, side = label[o], b.k[o], b.side[o]
        first = np.ones(len(o), bool)
        first[1:] = label[1:] != label[:-1]
        at = np.flatnonzero(first)
        of = np.cumsum(first) - 1
        name = np.add.reduceat(mix(k.astype(np.uint64) * np.uint64(2) + (side % 2).astype(np.uint64), 17), at).view(np.int64) if len(at) else np.zeros(0, np.int64)
        return [name[of], k[at][of], k, side]


def each_batch(rows: DataFrame, make: Callable[[], Callable[[Batch], list[np.ndarray]]], schema: str, kind: type[Batch] = Batch, most_rows: int = 6000, most_pairs: int = 3_000_000) -> DataFrame:
    """make() gives, once a task, a function from a batch of whole blocks to columns. Tasks hold some thousand rows at a time."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = [{"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, held, now, began, pairs = make(), [], None, 0, 0

        def done() -> Iterator[pa.RecordBatch]:
            cols = work(kind(held))
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for b in batches:
            for at in range(0, b.num_rows, 1000):
                for row in zip(*[b.column(i).slice(at, 1000).to_pylist() for i in range(5)], strict=True):
                    if row[0] != now:
                        pairs += (len(held) - began) ** 2
                        if len(held) > most_rows or pairs > most_pairs:
                            yield from done()
                            held, pairs = [], 0
                        now, began = row[0], len(held)
                    held.append(row)
        if held:
            yield from done()

    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, schema)
