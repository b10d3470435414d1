"""Operator 1: exact n-gram Jaccard join with set-relation skipping, and its components.

A document's set holds the 64-bit hashes of its distinct word shingles.  Documents
with equal sets form a class and are handled once.

1. **Screen.**  A set x with a partner misses at most ``m(x) = |x| - ceil(t |x|)`` of its
   members in that partner, so of any part of x all but m(x) members occur in a second
   set.  The quarter of the hash range is exchanged by hash bucket; buckets say for each
   class how many of its members there occur in another class, if any do.  Classes with too
   few are out.  That is exact and leaves few classes of a corpus.
2. **Index.**  For the classes left, members that occur in two classes or more are
   ordered by (how many classes, hash); members of one class come first.  The first
   ``m(x) + 1`` members of a set are its prefix; partners share a prefix member.  The
   index has a list for every prefix member, each entry with set size and position.
3. **Answer-level skipping.**  In each list all sets are compared with one pivot, the least
   class of the commonest sizes.  Sets that link with it are in one component and need no comparison with
   one another.  Between different components, the answers for the pivot bound those of
   the others: Jaccard distance is a metric, so sets whose distances to the pivot differ
   by more than ``1 - t`` cannot link.  Pivots change over a few rounds, so a list costs its
   length for each round.
4. **Index-level skipping.**  The sets that pivots leave open are laid out in blocks of a list:
   a band of sizes, a band of positions, ``BLOCK`` sets at most.  Blocks of a list are joined,
   and a pair of blocks whose ranges of size, position, rank or distance rule every overlap
   out is skipped whole; tasks expand the others.  A pair is named in the first list it shares.
   Before the members of a pair are fetched, the counts of members in ``BINS`` parts of the
   hash range bound the overlap; only pairs that pass are compared, exactly.
5. **Counting.**  Links never leave a component, so the number of links of a class is
   counted over all pairs of its component, those that step 4 skipped among them.  The
   classes of a component go into chunks; a task compares two chunks.  A member that most
   of their sets hold counts as held by all (the pivot set), and overlaps are corrected by
   the sets' differences from it, so a task sums over small differences, and rows are
   classes times chunks, never pairs.

Rows come out per document; links are found between classes only, and a document's number
of links weighs a linked class by its documents and adds the copies of its own set.
NULL, empty and blank texts have no shingles and link with nothing.  With fewer words
than a shingle the whole sequence is one.  Repeated rows are in one class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, as_i64, mix64, run_folder, stage, text_blocks, word_hashes
from .components import connected_components
from .url_cascade import Cascade, bloom_level, hash_pair

WIDTH = 4
NUM, DEN = 85, 100             # the least similarity as a fraction
SCREEN = 4                     # one in so many of the hash range is screened
PIVOT_ROUNDS = 2
ROUNDING = 1e-9
MAX_FILTER_BITS = 1 << 28      # the filter of representatives; fuller ones only pass more rows
BUCKET_MEMBERS = 1 << 20       # members that a bucket of the exchange holds
SLICE_MEMBERS = 1 << 19        # members that a task cuts into slices at once
BLOCK, POSITIONS = 256, 32     # sets of a block, and positions that it spans
STEP_PAIRS = 1 << 14           # pairs bounded at once
COMMON_STEP = 1 << 12         # values compared at once
EARLIER = 64                   # prefix members before a list's own that its entries carry
BINS, FULL_BIN = 128, 65535    # parts of the hash range whose counts bound an overlap; this count is no bound
BROADCAST_PAIRS = 1 << 17      # pairs of class keys (32 bytes) that are broadcast
CHUNK = 256                    # classes of a component that a chunk holds; more from CHUNKS chunks on
CHUNKS, MAX_CHUNK = 64, 4096
CHUNK_MEMBERS = 1 << 21
STRIP_CELLS = 1 << 22          # classes times members that are laid out at once
SPARSE_PAIRS = 4096            # a member with fewer pairs is enumerated, not multiplied


def shingle_sets(col: pa.Array, width: int) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each text."""
    n = len(col)
    h, row = word_hashes(col)
    per_row = np.bincount(row, minlength=n)
    mult = mix64(np.arange(1, width + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)
    k = max(0, len(h) - width + 1)
    full = np.zeros(k, U64)
    for j in range(width):
        full += h[j:j + k] * mult[j]
    fits = row[:k] == row[width - 1:width - 1 + k] if k else np.zeros(0, bool)
    vals, rows = [mix64(full[fits])], [row[:k][fits]]
    short = np.flatnonzero((per_row > 0) & (per_row < width))
    if len(short):                                  # the whole sequence as one, marked by its length
        first = np.concatenate([[0], np.cumsum(per_row)])[short]
        one = np.zeros(len(short), U64)
        for j in range(width - 1):
            has = per_row[short] > j
            one[has] += h[first[has] + j] * mult[j]
        vals.append(mix64(one + per_row[short].astype(U64) * U64(0x9E3779B97F4A7C15)))
        rows.append(short)
    vals, rows = np.concatenate(vals), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return [np.unique(x) for x in np.split(vals[order], np.cumsum(np.bincount(rows, minlength=n))[:-1])]


KEY_BYTES, SCREEN_KEY = 16, 12         # bytes of a class key, and of it in the screen


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


class Threshold:
    """Integer arithmetic of ``den * overlap >= num * union``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def may_miss(self, n):
        """Members of a set of n that a partner may lack."""
        return n - -(-self.num * n // self.den)

    def least_size(self) -> int:
        """Smallest set that can link with a different one: den * n >= num * (n + 1)."""
        return -(-self.num // (self.den - self.num))

    def links(self, inter: Column, n_a: Column, n_b: Column) -> Column:
        return self.den * inter >= self.num * (n_a + n_b - inter)


# ------------------------------------------------------------------ exchange by bucket

def _slices(key: list[bytes], size: list[int], vals: list[np.ndarray], n_buckets: int):
    """Rows (bucket, keys, sizes, counts, vals) of the members of some classes; a class
    without members goes to bucket 0, so that it is seen.  Without ``size`` there are no sizes."""
    owner = np.repeat(np.arange(len(vals), dtype=np.int32), [len(v) for v in vals])
    v = np.concatenate([*vals, np.zeros(0, U64)])
    bucket = (v >> U64(40)) % U64(n_buckets)
    order = np.argsort(bucket, kind="stable")
    owner, v, bucket = owner[order], v[order], bucket[order].astype(np.int64)
    keys = np.frombuffer(b"".join(key), f"V{len(key[0])}")
    sizes = np.array(size, np.int32) if size else None
    ends = np.searchsorted(bucket, np.arange(n_buckets + 1))
    none = np.array([k for k, x in enumerate(vals) if not len(x)], np.int64)
    rows = []
    for b in range(n_buckets):
        part, pv = owner[ends[b]:ends[b + 1]], v[ends[b]:ends[b + 1]]
        who, c = np.unique(part, return_counts=True)      # owners are ascending within a bucket
        if b == 0 and len(none):
            who, c = np.concatenate([who, none]), np.concatenate([c, np.zeros(len(none), np.int64)])
        if len(who):
            rows.append((b, keys[who].tobytes(), b"" if sizes is None else sizes[who].tobytes(), c.astype(np.int32).tobytes(), pv.tobytes()))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5))],
        names=["bucket", "keys", "sizes", "counts", "vals"])


def _shared(t: pa.Table):
    """A bucket: class of each member, member, in how many classes it is; and the
    classes' keys, sizes and counts.  A class that several tasks sent counts once."""
    cols = {c: b"".join(x.as_py() for x in t.column(c)) for c in ("keys", "sizes", "counts", "vals")}
    counts = np.frombuffer(cols["counts"], np.int32)
    keys = np.frombuffer(cols["keys"], f"V{len(cols['keys']) // max(1, len(counts)) or KEY_BYTES}")
    sizes, counts = (np.frombuffer(cols[c], np.int32) for c in ("sizes", "counts"))
    vals = np.frombuffer(cols["vals"], U64)
    halves = np.zeros((len(keys), 16), np.uint8)
    halves[:, :keys.itemsize] = np.frombuffer(cols["keys"], np.uint8).reshape(len(keys), -1) if len(keys) else 0
    del cols
    halves = halves.view(U64)
    by_key = np.lexsort((halves[:, 1], halves[:, 0]))
    runs = halves[by_key]
    keep = np.zeros(len(keys), bool)
    keep[by_key[np.r_[True, (runs[1:] != runs[:-1]).any(1)][:len(keys)]]] = True
    owner = np.repeat(np.arange(len(keys), dtype=np.int32), counts)
    if not keep.all():
        mine = keep[owner]
        owner, vals = owner[mine], vals[mine]
    order = np.argsort(vals, kind="stable")
    sv = vals[order]
    new = np.flatnonzero(np.r_[True, sv[1:] != sv[:-1]][:len(sv)])
    del sv
    times = np.diff(np.r_[new, len(vals)]).astype(np.int32)
    df = np.empty(len(vals), np.int32)
    df[order] = np.repeat(times, times)
    return keys, sizes, counts, keep, owner, vals, df


def _bucketed(rows: DataFrame, n_buckets: int, least: int, key_bytes: int = KEY_BYTES, made=iter) -> DataFrame:
    """Slices of (key, n, members binary) for classes of ``least`` members or more.

    ``made`` turns the batches of ``rows`` into those of (key, n, members), so that one
    Python worker a task does both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()                          # copies within a task go once
        key, size, vals, held = [], [], [], 0
        for b in made(batches):
            for k, n, m in zip(*(b.column(i) for i in range(3))):
                k, n = k.as_py(), n.as_py()
                if k is None or n < least or k in seen:
                    continue
                seen.add(k)
                key.append(k[:key_bytes])
                if key_bytes == KEY_BYTES:                # the screen needs no sizes
                    size.append(n)
                vals.append(np.frombuffer(m.as_py(), U64))
                held += len(vals[-1]) + 1
                if held >= SLICE_MEMBERS:
                    yield _slices(key, size, vals, n_buckets)
                    key, size, vals, held = [], [], [], 0
            if len(seen) > 1 << 20:
                seen.clear()
        if key:
            yield _slices(key, size, vals, n_buckets)

    return rows.mapInArrow(
        run, "bucket int, keys binary, sizes binary, counts binary, vals binary")


def _by_group(keys: np.ndarray, at: np.ndarray, n_groups: int):
    """Classes ``at`` cut into groups by key: (group, classes) for each group that occurs.

    What a bucket knows of its classes is handed on as one row for each group, so the
    rows between two exchanges are buckets times groups, not buckets times classes."""
    head = np.frombuffer(keys[at].tobytes(), np.uint8).reshape(-1, keys.itemsize)[:, :8]
    group = np.ascontiguousarray(head).view(U64).ravel() % U64(n_groups)
    order = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[order], np.arange(n_groups + 1))
    return [(g, at[order[ends[g]:ends[g + 1]]]) for g in range(n_groups) if ends[g] < ends[g + 1]]


def _merged(t: pa.Table, *names: str):
    """A group: its distinct keys with sizes, the class of each handed-on entry, and the
    joined columns ``names`` (name:type)."""
    cols = {n.split(":")[0]: np.frombuffer(b"".join(x.as_py() for x in t.column(n.split(":")[0])), n.split(":")[1])
            for n in ("keys:V16", "sizes:i4", *names)}
    halves = np.frombuffer(cols["keys"].tobytes(), U64).reshape(-1, 2)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    new = np.r_[True, (halves[order][1:] != halves[order][:-1]).any(1)][:len(order)]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    first = order[new]
    return cols["keys"][first], cols["sizes"][first], which, cols


def screen(docs: DataFrame, t: Threshold, n_buckets: int) -> DataFrame:
    """(short, m): the first bytes of a class's key, and how many of its screened members occur
    in another class; classes without any are not named.  A bucket hands its classes on by
    group, so rows are buckets times groups."""

    def count(tab: pa.Table) -> pa.Table:
        keys, _, _, keep, owner, _, df = _shared(tab)
        common = np.bincount(owner[df > 1], minlength=len(keys)) * keep
        rows = [(g, keys[c].tobytes(), common[c].astype(np.int32).tobytes()) for g, c in _by_group(keys, np.flatnonzero(common), n_buckets)]
        return pa.table({"grp": pa.array([r[0] for r in rows], pa.int32()),
                         **{n: pa.array([r[i] for r in rows], pa.binary()) for i, n in enumerate(("keys", "m"), 1)}})

    def add_up(tab: pa.Table) -> pa.Table:
        cols = [np.frombuffer(b"".join(x.as_py() for x in tab.column(c)), k) for c, k in (("keys", f"S{SCREEN_KEY}"), ("m", "i4"))]
        raw = np.frombuffer(cols[0].tobytes(), np.uint8).reshape(-1, SCREEN_KEY)
        order = np.lexsort(raw.T[::-1])
        raw, m = raw[order], cols[1][order]
        first = np.flatnonzero(np.r_[True, (raw[1:] != raw[:-1]).any(1)][:len(raw)])
        total = np.add.reduceat(m.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        return pa.table({"short": pa.array([raw[i].tobytes() for i in first], pa.binary()), "m": pa.array(total)})

    return (_bucketed(docs.select("key", "n", "part"), n_buckets, t.least_size(), SCREEN_KEY).groupBy("bucket")
            .applyInArrow(count, "grp int, keys binary, m binary").groupBy("grp").applyInArrow(add_up, "short binary, m long"))


def index(sets: DataFrame, t: Threshold, n_buckets: int, made=iter) -> DataFrame:
    """Of sets (key, n, members), which ``made`` makes from the batches of ``sets``: (key, n, members, prefix, before, bins): members shared with other classes (ascending,
    binary), the prefix among them, how many members of x stand before the prefix, and the counts
    of the shared members in equal parts of the hash range."""

    def collect(tab: pa.Table) -> pa.Table:
        keys, sizes, _, _, owner, vals, df = _shared(tab)
        at = np.flatnonzero(df > 1)
        order = at[np.argsort(owner[at], kind="stable")]
        owner, vals, df = owner[order], vals[order], df[order]
        del at, order
        have = np.bincount(owner, minlength=len(keys)).astype(np.int32)
        start = np.cumsum(have) - have
        rows = []
        for g, c in _by_group(keys, np.flatnonzero(have), n_buckets):
            own = np.concatenate([np.arange(start[i], start[i] + have[i]) for i in c])
            rows.append((g, keys[c].tobytes(), sizes[c].tobytes(), have[c].tobytes(), vals[own].tobytes(), df[own].tobytes()))
        return pa.table({"grp": pa.array([r[0] for r in rows], pa.int32()), **{
            n: pa.array([r[i] for r in rows], pa.binary()) for i, n in enumerate(("keys", "sizes", "have", "v", "d"), 1)}})

    def prefixes(tab: pa.Table) -> pa.Table:
        keys, sizes, which, cols = _merged(tab, "have:i4", "v:u8", "d:i4")
        of = np.repeat(which, cols["have"])
        order = np.lexsort((cols["v"], cols["d"], of))
        v, of = cols["v"][order], of[order]
        ends = np.searchsorted(of, np.arange(len(keys) + 1))
        out = []
        for i, n in enumerate(sizes.tolist()):
            mine = v[ends[i]:ends[i + 1]]
            alone = n - len(mine)
            take = t.may_miss(n) + 1 - alone
            if take > 0:
                bins = np.minimum(np.bincount((mine >> U64(57)).astype(np.int64), minlength=BINS), FULL_BIN).astype(np.uint16)
                out.append((keys[i].tobytes(), n, np.sort(mine).tobytes(), as_i64(mine[:take]), alone, bins.tobytes()))
        return pa.table({"key": pa.array([r[0] for r in out], pa.binary()), "n": pa.array([r[1] for r in out], pa.int32()),
                         "members": pa.array([r[2] for r in out], pa.binary()),
                         "prefix": pa.array([r[3] for r in out], pa.list_(pa.int64())),
                         "before": pa.array([r[4] for r in out], pa.int32()), "bins": pa.array([r[5] for r in out], pa.binary())})

    return (_bucketed(sets, n_buckets, t.least_size(), made=made).groupBy("bucket")
            .applyInArrow(collect, "grp int, keys binary, sizes binary, have binary, v binary, d binary")
            .groupBy("grp").applyInArrow(prefixes, "key binary, n int, members binary, prefix array<long>, before int, bins binary"))


# --------------------------------------------------------------------------- comparing

def may_link(t: Threshold, n_a: Column, p_a: Column, r_a: Column, n_b: Column, p_b: Column, r_b: Column) -> Column:
    """Whether two blocks (size n, position p, rank r among shared members) of one list
    can hold a linked pair: overlap <= least rank before + 1 + least rest behind."""
    rest = F.least(n_a - p_a, n_b - p_b) + F.least(r_a, r_b)
    return (t.den * F.least(n_a, n_b) >= t.num * F.greatest(n_a, n_b)) & ((t.den + t.num) * rest >= t.num * (n_a + n_b))


def size_band(n: str, t: Threshold) -> Column:
    """Sets whose sizes differ by less than the factor at which no two link."""
    return F.floor(F.log(n) / float(np.log(t.den / t.num))).cast("int")


def _bins(cells) -> np.ndarray:
    h = np.frombuffer(b"".join(x.as_py() for x in cells), np.uint16).reshape(-1, BINS).astype(np.int32)
    h[h == FULL_BIN] = 1 << 30
    return h


def may_overlap(pairs: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """The class pairs (a, b) whose counts by part of the hash range leave a link possible."""
    side = lambda s: sets.select(F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col("bins").alias(f"h_{s}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [_bins(b.column(i)) for i in (4, 5)]
            n = [np.asarray(b.column(i), dtype=np.int64) for i in (2, 3)]
            most = np.minimum(*h).sum(1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(t.links(most, *n)))

    return (pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "h_a", "h_b")
            .mapInArrow(run, "a binary, b binary"))


def compare(pairs: DataFrame, sets: DataFrame, t: Threshold, folder: str, name: str) -> DataFrame:
    """Exact overlap of the class pairs (a, b) that can link: n_a, n_b, inter.

    A few pairs are broadcast, so that only members of their sets are shuffled."""
    pairs = stage(may_overlap(pairs, sets, t), folder, f"pairs-{name}")
    left = sets.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("members").alias("m_a"))
    right = sets.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("members").alias("m_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            inter = []
            for x, y in zip(b.column(4), b.column(5)):
                x, y = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
                inter.append(int((y[at] == x).sum()) if len(x) else 0)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(4)), pa.array(inter, pa.int32())],
                names=["a", "b", "n_a", "n_b", "inter"])

    if pairs.count() <= BROADCAST_PAIRS:
        joined = left.join(F.broadcast(pairs), "a").join(right.join(F.broadcast(pairs), "b"), ["a", "b"])
    else:
        joined = pairs.join(right, "b").join(left, "a")
    return joined.select("a", "b", "n_a", "n_b", "m_a", "m_b").mapInArrow(
        run, "a binary, b binary, n_a int, n_b int, inter int")


def common_member(n_a: int, row_a: np.ndarray, val_a: np.ndarray, n_b: int, row_b: np.ndarray, val_b: np.ndarray) -> np.ndarray:
    """Whether rows of a and of b, given as (row, value) entries, have a value in common."""
    both = np.intersect1d(val_a, val_b)
    out = np.zeros((n_a, n_b), bool)
    for lo in range(0, len(both), COMMON_STEP):
        part = both[lo:lo + COMMON_STEP]
        grids = []
        for n, row, val in ((n_a, row_a, val_a), (n_b, row_b, val_b)):
            at = np.minimum(np.searchsorted(part, val), len(part) - 1)
            has = part[at] == val
            grid = np.zeros((n, len(part)), np.float32)
            grid[row[has], at[has]] = 1
            grids.append(grid)
        out |= grids[0] @ grids[1].T > 0
    return out


def open_pairs(lists: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """Class pairs (a, b) of the lists (e, key, n, pos, rank, comp, d...) that neither the lists
    nor the distances nor the counts by hash range rule out.  Lists are cut into blocks, block pairs are joined, and what is
    left of them is expanded in the tasks.

    A pair that shares several lists is named in the first one: entries carry the first ``EARLIER`` prefix
    members before the list's own, and a pair with one of those in common belongs to an earlier list.
    (Pairs that share none of their first ``EARLIER`` prefix members may come more than once.)"""
    dist = [c for c in lists.columns if c[0] == "d" and c[1:].isdigit()]
    rows = lists.join(sets.select("key", "bins", F.slice("prefix", 1, EARLIER).alias("first")), "key").withColumn(
        "early", F.slice("first", F.lit(1), F.least("rank", F.lit(EARLIER)))).drop("first").withColumn("band", size_band("n", t)).withColumn("at", F.floor(F.col("pos") / POSITIONS).cast("int"))
    of = ["e", "band", "at"]
    cuts = rows.groupBy(*of).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cuts"))
    rows = rows.join(cuts, of).withColumn("cut", F.pmod(F.xxhash64("key"), F.col("cuts")).cast("int"))
    fields = ["key", "comp", "n", "pos", "rank", *dist, "bins", "early"]
    span = [f(c).alias(f"{k}_{c}") for c in ("n", "pos", "rank", *dist) for k, f in (("lo", F.min), ("hi", F.max))]
    # a block with an unknown distance has no bounds
    known = [F.bool_and(F.col(c).isNotNull()).alias(f"all_{c}") for c in dist]
    blocks = rows.groupBy(*of, "cut").agg(F.collect_list(F.struct(*fields)).alias("m"), *span, *known)
    x, y = (blocks.select("e", F.struct("band", "at", "cut").alias(f"id_{s}"),
                          *[F.col(c).alias(f"{c}_{s}") for c in blocks.columns if c not in (*of, "cut")]) for s in "xy")
    most = F.least(F.col("hi_n_x") - F.col("lo_pos_x"), F.col("hi_n_y") - F.col("lo_pos_y")) + F.least("hi_rank_x", "hi_rank_y")
    fits = ((t.den * F.least("hi_n_x", "hi_n_y") >= t.num * F.greatest("lo_n_x", "lo_n_y"))
            & ((t.den + t.num) * most >= t.num * (F.col("lo_n_x") + F.col("lo_n_y"))))
    slack = 1 - t.num / t.den + ROUNDING
    for c in dist:
        gap = F.greatest(F.col(f"lo_{c}_x") - F.col(f"hi_{c}_y"), F.col(f"lo_{c}_y") - F.col(f"hi_{c}_x"))
        fits &= ~F.coalesce(F.col(f"all_{c}_x") & F.col(f"all_{c}_y") & (gap > slack), F.lit(False))
    pairs = x.join(y, "e").filter((F.col("id_x") <= F.col("id_y")) & fits)

    def side(v: pa.Scalar):
        cells = v.values
        key = np.frombuffer(b"".join(k.as_py() for k in cells.field("key")), "V16")
        comp = np.frombuffer(b"".join(k.as_py() for k in cells.field("comp")), "V16")
        num = [np.asarray(cells.field(c).cast(pa.float64()).fill_null(np.nan)) for c in ("n", "pos", "rank", *dist)]
        early = cells.field("early")
        return key, comp, num, _bins(cells.field("bins")), (np.asarray(pc.list_parent_indices(early)), np.asarray(pc.list_flatten(early)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out_a, out_b = [], []
            for i in range(b.num_rows):
                (ka, ca, (na, pa_, ra, *da), ha, ea), (kb, cb, (nb, pb, rb, *db), hb, eb) = (side(b.column(c)[i]) for c in (0, 1))
                col = lambda v: v[:, None]
                rest = np.minimum(col(na - pa_), nb - pb) + np.minimum(col(ra), rb)
                ok = ((t.den * np.minimum(col(na), nb) >= t.num * np.maximum(col(na), nb))
                      & ((t.den + t.num) * rest >= t.num * (col(na) + nb)) & (ca[:, None] != cb))
                for u, v in zip(da, db):           # pairs with a pivot (distance 0) have been compared
                    with np.errstate(invalid="ignore"):
                        ok &= ~(np.abs(col(u) - v) > slack) & ~(col(u) <= 0) & ~(v <= 0)
                if ok.any():
                    ok &= ~common_member(len(ka), *ea, len(kb), *eb)
                p, q = np.nonzero(ok)
                for lo in range(0, len(p), STEP_PAIRS):
                    u, v = p[lo:lo + STEP_PAIRS], q[lo:lo + STEP_PAIRS]
                    ok[u, v] = t.links(np.minimum(ha[u], hb[v]).sum(1, dtype=np.int64), na[u], nb[v])
                p, q = np.nonzero(ok)
                one, two = ([k[j].tobytes() for j in at] for k, at in ((ka, p), (kb, q)))
                pair = {(min(u, v), max(u, v)) for u, v in zip(one, two)}
                out_a += [u for u, _ in pair]
                out_b += [v for _, v in pair]
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], names=["a", "b"])

    return pairs.select("m_x", "m_y").mapInArrow(run, "a binary, b binary")


def find_links(indexed: DataFrame, t: Threshold, folder: str) -> DataFrame:
    """Pairs (a, b) of classes that span every component of the link graph."""
    entries = indexed.select("key", "n", "before", F.posexplode("prefix").alias("rank", "e")) \
        .withColumn("pos", F.col("before") + F.col("rank")).drop("before")
    many = entries.groupBy("e").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("e")
    lists = stage(entries.join(many, "e").withColumn("comp", F.col("key")).withColumn("old", F.array().cast("array<binary>")),
                  folder, "lists-0")
    n = [F.col(c) for c in ("n", "pos", "rank")]
    for r in range(PIVOT_ROUNDS):
        # the pivot: the least class outside the components of earlier pivots, of the sizes that
        # most of those have, since other sizes tell it nothing
        own = ~F.array_contains("old", F.col("comp"))
        bands = lists.filter(own).groupBy("e", size_band("n", t).alias("band")).agg(
            F.count(F.lit(1)).alias("c"), F.min(F.struct("key", "n", "pos", "rank", "comp")).alias("p"))
        pivots = bands.groupBy("e").agg(F.max_by("p", F.struct("c", "band")).alias("p"))
        at = [F.col(f"p.{c}") for c in ("n", "pos", "rank")]
        with_pivot = lists.join(pivots, "e", "left")
        pairs = (with_pivot.filter((F.col("p.comp") != F.col("comp")) & may_link(t, *n, *at))
                 .select(F.least("key", "p.key").alias("a"), F.greatest("key", "p.key").alias("b")).distinct())
        tested = stage(compare(pairs, indexed, t, folder, str(r)), folder, f"tested-{r}")
        found = tested.filter(t.links(F.col("inter"), F.col("n_a"), F.col("n_b"))).select("a", "b")
        # the stars of the rounds before stand for their links
        edges = found if r == 0 else found.union(stars)
        roots = stage(connected_components(edges, folder, f"round-{r}"), folder, f"roots-{r}")
        stars = roots.filter("node <> root").toDF("a", "b")
        # distance to this round's pivot, as an interval test for later pairs
        gap = 1 - F.col("inter") / (F.col("n_a") + F.col("n_b") - F.col("inter"))
        dist = tested.select("a", "b", gap.alias(f"d{r}"))
        moved = (with_pivot.withColumn("a", F.least("key", "p.key")).withColumn("b", F.greatest("key", "p.key"))
                 .join(dist, ["a", "b"], "left")
                 .withColumn(f"d{r}", F.when(F.col("key") == F.col("p.key"), 0.0).otherwise(F.col(f"d{r}")))
                 .join(roots.withColumnRenamed("node", "key"), "key", "left")
                 .withColumn("comp", F.coalesce("root", "key")))
        moved = moved.select("e", *[c for c in lists.columns if c not in ("e", "old")], f"d{r}", F.col("p.key").alias("pv"), "old")
        # components of all pivots so far, named by their present roots
        names = (moved.filter(F.col("key") == F.col("pv")).groupBy("e").agg(F.first("comp").alias("now")))
        moved = moved.join(names, "e", "left").withColumn(
            "old", F.when(F.col("now").isNull(), F.col("old")).otherwise(F.array_append("old", F.col("now")))).drop("pv", "now")
        open_ = moved.groupBy("e").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")) \
            .filter("lo <> hi").select("e")
        lists = stage(moved.join(open_, "e"), folder, f"lists-{r + 1}")
        if lists.isEmpty():
            return stars
    tested = stage(compare(open_pairs(lists, indexed, t).distinct(), indexed, t, folder, "last"), folder, "tested-last")
    return stars.union(tested.filter(t.links(F.col("inter"), F.col("n_a"), F.col("n_b"))).select("a", "b"))


# ---------------------------------------------------------------------------- counting

def overlaps(counts_a: np.ndarray, vals_a: np.ndarray, counts_b: np.ndarray, vals_b: np.ndarray) -> np.ndarray:
    """Overlap of each set of a with each set of b (members concatenated, and how many each has)."""
    n_a, n_b = len(counts_a), len(counts_b)
    out = np.zeros((n_a, n_b), np.int64)
    both = np.intersect1d(vals_a, vals_b)
    step = max(1, STRIP_CELLS // (n_a + n_b))
    sides = []
    for counts, vals in ((counts_a, vals_a), (counts_b, vals_b)):
        at = np.searchsorted(both, vals)
        has = both[np.minimum(at, max(len(both) - 1, 0))] == vals if len(both) else np.zeros(len(vals), bool)
        row, at = np.repeat(np.arange(len(counts)), counts)[has], at[has]
        order = np.argsort(at, kind="stable")
        sides.append((row[order], at[order]))
    for lo in range(0, len(both), step):
        width = min(step, len(both) - lo)
        a, b = (np.zeros((n, width), bool) for n in (n_a, n_b))
        for grid, (row, at) in zip((a, b), sides):
            i, j = np.searchsorted(at, [lo, lo + width])
            grid[row[i:j], at[i:j] - lo] = True
        # members of the pivot set: differences from it instead of the members
        pivot = 2 * (a.sum(0) + b.sum(0)) > n_a + n_b
        a, b = a ^ pivot, b ^ pivot
        out += int(pivot.sum()) - a[:, pivot].sum(1)[:, None] - b[:, pivot].sum(1)
        pairs = a.sum(0) * b.sum(0)
        many = pairs > SPARSE_PAIRS
        out += (a[:, many].astype(np.float32) @ b[:, many].T.astype(np.float32)).astype(np.int64)
        few = (pairs > 0) & ~many
        (col, x), (col_b, y) = (np.nonzero(g[:, few].T) for g in (a, b))
        first = np.searchsorted(col_b, np.arange(few.sum() + 1))
        times = np.diff(first)[col]
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[col], times)
        out += np.bincount(np.repeat(x, times) * n_b + y[place], minlength=n_a * n_b).reshape(n_a, n_b)
    return out


def count_links(sets: DataFrame, roots: DataFrame, t: Threshold) -> DataFrame:
    """(key, more): documents in the other classes that each class of ``sets`` (key, n,
    copies, members) links with.  Classes without a link are left out."""
    rows = sets.join(roots.withColumnRenamed("node", "key"), "key")
    per = F.least(F.greatest(F.col("g") / CHUNKS, F.lit(CHUNK)), F.lit(MAX_CHUNK))
    cut = (rows.groupBy("root").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("held"))
           .select("root", F.greatest(F.ceil(F.col("g") / per), F.ceil(F.col("held") / CHUNK_MEMBERS)).cast("int").alias("chunks"))
           .filter("chunks > 1"))                           # large components only, far fewer than classes
    rows = rows.join(F.broadcast(cut), "root", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))

    def pack(tab: pa.Table) -> pa.Table:
        vals = [x.as_py() for x in tab.column("members")]
        packed = {"keys": b"".join(x.as_py() for x in tab.column("key")), "vals": b"".join(vals),
                  "counts": np.array([len(x) // 8 for x in vals], np.int64).tobytes(),
                  **{name: tab.column(c).to_numpy().astype(np.int64).tobytes() for name, c in (("sizes", "n"), ("weights", "copies"))}}
        return pa.table({**{c: tab.column(c).slice(0, 1) for c in ("root", "chunk", "chunks")},
                         **{c: pa.array([v], pa.binary()) for c, v in packed.items()}})

    parts = ["keys", "vals", "counts", "sizes", "weights"]
    blocks = rows.groupBy("root", "chunk").applyInArrow(
        pack, "root binary, chunk int, chunks int, " + ", ".join(f"{c} binary" for c in parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                col = [b.column(i)[r].as_py() for i in range(b.num_columns)]
                same = len(col) == len(parts) or col[0] == col[len(parts)]
                sides = [(np.frombuffer(c[0], "V16"), np.frombuffer(c[1], U64), *(np.frombuffer(x, np.int64) for x in c[2:]))
                         for c in (col[:len(parts)], col[-len(parts):])]
                (k_a, v_a, c_a, n_a, w_a), (k_b, v_b, c_b, n_b, w_b) = sides
                inter = overlaps(c_a, v_a, c_b, v_b)
                link = t.links(inter, n_a[:, None], n_b)
                if same:
                    np.fill_diagonal(link, False)
                for k, more in ((k_a, link @ w_b), (k_b, w_a @ link))[:1 if same else 2]:
                    at = np.flatnonzero(more)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k[i].tobytes() for i in at], pa.binary()), pa.array(more[at])], names=["key", "more"])

    one = blocks.filter("chunks = 1").select(*parts)
    large = blocks.filter("chunks > 1")
    side = lambda at, other, a, b, s: large.select(
        "root", F.col("chunk").alias(at), F.explode(F.sequence(a, b)).alias(other), *(F.col(c).alias(c + s) for c in parts))
    pairs = side("i", "j", F.col("chunk"), F.col("chunks") - 1, "").join(
        side("j", "i", F.lit(0), F.col("chunk"), "_b"), ["root", "i", "j"]).select(*parts, *(f"{c}_b" for c in parts))
    out = "key binary, more long"
    return one.mapInArrow(run, out).union(pairs.mapInArrow(run, out)).groupBy("key").agg(F.sum("more").alias("more"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN,
                    id_col: str = "doc_id", text_col: str = "text", links: bool = True) -> DataFrame:
    """id, n_shingles, component_id (least id reachable by links), class_id (a hash of
    the set, as hexadecimal text; NULL without shingles) and, with ``links``, n_links
    (how many other rows the row links with, copies included) of every row."""
    spark = docs.sparkSession
    folder, t = run_folder(spark), Threshold(num, den)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches):
            s = shingle_sets(b.column(1), width)
            part = [x[x % U64(SCREEN) == 0].tobytes() for x in s]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in s], pa.int32()),
                 pa.array([_key(x) if len(x) else None for x in s], pa.binary()), pa.array(part, pa.binary())],
                names=["id", "n", "key", "part"])

    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    rows = stage(src.mapInArrow(sets_of, "id long, n int, key binary, part binary"), folder, "documents")
    classes = stage(rows.filter("key IS NOT NULL").groupBy("key")
                    .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"),
                         F.min(F.octet_length("part") / 8).cast("int").alias("c")), folder, "classes")
    held = classes.agg(F.sum("c"), F.sum("n")).first()
    parts = max(1, -(-int(held[0] or 0) // BUCKET_MEMBERS))
    alone = F.col("n") - F.expr(f"(n * {num}L + {den - 1}) div {den}")           # members that a partner may lack
    left = classes.filter(F.col("n") >= t.least_size()).join(
        screen(rows, t, parts), F.substring("key", 1, SCREEN_KEY) == F.col("short"), "left")
    left = stage(left.filter(F.coalesce("m", F.lit(0)) >= F.col("c") - alone).select("key", "n", "first"), folder, "screened")

    # sets of the classes left: one document of each, found by a filter on ids
    wanted = left.select("key", "first")
    parts = max(1, -(-int(left.agg(F.sum("n")).first()[0] or 0) // BUCKET_MEMBERS))
    h1, h2 = hash_pair(F.coalesce("first", F.lit(0)))
    n = left.count()
    rate = min(0.9, max(0.001, float(np.exp(-MAX_FILTER_BITS * np.log(2) ** 2 / max(n, 1)))))
    sent = spark.sparkContext.broadcast([bloom_level(wanted.select(h1.alias("h1"), h2.alias("h2")), n, rate)] if n else [])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Cascade(sent.value)
        for b in batches:
            if not levels.levels:
                return
            a, c = (np.asarray(b.column(i), dtype=np.int64) for i in (2, 3))
            few = b.filter(pa.array(levels.passes(a, c)))
            for x in text_blocks(iter([few])):
                s = shingle_sets(x.column(1), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_key(v) if len(v) else None for v in s], pa.binary()),
                     pa.array([len(v) for v in s], pa.int32()), pa.array([v.tobytes() for v in s], pa.binary())],
                    names=["key", "n", "members"])

    h1, h2 = hash_pair(F.coalesce("id", F.lit(0)))
    again = src.select("id", "text", h1.alias("h1"), h2.alias("h2"))
    # (a document that the filter lets through by chance adds a class without links, or one that is there)
    indexed = stage(index(again, t, parts, chosen), folder, "indexed")

    roots = connected_components(find_links(indexed, t, folder), folder, "final")
    classes = classes.select("key", "first", "copies")
    member = roots.join(classes, roots["node"] == classes["key"]).select("key", "root", "first")
    least = member.groupBy("root").agg(F.min("first").alias("least"))
    named = member.join(least, "root").select("key", "least")
    of_class = classes.join(named, "key", "left").withColumn("component_id", F.coalesce("least", "first"))
    found = []
    if links:
        roots = stage(roots, folder, "roots")
        linked = indexed.join(classes.select("key", "copies"), "key").select("key", "n", "copies", "members")
        counts = stage(count_links(linked, roots, t), folder, "counts")
        of_class = of_class.join(counts, "key", "left")
        found = [F.coalesce(F.col("copies") - 1 + F.coalesce("more", F.lit(0)), F.lit(0)).alias("n_links")]
    return rows.join(of_class, "key", "left").select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.lower(F.hex("key")).alias("class_id"), *found)


def one_per_group(docs: DataFrame, width: int, num: int, den: int, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the least of its component, an id once.

    A Bloom filter of the ids that go, or that several rows have, lets all other rows
    through untouched, so only texts of the rest are shuffled for the exact test.
    Rows with a NULL id stay."""
    spark = docs.sparkSession
    folder = run_folder(spark)
    found = stage(near_duplicates(docs, width, num, den, id_col, text_col, links=False).select(
        F.col(id_col).alias("id"), "component_id").filter("id IS NOT NULL"), folder, "components")
    ids = stage(found.groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.max(F.col("id") == F.col("component_id")).alias("stays")),
                folder, "ids")
    doubtful = ids.filter("c > 1 OR NOT stays")
    h1, h2 = hash_pair(F.col("id"))
    n = doubtful.count()
    rate = min(0.9, max(0.01, float(np.exp(-MAX_FILTER_BITS * np.log(2) ** 2 / max(n, 1)))))
    sent = spark.sparkContext.broadcast([bloom_level(doubtful.select(h1.alias("h1"), h2.alias("h2")), n, rate)] if n else [])
    d1, d2 = hash_pair(docs[id_col].cast("long"))
    marked = docs.withColumn("_h1", F.when(docs[id_col].isNotNull(), d1)).withColumn("_h2", d2)

    def split(doubt: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            level = Cascade(sent.value)
            for b in batches:
                known = np.asarray(b.column(b.num_columns - 2).is_valid())
                a, c = (np.asarray(b.column(b.num_columns - i).fill_null(0), dtype=np.int64) for i in (2, 1))
                hit = known & (level.passes(a, c) if level.levels else np.zeros(len(a), bool))
                keep = b.filter(pa.array(hit if doubt else ~hit))
                yield pa.RecordBatch.from_arrays(keep.columns[:-2], names=keep.schema.names[:-2])
        return marked.mapInArrow(run, docs.schema)

    stays = ids.filter("stays").select(F.col("id").alias("_id"))
    rest = split(True)
    rest = rest.join(stays, rest[id_col].cast("long") == stays["_id"], "left_semi").dropDuplicates([id_col])
    return split(False).union(rest)
