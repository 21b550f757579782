"""SimHash near-duplicate detection with bit-sliced comparison.

1. Every text gets a 64-bit fingerprint over its 4-word shingles.
2. Equal fingerprints collapse to one node, so copies cost one comparison.
3. Two fingerprints within ``radius`` bits agree on at least ``blocks - radius`` of
   ``blocks`` bit blocks, so each node is dealt once for every choice of that many blocks,
   keyed by their bits.  All pairs within the radius meet under some key; nothing else is
   compared.  A key with more than ``tile`` nodes is dealt as pairs of tiles, so no task
   holds more than two tiles of it.
4. Within a key the fingerprints are stored as vertical bit planes, 64 nodes per machine
   word.  One pass over the planes updates 64 distances at a time in carry-save counters;
   words whose 64 distances all exceed the radius are abandoned on the way.
5. Each key yields a spanning forest of its links, never the pairs, and the forests are
   joined to components by alternating large-star and small-star rounds, each a written
   table.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxima.llm.common import arrow_column, block_words, columns_of, free_name, lossless_bytes, write_table
from proxima.session import ship_package

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE = 4096

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONE = np.uint64(1)


# ---------------------------------------------------------------- fingerprints

def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 255 * 256):
        bits = np.unpackbits(hashes[i:i + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:  # up to 255 rows fit a byte counter
            total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[whole:].sum(axis=0, dtype=np.int64)
    return total


def _shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:z], SEED) for a, z in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())],
                    np.uint64)


def fingerprint(text: bytes | None, k: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a whole text; 0 without words."""
    counts, n, carry = np.zeros(64, np.int64), 0, []
    for piece in block_words(text or b""):
        words = carry + piece.lower().split()
        if len(words) >= k:
            h = _shingle_hashes(words, k)
            counts += _bit_counts(h)
            n += len(h)
            carry = words[len(words) - k + 1:]
        else:
            carry = words
    if n == 0:
        if not carry:
            return 0
        h = np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)
        counts, n = _bit_counts(h), 1
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text_col: str, out: str, k: int = SHINGLE) -> DataFrame:
    """``docs`` plus the fingerprint of ``text_col`` as a signed long named ``out``."""
    def batches(it):
        for texts in it:
            fps = np.fromiter((fingerprint(t.as_py(), k) for t in texts), np.uint64, len(texts))
            yield pa.array(fps.view(np.int64), pa.int64())

    fn = arrow_column(docs.sparkSession, batches, "bigint")
    return docs.withColumn(out, fn(lossless_bytes(F.col(text_col))))


# ---------------------------------------------------------------- bit-sliced comparison

class _Planes:
    """Fingerprints of many runs (one key, one side) packed 64 to a word, bit planes apart."""

    def __init__(self, fps: np.ndarray, run_start: np.ndarray, run_len: np.ndarray):
        words = (run_len + 63) // 64
        self.run_word = np.cumsum(words) - words
        self.n_words = int(words.sum())
        run = np.repeat(np.arange(len(run_len)), run_len)
        pos = np.arange(len(fps)) - run_start[run]
        self.word_of = self.run_word[run] + pos // 64
        self.lane_of = (pos % 64).astype(np.uint64)
        first = np.flatnonzero(pos % 64 == 0)
        self.word_first = first  # member that sits in lane 0 of each word
        self.planes = [np.bitwise_or.reduceat(((fps >> np.uint64(p)) & _ONE) << self.lane_of, first) for p in range(64)]
        self.valid = np.bitwise_or.reduceat(_ONE << self.lane_of, first)


def _exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Per lane: has the counted distance passed the radius?"""
    gt, eq = over.copy(), ~over
    for b in reversed(range(len(counters))):
        if radius >> b & 1:
            eq &= counters[b]
        else:
            gt |= eq & counters[b]
            eq &= ~counters[b]
    return gt


def _csa(a, b, c):
    """Carry-save adder: three bit planes in, sum and carry planes out."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _near(pl: _Planes, fps: np.ndarray, qi: np.ndarray, wi: np.ndarray, lanes: np.ndarray, radius: int):
    """Of the (query, word) blocks, those lanes within the radius: (query, word, lane mask)."""
    m = max(2, radius.bit_length())
    counters = [np.zeros(len(qi), np.uint64) for _ in range(m)]
    over = np.zeros(len(qi), np.uint64)
    qf = fps[qi]
    for p in range(0, 64, 4):
        d = [pl.planes[p + i][wi] ^ (np.uint64(0) - ((qf >> np.uint64(p + i)) & _ONE)) for i in range(4)]
        s, k1 = _csa(counters[0], d[0], d[1])
        counters[0], k2 = _csa(s, d[2], d[3])
        counters[1], carry = _csa(counters[1], k1, k2)
        for b in range(2, m):
            counters[b], carry = counters[b] ^ carry, counters[b] & carry
        over |= carry
        if p % 8 == 4:
            lanes = lanes & ~_exceeds(counters, over, radius)
            keep = lanes != 0
            if np.count_nonzero(keep) < 0.7 * len(keep) or p == 60:  # abandon blocks that hold no candidate
                qi, wi, lanes, over, qf = qi[keep], wi[keep], lanes[keep], over[keep], qf[keep]
                counters = [c[keep] for c in counters]
                if not len(qi):
                    break
    return qi, wi, lanes


class _Forest:
    """Union of links between positions 0..n-1, kept as a label array."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        lab = self.label
        while len(a):
            la, lb = lab[a], lab[b]
            differ = la != lb
            if not differ.any():
                return
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = lab[lab]
                if np.array_equal(up, lab):
                    break
                lab[:] = up


def link_runs(gid: np.ndarray, side: np.ndarray, fps: np.ndarray, radius: int = RADIUS, block: int = 1 << 17) -> np.ndarray:
    """Spanning forest of all links within the groups of ``gid`` (sorted by group, then
    side).  A group with sides 0 and 1 links only across them (a pair of tiles); a group
    with side 0 alone links all its members.  Returns an (m, 2) array of positions."""
    n = len(gid)
    if not n:
        return np.zeros((0, 2), np.int64)
    new = np.flatnonzero(np.r_[True, (gid[1:] != gid[:-1]) | (side[1:] != side[:-1])])
    length = np.diff(np.r_[new, n])
    pl = _Planes(fps, new, length)
    run = np.repeat(np.arange(len(new)), length)
    words = (length + 63) // 64
    run_end = pl.run_word + words
    nxt = np.r_[np.arange(1, len(new)), len(new) - 1]
    crossed = (gid[new][nxt] == gid[new]) & (side[new] == 0) & (side[new][nxt] == 1)  # runs facing another tile
    first = np.where(crossed[run], pl.run_word[nxt][run], pl.word_of)
    last = np.where(crossed[run], run_end[nxt][run], run_end[run])
    count = np.where(side == 1, 0, last - first)
    upto = np.cumsum(count)
    forest = _Forest(n)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + block, "right")))
        q = np.repeat(np.arange(lo, hi), count[lo:hi])
        if len(q):
            base = np.cumsum(count[lo:hi]) - count[lo:hi]
            w = first[q] + np.arange(len(q)) - base[q - lo]
            lanes = pl.valid[w]
            own = w == pl.word_of[q]
            lanes = np.where(own, lanes & ~((np.uint64(2) << pl.lane_of[q]) - _ONE), lanes)
            some = lanes != 0
            q, w, lanes = _near(pl, fps, q[some], w[some], lanes[some], radius) if some.any() else (q[:0], w[:0], lanes[:0])
            for i in range(0, len(q), 1 << 14):
                bits = np.unpackbits(np.ascontiguousarray(lanes[i:i + (1 << 14)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                r, lane = np.nonzero(bits)
                forest.link(q[i + r], pl.word_first[w[i + r]] + lane)
        lo = hi
    member = np.flatnonzero(forest.label != np.arange(n))
    return np.stack([member, forest.label[member]], axis=1)


# ---------------------------------------------------------------- candidate keys

def plan_blocks(nodes: int, radius: int = RADIUS, per_key: int = 1024) -> int:
    """The fewest bit blocks for which a key is expected to hold ``per_key`` nodes or less.
    Any choice finds the same links; more blocks mean more, but smaller, keys."""
    blocks = radius + 1
    while blocks < 3 * radius + 3 and nodes / 2.0 ** (64 * (blocks - radius) / blocks) > per_key:
        blocks += 1
    return blocks


def _key_columns(fp, radius: int, blocks: int):
    """One (table number, key) per choice of ``blocks - radius`` blocks."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(blocks)]
    out = []
    for n, chosen in enumerate(itertools.combinations(range(blocks), blocks - radius)):
        mask = sum(masks[i] for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.struct(F.lit(n).alias("t"), fp.bitwiseAND(F.lit(signed)).alias("key")))
    return F.explode(F.array(*out))


def _forest_batches(radius: int):
    """Link the complete keys of a partition sorted by key, a bounded number of rows at a time."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def emit(cols):
        t, key, i, j, side, fp = cols
        change = np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
        fps = fp.view(np.uint64)
        e = link_runs(np.cumsum(change), side, fps, radius)
        return pa.record_batch([pa.array(fp[e[:, 0]]), pa.array(fp[e[:, 1]])], schema=schema)

    def run(it):
        held = None
        for batch in it:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(6)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            t, key, i, j = cols[:4]
            tail = (t == t[-1]) & (key == key[-1]) & (i == i[-1]) & (j == j[-1])
            cut = len(t) - int(tail[::-1].argmin()) if not tail.all() else 0  # the last key may go on in the next batch
            if cut >= 1 << 14 or (cut and len(t) > 1 << 15):
                yield emit([c[:cut] for c in cols])
                held = [c[cut:].copy() for c in cols]
            else:
                held = cols
        if held is not None and len(held[0]):
            yield emit(held)

    return run


def candidate_forest(nodes: DataFrame, n_nodes: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (u, v) that connect all nodes (column ``fp``, distinct) within the radius."""
    spark = nodes.sparkSession
    ship_package(spark)
    dealt = nodes.select("fp", _key_columns(F.col("fp"), radius, plan_blocks(n_nodes, radius)).alias("k")).select("fp", "k.t", "k.key")
    sizes = dealt.groupBy("t", "key").count().where(F.col("count") > tile)
    hot = write_table(sizes.select("t", "key", F.ceil(F.col("count") / tile).cast("int").alias("tiles")), "simhash-hot")
    plain = dealt.select("t", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "fp")
    if not hot.isEmpty():
        plain = plain.join(hot.select("t", "key"), ["t", "key"], "left_anti")
        own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
        mine = dealt.join(hot, ["t", "key"]).select("t", "key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
        split = mine.select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                            F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "fp")
        plain = plain.unionByName(split)
    keys = ["t", "key", "i", "j"]
    dealt = plain.repartition(*[F.col(c) for c in keys]).sortWithinPartitions(*keys, "side")
    return dealt.mapInArrow(_forest_batches(radius), "u bigint, v bigint").distinct()


# ---------------------------------------------------------------- components

def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return r.n, r.h


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v); the root is the component's
    smallest node.  Alternates large-star and small-star rounds until nothing changes."""
    edges = write_table(edges.where("u <> v"), "components")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = write_table(least.select("u", F.col("m").alias("v")).unionByName(small).distinct(), "components")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def near_duplicate_groups(ids: DataFrame, id_col: str = "doc_id", fp_col: str = "fp", radius: int = RADIUS,
                          tile: int = TILE) -> DataFrame:
    """One row per fingerprint of ``ids``: fp, root (the group's smallest fingerprint),
    component_id (the group's smallest id), rows (how many rows have the fingerprint)."""
    nodes = write_table(ids.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("low"), F.count("*").alias("rows")), "simhash-nodes")
    comp = components(candidate_forest(nodes.select("fp"), nodes.count(), radius, tile))
    comp = comp.withColumnRenamed("node", "fp")
    labelled = nodes.join(comp, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low", "rows")
    linked = nodes.join(comp, "fp").groupBy("root").agg(F.min("low").alias("component_id"))
    return labelled.join(linked, "root", "left").select("fp", "root", F.coalesce("component_id", "low").alias("component_id"), "rows")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                    radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Near-duplicate groups of whole texts: ``id_col``, fingerprint (16 lowercase hex
    digits), component_id (the smallest id reachable over links of at most ``radius`` bits).

    Null, empty and blank texts have the fingerprint zero and link like any other.  Null
    ids stay as rows and are ignored as component ids unless a group has no other.
    Repeated rows stay repeated.  Other columns are ignored; an empty table gives none."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = write_table(with_fingerprint(src, "text", "fp", k).select("id", "fp"), "simhash-ids")
    groups = near_duplicate_groups(ids, "id", "fp", radius, tile).select("fp", "component_id")
    return ids.join(groups, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                         "component_id")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                       radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest id; of several rows
    with that id (or with no id at all) one stays.  All columns are kept."""
    fp = free_name(docs, "_fp")
    key = free_name(docs, "_id")
    lead_fp = free_name(docs, "_lead")
    with_fp = with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "fp", k)
    ids = write_table(with_fp.select("id", "fp"), "simhash-ids")
    groups = near_duplicate_groups(ids, "id", "fp", radius, tile)
    marked = ids.join(groups, "fp").withColumn("lead", F.col("id").eqNullSafe(F.col("component_id")))
    per_id = marked.groupBy("id").agg(F.count("*").alias("n"), F.max("lead").alias("lead")).where("lead")
    per_id = write_table(per_id.select(F.col("id").alias(key), F.col("n").alias(fp)), "simhash-keep")
    # a merge join at every size: the texts are dealt by id once, whether few or many ids stay
    kept = docs.join(per_id.hint("merge"), F.col(id_col).eqNullSafe(F.col(key)))
    own = columns_of(docs)
    single = kept.where(F.col(fp) == 1).select(*own)
    if per_id.where(F.col(fp) > 1).isEmpty():
        return single
    # ids that several rows carry: their rows are told apart by fingerprint
    leads = marked.where("lead").groupBy("id", "root").agg(F.min("fp").alias("fp")).select(F.col("id").alias(key), F.col("fp").alias(lead_fp))
    several = with_fingerprint(kept.where(F.col(fp) > 1).select(*own), text_col, fp, k)
    several = several.join(leads, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(fp) == F.col(lead_fp)), "left_semi")
    return single.unionByName(several.dropDuplicates([id_col, fp]).select(*own))
