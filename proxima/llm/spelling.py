"""Spelling variants: words one edit apart, found with a bit-sliced position index.

Words are dealt by halves.  Two words of lengths L and L or L + 1 that differ by one edit share
either their first L // 2 letters or their last L - L // 2, so a word of length m goes to the
groups of its halves for L = m and L = m - 1, and only words of one group are compared.

In a group every (position, letter) has a bitset over the words.  For a query word the sets of
words that agree so far without an error, with one replaced letter, with one letter more and
with one letter less are carried along together, 64 words of the vocabulary in one operation:
a replaced letter reads the bitsets of the same position, one more those of the next and one
less those of the last.  A task holds the bitsets of one or two positions at a time, and a
block of many small groups or a tile of a large one.  Words stand in a group by falling count,
so the first bit set is the best near word and the number of bits the number of near words: no
pair leaves a task.  Pairs that share both halves are counted under the first.

A group of more than ``TILE`` words is cut into tiles, and each pair of tiles is a task's block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxima.llm.common import write_table
from proxima.session import ship_package

LETTERS = "A-Za-zÀ-ÿ"
MIN_LETTERS, MIN_COUNT, RATIO, EVERY = 7, 2, 10, 31
TILE = 4096        # words of a group that are compared in one block
LETTERS_AT_ONCE = 1 << 22  # and letters of them
BLOCK = 1024       # words of small groups that share one bitset
QUERIES = 2048     # query words whose sets are carried along together
INDEXED, ASKED = 1, 2
GROUP = ["l", "side", "half", "ti", "tq"]


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT,
             every: int = EVERY) -> DataFrame:
    """(word, n): the maximal letter runs, A-Z lower-cased.  Where ``every`` divides h, the
    CRC-32 of ``<id>:<run>``, the run's letter h % length goes.  Results of ``min_letters`` and
    more that occur ``min_count`` times or more.  A shorter run cannot give one, so runs are
    matched from that length on; a null id counts as the empty text, a null text has no runs."""
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[{LETTERS}]{{{min_letters},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = rows.select("id", F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", upper, upper.lower())).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.pmod(F.col("h"), F.lit(every)) == 0, less).otherwise(F.col("run"))
    out = rows.select(word.alias("word")).where(F.char_length("word") >= min_letters)
    return out.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def halves(words: DataFrame) -> DataFrame:
    """word, n and its four groups: l, side (0: first letters, 1: last), half."""
    m = F.char_length("word")

    def group(less: int, side: int):
        n = m - less
        h = F.floor(n / 2).cast("int")
        part = F.substring("word", F.lit(1), h) if side == 0 else F.right("word", n - h)
        return F.struct(n.alias("l"), F.lit(side).alias("side"), part.alias("half"))

    return words.select("word", "n", F.explode(F.array(*[group(x, s) for x in (0, 1) for s in (0, 1)])).alias("g")).select("word", "n", "g.*")


def tiled(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """Rows with tile numbers ti and tq and a role: a word of a large group is indexed in its
    own tile for the queries of every tile, and asks every tile; otherwise it does both."""
    most = F.greatest(F.lit(1), F.least(F.lit(tile), F.floor(F.lit(LETTERS_AT_ONCE) / F.col("l"))))
    hot = rows.groupBy("l", "side", "half").agg(F.count(F.lit(1)).alias("g")).where(F.col("g") > most)
    hot = write_table(hot.select("l", "side", "half", F.ceil(F.col("g") / most).cast("int").alias("tiles")), "spelling-hot")
    both = rows.join(hot, ["l", "side", "half"], "left")
    own = F.pmod(F.xxhash64("word"), F.col("tiles").cast("bigint")).cast("int")
    each = F.sequence(F.lit(0), F.col("tiles") - 1)
    role = lambda ti, tq, r: F.struct(ti.alias("ti"), tq.alias("tq"), r.alias("role"))
    t = F.col("own")
    many = F.concat(
        F.transform(each, lambda j: role(t, j, F.when(j == t, F.lit(INDEXED + ASKED)).otherwise(F.lit(INDEXED)))),
        F.transform(F.filter(each, lambda j: j != t), lambda j: role(j, t, F.lit(ASKED))))
    one = F.array(role(F.lit(0), F.lit(0), F.lit(INDEXED + ASKED)))
    both = both.withColumn("own", own)
    return both.select("word", "n", "l", "side", "half", F.explode(F.when(F.col("tiles").isNull(), one).otherwise(many)).alias("r")).select(
        "word", "n", "l", "side", "half", "r.*")


class PositionIndex:
    """The bitsets of one block: words as letter codes (short ones padded by ``pad``)."""

    def __init__(self, codes: np.ndarray, pad: int):
        self.codes, self.pad, self.n = codes, pad, len(codes)
        self.words = -(-self.n // 64)

    def at(self, p: int) -> np.ndarray:
        """(letter, 64 words): bit i of letter c is set if word i has c at position p."""
        out = np.zeros((self.pad + 1, self.words * 64), np.uint8)
        if 0 <= p < self.codes.shape[1]:
            out[self.codes[:, p], np.arange(self.n)] = 1
            out[self.pad] = 0
        return bits(out)


def bits(flags: np.ndarray) -> np.ndarray:
    return np.packbits(flags, axis=1, bitorder="little").view(np.uint64)


def near_sets(index: PositionIndex, asked: np.ndarray, m: int, l: int, mask: np.ndarray, last_half: np.ndarray) -> np.ndarray:  # noqa: E741
    """(query, 64 words) sets of the words one edit from each query of length ``m`` (``l`` or
    ``l`` + 1) within its ``mask``.  Queries in a group of last halves leave out the words that
    share the first half too."""
    long = m > l
    same = mask.copy()                   # no error so far
    other, more, less = (np.zeros_like(mask) for _ in range(3))
    prefix = mask if l // 2 == 0 else None
    here, nearby = index.at(0), index.at(1)
    before = np.zeros_like(here)
    for p in range(m):
        c = asked[:, p]
        agree = here[c]
        if long:
            less &= before[c]
            less |= same                 # the query's letter p is one too many
        else:
            more |= same                 # the word's letter p is one too many
            more &= nearby[c]
            other &= agree
            other |= same & ~agree
        same &= agree
        if p == l // 2 - 1:
            prefix = same.copy()
        before, here, nearby = here, nearby, index.at(p + 2) if p + 2 <= l else np.zeros_like(here)
    size = (index.codes != index.pad).sum(axis=1)
    of_length = lambda n: bits(np.pad((size == n).astype(np.uint8), (0, index.words * 64 - index.n))[None, :])
    out = less & of_length(l) if long else (other & of_length(l)) | ((more | same) & of_length(l + 1))
    out[last_half] &= ~prefix[last_half]
    return out


def block_answers(words: list[str], n: np.ndarray, l: int, side: np.ndarray, role: np.ndarray, group: np.ndarray):  # noqa: E741
    """(row, near words, row of the best) for the asking rows of a block that have any.  Rows
    stand by group, then falling count, then word."""
    size = np.fromiter(map(len, words), int, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet, flat = np.unique(points, return_inverse=True)
    codes = np.full((len(words), l + 1), len(alphabet))
    codes[np.repeat(np.arange(len(words)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    at = np.flatnonzero(role & INDEXED)
    index = PositionIndex(codes[at], len(alphabet))
    numbers, first = np.unique(group[at], return_index=True)
    end = np.append(first[1:], len(at))
    place = np.arange(index.words * 64)
    found = []
    for m in (l, l + 1):
        ask = np.flatnonzero((role & ASKED > 0) & (size == m) & np.isin(group, numbers))
        for i in range(0, len(ask), QUERIES):
            q = ask[i:i + QUERIES]
            g, back = np.unique(np.searchsorted(numbers, group[q]), return_inverse=True)
            mask = bits(((place >= first[g, None]) & (place < end[g, None])).astype(np.uint8))[back]
            near = near_sets(index, codes[q], m, l, mask, side[q] == 1)
            count = np.bitwise_count(near).sum(axis=1)
            hit = np.flatnonzero(count)
            word = (near[hit] != 0).argmax(axis=1)
            x = near[hit, word]
            bit = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1))
            found.append((q[hit], count[hit].astype(np.int64), at[word * 64 + bit]))
    return tuple(np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, int),) * 3


def blocks_of(rows: pa.Table):
    """Cut a table of whole groups into blocks of one length: (from, to)."""
    key = [np.asarray(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1))) for c in (rows.column(g) for g in GROUP)]
    cut = np.flatnonzero(np.logical_or.reduce(key)) + 1 if len(rows) > 1 else np.zeros(0, int)
    group = np.zeros(len(rows), int)
    group[cut] = 1
    group = np.cumsum(group)
    length = rows.column("l").to_numpy()
    out, start = [], 0
    for a, b in zip(np.append(0, cut), np.append(cut, len(rows))):
        if a > start and (length[a] != length[start] or b - start > max(1, min(BLOCK, LETTERS_AT_ONCE // length[start]))):
            out.append((start, a))
            start = a
    return [*out, (start, len(rows))], group


def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group -> (word, near, best_n, best); at most one unfinished group and one
    batch are held."""
    held = None

    def solve(rows: pa.Table):
        blocks, group = blocks_of(rows)
        word, n = rows.column("word"), rows.column("n").to_numpy()
        side, role, length = (rows.column(c).to_numpy() for c in ("side", "role", "l"))
        for a, b in blocks:
            words = word.slice(a, b - a).to_pylist()
            if b - a < 2:
                continue
            i, count, best = block_answers(words, n[a:b], int(length[a]), side[a:b], role[a:b], group[a:b])
            if len(i):
                yield pa.record_batch([pa.array([words[j] for j in i]), pa.array(count), pa.array(n[a:b][best]), pa.array([words[j] for j in best])],
                                      names=["word", "near", "best_n", "best"])

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        differs = np.logical_or.reduce([np.asarray(pc.not_equal(held.column(g), held.column(g)[len(held) - 1])) for g in GROUP])
        whole = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if whole:
            yield from solve(held.slice(0, whole))
            held = held.slice(whole)
    if held is not None and len(held):
        yield from solve(held)


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """For each of the distinct words (word, n): word, n, n_near, best, best_n (its near word of
    largest n, ties by code points; null if none)."""
    ship_package(words.sparkSession)
    rows = tiled(halves(words), tile).repartition(*GROUP).sortWithinPartitions(*GROUP, F.col("n").desc(), "word")

    def ask(it):
        yield from answers(it)

    found = rows.select(*GROUP, "role", "word", "n").mapInArrow(ask, "word string, near bigint, best_n bigint, best string")
    best = F.struct((-F.col("best_n")).alias("c"), F.col("best").alias("w"))
    every = words.select("word", "n", F.lit(0).cast("bigint").alias("near"), F.lit(None).cast("struct<c: bigint, w: string>").alias("b"))
    every = every.unionByName(found.select("word", F.lit(None).cast("bigint").alias("n"), "near", best.alias("b")))
    out = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("b").alias("b"))
    return out.select("word", "n", "n_near", F.col("b.w").alias("best"), (-F.col("b.c")).alias("best_n"))


def roots_of(forms: DataFrame, ratio: int, max_n: int) -> DataFrame:
    """(word, root) of the words that have a form, by pointer jumping: counts grow by ``ratio``
    along a chain, so the largest count bounds its length and the number of rounds."""
    links = write_table(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "spelling-links")
    longest = max(1, math.floor(math.log(max(max_n, 2)) / math.log(ratio)) + 1)
    for _ in range(math.ceil(math.log2(longest))):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        links = write_table(links.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root")), "spelling-links")
    return links


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT,
             every: int = EVERY, ratio: int = RATIO, tile: int = TILE) -> DataFrame:
    """Per word of ``words_of``: word, form, root, n, n_near, form_n.  A word's form is its near
    word (one inserted, deleted or replaced code point) of largest n, ties by code points, if
    that n is at least ``ratio`` times its own; root follows forms to the last one.

    Null and empty texts have no words; repeated rows count as often as they stand; other
    columns are ignored; an empty table gives no rows.  ``ratio`` must be 2 or more."""
    words = write_table(words_of(docs, id_col, text_col, min_letters, min_count, every), "spelling-words")
    is_form = F.col("best_n") >= ratio * F.col("n")
    forms = write_table(near_words(words, tile).select("word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")),
                        "spelling-forms")
    roots = roots_of(forms, ratio, forms.agg(F.max("n")).first()[0] or 0)
    out = forms.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
