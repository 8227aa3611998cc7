"""Best-fit packing: a configuration linear program over the length histogram.

The corpus is read once: a tokenising pass gives thin piece rows (no ids), which are written to
the shared folder. Only the histogram of piece lengths, at most `size` rows, reaches the driver.
There multiplicative weights price configurations with a knapsack DP; prices give dual bounds (those
by tokens alone the quotient of all tokens); lengths are answered by the best full configurations in whole steps, so the solution
is rounded down as it grows. On a corpus of documents nine tenths of the pieces and more are placed so; the last few per
cent, an even sample of all lengths by then, fill up by best fit. Prices are integers (fixed point, no
library functions of floats), so a plan is the same on every machine. A rounded plan that needs more
sequences than the dual bound is rounded again, with finer steps or more left over, and the plan of
fewest sequences is taken: every plan rounds the program. (Where long pieces have too few short ones
beside them, full configurations run out; more is left to best fit then.) Rows then find their sequence through their rank within their
length, counted in hash buckets so that a hot length is split.
Ids of a word are found by hash, and the word's bytes are compared with those they were made from.

Null text is the empty text (the end id alone). Repeated rows are packed each on their own. An
empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SIZE = 2048
TABLE_BITS = 21
_PUNCTUATION, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_PUNCTUATION[list(b".,;:!?|%&*#$")] = True
_LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts. The tokenizer drops white space and no token crosses it, so a text's
    ids are its words' ids in a row. It also lower-cases and parts letters from punctuation, so a
    word is a unit up to its last letter and, if punctuation follows, a unit of that. Units are
    found in a table by 64-bit hash; the tokenizer runs once for each unit of a table generation."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << TABLE_BITS, np.uint64)
        self.first = np.zeros(1 << TABLE_BITS, np.int32)
        self.count = np.zeros(1 << TABLE_BITS, np.int32)
        self.pool, self.held, self.units = np.zeros(1 << 20, np.uint32), 0, 0
        self.spell = np.zeros(1 << TABLE_BITS, np.int32)  # where a unit's bytes are, and how many
        self.size = np.zeros(1 << TABLE_BITS, np.int32)
        self.letters, self.spelt = np.zeros(1 << 20, np.uint8), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slots of hashes, -1 if absent."""
        mask = np.uint64(len(self.keys) - 1)
        slot = (h & mask).astype(np.int64)
        open_ = np.flatnonzero(self.keys[slot] != h)
        while len(open_):
            absent = self.keys[slot[open_]] == 0
            slot[open_[absent]] = -1
            open_ = open_[~absent]
            slot[open_] = (slot[open_] + 1) & int(mask)
            open_ = open_[self.keys[slot[open_]] != h[open_]]
        return slot

    def insert(self, h: np.ndarray, first: np.ndarray, count: np.ndarray, spell: np.ndarray, size: np.ndarray) -> None:
        """Distinct hashes that are absent."""
        mask = len(self.keys) - 1
        slot, left = (h & np.uint64(mask)).astype(np.int64), np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = h[free]
            won = free[self.keys[slot[free]] == h[free]]
            self.first[slot[won]], self.count[slot[won]] = first[won], count[won]
            self.spell[slot[won]], self.size[slot[won]] = spell[won], size[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & mask
        self.units += len(h)

    def learn(self, h: np.ndarray, raw: list[bytes]) -> None:
        """One call for many units: tokens go back to units by their place in the joined text."""
        for i in range(0, len(raw), 4096):
            some = [x.decode("utf-8", "replace") for x in raw[i : i + 4096]]
            size = np.fromiter(map(len, raw[i : i + 4096]), np.int64, len(some))
            while self.spelt + int(size.sum()) > len(self.letters):
                self.letters = np.concatenate((self.letters, np.zeros_like(self.letters)))
            spell = self.spelt + np.cumsum(size) - size
            self.letters[self.spelt : self.spelt + int(size.sum())] = np.frombuffer(b"".join(raw[i : i + 4096]), np.uint8)
            self.spelt += int(size.sum())
            got = self.tok.encode(" ".join(some), add_special_tokens=False)
            ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
            at = np.fromiter((a for a, _ in got.offsets), np.int64, len(got.ids))
            cuts = np.searchsorted(at, ends)
            n = len(got.ids)
            while self.held + n > len(self.pool):
                self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
            self.pool[self.held : self.held + n] = got.ids
            counts = np.diff(cuts, prepend=0)
            self.insert(h[i : i + 4096], self.held + cuts - counts, counts, spell, size)
            self.held += n

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column in a row, and n + 1 bounds."""
        data, offs = common.flat(col)
        starts, ends, first = common.word_spans(data, offs)
        stem = ends.copy()
        live = np.arange(len(stem))
        for _ in range(8):
            live = live[(stem[live] > starts[live]) & _PUNCTUATION[data[stem[live] - 1]]]
            stem[live] -= 1
        tail = data[stem - 1] if len(stem) else data[:0]
        letter = _LETTER[tail] | ((tail >= 0x80) & (tail != 0x97) & (tail != 0xB7) & (stem - starts >= 2) & (data[stem - 2] == 0xC3))
        stem = np.where((stem > starts) & letter, stem, ends)
        more = stem < ends
        pos = np.arange(len(stem)) + np.cumsum(more) - more
        a, b = (np.empty(len(stem) + int(more.sum()), np.int64) for _ in range(2))
        a[pos], b[pos] = starts, stem
        a[pos[more] + 1], b[pos[more] + 1] = stem[more], ends[more]
        raw = data.tobytes()
        # a special token's string is found before lower-casing, so it must keep its case
        low = data if b"<|" in raw else common.lower(data)
        h = common.spans_hash(low, a, b) | np.uint64(1)
        slot = self.find(h)
        new, where = np.unique(h[slot < 0], return_index=True)
        if self.units + len(new) > len(self.keys) // 2 or max(self.held, self.spelt) > 1 << 29:
            self.clear()
            new, where = np.unique(h, return_index=True)
            while 2 * len(new) > len(self.keys):
                self.keys, self.first, self.count, self.spell, self.size = (np.concatenate((x, x)) for x in (self.keys, self.first, self.count, self.spell, self.size))
        else:
            where = np.flatnonzero(slot < 0)[where]
        if len(new):
            raw = low.tobytes()
            self.learn(new, [raw[x:y] for x, y in zip(a[where].tolist(), b[where].tolist(), strict=True)])
            slot = self.find(h)
        clash = self.differ(low, a, b, slot)
        if len(clash):  # two units of one hash: texts that hold the other one are encoded as they are
            bad = np.unique(np.searchsorted(np.append(pos, len(a))[first], clash, "right") - 1)
            return self.patched(col, slot, pos, first, len(a), bad)
        count = self.count[slot].astype(np.int64)
        total = np.concatenate(([0], np.cumsum(count)))
        ids = self.pool[np.repeat(self.first[slot] - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.append(pos, len(a))[first]]

    def differ(self, low: np.ndarray, a: np.ndarray, b: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Units whose bytes are not those that the ids in their slot were made from."""
        n = b - a
        odd = n != self.size[slot]
        shift = self.spell[slot] - a
        out = [np.flatnonzero(odd)]
        for i in range(0, len(a), 1 << 16):
            m = np.flatnonzero(~odd[i : i + (1 << 16)]) + i
            k = n[m]
            ends = np.cumsum(k)
            if not len(m):
                continue
            here = np.repeat(a[m] - (ends - k), k) + np.arange(ends[-1])
            wrong = self.letters[here + np.repeat(shift[m], k)] != low[here]
            if wrong.any():
                out.append(np.unique(m[np.searchsorted(ends, np.flatnonzero(wrong), "right")]))
        return np.concatenate(out)

    def patched(self, col, slot, pos, first, n, bad) -> tuple[np.ndarray, np.ndarray]:
        count = self.count[slot].astype(np.int64)
        total = np.concatenate(([0], np.cumsum(count)))
        at = total[np.append(pos, n)[first]]
        ids = self.pool[np.repeat(self.first[slot] - total[:-1], count) + np.arange(total[-1])]
        texts = [ids[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
        for d in bad.tolist():
            texts[d] = np.array(self.tok.encode(col[d].as_py() or "", add_special_tokens=False).ids, np.uint32)
        return np.concatenate(texts), np.concatenate(([0], np.cumsum([len(x) for x in texts])))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python worker, which keeps the words of its earlier tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """One row per piece of each document: (doc_id, piece, start, length, ids_crc32)."""

    def run(batches):
        enc = encoder(path)
        for rb in common.slices(batches):
            out: list[tuple] = []
            ids, at = enc.encode(rb.column("text"))
            raw = ids.astype("<u4").tobytes()
            at = (4 * at).tolist()
            for doc, x, y in zip(rb.column("doc_id").to_pylist(), at[:-1], at[1:], strict=True):
                own = raw[x:y] + b"\0\0\0\0"
                for k, p in enumerate(range(0, len(own), 4 * size)):
                    part = own[p : p + 4 * size]
                    out.append((doc, k, p // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(common.trimming(run), PIECES)


UNIT = 1 << 16  # fixed point
ROUNDINGS = ((40, 128, 32), (60, 128, 16), (40, 256, 32))  # stop, parts, batch of weighted()
UNEVEN = ((250, 128, 32), (500, 128, 32), (750, 128, 32))  # where no full configurations are left for the pieces that lag


def power(x: np.ndarray) -> np.ndarray:
    """2 ** x in fixed point, x too: powers by shifts, linear between them."""
    whole = x >> 16
    part = UNIT + (x & (UNIT - 1))
    return np.where(whole >= 0, part << np.maximum(whole, 0), part >> np.maximum(-whole, 0))


def prices_of(live: np.ndarray, rest: np.ndarray, n: np.ndarray, left: int, tokens: int) -> np.ndarray:
    """Of lengths: their tokens times their own eighth root (long ones fit fewer places) times a weight that
    falls exponentially with how far the length is ahead of the whole (`left` of `tokens` tokens)."""
    root = roots(int(live[-1]) if len(live) else 0)[live]
    whole = tokens * UNIT
    ahead = np.array([r * whole // (m * left) - UNIT for r, m in zip(rest.tolist(), n.tolist(), strict=True)], object)
    ahead = np.clip(ahead, -3 * UNIT, 3 * UNIT).astype(np.int64) * 3 // 2
    return (live * root * power(ahead)) >> 8


@functools.cache
def roots(most: int) -> np.ndarray:
    """Eighth roots of 0 to `most`, times 2 ** 8."""
    return np.array([math.isqrt(math.isqrt(math.isqrt(x << 64))) for x in range(most + 1)], np.int64)


def price(value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack DP over lengths: of each capacity the largest total value, and the least length of a
    configuration that has it (0: the capacity below is as good). `value` is by length, from 0.

    A configuration that beats the capacity below fills it, so its least length is at most half of it
    or it is one piece: the other lengths are not looked at."""
    back, last = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)  # back[size - c] is the best of c
    first, single, sums, most = value[1:], value.tolist(), np.empty(size // 2 + 1, np.int64), 0
    for c in range(1, size + 1):
        at, half, found = size - c + 1, c // 2, 0
        if half:
            v = np.add(first[:half], back[at : at + half], sums[:half])
            i = v.argmax()
            x = v.item(i)
            if x > most:
                most, found = x, i + 1
        if single[c] > most:
            most, found = single[c], c
        back[at - 1] = most
        if found:
            last[c] = found
    return back[::-1], last


def holding(ln: int, last: list[int], rest: np.ndarray, prices: np.ndarray, size: int) -> dict[int, int]:
    """The configuration of largest value among those that hold a piece of `ln`, as far as there are
    pieces; where a length runs out, the best one or two others that fill what is left."""
    out, c = {ln: 1}, size - ln
    while c > 0:
        k = last[c]
        if k and out.get(k, 0) < rest[k]:
            out[k] = out.get(k, 0) + 1
            c -= k
            continue
        there = rest[: c + 1] > 0
        for k, m in out.items():
            if k <= c and rest[k] <= m + 1:
                there[k] = False  # one that may be taken twice must be there twice
        if there[c]:
            out[c] = out.get(c, 0) + 1
            return out
        pairs = np.flatnonzero(there & there[::-1])
        if not len(pairs):
            return out
        x = int(pairs[int((prices[pairs] + prices[c - pairs]).argmax())])
        if x == c - x and rest[x] < out.get(x, 0) + 2:
            return out
        for k in (x, c - x):
            out[k] = out.get(k, 0) + 1
        return out
    return out


def weighted(n: np.ndarray, size: int, stop: int = 40, parts: int = 128, batch: int = 32) -> tuple[dict, int]:
    """The configuration linear program (fewest sequences that cover n pieces of each length) by
    multiplicative weights, rounded down step by step: (configurations with how many, dual bound).

    A DP prices all configurations; the lengths that lag most are each answered by the best
    configuration that holds them, if it is full, in whole steps of at most 1/parts of the length's
    pieces, and prices are made anew after `batch` of them. So all lengths are used up evenly, and the
    last `stop` thousandths of all tokens are an even sample of them, which is left for the caller."""
    have, lengths = np.flatnonzero(n), np.arange(size + 1)
    rest, tokens = n.copy(), int((n * lengths).sum())
    plan: dict[tuple, int] = {}
    bound = 0
    while True:
        left = int((rest * lengths).sum())
        live = have[rest[have] > 0]
        if 1000 * left < stop * tokens or not len(live):
            return plan, bound
        prices = np.full(size + 1, -1, np.int64)
        prices[live] = prices_of(live, rest[live], n[live], left, tokens)
        best, last = price(prices, size)
        if not plan:  # all pieces are still there: the prices are a dual solution of the whole
            bound = -(-sum(int(a) * int(b) for a, b in zip(prices[have], n[have], strict=True)) // int(best[size]))
        last, moved = last.tolist(), 0
        for ln in live[np.lexsort((-live, -(rest[live] / n[live])))].tolist():
            if rest[ln] <= 0:
                continue
            config = holding(ln, last, rest, prices, size)
            if sum(k * m for k, m in config.items()) < size:
                continue
            q = min(max(int(n[ln]) // parts, 1), *(int(rest[k]) // m for k, m in config.items()))
            for k, m in config.items():
                rest[k] -= m * q
            key = tuple(sorted(config.items(), reverse=True))
            plan[key] = plan.get(key, 0) + q
            moved += 1
            if moved == batch:
                break
        if not moved:
            return plan, bound


def best_fit(rest: np.ndarray, size: int, free: list[list] | None = None) -> list[list]:
    """Best fit on the histogram, longest first; classes of equal sequences by their free tokens."""
    free = free or [[] for _ in range(size + 1)]
    for ln in np.flatnonzero(rest)[::-1].tolist():
        r, room = int(rest[ln]), ln
        while r > 0:
            while room <= size and not free[room]:
                room += 1
            if room > size:
                k = size // ln
                if r // k:
                    free[size - k * ln].append([(ln,) * k, r // k])
                if r % k:
                    free[size - (r % k) * ln].append([(ln,) * (r % k), 1])
                break
            config, q = free[room].pop()
            m = min(room // ln, r)
            take = min(q, r // m)
            if take < q:
                free[room].append([config, q - take])
            free[room - m * ln].append([config + (ln,) * m, take])
            r -= m * take
    return free


def rounded(n: np.ndarray, size: int, plan: dict) -> tuple[list[list], int]:
    """The plan with what it leaves filled up by best fit, as classes by free tokens; what it left."""
    rest = n.copy()
    free: list[list] = [[] for _ in range(size + 1)]
    for config, q in plan.items():
        for ln, m in config:
            rest[ln] -= m * q
        free[size - sum(ln * m for ln, m in config)].append([tuple(ln for ln, m in config for _ in range(m)), q])
    return best_fit(rest, size, free), int(rest.sum())


def solve(hist: dict[int, int], size: int = SIZE) -> tuple[list[tuple[tuple[int, ...], int]], dict]:
    """(lengths of a sequence in order, how many such sequences), covering `hist` exactly, and
    figures: the dual bound, sequences of this plan, how often it was rounded, sequences of best fit
    alone (to compare), and the share of pieces that priced configurations hold."""
    n = np.zeros(size + 1, np.int64)
    for k, v in hist.items():
        n[int(k)] += int(v)
    if not n.any():
        return [], {"bound": 0, "priced": 0, "rounded": 0, "best_fit": 0, "lp_share": 0.0}
    count = lambda classes: sum(q for c in classes for _, q in c)
    least = -(-int((n * np.arange(size + 1)).sum()) // size)
    found, bound = None, 0
    for k, (stop, parts, batch) in enumerate(ROUNDINGS + UNEVEN, 1):
        if k > len(ROUNDINGS) and 1000 * (count(found[0]) - bound) < bound:
            break
        plan, dual = weighted(n, size, stop, parts, batch)
        bound = max(bound, dual, least)
        free, left = rounded(n, size, plan)
        if found is None or count(free) < count(found[0]):
            found = free, left
        if count(found[0]) <= bound:
            break
    facts = {"bound": bound, "priced": count(found[0]), "rounded": k, "best_fit": count(best_fit(n, size)), "lp_share": 1 - found[1] / int(n.sum())}
    return [(tuple(c), int(q)) for cls in found[0] for c, q in cls if q], facts


def configurations(hist: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    return solve(hist, size)[0]


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """Pieces of all documents with sequence_id and offset; sequences hold at most `size` tokens."""
    spark = docs.sparkSession
    got = common.written(pieces(docs, path or vocabulary(), size))
    buckets = common.partitions(spark)
    got = got.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = common.written(got.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n")))
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `size` rows
    plan = configurations(hist, size)
    slots: dict[int, list] = {}
    at: dict[int, int] = {}
    base = 0
    for config, q in plan:
        off = 0
        for ln in config:
            slots.setdefault(ln, []).append((at.get(ln, 0), base, off))
            at[ln] = at.get(ln, 0) + q
            off += ln
        base += q
    arrays = {ln: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for ln, v in slots.items()}
    w = Window.partitionBy("length").orderBy("_b")
    starts = counts.select("length", "_b", (F.sum("_n").over(w) - F.col("_n")).alias("_at"))
    ranked = got.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(starts, ["length", "_b"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_at") + F.col("_r") - 1).alias("_r"))

    def place(batches):
        for rb in batches:
            ln = rb.column("length").to_numpy()
            rank = rb.column("_r").to_numpy()
            seq, off = np.zeros(len(ln), np.int64), np.zeros(len(ln), np.int64)
            for v in np.unique(ln):
                m = ln == v
                first, b, o = arrays[int(v)]
                k = np.searchsorted(first, rank[m], "right") - 1
                seq[m], off[m] = b[k] + rank[m] - first[k], o[k]
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(common.trimming(place), PIECES + ", sequence_id long, offset long")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
