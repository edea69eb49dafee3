"""Exact n-gram Jaccard join by partitioning the universe of n-grams.

Sets are put into bands by size. In a band, n-grams are hashed into so many segments that two similar sets, which differ in
at most H n-grams, must agree on a segment entirely (plain segments, more than H of them) or but for one n-gram (one-deletion
segments, more than H / 2 of them). Which of the two a band uses, and how many segments it adds so that the agreeing segment
is not an empty one, is the cheaper by a cost model. Equal segments make candidates, and candidates are verified exactly.

Equal sets are one set throughout. Of the sets that share a segment, each is first compared with the hub it shares most with;
what is then connected is not compared again. Sets that share a segment and are still apart are compared block against block:
first by sketches, bit rows whose distance is never more than that of the sets, so that only those which may be similar to
another one send their n-grams, and then exactly.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, small, stored
from .arrow import grouped, in_arrow, lean, slices
from .graph import components

U = np.uint64
#: How fast the bands' sizes grow.
GROWTH = 1.5
#: Cost of a set that has to put its empty segments into the index, against that of one indexed segment.
EMPTY_COST = 3000
#: Members of a group that one task compares with the group's first set.
MEMBERS = 256
#: Sets of a group that are compared with each other in one block, by n-grams and by sketches.
BLOCK, SIDE = 1024, 1024
#: Bytes of text whose shingles are hashed at once; working memory is about a hundred times that.
SLICE = 1 << 19
#: Sets that a task remembers, so that copies don't put their segments into the index again.
SEEN = 200_000
#: Sets of a segment from which on it is common, and the most common segments there can be (the least grows with the table).
COMMON, MOST_COMMON = 1024, 50_000
#: Bytes of a word from which on it is hashed as a whole.
LONG_WORD = 48


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a one-to-one scrambling of its input."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Hashes of the distinct n-word shingles of many texts at once."""

    def __init__(self, words: int):
        self.words = words
        rng = np.random.default_rng(11)
        self.letter = rng.integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
        self.base = U(0x9E3779B97F4A7C15)
        inverse = pow(int(self.base), -1, 1 << 64)
        self.power, self.back = np.ones(1, U), np.ones(1, U)
        self.inverse = U(inverse)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.place = rng.integers(1, 1 << 63, max(8, words), dtype=U) * U(2) + U(1)

    def powers(self, n: int) -> None:
        while len(self.power) < n:
            k = len(self.power)
            self.power = np.concatenate([self.power, self.power * (self.power[-1:] * self.base)])
            self.back = np.concatenate([self.back, self.back * (self.back[-1:] * self.inverse)])
            assert len(self.power) == 2 * k

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all texts' distinct shingles, and where each text's begin (one more than texts)."""
        data = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
        n = len(data)
        self.powers(n + 1)
        gap = self.space[data]
        edge = np.diff(gap.astype(np.int8), prepend=1, append=1)
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        end = end[end > 0][-len(start) :] if len(start) else end[:0]
        sums = np.zeros(n + 1, U)
        np.cumsum(self.letter[data] * self.power[:n], out=sums[1:])
        word = mix((sums[end] - sums[start]) * self.back[start] + (end - start).astype(U))
        long = np.flatnonzero(end - start >= LONG_WORD)  # sums of powers modulo 2^64 collide for some long words
        if len(long):
            word[long] = [int.from_bytes(hashlib.blake2b(data[a:b].tobytes(), digest_size=8).digest(), "little") for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
        of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right") if texts else start
        per = np.bincount(of, minlength=len(texts))
        first = np.concatenate([[0], np.cumsum(per)])
        k = self.words
        rank = np.arange(len(start)) - first[of]  # of a word in its text
        full = np.flatnonzero(per[of] - rank >= k)
        hashes = np.zeros(len(full), U)
        for i in range(k):
            hashes += word[full + i] * self.place[i]
        hashes = mix(hashes)
        doc = of[full]
        short = np.flatnonzero((per > 0) & (per < k))
        if len(short):
            own = np.zeros(len(short), U)
            for i in range(k - 1):
                has = per[short] > i
                own[has] += word[first[short[has]] + i] * self.place[i]
            hashes, doc = np.concatenate([hashes, mix(own + per[short].astype(U))]), np.concatenate([doc, short])
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        keep = np.ones(len(doc), bool)
        keep[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
        hashes, doc = hashes[keep], doc[keep]
        return hashes, np.searchsorted(doc, np.arange(len(texts) + 1))


class Bands:
    """Size bands for a similarity of num / den, with the segments of each."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def most_differing(self, total: int) -> int:
        """n-grams that two similar sets of ``total`` elements together may have in only one of them."""
        return (self.den - self.num) * total // (self.den + self.num)

    def bound(self, n: int) -> int:
        """The same for a set of n elements and any similar one."""
        return self.most_differing(n + n * self.den // self.num)

    @cache  # noqa: B019
    def band(self, k: int) -> tuple[int, int]:
        """First and last size of a band."""
        low = 1 if k == 0 else self.band(k - 1)[1] + 1
        return low, max(low, int(low * GROWTH))

    @cache  # noqa: B019
    def of(self, n: int) -> int:
        k = 0
        while self.band(k)[1] < n:
            k += 1
        return k

    @cache  # noqa: B019
    def allocation(self, k: int) -> tuple[int, bool]:
        """Number of segments of a band, and whether they are one-deletion segments; 0 where only equal sets are similar."""
        low, high = self.band(k)
        most = self.bound(high)
        if not most:
            return 0, False

        def tail(mean: float, above: int) -> float:
            term, total = math.exp(-mean), 0.0
            for i in range(above + 1):
                total += term
                term *= mean / (i + 1)
            return max(0.0, 1 - total)

        options = []
        for spare in range(0, 12 + most // 8):
            m = most + 1 + spare
            options.append((m + EMPTY_COST * tail(m * math.exp(-high / m), spare), m, False))
            m = most // 2 + 1 + spare
            options.append((high + m + EMPTY_COST * tail(m * math.exp(-high / m) * (1 + high / m), spare), m, True))
        return min(options)[1:]

    @cache  # noqa: B019
    def uses(self, n: int) -> tuple[int, ...]:
        """Bands whose segments a set of n elements is indexed by: its own, and those of smaller similar sets."""
        return tuple(k for k in range(self.of(-(-n * self.num // self.den)), self.of(n) + 1) if self.allocation(k)[0])

    def signatures(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all segments of some sets (none of them empty), and the index of each key's set."""
        jobs = [(i, k) for i, s in enumerate(sets) for k in self.uses(len(s))]
        if not jobs:
            return np.zeros(0, U), np.zeros(0, np.int64)
        sizes = np.array([len(sets[i]) for i, _ in jobs])
        m = np.array([self.allocation(k)[0] for _, k in jobs])
        deleting = np.array([self.allocation(k)[1] for _, k in jobs])
        grams = np.concatenate([sets[i] for i, _ in jobs])
        job = np.repeat(np.arange(len(jobs)), sizes)
        base = np.concatenate([[0], np.cumsum(m)])
        at = base[job] + ((grams >> U(11)) % m[job].astype(U)).astype(np.int64)
        value = mix(grams + U(0x632BE59BD9B4E019))
        total = int(base[-1])
        low = np.bincount(at, (value & U(0xFFFFFFFF)).astype(float), total).astype(U)
        high = np.bincount(at, (value >> U(32)).astype(float), total).astype(U)
        sums = low + (high << U(32))
        count = np.bincount(at, minlength=total)
        owner = np.repeat(np.arange(len(jobs)), m)
        salt = mix(np.array([k for _, k in jobs], U)[owner] * U(1 << 32) + (np.arange(total) - base[owner]).astype(U))
        bound = np.array([self.bound(int(n)) for n in sizes])
        weak = np.bincount(owner, count <= deleting[owner], len(jobs))
        rare = m - np.where(deleting, bound // 2, bound) - weak < 1  # for these an empty segment may be the only one that agrees
        plain = (count > 0) | rare[owner]
        keys, of = [mix(sums + salt)[plain]], [owner[plain]]
        less = deleting[job] & ((count[at] > 1) | rare[job])
        keys.append(mix(sums[at[less]] - value[less] + salt[at[less]]))
        of.append(job[less])
        index = np.array([i for i, _ in jobs])
        return np.concatenate(keys), index[np.concatenate(of)]


def set_id(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def shingle_sets(batches, text: int, words: int):
    """(slice, sets) for the slices of Arrow batches whose column ``text`` holds the texts."""
    shingler = Shingler(words)
    for batch in batches:
        for part in slices(batch, text, SLICE):
            hashes, cut = shingler([(t or "").encode() for t in part.column(text).to_pylist()])
            yield part, [hashes[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def sketch_bytes(n: np.ndarray) -> np.ndarray:
    """Bytes of the sketches of sets of n elements: bits are a power of two, two to four times n."""
    return np.left_shift(8, np.ceil(np.log2(np.maximum(n, 32) / 32)).astype(np.int64))


def odd_sketches(sets: list[np.ndarray]) -> list[bytes]:
    """For each set a row of bits, each the parity of the number of elements that fall there.

    Two sketches differ in no more bits than their sets do in elements, so a pair of too distant sketches is not similar.
    """
    if not sets:
        return []
    sizes = np.array([len(s) for s in sets])
    width = sketch_bytes(sizes)
    base = np.concatenate([[0], np.cumsum(width * 8)])
    of = np.repeat(np.arange(len(sets)), sizes)
    at = base[of] + (mix(np.concatenate(sets) + U(0x9E6C63D0876A9A47)) & (width[of] * 8 - 1).astype(U)).astype(np.int64)
    packed = np.packbits(np.bincount(at, minlength=int(base[-1])).astype(np.uint8) & 1).tobytes()
    return [packed[a:b] for a, b in zip((base[:-1] // 8).tolist(), (base[1:] // 8).tolist(), strict=True)]


def folded(rows: np.ndarray, width: int) -> np.ndarray:
    """Sketches (as rows of 64-bit words) of a smaller width."""
    return rows if rows.shape[1] == width else np.bitwise_xor.reduce(rows.reshape(len(rows), -1, width), axis=1)


class Sketches:
    """Sketches of some sets, by width, to compare many with many."""

    def __init__(self, n: np.ndarray, rows: pa.Array, num: int, den: int):
        self.n, self.num, self.den = n, num, den
        width = np.array([len(r) // 8 for r in rows.to_pylist()], np.int64)
        raw = rows.to_pylist()
        self.by = {int(w): (i, np.frombuffer(b"".join([raw[k] for k in i]), U).reshape(len(i), -1)) for w in np.unique(width) for i in [np.flatnonzero(width == w)]}

    def fits(self, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> np.ndarray:
        total = self.n[i] + self.n[j]
        return apart <= (self.den - self.num) * total // (self.den + self.num)

    def candidates(self, left: np.ndarray, right: np.ndarray):
        """(i, j) of those pairs, i of ``left`` and j of ``right`` (masks), whose sketches let them be similar; in pieces."""
        for a, (at_a, rows_a) in self.by.items():
            for b, (at_b, rows_b) in self.by.items():
                if max(a, b) > 2 * min(a, b) and self.den * 2 * min(a, b) < self.num * max(a, b):
                    continue  # one has more than den / num times as many elements
                w, in_a, in_b = min(a, b), left[at_a], right[at_b]
                i, j = at_a[in_a], at_b[in_b]
                if not len(i) or not len(j):
                    continue
                x, y = folded(rows_a[in_a], w), folded(rows_b[in_b], w)
                step = max(1, (2 << 20) // max(1, len(j) * w))
                for k in range(0, len(i), step):
                    apart = np.bitwise_count(x[k : k + step, None, :] ^ y[None]).sum(2, dtype=np.int64)
                    p, q = np.nonzero(self.fits(i[k : k + step, None], j[None], apart))
                    if len(p):
                        yield i[k + p], j[q]


def set_table(docs: DataFrame, words: int, bands: Bands) -> DataFrame:
    """(id, n, sid, keys, sketch) of all documents; sid names the set and is null for an empty one.

    The keys of the set's segments and its sketch stand with its first document in a task (or more of them, the memory of
    which sets were seen is bounded).
    """

    @lean
    def run(batches):
        seen: set[int] = set()
        for part, sets in shingle_sets(batches, 1, words):
            sids = [set_id(s) if len(s) else None for s in sets]
            if len(seen) > SEEN:
                seen.clear()
            new = {i: k for k, i in enumerate(sids) if i is not None and i not in seen}
            seen.update(new)
            keys, of = bands.signatures([sets[k] for k in new.values()])
            keys = keys[np.argsort(of, kind="stable")].view(np.int64)
            ends = np.cumsum(np.bincount(of, minlength=len(new)))
            count = np.zeros(len(sets), np.int64)
            rank = np.sort(np.fromiter(new.values(), np.int64, len(new)))
            own = {k: at for at, k in enumerate(new.values())}
            order = np.array([own[k] for k in rank], np.int64)  # new sets in the order of their rows
            spans = [(int(ends[o - 1]) if o else 0, int(ends[o])) for o in order]
            flat = np.concatenate([keys[a:b] for a, b in spans]) if spans else keys
            count[rank] = [b - a for a, b in spans]
            holds = np.zeros(len(sets), bool)
            holds[rank] = True
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(flat))
            sketches: list[bytes | None] = [None] * len(sets)
            for k, s in zip(new.values(), odd_sketches([sets[k] for k in new.values()]), strict=True):
                sketches[k] = s
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sids, pa.int64()), lists, pa.array(sketches, pa.binary())], names=["id", "n", "sid", "keys", "sketch"])

    return docs.transform(in_arrow, run, "id long, n long, sid long, keys array<long>, sketch binary")


def shared_segments(table: DataFrame) -> DataFrame:
    """(segment, sid) for the segments that several sets share.

    Segments are dealt out by their keys. Very common ones, which a count over one in 16 sets finds (at most a fixed number
    of them whatever the size of the table), are not dealt to one task: all their sets are taken as they are.
    """
    segments = table.select(F.explode("keys").alias("segment"), "sid")
    total = table.agg(F.sum(F.size("keys"))).first()[0] or 0
    least = max(COMMON, total // MOST_COMMON)
    some = segments.where(F.pmod(F.xxhash64("sid"), F.lit(16)) == 0).groupBy("segment").agg(F.count("*").alias("c"))
    common = stored(some.where(f"c >= {least // 16}").select("segment"), "common")

    @lean
    def run(batches):
        last: tuple[int, int, bool] | None = None  # the row before: key, set, and whether it is out
        for batch in batches:
            keys, sids = (batch.column(i).to_numpy() for i in (0, 1))
            if last is not None:
                keys, sids = np.concatenate([[last[0]], keys]), np.concatenate([[last[1]], sids])
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1])
            keys, sids = keys[new], sids[new]
            if not len(keys):
                continue
            same = keys[1:] == keys[:-1]
            out = np.zeros(len(keys), bool)
            out[1:] |= same
            out[:-1] |= same
            done = bool(out[-1]) or (len(keys) == 1 and last is not None and last[2])
            if last is not None and last[2]:
                out[0] = False
            last = (int(keys[-1]), int(sids[-1]), done)
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(keys[out]), pa.array(sids[out])], names=["segment", "sid"])

    common = F.broadcast(common)  # at most 16 * MOST_COMMON keys
    dealt = segments.join(common, "segment", "left_anti").repartition("segment").sortWithinPartitions("segment", "sid")
    return dealt.transform(in_arrow, run, "segment long, sid long").union(segments.join(common, "segment", "left_semi").distinct())


def best_partners(shared: DataFrame) -> DataFrame:
    """(a, b): for each set b that is no hub the hub ``a`` with which it shares most segments.

    The hub of a segment is that of its sets which meets most others: the text that near copies were made from is closer to
    all of them than they are to each other.
    """
    sizes = shared.groupBy("segment").agg(F.count("*").alias("size"))
    met = shared.join(sizes, "segment").groupBy("sid").agg(F.sum("size").alias("met"))
    hub = shared.join(met, "sid").groupBy("segment").agg(F.max(F.struct("met", "sid")).alias("hub")).select("segment", F.col("hub.sid").alias("a"))
    stars = shared.join(hub, "segment").where("a <> sid").groupBy("a", F.col("sid").alias("b")).agg(F.count("*").alias("n"))
    return stars.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b")


def close_pairs(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Those (a, b) whose sketches let them be similar."""
    a, b = (sketches.select(F.col("sid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab")
    joined = pairs.join(b, "b").join(a, "a").select("a", "b", "n_a", "n_b", "s_a", "s_b").where(f"{den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)")

    @lean
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                keep = []
                for na, nb, x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4), part.column(5), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                    w = min(len(x), len(y))
                    apart = int(np.bitwise_count(folded(x[None], w) ^ folded(y[None], w)).sum())
                    keep.append(apart <= (den - num) * (na + nb) // (den + num))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.transform(in_arrow, run, "a long, b long")


def set_grams(docs: DataFrame, table: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(sid, grams) of the sets named in ``wanted`` (sid), from one document of each."""
    first = table.where("sid is not null").groupBy("sid").agg(F.min("id").alias("id"))
    asked = stored(wanted.distinct().join(first, "sid").select("sid", "id"), "wanted")
    texts = docs.join(small(asked.select("id").distinct()), "id", "left_semi").union(docs.where("id is null")).select("text")

    @lean
    def grams(batches):
        for _, sets in shingle_sets(batches, 0, words):
            own = {set_id(s): s for s in sets if len(s)}
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([s.tobytes() for s in own.values()], pa.binary())], names=["sid", "grams"])

    found = texts.transform(in_arrow, grams, "sid long, grams binary").join(small(asked.select("sid")), "sid", "left_semi").dropDuplicates(["sid"])
    sets = stored(found, "sets", "none")
    discard(asked)
    return sets


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those (a, b) of distinct pairs whose sets (sid, grams) are similar. A set ``a`` with many partners is sent to several tasks."""
    parts = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", F.expr(f"cast(ceil(n / {MEMBERS}) as int)").alias("parts"))
    left = sets.join(parts, sets.sid == parts.a).select("a", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "grams").drop("parts")
    right = pairs.join(parts, "a").join(sets, F.col("b") == sets.sid).select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", "grams")

    @lean
    def run(batches):
        a, own = None, None
        for batch in batches:
            out = []
            for x, b, grams in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                grams = np.frombuffer(grams.as_buffer(), U)
                if b is None:
                    a, own = x, grams
                    continue
                assert x == a
                n = len(own) + len(grams)
                # of a merged pair of sets, what stands twice is shared
                both = np.concatenate([own, grams])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                if den * shared >= num * (n - shared):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    dealt = left.unionByName(right).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return dealt.select("a", "part", "b", "grams").transform(in_arrow, run, "a long, b long")


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect what a symmetric matrix of links connects, as few as possible."""
    left, out = np.ones(len(near), bool), []
    for start in range(len(near)):
        if left[start]:
            left[start] = False
            front = near[start] & left
            while front.any():
                left &= ~front
                out += [(start, i) for i in np.flatnonzero(front).tolist()]
                front = near[front].any(0) & left
    return out


def block_pairs(groups: DataFrame, payload: DataFrame, size: int, *columns: str) -> DataFrame:
    """(kind, grp, low, high, sid, and ``columns``) with the members of two blocks of a group for each pair of its blocks.

    A group (kind, grp) of n members is dealt into n / size blocks, so a member is sent n / size times, and no task gets
    more than two blocks.
    """
    blocks = groups.groupBy("kind", "grp").agg(F.expr(f"cast(ceil(count(*) / {size}) as int)").alias("blocks"))
    placed = groups.join(blocks, ["kind", "grp"]).join(payload, "sid").withColumn("i", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = placed.select("kind", "grp", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"), "sid", "i", *columns)
    return pairs.repartition("kind", "grp", "low", "high").sortWithinPartitions("kind", "grp", "low", "high")


def with_candidates(groups: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """(kind, grp, sid) of those members that may be similar to one of another label, and in groups of kind 1 of another tree, of their group."""
    rows = block_pairs(groups, sketches, SIDE, "label", "tree", "n", "sketch")

    @lean
    def run(batches):
        for (kind, grp, low, high), part in grouped(batches, 4):
            if part.num_rows < 2:
                continue
            sid, i, label, tree, n = (part.column(c).to_numpy() for c in (4, 5, 6, 7, 8))
            live = np.zeros(len(sid), bool)
            for a, b in Sketches(n, part.column(9), num, den).candidates(i == low, i == high):
                open_ = label[a] != label[b]
                if kind:
                    open_ &= tree[a] != tree[b]
                live[a[open_]] = live[b[open_]] = True
            if live.any():
                out = sid[live]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), kind, np.int32)), pa.array(np.full(len(out), grp)), pa.array(out)], names=["kind", "grp", "sid"])

    return rows.transform(in_arrow, run, "kind int, grp long, sid long").distinct()


def block_links(groups: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) links that connect the similar sets of each group (kind, grp, sid), found block against block.

    A task compares two blocks by products of 0/1 matrices over the n-grams that they share, so no pair is ever a row, and
    returns only links that connect something.
    """
    rows = block_pairs(groups, sets, BLOCK, "grams")

    @lean
    def run(batches):
        for _, part in grouped(batches, 4):
            sids, at = np.unique(part.column(4).to_numpy(), return_index=True)
            own = [np.frombuffer(part.column(6)[int(i)].as_buffer(), U) for i in at]
            if len(own) < 2:
                continue
            sizes = np.array([len(g) for g in own])
            _, gram, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
            of, common = np.repeat(np.arange(len(own)), sizes), count > 1
            column = np.cumsum(common) - 1
            keep = common[gram]
            of, gram = of[keep], column[gram[keep]]
            order = np.argsort(gram, kind="stable")
            of, gram = of[order], gram[order]
            shared = np.zeros((len(own), len(own)), np.float32)
            step = 2048
            for start in range(0, int(common.sum()), step):
                a, b = np.searchsorted(gram, (start, start + step))
                some = np.zeros((len(own), step), np.float32)
                some[of[a:b], gram[a:b] - start] = 1
                shared += some @ some.T
            both = shared.astype(np.int64)
            near = den * both >= num * (sizes[:, None] + sizes - both)
            np.fill_diagonal(near, False)
            if found := spanning(near):
                yield pa.RecordBatch.from_arrays([pa.array(sids[[i for i, _ in found]]), pa.array(sids[[j for _, j in found]])], names=["a", "b"])

    return rows.transform(in_arrow, run, "a long, b long")


def open_groups(shared: DataFrame, labels: DataFrame, trees: DataFrame) -> DataFrame:
    """(kind, grp, sid, label, tree) of what has to be compared still.

    A segment whose sets are not all connected is open. Its sets are compared within each tree (kind 0, one group a tree
    whatever the number of its open segments) and, where the segment spans trees, across them (kind 1, a group a segment).
    """
    node = F.col("node").alias("sid")
    marked = shared.join(trees.select(node, F.col("label").alias("tree")), "sid").join(labels.select(node, "label"), "sid", "left").select("segment", "sid", "tree", F.coalesce("label", "sid").alias("label"))
    marked = stored(marked, "marked")
    spread = marked.groupBy("segment").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.min("tree").alias("t"), F.max("tree").alias("u")).where("l <> h").select("segment", (F.col("t") != F.col("u")).alias("spans"))
    open_ = stored(marked.join(spread, "segment"), "open")
    # only trees of several labels are open within
    inner = open_.groupBy("segment", "tree").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("segment", "tree")
    within = open_.join(inner, ["segment", "tree"], "left_semi").select(F.lit(0).alias("kind"), F.col("tree").alias("grp"), "sid", "label", "tree").distinct()
    between = open_.where("spans").select(F.lit(1).alias("kind"), F.col("segment").alias("grp"), "sid", "label", "tree")
    groups = stored(within.union(between), "groups")
    discard(marked)
    discard(open_)
    return groups


def similar_sets(docs: DataFrame, words: int, num: int, den: int, table: DataFrame, shared: DataFrame, sketches: DataFrame) -> DataFrame:
    """(sid, label) of all sets that are similar to another one; sets of one label are connected by links."""
    best = stored(best_partners(shared), "best")
    # first the hub with which a set shares most
    close = stored(close_pairs(best, sketches, num, den), "close")
    sets = set_grams(docs, table, close.select(F.col("a").alias("sid")).union(close.select("b")), words)
    links = stored(verified(close, sets, num, den), "links")
    discard(close)
    discard(sets)
    labels = components(links)
    # then what shares a segment and is still apart: by sketches, and what those let through exactly
    trees = components(best)
    discard(best)
    groups = open_groups(shared, labels, trees)
    live = stored(with_candidates(groups, sketches, num, den), "live")
    discard(groups)
    discard(trees)
    if live.limit(1).count():
        sets = set_grams(docs, table, live.select("sid"), words)
        more = stored(block_links(live, sets, num, den), "links")
        discard(sets)
        discard(labels)
        labels = components(links.union(more))
        discard(more)
    discard(live)
    discard(links)
    return labels.select(F.col("node").alias("sid"), "label")


def components_of_rows(docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """A table (id, n, sid) with a row for each document, and (sid, label) of the sets that are similar to another one."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    whole = stored(set_table(own, words, Bands(num, den)), "documents")
    table = stored(whole.select("id", "n", "sid"), "rows")
    shared = stored(shared_segments(whole), "segments")
    sketches = stored(whole.where("sketch is not null").select("sid", "n", "sketch").dropDuplicates(["sid"]), "sketches", "none")
    discard(whole)
    labels = similar_sets(own, words, num, den, table, shared, sketches)
    discard(shared)
    discard(sketches)
    return table, labels


def join_components(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose sets of n-word shingles have a Jaccard similarity of at least num / den.

    Words are runs of characters other than space and tab to carriage return, with A to Z in lower case. A text of fewer words
    is one shingle; one without words, or null, has none and links with nothing. Returns per row: the id, n_shingles, component_id
    (smallest id reachable by links, its own included). Every row is a node of its own, those of a repeated id too: a component's
    name is the smallest id of its rows, and null where none of them has one. No rows give no rows, and other columns are not
    read. Sets count as equal by a 64-bit hash of their sorted 64-bit n-gram hashes.
    """
    table, labels = components_of_rows(docs, words, num, den, id_col, text_col)
    sets = table.where("sid is not null").groupBy("sid").agg(F.min("id").alias("first")).join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    named = sets.groupBy("label").agg(F.min("first").alias("component"))
    known = sets.join(named, "label").select("sid", "component")
    return table.join(known, "sid", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))


def keep_first(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each component: that of the smallest id (a null one comes last), ties by a hash of the row.

    Rows without words all stay. Of equal rows of a component one stays. No rows give no rows.
    """
    mark = docs.withColumn("_row", F.xxhash64(*docs.columns))
    table, labels = components_of_rows(mark.select(F.col("_row").alias("id"), F.col(text_col).alias("text")), words, num, den, "id", "text")
    ids = mark.select("_row", F.col(id_col).cast("long").alias("_id"))
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("first")
    rows = table.where("sid is not null").select(F.col("id").alias("_row"), "sid").distinct().join(ids.distinct(), "_row")
    groups = rows.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    stay = groups.groupBy("label").agg(first).select("label", F.col("first._row").alias("_stays"))
    gone = groups.join(stay, "label").where("_row <> _stays").select("_row")
    again = table.where("sid is not null").groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("id").alias("_row"))
    again, gone = stored(again, "again"), stored(gone.distinct(), "gone")
    kept = mark.join(small(gone), "_row", "left_anti")
    return kept.join(small(again), "_row", "left_anti").drop("_row").union(kept.join(small(again), "_row", "left_semi").dropDuplicates(["_row"]).drop("_row"))
