"""SimHash near-duplicates, found by pigeonring filtering.

A fingerprint's 64 bits are cut into one segment more than the bits that may differ, laid out as a
ring. Where two fingerprints differ in at most `bits` bits, some segment starts a chain such that
each first l segments of it differ in at most l * bits / segments bits. So the chain's first segment
is equal (that is the key by which fingerprints are dealt; where a value is frequent, its rows are
dealt by the second segment too, but for one bit), its second differs in one bit at most, its third
in two (that is how long runs are cut further), and the longer chains are checked before the whole.

Equal fingerprints are one node, so that copies cost nothing here. Links of one fingerprint are
joined as they are found, in an array of roots: memory is bounded by the rows of a key, not by its
links, and each row sends at most one link on. Of a long dense run only rows that are not joined yet
are compared.

One fingerprint of 64 bits is near only for texts that are nearly equal. near_copies() finds texts of
a lower similarity: `prints` fingerprints each, from as many mixes of the shingle hashes; texts are
candidates if any pair of fingerprints passes the ring, and are decided by the exact Jaccard
similarity of their shingles. At a similarity of 0.8 about 15 % of the bits differ, so that seven
bits at most differ in one of sixteen fingerprints in 98 of 100 cases; at 0.85 in nearly all.

A large group of near copies would meet itself in nearly every run of the ring. So a bounded sample of
the signatures tells where they are dense: each row near a centre there belongs to that centre's zone.
The ring leaves pairs of one zone out; these are decided inside the zone, block by block, each row
once for each block, by the same fingerprints and the same sets. Zones only say where a pair is
decided: rows that the sample doesn't show to be dense have no zone, and meet in the ring.

Defined results: a null text is empty, and an empty text (no word) has fingerprint 0, which links
like any other; fewer words than a shingle are one shingle; repeated rows get the same component;
a null doc_id is kept and takes no part in naming a component. An empty table gives an empty table.
Texts are read whole, however long; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import components, keep, mix, only, pairs_of, release

SEED = 42
SMALL = 24  # runs up to this length are compared pair by pair
LARGE = 1024  # joined runs up to this length are not cut further
CHUNK, ROWS = 32_768, 200_000  # rows that are searched at once, and copies of them by the bits left out
HEAVY = 65_536  # rows of a segment's value beyond which they are dealt by the second segment too
PROBES = 4  # rows of a long run that tell whether it is dense
CENTRES = 1  # rows of a dense run that all others are compared with at first
WHOLE = 0.19  # of all bits of two signatures that may differ there: at a similarity of 0.8 the mean is 0.1515, its deviation 0.0112
ROUNDS = (64, None)  # and further on, of those that are out of its commonest component
DOMAIN = 1 << 20  # values of segments that are counted
SAMPLE, DENSE = 4096, 8  # rows of the sample that zones are found by, and how many of them make one
ZONES, RADIUS = 64, 0.3  # most zones, and the part of all bits that may differ from a zone's centre
BLOCK, BLOCKS, HASHES = 128, 64, 1 << 21  # rows of a block; beyond so many blocks they grow, up to so many shingles on average

_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.float32)
_SALTS = np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _ones(h: np.ndarray) -> np.ndarray:
    """(columns, 64): how often each bit is set in the columns of h (rows, columns), by a histogram of their bytes."""
    width = h.shape[1]
    lower = np.arange(8 * width, dtype=np.int32) * 256
    ones = np.zeros((width, 64), np.int64)
    for at in range(0, len(h), 1 << 12):
        of_byte = np.bincount((h[at : at + (1 << 12)].view(np.uint8).reshape(-1, 8 * width) + lower).ravel(), minlength=2048 * width)
        ones += np.rint(of_byte.reshape(8 * width, 256).astype(np.float32) @ _BITS).astype(np.int64).reshape(width, 64)
    return ones


def hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of a shorter text the whole."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return np.zeros(0, "<u8")
    grams: Iterable[bytes] = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype="<u8")


def signature(h: np.ndarray, prints: int = 1) -> np.ndarray:
    """The SimHashes of shingle hashes, as unsigned 64-bit integers; the first is of the plain hashes."""
    ones = np.zeros((prints, 64), np.int64)
    for at in range(0, len(h), 1 << 14):  # a long text's copies are not held at once
        every = np.repeat(h[at : at + (1 << 14), None], prints, axis=1)
        if prints > 1:
            every[:, 1:] = mix(every[:, 1:] + _SALTS[1:prints])
        ones += _ones(every)
    return np.packbits(2 * ones > len(h), axis=1, bitorder="little").view("<u8").ravel()


def segments(bits: int) -> list[tuple[int, int]]:
    """(shift, width) of bits + 1 segments that cover 64 bits."""
    m = bits + 1
    widths = [64 // m + (k < 64 % m) for k in range(m)]
    return [(sum(widths[:k]), widths[k]) for k in range(m)]


def _mask(shift: int, width: int) -> int:
    return ((1 << width) - 1) << shift


def _near(x: np.ndarray, start: int, bits: int, ring: list[tuple[int, int]]) -> np.ndarray:
    """Which of the differences x pass: chains of two segments and more from start, then the whole."""
    ok, chain = np.ones(len(x), dtype=bool), 0
    for n in range(len(ring) - 1):
        chain |= _mask(*ring[(start + n) % len(ring)])
        if n >= 1:
            at = np.flatnonzero(ok)
            ok[at] = np.bitwise_count(x[at] & np.uint64(chain)) <= (n + 1) * bits // len(ring)
    at = np.flatnonzero(ok)
    ok[at] = np.bitwise_count(x[at]) <= bits
    return ok


class Joined:
    """Which of n places are joined; links are held for a while and then taken together."""

    def __init__(self, n: int):
        self.root, self.held, self.count = np.arange(n), [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append((a, b))
        self.count += len(a)
        if self.count >= 1 << 17:
            self.settle()

    def settle(self) -> np.ndarray:
        """The smallest place of each place's component."""
        if self.held:
            a, b = (np.concatenate(x) for x in zip(*self.held))
            self.held, self.count = [], 0
            while True:
                x, y = self.root[a], self.root[b]
                apart = np.flatnonzero(x != y)
                if not len(apart):
                    break
                a, b, x, y = a[apart], b[apart], x[apart], y[apart]
                np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
                while not np.array_equal(up := self.root[self.root], self.root):
                    self.root = up
        return self.root


class Ring:
    """The search among rows that share a chain's first segment. Places name the rows.

    found(a, b) takes links; long(f, at, start, level, dense) takes each run that is dense (a sixteenth of it is near a probe), or as short
    as `large`, or cut as far as can be.
    """

    def __init__(self, bits: int, small: int, large: int, found: Callable, long: Callable):
        self.bits, self.ring, self.small, self.large, self.found, self.long = bits, segments(bits), small, large, found, long
        self.last = min(3, len(self.ring) - 1)

    def runs(self, key: np.ndarray, f: np.ndarray, at: np.ndarray, start: np.ndarray, level: int = 0) -> None:
        """Rows sorted by key. Short runs are compared lag by lag; what is neither short nor dense is cut."""
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        size = np.diff(edge)
        few = np.repeat((size > 1) & (size <= self.small), size)
        kf, ff, nf, sf = key[few], f[few], at[few], start[few]
        k = np.arange(len(kf))
        for lag in range(1, self.small):
            k = k[k + lag < len(kf)]
            k = k[kf[k + lag] == kf[k]]  # in order of keys, a lag can match only where the one before did
            if not len(k):
                break
            x, of = ff[k + lag] ^ ff[k], sf[k]
            k_near = np.flatnonzero(np.bitwise_count(x) <= self.bits)
            for s in np.unique(of[k_near]):
                mine = k_near[of[k_near] == s]
                good = k[mine[_near(x[mine], int(s), self.bits, self.ring)]]
                if len(good):
                    self.found(nf[good], nf[good + lag])
        many = size > self.small
        if not many.any():
            return
        run = np.repeat(np.arange(len(size)), size)
        near = [np.bincount(run, np.bitwise_count(f ^ f[edge[:-1] + size * k // PROBES][run]) <= self.bits, len(size)) for k in range(PROBES)]
        dense = np.maximum.reduce(near) >= np.maximum(8, size / 16)
        over = many & ((size <= self.large) | dense | (level >= self.last))
        for r in np.flatnonzero(over):
            a, b = edge[r], edge[r + 1]
            self.long(f[a:b], at[a:b], int(start[a]), level, bool(dense[r]))
        rest = np.flatnonzero((many & ~over)[run])
        if len(rest):
            self.cut(run[rest], f[rest], at[rest], start[rest], level + 1)

    def cut(self, run: np.ndarray, f: np.ndarray, at: np.ndarray, start: np.ndarray, level: int) -> None:
        """Cuts runs by the chain's next segment but for `level` bits, every choice of bits in turn."""
        nxt = (start + level) % len(self.ring)
        shift, width = (np.array([x[k] for x in self.ring], np.uint64)[nxt] for k in (0, 1))
        seg = (f >> shift) & ((np.uint64(1) << width) - np.uint64(1))
        most = max(x[1] for x in self.ring)
        run = np.cumsum(np.diff(run, prepend=run[:1]) != 0)
        choices = list(combinations(range(most), min(level, most)))
        step = max(1, ROWS // max(1, len(f)))
        for k in range(0, len(choices), step):
            some = choices[k : k + step]
            clear = np.array([sum(1 << j for j in out) for out in some], np.uint64)
            key = ((run[None, :] * len(some) + np.arange(len(some))[:, None]).astype(np.uint64) << np.uint64(most) | seg[None, :] & ~clear[:, None]).ravel()
            order = np.argsort(key, kind="stable")
            row = order % len(f)
            self.runs(key[order], f[row], at[row], start[row], level)


def _joining(bits: int, small: int, large: int) -> Callable:
    """search(start, f, rep, run) -> (a, b): each row's link to the smallest place that links reach among these rows."""

    def search(start: np.ndarray, f: np.ndarray, rep: np.ndarray, run: np.ndarray) -> Iterator[pa.RecordBatch]:
        joined = Joined(len(f))

        def long(f: np.ndarray, at: np.ndarray, *_) -> None:
            """Rows out of the commonest component are compared with all, until none is left."""
            done, step = np.zeros(len(f), bool), max(1, (1 << 18) // len(f))
            while True:
                of = joined.settle()[at]
                names, counts = np.unique(of, return_counts=True)
                left = np.flatnonzero((of != names[counts.argmax()]) & ~done)[:step]
                if not len(left):
                    return
                near = (np.bitwise_count(f[left, None] ^ f[None, :]) <= bits) & (of[left, None] != of[None, :])
                done[left] = True
                a, b = np.nonzero(near)
                joined.add(at[left[a]], at[b])

        Ring(bits, small, large, joined.add, long).runs(run, f, np.arange(len(f)), start)
        root = joined.settle()
        own = np.flatnonzero(root != np.arange(len(f)))
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(rep[root[own]]), pa.array(rep[own])], names=["a", "b"])

    return search


def _meeting(bits: int, small: int) -> Callable:
    """search(start, f, rep, run) -> (run, a, b): candidates, of run -1, and the rows (run, rep, fingerprint) of long dense runs.

    Pairs of one zone, which start tells beside the chain, are no candidates here.
    """

    def search(start: np.ndarray, f: np.ndarray, rep: np.ndarray, run: np.ndarray) -> Iterator[pa.RecordBatch]:
        start, zone = start & 15, (start >> 4) - 1
        out: list[tuple[np.ndarray, ...]] = []
        count = [0, TaskContext.get().partitionId() << 40 if TaskContext.get() else 0]

        def found(a: np.ndarray, b: np.ndarray) -> None:
            apart = (zone[a] != zone[b]) | (zone[a] < 0)
            a, b = rep[a[apart]], rep[b[apart]]
            out.append((np.full(len(a), -1), np.minimum(a, b), np.maximum(a, b)))

        def strangers(f: np.ndarray, at: np.ndarray) -> bool:
            """Whether all candidates of a run are found by its rows out of its commonest zone: if that holds half of it, and they are few."""
            of = zone[at]
            most = np.bincount(of + 1, minlength=2)[1:].argmax()
            left = np.flatnonzero(of != most)
            if 2 * len(left) > len(f):
                return False
            pairs, step = [(left[:0], left[:0])], max(1, (1 << 18) // len(f))
            for k in range(0, len(left), step):
                a, b = np.nonzero(np.bitwise_count(f[left[k : k + step], None] ^ f[None, :]) <= bits)
                pairs.append((left[k + a], b))
                if sum(len(b) for _, b in pairs) > 4 * len(f):
                    return False
            a, b = (np.concatenate(x) for x in zip(*pairs))
            found(at[a[a != b]], at[b[a != b]])
            return True

        def long(f: np.ndarray, at: np.ndarray, s: int, level: int, dense: bool) -> None:
            """Rows around a centre are a run of their own. A row beyond that is near only to rows that are beyond, or nearly so: they are searched on.

            The centre is the row nearest to the majority, bit by bit, of the rows near a probe. The chains of one fingerprint share it
            for the most part: it names the run, so that what several chains find around it is one run.
            """
            if strangers(f, at):
                return
            name, apart = search.base + count[0] + count[1], np.zeros(len(f), np.uint8)
            if dense:
                most = max((np.bitwise_count(f ^ f[len(f) * k // PROBES]) <= bits for k in range(PROBES)), key=np.count_nonzero)
                middle = np.packbits(2 * _ones(f[most][:, None])[0] > most.sum(), bitorder="little").view("<u8")
                centre = f[np.lexsort((rep[at], np.bitwise_count(f ^ middle)))[:1]]
                name = int(mix(centre)[0] >> np.uint64(2)) | 1 << 62
                apart = np.bitwise_count(f ^ centre)
                beyond = np.flatnonzero(apart > 2 * bits)
                if len(beyond) > 1:
                    ring.runs(np.zeros(len(beyond), np.int64), f[beyond], at[beyond], np.full(len(beyond), s), level)
                f, at, apart = (x[apart <= 3 * bits] for x in (f, at, apart))
            order = np.lexsort((rep[at], apart))  # the rows in the midst are near to most others
            f, at = f[order], at[order]
            for c in range(min(CENTRES, len(f) - 1)):
                near = c + 1 + np.flatnonzero(np.bitwise_count(f[c + 1 :] ^ f[c]) <= bits)
                found(np.full(len(near), at[c]), at[near])
            out.append((np.full(len(f), name), rep[at], f.view(np.int64)))
            count[0] += 1

        ring = Ring(bits, small, 0, found, long)
        ring.runs(run, f, np.arange(len(f)), start)
        search.base += count[0]
        if out:
            columns = [np.concatenate(x) for x in zip(*out)]
            pairs = columns[0] < 0
            once = np.unique(np.stack([c[pairs] for c in columns[1:]], 1), axis=0)
            columns = [np.concatenate(x) for x in ([np.full(len(once), -1), columns[0][~pairs]], [once[:, 0], columns[1][~pairs]], [once[:, 1], columns[2][~pairs]])]
            for k in range(0, len(columns[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 16)]) for c in columns], names=["run", "a", "b"])

    search.base = 0
    return search


def _searched(reps: DataFrame, bits: int, prints: int, make: Callable, ddl: str) -> DataFrame:
    """What make()() yields over the rows of each key; reps: (sig array<long>, rep long), and maybe (zone int), which is sent with the chain."""
    if not 0 < bits < 16:
        raise ValueError("bits must be between 1 and 15")
    ring = segments(bits)
    domain = len(ring) * prints << max(w for _, w in ring)

    def values(part: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(chain, key, fingerprint) of all rows; a key tells the print, the chain's first segment and its value."""
        sig = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, prints).view(np.uint64)
        for p in range(prints):
            f = np.ascontiguousarray(sig[:, p])
            for k, (shift, width) in enumerate(ring):
                seg = (f >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                yield k, (seg.astype(np.int64) * len(ring) + k) * prints + p, f

    def tally(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(domain, np.int64)
        for part in parts:
            for _, key, _ in values(part):
                n += np.bincount(key, minlength=domain)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["key", "n"])

    zoned = "zone" in reps.columns
    named = reps.where("rep is not null").select("sig", "rep", *["zone"] * zoned)
    heavy = np.zeros(0, np.int64)
    if domain <= DOMAIN:  # so at most as many keys; others have values of 21 bits or more
        counts = named.mapInArrow(tally, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > HEAVY)
        heavy = np.sort(np.array([r["key"] for r in counts.select("key").collect()], np.int64))

    def deal(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(key: np.ndarray, chain: np.ndarray, f: np.ndarray, rep: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(chain), pa.array(f.view(np.int64)), rep], names=["key", "chain", "fp", "rep"])

        for part in parts:
            zone = part.column(2).to_numpy() * 16 + 16 if zoned else np.zeros(len(part), np.int32)
            for k, key, f in values(part):
                finer = np.isin(key, heavy)
                few = np.flatnonzero(~finer)
                if len(few):
                    yield batch(key[few], zone[few] + np.int32(k), f[few], part.column(1).take(pa.array(few)))
                if len(few) < len(key):
                    many = np.flatnonzero(finer)
                    shift, width = ring[(k + 1) % len(ring)]
                    seg = (f[many] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                    rep = part.column(1).take(pa.array(many))
                    for j in range(width):
                        yield batch(((key[many] * 64 + j + 1) << max(w for _, w in ring)) + (seg & ~np.uint64(1 << j)).astype(np.int64) + (1 << 62), zone[many] + np.int32(k), f[many], rep)

    def search(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; they are searched CHUNK or more at a time, whole keys only."""
        over = make()

        def whole(key: np.ndarray, chain: np.ndarray, f: np.ndarray, rep: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.concatenate(([True], key[1:] != key[:-1]))
            several = np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))
            if len(several):
                yield from over(chain[several], f[several].view(np.uint64), rep[several], np.cumsum(new)[several])

        held: list[list[np.ndarray]] = []
        limit = CHUNK
        for part in parts:
            held.append([c.to_numpy(zero_copy_only=False) for c in part.columns])
            if sum(len(h[0]) for h in held) >= limit:
                now = [np.concatenate(c) for c in zip(*held)]
                cut = int(np.searchsorted(now[0], now[0][-1]))
                if cut:
                    yield from whole(*(c[:cut] for c in now))
                held = [[c[cut:] for c in now]]
                limit = max(CHUNK, 2 * len(held[0][0]))
        if held:
            yield from whole(*(np.concatenate(c) for c in zip(*held)))

    dealt = named.mapInArrow(deal, "key long, chain int, fp long, rep long")
    return dealt.repartition("key").sortWithinPartitions("key", "rep", "fp").mapInArrow(search, ddl)


def links(reps: DataFrame, bits: int = 4, prints: int = 1) -> DataFrame:
    """(a long, b long): rows that links join, where some fingerprint is near; as many as join all that links do.

    reps: (sig array<long>, rep long), a row for each signature; links name the rep.
    """
    small, large = SMALL, LARGE
    return _searched(reps, bits, prints, lambda: _joining(bits, small, large), "a long, b long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id long, sig array<long>): the fingerprint of each row, its bits read as a signed long."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = np.array([signature(hashes(t, shingle))[0] for _, t in pairs_of([part])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1), pa.int32()), pa.array(rows))], names=["doc_id", "sig"])

    return only(docs, id_col, text_col).mapInArrow(run, "doc_id long, sig array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """(doc_id, sig, component_id) of each row; component_id is the smallest doc_id that links of fingerprints reach."""
    of = keep(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    reps = keep(of.groupBy("sig").agg(F.min("doc_id").alias("rep")), "reps")
    found = components(links(reps, bits))
    named = reps.join(found, reps["rep"] == found["node"], "left").select("sig", F.coalesce("root", "rep").alias("component_id"))
    return of.join(named, "sig").select("doc_id", "sig", "component_id")


def shingle_sets(docs: DataFrame, shingle: int, prints: int) -> DataFrame:
    """(doc_id, same binary, n long, sig array<long>): of a row's distinct shingles a digest, their number and signature."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [np.unique(hashes(t, shingle)) for _, t in pairs_of([part])]
            sigs = np.array([signature(h, prints) for h in sets], np.uint64).reshape(-1, prints).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * prints, pa.int32()), pa.array(sigs.ravel()))
            keys = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), keys, pa.array([len(h) for h in sets], pa.int64()), lists], names=["doc_id", "same", "n", "sig"])

    return docs.mapInArrow(run, "doc_id long, same binary, n long, sig array<long>")


def whole_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(rep long, hashes array<long>): the distinct shingles of each row."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 256):
                piece = part.slice(at, 256)
                sets = [np.unique(hashes(t, shingle)).view(np.int64) for _, t in pairs_of([piece])]
                offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
                yield pa.RecordBatch.from_arrays([piece.column(0), lists], names=["rep", "hashes"])

    return docs.mapInArrow(run, "rep long, hashes array<long>")


def similar(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of `least` or more."""
    a, b = (sets.select(F.col("rep").alias(x), F.col("hashes").alias(f"of_{x}")) for x in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - both
    return pairs.join(a, "a").join(b, "b").where(both * least.denominator >= union * least.numerator).select("a", "b")


def _together(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first column, by which they are sorted."""
    held: list[pa.RecordBatch] = []
    for part in filter(len, parts):
        key = part.column(0).to_numpy()
        edge = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for a, z in zip(edge, edge[1:]):
            if held and held[0].column(0)[0].as_py() != key[a]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(part.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _signatures(column: pa.ChunkedArray, prints: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, prints)


def _further(rows: DataFrame, done: int, most: int | None, bits: int, prints: int) -> DataFrame:
    """(a, b): in each run (run, rep, fp, root, zone, sig), the near pairs of other roots with the rows out of the commonest root, from `done` to `most`.

    Pairs of one zone are left out.
    """

    def pairs(rep: np.ndarray, f: np.ndarray, root: np.ndarray, zone: np.ndarray, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
        names, counts = np.unique(root, return_counts=True)
        left = np.flatnonzero(root != names[counts.argmax()])[done:most]
        step = max(1, (1 << 18) // len(f))
        for k in range(0, len(left), step):
            some = left[k : k + step]
            a, b = np.nonzero((np.bitwise_count(f[some, None] ^ f[None, :]) <= bits) & (root[some, None] != root[None, :]))
            apart = (zone[some[a]] != zone[b]) | (zone[b] < 0)
            a, b = a[apart], b[apart]
            near = np.zeros(len(a), np.int64)
            for p in range(prints):
                near += np.bitwise_count(sig[some[a], p] ^ sig[b, p])
            good = near <= WHOLE * 64 * prints
            x, y = rep[some[a[good]]], rep[b[good]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _together(parts):
            rep, fp, root, zone = (c.to_numpy() for c in rows.columns[1:5])
            yield from pairs(rep, fp.view(np.uint64), root, zone, _signatures(rows.column(5), prints))

    return rows.select("run", "rep", "fp", "root", "zone", "sig").repartition("run").sortWithinPartitions("run", "rep").mapInArrow(run, "a long, b long").distinct()


def _centres(reps: DataFrame, prints: int) -> tuple[list[int], np.ndarray]:
    """(reps, signatures) of the zones' centres: in turn the row of the sample that is most like others, of those with DENSE others in their radius."""
    rows = reps.count()
    some = reps.where(F.pmod(F.xxhash64("rep"), F.lit(max(rows, 1))) < SAMPLE).select("rep", "sig").collect()
    some.sort(key=lambda r: (r["rep"], r["sig"]))
    sig = np.array([r["sig"] for r in some], np.int64).reshape(-1, prints).view(np.uint64)
    apart = np.zeros((len(sig), len(sig)), np.int16)
    for p in range(prints):
        apart += np.bitwise_count(sig[:, p, None] ^ sig[None, :, p])
    around, like = apart <= RADIUS * 64 * prints, apart <= WHOLE * 64 * prints
    free, chosen = np.ones(len(sig), bool), []
    while len(chosen) < ZONES:
        dense = free & ((around & free).sum(1) >= DENSE)
        if not dense.any():
            break
        chosen.append(int(np.where(dense, (like & free).sum(1), 0).argmax()))
        free &= ~around[chosen[-1]]
    return [some[k]["rep"] for k in chosen], sig[chosen]


def _zoned(reps: DataFrame, centres: np.ndarray, prints: int) -> DataFrame:
    """reps (same, rep, n, sig) with the zone (int) of the nearest centre in reach, or -1."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sig = part.column(3).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, prints)
            least, zone = np.full(len(sig), int(RADIUS * 64 * prints) + 1), np.full(len(sig), -1, np.int32)
            for k, centre in enumerate(centres):
                apart = np.bitwise_count(sig ^ centre).sum(1, dtype=np.int64)
                nearer = apart < least
                least[nearer], zone[nearer] = apart[nearer], k
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(zone)], names=["same", "rep", "n", "sig", "zone"])

    return reps.select("same", "rep", "n", "sig").mapInArrow(run, "same binary, rep long, n long, sig array<long>, zone int")


def _inside(zoned: DataFrame, whole: DataFrame, centres: list[int], bits: int, prints: int, least: Fraction) -> DataFrame:
    """(a, b): links that join all rows of a zone that near copies join.

    A zone's rows are dealt into blocks, and each two blocks, and each alone, meet in a group with the centre. Rows that are
    near copies of the centre are joined from the start; each other row is compared with all rows of the other block.
    """
    counts = zoned.where("zone >= 0").groupBy("zone").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()
    sizes = {r["zone"]: max(min(BLOCKS, -(-r["rows"] // BLOCK)), -(-r["n"] // HASHES)) for r in counts}
    blocks = F.get(F.array(*[F.lit(sizes.get(k, 1)) for k in range(len(centres))]), "zone")
    rows = zoned.where("zone >= 0").join(whole, "rep").select("rep", "sig", "hashes", "zone", (blocks - 1).alias("last"))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("rep"), F.col("last") + 1).cast("int"))
    every = rows.withColumn("other", F.explode(F.expr("sequence(0, last)"))).withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
    middle = rows.where(F.col("rep") == F.get(F.array(*map(F.lit, centres)), "zone")).withColumn("side", F.lit(-1))
    middle = middle.withColumn("i", F.explode(F.expr("sequence(0, last)"))).withColumn("j", F.explode(F.expr("sequence(i, last)")))
    key = F.col("zone").cast("long") * (1 << 40) + F.col("i").cast("long") * (1 << 20) + F.col("j")
    met = [x.select(key.alias("key"), "side", "rep", "sig", "hashes") for x in (every, middle)]

    def solve(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key, side, rep = rows.column(0)[0].as_py(), rows.column(1).to_numpy(), rows.column(2).to_numpy()
        alone = (key >> 20) % (1 << 20) == key % (1 << 20)
        sig, sets = _signatures(rows.column(3), prints), rows.column(4).combine_chunks()
        size = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        edge = np.concatenate(([0], np.cumsum(size)))
        names, code = np.unique(sets.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        joined, mark, todo = Joined(len(rep)), np.zeros(len(names), bool), side >= 0

        def links(x: int, among: np.ndarray) -> np.ndarray:
            """Of each other root a row among these that is a near copy of x."""
            root = joined.settle()
            near = np.flatnonzero(among & (root != root[x]))
            near = near[(np.bitwise_count(sig[near] ^ sig[x]) <= bits).any(1)]
            if len(near):
                own = code[edge[x] : edge[x + 1]]
                mark[own] = True
                sums = np.concatenate(([0], np.cumsum(mark[code])))
                mark[own] = False
                both = sums[edge[near + 1]] - sums[edge[near]]
                near = near[both * least.denominator >= (size[near] + size[x] - both) * least.numerator]
                near = near[np.unique(root[near], return_index=True)[1]]
                joined.add(np.full(len(near), x), near)
            return near

        y = links(0, todo)  # the centre comes first
        if alone:  # else other groups say the same
            yield rep[np.zeros(len(y), np.int64)], rep[y]
        for x in np.flatnonzero(todo & (joined.settle() != joined.root[0])).tolist():
            root = joined.settle()
            if root[x] != root[0]:  # those that are joined to it by now are met by the others
                y = links(x, todo if alone else todo & (side != side[x]))
                todo[x] = False
                yield rep[np.full(len(y), x)], rep[y]

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _together(parts):
            a, b = (np.concatenate(c) for c in zip(*[(np.zeros(0, np.int64),) * 2, *solve(rows)]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = met[0].union(met[1]).repartition("key").sortWithinPartitions("key", "side", "rep")
    return dealt.mapInArrow(run, "a long, b long").where("a <> b")


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, bits: int = 7, prints: int = 16, least: str = "0.8"
) -> DataFrame:
    """(doc_id, component_id) of each row of a doc_id; component_id is the smallest doc_id that near copies reach.

    Candidates are texts of which one of `prints` fingerprints differs in at most `bits` bits; they are
    near copies if their distinct shingles have a Jaccard similarity of `least` or more. Those of one
    zone are decided inside it; others as the ring finds them. In a long dense run rows are compared with its first CENTRES rows; then, in the ROUNDS, with some and at last with
    all rows that are out of the run's commonest component, and only where components differ: so n
    copies of each other give n links or so, and no pair is left out but those that are joined already.
    """
    bound = Fraction(least)
    texts = only(docs, id_col, text_col).where("doc_id is not null")
    of = keep(shingle_sets(texts, shingle, prints), "sets")
    plain = keep(of.groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "reps")
    centres, of_centres = _centres(plain, prints)
    reps = keep(_zoned(plain, of_centres, prints), "zoned")
    release(plain)
    small = max(2, SMALL // 2)  # each candidate costs a look at two whole sets
    met = keep(_searched(reps, bits, prints, lambda: _meeting(bits, small), "run long, a long, b long"), "met")
    pairs = met.where("run < 0 and a <> b").select("a", "b").distinct()
    dense = keep(met.where("run >= 0").select("run", F.col("a").alias("rep"), F.col("b").alias("fp")).distinct(), "dense")
    named = met.select(F.col("a").alias("doc_id")).union(met.where("run < 0").select("b")).union(reps.where("zone >= 0").select("rep")).distinct()
    # Of rows that repeat a doc_id one is taken, the same for all pairs.
    whole = keep(whole_sets(texts.join(named, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), shingle), "whole")
    found = similar(pairs, whole, bound)
    if centres:
        found = found.union(_inside(reps, whole, centres, bits, prints, bound))
    found = keep(found, "links")
    labels = keep(components(found), "labels")
    every = [found]
    done, left = 0, None
    for most in ROUNDS:
        if left is None:
            rows = dense.join(labels, dense["rep"] == labels["node"], "left").withColumn("root", F.coalesce("root", "rep"))
            open_ = rows.groupBy("run").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
            rows = rows.join(open_.select("run"), "run").select("run", "rep", "fp", "root")
            left = keep(rows.join(reps.select("rep", "zone", "sig"), "rep").select("run", "rep", "fp", "root", "zone", "sig"), "left")
        if left.isEmpty():
            break
        found = keep(similar(_further(left, done, most, bits, prints), whole, bound), "links")
        every.append(found)
        if found.isEmpty():  # the same rows are left, and those after `most` come next
            done = most
            continue
        before, labels = labels, keep(components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found)), "labels")
        release(left, before)
        done, left = 0, None
    release(left)
    named = reps.join(labels, reps["rep"] == labels["node"], "left").select("same", F.coalesce("root", "rep").alias("component_id"))
    release(met, dense, whole, *every)
    return of.select("doc_id", "same").join(named, "same").select("doc_id", "component_id")


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, bits: int = 7, prints: int = 16, least: str = "0.8"
) -> DataFrame:
    """docs, all columns, without the near copies: of each component the row of the smallest doc_id stays.

    Rows of one doc_id are one document: all go or stay, but of those with one text one stays, whatever
    else they hold. Rows of a null doc_id can't be told apart and stay.
    """
    of = near_copies(docs, id_col, text_col, shingle, bits, prints, least)
    rows = of.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("component_id").alias("root"))
    lost = rows.where("doc_id <> root").select(F.col("doc_id").alias("__lost"))
    kept = docs.join(lost, docs[id_col] == lost["__lost"], "left_anti")
    twice = keep(rows.where("doc_id = root and rows > 1").select(F.col("doc_id").alias("__twice")), "twice")
    if twice.isEmpty():
        return kept
    some = kept.join(twice, docs[id_col] == twice["__twice"], "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(twice, docs[id_col] == twice["__twice"], "left_anti").unionByName(some)
