"""Repeated passages by prefix-partitioned suffix trees.

A passage is a run of `window` words. Every start of one is a suffix. Suffixes are split into groups
by prefixes of variable length: first by a run of PREFIX words at an anchor, the least-hashed such
run within the window, which identical windows share, so that neighbouring suffixes with one anchor
travel as one row; a group of more than GROUP suffixes is split by its suffixes' first MIDDLE words
as well, and what is still too large by all words of the window, where a group is a single node and
is read as a stream. So a group that is held fits in memory, whatever is frequent.

In a group the suffixes are sorted by prefix doubling, over symbols that are the paths of `window`
words, and neighbours in that order get their longest common prefix: the subtree below the depth of
the window, as intervals. An internal node of that depth or deeper is a repeat. Its earliest leaf
stays, the others are flagged, and runs of flagged starts are a document's maximal repeats.

Before anything is shuffled, each task takes the same nodes over a buffer of its own documents and
keeps one leaf of each. So a passage that half of all documents share gives each group a row for
each buffer, not for each document. Prefixes and paths are compared by 64 bits of hash each.

Defined results: a null text has no words; a null doc_id counts as smaller than any other; rows of
one doc_id are one document, in which only earlier starts count, and rows that repeat are each cut;
texts are read whole, however long; other columns may have any names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import keep, mix, pairs_of, short_batches

WINDOW = 20  # words
PREFIX = 5  # words; window - prefix + 1 candidates for an anchor
MIDDLE = 10  # words of the longer prefix
BUFFER = 400_000  # words that a task compares at once
GROUP = 150_000  # suffixes of a group that a task holds
SMALLEST = -(1 << 63)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SUFFIX = np.dtype([("path", "<u8"), ("more", "<u2")])  # the window's hash, and digits of the longer prefix's
LEAVES = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("doc", pa.int64()), ("mark", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("paths", pa.binary())])
LEAVES_DDL = "kind int, key long, doc long, mark long, start long, stop long, paths binary"
FLAG, SHORT, LONGER, WHOLE = 0, 1, 2, 3  # of a row: starts [start, stop) repeat; suffixes by the short prefix, by the longer one, by the window


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()  # bytes: the six ASCII spaces only


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _paths(w: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words, from prefix sums of a polynomial modulo 2^64."""
    up = _powers(len(w), _BASE)
    back = _powers(len(w), np.uint64(pow(int(_BASE), -1, 1 << 64)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * up)])
    return mix((sums[size:] - sums[:-size]) * back[: len(w) - size + 1])


def _least(v: np.ndarray, size: int) -> np.ndarray:
    """The least of each `size` neighbours, by doubling."""
    width = 1
    while 2 * width <= size:
        v, width = np.minimum(v[:-width], v[width:]), 2 * width
    rest = size - width
    return np.minimum(v[:-rest], v[rest:]) if rest else v


def _heads(new: np.ndarray) -> np.ndarray:
    """The place of the latest True at or before each."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _later(path: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which leaves share their node with an earlier one, of one buffer."""
    out = np.zeros(len(path), bool)
    order = np.argsort(path, kind="stable")
    p = path[order]
    same = p[1:] == p[:-1]
    order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    if len(order):
        order = order[np.lexsort((start[order], doc[order], path[order]))]
        p, d, s = path[order], doc[order], start[order]
        head = _heads(np.concatenate([[True], p[1:] != p[:-1]]))
        out[order] = (d != d[head]) | (s != s[head])
    return out


def _dense(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Ranks of rows by their columns, equal rows alike; order sorts them."""
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def suffix_order(symbol: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): suffixes of runs of symbols, sorted, and how many symbols each shares with the one before it.

    joined tells where the suffix of the next place continues this one, in the same run.
    """
    n = len(symbol)
    ranks, step = [_dense(np.argsort(symbol, kind="stable"), symbol)], 1
    reach = np.zeros(n, np.int64)  # how many joined places follow
    for k in np.flatnonzero(joined)[::-1].tolist():
        reach[k] = reach[k + 1] + 1
    while step <= reach.max(initial=0):
        at = np.where(reach >= step, ranks[-1][np.minimum(np.arange(n) + step, n - 1)], -1)
        ranks.append(_dense(np.lexsort((at, ranks[-1])), ranks[-1], at))
        step *= 2
    order = np.argsort(ranks[-1], kind="stable")
    common = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    alive = np.ones(len(a), bool)
    for k in range(len(ranks) - 1, -1, -1):
        size = 1 << k
        inside = alive & (reach[a] + 1 >= size) & (reach[b] + 1 >= size)
        same = inside & (ranks[k][a] == ranks[k][b])
        common[1:][same] += size
        ends = same & ((reach[a] < size) | (reach[b] < size))
        alive &= ~ends
        move = same & ~ends
        a[move] += size
        b[move] += size
    return order, common


def subtree(key: np.ndarray, path: np.ndarray, doc: np.ndarray, start: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which leaves of a group's suffixes share a node of the window's depth or deeper with an earlier one.

    row tells the runs: neighbours of one row are neighbouring suffixes.
    """
    out = np.zeros(len(path), bool)
    symbol = _dense(np.lexsort((path, key)), key, path)
    some = np.flatnonzero((np.bincount(symbol) > 1)[symbol])  # the others are leaves below no such node
    if not len(some):
        return out
    joined = np.concatenate([(np.diff(some) == 1) & (row[some][1:] == row[some][:-1]), [False]])
    order, common = suffix_order(symbol[some], joined)
    node = np.cumsum(common == 0)  # intervals of suffixes that have the window in common
    leaf = some[order]
    by = np.lexsort((start[leaf], doc[leaf], node))
    leaf, node = leaf[by], node[by]
    head = _heads(np.concatenate([[True], node[1:] != node[:-1]]))
    out[leaf] = (doc[leaf] != doc[leaf][head]) | (start[leaf] != start[leaf][head])
    return out


def _flags(doc: np.ndarray, mark: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Rows of runs of starts, from starts that repeat."""
    order = np.lexsort((start, mark, doc))
    d, m, s = doc[order], mark[order], start[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (m[1:] != m[:-1]) | (s[1:] != s[:-1] + 1)])
    at = np.flatnonzero(new)
    stop = s[np.concatenate([at[1:], [len(s)]]) - 1] + 1
    n = len(at)
    columns = [np.zeros(n, np.int32), d[at] ^ m[at], d[at], m[at], s[at], stop]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(n, pa.binary())], schema=LEAVES)


def _local(held: list[tuple[int, int, np.ndarray]], window: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """Of one buffer's documents (doc, mark, word hashes): flags, and one leaf of each node, as rows of suffixes."""
    if not held:
        return
    w = np.concatenate([x for _, _, x in held])
    if len(w) < window:
        return
    sizes = np.array([len(x) for _, _, x in held])
    first = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(held)), sizes)
    docs, marks = (np.array([x[k] for x in held], np.int64) for k in (0, 1))
    start = np.arange(len(w)) - first[of]
    whole = np.flatnonzero(start[: len(w) - window + 1] + window <= sizes[of[: len(w) - window + 1]])
    if not len(whole):
        return
    path = _paths(w, window)[whole]
    key = _least(_paths(w, prefix), window - prefix + 1)[whole]
    suffix = np.empty(len(path), _SUFFIX)
    suffix["path"], suffix["more"] = path, (_paths(w, min(MIDDLE, window))[whole] >> np.uint64(48)).astype(np.uint16)
    of, start = of[whole], start[whole]
    doc = docs[of]
    later = _later(path, doc, start)
    if later.any():
        yield _flags(doc[later], marks[of[later]], start[later])
    at = np.flatnonzero(~later)
    suffix, key, of, start = suffix[at], key[at].view(np.int64), of[at], start[at]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1)])
    run = np.flatnonzero(new)
    ends = np.concatenate([run, [len(key)]])
    for k in range(0, len(run), 8192):
        r, e = run[k : k + 8192], ends[k : k + 8193]
        columns = [key[r], docs[of[r]], marks[of[r]], start[r], start[r] + np.diff(e)]
        yield _rows(SHORT, columns, suffix[e[0] : e[-1]], e - e[0])


def _rows(kind: int, columns: list[np.ndarray], suffixes: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """Rows of one kind; row k holds the suffixes from ends[k] to ends[k + 1]."""
    n = len(ends) - 1
    offsets, data = (ends * suffixes.dtype.itemsize).astype(np.int32), np.ascontiguousarray(suffixes).tobytes()
    paths = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(pa.array(c.astype(np.int64)) for c in columns), paths], schema=LEAVES)


def _explode(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """(key, doc, mark, start, row, path, more) of each suffix of rows of suffixes."""
    key, doc, mark, start, stop = (rows.column(n).to_numpy() for n in ("key", "doc", "mark", "start", "stop"))
    n = stop - start
    first = np.repeat(np.cumsum(n) - n, n)
    suffix = np.frombuffer(b"".join(rows.column("paths").to_pylist()), _SUFFIX)
    return np.repeat(key, n), np.repeat(doc, n), np.repeat(mark, n), np.repeat(start, n) + np.arange(n.sum()) - first, np.repeat(np.arange(len(n)), n), suffix["path"].copy(), suffix["more"].copy()


def _subtrees(parts: Iterable[pa.RecordBatch], group: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key. Flags pass; groups of suffixes give flags, or go on by a longer prefix if they are too large."""
    most = group or GROUP

    def longer(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """By the longer prefix, or if that was used by the window, whose rows have their group in place of `stop`."""
        short = rows.column("kind")[0].as_py() == SHORT
        key, doc, mark, start, _, path, more = _explode(rows)
        suffix = np.empty(len(path), _SUFFIX)
        suffix["path"], suffix["more"] = path, more
        by = mix(key.view(np.uint64) ^ mix(more.astype(np.uint64) + _BASE)).view(np.int64) if short else path.view(np.int64)
        columns = [by, doc, mark, start, start + 1 if short else key]
        for k in range(0, len(key), 8192):
            size = min(8192, len(key) - k)
            yield _rows(LONGER if short else WHOLE, [c[k : k + size] for c in columns], suffix[k : k + size], np.arange(size + 1))

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key = rows.column("key").to_numpy()
        same = key[1:] == key[:-1]
        some = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        if some.any():
            key, doc, mark, start, row, path, _ = _explode(rows.filter(pa.array(some)))
            later = subtree(key, path, doc, start, row)
            if later.any():
                yield _flags(doc[later], mark[later], start[later])

    def size(t: pa.Table) -> int:
        return int(t.column("stop").to_numpy().sum() - t.column("start").to_numpy().sum())

    held: list[pa.Table] = []
    large, count = None, 0  # the key of a group that goes on; suffixes that are held
    for part in parts:
        kinds = part.column(0).to_numpy()
        if (kinds == FLAG).any():
            yield part.filter(pa.array(kinds == FLAG))
            part = part.filter(pa.array(kinds != FLAG))
        for k in range(0, part.num_rows, 4096):
            now = pa.Table.from_batches([part.slice(k, 4096)])
            key = now.column("key").to_numpy()
            if large is not None:
                more = int(np.searchsorted(key, large, "right"))
                if more:
                    yield from longer(now.slice(0, more))
                if more == len(key):
                    continue
                now, key, large = now.slice(more), key[more:], None
            cut = int(np.searchsorted(key, key[-1]))
            if (cut or held and held[-1].column("key")[-1].as_py() != key[-1]) and count + size(now) > most // 2:
                yield from found(pa.concat_tables([*held, now.slice(0, cut)]))
                held, now = [], now.slice(cut)
                count = 0
            held.append(now)
            count += size(now)
            if count > most:
                rows = pa.concat_tables(held)
                last = rows.column("key")[-1].as_py()
                other = int(np.searchsorted(rows.column("key").to_numpy(), last))
                if other:
                    yield from found(rows.slice(0, other))
                held = [rows.slice(other)]
                count = size(held[0])
                if count > most:
                    large = last
                    yield from longer(held[0])
                    held, count = [], 0
    if held:
        yield from found(pa.concat_tables(held))


def _whole(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of single suffixes come sorted by path, group, document and start: all but a node's first are flagged."""
    node = None
    for part in parts:
        flagged = []
        for path, doc, mark, start, key in zip(*(part.column(n).to_pylist() for n in ("key", "doc", "mark", "start", "stop"))):
            if node is None or node[0] != (path, key):
                node = (path, key), (doc, start)
            elif (doc, start) != node[1]:
                flagged.append((doc, mark, start))
        if flagged:
            yield _flags(*(np.array(x, np.int64) for x in zip(*flagged)))


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs[text_col].cast("string")
    doc = docs[id_col].cast("long")
    return docs.select(F.coalesce(doc, F.lit(SMALLEST)).alias("doc"), text.alias("text"), F.xxhash64(text).alias("mark"), doc.alias("doc_id"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """(doc, mark, start, stop): runs of starts whose window also starts earlier; a maximal repeat may come in parts.

    doc is the doc_id (SMALLEST for null), mark tells rows of one doc_id with other texts apart.
    """
    if not 0 < prefix <= window:
        raise ValueError("the prefix must be within the window")
    short_batches(docs.sparkSession)
    buffer, group = BUFFER, GROUP

    def local(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for part in parts:
            marks = iter(part.column(2).to_pylist())
            for doc, text in pairs_of([part]):
                words, mark = words_of(text), next(marks)
                if len(words) >= window:
                    held.append((doc, mark, np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))))
                    count += len(words)
                if count >= buffer:
                    yield from _local(held, window, prefix)
                    held, count = [], 0
        yield from _local(held, window, prefix)

    def trees(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _subtrees(parts, group)

    leaves = _marked(docs, id_col, text_col).select("doc", "text", "mark").mapInArrow(local, LEAVES_DDL)
    found = keep(leaves.repartition("key").sortWithinPartitions("key").mapInArrow(trees, LEAVES_DDL), "leaves")
    middle = found.where(F.col("kind") == LONGER).repartition("key").sortWithinPartitions("key").mapInArrow(trees, LEAVES_DDL)
    middle = keep(middle, "longer")
    whole = middle.where(F.col("kind") == WHOLE).repartition("key", "stop").sortWithinPartitions("key", "stop", "doc", "start").mapInArrow(_whole, LEAVES_DDL)
    flags = found.where(F.col("kind") == FLAG).union(middle.where(F.col("kind") == FLAG)).union(whole)
    return flags.select("doc", "mark", "start", "stop")


def kept_words(words: list[bytes], runs: Iterable[tuple[int, int]], window: int = WINDOW) -> list[bytes]:
    """The words that no window starting in one of the runs [start, stop) covers."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, stop in runs:
        edge[start] += 1
        edge[min(len(words), stop - 1 + window)] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def merged(runs: list[tuple[int, int]], start: int, stop: int) -> None:
    """Adds a run to runs, which come in the order of their starts; copies of a row give the same runs again."""
    if runs and start <= runs[-1][1]:
        runs[-1] = runs[-1][0], max(stop, runs[-1][1])
    else:
        runs.append((start, stop))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): each row's words without those in passages that occur earlier.

    Texts and runs are dealt together, each document's runs first, and read as a stream.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def cut(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            of, runs = None, []
            for part in parts:
                for k in range(0, part.num_rows, 256):
                    for doc, mark, start, stop, text, i in zip(*(c.to_pylist() for c in part.slice(k, 256).columns)):
                        if of != (doc, mark):
                            of, runs = (doc, mark), []
                        if start >= 0:
                            merged(runs, start, stop)
                            continue
                        words = words_of(text or "")
                        kept = kept_words(words, runs, window) if runs else words
                        yield i, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace")

        held, size = [], 0
        for row in rows():
            held.append(row)
            size += len(row[3])
            if len(held) >= 1024 or size >= 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    texts = _marked(docs, id_col, text_col).select("doc", "mark", F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("stop"), "text", "doc_id")
    runs = repeats(docs, id_col, text_col, window, prefix).select("doc", "mark", "start", "stop", F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("doc_id"))
    # Runs are of starts from 0 on; a text comes behind its runs.
    both = runs.union(texts).repartition("doc", "mark").sortWithinPartitions("doc", "mark", F.col("start") < 0, "start")
    return both.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")
