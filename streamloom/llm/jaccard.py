"""Exact similarity join of word-shingle sets, with the classes that its links make.

Two documents link when the Jaccard similarity of their sets of five-word shingles is at least 0.75.

1. Documents with equal sets are one node: the node id is a 64-bit digest of the set. A set's shingles are 64-bit hashes.
2. Only a shingle that two different sets hold can be in an intersection, so one shuffle by shingle finds these; the
   rest is never moved again. A set that has fewer shared shingles than 0.75 of its size has no link and is done.
   On usual text this leaves little more than the true groups.
3. In the sets that are left, shingles are ordered from rare to frequent. Linked sets share one of the first
   (size - ceil(0.75 size) + 1), unshared ones counted first. Neighbours by size in such an index list are joined to
   candidate groups, a superset of the classes, by repeated contraction of the graph.
4. Within a group the join is exact, by set relations: index lists are read from the nearest size backwards, in blocks by the
   class that their sets have by then; blocks out of the size window or at hopeless positions are skipped, and
   once a set is found to be similar to another one its answer is derived from that one's: all sets of that class are
   answered already and none of their list entries is looked at again. Index lists of frequent shingles are bit columns:
   the sets in them that are not answered are bounded all at once, and only those that may link are compared.
5. A group over GROUP_SETS sets is dealt out in chunks: each is resolved by itself, then one leader per class, then only
   the sets outside a group's main class are compared with every chunk. No pair of classes goes unchecked.
6. With links=True each document's links are counted: overlaps of all sets of a class are added up from its bit columns and index lists.
   Classes over LINK_SETS sets or LINK_BYTES are dealt out by pairs of chunks. This takes the square of a class's sets.

Scale: shingles move as packed arrays, 8 bytes each in few parts and up to 15 in many, in one shuffle, to parts of PART_BYTES of input; from MANY_PARTS parts on
of up to LARGE_PART_BYTES, so a part has a bound at any size of the input. A shingle that HOT_LEAST different sets of a batch
hold is marked there as shared, for certain, and its occurrences skip the shuffle by shingle; of others a batch brings
fewer. Entries of one index list with equal sizes are chained within a batch and one goes on. Copies of one set are
dropped within a map task and their rows are spread by row, not by set. Nothing is collected or broadcast.

Defined results: null, empty and blank texts have an empty set, link with nothing and are their own component. Texts of
one to four words have their whole sequence as the only shingle. Repeated rows are copies. A null doc_id takes part; its
component is the smallest id that is not null, else null. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, hold, known_size, scan_parts, utf8

WORDS = 5
#: Similarity threshold as a fraction (fixed value of the contract).
NUM, DEN = 3, 4
PART_BYTES, LARGE_PART_BYTES, MANY_PARTS = 8 << 20, 64 << 20, 1 << 15
HOT_LEAST = 16
GROUP_SETS = 50_000
GROUP_BYTES = 64 << 20
LINK_SETS, LINK_BYTES = 2_000, 16 << 20
#: Shingles that so many sets of a group and this part of them hold are bit columns, which then take no more than the sets.
FREQUENT_LEAST, FREQUENT_SHARE = 16, 64
HOT = 1 << 31
MEMO = 250_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_LOW32, _16, _32 = np.uint64((1 << 32) - 1), np.uint64((1 << 16) - 1), np.uint64(32)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def _forget() -> None:
    _hashes.clear()


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a UTF-8 text, A-Z lower-cased."""
    w = text.lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w))
    k = min(words, len(w))
    m = len(w) - k + 1
    x = h[:m] + np.uint64(k)
    for i in range(1, k):
        x *= _MULTIPLIER
        x ^= x >> np.uint64(31)
        x += h[i : i + m]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def part_of(tokens: np.ndarray, parts: int) -> np.ndarray:
    """Part of each hash: its upper half's place in parts equal intervals."""
    return ((tokens >> _32) * np.uint64(parts) >> _32).astype(np.int32)


def _interval(part, parts: int) -> np.ndarray:
    """Where the interval of a part begins."""
    p = np.asarray(part).astype(np.uint64) << _32
    return (p + np.uint64(parts - 1)) // np.uint64(parts)


def within(tokens: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    """48 bits of each hash that tell it within its part: the place in the interval (modulo 65536, so all of it from 65536 parts on) and the lower half."""
    return (((tokens >> _32) - _interval(part, parts)) & _16) << _32 | tokens & _LOW32


def whole(low: np.ndarray, part, parts: int) -> np.ndarray:
    """A hash that is told over all parts."""
    return (_interval(part, parts) + (low >> _32)) << _32 | low & _LOW32


def set_id(tokens: np.ndarray) -> int:
    import xxhash

    return int.from_bytes(xxhash.xxh3_64_digest(tokens.tobytes()), "little", signed=True)


def least_overlap(n, m=None):
    """Least intersection of linked sets of sizes n and m; without m, with any partner."""
    if m is None:
        return -(-NUM * n // DEN)
    return -(-NUM * (n + m) // (NUM + DEN))


PACKED = "kind int, key int, payload binary"
_PACKED = pa.schema([("kind", pa.int32()), ("key", pa.int32()), ("payload", pa.binary())])
_BYTES = {"u8": np.dtype("<u8"), "i8": np.dtype("<i8"), "u4": np.dtype("<u4"), "u2": np.dtype("<u2"), "u1": np.dtype("u1")}


def pack(*arrays: np.ndarray) -> bytes:
    head = struct.pack(f"<{len(arrays)}I", *(len(a) for a in arrays))
    return head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(data: bytes, kinds: str) -> list[np.ndarray]:
    kinds_ = kinds.split()
    sizes = struct.unpack_from(f"<{len(kinds_)}I", data)
    at, out = 4 * len(kinds_), []
    for kind, n in zip(kinds_, sizes, strict=True):
        out.append(np.frombuffer(data, _BYTES[kind], n, at))
        at += n * _BYTES[kind].itemsize
    return out


#: sids, tokens of each, tokens' low 32 and next 16 bits; sid, token, frequency; sid, size; doc_id, is null, sid, size
PART, OCCURRENCE, SIZE, DOC = "i8 u1 u4 u2", "i8 u8 u4", "i8 u4", "i8 u1 i8 u4"


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kind, key, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.int32()), pa.array(payload, pa.binary())], schema=_PACKED)


def _emit(parts: int, words: int, hot_least: int):
    def run(batches):
        hold("shingles", _forget)
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column("doc_id")
            null = np.asarray(ids.is_null().to_pylist(), bool)
            doc = ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
            sids, sizes, kept = np.zeros(len(doc), "<i8"), np.zeros(len(doc), "<u4"), []
            for i, text in enumerate(utf8(batch.column("text"))):
                t = shingles(text, words)
                if len(t):
                    sids[i], sizes[i] = set_id(t), len(t)
                    if int(sids[i]) not in seen:
                        if len(seen) > 5_000_000:
                            seen.clear()
                        seen.add(int(sids[i]))
                        kept.append((i, t))
            rows = []
            if len(doc):
                deal = np.arange(len(doc)) % max(1, min(parts, len(doc) // 512))
                offset = int(doc[0]) % parts if len(doc) else 0
                for k in np.unique(deal):
                    s = deal == k
                    rows.append((2, int((k + offset) % parts), pack(doc[s], null[s].astype("u1"), sids[s], sizes[s])))
            if kept:
                # A set's size goes once to its bucket and not with its shingles, of which a part has few.
                own = np.asarray([i for i, _ in kept])
                to = (sids[own].astype(np.uint64) % np.uint64(parts)).astype(np.int32)
                own, to = own[order := np.argsort(to, kind="stable")], to[order]
                rows += [(5, int(to[a]), pack(sids[own[a:b]], sizes[own[a:b]])) for a, b in _segments(to)]
                who = np.repeat(np.asarray([i for i, _ in kept]), [len(t) for _, t in kept])
                tokens = np.concatenate([t for _, t in kept])
                part = part_of(tokens, parts)
                low = within(tokens, part, parts)
                order = np.argsort(part.astype("u2" if parts <= 1 << 16 else "u4"), kind="stable")
                who, part, low = who[order], part[order], low[order]
                straight = []
                for a, b in _segments(part):
                    p, w, t = int(part[a]), who[a:b], low[a:b]
                    if len(kept) >= hot_least:
                        values, inverse, counts = np.unique(t, return_inverse=True, return_counts=True)
                        hot = counts >= hot_least
                        if hot.any():
                            # Shared for certain: the occurrences go straight to their sets, with a marker by shingle.
                            h = hot[inverse]
                            rows.append((3, p, values[hot].astype("<u8").tobytes()))
                            straight.append((w[h], whole(t[h], p, parts)))
                            w, t = w[~h], t[~h]
                    if len(w):
                        own, n = _runs(w)
                        rows.append((0, p, pack(sids[own], n.astype("u1"), (t & np.uint64(0xFFFFFFFF)).astype("<u4"), (t >> np.uint64(32)).astype("<u2"))))
                if straight:
                    w, t = (np.concatenate(x) for x in zip(*straight, strict=True))
                    to = (sids[w].astype(np.uint64) % np.uint64(parts)).astype(np.int32)
                    order = np.argsort(to, kind="stable")
                    w, t, to = w[order], t[order], to[order]
                    rows += [(1, int(to[a]), pack(sids[w[a:b]], t[a:b], np.full(b - a, HOT, "<u4"))) for a, b in _segments(to)]
                    del straight, w, t, to, order
                del who, tokens, part, low
            yield _rows(rows)

    return run


def _segments(x: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of runs of equal values."""
    if not len(x):
        return []
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])).tolist()
    return list(zip(at, [*at[1:], len(x)], strict=True))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of runs; runs over 255 are cut."""
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    n = np.diff(np.concatenate([at, [len(x)]]))
    if n.max(initial=0) > 255:
        cutpoints = np.unique(np.concatenate([at, *[np.arange(a, a + m, 255) for a, m in zip(at, n, strict=True) if m > 255]]))
        at, n = cutpoints, np.diff(np.concatenate([cutpoints, [len(x)]]))
    return x[at], n


def _shared(parts: int):
    """By shingle part: the occurrences of shingles that two sets hold, packed by set bucket; all else passes."""

    def run(key, table):
        hold("sets")
        kind, part = key[0].as_py(), key[1].as_py()
        if kind != 0:
            return table.select(["kind", "key", "payload"])
        sids, tokens, marked = [], [], []
        for k, payload in zip(table.column("sub").to_pylist(), table.column("payload").to_pylist(), strict=True):
            if k == 3:
                marked.append(np.frombuffer(payload, "<u8"))
                continue
            s, runs, lo, hi = unpack(payload, PART)
            sids.append(np.repeat(s, runs))
            tokens.append(lo.astype("<u8") | hi.astype("<u8") << np.uint64(32))
        if not sids:
            return pa.Table.from_batches([_rows([])])
        sid, token = np.concatenate(sids), np.concatenate(tokens)
        del sids, tokens
        hot = np.unique(np.concatenate(marked)) if marked else np.empty(0, "<u8")
        order = np.argsort(token, kind="stable")
        token = token[order]
        same = token[1:] == token[:-1]
        several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        if len(hot):
            at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
            several |= hot[at] == token
        token, order = token[several], order[several]
        sid = sid[order]
        order = np.lexsort((sid, token))
        token, sid = token[order], sid[order]
        if not len(token):
            return pa.Table.from_batches([_rows([])])
        first = np.concatenate([[True], (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])])  # the same set of another batch
        token, sid = token[first], sid[first]
        _, inverse, counts = np.unique(token, return_inverse=True, return_counts=True)
        df = counts[inverse].astype("<u4")
        if len(hot):
            at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
            df[hot[at] == token] = HOT
        keep = df > 1
        token, sid, df = whole(token[keep], part, parts), sid[keep], df[keep]
        to = (sid.astype(np.uint64) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        token, sid, df, to = token[order], sid[order], df[order], to[order]
        rows = [(1, int(to[a]), pack(sid[a:b], token[a:b], df[a:b])) for a, b in _segments(to)]
        return pa.Table.from_batches([_rows(rows)])

    return run


BASE = "is_doc boolean, doc_id long, sid long, n int, tokens binary"
_BASE = pa.schema([("is_doc", pa.bool_()), ("doc_id", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary())])


def _gather(table):
    """By set bucket: sets with enough shared shingles, rare ones first; and the rows of documents."""
    docs, found, sized = [], [], []
    for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True):
        if kind == 2:
            doc, null, sid, n = unpack(payload, DOC)
            docs.append(pa.RecordBatch.from_arrays([pa.array(np.ones(len(doc), bool)), pa.array(doc, mask=null.astype(bool)), pa.array(sid), pa.array(n.astype("i4")), pa.nulls(len(doc), pa.binary())], schema=_BASE))
        elif kind == 5:
            sized.append(unpack(payload, SIZE))
        else:
            found.append(unpack(payload, OCCURRENCE))
    if found:
        sid, token, df = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((token, df, sid))
        sid, token, df = sid[order], token[order], df[order]
        # A set that several map tasks hold has its hot shingles several times.
        again = np.concatenate([[False], (sid[1:] == sid[:-1]) & (token[1:] == token[:-1])])
        sid, token = sid[~again], token[~again]
        of, n = (np.concatenate(x) for x in zip(*sized, strict=True))
        of, first = np.unique(of, return_index=True)
        n = n[first]
        segments = _segments(sid)
        sizes = n[np.searchsorted(of, sid[[a for a, _ in segments]])].tolist()
        rows = [(int(sid[a]), m, token[a:b].tobytes()) for (a, b), m in zip(segments, sizes, strict=True) if b - a >= least_overlap(m)]
        if rows:
            s, m, t = zip(*rows, strict=True)
            docs.append(pa.RecordBatch.from_arrays([pa.array([False] * len(s)), pa.nulls(len(s), pa.int64()), pa.array(s, pa.int64()), pa.array(m, pa.int32()), pa.array(t, pa.binary())], schema=_BASE))
    return pa.Table.from_batches(docs, schema=_BASE)


def _prefixes(parts: int):
    def run(batches):
        for b in batches:
            token, sid, size = [], [], []
            for s, n, data in zip(b.column("sid").to_pylist(), b.column("n").to_pylist(), b.column("tokens").to_pylist(), strict=True):
                t = np.frombuffer(data, "<u8")
                t = t[: len(t) - least_overlap(n) + 1]
                token.append(t)
                sid.append(np.full(len(t), s, "<i8"))
                size.append(np.full(len(t), n, "<u4"))
            rows = []
            if token:
                t, s, n = np.concatenate(token), np.concatenate(sid), np.concatenate(size)
                key = ((t ^ t >> np.uint64(17)) % np.uint64(parts)).astype(np.int32)
                order = np.lexsort((s, n, t, key))
                t, s, n, key = t[order], s[order], n[order], key[order]
                # Entries of one list with equal sizes are neighbours: they are chained here, and the first one goes on for all.
                same = np.concatenate([[False], (t[1:] == t[:-1]) & (n[1:] == n[:-1])])
                chained = np.flatnonzero(same & np.concatenate([[False], s[1:] != s[:-1]]))
                rows = [(4, int(key[chained[a]]), pack(s[chained[a:b] - 1], s[chained[a:b]])) for a, b in _segments(key[chained])]
                t, s, n, key = t[~same], s[~same], n[~same], key[~same]
                rows += [(0, int(key[a]), pack(t[a:b], s[a:b], n[a:b])) for a, b in _segments(key)]
            yield _rows(rows)

    return run


def _neighbours(table):
    """Neighbours by size in each index list, as long as the smaller may link with the larger; and those that were chained before."""
    lists, ready = [], [np.empty((0, 2), "<i8")]
    for kind, p in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True):
        if kind == 4:
            ready.append(np.stack(unpack(p, "i8 i8"), 1))
        else:
            lists.append(unpack(p, "u8 i8 u4"))
    t, s, n = (np.concatenate(x) for x in zip(*lists, strict=True))
    order = np.lexsort((s, n, t))
    t, s, n = t[order], s[order], n[order].astype("i8")
    near = (t[1:] == t[:-1]) & (DEN * n[:-1] >= NUM * n[1:]) & (s[1:] != s[:-1])
    pairs = np.sort(np.concatenate([*ready, np.stack([s[:-1][near], s[1:][near]], 1)]), axis=1)
    pairs = np.unique(pairs, axis=0)
    return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node that has an edge (a, b); label is one node of its component.

    In each round every node is merged into its first neighbour in a random order of that round, if that comes before itself;
    so even a long chain of ascending ids is a few rounds.
    """
    both = edges.where("a <> b").select("a", "b")
    e = cut(both.union(both.select("b", "a")).distinct())
    labels, turn = None, 0
    while not e.isEmpty():
        turn += 1
        placed = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        first = e.groupBy("a").agg(F.min(placed("b")).alias("m"))
        least = cut(first.select(F.col("a").alias("node"), F.least(placed("a"), "m")["v"].alias("to")))
        if labels is None:
            labels = least.select("node", F.col("to").alias("label"))
        else:
            step = least.select(F.col("node").alias("label"), "to")
            labels = cut(labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        of_a, of_b = (least.select(F.col("node").alias(x), F.col("to").alias(f"{x}_to")) for x in "ab")
        e = cut(e.join(of_a, "a").join(of_b, "b").where("a_to <> b_to").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct())
    return labels if labels is not None else e.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _bits(rows: list[np.ndarray], places: int) -> np.ndarray:
    """Bit columns: [w, x] has the places 64w to 64w + 63 of row x."""
    out = np.zeros((-(-places // 64), len(rows)), "<u8")
    for x, row in enumerate(rows):
        if len(row):
            flags = np.zeros(64 * len(out), bool)
            flags[row] = True
            out[:, x] = np.packbits(flags, bitorder="little").view("<u8")
    return out


def _common(bits: np.ndarray, x: int, low: int = 0, high: int | None = None) -> np.ndarray:
    """How many places row x has in common with each of the rows from low to high."""
    out = np.zeros(len(bits[0, low:high]) if len(bits) else (bits.shape[1] if high is None else high) - low, "i8")
    for w in np.flatnonzero(bits[:, x]).tolist():
        out += np.bitwise_count(bits[w, low:high] & bits[w, x])
    return out


def resolve(n: np.ndarray, sets: list[np.ndarray], labels: np.ndarray | None = None) -> np.ndarray:
    """Class of each set, as the position of one of its members, by links of similarity NUM / DEN or more.

    n: the full sizes; sets: the shingles that may be shared. Sets with equal labels are in one class from the start.
    Index lists of frequent shingles are bit columns: all sets that have one in their prefix are bounded at once by their common bits.
    """
    count = len(sets)
    if count < 2:
        return np.arange(count)
    order = np.lexsort((np.arange(count), n))  # from here on sets are told by their place in it
    size_of = n[order].astype(np.int64)
    size, parent, classes = size_of.tolist(), np.arange(count).tolist(), np.arange(count)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: int, j: int) -> None:
        i, j = find(i), find(j)
        if i != j:
            parent[i] = j
            classes[classes == i] = j

    if labels is not None:
        _, first, which = np.unique(labels[order], return_index=True, return_inverse=True)
        classes = first[which.ravel()]
        parent = classes.tolist()
    values, inverse, df = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, df))] = np.arange(len(values))
    lone = int((df == 1).sum())  # ranks below are in one set only
    frequent = max(lone, len(values) - int((df >= max(FREQUENT_LEAST, count // FREQUENT_SHARE)).sum()))  # ranks from here on are bits
    ends = np.cumsum([len(sets[i]) for i in order])
    ranked = [np.sort(r[r >= lone]) for r in np.split(rank[inverse], ends[:-1])]
    lengths = np.asarray([len(r) for r in ranked])
    rare = [r[: np.searchsorted(r, frequent)] for r in ranked]
    rares = np.asarray([len(r) for r in rare])
    bits = _bits([r[k:] - frequent for r, k in zip(ranked, rares.tolist(), strict=True)], len(values) - frequent)
    spares = lengths - least_overlap(size_of)
    in_bits = (spares >= rares) & (lengths > rares)  # a prefix reaches the frequent ones
    index: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for x in range(count):
        mine, nx, spare = ranked[x], size[x], int(spares[x])
        if spare < 0:
            continue
        prefix = rare[x][: spare + 1].tolist()
        smallest, seen, rest = -(-NUM * nx // DEN), set(), len(mine)
        for px, token in enumerate(prefix):
            blocks = index.get(token)
            if not blocks:
                continue
            for root, entries in blocks.items():
                if find(root) == find(x):
                    continue  # answered by the similar set that x was linked with
                for y, py in reversed(entries):
                    ny = size[y]
                    if ny < smallest:
                        break  # the lists ascend by size
                    if y in seen:
                        continue
                    seen.add(y)  # this is the first shingle that both have, so all they share is from here on
                    least = least_overlap(nx, ny)
                    if min(rest - px, len(ranked[y]) - py) < least:
                        continue
                    if len(np.intersect1d(mine, ranked[y], assume_unique=True)) >= least:
                        join(x, y)
                        break
        if in_bits[x]:
            low = int(np.searchsorted(size_of[:x], smallest))
            least = least_overlap(nx, size_of[low:x])
            common = _common(bits, x, low, x)
            may = in_bits[low:x] & (common + np.minimum(rares[low:x], rares[x]) >= least) & (classes[low:x] != classes[x])
            near, at_once = np.flatnonzero(may)[::-1], 4
            while len(near):
                ys, near = near[:at_once], near[at_once:]
                at_once *= 4
                held = np.isin(np.concatenate([rare[low + y] for y in ys]), rare[x])
                shared = common[ys] + np.bincount(np.repeat(np.arange(len(ys)), rares[low + ys]), held, len(ys)).astype("i8")
                linked = ys[shared >= least[ys]]
                for y in linked.tolist():
                    join(x, low + y)
                if len(linked):
                    near = near[classes[low + near] != classes[x]]
        root = find(x)
        for px, token in enumerate(prefix):
            index.setdefault(token, {}).setdefault(root, []).append((x, px))
    out = np.empty(count, np.int64)
    out[order] = order[[find(i) for i in range(count)]]
    return out


def _resolve_groups(table):
    """(sid, root) of the sets of all candidate groups in a bucket; column label, if any, has classes that are known."""
    hold("sets")
    sids, n, data = table.column("sid").to_numpy(), table.column("n").to_numpy(), table.column("tokens").to_pylist()
    known = table.column("label").to_numpy() if "label" in table.column_names else None
    comp = table.column("comp").to_numpy()
    out_s, out_r = [], []
    order = np.argsort(comp, kind="stable")
    for a, b in _segments(comp[order]):
        who = order[a:b]
        roots = resolve(n[who], [np.frombuffer(data[i], "<u8") for i in who], None if known is None else known[who])
        out_s.append(sids[who])
        out_r.append(sids[who][roots])
    return pa.table({"sid": np.concatenate(out_s) if out_s else np.empty(0, "i8"), "root": np.concatenate(out_r) if out_r else np.empty(0, "i8")})


ROOTS = "sid long, root long"


def _resolve_large(sets: DataFrame, sizes: DataFrame, group_sets: int, group_bytes: int) -> DataFrame:
    """Classes in groups that are too large for one task. sets: comp, sid, n, tokens; sizes: comp, chunks."""
    dealt = cut(sets.join(sizes, "comp").withColumn("chunk", F.pmod(F.xxhash64("sid"), F.col("chunks"))))
    local = cut(dealt.groupBy("comp", "chunk").applyInArrow(lambda _, t: _resolve_groups(t), ROOTS))
    # One leader per class of a chunk, dealt anew until they fit into one task or no class merges any more.
    merged = None
    leaders = cut(dealt.join(local.where("sid = root").select("sid"), "sid", "left_semi"))
    for _ in range(8):
        per = leaders.groupBy("comp").agg(F.count("*").alias("k"), F.sum(F.length("tokens")).alias("b"))
        per = per.select("comp", F.greatest(F.ceil(F.col("k") / group_sets), F.ceil(F.col("b") / group_bytes)).alias("now"))
        tasks = leaders.drop("chunks", "chunk").join(per, "comp").withColumn("deal", F.pmod(F.xxhash64("sid", F.lit(_)), F.col("now")))
        step = cut(tasks.groupBy("comp", "deal").applyInArrow(lambda _, t: _resolve_groups(t), ROOTS))
        merged = step if merged is None else cut(merged.join(step.select(F.col("sid").alias("root"), F.col("root").alias("to")), "root", "left").select("sid", F.coalesce("to", "root").alias("root")))
        left = cut(leaders.join(step.where("sid = root").select("sid"), "sid", "left_semi"))
        if per.agg(F.max("now")).first()[0] in (None, 1) or left.count() == leaders.count():
            break
        leaders = left
    classes = cut(local.join(merged.select(F.col("sid").alias("root"), F.col("root").alias("to")), "root", "left").select("sid", F.coalesce("to", "root").alias("label")))
    labelled = cut(dealt.join(classes, "sid"))
    counts = labelled.groupBy("comp", "label").agg(F.count("*").alias("k"))
    main = counts.groupBy("comp").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count("*").alias("classes")).where("classes > 1")
    others = labelled.join(main, "comp").where("label <> main")
    blocks = others.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / group_sets), F.ceil(F.sum(F.length("tokens")) / group_bytes)).cast("int").alias("blocks"))
    cols = ["comp", "chunk", "block", "sid", "n", "tokens", "label"]
    each = labelled.join(blocks, "comp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(cols)
    asked = (
        others.join(blocks, "comp")
        .withColumn("block", F.pmod(F.xxhash64("sid", F.lit("block")), F.col("blocks")).cast("int"))
        .withColumn("own", F.col("chunk"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)))
        .where("chunk <> own")
        .select(cols)
    )
    more = each.unionByName(asked).groupBy("comp", "chunk", "block").applyInArrow(lambda _, t: _resolve_groups(t), ROOTS)
    pairs = more.join(classes, "sid").select(F.col("label").alias("a"), F.col("root").alias("sid")).join(classes, "sid").select("a", F.col("label").alias("b")).where("a <> b").distinct()
    final = components(pairs)
    return classes.join(final.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("sid", F.coalesce("to", "label").alias("root"))


def _count_links(table):
    """(sid, links): the documents that each set links with by other sets; a task is a pair of chunks of a class."""
    root, low, high, chunk, sids, n, copies = (table.column(c).to_numpy() for c in ("root", "low", "high", "chunk", "sid", "n", "copies"))
    data = table.column("tokens").to_pylist()
    out_s, out_l = [], []
    order = np.lexsort((high, low, root))
    task = np.unique(np.stack([root[order], low[order], high[order]], 1), axis=0, return_inverse=True)[1].ravel()
    again = np.argsort(task, kind="stable")
    for a, b in _segments(task[again]):
        who = order[again[a:b]]
        size, times, side, between = n[who].astype("i8"), copies[who], chunk[who], low[who[0]] != high[who[0]]
        sets = [np.frombuffer(data[i], "<u8") for i in who]
        lengths = np.asarray([len(x) for x in sets])
        inverse = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
        df = np.bincount(inverse)
        frequent = df >= max(FREQUENT_LEAST, len(who) // FREQUENT_SHARE)
        place = np.cumsum(frequent) - 1
        tokens = np.split(inverse, np.cumsum(lengths)[:-1])
        bits = _bits([place[t[frequent[t]]] for t in tokens], int(frequent.sum()))
        holders = np.repeat(np.arange(len(who)), lengths)[np.argsort(inverse, kind="stable")]
        begins = np.concatenate([[0], np.cumsum(df)])
        links = np.zeros(len(who), "i8")
        for x, mine in enumerate(tokens):
            overlap = _common(bits, x)
            mine = mine[~frequent[mine] & (df[mine] > 1)]
            for part in np.array_split(mine, 1 + int(df[mine].sum()) // 4_000_000):
                if len(part):
                    overlap += np.bincount(np.concatenate([holders[begins[t] : begins[t + 1]] for t in part.tolist()]), minlength=len(who))
            linked = overlap >= least_overlap(size[x], size)
            linked[x] = False
            if between:
                linked &= side != side[x]
            links[x] = times[linked].sum()
        out_s.append(sids[who])
        out_l.append(links)
    return pa.table({"sid": np.concatenate(out_s) if out_s else np.empty(0, "i8"), "links": np.concatenate(out_l) if out_l else np.empty(0, "i8")})


def _links(sets: DataFrame, rooted: DataFrame, parts: int, link_sets: int, link_bytes: int) -> DataFrame:
    """(sid, links) of the sets in classes of two sets or more. rooted: sid, root, copies, n."""
    per = rooted.groupBy("root").agg(F.count("*").alias("k"), F.sum(F.col("n").cast("long") * 8).alias("b")).where("k > 1")
    per = per.select("root", F.greatest(F.ceil(F.col("k") / link_sets), F.ceil(F.col("b") / link_bytes)).alias("chunks"))
    dealt = (
        sets.join(rooted.join(per, "root").select("sid", "root", "copies", "chunks"), "sid")
        .withColumn("chunk", F.pmod(F.xxhash64("sid", F.lit("links")), F.col("chunks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .select("root", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "sid", "n", "tokens", "copies")
    )
    bucket = F.pmod(F.xxhash64("root", "low", "high"), F.lit(parts * 4)).alias("bucket")
    counted = dealt.groupBy(bucket).applyInArrow(lambda _, t: _count_links(t), "sid long, links long")
    return counted.groupBy("sid").agg(F.sum("links").alias("links"))


def link_classes(docs: DataFrame, words: int = WORDS, part_bytes: int = PART_BYTES, group_sets: int = GROUP_SETS, group_bytes: int = GROUP_BYTES, hot_least: int = HOT_LEAST, links: bool = False, link_sets: int = LINK_SETS, link_bytes: int = LINK_BYTES) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one per row of docs. links: also n_links, with how many other rows it links."""
    spark = docs.sparkSession
    parts = max(min(MANY_PARTS, scan_parts(docs, part_bytes, least=16)), scan_parts(docs, LARGE_PART_BYTES, most=1 << 22) if known_size(docs) else 16)
    source = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text"))
    emitted = source.mapInArrow(_emit(parts, words, hot_least), PACKED)
    # Markers of frequent shingles (kind 3) go with their part's rows (kind 0).
    keyed = emitted.select(F.when(F.col("kind") == 3, 0).otherwise(F.col("kind")).alias("kind"), "key", "payload", F.col("kind").alias("sub"))
    shared = keyed.groupBy("kind", "key").applyInArrow(_shared(parts), PACKED)
    base = cut(shared.groupBy("key").applyInArrow(_gather, BASE))
    documents = base.where("is_doc").select("doc_id", "sid", "n")
    sets = base.where("not is_doc").select("sid", "n", "tokens")
    listed = sets.mapInArrow(_prefixes(parts), PACKED)
    edges = listed.groupBy("key").applyInArrow(_neighbours, "a long, b long")
    groups = components(edges)
    grouped = cut(sets.join(groups.select(F.col("node").alias("sid"), F.col("label").alias("comp")), "sid"))
    sizes = grouped.groupBy("comp").agg(F.count("*").alias("k"), F.sum(F.length("tokens")).alias("b"))
    large = cut(sizes.where((F.col("k") > group_sets) | (F.col("b") > group_bytes)).select("comp", F.greatest(F.ceil(F.col("k") / group_sets), F.ceil(F.col("b") / group_bytes)).alias("chunks")))
    some_large = not large.isEmpty()
    small = grouped.join(large, "comp", "left_anti") if some_large else grouped
    roots = small.groupBy(F.pmod(F.xxhash64("comp"), F.lit(parts * 4)).alias("bucket")).applyInArrow(lambda _, t: _resolve_groups(t), ROOTS)
    if some_large:
        roots = roots.unionByName(_resolve_large(grouped, large, group_sets, group_bytes))
    least = documents.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min("n").alias("n"))
    rooted = least.join(roots, "sid", "left").select("sid", "least", F.coalesce("root", "sid").alias("root"), "copies", "n")
    rooted = cut(rooted)
    classes = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of_set = rooted.join(classes, "root").select("sid", "component", "copies")
    n_links = []
    if links:
        of_set = of_set.join(_links(sets, rooted, parts, link_sets, link_bytes), "sid", "left")
        n_links = [F.when(F.col("n") > 0, F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links")]
    return documents.join(of_set, "sid", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), *n_links
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class, that of its smallest doc_id; a null doc_id comes last.

    A document is told by a hash of doc_id and text, so null and repeated ids are linked by their texts alone; of
    rows alike in both one stays, the first by the other columns.
    """
    row, own, k = (fresh(docs, c) for c in ("row", "own", "k"))
    numbered = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    known = numbered.groupBy(row).agg(F.min("doc_id").alias(own), F.count("*").alias(k))
    linked = link_classes(numbered.select(F.col(row).alias("doc_id"), "text"), **options).select(F.col("doc_id").alias(row), "component_id").distinct()
    first = F.min(F.struct(F.col(own).isNull(), own, row, k)).alias("first")
    firsts = cut(linked.join(known, row).groupBy("component_id").agg(first).select(f"first.{row}", f"first.{k}"))
    kept = numbered.join(firsts, row)
    if firsts.where(F.col(k) > 1).isEmpty():
        return kept.select(docs.columns)
    one = kept.where(F.col(k) > 1).groupBy(row).agg(F.min(F.struct(*docs.columns)).alias("first")).select("first.*")
    return kept.where(F.col(k) == 1).select(docs.columns).unionByName(one)
