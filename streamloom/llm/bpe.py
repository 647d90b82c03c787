"""Byte-level BPE, encoding and decoding, exact and in linear time.

Bytes are mapped to Latin-1, so that an Aho-Corasick automaton over text finds the longest token that starts at a
place of a piece. Encoding takes the longest token and goes on; where the token before cannot stand next to it, it tries the
next shorter one, and steps back when none is left. Two tokens can stand side by side iff merging their bytes gives
just these two; that is computed once per pair and memoised. A place that failed once is not tried again, so the work
is linear. Pieces come from the tokenizer's pattern and each is encoded separately; frequent pieces are memoised.

Scale: one pass by Arrow batches without a shuffle. The ranks (under 1 MB, a file of fixed size) are read by the driver and
broadcast. Memos are per worker and bounded; when one is full it starts afresh. They go
when the worker turns to another step.

Defined results: null and empty texts give no ids and the digests of no bytes. Any text goes, of any length, also one
endless piece. Special tokens' names are plain text. Repeated rows repeat; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold

PIECES_KEPT, CHUNKS_KEPT, KEPT_CHARS, PAIRS_KEPT = 120_000, 250_000, 48, 300_000


#: Patterns in which a space before a character that is no white space always begins a piece (fixed value: the public byte-level pattern).
SPACE_BEGINS = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",)


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Of a file with lines "base64 rank"."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Bpe:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.token[i] = b
        self.longest = max(map(len, ranks))
        self.size = [len(b) for b in self.token]
        self.split = regex.compile(pattern).findall
        self.at_spaces = pattern in SPACE_BEGINS
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.shorter = [-1] * len(self.token)
        self.reachable = bytearray(len(self.token))
        self._derive()
        # Tokens that merges can make, by their bytes in Latin-1: each place's first choice, and pieces that are one token.
        self.whole = {b.decode("latin-1"): i for b, i in ranks.items()}
        for t in sorted(range(len(self.token)), key=self.size.__getitem__):
            s = self.shorter[t]
            if s >= 0 and not self.reachable[s]:
                self.shorter[t] = self.shorter[s]
        self.first = {s: i if self.reachable[i] else self.shorter[i] for s, i in self.whole.items()}.get
        self.four = [struct.pack("<I", i) for i in range(len(self.token))]
        self.packed: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _derive(self) -> None:
        """For each token, by rank: its longest shorter token, and the two tokens whose merge makes it.

        Of all ways to cut a token in two, only one is a pair that stays apart until this merge; single bytes have none, and a
        longer token without one can never come out of the merges.
        """
        ranks = self.ranks
        for b, t in sorted(ranks.items(), key=lambda x: x[1]):
            if len(b) == 1:
                self.reachable[t] = 1
                self.halves[t] = (t, t)
                continue
            for n in range(len(b) - 1, 0, -1):
                left = ranks.get(b[:n])
                if left is None:
                    continue
                if self.shorter[t] < 0:
                    self.shorter[t] = left
                right = ranks.get(b[n:])
                if right is not None and left in self.halves and right in self.halves and left < t and right < t and self._apart(left, right, t):
                    self.joined[left, right] = t
                    self.halves[t] = (left, right)
                    self.reachable[t] = 1
                    break

    def _apart(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge of a rank below limit crosses the border between tokens a and b.

        Undoes the merges of both sides, latest first, and looks at each pair that once met at the border.
        """
        joined, halves = self.joined.get, self.halves
        while True:
            if joined((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, halves[a][1]
                if a == limit:
                    limit, was = b + 1, b
                    b = halves[b][0]
                    if b == was:
                        return True
            else:
                limit, was = b + 1, b
                b = halves[b][0]
                if b == was:
                    limit, a = a, halves[a][1]
                    if a == limit:
                        return True

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(a, b, 1 << 60)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        return self._encode(piece.decode("latin-1")) if piece else []

    def _encode(self, s: str) -> list[int]:
        """Ids of a piece that is not empty, given as its bytes in Latin-1."""
        first = self.first
        t = self.whole.get(s)
        if t is not None:
            return [t]
        n, path, most, size, shorter, pairs = len(s), self.automaton.longest_prefix, self.longest, self.size, self.shorter, self.pairs.get
        failed = bytearray(n + 1)
        out: list[int] = []
        at, before = 0, -1
        while at < n:
            # The longest token from here; a place is come to once, as it fails when it is left by stepping back.
            part = s[at : at + most]
            k = path(part)
            t = first(part[:k])
            while t is None:
                k -= 1
                t = first(part[:k])
            while True:
                while t >= 0:
                    to = at + size[t]
                    if not failed[to]:
                        if before < 0:
                            break
                        fits = pairs(before << 32 | t)
                        if fits is None:
                            fits = self.compatible(before, t)
                        if fits:
                            break
                    t = shorter[t]
                if t >= 0:
                    break
                failed[at] = 1
                t = out.pop()
                before = out[-1] if out else -1
                at -= size[t]
                t = shorter[t]
            out.append(t)
            before, at = t, to
        return out

    def _ids(self, piece: str) -> bytes:
        ids = self._encode(piece if piece.isascii() else piece.encode("utf-8").decode("latin-1"))
        return b"".join([self.four[i] for i in ids])

    def _pack(self, piece: str) -> bytes:
        if self.at_spaces and piece[0] == " " and piece.isascii() and piece[1:].isalpha():
            return self.chunks.get(piece[1:]) or self._chunk(piece[1:])
        known = self.packed.get(piece)
        if known is None:
            known = self._ids(piece)
            if len(piece) <= KEPT_CHARS:
                if len(self.packed) >= PIECES_KEPT:
                    self.packed.clear()
                self.packed[piece] = known
        return known

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a space and chunk, which starts with no white space. ASCII letters alone are one piece."""
        if chunk.isascii() and chunk.isalpha():
            known = self._ids(" " + chunk)
        else:
            known = b"".join(map(self._pack, self.split(" " + chunk)))
        if len(chunk) <= KEPT_CHARS and "\n" not in chunk:
            if len(self.chunks) >= CHUNKS_KEPT:
                self.chunks.clear()
            self.chunks[chunk] = known
        return known

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers.

        With a pattern like the usual ones, where a space before a character that is no white space always begins a
        piece, the text falls into chunks at those spaces, and chunks are memoised as a whole.
        """
        first, *rest = text.split(" ")
        if not self.at_spaces or any(not c or c[0].isspace() for c in rest):
            if not self.at_spaces:
                return b"".join(map(self._pack, self.split(text)))
            joined, held = [], first
            for c in rest:
                if c and not c[0].isspace():
                    joined.append(held)
                    held = c
                else:
                    held = f"{held} {c}"
            first, *rest = [*joined, held]
        get, make = self.chunks.get, self._chunk
        return b"".join([*map(self._pack, self.split(first)), *[get(c) or make(c) for c in rest]])

    def encode(self, text: str) -> list[int]:
        data = self.encode_packed(text)
        return list(struct.unpack(f"<{len(data) // 4}I", data))

    def decode_packed(self, ids: bytes) -> bytes:
        import numpy as np

        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids) -> bytes:
        return b"".join(self.token[i] for i in ids)


_made: dict[str, Bpe] = {}


def _forget() -> None:
    _made.clear()


def worker_bpe(data: bytes, pattern: str) -> Bpe:
    """One encoder per worker process and vocabulary."""
    hold("bpe", _forget)
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = Bpe(read_ranks(data), pattern)
    return _made[key]


def _texts(column) -> list[str]:
    return [t or "" for t in column.to_pylist()]


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: number of ids and the digests of the ids and of the bytes that they decode to (columns DIGESTS)."""
    shared = docs.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())

    def run(batches):
        bpe = worker_bpe(shared.value, pattern)
        for b in batches:
            n, ids, back = [], [], []
            for text in _texts(b.column("text")):
                packed = bpe.encode_packed(text)
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(bpe.decode_packed(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=[x.split()[0] for x in DIGESTS.split(", ")])

    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text").mapInArrow(run, DIGESTS)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, column: str = "token_ids") -> DataFrame:
    """docs with one more column: the ids of text, array<int>. A column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())
    kept = [c for c in docs.columns if c != column]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes if c != column), f"`{column}` array<int>"])

    def run(batches):
        import numpy as np

        bpe = worker_bpe(shared.value, pattern)
        for b in batches:
            packed = [bpe.encode_packed(t) for t in _texts(b.column("text"))]
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype("int32")
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), ids], names=[*kept, column])

    return docs.select(*kept).mapInArrow(run, schema)


def decode_documents(docs: DataFrame, ranks_path: str, pattern: str, ids: str = "token_ids", column: str = "decoded") -> DataFrame:
    """doc_id and the bytes of the ids, binary; null ids give no bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())

    def run(batches):
        bpe = worker_bpe(shared.value, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([bpe.decode(x or ()) for x in b.column(ids).to_pylist()], pa.binary())], names=["doc_id", column])

    return docs.select("doc_id", ids).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, `{column}` binary")
