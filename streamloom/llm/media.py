"""ISO base media containers: write payloads losslessly, walk boxes, decode sample tables.

`mux` stores bytes as fixed-size samples of an audio track with 8-bit PCM (sample entry "raw "), so one byte is one
sample unit and the stored form is lossless. `probe` walks the nested boxes of any such container, decodes the sample
tables (stts, stsz or stz2, stsc, stco or co64, stss) and the runs of movie fragments (trex, tfhd, trun) of every track, and gives
codec, duration and the byte ranges of key frames; it reads no payload. `read_payload` follows the tables to the stored bytes.

Scale: one pass by Arrow batches, a document at a time; nothing is shuffled or kept between documents.

Defined results: null is the empty text. A payload is never empty (a positive multiple of 192). What is not a
container, is cut short or has inconsistent tables gives a row with `error` set and nulls elsewhere. Repeated rows and
equal texts give equal values; extra columns are kept by `media_columns`, which puts `media_` before a name of its own that the
table has already, and not read by `store_documents`; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

#: A payload is padded to a multiple of this (fixed value of the contract); it is the sample size here.
BLOCK = 192
TIMESCALE = 48_000
SAMPLES_A_CHUNK = 256
KEY_EVERY = 64
#: Boxes that hold boxes (fixed values of ISO/IEC 14496-12).
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"))


class MediaError(ValueError):
    """The bytes are no readable container."""


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes) -> bytes:
    return data + b" " * (-len(data) % BLOCK or (0 if data else BLOCK))


def mux(payload: bytes) -> bytes:
    """A container with one track whose samples are the BLOCK-byte pieces of payload, every KEY_EVERY-th a sync sample."""
    if not payload or len(payload) % BLOCK:
        raise ValueError("the payload must be a positive multiple of 192 bytes")
    n = len(payload) // BLOCK
    chunks, last = divmod(n, SAMPLES_A_CHUNK)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    first = len(ftyp) + head
    offsets = [first + i * SAMPLES_A_CHUNK * BLOCK for i in range(chunks + bool(last))]
    wide = offsets[-1] >= 1 << 32
    runs = ([(1, SAMPLES_A_CHUNK)] if chunks else []) + ([(chunks + 1, last)] if last else [])
    keys = range(1, n + 1, KEY_EVERY)
    duration = n * BLOCK
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, n, BLOCK)),
        full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, b, 1) for a, b in runs)),
        full(b"stsz", struct.pack(">II", BLOCK, n)),
        full(b"co64" if wide else b"stco", struct.pack(f">I{len(offsets)}{'Q' if wide else 'I'}", len(offsets), *offsets)),
    )
    unity = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    moov = box(
        b"moov",
        full(b"mvhd", struct.pack(">QQIQ", 0, 0, TIMESCALE, duration), struct.pack(">IH", 0x10000, 0x100), bytes(10), unity, bytes(24), struct.pack(">I", 2), version=1),
        box(
            b"trak",
            full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), unity, bytes(8), version=1, flags=3),
            box(
                b"mdia",
                full(b"mdhd", struct.pack(">QQIQ", 0, 0, TIMESCALE, duration), struct.pack(">HH", 0x55C4, 0), version=1),
                full(b"hdlr", bytes(4), b"soun", bytes(12), b"bytes\0"),
                box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl),
            ),
        ),
    )
    return ftyp + box(b"mdat", payload) + moov


def walk(data, begin: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int, int]]:
    """(path, begin of the box, begin of its body, end) of every box, depth first. Bodies of other boxes than CONTAINERS are not read."""
    end = len(data) if end is None else end
    while begin < end:
        if end - begin < 8:
            raise MediaError("a box header is cut short")
        size, kind = struct.unpack_from(">I4s", data, begin)
        body = begin + 8
        if size == 1:
            if end - begin < 16:
                raise MediaError("a box header is cut short")
            size, body = struct.unpack_from(">Q", data, begin + 8)[0], begin + 16
        elif size == 0:
            size = end - begin
        if size < body - begin or begin + size > end:
            raise MediaError(f"box {kind!r} has a wrong size")
        here = (*path, kind)
        yield here, begin, body, begin + size
        if kind in CONTAINERS:
            if len(here) > 16:
                raise MediaError("boxes are nested too deeply")
            yield from walk(data, body, begin + size, here)
        begin += size


def _ints(data, at: int, end: int, n: int, code: str = "I") -> tuple[int, ...]:
    width = struct.calcsize(code)
    if n < 0 or at + n * width > end:
        raise MediaError("a table is longer than its box")
    return struct.unpack_from(f">{n}{code}", data, at)


def _optional(data, at: int, flags: int, fields) -> tuple[dict, int]:
    """Values of the fields (bit, name, code) that flags say are there, and where they end."""
    out = {}
    for bit, name, code in fields:
        if flags & bit:
            out[name] = struct.unpack_from(f">{code}", data, at)[0]
            at += struct.calcsize(f">{code}")
    return out, at


#: Optional fields of tfhd, of trun and of a sample in trun, with the bits that say so (fixed values of ISO/IEC 14496-12).
TFHD = ((0x1, "base", "Q"), (0x2, "entry", "I"), (0x8, "duration", "I"), (0x10, "size", "I"), (0x20, "flags", "I"))
TRUN = ((0x1, "offset", "i"), (0x4, "first_flags", "I"))
TRUN_SAMPLE = ((0x100, "duration", "I"), (0x200, "size", "I"), (0x400, "flags", "I"), (0x800, "shift", "I"))
BASE_IS_MOOF, NOT_SYNC = 0x20000, 0x10000


def _compact_sizes(data, at: int, end: int) -> tuple[int, ...]:
    """Sizes of stz2, of 4, 8 or 16 bits."""
    bits, n = data[at + 7], _ints(data, at + 8, end, 1)[0]
    if bits == 4:
        pairs = _ints(data, at + 12, end, -(-n // 2), "B")
        return tuple(x for p in pairs for x in (p >> 4, p & 15))[:n]
    if bits not in (8, 16):
        raise MediaError("sample sizes of an unknown width")
    return _ints(data, at + 12, end, n, "B" if bits == 8 else "H")


def _run(data, at: int, end: int, base: int, defaults: dict) -> tuple[int, list[int], int, list[int]]:
    """(begin, sizes, duration, places of sync samples) of a trun box whose data begin at base if it does not say."""
    head, n = _ints(data, at, end, 2)
    flags = head & 0xFFFFFF
    own, here = _optional(data, at + 8, flags, TRUN)
    each = [(name, bit) for bit, name, _ in TRUN_SAMPLE if flags & bit]
    table = _ints(data, here, end, n * len(each))
    columns = {name: table[i :: len(each)] for i, (name, _) in enumerate(each)}
    value = lambda name: columns.get(name) or [defaults.get(name, 0)] * n
    sample_flags = list(value("flags"))
    if n and "first_flags" in own:
        sample_flags[0] = own["first_flags"]
    return base + own.get("offset", 0), list(value("size")), sum(value("duration")), [i for i, f in enumerate(sample_flags) if not f & NOT_SYNC]


def tracks(data) -> list[dict]:
    """id, codec, handler, timescale, duration, the decoded tables and the fragments' runs of every track."""
    found: list[dict] = []
    trex: dict[int, dict] = {}
    moof, follows, traf, here = 0, None, {}, 0
    try:
        for path, begin, at, end in walk(data):
            kind = path[-1]
            if kind == b"trak":
                found.append({"runs_of_fragments": []})
            elif kind == b"moof":
                moof, follows = begin, None
            elif kind == b"trex":
                number, _, duration, size, flags = _ints(data, at + 4, end, 5)
                trex[number] = {"duration": duration, "size": size, "flags": flags}
            elif kind == b"tfhd":
                head, number = _ints(data, at, end, 2)
                own, _ = _optional(data, at + 8, head & 0xFFFFFF, TFHD)
                traf = {"track": number, **trex.get(number, {}), **own}
                # Without a base of its own the first traf begins at its moof, another one where the data before it end.
                here = own.get("base", moof if head & BASE_IS_MOOF or follows is None else follows)
            elif kind == b"trun" and traf:
                start, sizes, duration, keys = _run(data, at, end, here, traf)
                here = follows = start + sum(sizes)
                if here > len(data) or start < 0:
                    raise MediaError("samples lie outside the file")
                for t in found:
                    if t.get("id") == traf["track"]:
                        t["runs_of_fragments"].append((start, sizes, keys))
                        t["fragment_duration"] = t.get("fragment_duration", 0) + duration
            if b"trak" not in path or kind == b"trak":
                continue
            t = found[-1]
            if kind == b"tkhd":
                t["id"] = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
            elif kind == b"mdhd":
                version = data[at]
                t["timescale"], t["duration"] = struct.unpack_from(">IQ", data, at + 20) if version == 1 else struct.unpack_from(">II", data, at + 12)
            elif kind == b"hdlr":
                t["handler"] = bytes(data[at + 8 : at + 12]).decode("latin-1")
            elif kind == b"stsd":
                t["codec"] = bytes(data[at + 12 : at + 16]).decode("latin-1")
            elif kind == b"stts":
                flat = _ints(data, at + 8, end, 2 * _ints(data, at + 4, end, 1)[0])
                t["times"] = list(zip(flat[::2], flat[1::2], strict=True))
            elif kind == b"stss":
                t["keys"] = _ints(data, at + 8, end, _ints(data, at + 4, end, 1)[0])
            elif kind == b"stsc":
                flat = _ints(data, at + 8, end, 3 * _ints(data, at + 4, end, 1)[0])
                t["runs"] = list(zip(flat[::3], flat[1::3], strict=False))
            elif kind == b"stsz":
                same, n = _ints(data, at + 4, end, 2)
                t["same"], t["n"], t["sizes"] = same, n, () if same else _ints(data, at + 12, end, n)
            elif kind == b"stz2":
                t["sizes"] = _compact_sizes(data, at, end)
                t["same"], t["n"] = 0, len(t["sizes"])
            elif kind in (b"stco", b"co64"):
                t["offsets"] = _ints(data, at + 8, end, _ints(data, at + 4, end, 1)[0], "I" if kind == b"stco" else "Q")
    except (struct.error, IndexError) as e:
        raise MediaError(str(e)) from e
    return found


def _ends(track: dict) -> list[int]:
    """Running sums of the sample sizes, for tables without one size for all."""
    if "ends" not in track:
        track["ends"] = [0, *itertools.accumulate(track["sizes"])]
    return track["ends"]


def sample_ranges(track: dict, total: int) -> list[tuple[int, int, int]]:
    """(first sample, begin, end) of runs of samples that lie one after another, from stsc, the sizes and the chunk offsets, then from fragments."""
    try:
        runs, offsets, n = track["runs"], track["offsets"], track["n"]
    except KeyError as e:
        raise MediaError(f"no table for {e}") from e
    out, sample = [], 0
    for i, (first, per) in enumerate(runs):
        until = runs[i + 1][0] if i + 1 < len(runs) else len(offsets) + 1
        if not 1 <= first <= until <= len(offsets) + 1:
            raise MediaError("chunks are out of order")
        for chunk in range(first, until):
            take = min(per, n - sample)
            size = take * track["same"] if track["same"] else _ends(track)[sample + take] - _ends(track)[sample]
            begin = offsets[chunk - 1]
            if begin + size > total:
                raise MediaError("samples lie outside the file")
            if take:
                out.append((sample, begin, begin + size))
            sample += take
    if sample != n:
        raise MediaError("the chunks hold fewer samples than the sizes")
    for begin, sizes, _ in track["runs_of_fragments"]:
        out.append((sample, begin, begin + sum(sizes)))
        sample += len(sizes)
    return out


def key_ranges(track: dict, total: int) -> list[tuple[int, int]]:
    """Byte ranges of the sync samples; without stss every sample of the tables is one."""
    spans = [s for s in sample_ranges(track, total) if s[0] < track["n"]]
    starts, out = [s for s, _, _ in spans], []
    for k in track.get("keys", range(1, track["n"] + 1)):
        if not 1 <= k <= track["n"]:
            raise MediaError("a sync sample has no size")
        first, begin, _ = spans[bisect.bisect_right(starts, k - 1) - 1]
        if track["same"]:
            a, size = begin + (k - 1 - first) * track["same"], track["same"]
        else:
            a, size = begin + _ends(track)[k - 1] - _ends(track)[first], track["sizes"][k - 1]
        out.append((a, a + size))
    for begin, sizes, keys in track["runs_of_fragments"]:
        ends = [begin, *itertools.accumulate(sizes, initial=begin)][1:]
        out += [(ends[i], ends[i] + sizes[i]) for i in keys]
    return out


def read_payload(data, track: dict) -> bytes:
    view = memoryview(data)
    return b"".join(view[a:b] for _, a, b in sample_ranges(track, len(data)))


TRACK = ("track_id", "codec", "handler", "timescale", "duration", "n_samples", "key_ranges")


def described(track: dict, total: int) -> dict:
    samples = track.get("n", 0) + sum(len(sizes) for _, sizes, _ in track["runs_of_fragments"])
    duration = (track.get("duration") or 0) or track.get("fragment_duration", 0)
    return dict(zip(TRACK, (track.get("id"), track.get("codec"), track.get("handler"), track.get("timescale"), duration, samples, [{"begin": a, "end": b} for a, b in key_ranges(track, total)]), strict=True))


def probe(data: bytes | None) -> dict:
    """TRACK of the first video track, else of the first track; all tracks; or error."""
    try:
        if not data:
            raise MediaError("empty")
        found = [described(t, len(data)) for t in tracks(data)]
        if not found:
            raise MediaError("no track")
        return next((t for t in found if t["handler"] == "vide"), found[0]) | {"tracks": found, "error": None}
    except MediaError as e:
        return dict.fromkeys((*TRACK, "tracks")) | {"error": str(e)}


_RANGES = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_TRACK = [("track_id", pa.int64()), ("codec", pa.string()), ("handler", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("key_ranges", _RANGES)]
_MEDIA = [*_TRACK, ("tracks", pa.list_(pa.struct(_TRACK))), ("error", pa.string())]
_TRACK_SQL = {"track_id": "long", "codec": "string", "handler": "string", "timescale": "long", "duration": "long", "n_samples": "long", "key_ranges": "array<struct<begin:long,end:long>>"}
_MEDIA_SQL = _TRACK_SQL | {"tracks": f"array<struct<{','.join(f'{n}:{t}' for n, t in _TRACK_SQL.items())}>>", "error": "string"}


def media_columns(df: DataFrame, column: str = "content") -> DataFrame:
    """df's columns (all but `column`) with what `probe` finds in the containers in `column`."""
    kept = [c for c in df.columns if c != column]
    taken = {c.lower() for c in kept}
    names = [f"media_{n}" if n in taken else n for n, _ in _MEDIA]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes if c != column), *(f"`{n}` {t}" for n, t in zip(names, _MEDIA_SQL.values(), strict=True))])

    def run(batches):
        for b in batches:
            found = pa.Table.from_pylist([probe(x) for x in b.column(column).to_pylist()], schema=pa.schema(_MEDIA)).combine_chunks()
            cols = [b.column(c) for c in kept] + [found.column(i).combine_chunks() for i in range(found.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, *names])

    return df.select(*kept, column).mapInArrow(run, schema)


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration long, n_keyframes long, keyframe_bytes long"


def store_documents(docs: DataFrame) -> DataFrame:
    """Stores every text, reads the stored bytes back through the sample tables, and describes them (columns STORED)."""

    def run(batches):
        for b in batches:
            rows = []
            for text in utf8(b.column("text")):
                stored = mux(padded(text))
                track = tracks(stored)[0]
                payload = read_payload(stored, track)
                keys = key_ranges(track, len(stored))
                spans = hashlib.md5(b"".join(struct.pack(">QQ", *r) for r in keys)).hexdigest()
                feature = f"codec={track['codec']};timescale={track['timescale']};duration={track['duration']};samples={track['n']};keyframes={len(keys)};first={keys[0][0]}-{keys[0][1]};last={keys[-1][0]}-{keys[-1][1]};ranges={spans}"
                rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, track["codec"], track["duration"], len(keys), sum(z - a for a, z in keys)))
            cols = list(zip(*rows, strict=True)) or [()] * 11
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in STORED.split(", ")])

    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text").mapInArrow(run, STORED)
