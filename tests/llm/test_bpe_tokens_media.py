import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from conftest import EDGE

from streamloom.llm import bpe, media, token_counts

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return bpe.Bpe(bpe.read_ranks(open(RANKS, "rb").read()), P.PATTERN)


@pytest.fixture(scope="module")
def reference(coder):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def test_same_ids_as_the_library(coder, reference):
    rng = random.Random(1)
    pieces = ["a", "b", "e", "th", "ing", " ", "  ", "\n", "é", "ß", "中", "\U0001f600", "1", "23", "'s", "#", "___", "====", "\t", "the ", "The", " ", "\x1c", "\x85", "<|endoftext|>"]
    for _ in range(3000):
        s = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))
        ids = coder.encode(s)
        assert ids == reference.encode_ordinary(s)
        assert coder.decode(ids) == s.encode()
    for s in ("a" * 4000, "ab" * 2000, " " * 3000, "aé" * 2000, "=" * 3000, "\n" * 999, "".join(rng.choice("abcdefgh") for _ in range(5000))):
        assert coder.encode(s) == reference.encode_ordinary(s)


def test_other_vocabulary():
    ranks = bpe.read_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    own, lib = bpe.Bpe(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for s in ("Une phrase avec des accents: éèê", "Straße und Grüße", "niño pequeño", "xqzv" * 50):
        assert own.encode(s) == lib.encode_ordinary(s)


def test_digests_on_edge_rows(edge, none, reference):
    rows = bpe.encode_digests(edge, RANKS, P.PATTERN).collect()
    want = []
    for i, t, *_ in EDGE:
        ids = reference.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in map(tuple, rows)) == sorted(want)
    assert bpe.encode_digests(none, RANKS, P.PATTERN).count() == 0
    encoded = bpe.encode_documents(edge, RANKS, P.PATTERN)
    back = bpe.decode_documents(encoded, RANKS, P.PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in back) == sorted((str(r[0]), (r[1] or "").encode()) for r in EDGE)


def test_token_counts(spark, edge, none, reference, tmp_path):
    want = sorted((str(i), len(reference.encode_ordinary(t or ""))) for i, t, *_ in EDGE)
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_counts.count_documents(edge, RANKS, P.PATTERN).collect()) == want
    uri = f"file://{tmp_path}/small"
    token_counts.write_token_files(edge.coalesce(2), uri, RANKS, P.PATTERN, block_tokens=7)
    found = token_counts.count_tokens(spark, uri).collect()
    assert sorted(r.n_tokens for r in found) == sorted(n for _, n in want) and all(r.closed for r in found)
    assert token_counts.count_documents(none, RANKS, P.PATTERN).count() == 0


def test_scan_stitches_foreign_files(spark, tmp_path):
    rng, eod = np.random.default_rng(2), 9
    ids = rng.integers(0, 10, 4000).astype("<u2")
    ids[1000:1900] = 1  # one document over many blocks
    cuts = [0, 3, 3, 700, 1100, 1500, 2500, 4000]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        (tmp_path / f"tokens-000001-{k:08d}.bin").write_bytes(ids[a:b].tobytes())
    want, begin = [], 0
    for at in [*np.flatnonzero(ids == eod).tolist(), None]:
        end = len(ids) if at is None else at
        if at is not None or end > begin:
            want.append((len(want), end - begin, begin, at is not None))
        begin = end + 1
    for block_bytes in (64, 1 << 20):  # also ranges within a file
        got = token_counts.count_tokens(spark, str(tmp_path), eod=eod, block_bytes=block_bytes)
        assert sorted((r.ordinal, r.n_tokens, r.begin, r.closed) for r in got.collect()) == want


def test_ids_that_do_not_fit_are_refused(edge, tmp_path):
    for eod, width in ((5, 2), (70_000, 2), (50_256, 1)):
        with pytest.raises(ValueError):
            token_counts.write_token_files(edge, f"file://{tmp_path}/x", RANKS, P.PATTERN, eod=eod, width=width)


def test_media_round_trip(edge, none):
    rows = media.store_documents(edge).collect()
    for r in rows:
        assert r.payload_bytes % 192 == 0 and r.payload_bytes >= 192 and r.codec == "raw "
    by = {str(r.doc_id): r for r in rows if r.doc_id != 6}
    for i, t, *_ in EDGE:
        if i != 6:
            data = (t or "").encode()
            data += b" " * (-len(data) % 192 or (0 if data else 192))
            r = by[str(i)]
            assert (r.n_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
    assert by["1"].media_sha256 == by["2"].media_sha256 and by["1"].feature == by["2"].feature
    assert media.store_documents(none).count() == 0


def test_media_probe(spark):
    for n in (1, 63, 64, 65, 256, 257, 1000):
        payload = bytes(i % 251 for i in range(192 * n))
        stored = media.mux(payload)
        track = media.tracks(stored)[0]
        assert media.read_payload(stored, track) == payload
        keys = media.key_ranges(track, len(stored))
        assert [stored[a:b] for a, b in keys] == [payload[i * 192 : i * 192 + 192] for i in range(0, n, media.KEY_EVERY)]
    bad = [None, b"", b"junk", stored[:200], stored[:-9], stored[:40] + b"\xff" * 60 + stored[100:], stored.replace(b"stsz", b"free")]
    rows = media.media_columns(spark.createDataFrame([(i, x) for i, x in enumerate([stored, *bad])], "id int, content binary")).orderBy("id").collect()
    assert rows[0].error is None and rows[0].duration == 192_000 and len(rows[0].key_ranges) == 16
    assert all(r.error or r.id == 6 for r in rows[1:])


def entry(kind, n=1):
    return media.box(b"stsd", struct.pack(">II", 0, 1), media.box(kind, bytes(6), struct.pack(">H", 1), bytes(70)))


def track(number, handler, codec, *tables, duration=0):
    return media.box(
        b"trak",
        media.full(b"tkhd", struct.pack(">IIIII", 0, 0, number, 0, duration), bytes(60)),
        media.box(b"mdia", media.full(b"mdhd", struct.pack(">IIII", 0, 0, 1000, duration), bytes(4)), media.full(b"hdlr", bytes(4), handler, bytes(13)), media.box(b"minf", media.box(b"stbl", entry(codec), *tables))),
    )


def test_all_tracks_compact_sizes_and_fragments(spark):
    """An audio track with 4-bit sizes before a video track whose samples are in fragments."""
    ftyp, audio = media.box(b"ftyp", b"isom", bytes(4)), b"abbcccdd"
    first = media.box(b"mdat", audio)
    sizes = media.full(b"stz2", bytes((0, 0, 0, 4)), struct.pack(">I", 4), bytes((0x12, 0x32)))
    a = track(1, b"soun", b"mp4a", sizes, media.full(b"stsc", struct.pack(">IIII", 1, 1, 3, 1)), media.full(b"stco", struct.pack(">III", 2, len(ftyp) + 8, len(ftyp) + 14)), duration=77)
    none = [media.full(b"stsz", struct.pack(">II", 0, 0)), media.full(b"stsc", struct.pack(">I", 0)), media.full(b"stco", struct.pack(">I", 0))]
    moov = media.box(b"moov", a, track(2, b"vide", b"avc1", *none), media.box(b"mvex", media.full(b"trex", struct.pack(">IIIII", 2, 1, 40, 5, 0x10000))))

    def moof(offset):
        one = media.full(b"trun", struct.pack(">IiI", 3, offset, 0), struct.pack(">III", 3, 4, 2), flags=0x205)
        two = media.full(b"trun", struct.pack(">I", 2), flags=0)
        return media.box(b"moof", media.full(b"mfhd", struct.pack(">I", 1)), media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 2), flags=0x20000), one, two))

    size = len(moof(0))
    data = ftyp + first + moov + moof(size + 8) + media.box(b"mdat", b"KKKnnnnppQQQQQRRRRR")
    found = media.tracks(data)
    assert media.read_payload(data, found[0]) == audio and media.read_payload(data, found[1]) == b"KKKnnnnppQQQQQRRRRR"
    assert [data[x:y] for x, y in media.key_ranges(found[0], len(data))] == [b"a", b"bb", b"ccc", b"dd"]
    assert [data[x:y] for x, y in media.key_ranges(found[1], len(data))] == [b"KKK"]
    r = media.media_columns(spark.createDataFrame([(1, "mine", data)], "id int, codec string, content binary")).first()
    assert (r.codec, r.media_codec, r.handler, r.duration, r.n_samples) == ("mine", "avc1", "vide", 200, 5)
    assert [(t.track_id, t.codec, t.duration, t.n_samples) for t in r.tracks] == [(1, "mp4a", 77, 4), (2, "avc1", 200, 5)]
    assert media.probe(data[:-3])["error"]


def test_small_memos_change_nothing(coder, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNKS_KEPT", 3)
    monkeypatch.setattr(bpe, "PIECES_KEPT", 2)
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 5)
    own, rng = bpe.Bpe(coder.ranks, P.PATTERN), random.Random(8)
    for _ in range(200):
        text = " ".join(rng.choice(("alpha", "beta's", "gamma\n", "", "1234", "über", "...")) + rng.choice("abc") for _ in range(rng.randrange(60)))
        assert own.encode(text) == reference.encode_ordinary(text)
