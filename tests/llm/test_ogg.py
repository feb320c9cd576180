import hashlib
import random
import struct
import zlib

import pytest

from lumenquad.llm import ogg
from lumenquad.llm.ogg import OggError, Reader, checksum, decode, encode, op13_ogg_media, page, pages_of, read, stored


def plain_checksum(data):
    """The container's polynomial, bit by bit."""
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc >> 31 else crc << 1 & 0xFFFFFFFF
    return crc


def test_checksum():
    r = random.Random(1)
    for n in (0, 1, 5, 300):
        data = r.randbytes(n)
        assert checksum(data) == checksum(data[:2], data[2:]) == plain_checksum(data)


def plain_pages(raw):
    """(flags, granule, serial, sequence, lacing, body) of each page by the layout of the format, checksums verified."""
    out, at = [], 0
    while at < len(raw):
        assert raw[at : at + 5] == b"OggS\0"
        flags, (granule,), (serial, sequence, crc), n = raw[at + 5], struct.unpack_from("<q", raw, at + 6), struct.unpack_from("<III", raw, at + 14), raw[at + 26]
        lacing = list(raw[at + 27 : at + 27 + n])
        end = at + 27 + n + sum(lacing)
        assert plain_checksum(raw[at : at + 22] + bytes(4) + raw[at + 26 : end]) == crc
        out.append((flags, granule, serial, sequence, lacing, raw[at + 27 + n : end]))
        at = end
    return out


@pytest.mark.parametrize("segments", [1, 2, 3, 32, 255])
def test_packets_of_any_length(segments):
    r = random.Random(segments)
    packets = [b"head"] + [r.randbytes(n) for n in (0, 1, 254, 255, 256, 510, 0, 765, 3000, 255)]
    raw = b"".join(pages_of(packets, 77, segments))
    laid = plain_pages(raw)
    assert [p[3] for p in laid] == list(range(len(laid))) and laid[0][0] == 2 and laid[-1][0] & 4 and all(p[2] == 77 and len(p[4]) <= segments for p in laid)
    got, starts = list(Reader(raw)), [None]
    for p in packets[1:]:
        starts.append((starts[-1] or 0) + (len(packets[len(starts) - 1]) if len(starts) > 1 else 0))
    assert [p.data for p in got] == packets and [p.start for p in got] == starts
    # A page on which no packet ends has no granule position; one that goes on with a packet says so.
    assert all((p[1] == -1) == all(v == 255 for v in p[4]) for p in laid)
    assert all(bool(b[0] & 1) == (a[4][-1] == 255) for a, b in zip(laid, laid[1:], strict=False))


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 1152, 5000, 60_000])
def test_round_trip(n):
    raw = random.Random(n).randbytes(n)
    media = encode(raw)
    payload, told = decode(media)
    assert payload == raw + b"\xff" * (len(payload) - n) and len(payload) % 576 == 0 and 0 < len(payload) < max(n, 1) + 576
    assert told["n_bytes"] == n and told["streams"] == 2 and told["pages"] == len(plain_pages(media)) and told["packets"] == len(payload) // 576 + 2
    assert told["end_us"] == -(-len(payload) // 1152) * 576 * 125
    x = [b - 128 for b in payload]
    energy = [sum(v * v for v in x[i : i + 576]) for i in range(0, len(x), 576)]
    assert told["energy"] == sum(energy) and told["peak"] == max(energy) and told["loudest_us"] == energy.index(max(energy)) // 2 * 576 * 125
    assert told["crossings"] == sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))


def test_two_streams_and_pages_over_which_packets_go_on():
    laid = plain_pages(encode(bytes(range(256)) * 200))
    assert [p[0] & 2 for p in laid[:3]] == [2, 2, 0] and len({p[2] for p in laid}) == 2 and any(p[0] & 1 for p in laid) and sum(p[0] >> 2 & 1 for p in laid) == 2


def test_damage_is_told():
    media = encode(b"some text " * 3000)
    r = random.Random(3)
    for _ in range(300):
        at = r.randrange(len(media))
        with pytest.raises(OggError):
            decode(media[:at] + bytes([media[at] ^ 1 << r.randrange(8)]) + media[at + 1 :])
    for cut in (b"", media[:20], media[:-1], media[1:], media + b"x"):
        with pytest.raises(OggError):
            decode(cut)
    at = [0]
    for p in plain_pages(media):
        at.append(at[-1] + 27 + len(p[4]) + len(p[5]))
    whole = [media[a:b] for a, b in zip(at, at[1:], strict=False)]
    for k in range(len(whole)):  # a page lost, or two exchanged within a stream
        with pytest.raises(OggError):
            decode(b"".join(whole[:k] + whole[k + 1 :]))
    with pytest.raises(OggError):
        decode(b"".join([*whole[:2], *whole[4:6], *whole[2:4], *whole[6:]]))
    with pytest.raises(OggError, match="another kind"):
        decode(page(6, 0, 1, 0, b"\4", b"oops"))


def texts():
    return [None, "", "a", "x" * 576, "x" * 577, "é漢😀" * 400, "same", "same", "long " * 200_000]


def test_query(spark, tmp_path):
    rows = [(i, t, "m", 1, "clash", 2) for i, t in enumerate(texts())] + [(None, None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, media string, n_bytes long, error string, payload_bytes long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op13_ogg_media(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        raw, r = (t or "").encode(), got[i]
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes > r.payload_bytes and r.media_sha256 == hashlib.sha256(encode(raw)).hexdigest() and r.error is None and r.feature.startswith("streams=2 ")
    assert got[6][1:] == got[7][1:] and got[0][1:] == got[1][1:] == got[None][1:]


def test_column_as_a_table(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(texts()[:6])), "doc_id long, text string")
    stored(docs).write.parquet(str(tmp_path / "media"))
    table = spark.read.parquet(str(tmp_path / "media"))
    assert sorted(map(str, read(table).collect())) == sorted(map(str, read(stored(docs)).collect()))
    broken = table.selectExpr("doc_id", "case when doc_id = 0 then null when doc_id = 1 then substr(media, 1, 100) else media end as media")
    assert {r.doc_id: r.error for r in read(broken).collect() if r.error} == {0: "no media", 1: "a page is cut off"}
    assert ogg.read(stored(docs.limit(0))).count() == 0
