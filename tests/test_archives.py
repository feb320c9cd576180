"""Archives read by ranges, against the standard library's own reader and writer; pages that fail, end early or unsaid."""

import http.server
import io
import json
import random
import re
import threading
import zipfile
from urllib.parse import parse_qs, urlparse

import pytest

from lumenquad.sources import archives, paged, readers
from lumenquad.sources.archives import ZipError, directory, member_bytes, members


def reading(raw, log=None):
    def read(at, n):
        assert at >= 0 and n >= 0
        if log is not None:
            log.append((at, n))
        return raw[at : at + n]

    return read, len(raw)


def archive(files, comment=b"", method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.comment = comment
        for name, data in files:
            z.writestr(name, data)
    return out.getvalue()


def by_library(raw):
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        return [(i.filename, i.file_size, i.compress_size, i.compress_type, i.CRC) for i in z.infolist() if not i.is_dir()], {i.filename: z.read(i) for i in z.infolist()}


def check(raw):
    wanted, contents = by_library(raw)
    read, size = reading(raw)
    found = list(members(read, size))
    assert [m[1:6] for m in found] == wanted
    for _, name, plain, packed, method, crc, at in found:
        assert member_bytes(read, at, packed, plain, method, crc) == contents[name]
    return found


FILES = [("a.mp4", b"x" * 5000), ("d/", b""), ("d/é漢.webm", b""), ("d/b.txt", bytes(range(256)) * 9), ("a" * 300 + ".mkv", b"1")]


@pytest.mark.parametrize("raw", [archive(FILES), archive(FILES, method=zipfile.ZIP_STORED), archive([]), archive(FILES, b"c" * 60_000), b"in front " * 99 + archive(FILES)])
def test_as_the_library_reads(raw):
    check(raw)


def test_an_end_record_in_the_comment():
    raw = archive(FILES, b"PK\5\6 is in this comment, PK\5\6" + bytes(30) + b"twice")
    assert [m[1:] for m in members(*reading(raw))] == [m[1:] for m in check(archive(FILES))]
    assert len(list(members(*reading(archive(FILES) + b"behind")))) == 4


def test_more_entries_than_16_bits(monkeypatch):
    raw = archive([(f"f{i}", b"") for i in range(70_000)], method=zipfile.ZIP_STORED)
    assert len(check(raw)) == 70_000
    check(b"#!/bin/sh\n" + raw)
    log = []
    read, size = reading(raw, log)
    assert sum(1 for _ in members(read, size)) == 70_000 and max(n for _, n in log) <= archives.RANGE and len(log) < 10
    # Sizes and places beyond 32 bits, with the limit lowered: they stand in the zip64 field.
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    check(archive(FILES + [("z", b"y" * 300)]))


def test_reads_the_directory_alone():
    log = []
    raw = archive([(f"v{i}.mp4", random.Random(i).randbytes(200_000)) for i in range(20)], method=zipfile.ZIP_STORED)
    read, size = reading(raw, log)
    assert len(list(members(read, size))) == 20 and sum(n for _, n in log) < 80_000 < size / 40


def test_damage():
    raw = archive(FILES)
    for broken in (b"", b"PK", raw[:-30], raw[:100], raw.replace(b"PK\1\2", b"PK\1\3", 1)):
        with pytest.raises(ZipError):
            list(members(*reading(broken)))
    read, size = reading(raw)
    first = next(members(read, size))
    with pytest.raises(ZipError):
        member_bytes(read, first[6], first[3], first[2], first[4], first[5] ^ 1)
    with pytest.raises(ZipError):
        member_bytes(read, first[6] + 1, first[3], first[2], first[4], first[5])
    assert directory(*reading(raw))[2] == 5


def test_source(spark, tmp_path):
    spark.dataSource.register(archives.ZipIndexSource)
    for name, raw in {"p_2.zip": archive([("e/a.mp4", b"22")]), "p_1.zip": archive([("d/a.MP4", b"1"), ("b.txt", b""), ("c.webm", b"cc")]), "p_3.zip": b"no archive", "q_4.zip": archive(FILES), "p_5.txt": b""}.items():
        (tmp_path / name).write_bytes(raw)
    index = spark.read.format("zip_index").option("prefix", "p_").load(str(tmp_path))
    assert index.rdd.getNumPartitions() == 3
    assert {(r.zip.rsplit("/")[-1], r.member, r.size) for r in index.collect()} == {("p_1.zip", "d/a.MP4", 1), ("p_1.zip", "b.txt", 0), ("p_1.zip", "c.webm", 2), ("p_2.zip", "e/a.mp4", 2), ("p_3.zip", None, None)}
    assert [r.error for r in index.where("member is null").collect()] == ["ZipError: no end record"]
    # Of equal names the last archive counts.
    chosen = readers.archive_members(index)
    assert {(r.video_id, r.zip.rsplit("/")[-1]) for r in chosen.collect()} == {("a", "p_2.zip"), ("c", "p_1.zip")}
    got = {(r.member, r.error and r.error.split(":")[0]): r.content and bytes(r.content) for r in archives.extracted(index).collect()}
    assert got == {("d/a.MP4", None): b"1", ("b.txt", None): b"", ("c.webm", None): b"cc", ("e/a.mp4", None): b"22", (None, "ZipError"): None}
    one = spark.read.format("zip_index").load(f"file://{tmp_path}/q_4.zip, {tmp_path}/p_2.zip")
    assert one.count() == 5 and spark.read.format("zip_index").option("prefix", "none").load(str(tmp_path)).count() == 0


class Server:
    """Answers with a function of (path, query, headers): status, headers, body."""

    def __init__(self, answer):
        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                u = urlparse(self.path)
                status, headers, body = answer(u.path, {k: v[0] for k, v in parse_qs(u.query).items()}, self.headers)
                self.send_response(status)
                for k, v in ({"Content-Length": str(len(body))} | headers).items():
                    self.send_header(k, v)
                self.end_headers()
                if self.command != "HEAD":
                    self.wfile.write(body)

            do_HEAD = do_GET  # noqa: N815

            def log_message(self, *args):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.server.shutdown()
        self.server.server_close()


def test_ranges_over_http():
    raw = archive(FILES, b"comment")

    def answer(path, query, headers):
        if path == "/whole.zip" or "Range" not in headers:
            return 200, {}, raw
        a, b = map(int, re.fullmatch(r"bytes=(\d+)-(\d+)", headers["Range"]).groups())
        return 206, {}, raw[a : b + 1]

    with Server(answer) as s:
        read, size = archives.opened(f"{s.url}/x.zip")
        assert [m[1:] for m in members(read, size)] == [m[1:] for m in check(raw)]
        read, size = archives.opened(f"{s.url}/whole.zip")
        with pytest.raises(ZipError, match="range"):
            list(members(read, size))


def table(rows, total=None, cap=1000, fails=None):
    """Rows by page; `fails`: offset -> list of answers before the good one."""
    fails = {k: list(v) for k, v in (fails or {}).items()}
    asked = []

    def answer(path, query, headers):
        at, n = int(query["offset"]), int(query["length"])
        asked.append((at, n, headers.get("Authorization")))
        if fails.get(at):
            return fails[at].pop(0)
        page = {"rows": [{"row": {"i": i}} for i in range(at, min(at + min(n, cap), rows))]}
        return 200, {}, json.dumps(page | ({} if total is None else {"num_rows_total": total})).encode()

    return answer, asked


def load(spark, url, **options):
    reader = spark.read.format("paged_rows").option("url", url)
    for k, v in ({"wait": 0.01} | options).items():
        reader = reader.option(k, v)
    return sorted(json.loads(r.value)["i"] for r in reader.load().collect())


def test_pages(spark):
    spark.dataSource.register(paged.PagedSource)
    fails = {0: [(503, {"Retry-After": "0"}, b"")], 100: [(429, {}, b""), (200, {}, b'{"rows": [')], 200: [(500, {}, b"")] * 3}
    for rows, total, cap, page in ((250, 250, 1000, 100), (250, None, 1000, 100), (250, 250, 30, 100), (250, None, 7, 90), (1, None, 5, 100), (0, None, 5, 100), (0, 0, 5, 100), (64, None, 100, 8)):
        answer, asked = table(rows, total, cap, fails)
        with Server(answer) as s:
            assert load(spark, f"{s.url}/rows?x=1", page=page, token="t") == list(range(rows)), (rows, total, cap)
        assert {a[2] for a in asked} == {"Bearer t"}
    answer, asked = table(250, 250)
    with Server(answer) as s:
        assert load(spark, s.url, rows=120) == list(range(120))


def test_pages_that_never_come(spark):
    for answer, message in ((table(250, 250, fails={100: [(503, {}, b"")] * 9})[0], "asked 3 times"), (table(250, 250, fails={100: [(404, {}, b"")]})[0], "404"), (table(150, 250)[0], "no row at 150")):
        with Server(answer) as s, pytest.raises(Exception, match=message):
            load(spark, s.url, retries=2)


def test_waits_double_and_follow_the_server():
    waits, answer = [], table(5, 5, fails={0: [(503, {}, b"")] * 3 + [(429, {"Retry-After": "7"}, b""), (503, {"Retry-After": "900"}, b"")]})[0]
    with Server(answer) as s:
        assert paged.Pages({"url": s.url}, waits.append).total() == (5, True)
    assert waits == [0.5, 1.0, 2.0, 7.0, 60.0]
