"""ARC archives of both versions, gzipped and plain, with records that are not as they should be."""

import base64
import gzip
import hashlib
import io

import pytest

from sablefin.llm import warc


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


HTTP = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n"


def v1(url, block, length=None):
    return f"{url} 127.0.0.1 19970102030405 text/html {len(block) if length is None else length}\n".encode() + block + b"\n"


def v2(url, block):
    return f"{url} 10.0.0.1 200001020304 text/html; charset=x 200 {sha(block)} - 0 name.arc {len(block)}\n".encode() + block + b"\n"


def archive(version, records):
    return warc.arc_version_block(version) + b"".join(records)


def test_parse():
    body = HTTP + b"<p>\n1 2 3 4 5\n</p>"
    odd = archive(1, [v1("http://a/with space and 19970101000000 in it", body), b"junk line\nmore junk\n", v1("dns:b", b"1.2.3.4"), v1("http://c", b""), v1("http://d", b"short", 99)])
    got = list(warc.parse_arc(io.BytesIO(odd)))
    assert [(r["url"], r["block"], bool(r["error"])) for r in got] == [
        ("http://a/with space and 19970101000000 in it", body, False), ("", b"", True), ("dns:b", b"1.2.3.4", False), ("http://c", b"", False), ("http://d", b"short\n", True),
    ]
    two = list(warc.parse_arc(io.BytesIO(archive(2, [v2("http://x y", body), v2("http://z", b"")]))))
    assert [(r["url"], r["type"], r["code"], r["version"], r["error"]) for r in two] == [("http://x y", "text/html; charset=x", "200", 2, None), ("http://z", "text/html; charset=x", "200", 2, None)]
    assert list(warc.parse_arc(io.BytesIO(b""))) == []
    assert [r["version"] for r in warc.parse_arc(io.BytesIO(v2("http://x", b"1") + v1("http://y", b"2")))] == [2, 1]  # without a filedesc record each line speaks for itself


@pytest.mark.parametrize("zipped", [False, True])
def test_convert(spark, tmp_path, zipped):
    bodies = [HTTP + f"<p>{i}</p>".encode() * (1 + 40_000 * (i == 3)) for i in range(6)]
    files = {"a": archive(1, [v1(f"http://a/{i} x", b) for i, b in enumerate(bodies)]), "b": archive(2, [v2("dns:q", b"1.2.3.4"), *[v2(f"http://b/{i}", b) for i, b in enumerate(bodies)]]), "c": archive(1, [v1("http://ok", bodies[0]), b"??\n", v1("http://cut", bodies[1], 10**6)]), "d": b""}
    for name, data in files.items():
        if zipped:  # each record a member, as archives are written; the last file breaks off
            data = gzip.compress(data[: len(data) // 2]) + gzip.compress(data[len(data) // 2 :])
        (tmp_path / f"{name}.arc{'.gz' if zipped else ''}").write_bytes(data)
    if zipped:
        (tmp_path / "e.arc.gz").write_bytes(gzip.compress(files["a"])[:40] + b"\x00" * 30)
    paths = spark.createDataFrame([(str(p),) for p in sorted(tmp_path.glob("*.arc*"))], "path string")
    rows = warc.convert_archives(paths, f"{tmp_path}/out").collect()
    by = {}
    for r in rows:
        by.setdefault(r["path"].rsplit("/", 1)[1][0], []).append(r)
    assert [(r["url"], r["payload_digest"]) for r in by["a"]] == [(f"http://a/{i}%20x", sha(b[len(HTTP) :])) for i, b in enumerate(bodies)]
    assert [(r["record_type"], r["payload_bytes"]) for r in by["b"]] == [("resource", 7), *[("response", len(b) - len(HTTP)) for b in bodies]]
    assert [r["error"] is None for r in by["c"]] == [True, False, False] and "d" not in by
    assert not zipped or by["e"][-1]["error"].startswith("broken data")
    for path in {r["warc"] for r in rows if r["warc"]}:
        with open(path, "rb") as f:
            read = list(warc.parse_warc(warc.Members(f)))
        assert [h["WARC-Target-URI"] for h, _ in read] == [r["url"] for r in rows if r["warc"] == path]
        assert all(h["WARC-Payload-Digest"] == f"sha1:{sha(warc.http_payload(b))}" for h, b in read)
