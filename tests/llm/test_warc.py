"""Archives: exact round trip, revisit rules, and odd rows."""
import base64
import gzip
import glob
import hashlib
import io

from marketframe.llm import warc

ROWS = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (9, None, "same"), (3, "http://b/\r\nx", "other é\r\n\r\nWARC/1.1 \x00"), (4, "u", None), (5, "u", ""),
        (6, "u", "z" * 200_000), (None, "u", "same"), (None, "u", "alone"), (7, "u", "twice"), (7, "u", "twice")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, winner int")


def want(rows, least=0):
    out = []
    for k, _, h in rows:
        body = (h or "").encode()
        same = [x for x, _, y in rows if (y or "") == (h or "") and x is not None]
        revisit = len(body) >= least and bool(same) and k != max(same)
        out.append((k, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", max(same) if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    for least in (0, 5):
        path = str(tmp_path / f"a{least}")
        found = warc.archive(frame(spark), path, least, archive_mb=1)
        rows = found.collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == want(ROWS, least)
        full = {str(r.page_id): r.html for r in warc.expand(found).collect()}
        assert all(full[str(k)] in {y or "" for x, _, y in ROWS if x == k} for k, _, h in ROWS)


def test_archives_are_gzip_members_of_records(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.archive(frame(spark), path)
    seen = 0
    for name in glob.glob(path + "/part-*"):
        data = open(name, "rb").read()
        assert data[:2] == b"\x1f\x8b"
        for fields, block in warc.parse(io.BytesIO(gzip.decompress(data))):
            seen += 1
            assert len(block) == int(fields["Content-Length"])
            if fields["WARC-Type"] == "revisit":
                assert fields["WARC-Refers-To"] == warc.record_id(int(fields["X-Refers-To-Page"]))
    assert seen == len(ROWS)


def test_empty_table(spark, tmp_path):
    assert warc.archive(frame(spark, []), str(tmp_path / "e")).count() == 0
