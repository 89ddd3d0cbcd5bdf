import hashlib
import io

import pytest

from terrasift.llm import warc


def archive(records, dictionary=b"some shared words"):
    out = io.BytesIO()
    w = warc.ArchiveWriter(out, dictionary)
    for r in records:
        w.add(r)
    return out.getvalue()


def test_round_trip_of_the_format():
    bodies = [b"", b"<p>some shared words</p>" * 900, "é\r\n\r\n".encode() * 50]
    records = [warc.make_record(i, "http://a/b c\r\nX: y", b, 9 if i == 1 else None) for i, b in enumerate(bodies)]
    for dictionary in (b"", b"some shared words", warc.make_dictionary(records * 40)):
        got = [warc.parse_record(r) for r in warc.read_records(io.BytesIO(archive(records, dictionary)), 100)]
        assert [g["payload"] for g in got] == [bodies[0], None, bodies[2]]
        assert [g["refers_to"] for g in got] == [None, 9, None]
        assert [(g["payload_bytes"], g["payload_digest"]) for g in got] == [(len(b), hashlib.sha1(b).hexdigest()) for b in bodies]


def test_damage_is_found():
    record = warc.make_record(1, "u", b"payload", None)
    data = archive([record])
    for bad in (data[4:], data[:10], data[:-3], data[:-9] + b"\0" * 9):
        with pytest.raises(warc.WarcError):
            [warc.parse_record(r) for r in warc.read_records(io.BytesIO(bad))]
    for bad in (record.replace(b"WARC/1.1", b"WARC/9"), record[:-1], record.replace(b"payload\r", b"pAyload\r"), record.replace(b"WARC-Date: ", b"Date ")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)


def test_pages_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 5000)
    long_, other = "x" * 1000, "é" * 500
    rows = [(1, "u", long_), (5, None, long_), (3, "v", long_), (5, None, long_), (7, "w", "short"), (8, "w", "short"), (9, "z", None), (None, "n", long_), (2, "q", other), (10, "q", "a" * 999), (11, "q", "a" * 999)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "page_id long, url string, html string, n int").repartition(3)
    manifest = warc.write_archives(df)
    got = sorted((r.page_id or 0, r.url, r.record_type, r.refers_to, r.payload and bytes(r.payload), r.payload_bytes, r.payload_digest) for r in warc.read_archives(manifest).collect())
    want = []
    for p, u, h in rows:
        body = (h or "").encode()
        revisit = h == long_ and p in (1, 3)
        want.append((p or 0, u, "revisit" if revisit else "response", 5 if revisit else None, None if revisit else body, len(body), hashlib.sha1(body).hexdigest()))
    assert got == sorted(want)
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0
