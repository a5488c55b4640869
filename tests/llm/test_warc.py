"""Archives read back, byte ranges, odd rows and damage."""

import hashlib

import pytest

from maskwright.llm import warc


def test_round_trip_and_ranges(spark, tmp_path):
    body = "<p>é</p>" * 40
    rows = [(3, "http://a/\r\nX: y", body, "z"), (1, "http://b", body, "z"), (2, None, "", "z"), (5, "u", None, "z"), (4, "u", "x" * 99, "z"), (6, "u", "x" * 99, "z"), (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n", "z"), (9, "u", body, "z"), (None, "n", body, "z"), (None, "m", "q" * 300, "z"), (1, "http://b", body, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, archive string").repartition(4)
    directory = str(tmp_path / "a")
    index = warc.write_archives(pages, directory, archive_bytes=500)
    assert index.select("archive").distinct().count() > 1
    got = warc.read_records(index, directory).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(r[0]) for r in rows)
    for r in got:
        html = next(x[2] for x in rows if x[0] == r.page_id and (x[0] is not None or (x[1] == r.url))) or ""
        raw = html.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        again = len(raw) >= 100 and html == body and r.page_id != 1
        assert (r.record_type, r.refers_to) == (("revisit", 1) if again else ("response", None))
        assert r.payload == (None if again else raw)
    some = warc.read_records(index.where("page_id IN (4, 8)"), directory).collect()
    assert sorted(r.page_id for r in some) == [4, 8]
    # offsets and lengths are those of the files
    for r in index.collect():
        (file,) = (tmp_path / "a" / f"archive={r.archive}").glob("part-*")
        data = file.read_bytes()
        assert data[r.offset :].startswith(b"WARC/1.1\r\n") and data[r.offset + r.length : r.offset + r.length + 4] == b"\r\n\r\n"


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.write_archives(pages, str(tmp_path / "e")), str(tmp_path / "e")).count() == 0


def test_damage_is_found():
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 2\r\n\r\n"
    with pytest.raises(ValueError, match="digest"):
        warc._parse((head + "ab").encode())
    with pytest.raises(ValueError, match="bytes"):
        warc._parse((head + "abc").encode())


def test_ranges_join_neighbours():
    assert list(warc._ranges(["a", "a", "b"], [0, 10, 0], [6, 5, 5])) == [(0, 2), (2, 3)]
    assert list(warc._ranges(["a", "a"], [0, warc.GAP + 20], [6, 5])) == [(0, 1), (1, 2)]
    assert list(warc._ranges(["a", "a"], [0, warc.READ_BYTES - 3], [warc.READ_BYTES - 5, 5])) == [(0, 1), (1, 2)]
    assert list(warc._ranges([], [], [])) == []


def test_bodies_are_shuffled_deflated(spark, tmp_path, monkeypatch):
    """What the archives' shuffle carries is far smaller than the records; the archives hold them whole."""
    carried = tmp_path / "carried"
    carried.mkdir()
    inner = warc._deflated

    def noted(batches):
        for batch in inner(batches):
            (carried / f"{batch.column('page_id')[0].as_py()}").write_text(str(sum(map(len, batch.column("record").to_pylist()))))
            yield batch

    monkeypatch.setattr(warc, "_deflated", noted)
    rows = [(k, "u", f"{k} " + "<li>one of many</li>" * 400) for k in range(20)]
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "a"))
    whole = sum(len(r[2]) for r in rows)
    assert 0 < sum(int(f.read_text()) for f in carried.iterdir()) < whole / 4
    got = {r.page_id: r.payload.decode() for r in warc.read_records(index, str(tmp_path / "a")).collect()}
    assert got == {r[0]: r[2] for r in rows}
