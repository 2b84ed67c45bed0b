"""Foreign ARC files: broken ones beside good ones, odd heads and dates, equal records in two files."""

import gzip

import pytest

from tidemark.llm import warc


def records(*urls):
    return [(u, "1.2.3.4", "20200102030405", "text/html", b"HTTP/1.1 200 OK\r\nX-Row-Id: abc\r\n\r\n<p>" + u.encode()) for u in urls]


def test_a_broken_file_is_a_row_beside_the_good_ones(spark, tmp_path):
    whole = warc.arc_file(1, records("http://a/1", "http://a/2"))
    (tmp_path / "good.arc").write_bytes(whole)
    (tmp_path / "cut.arc").write_bytes(whole[:-20])
    (tmp_path / "odd.arc").write_bytes(b"no archive at all\n")
    (tmp_path / "cut.arc.gz").write_bytes(gzip.compress(whole)[:-30])
    (tmp_path / "bad.arc.gz").write_bytes(b"not gzip")
    (tmp_path / "empty.arc").write_bytes(b"")
    got = warc.convert_arc_files(spark, str(tmp_path)).collect()
    by = {}
    for r in got:
        by.setdefault(r.path.rsplit("/", 1)[1], []).append((r.warc is not None, r.error is not None))
        assert (r.warc is None) == (r.error is not None)
    assert by.pop("good.arc") == [(True, False)] * 2
    assert by.pop("cut.arc") == [(True, False), (False, True)]
    assert by.pop("odd.arc") == by.pop("bad.arc.gz") == [(False, True)]
    assert by.pop("cut.arc.gz")[-1] == (False, True)
    assert by in ({}, {"empty.arc": [(False, True)]})


def test_foreign_heads_are_no_numbers_and_files_are_told_apart(spark, tmp_path):
    for name in ("x.arc", "y.arc"):
        (tmp_path / name).write_bytes(warc.arc_file(2, [("http://a/1", "1.2.3.4", "20200102030405", "text/html", b"HTTP/1.1 200 OK\r\nX-Row-Id: 7\r\n\r\nbody")]))
    got = warc.convert_arc_files(spark, str(tmp_path)).collect()
    ids = [line.split(b": ")[1] for r in got for line in bytes(r.warc).split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(set(ids)) == 2 and all(warc.row_of(i.decode()) is None for i in ids)
    again = warc.convert_arc_files(spark, str(tmp_path)).collect()
    assert sorted(bytes(r.warc) for r in again) == sorted(bytes(r.warc) for r in got)


@pytest.mark.parametrize(
    ("date", "iso"),
    [("20200102030405", "2020-01-02T03:04:05Z"), ("2020", "2020-01-01T00:00:00Z"), ("20201399", "2020-01-01T00:00:00Z"), ("20200230", "2020-02-01T00:00:00Z"), ("20200229246161", "2020-02-29T00:00:00Z"), ("", "1970-01-01T00:00:00Z"), ("x", "1970-01-01T00:00:00Z"), ("0000", "1970-01-01T00:00:00Z"), ("0999", "0999-01-01T00:00:00Z"), ("2020010203040599", "2020-01-02T03:04:05Z"), ("٢٠٢٠", "1970-01-01T00:00:00Z")],
)
def test_dates(date, iso):
    assert warc.warc_date(date) == iso
