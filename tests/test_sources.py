"""Delimited text and checksums in ranges against Python's csv module and hashlib."""

import csv
import hashlib
import io
import random

import pytest

from plantscope.sources import delimited
from plantscope.sources import tables as src

RANGE_BYTES = "spark.sql.files.maxPartitionBytes"


@pytest.fixture(params=["134217728", "211"])
def ranges(spark, request):
    """Files in one range, and in ranges that cut cells, quotes and records."""
    before = spark.conf.get(RANGE_BYTES)
    spark.conf.set(RANGE_BYTES, request.param)
    yield int(request.param)
    spark.conf.set(RANGE_BYTES, before)


def table(n, seed, letters):
    rng = random.Random(seed)

    def cell():
        return "".join(rng.choice(letters) for _ in range(rng.randrange(6)))

    return [[str(i), cell(), cell()] for i in range(n)]


def text_of(rows, sep=",", end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, delimiter=sep, lineterminator=end)
    writer.writerow(["k", "a", "b\nc"])
    writer.writerows(rows)
    return out.getvalue()


def read(spark, path, **kw):
    return sorted((tuple(r) for r in src.read_csv(spark, str(path), **kw).collect()), key=lambda r: int(r[0]))


def test_quoted_line_feeds_in_ranges(spark, tmp_path, ranges):
    rows = table(60, 5, ["a", '"', ",", "\n", "\n\n", "é", " "])
    (tmp_path / "x.csv").write_text(text_of(rows), newline="")
    got = src.read_csv(spark, str(tmp_path / "x.csv"))
    assert got.columns == ["k", "a", "b\nc"]
    assert read(spark, tmp_path / "x.csv") == [tuple(r) for r in rows]
    if ranges < 1000:
        assert delimited.lines_of(spark, str(tmp_path / "x.csv"), "utf-8").select("block").distinct().count() > 3


def test_other_encodings_in_ranges(spark, tmp_path, ranges):
    # the second bytes of 功 and 許 are a backslash and a bar in big5
    rows = table(40, 6, ["溫", "功", "許", '"', "|", "\n", "a"])
    (tmp_path / "b.csv").write_bytes(text_of(rows, "|", "\r\n").encode("big5"))
    assert read(spark, tmp_path / "b.csv", sep="|", encoding="big5") == [tuple(r) for r in rows]


def test_quotes_inside_plain_cells_are_text(spark, tmp_path):
    (tmp_path / "x.csv").write_text('k,a,b\n1,5" pipe,"x\ny"\n2,6" pipe,z\n\n3,"",q\n4,"p ""q""\n,r"\n')
    assert read(spark, tmp_path / "x.csv") == [("1", '5" pipe', "x\ny"), ("2", '6" pipe', "z"), ("3", "", "q"), ("4", 'p "q"\n,r', "")]


def test_files_with_and_without_line_feeds_in_one_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,a\n1,x\n2\n")
    (tmp_path / "b.csv").write_text('k,a\n3,"x\n\ny"\n')
    assert read(spark, tmp_path) == [("1", "x"), ("2", ""), ("3", "x\n\ny")]
    assert read(spark, tmp_path, multi_line=True) == [("1", "x"), ("2", ""), ("3", "x\n\ny")]
    (tmp_path / "c.csv").write_text('k,a\n4,"x\ny",z\n')
    with pytest.raises(Exception, match="more cells"):
        src.read_csv(spark, str(tmp_path)).select("k").collect()


def test_a_long_cell_of_many_lines(spark, tmp_path, ranges):
    long = "\n".join(f'line {i} "q", ' for i in range(300 if ranges < 1000 else 40_000))
    rows = [["1", "x", long], ["2", long, "y"]]
    (tmp_path / "x.csv").write_text(text_of(rows), newline="")
    assert read(spark, tmp_path / "x.csv") == [tuple(r) for r in rows]


def test_empty_file_has_no_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        src.read_csv(spark, str(tmp_path / "x.csv"))


def test_checksums_in_ranges(spark, tmp_path, ranges):
    rng = random.Random(2)
    contents = {
        "b": b"\n", "c": b"x\r\ny", "d": b"x\ny\n\n", "e": rng.randbytes(3000), "f +%f": b"\xff\n" * 400,
    }
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    want = {n: hashlib.sha256(d).hexdigest() for n, d in contents.items()}
    for below in (0, 100, src.WHOLE_BELOW):
        got = [tuple(r) for r in src.file_checksums(spark, str(tmp_path), below).collect()]
        assert dict(got) == want and len(got) == len(want)
