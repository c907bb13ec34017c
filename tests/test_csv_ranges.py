"""A CSV file cut into byte ranges against the same file read as one."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from runlens.sources import csv_groups, csv_ranges, files


def written(path, rows, end="\n", last=True):
    text = io.StringIO()
    csv.writer(text, lineterminator=end).writerows(rows)
    data = text.getvalue()
    path.write_bytes((data if last else data[: -len(end)]).encode())


def random_rows(seed, n=60, width=4):
    rng = random.Random(seed)
    pieces = ["a", "é", ",", "\n", '"', "\r\n", " ", "0", "x" * 9]
    cell = lambda: "".join(rng.choice(pieces) for _ in range(rng.randint(0, 6)))
    return [[f"c{i}" for i in range(width)], *[["r", *[cell() for _ in range(width - 1)]] for _ in range(n)]]


def read(spark, folder, range_bytes, width=4):
    found = csv_ranges.read_ranges(files.list_files(spark, str(folder)), width, range_bytes)
    return [r.cells for r in found.orderBy("uri", "block", "line").collect()]


def one_task(spark, folder, width=4):
    return [r.cells for r in csv_groups.read_cells(spark, str(folder), width).orderBy("uri", "block", "line").collect()]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_line_breaks(spark, tmp_path, seed, end):
    rows = random_rows(seed)
    written(tmp_path / "one.csv", rows, end, last=seed % 2 == 0)
    kept = (lambda c: c.replace("\r\n", "\n")) if end == "\r\n" else (lambda c: c)
    expected = [[kept(c) or None for c in r] for r in rows[1:]]
    for size in (2, 61, 1 << 20):
        assert read(spark, tmp_path, size) == expected, size
    assert [[c or None for c in r] for r in one_task(spark, tmp_path)] == expected


def test_ranges_know_their_state(spark, tmp_path):
    """The state at every byte is that of a reader from the start."""
    rows = random_rows(11, n=12)
    written(tmp_path / "one.csv", rows)
    data = (tmp_path / "one.csv").read_bytes()
    found = csv_ranges.entered(csv_ranges.survey(csv_ranges.file_ranges(files.list_files(spark, str(tmp_path)), 3))).collect()
    assert len(found) == -(-len(data) // 3) and not any(r.whole for r in found)
    for r in found:
        assert r.quoted == (data[: r.begin].count(b'"') % 2 == 1)


def test_short_long_and_blank_lines(spark, tmp_path):
    (tmp_path / "one.csv").write_text('a,b\n1,2\n\n3\n4,5,6\n"",7\n"x\ny",\n')
    expected = [["1", "2"], ["3", None], ["4", "5"], [None, "7"], ["x\ny", None]]
    for size in (1, 5, 100):
        assert read(spark, tmp_path, size, 2) == expected
    assert [[c or None for c in r] for r in one_task(spark, tmp_path, 2)] == expected


@pytest.mark.parametrize("text", ['a,b\n5" pipe,1\n6" pipe,"2\n3"\n', "a,b\r1,2\r3,4\r", 'a,b\n1,"x"y\n2,3\n'])
def test_odd_quotes_are_read_as_one(spark, tmp_path, text):
    (tmp_path / "one.csv").write_bytes(text.encode())
    expected = [r for r in csv.reader(io.StringIO(text, newline=""))][1:]
    for size in (2, 5, 100):
        assert read(spark, tmp_path, size, 2) == expected


def test_marks_empty_files_and_bad_bytes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"")
    (tmp_path / "b.csv").write_bytes(b'\xef\xbb\xbf"a",b\n1,2\n')
    (tmp_path / "c.csv").write_bytes(b"a,b\n")
    (tmp_path / "d.csv").write_bytes(b"a,b\n\xff,1\n")
    for size in (2, 100):
        assert read(spark, tmp_path, size, 2) == [["1", "2"], ["�", "1"]]


def test_large_files_of_a_tree_are_cut(spark, tmp_path):
    """Groups above the range size come in several blocks and give the same rows."""
    folder = tmp_path / "Tranche_A" / "Session_1" / "cipheron_1" / "traffic_generator"
    folder.mkdir(parents=True)
    rows = [["Time", "PDU Size", "Note"], *[[i, i * 2, "x\ny"] for i in range(300)]]
    written(folder / "220909_125427_UECOMBINED_MACRXSTATS_ALL.csv", rows)
    written(folder / "220909_125427_UECOMBINED_PDCPRXSTATS_ALL.csv", rows[:20])
    tree = files.run_tree(files.walk(spark, str(tmp_path)))
    columns = {"mac_rx": ["pdu size"], "pdcp_rx": ["time"]}
    headers = files.csv_headers(tree.where("is_csv"))
    whole = csv_groups.read_groups(spark, str(tmp_path), tree, headers, columns)
    cut = csv_groups.read_groups(spark, str(tmp_path), tree, headers, columns, range_bytes=700)
    values = lambda df: [(r.tag, r["values"]) for r in df.orderBy("tag", *csv_groups.POSITION).collect()]
    assert values(cut) == values(whole) and len(values(cut)) == 319
    assert cut.where("tag = 'mac_rx'").agg(F.count_distinct("block")).first()[0] > 3
    assert cut.where("tag = 'pdcp_rx'").agg(F.count_distinct("block")).first()[0] == 1
