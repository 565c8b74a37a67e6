"""Matrix, weight and index files; files in several parts."""

import pyarrow as pa
import pytest

from routeloom.sources import text


def put(path, value):
    path.write_text(value)
    return str(path)


@pytest.mark.parametrize(
    "layout, numbers",
    [
        ("LOWER_DIAG_ROW", "0 1 0\n2 4 0 3\n5 6 0"),
        ("UPPER_ROW", "1 2\n3 4 5\n6"),
        ("UPPER_DIAG_ROW", "0 1 2 3 0 4 5 0 6 0"),
        ("FULL_MATRIX", "0 1 2 3\n9 0 4 5\n9 9 0 6\n9 9 9 0"),
    ],
)
def test_matrix(spark, tmp_path, layout, numbers):
    path = put(tmp_path / "m", f"NAME : m\nTYPE: TSP\nDIMENSION : 4\nEDGE_WEIGHT_TYPE: EXPLICIT\nEDGE_WEIGHT_FORMAT : {layout}\nEDGE_WEIGHT_SECTION\n{numbers}\nEOF\n")
    found = sorted(map(tuple, text.read_tsplib_matrix(spark, path).collect()))
    assert found == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 2, 4), (1, 3, 5), (2, 3, 6)]


def test_matrix_of_wrong_size(spark, tmp_path):
    with pytest.raises(ValueError):
        text.read_tsplib_matrix(spark, put(tmp_path / "m", "DIMENSION: 3\nEDGE_WEIGHT_FORMAT: UPPER_ROW\nEDGE_WEIGHT_SECTION\n1 2\n"))


def test_weights(spark, tmp_path):
    assert sorted(map(tuple, text.read_weights(spark, put(tmp_path / "w", "3\n1.5\n-2\n0\n")).collect())) == [(0, 3.5), (1, 0.0), (2, 2.0)]
    assert sorted(map(tuple, text.read_weights(spark, put(tmp_path / "v", "2\n1.5\n0\n")).collect())) == [(0, 1.5), (1, 0.0)]


def test_index_files(spark, tmp_path):
    regions = spark.createDataFrame([(k, 0.0, 1.5, -2.0, 3.0, 4 + k, -1.0) for k in range(5)], "part_id long, x0 double, x1 double, y0 double, y1 double, cnt long, bound double")
    text.write_region_index(regions, "map", 30, str(tmp_path / "r"))
    rows, label, n = text.read_region_index(spark, str(tmp_path / "r"))
    assert (label, n) == ("map", 30) and sorted(rows.collect()) == sorted(regions.collect())
    segments = spark.createDataFrame([(0, 10, 0, 500, 480), (1, 7, 10, 300, 300)], "seg_id long, cnt long, start long, origlen long, newlen long")
    text.write_segment_index(segments, "tour", 17, 800, str(tmp_path / "s"))
    rows, label, n, length = text.read_segment_index(spark, str(tmp_path / "s"))
    assert (label, n, length) == ("tour", 17, 800) and sorted(rows.collect()) == sorted(segments.collect())


def test_parts_are_read_in_order(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    put(folder / "part-0", "4\n0 0\n")
    put(folder / "part-1", "1 1\n2 2\n3.00000000000000000 3.0000000000000000000\n")
    assert sorted(map(tuple, text.read_points2d(spark, str(folder)).collect())) == [(k, float(k), float(k)) for k in range(4)]


def test_matrix_is_written_in_pieces_of_rows(spark, tmp_path):
    """A row's numbers stand in lines of a bounded length, and reading shuffles lines, not numbers."""
    points = [(7 * k - 20, float(k * k % 17), float(k % 5)) for k in range(11)]
    text.write_tsplib_matrix(spark.createDataFrame(points, "id long, x double, y double"), "EUC_2D", path := str(tmp_path / "m"), chunk=4)
    lines = [r[0] for r in text.numbered_lines(spark, path).orderBy("line").collect()]
    assert max(len(x.split()) for x in lines[5:]) == 4 and len(lines) == 5 + 4 * 1 + 4 * 2 + 3 * 3
    want = [(i, j, int(((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 + 0.5)) for i, a in enumerate(points) for j, b in enumerate(points) if i < j]
    found = text.read_tsplib_matrix(spark, path)
    assert sorted(map(tuple, found.collect())) == want
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_matrix_lines_are_counted_where_they_are(spark, tmp_path, monkeypatch):
    """Neither lines nor numbers are shuffled, when written or read, and no more than one copy of the lines is kept beside the file."""
    import os
    import re

    from routeloom.sources import text as module

    values = [" a  b", "a\fb\x0b", "c", "\x0bd \t e", "7 8 9"]
    lines = [x.strip(" \t\r") for x in values]
    for part in (slice(0, 5), slice(1, 4)):
        assert module._word_counts(pa.array(lines)[part]).tolist() == [len(re.split(r"[ \t\n\x0b\f\r]+", x)) for x in lines[part]]
    written, write = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, tag, **options: written.append((tag, df)) or write(df, tag, **options))
    points = [(k, float(k * k % 17), float(k % 5)) for k in range(23)]
    text.write_tsplib_matrix(spark.createDataFrame(points, "id long, x double, y double"), "EUC_2D", path := str(tmp_path / "m"), chunk=4)
    assert [tag for tag, _ in written] == ["matrix-nodes"]
    raw = "".join(open(f"{path}/{f}").read() for f in sorted(os.listdir(path)) if f.startswith("part-"))
    length = lambda a, b: int(((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 + 0.5)
    assert raw.split("SECTION\n")[1].split() == [str(length(a, b)) for i, a in enumerate(points) for b in points[: i + 1]]
    # A file in parts, of which some end within a row, and with lines of one word.
    numbers = raw.split("SECTION\n")[1].split()
    (tmp_path / "parts").mkdir()
    for k, some in enumerate(numbers[j : j + 40] for j in range(0, len(numbers), 40)):
        (tmp_path / "parts" / f"part-{k}").write_text((raw.split("\n0\n")[0] + "\n") * (k == 0) + "\n".join(some[:5]) + "\n\n" + "  ".join(some[5:]) + "\nEOF\n" * (k == 6))
    want = [(a[0], b[0], length(a, b)) for a in points for b in points if a[0] < b[0]]
    for where in (path, str(tmp_path / "parts")):
        written.clear()
        found = text.read_tsplib_matrix(spark, where)
        assert sorted(map(tuple, found.collect())) == want
        assert [tag for tag, _ in written] == ["placed-lines", "token-starts"]
        plan = written[1][1]._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
