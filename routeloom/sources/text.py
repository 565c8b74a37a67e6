"""Text files of points, edges, tours, vectors and cuts; a line's place in the file is its id."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.norms import length_col
from ..jobs.session import materialize, release
from ..operators.ranking import ranked, running_sum
from ..operators.tours import edges_to_tour, tour_edges


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, line: non-empty lines in the order of file names and lines, written once.

    Spark may read larger files first, so the lines are ranked by file, block and place.
    """
    placed = spark.read.text(path).select(F.btrim("value", F.lit(" \t\r")).alias("value"), "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    order = ["file_path", "file_block_start", "at"]
    return materialize(ranked(placed.filter("value != ''"), order, name="line").select("value", "line"), "lines")


def _words() -> Column:
    return F.split("value", r"\s+")


def _token_starts(lines: DataFrame) -> DataFrame:
    """value, n, start: ``lines`` (value, line) with how many words each has and how many are before it, written once."""
    sizes = lines.select("line", F.size(_words()).cast("long").alias("n"))
    return materialize(lines.join(running_sum(sizes, ["line"], "n", "start"), "line").select("value", "n", "start"), "token-starts")


_SPACES = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))


def _word_counts(values: pa.Array) -> np.ndarray:
    """How many parts ``split`` at white space has for each of ``values``, none of which is empty."""
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1]
    space = _SPACES[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]]
    at = ends - ends[0]
    first = space.copy()  # of a run of white space, which doesn't go on from line to line
    first[1:] &= ~space[:-1]
    first[at[:-1]] = space[at[:-1]]
    return np.diff(np.concatenate([[0], np.cumsum(first)])[at]) + 1


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``n``, the words of a line, and ``before``, those of the lines before it in its split (path, block), whose lines stand together."""
    split, total = None, 0
    for batch in (b for b in batches if b.num_rows):
        n = _word_counts(batch.column("value"))
        before = np.cumsum(n) - n
        for k, now in enumerate(zip(batch.column("path").to_pylist(), batch.column("block").to_pylist())):
            if now != split:
                # What the rows before this one have doesn't count.
                split, total = now, -int(before[k])
            before[k] += total
        total = int(before[-1] + n[-1])
        yield pa.record_batch([*batch.columns, n, before], names=[*batch.schema.names, "n", "before"])


def _placed_words(spark: SparkSession, path: str) -> DataFrame:
    """value, n, start of the non-empty lines: how many words each has and how many are before it in the file.

    Lines aren't shuffled: they are counted where they are, and each split's first place is the sum of those before it.
    """
    split = ["path", "block"]
    lines = spark.read.text(path).select(F.btrim("value", F.lit(" \t\r")).alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    placed = materialize(lines.filter("value != ''").mapInArrow(_counted_words, "value string, path string, block long, n long, before long"), "placed-lines", compression="zstd")
    # A row for each split of the files.
    offsets = placed.groupBy(*split).agg(F.sum("n").alias("all")).select(*split, F.coalesce(F.sum("all").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    starts = materialize(placed.join(F.broadcast(offsets), split).select("value", "n", (F.col("offset") + F.col("before")).alias("start")), "token-starts", compression="zstd")
    release(placed)
    return starts


def _tokens(starts: DataFrame) -> DataFrame:
    return starts.select("start", F.posexplode(_words()).alias("at", "t")).select("t", (F.col("start") + F.col("at")).alias("k"))


def numbered_tokens(lines: DataFrame) -> DataFrame:
    """t, k: the words of ``lines`` (value, line) in their order; only lines are shuffled, not words."""
    return _tokens(_token_starts(lines))


def _header(lines: DataFrame, start: int) -> dict[str, str]:
    """``KEY : value`` lines before line ``start``; only these reach the driver."""
    found = lines.filter(F.col("line") < start).select("value").collect()
    return {k.strip(): v.strip() for k, v in (x.split(":", 1) for (x,) in found if ":" in x)}


def _fields(lines: DataFrame, names: list[str], kinds: list[str], skip: int) -> DataFrame:
    parts = F.split("value", r"\s+")
    return lines.filter(F.col("line") >= skip).select((F.col("line") - skip).alias("id"), *[F.try_element_at(parts, F.lit(k + 1)).try_cast(t).alias(c) for k, (c, t) in enumerate(zip(names, kinds))])


def _counted(rows: DataFrame, want: int, path: str) -> DataFrame:
    found = rows.count()
    if found != want:
        raise ValueError(f"{path}: {want} rows stated, {found} found")
    return rows


def read_points2d(spark: SparkSession, path: str) -> DataFrame:
    """id, x, y of a file ``n`` then ``x y`` per line."""
    lines = numbered_lines(spark, path)
    n = int(lines.filter("line = 0").first()["value"].split()[0])
    return _counted(_fields(lines, ["x", "y"], ["double", "double"], 1), n, path)


def read_points3d(spark: SparkSession, path: str) -> DataFrame:
    lines = numbered_lines(spark, path)
    n = int(lines.filter("line = 0").first()["value"].split()[0])
    return _counted(_fields(lines, ["x", "y", "z"], ["double"] * 3, 1), n, path)


def read_edges(spark: SparkSession, path: str, third: str = "len", kind: str = "long") -> DataFrame:
    """i, j, len of a file ``n m`` then ``i j len`` per line."""
    lines = numbered_lines(spark, path)
    m = int(lines.filter("line = 0").first()["value"].split()[1])
    return _counted(_fields(lines, ["i", "j", third], ["long", "long", kind], 1).drop("id"), m, path)


def read_xvector(spark: SparkSession, path: str) -> DataFrame:
    return read_edges(spark, path, "x", "double")


def read_tour(spark: SparkSession, path: str, tour_id: int = 0) -> DataFrame:
    """tour_id, pos, node of a file ``n`` then nodes, any number of them per line."""
    tokens = materialize(numbered_tokens(numbered_lines(spark, path)).select((F.col("k") - 1).alias("pos"), F.col("t").cast("long").alias("node")), "tour")
    n = tokens.filter("pos = -1").first()["node"]
    return _counted(tokens.filter("pos >= 0").select(F.lit(tour_id).cast("long").alias("tour_id"), "pos", "node"), n, path)


def read_tour_tsplib(spark: SparkSession, path: str, n: int | None = None, tour_id: int = 0) -> DataFrame:
    """tour_id, pos, node of a file with a header and a TOUR_SECTION of numbers from 1, ended by -1.

    ``n``: the number of nodes that DIMENSION has to be.
    """
    lines = numbered_lines(spark, path)
    start = lines.filter(F.col("value").startswith("TOUR_SECTION")).agg(F.min("line")).first()[0]
    header = _header(lines, -1 if start is None else start)
    if start is None or header.get("TYPE") != "TOUR" or n not in (None, int(header.get("DIMENSION", -1))):
        raise ValueError(f"{path}: no tour of {n if n is not None else 'any number of'} nodes: type {header.get('TYPE')}, dimension {header.get('DIMENSION')}")
    tokens = numbered_tokens(lines.filter((F.col("line") > start) & ~F.col("value").startswith("EOF")))
    rows = tokens.select(F.lit(tour_id).cast("long").alias("tour_id"), F.col("k").alias("pos"), (F.col("t").cast("long") - 1).alias("node"))
    return _counted(materialize(rows.filter("node >= 0"), "tour"), int(header["DIMENSION"]), path)


def read_tour_edges(spark: SparkSession, path: str) -> DataFrame:
    """tour_id, pos, node of a tour given as an edge file, which has as many edges as nodes."""
    edges = materialize(read_edges(spark, path), "tour-edges")
    ends = edges.select(F.explode(F.array("i", "j")).alias("node")).distinct().count()
    tour = materialize(edges_to_tour(edges), "tour")
    if edges.count() != ends or tour.count() != ends:
        raise ValueError(f"{path}: the edges aren't one tour")
    return tour


#: Names of edge weight types in instance files, and the norms that they stand for.
WEIGHT_TYPES = {"EUC_2D": "EUC_2D", "EUC_3D": "EUC_3D", "MAX_2D": "MAX_2D", "MAN_2D": "MAN_2D", "CEIL_2D": "CEIL_2D", "GEO": "GEO", "GEOM": "GEOM", "ATT": "ATT"}


def read_tsplib(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """Nodes and norm of an instance with coordinates; only its header reaches the driver."""
    lines = numbered_lines(spark, path)
    start = lines.filter(F.col("value").startswith("NODE_COORD_SECTION")).agg(F.min("line")).first()[0]
    if start is None or lines.filter(F.col("value").startswith("FIXED_EDGES_SECTION")).take(1):
        raise ValueError(f"{path}: not an instance with coordinates and free edges")
    header = _header(lines, start)
    norm = WEIGHT_TYPES.get(header.get("EDGE_WEIGHT_TYPE", ""))
    if header.get("TYPE") != "TSP" or norm is None:
        raise ValueError(f"{path}: type {header.get('TYPE')}, weights {header.get('EDGE_WEIGHT_TYPE')}")
    names = ["number", "x", "y", *["z"] * (norm == "EUC_3D")]
    body = lines.filter((F.col("line") > start) & ~F.col("value").startswith("EOF"))
    rows = _fields(body, names, ["double"] * len(names), start + 1).drop("number")
    return _counted(rows, int(header["DIMENSION"]), path), norm


def _matrix_place(layout: str, k: Column, n: int) -> tuple[Column, Column]:
    """Row and column of the k-th number of a matrix file."""
    if layout == "FULL_MATRIX":
        return F.floor(k / n), k % n
    # Upper rows are the lower triangle's, read from the end.
    rows = n - 1 if layout == "UPPER_ROW" else n
    k = k if layout == "LOWER_DIAG_ROW" else F.lit(rows * (rows + 1) // 2 - 1) - k
    guess = F.floor((F.sqrt(8 * k + 1) - 1) / 2)
    row = F.when(guess * (guess + 1) / 2 > k, guess - 1).when((guess + 1) * (guess + 2) / 2 <= k, guess + 1).otherwise(guess)
    column = k - F.floor(row * (row + 1) / 2)
    return (row, column) if layout == "LOWER_DIAG_ROW" else (F.lit(rows - 1) - row, F.lit(n - 1) - column)


#: Layouts of explicit matrices, and how many numbers one of n nodes has.
MATRIX_LAYOUTS = {"LOWER_DIAG_ROW": lambda n: n * (n + 1) // 2, "UPPER_ROW": lambda n: n * (n - 1) // 2, "UPPER_DIAG_ROW": lambda n: n * (n + 1) // 2, "FULL_MATRIX": lambda n: n * n}


def read_tsplib_matrix(spark: SparkSession, path: str) -> DataFrame:
    """i, j, len with i < j of an explicit matrix, of which the upper triangle counts; numbers may flow across lines."""
    lines = _placed_words(spark, path)
    start = lines.filter(F.col("value").startswith("EDGE_WEIGHT_SECTION")).agg(F.min("start")).first()[0]
    if start is None:
        raise ValueError(f"{path}: no matrix")
    header = _header(lines.withColumnRenamed("start", "line"), start)
    layout, n = header.get("EDGE_WEIGHT_FORMAT", ""), int(header["DIMENSION"])
    if layout not in MATRIX_LAYOUTS:
        raise ValueError(f"{path}: layout {layout}")
    stop = lines.filter((F.col("start") > start) & F.col("value").rlike("^[A-Z]")).agg(F.min("start")).first()[0]
    body = lines.filter((F.col("start") > start) & (F.col("start") < (2**62 if stop is None else stop)))
    found, first = body.agg(F.coalesce(F.sum("n"), F.lit(0)), F.min("start")).first()
    if found != (want := MATRIX_LAYOUTS[layout](n)):
        raise ValueError(f"{path}: {want} rows stated, {found} found")
    starts = body.withColumn("start", F.col("start") - F.lit(first or 0))
    stream = _tokens(starts)
    row, column = (x.cast("long") for x in _matrix_place(layout, F.col("k"), n))
    kept = row < column if layout == "FULL_MATRIX" else row != column
    return stream.select(row.alias("r"), column.alias("c"), F.col("t").cast("double").cast("long").alias("len"), kept.alias("kept")).filter("kept").select(F.least("r", "c").alias("i"), F.greatest("r", "c").alias("j"), "len")


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """id, w of a file ``n``, then a weight per line; shifted so that none is negative."""
    lines = numbered_lines(spark, path)
    n = int(lines.filter("line = 0").first()["value"].split()[0])
    return shift_nonnegative(_counted(_fields(lines, ["w"], ["double"], 1), n, path))


def shift_nonnegative(weights: DataFrame) -> DataFrame:
    """Weights less their minimum if that is negative."""
    low = weights.agg(F.min("w")).first()[0]
    return weights if low is None or low >= 0 else weights.withColumn("w", F.col("w") - F.lit(low))


_REGION = {"part_id": "long", "x0": "double", "x1": "double", "y0": "double", "y1": "double", "cnt": "long", "bound": "double"}
_SEGMENT = {"seg_id": "long", "cnt": "long", "start": "long", "origlen": "long", "newlen": "long"}


def _read_index(spark: SparkSession, path: str, columns: dict[str, str]) -> tuple[DataFrame, list[str]]:
    lines = numbered_lines(spark, path)
    head, count = (r["value"].split() for r in lines.filter("line < 2").orderBy("line").collect())
    return _counted(_fields(lines, list(columns), list(columns.values()), 2).drop("id"), int(count[0]), path), head


def _write_lines(spark: SparkSession, path: str, head: list[str], *parts: DataFrame) -> None:
    """``head`` and then the lines of each part (value, and the columns after it in whose order they stand)."""
    rows = [spark.createDataFrame([(-1, k, v) for k, v in enumerate(head)], "part int, a long, value string").withColumn("b", F.lit(0).cast("long"))]
    for n, part in enumerate(parts):
        _, a, *b = part.columns
        rows.append(part.select(F.lit(n).alias("part"), F.col(a).cast("long").alias("a"), "value", (F.col(b[0]) if b else F.lit(0)).cast("long").alias("b")))
    reduce(DataFrame.unionByName, rows).orderBy("part", "a", "b").select("value").write.text(path)


def _write_index(rows: DataFrame, columns: dict[str, str], head: str, path: str) -> None:
    parts = [F.col(c).cast(t) for c, t in columns.items()]
    _write_lines(rows.sparkSession, path, [head, str(rows.count())], rows.select(F.concat_ws(" ", *parts).alias("value"), next(iter(columns))))


def read_region_index(spark: SparkSession, path: str) -> tuple[DataFrame, str, int]:
    """Regions, label and number of nodes of a file ``label n``, count, then ``id x0 x1 y0 y1 cnt bound`` per line."""
    rows, head = _read_index(spark, path, _REGION)
    return rows, head[0], int(head[1])


def write_region_index(regions: DataFrame, label: str, n: int, path: str) -> None:
    _write_index(regions, _REGION, f"{label} {n}", path)


def read_segment_index(spark: SparkSession, path: str) -> tuple[DataFrame, str, int, int]:
    """Segments, label, number of nodes and tour length of a file ``label n tourlen``, count, then ``id cnt start origlen newlen`` per line."""
    rows, head = _read_index(spark, path, _SEGMENT)
    return rows, head[0], int(head[1]), int(head[2])


def write_segment_index(segments: DataFrame, label: str, n: int, length: int, path: str) -> None:
    _write_index(segments, _SEGMENT, f"{label} {n} {length}", path)


def write_edges(edges: DataFrame, n: int, path: str, third: str = "len") -> None:
    """``n m``, then ``i j len`` lines in (i, j) order; ``third`` may be x instead."""
    body = edges.select(F.concat_ws(" ", "i", "j", F.col(third).cast("string")).alias("value"), "i", "j")
    _write_lines(edges.sparkSession, path, [f"{n} {edges.count()}"], body)


def _numbers(nodes: DataFrame) -> Column:
    dims = [c for c in ("x", "y", "z") if c in nodes.columns]
    return F.format_string(" ".join(["%.6f"] * len(dims)), *[F.col(c).cast("double") for c in dims])


def write_points(nodes: DataFrame, path: str) -> None:
    """``n``, then ``x y`` (and z) with six decimals per line, in the order of ids."""
    _write_lines(nodes.sparkSession, path, [str(nodes.count())], nodes.select(_numbers(nodes).alias("value"), "id"))


def write_tsplib(nodes: DataFrame, norm: str, path: str, name: str = "nodes") -> None:
    """An instance with coordinates; numbers are from 1."""
    if norm not in WEIGHT_TYPES.values():
        raise ValueError(f"norm {norm!r} has no name in such files")
    head = [f"NAME: {name}", "TYPE: TSP", f"DIMENSION: {nodes.count()}", f"EDGE_WEIGHT_TYPE: {norm}", "NODE_COORD_SECTION"]
    body = nodes.select(F.concat_ws(" ", (F.col("id") + 1).cast("string"), _numbers(nodes)).alias("value"), "id")
    _write_lines(nodes.sparkSession, path, head, body, nodes.sparkSession.range(1).select(F.lit("EOF").alias("value"), "id"))


def write_tsplib_matrix(nodes: DataFrame, norm: str, path: str, chunk: int = 2000) -> None:
    """An instance with the lengths between ``nodes`` (id, x, y) as lower rows with the diagonal, in the order of ids.

    A line has ``chunk`` numbers of a row at most. A task gets the nodes up to the end of its bands of rows, of which
    there are four to ``chunk`` nodes; bands are dealt in their order, and a length is made where it is written.
    """
    spark = nodes.sparkSession
    placed = materialize(ranked(nodes, ["id"], name="at").select("at", F.struct("x", "y").alias("p"), F.floor(F.col("at") / chunk).alias("chunk")), "matrix-nodes")
    n = placed.count()
    last, size = max(0, n - 1) // chunk, -(-chunk // 4)
    columns = placed.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("at", "p"))).alias("e"))
    # Later bands have more columns, and get tasks of their own by that.
    held = columns.select("chunk", "e", F.explode(F.sequence(4 * F.col("chunk"), F.lit(4 * last + 3))).alias("band")).repartitionByRange(min(2000, 4 * last + 4), "band")
    bands = held.groupBy("band").agg(F.sort_array(F.collect_list(F.struct("chunk", "e"))).alias("columns")).sortWithinPartitions("band")
    own = F.filter(F.element_at("columns", F.floor(F.col("band") / 4).cast("int") + 1)["e"], lambda e: F.floor(e["at"] % chunk / size) == F.col("band") % 4)
    rows = bands.select("columns", F.explode(own).alias("row"))
    number = lambda e: F.when(e["at"] <= F.col("row.at"), length_col(norm, F.col("row.p"), e["p"])).cast("string")
    line = F.transform(F.filter("columns", lambda c: c["chunk"] * chunk <= F.col("row.at")), lambda c: F.array_join(F.transform(c["e"], number), " "))
    head = ["TYPE: TSP", f"DIMENSION: {n}", "EDGE_WEIGHT_TYPE: EXPLICIT", "EDGE_WEIGHT_FORMAT: LOWER_DIAG_ROW", "EDGE_WEIGHT_SECTION"]
    spark.range(1).coalesce(1).select(F.explode(F.array(*map(F.lit, head))).alias("value")).union(rows.select(F.explode(line).alias("value"))).write.text(path)


def write_weights(weights: DataFrame, path: str) -> None:
    """``n``, then a weight per line, in the order of ids."""
    _write_lines(weights.sparkSession, path, [str(weights.count())], weights.select(F.col("w").cast("string").alias("value"), "id"))


def write_tour(tour: DataFrame, path: str, fmt: str = "nodes", nodes: DataFrame | None = None, norm: str = "EUC_2D") -> None:
    """One tour as ``nodes`` (n, then ten nodes per line), ``tsplib`` (numbers from 1, ended by -1) or ``edges`` (with lengths by ``norm``).

    The closing edge stands last, from the first node to the last.
    """
    spark, n = tour.sparkSession, tour.count()
    if fmt == "nodes":
        rows = tour.groupBy(F.floor(F.col("pos") / 10).alias("row")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"].cast("string")), " ").alias("value"))
        _write_lines(spark, path, [str(n)], rows.select("value", "row"))
    elif fmt == "tsplib":
        head = ["NAME: tour", "TYPE: TOUR", f"DIMENSION: {n}", "TOUR_SECTION"]
        end = spark.createDataFrame([("-1", 0), ("EOF", 1)], "value string, at long")
        _write_lines(spark, path, head, tour.select((F.col("node") + 1).cast("string").alias("value"), "pos"), end)
    elif fmt == "edges":
        e = tour_edges(tour, nodes, norm)
        closing = F.col("pos") == n - 1
        value = F.concat_ws(" ", F.when(closing, F.col("j")).otherwise(F.col("i")), F.when(closing, F.col("i")).otherwise(F.col("j")), "len")
        _write_lines(spark, path, [f"{n} {n}"], e.select(value.alias("value"), "pos"))
    else:
        raise ValueError(f"format {fmt!r}: nodes, tsplib or edges")


def read_rhvectors(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, float]]:
    """Vectors (id, vec of 0, 1 and 2) and parameters d00, d01, d02, d12, d22 and p1 of a vector file.

    The first line is ``count length d00 d01 d02 d12 d22``, each further one ``number label symbols``.
    A null vector is added as id 0. ``p1``: the share of ones among known symbols, 0 if there are none.
    """
    lines = numbered_lines(spark, path)
    n, size, *costs = (int(x) for x in lines.filter("line = 0").first()["value"].split())
    symbols = F.element_at(F.split("value", r"\s+"), -1)
    rows = lines.filter("line > 0").select(F.col("line").alias("id"), symbols.alias("s"))
    if rows.filter((F.length("s") != size) | ~F.col("s").rlike("^[012]*$")).take(1):
        raise ValueError(f"{path}: vectors are {size} symbols 0, 1 or 2")
    count = lambda c: F.sum(F.length("s") - F.length(F.replace("s", F.lit(c))))
    zeros, ones = _counted(rows, n, path).agg(count("0"), count("1")).first()
    vectors = rows.select("id", F.transform(F.split("s", ""), lambda x: x.cast("tinyint")).alias("vec"))
    null = spark.range(1).select("id", F.lit(None).cast(vectors.schema["vec"].dataType).alias("vec"))
    known = (zeros or 0) + (ones or 0)
    return null.unionByName(vectors), dict(zip(("d00", "d01", "d02", "d12", "d22"), costs)) | {"p1": (ones or 0) / known if known else 0.0}


def write_rhvectors(vectors: DataFrame, costs: dict[str, int], path: str) -> None:
    """A vector file of the vectors that aren't null, in the order of ids."""
    rows = vectors.filter("vec is not null")
    n, size = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
    head = " ".join(str(x) for x in (n, size or 0, *(costs[c] for c in ("d00", "d01", "d02", "d12", "d22"))))
    value = F.concat(F.col("id").cast("string"), F.lit(" v"), F.col("id").cast("string"), F.lit(" "), F.array_join(F.transform("vec", lambda x: x.cast("string")), ""))
    _write_lines(vectors.sparkSession, path, [head], rows.select(value.alias("value"), "id"))


def _cut_records(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each file's cuts as rows (file, cut, rhs, clique, node); a record's place is known only from those before it."""
    names = ["file", "cut", "rhs", "clique", "node"]
    for part in files:
        for file, text in zip(part["file"], part["value"]):
            tokens, out, cut = iter(map(int, text.split())), [], 0
            for n_cliques in tokens:
                try:
                    cliques = [[next(tokens) for _ in range(next(tokens))] for _ in range(n_cliques)]
                    rhs = next(tokens)
                except (StopIteration, RuntimeError):
                    raise ValueError(f"{file}: the last cut isn't complete") from None
                out += [(file, cut, rhs, k, node) for k, nodes in enumerate(cliques) for node in nodes]
                cut += 1
                if len(out) > 100_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)


def _reached(start: DataFrame, follow: DataFrame, carried: list[str], within: Column | None = None) -> DataFrame:
    """file, k and the ``carried`` columns of all that ``start`` leads to by ``follow`` (file, k, to), itself included.

    Each round adds what the steps so far lead to from all that is known, and doubles the steps.
    """
    known, steps = materialize(start.select("file", "k", *carried), "reached"), materialize(follow, "steps")
    count = known.count()
    while True:
        more = known.join(steps, ["file", "k"]).select("file", F.col("to").alias("k"), *carried)
        known = materialize(known.unionByName(more if within is None else more.filter(within)).distinct(), "reached")
        before, count = count, known.count()
        if count == before:
            return known
        steps = materialize(_after(steps, steps), "steps")


def _after(first: DataFrame, then: DataFrame) -> DataFrame:
    """file, k, to: both steps, one after the other."""
    return first.withColumnRenamed("to", "_via").join(then.withColumnsRenamed({"k": "_via", "to": "to"}), ["file", "_via"]).select("file", "k", "to")


def _long_cut_records(lines: DataFrame) -> DataFrame:
    """As :func:`_cut_records`, of files given as ``lines`` (file, value, file_block_start, at) that many tasks read.

    Every number is taken for the size of a clique, whose end is then known, and for the number of a
    cut's cliques, which is as many such steps, put together from doubled ones. The records are what
    the first number of a file leads to.
    """
    words = lines.select("file", "file_block_start", "at", F.posexplode(F.split("value", r"\s+")).alias("place", "t"))
    tokens = materialize(ranked(words, ["file_block_start", "at", "place"], ["file"], "k").select("file", "k", F.col("t").cast("long").alias("v")), "tokens")
    ends = tokens.groupBy("file").agg(F.max("k").alias("last"))
    inside = tokens.join(ends, "file")
    clique = materialize(inside.filter((F.col("v") >= 0) & (F.col("k") + F.col("v") + 1 <= F.col("last"))).select("file", "k", (F.col("k") + F.col("v") + 1).alias("to")), "clique-steps")
    # Where the cliques of a cut that begins at k end: its right-hand side.
    open_, steps, done = inside.filter((F.col("v") >= 0) & (F.col("k") < F.col("last"))).select("file", "k", F.col("v").alias("left"), (F.col("k") + 1).alias("to")), clique, None
    while True:
        odd = open_.filter("left % 2 = 1").withColumnRenamed("to", "_at").join(steps.withColumnRenamed("k", "_at"), ["file", "_at"]).drop("_at")
        open_ = materialize(open_.filter("left % 2 = 0").unionByName(odd.select("file", "k", "left", "to")).withColumn("left", F.floor(F.col("left") / 2)), "cut-steps")
        part = open_.filter("left = 0").select("file", "k", "to")
        done = part if done is None else done.unionByName(part)
        open_ = open_.filter("left > 0")
        if not open_.take(1):
            break
        steps = materialize(_after(steps, steps), "clique-steps")
    rhs = materialize(done.withColumnRenamed("to", "rhs_at"), "cut-ends")
    following = rhs.join(ends, "file").filter("rhs_at < last").select("file", "k", (F.col("rhs_at") + 1).alias("to"))
    starts = _reached(ends.select("file", F.lit(0).cast("long").alias("k")), following, [])
    cuts = materialize(ranked(starts.join(rhs, ["file", "k"], "left").select("file", "k", "rhs_at"), ["k"], ["file"], "cut"), "cut-starts")
    torn = cuts.groupBy("file").agg(F.max("rhs_at").alias("end"), F.count_if(F.col("rhs_at").isNull()).alias("open")).join(ends, "file").filter("open > 0 or end != last").take(1)
    if torn:
        raise ValueError(f"{torn[0]['file']}: the last cut isn't complete")
    values = tokens.select("file", F.col("k").alias("rhs_at"), F.col("v").cast("int").alias("rhs"))
    named = cuts.join(values, ["file", "rhs_at"]).select("file", (F.col("k") + 1).alias("k"), "cut", "rhs", "rhs_at")
    cliques = _reached(named.filter("k < rhs_at"), clique, ["cut", "rhs", "rhs_at"], F.col("k") < F.col("rhs_at"))
    placed = ranked(cliques, ["k"], ["file", "cut"], "clique").join(clique, ["file", "k"])
    members = placed.filter("to > k + 1").select("file", "cut", "rhs", "clique", F.explode(F.sequence(F.col("k") + 1, F.col("to") - 1)).alias("k"))
    return members.join(tokens, ["file", "k"]).select("file", "cut", "rhs", "clique", F.col("v").alias("node"))


def read_cuts(spark: SparkSession, path: str, tour: DataFrame | None = None, whole_bytes: int = 1 << 24) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cuts(cut_id, sense, rhs), cut_cliques(cut_id, clique_id) and members(clique_id, node) of cut files.

    For each cut a file has the number of its cliques, for each clique its size and nodes, then the
    right-hand side; the sense is G. With a ``tour`` nodes are replaced by their positions in it.
    Records have no marks: a file of up to ``whole_bytes`` is read in one task, as others are side by
    side with it, and a longer one in many (see :func:`_long_cut_records`). An incomplete last cut
    is an error. Cuts and cliques without a node don't come back.
    """
    sized = F.col("_metadata.file_size")
    files = spark.read.text(path, wholetext=True).filter(sized <= whole_bytes).select(F.col("_metadata.file_path").alias("file"), "value")
    short = files.mapInPandas(_cut_records, "file string, cut long, rhs int, clique long, node long")
    lines = spark.read.text(path).filter(sized > whole_bytes).select(F.col("_metadata.file_path").alias("file"), F.btrim("value", F.lit(" \t\r")).alias("value"), "_metadata.file_block_start", F.monotonically_increasing_id().alias("at")).filter("value != ''")
    rows = materialize(short.unionByName(_long_cut_records(materialize(lines, "cut-lines"))) if lines.take(1) else short, "cut-records")
    numbered = materialize(ranked(rows.select("file", "cut", "rhs").distinct(), ["file", "cut"], name="cut_id"), "cuts")
    links = materialize(ranked(rows.select("file", "cut", "clique").distinct().join(numbered.select("file", "cut", "cut_id"), ["file", "cut"]), ["cut_id", "clique"], name="clique_id"), "cut-cliques")
    members = rows.join(links, ["file", "cut", "clique"]).select("clique_id", "node")
    if tour is not None:
        members = members.join(tour.select("node", "pos"), "node").select("clique_id", F.col("pos").alias("node"))
    return numbered.select("cut_id", F.lit("G").alias("sense"), "rhs"), links.select("cut_id", "clique_id"), members


def write_cuts(cuts: DataFrame, cut_cliques: DataFrame, members: DataFrame, path: str, tour: DataFrame | None = None) -> None:
    """A cut file in the order of cut ids; branching cuts (``branch`` other than 0) are left out, nodes are the tour's at their positions."""
    if "branch" in cuts.columns:
        cuts = cuts.filter("branch = 0")
    if tour is not None:
        members = members.join(tour.select(F.col("pos").alias("node"), F.col("node").alias("_to")), "node").select("clique_id", F.col("_to").alias("node"))
    cliques = members.groupBy("clique_id").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    inside = cut_cliques.join(cuts.select("cut_id", "rhs"), "cut_id").join(cliques, "clique_id")
    value = F.concat_ws(" ", F.size("nodes").cast("string"), F.transform("nodes", lambda x: x.cast("string")))
    placed = inside.select("cut_id", "rhs", value.alias("value"), F.row_number().over(Window.partitionBy("cut_id").orderBy("clique_id")).alias("at"))
    ends = placed.groupBy("cut_id", "rhs").agg(F.count("*").alias("n"))
    lines = placed.select("value", "cut_id", "at").unionByName(ends.select(F.col("n").cast("string").alias("value"), "cut_id", F.lit(0).alias("at"))).unionByName(ends.select(F.col("rhs").cast("string").alias("value"), "cut_id", (F.col("n") + 1).cast("int").alias("at")))
    # A cut's lines stay in one file, so that no record is torn.
    lines.repartitionByRange("cut_id").sortWithinPartitions("cut_id", "at").select("value").write.text(path)
