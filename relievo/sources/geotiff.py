"""GeoTIFF files as rasters, and back, as a Spark data source.

Reading: when a scan is planned only the header of a file is read, by byte ranges.  Its strips
or tiles that a window or a pushed filter asks for are dealt into partitions, and each task
reads the byte ranges of its own, so a file may be larger than a task; of plain strips only
the lines asked for are read.  One band of unsigned or signed integers or floats is understood,
in strips or tiles, plain or deflated, with or without horizontal differences, also as BigTIFF.

Writing: tiles are deflated where they lie, their places in the file follow from their counted
sizes, and each task writes its tiles at their places in a file with a temporary name, which
gets its own name when all tasks are done.  So a raster is never in one task.  A task that is
run again writes the same bytes; if the job fails, the temporary files go.  The folder must be
one that driver and executors share and that takes writes at places, as a mounted one does.
"""

from __future__ import annotations

import json
import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.window import Window

from relievo.lineage import cut

#: TIFF tags, field types by size, and GeoTIFF keys.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
PIXEL_SCALE, TIEPOINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
SMALL_FILE, BIG_FILE, BIG_FROM = 42, 43, 1 << 32
PLAIN, DEFLATE, OLD_DEFLATE, GEOGRAPHIC, PROJECTED = 1, 8, 32946, 2048, 3072
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
KINDS = {(1, 8): "u1", (1, 16): "u2", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


#: Bytes of blocks that a task reads, and of plain lines that it holds at once.
PARTITION_BYTES, PIECE_BYTES = 32 << 20, 4 << 20
TILE = 256


def header(content: bytes | Callable[[int, int], bytes]) -> dict:
    """Sizes, the kind of a cell, x0, y0 (centre of the first cell), dx, dy, nodata, epsg, and ``blocks``: (r0, c0, offset, bytes) of ``tall`` x ``wide`` cells.

    ``content`` is a file's bytes or a function that reads so many of them from a place.
    """
    read = content if callable(content) else lambda at, n: content[at : at + n]
    start = read(0, 16)
    end = {b"II": "<", b"MM": ">"}.get(start[:2])
    version = struct.unpack_from(f"{end}H", start, 2)[0] if end and len(start) >= 8 else None
    if version not in (SMALL_FILE, BIG_FILE):
        raise ValueError("not a TIFF file")
    big = version == BIG_FILE
    at = struct.unpack_from(f"{end}Q", start, 8)[0] if big else struct.unpack_from(f"{end}I", start, 4)[0]
    word, entry, inside = ("Q", 20, 8) if big else ("I", 12, 4)
    n_size = 8 if big else 2
    many = struct.unpack(f"{end}{'Q' if big else 'H'}", read(at, n_size))[0]
    entries, tags = read(at + n_size, entry * many), {}
    for k in range(many):
        tag, kind, n = struct.unpack_from(f"{end}HH{word}", entries, entry * k)
        code = FIELD.get(kind)
        if code is None:
            continue
        size, place = n * struct.calcsize(code), entry * k + entry - inside
        raw = entries[place : place + size] if size <= inside else read(struct.unpack_from(f"{end}{word}", entries, place)[0], size)
        tags[tag] = raw if code == "s" else struct.unpack(f"{end}{n}{code}", raw)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    if one(COMPRESSION, PLAIN) not in (PLAIN, DEFLATE, OLD_DEFLATE) or one(SAMPLES, 1) != 1 or one(PREDICTOR, 1) not in (1, 2):
        raise ValueError("one band, plain or deflated, is asked for")
    rows, cols = one(HEIGHT), one(WIDTH)
    tiled = TILE_WIDTH in tags
    wide, tall = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (cols, min(rows, one(ROWS, rows)))
    across = -(-cols // wide)
    places = zip(tags[TILE_OFFSETS if tiled else OFFSETS], tags[TILE_COUNTS if tiled else COUNTS], strict=True)
    dx, dy = tags.get(PIXEL_SCALE, (1.0, 1.0))[:2]
    col, row, _, x, y, _ = tags.get(TIEPOINT, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0))[:6]
    keys = tags.get(GEO_KEYS, ())
    geo = {keys[k]: keys[k + 3] for k in range(4, len(keys), 4)}
    return {
        "rows": rows, "cols": cols, "kind": end + KINDS[one(FORMAT, 1), one(BITS)], "deflated": one(COMPRESSION, PLAIN) != PLAIN, "differences": one(PREDICTOR, 1) == 2, "wide": wide, "tall": tall, "tiled": tiled,
        "blocks": [(k // across * tall, k % across * wide, offset, n) for k, (offset, n) in enumerate(places)],
        "x0": x + (0.5 - col) * dx, "y0": y - (0.5 - row) * dy, "dx": dx, "dy": dy, "nodata": float(tags[NODATA].rstrip(b"\0 ")) if NODATA in tags else None, "epsg": geo.get(GEOGRAPHIC) or geo.get(PROJECTED),
    }


def cells_of(data: bytes, head: dict, r0: int, c0: int) -> np.ndarray:
    """The cells of a block that lie inside the raster."""
    if head["deflated"]:
        data = zlib.decompress(data)
    tall = head["tall"] if head["tiled"] else min(head["tall"], head["rows"] - r0)
    block = np.frombuffer(data, head["kind"], tall * head["wide"]).reshape(tall, head["wide"])
    if head["differences"]:
        block = np.cumsum(block, axis=1, dtype=block.dtype.newbyteorder("="))
    return block[: head["rows"] - r0, : head["cols"] - c0]


def decode(content: bytes) -> tuple[np.ndarray, dict]:
    """The band, and x0, y0 (centre of the first cell), dx, dy and nodata."""
    head = header(content)
    band = np.empty((head["rows"], head["cols"]), dtype=head["kind"])
    for r0, c0, offset, n in head["blocks"]:
        cells = cells_of(content[offset : offset + n], head, r0, c0)
        band[r0 : r0 + cells.shape[0], c0 : c0 + cells.shape[1]] = cells
    return band, {k: head[k] for k in ("x0", "y0", "dx", "dy", "nodata")}


def directory(fields: list[tuple], at: int, big: bool = False) -> bytes:
    """The entries (tag, field type, values) of a directory that lies at ``at``, and the values that do not fit into them."""
    word, inside = ("Q", 8) if big else ("I", 4)
    entries, more = b"", b""
    spill = at + (8 + 20 * len(fields) + 8 if big else 2 + 12 * len(fields) + 4)
    for tag, code, value in sorted(fields, key=lambda f: f[0]):
        raw = value if code == 2 else struct.pack(f"<{len(value)}{FIELD[code]}", *value)
        entries += struct.pack(f"<HH{word}", tag, code, len(value))
        if len(raw) > inside:
            entries += struct.pack(f"<{word}", spill + len(more))
            more += raw + b"\0" * (len(raw) % 2)
        else:
            entries += raw.ljust(inside, b"\0")
    return struct.pack("<Q" if big else "<H", len(fields)) + entries + struct.pack(f"<{word}", 0) + more


def _about(rows: int, cols: int, kind: np.dtype, x0: float, y0: float, dx: float, dy: float, nodata: float | None, epsg: int) -> list[tuple]:
    """The fields that any layout has."""
    model = 2 if epsg == 4326 else 1
    keys = (1, 1, 0, 3, 1024, 0, 1, model, 1025, 0, 1, 1, 2048 if model == 2 else 3072, 0, 1, epsg)
    fields = [
        (WIDTH, 4, (cols,)), (HEIGHT, 4, (rows,)), (BITS, 3, (kind.itemsize * 8,)), (PHOTOMETRIC, 3, (1,)), (SAMPLES, 3, (1,)), (FORMAT, 3, ({"u": 1, "i": 2, "f": 3}[kind.kind],)),
        (PIXEL_SCALE, 12, (dx, dy, 0.0)), (TIEPOINT, 12, (0.0, 0.0, 0.0, x0 - dx / 2, y0 + dy / 2, 0.0)), (GEO_KEYS, 3, keys),
    ]
    return fields if nodata is None else [*fields, (NODATA, 2, f"{nodata:g}".encode() + b"\0")]


def encode(band: np.ndarray, x0: float, y0: float, dx: float, dy: float, nodata: float | None = None, epsg: int = 4326) -> bytes:
    """One strip, little-endian; ``x0`` and ``y0`` are the centre of the first cell."""
    band = np.ascontiguousarray(band, band.dtype.newbyteorder("<"))
    strip = [(COMPRESSION, 3, (PLAIN,)), (OFFSETS, 4, (8,)), (ROWS, 4, (band.shape[0],)), (COUNTS, 4, (band.nbytes,))]
    body = band.tobytes() + b"\0" * (band.nbytes % 2)
    at = 8 + len(body)
    return struct.pack("<2sHI", b"II", SMALL_FILE, at) + body + directory(_about(*band.shape, band.dtype, x0, y0, dx, dy, nodata, epsg) + strip, at)


def tiled_header(about: list[tuple], tile: int, offsets: Sequence[int], counts: Sequence[int], big: bool) -> bytes:
    """The start of a file of deflated tiles; its length depends on their number only."""
    word = 16 if big else 4
    fields = [*about, (COMPRESSION, 3, (DEFLATE,)), (TILE_WIDTH, 4, (tile,)), (TILE_HEIGHT, 4, (tile,)), (TILE_OFFSETS, word, tuple(offsets)), (TILE_COUNTS, word, tuple(counts))]
    return (struct.pack("<2sHHHQ", b"II", BIG_FILE, 8, 0, 16) if big else struct.pack("<2sHI", b"II", SMALL_FILE, 8)) + directory(fields, 16 if big else 8, big)


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "file:///" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Ranges:
    """Reads byte ranges of a file; ``bytes`` counts what was read."""

    def __init__(self, path: str):
        system, where = _filesystem(path)
        self.file, self.bytes = system.open_input_file(where), 0

    def __call__(self, at: int, n: int) -> bytes:
        data = self.file.read_at(n, at)
        self.bytes += len(data)
        return data


def asked(head: dict, window: Sequence[float] | None, snap: str = "inside", halo: int = 0) -> tuple[int, int, int, int] | None:
    """First and last row and column that a window (x0, y0, x1, y1) asks for; None if there are none.

    ``inside``: cells whose centres are inside.  ``nearest``: from the centre nearest to one edge
    to that nearest to the other; two rows and columns at least.  ``cell``: from the cell that
    holds one corner to that which holds the other, with ``halo`` more on each side; three rows
    and columns at least.
    """
    rows, cols = head["rows"], head["cols"]
    if window is None:
        return 0, rows - 1, 0, cols - 1
    (left, right), (low, high) = sorted(window[::2]), sorted(window[1::2])
    if snap == "cell":
        at = lambda v, first, size: int((v - first) / size)
        west, north = head["x0"] - head["dx"] / 2, head["y0"] + head["dy"] / 2
        c0, c1 = max(0, at(left, west, head["dx"]) - halo), min(cols - 1, at(right, west, head["dx"]) + halo)
        r0, r1 = max(0, at(north, high, head["dy"]) - halo), min(rows - 1, at(north, low, head["dy"]) + halo)
        return (r0, r1, c0, c1) if c1 - c0 >= 2 and r1 - r0 >= 2 else None
    x, y = head["x0"] + np.arange(cols) * head["dx"], head["y0"] - np.arange(rows) * head["dy"]
    if snap == "nearest":
        (c0, c1), (r0, r1) = (sorted(int(np.abs(v - e).argmin()) for e in edges) for v, edges in ((x, (left, right)), (y, (high, low))))
        return (r0, r1, c0, c1) if c1 > c0 and r1 > r0 else None
    if snap != "inside":
        raise ValueError(f"unknown rule {snap!r}")
    c, r = np.flatnonzero((x >= left) & (x <= right)), np.flatnonzero((y >= low) & (y <= high))
    return (int(r[0]), int(r[-1]), int(c[0]), int(c[-1])) if len(c) and len(r) else None


def pieces(head: dict, r0: int, r1: int, c0: int, c1: int) -> list[tuple[int, int, int, int, int]]:
    """(r, c, lines, offset, bytes) of what must be read: whole blocks, or of plain strips only the lines asked for, some at once."""
    found, size = [], np.dtype(head["kind"]).itemsize
    for r, c, offset, n in head["blocks"]:
        if r > r1 or r + head["tall"] <= r0 or c > c1 or c + head["wide"] <= c0:
            continue
        if head["deflated"] or head["tiled"]:
            found.append((r, c, head["tall"], offset, n))
            continue
        line = head["wide"] * size
        step, last = max(1, PIECE_BYTES // line), min(r1, r + head["tall"] - 1, head["rows"] - 1)
        for k in range(max(r, r0), last + 1, step):
            lines = min(step, last + 1 - k)
            found.append((k, c, lines, offset + (k - r) * line, lines * line))
    return found


class GeoTiffSource(DataSource):
    """``spark.read.format("geotiff")``.

    Options: ``path`` (a file, or a folder of .tif files), ``window`` (x0,y0,x1,y1), ``snap`` and
    ``halo`` (see ``asked``), ``required`` (an error if no file has a cell in the window),
    ``eightbit`` (wider integers are divided by 256), ``form``: cells, or blocks as doubles.
    Comparisons of r, c, x and y with constants are pushed into the choice of byte ranges.
    """

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        if self.options.get("form", "cells") == "blocks":
            return "path string, r int, c int, h int, w int, data binary"
        return "path string, r int, c int, x double, y double, val double"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return GeoTiffReader(dict(self.options))


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.form = options["path"], options.get("form", "cells")
        self.window = [float(v) for v in options["window"].split(",")] if options.get("window") else None
        self.snap, self.halo = options.get("snap", "inside"), int(options.get("halo", 0))
        self.required, self.eight = options.get("required") == "true", options.get("eightbit") == "true"
        self.bounds: list[tuple[str, float, float]] = []
        self.bytes = 0

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Bounds on places choose byte ranges; Spark applies all filters again, to the cells."""
        for f in filters:
            axis, value = getattr(f, "attribute", ("",))[0], getattr(f, "value", None)
            if axis in ("r", "c", "x", "y") and value is not None:
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.bounds.append((axis, float(value), np.inf))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.bounds.append((axis, -np.inf, float(value)))
            yield f

    def _files(self) -> list[str]:
        system, where = _filesystem(self.path)
        if system.get_file_info(where).type == fs.FileType.File:
            return [self.path]
        found = system.get_file_info(fs.FileSelector(where, recursive=True))
        start = self.path.split("://")[0] + "://" if "://" in self.path else ""
        return sorted(start + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith((".tif", ".tiff")) and not Path(f.path).name.startswith("."))

    def _box(self, head: dict) -> tuple[int, int, int, int] | None:
        box = asked(head, self.window, self.snap, self.halo)
        if box is None:
            return None
        r0, r1, c0, c1 = box
        for axis, low, high in self.bounds:
            if axis in "xy":  # rounded outwards, the filter itself is applied to the cells
                first, size = (head["x0"], head["dx"]) if axis == "x" else (-head["y0"], head["dy"])
                low, high = sorted((low, high) if axis == "x" else (-low, -high))
                low, high = np.floor((low - first) / size - 1e-6), np.ceil((high - first) / size + 1e-6)
            if axis in "cx":
                c0, c1 = max(c0, low), min(c1, high)
            else:
                r0, r1 = max(r0, low), min(r1, high)
        return (int(r0), int(r1), int(c0), int(c1)) if r0 <= r1 and c0 <= c1 else None

    def partitions(self) -> list[InputPartition]:
        def plan(path: str) -> list[InputPartition]:
            ranges = Ranges(path)
            head = header(ranges)
            self.bytes += ranges.bytes
            box, found, held, size = self._box(head), [], [], 0
            for piece in pieces(head, *box) if box else []:
                held.append(piece)
                size += piece[-1]
                if size >= PARTITION_BYTES:
                    found.append(held)
                    held, size = [], 0
            head.pop("blocks")
            return [InputPartition((path, json.dumps(head), box, some)) for some in [*found, held] if some]

        with ThreadPoolExecutor(16) as pool:
            found = [p for of_file in pool.map(plan, self._files()) for p in of_file]
        if self.required and not found:
            raise ValueError(f"no cell of {self.path} is inside {self.window}")
        return found

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.value is None:
            return
        path, about, (r0, r1, c0, c1), some = partition.value
        head, ranges = json.loads(about), Ranges(path)
        for r, c, lines, offset, n in some:
            if n:
                whole = cells_of(ranges(offset, n), head | {"tall": lines}, r, c).astype(float)
            else:  # a tile that was never written
                whole = np.full((min(lines, head["rows"] - r), min(head["wide"], head["cols"] - c)), np.nan)
            a, b, first, last = max(r, r0), min(r + lines - 1, r1), max(c, c0), min(c + head["wide"] - 1, c1)
            val = whole[a - r : b - r + 1, first - c : last - c + 1]
            if head["nodata"] is not None:
                val = np.where(val == head["nodata"], np.nan, val)
            if self.eight and np.dtype(head["kind"]).itemsize > 1:
                val = np.floor(val / 256)
            yield self._batch(path, head, a, first, val)
        self.bytes += ranges.bytes

    def _batch(self, path: str, head: dict, r: int, c: int, val: np.ndarray) -> pa.RecordBatch:
        tall, wide = val.shape
        if self.form == "blocks":
            return pa.RecordBatch.from_arrays([pa.array([path]), *(pa.array([v], pa.int32()) for v in (r, c, tall, wide)), pa.array([np.ascontiguousarray(val).tobytes()], pa.binary())], ["path", "r", "c", "h", "w", "data"])
        lines, cols = np.arange(r, r + tall, dtype=np.int32), np.arange(c, c + wide, dtype=np.int32)
        x, y = head["x0"] + cols * head["dx"], head["y0"] - lines * head["dy"]
        flat = val.ravel()
        columns = [pa.array([path] * flat.size), pa.array(np.repeat(lines, wide)), pa.array(np.tile(cols, tall)), pa.array(np.tile(x, tall)), pa.array(np.repeat(y, wide)), pa.array(flat, mask=np.isnan(flat))]
        return pa.RecordBatch.from_arrays(columns, ["path", "r", "c", "x", "y", "val"])


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, with filters pushed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiffSource)
    spark.dataSource.register(FileRangesSink)


def read_geotiff(spark: SparkSession, path: str, window: tuple[float, float, float, float] | None = None, buffer: float = 0.0, required: bool = False, snap: str = "inside", halo: int = 0, eight_bits: bool = False, form: str = "cells") -> DataFrame:
    """path, r, c, x, y, val (or blocks) of the cells in ``window`` (x0, y0, x1, y1), grown by ``buffer`` of its extent; see ``GeoTiffSource``."""
    register(spark)
    options = {"snap": snap, "halo": str(halo), "required": str(required).lower(), "eightbit": str(eight_bits).lower(), "form": form}
    if window:
        xs, ys = sorted(window[::2]), sorted(window[1::2])
        gx, gy = (xs[1] - xs[0]) * buffer, (ys[1] - ys[0]) * buffer
        options["window"] = ",".join(repr(float(v)) for v in (xs[0] - gx, ys[0] - gy, xs[1] + gx, ys[1] + gy))
    if required:  # before any job: only headers are read
        GeoTiffReader({**options, "path": path}).partitions()
    return spark.read.format("geotiff").options(**options).load(path)


class FileRangesSink(DataSource):
    """``df.write.format("file_ranges")``: rows (name, offset, data) become files in a folder; all of them, or none."""

    @classmethod
    def name(cls) -> str:
        return "file_ranges"

    def schema(self) -> str:
        return "name string, offset long, data binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:  # noqa: ANN001
        return FileRangesWriter(self.options["path"])


class _Written(WriterCommitMessage):
    def __init__(self, names: set[str]):
        self.names = names


class FileRangesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        if "://" in folder and not folder.startswith("file://"):
            raise ValueError(f"{folder} takes no writes at places; a mounted folder does")
        self.folder = Path(_filesystem(folder)[1])
        self.held = self.folder / f".{uuid.uuid4().hex}"
        self.held.mkdir(parents=True)  # by the driver alone: once abort has taken it away, late tasks cannot write

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        names: set[str] = set()
        for batch in iterator:
            for name, offset, data in zip(*(batch.column(c).to_pylist() for c in ("name", "offset", "data")), strict=True):
                names.add(name)
                file = os.open(self.held / name, os.O_WRONLY | os.O_CREAT, 0o644)
                try:
                    while data:
                        done = os.pwrite(file, data, offset)
                        data, offset = data[done:], offset + done
                finally:
                    os.close(file)
        return _Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        for name in sorted(set().union(*(m.names for m in messages if m))):
            os.replace(self.held / name, self.folder / name)
        self.held.rmdir()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.held, ignore_errors=True)


def dem_name(region: Column, window: Column) -> Column:
    return F.concat(F.lit("dem_r"), region.cast("string"), F.lit("_w"), window.cast("string"), F.lit(".tif"))


def image_name(region: Column, window: Column) -> Column:
    return F.concat(F.lit("image_r"), region.cast("string"), F.lit("w"), window.cast("string"), F.lit(".tif"))


def write_geotiff(raster: DataFrame, grids: DataFrame, folder: str, kind: str = "int16", nodata: float | None = -32768, epsg: int = 4326, tile: int = TILE, big_from: int = BIG_FROM) -> None:
    """Writes the cells (name, r, c, val) of rasters as files of deflated tiles in ``folder``.

    ``grids``: name, rows, cols, x0, y0 (centre of the first cell), dx, dy of each file, one row
    a file; cells outside are dropped, cells without a row, or null, become ``nodata``.  Values
    of integer kinds are rounded and must fit.  Tiles without cells are left out of the file.
    """
    register(raster.sparkSession)
    dtype = np.dtype(kind)
    empty = 0.0 if nodata is None else nodata

    def packed(table: pa.Table) -> pa.Table:
        name, k = table["name"][0], table["k"][0]
        band = np.full((tile, tile), empty)
        val = table["val"].to_numpy()
        band[table["r"].to_numpy() % tile, table["c"].to_numpy() % tile] = np.where(np.isnan(val), empty, np.rint(val) if dtype.kind in "iu" else val)
        if dtype.kind in "iu" and (band.min() < np.iinfo(dtype).min or band.max() > np.iinfo(dtype).max):
            raise ValueError(f"a value does not fit {kind}")
        data = zlib.compress(band.astype(dtype.newbyteorder("<")).tobytes(), 6)
        return pa.table({"name": [name.as_py()], "k": pa.array([k.as_py()], pa.int64()), "data": pa.array([data], pa.binary())})

    def headed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g in batch.itertuples():
                about = _about(int(g.rows), int(g.cols), dtype, g.x0, g.y0, g.dx, g.dy, nodata, epsg)
                many = -(-int(g.rows) // tile) * -(-int(g.cols) // tile)
                sizes, total = [0] * many, 0
                for t in g.tiles if g.tiles is not None else []:
                    sizes[t["k"]] = t["n"]
                    total += t["n"]
                big = total + 64 * many + 4096 > big_from
                start = at = len(tiled_header(about, tile, [0] * many, sizes, big))
                offsets = []
                for n in sizes:
                    offsets.append(at if n else 0)
                    at += n
                yield pd.DataFrame({"name": [g.name], "start": [start], "data": [tiled_header(about, tile, offsets, sizes, big)]})

    grids = grids.select("name", "rows", "cols", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "dx", "dy")])
    shape = grids.select(F.col("name").alias("g_name"), "rows", "cols")
    inside = raster.join(shape, F.col("name") == F.col("g_name")).where("r >= 0 AND c >= 0 AND r < rows AND c < cols")
    k = F.floor(F.col("r") / tile) * F.ceil(F.col("cols") / tile) + F.floor(F.col("c") / tile)
    tiles = cut(inside.select("name", k.cast("long").alias("k"), "r", "c", F.col("val").cast("double").alias("val")).groupBy("name", "k").applyInArrow(packed, "name string, k long, data binary"))
    sizes = tiles.select("name", "k", F.length("data").cast("long").alias("n"))
    # A row a tile: the places of a file's tiles follow from the sizes of those before.
    places = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("name").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("name", "k", "before")
    lists = sizes.groupBy("name").agg(F.collect_list(F.struct("k", "n")).alias("tiles"))
    heads = cut(grids.join(lists, "name", "left").select(F.col("name"), "rows", "cols", "x0", "y0", "dx", "dy", "tiles").mapInPandas(headed, "name string, start long, data binary"))
    body = tiles.join(places, ["name", "k"]).join(heads.select("name", "start"), "name").select("name", (F.col("start") + F.col("before")).alias("offset"), "data")
    rows = heads.select("name", F.lit(0).cast("long").alias("offset"), "data").unionByName(body)
    rows.write.format("file_ranges").mode("append").save(folder)
