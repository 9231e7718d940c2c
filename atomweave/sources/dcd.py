"""Binary trajectory files as a partitioned Spark data source.

``spark.read.format("dcd").load(folder)`` gives frames; options:

``table``      ``frames`` (default), ``cells`` (box lengths per frame), ``checks`` (what is wrong in a range of a
               file; :func:`report` puts them together) or ``report`` (the same by one task a file)
``stride``     every n-th frame, ``maxFrames`` at most so many of them (0 = all): applied to planning
``frames``     wanted frames, ``atoms`` wanted atoms: a list ``1,30,400`` or a range ``5:9`` (without its end; either
               side may be missing); ``files`` a pattern for names, ``*-0.dcd``: all three are applied to planning
``splitBytes`` size of one partition

The driver only lists paths and sizes.  A partition is a byte range of one file; its task reads the
short file header, turns the range into whole frames (all frames have one size) and reads just those,
so a file of any size is spread over many tasks.  Where the options leave a bounded range of frames, it is
dealt out by frames instead: a file has no more partitions than wanted frames, and a task seeks to its own.

Conditions are options, not pushed filters: in Spark 4.1 a Python source that takes filters keeps those of one
query for later queries of the same DataFrame that have none to push, which then lack rows.

Paths go through ``pyarrow.fs``: local folders, HDFS and object stores work alike; a path without a scheme is local.
A malformed file stops a read, or gives no rows with ``skipBad``; the report tells what is wrong.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed numbers of the format.
HEADER_BLOCK = 84
CELL_BLOCK = 48
MAGIC = b"CORD"
MAX_ATOMS = 50_000_000
#: Wanted frames that many bytes apart are read one by one.
FAR_APART = 1 << 20

SCHEMAS = {
    "frames": "path string, frame bigint, atom_idx bigint, x double, y double, z double",
    "cells": "path string, frame bigint, a double, b double, c double",
    "report": "path string, status string, error string, num_atoms bigint, time_step double, "
              "frames_in_file bigint, frames_loaded bigint",
    "checks": "path string, header_error string, num_atoms bigint, time_step double, frames_in_file bigint, "
              "frames_seen bigint, bad_frame bigint, error string, tail_error string",
}


class BadTrajectory(ValueError):
    """The bytes are no readable trajectory."""


@dataclass(frozen=True)
class Layout:
    """What the header says, and where frames lie."""
    order: str
    declared_frames: int
    time_step: float
    num_atoms: int
    has_cell: bool
    first_frame: int

    @property
    def axis_block(self) -> int:
        return 4 * self.num_atoms

    @property
    def frame_size(self) -> int:
        return 3 * (self.axis_block + 8) + ((CELL_BLOCK + 8) if self.has_cell else 0)

    def whole_frames(self, size: int) -> int:
        return max(0, size - self.first_frame) // self.frame_size

    def frame_dtype(self) -> np.dtype:
        """Record of one frame with its length marks."""
        i4, f4, f8 = self.order + "i4", self.order + "f4", self.order + "f8"
        fields = [("cell_open", i4), ("cell", f8, (6,)), ("cell_close", i4)] if self.has_cell else []
        for axis in "xyz":
            fields += [(f"{axis}_open", i4), (axis, f4, (self.num_atoms,)), (f"{axis}_close", i4)]
        return np.dtype(fields)

    def check_marks(self, frames: np.ndarray, first: int) -> None:
        expected = {name: CELL_BLOCK if name.startswith("cell") else self.axis_block
                    for name in frames.dtype.names if name.endswith(("_open", "_close"))}
        for name, size in expected.items():
            wrong = np.flatnonzero(frames[name] != size)
            if len(wrong):
                raise BadTrajectory(f"frame {first + int(wrong[0])}: block mark {name} is "
                                    f"{int(frames[name][wrong[0]])}, expected {size}")


def read_layout(data: bytes) -> Layout:
    """Header, title block and atom count from the first bytes of a file."""
    def need(at: int, size: int, what: str) -> bytes:
        if at + size > len(data):
            raise BadTrajectory(f"file ends in the {what}")
        return data[at:at + size]

    mark = need(0, 4, "header")
    order = next((o for o in "<>" if struct.unpack(o + "i", mark)[0] == HEADER_BLOCK), None)
    if order is None:
        raise BadTrajectory("first block mark is not that of a trajectory")
    if need(4, 4, "header") != MAGIC:
        raise BadTrajectory("magic is not CORD")
    raw = need(8, 80, "header")
    control = struct.unpack(order + "20i", raw)
    if struct.unpack(order + "i", need(88, 4, "header"))[0] != HEADER_BLOCK:
        raise BadTrajectory("header block is not closed")
    time_step = struct.unpack(order + "f", raw[36:40])[0] if control[19] else 0.0
    if control[8] > 0:
        raise BadTrajectory(f"{control[8]} fixed atoms are not supported")
    title_size, lines = struct.unpack(order + "2i", need(92, 8, "title block"))
    if lines < 0 or title_size != 4 + 80 * lines:
        raise BadTrajectory("title block has an inconsistent size")
    at = 100 + 80 * lines
    closing, count_open, atoms, count_close = struct.unpack(order + "4i", need(at, 16, "title or atom block"))
    if closing != title_size:
        raise BadTrajectory("title block is not closed")
    if count_open != 4 or count_close != 4:
        raise BadTrajectory("atom count block has the wrong size")
    if not 0 < atoms <= MAX_ATOMS:
        raise BadTrajectory(f"atom count {atoms} is not plausible")
    return Layout(order, control[0], float(time_step), atoms, control[10] != 0, at + 16)


def load_layout(handle) -> Layout:
    """Header of an open file; the title says how much has to be read."""
    start = handle.read(100)
    if len(start) == 100:
        order = "<" if struct.unpack("<i", start[:4])[0] == HEADER_BLOCK else ">"
        lines = struct.unpack(order + "i", start[96:100])[0]
        if 0 <= lines <= 1_000_000:
            start += handle.read(80 * lines + 16)
    return read_layout(start)


@dataclass(frozen=True)
class Slice:
    """Range of one file: of bytes, or of frames."""
    path: str
    size: int
    start: int
    stop: int
    frames: bool = False
    weight: int = 0


@dataclass
class Wanted:
    """Numbers that an option leaves: a range without its end, and a list if it is one."""
    first: int = 0
    stop: int | None = None
    listed: tuple[int, ...] | None = None

    @classmethod
    def parse(cls, text: str) -> Wanted:
        if ":" in text:
            first, stop = (part.strip() for part in text.split(":"))
            return cls(max(0, int(first or 0)), max(0, int(stop)) if stop else None)
        if not text.strip():
            return cls()
        listed = tuple(sorted({int(part) for part in text.split(",") if int(part) >= 0}))
        return cls(min(listed, default=0), max(listed, default=-1) + 1, listed)

    def within(self, stop: int) -> range:
        return range(min(self.first, stop), stop if self.stop is None else max(min(self.first, stop), min(stop, self.stop)))

    def __contains__(self, number: int) -> bool:
        return (number >= self.first and (self.stop is None or number < self.stop)
                and (self.listed is None or number in self.listed))


class Pack(InputPartition):
    """Slices read by one task: one range of a large file, or several small files."""

    def __init__(self, slices: list[Slice]):
        super().__init__(tuple(slices))
        self.slices = slices


def pack(slices: list[Slice], limit: int) -> list[Pack]:
    packs, filled = [], 0
    for one in slices:
        size = one.weight
        if not packs or filled + size > limit:
            packs.append([])
            filled = 0
        packs[-1].append(one)
        filled += size
    return [Pack(slices) for slices in packs]


class TrajectoryReader(DataSourceReader):
    def __init__(self, options: dict, table: str):
        self.location = options["path"]
        self.table = table
        self.skip_bad = str(options.get("skipbad", options.get("skipBad", "false"))).lower() == "true"
        self.stride = max(1, int(options.get("stride", 1)))
        self.max_frames = int(options.get("maxframes", options.get("maxFrames", 0)))
        self.split_bytes = max(1, int(options.get("splitbytes", options.get("splitBytes", 64 << 20))))
        self.frames, self.atoms = (Wanted.parse(str(options.get(name, ""))) for name in ("frames", "atoms"))
        self.files = options.get("files", "*")

    def _frame_range(self) -> range | None:
        """Wanted frames as far as options bound them; None if none does."""
        last = None if self.max_frames <= 0 else (self.max_frames - 1) * self.stride + 1
        if last is None and self.frames.stop is None:
            return None
        return self.frames.within(last if last is not None else self.frames.stop)

    def partitions(self) -> list[Pack]:
        system, base = pafs.FileSystem.from_uri(self.location) if "://" in self.location or self.location.startswith(
            "file:") else (pafs.LocalFileSystem(), self.location)
        found = system.get_file_info(pafs.FileSelector(base, recursive=True)) \
            if system.get_file_info(base).type == pafs.FileType.Directory else [system.get_file_info(base)]
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.lower().endswith(".dcd")
                       and fnmatchcase(f.path.rsplit("/", 1)[-1], self.files))
        if self.table == "report":
            return pack([Slice(path, size, 0, size, False, size) for path, size in files], self.split_bytes)
        frames = self._frame_range() if self.table in ("frames", "cells") else None
        slices = []
        for path, size in files:
            many = max(1, -(-size // self.split_bytes))
            if frames is None:
                cuts = [*range(0, max(size, 1), self.split_bytes), size]
                slices += [Slice(path, size, a, b, False, b - a) for a, b in zip(cuts, cuts[1:])]
            elif frames:  # fewer frames than byte ranges are taken for as small a share of the file
                count = min(many, len(frames))
                weight = min(size, self.split_bytes if len(frames) >= many else self.split_bytes // many)
                cuts = [frames.start + len(frames) * i // count for i in range(count + 1)]
                slices += [Slice(path, size, a, b, True, weight) for a, b in zip(cuts, cuts[1:])]
        return pack(slices, self.split_bytes)

    def _last_wanted(self, whole: int) -> int:
        """Frames up to and with the last one that stride and limit leave."""
        return min(whole, (self.max_frames - 1) * self.stride + 1) if self.max_frames > 0 else whole

    def _open(self, path: str):
        if "://" in self.location or self.location.startswith("file:"):
            system, _ = pafs.FileSystem.from_uri(self.location)
        else:
            system = pafs.LocalFileSystem()
        return system.open_input_file(path)

    def read(self, partition: Pack) -> Iterator[pa.RecordBatch]:
        for one in partition.slices if partition is not None else []:
            yield from self._read_slice(one)

    def _read_slice(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        with self._open(partition.path) as handle:
            if self.table in ("report", "checks"):
                yield self._report(handle, partition) if self.table == "report" else self._check(handle, partition)
                return
            try:
                layout = load_layout(handle)
            except BadTrajectory:
                if self.skip_bad:
                    return
                raise
            first, last = self._own_frames(layout, partition)
            own = self.frames.within(last)
            first, last = max(first, own.start), min(last, own.stop)
            step = max(1, (4 << 20) // layout.frame_size)
            for at in range(first, last, step):
                yield from self._frames(handle, layout, partition.path, at, min(last, at + step))

    def _own_frames(self, layout: Layout, one: Slice) -> tuple[int, int]:
        """First and last frame (not with it) of a slice; a frame belongs to the byte range in which it starts."""
        most = self._last_wanted(layout.whole_frames(one.size))
        if one.frames:
            return min(one.start, most), min(one.stop, most)
        skip = layout.first_frame
        return (max(0, -(-(one.start - skip) // layout.frame_size)),
                min(most, max(0, -(-(one.stop - skip) // layout.frame_size))))

    def _frames(self, handle, layout: Layout, path: str, first: int, last: int) -> Iterator[pa.RecordBatch]:
        wanted = [f for f in range(first, last) if f % self.stride == 0 and f in self.frames
                  and (self.max_frames <= 0 or f // self.stride < self.max_frames)]
        if not wanted or (self.table == "cells" and not layout.has_cell):
            return
        if self.stride * layout.frame_size >= FAR_APART:
            parts = []
            for frame in wanted:
                handle.seek(layout.first_frame + frame * layout.frame_size)
                parts.append(np.frombuffer(handle.read(layout.frame_size), dtype=layout.frame_dtype()))
                layout.check_marks(parts[-1], frame)
            chosen = np.concatenate(parts)
        else:
            handle.seek(layout.first_frame + wanted[0] * layout.frame_size)
            data = handle.read((wanted[-1] - wanted[0] + 1) * layout.frame_size)
            block = np.frombuffer(data, dtype=layout.frame_dtype())
            layout.check_marks(block, wanted[0])
            chosen = block[[f - wanted[0] for f in wanted]]
        numbers = np.asarray(wanted, dtype=np.int64)
        if self.table == "cells":
            # box values are stored as A, gamma, B, beta, alpha, C
            columns = [chosen["cell"][:, i].astype(np.float64) for i in (0, 2, 5)]
            yield self._batch(path, [numbers, *columns], "cells")
            return
        near = self.atoms.within(layout.num_atoms)
        atoms = np.arange(near.start, near.stop, dtype=np.int64)
        if self.atoms.listed is not None:
            atoms = atoms[np.isin(atoms, self.atoms.listed)]
        columns = [np.repeat(numbers, len(atoms)), np.tile(atoms, len(wanted))]
        columns += [chosen[axis][:, atoms].astype(np.float64).ravel() for axis in "xyz"]
        yield self._batch(path, columns, "frames")

    def _batch(self, path: str, columns: list[np.ndarray], table: str) -> pa.RecordBatch:
        names = [part.split()[0] for part in SCHEMAS[table].split(", ")]
        rows = len(columns[0])
        paths = pa.array([path]).take(pa.array(np.zeros(rows, dtype=np.int32)))
        return pa.RecordBatch.from_arrays([paths, *[pa.array(c) for c in columns]], names=names)

    def _check(self, handle, one: Slice) -> pa.RecordBatch:
        """Verdict on one byte range: the header, the first bad frame that starts in the range, and the file's tail if it
        ends here.  Verdicts of a file's ranges can be merged in any order."""
        header = bad = tail = atoms = step = declared = place = None
        seen = 0
        try:
            layout = load_layout(handle)
        except BadTrajectory as problem:
            header = str(problem)
        else:
            atoms, step, declared = layout.num_atoms, layout.time_step, layout.declared_frames
            first, last = self._own_frames(layout, one)
            chunk = max(1, (4 << 20) // layout.frame_size)
            for at in range(first, last, chunk):
                count = min(last, at + chunk) - at
                handle.seek(layout.first_frame + at * layout.frame_size)
                block = np.frombuffer(handle.read(count * layout.frame_size), dtype=layout.frame_dtype())
                try:
                    layout.check_marks(block, at)
                except BadTrajectory as problem:
                    bad, place = str(problem), at
                    break
            seen = len([f for f in range(first, last) if f % self.stride == 0])
            if one.stop >= one.size:
                tail = self._tail(layout, one.size)
        values = [one.path, header, atoms, step, declared, seen, place, bad, tail]
        types = [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [part.split()[0] for part in SCHEMAS["checks"].split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(values, types)], names=names)

    def _tail(self, layout: Layout, size: int) -> str | None:
        """What is wrong behind the last whole frame, unless the limit ends before it."""
        whole = self._last_wanted(layout.whole_frames(size))
        rest = size - layout.first_frame - whole * layout.frame_size
        more = self.max_frames <= 0 or -(-(whole + 1) // self.stride) <= self.max_frames
        return f"frame {whole}: file ends in the box block" if more and layout.has_cell and 0 < rest < CELL_BLOCK + 8 else None

    def _report(self, handle, partition: Slice) -> pa.RecordBatch:
        status, error, atoms, step, declared, loaded = "ok", "", None, None, None, 0
        try:
            layout = load_layout(handle)
            atoms, step, declared = layout.num_atoms, layout.time_step, layout.declared_frames
            whole = self._last_wanted(layout.whole_frames(partition.size))
            chunk = max(1, (4 << 20) // layout.frame_size)
            for at in range(0, whole, chunk):
                count = min(whole, at + chunk) - at
                handle.seek(layout.first_frame + at * layout.frame_size)
                block = np.frombuffer(handle.read(count * layout.frame_size), dtype=layout.frame_dtype())
                layout.check_marks(block, at)
            loaded = len([1 for f in range(0, whole, self.stride)][:self.max_frames or None])
            if loaded == 0:
                raise BadTrajectory("no complete frame")
            if problem := self._tail(layout, partition.size):
                raise BadTrajectory(problem)
        except BadTrajectory as problem:
            status, error, loaded = "error", str(problem), 0
        values = [[partition.path], [status], [error], [atoms], [step], [declared], [loaded]]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        names = [part.split()[0] for part in SCHEMAS["report"].split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(values, types)], names=names)


class TrajectorySource(DataSource):
    """``dcd`` data source."""

    @classmethod
    def name(cls) -> str:
        return "dcd"

    def _table(self) -> str:
        table = self.options.get("table", "frames")
        if table not in SCHEMAS:
            raise ValueError(f"table has to be one of {sorted(SCHEMAS)}")
        return table

    def schema(self) -> str:
        return SCHEMAS[self._table()]

    def reader(self, schema) -> TrajectoryReader:
        return TrajectoryReader(dict(self.options), self._table())


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(TrajectorySource)


def report(spark: SparkSession, folder: str, stride: int = 1, max_frames: int = 0, split_bytes: int = 64 << 20) -> DataFrame:
    """One row per file, ``status``, ``error``, ``num_atoms``, ``time_step``, ``frames_in_file`` and ``frames_loaded``, from checks
    of all its ranges: a file of any size is checked by many tasks.

    The first of these is the error: a bad header, the bad frame with the smallest number, no complete frame, a tail
    that breaks off in a box.  A file with an error has no loaded frames.
    """
    register(spark)
    checks = (spark.read.format("dcd").option("table", "checks").option("stride", stride).option("maxFrames", max_frames)
              .option("splitBytes", split_bytes).load(folder))
    merged = checks.groupBy("path").agg(
        F.max("header_error").alias("header_error"), F.min(F.when(F.col("error").isNotNull(), F.struct("bad_frame", "error")))["error"].alias("bad"),
        F.max("tail_error").alias("tail_error"), F.sum("frames_seen").alias("seen"),
        *[F.max(c).alias(c) for c in ("num_atoms", "time_step", "frames_in_file")])
    error = F.coalesce("header_error", "bad", F.when(F.col("seen") == 0, "no complete frame"), "tail_error")
    return merged.select(
        "path", F.when(error.isNull(), "ok").otherwise("error").alias("status"), F.coalesce(error, F.lit("")).alias("error"),
        "num_atoms", "time_step", "frames_in_file", F.when(error.isNull(), F.col("seen")).otherwise(0).alias("frames_loaded"))


def encode_header(num_atoms: int, num_frames: int, time_step: float = 0.002, has_cell: bool = False,
                  order: str = "<", title: bytes = b"") -> bytes:
    """Header, one title line and atom count of a trajectory file."""
    control = [0] * 20
    control[0], control[10], control[19] = num_frames, int(has_cell), 24
    packed = bytearray(struct.pack(order + "20i", *control))
    packed[36:40] = struct.pack(order + "f", time_step)
    mark = struct.pack(order + "i", HEADER_BLOCK)
    line = title[:80].ljust(80)
    return (mark + MAGIC + bytes(packed) + mark + struct.pack(order + "2i", 84, 1) + line
            + struct.pack(order + "i", 84) + struct.pack(order + "3i", 4, num_atoms, 4))


def encode_frames(xyz: np.ndarray, cells: np.ndarray | None = None, order: str = "<") -> bytes:
    """Frames of shape (frames, atoms, 3), optionally with box lengths of shape (frames, 3)."""
    frames, atoms = xyz.shape[0], xyz.shape[1]
    layout = Layout(order, frames, 0.0, atoms, cells is not None, 0)
    block = np.zeros(frames, dtype=layout.frame_dtype())
    if cells is not None:
        block["cell_open"] = block["cell_close"] = CELL_BLOCK
        block["cell"] = 90.0
        for slot, axis in ((0, 0), (2, 1), (5, 2)):
            block["cell"][:, slot] = cells[:, axis]
    for i, axis in enumerate("xyz"):
        block[f"{axis}_open"] = block[f"{axis}_close"] = layout.axis_block
        block[axis] = xyz[:, :, i]
    return block.tobytes()


register_pickle_by_value(sys.modules[__name__])
