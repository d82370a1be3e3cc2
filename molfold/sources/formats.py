"""``spark.read.format("sdf")`` and ``spark.read.format("fpdb")``.

``register_formats(spark)`` makes both known.  Files may lie in any store that
has a URI of an Arrow file system; a path names a file or a folder.

``sdf``   one row per record.  Files are cut into ranges of ``splitBytes``; a
          record belongs to the range in which the end mark before it begins,
          so every record is read once whatever the line ends.  Columns that
          ``schema()`` leaves out are not built.  Comparisons of ``name`` are
          made before a record is parsed.
``fpdb``  the binary fingerprint files of :mod:`molfold.sources.fpfile`, cut
          into ranges of ``splitRows``.  Bounds of ``popcnt`` are compared in
          the block of counts, and only rows within them are read further.

Filters reach the sources by ``spark.sql.python.filterPushdown.enabled``, which
``register_formats`` turns on for the session: Spark refuses readers that take
filters while it is off.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.elements import SYMBOLS
from ..functions.smiles import MOL_T
from .fpfile import HEADER, MAGIC, VERSION, storage

MARK = b"\n$$$$"
CHUNK = 1 << 20
_INT = re.compile(r" *(-?[0-9]+)")
_FLOAT = re.compile(r"[ \t]*(-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)")
_KEY = re.compile(r"<([^>]*)>")
_PLACES = {s: z for z, s in reversed(list(enumerate(SYMBOLS[1:], 1)))}


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int


def _files(path: str, suffix: str) -> tuple[arrow_fs.FileSystem, list[arrow_fs.FileInfo]]:
    files, place = storage(path)
    info = files.get_file_info(place)
    if info.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == arrow_fs.FileType.File:
        return files, [info]
    found = files.get_file_info(arrow_fs.FileSelector(place))
    return files, sorted((i for i in found if i.type == arrow_fs.FileType.File and not i.base_name.startswith(("_", ".")) and i.base_name.endswith(suffix)), key=lambda i: i.path)


# --- structure-data files ---


def _int(text: str) -> int | None:
    m = _INT.match(text)
    return int(m[1]) if m and -(2**31) <= int(m[1]) < 2**31 else None


def _float(text: str) -> float:
    m = _FLOAT.match(text)
    return float(m[1]) if m else 0.0


def _charges(lines: list[str]) -> dict[int, int | None]:
    out: dict[int, int | None] = {}
    for line in lines:
        if line.startswith("M  CHG"):
            v = [w for w in re.split("[ \t]+", line[6:]) if w]
            n = (_int(v[0]) or 0) if len(v) >= 3 else 0
            out.update((_int(v[2 * k - 1]), _int(v[2 * k])) for k in range(1, min(n, (len(v) - 1) // 2) + 1))
    return out


def _properties(lines: list[str]) -> dict[str, str]:
    """Values by key, the first of equal keys; a value ends at an empty line."""
    out: dict[str, str] = {}
    key, value = "", []
    for line in [*lines, ">  <>"]:
        heads = len(line) > 3 and line[0] == ">"
        if key and (heads or not line):
            out.setdefault(key, "\n".join(value))
            key = ""
        elif key:
            value.append(line)
        if heads:
            m = _KEY.search(line)
            key, value = m[1] if m else "", []
    return out


def sdf_record(text: str, wanted: Iterable[str]) -> dict | None:
    """The wanted columns of one record, None if its counts line is broken or it has no atoms."""
    lines = [line.removesuffix("\r") for line in text.split("\n")]
    if len(lines) < 4 or len(lines[3]) < 6:
        return None
    n_atoms, n_bonds = _int(lines[3][:3]), _int(lines[3][3:6])
    if n_atoms is None or n_bonds is None or len(lines) < 4 + n_atoms + n_bonds:
        return None
    atom_lines = [t for t in lines[4 : 4 + n_atoms] if len(t) >= 34]
    if not atom_lines:
        return None
    rest = lines[4 + n_atoms + n_bonds :]
    cut = next((k for k, t in enumerate(rest) if t.startswith("M  END")), None)
    row: dict = {"name": lines[0].strip(" \t")}
    for k, axis in enumerate("xyz"):
        if axis in wanted:
            row[axis] = [_float(t[10 * k : 10 * k + 10]) for t in atom_lines]
    if "props" in wanted:
        row["props"] = _properties(rest[cut + 1 :] if cut is not None else [])
    if "mol" in wanted:
        charges = _charges(rest if cut is None else rest[: cut + 1])
        zero = {"num_h": 0, "isotope": 0, "aromatic": False, "in_ring": False, "explicit_h": False, "chirality": 0}
        atoms = [{"z": _PLACES.get(t[31:34].strip(" \t\r"), 0), "charge": charges.get(k, 0) or 0, **zero} for k, t in enumerate(atom_lines, 1)]
        ends = [(_int(t[:3]), _int(t[3:6]), _int(t[6:9])) for t in lines[4 + n_atoms : 4 + n_atoms + n_bonds] if len(t) >= 9]
        bonds = [{"a": a - 1, "b": b - 1, "bond_order": {2: 2, 3: 3, 4: 5}.get(order, 1), "in_ring": False} for a, b, order in ends if a is not None and b is not None]
        near: list[list[dict]] = [[] for _ in atoms]
        for k, x in enumerate(bonds):
            for at, to in ((x["a"], x["b"]), (x["b"], x["a"]))[: 1 + (x["a"] != x["b"])]:
                if 0 <= at < len(near):
                    near[at].append({"atom": to, "bond": k, "bond_order": x["bond_order"], "in_ring": False})
        row["mol"] = {"atoms": atoms, "bonds": bonds, "adj": near}
    return row


def sdf_texts(stream, start: int, end: int) -> Iterator[bytes]:
    """Records whose end mark before them begins in a range; the first record has it before the file."""
    stream.seek(start)
    held, at, first, done = b"" if start else b"\n", start if start else -1, start == 0, False
    while not done:
        more = stream.read(CHUNK)
        held, done = held + more, not more
        while True:
            if not first:  # to the end of the mark's line
                mark = held.find(MARK)
                if mark < 0:
                    keep = min(len(held), len(MARK) - 1)
                    at, held = at + len(held) - keep, held[len(held) - keep :]
                    if at >= end:
                        return
                    break
                if at + mark >= end:
                    return
                line = held.find(b"\n", mark + len(MARK))
                if line < 0:
                    if done:
                        return
                    break
                # the line end stays: it may begin the next mark
                body = line
            else:
                body = 0
            stop = held.find(MARK, body)
            if stop < 0 and not done:
                break
            text = held[body + 1 : (stop if stop >= 0 else len(held) - 1) + 1]
            if text.strip():
                yield text
            if stop < 0:
                return
            first = False
            at, held = at + stop, held[stop:]


class SdfReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.options, self.tests = schema, options, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, StringStartsWith)) and f.attribute == ("name",):
                self.tests.append((isinstance(f, EqualTo), f.value))
            else:
                yield f

    def partitions(self) -> list[Part]:
        split = int(self.options.get("splitbytes", 64 << 20))
        return [Part(i.path, low, min(low + split, i.size)) for i in _files(self.options["path"], "")[1] for low in range(0, i.size, split)]

    def _fits(self, text: str) -> bool:
        name = text.split("\n", 1)[0].removesuffix("\r").strip(" \t")
        return all(name == value if equal else name.startswith(value) for equal, value in self.tests)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        kind, wanted, rows = to_arrow_schema(self.schema), set(self.schema.names), []
        with storage(self.options["path"])[0].open_input_file(partition.path) as stream:
            for data in sdf_texts(stream, partition.start, partition.end):
                text = data.decode("utf-8", "replace")
                row = sdf_record(text, wanted) if self._fits(text) else None
                if row is not None:
                    rows.append(row)
                if len(rows) == 2048:
                    yield pa.RecordBatch.from_pylist(rows, kind)
                    rows = []
        yield pa.RecordBatch.from_pylist(rows, kind)


class SdfSource(DataSource):
    """Structure-data files."""

    @classmethod
    def name(cls) -> str:
        return "sdf"

    def schema(self) -> str:
        return f"name string, mol {MOL_T}, x array<double>, y array<double>, z array<double>, props map<string,string>"

    def reader(self, schema: StructType) -> SdfReader:
        return SdfReader(schema, dict(self.options))


# --- binary fingerprint files ---


class FingerprintReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.options = schema, options
        self.low, self.high = -(2**31), 2**31 - 1

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("popcnt",) or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
                continue
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))

    def partitions(self) -> list[Part]:
        split = int(self.options.get("splitrows", 1 << 18))
        files, found = _files(self.options["path"], ".fpdb")
        parts = []
        for info in found:
            with files.open_input_file(info.path) as f:
                n = _header(f.read(struct.calcsize(HEADER)))[1]
            parts += [Part(info.path, low, min(low + split, n)) for low in range(0, n, split)]
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        kind, names = to_arrow_schema(self.schema), self.schema.names
        start, end = partition.start, partition.end
        with storage(self.options["path"])[0].open_input_file(partition.path) as f:
            size = struct.calcsize(HEADER)
            words, n = _header(f.read(size))
            counts = np.frombuffer(f.read_at(4 * (end - start), size + 8 * n * words + 4 * start), "<i4")
            if len(counts) < end - start:
                raise ValueError("read failed")
            keep = np.flatnonzero((counts >= self.low) & (counts <= self.high))
            if not len(keep):
                return
            columns: dict[str, pa.Array] = {"popcnt": pa.array(counts[keep])}
            if "fp" in names:
                first, last = int(keep[0]), int(keep[-1]) + 1
                rows = np.frombuffer(f.read_at(8 * words * (last - first), size + 8 * words * (start + first)), "<i8").reshape(-1, words)[keep - first]
                columns["fp"] = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * words, pa.int32()), pa.array(rows.ravel()))
            if "id" in names:
                columns["id"] = pa.array(self._ids(f, size + n * (8 * words + 4), start, keep))
        yield pa.RecordBatch.from_arrays([columns[c] for c in names], schema=kind)

    @staticmethod
    def _ids(f, at: int, start: int, keep: np.ndarray) -> list[str]:
        """Ids of some rows; they follow each other with their lengths, so those before are stepped over."""
        f.seek(at)
        held, place, out, wanted = b"", 0, [], iter((keep + start).tolist())
        row, goal = 0, next(wanted)
        while True:
            while len(held) < place + 2 or len(held) < place + 2 + int.from_bytes(held[place : place + 2], "little"):
                more = f.read(CHUNK)
                if not more:
                    raise ValueError("read failed")
                held, place = held[place:] + more, 0
            length = int.from_bytes(held[place : place + 2], "little")
            if row == goal:
                out.append(held[place + 2 : place + 2 + length].decode())
                goal = next(wanted, None)
                if goal is None:
                    return out
            row, place = row + 1, place + 2 + length


def _header(data: bytes) -> tuple[int, int]:
    """(words per row, rows)."""
    if len(data) < struct.calcsize(HEADER):
        raise ValueError("truncated header")
    magic, version, words, _, n = struct.unpack(HEADER, data)
    if magic != MAGIC:
        raise ValueError("bad magic")
    if version != VERSION:
        raise ValueError("unsupported version")
    return words, n


class FingerprintSource(DataSource):
    """Binary fingerprint files."""

    @classmethod
    def name(cls) -> str:
        return "fpdb"

    def schema(self) -> str:
        return "id string, fp array<bigint>, popcnt int"

    def reader(self, schema: StructType) -> FingerprintReader:
        return FingerprintReader(schema, dict(self.options))


def register_formats(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SdfSource)
    spark.dataSource.register(FingerprintSource)
