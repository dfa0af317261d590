"""PCD files: a text header, then points as text, as records, or as compressed columns.

read_pcd and write_pcd work on whole folders by a Python data source,
`format("pcd")` (register with `register(spark)`): files are read in splits, and
each partition of a DataFrame is written as one file.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import lzf

KINDS = ("ascii", "binary", "binary_compressed")
_NUMPY = {("U", 1): "u1", ("I", 1): "i1", ("U", 2): "u2", ("I", 2): "i2", ("U", 4): "u4", ("I", 4): "i4", ("F", 4): "f4", ("U", 8): "u8", ("I", 8): "i8", ("F", 8): "f8", ("U", 16): "V16", ("I", 16): "V16"}
_SPARK = {"u1": T.ShortType(), "i1": T.ByteType(), "u2": T.IntegerType(), "i2": T.ShortType(), "u4": T.LongType(), "i4": T.IntegerType(), "f4": T.FloatType(), "u8": T.DecimalType(20, 0), "i8": T.LongType(), "f8": T.DoubleType(), "V16": T.BinaryType()}
#: Types by size, where the header has no TYPE.
_DEFAULT = {1: "I", 2: "I", 4: "F", 8: "F", 16: "I"}
#: Columns that files keep in one field of several numbers.
GROUPS = {"normal": ("nx", "ny", "nz"), "viewpoint": ("vx", "vy", "vz")}
ALIASES = {"rgb": "rgba", "normal_x": "nx", "normal_y": "ny", "normal_z": "nz"}
#: What a point has where a file doesn't say.
DEFAULTS = {"x": 0.0, "y": 0.0, "z": 0.0, "nx": 0.0, "ny": 0.0, "nz": 0.0, "curvature": 0.0, "intensity": 0.0, "range": 0.0, "vx": 0.0, "vy": 0.0, "vz": 0.0, "rgba": 0, "label": 0}


class PcdError(ValueError):
    pass


@dataclass
class Field:
    name: str
    kind: str = "F"
    size: int = 4
    count: int = 1

    @property
    def dtype(self) -> str:
        if (self.kind, self.size) not in _NUMPY:
            raise PcdError(f"no type {self.kind}{self.size}")
        return _NUMPY[self.kind, self.size]


@dataclass
class Header:
    fields: list[Field]
    width: int
    height: int
    viewpoint: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)  # position, then quaternion x y z w
    data: str = "ascii"
    extra: dict = field(default_factory=dict)

    @property
    def points(self) -> int:
        return self.width * self.height

    def record(self) -> np.dtype:
        return np.dtype([(f"f{k}", "<" + f.dtype if f.size > 1 and f.dtype != "V16" else f.dtype, (f.count,)) for k, f in enumerate(self.fields)])

    def text(self) -> str:
        rows = [("VERSION", [".7"]), ("FIELDS", [f.name for f in self.fields]), ("SIZE", [f.size for f in self.fields]), ("TYPE", [f.kind for f in self.fields]), ("COUNT", [f.count for f in self.fields])]
        rows += [("WIDTH", [self.width]), ("HEIGHT", [self.height]), ("VIEWPOINT", [f"{v:g}" for v in self.viewpoint]), ("POINTS", [self.points]), ("DATA", [self.data])]
        return "".join(f"{k} {' '.join(map(str, v))}\n" for k, v in rows)


def parse_header(blob: bytes) -> tuple[Header, int]:
    """(header, where the data start).  Unknown keys and comments are skipped."""
    at, got = 0, {}
    while "DATA" not in got:
        end = blob.find(b"\n", at)
        if end < 0:
            raise PcdError("the header ends early")
        line = blob[at:end].decode("ascii", "replace").strip()
        at = end + 1
        if not line or line.startswith("#"):
            continue
        key, blank, rest = line.partition(" ")
        if not blank:
            raise PcdError(f"a header line without a value: {line}")
        got["FIELDS" if key == "COLUMNS" else key] = rest.split()
    try:
        names = got["FIELDS"]
        sizes = [int(v) for v in got["SIZE"]]
        kinds = got.get("TYPE", [_DEFAULT.get(s, "F") for s in sizes])
        counts = [int(v) for v in got.get("COUNT", [1] * len(names))]
        width, height = int(got["WIDTH"][0]), int(got.get("HEIGHT", [1])[0])
        points = int(got.get("POINTS", [width * height])[0])
        view = tuple(float(v) for v in got.get("VIEWPOINT", [0, 0, 0, 0, 0, 0, 1]))
    except (KeyError, ValueError, IndexError) as e:
        raise PcdError(f"a bad header: {e}") from e
    if not len(names) == len(sizes) == len(kinds) == len(counts) or points != width * height or got["DATA"][0] not in KINDS:
        raise PcdError("the header contradicts itself")
    return Header([Field(*f) for f in zip(names, kinds, sizes, counts, strict=True)], width, height, view, got["DATA"][0]), at


def decode(blob: bytes) -> tuple[Header, dict[str, np.ndarray]]:
    """(header, a points x count array for each field)."""
    head, at = parse_header(blob)
    n, dtype = head.points, head.record()
    if head.data == "ascii":
        words = blob[at:].split()
        per = sum(f.count for f in head.fields)
        if len(words) < n * per:
            raise PcdError("points are missing")
        table = np.array(words[: n * per], "S").reshape(n, per)
        out, k = {}, 0
        for f in head.fields:
            out[f.name] = _numbers(table[:, k : k + f.count], f)
            k += f.count
        return head, out
    if head.data == "binary":
        raw = blob[at : at + n * dtype.itemsize]
        if len(raw) < n * dtype.itemsize:
            raise PcdError("points are missing")
        rows = np.frombuffer(raw, dtype)
        return head, {f.name: rows[f"f{k}"] for k, f in enumerate(head.fields)}
    packed, size = (int.from_bytes(blob[at + k : at + k + 4], "little") for k in (0, 4))
    raw = lzf.decompress(blob[at + 8 : at + 8 + packed], size) if packed != size else blob[at + 8 : at + 8 + size]
    if len(raw) < n * dtype.itemsize:
        raise PcdError("points are missing")
    out, k = {}, 0
    for f in head.fields:
        end = k + n * f.size * f.count
        out[f.name] = np.frombuffer(raw[k:end], f.dtype).reshape(n, f.count)
        k = end
    return head, out


def _numbers(words: np.ndarray, f: Field) -> np.ndarray:
    """The values of a field's words; integers may be written as floats."""
    if f.dtype == "V16":
        return np.array([[int(w) for w in row] for row in words.tolist()], object).reshape(words.shape)
    if not words.size:
        return np.zeros(words.shape, f.dtype)
    try:
        return words.astype("f8").astype(f.dtype) if f.kind == "F" else words.astype("u8" if f.kind == "U" else "i8").astype(f.dtype)
    except ValueError:
        return words.astype("f8").astype("i8").astype(f.dtype)


def encode(head: Header, columns: dict[str, np.ndarray]) -> bytes:
    """The file's bytes.  Compressed data that don't shrink are stored as they are, with equal sizes."""
    parts = _parts(head, columns, head.points)
    out = head.text().encode()
    if head.data != "binary_compressed":
        return out + _rows(head, parts)
    raw = b"".join(p.tobytes() for p in parts)
    try:
        packed = lzf.compress(raw)
    except lzf.NoCompressionPossible:
        packed = raw
    return out + len(packed).to_bytes(4, "little") + len(raw).to_bytes(4, "little") + packed


def _parts(head: Header, columns: dict[str, np.ndarray], n: int) -> list[np.ndarray]:
    """n values of each field, in the file's types."""
    return [np.asarray(columns[f.name]).astype(f.dtype).reshape(n, f.count) for f in head.fields]


def _rows(head: Header, parts: list[np.ndarray]) -> bytes:
    """Points as lines of text or as records."""
    if head.data == "ascii":
        texts = [p[:, k].astype(str).tolist() for p in parts for k in range(p.shape[1])]
        return "".join(" ".join(row) + "\n" for row in zip(*texts, strict=True)).encode()
    rows = np.zeros(len(parts[0]) if parts else 0, head.record())
    for k, p in enumerate(parts):
        rows[f"f{k}"] = p
    return rows.tobytes()


# --- columns ------------------------------------------------------------------------


def spark_schema(head: Header) -> T.StructType:
    """Fields by their own names; several numbers are arrays."""
    return T.StructType([T.StructField(f.name, _SPARK[f.dtype] if f.count == 1 else T.ArrayType(_SPARK[f.dtype])) for f in head.fields])


def point_columns(head: Header, data: dict[str, np.ndarray], names: list[str]) -> dict[str, np.ndarray]:
    """Point columns by name, whatever the order of the fields; what the file lacks has its default.

    Integer colours and labels are taken as they are; float ones hold the bits of one.
    """
    have: dict[str, np.ndarray] = {}
    for f in head.fields:
        targets = GROUPS.get(f.name, (ALIASES.get(f.name, f.name),))
        for k, name in enumerate(targets[: f.count]):
            if name in have:
                raise PcdError(f"two fields for {name}")
            part = data[f.name][:, k]
            have[name] = np.ascontiguousarray(part).view("u4").astype("i8") if name in ("rgba", "label") and f.kind == "F" and f.size == 4 else part.astype("i8") if name in ("rgba", "label") else part.astype("f8")
    return {n: have[n] if n in have else np.full(head.points, DEFAULTS.get(n, math.nan)) for n in names}


def header_for(columns: list[str], n: int, width: int | None, data: str, viewpoint=None) -> Header:
    """Fields for point columns: a group is one field; floats of 4 bytes, colours and labels as unsigned integers."""
    fields, done = [], set()
    for c in columns:
        group = next((g for g, m in GROUPS.items() if c in m and all(k in columns for k in m)), None)
        if group:
            if group not in done:
                fields.append(Field(group, "F", 4, len(GROUPS[group])))
                done.add(group)
        else:
            fields.append(Field(c, "U" if c in ("rgba", "label") else "F", 4, 1))
    w = width if width and n % width == 0 else n
    return Header(fields, w if n else 0, n // w if w else 1, viewpoint or (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), data)


def pack(columns: dict[str, np.ndarray], width: int | None = None, data: str = "binary", viewpoint=None) -> bytes:
    n = len(next(iter(columns.values()))) if columns else 0
    head = header_for(list(columns), n, width, data, viewpoint)
    return encode(head, _grouped(head, columns))


def _grouped(head: Header, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Values by field: those of a group side by side."""
    return {f.name: np.column_stack([columns[c] for c in GROUPS[f.name]]) if f.name in GROUPS else columns[f.name] for f in head.fields}


COLUMN_TYPES = {"rgba": "long", "label": "long"}


def read_pcd(spark: SparkSession, path: str, columns: list[str] | None = None, viewpoint: bool = False, split: int | None = None) -> DataFrame:
    """file, idx (position in the file), row, col and the point columns of all files under a path; with `viewpoint` also the file's (position, then quaternion x y z w).

    Files are read in splits of about `split` bytes of points (SPLIT), only the
    columns asked for are decoded, and no task holds more than its own points of them.
    With spark.sql.python.filterPushdown.enabled, bounds of idx leave splits out.
    """
    register(spark)
    names = columns or ["x", "y", "z"]
    more = ["file", "row", "col", *(["viewpoint"] if viewpoint else [])]
    found = spark.read.format("pcd").option("columns", ",".join(names)).option("more", ",".join(more)).option("split", str(split or SPLIT)).option("filters", spark.conf.get("spark.sql.python.filterPushdown.enabled")).load(path)
    return found.select("file", "idx", "row", "col", *names, *more[3:])


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """file, width, height, points, fields, data and viewpoint (position, then quaternion x y z w) of all files under a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [parse_header(blob.as_py())[0] for blob in batch.column(1)]
            rows = [(h.width, h.height, h.points, [f.name for f in h.fields], h.data, h.viewpoint) for h in heads]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["file", "width", "height", "points", "fields", "data", "viewpoint"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, width long, height long, points long, fields array<string>, data string, viewpoint array<double>")


def write_pcd(df: DataFrame, path: str, data: str = "binary", width: int | None = None, single: bool = False, mode: str = "append", viewpoint: tuple[float, ...] | None = None) -> None:
    """The columns of df, ordered by idx, as one file for each partition (ranges of idx), or as a single one for a cloud that one task can hold."""
    names = [c for c in df.columns if c not in ("idx", "row", "col", "file")]
    dealt = df.coalesce(1) if single else df.repartitionByRange("idx")
    out = dealt.sortWithinPartitions("idx").select(*names).write.format("pcd").option("data", data).option("width", str(width or 0)).mode(mode)
    if viewpoint:
        out = out.option("viewpoint", " ".join(map(repr, map(float, viewpoint))))
    out.save(path)


class PcdSource(DataSource):
    """spark.read.format("pcd").option("columns", "x,y,z").load(folder) and df.write.format("pcd").save(folder)."""

    @classmethod
    def name(cls) -> str:
        return "pcd"

    def schema(self) -> str:
        names, more = ([c.strip() for c in self.options.get(k, v).split(",") if c.strip()] for k, v in (("columns", "x,y,z"), ("more", "")))
        return ", ".join(["idx long", *(f"{c} {COLUMN_TYPES.get(c, 'double')}" for c in names), *(f"{c} {_MORE[c]}" for c in more)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        kind = _BoundedReader if self.options.get("filters", "false") == "true" else _Reader
        return kind(self.options["path"], schema.fieldNames(), int(self.options.get("split", SPLIT)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        view = tuple(float(v) for v in self.options.get("viewpoint", "").split())
        if view and len(view) != 7:
            raise PcdError("a viewpoint has seven numbers")
        return _Writer(self.options["path"], schema.fieldNames(), self.options.get("data", "binary"), int(self.options.get("width", 0) or 0), view or None, overwrite)


def _folder(path: str):
    """(Arrow file system, path): local folders, and what Arrow can open by its address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


#: Bytes of points that one task reads.
SPLIT = 64 << 20
#: Points in a batch.
BATCH = 65_536
#: Columns of the file and not of its points.
_MORE = {"file": "string", "row": "long", "col": "long", "viewpoint": "array<double>"}


@dataclass
class _Split(InputPartition):
    """Points first to last - 1 of a file; of a file of text, all."""

    path: str
    head: Header
    at: int
    first: int
    last: int


def _header(stream) -> tuple[Header, int]:
    """The header at the start of a stream, read until it is whole."""
    blob = b""
    while True:
        more = stream.read(1 << 12)
        blob += more
        try:
            return parse_header(blob)
        except PcdError:
            if not more or len(blob) > 1 << 20 or re.search(rb"(?m)^DATA\s.*\n", blob):
                raise


def _wanted(head: Header, names: list[str]) -> list[Field]:
    """The fields that the columns come from."""
    return [f for f in head.fields if any(t in names for t in GROUPS.get(f.name, (ALIASES.get(f.name, f.name),)))]


def _read_text(stream, part: _Split, fields: list[Field]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Points of a file of text, batch by batch."""
    per, n, rest = sum(f.count for f in part.head.fields), 0, []
    columns, k = {}, 0
    for f in part.head.fields:
        columns[f.name] = slice(k, k + f.count)
        k += f.count
    cut = b""
    while n < part.last:
        raw = stream.read(1 << 20)
        cut += raw
        end = max(cut.rfind(b"\n"), cut.rfind(b" ")) + 1 if raw else len(cut)
        rest += cut[:end].split()
        cut = cut[end:]
        have = min(len(rest) // per, part.last - n)
        if not raw and n + have < part.last:
            raise PcdError("points are missing")
        if have:
            table = np.array(rest[: have * per], "S").reshape(have, per)
            yield n, {f.name: _numbers(table[:, columns[f.name]], f) for f in fields}
            n, rest = n + have, rest[have * per :]


def _read_records(stream, part: _Split, fields: list[Field]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Points of a file of records: only the bytes of the split are read."""
    dtype, place = part.head.record(), {f.name: k for k, f in enumerate(part.head.fields)}
    stream.seek(part.at + part.first * dtype.itemsize)
    for lo in range(part.first, part.last, BATCH):
        n = min(BATCH, part.last - lo)
        raw = stream.read(n * dtype.itemsize)
        if len(raw) < n * dtype.itemsize:
            raise PcdError("points are missing")
        rows = np.frombuffer(raw, dtype)
        yield lo, {f.name: rows[f"f{place[f.name]}"] for f in fields}


def _read_columns(stream, part: _Split, fields: list[Field]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Points of a compressed file, which has one field after the other: unpacked as it is read, up to the last byte that is asked for, of which the rest is not kept."""
    stream.seek(part.at)
    packed, size = (int.from_bytes(stream.read(4), "little") for _ in range(2))
    head, parts, at = part.head, [], 0
    if size < head.points * head.record().itemsize:
        raise PcdError("points are missing")
    for f in head.fields:
        width = f.size * f.count
        if any(f is g for g in fields):
            parts.append((at + part.first * width, at + part.last * width, f, bytearray()))
        at += head.points * width
    chunks = lzf.stream(stream.read, packed) if packed != size else iter(lambda: stream.read(1 << 20), b"")
    seen, end = 0, max((p[1] for p in parts), default=0)
    while seen < end:
        chunk = next(chunks, b"")
        if not chunk:
            raise PcdError("points are missing")
        for lo, hi, _, held in parts:
            held += chunk[max(0, lo - seen) : max(0, hi - seen)]
        seen += len(chunk)
    yield part.first, {f.name: np.frombuffer(held, f.dtype).reshape(part.last - part.first, f.count) for _, _, f, held in parts}


_READ = {"ascii": _read_text, "binary": _read_records, "binary_compressed": _read_columns}


class _Reader(DataSourceReader):
    """Splits of whole records.  Text is one split a file, as a line's place tells nothing of its number, but is read in parts; compressed files have splits of the unpacked points."""

    def __init__(self, path: str, names: list[str], split: int):
        self.path, self.names, self.split = path, names, split
        self.least, self.most = 0, math.inf

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = _folder(self.path)
        info = system.get_file_info(path)
        files = [info] if info.is_file else system.get_file_info(fs.FileSelector(path))
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if f.path.endswith(".pcd"):
                with system.open_input_stream(f.path) as stream:
                    head, at = _header(stream)
                step = max(1, self.split // max(1, head.record().itemsize)) if head.data != "ascii" else max(1, head.points)
                out += [_Split(f.path, head, at, lo, min(head.points, lo + step)) for lo in range(0, head.points, step) if lo + step > self.least and lo <= self.most]
        return out or [_Split("", Header([], 0, 0), 0, 0, 0)]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        if part.first >= part.last:
            return
        points = [n for n in self.names if n != "idx" and n not in _MORE]
        system, _ = _folder(self.path)
        fields = _wanted(part.head, points)
        # Where no column is asked for that the file has, its points are still counted.
        with system.open_input_file(part.path) as stream:
            stream.seek(part.at)
            for lo, data in _READ[part.head.data](stream, part, fields or part.head.fields[:1]):
                n = len(next(iter(data.values())))
                got = point_columns(Header(fields, n, 1), data, points)
                for a in range(0, n, BATCH):
                    idx = np.arange(lo + a, lo + min(n, a + BATCH))
                    made = {"idx": pa.array(idx), "row": pa.array(idx // part.head.width), "col": pa.array(idx % part.head.width)}
                    made |= {c: pa.array(v[a : a + BATCH].astype("i8" if c in COLUMN_TYPES else "f8")) for c, v in got.items()}
                    if "file" in self.names:
                        made["file"] = pa.array([part.path] * len(idx), pa.string())
                    if "viewpoint" in self.names:
                        made["viewpoint"] = pa.array([part.head.viewpoint] * len(idx), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([made[c] for c in self.names], names=self.names)


class _BoundedReader(_Reader):
    """The same where the session lets sources see filters."""

    def pushFilters(self, filters):
        """Bounds of idx leave splits out; Spark still tests all filters itself."""
        for f in filters:
            if getattr(f, "attribute", None) == ("idx",) and isinstance(getattr(f, "value", None), int):
                kind = type(f).__name__
                if kind in ("EqualTo", "GreaterThan", "GreaterThanOrEqual"):
                    self.least = max(self.least, f.value + (kind == "GreaterThan"))
                if kind in ("EqualTo", "LessThan", "LessThanOrEqual"):
                    self.most = min(self.most, f.value - (kind == "LessThan"))
        return filters


@dataclass
class _Written(WriterCommitMessage):
    name: str


class _Spools:
    """Parts of a file to come, each written and read in pieces, beside it in the job's folder: a header says how many points follow, which is known last."""

    def __init__(self, system, path: str):
        self.system, self.path, self.open, self.names = system, path, {}, []

    def add(self, name: str, data: bytes) -> None:
        if name not in self.open:
            self.names.append(name)
            self.open[name] = self.system.open_output_stream(f"{self.path}.{len(self.names)}")
        self.open[name].write(data)

    def pieces(self, name: str) -> Iterator[bytes]:
        if name in self.names:
            if stream := self.open.pop(name, None):
                stream.close()
            with self.system.open_input_stream(f"{self.path}.{self.names.index(name) + 1}") as stream:
                while piece := stream.read(1 << 20):
                    yield piece

    def clear(self) -> None:
        for k, name in enumerate(self.names):
            if stream := self.open.pop(name, None):
                stream.close()
            self.system.delete_file(f"{self.path}.{k + 1}")


class _Writer(DataSourceArrowWriter):
    """Tasks write into a folder of the job's own inside the target, which readers pass over; committed files are moved out of it, and what else is there goes with it."""

    def __init__(self, path: str, names: list[str], data: str, width: int, viewpoint: tuple[float, ...] | None, overwrite: bool):
        self.path, self.names, self.data, self.width, self.viewpoint, self.overwrite = path, names, data, width, viewpoint, overwrite
        self.job = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, folder = _folder(self.path)
        system.create_dir(f"{folder}/{self.job}", recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.pcd"
        spools = _Spools(system, f"{folder}/{self.job}/{name}")
        head = header_for(self.names, 0, None, self.data)
        n = size = 0
        for batch in iterator:
            at = {c: batch.column(batch.schema.get_field_index(c)) for c in self.names}
            parts = _parts(head, _grouped(head, {c: v.to_numpy(zero_copy_only=False).astype("i8" if c in COLUMN_TYPES else "f8") for c, v in at.items()}), batch.num_rows)
            if self.data != "binary_compressed":
                spools.add("rows", _rows(head, parts))
            else:
                for f, p in zip(head.fields, parts, strict=True):
                    spools.add(f.name, p.tobytes())
            n += batch.num_rows
        head = header_for(self.names, n, self.width or None, self.data, self.viewpoint)
        if self.data == "binary_compressed":
            packed = 0
            for f in head.fields:
                for piece in spools.pieces(f.name):
                    short = lzf.shorter(piece)
                    spools.add("packed", short)
                    packed, size = packed + len(short), size + len(piece)
            if size >= 1 << 32:
                raise PcdError("a compressed file holds less than 4 GiB; write more partitions")
            body = ["packed"] if packed < size else [f.name for f in head.fields]
            start = min(packed, size).to_bytes(4, "little") + size.to_bytes(4, "little")
        else:
            body, start = ["rows"], b""
        with system.open_output_stream(f"{folder}/{self.job}/{name}") as out:
            out.write(head.text().encode() + start)
            for k in body:
                for piece in spools.pieces(k):
                    out.write(piece)
        spools.clear()
        return _Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, folder = _folder(self.path)
        system.create_dir(folder, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.is_file and f.path.endswith(".pcd")] if self.overwrite else []
        for m in messages:
            if m is not None:
                system.move(f"{folder}/{self.job}/{m.name}", f"{folder}/{m.name}")
        for path in old:
            system.delete_file(path)
        self._clear(system, folder)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_folder(self.path))

    def _clear(self, system, folder: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{folder}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{folder}/{self.job}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcdSource)
