"""Scan files as a Spark data source: ``spark.read.format("scan_files")``, ``spark.readStream`` and ``df.write``.

    register(spark)
    spark.read.format("scan_files").load("/scans")                                        # header fields and blocks
    spark.read.format("scan_files").option("columns", "header").load("/scans")            # the header bytes only
    spark.readStream.format("scan_files").option("indexLocation", "/state/scans").load("/scans")
    df.select("name", "content").write.format("scan_files").mode("append").save("/scans")

Batch: the folder is listed once, one subfolder at a time, copies beside their source are left out, and files are packed into
partitions by size (``partitionBytes``). What planning holds of a file is its entry in a compressed list, so very many files
should be written to subfolders (names may hold them). Every candidate file gives a row; a file that cannot be decoded has ``decode_error`` in words and
``error_code`` as a key (too_large, unreadable, short_header, unknown_format, truncated_samples). Only the requested columns are made: without blocks,
hash or shape among them, 484 bytes of each file are read, whatever its length.

Stream: each trigger lists the folder and appends what is new, or has another length or time than before, to an index of small
files, ordered by (time, path); an entry's place in the index is its ``arrival_seq``, gapless and final. Offsets are lengths of
that index, so a replayed batch reads the same entries, and a file rewritten in place arrives again. In memory the index is
compressed by folder. ``maxFileAge`` (seconds) lets
the stream forget files that are so much older than the newest one: its memory is bounded by what arrives in that time.

Any file system that Arrow opens by URI works (local, hdfs, s3, gs). Names follow ``scan_files.candidate``.
"""
from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from lumenscan.sources import scan_files as SF

PARTITION_BYTES, OPEN_BYTES, BATCH, INDEX_FILE = 64 << 20, 1 << 16, 256, 10_000
_FILE = [T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("arrival_seq", T.LongType())]
_BLOCKS = {"ole_reference", "ole_spectrum", "sample_dn", "reference_dn", "stored_r"}
_SHAPE = T.StructType([T.StructField("state", T.StringType()), T.StructField("reason", T.StringType())])
FULL = T.StructType(_FILE + SF.DECODED.fields + [T.StructField("error_code", T.StringType()), T.StructField("file_sha256", T.StringType()), T.StructField("shape", _SHAPE)])
HEADERS = T.StructType([f for f in FULL.fields if f.name not in _BLOCKS | {"file_sha256", "shape"}])
_NAME, _TEMPORARY = re.compile(SF.CANDIDATE), re.compile(SF.TEMPORARY)


@dataclass
class Entry:
    path: str
    size: int
    time_us: int
    seq: int | None = None


def squeezed(rows: list) -> bytes:
    return zlib.compress(json.dumps(rows).encode(), 1)


def unsqueezed(b: bytes) -> list:
    return json.loads(zlib.decompress(b))


class Files(InputPartition):
    """Entries of one partition, compressed: planning holds all partitions at once."""

    def __init__(self, entries: list[Entry]) -> None:
        self.entries = squeezed([[e.path, e.size, e.time_us, e.seq] for e in entries])

    @property
    def value(self) -> list[Entry]:
        return [Entry(*x) for x in unsqueezed(self.entries)]


def opened(path: str) -> tuple[pfs.FileSystem, str]:
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]+:", path):
        return pfs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pfs.LocalFileSystem(), path


def _folder(path: str) -> str:
    return path.rpartition("/")[0]


def is_candidate(name: str) -> bool:
    return bool(_NAME.search(name)) and not _TEMPORARY.search(name)


def listed(path: str, recursive: bool = True) -> Iterator[Entry]:
    """Candidate files, without copies that stand beside their source, ordered by name in a folder; one folder is held at a time."""
    fs, root = opened(path)
    folders = [root]
    while folders:
        here = folders.pop()
        infos = fs.get_file_info(pfs.FileSelector(here, allow_not_found=here != root))
        found = {i.path: i for i in infos if i.type == pfs.FileType.File and is_candidate(i.base_name)}
        if recursive:
            folders += sorted((i.path for i in infos if i.type == pfs.FileType.Directory), reverse=True)
        del infos
        for p, i in sorted(found.items()):
            if not (p.lower().endswith(".sco") and p[:-4] in found):
                yield Entry(p, i.size, int(i.mtime_ns or 0) // 1000)


def packed(entries: Iterable[Entry], limit: int) -> list[Files]:
    """Partitions of about `limit` bytes; a file counts as OPEN_BYTES at least."""
    out: list[Files] = []
    part: list[Entry] = []
    size = 0
    for e in entries:
        cost = max(e.size, OPEN_BYTES)
        if part and size + cost > limit:
            out.append(Files(part))
            part, size = [], 0
        part.append(e)
        size += cost
    return out + [Files(part)] if part else out


def shape_of(read_at: Callable[[int, int], bytes], size: int) -> tuple[str, str | None]:
    """(state, reason) of a file from byte ranges: complete, incomplete (still being written) or unrecognised. The same rules as
    ``scan_files.file_shape``, without the whole content."""
    if size < 3:
        return "incomplete", "shorter than the file signature"
    head = read_at(0, min(size, SF.HEADER_BYTES))
    magic = head[:3]
    if magic == b"\0\0\0":
        return "incomplete", "file start is still zero-filled"
    if magic not in (b"as6", b"as7", b"as8", b"ASD"):
        return "unrecognised", "not a scan file"
    if size < SF.HEADER_BYTES:
        return "incomplete", "header incomplete"
    h = np.frombuffer(head, SF.HEAD, 1)[0]
    n = int(h["channels"])
    if n == 0:
        return "incomplete", "header not fully written (0 channels)"
    kind = SF.SAMPLE_TYPES.get(int(h["data_format"]))
    if kind is None:
        return "unrecognised", "unknown data format"
    width = np.dtype(kind).itemsize
    few = min(SF.ZERO_CHANNELS, n)
    end = SF.HEADER_BYTES + n * width
    if size < end:
        return "incomplete", "spectrum block incomplete"
    if magic in (b"ASD", b"as6"):
        empty = magic == b"ASD" and not any(read_at(end - few * width, few * width))
        return ("incomplete", "reflectance block is still zero-filled") if empty else ("complete", None)
    if size < end + 20:
        return "incomplete", "reference header incomplete"
    start = end + 20 + int.from_bytes(read_at(end + (17 if magic == b"as7" else 18), 2), "little")
    ref_end = start + n * width
    if size < ref_end:
        return "incomplete", "white-reference block incomplete"
    if magic == b"as8" and ref_end < size < ref_end + SF.TRAILER_BYTES:
        return "incomplete", "file trailer incomplete"
    first, step, hi = float(h["ch1_wavel"]), float(h["wavel_step"]), n
    if np.isfinite(first) and np.isfinite(step) and step > 0:
        at = int(np.floor((SF.ZERO_BELOW_NM - first) / step)) + 1
        hi = at if 1 <= at <= n else n
    lo = max(hi - SF.ZERO_CHANNELS, 0)
    if not any(read_at(start + lo * width, (hi - lo) * width)) or not any(read_at(ref_end - few * width, few * width)):
        return "incomplete", "white-reference block is still zero-filled"
    return "complete", None


def lowered(options) -> dict:
    """Option names ignore case."""
    return {k.lower(): v for k, v in options.items()}


def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """BATCH rows at a time: what Python makes of a row is many times its size."""
    for b in batches:
        yield from (b.slice(k, BATCH) for k in range(0, b.num_rows, BATCH))


class _Rows:
    """Reads one partition's files into the requested columns."""

    def __init__(self, options: dict, schema: T.StructType) -> None:
        options = lowered(options)
        self.path = options["path"]
        self.schema = schema
        self.limit = int(options.get("maxfilebytes", SF.MAX_FILE_BYTES))
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.recursive = options.get("recursivefilelookup", "true").lower() == "true"
        names = set(schema.fieldNames())
        self.whole = bool(names & (_BLOCKS | {"file_sha256"}))
        self.shape = "shape" in names

    def row(self, fs: pfs.FileSystem, e: Entry) -> dict:
        base = {"path": e.path, "modificationTime": datetime.fromtimestamp(e.time_us / 1e6, timezone.utc), "length": e.size, "arrival_seq": e.seq}
        if e.size > self.limit:
            return {**base, "decode_error": f"unsupported: larger than {self.limit >> 20} MiB", "error_code": "too_large",
                    "shape": ("unrecognised", f"larger than {self.limit >> 20} MiB")}
        try:
            with fs.open_input_file(e.path) as f:
                size = f.size()
                if self.whole:
                    b = f.read()
                    got = {**SF.decode_file(b), "file_sha256": hashlib.sha256(b).hexdigest()}
                    at = lambda off, n: b[off:off + n]
                else:
                    got = SF.decode_header(f.read_at(min(size, SF.HEADER_BYTES), 0), size)
                    at = lambda off, n: f.read_at(n, off)
                if self.shape:
                    got["shape"] = shape_of(at, size)
        except OSError as problem:
            return {**base, "decode_error": f"unsupported: {type(problem).__name__}", "error_code": "unreadable", "shape": ("incomplete", "cannot be opened")}
        return {**base, **got, "error_code": SF.DECODE_CODES.get(got.get("decode_error"))}

    def batches(self, entries: list[Entry]) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        for k in range(0, len(entries), BATCH):
            rows = [self.row(fs, e) for e in entries[k:k + BATCH]]
            columns = []
            for f in self.schema.fields:
                if f.name == "modificationTime":
                    columns.append(pa.array([r[f.name] for r in rows], pa.timestamp("us", "UTC")))
                elif f.name == "shape":
                    columns.append(pa.array([dict(zip(("state", "reason"), r["shape"])) for r in rows], pa.struct([("state", pa.string()), ("reason", pa.string())])))
                else:
                    columns.append(SF.arrow_column(rows, f))
            yield pa.RecordBatch.from_arrays(columns, self.schema.fieldNames())


class ScanReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.rows = _Rows(options, schema)

    def partitions(self) -> list[Files]:
        return packed(listed(self.rows.path, self.rows.recursive), self.rows.partition_bytes) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from self.rows.batches(partition.value)


class Index:
    """What has arrived, in order: numbered small files of entries, each written under another name first. What is known of a
    folder's files is held as compressed lists of (path, size, time), the later ones over the earlier ones."""

    def __init__(self, location: str) -> None:
        self.fs, self.root = opened(location)
        self.fs.create_dir(self.root, recursive=True)
        self.files: list[tuple[int, int, str]] = []      # first entry, entries, path
        self.folders: dict[str, list[bytes]] = {}
        self.length, self.newest = 0, 0
        names = sorted(i.path for i in self.fs.get_file_info(pfs.FileSelector(self.root)) if i.base_name.endswith(".json"))
        for name in names:
            self._take(name, self._load(name))

    @property
    def known(self) -> dict[str, tuple[int, int]]:
        return {p: v for f in self.folders for p, v in self._known(f).items()}

    def _known(self, folder: str) -> dict[str, tuple[int, int]]:
        return {p: (size, time) for b in self.folders.get(folder, []) for p, size, time in unsqueezed(b)}

    def _load(self, name: str) -> list[Entry]:
        with self.fs.open_input_stream(name) as f:
            return [Entry(*x) for x in json.loads(f.read())]

    def _take(self, name: str, entries: list[Entry]) -> None:
        self.files.append((self.length, len(entries), name))
        self.length += len(entries)
        for folder, own in groupby(sorted(entries, key=lambda e: _folder(e.path)), lambda e: _folder(e.path)):    # stable: later entries stay behind earlier ones
            self.folders.setdefault(folder, []).append(squeezed([[e.path, e.size, e.time_us] for e in own]))
        self.newest = max([self.newest, *(e.time_us for e in entries)])

    def add(self, found: Iterable[Entry], max_age_us: int | None) -> None:
        """Append what is new or changed. Files older than the age are neither remembered nor taken. `found` comes folder by folder."""
        newest, parts = self.newest, []
        for folder, own in groupby(found, lambda e: _folder(e.path)):
            known, own = self._known(folder), list(own)
            newest = max([newest, *(e.time_us for e in own)])
            own = [e for e in own if known.get(e.path) != (e.size, e.time_us)]
            if known and len(self.folders[folder]) > 1:
                self.folders[folder] = [squeezed([[p, *v] for p, v in known.items()])]
            if own:
                parts.append(pa.table({"time": pa.array([e.time_us for e in own], pa.int64()), "path": pa.array([e.path for e in own], pa.large_string()), "size": pa.array([e.size for e in own], pa.int64())}))
        oldest = newest - max_age_us if max_age_us is not None else -1
        if max_age_us is not None:
            for folder in list(self.folders):
                kept = [[p, *v] for p, v in self._known(folder).items() if v[1] >= oldest]
                self.folders[folder] = [squeezed(kept)]
                if not kept:
                    del self.folders[folder]
        if not parts:
            return
        fresh = pa.concat_tables(parts).combine_chunks()     # or every take would join the chunks again
        del parts
        if max_age_us is not None:
            fresh = fresh.filter(pc.greater_equal(fresh["time"], oldest)).combine_chunks()
        order = pc.sort_indices(fresh, sort_keys=[("time", "ascending"), ("path", "ascending")])
        for k in range(0, len(order), INDEX_FILE):
            rows = fresh.take(order.slice(k, INDEX_FILE))
            entries = [Entry(p, size, t, self.length + n) for n, (p, size, t) in enumerate(zip(rows["path"].to_pylist(), rows["size"].to_pylist(), rows["time"].to_pylist()), 1)]
            name, draft = f"{self.root}/{self.length:012d}.json", f"{self.root}/.{uuid.uuid4().hex}"
            with self.fs.open_output_stream(draft) as f:
                f.write(json.dumps([[e.path, e.size, e.time_us, e.seq] for e in entries]).encode())
            self.fs.move(draft, name)
            self._take(name, entries)

    def entries(self, start: int, end: int) -> Iterator[Entry]:
        """Entries start + 1 to end; one file of the index is held at a time."""
        for first, n, name in self.files:
            if first < end and first + n > start:
                yield from (e for e in self._load(name) if start < e.seq <= end)

    def between(self, start: int, end: int) -> list[Entry]:
        return list(self.entries(start, end))


class ScanStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        options = lowered(options)
        if "indexlocation" not in options:
            raise ValueError("a stream of scan files needs option indexLocation, a folder that only this query writes to")
        self.rows = _Rows(options, schema)
        self.location = options["indexlocation"]
        self.max_files = int(options["maxfilespertrigger"]) if "maxfilespertrigger" in options else None
        self.max_age_us = int(float(options["maxfileage"]) * 1e6) if "maxfileage" in options else None
        self.index: Index | None = None
        self.served = 0

    def _index(self) -> Index:
        if self.index is None:
            self.index = Index(self.location)
        return self.index

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        index = self._index()
        index.add(listed(self.rows.path, self.rows.recursive), self.max_age_us)
        self.served = index.length if self.max_files is None else min(index.length, self.served + self.max_files)
        return {"entries": self.served}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.served = max(self.served, end["entries"])
        return packed(self._index().entries(start["entries"], end["entries"]), self.rows.partition_bytes) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from self.rows.batches(partition.value)

    def commit(self, end: dict) -> None:
        self.served = max(self.served, end["entries"])


class ScanWriter(DataSourceArrowWriter):
    """One file per row (name, content). A file appears under its name only when it is whole; the files of a failed attempt are
    replaced by those of the next one, as they have the same names."""

    def __init__(self, options: dict, schema: T.StructType) -> None:
        if {"name", "content"} - set(schema.fieldNames()):
            raise ValueError("scan files are written from the columns name and content")
        self.path = lowered(options)["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        made = {root}
        for name, content in (x for b in sliced(iterator) for x in zip(b.column("name").to_pylist(), b.column("content").to_pylist())):
            draft, target = f"{root}/.{uuid.uuid4().hex}.part", f"{root}/{name}"
            if _folder(target) not in made:
                fs.create_dir(_folder(target), recursive=True)
                made.add(_folder(target))
            with fs.open_output_stream(draft) as f:
                f.write(content or b"")
            fs.move(draft, target)
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        pass


def encode_file(magic: str, serial: int, start: float, step: float, sample: list[float], reference: list[float] | None, data_format: int = 2) -> bytes:
    """A scan file with the given header fields; the layout with stored reflectance (ASD) has one block, the others two."""
    h = np.zeros(1, SF.HEAD)
    h["dc_corr"], h["data_type"], h["data_format"] = 1, int(magic == "ASD"), data_format
    h["ch1_wavel"], h["wavel_step"], h["channels"], h["serial"] = start, step, len(sample), serial
    out = magic.encode("latin1") + h.tobytes()[3:] + np.asarray(sample, SF.SAMPLE_TYPES.get(data_format, "<f8")).tobytes()
    if magic == "ASD":
        return out
    times, _, fixed = SF.REFERENCE_HEADER["as7" if magic == "as7" else "as8"]
    return out + bytes(fixed) + np.asarray(reference, "<f8").tobytes()


def encoded(df: DataFrame) -> DataFrame:
    """name, content of scans (name, magic, serial, wl_start, wl_step, data_format, sample, reference; keep, the bytes that are
    left of a file that was cut, or null)."""
    names = ["magic", "serial", "wl_start", "wl_step", "sample", "reference", "data_format"]

    def run(batches):
        for b in sliced(batches):
            content = [encode_file(*row)[:keep] for *row, keep in zip(*(b.column(c).to_pylist() for c in [*names, "keep"]))]
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(content, pa.binary())], ["name", "content"])

    return df.select("name", *names, "keep").mapInArrow(run, "name string, content binary")


class ScanFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scan_files"

    def schema(self) -> T.StructType:
        return HEADERS if self.options.get("columns") == "header" else FULL

    def reader(self, schema: T.StructType) -> ScanReader:
        return ScanReader(dict(self.options), schema)

    def streamReader(self, schema: T.StructType) -> ScanStreamReader:
        return ScanStreamReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ScanWriter:
        if overwrite:
            raise ValueError("scan files are only appended")
        return ScanWriter(dict(self.options), schema)


def read_paths(df: DataFrame) -> DataFrame:
    """The files named by `path` as rows of the source, as they are now; `arrival_seq` stays with them."""
    def run(batches):
        for b in batches:
            paths, seq = b.column("path").to_pylist(), b.column("arrival_seq").to_pylist()
            if paths:
                fs, _ = opened(paths[0])
                info = fs.get_file_info([opened(p)[1] for p in paths])
                yield from _Rows({"path": paths[0]}, FULL).batches([Entry(p, max(i.size or 0, 0), int(i.mtime_ns or 0) // 1000, n) for p, i, n in zip(paths, info, seq)])

    return df.select("path", "arrival_seq").mapInArrow(run, FULL)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ScanFiles)
