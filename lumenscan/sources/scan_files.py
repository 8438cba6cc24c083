"""Bulk ingest of instrument scan files.

A directory tree is read with the ``binaryFile`` source (one row per file) and decoded per Arrow batch. Every file
keeps a row: what cannot be read carries its reason instead of being dropped.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenscan.functions import dates as D
from lumenscan.functions.text import file_name, folder
from lumenscan.operators import quality as Q
from lumenscan.operators.arrow import list_rows
from lumenscan.operators.matching import broadcast_if_small

# The file layout (little endian) and the limits of a candidate file.
HEADER_BYTES = 484
HEADER = {"when_sec": ("<i2", 160), "when_min": ("<i2", 162), "when_hour": ("<i2", 164), "when_mday": ("<i2", 166),
          "when_mon": ("<i2", 168), "when_year": ("<i2", 170), "program_version": ("u1", 178), "file_version": ("u1", 179),
          "dc_corr": ("u1", 181), "dc_time": ("<i4", 182), "data_type": ("u1", 186), "ref_time": ("<i4", 187),
          "ch1_wavel": ("<f4", 191), "wavel_step": ("<f4", 195), "data_format": ("u1", 199), "channels": ("<u2", 204),
          "integration_time_ms": ("<u4", 390), "serial": ("<u2", 400), "dc_count": ("<u2", 425), "ref_count": ("<u2", 427),
          "sample_count": ("<u2", 429), "swir1_gain": ("<u2", 436), "swir2_gain": ("<u2", 438), "splice1": ("<f4", 444),
          "splice2": ("<f4", 448)}
SAMPLE_TYPES = {0: "<f4", 1: "<i4", 2: "<f8"}
FORMATS = {"as8": "as8", "as7": "as7", "ASD": "legacy"}
# (offset of the two times, offset of the description length, fixed bytes before the description) after the samples
REFERENCE_HEADER = {"as7": (1, 17, 20), "as8": (2, 18, 20)}
MAX_FILE_BYTES = 16 * 1024 * 1024
CANDIDATE = r"(?i)^[^.~].*\.(asd|sco|\d{3})$"
PLAIN_GLOB = "*.{[aA][sS][dD],[0-9][0-9][0-9]}"
SCO_GLOB = "*.[sS][cC][oO]"
TEMPORARY = r"(?i)\.(tmp|part)\.[^.]*$"

_INTS = [k for k, (t, _) in HEADER.items() if "f" not in t]
DECODED = T.StructType(
    [T.StructField("magic", T.StringType()), T.StructField("format", T.StringType())]
    + [T.StructField(k, T.LongType()) for k in _INTS]
    + [T.StructField("wl_start", T.DoubleType()), T.StructField("wl_step", T.DoubleType()), T.StructField("n", T.IntegerType()),
       T.StructField("splices_header_nm", T.ArrayType(T.DoubleType())), T.StructField("ole_reference", T.DoubleType()),
       T.StructField("ole_spectrum", T.DoubleType()), T.StructField("sample_dn", T.ArrayType(T.DoubleType())),
       T.StructField("reference_dn", T.ArrayType(T.DoubleType())), T.StructField("stored_r", T.ArrayType(T.DoubleType())),
       T.StructField("decode_error", T.StringType())])


def candidate(name: Column) -> Column:
    """A file name that can be a scan: known extension after a stem, not hidden, a lock or a temporary copy."""
    return F.rlike(name, F.lit(CANDIDATE)) & ~F.rlike(name, F.lit(TEMPORARY))


def candidate_files(df: DataFrame, path: str = "path") -> DataFrame:
    return df.where(candidate(file_name(F.col(path))))


def without_large_content(files: DataFrame) -> DataFrame:
    """The same rows, but files above the limit come without content, which is then not read at all; `interpret` says why."""
    if "content" not in files.columns:
        return files
    large = files.where(F.col("length") > MAX_FILE_BYTES).drop("content").withColumn("content", F.lit(None).cast("binary"))
    return files.where(F.col("length") <= MAX_FILE_BYTES).unionByName(large)


def drop_shadowed(df: DataFrame, path: str = "path") -> DataFrame:
    """Drop ``X.sco`` when its source ``X`` is in the same folder: the same scan would be counted twice.

    The key is the whole path, which is unique, so no folder becomes one task.
    """
    sources = df.select(F.col(path).alias("_src")).where(~F.rlike(F.col("_src"), F.lit(r"(?i)\.sco$")))
    target = F.when(F.rlike(F.col(path), F.lit(r"(?i)\.sco$")), F.expr(f"substring({path}, 1, length({path}) - 4)"))
    marked = df.withColumn("_target", F.when(candidate(file_name(target)), target))
    return marked.join(sources, marked["_target"] == sources["_src"], "left_anti").drop("_target")


# Why a file could not be decoded: a key for programs, the text for people.
SHORT, UNKNOWN, CUT, ABSENT = ("unsupported: file shorter than the header", "unsupported: unknown data format", "unsupported: truncated sample block", "unsupported: no content")
DECODE_CODES = {SHORT: "short_header", UNKNOWN: "unknown_format", CUT: "truncated_samples", ABSENT: "unreadable"}
HEAD = np.dtype({"names": list(HEADER), "formats": [t for t, _ in HEADER.values()], "offsets": [o for _, o in HEADER.values()], "itemsize": HEADER_BYTES})


def decode_header(b: bytes, size: int) -> dict:
    """Header fields from the first bytes of a file of `size` bytes, and what they and the size say against decoding it."""
    row: dict = {"magic": b[:3].decode("latin1")}
    row["format"] = FORMATS.get(row["magic"])
    if len(b) < HEADER_BYTES:
        return {**row, "decode_error": SHORT}
    h = np.frombuffer(b, HEAD, 1)[0]
    row.update({k: int(h[k]) for k in _INTS})
    row.update(wl_start=float(h["ch1_wavel"]), wl_step=float(h["wavel_step"]), n=row["channels"],
               splices_header_nm=[float(h["splice1"]), float(h["splice2"])])
    kind = SAMPLE_TYPES.get(row["data_format"])
    if kind is None:
        return {**row, "decode_error": UNKNOWN}
    if size < HEADER_BYTES + row["n"] * np.dtype(kind).itemsize:
        return {**row, "decode_error": CUT}
    return row


def decode_file(b: bytes) -> dict:
    """Header fields and blocks of one file."""
    row = decode_header(b, len(b))
    if "decode_error" in row:
        return row
    kind = SAMPLE_TYPES[row["data_format"]]
    end = HEADER_BYTES + row["n"] * np.dtype(kind).itemsize
    values = np.frombuffer(b, kind, row["n"], HEADER_BYTES).astype(float)
    if row["format"] == "legacy":
        return {**row, "stored_r": values}
    row["sample_dn"] = values
    times, length_at, fixed = REFERENCE_HEADER["as7" if row["format"] == "as7" else "as8"]
    if len(b) >= end + fixed:
        row["ole_reference"], row["ole_spectrum"] = (float(v) for v in np.frombuffer(b, "<f8", 2, end + times))
        first = end + fixed + int(np.frombuffer(b, "<u2", 1, end + length_at)[0])
        if len(b) >= first + 8 * row["n"]:
            row["reference_dn"] = np.frombuffer(b, "<f8", row["n"], first)
    return row


_KINDS = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.IntegerType(): pa.int32()}


def arrow_column(rows: list[dict], f: T.StructField) -> pa.Array:
    return pa.array([r.get(f.name) for r in rows], type=_KINDS.get(f.dataType, pa.list_(pa.float64())))


def decode(files: DataFrame, content: str = "content") -> DataFrame:
    """Header fields and blocks of every file; ``decode_error`` says why a file could not be decoded."""
    keep = [f for f in files.schema.fields if f.name != content]
    schema = T.StructType(keep + DECODED.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = [decode_file(b) if b is not None else {"decode_error": ABSENT} for b in part.column(content).to_pylist()]
                cols = [part.column(f.name) for f in keep] + [arrow_column(rows, f) for f in DECODED.fields]
                yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

    return files.mapInArrow(run, schema)


def list_files(spark: SparkSession, path: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """One row per file. Content is read only where it is asked for, and only of files whose name fits ``glob``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def interpret(decoded: DataFrame) -> DataFrame:
    """Decoded files as scans: joins, kind, reflectance, clocks and the first reason a file is not supported."""
    df = Q.resolve_joins(decoded)
    df = Q.classify_kind(Q.accept(df))
    if "length" in df.columns:
        large = F.when(F.col("length") > MAX_FILE_BYTES, F.lit(f"unsupported: larger than {MAX_FILE_BYTES >> 20} MiB"))
        df = df.withColumn("decode_error", F.coalesce(large, "decode_error"))
    df = df.withColumn("reject_reason", F.coalesce("decode_error", "reject_reason"))
    ratio = F.zip_with("sample_dn", "reference_dn", lambda s, w: F.try_divide(s, w))
    when = D.tm_to_timestamp(*[F.col(f"when_{k}") for k in ("sec", "min", "hour", "mday", "mon", "year")])
    return df.withColumns({
        "scan_id": F.col("path"), "file": file_name(F.col("path")), "folder": folder(F.col("path")),
        "r": F.when(F.col("reject_reason").isNull(), F.coalesce("stored_r", ratio)),
        "timestamps": F.struct(D.ole_to_timestamp(F.col("ole_spectrum")).alias("spectrum_local"), when.alias("header_local"),
                               D.utc_offset_minutes(F.col("ole_reference"), F.col("ref_time")).alias("utc_offset_min"),
                               D.reference_age_seconds(F.col("ole_spectrum"), F.col("ole_reference")).alias("reference_age_s")),
    }).drop("stored_r", "decode_error")


def scan_content(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Candidate files with their content, without shadowed ones. Only ``.sco`` files can be shadowed, so only they are
    compared with the listing; the bytes of all other files never meet a join."""
    plain = without_large_content(candidate_files(list_files(spark, path, recursive, PLAIN_GLOB)))
    copies = without_large_content(candidate_files(list_files(spark, path, recursive, SCO_GLOB)))
    sources = plain.select(F.col("path").alias("_src"))
    target = F.expr("substring(path, 1, length(path) - 4)")
    shadowed = copies.select("path", target.alias("_src")).join(sources, "_src", "left_semi").select("path")
    return plain.unionByName(copies.join(broadcast_if_small(shadowed), "path", "left_anti"))


def read_scans(spark: SparkSession, path: str, recursive: bool = True, ordered: bool = False) -> DataFrame:
    """A folder of scan files as one row per file. ``ordered`` sorts by path (a range shuffle; not needed to score)."""
    kept = scan_content(spark, path, recursive)
    df = interpret(decode(kept.withColumn("file_sha256", F.sha2("content", 256))))
    return df.orderBy("path") if ordered else df


SPECTRUM_TAG = b"lumenscan-spectrum-v1\x00"


def with_spectrum_hash(df: DataFrame, col: str = "r", tag: bytes = SPECTRUM_TAG, out: str = "spectrum_sha256") -> DataFrame:
    """SHA-256 of a tag, the wavelengths and the values as little-endian float64 bytes (no SQL function packs doubles)."""
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.StringType())])

    def run(batches):
        for batch in batches:
            offsets, values = list_rows(batch.column(col))
            start = batch.column("wl_start").to_pylist()
            step = batch.column("wl_step").to_pylist()
            live = batch.column(col).is_valid().to_pylist()
            got = []
            for i in range(batch.num_rows):
                if not live[i]:
                    got.append(None)
                    continue
                x = np.ascontiguousarray(values[offsets[i]:offsets[i + 1]], "<f8")
                wl = np.ascontiguousarray(start[i] + step[i] * np.arange(len(x)), "<f8")
                got.append(hashlib.sha256(tag + wl.tobytes() + x.tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, type=pa.string())], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def with_file_hash(df: DataFrame, content: str = "content", out: str = "file_sha256") -> DataFrame:
    return df.withColumn(out, F.sha2(F.col(content), 256))


# ---------------------------------------------------------------------------------------------- completeness
# What must not be zero or missing in a file that is written to its end.
ZERO_CHANNELS, ZERO_BELOW_NM, TRAILER_BYTES = 32, 2450.0, 212


def float32_le(content: Column, off: int) -> Column:
    """A little-endian 32-bit float at a byte offset; null for infinities and NaN."""
    byte = lambda i: F.conv(F.hex(F.substring(content, off + i + 1, 1)), 16, 10).cast("bigint")
    bits = byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216
    exponent, fraction = F.shiftright(bits, 23).bitwiseAND(255), bits.bitwiseAND(0x7FFFFF)
    value = F.when(exponent == 0, fraction / F.lit(2.0 ** 149)).when(exponent < 255, (fraction + 0x800000) * F.pow(F.lit(2.0), (exponent - 150).cast("double")))
    return F.when(bits >= 1 << 31, -value).otherwise(value)


def file_shape(content: Column) -> Column:
    """struct(state, reason) of raw bytes: complete, incomplete (still being written) or unrecognised.

    Header integers are read in the JVM. Only hex of single bytes is used: reversing a binary column would turn it
    into text.
    """
    byte = lambda off: F.conv(F.hex(F.substring(content, off + 1, 1)), 16, 10).cast("int")
    u16 = lambda off: byte(off) + byte(off + 1) * 256
    size = F.length(content)
    magic = F.decode(F.substring(content, 1, 3), "ISO-8859-1")
    channels, fmt = u16(204), byte(199)
    width = F.when(fmt == 2, 8).when(fmt.isin(0, 1), 4)
    block = channels * width
    end = F.lit(HEADER_BYTES) + block
    dyn = lambda off: F.conv(F.hex(F.substr(content, off + 1, F.lit(1))), 16, 10).cast("int")
    at = end + F.when(magic == "as7", 17).otherwise(18)
    ref_end = end + 20 + dyn(at) + dyn(at + 1) * 256 + block
    tail = F.substr(content, end - F.least(channels, F.lit(ZERO_CHANNELS)) * width + 1, F.least(channels, F.lit(ZERO_CHANNELS)) * width)
    ref_tail = F.substr(content, ref_end - F.least(channels, F.lit(ZERO_CHANNELS)) * width + 1, F.least(channels, F.lit(ZERO_CHANNELS)) * width)
    # the last channels up to ZERO_BELOW_NM, where a white reference is never zero
    first, step = float32_le(content, 191), float32_le(content, 195)
    last = F.floor((F.lit(ZERO_BELOW_NM) - first) / F.when(step > 0, step)).cast("int") + 1
    hi = F.when((last >= 1) & (last <= channels), last).otherwise(channels)
    lo = F.greatest(hi - ZERO_CHANNELS, F.lit(0))
    ref_inside = F.substr(content, ref_end - block + lo * width + 1, (hi - lo) * width)
    zero = lambda b: F.rlike(F.hex(b), F.lit("^0*$"))
    reason = (F.when(size < 3, F.lit("shorter than the file signature"))
              .when(F.hex(F.substring(content, 1, 3)) == "000000", F.lit("file start is still zero-filled"))
              .when(~magic.isin("as6", "as7", "as8", "ASD"), F.lit("?not a scan file"))
              .when(size < HEADER_BYTES, F.lit("header incomplete")).when(channels == 0, F.lit("header not fully written (0 channels)"))
              .when(width.isNull(), F.lit("?unknown data format")).when(size < end, F.lit("spectrum block incomplete"))
              .when((magic == "ASD") & zero(tail), F.lit("reflectance block is still zero-filled"))
              .when(magic.isin("ASD", "as6"), F.lit(None)).when(size < end + 20, F.lit("reference header incomplete"))
              .when(size < ref_end, F.lit("white-reference block incomplete"))
              .when((magic == "as8") & (size > ref_end) & (size < ref_end + TRAILER_BYTES), F.lit("file trailer incomplete"))
              .when(zero(ref_tail) | zero(ref_inside), F.lit("white-reference block is still zero-filled")))
    return F.struct(F.when(reason.isNull(), F.lit("complete")).when(reason.startswith("?"), F.lit("unrecognised")).otherwise(F.lit("incomplete")).alias("state"),
                    F.regexp_replace(reason, r"^\?", "").alias("reason"))
