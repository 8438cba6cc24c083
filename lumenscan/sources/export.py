"""Exports and the result log."""
from __future__ import annotations

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscan.functions import numeric as N
from lumenscan.functions import status as S
from lumenscan.functions import text as X
from lumenscan.functions.records import flat_columns, leaves
from lumenscan.operators.matching import broadcast_if_small
from lumenscan.operators.sequencing import positions
from lumenscan.sources.scan_source import opened


def technical_table(df: DataFrame, analysis: str, maps: dict[str, list[str]] | None = None, drop=("r", "stream")) -> DataFrame:
    """One wide row per scan: unrounded numbers under dotted names, lists as JSON cells."""
    base = df.drop(*[c for c in drop if c in df.columns]).withColumn("analysis", F.lit(analysis))
    return base.select(*flat_columns(base.schema, maps=maps))


def _cells(df: DataFrame) -> DataFrame:
    """Values as export text: empty for null and non-finite, shortest round-trip form for numbers."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        out.append(F.when(N.is_finite(c), c.cast("string")).alias(f.name) if f.dataType.simpleString() == "double" else c.cast("string").alias(f.name))
    return df.select(*out)


def export_technical(df: DataFrame, path: str, analysis: str, maps: dict[str, list[str]] | None = None, fmt: str = "csv") -> DataFrame:
    """Write the technical table as many CSV parts (CRLF rows), each with a header, or as Parquet. ``export_wide`` writes rows whose
    keys differ, in order, as one file's parts."""
    table = technical_table(df, analysis, maps)
    if fmt == "parquet":
        table.write.mode("overwrite").parquet(path)
    else:
        _cells(table).write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("emptyValue", "").option("nullValue", "").csv(path)
    return table


def manifest(df: DataFrame, analysis: str, dependencies: dict[str, str], profile: str | None = None, revision: Column | None = None) -> DataFrame:
    """One JSON record per scan: input hash, effective configuration, dependency hashes, revision."""
    deps = F.create_map(*[F.lit(x) for kv in sorted(dependencies.items()) for x in kv]) if dependencies else F.create_map().cast("map<string,string>")
    has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    record = F.struct(
        F.lit(1).alias("format_version"), has("input_sha256").alias("input_sha256"),
        F.struct(has("class").alias("instrument_class"), has("class_source").alias("class_source"), F.lit(analysis).alias("analysis"),
                 F.lit(profile).cast("string").alias("profile"), has("correction_id").alias("transfer")).alias("effective_configuration"),
        deps.alias("dependencies"), (revision if revision is not None else F.lit(1)).cast("bigint").alias("result_revision"))
    return df.select("scan_id", F.to_json(record).alias("manifest"))


def readable_table(df: DataFrame, model_keys: dict[str, str] | None = None, verdict: str = "verdict", m: str = "m",
                   note_words: dict[str, str] = X.NOTE_WORDS, flag_words: dict[str, str] = X.FLAG_WORDS) -> DataFrame:
    """Worded row per scan. A thing already said under "why" is not repeated under "also noted"."""
    v = F.col(verdict)
    words = lambda keys: F.array_distinct(F.transform(keys, lambda k: F.coalesce(F.element_at(X.word_map(note_words), k), k)))
    bare = v["verdict"].isin("Rescan", "Doesn't look like bone", "Unsupported")
    why = words(v["notes_shown"])
    also = F.array_except(words(F.transform(v["notes_all"], lambda n: n["key"])), why)
    signs = F.flatten(F.transform(v["flags"], lambda f: f["signs"]))
    prot = N.all_of([F.coalesce(F.col("pattern.bands")[b]["readable"], F.lit(False)) for b in ("NH2044", "AM2175")])
    off = F.when(F.col("pattern.status.state") == "not assessed", F.col("pattern.status.reason"))
    cols = [F.col(c) for c in ("file", "scan_id") if c in df.columns][:1]
    return df.select(
        *cols, F.coalesce(F.element_at(X.word_map(X.VERDICT_WORDS), v["verdict"]), v["verdict"]).alias("verdict"),
        F.when(~bare, X.format_reading(F.col(m))).otherwise(F.lit("")).alias("collagen"), F.array_join(why, ". ").alias("why"),
        F.array_join(F.transform(signs, lambda s: F.coalesce(F.element_at(X.word_map(flag_words), s), s)), " ").alias("flags"),
        F.array_join(also, ". ").alias("also_noted"),
        F.when(off.isNotNull(), F.lit("Not assessed")).otherwise(F.coalesce(F.element_at(X.word_map(X.LEVEL_WORDS), F.col("evidence.level")), F.lit(""))).alias("protein_bands"),
        X.pattern_headline(F.col("pattern.pattern"), F.col("pattern.verdict"), F.col("pattern.vote_1545"), prot, off).alias("band_check"),
        *[X.format_model(F.col("models")[mid]["value"]).alias(k) for k, mid in (model_keys or {}).items()],
        F.coalesce(F.col("class"), F.lit("")).alias("instrument"), F.coalesce(F.col("serial").cast("string"), F.lit("")).alias("serial"))


def export_readable(df: DataFrame, path: str, **options) -> DataFrame:
    table = readable_table(df, **options)
    table.write.mode("overwrite").option("header", True).option("lineSep", "\r\n").csv(path)
    return table


MAX_COLUMNS = 20_000


def first_seen_keys(rows: DataFrame, pos: str = "pos", cells: str = "cells", limit: int = MAX_COLUMNS) -> list[str]:
    """All keys of all rows, in the order in which a reader of the rows from the first to the last would meet them.

    A key's place is the smallest (row, place in the row) that it has anywhere: a minimum, so tasks combine it before the shuffle.
    """
    seen = rows.select(pos, F.posexplode(cells).alias("i", "c")).groupBy(F.col("c.key").alias("key")).agg(F.min(F.struct(pos, "i")).alias("at"))
    found = seen.orderBy("at").limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} different columns")
    return [r.key for r in found]


def csv_cell(c: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.rlike(c, F.lit(r'[",\r\n]')), quoted).otherwise(F.coalesce(c, F.lit("")))


def export_wide(df: DataFrame, path: str, order: list[Column], drop=("r", "stream")) -> list[str]:
    """Rows of any nesting as CSV (CRLF, byte-order mark), one column per dotted key in first-seen order; returns the header.

    Rows are dealt by ranges of `order`, and the header stands before the first row only: the parts, in the order of their names,
    are one file, which ``one_file`` joins. A row that lacks a key has an empty cell.
    """
    base = df.drop(*[c for c in drop if c in df.columns])
    cells = base.select(*[o.alias(f"o{i}") for i, o in enumerate(order)], leaves(base.schema, finite=True).alias("cells"))
    rows = positions(cells, [F.col(f"o{i}") for i in range(len(order))], out="pos").select("pos", "cells")
    keys = first_seen_keys(rows)
    # of a repeated key, the last value counts
    own = F.map_from_entries(F.filter("cells", lambda c, i: ~F.exists(F.slice("cells", i + 2, F.greatest(F.size("cells") - i - 1, F.lit(0))), lambda d: d["key"] == c["key"])))
    line = F.array_join(F.transform(F.array(*map(F.lit, keys)), lambda k: csv_cell(F.try_element_at("own", k))), ",")
    head = ",".join('"' + k.replace('"', '""') + '"' if any(x in k for x in ',"\r\n') else k for k in keys)
    text = rows.select("pos", own.alias("own")).select("pos", line.alias("line"))
    text = text.repartitionByRange("pos").sortWithinPartitions("pos")
    text = text.select(F.when(F.col("pos") == 1, F.concat(F.lit("\ufeff" + head + "\r\n"), "line")).otherwise(F.col("line")).alias("value"))
    text.write.mode("overwrite").option("lineSep", "\r\n").text(path)
    return keys


def one_file(spark: SparkSession, parts: str, target: str) -> int:
    """The parts of ``export_wide`` as one file; one task copies their bytes in pieces of 1 MB, the driver none. Returns its length."""
    def copy(batches):
        for b in batches:
            for source, to in zip(b.column("parts").to_pylist(), b.column("target").to_pylist()):
                fs, root = opened(source)
                other, name = opened(to)
                size = 0
                with other.open_output_stream(name) as out:
                    for p in sorted(i.path for i in fs.get_file_info(pfs.FileSelector(root)) if i.base_name.startswith("part-")):
                        with fs.open_input_stream(p) as f:
                            while piece := f.read(1 << 20):
                                out.write(piece)
                                size += len(piece)
                yield pa.RecordBatch.from_pydict({"size": [size]})

    return spark.createDataFrame([(parts, target)], "parts string, target string").coalesce(1).mapInArrow(copy, "size bigint").first().size


def result_key(df: DataFrame, engine: str, dependencies: dict[str, str]) -> Column:
    """Identity of a result: input and effective configuration. The same input under the same configuration has the
    same key, so scoring it again adds nothing."""
    deps = ";".join(f"{k}={v}" for k, v in sorted(dependencies.items()))
    return F.sha2(F.to_json(F.struct("path", "input_sha256", "class", "class_source", F.lit(engine).alias("engine"), F.lit(deps).alias("dependencies"))), 256)


def log_records(results: DataFrame, engine: str, dependencies: dict[str, str], reason: str = "arrival", day: Column | None = None) -> DataFrame:
    """Result-log rows: key, when, why, the record as JSON."""
    body = [c for c in results.columns if c not in ("r", "stream", "content", "sample_dn", "reference_dn")]
    return results.select("path", "input_sha256", "class", "class_source", result_key(results, engine, dependencies).alias("result_key"),
                          F.lit(reason).alias("reason"), F.current_timestamp().alias("logged_at"),
                          (day if day is not None else F.current_date()).alias("log_date"), F.to_json(F.struct(*body)).alias("result"))


def append_results(records: DataFrame, path: str, log: DataFrame | None = None) -> None:
    """Append the records whose key the log does not hold yet, partitioned by day.

    The log only grows, so it is never shuffled: the batch's keys go to the log, and the few already known come back.
    """
    new = records.dropDuplicates(["result_key"]).persist()
    try:
        fresh = new
        if log is not None:
            known = log.select("result_key").join(broadcast_if_small(new.select("result_key")), "result_key", "left_semi").distinct()
            fresh = new.join(broadcast_if_small(known), "result_key", "left_anti")
        fresh.write.mode("append").partitionBy("log_date").parquet(path)
    finally:
        new.unpersist()
