"""The registered queries of this subpackage: name -> (function of the session and the tables' folder, SQL twin or None)."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscan.llm import bpe, forest, interpolation, jaccard, lines, media, packing, quality, resampling, spelling, substrings, superminhash, surrogates


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_media_columns(spark: SparkSession, sf: str) -> DataFrame:
    return media.media_features(table(spark, sf, "documents"))


def op2_prefix_forest(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    return forest.nearest(v, v.where(F.col("vec_id") % 20 == 0))


def op3_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality.scored(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op4_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines.dedup_lines(table(spark, sf, "documents"), tau=lines.TAU)      # as OP4_SQL
    return rows.select("doc_id", "n_lines", "n_removed", "n_near", F.sha2("text", 256).alias("kept_sha256"))


def line_dedup_by_length(spark: SparkSession, sf: str) -> DataFrame:
    """Operator 4 on all lines, short ones too, with as many edits as their length allows; op4_line_dedup has those of its SQL twin."""
    rows = lines.dedup_lines(table(spark, sf, "documents"), tau=lines.BY_LENGTH)
    return rows.select("doc_id", "n_lines", "n_removed", "n_near", F.sha2("text", 256).alias("kept_sha256"))


SURROGATE_KEY = "corpus-key-1"     # a secret of whoever runs it, in production


def op5_pii_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    rows = surrogates.with_surrogates(table(spark, sf, "documents").select("doc_id", "text"), SURROGATE_KEY)
    return rows.select("doc_id", "n_entities", "text")


# every line of MIN_CHARS characters meets the earlier ones of nearly its length; ids are unique in the given tables
OP4_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
d AS (SELECT line, min((doc_id, pos)) AS first, length(line) AS n FROM l WHERE line <> '' GROUP BY line),
near AS (SELECT DISTINCT a.line FROM d a JOIN d b ON b.n BETWEEN a.n - {lines.TAU} AND a.n + {lines.TAU} AND b.first < a.first
         WHERE a.n >= {lines.MIN_CHARS} AND b.n >= {lines.MIN_CHARS} AND levenshtein(a.line, b.line) <= {lines.TAU}),
f AS (SELECT l.*, line <> '' AND (doc_id, pos) <> first AS again, line <> '' AND (doc_id, pos) = first AND line IN (SELECT line FROM near) AS close
      FROM l LEFT JOIN d USING (line)),
f2 AS (SELECT doc_id, pos, line, coalesce(again, false) OR line IN (SELECT line FROM near) AS gone, coalesce(close, false) AS close FROM f)
SELECT doc_id, count(*)::INT AS n_lines, (count(*) FILTER (WHERE gone))::INT AS n_removed, (count(*) FILTER (WHERE close))::INT AS n_near,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f2 GROUP BY doc_id"""


# levenshtein counts bytes: the given tables' letters beyond ASCII are mapped to control characters, which these do not hold
_ACCENTED = "éóèñüçäöêßíÉÈÑÓÇÊÜÖÄÍ"
_CONTROL = " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 32)][:len(_ACCENTED)])
_EDITS = "CASE " + " ".join(f"WHEN least(a.n, b.n) >= {least} THEN {edits}" for least, edits in lines.BY_LENGTH[::-1]) + " END"
_MOST = max(edits for _, edits in lines.BY_LENGTH)
BY_LENGTH_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
d AS (SELECT line, min((doc_id, pos)) AS first, length(line) AS n, translate(line, '{_ACCENTED}', {_CONTROL}) AS plain FROM l WHERE line <> '' GROUP BY line),
near AS (SELECT DISTINCT a.line, true AS is_near FROM d a JOIN d b ON b.n BETWEEN a.n - {_MOST} AND a.n + {_MOST} AND b.first < a.first
         WHERE abs(a.n - b.n) <= {_EDITS} AND levenshtein(a.plain, b.plain) <= {_EDITS}),
f AS (SELECT doc_id, pos, line, line <> '' AND ((doc_id, pos) <> first OR is_near IS NOT NULL) AS gone, (doc_id, pos) = first AND is_near IS NOT NULL AS close
      FROM l LEFT JOIN d USING (line) LEFT JOIN near USING (line))
SELECT doc_id, count(*)::INT AS n_lines, (count(*) FILTER (WHERE gone))::INT AS n_removed, (count(*) FILTER (WHERE close))::INT AS n_near,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(gone, false)), '')) AS kept_sha256
FROM f GROUP BY doc_id"""


def op6_grouped_prefix_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


def op8_deleted_interpolation(spark: SparkSession, sf: str) -> DataFrame:
    return interpolation.scores(table(spark, sf, "documents"))


def op9_fm_index_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf, "documents"))


def op10_bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_permuterm_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.spelling_forms(table(spark, sf, "documents"))


def op12_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.resampled(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op13_superminhash(spark: SparkSession, sf: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf, "documents"))


# crc32 of a text's UTF-8 bytes: t is the table of 256 remainders, as a list; {text} an expression
CRC_TABLE = """crct AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
                 FROM (SELECT unnest(range(256)) AS i)))"""
CRC = """xor(list_reduce(list_concat([4294967295], list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295)"""

# every pair of words of neighbouring lengths is compared; letters above z are mapped to other single bytes for levenshtein
_HIGH = "".join(chr(c) for c in range(0xC0, 0x100))
_PLAIN = "".join(chr(c) for c in range(33, 127) if chr(c) not in "'" and not "a" <= chr(c) <= "z")[:64]
OP11_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS k FROM r WHERE length(run) >= {spelling.LEAST} GROUP BY ALL),
h AS (SELECT run, k, {CRC.format(text="(doc_id || ':' || run)")} AS h FROM d, crct),
c AS (SELECT k, CASE WHEN h % {spelling.SLIPS} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h),
w AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n, translate(word, '{_HIGH}', '{_PLAIN}') AS plain, length(word) AS len FROM c WHERE length(word) >= {spelling.LEAST} GROUP BY word HAVING sum(k) >= {spelling.TWICE}),
p AS (SELECT a.word, b.word AS near, b.n FROM w a JOIN w b ON b.len BETWEEN a.len - 1 AND a.len + 1 AND levenshtein(a.plain, b.plain) = 1),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, encode(near)) AS near, max(n) AS near_n FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {spelling.FACTOR} * w.n THEN near END AS form, CASE WHEN near_n >= {spelling.FACTOR} * w.n THEN near_n END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS here, form AS next FROM f UNION ALL SELECT chain.word, f.word, f.form FROM chain JOIN f ON f.word = chain.next)
SELECT f.word, form, here AS root, n, n_near, form_n FROM f JOIN chain ON chain.word = f.word AND chain.next IS NULL"""

OP12_SQL = rf"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
v AS MATERIALIZED (SELECT word, {CRC.format(text="word")} % {resampling.BUCKETS} AS bucket FROM (SELECT word FROM d UNION SELECT word FROM b), crct),
s AS (SELECT bucket, count(*) AS s FROM d JOIN v USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN v USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sa + {resampling.BUCKETS}) / ((s + 1)::DOUBLE * (ta + {resampling.BUCKETS}))))::BIGINT AS gain
      FROM s LEFT JOIN t USING (bucket), (SELECT coalesce(sum(s), 0)::DOUBLE AS sa FROM s), (SELECT coalesce(sum(t), 0)::DOUBLE AS ta FROM t)),
m AS (SELECT doc_id, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS w FROM d JOIN v USING (word) JOIN g USING (bucket) GROUP BY doc_id),
x AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(w, 0) AS weight, ('0x' || left(sha256('{resampling.SEED}:' || doc_id), 8))::BIGINT AS h FROM documents LEFT JOIN m USING (doc_id)),
y AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score, n_features >= {resampling.LEAST_WORDS} AS able FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= {resampling.PERCENT} * n // 100 THEN place END AS rank FROM z"""

SQL = {"op4_line_dedup": OP4_SQL, "line_dedup_by_length": BY_LENGTH_SQL, "op11_permuterm_variants": OP11_SQL, "op12_importance_resampling": OP12_SQL}
QUERIES = {f.__name__: (f, SQL.get(f.__name__)) for f in (op1_media_columns, op2_prefix_forest, op3_quality_classifier, op4_line_dedup, line_dedup_by_length, op5_pii_surrogates, op6_grouped_prefix_join, op7_packing, op8_deleted_interpolation, op9_fm_index_dedup, op10_bpe_round_trip, op11_permuterm_variants, op12_importance_resampling, op13_superminhash)}
