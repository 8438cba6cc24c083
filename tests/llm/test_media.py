import hashlib
import io
import wave
import zlib

from lumenscan.llm import media

TEXTS = ["", None, "a", "x" * 191, "x" * 192, "x" * 193, "héllo wörld " * 500, "the quick brown fox " * 40, "the quick brown fox " * 40]


def rows(spark, texts):
    df = spark.createDataFrame([(i if i != 3 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    return media.media_features(df)


def test_payload_survives_and_facts_hold(spark):
    got = rows(spark, TEXTS).collect()
    assert len(got) == len(TEXTS)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(TEXTS):
        r = by[i if i != 3 else None]
        raw = (t or "").encode()
        pay = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(pay)) and len(pay) % 192 == 0 and pay
        assert r.payload_sha256 == hashlib.sha256(pay).hexdigest() and r.tail_crc32 == zlib.crc32(pay[-16:])
        stored = media.wav_bytes(pay)
        with wave.open(io.BytesIO(stored)) as w:
            assert w.getsampwidth() == 1 and w.readframes(w.getnframes()) == pay
        assert r.media_bytes == len(stored) and r.media_sha256 == hashlib.sha256(stored).hexdigest()
        assert len(r.times) == len(r.codes) == int(r.feature.split(":")[0])
    assert by[7].feature == by[8].feature and by[0].feature == by[1].feature


def test_features_do_not_depend_on_neighbours(spark):
    long = "lorem ipsum dolor sit amet, " * 40000
    together = {r.doc_id: r.feature for r in rows(spark, ["abc " * 30 * i for i in range(1, 40)] + [long]).collect()}
    alone = rows(spark, [long]).collect()[0].feature
    assert together[39] == alone and len(set(together.values())) > 5


def test_empty_table(spark):
    assert rows(spark, []).collect() == []
