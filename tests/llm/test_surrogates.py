import re

from pyspark.sql import functions as F

from lumenscan.llm import surrogates

SF = "/root/testdata/sf0.001"
CARD, PLAIN = "4539 1488 0343 6467", "9807915762804490"


def run(spark, rows, key="k"):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_entities string")
    return surrogates.with_surrogates(df.withColumn("was", F.col("text")), key).collect()


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def shape(s):
    return re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", s))


def test_formats_coreference_and_gender(spark):
    texts = {
        1: "write to Jo.Smith7@Mail.Example.com or jo.smith7@mail.example.com, call +1 (017) 555-7713 or +1 017 555 7713.",
        2: f"card {CARD}, {CARD.replace(' ', '')}, {PLAIN} 4845168114407329; from 97.51.17.173 and 8.8.8.8, not 999.1.1.1",
        3: 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and DE89 3704 0044 0532 0130 00',
        4: "Mrs. Ada Stone met Mr Stone and Dr Stone; Господин Иванов, Frau Öhler",
        5: "nothing here, 12 apples and 3.14", 6: None, 7: "",
    }
    got = {r.doc_id: r for r in run(spark, list(texts.items()) + [(None, texts[1]), (1, texts[1])])}
    one = got[1].text
    mails = re.findall(r"\S+@[\w.]+\w", one)
    assert got[1].n_entities == 4 and mails[0].lower() == mails[1] and "smith" not in one and shape(one) == shape(texts[1])
    assert [c.isupper() for c in mails[0]] == [c.isupper() for c in "Jo.Smith7@Mail.Example.com"] and mails[0].endswith(".com")
    a, b = one.split("call ")[1].split(" or ")
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "10175557713"
    two = got[2].text
    first, second, plain, other = re.match(r"card (.*), (\d+), (\d+) (\d+);", two).groups()
    assert first.replace(" ", "") == second and first != CARD and luhn(first) and first[0] == "4" and len({second, plain, other}) == 3 and luhn(PLAIN) == luhn(plain)
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+", two)
    assert [len(o) for o in ips[0].split(".")] == [2, 2, 2, 3] and ips[0] != "97.51.17.173" and max(map(int, ips[0].split("."))) < 256 and ips[2] == "999.1.1.1"
    assert re.fullmatch(r'token = "[0-9a-f]{40}" and DE89( [0-9A-Z]{4}){4} [0-9A-Z]{2}', got[3].text) and "24be64" not in got[3].text
    m = re.fullmatch(r"Mrs\. (\S+) (\S+) met Mr (\S+) and Dr (\S+); Господин (\S+), Frau (\S+)", got[4].text)
    low = lambda names: {n.lower() for n in names}
    assert m[1].lower() in low(surrogates.NAMES["female", "latin"]) and m[2] == m[3] == m[4] and re.search("[а-я]", m[5].lower()) and m[6] != m[2]
    assert got[5].text == texts[5] and got[6].text is None and got[7].text == "" and got[None].text == one
    assert {r.n_entities for r in got.values() if r.doc_id in (5, 6, 7)} == {0}
    assert run(spark, [(1, texts[1])], "another key")[0].text != one


def test_national_numbers_ipv6_and_names_without_title(spark):
    texts = {
        1: "call 415-555-0132, 415.555.0132 or 1-415-555-0199; London 020 7946 0958, Berlin 030/12345678, not 01-02-2024 10:30 or 2024-01-02",
        2: "number 123-45-6789 again 123-45-6789, order 1234-56-7890",
        3: "from 2001:db8::8a2e:370:7334 and 2001:0DB8:0000:0000:0000:8A2E:0370:7335, fe80::1, at 12:34:56, x[1::2], a::b, std::map",
        4: "Mr McDonald met Mr O'Brien, Mrs Garcia-Lopez and Mr Smith's dog. McDonald left; Garcia-Lopez, O'Brien and Smith stayed, blacksmith Smithson too.",
        5: "McDonald farms, Smith",
    }
    got = {r.doc_id: r for r in run(spark, list(texts.items()))}
    for d, t in list(texts.items())[:3]:
        assert re.sub("[0-9a-f]", "9", got[d].text.lower()) == re.sub("[0-9a-f]", "9", t.lower())
    m = re.fullmatch(r"call (\S+), (\S+) or (1-\S+); London (0.*), Berlin (0\S+), not 01-02-2024 10:30 or 2024-01-02", got[1].text)
    assert re.sub(r"\D", "", m[1]) == re.sub(r"\D", "", m[2]) != "4155550132" and m[4] != "020 7946 0958" and m[5] != "030/12345678" and got[1].n_entities == 5
    m = re.fullmatch(r"number (\S+) again (\S+), order 1234-56-7890", got[2].text)
    assert m[1] == m[2] != "123-45-6789"
    m = re.fullmatch(r"from (2001:\S+) and (2001:\S+), (fe80::.), at 12:34:56, x\[1::2\], a::b, std::map", got[3].text)
    assert m[1] != "2001:db8::8a2e:370:7334" and m[2] != "2001:0DB8:0000:0000:0000:8A2E:0370:7335" and m[3] != "fe80::1" and got[3].n_entities == 3
    m = re.fullmatch(r"Mr (\w+) met Mr (\w+), Mrs (\w+) and Mr (\w+)'s dog\. (\w+) left; (\w+), (\w+) and (\w+) stayed, blacksmith Smithson too\.", got[4].text)
    assert (m[5], m[6], m[7], m[8]) == (m[1], m[3], m[2], m[4]) and not {"McDonald", "Brien", "Garcia", "Lopez", "Smith"} & set(m.groups()) and got[4].n_entities == 8
    assert got[5].text == texts[5] and got[5].n_entities == 0


def test_distinct_entities_stay_distinct(spark):
    """All one-digit addresses of two octets' choice and many names: draws must collide, results must not."""
    texts = [(i, f"at {a}.{b}.1.1 and Mr {chr(65 + a)}{'abcdefghij'[b] * 3}") for i, (a, b) in enumerate((a, b) for a in range(1, 10) for b in range(1, 10))]
    got = run(spark, texts)
    pairs = [re.fullmatch(r"at (\S+) and Mr (\S+)", r.text).groups() for r in got]
    assert len({p[0] for p in pairs}) == len({p[1] for p in pairs}) == len(texts)
    before = {re.fullmatch(r"at (\S+) and Mr (\S+)", t).groups() for _, t in texts}
    assert not {p[0] for p in pairs} & {p[0] for p in before} and not {p[1].lower() for p in pairs} & {p[1].lower() for p in before}


def test_given_documents_lose_every_mention_and_nothing_else(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in run(spark, rows)}
    kinds = [r"[\w.+-]+@[\w.-]+\.\w+", r"\+\d \(\d{3}\) \d{3}-\d{4}", r"(?<![\w.])\d{16}(?!\w)", r"(?<!\w)[0-9a-f]{40}(?!\w)"]
    seen = 0
    for d, t in rows:
        for k in kinds:
            for m in re.findall(k, t):
                seen += 1
                assert m not in got[d].text
        if not re.search(r"\d", t):
            assert got[d].text == t
        assert abs(len(got[d].text) - len(t)) < 40
    assert seen > 5


def test_no_python_and_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = surrogates.with_surrogates(df, "k")
    assert out.count() == 0
    assert not any(w in out._jdf.queryExecution().toString() for w in ("Python", "Pandas", "Arrow"))
