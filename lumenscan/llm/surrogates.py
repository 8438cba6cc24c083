"""Keyed surrogates for personal data, in DataFrame functions only.

Mail addresses, phone (international and national), social security and card numbers, IPv4 and IPv6 addresses, long hexadecimal
secrets, bank accounts and titled names are found by one pattern; a name that has a title somewhere in a document is also found
without one, as it was written, in the rest of that document. Every distinct entity of the corpus (its canonical form: case and separators dropped where they do not matter)
gets one surrogate, drawn from SHA-256 of the key, the entity and an attempt number:

* format: digits become digits, letters letters of their script, separators stay; a card that passes the Luhn test still does;
  octets keep their number of digits; an IPv6 address keeps its first group; a mail address keeps its last label; card, phone and bank numbers their first signs;
* names: a family name becomes a family name, a given name one of the gender that the title tells, of the same script;
* distinctness: surrogates of all entities of a kind are compared with each other and with all originals; where two meet, all
  but the first entity draw again, until none do. From the eighth attempt on, surrogates may grow, so that they never run out;
* coreference: a mention is written in its own layout (case, separators) from its entity's surrogate.

Null text stays null; text without entities stays as it is. Repeated rows get equal results; null ids stay. An empty table gives
an empty table. Columns but the text are kept; `n_entities` is added and replaces a column of that name. Mentions of a document
are the largest group that meets in a task; entities are grouped before they are joined.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan.llm.blocks import apart, stored

# Titles by gender, and name stems by gender and script.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа")
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин")
NEUTRAL_TITLES = ("Dr", "Prof")
NAMES = {
    ("female", "latin"): ("Anna", "Clara", "Elena", "Greta", "Ines", "Julia", "Laura", "Marta", "Nora", "Paula", "Rosa", "Vera"),
    ("male", "latin"): ("Adrian", "Bruno", "David", "Felix", "Hugo", "Jonas", "Leon", "Martin", "Oscar", "Pablo", "Simon", "Viktor"),
    ("any", "latin"): ("Alex", "Andrea", "Charlie", "Dominique", "Kim", "Luca", "Noa", "Robin", "Sascha", "Toni"),
    ("family", "latin"): ("Albers", "Berger", "Castell", "Delmar", "Engel", "Fontana", "Garland", "Holm", "Keller", "Lambert", "Moreau", "Novak", "Ortega", "Petri", "Roland", "Sander"),
    ("female", "cyrillic"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"),
    ("male", "cyrillic"): ("Антон", "Борис", "Виктор", "Игорь", "Максим", "Олег", "Павел", "Роман"),
    ("any", "cyrillic"): ("Саша", "Женя", "Валя"),
    ("family", "cyrillic"): ("Белов", "Волков", "Громов", "Дроздов", "Зайцев", "Лебедев", "Морозов", "Соколов"),
}
SYLLABLES = {"latin": ("an", "be", "do", "el", "fi", "ka", "lo", "mi", "ne", "ro", "su", "ta"), "cyrillic": ("ан", "бе", "до", "ел", "фи", "ка", "ло", "ми")}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшщыэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

_TITLE = "(?:" + "|".join(FEMALE_TITLES + MALE_TITLES + NEUTRAL_TITLES) + ")"
MAIL = r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])"
BANK = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
PHONE = r"(?:\+[0-9]{1,3}[ -]?)(?:\([0-9]{1,4}\)[ -]?)?[0-9]{2,4}(?:[ -]?[0-9]{2,4}){1,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z.])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9A-Za-z])"
CARD = r"(?<![0-9A-Za-z.])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
ADDRESS = r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}(?![0-9]|\.[0-9])"
SOCIAL = r"(?<![0-9A-Za-z]|[0-9][.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
# without country: three, three and four digits with one separator; or a leading 0 and 9 to 12 digits in all
_TEN = "|".join(f"(?:1{s})?[0-9]{{3}}{s}[0-9]{{3}}{s}[0-9]{{4}}" for s in ("-", r"\.", " "))
_ZERO = "|".join(rf"(?=0(?:{s}?[0-9]){{8,11}}(?![0-9A-Za-z]))0[0-9]{{1,4}}(?:{s}[0-9]{{2,8}}){{1,5}}" for s in ("-", r"\.", " ", "/"))
NATIONAL = rf"(?<![0-9A-Za-z]|[0-9][.-])(?:{_TEN}|{_ZERO})(?![0-9A-Za-z])"
# shortened ones need a first group of four digits, as all given ranges have, and a decimal digit
_HEX = "[0-9A-Fa-f]{1,4}"
ADDRESS6 = rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[0-9A-Fa-f:]*[0-9])[0-9A-Fa-f]{{4}}(?::{_HEX}){{0,6}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![0-9A-Za-z:])"
# letters of any case with apostrophes and hyphens inside; a possessive s is not part of it
_WORD = r"\p{Lu}(?=[\p{L}\p{M}'’-])[\p{L}\p{M}]*(?:['’-](?!s(?![\p{L}\p{M}]))[\p{L}\p{M}]+)*"
NAME = rf"(?<!\p{{L}}){_TITLE}\.? {_WORD}(?: (?=[\p{{L}}\p{{M}}'’-]*\p{{Ll}}){_WORD})?(?![\p{{L}}\p{{M}}])"
PATTERN = "|".join(f"(?:{p})" for p in (MAIL, NAME, SECRET, BANK, ADDRESS6, PHONE, CARD, SOCIAL, NATIONAL, ADDRESS))
LENGTHEN, GIVE_UP = 8, 40


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _script(c: Column) -> Column:
    return F.when(c.rlike(r"\p{IsCyrillic}"), "cyrillic").when(c.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def names(text: Column) -> Column:
    """The parts of all titled names of a text: array of (prefix, kind, canon, raw), ordered so that longer names come first."""
    titled = F.regexp_extract_all(text, F.lit(NAME), F.lit(0))
    return F.sort_array(F.array_distinct(F.transform(F.flatten(F.transform(titled, parts)),
                                                     lambda p: F.struct(p["raw"].alias("raw"), p["kind"].alias("kind"), p["canon"].alias("canon")))), False)


def pattern(known: Column) -> Column:
    """PATTERN and the names `known`, without titles; they hold letters, apostrophes and hyphens only."""
    each = F.array_join(F.array_distinct(F.transform(known, lambda n: n["raw"])), "|")
    return F.when(F.size(known) > 0, F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{M}\p{N}])(?:"), each, F.lit(r")(?![\p{L}\p{M}\p{N}])"))).otherwise(F.lit(PATTERN))


def mentions(text: Column, known: Column) -> Column:
    return F.regexp_extract_all(text, pattern(known), F.lit(0))


def untitled(mention: Column, known: Column) -> Column:
    """`parts` of a mention that is a known name without title, otherwise null; a word that is both is a family name."""
    same = F.filter(known, lambda n: n["raw"] == mention)
    first = F.coalesce(F.get(F.filter(same, lambda n: n["kind"].startswith("family")), F.lit(0)), F.get(same, F.lit(0)))
    return F.when(F.size(same) > 0, F.array(F.struct(F.lit("").alias("prefix"), first["kind"].alias("kind"), first["canon"].alias("canon"), mention.alias("raw"))))


def parts(mention: Column) -> Column:
    """A mention as array of (prefix, kind, canon, raw): one part, but for names a part for each name."""
    one = lambda kind, canon: F.array(F.struct(F.lit("").alias("prefix"), F.lit(kind).alias("kind"), canon.alias("canon"), mention.alias("raw")))
    words = F.split(mention, " ")
    title = F.regexp_replace(words[0], r"\.", "")
    gender = F.when(title.isin(*FEMALE_TITLES), "female").when(title.isin(*MALE_TITLES), "male").otherwise("any")
    name = lambda prefix, kind, raw: F.struct(prefix.alias("prefix"), F.concat(kind, F.lit("."), _script(raw)).alias("kind"), F.lower(raw).alias("canon"), raw.alias("raw"))
    family, given = F.lit("family"), gender
    named = F.when(F.size(words) == 2, F.array(name(F.concat(words[0], F.lit(" ")), family, words[1]))).otherwise(
        F.array(name(F.concat(words[0], F.lit(" ")), given, words[1]), name(F.lit(" "), family, F.get(words, F.lit(2)))))
    return (F.when(mention.contains("@"), one("mail", F.lower(mention)))
            .when(mention.rlike(rf"^{_TITLE}\.? "), named)
            .when(mention.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"), one("secret", F.lower(mention)))
            .when(mention.rlike("^[A-Z]{2}[0-9]{2}"), one("bank", F.regexp_replace(mention, " ", "")))
            .when(mention.rlike(r"^[+(]") | mention.rlike(f"^(?:{_TEN}|{_ZERO})$"), one("phone", _digits(mention)))
            .when(mention.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), one("social", _digits(mention)))
            .when(mention.contains(":"), one("address6", F.lower(mention)))
            .when(mention.contains("."), one("address", mention))
            .otherwise(one("card", _digits(mention))))


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits."""
    back = F.reverse(_chars(digits))
    double = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    worth = F.transform(back, lambda c, i: F.when(i % 2 == 1, double(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10


def draw(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The surrogate of one entity in its canonical layout."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 256)
    pick = lambda i, n: F.pmod(F.xxhash64(digest, i), F.lit(n)).cast("int")
    of = lambda values, i: F.get(F.array(*map(F.lit, values)), pick(i, len(values)))
    letter = lambda c, i: F.when(c.rlike(r"\p{IsCyrillic}"), of(ALPHABETS["cyrillic"], i)).when(c.rlike(r"\p{IsGreek}"), of(ALPHABETS["greek"], i)).otherwise(of(ALPHABETS["latin"], i))
    digit = lambda i: pick(i, 10).cast("string")
    more = F.greatest(attempt - LENGTHEN + 1, F.lit(0))
    grown = lambda fill: F.when(more > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda i: fill(i + 1000)), "")).otherwise("")
    chars = _chars(canon)
    tld = F.length(canon) - F.length(F.substring_index(canon, ".", -1))
    mail = F.concat(grown(lambda i: of(ALPHABETS["latin"], i)), F.array_join(F.transform(chars, lambda c, i: F.when((i < tld) & c.rlike(r"\p{N}"), digit(i)).when((i < tld) & c.rlike(r"\p{L}"), letter(c, i)).otherwise(c)), ""))
    secret = F.concat(F.array_join(F.transform(chars, lambda c, i: of("0123456789abcdef", i)), ""), grown(lambda i: of("0123456789abcdef", i)))
    keep = lambda n: F.concat(F.array_join(F.transform(chars, lambda c, i: F.when(i < n, c).when(c.rlike("[0-9]"), digit(i)).when(c.rlike("[A-Z]"), F.upper(of(ALPHABETS["latin"], i))).otherwise(c)), ""), grown(digit))
    number = keep(1)
    head = F.left(number, F.length(number) - 1)
    check = F.pmod(F.lit(10) - _luhn(F.concat(head, F.lit("0"))), F.lit(10)).cast("string")
    card = F.when(_luhn(canon) == 0, F.concat(head, check)).otherwise(number)
    octet = lambda x, i: F.when(more > 0, pick(i, 256)).when(F.length(x) == 1, pick(i, 9) + 1).when(F.length(x) == 2, pick(i, 90) + 10).otherwise(pick(i, 156) + 100).cast("string")
    address = F.array_join(F.transform(F.split(canon, r"\."), octet), ".")

    address6 = F.concat(F.array_join(F.transform(chars, lambda c, i: F.when((i < 4) | (c == ":"), c).otherwise(of("0123456789abcdef", i))), ""), grown(lambda i: of("0123456789abcdef", i)))

    def name(which: tuple[str, str]) -> Column:
        tail = F.when(attempt > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt, F.lit(1))), lambda i: of(SYLLABLES[which[1]], i + 50)), "")).otherwise("")
        return F.lower(F.concat(of(NAMES[which], F.lit(-1)), tail))

    out = F.when(kind == "mail", mail).when(kind == "secret", secret).when(kind == "bank", keep(4)).when(kind == "phone", number).when(kind == "card", card).when(kind == "address", address).when(kind == "social", keep(0)).when(kind == "address6", address6)
    return reduce(lambda o, w: o.when(kind == f"{w[0]}.{w[1]}", name(w)), NAMES, out).otherwise(F.array_join(F.transform(chars, letter), ""))


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, surrogate of distinct entities; no two of a kind share one, and none is an original."""
    table = stored(entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", draw(F.col("kind"), F.col("canon"), F.lit(0), key)))
    originals = entities.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("taken"))
    for _ in range(GIVE_UP):
        first = table.groupBy("kind", "surrogate").agg(F.min("canon").alias("first"), F.count("*").alias("n"))
        bad = first.join(originals, ["kind", "surrogate"], "left").where((F.col("n") > 1) | F.col("taken"))
        bad = stored(table.join(bad, ["kind", "surrogate"]).where(F.col("taken") | (F.col("canon") != F.col("first"))).select("kind", "canon", F.lit(1).alias("again")))
        if bad.isEmpty():
            return table.select("kind", "canon", "surrogate")
        # a new draw keeps away from surrogates that others hold only by chance, so the check is made again
        more = table.join(bad, ["kind", "canon"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0)))
        table = stored(more.withColumn("surrogate", F.when(F.col("again").isNull(), F.col("surrogate")).otherwise(draw(F.col("kind"), F.col("canon"), F.col("attempt"), key))).drop("again"))
    raise RuntimeError("surrogates still collide")


def render(kind: Column, raw: Column, surrogate: Column) -> Column:
    """A surrogate in the layout of the mention `raw`."""
    state = lambda out, k: F.struct(out.alias("out"), k.alias("k"))
    # signs fill the mention's own places in order; what is left over (grown surrogates) follows
    place = "[0-9A-Z]"
    filled = F.aggregate(_chars(raw), state(F.lit(""), F.lit(0)), lambda s, c: F.when(c.rlike(place), state(F.concat(s["out"], F.substring(surrogate, s["k"] + 1, F.lit(1))), s["k"] + 1)).otherwise(state(F.concat(s["out"], c), s["k"])),
                         lambda s: F.concat(s["out"], F.substring(surrogate, s["k"] + 1, F.length(surrogate))))
    cased = F.array_join(F.zip_with(_chars(surrogate), _chars(raw), lambda c, r: F.when(c.isNull(), "").when(r.isNotNull() & r.rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    return F.when(kind.isin("phone", "card", "bank", "social"), filled).when(kind.isin("mail", "secret", "address6"), cased).when(kind == "address", surrogate).otherwise(F.initcap(surrogate))


@apart("_id", "_tkey", "_hash", "_new", "_known")
def with_surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with surrogates in the text, and n_entities: the mentions replaced."""
    src = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_tkey"), F.col(text_col).alias("_text"), names(F.col(text_col)).alias("_known"))
    src = src.select("_id", "_tkey", "_known", F.posexplode(mentions(F.col("_text"), F.col("_known"))).alias("i", "m"))
    found = stored(src.select("_id", "_tkey", "i", F.posexplode(F.coalesce(untitled(F.col("m"), F.col("_known")), parts(F.col("m")))).alias("j", "p")).select("_id", "_tkey", "i", "j", "p.*"))
    table = surrogate_table(found.select("kind", "canon").distinct(), key)
    shown = found.join(table, ["kind", "canon"]).withColumn("s", F.concat("prefix", render(F.col("kind"), F.col("raw"), F.col("surrogate"))))
    whole = shown.groupBy("_id", "_tkey", "i").agg(F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("j", "s"))), lambda x: x["s"]), "").alias("s"))
    back = whole.groupBy("_id", "_tkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("_new"))
    rows = docs.withColumn("_hash", F.xxhash64(text_col)).join(back, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_tkey")), "left")
    rows = rows.withColumn("_known", F.when(F.col("_new").isNotNull(), names(F.col(text_col))))
    gaps = F.split(F.col(text_col), pattern(F.col("_known")), F.lit(-1))
    text = F.array_join(F.zip_with(gaps, F.col("_new"), lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    rows = rows.withColumn(text_col, F.when(F.col("_new").isNull(), F.col(text_col)).otherwise(text)).withColumn("n_entities", F.coalesce(F.size("_new"), F.lit(0)))
    return rows.drop("_id", "_tkey", "_hash", "_new", "_known")
