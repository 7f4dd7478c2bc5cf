"""Surrogates for personal data, in DataFrame functions only.

detect: one pattern (ENTITY) finds e-mail addresses, payment card numbers, phone numbers, IPv4 addresses, IBANs, US social security
numbers, secrets (long hexadecimal or key-like strings) and names after a title. replace: every distinct entity of the whole corpus gets one
surrogate, so mentions of one entity stay one (coreference) and different entities stay different (distinctness). Spellings are one entity where digits
(of phone, card and social security numbers), small letters (of e-mail addresses) or letters without spaces (of IBANs) are the same; a name is
its given name and its surname, so `Mr Adam Stone` and `Mr. Stone` keep one surname. A country code is part of a phone number; a name without a title is not found.

A surrogate is drawn from SHA-256 of (key, kind, attempt, part): letters become letters of the same script and case, digits digits,
punctuation stays; country codes, domains' endings and the prefixes of keys stay (only hexadecimal strings are drawn from a to f); cards that hold the Luhn test still do, as do IBANs theirs; address octets stay below 255; a name keeps
its title and gets a given name of the title's gender, in its script. Collision check: candidates that are a part of the corpus are
dropped, and of the parts that drew one candidate the first in (attempt, part) order has it; a part left without draws again.

Only entities and the texts that hold one are shuffled, hashed by text, so copies count once on the map side. Null text stays null and has
no entity; every row of the input comes back once, with its other columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, read, shared_folder, staged

KEY = "rasterloom surrogate key 1"  # the production key is the caller's to give
TRIES = 4  # candidates an entity draws at once

TITLES_F = "Mrs|Ms|Miss|Frau|Señora|Sra|Mme|Madame|Госпожа|г-жа|Κυρία"
TITLES_M = "Mr|Herr|Señor|Sr|Monsieur|Господин|г-н|Κύριος"
#: Beginnings of keys that tell their type.
PREFIX = r"(?:sk|pk|ghp|gho|xox[abp]|AKIA)[\-_]?"
KINDS = {
    "email": r"[\p{L}\p{N}._%+\-]+@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)*\.\p{L}{2,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "secret": rf"\b{PREFIX}[A-Za-z0-9_\-]{{16,}}\b|" r"\b(?=[0-9A-Fa-f]*[A-Fa-f])(?=[0-9A-Fa-f]*[0-9])[0-9A-Fa-f]{24,}\b",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ \-]?[0-9]{4}){2}[ \-]?[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9(])\(?[0-9]{3}\)?[ .\-][0-9]{3}[ .\-][0-9]{4}(?![0-9])",
    "name": rf"\b(?:{TITLES_F}|{TITLES_M})\.? \p{{Lu}}\p{{Ll}}+(?:[ \-]\p{{Lu}}\p{{Ll}}+)?",
}
ENTITY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Nothing in ENTITY matches without one of these; most texts are settled by this cheap test.
HINT = rf"[0-9@]|\b(?:{TITLES_F}|{TITLES_M})\b|\b{PREFIX}[A-Za-z0-9_\-]{{16}}"


def entities(text: Column) -> Column:
    """All entities of a text in order, mentions repeated."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), 0)).otherwise(F.array().cast("array<string>"))


def kind_of(value: Column) -> Column:
    return reduce(lambda out, k: F.when(value.rlike(f"^(?:{KINDS[k]})$"), F.lit(k)).otherwise(out), reversed(KINDS), F.lit("secret"))


def _draw(seed: Column, i: Column) -> Column:
    """A number below 65536 for place i (from 1): 16 places from each digest."""
    digest = F.sha2(F.concat(seed, F.lit("|"), F.floor((i - 1) / 16).cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, ((i - 1) % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _letter(c: Column, n: Column) -> Column:
    """A letter of c's script and case: Latin, Cyrillic, Greek, Arabic, Hangul, kana, Han; others become Latin."""
    code = F.ascii(c)
    low = F.lower(c)

    def of(first: int, count: int) -> Column:
        new = F.decode(F.unhex(F.lpad(F.hex((F.lit(first) + n % count).cast("int")), 4, "0")), "UTF-16BE")
        return F.when(c == low, new).otherwise(F.upper(new))

    ranges = [(0x430, 0x44F, 0x430, 32), (0x410, 0x42F, 0x430, 32), (0x391, 0x3A1, 0x3B1, 17), (0x3A3, 0x3C9, 0x3B1, 17), (0x627, 0x64A, 0x641, 9), (0xAC00, 0xD7A3, 0xAC00, 11172), (0x3041, 0x3096, 0x304B, 20), (0x30A1, 0x30FA, 0x30AB, 20), (0x4E00, 0x9FFF, 0x4E00, 20000)]
    return reduce(lambda out, r: F.when(code.between(r[0], r[1]), of(r[2], r[3])).otherwise(out), ranges, of(97, 26))


def _redrawn(value: Column, seed: Column, keep: Column, until: Column, hexadecimal: Column) -> Column:
    """value with letters and digits drawn anew from place keep + 1 to place until."""
    chars = F.split(value, "")

    def one(c: Column, i: Column) -> Column:
        n = _draw(seed, i + 1)
        digit = (n % 10).cast("string")
        letter = F.when(hexadecimal, F.when(c == F.lower(c), F.substring(F.lit("abcdef"), n % 6 + 1, F.lit(1))).otherwise(F.substring(F.lit("ABCDEF"), n % 6 + 1, F.lit(1)))).otherwise(_letter(c, n))
        return F.when((i < keep) | (i >= until), c).when(c.rlike("[0-9]"), digit).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def _remainder(iban: Column) -> Column:
    """An IBAN without spaces modulo 97, with its first four places moved to the end and letters counted from 10."""
    turned = F.split(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4))), "")
    return F.aggregate(turned, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _luhn(digits: Column, odd: int) -> Column:
    """Sum of the Luhn test; odd: 1 where the last digit counts once (a whole number), 0 where a check digit is still to come."""
    back = F.split(F.reverse(digits), "")
    return F.aggregate(F.transform(back, lambda c, i: F.when((i + odd) % 2 == 1, c.try_cast("int")).otherwise((c.try_cast("int") * 2) % 10 + F.floor(c.try_cast("int") * 2 / 10).cast("int"))), F.lit(0), lambda a, x: a + x)


GIVEN = {  # beginnings, then endings by gender, for the scripts that names are drawn in
    "latin": ("Al Be Cor Da El Fer Gal Hel Is Jo Kar Lu Mar Nor Or Pel Ros Sal Ta Ul Val Wil Yas Zel", "an den fred len mir nard ric ton vin", "ana da elle ia ina issa lyn nora ta"),
    "cyrillic": ("Ал Бо Вла Гле Да Ев Жан Зар Иг Кар Лю Ма Ни Ол Пет Ро Све Та Ул Фе Эль Юл Яр", "ан дор ей ил ислав мир тон", "ана ела ина ия лия мира та"),
    "greek": ("Αλ Βασ Γε Δη Ελ Ζα Ηλ Θε Ισ Κα Λε Μα Νι Ορ Παν Ρο Σε Ταν Φι Χα", "ανος ης ιος ος τας", "άνα ία ίνα νη τα"),
}
SURNAME = {"latin": "bach berg dale field ford gard hart land man mont ner sen stein ton well wick", "cyrillic": "аев енко ин ман ов ский ук ян", "greek": "άκης ίδης όπουλος ου"}


def _pick(words: str, n: Column) -> Column:
    own = words.split()
    return F.element_at(F.array(*map(F.lit, own)), (n % len(own) + 1).cast("int"))


def _script(value: Column, of: Callable[[str], Column]) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(value.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))


def _given(value: Column, seed: Column, attempt: Column, female: Column) -> Column:
    """A given name of the script and gender; later attempts have a syllable more, so that there are enough."""

    def of(script: str) -> Column:
        first, male, fem = GIVEN[script]
        n = [_draw(seed, F.lit(i)) for i in range(1, 5)]
        more = [F.when(attempt < least, F.lit("")).otherwise(F.lower(_pick(first, n[k]))) for least, k in ((2, 2), (8, 3))]
        return F.concat(_pick(first, n[0]), *more, F.when(female, _pick(fem, n[1])).otherwise(_pick(male, n[1])))

    return _script(value, of)


def _surname(value: Column, seed: Column, attempt: Column) -> Column:
    """A surname of the script; two with a hyphen for two."""

    def of(script: str) -> Column:
        first = GIVEN[script][0]

        def one(at: int) -> Column:
            n = [_draw(seed, F.lit(at + i)) for i in range(1, 5)]
            return F.concat(_pick(first, n[0]), F.lower(_pick(first, n[1])), F.when(attempt < 3, F.lit("")).otherwise(F.lower(_pick(first, n[2]))), _pick(SURNAME[script], n[3]))

        return F.concat(one(0), F.when(value.contains("-"), F.concat(F.lit("-"), one(4))).otherwise(""))

    return _script(value, of)


def parts_of(value: Column, kind: Column) -> Column:
    """What of a mention is drawn, as (kind, norm): the same for all spellings of one entity. Of a number its digits, of an address its small letters,
    of a name its given name (by gender) and its surname; else the mention itself."""
    title = F.regexp_extract(value, rf"^(?:{TITLES_F}|{TITLES_M})\.? ", 0)
    female = title.rlike(rf"^(?:{TITLES_F})\.? $")
    names = F.substring(value, F.length(title) + 1, F.length(value))
    given, surname = F.substring_index(names, " ", 1), F.substring_index(names, " ", -1)
    part = lambda k, v: F.struct(k.alias("kind"), v.alias("norm"))
    digits = F.regexp_replace(value, "[^0-9]", "")
    plus = F.when(value.startswith("+"), F.concat(F.lit("+"), F.regexp_extract(value, r"^\+([0-9]{1,3})(?=[ .(\-])", 1), F.lit(" "))).otherwise("")
    return (
        F.when((kind == "name") & names.contains(" "), F.array(part(F.when(female, F.lit("given_f")).otherwise(F.lit("given_m")), given), part(F.lit("surname"), surname)))
        .when(kind == "name", F.array(part(F.lit("surname"), surname)))
        .when(kind == "email", F.array(part(kind, F.lower(value))))
        .when(kind == "phone", F.array(part(kind, F.concat(plus, F.substring(digits, F.greatest(F.length(plus) - 1, F.lit(1)), F.length(digits))))))
        .when(kind.isin("card", "ssn"), F.array(part(kind, digits)))
        .when(kind == "iban", F.array(part(kind, F.replace(value, F.lit(" "), F.lit("")))))
        .otherwise(F.array(part(kind, value)))
    )


def with_candidates(rows: DataFrame, key: str) -> DataFrame:
    """rows (kind, norm, attempt) with surrogate: a function of key, kind, attempt and part alone, in the part's form.

    Step by step in columns of their own, so that the letters are drawn by one expression for all kinds.
    """
    norm, kind, body = F.col("norm"), F.col("kind"), F.col("body")
    typed = F.when(kind == "secret", F.length(F.regexp_extract(norm, rf"^{PREFIX}(?:(?:live|test|proj)[\-_])?", 0))).when(kind == "phone", F.length(F.regexp_extract(norm, r"^\+[0-9]* ", 0))).when(kind == "iban", 2).otherwise(0)
    ending = F.when(kind == "email", F.length(F.regexp_extract(norm, r"\.\p{L}{2,}$", 0))).otherwise(0)
    rows = rows.withColumn("seed", F.concat_ws("|", F.lit(key), kind, F.col("attempt").cast("string"), norm)).withColumn("typed", typed)
    drawn = _redrawn(norm, F.col("seed"), F.col("typed"), F.length(norm) - ending, (kind == "secret") & (F.col("typed") == 0))
    octets = F.array_join(F.transform(F.split(norm, r"\."), lambda _, i: (_draw(F.col("seed"), i + 1) % 223 + 1).cast("string")), ".")
    given = kind.isin("given_f", "given_m")
    rows = rows.withColumn("body", F.when(kind == "ip", octets).when(given, _given(norm, F.col("seed"), F.col("attempt"), kind == "given_f")).when(kind == "surname", _surname(norm, F.col("seed"), F.col("attempt"))).otherwise(drawn))
    front = F.substring(body, F.lit(1), F.length(body) - 1)
    card = F.when(_luhn(norm, 1) % 10 == 0, F.concat(front, ((10 - _luhn(front, 0) % 10) % 10).cast("string"))).otherwise(body)
    checked = lambda check: F.concat(F.substring(body, 1, 2), check, F.substring(body, F.lit(5), F.length(body)))
    iban = F.when(_remainder(norm) == 1, checked(F.lpad((98 - _remainder(checked(F.lit("00")))).cast("string"), 2, "0"))).otherwise(body)
    key_ = F.when(norm.startswith("AKIA"), F.translate(body, "0189", "2345")).otherwise(body)  # such keys are base 32
    return rows.withColumn("surrogate", F.when(kind == "card", card).when(kind == "iban", iban).when(kind == "secret", key_).otherwise(body)).drop("seed", "typed", "body")


def rendered(value: Column, kind: Column, drawn: Column) -> Column:
    """The surrogate in the format of a mention. drawn: an array of the surrogates of its parts, in their order."""
    chars, one = F.split(value, ""), F.element_at(drawn, 1)
    digits = F.regexp_replace(one, "[^0-9]", "")
    numbered = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c)), "")
    spaced = F.array_join(F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substring(one, F.length(F.replace(F.substring(value, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))), "")
    cased = F.array_join(F.transform(chars, lambda c, i: F.when(c != F.lower(c), F.upper(F.substring(one, i + 1, F.lit(1)))).otherwise(F.substring(one, i + 1, F.lit(1)))), "")
    title = F.regexp_extract(value, rf"^(?:{TITLES_F}|{TITLES_M})\.? ", 0)
    return (
        F.when(kind.isin("phone", "card", "ssn"), numbered).when(kind == "iban", spaced).when((kind == "email") & (value != F.lower(value)), cased)
        .when(kind == "name", F.concat(title, F.array_join(drawn, " "))).otherwise(one)
    )


def surrogates(found: DataFrame, key: str = KEY) -> DataFrame:
    """value -> surrogate for the distinct values of found (column value). Spellings of one entity get one surrogate, each in its format; different
    entities get different ones, and none that is itself in the corpus.

    Parts left without a candidate draw again, until none is left; each round settles all but those that collided.
    """
    spark = found.sparkSession
    folder = shared_folder(spark)
    found.select("value").distinct().withColumn("kind", kind_of(F.col("value"))).withColumn("parts", parts_of(F.col("value"), F.col("kind"))).write.parquet(f"{folder}/values")
    values = spark.read.parquet(f"{folder}/values")
    values.select(F.explode("parts").alias("part")).select("part.kind", "part.norm").distinct().write.parquet(f"{folder}/parts")
    parts = spark.read.parquet(f"{folder}/parts")
    # drawing is all computing and few bytes, so it is dealt out by number and not by size
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left, done, at = parts, None, 0
    while True:
        drawn = left.repartition(wide, "norm").select("kind", "norm", F.explode(F.array(*[F.lit(at + i) for i in range(TRIES)])).alias("attempt"))
        drawn = with_candidates(drawn, key)
        free = drawn.join(parts.select("kind", F.col("norm").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "norm")).alias("first"))
        won = won.groupBy("kind", F.col("first.norm").alias("norm")).agg(F.min(F.struct("first.attempt", "surrogate")).alias("best")).select("kind", "norm", F.col("best.surrogate").alias("surrogate"))
        won.write.mode("append").parquet(f"{folder}/done")
        done = spark.read.parquet(f"{folder}/done")
        rest = parts.join(done, ["kind", "norm"], "left_anti")
        at += TRIES
        if rest.isEmpty():
            break
        if at >= 400:
            raise ValueError("some entities find no free surrogate: their formats have fewer values than the corpus has entities")
        left = rest
    each = values.select("value", F.col("kind").alias("whole"), F.posexplode("parts").alias("place", "part")).select("value", "whole", "place", "part.kind", "part.norm")
    met = each.join(done, ["kind", "norm"]).groupBy("value", "whole").agg(F.array_sort(F.collect_list(F.struct("place", "surrogate"))).alias("drawn"))  # two parts at most
    return staged(met.repartition(wide, "value").select("value", rendered(F.col("value"), F.col("whole"), F.col("drawn.surrogate")).alias("surrogate")))


def replaced(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with surrogates in text, and n_entities long: mentions replaced in the row. A column named n_entities, in whatever case, is replaced; others stay."""
    docs, back = apart(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "n_entities"]), "text")
    names = docs.columns
    keep = [F.col(c) for c in names]
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("__text")
    # Each distinct text that holds an entity once, with its distinct entities.
    held = staged(docs.select(digest, F.array_distinct(entities(F.col("text"))).alias("__values")).where(F.size("__values") > 0).dropDuplicates(["__text"]))
    table = surrogates(held.select(F.explode("__values").alias("value")), key)
    maps = held.select("__text", F.explode("__values").alias("value")).join(table, "value")
    maps = maps.groupBy("__text").agg(F.map_from_entries(F.collect_list(F.struct("value", "surrogate"))).alias("__map"))  # as large as one text's entities
    hit = docs.withColumn("__found", entities(F.col("text"))).where(F.size("__found") > 0).withColumn("__text", digest)
    between = F.split("text", ENTITY, -1)
    mended = F.concat(F.array_join(F.zip_with(F.slice(between, F.lit(1), F.size("__found")), F.transform("__found", lambda v: F.element_at(F.col("__map"), v)), lambda a, b: F.concat(a, b)), ""), F.element_at(between, -1))
    changed = hit.join(maps, "__text").select(*[mended.alias("text") if c == "text" else F.col(c) for c in names], F.size("__found").cast("long").alias("n_entities"))
    same = docs.where(F.size(entities(F.col("text"))) <= 0).select(*keep, F.lit(0).cast("long").alias("n_entities"))
    return back(same.unionByName(changed), "n_entities")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return replaced(docs).select("doc_id", "n_entities", "text")
