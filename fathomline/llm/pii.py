"""PII surrogates, in DataFrame functions only.

Detected entities (mail addresses, phone numbers, IPv4 addresses, card numbers, IBANs, US social security numbers, access
keys and hexadecimal secrets, names after a title) are replaced where they stand. A surrogate depends on a key, the entity's
type and its canonical form, so that one entity gets the same surrogate everywhere, however it is written (case of mail, names
and hexadecimal secrets, punctuation of phone and card numbers). Letters stay letters of the same case and script (Latin, Greek, Cyrillic), digits
stay digits, punctuation stays; card numbers and IBANs keep their check digits right or wrong as they were.

Names: the words that follow a title are the parts of a name. Each part has one surrogate, whatever title or other part it stands with, and every later or
earlier mention of a part in the same document (as written, capitalised or in capitals) gets it too, with a title or without. Its ending follows the gender of
the titles that the part has in the document; where these differ, a mention follows its own title. Initials and the title stay.

Collision check: the distinct entities of the corpus (parts of names each for itself) and their surrogates are compared; an entity whose surrogate is also
another's, or is itself (a name: with any ending) an entity of the corpus, is drawn anew with the next attempt number until none is left. Every few attempts
the surrogates of names, mail addresses and phone numbers grow by a syllable, letter or digit, so that there are enough of them for any corpus;
all other formats have a thousand million surrogates or more. Should one be used up, an error names it after ``most_rounds`` draws.

Texts are searched once: what was found is written beside them. Only texts with entities are rebuilt, and they are shuffled only if
so many entities collided that these don't fit a small literal.

The key (HMAC-SHA256) has no default. It stands in the plan, so that event logs and plans of such a job are as secret as the key.

What counts as an entity is bounded by the formats themselves only: card numbers have 13 to 19 digits, IBANs at most 34 characters, international phone numbers groups of 2 to 4 digits.

Defined cases: null text stays null; empty text stays empty; identifiers may be null or repeat, since rows are never joined on them; an input column
named like the count column is replaced by it; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.storage import discard, stage

# Titles by gender.
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Don", "Sir"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Doña"]
NEUTRAL = ["Dr", "Prof", "Mx"]
TITLE = "(?:" + "|".join(sorted([*MALE, *FEMALE, *NEUTRAL], key=len, reverse=True)) + r")\.?"

WORD = r"[\p{L}\p{N}]"
#: A part of a name; a possessive s isn't part of it.
PART = r"\p{Lu}\p{L}*+(?:['’-]\p{L}{2,}+)*+"
TITLED = rf"\b{TITLE}(?: \p{{Lu}}\.)*+(?: {PART})++"
PATTERNS = {
    "mail": rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]++@{WORD}[\p{{L}}\p{{N}}-]*+(?:\.{WORD}[\p{{L}}\p{{N}}-]*+)++",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![\p{L}\p{N}]|\.[0-9])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "card": r"(?<![\p{L}\p{N}+-])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}])\+?(?:[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![\p{L}\p{N}])",
    "intl": r"(?<![\p{L}\p{N}])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}(?![\p{L}\p{N}])",
    "key": r"(?<![\p{L}\p{N}])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,}+)(?![\p{L}\p{N}])",
    "name": TITLED,
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
HEXADECIMAL = "^[0-9A-Fa-f]+$"
TITLE_HINT = rf"\b{TITLE}(?: \p{{Lu}}\.)*+ \p{{Lu}}"
HINT = r"[@0-9]|(?:AKIA|ASIA)[A-Z0-9]{16}|" + TITLE_HINT
LOWER = {"latin": "abcdefghijklmnopqrstuvwxyz", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "cyrillic": "абвгдежзиклмнопрстуфхцчшщыэюя"}
SYLLABLES = ["ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ja", "ka", "ke", "la", "le", "li", "lo", "ma", "me", "mi", "mo", "na", "ne", "ni", "no", "pa", "pe", "ra", "re", "ri", "ro", "sa"]
SYLLABLES_BY_SCRIPT = {
    "latin": SYLLABLES,
    "greek": ["βα", "βε", "γα", "γο", "δα", "δε", "ζα", "θε", "κα", "κε", "λα", "λε", "λι", "λο", "μα", "με", "μι", "μο", "να", "νε", "νι", "νο", "πα", "πε", "ρα", "ρε", "ρι", "ρο", "σα", "σε", "τα", "τε"],
    "cyrillic": ["ба", "бе", "бо", "ва", "ве", "га", "го", "да", "де", "до", "жа", "за", "ка", "ке", "ла", "ле", "ли", "ло", "ма", "ме", "ми", "мо", "на", "не", "ни", "но", "па", "пе", "ра", "ре", "ри", "ро"],
}
#: Collided entities that a literal holds; more are joined.
MOST_LITERAL = 1000
#: After so many attempts a surrogate is made longer by one unit.
ATTEMPTS_A_LENGTH = 4
ENDINGS = {"latin": ("o", "a", "e"), "greek": ("ος", "α", "ι"), "cyrillic": ("ов", "ова", "ин")}


def kind_of(entity: Column) -> Column:
    """The first type whose pattern matches the whole entity; what matches none is the mention of a name."""
    out = None
    for name, pattern in PATTERNS.items():
        full = entity.rlike(f"^(?:{pattern})$")
        value = F.lit("phone" if name == "intl" else name)
        out = F.when(full, value) if out is None else out.when(full, value)
    return out.otherwise(F.lit("name"))


def canonical(kind: Column, entity: Column) -> Column:
    """Of an entity that is no name."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return (
        F.when(kind == "mail", F.lower(entity))
        .when(kind == "phone", F.substring(digits, -10, 10))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .when((kind == "key") & entity.rlike(HEXADECIMAL), F.lower(entity))
        .otherwise(entity)
    )


def parts_of(name: Column) -> Column:
    """The words of a name, as written, without title and initials."""
    return F.filter(F.split(F.regexp_replace(name, f"^{TITLE} ", ""), " "), lambda w: (F.length(w) > 1) & w.rlike(f"^{PART}$"))


def _canons(kind: Column, entity: Column) -> Column:
    return F.when(kind == "name", F.array_distinct(F.transform(parts_of(entity), F.lower))).otherwise(F.array(canonical(kind, entity)))


def known(found: Column) -> Column:
    """array of struct(entity, kind, canons, units) of the entities found; ``units`` (kind, canon) is what has a surrogate of its own."""
    return _bound(F.transform(found, lambda e: F.struct(e.alias("entity"))), kind=lambda x: kind_of(x["entity"]), canons=lambda x: _canons(x["kind"], x["entity"]), units=lambda x: F.transform(x["canons"], lambda c: F.struct(x["kind"].alias("kind"), c.alias("canon"))))


def _keyed(key: str, message: Column) -> Column:
    """HMAC-SHA256 in hexadecimal."""
    own = key.encode()
    own = (hashlib.sha256(own).digest() if len(own) > 64 else own).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(x ^ y for x in own)) for y in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def _stream(key: str, kind: Column, canon: Column, attempt: Column, strength: int) -> Column:
    """512 bits in hexadecimal, keyed; ``strength`` (digits kept) is for tests that need collisions."""
    seed = F.concat_ws("\x1f", kind, canon, attempt.cast("string"))
    if strength < 64:
        seed = F.concat_ws("\x1f", kind, attempt.cast("string"), F.substring(F.sha2(seed, 256), 1, strength))
    return F.concat(_keyed(key, F.concat(F.lit("1"), seed)), _keyed(key, F.concat(F.lit("2"), seed)))


def _draw(stream: Column, at: Column) -> Column:
    """A number below 65536 for position ``at``; positions beyond the stream hash it once more with the position."""
    return F.conv(F.substring(F.sha2(F.concat(stream, at.cast("string")), 256), 1, 4), 16, 10).cast("int")


def _mapped_char(ch: Column, n: Column, hexa: bool = False) -> Column:
    def pick(alphabet: str) -> Column:
        return F.substring(F.lit(alphabet), (n % len(alphabet) + 1).cast("int"), F.lit(1))

    if hexa:
        return F.when(ch.rlike("[0-9]"), pick("0123456789")).when(ch.rlike("[a-f]"), pick("abcdef")).otherwise(ch)
    out = F.when(ch.rlike("[0-9]"), pick("0123456789"))
    for script, letters in (("Greek", LOWER["greek"]), ("Cyrillic", LOWER["cyrillic"]), ("Latin", LOWER["latin"])):
        own = ch.rlike(rf"\p{{Is{script}}}")
        out = out.when(own & ch.rlike(r"\p{Lu}"), F.upper(pick(letters))).when(own, pick(letters))
    return out.otherwise(ch)


def _mapped(text: Column, stream: Column, hexa: bool = False) -> Column:
    """``text`` with each letter and digit replaced by one of its own class, drawn by position."""
    return F.array_join(F.transform(F.split(text, ""), lambda ch, i: _mapped_char(ch, _draw(stream, i), hexa)), "")


def _refilled(pattern: Column, fill: Column) -> Column:
    """``pattern`` with its letters and digits replaced, left to right, by the characters of ``fill`` (as many, or more, which then follow); case follows ``fill``."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))
    step = lambda acc, ch: F.when(ch.rlike(r"[\p{L}\p{N}]"), F.struct(F.concat(acc["s"], F.substring(fill, acc["k"] + 1, F.lit(1))).alias("s"), (acc["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(acc["s"], ch).alias("s"), acc["k"].alias("k")))
    return F.aggregate(F.split(pattern, ""), start, step, lambda acc: F.concat(acc["s"], F.substring(fill, acc["k"] + 1, F.length(fill))))


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string, its last digit counted once."""
    reversed_digits = F.split(F.reverse(digits), "")
    doubled = F.transform(reversed_digits, lambda ch, i: F.when(i % 2 == 1, (ch.cast("int") * 2) - F.when(ch.cast("int") * 2 > 9, 9).otherwise(0)).otherwise(ch.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b)


def _modulo_97(text: Column) -> Column:
    """The remainder of the number that digits and letters (A is 10) make."""
    value = lambda ch: F.when(ch.rlike("[0-9]"), F.ascii(ch) - 48).otherwise(F.ascii(ch) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, ch: (a * F.when(ch.rlike("[0-9]"), 10).otherwise(100) + value(ch)) % 97)


def _bound(array: Column, **fields) -> Column:
    """``array`` (of structs) with fields added to each element. Each is worked out once, where a plain expression would repeat its inputs in full."""

    def adding(name, value):
        return lambda x: x.withField(name, value(x))

    for name, value in fields.items():
        array = F.transform(array, adding(name, value))
    return array


def _surrogates_of(array: Column, key: str, strength: int) -> Column:
    """array of struct(kind, canon, attempt, ...) with the field ``new`` added."""
    return _bound(array, s=lambda x: _stream(key, x["kind"], x["canon"], x["attempt"], strength), mapped=lambda x: _mapped(x["canon"], x["s"]), new=_surrogate_canonical)


def surrogate_canonical(kind: Column, canon: Column, attempt: Column, key: str, strength: int = 64) -> Column:
    """The surrogate of a canonical form; a name's endings are added where it stands in a text."""
    return F.element_at(_surrogates_of(F.array(F.struct(kind.alias("kind"), canon.alias("canon"), attempt.alias("attempt"))), key, strength), 1)["new"]


def _longer(attempt: Column, drawn) -> Column:
    """What ``attempt`` adds to a surrogate: ``drawn(k)`` for each unit k, from 1."""
    units = F.floor(attempt / ATTEMPTS_A_LENGTH).cast("int")
    return F.when(units > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(units, F.lit(1))), drawn), "")).otherwise("")


def _surrogate_canonical(x: Column) -> Column:
    kind, canon, s, mapped = x["kind"], x["canon"], x["s"], x["mapped"]
    letters = _longer(x["attempt"], lambda k: F.substring(F.lit(LOWER["latin"]), (_draw(s, k + 1000) % len(LOWER["latin"]) + 1).cast("int"), F.lit(1)))
    figures = _longer(x["attempt"], lambda k: (_draw(s, k + 1000) % 10).cast("string"))
    mail = F.concat_ws("@", F.concat(_mapped(F.substring_index(canon, "@", 1), s), letters), F.concat(_mapped(F.regexp_replace(F.substring_index(canon, "@", -1), r"\.[^.]+$", ""), F.concat(s, F.lit("d"))), F.regexp_extract(canon, r"(\.[^.]+)$", 1)))
    octet = lambda k: (_draw(s, F.lit(k)) % 254 + 1).cast("string")
    phone = F.concat((_draw(s, F.lit(99)) % 8 + 2).cast("string"), F.substring(mapped, 2, 64), figures)
    body = F.concat(F.substring(canon, 1, 1), F.expr("''"), F.substring(mapped, 2, 64))
    head = F.substring(body, F.lit(1), (F.length(canon) - 1).cast("int"))
    check = (10 - _luhn(F.concat(head, F.lit("0"))) % 10) % 10
    wrong = F.when(_luhn(canon) % 10 == 0, 0).otherwise(1 + _draw(s, F.lit(98)) % 9)
    card = F.concat(head, ((check + wrong) % 10).cast("string"))
    iban_body = _mapped(F.substring(canon, 5, 64), s)
    remainder = _modulo_97(F.concat(iban_body, F.substring(canon, 1, 2), F.lit("00")))
    # right check digits stay right, wrong ones wrong: they count modulo 97
    off = F.when(_modulo_97(F.concat(F.substring(canon, 5, 64), F.substring(canon, 1, 4))) == 1, 0).otherwise(1 + _draw(s, F.lit(97)) % 96)
    iban = F.concat(F.substring(canon, 1, 2), F.lpad(((96 - remainder + off) % 97 + 2).cast("string"), 2, "0"), iban_body)
    return (
        F.when(kind == "mail", mail)
        .when(kind == "ip", F.concat_ws(".", octet(1), octet(2), octet(3), octet(4)))
        .when(kind == "phone", phone)
        .when(kind == "card", card)
        .when(kind == "iban", iban)
        .when((kind == "key") & canon.rlike("^[0-9a-f]+$"), _mapped(canon, s, hexa=True))
        .when(kind == "key", F.concat(F.substring(canon, 1, 4), F.substring(mapped, 5, 512)))
        .when(kind == "name", _name(canon, s, x["attempt"]))
        .otherwise(mapped)
    )


def _by_script(word: Column, of) -> Column:
    return F.when(word.rlike(r"\p{IsGreek}"), of("greek")).when(word.rlike(r"\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))


def _name(canon: Column, s: Column, attempt: Column) -> Column:
    """A part of a name becomes three syllables (more after some attempts) in its script, without an ending."""

    def of(script: str) -> Column:
        table = F.array(*map(F.lit, SYLLABLES_BY_SCRIPT[script]))
        syllable = lambda at: F.element_at(table, (_draw(s, at) % len(SYLLABLES_BY_SCRIPT[script]) + 1).cast("int"))
        return F.concat(*[syllable(F.lit(k)) for k in range(3)], _longer(attempt, lambda k: syllable(k + 1000)))

    return _by_script(canon, of)


def _with_ending(stem: Column, gender: Column) -> Column:
    """A part's surrogate as it stands in a text, in small letters; gender is 0 (male), 1 (female) or 2."""
    return _by_script(stem, lambda script: F.concat(stem, F.element_at(F.array(*map(F.lit, ENDINGS[script])), gender + 1)))


def _gender(title: Column) -> Column:
    bare = F.regexp_replace(title, r"\.$", "")
    return F.when(bare.isin(*MALE), 0).when(bare.isin(*FEMALE), 1).otherwise(2)


def _renamed(x: Column, male: Column, female: Column) -> Column:
    """A name with the surrogates of its parts (``units``); title, initials and spaces stay."""
    entity, canons, news = x["entity"], x["units"]["canon"], x["units"]["new"]
    title = F.regexp_extract(entity, f"^({TITLE}) ", 1)

    def word(w: Column, i: Column) -> Column:
        is_male, is_female = F.array_contains(male, F.lower(w)), F.array_contains(female, F.lower(w))
        gender = F.when(is_male & ~is_female, 0).when(is_female & ~is_male, 1).otherwise(_gender(title))
        new = _with_ending(F.get(news, (F.array_position(canons, F.lower(w)) - 1).cast("int")), gender)
        cased = F.when(w == F.upper(w), F.upper(new)).otherwise(F.initcap(new))
        return F.when((i == 0) & (title != ""), w).when(F.array_contains(canons, F.lower(w)), cased).otherwise(w)

    return F.array_join(F.transform(F.split(entity, " "), word), " ")


def _in_format(x: Column, male: Column, female: Column) -> Column:
    """What stands in the text instead of an entity: the surrogates of its units in the entity's own format."""
    entity, kind, new = x["entity"], x["kind"], x["units"][0]["new"]
    digits = F.regexp_replace(entity, "[^0-9]", "")
    prefix = F.substring(digits, F.lit(1), F.greatest(F.length(digits) - 10, F.lit(0)).cast("int"))
    cased = F.array_join(F.zip_with(F.split(new, ""), F.split(entity, ""), lambda ch, as_in: F.when(as_in.rlike(r"\p{Lu}"), F.upper(ch)).otherwise(ch)), "")
    return (
        F.when(F.size(x["units"]) == 0, entity)
        .when(kind == "name", _renamed(x, male, female))
        .when((kind == "mail") | (kind == "key") & entity.rlike(HEXADECIMAL), cased)
        .when(kind == "phone", _refilled(entity, F.concat(prefix, new)))
        .when(kind.isin("card", "ssn", "iban"), _refilled(entity, new))
        .otherwise(new)
    )


def _strings() -> Column:
    return F.array().cast("array<string>")


def names_in(text: Column) -> Column:
    """All names after a title, with it."""
    return F.when(text.rlike(TITLE_HINT), F.regexp_extract_all(text, F.lit(TITLED), F.lit(0))).otherwise(_strings())


def mentions(titled: Column) -> Column:
    """How the parts of these names may stand in the document, longest first."""
    parts = F.array_distinct(F.flatten(F.transform(titled, parts_of)))
    forms = F.array_distinct(F.concat(parts, F.transform(parts, F.upper), F.transform(parts, lambda p: F.initcap(p))))
    return F.transform(F.array_sort(F.transform(forms, lambda f: F.struct((-F.length(f)).alias("n"), f.alias("f")))), lambda x: x["f"])


def pattern_of(names: Column) -> Column:
    """The pattern of all entities of a document whose names may be mentioned in these forms."""
    return F.when(F.size(names) > 0, F.concat(F.lit(ENTITY + r"|(?<![\p{L}\p{N}])(?=\p{Lu})(?:"), F.array_join(names, "|"), F.lit(r")(?![\p{L}\p{N}])"))).otherwise(F.lit(ENTITY))


def _of_gender(titled: Column, gender: int) -> Column:
    own = F.filter(titled, lambda t: _gender(F.regexp_extract(t, f"^({TITLE}) ", 1)) == gender)
    return F.array_distinct(F.flatten(F.transform(own, lambda t: F.transform(parts_of(t), F.lower))))


def searched(docs: DataFrame, text: str, count: str) -> DataFrame:
    """Staged: the rows (``r``) with their number, what was found in order, and of the names their forms and the parts with a male and a female title."""
    names = [F.col(f"`{c}`") for c in docs.columns if c.lower() != count.lower()]
    own = docs.select(F.struct(*names).alias("r"), F.col(text).alias("t"), names_in(F.col(text)).alias("titled"))
    own = own.select("r", "t", mentions(F.col("titled")).alias("names"), _of_gender(F.col("titled"), 0).alias("male"), _of_gender(F.col("titled"), 1).alias("female"))
    found = F.when(F.col("t").rlike(HINT), F.regexp_extract_all(F.col("t"), pattern_of(F.col("names")), F.lit(0))).otherwise(_strings())
    return stage(own.select("r", F.monotonically_increasing_id().alias("row"), "names", "male", "female", F.coalesce(found, _strings()).alias("found")), "pii-rows")


def collisions(entities: DataFrame, *, key: str, strength: int = 64, most_rounds: int = 200) -> DataFrame | None:
    """entities(kind, canon) -> (kind, canon, attempt) of those that can't keep their first surrogate; None if there is none."""
    known = stage(entities.distinct().withColumn("attempt", F.lit(0)), "pii-entities")
    for rounds in range(most_rounds):
        drawn = stage(known.withColumn("new", surrogate_canonical(F.col("kind"), F.col("canon"), F.col("attempt"), key, strength)), "pii-drawn")
        shared = drawn.groupBy("kind", "new").agg(F.min(F.struct("attempt", "canon")).alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        clash = drawn.join(shared, ["kind", "new"]).filter(F.struct("attempt", "canon") != F.col("keeper")).select("kind", "canon")
        forms = F.when(F.col("kind") == "name", F.array(*[_with_ending(F.col("new"), F.lit(g)) for g in range(3)])).otherwise(F.array("new"))
        real = drawn.withColumn("form", F.explode(forms)).join(known.select("kind", F.col("canon").alias("form")), ["kind", "form"], "left_semi").select("kind", "canon")
        again = stage(clash.unionByName(real).distinct().withColumn("bad", F.lit(1)), "pii-collisions")
        discard(drawn)
        if again.isEmpty():
            discard(again)
            return known.filter("attempt > 0") if rounds else None
        before, known = known, stage(known.join(again, ["kind", "canon"], "left").select("kind", "canon", (F.col("attempt") + F.coalesce("bad", F.lit(0))).alias("attempt")), "pii-entities")
        left = again
        discard(before)
    kinds = sorted(r["kind"] for r in left.select("kind").distinct().collect())
    raise ValueError(f"no free surrogates are left for {', '.join(kinds)} after {most_rounds} draws: the corpus uses up this format")


SEPARATOR = "\x1f"


def _rebuilt(text: Column, attempts: Column, key: str, strength: int) -> Column:
    """``text`` with surrogates; ``attempts`` is a map from type and canonical form to the attempt number, where it isn't 0."""
    number = lambda u: F.coalesce(F.try_element_at(attempts, F.concat_ws(SEPARATOR, u["kind"], u["canon"])), F.lit(0))
    drawn = _bound(known(F.col("found")), units=lambda x: _surrogates_of(F.transform(x["units"], lambda u: u.withField("attempt", number(u))), key, strength))
    new = F.transform(drawn, lambda x: _in_format(x, F.col("male"), F.col("female")))
    return F.array_join(F.zip_with(F.split(text, pattern_of(F.col("names")), -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def pseudonymise(docs: DataFrame, *, key: str, text: str = "text", count: str = "n_entities", strength: int = 64) -> DataFrame:
    """``docs`` with surrogates in ``text`` and the number of entities in ``count``."""
    rows = searched(docs, text, count)
    units = rows.select(F.explode("found").alias("e")).distinct().select(F.explode(known(F.array("e"))[0]["units"]).alias("u")).select("u.kind", "u.canon")
    override = collisions(units, key=key, strength=strength)
    hit = rows.filter(F.size("found") > 0)
    if override is None:
        hit = hit.withColumn("m", F.lit(None).cast("map<string,int>"))
    elif len(few := override.limit(MOST_LITERAL + 1).collect()) <= MOST_LITERAL:
        hit = hit.withColumn("m", F.create_map(*[F.lit(x) for r in few for x in (f"{r['kind']}{SEPARATOR}{r['canon']}", r["attempt"])]))
    else:
        each = hit.select("row", F.explode(F.flatten(known(F.col("found"))["units"])).alias("u")).select("row", "u.kind", "u.canon").distinct()
        drawn = each.join(override, ["kind", "canon"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(SEPARATOR, "kind", "canon"), "attempt"))).alias("m"))
        hit = hit.join(drawn, "row", "left")
    body = _rebuilt(F.col(f"r.`{text}`"), F.col("m"), key, strength)
    columns = [c for c in docs.columns if c.lower() != count.lower()]
    done = hit.withColumn("new", body).select(*[F.col("new").alias(c) if c == text else F.col(f"r.`{c}`").alias(c) for c in columns], F.size("found").alias(count))
    rest = rows.filter(F.size("found") == 0).select(*[F.col(f"r.`{c}`").alias(c) for c in columns], F.lit(0).alias(count))
    return done.unionByName(rest)
