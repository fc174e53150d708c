"""PII: keyed surrogates of like type, gender, script and format, in DataFrame expressions only.

Entities are found by one pattern and replaced where they stand. Surrogates come from a
keyed, format-preserving cipher (see encipher): characters move within their class
(digits, letters, vowels, consonants), unlike entities of one form stay unlike, an entity
has the same surrogate wherever it occurs, and none is its own surrogate. Given names
come from pools of the title's gender and the name's script, which is no bijection.
A check over the distinct entities of the corpus finds those whose choice another one
holds, or whose surrogate is some other entity of the corpus; these, and only these, get
further attempts until they are free.
"""

from __future__ import annotations

import secrets
import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.llm import base

#: Rows of resolved entities that are sent to every task; with more, texts are shuffled by a hash of their entities.
BROADCAST_LISTS = 200_000
#: Session setting that holds the key of the registered query and of the pipeline.
KEY_SETTING = "spark.lumenloom.pii.key"
#: Attempts at a free surrogate; only where nearly all strings of a form occur can they run out.
ATTEMPTS = 12
# Alphabets within which characters move.
DIGITS = ("0123456789",)
PHONE_DIGITS = ("01", "23456789")
_GREEK = ("αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
_CYRILLIC = ("абвгдежзийклмнопрстуфхцчшщъыьэюяё", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ")
_LATIN = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâäçèéêëíîïñóôöœùúûüß")
_SOUNDS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "áéíóúàèùâêîôûäöü", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ")
#: Where letters of either case are mixed: Latin, Greek and Cyrillic. Beyond, see _moved.
_MIXED = ((0x80, 0x24F), (0x370, 0x3FF), (0x400, 0x52F), (0x1E00, 0x1EFF), (0x1F00, 0x1FFF))


def _with_rest(alphabets: tuple[str, ...]) -> tuple[str, ...]:
    """``alphabets`` and, before them (they are tried last), those of all other letters and numbers of _MIXED, by range and case."""
    held, rest = set("".join(alphabets)), []
    for low, high in _MIXED:
        for kind in ("Lu", "Ll", ("Lo", "Lm", "Lt"), ("Nd", "No", "Nl")):
            found = "".join(c for c in map(chr, range(low, high + 1)) if unicodedata.category(c) in kind and c not in held)
            rest += [found] if found else []
    return (*rest, *alphabets)


LETTERS, SOUNDS = _with_rest(_GREEK + _CYRILLIC + _LATIN), _with_rest(_GREEK + _SOUNDS)
# Titles and given names by gender and script.
TITLES = {"m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Господин"), "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Госпожа")}
GIVEN = {
    "m": ("Adam", "Albert", "Bruno", "Carl", "David", "Edgar", "Felix", "George", "Hugo", "Ivan", "Jonas", "Kevin", "Leon", "Martin", "Oscar", "Paul", "Robert", "Simon", "Thomas", "Victor"),
    "f": ("Alice", "Anna", "Bella", "Clara", "Diana", "Emma", "Flora", "Grace", "Helen", "Irene", "Julia", "Karen", "Laura", "Maria", "Nina", "Olivia", "Paula", "Rosa", "Sarah", "Vera"),
}
GIVEN_CYRILLIC = {
    "m": ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Максим", "Павел", "Роман", "Степан"),
    "f": ("Алина", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Ирина", "Ксения", "Мария", "Нина", "Ольга", "Софья"),
}
# Words before a family name, which stay as they are.
PARTICLES = ("van", "von", "vom", "der", "den", "dem", "de", "del", "della", "di", "da", "dos", "du", "des", "la", "le", "los", "las", "zu", "zur", "ter", "ten", "bin", "ibn", "al", "el")
# First octets of public IPv4 addresses.
PUBLIC = tuple(k for k in range(1, 224) if k not in (10, 100, 127, 169, 172, 192, 198, 203))

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# Possessive groups run in a loop, not in recursion; lengths are those that addresses can have.
EMAIL = r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,126}+"
# The part of a domain up to its last label of letters.
_DOMAIN = r"^(.*\.[a-z]{2,63})(?![a-z0-9-])"
# Country calling codes of one and two digits; all others have three.
_COUNTRY = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)"
PHONE = r"(?<![\w+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?<![\w+])\+[2-9]\d{0,2}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,4}){2,5}(?!\w)"
LOCAL_PHONE = r"(?<![\w.(+-])\(?[2-9]\d{2}\)?[ .-]\d{3}[.-]\d{4}(?!\w|[.-]\d)"
IPV4 = rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)"
CARD = r"(?<![\w.-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w|[.-]\d)"
SSN = r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?!\w|[.-]\d)"
#: Titles that no other title begins: a text without these holds none.
_LEAST_TITLES = tuple(t for g in TITLES.values() for t in g if not any(t != o and t.startswith(o) for h in TITLES.values() for o in h))
_TITLE = rf"(?:{'|'.join(x for g in TITLES.values() for x in g)})\.?"
# A word of a name: initials before a further word, or a capital with inner capitals, marks, apostrophes and hyphens ('s and the like are no part of it).
_WORD = r"(?:(?:\p{Lu}\.){1,4}(?= \p{Lu})|(?:[dlDL]['’](?=\p{Lu}))?\p{Lu}[\p{L}\p{M}]*+(?:(?:-(?=\p{L})|['’](?=\p{Lu}|\p{L}{3}))[\p{L}\p{M}]++){0,4}(?![\p{L}\p{M}\p{N}]))"
_NAME_WORD = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}(?!{_TITLE} ){_WORD}"
NAME = rf"(?<![\p{{L}}\p{{N}}]){_TITLE} {_NAME_WORD}(?: {_NAME_WORD}){{0,6}}"
KINDS = {"email": EMAIL, "iban": IBAN, "phone": f"{PHONE}|{LOCAL_PHONE}", "ip": IPV4, "card": CARD, "ssn": SSN, "name": NAME}
# Every kind but names holds a digit or an @. No entity begins after an ASCII letter or digit, which is the quickest to see.
_START = r"(?<![A-Za-z0-9])"
NUMBERED = _START + "(?:" + "|".join((EMAIL, IBAN, PHONE, IPV4, CARD, SSN, LOCAL_PHONE)) + ")"
ENTITY = _START + "(?:" + "|".join((EMAIL, IBAN, PHONE, IPV4, CARD, SSN, LOCAL_PHONE, NAME)) + ")"


def _number(key: str, *parts: Column) -> Column:
    """A keyed number below 2**28 for ``parts``."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), *parts).cast("binary"), 256), 1, 7), 16, 10).cast("int")


_expressions: dict[tuple, Column] = {}


def _built(spark: SparkSession, key: str, name: str, build: Callable[[], Column]) -> Column:
    """A large expression, built once for a session and key."""
    own = (spark.sparkContext.applicationId, key, name)
    if own not in _expressions:
        _expressions[own] = build()
    return _expressions[own]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _listed(values: Iterable) -> Column:
    """An array of fixed values, as one string that the optimizer takes apart once."""
    return F.split(F.lit(",".join(map(str, values))), ",")


def _moved(c: Column, by: Column, alphabets: tuple[str, ...], always: Column) -> Column:
    """``c`` moved within its alphabet, where ``always`` never to itself. Among letters, Han and Hangul move as one alphabet each, and other scripts beyond _MIXED within their 16 code points."""
    step = lambda n: F.when(always, 1 + F.pmod(by, F.greatest(n - 1, F.lit(1)))).otherwise(by)
    alphabets = alphabets[::-1]
    starts = _listed(sum(map(len, alphabets[:k])) for k, a in enumerate(alphabets) for _ in a).cast("array<int>")
    sizes = _listed(len(a) for a in alphabets for _ in a).cast("array<int>")
    everything = "".join(alphabets)
    moved = c
    if not everything.isascii():
        code = F.ascii(c)
        turned = lambda low, n: low + F.pmod(code - low + step(F.lit(n)), F.lit(n))
        to = (
            F.when(code.between(0x4E00, 0x9FFF), turned(0x4E00, 0x5200))
            .when(code.between(0xAC00, 0xD7A3), turned(0xAC00, 11172))
            .when(code.between(0x250, 0x2FF) | (code.between(0x530, 0x1DFF) | (code >= 0x2070)), code - code % 16 + F.pmod(code + step(F.lit(16)), F.lit(16)))
        )
        moved = F.when(to.isNotNull(), F.decode(F.unhex(F.lpad(F.hex(to), 8, "0")), "UTF-32")).otherwise(c)
    known = F.split(F.lit(everything), "")
    within = lambda at: F.when(at >= 0, _let(F.struct(F.get(starts, at).alias("s"), F.get(sizes, at).alias("n")), lambda x: F.get(known, x["s"] + F.pmod(at - x["s"] + step(x["n"]), x["n"])))).otherwise(moved)
    return F.when(c == "", c).otherwise(_let(F.instr(F.lit(everything), c) - 1, within))


def encipher(s: Column, key: str, tweak: Column, alphabets: tuple[str, ...]) -> Column:
    """A keyed bijection on strings of one shape: every character stays within its alphabet, others stay.

    Two rounds of a Feistel network E (each half moves by a keyed digest of the other one,
    16 characters to a digest), then every character moves by a step that is not zero,
    then E backwards. Where a character has an alphabet of two or more, the result is
    thus never the string itself.
    """

    def turn(a: Column, k: Column) -> Column:
        left, right, middle = k.isin(1, 5), k.isin(2, 4), k == 3
        half = F.when(left, a["l"]).when(right, a["r"]).otherwise(F.concat(a["l"], a["r"]))
        other = F.when(left, F.array_join(a["r"], "")).when(right, F.array_join(a["l"], "")).otherwise(F.lit(""))
        digest = F.sha2(F.concat_ws("\x1f", F.lit(key), F.least(k, 6 - k).cast("string"), tweak, other).cast("binary"), 256)
        blocks = _let(digest, lambda d: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(half), 4)), lambda b: F.sha2(F.concat(d, b.cast("string")).cast("binary"), 256)))
        by = lambda given, i: F.conv(F.substring(F.get(given, F.shiftright(i, 4)), i.bitwiseAND(15) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        sign = F.when(k > 3, -1).otherwise(1)
        moved = _let(blocks, lambda given: F.transform(half, lambda c, i: _moved(c, sign * by(given, i), alphabets, middle)))
        n = F.size(a["l"])
        return _let(moved, lambda x: F.struct(F.when(left, x).when(right, a["l"]).otherwise(F.slice(x, F.lit(1), n)).alias("l"), F.when(left, a["r"]).when(right, x).otherwise(F.slice(x, n + 1, F.size(x))).alias("r")))

    halves = _let(F.split(s, ""), lambda c: F.struct(F.slice(c, F.lit(1), F.shiftright(F.size(c), 1)).alias("l"), F.slice(c, F.shiftright(F.size(c), 1) + 1, F.size(c)).alias("r")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(5)), halves, turn, lambda a: F.concat(F.array_join(a["l"], ""), F.array_join(a["r"], "")))


def _part(s: Column, tweak: Column) -> Column:
    return F.struct(s.alias("s"), tweak.alias("tweak"))


def _enciphered(parts: Column, key: str, alphabets: tuple[str, ...]) -> Column:
    """An array of _part, enciphered; the expression is large, and so stands there once."""
    return F.transform(parts, lambda p: encipher(p["s"], key, p["tweak"], alphabets))


def _refill(shape: Column, fill: Column, what: str) -> Column:
    """``shape`` with its characters of class ``what`` replaced, in order, by those of ``fill``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    kept = lambda a, c: F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))
    filled = lambda a, x: F.struct(F.concat(a["out"], F.substring(x, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))
    return _let(fill, lambda x: F.aggregate(F.split(shape, ""), start, lambda a, c: F.when(c.rlike(what), filled(a, x)).otherwise(kept(a, c)), lambda a: a["out"]))


def _luhn(digits: Column) -> Column:
    value = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(2 * c.try_cast("int") - F.when(c.try_cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda a, v: a + v)


def _mod97(s: Column) -> Column:
    return F.aggregate(F.split(s, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), F.pmod(a * 10 + c.try_cast("int"), F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97))))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def kind_of(m: Column) -> Column:
    """Kind of a matched string; null for addresses without a domain of letters, and for numbers whose length or check digits are wrong."""
    packed = F.regexp_replace(m, " ", "")
    return (
        F.when(m.contains("@"), F.when(_domain(m) != "", "email"))
        .when(m.rlike(r"^[A-Z]{2}\d\d"), F.when(_mod97(F.concat(F.substring(packed, F.lit(5), F.length(packed)), F.substring(packed, 1, 4))) == 1, "iban"))
        .when(m.startswith("+"), F.when(F.length(_digits(m)).between(8, 15), "phone"))
        .when(m.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^\p{L}"), "name")
        .when(F.length(_digits(m)) >= 13, F.when(F.pmod(_luhn(_digits(m)), F.lit(10)) == 0, "card"))
        .otherwise("phone")
    )


def _domain(m: Column) -> Column:
    """The domain of an address in lower case, up to its last label of letters; '' if it has none."""
    return F.regexp_extract(F.lower(F.substring_index(m, "@", -1)), _DOMAIN, 1)


def _again(what: str | Column, attempt: Column) -> Column:
    """The tweak of an attempt."""
    return F.concat(F.lit(what) if isinstance(what, str) else what, F.when(attempt > 0, F.concat(F.lit("#"), attempt.cast("string"))).otherwise(F.lit("")))


def _email(m: Column, key: str, attempt: Column) -> Column:
    domain = _domain(m)
    reserved = F.regexp_extract(domain, r"(example\.(?:com|org|net))$", 1)
    inside = F.when(reserved != "", F.lit("")).otherwise(F.concat(F.lit("."), F.substring_index(domain, ".", -1), F.lit(".example")))
    head = F.when(reserved != "", F.regexp_replace(domain, r"example\.(?:com|org|net)$", "")).otherwise(F.regexp_replace(domain, r"\.[a-z]+$", ""))
    local = F.substring_index(m, "@", 1)
    after = F.substring(m, F.length(local) + F.length(domain) + 2, F.length(m))
    parts = _enciphered(F.array(_part(local, _again(F.concat(F.lit("email "), domain), attempt)), _part(head, F.lit("domain"))), key, LETTERS + DIGITS)
    return _let(parts, lambda e: F.concat(e[0], F.lit("@"), e[1], reserved, inside, after))


def _country(m: Column) -> Column:
    """The country code of a phone number, '' for a local one."""
    return F.when(m.startswith("+"), F.regexp_extract(_digits(m), _COUNTRY, 1)).otherwise(F.lit(""))


def _phone(m: Column, key: str, attempt: Column) -> Column:
    """The digits after the country code decide alone, however they are written; further attempts use all digits in all places."""
    country, d = _country(m), _digits(m)
    own = F.substring(d, F.length(country) + 1, F.length(d))
    moved = F.when(attempt < 4, encipher(own, key, _again("phone", attempt), PHONE_DIGITS)).otherwise(encipher(own, key, _again("phone", attempt), DIGITS))
    return _refill(m, F.concat(country, moved), "[0-9]")


def _ip(m: Column, key: str, attempt: Column) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.try_cast("int"))
    public = _listed(PUBLIC).cast("array<int>")
    at = F.array_position(public, o[0]).cast("int")
    first = F.when(at > 0, F.element_at(public, F.pmod(at + F.pmod(_number(key, _again("octet", attempt)), F.lit(len(PUBLIC) - 1)), F.lit(len(PUBLIC))) + 1)).otherwise(o[0])
    x = o[1] * 65536 + o[2] * 256 + o[3]
    y = F.aggregate(
        F.sequence(F.lit(1), F.lit(4)), F.struct(F.shiftright(x, 12).alias("l"), x.bitwiseAND(4095).alias("r")),
        lambda a, k: F.struct(a["r"].alias("l"), a["l"].bitwiseXOR(_number(key, _again("ip", attempt), k.cast("string"), a["r"].cast("string")).bitwiseAND(4095)).alias("r")),
        lambda a: a["l"] * 4096 + a["r"],
    )
    return F.concat_ws(".", first.cast("string"), F.shiftright(y, 16).cast("string"), F.shiftright(y, 8).bitwiseAND(255).cast("string"), y.bitwiseAND(255).cast("string"))


def _card(m: Column, key: str, attempt: Column) -> Column:
    d = _digits(m)
    body = F.concat(F.substring(d, 1, 1), encipher(F.substring(d, F.lit(2), F.length(d) - 2), key, _again(F.concat(F.lit("card "), F.substring(d, 1, 1)), attempt), DIGITS))
    check = F.pmod(10 - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    return _refill(m, F.concat(body, check), "[0-9]")


def _ssn(m: Column, key: str, attempt: Column) -> Column:
    return encipher(m, key, _again("ssn", attempt), DIGITS)


def _iban(m: Column, key: str, attempt: Column) -> Column:
    packed = F.regexp_replace(m, " ", "")
    country, inner = F.substring(packed, 1, 2), F.substring(packed, F.lit(5), F.length(packed))
    body = encipher(inner, key, _again(F.concat(F.lit("iban "), country), attempt), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", *DIGITS))
    check = F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    return _refill(m, F.concat(country, check, body), "[A-Z0-9]")


def _is_particle(word: Column) -> Column:
    return F.array_contains(_listed(PARTICLES), word)


def _person(m: Column) -> tuple[Column, Column, Column, Column]:
    """Title, given name ('' without one), the words between, and family name of a titled name."""
    words = F.split(m, " ")
    has = (F.size(words) > 2) & ~_is_particle(words[1])
    first = F.when(has, 3).otherwise(2)
    return words[0], F.when(has, words[1]).otherwise(F.lit("")), F.slice(words, first, F.size(words) - first), F.element_at(words, -1)


def _is_initial(given: Column) -> Column:
    return given.rlike(r"^(?:\p{Lu}\.?)+$")


def _is_female(title: Column) -> Column:
    return F.regexp_replace(title, r"\.", "").isin(*TITLES["f"])


def _given(title: Column, given: Column, key: str) -> tuple[Column, Column]:
    """The given name's choice from its pool (never itself), and its own place there (null if it is in no pool)."""
    female, cyrillic = _is_female(title), given.rlike(r"^\p{IsCyrillic}")
    pools = F.when(cyrillic & female, _listed(GIVEN_CYRILLIC["f"])).when(cyrillic, _listed(GIVEN_CYRILLIC["m"])).when(female, _listed(GIVEN["f"])).otherwise(_listed(GIVEN["m"]))

    def choice(pool: Column) -> Column:
        at = F.nullif(F.array_position(pool, given).cast("int"), F.lit(0))
        foreign = F.pmod(_number(f"{key}/given", given), F.size(pool))
        turn = 1 + F.pmod(_number(f"{key}/given", F.lit("pool")), F.size(pool) - 1)
        return F.struct(F.element_at(pool, F.coalesce(F.pmod(at - 1 + turn, F.size(pool)), foreign) + 1).alias("name"), at.alias("at"))

    chosen = _let(pools, choice)
    return chosen["name"], chosen["at"]


def _name(m: Column, key: str, attempt: Column) -> Column:
    """From the first further attempt on, the enciphered given name (or else family name) is hyphenated to it, a bijection. Initials are enciphered."""
    return _let(F.struct(*(c.alias(n) for c, n in zip(_person(m), ("title", "given", "between", "family"), strict=True))), lambda p: _renamed(p["title"], p["given"], p["between"], p["family"], key, attempt))


def _renamed(title: Column, given: Column, between: Column, family: Column, key: str, attempt: Column) -> Column:
    plain, _ = _given(title, given, key)
    initial, further = _is_initial(given), attempt > 0
    # What is not used is the empty string, which costs little.
    parts = F.array(_part(F.when(initial | further, given).otherwise(F.lit("")), _again("given", attempt)), _part(F.when(further, family).otherwise(F.lit("")), _again("family", attempt)), _part(family, F.lit("family")))
    parts = F.concat(parts, F.transform(between, lambda w: _part(F.when(_is_particle(w), F.lit("")).otherwise(w), F.lit("family"))))
    return _let(_enciphered(parts, key, SOUNDS), lambda e: _joined(title, given, between, plain, e, initial, further))


def _joined(title: Column, given: Column, between: Column, plain: Column, e: Column, initial: Column, further: Column) -> Column:
    other = F.when(initial, e[0]).when(further, F.concat(plain, F.lit("-"), e[0])).otherwise(plain)
    between = F.transform(between, lambda w, i: F.when(_is_particle(w), w).otherwise(F.get(e, i + 3)))
    last = F.when(further & ((given == "") | initial), F.concat(e[2], F.lit("-"), e[1])).otherwise(e[2])
    return F.array_join(F.flatten(F.array(F.array(title), F.when(given != "", F.array(other)).otherwise(F.array().cast("array<string>")), between, F.array(last))), " ")


def surrogate(m: Column, key: str, attempt: Column | None = None) -> Column:
    """The surrogate of a matched string; strings of no kind stay. ``attempt``: 0, or what ``attempts`` says."""
    own = F.struct(m.alias("m"), kind_of(m).alias("kind"), (F.lit(0) if attempt is None else attempt).alias("attempt"))
    ciphers = {"email": _email, "phone": _phone, "ip": _ip, "card": _card, "ssn": _ssn, "iban": _iban, "name": _name}

    def chosen(x: Column) -> Column:
        out = x["m"]
        for kind, cipher in ciphers.items():
            out = F.when(x["kind"] == kind, cipher(x["m"], key, x["attempt"])).otherwise(out)
        return out

    return _let(own, chosen)


def identity(m: Column) -> Column:
    """What a matched string stands for, whatever its form: titles, separators and the case of a domain do not count; null for strings of no kind."""
    own = lambda x: F.struct(x.alias("m"), kind_of(x).alias("kind"), _digits(x).alias("d"))
    return _let(m, lambda x: _let(own(x), lambda o: _identity(o["m"], o["kind"], o["d"])))


def _identity(m: Column, kind: Column, d: Column) -> Column:
    named = F.concat(F.when(_is_female(F.substring_index(m, " ", 1)), F.lit("f ")).otherwise(F.lit("m ")), F.regexp_replace(m, r"^\S+ ", ""))
    phone = F.concat(F.when(m.startswith("+"), _country(m)).otherwise(F.lit("1")), F.lit(" "), F.substring(d, F.length(_country(m)) + 1, F.length(d)))
    what = (
        F.when(kind == "email", F.concat(F.substring_index(m, "@", 1), F.lit("@"), _domain(m)))
        .when(kind == "phone", phone).when(kind == "name", named).when(kind == "card", d)
        .when(kind == "iban", F.regexp_replace(m, " ", "")).otherwise(m)
    )
    return F.when(kind.isNotNull(), F.concat(kind, F.lit(" "), what))


def _found(text: Column, pattern: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), pattern, F.lit(0))


def _untitled(m: Column) -> Column:
    return F.regexp_replace(m, r"^\S+ ", "")


def _pattern(full: Column) -> Column:
    """ENTITY, and for a text with full titled names these names without a title, too."""
    words = F.transform(full, lambda m: F.concat(F.lit(r"\Q"), _untitled(m), F.lit(r"\E")))
    own = F.concat(F.lit(rf"{ENTITY}|(?<![\p{{L}}\p{{N}}])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(F.size(full) > 0, own).otherwise(F.lit(ENTITY))


def _full_names(found: Column) -> Column:
    """The distinct titled names with a given name that is no initial, longest first."""
    full = F.filter(found, lambda m: (kind_of(m) == "name") & (F.size(F.split(m, " ")) > 2) & ~_is_initial(F.split(m, " ")[1]) & ~_is_particle(F.split(m, " ")[1]))
    return F.reverse(F.array_sort(F.transform(F.array_distinct(full), lambda m: F.struct(F.length(_untitled(m)).alias("n"), m.alias("m"))))).getField("m")


def _titled(m: Column, full: Column) -> Column:
    """A matched string as it is, or an untitled name with the title it has elsewhere in the text."""
    return F.when(F.size(full) > 0, F.coalesce(F.get(F.filter(full, lambda f: _untitled(f) == m), F.lit(0)), m)).otherwise(m)


def found_in(docs: DataFrame) -> DataFrame:
    """``docs`` with _full (the full titled names of a text), and _found (its entities in order), written once."""
    text = F.col("text")
    # What cannot be in a text is not searched for.
    titled, numbered = F.lit(False), text.rlike("[0-9@]")
    for title in _LEAST_TITLES:
        titled = titled | text.contains(title)
    none = F.array().cast("array<string>")
    searched = F.when(numbered & titled, _found(text, F.lit(ENTITY))).when(numbered, _found(text, F.lit(NUMBERED))).when(titled, _found(text, F.lit(NAME))).otherwise(none)
    first = docs.withColumn("_found", searched)
    named = first.withColumn("_full", F.when(F.exists("_found", lambda m: m.rlike(r"^\p{L}") & ~m.contains("@")), _full_names(F.col("_found"))).otherwise(F.array().cast("array<string>")))
    return base.materialize(named.withColumn("_found", F.when(F.size("_full") > 0, _found(text, _pattern(F.col("_full")))).otherwise(F.col("_found"))), "entities")


def entities(found: DataFrame) -> DataFrame:
    """entity (its identity) and m (one of its forms) of the distinct entities of ``found``."""
    each = base.materialize(found.select(F.explode(F.array_distinct(F.transform("_found", lambda m: _titled(m, F.col("_full"))))).alias("m")).distinct(), "forms")
    return base.materialize(each.withColumn("entity", identity(F.col("m"))).where("entity is not null").groupBy("entity").agg(F.min("m").alias("m")), "entities")


def crowded(people: DataFrame, key: str) -> DataFrame:
    """The entities of ``people`` (entity, m: names) whose pool choice another given name of the same gender and family holds.

    A given name that is in the pool holds its choice, else the least one does.
    """
    title, given, between, family = _person(F.col("m"))
    choice, at = _given(title, given, key)
    held = ["_female", "_between", "_family", "_choice"]
    rows = people.select("entity", _is_female(title).alias("_female"), F.array_join(between, " ").alias("_between"), family.alias("_family"), choice.alias("_choice"), F.struct(at.isNull().alias("foreign"), given.alias("given")).alias("_who")).where((given != "") & ~_is_initial(given))
    holders = rows.groupBy(*held).agg(F.min("_who").alias("_holder"), F.max("_who").alias("_last")).where("_holder <> _last").drop("_last")
    return rows.join(holders, held).where("_who <> _holder").select("entity")


def attempts(known: DataFrame, key: str) -> DataFrame:
    """entity, attempt of the entities of ``known`` (entity, m) whose first surrogate is not free.

    A surrogate is free if it is no entity of the corpus and no other entity's surrogate.
    Each round gives those that are not free one more attempt; the first entity of a
    contested surrogate keeps it.
    """
    first = crowded(known.where(kind_of(F.col("m")) == "name"), key).withColumn("attempt", F.lit(1))
    candidate = _built(known.sparkSession, key, "candidate", lambda: identity(surrogate(F.col("m"), key, F.col("attempt"))))
    # The candidate is a large expression. On top of a join, adaptive execution plans it anew after each of the join's stages, so it is applied to rows that are written already.
    tried = lambda rows: base.materialize(base.materialize(rows, "numbered").withColumn("s", candidate), "attempts")
    state = tried(known.join(first, "entity", "left").withColumn("attempt", F.coalesce("attempt", F.lit(0))))
    for _ in range(ATTEMPTS):
        real = state.join(known.select(F.col("entity").alias("s")), "s", "left_semi").select("entity")
        claims = state.groupBy("s").agg(F.min(F.struct("attempt", "entity")).alias("first"), F.count("*").alias("n")).where("n > 1").select("s", F.col("first.entity").alias("first"))
        lost = base.materialize(real.union(state.join(claims, "s").where("entity <> first").select("entity")).distinct(), "lost")
        if not lost.take(1):
            break
        again = state.join(lost.withColumn("lost", F.lit(1)), "entity", "left").withColumn("attempt", F.col("attempt") + F.coalesce("lost", F.lit(0))).drop("lost", "s")
        state = tried(again)
    return state.where("attempt > 0").select("entity", "attempt")


def _with_attempts(found: DataFrame, resolved: DataFrame) -> DataFrame:
    """``found`` with _attempts: those of ``resolved`` that occur in a row; null if none does.

    Rows meet them by a hash of all their entities. Rows whose hashes agree share a list,
    which is harmless: an entity has one attempt everywhere. The lists are broadcast while
    they are few; beyond that texts are shuffled.
    """
    key = F.xxhash64("_found", "_full")
    each = found.where(F.size("_found") > 0).select(key.alias("_key"), F.explode(F.transform("_found", lambda m: identity(_titled(m, F.col("_full"))))).alias("entity")).distinct()
    listed = base.materialize(each.join(resolved, "entity").groupBy("_key").agg(F.collect_list(F.struct("entity", "attempt")).alias("_attempts")), "listed")
    # Rows without entities match nothing; their own hash deals them out.
    keyed = found.withColumn("_key", F.when(F.size("_found") > 0, key).otherwise(F.xxhash64("text")))
    return keyed.join(F.broadcast(listed) if listed.count() <= BROADCAST_LISTS else listed, "_key", "left").drop("_key")


def _replacement(m: Column, full: Column, tried: Column, key: str) -> Column:
    """The surrogate of a matched string of a text; an untitled name gets that of its titled form, without the title."""

    def attempt(whole: Column) -> Column:
        own = lambda e: F.coalesce(F.get(F.filter(tried, lambda x: x["entity"] == e), F.lit(0))["attempt"], F.lit(0))
        return F.when(F.size(tried) > 0, _let(identity(whole), own)).otherwise(F.lit(0))

    def new(whole: Column) -> Column:
        return _let(surrogate(whole, key, attempt(whole)), lambda s: F.when(whole == m, s).otherwise(_untitled(s)))

    return _let(_titled(m, full), new)


def protect(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with every entity of ``text`` replaced, all other columns as they are, and n_entities (in place of a column of that name).

    A null text stays null with 0 entities, an empty one empty; text outside entities is
    untouched to the character; repeated rows get equal results; an empty table gives no
    rows. Names are found after a title, and where a text has a full name with a title,
    also without it in the same text. Texts are searched once and written with what was
    found; only distinct entities are shuffled, unless those that need further attempts
    are too many to broadcast.
    """
    if not key:
        raise ValueError("the key is empty")
    found = found_in(docs)
    resolved = base.materialize(attempts(entities(found), key), "resolved")
    none = F.lit(None).cast("array<struct<entity:string,attempt:int>>")
    found = _with_attempts(found, resolved) if resolved.take(1) else found.withColumn("_attempts", none)
    replaced = _built(docs.sparkSession, key, "replaced", lambda: F.transform("_found", lambda m: _replacement(m, F.col("_full"), F.col("_attempts"), key)))
    pieces = F.zip_with(F.split("text", _pattern(F.col("_full")), -1), replaced, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    text = F.when(F.size("_found") > 0, F.array_join(pieces, "")).otherwise(F.col("text"))
    counted = F.size(F.filter("_found", lambda m: kind_of(m).isNotNull())).cast("long")
    out = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns if c != "n_entities"]
    return found.select(*out, counted.alias("n_entities"))


def session_key(spark: SparkSession) -> str:
    """The key that the session is set to; a deployment sets its own. Where there is none, one is drawn and kept for the session."""
    if not spark.conf.get(KEY_SETTING, ""):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` with surrogates, the number of entities and the new text's digest."""
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    done = protect(docs, session_key(spark))
    return done.select("doc_id", "n_entities", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
