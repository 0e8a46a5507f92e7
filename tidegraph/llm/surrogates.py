"""Private data: detected entities get keyed surrogates of the same type, by built-in functions only.

A pattern finds the entities of a text; each is replaced in place by a function of the key and the entity alone, so
one entity has one surrogate in all documents (coreference) and any executor finds it without a lookup:

* phone, card, account and social-security numbers: their digits pass through a keyed Feistel network over the
  numbers of that many digits, which is one-to-one; all other characters, and so the format, stay, as do a phone's
  country code, an account's country and a card's first digit: "+1 (212) 555-0100" and "1-212-555-0100" get equal
  digits.  Check digits (Luhn; ISO 7064 for accounts) are made anew, valid where they were.
* IPv4 addresses: the same over 32-bit numbers.  IPv6 addresses: eight groups from a hash.
* e-mail addresses: the local part keeps its letters-and-digits shape and gets a hashed suffix; each label of the host
  but the last gets hashed letters of its own, so addresses of one host stay so.
* secrets: each letter, digit and hex digit is replaced by one of its kind, from a 512-bit hash.
* names after a title: the family name becomes a built one in the script of the name (Latin, Cyrillic, Greek), the
  same wherever that family name stands; the given name one of the title's gender, with a built second part that keeps
  names apart.  Further mentions of such a name in the same text, in full or by family name, are replaced alike.

Before replacing, :func:`collisions` counts the surrogates that stand for two different entities of the corpus, and
hashed ones that are a real entity of it; if there are any, all surrogates are made anew with the next round of the
key until there are none.  One-to-one surrogates can't collide; that one equals some other person's real number
can't be helped where numbers are dense, and isn't counted.

Defined results: null text stays null, with no entities; repeated rows get equal results, ties don't arise; an empty
table gives an empty result; texts may be of any length; entities inside longer words or numbers are left alone, and so
are names that no title introduces; columns may have any names, but a ``count`` or ``kinds`` column that is there
already raises ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import let, no_clash, stage, unstage

#: Titles by gender, given names by gender and script, syllables of built names by script.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Lady", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "Pani", "госпожа", "Госпожа", "г-жа", "κυρία", "Κυρία"],
    "m": ["Mr", "Sir", "Lord", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Signor", "Pan", "господин", "Господин", "г-н", "κύριος", "Κύριος"],
    "x": ["Dr", "Prof"],
}
GIVEN = {
    ("f", "latin"): ["Anna", "Clara", "Elena", "Ida", "Julia", "Laura", "Maria", "Nora", "Paula", "Rosa", "Sara", "Vera", "Alma", "Emma", "Irma", "Olga"],
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leo", "Marco", "Oscar", "Paul", "Simon", "Tomas", "Victor"],
    ("x", "latin"): ["Alex", "Andrea", "Chris", "Dana", "Jean", "Kim", "Lee", "Lou", "Max", "Morgan", "Nico", "Pat", "Robin", "Sacha", "Sam", "Toni"],
    ("f", "cyrillic"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Иван", "Игорь", "Олег", "Павел", "Семён"],
    ("x", "cyrillic"): ["Саша", "Женя", "Валя", "Слава"],
    ("f", "greek"): ["Άννα", "Ελένη", "Ειρήνη", "Μαρία", "Σοφία", "Ζωή"],
    ("m", "greek"): ["Γιώργος", "Ιωάννης", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος"],
    ("x", "greek"): ["Αλέξης", "Χρύσα"],
}
SYLLABLES = {
    "latin": ["ba", "be", "bo", "da", "de", "do", "fa", "fe", "ka", "ke", "ko", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "ra", "re", "ro", "sa", "se", "so", "ta", "te", "to", "va", "ve", "vo"],
    "cyrillic": ["ба", "бе", "бо", "да", "де", "до", "фа", "фе", "ка", "ке", "ко", "ла", "ле", "ло", "ма", "ме", "мо", "на", "не", "но", "ра", "ре", "ро", "са", "се", "со", "та", "те", "то", "ва", "ве", "во"],
    "greek": ["βα", "βε", "βο", "δα", "δε", "δο", "φα", "φε", "κα", "κε", "κο", "λα", "λε", "λο", "μα", "με", "μο", "να", "νε", "νο", "ρα", "ρε", "ρο", "σα", "σε", "σο", "τα", "τε", "το", "γα", "γε", "γο"],
}
_ALL_TITLES = [t for names in TITLES.values() for t in names]
_TITLE = "|".join(_ALL_TITLES)
_INITIAL = f"(?=[{''.join(sorted({t[0] for t in _ALL_TITLES}))}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEXES = "[0-9a-fA-F]{1,4}"
_IPV6 = f"(?:{_HEXES}:){{7}}{_HEXES}|(?:{_HEXES}:){{2,6}}(?::{_HEXES}){{1,5}}|(?:fe80|fd[0-9a-fA-F]{{2}}|2[0-9a-fA-F]{{3}}):(?::{_HEXES}){{1,6}}"
#: Type to pattern, in order of precedence; no capturing groups.  A lookahead for the first characters stands before
#: what is dear to test, so that nearly all places fail at once.
PATTERNS = {
    "secret": r"(?=[A-Za-z0-9+/_\-]{16})(?<=(?:token|secret|passwd|password|api_key|apikey|access_key)[ ]{0,2}[=:][ ]{0,2}[\"']?)[A-Za-z0-9+/_\-]{16,}|(?=[0-9a-f]{32})(?<![\w])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![\w])|(?=A[KS]IA)(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)",
    "email": r"(?<![\w.+\-])[\p{L}0-9][\p{L}0-9._%+\-]*+@[\p{L}0-9](?:[\p{L}0-9\-]*[\p{L}0-9])?(?:\.[\p{L}0-9](?:[\p{L}0-9\-]*[\p{L}0-9])?)*\.[\p{L}]{2,}",
    "ip": rf"(?=\d)(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)|(?={_HEXES}:[0-9a-fA-F:])(?<![\w:])(?:{_IPV6})(?![\w:])",
    "iban": r"(?=[A-Z]{2}\d)(?<!\w)[A-Z]{2}\d{2}(?: ?\d{4}){3,6}(?: ?\d{1,3})?(?!\w)",
    "phone": r"(?=\+\d)(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-]?\d{2,4}){1,4}(?!\w)|(?=\(\d)(?<!\w)\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\w)|(?=\d)(?<![\w.\-])(?:1[ .\-])?\d{3}[ .\-]\d{3}[ .\-]\d{4}(?!\w|[.\-]\d)",
    "card": r"(?=\d{4})(?<![\w.\-])\d{4}(?:[ \-]?\d{4}){3}(?!\w|[.\-]\d)|(?=\d{4}[ \-])(?<![\w.\-])\d{4}[ \-]\d{6}[ \-]\d{5}(?!\w|[.\-]\d)|(?=\d{13})(?<![\w.\-])\d{13,19}(?!\w|[.\-]\d)",
    "ssn": r"(?=\d{3}-)(?<![\w.\-])\d{3}-\d{2}-\d{4}(?!\w|[.\-]\d)",
    "name": rf"{_INITIAL}(?<![\p{{L}}\w])(?:{_TITLE})\.? \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?(?!\p{{L}})",
}
ANY = "|".join(PATTERNS.values())
#: What every entity, or the place before it, holds; texts without it are passed over at once.  In this order: numbers;
#: octets of one digit; e-mail addresses; secrets after a name, in hex without adjacent digits, and by their start; names.
HINT = rf"[0-9]{{2}}|[0-9]\.[0-9]|@|[=:][ ]{{0,2}}[\"']?[A-Za-z0-9+/_\-]|[0-9a-f]{{32}}|AKIA|ASIA|{_INITIAL}(?:{_TITLE})\.? "
ROUNDS = 6
HEX = "0123456789abcdef"


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)


def _number(hexes: Column, at: int, digits: int = 12) -> Column:
    """A whole number from ``digits`` hex digits of a digest."""
    return F.conv(F.substring(hexes, at, digits), 16, 10).cast("bigint")


def _feistel(left: Column, right: Column, width: Column, left_size: Column, right_size: Column, key: str, sign: int = 1) -> Column:
    """(l, r) after ROUNDS keyed rounds: in turn, each half is shifted by a hash of the other, modulo its size.

    One-to-one for any halves, of equal sizes or not.
    """
    state = F.struct(left.alias("l"), right.alias("r"))

    def step(s: Column, i: Column) -> Column:
        of_right = _number(_digest(key, i.cast("string"), width.cast("string"), s["r"].cast("string")), 1)
        of_left = _number(_digest(key, i.cast("string"), width.cast("string"), s["l"].cast("string")), 1)
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["l"] + of_right, left_size)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + of_left, right_size)).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, step)


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("bigint")


def _chars(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))


def _put(entity: Column, new: Column) -> Column:
    """The entity with its digits replaced by those of ``new``, each in its place."""
    return F.aggregate(
        _chars(entity),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.struct(
            F.concat(s["out"], F.when(c.rlike("^[0-9]$"), F.substring(new, s["at"], F.lit(1))).otherwise(c)).alias("out"),
            (s["at"] + F.when(c.rlike("^[0-9]$"), 1).otherwise(0)).alias("at"),
        ),
        lambda s: s["out"],
    )


def _digits(entity: Column) -> Column:
    return F.regexp_replace(entity, "[^0-9]", "")


def _coded(digits: Column, key: str) -> Column:
    """Another number of as many digits, at most 36: one-to-one."""

    def code(d: Column) -> Column:
        n = F.length(d)
        half = F.floor(n / 2).cast("int")
        left = F.when(half > 0, F.substring(d, F.lit(1), half).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        right = F.substring(d, half + 1, n - half).cast("bigint")
        return let(_feistel(left, right, n, _power(half), _power(n - half), key), lambda s: F.concat(F.when(half > 0, F.lpad(s["l"].cast("string"), half, "0")).otherwise(""), F.lpad(s["r"].cast("string"), n - half, "0")))

    return let(digits, code)


def digits_surrogate(entity: Column, key: str, keep: Column) -> Column:
    """The entity with all digits but the first ``keep`` replaced."""
    return let(_digits(entity), lambda d: let(F.concat(F.substring(d, F.lit(1), keep), _coded(F.substring(d, keep + 1, F.length(d) - keep), key)), lambda new: _put(entity, new)))


def _luhn(body: Column) -> Column:
    """The check digit that makes ``body`` and it pass the Luhn test."""
    return F.get(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: F.call_function("luhn_check", F.concat(body, d.cast("string")))), 0)


def card_surrogate(entity: Column, key: str) -> Column:
    """The first digit stays; the last is as far from the Luhn digit as it was."""

    def made(d: Column) -> Column:
        n = F.length(d)
        body = F.concat(F.substring(d, 1, 1), _coded(F.substring(d, F.lit(2), n - 2), key))
        off = F.substring(d, n, F.lit(1)).cast("int") - _luhn(F.substring(d, F.lit(1), n - 1))
        return let(body, lambda b: let(F.concat(b, F.pmod(_luhn(b) + off, F.lit(10)).cast("string")), lambda new: _put(entity, new)))

    return let(_digits(entity), made)


def _account_check(country: Column, body: Column) -> Column:
    """98 less the account's number modulo 97."""
    letters = F.concat(*[(F.ascii(F.substring(country, i, 1)) - 55).cast("string") for i in (1, 2)])
    return 98 - F.concat(body, letters, F.lit("00")).cast("decimal(38,0)") % 97


def iban_surrogate(entity: Column, key: str) -> Column:
    """The country stays; the check digits are as far from the right ones as they were."""

    def made(d: Column) -> Column:
        country, n = F.substring(entity, 1, 2), F.length(d)
        body = _coded(F.substring(d, F.lit(3), n - 2), key)
        off = F.substring(d, 1, 2).cast("int") - _account_check(country, F.substring(d, F.lit(3), n - 2))
        return let(body, lambda b: let(F.concat(F.lpad(F.pmod((_account_check(country, b) + off).cast("int"), F.lit(100)).cast("string"), 2, "0"), b), lambda new: _put(entity, new)))

    return let(_digits(entity), made)


def ip_surrogate(entity: Column, key: str) -> Column:
    octet = lambda p, i: F.get(p, i).cast("bigint")

    def code(p: Column) -> Column:
        size = F.lit(65536).cast("bigint")
        coded = _feistel(octet(p, 0) * 256 + octet(p, 1), octet(p, 2) * 256 + octet(p, 3), F.lit(32), size, size, key)
        return let(coded, lambda s: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(s[h] / 256), s[h] % 256)]))

    groups = lambda d: F.concat_ws(":", *[F.substring(d, 4 * k + 1, 4) for k in range(8)])
    return F.when(entity.contains(":"), let(_digest(key, F.lower(entity)), groups)).otherwise(let(F.split(entity, "\\."), code))


def _letters(hexes: Column) -> Column:
    return F.translate(hexes, HEX, "abcdefghkmnprstv")


def email_surrogate(entity: Column, key: str) -> Column:
    """From the lower-case address, as mail systems ignore case."""

    def made(address: Column) -> Column:
        local, host = F.substring_index(address, "@", 1), F.split(F.substring_index(address, "@", -1), "\\.")
        labels = F.transform(host, lambda x, i: F.when(i == F.size(host) - 1, x).otherwise(_letters(F.substring(_digest(key, F.lit("host"), x), 1, 16))))

        def fill(d: Column) -> Column:
            at = lambda i: F.substring(d, F.pmod(i, F.lit(50)) + 1, F.lit(1))
            one = lambda c, i: F.when(c.rlike("^[0-9]$"), F.translate(at(i), "abcdef", "012345")).when(c.rlike("^\\p{L}$"), _letters(at(i))).otherwise(c)
            return F.concat(F.array_join(F.transform(_chars(local), one), ""), _letters(F.substring(d, 51, 14)))

        return F.concat(let(_digest(key, address), fill), F.lit("@"), F.array_join(labels, "."))

    return let(F.lower(entity), made)


def secret_surrogate(entity: Column, key: str) -> Column:
    """Each character becomes one of its kind: hex digit if the whole is hex, else digit, small or large letter."""
    hexes = let(_digest(key, entity), lambda d: F.concat(d, F.sha2(F.concat(d, F.lit(key)), 256)))

    def fill(d: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            v = F.conv(F.substring(d, F.pmod(i * 2, F.lit(126)) + 1, F.lit(3)), 16, 10).cast("int") + F.floor(i / 63).cast("int") * 7
            kind = lambda alphabet: F.substring(F.lit(alphabet), F.pmod(v, F.lit(len(alphabet))) + 1, F.lit(1))
            other = F.when(c.rlike("^[0-9]$"), kind("0123456789")).when(c.rlike("^[a-z]$"), kind("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("^[A-Z]$"), kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)
            return F.when(entity.rlike("^[0-9a-f]+$"), kind(HEX)).otherwise(other)

        return F.array_join(F.transform(_chars(entity), one), "")

    return let(hexes, fill)


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _built(name: Column, hexes: Column, syllables: int) -> Column:
    """A name of that many syllables in the script of ``name``, five bits of the hash for each."""
    tables = F.create_map(*[x for script, own in SYLLABLES.items() for x in (F.lit(script), F.array(*map(F.lit, own)))])
    at = lambda k: F.pmod(F.conv(F.substring(hexes, 2 * k + 1, 2), 16, 10).cast("int"), F.lit(32))
    return let(F.element_at(tables, _script(name)), lambda t: F.initcap(F.concat(*[F.get(t, at(k)) for k in range(syllables)])))


def family_surrogate(name: Column, key: str) -> Column:
    return let(_digest(key, F.lit("family"), name), lambda d: _built(name, d, 10))


def given_surrogate(name: Column, gender: Column, key: str) -> Column:
    tables = F.create_map(*[x for (g, script), own in GIVEN.items() for x in (F.lit(f"{g} {script}"), F.array(*map(F.lit, own)))])
    pick = lambda d: let(F.element_at(tables, F.concat_ws(" ", gender, _script(name))), lambda t: F.get(t, F.pmod(_number(d, 50, 6), F.size(t)).cast("int")))
    return let(_digest(key, F.lit("given"), gender, name), lambda d: F.concat(pick(d), F.lit("-"), _built(name, d, 10)))


def _name_parts(entity: Column) -> tuple[Column, Column, Column, Column]:
    """(title with its space, gender, given name or null, family name)."""
    title = F.regexp_extract(entity, rf"^((?:{_TITLE})\.? )", 1)
    gender = F.lit("x")
    for g in ("f", "m"):
        gender = F.when(entity.rlike(rf"^(?:{'|'.join(TITLES[g])})\.? "), g).otherwise(gender)
    own = F.split(F.regexp_replace(entity, rf"^(?:{_TITLE})\.? ", ""), " ")
    return title, gender, F.when(F.size(own) == 2, F.get(own, 0)), F.element_at(own, -1)


def name_surrogate(entity: Column, key: str) -> Column:
    """The title stays."""
    title, gender, given, family = _name_parts(entity)
    return F.concat(title, F.when(given.isNotNull(), F.concat(given_surrogate(given, gender, key), F.lit(" "))).otherwise(""), family_surrogate(family, key))


def mentions(gap: Column, names: Column, key: str) -> Column:
    """Text between entities with further mentions of ``names`` replaced: in full, then by family name."""

    def one(text: Column, entity: Column) -> Column:
        _, gender, given, family = _name_parts(entity)
        word = lambda w: F.concat(F.lit(r"(?<![\p{L}\w])"), w, F.lit(r"(?![\p{L}\w])"))
        surname = family_surrogate(family, key)
        full = F.when(given.isNotNull(), F.regexp_replace(text, word(F.concat(given, F.lit(" "), family)), F.concat(given_surrogate(given, gender, key), F.lit(" "), surname))).otherwise(text)
        return F.regexp_replace(full, word(family), surname)

    return F.aggregate(names, gap, one)


def type_of(entity: Column) -> Column:
    """The type of a found entity, from its own characters."""
    return (
        F.when(entity.rlike(rf"^(?:{_TITLE})\.? "), "name")
        .when(entity.contains("@"), "email")
        .when(entity.rlike(rf"^(?:(?:{_OCTET}\.){{3}}{_OCTET}|{_IPV6})$"), "ip")
        .when(entity.rlike(r"^[A-Z]{2}\d{2}(?: ?\d{4}){3,6}(?: ?\d{1,3})?$"), "iban")
        .when(entity.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(entity.rlike(r"^\d{4}(?:[ \-]?\d{4}){3}$|^\d{4}[ \-]\d{6}[ \-]\d{5}$|^\d{13,19}$"), "card")
        .when(entity.rlike(r"^(?:\+?\d|\(\d)[\d ().\-]*$") & (F.length(entity) < 26) & entity.rlike(r"[ ().\-+]"), "phone")
        .otherwise("secret")
    )


def surrogate(entity: Column, key: str) -> Column:
    kind = type_of(entity)
    # the country code of a number with "+" stays
    country = F.when(entity.rlike(r"^\+1|^1[ .\-]"), 1).when(entity.rlike(r"^\+\d{2,3}[ .\-(]"), F.length(F.regexp_extract(entity, r"^\+(\d+)", 1))).otherwise(0).cast("int")
    return let(
        kind,
        lambda k: F.when(k == "email", email_surrogate(entity, f"{key}|email"))
        .when(k == "ip", ip_surrogate(entity, f"{key}|ip"))
        .when(k == "phone", digits_surrogate(entity, f"{key}|phone", country))
        .when(k == "card", card_surrogate(entity, f"{key}|card"))
        .when(k == "iban", iban_surrogate(entity, f"{key}|iban"))
        .when(k == "ssn", digits_surrogate(entity, f"{key}|ssn", F.lit(0)))
        .when(k == "name", name_surrogate(entity, f"{key}|name"))
        .otherwise(secret_surrogate(entity, f"{key}|secret")),
    )


def entities(text: Column) -> Column:
    """The entities of a text, in order; none at once where the hint is missing."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(0))).otherwise(F.array().cast("array<string>"))


def replace(text: Column, found: Column, key: str) -> Column:
    """The text with each entity replaced; ``found`` must be ``entities(text)``."""
    parts = F.transform(found, lambda e: surrogate(e, key))
    names = F.filter(found, lambda e: type_of(e) == "name")
    whole = F.split(text, ANY, -1)
    between = let(names, lambda own: F.when(F.size(own) > 0, F.transform(whole, lambda g: mentions(g, own, f"{key}|name"))).otherwise(whole))
    both = let(between, lambda gaps: F.array_join(F.zip_with(gaps, parts, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), ""))
    return F.when(F.size(found) > 0, both).otherwise(text)


def all_entities(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The staged distinct entities (e) of all texts."""
    body = F.col(f"`{text}`")
    return stage(docs.filter(body.rlike(HINT)).select(F.explode(entities(body)).alias("e")).distinct(), "entities")


def collisions(found: DataFrame, key: str) -> int:
    """How many surrogates stand for two or more different entities ``found`` (e) of one type, or are one, if hashed.

    Numbers count as equal if their digits are, addresses if they differ in case only; given and family names count
    each by itself.
    """
    kind = type_of(F.col("e"))
    made = found.select(kind.alias("kind"), "e", F.when(kind != "name", surrogate(F.col("e"), key)).alias("s"))
    plain = lambda c: F.when(F.col("kind").isin("phone", "card", "iban", "ssn"), F.regexp_replace(c, "[^0-9A-Z]", "")).when(F.col("kind").isin("email", "ip"), F.lower(c)).otherwise(c)
    others = made.filter("kind != 'name'").select("kind", plain(F.col("e")).alias("e"), plain(F.col("s")).alias("s"))
    _, gender, given, family = _name_parts(F.col("e"))
    names = made.filter("kind = 'name'").select(gender.alias("gender"), given.alias("given"), family.alias("family")).distinct()
    own = f"{key}|name"
    families = names.select(F.lit("family").alias("kind"), F.col("family").alias("e"), family_surrogate(F.col("family"), own).alias("s"))
    givens = names.filter("given is not null").select(F.concat(F.lit("given "), F.col("gender")).alias("kind"), F.col("given").alias("e"), given_surrogate(F.col("given"), F.col("gender"), own).alias("s"))
    pairs = others.union(families).union(givens).distinct()
    twice = pairs.groupBy("kind", "s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("kind", "s")
    hashed = pairs.filter("kind not in ('phone', 'card', 'iban', 'ssn')").filter("kind != 'ip' or e like '%:%'")
    real = hashed.select("kind", "s").join(hashed.select("kind", F.col("e").alias("s")), ["kind", "s"], "left_semi")
    return twice.union(real).distinct().count()


def pick_round(found: DataFrame, key: str, *, most: int = 8, check=None) -> str:
    """The key of the first round without collisions among the entities ``found``."""
    check = check or collisions
    for n in range(most):
        own = f"{key}|round{n}"
        if not check(found, own):
            return own
    raise RuntimeError(f"surrogates still collide after {most} rounds")


def pseudonymize(docs: DataFrame, *, text: str = "text", key: str = "tide", count: str | None = None, kinds: str | None = None) -> DataFrame:
    """``docs`` with the entities of ``text`` replaced; columns ``count`` and ``kinds`` (comma list) if named."""
    no_clash(docs.columns, [c for c in (count, kinds) if c])
    found = all_entities(docs, text=text)
    own = pick_round(found, key)
    unstage(found)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), entities(F.col(f"`{text}`")).alias("found"))
    columns = [replace(F.col("row")[c], F.col("found"), own).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    if count:
        columns.append(F.coalesce(F.size("found"), F.lit(0)).cast("bigint").alias(count))
    if kinds:
        columns.append(F.array_join(F.transform("found", type_of), ",").alias(kinds))
    return held.select(*columns)
