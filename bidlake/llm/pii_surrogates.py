"""Surrogates for personal data (operator 1; DataFrame functions only).

Detected mentions (e-mail addresses, phone and card numbers, IP addresses, national ids, IBANs,
access keys, passwords and tokens, titled person names in Latin and Cyrillic script, and those
names and surnames without a title in the same document) are replaced by made-up
ones of the same type and format:

- *Coreference.* A mention is reduced to what it names (the digits of a card number whatever
  their punctuation, those of a phone number without country code and trunk 0, an address in
  lower case, given name and surname apart). The same name gets the same surrogate in all
  documents, written in the mention's own format; "Mr. Smith" and "Mr. John Smith" keep one
  surname, and a number keeps its country code. A given name's gender is that of all its
  mentions' titles together: neutral, if they have none or differ.
- *Keyed.* Characters come from SHA-512 over (key, type, name, attempt).
- *Type and format.* Digits stay digits, letters keep their case, hex stays hex; a card number
  that passes the Luhn test still does; IP octets keep their lengths; mail domains are reserved
  ones; an IBAN keeps its country, but its check digits aren't made valid; given names keep gender and script, Cyrillic surnames their gender's ending.
- *Distinctness.* The surrogates of all distinct names are compared: where several names of
  a type would get the same, or one that really occurs, all but one (none in the second case)
  draw again, until no two agree. A name that fails often draws from a longer format.

Mentions are searched once, and written beside their documents; only distinct names and mentions
and the documents that hold mentions are shuffled. A mention in very many documents is one row on
its side of a join, which AQE splits.

Defined results: a null text stays null with no mentions; documents without mentions are
unchanged; repeated rows are treated alike; other columns pass through, whatever their names; a
column named as ``count`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, release, stage

KEY = "bidlake"
#: Draws from the mention's own format before it is made longer.
DRAWS = 6

MALE = "Mr|Herr|Sr|Señor|Monsieur|господин|г-н"
FEMALE = "Mrs|Ms|Miss|Frau|Sra|Señora|Mme|Madame|госпожа|г-жа"
EITHER = "Dr|Prof"
CAPITALS = "MR|HERR|SR|MONSIEUR|MRS|MS|MISS|FRAU|SRA|MME|MADAME|DR|PROF"
NAME = r"\p{Lu}[\p{L}'’-]+"
#: Capitalised words that are no names (as in a heading: "The Dr. In The House").
NO_NAME = r"(?!(?:A|An|And|At|By|Das|Der|Die|For|From|In|Is|Of|On|Or|The|To|Was|Who|With)\b)"
TITLED = (rf"(?=[\p{{Lu}}г])(?<![\p{{L}}\p{{N}}])(?:{MALE}|{FEMALE}|{EITHER}|{CAPITALS})\.? "
          rf"{NO_NAME}{NAME}(?: {NO_NAME}{NAME})?")
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*"
         r"\.[A-Za-z]{2,}")
AWS = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
PASSWORD = r"(?i:\bpass(?:word|wd)|\bpwd)\s?[:=]\s?[^\s\"']{4,}"
#: Keys that are known by their beginning, and private key blocks.
STARTS = r"gh[pousr]_|sk_(?:live|test)_|xox[abprs]-|AIza"
BLOCK = r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"
BLOCK_END = r"-----END [A-Z ]{0,24}PRIVATE KEY-----"
PREFIXED = (rf"(?<![A-Za-z0-9])(?:{STARTS})[A-Za-z0-9_-]{{16,}}"
            rf"|{BLOCK}[A-Za-z0-9+/=\s]{{16,}}{BLOCK_END}")
TOKEN = r"(?i:\btoken|\bapi[_-]?key|\bsecret)\s?[:=]\s?\"?[A-Za-z0-9_-]{16,}\"?"
IP = rf"(?=\d)(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?![\d]|\.\d)"
#: Words before a number that is no phone or card number.
LABELLED = (r"(?<!\b(?i:isbn(?:-1[03])?|part|order|item|ref|sku|serial|invoice|article|model|nr|no"
            r"|number)[ .:#]{1,3})")
BOOK = r"(?!97[89][ -]?\d)"
CARD = rf"(?=\d)(?<![\w+-]){LABELLED}{BOOK}(?!00\d{{1,3}}[ -])\d(?:[ -]?\d){{12,18}}(?![\w-])"
#: An amount with points between thousands.
AMOUNT = r"\d{1,4}(?:\.\d{3})+(?![.\d])"
PHONE = (rf"(?=[+(\d])(?<![\w+]){LABELLED}{BOOK}(?!{AMOUNT})(?:\+\d{{1,3}}[ .-]?)?"
         r"(?:\(\d{2,4}\)[ .-]?|(?!00)\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w)")
HEX = r"[0-9A-Fa-f]{1,4}"
IP6 = (rf"(?=[0-9A-Fa-f:])(?<![\w:.])(?=[A-Fa-f:]*\d)(?:(?:{HEX}:){{7}}{HEX}"
       rf"|(?:{HEX}(?::{HEX}){{0,6}})?::(?:{HEX}(?::{HEX}){{0,6}})?)(?![\w:]|\.\d)")
IBAN = (r"(?=[A-Z]{2}\d)(?<![A-Za-z0-9])(?=(?:[A-Z ]{0,8}\d){8})[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}"
        r"(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Social security numbers (US); DNI and NIE (Spain). A French NIR is found as a card number.
NATIONAL = (r"(?=[\dXYZ])(?<![\w-])(?:\d{3}-\d{2}-\d{4}|(?:\d{8}|[XYZ]-?\d{7})-?[A-Z])(?![\w-])")
#: What may stand between two digits of a phone number.
BETWEEN = r"(?: \(|\) |[ ()./-])?"
DATE = r"\d{1,2}[./-]\d{1,2}[./-](?:\d{4}|\d{2})(?!\d)"
#: International numbers (+ or 00) however grouped; national ones with a leading 0 (ten or
#: eleven digits, if nothing separates them); nine digits in the Spanish groups; ten North American
#: digits without punctuation.
PHONE_MORE = (rf"(?<![\w+])\+[1-9](?:{BETWEEN}\d){{6,14}}(?!\w)"
              rf"|(?=00)(?<![\w+.,/-]){LABELLED}00[1-9](?:{BETWEEN}\d){{7,14}}(?![\w]|[./-]\d)"
              rf"|(?=\(?0)(?<![\w+.,/-]){LABELLED}(?!{DATE})(?!{AMOUNT})(?!\d{{8,9}}(?!\d))"
              rf"\(?0[1-9](?:{BETWEEN}\d){{6,10}}(?![\w]|[./-]\d)"
              r"|(?<![\w+.,/-])[6-9]\d{2}(?:[ .-]\d{2}){3}(?![\w]|[./-]\d)"
              rf"|(?=[2-9]\d{{9}})(?<![\w+.,$€£/-]){LABELLED}[2-9]\d{{2}}[2-9]\d{{6}}(?![\w-]|[.,]\d)")
#: Country calling codes of one and two digits; all others have three (fixed values).
CALLING = (r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")
PHONES = rf"(?:{PHONE}|{PHONE_MORE})"
# Alternatives begin with a look at the next character, so most places in a text are left at once.
PATTERN = "|".join((EMAIL, AWS, PASSWORD, TOKEN, PREFIXED, IP, IP6, IBAN, NATIONAL, CARD, PHONES, TITLED))

#: Made-up name parts: first, middle and last syllables by script; endings by gender.
SYLLABLES = {
    "latin": (["bal", "cor", "del", "fen", "gar", "hol", "jor", "kel", "lor", "mar", "nor",
               "pel", "ros", "sal", "tor", "ver"],
              ["a", "e", "i", "o"], ["dan", "len", "min", "ran", "sten", "tin", "vin", "wen"]),
    "cyrillic": (["бел", "вор", "гор", "дол", "жар", "зор", "кол", "лав", "мир", "нов", "пол",
                  "рад", "сев", "тол", "хар", "яр"],
                 ["а", "е", "и", "о"], ["дан", "лен", "мин", "ран", "стен", "тин", "вин", "кон"]),
}
ENDINGS = {("latin", "m"): "", ("latin", "f"): "a", ("latin", "n"): "y",
           ("cyrillic", "m"): "", ("cyrillic", "f"): "а", ("cyrillic", "n"): "я"}


def kind_of(raw: Column) -> Column:
    def whole(pattern: str) -> Column:
        return raw.rlike(rf"^(?:{pattern})$")

    return (F.when(whole(EMAIL), "email").when(whole(AWS), "key").when(whole(PASSWORD), "password")
            .when(whole(TOKEN), "token").when(whole(PREFIXED), "prefixed").when(whole(IP), "ip").when(whole(CARD), "card")
            .when(whole(IP6), "ip6").when(whole(IBAN), "iban").when(whole(NATIONAL), "national")
            .when(whole(PHONES), "phone").otherwise("person"))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def signs(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9]", "")


def script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


SECRET = r"^(.*?[:=]\s?\"?)(.*?)(\"?)$"
PREFIXED_PARTS = rf"^({STARTS}|{BLOCK})([\s\S]*?)({BLOCK_END})?$"


def secret_part(raw: Column, kind: Column, part: int) -> Column:
    """What leads to a secret (1), the secret (2), what closes it (3)."""
    return F.when(kind == "prefixed", F.regexp_extract(raw, PREFIXED_PARTS, part)).otherwise(
        F.regexp_extract(raw, SECRET, part))


def subscriber(raw: Column) -> Column:
    """A phone number's digits without its country code and trunk 0."""
    plain = F.regexp_replace(raw, r"[^\d+]", "")
    return F.regexp_replace(F.regexp_replace(plain, rf"^(?:\+|00)(?:{CALLING})", ""), "^0", "")


def names_of(raw: Column, kind: Column) -> Column:
    """What a mention names: an array of (type, name)."""
    def one(type_: Column, name: Column) -> Column:
        return F.array(F.struct(type_.alias("type"), name.alias("name")))

    parts = F.split(F.regexp_replace(raw, r"^[^ ]+ ", ""), " ")
    surname = F.lower(F.element_at(parts, -1))
    # a Cyrillic surname's gender shows in its ending; the name is the one without it
    family = F.when(script(raw) == "cyrillic", F.regexp_replace(surname, r"а$", "")).otherwise(
        surname)
    last = F.struct(F.concat(F.lit("surname-"), script(raw)).alias("type"), family.alias("name"))
    given = F.struct(F.concat(F.lit("given-"), script(raw)).alias("type"),
                     F.lower(parts[0]).alias("name"))
    return (F.when(kind == "email", one(kind, F.lower(raw)))
            .when(kind == "phone", one(kind, subscriber(raw)))
            .when(kind == "card", one(kind, digits(raw)))
            .when(kind == "ip6", one(kind, F.lower(raw)))
            .when(kind.isin("iban", "national"), one(kind, signs(raw)))
            .when(kind.isin("password", "token", "prefixed"), one(kind, secret_part(raw, kind, 2)))
            .when(kind == "person", F.when(F.size(parts) > 1, F.array(given, last))
                  .otherwise(F.array(last)))
            .otherwise(one(kind, raw)))


def gender_of(raw: Column) -> Column:
    """m or f, if a mention's title says so."""
    title = F.regexp_extract(raw, r"^([^ .]+)", 1)
    return (F.when(title.rlike(f"(?iu)^(?:{FEMALE})$"), "f")
            .when(title.rlike(f"(?iu)^(?:{MALE})$"), "m"))


def with_gender(each: DataFrame) -> DataFrame:
    """Given names' types with the gender on which all of a name's titles agree, n if none or
    several do."""
    given = F.col("type").startswith("given-")
    titles = each.where(given).groupBy("type", "name").agg(
        F.min(gender_of(F.col("raw"))).alias("least"), F.max(gender_of(F.col("raw"))).alias("most"))
    agreed = titles.select("type", "name", F.when(
        F.col("least") == F.col("most"), F.col("least")).otherwise("n").alias("gender"))
    return each.join(agreed, ["type", "name"], "left").withColumn("type", F.when(
        F.col("gender").isNotNull(), F.concat("type", F.lit("-"), "gender"))
        .otherwise(F.col("type"))).drop("gender")


def draw(hash_: Column, i: Column, of: int) -> Column:
    """A number below ``of`` for place ``i`` (from 1)."""
    return F.conv(F.substring(hash_, (i - 1) % 62 * 2 + 1, F.lit(3)), 16, 10).cast("int") % of


def letter(hash_: Column, i: Column, alphabet: str) -> Column:
    return F.substring(F.lit(alphabet), draw(hash_, i, len(alphabet)) + 1, F.lit(1))


def alike(form: Column, hash_: Column, hexa: Column) -> Column:
    """A text whose characters are of the same classes as those of ``form``."""
    def char(i: Column) -> Column:
        c = F.substring(form, i, F.lit(1))
        return (F.when(c.rlike("[0-9]"), letter(hash_, i, "0123456789"))
                .when(c.rlike("[a-f]") & hexa, letter(hash_, i, "abcdef"))
                .when(c.rlike("[a-z]"), letter(hash_, i, "abcdefghijklmnopqrstuvwxyz"))
                .when(c.rlike("[A-Z]"), letter(hash_, i, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
                .otherwise(c))

    return F.when(F.length(form) > 0, F.array_join(F.transform(
        F.sequence(F.lit(1), F.length(form)), char), "")).otherwise("")


def luhn_sum(number: Column) -> Column:
    """The Luhn sum modulo 10; 0 means a valid number."""
    n = F.length(number)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda t, i: t + F.when(
        (n - i) % 2 == 1,
        F.substring(number, i, F.lit(1)).cast("int") * 2
        - F.when(F.substring(number, i, F.lit(1)).cast("int") > 4, 9).otherwise(0))
        .otherwise(F.substring(number, i, F.lit(1)).cast("int"))) % 10


def surrogate(type_: Column, name: Column, attempt: Column, key: str) -> Column:
    """What stands for ``name`` at the given draw."""
    hash_ = F.sha2(F.concat_ws("|", F.lit(key), type_, name, attempt.cast("string")), 512)
    wider = F.floor(attempt / DRAWS).cast("int")
    more = F.repeat(F.lit("0"), wider)
    hexa = name.rlike(r"^[0-9a-f]+$")
    local = F.regexp_extract(name, "^([^@]*)@", 1)
    labels = F.split(F.regexp_extract(name, "@(.*)$", 1), r"\.")
    inner = F.array_join(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))), ".")
    form = F.concat(local, more, F.lit("@"), F.when(inner != "", F.concat(inner, F.lit(".")))
                    .otherwise(""))
    email = F.concat(alike(form, hash_, F.lit(False)), F.lit("example."),
                     F.element_at(F.array(F.lit("com"), F.lit("net"), F.lit("org")),
                                  draw(hash_, F.lit(61), 3) + 1))
    number = alike(F.concat(name, more), hash_, F.lit(False))
    phone = F.concat(F.when(name.startswith("0"), "0").otherwise(
        letter(hash_, F.lit(1), "23456789")), F.substring(number, 2, 99))
    iban = F.concat(F.substring(name, 1, 2), F.substring(number, 3, 99))
    card = F.concat(F.substring(name, 1, 1), F.substring(number, 2, 99))
    octets = F.split(F.when(wider > 0, F.lit("100.100.100.100")).otherwise(name), r"\.")
    ip = F.array_join(F.transform(octets, lambda o, i: F.when(
        F.length(o) == 1, draw(hash_, i * 3 + 1, 10)).when(
        F.length(o) == 2, draw(hash_, i * 3 + 1, 90) + 10).otherwise(
        draw(hash_, i * 3 + 1, 156) + 100).cast("string")), ".")
    words = F.lit(None).cast("string")
    for alphabet, (first, middle, last) in SYLLABLES.items():
        def pick(options: list[str], i: int) -> Column:
            return F.element_at(F.array(*map(F.lit, options)),
                                draw(hash_, F.lit(i), len(options)) + 1)

        word = F.concat(pick(first, 1), pick(middle, 2), F.when(wider > 0, F.concat(
            pick(first, 5), F.repeat(pick(middle, 6), wider))).otherwise(""), pick(last, 3))
        longer = F.concat(word, pick(middle, 4), pick(last, 7))
        words = F.when(type_ == f"surname-{alphabet}", longer).otherwise(words)
        for gender in "mfn":
            words = F.when(type_ == f"given-{alphabet}-{gender}", F.concat(
                word, F.lit(ENDINGS[alphabet, gender]))).otherwise(words)
    key_ = F.concat(F.lit("AKIA"), F.substring(number, 5, 99))
    checked = F.concat(
        F.substring(card, F.lit(1), F.length(card) - 1),
        ((10 - luhn_sum(F.concat(F.substring(card, F.lit(1), F.length(card) - 1), F.lit("0"))))
         % 10).cast("string"))
    return (F.when(type_ == "email", email).when(type_ == "phone", phone)
            .when(type_ == "card", F.when(luhn_sum(name) == 0, checked).otherwise(card))
            .when(type_ == "ip", ip).when(type_ == "key", key_)
            .when(type_ == "ip6", alike(F.concat(name, more), hash_, F.lit(True)))
            .when(type_ == "iban", iban).when(type_ == "national", number)
            .when(type_.isin("password", "token", "prefixed"),
                  alike(F.concat(name, more), hash_, hexa))
            .otherwise(words))


def assign(names: DataFrame, key: str) -> DataFrame:
    """(type, name, surrogate) of all ``names`` (type, name), no two of a type alike and none
    like a name that occurs."""
    # drawing costs far more than a name's bytes let Spark expect, so tasks are asked for
    drawn = stage(names.distinct().repartition(
        partitions(names.sparkSession), "type", "name").withColumn("attempt", F.lit(0)).withColumn(
        "surrogate", surrogate(F.col("type"), F.col("name"), F.col("attempt"), key)), "drawn")
    while True:
        real = drawn.select(F.col("type").alias("t"), F.col("name").alias("n"))
        turn = Window.partitionBy("type", "surrogate").orderBy("attempt", "name")
        judged = drawn.withColumn("turn", F.row_number().over(turn)).join(
            real, (F.col("type") == F.col("t")) & (F.col("surrogate") == F.col("n")), "left")
        again = (F.col("turn") > 1) | F.col("n").isNotNull()
        if judged.where(again).isEmpty():
            return drawn.drop("attempt")
        after = judged.withColumn("attempt", F.col("attempt") + again.cast("int")).select(
            "type", "name", "attempt", F.when(again, surrogate(
                F.col("type"), F.col("name"), F.col("attempt"), key))
            .otherwise(F.col("surrogate")).alias("surrogate"))
        after = stage(after, "drawn")
        release(drawn)
        drawn = after


def in_case_of(raw: Column, text: Column) -> Column:
    """``text`` (lower case) in capitals or title case if ``raw`` is."""
    return (F.when((raw == F.upper(raw)) & (raw != F.lower(raw)), F.upper(text))
            .when(F.substring(raw, 1, 1) != F.lower(F.substring(raw, 1, 1)), F.concat(
                F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 999))).otherwise(text))


def written(raw: Column, kind: Column, parts: Column) -> Column:
    """The surrogates ``parts`` in the format of the mention ``raw``."""
    value = F.element_at(parts, 1)
    size = F.length(value)

    def place(i: Column) -> Column:
        c = F.substring(raw, i, F.lit(1))
        behind = F.length(digits(F.substring(raw, i, F.length(raw))))
        return F.when(c.rlike(r"\d") & (behind <= size),
                      F.substring(value, size - behind + 1, F.lit(1))).otherwise(c)

    number = F.array_join(F.transform(F.sequence(F.lit(1), F.length(raw)), place), "")
    # digits that a longer surrogate has more than the mention lead
    number = F.concat(F.substring(value, F.lit(1), F.greatest(
        size - F.length(digits(raw)), F.lit(0))), number)

    def place_sign(i: Column) -> Column:
        c = F.substring(raw, i, F.lit(1))
        behind = F.length(signs(F.substring(raw, i, F.length(raw))))
        return F.when(c.rlike("[A-Za-z0-9]") & (behind <= size),
                      F.substring(value, size - behind + 1, F.lit(1))).otherwise(c)

    mixed = F.concat(
        F.substring(value, F.lit(1), F.greatest(size - F.length(signs(raw)), F.lit(0))),
        F.array_join(F.transform(F.sequence(F.lit(1), F.length(raw)), place_sign), ""))
    title = F.regexp_extract(raw, r"^([^ ]+ )", 1)
    words = F.split(F.regexp_replace(raw, r"^[^ ]+ ", ""), " ")
    last_raw, last = F.element_at(words, -1), F.element_at(parts, -1)
    last = F.when(last_raw.rlike(r"\p{IsCyrillic}") & F.lower(last_raw).endswith("а"),
                  F.concat(last, F.lit("а"))).otherwise(last)
    person = F.concat(title, F.when(F.size(parts) > 1, F.concat(
        in_case_of(words[0], value), F.lit(" "))).otherwise(""), in_case_of(last_raw, last))
    return (F.when(kind == "email", F.when(raw == F.upper(raw), F.upper(value)).otherwise(value))
            .when(kind.isin("phone", "card"), number)
            .when(kind.isin("iban", "national"), mixed)
            .when(kind == "ip6", F.when(raw == F.upper(raw), F.upper(value)).otherwise(value))
            .when(kind.isin("password", "token", "prefixed"), F.concat(
                secret_part(raw, kind, 1), value, secret_part(raw, kind, 3)))
            .when(kind == "person", person).otherwise(value))


def untitled(raw: Column, new: Column) -> Column:
    """A titled mention's name and its surname alone, longest first, with what stands for them:
    an array of (order, name, new)."""
    def behind(text: Column, pattern: str) -> Column:
        return F.regexp_replace(text, pattern, "")

    return F.array(*[F.struct(
        (-F.length(behind(raw, p))).alias("order"), behind(raw, p).alias("name"),
        behind(new, p).alias("new")) for p in (r"^[^ ]+ ", r"^.* ")])


def replace_untitled(piece: Column, bare: Column) -> tuple[Column, Column]:
    """``piece`` with the names in ``bare`` (see :func:`untitled`) replaced, and their number."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(bare["name"], "|"),
                       F.lit(r")(?![\p{L}\p{N}])"))
    found = F.regexp_extract_all(piece, pattern, F.lit(0))
    rebuilt = F.array_join(F.zip_with(
        F.split(piece, pattern, -1), found, lambda p, m: F.concat(p, F.when(
            m.isNull(), "").otherwise(F.element_at(
                bare["new"], F.array_position(bare["name"], m).cast("int"))))), "")
    none = F.size(bare) == 0
    return F.when(none, piece).otherwise(rebuilt), F.when(none, 0).otherwise(F.size(found))


def mentions_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def replace_private(documents: DataFrame, text: str = "text", key: str = KEY,
                    count: str = "n_mentions") -> DataFrame:
    """``documents`` (all columns) with surrogates in ``text`` and the number of mentions
    replaced in ``count``."""
    names = [c for c in documents.columns if c != count]
    # the caller's row is one column, so no name of ours meets one of theirs
    own = F.col("row").getField(text)
    found = stage(documents.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.coalesce(mentions_in(F.col(f"`{text}`")), F.array().cast("array<string>"))
        .alias("mentions")), "mentions")
    held = found.where(F.size("mentions") > 0)
    raws = held.select(F.explode(F.array_distinct("mentions")).alias("raw")).distinct()
    named = stage(raws.withColumn("kind", kind_of(F.col("raw"))).withColumn(
        "names", names_of(F.col("raw"), F.col("kind"))), "names")
    each = stage(with_gender(named.select(
        "raw", "kind", F.posexplode("names").alias("place", "part")).select(
        "raw", "kind", "place", "part.type", "part.name")), "parts")
    given = assign(each.select("type", "name"), key)
    texts = (each.join(given, ["type", "name"]).groupBy("raw", "kind").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("place", "surrogate"))),
        lambda x: x["surrogate"]).alias("parts"))
        .select("raw", "kind", written(F.col("raw"), F.col("kind"), F.col("parts")).alias("new")))
    # a document is known by its text; equal texts are changed alike
    marked = held.withColumn("mark", F.struct(F.xxhash64(own), F.md5(own)))
    per_text = marked.select("mark", F.explode(F.array_distinct("mentions")).alias("raw")
                             ).distinct().join(texts, "raw").groupBy("mark").agg(
        F.map_from_entries(F.collect_list(F.struct("raw", "new"))).alias("new"),
        F.sort_array(F.flatten(F.collect_list(F.when(F.col("kind") == "person", untitled(
            F.col("raw"), F.col("new")))))).alias("bare"))
    pieces = F.transform(F.split(own, PATTERN, -1), lambda p: F.struct(
        *[c.alias(n) for c, n in zip(replace_untitled(p, F.col("bare")), ("text", "n"))]))
    changed = marked.join(per_text, "mark").withColumn("pieces", pieces)
    rebuilt = F.array_join(F.zip_with(F.col("pieces.text"), "mentions", lambda p, m: F.concat(
        p, F.when(m.isNull(), "").otherwise(F.element_at(F.col("new"), m)))), "")
    number = F.size("mentions") + F.aggregate(F.col("pieces.n"), F.lit(0), lambda t, n: t + n)

    def columns(whole: Column) -> list[Column]:
        return [(whole if c == text else F.col("row").getField(c)).alias(c) for c in names]

    same = found.where(F.size("mentions") == 0).select(
        *columns(own), F.lit(0).cast("long").alias(count))
    return same.unionByName(changed.select(*columns(rebuilt), number.cast("long").alias(count)))


def op1_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """All documents with surrogates in place of personal data."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_private(documents)
