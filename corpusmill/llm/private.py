"""Operator 10: format-preserving pseudonyms of personal data, with DataFrame functions only.

Every found value becomes a row of digits with a radix each (a date becomes two, an address four,
a card one per digit but for its check digit). A keyed Feistel network permutes these rows, and the
result is written back in the found format, with check digits made anew. The same value
therefore gets the same pseudonym in every document, and no table of values is kept.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Countries by the length of their IBANs. The published registry.
IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def printed_ibans() -> str:
    """IBANs in groups of four, each country with its own length, so that what follows is never taken in."""
    forms = []
    for n, countries in IBANS.items():
        rest = f" [A-Z0-9]{{{n % 4}}}" if n % 4 else ""
        forms.append(f"(?:{'|'.join(countries.split())})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}{rest}")
    return rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(forms)})(?![\p{{L}}\p{{N}}])"


#: Kinds in the order in which they are tried at a place in the text. Published formats.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-]+\.[A-Za-z0-9.\-]*[A-Za-z0-9]",
    "phone": r"(?<![\p{L}\p{N}])\+[0-9]{1,3}[ .\-]?\(?[0-9]{2,4}\)?(?:[ .\-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![\p{L}\p{N}])\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}(?![0-9])",
    "ipv4": r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9\-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9\-])",
    "date": r"(?<![0-9\-/])(?:18|19|20|21)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9\-/])",
    "day": r"(?<![0-9\-/])(?:0[1-9]|[12][0-9]|3[01])/(?:0[1-9]|1[0-2])/(?:18|19|20|21)[0-9]{2}(?![0-9\-/])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![\p{L}\p{N}])",
    "printed iban": printed_ibans(),
    "secret": r"(?<![\p{L}\p{N}])[0-9a-f]{32,64}(?![\p{L}\p{N}])",
}
#: Looked for in what the other kinds leave: digits over blanks and hyphens, of which a card may be a part.
RUN = r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,}+"
CARD_DIGITS = (13, 19)
GROUPS = 256  # of a run of digits, gone through at once
ANY = "|".join(PATTERNS.values())
#: 146,097 days from 1800-01-01 repeat the calendar; they are the product of these radices.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)
ISO, SLASHED = "yyyy-MM-dd", "dd/MM/yyyy"
DIGITS, LOWER, UPPER, HEX = string.digits, string.ascii_lowercase, string.ascii_uppercase, "0123456789abcdef"
ALPHABET = DIGITS + LOWER + UPPER


# --- the keyed permutation -------------------------------------------------------------------


def let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def noise(key: str, kind: Column, turn: Column, radices: Column, half: Column, n: Column) -> Column:
    """``n`` pseudo-random numbers that depend on the key, the place in the network and the other half."""
    seed = F.concat_ws(
        "|", F.lit(key), kind, turn.cast("string"), F.concat_ws(",", radices.cast("array<string>")), F.concat_ws(",", half.cast("array<string>"))
    )
    stream = let(seed, lambda s: F.concat(*[F.sha2(F.concat(s, F.lit(f"|{i}")).cast("binary"), 512) for i in range(2)]))
    # 8 hex digits each give 32 numbers
    return let(
        stream, lambda s: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(s, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint"))
    )


def permuted(values: Column, radices: Column, kind: Column, key: str) -> Column:
    """A permutation of the rows of digits with these radices: alternating modular additions.

    What is added to one half depends on the other one alone, so each round can be undone. A single
    digit is shifted by a number that the key decides. Rows hold up to 64 digits.
    """
    n = F.size(values)
    cut = F.floor(n / 2).cast("int")

    def added(half: Column, radix: Column, extra: Column) -> Column:
        return let(extra, lambda e: F.transform(half, lambda x, i: (x + F.get(e, i)) % F.get(radix, i)))

    def turn(state: Column, t: Column) -> Column:
        left, right = state["l"], state["r"]
        odd = t % 2 == 1
        left_r, right_r = F.slice(radices, F.lit(1), cut), F.slice(radices, cut + 1, n - cut)
        new_left = F.when(odd | (cut == 0), left).otherwise(added(left, left_r, noise(key, kind, t, radices, right, cut)))
        new_right = F.when(odd, added(right, right_r, noise(key, kind, t, radices, left, n - cut))).otherwise(right)
        return F.struct(new_left.alias("l"), new_right.alias("r"))

    start = F.struct(F.slice(values, F.lit(1), cut).alias("l"), F.slice(values, cut + 1, n - cut).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))


# --- formats ---------------------------------------------------------------------------------


def longs(*values: Column | int) -> Column:
    return F.array(*[(F.lit(v) if isinstance(v, int) else v).cast("bigint") for v in values])


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def places(text: Column, alphabet: str) -> Column:
    """Place in the alphabet of each character."""
    return F.transform(chars(text), lambda c: F.instr(F.lit(alphabet), c).cast("bigint") - 1)


def spelled(values: Column, alphabet: str) -> Column:
    return F.array_join(F.transform(values, lambda v: F.substring(F.lit(alphabet), (v + 1).cast("int"), F.lit(1))), "")


def refilled(text: Column, letters: Column) -> Column:
    """``text`` with its ASCII letters and digits replaced, in order, by those of ``letters``."""

    def step(state: Column, c: Column) -> Column:
        slot = c.rlike("^[0-9A-Za-z]$")
        new = F.when(slot, F.substring(letters, state["k"], F.lit(1))).otherwise(c)
        return F.struct(F.concat(state["out"], new).alias("out"), (state["k"] + slot.cast("int")).alias("k"))

    return F.aggregate(chars(text), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step, lambda s: s["out"])


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, b: a + b)


def check_digit(digits: Column) -> Column:
    """The digit that makes this row of digits pass the Luhn test."""
    doubled = F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return (F.lit(10) - total(doubled) % 10) % 10


def mod97(text: Column) -> Column:
    """Remainder of an upper-case string whose letters count from 10."""
    step = lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97
    return F.aggregate(places(text, DIGITS + UPPER), F.lit(0).cast("bigint"), step)


def numbers_in(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def country_code(text: Column) -> Column:
    return F.regexp_extract(text, r"^\+[0-9]{1,3}(?=[ .\-(])", 0)


def after(text: Column, n: Column) -> Column:
    return F.substring(text, n + 1, F.length(text))


def slots(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9A-Za-z]", "")


def day_of(text: Column, form: str) -> Column:
    return F.datediff(F.try_to_date(text, form), F.lit(FIRST_DAY).cast("date"))


def date_digits(text: Column, form: str) -> Column:
    return let(day_of(text, form), lambda d: longs(F.floor(d / DAYS[1]), d % DAYS[1]))


def date_text(new: Column, form: str) -> Column:
    return F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (new[0] * DAYS[1] + new[1]).cast("int")), form)


def luhn(digits: Column) -> Column:
    """Whether a string of digits ends in its check digit."""
    return let(places(digits, DIGITS), lambda d: check_digit(F.slice(d, F.lit(1), F.size(d) - 1)) == F.element_at(d, -1))


def passes_luhn(text: Column) -> Column:
    return luhn(numbers_in(text))


def token(text: Column, found: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(found).alias("found"))


def cards_in(run: Column) -> Column:
    """A run of digits in tokens: at each group the longest card number of whole groups that starts there.

    Groups are gone through in blocks, so that what is found so far is copied once per block, not per group.
    """

    def cut(groups: Column) -> Column:
        n = F.size(groups)

        def card(i: Column, size: Column) -> Column:
            return F.rtrim(F.array_join(F.slice(groups, i + 1, size), ""), F.lit(" -"))

        def holds(c: Column) -> Column:
            digits = F.replace(F.replace(c, F.lit(" "), F.lit("")), F.lit("-"), F.lit(""))
            return let(digits, lambda d: F.length(d).between(*CARD_DIGITS) & luhn(d))

        def step(state: Column, i: Column) -> Column:
            # a group holds a digit at least
            sizes = F.sequence(F.least(n - i, F.lit(CARD_DIGITS[1])), F.lit(1), F.lit(-1))
            right = F.filter(sizes, lambda k: holds(card(i, k)))
            found = let(F.get(right, F.lit(0)), lambda k: F.when(k.isNotNull(), F.struct(
                F.concat(state["out"], let(card(i, k), lambda c: F.array(
                    token(c, True), token(after(F.array_join(F.slice(groups, i + 1, k), ""), F.length(c)), False)
                ))).alias("out"),
                (i + k).alias("next"),
            )).otherwise(F.struct(F.concat(state["out"], F.array(token(F.get(groups, i), False))).alias("out"), (i + 1).alias("next"))))
            return F.when(i < state["next"], state).otherwise(found)

        def block(state: Column, first: Column) -> Column:
            own = F.sequence(first, F.least(first + GROUPS, n) - 1)
            inner = F.aggregate(own, F.struct(nothing().alias("out"), state["next"].alias("next")), step)
            return let(inner, lambda x: F.struct(F.concat(state["outs"], F.array(x["out"])).alias("outs"), x["next"].alias("next")))

        start = F.struct(F.array().cast("array<array<struct<text:string,found:boolean>>>").alias("outs"), F.lit(0).alias("next"))
        return F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(GROUPS)), start, block, lambda s: F.flatten(s["outs"]))

    return let(F.regexp_extract_all(run, F.lit(r"[0-9]+[ \-]?"), F.lit(0)), cut)


def between(text: Column, pattern: str, gap, value) -> Column:
    """The tokens of ``gap`` of what lies around the matches and ``value`` of the matches, in order."""
    gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(gaps.alias("p"), values.alias("v"))
    return F.flatten(F.transform(pairs, lambda z: F.concat(gap(z["p"]), F.when(z["v"].isNull(), nothing()).otherwise(value(z["v"])))))


def nothing() -> Column:
    return F.array().cast("array<struct<text:string,found:boolean>>")


def tokens(text: Column) -> Column:
    """The text in pieces, of which those that may be personal data are marked."""
    rest = lambda p: F.when(p.rlike(RUN), between(p, RUN, lambda q: F.array(token(q, False)), cards_in)).otherwise(F.array(token(p, False)))
    return between(text, ANY, rest, lambda v: F.array(token(v, True)))


def kind_of(text: Column) -> Column:
    """The format of a found value; null for a number that fails its check."""
    luhn = passes_luhn(text)
    whole = slots(F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4)))
    local = F.substring_index(text, "@", 1)
    return (
        F.when(F.contains(text, F.lit("@")), F.when(local.rlike(r"[\p{L}\p{N}&&[^0-9A-Za-z]]") | (F.length(slots(local)) > 64), "mailbox").when(
            F.length(slots(local)) > 0, "email"
        ))
        .when(text.rlike(r"^[+(]"), "phone")
        .when(text.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ipv4")
        .when(text.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.when(day_of(text, ISO).isNotNull(), "date"))
        .when(text.rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), F.when(day_of(text, SLASHED).isNotNull(), "day"))
        .when(text.rlike(r"^[A-Z]{2}[0-9]{2}"), F.when(mod97(whole) == 1, "iban"))
        .when(text.rlike(r"^[0-9 \-]+$") & (F.length(numbers_in(text)) < 20), F.when(luhn, "card"))
        .otherwise("secret")
    )


def digits_of(text: Column, kind: Column) -> Column:
    """The row of digits that is permuted."""
    ssn = F.split(text, "-").cast("array<bigint>")
    named = F.when(kind == "email", F.substring_index(text, "@", 1)).otherwise(F.substring(text, F.lit(5), F.length(text)))
    lettered = let(places(slots(named), ALPHABET), lambda flat: F.transform(flat, lambda v: v - first_of(v)))
    return (
        F.when(kind.isin("email", "iban"), lettered)
        .when(kind == "phone", places(numbers_in(after(text, F.length(country_code(text)))), DIGITS))
        .when(kind == "ipv4", F.split(text, r"\.").cast("array<bigint>"))
        # 898 areas: 1 to 899 without 666
        .when(kind == "ssn", longs(ssn[0] - F.when(ssn[0] > 666, 2).otherwise(1), ssn[1] - 1, ssn[2] - 1))
        .when(kind == "date", date_digits(text, ISO))
        .when(kind == "day", date_digits(text, SLASHED))
        .when(kind == "card", let(places(numbers_in(text), DIGITS), lambda d: F.slice(d, F.lit(1), F.size(d) - 1)))
        .when(kind == "secret", places(text, HEX))
    )


def first_of(place: Column) -> Column:
    """Where the class of a character starts in ALPHABET."""
    return F.when(place < 10, 0).when(place < 36, 10).otherwise(36).cast("bigint")


def classes_of(text: Column, kind: Column) -> Column:
    named = F.when(kind == "email", F.substring_index(text, "@", 1)).otherwise(F.substring(text, F.lit(5), F.length(text)))
    return F.transform(places(slots(named), ALPHABET), first_of)


def radices_of(kind: Column, digits: Column, classes: Column) -> Column:
    same = F.when(kind == "ipv4", 256).when(kind == "secret", 16).otherwise(10).cast("bigint")
    return (
        F.when(kind.isin("email", "iban"), F.transform(classes, lambda c: F.when(c == 0, 10).otherwise(26).cast("bigint")))
        .when(kind == "ssn", longs(898, 99, 9999))
        .when(kind.isin("date", "day"), longs(*DAYS))
        .otherwise(F.transform(digits, lambda _: same))
    )


def written(text: Column, kind: Column, new: Column, classes: Column, key: str) -> Column:
    """The pseudonym in the format of the found text."""
    letters = spelled(F.zip_with(new, classes, lambda v, c: v + c), ALPHABET)
    code = country_code(text)
    account = let(letters, lambda a: let(F.concat(F.substring(text, 1, 2), F.lit("00")), lambda c: F.concat(
        F.substring(text, 1, 2), F.format_string("%02d", F.lit(98) - mod97(F.concat(a, c))), a
    )))
    area = new[0] + F.when(new[0] >= 665, 2).otherwise(1)
    return (
        F.when(kind == "email", F.concat(let(letters, lambda a: refilled(F.substring_index(text, "@", 1), a)), F.lit("@"), F.substring_index(text, "@", -1)))
        .when(kind == "phone", F.concat(code, let(spelled(new, DIGITS), lambda a: refilled(after(text, F.length(code)), a))))
        .when(kind == "ipv4", F.array_join(new.cast("array<string>"), "."))
        .when(kind == "ssn", F.format_string("%03d-%02d-%04d", area, new[1] + 1, new[2] + 1))
        .when(kind == "date", date_text(new, ISO))
        .when(kind == "day", date_text(new, SLASHED))
        .when(kind == "iban", let(account, lambda a: refilled(text, a)))
        # no letter of it may stay, and other alphabets have no order here
        .when(kind == "mailbox", F.concat(F.substring(F.sha2(F.concat(F.lit(f"{key}|mailbox|"), F.substring_index(text, "@", 1)).cast("binary"), 256), 1, 32), F.lit("@"), F.substring_index(text, "@", -1)))
        .when(kind == "card", let(F.concat(spelled(new, DIGITS), check_digit(new).cast("string")), lambda a: refilled(text, a)))
        .when(kind == "secret", spelled(new, HEX))
        .otherwise(text)
    )


def network_of(kind: Column) -> Column:
    """The permutation of a kind; a day has one pseudonym in both of its formats."""
    return F.when(kind == "day", "date").otherwise(kind)


def pseudonyms(found: Column, key: str) -> Column:
    """The tokens with the found values under pseudonyms, in steps, so that every part is computed once."""
    steps = F.transform(found, lambda v: F.struct(v["text"].alias("text"), F.when(v["found"], kind_of(v["text"])).alias("kind")))
    steps = F.transform(steps, lambda s: F.struct(
        s["text"].alias("text"), s["kind"].alias("kind"),
        F.when(s["kind"].isNotNull(), digits_of(s["text"], s["kind"])).alias("digits"),
        F.when(s["kind"].isin("email", "iban"), classes_of(s["text"], s["kind"])).alias("classes"),
    ))
    steps = F.transform(steps, lambda s: F.struct(s.alias("s"), F.when(s["digits"].isNotNull(), radices_of(s["kind"], s["digits"], s["classes"])).alias("radices")))
    steps = F.transform(steps, lambda s: F.struct(
        s["s"].alias("s"), F.when(s["s"]["digits"].isNotNull(), permuted(s["s"]["digits"], s["radices"], network_of(s["s"]["kind"]), key)).alias("new")
    ))
    return F.transform(steps, lambda s: written(s["s"]["text"], s["s"]["kind"], s["new"], s["s"]["classes"], key))


def pseudonymise(df: DataFrame, key: str, text: str = "text", found: str | None = "n_private") -> DataFrame:
    """Replace personal data in ``text``; ``found`` names a column with the number of values changed.

    Changed: e-mail local parts, phone numbers, IPv4 addresses, SSNs, dates from 1800 to 2199, IBANs and
    card numbers with right check digits, hexadecimal secrets of 32 to 64 digits. Local parts with letters or
    digits beyond ASCII, or over 64, become 32 hexadecimal digits. A card may be any whole groups of
    a run of digits; an IBAN in groups of four has its country's length. Numbers that fail their check stay as they are.
    Null text stays null with 0 values, a text without digit is kept untouched, repeated rows give repeated
    results, other columns are kept, whatever their names, and an empty table stays empty.
    """
    value, parts, new = F.col(text), free_name(df, "found"), free_name(df, "new")
    work = df.withColumn(parts, F.when(value.rlike("[0-9@]") & (value.rlike(ANY) | value.rlike(RUN)), tokens(value)))
    some = F.col(parts).isNotNull()
    work = work.withColumn(new, F.when(some, pseudonyms(F.col(parts), key)))
    work = work.withColumn(text, F.when(some, F.array_join(new, "")).otherwise(value))
    if found:
        pairs = F.arrays_zip(F.col(f"{parts}.text").alias("a"), F.col(new).alias("b"))
        work = work.withColumn(found, F.when(some, F.size(F.filter(pairs, lambda z: z["a"] != z["b"]))).otherwise(0).cast("bigint"))
    return work.drop(parts, new)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table has not."""
    while name in df.columns:
        name += "_"
    return name
