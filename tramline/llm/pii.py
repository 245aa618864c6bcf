"""Format-preserving pseudonyms for personal numbers, dates and addresses, in DataFrame functions only.

Equal values get equal pseudonyms under one key, in whatever document they stand, and different values of a format get
different ones: every step is a permutation of the values of that format. What counts as the value are its letters and
digits: spellings that differ in separators (cards, accounts, phones, SSNs), in the order of a date, or in the case of an
email address are linked."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import fresh, let

ROUNDS = 8
#: Days from 1900-01-01 to 2099-12-31 and the two factors whose product just covers them.
FIRST_DAY, DAYS, LEFT, RIGHT = "1900-01-01", 73049, 271, 270
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Kind, pattern; the first that fits at a place wins. Kinds with a rule of their own (check digits, calendar) are validated later.
#: Characters of an IBAN by its country (the registry's lengths).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "IR IS TR", 27: "BF BI CF CG CM DJ FR GA GR IT KM MC MG MR SM TD", 28: "AL AZ BJ BY CI CY DO GQ GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}"),
    ("aws_key", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("secret", r"(?<=(?:password|token|secret|api_key) ?[=:] ?[\"']?)(?=[0-9]*[A-Za-z])[A-Za-z0-9]{12,64}(?![A-Za-z0-9])"),
    ("iban", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{IBAN})(?![A-Za-z0-9])"),
    ("ip", rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"),
    ("iso_date", r"(?<![0-9-])(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9](?![0-9-])"),
    ("day_first", r"(?<![0-9./])[0-3][0-9]\.[01][0-9]\.(?:19|20)[0-9]{2}(?![0-9/])"),
    ("month_first", r"(?<![0-9./])[01][0-9]/[0-3][0-9]/(?:19|20)[0-9]{2}(?![0-9/])"),
    ("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}(?:-(?!00)[0-9]{2}-|(?<![0-9] [0-9]{3}) (?!00)[0-9]{2} (?![0-9]{4} [0-9]))(?!0000)[0-9]{4}(?![0-9-])"),
    ("phone", r"(?<![0-9A-Za-z])\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"),
    ("us_phone", r"(?<![0-9A-Za-z])(?:\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?:" + "|".join(rf"(?<![0-9]{by})[2-9][0-9]{{2}}{by}[2-9][0-9]{{2}}{by}[0-9]{{4}}(?!{by}[0-9])" for by in ("-", r"\.", " ")) + r")(?![0-9A-Za-z]))"),
    ("card", r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"),
)
#: A run of groups of digits, 13 in all or more, up to a group that starts a value of another kind. It may hold a card among
#: other numbers. Possessive, since a long run would use up the stack of the matcher.
OTHER = "|".join(p for kind, p in PATTERNS if kind in ("email", "ip", "iso_date", "day_first", "month_first", "ssn", "us_phone"))
RUN = rf"(?<![0-9A-Za-z])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?![A-Za-z])(?:[ -](?!{OTHER})[0-9]++(?![A-Za-z]))*+"
#: Country codes of telephone numbers: of one and two digits; all others have three.
COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
ANY = "|".join(RUN if kind == "card" else p for kind, p in PATTERNS)


def keyed(key: str, *parts: Column) -> Column:
    """A long of 48 bits from SHA-256 of the key and the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256), 1, 12), 16, 10).cast("long")


def permute_characters(value: Column, key: str, phone: bool = False) -> Column:
    """A Feistel permutation of the strings of one format.

    A format is the class of each place: digit, small letter, capital, or a fixed character. Even rounds add a keyed
    hash of the second half to every place of the first, modulo the size of the place's class; odd rounds the reverse.
    Each round can be undone, so the whole is a permutation. Strings of one place have only the odd rounds' keyed shift.
    With ``phone`` the values are ten digits whose first and fourth are of the class 2 to 9 or of the class 0 and 1, as
    area codes and exchanges are."""

    def one_round(text: Column, r: Column) -> Column:
        half = F.floor(F.length(text) / 2).cast("int")
        left, right = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
        even = r % 2 == 0

        def place(c: Column, i: Column, other: Column, first: bool) -> Column:
            code = F.ascii(c)
            base = F.when(c.rlike("^[0-9]$"), 48).when(c.rlike("^[a-z]$"), 97).when(c.rlike("^[A-Z]$"), 65)
            radix = F.when(base == 48, 10).otherwise(26)
            if phone and first:
                base = F.when(i.isin(0, 3) & (code >= 50), 50).otherwise(48)
                radix = F.when(i.isin(0, 3), F.when(code >= 50, 8).otherwise(2)).otherwise(10)
            return F.when(base.isNull(), c).otherwise(F.chr((base + (code - base + keyed(key, r, i, other)) % radix).cast("int")))

        def shifted(part: Column, other: Column, first: bool) -> Column:
            return F.array_join(F.transform(characters(part), lambda c, i: place(c, i, other, first)), "")

        return F.when(even, F.concat(shifted(left, right, True), right)).otherwise(F.concat(left, shifted(right, left, False)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), value, one_round)


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def bare(value: Column) -> Column:
    """The letters and digits of a value."""
    return F.regexp_replace(value, "[^A-Za-z0-9]", "")


def woven(value: Column, plain: Column) -> Column:
    """``value`` with its letters and digits replaced in order by those of ``plain``; separators stay."""

    def step(a: Column, c: Column) -> Column:
        own = c.rlike("^[A-Za-z0-9]$")
        return F.struct(F.concat(a["out"], F.when(own, F.substring(plain, a["i"], F.lit(1))).otherwise(c)).alias("out"), F.when(own, a["i"] + 1).otherwise(a["i"]).alias("i"))

    return F.aggregate(characters(value), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), step, lambda a: a["out"])


def with_case(value: Column, small: Column) -> Column:
    """``small`` with capitals where ``value`` has them."""
    return F.array_join(F.zip_with(characters(value), characters(small), lambda c, x: F.when(c.rlike("^[A-Z]$"), F.upper(x)).otherwise(x)), "")


def permute_number(n: Column, left: int, right: int, key: str) -> Column:
    """A Feistel permutation of 0 .. left * right - 1: the two mixed-radix halves in turn get a keyed hash of the other."""

    def one_round(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(
            F.when(even, (s["l"] + keyed(key, r, s["r"])) % left).otherwise(s["l"]).cast("long").alias("l"),
            F.when(even, s["r"]).otherwise((s["r"] + keyed(key, r, s["l"])) % right).cast("long").alias("r"),
        )

    start = F.struct(F.floor(n / right).cast("long").alias("l"), (n % right).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one_round, lambda s: s["l"] * right + s["r"])


def permute_day(day: Column, key: str) -> Column:
    """Cycle walking: a result past the last day is permuted again. 121 of 73,170 values are past it, so 12 steps end the
    walk but for a chance of 1e-33; a value that had not ended stays in the calendar by leaving the day as it was."""
    n = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(12)), permute_number(n, LEFT, RIGHT, key), lambda x, _: F.when(x < DAYS, x).otherwise(permute_number(x, LEFT, RIGHT, key)))
    return F.date_add(F.lit(FIRST_DAY).cast("date"), F.when(walked < DAYS, walked).otherwise(n).cast("int"))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits whose last one is the check digit."""
    doubled = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + (c.cast("int") * 2) % 10))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def pseudonym_card(value: Column, key: str) -> Column:
    """The digits before the check digit are permuted, whatever stands between them, and a right check digit is put
    behind them."""

    def with_check(body: Column) -> Column:
        return woven(value, F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")))

    return let(bare(value), lambda v: let(permute_characters(F.substring(v, F.lit(1), F.length(v) - 1), key), with_check))


def iban_rest(iban: Column) -> Column:
    """The number of an IBAN (country and check digits moved behind, letters as 10 to 35) modulo 97, by its characters."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    value = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.when(value(c) > 9, a * 100 + value(c)).otherwise(a * 10 + value(c)) % 97)


def pseudonym_iban(value: Column, key: str) -> Column:
    def with_check(body: Column) -> Column:
        country = F.substring(value, 1, 2)
        return woven(value, F.concat(country, F.lpad((98 - iban_rest(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0"), body))

    return let(bare(value), lambda v: let(permute_characters(F.substring(v, F.lit(5), F.length(v)), key), with_check))


def pseudonym_ssn(value: Column, key: str) -> Column:
    """A permutation of the valid numbers: areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""

    def of(v: Column) -> Column:
        area, group, serial = (F.substring(v, a, n).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
        place = F.when(area < 666, area - 1).otherwise(area - 2)
        return let(permute_number((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key), back)

    def back(n: Column) -> Column:
        place = F.floor(n / (99 * 9999))
        parts = (F.when(place < 665, place + 1).otherwise(place + 2), F.floor(n / 9999) % 99 + 1, n % 9999 + 1)
        return woven(value, F.concat(*[F.lpad(x.cast("long").cast("string"), w, "0") for x, w in zip(parts, (3, 2, 4), strict=True)]))

    return let(bare(value), of)


def pseudonym_phone(value: Column, key: str) -> Column:
    """The digits behind the country code are permuted. Ten of them behind 1, or without a code, keep the classes of area
    codes and exchanges, so a number is linked with and without the 1."""

    def of(v: Column) -> Column:
        code = F.when(value.startswith("+"), F.regexp_extract(v, COUNTRY, 0)).otherwise(F.lit(""))
        return let(F.struct(code.alias("code"), F.substring(v, F.length(code) + 1, F.length(v)).alias("rest")), numbered)

    def numbered(n: Column) -> Column:
        american = n["code"].isin("", "1") & (F.length(n["rest"]) == 10)
        return let(F.concat(n["code"], F.when(american, permute_characters(n["rest"], f"{key}|tel", True)).otherwise(permute_characters(n["rest"], f"{key}|tel"))), lambda p: woven(value, p))

    return let(bare(value), of)


def pseudonym_email(value: Column, key: str) -> Column:
    """Addresses that differ in case alone are linked; the last label stays."""
    end = F.length(value) - F.length(F.regexp_extract(value, r"\.[A-Za-z]+$", 0))
    body = F.substring(value, F.lit(1), end)
    return F.concat(let(permute_characters(F.lower(body), key), lambda p: with_case(body, p)), F.substring(value, end + 1, F.length(value)))


def pseudonym_ip(value: Column, key: str) -> Column:
    number = F.aggregate(F.split(value, r"\."), F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    return let(permute_number(number, 65536, 65536, key), lambda n: F.concat_ws(".", *[(F.floor(n / 256**k) % 256).cast("string") for k in (3, 2, 1, 0)]))


def kind_of(value: Column) -> Column:
    """The kind of a match, null if its check digits or its calendar refute it."""

    def whole(pattern: str) -> str:
        # look-around of the pattern saw the text; here the value stands alone
        return "^(?:" + pattern.replace(r"(?<=(?:password|token|secret|api_key) ?[=:] ?[\"']?)", "") + ")$"

    calendar = {"iso_date": "yyyy-MM-dd", "day_first": "dd.MM.yyyy", "month_first": "MM/dd/yyyy"}
    out = F.lit(None).cast("string")
    # alone, without the word before it, a secret looks like other kinds, so it is tried last
    for kind, pattern in sorted(PATTERNS, key=lambda p: p[0] == "secret")[::-1]:
        fits = value.rlike(whole(pattern))
        if kind == "card":
            fits = fits & (luhn_sum(F.regexp_replace(value, "[^0-9]", "")) % 10 == 0)
        elif kind == "iban":
            fits = fits & (iban_rest(F.regexp_replace(value, " ", "")) == 1)
        elif kind == "secret":
            # what looks like an account number is one or is none
            fits = fits & ~value.rlike(whole(dict(PATTERNS)["iban"]))
        elif kind in calendar:
            fits = fits & F.try_to_date(value, calendar[kind]).isNotNull()
        out = F.when(fits, kind).otherwise(out)
    return out


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a validated value; a value without a kind stays as it is."""
    day = lambda form, k: F.date_format(permute_day(F.try_to_date(value, form), f"{key}|day"), form)  # noqa: E731,ARG005
    after = lambda n: F.concat(F.substring(value, 1, n), permute_characters(F.substring(value, F.lit(n + 1), F.length(value)), key))
    return (
        F.when(kind == "email", pseudonym_email(value, key))
        .when(kind == "aws_key", after(4))
        .when(kind == "secret", after(0))
        .when(kind == "iban", pseudonym_iban(value, key))
        .when(kind == "ip", pseudonym_ip(value, key))
        .when(kind == "iso_date", day("yyyy-MM-dd", 0))
        .when(kind == "day_first", day("dd.MM.yyyy", 1))
        .when(kind == "month_first", day("MM/dd/yyyy", 2))
        .when(kind == "phone", pseudonym_phone(value, key))
        .when(kind == "us_phone", pseudonym_phone(value, key))
        .when(kind == "ssn", pseudonym_ssn(value, key))
        .when(kind == "card", pseudonym_card(value, key))
        .otherwise(value)
    )


def cards_within(value: Column, key: str) -> Column:
    """struct<value, kinds>: a run of groups of letters and digits with the cards among its groups replaced.

    Candidates begin and end where groups do, have 13 to 19 digits and a right check digit. The longest is taken first, of
    equal ones the leftmost, and then those that share no group with one taken."""

    def of(chars: Column) -> Column:
        between = lambda i: F.coalesce(F.get(chars, i).isin(" ", "-"), F.lit(True))
        places = F.sequence(F.lit(0), F.size(chars) - 1)
        starts, ends = F.filter(places, lambda i: between(i - 1)), F.filter(places, lambda i: between(i + 1))
        return let(F.struct(starts.alias("starts"), ends.alias("ends")), lambda g: let(taken(chars, g["starts"], g["ends"]), lambda w: rebuilt(chars, w)))

    def cut(chars: Column, start: Column, end: Column) -> Column:
        """The characters from start up to end, without end."""
        return F.array_join(F.slice(chars, start + 1, end - start), "")

    def taken(chars: Column, starts: Column, ends: Column) -> Column:
        def window(a: Column, b: Column) -> Column:
            first, last = F.get(starts, a), F.get(ends, b)
            return F.struct((last - first + 1 - (b - a)).alias("n"), first.alias("start"), (last + 1).alias("end"))

        last = F.size(starts) - 1
        some = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda a: F.filter(F.transform(F.sequence(a, F.least(a + 18, last)), lambda b: window(a, b)), lambda w: w["n"].between(13, 19))))
        right = F.filter(some, lambda w: let(cut(chars, w["start"], w["end"]), lambda t: t.rlike("^[0-9 -]+$") & (luhn_sum(F.regexp_replace(t, "[^0-9]", "")) % 10 == 0)))
        ranked = F.array_sort(F.transform(right, lambda w: F.struct((-w["n"]).alias("n"), w["start"].alias("start"), w["end"].alias("end"))))
        none = F.array().cast("array<struct<n:int,start:int,end:int>>")
        apart = F.aggregate(ranked, none, lambda found, w: F.when(F.exists(found, lambda x: (x["start"] < w["end"]) & (w["start"] < x["end"])), found).otherwise(F.concat(found, F.array(w))))
        return F.array_sort(F.transform(apart, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"))))

    def rebuilt(chars: Column, w: Column) -> Column:
        before = lambda i: F.coalesce(F.get(w, i - 1)["end"], F.lit(0))
        parts = F.transform(w, lambda x, i: F.concat(cut(chars, before(i), x["start"]), pseudonym_card(cut(chars, x["start"], x["end"]), key)))
        text = F.concat(F.array_join(parts, ""), cut(chars, before(F.size(w)), F.size(chars)))
        return F.struct(text.alias("value"), F.transform(w, lambda _: F.lit("card")).alias("kinds"))

    return let(F.filter(F.split(value, ""), lambda c: c != ""), of)


#: The setting that holds the key of the permutations. Whoever has the key can undo them, so it is in no code.
KEY_SETTING = "spark.tramline.pseudonyms.key"


def session_key(spark: SparkSession) -> str:
    """The session's key. Where none is set, one is drawn for this session: pseudonyms agree within it and nobody can undo
    them, but a later session does not link to them."""
    found = spark.conf.get(KEY_SETTING, None)
    if not found:
        found = secrets.token_hex(16)
        spark.conf.set(KEY_SETTING, found)
    return found


def pseudonymise(docs: DataFrame, text: str = "text", key: str | None = None, found: str | None = "pii_found") -> DataFrame:
    """``docs`` with each personal value in ``text`` replaced by its pseudonym, and the kinds found (``found``: an
    array<string>, one entry a value, in order of text; None leaves it out).

    The text is cut at the matches of one pattern; pieces and pseudonyms are joined again, so the rest of the text is
    kept as it is. Matches that fail their check (Luhn, modulo 97, calendar) stay, but for the cards among the groups of a
    run of digits or of what is no account number (``cards_within``). A null text stays null with no kinds;
    an empty one stays empty. Rows, also equal ones, and all other columns stay as they are. Without a ``key`` it is the
    session's (``session_key``); who has it can undo the permutation."""
    t = F.col(text)
    key = session_key(docs.sparkSession) if key is None else key
    if found and found in docs.columns:
        raise ValueError(f"column {found} exists")

    def one(value: Column) -> Column:
        whole = lambda k: F.struct(pseudonym(value, k, key).alias("value"), F.array(k).alias("kinds"))
        stays = F.struct(value.alias("value"), F.array().cast("array<string>").alias("kinds"))
        return let(kind_of(value), lambda k: F.when(k.isNotNull(), whole(k)).when(value.rlike("^[0-9A-Z]++[ -][0-9A-Z -]*+$"), cards_within(value, key)).otherwise(stays))

    # only a text with a digit next to something can hold a match; the others skip the long pattern
    may = t.rlike(r"[0-9@]|AKIA|password|token|secret|api_key")
    values = F.when(may, F.transform(F.regexp_extract_all(t, F.lit(ANY), F.lit(0)), one)).otherwise(F.array().cast("array<struct<value:string,kinds:array<string>>>"))

    def joined(v: Column) -> Column:
        cut = F.split(t, ANY, -1)
        return F.when(F.size(v) > 0, F.array_join(F.zip_with(cut, v, lambda piece, x: F.concat(piece, F.coalesce(x["value"], F.lit("")))), "")).otherwise(t)

    name = fresh(docs, "_both")
    both = let(values, lambda v: F.struct(joined(v).alias("text"), F.flatten(v["kinds"]).alias("kinds")))
    out = docs.withColumn(name, both)
    names = [F.col(name)["text"].alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*names, *([F.coalesce(F.col(name)["kinds"], F.array().cast("array<string>")).alias(found)] if found else []))


def count_kinds(found: Column) -> list[Column]:
    """A count column for each kind."""
    return [F.size(F.filter(found, _equals(kind))).cast("long").alias(f"n_{kind}") for kind, _ in PATTERNS]


def _equals(kind: str):
    # a function of one parameter: of two, the second would be the place in the array
    return lambda k: k == kind
