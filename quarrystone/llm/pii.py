"""Personal data replaced by format-preserving pseudonyms from keyed Feistel permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a deployment puts its key, and the key of tests, which is used where none is put there.
KEY_SETTING, KEY = "spark.quarrystone.pii.key", "quarrystone"
ROUNDS = 10
#: Dates from 1900-01-01 to 2099-12-31: 73,049 days, 17 times 4,297.
FIRST_DAY, DATE_SIDES = "1900-01-01", (17, 4297)

#: A local part has 64 characters at most, so a longer run is no address.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
DATE = r"(?<![0-9.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]|[.-][0-9])"
#: Parts from 0 to 255 without leading zeros: one spelling for each address.
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IP = rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?[0-9])"
#: International numbers in groups (three and four digits, pairs, or a long last group), then national ones of ten digits with an area code.
PHONE = "|".join((
    r"\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{3,4}){1,2}?[ .-]?[0-9]{4}(?![0-9])",
    r"\+[0-9]{1,3}[ .-]?[0-9](?:[ .-][0-9]{2}){4}(?![0-9])",
    r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,5}\)?[ .-]?[0-9]{4,8}(?![0-9])",
    r"(?<![0-9+])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    r"(?<![0-9.+-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9]|[.-][0-9])",
))
#: Country codes of one and two digits (E.164); all others have three.
CODE = "^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Runs of groups of four (GROUPS at most, a longer table is read in pieces), two formats of fewer digits, and solid numbers. A separate short number beside one is no part of it.
GROUPS = 64
CARD = "|".join((
    rf"(?<![0-9])[0-9]{{4}}(?:[ -][0-9]{{4}}(?![0-9])){{3,{GROUPS - 1}}}",
    r"(?<![0-9])[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}(?![0-9])",
    r"(?<![0-9])[0-9]{13,19}(?![0-9])",
))
#: kind: pattern, in the order in which they are tried at a place.
PATTERNS = {"email": EMAIL, "date": DATE, "ip": IP, "phone": PHONE, "ssn": SSN, "card": CARD}
#: All kinds but addresses of mail start with one of three kinds of character, which is tried once before them.
ANY = f"(?:{EMAIL})|(?=[0-9+(])(?:" + "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k != "email") + ")"
DATE_FORMATS = (("^[0-9]{4}-", "yyyy-MM-dd"), (r"^[0-9]{2}\.", "dd.MM.yyyy"), ("^[0-9]{2}/", "MM/dd/yyyy"))


def once(value: Column, use) -> Column:
    """use(value) with value computed once, however often use needs it."""
    return F.transform(F.array(value), use)[0]


def keyed(key: str, kind: str, round_: Column, other: Column) -> Column:
    """60 bits of a keyed hash of the round and the other half."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), other.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, sides: tuple[Column, Column], key: str, kind: str) -> Column:
    """Struct (l, r): a permutation of the pairs with l under sides[0] and r under sides[1]; in turn each half is shifted by a keyed hash of the other."""
    a, b = sides
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(x: Column, i: Column) -> Column:
        even = i % 2 == 0
        turn = keyed(key, kind, i, F.when(even, x["r"]).otherwise(x["l"]))
        return F.struct(F.when(even, (x["l"] + turn % a) % a).otherwise(x["l"]).alias("l"), F.when(even, x["r"]).otherwise((x["r"] + turn % b) % b).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def digits(value: Column, key: str, kind: str) -> Column:
    """A string of 2 to 36 digits, permuted among those of its length."""
    n = F.length(value)
    half = F.floor(n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    out = feistel(F.substr(value, F.lit(1), half), F.substr(value, half + 1, n - half), (power(half), power(n - half)), key, kind)
    return once(out, lambda x: F.concat(F.lpad(x["l"].cast("string"), half, F.lit("0")), F.lpad(x["r"].cast("string"), n - half, F.lit("0"))))


def put_digits(shape: Column, value: Column) -> Column:
    """shape with its digits replaced, in order, by those of value."""
    at = lambda i: F.length(F.regexp_replace(F.substr(shape, F.lit(1), i), "[^0-9]", ""))
    one = lambda i: F.substr(shape, i, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: F.when(one(i).rlike("[0-9]"), F.substr(value, at(i), F.lit(1))).otherwise(one(i))), "")


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column, check: bool) -> Column:
    """The sum of the digits of value, every second one doubled from the right: from the last but one if value ends with its check digit, else from the last."""
    n = F.length(value)

    def step(a: Column, i: Column) -> Column:
        d = F.substr(value, i, F.lit(1)).cast("int")
        double = (n - i) % 2 == (1 if check else 0)
        return a + F.when(double, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step)


def card(m: Column, key: str) -> Column:
    """A number with its digits but the last permuted and the check digit made valid again."""

    def made(value: Column) -> Column:
        body = digits(F.substr(value, F.lit(1), F.length(value) - 1), key, "card")
        return once(body, lambda b: F.concat(b, ((10 - luhn(b, False) % 10) % 10).cast("string")))

    return put_digits(m, once(only_digits(m), made))


def cards_at(m: Column) -> Column:
    """In a run of groups of four: the groups (from 0) at which a valid number of four groups starts, leftmost and not overlapping. At most GROUPS groups."""
    d = only_digits(m)

    def chosen(d: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.length(d) / 4).cast("int") - 4)), lambda j: luhn(F.substr(d, j * 4 + 1, F.lit(16)), True) % 10 == 0)
        none = F.array().cast("array<int>")
        last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(-4))
        return F.aggregate(starts, none, lambda a, j: F.when(j >= last(a) + 4, F.array_append(a, j)).otherwise(a))

    return once(d, chosen)


def cards(m: Column, key: str) -> Column:
    """A run of groups of four with its valid numbers replaced; a group has five characters with its separator."""

    def written(at: Column) -> Column:
        done = F.transform(at, lambda j: F.concat(card(F.substr(m, j * 5 + 1, F.lit(19)), key), F.substr(m, j * 5 + 20, F.lit(1))))
        # What stands between the numbers: from the end of one to the start of the next.
        ends = F.concat(F.array(F.lit(0)), F.transform(at, lambda j: j + 4))
        gaps = F.zip_with(ends, F.concat(at, F.array(F.lit(None).cast("int"))), lambda a, b: F.when(b.isNull(), F.substr(m, a * 5 + 1, F.length(m))).otherwise(F.substr(m, a * 5 + 1, (b - a) * 5)))
        return F.array_join(F.zip_with(gaps, done, lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")

    return once(cards_at(m), written)


def phone(m: Column, key: str) -> Column:
    """The country code stays; the other digits are permuted among those of their number, however they are grouped, so one number has one pseudonym in all spellings. A national number has ten digits and no code."""

    def made(d: Column) -> Column:
        code = F.when(~m.startswith("+"), 0).when(F.regexp_extract(d, CODE, 0) != "", F.length(F.regexp_extract(d, CODE, 0))).otherwise(3)
        return F.concat(F.substr(d, F.lit(1), code), digits(F.substr(d, code + 1, F.length(d) - code), key, "phone"))

    return put_digits(m, once(only_digits(m), made))


def ssn(m: Column, key: str) -> Column:
    """Another of the valid numbers: areas 001 to 899 but 666, groups from 01, serials from 0001."""
    part = lambda at, n: F.substr(m, F.lit(at), F.lit(n)).cast("long")
    area = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)
    out = feistel(area, (part(5, 2) - 1) * 9999 + part(8, 4) - 1, (F.lit(898), F.lit(99 * 9999)), key, "ssn")
    pad = lambda v, n: F.lpad(v.cast("long").cast("string"), n, "0")
    return once(out, lambda x: F.concat_ws("-", pad(x["l"] + F.when(x["l"] >= 665, 2).otherwise(1), 3), pad(F.floor(x["r"] / 9999) + 1, 2), pad(x["r"] % 9999 + 1, 4)))


def address(m: Column, key: str) -> Column:
    """Another of all IPv4 addresses."""

    def made(p: Column) -> Column:
        part = lambda i: F.get(p, i).cast("long")
        out = feistel(part(0) * 256 + part(1), part(2) * 256 + part(3), (F.lit(65536), F.lit(65536)), key, "ip")
        return once(out, lambda x: F.concat_ws(".", *(v.cast("long").cast("string") for v in (F.floor(x["l"] / 256), x["l"] % 256, F.floor(x["r"] / 256), x["r"] % 256))))

    return once(F.split(m, r"\."), made)


def day(m: Column) -> Column:
    out = F.lit(None).cast("date")
    for start, form in DATE_FORMATS:
        out = F.when(m.rlike(start), F.try_to_date(m, form)).otherwise(out)
    return out


def date(m: Column, key: str) -> Column:
    """Another day of the same two centuries, written alike."""
    a, b = DATE_SIDES

    def made(n: Column) -> Column:
        out = feistel(F.floor(n / b), n % b, (F.lit(a), F.lit(b)), key, "date")
        return once(F.date_add(F.lit(FIRST_DAY).cast("date"), once(out, lambda x: (x["l"] * b + x["r"]).cast("int"))), written)

    def written(d: Column) -> Column:
        out = d.cast("string")
        for start, form in DATE_FORMATS:
            out = F.when(m.rlike(start), F.date_format(d, form)).otherwise(out)
        return out

    return once(F.datediff(day(m), F.lit(FIRST_DAY).cast("date")), made)


def shifted(half: Column, hash_: Column) -> Column:
    """Each letter or digit shifted within its class by a byte of the hash."""

    def one(c: Column, i: Column) -> Column:
        turn = F.conv(F.substr(hash_, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        code = F.ascii(c)
        base = F.when(code >= 97, 97).when(code >= 65, 65).otherwise(48)
        return F.char(base + (code - base + turn) % F.when(base == 48, 10).otherwise(26))

    return F.array_join(F.transform(F.regexp_extract_all(half, F.lit("."), F.lit(0)), one), "")


def name(value: Column, key: str) -> Column:
    """A string of letters and digits, permuted among those with the same classes of characters; halves are shifted in turn as in feistel()."""
    half = F.ceil(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), half).alias("l"), F.substr(value, half + 1, F.length(value) - half).alias("r"))

    def step(x: Column, i: Column) -> Column:
        even = i % 2 == 0
        own = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), F.when(even, x["r"]).otherwise(x["l"])), 256)
        return F.struct(F.when(even, shifted(x["l"], own)).otherwise(x["l"]).alias("l"), F.when(even, x["r"]).otherwise(shifted(x["r"], own)).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda x: F.concat(x["l"], x["r"]))


def email(m: Column, key: str) -> Column:
    """The local part's letters and digits are permuted; its other characters and the domain stay."""
    local, rest = F.substring_index(m, "@", 1), F.concat(F.lit("@"), F.substring_index(m, "@", -1))
    plain = lambda x: F.regexp_replace(x, "[^A-Za-z0-9]", "")

    def put(value: Column) -> Column:
        one = lambda i: F.substr(local, i, F.lit(1))
        at = lambda i: F.length(plain(F.substr(local, F.lit(1), i)))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(local)), lambda i: F.when(one(i).rlike("[A-Za-z0-9]"), F.substr(value, at(i), F.lit(1))).otherwise(one(i))), "")

    return F.concat(once(name(plain(local), key), put), rest)


GROUPED = "^[0-9]{4}[ -][0-9]{4}[ -]"


def kind_of(m: Column) -> Column:
    """The kind of a match that is valid, else null: a card needs its check digit (a run of groups of four, one number with it),
    a date a day of the two centuries, a phone 8 to 15 digits (ten without a country code), an SSN an area, group and serial that exist."""
    full = lambda k: m.rlike(f"^(?:{PATTERNS[k]})$")
    low, high = F.lit(FIRST_DAY).cast("date"), F.lit("2099-12-31").cast("date")
    return (
        F.when(m.contains("@"), "email")
        .when(full("date"), F.when(day(m).between(low, high), "date"))
        .when(full("ip"), "ip")
        .when(m.startswith("+"), F.when(F.length(only_digits(m)).between(8, 15), "phone"))
        .when(full("phone"), "phone")
        .when(full("ssn"), F.when(m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), "ssn"))
        .when(m.rlike(GROUPED), F.when(F.size(cards_at(m)) > 0, "card"))
        .otherwise(once(only_digits(m), lambda d: F.when(luhn(d, True) % 10 == 0, "card")))
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    return (
        F.when(kind == "email", email(m, key))
        .when(kind == "date", date(m, key))
        .when(kind == "ip", address(m, key))
        .when(kind == "phone", phone(m, key))
        .when(kind == "ssn", ssn(m, key))
        .when(kind == "card", F.when(m.rlike(GROUPED), cards(m, key)).otherwise(card(m, key)))
        .otherwise(m)
    )


def pseudonymized(docs: DataFrame, key: str | None = None) -> DataFrame:
    """One row for each document: doc_id, text with its personal data replaced, n_email, n_date, n_ip, n_phone, n_ssn, n_card.

    Equal values get equal pseudonyms in every document; each kind's permutation has one pseudonym for each value, and the
    format stays. Numbers that aren't valid are left. A null text stays null, an empty one empty; repeated rows come back
    repeated and alike; an empty table gives no rows. Matches are bounded, so a text takes time in proportion to its length.
    The key is the argument, or what the session has at KEY_SETTING. A run with several cards counts as one match.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.when(text.rlike(ANY), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).alias("found"))
    rows = rows.select("doc_id", "text", F.transform("found", lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind"))).alias("found"))
    rows = rows.select("doc_id", "text", F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), pseudonym(x["m"], x["kind"], key).alias("new"))).alias("found"), F.when(F.col("found").isNotNull(), F.split("text", ANY, -1)).alias("between"))
    merged = F.array_join(F.zip_with("between", F.col("found.new"), lambda b, new: F.concat(b, F.coalesce(new, F.lit("")))), "")
    count = lambda k: F.coalesce(F.size(F.filter("found", lambda x: x["kind"] == k)), F.lit(0)).cast("long")
    return rows.select("doc_id", F.when(F.col("found").isNull(), F.col("text")).otherwise(merged).alias("text"), *(F.greatest(count(k), F.lit(0)).alias(f"n_{k}") for k in PATTERNS))
