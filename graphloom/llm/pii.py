"""Format-preserving pseudonyms by keyed Feistel permutations, in SQL functions alone.

Found values: e-mail addresses, quoted secrets behind a naming word, dates, IPv4 addresses, card and account
numbers (13 to 19 digits, blanks or hyphens between), telephone numbers, and IBANs. A value that its format
validates keeps it:

* dates (year-month-day, or day and month before the year, 1800 to 2199): permuted among the dates of these 400 years whose month and day are written with as many digits;
* IPv4 addresses, each part at most 255: permuted within 32 bits;
* card numbers with a right Luhn digit: all other digits are permuted and the Luhn digit is set; other long numbers: likewise, with a last digit that is
  wrong again, so that no number becomes a card's;
* telephone numbers: all digits behind a leading country code, the punctuation stays;
* IBANs: the digits behind the check digits are permuted and the check digits are set anew;
* e-mail addresses and secrets: a keyed digest of the lower-cased value, of the secret's length, as their alphabet has no fixed size.

A permutation is a bijection under one key, so equal values stay linked across documents and different ones stay apart
(digests: but for collisions of 64 bits or more). Numbers that no format validates (a date such as 31.02.2020) stay.

Defined cases: a null text stays null with no finds, an empty text stays empty; repeated rows, with or without an id, get equal results; of values that
overlap the first in the text is taken, of those that start together the first kind in the order above; other columns stay, whatever their names; columns named as
the results are replaced; an empty table gives no rows; texts of any length are searched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Of any length; the possessive loops need no stack.
EMAIL = r"(?<![._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
SECRET = r"(?<=[\"'])(?<=(?:token|secret|passwd|password|api_key|apikey|access_key) {0,2}[=:] {0,2}[\"'])[A-Za-z0-9/+_.-]{8,}+(?=[\"'])|AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
IBAN = r"[A-Z]{2}\d{2}(?: ?\d{4}){2,7}(?: ?\d{1,3})?(?![A-Za-z0-9])"
DATE = r"(?<![\w.])(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})(?!\w)"
IP = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"
NUMBER = r"(?<!\w)\d(?:[ -]?\d){12,18}(?!\w)"
PHONE = r"(?<!\w)(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<!\w)\+\d{8,15}(?!\w)"
#: Every value starts where no letter or digit stands before it, so most places fail at the first test.
ANY = "(?<![A-Za-z0-9])(?:" + "|".join((EMAIL, SECRET, IBAN, f"(?=[0-9+(])(?:{DATE}|{IP}|{NUMBER}|{PHONE})")) + ")"
#: Without one of these a text holds none of the above; these tests are cheap.
SOME_DIGITS = r"\d\D{0,3}\d\D{0,3}\d"
NAMING = r"(?:token|secret|passwd|password|api_?key|access_key) {0,2}[=:]"


def may_hold(text: Column) -> Column:
    quoted = (F.contains(text, F.lit('"')) | F.contains(text, F.lit("'"))) & F.rlike(text, F.lit(NAMING))
    return F.contains(text, F.lit("@")) | F.rlike(text, F.lit(SOME_DIGITS)) | F.contains(text, F.lit("AKIA")) | quoted


ALL_DAYS = 146097
FIRST_DAY = "1800-01-01"


def _prf(key: str, tweak: str, i: Column, half: Column) -> Column:
    """60 bits of a keyed hash of round and half, as a non-negative long."""
    text = F.concat(F.lit(key), F.lit("|" + tweak + "|"), i.cast("string"), F.lit("|"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, tweak: str, a: Column, b: Column, n: Column, m: Column) -> Column:
    """Permutes pairs a < n, b < m (longs): each round adds a keyed hash of one half to the other. Returns struct(a, b)."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, (s["a"] + _prf(key, tweak, i, s["b"]) % n) % n).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise((s["b"] + _prf(key, tweak, i, s["a"]) % m) % m).alias("b"),
        )

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, turn)


def _let(value: Column, use) -> Column:
    """``use`` of one evaluated value, so that larger expressions do not copy its expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def permute_digits(key: str, tweak: str, digits: Column) -> Column:
    """Permutes a string of 2 to 36 digits among those of its length."""

    def of(d: Column) -> Column:
        left, right = F.floor(F.length(d) / 2).cast("int"), F.ceil(F.length(d) / 2).cast("int")
        n, m = F.pow(F.lit(10.0), left).cast("long"), F.pow(F.lit(10.0), right).cast("long")
        mixed = F.concat(F.lit(f"{tweak}|"), F.length(d).cast("string"))
        start = F.struct(F.substr(d, F.lit(1), left).cast("long").alias("a"), F.substr(d, left + 1, right).cast("long").alias("b"))

        def turn(s: Column, i: Column) -> Column:
            even = i % 2 == 0
            h = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), mixed, i.cast("string"), F.when(even, s["b"]).otherwise(s["a"]).cast("string")).cast("binary"), 256), 1, 14), 16, 10).cast("long")
            return F.struct(F.when(even, (s["a"] + h % n) % n).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise((s["b"] + h % m) % m).alias("b"))

        done = F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, turn)
        return _let(done, lambda s: F.concat(F.lpad(s["a"].cast("string"), left, "0"), F.lpad(s["b"].cast("string"), right, "0")))

    return _let(digits, of)


def refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + is_digit.cast("int")).alias("at"))

    return F.aggregate(F.split(shape, ""), start, put, lambda s: s["out"])


def luhn_digit(body: Column) -> Column:
    """The check digit that makes body + digit pass the Luhn test."""

    def add(s: Column, i: Column) -> Column:
        twice = F.substr(body, F.length(body) - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return s + F.when(twice > 9, twice - 9).otherwise(twice)

    return ((10 - F.aggregate(F.sequence(F.lit(0), F.length(body) - 1), F.lit(0), add) % 10) % 10).cast("string")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _number(key: str, value: Column) -> Column:
    def of(d: Column) -> Column:
        body, last = F.substr(d, F.lit(1), F.length(d) - 1), F.substr(d, F.length(d), F.lit(1)).cast("int")
        off = (last - luhn_digit(body).cast("int") + 10) % 10  # 0 for a card
        start = F.struct(permute_digits(key, "card", body).alias("p"), off.alias("off"))

        def close(s: Column) -> Column:
            # Of the nine wrong last digits one becomes another, by a shift that the new body gives.
            turned = F.when(s["off"] == 0, 0).otherwise((s["off"] - 1 + _prf(key, "last", F.length(s["p"]), s["p"]) % 9) % 9 + 1)
            return F.concat(s["p"], ((luhn_digit(s["p"]).cast("int") + turned) % 10).cast("int").cast("string"))

        return refill(value, _let(start, close))

    return _let(_digits(value), of)


def _phone(key: str, value: Column) -> Column:
    head = F.regexp_extract(value, r"^(\+\d{1,3}(?=[ .(-])[ .-]?)", 1)
    return _let(F.struct(head.alias("h"), F.substr(value, F.length(head) + 1).alias("t")), lambda s: F.concat(s["h"], refill(s["t"], permute_digits(key, "phone", _digits(s["t"])))))


def _ip(key: str, value: Column) -> Column:
    part = F.split(value, r"\.")
    octet = [part[i].cast("int") for i in range(4)]
    valid = F.array_max(F.array(*octet)) <= 255
    done = feistel(key, "ip", octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], F.lit(65536), F.lit(65536))
    out = _let(done, lambda s: F.concat_ws(".", F.floor(s["a"] / 256).cast("string"), (s["a"] % 256).cast("string"), F.floor(s["b"] / 256).cast("string"), (s["b"] % 256).cast("string")))
    return F.when(valid, out).otherwise(value)


#: Dates of 400 years whose month, day or both are written with one digit: how many there are, and the sides of a square that holds them.
SHORT_MONTH, SHORT_DAY = 9, 9
#: Turns that every value is given room for, and the numbers below 400 x 279 that are no day: no walk from a day is longer than these and one.
STEPS, NO_DAYS = 6, 2303


def _first_that(fits, start: Column, turn) -> Column:
    """``turn`` applied to a long that fits until the result fits: a permutation of a larger set is one of the fitting part. Walks beyond STEPS go on to their end."""

    def again(s: Column, _: Column) -> Column:
        new = turn(s["v"])
        return _let(new, lambda n: F.struct(F.when(s["done"], s["v"]).otherwise(n).alias("v"), (s["done"] | fits(n)).alias("done")))

    begin = F.struct(start.cast("long").alias("v"), F.lit(False).alias("done"))
    some = F.aggregate(F.array(*[F.lit(i) for i in range(STEPS)]), begin, again)
    rest = lambda s: F.aggregate(F.sequence(F.lit(STEPS), F.lit(NO_DAYS)), s, again, lambda t: t["v"])
    return _let(some, lambda s: F.when(s["done"], s["v"]).otherwise(rest(s)))


def _date(key: str, value: Column) -> Column:
    """The order of the parts, their separators and the digits of each part stay."""
    part = F.split(value, r"[-/.]")
    first = F.lit(FIRST_DAY).cast("date")

    def mixed(tweak: str, number: Column, n: int, m: int) -> Column:
        """A number below n x m permuted among those."""
        return _let(feistel(key, tweak, F.floor(number / m), number % m, F.lit(n), F.lit(m)), lambda s: s["a"] * m + s["b"])

    def of(p: Column) -> Column:
        year_first = F.length(p[0]) == 4
        # Of day and month ahead of the year, a first part over 12 is a day; otherwise the month stands last, as in most of the world, unless the second is over 12.
        month_first = ~year_first & (p[1].cast("int") > 12)
        y, m, d = F.when(year_first, p[0]).otherwise(p[2]), F.when(year_first | ~month_first, p[1]).otherwise(p[0]), F.when(year_first, p[2]).when(month_first, p[1]).otherwise(p[0])
        # to_date of a wrong day is null, not an error, under try_to_timestamp.
        day = F.to_date(F.try_to_timestamp(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")))
        number = F.datediff(day, first)
        year, month, dom = F.year(day) - 1800, F.month(day), F.dayofmonth(day)
        from_parts = lambda a, b, c: F.make_date((a + 1800).cast("int"), b.cast("int"), c.cast("int"))
        # 146097 = 189 x 773, so that one Feistel of mixed radix permutes the days exactly.
        full = F.date_add(first, mixed("date", number, 189, 773).cast("int"))
        # 400 x 12 months x 9 days = 180 x 240; 400 x 9 x 9 = 180 x 180.
        short_day = _let(mixed("day", (year * 12 + month - 1) * SHORT_DAY + dom - 1, 180, 240), lambda v: from_parts(F.floor(v / 108), F.floor(v / 9) % 12 + 1, v % 9 + 1))
        short = _let(mixed("both", (year * SHORT_MONTH + month - 1) * SHORT_DAY + dom - 1, 180, 180), lambda v: from_parts(F.floor(v / 81), F.floor(v / 9) % 9 + 1, v % 9 + 1))
        # The days of nine months of 31 days, 400 x 279 = 360 x 310; turned on until there is such a day.
        real = lambda v: F.try_to_date(F.format_string("%04d-%02d-%02d", (F.floor(v / 279) + 1800).cast("int"), (F.floor(v / 31) % 9 + 1).cast("int"), (v % 31 + 1).cast("int")), "yyyy-MM-dd")
        walked = _first_that(lambda v: real(v).isNotNull(), year * 279 + (month - 1) * 31 + dom - 1, lambda v: mixed("month", v, 360, 310))
        new = F.when((F.length(m) == 2) & (F.length(d) == 2), full).when(F.length(m) == 2, short_day).when(F.length(d) == 1, short).otherwise(real(walked))
        sep1, sep2 = F.regexp_extract(value, r"^\d+([-/.])", 1), F.regexp_extract(value, r"([-/.])\d+$", 1)

        def built(t: Column) -> Column:
            yy, mm, dd = F.date_format(t, "yyyy"), F.lpad(F.month(t).cast("string"), F.length(m), "0"), F.lpad(F.dayofmonth(t).cast("string"), F.length(d), "0")
            return F.when(year_first, F.concat(yy, sep1, mm, sep2, dd)).when(month_first, F.concat(mm, sep1, dd, sep2, yy)).otherwise(F.concat(dd, sep1, mm, sep2, yy))

        return F.when(number.between(0, ALL_DAYS - 1), _let(new, built)).otherwise(value)

    return _let(part, of)


def _iban(key: str, value: Column) -> Column:
    def of(raw: Column) -> Column:
        country = F.substr(raw, F.lit(1), F.lit(2))
        code = F.concat((F.ascii(raw) - 55).cast("string"), (F.ascii(F.substr(raw, F.lit(2), F.lit(1))) - 55).cast("string"))
        mod97 = lambda text: F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: (s * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97)
        body = F.substr(raw, F.lit(5))
        valid = mod97(F.concat(body, code, F.substr(raw, F.lit(3), F.lit(2)))) == 1
        new = _let(permute_digits(key, "iban", body), lambda p: F.concat(F.lpad((98 - mod97(F.concat(p, code, F.lit("00")))).cast("string"), 2, "0"), p))
        return F.when(valid, F.concat(country, refill(F.substr(value, F.lit(3)), new))).otherwise(refill(value, permute_digits(key, "number", _digits(value))))

    return _let(F.replace(value, F.lit(" "), F.lit("")), of)


def kind_of(value: Column) -> Column:
    whole = lambda p: F.rlike(value, F.lit(f"^(?:{p})$"))
    return (
        F.when(F.contains(value, F.lit("@")), "email").when(whole(r"[A-Z]{2}\d{2}[ \d]+"), "iban").when(whole(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}"), "date")
        .when(whole(r"\d{1,3}(?:\.\d{1,3}){3}"), "ip").when(whole(r"\d(?:[ -]?\d){12,18}"), "number").when(whole(r"\+?[\d ().-]+"), "phone").otherwise("secret")
    )


def pseudonym(value: Column, key: str) -> Column:
    digest = F.sha2(F.concat(F.lit(key + "|digest|"), F.lower(value)).cast("binary"), 256)
    kind = kind_of(value)
    return (
        F.when(kind == "email", F.concat(F.lit("u"), F.substring(digest, 1, 16), F.lit("@mail.invalid")))
        .when(kind == "iban", _iban(key, value)).when(kind == "date", _date(key, value)).when(kind == "ip", _ip(key, value)).when(kind == "number", _number(key, value)).when(kind == "phone", _phone(key, value))
        .otherwise(F.substr(F.repeat(digest, F.ceil(F.length(value) / 64).cast("int")), F.lit(1), F.length(value)))
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", out_col: str | None = None, count_col: str = "n_pii") -> DataFrame:
    """``docs`` with pseudonyms in ``out_col`` (the text itself by default) and the number of values replaced in ``count_col``."""
    out_col = out_col or text_col
    taken = {c.lower() for c in docs.columns} | {out_col.lower(), count_col.lower()}
    found_, new_, out_, n_ = (next(f"_{name}{k}" for k in range(len(taken) + 1) if f"_{name}{k}".lower() not in taken) for name in ("found", "new", "out", "n"))
    text = F.col(f"`{text_col}`")
    # Where a text holds no candidate the arrays are not built.
    has = may_hold(text)
    found = F.when(has, F.regexp_extract_all(text, F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))
    some = docs.withColumn(found_, found)
    new = F.transform(found_, lambda v: pseudonym(v, key))
    some = some.withColumn(new_, F.when(F.size(found_) > 0, new).otherwise(F.array().cast("array<string>")))
    parts = F.split(text, ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(parts, F.col(new_), lambda p, v: F.array(p, F.coalesce(v, F.lit(""))))), "")
    changed = F.size(F.filter(F.zip_with(found_, new_, lambda a, b: a != b), lambda x: x))
    some = some.withColumn(out_, F.when(F.size(found_) > 0, joined).otherwise(text)).withColumn(n_, F.when(text.isNotNull(), changed).otherwise(0).cast("long"))
    return some.drop(out_col, count_col, found_, new_).withColumnsRenamed({out_: out_col, n_: count_col})
