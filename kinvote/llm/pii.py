"""Format-preserving Feistel pseudonyms for numbers and dates, as SQL functions only.

Found and validated: card numbers (13 to 19 digits, in groups or not, with a right Luhn check
digit; if all of a match has none, the card in it that is ungrouped or in groups of 4-4-4-4, 4-6-5
or 4-6-4 digits, so that a code, an expiry date or a count beside it does no harm), telephone numbers in
the North American form, social security numbers (three, two and four digits, of ranges in use), IBANs
written without blanks (check digits by mod 97), IPv4 addresses (octets up to 255, without leading
zeros), dates that exist (year-month-day, day.month.year, month/day/year, and day/month/year where
that is no month/day/year), and e-mail addresses. Each is replaced by another of its format under a keyed permutation, so equal values get equal
pseudonyms in all documents, different values different ones, and the key's owner can undo it:

* characters: a Feistel network over the two halves of the letters and digits; in a round each
  character of one half moves by a hash of (key, round, place, other half) among the characters
  of its kind (digits, small or capital letters). Telephone numbers keep the country code,
  e-mail addresses their domain's last part; cards permute all but the check digit, which is
  then made right again; a card beside other numbers is walked until the whole match has a
  wrong check digit again, so that undoing finds the same card; IBANs keep the country, and their
  check digits are made right again; social security numbers are walked until their range is in use;
* numbers in a range: the same with two halves of a number. Addresses are numbers below 2**32;
  dates are days from 1900-01-01 to 2099-12-31, walked until the permuted number is a day of
  that range again that can be written in the same shape: a day or month of one digit stays one
  of one digit, and a day first before a slash stays above 12. So 1.2.1999 and 01.02.1999 are
  different values.

Edge cases: a null text stays null, an empty one empty; values that fail their check, or are
part of a longer word or number, stay; a text without a value stays as it is; repeated rows
are changed alike; an empty table gives an empty result; all other columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinvote.llm.common import free_names

ROUNDS = 8
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9][A-Za-z0-9.\-]*\.[A-Za-z]{2,}"
IPV4 = r"\d{1,3}(?:\.\d{1,3}){3}"
DATE = r"\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}"
PHONE = r"(?:\+1[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[ .\-]\d{4}"
SSN = r"\d{3}-\d{2}-\d{4}"
SSN_USED = r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$"
IBAN = r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}"
CARD = r"\d(?:[ \-]?\d){12,18}"
USUAL = r"\d{13,19}|\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{4,5}"
INNER = rf"^(.*?)(?<!\d)({USUAL})(?!\d)(.*)$"
NO_DATE = r"(?!(?<=[ \-]\d{1,2})/\d{1,2}/\d{4})"
BEFORE, AFTER = r"(?<![\p{L}\p{N}_.@+\-])", r"(?![\p{L}\p{N}_@]|[.\-]\p{N})"
VALUE = f"{EMAIL}|{BEFORE}(?:{IPV4}|{DATE}|{PHONE}|{SSN}|{IBAN}|{CARD}{NO_DATE}){AFTER}"
KINDS = ("email", "ipv4", "date", "phone", "card", "ssn", "iban")

FIRST_DAY, DAYS = "1900-01-01", 73049
_DATE_SIDE = 271  # 271 * 271 is the smallest square not below DAYS
_WALK = 64  # a step stays outside the range once in 600; 64 steps in a row do once in 10**177
_LONG_WALK = 384  # a fifth of all days has the rarest shape; so many steps miss it once in 10**41


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: inside a lambda Spark computes each mention anew."""
    return F.transform(F.array(value), use)[0]


def _hash(key: str, number: Column, *parts: Column) -> Column:
    """A number below 2**48 of the key, the round and the parts."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), number.cast("string"), *parts), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")


def _moved(char: Column, by: Column) -> Column:
    """A character moved by so many places among those of its kind."""
    code, out = F.ascii(char), char
    for low, size in ((48, 10), (65, 26), (97, 26)):
        inside = (code >= low) & (code < low + size)
        out = F.when(inside, F.char(F.pmod(code - low + by, F.lit(size)) + low)).otherwise(out)
    return out


def feistel_text(text: Column, key: str, undo: bool = False) -> Column:
    """Permute letters and digits of a text among texts with the same kinds at the same places."""

    def one(state: Column, step: Column) -> Column:
        number = F.lit(ROUNDS - 1) - step if undo else step
        sign = F.lit(-1 if undo else 1)
        even = F.pmod(number, F.lit(2)) == 0
        half = (F.length(state) / 2).cast("int")
        left, right = F.substring(state, F.lit(1), half), F.substring(state, half + 1, F.length(state))
        target, other = F.when(even, left).otherwise(right), F.when(even, right).otherwise(left)
        chars = F.split(target, "")
        new = F.array_join(
            F.transform(
                chars, lambda c, i: _moved(c, sign * F.pmod(_hash(key, number, i.cast("string"), other), F.lit(260)))
            ),
            "",
        )
        new = F.when(F.length(target) == 0, target).otherwise(new)
        return F.when(even, F.concat(new, right)).otherwise(F.concat(left, new))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), text, one)


def feistel_number(value: Column, side: int, key: str, undo: bool = False) -> Column:
    """Permute the numbers below ``side * side``."""

    def one(state: Column, step: Column) -> Column:
        number = F.lit(ROUNDS - 1) - step if undo else step
        high, low = F.floor(state / side), F.pmod(state, F.lit(side))
        if undo:
            return F.pmod(low - _hash(key, number, high.cast("string")), F.lit(side)) * side + high
        return low * side + F.pmod(high + _hash(key, number, low.cast("string")), F.lit(side))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), value.cast("bigint"), one)


def _in_range(
    value: Column, key: str, undo: bool, days: tuple[Column, Column] | None = None, months: Column | None = None
) -> Column:
    """Cycle walking: permute until the number is below DAYS; one step at least.

    ``days``: the least and the largest day of the month that is taken; ``months``: the largest month.
    """
    least, most = days or (F.lit(1), F.lit(31))
    months = F.lit(12) if months is None else months
    start = F.struct(
        value.cast("bigint").alias("v"), F.lit(False).alias("done"), least.alias("low"), most.alias("high"), months.alias("months")
    )

    def one(state: Column, _: Column) -> Column:
        def stepped(new: Column) -> Column:
            held = [state[name].alias(name) for name in ("low", "high", "months")]
            return F.struct(new.alias("v"), _written(new, state).alias("done"), *held)

        return F.when(state["done"], state).otherwise(
            _bound(feistel_number(state["v"], _DATE_SIDE, key, undo), stepped)
        )

    steps = F.when((least > 1) | (most < 31) | (months < 12), _LONG_WALK).otherwise(_WALK)
    return F.aggregate(F.sequence(F.lit(1), steps), start, one, lambda s: s["v"])


def _written(number: Column, state: Column) -> Column:
    """Whether a number is a day of the range and within the state's days and months."""
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), number.cast("int"))
    inside = F.dayofmonth(day).between(state["low"], state["high"]) & (F.month(day) <= state["months"])
    return (number < DAYS) & inside


def _luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """The Luhn sum of a text of digits; whether the last digit counts double."""
    parity = F.pmod(F.length(digits) + (1 if doubled_last else 0), F.lit(2))

    def worth(c: Column, i: Column) -> Column:
        digit = c.try_cast("int")
        twice = digit * 2
        return F.when(F.pmod(i, F.lit(2)) == parity, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    return F.aggregate(F.transform(F.split(digits, ""), worth), F.lit(0), lambda a, b: a + b)


def _passes(value: Column) -> Column:
    """Whether the digits of a value end with a right Luhn digit."""
    return F.pmod(_luhn_sum(F.regexp_replace(value, r"[^0-9]", ""), False), F.lit(10)) == 0


def _filled(shape: Column, digits: Column) -> Column:
    """The digits put at the digit places of a shape, separators kept."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def filled(held: Column) -> Column:
        def one(state: Column, c: Column) -> Column:
            is_digit = c.rlike("^[0-9]$")
            put = F.when(is_digit, F.substring(held, state["at"], F.lit(1))).otherwise(c)
            return F.struct(
                F.concat(state["out"], put).alias("out"), (state["at"] + F.when(is_digit, 1).otherwise(0)).alias("at")
            )

        return F.aggregate(F.split(shape, ""), start, one, lambda s: s["out"])

    return _bound(digits, filled)


def _fields(value: Column) -> tuple[Column, Column]:
    """The first two numbers of a date that ends with the year."""
    return F.regexp_extract(value, r"^(\d+)[./]", 1), F.regexp_extract(value, r"^\d+[./](\d+)", 1)


def _existing(value: Column, month: Column, day: Column) -> Column:
    written = F.concat_ws("-", F.substring(value, F.length(value) - 3, F.lit(4)), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_date(written, "yyyy-MM-dd")


def _month_first(value: Column) -> Column:
    """Whether a value is a month, a day and a year that exist, with slashes."""
    first, second = _fields(value)
    return value.contains("/") & _existing(value, first, second).isNotNull()


def _day(value: Column) -> Column:
    """The date that a value writes; null if there is none."""
    first, second = _fields(value)
    return (
        F.when(value.rlike(r"^\d{4}-"), F.try_to_date(value, "yyyy-MM-dd"))
        .when(_month_first(value), _existing(value, first, second))
        .when(value.rlike(r"^\d{1,2}[./]"), _existing(value, second, first))
    )


def _date(value: Column, key: str, undo: bool) -> Column:
    first, second = _fields(value)
    iso, start = value.rlike(r"^\d{4}-"), F.lit(FIRST_DAY).cast("date")
    mark = F.when(value.contains("/"), "/").otherwise(".")

    def moved(month_first: Column) -> Column:
        short_day = ~iso & (F.length(F.when(month_first, second).otherwise(first)) == 1)
        short_month = ~iso & (F.length(F.when(month_first, first).otherwise(second)) == 1)
        days = (F.when(value.contains("/") & ~month_first, 13).otherwise(1), F.when(short_day, 9).otherwise(31))
        months = F.when(short_month, 9).otherwise(12)
        walked = _in_range(F.datediff(_day(value), start), key, undo, days, months)

        def written(new: Column) -> Column:
            # a short one has no leading zero, as it is below 10
            day, month = F.date_format(new, "dd"), F.date_format(new, "MM")
            day = F.when(short_day, F.substring(day, 2, 1)).otherwise(day)
            month = F.when(short_month, F.substring(month, 2, 1)).otherwise(month)
            halves = F.when(month_first, F.concat(month, mark, day)).otherwise(F.concat(day, mark, month))
            return F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(
                F.concat(halves, mark, F.date_format(new, "yyyy"))
            )

        return _bound(F.date_add(start, walked.cast("int")), written)

    return _bound(_month_first(value), moved)


def _mod97(text: Column) -> Column:
    """The rest modulo 97 of the number that digits and capital letters (A is 10) write."""
    def one(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code >= 65, F.pmod(rest * 100 + code - 55, F.lit(97))).otherwise(F.pmod(rest * 10 + code - 48, F.lit(97)))

    return F.aggregate(F.split(text, ""), F.lit(0), one)


def _iban(value: Column, key: str, undo: bool) -> Column:
    """The account permuted; the check digits follow."""
    country = F.substring(value, 1, 2)

    def checked(account: Column) -> Column:
        check = 98 - _mod97(F.concat(account, country, F.lit("00")))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), account)

    return _bound(feistel_text(F.substring(value, F.lit(5), F.length(value)), key, undo), checked)


def _is_iban(value: Column) -> Column:
    rest = _mod97(F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 4)))
    return (rest == 1) & F.substring(value, 3, 2).between("02", "98")


def _ssn(value: Column, key: str, undo: bool) -> Column:
    """The nine digits permuted until their range is in use; one of nine is not."""
    start = F.struct(value.alias("v"), F.lit(False).alias("done"))

    def one(state: Column, _: Column) -> Column:
        new = _filled(state["v"], feistel_text(F.regexp_replace(state["v"], "-", ""), key, undo))
        return F.when(state["done"], state).otherwise(
            _bound(new, lambda n: F.struct(n.alias("v"), n.rlike(SSN_USED).alias("done")))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), start, one, lambda s: s["v"])


def kind_of(value: Column) -> Column:
    """The kind of a found value, or null if it is not valid."""
    is_card = _passes(value) | _passes(F.regexp_extract(value, INNER, 2))
    octets_ok = F.forall(F.split(value, r"\."), lambda o: (o.try_cast("int") <= 255) & ~o.rlike("^0."))
    in_days = _day(value).between(F.lit(FIRST_DAY).cast("date"), F.lit("2099-12-31").cast("date"))
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike(f"^(?:{IPV4})$"), F.when(octets_ok, "ipv4"))
        .when(value.rlike(f"^(?:{DATE})$"), F.when(in_days, "date"))
        .when(value.rlike(f"^(?:{PHONE})$"), "phone")
        .when(value.rlike(f"^(?:{SSN})$"), F.when(value.rlike(SSN_USED), "ssn"))
        .when(value.rlike(f"^(?:{IBAN})$"), F.when(_is_iban(value), "iban"))
        .when(value.rlike(f"^(?:{CARD})$"), F.when(is_card, "card"))
    )


def _card(value: Column, key: str, undo: bool) -> Column:
    """All but the check digit permuted; the check digit follows."""
    digits = F.regexp_replace(value, r"[^0-9]", "")
    body = feistel_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, undo)

    def checked(held: Column) -> Column:
        check = F.pmod(10 - F.pmod(_luhn_sum(held, True), F.lit(10)), F.lit(10))
        return F.concat(held, check.cast("string"))

    return _filled(value, _bound(body, checked))


def _inner_card(value: Column, key: str, undo: bool) -> Column:
    """The card inside a value permuted until the whole value fails its check, as it did."""
    before, inner, after = [F.regexp_extract(value, INNER, group) for group in (1, 2, 3)]
    start = F.struct(inner.alias("v"), F.lit(False).alias("done"))

    def one(state: Column, _: Column) -> Column:
        def stepped(new: Column) -> Column:
            return F.struct(new.alias("v"), (~_passes(F.concat(before, new, after))).alias("done"))

        return F.when(state["done"], state).otherwise(_bound(_card(state["v"], key, undo), stepped))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), start, one, lambda s: s["v"])
    return F.concat(before, walked, after)


def pseudonym(value: Column, key: str, undo: bool = False) -> Column:
    """The pseudonym of a found value (``undo``: the value of a pseudonym); invalid values stay."""
    digits = F.regexp_replace(value, r"[^0-9]", "")
    # e-mail: all but the last label of the domain
    stem = F.regexp_extract(value, r"^(.*)\.[A-Za-z]+$", 1)
    email = F.concat(feistel_text(stem, f"{key}|email", undo), F.substring(value, F.length(stem) + 1, F.length(value)))
    # address: one number of 32 bits
    octets = F.split(value, r"\.")
    number = F.aggregate(octets, F.lit(0).cast("bigint"), lambda a, o: a * 256 + o.try_cast("bigint"))
    moved = feistel_number(number, 65536, f"{key}|ipv4", undo)
    octet = lambda n, bits: F.pmod(F.shiftright(n, bits), F.lit(256)).cast("string")
    address = _bound(moved, lambda n: F.concat_ws(".", *[octet(n, bits) for bits in (24, 16, 8, 0)]))
    # telephone: the last ten digits
    country = F.substring(digits, F.lit(1), F.length(digits) - 10)
    phone = _filled(value, F.concat(country, feistel_text(F.substring(digits, F.length(digits) - 9, F.lit(10)), f"{key}|phone", undo)))
    card = F.when(_passes(value), _card(value, f"{key}|card", undo)).otherwise(_inner_card(value, f"{key}|card", undo))

    def replaced(kind: Column) -> Column:
        return (
            F.when(kind == "email", email)
            .when(kind == "ipv4", address)
            .when(kind == "date", _date(value, f"{key}|date", undo))
            .when(kind == "phone", phone)
            .when(kind == "card", card)
            .when(kind == "ssn", _ssn(value, f"{key}|ssn", undo))
            .when(kind == "iban", _iban(value, f"{key}|iban", undo))
            .otherwise(value)
        )

    return _bound(kind_of(value), replaced)


def _count_of(kinds: Column, kind: str) -> Column:
    return F.size(F.filter(kinds, lambda k: k == kind))


def pseudonymise(
    df: DataFrame, text: str, key: str, out: str | None = None, counts: str | None = None, undo: bool = False
) -> DataFrame:
    """All rows, the values of ``text`` replaced (in ``out`` if given).

    ``counts``: a column for the number of replaced values by kind, a struct. A text is split
    at its values and put together again around their pseudonyms; no shuffle.
    """
    # every value has a digit or an @; most texts have neither and skip the long pattern
    may = F.col(text).rlike("[0-9@]")
    none = F.array().cast("array<string>")
    values = F.when(may, F.regexp_extract_all(F.col(text), F.lit(VALUE), F.lit(0))).when(~may, none)
    held_values, made = free_names(df, "_values", "_new")
    found = df.withColumn(held_values, values).withColumn(
        made, F.transform(held_values, lambda v: pseudonym(v, key, undo))
    )
    parts = F.split(F.col(text), VALUE, -1)
    # a text of n values has n + 1 parts; an array of n + 1 new values ends with an empty one
    joined = F.array_join(
        F.flatten(F.zip_with(parts, F.concat(made, F.array(F.lit(""))), lambda p, v: F.array(p, v))), ""
    )
    whole = F.when(F.size(held_values) > 0, joined).otherwise(F.col(text))
    result = found.withColumn(out or text, whole)
    if counts:
        kinds = F.transform(held_values, kind_of)
        held = [_count_of(kinds, kind).alias(kind) for kind in KINDS]
        result = result.withColumn(counts, F.when(F.col(held_values).isNotNull(), F.struct(*held)))
    return result.drop(held_values, made)
