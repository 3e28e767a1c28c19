"""Format-preserving pseudonyms for personal data, with DataFrame functions alone.

Kinds: e-mail addresses, IPv4 addresses, telephone numbers, card and account numbers (13 to 19 digits), dates
(YYYY-MM-DD and DD/MM/YYYY), and secrets (a long value after token, key, secret or password). A number is permuted by a keyed
Feistel network over its digits, a date over the days of its 400-year cycle, so each result has the same format, different
values never collide, and equal values stay equal in all documents. Digits keep their places; separators stay.

* A card number that passes the Luhn test gives one that passes it: all but the check digit are permuted, then it is computed.
* An IPv4 address permutes its 32 bits and stays an address. A date stays a date of the calendar; a text that only looks like
  a date or an address (month 13, octet 300) is not validated and stays.
* The digits of a telephone number after its country code are permuted, however they are separated; so are those of a social-security
  number.
* E-mail names and secrets have no number format: each is replaced by as many keyed hexadecimal digits (at most 64, for names at
  least 16) as it has characters, the e-mail's domain by example.com.

The key is the caller's: who has it can undo the pseudonyms. IBANs and IPv6 addresses are not known and stay.

Defined cases: a null or empty text stays; a text without personal data stays byte for byte; an empty table gives an empty
result; a very long text, or a very long run of what looks like one address, is searched in one pass without recursion; extra columns stay; columns named like a helper are not touched, since none is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Country codes of fewer than three digits (ITU E.164), as patterns.
_COUNTRIES = ("1", "7", "2[07]", "3[0-469]", "4[013-9]", "5[1-8]", "6[0-6]", "8[1246]", "9[0-58]")
#: Days of the Gregorian 400-year cycle: 27 * 5411.
_CYCLE, _LEFT = 146097, 27

#: What may be personal data, the most specific first. Java regular expressions; each alternative consumes at least one character, and
#: what may repeat without bound does so possessively, since Java's matcher calls itself for each repeat of a greedy group.
_SECRET = r"(?i:token|api[_-]?key|secret|password|passwd|pwd)[\x20\t]*[=:][\x20\t]*[\"']?[A-Za-z0-9_+/\-]{12,}"
_EMAIL = r"(?<![\w.+%-])[\w.+%-]++@[\w-]++(?:\.[\w-]++)++"
_IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
_PHONE = r"(?<![\w+])\+\d{1,3}[\x20.-]?\(?\d{2,4}\)?[\x20.-]?\d{3,4}[\x20.-]?\d{3,4}(?!\d)|(?<![\w)])\(\d{3}\)[\x20-]?\d{3}-\d{4}(?!\d)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\d-])"
_DATE = r"(?<![\d/-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})(?![\d/-])"
_SOCIAL = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
_NUMBER = r"(?<![\d])\d(?:[\x20-]?\d){12,18}(?![\d])"
PATTERN = "|".join((_SECRET, _EMAIL, _IP, _DATE, _SOCIAL, _PHONE, _NUMBER))
#: A text without any of these shapes has nothing for PATTERN; this test is cheap.
_HINT = r"@|\d[\d.()\x20/-]{5}|[=:][\x20\t]*[\"']?[A-Za-z0-9_+/\-]{12}"


def _round(key: str, label: Column, half: Column, size: Column) -> Column:
    """A keyed number in [0, size) from half: the first 15 hexadecimal digits of a SHA-256."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), label.cast("string"), half.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(20,0)"), size.cast("decimal(20,0)")).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, label: Column) -> Column:
    """A keyed permutation of the pairs (left, right) below their sizes: rounds add a function of one half to the other."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(s: Column, n: Column) -> Column:
        tag = F.concat_ws("/", label, n)
        l_next = F.pmod(s["l"] + _round(key, tag, s["r"], left_size), left_size)
        r_next = F.pmod(s["r"] + _round(key, tag, s["l"], right_size), right_size)
        return F.struct(F.when(n % 2 == 0, l_next).otherwise(s["l"]).cast("long").alias("l"), F.when(n % 2 == 1, r_next).otherwise(s["r"]).cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A permutation of the strings of as many digits (at most 36)."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    left, right = F.substring(digits, F.lit(1), a), F.substring(digits, a + 1, n - a)
    done = feistel(F.coalesce(F.try_to_number(left, F.lit("9" * 18)).cast("long"), F.lit(0)), right.cast("long"), power(a), power(n - a), key, F.concat(F.lit(kind), n.cast("string")))
    # an empty left half is zero of size one
    return F.transform(F.array(done), lambda s: F.concat(F.when(a > 0, F.lpad(s["l"].cast("string"), a, "0")).otherwise(""), F.lpad(s["r"].cast("string"), n - a, "0")))[0]


def _luhn_sum(digits: Column, from_right: int) -> Column:
    """The Luhn sum of digits whose last one stands at position from_right (0 is the check digit)."""
    n = F.length(digits)
    each = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.when((n - i + from_right) % 2 == 1, F.element_at(F.array(*(F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(digits, i, F.lit(1)).cast("int") + 1)).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def luhn_valid(digits: Column) -> Column:
    return _luhn_sum(digits, 0) % 10 == 0


def permuted_number(digits: Column, key: str) -> Column:
    """A card number (Luhn) becomes a card number, another number one of as many digits that is none."""
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    moved = permuted_digits(body, key, "card")
    check = lambda b: F.pmod(F.lit(10) - _luhn_sum(b, 1) % 10, F.lit(10))
    offset = F.pmod(F.substring(digits, F.length(digits), F.lit(1)).cast("int") - check(body), F.lit(10))
    return F.transform(F.array(moved), lambda b: F.concat(b, F.pmod(check(b) + offset, F.lit(10)).cast("string")))[0]


def permuted_date(day: Column, key: str) -> Column:
    """A day of the same 400-year cycle (counted from 1600-01-01)."""
    n = F.datediff(day, F.lit("1600-01-01").cast("date"))
    cycle, at = F.floor(n / _CYCLE).cast("int"), F.pmod(n, F.lit(_CYCLE))
    right = _CYCLE // _LEFT
    done = feistel(F.floor(at / right), at % right, F.lit(_LEFT), F.lit(right), key, F.lit("date"))
    return F.transform(F.array(done), lambda s: F.date_add(F.lit("1600-01-01").cast("date"), (cycle * _CYCLE + s["l"] * right + s["r"]).cast("int")))[0]


def _within(found: Column, digits: Column) -> Column:
    """The digits put into the places that found has digits in."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(s: Column, i: Column) -> Column:
        c = F.substring(found, i, F.lit(1))
        digit = c.rlike("[0-9]")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + F.when(digit, 1).otherwise(0)).alias("at"))

    return F.aggregate(F.sequence(F.lit(1), F.length(found)), start, put)["out"]


def _hex(value: Column, size: Column, key: str, kind: str) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), value), 256), F.lit(1), F.least(size, F.lit(64)))


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def pseudonym(found: Column, key: str) -> Column:
    """What takes the place of a match of PATTERN; a match that is not validated stays."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    # e-mail
    name = F.regexp_extract(found, "^([^@]*)@", 1)
    email = F.concat(_hex(F.lower(found), F.greatest(F.length(name), F.lit(16)), key, "email"), F.lit("@example.com"))
    # secret
    head = F.regexp_extract(found, "^([^=:]*[=:][\\x20\\t]*[\"']?)", 1)
    value = F.substring(found, F.length(head) + 1, F.length(found))
    secret = F.concat(head, _hex(value, F.length(value), key, "secret"))
    # address
    octets = F.transform(F.split(found, "\\."), lambda o: o.cast("int"))
    valid = F.forall(octets, lambda o: o <= 255)
    done = feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(65536), F.lit(65536), key, F.lit("ip"))
    address = _let(done, lambda s: F.concat_ws(".", F.floor(s["l"] / 256).cast("string"), (s["l"] % 256).cast("string"), F.floor(s["r"] / 256).cast("string"), (s["r"] % 256).cast("string")))
    # date
    iso = F.try_to_timestamp(found, F.lit("yyyy-MM-dd")).cast("date")
    european = F.try_to_timestamp(found, F.lit("dd/MM/yyyy")).cast("date")
    # telephone: the country prefix stays
    prefix = F.regexp_extract(found, r"^(\+(?:%s|\d{3}))" % "|".join(_COUNTRIES), 1)
    rest = F.substring(found, F.length(prefix) + 1, F.length(found))
    rest_digits = F.regexp_replace(rest, "[^0-9]", "")
    phone = F.concat(prefix, _within(rest, permuted_digits(rest_digits, key, "phone")))
    number = _let(permuted_number(digits, key), lambda d: _within(found, d))
    return (
        F.when(found.rlike("^" + _SECRET + "$"), secret)
        .when(found.contains("@"), email)
        .when(found.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(valid, address).otherwise(found))
        .when(found.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.when(iso.isNotNull(), F.date_format(permuted_date(iso, key), "yyyy-MM-dd")).otherwise(found))
        .when(found.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.when(european.isNotNull(), F.date_format(permuted_date(european, key), "dd/MM/yyyy")).otherwise(found))
        .when(F.length(digits) >= 13, number)
        .otherwise(phone)
    )


def kind_of(found: Column) -> Column:
    return (
        F.when(found.rlike("^" + _SECRET + "$"), "secret").when(found.contains("@"), "email").when(found.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip").when(found.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})$"), "date")
        .when(F.length(F.regexp_replace(found, "[^0-9]", "")) >= 13, "number").otherwise("phone")
    )


def matches(text: Column) -> Column:
    """The matches of PATTERN, in order; none for most texts at the price of one quick search."""
    return F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(f"({PATTERN})"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def replaced(text: Column, found: Column, key: str) -> Column:
    """text with each match replaced. The gaps between the matches are those of the same pattern."""
    gaps = F.split(text, PATTERN, -1)
    put = F.concat(F.transform(found, lambda m: pseudonym(m, key)), F.array(F.lit("")))
    return F.when(F.size(found) > 0, F.array_join(F.zip_with(gaps, put, lambda g, p: F.concat(g, p)), "")).otherwise(text)


def pseudonymised(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """docs with personal data in column replaced; all columns stay. n_chars, where there is one, follows the new text."""
    text = F.col(column)
    out = docs.withColumn(column, _let(text, lambda t: replaced(t, matches(t), key)))
    return out.withColumn("n_chars", F.length(column).cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text (replaced), n_found, kinds (sorted, comma-separated) of every document."""
    found = docs.select(F.col("doc_id"), "text", matches(F.col("text")).alias("_found"))
    return found.select(
        "doc_id",
        replaced(F.col("text"), F.col("_found"), key).alias("text"),
        F.coalesce(F.size("_found"), F.lit(0)).alias("n_found"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("_found", kind_of))), ",").alias("kinds"),
    )
