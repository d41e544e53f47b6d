r"""Pseudonyms for personal data, in DataFrame work alone.

Candidates are found by one pattern and validated: card numbers by the Luhn sum, IBANs by their remainder
modulo 97, addresses and dates by their ranges. A valid one is replaced by a keyed permutation of itself
within its own format (a Feistel network), so equal values have equal pseudonyms in all documents, and
different values different ones. Check digits are made anew, so pseudonyms are valid as well.

Characters: the digits and letters of a value, each within its own alphabet (a letter beyond ASCII: the letters
of its row of 16 in the code chart), are cut in halves; in turn, each half is shifted by a keyed hash of the other. Separators don't count and stay in place. Ranges (dates,
social security numbers): the value's number in its range is permuted on a slightly larger square, again
until it falls into the range.

A text without anything that a candidate needs is passed on as it is; else it is split at the candidates and put together
again with their pseudonyms.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, fresh, whole_text

KEY = "tidemark"
ROUNDS = 8
#: Steps until a number falls into its range; the squares are so close to the ranges that one in 10**9 needs six.
WALK = 40

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+"
SECRET = r"""(?i:(?<![\p{L}\p{N}])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s?[=:]\s?["'][A-Za-z0-9+/_.=-]{12,}["'])"""
#: Without quotes a secret needs a digit; keys that tell themselves by how they begin need no name.
BARE = r"""(?i:(?<![\p{L}\p{N}])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s?[=:]\s?(?=[A-Za-z+/_.-]*[0-9])[A-Za-z0-9+/_.-]{15,}[A-Za-z0-9+/_-]|(?<![\p{L}\p{N}])(?:password|passwd)\s?[=:]\s?(?=[^\s"'<>,;]*[0-9])[^\s"'<>,;]{6,})"""
ACCESS_KEY = r"(?<![\p{L}\p{N}])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[a-z]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,})(?![\p{L}\p{N}])"
DEVICE = r"(?<![\p{L}\p{N}:-])(?i:[0-9a-f]{2}(?:(?::[0-9a-f]{2}){5}|(?:-[0-9a-f]{2}){5}))(?![\p{L}\p{N}:-])"
ADDRESS_6 = r"(?<![\p{L}\p{N}:])(?i:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){1,5}::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,3})?)(?![\p{L}\p{N}:])"
ADDRESS = r"(?<![\p{L}\p{N}.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?[\p{L}\p{N}])"
PHONE = r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}+(])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}+(.,-])0\d{2,4}[ /-]\d{5,8}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}+(.,-])(?:\(0\d{2,4}\) ?\d{3,4}[ -]?\d{3,4}|00\d{2}[ .-]\d{2,4}(?:[ .-]?\d{2,4}){2,3})(?![\p{L}\p{N}])"
SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])"
DATE = r"(?<![\p{L}\p{N}./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\p{N}/-]|(?!T\d{2}:)\p{L})"
CARD = r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?![\p{L}\p{N}])"
IBAN = r"(?<![\p{L}\p{N}])(?:[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)|[a-z]{2}\d{2}[a-z0-9]{11,30})(?![\p{L}\p{N}])"
#: In this order; where two begin at one place, the first is taken.
ANY = "|".join((EMAIL, SECRET, BARE, ACCESS_KEY, IBAN, ADDRESS_6, DEVICE, ADDRESS, DATE, SSN, CARD, PHONE))

#: What no candidate lacks.
_NEEDED = "[0-9@]|[=:]\\s?[\"']"

FIRST_DAY, DAYS = "1900-01-01", 73049  # up to 2099-12-31


def _whole(pattern: str) -> str:
    return rf"^(?:{pattern})$"


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 512)


def _number(digest: Column, i: Column, length: int = 4) -> Column:
    """The i-th group of hex digits as a number."""
    return F.conv(F.substr(digest, (i * length % (128 - length + 1) + 1).cast("int"), F.lit(length)), 16, 10).cast("long")


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _alphabet(c: Column, hexa: Column) -> Column:
    """The characters among which c moves; c itself if it doesn't."""
    digit, small, large = c.rlike("^[0-9]$"), c.rlike("^[a-z]$"), c.rlike("^[A-Z]$")
    # a letter beyond ASCII (and within the base plane, where a code is two bytes): its row of the code chart
    code = F.hex(F.encode(c, "UTF-16BE"))
    of_row = F.transform(F.split(F.lit("0123456789ABCDEF"), ""), lambda x: F.decode(F.unhex(F.concat(F.substring(code, 1, 3), x)), "UTF-16BE"))
    row = F.array_join(F.filter(of_row, lambda x: x.rlike("^\\p{L}$")), "")
    beyond = c.rlike("^[\\p{L}&&[^A-Za-z]]$") & (F.length(code) == 4)
    return F.when(hexa & c.rlike("^[0-9a-f]$"), F.lit("0123456789abcdef")).when(beyond, row).when(digit, F.lit("0123456789")).when(small, F.lit("abcdefghijklmnopqrstuvwxyz")).when(large, F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)


def permuted(value: Column, key: str, hexa: Column | None = None) -> Column:
    """A string's ASCII digits and letters permuted within their classes (hexa: all of them hex digits)."""
    alphabets = F.transform(F.split(value, ""), lambda c: _alphabet(c, F.lit(False) if hexa is None else hexa))

    def rounds(alpha: Column) -> Column:
        half = F.floor(F.size(alpha) / 2)
        start = F.transform(F.split(value, ""), lambda c, i: F.instr(F.element_at(alpha, (i + 1).cast("int")), c) - 1)

        def one(v: Column, r: Column) -> Column:
            moves = lambda i: (i < half) == (r % 2 == 1)
            other = F.array_join(F.transform(v, lambda x, i: F.when(moves(i), F.lit("-")).otherwise(x.cast("string"))), ",")
            return _let(_hash(key, r.cast("string"), other), lambda d: F.transform(v, lambda x, i: F.when(moves(i), ((x + _number(d, i)) % F.length(F.element_at(alpha, (i + 1).cast("int")))).cast("int")).otherwise(x)))

        moved = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one)
        return F.array_join(F.transform(moved, lambda x, i: F.substr(F.element_at(alpha, (i + 1).cast("int")), (x + 1).cast("int"), F.lit(1))), "")

    return F.when(F.length(value) == 0, value).otherwise(_let(alphabets, rounds))


def permuted_number(value: Column, size: int, key: str) -> Column:
    """A permutation of 0..size-1."""
    side = math.isqrt(size - 1) + 1

    def network(x: Column) -> Column:
        start = F.struct((x / side).cast("long").alias("l"), (x % side).alias("r"))
        one = lambda v, k: F.struct(v["r"].alias("l"), ((v["l"] + _number(_hash(key, k.cast("string"), v["r"].cast("string")), F.lit(0), 12)) % side).alias("r"))
        return _let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one), lambda v: v["l"] * side + v["r"])

    # once through, and then on while it lies beyond the range
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.lit(-1).cast("long"), lambda at, k: F.when((at >= 0) & (at < size), at).otherwise(network(F.when(at < 0, value.cast("long")).otherwise(at))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _put_back(value: Column, marks: Column, pattern: str) -> Column:
    """value with its characters that match pattern replaced, in order, by those of marks."""

    def put(new: Column) -> Column:
        chars = F.split(value, "")
        return F.aggregate(
            chars, F.struct(F.lit("").alias("text"), F.lit(1).alias("at")),
            lambda a, c: F.when(c.rlike(pattern), F.struct(F.concat(a["text"], F.substr(new, a["at"], F.lit(1))).alias("text"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["text"], c).alias("text"), a["at"].alias("at"))),
            lambda a: a["text"],
        )

    return _let(marks, put)


def _luhn_sum(digits: Column, from_end: int) -> Column:
    """Luhn sum; from_end 0: the last digit counts once, 1: twice."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 1 - from_end, d.cast("int") * 2 - 9 * (d.cast("int") > 4).cast("int")).otherwise(d.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _card(value: Column, key: str) -> Column:
    def with_check(payload: Column) -> Column:
        return F.concat(payload, ((10 - _luhn_sum(payload, 1) % 10) % 10).cast("string"))

    d = _digits(value)
    return _put_back(value, _let(permuted(F.substr(d, F.lit(1), F.length(d) - 1), key + "card"), with_check), "^[0-9]$")


def _mod97(text: Column) -> Column:
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + F.conv(c, 10, 10).cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _iban(value: Column, key: str) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    country = F.substr(plain, F.lit(1), F.lit(2))

    def with_check(own: Column) -> Column:
        return F.concat(country, F.lpad((98 - _mod97(F.concat(own, country, F.lit("00")))).cast("string"), 2, "0"), own)

    return _put_back(value, _let(permuted(F.substr(plain, F.lit(5)), key + "iban"), with_check), "^[A-Z0-9]$")


def _address(value: Column, key: str) -> Column:
    p = F.split(value, r"\.")
    n = reduce(lambda a, i: a * 256 + F.element_at(p, i).cast("long"), (2, 3, 4), F.element_at(p, 1).cast("long"))
    return _let(permuted_number(n, 1 << 32, key + "address"), lambda x: F.concat_ws(".", *(F.shiftright(x, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0))))


def _day(value: Column) -> Column:
    """The day that value names, null if there is none; of day and month the one that fits comes first."""
    forms = (("^....-", "yyyy-MM-dd"), ("^../", "dd/MM/yyyy"), ("^../", "MM/dd/yyyy"), (r"\.", "d.M.yyyy"))
    return F.coalesce(*(F.when(value.rlike(p), F.to_date(F.try_to_timestamp(value, F.lit(f)))) for p, f in forms))


def _date(value: Column, key: str) -> Column:
    number = permuted_number(F.datediff(_day(value), F.lit(FIRST_DAY).cast("date")), DAYS, key + "date")
    month_first = F.try_to_timestamp(value, F.lit("dd/MM/yyyy")).isNull()
    return _let(
        F.date_add(F.lit(FIRST_DAY).cast("date"), number.cast("int")),
        lambda d: F.when(value.rlike("^....-"), F.date_format(d, "yyyy-MM-dd")).when(value.rlike(r"^..\...\."), F.date_format(d, "dd.MM.yyyy")).when(value.contains("."), F.date_format(d, "d.M.yyyy"))
        # a day up to 12 first would be read the other way round; such a text may stand for two days either way
        .when(month_first, F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy")),
    )


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.substr(value, F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    n = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1

    def text(x: Column) -> Column:
        a = (x / (99 * 9999)).cast("long") + 1
        return F.format_string("%03d-%02d-%04d", a + (a >= 666).cast("int"), (x / 9999).cast("long") % 99 + 1, x % 9999 + 1)

    return _let(permuted_number(n, 898 * 99 * 9999, key + "ssn"), text)


def _email(value: Column, key: str) -> Column:
    """Case doesn't count, so all ways to write an address are linked."""
    low = F.when(F.length(F.lower(value)) == F.length(value), F.lower(value)).otherwise(value)
    return F.concat(permuted(F.substring_index(low, "@", 1), key + "email"), F.lit("@"), F.substring_index(low, "@", -1))


def _secret(value: Column, key: str) -> Column:
    own = F.regexp_extract(value, r"""["'](.*)["']$""", 1)
    head = F.regexp_extract(value, r"""^(.*?["']).*$""", 1)
    return F.concat(head, permuted(own, key + "secret", own.rlike("^[0-9a-f]+$")), F.substr(value, F.length(value), F.lit(1)))


def _bare(value: Column, key: str) -> Column:
    head = F.regexp_extract(value, r"^([^=:]*[=:]\s?)", 1)
    own = F.substr(value, F.length(head) + 1, F.length(value))
    return F.concat(head, permuted(own, key + "secret", own.rlike("^[0-9a-f]+$")))


def _known_key(value: Column, key: str) -> Column:
    head = F.regexp_extract(value, "^(?:AKIA|ASIA|gh[a-z]_|sk-)", 0)
    return F.concat(head, permuted(F.substr(value, F.length(head) + 1, F.length(value)), key + "access"))


def _phone(value: Column, key: str) -> Column:
    """The country's digits and the 0 of a long-distance call stay."""
    head = F.regexp_extract(value, r"^(?:\+\d{1,3}|00\d{2}|\(?0)?", 0)
    rest = F.substr(value, F.length(head) + 1, F.length(value))
    return F.concat(head, _put_back(rest, permuted(_digits(rest), key + "phone"), "^[0-9]$"))


def pseudonym(value: Column, key: str = KEY) -> Column:
    """The pseudonym of a candidate; null if it isn't valid."""
    d = _digits(value)
    octets = F.forall(F.split(value, r"\."), lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False)))
    day = _day(value)
    # an IBAN in small letters is linked with that in capitals
    upper = F.upper(F.replace(value, F.lit(" "), F.lit("")))
    in_order = _mod97(F.concat(F.substr(upper, F.lit(5)), F.substr(upper, F.lit(1), F.lit(4)))) == 1
    return (
        F.when(value.contains("@"), _email(value, key))
        .when(value.rlike("[\"']$"), _secret(value, key))
        .when(value.rlike(_whole(BARE)), _bare(value, key))
        .when(value.rlike(_whole(ACCESS_KEY)), _known_key(value, key))
        .when(value.rlike(_whole(DEVICE)), permuted(F.lower(value), key + "device", F.lit(True)))
        .when(value.rlike(_whole(ADDRESS_6)), permuted(F.lower(value), key + "address6", F.lit(True)))
        .when(value.rlike(_whole(ADDRESS)), F.when(octets, _address(value, key)))
        .when(value.rlike(_whole(DATE)), F.when((day >= F.lit(FIRST_DAY).cast("date")) & (F.datediff(day, F.lit(FIRST_DAY).cast("date")) < DAYS), _date(value, key)))
        .when(value.rlike(_whole(SSN)), F.when(~value.rlike("^(?:000|666|9..)-|-00-|-0000$"), _ssn(value, key)))
        .when(value.rlike("^[A-Z]"), F.when(in_order, _iban(value, key)))
        .when(value.rlike("^[a-z]"), F.when(in_order, F.lower(_iban(upper, key))))
        .when(value.rlike(_whole(CARD)), F.when((_luhn_sum(d, 0) % 10 == 0) & ~d.rlike("^0+$"), _card(value, key)))
        .when(value.rlike(_whole(PHONE)), _phone(value, key))
    )


def with_pseudonyms(docs: DataFrame, key: str = KEY, column: str = "text") -> DataFrame:
    """docs with the text's personal data replaced, and n_found, how many values were (replacing that column).

    A null text stays null and has 0; an empty one stays empty. What isn't valid stays as it is, as does
    all else. Of a text of any length each value by itself is worked on. Rows are worked on one by one: repeated rows stay so, an empty table gives an empty one.
    """
    text = F.col(column)
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    docs = docs.drop("n_found")
    old, new = fresh(docs, "pii_found", "pii_new")
    marked = docs.withColumn(old, F.when(text.rlike(_NEEDED), found)).withColumn(new, F.when(F.size(old) > 0, F.transform(old, lambda v: pseudonym(v, key))))
    pieces = F.split(text, ANY, -1)
    kept = F.zip_with(F.col(old), F.col(new), lambda v, p: F.coalesce(p, v))
    whole = F.array_join(F.zip_with(pieces, kept, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    n = F.when(F.col(new).isNotNull(), F.size(F.array_compact(new))).otherwise(0)
    return marked.withColumn("n_found", n).withColumn(column, F.when(F.col("n_found") > 0, whole).otherwise(text)).drop(old, new)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_pseudonyms(documents(spark, sf_dir)).select("doc_id", "text", "n_found")
