"""Personal data in texts, replaced by format-preserving keyed pseudonyms. Column functions only.

Numbers and dates are found by pattern and validated (Luhn digit, octets, calendar, numbering
plan); each valid value is split into two numbers x below a and y below b, and eight rounds of
a Feistel network (x += F(y) mod a, y += F(x) mod b, F keyed by SHA-256) permute all values of
that format. A value therefore always gets the same pseudonym in every document, two values
never share one, and whoever holds the key can invert it. E-mail addresses have no fixed
format to permute; they get a keyed digest in the form of an address. Long hexadecimal
secrets are permuted in blocks.

=========== ============================== ======================================
kind        valid when                     permuted over
=========== ============================== ======================================
card        13-19 digits, Luhn sum 0       all but the check digit, which follows
phone       +country and 7-13 digits, or   the digits after the country code; ten
            (nnn) nnn-nnnn                 digits of +1 stay in the numbering plan
ssn         nnn-nn-nnnn as issued          the issued numbers
ipv4        four octets                    all addresses
date        ISO, dd.mm.yyyy or mm/dd/yyyy, the days from 1901 to 2096
            a calendar day of 1901-2096
secret      32-64 hexadecimal digits, both blocks of 28 digits
            letters and digits
=========== ============================== ======================================

Defined results: a null text stays null, an empty one empty; text outside valid values is not
changed; invalid look-alikes stay; equal rows give equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.functions.text import let

ROUNDS = 8
_START, _CYCLE_DAYS, _CYCLES = "1901-01-01", 1461, 49

# Patterns of the candidates, tried in this order at each place.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
SECRET = r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])"
PHONE = r"\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\d)|(?<!\d)\([2-9]\d{2}\) ?\d{3}-\d{4}(?!\d)"
ISO_DATE = r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)"
DOT_DATE = r"(?<![\d.])\d{2}\.\d{2}\.\d{4}(?!\d)"
SLASH_DATE = r"(?<![\d/])\d{2}/\d{2}/\d{4}(?!\d)"
IPV4 = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<!\d)\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?!\d)|(?<!\d)\d{13,19}(?!\d)"
ANY = "|".join([EMAIL, SECRET, PHONE, ISO_DATE, DOT_DATE, SLASH_DATE, IPV4, SSN, CARD.replace(r"\1", r"[ -]").replace("([ -])", "[ -]")])


def _draw(key: str, tag: Column, r: Column, value: Column) -> Column:
    """A keyed number below 2 ** 60."""
    said = F.concat_ws("|", F.lit(key), tag, r.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long")


def feistel(x: Column, y: Column, a: Column, b: Column, key: str, tag: Column) -> Column:
    """struct(x, y) permuted over x below ``a`` and y below ``b``."""
    def turn(s: Column, r: Column) -> Column:
        return F.when(r % 2 == 0, F.struct(((s.x + _draw(key, tag, r, s.y)) % a).alias("x"), s.y.alias("y"))).otherwise(
            F.struct(s.x.alias("x"), ((s.y + _draw(key, tag, r, s.x)) % b).alias("y")))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), start, turn)


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def permuted_digits(d: Column, key: str, tag: str) -> Column:
    """A string of 2 to 36 digits permuted over all strings of its length."""
    def halves(n: Column) -> Column:
        half = n.bitwiseAND(F.lit(-2)) / 2
        left, right = half.cast("int"), (n - half).cast("int")
        return let(feistel(F.substring(d, F.lit(1), left).cast("long"), F.substring(d, left + 1, right).cast("long"), _power(left), _power(right),
                           key, F.concat(F.lit(tag), n.cast("string"))),
                   lambda s: F.concat(F.lpad(s.x.cast("string"), left, F.lit("0")), F.lpad(s.y.cast("string"), right, F.lit("0"))))

    return let(F.length(d), halves)


def _refilled(template: Column, digits: Column) -> Column:
    """The template with its digits replaced, in order, by the given ones."""
    step = F.aggregate(
        F.split(template, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")),
        lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s.out, F.substring(digits, s.i, F.lit(1))).alias("out"), (s.i + 1).alias("i")))
        .otherwise(F.struct(F.concat(s.out, c).alias("out"), s.i.alias("i"))))
    return step.out


def _luhn(d: Column, shift: int) -> Column:
    """Luhn sum of a digit string; ``shift`` 1 when a check digit is to be appended."""
    def one(s: Column, i: Column) -> Column:
        v = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        twice = F.when(v > 4, v * 2 - 9).otherwise(v * 2)
        return s + F.when((i + shift) % 2 == 1, twice).otherwise(v)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), one)


def _card(m: Column, key: str) -> Column:
    def valid(d: Column) -> Column:
        body = permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        fresh = let(body, lambda b: F.concat(b, ((10 - _luhn(b, 1) % 10) % 10).cast("string")))
        return F.when(_luhn(d, 0) % 10 == 0, _refilled(m, fresh)).otherwise(m)

    return let(_digits(m), valid)


def _phone(m: Column, key: str) -> Column:
    """Digits after the country code; North American numbers keep both leading digits from 2 to 9."""
    country = F.regexp_extract(m, r"^(\+\d{1,3}?)(?=[ .(-])|^(\+1)(?=\d{10}$)", 0)

    def numbered(d: Column) -> Column:
        plan = d.rlike(r"^[2-9]\d{2}[2-9]\d{6}$")
        area, rest = F.substring(d, 1, 3).cast("long") - 200, F.substring(d, 4, 7).cast("long") - 2_000_000
        in_plan = let(feistel(area, rest, F.lit(800), F.lit(8_000_000), key, F.lit("phone")),
                      lambda s: F.concat((s.x + 200).cast("string"), (s.y + 2_000_000).cast("string")))
        return (F.when(plan, in_plan).when(F.length(d).between(7, 13), permuted_digits(d, key, "phone")))

    body = F.substring(m, F.length(country) + 1, F.length(m))
    return let(numbered(_digits(body)), lambda d: F.when(d.isNull(), m).otherwise(F.concat(country, _refilled(body, d))))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = F.substring(m, 1, 3).cast("int"), F.substring(m, 5, 2).cast("int"), F.substring(m, 8, 4).cast("int")
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    x = F.when(area > 666, area - 2).otherwise(area - 1)
    y = (group - 1) * 9999 + serial - 1

    def shown(s: Column) -> Column:
        a = F.when(s.x >= 665, s.x + 2).otherwise(s.x + 1)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.floor(s.y / 9999) + 1).cast("string"), 2, "0"),
                           F.lpad((s.y % 9999 + 1).cast("string"), 4, "0"))

    return F.when(valid, let(feistel(x, y, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn")), shown)).otherwise(m)


def _ipv4(m: Column, key: str) -> Column:
    def octets(o: Column) -> Column:
        x, y = F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3))
        new = let(feistel(x, y, F.lit(65536), F.lit(65536), key, F.lit("ipv4")), lambda s: F.concat_ws(
            ".", F.floor(s.x / 256).cast("string"), (s.x % 256).cast("string"), F.floor(s.y / 256).cast("string"), (s.y % 256).cast("string")))
        return F.when(F.forall(o, lambda v: v < 256), new).otherwise(m)

    return let(F.transform(F.split(m, r"\."), lambda v: v.cast("int")), octets)


def _date(m: Column, form: str, key: str) -> Column:
    def day(n: Column) -> Column:
        new = let(feistel(F.floor(n / _CYCLE_DAYS), n % _CYCLE_DAYS, F.lit(_CYCLES), F.lit(_CYCLE_DAYS), key, F.lit("date")),
                  lambda s: F.date_format(F.date_add(F.lit(_START).cast("date"), (s.x * _CYCLE_DAYS + s.y).cast("int")), form))
        return F.when(n.between(0, _CYCLES * _CYCLE_DAYS - 1), new).otherwise(m)

    return let(F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit(_START).cast("date")), day)


def _secret(m: Column, key: str) -> Column:
    def block(at: Column) -> Column:
        part = F.substring(m, at, F.least(F.lit(28), F.length(m) - at + 1))

        def halves(n: Column) -> Column:
            left = F.floor(n / 2).cast("int")
            right = (n - left).cast("int")
            two = feistel(F.conv(F.substring(part, F.lit(1), left), 16, 10).cast("long"), F.conv(F.substring(part, left + 1, right), 16, 10).cast("long"),
                          F.pow(F.lit(16.0), left).cast("long"), F.pow(F.lit(16.0), right).cast("long"), key, F.concat(F.lit("secret"), at.cast("string"), F.lit("."), n.cast("string")))
            return let(two, lambda s: F.concat(F.lpad(F.lower(F.hex(s.x)), left, F.lit("0")), F.lpad(F.lower(F.hex(s.y)), right, F.lit("0"))))

        return let(F.length(part), halves)

    mixed = m.rlike("[0-9]") & m.rlike("[a-f]")
    whole = F.array_join(F.transform(F.filter(F.array(F.lit(1), F.lit(29), F.lit(57)), lambda at: at <= F.length(m)), block), "")
    return F.when(mixed, whole).otherwise(m)


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("user."), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 16), F.lit("@mail.invalid"))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one candidate; the candidate itself if it is not valid."""
    def alone(pattern: str) -> Column:
        return m.rlike(f"^(?:{pattern})$")

    return (
        F.when(m.contains("@"), _email(m, key))
        .when(alone(SECRET) & m.rlike("[a-f]"), _secret(m, key))
        .when(alone(PHONE), _phone(m, key))
        .when(alone(ISO_DATE), _date(m, "yyyy-MM-dd", key))
        .when(alone(DOT_DATE), _date(m, "dd.MM.yyyy", key))
        .when(alone(SLASH_DATE), _date(m, "MM/dd/yyyy", key))
        .when(alone(IPV4), _ipv4(m, key))
        .when(alone(SSN), _ssn(m, key))
        .when(alone(CARD), _card(m, key))
        .otherwise(m))


def replaced(text: Column, key: str) -> Column:
    """struct(text, n_found, n_changed): the text with all valid values replaced."""
    def zipped(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(ANY), 0)
        return let(found, lambda old: let(F.transform(old, lambda m: pseudonym(m, key)), lambda new: F.struct(
            F.array_join(F.zip_with(F.split(t, ANY, -1), F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "").alias("text"),
            F.size(old).cast("long").alias("n_found"),
            F.size(F.filter(F.zip_with(old, new, lambda a, b: a != b), lambda x: x)).cast("long").alias("n_changed"))))

    plain = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n_found"), F.lit(0).cast("long").alias("n_changed"))
    return F.when(text.rlike("[0-9@]") | text.rlike("[0-9a-f]{32}"), let(text, zipped)).otherwise(plain)


def pseudonymise(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """All columns with ``text`` replaced; n_found and n_changed are added, or take the place of columns so named."""
    done = docs.withColumn("_pii", replaced(F.col(text), secret))
    return done.withColumns({text: F.col("_pii.text"), "n_found": F.col("_pii.n_found"), "n_changed": F.col("_pii.n_changed")}).drop("_pii")
