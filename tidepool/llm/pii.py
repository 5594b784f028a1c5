"""Format-preserving pseudonyms for personal data, by a keyed Feistel network.

Candidates are found by one pattern over the whole text and validated: cards by issuer range, length and
check digit, bank accounts (IBAN) by their remainder, addresses by their octets, dates by the calendar,
social-security numbers by their numbering plan; phone numbers need only the format (North American, or
a plus sign and 7 to 15 digits). A valid value is permuted within its format: its symbols are cut in two halves, and
in ten rounds a half is shifted, symbol by symbol, by a keyed SHA-256 digest of the other. Values that
must lie in a smaller domain (a calendar day, a 32-bit address, a plan's prefixes) are permuted again
until they do (cycle walking), so the mapping stays one-to-one; check digits are computed anew.
Equal values get equal pseudonyms in all documents; separators, letter case, e-mail hosts, a card's first
two digits and a country's code stay. Bare ten-digit numbers are not taken for phone numbers.

Scale: a projection; nothing is shuffled, joined or broadcast.

Defined cases: null texts stay null; texts without candidates, and candidates that fail validation,
stay as they are. Very long texts are read whole: the patterns have no unbounded repeated groups (an
e-mail address has at most 64 characters before the @ and nine labels after it, as many as its standard
lets usual hosts have), and a secret of any length is permuted in time linear in it. Rows are rewritten
one by one, so repeated rows get equal texts. Other columns are
kept; the counts are in a column whose name the caller gives (an input column of that name is
replaced).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import let, whole_row

ROUNDS, WALK = 10, 128
DIGITS, HEX, LETTERS, CODES = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
FIRST_DAY, DAYS = "1900-01-01", 73049  # to 2099-12-31

# Each kind's pattern; they are tried in this order.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])(?=[._%+-]{0,63}[A-Za-z0-9])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,63}",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:token|password|secret|api_key)\s?[=:]\s?\"?[0-9a-f]{16,}+(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+1[ .-]?)?(?:\(?[0-9]{3}\)?[ .-]|\([0-9]{3}\))[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "abroad": r"(?<![0-9A-Za-z+])\+[1-9][0-9](?:[ .()/-]{0,2}[0-9]){5,13}(?![0-9])",
    "card": r"(?<![0-9-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,4}(?:[ -][0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9]|-[0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# Every match of a pattern has a match of this: an @, a digit, or what a key or secret starts with.
ISSUED = "^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(?:5[1-5]|2[2-7])[0-9]{14}|3[47][0-9]{13}|3[0689][0-9]{12}|35[0-9]{14}|6[0245][0-9]{14,17})$"
MAYBE = r"[0-9@]|AKIA|(?:token|password|secret|api_key)\s?[=:]"


def feistel(value: Column, alphabet: str, key: str, tweak: str) -> Column:
    """A keyed permutation of the strings over ``alphabet`` of each length."""
    n, block = len(alphabet), F.lit("(?s).{1,16}")

    def shift(half: Column, other: Column, r: Column) -> Column:
        # One digest of the other half, and one of it for each 16 symbols: linear in the length.
        def moved(symbols: Column, digest: Column) -> Column:
            def one(c: Column, i: Column) -> Column:
                add = F.conv(F.substring(digest, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
                return F.substring(F.lit(alphabet), F.pmod(F.position(c, F.lit(alphabet)) - 1 + add, F.lit(n)) + 1, F.lit(1))

            return F.array_join(F.transform(F.split(symbols, ""), one), "")

        parts = lambda h: F.transform(F.regexp_extract_all(half, block, F.lit(0)), lambda s, k: let(F.sha2(F.concat_ws("|", h, k.cast("string")), 256), lambda d: moved(s, d)))
        return let(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), r.cast("string"), other), 256), lambda h: F.array_join(parts(h), ""))

    cut = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), cut).alias("a"), F.substring(value, cut + 1, F.length(value)).alias("b"))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, r: F.struct(s["b"].alias("a"), shift(s["a"], s["b"], r).alias("b")), lambda s: F.concat(s["a"], s["b"]))
    return last


def walk(value: Column, step: Callable[[Column], Column], fits: Callable[[Column], Column]) -> Column:
    """Permute until the value is in its domain again. It starts there, so it gets back."""
    start = F.struct(step(value).alias("v"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, lambda s, _: F.struct(F.when(fits(s["v"]), s["v"]).otherwise(step(s["v"])).alias("v")), lambda s: s["v"])


def refill(shape: Column, symbols: Column, cls: str) -> Column:
    """Put the symbols, in order, in place of the shape's characters of the class; case is kept."""

    def one(c: Column, i: Column) -> Column:
        k = F.length(F.regexp_replace(F.substring(shape, F.lit(1), i + 1), f"[^{cls}]", ""))
        new = F.substring(symbols, k, F.lit(1))
        return F.when(c.rlike(f"[{cls}]"), F.when(c.rlike("[A-Z]"), F.upper(new)).otherwise(new)).otherwise(c)

    return F.array_join(F.transform(F.split(shape, ""), one), "")


def only(value: Column, cls: str) -> Column:
    return F.regexp_replace(value, f"[^{cls}]", "")


def luhn(digits: Column) -> Column:
    """Sum of the check formula, where the last digit counts once."""

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + F.pmod(i, F.lit(2)))
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda a, b: a + b)


def _number(value: Column, size: int, key: str, tweak: str) -> Column:
    """Permute a number below ``size``."""
    width = len(str(size - 1))
    out = walk(F.lpad(value.cast("string"), width, "0"), lambda v: feistel(v, DIGITS, key, tweak), lambda v: v.cast("long") < size)
    return out.cast("long")


def _card(x: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        body = let(feistel(F.substring(d, F.lit(3), F.length(d) - 3), DIGITS, key, "card"), lambda b: F.concat(F.substring(d, 1, 2), b))
        return let(body, lambda b: F.concat(b, F.pmod(10 - F.pmod(luhn(F.concat(b, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")))

    return let(only(x, "0-9"), lambda d: F.when(d.rlike(ISSUED) & (F.pmod(luhn(d), F.lit(10)) == 0), refill(x, new(d), "0-9")))


def remainder(account: Column) -> Column:
    """Of an account (country and check digits first), with letters as numbers from 10 on, by 97."""

    def add(a: Column, c: Column) -> Column:
        v = F.position(c, F.lit(DIGITS + LETTERS.upper())) - 1
        return F.pmod(F.when(v < 10, a * 10 + v).otherwise(a * 100 + v), F.lit(97))

    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    return F.aggregate(F.split(moved, ""), F.lit(0), add)


def _iban(x: Column, key: str) -> Column:
    def new(s: Column) -> Column:
        rest = F.substring(s, F.lit(5), F.length(s))
        letters = let(F.lower(only(rest, "A-Z")), lambda v: feistel(v, LETTERS, key, "iban"))
        digits = let(only(rest, "0-9"), lambda v: feistel(v, DIGITS, key, "iban"))
        own = let(letters, lambda a: let(digits, lambda d: refill(refill(rest, a, "A-Z"), d, "0-9")))
        check = lambda b: F.lpad((98 - remainder(F.concat(F.substring(s, 1, 2), F.lit("00"), b))).cast("string"), 2, "0")
        return let(own, lambda b: F.concat(F.substring(s, 1, 2), check(b), b))

    return let(only(x, "A-Z0-9"), lambda s: F.when(remainder(s) == 1, refill(x, new(s), "A-Z0-9")))


def _phone(x: Column, key: str) -> Column:
    fits = lambda d: d.rlike("^[2-9][0-9]{2}[2-9]")
    prefix = F.when(x.startswith("+1"), F.lit("1")).otherwise(F.lit(""))
    # Numbers of the plan stay in it, the others outside it: each side is permuted in itself.
    new = lambda d: walk(d, lambda v: feistel(v, DIGITS, key, "phone"), lambda v: fits(v) == fits(d))
    return let(F.regexp_replace(only(x, "0-9"), "^1(?=[0-9]{10}$)", ""), lambda d: refill(x, F.concat(prefix, new(d)), "0-9"))


def _abroad(x: Column, key: str) -> Column:
    new = lambda d: F.concat(F.substring(d, 1, 2), let(F.substring(d, F.lit(3), F.length(d)), lambda v: feistel(v, DIGITS, key, "abroad")))
    return let(only(x, "0-9"), lambda d: refill(x, new(d), "0-9"))


def _ssn(x: Column, key: str) -> Column:
    fits = lambda d: d.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")
    return let(only(x, "0-9"), lambda d: F.when(fits(d), refill(x, walk(d, lambda v: feistel(v, DIGITS, key, "ssn"), fits), "0-9")))


def _ip(x: Column, key: str) -> Column:
    parts = F.transform(F.split(x, r"\."), lambda p: p.cast("long"))
    number = lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, b: a * 256 + b)
    text = lambda n: F.concat_ws(".", *[F.pmod(F.floor(n / (1 << s)), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])
    return let(parts, lambda p: F.when(~F.exists(p, lambda o: o > 255), let(_number(number(p), 1 << 32, key, "ip"), text)))


def _date(x: Column, key: str) -> Column:
    iso = x.rlike("^[0-9]{4}-")
    y = F.when(iso, F.substring(x, 1, 4)).otherwise(F.substring(x, 7, 4))
    a, b = F.when(iso, F.substring(x, 6, 2)).otherwise(F.substring(x, 4, 2)), F.when(iso, F.substring(x, 9, 2)).otherwise(F.substring(x, 1, 2))
    day = lambda m, d: F.concat_ws("-", y, m, d).try_cast("date")
    swapped = day(a, b).isNull()
    value = F.datediff(F.coalesce(day(a, b), day(b, a)), F.lit(FIRST_DAY).cast("date"))

    def shape(n: Column) -> Column:
        d = F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))
        other = F.when(swapped, F.date_format(d, "MM.dd.yyyy")).otherwise(F.date_format(d, "dd.MM.yyyy"))
        return F.when(iso, F.date_format(d, "yyyy-MM-dd")).otherwise(F.replace(other, F.lit("."), F.substring(x, 3, 1)))

    # A swapped day and month must stay one that reads only so, or it would be read the other way.
    fits = lambda n: (n < DAYS) & (~swapped | (F.day(F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))) > 12))
    new = lambda v: walk(F.lpad(v.cast("string"), 5, "0"), lambda s: feistel(s, DIGITS, key, "date"), lambda s: F.when(s.cast("int") < DAYS, fits(s.cast("int"))).otherwise(F.lit(False))).cast("int")
    return let(value, lambda v: F.when((v >= 0) & (v < DAYS), let(new(v), shape)))


def _email(x: Column, key: str) -> Column:
    local = F.substring_index(x, "@", 1)
    letters = let(F.lower(only(local, "A-Za-z")), lambda s: feistel(s, LETTERS, key, "mail"))
    digits = let(only(local, "0-9"), lambda s: feistel(s, DIGITS, key, "mail"))
    new = let(letters, lambda a: let(digits, lambda d: refill(refill(local, a, "A-Za-z"), d, "0-9")))
    return F.concat(new, F.substring(x, F.length(local) + 1, F.length(x)))


def _key(x: Column, key: str) -> Column:
    return F.concat(F.lit("AKIA"), let(F.substring(x, 5, 16), lambda s: feistel(s, CODES, key, "key")))


def _secret(x: Column, key: str) -> Column:
    value = F.regexp_extract(x, "[0-9a-f]{16,}$", 0)
    return F.concat(F.substring(x, F.lit(1), F.length(x) - F.length(value)), let(value, lambda s: feistel(s, HEX, key, "secret")))


KINDS = {"email": _email, "key": _key, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "abroad": _abroad, "card": _card}


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one candidate; null if it fails validation."""
    out = F.when(F.lit(False), value)
    for kind, f in KINDS.items():
        out = out.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), f(value, key))
    return out


def pseudonymize(docs: DataFrame, key: str, *, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the valid values in the text replaced, and their number in ``count_col``."""
    text = F.col(text_col)

    def rebuilt(found: Column) -> Column:
        parts = F.split(text, ANY)
        changed = F.transform(found, lambda x: F.struct(x.alias("old"), pseudonym(x, key).alias("new")))
        return let(changed, lambda c: F.struct(
            F.array_join(F.zip_with(parts, c, lambda p, x: F.concat(p, F.coalesce(x["new"], x["old"], F.lit("")))), "").alias("text"),
            F.size(F.filter(c, lambda x: x["new"].isNotNull())).cast("long").alias("n"),
        ))

    same = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
    result = F.when(text.rlike(MAYBE), let(F.regexp_extract_all(text, F.lit(ANY), 0), lambda m: F.when(F.size(m) > 0, rebuilt(m)).otherwise(same))).otherwise(same)
    rows = docs.select(whole_row(docs), result.alias("_new"))
    own = [F.col("_new.text").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns if c != count_col]
    return rows.select(*own, *([F.col("_new.n").alias(count_col)] if count_col else []))
