"""Format-preserving pseudonyms for personal data, in column expressions.

Method: one pattern finds candidates; each is validated by its kind.  Card numbers
pass the Luhn test, IBANs the remainder test, network addresses and dates must exist,
telephone numbers need ten to fifteen digits.  The digits of a valid value are a number
that a keyed Feistel network permutes among the numbers of the same format: rounds of
a keyed hash are added in turn to either half, modulo the size of that half.  Check
digits are then set anew, and the digits are laid into the separators of the original.
A permutation never maps two values to one, and equal values get equal pseudonyms in
every document, whatever their separators.  Dates are permuted among the days of four
centuries, addresses among all addresses, the last ten digits of a telephone number
among all such, and the first digit of a card number and the country of an IBAN stay.

E-mail names and secrets (passwords, tokens, access keys) have no number to permute.
Their letters and digits are replaced by keyed ones of the same class that depend on
the whole value, so equal values stay linked here too; the domain of an e-mail stays.

A candidate that fails its validation is read again as far as each of its separators: the
longest part that is a card or an IBAN, or a telephone number at its beginning, is
replaced, and the rest stays.  A value that fails that too stays as it is.  Dates with
slashes are read month first where that is a date, and stay among such dates; those that
are dates only day first are permuted among their like, by walking on until the result is
one, so no two of them come to print the same.  Every text is one row from scan to result;
nothing is shuffled.

Rows: a null text stays null, an empty one empty, both without findings.  Repeated rows
get equal results.  An empty table gives an empty result.  Other columns are not read
and may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
SECRET = r"(?i:password|passwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{8,}"
ACCESS_KEY = r"(?<![A-Za-z0-9])A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]|[./-][0-9])"
#: The usual groupings of a card, and bare digits, end where they end: what follows is read
#: for itself, apart from three digits that may belong to a card of nineteen.
_GROUPED = r"(?:[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4})(?![0-9]|[ -][0-9]{3}(?![0-9/.-]))"
_AMERICAN = r"(?:[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![0-9])"
CARD = rf"(?<![0-9+])(?:{_GROUPED}|{_AMERICAN}|[0-9]{{13,19}}(?![0-9])|[0-9](?:[ -]?[0-9]){{12,18}}(?![0-9]))"
PHONE = r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-][0-9]{4}(?![0-9])|\+[0-9]{10,15}(?![0-9])"
#: Patterns are grouped by what may begin them, so most places are passed at once.
NUMBER = "|".join(f"(?:{p})" for p in (ADDRESS, DATE, CARD, PHONE))
CANDIDATE = f"(?:{EMAIL})|(?=[pPsStTaA])(?:{SECRET})|(?=[A-Z]{{2}})(?:{ACCESS_KEY}|{IBAN})|(?=[0-9+(])(?:{NUMBER})"
#: What every text with a candidate has.
LIKELY = r"@|[0-9][0-9 ().-]{5,}[0-9]|[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{8}|A[KS]IA[0-9A-Z]{16}|[0-9]{2} ?[A-Z0-9]{4}|\+[0-9]{10}|[/-][0-9]{2}"

KINDS = ("email", "secret", "iban", "address", "date", "card", "phone")
_ROUNDS = 10
#: Days of the 400-year cycle 1700-2099, as the product of the two halves' sizes.
_FIRST_DAY, _DAY_HALVES = "1700-01-01", (189, 773)
#: Two days of five cannot be read month first, so nearly no walk is as long as this.
_MOST_STEPS = 64


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, tweak: Column, key: str) -> Column:
    """A keyed permutation of the pairs below ``left_size`` and ``right_size``, as ``l`` and ``r``."""

    def noise(r: Column, half: Column, size: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, r.cast("string"), half.cast("string")).cast("binary"), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size

    def turn(state: Column, r: Column) -> Column:
        new_left = F.when(r % 2 == 0, (state["l"] + noise(r, state["r"], left_size)) % left_size).otherwise(state["l"])
        new_right = F.when(r % 2 == 1, (state["r"] + noise(r, state["l"], right_size)) % right_size).otherwise(state["r"])
        return F.struct(new_left.alias("l"), new_right.alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(_ROUNDS - 1)), start, turn)


def permuted_digits(digits: Column, tweak: Column, key: str) -> Column:
    """A permutation of the digit strings of the same length, from 2 to 34."""
    ten = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")

    def moved(d: Column) -> Column:
        n = F.length(d)
        a = F.floor(n / 2).cast("int")
        left, right = F.substring(d, F.lit(1), a), F.substring(d, a + 1, n - a)
        pair = feistel(left.cast("long"), right.cast("long"), ten(a), ten(n - a), F.concat(tweak, n.cast("string")), key)
        return bound(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), a, "0"), F.lpad(p["r"].cast("string"), n - a, "0")))

    return bound(digits, moved)


def relaid(value: Column, pool: Column, where: str) -> Column:
    """``value`` with its characters of class ``where`` replaced by those of ``pool`` in turn."""

    def laid(p: Column) -> Column:
        def step(state: Column, c: Column) -> Column:
            hit = (F.length(c) > 0) & c.rlike(where)
            return F.struct(F.concat(state["out"], F.when(hit, F.substring(p, state["i"], F.lit(1))).otherwise(c)).alias("out"), (state["i"] + hit.cast("int")).alias("i"))

        return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), step)["out"]

    return bound(pool, laid)


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a number whose check digit is the last."""
    def total(number: Column) -> Column:
        n = F.length(number)

        def step(total: Column, i: Column) -> Column:
            d = F.substring(number, i, F.lit(1)).cast("int")
            doubled = F.when((n - i) % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
            return total + doubled

        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step)

    return bound(digits, total)


def _iban_remainder(text: Column) -> Column:
    """Remainder by 97 of digits and letters, letters as 10 to 35."""

    def step(total: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(F.length(c) == 0, total).when(code < 58, (total * 10 + code - 48) % 97).otherwise((total * 100 + code - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _card(value: Column, key: str) -> Column:
    def made(digits: Column) -> Column:
        first, middle = F.substring(digits, 1, 1), F.substring(digits, F.lit(2), F.length(digits) - 2)
        body = F.concat(first, permuted_digits(middle, F.concat(F.lit("card"), first), key))
        checked = bound(body, lambda b: F.concat(b, ((10 - _luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when((F.length(digits) > 12) & (_luhn_sum(digits) % 10 == 0), relaid(value, checked, "[0-9]"))

    return bound(F.regexp_replace(value, "[^0-9]", ""), made)


def _shorter(value: Column, where: str) -> Column:
    """The beginnings of a value that end before one of its separators, longest first."""
    ends = F.filter(F.sequence(F.lit(1), F.length(value)), lambda i: F.substring(value, i, F.lit(1)).rlike(where))
    return F.transform(F.reverse(ends), lambda i: F.substring(value, F.lit(1), i - 1))


def _longest(value: Column, where: str, make, key: str) -> Column:
    """The pseudonym of a value, or of its longest valid beginning with the rest behind it."""
    tried = F.filter(F.transform(_shorter(value, where), lambda v: F.struct(v.alias("v"), make(v, key).alias("new"))), lambda x: x["new"].isNotNull())
    rest = bound(F.get(tried, F.lit(0)), lambda x: F.concat(x["new"], F.substring(value, F.length(x["v"]) + 1, F.length(value))))
    return bound(make(value, key), lambda new: F.when(new.isNotNull(), new).otherwise(rest))


def _iban(value: Column, key: str) -> Column:
    def made(plain: Column) -> Column:
        country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain) - 4)
        valid = _iban_remainder(F.concat(account, F.substring(plain, 1, 4))) == 1
        digits = F.regexp_replace(account, "[^0-9]", "")
        moved = F.when(F.length(digits) > 1, relaid(account, permuted_digits(digits, F.concat(F.lit("iban"), country), key), "[0-9]")).otherwise(account)

        def checked(m: Column) -> Column:
            check = F.lpad((98 - _iban_remainder(F.concat(m, country, F.lit("00")))).cast("string"), 2, "0")
            return F.concat(country, check, m)

        return F.when(valid, relaid(value, bound(moved, checked), "[A-Z0-9]"))

    return bound(F.replace(value, F.lit(" "), F.lit("")), made)


def _address(value: Column, key: str) -> Column:
    def made(parts: Column) -> Column:
        part = lambda i: parts[i].cast("int")
        valid = ~value.rlike(r"(?:^|\.)0[0-9]") & (F.greatest(*[part(i) for i in range(4)]) < 256)
        size = F.lit(65536).cast("long")
        pair = feistel(part(0) * 256 + part(1), part(2) * 256 + part(3), size, size, F.lit("address"), key)
        shown = bound(pair, lambda p: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(p[h] / 256), p[h] % 256)]))
        return F.when(valid, shown)

    return bound(F.split(value, r"\."), made)


def _date(value: Column, key: str) -> Column:
    form = F.when(value.rlike("^[0-9]{4}-"), "yyyy-MM-dd").when(F.contains(value, F.lit("/")), "MM/dd/yyyy").otherwise("dd.MM.yyyy")
    day = F.coalesce(
        F.when(form == "yyyy-MM-dd", F.try_to_date(value, "yyyy-MM-dd")),
        F.when(form == "MM/dd/yyyy", F.coalesce(F.try_to_date(value, "MM/dd/yyyy"), F.try_to_date(value, "dd/MM/yyyy"))),
        F.when(form == "dd.MM.yyyy", F.try_to_date(value, "dd.MM.yyyy")),
    )
    number = F.datediff(day, F.lit(_FIRST_DAY).cast("date"))
    a, b = (F.lit(x).cast("long") for x in _DAY_HALVES)
    day_first = (form == "MM/dd/yyyy") & F.try_to_date(value, "MM/dd/yyyy").isNull()

    def turned(n: Column) -> Column:
        pair = feistel(F.floor(n / _DAY_HALVES[1]), F.pmod(n, F.lit(_DAY_HALVES[1])), a, b, F.lit("date"), key)
        return bound(pair, lambda p: (p["l"] * _DAY_HALVES[1] + p["r"]).cast("int"))

    def date_of(n: Column) -> Column:
        return F.date_add(F.lit(_FIRST_DAY).cast("date"), n)

    def walked(n: Column) -> Column:
        """On through the permutation until the date is one that cannot be read month first."""
        step = lambda at, _: F.when((at == n) | (F.day(date_of(at)) < 13), turned(at)).otherwise(at)
        return F.aggregate(F.sequence(F.lit(1), F.lit(_MOST_STEPS)), n, step)

    def shown(moved: Column) -> Column:
        iso = F.when(form == "yyyy-MM-dd", F.date_format(moved, "yyyy-MM-dd")).when(form == "dd.MM.yyyy", F.date_format(moved, "dd.MM.yyyy"))
        return iso.when(day_first, F.date_format(moved, "dd/MM/yyyy")).otherwise(F.date_format(moved, "MM/dd/yyyy"))

    def made(n: Column) -> Column:
        moved = bound(F.when(day_first, walked(n)).otherwise(turned(n)), date_of)
        return F.when((n >= 0) & (n < _DAY_HALVES[0] * _DAY_HALVES[1]), bound(moved, shown))

    return bound(number.cast("int"), made)


def _phone(value: Column, key: str) -> Column:
    def made(digits: Column) -> Column:
        n = F.length(digits)
        moved = F.concat(F.substring(digits, F.lit(1), n - 10), permuted_digits(F.substring(digits, n - 9, F.lit(10)), F.lit("phone"), key))
        return F.when((n >= 10) & (n <= 15), relaid(value, moved, "[0-9]"))

    return bound(F.regexp_replace(value, "[^0-9]", ""), made)


def _characters(value: Column, same: Column, key: str) -> Column:
    """``value`` with keyed letters and digits in the place of its own; ``same`` is what
    equal values have in common."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(value) / 32).cast("int")), lambda b: F.sha2(F.concat_ws("|", F.lit(key), b.cast("string"), same).cast("binary"), 256))

    def replaced(stream: Column, c: Column, i: Column) -> Column:
        pick = F.conv(F.substring(stream, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return F.when(c.rlike("[0-9]"), F.char((pick % 10 + 48).cast("long"))).when(c.rlike("[a-z]"), F.char((pick % 26 + 97).cast("long"))).when(c.rlike("[A-Z]"), F.char((pick % 26 + 65).cast("long"))).otherwise(c)

    return bound(F.array_join(blocks, ""), lambda stream: F.array_join(F.transform(F.split(value, ""), lambda c, i: replaced(stream, c, i)), ""))


def _email(value: Column, key: str) -> Column:
    name = F.lower(F.substring_index(value, "@", 1))
    return F.concat(_characters(name, F.concat(F.lit("email"), F.lower(value)), key), F.lit("@"), F.substring_index(value, "@", -1))


def _secret(value: Column, key: str) -> Column:
    head = F.regexp_extract(value, r"""^(?:(?i:password|passwd|secret|token|api[_-]?key)\s*[=:]\s*["']?|A[KS]IA)""", 0)
    rest = F.substring(value, F.length(head) + 1, F.length(value))
    return F.concat(head, _characters(rest, F.concat(F.lit("secret"), rest), key))


def pseudonym(value: Column, key: str) -> Column:
    """Kind and pseudonym of a candidate; both null if it fails its validation."""
    email, secret = value.rlike(f"^(?:{EMAIL})$"), value.rlike(f"^(?:(?:{SECRET})|(?:{ACCESS_KEY}))$")
    made = [
        ("email", email, _email),
        ("secret", secret, _secret),
        ("iban", value.rlike("^[A-Z]{2}[0-9]{2}"), lambda v, k: _longest(v, " ", _iban, k)),
        ("address", value.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), _address),
        ("date", value.rlike(f"^(?:{DATE})$"), _date),
    ]
    found = None
    for kind, is_kind, make in made:
        pair = F.struct(F.lit(kind).alias("kind"), make(value, key).alias("new"))
        found = F.when(is_kind, pair) if found is None else found.when(is_kind, pair)

    def card_or_phone(card: Column) -> Column:
        # digits that are no card may begin with a telephone number, if no group of four goes on
        number = F.regexp_extract(value, f"^(?:{PHONE})(?![ -][0-9]{{4}})", 0)
        phone = F.when(F.length(number) > 0, F.concat(_phone(number, key), F.substring(value, F.length(number) + 1, F.length(value))))
        return F.when(card.isNotNull(), F.struct(F.lit("card").alias("kind"), card.alias("new"))).otherwise(F.struct(F.lit("phone").alias("kind"), phone.alias("new")))

    found = found.when(value.rlike(f"^(?:{CARD})$"), bound(_longest(value, "[ -]", _card, key), card_or_phone))
    return found.otherwise(F.struct(F.lit("phone").alias("kind"), _phone(value, key).alias("new")))


def pseudonymised(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``text`` with pseudonyms, and how many values of each kind were replaced."""
    text = F.col("_text")
    source = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    likely = F.coalesce(text.rlike(LIKELY), F.lit(False))
    values = F.when(likely, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def shown(pair: Column, value: Column) -> Column:
        return F.struct(F.when(pair["new"].isNotNull(), pair["kind"]).alias("kind"), F.coalesce(pair["new"], value).alias("shown"))

    # the lists are made once for each row: an explode of one element is not merged
    # into the expressions that use it
    found = source.select("*", F.explode(F.array(values)).alias("_values"))
    found = found.select("*", F.explode(F.array(F.transform("_values", lambda v: pseudonym(v, key)))).alias("_pairs"))
    found = found.withColumn("_found", F.zip_with("_pairs", "_values", shown)).drop("_pairs", "_values")
    gaps = F.split(text, CANDIDATE, -1)
    parts = F.zip_with(gaps, "_found", lambda gap, x: F.concat(gap, F.coalesce(x["shown"], F.lit(""))))
    done = F.when(F.size("_found") > 0, F.array_join(parts, "")).otherwise(text)
    count = lambda kind: F.size(F.filter("_found", lambda x: x["kind"] == kind)).cast("long")
    return found.select(id_col, done.alias("text"), *[count(k).alias(f"n_{k}") for k in KINDS])
