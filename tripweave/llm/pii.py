"""Operator 4, personal data: format-preserving Feistel pseudonyms, in SQL expressions only.

One pattern finds candidates, each is validated (Luhn, mod 97, octets, calendar, number plans),
and what is valid is replaced by another valid value of the same format: its free digits are
two coordinates of a domain a x b, and rounds of keyed hashing add to one coordinate modulo its
size what the other one hashes to. Each round can be undone, so the whole is a permutation of
the domain under the key: equal values stay equal everywhere, different ones different.

    kind    valid if                           kept              permuted
    email   local part, @, domain              domain, shape     letters and digits before the @
    ipv4    four octets, no leading zeros      -                 the 32 bits
    date    in the calendar, 1900 to 2099      order, separators the day among all of these
    ssn     no reserved area, group, serial    separators        area, group and serial
    phone   3-3-4 digits, neither part in 0, 1 country code      all others but those first digits
    card    13 to 19 digits, Luhn              first digit       the others; the check digit fits
    iban    mod 97 is 1                        country, letters  digits; the check digits fit
    intl    + and 8 to 15 digits               all but seven     the last seven digits

Of an email's local part, up to 24 letters (12 if digits take part) are permuted.

Defined results: a null text stays null with no values; candidates that are not valid stay as
they are; any length of text is taken whole; rows are independent, so repeats agree; columns
other than the text pass through, and a column with the name of the count is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of the network; eight and more are usual for small domains.
ROUNDS = 10

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]\d|\d)"
# No start inside a run and no way back into it: a long run without an @ is read once.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IPV4 = rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)"
DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d./])\d{2}(?<s>[./])\d{2}\k<s>\d{4}(?![\d./]\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d(+-])(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?!\d|-\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}(?<c>[ -])\d{4}\k<c>\d{4}\k<c>\d{4}|\d{4}(?<e>[ -])\d{6}\k<e>\d{5})(?!\d)"
INTL = r"(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)"
CANDIDATE = "|".join([EMAIL, IPV4, DATE, SSN, PHONE, IBAN, CARD, INTL])

_FIRST_DAY, _DAYS = "1900-01-01", 73049  # 229 x 319 days, to 2099-12-31


def _number(digits: Column) -> Column:
    return F.coalesce(digits.cast("long"), F.lit(0).cast("long"))


def _pow(base: int, n: Column) -> Column:
    return F.pow(F.lit(float(base)), n.cast("double")).cast("long")


def _mixed(key: str, kind: Column, i: Column, x: Column) -> Column:
    """60 bits of a keyed hash, nested as in HMAC."""
    inner = F.sha2(F.concat_ws("|", F.lit(f"in:{key}"), kind, i.cast("string"), x.cast("string")), 256)
    outer = F.sha2(F.concat(F.lit(f"out:{key}"), inner), 256)
    return F.conv(F.substring(outer, 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: Column, a: Column, b: Column, x: Column, y: Column) -> Column:
    """A keyed permutation of the pairs (x, y) with x below a and y below b, as a struct."""

    def turn(s: Column, i: Column) -> Column:
        left = F.struct(
            ((s["x"] + _mixed(key, kind, i, s["y"]) % a) % a).alias("x"), s["y"].alias("y")
        )
        right = F.struct(
            s["x"].alias("x"), ((s["y"] + _mixed(key, kind, i, s["x"]) % b) % b).alias("y")
        )
        return F.when(i % 2 == 0, left).otherwise(right)

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo ten."""
    def part(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    parts = F.transform(F.reverse(F.split(digits, "")), part)
    return F.aggregate(parts, F.lit(0), lambda s, d: s + d) % 10


def _mod97(text: Column) -> Column:
    """A string of digits and capital letters, letters as 10 to 35, modulo 97."""
    def add(s: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + letter) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _refill(shape: Column, digits: Column, letters: Column | None = None) -> Column:
    """``shape`` with its digits (and letters, if given) replaced in turn by others."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("d"), F.lit(1).alias("l"))

    def step(s: Column, c: Column) -> Column:
        put = F.struct(F.concat(s["out"], F.substr(digits, s["d"], F.lit(1))).alias("out"), (s["d"] + 1).alias("d"), s["l"].alias("l"))
        keep = F.struct(F.concat(s["out"], c).alias("out"), s["d"].alias("d"), s["l"].alias("l"))
        if letters is None:
            return F.when(c.rlike("[0-9]"), put).otherwise(keep)
        new = F.substr(letters, s["l"], F.lit(1))
        new = F.when(c.rlike("[A-Z]"), F.upper(new)).otherwise(new)
        swap = F.struct(F.concat(s["out"], new).alias("out"), s["d"].alias("d"), (s["l"] + 1).alias("l"))
        return F.when(c.rlike("[0-9]"), put).when(c.rlike("[A-Za-z]"), swap).otherwise(keep)

    return F.aggregate(F.split(shape, ""), start, step)["out"]


_AZ, _26 = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"


def _letters_to_number(letters: Column) -> Column:
    return F.coalesce(F.conv(F.translate(letters, _AZ, _26), 26, 10).cast("long"), F.lit(0).cast("long"))


def _number_to_letters(number: Column, n: Column) -> Column:
    based = F.lower(F.conv(number.cast("string"), 10, 26))
    return F.when(n > 0, F.translate(F.lpad(based, n, "0"), _26, _AZ)).otherwise("")


def _pad(number: Column, n: Column) -> Column:
    return F.when(n > 0, F.lpad(number.cast("string"), n, "0")).otherwise("")


def _part(text: Column, start: Column | int, n: Column | int) -> Column:
    return F.substr(text, F.lit(start) if isinstance(start, int) else start, F.lit(n) if isinstance(n, int) else n)


def _day(m: Column) -> Column:
    """The date that a candidate spells, null if it is not in the calendar."""
    iso = m.rlike(r"^\d{4}-")
    dotted = F.concat_ws("-", _part(m, 7, 4), _part(m, 4, 2), _part(m, 1, 2))
    slashed = F.concat_ws("-", _part(m, 7, 4), _part(m, 1, 2), _part(m, 4, 2))
    shown = F.when(iso, m).when(m.contains("."), dotted).otherwise(slashed)
    return F.try_to_date(shown, "yyyy-MM-dd")


class _Kind:
    """How values of one kind are recognised, seen as a pair of numbers, and written."""

    def __init__(self, name: str, valid: Callable, domain: Callable, write: Callable):
        self.name, self.valid, self.domain, self.write = name, valid, domain, write


def _halves(n: Column) -> tuple[Column, Column]:
    low = F.floor(n / 2).cast("int")
    return low, n.cast("int") - low


def _digit_domain(digits: Column) -> tuple[Column, ...]:
    u, v = _halves(F.length(digits))
    return _pow(10, u), _pow(10, v), _number(_part(digits, 1, u)), _number(_part(digits, u + 1, v))


def _digits_of(pair: Column, n: Column) -> Column:
    u, v = _halves(n)
    return F.concat(_pad(pair["x"], u), _pad(pair["y"], v))


def _constant(*sizes: int) -> tuple[Column, ...]:
    return tuple(F.lit(s).cast("long") for s in sizes)


def _whole(pattern: str) -> Callable:
    return lambda m, d: m.rlike(f"^(?:{pattern})$")


def _email_sizes(m: Column) -> tuple[Column, ...]:
    local = F.substring_index(m, "@", 1)
    letters = F.lower(F.regexp_replace(local, "[^A-Za-z]", ""))
    digits = F.substring(F.regexp_replace(local, "[^0-9]", ""), 1, 15)
    n, k = F.length(letters), F.length(digits)
    both = (n > 0) & (n <= 12) & (k > 0)
    return local, letters, digits, F.least(n, F.lit(24)), k, both


def _email_domain(m: Column, d: Column) -> tuple[Column, ...]:
    _, letters, digits, n, k, both = _email_sizes(m)
    u, v = _halves(n)
    du, dv = _halves(k)
    only = n == 0
    a = F.when(both, _pow(26, n)).when(only, _pow(10, du)).otherwise(_pow(26, u))
    b = F.when(both, _pow(10, k)).when(only, _pow(10, dv)).otherwise(_pow(26, v))
    x = F.when(both, _letters_to_number(letters)).when(only, _number(_part(digits, 1, du))).otherwise(_letters_to_number(_part(letters, 1, u)))
    y = F.when(both, _number(digits)).when(only, _number(_part(digits, du + 1, dv))).otherwise(_letters_to_number(_part(letters, u + 1, v)))
    return a, b, x, y


def _email_write(m: Column, d: Column, pair: Column) -> Column:
    local, letters, digits, n, k, both = _email_sizes(m)
    u, v = _halves(n)
    only = n == 0
    new = F.when(both, _number_to_letters(pair["x"], n)).when(only, F.lit("")).otherwise(
        F.concat(_number_to_letters(pair["x"], u), _number_to_letters(pair["y"], v))
    )
    numbers = F.when(both, _pad(pair["y"], k)).when(only, _digits_of(pair, k)).otherwise(digits)
    tail = F.regexp_replace(local, "[^0-9]", "")
    filled = _refill(
        local, F.concat(numbers, _part(tail, k + 1, F.length(tail))),
        F.concat(new, _part(letters, n + 1, F.length(letters))),
    )
    return F.concat(filled, _part(m, F.length(local) + 1, F.length(m)))


def _ipv4_domain(m: Column, d: Column) -> tuple[Column, ...]:
    octet = [F.split(m, r"\.")[i].cast("long") for i in range(4)]
    return *_constant(65536, 65536), octet[0] * 256 + octet[1], octet[2] * 256 + octet[3]


def _ipv4_write(m: Column, d: Column, pair: Column) -> Column:
    x, y = pair["x"], pair["y"]
    return F.concat_ws(".", *[c.cast("long").cast("string") for c in (F.floor(x / 256), x % 256, F.floor(y / 256), y % 256)])


def _date_valid(m: Column, d: Column) -> Column:
    day = F.datediff(_day(m), F.lit(_FIRST_DAY).cast("date"))
    return m.rlike(f"^(?:{DATE})$") & F.coalesce(day.between(0, _DAYS - 1), F.lit(False))


def _date_domain(m: Column, d: Column) -> tuple[Column, ...]:
    day = F.datediff(_day(m), F.lit(_FIRST_DAY).cast("date")).cast("long")
    return *_constant(229, 319), F.floor(day / 319).cast("long"), day % 319


def _date_write(m: Column, d: Column, pair: Column) -> Column:
    day = F.date_add(F.lit(_FIRST_DAY).cast("date"), (pair["x"] * 319 + pair["y"]).cast("int"))
    return (
        F.when(m.rlike(r"^\d{4}-"), F.date_format(day, "yyyy-MM-dd"))
        .when(m.contains("."), F.date_format(day, "dd.MM.yyyy"))
        .otherwise(F.date_format(day, "MM/dd/yyyy"))
    )


def _ssn_valid(m: Column, d: Column) -> Column:
    return m.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$")


def _ssn_domain(m: Column, d: Column) -> tuple[Column, ...]:
    area = _number(_part(d, 1, 3))
    x = F.when(area > 666, area - 2).otherwise(area - 1)
    return *_constant(898, 99 * 9999), x, (_number(_part(d, 4, 2)) - 1) * 9999 + _number(_part(d, 6, 4)) - 1


def _ssn_write(m: Column, d: Column, pair: Column) -> Column:
    area = F.when(pair["x"] >= 665, pair["x"] + 2).otherwise(pair["x"] + 1)
    group = F.floor(pair["y"] / 9999) + 1
    return _refill(m, F.concat(
        _pad(area, F.lit(3)), _pad(group, F.lit(2)), _pad(pair["y"] % 9999 + 1, F.lit(4))
    ))


def _phone_domain(m: Column, d: Column) -> tuple[Column, ...]:
    own = F.right(d, F.lit(10))
    return *_constant(800, 8_000_000), _number(_part(own, 1, 3)) - 200, _number(_part(own, 4, 7)) - 2_000_000


def _phone_write(m: Column, d: Column, pair: Column) -> Column:
    country = _part(d, F.lit(1), F.length(d) - 10)
    return _refill(m, F.concat(
        country, _pad(pair["x"] + 200, F.lit(3)), _pad(pair["y"] + 2_000_000, F.lit(7))
    ))


def _card_valid(m: Column, d: Column) -> Column:
    return m.rlike(f"^(?:{CARD})$") & (_luhn(d) == 0)


def _card_domain(m: Column, d: Column) -> tuple[Column, ...]:
    return _digit_domain(_part(d, F.lit(2), F.length(d) - 2))


def _card_write(m: Column, d: Column, pair: Column) -> Column:
    body = F.concat(_part(d, 1, 1), _digits_of(pair, F.length(d) - 2))
    check = (10 - _luhn(F.concat(body, F.lit("0")))) % 10
    return _refill(m, F.concat(body, check.cast("string")))


def _iban_valid(m: Column, d: Column) -> Column:
    flat = F.replace(m, F.lit(" "), F.lit(""))
    moved = F.concat(_part(flat, 5, F.length(flat)), _part(flat, 1, 4))
    return m.rlike(f"^(?:{IBAN})$") & (_mod97(moved) == 1)


def _iban_domain(m: Column, d: Column) -> tuple[Column, ...]:
    return _digit_domain(_part(d, 3, F.length(d)))


def _iban_write(m: Column, d: Column, pair: Column) -> Column:
    body = _digits_of(pair, F.length(d) - 2)
    open_ = F.replace(_refill(m, F.concat(F.lit("00"), body)), F.lit(" "), F.lit(""))
    moved = F.concat(_part(open_, 5, F.length(open_)), _part(open_, 1, 4))
    check = _pad(98 - _mod97(moved), F.lit(2))
    return _refill(m, F.concat(check, body))


def _intl_valid(m: Column, d: Column) -> Column:
    return m.rlike(f"^(?:{INTL})$") & F.length(d).between(8, 15)


def _intl_domain(m: Column, d: Column) -> tuple[Column, ...]:
    return _digit_domain(F.right(d, F.lit(7)))


def _intl_write(m: Column, d: Column, pair: Column) -> Column:
    kept = _part(d, F.lit(1), F.length(d) - 7)
    return _refill(m, F.concat(kept, _digits_of(pair, F.lit(7))))


KINDS = [
    _Kind("email", _whole(EMAIL), _email_domain, _email_write),
    _Kind("ipv4", _whole(IPV4), _ipv4_domain, _ipv4_write),
    _Kind("date", _date_valid, _date_domain, _date_write),
    _Kind("ssn", _ssn_valid, _ssn_domain, _ssn_write),
    _Kind("phone", _whole(PHONE), _phone_domain, _phone_write),
    _Kind("card", _card_valid, _card_domain, _card_write),
    _Kind("iban", _iban_valid, _iban_domain, _iban_write),
    _Kind("intl", _intl_valid, _intl_domain, _intl_write),
]


def _choose(kind: Column, pick: Callable) -> Column:
    out = None
    for k in KINDS:
        out = F.when(kind == k.name, pick(k)) if out is None else out.when(kind == k.name, pick(k))
    return out


def _replaced(found: Column, key: str) -> Column:
    """An array of structs (m, kind, new) for an array of candidates."""

    def named(m: Column) -> Column:
        digits = F.regexp_replace(m, "[^0-9]", "")
        kind = None
        for k in KINDS:
            hit = k.valid(m, digits)
            kind = F.when(hit, k.name) if kind is None else kind.when(hit, k.name)
        return F.struct(m.alias("m"), digits.alias("d"), kind.alias("kind"))

    def placed(s: Column) -> Column:
        parts = ["a", "b", "x", "y"]
        domain = _choose(s["kind"], lambda k: F.struct(*[
            c.cast("long").alias(n) for n, c in zip(parts, k.domain(s["m"], s["d"]), strict=True)
        ]))
        return F.struct(s.alias("s"), domain.alias("p"))

    def permuted(t: Column) -> Column:
        p, s = t["p"], t["s"]
        return F.struct(s.alias("s"), F.when(
            s["kind"].isNotNull(), feistel(key, s["kind"], p["a"], p["b"], p["x"], p["y"])
        ).alias("pair"))

    def written(t: Column) -> Column:
        s = t["s"]
        new = _choose(s["kind"], lambda k: k.write(s["m"], s["d"], t["pair"]))
        return F.struct(s["m"].alias("m"), s["kind"].alias("kind"), F.coalesce(new, s["m"]).alias("new"))

    out = found
    for step in (named, placed, permuted, written):
        out = F.transform(out, step)
    return out


def pseudonymize(
    df: DataFrame, key: str, text: str = "text", count: str = "n_pseudonyms"
) -> DataFrame:
    """``df`` with the values in ``text`` replaced under ``key``; ``count`` tells how many.

    Texts without a digit or an @ hold no candidate and skip the search. The key is part of the
    plan; give each release its own, from wherever secrets are kept.
    """
    body = F.col(f"`{text}`")
    some = body.rlike("[0-9@]")
    found = F.when(some, F.regexp_extract_all(body, F.lit(CANDIDATE), F.lit(0)))
    made = "_pseudonyms"
    while made in df.columns:
        made += "_"
    work = df.select(
        *[F.col(f"`{c}`") for c in df.columns if c != count],
        F.when(F.size(found) > 0, _replaced(found, key)).alias(made),
    )
    gaps = F.split(body, CANDIDATE, -1)
    news = F.transform(F.col(made), lambda s: s["new"])
    joined = F.array_join(
        F.zip_with(gaps, F.concat(news, F.array(F.lit(""))), lambda g, r: F.concat(g, r)), ""
    )
    hits = F.filter(F.col(made), lambda s: s["kind"].isNotNull())
    return work.select(
        *[
            F.when(F.col(made).isNull(), body).otherwise(joined).alias(c)
            if c == text else F.col(f"`{c}`")
            for c in df.columns if c != count
        ],
        F.coalesce(F.when(F.col(made).isNotNull(), F.size(hits)), F.lit(0)).cast("long").alias(count),
    )
