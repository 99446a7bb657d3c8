r"""Personal data: format-preserving pseudonyms. DataFrame functions only.

Numbers and dates that pass their kind's validity rule are permuted within their kind's valid values by a keyed Feistel network, so
a value always gets the same pseudonym, different values get different ones, and the pseudonym has the format and passes the
rule. A network's state is a pair (x, y) of numbers below (a, b); each round adds a keyed hash of one half to the other, modulo its bound. Addresses of
mail and secrets have no such domain; they get keyed hashes. One regular expression finds all kinds; a text is
cut there and put together again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Dates from FIRST_DAY on, DAYS * DAYS of them, are permuted (1600-01-01 to 2204-10-19).
FIRST_DAY, DAYS = "1600-01-01", 470
MONTHS = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
#: What a date looks like and how it reads; of two readings of one look the first that gives a date counts.
DATE_FORMATS = (
    (r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"), (r"\d{4}/\d{2}/\d{2}", "yyyy/MM/dd"), (r"\d{2}/\d{2}/\d{4}", "dd/MM/yyyy"), (r"\d{2}/\d{2}/\d{4}", "MM/dd/yyyy"), (r"\d{2}\.\d{2}\.\d{4}", "dd.MM.yyyy"),
    (rf"\d{{1,2}} {MONTHS} \d{{4}}", "d MMM yyyy"), (rf"{MONTHS} \d{{1,2}}, \d{{4}}", "MMM d, yyyy"),
)
#: Digits in the groups of a card number, as printed.
CARD_LAYOUTS = ("4,4,4,4", "4,4,4,4,3", "4,6,5", "4,6,4", *map(str, range(13, 20)))
NAMED = r"password|passwd|pwd|secret|token|api[_-]?key"
H = "[0-9A-Fa-f]{1,4}"

#: kind: what it looks like. Where two start at one place the earlier kind wins.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "secret": rf"\bAKIA[0-9A-Z]{{16}}\b|\bgh[opusr]_[A-Za-z0-9]{{36}}\b|\bxox[abeprs]-[A-Za-z0-9-]{{10,}}|\bAIza[A-Za-z0-9_-]{{35}}|\beyJ[A-Za-z0-9_-]{{8,}}\.eyJ[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}|\bsk-[A-Za-z0-9_-]{{20,}}|(?i:\b(?:{NAMED})\b *[=:] *)\"?[^\s\"]{{6,}}\"?",
    "iban": r"\b[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)\b",
    "date": rf"(?<![\d./-])(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{4}}/\d{{2}}/\d{{2}}|\d{{2}}/\d{{2}}/\d{{4}}|\d{{2}}\.\d{{2}}\.\d{{4}})(?![\d/-])|(?<!\d)\d{{1,2}} {MONTHS} \d{{4}}(?!\d)|\b{MONTHS} \d{{1,2}}, \d{{4}}(?!\d)",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)",
    "ipv6": rf"(?<![\w:.])(?:{H}(?::{H}){{7}}|(?:{H}(?::{H}){{0,5}})?::(?:{H}(?::{H}){{0,5}})?)(?![\w:])",
    "ssn": r"(?<![\d-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4})(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{2,5}\)?){2,5}(?!\d)|(?<!\d |[\w+])0\d{2,4} \d{3,4} \d{3,4}(?![ ]?\d)",
    "card": r"(?<![\w])\d(?:[ -]?\d){12,38}(?![\w])",
}
ANY = "|".join(PATTERNS.values())
#: A text without any of these has nothing that ANY finds.
HINT = r"[0-9@:]|AKIA|gh[opusr]_|sk-|xox|AIza|eyJ|(?i:passw|pwd|secret|token|api[_-]?key)"
COUNTS = tuple(f"n_{k}" for k in PATTERNS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def refill(shape: Column, new: Column) -> Column:
    """shape with its digits replaced in order by those of new."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("i"))

    def step(state: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        s = F.concat(state["s"], F.when(is_digit, F.substring(new, state["i"] + 1, F.lit(1))).otherwise(c))
        return F.struct(s.alias("s"), (state["i"] + is_digit.cast("int")).alias("i"))

    return F.aggregate(F.split(shape, ""), start, step, lambda state: state["s"])


def feistel(x: Column, y: Column, a: Column, b: Column, key: str, kind: str, beside: Column | None = None) -> Column:
    """A keyed permutation of the pairs (x, y) with 0 <= x < a and 0 <= y < b, as a struct of longs; another for each text beside. a and b are at most 10 ** 15."""
    more = [] if beside is None else [beside]

    def keyed(r: Column, half: Column, bound: Column) -> Column:
        said = F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), a.cast("string"), b.cast("string"), half.cast("string"), *more)
        return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long") % bound

    def step(state: Column, r: Column) -> Column:
        sx, sy = state["x"], state["y"]
        odd = r % 2 == 1
        return F.struct(
            F.when(odd, (sx + keyed(r, sy, a)) % a).otherwise(sx).alias("x"),
            F.when(odd, sy).otherwise((sy + keyed(r, sx, b)) % b).alias("y"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), step)


def permute_digits(number: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the digit strings of the length of number (2 to 30 digits)."""
    n = F.length(number)
    half = F.floor(n / 2).cast("int")
    bound = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    x, y = F.substring(number, F.lit(1), half).cast("long"), F.substring(number, half + 1, n - half).cast("long")
    new = feistel(x, y, bound(half), bound(n - half), key, kind)
    return let(new, lambda s: F.concat(F.lpad(s["x"].cast("string"), half, "0"), F.lpad(s["y"].cast("string"), n - half, "0")))


def luhn_sum(number: Column, doubled: int) -> Column:
    """The Luhn sum of a digit string; from the right, digits at places of the parity `doubled` count twice."""
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: let(c.cast("int") * F.when(i % 2 == doubled, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d)


def mod97(text: Column) -> Column:
    """The ISO 7064 remainder of a string of digits and capitals (A is 10, Z is 35)."""

    def step(rest: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def card(m: Column, key: str) -> Column:
    """Every stretch of whole groups that is laid out as a card number and has the right check digit: its first digit stays, its check digit is made to fit."""

    def new(n: Column) -> Column:
        body = F.concat(F.substring(n, 1, 1), permute_digits(F.substring(n, F.lit(2), F.length(n) - 2), key, "card"))
        return let(body, lambda c: F.concat(c, ((10 - luhn_sum(c, 0) % 10) % 10).cast("string")))

    def stretches(sizes: Column, n: Column) -> Column:
        """start, size of the stretches, those that begin first and are shorter before the others."""
        places = F.sequence(F.lit(0), F.size(sizes) - 1)
        start = lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, x: a + x)
        some = lambda i, j: F.slice(sizes, i + 1, j - i + 1)
        found = F.flatten(
            F.transform(
                places,
                lambda i: F.transform(
                    F.filter(places, lambda j: (j >= i) & (j < i + 5) & F.array_join(some(i, j).cast("array<string>"), ",").isin(*CARD_LAYOUTS)),
                    lambda j: F.struct(start(i).alias("start"), F.aggregate(some(i, j), F.lit(0), lambda a, x: a + x).alias("size")),
                ),
            )
        )
        part = lambda s: F.substring(n, s["start"] + 1, s["size"])
        return F.filter(found, lambda s: (F.substring(part(s), 1, 1) > "0") & (luhn_sum(part(s), 1) % 10 == 0))

    def replaced(n: Column, found: Column) -> Column:
        """n with the stretches replaced, but for those that lie in one replaced before."""

        def step(state: Column, s: Column) -> Column:
            end = s["start"] + s["size"]
            text = F.concat(F.substring(state["text"], F.lit(1), s["start"]), new(F.substring(n, s["start"] + 1, s["size"])), F.substring(n, end + 1, F.length(n)))
            free = s["start"] >= state["end"]
            return F.struct(F.when(free, text).otherwise(state["text"]).alias("text"), F.when(free, end).otherwise(state["end"]).alias("end"))

        return F.aggregate(found, F.struct(n.alias("text"), F.lit(0).alias("end")), step, lambda s: s["text"])

    sizes = F.transform(F.split(m, "[ -]"), F.length)
    return let(stretches(sizes, digits(m)), lambda found: F.when(F.size(found) > 0, refill(m, replaced(digits(m), found))))


def ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.substring(m, at, k).cast("long") for at, k in ((1, 3), (5, 2), (8, 4)))
    at = area - 1 - F.when(area > 666, 1).otherwise(0)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)

    def text(s: Column) -> Column:
        at = F.floor(s["x"] / 99) + 1
        return F.format_string("%03d-%02d-%04d", F.when(at >= 666, at + 1).otherwise(at), s["x"] % 99 + 1, s["y"] + 1)

    return F.when(valid, refill(m, digits(let(feistel(at * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn"), text))))


def phone(m: Column, key: str) -> Column:
    """Numbers of the North American plan keep their country code (areas and exchanges are 200 to 999); of others, all but the first three digits change."""
    n = digits(m)
    ten = F.substring(n, F.length(n) - 9, F.lit(10))
    area, exchange, line = (F.substring(ten, at, k).cast("long") for at, k in ((1, 3), (4, 3), (7, 4)))
    american = ((F.length(n) == 10) | (F.length(n) == 11) & n.startswith("1")) & (area >= 200) & (exchange >= 200)
    made = let(
        feistel((area - 200) * 800 + exchange - 200, line, F.lit(640_000), F.lit(10_000), key, "phone"),
        lambda s: F.format_string("%03d%03d%04d", F.floor(s["x"] / 800) + 200, s["x"] % 800 + 200, s["y"]),
    )
    american_new = refill(m, F.concat(F.substring(n, F.lit(1), F.length(n) - 10), made))
    other_new = refill(m, F.concat(F.substring(n, 1, 3), permute_digits(F.substring(n, F.lit(4), F.length(n) - 3), key, "phone")))
    other = m.startswith("+") & F.length(n).between(8, 15) & ~n.startswith("1") | m.startswith("0") & F.length(n).between(10, 11)
    return F.when(american, american_new).when(other, other_new)


def ip(m: Column, key: str) -> Column:
    part = F.transform(F.split(m, "\\."), lambda p: p.cast("long"))
    at = [F.get(part, F.lit(i)) for i in range(4)]
    new = let(
        feistel(at[0] * 256 + at[1], at[2] * 256 + at[3], F.lit(65_536), F.lit(65_536), key, "ip"),
        lambda s: F.concat_ws(".", *(v.cast("string") for v in (F.floor(s["x"] / 256), s["x"] % 256, F.floor(s["y"] / 256), s["y"] % 256))),
    )
    return F.when(F.forall(part, lambda p: p <= 255), new)


def ipv6(m: Column, key: str) -> Column:
    """An address in any spelling becomes one of eight groups: each half is permuted beside the other. The loopback and the empty address stay; a shortened one
    needs a digit and a group of three digits or more, so that names like a::b stay, too."""
    sides = F.split(m, "::")
    groups = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ":"))
    left, right = groups(sides[0]), F.when(F.size(sides) > 1, groups(F.get(sides, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    gap = 8 - F.size(left) - F.size(right)
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right)
    valid = F.when(F.size(sides) > 1, (gap > 0) & m.rlike("[0-9]") & m.rlike("[0-9A-Fa-f]{3}")).otherwise(gap == 0)

    def made(part: Column) -> Column:
        number = lambda i: part[i] * 65_536 + part[i + 1]
        half = lambda i, beside: feistel(number(i), number(i + 2), F.lit(1 << 32), F.lit(1 << 32), key, "ipv6", beside)
        text = lambda s: F.concat_ws(":", *(F.lower(F.hex(v)) for x in ("x", "y") for v in (F.floor(s[x] / 65_536), s[x] % 65_536)))
        high = F.concat_ws(":", *(part[i].cast("string") for i in range(4)))
        return let(text(half(4, high)), lambda low: F.concat_ws(":", let(half(0, low), text), low))

    numbers = F.transform(whole, lambda g: F.conv(g, 16, 10).cast("long"))
    return F.when(valid & F.exists(F.slice(numbers, 1, 7), lambda g: g > 0), let(numbers, made))


def date(m: Column, key: str) -> Column:
    out = []
    for shape, form in DATE_FORMATS:
        at = F.datediff(F.try_to_date(m, form), F.lit(FIRST_DAY).cast("date")).cast("long")
        day = let(feistel(F.floor(at / DAYS), at % DAYS, F.lit(DAYS), F.lit(DAYS), key, "date"), lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["x"] * DAYS + s["y"]).cast("int")))
        out.append(F.when(m.rlike(f"^{shape}$") & at.between(0, DAYS * DAYS - 1), F.date_format(day, form)))
    return F.coalesce(*out)


def iban(m: Column, key: str) -> Column:
    """The digits of the account part change, its letters and the country stay, the check digits are made to fit. Of groups printed apart the last may be another word."""

    def one(m: Column) -> Column:
        bare = F.replace(m, F.lit(" "), F.lit(""))
        country, rest = F.substring(m, 1, 2), F.substring(bare, F.lit(5), F.length(bare) - 4)
        valid = F.length(rest).between(11, 30) & (mod97(F.concat(rest, F.substring(m, 1, 4))) == 1)

        def whole(new: Column) -> Column:
            check = 98 - mod97(F.concat(F.replace(new, F.lit(" "), F.lit("")), country, F.lit("00")))
            return F.concat(country, F.lpad(check.cast("string"), 2, "0"), new)

        changed = refill(F.substring(m, F.lit(5), F.length(m) - 4), permute_digits(digits(rest), key, "iban"))
        return F.when(valid & F.length(digits(rest)).between(2, 30), let(changed, whole))

    last = F.regexp_extract(m, " [A-Z0-9]{1,4}$", 0)
    less = F.substring(m, F.lit(1), F.length(m) - F.length(last))
    return F.coalesce(one(m), F.when(F.length(last) > 0, F.concat(one(less), last)))


def email(m: Column, key: str) -> Column:
    """Hexadecimal digits in place of what stands before the @ (as many, twelve at least), and a domain that cannot exist."""
    hashed = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256)
    return F.concat(F.substring(hashed, F.lit(1), F.greatest(F.lit(12), F.locate("@", m) - 1)), F.lit("@example.invalid"))


def secret(m: Column, key: str) -> Column:
    """What names the secret stays; the value becomes hexadecimal digits, as many as it had characters."""
    head = F.regexp_extract(m, rf"(?i)^((?:{NAMED}) *[=:] *\"?|AKIA|gh[opusr]_|sk-|xox[abeprs]-|AIza|eyJ)", 1)
    value = F.regexp_replace(F.substring(m, F.length(head) + 1, F.length(m)), r'"$', "")
    tail = F.when(m.endswith('"'), F.lit('"')).otherwise("")
    hashed = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), value), 256)
    hashed = F.when(head == "AKIA", F.upper(hashed)).otherwise(hashed)
    return F.concat(head, F.rpad(hashed, F.length(value), hashed), tail)


KINDS = {"email": email, "secret": secret, "iban": iban, "date": date, "ip": ip, "ipv6": ipv6, "ssn": ssn, "phone": phone, "card": card}


def pseudonym(m: Column, key: str) -> Column:
    """struct(kind, value) of a match of ANY: what stands for it. kind is null and the value as it was where no validity rule passes."""
    options = []
    for kind, make in KINDS.items():
        fits = m.rlike(f"^(?:{PATTERNS[kind]})$")
        options.append(F.when(fits, make(m, key)))
    made = F.array(*options)
    none = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value"))
    names = F.array(*map(F.lit, KINDS))
    first = F.filter(F.zip_with(names, made, lambda k, v: F.struct(k.alias("kind"), v.alias("value"))), lambda s: s["value"].isNotNull())
    return F.coalesce(F.get(first, F.lit(0)), none)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with pseudonyms in text, and COUNTS: how many values of each kind were replaced.

    Numbers that fail their kind's rule stay as they are. Equal values get equal pseudonyms, however they are printed; dates keep their format, and as days and months can't
    always be told apart (05/06/1999), the day counts as first where it can be. Names, addresses of houses and the like have no format and are not
    looked for. The key is a literal of the plan: keep it out of the code (the query takes it from the setting scanspark.pseudonym.key), and plans and event
    logs out of others' hands (spark.redaction.string.regex). A null text stays null, with counts of 0. Repeated rows get the same text. Columns of
    docs with the names of COUNTS are replaced. No row moves: the operator is one projection.
    """
    names = [c for c in docs.columns if c not in COUNTS]
    text = F.col("text")
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    out = docs.select(*names, found.alias("__found"))
    hits = F.when(F.size("__found") > 0, F.transform("__found", lambda m: pseudonym(m, key)))
    out = out.select(*names, hits.alias("__hits"))
    gaps = F.split(text, ANY)
    values = F.concat(F.transform("__hits", lambda h: h["value"]), F.array(F.lit("")))
    new = F.array_join(F.flatten(F.zip_with(gaps, values, lambda g, v: F.array(g, v))), "")
    return out.select(*(F.coalesce(F.when(F.col("__hits").isNotNull(), new), text).alias("text") if c == "text" else c for c in names), *map(_count, KINDS))


def _count(kind: str) -> Column:
    n = F.size(F.filter("__hits", lambda h: h["kind"] == kind))
    return F.when(F.col("__hits").isNull(), 0).otherwise(n).cast("long").alias(f"n_{kind}")
