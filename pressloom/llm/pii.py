"""Format-preserving pseudonyms for numbers and dates in texts.

Card numbers that pass the Luhn check, North American telephone numbers, IPv4
addresses, social security numbers and calendar dates are found, validated and
permuted under a key within their own format: the pseudonym of a card is a
number of the same length and spacing that passes the check, that of a date is a
date. Who does not have the key can neither undo nor repeat it, as the rounds are
keyed digests (HMAC-SHA256). Cards are looked for in what the other kinds leave, printed groups before
others and the longest first, at every border of a run of digits that spaces and hyphens divide, so that other
numbers beside a card do not hide it. Dates are year-month-day with hyphens,
slashes or dots, day.month.year, and month/day/year, or day/month/year where the
first number is above 12; the date of a timestamp such as 2024-02-29T10:00 is one. The permutations are Feistel networks, so equal values become equal
pseudonyms in all documents, unequal ones stay apart, and nothing else changes.

Only DataFrame functions are used; texts without a match pass untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.llm.permutation import let, permuted, permuted_among, secret_rounds, with_secret

_EDGE, _END = r"(?<![0-9A-Za-z_+-])(?<![0-9]\.)", r"(?![0-9A-Za-z_]|[.-][0-9])"
PHONE = r"\+?1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}|[2-9][0-9]{2} [2-9][0-9]{2}[ -][0-9]{4}"
ADDRESS = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
SOCIAL = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
DATES = {
    "yyyy-MM-dd": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "yyyy/MM/dd": r"[0-9]{4}/[0-9]{2}/[0-9]{2}",
    "yyyy.MM.dd": r"[0-9]{4}\.[0-9]{2}\.[0-9]{2}",
    "dd.MM.yyyy": r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}",
    "MM/dd/yyyy": r"(?:0[0-9]|1[0-2])/[0-9]{2}/[0-9]{4}",
    "dd/MM/yyyy": r"(?:1[3-9]|[2-9][0-9])/[0-9]{2}/[0-9]{4}",
}
DATE = "|".join(DATES.values())
#: A date may end before the time of a timestamp.
FOUND = f"{_EDGE}(?:(?:{DATE})(?:{_END}|(?=T[0-9]{{2}}|Z(?![0-9A-Za-z_])))|(?:{SOCIAL}|{ADDRESS}|{PHONE}){_END})"


def _written(n: int) -> str:
    """``n`` digits in one piece or in the groups of printed cards, with one separator."""
    groups = [[4, 4, 4, 4] + [n - 16] * (n > 16)] if n > 15 else [[4, 4, 4, n - 12], [4, 6, n - 10]]
    return "|".join([f"[0-9]{{{n}}}", *[sign.join(f"[0-9]{{{k}}}" for k in g) for g in groups for sign in " -"]])


#: Cards as they are printed come before digits in any groups, as one in ten of these passes the check by chance.
CARD_SHAPES = [f"(?:{_written(n)})" for n in range(19, 12, -1)] + [f"[0-9](?:[ -]?[0-9]){{{n - 1}}}" for n in range(19, 12, -1)]
_CARD_EDGE, _CARD_END = r"(?<![0-9A-Za-z_+])(?<![0-9]\.)", r"(?![0-9A-Za-z_]|\.[0-9])"
CARD = f"{_CARD_EDGE}[0-9](?:[ -]?[0-9]){{12}}"
FIRST_DAY, DAYS = "1900-01-01", 73049  # to 2099-12-31
ROUNDS = 8


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refilled(pattern: Column, digits: Column) -> Column:
    """``pattern`` with its digits replaced in turn by ``digits``."""

    def place(new: Column, i: Column) -> Column:
        own = F.substring(pattern, i, F.lit(1))
        return F.when(own.rlike("[0-9]"), F.substring(new, F.length(_digits(F.substring(pattern, F.lit(1), i))), F.lit(1))).otherwise(own)

    return let(digits, lambda new: F.array_join(F.transform(F.sequence(F.lit(1), F.length(pattern)), lambda i: place(new, i)), ""))


def permuted_digits(digits: Column, key: Column, purpose: str) -> Column:
    """A keyed permutation of the digit strings of each length from 2 to 30, leading zeros kept."""
    n = F.length(digits)
    left = F.floor(n / 2)
    draw = secret_rounds(key, purpose, 14)
    scale = lambda k: F.pow(F.lit(10.0), k).cast("long")

    def step(state: Column, i: Column) -> Column:
        a, b = state["a"], state["b"]
        mark = lambda x: F.concat(n.cast("string"), F.lit(":"), i.cast("string"), F.lit(":"), x.cast("string"))
        even = F.struct(F.pmod(a + draw(F.lit(0), mark(b)), scale(left)).alias("a"), b.alias("b"))
        odd = F.struct(a.alias("a"), F.pmod(b + draw(F.lit(1), mark(a)), scale(n - left)).alias("b"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    halves = F.struct(F.substring(digits, F.lit(1), left.cast("int")).cast("long").alias("a"), F.substring(digits, (left + 1).cast("int"), (n - left).cast("int")).cast("long").alias("b"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), halves, step, lambda s: F.concat(F.lpad(s["a"].cast("string"), left.cast("int"), "0"), F.lpad(s["b"].cast("string"), (n - left).cast("int"), "0")))
    return done


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum whose last digit is doubled (1) or not (0)."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1 - doubled, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _card(value: Column, key: Column) -> Column:
    digits = _digits(value)
    body = let(F.substring(digits, F.lit(1), F.length(digits) - 1), lambda x: permuted_digits(x, key, "card"))
    return _refilled(value, let(body, lambda x: F.concat(x, F.pmod(-luhn_sum(x, 1), F.lit(10)).cast("string"))))


def _phone(value: Column, key: Column) -> Column:
    """Valid numbers, whose area and exchange codes begin with 2 to 9, stay valid; the others of this format stay others."""
    digits = _digits(value)
    local = F.substring(digits, F.length(digits) - 9, F.lit(10)).cast("long")
    valid = lambda x: (x >= 2_000_000_000) & (x % 10_000_000 >= 2_000_000)
    number = permuted_among(local, 10**10, secret_rounds(key, "phone"), lambda x: valid(x) == valid(local))
    return _refilled(value, F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), F.lpad(number.cast("string"), 10, "0")))


def _address(value: Column, key: Column) -> Column:
    """The same address becomes the same; parts written with leading zeros keep their width."""
    parts = F.split(value, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda total, part: total * 256 + part.cast("long"))

    def written(new: Column) -> Column:
        plain = F.array(*[(F.shiftright(new, s) % 256).cast("string") for s in (24, 16, 8, 0)])
        return F.array_join(F.zip_with(plain, parts, lambda x, old: F.when(old.rlike("^0."), F.lpad(x, F.greatest(F.length(x), F.length(old)), F.lit("0"))).otherwise(x)), ".")

    return let(permuted(number, 1 << 32, secret_rounds(key, "address")), written)


def _day(value: Column, form: str) -> Column:
    return F.datediff(F.try_to_date(value, form), F.lit(FIRST_DAY).cast("date")).cast("long")


def _date(value: Column, key: Column) -> Column:
    """The same day becomes the same day in all formats but day/month/year, whose days stay above 12."""
    written = lambda number: F.date_add(F.lit(FIRST_DAY).cast("date"), number.cast("int"))
    late = lambda number: (number < DAYS) & (F.dayofmonth(written(number)) > 12)
    out = F.when(F.lit(False), value)
    for form, pattern in DATES.items():
        day = _day(value, form)
        new = permuted_among(day, DAYS, secret_rounds(key, "late"), late) if form == "dd/MM/yyyy" else permuted(day, DAYS, secret_rounds(key, "date"))
        out = out.when(value.rlike(f"^{pattern}$"), F.date_format(written(new), form))
    return out


def _kind(value: Column) -> Column:
    """The validated kind of a match other than cards, null if it is none."""
    octets = F.forall(F.split(value, r"\."), lambda x: x.cast("int") <= 255)
    date = F.lit(False)
    for form, pattern in DATES.items():
        date = date | (value.rlike(f"^{pattern}$") & F.coalesce(_day(value, form).between(0, DAYS - 1), F.lit(False)))
    return (
        F.when(date, "date")
        .when(value.rlike(f"^(?:{DATE})$"), None)
        .when(value.rlike(f"^{SOCIAL}$"), F.when(~value.rlike("^(?:000|666|9)|-00-|-0000$"), "social"))
        .when(value.rlike(f"^{ADDRESS}$"), F.when(octets, "address"))
        .when(value.rlike(f"^(?:{PHONE})$"), "phone")
    )


def _social(value: Column, key: Column) -> Column:
    """Area 1-899 without 666, group 1-99 and serial 1-9999 stay in their ranges."""
    area, group, serial = (F.substring(value, a, b).cast("long") for a, b in ((1, 3), (5, 2), (8, 4)))
    area = F.when(area > 666, area - 2).otherwise(area - 1)

    def written(number: Column) -> Column:
        rest = F.floor(number / 9999)
        new = F.floor(rest / 99)
        new = F.when(new >= 665, new + 2).otherwise(new + 1)
        return F.concat_ws("-", F.lpad(new.cast("string"), 3, "0"), F.lpad((rest % 99 + 1).cast("string"), 2, "0"), F.lpad((number % 9999 + 1).cast("string"), 4, "0"))

    return let(permuted((area * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, secret_rounds(key, "social")), written)


def _pseudonym(value: Column, kind: Column, key: Column) -> Column:
    makers = {"card": _card, "phone": _phone, "address": _address, "date": _date, "social": _social}
    out = F.when(kind.isNull(), value)
    for name, make in makers.items():
        out = out.when(kind == name, make(value, key))
    return out


def _pieces(text: Column) -> Column:
    """``value, card``: the text cut at its card numbers, the longest first, each at borders of its run of digits."""

    def cut(piece: Column, shape: Column) -> Column:
        starts = F.concat(F.lit(f"{_CARD_EDGE}(?=("), shape, F.lit(f"){_CARD_END})"))
        passing = F.array_distinct(F.filter(F.regexp_extract_all(piece, starts, F.lit(1)), lambda x: luhn_sum(_digits(x), 0) % 10 == 0))

        def divided(cards: Column) -> Column:
            any_of = F.concat(F.lit(f"{_CARD_EDGE}(?:"), F.array_join(cards, "|"), F.lit(f"){_CARD_END}"))
            pair = lambda rest, card: F.array(F.struct(rest.alias("value"), F.lit(False).alias("card")), F.struct(card.alias("value"), F.lit(True).alias("card")))
            found = F.flatten(F.zip_with(F.split(piece, any_of, -1), F.regexp_extract_all(piece, any_of, F.lit(0)), pair))
            return F.when(F.size(cards) > 0, F.filter(found, lambda x: x["value"].isNotNull())).otherwise(whole(piece))

        return let(passing, divided)

    whole = lambda value: F.array(F.struct(value.alias("value"), F.lit(False).alias("card")))
    shapes = F.array(*[F.lit(x) for x in CARD_SHAPES])
    step = lambda pieces, x: F.flatten(F.transform(pieces, lambda p: F.when(p["card"], F.array(p)).otherwise(cut(p["value"], x))))
    return F.when(text.rlike(CARD), F.aggregate(shapes, whole(text), step)).otherwise(whole(text))


def pseudonymise(documents: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``documents`` with ``text_col`` rewritten under the secret ``key``, and ``n_numbers`` and ``n_dates`` replaced in it.

    Null and empty texts stay as they are, with zeros; repeated rows are
    rewritten alike. Rows are independent, so there is no shuffle; texts of any
    length are handled whole. The key is in no query plan. Existing columns of the two names are replaced.
    """
    if not key:
        raise ValueError("a secret key is needed")
    pads = f"_pads_{uuid.uuid4().hex}"
    documents = with_secret(documents, key, pads)
    text = F.col(text_col)
    hit = F.coalesce(text.rlike("[0-9]") & (text.rlike(FOUND) | text.rlike(CARD)), F.lit(False))
    match = lambda m: F.array(F.struct(m.alias("value"), _kind(m).alias("kind")))
    between = lambda p: F.transform(_pieces(p), lambda x: F.struct(x["value"].alias("value"), F.when(x["card"], "card").alias("kind")))
    parts = F.zip_with(F.split(text, FOUND, -1), F.regexp_extract_all(text, F.lit(FOUND), F.lit(0)), lambda p, m: F.concat(between(p), F.when(m.isNotNull(), match(m)).otherwise(F.array().cast("array<struct<value:string,kind:string>>"))))

    def rewritten(pieces: Column) -> Column:
        whole = F.array_join(F.transform(pieces, lambda m: _pseudonym(m["value"], m["kind"], F.col(pads))), "")
        count = lambda f: F.size(F.filter(pieces, f))
        return F.struct(whole.alias("text"), count(lambda m: m["kind"].isNotNull() & (m["kind"] != "date")).alias("numbers"), count(lambda m: m["kind"] == "date").alias("dates"))

    kept = F.struct(text.alias("text"), F.lit(0).alias("numbers"), F.lit(0).alias("dates"))
    result = f"_done_{uuid.uuid4().hex}"
    done = documents.withColumn(result, F.when(hit, let(F.flatten(parts), rewritten)).otherwise(kept))
    return done.withColumns({text_col: F.col(result)["text"], "n_numbers": F.col(result)["numbers"], "n_dates": F.col(result)["dates"]}).drop(result, pads)
