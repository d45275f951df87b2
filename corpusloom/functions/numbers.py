"""Numbers in words as column expressions. Beyond the scales' 36 digits, digits are read one by one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.bind import bind
from corpusloom.functions.rewrite import rewrite

# English number words.
ONES = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen "
    "fifteen sixteen seventeen eighteen nineteen"
).split()
TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = (
    " thousand million billion trillion quadrillion quintillion sextillion septillion "
    "octillion nonillion decillion"
).split(" ")
ORDINAL_ENDINGS = {
    "one": "first",
    "two": "second",
    "three": "third",
    "five": "fifth",
    "eight": "eighth",
    "nine": "ninth",
    "twelve": "twelfth",
}


def _table(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _below_hundred(n: Column) -> Column:
    ones, tens = _table(ONES), _table(TENS)
    ten, one = F.get(tens, F.floor(n / 10).cast("int")), F.get(ones, (n % 10).cast("int"))
    return (
        F.when(n < 20, F.get(ones, n))
        .when(n % 10 == 0, ten)
        .otherwise(F.concat(ten, F.lit("-"), one))
    )


def _below_thousand(n: Column, link: str) -> Column:
    hundreds = F.concat(F.get(_table(ONES), F.floor(n / 100).cast("int")), F.lit(" hundred"))
    rest = (n % 100).cast("int")
    return (
        F.when(n < 100, _below_hundred(n))
        .when(rest == 0, hundreds)
        .otherwise(F.concat(hundreds, F.lit(link), _below_hundred(rest)))
    )


def number_words(digits: Column, spoken_and: bool = True) -> Column:
    """Words for a string of decimal digits: ``1234567`` becomes ``one million, two hundred and
    thirty-four thousand, five hundred and sixty-seven`` (without ``and`` if not spoken). Without
    leading zeros, more than 36 digits are said one by one: ``one two three``."""
    link = " and " if spoken_and else " "

    def words(bare: Column) -> Column:
        groups = F.ceil(F.length(bare) / 3).cast("int")

        def said(i: Column, n: Column) -> Column:
            scale = F.get(_table(SCALES), groups - 1 - i)
            joint = F.when(i == 0, "").when((i == groups - 1) & (n < 100), link).otherwise(", ")
            tail = F.when(scale == "", "").otherwise(F.concat(F.lit(" "), scale))
            return F.when(n > 0, F.concat(joint, _below_thousand(n, link), tail)).otherwise("")

        def parts(padded: Column) -> Column:
            def part(i: Column) -> Column:
                group = F.substring(padded, i * 3 + 1, F.lit(3)).cast("int")
                return bind(group, lambda n: said(i, n))

            return F.array_join(F.transform(F.sequence(F.lit(0), groups - 1), part), "")

        padded = F.lpad(bare, groups * 3, F.lit("0"))
        places = F.sequence(F.lit(1), F.greatest(F.length(bare), F.lit(1)))
        one_by_one = F.array_join(F.transform(places, lambda i: F.get(_table(ONES), F.substring(bare, i, F.lit(1)).cast("int"))), " ")
        return (
            F.when(bare == "", "zero")
            .when(F.length(bare) > 3 * len(SCALES), one_by_one)
            .otherwise(bind(padded, parts))
        )

    return bind(F.regexp_replace(digits, "^0+", ""), words)


def ordinal_words(digits: Column) -> Column:
    """``21`` becomes ``twenty-first``."""

    def turned(words: Column, last: Column) -> Column:
        head = F.substring(words, F.lit(1), F.length(words) - F.length(last))
        ending = F.coalesce(
            F.create_map(*[F.lit(x) for kv in ORDINAL_ENDINGS.items() for x in kv])[last],
            F.when(last.endswith("y"), F.concat(F.regexp_replace(last, "y$", "ie"), F.lit("th"))),
            F.concat(last, F.lit("th")),
        )
        return F.concat(head, ending)

    return bind(
        number_words(digits),
        lambda w: bind(F.regexp_extract(w, "([a-z]+)$", 1), lambda last: turned(w, last)),
    )


def _pair(n: Column) -> Column:
    """Two digits of a year: 05 is read ``oh five``."""
    return (
        F.when(n == 0, "oh oh")
        .when(n < 10, F.concat(F.lit("oh "), F.get(_table(ONES), n)))
        .otherwise(_below_hundred(n))
    )


def spoken_integer(digits: Column) -> Column:
    """Whole numbers as read aloud: years between 1000 and 3000 go by pairs."""

    def said(year: Column) -> Column:
        high, low = F.floor(year / 100).cast("int"), (year % 100).cast("int")
        by_pairs = F.concat(_below_hundred(high), F.lit(" "), _pair(low))
        late = F.concat(F.lit("two thousand "), _below_hundred(low))
        return (
            F.when((year <= 1000) | (year >= 3000) | year.isNull(), number_words(digits, False))
            .when(year == 2000, "two thousand")
            .when((year > 2000) & (year < 2010), late)
            .when(low == 0, F.concat(_below_hundred(high), F.lit(" hundred")))
            .otherwise(by_pairs)
        )

    bare = F.regexp_replace(digits, "^0+", "")
    return bind(bare, lambda b: bind(F.when(F.length(b) == 4, b.cast("int")), said))


def spell_numbers(c: Column) -> Column:
    """Each maximal run of digits in words."""
    return rewrite(c, "[0-9]+", number_words)


def _money(match: Column) -> Column:
    amount = F.substring(match, F.lit(2), F.length(match))
    parts = F.split(amount, "\\.", -1)

    def whole(i: int) -> Column:
        bare = F.regexp_replace(F.coalesce(F.get(parts, F.lit(i)), F.lit("")), "[^0-9]", "")
        return F.regexp_replace(bare, "^0+", "")

    def counted(n: Column, one: str, many: str) -> Column:
        return F.concat(n, F.when(n == "1", f" {one}").otherwise(f" {many}"))

    def said(d: Column, c: Column) -> Column:
        dollars, cents = counted(d, "dollar", "dollars"), counted(c, "cent", "cents")
        return (
            F.when(F.size(parts) > 2, F.concat(amount, F.lit(" dollars")))
            .when((d != "") & (c != ""), F.concat(dollars, F.lit(", "), cents))
            .when(d != "", dollars)
            .when(c != "", cents)
            .otherwise("zero dollars")
        )

    return bind(whole(0), lambda d: bind(whole(1), lambda c: said(d, c)))


def normalize_numbers(c: Column) -> Column:
    """Thousands commas, pounds, dollars, decimals, ordinals, then whole numbers, in that order."""
    c = rewrite(c, "[0-9][0-9,]+[0-9]", lambda m: F.replace(m, F.lit(",")))
    c = F.regexp_replace(c, "£([0-9,]*[0-9]+)", "$1 pounds")
    c = rewrite(c, "\\$[0-9.,]*[0-9]+", _money)
    c = F.regexp_replace(c, "([0-9]+)\\.([0-9]+)", "$1 point $2")
    c = rewrite(
        c, "[0-9]+(?:st|nd|rd|th)", lambda m: ordinal_words(F.regexp_extract(m, "^[0-9]+", 0))
    )
    return rewrite(c, "[0-9]+", spoken_integer)
