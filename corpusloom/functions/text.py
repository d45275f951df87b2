"""Text cleaning and splitting as column expressions.

They are composed into table jobs in ``operators/text_jobs.py``. Patterns use Java syntax;
``(?U)`` makes whitespace and word boundaries Unicode-wide.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.bind import bind, running
from corpusloom.functions.numbers import normalize_numbers, spell_numbers

# The delimiter sets, brackets and replacements that define the splitting rules.
CHINESE = "一-鿿"
SENTENCE_ENDS_ZH = "。？！；：、.?!;"
SENTENCE_ENDS = ".?!;:"
COMMAS = "，,"
CLOSING_QUOTES = '"”'
CUT_MARKS = "。！？；，、.!?;,"
ASR_MARKS = '，。！？、；："（）【】《》'
ABBREVIATIONS = {
    "mrs": "misess",
    "mr": "mister",
    "dr": "doctor",
    "st": "saint",
    "co": "company",
    "jr": "junior",
    "maj": "major",
    "gen": "general",
    "drs": "doctors",
    "rev": "reverend",
    "lt": "lieutenant",
    "hon": "honorable",
    "sgt": "sergeant",
    "capt": "captain",
    "esq": "esquire",
    "ltd": "limited",
    "col": "colonel",
    "ft": "fort",
}
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LIGATURES = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE"}


def latin_letters() -> tuple[str, str]:
    """Accented Latin letters and their ASCII bases, from Unicode decomposition."""
    pairs = [(chr(n), unicodedata.normalize("NFD", chr(n))[0]) for n in range(0xC0, 0x180)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip(c: Column) -> Column:
    """Without whitespace at both ends (a trim set: a regex would rescan every inner run)."""
    return F.trim(c, F.lit(WHITESPACE))


def contains_chinese(c: Column) -> Column:
    return c.rlike(f"[{CHINESE}]")


def replace_corner_mark(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("²"), F.lit("平方")), F.lit("³"), F.lit("立方"))


def remove_bracket(c: Column) -> Column:
    return F.replace(F.translate(c, "（）【】`", ""), F.lit("——"), F.lit(" "))


def replace_blank(c: Column) -> Column:
    """Keep a space only between two ASCII characters that are not spaces."""
    solid = "[\\x00-\\x1f\\x21-\\x7f]"
    return F.regexp_replace(c, f"(?<!{solid}) | (?!{solid})", "")


def normalize_text(c: Column) -> Column:
    """Normalise unless the text is empty or carries ``<| |>`` markers."""

    def front_end(text: Column) -> Column:
        zh = replace_corner_mark(replace_blank(F.replace(text, F.lit("\n"), F.lit(""))))
        zh = F.replace(F.replace(zh, F.lit("."), F.lit("。")), F.lit(" - "), F.lit("，"))
        zh = F.regexp_replace(remove_bracket(zh), "[，,、]+\\z", "。")
        return F.when(contains_chinese(text), zh).otherwise(spell_numbers(text))

    return F.when(is_marked(c), c).otherwise(bind(strip(c), front_end))


def is_marked(c: Column) -> Column:
    """Texts that are passed on whole: empty, or with ``<| |>`` markers."""
    return (c.contains("<|") & c.contains("|>")) | (c == "")


def only_punctuation(c: Column) -> Column:
    return c.rlike("\\A[\\p{P}\\p{S}]*\\z")


def _sentences(c: Column, ends: str, terminal: str) -> Column:
    mark = f"[{ends}][{CLOSING_QUOTES}]?"
    # delimiters after an empty piece go, the quotes between them stay
    spare = f"(?<=[{ends}][{CLOSING_QUOTES}]{{0,1}})[{ends}]"

    def pieces(text: Column) -> Column:
        end = F.when(F.right(text, F.lit(1)).rlike(f"[{ends}]"), "").otherwise(terminal)
        ended = F.regexp_replace(F.concat(text, end), f"^(?:{mark})++", "")
        found = F.regexp_extract_all(ended, F.lit(f"[^{ends}]+{mark}(?:{mark})*+"), F.lit(0))
        cleaned = F.transform(found, lambda m: F.regexp_replace(m, spare, ""))
        return F.when(text == "", F.array().cast("array<string>")).otherwise(cleaned)

    return bind(c, pieces)


def split_sentences(c: Column, chinese: Column, comma_split: bool = False) -> Column:
    """Cut after each delimiter; a closing quote stays with the piece before it."""
    extra = COMMAS if comma_split else ""
    return F.when(chinese, _sentences(c, SENTENCE_ENDS_ZH + extra, "。")).otherwise(
        _sentences(c, SENTENCE_ENDS + extra, ".")
    )


def char_length(c: Column) -> Column:
    return F.length(c)


def word_length(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit("\\S+"), F.lit(0)))


def _pack_type() -> Column:
    return F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("open")
    )


#: Pieces that are packed by a fold. It copies its list at each piece, so more go by pointers.
FOLD = 256


def pack_sentences(
    pieces: Column,
    longest: int = 80,
    shortest: int = 60,
    merge: int = 20,
    measure: Callable[[Column], Column] = char_length,
) -> Column:
    """Join pieces up to a length; a short tail joins the pack before it.

    ``measure`` of a joined text must follow from its pieces and each two neighbours, as numbers of
    characters and words do, and must not shrink with another piece.
    """

    def step(acc: Column, piece: Column) -> Column:
        def either(grown: Column) -> Column:
            flush = (measure(grown) > longest) & (measure(acc["open"]) > shortest)
            flushed = F.struct(
                F.concat(acc["done"], F.array(acc["open"])).alias("done"), piece.alias("open")
            )
            kept = F.struct(acc["done"].alias("done"), grown.alias("open"))
            return F.when(flush, flushed).otherwise(kept)

        return bind(F.concat(acc["open"], piece), either)

    def folded(p: Column) -> Column:
        return F.aggregate(p, _pack_type(), step, lambda a: _close(a, measure(a["open"]) < merge))

    def ends(sizes: Sizes, i: Column, j: Column) -> Column:
        return (sizes(i, j + 1) > longest) & (sizes(i, j) > shortest)

    return _packed(pieces, folded, measure, ends, merge)


def _close(acc: Column, short: Column) -> Column:
    """End of a fold: keep the open piece, or append it to the last finished one if short."""
    done, last = acc["done"], acc["open"]
    joined = F.concat(
        F.slice(done, F.lit(1), F.size(done) - 1),
        F.array(F.concat(F.get(done, F.size(done) - 1), last)),
    )
    return (
        F.when(last == "", done)
        .when(short & (F.size(done) > 0), joined)
        .otherwise(F.concat(done, F.array(last)))
    )


def merge_short_text(pieces: Column, shortest: int = 5) -> Column:
    """A piece shorter than the limit absorbs the next; a short tail joins its predecessor."""

    def step(acc: Column, piece: Column) -> Column:
        short = F.length(acc["open"]) < shortest
        return F.struct(
            F.when(short, acc["done"])
            .otherwise(F.concat(acc["done"], F.array(acc["open"])))
            .alias("done"),
            F.when(short, F.concat(acc["open"], piece)).otherwise(piece).alias("open"),
        )

    def folded(p: Column) -> Column:
        return F.aggregate(p, _pack_type(), step, lambda a: _close(a, F.length(a["open"]) < shortest))

    def ends(sizes: Sizes, i: Column, j: Column) -> Column:
        return sizes(i, j) >= shortest

    return _packed(pieces, folded, char_length, ends, shortest)


#: Measure of the pieces from ``i`` up to ``j``, joined.
Sizes = Callable[[Column, Column], Column]


def _packed(
    pieces: Column,
    folded: Callable[[Column], Column],
    measure: Callable[[Column], Column],
    ends: Callable[[Sizes, Column, Column], Column],
    merge: int,
) -> Column:
    """Packs by the fold for few pieces, by pointers for many; both give the same packs."""
    return bind(pieces, lambda p: F.when(F.size(p) <= FOLD, folded(p)).when(p.isNotNull(), _pointed(p, measure, ends, merge)))


def _pointed(pieces: Column, measure: Callable[[Column], Column], ends: Callable[[Sizes, Column, Column], Column], merge: int) -> Column:
    """Packs by next-cut pointers. Where the pack that begins at a piece ends depends on that piece
    only, and ``ends`` holds from there on, so it is found by bisection on running sums. Doubled
    pointers then tell the k-th cut for every k at once: n log n steps, one slicing at the end.
    """
    n = F.size(pieces)
    upto = lambda k: F.sequence(F.lit(0), k - 1)
    rounds = F.ceil(F.log2(n + 1)).cast("int")
    power = lambda k: F.pow(F.lit(2), k).cast("int")

    def joint(k: Column) -> Column:
        """What joining piece ``k`` to the one before adds to the measure."""
        before, here = F.get(pieces, k - 1), F.get(pieces, k)
        return F.when(k > 0, measure(F.concat(before, here)) - measure(before) - measure(here)).otherwise(0)

    def summed(joints: Column) -> Column:
        grown = F.transform(pieces, lambda p, k: (measure(p) + F.get(joints, k)).cast("long"))
        return bind(F.struct(joints.alias("joint"), running(grown, lambda x, y: x + y).alias("sum")), pointers)

    def pointers(s: Column) -> Column:
        def sizes(i: Column, j: Column) -> Column:
            before = F.when(i > 0, F.get(s["sum"], i - 1)).otherwise(0)
            return F.when(j > i, F.get(s["sum"], j - 1) - before - F.get(s["joint"], i)).otherwise(0)

        def following(i: Column) -> Column:
            def further(at: Column, k: Column) -> Column:
                return F.when((at + k < n) & ~ends(sizes, i, at + k), at + k).otherwise(at)

            return F.aggregate(F.reverse(F.transform(upto(rounds), power)), i, further) + 1

        return bind(F.concat(F.transform(upto(n), following), F.array(n)), lambda one: bind(doubled(one), packs))

    def doubled(one: Column) -> Column:
        def more(acc: Column, _: Column) -> Column:
            return bind(F.get(acc, F.size(acc) - 1), lambda far: F.concat(acc, F.array(F.transform(far, lambda x: F.get(far, x)))))

        return F.aggregate(upto(rounds), F.array(one), more)

    def packs(tables: Column) -> Column:
        def start(k: Column) -> Column:
            jump = lambda at, r: F.when(F.floor(k / power(r)) % 2 == 1, F.get(F.get(tables, r), at)).otherwise(at)
            return F.aggregate(upto(rounds), F.lit(0), jump)

        starts = F.filter(F.transform(upto(n), start), lambda x: x < n)
        return bind(starts, lambda at: bind(F.transform(at, lambda x, k: text(x, F.coalesce(F.get(at, k + 1), n))), tail))

    def text(begin: Column, end: Column) -> Column:
        return F.array_join(F.slice(pieces, begin + 1, end - begin), "")

    def tail(made: Column) -> Column:
        last = F.get(made, F.size(made) - 1)
        state = F.struct(F.slice(made, F.lit(1), F.size(made) - 1).alias("done"), last.alias("open"))
        return bind(state, lambda a: _close(a, measure(a["open"]) < merge))

    return bind(F.transform(upto(n), joint), summed)


def fixed_width(c: Column, width: int) -> Column:
    def cut(text: Column) -> Column:
        starts = F.sequence(F.lit(0), F.ceil(F.length(text) / width).cast("int") - 1)
        return F.transform(starts, lambda i: F.substring(text, i * width + 1, F.lit(width)))

    return bind(c, cut)


def split_by_punctuation(c: Column, longest: int = 50, shortest: int = 10) -> Column:
    """Texts over ``longest`` are cut at the first mark once a piece has ``shortest`` characters."""
    # \\G: a search that fails is not tried again from every later character
    cut = F.lit(f"\\G(?s).{{{shortest - 1},}}?[{CUT_MARKS}]")

    def joined(text: Column, found: Column) -> Column:
        used = F.aggregate(found, F.lit(0), lambda n, p: n + F.length(p))
        ends = F.struct(
            found.alias("done"), F.substring(text, used + 1, F.length(text)).alias("open")
        )
        return bind(ends, lambda a: _close(a, F.length(a["open"]) < shortest))

    def pieces(text: Column) -> Column:
        def checked(parts: Column) -> Column:
            return F.when(F.size(parts) == 1, fixed_width(text, longest)).otherwise(parts)

        cuts = bind(F.regexp_extract_all(text, cut, F.lit(0)), lambda f: joined(text, f))
        return F.when(F.length(text) <= longest, F.array(text)).otherwise(bind(cuts, checked))

    return bind(c, pieces)


def segment_long_text(c: Column, above: int = 5000, longest: int = 30, shortest: int = 10) -> Column:
    """Pieces for texts over ``above`` characters, null for the others."""
    pieces = merge_short_text(split_by_punctuation(c, longest, shortest), shortest)
    return F.when(F.length(c) > above, pieces)


def clean_asr_text(c: Column) -> Column:
    """Drop blanks between Chinese characters and around their punctuation, collapse the rest."""
    for before, after in (
        (CHINESE, CHINESE),
        (CHINESE, ASR_MARKS),
        (ASR_MARKS, CHINESE),
    ):
        c = F.regexp_replace(c, f"(?U)([{before}])\\s+([{after}])", "$1$2")
    return strip(collapse_whitespace(c))


def lowercase(c: Column) -> Column:
    return F.lower(c)


def collapse_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)\\s+", " ")


def basic_cleaners(c: Column) -> Column:
    return collapse_whitespace(lowercase(c))


def to_ascii(c: Column) -> Column:
    """Latin letters without their marks; other scripts are left as they are."""
    for a, b in LIGATURES.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, *latin_letters())


def transliteration_cleaners(c: Column) -> Column:
    return collapse_whitespace(lowercase(to_ascii(c)))


def expand_abbreviations(c: Column) -> Column:
    """Each abbreviation in turn, in the texts that hold it at all.

    The word boundary is tested after the literal, which is the rarer of the two.
    """
    rules = F.array(
        *[
            F.struct(
                F.lit(f"{short.upper()}.").alias("mark"),
                F.lit(f"(?iU){short}\\.(?<!\\w{short}\\.)").alias("pattern"),
                F.lit(full).alias("full"),
            )
            for short, full in ABBREVIATIONS.items()
        ]
    )

    def expanded(upper: Column) -> Column:
        held = F.filter(rules, lambda r: upper.contains(r["mark"]))
        return F.aggregate(held, c, lambda t, r: F.regexp_replace(t, r["pattern"], r["full"]))

    return bind(F.upper(c), expanded)


def english_cleaners(c: Column) -> Column:
    return collapse_whitespace(expand_abbreviations(lowercase(to_ascii(c))))


def strip_ansi(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, "\\x1b\\[[A-Za-z0-9;]*[A-Za-z]", ""), F.lit("[A"))


# Cleaners by name, applied left to right.
CLEANERS: dict[str, Callable[[Column], Column]] = {
    "lowercase": lowercase,
    "collapse_whitespace": collapse_whitespace,
    "basic_cleaners": basic_cleaners,
    "convert_to_ascii": to_ascii,
    "transliteration_cleaners": transliteration_cleaners,
    "expand_abbreviations": expand_abbreviations,
    "english_cleaners2": english_cleaners,
    "normalize_numbers": normalize_numbers,
    "spell_numbers": spell_numbers,
    "clean_asr_text": clean_asr_text,
}


def clean(c: Column, names: list[str]) -> Column:
    for name in names:
        if name not in CLEANERS:
            raise ValueError(f"unknown cleaner: {name}")
        c = CLEANERS[name](c)
    return c
