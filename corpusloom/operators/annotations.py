"""Bracketed pronunciation notes in text: pinyin, phonetic symbols or plain text.

A segment is the text between two bracket cuts. Every opening bracket cuts, every closing
bracket cuts when it has an opening one; the innermost bracket contents are classified, the
rest is text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.bind import bind, prefixes
from corpusloom.functions.text import strip

# Symbols, words and affixes that tell phonetic notes, pinyin and English apart.
PHONETIC = "ɪəʊɔæʌɑɛɜɒθðʃʒŋˈˌː"
PHONETIC_LETTERS = "ɪəʊɔæʌɑɛɜɒθðʃʒŋ"
COMMON_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should "
    "may might must can this that these those it its in on at to for of with by from about and "
    "or but not no yes i you he she we they me him her us them my your his our their what when "
    "where who why how which whose here there now then today tomorrow yesterday good bad big "
    "small new old first last one two three four five six seven eight nine ten"
)
PHRASE_WORDS = "a an the is are in on at to for of"
ENGLISH_AFFIX = "^(?:.*(?:ing|ed|er|est|ly|tion|sion|ness|ment|ful|less)$|(?:un|re|pre|dis|mis))"

SEGMENTS = T.ArrayType(
    T.StructType(
        [T.StructField("segment", T.StringType()), T.StructField("leaf", T.BooleanType())]
    )
)

# The syllables taken for pinyin when there is no tone digit.
SYLLABLES = """
a o e ai ei ao ou an en ang eng er
ba pa ma fa da ta na la ga ka ha
za ca sa zha cha sha ra
ji qi xi zi ci si zhi chi shi ri
bo po mo fo wo yo
bi pi mi di ti ni li
bu pu mu fu du tu nu lu gu ku hu
zu cu su zhu chu shu ru
ge ke he ze ce se zhe che she re
ben pen men fen den nen gen ken hen zen cen sen
bang pang mang fang dang tang nang lang gang kang hang
beng peng meng feng deng teng neng leng geng keng heng
bin pin min nin lin jin qin xin
bing ping ming ding ting ning ling jing qing xing
jia qia xia yan qian xian jiang qiang xiang
jie qie xie jian
ju qu xu juan quan xuan
yue yun yuan yin ying yong you
wu wei wen wang weng
lv lve nv nve
"""


def is_phonetic(c: Column) -> Column:
    """A phonetic symbol anywhere, or one in any case next to a Latin letter."""
    near = f"(?iu)[a-z][{PHONETIC_LETTERS}]|[{PHONETIC_LETTERS}][a-z]"
    return c.rlike(f"[{PHONETIC}]") | c.rlike(near)


def is_english(c: Column) -> Column:
    def readable(words: Column) -> Column:
        single = (F.size(words) == 1) & (F.length(words[0]) > 2) & words[0].rlike(ENGLISH_AFFIX)
        several = (F.size(words) > 1) & F.exists(words, lambda w: w.isin(PHRASE_WORDS.split()))
        return F.forall(words, lambda w: w.isin(COMMON_WORDS.split())) | single | several

    def english(text: Column) -> Column:
        words = F.split(F.lower(text), "\\s+")
        return text.rlike("\\A[a-zA-Z\\s]+\\z") & bind(words, readable)

    return bind(strip(c), english)


def is_pinyin(c: Column) -> Column:
    """Letters with an optional tone digit, decided by the first word that settles it."""
    def verdict(w: Column) -> Column:
        base = F.regexp_replace(w, "[1-5]$", "")
        return (
            F.when(F.length(base) > 6, False)
            .when(w.rlike("[1-5]$"), True)
            .when(F.lower(base).isin(SYLLABLES.split()), True)
        )

    def pinyin(text: Column) -> Column:
        verdicts = F.transform(F.split(text, "\\s+"), verdict)
        settled = F.get(F.filter(verdicts, lambda v: v.isNotNull()), F.lit(0))
        shaped = text.rlike("\\A[a-zA-Z]+[1-5]?(?:\\s+[a-zA-Z]+[1-5]?)*+\\z")
        return shaped & ~is_english(text) & F.coalesce(settled, F.lit(False))

    return bind(strip(c), pinyin)


def classify_annotation(c: Column) -> Column:
    return F.when(is_phonetic(c), "phonetic").when(is_pinyin(c), "pinyin").otherwise("text")


#: Between a bracket and what stands beside it. A split there passes each character once; runs of a
#: negated class are many times slower.
JOINTS = "(?<=[()（）])|(?=[()（）])"


def _flat(t: Column) -> Column:
    """Segments of a text whose brackets are balanced and not nested: contents follow an opening one."""
    parts = F.transform(t, lambda s, i: F.struct(s.alias("segment"), F.coalesce(F.get(t, i - 1).isin("(", "（"), F.lit(False)).alias("leaf")))
    return F.filter(parts, lambda p: ~p["segment"].isin("(", "（", ")", "）", ""))


def _segments(c: Column) -> Column:
    """Segments of any text, from the depths of its brackets.

    The depth before the first bracket is 0 and goes below it where closing brackets have no opening
    one: there it reaches a new least depth. An opening bracket has its closing one if the depth later
    falls below the bracket's own. Such pairs cut and go; an opening bracket alone cuts and stays.
    """

    def placed(t: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: F.get(t, i).isin("(", "（", ")", "）"))
        steps = F.transform(at, lambda i: F.when(F.get(t, i).isin("(", "（"), 1).otherwise(-1))
        return bind(F.struct(t.alias("t"), at.alias("at"), steps.alias("step")), shaped)

    def shaped(s: Column) -> Column:
        turns = F.forall(F.transform(s["step"], lambda x, k: x == 1 - 2 * (k % 2)), lambda x: x)
        return F.when(turns & (F.size(s["step"]) % 2 == 0), _flat(s["t"])).otherwise(depths(s))

    def depths(s: Column) -> Column:
        depth = prefixes(s["step"], lambda x, y: x + y)
        return bind(depth, lambda d: bind(F.struct(
            s["t"].alias("t"), s["at"].alias("at"), s["step"].alias("step"), d.alias("depth"),
            prefixes(d, F.least).alias("least"), F.reverse(prefixes(F.reverse(d), F.least)).alias("later"),
        ), cuts))

    def cuts(s: Column) -> Column:
        def cut(i: Column, k: Column) -> Column:
            depth, opens = F.get(s["depth"], k), F.get(s["step"], k) == 1
            matched = F.coalesce(F.get(s["later"], k + 1) < depth, F.lit(False))
            alone = depth < F.least(F.lit(0), F.coalesce(F.get(s["least"], k - 1), F.lit(0)))
            kind = F.when(opens & matched, 1).when(opens, 0).when(~alone, 2)
            return F.struct(i.alias("at"), kind.alias("kind"))

        found = F.filter(F.transform(s["at"], cut), lambda x: x["kind"].isNotNull())
        edge = lambda at, kind: F.array(F.struct(at.alias("at"), F.lit(kind).alias("kind")))
        bounds = F.concat(edge(F.lit(0), 0), found, edge(F.size(s["t"]), 0))
        return bind(F.struct(s["t"].alias("t"), bounds.alias("bounds")), segments)

    def segments(s: Column) -> Column:
        def segment(k: Column) -> Column:
            before, after = F.get(s["bounds"], k), F.get(s["bounds"], k + 1)
            begin = before["at"] + F.when(before["kind"] > 0, 1).otherwise(0)
            part = F.array_join(F.slice(s["t"], begin + 1, F.greatest(after["at"] - begin, F.lit(0))), "")
            return F.struct(part.alias("segment"), ((before["kind"] == 1) & (after["kind"] == 2)).alias("leaf"))

        made = F.transform(F.sequence(F.lit(0), F.size(s["bounds"]) - 2), segment)
        return F.filter(made, lambda p: p["segment"] != "")

    return bind(F.split(c, JOINTS), placed)


def parse_annotations(c: Column) -> Column:
    """Array of ``(segment, leaf)`` in order; ``leaf`` marks innermost bracket contents. Null for null."""
    bracketed = c.rlike("[(（]")
    plain = F.array(F.struct(c.alias("segment"), F.lit(False).alias("leaf")))
    return (
        F.when(c == "", F.array().cast(SEGMENTS))
        .when(~bracketed, plain)
        .when(c.isNotNull(), _segments(c))
    )


def annotation_segments(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per segment: ``seg_no`` (from 0), ``segment``, ``seg_type``."""
    keep = [c for c in df.columns if c != text]
    rows = df.select(*keep, F.posexplode_outer(parse_annotations(F.col(text))).alias("seg_no", "_s"))
    rows = rows.filter("seg_no is not null")
    kind = F.when(F.col("_s.leaf"), classify_annotation(F.col("_s.segment"))).otherwise("text")
    return rows.select(*keep, "seg_no", F.col("_s.segment").alias("segment"), kind.alias("seg_type"))


def _typed(text: str) -> Column:
    return F.transform(
        parse_annotations(F.col(text)),
        lambda s: F.struct(
            s["segment"].alias("segment"),
            F.when(s["leaf"], classify_annotation(s["segment"])).otherwise("text").alias("kind"),
        ),
    )


def annotation_views(df: DataFrame, text: str = "text", separator: str = " | ") -> DataFrame:
    """Per row: the plain text, the pinyin and the phonetic segments, and a readable form."""

    def of(kind: str) -> Column:
        return F.transform(
            F.filter("_s", lambda s: s["kind"] == kind), lambda s: s["segment"]
        )

    shown = F.transform(
        "_s", lambda s: F.concat(F.lit("["), s["kind"], F.lit("]: "), s["segment"])
    )
    return df.withColumn("_s", _typed(text)).withColumns(
        {
            "text_only": F.array_join(of("text"), ""),
            "pinyin_only": of("pinyin"),
            "phonetic_only": of("phonetic"),
            "formatted": F.array_join(shown, separator),
        }
    ).drop("_s")


def segments_by_type(df: DataFrame, kind: str, text: str = "text") -> DataFrame:
    """Segments of one type with their original index."""
    return annotation_segments(df, text).filter(F.col("seg_type") == kind)
