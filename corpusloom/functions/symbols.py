"""The symbol inventory of the text encoder, and the language codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.lookup import lookup

# The symbols in id order (padding, punctuation, letters, phonetic letters).
PAD = "_"
PUNCTUATION = ';:,.!?¡¿—…"«»“” '
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
PHONETIC_LETTERS = (
    "ɑɐɒæɓʙβɔɕçɗɖðʤəɘɚɛɜɝɞɟʄɡɠɢʛɦɧħɥʜɨɪʝɭɬɫɮʟɱɯɰŋɳɲɴøɵɸθœɶʘɹɺɾɻʀʁɽʂʃʈʧʉʊʋⱱʌɣɤʍχʎʏʑʐʒʔʡʕʢǀǁǂǃ"
    "ˈˌːˑʼʴʰʱʲʷˠˤ˞↓↑→↗↘'̩'ᵻ"
)
SYMBOLS = PAD + PUNCTUATION + LETTERS + PHONETIC_LETTERS

# Language names with more than one spelling.
LANGUAGE_ALIASES = {
    "burmese": "my",
    "valencian": "ca",
    "flemish": "nl",
    "haitian": "ht",
    "letzeburgesch": "lb",
    "pushto": "ps",
    "panjabi": "pa",
    "moldavian": "ro",
    "moldovan": "ro",
    "sinhalese": "si",
    "castilian": "es",
    "mandarin": "zh",
}


def symbol_ids() -> dict[str, int]:
    """Symbol to id; a symbol listed twice has its last id."""
    return {s: i for i, s in enumerate(SYMBOLS)}


def _by_code_point() -> Column:
    """Array of ids at the code points of their symbols: a lookup without a search."""
    ids = {ord(s): i for s, i in symbol_ids().items()}
    cells = ",".join(str(ids.get(n, "null")) for n in range(max(ids) + 1))
    return F.from_json(F.lit(f"[{cells}]"), "array<int>")


def characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda s: s != "")


def symbols_to_ids(c: Column, strict: bool = True) -> Column:
    """Ids of the characters; an unknown character fails, or is left out if not strict."""
    table = _by_code_point()
    ids = F.transform(characters(c), lambda s: F.get(table, F.ascii(s)))
    if not strict:
        return F.filter(ids, lambda i: i.isNotNull())
    unknown = F.raise_error(F.lit("unknown symbol")).cast("int")
    return F.transform(ids, lambda i: F.coalesce(i, unknown))


def ids_to_symbols(ids: Column) -> Column:
    table = F.array(*[F.lit(s) for s in SYMBOLS])
    unknown = F.raise_error(F.lit("unknown symbol id"))
    return F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(table, i), unknown)), "")


def language_code(df: DataFrame, languages: DataFrame, name: str = "language") -> DataFrame:
    """Add ``code`` for a language given by code, name or alias; null when it is unknown.

    ``languages``: ``code, name``, the dimension of the codes in use.
    """
    spark = df.sparkSession
    aliases = spark.createDataFrame(
        [(a, c) for a, c in LANGUAGE_ALIASES.items()], "alias string, code string"
    )
    known = (
        languages.select(F.lower("code").alias("_said"), "code", F.lit(0).alias("_rank"))
        .unionByName(languages.select(F.lower("name").alias("_said"), "code", F.lit(1).alias("_rank")))
        .unionByName(
            aliases.join(languages.select("code"), "code", "left_semi").select(
                F.col("alias").alias("_said"), "code", F.lit(2).alias("_rank")
            )
        )
        .groupBy("_said")
        .agg(F.min_by("code", "_rank").alias("code"))
    )
    return lookup(df.withColumn("_said", F.lower(name)), known, "_said").drop("_said")
