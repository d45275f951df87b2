"""Text table jobs: normalise, segment, encode. A text is one row and stays in one
task. Pieces are exploded by outer generators: for an inner one the optimizer infers a filter on
the pieces and would compute them twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.arrays import intersperse
from corpusloom.functions.symbols import characters, symbols_to_ids


def normalize_corpus(
    df: DataFrame, text: str = "text", cleaners: list[str] | None = None
) -> DataFrame:
    """Normalised texts without those that are only punctuation.

    ``cleaners`` names the cleaners to apply instead of the front-end normalisation. The new text
    comes out of a generator: the filter on it would otherwise normalise a second time.
    """
    c = F.col(text)
    done = T.clean(c, cleaners) if cleaners else T.normalize_text(c)
    rest = [x for x in df.columns if x != text]
    rows = df.select(*rest, F.explode(F.array(done)).alias(text)).select(*df.columns)
    return rows.filter(~T.only_punctuation(F.col(text)))


def text_pieces(
    c: Column,
    longest: int = 80,
    shortest: int = 60,
    merge: int = 20,
    comma_split: bool = False,
    measure: Callable[[Column], Column] | None = None,
) -> Column:
    """Sentences of a text packed to length; Chinese by characters, other text by words."""
    def packed(chinese: bool, size: Callable[[Column], Column]) -> Column:
        pieces = T.split_sentences(c, F.lit(chinese), comma_split)
        return T.pack_sentences(pieces, longest, shortest, merge, size)

    other = packed(False, measure or T.word_length)
    chinese = packed(True, measure or T.char_length)
    return F.when(T.contains_chinese(c), chinese).otherwise(other)


def segment_corpus(df: DataFrame, text: str = "text", normalize: bool = True, **limits) -> DataFrame:
    """One row per segment: the other columns, ``seg_no`` (from 0), ``segment``, ``n_chars``.

    Marked texts stay whole; segments of punctuation only are dropped.
    """
    keep = [c for c in df.columns if c != text]
    c = F.col("_text")
    base = df.select(
        *keep,
        T.is_marked(F.col(text)).alias("_whole"),
        (T.normalize_text(F.col(text)) if normalize else F.col(text)).alias("_text"),
    )
    pieces = F.when(F.col("_whole"), F.array(c)).otherwise(
        F.filter(text_pieces(c, **limits), lambda p: ~T.only_punctuation(p))
    )
    rows = base.select(*keep, F.posexplode_outer(pieces).alias("seg_no", "segment"))
    return rows.filter("seg_no is not null").withColumn("n_chars", F.length("segment"))


def segment_by_marks(
    df: DataFrame, text: str = "text", longest: int = 50, shortest: int = 10, merge: int | None = None
) -> DataFrame:
    """Segments by punctuation, optionally merged up to a shortest length."""
    pieces = T.split_by_punctuation(F.col(text), longest, shortest)
    if merge is not None:
        pieces = T.merge_short_text(pieces, merge)
    keep = [c for c in df.columns if c != text]
    rows = df.select(*keep, F.posexplode_outer(pieces).alias("seg_no", "segment"))
    return rows.filter("seg_no is not null")


def segment_long_texts(df: DataFrame, text: str = "text", above: int = 5000) -> DataFrame:
    """For texts over the limit: the number of segments and each segment."""
    keep = [c for c in df.columns if c != text]
    pieces = T.segment_long_text(F.col(text), above)
    sized = df.filter(F.length(text) > above).select(*keep, pieces.alias("_p"))
    return sized.select(
        *keep, F.size("_p").alias("total_segments"), F.posexplode_outer("_p").alias("seg_no", "segment")
    )


def encode_corpus(
    df: DataFrame, text: str = "text", blank: int | None = 0, strict: bool = False
) -> DataFrame:
    """Symbol ids per text, with ``blank`` between and around them when given."""
    ids = symbols_to_ids(F.col(text), strict)
    coded = intersperse(ids, blank) if blank is not None else ids
    return df.withColumn("text_token", coded).withColumn("text_token_len", F.size("text_token"))


def unknown_symbols(df: DataFrame, text: str = "text") -> DataFrame:
    """How often each character without an id occurs, most frequent first.

    Counts are reduced inside each text before the shuffle: only the texts' distinct unknown
    characters are exploded.
    """
    from corpusloom.functions.symbols import SYMBOLS

    unknown = F.translate(F.col(text), SYMBOLS, "")
    chars = F.array_distinct(characters(unknown))
    pairs = df.select(unknown.alias("_u"), F.explode_outer(chars).alias("symbol"))
    pairs = pairs.filter(F.col("symbol").isNotNull())
    found = F.length("_u") - F.length(F.replace(F.col("_u"), F.col("symbol"), F.lit("")))
    return (
        pairs.select("symbol", found.cast("bigint").alias("n"))
        .groupBy("symbol")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.col("n").desc(), "symbol")
    )


def marker_membership(tokens: DataFrame, vocabulary: DataFrame, token: str = "token") -> DataFrame:
    """Tokens that are registered markers."""
    known = vocabulary.select(F.col("marker").alias(token))
    return tokens.join(known, token, "left_semi")
