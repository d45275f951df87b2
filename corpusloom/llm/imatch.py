"""I-Match fingerprints: terms of a document-frequency band, hashed in randomised lexicon subsets.

DataFrame functions only. A term's hash puts it into one of SUBSETS random parts of the lexicon, and
at level ``l`` a part keeps a random ``2 ** -l`` of its terms. A document is hashed at the two levels
that leave about one of its terms in a part, so that few of its hashes change when some terms do,
whatever its length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpointed

SUBSETS = 16
#: Fewer band terms than this in a document's subsets: its terms of any frequency are used.
FEW = 6
#: Bits beside a term that say where it is: in the text, in the edited text, in the band.
FLAGS = 3
NO_ID = -(1 << 63)


def terms(text: Column) -> Column:
    """61-bit hashes of the distinct lower-case runs of letters and digits."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.shiftrightunsigned(F.xxhash64(w), FLAGS)))


def level(found: Column) -> Column:
    """The level for so many distinct terms: one or two terms a subset stay, in any band."""
    return F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.size(found), F.lit(1)) / F.lit(SUBSETS)))).cast("int")


def kept_at(term: Column, lev: Column) -> Column:
    """Whether a term is in its subset at this level."""
    low = F.call_function("shiftleft", F.lit(1).cast("long"), lev) - F.lit(1)
    return F.shiftrightunsigned(term, 4).bitwiseAND(low) == 0


def codes(found: Column, lev: Column) -> Column:
    """A number for every subset with terms, at the level and the next: level and subset in the upper
    half, a hash of the sorted distinct terms in the lower."""
    ordered = F.array_sort(F.array_distinct(found))

    def one(i: Column) -> Column:
        at, part = lev + (i / SUBSETS).cast("int"), i % SUBSETS
        mine = F.filter(ordered, lambda t: (t.bitwiseAND(F.lit(SUBSETS - 1)) == part) & kept_at(t, at))
        place = (at * SUBSETS + part).cast("long") * F.lit(1 << 32)
        return F.when(F.size(mine) > 0, place + F.xxhash64(mine).bitwiseAND(F.lit((1 << 32) - 1)))

    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(2 * SUBSETS - 1)), one), lambda c: c.isNotNull())


def likeness(a: Column, level_a: Column, b: Column, level_b: Column) -> Column:
    """Share of equal hashes among the subsets, at levels both have, in which either has terms."""
    low, high = F.greatest(level_a, level_b), F.least(level_a, level_b) + 1
    place = lambda c: F.shiftrightunsigned(c, 32)
    common = lambda xs: F.filter(xs, lambda c: (place(c) >= low * SUBSETS) & (place(c) < (high + 1) * SUBSETS))
    own, other = common(a), common(b)
    either = F.size(F.array_union(F.transform(own, place), F.transform(other, place)))
    return F.when(either > 0, F.size(F.array_intersect(own, other)) / either).otherwise(F.lit(0.0))


def in_order(rows: DataFrame) -> DataFrame:
    """``(id, h, n, copies)`` with the row before and after in order of (id, h), around the end.

    The order is cut into ranges; windows run inside a range, and one row per range, as many as the
    shuffle has partitions, carries across.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = checkpointed(rows.repartitionByRange(parts, "id", "h").withColumn("cut", F.spark_partition_id()))
    row = F.struct("id", "h", "n")
    edges = cut.groupBy("cut").agg(F.min(row).alias("low"), F.max(row).alias("high"))
    across = W.partitionBy(F.lit(0)).orderBy("cut")
    whole = across.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    edges = edges.select(
        "cut", F.coalesce(F.lag("high").over(across), F.last("high").over(whole)).alias("high"),
        F.coalesce(F.lead("low").over(across), F.first("low").over(whole)).alias("low"),
    )
    inside = W.partitionBy("cut").orderBy("id", "h")
    near = cut.select("*", F.lag(row).over(inside).alias("before"), F.lead(row).over(inside).alias("after"))
    # a row for each range: no more than the shuffle has partitions
    return near.join(F.broadcast(edges), "cut").select(
        "id", "h", "n", "copies", F.coalesce("before", "high").alias("before"), F.coalesce("after", "low").alias("after")
    )


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_idf: float = 2.0, least_docs: int = 2) -> DataFrame:
    """Per row ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited`` and ``near_next``.

    The edited text is the text with its last quarter of code points replaced by the first ones of
    the next document. The band: terms in ``least_docs`` documents or more whose inverse document
    frequency ``ln(documents / documents with the term)`` is ``least_idf`` or more, counted over all
    rows. A document with fewer than FEW band terms in its subsets (a group of copies may hold a
    third of all rows) takes its terms in ``least_docs`` documents of any frequency. A document
    without any has a hash of its whole text as fingerprint, alike only to the same text.

    Null texts are empty. A null id comes before all others. Rows with one id follow each other by a
    hash of the text; repeated rows are one document with as many equal rows in the result. A single
    document is its own next. An empty table gives an empty table.
    """
    base = df.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    ).withColumn("h", F.xxhash64("text"))
    place = in_order(base.groupBy("id", "h", F.char_length("text").alias("n")).agg(F.count(F.lit(1)).alias("copies")))
    lexicon = base.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    docs = base.count()
    most = docs * math.exp(-least_idf)
    lexicon = checkpointed(lexicon.where(F.col("df") >= least_docs).select("term", (F.col("df") <= most).alias("band")))

    # the next document's first code points travel to the document before it
    needed = base.join(place.select("id", "h", "before"), ["id", "h"])
    heads = needed.select(
        F.col("before.id").alias("id"), F.col("before.h").alias("h"),
        F.expr("left(text, cast(floor(before.n / 4) as int))").alias("head"),
    ).dropDuplicates(["id", "h"])
    pair = base.join(heads, ["id", "h"]).withColumn("n", F.char_length("text"))
    pair = pair.withColumn("edited", F.expr("concat(left(text, n - cast(floor(n / 4) as int)), head)"))
    pair = pair.select(
        F.xxhash64("id", "h").alias("key"),
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), F.unhex(F.sha2(F.col("edited").cast("binary"), 256)).alias("edited_sha"),
        terms(F.col("text")).alias("a"), terms(F.col("edited")).alias("b"),
    )
    pair = pair.select("key", "sha", "edited_sha", "a", "b", level(F.col("a")).alias("la"), level(F.col("b")).alias("lb"))
    a, b = F.filter("a", lambda t: kept_at(t, F.col("la"))), F.filter("b", lambda t: kept_at(t, F.col("lb")))
    pair = pair.select("key", F.struct("sha", "edited_sha", "la", "lb").alias("meta"), a.alias("a"), b.alias("b"))
    both = F.transform(
        F.array_union("a", "b"),
        lambda t: F.struct(
            t.alias("term"), (F.array_contains("a", t).cast("int") + 2 * F.array_contains("b", t).cast("int")).alias("texts"),
            F.lit(None).cast(pair.schema["meta"].dataType).alias("meta"),
        ),
    )
    # a row more per document carries what is known of it, under a term of its own
    own = F.struct(F.xxhash64("key", F.lit("own")).alias("term"), F.lit(0).alias("texts"), F.col("meta"))
    rows = pair.select("key", F.explode(F.concat(both, F.array(own))).alias("x")).select("key", "x.*")
    met = rows.join(lexicon, "term", "left").where(F.col("band").isNotNull() | F.col("meta").isNotNull())
    flagged = F.shiftleft("term", FLAGS).bitwiseOR(F.col("texts").cast("long") + 4 * F.col("band").cast("long"))
    each = met.groupBy("key").agg(F.max("meta").alias("meta"), F.collect_set(F.when(F.col("meta").isNull(), flagged)).alias("found"))

    def chosen(flag: int) -> Column:
        mine = F.filter("found", lambda t: t.bitwiseAND(F.lit(flag)) != 0)
        band = F.filter(mine, lambda t: t.bitwiseAND(F.lit(4)) != 0)
        return F.transform(F.when(F.size(band) >= FEW, band).otherwise(mine), lambda t: F.shiftrightunsigned(t, FLAGS))

    each = each.select("key", "meta.*", codes(chosen(1), F.col("meta.la")).alias("a"), codes(chosen(2), F.col("meta.lb")).alias("b"))
    each = checkpointed(each)

    order = place.select(
        F.xxhash64("id", "h").alias("key"), "id", "n", "copies", (F.col("h") == F.col("after.h")).alias("same"),
        F.xxhash64("after.id", "after.h").alias("next_key"),
    )
    after = each.select(F.col("key").alias("next_key"), F.col("a").alias("c"), F.col("la").alias("lc"))
    hexed = lambda c, sha: F.when(F.size(c) == 0, F.concat(F.lit("t"), F.substring(F.lower(F.hex(sha)), 1, 32))).otherwise(
        F.array_join(F.transform(c, lambda x: F.lower(F.lpad(F.hex(x), 11, "0"))), "")
    )
    unchanged = F.col("sha") == F.col("edited_sha")
    near_edited, near_next = likeness(F.col("a"), F.col("la"), F.col("b"), F.col("lb")), likeness(F.col("a"), F.col("la"), F.col("c"), F.col("lc"))
    out = order.join(after, "next_key").join(each, "key").select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), F.col("n").cast("long").alias("n_chars"),
        F.lower(F.hex("edited_sha")).alias("edited_sha256"), hexed("a", "sha").alias("fingerprint"), hexed("b", "edited_sha").alias("edited_fingerprint"),
        F.when(unchanged, F.lit(1.0)).otherwise(near_edited).alias("near_edited"),
        F.when(F.col("same"), F.lit(1.0)).otherwise(near_next).alias("near_next"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    )
    return out.drop("copy")
