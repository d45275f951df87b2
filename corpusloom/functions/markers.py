"""Registered text markers: events, and the bracketed phones of English and Mandarin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.bind import bind

# Event markers and the phones, with stress digits 0 to 2 on the vowels.
EVENT_MARKERS = (
    "<|im_start|> <|im_end|> <|endofprompt|> [breath] <strong> </strong> [noise] [laughter] "
    "[cough] [clucking] [accent] [quick_breath] <laughter> </laughter> [hissing] [sigh] "
    "[vocalized-noise] [lipsmack] [mn] <|endofsystem|>"
)
PHONES = (
    "AA AA0 AA1 AA2 AE AE0 AE1 AE2 AH AH0 AH1 AH2 AO AO0 AO1 AO2 AW AW0 AW1 AW2 AY AY0 AY1 AY2 B CH D DH "
    "EH EH0 EH1 EH2 ER ER0 ER1 ER2 EY EY0 EY1 EY2 F G HH IH IH0 IH1 IH2 IY IY0 IY1 IY2 JH K L M N NG "
    "OW OW0 OW1 OW2 OY OY0 OY1 OY2 P R S SH T TH UH UH0 UH1 UH2 UW UW0 UW1 UW2 V W Y Z ZH"
)
# Initials and finals of Mandarin syllables that have markers; finals without a tone,
# with each of the four tones (written by the rule of ``toned``), and single ones.
INITIALS = "b c ch d f g h j k l m n p q r s sh t w x y z zh"
PLAIN_FINALS = "a ai an ang ao e ei en eng i ian in ing iu o ong ou u uang ue un uo"
TONED_FINALS = "a ai an ang ao e ei en eng i ia ian iang iao ie in ing iong iu o ong ou u ua uai uan uang ue ui un uo"
SINGLE_FINALS = "ér ěr èr vè ǘ ǚ ǜ"
TONES = {"a": "āáǎà", "e": "ēéěè", "i": "īíǐì", "o": "ōóǒò", "u": "ūúǔù", "v": "ǖǘǚǜ"}


def toned(final: str, tone: int) -> str:
    """A final with the mark of a tone (1 to 4): on a or e, else on the o of ou, else on the last vowel."""
    at = next((final.index(v) for v in ("a", "e", "ou") if v in final), None)
    if at is None:
        at = max(final.rfind(v) for v in "iouv")
    return final[:at] + TONES[final[at]][tone - 1] + final[at + 1 :]


def marker_names() -> list[str]:
    finals = PLAIN_FINALS.split() + [toned(f, t) for f in TONED_FINALS.split() for t in (1, 2, 3, 4)] + SINGLE_FINALS.split()
    return EVENT_MARKERS.split() + [f"[{p}]" for p in [*PHONES.split(), *INITIALS.split(), *finals]]


def syllable_phones(c: Column) -> Column:
    """Initial and toned final of a syllable written with a tone digit (``zhong1``; 5, 0 or none: no
    mark; ``v`` or ``ü``), as an array without empty parts. The longest initial is taken."""
    longest = "|".join(sorted(INITIALS.split(), key=len, reverse=True))
    low = F.translate(F.lower(c), "ü", "v")
    parts = f"^({longest})?([a-z]*)([0-5]?)$"
    tone = F.regexp_extract(low, parts, 3)

    def marked(final: Column) -> Column:
        place = F.when(final.rlike("[ae]"), "^([^ae]*)([ae])(.*)$").when(final.contains("ou"), "^(.*?)(o)(u.*)$").otherwise("^(.*)([iouv])([^iouv]*)$")
        found = lambda i: F.call_function("regexp_extract", final, place, F.lit(i))
        vowel = found(2)
        letter = F.lit(None).cast("string")
        for v, marks in TONES.items():
            letter = F.coalesce(letter, F.when(vowel == v, F.substring(F.lit(marks), tone.cast("int"), F.lit(1))))
        written = F.concat(found(1), letter, found(3))
        return F.when(tone.rlike("[1-4]"), F.coalesce(written, final)).otherwise(final)

    both = F.array(F.regexp_extract(low, parts, 1), bind(F.regexp_extract(low, parts, 2), marked))
    return F.filter(both, lambda p: p != "")


def marker_vocabulary(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """Dimension of markers; ``extra`` (``marker``) adds more."""
    base = spark.createDataFrame([(m,) for m in marker_names()], "marker string")
    return base if extra is None else base.unionByName(extra.select("marker")).distinct()
