"""Text jobs: normalise, clean, split, annotate, encode."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import markers, symbols
from corpusloom.functions import text as T
from corpusloom.operators import annotations as A
from corpusloom.operators import text_jobs as J
from corpusloom.plans.jobs import language_segments as segments_by_language
from queries import query
from queries import sqltext as S

# Every second document gets Chinese characters for its vowels, so that both branches run.
LATIN, HAN = "aeiou,", "中文音频道，"
MIXED = f"""
WITH mixed AS (SELECT doc_id, lang,
  CASE WHEN doc_id % 2 = 0 THEN translate(text, '{LATIN}', '{HAN}') ELSE text END AS text FROM documents)
"""


def mixed(t):
    text = F.when(F.col("doc_id") % 2 == 0, F.translate("text", LATIN, HAN)).otherwise(F.col("text"))
    return t.texts().select("doc_id", "lang", text.alias("text"))


@query(MIXED + f""",
n AS (SELECT doc_id, lang, {S.normalize('text')} AS text FROM mixed)
SELECT * FROM n WHERE NOT {S.punctuation('text')}
""")
def normalize_corpus(t):
    return J.normalize_corpus(mixed(t))


ZH = S.sentences("text", T.SENTENCE_ENDS_ZH, "。")
EN = S.sentences("text", T.SENTENCE_ENDS, ".")


@query(MIXED + f""",
n AS (SELECT doc_id, {S.marked('text')} AS whole, {S.normalize('text')} AS text FROM mixed),
p AS (SELECT *, {S.chinese('text')} AS zh, CASE WHEN {S.chinese('text')} THEN {ZH} ELSE {EN} END AS pieces FROM n),
f AS (SELECT *, CASE WHEN zh THEN {S.pack('pieces', S.length)} ELSE {S.pack('pieces', S.words)} END AS a FROM p),
c AS (SELECT doc_id, CASE WHEN whole THEN [text] ELSE list_filter(
    {S.close('a', f"(CASE WHEN zh THEN {S.length('a.cur')} ELSE {S.words('a.cur')} END) < 20")},
    lambda s: NOT {S.punctuation('s')}) END AS packs FROM f)
{S.exploded('c', 'doc_id', 'packs', ', CAST(length(packs[i + 1]) AS INTEGER) AS n_chars')}
""")
def segment_corpus(t):
    return J.segment_corpus(mixed(t).select("doc_id", "text"))


@query(f"""
WITH n AS (SELECT d.doc_id, lang, quality, {S.marked('text')} AS whole, {S.normalize('text')} AS text
  FROM documents d JOIN labels USING (doc_id)),
p AS (SELECT *, {EN} AS pieces FROM n),
f AS (SELECT *, {S.pack('pieces', S.length)} AS a FROM p),
c AS (SELECT *, CASE WHEN whole THEN [text] ELSE list_filter(
    {S.close('a', 'length(a.cur) < 20')}, lambda s: NOT {S.punctuation('s')}) END AS packs FROM f),
e AS ({S.exploded('c', 'lang, quality', 'packs')})
SELECT lang, quality, count(*) AS segments, CAST(sum(length(segment)) AS BIGINT) AS chars,
  CAST(min(length(segment)) AS INTEGER) AS shortest, CAST(max(length(segment)) AS INTEGER) AS longest,
  round(avg(length(segment)), 6) AS mean_chars FROM e GROUP BY lang, quality
""")
def language_segments(t):
    return segments_by_language(t.texts(), t.labels)


@query(f"""
WITH c AS (SELECT doc_id, {S.sentences('text', T.SENTENCE_ENDS + T.COMMAS, '.')} AS pieces FROM documents)
{S.exploded('c', 'doc_id', 'pieces')}
""")
def split_sentences(t):
    pieces = T.split_sentences(F.col("text"), F.lit(False), comma_split=True)
    return t.texts().select("doc_id", F.posexplode_outer(pieces).alias("seg_no", "segment"))


def cut_by_marks(x: str, longest: int, shortest: int) -> str:
    """CTEs from {doc_id, text} to {doc_id, text, pieces}."""
    return f"""
m AS (SELECT *, regexp_extract_all({x}, '(?s).{{{shortest - 1},}}?[{T.CUT_MARKS}]') AS found FROM src),
u AS (SELECT *, {{'done': found, 'cur': substr({x}, CAST(coalesce(list_sum(list_transform(found, lambda p: length(p))), 0) AS BIGINT) + 1)}} AS a FROM m),
v AS (SELECT *, {S.close('a', f'length(a.cur) < {shortest}')} AS joined FROM u),
w AS (SELECT *, CASE WHEN length({x}) <= {longest} THEN [{x}]
   WHEN len(joined) = 1 AND length({x}) > {longest}
     THEN list_transform(range(0, length({x}), {longest}), lambda o: substr({x}, o + 1, {longest}))
   ELSE joined END AS pieces FROM v)"""


@query(f"""
WITH src AS (SELECT doc_id, text FROM documents), {cut_by_marks('text', 50, 10)}
{S.exploded('w', 'doc_id', 'pieces')}
""")
def segment_by_marks(t):
    return J.segment_by_marks(t.texts().select("doc_id", "text"))


@query(f"""
WITH src AS (SELECT doc_id, text FROM documents WHERE length(text) > 5000), {cut_by_marks('text', 30, 10)},
f AS (SELECT doc_id, {S.merge_short('pieces', 10)} AS a FROM w),
c AS (SELECT doc_id, {S.close('a', 'length(a.cur) < 10')} AS merged FROM f)
{S.exploded('c', 'doc_id, CAST(len(merged) AS INTEGER) AS total_segments', 'merged')}
""")
def segment_long_texts(t):
    return J.segment_long_texts(t.texts().select("doc_id", "text"))


@query(MIXED + f""",
a AS (SELECT doc_id, regexp_replace(text, '([{T.CHINESE}])\\s+([{T.CHINESE}])', '\\1\\2', 'g') AS text FROM mixed),
b AS (SELECT doc_id, regexp_replace(text, '([{T.CHINESE}])\\s+([{T.ASR_MARKS}])', '\\1\\2', 'g') AS text FROM a),
c AS (SELECT doc_id, regexp_replace(text, '([{T.ASR_MARKS}])\\s+([{T.CHINESE}])', '\\1\\2', 'g') AS text FROM b)
SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM c
""")
def clean_asr_text(t):
    return mixed(t).select("doc_id", T.clean_asr_text(F.col("text")).alias("text"))


@query(f"""
SELECT doc_id, regexp_replace(lower(translate(replace(replace(replace(replace(replace(
  text, 'ß', 'ss'), 'æ', 'ae'), 'Æ', 'AE'), 'œ', 'oe'), 'Œ', 'OE'),
  '{T.latin_letters()[0]}', '{T.latin_letters()[1]}')), '\\s+', ' ', 'g') AS text FROM documents
""")
def transliteration_cleaners(t):
    return J.normalize_corpus(
        t.texts().select("doc_id", "text"), cleaners=["transliteration_cleaners"]
    )


@query("""
SELECT doc_id, regexp_replace(lower(text), '\\s+', ' ', 'g') AS text FROM documents
""")
def basic_cleaners(t):
    return J.normalize_corpus(t.texts().select("doc_id", "text"), cleaners=["basic_cleaners"])


def sql_abbreviations() -> str:
    x = "text"
    for short, full in T.ABBREVIATIONS.items():
        x = f"regexp_replace({x}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({short})\\.', '\\1{full}', 'g')"
    return x


TITLES = "replace(replace(text, '. ', ' and Mr. '), ', ', ' or the drs. of St. ')"


@query(f"""
WITH titled AS (SELECT doc_id, {TITLES} AS text FROM documents)
SELECT doc_id, {sql_abbreviations()} AS text FROM titled
""")
def expand_abbreviations(t):
    titled = t.texts().select("doc_id", F.expr(TITLES).alias("text"))
    return J.normalize_corpus(titled, cleaners=["expand_abbreviations"])


PRICED = (
    "concat('Paid $', n_chars, '.', doc_id % 100, ' and £1,', lpad(CAST(doc_id % 1000 AS STRING), 3, '0'), "
    "' on the ', doc_id, 'th, $0.', doc_id % 3, ', $', doc_id % 3, ', in ', 1000 + doc_id % 2100, ' of ', "
    "repeat(CAST(doc_id % 10 AS STRING), CAST(30 + doc_id % 41 AS INT)), ': ', text)"
)


def whole(x: str) -> str:
    return f"ltrim(regexp_replace(coalesce({x}, ''), '[^0-9]', '', 'g'), '0')"


def sql_money(m: str) -> str:
    parts = f"string_split(substr({m}, 2), '.')"
    d, c = whole(f"{parts}[1]"), whole(f"{parts}[2]")
    dollars = f"{d} || CASE WHEN {d} = '1' THEN ' dollar' ELSE ' dollars' END"
    cents = f"{c} || CASE WHEN {c} = '1' THEN ' cent' ELSE ' cents' END"
    return (
        f"CASE WHEN len({parts}) > 2 THEN substr({m}, 2) || ' dollars' "
        f"WHEN {d} <> '' AND {c} <> '' THEN {dollars} || ', ' || {cents} "
        f"WHEN {d} <> '' THEN {dollars} WHEN {c} <> '' THEN {cents} ELSE 'zero dollars' END"
    )


def sql_ordinal(m: str) -> str:
    w = S.number_words(f"regexp_extract({m}, '^[0-9]+')")
    last = f"regexp_extract({w}, '([a-z]+)$', 1)"
    irregular = " ".join(
        f"WHEN '{a}' THEN '{b}'"
        for a, b in (
            ("one", "first"),
            ("two", "second"),
            ("three", "third"),
            ("five", "fifth"),
            ("eight", "eighth"),
            ("nine", "ninth"),
            ("twelve", "twelfth"),
        )
    )
    return (
        f"left({w}, length({w}) - length({last})) || CASE {last} {irregular} ELSE "
        f"CASE WHEN {last} LIKE '%y' THEN regexp_replace({last}, 'y$', 'ie') ELSE {last} END || 'th' END"
    )


def sql_integer(m: str) -> str:
    bare = f"ltrim({m}, '0')"
    y = f"CAST({bare} AS INTEGER)"
    low = f"{y} % 100"
    pair = (
        f"CASE WHEN {low} = 0 THEN 'oh oh' WHEN {low} < 10 THEN 'oh ' || {S.ONES}[{low} + 1] "
        f"ELSE {S.below_hundred(low)} END"
    )
    return (
        f"CASE WHEN length({bare}) <> 4 THEN {S.number_words(m, ' ')} "
        f"WHEN {y} <= 1000 OR {y} >= 3000 THEN {S.number_words(m, ' ')} "
        f"WHEN {y} = 2000 THEN 'two thousand' "
        f"WHEN {y} > 2000 AND {y} < 2010 THEN 'two thousand ' || {S.below_hundred(low)} "
        f"WHEN {low} = 0 THEN {S.below_hundred(y + ' // 100')} || ' hundred' "
        f"ELSE {S.below_hundred(y + ' // 100')} || ' ' || {pair} END"
    )


@query(f"""
WITH a AS (SELECT doc_id, {PRICED} AS text FROM documents),
b AS (SELECT doc_id, {S.rewrite('text', '[0-9][0-9,]+[0-9]', lambda m: f"replace({m}, ',', '')")} AS text FROM a),
c AS (SELECT doc_id, regexp_replace(text, '£([0-9,]*[0-9]+)', '\\1 pounds', 'g') AS text FROM b),
d AS (SELECT doc_id, {S.rewrite('text', '[$][0-9.,]*[0-9]+', sql_money)} AS text FROM c),
e AS (SELECT doc_id, regexp_replace(text, '([0-9]+)[.]([0-9]+)', '\\1 point \\2', 'g') AS text FROM d),
f AS (SELECT doc_id, {S.rewrite('text', '[0-9]+(?:st|nd|rd|th)', sql_ordinal)} AS text FROM e)
SELECT doc_id, {S.rewrite('text', '[0-9]+', sql_integer)} AS text FROM f
""")
def normalize_numbers(t):
    priced = t.texts().select("doc_id", F.expr(PRICED).alias("text"))
    return J.normalize_corpus(priced, cleaners=["normalize_numbers"])


NOTED = "concat(text, ' (ni3 hao3) and (', lang, '（θɪs）', source, ') or () (he is) ) and (open')"
NOTES = f"""
WITH src AS (SELECT doc_id, {NOTED.replace('text', "regexp_replace(text, ' ([a-z]{2,6}) ', ' (\\1) ', 'g')", 1)} AS text
  FROM documents),
tok AS (SELECT doc_id, ts[i] AS t, i FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM (
  SELECT doc_id, regexp_extract_all(text, '[(（]|[)）]|[^()（）]+') AS ts FROM src))),
s AS (SELECT *, t IN ('(', '（') AS op, t IN (')', '）') AS cl, CAST(sum(CASE WHEN t IN ('(', '（') THEN 1
  WHEN t IN (')', '）') THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS s FROM tok),
d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY i)) AS depth FROM s),
r AS (SELECT *, CASE
  WHEN op AND min(depth) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) < depth THEN 'o'
  WHEN op THEN 'u'
  WHEN cl AND lag(depth, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) > 0 THEN 'c' ELSE 't' END AS role FROM d),
g AS (SELECT *, sum(CASE WHEN role <> 't' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM r),
p AS (SELECT doc_id, g, min_by(role, i) AS first, coalesce(string_agg(t, '' ORDER BY i) FILTER (role IN ('u', 't')), '') AS seg
  FROM g GROUP BY doc_id, g),
l AS (SELECT *, first = 'o' AND lead(first) OVER (PARTITION BY doc_id ORDER BY g) = 'c' AS leaf FROM p),
k AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS INTEGER) AS seg_no, seg, leaf,
  {S.strip('seg')} AS x, string_split_regex(lower({S.strip('seg')}), '\\s+') AS ws FROM l WHERE seg <> ''),
e AS (SELECT *, regexp_full_match(x, '[a-zA-Z\\s]+') AND (
  len(list_filter(ws, lambda w: NOT list_contains({S.words_list(A.COMMON_WORDS.split())}, w))) = 0
  OR (len(ws) = 1 AND length(ws[1]) > 2 AND regexp_matches(ws[1], '{A.ENGLISH_AFFIX}'))
  OR (len(ws) > 1 AND list_has_any(ws, {S.words_list(A.PHRASE_WORDS.split())}))) AS english,
  list_filter(list_transform(ws, lambda w: CASE
    WHEN length(regexp_replace(w, '[1-5]$', '')) > 6 THEN 'n' WHEN regexp_matches(w, '[1-5]$') THEN 'y'
    WHEN list_contains({S.words_list(A.SYLLABLES.split())}, w) THEN 'y' END), lambda v: v IS NOT NULL) AS verdicts FROM k),
n AS (SELECT doc_id, seg_no, seg AS segment, CASE WHEN NOT leaf THEN 'text'
  WHEN regexp_matches(seg, '[{A.PHONETIC}]') THEN 'phonetic'
  WHEN NOT english AND regexp_full_match(x, '[a-zA-Z]+[1-5]?(\\s+[a-zA-Z]+[1-5]?)*') AND verdicts[1] = 'y' THEN 'pinyin'
  ELSE 'text' END AS seg_type FROM e)
"""


def noted(t):
    wrapped = F.regexp_replace("text", " ([a-z]{2,6}) ", " ($1) ")
    return t.texts().withColumn("text", wrapped).select("doc_id", F.expr(NOTED).alias("text"))


@query(NOTES + "SELECT * FROM n")
def annotate_corpus(t):
    return A.annotation_segments(noted(t))


@query(NOTES + "SELECT seg_type, count(*) AS n FROM n GROUP BY 1")
def annotation_counts(t):
    return A.annotation_segments(noted(t)).groupBy("seg_type").agg(F.count(F.lit(1)).alias("n"))


@query(NOTES + """
SELECT doc_id,
  coalesce(string_agg(segment, '' ORDER BY seg_no) FILTER (seg_type = 'text'), '') AS text_only,
  coalesce(string_agg(segment, '; ' ORDER BY seg_no) FILTER (seg_type = 'pinyin'), '') AS pinyin_only,
  coalesce(string_agg(segment, '; ' ORDER BY seg_no) FILTER (seg_type = 'phonetic'), '') AS phonetic_only,
  string_agg('[' || seg_type || ']: ' || segment, ' | ' ORDER BY seg_no) AS formatted
FROM n GROUP BY doc_id
""")
def annotation_views(t):
    return A.annotation_views(noted(t)).select(
        "doc_id",
        "text_only",
        F.array_join("pinyin_only", "; ").alias("pinyin_only"),
        F.array_join("phonetic_only", "; ").alias("phonetic_only"),
        "formatted",
    )


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


IDS = "MAP {" + ", ".join(f"{quoted(s)}: {i}" for s, i in symbols.symbol_ids().items()) + "}"


@query(f"""
WITH c AS (SELECT doc_id, list_filter(list_transform(string_split(text, ''), lambda s: {IDS}[s]),
  lambda i: i IS NOT NULL) AS ids FROM documents)
SELECT doc_id, CAST(2 * len(ids) + 1 AS INTEGER) AS text_token_len,
  '0,' || array_to_string(list_transform(ids, lambda i: i || ',0'), ',') AS ids FROM c
""")
def encode_corpus(t):
    coded = J.encode_corpus(t.texts().select("doc_id", "text"))
    return coded.select("doc_id", "text_token_len", F.array_join("text_token", ",").alias("ids"))


@query(f"""
WITH c AS (SELECT unnest(string_split(text, '')) AS symbol FROM documents)
SELECT symbol, count(*) AS n FROM c WHERE NOT list_contains(map_keys({IDS}), symbol) AND symbol <> '' GROUP BY symbol
""")
def unknown_symbols(t):
    return J.unknown_symbols(t.texts())


@query("""
WITH c AS (SELECT doc_id, lang, CASE doc_id % 3 WHEN 0 THEN upper(lang) WHEN 1 THEN 'language ' || lang
  ELSE 'castilian' END AS language FROM documents)
SELECT doc_id, language, CASE WHEN doc_id % 3 = 2 THEN 'es' ELSE lang END AS code FROM c
""")
def language_code(t):
    dimension = t.documents.select(
        F.col("lang").alias("code"), F.concat(F.lit("language "), "lang").alias("name")
    ).distinct()
    third = F.col("doc_id") % 3
    said = (
        F.when(third == 0, F.upper("lang"))
        .when(third == 1, F.concat(F.lit("language "), "lang"))
        .otherwise("castilian")
    )
    asked = t.texts().select("doc_id", said.alias("language"))
    return symbols.language_code(asked, dimension)


@query(f"""
WITH w AS (SELECT unnest(string_split(text, ' ')) AS w FROM documents)
SELECT '[' || upper(w) || ']' AS token, count(*) AS n FROM w
WHERE list_contains({S.words_list(markers.marker_names())}, '[' || upper(w) || ']') GROUP BY 1
""")
def marker_membership(t):
    words = t.texts().select(F.explode(F.split("text", " ")).alias("w"))
    tokens = words.select(F.concat(F.lit("["), F.upper("w"), F.lit("]")).alias("token"))
    known = J.marker_membership(tokens, markers.marker_vocabulary(t.spark))
    return known.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT doc_id, regexp_replace(text, '[^{symbols.LETTERS}]', '', 'g') AS text FROM documents
""")
def ids_to_symbols(t):
    letters = F.regexp_replace("text", f"[^{symbols.LETTERS}]", "")
    ids = symbols.symbols_to_ids(letters)
    return t.texts().select("doc_id", symbols.ids_to_symbols(ids).alias("text"))
