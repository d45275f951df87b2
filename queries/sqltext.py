"""SQL fragments for the text queries."""

from __future__ import annotations

from collections.abc import Callable

from corpusloom.functions import numbers as N
from corpusloom.functions import text as T


def words_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


ONES, TENS = words_list(N.ONES), words_list(N.TENS)
SCALES = words_list([f" {s}" if s else "" for s in N.SCALES])


def below_hundred(n: str) -> str:
    return (
        f"(CASE WHEN ({n}) < 20 THEN {ONES}[({n}) + 1] WHEN ({n}) % 10 = 0 THEN {TENS}[({n}) // 10 + 1] "
        f"ELSE {TENS}[({n}) // 10 + 1] || '-' || {ONES}[({n}) % 10 + 1] END)"
    )


def number_words(d: str, link: str = " and ") -> str:
    bare = f"ltrim({d}, '0')"
    k = f"CAST(ceil(length({bare}) / 3) AS INTEGER)"
    n = f"CAST(substr(lpad({bare}, {k} * 3, '0'), CAST(i AS INTEGER) * 3 + 1, 3) AS INTEGER)"
    hundred = f"{ONES}[{n} // 100 + 1] || ' hundred'"
    said = (
        f"(CASE WHEN {n} < 100 THEN {below_hundred(n)} WHEN {n} % 100 = 0 THEN {hundred} "
        f"ELSE {hundred} || '{link}' || {below_hundred(n + ' % 100')} END)"
    )
    joint = f"(CASE WHEN i = 0 THEN '' WHEN i = {k} - 1 AND {n} < 100 THEN '{link}' ELSE ', ' END)"
    part = f"CASE WHEN {n} > 0 THEN {joint} || {said} || {SCALES}[{k} - CAST(i AS INTEGER)] ELSE '' END"
    whole = f"array_to_string(list_transform(range({k}), lambda i: {part}), '')"
    digit = f"{ONES}[ascii(substr({bare}, CAST(i AS INTEGER) + 1, 1)) - 47]"
    spelt = f"array_to_string(list_transform(range(length({bare})), lambda i: {digit}), ' ')"
    return f"(CASE WHEN {bare} = '' THEN 'zero' WHEN length({bare}) >= 37 THEN {spelt} ELSE {whole} END)"


def rewrite(x: str, pattern: str, change: Callable[[str], str]) -> str:
    """SQL form of replacing each match by an expression of it."""
    found = f"list_append(list_transform(regexp_extract_all({x}, '{pattern}'), lambda m: {change('m')}), '')"
    return (
        f"(CASE WHEN regexp_matches({x}, '{pattern}') THEN array_to_string(list_transform("
        f"list_zip(string_split_regex({x}, '{pattern}'), {found}), lambda z: z[1] || z[2]), '') ELSE {x} END)"
    )


def strip(x: str) -> str:
    return f"trim({x}, '{T.WHITESPACE}')"


def chinese(x: str) -> str:
    return f"regexp_matches({x}, '[{T.CHINESE}]')"


def marked(x: str) -> str:
    return f"((contains({x}, '<|') AND contains({x}, '|>')) OR {x} = '')"


def punctuation(x: str) -> str:
    return f"regexp_full_match({x}, '[\\p{{P}}\\p{{S}}]*')"


def replace_blank(x: str) -> str:
    x = f"regexp_replace({x}, ' {{2,}}', '', 'g')"
    x = f"regexp_replace({x}, '([^\\x00-\\x7f]|^) ', '\\1', 'g')"
    return f"regexp_replace({x}, ' ([^\\x00-\\x7f]|$)', '\\1', 'g')"


def normalize(x: str) -> str:
    t = strip(x)
    zh = replace_blank(f"replace({t}, chr(10), '')")
    zh = f"replace(replace(replace(replace({zh}, '²', '平方'), '³', '立方'), '.', '。'), ' - ', '，')"
    zh = f"replace(translate({zh}, '（）【】`', ''), '——', ' ')"
    zh = f"regexp_replace({zh}, '[，,、]+$', '。')"
    en = rewrite(t, "[0-9]+", number_words)
    return f"CASE WHEN {marked(x)} THEN {x} WHEN {chinese(x)} THEN {zh} ELSE {en} END"


def sentences(x: str, ends: str, terminal: str) -> str:
    mark = f'[{ends}]["”]?'
    t = f"(CASE WHEN regexp_matches(right({x}, 1), '[{ends}]') THEN {x} ELSE {x} || '{terminal}' END)"
    t = f"regexp_replace({t}, '^(?:{mark})+', '')"
    head = f"regexp_extract(m, '^[^{ends}]+{mark}')"
    return (
        f"list_transform(regexp_extract_all({t}, '[^{ends}]+{mark}(?:{mark})*'), "
        f"lambda m: {head} || regexp_replace(substr(m, length({head}) + 1), '[{ends}]', '', 'g'))"
    )


def close(acc: str, short: str) -> str:
    return f"""CASE WHEN {acc}.cur = '' THEN {acc}.done
      WHEN {short} AND len({acc}.done) > 0
        THEN list_append({acc}.done[1:len({acc}.done) - 1], {acc}.done[len({acc}.done)] || {acc}.cur)
      ELSE list_append({acc}.done, {acc}.cur) END"""


def fold(pieces: str, step: str) -> str:
    """Fold of pieces into {done, cur}; ``step`` is an expression of ``acc_`` and ``x_``."""
    return (
        "list_reduce(list_prepend({'done': []::VARCHAR[], 'cur': ''}, list_transform("
        f"{pieces}, lambda pc: {{'done': []::VARCHAR[], 'cur': pc}})), lambda acc_, x_: {step})"
    )


def pack(pieces: str, measure: Callable[[str], str], longest=80, shortest=60) -> str:
    flush = f"{measure('(acc_.cur || x_.cur)')} > {longest} AND {measure('acc_.cur')} > {shortest}"
    return fold(
        pieces,
        f"CASE WHEN {flush} THEN {{'done': list_append(acc_.done, acc_.cur), 'cur': x_.cur}} "
        "ELSE {'done': acc_.done, 'cur': acc_.cur || x_.cur} END",
    )


def merge_short(pieces: str, shortest: int) -> str:
    return fold(
        pieces,
        f"CASE WHEN length(acc_.cur) < {shortest} THEN {{'done': acc_.done, 'cur': acc_.cur || x_.cur}} "
        "ELSE {'done': list_append(acc_.done, acc_.cur), 'cur': x_.cur} END",
    )


def length(x: str) -> str:
    return f"length({x})"


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '\\S+'))"


def exploded(source: str, keys: str, pieces: str, extra: str = "") -> str:
    """Rows of a list column with their 0-based number."""
    return (
        f"SELECT {keys}, CAST(i AS INTEGER) AS seg_no, {pieces}[i + 1] AS segment{extra} "
        f"FROM (SELECT *, unnest(range(len({pieces}))) AS i FROM {source})"
    )
