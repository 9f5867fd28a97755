"""DuckDB twins of the Spark text functions, as SQL expression builders.

Used only to write the oracle SQL of the query catalogue.  Each builder takes
SQL expression strings and returns one.  RE2 and Java agree on the classes
used here because they are spelled out.
"""

from __future__ import annotations

WS = r"[ \t\n\r\f\x0B]"
MARK = "chr(1)"


def collapse_ws(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sentences(x: str) -> str:
    marked = f"regexp_replace({x}, '([.!?]){WS}+', '\\1' || {MARK}, 'g')"
    marked = f"regexp_replace({marked}, '[\\n\\r]+', {MARK}, 'g')"
    return (f"list_filter(list_transform(string_split({marked}, {MARK}), lambda s: {strip_ws('s')}), "
            f"lambda s: s <> '')")


def ws_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda t: t <> '')"


def rouge_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


WORD_PUNCT = r"[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\r\f\x0B]"


def word_punct_tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '{WORD_PUNCT}')"


def ngrams(t: str, n: int) -> str:
    if n == 1:
        return t
    return f"list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i + {n - 1}], '_'))"


def occ(a: str) -> str:
    return (f"list_transform([list_sort({a})], lambda srt: list_transform(srt, lambda x, i: x || chr(1) || "
            f"CAST(i - list_position(srt, x) AS VARCHAR)))[1]")


def clipped_overlap(h: str, r: str) -> str:
    return f"CAST(len(list_intersect({occ(h)}, {occ(r)})) AS BIGINT)"


def ngram_count(t: str, n: int) -> str:
    return f"CAST(greatest(len({t}) - {n} + 1, 0) AS BIGINT)"


def lcs(a: str, b: str) -> str:
    """LCS length by a row-by-row dynamic program folded with list_reduce."""
    m = f"len({b})"
    zeros = f"list_transform(range(0, {m} + 1), lambda k: 0::BIGINT)"
    inner = (f"list_reduce(range(1, {m} + 1), lambda acc, j: list_append(acc, CASE WHEN {b}[j] = x "
             f"THEN row[j] + 1 ELSE greatest(row[j + 1], acc[j]) END), [0::BIGINT])")
    return f"CAST(list_reduce({a}, lambda row, x: {inner}, {zeros})[{m} + 1] AS BIGINT)"


def ratio(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN CAST({num} AS DOUBLE) / {den} ELSE 0.0 END"


def tag_sentences(s: str) -> str:
    return f"array_to_string(list_transform({s}, lambda x: '<s> ' || x || ' </s>'), ' ')"


def remove_tags(x: str) -> str:
    return f"replace(replace({x}, '<s>', ''), '</s>', '')"


def grams_sep(t: str, n: int, sep: str = "chr(1)") -> str:
    if n == 1:
        return t
    return (f"list_transform(range(1, len({t}) - {n} + 2), "
            f"lambda i: array_to_string({t}[i:i + {n - 1}], {sep}))")


def characters(x: str) -> str:
    return f"regexp_extract_all({x}, '(?s).')"


def bleu_counts(h: str, r: str, max_n: int = 4, sep: str = "chr(1)", prefix: str = "b") -> str:
    """Select-list fragment: ``{prefix}{n}_num``, ``{prefix}{n}_den``, ``{prefix}_c``, ``{prefix}_r``."""
    parts = []
    for n in range(1, max_n + 1):
        parts.append(f"{clipped_overlap(grams_sep(h, n, sep), grams_sep(r, n, sep))} AS {prefix}{n}_num")
        parts.append(f"CAST(greatest(len({h}) - {n - 1}, 1) AS BIGINT) AS {prefix}{n}_den")
    parts.append(f"CAST(len({h}) AS BIGINT) AS {prefix}_c")
    parts.append(f"CAST(len({r}) AS BIGINT) AS {prefix}_r")
    return ",\n       ".join(parts)


def bleu_expr(nums, dens, c: str, r: str) -> str:
    any_zero = " OR ".join(f"{n} = 0" for n in nums)
    logs = " + ".join(f"ln(CAST({n} AS DOUBLE) / {d})" for n, d in zip(nums, dens))
    bp = f"(CASE WHEN {c} > {r} THEN 1.0 WHEN {c} = 0 THEN 0.0 ELSE exp(1 - CAST({r} AS DOUBLE) / {c}) END)"
    return f"(CASE WHEN {any_zero} THEN 0.0 ELSE {bp} * exp(({logs}) / {len(nums)}) END)"
