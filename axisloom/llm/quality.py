"""Line-first quality rules, in DataFrame expressions only.

Each line with a word is judged by itself; failing lines go, and a document that loses
more than ``max_lost`` of its words is rejected. Null and empty texts have no words and
fail the base rule. Rows are independent: nothing is shuffled, ties and repeated rows
do not matter, and other columns pass through under any name; columns of the same name as
one that is added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, aside, returned, word_array

#: Phrases of page furniture, matched in lower case.
BOILERPLATE = [
    "all rights reserved",
    "cookie policy",
    "enable javascript",
    "privacy policy",
    "sign up for our newsletter",
    "skip to content",
    "terms of service",
    "terms of use",
]
#: A line with two or more of these between its words is a menu or a path of links.
NAVIGATION = r"(?:\s[|>\x{bb}\x{2022}]\s[^|>]*){2,}"
NAVIGATION_RE2 = r"(?:[\t\n\f\r ][|>\x{bb}\x{2022}][\t\n\f\r ][^|>]*){2,}"
#: What ends a sentence, with closing quotes or brackets behind it.
TERMINAL = r"[.!?:;\x{2026}][\x22'\x29\x5d\x{bb}\x{201d}\x{2019}]*$"


def line_fails(line: Column, short_line: int = 4) -> Column:
    """line: trimmed at both ends. True for boilerplate, navigation, and short lines without final punctuation."""
    low = F.lower(line)
    furniture = F.lit(False)
    for phrase in BOILERPLATE:
        furniture = furniture | low.contains(phrase)
    few = F.size(F.split(line, r"[\x20\x09-\x0D]+")) < short_line
    return furniture | line.rlike(NAVIGATION) | (few & ~line.rlike(TERMINAL))


def quality_rules(
    df: DataFrame,
    text: str = "text",
    min_words: int = 20,
    window: int = 8,
    max_repeat_percent: int = 30,
    max_lost_percent: int = 50,
    short_line: int = 4,
) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_removed, n_words_kept, base_failed, kept, clean_text.

    n_repeat_words counts the words covered by windows of ``window`` words found twice or more in the
    same text. A document is kept if the base rule passes and at most ``max_lost_percent`` of its words
    stand in failing lines.
    """
    df, names = aside(df)
    text = names.get(text, text)
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"_w": word_array(F.col(text)), "_lines": F.split(t, "\n")})
    df = df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long"),
            "_full": F.filter("_lines", lambda x: F.btrim(x, F.lit(SPACE)) != ""),
            "_h": F.transform("_w", lambda x: F.xxhash64(x)),
        }
    )
    df = df.withColumns(
        {
            "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
            "_bad": F.filter("_full", lambda x: line_fails(F.btrim(x, F.lit(SPACE)), short_line)),
            "_g": F.when(F.size("_h") >= window, F.transform(F.sequence(F.lit(1), F.size("_h") - (window - 1)), lambda i: F.xxhash64(F.slice("_h", i, window)))).otherwise(F.array().cast("array<bigint>")),
        }
    )
    # Only texts with a repeated window sort their windows; equal hashes then stand next to each other.
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    n = F.size("_s")
    same = lambda i, j: F.get("_s", i)["g"] == F.get("_s", j)["g"]
    df = df.withColumn("_p", F.sort_array(F.filter(F.transform("_s", lambda x, i: F.when((i > 0) & F.coalesce(same(i, i - 1), F.lit(False)) | (i < n - 1) & F.coalesce(same(i, i + 1), F.lit(False)), x["i"])), lambda v: v.isNotNull())))
    covered = F.aggregate(F.transform("_p", lambda p, i: F.least(F.lit(window), F.coalesce(F.get("_p", i + 1), p + window) - p)), F.lit(0), lambda a, b: a + b)
    df = df.withColumns(
        {
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "n_lines_removed": F.size("_bad").cast("long"),
            "n_words_kept": (F.col("n_words") - F.aggregate(F.transform("_bad", lambda x: F.size(F.split(F.btrim(x, F.lit(SPACE)), r"[\x20\x09-\x0D]+"))), F.lit(0), lambda a, b: a + b)).cast("long"),
            "clean_text": F.array_join(F.filter("_lines", lambda x: ~F.array_contains("_bad", x)), "\n"),
        }
    )
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    df = df.withColumn("base_failed", failed)
    df = df.withColumn("kept", ~F.col("base_failed") & ((F.col("n_words") - F.col("n_words_kept")) * 100 <= F.col("n_words") * max_lost_percent))
    return returned(df.drop("_w", "_lines", "_full", "_h", "_bad", "_g", "_s", "_p"), names)


def oracle(short_line: int = 4) -> str:
    phrases = " or ".join(f"contains(low, '{p}')" for p in BOILERPLATE)
    return rf"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws, string_split(text, chr(10)) as ls from t),
g as (select r, i, list_slice(ws, i, i + 7) as g from (select r, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)),
d as (select r, i from (select r, i, count(*) over (partition by r, g) as n from g) where n > 1),
c as (select r, sum(least(8, coalesce(nx - i, 8))) as n from (select r, i, lead(i) over (partition by r order by i) as nx from d) group by r),
l as (select r, unnest(ls) as raw from w),
l1 as (select r, raw, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as line from l),
l2 as (select r, raw, line, lower(line) as low, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as k from l1 where line <> ''),
l3 as (select r, count(*) - count(distinct raw) as dup, coalesce(sum(k) filter (({phrases}) or regexp_matches(line, '{NAVIGATION_RE2}') or (k < {short_line} and not regexp_matches(line, '{TERMINAL.replace("'", "''")}'))), 0) as lost from l2 group by r),
f as (select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(dup, 0)::bigint as n_dup_lines,
  coalesce(c.n, 0)::bigint as n_repeat_words, coalesce(lost, 0)::bigint as lost from w left join c using (r) left join l3 using (r)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and 100 * lost <= 50 * n_words as kept from b"""
