"""Line-first quality rules in native expressions: failing lines go, then documents that lose too much.

Everything about a document is computed from arrays inside its own row, so nothing is shuffled and a hot
source costs no more than any other. Repeated five-word windows are found by sorting one long array per
text: the upper bits of a key are the window's hash and the lower ones its place, so equal windows are
neighbours. With n words, 64 - log2(n) - 1 bits of hash remain (49 for 20,000 words).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5

#: A document that loses more than this share of its words with all its failing lines is rejected.
MAX_LOST_PERCENT = 70
#: So is one that loses more than this with lines that fail the punctuation or the navigation rule.
MAX_NOISE_PERCENT = 30
#: A line with more runs of marks than this, per hundred words, fails the punctuation rule.
MAX_MARKS_PERCENT = 20
#: So does a line of fewer words than this that ends without a closing mark.
MIN_UNCLOSED_WORDS = 3
#: A line with this many bars and more than so many bars per hundred words is navigation.
MIN_BARS, MAX_BARS_PERCENT = 3, 20
MARKS = r"[#*$%&<>!?]{2,}"
CLOSING = r"[.!?:;,…。！？\"'”’»)\]]$"
NAVIGATION = r"(?i)^[\x20\x09-\x0D]*(home|menu|login|log in|sign in|sign up|search|next|previous|back to top|skip to content|read more|share)[\x20\x09-\x0D.!:>|]*$"
BOILERPLATE = (r"(?i)(licensed under the|all rights reserved|permission is hereby granted|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies"
               r"|enable javascript|lorem ipsum|^[\x20\x09-\x0D]*copyright |spdx-license-identifier|subscribe to our newsletter)")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    plain = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(plain) > 0, F.split(plain, SPACE + "+")).otherwise(F.array().cast("array<string>"))


def _shifted(a: Column, b: Column, step: int, size: Column) -> Column:
    """Hashes of a[i] and b[i + step]."""
    return F.zip_with(F.slice(a, F.lit(1), size), F.slice(b, F.lit(step + 1), size), lambda x, y: F.xxhash64(x, y))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of five words which occurs at least twice in the text."""
    def from_hashes(h: Column) -> Column:
        n = F.size(h)
        two = lambda v: let(_shifted(v, v, 1, F.size(v) - 1), four)
        four = lambda v: let(_shifted(v, v, 2, F.size(v) - 2), five)
        five = lambda v: _shifted(v, h, 4, F.size(v) - 1)
        low = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n.cast("long")))) - 1
        return let(low, lambda mask: let(F.sort_array(F.transform(two(h), lambda g, i: g.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")))),
                                         lambda keys: _covered(_repeats(keys, mask))))

    enough = F.size(words) > REPEAT_WINDOW
    return F.when(enough, let(F.transform(words, lambda w: F.xxhash64(w)), from_hashes)).otherwise(F.lit(0)).cast("long")


def _repeats(keys: Column, mask: Column) -> Column:
    """Sorted places of the windows whose hash a neighbour in ``keys`` shares."""
    size = F.size(keys) - 1
    high = F.bitwise_not(mask)
    equal = F.zip_with(F.slice(keys, F.lit(1), size), F.slice(keys, F.lit(2), size),
                       lambda a, b: F.when(a.bitwiseXOR(b).bitwiseAND(high) == 0, F.array(a.bitwiseAND(mask), b.bitwiseAND(mask))))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(equal, lambda p: p.isNotNull()))))


def _covered(starts: Column) -> Column:
    """Words covered by windows at sorted places."""
    def total(s: Column) -> Column:
        size = F.size(s) - 1
        steps = F.zip_with(F.slice(s, F.lit(1), size), F.slice(s, F.lit(2), size), lambda a, b: F.least(b - a, F.lit(REPEAT_WINDOW).cast("long")))
        return F.when(size >= 0, F.aggregate(steps, F.lit(REPEAT_WINDOW).cast("long"), lambda t, x: t + x)).otherwise(F.lit(0).cast("long"))

    return let(starts, total)


def judge_line(line: Column) -> Column:
    """Words of a line and the first rule it fails: 1 punctuation, 2 navigation, 3 boilerplate, 0 none."""
    plain = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    n = F.when(F.length(plain) > 0, F.regexp_count(plain, F.lit(SPACE + "+")) + 1).otherwise(0)

    def verdict(words: Column) -> Column:
        bars = F.length(plain) - F.length(F.replace(plain, F.lit("|"), F.lit("")))
        marks = F.regexp_count(plain, F.lit(MARKS))
        unclosed = (words < MIN_UNCLOSED_WORDS) & ~plain.rlike(CLOSING)
        rule = (F.when(words == 0, 0).when(unclosed | (marks * 100 > words * MAX_MARKS_PERCENT), 1)
                .when(((bars >= MIN_BARS) & (bars * 100 > words * MAX_BARS_PERCENT)) | plain.rlike(NAVIGATION), 2)
                .when(plain.rlike(BOILERPLATE), 3).otherwise(0))
        return F.struct(line.alias("line"), words.alias("n"), rule.alias("rule"))

    return let(n.cast("int"), verdict)


def clean_lines(documents: DataFrame) -> DataFrame:
    """All columns of ``documents`` but ``text``, plus the rule columns and ``clean_text``, the lines that pass.

    A null text has no words, fails the base rule and has an empty clean_text. Empty and blank texts fail
    likewise. Repeated rows each give a row. Lines without a word pass and stay where they are. Columns of
    ``documents`` that have the name of a rule column are replaced.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n")
    spoken = F.filter(lines, lambda l: l.rlike(r"[^\x20\x09-\x0D]"))
    judged = F.transform(lines, judge_line)
    out = documents.withColumns({"_words": words_of(text), "_lines": judged, "_spoken": spoken})
    count = lambda rule: F.size(F.filter("_lines", lambda l: l["rule"] == rule)).cast("long")
    lost = lambda *rules: F.aggregate("_lines", F.lit(0).cast("long"), lambda t, l: t + F.when(l["rule"].isin(*rules), l["n"]).otherwise(0))
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, "[^" + SYMBOLS + "]+", "")).cast("long"),
        "n_dup_lines": (F.size("_spoken") - F.size(F.array_distinct("_spoken"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")),
        "n_punctuation_lines": count(1), "n_navigation_lines": count(2), "n_boilerplate_lines": count(3), "n_noise_words": lost(1, 2), "n_lost_words": lost(1, 2, 3),
        "clean_text": F.array_join(F.transform(F.filter("_lines", lambda l: l["rule"] == 0), lambda l: l["line"]), "\n")})
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    within = lambda name, percent: F.col(name) * 100 <= F.col("n_words") * percent
    kept = ~failed & within("n_lost_words", MAX_LOST_PERCENT) & within("n_noise_words", MAX_NOISE_PERCENT)
    return out.withColumn("base_failed", failed).withColumn("kept", kept).drop("_words", "_lines", "_spoken", "text")


RULE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_punctuation_lines",
                "n_navigation_lines", "n_boilerplate_lines", "n_noise_words", "n_lost_words"]


def quality_rules(documents: DataFrame) -> DataFrame:
    """One row per row: doc_id and the rule columns."""
    return clean_lines(documents.select("doc_id", "text")).select("doc_id", *RULE_COLUMNS)


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4]) AS c
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM g, (SELECT unnest(range(5)) AS o) WHERE c > 1 GROUP BY rid),
l AS (SELECT rid, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
             regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS p FROM (SELECT rid, unnest(ls) AS line FROM w)),
j AS (SELECT rid, n, line, CASE WHEN n = 0 THEN 0
        WHEN (n < {MIN_UNCLOSED_WORDS} AND NOT regexp_matches(p, {_sql_text(CLOSING)}))
          OR len(regexp_extract_all(p, {_sql_text(MARKS)})) * 100 > n * {MAX_MARKS_PERCENT} THEN 1
        WHEN (length(p) - length(replace(p, '|', '')) >= {MIN_BARS} AND (length(p) - length(replace(p, '|', ''))) * 100 > n * {MAX_BARS_PERCENT})
          OR regexp_matches(p, {_sql_text(NAVIGATION)}) THEN 2
        WHEN regexp_matches(p, {_sql_text(BOILERPLATE)}) THEN 3 ELSE 0 END AS rule FROM l),
k AS (SELECT rid, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines, count(*) FILTER (rule = 1) AS p1,
             count(*) FILTER (rule = 2) AS p2, count(*) FILTER (rule = 3) AS p3,
             coalesce(sum(n) FILTER (rule IN (1, 2)), 0)::BIGINT AS noise, coalesce(sum(n) FILTER (rule > 0), 0)::BIGINT AS lost FROM j GROUP BY rid),
b AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[{SYMBOLS}]'))::BIGINT AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             p1 AS n_punctuation_lines, p2 AS n_navigation_lines, p3 AS n_boilerplate_lines, noise AS n_noise_words, lost AS n_lost_words
      FROM w JOIN k USING (rid) LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND n_lost_words * 100 <= n_words * {MAX_LOST_PERCENT} AND n_noise_words * 100 <= n_words * {MAX_NOISE_PERCENT} AS kept FROM f
"""
