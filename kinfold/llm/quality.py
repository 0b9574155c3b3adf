"""Quality rules: a table of thresholds compiled into one projection, without user functions.

``measures()`` counts, ``RATIOS`` names the shares built of the counts, and ``RULES`` holds
(measure, least, most). ``judged()`` turns all of them into one expression, a struct of
counts and verdict, in which a text's words and lines are bound once; so the scan, the
measures and the verdict are one stage without a shuffle, also where a filter uses them.

Repeated windows are found in the array itself: if all window hashes differ, nothing
repeats (the usual case); else the windows whose hash repeats are sorted as strings with
their places, equal neighbours mark their places, and the marked places' words are counted
once each.

Frequent words are asked for only of texts of ``JUDGED_WORDS`` words and more whose ``lang``
has a list in ``FREQUENT``; a row without a ``lang`` is not judged by this rule. ``judge()``
gives counts and verdict of every row, ``keep()`` drops the rows that the same rules reject.

Defined results: a null or empty text has no words, so it fails; texts of any length are
measured whole; ties and repeated rows do not matter, as each row is judged by itself;
extra columns are kept by ``keep()`` and ignored by ``judge()``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, table, words_of

#: Frequent words by language.
FREQUENT = {
    "en": "the of and to in that is a it for was on with as be by this are at from an he or not have had his her they you we but which i she were been has will would can no if so".split(),
    "fr": "de la le et les des en un du une que pour est par qui dans avec sur pas au ou il elle ne se ce plus son sa ses je nous vous on mais aux cette sont à l d".split(),
    "es": "de la que el en y los se del las un por con no su una para es al lo a o como más pero sus le ya este sí porque esta entre cuando muy sin sobre también".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im nicht dem ein eine als auch es an er sie wir ich hat bei aus nach wie zum war noch nur oder einen einer".split(),
}
#: The share of frequent words is judged from so many words on: 1 / 0.01 of ``frequent_share``.
JUDGED_WORDS = 100
#: Stripped from both ends of a word before it is looked up.
PUNCTUATION = ".,;:!?\"'()[]{}<>«»“”„‘’¿¡…*_-–—|&%#$"

#: (measure, least, most), either may be None. Shares are of words or lines.
RULES = (
    ("n_words", 10, None),
    ("word_length", 1.5, 25.0),
    ("symbol_share", None, 0.25),
    ("frequent_share", 0.01, None),
    ("dup_line_share", None, 0.5),
    ("repeat_share", None, 0.2),
    ("longest_word", None, 1000),
)


def _again(s: Column, what: str) -> Column:
    """The places ``i`` of a sorted array of structs whose field ``what`` a neighbour shares."""
    same = lambda a, b: F.coalesce(F.get(s, a)[what] == F.get(s, b)[what], F.lit(False))
    return F.array_compact(F.transform(s, lambda x, k: F.when(same(k, k - 1) | same(k, k + 1), x["i"])))


def _repeat_words(words: Column, width: int = 5) -> Column:
    """Words that lie in windows of ``width`` words found twice or more in the text."""
    none = F.lit(0).cast("long")

    def exact(w, hashes):
        maybe = bind(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i")))), lambda s: _again(s, "h"))
        keyed = F.array_sort(F.transform(maybe, lambda i: F.struct(F.array_join(F.slice(w, i, width), " ").alias("g"), i.alias("i"))))

        def covered(m):
            rest = F.greatest(F.size(m) - 1, F.lit(0))
            gaps = F.zip_with(F.slice(m, 2, rest), F.slice(m, 1, rest), lambda b, a: F.least(b - a, F.lit(width)).cast("long"))
            return F.when(F.size(m) > 0, F.aggregate(gaps, F.lit(width).cast("long"), lambda a, x: a + x)).otherwise(none)

        return bind(bind(keyed, lambda s: F.array_sort(_again(s, "g"))), covered)

    def windows(w):
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))
        return bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(exact(w, h)))

    return F.when(F.size(words) < width + 1, none).otherwise(windows(words))


def measures(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """What can be counted of a text, its words and its lines that hold a word."""
    frequent = sorted({x for xs in FREQUENT.values() for x in xs})
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeat_words(words),
        "n_frequent": F.size(F.filter(words, lambda w: F.btrim(F.lower(w), F.lit(PUNCTUATION)).isin(*frequent))).cast("long"),
        "longest_word": F.coalesce(F.array_max(F.transform(words, F.char_length)), F.lit(0)).cast("long"),
    }


RATIOS = {
    "word_length": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "n_words"),
    "frequent_share": ("n_frequent", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
}


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def compiled(count: Column, rules, listed: Column) -> Column:
    """The threshold table as one boolean expression over the fields of ``count``."""
    ok = F.lit(True)
    for name, least, most in rules:
        if name in RATIOS:
            top, bottom = (count[n] for n in RATIOS[name])
            value = F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))
        else:
            value = count[name]
        if name == "frequent_share":
            value = F.when(listed & (count["n_words"] >= JUDGED_WORDS), value).otherwise(F.lit(1.0))
        if least is not None:
            ok = ok & (value >= F.lit(least))
        if most is not None:
            ok = ok & (value <= F.lit(most))
    return ok


def judged(docs: DataFrame, rules) -> Column:
    """Of rows (text and maybe lang): a struct of the counts that ``rules`` need and of ``BASE``, ``base_failed`` and ``kept``."""
    needed = {*BASE, *(n for name, _, _ in rules for n in RATIOS.get(name, (name,)))}
    listed = F.coalesce(F.lower("lang").isin(*FREQUENT), F.lit(False)) if "lang" in docs.columns else F.lit(False)

    def counted(x):
        return F.struct(*[c.alias(n) for n, c in measures(x["t"], x["w"], x["l"]).items() if n in needed])

    def verdict(m):
        failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
        return F.struct(*[m[n].alias(n) for n in sorted(needed)], failed.alias("base_failed"), (~failed & compiled(m, rules, listed)).alias("kept"))

    t = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return bind(bind(F.struct(t.alias("t"), words_of(t).alias("w"), lines.alias("l")), counted), verdict)


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the other counts that ``rules`` need, for every row."""
    m = docs.select("doc_id", judged(docs, rules).alias("_m")).select("doc_id", "_m.*")
    return m.select("doc_id", *BASE, "base_failed", "kept", *[c for c in m.columns if c not in ("doc_id", *BASE, "base_failed", "kept")])


def keep(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with exactly the columns of ``docs``."""
    return docs.where(judged(docs, rules)["kept"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


_LISTED = ", ".join(f"'{x}'" for x in FREQUENT)
_FREQUENT = ", ".join(f"'{w}'" for w in sorted({x for xs in FREQUENT.values() for x in xs}))
_TRIMMED = PUNCTUATION.replace("'", "''")
SQL = rf"""
WITH w0 AS (SELECT *, row_number() OVER () AS rid, coalesce(lower(lang) IN ({_LISTED}), false) AS listed,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g0 AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w0 WHERE len(ws) > 5)),
g1 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g0),
g2 AS (SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS step FROM g1 WHERE n > 1),
g3 AS (SELECT rid, CAST(sum(step) AS BIGINT) AS n FROM g2 GROUP BY rid),
m0 AS (SELECT doc_id, listed, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(g3.n, 0) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(list_filter(ws, lambda x: trim(lower(x), '{_TRIMMED}') IN ({_FREQUENT}))) AS BIGINT) AS n_frequent,
    CAST(coalesce(list_max(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS longest_word FROM w0 LEFT JOIN g3 USING (rid)),
m1 AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_frequent, longest_word,
    coalesce(NOT base_failed AND n_words >= 10 AND word_chars / n_words BETWEEN 1.5 AND 25.0 AND n_symbols / n_words <= 0.25
    AND (NOT listed OR n_words < {JUDGED_WORDS} OR n_frequent / n_words >= 0.01) AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.5) AND n_repeat_words / n_words <= 0.2
    AND longest_word <= 1000, false) AS kept FROM m1
"""
