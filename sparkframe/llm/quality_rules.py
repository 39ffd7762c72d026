"""Quality rules: a table of thresholds on text statistics, compiled into one projection.

Every statistic and every rule is a Spark expression over one row; there are no user functions
and no shuffle. Null, empty and blank texts have no words, so the base rule rejects them.
Equal rows are judged alike, extra columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkframe.llm.columns import NONBLANK, carried, let, words

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were "
    "de la et le les des en un du une que est pour qui dans par plus au sur ne se pas sont avec ce il "
    "der die und den von zu das mit sich auf ist im dem nicht ein eine als auch es an werden aus er hat "
    "el los del las por con una su para como al lo más o pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """A text fails where ``metric`` is below ``least`` or above ``most``."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: The method's own rules, beside the base rule. Each is a ratio, so a text's length doesn't matter.
RULES = (
    Rule("word length", "mean_word_chars", 1.5, 25.0),
    Rule("symbols", "symbols_per_word", most=0.15),
    Rule("capitals", "upper_share", most=0.5),
    Rule("stop words", "stop_share", least=0.01),
    Rule("repeated lines", "dup_line_share", most=0.5),
)


#: Bits of a packed window that hold its place; the others hold its hash.
_PLACE_BITS = 20


def _window(w: Column, i: Column) -> Column:
    return F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))


def _covered(at: Column) -> Column:
    """Words under three-word windows that start at the sorted places ``at``."""
    each = F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce((F.get(at, k + 1) - x).cast("int"), F.lit(3))))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)


def _repeat_words_by_text(w: Column) -> Column:
    """The same count from sorting the windows' texts: slower, for any length and any hash."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(_window(w, i).alias("g"), i.alias("i")))

    def starts(s: Column) -> Column:
        same = lambda x, k: (F.get(s, k - 1)["g"] == x["g"]) | (F.get(s, k + 1)["g"] == x["g"])
        return F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"]))

    return let(F.sort_array(windows), lambda s: let(starts(s), _covered))


def _repeat_words(w: Column) -> Column:
    """Words in three-word windows that occur twice or more, the first occurrence included.

    Each window becomes one long, hash above place, so that sorting longs brings equal windows
    together. Windows whose hashes agree are compared as texts. Should two different ones share
    a hash, or a text have more words than places fit, the windows' texts are sorted instead.
    """
    n, low = F.size(w), (1 << _PLACE_BITS) - 1
    packed = F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    place = lambda x: x.bitwiseAND(F.lit(low)).cast("int")

    def near(s: Column) -> Column:
        same = lambda x, y: F.coalesce(F.shiftrightunsigned(x.bitwiseXOR(y), _PLACE_BITS) == 0, F.lit(False))
        return F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))

    def checked(c: Column) -> Column:
        texts = F.transform(c, lambda x: _window(w, place(x)))
        alike = lambda g: F.filter(c, lambda x, k: F.coalesce((F.get(g, k) == F.get(g, k - 1)) | (F.get(g, k) == F.get(g, k + 1)), F.lit(False)))
        found = let(texts, alike)
        return let(found, lambda a: F.when(F.size(a) == F.size(c), let(F.sort_array(F.transform(a, place)), _covered)).otherwise(_repeat_words_by_text(w)))

    quick = let(F.sort_array(packed), lambda s: let(near(s), lambda c: F.when(F.size(c) == 0, F.lit(0).cast("long")).otherwise(checked(c))))
    return F.when(n < 3, F.lit(0).cast("long")).when(n <= low, quick).otherwise(_repeat_words_by_text(w))


def statistics(text: Column) -> Column:
    """A struct of counts and ratios of one text."""
    t = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.char_length(F.regexp_replace(t, pattern, "")).cast("long")
    ratio = lambda a, b: F.coalesce(a.cast("double") / F.nullif(b, F.lit(0).cast("long")), F.lit(0.0))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
            F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS, *(x.capitalize() for x in STOP_WORDS)))).cast("long").alias("n_stop"),
            _repeat_words(w).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(NONBLANK))

    def assembled(w: Column, l: Column, n_symbols: Column, n_upper: Column) -> Column:
        return F.struct(
            *[w[x].alias(x) for x in ("n_words", "word_chars", "n_repeat_words", "n_stop")],
            *[l[x].alias(x) for x in ("n_lines", "n_dup_lines")],
            n_symbols.alias("n_symbols"),
            n_upper.alias("n_upper"),
            ratio(w["word_chars"], w["n_words"]).alias("mean_word_chars"),
            ratio(n_symbols, w["n_words"]).alias("symbols_per_word"),
            ratio(n_upper, w["word_chars"]).alias("upper_share"),
            ratio(w["n_stop"], w["n_words"]).alias("stop_share"),
            ratio(l["n_dup_lines"], l["n_lines"]).alias("dup_line_share"),
            ratio(w["n_repeat_words"], w["n_words"]).alias("repeat_share"),
        )

    return let(
        F.struct(let(words(text), of_words).alias("w"), let(lines, of_lines).alias("l"), count(r"[^#*$%&|<>]+").alias("s"), count(r"[^A-Z]+").alias("u")),
        lambda x: assembled(x["w"], x["l"], x["s"], x["u"]),
    )


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def verdict(s: Column, rules=RULES) -> Column:
    """True where no rule of the table fails."""
    tests = [t for r in rules for t in ([s[r.metric] >= r.least] if r.least is not None else []) + ([s[r.metric] <= r.most] if r.most is not None else [])]
    return functools.reduce(lambda a, b: a & b, tests, F.lit(True))


def failed_rules(s: Column, rules=RULES) -> Column:
    """Names of the rules that a text fails, in the table's order."""
    names = [F.when(~verdict(s, (r,)), F.lit(r.name)) for r in rules]
    return F.filter(F.array(*names), lambda x: x.isNotNull())


def judge(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``row`` (all columns of ``docs``), ``stats``, ``base_failed``, ``kept`` and ``failed_rules``."""
    found = carried(docs, stats=statistics(F.col(f"`{text}`")))
    return found.select("row", "stats", base_failed(F.col("stats")).alias("base_failed"), (~base_failed(F.col("stats")) & verdict(F.col("stats"), rules)).alias("kept"), failed_rules(F.col("stats"), rules).alias("failed_rules"))


def keep_good(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that every rule lets pass, with the columns they came with."""
    return judge(docs, text, rules).filter("kept").select("row.*")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judge(docs).select("row.doc_id", *[F.col(f"stats.{n}").alias(n) for n in names], "base_failed", "kept")


#: DuckDB's regular expressions take the same classes; the ratios are the same divisions.
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
k AS (SELECT row_number() OVER () AS id, * FROM w),
g AS (SELECT id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM k, unnest(range(1, len(w) - 1)) AS u(i)),
r AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT id, count(DISTINCT i + d) AS n FROM r, unnest([0, 1, 2]) AS v(d) GROUP BY id),
s AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
             length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS upper, len(list_filter(w, lambda x: x IN (@STOP@))) AS stop
      FROM k LEFT JOIN c USING (id)),
q AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
             coalesce(word_chars::DOUBLE / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols::DOUBLE / nullif(n_words, 0), 0) AS symbols_per_word,
             coalesce(upper::DOUBLE / nullif(word_chars, 0), 0) AS upper_share, coalesce(stop::DOUBLE / nullif(n_words, 0), 0) AS stop_share,
             coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0) AS dup_line_share FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND @RULES@) AS kept FROM q
""".replace("@STOP@", ", ".join(f"'{y}'" for x in STOP_WORDS for y in (x, x.capitalize()))).replace("@RULES@", " AND ".join(t for r in RULES for t in ([f"{r.metric} >= {r.least}"] if r.least is not None else []) + ([f"{r.metric} <= {r.most}"] if r.most is not None else [])))
