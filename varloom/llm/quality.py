"""Quality rules as a short-circuit cascade of native expressions.

Each rule is a SQL predicate that is true for a document to reject.  `QualityCascade.fit` measures every rule on a
bounded sample (SAMPLE_ROWS documents of at most SAMPLE_FILES files): its rejection rate, and its time, all in one job: between two
rules the clock is read, and what reading it takes is taken off.  Rules are then tried in the order of rejection per cost, inside
one CASE expression, so that a document pays for a rule only if all rules before it passed it.  The order never changes which
documents are kept, only what that costs.

Repeated windows are told by 64-bit hashes of their words: two different windows share one with a probability of 5e-20.

Defined results: a null text has no words and fails `too_short`; ties in rejection per cost are tried in the rules' own
order; an empty table gives an empty table and keeps the rules' own order; repeated rows are judged one by one.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents on which costs and rejection rates are estimated, and files from which they are taken.
SAMPLE_ROWS = 1000
SAMPLE_FILES = 8
#: Documents longer than this are left out of the sample (not of the cascade), which bounds the sample's bytes.
SAMPLE_CHARS = 1_000_000
#: How often a rule is evaluated on each document of the sample; the first time is for the compiler and does not count.
REPEATS = 4
#: SQL: nanoseconds of a clock on the executor, read anew wherever it stands.
CLOCK = "cast(java_method('java.lang.System', 'nanoTime') as long)"
#: Seconds that any rule takes at least.
LEAST_COST = 1e-6
#: Words in a window of which repetition counts.
WINDOW = 8

_SPLIT = r"[\\x20\\x09-\\x0D]+"
_WORD = r"[^\\x20\\x09-\\x0D]"
_SYMBOLS = "[^#*$%&|<>]+"


def words(text: str) -> str:
    """SQL: the array of words of a text (null: none)."""
    return f"array_remove(split(coalesce({text}, ''), '{_SPLIT}'), '')"


def word_lines(text: str) -> str:
    """SQL: the array of the \\n-split lines that hold a word."""
    return f"filter(split(coalesce({text}, ''), '\\n'), l -> l rlike '{_WORD}')"


def n_dup_lines(lines: str) -> str:
    return f"cast(size({lines}) - size(array_distinct({lines})) as long)"


def n_symbols(text: str) -> str:
    return f"cast(length(regexp_replace(coalesce({text}, ''), '{_SYMBOLS}', '')) as long)"


def window_hashes(array: str) -> str:
    """SQL: a 64-bit hash of each window of 8 words, by doubling: of 1, 2, 4 and 8 words."""
    one = f"transform({array}, w -> xxhash64(w))"
    for step in (1, 2, 4):
        one = f"transform(array({one}), h -> transform(h, (x, i) -> xxhash64(x, get(h, i + {step}))))[0]"
    return f"slice({one}, 1, greatest(size({array}) - {WINDOW - 1}, 0))"


def covered_words(windows: str) -> str:
    """SQL: how many words lie in windows whose hash occurs twice or more; only texts with a repeat pay for the sort."""
    pairs = f"array_sort(transform({windows}, (h, i) -> struct(h as h, i as i)))"
    again = f"transform(array({pairs}), s -> filter(s, (x, i) -> coalesce(x.h = get(s, i - 1).h, false) or coalesce(x.h = get(s, i + 1).h, false)))[0]"
    at = f"array_sort(transform({again}, x -> x.i))"
    steps = f"transform(array({at}), p -> transform(p, (x, i) -> least({WINDOW}, coalesce(get(p, i + 1) - x, {WINDOW}))))[0]"
    return f"case when size(array_distinct({windows})) < size({windows}) then aggregate({steps}, 0L, (a, x) -> a + x) else 0L end"


@dataclass(frozen=True)
class Rule:
    """`reject` is SQL over the columns `text`, `words` and `lines` of `prepared`."""

    name: str
    reject: str


#: Thresholds of the rules.  The first two are the contract's base rules.  What a rule uses twice it computes once itself: else
#: Spark would do so ahead of all rules, on nobody's account.
RULES = (
    Rule("too_short", "size(words) < 20"),
    Rule("repeated_windows", f"100 * transform(array({window_hashes('words')}), win -> {covered_words('win')})[0] > 30 * size(words)"),
    Rule("symbols", f"10 * ({n_symbols('text')}) > size(words)"),
    Rule("exclamations", "2 * length(regexp_replace(text, '[^!]+', '')) > size(words)"),
    Rule("upper_case", "10 * length(regexp_replace(text, '[^A-Z]+', '')) > 4 * length(text)"),
    Rule("duplicate_lines", f"10 * ({n_dup_lines('lines')}) > 4 * size(lines)"),
    Rule("few_distinct_words", "transform(array(size(array_distinct(words))), d -> 20 * d < size(words) and d < 200)[0]"),
    Rule("long_words", "length(text) > 40 * size(words)"),
)


def prepared(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One struct column per row of what rules read, so that words and lines are split once."""
    return df.withColumn("_q", F.expr(f"struct(coalesce(`{text_col}`, '') as text, {words(f'`{text_col}`')} as words, {word_lines(f'`{text_col}`')} as lines)"))


def few_files(df: DataFrame, most: int = SAMPLE_FILES) -> DataFrame:
    """Rows of at most `most` files of a table read from Parquet, evenly chosen; tables of other origin as they are."""
    files = sorted(df.inputFiles())
    if len(files) <= most:
        return df
    return df.sparkSession.read.schema(df.schema).parquet(*[files[i * len(files) // most] for i in range(most)])


class QualityCascade:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = tuple(rules)
        self.estimates: dict[str, tuple[float, float]] = {}

    def fit(self, df: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS) -> QualityCascade:
        """Estimate cost (seconds a document) and rejection rate of each rule; gives a cascade in the order of their ratio.

        `df` is the table that the sample is taken of, all of which is read: see `few_files`.
        """
        total = df.count()
        if not total:
            return self
        taken = df.select(F.col(f"`{text_col}`").alias("text")).where(f"text is null or length(text) <= {SAMPLE_CHARS}")
        taken = taken.sample(False, min(1.0, rows / total), seed=7) if total > rows else taken
        sample = prepared(taken).select("_q", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("_time"))
        # a step ends with the clock, which is read once the verdict is there; the first two look at nothing
        nothing = "_q.text is null and _time < 0"
        verdicts = [nothing, nothing, *[_qualified(r.reject) for r in self.rules]]
        steps = [F.expr(f"if({v}, struct(true as hit, {CLOCK} as t), struct(false as hit, {CLOCK} as t))").alias(f"s{i}") for i, v in enumerate(verdicts)]
        timed = sample.select("_time", *steps).where("_time > 1")
        ends = range(1, len(verdicts))
        row = timed.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"s{i}.hit")).alias(f"hits{i}") for i in ends], *[F.sum(F.col(f"s{i}.t") - F.col(f"s{i - 1}.t")).alias(f"took{i}") for i in ends]).first()
        n = row["n"]
        if not n:
            return self
        found = {r.name: (row[f"hits{i}"] / n, (row[f"took{i}"] - row["took1"]) / n / 1e9) for i, r in enumerate(self.rules, 2)}
        out = QualityCascade(self.rules)
        out.estimates = {name: (rejected, max(cost, LEAST_COST)) for name, (rejected, cost) in found.items()}
        out.rules = out.ordered(self.rules, out.estimates)
        return out

    @staticmethod
    def ordered(rules: tuple[Rule, ...], estimates: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
        """By rejection per cost."""
        return tuple(sorted(rules, key=lambda r: -estimates[r.name][0] / estimates[r.name][1])) if estimates else tuple(rules)

    def transform(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """Adds failed_rule (string: the first rule of the cascade that rejects, or null) and kept (boolean)."""
        rows = prepared(df.drop("failed_rule", "kept", "_q"), text_col)
        return rows.withColumn("failed_rule", self.failed()).drop("_q").withColumn("kept", F.col("failed_rule").isNull())

    def failed(self) -> Column:
        out = None
        for rule in self.rules:
            out = (F if out is None else out).when(_verdict(rule), F.lit(rule.name))
        return out.otherwise(F.lit(None).cast("string")) if out is not None else F.lit(None).cast("string")


def _verdict(rule: Rule) -> Column:
    return F.expr(_qualified(rule.reject))


def _qualified(sql: str) -> str:
    return re.sub(r"\b(text|words|lines)\b(?!\s*\()", r"_q.\1", sql)


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed to each row."""
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    rows = prepared(df.drop(*new, "_q", "_h"), text_col).withColumn("_h", F.expr(window_hashes("_q.words")))
    rows = rows.withColumns({
        "n_words": F.expr("cast(size(_q.words) as long)"),
        "word_chars": F.expr("cast(length(array_join(_q.words, '')) as long)"),
        "n_symbols": F.expr(n_symbols("_q.text")),
        "n_dup_lines": F.expr(n_dup_lines("_q.lines")),
        "n_repeat_words": F.expr(covered_words("_h")),
    }).drop("_h")
    return rows.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))


#: The rules that the base columns decide already, and those that only compare them.
BASE_RULES = ("too_short", "repeated_windows")
OF_COLUMNS = {"symbols": Rule("symbols", "10 * n_symbols > n_words"), "duplicate_lines": Rule("duplicate_lines", "10 * n_dup_lines > 4 * size(lines)")}


def judged(df: DataFrame, cascade: QualityCascade, text_col: str = "text") -> DataFrame:
    """`measures` and the cascade's verdict: kept is false where base_failed, else as the other rules decide."""
    # rules that find their counts in the base columns cost no more than a comparison
    rules = tuple(OF_COLUMNS.get(r.name, r) for r in cascade.rules if r.name not in BASE_RULES)
    costs = {name: (rejected, LEAST_COST if name in OF_COLUMNS else cost) for name, (rejected, cost) in cascade.estimates.items()}
    rest = QualityCascade(QualityCascade.ordered(rules, costs))
    rows = measures(df, text_col)
    rows = rows.withColumn("failed_rule", F.when(F.col("base_failed"), F.lit("base")).otherwise(rest.failed()))
    return rows.drop("_q").withColumn("kept", F.col("failed_rule").isNull())
