"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

Null text counts as empty, and texts are read whole. Every row gets a row, whatever its id (null or repeated); ``kept`` is
false for those that fail the base rule or any rule of the table; equal rows get equal verdicts, an empty table gives an
empty one. Columns that the operator uses on its way have names that the table doesn't; where the table has a column of
the name of a count or verdict, ``quality_rules`` gives the computed one and ``passing`` the table's own. No user functions
run, and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[ \t\n\x0B\f\r]+"
SYMBOLS = r"[#*$%&|<>]"
#: Frequent function words of the languages that the rules know.
STOP_WORDS = {
    "en": "the of and to in a is that for it was on are as with be this by from have not but at or".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "es": "de la que el en y a los se del las por un para con no una su al lo como más".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se".split(),
}


@dataclass(frozen=True)
class Rule:
    """Rejects a document whose measure lies outside low..high, if it has at least ``least`` words."""

    measure: str
    low: float | None = None
    high: float | None = None
    least: int = 1


#: Production thresholds.
RULES = (
    Rule("mean_word_chars", low=2.0, high=15.0),
    Rule("symbols_per_word", high=0.1),
    Rule("dup_line_share", high=0.5),
    Rule("repeat_word_share", high=0.5),
    Rule("capital_word_share", high=0.5),
    Rule("bullet_line_share", high=0.9),
    Rule("ellipsis_line_share", high=0.3),
    Rule("stop_word_share", low=0.02, least=50),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: The columns that ``quality_rules`` adds.
COUNTS = ("n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capital", "n_bullet_lines", "n_ellipsis_lines", "n_stop_words", "base_failed", "kept")


def _free(documents: DataFrame) -> str:
    """A prefix that no column of the table has."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in documents.columns):
        prefix += "_"
    return prefix


def measured(documents: DataFrame, text: str = "text", prefix: str | None = None) -> DataFrame:
    """Adds the counts of ``COUNTS``, under names with the prefix."""
    p = _free(documents) if prefix is None else prefix
    stops = sorted({w for words in STOP_WORDS.values() for w in words})
    words, lines, ordered, at = (f"{p}-{c}" for c in ("words", "lines", "ordered", "at"))
    content = f"{p}-text"
    col = lambda name: F.col(f"`{name}`")
    get = lambda name, i: F.get(col(name), i)
    one = documents.withColumn(content, F.coalesce(col(text), F.lit("")))
    one = one.withColumn(words, F.filter(F.split(col(content), SPACES), lambda w: w != ""))
    one = one.withColumn(lines, F.filter(F.split(col(content), "\n"), lambda s: s.rlike(r"[^ \t\n\x0B\f\r]")))
    one = one.withColumn(f"{p}n_words", F.size(col(words)).cast("long")).withColumn(f"{p}n_lines", F.size(col(lines)).cast("long"))
    triples = F.transform(F.sequence(F.lit(0), F.size(col(words)) - 3), lambda i: F.struct(F.xxhash64(get(words, i), get(words, i + 1), get(words, i + 2)).alias("h"), i.alias("i")))
    two = one.withColumn(ordered, F.when(F.col(f"{p}n_words") >= 3, F.sort_array(triples)))
    same = lambda x, j: F.coalesce(get(ordered, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(get(ordered, j + 1)["h"] == x["h"], F.lit(False))
    three = two.withColumn(at, F.sort_array(F.transform(F.filter(col(ordered), same), lambda x: x["i"])))
    covered = F.aggregate(F.transform(col(at), lambda q, j: F.least(F.lit(3), F.coalesce(get(at, j + 1) - q, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    count = lambda c, test: F.size(F.filter(col(c), test)).cast("long")
    counted = {
        "word_chars": F.length(F.array_join(col(words), "")).cast("long"),
        "n_symbols": F.length(col(content)).cast("long") - F.length(F.regexp_replace(col(content), SYMBOLS, "")),
        "n_dup_lines": F.col(f"{p}n_lines") - F.size(F.array_distinct(col(lines))),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
        "n_capital": count(words, lambda w: w.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$")),
        "n_bullet_lines": count(lines, lambda s: s.rlike(r"^\s*[-•*·]\s")),
        "n_ellipsis_lines": count(lines, lambda s: s.rlike(r"(\.\.\.|…)\s*$")),
        "n_stop_words": count(words, lambda w: w.isin(*stops)),
    }
    return three.withColumns({p + name: c for name, c in counted.items()}).drop(content, words, lines, ordered, at)


def verdict(rules: tuple[Rule, ...] = RULES, prefix: str = "") -> Column:
    """True for documents inside every threshold; a measure without a denominator passes."""
    share = lambda n, of: F.col(prefix + n) / F.when(F.col(prefix + of) > 0, F.col(prefix + of))
    measures = {
        "mean_word_chars": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_word_share": share("n_repeat_words", "n_words"),
        "capital_word_share": share("n_capital", "n_words"),
        "bullet_line_share": share("n_bullet_lines", "n_lines"),
        "ellipsis_line_share": share("n_ellipsis_lines", "n_lines"),
        "stop_word_share": share("n_stop_words", "n_words"),
    }
    passes = F.lit(True)
    for rule in rules:
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (measures[rule.measure] < rule.low)
        if rule.high is not None:
            bad = bad | (measures[rule.measure] > rule.high)
        passes = passes & ~(F.coalesce(bad, F.lit(False)) & (F.col(f"{prefix}n_words") >= rule.least))
    return passes


def _judged(documents: DataFrame, text: str, rules: tuple[Rule, ...], p: str) -> DataFrame:
    failed = (F.col(f"{p}n_words") < MIN_WORDS) | (F.lit(100) * F.col(f"{p}n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col(f"{p}n_words"))
    # the verdict looks at a row number, which keeps the optimizer from moving a later filter on it below the projections,
    # where it would repeat their expressions many times over
    judged = measured(documents, text, p).withColumn(f"{p}row", F.monotonically_increasing_id()).withColumn(f"{p}base_failed", failed)
    return judged.withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & verdict(rules, p) & (F.col(f"{p}row") >= 0))


def quality_rules(documents: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The operator: the documents' columns, the counts, base_failed and kept."""
    p = _free(documents)
    own = [F.col(f"`{c}`") for c in documents.columns if c.lower() not in COUNTS]
    return _judged(documents, text, rules, p).select(*own, *(F.col(p + c).alias(c) for c in COUNTS))


def passing(documents: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that are kept, with their own columns."""
    p = _free(documents)
    return _judged(documents, text, rules, p).where(F.col(f"{p}kept")).select(*(F.col(f"`{c}`") for c in documents.columns))
