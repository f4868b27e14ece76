"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Words are runs of anything but ``\\x20`` and ``\\x09`` to ``\\x0D``. The counts are exact; repeated three-word windows
are recognised by 64-bit hashes of their words. A document fails the base rule with fewer than 50 words or when more
than half of its words lie in windows found twice or more, and it is kept if no rule of the table fails either.

A null text has no words; so has an empty one, and both fail the base rule. Each row gives one row, null ids and
repeated rows too. Columns other than doc_id and text play no part. There is no shuffle: a document's arrays live only
while its own row is projected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Frequent words of the corpus languages.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with", "au", "aux", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pour", "que", "qui", "sur", "un", "une", "das", "dem", "den", "der", "die", "ein", "eine", "ist", "mit", "nicht", "und", "von", "zu", "con", "del", "el", "los", "las", "por", "se", "una", "y")


@dataclass(frozen=True)
class Rule:
    """``ratio`` must lie between ``least`` and ``most``."""

    name: str
    ratio: str
    least: float | None
    most: float | None


#: The threshold table; each ratio is SQL over the counts.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2.0, 16.0),
    Rule("symbols_per_word", "n_symbols / n_words", None, 0.1),
    Rule("stop_word_share", "n_stop_words / n_words", 0.01, None),
    Rule("duplicate_line_share", "n_dup_lines / n_lines", None, 0.7),
    Rule("words", "cast(n_words as double)", 50.0, 1000000.0),
)


def _without(col: Column, chars: str) -> Column:
    for c in chars:
        col = F.replace(col, F.lit(c), F.lit(""))
    return col


def counts(docs: DataFrame) -> DataFrame:
    """The exact counts that the rules are about, beside each input row as the struct ``_row``."""
    df = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("_row"), F.expr("coalesce(cast(text as string), '') _t"))
    df = df.withColumn("_w", F.expr(r"filter(split(_t, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"))
    df = df.withColumn("_h", F.expr("transform(_w, w -> xxhash64(w))"))
    # Windows with their places, by hash: equal ones are neighbours.
    df = df.withColumn("_g", F.expr("case when size(_h) >= 3 then array_sort(transform(sequence(0, size(_h) - 3), i -> struct(xxhash64(_h[i], _h[i + 1], _h[i + 2]) as g, i as i))) else array() end"))
    df = df.withColumn("_r", F.expr("array_sort(transform(filter(_g, (x, k) -> (k > 0 and x.g = _g[k - 1].g) or (k < size(_g) - 1 and x.g = get(_g, k + 1).g)), x -> x.i))"))
    df = df.withColumn("_l", F.expr(r"filter(split(_t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    stops = ", ".join(f"xxhash64('{w}')" for w in sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)}))
    found = F.struct(
        F.expr("cast(size(_w) as long)").alias("n_words"),
        F.char_length(_without(F.col("_t"), SPACES)).cast("long").alias("word_chars"),
        (F.octet_length("_t") - F.octet_length(_without(F.col("_t"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.expr("cast(size(_l) - size(array_distinct(_l)) as long)").alias("n_dup_lines"),
        # A window covers three words; of two that overlap the later one adds only what lies beyond the earlier.
        F.expr("cast(aggregate(transform(_r, (x, k) -> case when k = 0 then 3 else least(3, x - _r[k - 1]) end), 0, (a, b) -> a + b) as long)").alias("n_repeat_words"),
        F.expr("cast(size(_l) as long)").alias("n_lines"),
        F.expr(f"cast(size(filter(_h, h -> h in ({stops}))) as long)").alias("n_stop_words"),
    )
    # A generator of one row: filters on the counts stay above it. Pushed below, they would write the expressions into
    # each other over and over.
    return df.select("_row", F.explode_outer(F.array(found)).alias("_found")).select("_row", "_found.*")


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds base_failed, kept and the names of the rules that failed to what :func:`counts` gives."""
    df = df.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    failed = []
    for r in rules:
        over, _, under = r.ratio.partition(" / ")
        value = F.expr(f"coalesce(try_divide({over}, {under or 1}), 0d)")
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (value < F.lit(r.least))
        if r.most is not None:
            bad = bad | (value > F.lit(r.most))
        failed.append(F.when(bad, F.lit(r.name)))
    df = df.withColumn("failed_rules", F.concat_ws(",", *failed))
    return df.withColumn("kept", F.expr("not base_failed and failed_rules = ''"))


def assess(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document with the counts, base_failed and kept."""
    judged = judge(counts(docs.select("doc_id", "text")), rules)
    return judged.select(F.expr("cast(_row.doc_id as long) doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that :func:`assess` keeps, with all their columns."""
    return judge(counts(docs), rules).where("kept").select("_row.*")
