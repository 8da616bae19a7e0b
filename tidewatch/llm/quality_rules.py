"""Quality rules whose cutoffs are held to a limited rate of false rejections, stratum by stratum. DataFrame functions only.

A rule rejects a text whose measure reaches a cutoff. For each stratum (a language), each rule and each cutoff of a
fixed grid, the labelled good texts of the stratum are the holdout: with k of n rejected, the exact binomial tail
``P(X <= k), X ~ Binomial(n, RISK)`` is the chance of so few if the true rate were ``RISK`` or more. A cutoff is
certified when that is at most ``CONFIDENCE / tests``, which corrects for all tests of all strata (Bonferroni), so with
probability ``1 - CONFIDENCE`` no certified cutoff of any stratum rejects ``RISK`` or more of its good texts. Each rule
takes its strictest certified cutoff; without one (too few labels, too many good texts beyond each cutoff) it rejects
nothing in that stratum. A text passes if no rule rejects it, so at most ``len(GRID) * RISK`` of good texts are lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.graph import stored

#: Largest true rate of good texts that one rule may reject in a stratum, and the chance that any cutoff exceeds it.
RISK, CONFIDENCE = 0.005, 0.05
#: Measures are whole numbers: shares in thousandths, mean word length in tenths of a character.
GRID = {
    "symbol_share": [50, 100, 150, 200, 250, 300, 400, 500, 600, 800],
    "line_share": [100, 200, 300, 400, 500, 600, 700, 800, 900],
    "repeat_share": [50, 100, 150, 200, 300, 400, 500, 600, 700, 800, 900],
    "mean_length": [60, 65, 70, 75, 80, 90, 100, 120, 150, 200],
}
SYMBOLS = "#*$%&|<>"
SPACE = r"[\x20\x09-\x0D]+"


def once(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(hashes: Column) -> Column:
    """How many words lie in five-word windows (given by their hashes) that the text has twice or more."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(all_placed: Column) -> Column:
        again = F.filter(
            all_placed,
            lambda p, j: (p["h"] == F.get(all_placed, j - 1)["h"]) | (p["h"] == F.get(all_placed, j + 1)["h"]),
        )
        return F.sort_array(F.transform(again, lambda p: p["i"]))

    covered = F.aggregate(
        once(placed, starts),
        F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last")),
    )
    return covered["n"]


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, stratum``, the counts of the base rules and the measures of the grid, for every whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    cut = docs.select(
        F.col("doc_id"),
        lang.alias("stratum"),
        F.array_remove(F.split(text, SPACE), "").alias("words"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    words = F.col("words")
    window = F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 4, F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, 5)]),
    )
    hashed = cut.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        window.alias("windows"),
    )
    counted = hashed.withColumn(
        "n_repeat_words",
        F.when(F.size("windows") == F.size(F.array_distinct("windows")), F.lit(0))
        .otherwise(repeated_words(F.col("windows")))
        .cast("long"),
    )

    def share(part: str, whole: str, unit: int) -> Column:
        return F.when(F.col(whole) > 0, F.expr(f"{unit} * {part} DIV {whole}")).otherwise(F.lit(0)).cast("long")

    return counted.select(
        "doc_id",
        "stratum",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "word_chars", 1000).alias("symbol_share"),
        share("n_dup_lines", "n_lines", 1000).alias("line_share"),
        share("n_repeat_words", "n_words", 1000).alias("repeat_share"),
        share("word_chars", "n_words", 10).alias("mean_length"),
    )


def tail(k: Column, n: Column, risk: float) -> Column:
    """``P(X <= k)`` for ``X ~ Binomial(n, risk)`` where ``k`` is below its mean, else 1: summed in logarithms."""
    step = F.log(F.lit(risk / (1 - risk)))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + step
        high, low = F.greatest(a["sum"], term), F.least(a["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    first = n * F.log1p(F.lit(-risk))
    steps = F.filter(F.sequence(F.lit(0).cast("long"), k), lambda i: i > 0)
    whole = F.aggregate(steps, F.struct(first.alias("term"), first.alias("sum")), add)
    return F.when(k < n * risk, F.exp(whole["sum"])).otherwise(F.lit(1.0))


def certified(texts: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """``stratum`` and, for each rule, its strictest certified cutoff (null: none)."""
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    tests = [(rule, cut) for rule, cuts in GRID.items() for cut in cuts]
    counts = (
        texts.where("NOT base_failed")
        .join(good.select("doc_id"), "doc_id")
        .groupBy("stratum")
        .agg(
            F.count("*").alias("n"),
            *[F.sum((F.col(rule) >= cut).cast("long")).alias(f"{rule}_{cut}") for rule, cut in tests],
        )
    )
    counts = stored(counts, "holdout")
    strata = counts.count()
    each = counts.select(
        "stratum",
        "n",
        F.explode(
            F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cut"), F.col(f"{r}_{c}").alias("k")) for r, c in tests])
        ).alias("t"),
    ).select("stratum", "n", "t.rule", "t.cut", "t.k")
    fine = each.where(tail(F.col("k"), F.col("n"), risk) <= F.lit(confidence / max(1, strata * len(tests))))
    return fine.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cut"))).alias(f"{r}_cut") for r in GRID])


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``, ``lang``): ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept``, then the measures and the cutoffs that held for the row's stratum.

    ``labels`` has ``doc_id`` and ``quality`` (1 is good); a document with several labels is good if all are.
    ``base_failed``: fewer than 10 words, or more than a fifth of the words within five-word windows that the text
    has twice. ``kept`` is false then, else what the certified rules say.

    A null text has no words and fails. A null language is the stratum ''. Labels without a document, null doc_ids and
    null qualities count for nothing. Repeated rows are judged one by one; a row of ``docs`` that repeats counts again
    in its holdout. Without labels no rule rejects. Other columns are ignored; an empty table gives an empty one.
    """
    texts = stored(measured(docs), "measures")
    cuts = certified(texts, labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality")), risk, confidence)
    rejected = F.lit(False)
    for rule in GRID:
        rejected = rejected | F.coalesce(F.col(rule) >= F.col(f"{rule}_cut"), F.lit(False))
    return texts.join(cuts, "stratum", "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~rejected).alias("kept"),
        *GRID,
        *[f"{rule}_cut" for rule in GRID],
    )
