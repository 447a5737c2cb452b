"""Quality rules whose cutoffs are certified on labelled documents.

Every rule measures a share of a document in percent (symbols, capitals, repeated lines, repeated words, word
length) and rejects what exceeds the rule's cutoff. A rule has a short grid of possible cutoffs, fixed beforehand.
The labelled good documents of a stratum are the holdout: none of them has a part in making the grid. For each
stratum, rule and cutoff the hypothesis "more than ``alpha / rules`` of the good documents would be rejected" is
tested with the exact binomial tail. A rule's grid is walked from the mildest cutoff to the strictest and ends at the
first that is not certified (fixed-sequence testing); the walks share the error ``delta`` evenly (Bonferroni over
strata times rules). So with probability 1 - delta no stratum loses more than alpha of its good documents. Without
enough labelled documents nothing is certified and the rule rejects nothing.

Only DataFrame functions. Null or empty texts have no words and fail the base; a null stratum is the empty one;
repeated labels of a document count once, as good if any says so; repeated documents count each time.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysift.llm.common import free_name, own_columns, small_side, stored

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"

#: Rule: numerator, denominator and the cutoffs in percent, mildest first.
RULES = {
    "symbols": ("n_symbols", "word_chars", (40, 30, 20, 10, 5)),
    "capitals": ("n_capitals", "word_chars", (90, 80, 70, 60, 50, 40)),
    "dup_lines": ("n_dup_lines", "n_lines", (90, 80, 70, 60, 50, 40)),
    "repeats": ("n_repeat_words", "n_words", (50, 45, 40, 35, 30)),
    "word_length": ("word_chars", "n_words", (1200, 1100, 1000, 900, 800)),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_lines")
#: ln(x!) for x below 16.
LOG_FACTORIALS = [math.lgamma(x + 1) for x in range(16)]


def with_measures(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the columns of MEASURES; of the own columns only ``keep`` (None: all) stay.

    Windows of three words are hashed; only in a text where a hash comes twice they are sorted by hash and words,
    so that equal windows meet and equal hashes of different words don't count.
    """
    own = docs.columns if keep is None else keep
    body, words, lines, hashes, wins, hits = free_name(docs, "_body", "_words", "_lines", "_hashes", "_wins", "_hits")
    w = F.col(words)
    out = docs.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns({
        words: F.filter(F.split(body, SPACE), lambda x: x != ""),
        lines: F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    starts = F.sequence(F.lit(0), F.size(w) - 3)
    out = out.withColumn(hashes, F.when(F.size(w) >= 4, F.transform(
        starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))
    out = out.withColumn(wins, F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes),
        F.sort_array(F.transform(hashes, lambda h, i: F.struct(
            h.alias("h"), F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))))))
    s = F.col(wins)

    def equal(x: Column, y: Column) -> Column:
        return (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    found = F.filter(s, lambda x, k: ((k > 0) & equal(x, F.get(s, k - 1)))
                     | F.coalesce(equal(x, F.get(s, k + 1)), F.lit(False)))
    out = out.withColumn(hits, F.sort_array(F.transform(found, lambda x: x["i"])))
    covered = F.aggregate(
        hits, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return out.select(*own_columns(docs, own), *(c.cast("long").alias(n) for n, c in {
        "n_words": F.size(w), "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.coalesce(covered, F.lit(0)), "n_capitals": F.regexp_count(body, F.lit("[A-Z]")),
        "n_lines": F.size(lines),
    }.items()))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def exceeds(rule: str, cutoff: Column) -> Column:
    """Whether the rule's share is above the cutoff; integers only, so that no rounding decides."""
    top, bottom, _ = RULES[rule]
    return 100 * F.col(top) > cutoff * F.col(bottom)


def log_factorial(x: Column) -> Column:
    """ln(x!): a table below 16, then Stirling's series (relative error below 1e-14)."""
    small = F.element_at(F.array(*map(F.lit, LOG_FACTORIALS)), F.least(x, F.lit(15)).cast("int") + 1)
    y = F.greatest(x, F.lit(16)).cast("double")
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return F.when(x < 16, small).otherwise((y + 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial variable where k < n p, else 1 (never small there).

    The terms are summed downwards from k, each from the one before; they fall at least like a normal density, so
    40 standard deviations of them are all that doubles can hold.
    """
    k, n = k.cast("long"), n.cast("long")
    first = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k)
                  + k * math.log(p) + (n - k) * math.log1p(-p))
    steps = F.least(k, F.ceil(40 * F.sqrt(n * p)) + 60)
    summed = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(0).cast("long"), steps - 1)).otherwise(F.array().cast("array<bigint>")),
        F.struct(first.alias("t"), first.alias("s")),
        lambda a, i: F.struct((a["t"] * (k - i) * (1 - p) / ((n - k + i + 1) * p)).alias("t"),
                              (a["s"] + a["t"] * (k - i) * (1 - p) / ((n - k + i + 1) * p)).alias("s")),
        lambda a: a["s"])
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(summed)


def fit_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", doc_id: str = "doc_id",
                good: str = "quality", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """One row per stratum with a certified cutoff: column ``cut_<rule>`` holds the rule's strictest, or null.

    Labels and documents meet on the id (a shuffle of narrow rows); the counts are one aggregation.
    """
    marks = (labels.groupBy(F.col(doc_id).alias("_id")).agg(F.max(good).alias("_good")).where("_good = 1"))
    holdout = (measured.where(~base_failed())
               .select(F.col(doc_id).alias("_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum"),
                       *MEASURES)
               .join(marks, "_id"))
    # every document falls below one step of each rule's grid, so a row per stratum, rule and step is all that is summed
    steps = F.explode(F.array(*(F.struct(
        F.lit(r).alias("rule"), sum((exceeds(r, F.lit(c)).cast("int") for c in grid), F.lit(0)).alias("passed"))
        for r, (_, _, grid) in RULES.items())))
    tally = (holdout.select("_stratum", steps.alias("_s")).groupBy("_stratum", "_s.rule", "_s.passed")
             .agg(F.count("*").alias("n")))
    grids = F.create_map(*(x for r, (_, _, g) in RULES.items() for x in (F.lit(r), F.array(*map(F.lit, g)))))
    cells = (tally.groupBy("_stratum", "rule")
             .agg(F.sum("n").alias("n"), F.collect_list(F.struct("passed", "n")).alias("at"))
             .select("_stratum", "rule", "n", "at", F.posexplode(grids[F.col("rule")]).alias("step", "cut"))
             .withColumn("k", F.aggregate(F.filter("at", lambda x: x["passed"] > F.col("step")),
                                          F.lit(0).cast("long"), lambda a, x: a + x["n"])))
    strata = F.broadcast(holdout.agg(F.countDistinct("_stratum").alias("_strata")))
    level = F.lit(delta) / (F.col("_strata") * len(RULES))
    # tails grow with the strictness, so the strictest that passes ends an unbroken walk
    certified = (cells.withColumn("p", binomial_tail(F.col("k"), F.col("n"), alpha / len(RULES)))
                 .crossJoin(strata).where(F.col("p") <= level))
    return (certified.groupBy("_stratum").pivot("rule", list(RULES)).agg(F.min("cut"))
            .select("_stratum", *(F.col(r).alias(f"cut_{r}") for r in RULES)))


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Add ``base_failed`` and ``kept``; cutoffs are joined by the stratum, broadcast when counted as small."""
    joined = (measured.withColumn("_stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
              .join(small_side(cutoffs), "_stratum", "left"))
    bad = F.lit(False)
    for rule in RULES:
        bad = bad | F.coalesce(exceeds(rule, F.col(f"cut_{rule}")), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~bad)


def apply_rules(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
                stratum: str = "lang", keep: list[str] | None = None, **risk) -> DataFrame:
    """Measure, certify and judge; returns ``keep`` (None: all columns of ``docs``), MEASURES, base_failed, kept."""
    own = docs.columns if keep is None else keep
    measured = stored(with_measures(docs, text, list(dict.fromkeys([*own, doc_id, stratum]))), "rules")
    cutoffs = stored(fit_cutoffs(measured, labels, stratum, doc_id, **risk), "cutoffs")
    return judge(measured, cutoffs, stratum).select(*own_columns(docs, own), *MEASURES, "base_failed", "kept")


def kept_documents(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", stratum: str = "lang",
                   **risk) -> DataFrame:
    """The documents that pass, with their own columns; names that this module uses are put aside meanwhile."""
    used = {n.lower() for n in (*MEASURES, "base_failed", "kept", "_stratum", *(f"cut_{r}" for r in RULES))}
    clash = [c for c in docs.columns if c.lower() in used]
    aside = dict(zip(clash, free_name(docs, *(f"_own_{c}" for c in clash))))
    names = [aside.get(c, c) for c in docs.columns]
    held = docs.select(*(c.alias(n) for c, n in zip(own_columns(docs), names)))
    judged = apply_rules(held, labels, *(aside.get(c, c) for c in (text, doc_id, stratum)), **risk)
    return judged.where("kept").select(*(c.alias(n) for c, n in zip(own_columns(held), docs.columns)))
