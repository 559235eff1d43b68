"""Quality rules whose cutoffs are set from labels under a risk guarantee.

``measure`` counts words, symbols and repetition in each text.  ``calibrate``
turns the measures into rules: for each stratum (a language, unless told
otherwise) and each rule of ``RULES`` it tries every cutoff of the rule's grid
on a labelled holdout.  A cutoff may be used if the exact binomial upper bound
on its rate of false rejections (labelled good, but beyond the cutoff) is at
most ``alpha`` / number of rules, at level ``delta`` / number of all tests in
all strata (Bonferroni), so that with probability 1 - ``delta`` no stratum's
rules together reject more than ``alpha`` of its good documents.  Of the usable
cutoffs the one is taken that rejects most labelled bad documents, a good one
counting ``GOOD_COST`` times; the largest of those that tie.  A stratum with too
few labels to prove anything keeps all that passes the base rules.

All of it is DataFrame functions; no Python runs on executors.

Defined results: a null text has no words (and so fails the base rules); a null
stratum is a stratum of its own; several labels of a document count as good if
all are; a null label is none; repeated documents count once per row; with no
labels every verdict is the base rules'; an empty table gives no rows.  Other
columns pass through untouched, but those named like one of its own, all of which
begin with ``q_`` (or ``cut_``), are replaced or dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.scratch import save, tidied

SPACE, NOT_SPACE = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
#: rule: (measure as SQL, cutoffs); a document is rejected if its measure is above the cutoff.
RULES = {
    "symbols": ("q_n_symbols / greatest(q_n_words, 1)", [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0, 1.5, 2.0, 2.5]),
    "dup_lines": ("q_n_dup_lines / greatest(q_n_lines, 1)", [0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]),
    "repeats": ("q_n_repeat_words / greatest(q_n_words, 1)", [0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45]),
    "long_words": ("q_word_chars / greatest(q_n_words, 1)", [6.5, 7.0, 7.5, 8.0, 8.5, 9.0, 10.0, 12.0]),
}
GOOD_COST = 20.0
#: Terms of the binomial sum that are added one by one; the rest is bounded from above.
TERMS = 4096
#: Strata with a rule that a broadcast may hold; beyond it the join shuffles.
BROADCAST_STRATA = 10_000


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with q_n_words, q_word_chars, q_n_symbols, q_n_lines, q_n_dup_lines, q_n_repeat_words (long).

    A 3-word window is known by its 64-bit hash.  Each text is worked on in
    time that grows as its words times their logarithm.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(NOT_SPACE))
    out = docs.withColumns({"q_words": F.array_remove(F.split(body, SPACE, -1), ""), "q_lines": lines, "q_n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long")})
    n = F.size("q_words")
    window = F.arrays_zip(*(F.slice("q_words", k, F.greatest(n - 2, F.lit(0))) for k in (1, 2, 3)))
    out = out.withColumns(
        {
            "q_n_words": n.cast("long"),
            "q_word_chars": F.aggregate("q_words", F.lit(0).cast("long"), lambda a, x: a + F.length(x)),
            "q_n_lines": F.size("q_lines").cast("long"),
            "q_n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
            "q_windows": F.transform(window, lambda x: F.xxhash64(x)),
        }
    ).drop("q_words", "q_lines")
    pairs = F.sort_array(F.transform("q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("q_sorted", F.when(F.size(F.array_distinct("q_windows")) < F.size("q_windows"), pairs)).drop("q_windows")
    twice = F.transform(
        "q_sorted", lambda x, k: F.when((x["h"] == F.get("q_sorted", k - 1)["h"]) | (x["h"] == F.get("q_sorted", k + 1)["h"]), x["i"])
    )
    places = F.sort_array(F.filter(twice, lambda i: i.isNotNull()))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return out.withColumn("q_n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("q_sorted")


def base_failed(least_words: int = 50, most_repeat_percent: int = 50) -> Column:
    return (F.col("q_n_words") < least_words) | (100 * F.col("q_n_repeat_words") > most_repeat_percent * F.col("q_n_words"))


def _ln_gamma(x: Column) -> Column:
    """ln(gamma(x)) for x >= 1, by Stirling's series at x + 8."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    shift = F.lit(0.0)
    for k in range(8):
        shift = shift + F.log(x + k)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for k < n * p, else 1; never below the true value but for rounding.

    It is at most a level exactly when the exact (Clopper-Pearson) upper bound
    of k / n at that level is at most p.
    """
    kd, nd, odds = k.cast("double"), n.cast("double"), (1 - p) / p
    first = _ln_gamma(nd + 1) - _ln_gamma(kd + 1) - _ln_gamma(nd - kd + 1) + kd * F.log(F.lit(p)) + (nd - kd) * F.log(F.lit(1 - p))
    sums = F.aggregate(
        F.sequence(F.lit(0), F.least(k, F.lit(TERMS)).cast("int")),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("ratio")),
        lambda a, i: F.struct(
            (a["term"] * (kd - i) / (nd - kd + i + 1) * odds).alias("term"), (a["sum"] + a["term"]).alias("sum"), ((kd - i) / (nd - kd + i + 1) * odds).alias("ratio")
        ),
        lambda a: a["sum"] + a["term"] / (1 - a["ratio"]),
    )
    return F.when(kd < nd * p, F.least(F.lit(1.0), F.exp(first) * sums)).otherwise(F.lit(1.0))


def calibrate(measured: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """stratum, and of the cutoffs that labels prove safe one for each rule (null: the rule is off)."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("good")).where(F.col("good").isNotNull())
    held = measured.where(~base_failed()).select("doc_id", F.col(stratum).cast("string").alias("stratum"), *RULE_COLUMNS).join(good, "doc_id")
    steps = [
        F.struct(F.lit(name).alias("rule"), sum((F.when(F.expr(value) > c, 1).otherwise(0) for c in cuts), F.lit(0)).alias("above"))
        for name, (value, cuts) in RULES.items()
    ]
    counts = (
        held.select("stratum", (F.col("good") > 0).alias("good"), F.explode(F.array(*steps)).alias("s"))
        .groupBy("stratum", "s.rule", "s.above")
        .agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
        .groupBy("stratum", "rule")
        .agg(F.collect_list(F.struct("above", "good", "bad")).alias("bins"), F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"))
    )  # at most one bin for each cutoff and one more
    grid = F.create_map(*(x for name, (_, cuts) in RULES.items() for x in (F.lit(name), F.array(*map(F.lit, cuts)))))

    def beyond(part: str, at: Column) -> Column:
        return F.aggregate("bins", F.lit(0).cast("long"), lambda a, b: a + F.when(b["above"] > at, b[part]).otherwise(0))

    tries = counts.select("stratum", "rule", "n_good", "n_bad", "bins", F.posexplode(grid[F.col("rule")]).alias("at", "cutoff"))
    tries = tries.withColumns({"k": beyond("good", F.col("at")), "caught": beyond("bad", F.col("at"))}).drop("bins")
    n_tests = sum(len(cuts) for _, cuts in RULES.values()) * counts.select("stratum").distinct().count()
    safe = binomial_tail(F.col("k"), F.col("n_good"), alpha / len(RULES)) <= delta / max(n_tests, 1)
    gain = F.col("caught") / F.greatest("n_bad", F.lit(1)) - GOOD_COST * F.col("k") / F.greatest("n_good", F.lit(1))
    best = tries.where((F.col("caught") > 0) & safe).withColumn("gain", gain).where("gain > 0").groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("gain", "cutoff")).alias("cutoff"))
    return best.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"cut_{name}") for name in RULES))


RULE_COLUMNS = ["q_n_words", "q_word_chars", "q_n_symbols", "q_n_lines", "q_n_dup_lines", "q_n_repeat_words"]


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """measured with q_base_failed and q_kept."""
    table = save(cutoffs.withColumnRenamed("stratum", "q_stratum"), "cutoffs")
    if table.count() <= BROADCAST_STRATA:
        table = F.broadcast(table)
    out = measured.join(table, F.col(stratum).cast("string").eqNullSafe(F.col("q_stratum")), "left")
    rejected = F.lit(False)
    for name, (value, _) in RULES.items():
        rejected = rejected | F.coalesce(F.expr(value) > F.col(f"cut_{name}"), F.lit(False))
    out = out.withColumn("q_base_failed", base_failed()).withColumn("q_kept", ~F.col("q_base_failed") & ~rejected)
    return out.drop("q_stratum", *(f"cut_{name}" for name in RULES))


@tidied
def assess(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """docs with all q_ columns; what is measured is kept in the shared folder and read twice."""
    measured = save(measure(docs), "measured")
    return judge(measured, calibrate(measured, labels, stratum), stratum)
