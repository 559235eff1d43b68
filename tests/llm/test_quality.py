import math
import random

import pytest

from lattica.llm import quality

MEASURES = {
    "symbols": lambda r: r["q_n_symbols"] / max(r["q_n_words"], 1),
    "dup_lines": lambda r: r["q_n_dup_lines"] / max(r["q_n_lines"], 1),
    "repeats": lambda r: r["q_n_repeat_words"] / max(r["q_n_words"], 1),
    "long_words": lambda r: r["q_word_chars"] / max(r["q_n_words"], 1),
}


def _tail(k, n, p):
    """P(Binomial(n, p) <= k), term by term; 1 from the mean on."""
    if k >= n * p:
        return 1.0
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))


def _cutoffs(rows, good_of, alpha=0.05, delta=0.05):
    """calibrate() in plain Python: (stratum, rule) -> cutoff."""
    strata = {}
    for r in rows:
        good = good_of.get(r["doc_id"])
        if good is not None and r["q_n_words"] >= 50 and 100 * r["q_n_repeat_words"] <= 50 * r["q_n_words"]:
            strata.setdefault(r["lang"], []).append((r, good > 0))
    n_tests = len(strata) * sum(len(cuts) for _, cuts in quality.RULES.values())
    out = {}
    for stratum, held in strata.items():
        n_good = sum(g for _, g in held)
        n_bad = len(held) - n_good
        for name, (_, cuts) in quality.RULES.items():
            usable = []
            for cut in cuts:
                beyond = [g for r, g in held if MEASURES[name](r) > cut]
                k, caught = sum(beyond), len(beyond) - sum(beyond)
                gain = caught / max(n_bad, 1) - quality.GOOD_COST * k / max(n_good, 1)
                if caught and gain > 0 and _tail(k, n_good, alpha / len(quality.RULES)) <= delta / n_tests:
                    usable.append((gain, cut))
            if usable:
                out[stratum, name] = max(usable)[1]
    return out


def _table(seed, sizes):
    """Measured documents and their labels: bad ones have more symbols, lines twice, repeats and long words."""
    rng, rows, labels = random.Random(seed), [], []
    for lang, size in sizes.items():
        for _ in range(size):
            bad, n = rng.random() < 0.3, rng.randint(20, 400)
            row = {"doc_id": len(rows), "lang": lang, "q_n_words": n, "q_word_chars": int(n * rng.uniform(4, 6.4 + 3 * bad)), "q_n_symbols": int(n * rng.uniform(0, 0.04 + 0.5 * bad))}
            row |= {"q_n_lines": 20, "q_n_dup_lines": rng.randint(0, 2 + 12 * bad), "q_n_repeat_words": int(n * rng.uniform(0, 0.1 + 0.45 * bad))}
            rows.append(row)
            if rng.random() < 0.9:
                wrong = rng.random() < 0.002
                labels.append((row["doc_id"], int(bad == wrong)))
    labels += labels[:5] + [(labels[0][0], 0), (None, 1), (10**9, 0), (rows[-1]["doc_id"], None)]
    return rows, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_cutoffs_of_every_stratum_against_plain_python(spark, seed):
    rows, labels = _table(seed, {"en": 6000, "de": 2500, "fr": 2500, "es": 2500, None: 1500, "tiny": 60})
    schema = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in quality.RULE_COLUMNS)
    measured = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    good_of = {}
    for doc, label in labels:
        if label is not None:
            good_of[doc] = min(label, good_of.get(doc, label))
    want = _cutoffs(rows, good_of)
    assert {s for s, _ in want} == {"en", "de", "fr", "es", None} and {n for _, n in want} == {*quality.RULES}
    cutoffs = quality.calibrate(measured, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {(r.stratum, n): r[f"cut_{n}"] for r in cutoffs.collect() for n in quality.RULES if r[f"cut_{n}"] is not None}
    assert got == want
    kept = {r.doc_id: r.q_kept for r in quality.judge(measured, cutoffs).collect()}
    for r in rows:
        base = r["q_n_words"] < 50 or 100 * r["q_n_repeat_words"] > 50 * r["q_n_words"]
        assert kept[r["doc_id"]] == (not base and not any((r["lang"], n) in want and f(r) > want[r["lang"], n] for n, f in MEASURES.items()))
    good = [r for r in rows if good_of.get(r["doc_id"]) == 1 and r["q_n_words"] >= 50]
    assert sum(not kept[r["doc_id"]] for r in good) <= 0.05 * len(good)


def test_binomial_tail_against_the_exact_sum(spark):
    cases = [(k, n) for n in (1, 30, 640, 5000) for k in (0, 1, 3, n // 90, n // 50) if k <= n]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_tail(quality.F.col("k"), quality.F.col("n"), 0.0125).alias("p")).collect()
    for r in got:
        exact = _tail(r.k, r.n, 0.0125)
        assert r.p >= exact * (1 - 1e-9) and r.p == pytest.approx(exact, rel=1e-6)
