"""Operator 1, quality rules: host verdicts from shrunk failure rates.

Every document is measured by rules; failures are added up per host; a host's
rate for a rule is shrunk towards the rate of all hosts with a beta prior that
is fitted to the hosts themselves (method of moments); a host whose shrunk rate
is certainly high gets a verdict, and the verdict is joined back.

Defined results: a null text has no words and fails the base rule; a null host
is a host of its own; repeated rows are rows; an empty table gives no rows;
further columns pass through, except that the names below are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attesta.llm.common import let, text_of, words_of
from attesta.session import materialize

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = r"[#*$%&|<>]"

#: Rules that are counted per host: name -> condition on the metrics, in integers.
RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 12 * n_words",
    "dup_lines": "10 * n_dup_lines > n_words",
}
#: Hosts: at least so many of 1000 documents must certainly fail one rule.
BAD_PERMILLE = 800
#: Bad hosts that may be broadcast.
BROADCAST_HOSTS = 10_000
#: Posterior standard deviations that "certainly" takes off the shrunk rate.
CERTAIN = 2.0


def _covered(words: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more."""
    def grams(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                           lambda i: F.concat_ws(" ", w[i], w[i + 1], w[i + 2]))

    def repeated(g):
        ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        at = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (
            (j > 0) & (F.get(s, j - 1)["g"] == F.get(s, j)["g"])
        ) | ((j < F.size(s) - 1) & F.coalesce(F.get(s, j + 1)["g"] == F.get(s, j)["g"], F.lit(False))))
        return let(ordered, lambda s: F.sort_array(F.transform(at(s), lambda j: F.get(s, j)["i"])))

    def cover(p):
        return F.aggregate(p, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, x: F.struct(
            x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")))["n"]

    # Equal windows have equal hashes: without an equal hash nothing repeats.
    hashes = F.slice(F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2))),
                     1, F.size(words) - 2)
    return (
        F.when(F.size(words) < 4, F.lit(0))
        .when(let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h)), F.lit(0))
        .otherwise(let(let(grams(words), repeated), cover))
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the metrics of the whole text."""
    t = text_of(text)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _covered(w).cast("long").alias("n_repeat_words")))
    return (
        docs.drop(*METRICS, "_m").withColumn("_m", counts)
        .withColumns({
            "n_words": F.col("_m.n_words"), "word_chars": F.col("_m.word_chars"),
            "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": F.col("_m.n_repeat_words"),
        })
        .drop("_m")
    )


def base_failed() -> Column:
    return F.expr(f"{RULES['short']} or {RULES['repetitive']}")


def host_verdicts(measured: DataFrame, host: str = "source", bad_permille: int = BAD_PERMILLE,
                  certain: float = CERTAIN) -> DataFrame:
    """One row per host that has a bad verdict: its key and the rules that it fails.

    Rates are shrunk with a beta prior fitted to the hosts' own rates: with
    mean m and between-host variance v of the rates (weighted by documents),
    the prior's weight is m(1-m)/v - 1.  The moments are one row of a few
    numbers, whatever the input, and reach the plan as literals.
    """
    fails = [F.sum(F.expr(cond).cast("long")).alias(f"k_{name}") for name, cond in RULES.items()]
    # Written once: the moments and the verdicts read it, the documents are measured one time only.
    hosts = materialize(measured.groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("n"), *fails), "hosts")
    rows = hosts.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"),
        *[F.sum(f"k_{r}").alias(f"k_{r}") for r in RULES],
        *[F.sum(F.col(f"k_{r}") * F.col(f"k_{r}") / F.col("n")).alias(f"s_{r}") for r in RULES],
    ).first()
    bad = []
    for r in RULES:
        mean, weight = prior(rows["n"] or 0, rows[f"k_{r}"] or 0, rows[f"s_{r}"] or 0.0)
        a, b = F.lit(mean * weight), F.lit((1 - mean) * weight)
        k, n = F.col(f"k_{r}"), F.col("n")
        rate = (k + a) / (n + a + b)
        sd = F.sqrt(rate * (1 - rate) / (n + a + b + 1))
        bad.append(F.when((rate - certain * sd) * 1000 >= bad_permille, F.lit(r)))
    verdict = F.concat_ws(",", *bad)
    return hosts.select("_host", verdict.alias("host_fails")).filter("host_fails <> ''")


def prior(n: int, k: int, square: float) -> tuple[float, float]:
    """Mean and weight of the beta prior from n documents, k failures and sum k_h^2/n_h.

    No spread, or no failures at all, gives the strongest prior that is used
    (10,000 documents); the weakest is one document.
    """
    if not n:
        return 0.0, 1.0
    mean = k / n
    spread = max(0.0, square / n - mean * mean)
    weight = mean * (1 - mean) / spread - 1 if spread > 0 and 0 < mean < 1 else 10_000.0
    return mean, min(10_000.0, max(1.0, weight))


def judge(measured: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """Joins the verdicts back: adds ``base_failed``, ``host_fails`` and ``kept``.

    The right side holds bad hosts only, and is counted: up to BROADCAST_HOSTS
    it is sent to the documents, which then do not move; beyond it the
    documents are the left side of a plain join, whose hot hosts adaptive
    execution splits.
    """
    if verdicts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    out = measured.drop("base_failed", "kept", "host_fails", "_host")
    out = out.join(verdicts, out[host].eqNullSafe(verdicts["_host"]), "left").drop("_host")
    return out.withColumns({
        "base_failed": base_failed(),
        "kept": ~base_failed() & F.col("host_fails").isNull(),
        "host_fails": F.coalesce("host_fails", F.lit("")),
    })

