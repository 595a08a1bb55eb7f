"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good (2), votes bad (0) or abstains (1) on a document.  Nobody knows which rules are right: the votes of
all documents are counted by their pattern (eight rules, so at most 3**8 = 6,561 rows, whatever the input), and
expectation-maximisation on those counts estimates how often each rule votes each way on good and on bad documents.
A document's log-odds are then a sum of one weight per rule, a plain column expression.

Defined cases: a null text counts as empty (no words, fails the base rules); a null doc_id is carried through; repeated
rows are judged one by one and alike; an empty table gives an empty result; further columns are ignored by
:func:`judge` and kept by :func:`keep_good`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import WHITE, fresh, saved

RULES = 8
#: The posterior from which a document is kept.  Losing a good document costs far more than keeping a bad one, so a
#: document goes only if it is bad by odds of a thousand to one: as a rule two rules or more must have voted against it.
KEEP_FROM = 0.001
#: What EM starts from and is drawn to: chances of the votes bad, abstain and good for a bad and for a good document, worth PRIOR_ROWS documents.
PRIOR_VOTES = {"bad": (0.25, 0.15, 0.60), "good": (0.003, 0.1, 0.897)}
PRIOR_ROWS, PRIOR_GOOD, EM_ROUNDS = 20.0, 0.8, 60


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and the counts of every whole text that the rules read.

    The windows of five words are compared by their 64-bit hashes within one document.  Hashes are sorted with their
    places only in documents that hold some hash twice.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*keep, text.alias("_t")).withColumn("_trim", F.btrim(F.col("_t"), F.lit(WHITE)))
    df = df.withColumn("_words", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", r"[\x20\x09-\x0D]+")))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    df = df.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_trim", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("_trim") - F.length(F.translate("_trim", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length("_trim") - F.length(F.translate("_trim", "!?", ""))).cast("long").alias("n_marks"),
        F.length(F.regexp_replace("_trim", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("_trim", r"\P{L}+", "")).cast("long").alias("n_letters"),
        lines.alias("_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"),
    )
    df = df.withColumn("_windows", F.when(F.col("n_words") >= 5, F.transform(F.sequence(F.lit(0), F.size("_h") - 5), lambda i: F.xxhash64(*(F.get("_h", i + k) for k in range(5))))).otherwise(F.array().cast("array<bigint>")))
    df = df.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_marks", "n_upper", "n_letters",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("_h")).cast("long").alias("n_distinct"),
        F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_sorted"),
    )
    twice = F.transform("_sorted", lambda x, k: F.when((F.get("_sorted", k + 1)["h"] == x["h"]) | (F.get("_sorted", k - 1)["h"] == x["h"]), x["i"]))
    df = df.withColumn("_at", F.sort_array(F.filter(twice, lambda i: i.isNotNull())))
    covered = F.aggregate(F.transform("_at", lambda i, k: F.least(F.lit(5), F.coalesce(F.get("_at", k + 1) - i, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_sorted", "_at")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def votes() -> list[Column]:
    """One column for each rule: 0 bad, 1 abstains, 2 good."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, 0).when(good, 2).otherwise(1)

    chars = F.col("word_chars") / n
    letters = F.col("n_letters") / F.greatest(F.col("word_chars"), F.lit(1))
    return [
        rule(letters < 0.88, letters > 0.92),
        rule((chars < 2) | (chars > 14), (chars > 2.5) & (chars < 11)),
        rule(F.col("n_symbols") / n > 0.2, F.col("n_symbols") / n < 0.05),
        rule(F.col("n_marks") / n > 0.5, F.col("n_marks") / n < 0.1),
        rule(F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)) > 0.4, F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)) < 0.15),
        rule(F.col("n_dup_lines") * 10 > F.col("n_lines") * 3, F.col("n_dup_lines") * 10 <= F.col("n_lines")),
        rule(F.col("n_repeat_words") > 0.15 * n, F.col("n_repeat_words") <= 0.05 * n),
        rule((F.col("n_words") > 30) & (F.col("n_distinct") < 0.2 * n), (F.col("n_words") <= 30) | (F.col("n_distinct") > 0.3 * n)),
    ]


def pattern() -> Column:
    return sum((v * 3**k for k, v in enumerate(votes())), F.lit(0))


def estimate(counts: list[tuple[int, int]]) -> tuple[float, list[tuple[float, float, float]]]:
    """EM over (pattern, documents): the prior log-odds of good, and for each rule the log-odds that each vote adds.

    The estimates are drawn to the starting values by a fixed number of documents, so that the two classes keep their
    names and a rule that never votes keeps its start.
    """
    votes_of = [[p // 3**k % 3 for k in range(RULES)] for p, _ in counts]
    like = {c: [PRIOR_VOTES[c]] * RULES for c in PRIOR_VOTES}
    good = PRIOR_GOOD
    for _ in range(EM_ROUNDS):
        odds = math.log(good / (1 - good))
        tally = {c: [[PRIOR_ROWS * x for x in PRIOR_VOTES[c]] for _ in range(RULES)] for c in like}
        goods, total = PRIOR_ROWS * PRIOR_GOOD, PRIOR_ROWS
        for vs, (_, n) in zip(votes_of, counts, strict=True):
            z = odds + sum(math.log(like["good"][k][v] / like["bad"][k][v]) for k, v in enumerate(vs))
            g = 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))
            goods, total = goods + n * g, total + n
            for k, v in enumerate(vs):
                tally["good"][k][v] += n * g
                tally["bad"][k][v] += n * (1 - g)
        good = min(max(goods / total, 1e-6), 1 - 1e-6)
        like = {c: [tuple(x / sum(t) for x in t) for t in tally[c]] for c in tally}
    return math.log(good / (1 - good)), [tuple(math.log(like["good"][k][v] / like["bad"][k][v]) for v in range(3)) for k in range(RULES)]


def posterior(found: DataFrame) -> Column:
    """The chance that a row of ``found`` (a written table of :func:`features`) is a good document."""
    counts = [(r["p"], r["n"]) for r in found.groupBy(pattern().alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()]  # at most 3**RULES rows
    prior, weights = estimate(counts)
    z = sum((F.when(v == 0, F.lit(w[0])).when(v == 1, F.lit(w[1])).otherwise(F.lit(w[2])) for v, w in zip(votes(), weights, strict=True)), F.lit(prior))
    return 1 / (1 + F.exp(-z))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, posterior and kept, one row for each row of ``docs``."""
    found = saved(features(docs, "doc_id"), "quality")
    p = posterior(found)
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & (p >= KEEP_FROM)).alias("kept"), p.alias("posterior"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is kept, with their columns.

    Verdicts are found by doc_id and text hash, nulls included, so repeated ids with different texts are told apart.
    """
    of, x = fresh(docs, "of", "x")
    key = docs.select(F.col("doc_id").alias(of), F.coalesce(F.xxhash64("text"), F.lit(0)).alias(x), "text")
    found = saved(features(key, of, x), "quality")
    good = found.filter(~base_failed() & (posterior(found) >= KEEP_FROM)).select(of, x).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(of)) & (F.coalesce(F.xxhash64("text"), F.lit(0)) == F.col(x))
    return docs.join(good, same, "left_semi")
