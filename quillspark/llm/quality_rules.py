"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

A rule rejects a document whose signal is over a cutoff. Cutoffs are chosen per
stratum (band of lengths) from labelled documents, which are split in two by a
hash of their id:

1. The *drafting* part proposes. For each signal it takes the strictest candidate
   that spares nearly all of its good documents and rejects some of its bad ones;
   signals go in the order of how many bad ones they reject.
2. The *holdout* decides. The rules of a stratum form nested sets: the first signal
   alone, the first two, and so on. Of each set, in this fixed order, the exact
   (Clopper-Pearson) upper bound of the share of good documents that it rejects
   is compared with ``RISK``, until one exceeds it; the last set that passed is
   used. A fixed order that the holdout had no part in needs no correction within
   a stratum; Bonferroni's spreads ``DELTA`` over the strata.

So with probability 1 - ``DELTA`` no stratum loses more than ``RISK`` of its good
documents to all its rules together. Where labels are too few to show that (some
200 good documents in the holdout of a stratum), nothing is rejected.

Only counts per stratum and candidate reach the driver: a fixed number of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

# The base rules, the strata and the candidates.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 20, 30, 8
STRATA = {"short": 150, "middle": 600, "long": None}  # words below
SIGNALS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
}
CANDIDATES = (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.5)
RISK, DELTA = 0.02, 0.05
#: Share of the drafting part's good documents that one proposed rule may reject, and thirds of labels in that part.
DRAFT_RISK, DRAFT_THIRDS = 0.002, 1


def features(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and counts over each whole text (null: none of anything)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", SPACES), lambda w: w != ""))
    n = F.size("words")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    rows = rows.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))).cast("long").alias("n_marks"),
        (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))).cast("long").alias("n_capitals"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, WINDOW))).alias("windows"),
    )
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_marks", "n_capitals",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeats, _covered(F.col("windows"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _covered(windows: Column) -> Column:
    """Words in windows whose hash comes twice or more. Equal hashes stand side by
    side once sorted; each start then covers what its predecessor left."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def same(s: Column, j: Column, by: int, h: Column) -> Column:
        return F.coalesce(F.get(s, j + by)["h"] == h, F.lit(False))

    again = lambda s: F.filter(s, lambda x, j: same(s, j, -1, x["h"]) | same(s, j, 1, x["h"]))
    starts = F.transform(F.array(placed), lambda s: F.sort_array(F.transform(again(s), lambda x: x["i"])))[0]
    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"))
    return F.aggregate(starts, zero, step, lambda acc: acc["n"])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def stratum() -> Column:
    out = F
    for name, below in STRATA.items():
        out = out.when(F.col("n_words") < below, F.lit(name)) if below else out.otherwise(F.lit(name))
    return out


def signal(name: str) -> Column:
    part, whole = SIGNALS[name]
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def upper_bound(rejected: int, of: int, delta: float) -> float:
    """Exact binomial: the largest rate under which at most ``rejected`` of ``of``
    would be seen with a probability of ``delta`` or more."""
    if rejected >= of:
        return 1.0
    terms = [math.lgamma(of + 1) - math.lgamma(k + 1) - math.lgamma(of - k + 1) for k in range(rejected + 1)]

    def log_tail(p: float) -> float:
        logs = [c + k * math.log(p) + (of - k) * math.log1p(-p) for k, c in enumerate(terms)]
        top = max(logs)
        return top + math.log(sum(math.exp(x - top) for x in logs))

    low, high = 1e-15, 1 - 1e-15
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if log_tail(mid) > math.log(delta) else (low, mid)
    return high


Counts = dict[str, tuple[int, int, dict[tuple[str, float], tuple[int, int]]]]


def proposed(counts: Counts, draft_risk: float = DRAFT_RISK) -> dict[str, list[tuple[str, float]]]:
    """Rules of each stratum in the order of their tests. counts, of the drafting
    part by stratum: good and bad documents, and how many of either each (signal,
    candidate) would reject."""
    out = {}
    for name, (good, _, rejected) in counts.items():
        rules = []
        for sig in SIGNALS:
            fine = [c for c in CANDIDATES if rejected[sig, c][0] <= draft_risk * good and rejected[sig, c][1] > 0]
            if fine:
                rules.append((rejected[sig, min(fine)][1], sig, min(fine)))
        out[name] = [(sig, c) for _, sig, c in sorted(rules, key=lambda r: (-r[0], r[1]))]
    return out


def proven(rules: dict[str, list[tuple[str, float]]], counts: dict[str, tuple[int, list[int]]], risk: float = RISK, delta: float = DELTA):
    """(stratum, signal) to the cutoff in use. counts, of the holdout by stratum: good
    documents, and how many of them each rule rejects first, in the rules' order."""
    chosen = {}
    for name, ordered in rules.items():
        good, first = counts.get(name, (0, []))
        lost = 0
        for (sig, c), n in zip(ordered, first):
            lost += n
            if not good or upper_bound(lost, good, delta / len(STRATA)) > risk:
                break
            chosen[name, sig] = c
    return chosen


def calibrate(measured: DataFrame, labels: DataFrame, label: str = "quality") -> dict[tuple[str, str], float]:
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("good"))
    known = known.where(F.col("good").isin(0, 1))  # an id with both labels counts as good
    drafting = F.crc32(F.concat(F.lit("rules "), F.col("doc_id").cast("string"))) % 3 < DRAFT_THIRDS
    labelled = measured.join(known, "doc_id").where(~base_failed())
    labelled = materialise(labelled.withColumn("stratum", stratum()).withColumn("drafting", drafting), "labelled")
    names = [(sig, c) for sig in SIGNALS for c in CANDIDATES]
    good = F.col("good") == 1
    over = [F.count_if((signal(sig) > c) & which).alias(f"c{i}_{k}") for i, (sig, c) in enumerate(names) for k, which in enumerate((good, ~good))]
    counts: Counts = {}
    for r in labelled.where("drafting").groupBy("stratum").agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"), *over).collect():
        counts[r["stratum"]] = (r["good"], r["bad"], {name: (r[f"c{i}_0"], r[f"c{i}_1"]) for i, name in enumerate(names)})
    rules = proposed(counts)
    first = F.lit(None).cast("int")  # the number of the first rule that rejects the document
    for name, ordered in rules.items():
        for k, (sig, c) in reversed(list(enumerate(ordered))):
            first = F.when((F.col("stratum") == name) & (signal(sig) > c), F.lit(k)).otherwise(first)
    held = labelled.where(~F.col("drafting") & good).withColumn("first", first)
    sums = [F.count_if(F.col("first") == k).alias(f"r{k}") for k in range(len(SIGNALS))]
    held = {r["stratum"]: (r["good"], [r[f"r{k}"] for k in range(len(SIGNALS))]) for r in held.groupBy("stratum").agg(F.count(F.lit(1)).alias("good"), *sums).collect()}
    discard(labelled)
    return proven(rules, held)


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The counts of ``features`` for every document, base_failed, kept, and
    rejected_by (the first rule that rejects it, or null).

    A null or empty text fails the base rules. Null ids and repeated rows are judged
    like others (labels with a null id match nothing); other columns are ignored.
    Without enough labels only the base rules reject; an empty table gives no rows.
    """
    measured = materialise(features(docs, text, doc_id), "features")
    chosen = calibrate(measured, labels)
    reason = F.when(base_failed(), F.lit("base"))
    for (name, sig), c in sorted(chosen.items()):
        reason = reason.when((stratum() == name) & (signal(sig) > c), F.lit(sig))
    out = measured.withColumn("base_failed", base_failed()).withColumn("rejected_by", reason)
    return out.withColumn("kept", F.col("rejected_by").isNull())
