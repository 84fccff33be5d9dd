"""Rubric scores, judge ensembles and plausibility checks as column expressions.

Metrics are mixed: a number, the text "N/A" (not applicable) or null (missing).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .relational import number

# Largest marks, caps and thresholds of the rubric.
FULL_MARK, EXTRA_MARK = 3.0, 2.0
CAP_TAXONOMY, CAP_IRRELEVANT, IRRELEVANT = 0.1, 0.2, 1.0
DISAGREE = 2.0
TOLERANCE_M = 200
# Which family a model belongs to, by the first part its name contains.
FAMILIES = (("openai", "openai"), ("gpt", "openai"), ("anthropic", "anthropic"), ("claude", "anthropic"), ("google", "google"), ("gemini", "google"), ("llama", "meta"), ("meta-llama", "meta"), ("deepseek", "deepseek"))


def applicable(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) != "N/A", F.lit(True))


def composite(m1: Column, m2: Column, m3: Column, m4: Column, m5: Column, tier: Column, profile: Column, taxonomy_valid: Column | None = None, rich_tier: str = "T3", expert: str = "botanico", digits: int | None = None) -> Column:
    """Share of the attainable marks. The rich tier adds m2, and for experts m4, unless not applicable (a missing one counts as 0 marks).

    ``digits``: rounded before the caps. An invalid taxonomy and an irrelevant answer (m3 of 1 or less, or no number) cap the score.
    """
    zero = lambda m: F.coalesce(number(m), F.lit(0.0))
    with2 = (tier == rich_tier) & applicable(m2)
    with4 = (tier == rich_tier) & (profile == expert) & applicable(m4)
    got = zero(m1) + zero(m3) + zero(m5) + F.when(with2, zero(m2)).otherwise(0.0) + F.when(with4, zero(m4)).otherwise(0.0)
    most = F.lit(3 * FULL_MARK) + F.when(with2, EXTRA_MARK).otherwise(0.0) + F.when(with4, EXTRA_MARK).otherwise(0.0)
    score = got / most if digits is None else F.round(got / most, digits)
    valid = F.lit(True) if taxonomy_valid is None else F.coalesce(taxonomy_valid.cast("boolean"), F.lit(True))
    score = F.when(~valid, F.least(score, F.lit(CAP_TAXONOMY))).otherwise(score)
    return F.when(zero(m3) <= IRRELEVANT, F.least(score, F.lit(CAP_IRRELEVANT))).otherwise(score)


def judge_mean(a: Column, b: Column) -> Column:
    """Mean of two judges' marks as text, to two digits: "N/A" if either says so; the first judge's mark, null or not, unless both are numbers."""
    both = F.round((number(a) + number(b)) / 2, 2)
    return F.when(~applicable(a) | ~applicable(b), "N/A").otherwise(F.coalesce(both.cast("string"), number(a).cast("string"), a.cast("string")))


METRICS = ("m1_precision_geografica", "m2_precision_altitudinal", "m3_relevancia_respuesta", "m4_variable_climatica", "m5_profundidad_analitica")


def ensemble(a: Column, b: Column, label_a: Column, label_b: Column, tier: Column, profile: Column, taxonomy_valid: Column | None = None, third: Column | None = None, metrics: Sequence[str] = METRICS) -> Column:
    """One result of two judges' mark structs (null: the judge failed); null if both failed.

    A judge that failed takes the other one's marks and label. The marks are averaged, the third judge is asked where the
    two are DISAGREE or more apart in any metric (its marks, ``third``, are kept but not averaged in), and such answers need a human's review.
    """
    lost_a, lost_b = a.isNull(), b.isNull()
    x, y = F.coalesce(a, b), F.coalesce(b, a)
    pairs = F.array(*(F.struct(x[m].cast("string").alias("a"), y[m].cast("string").alias("b")) for m in metrics))
    told = F.transform(pairs, lambda p: F.struct(judge_mean(p["a"], p["b"]).alias("mean"), largest_difference([(p["a"], p["b"])]).alias("gap")))
    third = F.lit(None).cast("string") if third is None else third
    labels = F.struct(F.when(lost_a, label_b).otherwise(label_a).alias("a"), F.when(lost_b, label_a).otherwise(label_b).alias("b"))
    valid = F.lit(True) if taxonomy_valid is None else taxonomy_valid.cast("boolean")

    def result(s: Column) -> Column:
        mean = [s["told"][i]["mean"] for i in range(len(metrics))]
        gap = F.array_max(F.transform(s["told"], lambda t: t["gap"]))
        disagree = gap >= DISAGREE
        score = F.round(composite(*mean, s["tier"], s["profile"], s["valid"], digits=4), 4)
        return F.struct(
            s["labels"]["a"].alias("judge_a_label"), s["labels"]["b"].alias("judge_b_label"), F.when(disagree, s["third"]).alias("judge_c_scores"),
            *(v.alias(m) for m, v in zip(metrics, mean)), score.alias("score_compuesto"), gap.alias("max_metric_diff"), disagree.alias("disagree_flag"), (disagree & s["third"].isNotNull()).alias("used_tiebreaker"), disagree.alias("needs_human_review"),
        )

    # One element of an array, so that the marks are read once and the expression stays small enough to be compiled.
    all_ = F.struct(told.alias("told"), labels.alias("labels"), tier.alias("tier"), profile.alias("profile"), valid.alias("valid"), third.alias("third"))
    return F.when(~(lost_a & lost_b), F.get(F.transform(F.array(all_), result), F.lit(0)))


def taxonomy_valid(status: Column, confidence: Column, least: int = 80) -> Column:
    """Whether a name stands in the backbone: accepted or a synonym, with enough confidence if any is told. A look-up that failed (null status) does not count against the answer."""
    return F.when(status.isNull(), True).otherwise(status.isin("ACCEPTED", "SYNONYM") & F.coalesce(confidence >= least, F.lit(True)))


def largest_difference(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """Largest distance between the judges over the metrics both marked; 0 if there is none."""
    gaps = [F.abs(number(a) - number(b)) for a, b in pairs]
    return F.coalesce(F.greatest(*gaps) if len(gaps) > 1 else gaps[0], F.lit(0.0))


def family(model: Column, families: Sequence[tuple[str, str]] = FAMILIES) -> Column:
    """Family of the first part the model's name contains, in order; unknown otherwise."""
    m = F.lower(model)
    out = F.lit("unknown")
    for part, name in reversed(list(families)):
        out = F.when(m.contains(part), name).otherwise(out)
    return out


def independent_judge(generator: Column, judge: Column, third: Column, families: Sequence[tuple[str, str]] = FAMILIES) -> Column:
    """The judge, or the third one where the judge is of the generator's family and a third exists."""
    own = (family(generator, families) == family(judge, families)) & (family(judge, families) != "unknown")
    return F.when(own & third.isNotNull(), third).otherwise(judge)


def elevation_plausibility(mentions: Column, low: Column | Sequence[Column], high: Column | Sequence[Column], tolerance: int = TOLERANCE_M) -> Column:
    """2 if all mentioned heights lie in the widest band of the sources, widened by the tolerance, 1 if some do, 0 if none do or none is mentioned; null (not applicable) without a low or a high end."""
    lows, highs = ([side] if isinstance(side, Column) else list(side) for side in (low, high))
    widest = lambda f, xs: f(*xs) if len(xs) > 1 else xs[0]
    lo, hi = widest(F.least, lows) - tolerance, widest(F.greatest, highs) + tolerance
    heights = F.coalesce(mentions, F.array().cast("array<bigint>"))
    ok = lambda x: x.between(lo, hi)
    known = lo.isNotNull() & hi.isNotNull()
    return F.when(known & (F.size(heights) == 0), 0).when(known & F.forall(heights, ok), 2).when(known & F.exists(heights, ok), 1).when(known, 0)


def row_mean(*metrics: Column) -> Column:
    """Mean of marks of which none is missing, to two digits."""
    return F.round(sum(metrics[1:], metrics[0]) / len(metrics), 2)


def descending(*levels: Column) -> Column:
    """Whether each level's score is at least the next one's."""
    out = F.lit(True)
    for a, b in zip(levels, levels[1:]):
        out = out & (a >= b)
    return out
