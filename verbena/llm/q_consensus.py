"""Problem 4: one M1 per evaluated answer out of its evaluators' and judges' marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical_key, micros_of_text
from ..runtime import materialise, table
from .consensus import Consensus, alpha

_KEYS = ("exp_id", "especie", "tier", "modelo_generador")


def _keyed(df: DataFrame) -> DataFrame:
    return df.select("*", *(canonical_key(k).alias(f"k{i}") for i, k in enumerate(_KEYS))).filter(" and ".join(f"k{i} is not null" for i in range(4)))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (item, annotator, label): one label per annotator and item, the last submitted one."""
    k = [f"k{i}" for i in range(4)]
    human = _keyed(table(spark, sf_dir, "human_evaluations").select("human_id", *_KEYS, "evaluator", "m1", "submitted_at")).withColumn("annotator", canonical_key("evaluator"))
    human = human.filter("m1 between 0 and 3 and annotator <> ''")
    when = F.struct(F.coalesce(micros_of_text("submitted_at"), F.lit(-(1 << 62))), "human_id")
    human = human.groupBy(*k, "annotator").agg(F.max_by("m1", when).alias("label"))
    judge = _keyed(table(spark, sf_dir, "judge_evals").select("judge_id", *_KEYS, "judge_a_label", "judge_b_label", "judge_a_scores", "judge_b_scores"))
    sides = F.array(*(F.struct(F.concat(F.lit("judge "), canonical_key(f"judge_{s}_label")).alias("annotator"), F.col(f"judge_{s}_scores.m1_precision_geografica").alias("label"), F.lit(s).alias("side")) for s in "ab"))
    judge = judge.select("judge_id", *k, F.explode(sides).alias("e")).select("judge_id", *k, "e.annotator", "e.label", "e.side").filter("annotator is not null and label between 0 and 3")
    judge = judge.groupBy(*k, "annotator").agg(F.min_by("label", F.struct("judge_id", "side")).alias("label"))
    items = _keyed(table(spark, sf_dir, "llm_evaluations").select("eval_id", *_KEYS)).select(F.col("eval_id").alias("item"), *k).distinct()
    return human.unionByName(judge).join(items, k).select("item", "annotator", F.col("label").cast("int").alias("label"))


def _consensus(spark: SparkSession, sf_dir: str) -> Consensus:
    return Consensus(materialise(labels(spark, sf_dir), "labels"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).consensus().filter("n_labels >= 3 and n_distinct > 1").select(F.col("item").alias("eval_id"), F.col("label").alias("m1_consensus"))


def p4_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with a label: consensus, confidence and agreement."""
    return _consensus(spark, sf_dir).consensus().withColumnsRenamed({"item": "eval_id", "label": "m1_consensus"})


def p4_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).annotators()


def p4_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alpha(materialise(labels(spark, sf_dir), "labels"))


_K = lambda t: ", ".join(f"trim(regexp_replace(lower({t}.{c}), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_') k{i}" for i, c in enumerate(_KEYS))
_AGREEMENT = f"""
with h as (select {_K("h")}, trim(regexp_replace(lower(evaluator), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_') a, arg_max(m1, (coalesce(try_cast(submitted_at as timestamp), timestamp '1900-01-01'), human_id)) v
  from human_evaluations h where m1 between 0 and 3 and evaluator is not null group by all),
j as (select {_K("j")}, 'judge ' || lower(judge_a_label) a, judge_a_scores.m1_precision_geografica v from judge_evals j
  union select {_K("j")}, 'judge ' || lower(judge_b_label) a, judge_b_scores.m1_precision_geografica v from judge_evals j),
l as (select distinct eval_id item, {_K("l")} from llm_evaluations l),
e as (select item, v from (select * from h where a <> '' union all select * from j where v between 0 and 3) join l using (k0, k1, k2, k3)),
i as (select item, count(*) n, sum(v) s, sum(v * v) q from e group by item having count(*) >= 2),
c as (select item, sum(m * m) cc from (select item, v, count(*) m from e group by all) group by item),
w as (select count(*) n_items, sum(n) n, sum(s) s, sum(q) q, sum((n * n - cc) / (n - 1)) d1, sum((2 * n * q - 2 * s * s) / (n - 1)) d2 from i join c using (item)),
t as (select sum(m * m) mm from (select v, count(*) m from e where item in (select item from i) group by v))
select n_items, cast(n as bigint) n_labels, cast(1 - (n - 1) * d1 / (n * n - mm) as double) alpha_nominal, cast(1 - (n - 1) * d2 / (2 * n * q - 2 * s * s) as double) alpha_interval from w, t
"""

QUERIES = {"p4_found": p4_found, "p4_items": p4_items, "p4_annotators": p4_annotators, "p4_agreement": p4_agreement}
ORACLE = {"p4_agreement": _AGREEMENT}
