"""Queries over the evaluation warehouse: summaries, pairings, progress, scores and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical_key
from ..operators import aggregates as A
from ..operators import relational as R
from ..operators import scoring as S
from ..operators import stats as Q
from ..operators import windows as W
from ..runtime import table

METRICS = ["m1", "m2", "m3", "m4", "m5"]
KEYS = ["exp_id", "especie", "tier", "modelo_generador"]
TIERS = ["T0", "T1", "T3"]
SCORE = "score_compuesto"
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Fractions rounded, so that the order of additions does not show."""
    return df.select(*((F.round(F.col(f"`{c}`").cast("double"), digits) + 0.0).alias(c) if t in ("double", "float") or t.startswith("decimal") else F.col(f"`{c}`") for c, t in df.dtypes))


def llm(spark: SparkSession, sf_dir: str, *need: str) -> DataFrame:
    """Each evaluation once: repeated rows share their id, so the id and the needed columns tell them apart and only these are read."""
    return table(spark, sf_dir, "llm_evaluations").select(*dict.fromkeys(["eval_id", *need])).distinct()


def human(spark: SparkSession, sf_dir: str, *need: str) -> DataFrame:
    return table(spark, sf_dir, "human_evaluations").select(*dict.fromkeys(["human_id", *need])).distinct()


def model(c: str = "modelo_generador"):
    return canonical_key(c)


_MODEL = "trim(regexp_replace(lower(modelo_generador), '[^\\p{L}\\p{N}]+', '_', 'g'), '_')"
_LLM = "(select distinct * from llm_evaluations)"
_HUMAN = "(select distinct * from human_evaluations)"


@query(f"select tier, {_MODEL} model, {', '.join(f'round(avg(cast({m} as double)), 6) avg_{m}' for m in METRICS)}, round(avg(score_compuesto::double), 6) avg_score_compuesto, count(*) n from {_LLM} group by all")
def score_summary(spark, sf_dir):
    return rounded(A.summary(llm(spark, sf_dir, "tier", "modelo_generador", *METRICS, SCORE).withColumn("model", model()), ["tier", "model"], [*METRICS, "score_compuesto"]))


@query(f"select tier, {_MODEL} model, {', '.join(f'round(avg(cast({m} as double)), 6) avg_{m}' for m in METRICS)}, count(*) n from {_HUMAN} group by all")
def human_score_summary(spark, sf_dir):
    return rounded(A.summary(human(spark, sf_dir, "tier", "modelo_generador", *METRICS).withColumn("model", model()), ["tier", "model"], METRICS))


@query(f"select e.exp_id, e.started_at, l.tier, round(avg(l.score_compuesto::double), 6) avg_score_compuesto, count(*) n from {_LLM} l join (select distinct exp_id, started_at from experiments) e using (exp_id) group by all")
def score_trend(spark, sf_dir):
    runs = table(spark, sf_dir, "experiments").select("exp_id", "started_at").distinct()
    return rounded(A.summary(llm(spark, sf_dir, "exp_id", "tier", SCORE).join(runs, "exp_id"), ["exp_id", "started_at", "tier"], ["score_compuesto"]))


@query(f"select tier, {_MODEL} model, round(avg(score_compuesto::double), 6) mean, round(stddev_samp(score_compuesto::double), 6) std, count(score_compuesto) n from {_LLM} group by all")
def group_mean_std_count(spark, sf_dir):
    return rounded(A.describe(llm(spark, sf_dir, "tier", "modelo_generador", SCORE).withColumn("model", model()), ["tier", "model"], "score_compuesto"))


@query(f"select stratum, round(avg(case when tier = 'T0' then score_compuesto::double end), 6) \"mean_T0\", round(avg(case when tier = 'T1' then score_compuesto::double end), 6) \"mean_T1\", round(avg(case when tier = 'T3' then score_compuesto::double end), 6) \"mean_T3\" from {_LLM} group by all")
def tier_conditional_means(spark, sf_dir):
    return rounded(A.conditional_means(llm(spark, sf_dir, "stratum", "tier", SCORE), "stratum", "tier", TIERS, "score_compuesto"))


@query(f"select tier, metric, round(avg(value), 6) mean, round(stddev_samp(value), 6) std, count(value) n from (unpivot (select tier, {', '.join(f'coalesce({m}::double, -1) {m}' for m in METRICS)} from {_LLM}) on {', '.join(METRICS)} into name metric value value) where value >= 0 group by all")
def metric_summary_unpivot(spark, sf_dir):
    long = R.long_form(llm(spark, sf_dir, "tier", *METRICS), ["tier"], METRICS).filter("value is not null")
    return rounded(A.describe(long, ["tier", "metric"], "value"))


@query(f"select especie, round(avg(case when tier = 'T0' then score_compuesto::double end), 6) \"T0\", round(avg(case when tier = 'T1' then score_compuesto::double end), 6) \"T1\", round(avg(case when tier = 'T3' then score_compuesto::double end), 6) \"T3\" from {_LLM} group by all")
def pivot_mean(spark, sf_dir):
    return rounded(A.pivot_mean(llm(spark, sf_dir, "especie", "tier", SCORE), "especie", "tier", TIERS, "score_compuesto"))


@query(f"select stratum, tier, grouping(stratum)::int all_levels, round(avg(score_compuesto::double), 6) mean, count(*) n from {_LLM} group by grouping sets ((stratum, tier), (tier))")
def all_levels_grouping_sets(spark, sf_dir):
    return rounded(A.levels(llm(spark, sf_dir, "stratum", "tier", SCORE), "stratum", "tier", "score_compuesto"))


@query("select source, count(*) n from documents group by all order by n desc, source nulls last limit 5")
def value_counts_topk(spark, sf_dir):
    return A.value_counts(table(spark, sf_dir, "documents"), "source", 5)


@query("select family, arg_min(volume, pick_id) volume, arg_min(occurrences, pick_id) occurrences, count(*) n from (select family, coalesce(volume, '-') volume, coalesce(occurrences, -1) occurrences, pick_id from picked_species where family is not null) group by all")
def first_seen_per_group(spark, sf_dir):
    t = table(spark, sf_dir, "picked_species").filter("family is not null").select("family", F.coalesce("volume", F.lit("-")).alias("volume"), F.coalesce("occurrences", F.lit(-1)).alias("occurrences"), "pick_id")
    return A.first_seen(t, "family", "pick_id", ["volume", "occurrences"])


@query(f"select exp_id, count(distinct especie) n_species, count(distinct {_MODEL}) n_models from {_LLM} group by all")
def distinct_counts(spark, sf_dir):
    return llm(spark, sf_dir, "exp_id", "especie", "modelo_generador").groupBy("exp_id").agg(F.countDistinct("especie").alias("n_species"), F.countDistinct(model()).alias("n_models"))


@query("select min(elevation_min_m) lowest, max(elevation_max_m) highest, round(avg(elevation_max_m), 6) mean_max from picked_species_enhanced")
def min_max_mean(spark, sf_dir):
    return rounded(table(spark, sf_dir, "picked_species_enhanced").agg(F.min("elevation_min_m").alias("lowest"), F.max("elevation_max_m").alias("highest"), F.avg("elevation_max_m").alias("mean_max")))


@query("select extraction_method, median(elevation_max_m) median_max from picked_species_enhanced group by all")
def group_median(spark, sf_dir):
    t = table(spark, sf_dir, "picked_species_enhanced").select("extraction_method", "elevation_max_m")
    return W.medians(t, ["extraction_method"], "elevation_max_m", "median_max")


@query("select extraction_method, count(*) filter (where habitat_raw is null or trim(habitat_raw) = '') n_empty, count(*) filter (where elevation_min_m is not null) n_height, count(*) n from picked_species_enhanced group by all")
def conditional_counts(spark, sf_dir):
    empty = F.col("habitat_raw").isNull() | (F.trim("habitat_raw") == "")
    return table(spark, sf_dir, "picked_species_enhanced").groupBy("extraction_method").agg(F.count_if(empty).alias("n_empty"), F.count_if(F.col("elevation_min_m").isNotNull()).alias("n_height"), F.count("*").alias("n"))


@query("select l_shipmode, r, case when r > 0 then 'POSITIVE' else 'NEGATIVE' end direction from (select l_returnflag l_shipmode, round(corr(l_extendedprice, l_discount), 6) r from lineitem group by all)")
def corr_direction(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "l_shipmode")
    return rounded(A.correlation_direction(t, ["l_shipmode"], "l_extendedprice", "l_discount"))


@query(f"select evaluator, especie, list_aggregate(list_sort(list(distinct tier)), 'string_agg', ',') tiers from {_HUMAN} where evaluator is not null and especie is not null and tier is not null group by all")
def nested_progress(spark, sf_dir):
    per = A.collected_pairs(human(spark, sf_dir, "evaluator", "especie", "tier").filter("tier is not null"), "evaluator", "especie", "tier")
    return per.select("evaluator", "especie", F.concat_ws(",", "leaves").alias("tiers"))


@query(f"select especie, tier winner, best from (select especie, tier, best, row_number() over (partition by especie order by best desc, tier) r from (select especie, tier, round(avg(score_compuesto::double), 6) best from {_LLM} group by all) where best is not null) where r = 1")
def argmax_winner(spark, sf_dir):
    means = rounded(llm(spark, sf_dir, "especie", "tier", SCORE).groupBy("especie", "tier").agg(F.avg(F.col("score_compuesto").cast("double")).alias("best")))
    return A.arg_max(means, "especie", "tier", "best").filter("especie is not null").unionByName(A.arg_max(means.filter("especie is null"), "especie", "tier", "best"))


@query(f"select human_id, round((m1 + m3 + m5) / 3.0::double, 2) row_mean from {_HUMAN} where m1 + m3 + m5 is not null")
def rubric_row_mean(spark, sf_dir):
    return human(spark, sf_dir, "m1", "m3", "m5").select("human_id", S.row_mean(F.col("m1"), F.col("m3"), F.col("m5")).alias("row_mean")).filter("row_mean is not null")


_CANON = lambda t: ", ".join(f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_') k_{c}" for c in KEYS)
_PAIRED = f"""h as (select human_id, {_CANON('h')}, m1, m3 from {_HUMAN} h), l as (select eval_id, {_CANON('l')}, m1, m3 from {_LLM} l),
p as (select human_id, eval_id, h.m1 h_m1, l.m1 l_m1, h.m3 h_m3, l.m3 l_m3 from h join l using (k_exp_id, k_especie, k_tier, k_modelo_generador))"""


def _paired(spark, sf_dir, how="inner"):
    keyed = lambda df, i: df.select(i, *(canonical_key(k).alias(f"k_{k}") for k in KEYS), "m1", "m3")
    keys = [f"k_{k}" for k in KEYS]
    return R.paired(keyed(human(spark, sf_dir, *KEYS, "m1", "m3"), "human_id"), keyed(llm(spark, sf_dir, *KEYS, "m1", "m3"), "eval_id"), keys, how, "h_", "l_").withColumnsRenamed({"h_human_id": "human_id", "l_eval_id": "eval_id"})


@query(f"with {_PAIRED} select * from p where abs(h_m1 - l_m1) >= 2 or abs(h_m3 - l_m3) >= 2")
def disagreements(spark, sf_dir):
    return _paired(spark, sf_dir).filter(R.differs([("h_m1", "l_m1"), ("h_m3", "l_m3")], 2)).select("human_id", "eval_id", "h_m1", "l_m1", "h_m3", "l_m3")


@query(f"with {_PAIRED}, q as (select human_id, h.m1 h_m1, l.eval_id, l.m1 l_m1 from h left join l using (k_exp_id, k_especie, k_tier, k_modelo_generador)) select * from q")
def left_export(spark, sf_dir):
    return _paired(spark, sf_dir, "left").select("human_id", "h_m1", "eval_id", "l_m1")


@query("select distinct trim(regexp_replace(lower(species), '[^\\p{L}\\p{N}]+', '_', 'g'), '_') name_key from picked_species where species is not null intersect select distinct trim(regexp_replace(lower(especie), '[^\\p{L}\\p{N}]+', '_', 'g'), '_') from results where trim(regexp_replace(lower(especie), '[^\\p{L}\\p{N}]+', '_', 'g'), '_') <> ''")
def norm_name_merge(spark, sf_dir):
    return R.same_name(table(spark, sf_dir, "picked_species"), table(spark, sf_dir, "results"), "species", "especie")


@query("select ref_id, species from species_reference where species in (select species from picked_species)")
def semi_join(spark, sf_dir):
    return table(spark, sf_dir, "species_reference").select("ref_id", "species").join(table(spark, sf_dir, "picked_species").select("species").distinct(), "species", "left_semi").select("ref_id", "species")


@query("select ref_id, species from species_reference where species not in (select species from picked_species where species is not null)")
def anti_join(spark, sf_dir):
    return table(spark, sf_dir, "species_reference").select("ref_id", "species").join(table(spark, sf_dir, "picked_species").select("species").distinct(), "species", "left_anti").select("ref_id", "species")


@query(f"select evaluator, min(especie) first_open from (select evaluator, especie, list(distinct tier) t from {_HUMAN} where evaluator is not null and especie is not null group by all) where not list_has_all(t, ['T0', 'T1', 'T3']) group by all")
def first_incomplete(spark, sf_dir):
    done = human(spark, sf_dir, "evaluator", "especie", "tier").filter("evaluator is not null and especie is not null").groupBy("evaluator", "especie").agg(F.collect_set("tier").alias("t"))
    open_ = done.filter(F.size(F.array_except(F.array(*map(F.lit, TIERS)), "t")) > 0)
    return open_.groupBy("evaluator").agg(F.min("especie").alias("first_open"))


@query("select s.species especie, t.tier from species_reference s cross join (select tier from tier_defs) t where not exists (select 1 from llm_evaluations l where l.especie = s.species and l.tier = t.tier)")
def cross_plan_anti_done(spark, sf_dir):
    species = table(spark, sf_dir, "species_reference").select(F.col("species").alias("especie"))
    return R.work_plan([species, table(spark, sf_dir, "tier_defs").select("tier")], llm(spark, sf_dir, "especie", "tier"), ["especie", "tier"])


@query(f"with m as (select especie, tier, round(avg(score_compuesto::double), 6) v from {_LLM} where tier in ('T0', 'T1', 'T3') and especie is not null group by all having avg(score_compuesto) is not null) select x.especie, x.tier a, y.tier b, x.v value_a, y.v value_b from m x join m y on x.especie = y.especie and x.tier < y.tier")
def pairwise_tiers(spark, sf_dir):
    m = rounded(llm(spark, sf_dir, "especie", "tier", SCORE).filter(F.col("tier").isin(*TIERS) & F.col("especie").isNotNull()).groupBy("especie", "tier").agg(F.avg(F.col("score_compuesto").cast("double")).alias("v")).filter("v is not null"))
    return R.unordered_pairs(m, ["especie"], "tier", "v")


@query("select row_id, case when trim(m2_precision_altitudinal) = 'N/A' then 'not_applicable' when try_cast(m2_precision_altitudinal as double) is null then 'missing' else 'number' end state, try_cast(m2_precision_altitudinal as double) m2, case lower(taxonomy_valid) when 'true' then 1.0::double when 'false' then 0.0::double else try_cast(taxonomy_valid as double) end valid from (select distinct * from results)")
def coerce_mixed(spark, sf_dir):
    t = table(spark, sf_dir, "results").distinct()
    return t.select("row_id", R.state("m2_precision_altitudinal").alias("state"), R.number("m2_precision_altitudinal").alias("m2"), R.number("taxonomy_valid").alias("valid"))


@query("select lower(modelo_generador) like '%orb%' is_orb, case when lower(modelo_generador) like '%orb%' then 'orbis' when lower(modelo_generador) like '%canto%' then 'lumen' when lower(modelo_generador) like '%vela%' then 'velar' else 'unknown' end family, count(*) n from llm_evaluations group by all")
def model_family(spark, sf_dir):
    fam = S.family(F.col("modelo_generador"), (("orb", "orbis"), ("canto", "lumen"), ("vela", "velar")))
    return table(spark, sf_dir, "llm_evaluations").groupBy(F.lower("modelo_generador").contains("orb").alias("is_orb"), fam.alias("family")).agg(F.count("*").alias("n"))


_J = "(select distinct * from judge_evals)"
_MARKS = {"m1": "m1_precision_geografica", "m2": "m2_precision_altitudinal", "m3": "m3_relevancia_respuesta", "m4": "m4_variable_climatica", "m5": "m5_profundidad_analitica"}
_NUM = lambda side, m: f"try_cast(judge_{side}_scores.{_MARKS[m]}::varchar as double)"
_TEXT = lambda side, m: f"judge_{side}_scores.{_MARKS[m]}::varchar"
_BOTH = lambda m: f"case when {_TEXT('a', m)} = 'N/A' or {_TEXT('b', m)} = 'N/A' then 'N/A' else coalesce(coalesce(round(({_NUM('a', m)} + {_NUM('b', m)}) / 2, 2), {_NUM('a', m)})::varchar, {_TEXT('a', m)}) end"
_GAP = "coalesce(greatest(" + ", ".join(f"abs({_NUM('a', m)} - {_NUM('b', m)})" for m in _MARKS) + "), 0)"


@query(f"select judge_id, {', '.join(f'{_BOTH(m)} {m}' for m in _MARKS)}, {_GAP}::double diff, {_GAP} >= 2 disagree from {_J}")
def judge_average_disagree(spark, sf_dir):
    t = table(spark, sf_dir, "judge_evals").distinct()
    a, b = (lambda f: F.col(f"judge_a_scores.{f}")), (lambda f: F.col(f"judge_b_scores.{f}"))
    diff = S.largest_difference([(a(n), b(n)) for n in _MARKS.values()])
    return t.select("judge_id", *(S.judge_mean(a(n), b(n)).alias(m) for m, n in _MARKS.items()), diff.alias("diff"), (diff >= S.DISAGREE).alias("disagree"))


def _numbers(a: str) -> str:
    return f"coalesce(try_cast({a} as double), 0)"


_A = "judge_a_scores."
_M2, _M4 = _A + "m2_precision_altitudinal", _A + "m4_variable_climatica"
_WITH2, _WITH4 = f"(tier = 'T3' and coalesce({_M2}, '') <> 'N/A')", f"(tier = 'T3' and perfil = 'botanico' and coalesce({_M4}, '') <> 'N/A')"
_RAW = f"({_numbers(_A + 'm1_precision_geografica')} + {_numbers(_A + 'm3_relevancia_respuesta')} + {_numbers(_A + 'm5_profundidad_analitica')} + case when {_WITH2} then {_numbers(_M2)} else 0 end + case when {_WITH4} then {_numbers(_M4)} else 0 end) / (9.0 + case when {_WITH2} then 2 else 0 end + case when {_WITH4} then 2 else 0 end)"
_CAPPED = f"case when taxonomy_valid = false then least({_RAW}, 0.1) else {_RAW} end"


@query(f"select judge_id, round(case when {_numbers(_A + 'm3_relevancia_respuesta')} <= 1 then least({_CAPPED}, 0.2) else {_CAPPED} end, 6) score from (select distinct * from judge_evals)")
def composite_score(spark, sf_dir):
    t = table(spark, sf_dir, "judge_evals").distinct()
    m = lambda n: F.col(f"judge_a_scores.{n}")
    score = S.composite(m("m1_precision_geografica"), m("m2_precision_altitudinal"), m("m3_relevancia_respuesta"), m("m4_variable_climatica"), m("m5_profundidad_analitica"), F.col("tier"), F.col("perfil"), F.col("taxonomy_valid"))
    return rounded(t.select("judge_id", score.alias("score")))


_KAPPA = """with x as (select judge_a_scores.m1_precision_geografica a, judge_b_scores.m1_precision_geografica b from (select distinct * from judge_evals) where judge_a_label <> judge_b_label),
p as (select a, b, count(*) c from x where a is not null and b is not null group by all), l as (select v, row_number() over (order by v) i from (select a v from p union select b from p)),
q as (select la.i i, lb.i j, c from p join l la on la.v = a join l lb on lb.v = b), n as (select sum(c) n from q),
s as (select sum(abs(i - j) * c) s from q), e as (select sum(abs(x.i - y.j) * x.c * y.c) e from q x, q y)
select n::bigint n, round(1 - s / (e / n), 6) kappa from n, s, e"""


@query(_KAPPA)
def kappa_linear(spark, sf_dir):
    t = table(spark, sf_dir, "judge_evals").distinct().filter("judge_a_label <> judge_b_label").select(F.col("judge_a_scores.m1_precision_geografica").alias("a"), F.col("judge_b_scores.m1_precision_geografica").alias("b"))
    return rounded(Q.weighted_kappa(t, "a", "b"))


_BLOCKS = f"""m as (select especie block, tier label, avg(score_compuesto::double) v from {_LLM} where tier in ('T0', 'T1', 'T3') group by all having avg(score_compuesto) is not null),
b as (select * from m where block in (select block from m group by block having count(*) = 3)),
r as (select *, rank() over (partition by block order by v) + (count(*) over (partition by block, v) - 1) / 2.0 rk from b)"""


@query(f"with {_BLOCKS}, t as (select sum(t * t * t - t) ties from (select count(*) t from b group by block, v)), s as (select sum(x * x) rr, max(n) n from (select sum(rk) x, count(*) n from r group by label)), c as (select (12 * rr / (n * 12) - 3 * n * 4) / (1 - ties / (n * 24.0)) chi2, n from s, t) select round(chi2, 6) chi2, n::bigint n_blocks, 3 k, round(chi2 / (3 * (n - 1)), 6) w_code, round(chi2 / (n * 2), 6) w_textbook from c")
def friedman_chi2(spark, sf_dir):
    return rounded(Q.friedman(llm(spark, sf_dir, "especie", "tier", SCORE), "especie", "tier", TIERS, "score_compuesto").drop("p"))


def friedman_p(spark, sf_dir):
    return Q.friedman(llm(spark, sf_dir, "especie", "tier", SCORE), "especie", "tier", TIERS, "score_compuesto")


QUERIES["friedman_p"] = friedman_p

_WILCOXON = f"""with m as (select especie block, tier label, avg(score_compuesto::double) v from {_LLM} where tier in ('T0', 'T1', 'T3') group by all having avg(score_compuesto) is not null),
p as (select x.label a, y.label b, round(x.v - y.v, 9) d from m x join m y on x.block = y.block and x.label < y.label),
k as (select a, b, d, rank() over (partition by a, b order by abs(d)) + (count(*) over (partition by a, b, abs(d)) - 1) / 2.0 rk from p where d <> 0),
w as (select a, b, least(coalesce(sum(rk) filter (where d > 0), 0), coalesce(sum(rk) filter (where d < 0), 0)) w, count(*) nz from k group by all), n as (select a, b, count(*) n from p group by all)
select a, b, n, coalesce(nz, 0) n_nonzero, case when n >= 5 then w end::double w, round(case when n >= 5 then (w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0) end, 6) z, round(case when n >= 5 then abs((w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0)) / sqrt(n) end, 6) r from n left join w using (a, b)"""


@query(_WILCOXON)
def wilcoxon_pairs(spark, sf_dir):
    return rounded(Q.wilcoxon_pairs(llm(spark, sf_dir, "especie", "tier", SCORE), "especie", "tier", TIERS, "score_compuesto").drop("p", "p_bonferroni"))


def wilcoxon_p(spark, sf_dir):
    return Q.wilcoxon_pairs(llm(spark, sf_dir, "especie", "tier", SCORE), "especie", "tier", TIERS, "score_compuesto")


QUERIES["wilcoxon_p"] = wilcoxon_p


@query(f"with x as (select tier g, score_compuesto::double v from {_LLM} where tier is not null and score_compuesto is not null), p as (select g, count(*) n, avg(v) m, var_pop(v) s from x group by g), t as (select sum(n) n, count(*) k, sum(n * m) sm, sum(n * m * m) smm, sum(n * s) w from p) select round(((smm - sm * sm / n) / (k - 1)) / (w / (n - k)), 6) f, (k - 1)::bigint df_between, (n - k)::bigint df_within from t")
def anova_f(spark, sf_dir):
    return rounded(Q.anova(llm(spark, sf_dir, "tier", SCORE), "tier", "score_compuesto").drop("p"))


@query(f"with x as (select tier g, score_compuesto::double v from {_LLM} where tier is not null and score_compuesto is not null), p as (select g, count(*) n, avg(v) m, var_pop(v) s from x group by g), e as (select sum(n * s) / (sum(n) - count(*)) mse from p) select a.g a, b.g b, round(b.m - a.m, 6) + 0.0 difference, round(sqrt(mse / 2 * (1.0 / a.n + 1.0 / b.n)), 6) se, round(abs(b.m - a.m) / sqrt(mse / 2 * (1.0 / a.n + 1.0 / b.n)), 6) q from p a join p b on a.g < b.g, e")
def tukey_differences(spark, sf_dir):
    return rounded(Q.pairwise_differences(llm(spark, sf_dir, "tier", SCORE), "tier", "score_compuesto").drop("p"))


def tukey_p(spark, sf_dir):
    """Tukey's test with its p."""
    return Q.pairwise_differences(llm(spark, sf_dir, "tier", SCORE), "tier", "score_compuesto")


QUERIES["tukey_p"] = tukey_p


def bootstrap_ci(spark, sf_dir):
    return Q.bootstrap_ci(llm(spark, sf_dir, "tier", SCORE), ["tier"], "score_compuesto")


QUERIES["bootstrap_ci"] = bootstrap_ci


@query(f"with {_PAIRED}, v as (select h_m1::double x, l_m1::double y from p where h_m1 is not null and l_m1 is not null), r as (select x, y, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 ry from v) select round(corr(rx, ry), 6) rho, round(avg(abs(x - y)), 6) mae, count(*) n from r")
def expert_calibration(spark, sf_dir):
    return rounded(Q.spearman(_paired(spark, sf_dir).select(F.col("h_m1").cast("double").alias("x"), F.col("l_m1").cast("double").alias("y")), "x", "y"))


@query(f"select disagree_flag label, count(*) n from {_LLM} where disagree_flag is not null and needs_human_review is not null and disagree_flag = needs_human_review group by all")
def agreement_diagonal(spark, sf_dir):
    return A.confusion(llm(spark, sf_dir, "disagree_flag", "needs_human_review"), "disagree_flag", "needs_human_review").filter("disagree_flag = needs_human_review").select(F.col("disagree_flag").alias("label"), "n")


@query(f"select disagree_flag, taxonomy_valid, count(*) n from {_LLM} where disagree_flag is not null and taxonomy_valid is not null group by all")
def confusion_matrix(spark, sf_dir):
    return A.confusion(llm(spark, sf_dir, "disagree_flag", "taxonomy_valid"), "disagree_flag", "taxonomy_valid")


@query(f"with x as (select disagree_flag y, score_compuesto::double s from {_LLM} where disagree_flag is not null and score_compuesto is not null), r as (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 rk from x), t as (select sum(rk) filter (where y = 1) r, count(*) filter (where y = 1) n1, count(*) filter (where y = 0) n0 from r) select round((r - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) auc, n1, n0 from t")
def rank_auc(spark, sf_dir):
    return rounded(W.rank_auc(llm(spark, sf_dir, "disagree_flag", SCORE).withColumn("s", F.col("score_compuesto").cast("double")), "disagree_flag", "s"))


@query(f"with x as (select distinct eval_id, taxonomy_valid from {_LLM} where taxonomy_valid is not null), r as (select *, row_number() over (partition by taxonomy_valid order by eval_id) i, count(*) over (partition by taxonomy_valid) n from x) select eval_id, taxonomy_valid, i <= floor(n * 0.2) is_test from r")
def stratified_split(spark, sf_dir):
    return W.stratified_split(llm(spark, sf_dir, "taxonomy_valid").filter("taxonomy_valid is not null").select("eval_id", "taxonomy_valid").distinct(), "taxonomy_valid", "eval_id")


@query("select username, lag(username) over (order by username) prev, lead(username) over (order by username) as next, row_number() over (order by username) place, count(*) over () places from (select username from expert_sessions)")
def prev_next_nav(spark, sf_dir):
    return W.neighbours(table(spark, sf_dir, "expert_sessions").select("username"), [], "username").withColumns({"place": F.col("place").cast("bigint")})


@query("select exp_id, arg_max(row_id, (loaded_at, row_id)) row_id, max(loaded_at) loaded_at from (select * from results where loaded_at is not null) group by all")
def latest_per_group(spark, sf_dir):
    t = table(spark, sf_dir, "results").filter("loaded_at is not null").select("exp_id", "row_id", "loaded_at")
    return W.latest(t, ["exp_id"], ["loaded_at", "row_id"])


@query(f"select count(*) n from {_HUMAN}")
def dedup_rows(spark, sf_dir):
    return table(spark, sf_dir, "human_evaluations").distinct().agg(F.count("*").alias("n"))


@query("select count(*) n, count(m1) n_m1, count(taxonomy_valid) n_valid, count(evaluator) n_evaluator from (select exp_id, tier, m1, taxonomy_valid::varchar taxonomy_valid, null::varchar evaluator from llm_evaluations union all by name select exp_id, tier, m1, evaluator from human_evaluations)")
def union_missing_cols(spark, sf_dir):
    a = table(spark, sf_dir, "llm_evaluations").select("exp_id", "tier", "m1", F.col("taxonomy_valid").cast("string").alias("taxonomy_valid"))
    b = table(spark, sf_dir, "human_evaluations").select("exp_id", "tier", F.col("m1").cast("float").alias("m1"), "evaluator")
    return R.stacked(a, b).agg(F.count("*").alias("n"), F.count("m1").alias("n_m1"), F.count("taxonomy_valid").alias("n_valid"), F.count("evaluator").alias("n_evaluator"))


@query("select exp_id from (select distinct exp_id from human_evaluations) where exp_id is not null except select exp_id from experiments")
def except_keys(spark, sf_dir):
    return R.keys_missing(human(spark, sf_dir, "exp_id").filter("exp_id is not null"), table(spark, sf_dir, "experiments"), "exp_id")


@query("select eval_id, coalesce((tier = 'T0')::int, 0) \"is_T0\", coalesce((tier = 'T1')::int, 0) \"is_T1\", coalesce((tier = 'T3')::int, 0) \"is_T3\" from llm_evaluations")
def one_hot(spark, sf_dir):
    return R.one_hot(table(spark, sf_dir, "llm_evaluations").select("eval_id", "tier"), "tier", TIERS, "is_").drop("tier")


@query("with t as (select distinct exp_id, persona, status from experiments), u as (select exp_id, min(perfil) persona, 'synced' status from llm_evaluations group by all) select coalesce(t.exp_id, u.exp_id) exp_id, case when t.exp_id is null then u.persona else t.persona end persona, case when u.exp_id is null then t.status else u.status end status from t full join u using (exp_id)")
def upsert_merge(spark, sf_dir):
    t = table(spark, sf_dir, "experiments").select("exp_id", "persona", "status").distinct()
    u = table(spark, sf_dir, "llm_evaluations").groupBy("exp_id").agg(F.min("perfil").alias("persona"), F.lit("synced").alias("status"))
    return R.upsert(t, u, ["exp_id"], update=["status"])


@query("select username from expert_sessions union all select * from (select distinct evaluator from human_evaluations where evaluator is not null) where evaluator not in (select username from expert_sessions)")
def insert_absent(spark, sf_dir):
    have = table(spark, sf_dir, "expert_sessions").select("username")
    new = human(spark, sf_dir, "evaluator").select(F.col("evaluator").alias("username")).filter("username is not null").distinct()
    return R.insert_absent(have, new, ["username"])


@query("select pick_id, coalesce(nullif(trim(species), ''), nullif(trim(family), '')) name from picked_species where coalesce(nullif(trim(species), ''), nullif(trim(family), '')) is not null")
def fallback_column(spark, sf_dir):
    return table(spark, sf_dir, "picked_species").select("pick_id", R.fallback("species", "family").alias("name")).filter("name is not null")


@query("select ref_id, family from species_reference where family between 'L' and 'Pirrequaceae' or family between 'T' and 'Tb'")
def lexicographic_range(spark, sf_dir):
    return R.in_range(table(spark, sf_dir, "species_reference").select("ref_id", "family"), "family", [("L", "Pirrequaceae"), ("T", "Tb")])


@query("select pick_id, species from picked_species where regexp_matches(trim(species), '^\\S+\\s+[a-zà-öø-ÿ]')")
def binomial_filter(spark, sf_dir):
    return table(spark, sf_dir, "picked_species").filter(R.binomial("species")).select("pick_id", "species")


@query("select pick_id, coalesce(v.label, 'otro') label from picked_species p left join (values ('tomo 1', 'uno'), ('tomo 2', 'dos')) v(volume, label) using (volume)")
def dict_lookup_default(spark, sf_dir):
    t = table(spark, sf_dir, "picked_species")
    dim = spark.createDataFrame([("tomo 1", "uno"), ("tomo 2", "dos")], "volume string, label string")
    return R.lookup(t, dim, ["volume"], "label", F.lit("otro")).select("pick_id", "label")


@query("select split_part(file_name, '/', 1) producer, split_part(split_part(file_name, '/', 2), '_', 1) kind, count(*) n from raw_records group by all")
def log_key_split(spark, sf_dir):
    part = F.split_part("file_name", F.lit("/"), F.lit(2))
    return table(spark, sf_dir, "raw_records").groupBy(F.split_part("file_name", F.lit("/"), F.lit(1)).alias("producer"), F.split_part(part, F.lit("_"), F.lit(1)).alias("kind")).agg(F.count("*").alias("n"))


@query("select o.o_orderkey, coalesce(c.c_mktsegment, n.n_name, 'none') parent from orders o left join (select c_custkey, c_mktsegment, c_nationkey from customer where c_acctbal > 0) c on c.c_custkey = o.o_custkey left join (select c_custkey, n_name from customer join nation on n_nationkey = c_nationkey) n on n.c_custkey = o.o_custkey")
def parent_fallback(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    first = c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("parent"))
    second = c.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("parent"))
    return R.with_parents(table(spark, sf_dir, "orders"), [(first, ["o_custkey"]), (second, ["o_custkey"])], "parent", F.lit("none")).select("o_orderkey", "parent")


@query("select exp_id, 1 + coalesce(max(i) filter (where i = c), 0) next_free from (select substring(exp_id, 1, 12) exp_id, c, row_number() over (partition by substring(exp_id, 1, 12) order by c) i from (select distinct exp_id, try_cast(split_part(exp_id, '-', 3) as bigint) c from experiments) where c >= 1) group by all")
def next_free_counter(spark, sf_dir):
    t = table(spark, sf_dir, "experiments").select(F.substring("exp_id", 1, 12).alias("day"), F.split_part("exp_id", F.lit("-"), F.lit(3)).try_cast("bigint").alias("c")).distinct()
    return W.first_gap(t, ["day"], "c").withColumnRenamed("day", "exp_id")


@query(f"with m as (select tier, avg(m2::double) v from {_LLM} where m2 is not null and not isnan(m2) group by all) select l.eval_id, round(coalesce(case when isnan(m2) then null else m2::double end, v), 6) m2 from {_LLM} l left join m using (tier)")
def mean_imputation(spark, sf_dir):
    return rounded(A.filled_with_mean(llm(spark, sf_dir, "tier", "m2").select("eval_id", "tier", "m2"), ["tier"], "m2").select("eval_id", "m2"))


@query("select x.tier, x.eval_id a, y.human_id b from (select tier, eval_id, row_number() over (partition by tier order by eval_id) i from (select distinct tier, eval_id from llm_evaluations) where tier is not null) x join (select tier, human_id, row_number() over (partition by tier order by human_id) i from (select distinct tier, human_id from human_evaluations)) y using (tier, i)")
def positional_zip(spark, sf_dir):
    a = llm(spark, sf_dir, "tier").select("tier", "eval_id").distinct().filter("tier is not null")
    b = human(spark, sf_dir, "tier").select("tier", "human_id").distinct()
    ra = W.value_ranks(a, ["tier"], "eval_id").select("tier", "eval_id", F.col("rank").alias("i"))
    rb = W.value_ranks(b, ["tier"], "human_id").select("tier", "human_id", F.col("rank").alias("i"))
    return ra.join(rb, ["tier", "i"]).select("tier", F.col("eval_id").alias("a"), F.col("human_id").alias("b"))


_FAM = lambda c: f"case when lower({c}) like '%velaria%' then 'v' when lower({c}) like '%orbisai%' then 'o' when lower({c}) like '%tessera%' then 't' else 'unknown' end"


@query(f"select judge_id, case when {_FAM('modelo_generador')} = {_FAM('modelo_juez_a')} and {_FAM('modelo_juez_a')} <> 'unknown' then 'tessera/juez-70b' else modelo_juez_a end judge, judge_a_label = judge_b_label single_judge from {_J}")
def independent_judge(spark, sf_dir):
    fam = (("velaria", "v"), ("orbisai", "o"), ("tessera", "t"))
    t = table(spark, sf_dir, "judge_evals").distinct()
    return t.select("judge_id", S.independent_judge(F.col("modelo_generador"), F.col("modelo_juez_a"), F.lit("tessera/juez-70b"), fam).alias("judge"), (F.col("judge_a_label") == F.col("judge_b_label")).alias("single_judge"))


@query(f"with m as (select especie, round(avg(score_compuesto::double) filter (where tier = 'T0'), 6) a, round(avg(score_compuesto::double) filter (where tier = 'T1'), 6) b, round(avg(score_compuesto::double) filter (where tier = 'T3'), 6) c from {_LLM} group by all) select count(*) filter (where c >= b and b >= a) n_in_order, count(*) filter (where a is not null and b is not null and c is not null) n from m")
def calibration_rank(spark, sf_dir):
    m = rounded(A.pivot_mean(llm(spark, sf_dir, "especie", "tier", SCORE), "especie", "tier", TIERS, "score_compuesto"))
    full = F.col("T0").isNotNull() & F.col("T1").isNotNull() & F.col("T3").isNotNull()
    return m.agg(F.count_if(S.descending(F.col("T3"), F.col("T1"), F.col("T0"))).alias("n_in_order"), F.count_if(full).alias("n"))


@query(f"select l.eval_id, coalesce(e.persona, l.perfil, 'random') persona from (select distinct eval_id, exp_id, perfil from {_LLM}) l left join (select exp_id, min(persona) persona from experiments group by all) e using (exp_id)")
def persona_assignment(spark, sf_dir):
    log = table(spark, sf_dir, "experiments").groupBy("exp_id").agg(F.min("persona").alias("logged"))
    rows = llm(spark, sf_dir, "exp_id", "perfil").select("eval_id", "exp_id", "perfil").distinct()
    return rows.join(log, "exp_id", "left").select("eval_id", F.coalesce("logged", "perfil", F.lit("random")).alias("persona"))


@query(f"select eval_id, case tier when 'T0' then 'question' when 'T1' then 'question+ficha' when 'T3' then 'question+ficha+model' else 'none' end context from {_LLM}")
def tier_context(spark, sf_dir):
    return llm(spark, sf_dir, "tier").select("eval_id", R.remap("tier", {"T0": "question", "T1": "question+ficha", "T3": "question+ficha+model"}, F.lit("none")).alias("context"))


def seeded_sample(spark, sf_dir):
    """A sampling operator: the limit is the feature."""
    return W.sample_n(table(spark, sf_dir, "species_reference"), "ref_id", 100)


def question_assignment(spark, sf_dir):
    pool = {"turista": [f"t{i}" for i in range(10)], "botanico": [f"b{i}" for i in range(17)], "random": ["r0", "r1"]}
    items = llm(spark, sf_dir, "especie", "perfil").filter("perfil in ('turista', 'botanico', 'random')").select("especie", "perfil").distinct()
    return W.cyclic_assignment(items, "especie", "perfil", pool)


QUERIES |= {"seeded_sample": seeded_sample, "question_assignment": question_assignment}
