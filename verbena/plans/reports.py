"""Queries of the reports: strata, metrics, generators, agreement of people and judges, and the small operators around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical_key
from ..functions.numbers import half_away, half_even, whole, zero_as_missing
from ..operators import relational as R
from ..operators import reports as P
from ..operators import windows as W
from ..runtime import table
from ..sources import readers
from .evaluation import KEYS, METRICS, SCORE, TIERS, human, llm, model, rounded

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_ROWS = "r as (select coalesce(s.stratum, l.stratum) stratum, l.* exclude (stratum) from (select distinct * from llm_evaluations) l cross join (values (null), ('all')) s(stratum) where tier in ('T0', 'T1', 'T3') and (s.stratum is not null or l.stratum is not null))"


def _report(spark, sf_dir, n_boot: int = 10_000):
    return P.stratum_report(llm(spark, sf_dir, "stratum", "especie", "tier", SCORE), "stratum", TIERS, SCORE, n_boot=n_boot)


@query(f"with {_ROWS} select stratum, tier, round(avg(score_compuesto::double), 6) mean, round(stddev_samp(score_compuesto::double), 6) std, count(score_compuesto) n from r group by all having count(score_compuesto) > 0")
def stratum_tiers(spark, sf_dir):
    """Means per stratum (and over all) and tier; the intervals are in stratum_report."""
    return rounded(_report(spark, sf_dir, 50)["tier_stats"].drop("ci_low", "ci_high"))


def stratum_report(spark, sf_dir):
    """Means per stratum and tier with their bootstrap intervals."""
    return _report(spark, sf_dir)["tier_stats"]


_MEANS = "m as (select stratum, especie block, tier label, avg(score_compuesto::double) v from r where especie is not null group by all having avg(score_compuesto) is not null)"


@query(f"""with {_ROWS}, {_MEANS}, b as (select m.* from m join (select stratum, block from m group by all having count(*) = 3) using (stratum, block)),
k as (select *, rank() over (partition by stratum, block order by v) + (count(*) over (partition by stratum, block, v) - 1) / 2.0 rk from b),
t as (select stratum, sum(t * t * t - t) ties from (select stratum, block, v, count(*) t from b group by all) group by all), s as (select stratum, sum(x * x) rr, max(n) n from (select stratum, label, sum(rk) x, count(*) n from k group by all) group by all)
select stratum, n::bigint n_blocks, round(case when n >= 2 then (12 * rr / (n * 12) - 3 * n * 4) / nullif(1 - ties / (n * 24.0), 0) end, 6) chi2 from s join t using (stratum)""")
def stratum_friedman(spark, sf_dir):
    return rounded(_report(spark, sf_dir)["friedman"].select("stratum", "n_blocks", "chi2"))


@query(f"""with {_ROWS}, {_MEANS}, p as (select x.stratum, x.label a, y.label b, round(x.v - y.v, 9) d from m x join m y on x.stratum = y.stratum and x.block = y.block and x.label < y.label),
k as (select *, rank() over (partition by stratum, a, b order by abs(d)) + (count(*) over (partition by stratum, a, b, abs(d)) - 1) / 2.0 rk from p where d <> 0),
w as (select stratum, a, b, least(coalesce(sum(rk) filter (where d > 0), 0), coalesce(sum(rk) filter (where d < 0), 0)) w, count(*) nz from k group by all), n as (select stratum, a, b, count(*) n from p group by all)
select stratum, a, b, n, coalesce(nz, 0) n_nonzero, case when n >= 5 then w end::double w from n left join w using (stratum, a, b)""")
def stratum_wilcoxon(spark, sf_dir):
    rows = _report(spark, sf_dir)["wilcoxon"]
    return rounded(rows.select("stratum", "a", "b", "n", "n_nonzero", "w"))


@query("select metric, tier, round(avg(v), 6) mean, round(stddev_samp(v), 6) std, count(v) n from (unpivot (select tier, coalesce(try_cast(m1_precision_geografica as double), -9) m1_precision_geografica, coalesce(try_cast(m2_precision_altitudinal as double), -9) m2_precision_altitudinal, coalesce(try_cast(m3_relevancia_respuesta as double), -9) m3_relevancia_respuesta from (select distinct * from results) where tier in ('T0', 'T1', 'T3')) on m1_precision_geografica, m2_precision_altitudinal, m3_relevancia_respuesta into name metric value v) where v <> -9 group by all")
def metric_tiers(spark, sf_dir):
    """Metrics by tier out of mixed columns (numbers, N/A, missing); metrics the table lacks are passed over."""
    names = ["m1_precision_geografica", "m2_precision_altitudinal", "m3_relevancia_respuesta", "m4_variable_climatica", "m5_profundidad_analitica"]
    t = table(spark, sf_dir, "results").distinct()
    return rounded(P.metric_report(t, names, TIERS, n_boot=50).drop("ci_low", "ci_high"))


def metric_report(spark, sf_dir):
    """Metrics by tier with bootstrap intervals."""
    return P.metric_report(llm(spark, sf_dir, "tier", *METRICS), METRICS, TIERS)


_MODEL = "trim(regexp_replace(lower(modelo_generador), '[^\\p{L}\\p{N}]+', '_', 'g'), '_')"


@query(f"""with l as (select distinct eval_id, especie, tier, {_MODEL} model, score_compuesto::double s from llm_evaluations where tier is not null and modelo_generador is not null and score_compuesto is not null),
t as (select tier, model, i from (select tier, model, row_number() over (partition by tier order by model) i from (select distinct tier, model from l)) where i <= 2),
m as (select tier, i, especie, avg(s) v from l join t using (tier, model) where especie is not null group by all), p as (select x.tier, x.v v1, y.v v2, round(x.v - y.v, 9) d from m x join m y on x.tier = y.tier and x.especie = y.especie and x.i = 1 and y.i = 2),
k as (select tier, d, rank() over (partition by tier order by abs(d)) + (count(*) over (partition by tier, abs(d)) - 1) / 2.0 rk from p where d <> 0),
w as (select tier, least(coalesce(sum(rk) filter (where d > 0), 0), coalesce(sum(rk) filter (where d < 0), 0)) w from k group by all), n as (select tier, count(*) n, round(avg(v1), 6) mean_1, round(avg(v2), 6) mean_2 from p group by all), z as (select tier, max(model) filter (where i = 1) model_1, max(model) filter (where i = 2) model_2 from t group by all)
select tier, model_1, model_2, mean_1, mean_2, w::double w, n from n join w using (tier) join z using (tier) where n >= 5""")
def generator_comparison(spark, sf_dir):
    """The first two generators of each tier side by side over the species both have."""
    t = llm(spark, sf_dir, "especie", "tier", "modelo_generador", SCORE).withColumn("model", model())
    return rounded(P.generator_comparison(t, "model", SCORE).drop("p"))


def _pairs(spark, sf_dir):
    keyed = lambda df: df.select(*(canonical_key(k).alias(f"k_{k}") for k in KEYS), *METRICS)
    keys = [f"k_{k}" for k in KEYS]
    return R.paired(keyed(human(spark, sf_dir, *KEYS, *METRICS)), keyed(llm(spark, sf_dir, *KEYS, *METRICS)), keys, "inner", "h_", "l_")


_KEYED = ", ".join(f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_') k_{c}" for c in KEYS)
_VECTORS = f"""h as (select {_KEYED}, {", ".join(f"{m}::int h_{m}" for m in METRICS)} from (select distinct * from human_evaluations)), l as (select {_KEYED}, {", ".join(f"round_even({m}::double, 0)::int l_{m}" for m in METRICS)} from (select distinct * from llm_evaluations)),
j as (select * from h join l using (k_exp_id, k_especie, k_tier, k_modelo_generador)), v as ({" union all ".join(f"select '{m}' metric, h_{m} human, l_{m} judge from j where h_{m} is not null and l_{m} is not null" for m in METRICS)})"""


@query(f"with {_VECTORS} select metric, human, judge, count(*) n from v group by all")
def kappa_pairs(spark, sf_dir):
    """Whole marks of people and judges side by side, counted."""
    return P.paired_marks(_pairs(spark, sf_dir), METRICS).groupBy("metric", "human", "judge").agg(F.count("*").alias("n"))


@query(f"""with {_VECTORS}, p as (select metric, human a, judge b, count(*) c from v group by all), o as (select metric, x, row_number() over (partition by metric order by x) i from (select metric, a x from p union select metric, b from p)),
q as (select p.metric, la.i i, lb.i j, c from p join o la on la.metric = p.metric and la.x = a join o lb on lb.metric = p.metric and lb.x = b), n as (select metric, sum(c) n, sum(abs(i - j) * c) s from q group by all),
e as (select x.metric, sum(abs(x.i - y.j) * x.c * y.c) e from q x join q y on x.metric = y.metric group by all)
select metric, n::bigint n, round(1 - s / nullif(e / n, 0), 6) kappa from n join e using (metric) where n >= 2""")
def kappa_by_metric(spark, sf_dir):
    """Agreement of people and judges per metric."""
    return rounded(P.agreement_by_metric(_pairs(spark, sf_dir), METRICS).filter("n >= 2"))


@query(f"select tier, {_MODEL} model, round(cast(avg(m1::double) as decimal(38, 18)), 3)::double avg_m1, count(*) n from (select distinct * from llm_evaluations) group by all")
def decimal_summary(spark, sf_dir):
    """Means rounded as a database's numeric type rounds."""
    t = llm(spark, sf_dir, "tier", "modelo_generador", "m1").withColumn("model", model())
    return t.groupBy("tier", "model").agg(half_away(F.avg(F.col("m1").cast("double"))).alias("avg_m1"), F.count("*").alias("n"))


@query("select l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) half, round_even(l_quantity / 2, 0)::int whole, nullif(l_discount, 0) discount from lineitem")
def rounding_rules(spark, sf_dir):
    """Halves to the even neighbour, whole numbers, and 0 taken for no value."""
    t = table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", half_even(F.col("l_quantity") / 2).alias("half"), whole(F.col("l_quantity") / 2).alias("whole"), zero_as_missing("l_discount").alias("discount"))


@query("select coalesce(p_brand, 'l_partkey_' || l_partkey) p_brand, sum(n)::bigint n from (select l_partkey, count(*) n from lineitem group by all) c left join (select p_partkey l_partkey, p_brand from part where p_size > 25) p using (l_partkey) group by all")
def merged_counts(spark, sf_dir):
    """Counts per key summed over keys of one name."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    names = table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return R.merged_counts(counts, names, "l_partkey", "p_brand")


@query("select l_partkey, count(*) n from lineitem group by all order by n desc, l_partkey limit 50 offset 50")
def facet_page(spark, sf_dir):
    """The second page of the counts per part: paging is the feature."""
    return readers.facets(table(spark, sf_dir, "lineitem"), "l_partkey", 50, 50)


@query("select especie, arg_min(row_id, row_id) row_id from (select distinct * from results) where lower(taxonomy_valid) = 'true' group by all")
def first_verified(spark, sf_dir):
    """The first verified result of each species."""
    t = table(spark, sf_dir, "results").select("especie", "row_id", "taxonomy_valid").distinct()
    return R.first_success(t, ["especie"], "row_id", F.lower("taxonomy_valid") == "true").select("especie", "row_id")


@query("select file_name, seq from (select file_name || '|eval' as \"key\", file_name, file_seq seq, case when file_seq > 1 then 'done' else 'open' end status from raw_records where feed = 'eval') where status = 'done'")
def finished_log_keys(spark, sf_dir):
    """Rows of a log whose key says eval and whose status says done."""
    t = table(spark, sf_dir, "raw_records").withColumn("key", F.concat_ws("|", "file_name", "feed")).withColumn("status", F.when(F.col("file_seq") > 1, "done").otherwise("open"))
    return R.finished(t, "key", "eval").select("file_name", F.col("file_seq").alias("seq"))


@query("select count(*) n from picked_species where lower(volume) = lower((select min(volume) from picked_species)) and lower(phylum) = lower((select min(phylum) from picked_species))")
def folded_filter(spark, sf_dir):
    """Rows that equal two given values whatever their case."""
    t = table(spark, sf_dir, "picked_species")
    v = t.agg(F.min("volume").alias("v"), F.min("phylum").alias("p")).first()
    return R.folded_equals(t, volume=v.v.upper(), phylum=v.p.lower()).agg(F.count("*").alias("n"))


@query("select 'x' as \"tag\", eval_id, m1, m2, m3, m4, m5, tier kind from llm_evaluations where tier = 'T1'")
def chosen_columns(spark, sf_dir):
    """Columns picked by what the table has, by parts of names, by exclusion and by the first that exists; a constant in front; a filter only where a value is given."""
    t = R.optionally(R.optionally(table(spark, sf_dir, "llm_evaluations"), "tier", "T1"), "perfil", None)
    t = t.withColumn("kind", R.first_existing(t, ["clase", "tier", "perfil"]))
    marks = [c for c in R.matching(t, ["m1", "m2", "m3", "m4", "m5"]) if c not in R.excluding(t, METRICS)]
    return R.with_constants(R.existing(t, ["eval_id", *marks, "nowhere", "kind"]), {"tag": "x"}, first=True)


@query("select e.exp_id, coalesce(n.notes, e.notes) notes from (select distinct exp_id, notes from experiments) e left join (select exp_id, 'revisado' notes from experiments where status = 'done' group by all) n using (exp_id)")
def masked_assignment(spark, sf_dir):
    """Values replaced where a table of replacements has the key."""
    t = table(spark, sf_dir, "experiments").select("exp_id", "notes").distinct()
    new = table(spark, sf_dir, "experiments").filter("status = 'done'").select("exp_id", F.lit("revisado").alias("notes")).distinct()
    return R.assigned(t, new, "exp_id")


@query("select pick_id, species, 'kept' kind from picked_species where species is null or species not in (select species from species_reference) union all select pick_id, species, 'left out' from picked_species where species not in (select species from species_reference)")
def rows_not_in(spark, sf_dir):
    """Rows whose name is not listed, those without a name kept and left out."""
    t, ref = table(spark, sf_dir, "picked_species").select("pick_id", "species"), table(spark, sf_dir, "species_reference")
    return R.rows_not_in(t, ref, "species").withColumn("kind", F.lit("kept")).unionByName(R.rows_not_in(t, ref, "species", keep_nulls=False).withColumn("kind", F.lit("left out")))


@query("select tier, min(s) lowest, median(s) middle, max(s) highest, count(*) n from (select distinct eval_id, tier, score_compuesto::double s from llm_evaluations) where s is not null and tier is not null group by all")
def box_data(spark, sf_dir):
    """The figures behind a box plot of the scores per tier."""
    t = llm(spark, sf_dir, "tier", SCORE).select("tier", F.col(SCORE).cast("double").alias("s")).filter("s is not null and tier is not null")
    ends = t.groupBy("tier").agg(F.min("s").alias("lowest"), F.max("s").alias("highest"), F.count("*").alias("n"))
    return ends.join(W.medians(t, ["tier"], "s", "middle"), "tier").select("tier", "lowest", "middle", "highest", "n")


@query(f"select eval_id, {', '.join(f'{m}::int {m}' for m in ('disagree_flag', 'taxonomy_valid'))}, case when lower(r.taxonomy_valid::varchar) = '1' then 1 else 0 end flag from llm_evaluations r where taxonomy_valid is not null and disagree_flag is not null")
def typed_flags(spark, sf_dir):
    """Mixed flags as whole numbers."""
    t = table(spark, sf_dir, "llm_evaluations").filter("taxonomy_valid is not null and disagree_flag is not null")
    return t.select("eval_id", R.number("disagree_flag").cast("int").alias("disagree_flag"), R.number("taxonomy_valid").cast("int").alias("taxonomy_valid"), F.coalesce(R.number("taxonomy_valid").cast("int"), F.lit(0)).alias("flag"))


QUERIES |= {"stratum_report": stratum_report, "metric_report": metric_report}
