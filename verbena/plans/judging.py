"""Queries of the judge ensemble, the evaluation loop, assignments with a log, and lookups of names."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import assignment as A
from ..operators import judging as J
from ..operators import relational as R
from ..operators import scoring as S
from ..runtime import checked_join, materialise, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


MARKS = {"m1": "m1_precision_geografica", "m2": "m2_precision_altitudinal", "m3": "m3_relevancia_respuesta", "m4": "m4_variable_climatica", "m5": "m5_profundidad_analitica"}


def judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded judgements; a judge without any mark has failed (null marks)."""
    t = table(spark, sf_dir, "judge_evals").distinct()
    some = lambda s: F.when(F.coalesce(*(F.col(f"judge_{s}_scores.{m}").cast("string") for m in MARKS.values())).isNotNull(), F.col(f"judge_{s}_scores"))
    return t.withColumns({"a": some("a"), "b": some("b")})


# The ensemble written out from its rules: one side stands in for a missing one, then means, caps and flags.
_S = lambda side, other, m: f"case when {side}_lost then judge_{other}_scores.{MARKS[m]}::varchar else judge_{side}_scores.{MARKS[m]}::varchar end"
_LOST = lambda s: " and ".join(f"judge_{s}_scores.{m} is null" for m in MARKS.values())
_ENSEMBLE = f"""
with j as (select distinct * from judge_evals), l as (select *, ({_LOST("a")}) a_lost, ({_LOST("b")}) b_lost from j),
s as (select judge_id, exp_id, especie, tier, modelo_generador, perfil, taxonomy_valid, case when a_lost then judge_b_label else judge_a_label end la, case when b_lost then judge_a_label else judge_b_label end lb, {", ".join(f"{_S('a', 'b', m)} a{m}, {_S('b', 'a', m)} b{m}" for m in MARKS)} from l where not (a_lost and b_lost)),
d as (select *, coalesce(greatest({", ".join(f"abs(try_cast(a{m} as double) - try_cast(b{m} as double))" for m in MARKS)}), 0) gap, {", ".join(f"case when trim(a{m}) = 'N/A' or trim(b{m}) = 'N/A' then 'N/A' else coalesce(coalesce(round((try_cast(a{m} as double) + try_cast(b{m} as double)) / 2, 2), try_cast(a{m} as double))::varchar, a{m}) end {m}" for m in MARKS)} from s),
p as (select *, tier = 'T3' and coalesce(m2, '') <> 'N/A' with2, tier = 'T3' and perfil = 'botanico' and coalesce(m4, '') <> 'N/A' with4, {", ".join(f"coalesce(try_cast({m} as double), 0) n{m[1]}" for m in MARKS)} from d),
r as (select *, round((n1 + n3 + n5 + case when with2 then n2 else 0 end + case when with4 then n4 else 0 end) / (9 + case when with2 then 2 else 0 end + case when with4 then 2 else 0 end), 4) raw from p),
e as (select *, round(least(raw, case when taxonomy_valid = false then 0.1 else 1 end, case when n3 <= 1 then 0.2 else 1 end), 4) score from r)
"""


@query(_ENSEMBLE + "select judge_id, la judge_a_label, lb judge_b_label, m1, m2, m3, m4, m5, score::double score_compuesto, gap::double max_metric_diff, gap >= 2 disagree_flag, gap >= 2 needs_human_review from e")
def judge_ensemble(spark, sf_dir):
    """One result per answer out of two recorded judges."""
    t = judges(spark, sf_dir)
    result = S.ensemble(F.col("a"), F.col("b"), F.col("judge_a_label"), F.col("judge_b_label"), F.col("tier"), F.col("perfil"), F.col("taxonomy_valid"))
    got = t.select("judge_id", result.alias("r")).filter("r is not null")
    return got.select("judge_id", "r.judge_a_label", "r.judge_b_label", *(F.col(f"r.{m}").alias(k) for k, m in MARKS.items()), "r.score_compuesto", "r.max_metric_diff", "r.disagree_flag", "r.needs_human_review")


def recorded(prompt: str) -> str | None:
    """A client that repeats what stands recorded in the prompt."""
    return prompt or None


@query(_ENSEMBLE + """, k as (select *, exp_id || '|' || especie || '|' || tier || '|' || modelo_generador as "key" from e where especie is not null and exp_id is not null and tier is not null and modelo_generador is not null),
o as (select "key", count(*) n, min(judge_id) judge_id from k group by all), q as (select distinct exp_id || '|' || especie || '|' || tier || '|' || modelo_generador as "key" from llm_evaluations where needs_human_review = 0)
select o."key", case when q."key" is null then 'done' else 'logged' end status, case when q."key" is null then k.score::double end score from o join k using (judge_id) left join q on q."key" = o."key" """)
def evaluation_loop(spark, sf_dir):
    """Every judged answer, evaluated unless the log has it: asked from recorded judges, read, averaged and capped."""
    key = F.concat_ws("|", "exp_id", "especie", "tier", "modelo_generador")
    named = "especie is not null and exp_id is not null and tier is not null and modelo_generador is not null"
    t = judges(spark, sf_dir).filter(named).filter("a is not null or b is not null").withColumn("key", key)
    said = lambda s: F.coalesce(F.concat(F.lit("```json\n"), F.to_json(s), F.lit("\n```")), F.lit(""))
    first = t.groupBy("key").agg(F.min_by(F.struct("tier", "perfil", "taxonomy_valid", said("a").alias("said_a"), said("b").alias("said_b")), "judge_id").alias("r")).select("key", "r.*")
    items = materialise(first.withColumn("ficha", F.lit("recorded")), "loop-items")
    done = table(spark, sf_dir, "llm_evaluations").filter("needs_human_review = 0").select(key.alias("key")).distinct()

    def evaluate(todo: DataFrame) -> DataFrame:
        a, b = (J.asked(todo, ["key"], F.col(f"said_{s}"), recorded).select("key", J.marks(F.col("answer")).alias(s)) for s in "ab")
        both = todo.join(materialise(a, "said-a"), "key").join(materialise(b, "said-b"), "key")
        return both.withColumn("result", S.ensemble(F.col("a"), F.col("b"), F.lit("A"), F.lit("B"), F.col("tier"), F.col("perfil"), F.col("taxonomy_valid")))

    result = "struct<score_compuesto: double>"
    log = done.select("key", F.lit("done").alias("status"), F.lit(None).cast(result).alias("result"))
    evaluated = J.evaluation_loop(items, log, ["key"], lambda todo: evaluate(todo).withColumn("result", F.when(F.col("result").isNotNull(), F.struct(F.col("result.score_compuesto").alias("score_compuesto")))), "ficha")
    return evaluated.select("key", F.when((F.col("status") == "done") & F.col("result").isNull(), "logged").otherwise(F.col("status")).alias("status"), F.col("result.score_compuesto").alias("score"))


@query("""with n as (select row_id, especie from (select distinct * from results) where especie is not null), s as (select species n, 'ACCEPTED' status, ref_id from species_reference union all select unnest(synonyms), 'SYNONYM', ref_id from species_reference),
b as (select n, arg_min(status, (status, ref_id)) status from s where n is not null group by all)
select row_id, coalesce(b.status, 'NOT_FOUND') status, coalesce(b.status, 'NOT_FOUND') in ('ACCEPTED', 'SYNONYM') valid from n left join b on b.n = n.especie""")
def taxonomy_lookup(spark, sf_dir):
    """Names looked up in the backbone: accepted, synonym or not found, and whether that counts as valid."""
    t = table(spark, sf_dir, "results").distinct().filter("especie is not null").select("row_id", "especie")
    ref = table(spark, sf_dir, "species_reference")
    entries = ref.select(F.col("species").alias("especie"), F.lit("ACCEPTED").alias("status"), "ref_id").unionByName(ref.select(F.explode("synonyms").alias("especie"), F.lit("SYNONYM").alias("status"), "ref_id"))
    backbone = materialise(entries.filter("especie is not null").groupBy("especie").agg(F.min_by("status", F.struct("status", "ref_id")).alias("status")), "backbone")
    met = checked_join(t, backbone, ["especie"], "left", salt_on=["row_id"]).withColumn("status", F.coalesce("status", F.lit("NOT_FOUND")))
    return met.select("row_id", "status", S.taxonomy_valid(F.col("status"), F.lit(None).cast("int")).alias("valid"))


@query("select pick_id, case when elevation_min_m is null then 'unknown' else 'checked' end status, coalesce(elevation_max_m, 0) height, 'manual' as \"source\" from picked_species_enhanced")
def merged_validators(spark, sf_dir):
    """Two validators' results as one struct, the later one's fields winning."""
    t = table(spark, sf_dir, "picked_species_enhanced")
    first = F.struct(F.lit("unknown").alias("status"), F.lit("manual").alias("source"))
    second = F.struct(F.when(F.col("elevation_min_m").isNull(), "unknown").otherwise("checked").alias("status"), F.coalesce("elevation_max_m", F.lit(0.0)).alias("height"))
    return t.select("pick_id", A.merged(first, second, ["status", "source"], ["status", "height"]).alias("m")).select("pick_id", "m.*")


POOL = {"turista": [f"t{i}" for i in range(10)], "botanico": [f"b{i}" for i in range(17)], "random": ["r0", "r1"]}


@query("select distinct especie, perfil from results where perfil in ('turista', 'botanico', 'random') and especie is not null except select especie, perfil from llm_evaluations where especie is not null and perfil is not null")
def unlogged_items(spark, sf_dir):
    """Items that a question is still to be assigned to: those of the log are skipped."""
    items = table(spark, sf_dir, "results").filter("perfil in ('turista', 'botanico', 'random') and especie is not null").select("especie", "perfil").distinct()
    log = table(spark, sf_dir, "llm_evaluations").select("especie", "perfil")
    return A.assigned_questions(items, log, "especie", "perfil", POOL).select("especie", "perfil")


@query("select l.eval_id, case when e.persona is not null then e.persona else 'chosen' end persona from (select distinct eval_id, exp_id from llm_evaluations) l left join (select exp_id, min(persona) persona from experiments group by all) e using (exp_id)")
def logged_personas(spark, sf_dir):
    """The persona of each evaluation: the logged one, or a seeded choice (shown as such, for it depends on a hash)."""
    rows = table(spark, sf_dir, "llm_evaluations").select("eval_id", "exp_id").distinct()
    got = A.personas(rows, table(spark, sf_dir, "experiments").select("exp_id", "persona"), "exp_id", ["chosen"])
    return got.select("eval_id", "persona")


@query("select tier, persona, count(*) n from (values ('T0'), ('T1'), ('T3'), ('T9')) t(tier) join (select perfil persona, tier tier_min, eval_id from (select distinct eval_id, perfil, tier from llm_evaluations) where perfil is not null) q on case tier when 'T1' then 1 when 'T3' then 3 else 99 end >= case tier_min when 'T1' then 1 when 'T3' then 3 else 1 end group by all")
def fitting_questions(spark, sf_dir):
    """How many questions of each persona each tier can answer; the evaluations stand for the questions."""
    q = table(spark, sf_dir, "llm_evaluations").select("eval_id", F.col("perfil").alias("persona"), F.col("tier").alias("tier_min")).distinct().filter("persona is not null")
    counted = [A.fitting(q, tier=t).groupBy("persona").agg(F.count("*").alias("n")).withColumn("tier", F.lit(t)) for t in ("T0", "T1", "T3", "T9")]
    return R.stacked(*counted)


@query("select pick_id, coalesce(nullif(trim(volume), ''), 'sin tomo') volume, coalesce(nullif(trim(family), ''), 'sin familia') family, 'es' lang from picked_species")
def prompt_defaults(spark, sf_dir):
    """Prompt variables with their defaults, absent columns included."""
    t = table(spark, sf_dir, "picked_species").select("pick_id", "volume", "family")
    return A.with_defaults(t, {"volume": "sin tomo", "family": "sin familia", "lang": "es"})


@query("select pick_id, coalesce(nullif(trim(species), ''), 'nombre') tone, 'es' lang from picked_species")
def prompt_overrides(spark, sf_dir):
    """Overrides over defaults: blank and unknown ones are ignored."""
    got = A.overridden({"tone": "nombre", "lang": "es"}, F.create_map(F.lit("tone"), F.col("species"), F.lit("lang"), F.lit(" "), F.lit("other"), F.lit("x")))
    return table(spark, sf_dir, "picked_species").select("pick_id", got.alias("m")).select("pick_id", F.col("m")["tone"].alias("tone"), F.col("m")["lang"].alias("lang"))


@query("select ref_id, base64(encode(species)) coded, species name from species_reference where species is not null")
def base64_content(spark, sf_dir):
    t = table(spark, sf_dir, "species_reference").filter("species is not null").select("ref_id", F.encode("species", "utf-8").alias("content"))
    return t.select("ref_id", X.encoded("content").alias("coded"), F.decode(F.unbase64(X.encoded("content")), "utf-8").alias("name"))


@query("select record_id, json_extract_string(payload, '$.exp_id') exp_id from raw_records where json_valid(payload) and json_extract_string(payload, '$.exp_id') is not null")
def fenced_answers(spark, sf_dir):
    """Fields of JSON answers that stand in code fences."""
    t = table(spark, sf_dir, "raw_records").select("record_id", F.concat(F.lit("```json\n"), "payload", F.lit("\n```")).alias("answer"))
    return t.select("record_id", X.json_answer("answer", "exp_id string").alias("r")).select("record_id", "r.exp_id").filter("exp_id is not null")


def assigned_questions(spark, sf_dir):
    """Questions for the items the log does not have, no entry of a pool twice before it is used up."""
    items = table(spark, sf_dir, "results").filter("perfil in ('turista', 'botanico', 'random') and especie is not null").select("especie", "perfil").distinct()
    return A.assigned_questions(items, table(spark, sf_dir, "llm_evaluations").select("especie", "perfil"), "especie", "perfil", POOL)


QUERIES["assigned_questions"] = assigned_questions
