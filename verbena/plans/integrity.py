"""Problem 1: orphan references of the evaluation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.orphans import Child, OrphanTracker, orphan_report, orphan_rows, parents, track
from ..runtime import table


def _replay(spark: SparkSession, sf_dir: str, snapshots: bool = False) -> tuple[OrphanTracker, DataFrame | None]:
    t = lambda name: table(spark, sf_dir, name)
    children = [
        Child("human_evaluations", t("human_evaluations"), "human_id", "submitted_at", "received_at", ("exp_id", "especie", "modelo_generador")),
        Child("llm_evaluations", t("llm_evaluations"), "eval_id", "synced_at", "synced_at", ("tier",)),
    ]
    index = (
        parents(t("experiments"), "exp_id", "exp_id", "registered_at", "deleted_at")
        .unionByName(parents(t("species_reference"), "especie", "species", "valid_from", "retired_at"))
        .unionByName(parents(t("generator_models"), "modelo_generador", "modelo_generador", "available_from", "retired_at"))
        .unionByName(parents(t("tier_defs"), "tier", "tier", "valid_from", "retired_at"))
    )
    return track(children, index, snapshots=snapshots)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_rows(_replay(spark, sf_dir)[0])


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_replay(spark, sf_dir)[0])


def p1_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replay(spark, sf_dir, snapshots=True)[1]


_KEY = "trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_')"
_TIME = "try_cast(case when regexp_matches({c}, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') and regexp_matches({c}, '[0-9]:[0-9]') then {c} else {c} || 'Z' end as timestamptz) at time zone 'UTC'"


def _child(name: str, row_id: str, field: str, time: str) -> str:
    return f"select '{name}' child_table, '{field}' ref_field, {row_id} row_id, {_KEY.format(c=field)} k, {_TIME.format(c=time)} t from {name} where {field} is not null"


def _parent(name: str, field: str, key: str, lo: str, hi: str) -> str:
    return f"select '{field}' ref_field, {_KEY.format(c=key)} k, min({lo}) lo, max(coalesce({hi}, timestamp '9999-01-01')) hi from {name} where {key} is not null group by all"


_FAULTS = f"""
with c as ({" union ".join([_child("human_evaluations", "human_id", f, "submitted_at") for f in ("exp_id", "especie", "modelo_generador")] + [_child("llm_evaluations", "eval_id", "tier", "synced_at")])}),
p as ({" union all ".join([_parent("experiments", "exp_id", "exp_id", "registered_at", "deleted_at"), _parent("species_reference", "especie", "species", "valid_from", "retired_at"), _parent("generator_models", "modelo_generador", "modelo_generador", "available_from", "retired_at"), _parent("tier_defs", "tier", "tier", "valid_from", "retired_at")])}),
f as (select c.*, case when p.k is null then 'missing' when t < lo then 'late' when t >= hi then 'deleted' end fault from c left join p using (ref_field, k))
"""

_EVENTS = """
with c as ({children}), p as ({parents}),
s as (select b, lead(b) over (order by b) is null last, timestamp '1970-01-01' + to_days(cast((b + 1) * 183 as int)) as_of from (select distinct cast(floor(epoch_us(arrived) / 15811200000000.0) as bigint) b from c where arrived is not null)),
k as (select s.as_of, ref_field, k, min(lo) lo, max(case when last or hi < s.as_of then hi else timestamp '9999-01-01' end) hi from p, s where last or lo < s.as_of group by all),
f as (select s.as_of, c.child_table, c.ref_field, c.row_id, c.k, c.t, case when k.k is null then 'missing' when t < lo then 'late' when t >= hi then 'deleted' end fault
  from c join s on s.last or c.arrived < s.as_of left join k on k.as_of = s.as_of and k.ref_field = c.ref_field and k.k = c.k)
select as_of, child_table, ref_field, fault, count(*) n_refs from (select distinct * from f where fault is not null) group by all
"""


def _arriving(name: str, row_id: str, field: str, time: str, got: str) -> str:
    return f"select distinct '{name}' child_table, '{field}' ref_field, {row_id} row_id, {_KEY.format(c=field)} k, {_TIME.format(c=time)} t, coalesce({got}, {_TIME.format(c=time)}) arrived from {name} where {field} is not null"


def _record(name: str, field: str, key: str, lo: str, hi: str) -> str:
    return f"select '{field}' ref_field, {_KEY.format(c=key)} k, coalesce({lo}, timestamp '0001-01-01') lo, coalesce({hi}, timestamp '9999-01-01') hi from {name} where {key} is not null"


_SNAPSHOTS = _EVENTS.format(
    children=" union all ".join([_arriving("human_evaluations", "human_id", f, "submitted_at", "received_at") for f in ("exp_id", "especie", "modelo_generador")] + [_arriving("llm_evaluations", "eval_id", "tier", "synced_at", _TIME.format(c="synced_at"))]),
    parents=" union all ".join([_record("experiments", "exp_id", "exp_id", "registered_at", "deleted_at"), _record("species_reference", "especie", "species", "valid_from", "retired_at"), _record("generator_models", "modelo_generador", "modelo_generador", "available_from", "retired_at"), _record("tier_defs", "tier", "tier", "valid_from", "retired_at")]),
)

QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_snapshots": p1_snapshots}
ORACLE = {
    "p1_found": _FAULTS + "select distinct child_table, ref_field, row_id, fault from f where fault is not null",
    "p1_report": _FAULTS + "select child_table, ref_field, strftime(t, '%Y-%m') as month, fault, count(distinct row_id) as n_refs from f where fault is not null group by all",
    "p1_snapshots": _SNAPSHOTS,
}
