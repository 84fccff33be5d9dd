"""Evaluation of answers by judges: an injectable client, an ensemble of two judges and a third, and the loop that goes on from its log.

A client is a function of one prompt that gives the judge's text, or None if it failed; it runs in the workers, one
call per row, and is the only place where anything leaves the engine. Tests and queries use recorded answers.

Defined results: an answer that cannot be read as JSON counts as a failure; items without the text that the judges
compare with are skipped; items logged as done keep their logged result and are not asked again; repeated items are asked once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..runtime import checked_join, materialise
from . import scoring as S

Client = Callable[[str], str | None]
MARKS = "m1_precision_geografica string, m2_precision_altitudinal string, m3_relevancia_respuesta string, m4_variable_climatica string, m5_profundidad_analitica string"


def asked(df: DataFrame, key: Sequence[str], prompt: Column, client: Client, retries: int = 3) -> DataFrame:
    """(key, answer): the client's answers, asked again up to ``retries`` times in all while it gives none; an error of the client counts as none."""
    rows = df.select(*key, prompt.alias("__prompt"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def once(p: str | None) -> str | None:
            for _ in range(retries if p is not None else 0):
                try:
                    got = client(p)
                except Exception:  # a judge that fails is a result, not a failure of the job
                    got = None
                if got is not None:
                    return got
            return None

        for pdf in batches:
            yield pdf[list(key)].assign(answer=[once(p) for p in pdf["__prompt"]])

    kinds = dict(df.dtypes)
    return rows.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", answer string")


def marks(answer: Column) -> Column:
    """The marks in a judge's answer, null if there are none."""
    got = X.json_answer(answer, MARKS)
    some = F.coalesce(*(got[m] for m in S.METRICS))
    return F.when(some.isNotNull(), got)


def judged(items: DataFrame, key: Sequence[str], prompt: Column, a: Client, b: Client, c: Client | None = None, own_a: Column | None = None, own_b: Column | None = None) -> DataFrame:
    """items (key, tier, perfil, ..) with ``result``, as ``scoring.ensemble``.

    ``own_a``, ``own_b``: whether judge A or B is of the answer's own family; the third judge then stands in. It is also asked where the first two disagree.
    """
    key = list(key)
    out = items
    no = F.lit(False)
    own_a, own_b = (no if c is None or own_a is None else own_a), (no if c is None or own_b is None else own_b & ~(no if own_a is None else own_a))
    out = out.withColumn("__own_a", own_a).withColumn("__own_b", own_b)
    for name, client in (("a", a), ("b", b)):
        one = asked(out.filter(~F.col(f"__own_{name}")), key, prompt, client).select(*key, marks(F.col("answer")).alias(f"__m_{name}"))
        if c is not None:
            one = one.unionByName(asked(out.filter(F.col(f"__own_{name}")), key, prompt, c).select(*key, marks(F.col("answer")).alias(f"__m_{name}")))
        out = out.join(materialise(one, f"judge-{name}"), key, "left")
    label = lambda name: F.when(F.col(f"__own_{name}"), "C").otherwise(name.upper())
    args = (F.col("__m_a"), F.col("__m_b"), label("a"), label("b"), F.col("tier"), F.col("perfil"), F.col("taxonomy_valid") if "taxonomy_valid" in items.columns else None)
    if c is None:
        return out.withColumn("result", S.ensemble(*args)).select(*items.columns, "result")
    apart = out.filter(S.ensemble(*args)["disagree_flag"])
    third = asked(apart, key, prompt, c).select(*key, F.to_json(marks(F.col("answer"))).alias("__m_c"))
    out = out.join(materialise(third, "judge-c"), key, "left")
    return out.withColumn("result", S.ensemble(*args, F.col("__m_c"))).select(*items.columns, "result")


def evaluation_loop(items: DataFrame, log: DataFrame, key: Sequence[str], evaluate: Callable[[DataFrame], DataFrame], ground: str) -> DataFrame:
    """(key, status, result) of all items that can be evaluated: the logged rows that are done, and the rest evaluated now, done or failed.

    items: one row per key (repeated ones count once) with the text ``ground`` that the judges compare with; log: (key, status, result).
    ``evaluate`` adds ``result`` (null: failed), as ``judged`` does. Only what the log does not have as done is evaluated, so a stopped loop goes on from its log.
    """
    key = list(key)
    items = items.filter(F.length(F.trim(F.coalesce(ground, F.lit("")))) > 0).dropDuplicates(key)
    done = log.filter("status = 'done'").select(*key, "status", "result").dropDuplicates(key)
    todo = materialise(items.join(done.select(*key), key, "left_anti"), "loop-todo")
    new = evaluate(todo).select(*key, F.when(F.col("result").isNotNull(), "done").otherwise("failed").alias("status"), "result")
    return done.join(items.select(*key), key, "left_semi").unionByName(new)


def directory_items(texts: DataFrame, profile_part: str, ground_part: str, marker: str) -> DataFrame:
    """(especie, tier, model, question, answer, ground) out of whole files (path, text) of a run: species/tier/profile files, and a ground text in the species' folder or one of its tiers (the first by path).

    The answer is what follows the marker, the question what the header line "Pregunta Usuario" says.
    """
    parts = F.split("path", "/")
    files = texts.select("path", "text", F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("up"), F.element_at(parts, -3).alias("upper"))
    species = F.translate(F.when(F.col("up").rlike("^T[0-9]$"), F.col("upper")).otherwise(F.col("up")), "_", " ")
    ground = files.filter(F.col("name").contains(ground_part)).groupBy(species.alias("especie")).agg(F.min_by("text", F.struct(F.col("up").rlike("^T[0-9]$"), "path")).alias("ground"))
    profiles = files.filter(F.col("name").contains(profile_part) & F.col("up").rlike("^T[0-9]$"))
    model = F.regexp_replace("name", rf"^.*{profile_part}|\.txt$", "")
    rows = profiles.select(species.alias("especie"), F.col("up").alias("tier"), model.alias("model"), X.header_value("text", "Pregunta Usuario").alias("question"), X.after_marker("text", marker).alias("answer"))
    return checked_join(rows, materialise(ground, "run-ground"), ["especie"], "left")
