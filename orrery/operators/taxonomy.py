"""Ingestion of an occupational taxonomy: five related tables from raw sheets.

Keys are cleaned before they are joined. Ratings keep their first non-null value by scale in the order of the rows; rows
that are marked as suppressed are dropped, unmarked ones stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery import contracts as C
from orrery.functions import text as T
from orrery.operators import relational as R

CODE = "onet_soc_code"
RELATION_COLUMNS = {
    CODE: "string", "skill_id": "string", "skill_name": "string", "skill_type": "string", "importance": "double", "level": "double", "hot_technology": "boolean", "in_demand": "boolean",
    "not_relevant": "boolean", "source_date": "timestamp", "domain_source": "string", "category_element_id": "string", "category_name": "string",
}


def _c(name: str) -> Column:
    return T.clean(F.col(f"`{name}`").cast("string"))


def occupations(data: DataFrame, zones: DataFrame) -> DataFrame:
    base = data.select(_c("O*NET-SOC Code").alias(CODE), _c("Title").alias("title"), _c("Description").alias("description"))
    zone = zones.select(_c("O*NET-SOC Code").alias(CODE), F.expr("try_cast(`Job Zone` AS BIGINT)").alias("job_zone"), T.month_year(_c("Date")).alias("job_zone_date"), _c("Domain Source").alias("job_zone_source"))
    return R.left_validated(base, zone, [CODE]).withColumn("has_job_zone_data", F.col("job_zone").isNotNull())


def job_titles(alternate: DataFrame, reported: DataFrame) -> DataFrame:
    """Alternate, short and reported titles; the first spelling of a folded title wins, alternates before shorts before reports."""
    columns = {CODE: "string", "job_title": "string", "title_type": "string", "source_detail": "string", "shown_in_my_next_move": "boolean", "_o": "int"}
    code = _c("O*NET-SOC Code").alias(CODE)
    frames = [
        alternate.select(code, _c("Alternate Title").alias("job_title"), F.lit("alternate").alias("title_type"), _c("Source(s)").alias("source_detail"), F.lit(0).alias("_o")),
        alternate.select(code, _c("Short Title").alias("job_title"), F.lit("short").alias("title_type"), _c("Source(s)").alias("source_detail"), F.lit(1).alias("_o")),
        reported.select(code, _c("Reported Job Title").alias("job_title"), F.lit("reported").alias("title_type"), T.is_yes(_c("Shown in My Next Move")).alias("shown_in_my_next_move"), F.lit(2).alias("_o")),
    ]
    rows = R.union_fixed(frames, columns).where("job_title IS NOT NULL AND job_title <> ''").withColumn("_f", T.fold(F.col("job_title")))
    return R.first_by(rows, [CODE, "_f", "title_type"], [F.col("_o"), F.col("job_title")]).drop("_f", "_o")


def tasks(statements: DataFrame) -> DataFrame:
    return statements.select(
        F.col("`Task ID`").cast("bigint").alias("task_id"), _c("O*NET-SOC Code").alias(CODE), _c("Task").alias("task"), F.coalesce(_c("Task Type"), F.lit("Unspecified")).alias("task_type"),
        F.expr("try_cast(`Incumbents Responding` AS BIGINT)").alias("incumbents_responding"), T.month_year(_c("Date")).alias("source_date"), _c("Domain Source").alias("domain_source"),
    )


def rated_skills(sheet: DataFrame, kind: str, order: str) -> DataFrame:
    """Importance and level of each element by occupation; ``order`` is a column that numbers the sheet's rows."""
    keep = R.keep_unless(sheet, T.is_yes(_c("Recommend Suppress")))
    rows = keep.select(
        _c("O*NET-SOC Code").alias(CODE), _c("Element ID").alias("element_id"), _c("Element Name").alias("skill_name"), _c("Scale ID").alias("scale"), F.expr("try_cast(`Data Value` AS DOUBLE)").alias("value"),
        T.is_yes(_c("Not Relevant")).alias("not_relevant"), T.month_year(_c("Date")).alias("source_date"), _c("Domain Source").alias("domain_source"), F.col(order).alias("_o"),
    )
    keys = [CODE, "element_id", "skill_name"]
    rows = rows.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))
    wide = R.rated_pivot(rows, keys, "scale", "value", {"IM": "importance", "LV": "level"}, [F.col("_o")])
    meta = rows.groupBy(*keys).agg(F.max("source_date").alias("source_date"), F.bool_or("not_relevant").alias("not_relevant"), F.min_by("domain_source", F.when(F.col("domain_source").isNotNull(), F.col("_o"))).alias("domain_source"))
    out = wide.join(meta, keys, "left").withColumn("skill_id", F.concat(F.lit("onet:"), "element_id")).withColumn("skill_type", F.lit(kind))
    return out.withColumn("hot_technology", F.lit(False)).withColumn("in_demand", F.lit(False))


def software_skills(sheet: DataFrame) -> DataFrame:
    return sheet.select(
        _c("O*NET-SOC Code").alias(CODE), T.stable_id(_c("Example")).alias("skill_id"), _c("Example").alias("skill_name"), F.lit("software").alias("skill_type"), F.coalesce(T.is_yes(_c("Hot Technology")), F.lit(False)).alias("hot_technology"),
        F.coalesce(T.is_yes(_c("In Demand")), F.lit(False)).alias("in_demand"), F.lit("technology_skills").alias("domain_source"), _c("Commodity Code").alias("category_element_id"), _c("Commodity Title").alias("category_name"),
    )


def relations(rated: list[DataFrame], software: DataFrame) -> DataFrame:
    return R.union_fixed([*rated, software], RELATION_COLUMNS)


def skills(rated: list[DataFrame], software: DataFrame, reference: DataFrame) -> DataFrame:
    """The catalog. Two spellings of one software id stay two rows, which the contract reports."""
    told = reference.select(_c("Element ID").alias("element_id"), _c("Description").alias("description"))
    columns = {"skill_id": "string", "element_id": "string", "skill_name": "string", "skill_type": "string", "description": "string", "category_element_id": "string", "category_name": "string"}
    elements = reduce(DataFrame.unionByName, (f.select("skill_id", "element_id", "skill_name", "skill_type").distinct() for f in rated))
    named = software.groupBy("skill_id", "skill_name", "skill_type").agg(R.join_unique("category_element_id").alias("category_element_id"), R.join_unique("category_name").alias("category_name"))
    return R.union_fixed([R.left_validated(elements, told, ["element_id"], one_to_one=False), named], columns)


def validate(occupation: DataFrame, task: DataFrame, skill: DataFrame, relation: DataFrame) -> None:
    C.require(
        {
            "occupations key": C.duplicate_keys(occupation, [CODE]), "tasks key": C.duplicate_keys(task, ["task_id"]), "skills key": C.duplicate_keys(skill, ["skill_id"]), "relations key": C.duplicate_keys(relation, [CODE, "skill_id"]),
            "relations occupations": C.orphans(relation, occupation, CODE, CODE), "relations skills": C.orphans(relation, skill, "skill_id", "skill_id"), "tasks occupations": C.orphans(task, occupation, CODE, CODE),
        }
    )


def with_data_flags(occupation: DataFrame, task: DataFrame, relation: DataFrame) -> DataFrame:
    return R.with_member_flag(R.with_member_flag(occupation, task, CODE, "has_task_data"), relation, CODE, "has_skill_data")
