"""Text and date columns. White space is Unicode white space wherever a rule says so, hence ``(?U)`` in the patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(text: Column) -> Column:
    """Strips white space at both ends; null stays null and an empty string stays empty."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize(text: Column) -> Column:
    """Null becomes empty, runs of white space one space, ends are stripped; case is kept."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def truncate(text: Column, limit: int) -> Column:
    """Longer text ends at its last space within the limit, without trailing marks, and with an ellipsis."""
    head = F.substring(text, 1, limit)
    whole_words = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(whole_words, "[ ,;:-]+$", ""), F.lit(" …")))


def token_count(normalized: Column) -> Column:
    return F.when(normalized == "", F.lit(0)).otherwise(F.size(F.split(normalized, " ")))


def fold(text: Column) -> Column:
    """Lower case with the sharp s spelled out, which covers the Latin case folding that names need."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def stable_id(name: Column, kind: str = "software", width: int = 40) -> Column:
    """kind:slug:digest of the folded name; the digest tells apart names with one slug."""
    folded = normalize(fold(name))
    slug = F.substring(F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, width)
    return F.concat(F.lit(f"{kind}:"), F.when(slug == "", F.lit(kind)).otherwise(slug), F.lit(":"), F.substring(F.sha2(folded, 256), 1, 10))


# The sentences that rows of evidence are written as.


def job_line(title: Column, start: Column, end: Column, evidence: Column) -> Column:
    return F.concat(F.lit("Role: "), normalize(title), F.lit(". Dates: "), date_label(start), F.lit(" to "), date_label(end, "present"), F.lit(". Evidence: "), normalize(evidence))


def project_line(title: Column, completed: Column, evidence: Column) -> Column:
    return F.concat(F.lit("Project: "), normalize(title), F.lit(". Completed: "), date_label(completed), F.lit(". Evidence: "), normalize(evidence))


def course_line(name: Column, completed: Column) -> Column:
    return F.concat(F.lit("Course: "), normalize(name), F.lit(". Completed: "), date_label(completed), F.lit("."))


def claim_line(name: Column, level: Column) -> Column:
    return F.concat(F.lit("Claimed skill: "), normalize(name), F.lit("; level: "), F.coalesce(level.cast("int").cast("string"), F.lit("unknown")), F.lit("."))


def is_yes(flag: Column) -> Column:
    return F.upper(flag) == "Y"


def role_prefixed(source: Column, text: Column, kind: str = "Candidate") -> Column:
    return F.concat(F.lit(f"{kind} "), F.replace(source, F.lit("_"), F.lit(" ")), F.lit(" evidence: "), text)


def numbered_id(stem: str, number: Column, width: int) -> Column:
    return F.concat(F.lit(stem), F.lpad(number.cast("string"), width, "0"))


def month_year(text: Column) -> Column:
    """'MM/YYYY' as a timestamp at the month's start; anything else is null."""
    return F.try_to_timestamp(text, F.lit("MM/yyyy"))


def date_label(moment: Column, missing: str = "unknown") -> Column:
    return F.coalesce(F.date_format(moment, "yyyy-MM-dd"), F.lit(missing))


def age_days(moment: Column, snapshot: str) -> Column:
    return F.datediff(F.lit(snapshot).cast("date"), moment)


#: Names that people write another way.
SYNONYMS = {
    "amazon web services aws": "AWS",
    "google cloud platform gcp": "GCP",
    "microsoft azure": "Azure",
    "microsoft excel": "Excel",
    "python": "Python programming",
    "structured query language sql": "SQL",
}


def surface_name(name: Column, draw: list[Column]) -> tuple[Column, Column]:
    """How a person may write a catalog name, and which kind of alias that is. ``draw`` holds four uniform columns."""
    folded = normalize(fold(name))
    synonym = F.coalesce(*(F.when(folded == k, F.lit(v)) for k, v in SYNONYMS.items()))
    kind = (
        F.when(synonym.isNotNull() & (draw[0] < 0.70), "manual_synonym")
        .when(folded.startswith("microsoft ") & (draw[1] < 0.35), "vendor_shortened")
        .when(draw[2] < 0.12, "case_variant")
        .when(folded.contains(" and ") & (draw[3] < 0.12), "symbol_variant")
        .otherwise("canonical")
    )
    written = (
        F.when(kind == "manual_synonym", synonym)
        .when(kind == "vendor_shortened", F.regexp_replace(name, "^[^ ]* ", ""))
        .when(kind == "case_variant", F.lower(name))
        .when(kind == "symbol_variant", F.replace(name, F.lit(" and "), F.lit(" & ")))
        .otherwise(name)
    )
    return written, kind
