"""Query/retrieve over the patient, study, series, instance hierarchy.

A `Hierarchy` names the tables of an archive. A query is a mapping from attribute keyword to key; the dictionary's VR decides how a
key is matched, and every predicate is a Column expression on the table it belongs to, so Catalyst pushes it to the scan before any join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tessera.functions import matching
from tessera.plans.dims import STATUS, TAG

_VR = {keyword: vr for _, _, vr, keyword in TAG}


def key_predicate(keyword: str, c: Column, key: str, kind: T.DataType | None = None) -> Column:
    """Matching by the VR of the attribute: ranges of dates, lists of UIDs, wildcards for other text, equality for the rest.

    Columns whose `kind` is a date or a whole number are compared by typed constants, which reach the scan.
    """
    vr = _VR.get(keyword, "LO")
    if key == "":
        return F.lit(True)
    if vr == "DA":
        return matching.typed_date_range(c, key) if kind is not None and matching.is_date(kind) else matching.date_range(c, key)
    if vr == "UI":
        return matching.typed_uid_list(c, key) if kind is not None and matching.is_whole(kind) else matching.uid_list(c, key)
    if vr in ("US", "UL", "IS", "DS"):
        return matching.single_value(c, key)
    return matching.wildcard(c, key)


def matched(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows that match every key whose attribute the level has. A null value matches the empty key alone."""
    for keyword, key in keys.items():
        if keyword in df.columns and key != "":
            df = df.where(key_predicate(keyword, F.col(keyword), key, df.schema[keyword].dataType))
    return df


@dataclass(frozen=True)
class Hierarchy:
    """The levels of an archive: each table holds the key columns of its own level and of those above."""

    patients: DataFrame  #: PatientID, PatientName
    studies: DataFrame  #: StudyInstanceUID, PatientID, StudyDate, StudyDescription
    instances: DataFrame  #: StudyInstanceUID, Modality, and what else an instance has

    def find_patients(self, keys: dict[str, str]) -> DataFrame:
        return matched(self.patients, keys)

    def find_studies(self, keys: dict[str, str]) -> DataFrame:
        """Matching studies with their patient and NumberOfStudyRelatedInstances. Only instances of matching studies are counted, before they
        are joined."""
        studies = matched(self.studies, keys)
        out = studies.join(self.find_patients(keys), "PatientID")
        instances = self.instances
        if any(keys.get(c) for c in (*self.studies.columns, *self.patients.columns)):
            instances = instances.join(out.select("StudyInstanceUID"), "StudyInstanceUID", "left_semi")
        related = instances.groupBy("StudyInstanceUID").agg(F.count("*").alias("NumberOfStudyRelatedInstances"))
        return out.join(related, "StudyInstanceUID", "left").withColumn("NumberOfStudyRelatedInstances", F.coalesce("NumberOfStudyRelatedInstances", F.lit(0)))

    def find_series(self, keys: dict[str, str]) -> DataFrame:
        """A series is what a study has of one modality."""
        own = matched(self.instances, keys)
        series = own.groupBy("StudyInstanceUID", "Modality").agg(F.count("*").alias("NumberOfSeriesRelatedInstances"))
        return series.join(self.find_studies(keys).select("StudyInstanceUID", "PatientID", "StudyDate"), "StudyInstanceUID")

    def find_instances(self, keys: dict[str, str]) -> DataFrame:
        own = matched(self.instances, keys)
        studies = matched(self.studies, keys).join(self.find_patients(keys), "PatientID", "left_semi")
        return own.join(studies.select("StudyInstanceUID", "PatientID"), "StudyInstanceUID")

    def related_counts(self) -> DataFrame:
        """Studies, series and instances of every patient."""
        per_study = self.instances.groupBy("StudyInstanceUID").agg(F.count("*").alias("i"), F.countDistinct("Modality").alias("s"))
        joined = self.studies.select("StudyInstanceUID", "PatientID").join(per_study, "StudyInstanceUID", "left")
        return joined.groupBy("PatientID").agg(
            F.count("*").alias("NumberOfPatientRelatedStudies"), F.coalesce(F.sum("s"), F.lit(0)).alias("NumberOfPatientRelatedSeries"), F.coalesce(F.sum("i"), F.lit(0)).alias("NumberOfPatientRelatedInstances"))


def retrieve_progress(items: DataFrame, request: list[str], order: list[str], ok: Column) -> DataFrame:
    """The pending response before each item: `completed`, `failed` so far and `remaining`, per request in the given order."""
    w = Window.partitionBy(*request).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c: F.coalesce(F.sum(c.cast("long")).over(before), F.lit(0))
    total = F.count("*").over(Window.partitionBy(*request))
    out = items.withColumn("completed", count(ok)).withColumn("failed", count(~ok))
    return out.withColumn("remaining", total - (F.col("completed") + F.col("failed") + 1))


def retrieve_result(items: DataFrame, request: list[str], ok: Column, abstract_syntax: str) -> DataFrame:
    """Per request: completed, failed, the final status and the distinct abstract syntaxes that a sub-association needs."""
    out = items.groupBy(*request).agg(F.count_if(ok).alias("completed"), F.count_if(~ok).alias("failed"), F.array_join(F.array_sort(F.collect_set(abstract_syntax)), ",").alias("abstract_syntaxes"))
    return out.withColumn("status", F.when(F.col("failed") > 0, STATUS["some_failed"]).otherwise(STATUS["success"]))


def destinations(requests: DataFrame, title: str, table: DataFrame, name: str, order: str) -> DataFrame:
    """Each request with the first destination whose title is the same, trimmed and upper-cased; status A801 where none is."""
    norm = lambda c: F.upper(F.trim(F.col(c)))
    first = table.groupBy(norm(name).alias("__title")).agg(F.min_by(F.struct(*table.columns), order).alias("d"))
    out = requests.join(first, norm(title) == F.col("__title"), "left").drop("__title")
    return out.select(*requests.columns, *[F.col(f"d.{c}").alias(c) for c in table.columns], F.when(F.col("d").isNull(), STATUS["unknown_destination"]).otherwise(STATUS["success"]).alias("status"))
