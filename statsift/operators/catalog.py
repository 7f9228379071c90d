"""Catalogue JSON and sidecars as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statsift.functions.cells import as_flag, as_int, blank_to_null, year_of
from statsift.operators.payload import parse_yaml
from statsift.sources.kept import spread

#: Fields that a standard-format file must have, in order.
MANDATORY = ("chromosome", "base_pair_location", "effect_allele", "other_allele", "beta", "standard_error", "effect_allele_frequency", "p_value")
_STUDY_V2 = "accession_id string, disease_trait string, efo_traits array<struct<efo_id:string,efo_trait:string>>, initial_sample_size string, replication_sample_size string, full_summary_stats string, full_summary_stats_available boolean, pubmed_id string, publication_date string, discovery_ancestry array<string>, cohort array<string>"
_STUDY_V1 = "accessionId string, diseaseTrait struct<trait:string>, initialSampleSize string, replicationSampleSize string, fullPvalueSet boolean, cohort string, publicationInfo struct<pubmedId:string,publicationDate:string>, ancestries array<struct<type:string,numberOfIndividuals:bigint,ancestralGroups:array<struct<ancestralGroup:string>>>>"
_SIDECAR = "gwas_id string, trait_description array<string>, genome_assembly string, file_type string, data_file_name string, data_file_md5sum string, is_harmonised string, is_sorted string, samples array<struct<sample_ancestry_category:array<string>,sample_size:string,case_control_study:string,case_count:string,control_count:string>>"


def studies_v2(pages: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """Studies from the newer route's JSON; ``keep``: columns of the pages that go along."""
    s = F.from_json(body, _STUDY_V2)
    return pages.select(*keep, s.alias("s")).select(
        *keep, F.col("s.accession_id").alias("accession"), blank_to_null(F.col("s.disease_trait")).alias("trait"),
        F.transform("s.efo_traits", lambda t: t["efo_trait"]).alias("mapped_traits"), blank_to_null(F.col("s.initial_sample_size")).alias("initial_sample"),
        blank_to_null(F.col("s.replication_sample_size")).alias("replication_sample"), F.col("s.full_summary_stats_available").alias("has_sumstats"),
        F.col("s.pubmed_id").alias("pubmed_id"), year_of(F.col("s.publication_date")).alias("year"), F.col("s.discovery_ancestry").alias("ancestries"), F.col("s.cohort").alias("cohorts"),
        blank_to_null(F.col("s.full_summary_stats")).alias("location"), F.lit(None).cast("long").alias("study_n"),
    )


def studies_v1(pages: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """Studies from the older route's JSON; its cohorts are one string with bars, its discovery numbers add up."""
    s = F.from_json(body, _STUDY_V1)
    groups = F.flatten(F.transform(F.filter("s.ancestries", lambda a: a["type"] == "initial"), lambda a: F.transform(a["ancestralGroups"], lambda g: g["ancestralGroup"])))
    return pages.select(*keep, s.alias("s")).select(
        *keep, F.col("s.accessionId").alias("accession"), blank_to_null(F.col("s.diseaseTrait.trait")).alias("trait"), F.lit(None).cast("array<string>").alias("mapped_traits"),
        blank_to_null(F.col("s.initialSampleSize")).alias("initial_sample"), blank_to_null(F.col("s.replicationSampleSize")).alias("replication_sample"),
        F.col("s.fullPvalueSet").alias("has_sumstats"), F.col("s.publicationInfo.pubmedId").alias("pubmed_id"), year_of(F.col("s.publicationInfo.publicationDate")).alias("year"),
        F.array_distinct(groups).alias("ancestries"), F.filter(F.split("s.cohort", r"\|"), lambda c: c != "").alias("cohorts"),
        F.lit(None).cast("string").alias("location"), discovery_n(F.col("s.ancestries")).alias("study_n"),
    )


def discovery_n(ancestries: Column) -> Column:
    """Individuals of the discovery stage; NULL if none is stated."""
    counts = F.filter(F.transform(F.filter(ancestries, lambda a: a["type"] == "initial"), lambda a: a["numberOfIndividuals"]), lambda n: n.isNotNull())
    return F.when(F.size(counts) > 0, F.aggregate(counts, F.lit(0).cast("bigint"), lambda x, y: x + y))


def sidecars(texts: DataFrame, text: str = "text") -> DataFrame:
    """Sidecar fields; sample numbers add up over the samples, 0 and nothing are NULL."""
    texts = spread(texts, "source_id")  # YAML takes long for its size
    s = F.from_json(parse_yaml(F.col(text)), _SIDECAR)
    total = lambda name: F.nullif(F.aggregate(F.transform("s.samples", lambda x: F.coalesce(as_int(x[name]), F.lit(0))), F.lit(0).cast("bigint"), lambda x, y: x + y), F.lit(0).cast("bigint"))
    return texts.select("source_id", s.alias("s")).select(
        "source_id", F.col("s").isNotNull().alias("readable"), F.col("s.gwas_id").alias("accession"), "s.trait_description", "s.genome_assembly", "s.file_type", "s.data_file_name", F.lower("s.data_file_md5sum").alias("md5"),
        as_flag(F.col("s.is_harmonised")).alias("is_harmonised"), as_flag(F.col("s.is_sorted")).alias("is_sorted"),
        total("sample_size").alias("sidecar_n"), total("case_count").alias("sidecar_cases"), total("control_count").alias("sidecar_controls"),
        F.try_element_at(F.filter(F.transform("s.samples", lambda x: as_flag(x["case_control_study"])), lambda x: x.isNotNull()), F.lit(1)).alias("case_control"),
        F.array_distinct(F.flatten(F.filter(F.transform("s.samples", lambda x: x["sample_ancestry_category"]), lambda x: x.isNotNull()))).alias("ancestries"),
    )


def ssf_status(file_type: Column) -> Column:
    """The declared status; what is declared otherwise stays as it is."""
    word = F.upper(F.trim(file_type))
    return F.when(F.startswith(word, F.lit("GWAS-SSF")), "GWAS-SSF").when(F.startswith(word, F.lit("PRE-GWAS-SSF")), "pre-GWAS-SSF").when(F.startswith(word, F.lit("NON-GWAS-SSF")), "Non-GWAS-SSF").otherwise(file_type)


def route_status(status: Column) -> Column:
    """What an answer of the withdrawn route means."""
    return F.when(status == 410, "deprecated").when(status == 404, "not_represented").when(status >= 500, "error").when(status == 200, "available").otherwise("unknown")


def record_fields(body: Column) -> Column:
    """Field names of a JSON record, without those that start with an underscore."""
    return F.filter(F.json_object_keys(body), lambda k: ~F.startswith(k, F.lit("_")))


def fields_cover(fields: Column) -> Column:
    """Whether declared fields are enough for a score: a variant, both alleles, an effect and a p-value."""
    any_of = lambda *names: F.arrays_overlap(fields, F.array(*map(F.lit, names)))
    place = any_of("chromosome") & any_of("base_pair_location", "position")
    return (any_of("variant_id", "rsid") | place) & any_of("effect_allele") & any_of("other_allele") & any_of("beta", "odds_ratio", "hazard_ratio") & any_of("p_value", "neg_log_10_p_value")


def association_fields(answers: DataFrame, body: str = "body") -> DataFrame:
    """``source_id, fields`` from the first record under any of the keys that routes use."""
    keys = ("$._embedded.associations[0]", "$._embedded.associations.0", "$.associations[0]", "$.data[0]", "$.results[0]")
    first = F.coalesce(*(F.get_json_object(body, k) for k in keys))
    return answers.select("source_id", record_fields(first).alias("fields"))
