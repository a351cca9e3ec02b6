"""Categories of personal data, their groups, and named sets of categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups in their order, and each category's group.
GROUPS = ["identity", "contact", "economic", "health", "proceedings", "organisations", "other"]
CATEGORIES = {
    "identity": ["person", "es_national_id", "passport", "birth_or_age", "sex"],
    "contact": ["address", "phone", "email", "place_or_postcode"],
    "economic": ["iban", "payment_card", "es_company_tax_id", "uk_nino", "us_ssn_itin"],
    "health": ["es_health_card", "medical_record", "es_social_security", "uk_nhs", "clinician", "professional_reg", "health_centre", "department"],
    "proceedings": ["case_reference", "land_registry", "plate"],
    "organisations": ["organisation", "logo"],
    "other": ["date", "custom_term"],
}
GROUP_OF = {c: g for g, cs in CATEGORIES.items() for c in cs}
#: Identifiers by which other systems know the categories, in the order of CATEGORIES.
ALIASES = dict(
    zip(
        "persona dni_nie pasaporte fecha_nacimiento sexo direccion telefono email localidad iban tarjeta cif nino ssn cip nhc nuss nhs sanitario colegiado centro servicio_unidad expediente catastro matricula organizacion logo fecha personalizada".split(),
        GROUP_OF,
    )
)
#: Named sets of categories; "everything" has all of them.
PROFILES = {
    "everything": list(GROUP_OF),
    "clinical": (
        "person es_national_id passport birth_or_age address phone email place_or_postcode iban payment_card us_ssn_itin es_health_card medical_record "
        "es_social_security uk_nhs date custom_term"
    ).split(),
    "publication": (
        "person es_national_id passport birth_or_age address phone email place_or_postcode iban payment_card us_ssn_itin es_health_card medical_record "
        "es_social_security uk_nhs clinician professional_reg health_centre department organisation logo date custom_term"
    ).split(),
    "teaching": (
        "person es_national_id passport birth_or_age address phone email place_or_postcode iban payment_card us_ssn_itin es_health_card medical_record "
        "es_social_security uk_nhs clinician professional_reg health_centre organisation logo date custom_term"
    ).split(),
    "legal": (
        "person es_national_id passport birth_or_age address phone email place_or_postcode iban payment_card es_company_tax_id uk_nino us_ssn_itin "
        "case_reference land_registry plate organisation logo date custom_term"
    ).split(),
    "company": (
        "person es_national_id passport birth_or_age address phone email place_or_postcode iban payment_card es_company_tax_id uk_nino us_ssn_itin "
        "es_social_security case_reference plate organisation logo custom_term"
    ).split(),
    "invoices": (
        "person es_national_id passport birth_or_age address phone email place_or_postcode iban payment_card es_company_tax_id uk_nino us_ssn_itin "
        "case_reference organisation logo custom_term"
    ).split(),
    "personal": (
        "person es_national_id passport birth_or_age address phone email place_or_postcode iban payment_card uk_nino us_ssn_itin es_social_security uk_nhs "
        "case_reference land_registry plate custom_term"
    ).split(),
}


def catalog(spark: SparkSession) -> DataFrame:
    """(category, category_group, group_order, position): the catalog as a table."""
    rows = [(c, g, GROUPS.index(g), i) for i, (c, g) in enumerate(GROUP_OF.items())]
    return spark.createDataFrame(rows, "category string, category_group string, group_order int, position int")


def matching_profile(active: DataFrame, key: str, category: str = "category") -> DataFrame:
    """(key, profile): the named set that equals each key's set of categories; null if none does."""
    spark = active.sparkSession
    named = spark.createDataFrame([(p, sorted(cs)) for p, cs in PROFILES.items()], "profile string, categories array<string>")
    sets = active.groupBy(key).agg(F.array_sort(F.collect_set(category)).alias("categories"))
    return sets.join(F.broadcast(named), "categories", "left").select(key, "profile")
