"""Population terms, categories and how well a study fits a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The catalogue's categories and the terms that mean them.
CATEGORIES = {
    "European": ["european", "eur", "caucasian", "white", "ceu", "eu"],
    "East Asian": ["east asian", "eas", "chinese", "japanese", "korean", "han", "asian east"],
    "South Asian": ["south asian", "sas", "indian", "pakistani", "bangladeshi", "sri lankan"],
    "South East Asian": ["south east asian", "southeast asian", "sea", "malay", "thai", "filipino"],
    "African unspecified": ["african", "afr", "african unspecified"],
    "Sub-Saharan African": ["sub-saharan african", "sub saharan african", "west african", "yoruba"],
    "African American or Afro-Caribbean": ["african american", "afro-caribbean", "afro caribbean", "black american", "aa"],
    "Hispanic or Latin American": ["hispanic", "latino", "latin american", "latina", "amr", "admixed american"],
    "Greater Middle Eastern (Middle Eastern, North African or Persian)": ["middle eastern", "north african", "persian", "iranian", "arab", "gme"],
    "Oceanian": ["oceanian", "polynesian", "melanesian", "maori", "pacific islander"],
    "Native American": ["native american", "american indian", "amerindian", "indigenous american"],
    "Aboriginal Australian": ["aboriginal australian", "aboriginal", "australian aboriginal"],
    "Other admixed ancestry": ["admixed", "mixed", "multi-ancestry", "multiancestry", "trans-ethnic"],
    "Other": ["other"],
    "NR": ["nr", "not reported", "unspecified", "unknown"],
}
UNREPORTED = "NR"


def terms() -> dict[str, str]:
    """Each term and each category's own name, with its category."""
    out = {t: c for c, ts in CATEGORIES.items() for t in ts}
    return out | {c.lower(): c for c in CATEGORIES}


def normalised(text: Column) -> Column:
    """The category of a text: of the term that it is, else of the longest term within it
    (of equally long ones the first of the table)."""
    word = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    known = terms()
    out = None
    for term in sorted(known, key=len, reverse=True):  # stable: the table's order among equals
        test = F.contains(word, F.lit(term))
        out = F.when(test, F.lit(known[term])) if out is None else out.when(test, F.lit(known[term]))
    exact = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.coalesce(F.try_element_at(exact, word), out)


def match_score(requested: Column, groups: Column) -> Column:
    """A struct (score, reason): 1 alone, 0.75 among other reported categories, 0.6 where a request
    outside the vocabulary stands in a group's text, 0.4 where nothing is reported, 0 for a mismatch."""
    want, needle = normalised(requested), F.lower(F.trim(requested))
    given = F.filter(F.coalesce(groups, F.array().cast("array<string>")), lambda g: g.isNotNull() & (g != ""))
    have = F.filter(F.transform(given, normalised), lambda x: x.isNotNull())
    reported = F.array_distinct(F.array_remove(have, UNREPORTED))
    made = lambda score, reason: F.struct(F.lit(score).alias("score"), F.lit(reason).alias("reason"))
    return (
        F.when(requested.isNull() | (requested == ""), made(1.0, "any"))
        .when(F.size(given) == 0, made(0.4, "unreported"))
        .when(want.isNull(), F.when(F.exists(given, lambda g: F.contains(F.lower(g), needle)), made(0.6, "text")).otherwise(made(0.0, "unknown population")))
        .when(F.array_contains(have, want), F.when(F.size(reported) > 1, made(0.75, "among others")).otherwise(made(1.0, "exact")))
        .when((F.size(have) > 0) & (F.size(reported) == 0), made(0.4, "unreported"))
        .otherwise(made(0.0, "different"))
    )


def population_filter(studies: DataFrame, requested: str, groups: str = "ancestries") -> DataFrame:
    """Studies with a score above 0, which keeps those that report nothing."""
    return studies.withColumn("match", match_score(F.lit(requested), F.col(groups))).filter("match.score > 0")


def summary(groups: Column) -> Column:
    """Distinct categories in order (a group's own text where it has none); of more than two, the
    first and how many more; ``unknown`` where there is none."""
    named = F.transform(F.coalesce(groups, F.array().cast("array<string>")), lambda g: F.coalesce(normalised(g), g))
    kept = F.array_distinct(F.filter(named, lambda g: g.isNotNull() & (g != "")))
    several = F.when(F.size(kept) > 2, F.concat(F.element_at(kept, 1), F.lit(" +"), (F.size(kept) - 1).cast("string"), F.lit(" more")))
    return F.when(F.size(kept) == 0, F.lit("unknown")).otherwise(several.otherwise(F.array_join(kept, ", ")))
