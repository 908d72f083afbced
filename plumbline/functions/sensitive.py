"""Sensitive attributes recognised by column name."""

from __future__ import annotations

import re

# Words in a column name that mark a sensitive attribute, by kind.
SENSITIVE_KEYWORDS = {
    "age": ["age", "years_old", "current_age", "age_years"],
    "gender": ["gender", "sex"],
    "race_ethnicity": ["race", "ethnicity", "ethnic_group"],
    "national_origin": [
        "nationality", "citizenship", "country_of_origin", "birth_country",
        "home_country", "passport_country", "native",
    ],
    "religion": ["religion", "faith", "religious_affiliation"],
    "disability": ["disability", "handicap", "impairment"],
    "sexual_orientation": ["sexual_orientation", "orientation"],
    "marital_status": ["marital_status", "married", "marital"],
    "pregnancy": ["pregnancy", "pregnant", "gestation", "maternal_status"],
    "socioeconomic": [
        "income", "salary", "wage", "employment_status", "occupation",
        "education_level", "credit_score",
    ],
}


def sensitive_kind(name: str, match: str = "substring") -> str | None:
    """Kind of sensitive attribute a column name points to, or None.

    ``match="substring"`` finds keywords anywhere in the lower-cased name, so ``wage``
    counts as ``age``; ``match="token"`` asks for whole words between separators.
    """
    low = name.lower()
    if match == "token":
        low = "_" + re.sub(r"[^a-z0-9]+", "_", low) + "_"
    for kind, words in SENSITIVE_KEYWORDS.items():
        for word in words:
            if (f"_{word}_" if match == "token" else word) in low:
                return kind
    return None
