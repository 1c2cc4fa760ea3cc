"""Request texts, response parsing, choice parsing and label flags."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts and terms that results depend on.
SYSTEM_TEXT = "You are a social science researcher."
REQUEST_UNPROMPTED = """A survey asks respondents: "{question}"

You want to predict how a respondent will answer. What information about the respondent would you need?

Output a JSON list where each item describes one piece of information you would want to know. Each item should have:
- "feature": a short label for the information (e.g., "a specific attitude or behaviour")
- "reasoning": one sentence on why this would help predict the answer

Output ONLY the JSON list, no other text."""
REQUEST_COUNTRY = """A survey asks respondents in {country}: "{question}"

You want to predict how a respondent in {country} will answer. What information about the respondent would you need?

Output a JSON list where each item describes one piece of information you would want to know. Each item should have:
- "feature": a short label for the information (e.g., "a specific attitude or behaviour")
- "reasoning": one sentence on why this would help predict the answer

Output ONLY the JSON list, no other text."""
CHOICE_REQUEST = """You are helping map abstract feature descriptions to concrete survey questions.

A researcher said they would want to know a respondent's:
"{feature_label}"
Reasoning: "{feature_reasoning}"

Below are candidate survey questions that might capture this information. Pick the ONE question that best matches what the researcher is asking for, or respond "none" if no question is a good match.

Candidates:
{candidates_block}

Respond with ONLY the letter (A, B, C, ...) of the best match, or "none". No explanation."""
FENCE_START = r"^```(?:json)?\s*"
FENCE_END = r"\s*```$"
DEMOGRAPHIC_TERMS = [
    "age", "gender", "sex", "education", "educational",
    "income", "household income", "socioeconomic", "ses",
    "employment", "occupation", "marital", "marriage",
    "race", "ethnic", "ethnicity", "religion", "religious affiliation",
    "urban", "rural", "region", "geographic", "country", "nationality",
    "class", "social class",
]
UNPROMPTED, COUNTRY_PROVIDED = "unprompted", "country_provided"

# A letter or digit of any script next to a letter makes it part of a word.
APART = r"[^\p{L}\p{M}\p{N}_]"
FEATURE_LIST = "array<struct<feature:string,reasoning:string>>"


def fill(template: str, **values: Column) -> Column:
    """Fill ``{name}`` places with columns; inserted text is never re-read."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


def strip(x: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.btrim(x, F.lit(" \t\n\r\f\v"))


def first_text(*options: Column) -> Column:
    """First option that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options])


def request_text(question: Column, country: Column) -> Column:
    """Request for one target; an empty country counts as none."""
    return F.when(has_text(country), fill(REQUEST_COUNTRY, question=question, country=country)) \
        .otherwise(fill(REQUEST_UNPROMPTED, question=question))


def has_text(x: Column) -> Column:
    return x.isNotNull() & (x != "")


def request_condition(country: Column) -> Column:
    return F.when(has_text(country), COUNTRY_PROVIDED).otherwise(UNPROMPTED)


def strip_fence(raw: Column) -> Column:
    """Trim, then drop one leading and one trailing code fence."""
    return F.regexp_replace(F.regexp_replace(strip(raw), FENCE_START, ""), FENCE_END, "")


def parse_feature_list(raw: Column) -> Column:
    """Response text to feature structs; NULL unless it is one JSON list.

    The JSON reader stops after the first value, so the text is read twice, inside
    an object and as the only element of a list: nothing can follow the list in both.
    """
    return parse_list_body(strip(strip_fence(raw)))


def parse_list_body(body: Column) -> Column:
    """``parse_feature_list`` for text whose fence and outer space are gone."""
    strict = {"allowSingleQuotes": "false"}
    whole = F.startswith(body, F.lit("[")) & F.endswith(body, F.lit("]"))
    field = F.from_json(F.concat(F.lit('{"r": '), body, F.lit("}")), f"struct<r:{FEATURE_LIST}>", strict)
    only = F.from_json(F.concat(F.lit("["), body, F.lit("]")), f"array<{FEATURE_LIST}>", strict)
    # inside an array of one, so that ``only`` is read once and not per use
    single = F.get(F.transform(F.array(only), lambda o: (F.size(o) == 1) & F.get(o, F.lit(0)).isNotNull()), F.lit(0))
    return F.when(whole & single, field["r"])


def combined_text(label: Column, reasoning: Column) -> Column:
    """``label: reasoning``, or the label alone."""
    return F.when(has_text(reasoning), F.concat(F.coalesce(label, F.lit("")), F.lit(": "), reasoning)) \
        .otherwise(F.coalesce(label, F.lit("")))


def candidate_block(candidates: Column) -> Column:
    """Lettered lines ``A. [code] text``."""
    lines = F.transform(candidates, lambda c, i: F.concat(
        F.char((i + 65).cast("bigint")), F.lit(". ["), c["var_code"], F.lit("] "),
        F.coalesce(c["question_text"], F.lit(""))))
    return F.array_join(lines, "\n")


def choice_request(label: Column, reasoning: Column, candidates: Column) -> Column:
    return fill(CHOICE_REQUEST, feature_label=F.coalesce(label, F.lit("")),
                feature_reasoning=F.coalesce(reasoning, F.lit("")), candidates_block=candidate_block(candidates))


def parse_choice(raw: Column, n_candidates: Column, legacy: bool = False) -> Column:
    """Answer text to a 0-based candidate index, NULL for "none" or no match.

    Strict: the first letter of a candidate that stands alone; other letters, such
    as "I" in a sentence with five candidates, are passed over, and so is the "A" of "Ah\u00e9" or "\u00e9a". Legacy: the
    alphabetically first candidate letter that occurs anywhere, even inside a word.
    """
    text = F.upper(strip(raw))
    if legacy:
        index = F.get(F.filter(F.sequence(F.lit(0), F.lit(25)), lambda i: (
            (i < n_candidates) & F.contains(text, F.char((i + 65).cast("bigint"))))), F.lit(0))
    else:
        letters = F.regexp_extract_all(text, F.lit(rf"(?:^|{APART})([A-Z])(?={APART}|$)"), F.lit(1))
        index = F.get(F.filter(F.transform(letters, lambda c: F.ascii(c) - 65), lambda i: i < n_candidates), F.lit(0))
    return F.when(~F.contains(text, F.lit("NONE")), index)


def is_demographic(label: Column, whole_word: bool = False) -> Column:
    """Does the label name a demographic trait?

    By default any occurrence counts, so "language" matches "age".
    """
    low = F.lower(F.coalesce(label, F.lit("")))
    if whole_word:
        return low.rlike(r"\b(" + "|".join(DEMOGRAPHIC_TERMS) + r")\b")
    found = F.contains(low, F.lit(DEMOGRAPHIC_TERMS[0]))
    for term in DEMOGRAPHIC_TERMS[1:]:
        found = found | F.contains(low, F.lit(term))
    return found
