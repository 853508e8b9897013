"""Prompt templates as native string expressions.

Fixed values: the texts below must equal the reference's prompts exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (exact prompt texts) ------------------------------------
TOPIC_NO_COMPANY = ("Topic %% Customer: {text}.\nEND MESSAGE\n"
                    "Choose one topic that matches customer's issue.\n{prompt}\nClass name: ")
TOPIC_COMPANY = ("Topic %% Company name: {company_name} is doing: {company_specific}\n"
                 "Customer: {text}.\nEND MESSAGE\n"
                 "Choose one topic that matches customer's issue.\n{prompt}\nClass name: ")
COMPANY_DESCRIPTIONS = {
    "Pizza Mia": "This company is a pizzeria place.",
    "Online Banking": "This company is an online banking.",
}
ENTITY_PROMPT = "Extraction %% Customer: {text}"
PAIR_PROMPT = ("\n        Same customer intent? %% First customer: @@ Second customer: $$ END. "
               "\nOPTIONS: 1. yes, 2. no. Class name:\n    ")
COMPANY_OPTIONS_BLOCK = "\n        OPTIONS:\n        {options}\n    "
JSON_REQUEST_PROMPT = ("You are an expert in customer service domain. You need to classify a "
                       "customer message into one of the following classes: {options} % "
                       "Customer message: {txt} % Please return json object with the following "
                       "structure: {{class_name: }} class name should not contain a number. ")
# ----------------------------------------------------------------------------


def _c(col) -> Column:
    if col is None:
        return F.lit("")
    return F.col(col) if isinstance(col, str) else col


def _render(template: str, **parts: Column) -> Column:
    """Render a ``{name}`` template as ``concat`` of literals and columns."""
    import string

    pieces = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if field is not None:
            pieces.append(parts[field])
    return F.concat(*pieces)


def build_prompt(text, options, company_name=None, company_specific=None,
                 no_company_specific: bool = False) -> Column:
    """Classification prompt.  With a company, the exact names listed in
    ``COMPANY_DESCRIPTIONS`` override ``company_specific``."""
    if no_company_specific:
        return _render(TOPIC_NO_COMPANY, text=_c(text), prompt=_c(options))
    name = _c(company_name)
    spec = F.lit("")
    if company_specific is not None:
        spec = company_specific if not isinstance(company_specific, str) else F.lit(company_specific)
    for k, v in COMPANY_DESCRIPTIONS.items():
        spec = F.when(name == k, F.lit(v)).otherwise(spec)
    return _render(TOPIC_COMPANY, company_name=name, company_specific=spec,
                   text=_c(text), prompt=_c(options))


def entity_prompt(text) -> Column:
    return _render(ENTITY_PROMPT, text=_c(text))


def pair_prompt(first, second) -> Column:
    """Same-intent question for two texts (``@@`` then ``$$`` replaced)."""
    a, b = PAIR_PROMPT.split("@@")
    b1, b2 = b.split("$$")
    return F.concat(F.lit(a), _c(first), F.lit(b1), _c(second), F.lit(b2))


def company_options_block(options) -> Column:
    return _render(COMPANY_OPTIONS_BLOCK, options=_c(options))


def json_request_prompt(options, text) -> Column:
    return _render(JSON_REQUEST_PROMPT, options=_c(options), txt=_c(text))
