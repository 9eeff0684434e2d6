"""Annotation text: splitting boxes into statements, classifying them, appearance strings, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SEE_PAGE

# SDTM domain codes, annotation types and the patterns of annotation statements.
DOMAINS = ("AE AG BE BS CE CM CO CP CV DA DD DM DS DV EC EG EX FA FT GF HO IE IS LB MB MH MI MK ML MS NV OE PC PE PP PR QS RE "
           "RELREC RP RS SC SE SR SS SU SV TA TD TE TI TM TR TS TU TV UR VS ZA").split()
TYPES = ["VARIABLE", "CONSTANT_ASSIGNMENT", "SUPP_QUALIFIER", "NOT_SUBMITTED", "DERIVATION_RULE", "CROSS_REFERENCE", "DOMAIN_HEADER", "NOTE"]
TOKEN = r"[A-Z][A-Z0-9]{1,7}"
QUALIFIED = rf"(?:([A-Z]{{2}})\.)?({TOKEN})"
NOT_SUBMITTED = r"(?i)^\W*not\s+submitted\W*$"
SUPP = r"(?i)\bSUPP(?:[A-Z]{2})?\b|\bQNAM\b"
SUPP_DOMAIN = r"(?i)SUPP([A-Z]{2})"
SUPP_VARIABLE = rf"(?i)SUPP[A-Z]{{2}}\.({TOKEN})"
QNAM = r"(?i)QNAM\s*=\s*[\"']?([A-Z][A-Z0-9_]*)[\"']?"
ASSIGNMENT = rf"^\s*{QUALIFIED}\s*=\s*(.+?)\s*$"
PURE_VARIABLE = rf"^\s*{QUALIFIED}\s*$"
VARIABLE_LIST = rf"^\s*{TOKEN}(?:\.{TOKEN})?(?:\s*[,/|]\s*|\s+){TOKEN}(?:\.{TOKEN})?.*$"
DERIVATION = (r"(?i)\b(deriv\w*|calculat\w*|comput\w*|concatenat\w*|imput\w*|assigned\s+by|populated\s+(?:from|by)|"
              r"mapped\s+(?:to|from)|if\b.*\bthen\b|not\s+collected)\b")
SEPARATOR = r"\s*[,/|]\s*|\s+"
STRUCTURAL, LIKELY, AMBIGUOUS, FALLBACK = 0.95, 0.8, 0.55, 0.3
APPEARANCE_FONT = r"/([^\s/]+)\s+([\d.]+)\s+Tf"
APPEARANCE_RGB = r"(?i)([\d.]+)\s+([\d.]+)\s+([\d.]+)\s+rg\b"
APPEARANCE_CMYK = r"(?i)([\d.]+)\s+([\d.]+)\s+([\d.]+)\s+([\d.]+)\s+k\b"
APPEARANCE_GRAY = r"(?:^|[^\d.])([\d.]+)\s+g\b"

#: Fields of a classified statement.
STATEMENT = "struct<annot_type:string,confidence:double,variable:string,domain:string,value:string,qnam:string,label:string,target_page:int,variables:array<string>,evidence:array<string>>"


def _found(text: Column, pattern: str, group: int) -> Column:
    """The group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _unquote(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(text), "^[\"']+|[\"']+$", ""))


def _evidence(*parts) -> Column:
    return F.array_compact(F.array(*(p if isinstance(p, Column) else F.lit(p) for p in parts)))


def _statement(kind, confidence, evidence: Column, **parsed) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    names = {"variable": "string", "domain": "string", "value": "string", "qnam": "string", "label": "string", "target_page": "int", "variables": "array<string>"}
    return F.struct(as_column(kind).alias("annot_type"), as_column(confidence).cast("double").alias("confidence"),
                    *(as_column(parsed.get(n)).cast(t).alias(n) for n, t in names.items()), evidence.alias("evidence"))


def classify(text: Column, first: Column | None = None) -> Column:
    """The type, confidence, parsed parts and evidence of one statement; most specific rule first.

    ``first`` tells whether it is the first annotation of its page (default: no).
    """
    first = F.coalesce(first, F.lit(False)) if first is not None else F.lit(False)
    t = F.trim(F.coalesce(text, F.lit("")))
    page = _found(t, SEE_PAGE, 1)

    supp_domain, qnam = F.upper(_found(t, SUPP_DOMAIN, 1)), F.upper(_found(t, QNAM, 1))
    lead = _found(F.trim(F.element_at(F.split(t, " when "), 1)), PURE_VARIABLE, 2)
    supp_variable = F.coalesce(lead, F.upper(_found(t, SUPP_VARIABLE, 1)))
    supp = _statement("SUPP_QUALIFIER", F.when(qnam.isNotNull(), STRUCTURAL).otherwise(LIKELY),
                      _evidence("names a supplemental qualifier", F.concat(F.lit("supplemental domain "), supp_domain), F.concat(F.lit("qualifier "), qnam), F.concat(F.lit("its variable "), supp_variable)),
                      domain=supp_domain, qnam=qnam, variable=supp_variable)

    owner, left, right = _found(t, ASSIGNMENT, 1), _found(t, ASSIGNMENT, 2), F.trim(_found(t, ASSIGNMENT, 3))
    known = left.isin(DOMAINS)
    code_note = F.concat(left, F.lit(" before the sign"), F.when(known, ", a known domain").otherwise(""))
    name = _statement("DOMAIN_HEADER", F.when(known, STRUCTURAL).otherwise(LIKELY), _evidence(code_note, "a name after it"), domain=left, label=right)
    topmost = _statement("DOMAIN_HEADER", AMBIGUOUS, _evidence(code_note, "capitals after it in the first annotation of the page"), domain=left, label=right)
    code = _statement("CONSTANT_ASSIGNMENT", F.when(known, AMBIGUOUS).otherwise(LIKELY), _evidence(code_note, "a code after it in a later annotation"), variable=left, value=_unquote(right))
    qualified = _statement("CONSTANT_ASSIGNMENT", STRUCTURAL, _evidence(F.concat(owner, F.lit("."), left, F.lit(" set to a constant"))), domain=owner, variable=left, value=_unquote(right))
    constant = _statement("CONSTANT_ASSIGNMENT", STRUCTURAL, _evidence(F.concat(left, F.lit(" set to "), right)), variable=left, value=_unquote(right))
    assignment = (F.when(owner.isNotNull(), qualified).when(F.length(left) != 2, constant)
                  .when(right.rlike("[a-z]") | right.contains(" "), name).when(known & first, topmost).otherwise(code))

    wording = _found(t, DERIVATION, 1)
    derivation = _statement("DERIVATION_RULE", LIKELY, _evidence(F.concat(F.lit("speaks of a derivation: "), wording)),
                            variables=F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(rf"\b({TOKEN})\b"), 1))))
    own, bare = _found(t, PURE_VARIABLE, 1), _found(t, PURE_VARIABLE, 2)
    variable = _statement("VARIABLE", F.when(own.isNotNull(), STRUCTURAL).otherwise(LIKELY),
                          _evidence(F.concat(F.lit("a variable alone: "), bare), F.concat(F.lit("of domain "), own)), variable=bare, domain=own)
    return (F.when(t.rlike(NOT_SUBMITTED), _statement("NOT_SUBMITTED", STRUCTURAL, _evidence("says that nothing is submitted")))
            .when(page.isNotNull(), _statement("CROSS_REFERENCE", STRUCTURAL, _evidence(F.concat(F.lit("points to page "), page)), target_page=page.try_cast("int")))
            .when(t.rlike(SUPP), supp).when(left.isNotNull(), assignment).when(wording.isNotNull(), derivation).when(bare.isNotNull(), variable)
            .otherwise(_statement("NOTE", FALLBACK, _evidence("plain text"))))


def statements(text: Column) -> Column:
    """The statements that one box holds: a pure list of variables splits, all else stays whole."""
    t = F.trim(F.coalesce(text, F.lit("")))
    parts = F.filter(F.split(t, SEPARATOR), lambda x: x != "")
    lists = ~t.contains("=") & t.rlike(VARIABLE_LIST) & F.forall(parts, lambda x: x.rlike(PURE_VARIABLE))
    return F.when(t == "", F.array().cast("array<string>")).when(lists, parts).otherwise(F.array(t))


def parse_appearance(appearance: Column) -> Column:
    """Struct of ``text_color`` (RGB of 3 digits, or null), ``font_name`` and ``font_size`` (0 is kept)."""
    a = F.coalesce(appearance, F.lit(""))
    number = lambda p, g: _found(a, p, g).try_cast("double")
    rgb = F.array(*(F.bround(number(APPEARANCE_RGB, g), 3) for g in (1, 2, 3)))
    cmyk = F.array(*(F.bround((1 - number(APPEARANCE_CMYK, g)) * (1 - number(APPEARANCE_CMYK, 4)), 3) for g in (1, 2, 3)))
    gray = F.array(*[F.bround(number(APPEARANCE_GRAY, 1), 3)] * 3)
    color = F.when(_found(a, APPEARANCE_RGB, 1).isNotNull(), rgb).when(_found(a, APPEARANCE_CMYK, 1).isNotNull(), cmyk).when(_found(a, APPEARANCE_GRAY, 1).isNotNull(), gray)
    return F.struct(color.alias("text_color"), F.regexp_extract(a, APPEARANCE_FONT, 1).alias("font_name"),
                    F.coalesce(F.bround(number(APPEARANCE_FONT, 2), 2), F.lit(0.0)).alias("font_size"))


def to_hex(color: Column) -> Column:
    """``#RRGGBB`` of RGB fractions; "" without a colour."""
    byte = lambda c: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.bround(c * 255).cast("int")))), 2, "0")
    return F.when(color.isNull() | (F.size(color) < 3), "").otherwise(F.concat(F.lit("#"), *(byte(F.element_at(color, i)) for i in (1, 2, 3))))


def from_hex(text: Column) -> Column:
    """RGB fractions of 3 digits, or null if it is no colour."""
    digits = _found(F.trim(text), r"^#?([0-9A-Fa-f]{6})$", 1)
    return F.when(digits.isNotNull(), F.array(*(F.bround(F.conv(F.substring(digits, i, 2), 16, 10).cast("double") / 255, 3) for i in (1, 3, 5))))


def foreign_domain(variable: Column, domain: Column) -> Column:
    """The other domain that a variable's prefix names, or ""."""
    variable, domain = F.coalesce(variable, F.lit("")), F.coalesce(domain, F.lit(""))
    prefix = F.substring(variable, 1, 2)
    foreign = (variable != "") & (domain != "") & ~variable.startswith(domain) & prefix.isin(DOMAINS) & F.substring(variable, 3, 100).rlike(r"^[A-Z][A-Z0-9]{2,}$")
    return F.when(foreign, prefix).otherwise("")
