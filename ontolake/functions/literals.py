"""Lexical rules of datatypes as SQL expressions for Spark and DuckDB, and the same rules in Python for single values.

A literal is valid, invalid, or unverified where its datatype is unknown; the third outcome is kept apart throughout.
"""

from __future__ import annotations

from ..model import DATATYPES, OWL, RDF, RDFS, XSD


class Dialect:
    """How the two engines write what differs."""

    def __init__(self, spark: bool) -> None:
        self.spark = spark

    def match(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE r'{pattern}')" if self.spark else f"regexp_matches({x}, '{pattern}')"

    def extract(self, x: str, pattern: str, group: int) -> str:
        return f"regexp_extract({x}, r'{pattern}', {group})" if self.spark else f"regexp_extract({x}, '{pattern}', {group})"

    def replace(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, r'{pattern}', '{to}')" if self.spark else f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


SPARK, DUCKDB = Dialect(True), Dialect(False)

_NAME_START = r":A-Z_a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2FF}\x{370}-\x{37D}\x{37F}-\x{1FFF}\x{200C}-\x{200D}\x{2070}-\x{218F}\x{2C00}-\x{2FEF}\x{3001}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFFD}\x{10000}-\x{EFFFF}"
_NAME_MORE = r"\-.0-9\x{B7}\x{300}-\x{36F}\x{203F}-\x{2040}"
_NC_START = _NAME_START[1:]
NAME = rf"^[{_NAME_START}][{_NAME_START}{_NAME_MORE}]*$"
NCNAME = rf"^[{_NC_START}][{_NC_START}{_NAME_MORE}]*$"
NMTOKEN = rf"^[{_NAME_START}{_NAME_MORE}]+$"
#: The longest NCName at the end of an IRI.
NCNAME_SUFFIX = rf"[{_NC_START}][{_NC_START}{_NAME_MORE}]*$"
XML_CHARS = r"^[\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]*$"
LANGUAGE = (
    r"^(?i:(?:[a-z]{2,3}(?:-[a-z]{3}(?:-[a-z]{3}){0,2})?|[a-z]{4}|[a-z]{5,8})(?:-[a-z]{4})?(?:-(?:[a-z]{2}|[0-9]{3}))?(?:-(?:[a-z0-9]{5,8}|[0-9][a-z0-9]{3}))*(?:-[0-9a-wy-z](?:-[a-z0-9]{2,8})+)*(?:-x(?:-[a-z0-9]{1,8})+)?"
    r"|x(?:-[a-z0-9]{1,8})+|i-(?:ami|bnn|default|enochian|hak|klingon|lux|mingo|navajo|pwn|tao|tay|tsu)|en-gb-oed|sgn-(?:be-fr|be-nl|ch-de)|art-lojban|cel-gaulish|no-(?:bok|nyn)|zh-(?:guoyu|hakka|min|min-nan|xiang))$"
)
XSD_LANGUAGE = r"^[a-zA-Z]{1,8}(?:-[a-zA-Z0-9]{1,8})*$"
INTEGER = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)$"
FLOAT = r"^(?:[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?INF|NaN)$"
BOOLEAN = r"^(?:true|false|0|1)$"
RATIONAL = r"^[+-]?[0-9]+ */ *0*[1-9][0-9]*$"
HEX = r"^(?:[0-9a-fA-F]{2})*$"
BASE64 = r"^(?:(?:[A-Za-z0-9+/] ?){4})*(?:(?:[A-Za-z0-9+/] ?){3}[A-Za-z0-9+/]|(?:[A-Za-z0-9+/] ?){2}[AEIMQUYcgkosw048] ?=|[A-Za-z0-9+/] ?[AQgw] ?= ?=)?$"
NORMALIZED = r"^[^\t\n\r]*$"
TOKEN = r"^(?:[^\t\n\r ]+(?: [^\t\n\r ]+)*)?$"
DATETIME = r"^(-?(?:[1-9][0-9]{3,}|0[0-9]{3}))-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T(?:(?:([01][0-9]|2[0-3])):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?|24:00:00(?:\.0+)?)(Z|[+-](?:0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?$"
PLAIN = r"^(?s:.*)@([A-Za-z0-9-]*)$"
ANY_URI = r"^[^\x{0}-\x{20}<>\x{22}{}|\\^`]*$"
ABSOLUTE_IRI = r"^[A-Za-z][A-Za-z0-9+.-]*:[^\x{0}-\x{20}<>\x{22}{}|\\^`]*$"

_SIMPLE = {"decimal": DECIMAL, "float": FLOAT, "double": FLOAT, "boolean": BOOLEAN, "string": XML_CHARS, "normalizedString": NORMALIZED, "token": TOKEN, "language": XSD_LANGUAGE, "Name": NAME, "NCName": NCNAME, "NMTOKEN": NMTOKEN, "hexBinary": HEX, "base64Binary": BASE64, "anyURI": ANY_URI}


_INTEGERS = [t for t in DATATYPES if t.iri.startswith(XSD) and t.facets == "order" and (t.iri == XSD + "integer" or t.low is not None or t.high is not None)]


def integer_in_bounds(d: Dialect, x: str, datatype: str) -> str:
    """Is an integer text within the bounds of its datatype: by its sign where it is long, else by its value, so that any
    number of digits will do. An absent bound is NULL and holds."""
    plain = d.replace(d.replace(x, r"^[+]", ""), r"^(-?)0+([0-9])", r"$1$2" if d.spark else r"\1\2")
    low, high = (f"(CASE {datatype} " + " ".join(f"WHEN '{t.iri}' THEN CAST('{b}' AS DECIMAL(38,0))" for t in _INTEGERS if (b := getattr(t, side)) is not None) + " END)" for side in ("low", "high"))
    value = f"CAST(CASE WHEN length({plain}) > 30 THEN CASE WHEN {d.match(plain, '^-')} THEN '-' ELSE '' END || '999999999999999999999999999999' ELSE {plain} END AS DECIMAL(38,0))"
    return f"COALESCE({value} BETWEEN COALESCE({low}, CAST('-9999999999999999999999999999999' AS DECIMAL(38,0))) AND COALESCE({high}, CAST('9999999999999999999999999999999' AS DECIMAL(38,0))), FALSE)"


def date_time(d: Dialect, x: str, datatype: str) -> str:
    """Pattern, days of the month, leap years by the last four digits of the year, and the time zone where one is asked."""
    year, month, day = (f"CAST({d.extract(x, DATETIME, g)} AS {t})" for g, t in ((1, "DECIMAL(38,0)"), (2, "INT"), (3, "INT")))
    leap = f"(({year} % 4 = 0 AND {year} % 100 <> 0) OR {year} % 400 = 0)"
    days = f"(CASE WHEN {month} IN (4, 6, 9, 11) THEN 30 WHEN {month} = 2 THEN CASE WHEN {leap} THEN 29 ELSE 28 END ELSE 31 END)"
    zoned = f"({datatype} = '{XSD}dateTime' OR {d.extract(x, DATETIME, 5)} <> '')"
    return f"CASE WHEN {d.match(x, DATETIME)} THEN {day} <= {days} AND {zoned} ELSE FALSE END"


def status(d: Dialect, lexical: str = "lexical", lang: str = "lang", datatype: str = "datatype_iri") -> str:
    """'valid', 'invalid' or 'unverified' of a literal."""
    whens = [f"WHEN {lang} <> '' THEN {d.match(lang, LANGUAGE)} AND {d.match(lexical, XML_CHARS)}"]
    names = ", ".join(f"'{t.iri}'" for t in _INTEGERS)
    whens.append(f"WHEN {datatype} IN ({names}) THEN CASE WHEN {d.match(lexical, INTEGER)} THEN {integer_in_bounds(d, lexical, datatype)} ELSE FALSE END")
    whens.append(f"WHEN {datatype} IN ('{XSD}dateTime', '{XSD}dateTimeStamp') THEN {date_time(d, lexical, datatype)}")
    for t in DATATYPES:
        name = t.iri.rsplit("#", 1)[1]
        if t in _INTEGERS or name in ("dateTime", "dateTimeStamp"):
            continue
        if t.iri == OWL + "rational":
            rule = d.match(lexical, RATIONAL)
        elif t.iri == RDF + "PlainLiteral":
            tag = d.extract(lexical, PLAIN, 1)
            rule = f"CASE WHEN {d.match(lexical, PLAIN)} THEN {tag} = '' OR {d.match(tag, LANGUAGE)} ELSE FALSE END"
        elif t.iri in (OWL + "real", RDFS + "Literal", RDF + "langString"):
            rule = "FALSE"
        elif t.iri == RDF + "XMLLiteral":
            rule = "NULL"
        else:
            rule = d.match(lexical, _SIMPLE[name])
        whens.append(f"WHEN {datatype} = '{t.iri}' THEN {rule}")
    return f"CASE (CASE {' '.join(whens)} END) WHEN TRUE THEN 'valid' WHEN FALSE THEN 'invalid' ELSE 'unverified' END"


def short_form(d: Dialect, iri: str) -> str:
    """The longest NCName at the end of an IRI, else the IRI in angle brackets."""
    found = d.extract(iri, f"({NCNAME_SUFFIX})", 1)
    return f"CASE WHEN {found} <> '' THEN {found} ELSE '<' || {iri} || '>' END"


def media_type(x: str) -> str:
    """A media type without its parameters."""
    return f"lower(trim(split_part({x}, ';', 1)))"


def file_extension(d: Dialect, x: str) -> str:
    return f"lower({d.extract(x, r'(\.[^./\\]+)$', 1)})"


def java_trim(d: Dialect, x: str) -> str:
    """Code points up to the blank cut off both ends."""
    return d.replace(d.replace(x, r"^[\x{0}-\x{20}]+", ""), r"[\x{0}-\x{20}]+$", "")


def normal_cardinality(d: Dialect, x: str) -> str:
    return d.replace(x, r"^0+([0-9])", r"$1" if d.spark else r"\1")


def escaped(x: str) -> str:
    """A literal's text with quotes and backslashes escaped."""
    return f"replace(replace({x}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34))"


def xml_literal_valid(text: str) -> bool:
    """Is a text well-formed XML content in its canonical form: it equals what canonicalisation makes of it."""
    import xml.etree.ElementTree as ET

    try:
        canonical = ET.canonicalize(f"<x>{text}</x>", with_comments=True)
    except (ET.ParseError, ValueError):
        return False
    return canonical == f"<x>{text}</x>"


def xml_literals(df, lexical: str = "lexical"):
    """df with `valid` of each XML literal, in Arrow batches; for the few rows of that datatype."""
    from pyspark.sql import functions as F

    @F.pandas_udf("boolean")
    def valid(texts):
        return texts.map(lambda t: None if t is None else xml_literal_valid(t))

    return df.withColumn("valid", valid(lexical))
