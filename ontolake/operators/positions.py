"""Rules over single expressions: class positions and facets."""

from __future__ import annotations

import re

from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import literals as lit
from ..model import DATATYPES, KIND, OWL, RDF, THING, XSD, Obj

_OF = {d.iri: d for d in DATATYPES}


def allowed(c: Obj, place: str, profile: str) -> bool:
    """May a class expression stand in a place (sub, super, equiv) of a profile (QL, RL)."""
    k, f = KIND[c.kind].keyword, c.fields
    if profile == "QL":
        if k == "Class":
            return True
        if place == "sub":
            return k == "ObjectSomeValuesFrom" and f[1].iri == THING or k == "DataSomeValuesFrom"
        return (
            k == "ObjectIntersectionOf" and all(allowed(x, "super", profile) for x in f[0])
            or k == "ObjectComplementOf" and allowed(f[0], "sub", profile)
            or k == "ObjectSomeValuesFrom" and f[1].kind == "OWLClass"
            or k == "DataSomeValuesFrom"
        )
    if k == "Class":
        return c.iri != THING
    if k in ("ObjectHasValue", "DataHasValue"):
        return True
    if k == "ObjectIntersectionOf":
        return all(allowed(x, place, profile) for x in f[0])
    thing_or = lambda x, at: x.iri == THING or allowed(x, at, profile)
    if place == "sub":
        return (k == "ObjectUnionOf" and all(allowed(x, "sub", profile) for x in f[0])) or k in ("ObjectOneOf", "DataSomeValuesFrom") or k == "ObjectSomeValuesFrom" and thing_or(f[1], "sub")
    if place == "super":
        return (
            k == "ObjectComplementOf" and allowed(f[0], "sub", profile)
            or k == "ObjectAllValuesFrom" and allowed(f[1], "super", profile)
            or k == "DataAllValuesFrom"
            or k == "ObjectMaxCardinality" and int(f[0]) <= 1 and thing_or(f[2], "sub")
            or k == "DataMaxCardinality" and int(f[0]) <= 1
        )
    return False


def class_positions(a: Obj, profile: str, rl_disjoint: str = "sub") -> Iterator[Obj]:
    """Class expressions of an axiom that its profile does not admit where they stand."""
    k, f = KIND[a.kind].keyword, a.fields
    places: list[tuple[Obj, str]] = []
    if k == "SubClassOf":
        places = [(f[0], "sub"), (f[1], "super")]
    elif k == "EquivalentClasses":
        places = [(x, "sub" if profile == "QL" else "equiv") for x in f[0]]
    elif k == "DisjointClasses":
        places = [(x, "sub" if profile == "QL" else rl_disjoint) for x in f[0]]
    elif k in ("ObjectPropertyDomain", "DataPropertyDomain", "ObjectPropertyRange"):
        places = [(f[1], "super")]
    elif k == "ClassAssertion" and profile == "RL":
        places = [(f[0], "super")]
    elif k == "HasKey":
        places = [(f[0], "sub")]
    for c, place in places:
        if not allowed(c, place, profile):
            yield c


def rational(text: str, datatype: str) -> Fraction | None:
    """Exact value of a number's text, if it is one."""
    try:
        if datatype == OWL + "rational":
            n, d = text.split("/")
            return Fraction(int(n), int(d))
        if datatype in (XSD + "float", XSD + "double"):
            return Fraction(text) if re.match(lit.FLOAT, text) and not text.endswith(("INF", "NaN")) else None
        return Fraction(text) if re.match(lit.DECIMAL, text) else None
    except (ValueError, ZeroDivisionError):
        return None


_FACETS = {"order": ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive"), "length": ("length", "minLength", "maxLength", "pattern"), "octets": ("length", "minLength", "maxLength"), "lang": ("length", "minLength", "maxLength", "pattern", "langRange"), "none": ()}
_FLOATS, _TIMES = (XSD + "float", XSD + "double"), (XSD + "dateTime", XSD + "dateTimeStamp")
_TEXTS = tuple(XSD + x for x in ("string", "normalizedString", "token", "language", "Name", "NCName", "NMTOKEN"))


def in_value_space(datatype: str, v: Fraction | None) -> bool:
    """Is an exact number a value of a numeric datatype: of owl:real and owl:rational any is, of xsd:decimal those with a
    finite decimal fraction, of the others the whole ones between their bounds."""
    if v is None or datatype in (OWL + "real", OWL + "rational"):
        return v is not None
    if datatype == XSD + "decimal":
        den = v.denominator
        for p in (2, 5):
            while den % p == 0:
                den //= p
        return den == 1
    d = _OF[datatype]
    return v.denominator == 1 and (d.low is None or v >= int(d.low)) and (d.high is None or v <= int(d.high))


def facet_status(datatype: str, facet: str, lexical: str, own: str, literal: str = "valid") -> str:
    """'valid', 'invalid' or 'unverified' of a facet restriction of a built-in datatype: the value must be a literal in order
    itself (`literal` is its status), of the base's value space where it is a bound, a whole number of any exact numeric
    datatype where it is a length, a text where it is a pattern or a basic language range."""
    if literal != "valid":
        return literal
    d, name = _OF.get(datatype), facet.removeprefix(XSD).removeprefix(RDF)
    if d is None or name not in _FACETS[d.facets] or (name == "langRange") != facet.startswith(RDF):
        return "invalid"
    exact = rational(lexical, own) if own not in _FLOATS and (own == OWL + "rational" or own in _OF and _OF[own].facets == "order" and own not in _TIMES) else None
    if d.facets == "order":
        if datatype in _TIMES:
            fits = own in _TIMES and (datatype == XSD + "dateTime" or re.search(r"(?:Z|[+-][0-9]{2}:[0-9]{2})$", lexical) is not None)
        elif datatype in _FLOATS:
            fits = own == datatype
        else:
            fits = in_value_space(datatype, exact)
    elif name in ("pattern", "langRange"):
        text = lexical if own in _TEXTS else lexical[:-1] if own == RDF + "PlainLiteral" and lexical.endswith("@") else None
        fits = text is not None and (xsd_pattern(text) if name == "pattern" else re.fullmatch(r"\*|[A-Za-z]{1,8}(?:-[A-Za-z0-9]{1,8})*", text) is not None)
    else:
        fits = exact is not None and exact.denominator == 1 and exact >= 0
    return "valid" if fits else "invalid"


def xsd_pattern(text: str) -> bool:
    """Is a text a regular expression of XML Schema. It is recognised, never run."""
    at, n = 0, len(text)

    def branch(deep: int) -> bool:
        nonlocal at
        while at < n and text[at] not in ")":
            c = text[at]
            if c == "|":
                at += 1
                continue
            if c == "(":
                at += 1
                if deep > 200 or not branch(deep + 1) or at >= n or text[at] != ")":
                    return False
                at += 1
            elif c == "[":
                if not group():
                    return False
            elif c == "\\":
                if not escape():
                    return False
            elif c in "?*+{}]":
                return False
            else:
                at += 1
            if at < n and text[at] in "?*+":
                at += 1
            elif at < n and text[at] == "{":
                m = re.match(r"\{([0-9]+)(?:(,)([0-9]*))?\}", text[at:])
                if not m or m[3] and int(m[1]) > int(m[3]):
                    return False
                at += m.end()
        return True

    def escape() -> bool:
        nonlocal at
        m = re.match(r"\\(?:[nrt\\|.?*+(){}\-\[\]^sSiIcCdDwW]|[pP]\{(?:L[ultmo]?|M[nce]?|N[dlo]?|P[cdseifo]?|Z[slp]?|S[mcko]?|C[cfon]?|Is[A-Za-z0-9-]+)\})", text[at:])
        at += m.end() if m else 0
        return bool(m)

    def group() -> bool:
        nonlocal at
        at += 1
        if at < n and text[at] == "^":
            at += 1
        empty = True
        while at < n and text[at] != "]":
            if text[at] == "-" and at + 1 < n and text[at + 1] == "[":
                at += 1
                return not empty and group() and at < n and text[at] == "]" and step()
            if text[at] == "[":
                return False
            if text[at] == "\\":
                if not escape():
                    return False
            else:
                start = text[at]
                at += 1
                if at + 1 < n and text[at] == "-" and text[at + 1] not in "]-[\\":
                    if text[at + 1] < start:
                        return False
                    at += 2
            empty = False
        return at < n and not empty and step()

    def step() -> bool:
        nonlocal at
        at += 1
        return True

    return branch(0) and at == n


def facet_frame(s) -> DataFrame:
    """datatype, facet, lexical, value_type, status of every facet restriction of a built-in datatype in a Store, without
    repeats. The grammar of patterns and exact numbers are Python's work, in Arrow batches over the distinct restrictions."""
    part = lambda kind, field, *names: s.edges([kind], [field], nested=True).selectExpr("parent_key", *names)
    of = part("OWLDatatypeRestriction", "datatype", "child_key AS datatype").join(part("OWLDatatypeRestriction", "facetRestrictions", "child_key AS restriction"), "parent_key").drop("parent_key")
    facet = part("OWLFacetRestriction", "facet", "child_key AS facet").join(part("OWLFacetRestriction", "value", "child_key AS value"), "parent_key").withColumnRenamed("parent_key", "restriction")
    values = s.nodes().where("kind = 'OWLLiteral'").selectExpr("node_key AS value", "lexical", "lang", "datatype_iri", f"{lit.status(lit.SPARK)} AS literal")
    plain = "regexp_extract({}, '<(.*)>', 1)"
    rows = of.join(facet, "restriction").join(values, "value")
    rows = rows.selectExpr(f"{plain.format('datatype')} AS datatype", f"{plain.format('facet')} AS facet", "lexical", "datatype_iri AS value_type", "literal").where(F.col("datatype").isin([d.iri for d in DATATYPES])).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [facet_status(*r) for r in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.string())], names=["datatype", "facet", "lexical", "value_type", "status"])

    return rows.mapInArrow(run, "datatype string, facet string, lexical string, value_type string, status string")
