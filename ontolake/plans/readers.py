"""Readers, writers and the RDF mapping as queries: every customer and nation becomes a document in a syntax, which Spark then
reads. What a document says is known from the row it was made of, so the SQL gives the axioms from the columns alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.registry import parse_texts
from .projection import EX, Store

_XSD, _RDF, _OWL, _RDFS = "http://www.w3.org/2001/XMLSchema#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2000/01/rdf-schema#"

#: Documents about one customer, in every syntax that has data values. {c}, {n} and {b}: the customer's IRI, the nation's, and
#: the balance.
_TRIPLES = (("<{n}>", f"<{_RDF}type>", f"<{_OWL}Class>"), (f"<{EX}acctbal>", f"<{_RDF}type>", f"<{_OWL}DatatypeProperty>"), ("<{c}>", f"<{_RDF}type>", "<{n}>"), ("<{c}>", f"<{EX}acctbal>", f'"{{b}}"^^<{_XSD}decimal>'))
CUSTOMER = {
    "functional": f'Ontology(Declaration(Class(<{{n}}>)) Declaration(DataProperty(<{EX}acctbal>)) ClassAssertion(<{{n}}> <{{c}}>) DataPropertyAssertion(<{EX}acctbal> <{{c}}> "{{b}}"^^<{_XSD}decimal>))',
    "manchester": f'Ontology:\nClass: <{{n}}>\nDataProperty: <{EX}acctbal>\nIndividual: <{{c}}>\n    Types: <{{n}}>\n    Facts: <{EX}acctbal> "{{b}}"^^<{_XSD}decimal>\n',
    "owlxml": f'<Ontology xmlns="{_OWL}"><Declaration><Class IRI="{{n}}"/></Declaration><Declaration><DataProperty IRI="{EX}acctbal"/></Declaration><ClassAssertion><Class IRI="{{n}}"/><NamedIndividual IRI="{{c}}"/></ClassAssertion><DataPropertyAssertion><DataProperty IRI="{EX}acctbal"/><NamedIndividual IRI="{{c}}"/><Literal datatypeIRI="{_XSD}decimal">{{b}}</Literal></DataPropertyAssertion></Ontology>',
    "rdfxml": f'<rdf:RDF xmlns:rdf="{_RDF}" xmlns:owl="{_OWL}" xmlns:ex="{EX}"><owl:Class rdf:about="{{n}}"/><owl:DatatypeProperty rdf:about="{EX}acctbal"/><rdf:Description rdf:about="{{c}}"><rdf:type rdf:resource="{{n}}"/><ex:acctbal rdf:datatype="{_XSD}decimal">{{b}}</ex:acctbal></rdf:Description></rdf:RDF>',
    "turtle": f"@prefix owl: <{_OWL}> .\n@prefix : <{EX}> .\n<{{n}}> a owl:Class .\n:acctbal a owl:DatatypeProperty .\n<{{c}}> a <{{n}}> ; :acctbal {{b}} .\n",
    "trig": f"@prefix owl: <{_OWL}> .\n@prefix : <{EX}> .\n{{{{ <{{n}}> a owl:Class . :acctbal a owl:DatatypeProperty . <{{c}}> a <{{n}}> ; :acctbal {{b}} }}}}\n",
    "ntriples": "".join(" ".join(t) + " .\n" for t in _TRIPLES),
    "nquads": "".join(" ".join(t) + f" <{EX}graph> .\n" for t in _TRIPLES),
    "jsonld": f'{{{{"@graph":[{{{{"@id":"{{n}}","@type":"{_OWL}Class"}}}},{{{{"@id":"{EX}acctbal","@type":"{_OWL}DatatypeProperty"}}}},{{{{"@id":"{{c}}","@type":"{{n}}","{EX}acctbal":{{{{"@value":"{{b}}","@type":"{_XSD}decimal"}}}}}}}}]}}}}',
}
#: Syntaxes without data values; their names stand for IRIs of the document's own.
CONCEPTS = {"dl": "n{k} ⊑ Party\nn{k}(c{i})\n", "krss1": "(define-primitive-concept n{k} Party)\n(instance c{i} n{k})\n", "krss2": "(implies n{k} Party)\n(instance c{i} n{k})\n"}


def _filled(template: str, **columns):
    """The template with columns in the places of its names, as a Spark column."""
    from string import Formatter

    parts = []
    for text, name, _, _ in Formatter().parse(template):
        parts.append(F.lit(text))
        if name:
            parts.append(columns[name])
    return F.concat(*parts)


def _customers(s: Store):
    df = s.table("customer").where("c_acctbal IS NOT NULL")
    text = lambda x: F.col(x).cast("string")
    return df, {"c": F.concat(F.lit(f"{EX}customer/"), text("c_custkey")), "n": F.concat(F.lit(f"{EX}nation/"), text("c_nationkey")), "b": F.col("c_acctbal").cast("decimal(18,2)").cast("string"), "i": text("c_custkey"), "k": text("c_nationkey")}


def read_customers(s: Store, key: str, through: tuple[str, ...] = ()) -> DataFrame:
    """doc, axiom_key of the documents about all customers in one syntax; through: formats that they are written in and read
    again from."""
    df, columns = _customers(s)
    template = CUSTOMER.get(key) or CONCEPTS[key]
    doc = F.concat(F.lit(f"{EX}doc/"), columns["i"])
    return parse_texts(df, doc, _filled(template, **columns), key, through).select("doc", F.coalesce("axiom_key", "error").alias("axiom_key"))


def customer_sql(key: str) -> str:
    doc, balance = f"'{EX}doc/' || c_custkey", "CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR)"
    if key in CONCEPTS:
        of = lambda name, column: f"'<' || {doc} || '#{name}' || {column} || '>'"
        axioms = [f"'SubClassOf(Class(' || {of('n', 'c_nationkey')} || ') Class(<' || {doc} || '#Party>))'", f"'ClassAssertion(Class(' || {of('n', 'c_nationkey')} || ') NamedIndividual(' || {of('c', 'c_custkey')} || '))'"]
    else:
        n, c = f"'Class(<{EX}nation/' || c_nationkey || '>)'", f"'NamedIndividual(<{EX}customer/' || c_custkey || '>)'"
        axioms = [f"'Declaration(' || {n} || ')'", f"'Declaration(DataProperty(<{EX}acctbal>))'", f"'ClassAssertion(' || {n} || ' ' || {c} || ')'", f"'DataPropertyAssertion(DataProperty(<{EX}acctbal>) ' || {c} || ' \"' || {balance} || '\"^^<{_XSD}decimal>)'"]
        axioms += [f"'Declaration(' || {c} || ')'"] if key == "manchester" else []
    return " UNION ALL ".join(f"SELECT {doc} AS doc, {a} AS axiom_key FROM customer WHERE c_acctbal IS NOT NULL" for a in axioms)


#: Axioms about one nation with expressions of most kinds; as functional text, and as keys. {n}, {r}: nation and region; {k}: the
#: nation's number.
NATION = (
    ('SubClassOf(Annotation(<{rdfs}comment> "why") <{n}> ObjectSomeValuesFrom(ObjectInverseOf(<{ex}p>) <{r}>))', 'SubClassOf(Annotation(AnnotationProperty(<{rdfs}comment>) "why"^^<{xsd}string>) Class(<{n}>) ObjectSomeValuesFrom(ObjectInverseOf(ObjectProperty(<{ex}p>)) Class(<{r}>)))'),
    ("EquivalentClasses(<{n}> ObjectIntersectionOf(<{r}> ObjectComplementOf(<{ex}Place>)))", "EquivalentClasses(Class(<{n}>) ObjectIntersectionOf(Class(<{r}>) ObjectComplementOf(Class(<{ex}Place>))))"),
    ("SubClassOf(<{n}> ObjectMinCardinality({k} <{ex}p> <{r}>))", "SubClassOf(Class(<{n}>) ObjectMinCardinality({k} ObjectProperty(<{ex}p>) Class(<{r}>)))"),
    ("SubClassOf(<{n}> ObjectAllValuesFrom(<{ex}p> ObjectUnionOf(<{n}> <{r}>)))", "SubClassOf(Class(<{n}>) ObjectAllValuesFrom(ObjectProperty(<{ex}p>) ObjectUnionOf(Class(<{n}>) Class(<{r}>))))"),
    ('SubClassOf(<{n}> DataSomeValuesFrom(<{ex}d> DatatypeRestriction(<{xsd}integer> <{xsd}minInclusive> "{k}"^^<{xsd}integer>)))', 'SubClassOf(Class(<{n}>) DataSomeValuesFrom(DataProperty(<{ex}d>) DatatypeRestriction(Datatype(<{xsd}integer>) FacetRestriction(<{xsd}minInclusive> "{k}"^^<{xsd}integer>))))'),
    ("SubClassOf(<{n}> ObjectOneOf(<{ex}i/{k}> <{ex}j/{k}>))", "SubClassOf(Class(<{n}>) ObjectOneOf(NamedIndividual(<{ex}i/{k}>) NamedIndividual(<{ex}j/{k}>)))"),
    ("HasKey(<{n}> (<{ex}p>) (<{ex}d>))", "HasKey(Class(<{n}>) (ObjectProperty(<{ex}p>)) (DataProperty(<{ex}d>)))"),
    ("SubObjectPropertyOf(ObjectPropertyChain(<{ex}p> <{ex}p>) <{ex}q/{k}>)", "SubPropertyChainOf((ObjectProperty(<{ex}p>) ObjectProperty(<{ex}p>)) ObjectProperty(<{ex}q/{k}>))"),
    ('NegativeDataPropertyAssertion(<{ex}d> <{ex}i/{k}> "{k}"^^<{xsd}integer>)', 'NegativeDataPropertyAssertion(DataProperty(<{ex}d>) NamedIndividual(<{ex}i/{k}>) "{k}"^^<{xsd}integer>)'),
    ("DifferentIndividuals(<{ex}i/{k}> <{ex}j/{k}> <{ex}k/{k}>)", "DifferentIndividuals(NamedIndividual(<{ex}i/{k}>) NamedIndividual(<{ex}j/{k}>) NamedIndividual(<{ex}k/{k}>))"),
    *((f"Declaration({x})", f"Declaration({x})") for x in ("Class(<{n}>)", "Class(<{r}>)", "Class(<{ex}Place>)", "ObjectProperty(<{ex}p>)", "ObjectProperty(<{ex}q/{k}>)", "DataProperty(<{ex}d>)")),
)
_FIXED = {"ex": EX, "xsd": _XSD, "rdfs": _RDFS}


def map_nations(s: Store, through: tuple[str, ...]) -> DataFrame:
    """doc, axiom_key of the documents about all nations, mapped to RDF and back."""
    df, text = s.table("nation"), lambda x: F.col(x).cast("string")
    columns = {"n": F.concat(F.lit(f"{EX}nation/"), text("n_nationkey")), "r": F.concat(F.lit(f"{EX}region/"), text("n_regionkey")), "k": (F.col("n_nationkey") + 1).cast("string"), **{k: F.lit(v) for k, v in _FIXED.items()}}
    whole = F.concat(F.lit("Ontology("), *(x for t, _ in NATION for x in (_filled(t, **columns), F.lit("\n"))), F.lit(")"))
    return parse_texts(df, columns["n"], whole, "functional", through).select("doc", F.coalesce("axiom_key", "error").alias("axiom_key"))


def nation_sql() -> str:
    columns = {"n": f"'{EX}nation/' || n_nationkey", "r": f"'{EX}region/' || n_regionkey", "k": "(n_nationkey + 1)"}
    from string import Formatter

    def sql(template: str) -> str:
        parts = []
        for text, name, _, _ in Formatter().parse(template):
            text += _FIXED.get(name or "", "")
            parts += ["'" + text.replace("'", "''") + "'"] + ([columns[name]] if name in columns else [])
        return " || ".join(parts)

    return " UNION ALL ".join(f"SELECT {columns['n']} AS doc, {sql(k)} AS axiom_key FROM nation" for _, k in NATION)
