"""Readers and writers: what one format says, another says too."""

import re

import pytest

from ontolake.errors import AmbiguousRdfDatasetError, OWLSyntaxError, ParserMismatchError, SecurityPolicyError, UnparsableOntologyException
from ontolake.model import BY_KEYWORD, KINDS, XSD, cardinality, entity, literal, make, with_annotations, without_annotations
from ontolake.operators import comparison, hierarchy, locality, positions
from ontolake.plans.schema_text import SCHEMA
from ontolake.sources.documents import DocumentStore
from ontolake.sources import dl, functional, krss, manchester, mapping, owlxml, registry
from ontolake.sources.jsonld import read_jsonld
from ontolake.sources.rdf_terms import nt, read_lines, read_trig, read_turtle, write_lines, write_turtle
from ontolake.sources.rdfxml import read_rdfxml, write_rdfxml


def plain(o):
    return sorted({re.sub(r"_:[^\s()@]+@[^\s()]*", "_:", a.key) for a in o.distinct().axioms})


@pytest.fixture(scope="module")
def schema():
    return functional.parse(SCHEMA, "schema")


def test_every_kind_of_axiom_is_in_the_schema(schema):
    assert {a.kind for a in schema.axioms} == {k.kind for k in KINDS if k.category == "axiom"}


def test_functional_round_trip(schema):
    assert plain(functional.parse(functional.render(schema))) == plain(schema)


def test_owlxml_round_trip(schema):
    back = owlxml.parse(owlxml.render(schema))
    assert plain(back) == plain(schema)
    assert (back.iri, back.version, back.imports) == (schema.iri, schema.version, schema.imports)


@pytest.mark.parametrize("read,write", [(read_turtle, lambda q: write_turtle(q, {"ex:": "urn:ex:"})), (read_rdfxml, lambda q: write_rdfxml(q, {})), (lambda t: list(read_lines(t, False)), write_lines)])
def test_rdf_round_trip(schema, read, write):
    quads = mapping.to_rdf(schema)
    once, again = mapping.from_rdf(quads), mapping.from_rdf(read(write(quads)))
    assert plain(once) == plain(again)
    assert not again.unconsumed


def test_rdf_keeps_what_it_can_say():
    text = """Prefix(:=<urn:x:>) Ontology(<urn:x:o> <urn:x:v> Import(<urn:x:i>) Annotation(rdfs:label "o"@en)
    Declaration(Class(:A)) Declaration(Class(:B)) Declaration(ObjectProperty(:p)) Declaration(DataProperty(:d)) Declaration(AnnotationProperty(:n))
    SubClassOf(Annotation(:n "why"@en) Annotation(Annotation(:n "deep") :n "more") :A ObjectSomeValuesFrom(ObjectInverseOf(:p) :B))
    EquivalentClasses(:A ObjectUnionOf(:B ObjectComplementOf(:A))) SubClassOf(:A DataMaxCardinality(2 :d xsd:integer)) HasKey(:A (:p) (:d))
    SubObjectPropertyOf(ObjectPropertyChain(:p :p) :p) NegativeDataPropertyAssertion(:d :i "1"^^xsd:integer) DifferentIndividuals(:i :j :k) DataPropertyAssertion(:d :i "x"))"""
    o = functional.parse(text)
    r = mapping.from_rdf(mapping.to_rdf(o), strict=True)
    assert plain(r) == plain(o)
    assert (r.iri, r.version, r.imports, r.annotations) == (o.iri, o.version, o.imports, o.annotations)


def test_strict_refuses_what_no_rule_takes():
    quads = read_turtle("@prefix : <urn:x:> . :a :unknown :b .")
    with pytest.raises(OWLSyntaxError):
        mapping.from_rdf(quads, strict=True)
    assert [a.kind for a in mapping.from_rdf(quads).axioms] == ["OWLAnnotationAssertionAxiom"]


def test_malformed_lists_are_refused():
    text = "@prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . <urn:a> owl:equivalentClass [ a owl:Class ; owl:unionOf _:l ] . _:l rdf:first <urn:b> ; rdf:rest _:l ."
    with pytest.raises(OWLSyntaxError):
        mapping.from_rdf(read_turtle(text))


DL = "A ⊑ B\nA ≡ B ⊓ ∃ p.C\nA ⊑ ∀ p.(B ⊔ ¬C)\nA \\sqsubseteq \\geq 2 p.B\n{i j} ⊑ A\nA(i)\np(i, j)\ni ≠ j\ni = k\n: p ⊑ q\n: p ∘ q ⊑ r\n: p ∈ transitive\ntop ⊑ ∀ p.B\n∃ p.top ⊑ A\ntop ⊑ ≤ 1 p.top\n"
DL_SAME = """Prefix(:=<urn:x:>) Ontology( SubClassOf(:A :B) EquivalentClasses(:A ObjectIntersectionOf(:B ObjectSomeValuesFrom(:p :C)))
SubClassOf(:A ObjectAllValuesFrom(:p ObjectUnionOf(:B ObjectComplementOf(:C)))) SubClassOf(:A ObjectMinCardinality(2 :p :B)) SubClassOf(ObjectOneOf(:i :j) :A) ClassAssertion(:A :i)
ObjectPropertyAssertion(:p :i :j) DifferentIndividuals(:i :j) SameIndividual(:i :k) SubObjectPropertyOf(:p :q) SubObjectPropertyOf(ObjectPropertyChain(:p :q) :r) TransitiveObjectProperty(:p)
ObjectPropertyRange(:p :B) ObjectPropertyDomain(:p :A) FunctionalObjectProperty(:p))"""


def test_dl_says_what_functional_says():
    assert plain(dl.parse(DL, prefix="urn:x:")) == plain(functional.parse(DL_SAME))


def test_krss_dialects():
    shared = "(define-concept A (and B (some p C)))(transitive p)(instance i A)(related i p j)(equal i k)"
    assert plain(krss.parse(shared, prefix="urn:x:", dialect=1)) == plain(krss.parse(shared, prefix="urn:x:"))
    second = "(implies A B)(role-inclusion (compose p p) q)(define-primitive-role p :domain A :symmetric nil :reflexive t)"
    assert len(krss.parse(second, prefix="urn:x:").axioms) == 5
    with pytest.raises(OWLSyntaxError):
        krss.parse(second, prefix="urn:x:", dialect=1)
    with pytest.raises(OWLSyntaxError):
        krss.parse("(equivalent A B C)", prefix="urn:x:")


MANCHESTER = """Prefix: : <urn:x:>
Ontology: <urn:x:o>
Class: :A
    SubClassOf: Annotations: rdfs:comment "c" :B and (:p some :C), :p max 1, :d some xsd:integer[>= 0 , < 10]
    EquivalentTo: {:i , :j}
ObjectProperty: :p
    Characteristics: Functional, Transitive
    SubPropertyChain: :p o inverse :p
DataProperty: :d
    Range: xsd:integer or xsd:string
Individual: :i
    Types: :A, not :B
    Facts: :p :j, not :d 5
DisjointClasses: :A, :B, :C
"""
MANCHESTER_SAME = """Prefix(:=<urn:x:>) Ontology(<urn:x:o> Declaration(Class(:A)) Declaration(ObjectProperty(:p)) Declaration(DataProperty(:d)) Declaration(NamedIndividual(:i))
SubClassOf(Annotation(rdfs:comment "c") :A ObjectIntersectionOf(:B ObjectSomeValuesFrom(:p :C))) SubClassOf(:A ObjectMaxCardinality(1 :p)) SubClassOf(:A DataSomeValuesFrom(:d DatatypeRestriction(xsd:integer xsd:minInclusive "0"^^xsd:integer xsd:maxExclusive "10"^^xsd:integer)))
EquivalentClasses(:A ObjectOneOf(:i :j)) FunctionalObjectProperty(:p) TransitiveObjectProperty(:p) SubObjectPropertyOf(ObjectPropertyChain(:p ObjectInverseOf(:p)) :p)
DataPropertyRange(:d DataUnionOf(xsd:integer xsd:string)) ClassAssertion(:A :i) ClassAssertion(ObjectComplementOf(:B) :i) ObjectPropertyAssertion(:p :i :j) NegativeDataPropertyAssertion(:d :i "5"^^xsd:integer) DisjointClasses(:A :B :C))"""


def test_manchester_says_what_functional_says():
    assert plain(manchester.parse(MANCHESTER)) == plain(functional.parse(MANCHESTER_SAME))


def test_manchester_rendering():
    o = functional.parse(MANCHESTER_SAME)
    texts = {manchester.render_object(a) for a in o.axioms}
    assert {"A SubClassOf p max 1 Thing", "i Type not B", "DisjointWith: A , B , C", "Functional p"} <= texts


def test_jsonld():
    text = '{"@context":{"ex":"urn:x:","k":{"@id":"ex:k","@type":"@id"},"l":{"@id":"ex:l","@container":"@list"}},"@id":"ex:a","@type":"ex:T","ex:n":{"@value":"v","@language":"en"},"k":"ex:b","l":[1,true]}'
    got = sorted(" ".join(nt(t) for t in q[:3]) for q in read_jsonld(text))
    assert '<urn:x:a> <urn:x:n> "v"@en' in got
    assert "<urn:x:a> <urn:x:k> <urn:x:b>" in got
    assert len(got) == 8
    with pytest.raises(SecurityPolicyError):
        read_jsonld('{"@context":"http://example.org/c","@id":"x:y"}')


def test_trig_and_graphs():
    quads = read_trig("@prefix : <urn:x:> . :g { :a :b :c , 'x'@en } GRAPH :h { :a :b 1.5 . } :s :p ( 1 2 ) .")
    assert {nt(q.g) if q.g else "" for q in quads} == {"<urn:x:g>", "<urn:x:h>", ""}
    with pytest.raises(AmbiguousRdfDatasetError):
        registry.parse("<urn:a> <urn:b> <urn:c> <urn:g> .\n<urn:a> <urn:b> <urn:c> <urn:h> .\n", "nquads")


@pytest.mark.parametrize("text,first", [("Prefix(:=<urn:x:>) Ontology()", "functional"), ("Prefix: : <u:x>\nOntology:", "manchester"), ("<?xml version='1.0'?><Ontology xmlns='http://www.w3.org/2002/07/owl#'/>", "owlxml"), ("<rdf:RDF xmlns:rdf='x'/>", "rdfxml"), ("A ⊑ B", "dl"), ("(implies A B)", "krss2"), ("(define-concept A B)", "krss1"), ("<urn:a> <urn:b> <urn:c> .", "ntriples"), ("<urn:a> <urn:b> <urn:c> <urn:g> .", "nquads"), ("@prefix : <urn:x:> .", "turtle"), ('{"@id": "x:y"}', "jsonld"), ("<urn:g> { }", "trig")])
def test_detection(text, first):
    assert registry.candidates(text)[0] == first


def test_detection_failures():
    with pytest.raises(ParserMismatchError):
        registry.parse("nothing of the kind")
    with pytest.raises(UnparsableOntologyException):
        registry.parse("Ontology(SubClassOf(")
    with pytest.raises(OWLSyntaxError):
        registry.parse("Ontology(", "functional")


def test_storers(schema):
    small = functional.parse(DL_SAME)
    for key in ("functional", "owlxml", "turtle", "rdfxml"):
        assert plain(registry.parse(registry.store(small, key), key)[0]) == plain(small)


def test_lossy_texts_are_refused():
    from ontolake.errors import OWLOntologyStorageError

    head = "Prefix(:=<urn:x:>) Ontology(<urn:x:o> <urn:x:o/1> Import(<urn:x:i>) Annotation(rdfs:comment \"c\") "
    kept = functional.parse(head + "SubClassOf(:A ObjectSomeValuesFrom(:p _:b)) ClassAssertion(:A _:x) EquivalentClasses(:A :B) Declaration(ObjectProperty(:p)))".replace("ObjectSomeValuesFrom(:p _:b)", "ObjectHasValue(:p _:b)"))
    lost = functional.parse(head + "EquivalentClasses(:A :B :C))")  # RDF says it in pairs
    for key in ("turtle", "rdfxml"):
        assert comparison.compare(registry.parse(registry.store(kept, key), key)[0].axioms, kept.axioms)
        with pytest.raises(OWLOntologyStorageError):
            registry.store(lost, key)


def test_entities_are_bounded():
    with pytest.raises(SecurityPolicyError):
        read_rdfxml('<!DOCTYPE r [<!ENTITY x SYSTEM "file:///etc/passwd">]><r/>')
    quads = read_rdfxml('<!DOCTYPE rdf:RDF [<!ENTITY ex "urn:x:">]><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="urn:e:"><rdf:Description rdf:about="&ex;a"><e:p rdf:resource="&ex;b"/></rdf:Description></rdf:RDF>')
    assert nt(quads[0].s) == "<urn:x:a>"
    far = "<!-- " + "x" * 300_000 + " -->"
    for entity_text in ('<!ENTITY big "' + "y" * 20_000 + '">', '<!ENTITY x SYSTEM "file:///etc/passwd">', '<!ENTITY % p "z">', '<!ENTITY a "' + "y" * 5000 + '"><!ENTITY b "&a;&a;&a;">'):
        with pytest.raises(SecurityPolicyError):
            read_rdfxml(f"<!DOCTYPE r [{far}{entity_text}]><r/>")


def test_documents_load(spark, tmp_path):
    (tmp_path / "a.ofn").write_text(DL_SAME)
    (tmp_path / "b.omn").write_text(MANCHESTER)
    (tmp_path / "c.ofn").write_text("Ontology(")
    got = registry.load_axioms(spark, str(tmp_path)).toPandas()
    assert got[got.error.isna()].groupby("format").size().to_dict() == {"functional": 15, "manchester": 17}
    assert got.error.notna().sum() == 1
    assert registry.load_reach(spark, str(tmp_path)).where("node_kind = 'OWLClass'").count() > 10
    assert registry.load_edges(spark, str(tmp_path)).where("field = 'superClass'").count() == 7


def test_line_scan(spark, tmp_path):
    from ontolake.operators import rdf

    (tmp_path / "q.nq").write_text('<urn:a> <urn:b> "x\\"y"@en <urn:g> . # note\n\n# nothing\n_:b1 <urn:b> <urn:c> .\nbroken line\n')
    got = rdf.scan_lines(spark, str(tmp_path / "q.nq"))
    assert got.where("ok").count() == 2 and got.where("NOT ok").count() == 1
    with pytest.raises(AmbiguousRdfDatasetError):
        rdf.select_graph(got.where("ok"))
    assert rdf.select_graph(got.where("ok"), "merge").count() == 2
    assert rdf.select_graph(got.where("ok"), "selectGraph", "<urn:g>").count() == 1


def test_model():
    a, b = entity("Class", "urn:a"), entity("Class", "urn:b")
    assert make("ObjectUnionOf", [b, a, b]).key == make("ObjectUnionOf", [a, b]).key
    assert make("SubPropertyChainOf", [entity("ObjectProperty", "urn:p")] * 2, entity("ObjectProperty", "urn:q")).key.count("urn:p") == 2
    note = make("OWLAnnotation", entity("AnnotationProperty", "urn:n"), literal("x"))
    axiom = make("SubClassOf", a, b)
    assert with_annotations(axiom, [note]).key_noann == axiom.key
    assert without_annotations(with_annotations(axiom, [note])) == axiom
    assert cardinality("007") == "7" and cardinality("9" * 40) == "9" * 40
    with pytest.raises(ValueError):
        cardinality("-1")
    assert len([k for k in KINDS if k.category == "axiom"]) == 38 and len([k for k in KINDS if k.logical]) == 33
    assert BY_KEYWORD["Class"].kind == "OWLClass"


def test_locality(schema):
    module = locality.extract(schema.axioms, ["Class(<urn:ex:Customer>)"], "BOTTOM")
    signature = set().union(*(locality.entities(a) for a in module)) | {"Class(<urn:ex:Customer>)"}
    inside = {a.key for a in module}
    assert all(locality.is_local(a, signature, "BOTTOM") for a in schema.axioms if a.key not in inside)
    star = {a.key for a in locality.extract(schema.axioms, ["Class(<urn:ex:Customer>)"], "STAR")}
    assert star <= inside
    with pytest.raises(ValueError):
        locality.extract(schema.axioms, ["Class(<urn:none>)"], "TOP")
    assert locality.extract(schema.axioms, [], "TOP") == []


def test_locality_frame_equals_driver(spark, schema):
    from ontolake.plans import catalog
    from ontolake.plans.projection import Store

    pool, reach = catalog._pool(Store(spark, "/root/testdata/sf0.001"))
    mine = reach.where("ont_id = 'schema'")
    own = pool.join(mine.select(mine.root_key.alias("axiom_key")).distinct(), "axiom_key", "left_semi")
    got = {r["axiom_key"] for r in locality.module_frame(spark, own, mine, ["Class(<urn:ex:Order>)"], "BOTTOM").collect()}
    assert got == {a.key for a in locality.extract(schema.axioms, ["Class(<urn:ex:Order>)"], "BOTTOM")}


def test_positions_and_facets(schema):
    p = functional.parse("Prefix(:=<urn:x:>) Ontology(SubClassOf(:A ObjectUnionOf(:B :C)) SubClassOf(ObjectUnionOf(:B :C) :A))")
    bad = {(profile, a.key) for a in p.axioms for profile in ("QL", "RL") for _ in positions.class_positions(a, profile)}
    assert len([x for x in bad if x[0] == "RL"]) == 1 and len([x for x in bad if x[0] == "QL"]) == 2
    status = lambda d, f, v, t: positions.facet_status(XSD + d, XSD + f, v, XSD + t)
    assert status("integer", "minInclusive", "5", "integer") == "valid"
    assert status("byte", "maxInclusive", "300", "integer") == "invalid"
    assert status("string", "minInclusive", "5", "integer") == "invalid"
    assert status("string", "pattern", "[a-z]+", "string") == "valid"
    assert status("string", "pattern", "a{2,1}", "string") == "invalid"
    assert positions.facet_status(XSD + "string", XSD + "pattern", "a", XSD + "string", "unverified") == "unverified"


@pytest.fixture()
def store_of(spark, tmp_path):
    def make(axioms):
        (tmp_path / "o.ofn").write_text(f"Prefix(:=<urn:x:>) Ontology(<urn:x:o> {axioms})")
        return DocumentStore(spark, f"file://{tmp_path}")

    return make


@pytest.mark.parametrize(("axioms", "pairs"), [
    ("SubObjectPropertyOf(ObjectPropertyChain(:p :p) ObjectInverseOf(:p))", set()),
    ("SubObjectPropertyOf(ObjectPropertyChain(:p :p) :p)", set()),
    ("SubObjectPropertyOf(ObjectPropertyChain(:p :q) :p) SubObjectPropertyOf(ObjectPropertyChain(:q :r) :r)", set()),
    ("SubObjectPropertyOf(ObjectPropertyChain(:q :p :q) :p)", {("+urn:x:p", "+urn:x:p")}),
    ("SubObjectPropertyOf(ObjectPropertyChain(:p :q) :r) SubObjectPropertyOf(:r ObjectInverseOf(:q))", {("-urn:x:q", "+urn:x:r")}),
    ("SubObjectPropertyOf(ObjectPropertyChain(:p :q) owl:topObjectProperty) SubObjectPropertyOf(owl:topObjectProperty :p)", set()),
])
def test_regular_hierarchies(store_of, axioms, pairs):
    assert {(r["lower"], r["upper"]) for r in hierarchy.irregular_hierarchy(store_of(axioms)).collect()} >= pairs
    assert bool(pairs) == (hierarchy.irregular_hierarchy(store_of(axioms)).count() > 0)


def test_order_of_two_chains(store_of):
    assert hierarchy.irregular_hierarchy(store_of("SubObjectPropertyOf(ObjectPropertyChain(:p :q) :r) SubObjectPropertyOf(ObjectPropertyChain(:r :q) :p)")).count() > 0


def test_properties_above_an_inverse_are_not_simple(store_of):
    s = store_of("TransitiveObjectProperty(:q) SubObjectPropertyOf(ObjectInverseOf(:q) :p) FunctionalObjectProperty(:p) SymmetricObjectProperty(:s) SubObjectPropertyOf(ObjectPropertyChain(:a :b) ObjectInverseOf(:s)) IrreflexiveObjectProperty(:s) AsymmetricObjectProperty(:a)")
    assert {r["child_key"] for r in hierarchy.nonsimple_uses(s).collect()} == {"ObjectProperty(<urn:x:p>)", "ObjectProperty(<urn:x:s>)"}


def test_datatypes_that_name_themselves(store_of):
    s = store_of("DatatypeDefinition(:d DataUnionOf(:d xsd:string)) DatatypeDefinition(:e DataComplementOf(:f)) DatatypeDefinition(:f DataIntersectionOf(xsd:string DataComplementOf(:e))) DatatypeDefinition(:g :e) DatatypeDefinition(:h xsd:string)")
    assert {r["datatype"] for r in hierarchy.cyclic_datatypes(s).collect()} == {f"Datatype(<urn:x:{x}>)" for x in "def"}


def test_facets_of_documents(store_of):
    s = store_of('DatatypeDefinition(:d DataUnionOf(DatatypeRestriction(xsd:string xsd:length "5.0"^^xsd:decimal) DatatypeRestriction(xsd:byte xsd:maxInclusive "300"^^xsd:byte) DatatypeRestriction(:own xsd:length "1"^^xsd:integer)))')
    assert {(r["lexical"], r["status"]) for r in positions.facet_frame(s).collect()} == {("5.0", "valid"), ("300", "invalid")}


def test_comparison(schema):
    renamed = functional.parse(SCHEMA.replace("_:x", "_:foo").replace("_:y", "_:bar"), "other")
    assert comparison.compare(schema.axioms, renamed.axioms)
    assert not comparison.compare(schema.axioms, renamed.axioms[:-1])
    ring = [f"P(_:a{i} _:a{(i + 1) % 6})" for i in range(6)]
    two = [f"P(_:a{i} _:a{(i // 3) * 3 + (i + 1) % 3})" for i in range(6)]
    assert comparison.same(ring, [k.replace("_:a", "_:z") for k in ring])
    assert comparison.same(ring, two) is None


OWL_PREFIXES = "@prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix : <urn:x:> . "


def kinds_of(text):
    return {a.kind for a in mapping.from_rdf(read_turtle(OWL_PREFIXES + text)).axioms}


def test_property_categories():
    both = ":p a owl:ObjectProperty , owl:DatatypeProperty . "
    assert "OWLDataPropertyRangeAxiom" in kinds_of(both + ":p rdfs:range xsd:string .")
    assert "OWLObjectPropertyRangeAxiom" in kinds_of(both + ":C a owl:Class . :p rdfs:range :C .")
    assert "OWLSubObjectPropertyOfAxiom" in kinds_of(both + ":q a owl:ObjectProperty . :p rdfs:subPropertyOf :q . :q a owl:TransitiveProperty .")
    assert "OWLDataPropertyDomainAxiom" in kinds_of(both + ":C a owl:Class . :p rdfs:domain :C .")
    assert "OWLDataPropertyAssertionAxiom" in kinds_of(":p a rdf:Property ; rdfs:range xsd:string . :a :p 'v' .")


def test_cross_category_subproperty_is_left_out():
    r = mapping.from_rdf(read_turtle(OWL_PREFIXES + ":p a owl:ObjectProperty . :q a owl:DatatypeProperty . :p rdfs:subPropertyOf :q ."))
    assert not [a for a in r.axioms if a.kind.startswith("OWLSub")] and r.diagnostics


def test_headers_and_imports(spark, tmp_path):
    from ontolake.operators import revisions

    (tmp_path / "a.ofn").write_text("Ontology(<urn:a> Import(<urn:b>) Import(<urn:none>))")
    (tmp_path / "b.ofn").write_text("Ontology(<urn:b> <urn:b/1> Declaration(Class(<urn:b#C>)))")
    onts = registry.load_ontologies(spark, str(tmp_path))
    got = {(r["import_iri"], r["target"] is not None) for r in revisions.resolve_imports(onts).collect()}
    assert got == {("urn:b", True), ("urn:none", False)}
    mapped = revisions.resolve_imports(onts, spark.createDataFrame([("urn:none", "urn:b/1")], "import_iri string, document_iri string"))
    assert mapped.where("target IS NULL").isEmpty()
    assert revisions.unique_ids(onts).isEmpty()


def test_revisions(spark, tmp_path):
    from ontolake.errors import OWLOntologyStateError
    from ontolake.operators.revisions import Revisions

    log = lambda rows: spark.createDataFrame(rows, "axiom_key string, op string, ts int, seq int")
    r = Revisions(spark, f"file://{tmp_path}/store")
    assert r.commit("o", log([("a", "add", 1, 1), ("b", "add", 2, 2), ("a", "remove", 3, 3)]), 0) == 1
    assert [x["axiom_key"] for x in r.read("o").collect()] == ["b"]
    assert r.commit("o", log([("b", "add", 1, 1)]), 1) == 1
    with pytest.raises(OWLOntologyStateError):
        r.commit("o", log([("c", "add", 1, 1)]), 0)
    assert r.commit("o", log([("c", "add", 1, 1)]), 1) == 2 and r.read("o", 1).count() == 1


def test_document_format():
    from ontolake.sources.formats import DocumentFormat, StringTarget, WriterConfiguration, save

    f = DocumentFormat("functional")
    f.set_prefix("ex", "urn:ex:")
    assert f.get_iri("ex:a") == "urn:ex:a" and f.get_prefix_iri("urn:ex:b") == "ex:b"
    f.unregister_namespace("urn:ex:")
    assert not f.contains_prefix("ex:")
    target = StringTarget()
    save(functional.parse(DL_SAME), f, target)
    assert plain(functional.parse(target.text)) == plain(functional.parse(DL_SAME))
    assert WriterConfiguration().with_(indent=2).indent == 2
    with pytest.raises(ValueError):
        DocumentFormat("none")


def test_detection_of_tables(spark):
    texts = ["Prefix(:=<urn:x:>) Ontology()", "<rdf:RDF xmlns:rdf='x'/>", "@prefix : <urn:x:> .", "nothing", None]
    got = registry.detected(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text").orderBy("i").collect()
    assert [r["formats"] for r in got] == ["functional", "rdfxml", "turtle", "", ""]


def test_objects(schema):
    from ontolake.operators import objects

    changes = objects.rename(schema.axioms, {"urn:ex:Customer": "urn:ex:Buyer2"})
    assert [op for op, _ in changes[:2]] == ["remove", "add"] and not any("urn:ex:Customer>" in a.key for op, a in changes if op == "add")
    typed = objects.rename(schema.axioms, {"urn:ex:source": "urn:ex:origin"}, "OWLObjectProperty")
    assert {a.key for op, a in typed if op == "add"} == {"Declaration(ObjectProperty(<urn:ex:origin>))"}
    note = next(a for a in schema.axioms if a.kind == "OWLAnnotationAssertionAxiom" and a.annotations)
    assert objects.duplicate(note) == note
    blanks = next(a for a in schema.axioms if a.kind == "OWLDifferentIndividualsAxiom")
    assert "_:x@new" in objects.duplicate(blanks, scope="new").key
    gone = objects.remove(schema.axioms, entity("Class", "urn:ex:Customer"))
    assert all("urn:ex:Customer" in a.key for a in gone) and len(gone) > len({a.key for a in gone}) - 1
    other = functional.parse("Ontology(<urn:o> ClassAssertion(<urn:C> _:x))", "other")
    merged = objects.merge([schema, other], "urn:m", logical_only=True)
    assert merged.iri == "urn:m" and not merged.imports and all(a.kind != "OWLDeclarationAxiom" for a in merged.axioms)
    assert "ClassAssertion(Class(<urn:C>) _:x@other)" in {a.key for a in merged.axioms}


def test_metadata_graphs_and_limits(schema):
    from ontolake.errors import ResourceLimitError
    from ontolake.operators import objects

    quads = mapping.to_rdf(functional.parse(DL_SAME))
    again = read_turtle(write_turtle(quads, {}))
    assert objects.same_graph(quads, again)
    assert not objects.same_graph(quads, again[1:])
    meta = objects.parser_metadata([*quads, quads[0]], mapping.from_rdf(quads))
    assert meta.statements == meta.triples + 1 and meta.header == "missing" and ("urn:x:A", "OWLClass") in meta.guessed
    with pytest.raises(ResourceLimitError):
        objects.Limits(axioms=3).check_ontology(schema)
    with pytest.raises(ResourceLimitError):
        objects.Limits(depth=1).check_ontology(schema)
    objects.Limits().with_(axioms=1000).check_ontology(schema)
    assert registry.candidates("x", fixed_order=True)[0] == "rdfxml" and registry.candidates("x", "text/turtle", fixed_order=True) == ["turtle"]


def test_banners(schema):
    quads = mapping.to_rdf(schema)
    text = write_turtle(quads, {}, banners=True)
    names = re.findall(r"#    (.*)\n", text)
    assert names == sorted(names, key=["Annotation properties", "Datatypes", "Object Properties", "Data properties", "Classes", "Individuals", "General axioms"].index) and len(names) == len(set(names))
    assert plain(mapping.from_rdf(read_turtle(text))) == plain(mapping.from_rdf(quads))


@pytest.fixture(scope="module")
def stores(spark, tmp_path_factory):
    from ontolake.plans.projection import Store
    from ontolake.sources.documents import DocumentStore

    folder = tmp_path_factory.mktemp("onts")
    (folder / "schema.ofn").write_text(SCHEMA)
    (folder / "geo.omn").write_text("Ontology: <urn:ex:geo>\nClass: <urn:ex:nation/1>\n  SubClassOf: <urn:ex:region/1>\n")
    (folder / "bad.ofn").write_text("Ontology(")
    return Store(spark, "/root/testdata/sf0.001"), DocumentStore(spark, str(folder))


def same_rows(a, b):
    """Rows about the schema ontology, scopes and ontology names aside."""
    clean = lambda df: sorted(tuple(re.sub(r"_:([^\s()@]+)@[^\s()]*", r"_:\1", str(v)) for v in r) for r in df.collect())
    return clean(a) == clean(b)


def test_document_store_answers_as_the_table_store(stores):
    from ontolake.model import AXIOM_KINDS
    from ontolake.operators import graph, profiles, search, structural

    tables, documents = stores
    mine = lambda df: df.where("ont_id = 'schema'").drop("ont_id")
    theirs = lambda df: df.where("ont_id LIKE '%schema.ofn'").drop("ont_id")
    for f in (search.super_classes, search.sub_classes, search.equivalent_classes, search.disjoint_classes, search.sub_properties, search.super_properties, search.domains, search.ranges, search.inverses, search.annotation_objects):
        assert same_rows(mine(f(tables)), theirs(f(documents))), f.__name__
    assert same_rows(mine(tables.axioms(AXIOM_KINDS, ["schema"])), theirs(documents.axioms()))
    assert same_rows(mine(tables.reach(None, ["schema"])), theirs(documents.reach()))
    assert same_rows(mine(tables.edges(None, None, ["schema"], nested=True)), theirs(documents.edges(nested=True)))
    assert same_rows(mine(structural.signature(tables)), theirs(structural.signature(documents)))
    assert same_rows(mine(structural.by_position(tables, "OWLDisjointClassesAxiom", ("classExpressions",))), theirs(structural.by_position(documents, "OWLDisjointClassesAxiom", ("classExpressions",))))
    assert same_rows(hierarchy.nonsimple_properties(tables), hierarchy.nonsimple_properties(documents))
    assert same_rows(hierarchy.cyclic_datatypes(tables), hierarchy.cyclic_datatypes(documents))
    for rule in profiles.RULES:
        if rule.name in ("set_arity", "top_data_property_position", "data_range_arity", "el_class_expressions", "data_range_not_allowed", "enumeration_not_singleton", "defined_datatype_literal"):
            assert same_rows(rule.spark(tables), rule.spark(documents)), rule.name
        else:
            rule.spark(documents).count()
    assert graph.reachable(search.super_classes(documents).selectExpr("entity AS src", "result AS dst")).count() > 0
    assert structural.imports_closure(documents).count() == 2
    assert documents.failures().count() == 1
    assert documents.imports().where("target IS NULL").count() == 2
    assert documents.nodes().count() >= tables.nodes().count()


def test_xml_literals(spark):
    from ontolake.functions.literals import xml_literals

    rows = [("a<b>c</b>", True), ("a<b", False), ("<b></b>", True), ("<b/>", False), ("<b z=\"1\" a=\"2\"></b>", False), ("", True), ("&amp;", True), ("&", False)]
    got = xml_literals(spark.createDataFrame([(t,) for t, _ in rows], "lexical string")).collect()
    assert [(r["lexical"], r["valid"]) for r in got] == rows


# guards


def test_dispatch_is_total(schema):
    from ontolake.operators.guards import dispatch

    every = {k.kind: (lambda o: o.kind) for k in KINDS}
    assert {dispatch(a, every) for a in schema.axioms} == {a.kind for a in schema.axioms}
    axioms = {k.kind: len for k in KINDS if k.category == "axiom"}
    axioms.pop("OWLHasKeyAxiom")
    with pytest.raises(TypeError, match="HasKey"):
        dispatch(schema.axioms[0], axioms, "axiom")
    with pytest.raises(TypeError):
        dispatch(entity("Class", "urn:a"), every, "axiom")


def test_stores_of_different_behaviours_are_kept_apart(stores):
    from ontolake.operators import search
    from ontolake.operators.guards import closure_provider, searched

    tables, documents = stores
    both = searched([tables, documents], search.super_classes).count()
    assert both == search.super_classes(tables).count() + search.super_classes(documents).count()
    documents.behavior = "java"
    with pytest.raises(ValueError):
        searched([tables, documents], search.super_classes)
    documents.behavior = None
    assert "geo" in {r["member"] for r in closure_provider(tables, "trade")().collect()}


def test_jobs_end_with_their_time(spark):
    import time

    from pyspark.sql import functions as F

    from ontolake.errors import ResourceLimitError
    from ontolake.operators.guards import within

    with within(spark, 60):
        assert spark.range(10).count() == 10
    began = time.time()
    with pytest.raises(ResourceLimitError), within(spark, 1):
        spark.range(0, 10**13, 1, 4).agg(F.sum(F.hash("id"))).collect()
    assert time.time() - began < 40
    assert spark.range(10).count() == 10


def test_modules_of_an_extractor(spark, schema):
    from ontolake.plans import catalog
    from ontolake.plans.projection import EX, Store

    pool, reach = catalog._pool(Store(spark, "/root/testdata/sf0.001"))
    m = locality.ModuleExtractor(spark, pool, reach, locality.BOTTOM)
    seed = [f"Class(<{EX}Customer>)"]
    keys = lambda df: {r["axiom_key"] for r in df.collect()}
    whole = keys(m.extract(seed))
    assert m.locality_class == locality.BOTTOM and whole <= keys(m.axiom_base())
    assert m.contains_axiom(f"SubClassOf(Class(<{EX}Customer>) Class(<{EX}Party>))") and not m.contains_axiom("SubClassOf(A B)")
    some = keys(m.extract(seed, hierarchy.F.col("axiom_key").startswith("SubClassOf(")))
    assert some and all(k.startswith("SubClassOf(") for k in some) and some <= whole
    with pytest.raises(ValueError):
        m.extract(["Class(<urn:none>)"])


def test_ill_formed_terms_and_tags():
    from ontolake.errors import OWLOntologyStorageError

    text = '{"@id":"urn:x:a","urn:x:p":[{"@id":"urn:x:b c"},{"@value":"v","@language":"e"},{"@value":"w","@language":"en"},{"@value":"z","@type":"urn:t#a#b"}]}'
    assert [nt(q.o) for q in read_jsonld(text)] == ['"w"@en']
    o = functional.parse('Prefix(:=<urn:x:>) Ontology(DataPropertyAssertion(:d :a "x"@en))')
    o.axioms = [make("DataPropertyAssertion", entity("DataProperty", "urn:x:d"), entity("NamedIndividual", "urn:x:a"), literal("x", "not_a_tag"))]
    with pytest.raises(OWLOntologyStorageError):
        functional.render(o)


def test_bytes_of_documents():
    import gzip
    import io
    import zipfile
    import zlib

    from ontolake.errors import ResourceLimitError

    text = "Ontology(<urn:x:é>)"
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("o.ofn", text)
    for data in (text.encode(), b"\xef\xbb\xbf" + text.encode(), text.encode("utf-16"), text.encode("utf-32"), gzip.compress(text.encode()), gzip.compress(text[:5].encode()) + gzip.compress(text[5:].encode()), zlib.compress(text.encode()), packed.getvalue()):
        assert registry.decoded(data) == text
    latin = "<?xml version='1.0' encoding='ISO-8859-1'?><r>é</r>"
    assert registry.decoded(latin.encode("latin-1")) == latin
    for data in (gzip.compress(b"x" * 100_000), zlib.compress(b"x" * 100_000)):
        with pytest.raises(ResourceLimitError):
            registry.decoded(data, 1000)
    for data in (gzip.compress(b"x" * 1000)[:-9], b"<?xml version='1.0' encoding='none-such'?><r/>"):
        with pytest.raises(ParserMismatchError):
            registry.decoded(data)


def test_documents_of_one_split_are_dealt_over_tasks(spark):
    from pyspark.sql import functions as F

    from ontolake.sources.registry import parse_texts

    one = spark.range(100).coalesce(1)
    text = F.concat(F.lit("Ontology(Declaration(Class(<urn:x:"), F.col("id").cast("string"), F.lit(">)))"))
    parsed = parse_texts(one, F.concat(F.lit("urn:d:"), F.col("id").cast("string")), text, "functional", ("turtle", "rdfxml"))
    rows = parsed.withColumn("task", F.spark_partition_id()).collect()
    assert {r["axiom_key"] for r in rows} == {f"Declaration(Class(<urn:x:{i}>))" for i in range(100)}
    assert len({r["task"] for r in rows}) > 3 * spark.sparkContext.defaultParallelism // 2


def test_a_proof_is_taken_for_a_reading_only_where_it_is_one(monkeypatch):
    doc, read = "http://a.example/dir/doc", registry.quads_of
    for body, readings in (
        ("Declaration(Class(<urn:x:C>)) ClassAssertion(<urn:x:C> <urn:x:i>)", 1),
        ("Declaration(Class(<urn:x:C>)) ClassAssertion(<urn:x:C> _:i)", 2),  # scoped by the document
        ("Declaration(Class(<urn:x:C>)) ClassAssertion(<urn:x:C> <i>)", 2),  # relative to the document
    ):
        o, _ = registry.parse(f"Ontology({body})", "functional", doc)
        for key in ("turtle", "rdfxml"):
            asked = []
            monkeypatch.setattr(registry, "quads_of", lambda *a: asked.append(a) or read(*a))
            text, back = registry._stored(o, key)
            back = back or registry.parse(text, key, doc)[0]
            assert len(asked) == readings
            want, _ = registry.parse(text, key, doc)
            assert [a.key for a in back.distinct().axioms] == [a.key for a in want.distinct().axioms]
            assert (back.iri, back.version, back.imports, back.prefixes) == (want.iri, want.version, want.imports, want.prefixes)


def test_writers_run_where_the_package_is_not(tmp_path):
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "f").write_bytes(cloudpickle.dumps(lambda text: registry.store(registry.parse(text, "functional")[0], "rdfxml")))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = "import pickle; print(pickle.load(open('f', 'rb'))('Ontology(Declaration(Class(<urn:x:C>)))'))"
    assert "urn:x:C" in subprocess.run([sys.executable, "-c", run], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout
