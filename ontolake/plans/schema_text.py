"""The fixed schema ontology: every kind of axiom and expression, and cases for the profile rules."""

SCHEMA = """
Prefix(:=<urn:ex:>)
Ontology(<urn:ex:schema> <urn:ex:schema/1>
Import(<urn:ex:sales>)
Import(<urn:ex:missing>)
Annotation(rdfs:comment "trade vocabulary"@en)
Annotation(:maintainer :alice)
Declaration(Class(:Product)) Declaration(Class(:Party)) Declaration(Class(:Customer)) Declaration(Class(:Supplier)) Declaration(Class(:Order)) Declaration(Class(:Place))
Declaration(Class(:Premium)) Declaration(Class(:Heavy)) Declaration(Class(:Idle)) Declaration(Class(:Mixed))
Declaration(ObjectProperty(:placedBy)) Declaration(ObjectProperty(:hasPart)) Declaration(ObjectProperty(:suppliedBy)) Declaration(ObjectProperty(:replyTo)) Declaration(ObjectProperty(:partOf))
Declaration(ObjectProperty(:relatedTo)) Declaration(ObjectProperty(:knows)) Declaration(ObjectProperty(:locatedIn)) Declaration(ObjectProperty(:trades))
Declaration(DataProperty(:acctbal)) Declaration(DataProperty(:retailPrice)) Declaration(DataProperty(:orderDate)) Declaration(DataProperty(:amount)) Declaration(DataProperty(:code))
Declaration(AnnotationProperty(:source)) Declaration(AnnotationProperty(:quality)) Declaration(AnnotationProperty(:maintainer)) Declaration(AnnotationProperty(:note))
Declaration(Datatype(:money)) Declaration(Datatype(:loopA)) Declaration(Datatype(:loopB)) Declaration(NamedIndividual(:alice)) Declaration(NamedIndividual(:bob))
Declaration(DataProperty(:Mixed)) Declaration(ObjectProperty(:source))
Declaration(ObjectProperty(:reaches)) Declaration(ObjectProperty(:loops)) Declaration(ObjectProperty(:winds)) Declaration(ObjectProperty(:bends)) Declaration(ObjectProperty(:flips)) Declaration(Datatype(:selfish)) Declaration(Datatype(:tight))
SubClassOf(Annotation(rdfs:comment "by law") :Customer :Party)
SubClassOf(:Customer :Party)
SubClassOf(:Supplier :Party)
SubClassOf(:Order ObjectSomeValuesFrom(:placedBy :Customer))
SubClassOf(:Order ObjectAllValuesFrom(:hasPart :Product))
SubClassOf(:Premium ObjectIntersectionOf(:Customer DataSomeValuesFrom(:acctbal DatatypeRestriction(xsd:decimal xsd:minInclusive "5000"^^xsd:decimal))))
SubClassOf(:Heavy ObjectMinCardinality(10 :hasPart :Product))
SubClassOf(:Heavy ObjectMaxCardinality(1 :placedBy))
SubClassOf(:Heavy ObjectExactCardinality(1 :knows :Party))
SubClassOf(:Idle ObjectComplementOf(ObjectUnionOf(:Premium :Heavy)))
SubClassOf(:Idle ObjectHasSelf(:relatedTo))
SubClassOf(:Idle DataMinCardinality(1 :code xsd:string))
SubClassOf(:Idle DataMaxCardinality(1 :code))
SubClassOf(:Idle DataExactCardinality(1 :amount xsd:decimal))
SubClassOf(DataHasValue(:code "x") ObjectHasValue(:knows :alice))
SubClassOf(ObjectOneOf(:alice :bob) :Party)
SubClassOf(:Mixed DataAllValuesFrom(:code DataUnionOf(xsd:string DataComplementOf(xsd:integer))))
SubClassOf(:Mixed DataSomeValuesFrom(:code DataIntersectionOf(xsd:string DataOneOf("a" "b"))))
SubClassOf(:Mixed ObjectIntersectionOf(:Party))
SubClassOf(:Undeclared :Party)
SubClassOf(<http://www.w3.org/2002/07/owl#Strange> :Party)
SubClassOf(ObjectSomeValuesFrom(ObjectInverseOf(:placedBy) :Order) :Customer)
EquivalentClasses(:Party ObjectUnionOf(:Customer :Supplier))
EquivalentClasses(:Customer :Client :Buyer)
DisjointClasses(:Product :Party :Place)
DisjointUnion(:Party :Customer :Supplier)
SubObjectPropertyOf(:placedBy :relatedTo)
SubObjectPropertyOf(:suppliedBy :relatedTo)
SubObjectPropertyOf(:relatedTo :knows)
SubObjectPropertyOf(ObjectPropertyChain(:hasPart :suppliedBy) :trades)
SubObjectPropertyOf(ObjectPropertyChain(:partOf :locatedIn) :locatedIn)
SubObjectPropertyOf(ObjectInverseOf(:partOf) :reaches) FunctionalObjectProperty(:reaches)
SubObjectPropertyOf(ObjectPropertyChain(:loops :winds) :bends) SubObjectPropertyOf(:bends :loops)
SubObjectPropertyOf(ObjectPropertyChain(:flips :flips) ObjectInverseOf(:flips))
EquivalentObjectProperties(:trades :dealsWith)
DisjointObjectProperties(:placedBy :suppliedBy)
ObjectPropertyDomain(:placedBy :Order) ObjectPropertyRange(:placedBy :Customer)
ObjectPropertyDomain(:hasPart :Order) ObjectPropertyRange(:hasPart :Product)
ObjectPropertyRange(:trades :Party)
InverseObjectProperties(:hasPart :partOf)
InverseObjectProperties(:relatedTo :relatedTo)
FunctionalObjectProperty(:placedBy) InverseFunctionalObjectProperty(:partOf) ReflexiveObjectProperty(:knows) IrreflexiveObjectProperty(:placedBy)
SymmetricObjectProperty(:relatedTo) AsymmetricObjectProperty(:hasPart) TransitiveObjectProperty(:partOf) TransitiveObjectProperty(:locatedIn) AsymmetricObjectProperty(:locatedIn)
SubDataPropertyOf(:retailPrice :amount) SubDataPropertyOf(:acctbal :amount)
EquivalentDataProperties(:code :identifier) DisjointDataProperties(:code :orderDate)
DataPropertyDomain(:acctbal :Party) DataPropertyRange(:acctbal xsd:decimal) DataPropertyDomain(:retailPrice :Product) DataPropertyRange(:retailPrice :money) DataPropertyRange(:orderDate xsd:dateTime)
FunctionalDataProperty(:acctbal)
DatatypeDefinition(:money DatatypeRestriction(xsd:decimal xsd:minInclusive "0"^^xsd:decimal xsd:maxExclusive "1000000"^^xsd:decimal))
DatatypeDefinition(:selfish DataUnionOf(:selfish xsd:string))
DatatypeDefinition(:tight DataUnionOf(DatatypeRestriction(xsd:decimal xsd:minInclusive "1/3"^^owl:rational) DatatypeRestriction(xsd:decimal xsd:minInclusive "1/4"^^owl:rational) DatatypeRestriction(xsd:byte xsd:maxInclusive "300"^^xsd:byte) DatatypeRestriction(xsd:byte xsd:maxInclusive "300"^^xsd:integer) DatatypeRestriction(xsd:string xsd:length "5.0"^^xsd:decimal) DatatypeRestriction(xsd:string xsd:length "-5"^^xsd:integer) DatatypeRestriction(xsd:string xsd:pattern "a[bc]+") DatatypeRestriction(xsd:string xsd:pattern "a[") DatatypeRestriction(rdf:PlainLiteral rdf:langRange "de-*") DatatypeRestriction(rdf:PlainLiteral rdf:langRange "de-AT") DatatypeRestriction(xsd:dateTimeStamp xsd:minInclusive "2024-01-01T00:00:00"^^xsd:dateTime) DatatypeRestriction(xsd:dateTimeStamp xsd:minInclusive "2024-01-01T00:00:00Z"^^xsd:dateTime) DatatypeRestriction(xsd:double xsd:minInclusive "1"^^xsd:decimal) DatatypeRestriction(xsd:boolean xsd:length "1"^^xsd:integer)))
DatatypeDefinition(:loopA DataUnionOf(:loopB xsd:string)) DatatypeDefinition(:loopB DataComplementOf(:loopA))
HasKey(:Order (:placedBy) (:orderDate))
SameIndividual(:alice :ally) DifferentIndividuals(:alice :bob _:x)
ClassAssertion(:Party :alice) ClassAssertion(ObjectSomeValuesFrom(:knows :Party) :bob) ClassAssertion(:Party _:x)
ObjectPropertyAssertion(:knows :alice :bob) ObjectPropertyAssertion(:knows :alice _:x) ObjectPropertyAssertion(:knows _:x _:y) ObjectPropertyAssertion(:knows _:y _:z) ObjectPropertyAssertion(:knows _:z _:x) ObjectPropertyAssertion(:knows _:p _:q)
NegativeObjectPropertyAssertion(:knows :bob :alice)
DataPropertyAssertion(:code :alice "a1") DataPropertyAssertion(:amount :alice "12"^^:money) DataPropertyAssertion(:amount :bob "300"^^xsd:byte) DataPropertyAssertion(:amount :bob "12.50"^^xsd:decimal)
DataPropertyAssertion(:amount :bob "twelve"^^xsd:integer) DataPropertyAssertion(:amount :bob "true"^^xsd:boolean) DataPropertyAssertion(:amount :bob "maybe"^^xsd:boolean) DataPropertyAssertion(:amount :bob "1/3"^^owl:rational)
DataPropertyAssertion(:amount :bob "2024-02-30T00:00:00"^^xsd:dateTime) DataPropertyAssertion(:amount :bob "2024-02-29T24:00:00Z"^^xsd:dateTime) DataPropertyAssertion(:amount :bob "abc"@en) DataPropertyAssertion(:amount :bob "x"^^<urn:other:type>)
DataPropertyAssertion(:code :bob "http://example.org/a"^^xsd:anyURI) DataPropertyAssertion(:code :bob "urn:ex:alice"^^xsd:anyURI) DataPropertyAssertion(owl:topDataProperty :bob "t")
NegativeDataPropertyAssertion(:code :bob "a1")
AnnotationAssertion(Annotation(:note "twice") rdfs:label :Customer "customer"@en) AnnotationAssertion(rdfs:label :Customer "Kunde"@de) AnnotationAssertion(rdfs:label :Supplier "supplier") AnnotationAssertion(:note :Customer :Party) AnnotationAssertion(rdfs:label :Order :Party)
AnnotationAssertion(rdfs:label :Order "order"@en) AnnotationAssertion(:note _:x "anonymous")
SubAnnotationPropertyOf(:note rdfs:comment) AnnotationPropertyDomain(:note :Party) AnnotationPropertyRange(:note xsd:string)
)
"""
