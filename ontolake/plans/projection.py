"""The ontologies behind the driver's tables: each table's rows become axioms of one kind or several, and a fixed schema
ontology ties them together.

A branch says how: from which table, under which condition, with which direct fields. Its expressions are in the part of
SQL that Spark and DuckDB share, so the same branch gives the Spark frames and the SQL text of the oracles. Frames are
built of the branches whose kinds a query asks for, so a query reads only the tables and columns behind those kinds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import BRACKETED, BY_KEYWORD, KIND, RDFS, XSD, Obj, height, walk
from ..sources.functional import parse
from .schema_text import SCHEMA
from .unique import Part, apart, decided, of_key, pattern, pieces

EX = "urn:ex:"


class Field(NamedTuple):
    name: str
    key: str  # SQL
    kind: str
    ord: int = 0
    lexical: str = ""  # SQL, of literals
    language: str = "''"
    datatype: str = ""


class Branch(NamedTuple):
    ont: str
    keyword: str
    table: str
    fields: tuple[Field, ...]
    where: str = ""
    distinct: bool = False

    @property
    def kind(self) -> str:
        return BY_KEYWORD[self.keyword].kind

    @property
    def key(self) -> str:
        values, parts = {}, []
        for f in self.fields:
            values.setdefault(f.name, []).append(f.key)
        for spec in BY_KEYWORD[self.keyword].fields:
            many = " || ' ' || ".join(values[spec.strip("{}[]")])
            parts.append(f"'(' || {many} || ')'" if spec[0] in "{[" and self.keyword in BRACKETED else many)
        return f"'{self.keyword}(' || " + " || ' ' || ".join(parts) + " || ')'"


def _id(name: str, column: str) -> str:
    return f"'{EX}{name}/' || CAST({column} AS VARCHAR(20))"


def _word(name: str, column: str) -> str:
    return f"'{EX}{name}/' || replace(replace({column}, ' ', '_'), '#', '-')"


def _e(keyword: str, iri: str) -> tuple[str, str]:
    return f"'{keyword}(<' || {iri} || '>)'", BY_KEYWORD[keyword].kind


def _f(name: str, keyword: str, iri: str, ord: int = 0) -> Field:
    return Field(name, *_e(keyword, iri), ord)


def _iri(name: str, iri: str) -> Field:
    return Field(name, f"'<' || {iri} || '>'", "IRI")


def _lit(name: str, lexical: str, datatype: str = XSD + "string", language: str = "") -> Field:
    text = f"replace(replace({lexical}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34))"
    tail = f"chr(34) || '@' || {language}" if language else f"chr(34) || '^^<{datatype}>'"
    return Field(name, f"chr(34) || {text} || {tail}", "OWLLiteral", 0, lexical, language or "''", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString" if language else datatype)


def _const(name: str) -> str:
    return f"'{EX}{name}'"


def _money(column: str) -> str:
    return f"CAST(CAST({column} AS DECIMAL(18,2)) AS VARCHAR(40))"


_N, _C, _O, _D = "NamedIndividual", "Class", "ObjectProperty", "DataProperty"
BRANCHES: tuple[Branch, ...] = (
    Branch("geo", "Declaration", "region", (_f("entity", _C, _id("region", "r_regionkey")),)),
    Branch("geo", "Declaration", "nation", (_f("entity", _C, _id("nation", "n_nationkey")),)),
    Branch("geo", "SubClassOf", "nation", (_f("subClass", _C, _id("nation", "n_nationkey")), _f("superClass", _C, _id("region", "n_regionkey")))),
    Branch("catalog", "Declaration", "part", (_f("entity", _C, _word("type", "p_type")),), "p_type IS NOT NULL", True),
    Branch("catalog", "Declaration", "part", (_f("entity", _C, _word("brand", "p_brand")),), "p_brand IS NOT NULL", True),
    Branch("catalog", "ClassAssertion", "part", (_f("classExpression", _C, _word("type", "p_type")), _f("individual", _N, _id("part", "p_partkey"))), "p_type IS NOT NULL"),
    Branch("catalog", "ClassAssertion", "part", (_f("classExpression", _C, _word("brand", "p_brand")), _f("individual", _N, _id("part", "p_partkey"))), "p_brand IS NOT NULL"),
    Branch("catalog", "DataPropertyAssertion", "part", (_f("property", _D, _const("retailPrice")), _f("subject", _N, _id("part", "p_partkey")), _lit("value", _money("p_retailprice"), XSD + "decimal")), "p_retailprice IS NOT NULL"),
    Branch("trade", "ClassAssertion", "customer", (_f("classExpression", _C, _id("nation", "c_nationkey")), _f("individual", _N, _id("customer", "c_custkey")))),
    Branch("trade", "ClassAssertion", "customer", (_f("classExpression", _C, _word("segment", "c_mktsegment")), _f("individual", _N, _id("customer", "c_custkey"))), "c_mktsegment IS NOT NULL"),
    Branch("trade", "DataPropertyAssertion", "customer", (_f("property", _D, _const("acctbal")), _f("subject", _N, _id("customer", "c_custkey")), _lit("value", _money("c_acctbal"), XSD + "decimal")), "c_acctbal IS NOT NULL"),
    Branch("trade", "ClassAssertion", "supplier", (_f("classExpression", _C, _id("nation", "s_nationkey")), _f("individual", _N, _id("supplier", "s_suppkey")))),
    Branch("trade", "DataPropertyAssertion", "supplier", (_f("property", _D, _const("acctbal")), _f("subject", _N, _id("supplier", "s_suppkey")), _lit("value", _money("s_acctbal"), XSD + "decimal")), "s_acctbal IS NOT NULL"),
    Branch("trade", "SameIndividual", "supplier", (_f("individuals", _N, _id("customer", "s_suppkey")), _f("individuals", _N, _id("supplier", "s_suppkey"), 1))),
    Branch("sales", "ObjectPropertyAssertion", "orders", (_f("property", _O, _const("placedBy")), _f("subject", _N, _id("order", "o_orderkey")), _f("value", _N, _id("customer", "o_custkey")))),
    Branch("sales", "DataPropertyAssertion", "orders", (_f("property", _D, _const("orderDate")), _f("subject", _N, _id("order", "o_orderkey")), _lit("value", "CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) || 'T00:00:00'", XSD + "dateTime")), "o_orderdate IS NOT NULL"),
    Branch("sales", "ObjectPropertyAssertion", "lineitem", (_f("property", _O, _const("hasPart")), _f("subject", _N, _id("order", "l_orderkey")), _f("value", _N, _id("part", "l_partkey"))), "", True),
    Branch("sales", "ObjectPropertyAssertion", "lineitem", (_f("property", _O, _const("suppliedBy")), _f("subject", _N, _id("order", "l_orderkey")), _f("value", _N, _id("supplier", "l_suppkey"))), "", True),
    Branch("text", "AnnotationAssertion", "documents", (_f("property", "AnnotationProperty", f"'{RDFS}label'"), _iri("subject", _id("document", "doc_id")), _lit("value", "text", language="lang")), "text IS NOT NULL AND lang IS NOT NULL"),
    Branch("text", "AnnotationAssertion", "documents", (_f("property", "AnnotationProperty", _const("source")), _iri("subject", _id("document", "doc_id")), _lit("value", "source")), "source IS NOT NULL"),
    Branch("text", "AnnotationAssertion", "labels", (_f("property", "AnnotationProperty", _const("quality")), _iri("subject", _id("document", "doc_id")), _lit("value", "CAST(quality AS VARCHAR(20))", XSD + "integer")), "quality IS NOT NULL"),
    Branch("text", "AnnotationAssertion", "pages", (_f("property", "AnnotationProperty", f"'{RDFS}seeAlso'"), _iri("subject", _id("page", "page_id")), _lit("value", "url", XSD + "anyURI")), "url IS NOT NULL"),
    Branch("talk", "ObjectPropertyAssertion", "conversations", (_f("property", _O, _const("replyTo")), _f("subject", _N, _id("turn", "conv_id") + " || '/' || CAST(turn AS VARCHAR(20))"), _f("value", _N, _id("turn", "conv_id") + " || '/' || CAST(turn - 1 AS VARCHAR(20))")), "turn > 0"),
)

#: (ont, ontology IRI, version IRI, authored imports with the ontology they resolve to)
ONTOLOGIES: tuple[tuple[str, str, str | None, tuple[tuple[str, str | None], ...]], ...] = (
    ("geo", EX + "geo", None, ()),
    ("catalog", EX + "catalog", None, ((EX + "schema", "schema"),)),
    ("trade", EX + "trade", None, ((EX + "geo", "geo"), (EX + "schema", "schema"))),
    ("sales", EX + "sales", EX + "sales/2", ((EX + "trade", "trade"), (EX + "catalog", "catalog"))),
    ("text", EX + "text", None, ()),
    ("talk", EX + "talk", None, ((EX + "text", "text"),)),
    ("schema", EX + "schema", EX + "schema/1", ((EX + "sales", "sales"), (EX + "missing", None))),
)

AXIOM = "ont_id string, axiom_key string, key_noann string, kind string, is_logical boolean"
EDGE = "ont_id string, parent_key string, parent_kind string, field string, ord int, child_key string, child_kind string, in_axiom boolean"
NODE = "node_key string, kind string, iri string, lexical string, lang string, datatype_iri string, node_id string, cardinality string, height int"
REACH = "ont_id string, root_key string, root_kind string, node_key string, node_kind string, in_annotation boolean"


@lru_cache(1)
def schema_rows() -> dict[str, list[tuple]]:
    """The schema ontology as rows of the four tables. reach has a row for each way of being in an annotation."""
    o = parse(SCHEMA, "schema")
    axioms, edges, nodes, reach = [], {}, {}, []
    for a in o.axioms:
        axioms.append(("schema", a.key, a.key_noann, a.kind, KIND[a.kind].logical))
        for x, ann in walk(a):
            if x is not a:
                reach.append(("schema", a.key, a.kind, x.key, x.kind, ann))
            for name, i, c in x.children():
                edges[x.key, x.kind, name, i] = ("schema", x.key, x.kind, name, i, c.key, c.kind, x is a)
            nodes.setdefault((x.key, x.kind), _node(x))
    for a in o.annotations:
        for x, _ in walk(a):
            nodes.setdefault((x.key, x.kind), _node(x))
    annots = [("schema", a.key, c.key, c.kind) for a in o.annotations for c, _ in walk(a) if c is not a]
    return {"axiom": axioms, "edge": list(edges.values()), "node": list(nodes.values()), "reach": reach, "ont_annot": annots}


def _node(x: Obj) -> tuple:
    lit = x.fields if x.kind == "OWLLiteral" else (None, None, None)
    card = x.fields[0] if x.kind.endswith("Cardinality") else None
    return (x.key, x.kind, x.iri, *lit, x.fields[0] if x.kind == "OWLAnonymousIndividual" else None, card, height(x))


def _text(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def values_sql(rows: Iterable[tuple], columns: str) -> str:
    """A VALUES list for DuckDB."""
    names = ", ".join(c.split()[0] for c in columns.split(", "))
    types = [c.split()[1] for c in columns.split(", ")]
    rows = list(rows)
    cast = ", ".join(f"CAST({n} AS {'VARCHAR' if t == 'string' else t}) AS {n}" for n, t in zip(names.split(", "), types))
    if not rows:
        return "SELECT " + ", ".join(f"CAST(NULL AS {'VARCHAR' if t == 'string' else t}) AS {n}" for n, t in zip(names.split(", "), types)) + " WHERE FALSE"
    return f"SELECT {cast} FROM (VALUES " + ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows) + f") AS t({names})"


def local(spark: SparkSession, rows: Iterable[tuple], columns: str) -> DataFrame:
    """A small fixed table, part of the plan."""
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "long": pa.int64()}
    names = [c.split() for c in columns.split(", ")]
    rows = list(rows)
    return spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], kinds[t]) for i, (n, t) in enumerate(names)}))


def inverted(expression: str, key: str) -> str | None:
    """What a table's columns must be for a key expression to give a key: a condition that reaches the scan, 'TRUE' or
    'FALSE' where no column decides, None where the expression can't be turned round."""
    parts = expression.split(" || ")
    columns = [re.fullmatch(r"CAST\((\w+) AS VARCHAR\(20\)\)", x) for x in parts]
    if any(not m and not re.fullmatch(r"'[^']*'", x) for m, x in zip(columns, parts)) or sum(map(bool, columns)) > 1:
        return None
    at = next((i for i, m in enumerate(columns) if m), len(parts))
    before, after = ("".join(x[1:-1] for x in some) for some in (parts[:at], parts[at + 1 :]))
    if at == len(parts):
        return "TRUE" if before == key else "FALSE"
    value = key[len(before) : len(key) - len(after)]
    fits = key.startswith(before) and key.endswith(after) and re.fullmatch(r"0|-?[1-9][0-9]{0,17}", value)
    return f"{columns[at][1]} = {value}" if fits else "FALSE"


def conditions(only: list[str | None]) -> str:
    """One of the conditions that inverted() gave; no condition if one of them is unknown or always holds."""
    some = [c for c in only if c != "FALSE"]
    return "" if not some or None in some or "TRUE" in some else " OR ".join(dict.fromkeys(some))


class Store:
    """The projected ontologies as frames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}
        self._whole: dict[tuple[str, str], bool] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:  # a reader looks at files to know a schema; once is enough
            self._tables[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._tables[name]

    def _rows(self, b: Branch, columns: dict[str, str], only: str = "") -> DataFrame:
        df = self.table(b.table)
        for where in (b.where, only):
            df = df.where(where) if where else df
        if b.distinct:  # on the columns in use, before any text is built
            used = [c for c in df.columns if any(re.search(rf"\b{c}\b", f.key) for f in b.fields)]
            df = df.select(*used).distinct()
        return df.select(*(F.expr(e).alias(n) for n, e in columns.items()))

    def _union(self, parts: list[DataFrame], empty: str) -> DataFrame:
        parts = parts or [self.spark.createDataFrame([], empty)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def axioms(self, kinds: Iterable[str] | None = None, onts: Iterable[str] | None = None) -> DataFrame:
        """ont_id, axiom_key, key_noann, kind, is_logical; those of some kinds or ontologies."""
        parts = [self._rows(b, axiom_columns(b)) for b in chosen(kinds, onts)]
        rows = [r for r in schema_rows()["axiom"] if (kinds is None or r[3] in kinds) and (onts is None or "schema" in onts)]
        return self._union(([local(self.spark, rows, AXIOM)] if rows else []) + parts, AXIOM)

    def whole(self, name: str, expression: str) -> bool:
        """Is an expression over a table's columns a whole number."""
        if (name, expression) not in self._whole:
            self._whole[name, expression] = self.table(name).select(F.expr(expression)).dtypes[0][1] in ("tinyint", "smallint", "int", "bigint")
        return self._whole[name, expression]

    def parts(self, kinds: Iterable[str] | None = None, onts: Iterable[str] | None = None, across: bool = False, column: str = "axiom_key") -> tuple[list[Part], list[Branch], list[tuple[Branch, str]]]:
        """Branches whose axioms are told apart by their columns, without repeats; the other branches; and, for rows of the first
        that have null keys, the branch and the condition. across: also apart from axioms of other ontologies, those of the
        schema too, by axiom_key or key_noann."""
        branches = chosen(kinds, onts)
        shapes = [pattern(b, lambda e, b=b: self.whole(b.table, e)) for b in branches]
        meets = lambda i, j: i != j and branches[i].kind == branches[j].kind and (across or branches[i].ont == branches[j].ont) and not apart(shapes[i], shapes[j])
        good = [decided(p) and not any(meets(i, j) for j in range(len(branches))) for i, p in enumerate(shapes)]
        found, nulls = [], []
        for b, p in ((b, p) for b, p, g in zip(branches, shapes, good) if g):
            holes = list({x.text: x for x in p if not isinstance(x, str)}.values())
            names = {basis: f"b{i}" for i, basis in enumerate(dict.fromkeys(x.basis for x in holes))}
            df = self.table(b.table)
            df = (df.where(b.where) if b.where else df).select(*(F.expr(e).alias(n) for e, n in names.items())).where(" AND ".join(f"{n} IS NOT NULL" for n in names.values()) or "TRUE").distinct()

            def over(sql: str, holes=holes, names=names) -> str:
                for x in holes:
                    sql = sql.replace(x.text, x.shown.format(names[x.basis]))
                return sql

            part = Part(b, df, over, p)
            same = sorted({r[1 if column == "axiom_key" else 2] for r in schema_rows()["axiom"] if r[3] == b.kind}) if across or b.ont == "schema" else []
            if same:
                part = part._replace(rows=df.where(~F.expr(over(b.key)).isin(same)))
            found.append(part)
            if names:
                nulls.append((b, " OR ".join(f"({e}) IS NULL" for e in names)))
        return found, [b for b, g in zip(branches, good) if not g], nulls

    def unique_axioms(self, kinds: Iterable[str] | None = None, onts: Iterable[str] | None = None, by: tuple[str, ...] = ("axiom_key",)) -> DataFrame:
        """axioms() without repeats of ("ont_id", "axiom_key"), ("axiom_key",) or ("key_noann",)."""
        found, rest = self.unique_parts(kinds, onts, "ont_id" not in by, by[-1])
        return self._union([rest.dropDuplicates(list(by)), *(axioms_of(x) for x in found)], AXIOM)

    def unique_parts(self, kinds: Iterable[str] | None = None, onts: Iterable[str] | None = None, across: bool = True, column: str = "axiom_key") -> tuple[list[Part], DataFrame]:
        """Parts as in parts(), and axioms() of all that they leave, repeats and all."""
        found, others, nulls = self.parts(kinds, onts, across, column)
        rows = [r for r in schema_rows()["axiom"] if (kinds is None or r[3] in kinds) and (onts is None or "schema" in onts)]
        rest = [self._rows(b, axiom_columns(b), only) for b, only in (*((b, "") for b in others), *nulls)]
        return found, self._union(([local(self.spark, rows, AXIOM)] if rows else []) + rest, AXIOM)

    def axiom_counts(self, kinds: Iterable[str] | None = None, onts: Iterable[str] | None = None) -> DataFrame:
        """ont_id, kind, is_logical, n: axioms of each kind of an ontology, in a row or several. A table is read once, whatever
        the number of axioms that its rows make, and no key is written."""
        by: dict[str, list[Branch]] = {}
        for b in chosen(kinds, onts):
            by.setdefault(b.table, []).append(b)
        parts = []
        for name, branches in by.items():
            df, counts = self.table(name), []
            for b in branches:
                used = [c for c in df.columns if any(re.search(rf"\b{c}\b", f.key) for f in b.fields)]
                what = f"DISTINCT struct({', '.join(used)})" if b.distinct else "1"
                counts.append(f"count({what})" + (f" FILTER (WHERE {b.where})" if b.where else ""))
            one = df.agg(*(F.expr(c).alias(f"n{i}") for i, c in enumerate(counts)))
            rows = ", ".join(f"struct('{b.ont}' AS ont_id, '{b.kind}' AS kind, {str(KIND[b.kind].logical).lower()} AS is_logical, n{i} AS n)" for i, b in enumerate(branches))
            parts.append(one.select(F.expr(f"inline(array({rows}))")))
        own = Counter((r[0], r[3], r[4]) for r in schema_rows()["axiom"] if (kinds is None or r[3] in kinds) and (onts is None or "schema" in onts))
        shape = "ont_id string, kind string, is_logical boolean, n long"
        return self._union(([local(self.spark, [(*k, n) for k, n in own.items()], shape)] if own else []) + parts, shape)

    def edges(self, kinds: Iterable[str] | None = None, fields: Iterable[str] | None = None, onts: Iterable[str] | None = None, nested: bool = False, key: str | None = None) -> DataFrame:
        """Direct fields of axioms (and, with nested, of the expressions inside); with key, those whose value it is: the key
        becomes a condition on the tables' columns, and tables that cannot have it are not read."""
        parts = []
        for b in chosen(kinds, onts):
            own = [f for f in b.fields if fields is None or f.name in fields]
            only = [inverted(f.key, key) for f in own] if key else []
            own = [f for f, c in zip(own, only) if c != "FALSE"] if key else own
            if own:
                structs = ", ".join(f"named_struct('field', '{f.name}', 'ord', {f.ord}, 'child_key', {f.key}, 'child_kind', '{f.kind}')" for f in own)
                rows = self._rows(b, {"parent_key": b.key, "x": f"explode(array({structs}))"}, conditions(only))
                parts.append(rows.select(F.lit(b.ont).alias("ont_id"), "parent_key", F.lit(b.kind).alias("parent_kind"), "x.field", "x.ord", "x.child_key", "x.child_kind", F.lit(True).alias("in_axiom")))
        rows = [r for r in schema_rows()["edge"] if (kinds is None or r[2] in kinds) and (fields is None or r[3] in fields) and (onts is None or "schema" in onts) and (nested or r[7])]
        out = self._union(([local(self.spark, rows, EDGE)] if rows else []) + parts, EDGE)
        return out.where(F.col("child_key") == key) if key else out

    def rows(self, kinds: Iterable[str], fields: Iterable[str], onts: Iterable[str] | None = None) -> DataFrame:

        """Axioms with some of their single fields side by side: ont_id, axiom_key, kind, and <field>_key and <field>_kind of
        each. All come from one row of a table, so no join is needed."""
        kinds, fields = list(kinds), list(fields)
        parts = []
        for b in chosen(kinds, onts):
            f = {x.name: x for x in b.fields}
            own = {k: v for n in fields for k, v in ((f"{n}_key", f[n].key), (f"{n}_kind", f"'{f[n].kind}'"))}
            parts.append(self._rows(b, {"ont_id": f"'{b.ont}'", "axiom_key": b.key, "kind": f"'{b.kind}'"} | own))
        at: dict[str, dict] = {}
        for r in schema_rows()["edge"] if onts is None or "schema" in onts else ():
            if r[7] and r[2] in kinds and r[3] in fields:
                at.setdefault(r[1], {"kind": r[2]})[r[3]] = (r[5], r[6])
        own = [("schema", k, v["kind"], *(x for n in fields for x in v[n])) for k, v in at.items()]
        shape = "ont_id string, axiom_key string, kind string, " + ", ".join(f"{n}_key string, {n}_kind string" for n in fields)
        return self._union(([local(self.spark, own, shape)] if own else []) + parts, shape)

    def pairs(self, kinds: Iterable[str], left: str, right: str, onts: Iterable[str] | None = None) -> DataFrame:
        """rows() of two fields, named left and right."""
        names = {f"{f}_{x}": f"{side}_{x}" for f, side in ((left, "left"), (right, "right")) for x in ("key", "kind")}
        return self.rows(kinds, [left, right], onts).withColumnsRenamed(names)

    def entities(self, node_kinds: Iterable[str], kinds: Iterable[str] | None = None, onts: Iterable[str] | None = None, repeats: bool = False) -> DataFrame:
        """ont_id, node_kind, node_key of objects of some kinds anywhere in axioms, without repeats inside an ontology
        unless asked for.
        A table is scanned once for all its keys, and not at all if it holds no object of these kinds; keys that no column
        goes into take one row of it."""
        wheres: dict[tuple[str, str, str, str], set[str]] = {}
        for b in chosen(kinds, onts):
            for key, kind, _ in inside(b):
                if kind in node_kinds:
                    wheres.setdefault((b.ont, b.table, key, kind), set()).add(b.where)
        scans: dict[tuple[str, str, str, bool], list[tuple[str, str]]] = {}
        for (ont, name, key, kind), some in wheres.items():
            where = "" if "" in some else " OR ".join(f"({w})" for w in sorted(some))
            fixed = not any(re.search(rf"\b{c}\b", key) for c in self.table(name).columns)
            scans.setdefault((ont, name, where, fixed), []).append((key, kind))
        parts = []
        for (ont, name, where, fixed), found in scans.items():
            df = self.table(name)
            df = df.where(where) if where else df
            df = df.limit(1) if fixed else df
            structs = ", ".join(f"named_struct('node_kind', '{kind}', 'node_key', {key})" for key, kind in found)
            parts.append(df.select(F.expr(f"explode(array({structs}))").alias("x")).select(F.lit(ont).alias("ont_id"), "x.node_kind", "x.node_key"))
        own = sorted({(r[0], r[4], r[3]) for r in schema_rows()["reach"] if r[4] in node_kinds and (kinds is None or r[2] in kinds) and (onts is None or "schema" in onts)})
        shape = "ont_id string, node_kind string, node_key string"
        out = self._union(([local(self.spark, own, shape)] if own else []) + parts, shape)
        return out if repeats else out.distinct()

    def reach(self, kinds: Iterable[str] | None = None, onts: Iterable[str] | None = None, node_kinds: Iterable[str] | None = None, key: str | None = None) -> DataFrame:
        """Every object inside each axiom, or those of some kinds, or those with a key, as in edges()."""
        parts = []
        for b in chosen(kinds, onts):
            own = [x for x in inside(b) if node_kinds is None or x[1] in node_kinds]
            only = [inverted(x[0], key) for x in own] if key else []
            own = [x for x, c in zip(own, only) if c != "FALSE"] if key else own
            if not own:
                continue
            parts.append(self._reach(b, own, conditions(only)))
        rows = [r for r in schema_rows()["reach"] if (kinds is None or r[2] in kinds) and (onts is None or "schema" in onts) and (node_kinds is None or r[4] in node_kinds)]
        out = self._union(([local(self.spark, rows, REACH)] if rows else []) + parts, REACH)
        return out.where(F.col("node_key") == key) if key else out

    def reach_parts(self, kinds: Iterable[str] | None = None) -> tuple[list[Part], DataFrame]:
        """Parts of unique axioms of each ontology, and reach() of all axioms that they leave."""
        found, others, nulls = self.parts(kinds)
        parts = [self._reach(b, inside(b), only) for b, only in (*((b, "") for b in others), *nulls)]
        rows = [r for r in schema_rows()["reach"] if kinds is None or r[2] in kinds]
        return found, self._union([local(self.spark, rows, REACH), *parts], REACH)

    def _reach(self, b: Branch, own: list[tuple[str, str, bool]], only: str) -> DataFrame:
        structs = ", ".join(f"named_struct('node_key', {k}, 'node_kind', '{kind}', 'in_annotation', {str(ann).lower()})" for k, kind, ann in own)
        rows = self._rows(b, {"root_key": b.key, "x": f"explode(array({structs}))"}, only)
        return rows.select(F.lit(b.ont).alias("ont_id"), "root_key", F.lit(b.kind).alias("root_kind"), "x.node_key", "x.node_kind", "x.in_annotation")

    def distinct_count(self, part: Part, keys: Iterable[str]) -> str:
        """SQL over a part's rows of how many of some keys inside an axiom differ: a number, if their fixed texts tell."""
        keys = list(dict.fromkeys(keys))
        texts = {f.key: f for f in part.branch.fields if f.lexical}
        whole = lambda e: self.whole(part.branch.table, e)
        shapes = [pieces(texts[k], whole) if k in texts else of_key(k, whole) for k in keys]
        if all(apart(p, q) for i, p in enumerate(shapes) for q in shapes[:i]):
            return str(len(keys))
        return f"size(array_distinct(array({', '.join(map(part.over, keys))})))"

    def literals(self, kinds: Iterable[str] | None = None) -> DataFrame:
        """ont_id, root_key, lexical, lang, datatype_iri of the literals in axioms."""
        parts = []
        for b in chosen(kinds, None):
            for f in b.fields:
                if f.kind == "OWLLiteral":
                    parts.append(self._rows(b, {"ont_id": f"'{b.ont}'", "root_key": b.key, "lexical": f.lexical, "lang": f.language, "datatype_iri": f"'{f.datatype}'"}))
        rows = literal_rows(kinds)
        return self._union([local(self.spark, rows, LITERAL), *parts], LITERAL)

    def nodes(self) -> DataFrame:
        """The nodes of the schema ontology."""
        return local(self.spark, schema_rows()["node"], NODE)

    def ontologies(self) -> DataFrame:
        return local(self.spark, [o[:3] for o in ONTOLOGIES], "ont_id string, ontology_iri string, version_iri string")

    def imports(self) -> DataFrame:
        return local(self.spark, import_rows(), IMPORT)

    def annotations(self) -> DataFrame:
        return local(self.spark, schema_rows()["ont_annot"], ONT_ANNOT)


LITERAL = "ont_id string, root_key string, lexical string, lang string, datatype_iri string"
IMPORT = "ont_id string, import_iri string, target string"
ONT_ANNOT = "ont_id string, ann_key string, node_key string, node_kind string"


def literal_rows(kinds: Iterable[str] | None) -> list[tuple]:
    of = {n[0]: n for n in schema_rows()["node"] if n[1] == "OWLLiteral"}
    return sorted({("schema", r[1], *of[r[3]][3:6]) for r in schema_rows()["reach"] if r[4] == "OWLLiteral" and (kinds is None or r[2] in kinds)})


def import_rows() -> list[tuple]:
    return [(o[0], iri, target) for o in ONTOLOGIES for iri, target in o[3]]


def chosen(kinds: Iterable[str] | None, onts: Iterable[str] | None) -> list[Branch]:
    return [b for b in BRANCHES if (kinds is None or b.kind in kinds) and (onts is None or b.ont in onts)]


def axiom_columns(b: Branch) -> dict[str, str]:
    return {"ont_id": f"'{b.ont}'", "axiom_key": b.key, "key_noann": b.key, "kind": f"'{b.kind}'", "is_logical": str(KIND[b.kind].logical).lower()}


def axioms_of(part: Part) -> DataFrame:
    return part.select(**axiom_columns(part.branch))


def inside(b: Branch) -> list[tuple[str, str, bool]]:
    """(key, kind, in annotation) of all objects inside a branch's axioms."""
    out = []
    for f in b.fields:
        ann = b.keyword == "AnnotationAssertion" and f.name == "value"
        out.append((f.key, f.kind, ann))
        if f.datatype:
            out.append((f"'Datatype(<{f.datatype}>)'", "OWLDatatype", ann))
    return out


# The same tables as SQL text for DuckDB.


def _from(b: Branch) -> str:
    return f"FROM {b.table}" + (f" WHERE {b.where}" if b.where else "")


def axiom_sql(kinds: Iterable[str] | None = None, onts: Iterable[str] | None = None) -> str:
    rows = [r for r in schema_rows()["axiom"] if (kinds is None or r[3] in kinds) and (onts is None or "schema" in onts)]
    parts = [values_sql(rows, AXIOM)]
    parts += [f"SELECT {'DISTINCT ' if b.distinct else ''}'{b.ont}', {b.key}, {b.key}, '{b.kind}', {KIND[b.kind].logical} {_from(b)}" for b in chosen(kinds, onts)]
    return "\nUNION ALL ".join(parts)


def edge_sql(kinds: Iterable[str] | None = None, fields: Iterable[str] | None = None, nested: bool = False, onts: Iterable[str] | None = None) -> str:
    rows = [r for r in schema_rows()["edge"] if (kinds is None or r[2] in kinds) and (fields is None or r[3] in fields) and (nested or r[7]) and (onts is None or "schema" in onts)]
    parts = [values_sql(rows, EDGE)]
    for b in chosen(kinds, onts):
        parts += [f"SELECT {'DISTINCT ' if b.distinct else ''}'{b.ont}', {b.key}, '{b.kind}', '{f.name}', {f.ord}, {f.key}, '{f.kind}', TRUE {_from(b)}" for f in b.fields if fields is None or f.name in fields]
    return "\nUNION ALL ".join(parts)


def reach_sql(kinds: Iterable[str] | None = None, onts: Iterable[str] | None = None) -> str:
    parts = [values_sql([r for r in schema_rows()["reach"] if (kinds is None or r[2] in kinds) and (onts is None or "schema" in onts)], REACH)]
    for b in chosen(kinds, onts):
        parts += [f"SELECT {'DISTINCT ' if b.distinct else ''}'{b.ont}', {b.key}, '{b.kind}', {k}, '{kind}', {ann} {_from(b)}" for k, kind, ann in inside(b)]
    return "\nUNION ALL ".join(parts)


def literal_sql(kinds: Iterable[str] | None = None) -> str:
    parts = [values_sql(literal_rows(kinds), LITERAL)]
    for b in chosen(kinds, None):
        parts += [f"SELECT '{b.ont}', {b.key}, {f.lexical}, {f.language}, '{f.datatype}' {_from(b)}" for f in b.fields if f.kind == "OWLLiteral"]
    return "\nUNION ALL ".join(parts)


def node_sql() -> str:
    return values_sql(schema_rows()["node"], NODE)


def import_sql() -> str:
    return values_sql(import_rows(), IMPORT)


def annot_sql() -> str:
    return values_sql(schema_rows()["ont_annot"], ONT_ANNOT)


def ontology_sql() -> str:
    return values_sql([o[:3] for o in ONTOLOGIES], "ont_id string, ontology_iri string, version_iri string")
