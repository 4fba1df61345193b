"""Change logs and transformations: folds of a log into a state, and changes that renaming and removing make."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.literals import SPARK, short_form
from ..model import RDF, RDFS, TYPE_INDEX
from ..plans.projection import EX, Store, axioms_of
from ..plans.unique import can_hold
from .structural import referencing

LOG = "'ClassAssertion(Class(<urn:ex:event/' || event_type || '>) NamedIndividual(<urn:ex:user/' || CAST(user_id AS VARCHAR(20)) || '>))'"


def event_log(s: Store) -> DataFrame:
    """The events as a change log: seq, ts, op, axiom_key. Every third event takes its axiom back."""
    op = F.when(F.col("event_id") % 3 == 0, "remove").otherwise("add")
    return s.table("events").select(F.col("event_id").alias("seq"), "ts", op.alias("op"), F.expr(LOG).alias("axiom_key"))


def folded(log: DataFrame) -> DataFrame:
    """axiom_key, op: the last change of each axiom. An aggregate, so no log of one axiom is sorted in one place."""
    return log.groupBy("axiom_key").agg(F.max_by("op", F.struct("ts", "seq")).alias("op"))


def applied(base: DataFrame, log: DataFrame) -> DataFrame:
    """The axioms of base after the changes of a log."""
    last = folded(log)
    kept = base.select("axiom_key").join(last.where("op = 'remove'"), "axiom_key", "left_anti")
    return kept.union(last.where("op = 'add'").select("axiom_key")).distinct()


def applied_one_by_one(base: DataFrame, log: DataFrame) -> DataFrame:
    """seq, axiom_key, op, status of a log that is applied change by change: SUCCESSFULLY where it changes the set, NO_OPERATION
    where the axiom is there already, or is not there to remove. The change before it of the same axiom tells, or the base; one
    axiom's changes are sorted in one place, which spills."""
    before = F.lag("op").over(Window.partitionBy("axiom_key").orderBy("ts", "seq"))
    rows = log.withColumn("before", before).join(base.select("axiom_key").distinct().withColumn("there", F.lit(True)), "axiom_key", "left")
    present = F.when(F.col("before").isNull(), F.coalesce("there", F.lit(False))).otherwise(F.col("before") == "add")
    return rows.select("seq", "axiom_key", "op", F.when((F.col("op") == "add") != present, "SUCCESSFULLY").otherwise("NO_OPERATION").alias("status"))


def net_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """op, axiom_key: what turns one set of axioms into another; empty where a commit would change nothing."""
    b, a = before.select("axiom_key", F.lit(1).alias("b")), after.select("axiom_key", F.lit(1).alias("a"))
    both = b.join(a, "axiom_key", "full_outer")
    return both.where("a IS NULL OR b IS NULL").select(F.when(F.col("a").isNull(), "remove").otherwise("add").alias("op"), "axiom_key")


def rename(axioms: DataFrame, old: str, new: str, keyword: str | None = None) -> DataFrame:
    """op, axiom_key: removal of each axiom that holds an IRI, and addition of what it becomes. With a keyword only that
    kind of entity is renamed, so other entities with the same IRI stay."""
    was, now = (f"{keyword}(<{x}>)" if keyword else f"<{x}>" for x in (old, new))
    hit = axioms.where(F.instr("axiom_key", was) > 0).select("axiom_key", F.replace("axiom_key", F.lit(was), F.lit(now)).alias("_new"))
    return hit.select(F.explode(F.array(F.struct(F.lit("remove").alias("op"), F.col("axiom_key").alias("axiom_key")), F.struct(F.lit("add").alias("op"), F.col("_new").alias("axiom_key")))).alias("x")).select("x.op", "x.axiom_key").distinct()


def removal(s: Store, key: str, iri: str, kinds) -> DataFrame:
    """ont_id, axiom_key of everything that goes with an entity: axioms that refer to it, and annotations of its IRI. One
    that is both comes twice."""
    subject = s.edges(["OWLAnnotationAssertionAxiom"], ["subject"], key=f"<{iri}>")
    return referencing(s, key, kinds=kinds).unionAll(subject.select("ont_id", F.col("parent_key").alias("axiom_key")))


def duplicate(axioms: DataFrame, iris: dict[str, str], scope: str, fresh: str) -> DataFrame:
    """Axioms with IRIs replaced and anonymous individuals in a scope of their own."""
    out: Column = F.col("axiom_key")
    for a, b in sorted(iris.items()):
        out = F.replace(out, F.lit(f"<{a}>"), F.lit(f"<{b}>"))
    return axioms.select(F.regexp_replace(out, rf"(_:[^\s()@]+)@{scope}", rf"$1@{fresh}").alias("axiom_key")).distinct()


def duplicate_of(s: Store, kinds, iris: dict[str, str], scope: str, fresh: str) -> DataFrame:
    """duplicate() of a store's axioms. Only what holds an IRI or a scope, old or new, can change or meet what changed; all else
    stays as it is and has no repeats."""
    marks = [*(f"<{x}>" for ab in sorted(iris.items()) for x in ab), f"@{scope}", f"@{fresh}"]
    found, rest = s.unique_parts(kinds)
    kept, open_ = [], [rest.select("axiom_key")]
    for x in found:
        rows = axioms_of(x).select("axiom_key")
        some = [m for m in marks if can_hold(x.pattern, m)]
        if some:
            marked = reduce(Column.__or__, (F.contains("axiom_key", F.lit(m)) for m in some))
            open_.append(rows.where(marked))
            rows = rows.where(~marked)
        kept.append(rows)
    return reduce(DataFrame.union, [duplicate(reduce(DataFrame.union, open_), iris, scope, fresh), *kept])


def preferred_labels(assertions: DataFrame, properties: list[str], languages: dict[str, list[str]]) -> DataFrame:
    """subject_key, label: for each subject the short form that annotations give, by a fold in encounter order.

    assertions: subject_key, property_key, value_key, value_kind, lexical, lang. An IRI always takes the place of the
    choice so far; a literal only if its language ranks better than every literal before it; the best rank ends a property."""
    rank_of = F.lit(None).cast("int")
    for prop, langs in languages.items():
        ranks = F.array_position(F.array(*(F.lit(x) for x in langs)), F.col("lang")).cast("int") - 1
        rank_of = F.when(F.col("property_key") == prop, ranks).otherwise(rank_of)
    preferred = F.col("property_key").isin(list(languages))
    rank = F.when(F.col("value_kind") == "IRI", F.lit(-2)).when(preferred, rank_of).otherwise(F.lit(0))
    order = F.array_position(F.array(*(F.lit(x) for x in properties)), F.col("property_key"))
    text = F.when(F.col("value_kind") == "IRI", F.expr(short_form(SPARK, "substr(value_key, 2, length(value_key) - 2)"))).otherwise(F.col("lexical"))
    shown = F.struct(F.when(F.col("value_kind") == "IRI", TYPE_INDEX["IRI"]).otherwise(TYPE_INDEX["OWLLiteral"]).alias("type"), "value_key", rank.alias("rank"), text.alias("text"))
    rows = assertions.where(F.col("property_key").isin(properties)).select("subject_key", order.alias("order"), shown.alias("shown"))
    per = rows.groupBy("subject_key", "order").agg(F.array_sort(F.collect_list("shown")).alias("values"))
    start = F.struct(F.lit(None).cast("string").alias("text"), F.lit(2147483647).alias("best"))

    def step(state: Column, v: Column) -> Column:
        done = state["best"] == 0
        counts = (v["rank"] >= 0) & (v["rank"] < state["best"])
        return F.when(done, state).when(v["rank"] == -2, F.struct(v["text"].alias("text"), state["best"].alias("best"))).when(counts, F.struct(v["text"].alias("text"), v["rank"].alias("best"))).otherwise(state)

    chosen = per.select("subject_key", "order", F.aggregate("values", start, step)["text"].alias("text"))
    best = chosen.groupBy("subject_key").agg(F.min_by("text", F.when(F.col("text").isNotNull(), F.col("order"))).alias("text"))
    own = F.expr(short_form(SPARK, "substr(subject_key, 2, length(subject_key) - 2)"))
    return best.select("subject_key", F.coalesce("text", own).alias("label"))


def triples(s: Store, onts=None) -> DataFrame:
    """subject, predicate, object, graph: RDF of the axioms whose terms all have names; entities of nested expressions
    need blank nodes and go through mapping.to_triples."""
    plain = lambda c: F.regexp_replace(c, r"^[A-Za-z]+\((<.*>)\)$", "$1")
    parts = []
    fixed = {
        "OWLSubClassOfAxiom": ("subClass", "superClass", f"<{RDFS}subClassOf>"), "OWLSubObjectPropertyOfAxiom": ("subProperty", "superProperty", f"<{RDFS}subPropertyOf>"),
        "OWLSubDataPropertyOfAxiom": ("subProperty", "superProperty", f"<{RDFS}subPropertyOf>"), "OWLClassAssertionAxiom": ("individual", "classExpression", f"<{RDF}type>"),
        "OWLObjectPropertyDomainAxiom": ("property", "domain", f"<{RDFS}domain>"), "OWLDataPropertyDomainAxiom": ("property", "domain", f"<{RDFS}domain>"),
        "OWLObjectPropertyRangeAxiom": ("property", "range", f"<{RDFS}range>"), "OWLDataPropertyRangeAxiom": ("property", "range", f"<{RDFS}range>"),
    }
    named = r"^([A-Za-z]+\()?<[^<>]*>\)?$"
    for kind, (a, b, p) in fixed.items():
        rows = s.pairs([kind], a, b, onts)
        parts.append(rows.where(F.col("left_key").rlike(named) & F.col("right_key").rlike(named)).select(plain(F.col("left_key")).alias("subject"), F.lit(p).alias("predicate"), plain(F.col("right_key")).alias("object"), F.col("ont_id").alias("graph")))
    e = s.rows(["OWLObjectPropertyAssertionAxiom", "OWLDataPropertyAssertionAxiom", "OWLAnnotationAssertionAxiom"], ["subject", "property", "value"], onts)
    parts.append(e.select(plain(F.col("subject_key")).alias("subject"), plain(F.col("property_key")).alias("predicate"), plain(F.col("value_key")).alias("object"), F.col("ont_id").alias("graph")))
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    # Axioms are sets already; only axioms that differ in their annotations give a triple twice, and the tables have none.
    return out.where("graph = 'schema'").distinct().union(out.where("graph <> 'schema'"))


#: Bytes of the tables behind axioms, by the optimizer's estimate, for each range that they are sorted in.
RANGE_BYTES = 8 << 20


def display_order(axioms: DataFrame) -> DataFrame:
    """ont_id, axiom_key, place: axioms of each ontology by the index of their kind, then by key in UTF-16 code units, null last.
    Axioms are dealt by ranges of that order, sorted and numbered inside each where they are dealt; an ontology's axioms in the
    ranges before (a row for each range and ontology, sent to all tasks) make the place, so axioms are exchanged once."""
    from ..staging import stored

    index = F.element_at(F.create_map(*(x for k, i in TYPE_INDEX.items() for x in (F.lit(k), F.lit(i)))), F.col("kind"))
    rows = axioms.select("ont_id", index.alias("index"), F.encode("axiom_key", "UTF-16BE").alias("units"))
    order = ["ont_id", "index", F.asc_nulls_last("units")]
    size = int(str(axioms._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # beyond all bounds where it is unknown
    n = size // RANGE_BYTES
    few = size >= 1 << 60 or n <= int(axioms.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = (rows.repartitionByRange(*order) if few else rows.repartitionByRange(min(n, 10_000), *order)).sortWithinPartitions(*order)
    id = F.monotonically_increasing_id()  # the task's number and, in 33 bits, the row's
    rows = stored(rows.select("ont_id", F.decode("units", "UTF-16BE").alias("axiom_key"), id.alias("id")), "display-order")
    rows = rows.withColumn("part", F.shiftright("id", 33))
    before = rows.groupBy("ont_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = before.select("ont_id", "part", (F.sum("n").over(Window.partitionBy("ont_id").orderBy("part")) - F.col("n") - F.col("first")).alias("more"))
    return rows.join(F.broadcast(before), ["ont_id", "part"]).select("ont_id", "axiom_key", (F.col("id") + F.col("more") + 1).alias("place"))


RENAMED = {f"{EX}Customer": f"{EX}Buyer2", f"{EX}Party": f"{EX}Agent"}


def ontology_state(log: DataFrame) -> DataFrame:
    """ont_id, part, key after a log of all kinds of changes (ont_id, part, key, op, ts, seq). part is axiom, import or
    annotation, whose last change of a key counts, or id, whose last change of the ontology counts."""
    last = lambda df, *by: df.groupBy(*by).agg(F.max_by(F.struct("op", "key"), F.struct("ts", "seq")).alias("x")).select(*by, "x.op", *([] if "key" in by else ["x.key"]))
    members = last(log.where("part <> 'id'"), "ont_id", "part", "key").where("op = 'add'").select("ont_id", "part", "key")
    return members.union(last(log.where("part = 'id'"), "ont_id", "part").select("ont_id", "part", "key"))
