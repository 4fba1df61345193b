"""The hierarchy of object properties: inclusions, properties that are not simple, and the order that chains ask for.

A property expression is written with its sign: + and its IRI, or - and the IRI of the property that it inverts. What holds of
a property below another holds of their inverses too, so every inclusion comes with its mirror image.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ResourceLimitError
from ..model import BY_KEYWORD, OWL
from ..plans.projection import Store
from ..staging import stored
from .graph import reachable

_TOP, _BOTTOM = "+" + OWL + "topObjectProperty", "+" + OWL + "bottomObjectProperty"


def signed(key: str | Column) -> Column:
    """The signed name of a property's key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.when(key.startswith("ObjectInverseOf("), "-").otherwise("+"), F.regexp_extract(key, "<(.*)>", 1))


def mirrored(name: str | Column) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.concat(F.when(name.startswith("+"), "-").otherwise("+"), F.substring(name, 2, 1 << 20))


def key_of(name: str) -> Column:
    """The key of a signed name."""
    plain = F.concat(F.lit("ObjectProperty(<"), F.substring(name, 2, 1 << 20), F.lit(">)"))
    return F.when(F.col(name).startswith("-"), F.concat(F.lit("ObjectInverseOf("), plain, F.lit(")"))).otherwise(plain)


def _field(s: Store, keyword: str, field: str, name: str) -> DataFrame:
    return s.edges([BY_KEYWORD[keyword].kind], [field]).select("ont_id", "parent_key", "ord", signed("child_key").alias(name))


def inclusions(s: Store) -> DataFrame:
    """(src, dst): src is below dst by one axiom, mirror images included."""
    on = ["ont_id", "parent_key"]
    sub = _field(s, "SubObjectPropertyOf", "subProperty", "src").drop("ord").join(_field(s, "SubObjectPropertyOf", "superProperty", "dst").drop("ord"), on)
    # Equals by way of the least of them: a path joins any two, without all pairs.
    same = _field(s, "EquivalentObjectProperties", "properties", "dst")
    same = same.join(same.groupBy(*on).agg(F.min("dst").alias("src")), on)
    inverse = _field(s, "InverseObjectProperties", "properties", "name").groupBy(*on).agg(F.min_by("name", "ord").alias("src"), mirrored(F.max_by("name", "ord")).alias("dst"))
    symmetric = _field(s, "SymmetricObjectProperty", "property", "src").withColumn("dst", mirrored("src"))
    one_way = [sub.select("src", "dst")]
    both_ways = [f.select(*c) for f in (same, inverse, symmetric) for c in (("src", "dst"), (F.col("dst").alias("src"), F.col("src").alias("dst")))]
    edges = reduce(DataFrame.union, one_way + both_ways)
    return edges.union(edges.select(mirrored("src"), mirrored("dst"))).where("src <> dst").distinct()


def nonsimple_names(s: Store) -> DataFrame:
    """(name): top and bottom, transitive properties, heads of chains, their inverses, and all that is above one of them."""
    seeds = _field(s, "TransitiveObjectProperty", "property", "src").select("src").union(_field(s, "SubPropertyChainOf", "superProperty", "src").select("src"))
    seeds = seeds.union(seeds.select(mirrored("src"))).union(s.spark.createDataFrame([(_TOP,), (_BOTTOM,)], "src string"))
    return reachable(inclusions(s), seeds, reflexive=True).select(F.col("dst").alias("name")).distinct()


def nonsimple_properties(s: Store) -> DataFrame:
    """Keys of the property expressions that are not simple."""
    return nonsimple_names(s).select(key_of("name").alias("property"))


#: What only simple properties may stand in.
SIMPLE_ONLY = [BY_KEYWORD[k].kind for k in ("ObjectMinCardinality", "ObjectMaxCardinality", "ObjectExactCardinality", "ObjectHasSelf", "FunctionalObjectProperty", "InverseFunctionalObjectProperty", "IrreflexiveObjectProperty", "AsymmetricObjectProperty", "DisjointObjectProperties")]


def nonsimple_uses(s: Store) -> DataFrame:
    """Property expressions that are not simple where only simple ones may stand."""
    e = s.edges(SIMPLE_ONLY, ["property", "properties"], nested=True).withColumn("name", signed("child_key"))
    return e.join(nonsimple_names(s), "name", "left_semi").select("parent_key", "child_key").distinct()


def irregular_hierarchy(s: Store, rounds: int = 50) -> DataFrame:
    """(lower, upper): pairs that a chain puts in order though upper is, by inclusions, below lower or the same; none if the
    hierarchy is regular.

    A chain puts each of its properties below its head, but not where it is head head -> head or ends in top; a head at the
    chain's beginning, or else at its end, is left out. With a named head the order holds for the inverse of the lower too,
    which goes for pairs that follow from others as well."""
    chain = _field(s, "SubPropertyChainOf", "chain", "item").join(_field(s, "SubPropertyChainOf", "superProperty", "head").drop("ord"), ["ont_id", "parent_key"])
    ends = chain.groupBy("ont_id", "parent_key").agg(F.min_by("item", "ord").alias("first"), F.max_by("item", "ord").alias("last"), F.max("ord").alias("most"), F.min("ord").alias("least"))
    c = chain.join(ends, ["ont_id", "parent_key"])
    head, first = F.col("head"), F.col("first") == F.col("head")
    square = first & (F.col("last") == head) & (F.col("most") - F.col("least") == 1)
    spared = (first & (F.col("ord") == F.col("least"))) | (~first & (F.col("last") == head) & (F.col("ord") == F.col("most")))
    below = c.where(~square & (head != _TOP) & ~spared).select(F.col("item").alias("src"), head.alias("dst"))
    named = lambda e: e.where(F.col("dst").startswith("+")).select(mirrored("src").alias("src"), "dst")
    order = below.union(named(below)).distinct()
    for _ in range(rounds):
        every = reachable(order)
        grown = stored(every.union(named(every)).distinct(), "property-order")
        if grown.join(every, ["src", "dst"], "left_anti").isEmpty():
            break
        order = grown
    else:
        raise ResourceLimitError(f"an order of more than {rounds} rounds")
    above = reachable(inclusions(s))
    back = every.join(above.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_semi")
    return every.where("src = dst").union(back.select("src", "dst")).distinct().select(F.col("src").alias("lower"), F.col("dst").alias("upper"))


def cyclic_datatypes(s: Store) -> DataFrame:
    """Datatypes whose definition, by what stands in its data range, leads back to them."""
    kind = BY_KEYWORD["DatatypeDefinition"].kind
    field = lambda f, name: s.edges([kind], [f]).select("ont_id", "parent_key", F.col("child_key").alias(name))
    ranges = field("dataRange", "node").join(field("datatype", "datatype"), ["ont_id", "parent_key"])
    inside = s.edges([BY_KEYWORD[k].kind for k in ("DataIntersectionOf", "DataUnionOf", "DataComplementOf", "DatatypeRestriction")], nested=True).select(F.col("parent_key").alias("src"), F.col("child_key").alias("dst"))
    parts = reachable(inside, ranges.select(F.col("node").alias("src")), reflexive=True)
    uses = ranges.join(parts, F.col("node") == F.col("src")).where(F.col("dst").startswith("Datatype(")).select(F.col("datatype").alias("src"), "dst").distinct()
    return reachable(uses).where("src = dst").select(F.col("src").alias("datatype"))
