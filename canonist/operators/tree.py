"""Trees of nodes. A node: version, id, parent (null for a root), type, text, ord; maybe lang. Ids are unique in a version (and language).
ord rises in document order, depth first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, merge
from .ranges import near


def keys_of(nodes: DataFrame) -> list[str]:
    """What an id is unique in."""
    return [c for c in ("version", "lang") if c in nodes.columns]


def closure(nodes: DataFrame) -> DataFrame:
    """version (and lang), id, ancestor, distance; a node is its own ancestor at 0. Pointer doubling: jumps of 1, 2, 4, ... steps are each
    joined of two jumps half as long, and lead on to all that is reached in fewer steps, so a tree of depth d takes about log d rounds, each
    stored; once no jump is left there is nothing further to reach. A chain that returns to its node is an error."""
    keys, scratch = keys_of(nodes), Scratch(nodes.sparkSession)
    at = lambda df, id_, ancestor, distance: df.select(*keys, F.col(id_).alias("id"), F.col(ancestor).alias("ancestor"), distance.cast("int").alias("distance"))
    up = scratch.stored(nodes.select(*keys, "id", "parent"), "parents")
    jump, steps, reached = at(up.filter("parent is not null"), "id", "parent", F.lit(1)), 1, None
    while not jump.isEmpty():
        new = jump
        if reached is not None:
            on = reached.select(*keys, F.col("id").alias("ancestor"), F.col("ancestor").alias("above"), F.col("distance").alias("more"))
            new = scratch.stored(new.unionByName(at(jump.join(merge(on), [*keys, "ancestor"]), "id", "above", F.col("more") + steps)), "level")
        if not new.filter("id = ancestor").isEmpty():
            raise ValueError("the parents of some nodes lead back to them")
        reached = new if reached is None else reached.unionByName(new)
        half = jump.select(*keys, F.col("id").alias("ancestor"), F.col("ancestor").alias("above"))
        steps *= 2
        jump = scratch.stored(at(jump.join(merge(half), [*keys, "ancestor"]), "id", "above", F.lit(steps)), "jumps")
    own = at(up, "id", "id", F.lit(0))
    return merge(own if reached is None else own.unionByName(reached))


def positions(rows: DataFrame, *order: str, named: str = "pos") -> DataFrame:
    """rows with pos (or as named), the number of rows before each in this order. Rows are dealt by ranges and numbered in each; the ranges' sizes,
    a row for each range, give the offsets: no task holds more than its range."""
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    laid = Scratch(rows.sparkSession).stored(laid.withColumn("__part", F.shiftright("__at", 33)), "positions")
    sizes = laid.groupBy("__part").agg(F.count("*").alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return laid.join(F.broadcast(offsets), "__part").withColumn(named, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__part", "__at", "__before")


def descendants(nodes: DataFrame, chain: DataFrame) -> DataFrame:
    """version, ancestor, id, nth: what lies below each node, numbered in document order. Depth first, what lies below a node follows it
    without a gap, so the number is a difference of positions."""
    keys = keys_of(nodes)
    at = positions(nodes.select(*keys, "id", "ord"), *keys, "ord").select(*keys, "id", "pos")
    below = chain.filter("distance > 0").join(merge(at), [*keys, "id"]).join(merge(at.select(*keys, F.col("id").alias("ancestor"), F.col("pos").alias("own"))), [*keys, "ancestor"])
    return below.select(*keys, "ancestor", "id", (F.col("pos") - F.col("own")).cast("int").alias("nth"))


def nearest(nodes: DataFrame, chain: DataFrame, where: Column, value: Column) -> DataFrame:
    """version, id, value: that of the nearest ancestor (or the node) that satisfies a condition on its own columns."""
    keys = keys_of(nodes)
    good = nodes.filter(where).select(*keys, F.col("id").alias("ancestor"), value.alias("value"))
    return chain.join(merge(good), [*keys, "ancestor"]).groupBy(*keys, "id").agg(F.min_by("value", "distance").alias("value"))


def _own_texts(nodes: DataFrame) -> DataFrame:
    """version, id, ord, text of nodes that have one, with their heading in front."""
    texts = F.array("heading", "text") if "heading" in nodes.columns else F.array("text")
    return nodes.select(*keys_of(nodes), "id", "ord", F.array_join(F.filter(texts, lambda t: t.isNotNull() & (t != "")), "\n").alias("text")).filter("text != ''")


def subtree_rows(nodes: DataFrame, chain: DataFrame) -> DataFrame:
    """version, id, ord, text: a row for each text (headings too, where nodes have them) at or below a node; empty ones left out."""
    keys = keys_of(nodes)
    return chain.join(merge(_own_texts(nodes)), [*keys, "id"]).select(*keys, F.col("ancestor").alias("id"), "ord", "text")


def subtree_text(nodes: DataFrame, chain: DataFrame, most: int = 1 << 28) -> DataFrame:
    """version, id, text: subtree_rows in order, joined by line feeds. A text of more than `most` characters would fill a task, so
    its cell is null; its rows are those of subtree_rows. Lengths tell beforehand which texts are joined: those of cells that are null are never copied to
    their ancestors, and a text that is alone goes out as it is."""
    keys, own = keys_of(nodes), _own_texts(nodes)
    sizes = chain.join(merge(own.select(*keys, "id", F.length("text").alias("size"))), [*keys, "id"]).groupBy(*keys, "ancestor").agg(F.count("*").alias("n"), (F.sum(F.col("size") + 1) <= most).alias("fits"))
    sizes = Scratch(nodes.sparkSession).stored(sizes, "sizes")
    asked = lambda which: chain.join(merge(sizes.filter(which).select(*keys, "ancestor")), [*keys, "ancestor"]).join(merge(own), [*keys, "id"])
    id_ = F.col("ancestor").alias("id")
    one = asked("fits and n = 1").select(*keys, id_, "text")
    several = asked("fits and n > 1").groupBy(*keys, "ancestor").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("x")).select(*keys, id_, F.array_join(F.transform("x", lambda x: x["text"]), "\n").alias("text"))
    return one.unionByName(several).unionByName(sizes.filter("not fits").select(*keys, id_, F.lit(None).cast("string").alias("text")))


#: Types whose siblings are the family of their number (60, 60a) and the node before and after it.
ROOTS = ("article", "annex", "recital")


def neighbours(nodes: DataFrame, other: DataFrame, most: int = 30) -> DataFrame:
    """version, id, before, after, children, siblings (how many), nearest (id and missing of the `most` nearest siblings by distance
    of ord, ties to the earlier one, in document order), missing (not in the other version). Nodes are laid out in order and dealt by
    blocks of places, so no task holds all children of a parent, or all roots. most: 0 where nobody asks for the nearest."""
    kids = nodes.filter("parent is not null").groupBy("version", F.col("parent").alias("id")).agg(F.count("id").alias("children"))
    there = other.select("id", F.lit(False).alias("gone")).distinct()
    root, number = F.col("type").isin(*ROOTS), F.nullif(F.regexp_extract("id", r"^([a-z]+_\d+)[a-z]*$", 1), F.lit(""))
    out = nodes.join(merge(there), "id", "left").withColumn("missing", F.coalesce("gone", F.lit(True)))
    out = out.select("version", "id", "parent", "type", "ord", "missing", F.when(~root, F.col("parent")).alias("p"), F.when(root | F.col("parent").isNull(), F.col("type")).alias("t"), F.when(root, F.coalesce(number, F.col("id"))).alias("f"))
    own = F.struct("ord", "id", "missing")
    out = near(out, ["version", "parent", "type"], ["ord", "id"], own, 1)
    at = lambda step: F.get(F.filter("near", lambda x: x["place"] == F.col("place") + step), F.lit(0))["value"]
    out = out.select(*[c for c in out.columns if c not in ("near", "place", "block")], at(-1).alias("prev"), at(1).alias("next"))
    # no sibling among the nearest is more than `most` places away
    group = ["version", "p", "t", "f"]
    out = near(out, group, ["ord", "id"], own, most)

    def closest(held: Column) -> Column:
        far = F.transform(F.filter(held, lambda x: x["id"] != F.col("id")), lambda x: F.struct(F.abs(x["ord"] - F.col("ord")).alias("far"), x["ord"].alias("ord"), x["id"].alias("id"), x["missing"].alias("missing")))
        return F.array_sort(F.transform(F.slice(F.array_sort(far), 1, most), lambda x: F.struct(x["ord"].alias("ord"), x["id"].alias("id"), x["missing"].alias("missing"))))

    # of the rows on both sides only the nearest are stored; those at the edges of the group may still be nearer
    out = Scratch(nodes.sparkSession).stored(out.withColumn("near", closest(F.transform("near", lambda x: x["value"]))).drop("place"), "near")
    known = out.groupBy(*group).agg(F.count("id").alias("n"), F.min_by(F.when(root, F.col("prev")), "ord").alias("first"), F.max_by(F.when(root, F.col("next")), "ord").alias("last"))
    alike = lambda a, b: [a[c].eqNullSafe(b[c]) for c in group]
    # what is known of a group goes to its blocks first, then to the rows of each: a large group is no hot key
    spread = out.select(*group, "block").distinct().alias("s").join(merge(known).alias("k"), alike(_of("s"), _of("k"))).select("s.*", "k.n", F.array_compact(F.array("k.first", "k.last")).alias("edges"))
    out = out.alias("o").join(merge(spread).alias("s"), [F.col("o.block") == F.col("s.block"), *alike(_of("o"), _of("s"))]).select("o.*", "s.n", "s.edges")
    told = F.transform(F.when(F.size("edges") > 0, closest(F.concat("near", "edges"))).otherwise(F.col("near")), lambda x: F.struct(x["id"].alias("id"), x["missing"].alias("missing")))
    return out.join(merge(kids), ["version", "id"], "left").select("version", "id", F.col("prev.id").alias("before"), F.col("next.id").alias("after"), F.coalesce("children", F.lit(0)).alias("children"), (F.col("n") - 1 + F.size("edges")).alias("siblings"), told.alias("nearest"), "missing")


def _of(name: str) -> dict[str, Column]:
    return {c: F.col(f"{name}.{c}") for c in ("version", "p", "t", "f")}


def violations(nodes: DataFrame) -> DataFrame:
    """version, id, what: duplicate ids, missing parents, parents that come later, gaps in ord, empty leaves, odd ids."""
    twice = nodes.groupBy("version", "id").count().filter("count > 1").select("version", "id", F.lit("duplicate_id").alias("what"))
    parents = nodes.select("version", F.col("id").alias("parent"), F.col("ord").alias("pord")).distinct()
    held = nodes.filter("parent is not null").join(merge(parents), ["version", "parent"], "left")
    orphan = held.filter("pord is null").select("version", "id", F.lit("missing_parent").alias("what"))
    later = held.filter("pord >= ord").select("version", "id", F.lit("parent_after_child").alias("what"))
    odd = nodes.filter("parent is not null and not (startswith(id, concat(parent, '.')) and instr(substr(id, length(parent) + 2), '.') = 0)").select("version", "id", F.lit("odd_id").alias("what"))
    at = positions(nodes.select("version", "id", "ord"), "version", "ord")
    before = at.select("version", (F.col("pos") + 1).alias("pos"), F.col("ord").alias("last"))
    gap = at.join(merge(before), ["version", "pos"]).filter("ord - last > 1").select("version", "id", F.lit("gap").alias("what"))
    inner = nodes.filter("parent is not null").select("version", F.col("parent").alias("id")).distinct()
    empty = nodes.filter("text = ''").join(merge(inner), ["version", "id"], "left_anti").select("version", "id", F.lit("empty").alias("what"))
    out = twice
    for one in (orphan, later, odd, gap, empty):
        out = out.unionByName(one)
    return out
