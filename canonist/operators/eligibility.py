"""Which obligations apply to which profiles, from when, and which unanswered question would change that.

A condition is a nested dict: {"all": [...]}, {"any": [...]}, {"not": c}, {"eq": [field, value]}, {"in": [field, [values]]},
{"has": [field, value]} (field is an array) or {"before": [field, date]} (ISO strings). An absent field makes a leaf false.
An obligation: id, roles (any of them; empty: everyone), applies_if (or None), and effective (ISO date or None), not_before (or None); or
timing: basis (transition, with date; hr_route, with route and literal_rule; deadline_table, with rule, literal_rule or anchor),
not_before. Obligations, conditions and the rules' dates are a plan's text and live on the driver; profiles are rows and never do."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, is_iso_date
from ..sources.scratch import Scratch, merge
from .ranges import summed
from .ranges import summed


def condition(c: dict | None) -> Column:
    """The column that a condition states."""
    if not c:
        return F.lit(True)
    ((kind, x),) = c.items()
    if kind in ("all", "any"):
        return reduce(and_ if kind == "all" else or_, map(condition, x), F.lit(kind == "all"))
    if kind == "not":
        return ~condition(x)
    field, value = x
    leaves = {"eq": lambda: F.col(field) == value, "in": lambda: F.col(field).isin(value), "has": lambda: F.array_contains(field, value), "before": lambda: F.col(field) < value}
    if kind not in leaves:
        raise ValueError(f"unknown condition: {kind}")
    return F.coalesce(leaves[kind](), F.lit(False))


def fields_of(c: dict | None) -> set[str]:
    if not c:
        return set()
    ((kind, x),) = c.items()
    return set().union(*map(fields_of, x)) if kind in ("all", "any") else fields_of(x) if kind == "not" else {x[0]}


def with_derived(profiles: DataFrame, derived: dict[str, dict]) -> DataFrame:
    """profiles with boolean columns that conditions over fields and other derived columns define; a cycle is an error."""
    left, done = dict(derived), profiles
    while left:
        ready = {name: condition(c) for name, c in left.items() if not fields_of(c) & left.keys()}
        if not ready:
            raise ValueError(f"derived fields refer to each other: {sorted(left)}")
        done = done.withColumns(ready)
        left = {name: c for name, c in left.items() if name not in ready}
    return done


#: Rules of the two routes, the one that only simplifies them, and the default's name.
ROUTE_RULES = {"annex_iii": ("high_risk_annex_iii", "art6-par2-annex3"), "annex_i": ("high_risk_annex_i", "art6-par1-annex1")}
SIMPLIFIED, DEFAULT = "ch3s1-3", "default"


def spec_of(description: str) -> dict:
    """type, values and default of a profile field, from the first clause of its description."""
    head, quoted = description.split(";")[0].strip(), re.findall(r"'([^']+)'", description.split(";")[0])
    if head.startswith("bool"):
        return {"type": "boolean", "default": head.endswith("true")}
    if head.startswith("array of enum "):
        return {"type": "enum_array", "values": head.removeprefix("array of enum ").split("|")}
    if head == "null or ISO date":
        return {"type": "date"}
    if head.startswith("null or string ") and len(quoted) == 2:
        return {"type": "enum", "values": [str(i) for i in range(int(quoted[0]), int(quoted[1]) + 1)]}
    if head.startswith("null or enum "):
        return {"type": "enum", "values": quoted}
    return {"type": "enum", "values": head.removeprefix("enum ").split("|")} if head.startswith("enum ") else {"type": "any"}


def _others(c: Column, values: list[str]) -> Column:
    return F.exists(c, lambda x: F.coalesce(~x.isin(*values), F.lit(True)))


def normalized(profiles: DataFrame, fields: dict[str, str], key: str = "profile_id", required: str = "role") -> tuple[DataFrame, DataFrame]:
    """(profiles that are right, with defaults filled in; rejects: id, field, why). fields: description by name; columns that are no field
    are unknown fields wherever they are set. A missing boolean is its default, any other missing field stays null."""
    reject, filled = [], {}
    wrong = lambda name, bad, why: reject.append(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(name).alias("field"), F.lit(why).alias("why"))))
    for name in profiles.columns:
        if name not in fields and name not in (key, "as_of"):
            wrong(name, F.col(name).isNotNull(), "unknown field")
    for name, description in fields.items():
        if name not in profiles.columns:
            continue
        c, spec = F.col(name), spec_of(description)
        if spec["type"] == "enum_array":
            wrong(name, _others(c, spec["values"]), f"not of {'|'.join(spec['values'])}")
            filled[name] = F.array_distinct(c)
        elif spec["type"] == "enum":
            wrong(name, ~c.isin(*spec["values"]), f"not one of {'|'.join(spec['values'])}")
        elif spec["type"] == "date":
            wrong(name, c.isNotNull() & ~is_iso_date(c), "no calendar date")
        elif spec["type"] == "boolean":
            filled[name] = F.coalesce(c, F.lit(spec["default"]))
        if name == required:
            wrong(name, F.coalesce(F.size(c), F.lit(0)) <= 0, "missing")
    rejects = profiles.select(F.col(key).alias("id"), F.explode(F.array_compact(F.array(*reject))).alias("r")).select("id", "r.*")
    return profiles.join(rejects.select(F.col("id").alias(key)).distinct(), key, "left_anti").withColumns(filled), rejects


def entry_date(timing: dict, dates: dict[str, str], anchored: str | None = None) -> tuple[Column, Column, Column]:
    """(effective, literal: what the text alone would say, where that differs; routes: the dates of both routes where both are taken), by
    the timing's basis. dates: by rule; anchored: the date of the anchor's own rule."""
    none, text = F.lit(None).cast("string"), lambda d: F.lit(d).cast("string")
    bound = lambda d: F.greatest(d, text(timing.get("not_before")))
    nowhere = F.lit(None).cast("array<string>")
    if timing["basis"] == "transition":
        return text(timing.get("date")), none, nowhere
    if timing["basis"] == "hr_route":
        literal = bound(text(dates[timing.get("literal_rule", DEFAULT)]))
        other = {"annex_i": "annex_iii", "annex_iii": "annex_i"}.get(timing.get("route"))
        taken = [F.when(F.coalesce(F.col(field), F.lit(False)), text(dates[rule])) for route, (field, rule) in ROUTE_RULES.items() if route != other]
        routes = F.array_sort(F.array_compact(F.array(*taken)))
        start = F.when(F.size(routes) > 0, bound(routes[0])).otherwise(literal)
        apart = (F.size(routes) > 0) & (literal != start) & F.lit(timing.get("literal_rule") != SIMPLIFIED)
        return start, F.when(apart, literal), F.when(F.size(routes) > 1, routes)
    if timing["basis"] != "deadline_table":
        raise ValueError(f"unknown basis: {timing['basis']}")
    by_rule, by_text = dates.get(timing.get("rule")), dates.get(timing.get("literal_rule"))
    start = bound(text(by_rule or by_text or anchored or dates[DEFAULT]))
    return start, F.when(F.lit(bool(by_rule and by_text)) & (text(by_text) != start), text(by_text)), nowhere


def quotes_hold(entries: DataFrame, rows: DataFrame, least: int = 4096, whole: int = 1 << 18) -> DataFrame:
    """id, holds: is an entry's quotation still in the text at or below its anchor, white space aside? entries: id, anchor, quote; rows: id,
    ord, text (tree.subtree_rows of one version). False for anchors without text and null quotations.

    Texts of an anchor that come to `whole` characters at most are joined. Longer ones are one stream, cut into blocks of
    `least` characters, or of its longest quotation if that is longer; a quotation begins in some block and ends in the next at the latest, so
    no task needs more than two blocks at once."""
    plain = lambda c: F.trim(F.regexp_replace(c, SPACE, " "))
    scratch = Scratch(entries.sparkSession)
    told = scratch.stored(entries.select("id", "anchor", plain(F.col("quote")).alias("quote")), "asked")
    texts = scratch.stored(rows.select(F.col("id").alias("anchor"), "ord", plain(F.col("text")).alias("text")).filter("text != ''"), "texts")
    sizes = texts.groupBy("anchor").agg(F.sum(F.length("text") + 1).alias("n")).join(merge(told.groupBy("anchor").agg(F.greatest(F.lit(least), F.max(F.length("quote"))).alias("block"))), "anchor")
    sizes = scratch.stored(sizes, "sizes")
    short = texts.join(merge(sizes.filter(F.col("n") <= whole).select("anchor")), "anchor", "left_semi")
    joined = short.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("x")).select("anchor", F.array_join(F.transform("x", lambda x: x["text"]), " ").alias("text"))
    long = sizes.filter(F.col("n") > whole)
    if not long.isEmpty():
        joined = joined.unionByName(_pieces(texts.join(merge(long.select("anchor", "block")), "anchor")))
    met = told.join(merge(joined), "anchor").filter(F.contains("text", "quote")).select("id", F.lit(True).alias("met")).distinct()
    return told.join(merge(met), "id", "left").select("id", F.coalesce("met", F.lit(False)).alias("holds"))


def _pieces(texts: DataFrame) -> DataFrame:
    """anchor, text: of each block of an anchor's stream the text of it and the next one. texts: anchor, ord, text, block (how long)."""
    laid = summed(texts.withColumn("text", F.concat("text", F.lit(" "))), ["anchor"], ["ord"], F.length("text")).withColumn("end", F.col("start") + F.length("text"))
    over = F.sequence(F.floor(F.col("start") / F.col("block")), F.floor((F.col("end") - 1) / F.col("block")))
    cut = laid.withColumn("b", F.explode(over)).withColumn("from", F.greatest("start", F.col("b") * F.col("block")))
    piece = F.substring("text", (F.col("from") - F.col("start") + 1).cast("int"), F.col("block"))
    piece = F.left(piece, ((F.col("b") + 1) * F.col("block") - F.col("from")).cast("int"))
    dealt = cut.select("anchor", "from", piece.alias("piece"), F.explode(F.array("b", F.col("b") - 1)).alias("b")).filter("b >= 0")
    return dealt.groupBy("anchor", "b").agg(F.array_sort(F.collect_list(F.struct("from", "piece"))).alias("x")).select("anchor", F.array_join(F.transform("x", lambda x: x["piece"]), "").alias("text"))


def changed_dates(found: DataFrame, older: DataFrame, entries: DataFrame) -> DataFrame:
    """found with changed: an entry is marked as changed, or its anchor's date in the older version was another. older: id (a node),
    applies_from; entries: id, anchor, marked, timed (not by transition)."""
    told = entries.join(older.select(F.col("id").alias("anchor"), F.col("applies_from").alias("was")), "anchor", "left").select("id", "marked", "timed", "was")
    out = found.join(F.broadcast(told), "id", "left")
    moved = F.col("timed") & F.col("was").isNotNull() & F.col("effective").isNotNull() & (F.col("was") != F.col("effective"))
    return out.withColumn("changed", F.coalesce(F.col("marked"), F.lit(False)) | F.coalesce(moved, F.lit(False))).drop("marked", "timed", "was")


def obligations_of(profiles: DataFrame, obligations: list[dict], key: str = "profile_id", dates: dict[str, str] | None = None, anchored: dict[str, str] | None = None, scope: str | None = None) -> DataFrame:
    """key, as_of, id, effective (never before not_before; null where it depends), literal, routes, status (applicable, upcoming, depends),
    days until it applies (null where it depends). profiles hold roles (an array) and as_of (ISO string). One pass over the profiles, no
    join. dates: of the rules that timings name; anchored: of the anchors' own rules, by entry; scope: a field that is false where nothing
    applies at all."""
    inside = F.coalesce(F.col(scope), F.lit(True)) if scope else F.lit(True)

    def entry(o: dict) -> Column:
        role = F.coalesce(F.arrays_overlap("roles", F.array(*map(F.lit, o["roles"]))), F.lit(False)) if o.get("roles") else F.lit(True)
        if o.get("timing"):
            since, literal, routes = entry_date(o["timing"], dates or {}, (anchored or {}).get(o["id"]))
        else:
            date = F.lit(o.get("effective")).cast("string")
            since, literal, routes = F.when(date.isNull(), date).otherwise(F.greatest(date, F.lit(o.get("not_before")).cast("string"))), F.lit(None).cast("string"), F.lit(None).cast("array<string>")
        return F.when(inside & role & condition(o.get("applies_if")), F.struct(F.lit(o["id"]).alias("id"), since.alias("effective"), literal.alias("literal"), routes.alias("routes")))

    met = profiles.select(key, "as_of", F.explode(F.filter(F.array(*map(entry, obligations)), lambda e: e.isNotNull())).alias("e")).select(key, "as_of", "e.*")
    status = F.when(F.col("effective").isNull(), "depends").when(F.col("effective") <= F.col("as_of"), "applicable").otherwise("upcoming")
    return met.withColumn("status", status).withColumn("days", F.when(F.col("effective").isNotNull(), F.greatest(F.lit(0), F.datediff(F.to_date("effective"), F.to_date("as_of")))))


def ranked(found: DataFrame, key: str = "profile_id") -> DataFrame:
    """found with nth: by status as listed, date (nulls last), id, of each profile."""
    place = F.array_position(F.array(*map(F.lit, ("applicable", "upcoming", "depends"))), F.col("status"))
    return found.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(place, F.col("effective").asc_nulls_last(), "id")))


def timeline(found: DataFrame, key: str = "profile_id") -> DataFrame:
    """key, effective, ids: dates on or after as_of with what begins to apply, as one comma-joined string."""
    ahead = found.filter("effective >= as_of")
    return ahead.groupBy(key, "effective").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("ids"))


def open_questions(profiles: DataFrame, obligations: list[dict], fields: dict[str, list], derived: dict[str, dict] | None = None, key: str = "profile_id") -> DataFrame:
    """key, field: a field that a profile leaves null and of which some possible value changes the set of (id, effective)."""
    as_rows = [F.struct(F.lit(name).alias("field"), F.lit(i).alias("i")) for name, values in fields.items() for i in range(len(values))]
    probes = profiles.withColumn("__p", F.explode(F.array(F.struct(F.lit("").alias("field"), F.lit(-1).alias("i")), *as_rows)))
    null = reduce(or_, [(F.col("__p.field") == name) & F.col(name).isNull() for name in fields], F.col("__p.field") == "")
    probes = probes.filter(null)
    for name, values in fields.items():
        of_probe = F.get(F.array(*map(F.lit, values)), F.col("__p.i"))
        probes = probes.withColumn(name, F.when(F.col("__p.field") == name, of_probe).otherwise(F.col(name)))
    probes = probes.withColumn("__key", F.struct(F.col(key).alias("k"), "__p"))
    met = obligations_of(with_derived(probes, derived or {}), obligations, "__key").groupBy("__key").agg(F.array_sort(F.collect_set(F.struct("id", "effective"))).alias("signature"))
    every = probes.select("__key").join(met, "__key", "left").select(F.col("__key.k").alias(key), F.col("__key.__p.field").alias("field"), F.coalesce(F.to_json("signature"), F.lit("[]")).alias("signature"))
    told = every.groupBy(key).agg(F.max(F.when(F.col("field") == "", F.col("signature"))).alias("own"))
    return every.filter("field != ''").join(told, key).filter("signature != own").select(key, "field").distinct()
