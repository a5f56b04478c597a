"""Readers and validation."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stream import told_of

NODE = "id: string, type: string, parent: string, heading: string, text: string, hash: string, node_hash: string, order: int, source_anchor: string"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """celex, lang and the node fields, a row for each node of each corpus file."""
    files = spark.read.schema(f"celex string, lang string, nodes array<struct<{NODE}>>").option("multiLine", True).json(path)
    return files.select("celex", "lang", F.posexplode("nodes").alias("at", "n")).select("celex", "lang", "at", "n.*")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with seq (file, place of the block, line in it), which rises in the files' order, then the lines'; blank lines are
    skipped."""
    rows = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("seq"))
    return rows.filter(F.trim("value") != "").select(F.from_json("value", schema).alias("r"), "seq").select("r.*", "seq")


RULE = "id: string, applies_from: string, scope: array<string>, except: array<string>, later_dates: array<struct<applies_from: string, condition: string, source_node: string>>, source_nodes: array<string>"


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """version, rule_id, pos (0 for the default), is_default, applies_from, scope, except, later_dates (sorted dates), source_nodes: a row for
    each rule of each version of a rule file."""
    none = F.expr("cast(array() as array<string>)")
    files = spark.read.schema(f"versions map<string, struct<`default`: struct<{RULE}>, rules: array<struct<{RULE}>>>>").option("multiLine", True).json(path)
    block = files.select(F.explode("versions").alias("version", "b"))
    default = F.filter(F.array(F.struct(F.lit(0).alias("pos"), F.col("b.default").alias("r"))), lambda x: x["r"].isNotNull())
    others = F.transform(F.coalesce("b.rules", F.expr(f"cast(array() as array<struct<{RULE}>>)")), lambda r, i: F.struct((i + 1).alias("pos"), r.alias("r")))
    rows = block.select("version", F.explode(F.concat(default, others)).alias("x")).select("version", "x.pos", "x.r.*")
    dates = F.array_sort(F.transform(F.coalesce("later_dates", F.expr("cast(array() as array<struct<applies_from:string,condition:string,source_node:string>>)")), lambda d: d["applies_from"]))
    return rows.select("version", F.coalesce("id", F.lit("default")).alias("rule_id"), "pos", (F.col("pos") == 0).alias("is_default"), "applies_from", F.coalesce("scope", none).alias("scope"), F.coalesce("except", none).alias("except"), dates.alias("later_dates"), F.coalesce("source_nodes", none).alias("source_nodes"))


#: Tags whose content is no text of a page, and blocks that are.
SKIPPED = frozenset("nav footer script style noscript template head title".split())
BLOCKS = {"p": "text", "blockquote": "text", "pre": "text", "li": "item", "td": "text", "th": "text", "dd": "text", "dt": "text", "figcaption": "text"} | {f"h{i}": "heading" for i in range(1, 7)}


class _Blocks(HTMLParser):
    """(kind, level, text) of every block; an open block ends where the next begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.parts, self.kind, self.level, self.skipped = [], [], "text", 0, []

    def end(self) -> None:
        if text := " ".join("".join(self.parts).split()):
            self.out.append((self.kind, self.level, text))
        self.parts, self.kind, self.level = [], "text", 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skipped.append(tag)
        elif tag in BLOCKS:
            self.end()
            self.kind, self.level = BLOCKS[tag], int(tag[1]) if BLOCKS[tag] == "heading" else 0

    def handle_endtag(self, tag):
        if tag in self.skipped:
            del self.skipped[self.skipped.index(tag) :]
        elif tag in BLOCKS:
            self.end()

    def handle_data(self, data):
        if not self.skipped:
            self.parts.append(data)


def page_nodes(html: str) -> list[tuple]:
    """(id, parent, type, heading, text, ord) of a page: headings open containers by their level; the first text of a container is its
    own, further ones are sub_2, sub_3, ...; items are pt_1, pt_2, ... below it."""
    reader = _Blocks()
    reader.feed(html)
    reader.close()
    reader.end()
    rows, open_, counts = [["page", None, "page", "", "", 0]], [(0, 0)], {}
    for kind, level, text in reader.out:
        if kind == "heading":
            while open_[-1][0] >= level:
                open_.pop()
            parent = rows[open_[-1][1]]
            n = counts[parent[0], "sct"] = counts.get((parent[0], "sct"), 0) + 1
            open_.append((level, len(rows)))
            rows.append([f"{parent[0]}.sct_{n}", parent[0], "section", text, "", len(rows)])
            continue
        at = rows[open_[-1][1]]
        if kind == "text" and not at[4] and (at[0], "pt") not in counts:
            at[4] = text
        else:
            name = "pt" if kind == "item" else "sub"
            n = counts[at[0], name] = counts.get((at[0], name), 0 if name == "pt" else 1) + 1
            rows.append([f"{at[0]}.{name}_{n}", at[0], "point" if name == "pt" else "paragraph", "", text, len(rows)])
    return [tuple(r) for r in rows]


def parse_pages(pages: DataFrame) -> DataFrame:
    """page_id, id, parent, type, heading, text, ord: the tree of every page (page_id, html; null: a root alone)."""
    return told_of(pages, "page_id", "html", page_nodes, "id string, parent string, type string, heading string, text string, ord int")


def acceptable(pages: DataFrame, anchor: str, least: int) -> DataFrame:
    """Pages that are long enough, look like markup, hold the anchor and are no error or redirect page."""
    html = F.col("html")
    return pages.filter((F.length(html) > least) & F.contains(html, F.lit("<html")) & F.contains(html, F.lit(anchor)) & ~html.rlike("(?i)<title>[^<]*(error|redirect)"))


def validate(rows: DataFrame, key: str, rules: list[tuple[str, Column, str]]) -> tuple[DataFrame, DataFrame]:
    """(clean rows, rejects: id, field, why). rules: field, what makes a row wrong, why; ids that repeat are rejected too."""
    why = F.filter(F.array(*[F.when(bad, F.struct(F.lit(field).alias("field"), F.lit(text).alias("why"))) for field, bad, text in rules]), lambda x: x.isNotNull())
    rejects = rows.select(F.col(key).alias("id"), F.explode(why).alias("r")).select("id", "r.field", "r.why")
    twice = rows.groupBy(F.col(key).alias("id")).count().filter("count > 1").select("id", F.lit(key).alias("field"), F.lit("not unique").alias("why"))
    rejects = rejects.unionByName(twice)
    return rows.join(rejects.select(F.col("id").alias(key)).distinct(), key, "left_anti"), rejects
