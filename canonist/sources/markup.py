"""Pages of acts, in either of two renditions, as trees of provisions.

A page is read by an automaton with one stack of open elements. An element that closes is reduced to blocks of the element around it:
texts, headings, labelled items (rows of list tables, two-column grids), numbered paragraphs, and boxes (recitals, articles, annexes,
chapters). That is all that is done page by page; numbers, containers, ids, duplicates and warnings are windows and joins over the blocks of
all pages.

Defined cases: a null page has no blocks; end tags without a start are passed over, elements left open end where an outer one does; a page
with an error (an id twice, an annex heading of no known form) gives no nodes, only its problems; equal page_ids must not occur."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import text as T
from ..operators import tree
from .scratch import Scratch
from .stream import told_of

#: Classes, ids and labels of the two renditions.
INLINE = frozenset("span a i b em strong sup sub u small abbr q font".split())
VOID = frozenset("br img hr meta link input col wbr".split())
SKIPPED = frozenset("oj-ti-art oj-sti-art title-article-norm stitle-article-norm modref oj-note footnote arrow disclaimer".split())
TITLE, NUMBERED = "eli-title", "no-parag"
LEVEL_1, LEVEL_2 = frozenset({"oj-ti-grseq-1", "title-gr-seq-level-1"}), "title-gr-seq-level-2"
ANNEX_TITLES = ("oj-doc-ti", "title-annex-1", "title-annex-2")
RAISED = frozenset({"oj-super", "oj-note-tag", "superscript"})
BOXES = [("recital", r"rct_(\d+)"), ("article", r"art_(\d+[a-z]*)"), ("annex", r"anx_([IVXLC]+)"), ("chapter", r"cpt_([IVXLC]+)"), ("section", r"cpt_([IVXLC]+\.sct_\d+)")]
LIST_LABEL = re.compile(r"\(?[0-9A-Za-z]{1,6}[.)]|\d+(\.\d+)+\.|[—–‒\-•·]")
PAR_LABEL = re.compile(r"(?:\((\d+[a-z]{0,2})\)|(\d+(?:\.\d+)*[a-z]{0,2})\.)(?:\s+|$)")
SECTION = r"^(?:Section|Abschnitt)\s+([A-Za-z]|\d+)(?=[\s.:—–-]|$)"
BARE_SECTION = r"^(?:Section|Abschnitt)\s+(?:[A-Za-z]|\d+)$"
GROUP, LETTER = r"^(\d+)[.)]\s+(.*)$", r"^([a-z]{1,3})[.)]\s+(.*)$"
#: Marks of a dropped footnote reference, one whose parentheses stand in the link and one whose may stand around it.
NOTE, BARE_NOTE = "\ue010", "\ue011"


def flat(s: str) -> str:
    return " ".join(s.split())


def without_notes(s: str) -> str:
    """Footnote marks taken out: no space before punctuation, one where two words would touch."""
    if NOTE not in s and BARE_NOTE not in s:
        return s
    s = re.sub(rf"\({BARE_NOTE}(?:\s*\))?|{BARE_NOTE}", NOTE, s)
    s = re.sub(rf"\s*{NOTE}[\s{NOTE}]*(?=[,.;:)])", "", s)
    return re.sub(rf"(?<=\S){NOTE}+(?=\S)", " ", s).replace(NOTE, "")


class Block:
    __slots__ = ("kind", "text", "label", "level", "key", "heading", "anchor", "blocks")

    def __init__(self, kind: str, anchor: str, text: str = "", label: str = "", level: int = 0, key: str = "", heading: str = "", blocks: list[Block] | None = None):
        self.kind, self.anchor, self.text, self.label, self.level, self.key, self.heading = kind, anchor, text, label, level, key, heading
        self.blocks = blocks if blocks is not None else []


class Frame:
    """An open element: its blocks so far, the numbered paragraph that goes on, the text not yet put into a block."""

    def __init__(self, tag: str, kind: str, anchor: str, classes: frozenset[str] = frozenset(), key: str = ""):
        self.tag, self.kind, self.anchor, self.classes, self.key = tag, kind, anchor, classes, key
        self.blocks, self.goes_on, self.text, self.raw, self.cells, self.heads = [], None, [], [], [], []
        self.label, self.title, self.titles, self.raised, self.in_head = None, None, [], False, True

    def target(self) -> list[Block]:
        return self.goes_on.blocks if self.goes_on else self.blocks

    def put(self, block: Block) -> None:
        """What follows a numbered paragraph belongs to it, until the next one or a heading."""
        if block.kind in ("text", "item"):
            self.target().append(block)
            return
        self.blocks.append(block)
        if block.kind in ("par", "heading"):
            self.goes_on = block if block.kind == "par" else None

    def put_text(self, s: str) -> Block | None:
        if not s.strip():
            return None
        if not re.search(r"[^\W_]", s):  # punctuation alone belongs to the text before it
            at = self.target()
            while at and at[-1].kind in ("item", "par") and at[-1].blocks:
                at = at[-1].blocks
            if at and at[-1].kind == "text":
                at[-1].text = at[-1].text.rstrip() + s.strip()
                return None
        self.put(block := Block("text", self.anchor, s))
        return block

    def flush(self) -> None:
        if self.text:
            s, self.text = without_notes("".join(self.text)), []
            self.put_text(s)


def lines_of(blocks: list[Block]) -> list[str]:
    """Blocks as lines, an item's label before its first."""
    out, stack = [], [(b, "") for b in reversed(blocks)]
    while stack:
        block, front = stack.pop()
        if block.kind in ("text", "heading"):
            out.append(front + block.text)
        elif not block.blocks:
            out.append(front + block.label)
        else:
            stack += [(b, "") for b in reversed(block.blocks[1:])]
            stack.append((block.blocks[0], f"{front}{block.label} "))
    return out


class Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [Frame("", "root", "")]

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return self.handle_data(" ") if tag == "br" else None
        told = {k: v or "" for k, v in attrs}
        classes, own = frozenset(told.get("class", "").split()), told.get("id", "")
        self.implied(tag)
        top = self.stack[-1]
        if top.kind == "skip" or classes & SKIPPED:
            self.stack.append(Frame(tag, "skip", top.anchor))
        elif TITLE in classes:
            self.stack.append(Frame(tag, "title", top.anchor))
        elif tag == "a" and told.get("href", "").startswith("#"):
            self.stack.append(Frame(tag, "ref", top.anchor))
        elif top.kind == "ref":
            top.raised = top.raised or bool(classes & RAISED)
        elif NUMBERED in classes and top.kind == "norm" and top.label is None:
            self.stack.append(Frame(tag, "label", top.anchor))
        elif tag not in INLINE and tag not in ("tbody", "thead", "tfoot"):
            if top.kind in ("root", "div", "box", "cell", "norm", "par", "grid"):
                top.flush()
            self.stack.append(self.opened(tag, told, classes, own, top))

    def implied(self, tag: str) -> None:
        """Ends what an element that begins cannot stand in: a paragraph, or an open cell, row or list item of the same table or list."""
        if self.stack[-1].kind == "p" and tag not in INLINE:
            self.end(self.stack[-1])
        ends, within = {"td": (("td", "th"), "tr"), "th": (("td", "th"), "tr"), "tr": (("tr",), "table"), "li": (("li",), "ul")}.get(tag, ((), ""))
        open_ = next((f for f in reversed(self.stack) if f.tag in (*ends, within) or f.tag in ("table", "ol")), None) if ends else None
        if open_ is not None and open_.tag in ends:
            self.end(open_)

    def opened(self, tag: str, told: dict[str, str], classes: frozenset[str], own: str, top: Frame) -> Frame:
        anchor, leaf = own or top.anchor, any(f.kind == "box" and f.key.split(":")[0] in ("recital", "article", "annex") for f in self.stack)
        if not leaf:
            for kind, pattern in BOXES:
                if m := re.fullmatch(pattern, own):
                    return Frame(tag, "box", anchor, classes, f"{kind}:{m[1]}")
        kind = {"p": "p", "table": "table", "tr": "row", "td": "cell", "th": "cell"}.get(tag, "div")
        if tag == "div":
            if top.kind == "box":
                top.in_head = False
            if "grid-container" in classes:
                kind = "grid"
            elif top.kind == "grid" and classes & {"grid-list-column-1", "grid-list-column-2"}:
                kind = "cell"
            elif "norm" in classes:
                kind = "norm"
            elif re.fullmatch(r"\d{3}\.\d{3}", own) or "oj-enumeration-spacing" in classes or "text-indent" in told.get("style", ""):
                kind = "par"
        return Frame(tag, kind, anchor, classes)

    def handle_endtag(self, tag):
        if tag not in VOID:
            if (open_ := next((f for f in reversed(self.stack[1:]) if f.tag == tag), None)) is not None:
                self.end(open_)

    def handle_data(self, data):
        top = self.stack[-1]
        if top.kind != "skip":
            top.raw.append(data)
            if top.kind in ("root", "div", "box", "cell", "norm", "par", "p", "ref", "grid"):
                top.text.append(data)

    def end(self, frame: Frame) -> None:
        while (closed := self.stack.pop()) is not frame:
            self.reduced(closed, self.stack[-1])
        self.reduced(frame, self.stack[-1])

    def reduced(self, f: Frame, around: Frame) -> None:
        """What a closed element adds to the one around it."""
        raw = "".join(f.raw)
        if f.kind == "ref":
            if f.raised or re.fullmatch(r"\(?\*?\d*\)?", raw.strip()):
                around.text.append(NOTE if raw.strip().startswith("(") else BARE_NOTE)
            elif around.kind != "title":
                around.text += f.text
            around.raw.append(raw)
            return
        if f.kind == "skip":
            return
        around.raw.append(raw)
        if f.kind == "label":
            around.label = raw
        elif f.kind == "title":
            around.heads += f.heads or [flat(raw)]
            around.title = around.title or flat(raw)
        elif f.kind == "p":
            s = without_notes("".join(f.text))
            level = 1 if f.classes & LEVEL_1 else 2 if LEVEL_2 in f.classes else 0
            if around.kind == "title" or around.kind == "box" and around.in_head:
                around.heads.append(flat(raw))
            block = Block("heading", f.anchor, s, level=level) if level and s.strip() else None
            if block is not None:
                around.put(block)
            elif not level:
                block = self.text_at(around, s, f.anchor)
            if block is not None and around.key.startswith("annex"):
                around.titles.append((block, any(c.startswith(ANNEX_TITLES) for c in f.classes), flat(raw)))
        elif f.kind in ("row", "cell"):
            f.flush()
            if around.kind in ("table", "row", "grid"):
                around.cells.append(f)
            else:
                self.passed(f, around)
        elif f.kind == "table":
            self.table(f, around)
        else:
            f.flush()
            self.container(f, around)

    def text_at(self, around: Frame, s: str, anchor: str) -> Block | None:
        held, around.anchor = around.anchor, anchor
        block = around.put_text(s)
        around.anchor = held
        return block

    def passed(self, f: Frame, around: Frame) -> None:
        for cell in f.cells:
            self.passed(cell, around)
        for block in f.blocks:
            around.put_text(block.text) if block.kind == "text" and not re.search(r"[^\W_]", block.text) else around.put(block)

    def table(self, f: Frame, around: Frame) -> None:
        """Rows of a label and a content are items; any other table is one text, a line for each row."""
        listed = []
        for row in f.cells:
            cells = row.cells[1:] if len(row.cells) == 3 and not flat("".join(row.cells[0].raw)) else row.cells
            if len(cells) != 2 or not LIST_LABEL.fullmatch(flat("".join(cells[0].raw))):
                break
            listed.append(Block("item", f.anchor, label=flat("".join(cells[0].raw)), blocks=cells[1].blocks))
        if f.cells and len(listed) == len(f.cells):
            for item in listed:
                around.put(item)
            return
        rows = [" | ".join(s for cell in row.cells if (s := flat(" ".join(lines_of(cell.blocks))))) for row in f.cells]
        self.text_at(around, "\n".join(r for r in rows if r), f.anchor)

    def container(self, f: Frame, around: Frame) -> None:
        if f.kind == "grid" and len(f.cells) >= 2:
            label = next((c for c in f.cells if "grid-list-column-1" in c.classes), None)
            content = next((c for c in f.cells if "grid-list-column-2" in c.classes), None)
            if label is not None and content is not None:
                around.put(Block("item", f.anchor, label=flat("".join(label.raw)), blocks=content.blocks))
                return
        if f.kind == "norm" and f.label is not None:
            around.put(Block("par", f.anchor, label=flat(f.label), blocks=f.blocks))
        elif f.kind == "par" and f.blocks and f.blocks[0].kind == "text" and (m := PAR_LABEL.match(first := flat(f.blocks[0].text))):
            rest = first[m.end() :]
            f.blocks[0].text = rest
            around.put(Block("par", f.anchor, label=m[0].strip(), blocks=f.blocks if rest else f.blocks[1:]))
        elif f.kind == "box":
            around.put(self.box(f))
        else:
            self.passed(f, around)

    def box(self, f: Frame) -> Block:
        kind, _, key = f.key.partition(":")
        out = Block(kind, f.anchor, key=key, blocks=f.blocks)
        if kind in ("chapter", "section"):
            out.heading = (f.heads[1:] or f.heads or [""])[0]
            out.blocks = [b for b in f.blocks if b.kind in dict(BOXES)]
        elif kind == "article":
            out.heading = f.title or ""
        elif kind == "recital":
            lines = lines_of(f.blocks)
            out.text = "\n".join([re.sub(r"^\s*\(\d+\)\s*", "", lines[0]), *lines[1:]]) if lines else ""
            out.blocks = []
        elif (label := next((t for t in f.titles if t[1]), None)) is not None:
            after = f.titles[f.titles.index(label) + 1 :]
            title = next((t for t in after if t[1]), after[0] if after else None)
            out.heading = (title or label)[2]
            out.blocks = [b for b in f.blocks if b is not label[0] and (title is None or b is not title[0])]
        return out


ROWS = "n int, up int, top boolean, kind string, box string, key string, label string, level int, text string, heading string, anchor string"


def blocks_of(html: str) -> list[tuple]:
    """ROWS of a page: its boxes and all in them, in document order."""
    reader = Reader()
    reader.feed(html)
    reader.close()
    reader.end(reader.stack[1]) if len(reader.stack) > 1 else None
    kinds, out = dict(BOXES), []
    stack = [(b, None, "", False) for b in reversed(reader.stack[0].blocks) if b.kind in kinds]
    while stack:
        b, up, box, top = stack.pop()
        n, of_box = len(out), b.kind in kinds
        out.append((n, up, top, b.kind, b.kind if of_box else box, b.key, b.label, b.level, b.text, b.heading, b.anchor))
        stack += [(c, n, b.kind if of_box else box, of_box) for c in reversed(b.blocks)]
    return out


def page_blocks(pages: DataFrame) -> DataFrame:
    """page_id and ROWS of every page (page_id, html)."""
    return told_of(pages.select(F.col("page_id").cast("string").alias("page_id"), "html"), "page_id", "html", blocks_of, ROWS)


def parse_acts(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: page_id, id, type, parent, heading, text, hash, node_hash, ord, source_anchor; problems: page_id, what, error, detail).

    The first text of a node is its own, further ones are sub_2, sub_3 and so on; items hang below the last of these before them; items without
    a label's core are numbered. Headings of annexes open sections, numbered groups and letters; other headings are texts."""
    scratch = Scratch(pages.sparkSession)
    b = scratch.stored(page_blocks(pages).withColumn("text", T.normalize(F.col("text"))).withColumn("heading", T.normalize(F.col("heading"))), "blocks")
    beside = Window.partitionBy("page_id", "up").orderBy("n")
    before, whole = beside.rowsBetween(Window.unboundedPreceding, 0), beside.rowsBetween(Window.unboundedPreceding, -1)
    # headings of annexes: what each one opens, and below what
    held = (F.col("kind") == "heading") & (F.col("box") == "annex") & F.col("top")
    first = held & (F.col("level") == 1)
    b = b.withColumns({"sec": first & F.col("text").rlike(SECTION), "group": first & F.col("text").rlike(GROUP), "letter": held & (F.col("level") == 2) & F.col("text").rlike(LETTER)})
    b = b.withColumn("bare", F.col("sec") & F.col("text").rlike(BARE_SECTION))
    b = b.withColumn("joins", first & ~F.col("sec") & ~F.col("group") & F.coalesce(F.lag("bare").over(beside), F.lit(False)))
    b = b.withColumn("odd", held & ~(F.col("sec") | F.col("group") | F.col("letter") | F.col("joins")))
    b = b.withColumn("title", F.when(F.col("sec"), F.when(F.lead("joins").over(beside), F.concat_ws(" ", "text", F.lead("text").over(beside))).otherwise(F.col("text"))).when(F.col("group"), F.regexp_extract("text", GROUP, 2)).when(F.col("letter"), F.regexp_extract("text", LETTER, 2)))
    last = lambda which, w: F.last(F.when(F.col(which), F.col("n")), ignorenulls=True).over(w)
    b = b.withColumns({"in_sec": last("sec", before), "in_group": last("group", before), "opens": F.col("sec") | F.col("group") | F.col("letter")})
    in_group = F.when(F.coalesce(F.col("in_group") > F.col("in_sec"), F.col("in_group").isNotNull()), F.col("in_group"))
    owner = F.when(F.col("sec"), F.col("up")).when(F.col("group"), F.coalesce("in_sec", "up")).when(F.col("letter"), F.coalesce(in_group, "in_sec", "up")).otherwise(F.coalesce(last("opens", before), F.col("up")))
    b = scratch.stored(b.withColumn("owner", owner).filter("not joins"), "owned")
    # texts and items below their owners
    boxed = F.col("kind").isin(*dict(BOXES))
    inner = b.filter(~boxed & ~F.col("opens") & ~F.col("odd"))
    own_w = Window.partitionBy("page_id", "owner").orderBy("n")
    inner = inner.withColumn("is_text", F.col("kind").isin("text", "heading")).withColumn("own", (F.row_number().over(own_w) == 1) & F.col("is_text"))
    inner = inner.withColumn("sub", F.col("is_text") & ~F.col("own"))
    subs = own_w.rowsBetween(Window.unboundedPreceding, 0)
    inner = inner.withColumn("nth", 1 + F.count_if("sub").over(subs)).withColumn("container", F.coalesce(F.last(F.when(F.col("sub"), F.col("n")), ignorenulls=True).over(own_w.rowsBetween(Window.unboundedPreceding, -1)), "owner"))
    core = F.regexp_replace(F.regexp_replace(F.trim("label"), r"^\(", ""), r"[.)]+$", "")
    inner = inner.withColumn("core", F.when(core.rlike(r"^[0-9A-Za-z]+(?:\.[0-9A-Za-z]+)*$"), core).otherwise(""))
    bullet = F.row_number().over(Window.partitionBy("page_id", "container", F.col("is_text") | (F.col("core") != "")).orderBy("n"))
    par = (F.col("kind") == "par") & (F.col("box") == "article") & F.col("top") & (F.col("container") == F.col("up"))
    label = F.when(F.col("core") == "", F.concat(F.lit("pt_"), bullet.cast("string"))).when(F.col("core").rlike(r"^\d"), F.concat(F.when(par, "par_").otherwise("pt_"), F.substring_index("core", ".", -1))).otherwise(F.col("core"))
    inner = inner.withColumn("segment", F.when(F.col("sub"), F.concat(F.lit("sub_"), F.col("nth").cast("string"))).otherwise(label))
    texts = inner.filter("own").select("page_id", F.col("owner").alias("n"), F.col("text").alias("own_text"), F.col("anchor").alias("own_anchor"))
    type_ = F.when(F.col("sub"), "subparagraph").when(F.col("box") == "annex", "annex_point").when(par, "paragraph").otherwise("point")
    nodes = inner.filter(~F.col("own")).select("page_id", "n", F.when(F.col("sub"), F.col("owner")).otherwise(F.col("container")).alias("above"), type_.alias("type"), "segment", F.lit("").alias("heading"), F.when(F.col("sub"), F.col("text")).otherwise("").alias("text"), "anchor", "core")
    opened = F.when(F.col("sec"), F.concat(F.lit("sec_"), F.lower(F.regexp_extract("text", SECTION, 1)))).when(F.col("group"), F.concat(F.lit("pt_"), F.regexp_extract("text", GROUP, 1))).otherwise(F.regexp_extract("text", LETTER, 1))
    nodes = nodes.unionByName(b.filter("opens").select("page_id", "n", F.col("owner").alias("above"), F.when(F.col("sec"), "annex_section").otherwise("annex_point").alias("type"), opened.alias("segment"), F.col("title").alias("heading"), F.lit("").alias("text"), "anchor", F.lit("").alias("core")))
    boxes = b.filter(boxed).select("page_id", "n", "up", "kind", _box_id(F.col("kind"), F.col("key")).alias("id"), "heading", "text", "anchor")
    around = boxes.select("page_id", F.col("n").alias("up"), F.col("id").alias("parent"))
    roots = boxes.select("page_id", "n", F.lit(None).cast("int").alias("above"), F.col("kind").alias("type"), F.col("id").alias("segment"), "heading", "text", "anchor", F.lit("").alias("core"))
    nodes = scratch.stored(roots.unionByName(nodes).join(texts, ["page_id", "n"], "left"), "nodes")
    links = nodes.select(F.col("page_id").alias("version"), F.col("n").alias("id"), F.col("above").alias("parent"))
    chain = tree.closure(links).withColumnsRenamed({"version": "page_id", "id": "n"})
    above = chain.join(nodes.select("page_id", F.col("n").alias("ancestor"), "segment"), ["page_id", "ancestor"])
    path = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "segment"))), lambda x: x["segment"])
    ids = scratch.stored(above.groupBy("page_id", "n").agg(F.array_join(path, ".").alias("id")), "ids")
    text = F.when(F.col("text") == "", F.coalesce("own_text", F.lit(""))).otherwise(F.col("text"))
    out = nodes.join(ids, ["page_id", "n"]).join(ids.select("page_id", F.col("n").alias("above"), F.col("id").alias("over")), ["page_id", "above"], "left")
    out = out.join(boxes.join(around, ["page_id", "up"]).select("page_id", "n", "parent"), ["page_id", "n"], "left").withColumn("text", text).withColumn("parent", F.coalesce("over", "parent"))
    out = scratch.stored(out.withColumn("anchor", F.coalesce("own_anchor", "anchor")), "told")
    problems = _problems(b, out)
    bad = problems.filter("error").select("page_id").distinct()
    ord_ = F.row_number().over(Window.partitionBy("page_id").orderBy("n")) - 1
    good = out.join(bad, "page_id", "left_anti")
    hashes = F.sha2("text", 256).alias("hash"), F.sha2(F.concat_ws("\n", "heading", "text"), 256).alias("node_hash")
    return good.select("page_id", "id", "type", "parent", "heading", "text", *hashes, ord_.alias("ord"), F.col("anchor").alias("source_anchor")), problems


def _box_id(kind: Column, key: Column) -> Column:
    roman, of = C.number(F.substring_index(key, ".", 1)), F.regexp_extract(key, r"\.(sct_\d+)$", 1)
    return F.when(kind == "recital", F.concat(F.lit("rec_"), key)).when(kind == "article", F.concat(F.lit("art_"), key)).when(kind == "annex", F.concat(F.lit("anx_"), roman)).when(kind == "chapter", F.concat(F.lit("cpt_"), roman)).otherwise(F.concat(F.lit("cpt_"), roman, F.lit("."), of))


def _problems(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    twice = nodes.groupBy("page_id", "id").count().filter("count > 1").select("page_id", F.lit("duplicate_id").alias("what"), F.lit(True).alias("error"), F.col("id").alias("detail"))
    odd = blocks.filter("odd").select("page_id", F.lit("unknown_heading").alias("what"), F.lit(True).alias("error"), F.col("text").alias("detail"))
    # a label of several numbers belongs below the node of the number before its last
    within = F.regexp_extract("core", r"([0-9A-Za-z]+)\.[0-9A-Za-z]+$", 1)
    astray = nodes.filter(F.contains("core", F.lit(".")) & ~F.regexp_extract("parent", r"(?:^|\.)(?:pt|par)_([0-9a-z]+)$", 1).eqNullSafe(within))
    nested = astray.select("page_id", F.lit("nested_label").alias("what"), F.lit(False).alias("error"), F.concat_ws(" under ", "core", "parent").alias("detail"))
    return twice.unionByName(odd).unionByName(nested)
