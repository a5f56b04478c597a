"""Registered queries on structured pages and number notation, with SQL that states what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import verify
from ..sources import markup
from .audits import NORM
from .derive import table
from .logs import PLAIN
from .registry import query

LINES_SQL = r"""lines_ as (select doc_id, unnest(l) line, generate_subscripts(l, 1) - 1 p from (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[A-Za-z0-9]')) l from documents where text is not null)),
 groups_ as (select doc_id, line, p, 'art_' || doc_id root, 'art_' || doc_id || '.par_' || (p // 4 + 1) par from lines_)"""


def act_pages(spark, sf_dir) -> DataFrame:
    """page_id, html: every document as an article; its lines by fours are a numbered paragraph, a lettered item, a further text and a dash below it.
    Odd documents are written with grids, even ones with list tables and footnotes."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[A-Za-z0-9]"))
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def item(label: Column, line: Column) -> Column:
        listed = F.concat(F.lit("<table><tr><td><p>"), label, F.lit("</p></td><td><p>"), line, F.lit("</p></td></tr></table>"))
        grid = F.concat(F.lit('<div class="grid-container"><div class="grid-list-column-1">'), label, F.lit('</div><div class="grid-list-column-2"><p>'), line, F.lit("</p></div></div>"))
        return F.when(F.col("doc_id") % 2 == 0, listed).otherwise(grid)

    def written(line: Column, p: Column) -> Column:
        nth, k = F.floor(p / 4), p % 4
        number = (nth + 1).cast("string")
        table_par = F.concat(F.when(p > 0, "</div>").otherwise(""), F.lit('<div id="001.'), F.lpad((nth % 1000).cast("string"), 3, "0"), F.lit('"><p>'), number, F.lit(".   "), line, F.lit('<a href="#n"><span class="oj-super">(1)</span></a></p>'))
        grid_par = F.concat(F.lit('<div class="norm"><span class="no-parag">'), number, F.lit(".</span><p>"), line, F.lit("</p></div>"))
        par = F.when(F.col("doc_id") % 2 == 0, table_par).otherwise(grid_par)
        return F.when(k == 0, par).when(k == 1, item(F.concat(F.lit("("), F.char(97 + nth % 26), F.lit(")")), line)).when(k == 2, F.concat(F.lit("<p>"), line, F.lit("</p>"))).otherwise(item(F.lit("—"), line))

    body = F.array_join(F.transform(lines, lambda x, i: written(safe(x), i)), "")
    open_ = F.when((F.col("doc_id") % 2 == 0) & (F.size(lines) > 0), "</div>").otherwise("")
    page = F.concat(F.lit('<html><body><div id="cpt_IV"><p>CHAPTER IV</p><div class="eli-title"><p>All of it</p></div><div id="art_'), F.col("doc_id").cast("string"), F.lit('"><div class="eli-title"><p>Number '), F.col("doc_id").cast("string"), F.lit("</p></div>"), body, open_, F.lit("</div></div></body></html>"))
    return docs.select(F.col("doc_id").cast("string").alias("page_id"), page.alias("html"))


@query(rf"""with {LINES_SQL}, all_ as (
 select doc_id, 'cpt_4' id, 'chapter' as type, null::varchar parent, 'All of it' heading, '' line from documents where text is not null union all
 select doc_id, 'art_' || doc_id, 'article', 'cpt_4', 'Number ' || doc_id, '' from documents where text is not null union all
 select doc_id, case p % 4 when 0 then par when 1 then par || '.' || chr((97 + (p // 4) % 26)::int) when 2 then par || '.sub_2' else par || '.sub_2.pt_1' end, case p % 4 when 0 then 'paragraph' when 2 then 'subparagraph' else 'point' end,
  case p % 4 when 0 then root when 3 then par || '.sub_2' else par end, '', line from groups_)
select doc_id::varchar page_id, id, type, parent, heading, sha256({PLAIN.format("line")}) hash from all_""")
def source_acts(spark, sf_dir):
    """The provisions of every document's page, in either rendition."""
    nodes, _ = markup.parse_acts(act_pages(spark, sf_dir))
    return nodes.select("page_id", "id", "type", "parent", "heading", "hash")


@query(rf"""with {LINES_SQL} select doc_id::varchar page_id, 'duplicate_id' what, true error, case when p % 4 = 1 then par || '.' || chr((97 + (p // 4) % 26)::int) else par end detail from groups_
 where doc_id % 9 = 4 and p = 0""")
def source_acts_refused(spark, sf_dir):
    """Every ninth page holds its first paragraph twice: what is wrong with it."""
    pages = act_pages(spark, sf_dir).filter(F.col("page_id").cast("long") % 9 == 4)
    first = F.regexp_extract("html", r'(?s)(<div class="norm"><span class="no-parag">1\..*?</p></div>|<div id="001\.000">.*?</a></p>)', 1)
    twice = F.concat(first, F.when(F.startswith(first, F.lit("<div id")), "</div>").otherwise(""))
    html = F.concat(F.substring_index("html", "</div></div></body>", 1), F.when(first != "", twice).otherwise(""), F.lit("</div></div></body></html>"))
    return markup.parse_acts(pages.withColumn("html", html))[1]


_SMALL = "case when n <= -6 then s[1] || case when len(s) > 1 then '.' || s[2:] else '' end || 'e-' || (1 - n) else '0.' || repeat('0', (-n)::int) || s end"
_BIG = "case when len(k) + 19 > 21 then s[1] || case when len(s) > 1 then '.' || s[2:] else '' end || 'e+' || (len(k) + 18) else k || repeat('0', 19) end"


@query(f"""with k_ as (select o_orderkey, (o_orderkey + 1)::varchar k, rtrim((o_orderkey + 1)::varchar, '0') s, len((o_orderkey + 1)::varchar) - 9 n from orders)
select o_orderkey k, case when o_orderkey % 7 = 3 then null else '{{"big":' || {_BIG} || ',"half":-' || k || '.5,"list":[0,' || k || ',null],"small":' || {_SMALL} || ',"' || chr(65536) || '":1,"' || chr(57344) || '":2}}' end canonical from k_""")
def text_canonical_numbers(spark, sf_dir):
    """JSON whose numbers are small, big, halves and whole ones written with fractions, with keys in and beyond the basic plane; every seventh holds
    what is no JSON."""
    k = (F.col("o_orderkey") + 1).cast("string")
    parts = [F.lit('{"\ue000": 2.0, "\U00010000": 1e0, "small":'), k, F.lit('e-9, "list":[-0.0, '), k, F.lit(".000, "), F.when(F.col("o_orderkey") % 7 == 3, "NaN").otherwise("1e999"), F.lit('], "half":-'), k, F.lit('.50, "big":'), k, F.lit("e19}")]
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), T.canonical_json(F.concat(*parts)).alias("canonical"))


@query(rf"""with l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[A-Za-z0-9]')) l from documents where text is not null),
q_ as (select doc_id, array_to_string(list_filter(string_split(l[1], ' '), lambda x: x <> '')[-6:], ' ') || ' ' || array_to_string(list_filter(string_split(l[2], ' '), lambda x: x <> '')[1:6], ' ') q from l where len(l) > 1),
q as (select doc_id, {NORM.format("q")} n from q_), d as (select doc_id, {NORM.format("text")} n from documents where text is not null), one as (select {NORM.format("x")} n from (select unnest(l) x from l)),
met as (select q.doc_id, min(d.doc_id) root from q join d on contains(d.n, q.n) group by q.doc_id), alone as (select q.doc_id, count(*) c from q join one on contains(one.n, q.n) group by q.doc_id)
select q.doc_id quote_id, case when len(string_split(trim(n), ' ')) < 6 then 'too_short' when c > 1 then 'multiple_matches' when c = 1 then 'exact' else 'multi_node' end status,
 case when len(string_split(trim(n), ' ')) >= 6 and c is null then root end root from q left join met using (doc_id) left join alone using (doc_id)""")
def quotes_over_nodes(spark, sf_dir):
    """The end of every document's first line and the beginning of its second one as a quotation: which document holds it over its lines?"""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.filter(F.split("text", "\n"), lambda x: x.rlike("[A-Za-z0-9]")).alias("l"))
    words = lambda i: F.filter(F.split(F.get("l", F.lit(i)), " "), lambda w: w != "")
    tail = F.when(F.size(words(0)) > 6, F.slice(words(0), -6, 6)).otherwise(words(0))
    quotes = docs.filter(F.size("l") > 1).select(F.col("doc_id").alias("quote_id"), F.array_join(F.concat(tail, F.slice(words(1), 1, 6)), " ").alias("quote"))
    at = F.col("doc_id").cast("long") * 100_000
    fixed = [F.lit("v1").alias("version"), F.lit("en").alias("lang")]
    lines = docs.select("doc_id", F.posexplode("l").alias("p", "text")).select(*fixed, F.concat_ws(".", "doc_id", "p").alias("id"), F.lit("paragraph").alias("type"), (at + F.col("p") + 1).alias("ord"), "text", F.col("doc_id").cast("string").alias("root"))
    heads = docs.select(*fixed, F.col("doc_id").cast("string").alias("id"), F.lit("article").alias("type"), at.alias("ord"), F.lit("").alias("text"))
    own = lambda df, up, far: df.select("version", "lang", "id", F.col(up).alias("ancestor"), F.lit(far).alias("distance"))
    chain = own(heads, "id", 0).unionByName(own(lines, "id", 0)).unionByName(own(lines, "root", 1))
    asked = quotes.withColumn("claimed", F.lit(None).cast("string")).withColumn("version", F.lit("v1")).withColumn("lang", F.lit("en"))
    told = verify.verify(asked, lines.drop("root").unionByName(heads), chain)
    root = F.when(F.col("status") == "multi_node", F.substring_index(F.col("candidates")[0]["id"], ".", 1).cast("long"))
    return told.select("quote_id", "status", root.alias("root"))
