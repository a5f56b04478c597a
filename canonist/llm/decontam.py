"""Benchmark decontamination from a distributed positional inverted index, DataFrame functions only.

Every text is cut into its words once. The index holds the postings of the benchmark's terms: term, document, position, and the
words around, each document's in one row where the document was read. Each benchmark text is cut into windows of `width` words
(one window if it has fewer); its terms are counted over all documents, and a window is looked up from its rarest term on: each
posting of it, shifted by the term's offset in the window, is a start, which stands if every other term of the window is at its own
offset from there. `proximity` intersects the lists for terms that stand close together in any order.

Defined cases: a null or wordless text has no words, windows or hits; equal documents are each a row of the result; equal
windows are looked up once; an item without item_id is no item; an empty benchmark hits nothing; an empty table gives no rows; very
long texts are whole. Only doc_id, text and item_id are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, merge

WIDTH = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows that may be broadcast: some 30 MB at most. Beyond that the join shuffles.
SMALL = 100_000
#: Longs of the bit set that passes words on to the index: 32 KB at every size. It lets a few words more through, none less.
LONGS = 4096


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; of a null text none."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def forward(documents: DataFrame) -> DataFrame:
    """uid, doc_id, text_hash, ws (the words): to be stored before it is read twice."""
    return documents.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("ws"))


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, w (array of words): every different window of every item."""
    items = benchmark.filter("item_id is not null").select("item_id", words(F.col("text")).alias("ws")).filter("size(ws) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - width + 1))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("ws"), i, width))).alias("w")).distinct()


def frequencies(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: how often each of these different terms stands in the documents."""
    counts = tokens.select(F.explode("ws").alias("term")).groupBy("term").count()  # summed where they stand, so no term is hot
    return terms.join(merge(counts), "term", "left").select("term", F.coalesce("count", F.lit(0)).alias("n"))


def maybe_one_of(terms: DataFrame):
    """A test of a word that is true for all of terms (column term) and for few others: bits of the terms' hashes."""
    of = lambda term: (F.pmod(F.xxhash64(term), F.lit(LONGS)), F.pmod(F.shiftright(F.xxhash64(term), 40), F.lit(64)))
    at, bit = of(F.col("term"))
    held = terms.select(at.alias("at"), bit.alias("bit")).distinct().groupBy("at").agg(F.collect_list("bit").alias("bits")).collect()  # LONGS rows at most
    longs = [0] * LONGS
    for row in held:
        value = sum(1 << b for b in row["bits"])
        longs[row["at"]] = value - (1 << 64) if value >> 63 else value
    mask = F.split(F.lit(",".join(map(str, longs))), ",").cast("array<long>")  # a constant once the plan is optimised
    return lambda term: F.getbit(F.get(mask, of(term)[0].cast("int")), of(term)[1].cast("int")) == 1


def index(tokens: DataFrame, terms: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row for each document: uid, doc_id, text_hash, n_words, postings (array of term, pos from 0, around: the words from
    width - 1 before it to width - 1 after it), in order of pos; of these terms, and a few others."""
    asked = maybe_one_of(terms)
    places = F.filter(F.transform("ws", lambda w, i: F.struct(i.alias("pos"), w.alias("term"))), lambda x: asked(x["term"]))
    around = lambda x: F.slice(F.col("ws"), F.greatest(F.lit(1), x["pos"] - (width - 2)), x["pos"] + width - F.greatest(F.lit(0), x["pos"] - (width - 1)))
    return tokens.select("uid", "doc_id", "text_hash", F.size("ws").cast("long").alias("n_words"), F.transform(places, lambda x: F.struct(x["term"].alias("term"), x["pos"].alias("pos"), around(x).alias("around"))).alias("postings"))


def inverted(by_document: DataFrame) -> DataFrame:
    """term, uid, pos, around: the postings, one row each."""
    return by_document.select("uid", F.explode("postings").alias("p")).select("p.term", "uid", "p.pos", "p.around")


def phrases(postings: DataFrame, anchors: DataFrame, width: int = WIDTH) -> DataFrame:
    """uid, start, len, items: every occurrence of a window. anchors: term, off (of the window's rarest term), w, items."""
    listed = postings.join(anchors, "term").withColumn("start", F.col("pos") - F.col("off")).filter("start >= 0")
    at = F.slice("around", F.col("start") - F.greatest(F.lit(0), F.col("pos") - (width - 1)) + 1, F.size("w"))
    return listed.filter(at == F.col("w")).select("uid", "start", F.size("w").alias("len"), "items")


def decontaminate(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, small: int = SMALL) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, items (sorted array of the item_ids as strings): a row for every document."""
    scratch = Scratch(documents.sparkSession)
    stored = scratch.stored
    wins = windows(benchmark, width).groupBy("w").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    wins = stored(wins.withColumn("win", F.monotonically_increasing_id()), "windows")
    tokens = stored(forward(documents), "tokens")
    rarity = stored(frequencies(tokens, wins.select(F.explode("w").alias("term")).distinct()), "frequencies")
    places = wins.select("win", F.posexplode("w").alias("off", "term")).join(rarity, "term")
    rarest = places.groupBy("win").agg(F.min(F.struct("n", "off", "term")).alias("r")).filter("r.n > 0")  # else the window occurs nowhere
    anchors = stored(rarest.select("win", "r.term", "r.off").join(wins, "win").drop("win"), "anchors")
    by_document = stored(index(tokens, anchors.select("term").distinct(), width), "index")
    scratch.drop("tokens", "windows", "frequencies")
    found = stored(phrases(inverted(by_document), F.broadcast(anchors) if anchors.count() <= small else anchors, width), "phrases")
    end = F.col("start") + F.col("len")
    before = Window.partitionBy("uid").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))))
    n_hit = found.select("uid", "start", "len").distinct().withColumn("fresh", fresh).groupBy("uid").agg(F.sum("fresh").alias("n_hit"))
    items = found.select("uid", F.explode("items").alias("item")).groupBy("uid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = by_document.select("uid", "doc_id", "text_hash", "n_words").join(merge(n_hit.join(merge(items), "uid")), "uid", "left")
    out = stored(out.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")), "result")
    scratch.drop("index", "anchors", "phrases")
    return out


def proximity(documents: DataFrame, queries: DataFrame, within: int = 20) -> DataFrame:
    """query_id, doc_id, text_hash, pos: where all words of a query (query_id, text) stand within `within` words of the
    posting at pos of its rarest word, in any order."""
    scratch = Scratch(documents.sparkSession)
    asked = queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    terms = scratch.stored(asked.select("term").distinct(), "terms")
    tokens = scratch.stored(forward(documents), "tokens")
    own = Window.partitionBy("query_id")
    ranked = asked.join(frequencies(tokens, terms), "term").withColumn("slot", F.row_number().over(own.orderBy("n", "term"))).withColumn("of", F.count("term").over(own))
    ranked = scratch.stored(ranked, "ranked")
    by_document = scratch.stored(index(tokens, terms, 1), "index")
    scratch.drop("tokens")
    lists = inverted(by_document).drop("around").join(ranked.select("query_id", "term", "slot", "of"), "term")
    first, other = lists.filter("slot = 1").alias("a"), lists.filter("slot > 1").alias("b")
    near = (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.uid") == F.col("b.uid")) & (F.abs(F.col("a.pos") - F.col("b.pos")) < within)
    met = first.join(other, near, "left").groupBy("a.query_id", "a.uid", "a.pos", "a.of").agg(F.countDistinct("b.slot").alias("met")).filter("met = of - 1")
    return met.join(by_document.select("uid", "doc_id", "text_hash"), "uid").select("query_id", "doc_id", "text_hash", "pos").distinct()
