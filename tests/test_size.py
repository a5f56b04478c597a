"""What has to hold at any size, seen in plans and in small tables."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries

SMALL = "/root/testdata/sf0.001"


def broadcasts(df) -> int:
    return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")


@pytest.mark.parametrize("name", ["tree_subtree_text", "rules_coverage", "rules_descendant_dates", "rules_resolved", "rules_state", "diff_rollup"])
def test_no_table_that_grows_with_the_documents_is_broadcast(spark, name):
    assert broadcasts(queries()[name](spark, SMALL)) == 0


def test_search_scores_only_nodes_that_can_be_results(spark):
    """Against plain sums: common words in all of 3000 texts, rare ones in a few, ties at the last rank."""
    import math
    import random

    from canonist.operators import search

    random.seed(5)
    texts = {i: [f"c{random.randrange(12)}" for _ in range(random.randrange(1, 30))] + [f"r{random.randrange(400)}" for _ in range(2)] for i in range(3000)}
    texts |= {9000 + i: ["c1", "c2", "tie"] for i in range(30)} | {9100: []}
    asked = {1: ["c1", "c2", "c3", "r7", "r8", "r9"], 2: ["c1", "c2", "tie"], 3: ["c4"], 4: ["nowhere"], 5: ["r7", "nowhere", "c5"]}
    docs = spark.createDataFrame(list(texts.items()), "id long, w array<string>")
    index, queries_ = search.build_index(docs, F.col("w")), search.expand(spark.createDataFrame(list(asked.items()), "query_id long, terms array<string>"))
    got = sorted((r.query_id, r.rank, r.id, r.score) for r in search.search(queries_, index).collect())
    held = {i: w for i, w in texts.items() if w}
    n, avg = len(held), sum(map(len, held.values())) / len(held)
    df = {t: sum(t in w for w in held.values()) for q in asked.values() for t in q}
    part = lambda t, w: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / avg))
    want = []
    for q, terms in asked.items():
        scores = [(-math.floor(sum(part(t, w) for t in terms) * 1e4 + 0.5) / 1e4, i) for i, w in held.items() if any(t in w for t in terms)]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:8], 1)]
    assert got == sorted(want)
    size = index.select("id", "len").distinct().agg(F.avg("len").alias("avg"))
    vectors = search._vectors(index, queries_.select("term").distinct(), size).withColumn("by", F.lit(1.0)).cache()
    found = search._posts(vectors).groupBy("term").agg(F.count("id").alias("df"), F.max("f").alias("most"))
    wanted = queries_.join(found, "term").select("query_id", "term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("w"), F.lit(True).alias("own"), "df", "most", F.lit(1.0).alias("up"))
    scored = {r.query_id: r.n for r in search._contenders(wanted, vectors, 8).groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    assert scored[1] < 100 and scored[2] < 100 and scored[5] < 100  # of some 2900 nodes that hold one of the words
    assert 30 <= scored[2]  # all that share the last score


def test_terms_are_counted_within_their_row(spark):
    from canonist.operators import search

    docs = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["x"])], "id long, w array<string>")
    index = search.build_index(docs, F.col("w"))
    assert sorted(map(tuple, index.collect())) == [(1, "a", 1, 3), (1, "b", 2, 3), (3, "x", 1, 1)]
    assert "Exchange" not in index._jdf.queryExecution().sparkPlan().toString() and "Aggregate" not in index._jdf.queryExecution().sparkPlan().toString()


def test_keys_of_quotations_are_few_and_enough(spark):
    """Of a short quotation one run is looked up, and none of its words alone; and of gaps between single tokens more are one edit than soft ones."""
    from canonist.functions import text as T
    from canonist.operators import align, verify

    for n in range(6, 400):
        k, e = align.allowed(n), n // 2
        assert 2 * (n - e - 3 * k - 1) - e > k and n - k > (verify.GRAM - 1) * (k + 1)
    words = "of the pilot on the pier may not leave at 7".split()
    quotes = spark.createDataFrame([(1, words), (2, words[:6] + ["x", "y"]), (3, [f"w{chr(97 + i)}" for i in range(25)])], "quote_id long, toks array<string>")
    keys = verify.asked_keys(quotes, T.HARD).groupBy("quote_id", "kind").count().collect()
    got = {(r.quote_id, r.kind): r["count"] for r in keys}
    assert got[1, "runs"] == got[2, "runs"] == 1 and got[3, "runs"] == 21
    assert got[1, "loose"] > 0 and (3, "loose") not in got


def test_equal_documents_are_audited_once(spark):
    from canonist.operators import audit
    from canonist.sources.scratch import Scratch

    text = "See Article 3(1) for the details."
    rows = [(1, text, "v1"), (2, text, "v1"), (3, text, "v2"), (4, None, "v1"), (5, "", "v1"), (6, "Article 9 applies.", "v1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, version string").withColumn("lang", F.lit("en"))
    nodes = spark.createDataFrame([("v1", "en", "art_3.par_1"), ("v2", "en", "art_9")], "version string, lang string, id string")
    different, copies = audit.once(docs)
    told = audit.mentions(different, nodes, Scratch(spark))
    assert told.count() == 4 and copies.count() == 6
    found = audit.of_all(told.select("doc_id", F.explode("refs.id").alias("ref"), F.col("refs")[0]["node"].alias("node")), copies)
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "art_3.par_1", "art_3.par_1"), (2, "art_3.par_1", "art_3.par_1"), (3, "art_3.par_1", None), (6, "art_9", None)]


def test_law_makes_only_what_is_asked_for(spark, monkeypatch):
    from canonist.plans import audits
    from canonist.sources.scratch import Scratch

    made, stored = [], Scratch.stored
    monkeypatch.setattr(Scratch, "stored", lambda self, df, label: made.append(label) or stored(self, df, label))
    held = audits.law(spark, SMALL, "moved")
    assert set(held) == {"nodes", "order", "moved"} and "resolved" not in made and "closure" not in made


def _tree(spark, version="v1", kids=3):
    rows = [(version, "r", None, "source", "", 0)] + [(version, f"r.{i}", "r", "document", f"h{i}", i * 10) for i in range(1, kids + 1)] + [(version, f"r.{i}.p", f"r.{i}", "line", f"t{i}", i * 10 + 1) for i in range(1, kids + 1)]
    return spark.createDataFrame(rows, "version string, id string, parent string, type string, hash string, ord long")


def test_closure_ends_when_no_jump_is_left(spark, monkeypatch):
    from canonist.operators import tree
    from canonist.sources.scratch import Scratch

    made, stored = [], Scratch.stored
    monkeypatch.setattr(Scratch, "stored", lambda self, df, label: made.append(label) or stored(self, df, label))
    got = tree.closure(_tree(spark)).groupBy("distance").count().collect()
    assert {r.distance: r["count"] for r in got} == {0: 7, 1: 6, 2: 3}
    assert made == ["parents", "jumps", "level", "jumps"]


def test_versions_meet_once_and_only_counts_are_shuffled_by_ancestor(spark, monkeypatch):
    from canonist.operators import diff, tree
    from canonist.sources.scratch import Scratch

    made, stored = [], Scratch.stored
    old = _tree(spark)
    new = old.withColumn("id", F.when(F.col("id") == "r.3.p", "r.2.q").otherwise(F.col("id"))).withColumn("parent", F.when(F.col("id") == "r.2.q", "r.2").otherwise(F.col("parent")))
    chains = tree.closure(old), tree.closure(new)
    monkeypatch.setattr(Scratch, "stored", lambda self, df, label: made.append(label) or stored(self, df, label))
    out = diff.rollup_diff(diff.diff_nodes(old, new), *chains)
    assert made == ["both"]
    got = {r.ancestor: (r.unchanged, r.changed, r.moved, r.added, r.removed) for r in out.collect()}
    assert got["r"] == (6, 0, 1, 0, 0) and got["r.2"] == (2, 0, 1, 0, 0) and got["r.3"] == (1, 0, 1, 0, 0) and got["r.2.q"] == got["r.3.p"] == (0, 0, 1, 0, 0)
    assert "keys=[status" not in out._jdf.queryExecution().executedPlan().toString()


def test_neighbours_without_the_nearest(spark):
    from canonist.operators import tree

    every, none = tree.neighbours(_tree(spark, kids=40), _tree(spark, kids=30)), tree.neighbours(_tree(spark, kids=40), _tree(spark, kids=30), most=0)
    assert sorted(map(str, every.drop("nearest").collect())) == sorted(map(str, none.drop("nearest").collect()))
    assert none.filter("size(nearest) > 0").isEmpty() and every.filter("id = 'r.20' and size(nearest) = 30 and siblings = 39").count() == 1


def test_only_last_answers_are_parsed(spark, monkeypatch):
    """The same rates whichever answers are parsed, but the text of one answer for each key reaches the parser."""
    from canonist.operators import evalstats
    from canonist.plans import logs

    last, every = logs.answers(spark, SMALL, last=True), logs.answers(spark, SMALL)
    assert last.count() == every.select(*evalstats.KEY).distinct().count() < every.count()
    seen = []
    monkeypatch.setattr(logs, "scored", lambda *a, f=logs.scored, **k: seen.append(k) or f(*a, **k))
    queries()["eval_tools"](spark, SMALL)
    assert seen == [{"last": True}]
    rates = lambda **k: sorted(map(tuple, evalstats.tool_use(logs.scored(spark, SMALL, **k), "a").collect()))
    assert rates(last=True) == rates()


@pytest.mark.parametrize("whole", [0, 200, 1 << 18])
def test_short_texts_are_joined_and_long_ones_cut(spark, monkeypatch, whole):
    """The same answers whether texts are joined whole or cut into blocks; texts are laid out over ranges only where some are long."""
    import random

    from canonist.operators import eligibility as E
    from canonist.sources.scratch import Scratch

    rng, made, stored = random.Random(3), [], Scratch.stored
    monkeypatch.setattr(Scratch, "stored", lambda self, df, label: made.append(label) or stored(self, df, label))
    rows = [(a, i, rng.choice(["", " "]).join(rng.choices(["a", "b", " ", "ab"], k=rng.randint(0, 9)))) for a, n in (("u", 15), ("v", 15), ("w", 90)) for i in range(n)]
    held = {a: " ".join(" ".join(t for x, _, t in rows if x == a).split()) for a in "uvw"}
    asked = [(f"{a}{n}", a, held[a][(at := rng.randint(0, len(held[a]) - 1)) : at + rng.randint(1, 30)][:: rng.choice([1, 1, -1])]) for a in "uvw" for n in range(40)]
    out = E.quotes_hold(spark.createDataFrame(asked, "id string, anchor string, quote string"), spark.createDataFrame(rows, "id string, ord long, text string").repartition(5), least=7, whole=whole)
    assert {r.id: r.holds for r in out.collect()} == {i: " ".join(q.split()) in held[a] for i, a, q in asked}
    assert ("laid" in made) == (whole < 1000) and len(held["u"]) < 200 < len(held["w"])


def test_chance_pairs_at_hard_tokens_are_no_stretches(spark, monkeypatch):
    """Common words around a number in every text: only texts that hold enough of a quotation are cut out; a number written over a word is still found."""
    import random

    from canonist.operators import verify

    rng, cut, seen = random.Random(2), verify.cut, []

    def counted(places, streams):
        seen.append(places.select("quote_id", "sid").distinct().count())
        return cut(places, streams)

    monkeypatch.setattr(verify, "cut", counted)
    words = "of the and to in that is by on it for at".split()
    texts = {f"t{i}": [*rng.choices(words, k=20), str(i), *rng.choices(words, k=20)] for i in range(60)}
    quotes = {i: rng.choices(words, k=12) for i in range(60)} | {90: texts["t7"][14:20] + ["of"] + texts["t7"][21:26]}
    streams = spark.createDataFrame([(k, k, 0, runs) for k, runs in texts.items()], "stream string, part string, first long, runs array<string>")
    asked = spark.createDataFrame([(k, [(" ".join(q), q)], len(q)) for k, q in quotes.items()], "quote_id long, segments array<struct<text:string,toks:array<string>>>, total int")
    got = {(r.quote_id, r.stream): r.hard for r in verify.found(asked, streams).select("quote_id", "stream", "hard").collect()}
    assert got[90, "t7"] == 1 and sum(seen) < 60


def test_quotations_that_stand_there_are_not_looked_up_again(spark, monkeypatch):
    """Of those found without an edit nobody asks for places with edits; one that is edited, and one that is not there, are looked up by all keys."""
    from canonist.operators import verify

    found, seen = verify.found, []

    def told(quotes, *rest):
        seen.append({r.quote_id for r in quotes.select("quote_id").collect()})
        return found(quotes, *rest)

    monkeypatch.setattr(verify, "found", told)
    a, b = [f"a{chr(97 + i)}" for i in range(25)], [f"b{chr(97 + i)}" for i in range(25)]
    texts = spark.createDataFrame([("x", a), ("y", a[:9] + ["7"] + a[10:]), ("z", b)], "part string, runs array<string>")
    quotes = {1: a, 2: b[:9] + ["q"] + b[10:], 3: b[:9] + ["8"] + b[10:], 4: ["none", "of", "these", "words", "is", "there"]}
    asked = spark.createDataFrame([(k, [(" ".join(q), q)], len(q)) for k, q in quotes.items()], "quote_id long, segments array<struct<text:string,toks:array<string>>>, total int")
    got = {(r.quote_id, r.stream): (r.soft, r["hard"]) for r in verify.searched(asked, None, verify.T.HARD, texts).collect()}
    assert got == {(1, "x"): (0, 0), (2, "z"): (1, 0), (3, "z"): (0, 1)} and seen == [{1, 2, 3, 4}, {2, 3, 4}]


def test_texts_are_copied_only_to_ancestors_whose_cell_is_filled(spark):
    """A cell beyond the limit is null, and no text goes to it; a text that is alone isn't grouped; an ancestor's order is that of the document."""
    from canonist.operators import tree

    rows = [("v", "s", None, "", 0), ("v", "s.a", "s", "", 1), ("v", "s.a.1", "s.a", "y" * 9, 2), ("v", "s.a.2", "s.a", "x" * 9, 3), ("v", "s.b", "s", "z" * 30, 4), ("v", "s.c", "s", "", 5)]
    nodes = spark.createDataFrame(rows, "version string, id string, parent string, text string, ord long")
    out = tree.subtree_text(nodes, tree.closure(nodes), most=40)
    assert {r.id: r.text for r in out.collect()} == {"s": None, "s.a": "y" * 9 + "\n" + "x" * 9, "s.a.1": "y" * 9, "s.a.2": "x" * 9, "s.b": "z" * 30}
    # lengths choose the ancestors before any text is joined; texts are not thrown away afterwards
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "(n#" in plan and "LeftSemi" not in plan
