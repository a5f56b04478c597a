"""Search, answers and their scores, eligibility by rules, readers, pages and manifests on mini inputs."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from canonist.functions import text as T
from canonist.operators import eligibility as E
from canonist.operators import evalstats, search, tree
from canonist.sources import io, sinks

NODE = "version string, id string, parent string, type string, heading string, text string, ord long"


def hits(spark, nodes, query, version="new", k=8):
    postings, documents = search.index_nodes(nodes, tree.closure(nodes))
    asked = search.ask(spark.createDataFrame([(1, version, query)], "query_id long, version string, query string"), search.synonym_table(spark))
    return search.shown(search.ranked(asked, postings, documents, k), asked).orderBy("rank").collect()


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("cpt_1", None, "chapter", "Sandboxes and other sundry measures", ""), ("art_1", "cpt_1", "article", "Scope", ""), ("art_1.par_1", "art_1", "paragraph", "", "This Regulation lays down rules on testing of systems in a sandbox under supervision of the competent authority.")]
    rows += [("art_1.par_2", "art_1", "paragraph", "", "The competent authority shall publish guidance. " + "Filler words about nothing in particular. " * 40), ("art_2", "cpt_1", "article", "Penalties", ""), ("art_2.par_1", "art_2", "paragraph", "", "Penalties shall be effective, proportionate and dissuasive, and the competent authority applies them.")]
    held = [(v, *r[:3], r[3], r[4], n) for v in ("old", "new") for n, r in enumerate(rows)]
    return spark.createDataFrame([*held, ("new", "art_3", "cpt_1", "article", "", "A novel provision about quantum widgets that exists only in the consolidated text.", 9), ("old", "rec_1", None, "recital", "", "A recital about widgets of the old kind.", 9)], NODE)


def test_ranks(spark, corpus):
    ids = [h.id for h in hits(spark, corpus, "competent authority")]
    assert ids.index("art_1.par_1") < ids.index("art_1.par_2")
    assert hits(spark, corpus, "sandbox")[0].id == "art_1.par_1"
    whole, mixed = hits(spark, corpus, "effective proportionate dissuasive")[0], hits(spark, corpus, "dissuasive proportionate effective")[0]
    assert (whole.id, whole.citation, whole.heading) == ("art_2.par_1", "Article 2(1)", "Penalties") and whole.score > mixed.score
    assert hits(spark, corpus, "quantum widgets")[0].id == "art_3" and "rec_1" in [h.id for h in hits(spark, corpus, "quantum widgets", "old")]
    assert "art_2.par_1" in [h.id for h in hits(spark, corpus, "sanction")]
    assert len(hits(spark, corpus, "authority sandbox penalties scope widgets", k=0)) == 1 and hits(spark, corpus, "") == hits(spark, corpus, "zzzqqq") == []


def test_scores_against_plain_python(spark, corpus):
    import math
    import re

    size = lambda t: len(re.findall(r"\w+", t))
    lengths = {r.id: size(r.text) + 3 * size(r.heading) for r in corpus.filter("version = 'new'").collect()}
    mean = sum(lengths.values()) / len(lengths)
    # the stem stands in the heading of art_2, and in art_2.par_1: once in its text, twice as its context
    idf = math.log(1 + (len(lengths) - 2 + 0.5) / 2.5)
    score = lambda tf, n: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))
    # the words are those of a topic, but art_99 is not there
    assert {h.id: h.score for h in hits(spark, corpus, "penalty")} == {"art_2": pytest.approx(score(3, lengths["art_2"]) * 0.85, abs=1e-4), "art_2.par_1": pytest.approx(score(3, lengths["art_2.par_1"]), abs=1e-4)}


def test_stems_and_snippets(spark):
    en = "penalties penalty sandboxes sandbox systems processing assessed bias processes".split()
    got = dict(spark.createDataFrame([(w,) for w in en], "w string").select("w", T.stem(F.col("w"))).collect())
    assert got == {"penalties": "penalty", "penalty": "penalty", "sandboxes": "sandbox", "sandbox": "sandbox", "systems": "system", "processing": "process", "assessed": "assess", "bias": "bias", "processes": "process"}
    de = dict(spark.createDataFrame([(w,) for w in "kennzeichnungen sanktionen geldbußen geldbuße kmu".split()], "w string").select("w", T.stem(F.col("w"), "de")).collect())
    assert de == {"kennzeichnungen": "kennzeichnung", "sanktionen": "sanktion", "geldbußen": "geldbuß", "geldbuße": "geldbuß", "kmu": "kmu"}
    text = " ".join(f"word{i}" for i in range(100)) + " needle " + " ".join(f"more{i}" for i in range(100))
    row = spark.createDataFrame([(text, ["needle"]), ("short  text", ["x"]), (text, ["nowhere"])], "s string, t array<string>")
    row = [(r.snippet,) for r in T.with_snippets(row, "s", "t").collect()]
    assert "needle" in row[0][0] and row[0][0].startswith("…word") and row[0][0].endswith("…") and len(row[0][0]) <= 240
    assert row[1][0] == "short text" and row[2][0].startswith("word0 word1") and len(row[2][0]) <= 240


def test_answers(spark):
    raw = ['Sure. {"answer": "use {braces} freely", "date": "2027-12-02"} {"date": "1999-01-01"}', '{"date": null, "article": ["x"], "foo": 1, "version": 2026}', "[1,2]", "```json\nnot json\n```", 'a ```json\n{"verdict": true}\n``` {', '{"a": ', None, '{"date": NaN}']
    got = [r[0] for r in spark.createDataFrame([(r,) for r in raw], "s string").select(T.parse_answer(F.col("s"))).collect()]
    assert (got[0].date, got[0].answer) == ("2027-12-02", "use {braces} freely") and (got[1].date, got[1].article, got[1].version) == (None, None, "2026")
    assert got[2] is got[3] is got[5] is got[6] is got[7] is None and got[4].verdict == "true"
    spelled = ["2027-12-02", "2 December 2027", "December 2, 2027", "02.12.2027", "2. Dezember 2027", "2nd December 2027", "Applies from 2027-12-02.", "2027-02-30", "soon"]
    assert [r[0] for r in spark.createDataFrame([(s,) for s in spelled], "s string").select(T.parse_date(F.col("s"))).collect()] == ["2027-12-02"] * 7 + [None, None]
    named = [("2024/1689 as amended by 2026/1744",), ("2024/1689 and 2026/1744",), ("32026R1744",), ("the Amtsblatt",), ("consolidated",)]
    assert [(r[0], r[1]) for r in spark.createDataFrame(named, "s string").select(T.version_named(F.col("s")), T.named_version(F.col("s"))).collect()] == [(T.NEWER, T.NEWER), ("both", T.NEWER), (T.NEWER, None), (T.OLDER, T.OLDER), (None, T.NEWER)]
    claims = [("yes", "Ja, sicher"), ("no", "Yes"), ("Art ", "see article 5"), ("No later than 2027", "no later than 2027."), ("yes", None)]
    assert [r[0] for r in spark.createDataFrame(claims, "c string, a string").select(T.claim_holds(F.col("c"), F.col("a"))).collect()] == [True, False, True, True, False]


PARSED = "struct<date:string,version:string,article:string,quote:string,answer:string,verdict:string>"
EXPECTED = "struct<date:string,version:string,articles:array<string>,verdict:string,claim:string>"


def test_scores_of_answers(spark):
    cases = spark.createDataFrame([("g", "generation", ("2027-12-02", None, ["art_6", "art_113"], None, None)), ("e", "evaluation", (None, None, None, "correct", None)), ("n", "generation", (None, None, None, None, None))], f"case_id string, kind string, expected {EXPECTED}")
    p = lambda date=None, article=None, verdict=None: (date, None, article, None, None, verdict)
    runs = [("g", p("2 December 2027", "Article 6(2)")), ("g", p("2027-12-02", "art_113.sub_3.c")), ("g", p("2027-12-02", "Article 60")), ("g", p("2027-12-02")), ("e", p()), ("e", p(verdict=" Correct ")), ("n", p()), ("g", None)]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(runs)], f"seq int, case_id string, parsed {PARSED}")
    got = {r.seq: (r.correct, r.checks) for r in evalstats.score(rows, cases).collect()}
    assert [got[i][0] for i in range(8)] == [True, True, False, False, False, True, True, None]
    assert got[2][1] == {"date": True, "article": False} and got[7][1] == {} and got[6][1] == {}
    stale = rows.withColumn("checks", F.create_map(F.lit("verdict"), F.lit(True))).withColumn("correct", F.lit(True))
    assert {r.seq for r in evalstats.rescored(stale, cases).filter("changed").collect()} == {0, 1, 2, 3, 4, 6, 7}


def test_strata_and_unparseable(spark):
    rows = [("a", 1, None), ("a", 2, None), ("a", 3, False), ("b", 1, None), ("b", 2, False), ("b", 3, False), ("c", 1, None), ("c", 2, None), ("c", 3, None)]
    runs = spark.createDataFrame([(n, c, "m", "x", rep, ok, "s1" if c == "a" else "s2", n % 2, None) for n, (c, rep, ok) in enumerate(rows)], "seq int, case_id string, model string, arm string, rep int, correct boolean, subset string, tool_calls int, error string")
    got = {r.subset: (r.cases, r.excluded, r.wrong, r.any_wrong, r.strict_wrong, r.unparseable) for r in evalstats.cells_by(runs, "subset").collect()}
    assert got == {None: (2, 1, 1, 2, 3, 6), "s1": (1, 0, 0, 1, 1, 2), "s2": (1, 1, 1, 1, 2, 4)}
    use = evalstats.tool_use(runs, "x").first()
    assert (use.rate, use.scored_with, use.wrong_with, use.scored_without, use.wrong_without) == (0.4444, 1, 1, 2, 2)


def test_fields_dates_and_changes(spark):
    assert E.spec_of("bool, default true; x") == {"type": "boolean", "default": True} and E.spec_of("null or string '1'..'3'; x")["values"] == ["1", "2", "3"] and E.spec_of("enum a|b")["values"] == ["a", "b"]
    fields = {"role": "array of enum p|d", "flag": "bool, default true", "day": "null or ISO date", "size": "null or enum 'S'|'M'"}
    rows = [(1, ["p", "p"], None, "2026-02-28", "S", None), (2, [], True, None, None, None), (3, ["x"], False, "2026-02-30", "L", 5)]
    clean, bad = E.normalized(spark.createDataFrame(rows, "profile_id int, role array<string>, flag boolean, day string, size string, odd int"), fields)
    assert [(r.profile_id, r.role, r.flag) for r in clean.collect()] == [(1, ["p"], True)]
    assert sorted((r.id, r.field) for r in bad.collect()) == [(2, "role"), (3, "day"), (3, "odd"), (3, "role"), (3, "size")]
    dates = {"default": "2026-08-02", "art6-par2-annex3": "2027-12-02", "art6-par1-annex1": "2028-08-02", "ch3s1-3": "2026-08-02"}
    profiles = spark.createDataFrame([(1, [], "2026-10-05", True, True), (2, [], "2026-10-05", False, False), (3, [], "2026-10-05", None, True)], "profile_id int, roles array<string>, as_of string, high_risk_annex_iii boolean, high_risk_annex_i boolean")
    rules_ = [{"id": "both", "timing": {"basis": "hr_route"}}, {"id": "simple", "timing": {"basis": "hr_route", "literal_rule": "ch3s1-3", "route": "annex_iii"}}, {"id": "late", "timing": {"basis": "deadline_table", "not_before": "2030-01-01"}}, {"id": "open", "timing": {"basis": "transition"}}]
    found = E.obligations_of(profiles, rules_, dates=dates)
    got = {(r.profile_id, r.id): (r.effective, r.literal, r.routes, r.status, r.days) for r in found.collect()}
    assert got[1, "both"] == ("2027-12-02", "2026-08-02", ["2027-12-02", "2028-08-02"], "upcoming", 423) and got[3, "both"][0] == "2028-08-02" and got[2, "both"][:3] == ("2026-08-02", None, None)
    assert got[1, "simple"][:3] == ("2027-12-02", None, None) and got[3, "simple"][0] == "2026-08-02" and got[1, "late"][0] == "2030-01-01" and got[1, "open"][3:] == ("depends", None)
    assert {r.profile_id for r in E.obligations_of(profiles, rules_, dates=dates, scope="high_risk_annex_iii").collect()} == {1, 3}
    older = spark.createDataFrame([("n1", "2026-08-02"), ("n2", "2030-01-01")], "id string, applies_from string")
    entries = spark.createDataFrame([("both", "n1", False, True), ("simple", "gone", True, True), ("late", "n2", False, True), ("open", "n1", False, False)], "id string, anchor string, marked boolean, timed boolean")
    assert {r.id: r.changed for r in E.changed_dates(found.filter("profile_id = 1"), older, entries).collect()} == {"both": True, "simple": True, "late": False, "open": False}
    held = E.quotes_hold(spark.createDataFrame([("a", "x", "two  words"), ("b", "x", "other"), ("c", "y", "z")], "id string, anchor string, quote string"), spark.createDataFrame([("x", 1, "has two\nwords")], "id string, ord long, text string"))
    assert {r.id: r.holds for r in held.collect()} == {"a": True, "b": False, "c": False}


def test_readers(spark, tmp_path):
    (tmp_path / "c").mkdir()
    node = {"id": "art_1", "type": "article", "parent": None, "heading": "H", "text": "T", "hash": "h", "node_hash": "n", "order": 0, "source_anchor": "a"}
    (tmp_path / "c" / "x.json").write_text(json.dumps({"celex": "C", "lang": "en", "nodes": [node, {**node, "id": "art_1.par_1", "parent": "art_1", "order": 1}]}, indent=1))
    assert [(r.celex, r["at"], r.id, r.parent) for r in io.read_corpus(spark, f"{tmp_path}/c").orderBy("at").collect()] == [("C", 0, "art_1", None), ("C", 1, "art_1.par_1", "art_1")]
    (tmp_path / "rules.json").write_text(json.dumps({"versions": {"v": {"default": {"id": "default", "applies_from": "2030-01-01", "source_nodes": ["z"]}, "rules": [{"id": "r", "applies_from": "2025-01-01", "scope": ["a"], "except": ["b"], "later_dates": [{"applies_from": "2027-01-01"}, {"applies_from": "2026-01-01"}]}]}, "w": {"rules": []}}}, indent=1))
    got = [(r.version, r.rule_id, r.pos, r.is_default, r.scope, r["except"], r.later_dates) for r in io.read_rules(spark, f"{tmp_path}/rules.json").orderBy("pos").collect()]
    assert got == [("v", "default", 0, True, [], [], []), ("v", "r", 1, False, ["a"], ["b"], ["2026-01-01", "2027-01-01"])]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    (tmp_path / "log" / "b.jsonl").write_text('{"x": 3}\n')
    assert [r.x for r in io.read_log(spark, f"{tmp_path}/log", "x int").orderBy("seq").collect()] == [1, 2, 3]


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("v", "en", f"a{i}", 9 - i) for i in range(10)] + [("w", "en", "b", 1)], "version string, lang string, id string, ord int")
    for name in ("one", "two"):
        sinks.write_nodes(nodes.repartition(3), f"{tmp_path}/{name}")
    back = spark.read.parquet(f"{tmp_path}/one/version=v")
    assert [r.id for r in back.collect()] == [f"a{i}" for i in range(9, -1, -1)] and back.exceptAll(spark.read.parquet(f"{tmp_path}/two/version=v")).count() == 0
    (tmp_path / "f").mkdir()
    for name, text in {"a.txt": "one", "b.txt": "two"}.items():
        (tmp_path / "f" / name).write_text(text)
    listed = sinks.manifest(spark, f"{tmp_path}/f", spark.createDataFrame([("a.txt",), ("a.txt",)], "path string"))
    assert [(r.path, r.sha256, r.bytes, r.nodes) for r in listed.collect()] == [("a.txt", hashlib.sha256(b"one").hexdigest(), 3, 2), ("b.txt", hashlib.sha256(b"two").hexdigest(), 3, None)]
    held = spark.createDataFrame(listed.collect(), listed.schema)
    assert sinks.manifest_holds(sinks.check_manifest(held, held)).first().ok
    os.remove(tmp_path / "f" / "a.txt")
    (tmp_path / "f" / "b.txt").write_text("tw0")
    (tmp_path / "f" / "c.txt").write_text("new")
    now = {r.path: (r.listed, r.present, r.sha256_ok, r.bytes_ok) for r in sinks.check_manifest(held, sinks.manifest(spark, f"{tmp_path}/f")).collect()}
    assert now == {"a.txt": (True, False, False, False), "b.txt": (True, True, False, True), "c.txt": (False, True, False, False)}


def test_page_trees(spark):
    html = "<html><title>T</title><body><nav><p>Menu</nav><p>Intro<p>More<h1>One</h1><p>Text one<ul><li>a<li>b</ul><h2>Sub</h2><p>Deep</p><h1>Two<p>End<script>x</script></body>"
    rows = io.parse_pages(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("page_id", "ord").collect()
    assert [(r.id, r.parent, r.heading, r.text) for r in rows if r.page_id == 1] == [("page", None, "", "Intro"), ("page.sub_2", "page", "", "More"), ("page.sct_1", "page", "One", "Text one"), ("page.sct_1.pt_1", "page.sct_1", "", "a"), ("page.sct_1.pt_2", "page.sct_1", "", "b"), ("page.sct_1.sct_1", "page.sct_1", "Sub", "Deep"), ("page.sct_2", "page", "Two", "End")]
    assert [(r.id, r.text) for r in rows if r.page_id == 2] == [("page", "")]


def test_closure_of_deep_trees_and_loops(spark):
    rows = [("v", f"n{i}", f"n{i - 1}" if i else None, "t", "", f"x{i}", i) for i in range(45)]
    nodes = spark.createDataFrame(rows, NODE)
    chain = tree.closure(nodes)
    assert chain.count() == 45 * 46 // 2 and chain.agg(F.max("distance")).first()[0] == 44
    assert [r.nth for r in tree.descendants(nodes, chain).filter("ancestor = 'n40'").orderBy("nth").collect()] == [1, 2, 3, 4]
    text = {r.id: r.text for r in tree.subtree_text(nodes, chain, most=12).collect()}
    assert text["n42"] == "x42\nx43\nx44" and text["n0"] is None
    with pytest.raises(ValueError):
        tree.closure(spark.createDataFrame([("v", "a", "b", "t", "", "", 1), ("v", "b", "a", "t", "", "", 2)], NODE))


def test_quotations_held_over_blocks_against_whole_texts(spark):
    """Streams of up to 40 short rows in blocks of 7 characters, quotations of up to 30."""
    import random

    rng = random.Random(8)
    rows = [(a, i, rng.choice(["", " "]).join(rng.choices(["a", "b", " ", "\n", "ab"], k=rng.randint(0, 9)))) for a in "uvw" for i in range(40)]
    rows += [("hot", i, "a b") for i in range(400)] + [("blank", 0, " \n"), ("null", 0, None)]
    whole = {a: " ".join(" ".join(t for x, _, t in rows if x == a and t).split()) for a in {r[0] for r in rows}}
    asked = [(f"{a}{n}", a, whole[a][(at := rng.randint(0, len(whole[a]) - 1)) : at + rng.randint(1, 30)][:: rng.choice([1, 1, -1])]) for a in ("u", "v", "w", "hot") for n in range(60)]
    asked += [("none", "lost", "a"), ("q", "u", None), ("e", "u", ""), ("f", "blank", ""), ("g", "null", "a")]
    got = {r.id: r.holds for r in E.quotes_hold(spark.createDataFrame(asked, "id string, anchor string, quote string"), spark.createDataFrame(rows, "id string, ord long, text string").repartition(5), least=7).collect()}
    assert got == {i: q is not None and bool(whole.get(a)) and " ".join(q.split()) in whole[a] for i, a, q in asked}
    assert {*got.values()} == {True, False}
