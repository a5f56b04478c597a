"""Mini tables with results written by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from canonist.functions import text as T
from canonist.operators import align, diff, evalstats, rules, tree, verify, versions


def nodes(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "version string, id string, parent string, type string, text string, ord int").withColumn("hash", F.sha2("text", 256))


def test_diff_with_move_and_ambiguous(spark):
    old = nodes(spark, [("o", "a1", None, "t", "same"), ("o", "a2", None, "t", "old text"), ("o", "b1", None, "t", "moving text"), ("o", "c", None, "t", "gone"), ("o", "d1", None, "t", "dup"), ("o", "d2", None, "t", "dup")])
    new = nodes(spark, [("n", "a1", None, "t", "same"), ("n", "a2", None, "t", "new text"), ("n", "z9", None, "t", "moving text"), ("n", "e", None, "t", "brand new"), ("n", "f", None, "t", "dup")])
    out = diff.diff_nodes(old, new)
    got = {(r.status, r.from_id, r.to_id) for r in out.collect()}
    assert got == {("unchanged", "a1", "a1"), ("changed", "a2", "a2"), ("moved", "b1", "z9"), ("removed", "c", None), ("removed", "d1", None), ("removed", "d2", None), ("added", None, "e"), ("added", None, "f")}
    assert [r[0] for r in diff.ambiguous(out).collect()] == ["f"]


def test_rules_nearest_scope_exception_default(spark):
    n = nodes(spark, [("v", "c", None, "t", ""), ("v", "c.s", "c", "t", ""), ("v", "a1", "c.s", "t", ""), ("v", "p", "a1", "t", ""), ("v", "a", "p", "t", "x"), ("v", "a2", "c.s", "t", "x"), ("v", "a3", None, "t", "x")])
    none = []
    table = spark.createDataFrame([("default", 0, True, "2030-01-01", none, none, none), ("chapter", 1, False, "2025-01-01", ["c"], ["a2"], none), ("article", 2, False, "2026-01-01", ["a1"], none, none), ("point", 3, False, "2027-12-02", ["a"], none, ["2028-08-02"])], "rule_id string, pos int, is_default boolean, applies_from string, scope array<string>, except array<string>, later_dates array<string>")
    got = rules.resolve(tree.closure(n), table)
    assert {r.id: r.rule_id for r in got.collect()} == {"c": "chapter", "c.s": "chapter", "a1": "article", "p": "article", "a": "point", "a2": "default", "a3": "default"}
    on = {r.as_of: r.state for r in rules.state_on(got.filter("id = 'a'").withColumn("as_of", F.explode(F.array(*map(F.lit, ["2027-01-01", "2028-01-01", "2028-08-02"]))))).collect()}
    assert on == {"2027-01-01": "not_yet_applicable_until", "2028-01-01": "unknown", "2028-08-02": "in_force_at_as_of"}


def test_version_boundary_day_is_new(spark):
    known = spark.createDataFrame([("a", "2020-01-01"), ("b", "2024-08-01")], "version string, effective_from string")
    asked = spark.createDataFrame([("2010-01-01",), ("2024-07-31",), ("2024-08-01",)], "as_of string")
    assert {r.as_of: r.version for r in versions.version_as_of(asked, known).collect()} == {"2010-01-01": "a", "2024-07-31": "a", "2024-08-01": "b"}


def test_violations(spark):
    n = nodes(spark, [("v", "a", None, "t", "x"), ("v", "a.b", "a", "t", ""), ("v", "zz", "a", "t", "x"), ("v", "a.c", "q", "t", "x"), ("v", "a", None, "t", "x")])
    assert {(r.id, r.what) for r in tree.violations(n).collect()} >= {("a", "duplicate_id"), ("a.b", "empty"), ("zz", "odd_id"), ("a.c", "missing_parent")}


@pytest.mark.parametrize("k, n, want", [(22, 40, (0.3849, 0.7074)), (4, 40, (0.0279, 0.2366)), (3, 40, (0.0157, 0.2039)), (4, 30, (0.0376, 0.3072)), (0, 10, (0.0, 0.3085))])
def test_exact_interval(k, n, want):
    assert tuple(round(x, 4) for x in evalstats.clopper_pearson(k, n)) == want


def test_soft_edits_allowed():
    assert [align.allowed(n) for n in (6, 19, 20, 39, 40)] == [0, 0, 1, 1, 2]


def test_best_window_against_brute_force():
    rng = np.random.default_rng(1)

    def edits(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(last + (x != y), d[j] + 1, d[j - 1] + 1)
        return d[-1]

    for _ in range(150):
        q, t = rng.integers(0, 4, rng.integers(1, 6)), rng.integers(0, 4, rng.integers(1, 9))
        least = min(edits(q, t[a:b]) for a in range(len(t) + 1) for b in range(a, len(t) + 1))
        cost, a, b = align.best_window(q, t)
        assert cost == least == edits(q, t[a:b])


def test_quotation_statuses(spark):
    base = "the provider shall not place on the market any of these twenty systems unless they have been checked by somebody else before"
    rows = [(str(i), t, i) for i, t in enumerate([base, "one text that is held twice here", "one text that is held twice here"], 1)]
    corpus = spark.createDataFrame(rows, "id string, text string, ord long").withColumns({"version": F.lit("v"), "lang": F.lit("en"), "type": F.lit("article")})
    asked = spark.createDataFrame([(1, base.upper()), (2, base.replace("market", "bazaar")), (3, base.replace("shall not", "shall")), (4, base.replace("twenty", "17")), (5, "one text that is held twice here"), (6, "too short a one"), (7, "words that nobody ever wrote in any such place"), (8, None)], "quote_id long, quote string")
    asked = asked.withColumns({"claimed": F.lit(None).cast("string"), "version": F.lit("v"), "lang": F.lit("en")})
    chain = corpus.select("version", "lang", "id", F.col("id").alias("ancestor"), F.lit(0).alias("distance"))
    got = {r.quote_id: r.status for r in verify.verify(asked, corpus, chain).collect()}
    assert got == {1: "fuzzy", 2: "fuzzy", 3: "mismatch_hard_token", 4: "mismatch_hard_token", 5: "multiple_matches", 6: "too_short", 7: "not_found", 8: "too_short"}


def test_dates_and_claims(spark):
    rows = spark.createDataFrame([("2027-12-02",), ("2.12.2027",), ("2 December 2027",), ("December 2, 2027",), ("2nd of December 2027",), ("2. Dezember 2027",), ("31 February 2027",), ("soon",)], "s string")
    assert [r[0] for r in rows.select(T.parse_date(F.col("s"))).collect()] == ["2027-12-02"] * 6 + [None, None]
    claims = spark.createDataFrame([("yes", "Ja, sicher"), ("no", "Yes"), ("Art", "see article 5")], "c string, a string")
    assert [r[0] for r in claims.select(T.claim_holds(F.col("c"), F.col("a"))).collect()] == [True, False, True]


def test_normalize_and_hard_tokens(spark):
    row = spark.createDataFrame([("“A  b”\n\n c­–d é",)], "s string")
    assert row.select(T.normalize(F.col("s"))).first()[0] == '"A b"\nc–d é'
    toks = spark.createDataFrame([(["you", "may", "not", "5", "may", "six"],)], "t array<string>")
    assert toks.select(T.hard_flags(F.col("t"))).first()[0] == [False, False, True, True, True, True]


def test_last_line_wins_and_majority(spark):
    runs = spark.createDataFrame([(1, "c", "m", "a", 1, False, 1.0, None), (2, "c", "m", "a", 1, True, 1.0, None), (3, "c", "m", "a", 2, False, 1.0, None), (4, "c", "m", "a", 3, None, 1.0, None), (5, "d", "m", "a", 1, None, 1.0, "x")], "seq long, case_id string, model string, arm string, rep int, correct boolean, cost double, error string")
    got = {r.case_id: (r.wrong, r.any_wrong, r.excluded) for r in evalstats.case_verdicts(evalstats.latest(runs)).collect()}
    assert got == {"c": (False, True, False), "d": (False, False, True)}
    total = evalstats.cells(runs).filter("model = 'm' and arm = 'a'").first()
    assert (total.cost, total.runs, total.errors) == (5.0, 4, 1)


def test_word_diff_rebuilds_both_sides_and_keeps_the_most():
    import random

    from canonist.operators.worddiff import word_diff

    rng = random.Random(5)
    for _ in range(300):
        a, b = (rng.choices("abcd", k=rng.randint(0, 9)) for _ in range(2))
        runs = word_diff(a, b)
        side = lambda skip: [w for op, t in runs if op != skip for w in t.split()]  # noqa: B023, E731
        assert side("insert") == a and side("delete") == b
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert sum(len(t.split()) for op, t in runs if op == "equal") == best[len(a)][len(b)]
        assert all(x[0] != y[0] for x, y in zip(runs, runs[1:]))
    assert word_diff(["a", "b", "c"], ["a", "x", "c"]) == [("equal", "a"), ("delete", "b"), ("insert", "x"), ("equal", "c")]
    assert word_diff(["a", "b"], ["c", "d"], most=1) == [("delete", "a b"), ("insert", "c d")]


def test_obligations_on_null_fields_and_cycles(spark):
    import pytest

    from canonist.operators import eligibility as E

    p = spark.createDataFrame([(1, None, None, "2026-01-01"), (2, ["x"], True, "2026-01-01"), (None, [], None, "2026-01-01")], "profile_id long, roles array<string>, big boolean, as_of string")
    rules_ = [{"id": "r", "roles": ["x"], "effective": "2026-02-01"}, {"id": "n", "applies_if": {"not": {"eq": ["big", True]}}}]
    got = sorted((r.profile_id or 0, r.id, r.status, r.days) for r in E.obligations_of(p, rules_).collect())
    assert got == [(0, "n", "depends", None), (1, "n", "depends", None), (2, "r", "upcoming", 31)]
    assert [r.profile_id for r in E.open_questions(p.filter("profile_id = 1"), rules_, {"big": [True, False]}).collect()] == [1]
    with pytest.raises(ValueError):
        E.with_derived(p, {"a": {"eq": ["b", True]}, "b": {"eq": ["a", True]}})
    with pytest.raises(ValueError):
        E.condition({"like": ["a", "b"]})
    assert E.obligations_of(p.filter("false"), rules_).count() == 0


def test_word_diff_aligns_at_every_size():
    import random

    from canonist.operators.worddiff import word_diff

    words = [f"w{i}" for i in range(2100)]
    new = ["x", *words[1:1000], "y", *words[1000:-2], "z", words[-1], "end"]
    want = [("delete", "w0"), ("insert", "x"), ("equal", " ".join(words[1:1000])), ("insert", "y"), ("equal", " ".join(words[1000:-2])), ("delete", words[-2]), ("insert", "z"), ("equal", words[-1]), ("insert", "end")]
    assert word_diff(words, new) == want
    rng = random.Random(4)
    for _ in range(200):
        a, b = (rng.choices("abcd", k=rng.randint(0, 25)) for _ in "ab")
        assert word_diff(a, b, most=rng.choice([1, 7, 40])) == word_diff(a, b)


def test_neighbours_nearest_siblings(spark):
    rows = [("v", "c", None, "t", "")] + [("v", f"c.{i}", "c", "line" if i % 2 else "t", "x") for i in range(100)]
    rows += [("v", i, None, "article", "x") for i in ("art_1", "art_2", "art_2a", "art_2b", "art_3", "art_4")]
    n = nodes(spark, rows)
    got = {r.id: r for r in tree.neighbours(n, n.filter("id != 'c.1'"), 30).collect()}
    for i in range(100):
        want = sorted(sorted((j for j in range(100) if j != i), key=lambda j: (abs(j - i), j))[:30])
        assert got[f"c.{i}"].siblings == 99 and [x.id for x in got[f"c.{i}"].nearest] == [f"c.{j}" for j in want]
    assert [x.id for x in got["c.0"].nearest if x.missing] == ["c.1"] and got["c.1"].missing
    assert {i: [x.id for x in got[i].nearest] for i in ("art_1", "art_2a", "art_4", "c")} == {"art_1": ["art_2"], "art_2a": ["art_1", "art_2", "art_2b", "art_3"], "art_4": ["art_3"], "c": []}
    assert got["art_2a"].siblings == 4


def test_search_of_whole_texts(spark, tmp_path):
    import collections
    import math
    import random

    from canonist.plans import queries

    rng = random.Random(3)
    texts = {i: " ".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(5, 60))) for i in range(40)}
    asked = {i: " ".join(rng.choices("abcdefghijklmnopqrst", k=16)) for i in range(6)}
    spark.createDataFrame([*texts.items(), (99, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*asked.items()], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = collections.defaultdict(list)
    for r in queries.QUERIES["search_bm25_whole"](spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, r.score))
    held = {i: collections.Counter(t.split()) for i, t in texts.items()}
    mean = sum(c.total() for c in held.values()) / len(held)
    for q, text in asked.items():
        idf = {w: math.log(1 + (len(held) - df + 0.5) / (df + 0.5)) for w in set(text.split()) if (df := sum(w in c for c in held.values()))}
        score = {i: sum(x * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for w, x in idf.items() if w in c) for i, c in held.items()}
        best = sorted(score, key=lambda i: (-math.floor(score[i] * 1e4 + 0.5) / 1e4, i))[:8]
        assert [i for i, _ in got[q]] == best and [s for _, s in got[q]] == pytest.approx([score[i] for i in best], abs=1e-4)


def test_quotes_verified_searches_every_passage_whole(spark, tmp_path):
    from canonist.plans import queries

    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, text), (3, text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.quote_id: r.status for r in queries.QUERIES["quotes_verified"](spark, str(tmp_path)).collect()}
    assert got == {0: "exact", 3: "exact", -4: "too_short"}


def test_closure_of_a_long_chain_and_of_lost_parents(spark):
    """300 nodes one below the other in ten rounds; a parent that is no node is an ancestor, but has no row of its own."""
    rows = [("v", f"n{i}", f"n{i - 1}" if i else None) for i in range(300)] + [("v", "x", "lost"), ("w", "n1", "n0")]
    got = [(r.version, r.id, r.ancestor, r.distance) for r in tree.closure(spark.createDataFrame(rows, "version string, id string, parent string")).collect()]
    want = {("v", f"n{i}", f"n{j}", i - j) for i in range(300) for j in range(i + 1)} | {("v", "x", "x", 0), ("v", "x", "lost", 1), ("w", "n1", "n1", 0), ("w", "n1", "n0", 1)}
    assert len(got) == len(want) and set(got) == want
    with pytest.raises(ValueError, match="lead back"):
        tree.closure(spark.createDataFrame([("v", "a", "c"), ("v", "b", "a"), ("v", "c", "b"), ("v", "d", "c")], "version string, id string, parent string"))
    assert tree.closure(spark.createDataFrame([], "version string, id string, parent string")).count() == 0


def test_neighbours_over_many_blocks(spark):
    """Blocks of 8 places: a parent of 100 children and 40 roots lie over many of them; against plain windows of each group."""
    from canonist.operators.ranges import near

    rows = [(g, i, f"{g}{i}") for g, n in (("a", 100), ("b", 1), ("c", 9), (None, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, o int, id string").repartition(7)
    got = {r.id: [x.value for x in r.near] for r in near(df, ["g"], ["o"], F.col("id"), 5, block=8).collect()}
    members = {g: [r[2] for r in rows if r[0] == g] for g in ("a", "b", "c", None)}
    assert got == {i: members[g][max(0, o - 5) : o + 6] for g, o, i in rows}
    assert near(df.filter("false"), ["g"], ["o"], F.col("id"), 5, block=8).count() == 0
    with pytest.raises(ValueError):
        near(df, ["g"], ["o"], F.col("id"), 9, block=8)
