"""Small tables with nulls, empty and repeated rows, ties and clashing columns; brute force where SQL says nothing."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from canonist.llm import ann, chat, components, decontam, dedup, html, lines, packing, quality, secrets, toxicity

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i if i != 99 else None, t, None, "s", None if t is None else len(t)) for i, t in texts], DOCS)


def test_tokens_as_the_library_makes_them():
    import pyarrow as pa

    e = packing.Encoder(PATH)
    texts = ["  a\n\n b\t \tc  ", "", "   ", "x<|endoftext|>y", "don't wo!'s abc's a1b2 éa-b xд дx", "a \n b\n c \t\nd ", " a\xa0b", "a  b", "ß" * 50]
    assert e.many(pa.array(texts)) == [packing.pack_ids(e.whole(t)) for t in texts]


@pytest.mark.parametrize("low, high, n", [(270, 1370, 1500), (600, 760, 900)])
def test_packing_generations_beat_best_fit(low, high, n):
    """Where best-fit decreasing leaves room, crossover of whole bins needs fewer."""
    sizes = [int(x) for x in np.random.default_rng(3).integers(low, high, n)]
    seed = packing.packed(sorted(range(n), key=lambda i: -sizes[i]), sizes, 2048)
    best = packing.evolved(sizes, [], 2048, np.random.default_rng(1), packing.GENERATIONS, packing.POPULATION)
    assert len(best) < len(seed) and sorted(i for b in best for i in b) == list(range(n)) and max(sum(sizes[i] for i in b) for b in best) <= 2048


def test_packing_is_gapless_and_tight(spark):
    rng = random.Random(1)
    texts = [(1, None), (2, ""), (2, ""), (99, "a b c")] + [(i, " ".join(rng.choices("alpha beta gamma".split(), k=rng.randint(1, 3000)))) for i in range(10, 60)]
    out = packing.pack_documents(docs(spark, texts).withColumn("piece", F.lit("clash")), PATH, shard=20).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(r.length for r in out)
    assert len(by) <= -(-total // 2048) + 2
    assert sum(r.length for r in out if r.doc_id == 2) == 2
    assert packing.pack_documents(docs(spark, []), PATH).count() == 0


def brute_components(texts, width, part):
    def of(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets, up = [of(t) for _, t in texts], list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= part * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("width, part", [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, width, part):
    rng = random.Random(width)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(120)]
    texts = [(0, None), (1, ""), (2, "one"), (3, "one"), (4, " \t\n")]
    for i in range(5, 60):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 99)}"
        texts.append((i, " ".join(w)))
    got = {r.doc_id: r for r in dedup.near_duplicates(docs(spark, texts).withColumns({c: F.lit("clash") for c in ("node", "__n", "__uid", "component", "keep", "text2")}), width, (part, 100)).collect()}
    assert [got[i]["__component"] for i, _ in texts] == brute_components(texts, width, part)
    assert sum(r["__keep"] for r in got.values()) == len(set(brute_components(texts, width, part)))
    assert dedup.near_duplicates(docs(spark, [])).count() == 0


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    rows[5] = (5, rows[0][1])
    rows += [(500, None), (550, [0.0] * 8), (600, [float("nan")] * 8), (650, [1.0, 2.0]), (None, rows[3][1]), (7, rows[7][1])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = collections.defaultdict(list)
    for r in ann.nearest(t, t.filter("vec_id % 50 = 0"), 5, leaf=40).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    ids, x = np.arange(400), np.asarray([v for _, v in rows[:400]])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = {q: set(sorted(ids[ids != q], key=lambda i: (-x[q] @ x[i], i))[:5]) for q in range(0, 400, 50)}
    assert set(got) == set(true) and got[0][0] == 5
    assert np.mean([len(true[q] & set(got[q])) / 5 for q in true]) >= 0.9
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert ann.nearest(few, few, 5).count() == 6


def test_chat_round_trip_and_rewritten_history(spark):
    turns = [("user", "</s>[INST] ok [/INST]"), ("assistant", "<|turn|>\\<|end|>\n"), ("us\ner", ""), ("", "[[INST]")]
    text, at, rewritten = chat.spans(turns, chat.template)
    assert chat.read_back(text) == turns and not rewritten
    assert [chat.unescape(text[a:b]) for _, a, b, _ in at] == [t for _, t in turns]
    assert chat.spans(turns, lambda t: f"{len(t)}:" + chat.template(t))[2]
    rows = spark.createDataFrame([(1, 1, "assistant", None), (1, 0, "user", "hi"), (None, 0, None, "x")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.formatted(rows)).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[1].turns_sha256) == (2, 0, chat.hexdigest("user\nhi\nassistant\n\n")) and got[None].n_turns == 1


@pytest.mark.parametrize("small", [100_000, 0])
def test_decontamination(spark, small):
    w = [f"w{i}" for i in range(40)]
    texts = [(1, "x " + " ".join(w[3:15]) + " y"), (2, " ".join(w[3:12])), (3, None), (4, "Solo word"), (5, ""), (1, "x " + " ".join(w[3:15]) + " y"), (99, "SOLO")]
    bench = spark.createDataFrame([(7, " ".join(w)), (10, "solo"), (11, None), (None, "word"), (12, "...")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.items) for r in decontam.decontaminate(docs(spark, texts), bench, small=small).collect())
    assert got == [("1", 14, 12, ["7"]), ("1", 14, 12, ["7"]), ("2", 9, 0, []), ("3", 0, 0, []), ("4", 2, 1, ["10"]), ("5", 0, 0, []), ("None", 1, 1, ["10"])]
    near = decontam.proximity(docs(spark, texts), spark.createDataFrame([(1, "w5 w9 w3"), (2, "w3 solo")], "query_id long, text string"), 8).collect()
    assert {(r.query_id, r.doc_id) for r in near} == {(1, 1), (1, 2)}
    assert decontam.decontaminate(docs(spark, texts), bench.limit(0)).filter("n_hit > 0").count() == 0


def test_line_dedup(spark):
    passage = "\n".join(f"line {i} of a passage that many documents share here" for i in range(6))
    texts = [(1, "first words\n" + passage), (2, "other words\n\n" + passage + "\nlast own line"), (3, None), (4, ""), (5, "short\nAs."), (6, "As.\nlong"), (7, passage), (7, passage), (99, "tail\n" + passage)]
    out = lines.dedup_lines(docs(spark, texts).withColumn("cut", F.lit(1)).withColumn("__uid", F.lit(2)).withColumn("own", F.lit(3)))
    got = sorted((str(r.doc_id), r.text) for r in out.collect())
    assert got == [("1", texts[0][1]), ("2", "other words\n\nlast own line"), ("3", None), ("4", ""), ("5", "short\nAs."), ("6", "As.\nlong"), ("None", "tail")]
    assert lines.patience([1, 2, 3, 4, 5], [9, 2, 3, 8, 5, 1]) == [(1, 1), (2, 2), (4, 4)]
    assert lines.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_takes_every_shared_block(spark):
    mark = [f"line {i} has eight words of its own" for i in range(40)]
    join = lambda *parts: "\n".join(x for part in parts for x in part)
    # each couplet of the eight lines stood somewhere before, the eight together only in 10
    texts = [(i, join([f"own {i}"], mark[i - 1 : i + 1])) for i in range(1, 8)] + [(10, join(["ten"], mark[:8])), (11, join(["eleven"], mark[:8], ["end"]))]
    # passages in another order, and one twice; blocks that overlap in the later document only
    texts += [(20, join(mark[10:18], ["twenty"], mark[20:28])), (21, join(mark[20:28], ["moved"], mark[10:18])), (22, join(mark[10:18], ["again"], mark[10:18]))]
    texts += [(30, join(mark[30:33], ["thirty"], mark[32:35])), (31, join(mark[30:35], ["over"]))]
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs(spark, texts)).collect()}
    assert [got[i] for i in (11, 21, 22, 31)] == ["eleven\nend", "moved", "again", "over"]
    assert all(got[i] == t for i, t in texts if i not in (11, 21, 22, 31))


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(6)
    pool = [" ".join(f"w{i}" for _ in range(rng.choice([1, 5, 8, 12]))) + f" {i}" for i in range(12)]
    texts = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    want, before = {}, []
    for i, t in texts:
        held = t.split("\n")
        gone = {k for a in range(len(held)) for b in range(a + 1, len(held) + 1) if len(" ".join(held[a:b]).split()) >= 20 and any(held[a:b] == old[c : c + b - a] for old in before for c in range(len(old))) for k in range(a, b)}
        if len(gone) < len(held):
            want[i] = "\n".join(x for k, x in enumerate(held) if k not in gone)
        before.append(held)
    assert {r.doc_id: r.text for r in lines.dedup_lines(docs(spark, texts)).collect()} == want


def test_main_text():
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li>Menu</li></ul></nav><div class="ad box">Buy</div><header>Top</header>
    <article><h1>Head &amp; line</h1><p><b>One<br>two<p>Three&nbsp;  four</p><div id="comments">Reader</div><form>Name</form></article><aside>Side</aside><footer>&copy;</footer></body></html>"""
    assert html.main_text(page) == "Head & line One two Three four"
    assert html.main_text(None) == html.main_text("") == "" and html.main_text("<p>a<p") == "a"
    assert html.main_text("<article><p>x</p><!-- cut") == "x"
    body = "".join(f"<p>{'long words of a story ' * 12}{i}</p>" for i in range(8))
    links = "".join("<li><a href='#'>x</a></li>" for _ in range(25))
    got = html.main_text(f"<body><ul>{links}</ul>{body}<ul>{links}</ul></body>")
    assert got.startswith("long words") and "x x" not in got and got.endswith("7")


def test_main_text_skipped_elements_end_with_their_parents():
    for cut in ("<p class='notice'>We use cookies", "<ul><li class='share'>Share<li>Kept</ul>", "<header><nav>Menu</header>", "<section><div class='ad'><span>Buy</section>", "<table><tr><td class='ad'>Buy<tr><td>Kept</table>", "<p><span class='ad'><b>Buy</span>"):
        got = html.main_text(f"<article><p>Before</p>{cut}<p>Real one<p>Real two</article>")
        assert got.replace(" Kept", "") == "Before Real one Real two"
    assert html.main_text("<html><head><title>T</title><p>Hello") == "Hello"
    assert html.main_text("<article><nav><ul><li>a<li>b</ul><p>c</nav><p>x</b>y</article>") == "xy"


def test_main_text_article_mark_is_a_prior():
    story = [f"{'long words of a story ' * 12}{i}" for i in range(8)]
    body = "".join(f"<p>{t}</p>" for t in story)
    links = "<ul>" + "".join("<li><a href='#'>x</a></li>" for _ in range(25)) + "</ul>"
    card = "<article><h3>Other story</h3><a href='#'>more</a></article>"
    got = html.main_text(f"<body>{links}<div>{body}</div>{links}{card}</body>")
    assert all(t in got for t in story) and "x" not in got.split()
    got = html.main_text(f"<body><article><h1>Head</h1>{body}<p>End</p></article>{links}<article class='comment'><p>Reader says so</p></article></body>")
    assert got == " ".join(["Head", *story, "End"])
    got = html.main_text(f"<body><article class='post category-social'><h1>Head</h1>{body}</article>{links}<div>{body}</div></body>")
    assert got == " ".join(["Head", *story, *story])


def test_quality_keeps_good_and_drops_poor(spark):
    rng = random.Random(0)
    good = [" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(60)) + f" {i}." for i in range(150)]
    poor = ["NOISE!! LOUD!! " * 30 + str(i) for i in range(15)] + ["same " * 80 + str(i) for i in range(15)]
    rows = list(enumerate(good + poor, 1000)) + [(900, None), (901, "")]
    got = {r.doc_id: r["__keep"] for r in quality.classify(docs(spark, rows)).collect()}
    assert all(got[i] for i in range(1000, 1150)) and not any(got[i] for i in range(1150, 1180)) and got[900] and got[901]
    assert quality.classify(docs(spark, [])).count() == 0


def test_toxicity(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = [(i, " ".join([word() for _ in range(40)] + ["you zzfool"] * (i % 4 == 0))) for i in range(200)] + [(300, None)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)] + [(None, 1, 1), (161, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, rows), labels).collect()}
    assert all((got[i] >= 0.3) == (i % 4 == 0) for i in range(160, 200)) and 0 <= got[300] < 0.3
    assert {r.score for r in toxicity.score(docs(spark, rows), labels.limit(0)).collect()} == {0.0}


def test_isotonic_rises():
    at, level = toxicity.isotonic(np.asarray([0.0, 1, 2, 3, 4]), np.asarray([0.0, 1, 0, 1, 1]), np.ones(5))
    assert (np.diff(level) >= 0).all() and level[0] == 0 and level[-1] == 1


def test_secrets_and_ledger(spark):
    key = "AKIA" + "A1B2" * 4
    text = f"é password = 'abcdef' {key} {'ab12' * 6} token: abc"
    rows = docs(spark, [(1, text), (2, text), (3, None), (1, "Secret:123456")])
    out, ledger = secrets.scan(rows.withColumn("blob", F.lit("clash")))
    got = sorted((r.doc_id, [(f.kind, f.start, f.end) for f in r.found]) for r in out.collect())
    spans = [("assign", 2, 20), ("access", 22, 42), ("hex", 43, 67)]
    assert got == [(1, [("assign", 0, 13)]), (1, spans), (2, spans), (3, [])]
    assert ledger.count() == 3
    again, new = secrets.scan(rows.unionByName(docs(spark, [(9, "hex " + "0f" * 12)])), ledger)
    assert new.count() == 1 and sorted(len(r.found) for r in again.collect()) == [0, 1, 1, 3, 3]


@pytest.mark.parametrize("members, shingles", [(512, 1 << 19), (7, 1 << 19), (512, 900)])
def test_links_of_a_bucket_in_blocks(spark, members, shingles):
    """Many sets of one bucket, most just short of the threshold: the components are those of all pairs."""
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**62), 2**62, 100)
    sets = [np.unique(np.concatenate([base[rng.random(100) > 0.06], rng.integers(-(2**62), 2**62, 5)])) for _ in range(60)]
    rows = spark.createDataFrame([(9, i, len(x), i // 2 * 2, x.tolist()) for i, x in enumerate(sets)], "bucket long, node long, n long, component long, shingles array<long>")
    links = [(r.u, r.v) for r in dedup.block_links(rows.drop("shingles"), rows.select("node", "shingles"), 85, 100, members, shingles).collect()]
    both = lambda x, y: len(np.intersect1d(x, y))
    true = [(i, j) for i in range(60) for j in range(i) if 100 * both(sets[i], sets[j]) >= 85 * (len(sets[i]) + len(sets[j]) - both(sets[i], sets[j]))]

    def joined(pairs):
        up = {i: i for i in range(60)}
        for a, b in [*pairs, *((i, i // 2 * 2) for i in range(60))]:
            x, y = up[a], up[b]
            up = {k: min(x, y) if v in (x, y) else v for k, v in up.items()}
        return up

    assert 0 < len(true) < 1700 and joined(links) == joined(true)


def test_main_text_names_and_teasers():
    """Names that only hold a mark's word kill no page and no part of the article; articles in closed sidebars are teasers."""
    p = lambda x: f"<p>{x} {'word and more of it ' * 12}</p>"
    got = html.main_text(f'<body class="sidebar-layout comments-closed"><div class="content with-sidebar no-comments"><article>{p("A")}{p("B")}</article></div></body>')
    assert got.startswith("A word") and " B word" in got
    assert "Teaser" not in html.main_text(f'<body><article>{p("A")}</article><aside><article>{p("Teaser")}</article></aside></body>')
    assert "Critics" in html.main_text(f'<body><article>{p("A")}<div class="reply-to-critics">{p("Critics")}</div></article></body>')
    assert html.main_text(f"<body><nav><p>Nav</p><article>{p('A')}</article></body>").startswith("A word")
    for name in ("site-nav", "comment-list", "ad", "cookie_notice", "related-posts", "js-ad-top", "sidebar"):
        assert "Gone" not in html.main_text(f'<body><article>{p("A")}<div class="{name}">{p("Gone")}</div></article></body>'), name
