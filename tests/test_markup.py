"""Pages of acts in two renditions, with trees written by hand; the same provisions in either give the same nodes."""

import pytest

from canonist.sources import markup

NOTE = '<a href="#n1"><span class="oj-super oj-note-tag">(1)</span></a>'
OUTSIDE = '(<a href="#n2"><span class="superscript">2</span></a>)'
OJ = f"""<html><body><div class="eli-container">
<div id="rct_3"><table><tr><td><p>(3)</p></td><td><p>Ports {NOTE} grow.</p></td></tr></table></div>
<div id="cpt_II"><p class="oj-ti-section-1">CHAPTER II</p><div class="eli-title"><p>HARBOUR DUES</p></div>
 <div id="cpt_II.sct_1"><p>SECTION 1</p><div class="eli-title"><p>Rates</p></div>
  <div id="art_4a"><p class="oj-ti-art">Article 4a</p><div class="eli-title"><p>Boats</p></div>
   <div id="004.001"><p>1.   Each boat{NOTE}, old or new, pays:</p>
    <table><tr><td><p>(a)</p></td><td><p>a fee;</p></td></tr><tr><td><p>(ba)</p></td><td><p>a due, namely:</p>
     <table><tr><td><p>(i)</p></td><td><p>by length</p></td></tr></table><p>and no more.</p></td></tr></table>
    <p>It pays at once.</p>
    <table><tr><td><p>—</p></td><td><p>in coin</p></td></tr><tr><td><p>—</p></td><td><p>by note</p></td></tr></table></div>
   <div id="004.002"><p>2.   Rafts are free.</p></div></div></div></div>
<div id="anx_IV"><p class="oj-doc-ti">ANNEX IV</p><p class="oj-doc-ti">List of piers</p>
 <p>Opening words.</p>
 <p class="oj-ti-grseq-1">Section A</p><p class="oj-ti-grseq-1">Northern piers</p>
 <table><tr><td></td><td><p>1.</p></td><td><p>Old pier</p></td></tr><tr><td></td><td><p>2.</p></td><td><p>New pier</p><table><tr><td><p>2.1.</p></td><td><p>its steps</p></td></tr></table></td></tr></table>
 <p class="oj-ti-grseq-1">Section B. Others</p><p>Words of B</p>
 <p class="oj-ti-grseq-1">7. Rowing</p><p>Oars</p><table><tr><th>Pier</th><th>Depth</th></tr><tr><td>Old</td><td>3 m</td></tr></table></div>
</div></body></html>"""
NEW = f"""<html><body>
<div id="rct_3"><p>(3)</p><p>Ports grow.</p></div>
<div id="cpt_II"><p>CHAPTER II</p><div class="eli-title"><p>HARBOUR DUES</p></div>
 <div id="cpt_II.sct_1"><p>SECTION 1</p><div class="eli-title"><p>Rates</p></div>
  <div id="art_4a"><p class="title-article-norm">Article 4a</p><div class="eli-title"><p class="stitle-article-norm">x</p>Boats</div><p class="modref">M1</p>
   <div class="norm"><span class="no-parag">1.  </span><div class="norm inline-element">Each boat {OUTSIDE}, old or new, pays:</div></div>
   <div class="grid-container"><div class="grid-list-column-1"><span>(a)</span></div><div class="grid-list-column-2"><p class="norm">a fee</p><p>;</p></div></div>
   <div class="grid-container"><div class="grid-list-column-1">(ba)</div><div class="grid-list-column-2"><p>a due, namely:</p>
     <div class="grid-container"><div class="grid-list-column-1">(i)</div><div class="grid-list-column-2"><p>by length</div></div><p>and no more.</div></div>
   <p class="norm">It pays at once.</p>
   <div class="grid-container"><div class="grid-list-column-1">—</div><div class="grid-list-column-2"><p>in coin</p></div></div>
   <div class="grid-container"><div class="grid-list-column-1">—</div><div class="grid-list-column-2"><p>by note</p></div></div>
   <div class="norm"><span class="no-parag">2.</span><p>Rafts are free.</p></div></div></div></div>
<div id="anx_IV"><p class="title-annex-1">ANNEX IV</p><p class="norm">List of piers</p><p>Opening words.</p>
 <p class="title-gr-seq-level-1">Section A</p><p class="title-gr-seq-level-1">Northern piers</p>
 <div class="grid-container"><div class="grid-list-column-1">1.</div><div class="grid-list-column-2"><p>Old pier</p></div></div>
 <div class="grid-container"><div class="grid-list-column-1">2.</div><div class="grid-list-column-2"><p>New pier</p><div class="grid-container"><div class="grid-list-column-1">2.1.</div><div class="grid-list-column-2">its steps</div></div></div></div>
 <p class="title-gr-seq-level-1">Section B. Others</p><p>Words of B</p>
 <p class="title-gr-seq-level-1">7. Rowing</p><p>Oars</p><table><tr><th>Pier<th>Depth<tr><td>Old<td>3 m</table></div></body></html>"""
WANT = [
    ("rec_3", "recital", None, "", "Ports grow."),
    ("cpt_2", "chapter", None, "HARBOUR DUES", ""),
    ("cpt_2.sct_1", "section", "cpt_2", "Rates", ""),
    ("art_4a", "article", "cpt_2.sct_1", "Boats", ""),
    ("art_4a.par_1", "paragraph", "art_4a", "", "Each boat, old or new, pays:"),
    ("art_4a.par_1.a", "point", "art_4a.par_1", "", "a fee;"),
    ("art_4a.par_1.ba", "point", "art_4a.par_1", "", "a due, namely:"),
    ("art_4a.par_1.ba.i", "point", "art_4a.par_1.ba", "", "by length"),
    ("art_4a.par_1.ba.sub_2", "subparagraph", "art_4a.par_1.ba", "", "and no more."),
    ("art_4a.par_1.sub_2", "subparagraph", "art_4a.par_1", "", "It pays at once."),
    ("art_4a.par_1.sub_2.pt_1", "point", "art_4a.par_1.sub_2", "", "in coin"),
    ("art_4a.par_1.sub_2.pt_2", "point", "art_4a.par_1.sub_2", "", "by note"),
    ("art_4a.par_2", "paragraph", "art_4a", "", "Rafts are free."),
    ("anx_4", "annex", None, "List of piers", "Opening words."),
    ("anx_4.sec_a", "annex_section", "anx_4", "Section A Northern piers", ""),
    ("anx_4.sec_a.pt_1", "annex_point", "anx_4.sec_a", "", "Old pier"),
    ("anx_4.sec_a.pt_2", "annex_point", "anx_4.sec_a", "", "New pier"),
    ("anx_4.sec_a.pt_2.pt_1", "annex_point", "anx_4.sec_a.pt_2", "", "its steps"),
    ("anx_4.sec_b", "annex_section", "anx_4", "Section B. Others", "Words of B"),
    ("anx_4.sec_b.pt_7", "annex_point", "anx_4.sec_b", "Rowing", "Oars"),
    ("anx_4.sec_b.pt_7.sub_2", "subparagraph", "anx_4.sec_b.pt_7", "", "Pier | Depth\nOld | 3 m"),
]
ODD = {
    "twice": '<div id="art_1"><div id="001.001"><p>1. a</p></div><div id="001.002"><p>1. b</p></div></div>',
    "heading": '<div id="anx_I"><p class="oj-doc-ti">ANNEX I</p><p class="oj-doc-ti">Title</p><p class="oj-ti-grseq-1">Of no known form</p></div>',
    "nested": '<div id="anx_I"><p class="oj-doc-ti">ANNEX I</p><table><tr><td>5.2.</td><td>astray</td></tr></table></div>',
    "open": '<div id="art_7"><p>one<p>two<table><tr><td>(a)<td>three<tr><td>(b)<td>four</table></i></span><div class="oj-note">gone</div>',
    "words": '<div id="art_8"><p>first</p><p class="oj-ti-grseq-1">a heading of an article</p></div>',
    "empty": "",
    "none": None,
}


@pytest.fixture(scope="module")
def parsed(spark):
    pages = spark.createDataFrame([("oj", OJ), ("new", NEW), *ODD.items()], "page_id string, html string")
    nodes, problems = markup.parse_acts(pages)
    out = {}
    for r in nodes.orderBy("page_id", "ord").collect():
        out.setdefault(r.page_id, []).append(r)
    return out, sorted((r.page_id, r.what, r.error, r.detail) for r in problems.collect())


@pytest.mark.parametrize("page", ["oj", "new"])
def test_both_renditions_give_the_same_tree(parsed, page):
    rows = parsed[0][page]
    assert [(r.id, r.type, r.parent, r.heading, r.text) for r in rows] == WANT
    assert [r.ord for r in rows] == list(range(len(WANT)))
    assert {r.source_anchor for r in rows if r.id == "art_4a.par_2"} == {{"oj": "004.002", "new": "art_4a"}[page]}


def test_equal_hashes_across_renditions(parsed):
    hashes = lambda page: [(r.hash, r.node_hash) for r in parsed[0][page]]
    assert hashes("oj") == hashes("new") and len({h for _, h in hashes("oj")}) > 15


def test_problems_and_broken_pages(parsed):
    nodes, problems = parsed
    assert problems == [("heading", "unknown_heading", True, "Of no known form"), ("nested", "nested_label", False, "5.2 under anx_1"), ("twice", "duplicate_id", True, "art_1.par_1")]
    assert not {"twice", "heading", "empty", "none"} & set(nodes) and [r.id for r in nodes["nested"]] == ["anx_1", "anx_1.pt_2"]
    assert [(r.id, r.text) for r in nodes["open"]] == [("art_7", "one"), ("art_7.sub_2", "two"), ("art_7.sub_2.a", "three"), ("art_7.sub_2.b", "four")]
    assert [(r.id, r.text) for r in nodes["words"]] == [("art_8", "first"), ("art_8.sub_2", "a heading of an article")]
