"""Values read one by one: results in small batches, whatever the number of rows a task has."""

import pyarrow as pa
import pytest

from canonist.sources import io, markup, stream


@pytest.mark.parametrize("parse, per", [(io.parse_pages, 40), (markup.page_blocks, 41)])
def test_no_batch_of_results_grows_with_the_rows_of_a_task(spark, monkeypatch, parse, per):
    """3000 pages of 40 blocks as one batch: batches of results hold no more than the most rows and those of a page."""
    pages = spark.createDataFrame([("1", "")], "page_id string, html string")
    runs, kind = [], type(pages)
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, schema, f=kind.mapInArrow: runs.append(run) or f(self, run, schema))
    parse(pages)
    html = '<div id="art_1">' + "<p>A text." * 40 + "</div>"
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(3000)]), pa.array([html] * 3000)], ["page_id", "html"])
    out = list(runs[0](iter([batch])))
    assert sum(b.num_rows for b in out) == 3000 * per and max(b.num_rows for b in out) <= stream.ROWS + per
    assert [x.as_py() for b in out for x in b.column(0)] == [str(i) for i in range(3000) for _ in range(per)]


def test_batches_end_after_so_many_characters_and_keep_keys(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "c" * 9 + " d"), (4, "")], "k long, v string").coalesce(1)
    told = stream.told_of(rows, "k", "v", lambda v: [(w, len(w), w == "d") for w in v.split()], "w string, n int, last boolean")
    assert sorted(map(tuple, told.collect())) == [(1, "a", 1, False), (1, "b", 1, False), (3, "c" * 9, 9, False), (3, "d", 1, True)]
