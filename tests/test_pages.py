"""Pages are parsed a few at a time, however many a batch holds."""

import pyarrow as pa

from brindle.sources import density, feeds


def test_few_pages_are_held(spark, monkeypatch):
    sizes = []

    class Pages:  # hands one large batch to what the extractors map with
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            html = "<html><body><article><p>" + "Words that tell of it in a text. " * 9 + "</p></article></body></html>"
            batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array([html, None] * 500)], ["page_id", "html"])
            out = list(run(iter([batch])))
            sizes.extend(b.num_rows for b in out)
            return pa.Table.from_batches(out)

        mapInPandas = None

    for extract in (density.density_extract, feeds.html_extract):
        found = extract(Pages())
        assert found.column("page_id").to_pylist() == list(range(1000))
        assert found.column("content").null_count == 500 and set(found.column("word_count").to_pylist()) == {None, 72}
    assert max(sizes) <= 100
