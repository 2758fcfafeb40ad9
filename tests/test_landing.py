"""Pages that land are gathered to documents, whatever their order, over restarts, and by timer."""

import time

import pytest

from tessera.operators import zones as Z
from tessera.streaming import landing


@pytest.fixture
def stateful(spark):
    settings = landing._STATE | landing._DATA_ONLY
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_documents_come_once_over_restarts(stateful, tmp_path):
    schema = landing.PAGES + ", score double"
    runs = [
        [(1, 2, 3, "c", 0.5), (2, 0, 1, "", 0.5), (1, 0, 3, "a", None), (1, 0, 3, "a again", 0.5), (None, 0, 1, "x", 0.5), (3, None, 1, "x", 0.5), (3, 0, 1, None, 0.5), (4, 0, 2, "only one", 0.5)],
        [(1, 1, 3, "b " * 50_000, 0.5), (2, 0, 1, "late", 0.5), (5, 1, 2, "y", 0.5), (5, 0, 2, "x", 0.5)],
        [(1, 1, 3, "late", 0.5), (6, 0, 1, "z", 0.5)],
    ]
    got = []
    for rows in runs:
        stateful.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        pages = stateful.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = landing.gathered(pages).writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect())))
        out.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == [(1, "a\n" + "b " * 50_000 + "\nc", 3, True), (2, "", 1, True), (5, "x\ny", 2, True), (6, "z", 1, True)]


def test_zones_of_pages_equal_those_of_the_table(spark, tmp_path):
    """An incomplete document comes when its wait is over; the session's settings stay as they were."""
    texts = {k: "\n".join(f"line {i} of wind power" if (i + k) % 7 == 0 else "plain words " * 20 for i in range(30)) for k in range(5)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = [(k, p, 3 if k else 4, "\n".join(t.split("\n")[10 * p : 10 * p + 10])) for k, t in texts.items() for p in range(3)]
    spark.createDataFrame(rows[::-1], landing.PAGES).repartition(3, "page_no").write.parquet(str(tmp_path / "in"))
    pages = spark.readStream.schema(landing.PAGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    settings = {k: spark.conf.get(k, None) for k in landing._STATE | landing._DATA_ONLY}
    q = landing.zones_to_table(pages, r"(?i)\b(?:wind power)\b", str(tmp_path / "out"), str(tmp_path / "check"), 1000, processingTime="1 second")
    assert settings == {k: spark.conf.get(k, None) for k in landing._STATE | landing._DATA_ONLY}
    want = Z.zones(Z.paragraphs(Z.line_units(docs)), r"(?i)\b(?:wind power)\b")
    columns = [c for c in want.columns if c != "batch"]
    expected, got, end = sorted(map(tuple, want.collect())), [], time.time() + 100
    while len(got) < len(expected) and time.time() < end and q.isActive:
        time.sleep(2)
        if any((tmp_path / "out").glob("batch=*/_SUCCESS")):
            got = sorted(map(tuple, spark.read.schema(want.schema).parquet(str(tmp_path / "out")).select(columns).collect()))
    q.stop()
    assert got == expected != []


def test_complete_documents_are_not_held():
    """Pages that come together go on without being written to the state."""
    from unittest.mock import MagicMock

    import pandas as pd

    from tessera.streaming.landing import _Gather

    g = _Gather(1, 1)
    g.init(MagicMock())
    g.pages, g.held, g.done = MagicMock(), MagicMock(), MagicMock()
    g.done.exists.return_value, g.held.get.return_value = False, None
    rows = pd.DataFrame({"page_no": [1, 0, 1], "n_pages": [2, 2, 2], "text": ["b", "a", "x"]})
    (out,) = g.handleInputRows((7,), iter([rows]), MagicMock())
    assert out.to_dict("records") == [{"doc_id": 7, "text": "a\nb", "n_pages": 2, "complete": True}]
    assert not g.pages.method_calls and not g.held.update.called and g.done.update.called
