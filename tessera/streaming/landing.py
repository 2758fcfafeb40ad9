"""An extension: documents that land in a folder are cut into paragraphs as they come, without state; pages that land are gathered to documents by keyed state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T
from ..operators import zones as Z

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def landed(spark: SparkSession, folder: str, schema: str = DOCUMENTS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def hot_lines(docs: DataFrame, keywords: str, threshold: float = 1.0) -> DataFrame:
    """(doc_id, line_no, text, density) of the dense lines of a stream or a table."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).withColumn("text", T.clean_block(F.col("raw"))).where("text <> ''")
    out = lines.withColumn("density", T.density(T.count(F.col("text"), keywords), F.size(T.words(F.col("text")))))
    return out.where(F.col("density") >= threshold).drop("raw")


def to_table(docs: DataFrame, keywords: str, path: str, checkpoint: str):  # noqa: ANN201
    """Starts writing hot lines as Parquet, each landed file once, and stops when all there is has been read."""
    return hot_lines(docs, keywords).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: A page as it lands, with the number of pages of its document.
PAGES = "doc_id long, page_no int, n_pages int, text string"
_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: With timers, batches without data would never end in a stream that stops when all has been read.
_DATA_ONLY = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


class _Gather(StatefulProcessor):
    """Pages of a document until all are there, or until none has come for `wait` ms."""

    def __init__(self, wait: int, remember: int):
        self.wait, self.remember = wait, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getListState("pages", "page_no int, text string")
        self.held = handle.getValueState("held", "expected int")
        self.done = handle.getValueState("done", "at long", self.remember)

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        """A call to the state costs more than a page: what is held is read and written as a whole, and a document that is complete at once isn't held."""
        if self.done.exists():
            for _ in rows:
                pass
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        before = self.held.get()
        expected, pages = before[0] if before is not None else 0, dict(self.pages.get()) if before is not None else {}
        new: list[tuple[int, str]] = []
        for batch in rows:
            for page, total, text in zip(batch["page_no"].tolist(), batch["n_pages"].tolist(), batch["text"], strict=True):
                expected = max(expected, total)
                if page not in pages:
                    pages[page] = text
                    new.append((page, text))
        if before is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if len(pages) >= expected:
            yield self._emitted(key, now, pages, True, before is not None)
        else:
            if new:
                self.pages.appendList(new)
            self.held.update((expected,))
            self.handle.registerTimer(now + self.wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
        if self.held.exists():
            yield self._emitted(key, timerValues.getCurrentProcessingTimeInMs(), dict(self.pages.get()), False, True)

    def _emitted(self, key: tuple, now: int, pages: dict[int, str], complete: bool, stored: bool) -> pd.DataFrame:
        if stored:
            self.pages.clear()
            self.held.clear()
        self.done.update((now,))
        return pd.DataFrame({"doc_id": [key[0]], "text": ["\n".join(t for _, t in sorted(pages.items()))], "n_pages": [len(pages)], "complete": [complete]})

    def close(self) -> None:
        pass


def gathered(pages: DataFrame, wait: int = 3_600_000, remember: int = 7 * 86_400_000) -> DataFrame:
    """(doc_id, text, n_pages, complete) of each document of a stream of PAGES, once: its pages in order, joined by a line's end.

    A document comes when it has n_pages pages (the greatest value counts), in whatever order and batches
    they land; a page number that lands again has no effect, the first one counts. If no page has come for
    `wait` ms, what there is comes with complete false. Pages of a document that came already are left out
    for `remember` ms, after which they begin a new one. Rows with a null in any of the four columns are left
    out; other columns too. State is keyed by document and a page is written to it once, so a batch costs what lands in it.
    """
    held = pages.select("doc_id", "page_no", "n_pages", "text").dropna()
    return held.groupBy("doc_id").transformWithStateInPandas(_Gather(wait, remember), "doc_id long, text string, n_pages long, complete boolean", "append", "processingTime")


def zones_to_table(pages: DataFrame, keywords: str, path: str, checkpoint: str, wait: int = 3_600_000, **trigger):  # noqa: ANN201
    """Starts writing the zones of documents whose pages land, as Parquet folders batch=n under path; a batch that is repeated after a failure replaces its own folder.

    trigger: that of the stream. By default it stops when all there is has been read; documents whose wait
    is over then come in a later run that has data, with other triggers in time. The stream keeps its state
    in RocksDB; the session's own settings are put back once the stream has started.
    """

    def write(docs: DataFrame, batch: int) -> None:
        Z.zones(Z.paragraphs(Z.line_units(docs)), keywords).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    conf, settings = pages.sparkSession.conf, _STATE if trigger else _STATE | _DATA_ONLY
    before = {k: conf.get(k, None) for k in settings}
    for k, v in settings.items():
        conf.set(k, v)
    try:
        return gathered(pages, wait).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
