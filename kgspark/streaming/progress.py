"""Progress of document processing: milestones of batch stages and of streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

Report = Callable[[int, str], None]


def run_stages(stages: list[tuple[str, int, Callable[[], object]]], report: Report) -> list[object]:
    """Run named stages with weights; ``report`` hears 0, the share done before each stage, and 100.

    A stage that fails is reported as 0 and its error is raised.
    """
    total, done, out = sum(w for _, w, _ in stages) or 1, 0, []
    report(0, "started")
    for name, weight, stage in stages:
        report(100 * done // total, name)
        try:
            out.append(stage())
        except Exception as failed:
            report(0, f"failed: {failed}")
            raise
        done += weight
    report(100, "completed")
    return out


class StreamProgress(StreamingQueryListener):
    """Tells ``report`` the rows that a named stream has read so far, its end and its error."""

    def __init__(self, report: Callable[[str, str, int], None]) -> None:
        self.report, self.rows, self.names = report, {}, {}

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.names[event.id] = event.name or str(event.id)
        self.report(self.names[event.id], "started", 0)

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        self.rows[p.id] = self.rows.get(p.id, 0) + p.numInputRows
        self.report(self.names.get(p.id, str(p.id)), "progress", self.rows[p.id])

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        """Nothing was read; nothing to tell."""

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.report(self.names.get(event.id, str(event.id)), "failed" if event.exception else "completed", self.rows.get(event.id, 0))


def watch(spark: SparkSession, report: Callable[[str, str, int], None]) -> StreamProgress:
    """Attach a listener to the session; ``spark.streams.removeListener`` ends it."""
    listener = StreamProgress(report)
    spark.streams.addListener(listener)
    return listener
