"""Progress of streaming queries as plain records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Calls back with (kind, query id, rows in the batch or the error)."""

    def __init__(self, tell: Callable[[str, str, object], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell("started", str(event.id), None)

    def onQueryProgress(self, event) -> None:
        self.tell("progress", str(event.progress.id), event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        self.tell("idle", str(event.id), None)

    def onQueryTerminated(self, event) -> None:
        self.tell("error" if event.exception else "ended", str(event.id), event.exception)
