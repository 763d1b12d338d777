"""Commands from a file, run again whenever it changes, in one session that keeps what it has loaded."""

from __future__ import annotations

import shlex
import time
from collections.abc import Callable

from pyspark.sql import SparkSession


class Server:
    """Each line of the file is a command line; ``#`` begins a remark.

    A pass runs all of them in order if the text is another than in the pass
    before. A command that fails does not stop the ones after it; its error is
    what ``step`` returns for it.
    """

    def __init__(self, spark: SparkSession, path: str, run: Callable[[list[str]], None]):
        self.spark, self.path, self.run, self.seen = spark, path, run, None

    def text(self) -> str:
        return "\n".join(r["value"] for r in self.spark.read.option("wholetext", True).text(self.path).collect())

    def step(self) -> list[Exception | None]:
        """One look at the file: nothing if it is as before, else what became of each command."""
        text = self.text()
        if text == self.seen:
            return []
        self.seen, out = text, []
        for line in text.splitlines():
            if words := shlex.split(line, comments=True):
                try:
                    self.run(words)
                    out.append(None)
                except Exception as e:  # noqa: BLE001 - reported for the command
                    out.append(e)
        return out

    def serve(self, every: float = 1.0, passes: int | None = None, report: Callable[[Exception | None], None] = print) -> None:
        """Looks at the file again and again; ``passes`` bounds the looks."""
        while passes is None or passes > 0:
            for said in self.step():
                report(said)
            passes = None if passes is None else passes - 1
            if passes != 0:
                time.sleep(every)
