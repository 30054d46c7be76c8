"""Git repositories as a data source, for folders that the tasks can reach.

``spark.read.format("git_log")`` gives raw log records for `gitlog.decoded`;
`contents` looks up files at commits. A log is one process and one partition;
to scale out, export it once and read the text with `gitlog.read_log`.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .gitlog import RECORD

_FORMAT = "%x1e%H%x01%P%x01%an%x01%ae%x01%aI%x01%s%x01%b%x1f"


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        limit = [f"-n{self.options['max']}"] if "max" in self.options else []
        run = subprocess.Popen(["git", "-C", self.options["path"], "log", "--numstat", f"--format={_FORMAT}", *limit, self.options.get("ref", "HEAD")], stdout=subprocess.PIPE, text=True, errors="replace")
        held = ""
        for chunk in iter(lambda: run.stdout.read(1 << 20), ""):
            *whole, held = (held + chunk).split(RECORD)
            yield from ((r,) for r in whole if r)
        if held:
            yield (held,)
        if run.wait():
            raise OSError(f"git log ended with {run.returncode}")


class GitLog(DataSource):
    """Options: path, ref (HEAD) and max."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)


def read_repository(spark: SparkSession, path: str, ref: str = "HEAD", most: int | None = None) -> DataFrame:
    spark.dataSource.register(GitLog)
    reader = spark.read.format("git_log").option("path", path).option("ref", ref)
    return (reader.option("max", most) if most else reader).load()


def contents(requests: DataFrame, repository: str) -> DataFrame:
    """(commit_hash, path) with content, null where there is none; one process per batch of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [f"{c}:{p}" for c, p in zip(batch.column("commit_hash").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            out = subprocess.run(["git", "-C", repository, "cat-file", "--batch"], input="\n".join(names) + "\n" * bool(names), capture_output=True, encoding="utf-8", errors="surrogateescape", check=True).stdout.encode("utf-8", "surrogateescape")
            texts, at = [], 0
            for _ in names:
                end = out.index(b"\n", at)
                head = out[at:end].split()
                if head[-1] == b"missing":
                    texts.append(None)
                    at = end + 1
                else:
                    size = int(head[-1])
                    texts.append(out[end + 1 : end + 1 + size].decode("utf-8", "replace"))
                    at = end + 2 + size
            yield pa.RecordBatch.from_pydict({"commit_hash": batch.column("commit_hash"), "path": batch.column("path"), "content": pa.array(texts, pa.string())})

    return requests.select("commit_hash", "path").mapInArrow(run, "commit_hash string, path string, content string")
