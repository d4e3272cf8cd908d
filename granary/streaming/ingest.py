"""Files that arrive in a folder, taken into a repository by micro-batches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from granary.plans.repository import Repository
from granary.sources.files import with_paths

_FILES = "path string, modificationTime timestamp, length long, content binary"


def arrivals(repository: Repository, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of (domain, relative_path, content, size) of new files under a folder."""
    reader = repository.spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return with_paths(reader.load(folder), folder, repository.domain)


def ingest(repository: Repository, folder: str, checkpoint: str, files_per_batch: int | None = None, clock=None, remote_id: str | None = None) -> StreamingQuery:  # noqa: ANN001
    """Takes in all files that are new since the checkpoint, a version for each batch that
    changes something, then ends. The query is the repository's only writer while it runs; a
    batch that is delivered again finds its content live and makes no version. `clock` gives the
    time of a batch. With a remote_id, files are pulled through and nothing is derived."""
    clock = clock or (lambda batch: dt.datetime(1970, 1, 1) + dt.timedelta(seconds=batch))

    def take(files: DataFrame, batch: int) -> None:
        files = files.persist()
        try:
            if files.isEmpty():
                return
            rows = files.select("relative_path", "content")
            if remote_id is None:
                repository.deploy(rows, clock(batch))
            else:
                repository.pull(rows, remote_id, clock(batch))
        finally:
            files.unpersist()

    writer = arrivals(repository, folder, files_per_batch).writeStream.foreachBatch(take)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

