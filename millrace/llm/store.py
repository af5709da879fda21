"""Files that tasks write themselves, through Arrow's file systems, into a folder that all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def located(path: str):
    """Arrow's file system and the path in it; Spark spells local files with one slash."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def attempt_name() -> str:
    """A name that no other attempt of a task has."""
    from pyspark import TaskContext

    return f"{TaskContext.get().taskAttemptId()}.{uuid.uuid4().hex[:8]}"


def publish(store, attempt: str, last: str) -> None:
    """Gives a finished file its last name. Where an earlier attempt has done so, its file, which has the same rows, stays."""
    from pyarrow import fs

    try:
        store.move(attempt, last)
    except OSError:  # some stores refuse to move onto an existing name
        if store.get_file_info(last).type != fs.FileType.File:
            raise
        store.delete_file(attempt)


def remove(store, path: str) -> None:
    """Removes a file; one that an earlier attempt has removed is no error."""
    from pyarrow import fs

    if store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_file(path)


def saved(df: DataFrame, path: str) -> DataFrame:
    """df, written as Parquet and read again: run once, durable, and of a size that the planner knows."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
