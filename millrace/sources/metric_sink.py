"""A sink that writes a table to several targets or to none of them, for tables and for streams."""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage


@dataclass
class Staged(WriterCommitMessage):
    """The file that a task has written to each target."""

    name: str
    rows: int
    stage: str


class MetricSink(DataSource):
    """``write.format("metric_sink")`` with option ``targets``, a JSON list of folders (any that pyarrow can write).

    A target whose name ends in ``.jsonl`` gets lines of JSON, others Parquet. Tasks write to a hidden folder in each target.
    When all have ended, each target's folder is renamed to what readers see, ``job=<id>``; if one can't be, those that were are
    taken back and the write fails. If a task fails for good, readers see nothing of the job; a task that outlives it by seconds may
    leave its hidden file. Option ``job`` names the job; one of that name is
    replaced. A stream's micro-batches are jobs by number, so one that is run again counts once.
    """

    @classmethod
    def name(cls) -> str:
        return "metric_sink"

    def writer(self, schema, overwrite):
        return _Writer(self.options)

    def streamWriter(self, schema, overwrite):  # noqa: N802
        return _StreamWriter(self.options)


class _Targets:
    def __init__(self, options):
        self.targets = [t.rstrip("/") for t in json.loads(options["targets"])]
        self.job, self.stage = options.get("job", uuid.uuid4().hex), f"_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        """One file a target; rows pass through as a stream."""
        name, rows, open_ = uuid.uuid4().hex, 0, []
        try:
            for batch in iterator:
                rows += batch.num_rows
                for k, target in enumerate(self.targets):
                    if len(open_) <= k:
                        system, root = fs.FileSystem.from_uri(target)
                        system.create_dir(f"{root}/{self.stage}", recursive=True)
                        out = system.open_output_stream(f"{root}/{self.stage}/{name}.{'json' if target.endswith('.jsonl') else 'parquet'}")
                        open_.append((out, None if target.endswith(".jsonl") else pq.ParquetWriter(out, batch.schema)))
                    out, parquet = open_[k]
                    if parquet:
                        parquet.write_batch(batch)
                    else:
                        out.write("".join(json.dumps(r, default=str) + "\n" for r in batch.to_pylist()).encode())
        finally:
            for out, parquet in open_:
                if parquet:
                    parquet.close()
                out.close()
        return Staged(name, rows, self.stage)

    def publish(self, messages: list, job: str) -> None:
        kept = {m.name for m in messages if m is not None and m.rows}
        self.stage = next((m.stage for m in messages if m is not None), self.stage)  # a stream commits by another instance
        done = []
        try:
            for target in self.targets:
                system, root = fs.FileSystem.from_uri(target)
                system.create_dir(f"{root}/{self.stage}", recursive=True)
                for info in system.get_file_info(fs.FileSelector(f"{root}/{self.stage}")):
                    if info.base_name.partition(".")[0] not in kept:  # of an attempt that didn't count
                        system.delete_file(info.path)
                final, former = f"{root}/job={job}", f"{root}/_former-{job}"
                if system.get_file_info(final).type == fs.FileType.Directory:
                    system.move(final, former)
                done.append((system, final, former))
                system.move(f"{root}/{self.stage}", final)
        except Exception:
            for system, final, former in done:
                self._delete(system, final)
                if system.get_file_info(former).type == fs.FileType.Directory:
                    system.move(former, final)
            self.withdraw()
            raise
        for system, _, former in done:
            self._delete(system, former)

    def withdraw(self) -> None:
        """Drop what was staged. Other tasks of a failed job may still be ending, so this is tried again for a while."""
        for pause in (0.0, 0.3, 1.0):
            time.sleep(pause)
            for target in self.targets:
                system, root = fs.FileSystem.from_uri(target)
                with contextlib.suppress(OSError):
                    self._delete(system, f"{root}/{self.stage}")

    @staticmethod
    def _delete(system: fs.FileSystem, path: str) -> None:
        if system.get_file_info(path).type == fs.FileType.Directory:
            system.delete_dir(path)


class _Writer(_Targets, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        self.publish(messages, self.job)

    def abort(self, messages: list) -> None:
        self.withdraw()


class _StreamWriter(_Targets, DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.publish(messages, f"{batchId}")

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.stage = next((m.stage for m in messages if m is not None), self.stage)
        self.withdraw()


def write_metrics(df: DataFrame, targets: list[str], job: str | None = None) -> None:
    """``df`` to all targets or to none; see ``MetricSink``."""
    df.sparkSession.dataSource.register(MetricSink)
    options = {"targets": json.dumps(targets), **({"job": job} if job else {})}
    df.write.format("metric_sink").mode("append").options(**options).save()


def read_metrics(df_like: DataFrame, target: str) -> DataFrame:
    """What a target holds, with the columns of ``df_like`` and ``job``."""
    reader = df_like.sparkSession.read.schema(df_like.schema.add("job", "string"))
    return reader.json(target) if target.rstrip("/").endswith(".jsonl") else reader.parquet(target)
