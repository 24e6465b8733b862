"""A streaming source over a table of a series store whose offsets are the numbers of its commits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidemark.sources.commits import ArrowFiles, CommitLog

#: Rows handed on at once.
BATCH = 16_384
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


@dataclass
class _File(InputPartition):
    """A file of items; ``number`` is that of its commit, None for one whose items have their own."""

    file: str
    number: int | None
    after: int
    upto: int
    erased: dict[str, int]


@dataclass
class _Erased(InputPartition):
    columns: list[tuple[str, int]]


class SeriesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_series"

    def schema(self) -> str:
        return f"column_path string, key long, value {self.options['kind']}, value_type string, ingest_seq long"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802  named by Spark
        return _Reader(dict(self.options))


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.table, self.type, self.kind = options["table"], options["type"], options["kind"]
        self.since, self.erasures = int(options["since"]), options["erasures"] == "true"

    def _log(self) -> CommitLog:
        return CommitLog(ArrowFiles(self.table))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"number": self.since}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"number": max(self.since, self._log().state().number)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        """The files of the folders that hold items of these commits, wherever compaction has put them."""
        log, after, upto = self._log(), start["number"], end["number"]
        state = log.state()
        parts: list[InputPartition] = []
        for folder, number in state.writes.items():
            packed = folder in state.compacted
            if number > after and (packed or number <= upto):
                names = [n for n in log.files.names(f"data/{folder}/items") if n.endswith(".parquet")]
                parts += [_File(f"data/{folder}/items/{n}", None if packed else number, after, upto, state.erased) for n in names]
        if self.erasures:
            gone = [(e["path"], e["number"]) for e in log.entries(after, upto) if e["kind"] == "erase"]
            parts += [_Erased(gone)] if gone else []
        return parts

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), _ARROW[self.kind], pa.string(), pa.int64()]
        names = ["column_path", "key", "value", "value_type", "ingest_seq"]
        schema = pa.schema(list(zip(names, types, strict=True)))
        if isinstance(partition, _Erased):
            paths, numbers = zip(*partition.columns, strict=True)
            none = [pa.nulls(len(paths), t) for t in types[1:3]]
            yield pa.RecordBatch.from_arrays([pa.array(paths), *none, pa.array([self.type] * len(paths)), pa.array(numbers)], schema=schema)
            return
        files = ArrowFiles(self.table)
        marks = pa.array(list(partition.erased), pa.string())
        until = pa.array(list(partition.erased.values()), pa.int64())
        with files.fs.open_input_file(f"{files.root}/{partition.file}") as file:
            for batch in pq.ParquetFile(file).iter_batches(BATCH, columns=names):
                number = batch.column("ingest_seq") if partition.number is None else pa.array([partition.number] * batch.num_rows, pa.int64())
                keep = pc.and_(pc.equal(batch.column("value_type"), self.type), pc.and_(pc.greater(number, partition.after), pc.less_equal(number, partition.upto)))
                if len(marks):
                    mark = until.take(pc.index_in(batch.column("column_path"), marks))
                    keep = pc.and_(keep, pc.fill_null(pc.greater(number, mark), True))
                rows = [*(batch.column(c).cast(t) for c, t in zip(names[:4], types[:4], strict=True)), number]
                yield pa.RecordBatch.from_arrays(rows, schema=schema).filter(keep)

    def commit(self, end: dict) -> None:
        """Nothing is kept of what was read."""
