"""Providers: where companies, pages and search hits come from.

A provider has one method, which gives a DataFrame.  The default reads a table.  `RowGroups` is a data source of Spark for
stores that hand out files: a partition a row group, the columns and simple filters that a query needs go to the reader, and
row groups that the statistics rule out are never opened.  An outside service becomes a provider by a class with the same
method; `provider` chooses by name, and by what is configured.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

FORMAT = "row_groups"
_TESTS = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in", IsNotNull: "there"}


class Provider(Protocol):
    def rows(self, spark: SparkSession) -> DataFrame: ...


class Table:
    """A table of Parquet files, by any path that Spark reads."""

    def __init__(self, path: str):
        self.path = path

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


class Store:
    """The same files by the data source below."""

    def __init__(self, path: str):
        self.path = path

    def rows(self, spark: SparkSession) -> DataFrame:
        spark.dataSource.register(RowGroups)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        return spark.read.format(FORMAT).load(self.path)


#: Kinds of providers by name, and what must be configured for one; what is not falls back to the default.
KINDS: dict[str, tuple[Callable[..., Provider], tuple[str, ...]]] = {"table": (Table, ("path",)), "store": (Store, ("path", "store_key"))}


def provider(settings: dict[str, str], default: str = "table") -> Provider:
    """settings: provider (a name, any case) and what its kind needs; an unknown or unconfigured one is the default."""
    name = (settings.get("provider") or "").strip().lower()
    kind, needs = KINDS.get(name, KINDS[default])
    if any(not settings.get(n) for n in needs):
        kind, needs = KINDS[default]
    if any(not settings.get(n) for n in needs):
        raise ValueError(f"provider {default} needs {', '.join(needs)}")
    return kind(settings["path"])


def _files(path: str):
    """(file system, files) of a path."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.File:
        return system, [place]
    found = system.get_file_info(fs.FileSelector(place, recursive=True))
    return system, sorted(f.path for f in found if f.is_file and f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", ".")))


class RowGroup(InputPartition):
    def __init__(self, file: str, number: int):
        super().__init__((file, number))
        self.file, self.number = file, number


class RowGroups(DataSource):
    """Parquet files, a partition a row group."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        system, files = _files(self.options["path"])
        return from_arrow_schema(pq.read_schema(files[0], filesystem=system))

    def reader(self, schema):
        return RowGroupReader(self.options["path"], schema.fieldNames())


class RowGroupReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.tests = path, columns, []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            sign = _TESTS.get(type(f))
            if sign and len(f.attribute) == 1:
                self.tests.append((f.attribute[0], sign, getattr(f, "value", None)))
            else:
                yield f  # Spark's own

    def partitions(self) -> list[RowGroup]:
        import pyarrow.parquet as pq

        system, files = _files(self.path)
        out = []
        for file in files:
            meta = pq.read_metadata(file, filesystem=system)
            places = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
            out += [RowGroup(file, g) for g in range(meta.num_row_groups) if self._may_hold(meta.row_group(g), places)]
        return out

    def _may_hold(self, group, places: dict[str, int]) -> bool:
        for column, sign, value in self.tests:
            stats = group.column(places[column]).statistics if column in places else None
            if stats is None or not stats.has_min_max:
                continue
            low, high = stats.min, stats.max
            values = value if sign == "in" else (value,)
            try:
                fits = {"==": lambda v: low <= v <= high, "in": lambda v: low <= v <= high, ">": lambda v: high > v, ">=": lambda v: high >= v, "<": lambda v: low < v, "<=": lambda v: low <= v, "there": lambda v: True}[sign]
                if not any(fits(v) for v in values):
                    return False
            except TypeError:  # statistics of another type say nothing
                continue
        return True

    def read(self, partition: RowGroup) -> Iterator:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        system, _ = _files(partition.file if "://" not in self.path else self.path)
        with system.open_input_file(partition.file) as source:
            for batch in pq.ParquetFile(source).iter_batches(row_groups=[partition.number], columns=self.columns):
                for column, sign, value in self.tests:
                    own = batch.column(batch.schema.get_field_index(column))
                    keep = pc.is_valid(own) if sign == "there" else pc.is_in(own, value_set=pa_values(value, own.type)) if sign == "in" else {"==": pc.equal, ">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal}[sign](own, pa_values([value], own.type)[0])
                    batch = batch.filter(keep)
                yield batch


def pa_values(values, kind):
    import pyarrow as pa

    return pa.array(list(values), kind)
