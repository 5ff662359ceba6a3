"""Readers for the recordings' files, each a DataFrame: catalogs, run records, matrices, stimulus XML, array bundles
and interleaved channel files. Array and channel files are Python data sources, read in row blocks by many tasks."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CATALOG = "recording_id int, cohort string, dir string, save_root string, registration_root string"
RUNS = "spec_idx int, spec_label string, run_idx int, fish_idx int, condition string, r2 double, aic double, params array<double>, perfect_separation boolean"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The recordings; 'None' and empty registrations become null."""
    rows = spark.read.schema(CATALOG).csv(path, header=True)
    root = F.when(~F.lower("registration_root").isin("none", "nan", ""), F.col("registration_root"))
    return rows.withColumn("registration_root", root)


def select_recordings(catalog: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows of an inclusive range of recording ids; an open end takes all."""
    kept = catalog if first is None else catalog.filter(F.col("recording_id") >= first)
    return kept if last is None else kept.filter(F.col("recording_id") <= last)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS).option("multiLine", True).json(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, values) of a text matrix split at white space; for matrices of a few rows, in one file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\n")).alias("row", "line"))
    return lines.select("row", F.split(F.trim("line"), r"\s+").cast("array<double>").alias("values"))


def read_epochs(spark: SparkSession, path: str, row_tag: str = "epoch") -> DataFrame:
    """(epoch_idx, field, value) of the fields that are numbers in every epoch, in the order of the file."""
    rows = spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", False).load(path)
    numbered = rows.withColumn("epoch_idx", F.row_number().over(_file_order()) - 1)
    fields = [c for c in rows.columns if c != "epoch_idx"]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("text")) for c in fields]))
    long = numbered.select("epoch_idx", pairs.alias("p")).select("epoch_idx", "p.field", F.expr("try_cast(trim(p.text) AS DOUBLE)").alias("value"))
    whole = long.groupBy("field").agg(F.count("value").alias("n"), F.count(F.lit(1)).alias("all")).filter("n = all").select("field")
    return long.join(F.broadcast(whole), "field").select("epoch_idx", "field", "value")


def read_camera_info(spark: SparkSession, path: str) -> DataFrame:
    """(name, value): the attributes of the ``info`` elements and then of the ``action`` elements; later ones win."""
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("xml"))
    tags = text.select(F.posexplode(F.concat(*[F.regexp_extract_all("xml", F.lit(rf"<{t}\b[^>]*>"), F.lit(0)) for t in ("info", "action")])).alias("at", "tag"))
    pairs = tags.select("at", F.posexplode(F.regexp_extract_all("tag", F.lit(r'([\w:.-]+)\s*=\s*("[^"]*"|\'[^\']*\')'), F.lit(0))).alias("k", "pair"))
    split = pairs.select("at", "k", F.regexp_extract("pair", r"^([\w:.-]+)", 1).alias("name"), F.regexp_extract("pair", r"=\s*[\"'](.*)[\"']$", 1).alias("value"))
    return split.groupBy("name").agg(F.max_by("value", F.struct("at", "k")).alias("value"))


def find_file(name: str, folders: list[str]) -> str:
    """The first of ``folders`` that has ``name``, joined to it."""
    import os

    for folder in folders:
        if os.path.exists(found := os.path.join(folder, name)):
            return found
    raise FileNotFoundError(f"no {name!r} in {', '.join(folders)}")


def rename_channels(channels: DataFrame, aliases: dict[str, str], channel: str = "channel") -> DataFrame:
    """Rows of the swim channels, the camera and grating channels and the aliased ones, under the names of what they show.

    ``aliases`` maps a field (gain, velocity, ...) to the channel that carries it; a channel may serve two fields.
    """
    names = [("swim1", "swim1"), ("swim2", "swim2"), ("visualInput1", "camTicks"), ("visualInput2", "gratingVel"), *[(c, f"{f}_trace") for f, c in aliases.items()]]
    shown = F.filter(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(n).alias("n")) for c, n in names]), lambda x: x["c"] == F.col(channel))
    return channels.withColumn("__s", F.explode(shown)).withColumn("signal", F.col("__s.n")).drop("__s")


def _file_order():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy(F.monotonically_increasing_id())  # one protocol file: tens of epochs


class _Block(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class NpySource(DataSource):
    """``spark.read.format("npy").option("path", f).option("key", k).load()``: (row, values) of an .npy file or one
    array of an .npz bundle. Files must be on storage that all executors mount. Pickled arrays are refused."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row long, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options)


class _NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.key, self.block = options["path"], options.get("key"), int(options.get("rows", 2048))

    def _opened(self):
        """(file at the first value, shape, dtype): of an .npz bundle only the wanted member is opened."""
        if self.path.endswith(".npz"):
            source = zipfile.ZipFile(self.path).open(f"{self.key}.npy")
        else:
            source = open(self.path, "rb")  # noqa: SIM115
        version = np.lib.format.read_magic(source)
        header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, by_column, kind = header(source)
        if kind.hasobject or by_column and len(shape) > 1:
            raise ValueError(f"{self.path}: pickled and column-major arrays are not read")
        return source, shape, kind

    def partitions(self) -> list[_Block]:
        source, shape, _ = self._opened()
        source.close()
        n = shape[0] if shape else 0
        return [_Block(a, min(n, a + self.block)) for a in range(0, n, self.block)] or [_Block(0, 0)]

    def read(self, part: _Block) -> Iterator[pa.RecordBatch]:
        source, shape, kind = self._opened()
        width = int(np.prod(shape[1:], dtype=np.int64)) if shape else 0
        with source:  # only this block's rows are held; a compressed member is unpacked up to them
            source.seek(part.start * width * kind.itemsize, 1)
            raw = source.read((part.stop - part.start) * width * kind.itemsize)
        rows = np.frombuffer(raw, kind).astype(float).reshape(part.stop - part.start, width)
        yield pa.RecordBatch.from_arrays([pa.array(range(part.start, part.stop), pa.int64()), pa.array(rows.tolist(), pa.list_(pa.float64()))], ["row", "values"])


class ChannelSource(DataSource):
    """``format("chflt")``: (channel, sample_idx, value) of interleaved float32 samples; the number of channels is in
    the suffix <n>chFlt. The first three are swim1 to swim3, others visualInput1 on; a last partial record is dropped."""

    @classmethod
    def name(cls) -> str:
        return "chflt"

    def schema(self) -> str:
        return "channel string, sample_idx long, value float"

    def reader(self, schema) -> DataSourceReader:
        return _ChannelReader(self.options)


class _ChannelReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.block = options["path"], int(options.get("samples", 1 << 20))
        found = re.search(r"(\d+)chFlt$", self.path)
        if not found or int(found[1]) < 1:
            raise ValueError(f"no number of channels in {self.path}")
        self.channels = int(found[1])

    def partitions(self) -> list[_Block]:
        import os

        n = os.path.getsize(self.path) // (4 * self.channels)
        return [_Block(a, min(n, a + self.block)) for a in range(0, n, self.block)] or [_Block(0, 0)]

    def read(self, part: _Block) -> Iterator[pa.RecordBatch]:
        count = part.stop - part.start
        data = np.fromfile(self.path, np.float32, count * self.channels, offset=4 * part.start * self.channels).reshape(count, self.channels)
        at = pa.array(range(part.start, part.stop), pa.int64())
        for c in range(self.channels):
            name = f"swim{c + 1}" if c < 3 else f"visualInput{c - 2}"
            yield pa.RecordBatch.from_arrays([pa.array([name] * count), at, pa.array(data[:, c].copy())], ["channel", "sample_idx", "value"])


def register(spark: SparkSession) -> None:
    """Makes the formats npy and chflt known to the session."""
    spark.dataSource.register(NpySource)
    spark.dataSource.register(ChannelSource)
