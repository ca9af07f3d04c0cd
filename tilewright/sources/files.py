"""Files of episodes, images, feature vectors and work items."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.runtime import BATCH_BYTES

IMAGE_NAME = r"(?i)\.(jpe?g|png)$"


def is_image(name: Column) -> Column:
    return name.rlike(IMAGE_NAME)


def first_files(df: DataFrame, n: int, name: str = "name") -> DataFrame:
    """The rows of the first n files in the order of names; only the names are sorted."""
    return df.join(df.select(name).distinct().orderBy(name).limit(n), name, "left_semi")


def split_episode(rows: DataFrame, vector: str, n_actions: int = 1) -> DataFrame:
    """(…, frame, action): rows of a frame with its action (or one-hot actions) behind it."""
    d = F.size(vector) - n_actions
    tail = F.slice(vector, d + 1, n_actions)
    action = F.element_at(tail, 1).cast("int") if n_actions == 1 else (F.array_position(tail, F.array_max(tail)) - 1).cast("int")
    return rows.select("*", F.slice(vector, F.lit(1), d).alias("frame"), action.alias("action"))


def class_counts(names: DataFrame, class_col: str, name_col: str) -> DataFrame:
    """(class, n): images of each class by their names."""
    return names.where(is_image(F.col(name_col))).groupBy(class_col).agg(F.count(F.lit(1)).alias("n"))


def tar_members(spark: SparkSession, path: str, decode: Callable[[bytes], object] | None = None, ddl: str = "name string, payload binary") -> DataFrame:
    """The image members of tar files, a task for each file: (file, name, payload), or what ``decode`` makes of a payload.

    ``decode`` returns the values of ``ddl`` after the name, or None to leave a member out.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("file string, " + ddl)
    arrow = to_arrow_schema(schema)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out, held = [[] for _ in names], 0
                with tarfile.open(fileobj=io.BytesIO(content.as_py())) as t:
                    for m in t:
                        if m.isfile() and re.search(IMAGE_NAME, m.name):
                            raw = t.extractfile(m).read()
                            values = (raw,) if decode is None else decode(raw)
                            if values is not None:
                                for c, v in zip(out, (file, m.name, *values), strict=True):
                                    c.append(v)
                                held += max(m.size, 64)
                                if held > BATCH_BYTES:
                                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)
                                    out, held = [[] for _ in names], 0
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def csv_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(name, features) of lines ``name,f1,f2,…``."""
    parts = F.split("value", ",")
    return spark.read.text(path).select(F.element_at(parts, 1).alias("name"), F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda x: x.cast("double")).alias("features"))


def class_of_name(name: Column) -> Column:
    """The class before the first underscore of a file's name."""
    return F.element_at(F.split(F.element_at(F.split(name, "/"), -1), "_"), 1)


def tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files below a path, without those that cannot be read."""
    return spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(path)


def column_batches(rows: DataFrame, bytes_col: str, height: int, width: int, channels: int) -> DataFrame:
    """(…, px): images stored as bytes in channels, rows, columns, behind a label byte."""
    d = height * width * channels
    at = F.sequence(F.lit(1), F.lit(d))
    return rows.select("*", F.transform(at, lambda k: F.conv(F.hex(F.substring(F.col(bytes_col), k + 1, 1)), 16, 10).cast("int")).alias("px"), F.conv(F.hex(F.substring(bytes_col, 1, 1)), 16, 10).cast("int").alias("class"))


def tar_images(spark: SparkSession, path: str, decode: Callable[[bytes], tuple[int, int, int, list[float]] | None]) -> DataFrame:
    """(i, class, label, name, h, w, px) of the images of tar files, one file for each class, its label being its place among the files.

    ``decode`` gives height, width, channels and the flat pixels of channels, rows, columns; grey images become three equal
    channels. Rows are numbered by class and name; a class begins where the counts of those before it add up to.
    """
    from pyspark.sql import Window

    from tilewright.operators.windows import offsets
    from tilewright.runtime import cut

    members = tar_members(spark, path, decode, "name string, h int, w int, c int, px array<double>")
    name = F.regexp_extract("file", r"([^/]*)\.tar$", 1)
    rows = cut(members.withColumn("class", name), "tar").withColumn("px", F.when(F.col("c") == 1, F.concat("px", "px", "px")).otherwise(F.col("px")))
    starts = offsets(rows.groupBy("class").agg(F.count(F.lit(1)).alias("n")), "class").withColumn("label", F.row_number().over(Window.orderBy("class")) - 1)
    placed = rows.withColumn("k", F.row_number().over(Window.partitionBy("class").orderBy("name")) - 1)
    return placed.join(F.broadcast(starts), "class").select((F.col("start") + F.col("k")).alias("i"), "class", "label", "name", "h", "w", "px")
