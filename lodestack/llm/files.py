"""Files that tasks write and read themselves, in the shared folder, by Arrow's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def located(spark: SparkSession, path: str) -> str:
    """A full URI for ``path``, made by Hadoop on the driver, with the folder created."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    uri = fs.makeQualified(at).toUri().toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def opened_for_writing(uri: str):
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri)
    return fs.open_output_stream(path, compression=None, buffer_size=1 << 20)


def opened_for_reading(uri: str):
    """The open file, and its size."""
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri)
    f = fs.open_input_file(path)
    return f, f.size()
