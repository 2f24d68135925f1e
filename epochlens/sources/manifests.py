"""Readers of scene and tile documents, raster tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.classic.column import Column

from epochlens import schemas
from epochlens.operators.catalog import box_rules, scene_rules, split_valid, tile_rules, validate

#: Bytes that are read ahead of a file that is hashed.
HASH_BUFFER = 1 << 20


def _documents(spark: SparkSession, path: str, schema) -> DataFrame:
    """One row per JSON object; a file may hold one object or a list, and unreadable text is kept aside."""
    rows = (
        spark.read.schema(schemas.with_corrupt(schema)).option("multiLine", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", schemas.CORRUPT).json(path)
    )
    flat = rows.select("*", F.col("_metadata.file_path").alias("document_path"))
    return flat.withColumns({c: F.col(f"bounds_wgs84.{c}") for c in ("min_lon", "min_lat", "max_lon", "max_lat")})


def _read(spark: SparkSession, path: str, schema, rules, defaults: dict) -> tuple[DataFrame, DataFrame]:
    rows = _documents(spark, path, schema)
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
    readable = {"document cannot be read": F.col(schemas.CORRUPT).isNull()}
    valid, rejected = split_valid(validate(rows, {**readable, **rules}))
    return valid.drop(schemas.CORRUPT), rejected


def read_scenes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Accepted scenes and rejected documents (with `errors`)."""
    return _read(spark, path, schemas.SCENE, {**scene_rules(), **box_rules()}, {"sensor": "unknown", "platform": "unknown"})


def read_tiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Accepted tiles and rejected documents (with `errors`)."""
    return _read(spark, path, schemas.TILE, tile_rules(), {"sensor": "unknown", "zoom_level": 14})


def read_raster_table(spark: SparkSession, path: str) -> DataFrame:
    """Raster blocks as written by `write_raster_table`."""
    return spark.read.parquet(path)


def _file_sha256(spark: SparkSession, path: str) -> Column:
    """SHA-256 of the files named by a column, in hexadecimal.

    A task reads a file as a stream by Hadoop's file system, so it holds one buffer and no file. No built-in
    function reads a stream; the expression calls classes that every Spark has on its class path.
    """
    jvm = spark._jvm
    expressions, types = jvm.org.apache.spark.sql.catalyst.expressions, jvm.org.apache.spark.sql.types
    columns = jvm.org.apache.spark.sql.classic.ExpressionUtils

    def kind(name):
        return jvm.org.apache.spark.util.Utils.classForName(name, True, False)

    def of(*items):
        return jvm.org.apache.spark.api.python.PythonUtils.toSeq(list(items))

    def constant(value, name):
        return expressions.Literal(value, types.ObjectType(kind(name)))

    def new(name, *args):
        return expressions.objects.NewInstance(kind(name), of(*args), of(), True, types.ObjectType(kind(name)), jvm.scala.Option.empty())

    def call(target, method, name, *args):
        return expressions.objects.Invoke(target, method, types.ObjectType(kind(name)), of(*args), of(), True, True, True)

    # The settings go along as they do with Spark's own readers; an executor may lack those made in this session.
    settings = jvm.org.apache.spark.util.SerializableConfiguration(spark._jsparkSession.sessionState().newHadoopConf())
    conf = call(constant(settings, "org.apache.spark.util.SerializableConfiguration"), "value", "org.apache.hadoop.conf.Configuration")
    file = new("org.apache.hadoop.fs.Path", call(columns.expression(F.col(path)._jc), "toString", "java.lang.String"))
    system = call(file, "getFileSystem", "org.apache.hadoop.fs.FileSystem", conf)
    opened = call(system, "open", "org.apache.hadoop.fs.FSDataInputStream", file, expressions.Literal.create(HASH_BUFFER, types.DataTypes.IntegerType))
    stream = new("org.apache.commons.io.input.AutoCloseInputStream", opened)  # closed at the file's end
    digest = new("org.apache.commons.codec.digest.DigestUtils", constant("SHA-256", "java.lang.String"))
    hexadecimal = call(digest, "digestAsHex", "java.lang.String", stream)
    text = expressions.objects.StaticInvoke(
        kind("org.apache.spark.unsafe.types.UTF8String"), types.DataTypes.StringType, "fromString", of(hexadecimal), of(), True, True, True, jvm.scala.Option.empty()
    )
    return Column(columns.column(text))


def file_inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Size and SHA-256 of every file, whatever its size; an empty file is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select(
        "path", "length", "modificationTime", _file_sha256(spark, "path").alias("file_hash"), F.when(F.col("length") == 0, "file is empty").alias("error")
    )
