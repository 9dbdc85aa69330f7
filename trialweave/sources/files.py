"""A catalog of files from their metadata: names parsed to entities, filters, the newest of each name, subjects, and paths by preference.

Contents are not read. A name is ``key-value`` pairs joined by ``_``, then a suffix and an
extension, as in ``sub-01_task-rest_run-2_events.tsv``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PAIR = r"(?:^|_)([A-Za-z]+)-([A-Za-z0-9+]+)(?=_|\.|$)"


def scan(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """path, name, folder, modified, length of all files below a folder; hidden ones (``.``, ``_``) are left out by Spark's readers."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        read = read.option("pathGlobFilter", glob)
    name = F.element_at(F.split("path", "/"), -1)
    return read.load(folder).select("path", name.alias("name"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.col("modificationTime").alias("modified"), "length")


def with_entities(files: DataFrame) -> DataFrame:
    """Adds entities (a map of the name's pairs; of a key that repeats, the last value), suffix and extension."""
    keys, values = F.regexp_extract_all("name", F.lit(_PAIR), F.lit(1)), F.regexp_extract_all("name", F.lit(_PAIR), F.lit(2))
    last = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), x["k"]))
    stem = F.regexp_extract("name", r"^([^.]*)", 1)
    suffix = F.element_at(F.split(stem, "_"), -1)
    return files.withColumn("entities", F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"])))).withColumn("suffix", F.when(~F.contains(suffix, F.lit("-")), suffix)).withColumn("extension", F.regexp_extract("name", r"^[^.]*(\..*)$", 1))


def layout(files: DataFrame, suffix: str | None = None, extension: str | None = None, **entities: str | list[str]) -> DataFrame:
    """Files with the given entities (one value or any of several), suffix and extension; entities may be written with or without leading zeros."""
    out = files if "entities" in files.columns else with_entities(files)
    bare = lambda c: F.regexp_replace(c, "^0+(?=.)", "")
    for key, wanted in entities.items():
        values = [wanted] if isinstance(wanted, str) else list(wanted)
        out = out.where(bare(F.col("entities")[key]).isin([v.lstrip("0") or v[-1:] for v in values]))
    if suffix:
        out = out.where(F.col("suffix") == suffix)
    return out.where(F.col("extension") == extension) if extension else out


def newest(files: DataFrame, by: list[str]) -> DataFrame:
    """Of the files that agree in some columns, the one modified last (ties: the last path)."""
    best = F.max(F.struct("modified", "path", *[c for c in files.columns if c not in (*by, "modified", "path", "entities")])).alias("_f")
    return files.groupBy(*by).agg(best).select(*by, "_f.*")


def subjects(files: DataFrame, key: str = "sub", drop: list[str] | None = None) -> DataFrame:
    """subject, n_files: ids in the names, without those to drop."""
    found = (files if "entities" in files.columns else with_entities(files)).select(F.col("entities")[key].alias("subject")).where("subject is not null")
    return found.where(~F.col("subject").isin(drop or [])).groupBy("subject").agg(F.count(F.lit(1)).alias("n_files"))


def missing(files: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``expected`` (entities as columns) for which there is no file."""
    found = files if "entities" in files.columns else with_entities(files)
    return expected.join(found.select(*[F.col("entities")[k].alias(k) for k in keys]).distinct(), keys, "left_anti")


def resolve(spark: SparkSession, candidates: list[str]) -> str:
    """The first path of a list that is there; an error that names them all if none is."""
    for path in candidates:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
            return path
    raise FileNotFoundError(f"none of these paths is there: {', '.join(candidates)}")


def region_masks(files: DataFrame) -> DataFrame:
    """region, path of mask files by their names without extension; of several with one name the newest."""
    named = files.withColumn("region", F.regexp_replace("name", r"\..*$", ""))
    return newest(named.select("region", "path", "modified", "length"), ["region"]).select("region", "path", "length")
