"""Project identity of local checkouts: their remotes, read from the git configuration below a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators.memory import project_key

#: Where a checkout keeps its configuration, and how it writes a remote there.
CONFIG = r"^(.*)/\.git/config$"
REMOTE = r'(?s)\[remote "([^"]*)"\][^\[]*?\burl\s*=\s*([^\r\n]+)'


def checkouts(spark: SparkSession, root: str, depth: int = 4) -> DataFrame:
    """(git_root, remotes) of all checkouts up to ``depth`` folders below ``root``; remotes: array of (name, url), in order of the file.

    Hidden folders are only found by name, so each depth is a pattern of its own.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    patterns = [f"{root.rstrip('/')}/{'*/' * d}.git/config" for d in range(depth + 1)]
    found = [p for p in patterns if store.globStatus(path(p))]
    if not found:
        return spark.createDataFrame([], "git_root string, remotes array<struct<name:string,url:string>>")
    rows = spark.read.text(found, wholetext=True)
    rows = rows.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("path"), F.col("value").alias("text")).where(F.col("path").rlike(CONFIG))
    names, urls = (F.regexp_extract_all("text", F.lit(REMOTE), F.lit(k)) for k in (1, 2))
    remotes = F.zip_with(names, urls, lambda n, u: F.struct(n.alias("name"), F.trim(u).alias("url")))
    return rows.select(F.regexp_extract("path", CONFIG, 1).alias("git_root"), remotes.alias("remotes"))


def with_project_keys(sessions: DataFrame, known: DataFrame, folder: str = "cwd") -> DataFrame:
    """sessions with project_key: that of the innermost checkout (``checkouts``) their folder lies in, else of the folder itself.

    A folder is cut into its own parts, so it meets checkouts by equality; null folders have no key.
    """
    path = F.regexp_replace(F.replace(F.col(folder), F.lit("\\"), F.lit("/")), "(?<=.)/+$", "")
    parts = F.split(path, "/")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    each = sessions.select(folder).where(F.col(folder).isNotNull()).distinct().select(F.col(folder).alias("_folder"), F.explode(upto).alias("git_root"))
    found = each.join(known, "git_root").groupBy("_folder").agg(F.max_by(F.struct("git_root", "remotes"), F.length("git_root")).alias("_at"))
    out = sessions.join(found, sessions[folder] == found["_folder"], "left")
    return out.withColumn("project_key", project_key(F.col("_at.remotes"), F.col("_at.git_root"), F.col(folder))).drop("_folder", "_at")
