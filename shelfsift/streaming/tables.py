"""Structured Streaming jobs over files that keep arriving.

Scores go to a folder named after the number of their micro-batch, replaced when the batch is run
again after a failure. Counts go to folders that a manifest lists; they are merged in levels, so that
their number stays small, and remember the files they come from, so that every file counts once even where the progress
of the stream is lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfsift.functions.text import tokens_ws
from shelfsift.operators.prep import CONFIDENT, confident

FAN = 8  # folders of one level that are merged into one of the next
RETIRED = -1  # level of folders that the last merge replaced
COUNTS = "class string, token string, n bigint"
FILES = "file string"
MANIFEST = "version bigint, folder string, level int"


def read_arriving(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files: int = 1000) -> DataFrame:
    """Parquet files as they appear in a folder, at most ``files`` per micro-batch.

    A plain name in place of a pattern is one table there: a file, or the files of a folder of that name. The braces
    make it a pattern of paths, which may match nothing at first.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if any(c in pattern for c in "*?[{"):
        return reader.option("pathGlobFilter", pattern).parquet(folder)
    return reader.parquet(f"{folder.rstrip('/')}/{{{pattern}}}")


def _each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, once: bool) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


class CountFolders:
    """The folders of counts below ``sink`` and the manifest that lists those in use.

    A folder holds the counts of some files and the names of these files. It counts from the moment a
    manifest lists it: what a crash leaves half written is never read. Manifests go by turns to two places, so the last one
    stands while the next is written, and each is a single file, which appears at once or not at all.
    One writer at a time; readers at any time.

    As soon as ``fan`` folders of one level are listed, they are merged into one of the next level, and the
    manifest swaps them at once. So at most ``fan`` - 1 folders of each level are read, with one level for each
    factor of ``fan`` in the number of batches, and a count is rewritten once a level. Replaced folders are emptied
    at the next swap, so that a reader of the manifest before still finds them.
    """

    def __init__(self, spark: SparkSession, sink: str, fan: int = FAN):
        if fan < 2:
            raise ValueError("at least two folders make a merge")
        self.spark, self.sink, self.fan = spark, sink.rstrip("/"), fan
        self.last: tuple[int, list[tuple[str, int]]] | None = None

    def known(self) -> tuple[int, list[tuple[str, int]]]:
        """The manifest as the only writer knows it: read once, then as it was last swapped."""
        if self.last is None:
            self.last = self.manifest()
        return self.last

    def manifest(self) -> tuple[int, list[tuple[str, int]]]:
        """(version, [(folder, level), ...]) of the last whole manifest; version 0 lists none."""
        last = (0, [])
        for place in (0, 1):
            try:
                rows = self.spark.read.schema(MANIFEST).parquet(f"{self.sink}/manifest-{place}").collect()
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
                continue
            if rows and rows[0]["version"] > last[0]:
                last = rows[0]["version"], sorted((r["folder"], r["level"]) for r in rows)
        return last

    def swap(self, version: int, folders: list[tuple[str, int]]) -> None:
        """Make ``folders`` the ones in use."""
        rows = self.spark.createDataFrame([(version, f, n) for f, n in folders], MANIFEST)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.sink}/manifest-{version % 2}")
        self.last = version, sorted(folders)

    def paths(self, folders: list[str], kind: str) -> list[str]:
        return [f"{self.sink}/{folder}/{kind}" for folder in folders]

    def read(self, folders: list[str], kind: str, schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*self.paths(folders, kind))

    def in_use(self) -> list[str]:
        return [folder for folder, level in self.known()[1] if level != RETIRED]

    def write(self, counts: DataFrame, files: DataFrame) -> str:
        """A new folder, of a name no other has, which no manifest lists yet."""
        folder = f"part-{uuid.uuid4().hex}"
        counts.write.parquet(f"{self.sink}/{folder}/counts")
        files.write.parquet(f"{self.sink}/{folder}/files")
        return folder

    def unseen(self, files: DataFrame) -> list[str]:
        """Those of ``files`` that no folder in use counts: at most as many as a micro-batch has."""
        seen = self.read(self.in_use(), "files", FILES)
        return sorted(r["file"] for r in files.join(seen, "file", "left_anti").collect())

    def add(self, counts: DataFrame, files: DataFrame) -> None:
        version, listed = self.known()
        self.swap(version + 1, [*listed, (self.write(counts, files), 0)])

    def merge(self) -> bool:
        """Merge the folders of the lowest level that has ``fan`` of them; False if there is none."""
        version, listed = self.known()
        full = [n for n in sorted({n for _, n in listed if n != RETIRED}) if sum(m == n for _, m in listed) >= self.fan]
        if not full:
            return False
        old = [folder for folder, level in listed if level == full[0]]
        counts = self.read(old, "counts", COUNTS).groupBy("class", "token").agg(F.sum("n").alias("n"))
        new = self.write(counts, self.read(old, "files", FILES))
        kept = [(f, n) for f, n in listed if n not in (full[0], RETIRED)]
        self.swap(version + 1, [*kept, (new, full[0] + 1), *[(f, RETIRED) for f in old]])
        self.empty([f for f, n in listed if n == RETIRED])
        return True

    def empty(self, folders: list[str]) -> None:
        for kind, schema in (("counts", COUNTS), ("files", FILES)):
            for path in self.paths(folders, kind):
                self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def stream_token_counts(
    stream: DataFrame, text: str, cls: str, sink: str, checkpoint: str, once: bool = True, fan: int = FAN
) -> StreamingQuery:
    """Add each batch's (class, token, n) to the folders of ``sink``; ``token_counts`` sums them into the index.

    The counts of a batch are grouped where they are made, and no state grows with the vocabulary.
    ``stream`` reads files. A file counts once by its name: a batch run again, or all batches after the
    checkpoint is lost, leave out the files that are counted, whatever their number in the stream. Merges run between
    batches, see ``CountFolders``. Null texts and empty files count as files without tokens.
    """

    folders = CountFolders(stream.sparkSession, sink, fan)

    def write(batch: DataFrame, number: int) -> None:
        new = folders.unseen(batch.select("file").distinct())
        if new:
            rows = batch.where(F.col("file").isin(new))
            counts = rows.select("class", F.explode(tokens_ws("text")).alias("token")).groupBy("class", "token").agg(F.count(F.lit(1)).alias("n"))
            folders.add(counts, rows.select("file").distinct())
        while folders.merge():
            pass

    named = stream.select(F.col("_metadata.file_path").alias("file"), F.col(cls).alias("class"), F.col(text).alias("text"))
    writer = named.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def token_counts(spark: SparkSession, sink: str) -> DataFrame:
    """The index counts gathered so far; none where nothing is."""
    folders = CountFolders(spark, sink)
    return folders.read(folders.in_use(), "counts", COUNTS).groupBy("class", "token").agg(F.sum("n").alias("n_wc"))


def stream_score(
    stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, cut: float = CONFIDENT,
    prob: str = "probability", once: bool = True,
) -> StreamingQuery:
    """Score arriving rows and append the confident ones."""
    return _each_batch(stream, lambda batch: confident(scorer(batch), prob, cut), sink, checkpoint, once)


def scored_rows(spark: SparkSession, sink: str, schema: str) -> DataFrame:
    """The rows of all batches so far; none where no batch has come."""
    try:
        return spark.read.schema(f"{schema}, batch int").parquet(sink)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, batch int")
