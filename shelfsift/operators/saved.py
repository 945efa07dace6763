"""Models of this library that Spark can write and read, alone or inside a ``PipelineModel``."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession


class OwnModel(Model, MLWritable, MLReadable):
    """A model made of plain values and of parts that can be written: Spark models and tables."""

    def values(self) -> dict[str, object]:
        """What JSON can hold."""
        return {}

    def parts(self) -> dict[str, Model | DataFrame]:
        return {}

    @classmethod
    def of(cls, values: dict[str, object], parts: dict[str, Model | DataFrame]) -> OwnModel:
        return cls(**parts, **values)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: OwnModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        parts = self.model.parts()
        tables = sorted(name for name, part in parts.items() if isinstance(part, DataFrame))
        DefaultParamsWriter.saveMetadata(
            self.model, path, SparkSession.getActiveSession(),
            extraMetadata={"values": self.model.values(), "tables": tables, "models": sorted(set(parts) - set(tables))})
        for name, part in parts.items():
            (part.write.mode("overwrite").parquet if name in tables else part.write().overwrite().save)(f"{path}/{name}")


class _Reader(MLReader):
    def __init__(self, kind: type[OwnModel]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> OwnModel:
        spark = SparkSession.getActiveSession()
        found = DefaultParamsReader.loadMetadata(path, spark)
        parts = {name: spark.read.parquet(f"{path}/{name}") for name in found["tables"]}
        parts |= {name: DefaultParamsReader.loadParamsInstance(f"{path}/{name}", spark) for name in found["models"]}
        model = self.kind.of(found["values"], parts)
        model._resetUid(found["uid"])
        return model
