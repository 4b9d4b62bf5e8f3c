"""A stream of samples by position: what is at a position depends on the seed and the position alone, so a run that is stopped and continued gives the rows of one that isn't."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PRIME = 2**31 - 1


def draw(seed: int, position: int) -> int:
    """A number from 0 to ``PRIME`` - 1."""
    x = (position * 69_621 + seed * 16_807 + 12_345) % PRIME
    x = (x * x + position) % PRIME
    return (x * x + seed) % PRIME * 48_271 % PRIME


class Span(InputPartition):
    def __init__(self, first: int, end: int):
        super().__init__((first, end))
        self.first, self.end = first, end


class PositionReader(DataSourceStreamReader):
    def __init__(self, seed: int, end: int, piece: int):
        self.seed, self.end, self.piece = seed, end, piece

    def initialOffset(self) -> dict:  # noqa: N802
        return {"position": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"position": self.end}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [Span(i, min(i + self.piece, end["position"])) for i in range(start["position"], end["position"], self.piece)]

    def read(self, part: Span) -> Iterator[tuple]:
        for i in range(part.first, part.end):
            yield i, draw(self.seed, i)

    def commit(self, end: dict) -> None:
        pass


class Positions(DataSource):
    @classmethod
    def name(cls) -> str:
        return "positions"

    def schema(self) -> str:
        return "position bigint, draw bigint"

    def streamReader(self, schema) -> PositionReader:  # noqa: N802
        return PositionReader(int(self.options.get("seed", 0)), int(self.options["end"]), int(self.options.get("piece", 100_000)))


def positions(spark: SparkSession, seed: int, end: int, piece: int = 100_000):
    """The stream ``position, draw`` of the positions before ``end``; a later run with a larger end goes on where its checkpoint stands."""
    spark.dataSource.register(Positions)
    return spark.readStream.format("positions").option("seed", seed).option("end", end).option("piece", piece).load()
