"""A corpus: named DataFrames around ``input``.

Filters narrow ``input``; tables that depend on its rows (token sequences,
annotations) are narrowed with it when they are read through ``dependent``.  Label tables
stay as they are, as their rows outlive the documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

INPUT = T.StructType([T.StructField("identifier", T.LongType()), T.StructField("document", T.StringType()), T.StructField("date", T.TimestampType()), T.StructField("source", T.StringType())])
LABEL = T.StructType([T.StructField("document_identifier", T.LongType()), T.StructField("label", T.LongType())])
SUBPHRASES = T.StructType([T.StructField("identifier", T.LongType()), T.StructField("document_identifier", T.LongType()), T.StructField("annotation", T.StringType()), T.StructField("sentiment", T.StringType())])


@dataclass(frozen=True)
class Corpus:
    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    metadata: dict[str, str] = field(default_factory=dict)

    @property
    def input(self) -> DataFrame:
        return self.tables["input"] if "input" in self.tables else self.spark.createDataFrame([], INPUT)

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"no table {name}; there are {', '.join(sorted(self.tables))}")
        return self.tables[name]

    def has(self, name: str) -> bool:
        return name in self.tables

    def dependent(self, name: str, key: str = "document_identifier") -> DataFrame:
        """Rows of a table whose document is still there."""
        kept = self.input.select(self.input["identifier"].alias(key))
        return self.table(name).join(kept, key, "left_semi")

    def labels(self, name: str) -> DataFrame:
        """Rows of a label table, temporary or with a dictionary; empty if there is none yet."""
        for table in (f"temporary_label_{name}", f"label_{name}"):
            if table in self.tables:
                return self.tables[table]
        return self.spark.createDataFrame([], LABEL)

    def with_table(self, name: str, df: DataFrame) -> Corpus:
        return replace(self, tables={**self.tables, name: df})

    def with_input(self, df: DataFrame) -> Corpus:
        return self.with_table("input", df)

    def without(self, name: str) -> Corpus:
        return replace(self, tables={k: v for k, v in self.tables.items() if k != name})

    def with_metadata(self, **more: str) -> Corpus:
        return replace(self, metadata={**self.metadata, **more})
