"""A table to compare, with columns addressed by place: names that differ in case, hold dots or clash do no harm."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Side:
    """df has internal column names; names maps the table's own to them."""

    df: DataFrame
    names: dict[str, str]
    kinds: dict[str, T.DataType]
    label: str = ""

    @classmethod
    def of(cls, df: DataFrame, tag: str, label: str = "") -> Side:
        fields = df.schema.fields
        inner = [f"{tag}{i}" for i in range(len(fields))]
        return cls(df.toDF(*inner), {f.name: n for f, n in zip(fields, inner, strict=True)}, {f.name: f.dataType for f in fields}, label)

    def column(self, name: str) -> Column:
        return F.col(self.names[name])

    def only(self, names: list[str]) -> Side:
        keep = list(dict.fromkeys(names))
        return Side(self.df.select(*[self.names[n] for n in keep]), {n: self.names[n] for n in keep}, {n: self.kinds[n] for n in keep}, self.label)

    def where(self, condition: Column) -> Side:
        return Side(self.df.filter(condition), self.names, self.kinds, self.label)
