"""Comparison of two schemas by column name."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from .config import DiffError


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    data_type: str


@dataclass(frozen=True)
class TypeChange:
    name: str
    left: str
    right: str


@dataclass(frozen=True)
class Rename:
    left: str
    right: str
    similarity: float


@dataclass
class SchemaDiff:
    """added in the right table's order, removed and mutual in the left's, renamed by falling similarity."""

    added: list[ColumnInfo] = field(default_factory=list)
    removed: list[ColumnInfo] = field(default_factory=list)
    type_changed: list[TypeChange] = field(default_factory=list)
    renamed: list[Rename] = field(default_factory=list)
    mutual: list[str] = field(default_factory=list)

    @property
    def empty(self) -> bool:
        return not (self.added or self.removed or self.type_changed or self.renamed)

    def rename(self, found: list[Rename]) -> None:
        """Columns that are renamed are neither added nor removed."""
        self.renamed = found
        self.added = [c for c in self.added if c.name not in {r.right for r in found}]
        self.removed = [c for c in self.removed if c.name not in {r.left for r in found}]


def compare_schemas(left: T.StructType, right: T.StructType) -> SchemaDiff:
    kinds, others = ({f.name: f.dataType for f in s.fields} for s in (left, right))
    out = SchemaDiff(
        added=[ColumnInfo(n, t.simpleString()) for n, t in others.items() if n not in kinds],
        removed=[ColumnInfo(n, t.simpleString()) for n, t in kinds.items() if n not in others],
        type_changed=[TypeChange(n, t.simpleString(), others[n].simpleString()) for n, t in kinds.items() if n in others and others[n] != t],
        mutual=[n for n in kinds if n in others],
    )
    if not out.mutual:
        raise DiffError("tables share no columns; nothing to compare")
    return out


def check_key(key: tuple[str, ...], schema: SchemaDiff) -> None:
    for name in key:
        if name not in schema.mutual:
            raise DiffError(f"key column `{name}` must exist in both tables (shared columns: {', '.join(schema.mutual)})")
