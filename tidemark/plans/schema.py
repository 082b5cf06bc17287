"""Table schemas with stable field ids.

Each logical column maps to a field id; the change rows store the column under
the physical name ``f<id>``.  Renaming or re-adding a column therefore never
exposes values written under an older field of the same name.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

# Widening rules accepted by ``widen``: (from, to).
_WIDENINGS = {
    ("int", "bigint"), ("smallint", "int"), ("smallint", "bigint"),
    ("tinyint", "smallint"), ("tinyint", "int"), ("tinyint", "bigint"),
    ("float", "double"),
}


@dataclass(frozen=True)
class Field:
    id: int
    name: str
    type: str          # Spark DDL simple string, e.g. "bigint", "decimal(10,2)"
    nullable: bool = True

    @property
    def phys(self) -> str:
        return f"f{self.id}"


@dataclass(frozen=True)
class TableSchema:
    fields: tuple[Field, ...]
    keys: tuple[str, ...] = ()
    partition_by: tuple[tuple[str, str], ...] = ()   # (transform, column), transform in {"day", "identity"}
    next_id: int = 1

    # -- construction -----------------------------------------------------
    @staticmethod
    def from_struct(struct: T.StructType, keys=(), partition_by=()) -> "TableSchema":
        fs = tuple(Field(i + 1, f.name, f.dataType.simpleString(), f.nullable)
                   for i, f in enumerate(struct.fields))
        ts = TableSchema(fs, tuple(keys), tuple(tuple(p) for p in partition_by), len(fs) + 1)
        for k in ts.keys:
            ts.field(k)
        return ts

    @staticmethod
    def from_json(s: str) -> "TableSchema":
        d = json.loads(s)
        return TableSchema(tuple(Field(**f) for f in d["fields"]), tuple(d.get("keys", ())),
                           tuple(tuple(p) for p in d.get("partition_by", ())), d["next_id"])

    def to_json(self) -> str:
        return json.dumps({"fields": [f.__dict__ for f in self.fields], "keys": list(self.keys),
                           "partition_by": [list(p) for p in self.partition_by],
                           "next_id": self.next_id}, sort_keys=True)

    # -- lookups ----------------------------------------------------------
    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(f"no column {name!r}; columns are {self.names}")

    def has(self, name: str) -> bool:
        return any(f.name == name for f in self.fields)

    @property
    def key_phys(self) -> list[str]:
        return [self.field(k).phys for k in self.keys] if self.keys else ["_row_id"]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, T._parse_datatype_string(f.type), f.nullable)
                             for f in self.fields])

    # -- evolution --------------------------------------------------------
    def add(self, name: str, type_: str, if_not_exists: bool = False) -> "TableSchema":
        if self.has(name):
            if if_not_exists:
                return self
            raise ValueError(f"column {name!r} already exists")
        f = Field(self.next_id, name, T._parse_datatype_string(type_).simpleString(), True)
        return replace(self, fields=self.fields + (f,), next_id=self.next_id + 1)

    def drop(self, name: str, if_exists: bool = False) -> "TableSchema":
        if not self.has(name):
            if if_exists:
                return self
            raise KeyError(f"no column {name!r}")
        if name in self.keys:
            raise ValueError(f"cannot drop identity column {name!r}")
        if any(p[1] == name for p in self.partition_by):
            raise ValueError(f"cannot drop partition source column {name!r}")
        return replace(self, fields=tuple(f for f in self.fields if f.name != name))

    def rename(self, old: str, new: str) -> "TableSchema":
        if self.has(new):
            raise ValueError(f"column {new!r} already exists")
        f = self.field(old)
        keys = tuple(new if k == old else k for k in self.keys)
        return replace(self, keys=keys, fields=tuple(replace(x, name=new) if x.id == f.id else x
                                                     for x in self.fields))

    def widen(self, name: str, type_: str) -> "TableSchema":
        f = self.field(name)
        new = T._parse_datatype_string(type_).simpleString()
        if new == f.type:
            return self
        if not _can_widen(f.type, new):
            raise ValueError(f"cannot change {name!r} from {f.type} to {new}")
        return replace(self, fields=tuple(replace(x, type=new) if x.id == f.id else x
                                          for x in self.fields))


def _can_widen(old: str, new: str) -> bool:
    if (old, new) in _WIDENINGS:
        return True
    if old.startswith("decimal") and new.startswith("decimal"):
        p1, s1 = _dec(old)
        p2, s2 = _dec(new)
        return s2 == s1 and p2 >= p1
    return False


def _dec(t: str) -> tuple[int, int]:
    p, s = t[t.index("(") + 1:t.index(")")].split(",")
    return int(p), int(s)


def physical_fields(schemas: list[TableSchema]) -> dict[int, str]:
    """Field id -> newest type over a sequence of schemas (oldest first)."""
    out: dict[int, str] = {}
    for s in schemas:
        for f in s.fields:
            out[f.id] = f.type
    return out
