"""What to move: table mappings, load settings and the names they resolve to."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from datamove.sources.jdbc import Connection

# The formats an export folder may have, and the load modes.
FILE_FORMATS = ("PARQUET", "CSV", "JSON", "AVRO", "ORC")
LOAD_MODES = ("append", "replace")
LOAD_METHODS = ("catalog", "files", "jdbc")

# Fixed value: a name segment that marks a production target.
PRODUCTION_NAME = r"(^|[._\-])(prod|production)($|[._\-])"


class MoveError(Exception):
    """A problem the caller can act on; the message says what to do."""


@dataclass(frozen=True)
class TableMapping:
    """One table to move. `columns` maps target column -> source column; empty means same names. A read over a connection is split into `parts` ranges of `key`."""

    source: str
    target: str
    load: bool = True
    columns: dict[str, str] = field(default_factory=dict)
    where: str = ""
    key: str = ""
    parts: int = 8

    @property
    def short_name(self) -> str:
        return self.source.split(".")[-1]


@dataclass(frozen=True)
class MoveSettings:
    """Settings shared by all tables of one move."""

    tables: tuple[TableMapping, ...] = ()
    mode: str = "append"
    method: str = "catalog"  # catalog: read tables; files: read export folders; jdbc: read the database itself
    source_catalog: str = ""
    files_root: str = ""
    file_format: str = "PARQUET"
    target_schema: str = "default"
    schema_map: dict[str, str] = field(default_factory=dict)
    connection: Connection | None = None

    def __post_init__(self) -> None:
        if self.method not in LOAD_METHODS:
            raise MoveError(f"Load method must be one of {', '.join(LOAD_METHODS)}, not {self.method!r}.")
        if self.mode not in LOAD_MODES:
            raise MoveError(f"Load mode must be one of {', '.join(LOAD_MODES)}, not {self.mode!r}.")
        if self.file_format.upper() not in FILE_FORMATS:
            raise MoveError(f"File format must be one of {', '.join(FILE_FORMATS)}, not {self.file_format!r}.")

    def target_for(self, source: str) -> str:
        """Target name of a source table: its schema's entry in the map (any case), else the default schema."""
        *schema, table = source.split(".")
        by_lower = {k.lower(): v for k, v in self.schema_map.items()}
        prefix = by_lower.get(schema[-1].lower(), self.target_schema) if schema else self.target_schema
        return f"{prefix}.{table}"


def looks_like_production(name: str) -> bool:
    return re.search(PRODUCTION_NAME, name or "", re.IGNORECASE) is not None


def refuse_production(targets: list[str], allow: bool = False) -> None:
    found = [t for t in targets if looks_like_production(t)]
    if found and not allow:
        raise MoveError(f"These targets look like production: {', '.join(found)}. Pass allow_production=True to load them.")
