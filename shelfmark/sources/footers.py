"""Schemas of many Parquet files in one pass over their footers.

A task reads the footers of its files, takes from each the type of every stored column, and returns
every distinct schema it met once, with the files that have it. The driver, which holds the list of
files for any scan, sorts schemas whose shared columns agree into groups that one scan can read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

_DECIMAL = re.compile(r"Decimal\(precision=\d+, scale=(-?\d+)\)")


@dataclass
class FileGroup:
    """Files that one scan can read.

    `columns` are the stored columns (nested ones by their leaves) and their types; `examples` one
    file of every schema. `empty` are top-level columns that hold no value in any of the files, and
    `typed` those that hold one, or may.
    """

    columns: dict[str, str] = field(default_factory=dict)
    files: list[str] = field(default_factory=list)
    examples: list[str] = field(default_factory=list)
    typed: set[str] = field(default_factory=set)
    empty: set[str] = field(default_factory=set)


def _footer_reader():
    """What tasks do: a row per schema that a task meets, with its files.

    Its parts are functions inside it, so that workers need not have this library.
    """

    def opened(path: str):
        """A file as tasks can open it, whatever Spark calls its file system."""
        from pyarrow import fs

        if path.startswith("file:"):
            return pa.OSFile("/" + path[5:].lstrip("/"))
        scheme, _, rest = path.partition("://")
        scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
        system, place = fs.FileSystem.from_uri(f"{scheme}://{rest}")
        return system.open_input_file(place)

    def described(path: str) -> str:
        """JSON of the stored columns, in their order: name, type, whether no row has a value."""
        import pyarrow.parquet as pq

        with opened(path) as file:
            footer = pq.ParquetFile(file).metadata
        out = []
        for i in range(footer.num_columns):
            column = footer.schema.column(i)
            logical = str(column.logical_type)
            decimal = _DECIMAL.fullmatch(logical)
            # Decimals of one scale are read as the widest of them, however they are stored.
            kind = f"decimal {decimal[1]}" if decimal else f"{column.physical_type} {logical}"
            empty = logical.startswith("Null") or all(
                without_value(footer.row_group(g).column(i)) for g in range(footer.num_row_groups)
            )
            out.append([column.path, f"{kind} {column.max_repetition_level}", empty])
        return json.dumps(out)

    def without_value(part) -> bool:
        known = part.is_stats_set and part.statistics.has_null_count
        return known and part.statistics.null_count == part.num_values

    def schemas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str | None, list[str]] = {}
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    schema = described(path)
                except (OSError, pa.ArrowException, ImportError):
                    schema = None  # only Spark's readers can open it
                found.setdefault(schema, []).append(path)
        columns = [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["schema", "files"])

    return schemas


def _fits(group: FileGroup, columns: dict[str, str]) -> bool:
    """Whether no column has another type in the group, nor is nested in one and plain in the other."""
    if any(group.columns.get(path, kind) != kind for path, kind in columns.items()):
        return False
    own, other = _shapes(group.columns), _shapes(columns)
    return all(own.get(name, shape) == shape for name, shape in other.items())


# How the format names the level below a list or a map.
_REPEATED = ("list", "key_value", "bag")


def _shapes(columns: dict[str, str]) -> dict[str, str]:
    """Top-level column to whether it is plain, a list, a map or a structure."""
    found = {}
    for path, kind in columns.items():
        name, _, rest = path.partition(".")
        inner = rest.partition(".")[0]
        repeated = inner in _REPEATED and not kind.endswith(" 0")
        found[name] = inner if repeated else "structure" if rest else "plain"
    return found


def file_groups(files: DataFrame) -> list[FileGroup] | None:
    """Groups of files (column `path`) whose schemas agree, in the order of their first files.

    None if tasks cannot open some file themselves. One job, whatever the number of files.
    """
    rows = files.select("path").mapInArrow(_footer_reader(), "schema string, files array<string>").collect()
    found: dict[str | None, list[str]] = {}
    for row in rows:
        found.setdefault(row["schema"], []).extend(row["files"])
    if None in found:
        return None
    groups: list[FileGroup] = []
    for files_of, schema in sorted((sorted(names), schema) for schema, names in found.items()):
        leaves = json.loads(schema)
        columns = {path: kind for path, kind, _ in leaves}
        names = {path.partition(".")[0] for path in columns}
        typed = {path.partition(".")[0] for path, _, empty in leaves if not empty}
        group = next((g for g in groups if _fits(g, columns)), None)
        if group is None:
            groups.append(group := FileGroup())
        group.columns.update(columns)
        group.files += files_of
        group.examples.append(files_of[0])
        group.typed |= typed
        group.empty = (group.empty | names) - group.typed
    return groups
