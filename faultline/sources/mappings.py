"""Declared layouts of foreign log records: where each field of an event stands in them.

A mapped record becomes a document of the library's own layout before it is checked, so validation, identity,
redaction and credential rules are those of every other record.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline import fixed_values as fv
from faultline.functions import documents as doc


@dataclass(frozen=True)
class RecordLayout:
    """``paths``: JSON paths of each field, the first present one that is not null counts.

    ``renamed``: texts of a field that are read as others. ``defaults``: a field's text where no path has a value.
    ``last_segment``: fields of which only what follows the last slash is kept. ``metadata``: paths of objects whose
    other keys become metadata; where two have a key, the earlier one counts. A key that is the name of an event's
    field is left out there, so that it cannot stand in for the field.
    """

    paths: Mapping[str, tuple[str, ...]]
    renamed: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    defaults: Mapping[str, str] = field(default_factory=dict)
    last_segment: tuple[str, ...] = ()
    metadata: tuple[str, ...] = ()

    def read(self, document: Column) -> Column:
        """Struct of all that the layout names, in one walk over the record; other paths than of plain names by themselves."""
        walk, alone = self._plan()
        return F.struct(
            F.try_variant_get(document, "$", _type_of(walk)).alias("walk"),
            *[F.try_variant_get(document, path, "variant").alias(f"alone_{at}") for at, path in enumerate(alone)])

    def found(self, read: Column) -> Column:
        """Struct of the values that are tested before they are taken over, as they stand in the record."""
        tested = [name for name in self.paths if name in self.renamed or name in self.last_segment]
        return F.struct(F.lit(None).cast(_VALUE).alias("_none"), *[self._value(read, name).alias(name) for name in tested])

    def fields(self, read: Column, found: Column) -> Column:
        """Map of the fields' values, keyed by constants."""
        names = list(self.paths)
        return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[self._field(read, found, name) for name in names]))

    def document(self, read: Column, fields: Column) -> Column:
        """The record in the library's own layout: its fields that have a value, and metadata beside them."""
        present = F.map_filter(fields, lambda _, value: value.isNotNull())
        return F.to_variant_object(F.map_concat(present, *[self._others(read, at) for at in range(len(self.metadata))]))

    def _plan(self) -> tuple[dict, list[str]]:
        """Paths of plain names as a tree, whose leaves are a value or a whole object (for metadata), and the other paths."""
        walk: dict = {}
        alone: list[str] = []
        objects = [path for path in self.metadata if _PLAIN_PATH.fullmatch(path)]
        for path in dict.fromkeys((*objects, *(path for paths in self.paths.values() for path in paths))):
            *outer, last = path.split(".")[1:] or [""]
            if path not in objects and ".".join(["$", *outer]) in objects and _PLAIN_PATH.fullmatch(path):
                continue
            level = walk if _PLAIN_PATH.fullmatch(path) else None
            for name in outer:
                level = _entered(level, name)
            if level is None or any(last.lower() == name.lower() for name in level):
                alone.append(path)
            else:
                level[last] = _OBJECT if path in objects else _VALUE
        return walk, alone

    def _at(self, read: Column, path: str) -> Column:
        """The value at one of the paths, out of what was read."""
        walk, alone = self._plan()
        if path in alone:
            return read[f"alone_{alone.index(path)}"]
        value, level = read["walk"], walk
        for name in path.split(".")[1:]:
            value = F.try_element_at(value, F.lit(name)) if level == _OBJECT else value[name]
            level = level[name] if isinstance(level, dict) else _VALUE
        return value

    def _value(self, read: Column, name: str) -> Column:
        # JSON null counts as absent
        return F.coalesce(*[F.when(~F.is_variant_null(value), value) for value in (self._at(read, path) for path in self.paths[name])])

    def _field(self, read: Column, found: Column, name: str) -> Column:
        tested = name in self.renamed or name in self.last_segment
        value = found[name] if tested else self._value(read, name)
        plain = doc.plain_text(value)
        if name in self.last_segment:
            value = F.when(doc.is_string(value, plain), F.substring_index(plain, "/", -1).cast("variant")).otherwise(value)
        for old, new in self.renamed.get(name, {}).items():
            value = F.when(plain == old, F.lit(new).cast("variant")).otherwise(value)
        if name in self.defaults:
            value = F.coalesce(value, F.lit(self.defaults[name]).cast("variant"))
        return value

    def _taken(self, path: str) -> list[str]:
        """Keys of an object that a field is read from."""
        return [where.removeprefix(f"{path}.") for paths in self.paths.values() for where in paths if where.startswith(f"{path}.")]

    def _object(self, read: Column, path: str) -> Column:
        value = self._at(read, path)
        return doc.object_fields(value) if path in self._plan()[1] else value

    def _others(self, read: Column, at: int) -> Column:
        """What an object holds beside fields, names of fields, and keys that are metadata of an earlier object."""
        path, earlier = self.metadata[at], self.metadata[:at]
        own = dict.fromkeys((*self._taken(path), *self.paths, *fv.NAMED_FIELDS, "insertId"))

        def is_free(key: Column, _: Column) -> Column:
            free = ~key.isin(*own)
            for other in earlier:
                there = F.coalesce(F.map_contains_key(self._object(read, other), key), F.lit(False))
                taken = self._taken(other)
                free &= ~(there & ~key.isin(*taken) if taken else there)
            return free

        return F.coalesce(F.map_filter(self._object(read, path), is_free), F.create_map().cast(_OBJECT))


_PLAIN_PATH = re.compile(r"\$(\.\w+)+")
_VALUE, _OBJECT = "variant", "map<string,variant>"


def _entered(level: dict | None, name: str) -> dict | None:
    """The tree below ``name``, made if need be; None where something else is read at that place."""
    if level is None or any(name.lower() == other.lower() and name != other for other in level):
        return None
    below = level.setdefault(name, {})
    return below if isinstance(below, dict) else None


def _type_of(tree: dict | str) -> str:
    if isinstance(tree, str):
        return tree
    return "struct<" + ", ".join(f"`{name}`: {_type_of(below)}" for name, below in tree.items()) + ">"


# Layout of a cloud provider's log entries. Fixed values.
CLOUD_ENTRY = RecordLayout(
    paths={
        "event_id": ("$.insertId",),
        "timestamp": ("$.timestamp", "$.receiveTimestamp"),
        "severity": ("$.severity",),
        "service": ("$.resource.labels.service_name", "$.resource.labels.container_name", "$.labels.service"),
        "environment": ("$.labels.environment", "$.jsonPayload.environment"),
        "version": ("$.resource.labels.revision_name", "$.labels.version"),
        "message": ("$.jsonPayload.message", "$.textPayload"),
        "error_type": ("$.jsonPayload.error_type",),
        "error_message": ("$.jsonPayload.error_message",),
        "stack_trace": ("$.jsonPayload.stack_trace",),
        "request_id": ("$.jsonPayload.request_id", "$.labels.request_id"),
        "trace_id": ("$.trace",),
        "span_id": ("$.spanId",),
        "endpoint": ("$.jsonPayload.endpoint", "$.httpRequest.requestUrl"),
        "http_status": ("$.jsonPayload.http_status", "$.httpRequest.status"),
    },
    renamed={"severity": {"DEFAULT": "INFO", "NOTICE": "INFO", "ALERT": "CRITICAL", "EMERGENCY": "CRITICAL"}},
    defaults={"severity": "INFO"},
    last_segment=("trace_id",),
    metadata=("$.jsonPayload", "$.labels", "$.resource.labels"),
)
