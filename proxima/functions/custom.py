"""Encoders of the user's own (UDF-1): a name is registered with a function that turns the
value column into the feature's vector column.

    custom.register("latlon", length=3, encode=lambda value, spec: F.array(...))

The function gets the value Column and the ``EncoderSpec`` and returns an
``array<double>`` Column of ``length`` numbers; null or a wrong shape rejects the row.
Built-in expressions stay on the JVM side; an Arrow function works as well.  A schema
names the encoder by ``type``; loading a saved schema needs the same registration.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from .encoders import valid_vector


@dataclass(frozen=True)
class CustomEncoder:
    length: int
    encode: Callable[[Column, object], Column]


_REGISTRY: dict[str, CustomEncoder] = {}


def register(name: str, length: int, encode: Callable[[Column, object], Column]) -> None:
    _REGISTRY[name] = CustomEncoder(int(length), encode)


def registered(name: str) -> CustomEncoder | None:
    return _REGISTRY.get(name)


def code(e, value: Column) -> Column:
    return _REGISTRY[e.custom].encode(value, e).cast("array<double>")


def bad(e, vector: Column) -> Column:
    return ~valid_vector(vector, e.length)
