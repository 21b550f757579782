"""Declarative similarity schema: hard filters, weighted feature encoders, metric.

The schema is small driver-side configuration.  Everything that touches data is a
Column expression or a DataFrame operator built from it (see ``proxima.functions``
and ``proxima.operators``).  Schemas are immutable; variants (re-weighted copies of
the base weights) are new ``Strategy`` entries of the same schema, so one coded
index serves every variant.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace
from typing import Any, Mapping, Sequence

# --- fixed values -------------------------------------------------------------
# Encoder type names and their accepted aliases (must match the reference's
# accepted spellings so existing schema documents keep working).
ENCODER_ALIASES = {
    "onehot": ["onehot", "one_hot", "one hot", "oh"],
    "strict_onehot": ["strictonehot", "strict_one_hot", "strict one hot", "soh"],
    "numeric": ["num", "numeric"],
    "ordinal": ["ordinal", "ordered"],
    "bin": ["bin", "binning"],
    "bin_ordinal": ["binordinal", "bin_ordinal", "bin ordinal", "ord bin"],
    "hierarchy": ["hier", "hierarchy", "nested"],
    "embedding": ["numpy", "np", "embedding"],
    "json": ["JSON", "json", "js"],
    "feature_table": ["feature_table"],
}
METRICS = ["l2", "ip", "cosine"]
DEFAULT_METRIC = "ip"
DEFAULT_SIMILARITY_BY_DEPTH = [1, 0.5, 0]
ALL_PARTITION = "ALL"
# -----------------------------------------------------------------------------

_ALIAS_TO_TYPE = {alias: canon for canon, aliases in ENCODER_ALIASES.items() for alias in aliases}

CODED_TYPES = {"onehot", "strict_onehot", "ordinal", "bin", "bin_ordinal", "hierarchy"}
SCALAR_TYPES = {"numeric"}
VECTOR_TYPES = {"embedding", "json", "feature_table", "custom"}


def canonical_type(name: str) -> str:
    try:
        return _ALIAS_TO_TYPE[name]
    except KeyError:
        from .functions import custom
        if custom.registered(name) is not None:
            return "custom"
        raise TypeError(f"Unknown encoder type {name!r}") from None


@dataclass(frozen=True)
class FilterSpec:
    field: str
    values: tuple

    def to_dict(self):
        return {"field": self.field, "values": list(self.values)}


@dataclass(frozen=True, eq=False)
class EncoderSpec:
    """One weighted feature.

    An embedding encoder without ``table`` reads the vector from the field itself (a dense
    array column); with a table it looks the field's value up by key.

    ``values`` means: the category list (onehot, strict_onehot, ordinal), the sorted bin
    boundaries (bin, bin_ordinal), the nested tree (hierarchy) or the optional id list
    of an embedding matrix.  ``table``/``key``/``vector`` name the lookup table of the
    embedding and feature_table encoders (``entity`` is the entity column for the latter).
    """

    field: str
    type: str
    weight: float = 1.0
    values: Any = ()
    default: Any = None
    window: tuple = ()
    similarity_by_depth: tuple = tuple(DEFAULT_SIMILARITY_BY_DEPTH)
    length: int = 0
    table: str | None = None
    key: str = "key"
    vector: str = "vector"
    entity: str | None = None
    custom: str | None = None  # registered name of a custom encoder

    @property
    def coded(self) -> bool:
        return self.type in CODED_TYPES

    @property
    def is_vector(self) -> bool:
        return self.type in VECTOR_TYPES

    def to_dict(self):
        d = {"field": self.field, "type": self.custom or self.type, "weight": self.weight, "default": self.default}
        if self.type == "hierarchy":
            d["values"] = self.values
            d["similarity_by_depth"] = list(self.similarity_by_depth)
        else:
            d["values"] = list(self.values) if self.values is not None else []
        if self.type in ("ordinal", "bin_ordinal"):
            d["window"] = list(self.window)
        if self.type in VECTOR_TYPES:
            d.update(length=self.length, table=self.table, key=self.key, vector=self.vector)
        if self.type == "feature_table":
            d["entity"] = self.entity
        return d

    @staticmethod
    def from_dict(d: Mapping) -> "EncoderSpec":
        t = canonical_type(d["type"])
        values = d.get("values", ())
        if t != "hierarchy":
            values = tuple(values) if values is not None else ()
        spec = EncoderSpec(
            field=d["field"],
            type=t,
            weight=float(d.get("weight", 1.0)),
            values=values,
            default=d.get("default"),
            window=tuple(d.get("window", ()) or ()),
            similarity_by_depth=tuple(d.get("similarity_by_depth", DEFAULT_SIMILARITY_BY_DEPTH)),
            length=int(d.get("length", 0) or 0),
            table=d.get("table", d.get("npy")),
            key=d.get("key", "key"),
            vector=d.get("vector", "vector"),
            entity=d.get("entity"),
            custom=d["type"] if t == "custom" else None,
        )
        if t == "custom":
            from .functions import custom
            spec = replace(spec, length=custom.registered(d["type"]).length)
        spec.validate()
        return spec

    def validate(self):
        if self.type in ("ordinal", "bin_ordinal"):
            if len(self.window) % 2 != 1:
                raise ValueError(f"Window size should be odd: window: {list(self.window)} ({self.field})")
        if self.type in ("bin", "bin_ordinal"):
            b = [float(x) for x in self.values]
            if b != sorted(b):
                raise ValueError(f"bin boundaries of {self.field} must be sorted")
        if self.type in ("json", "feature_table") and self.length <= 0:
            raise ValueError(f"{self.field}: json/feature_table encoders need a positive length")
        if self.type == "embedding" and self.length <= 0:
            raise ValueError(f"{self.field}: embedding encoders need a length")
        if self.type == "feature_table" and (self.table is None or not self.entity):
            raise ValueError(f"{self.field}: feature_table encoders need a table and an entity column")


@dataclass(frozen=True)
class Strategy:
    """A weight set.  The base strategy uses the encoders' own weights; a variant
    overrides some of them (A/B testing)."""

    id: str
    name: str = "default"
    is_base: bool = False
    weights: tuple = ()  # ((field, weight), ...) overrides

    def to_dict(self):
        return {"id": self.id, "name": self.name, "is_base": self.is_base, "weights": dict(self.weights)}


@dataclass(frozen=True)
class Schema:
    encoders: tuple
    filters: tuple = ()
    metric: str = DEFAULT_METRIC
    id_col: str = "id"
    user_encoders: tuple = ()
    index_factory: str = "Flat"
    strategies: tuple = (Strategy("0", "default", True),)

    # ------------------------------------------------------------------ build
    @staticmethod
    def build(encoders: Sequence[Mapping], filters: Sequence[Mapping] = (), metric: str = DEFAULT_METRIC,
              id_col: str = "id", user_encoders: Sequence[Mapping] = (), index_factory: str = "Flat",
              strategies: Sequence[Mapping] | None = None) -> "Schema":
        if metric not in METRICS:
            raise TypeError(f"{metric} is not supported")
        encs = tuple(EncoderSpec.from_dict(e) for e in encoders)
        names = [e.field for e in encs]
        if len(set(names)) != len(names):
            raise ValueError("duplicate encoder field")
        filts = tuple(FilterSpec(f["field"], tuple(f["values"])) for f in filters if f)
        uencs = tuple(EncoderSpec.from_dict(e) for e in user_encoders)
        for u in uencs:
            if u.field not in names:
                raise ValueError(f"user encoder {u.field} has no item encoder")
        if strategies is None:
            strats = (Strategy("0", "default", True),)
        else:
            strats = tuple(Strategy(str(s["id"]), s.get("name", str(s["id"])), bool(s.get("is_base", False)),
                                    tuple((k, float(v)) for k, v in (s.get("weights") or {}).items()))
                           for s in strategies)
            if sum(s.is_base for s in strats) != 1:
                raise ValueError("exactly one base strategy is required")
        return Schema(encs, filts, metric, id_col, uencs, index_factory, strats)

    # ------------------------------------------------------------ accessors
    @property
    def filter_fields(self) -> list[str]:
        return [f.field for f in self.filters]

    @property
    def features(self) -> list[str]:
        return [e.field for e in self.encoders]

    def encoder(self, field_name: str) -> EncoderSpec:
        for e in self.encoders:
            if e.field == field_name:
                return e
        raise KeyError(field_name)

    def user_encoder(self, field_name: str) -> EncoderSpec | None:
        for e in self.user_encoders:
            if e.field == field_name:
                return e
        return None

    @property
    def base_strategy_id(self) -> str:
        return next(s.id for s in self.strategies if s.is_base)

    def strategy(self, strategy_id: str | None = None) -> Strategy:
        sid = self.base_strategy_id if strategy_id is None else str(strategy_id)
        for s in self.strategies:
            if s.id == sid:
                return s
        raise KeyError(f"unknown strategy {strategy_id}")

    def weights(self, strategy_id: str | None = None, override: Mapping | Sequence | None = None) -> dict:
        """Feature weights of a strategy (ENC-15: ``override`` replaces them)."""
        w = {e.field: e.weight for e in self.encoders}
        w.update(dict(self.strategy(strategy_id).weights))
        if override is not None:
            if isinstance(override, Mapping):
                w.update({k: float(v) for k, v in override.items()})
            else:
                if len(override) != len(self.encoders):
                    raise ValueError(f"Invalid number of weight vector {len(override)}")
                w = {e.field: float(v) for e, v in zip(self.encoders, override)}
        return w

    def with_variant(self, variant_id, name: str, weights: Mapping) -> "Schema":
        """ENC-18: a new immutable schema with one more (re-weighted) strategy."""
        vid = str(variant_id)
        if any(s.id == vid for s in self.strategies):
            raise ValueError(f"strategy {vid} exists")
        for k in weights:
            self.encoder(k)
        v = Strategy(vid, name, False, tuple((k, float(x)) for k, x in weights.items()))
        return replace(self, strategies=self.strategies + (v,))

    def variant_description(self, variant_id) -> dict:
        w = self.weights(variant_id)
        encs = []
        for e in self.encoders:
            d = e.to_dict()
            d["weight"] = w[e.field]
            encs.append(d)
        s = self.strategy(variant_id)
        return {"id": s.id, "name": s.name, "encoders": encs}

    # ----------------------------------------------------------- partitions
    @property
    def partitions(self) -> list[tuple]:
        """Declared partitions: the product of the filter values (FLT-1/FLT-4)."""
        if not self.filters:
            return [(ALL_PARTITION,)]
        out = [()]
        for f in self.filters:
            out = [p + (v,) for p in out for v in f.values]
        return out

    # ---------------------------------------------------------------- sizes
    def length(self, field_name: str) -> int:
        from .functions.blocks import encoder_length
        return encoder_length(self.encoder(field_name))

    def sizes(self) -> dict:
        return {e.field: self.length(e.field) for e in self.encoders}

    def offsets(self, strategy_id: str | None = None) -> dict:
        """(start, end) of each non-zero-weight feature in the vector (D8: real prefix sums)."""
        w = self.weights(strategy_id)
        out, start = {}, 0
        for e in self.encoders:
            if w[e.field] == 0:
                continue
            n = self.length(e.field)
            out[e.field] = (start, start + n)
            start += n
        return out

    def dim(self, strategy_id: str | None = None) -> int:
        return sum(b - a for a, b in self.offsets(strategy_id).values())

    def factor(self, field_name: str, strategy_id: str | None = None, override=None) -> float:
        """weight / sqrt(nonzero elements): the scale of the feature's block (ENC-12)."""
        from .functions.blocks import nonzero_elements
        e = self.encoder(field_name)
        return self.weights(strategy_id, override)[field_name] / math.sqrt(nonzero_elements(e))

    # ----------------------------------------------------------------- json
    def to_dict(self) -> dict:
        return {
            "encoders": [e.to_dict() for e in self.encoders],
            "filters": [f.to_dict() for f in self.filters],
            "metric": self.metric,
            "id_col": self.id_col,
            "user_encoders": [e.to_dict() for e in self.user_encoders],
            "index_factory": self.index_factory,
            "strategies": [s.to_dict() for s in self.strategies],
        }

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)

    @staticmethod
    def from_dict(d: Mapping) -> "Schema":
        return Schema.build(d["encoders"], d.get("filters", ()), d.get("metric", DEFAULT_METRIC),
                            d.get("id_col", "id"), d.get("user_encoders", ()), d.get("index_factory", "Flat"),
                            d.get("strategies"))

    @staticmethod
    def from_json(s: str) -> "Schema":
        return Schema.from_dict(json.loads(s))
