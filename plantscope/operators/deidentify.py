"""De-identification: plan, keyed pseudonyms, replacement, reproducible noise, numeric policies."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantscope.sources.tables import fingerprint

# fixed values: column-name parts that mark a sensitive column
SENSITIVE_PARTS = (
    "barcode", "serial", "serial_number", "sn", "lot", "lot_number",
    "operator", "employee", "name", "email", "phone", "address",
    "part_number", "part_num", "pn", "sku",
)
PSEUDONYM_HEX = 32
MASK = "MASKED"
NEGLIGIBLE_NOISE = 0.01
STRATEGIES = ("hash", "masked", "noise")
_BLOCK = 64


@dataclass(frozen=True)
class Plan:
    """What happens to every column."""

    kept: list[str]
    masked: dict[str, str]  # column -> hash | masked | replace | noise
    excluded: list[str]
    noise: dict[str, float]  # column -> sigma
    warnings: list[str] = field(default_factory=list)

    def table(self, df: DataFrame) -> DataFrame:
        rows = [(c, "keep", self.noise.get(c)) for c in self.kept]
        rows += [(c, s, self.noise.get(c)) for c, s in self.masked.items()]
        rows += [(c, "exclude", None) for c in self.excluded]
        return df.sparkSession.createDataFrame(rows, "column string, strategy string, sigma double")


def is_sensitive_name(name: str) -> bool:
    return any(part in name.lower() for part in SENSITIVE_PARTS)


def make_plan(
    df: DataFrame,
    sensitive: Sequence[str] = (),
    excluded: Sequence[str] = (),
    overrides: dict[str, str] | None = None,
    noise_std: float = 0.0,
    noise_ratio: float = 0.0,
) -> Plan:
    """Text hashes, other sensitive columns are replaced; overrides choose hash, masked or noise."""
    overrides = overrides or {}
    kinds = {f.name: f.dataType for f in df.schema.fields}
    numeric = {c for c, t in kinds.items() if isinstance(t, T.NumericType)}
    hidden = {c for c in df.columns if c in sensitive or is_sensitive_name(c)} - set(excluded)
    warnings, masked = [], {}
    for c in [c for c in df.columns if c in hidden]:
        default = "hash" if isinstance(kinds[c], T.StringType) else "replace"
        wish = overrides.get(c)
        if wish is not None and wish not in STRATEGIES:
            raise ValueError(f"unsupported strategy {wish!r} for column {c!r}")
        if wish == "noise" and c not in numeric:
            warnings.append(f"noise on non-numeric column {c}: {default} applied instead")
            wish = None
        masked[c] = wish or default
    kept = [c for c in df.columns if c not in hidden and c not in excluded]
    wanted = [c for c in [*kept, *masked] if c in numeric and (overrides.get(c) == "noise" or noise_std > 0 or noise_ratio > 0)]
    noise = {}
    if wanted:
        stds = df.agg(*[F.stddev_samp(c).alias(c) for c in wanted]).first()
        for c in wanted:
            std = float(stds[c] or 0.0)
            sigma = noise_std if noise_std > 0 else noise_ratio * std
            noise[c] = sigma
            if sigma <= 0:
                warnings.append(f"noise on {c} has sigma 0: values stay unchanged")
            elif std > 0 and sigma < NEGLIGIBLE_NOISE * std:
                warnings.append(f"noise on {c} is negligible: sigma {sigma:g} against std {std:g}")
    return Plan(kept, masked, [c for c in df.columns if c in excluded], noise, warnings)


def pseudonym(col: Column, key: bytes) -> Column:
    """HMAC-SHA-256 of the text under ``key``, first 32 hex digits, as native hash columns; null is "NULL"."""
    if len(key) > _BLOCK:
        raise ValueError("the key must be at most 64 bytes")
    padded = key.ljust(_BLOCK, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in padded))
    outer = F.lit(bytearray(b ^ 0x5C for b in padded))
    message = col.cast("string").cast("binary")
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)
    return F.when(col.isNull(), "NULL").otherwise(F.substring(digest, 1, PSEUDONYM_HEX))


def gaussian(keys: Sequence[str], name: str, seed: int) -> Column:
    """Standard normal noise from the row key by Box-Muller: the same under any partitioning."""
    unit = lambda salt: (F.pmod(F.xxhash64(*keys, F.lit(name), F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.ln(unit(1))) * F.cos(2 * math.pi * unit(2))


def apply_plan(df: DataFrame, plan: Plan, key: bytes, row_key: Sequence[str], seed: int = 42) -> DataFrame:
    """The de-identified table; excluded columns are gone."""
    out = []
    for c in [*plan.kept, *plan.masked]:
        strategy = plan.masked.get(c, "keep")
        col = F.col(c)
        if strategy == "hash":
            col = pseudonym(col, key)
        elif strategy in ("masked", "replace"):
            col = F.lit(MASK)
        if plan.noise.get(c, 0.0) > 0 and strategy in ("keep", "noise"):
            col = F.col(c).cast("double") + plan.noise[c] * gaussian(row_key, c, seed)
        out.append(col.alias(c))
    return df.select(*out)


def plan_fingerprint(df: DataFrame, plan: Plan, key: bytes, row_key: Sequence[str], seed: int = 42) -> DataFrame:
    """Fingerprint of the exact table ``apply_plan`` returns."""
    return fingerprint(apply_plan(df, plan, key, row_key, seed))


def bucketed(col: Column, width: int = 10) -> Column:
    """Label of the bucket, like 20-30."""
    low = (F.floor(col / width) * width).cast("long")
    return F.concat(low.cast("string"), F.lit("-"), (low + width).cast("string"))


def standardized(col: Column, mean: float, std: float) -> Column:
    if not mean or std <= 0:
        raise ValueError("standardising needs a nonzero mean and a positive standard deviation")
    return (col - mean) / std


def mask_nested(df: DataFrame, keys: Sequence[str] = (), paths: Sequence[str] = ()) -> DataFrame:
    """Replace fields by name or dotted path anywhere inside structs and arrays, driven by the schema."""

    def hidden(name: str, path: str) -> bool:
        return path in paths or any(k in name.lower() for k in keys)

    def walk(col: Column, kind: T.DataType, path: str) -> Column:
        if isinstance(kind, T.StructType):
            fields = []
            for f in kind.fields:
                inner = f"{path}.{f.name}" if path else f.name
                value = F.lit(MASK) if hidden(f.name, inner) else walk(col[f.name], f.dataType, inner)
                fields.append(value.alias(f.name))
            return F.when(col.isNotNull(), F.struct(*fields))
        if isinstance(kind, T.ArrayType):
            return F.transform(col, lambda item: walk(item, kind.elementType, path))
        return col

    return df.select(
        *[(F.lit(MASK) if hidden(f.name, f.name) else walk(F.col(f.name), f.dataType, f.name)).alias(f.name) for f in df.schema.fields]
    )
