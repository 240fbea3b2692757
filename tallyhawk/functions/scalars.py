"""Scalar functions for rules, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fmt(template: str, *args: Column) -> Column:
    """``template`` with each ``{}`` replaced by the next argument as text; a null argument gives nothing."""
    parts = template.split("{}")
    if len(parts) != len(args) + 1:
        raise ValueError(f"{len(parts) - 1} places for {len(args)} arguments")
    out = [F.lit(parts[0])]
    for arg, text in zip(args, parts[1:], strict=True):
        out += [F.coalesce(arg.cast("string"), F.lit("")), F.lit(text)]
    return F.concat(*out)


def is_blank(x: Column) -> Column:
    return x.isNull() | (F.trim(x) == "")


def null_if_blank(x: Column) -> Column:
    return F.when(~is_blank(x), x)


def default_if_blank(x: Column, default: Column) -> Column:
    return F.when(is_blank(x), default).otherwise(x)


def hex_text(x: Column) -> Column:
    """Lower-case hexadecimal digits of a number or of a text's bytes."""
    return F.lower(F.hex(x))


_TAGS = {"string": "s", "bigint": "i", "int": "i", "double": "f", "boolean": "b"}


def stable_id(*parts: tuple[Column, str]) -> Column:
    """SHA-256 of (value, type) parts, each with its type and length in front, so ("ab", "c") and ("a", "bc") differ.

    A null part counts as a part of its own kind.
    """
    coded = [
        F.coalesce(F.concat(F.lit(_TAGS[kind] + ":"), F.octet_length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")), F.lit("n:0:"))
        for x, kind in parts
    ]
    return F.sha2(F.concat(*coded), 256)


def now(unit: str = "ts") -> Column:
    """The time of the query or micro-batch, one value for all its rows."""
    t = F.current_timestamp()
    return {
        "ts": t, "s": F.unix_seconds(t), "ms": F.unix_millis(t), "us": F.unix_micros(t), "ns": F.unix_micros(t) * 1000,
    }[unit]


def json_object(**fields: Column) -> Column:
    """A JSON object in the order given; null fields are left out."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def json_array(*items: Column) -> Column:
    return F.to_json(F.array(*items))


def merge(*maps: Column) -> Column:
    """Maps joined key by key, later ones winning; a null map counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    out = F.coalesce(maps[0], empty)
    for m in maps[1:]:
        right = F.coalesce(m, empty)
        out = F.map_concat(_without(out, F.map_keys(right)), right)
    return out


def _without(m: Column, keys: Column) -> Column:
    return F.map_filter(m, lambda k, _: ~F.array_contains(keys, k))


def is_internal(ip: Column) -> Column:
    """Is a dotted IPv4 address in a private range (10/8, 172.16/12, 192.168/16)? Null or malformed: false."""
    octet = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
    private = rf"^(?:10\.{octet}|172\.(?:1[6-9]|2\d|3[01])|192\.168)\.{octet}\.{octet}$"
    return F.coalesce(ip.rlike(private), F.lit(False))


def regex_any(x: Column, patterns: list[str]) -> Column:
    """Does any pattern occur in the text? All of them go through one alternation; a null text does not match."""
    return F.coalesce(x.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))
