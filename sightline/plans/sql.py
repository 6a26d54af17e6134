"""SQL that DuckDB runs beside the queries: the derived views as common table expressions, and formulas as text."""

from __future__ import annotations

import re

from sightline.schema import ENTITIES
from sightline.sources.fixtures import VIEWS

PI = "pi()"


def oracle(text: str, **more: str) -> str:
    """`text` under WITH: the views that it, or those it needs, name; `more` come after them."""
    text = text.strip()
    needed = " ".join([text, *more.values()])
    views = {n: v for n, v in VIEWS.items() if re.search(rf"\b{n}\b", needed)} | more
    return f"with {', '.join(f'{n} as ({v})' for n, v in views.items())} {text}" if views else text


def star(table: str, prefix: str = "", *skip: str) -> str:
    """The columns of an entity, times as text."""
    kinds = [(f.name, f.dataType.typeName()) for f in ENTITIES[table] if f.name not in skip]
    return ", ".join(f"{stamp(prefix + n)} as {n}" if k == "timestamp_ntz" else f"{prefix}{n} as {n}" for n, k in kinds)


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def r(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + cast(0 as double))"


def bearing(a: str, b: str, c: str, d: str) -> str:
    return (
        f"degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), "
        f"cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b}))))"
    )


def distance(a: str, b: str, c: str, d: str) -> str:
    return f"cast(2 * 6371000 as double) * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))"


def tangent_x(lng: str, cam_lat: str, cam_lng: str) -> str:
    return f"({lng} - {cam_lng}) * cast(111320 as double) * cos(radians({cam_lat}))"


def tangent_z(lat: str, cam_lat: str) -> str:
    return f"-({lat} - {cam_lat}) * cast(111320 as double)"


def wrap(a: str) -> str:
    return f"((({a}) + {PI}) - 2 * {PI} * floor((({a}) + {PI}) / (2 * {PI})) - {PI})"


def ray(u: str = "u", v: str = "v", p: str = "") -> tuple[str, str, str]:
    """x, y, z of a photo point's ray: the photo's centre and its two axes, in world coordinates."""
    az, t, ro, s, asp = (p + c for c in ("photo_az", "photo_tilt", "photo_roll", "size_rad", "aspect"))
    dx, dy = f"(({u} - 0.5::double) * 2 * tan({s} / 2))", f"(({v} - 0.5::double) * 2 * tan({s} / 2) / {asp})"
    right = f"({dx} * cos({ro}) - {dy} * sin({ro}))"
    up = f"({dx} * sin({ro}) + {dy} * cos({ro}))"
    x = f"(-cos({t}) * sin({az}) + {right} * cos({az}) + {up} * sin({t}) * sin({az}))"
    y = f"(sin({t}) + {up} * cos({t}))"
    z = f"(-cos({t}) * cos({az}) - {right} * sin({az}) + {up} * sin({t}) * cos({az}))"
    return x, y, z


def seen_az(u: str = "u", v: str = "v", p: str = "") -> str:
    x, _, z = ray(u, v, p)
    return f"atan2(-{x}, -{z})"


def seen_el(u: str = "u", v: str = "v", p: str = "") -> str:
    x, y, z = ray(u, v, p)
    return f"asin({y} / sqrt({x} * {x} + {y} * {y} + {z} * {z}))"


def tile_x(lng: str, z: str) -> str:
    return f"(({lng} + 180) / 360 * pow(2, {z}))"


def tile_y(lat: str, z: str) -> str:
    return f"((0.5::double - ln((1 + sin(radians({lat}))) / (1 - sin(radians({lat})))) / (4 * {PI})) * pow(2, {z}))"


def tile_lat(y: str, z: str) -> str:
    n = f"({PI} - 2 * {PI} * ({y}) / pow(2, {z}))"
    return f"degrees(atan((exp({n}) - exp(-{n})) / 2))"


def tile_lng(x: str, z: str) -> str:
    return f"(({x}) / pow(2, {z}) * 360 - 180)"
