"""Columns from labels, names and places. All are built-in expressions; a null stays null unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has_keyword(label: Column, words: list[str]) -> Column:
    """Whether any word is part of the label; false for null, empty and 'Unknown'."""
    found = F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(F.lower(label), F.lower(w)))
    return F.coalesce(found & ~label.isin("", "Unknown"), F.lit(False))


def first_rule(rules: list[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first rule that holds; a null condition doesn't hold."""
    out = F.lit(default)
    for condition, value in reversed(rules):
        out = F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def last_write(writes: list[tuple[Column, object]], default: Column) -> Column:
    """What a column holds after successive conditional overwrites: the last that holds."""
    return first_rule(writes[::-1], default)


def region_and_side(tag: Column) -> tuple[Column, Column]:
    """`roi(L)` as (roi, L), trimmed; a tag without a side is a region with a null side."""
    pattern = r"^(.*)\((L|R)\)$"
    roi, side = F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2)
    return F.trim(F.coalesce(F.nullif(roi, F.lit("")), tag)), F.nullif(side, F.lit(""))


def subject_id(code: Column) -> Column:
    """D0096 as D96."""
    return F.regexp_replace(code, "^([A-Z])0+", "$1")


def subject_number(code: Column) -> Column:
    """D0096 as D96 by the number behind the first character: D0000 is D0; null where there is no number."""
    return F.concat(F.substring(code, 1, 1), F.substring(code, F.lit(2), F.length(code)).try_cast("int").cast("string"))


def subject_replaced(code: Column, fronts: tuple[str, ...] = ("D00", "D0")) -> Column:
    """The fronts, one after another, replaced by D wherever they stand: D0096 is D96, and so is the D0096 in D0096_ROG1."""
    for front in fronts:
        code = F.replace(code, F.lit(front), F.lit("D"))
    return code


def contact_pair(name: Column) -> tuple[Column, Column]:
    """PRE1-2 as (PRE1, PRE2); another name stands for both."""
    part = lambda i: F.regexp_extract(name, r"^(.+?)(\d+)-(\d+)$", i)
    found = F.rlike(name, F.lit(r"^(.+?)(\d+)-(\d+)$"))
    return F.when(found, F.concat(part(1), part(2))).otherwise(name), F.when(found, F.concat(part(1), part(3))).otherwise(name)


def without_last(name: Column) -> tuple[Column, Column]:
    """(all but the last character, the last character)."""
    return F.substring(name, F.lit(1), F.length(name) - 1), F.right(name, F.lit(1))


def gross_region(label: Column, names: dict[str, str]) -> Column:
    """What stands behind the last underscore, by the map, else itself, without spaces."""
    fine = F.substring_index(label, "_", -1)
    pairs = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.replace(F.coalesce(pairs[fine], fine), F.lit(" "), F.lit(""))


def short_label(label: Column, prefix: str, most: int = 20, kept: int = 18) -> Column:
    """Without the prefix, underscores as spaces, and cut where over `most` characters."""
    out = F.replace(F.regexp_replace(label, f"^{prefix}", ""), F.lit("_"), F.lit(" "))
    return F.when(F.length(out) > most, F.substring(out, 1, kept)).otherwise(out)


def millimetres(places: list[Column], below: float = 10.0) -> list[Column]:
    """Places of one row in millimetres: those whose largest distance from 0 is below the limit are metres."""
    metres = F.greatest(*(F.abs(p) for p in places)) < below
    return [F.when(metres, p * 1000).otherwise(p) for p in places]


def millimetres_by_set(df: DataFrame, keys: list[str], places: tuple[str, str, str] = ("x", "y", "z"), below: float = 1.0) -> DataFrame:
    """`df` with the places of each set (all rows of a key) in millimetres: a set whose largest distance from 0 is below the limit is in metres. Sets without a place stay."""
    far = df.groupBy(*keys).agg(F.max(F.greatest(*(F.abs(c) for c in places))).alias("__far"))
    both = df.join(far.withColumnsRenamed({k: f"__k{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"__k{k}")) for k in keys])
    return both.withColumns({c: F.when(F.col("__far") < below, F.col(c) * 1000).otherwise(F.col(c)) for c in places}).select(*df.columns)


def voxel(place: Column, offset: float, size: int, flip: bool = False) -> tuple[Column, Column]:
    """Voxel index of a place (half to even) and the same within bounds."""
    index = F.rint(F.lit(offset) - place if flip else place + offset).cast("int")
    return index, F.greatest(F.lit(0), F.least(index, F.lit(size - 1)))


def transformed(df: DataFrame, matrices: DataFrame, key: str, places: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Points moved by the affine matrix of their key (rows m00 to m23); points without one have null places."""
    joined = df.join(matrices, key, "left")
    moved = {c: sum((F.col(f"m{i}{j}") * F.col(p) for j, p in enumerate(places)), F.col(f"m{i}3")) for i, c in enumerate(places)}
    return joined.withColumns(moved).select(*df.columns)


def percent(part: Column, whole: Column) -> Column:
    """Rounded half to even."""
    return F.rint(part / whole * 100).cast("int")


def noise(*key: Column) -> Column:
    """Standard normal number that hangs on the key alone: Box-Muller over two slices of its md5."""
    h = F.md5(F.concat_ws("|", *(k.cast("string") for k in key)))
    u = lambda at: (F.conv(F.substring(h, at, 8), 16, 10).cast("long") + 1).cast("double") / 4294967297.0
    return F.sqrt(-2 * F.log(u(1))) * F.cos(2 * F.pi() * u(9))


def uniform(*key: Column) -> Column:
    """Number in [0, 1) that hangs on the key alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(k.cast("string") for k in key))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
