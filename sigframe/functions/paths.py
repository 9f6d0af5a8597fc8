"""Path and name expressions.  All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigframe.constants import CLASS_CODES, COARSE_CLIP_STEPS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _components(path: Column) -> Column:
    """Components of a path without empty and ``.`` entries."""
    return F.filter(F.split(path, "/"), lambda part: (part != "") & (part != "."))


def path_part(path: Column | str, i: int) -> Column:
    """``i``-th path component, null beyond the end; an absolute path has ``/`` first."""
    path = _col(path)
    parts = _components(path)
    absolute = F.lit("/") if i == 0 else F.get(parts, F.lit(i - 1))
    return F.when(path.startswith("/"), absolute).otherwise(F.get(parts, F.lit(i)))


def parent_name(path: Column | str) -> Column:
    """Name of the directory a file lies in, null when the path has none."""
    return F.try_element_at(_components(_col(path)), F.lit(-2))


def class_after_marker(
    path: Column | str, marker: str = "train_audio/", strict: bool = False
) -> Column:
    """Text between the first ``marker`` and the next ``/``.

    A path without the marker gives null, or raises if ``strict``, as labels for
    training should be.
    """
    path = _col(path)
    rest = F.split_part(path, F.lit(marker), F.lit(2))
    found = F.when(path.contains(marker), F.split_part(rest, F.lit("/"), F.lit(1)))
    if not strict:
        return found
    failure = F.raise_error(F.concat(F.lit(f"no {marker} in "), F.coalesce(path, F.lit("a null path"))))
    return found.otherwise(failure.cast("string"))


def relative_path(path: Column | str, root: str) -> Column:
    """``path`` without a leading ``root``; paths outside the root stay as they are."""
    path = _col(path)
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def concat_path(root: str, *parts: Column | str) -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), *[_col(p) for p in parts])


def stem(path: Column | str, ext: str = ".ogg") -> Column:
    """Last path component without the extension ``ext``."""
    name = F.element_at(F.split(_col(path), "/"), -1)
    return F.when(
        name.endswith(ext), F.substr(name, F.lit(1), F.length(name) - len(ext))
    ).otherwise(name)


def row_id(file: Column | str, end_time: Column | str, ext: str = ".ogg") -> Column:
    """``<stem>_<end second>``, the end time cut towards zero."""
    return F.concat(stem(file, ext), F.lit("_"), _col(end_time).cast("int").cast("string"))


def part_name(part: Column | str) -> Column:
    return F.format_string("part_%04d", _col(part).cast("int"))


def has_letter(name: Column | str) -> Column:
    return _col(name).rlike(r"\p{L}")


def clip_step_for(window: Column | str) -> Column:
    """Step between clips for a model window; coarse windows step by one second."""
    window = _col(window)
    return F.when(window.isin(COARSE_CLIP_STEPS), F.lit(1.0)).otherwise(window)


def code_for(name: Column | str, mapping: dict[str, int] | None = None) -> Column:
    """Integer code of a class name, null for names the mapping lacks."""
    pairs = [F.lit(x) for kv in (mapping or CLASS_CODES).items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), _col(name))
