"""Path, template and URL name functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*?)/+[^/]*\z", 1)


def extension(path: Column) -> Column:
    """The last suffix of the name with its dot; empty when there is none or when the name ends in a dot."""
    return F.regexp_extract(base_name(path), r"(?s)(\.[^.]+)\z", 1)


def file_base(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?s)\.[^.]*\z", "")


def relative_path(path: Column, base: str) -> Column:
    """The path as seen from the folder ``base``; an absolute path elsewhere climbs with ``..``.

    The base itself is compared without case, the folders above it with case.
    """
    folders = [f for f in base.split("/") if f]
    prefix = base.rstrip("/") + "/"
    out = F.when(F.lower(path).startswith(F.lit(prefix.lower())), F.substring(path, len(prefix) + 1, 2147483647))
    if base.startswith("/"):
        for shared in range(len(folders) - 1, -1, -1):
            above = "/" + "".join(f + "/" for f in folders[:shared])
            climbed = F.concat(F.lit("../" * (len(folders) - shared)), F.substring(path, len(above) + 1, 2147483647))
            out = out.when(path.startswith(F.lit(above)), climbed)
    return out.otherwise(path)


def template_path(path: Column, template: str | Column, timestamp: str | Column, time: str | Column) -> Column:
    """Expand the placeholders of an output template for a file.

    ``timestamp`` (yyyyMMddHHmmss) and ``time`` (milliseconds) are arguments, so a rerun of a task yields
    the same names.
    """
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    values = (
        ("fileName", path),
        ("filePath", directory(path)),
        ("fileBase", file_base(path)),
        ("fileExt", F.substring(extension(path), 2, 2147483647)),
        ("timeStamp", as_col(timestamp)),
    )
    out = as_col(template)
    for name, value in values:
        out = F.replace(out, F.lit("{%s}" % name), value)
        out = F.replace(out, F.lit("{%s}" % name.lower()), value)
    out = F.replace(out, F.lit("{time}"), as_col(time))
    return F.btrim(out, F.lit(" /\\"))


_URL = r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)(?::\d*)?([^?#]*)(\?[^#]*)?"


def url_slug(url: Column) -> Column:
    """Host, path and query of a URL as alphanumeric parts joined by dashes.

    Characters outside ASCII in path and query count as their percent escapes, as in a URL on the wire.
    """
    host = F.lower(F.regexp_extract(url, _URL, 1))
    rest = F.concat(F.regexp_extract(url, _URL, 2), F.regexp_extract(url, _URL, 3))
    dashed = F.regexp_replace(rest, r"[\x00-\x7F&&[^A-Za-z0-9]]+", "-")
    escaped = F.when(dashed.rlike(r"[^\x00-\x7F]"), F.replace(F.url_encode(dashed), F.lit("%"), F.lit("-")))
    whole = F.concat(F.regexp_replace(host, r"[\x00-\x7F&&[^a-z0-9]]+", "-"), F.lit("-"), F.coalesce(escaped, dashed))
    return F.btrim(F.regexp_replace(whole, "-{2,}", "-"), F.lit("-"))


def slug_path(url: Column, folder: str = "web-pages") -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), url_slug(url))
