"""Paths and addresses as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from shutterloom.functions.vectors import let


def under_prefix(path: Column, prefix: str) -> Column:
    """Whether a path is the prefix or lies below it; whole segments, either separator."""
    bare = prefix.rstrip("/\\")
    return (path == bare) | (path == prefix) | path.startswith(bare + "/") | path.startswith(bare + "\\")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def stem_of(name: Column) -> Column:
    """Name before its last dot."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def split_ext(name: Column) -> tuple[Column, Column]:
    """(stem, extension without the dot); names that only begin or end with a dot have none."""
    has = name.rlike(r"^.+\.[^.]+$")
    return F.when(has, F.regexp_extract(name, r"^(.+)\.([^.]+)$", 1)).otherwise(name), F.when(has, F.regexp_extract(name, r"^(.+)\.([^.]+)$", 2))


def relative_path(path: Column, root: str) -> Column:
    """Path below the root; null outside it."""
    bare = root.rstrip("/")
    return F.when(path.startswith(bare + "/"), F.substr(path, F.lit(len(bare) + 2)))


def non_ascii(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7F]")


def valuable_name(path: Column) -> Column:
    """Innermost folder with a character beyond ASCII; empty without one."""
    folders = F.filter(F.split(parent(path), "/"), non_ascii)
    return F.coalesce(F.try_element_at(folders, F.lit(-1)), F.lit(""))


def sanitized_segment(value: Column) -> Column:
    """A container field as one path segment: ``unknown`` if missing; separators and control
    characters become underscores, and so does every dot of a name of dots."""
    clean = F.regexp_replace(F.coalesce(F.nullif(value, F.lit("")), F.lit("unknown")), r"[/\\\x00-\x1F\x7F-\u009F]", "_")
    return F.when(clean.rlike(r"^\.+$"), F.repeat(F.lit("_"), F.length(clean))).otherwise(clean)


def clean_segments(path: Column) -> Column:
    """Path without empty segments."""
    return F.array_join(F.filter(F.split(path, "/"), lambda s: s != ""), "/")


PLACEHOLDERS = ("year", "month", "day", "valuable_name", "make", "model")
NEVER_EMPTY = ("year", "month", "day", "make", "model")


def template_errors(template: str) -> str | None:
    """Why a template can't be used, if so."""
    if not template:
        return "the template is empty"
    plain = re.sub(r"\{[^{}]*\}", "", template)
    if "{" in plain or "}" in plain:
        return "the template has unbalanced braces"
    names = re.findall(r"\{([^{}]*)\}", template)
    for n in names:
        if n not in PLACEHOLDERS:
            return f"the template has an unknown placeholder {{{n}}}"
    if not set(names) & set(NEVER_EMPTY):
        return "the template needs one of " + ", ".join(NEVER_EMPTY)
    return None


def rendered(template: str, values: dict[str, Column]) -> Column:
    """A template compiled to a column; unknown placeholders stay as they are."""
    parts = []
    for k, piece in enumerate(re.split(r"\{([^{}]*)\}", template)):
        if k % 2 == 0:
            parts.append(F.lit(piece))
        else:
            parts.append(values.get(piece, F.lit("{" + piece + "}")))
    return clean_segments(F.concat(*parts))


def python_literal(text: Column) -> Column:
    """Text as it stands between double quotes in Python."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def decoded(segment: Column) -> Column:
    """Percent-decoded text, null if malformed; a plus sign stays."""
    return F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B")))


def encoded(path: Column) -> Column:
    """Percent-encoded path: controls, space, ``# ? @ : %`` and all beyond ASCII; slashes stay."""
    pieces = F.split(path, "")
    safe = F.transform(F.filter(pieces, lambda c: c != ""), lambda c: F.when(c.rlike(r"[\x21-\x7E]") & ~c.rlike(r"[#?@:%]"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")))
    return F.array_join(safe, "")


def location(uri: Column) -> Column:
    """Struct (scheme, user, host, port, share, device, storage, serial, path, error) of an address.

    Without ``://`` an address is local. Errors: unknown_scheme, missing_host, missing_share,
    missing_storage, missing_path, bad_port, bad_escape.
    """
    some = lambda c: F.nullif(c, F.lit(""))

    # each step is bound once and read by the next: written out in one another, the steps multiply
    def split(uri: Column) -> Column:
        at = F.instr(uri, "://")
        scheme = F.when(at == 0, "local").otherwise(F.lower(F.substring_index(uri, "://", 1)))
        rest = F.when(at == 0, uri).otherwise(F.substr(uri, at + 3))
        return let(F.struct(uri.alias("uri"), scheme.alias("scheme"), rest.alias("rest")), ends)

    def ends(s: Column) -> Column:
        head, tail = F.regexp_extract(s["rest"], "^([^/]*)", 1), F.regexp_extract(s["rest"], "^[^/]*/(.*)$", 1)
        return let(F.struct(head.alias("head"), tail.alias("tail")), lambda h: segments(s, h))

    def segments(s: Column, h: Column) -> Column:
        head, tail, named = h["head"], h["tail"], F.instr(h["head"], "@") > 0
        userinfo = F.when(named, F.substring_index(head, "@", 1))
        address = F.when(named, F.regexp_extract(head, "^[^@]*@(.*)$", 1)).otherwise(head)
        first, after = F.regexp_extract(tail, "^([^/]*)", 1), F.regexp_extract(tail, "^[^/]*/(.*)$", 1)
        return let(F.struct(userinfo.alias("userinfo"), address.alias("address"), first.alias("first"), after.alias("after")), lambda g: values(s, h, g))

    def values(s: Column, h: Column, g: Column) -> Column:
        scheme, address = s["scheme"], g["address"]
        host = F.when(address.startswith("["), F.regexp_extract(address, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(address, "^([^:]*)", 1))
        port_text = F.when(address.startswith("["), F.regexp_extract(address, r"^\[[^\]]*\]:(.*)$", 1)).otherwise(F.regexp_extract(address, "^[^:]*:(.*)$", 1))
        path = F.when(scheme == "local", s["uri"]).when(scheme == "file", decoded(s["rest"])).when(scheme.isin("smb", "mtp"), F.concat(F.lit("/"), decoded(g["after"]))).when(scheme == "adb", F.concat(F.lit("/"), decoded(h["tail"])))
        return let(F.struct(host.alias("host"), port_text.alias("port_text"), port_text.try_cast("int").alias("port"), path.alias("path")), lambda v: checked(s, h, g, v))

    def checked(s: Column, h: Column, g: Column, v: Column) -> Column:
        scheme, port = s["scheme"], v["port"]
        error = (
            F.when(~scheme.isin("local", "file", "smb", "mtp", "adb"), "unknown_scheme")
            .when((scheme == "smb") & (v["host"] == ""), "missing_host")
            .when((scheme == "smb") & (v["port_text"] != "") & (port.isNull() | ~port.between(0, 65535)), "bad_port")
            .when((scheme == "smb") & (g["first"] == ""), "missing_share")
            .when((scheme == "mtp") & (h["head"] == ""), "missing_host")
            .when((scheme == "mtp") & (g["first"] == ""), "missing_storage")
            .when((scheme == "adb") & (h["tail"] == ""), "missing_path")
            .when(v["path"].isNull(), "bad_escape")
        )
        return let(error, lambda e: parsed(s, h, g, v, e))

    def parsed(s: Column, h: Column, g: Column, v: Column, error: Column) -> Column:
        keep = lambda kind, c: F.when(error.isNull() & (s["scheme"] == kind), c)
        return F.when(s["uri"].isNotNull(), F.struct(
            F.when(s["scheme"] == "file", "local").otherwise(s["scheme"]).alias("scheme"),
            keep("smb", some(g["userinfo"])).alias("user"),
            keep("smb", v["host"]).alias("host"),
            keep("smb", v["port"]).alias("port"),
            keep("smb", decoded(g["first"])).alias("share"),
            keep("mtp", decoded(h["head"])).alias("device"),
            keep("mtp", decoded(g["first"])).alias("storage"),
            keep("adb", some(h["head"])).alias("serial"),
            F.when(error.isNull(), v["path"]).alias("path"),
            error.alias("error"),
        ))

    return let(uri, split)


def shown(loc: Column) -> Column:
    """The address of a location struct."""
    host = F.when(F.instr(loc["host"], ":") > 0, F.concat(F.lit("["), loc["host"], F.lit("]"))).otherwise(loc["host"])
    user = F.coalesce(F.concat(loc["user"], F.lit("@")), F.lit(""))
    port = F.coalesce(F.concat(F.lit(":"), loc["port"].cast("string")), F.lit(""))
    return (
        F.when(loc["scheme"] == "local", loc["path"])
        .when(loc["scheme"] == "smb", F.concat(F.lit("smb://"), user, host, port, F.lit("/"), encoded(loc["share"]), encoded(loc["path"])))
        .when(loc["scheme"] == "mtp", F.concat(F.lit("mtp://"), encoded(loc["device"]), F.lit("/"), encoded(loc["storage"]), encoded(loc["path"])))
        .when(loc["scheme"] == "adb", F.concat(F.lit("adb://"), F.coalesce(loc["serial"], F.lit("")), encoded(loc["path"])))
    )


def with_path(loc: Column, path: Column) -> Column:
    """The location with another path; scheme and connection stay."""
    return loc.withField("path", path)


def joined(loc: Column, child: Column) -> Column:
    """Location of a child name, or of several with slashes between; a path that is empty gives the child alone."""
    base = loc["path"]
    return with_path(loc, F.when(base == "", child).when(base.endswith("/"), F.concat(base, child)).otherwise(F.concat(base, F.lit("/"), child)))
