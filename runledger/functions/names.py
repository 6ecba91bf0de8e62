"""Names and references: images, states, environments, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runledger.plans.digest import row_digest

# Where bare image names live, and the accepted spellings.
DEFAULT_REGISTRY = "registry-1.docker.io"
DEFAULT_NAMESPACE = "library/"
DEFAULT_TAG = "latest"
PINNED_SPEC = r"===?\s*[^,\s]+\s*\z"
SAFE_NAME = r"^[A-Za-z0-9._-]+$"
SAFE_HOST = r"^[A-Za-z0-9_][A-Za-z0-9._-]*(@[A-Za-z0-9_][A-Za-z0-9._:-]*)?$"
PLATFORM_FIELD = r"\A[A-Za-z0-9._+-]+\z"
# Whitespace in the Unicode sense, spelled out so every regex dialect agrees.
WHITESPACE = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
# Reserved words of Python 3, which cannot be identifiers.
RESERVED = (
    "False None True and as assert async await break class continue def del elif else except finally for from "
    "global if import in is lambda nonlocal not or pass raise return try while with yield"
).split()


def split_ref(ref: Column) -> Column:
    """Image reference -> struct(registry, repository, reference); null if not a registry reference."""
    has_scheme = ref.contains("://")
    scheme = F.substring_index(ref, "://", 1)
    rest = F.when(has_scheme, F.regexp_extract(ref, r"^.*?://(.*)$", 1)).otherwise(ref)
    by_digest = rest.contains("@")
    tagged = F.substring_index(rest, "/", -1).contains(":")
    name = (
        F.when(by_digest, F.substring_index(rest, "@", 1))
        .when(tagged, F.regexp_extract(rest, r"^(.*):[^:]*$", 1))
        .otherwise(rest)
    )
    reference = (
        F.when(by_digest, F.regexp_extract(rest, r"^[^@]*@(.*)$", 1))
        .when(tagged, F.substring_index(rest, ":", -1))
        .otherwise(F.lit(DEFAULT_TAG))
    )
    first = F.substring_index(name, "/", 1)
    hosted = name.contains("/") & (first.contains(".") | first.contains(":") | (first == "localhost"))
    registry = F.when(hosted, first).otherwise(F.lit(DEFAULT_REGISTRY))
    repository = (
        F.when(hosted, F.regexp_extract(name, r"^[^/]*/(.*)$", 1))
        .when(name.contains("/"), name)
        .otherwise(F.concat(F.lit(DEFAULT_NAMESPACE), name))
    )
    usable = ~has_scheme | (scheme == "docker")
    return F.when(usable, F.struct(registry.alias("registry"), repository.alias("repository"), reference.alias("reference")))


def pin_ref(ref: Column, digest: Column) -> Column:
    """`[scheme://]repo:tag` -> `[scheme://]repo@digest`; a registry port stays."""
    has_scheme = ref.contains("://")
    lead = F.when(has_scheme, F.concat(F.substring_index(ref, "://", 1), F.lit("://"))).otherwise(F.lit(""))
    rest = F.substring_index(F.when(has_scheme, F.regexp_extract(ref, r"^.*?://(.*)$", 1)).otherwise(ref), "@", 1)
    bare = F.when(F.substring_index(rest, "/", -1).contains(":"), F.regexp_extract(rest, r"^(.*):[^:]*$", 1)).otherwise(rest)
    return F.concat(lead, bare, F.lit("@"), digest)


def display_label(dotted: Column) -> Column:
    """A dotted step path without its root, which is the same on every line."""
    return F.regexp_replace(dotted, r"^[^.]*\.", "")


def shorten(text: Column, limit: int) -> Column:
    """One line of at most `limit` characters, ending in `...` where cut."""
    line = F.regexp_replace(F.regexp_replace(text, WHITESPACE, " "), "^ | $", "")
    kept = F.regexp_replace(F.substring(line, 1, max(0, limit - 3)), " $", "")
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(kept, F.lit("...")))


def state_name(key: Column, field: Column) -> Column:
    """Name of the state a step wrote: its key and the sanitized output field."""
    return F.concat(key, F.lit("__"), F.regexp_replace(field, r"[^\p{L}\p{N}_-]", "_"))


def gen0_name(path: Column, fingerprint: Column) -> Column:
    """Name of a path's state before anything tracked wrote to it."""
    return F.concat(F.lit("gen0__"), F.substring(row_digest(path, fingerprint), 1, 32))


def is_unpinned(spec: Column) -> Column:
    """Whether a requirement does not name one exact version."""
    return ~spec.rlike(PINNED_SPEC)


def is_safe_name(name: Column) -> Column:
    """Whether a name may be written into a generated script."""
    return name.rlike(SAFE_NAME)


def env_id(lock: Column, project: Column, extras: Column, groups: Column, python: Column, mode: Column, platform: Column) -> Column:
    """Sixteen hex digits naming an environment by every input to its build."""
    nul = F.char(F.lit(0))
    tagged = F.concat(
        F.transform(F.array_sort(extras), lambda e: F.concat(F.lit("extra="), e)),
        F.transform(F.array_sort(groups), lambda g: F.concat(F.lit("group="), g)),
    )
    selection = F.array_join(tagged, "\0")
    fields = [part for field in (lock, project, selection, python, mode, platform) for part in (field, nul)]
    return F.substring(F.sha2(F.concat(*fields), 256), 1, 16)


def parse_remote(spec: Column) -> Column:
    """`[user@]host:/path` -> struct(host, path); null where it is not one or the host is unsafe."""
    host = F.substring_index(spec, ":", 1)
    path = F.regexp_extract(spec, r"^[^:]*:([\s\S]*)$", 1)
    usable = spec.contains(":") & (host != "") & (path != "") & host.rlike(SAFE_HOST)
    return F.when(usable, F.struct(host.alias("host"), path.alias("path")))


def parse_platform(text: Column) -> Column:
    """`machine/libc/python` -> struct of the three; null unless exactly three plain fields."""
    parts = F.split(F.trim(text), "/")
    field = [F.get(parts, i) for i in range(3)]
    usable = (F.size(parts) == 3) & field[0].rlike(PLATFORM_FIELD) & field[1].rlike(PLATFORM_FIELD) & field[2].rlike(PLATFORM_FIELD)
    return F.when(usable, F.struct(field[0].alias("machine"), field[1].alias("libc"), field[2].alias("python")))


def to_json_safe(*cols: str) -> Column:
    """A record as one JSON document, absent values kept as null."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def sanitize(name: Column) -> Column:
    """A parameter name as an identifier."""
    cleaned = F.regexp_replace(name, r"[^\p{L}\p{N}_]", "_")
    led = F.when(cleaned.rlike("^[0-9]"), F.concat(F.lit("_"), cleaned)).otherwise(cleaned)
    return F.when(led.isin(RESERVED), F.concat(led, F.lit("_"))).otherwise(led)
