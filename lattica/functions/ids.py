"""Identifiers, qualifiers, globs, dates and status words as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.schema import PREFIXES


def mint(kind: str, local: Column) -> Column:
    return F.concat(F.lit(f"{PREFIXES[kind]}:"), local)


def symbol_id(path: Column, name: Column, ordinal: Column) -> Column:
    """The first symbol of a name in a file has no suffix, the n-th ``~n``."""
    return F.concat(F.lit("sym:"), path, F.lit("#"), name, F.when(ordinal > 1, F.concat(F.lit("~"), ordinal.cast("string"))).otherwise(""))


def qualify(local_id: Column, repo: Column) -> Column:
    """``kind:local`` to ``kind:<repo>:local``."""
    return F.concat(F.substring_index(local_id, ":", 1), F.lit(":"), repo, F.lit(":"), after(local_id, ":"))


def after(text: Column, mark: str) -> Column:
    """What follows the first mark; null without one."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text)))


#: A qualifier ends at the first colon, but one that introduces a port (digits, then a slash, no slash before) is part of it.
SPLIT = r"^([^/:]+:[0-9]+/[^:]*|[^:]*):(.*)$"


def split_qualifier(text: Column) -> tuple[Column, Column]:
    """Repo and local part; both null where there is none."""
    ok = text.rlike(f"(?s){SPLIT}")
    return (F.when(ok, F.regexp_extract(text, f"(?s){SPLIT}", i)) for i in (1, 2))


def parse_id(text: Column) -> dict[str, Column]:
    """kind, repo, local of an external id and whether it is well formed; a repo id has no local part."""
    kind, rest = F.substring_index(text, ":", 1), after(text, ":")
    repo, local = split_qualifier(rest)
    is_repo = kind == "repo"
    known = kind.isin(*PREFIXES.values())
    valid = F.coalesce(F.when(is_repo, rest != "").when(known, (repo != "") & (local != "")), F.lit(False))
    return {"kind": F.when(valid, kind), "repo": F.when(valid, F.when(is_repo, rest).otherwise(repo)), "local": F.when(valid & ~is_repo, local), "valid": valid}


def addressable(qualifier: Column) -> Column:
    """Whether a qualifier survives being put into an id and taken out again."""
    repo, local = split_qualifier(F.concat(qualifier, F.lit(":x")))
    return F.coalesce((qualifier != "") & (repo == qualifier) & (local == "x"), F.lit(False))


def repo_qualifier(base_url: Column, slug: Column) -> Column:
    bare = F.when(F.instr(base_url, "://") > 0, after(base_url, "://")).otherwise(base_url)
    return F.concat(F.regexp_replace(bare, "/+$", ""), F.lit("/"), slug)


def one_a_byte(text: Column) -> Column:
    """A text with a character for every byte of it."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def glob_regex(pattern: Column) -> Column:
    """For texts with a character a byte: ``*`` is any run, also across slashes, ``?`` one byte; all else is meant literally."""
    quoted = F.regexp_replace(one_a_byte(pattern), r"([\\.\[\]{}()+^$|])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("\\z"))


def glob_matches(pattern: Column, text: Column) -> Column:
    return F.rlike(one_a_byte(text), glob_regex(pattern))


def glob_match_bytes(pattern: str, text: str) -> bool:
    """The same for one pair, ``?`` being one byte."""
    parts = (b".*" if c == b"*" else b"." if c == b"?" else re.escape(c) for c in (bytes([b]) for b in pattern.encode()))
    return re.fullmatch(b"(?s:" + b"".join(parts) + b")", text.encode()) is not None


def render_date(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_since(text: Column) -> Column:
    """Epoch seconds of an RFC 3339 instant or of a date's midnight in UTC; null for anything else. The session's zone has to be UTC."""
    instant = text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    day = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.when(instant | day, F.unix_seconds(F.try_to_timestamp(F.upper(text))))


def valid_sha(text: Column) -> Column:
    return text.rlike("^([0-9a-f]{40}|[0-9a-f]{64})$")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_dir(path: Column) -> Column:
    return F.regexp_extract(path, "(?s)^(.*)/", 1)


def go_module(body: Column) -> Column:
    """The module path that a go.mod names, without comment and quotes; null if none."""
    line = F.regexp_extract(body, r"(?m)^[ \t]*module[ \t]+([^\r\n]*)", 1)
    name = F.trim(F.replace(F.regexp_replace(line, "//.*$", ""), F.lit('"'), F.lit("")))
    return F.when(name != "", name)


def plain_snippet(html: Column) -> Column:
    out = F.replace(F.replace(html, F.lit("<b>"), F.lit("")), F.lit("</b>"), F.lit(""))
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(c))
    return out


def locator(url: Column) -> dict[str, Column]:
    """base_url and slug of a repository's URL: host in lower case, no .git, no slash behind; both null where it is refused."""
    pattern = r"^(https?)://([^/?#@\s]+)/([^?#\s]+?)(?:\.git)?/*$"
    slug = F.regexp_replace(F.regexp_extract(url, pattern, 3), "/+", "/")
    ok = F.coalesce(url.rlike(pattern) & ~slug.rlike(r"(^|/)\.{1,2}(/|$)") & (slug != ""), F.lit(False))
    return {"base_url": F.when(ok, F.lower(F.concat(F.regexp_extract(url, pattern, 1), F.lit("://"), F.regexp_extract(url, pattern, 2)))), "slug": F.when(ok, slug)}


def job_state(state: Column, attempts: Column, has_output: Column) -> Column:
    return (
        F.when(state == "leased", "active").when((state == "queued") & (attempts == 0), "queued").when(state == "queued", "retrying")
        .when(state.isNotNull(), "unknown").when(has_output, "done").otherwise("never_ran")
    )


def backoff_seconds(attempts: Column) -> Column:
    return F.least(F.lit(30.0) * F.pow(F.lit(2.0), F.least(attempts, F.lit(7))), F.lit(3600.0)).cast("long")


def token_status(revoked_at: Column, expires_at: Column, now: Column) -> Column:
    return F.when(revoked_at.isNotNull(), "revoked").when(expires_at <= now, "expired").otherwise("active")


def retry_after(header: Column, reset: Column, now: Column) -> Column:
    """Seconds to wait: the longer of a Retry-After of seconds or an HTTP date and of the reset's instant; at least 5, 300 where neither tells."""
    seconds = F.try_to_number(header, F.lit("999999999")).cast("long")
    date = F.unix_seconds(F.try_to_timestamp(F.regexp_extract(header, r"^\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))) - now
    return F.greatest(F.coalesce(F.greatest(F.coalesce(seconds, date), reset - now), F.lit(300).cast("long")), F.lit(5).cast("long"))


def relative_import(language: Column, path: Column) -> Column:
    """Whether an import stays inside the repository and names no package."""
    return (
        F.when(language == "rust", path.rlike(r"^(crate|self|super|Self)(::|$)"))
        .when(language == "python", path.startswith(".")).when(language == "ecmascript", path.rlike(r"^\.{1,2}(/|$)")).otherwise(False)
    )


#: Extensions by language.
LANGUAGES = {"go": ("go",), "typescript": ("ts", "mts", "cts"), "tsx": ("tsx",), "javascript": ("js", "jsx", "mjs", "cjs"), "python": ("py",), "rust": ("rs",), "java": ("java",)}


def language(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, extensions in LANGUAGES.items():
        for e in extensions:
            out = F.when(path.endswith(f".{e}"), name).otherwise(out)
    return out
