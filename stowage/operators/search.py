"""Search over root entries.

root_entries(name_hash, entry_ord, ckey, locale, content), names(name_hash, path), fdid_map(file_data_id, name_hash).
Results come in the total order (path, nulls last; hash digits; entry_ord) before any limit.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash_hex, locale_matches
from ..plans.glob import BadPattern, NotFound, PathQuery, glob, hash_prefix, is_glob
from .unique import first_wins



@dataclass(frozen=True)
class SearchQuery:
    """All fields that are set must hold; a query without any matches everything. limit 0 is no limit."""

    name_contains: str | None = None
    hash_hex: str | None = None
    ckey_hex: str | None = None
    locale: int | None = None
    content: int | None = None
    limit: int = 0

    def filename(self, text: str) -> SearchQuery:
        return replace(self, name_contains=text)

    def hash_prefix(self, text: str) -> SearchQuery:
        return replace(self, hash_hex=text)

    def ckey_prefix(self, text: str) -> SearchQuery:
        return replace(self, ckey_hex=text)

    def with_locale(self, mask: int) -> SearchQuery:
        return replace(self, locale=mask)

    def with_content(self, mask: int) -> SearchQuery:
        return replace(self, content=mask)

    def top(self, n: int) -> SearchQuery:
        return replace(self, limit=n)

    def predicate(self) -> Column:
        """Over locale, content, name_hash, ckey and path; cheap conditions first. A null path never matches a needle."""
        found = F.lit(True)
        if self.locale is not None:
            found &= locale_matches(F.col("locale"), self.locale)
        if self.content is not None:
            found &= F.col("content").bitwiseAND(self.content) != 0
        if self.hash_hex is not None:
            found &= hash_prefix(F.col("name_hash"), self.hash_hex)
        if self.ckey_hex is not None:
            found &= F.hex("ckey").startswith(self.ckey_hex.upper())
        if self.name_contains is not None:
            found &= F.col("path").isNotNull() & F.contains(F.lower("path"), F.lit(self.name_contains.lower()))
        return found


def in_order(df: DataFrame, limit: int = 0) -> DataFrame:
    out = df.orderBy(F.col("path").asc_nulls_last(), hash_hex(F.col("name_hash")), "entry_ord")
    return out.limit(limit) if limit else out


def enrich(entries: DataFrame, names: DataFrame, fdids: DataFrame | None = None) -> DataFrame:
    """Entries with path and file_data_id, null where there is none."""
    out = entries.join(names.select("name_hash", "path"), "name_hash", "left")
    if fdids is None:
        return out
    return out.join(fdids.select("name_hash", "file_data_id"), "name_hash", "left")


def search(entries: DataFrame, names: DataFrame, query: SearchQuery, fdids: DataFrame | None = None) -> DataFrame:
    return in_order(enrich(entries, names, fdids).filter(query.predicate()), query.limit)


def by_hash(entries: DataFrame, names: DataFrame, h: int, fdids: DataFrame | None = None) -> DataFrame:
    """All variants of one hash."""
    return in_order(enrich(entries.filter(F.col("name_hash") == h), names, fdids))


def by_text(entries: DataFrame, names: DataFrame, text: str, limit: int = 0, fdids: DataFrame | None = None) -> DataFrame:
    """A glob if the text has a wildcard (a bad one finds nothing), else a substring."""
    if not is_glob(text):
        return search(entries, names, SearchQuery(name_contains=text, limit=limit), fdids)
    try:
        return by_path(entries, names, text, limit, fdids)
    except BadPattern:
        return enrich(entries, names, fdids).limit(0)


def by_path(entries: DataFrame, names: DataFrame, query: str, limit: int = 0, fdids: DataFrame | None = None) -> DataFrame:
    """Paths that match a glob, with the first variant of each; paths without an entry are passed over before the limit."""
    parsed = PathQuery.parse(query)
    hit = names.filter(glob(F.col("path"), parsed.pattern)) if parsed.glob else literal(names, parsed)
    first = first_wins(entries.join(hit.select("name_hash").distinct(), "name_hash", "left_semi"), ["name_hash"], ["entry_ord"])
    return in_order(enrich(first, hit, fdids), limit)


def literal(names: DataFrame, parsed: PathQuery) -> DataFrame:
    """The files below a folder, or else the file of that path; NotFound if there is neither."""
    from .tree import folder_of

    inside = names.filter(parsed.folder(folder_of(F.col("path"))))
    if inside.take(1) or not parsed.parts():
        return inside
    named = names.filter(parsed.file(F.col("path")))
    if named.take(1):
        return named
    raise NotFound(parsed.text)


def exists(entries: DataFrame, *, name_hash: int | None = None, file_data_id: int | None = None, fdids: DataFrame | None = None) -> bool:
    """Whether a hash, or the hash of a file data id, has an entry."""
    if file_data_id is not None:
        return bool(fdids.filter(F.col("file_data_id") == file_data_id).join(entries, "name_hash", "left_semi").take(1))
    return bool(entries.filter(F.col("name_hash") == name_hash).take(1))


def name_exists(entries: DataFrame, path: str) -> bool:
    from ..functions.hashing import name_hash_py

    return exists(entries, name_hash=name_hash_py(path))


def distinct_hashes(entries: DataFrame) -> DataFrame:
    return entries.select("name_hash").distinct()


def counts(entries: DataFrame, names: DataFrame) -> DataFrame:
    """One row: entries, distinct hashes, names."""
    own = entries.agg(F.count("*").alias("entries"), F.countDistinct("name_hash").alias("hashes"), F.lit(0).cast("bigint").alias("names"))
    named = names.agg(F.lit(0).cast("bigint").alias("entries"), F.lit(0).cast("bigint").alias("hashes"), F.count("*").alias("names"))
    return own.unionByName(named).agg(*[F.max(c).alias(c) for c in ("entries", "hashes", "names")])
