"""Access, freshness and metadata predicates, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MANAGEMENT, EVERYONE = "Management", "User"
#: Filter keys that configure the search instead of naming metadata.
CONFIGURATION_KEYS = (
    "freshness_filter", "search_strategy", "hybrid_strategy", "vector_weight", "keyword_weight",
    "rrf_k", "vector_limit", "keyword_limit", "final_limit", "vector_final_limit",
    "keyword_final_limit", "score_threshold", "freshness_boost", "context_expansion",
    "context_expansion_size", "chunk_size", "chunk_overlap", "context_max_tokens",
)


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def tenant_matches(row_tenant: Column, tenant: Column) -> Column:
    """The tenant itself or its base, the part before the first dash."""
    return _yes((row_tenant == tenant) | (row_tenant == F.split(tenant, "-")[0]))


def _overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(F.array_compact(a), F.array_compact(b))) > 0


def acl_strict(acl: Column, groups: Column) -> Column:
    """Retrieval's rule: Management sees all; else the list must be there and share a group with the user's and User."""
    return _yes(F.array_contains(groups, MANAGEMENT)) | _yes(_overlap(acl, F.array_union(groups, F.array(F.lit(EVERYONE)))))


def acl_lenient(acl: Column, groups: Column) -> Column:
    """The library list's rule: no list and an empty list let everyone pass, and so does User in it."""
    return acl.isNull() | (F.size(acl) == 0) | _yes(F.array_contains(acl, EVERYONE)) | _yes(F.array_contains(groups, MANAGEMENT)) | _yes(_overlap(acl, groups))


def fresh_enough(mode: Column, status: Column, created: Column, as_of_year: int) -> Column:
    """all, latest (status current) or this_year (year of creation); other modes pass all."""
    return F.when(mode == "latest", _yes(status == "current")).when(mode == "this_year", _yes(F.year(created) == as_of_year)).otherwise(True)


def metadata_matches(filters: Column, *lookups: Column) -> Column:
    """Each filter must equal the value of its key in one of the maps; configuration keys are skipped."""

    def fits(key: Column, value: Column) -> Column:
        found = F.lit(False)
        for m in lookups:
            found = found | _yes(m[key] == value)
        return key.isin(*CONFIGURATION_KEYS) | found

    return F.coalesce(F.forall(F.map_entries(filters), lambda e: fits(e["key"], e["value"])), F.lit(True))


def cleaned_filters(filters: Column) -> Column:
    """Without placeholder keys, nulls and empty objects."""
    return F.map_filter(filters, lambda k, v: (k != "additionalProp1") & v.isNotNull() & ~v.isin("{}", ""))


def library_matches(language: Column, folder: Column, status: Column, year: Column, want_language: Column, want_folder: Column, mode: Column, as_of_year: int) -> Column:
    """Null wishes ask for nothing."""
    fresh = F.when(mode == "latest", status == "current").when(mode == "this_year", year == as_of_year).otherwise(True)
    return _yes((want_language.isNull() | (language == want_language)) & (want_folder.isNull() | (folder == want_folder)) & fresh)


def library_search(needle: Column, *fields: Column) -> Column:
    """Case-insensitive substring in any field; a blank needle finds all."""
    wanted = F.lower(F.trim(needle))
    hit = F.lit(False)
    for f in fields:
        hit = hit | _yes(F.contains(F.lower(f), wanted))
    return (wanted == "") | hit


#: What decides whether a query may see a chunk: columns of the query, and of the chunk with its document.
ASKER, SEEN = ("tenant", "groups", "freshness"), ("tenant_id", "doc_acl", "acl", "freshness_status", "created_at")


def may_see(as_of_year: int) -> Column:
    """Tenant, access and freshness over the columns ASKER and SEEN; documents' and chunks' lists both count."""
    return tenant_matches(F.col("tenant_id"), F.col("tenant")) & acl_strict(F.col("doc_acl"), F.col("groups")) & acl_strict(F.col("acl"), F.col("groups")) & fresh_enough(F.col("freshness"), F.col("freshness_status"), F.col("created_at"), as_of_year)
