"""Relations between documents, edits, and access lists that follow categories.

Every function gives a new frame; plain Parquet has no in-place update.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANAGEMENT = "Management"
ALL_GROUPS = ("Management", "HR", "Finance", "User")
EMPTY_MAP = "map<string,string>"


def merged(old: Column, new: Column) -> Column:
    """Both maps; the new one wins."""
    old, new = F.coalesce(old, F.create_map().cast(EMPTY_MAP)), F.coalesce(new, F.create_map().cast(EMPTY_MAP))
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def role_name(role: Column, key: Column, groups: Column) -> Column:
    """The given role, Management or User by key, the first group that is not Management, else the key."""
    others = F.filter(groups, lambda g: F.lower(g) != "management")
    return F.coalesce(F.when(role != "", role), F.when(F.lower(key) == "management", "Management"), F.when(F.lower(key) == "user", "User"), F.get(others, F.lit(0)), key)


def apply_relations(documents: DataFrame, relations: DataFrame) -> DataFrame:
    """Archive replaced documents and cross-link both; modified ones are linked from the new document only.

    relations: (source_document_id, relationship_type, target_document_id). A document with
    several relations of a kind keeps the link of the smallest id.
    """
    replaces = relations.filter("relationship_type = 'replaces'")
    modifies = relations.filter("relationship_type = 'modifies'")
    titles = documents.select(F.col("document_id").alias("t_id"), F.col("title").alias("t_title"))

    def link(side: DataFrame, on: str, other: str, prefix: str) -> DataFrame:
        named = side.join(titles, side[other] == F.col("t_id"))
        one = named.groupBy(F.col(on).alias("document_id")).agg(F.min(F.struct(F.col(other).alias("id"), F.col("t_title").alias("title"))).alias("o"))
        return one.select("document_id", F.create_map(F.lit(f"{prefix}_document_id"), F.col("o.id").cast("string"), F.lit(f"{prefix}_document_title"), F.col("o.title")).alias(prefix))

    by, of, mod = (link(replaces, "target_document_id", "source_document_id", "replaced_by"), link(replaces, "source_document_id", "target_document_id", "replaces"), link(modifies, "source_document_id", "target_document_id", "modifies"))
    joined = documents.join(by, "document_id", "left").join(of, "document_id", "left").join(mod, "document_id", "left")
    out = joined.withColumn("metadata", merged(merged(merged(F.col("metadata"), F.col("replaced_by")), F.col("replaces")), F.col("modifies")))
    return out.withColumn("freshness_status", F.when(F.col("replaced_by").isNotNull(), "archived").otherwise(F.col("freshness_status"))).select(*documents.columns)


def archive_chunks(chunks: DataFrame, relations: DataFrame) -> DataFrame:
    gone = relations.filter("relationship_type = 'replaces'").select(F.col("target_document_id").alias("document_id"), F.lit(True).alias("gone")).distinct()
    return chunks.join(gone, "document_id", "left").withColumn("freshness_status", F.when(F.col("gone"), "archived").otherwise(F.col("freshness_status"))).drop("gone")


def category_groups(categories: DataFrame, default: tuple[str, ...] = ALL_GROUPS) -> Column:
    return F.coalesce("allowed_groups", F.array(*[F.lit(g) for g in default]))


def apply_edits(documents: DataFrame, edits: DataFrame, categories: DataFrame) -> DataFrame:
    """Non-null fields of edits (document_id, new_title, new_status, new_language, new_category) take effect; a category brings its groups, Management alone if unknown."""
    groups = F.broadcast(categories.select(F.col("key").alias("new_category"), "allowed_groups", F.lit(True).alias("known")))
    wanted = edits.join(groups, "new_category", "left")
    acl = F.when(F.col("new_category").isNotNull(), F.coalesce("allowed_groups", F.array(F.lit(MANAGEMENT))))
    wanted = wanted.select("document_id", "new_title", "new_status", "new_language", "new_category", acl.alias("new_acl"))
    joined = documents.join(wanted, "document_id", "left")
    changed = {"title": F.coalesce("new_title", "title"), "freshness_status": F.coalesce("new_status", "freshness_status"), "language": F.coalesce("new_language", "language"), "acl": F.coalesce("new_acl", "acl"), "metadata": F.when(F.col("new_category").isNotNull(), merged(F.col("metadata"), F.create_map(F.lit("department"), F.col("new_category")))).otherwise(F.col("metadata"))}
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in documents.columns])


def renamed_groups(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_role, new_role) of categories whose key stays and whose role changes."""
    before = old.select("key", role_name(F.col("role_name"), F.col("key"), F.col("allowed_groups")).alias("old_role"))
    after = new.select("key", role_name(F.col("role_name"), F.col("key"), F.col("allowed_groups")).alias("new_role"))
    return before.join(after, "key").filter("old_role <> new_role").select("old_role", "new_role")


def apply_renames(categories: DataFrame, renames: DataFrame) -> DataFrame:
    table = renames.agg(F.map_from_entries(F.collect_list(F.struct("old_role", "new_role"))).alias("m"))
    return categories.crossJoin(F.broadcast(table)).withColumn("allowed_groups", F.transform("allowed_groups", lambda g: F.coalesce(F.col("m")[g], g))).drop("m")  # one row


def migrate_categories(documents: DataFrame, migrations: DataFrame, categories: DataFrame) -> DataFrame:
    """Documents of a deleted category move to its replacement and take its groups; ``migrated`` marks them."""
    moves = migrations.join(categories.select(F.col("key").alias("replacement_key"), F.col("allowed_groups").alias("move_acl")), "replacement_key").select("deleted_key", "replacement_key", "move_acl")
    joined = documents.join(F.broadcast(moves), F.col("metadata")["department"] == F.col("deleted_key"), "left")
    moved = F.col("replacement_key").isNotNull()
    changed = {"metadata": F.when(moved, merged(F.col("metadata"), F.create_map(F.lit("department"), F.col("replacement_key")))).otherwise(F.col("metadata")), "acl": F.when(moved, F.col("move_acl")).otherwise(F.col("acl"))}
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in documents.columns], moved.alias("migrated"))


def propagate_acl(documents: DataFrame, categories: DataFrame) -> DataFrame:
    """Documents get their category's groups; ``propagated`` marks those whose list was another."""
    groups = F.broadcast(categories.select(F.col("key").alias("c_key"), F.col("allowed_groups").alias("c_acl")))
    joined = documents.join(groups, F.col("metadata")["department"] == F.col("c_key"), "left")
    differs = F.col("c_key").isNotNull() & ~F.col("acl").eqNullSafe(F.col("c_acl"))
    return joined.select(*[F.when(differs, F.col("c_acl")).otherwise(F.col("acl")).alias("acl") if c == "acl" else F.col(c) for c in documents.columns], differs.alias("propagated"))


def mirrored(chunks: DataFrame, documents: DataFrame, columns: tuple[str, ...] = ("language", "freshness_status", "acl", "metadata")) -> DataFrame:
    """Chunks with what they inherit taken again from ``documents``, the edited, moved or propagated ones; others stay as they are.

    Titles are not a chunk's, and columns that chunks lack are left out.
    """
    taken = [c for c in columns if c in chunks.columns and c in documents.columns]
    new = documents.select("document_id", *[F.col(c).alias(f"_new_{c}") for c in taken], F.lit(True).alias("_mirrored"))
    joined = chunks.join(new, "document_id", "left")
    return joined.select(*[F.when(F.col("_mirrored"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in taken else F.col(c) for c in chunks.columns])
