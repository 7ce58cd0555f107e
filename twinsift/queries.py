"""The core's registered queries; their SQL is in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as K
from .functions import features as X
from .functions.extractors import log_tag
from .functions import keep
from .functions.readings import clean_path
from .functions.score import components, pair_score
from .operators import changes as feed
from .operators import filters, groups, pairs, policy, report, vectors
from .operators.components import connected_components
from .operators.heavy_keys import newest_per_content_key
from .oracle import oracle_sql  # noqa: F401 - part of this module's contract
from .plans.runtime import cut
from .settings import Settings
from .sources import catalog
from .tables import table

Query = Callable[[SparkSession, str], DataFrame]
col = F.col


def _files(s: SparkSession, d: str) -> DataFrame:
    return catalog.load_metadata(s, d)


def _members(s: SparkSession, d: str) -> DataFrame:
    return catalog.load_members(s, d)


def _contents(s: SparkSession, d: str) -> DataFrame:
    return catalog.load_contents(s, d)


def _digested(s: SparkSession, d: str) -> DataFrame:
    """The content catalog with digests and tokens instead of content."""
    c = _contents(s, d)
    return catalog.tokens_of(c.withColumns({"hash": F.md5("content"), "sha256_hash": F.sha2("content", 256), "quick_hash": X.quick_digest(col("content"))}).drop("content"))


def _remaining(files: DataFrame) -> DataFrame:
    """Files that are neither links nor exact copies of others."""
    rest = groups.without_members(files, groups.hardlink_groups(files), "device", "inode")
    return groups.without_members(rest, groups.exact_groups(rest, "hash"), "size", "hash")


def _known_pairs(s: SparkSession, d: str) -> DataFrame:
    """Distinct matched pairs of two known files, as structs ``a`` and ``b`` in path order."""
    m = table(s, d, "match_pairs").select(clean_path(col("path_a")).alias("x"), clean_path(col("path_b")).alias("y")).where(col("x") != col("y"))
    p = m.select(F.least("x", "y").alias("pa"), F.greatest("x", "y").alias("pb")).distinct()
    f = catalog.tokens_of(_files(s, d).withColumn("name", F.coalesce("name", F.lit(""))))
    row = F.struct("file_id", "category", *[c for c in pairs.SCORED if c != "embedding"])
    return p.join(f.select(col("path").alias("pa"), row.alias("a")), "pa").join(f.select(col("path").alias("pb"), row.alias("b")), "pb").select("a", "b")


def _paths(p: DataFrame, *cols) -> DataFrame:
    return p.select(col("a.path").alias("path_a"), col("b.path").alias("path_b"), *cols)


def _needed(files: DataFrame) -> DataFrame:
    """Folders that hold a file of installed software."""
    return files.where(keep.needs_company(F.concat(F.lit("."), "ext"))).select("parent").distinct()


def _with_keep_parts(files: DataFrame) -> DataFrame:
    f = files.join(_needed(files).withColumn("needed", F.lit(True)), "parent", "left").withColumn("needed", F.coalesce("needed", F.lit(False)))
    return f.withColumn("stem", X.stem(F.coalesce("name", F.lit(""))))


def _path_scores(files: DataFrame) -> DataFrame:
    return _with_keep_parts(files).select("path", keep.path_keep_score(col("path"), col("needed")).alias("path_score"))


def _candidates(s: SparkSession, d: str) -> DataFrame:
    return pairs.near_candidates(_remaining(_digested(s, d)))


def _native_pairs(s: SparkSession, d: str) -> DataFrame:
    return pairs.near_pairs(_candidates(s, d), 60, with_names=False)


def _clusters(s: SparkSession, d: str, names: bool = True, largest: int | None = K.MAX_CLUSTER) -> tuple[DataFrame, DataFrame]:
    """(clusters, pairs that validation counts): of the whole score from 70 on, validated from 60 on; or of the score without names from 60 on."""
    p = cut(pairs.near_pairs(_candidates(s, d), 60, with_names=names).select("path_a", "path_b", "score"))
    return pairs.near_clusters(p.where(col("score") >= (70 if names else 60)), largest), p


def _all_groups(s: SparkSession, d: str, names: bool = True) -> DataFrame:
    f = _digested(s, d)
    g = lambda kind, files, *keys: files.dropna(subset=list(keys)).groupBy(*keys).agg(F.min("path").alias("first_path"), F.count(F.lit(1)).alias("n_files")).where(col("n_files") > 1).select(F.lit(kind).alias("group_type"), "first_path", "n_files")
    rest = groups.without_members(f, groups.hardlink_groups(f), "device", "inode")
    near = _clusters(s, d, names)[0].select(F.lit("near").alias("group_type"), col("cluster").alias("first_path"), "n_files").distinct()
    return g("hardlink", f, "device", "inode").unionByName(g("exact", rest.where(col("size") > 0), "size", "hash")).unionByName(near)


def _selection(m: DataFrame, **changes) -> DataFrame:
    return policy.selected(m, Settings(**changes))


def _overrides(m: DataFrame) -> DataFrame:
    """What the saved marks would change: KEEP and DELETE as saved, REVIEW toggles."""
    return m.where(col("saved").isin("KEEP", "DELETE", "REVIEW")).select("group_id", "path", F.when(col("saved") == "REVIEW", "TOGGLE").otherwise(col("saved")).alias("action"))


def _feed(s: SparkSession, d: str) -> DataFrame:
    """The events as a feed of states: a user's properties are the state, an error takes it away."""
    e = table(s, d, "events")
    return e.select(col("user_id").cast("string").alias("key"), "ts", col("event_id").alias("seq"), F.when(col("event_type") == "error", "delete").otherwise("put").alias("op"), F.md5("props").alias("digest"))


def _stars(m: DataFrame) -> DataFrame:
    """Pairs of each group's smallest path with its other members."""
    first = m.groupBy("group_id").agg(F.min("path").alias("a"))
    return m.select("group_id", col("path").alias("b")).join(first, "group_id").where(col("a") != col("b")).select("a", "b")


def _queries_of_vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(s, d, "embeddings")
    return v.where(col("vec_id") % 100 == 0), v


def _fusion(s: SparkSession, d: str) -> DataFrame:
    """Known pairs, each file with one of all vectors: the file's number modulo the number of vectors names it."""
    v = table(s, d, "embeddings").select("vec_id", "embedding")
    n = max(1, v.count())
    at = lambda side: F.pmod(col(f"{side}.file_id"), F.lit(n))
    p = _known_pairs(s, d).withColumns({"ia": at("a"), "ib": at("b")}).join(v.select(col("vec_id").alias("ia"), col("embedding").alias("va")), "ia").join(v.select(col("vec_id").alias("ib"), col("embedding").alias("vb")), "ib")
    same = F.coalesce(col("a.hash") == col("b.hash"), F.lit(False))
    p = p.withColumns({"h": F.when(same, 1.0).otherwise(0.0), "sem": X.cosine(col("va"), col("vb")), "ctx": vectors.contextual_score("a", "b")})
    score = vectors.fused(col("h"), col("sem"), col("ctx"))
    return _paths(p, F.round(score, 6).alias("fused"), (same | (score >= vectors.threshold_for(col("a.category")))).alias("is_duplicate"))


def _story(p: DataFrame) -> DataFrame:
    """Up to five sentences about a pair."""
    a, b = lambda f: col(f"a.{f}"), lambda f: col(f"b.{f}")
    off = F.abs(a("size") - b("size")) / F.greatest(a("size"), b("size"), F.lit(1))
    size = F.when(a("size") == b("size"), F.concat(F.lit("Same size, "), X.format_size(a("size")))).when(off < 0.05, F.format_string("Sizes differ by %.1f %%", 100 * off)).otherwise(F.concat(F.lit("Sizes "), X.format_size(a("size")), F.lit(" and "), X.format_size(b("size"))))
    r = X.name_ratio(F.lower(X.stem(a("name"))), F.lower(X.stem(b("name"))))
    name = F.when(r > 0.9, "Names nearly the same").when(r > 0.7, "Names very similar").when(r > 0.5, "Names share parts")
    bits = X.phash_distance(a("phash"), b("phash"))
    look = F.when(bits <= 8, "Pictures nearly the same").when(bits <= 16, "Pictures very similar")
    gap = F.abs(a("mtime") - b("mtime"))
    time = F.when(gap < 3600, "Changed within an hour").when(gap < 604800, "Changed within a week")
    kind = F.when(a("category") == b("category"), F.concat(F.lit("Both "), a("category")))
    folder = F.when(a("parent") == b("parent"), "Same folder")
    score = pair_score("a", "b", r)
    level = F.when(score >= 90, "HIGH similarity").when(score >= 70, "MODERATE similarity").otherwise("LOW similarity")
    return _paths(p, F.concat_ws(". ", F.slice(F.array_compact(F.array(size, name, look, time, kind, folder, level)), 1, 5)).alias("story"))


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    files = lambda f: lambda s, d: f(_files(s, d))
    members = lambda f: lambda s, d: f(_members(s, d))
    contents = lambda f: lambda s, d: f(_contents(s, d))
    known = lambda f: lambda s, d: f(_known_pairs(s, d))

    q["exact_groups"] = files(lambda f: groups.exact_groups(f, "hash"))
    # sources
    q["catalog_scan"] = contents(lambda c: c.select("path", "name", "ext", "size"))
    q["catalog_stat"] = files(lambda f: f.select("file_id", "path", "ext", "size", "mtime", "ctime", "inode", "device", "hash", "quick_hash", "is_locked", "is_system", "is_symlink"))
    q["doc_text_head"] = lambda s, d: table(s, d, "documents").select("doc_id", F.md5(F.left("text", F.lit(K.TEXT_HEAD_CHARS))).alias("head_md5"), F.length(F.left("text", F.lit(K.TEXT_HEAD_CHARS))).cast("bigint").alias("head_chars"))
    q["log_tags"] = lambda s, d: table(s, d, "documents").select(F.explode(F.split("text", "\n")).alias("line")).groupBy(log_tag(col("line")).alias("tag")).agg(F.count(F.lit(1)).alias("n_lines"))
    q["recent_file"] = files(lambda f: f.where(col("mtime").isNotNull()).groupBy("parent").agg(F.max(F.struct("mtime", "path")).alias("m")).select("parent", col("m.path").alias("path")))
    # filters
    q["filter_size_range"] = files(lambda f: filters.size_between(f, 4096, 1_048_576).select("path", "size"))
    q["filter_exclusions"] = files(lambda f: filters.excluding(f, ["Cache", "archive", ".tmp"]).select("path"))
    q["filter_system_path"] = files(lambda f: f.select("path", keep.is_system_path(col("path")).alias("is_system_path")))
    q["filter_temp_dirs"] = files(lambda f: filters.outside_temp(f).select("path"))
    q["filter_groups"] = members(lambda m: filters.shown_groups(m, "near", "documents"))
    q["revalidate_mutation"] = lambda s, d: filters.revalidated(catalog.metadata(table(s, d, "file_records").where(col("scanned_at") < F.lit("2025-06-01").cast("timestamp_ntz"))), _files(s, d))
    # features
    q["path_parts"] = files(lambda f: f.select("path", X.parent_dir(col("path")).alias("parent"), X.file_name(col("path")).alias("name"), X.stem(X.file_name(col("path"))).alias("stem"), X.suffix(X.file_name(col("path"))).alias("ext"), X.depth(col("path")).alias("depth")))
    q["magic_type"] = contents(lambda c: c.select("path", X.magic_type(F.substring("content", 1, K.MAGIC_HEAD)).alias("magic_type")))
    q["category"] = files(lambda f: f.select("path", X.category(col("magic_type"), F.coalesce("ext", F.lit(""))).alias("category")))
    q["category_histogram"] = files(lambda f: report.category_histogram(f.select(X.category(col("magic_type"), F.coalesce("ext", F.lit(""))).alias("category"))))
    q["hash_quick"] = contents(lambda c: c.select("path", X.quick_digest(col("content")).alias("quick_hash")))
    q["hash_partial"] = contents(lambda c: c.select("path", X.partial_digest(col("content")).alias("partial_hash")))
    q["hash_full"] = contents(lambda c: c.select("path", F.md5("content").alias("hash")))
    q["hash_sha256"] = contents(lambda c: c.select("path", F.sha2("content", 256).alias("sha256_hash")))
    q["staged_hash"] = contents(groups.staged_digests)
    q["entropy"] = contents(lambda c: c.select("path", X.entropy(F.substring("content", 1, K.CHUNK_BYTES)).alias("entropy")))
    q["name_tokens"] = files(lambda f: f.select("path", F.array_join(F.array_sort(X.name_tokens(col("name"))), " ").alias("tokens")))
    q["name_keep_score"] = files(lambda f: f.select("path", keep.name_keep_score(X.stem(col("name"))).alias("name_score")))
    q["path_keep_score"] = files(_path_scores)
    q["keep_score"] = files(lambda f: _with_keep_parts(f).select("path", keep.keep_score(col("stem"), col("path"), col("needed"), col("is_locked"), col("is_system")).alias("keep_score")))
    q["format_size"] = files(lambda f: f.select("path", X.format_size(col("size")).alias("size_text")))
    q["format_ts"] = files(lambda f: f.select("path", X.format_ts(col("mtime")).alias("mtime_text")))
    # pairs of files
    q["ext_compat"] = known(lambda p: _paths(p, X.ext_compat(F.coalesce("a.ext", F.lit("")), F.coalesce("b.ext", F.lit(""))).alias("compat")))
    q["phash_distance"] = known(lambda p: _paths(p.where(col("a.phash").isNotNull() & col("b.phash").isNotNull()), X.phash_distance(col("a.phash"), col("b.phash")).alias("distance")))
    q["token_jaccard"] = known(lambda p: _paths(p, F.round(X.jaccard(col("a.tokens"), col("b.tokens")), 6).alias("jaccard")))
    q["name_ratio"] = known(lambda p: _paths(p, F.round(X.name_ratio(F.lower(X.stem(col("a.name"))), F.lower(X.stem(col("b.name")))), 6).alias("ratio")))
    q["pair_score_native"] = known(lambda p: _paths(p, pair_score("a", "b").alias("score"), *[v.cast("bigint").alias(f"c_{k}") for k, v in components("a", "b").items() if k not in ("name", "semantic")]))
    q["contextual_score"] = known(lambda p: _paths(p, F.round(vectors.contextual_score("a", "b"), 6).alias("context")))
    q["fusion_score"] = _fusion
    q["duplicate_story"] = known(_story)
    q["size_block_pairs"] = lambda s, d: pairs.block_pairs(_remaining(_digested(s, d))).select(col("a.path").alias("path_a"), col("b.path").alias("path_b"), "size")
    q["near_pairs"] = lambda s, d: pairs.near_pairs(_candidates(s, d), 70)
    q["near_pairs_native"] = lambda s, d: _native_pairs(s, d).select("path_a", "path_b", "score", "c_size", "c_quick", "c_token", "c_ext", "c_time")
    q["near_pairs_capped"] = lambda s, d: pairs.capped(_candidates(s, d).select("size", col("a.path").alias("path_a"), col("b.path").alias("path_b")))
    q["name_bigram_pairs"] = lambda s, d: pairs.named_pairs(_remaining(_files(s, d)))
    # groups
    q["size_groups"] = files(groups.size_groups)
    q["hardlink_groups"] = files(groups.hardlink_groups)
    q["exact_groups_sha256"] = lambda s, d: groups.exact_groups(_digested(s, d), "hash", "sha256_hash")
    q["exact_remaining"] = lambda s, d: _remaining(_digested(s, d)).select("path")
    q["connected_components"] = lambda s, d: connected_components(table(s, d, "match_pairs").select(clean_path(col("path_a")).alias("a"), clean_path(col("path_b")).alias("b")), "a", "b")
    q["near_clusters"] = lambda s, d: _clusters(s, d)[0]
    q["cluster_validate"] = lambda s, d: pairs.validated(*_clusters(s, d))
    q["all_groups"] = _all_groups
    q["near_clusters_native"] = lambda s, d: _clusters(s, d, names=False)[0]
    q["near_clusters_uncapped"] = lambda s, d: _clusters(s, d, names=False, largest=None)[0]
    q["cluster_validate_native"] = lambda s, d: pairs.validated(*_clusters(s, d, names=False))
    q["cluster_validate_uncapped"] = lambda s, d: pairs.validated(*_clusters(s, d, names=False, largest=None), largest=None)
    q["all_groups_native"] = lambda s, d: _all_groups(s, d, names=False)
    q["paranoid_verify"] = contents(lambda c: groups.verified(c.withColumn("hash", F.md5("content"))))
    q["reclaimable"] = members(groups.group_totals)
    q["risk_level"] = members(groups.risk_levels)
    q["ranked_groups"] = members(groups.ranked)
    q["group_navigation"] = members(lambda m: groups.neighbours(cut(groups.ranked(m))))
    q["eval_pass_rate"] = lambda s, d: pairs.found_share(table(s, d, "match_pairs").select(clean_path(col("path_a")).alias("a"), clean_path(col("path_b")).alias("b")).where(col("a") != col("b")), _stars(_members(s, d)))
    # decisions
    q["keeper"] = members(lambda m: policy.keepers(m).select("group_id", "keeper", "best_score", "n_files"))
    q["select_policy"] = members(_selection)
    q["select_policy_aggressive"] = members(lambda m: _selection(m, cleanup_mode="AGGRESSIVE"))
    q["select_policy_media"] = members(lambda m: _selection(m, cleanup_mode="MEDIA-FOCUSED"))
    q["select_policy_basic"] = members(policy.selected_basic)
    q["manual_overrides"] = members(lambda m: policy.overridden(_selection(m), _overrides(m)))
    q["deletion_plan"] = members(lambda m: policy.deletion_plan(m, _selection(m, cleanup_mode="AGGRESSIVE")))
    q["deletion_plan_summary"] = members(lambda m: report.plan_summary(policy.deletion_plan(m, _selection(m, cleanup_mode="AGGRESSIVE"))))
    q["post_delete_groups"] = members(lambda m: policy.after_deletion(m, policy.deletion_plan(m, _selection(m, cleanup_mode="AGGRESSIVE"))))
    q["why_keep"] = lambda s, d: policy.why_keep(_members(s, d), _needed(_files(s, d)), _path_scores(_files(s, d)))
    # reports
    q["report_summary"] = members(lambda m: report.summary(m, _selection(m)))
    q["summary_rollup"] = members(report.rollup)
    q["scan_stats"] = lambda s, d: report.scan_stats(_files(s, d), _members(s, d))
    q["export_rows"] = members(lambda m: report.export_rows(m, _selection(m)))
    q["export_nested"] = members(lambda m: report.export_nested(report.export_rows(m, _selection(m))))
    # vectors
    q["cosine_similarity"] = lambda s, d: (lambda v: v.alias("x").join(v.alias("y"), col("x.vec_id") + 1 == col("y.vec_id")).select(col("x.vec_id").alias("vec_id"), F.round(X.cosine(col("x.embedding"), col("y.embedding")), 6).alias("similarity")))(table(s, d, "embeddings"))
    q["knn_topk"] = lambda s, d: vectors.knn(*_queries_of_vectors(s, d))
    q["semantic_pairs"] = lambda s, d: vectors.within(*_queries_of_vectors(s, d), 0.4)
    q["ann_topk"] = lambda s, d: vectors.ann(*_queries_of_vectors(s, d))
    # changes
    q["watch_changes"] = lambda s, d: feed.changes(_feed(s, d))
    q["p5_found"] = lambda s, d: newest_per_content_key(table(s, d, "file_records"))
    return q
