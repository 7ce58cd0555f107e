"""The three relations that the operators work on: file metadata, saved groups with their members, and file contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import name_tokens, parent_dir, plain_ext, stem, suffix
from ..functions.readings import clean_path, digest
from ..operators.versions import current_files, latest
from ..tables import table

FILE_COLUMNS = ("path", "name", "ext", "size", "mtime", "ctime", "inode", "device", "hash", "partial_hash", "quick_hash", "sha256_hash", "magic_type", "category", "keep_score", "entropy", "phash", "is_locked", "is_symlink", "is_system")


def metadata(files: DataFrame) -> DataFrame:
    """One row per file from ``file_records``: the current row, its values read once and for all.

    Digests are canonical or null, extensions plain or null, sizes and times that can't be are null, missing flags false.
    Files without a path are left out.
    """
    now = current_files(files, *FILE_COLUMNS, "scanned_at")
    text = lambda c: F.when(F.btrim(c, F.lit(" \t")) != "", F.btrim(c, F.lit(" \t")))
    time = lambda c: F.when((F.col(c) > 0) & ~F.isnan(c), F.col(c))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    path = clean_path(F.col("path"))
    ext = plain_ext(text(F.col("ext")))
    return now.select(
        "file_id", path.alias("path"), text(F.col("name")).alias("name"), F.when(ext != "", ext).alias("ext"),
        F.when(F.col("size") >= 0, F.col("size")).alias("size"), time("mtime").alias("mtime"), time("ctime").alias("ctime"),
        F.when(F.col("inode") > 0, F.col("inode")).alias("inode"), "device",
        *[digest(F.col(c)).alias(c) for c in ("hash", "partial_hash", "quick_hash")], F.lower(text(F.col("sha256_hash"))).alias("sha256_hash"),
        text(F.col("magic_type")).alias("magic_type"), text(F.col("category")).alias("category"), F.col("keep_score").cast("bigint").alias("keep_score"),
        F.when(~F.isnan("entropy"), F.col("entropy")).alias("entropy"), text(F.col("phash")).alias("phash"),
        *[flag(c).alias(c) for c in ("is_locked", "is_symlink", "is_system")],
    ).where(F.col("path").isNotNull()).withColumn("parent", parent_dir(F.col("path")))


def saved_members(groups: DataFrame, files: DataFrame) -> DataFrame:
    """``(group_id, group_type, score, idx, saved, ...file columns)``: known members of each group's latest saving.

    ``files`` is ``metadata``. A path listed twice counts at its first place; members are numbered by that place.
    """
    now = latest(groups.select("group_id", "group_type", F.col("score").cast("bigint").alias("score"), "files", "saved_at", F.array_sort(F.map_entries("suggestions")).alias("marks")), "group_id", "saved_at", ["group_id", "group_type", "score", "files", "marks"])
    head = now.select("group_id", F.lower(F.btrim("group_type", F.lit(" \t"))).alias("group_type"), "score")
    listed = now.select("group_id", F.posexplode("files").alias("idx", "path")).select("group_id", F.col("idx").cast("bigint").alias("idx"), clean_path(F.col("path")).alias("path")).where(F.col("path").isNotNull())
    first = listed.groupBy("group_id", "path").agg(F.min("idx").alias("idx"))
    marks = now.select("group_id", F.explode("marks").alias("m")).select("group_id", F.col("m.key").cast("bigint").alias("idx"), F.upper(F.btrim("m.value", F.lit(" \t"))).alias("saved"))
    return first.join(marks, ["group_id", "idx"], "left").join(files, "path").join(head, "group_id")


def contents(docs: DataFrame) -> DataFrame:
    """A catalog with binary content made from ``documents``: every text as a file, some also as links or edited copies.

    Links share the inode of their text; edited copies have its size and first bytes but another last one. Null texts are
    empty files.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text.alias("text"), F.coalesce(F.nullif(F.lower(F.btrim("source", F.lit(" \t"))), F.lit("")), F.lit("unknown")).alias("source"))
    last = F.right(F.col("text"), F.lit(1))
    edited = F.concat(F.expr("substr(text, 1, length(text) - 1)"), F.when(last == "~", "!").otherwise("~"))
    kinds = F.filter(
        F.array(
            F.struct(F.lit("base").alias("kind"), F.col("text").alias("text"), F.lit(True).alias("fits")),
            F.struct(F.lit("alias").alias("kind"), F.col("text").alias("text"), (F.col("doc_id") % 20 == 0).alias("fits")),
            F.struct(F.lit("edited").alias("kind"), edited.alias("text"), ((F.octet_length("text") > 4096) & last.isin(".", "!", "?", " ", "a", "e", "n", "s", "t")).alias("fits")),
        ),
        lambda k: k.fits,
    )
    e = d.select("doc_id", "source", F.explode(kinds).alias("k")).select("doc_id", "source", "k.kind", "k.text")
    i = F.col("doc_id")
    folder = F.element_at(F.array(*map(F.lit, ("/data/documents/", "/data/tmp/", "/data/work/a/b/c/", "/usr/share/", "/data/downloads/", "/srv/"))), (i % 6 + 1).cast("int"))
    mark = F.when(F.col("kind") == "edited", " - copy").when(i % 7 == 3, "_backup").when(i % 7 == 5, " (1)").otherwise("")
    end = F.when((F.col("kind") == "edited") & (i % 2 == 1), ".log").otherwise(F.element_at(F.array(*map(F.lit, (".md", ".html", ".xml", ".txt", ".txt"))), (i % 5 + 1).cast("int")))
    name = F.concat(F.when(F.col("kind") == "alias", "link_").otherwise("doc_"), F.lpad(i.cast("string"), 10, "0"), mark, end)
    return (
        e.select("doc_id", "kind", F.concat(folder, "source").alias("parent"), name.alias("name"), F.encode("text", "UTF-8").alias("content"))
        .withColumn("path", F.concat("parent", F.lit("/"), "name"))
        .select(
            "doc_id", "kind", "path", "parent", "name", stem(F.col("name")).alias("stem"), suffix(F.col("name")).alias("ext"), "content",
            F.octet_length("content").cast("bigint").alias("size"),
            (1704067200 + i * 1800 + F.when(F.col("kind") == "edited", 7200).otherwise(0)).cast("double").alias("mtime"),
            (1704067200 + i * 1800 - i % 11 * 60).cast("double").alias("ctime"),
            F.when(F.col("kind") == "edited", i + 1_000_000_000_000).otherwise(i + 1).alias("inode"), F.lit(1).cast("bigint").alias("device"),
            (i % 37 == 0).alias("is_locked"), (i % 41 == 0).alias("is_system"), (i % 43 == 0).alias("is_symlink"),
        )
    )


def tokens_of(files: DataFrame) -> DataFrame:
    return files.withColumn("tokens", name_tokens(F.col("name")))


def load_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return metadata(table(spark, folder, "file_records"))


def load_members(spark: SparkSession, folder: str) -> DataFrame:
    return saved_members(table(spark, folder, "dup_groups"), load_metadata(spark, folder))


def load_contents(spark: SparkSession, folder: str) -> DataFrame:
    return contents(table(spark, folder, "documents"))


def scan_folder(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Files below a folder as ``(path, name, ext, size, mtime, content)``; folders named like temporary ones are left out."""
    from .. import constants as K
    from ..functions.features import file_name, path_has

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    path = F.regexp_replace("path", "^file:(//)?", "")
    below = F.expr("substr(path, {})".format(len(root.rstrip("/")) + 1))
    d = raw.select(path.alias("path"), F.unix_micros("modificationTime").cast("double").alias("us"), "length", "content")
    return d.where(~path_has(parent_dir(below), K.TEMP_TOKENS, "segment")).select("path", file_name(F.col("path")).alias("name"), suffix(file_name(F.col("path"))).alias("ext"), F.col("length").alias("size"), (F.col("us") / 1e6).alias("mtime"), "content")


def _digest_sql(c: str) -> str:
    run = rf"regexp_extract(lower(replace({c}, '-', '')), '(^|[^0-9a-f])([0-9a-f]{{32}})($|[^0-9a-f])', 2)"
    return f"case when {run} <> '' and {run} <> repeat(left({run}, 1), 32) then {run} end {c}"


def _text_sql(c: str) -> str:
    return f"nullif(trim({c}, ' ' || chr(9)), '')"


METADATA_SQL = f"""cur as (select * from (select *, row_number() over (partition by file_id order by scanned_at desc) rn from file_records) where rn = 1),
f as (select *, regexp_extract(path, '^(.*)[/\\\\][^/\\\\]*$', 1) parent from (select file_id, {_text_sql('path')} path, {_text_sql('name')} as name,
  nullif(regexp_replace(lower({_text_sql('ext')}), '^\\.+', ''), '') ext, case when size >= 0 then size end as size,
  case when mtime > 0 and not isnan(mtime) then mtime end mtime, case when ctime > 0 and not isnan(ctime) then ctime end ctime,
  case when inode > 0 then inode end inode, device, {_digest_sql('hash')}, {_digest_sql('partial_hash')}, {_digest_sql('quick_hash')},
  lower({_text_sql('sha256_hash')}) sha256_hash, {_text_sql('magic_type')} magic_type, {_text_sql('category')} category, cast(keep_score as bigint) keep_score,
  case when not isnan(entropy) then entropy end entropy, {_text_sql('phash')} phash,
  coalesce(is_locked, false) is_locked, coalesce(is_symlink, false) is_symlink, coalesce(is_system, false) is_system from cur) where path is not null)"""

MEMBERS_SQL = f"""{METADATA_SQL},
g as (select * from (select *, row_number() over (partition by group_id order by saved_at desc) rn from dup_groups) where rn = 1),
gl as (select group_id, unnest(files) p, generate_subscripts(files, 1) - 1 i from g),
gp as (select group_id, trim(p, ' ' || chr(9)) path, min(i) idx from gl where trim(p, ' ' || chr(9)) <> '' group by 1, 2),
m as (select f.*, gp.group_id, gp.idx, lower(trim(g.group_type, ' ' || chr(9))) group_type, cast(g.score as bigint) score,
  upper(trim(g.suggestions[gp.idx::int], ' ' || chr(9))) saved from gp join f on gp.path = f.path join g on g.group_id = gp.group_id)"""

CONTENTS_SQL = r"""d as (select doc_id, coalesce(text, '') as text, coalesce(nullif(lower(trim(source, ' ' || chr(9))), ''), 'unknown') source from documents where doc_id is not null),
r as (select doc_id, source, 'base' kind, text from d
  union all select doc_id, source, 'alias', text from d where doc_id % 20 = 0
  union all select doc_id, source, 'edited', substr(text, 1, length(text) - 1) || case when right(text, 1) = '~' then '!' else '~' end
    from d where octet_length(encode(text)) > 4096 and right(text, 1) in ('.', '!', '?', ' ', 'a', 'e', 'n', 's', 't')),
n as (select doc_id, kind, text,
  case doc_id % 6 when 0 then '/data/documents/' when 1 then '/data/tmp/' when 2 then '/data/work/a/b/c/' when 3 then '/usr/share/' when 4 then '/data/downloads/' else '/srv/' end || source parent,
  case when kind = 'alias' then 'link_' else 'doc_' end || lpad(cast(doc_id as varchar), 10, '0')
    || case when kind = 'edited' then ' - copy' when doc_id % 7 = 3 then '_backup' when doc_id % 7 = 5 then ' (1)' else '' end stem,
  case when kind = 'edited' and doc_id % 2 = 1 then '.log' when doc_id % 5 = 0 then '.md' when doc_id % 5 = 1 then '.html' when doc_id % 5 = 2 then '.xml' else '.txt' end ext from r),
c as (select doc_id, kind, parent || '/' || stem || ext path, parent, stem || ext as name, stem, ext, encode(text) content, text,
  cast(octet_length(encode(text)) as bigint) as size, cast(1704067200 + doc_id * 1800 + case when kind = 'edited' then 7200 else 0 end as double) mtime,
  cast(1704067200 + doc_id * 1800 - doc_id % 11 * 60 as double) ctime, case when kind = 'edited' then doc_id + 1000000000000 else doc_id + 1 end inode, 1::bigint device,
  doc_id % 37 = 0 is_locked, doc_id % 41 = 0 is_system, doc_id % 43 = 0 is_symlink from n)"""
