"""SQL that gives the same rows as the registered queries, for a check by another engine."""

from __future__ import annotations

from . import constants as K
from .functions.extractors import LOG_TAGS
from .operators.heavy_keys import NEWEST_SQL
from .sources.catalog import CONTENTS_SQL, MEMBERS_SQL, METADATA_SQL


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _contains(text: str, words) -> str:
    return "(" + " or ".join(f"contains({text}, {_quoted([w])})" for w in words) + ")"


NAME = r"regexp_extract({0}, '([^/\\]*)$', 1)"
STEM = r"(case when regexp_matches({0}, '^(.+)\.[^.]+$') then regexp_extract({0}, '^(.+)\.[^.]+$', 1) else {0} end)"
SUFFIX = r"lower(regexp_extract({0}, '^.+(\.[^.]+)$', 1))"
SEGMENTS = r"list_filter(string_split_regex({0}, '[/\\]'), lambda p: p <> '')"
DEPTH = f"(len({SEGMENTS}) + case when starts_with({{0}}, '/') then 1 else 0 end)"
EXT = r"regexp_replace(lower(coalesce({0}, '')), '^\.+', '')"
PROTECTED = _contains("lower({0})", [d.lower().replace("*", "") for d in K.PROTECTED_DIRS])
SYSTEM = "(" + " or ".join(f"starts_with(lower({{0}}), {_quoted([p.lower()])})" for p in K.SYSTEM_PREFIXES) + ")"
COPY = _contains("lower({0})", K.COPY_PATTERNS)


def _any_segment(path: str, words) -> str:
    return f"len(list_filter({SEGMENTS.format(f'lower({path})')}, lambda p: {_contains('p', words)})) > 0"


def _category(magic: str, ext: str) -> str:
    e = EXT.format(ext)
    return "case " + " ".join([f"when {magic} in ({_quoted(v)}) then '{k}'" for k, v in K.MAGIC_CATEGORIES.items()] + [f"when {e} in ({_quoted(v)}) then '{k}'" for k, v in K.EXT_CATEGORIES.items()]) + " else 'Other' end"


def _name_score(stem: str) -> str:
    s = f"lower({stem})"
    return rf"(case when {COPY.format(stem)} then -30 else 0 end + case when regexp_matches({s}, '\([0-9]+\)\s*$') then -20 when regexp_matches({s}, '[\s_\-][0-9]+\s*$') then -15 else 0 end + case when length({s}) <= 2 then -5 else 0 end + case when length({s}) >= 10 and not regexp_matches({s}, '[_\-]{{3,}}') then 5 else 0 end)"


def _path_score(path: str) -> str:
    d = DEPTH.format(path)
    return f"(case when {PROTECTED.format(path)} then -60 else 0 end + case when needed then -40 else 0 end + case when {_any_segment(path, K.TEMP_TOKENS)} then -25 else 0 end + case when {_any_segment(path, K.PREFERRED_TOKENS)} then 10 else 0 end - case when {d} > 5 then least(({d} - 5) * 2, 20) else 0 end + case when {d} <= 4 then 5 else 0 end)"


NEEDED = f"{METADATA_SQL}, nf as (select distinct parent from f where '.' || ext in ({_quoted(K.NEEDED_EXTENSIONS)})), k as (select f.*, nf.parent is not null needed, {STEM.format(chr(34) + 'nm' + chr(34))} stem from (select *, coalesce(name, '') nm from f) f left join nf on f.parent = nf.parent)"
TOKENS = f"list_distinct(regexp_extract_all(lower({STEM.format('{0}')}), '[a-z0-9]+'))"


def _jaccard(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    return f"(case when len({a}) > 0 and len({b}) > 0 then {common}::double / (len({a}) + len({b}) - {common}) else 0.0 end)"


def _compat(a: str, b: str) -> str:
    x, y = EXT.format(a), EXT.format(b)
    rules = " or ".join(f"({x} in ({_quoted(g)}) and {y} in ({_quoted(g)}))" for g in K.EXT_COMPATIBLE)
    return f"(case when coalesce({a}, '') = coalesce({b}, '') then 1.0 when {x} <> '' and {y} <> '' and ({rules}) then 0.9 else 0.0 end)"


KNOWN = f"""{METADATA_SQL}, pr as (select distinct least(x, y) pa, greatest(x, y) pb from (select trim(path_a, ' ' || chr(9)) x, trim(path_b, ' ' || chr(9)) y from match_pairs) where x <> y and x <> '' and y <> ''),
ft as (select *, coalesce(name, '') nm, {TOKENS.format("coalesce(name, '')")} tokens from f)"""
AB = "from pr join ft a on pr.pa = a.path join ft b on pr.pb = b.path"


def _pair_parts(phash: bool = True) -> dict[str, str]:
    off = "abs(a.size - b.size)::double / greatest(a.size, b.size, 1)"
    j = _jaccard("a.tokens", "b.tokens")
    hours = "abs(a.mtime - b.mtime) / 3600"
    parts = {
        "size": f"case when a.size = b.size then 35 when {off} <= 0.05 then 15 when {off} <= 0.10 then 8 else 0 end",
        "quick": "case when a.quick_hash = b.quick_hash and a.size = b.size then 20 else 0 end",
        "token": f"case when {j} > 0.7 then 10 when {j} > 0.4 then 5 else 0 end",
        "ext": f"case when a.ext = b.ext then 12 when a.ext is not null and b.ext is not null and {_compat('a.ext', 'b.ext')} > 0 then 5 else 0 end",
        "magic": "case when a.magic_type = b.magic_type then 8 else 0 end",
        "dir": "case when a.parent = b.parent and a.parent <> '' then 5 else 0 end",
        "entropy": "case when abs(a.entropy - b.entropy) / greatest(a.entropy, b.entropy, 0.001) < 0.1 then 5 else 0 end",
        "phash": f"case when a.phash is not null and b.phash is not null then case when {DISTANCE} <= 8 then 30 when {DISTANCE} <= 16 then 18 when {DISTANCE} <= 24 then 8 else 0 end else 0 end",
        "time": f"case when a.mtime <> 0 and b.mtime <> 0 then case when {hours} < 1 then 5 when {hours} < 24 then 3 when {hours} < 168 then 1 else 0 end else 0 end",
    }
    return parts


_HEX = "case when regexp_full_match({0}, '[0-9a-fA-F]{{1,16}}') then ('0x' || {0})::ubigint end"
DISTANCE = f"coalesce(bit_count(xor({_HEX.format('a.phash')}, {_HEX.format('b.phash')}))::bigint, 64)"
OFF_PAIR = "abs(a.size - b.size)::double / greatest(a.size, b.size, 1)"


def _score(parts: dict[str, str]) -> str:
    out = f"({OFF_PAIR} > 0.20 or (a.size = b.size and (coalesce(a.partial_hash <> b.partial_hash, false) or coalesce(a.quick_hash <> b.quick_hash, false))))"
    return f"cast(case when coalesce(a.hash = b.hash, false) then 100 when {out} then 0 else least(100, {' + '.join(f'({p})' for p in parts.values())}) end as bigint)"


#: The content catalog with digests, links and exact copies set apart.
REST = f"""{CONTENTS_SQL},
x as (select * exclude (content, text), md5(content) hash, sha256(content) sha256_hash, md5(content[1:{K.QUICK_BYTES}]) quick_hash, {TOKENS.format("name")} tokens from c),
hl as (select device, inode, min(path) first_path, count(*) n_files from x group by 1, 2 having count(*) > 1),
y as (select * from x anti join hl using (device, inode)),
eg as (select size, hash, min(path) first_path, count(*) n_files from y where size > 0 group by 1, 2 having count(*) > 1),
rest as (select * from y anti join eg using (size, hash)),
near as (select a.path path_a, b.path path_b, a.size as size, {{0}} as score, {{1}} from rest a join rest b on a.size = b.size and a.quick_hash = b.quick_hash and a.path < b.path where a.size > 0)"""


def _near() -> str:
    p = _pair_parts()
    use = {k: p[k] for k in ("size", "quick", "token", "ext", "dir", "time")}
    total = " + ".join(f"({v})" for v in use.values())
    return REST.format(f"cast(least(100, {total}) as bigint)", ", ".join(f"cast({use[k]} as bigint) c_{k}" for k in ("size", "quick", "token", "ext", "time")))


def _clusters(largest: int | None = 1000) -> str:
    most = f"having count(*) <= {largest}" if largest else ""
    return "with recursive " + _near() + """, np as (select * from near where score >= 60), e as (select path_a a, path_b b from np union select path_b, path_a from np),
walk(a, b) as (select distinct a, a from e union select walk.a, e.b from walk join e on walk.b = e.a where e.b <> walk.a),
cc as (select a path, min(b) cluster from walk group by a), cn as (select cluster, count(*) n_files from cc group by 1 """ + most + """),
cs as (select cluster, max(score) score from np join cc on np.path_a = cc.path group by 1),
cl as (select cc.path, cc.cluster, n_files, score from cc join cn on cc.cluster = cn.cluster join cs on cc.cluster = cs.cluster)
"""


def _selected(mode: str) -> str:
    base, low = 15, 5
    gap = max(5, base - 10) if mode == "AGGRESSIVE" else base
    near = {"SAFE": "false", "AGGRESSIVE": f"(score >= 90 and {{copy}} and gap >= {gap})", "MEDIA": f"(media and phash is not null and kp is not null and {{dist}} <= 8 and {{copy}} and gap >= {base - 5})"}[mode]
    dist = DISTANCE.replace("a.phash", "phash").replace("b.phash", "kp")
    near = near.format(copy=COPY.format(STEM.format("coalesce(name, '')")), dist=dist)
    exact = f"case when media then {base - low} else {gap} end" if mode == "MEDIA" else str(gap)
    return f"""{MEMBERS_SQL},
kk as (select group_id, path keeper, coalesce(keep_score, -1) best, phash kp from (select *, row_number() over (partition by group_id order by coalesce(keep_score, -1) desc, coalesce(ctime, 'infinity'::double), path) rn from m) where rn = 1),
gg as (select group_id, count(*) n_files, bool_or(coalesce(category in ('Image', 'Video', 'Audio'), false)) media from m group by 1),
sg as (select m.*, keeper, best, kp, n_files, media, best - coalesce(keep_score, -1) gap from m join kk on m.group_id = kk.group_id join gg on gg.group_id = m.group_id),
sel as (select group_id, path, gap, case when n_files < 2 or coalesce(group_type = 'hardlink', false) or is_locked or is_system or path = keeper then 'KEEP'
  when group_type = 'exact' then case when gap >= {exact} then 'DELETE' else 'KEEP' end when coalesce({near}, false) then 'DELETE' else 'REVIEW' end suggestion from sg)"""


PLAN = """, plan as (select m.group_id, m.path, size, case when group_type = 'hardlink' then 'hard links share their content' when coalesce(group_type <> 'exact', true) then 'not an exact copy'
  when is_locked then 'locked' when is_system then 'system file' when is_symlink then 'symbolic link' else 'ok' end reason
  from m join sel on m.group_id = sel.group_id and m.path = sel.path where suggestion = 'DELETE')"""

UNIT = "u as (select vec_id, list_transform(embedding, lambda x: x::double) e from embeddings)"
COS = "list_cosine_similarity(a.e, b.e)"


def oracle_sql() -> dict[str, str]:
    f, m, c = f"with {METADATA_SQL} select ", f"with {MEMBERS_SQL} select ", f"with {CONTENTS_SQL} select "
    k, p, rest = f"with {NEEDED} select ", f"with {KNOWN} select a.path path_a, b.path path_b, ", "with " + REST.format("0", "0 z")
    parts = _pair_parts()
    rows = """, xr as (select m.group_id as "group", group_type as type, score, row_number() over (partition by m.group_id order by idx, m.path) file_index, sel.suggestion, coalesce(keep_score, 100) quality, m.path, coalesce(size, 0) size,
  coalesce(hash, '') hash, coalesce(magic_type, '') mime from m join sel on m.group_id = sel.group_id and m.path = sel.path) select * from xr"""
    sizes = "case when size < 1024 then size || ' B' when size < 1048576 then printf('%.1f KB', size / 1024) when size < 1073741824 then printf('%.2f MB', size / 1048576) else printf('%.2f GB', size / 1073741824) end"
    temp = r"regexp_extract(path, '^(.*)[/\\][^/\\]*$', 1)"
    q = {
        "exact_groups": f + "size, hash, count(*) n_files, (sum(size))::bigint total_bytes, (sum(size) - max(size))::bigint reclaimable_bytes from f where size > 0 and hash is not null group by 1, 2 having count(*) > 1",
        "catalog_scan": c + "path, name, ext, size from c",
        "catalog_stat": f + "file_id, path, ext, size, mtime, ctime, inode, device, hash, quick_hash, is_locked, is_system, is_symlink from f",
        "doc_text_head": f"select doc_id, md5(left(text, {K.TEXT_HEAD_CHARS})) head_md5, length(left(text, {K.TEXT_HEAD_CHARS}))::bigint head_chars from documents",
        "filter_size_range": f + "path, size from f where size between 4096 and 1048576",
        "filter_exclusions": f + f"path from f where not {_contains('lower(path)', ['cache', 'archive', '.tmp'])}",
        "filter_system_path": f + f"path, {SYSTEM.format('path')} is_system_path from f",
        "filter_temp_dirs": f + f"path from f where len(list_intersect(string_split_regex(lower({temp}), '[/\\\\]'), [{_quoted(K.TEMP_TOKENS)}])) = 0",
        "filter_groups": m + "distinct group_id, group_type, score from m where group_type = 'near' and group_id in (select group_id from m where contains(lower(path), 'documents'))",
        "revalidate_mutation": f"with {METADATA_SQL.replace('cur as', 'cur0 as').replace('f as (', 'f0 as (', 1).replace('from cur)', 'from cur0)').replace('from file_records)', chr(102) + 'rom file_records where scanned_at < timestamp ' + chr(39) + '2025-06-01' + chr(39) + ')')}, {METADATA_SQL}, j as (select o.path, o.hash, case when n.path is null then 'gone' when o.size is not distinct from n.size and coalesce(abs(o.mtime - n.mtime) <= 1, o.mtime is null and n.mtime is null) then 'unchanged' else 'changed' end state from f0 o left join f n on o.path = n.path) select path, state, case when state = 'unchanged' then hash end hash from j",
        "path_parts": f + rf"path, parent, name, {STEM.format('name')} stem, {SUFFIX.format('name')} ext, {DEPTH.format('path')}::bigint depth from (select path, parent, {NAME.format('path')} as name from f)",
        "magic_type": c + "path, case " + " ".join(f"when starts_with(hex(content), '{sig.hex().upper()}') then '{label}'" for sig, label in K.MAGIC) + " end magic_type from c",
        "category": f + f"path, {_category('magic_type', 'ext')} category from f",
        "category_histogram": f + f"{_category('magic_type', 'ext')} category, count(*) n_files from f group by 1",
        "hash_quick": c + f"path, md5(content[1:{K.QUICK_BYTES}]) quick_hash from c",
        "hash_partial": c + f"path, md5(case when size > {K.CHUNK_BYTES} then content[1:{K.CHUNK_BYTES}] || content[size - {K.CHUNK_BYTES} + 1:size] else content end) partial_hash from c",
        "hash_full": c + "path, md5(content) hash from c",
        "hash_sha256": c + "path, sha256(content) sha256_hash from c",
        "staged_hash": f"with {CONTENTS_SQL}, s as (select path, size, md5(content[1:{K.QUICK_BYTES}]) q, md5(content) h, count(*) over (partition by size) n, content from c where size > 0), t as (select *, case when n > 1 then q end quick from s), u as (select *, count(*) over (partition by size, quick) n2 from t), v as (select *, case when quick is not null and n2 > 1 and size > {K.PARTIAL_ABOVE} then md5(content[1:{K.CHUNK_BYTES}] || content[size - {K.CHUNK_BYTES} + 1:size]) end partial from u), w as (select *, count(*) over (partition by size, partial) n3 from v) select path, size, quick, partial, case when size <= {K.QUICK_BYTES} then quick when quick is not null and n2 > 1 and (size <= {K.PARTIAL_ABOVE} or n3 > 1) then h end \"full\" from w",
        "entropy": f"with {CONTENTS_SQL}, b as (select path, unnest(regexp_extract_all(hex(content[1:{K.CHUNK_BYTES}]), '..')) x from c), bn as (select path, x, count(*) n from b group by 1, 2), t as (select path, n, sum(n) over (partition by path) t from bn), h as (select path, round(-sum(n / t * log2(n / t)), 4) h from t group by 1) select c.path, coalesce(h.h, 0.0) + 0.0 entropy from c left join h on c.path = h.path",
        "name_tokens": f + f"path, array_to_string(list_sort({TOKENS.format('name')}), ' ') tokens from f",
        "name_keep_score": f + f"path, case when name is not null then {_name_score(STEM.format('name'))}::bigint end name_score from f",
        "path_keep_score": k + f"path, {_path_score('path')}::bigint path_score from k",
        "keep_score": k + f"path, greatest(0, least(200, 100 + {_name_score('stem')} + {_path_score('path')} + case when is_locked then 20 else 0 end - case when is_system then 50 else 0 end))::bigint keep_score from k",
        "format_size": f + f"path, {sizes} size_text from f",
        "format_ts": f + "path, case when mtime < 253402300800 then strftime(to_timestamp(floor(mtime)) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') else 'N/A' end mtime_text from f",
        "ext_compat": p + f"{_compat('a.ext', 'b.ext')}::double compat {AB}",
        "phash_distance": p + f"{DISTANCE} distance {AB} where a.phash is not null and b.phash is not null",
        "token_jaccard": p + f"round({_jaccard('a.tokens', 'b.tokens')}, 6) jaccard {AB}",
        "pair_score_native": p + f"{_score(parts)} score, " + ", ".join(f"cast({v} as bigint) c_{n}" for n, v in parts.items()) + f" {AB}",
        "contextual_score": p + f"{CONTEXT} context {AB}",
        "fusion_score": f"with {KNOWN}, {UNIT}, s as (select a.path path_a, b.path path_b, coalesce(a.hash = b.hash, false) same, 0.4 * case when coalesce(a.hash = b.hash, false) then 1.0 else 0.0 end + 0.35 * list_cosine_similarity(ea.e, eb.e) + 0.15 * {CONTEXT} fz, lower(a.category) cat {AB} join u ea on ea.vec_id = a.file_id % (select count(*) from embeddings) join u eb on eb.vec_id = b.file_id % (select count(*) from embeddings)) select path_a, path_b, round(fz, 6) fused, same or fz >= coalesce(case cat when 'image' then 0.92 when 'document' then 0.85 when 'video' then 0.88 when 'audio' then 0.85 when 'code' then 0.90 end, 0.85) is_duplicate from s",
        "size_block_pairs": rest + " select a.path path_a, b.path path_b, a.size size from rest a join rest b on a.size = b.size and a.path < b.path where a.size > 0",
        "near_pairs_native": "with " + _near() + " select path_a, path_b, score, c_size, c_quick, c_token, c_ext, c_time from near where score >= 60",
        "near_pairs_capped": rest + f", o as (select size, path_a, path_b, row_number() over (partition by size order by path_a, path_b) n from near) select size, path_a, path_b from o where n <= {K.MAX_PAIRS_PER_BLOCK} order by size, path_a, path_b limit {K.MAX_PAIRS}",
        "size_groups": f + "size, count(*) n_files from f where size > 0 group by 1 having count(*) > 1",
        "hardlink_groups": f + "device, inode, count(*) n_files, sum(size)::bigint total_bytes, (sum(size) - max(size))::bigint reclaimable_bytes from f where inode > 0 and device is not null group by 1, 2 having count(*) > 1",
        "exact_groups_sha256": rest + " select size, hash, sha256_hash, count(*) n_files, sum(size)::bigint total_bytes, (sum(size) - max(size))::bigint reclaimable_bytes from x where size > 0 group by 1, 2, 3 having count(*) > 1",
        "exact_remaining": rest + " select path from rest",
        "connected_components": "with recursive e0 as (select trim(path_a, ' ' || chr(9)) a, trim(path_b, ' ' || chr(9)) b from match_pairs), e as (select a, b from e0 where a <> '' and b <> '' and a <> b union select b, a from e0 where a <> '' and b <> '' and a <> b), r(a, b) as (select distinct a, a from e union select r.a, e.b from r join e on r.b = e.a where e.b <> r.a) select a id, min(b) component from r group by a",
        "near_clusters_native": _clusters() + "select path, cluster, n_files, score from cl",
        "near_clusters_uncapped": _clusters(None) + "select path, cluster, n_files, score from cl",
        "cluster_validate_uncapped": _clusters(None) + ", gd as (select cluster, count(*) good from np join cc on np.path_a = cc.path where score >= 60 group by 1) select cn.cluster, n_files, coalesce(good, 0) / (n_files * (n_files - 1) / 2) >= 0.3 valid from cn left join gd on cn.cluster = gd.cluster",
        "cluster_validate_native": _clusters() + ", gd as (select cluster, count(*) good from np join cc on np.path_a = cc.path where score >= 60 group by 1) select cn.cluster, n_files, n_files > 50 or coalesce(good, 0) / (n_files * (n_files - 1) / 2) >= 0.3 valid from cn left join gd on cn.cluster = gd.cluster",
        "all_groups_native": _clusters() + "select 'hardlink' group_type, first_path, n_files from hl union all select 'exact', first_path, n_files from eg union all select distinct 'near', cluster, n_files from cl",
        "paranoid_verify": f"with {CONTENTS_SQL}, h as (select path, size, md5(content) hash, content from c where size > 0), g as (select size, hash, min(path) first_path, arg_min(content, path) first from h group by 1, 2 having count(*) > 1) select h.path, first_path, content = first verified from h join g on h.size = g.size and h.hash = g.hash",
        "reclaimable": m + "group_id, group_type, count(*) n_files, sum(coalesce(size, 0))::bigint total_bytes, case when count(*) < 2 then 0 else sum(coalesce(size, 0)) - max(coalesce(size, 0)) end::bigint reclaimable_bytes from m group by 1, 2",
        "risk_level": m + "group_id, group_type, case when group_type = 'hardlink' then 'LOW' when coalesce(group_type <> 'exact', true) then 'HIGH' when bool_or(is_locked) then 'MEDIUM' when bool_or(is_system) then 'HIGH' else 'LOW' end risk_level from m group by 1, 2",
        "ranked_groups": m + "row_number() over (order by case when group_type in ('exact', 'hardlink') then 0 else 1 end, score desc nulls last, group_id) place, group_id, group_type, score, n_files from (select group_id, group_type, score, count(*) n_files from m group by 1, 2, 3)",
        "eval_pass_rate": f"with {MEMBERS_SQL}, fp as (select min(path) a, group_id from m group by 2), st as (select distinct least(fp.a, m.path) a, greatest(fp.a, m.path) b from m join fp on m.group_id = fp.group_id where fp.a <> m.path), ex as (select distinct least(a, b) a, greatest(a, b) b from (select trim(path_a, ' ' || chr(9)) a, trim(path_b, ' ' || chr(9)) b from match_pairs) where a <> b and a <> '' and b <> ''), t as (select count(*) expected, count(st.a) found from ex left join st on ex.a = st.a and ex.b = st.b) select expected, found, expected - found missing, case when expected > 0 then round(100 * found / expected, 2) else 0.0 end pass_rate, coalesce(found / nullif(expected, 0) * 100 >= 80, false) passed from t",
        "keeper": f"with {_selected('SAFE')} select kk.group_id, keeper, best best_score, n_files from kk join gg on kk.group_id = gg.group_id",
        "select_policy": f"with {_selected('SAFE')} select * from sel",
        "select_policy_aggressive": f"with {_selected('AGGRESSIVE')} select * from sel",
        "select_policy_media": f"with {_selected('MEDIA')} select * from sel",
        "select_policy_basic": f"with {_selected('SAFE')} select group_id, path, case when path <> keeper and (coalesce(group_type in ('exact', 'hardlink'), false) or gap >= 15) then 'DELETE' else 'KEEP' end suggestion from sg",
        "manual_overrides": f"with {_selected('SAFE')} select sel.group_id, sel.path, case m.saved when 'KEEP' then 'KEEP' when 'DELETE' then 'DELETE' when 'REVIEW' then case when suggestion = 'DELETE' then 'KEEP' else 'DELETE' end else suggestion end suggestion from sel join m on sel.group_id = m.group_id and sel.path = m.path",
        "deletion_plan": f"with {_selected('AGGRESSIVE')}{PLAN} select group_id, path, size, reason = 'ok' allowed, reason from plan",
        "deletion_plan_summary": f"with {_selected('AGGRESSIVE')}{PLAN} select reason = 'ok' allowed, reason, count(*) n_files, coalesce(sum(size), 0)::bigint total_bytes from plan group by 1, 2",
        "post_delete_groups": f"with {_selected('AGGRESSIVE')}{PLAN} select m.group_id, count(*) n_files from m anti join (select * from plan where reason = 'ok') d on m.group_id = d.group_id and m.path = d.path group by 1 having count(*) > 1",
        "report_summary": f"with {_selected('SAFE')}, g1 as (select m.group_id, group_type, count(*) n, sum(coalesce(size, 0)) - max(coalesce(size, 0)) freed, count(*) filter (suggestion = 'KEEP') k, count(*) filter (suggestion = 'REVIEW') r, count(*) filter (suggestion = 'DELETE') d from m join sel on m.group_id = sel.group_id and m.path = sel.path group by 1, 2) select count(*) n_groups, coalesce(sum(n), 0)::bigint n_files, coalesce(sum(freed), 0)::bigint reclaimable_bytes, count(*) filter (group_type = 'exact') n_exact, count(*) filter (group_type = 'near') n_near, count(*) filter (group_type = 'hardlink') n_hardlink, coalesce(sum(k), 0)::bigint n_keep, coalesce(sum(r), 0)::bigint n_review, coalesce(sum(d), 0)::bigint n_delete from g1",
        "summary_rollup": m + "group_type, category, grouping(group_type, category)::bigint as level, count(*) n_files, sum(size)::bigint total_bytes from (select coalesce(group_type, 'none') group_type, coalesce(category, 'none') category, coalesce(size, 0) size from m) group by rollup (group_type, category)",
        "scan_stats": f"with {MEMBERS_SQL} select (select count(*) from f) total_files, (select coalesce(sum(size), 0)::bigint from f) total_bytes, round((select coalesce(sum(size), 0) from f) / 1048576, 2)::double total_mb, (select count(distinct group_id) from m) total_groups, (select count(*) from m) files_in_groups",
        "export_rows": f"with {_selected('SAFE')}{rows}",
        "cosine_similarity": f"with {UNIT} select a.vec_id, round({COS}, 6) similarity from u a join u b on a.vec_id + 1 = b.vec_id",
        "knn_topk": f"with {UNIT}, s as (select a.vec_id query_id, b.vec_id vec_id, {COS} s from u a join u b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0), o as (select *, row_number() over (partition by query_id order by round(s, 9) desc, vec_id) place from s) select query_id, vec_id, place, round(s, 6) similarity from o where place <= 5",
        "semantic_pairs": f"with {UNIT} select a.vec_id query_id, b.vec_id vec_id, round({COS}, 6) similarity from u a join u b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0 and round({COS}, 6) >= 0.4",
        "log_tags": "select case " + " ".join(f"when contains(lower(l), '{w}') then '{t}'" for w, t in LOG_TAGS) + " else 'debug' end tag, count(*) n_lines from (select unnest(string_split(text, chr(10))) l from documents) group by 1",
        "recent_file": f + "parent, path from (select *, row_number() over (partition by parent order by mtime desc, path desc) rn from f where mtime is not null) where rn = 1",
        "group_navigation": m + "group_id, lag(group_id) over w previous_id, lead(group_id) over w next_id from (select distinct group_id, group_type, score from m) window w as (order by case when group_type in ('exact', 'hardlink') then 0 else 1 end, score desc nulls last, group_id)",
        "watch_changes": "with e as (select user_id::varchar as key, ts, event_id seq, event_type = 'error' gone, md5(props) dg from events where user_id is not null and (event_type = 'error' or props is not null)), l as (select *, lag(case when not gone then dg end) over (partition by key order by ts, seq) b from e), v as (select *, case when gone and b is not null then 'deleted' when not gone and b is null then 'created' when not gone and b <> dg then 'modified' end event from l) select key, ts, seq, event from v where event is not null",
        "p5_found": NEWEST_SQL,
    }
    return q


_CTX_STEM = r"(case when regexp_matches({0}, '^(.+)\.[^.]*$') then regexp_extract({0}, '^(.+)\.[^.]*$', 1) else {0} end)"
CONTEXT = f"round(least(1.0, case when a.parent = b.parent then 0.5 when starts_with(a.path, '/') and starts_with(b.path, '/') then 0.2 else 0.0 end + case when abs(coalesce(a.mtime, 0) - coalesce(b.mtime, 0)) < 60 then 0.3 else 0.0 end + case when lower(a.nm) = lower(b.nm) then 0.2 when {_CTX_STEM.format('a.nm')} = {_CTX_STEM.format('b.nm')} then 0.1 else 0.0 end), 6)::double"
