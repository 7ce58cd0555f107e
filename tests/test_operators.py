import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.graphs import components, shapes
from twinsift.functions import features
from twinsift.operators import changes, filters, groups, pairs, policy, report, vectors
from twinsift.operators.components import connected_components
from twinsift.settings import PROFILES, Settings

MEMBER = "group_id string, group_type string, score long, path string, name string, ext string, size long, keep_score long, ctime double, category string, phash string, hash string, magic_type string, is_locked boolean, is_system boolean, is_symlink boolean, idx long, parent string"
COLUMNS = [c.split()[0] for c in MEMBER.split(", ")]


def members(spark, *rows):
    base = {"group_id": "g", "group_type": "exact", "score": 100, "name": "a.txt", "ext": "txt", "size": 10, "keep_score": 100, "ctime": 1.0, "is_locked": False, "is_system": False, "is_symlink": False, "idx": 0, "parent": "/d"}
    return spark.createDataFrame([tuple((base | r).get(c) for c in COLUMNS) for r in rows], MEMBER)


def marks(df, *cols):
    return {r.path: r.suggestion for r in df.collect()}


@pytest.mark.parametrize(("name", "edges"), list(shapes()))
def test_components_equal_union_find(spark, name, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.id: r.component for r in connected_components(df, "a", "b").collect()} == components(edges)


def test_filters(spark):
    f = spark.createDataFrame([("/a/Temp/x", 0), ("/lib/y", 1), ("/library/z", 5), ("/home/template/w", 9), ("/home/v", None)], "path string, size long")
    assert sorted(r.path for r in filters.size_between(f).collect()) == ["/home/template/w", "/lib/y", "/library/z"]
    assert [r.path for r in filters.size_between(f, 1, 1).collect()] == ["/lib/y"]
    assert sorted(r.path for r in filters.outside_system(f).collect()) == ["/a/Temp/x", "/home/template/w", "/home/v"]
    assert sorted(r.path for r in filters.outside_temp(f).collect()) == ["/home/template/w", "/home/v", "/lib/y", "/library/z"]
    assert sorted(r.path for r in filters.excluding(f, ["TEMP", "lib"]).collect()) == ["/home/v"]
    assert filters.excluding(f, []).count() == 5


def test_revalidation(spark):
    s = "path string, size long, mtime double, hash string"
    old = spark.createDataFrame([("same", 1, 5.0, "h"), ("near", 1, 5.0, "h"), ("late", 1, 5.0, "h"), ("grown", 1, 5.0, "h"), ("gone", 1, 5.0, "h"), ("null", None, None, "h")], s)
    new = spark.createDataFrame([("same", 1, 5.0, "h"), ("near", 1, 6.0, "h"), ("late", 1, 6.1, "h"), ("grown", 2, 5.0, "h"), ("new", 1, 5.0, "h"), ("null", None, None, "h")], s)
    out = {r.path: (r.state, r.hash) for r in filters.revalidated(old, new).collect()}
    assert out == {"same": ("unchanged", "h"), "near": ("unchanged", "h"), "late": ("changed", None), "grown": ("changed", None), "gone": ("gone", None), "null": ("unchanged", "h")}


def test_staged_digests_leave_undecided_files_only(spark):
    import hashlib

    big = b"a" * 1_048_577
    rows = {"alone": b"q" * 7, "s1": b"x" * 100, "s2": b"x" * 100, "s3": b"y" * 100, "m1": b"h" * 5000, "m2": b"h" * 4999 + b"!", "b1": big, "b2": big, "b3": big[:600_000] + b"!" + big[600_001:], "empty": b""}
    df = spark.createDataFrame([(k, len(v), bytearray(v)) for k, v in rows.items()], "path string, size long, content binary")
    out = {r.path: r for r in groups.staged_digests(df).collect()}
    assert "empty" not in out and out["alone"].quick is None and out["alone"].full is None
    for k in ("s1", "s2", "s3"):
        assert out[k].full == out[k].quick == hashlib.md5(rows[k]).hexdigest() and out[k].partial is None
    assert out["m1"].full != out["m2"].full and out["m1"].quick == out["m2"].quick
    assert out["b1"].full == out["b2"].full != out["b3"].full and out["b1"].partial == out["b3"].partial


def test_groups_ignore_nulls_and_empty_tables(spark):
    f = spark.createDataFrame([("a", 1, "h"), ("b", 1, "h"), ("c", 2, "h"), ("d", 1, None), ("e", 1, None), ("f", 0, "z"), ("g", 0, "z")], "path string, size long, hash string")
    assert [tuple(r) for r in groups.exact_groups(f, "hash").collect()] == [(1, "h", 2, 2, 1)]
    assert groups.exact_groups(f.limit(0), "hash").count() == 0
    assert sorted(r.path for r in groups.without_members(f, groups.exact_groups(f, "hash"), "size", "hash").collect()) == ["c", "d", "e", "f", "g"]


@pytest.mark.parametrize(
    ("mode", "row", "mark"),
    [
        ("SAFE", {"keep_score": 85}, "DELETE"), ("SAFE", {"keep_score": 86}, "KEEP"), ("SAFE", {"keep_score": 10, "is_locked": True}, "KEEP"),
        ("SAFE", {"keep_score": 10, "is_system": True}, "KEEP"), ("SAFE", {"keep_score": 10, "group_type": "hardlink"}, "KEEP"),
        ("SAFE", {"keep_score": 10, "group_type": "near"}, "REVIEW"), ("AGGRESSIVE", {"keep_score": 95}, "DELETE"), ("AGGRESSIVE", {"keep_score": 96}, "KEEP"),
        ("AGGRESSIVE", {"keep_score": 95, "group_type": "near", "score": 90, "name": "a copy.txt"}, "DELETE"),
        ("AGGRESSIVE", {"keep_score": 95, "group_type": "near", "score": 89, "name": "a copy.txt"}, "REVIEW"),
        ("AGGRESSIVE", {"keep_score": 95, "group_type": "near", "score": 90}, "REVIEW"),
        ("MEDIA-FOCUSED", {"keep_score": 90, "category": "Image"}, "DELETE"), ("MEDIA-FOCUSED", {"keep_score": 90}, "KEEP"),
        ("MEDIA-FOCUSED", {"keep_score": 90, "group_type": "near", "category": "Image", "phash": "ff", "name": "a copy.png"}, "DELETE"),
        ("MEDIA-FOCUSED", {"keep_score": 90, "group_type": "near", "category": "Image", "phash": "ffff", "name": "a copy.png"}, "REVIEW"),
        ("MEDIA-FOCUSED", {"keep_score": 90, "group_type": "near", "category": "Image", "name": "a copy.png"}, "REVIEW"),
        ("SAFE", {"keep_score": None}, "DELETE"), ("SAFE", {"keep_score": 10, "group_type": None}, "REVIEW"),
    ],
)
def test_selection_rules(spark, mode, row, mark):
    shared = {k: row[k] for k in ("group_type", "score") if k in row}
    m = members(spark, {"path": "/k", "phash": "00"} | shared, {"path": "/x"} | row)
    assert marks(policy.selected(m, Settings(cleanup_mode=mode))) == {"/k": "KEEP", "/x": mark}


def test_keeper_ties_and_single_members(spark):
    m = members(spark, {"path": "/c", "ctime": 2.0}, {"path": "/b", "ctime": 1.0}, {"path": "/a", "ctime": 1.0}, {"path": "/z", "ctime": None, "keep_score": None}, {"group_id": "one", "path": "/o"})
    assert {r.group_id: (r.keeper, r.n_files) for r in policy.keepers(m).collect()} == {"g": ("/a", 4), "one": ("/o", 1)}
    assert policy.selected(m.limit(0)).count() == 0


def test_safety_of_plans(spark):
    rows = [{"group_id": f"{t}{i}", "group_type": t, "path": f"/{t}{i}{j}", "keep_score": 100 - 40 * j, "is_locked": i == 1 and j == 1, "is_system": i == 2 and j == 1, "is_symlink": i == 3 and j == 1, "name": "a copy.txt"} for t in ("exact", "near", "hardlink") for i in range(5) for j in range(3)]
    m = members(spark, *rows)
    for mode in ("SAFE", "AGGRESSIVE", "MEDIA-FOCUSED"):
        sel = policy.selected(m, Settings(cleanup_mode=mode))
        kept = {r.group_id for r in sel.where(F.col("suggestion") == "KEEP").select("group_id").distinct().collect()}
        assert kept == {r["group_id"] for r in rows}
        plan = policy.deletion_plan(m, sel).collect()
        allowed = [r for r in plan if r.allowed]
        assert allowed and all(r.group_id.startswith("exact") for r in allowed)
        assert not {"/exact11", "/exact21", "/exact31"} & {r.path for r in allowed}
    left = policy.after_deletion(m, policy.deletion_plan(m, policy.selected(m)))
    assert all(r.n_files > 1 for r in left.collect())


def test_overrides(spark):
    sel = spark.createDataFrame([("g", p, s) for p, s in (("a", "KEEP"), ("b", "DELETE"), ("c", "REVIEW"), ("d", "KEEP"))], "group_id string, path string, suggestion string")
    o = spark.createDataFrame([("g", "a", "toggle"), ("g", "b", "TOGGLE"), ("g", "c", "TOGGLE"), ("g", "d", "REVIEW"), ("h", "a", "DELETE")], "group_id string, path string, action string")
    assert marks(policy.overridden(sel, o)) == {"a": "DELETE", "b": "KEEP", "c": "DELETE", "d": "REVIEW"}


def test_risk(spark):
    m = members(spark, {"group_id": "l", "group_type": "hardlink", "path": "/1", "is_locked": True}, {"group_id": "n", "group_type": "near", "path": "/2"}, {"group_id": "b", "path": "/3", "is_locked": True, "is_system": True}, {"group_id": "s", "path": "/4", "is_system": True}, {"group_id": "e", "path": "/5"})
    assert {r.group_id: r.risk_level for r in groups.risk_levels(m).collect()} == {"l": "LOW", "n": "HIGH", "b": "MEDIUM", "s": "HIGH", "e": "LOW"}


def cluster_rows(sizes):
    return [(f"{s}/{i}", str(s), s) for s in sizes for i in range(s)]


def test_validation_of_clusters(spark):
    c = spark.createDataFrame(cluster_rows([5, 50, 51]), "path string, cluster string, n_files long")
    good = [(f"5/{a}", f"5/{b}", 70) for a, b in itertools.islice(itertools.combinations(range(5), 2), 3)] + [("50/0", "50/1", 90), ("51/0", "51/1", 90), ("5/3", "5/4", 59)]
    p = spark.createDataFrame(good, "path_a string, path_b string, score long")
    assert {r.cluster: r.valid for r in pairs.validated(c, p).collect()} == {"5": True, "50": False, "51": True}


def test_large_clusters_are_dropped(spark):
    p = spark.createDataFrame([("a0", f"a{i}", 80) for i in range(1, 5)] + [("b0", "b1", 90)], "path_a string, path_b string, score long")
    assert {(r.path, r.cluster, r.score) for r in pairs.near_clusters(p, largest=4).collect()} == {("b0", "b0", 90), ("b1", "b0", 90)}


def test_candidates_with_missing_digests(spark):
    f = spark.createDataFrame([("a", 5, "q"), ("b", 5, "q"), ("c", 5, "r"), ("d", 5, None), ("e", 5, None), ("f", 6, "q"), ("g", None, "q"), ("h", 0, "q"), ("i", 0, "q")], "path string, size long, quick_hash string")
    got = {(r.a.path, r.b.path) for r in pairs.near_candidates(f).collect()}
    assert got == {("a", "b"), ("a", "d"), ("b", "d"), ("c", "d"), ("a", "e"), ("b", "e"), ("c", "e"), ("d", "e")}


def test_pair_caps(spark):
    p = spark.createDataFrame([(s, f"a{i}", "b") for s in (1, 2) for i in range(5)], "size long, path_a string, path_b string")
    assert [tuple(r) for r in pairs.capped(p, 2, 3).collect()] == [(1, "a0", "b"), (1, "a1", "b"), (2, "a0", "b")]


def test_bigram_pairs_equal_brute_force(spark):
    import random

    r = random.Random(1)
    names = ["".join(r.choice("abcab_1") for _ in range(r.randint(0, 14))) for _ in range(120)] + ["report_2020.txt", "report_2021.txt", "Report_2020.txt", None, "x"]

    def grams(n):
        return {g: sum(n[i : i + 2] == g for i in range(len(n) - 1)) for g in {n[i : i + 2] for i in range(len(n) - 1)}}

    def cos(a, b):
        return sum(a[g] * b.get(g, 0) for g in a) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    low = sorted({n.lower() for n in names if n and len(n) > 1})
    for t in (0.6, 0.85):
        want = {(a, b) for a, b in itertools.combinations(low, 2) if cos(grams(a), grams(b)) > t + 1e-9}
        got = {(x.name_a, x.name_b) for x in pairs.bigram_pairs(spark.createDataFrame([(n,) for n in names], "name string"), t).collect()}
        assert {p for p in got if cos(grams(p[0]), grams(p[1])) > t + 1e-9} == want


def test_named_pairs_are_scored_pairs_of_files(spark):
    row = {"parent": "/d", "ext": "txt", "size": 100, "quick_hash": "q", "mtime": 1e9, "magic_type": "m"}
    rows = [{"path": "/1", "name": "report_2020.txt"}, {"path": "/2", "name": "Report_2021.txt"}, {"path": "/3", "name": "report_2020.txt", "size": 97, "quick_hash": "z"}, {"path": "/4", "name": "report_2020.txt", "size": 60}, {"path": "/5", "name": "zebra.txt"}, {"path": "/6", "name": "report_2020.txt", "quick_hash": "y"}, {"path": "/7", "name": "report_2020.txt", "size": None}]
    names = ["path", "name", *row]
    f = spark.createDataFrame([tuple((row | r)[c] for c in names) for r in rows], "path string, name string, parent string, ext string, size long, quick_hash string, mtime double, magic_type string")
    got = {(r.path_a, r.path_b, r.score) for r in pairs.named_pairs(f).collect()}
    assert got == {("/1", "/2", 100), ("/1", "/3", 70), ("/2", "/3", 70), ("/3", "/6", 70)}
    assert got == {(r.path_a, r.path_b, r.score) for r in pairs.near_pairs(f.alias("x").select(F.struct("*").alias("a")).crossJoin(f.select(F.struct("*").alias("b"))).where("a.path < b.path and a.name not like 'z%' and b.name not like 'z%'").select(*[F.struct(*[F.col(f"{n}.{c}") for c in names], *[F.lit(None).cast(k).alias(c) for c, k in pairs.SCORED.items() if c not in names]).alias(n) for n in "ab"])).collect()}


def test_named_pairs_equal_brute_force(spark):
    import random
    from collections import Counter

    r = random.Random(5)
    stems = ["report_2020", "Report_2021", "report2020", "photo (1)", "aaaaaa", "aaab", "ab", "x"]
    value = {"name": lambda: r.choice(stems) + r.choice(["", ".txt"]), "parent": lambda: r.choice(["/d", ""]), "ext": lambda: r.choice(["txt", "md", None]), "size": lambda: r.choice([0, 100, 97, 92, 85, 10_000, None]), "mtime": lambda: r.choice([1e9, 1e9 + 3599, 1e9 + 90_000, 1.1e9, None]), "magic_type": lambda: r.choice(["m", None]), "hash": lambda: r.choice(["h", None, None, None]), "quick_hash": lambda: r.choice(["q", "r", None])}
    rows = [(f"/{i}", *[v() for v in value.values()]) for i in range(90)]
    f = spark.createDataFrame(rows, "path string, name string, parent string, ext string, size long, mtime double, magic_type string, hash string, quick_hash string")
    row = lambda n: pairs.scored_columns(f).select(F.struct("*").alias(n))
    count = lambda n: Counter(map(str.__add__, n, n[1:]))
    cos = lambda a, b: sum(a[g] * b[g] for g in a) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    grams = {x[0]: count(x[1].lower()) for x in rows}
    like = {(a, b) for a, b in itertools.permutations(grams, 2) if grams[a] and grams[b] and cos(grams[a], grams[b]) > 0.85}
    # equal digests tell that files are alike, whatever their sizes
    assert {(x[7], x[4]) for x in rows} >= {("h", 100), ("h", 10_000), ("h", None)}
    for least in (58, 66, 70):
        every = pairs.near_pairs(row("a").crossJoin(row("b")).where("a.path < b.path"), least)
        want = {(x.path_a, x.path_b, x.score) for x in every.collect() if (x.path_a, x.path_b) in like}
        assert want and {(x.path_a, x.path_b, x.score) for x in pairs.named_pairs(f, min_score=least).collect()} == want


@pytest.mark.parametrize("least", [0, 30, 50, 55, 56, 70])
def test_named_pairs_of_any_score_and_odd_names(spark, least):
    """Also from scores on that files without a common column reach, and of names that are longer in lower case."""
    import random
    from collections import Counter

    r = random.Random(9)
    names = ["\u0130", "\u0130", "x", "", None, "\U0001f4c4\U0001f4c4", "\U0001f4c4\U0001f4c4", "report_2020.txt", "Report_2021.txt", "REPORT_2020.TXT", "photo (1)"]
    value = {"parent": lambda: r.choice(["/d", ""]), "ext": lambda: r.choice(["txt", "md", None]), "size": lambda: r.choice([100, 97, 92, 10_000, None]), "mtime": lambda: r.choice([1e9, 1e9 + 3599, 1.1e9, None]), "magic_type": lambda: r.choice(["m", None]), "quick_hash": lambda: r.choice(["q", "r", None])}
    rows = [(f"/{i:02}", names[i % len(names)], *[v() for v in value.values()]) for i in range(66)]
    f = spark.createDataFrame(rows, "path string, name string, parent string, ext string, size long, mtime double, magic_type string, quick_hash string")
    row = lambda n: pairs.scored_columns(f).select(F.struct("*").alias(n))
    count = lambda n: Counter(map(str.__add__, n, n[1:]))
    cos = lambda a, b: sum(a[g] * b[g] for g in a) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    grams = {x[0]: count((x[1] or "").lower()) for x in rows}
    like = {(a, b) for a, b in itertools.combinations(grams, 2) if grams[a] and grams[b] and cos(grams[a], grams[b]) > 0.85}
    every = pairs.near_pairs(row("a").crossJoin(row("b")).where("a.path < b.path"), least)
    want = {(x.path_a, x.path_b, x.score) for x in every.collect() if (x.path_a, x.path_b) in like}
    assert any(int(a[1:]) % len(names) < 2 for a, _, _ in want)
    assert {(x.path_a, x.path_b, x.score) for x in pairs.named_pairs(f, min_score=least).collect()} == want


def test_named_pairs_of_very_long_names(spark):
    import pyarrow as pa

    f = spark.createDataFrame([(f"/{i}", "a" * 60_000, "txt", 100, "q") for i in range(2)], "path string, name string, ext string, size long, quick_hash string")
    assert [(r.path_a, r.path_b, r.score) for r in pairs.named_pairs(f).collect()] == [("/0", "/1", 92)]
    long = "".join(map(chr, range(0x4E00, 0x4E00 + 5_000)))
    [out] = pairs._meeting_places({}, 0.85)([pa.RecordBatch.from_pydict({"id": [0, 1], "name": [long, long[:4_500]], "block": [1, 1], "shared": [1, 1]})])
    a, b = map(set, out.column("keys").to_pylist())
    assert a & b and len(a) == 1 + int((1 - 0.85**2) * 4_999)


def test_like_names_share_a_meeting_place():
    import random
    from collections import Counter

    import pyarrow as pa

    r = random.Random(2)
    parts = ["rek", "nam", "lik", "von", "bek", "aa", "_2", ".txt"]
    names = ["".join(r.choices(parts, k=r.randint(1, 7))) for _ in range(250)] + ["ab", "aba", "aaaaaa", "aaaa"]
    count = lambda n: Counter(map(str.__add__, n, n[1:]))
    cos = lambda a, b: sum(a[g] * b[g] for g in a) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    like = [(i, j) for i, j in itertools.combinations(range(len(names)), 2) if cos(count(names[i]), count(names[j])) > 0.85]
    ranks = {g: i for i, (g, _) in enumerate(Counter(g for n in names for g in count(n)).most_common(20))}
    met = []
    for shared in (0, 1, 2, 3):
        rows = pa.RecordBatch.from_pydict({"id": list(range(len(names))), "name": names, "block": [-7] * len(names), "shared": [shared] * len(names)})
        [out] = pairs._meeting_places(ranks, 0.85)([rows])
        keys = [set(k) for k in out.column("keys").to_pylist()]
        assert all(keys[i] & keys[j] for i, j in like)
        assert out.column("norm2").to_pylist() == [sum(v * v for v in count(n).values()) for n in names]
        met.append(sum(bool(a & b) for a, b in itertools.combinations(keys, 2)))
    assert len(like) > 100 and met[0] > met[1] > met[2] > met[3]


def test_names_of_file_records_agree_from_85_percent_on(spark, data):
    from twinsift.queries import queries

    paths = {r.path for r in queries()["catalog_stat"](spark, data).select("path").collect()}
    got = queries()["name_bigram_pairs"](spark, data)
    assert {"path_a", "path_b", "score"} <= set(got.columns)
    assert all(r.score >= 70 and {r.path_a, r.path_b} <= paths for r in got.collect())


def test_found_share(spark):
    s = "a string, b string"
    e = spark.createDataFrame([(f"x{i}", f"y{i}") for i in range(5)] + [("y0", "x0"), (None, "q")], s)
    f = spark.createDataFrame([(f"y{i}", f"x{i}") for i in range(4)] + [("z", "w")], s)
    assert tuple(pairs.found_share(e, f).first()) == (5, 4, 1, 80.0, True)
    assert tuple(pairs.found_share(e.limit(0), f).first()) == (0, 0, 0, 0.0, False)


def test_export(spark):
    m = members(spark, {"path": "/a", "idx": 1}, {"path": "/b", "idx": 0, "size": None, "keep_score": None})
    rows = report.export_rows(m, policy.selected(m).limit(0))
    assert [(r.file_index, r.path, r.suggestion, r.quality, r.size, r.hash) for r in rows.orderBy("file_index").collect()] == [(1, "/b", "KEEP", 100, 0, ""), (2, "/a", "KEEP", 100, 10, "")]
    [n] = report.export_nested(rows).collect()
    assert [f.path for f in n.files] == ["/b", "/a"] and n.reclaimable_bytes == 0


def test_changes(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [("k", t, i, op, d) for i, (op, d) in enumerate([("put", "1"), ("put", "1"), ("put", "2"), ("delete", None), ("delete", None), ("put", "2")])] + [(None, t, 9, "put", "1"), ("n", t, 0, "put", None)]
    out = changes.changes(spark.createDataFrame(rows, "key string, ts timestamp_ntz, seq long, op string, digest string"))
    assert [(r.seq, r.event) for r in out.orderBy("seq").collect()] == [(0, "created"), (2, "modified"), (3, "deleted"), (5, "created")]


def test_neighbours(spark, data):
    v = spark.read.parquet(f"{data}/embeddings.parquet")
    q = v.where(F.col("vec_id") % 100 == 0)
    x = {r.vec_id: np.array(r.embedding, dtype=float) for r in v.collect()}
    exact = {(r.query_id, r.place): r.vec_id for r in vectors.knn(q, v).collect()}
    for i in {k[0] for k in exact}:
        s = {j: float(x[i] @ w / np.linalg.norm(x[i]) / np.linalg.norm(w)) for j, w in x.items() if j != i}
        assert [exact[i, k + 1] for k in range(5)] == sorted(s, key=lambda j: (-round(s[j], 9), j))[:5]
    near = {(r.query_id, r.vec_id) for r in vectors.ann(q, v).collect()}
    assert len(near & {(k[0], j) for k, j in exact.items()}) / len(exact) >= 0.9


def test_vectors_without_length(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, []), (4, [1.0, 0.0]), (5, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.similarity) for r in vectors.knn(v, v).orderBy("query_id").collect()] == [(4, 5, 1.0), (5, 4, 1.0)]
    assert vectors.knn(v.limit(0), v).count() == 0


def test_settings():
    assert PROFILES["max_safe"].min_score == 90 and PROFILES["performance"].cleanup_mode == "AGGRESSIVE"
    with pytest.raises(ValueError, match="unknown"):
        Settings().with_changes(colour=1)
    with pytest.raises(ValueError, match="cleanup_mode"):
        Settings(cleanup_mode="WILD")


def test_places_and_predecessors_of_a_group_over_many_partitions(spark):
    from pyspark.sql import Window

    from twinsift.operators.ranks import place_within, previous

    df = spark.range(5_000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 50).cast("int").alias("g"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("a"), "id")
    w = Window.partitionBy("g").orderBy("a", "id")
    want = sorted(map(tuple, df.select("g", "a", "id", F.row_number().over(w), F.lag("id").over(w)).collect()), key=lambda r: r[2])
    places = place_within(df, ["g"], [F.col("a").asc(), F.col("id").asc()], "n")
    got = previous(places, ["g"], ["a", "id"], "id", "p")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == want
    assert place_within(df.limit(0), ["g"], [F.col("id").asc()], "n").count() == 0


def test_clusters_without_a_limit(spark):
    p = spark.createDataFrame([(f"p{i:04d}", f"p{i + 1:04d}", 80) for i in range(1100)], "path_a string, path_b string, score bigint")
    assert pairs.near_clusters(p).count() == 0
    c = pairs.near_clusters(p, largest=None)
    assert c.count() == 1101
    assert pairs.validated(c, p).first().valid and not pairs.validated(c, p, largest=None).first().valid


def test_proof_of_copies(spark):
    rows = [("/a", 3, "h", "s"), ("/b", 3, "h", "s"), ("/c", 3, "h", "t"), ("/d", 3, "h", None), ("/e", 0, "h", "s"), ("/f", 3, None, "s"), ("/g", 9, "x", "s")]
    f = spark.createDataFrame(rows, "path string, size bigint, hash string, sha256_hash string")
    assert {tuple(r) for r in groups.verified(f).collect()} == {("/a", "/a", True), ("/b", "/a", True), ("/c", "/a", False), ("/d", "/a", False)}
    c = f.select("path", "size", "hash", F.when(F.col("path") == "/c", F.lit(b"abd")).otherwise(F.lit(b"abc")).alias("content"))
    assert {r.path for r in groups.verified(c).where("verified").collect()} == {"/a", "/b", "/d"}
    assert groups.verified(f.limit(0)).count() == 0


def test_semantic_points_lift_a_pair(spark):
    row = "struct<path:string,parent:string,name:string,ext:string,size:bigint,mtime:double,hash:string,partial_hash:string,quick_hash:string,magic_type:string,entropy:double,phash:string,tokens:array<string>,embedding:array<float>>"
    one = lambda p, e: (p, "/x", "abc", "txt", 10, None, None, None, None, None, None, None, ["abc"], e)
    c = spark.createDataFrame([(10, one("/a", [1.0, 0.0]), one("/b", [1.0, 0.1])), (10, one("/c", None), one("/d", [1.0, 0.1]))], f"size bigint, a {row}, b {row}")
    plain, both = (pairs.near_pairs(c, 50, with_names=False, semantic=x).collect() for x in (False, True))
    score = {r.path_a: r.score for r in both}
    assert score["/a"] == min(100, plain[0].score + 40) and score["/c"] == plain[1].score


def test_times_that_no_text_can_write(spark):
    f = spark.createDataFrame([(None,), (0.0,), (1e15,), (float("nan"),), (5e9,)], "t double")
    assert [r[0] for r in f.select(features.format_ts(F.col("t"))).collect()] == ["N/A"] * 4 + ["2128-06-11 08:53:20"]
