"""The training-data queries against SQL, and their operators against brute force on small dirty tables."""

import datetime as dt
import random
import re

import pytest
from tests.check import same_rows
from tests.graphs import components, shapes
from twinsift.llm import queries as llm
from twinsift.llm.batches import BatchIndex, batch_matches, match_batches
from twinsift.llm.linkage import min_labels, path_groups
from twinsift.llm.minmax import min_max_bands, near_name_groups, near_names
from twinsift.llm.survivors import surviving_fields
from twinsift.plans.runtime import Workspace

SQL = llm.oracle_sql()
T = dt.datetime(2025, 1, 1)
FILES = "file_id long, path string, name string, ext string, size long, hash string, partial_hash string, keep_score int, mtime double, category string, scanned_at timestamp_ntz, extra int"


def files(spark, *rows):
    cols = [c.split()[0] for c in FILES.split(", ")]
    return spark.createDataFrame([tuple(({"scanned_at": T, "extra": 1} | r).get(c) for c in cols) for r in rows], FILES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    same_rows(llm.queries()[name](spark, data), SQL[name], data)


# problem 1


def groups(spark, *rows):
    return spark.createDataFrame([(*r[:3], r[3] if len(r) > 3 else T, "x") for r in rows], "group_id long, files array<string>, suggestions map<int,string>, saved_at timestamp_ntz, extra string")


def survivors(g, f):
    return {(r.group_id, r.field_name): r.file_id for r in surviving_fields(g, f).collect()}


def test_fields_come_from_the_most_trusted(spark):
    f = files(
        spark,
        {"file_id": 1, "path": "/a", "keep_score": 90, "mtime": 5.0, "category": "unknown"},
        {"file_id": 2, "path": "/b", "keep_score": 150, "mtime": 9e12, "category": " "},
        {"file_id": 3, "path": "/c", "keep_score": 201, "mtime": 7.0, "category": "Image"},
        {"file_id": 3, "path": "/c", "keep_score": 0, "mtime": 7.0, "category": "Old", "scanned_at": T - dt.timedelta(1)},
        {"file_id": 4, "path": "/d", "category": None},
    )
    g = groups(spark, (1, ["/b", " /a\t", "/c", "/gone", None, "", "/a"], {1: " keep", 2: "DELETE"}), (2, ["/a", "/a", "/gone"], {}), (3, ["/d", "/a"], {0: "keep"}), (4, None, None), (5, [], {}), (6, ["/a", "/b"], None))
    assert survivors(g, f) == {
        (1, "path"): 1, (1, "keep_score"): 2, (1, "mtime"): 3, (1, "category"): 3,
        (3, "path"): 4, (3, "keep_score"): 1, (3, "mtime"): 1,
        (6, "path"): 2, (6, "keep_score"): 2, (6, "mtime"): 1,
    }


def test_survivors_of_repeats_ties_and_nothing(spark):
    f = files(spark, *[{"file_id": i, "path": f"/{i}", "keep_score": 5, "mtime": 1.0, "category": "x"} for i in (2, 1, 3)])
    g = groups(spark, (1, ["/3", "/2", "/1"], {0: "review", 1: None}, T), (1, ["/3", "/2", "/1"], {0: "review", 1: None}, T), (1, ["/2", "/1"], {}, T - dt.timedelta(1)))
    assert survivors(g, f) == dict.fromkeys([(1, x) for x in ("path", "keep_score", "mtime", "category")], 3)
    assert survivors(g.limit(0), f) == {} and survivors(g, f.limit(0)) == {}


def test_one_group_with_most_members(spark):
    n = 5_000
    f = spark.range(n).selectExpr("id as file_id", "concat('/p', id) as path", "cast(id % 100 as int) as keep_score", "double(1) as mtime", "'c' as category", "timestamp_ntz'2025-01-01' as scanned_at")
    g = spark.createDataFrame([(1, [f"/p{i}" for i in range(n)], {7: "KEEP"}, T)], "group_id long, files array<string>, suggestions map<int,string>, saved_at timestamp_ntz")
    out = surviving_fields(g, f)
    assert {r.field_name: r.file_id for r in out.collect()} == {"path": 7, "keep_score": 1099, "mtime": 7, "category": 7} | {"keep_score": min((f"/p{i}", i) for i in range(99, n, 100))[1]}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


# problem 2


def brute_batches(seen, incoming):
    digits = lambda h: next((m for m in re.findall(r"(?<![0-9a-f])[0-9a-f]{32}(?![0-9a-f])", (h or "").lower().replace("-", ""))), None)
    good = lambda h: d if (d := digits(h)) and d != d[0] * 32 else None
    known = [(i, good(h), good(p)) for i, h, p in seen] + sorted({(i, good(h), good(p)) for i, _, h, p in incoming})
    out = set()
    for i, _, h, p in incoming:
        for kind, k, v in (("exact", 1, good(h)), ("near", 2, good(p))):
            before = [x[0] for x in known if v and x[k] == v and (x[0] < i if x[0] >= 1000 else True)]
            if before:
                out.add((min(before), i, kind))
                break
    return out


@pytest.mark.parametrize("seed", range(2))
def test_batches_equal_brute_force(spark, seed):
    r = random.Random(seed)
    pool = [f"{k:032x}"[:31] + "a" for k in range(12)]
    dirty = lambda: r.choice([None, "", "-", "0" * 32, *[r.choice(["{}", "md5:{}", " {}\t", "0x{}"]).format(p.upper() if r.random() < 0.3 else p) for p in r.sample(pool, 3)]])
    seen = [(i, dirty(), dirty()) for i in range(6)]
    once = [(1000 + i, dirty(), dirty()) for i in range(40)]
    incoming = [(i, r.choice([None, 1, 2, 3, 4]), h, p) for i, h, p in once] + [(i, 5, h, p) for i, h, p in r.sample(once, 8)]
    f = files(spark, *[{"file_id": i, "hash": h, "partial_hash": p} for i, h, p in seen])
    inc = spark.createDataFrame([(*x, T, "y") for x in incoming] + [(None, 1, pool[0], None, T, "y")], "file_id long, batch_no int, hash string, partial_hash string, received_at timestamp_ntz, extra string")
    assert {tuple(x) for x in batch_matches(inc, f).collect()} == brute_batches(seen, incoming)


def test_empty_batches(spark):
    f = files(spark, {"file_id": 1, "hash": "0123456789abcdef" * 2})
    inc = spark.createDataFrame([(5, 1, "0123456789abcdef" * 2, None, T)], "file_id long, batch_no int, hash string, partial_hash string, received_at timestamp_ntz")
    assert batch_matches(inc.limit(0), f).count() == 0
    assert batch_matches(inc, f.limit(0)).count() == 0
    assert [tuple(x) for x in batch_matches(inc, f).collect()] == [(1, 5, "exact")]


def test_a_kept_index_needs_no_history_again(spark, tmp_path):
    """Batches of two runs against one index equal all of them at once, and ids of history may be larger than theirs."""
    r = random.Random(5)
    pool = [f"{k:032x}"[:31] + "b" for k in range(30)]
    seen = [(9000 + i, r.choice(pool), r.choice(pool)) for i in range(8)]
    incoming = [(1000 + i, 1 + i // 10, r.choice([None, *pool]), r.choice([None, *pool])) for i in range(40)]
    f = files(spark, *[{"file_id": i, "hash": h, "partial_hash": p} for i, h, p in seen])
    inc = spark.createDataFrame([(*x, T) for x in incoming], "file_id long, batch_no int, hash string, partial_hash string, received_at timestamp_ntz")
    want = {tuple(x) for x in batch_matches(inc, f).collect()}
    assert any(m >= 9000 for m, _, _ in want)
    root = str(tmp_path / "index")
    got = {tuple(x) for x in batch_matches(inc.where("batch_no <= 2"), f, root=root).collect()}
    for n in (3, 4):
        index = BatchIndex(spark, root)
        assert not index.empty and index.parts == n - 1
        new = match_batches(index, inc.where(f"batch_no = {n}"))
        assert not any("file_records" in x for x in new.inputFiles())
        got |= {tuple(x) for x in new.collect()}
        index.compact()
        index.drop()
    assert got == want


# problem 3


def pieces(name):
    base = name.rsplit(".", 1)[0] if "." in name else name
    return {p for run in re.findall("[a-z0-9]+", base.lower()) for p in ([run] if len(run) < 3 else [run[i : i + 3] for i in range(len(run) - 2)])}


def brute_names(rows, groups):
    def ext(e):
        return (e or "").strip(" \t").lower().replace(".", "").strip(" \t")

    out = set()
    for a in rows:
        for b in rows:
            if a["file_id"] < b["file_id"] and a["name"] is not None and b["name"] is not None:
                x, y = pieces(a["name"]), pieces(b["name"])
                s, t = a["size"] or 0, b["size"] or 0
                e, f = ext(a["ext"]), ext(b["ext"])
                close = s > 0 and t > 0 and abs(s - t) * 20 <= max(s, t)
                kin = e and f and (e == f or groups.get(e, {1}) & groups.get(f, {2}))
                if close and kin and (x | y) and 10 * len(x & y) >= 7 * len(x | y):
                    out.add((a["file_id"], b["file_id"]))
    return out


def test_names_equal_brute_force(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    rows = []
    for i in range(60):
        base, size, e = " ".join(word(r.randint(1, 9)) for _ in range(r.randint(1, 4))), r.choice([4096, r.randint(1, 10**7)]), r.choice([".jpg", "JPEG", " .txt ", "md", "", None])
        for _ in range(r.randint(1, 5)):
            n = list(base)
            for _ in range(r.randint(0, 2)):
                n[r.randrange(len(n))] = r.choice("xyz _-É")
            rows.append({"file_id": len(rows), "name": r.choice(["".join(n) + ".ext", "".join(n), "".join(n).upper() + ".a"]), "size": round(size * r.choice([1, 1, 1.02, 1.05, 1.06])), "ext": e})
    rows += [{"file_id": len(rows) + k, **x} for k, x in enumerate([{"name": None, "size": 5, "ext": "jpg"}, {"name": "é.jpg", "size": 5, "ext": "jpg"}, {"name": "é.png", "size": 5, "ext": "jpg"}, {"name": "", "size": 5, "ext": "jpg"}, {"name": "abc", "size": None, "ext": "jpg"}, {"name": "abc", "size": -1, "ext": "jpg"}, {"name": "ab", "size": 95, "ext": "jpg"}, {"name": "AB", "size": 100, "ext": ".jfif"}, {"name": "a.b.c", "size": 100, "ext": "z"}, {"name": "a.b", "size": 100, "ext": "Z."}, {"name": "x" * 20_000, "size": 7, "ext": "q"}, {"name": "x" * 30_000, "size": 7, "ext": "q"}])]
    groups = {"jpg": {"p", "v"}, "jpeg": {"p"}, "jfif": {"p", "v"}, "txt": {"t"}, "md": {"t"}}
    g = spark.createDataFrame([(e, x) for e, v in groups.items() for x in v] + [("jpg", "p"), ("bad", None)], "ext string, ext_group string")
    f = files(spark, *rows, *rows[:5], {"file_id": 0, "name": "other", "size": 1, "ext": "q", "scanned_at": T - dt.timedelta(1)})
    got = [tuple(x) for x in near_names(f, g).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_names(rows, groups)
    assert near_names(f.limit(0), g).count() == 0 and near_names(f, g.limit(0)).count() <= len(got)


def test_both_ends_of_a_permutation_estimate_similarity():
    import numpy as np

    r = random.Random(9)
    for shared in (14, 18):
        a, b = r.sample(range(50_000), 20), None
        b = a[:shared] + r.sample(range(50_000, 99_999), 20 - shared)
        keys = min_max_bands([np.array(sorted(a)), np.array(sorted(b))], bands=4_000, permutations=1)
        union = 40 - shared
        want = shared * (shared - 1) / (union * (union - 1))
        assert abs((keys[0] == keys[1]).mean() - want) < 0.03


def test_copies_meet_once(spark):
    f = spark.range(300).selectExpr("id as file_id", "'report_final.txt' as name", "1000L as size", "'.txt' as ext", "timestamp_ntz'2025-01-01' as scanned_at")
    g = spark.createDataFrame([], "ext string, ext_group string")
    assert near_names(f, g).count() == 300 * 299 // 2


def test_groups_of_names_and_one_popular_name(spark):
    """A popular name with many sizes meets only its like, and groups are the components of the pairs."""
    rows = [{"file_id": k, "name": "Holiday Picture 2024.jpg", "size": 1000 + 7 * k, "ext": "jpg"} for k in range(400)] + [{"file_id": 1000 + k, "name": f"other{k:05d}", "size": 9, "ext": "q"} for k in range(40)]
    f, g = files(spark, *rows), spark.createDataFrame([], "ext string, ext_group string")
    want = brute_names(rows, {})
    assert {tuple(x) for x in near_names(f, g).collect()} == want
    of = components(want)
    assert {(r.file_id, r.group_id) for r in near_name_groups(f, g).collect()} == set(of.items())
    assert sum(r.n_links for r in near_name_groups(f, g).collect()) == 2 * len(want)
    assert near_name_groups(f.limit(0), g).count() == 0


# problem 4


@pytest.mark.parametrize(("name", "edges"), list(shapes()))
def test_labels_equal_union_find(spark, name, edges):
    df = spark.createDataFrame(edges, "u long, v long")
    with Workspace(spark, "t") as w:
        assert {r.id: r.label for r in min_labels(df, w).collect()} == components(edges)


def test_paths_with_dirt(spark):
    p = spark.createDataFrame([("/b ", "\t/a", 1), ("/a", "/a", 2), (None, "/x", 3), ("/x", " ", 4), ("/c", "/b", None), ("/c", "/b", None)], "path_a string, path_b string, score int")
    g = groups(spark, (1, ["/z", None, " /y", "", "/z"], {}), (2, ["/only", "/only "], {}), (3, ["/old", "/a"], {}, T - dt.timedelta(1)), (3, ["/new", "/c"], {}), (4, None, None))
    assert {tuple(x) for x in path_groups(p, g).collect()} == {("/a", "/a"), ("/b", "/a"), ("/c", "/a"), ("/new", "/a"), ("/y", "/y"), ("/z", "/y")}
    assert path_groups(p.limit(0), g.limit(0)).count() == 0
