"""The engine, the command port, sessions, logs, exports and streams."""

import datetime as dt
import json

import pytest

from twinsift.operators import changes
from twinsift.plans import runtime
from twinsift.plans.engine import DedupEngine
from twinsift.plans.port import COMMANDS, CommandPort
from twinsift.settings import Settings
from twinsift.sources import catalog, session
from twinsift.streaming.watch import stream_exact, watch

FILE = "path string, name string, ext string, size long, mtime double, ctime double, inode long, device long, hash string, quick_hash string, sha256_hash string, magic_type string, category string, keep_score long, phash string, parent string, is_locked boolean, is_system boolean, is_symlink boolean, tokens array<string>"
NAMES = [c.split()[0] for c in FILE.split(", ")]


def files(spark, *rows):
    base = {"size": 10, "mtime": 1.0, "ctime": 1.0, "device": 1, "keep_score": 100, "parent": "/d", "ext": "txt", "is_locked": False, "is_system": False, "is_symlink": False, "tokens": []}
    return spark.createDataFrame([tuple((base | {"name": r["path"][1:], "inode": i + 1} | r).get(c) for c in NAMES) for i, r in enumerate(rows)], FILE)


@pytest.fixture(scope="module")
def engine(spark):
    rows = [
        {"path": "/l1", "inode": 99, "hash": "a"}, {"path": "/l2", "inode": 99, "hash": "a"}, {"path": "/e0", "hash": "a"},
        {"path": "/e1", "hash": "b", "keep_score": 120}, {"path": "/e2", "hash": "b"}, {"path": "/e3", "hash": "b", "is_locked": True},
        {"path": "/n1", "hash": "c", "quick_hash": "q", "size": 70, "tokens": ["n"]}, {"path": "/n2", "hash": "d", "quick_hash": "q", "size": 70, "tokens": ["n"]},
        {"path": "/empty", "size": 0, "hash": "z"}, {"path": "/lib/x", "hash": "b"},
    ]
    return DedupEngine(spark, Settings(min_score=60)).catalog(files(spark, *rows))


def test_engine_finds_each_kind_once(engine):
    got = {(r.group_id, r.path) for r in engine.groups().select("group_id", "path").collect()}
    assert got == {("hardlink:/l1", "/l1"), ("hardlink:/l1", "/l2"), ("exact:/e1", "/e1"), ("exact:/e1", "/e2"), ("exact:/e1", "/e3"), ("near:/n1", "/n1"), ("near:/n1", "/n2")}
    marks = {r.path: r.suggestion for r in engine.select().collect()}
    assert marks == {"/l1": "KEEP", "/l2": "KEEP", "/e1": "KEEP", "/e2": "DELETE", "/e3": "KEEP", "/n1": "KEEP", "/n2": "REVIEW"}
    assert [(r.path, r.allowed) for r in engine.plan().collect()] == [("/e2", True)]


def test_validation_counts_pairs_below_min_score(spark):
    # any two have 67 points (size, quick digest, ext) and 3 of time; neighbours reach 82 by tokens and time: 7 of 28 pairs
    rows = [{"path": f"/v{i}", "name": c * 4, "hash": f"h{i}", "quick_hash": "q", "size": 70, "parent": f"/p{i}", "mtime": 1e9 + 3500 * i, "tokens": [f"t{k}" for k in range(i, i + 6)]} for i, c in enumerate("abcdefgh")]
    got = DedupEngine(spark, Settings(min_score=80)).catalog(files(spark, *rows)).groups()
    assert {(r.group_id, r.path) for r in got.collect()} == {("near:/v0", f"/v{i}") for i in range(8)}


def test_port_answers_every_command(engine, tmp_path):
    port, heard = CommandPort(engine), []
    port.register(lambda signal, data: heard.append(signal))
    ask = lambda cmd, **args: port.handle(json.dumps({"cmd": cmd, "args": args}))
    assert ask("ping")["pong"] and ask("scan")["groups"] == 3 and heard == ["scan_done"]
    assert ask("get_status")["status"] == "done"
    assert len(ask("get_groups")["groups"]) == 3
    assert [f["path"] for f in ask("get_group", group_id="exact:/e1")["files"]] == ["/e1", "/e2", "/e3"]
    assert not ask("get_group", group_id="none")["ok"] and not ask("select_files", group_id="x", paths=[], action="EAT")["ok"]
    assert ask("delete_selected")["plan"][0]["n_files"] == 1
    assert ask("select_files", group_id="exact:/e1", paths=["/e2"], action="KEEP")["ok"] and ask("delete_selected")["plan"] == []
    assert ask("get_stats")["stats"]["total_groups"] == 3 and "numpy" in ask("get_capabilities")["capabilities"]
    for kind in ("csv", "json", "html", "txt"):
        assert ask("export", folder=f"{tmp_path}/{kind}", format=kind)["ok"], kind
    assert not ask("export", folder=f"{tmp_path}/x", format="tape")["ok"]
    assert ask("save_session", folder=f"{tmp_path}/s")["ok"] and ask("load_session", folder=f"{tmp_path}/s")["about"] == {"profile": "safe"}
    assert not ask("load_session", folder=f"{tmp_path}/none")["ok"]
    assert ask("pause")["ok"] and ask("resume")["ok"] and not ask("fly")["ok"]
    assert not port.handle("{")["ok"] and not port.handle("[]")["ok"] and not port.handle('{"a": 1}')["ok"]
    assert ask("set_settings", profile="max_safe")["settings"]["min_score"] == 90 and not ask("set_settings", colour=1)["ok"]
    assert ask("get_settings")["settings"]["profile"] == "max_safe"
    assert ask("cancel")["ok"] and ask("stop")["ok"] and len(COMMANDS) == 18


def test_html_is_escaped(spark):
    rows = spark.createDataFrame([(1, "near", 70, 1, "REVIEW", 100, '/<b>&"', 5, "h" * 40, None)], "group int, type string, score int, file_index int, suggestion string, quality int, path string, size long, hash string, mime string")
    [r] = session.html_rows(rows).collect()
    assert '<tr class="review">' in r.value and "/&lt;b&gt;&amp;&quot;" in r.value and f"<td>{'h' * 20}</td>" in r.value
    assert session.text_rows(rows).first().value.startswith("[REVIEW] 1/1 /<b>")


def test_log(spark, tmp_path):
    log = f"{tmp_path}/log"
    assert session.read_log(spark, log).count() == 0
    entry = lambda t, p, e=None: spark.createDataFrame([(t, p, e is None, e)], session.LOG)
    session.append_log(entry(1.0, "a"), log)
    session.append_log(entry(2.0, "b", "gone"), log)
    (tmp_path / "log" / "part-bad.json").write_text("not json\n")
    assert [(r.path, r.success) for r in session.read_log(spark, log).collect()] == [("b", False), ("a", True)]


def test_other_versions_are_no_session(spark, tmp_path):
    spark.createDataFrame([("0", "{}")], "version string, about string").write.parquet(f"{tmp_path}/s/session")
    assert session.load_session(spark, f"{tmp_path}/s") is None


def test_folder_scan(spark, tmp_path):
    for p in ("a.TXT", "sub/b.tar.gz", "sub/Cache/c.txt", "sub/.git/d"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"12345")
    got = {(r.name, r.ext, r["size"]) for r in catalog.scan_folder(spark, str(tmp_path)).select("name", "ext", "size").collect()}
    assert got == {("a.TXT", ".txt", 5), ("b.tar.gz", ".gz", 5)}


def test_workspaces_live_in_the_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or runtime.shared_dir(spark)
    assert runtime.shared_dir(spark) == named.rstrip("/")
    from pathlib import Path

    with runtime.Workspace(spark, "w") as w:
        assert w.root.startswith(named) and w.keep(spark.range(5)).count() == 5
        here = Path(w.root.removeprefix("file:"))
        assert here.exists()
    assert not here.exists()
    assert runtime.cut(spark.range(3)).count() == 3


FEED = "key string, ts timestamp, seq long, op string, digest string"


def test_stream_equals_batch(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    ops = [("put", "1"), ("put", "1"), ("put", "2"), ("delete", None), ("put", "2"), ("put", None), ("put", "3")]
    rows = [(k, t + dt.timedelta(minutes=i), i, op, d) for i, (op, d) in enumerate(ops) for k in ("x", "y")]
    for n in range(0, len(rows), 4):  # several micro-batches
        spark.createDataFrame(rows[n : n + 4], FEED).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    q = watch(spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")).writeStream.format("memory").queryName("seen").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(120)
    want = changes.changes(spark.createDataFrame(rows, FEED))
    key = lambda df: sorted((r.key, r.seq, r.event) for r in df.collect())
    assert key(spark.table("seen")) == key(want)


def test_stream_against_known_files(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    spark.createDataFrame([("n1", t, "d1"), ("n1", t, "d1"), ("n2", t, "d2")], "key string, ts timestamp, digest string").coalesce(1).write.json(f"{tmp_path}/in")
    known = spark.createDataFrame([("/old", "d1")], "path string, digest string")
    feed = spark.readStream.schema("key string, ts timestamp, digest string").json(f"{tmp_path}/in")
    q = stream_exact(feed, known).writeStream.format("memory").queryName("hits").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(120)
    assert [(r.key, r.path) for r in spark.table("hits").collect()] == [("n1", "/old")]


def test_members_with_dirt(spark):
    T = dt.datetime(2025, 1, 1)
    g = spark.createDataFrame([(1, "exact", 100, ["/a ", None, "\t/a", "/b", "", "/gone"], {0: "keep ", 2: "DELETE", 3: None}, T), (1, "exact", 50, ["/b"], {}, T - dt.timedelta(1)), (2, None, None, None, None, T)], "group_id long, group_type string, score int, files array<string>, suggestions map<int,string>, saved_at timestamp_ntz")
    f = spark.createDataFrame([(1, "/a"), (2, "/b"), (3, "/c")], "file_id long, path string")
    out = catalog.saved_members(g, f).select("group_id", "path", "idx", "saved").orderBy("idx").collect()
    assert [tuple(r) for r in out] == [(1, "/a", 0, "KEEP"), (1, "/b", 3, None)]


def test_metadata_reads_dirt(spark):
    T = dt.datetime(2025, 1, 1)
    s = "file_id long, path string, name string, ext string, size long, mtime double, ctime double, inode long, device long, hash string, partial_hash string, quick_hash string, sha256_hash string, magic_type string, category string, keep_score int, entropy double, phash string, is_locked boolean, is_symlink boolean, is_system boolean, scanned_at timestamp_ntz"
    row = (1, " /d/x.TXT\t", " ", " .TXT", -5, float("nan"), -1.0, 0, 1, "md5:" + "Ab" * 16, "-", "f" * 32, " AA ", "", None, None, float("nan"), "", None, True, None, T)
    [r] = catalog.metadata(spark.createDataFrame([row, row, (None, *row[1:])], s)).collect()
    assert (r.path, r.name, r.ext, r["size"], r.mtime, r.ctime, r.inode, r.hash, r.partial_hash, r.quick_hash, r.sha256_hash) == ("/d/x.TXT", None, "txt", None, None, None, None, "ab" * 16, None, None, "aa")
    assert (r.is_locked, r.is_symlink, r.parent, r.entropy, r.magic_type) == (False, True, "/d", None, None)
    assert catalog.metadata(spark.createDataFrame([], s)).count() == 0


def test_paranoid_engine_keeps_only_proved_copies(spark):
    rows = [("/d/a.txt", "h", "s"), ("/d/b.txt", "h", "s"), ("/d/c.txt", "h", "t"), ("/d/e.txt", "g", None), ("/d/f.txt", "g", None)]
    f = spark.createDataFrame([(p, "/d", p[3:], "txt", 9, 1.0, 1.0, None, 1, h, s, False, False, False) for p, h, s in rows], "path string, parent string, name string, ext string, size bigint, mtime double, ctime double, inode bigint, device bigint, hash string, sha256_hash string, is_locked boolean, is_system boolean, is_symlink boolean")
    exact = lambda **x: {r.path for r in DedupEngine(spark, Settings(near=False, **x)).catalog(f).groups().collect()}
    assert exact() == {p for p, _, _ in rows} and exact(paranoid=True) == {"/d/a.txt", "/d/b.txt"}
