import difflib
import hashlib
import math
from collections import Counter
from pathlib import PurePosixPath

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinsift import constants as K
from twinsift.functions import features as X
from twinsift.functions import keep
from twinsift.functions.score import pair_score
from twinsift.operators.pairs import SCORED


def values(spark, rows, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


def test_path_parts_like_pathlib(spark):
    paths = ["/a/b/.bashrc", "/a/x.tar.gz", "/A.TXT", "/r/name", "/r/dot.", "/f", "/a/b/c/d/e/f/g.t"]
    out = values(spark, [(p,) for p in paths], "p string", "p", X.file_name(F.col("p")), X.stem(X.file_name(F.col("p"))), X.suffix(X.file_name(F.col("p"))), X.depth(F.col("p")))
    for p, name, stem, suffix, depth in out:
        q = PurePosixPath(p)
        assert (name, depth) == (q.name, len(q.parts))
        if not name.endswith("."):
            assert (stem, suffix) == (q.stem, q.suffix.lower())
    assert ("dot.", "dot.", "") in [o[1:4] for o in out]


def test_magic_and_category(spark):
    rows = [(bytearray(sig + b"..."), label) for sig, label in K.MAGIC] + [(bytearray(b""), None), (None, None), (bytearray(b"nothing"), None)]
    for found, label in values(spark, rows, "h binary, l string", X.magic_type(F.col("h")), "l"):
        assert found == label
    assert values(spark, [("JPEG", "txt"), (None, ".MP3"), (None, ""), ("ELF", ""), ("ICO", "py")], "m string, e string", X.category(F.col("m"), F.col("e"))) == [("Image",), ("Audio",), ("Other",), ("Executable",), ("Code",)]


def test_ext_compat(spark):
    rows = [("jpg", "jpeg"), (".JPG", "jpg"), ("a", "a"), ("", ""), ("", "jpg"), ("zip", "gz"), ("txt", "mp3")]
    assert [r[0] for r in values(spark, rows, "a string, b string", X.ext_compat(F.col("a"), F.col("b")))] == [0.9, 0.9, 1.0, 1.0, 0.0, 0.9, 0.0]


@pytest.mark.parametrize("n", [0, 1, 4096, 4097, 65536, 65537, 200_001])
def test_digests_and_entropy_at_boundaries(spark, n):
    raw = bytes(i * i % 251 for i in range(n))
    [(q, p, e)] = values(spark, [(bytearray(raw),)], "c binary", X.quick_digest(F.col("c")), X.partial_digest(F.col("c")), X.entropy(F.substring("c", 1, K.CHUNK_BYTES)))
    assert q == hashlib.md5(raw[:4096]).hexdigest()
    assert p == hashlib.md5(raw if n <= 65536 else raw[:65536] + raw[-65536:]).hexdigest()
    head = raw[:65536]
    want = -sum(k / len(head) * math.log2(k / len(head)) for k in Counter(head).values()) if head else 0.0
    assert e == pytest.approx(want, abs=1e-4)


def test_name_scores(spark):
    cases = {p.strip() + "zz": -30 for p in ("- copy", "_backup")} | {"report": 0, "x(1)": -20, "x-2": -15, "ab": -5, "abcdefghij": 5, "abcdef___ghij": 0, "": -5}
    out = dict(values(spark, [(k,) for k in cases], "s string", "s", keep.name_keep_score(F.col("s"))))
    for k, v in cases.items():
        length = 5 if len(k) >= 10 and v == -30 else 0
        assert out[k] == v + length, k
    for p in K.COPY_PATTERNS:
        assert values(spark, [(f"q{p}q",)], "s string", keep.is_copy_name(F.col("s"))) == [(True,)]


def test_path_scores(spark):
    cases = {"/a/b.txt": 5, "/a/b/c/d.txt": 0, "/a/b/c/d/e.txt": -2, "/template/x.txt": -20, "/Documents/x.txt": 15, "/usr/share/x.txt": -55, "/" + "d/" * 30 + "x": -20}
    out = dict(values(spark, [(k,) for k in cases], "p string", "p", keep.path_keep_score(F.col("p"), F.lit(False))))
    assert out == cases
    assert values(spark, [("/template/x.txt",)], "p string", keep.path_keep_score(F.col("p"), F.lit(True), "segment")) == [(-35,)]


def test_phash_distance_and_texts(spark):
    rows = [("ffffffffffffffff", "0000000000000000"), ("1", "3"), ("zz", "1"), (None, "1")]
    assert [r[0] for r in values(spark, rows, "a string, b string", X.phash_distance(F.col("a"), F.col("b")))] == [64, 1, 64, 64]
    assert [r[0] for r in values(spark, [(0,), (1023,), (30976,), (5 << 20,), (3 << 30,)], "n long", X.format_size(F.col("n")))] == ["0 B", "1023 B", "30.2 KB", "5.00 MB", "3.00 GB"]
    assert [r[0] for r in values(spark, [(0.0,), (None,), (86400.9,)], "t double", X.format_ts(F.col("t")))] == ["N/A", "N/A", "1970-01-02 00:00:00"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=30), st.text(max_size=30)), min_size=1, max_size=20))
def test_name_ratio_is_difflibs(spark, pairs):
    clean = [(a.encode("utf-8", "ignore").decode(), b.encode("utf-8", "ignore").decode()) for a, b in pairs]
    for a, b, r in values(spark, clean, "a string, b string", "a", "b", X.name_ratio(F.col("a"), F.col("b"))):
        assert r == difflib.SequenceMatcher(None, a, b).ratio()


def record(**k):
    base = dict.fromkeys(SCORED) | {"path": "/p", "parent": "/d", "name": "n", "ext": "txt", "size": 1000, "mtime": 1e9, "tokens": []}
    return tuple((base | k)[c] for c in SCORED)


@pytest.mark.parametrize(
    ("a", "b", "score"),
    [
        ({"hash": "h"}, {"hash": "h", "size": 5}, 100),
        ({}, {}, 35 + 12 + 5 + 5),
        ({}, {"size": 951}, 15 + 12 + 5 + 5),
        ({}, {"size": 949}, 8 + 12 + 5 + 5),
        ({}, {"size": 800}, 0 + 12 + 5 + 5),
        ({}, {"size": 799}, 0),
        ({"quick_hash": "q"}, {"quick_hash": "r"}, 0),
        ({"quick_hash": "q"}, {"quick_hash": "q"}, 35 + 20 + 12 + 5 + 5),
        ({"partial_hash": "q"}, {"partial_hash": "r"}, 0),
        ({"ext": "jpg"}, {"ext": "jpeg"}, 35 + 5 + 5 + 5),
        ({}, {"mtime": 1e9 + 3600}, 35 + 12 + 5 + 3),
        ({}, {"mtime": 1e9 + 86400}, 35 + 12 + 5 + 1),
        ({}, {"mtime": 1e9 + 7 * 86400}, 35 + 12 + 5),
        ({}, {"mtime": 0.0}, 35 + 12 + 5),
        ({"entropy": 1.0}, {"entropy": 0.91}, 35 + 12 + 5 + 5 + 5),
        ({"entropy": 1.0}, {"entropy": 0.89}, 35 + 12 + 5 + 5),
        ({"phash": "ff"}, {"phash": "00"}, 35 + 12 + 5 + 5 + 30),
        ({"tokens": list("abcd")}, {"tokens": list("abce")}, 35 + 12 + 5 + 5 + 5),
        ({"tokens": list("abc")}, {"tokens": list("abc")}, 35 + 12 + 5 + 5 + 10),
        ({"magic_type": "PDF"}, {"magic_type": "PDF"}, 35 + 12 + 5 + 5 + 8),
        ({"parent": ""}, {"parent": ""}, 35 + 12 + 5),
    ],
)
def test_pair_score_rules(spark, a, b, score):
    row = "struct<" + ",".join(f"{c}:{t}" for c, t in SCORED.items()) + ">"
    df = spark.createDataFrame([(record(**a), record(**b))], f"a {row}, b {row}")
    assert df.select(pair_score("a", "b")).first()[0] == score


def test_extractors(spark):
    import numpy as np
    from pyspark.sql.types import LongType

    from twinsift.functions.extractors import audio_tags, dct_hash, extractor, pgm_hash

    tag = b"TAG" + b"Song".ljust(30, b"\0") + b"Band".ljust(30) + b"Disc".ljust(30, b"\0") + b"1999" + b"\0" * 31
    y, x = np.mgrid[:40, :50]
    picture = (128 + 60 * np.sin(x / 7) + 60 * np.cos(y / 5)).astype(np.uint8)
    brighter = np.clip(picture.astype(int) + 6, 0, 255).astype(np.uint8)
    rows = [b"ID3..." + tag, tag[:-1], b"", None, b"P5 50 40 255\n" + picture.tobytes(), b"P5 50 40 255\n" + brighter.tobytes(), b"P5 9 9 255\nshort"]
    size = extractor(lambda: 3, lambda m, c: m * len(c) if c[:1] != b"T" else 1 // 0, LongType())
    out = values(spark, [(bytearray(r) if r is not None else None,) for r in rows], "c binary", audio_tags(F.col("c")), pgm_hash("c"), size("c"))
    assert out[0][0] == {"title": "Song", "artist": "Band", "album": "Disc", "year": "1999"} and [o[0] for o in out[1:]] == [None] * 6
    assert out[4][1] == dct_hash(picture) and out[6][1] is None and out[0][1] is None
    assert (int(out[4][1], 16) ^ int(out[5][1], 16)).bit_count() <= 8
    assert [o[2] for o in out[:4]] == [3 * len(rows[0]), None, 0, None]
