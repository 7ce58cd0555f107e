"""Features of content that need a decoder or a model, and tags of lines and audio files."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

# The first word found in a line names its tag.
LOG_TAGS = (("[hash]", "hash"), ("[compare]", "compare"), ("[scan]", "scan"), ("[find]", "debug"), ("[select]", "select"), ("[delete]", "warn"), ("[verify]", "hash"), ("[session]", "info"), ("error", "error"), ("warn", "warn"))


def log_tag(line: Column) -> Column:
    low = F.lower(line)
    return F.coalesce(*[F.when(low.contains(w), F.lit(t)) for w, t in LOG_TAGS], F.lit("debug"))


def extractor(load: Callable[[], object], apply: Callable[[object, bytes], object], returns: DataType):
    """A column function for any model: ``load`` runs once per Python worker, ``apply`` on each binary value.

    Null content, and content that ``apply`` raises on, give null: a broken file is no reason to stop a scan.
    """
    kept: list = []

    def one(content):
        if content is None:
            return None
        if not kept:
            kept.append(load())
        try:
            return apply(kept[0], content)
        except Exception:  # noqa: BLE001
            return None

    @F.pandas_udf(returns)
    def extract(content: pd.Series) -> pd.Series:
        return pd.Series([one(c) for c in content], dtype=object)

    return extract


def dct_hash(gray: np.ndarray) -> str:
    """64 bits of a grey picture as hex: which low frequencies of its 32 x 32 form are above their median."""
    g = np.asarray(gray, dtype=np.float64)
    y, x = (np.linspace(0, n, 33).astype(int) for n in g.shape)
    small = np.array([[g[a : max(b, a + 1), c : max(d, c + 1)].mean() for c, d in zip(x, x[1:])] for a, b in zip(y, y[1:])])
    k = np.arange(32)
    basis = np.cos(np.pi * (k[None, :] + 0.5) * k[:, None] / 32)
    low = (basis @ small @ basis.T)[:8, :8]
    return f"{int(''.join('1' if b else '0' for b in (low > np.median(low)).ravel()), 2):016x}"


@F.pandas_udf(StringType())
def pgm_hash(content: pd.Series) -> pd.Series:
    """``dct_hash`` of binary PGM pictures, the one format that needs no decoder; null for anything else."""

    def one(c):
        parts = c.split(None, 4) if c is not None and c[:2] == b"P5" else []
        if len(parts) < 5 or parts[3] != b"255":
            return None
        w, h = int(parts[1]), int(parts[2])
        body = c[len(c) - w * h :]
        return dct_hash(np.frombuffer(body, dtype=np.uint8).reshape(h, w)) if w * h and len(body) == w * h else None

    return pd.Series([one(c) for c in content], dtype=object)


def audio_tags(content: Column) -> Column:
    """Title, artist, album and year of the tag block that ends an MP3 file, as a map; null if there is none."""
    tail = F.substring(content, -128, 128)
    text = lambda at, n: F.btrim(F.decode(F.substring(tail, at, n), "ISO-8859-1"), F.lit(" \x00"))
    return F.when(F.startswith(tail, F.lit(b"TAG")) & (F.octet_length(tail) == 128), F.create_map(F.lit("title"), text(4, 30), F.lit("artist"), text(34, 30), F.lit("album"), text(64, 30), F.lit("year"), text(94, 4)))
