"""How the dirty columns of a catalog are read: digests, paths, scores and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t"
#: A usable keep score lies in this closed range.
KEEP_RANGE = (0, 200)


def digest(c: Column) -> Column:
    """The 32 lower-case hex digits a digest column holds, or null.

    Hyphens and letter case don't count; the digits are the first run of exactly 32, whatever stands around it. Values
    without such a run, and runs of one repeated digit, are no digest.
    """
    run = F.regexp_extract(F.translate(F.lower(c), "-", ""), r"(?<![0-9a-f])([0-9a-f]{32})(?![0-9a-f])", 1)
    # the one-element array binds the run, so that the pattern is matched once per value and not once per mention
    return F.get(F.filter(F.array(run), lambda r: (r != "") & (r != F.repeat(F.left(r, F.lit(1)), 32))), F.lit(0))


def digest_bytes(c: Column) -> Column:
    """``digest`` as 16 bytes: half the width in shuffles and hash tables."""
    return F.unhex(digest(c))


def clean_path(c: Column) -> Column:
    """A path without surrounding spaces and tabs; blank ones are null."""
    t = F.btrim(c, F.lit(BLANKS))
    return F.when(t != "", t)


def usable_score(c: Column) -> Column:
    """A keep score from 0 to 200, else null."""
    return F.when(c.between(*KEEP_RANGE), c)


def usable_mtime(mtime: Column, scanned_at: Column) -> Column:
    """An mtime above 0 and not after the scan that saw it, else null (NaN and infinities too)."""
    scanned = F.unix_micros(scanned_at.cast("timestamp")).cast("double") / F.lit(1e6)
    return F.when(~F.isnan(mtime) & (mtime > 0) & (mtime <= scanned), mtime)
