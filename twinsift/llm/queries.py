"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..tables import table
from .batches import BATCH_SQL, batch_matches
from .encodings import garbled, restored
from .linkage import LINKAGE_SQL, path_groups
from .minmax import NAMES_SQL, near_name_groups, near_names
from .mixing import mixture, reached_shares
from .packing import containers, filling
from .survivors import SURVIVORS_SQL, surviving_fields

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: surviving_fields(table(s, d, "dup_groups"), table(s, d, "file_records")),
        "p2_found": lambda s, d: batch_matches(table(s, d, "incoming_files"), table(s, d, "file_records")),
        "p3_found": lambda s, d: near_names(table(s, d, "file_records"), table(s, d, "ext_groups")),
        "p3_groups": lambda s, d: near_name_groups(table(s, d, "file_records"), table(s, d, "ext_groups")),
        "p4_found": lambda s, d: path_groups(table(s, d, "match_pairs"), table(s, d, "dup_groups")),
        "p6_containers": lambda s, d: containers(table(s, d, "documents"), table(s, d, "pack_specs")),
        "p6_filling": lambda s, d: filling(containers(table(s, d, "documents"), table(s, d, "pack_specs")), table(s, d, "pack_specs")),
        "p7_mixture": lambda s, d: mixture(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p7_shares": lambda s, d: reached_shares(mixture(table(s, d, "documents"), table(s, d, "mix_targets")), table(s, d, "mix_targets")),
        "p8_found": lambda s, d: garbled(table(s, d, "documents")),
        "p8_restored": lambda s, d: restored(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"p1_found": SURVIVORS_SQL, "p2_found": BATCH_SQL, "p3_found": NAMES_SQL, "p4_found": LINKAGE_SQL}
