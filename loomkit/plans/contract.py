"""Whether a module's contract fits: one major version, and no later minor one than the host's."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The host's contract.
MAJOR, MINOR = 4, 2


def accepts(contract: str, major: int = MAJOR, minor: int = MINOR) -> bool:
    """contract ends in @major.minor[.patch]; one without version is refused."""
    found = re.search(r"@(\d+)\.(\d+)(?:\.\d+)?$", contract or "")
    return bool(found) and int(found[1]) == major and int(found[2]) <= minor


def accepts_column(contract: Column, major: int = MAJOR, minor: int = MINOR) -> Column:
    pattern = r"@(\d+)\.(\d+)(?:\.\d+)?$"
    part = lambda i: F.regexp_extract(contract, pattern, i).try_cast("int")
    return F.coalesce((part(1) == major) & (part(2) <= minor), F.lit(False))


def major_of(abi: Column) -> Column:
    """The number between the last @ and the first point after it; null if there is none."""
    return F.when(F.instr(abi, "@") > 0, F.substring_index(F.substring_index(abi, "@", -1), ".", 1).try_cast("int"))
