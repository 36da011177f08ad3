"""Fill-in-the-middle transformation by two passes of a lazy matcher.

A text is taken apart into units (matches of a pattern, one after another). Two
hashed ranks cut it into prefix, middle and suffix. The first pass of the
matcher counts the units; the second is advanced to the lower rank and on to the
higher one and then left. Neither keeps a unit, so beside the text and its
output a row needs constant memory, however many units it has.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import NULL_ID, released
from .store import given_id, texts

#: A run of letters, or any other character: every text is exactly its units, one after another.
UNITS = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Characters of output that a batch holds at least before it is handed on.
_FLUSH = 1 << 20


def count_units(units: Iterator) -> int:
    """How many there are; none is kept."""
    places = count()
    deque(zip(units, places), maxlen=0)
    return next(places)


def end_of(units: Iterator, steps: int, before: int) -> int:
    """Where the unit ends that lies so many steps on; before if there is no step."""
    return next(islice(units, steps - 1, None)).end() if steps else before


def draws(doc_id: int | None, seed: str) -> tuple[int, ...]:
    """Four numbers of 32 bits from the hash of seed, a colon and the id (nothing for null)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def infill(text: str, doc_id: int | None, seed: str = "1", percent: int = 90, spm_percent: int = 20, pattern: re.Pattern = re.compile(UNITS)):
    """(n, form, output, prefix characters, middle characters); the last two are None if form is plain."""
    n = count_units(pattern.finditer(text))
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= percent:
        return n, "plain", text, None, None
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    units = pattern.finditer(text)
    a = end_of(units, low, 0)
    b = end_of(units, high - low, a)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)), a, b - a
    return n, "psm", "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)), a, b - a


def fill_in_middle(docs: DataFrame, seed: str = "1", percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """doc_id, n, form, output, prefix_chars, middle_chars of every row.

    n counts the units of UNITS. With the four 32-bit numbers of the SHA-256 of
    ``seed:doc_id``, the prefix ends after the smaller of h1 % (n + 1) and
    h2 % (n + 1) units, the middle after the larger; h3 % 100 >= percent leaves
    the text plain, h4 % 100 < spm_percent puts the suffix first (spm), else the
    prefix (psm). An empty or null text, and one that holds a mark, is plain:
    output is the text, the lengths (in code points) are null. Parts may be
    empty. Repeated rows repeat, ids may be null (hashed as ``seed:``) or occur
    with several texts; an empty table gives no rows, further columns are not
    read. No row depends on another: nothing is shuffled or collected, and a lost
    executor costs its own tasks only.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("output", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])

    @released
    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                doc_id = doc_id.as_py()
                n, form, output, a, b = infill(text.as_py() or "", None if doc_id == NULL_ID else doc_id, seed, percent, spm_percent)
                rows.append((doc_id, n, form, output, a, b))
                size += len(output) + 64
                if size >= _FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return texts(docs).mapInArrow(run, "doc_id long, n long, form string, output string, prefix_chars long, middle_chars long").withColumn("doc_id", given_id())


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that an output of the given form was made of.

    A transformed text holds no mark of its own, and no mark ends as another
    begins, so each mark stands in an output once, where it was put.
    """
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    middle = F.substring_index(output, MIDDLE, -1)
    before = F.substring_index(output, MIDDLE, 1)
    psm = F.concat(F.substring_index(F.substring_index(before, SUFFIX, 1), PREFIX, -1), middle, F.substring_index(before, SUFFIX, -1))
    spm = F.concat(F.substring_index(before, PREFIX, -1), middle, F.substring_index(F.substring_index(before, PREFIX, 1), SUFFIX, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
