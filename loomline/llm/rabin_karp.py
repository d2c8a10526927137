"""Exact substring de-duplication over words by Rabin-Karp window hashes.

A window of `length` words whose sequence also starts in a document with a smaller id is
removed; removed windows merge into maximal intervals. A rolling hash is taken of every window in
its task. Runs of neighbouring windows that share their least inner gram are counted in Spark
together, by a hash of all their windows' hashes; where two runs share the gram but differ, their
windows are compared one by one: see `repeats`.

Edge cases: null and empty texts, and those of fewer words, keep all; a null id is smaller than
any other, and null ids aren't smaller than each other; rows that repeat an id don't remove
each other; an empty table gives no rows; other columns are passed over.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomline.llm.common import buffers, words, trimmed
from loomline.llm.repeats import Windows, covered, repeated

GRAM = 16


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept string, kept_sha256, intervals array of [start, end) in words)."""
    w = Windows("words", length, min(GRAM, length))

    @trimmed

    def of(batches):
        for b in batches:
            cache: dict = {}
            for i, j, buf, off in buffers(b.column(1)):
                starts, ends, unit = words(buf, off)
                n = len(starts)
                gone = covered(b.column(2), unit, i, j, n, w, cache)
                first = np.zeros(n + 1, bool)
                first[unit] = True
                begin = np.flatnonzero(gone & (~np.concatenate([[False], gone[:-1]]) | first[:-1])) if n else np.zeros(0, np.int64)
                end = np.flatnonzero(gone & (~np.concatenate([gone[1:], [False]]) | first[1:])) + 1 if n else np.zeros(0, np.int64)
                at = np.searchsorted(begin, unit)
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[unit[1:]] - total[unit[:-1]]
                raw = buf.tobytes()
                kept = []
                for r in range(j - i):
                    own = raw[off[r] : off[r + 1]].split()
                    if removed[r]:
                        own = [x for x, g in zip(own, gone[unit[r] : unit[r + 1]].tolist(), strict=True) if not g]
                    kept.append(b" ".join(own))
                row = np.repeat(np.arange(j - i), np.diff(at))
                pairs = pa.StructArray.from_arrays([pa.array(begin - unit[row]), pa.array(end - unit[row])], ["start", "end"])
                yield pa.record_batch(
                    [
                        b.column(0).slice(i, j - i),
                        pa.array(np.diff(unit).astype(np.int64)),
                        pa.array(removed),
                        pa.array([x.decode() for x in kept]),
                        pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                        pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pairs),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept", "kept_sha256", "intervals"],
                )

    return repeated(docs, w, True, id_col, text_col).mapInArrow(
        of, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string, intervals array<struct<start:long,end:long>>"
    )
