"""Exact substring de-duplication over bytes by prefix-free parsing.

A string of `length` bytes that starts anywhere else too is removed wherever it stands. Texts
are cut at rolling-hash triggers into overlapping phrases; the parse lists the phrases of every
text and the dictionary each distinct phrase once, with its count. As neighbouring phrases overlap
by length - 1 bytes, a string of that length lies whole in one phrase, so the corpus order of
strings to this depth is that of the dictionary's suffixes, each as often as the parse has its
phrase: the parse's own order beyond one phrase decides nothing. Equal strings follow equal triggers,
so the suffix array is built for each trigger's phrases, by doubling prefixes to `length` bytes, and
only where a trigger has several phrases; strings inside a phrase that the parse holds more than once
are settled by its count. See `repeats`.

Triggers are least hashes of a window, not residues of a modulus, so each string has one even
in text of low entropy.

Edge cases: null and empty texts, and those shorter than `length`, keep all; null ids are kept as
null; repeated rows are copies of each other, and go whole; an empty table gives no rows; other
columns are passed over.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomline.llm.common import buffers, trimmed
from loomline.llm.repeats import Windows, covered, repeated

GRAM = 32


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, kept_sha256, spans array of [start, end))."""
    w = Windows("bytes", length, min(GRAM, length))

    @trimmed

    def of(batches):
        for b in batches:
            cache: dict = {}
            for i, j, buf, off in buffers(b.column(1)):
                gone = covered(b.column(2), off, i, j, len(buf), w, cache)
                first = np.zeros(len(buf) + 1, bool)
                first[off] = True
                begin = np.flatnonzero(gone & (~np.concatenate([[False], gone[:-1]]) | first[:-1])) if len(buf) else np.zeros(0, np.int64)
                end = np.flatnonzero(gone & (~np.concatenate([gone[1:], [False]]) | first[1:])) + 1 if len(buf) else np.zeros(0, np.int64)
                at = np.searchsorted(begin, off)
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[off[1:]] - total[off[:-1]]
                kept = [buf[s:e][~gone[s:e]].tobytes() if r else buf[s:e].tobytes() for s, e, r in zip(off, off[1:], removed, strict=False)]
                row = np.repeat(np.arange(j - i), np.diff(at))
                pairs = pa.StructArray.from_arrays([pa.array(begin - off[row]), pa.array(end - off[row])], ["start", "end"])
                yield pa.record_batch(
                    [
                        b.column(0).slice(i, j - i),
                        pa.array(np.diff(off)),
                        pa.array(removed),
                        pa.array(np.diff(at).astype(np.int64)),
                        pa.array(kept, pa.binary()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                        pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pairs),
                    ],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "spans"],
                )

    return repeated(docs, w, False, id_col, text_col).mapInArrow(
        of, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, spans array<struct<start:long,end:long>>"
    )
