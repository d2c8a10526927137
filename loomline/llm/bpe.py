"""Byte-level BPE encoding and decoding by tree concatenation.

A text is cut at the vocabulary's control strings. What lies between is encoded as a tree: while it
is longer than `LEAF` characters it is halved at any character, the leaves of a batch are cut
into pre-tokens and encoded together, and neighbours are joined. At each join a window of the last
pre-tokens on the left and the first on the right is cut anew, and grows both ways until it begins
with the left side's pre-token and meets an edge of the right side's. The result is then that of
the whole: where a pre-token ends depends on its own text and on at most two characters after its
end, or three after its start, so nothing before the window can change, and after a common edge
both sides go on alike.

A pre-token of `LONG_RUN` characters or more, which the pattern doesn't split, is a tree of its
own, over tokens: leaves of `RUN_LEAF` characters are encoded together, and at each join a window
of tokens is encoded anew and grows until it begins with the left side's token and ends with
the right side's. A token sequence is the encoding of its bytes exactly if each two neighbours
are the encoding of theirs, and all neighbours then come from one of the three encodings.

Of each pre-token up to `REMEMBERED` are remembered, with its ids, their decimal text and the
bytes they stand for. Decoding joins the bytes of the ids.

Edge cases: a null text is empty and has no tokens; control strings of the vocabulary are found
as the library finds them; ids that the vocabulary lacks decode to nothing, and bytes that aren't
UTF-8 to U+FFFD; repeated rows are encoded alike; null ids are kept; an empty table gives no rows;
other columns are passed over. A text is held whole, with its pre-tokens: about 60 bytes each.
"""

from __future__ import annotations

import hashlib
import os
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import bounded, trimmed

LEAF = 4096
LONG_RUN = 4096
RUN_LEAF = 1024
REMEMBERED, AT_ONCE = 1 << 17, 1 << 13
BATCH_BYTES = 1 << 20

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class Codec:
    """A byte-level BPE file of the tokenizers library, with truncation and padding unused."""

    def __init__(self, path: str, leaf: int = LEAF, long_run: int = LONG_RUN, run_leaf: int = RUN_LEAF) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.model.encode_special_tokens = True
        self.unsplit = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.by_line = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), self.unsplit])
        added = {t.content: i for i, t in self.model.get_added_tokens_decoder().items()}
        self.added = added
        self.control = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.leaf, self.long_run, self.run_leaf = leaf, long_run, run_leaf
        letters = byte_letters()
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for t, i in vocabulary.items():
            self.bytes_of[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        self.numerals = [str(i) for i in range(len(self.bytes_of))]
        self.line_end = self.numerals[self.bytes_of.index(b"\n")]
        #: What is remembered of a pre-token: the decimal text of its ids, and their bytes.
        self.decimal: dict[str, str] = {}
        self.raw: dict[str, bytes] = {}
        self.joins = 0

    # --- pre-tokens -----------------------------------------------------------------------

    def _join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        """The pre-tokens of two neighbouring texts put together, from those of each."""
        if not left or not right:
            return left + right
        self.joins += 1
        size = 2
        while True:
            i, j = max(len(left) - size, 0), min(size, len(right))
            tail, window = "".join(left[i:]), "".join(left[i:] + right[:j])
            got = PATTERN.findall(window)
            if i == 0 or (got[0] == left[i] and len(tail) > 2):
                edges = {e: k for k, e in enumerate(accumulate(map(len, right[:j]), initial=len(tail)))}
                at = 0
                for k, w in enumerate(got):
                    if at in edges and at + 2 <= len(window):
                        return left[:i] + got[:k] + right[edges[at] :]
                    at += len(w)
                if j == len(right):
                    return left[:i] + got
            size *= 2

    def _leaves(self, text: str) -> list[str]:
        if len(text) <= self.leaf:
            return [text]
        half = len(text) // 2
        return self._leaves(text[:half]) + self._leaves(text[half:])

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens and control strings of a text."""
        out: list[str] = []
        for part in self.control.split(text) if self.control and self.control.search(text) else (text,):
            if part in self.added:
                out.append(part)
                continue
            level = [PATTERN.findall(x) for x in self._leaves(part)]
            while len(level) > 1:
                odd = level[len(level) - len(level) % 2 :]
                level = [self._join_pieces(level[k], level[k + 1]) for k in range(0, len(level) - len(odd), 2)] + odd
            out += level[0]
        return out

    # --- tokens of a pre-token that is long -----------------------------------------------

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        self.model.pre_tokenizer = self.unsplit
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _text(self, ids: list[int]) -> str | None:
        try:
            return self.joined(ids).decode()
        except UnicodeDecodeError:
            return None

    def _join_tokens(self, left: list[int], right: list[int], lt: str, rt: str) -> list[int]:
        """The encoding of lt + rt from those of lt and rt; a window that would part a character grows."""
        if not left or not right:
            return left + right
        size = 8
        while True:
            i, j = min(size, len(left)), min(size, len(right))
            a = lt if i == len(left) else self._text(left[-i:])
            b = rt if j == len(right) else self._text(right[:j])
            if a is not None and b is not None:
                got = self._encoded([a + b])[0]
                if (i == len(left) or got[0] == left[-i]) and (j == len(right) or got[-1] == right[j - 1]):
                    return left[: len(left) - i] + got + right[j:]
            size *= 2

    def run(self, text: str) -> list[int]:
        """The encoding of a pre-token."""
        level = [text[k : k + self.run_leaf] for k in range(0, len(text), self.run_leaf)]
        ids = self._encoded(level)
        while len(level) > 1:
            odd = len(level) % 2
            joined = [self._join_tokens(ids[k], ids[k + 1], level[k], level[k + 1]) for k in range(0, len(level) - odd, 2)]
            texts = [level[k] + level[k + 1] for k in range(0, len(level) - odd, 2)]
            ids, level = joined + ids[len(ids) - odd :] * odd, texts + level[len(level) - odd :] * odd
        return ids[0] if ids else []

    # --- texts ------------------------------------------------------------------------------

    def learn(self, pieces: list[list[str]]) -> None:
        """From now on all these pre-tokens are remembered, until the next call.

        New ones are encoded as lines of one text: a line end is a token of its own there.
        """
        used = set(chain.from_iterable(pieces))
        if len(self.raw) > REMEMBERED:
            for known in (self.decimal, self.raw):
                kept = {w: known[w] for w in used.intersection(known)}
                known.clear()
                known.update(kept)
        new = used.difference(self.raw)
        odd = {w for w in new if len(w) >= self.long_run or "\n" in w or w in self.added}
        for w in odd:
            ids = [self.added[w]] if w in self.added else self.run(w)
            self.decimal[w], self.raw[w] = ",".join([self.numerals[i] for i in ids]), self.joined(ids)
        self.model.pre_tokenizer = self.by_line
        every = list(new.difference(odd))
        for a in range(0, len(every), AT_ONCE):
            plain = every[a : a + AT_ONCE]
            ids = self.model.encode_batch_fast(["\n".join(plain)], add_special_tokens=False)[0].ids
            decimal = ",".join(map(self.numerals.__getitem__, ids)).split(f",{self.line_end},")
            self.decimal.update(zip(plain, decimal, strict=True))
            self.raw.update(zip(plain, b"".join(map(self.bytes_of.__getitem__, ids)).split(b"\n"), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        pieces = [self.pieces(t) for t in texts]
        self.learn(pieces)
        return [np.fromstring(",".join(map(self.decimal.__getitem__, own)), np.int32, sep=",") for own in pieces]

    def joined(self, ids: list[int]) -> bytes:
        """The bytes that ids stand for."""
        n = len(self.bytes_of)
        return b"".join([self.bytes_of[i] for i in ids if 0 <= i < n])

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.joined(x).decode("utf-8", "replace") for x in ids]

    def round_trip(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """Of each text: the number of ids, their decimal text joined by commas, and the decoded bytes."""
        pieces = [self.pieces(t) for t in texts]
        self.learn(pieces)
        out = []
        for own in pieces:
            decimal = ",".join(map(self.decimal.__getitem__, own)).encode()
            back = b"".join(map(self.raw.__getitem__, own))
            out.append((decimal.count(b",") + (len(decimal) > 0), decimal, back.decode("utf-8", "replace").encode()))
        return out


def _groups(col: pa.Array):
    """Runs of texts of about `BATCH_BYTES`: (first row, end row, texts)."""
    end = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64))
    i, before = 0, 0
    while i < len(col):
        j = max(int(np.searchsorted(end, before + BATCH_BYTES, side="right")), i + 1)
        yield i, j, [x or "" for x in col.slice(i, j - i).to_pylist()]
        i, before = j, int(end[j - 1])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>)"""

    @trimmed

    def of(batches):
        codec = Codec(path)
        for b in batches:
            for i, j, texts in _groups(b.column(1)):
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array(codec.encode(texts), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(of, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)"""

    @trimmed

    def of(batches):
        codec = Codec(path)
        for b in batches:
            ids = [x or [] for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(codec.decode(ids), pa.string())], ["doc_id", "text"])

    return bounded(coded).select("doc_id", "ids").mapInArrow(of, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded and decoded in one pass, without moving the ids."""
    digest = lambda s: hashlib.sha256(s).hexdigest()

    @trimmed

    def of(batches):
        codec = Codec(path)
        for b in batches:
            for i, j, texts in _groups(b.column(1)):
                got = codec.round_trip(texts)
                cols = [pa.array([n for n, _, _ in got], pa.int64()), pa.array([digest(x) for _, x, _ in got]), pa.array([digest(x) for _, _, x in got])]
                yield pa.record_batch([b.column(0).slice(i, j - i), *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        of, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
