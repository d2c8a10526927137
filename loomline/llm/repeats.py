"""Windows of a fixed length that occur again, over a whole corpus, with little shuffling.

A text is a sequence of units, bytes or words. Every window of `length` units is decided
exactly, but only few are shuffled one by one:

* Trigger: of the `gram`-unit grams inside a window, the one whose rolling hash is least (the
  leftmost of equals). Equal windows have equal triggers at equal places, and each window has
  one, whatever the text.
* Phrase: a run of neighbouring window starts that share their trigger, with the units that
  those windows cover. Neighbouring phrases overlap, so each window lies whole in one phrase.
* Parse: the phrases of all texts in order, one row each: hash of the trigger, hash of the
  phrase, text, place. About length / 2 windows share a row. Equal phrases at equal steps in a
  text, as text of a short period has, are one row with the step and their number.
* Dictionary: the distinct phrases with their counts, by a partial aggregation; a phrase that
  half of the texts hold is still one row for each task.

All windows of a phrase that occurs again occur again. Other windows can have an equal only in
a different phrase of the same trigger. So the suffixes of distinct phrases are compared only
where a trigger has several phrases, one copy of each phrase standing for all. The copies are
dealt by trigger. In the task the suffixes of byte phrases are put in their order, to a depth of
`length`, by doubling prefixes from 8 bytes on; those of equal rank are equal. Words are compared by
the Rabin-Karp hashes of their windows. A trigger with more than `CROWD` distinct phrases is not
gathered: the windows of its phrases are counted in Spark one by one, by two 64-bit hashes.

No unbounded group of rows is gathered in one task: groups are counted by partial aggregation and
joined back, which Spark splits where a key is frequent. What is collected in a row belongs to one
text or one phrase. Rows are known by a 64-bit hash of id and text, so ids may be null or repeated.
A text is held whole in its task, with about 100 bytes for each of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import BASES, bounded, buffers, mix, Rolling, signed, sliding_min, trimmed, U, word_hashes, words

CROWD = 4096
CHUNK_UNITS = 1 << 18
SPAN = 1024  # starts and counts of a phrase are packed as start * SPAN + count


@dataclass(frozen=True)
class Windows:
    """Windows of `length` units ("bytes" or "words") and the grams that part them."""

    units: str
    length: int
    gram: int

    def __post_init__(self) -> None:
        if not 1 <= self.gram <= self.length < SPAN:
            raise ValueError(f"1 <= gram <= length < {SPAN} is needed")

    def values(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A number for each unit, and the bounds of each text among the units."""
        if self.units == "bytes":
            return buf.astype(U) + U(1), off
        starts, ends, bounds = words(buf, off)
        return word_hashes(buf, starts, ends), bounds

    def phrases(self, values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each phrase: text, start within it, number of windows, trigger hash, phrase hash.

        The phrase hash of words is one of the Rabin-Karp hashes of all its windows, in order.
        """
        n = len(values) - self.length + 1
        none = np.zeros(0, np.int64)
        if n <= 0:
            return none, none, none, none.view(U), none.view(U)
        one = Rolling(values, BASES[0])
        grams = mix(one.windows(self.gram))
        place = np.arange(len(grams), dtype=U)
        least = sliding_min((grams & U(0xFFFFFFFF00000000)) | place, self.length - self.gram + 1)
        at = (least & U(0xFFFFFFFF)).astype(np.int64)
        inside = np.zeros(n + 1, np.int32)
        lo, hi = bounds[:-1], np.maximum(bounds[1:] - self.length + 1, bounds[:-1])
        np.add.at(inside, np.minimum(lo, n), 1)
        np.add.at(inside, np.minimum(hi, n), -1)
        inside = np.cumsum(inside[:n]) > 0
        new = inside.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
        a = np.flatnonzero(new)
        if not len(a):
            return none, none, none, none.view(U), none.view(U)
        stop = inside.copy()
        stop[:-1] &= (at[1:] != at[:-1]) | ~inside[1:]
        count = np.flatnonzero(stop) + 1 - a
        trigger = at[a]
        two = Rolling(values, BASES[1])
        if self.units == "words":
            whole = Rolling(mix(two.windows(self.length)), BASES[0]).slices(a, a + count)
        else:
            whole = two.slices(a, a + count + self.length - 1)
        whole = mix(mix(whole) + (count * 4 * SPAN + (trigger - a)).astype(U))
        text = np.searchsorted(bounds, a, side="right") - 1
        return text, a - bounds[text], count, grams[trigger], whole

    def hashes(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return mix(Rolling(values, BASES[0]).windows(self.length)), mix(Rolling(values, BASES[1]).windows(self.length))


PARSE = "trigger long, phrase long, key long, at long, more long"
#: A row's step and number of phrases are packed as step * STEPS + number.
STEPS = 1 << 32


def stepped(text: np.ndarray, at: np.ndarray, trigger: np.ndarray, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each run of equal phrases at equal steps in a text, and each run's packed step and number."""
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((at, phrase, trigger, text))
    t, a, g, p = text[order], at[order], trigger[order], phrase[order]
    group = np.concatenate([[True], (t[1:] != t[:-1]) | (g[1:] != g[:-1]) | (p[1:] != p[:-1])])
    step = np.concatenate([[0], np.diff(a)])
    step[group] = np.iinfo(np.int64).max
    head = np.flatnonzero(group)
    least = np.repeat(np.minimum.reduceat(step, head), np.diff(np.append(head, len(t))))
    first = np.flatnonzero(group | (step != least))
    number = np.diff(np.append(first, len(t)))
    return order[first], np.where(number > 1, least[first] * STEPS, 0) + number


def parse(keyed: DataFrame, w: Windows, with_id: bool) -> DataFrame:
    """The phrases of every text, with the text's id if asked for."""

    @trimmed

    def of(batches):
        for b in batches:
            ids, keys = (np.asarray(b.column(i)) for i in (0, 1))
            for i, _, buf, off in buffers(b.column(2)):
                text, at, count, trigger, phrase = w.phrases(*w.values(buf, off))
                first, more = stepped(text, at, trigger, phrase)
                cols = [signed(trigger[first]), signed(phrase[first]), pa.array(keys[i + text[first]]), pa.array((at * SPAN + count)[first]), pa.array(more)]
                names = ["trigger", "phrase", "key", "at", "more"]
                if with_id:
                    cols, names = [*cols, pa.array(ids[i + text[first]])], [*names, "id"]
                yield pa.record_batch(cols, names)

    return keyed.select("id", "key", "text").mapInArrow(of, PARSE + ", id long" * with_id)


def lists(col: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets and values of a list column whose nulls are empty lists."""
    n = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), 0)).astype(np.int64)
    return np.concatenate([[0], np.cumsum(n)]), col.flatten()


COPIES = "trigger long, phrase long, low long, n int, body binary"


def _copies(chosen: DataFrame, w: Windows) -> DataFrame:
    """One copy of each of the chosen phrases: the numbers of its units."""

    @trimmed

    def of(batches):
        for b in batches:
            bounds, found = lists(b.column(1))
            if not len(found):
                continue
            at, trigger, phrase, low = (np.asarray(found.field(i)) for i in range(4))
            for i, j, buf, off in buffers(b.column(0)):
                values, unit = w.values(buf, off)
                if w.units == "bytes":
                    values = buf
                lo, hi = bounds[i], bounds[j]
                row = np.repeat(np.arange(j - i), np.diff(bounds[i : j + 1]))
                start, n = unit[row] + at[lo:hi] // SPAN, at[lo:hi] % SPAN
                body = [values[s:e].tobytes() for s, e in zip(start.tolist(), (start + n + w.length - 1).tolist(), strict=True)]
                yield pa.record_batch(
                    [pa.array(trigger[lo:hi]), pa.array(phrase[lo:hi]), pa.array(low[lo:hi]), pa.array(n.astype(np.int32)), pa.array(body, pa.binary())],
                    ["trigger", "phrase", "low", "n", "body"],
                )

    return chosen.select("text", "found", "own").mapInArrow(of, COPIES)


def _windows_of(b: pa.RecordBatch, w: Windows) -> tuple[np.ndarray, ...]:
    """Of each window of the copies in a batch: (copy, offset, its place among the copies' units, those units)."""
    n = np.asarray(b.column("n")).astype(np.int64)
    raw = np.frombuffer(b"".join(b.column("body").to_pylist()), np.uint8)
    size = n + w.length - 1
    copy = np.repeat(np.arange(len(n)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return copy, step, (np.cumsum(size) - size)[copy] + step, raw if w.units == "bytes" else raw.view(U)


def _hashed_windows(b: pa.RecordBatch, w: Windows) -> tuple[np.ndarray, ...]:
    """Of each window of the copies in a batch: (copy, offset, h1, h2)."""
    copy, step, place, values = _windows_of(b, w)
    h1, h2 = w.hashes(values.astype(U) + U(1) if w.units == "bytes" else values)
    return copy, step, h1[place], h2[place]


def suffix_ranks(raw: np.ndarray, length: int) -> np.ndarray:
    """The rank of each string of `length` bytes among those of the sequence, in their order; equal strings have equal ranks.

    Prefixes are doubled from 8 bytes on: the rank of a longer one is that of the ranks of its halves.
    """
    n = len(raw) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    have = min(8, length)
    rank = np.zeros(len(raw) - have + 1, U)
    for k in range(have):
        rank = rank << U(8) | raw[k : len(raw) - have + 1 + k]
    rank = np.unique(rank, return_inverse=True)[1]
    while have < length:
        more = min(have, length - have)
        rank = np.unique(rank[: len(rank) - more].astype(U) << U(32) | rank[more:].astype(U), return_inverse=True)[1]
        have += more
    return rank


def _ordered(copies: DataFrame, w: Windows, earlier: bool) -> DataFrame:
    """(trigger, phrase, low, offs) of the copies' windows that count, by ordering a trigger's suffixes in the task."""

    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        low = np.asarray(batch.column("low"))
        if w.units == "bytes":
            copy, step, place, raw = _windows_of(batch, w)
            rank = suffix_ranks(raw, w.length)[place]
            order = np.argsort(rank, kind="stable")
            new = np.ones(len(order), bool)
            new[1:] = rank[order][1:] != rank[order][:-1]
        else:
            copy, step, h1, h2 = _hashed_windows(batch, w)
            order = np.lexsort((h2, h1))
            new = np.ones(len(order), bool)
            new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        head = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        own = low[copy[order]]
        if earlier:
            hit = np.minimum.reduceat(own, head)[group] < own
        else:
            hit = (np.diff(np.append(head, len(order)))[group] > 1) & (own == 0)
        at = np.sort(order[hit])
        bounds = np.searchsorted(copy[at], np.arange(batch.num_rows + 1))
        offs = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(step[at].astype(np.int32)))
        out = pa.record_batch([batch.column("trigger"), batch.column("phrase"), batch.column("low"), offs], ["trigger", "phrase", "low", "offs"])
        return out.filter(pa.array(np.diff(bounds) > 0))

    @trimmed

    def of(batches):
        held: list[pa.RecordBatch] = []
        units = 0
        for b in batches:
            trigger = np.asarray(b.column(0))
            cuts = np.flatnonzero(trigger[1:] != trigger[:-1]) + 1
            a = 0
            if held and len(trigger) and trigger[0] != held[-1].column(0)[-1].as_py():
                cuts = np.concatenate([[0], cuts])
            size = np.cumsum(np.asarray(b.column(3)).astype(np.int64) + w.length)
            for c in cuts.tolist():
                if units + (size[c - 1] if c else 0) - (size[a - 1] if a else 0) < CHUNK_UNITS:
                    continue
                if c > a:
                    held.append(b.slice(a, c - a))
                yield judged(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, units, a = [], 0, c
            if a < b.num_rows:
                held.append(b.slice(a))
                units += int(size[-1] - (size[a - 1] if a else 0))
        if held:
            yield judged(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    dealt = copies.repartition("trigger").sortWithinPartitions("trigger")
    return dealt.mapInArrow(of, "trigger long, phrase long, low long, offs array<int>")


def _counted(copies: DataFrame, w: Windows, earlier: bool) -> DataFrame:
    """The same by counting every window in Spark, for triggers with many phrases."""

    @trimmed

    def of(batches):
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                copy, step, h1, h2 = _hashed_windows(part, w)
                each = [np.asarray(part.column(i))[copy] for i in range(3)]
                yield pa.record_batch(
                    [signed(h1), signed(h2), *map(pa.array, each), pa.array(step.astype(np.int32))], ["h1", "h2", "trigger", "phrase", "low", "off"]
                )

    suffix = copies.mapInArrow(of, "h1 long, h2 long, trigger long, phrase long, low long, off int")
    if earlier:
        same = suffix.groupBy("h1", "h2").agg(F.min("low").alias("least"), F.max("low").alias("most")).filter("least < most")
        part = suffix.join(same, ["h1", "h2"]).filter("least < low")
    else:
        same = suffix.groupBy("h1", "h2").agg(F.count("*").alias("m")).filter("m > 1")
        part = suffix.filter("low = 0").join(same, ["h1", "h2"])
    return part.groupBy("trigger", "phrase").agg(F.first("low").alias("low"), F.collect_set("off").alias("offs"))


def repeated(docs: DataFrame, w: Windows, earlier: bool, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """(id, text, marks): of each text, the windows that occur again.

    earlier: only windows that also start in a text with a smaller id count; else those that
    start anywhere else, in the same text too. marks: array of (at, more, offs), for a phrase of
    at % SPAN windows from at // SPAN on, and more % STEPS - 1 others like it at steps of more // STEPS;
    offs, where not null, has those of its windows that count.
    A null id is smaller than all others.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    raw = F.col(id_col).cast("long")
    keyed = bounded(docs).select(raw.alias("own"), F.coalesce(raw, F.lit(-(1 << 63))).alias("id"), text.alias("text")).withColumn("key", F.xxhash64("own", "text"))
    # The filters that always hold keep the columns and conditions of each use alike, so that Spark
    # moves the texts and the parse once for all uses.
    rows = parse(keyed, w, earlier).filter("trigger is not null and phrase is not null")
    sums = [F.first("key").alias("key"), F.first("at").alias("at")]
    sums += [F.min("id").alias("low"), F.max("id").alias("high")] if earlier else [F.sum(F.col("more").bitwiseAND(STEPS - 1)).alias("n")]
    entry = rows.groupBy("trigger", "phrase").agg(*sums)
    entry = entry.filter("key is not null and at is not null and " + ("low is not null and high is not null" if earlier else "n > 0"))
    again: Column = F.col("low") < F.col("high") if earlier else F.col("n") > 1
    per = [F.count("*").alias("phrases")] + ([F.min("low").alias("least"), F.max("high").alias("most")] if earlier else [])
    several = entry.groupBy("trigger").agg(*per).filter("phrases > 1" + (" and least < most" if earlier else ""))
    compared = entry.join(several.select("trigger", (F.col("phrases") > crowd).alias("crowd")), "trigger")
    mark = F.col("low") if earlier else F.when(again, F.lit(1)).otherwise(F.lit(0)).cast("long")

    def copies(which: str) -> DataFrame:
        chosen = compared.filter(which).groupBy("key").agg(F.collect_list(F.struct("at", "trigger", "phrase", mark.alias("low"))).alias("found"))
        return _copies(keyed.select("key", "own", "text").join(chosen, "key"), w)

    part = _ordered(copies("not crowd"), w, earlier).unionByName(_counted(copies("crowd"), w, earlier))
    whole = entry.filter(again).select("trigger", "phrase", F.lit(None).cast("array<int>").alias("offs"), *(["low"] if earlier else []))
    hits = whole.unionByName(part.select(whole.columns))
    met = rows.join(hits, ["trigger", "phrase"])
    if earlier:
        met = met.filter("(offs is null and id > low) or (offs is not null and id = low)")
    marks = met.groupBy("key").agg(F.collect_list(F.struct("at", "more", "offs")).alias("marks"))
    return keyed.select("key", "own", "text").join(marks, "key", "left").select(F.col("own").alias("id"), "text", "marks")


def covered(marks: pa.Array, unit: np.ndarray, i: int, j: int, n: int, w: Windows, cache: dict) -> np.ndarray:
    """Which of n units lie under a marked window; rows i to j of the batch, whose texts begin at `unit`."""
    if "bounds" not in cache:
        cache["bounds"], found = lists(marks)
        some = len(found) > 0
        cache["at"], cache["more"] = (np.asarray(found.field(k)) if some else np.zeros(0, np.int64) for k in (0, 1))
        offs = found.field(2) if some else pa.array([], pa.list_(pa.int32()))
        cache["null"] = np.asarray(offs.is_null())
        cache["offs"], each = lists(offs)
        cache["off"] = np.asarray(each).astype(np.int64)
    bounds, at, more = cache["bounds"], cache["at"], cache["more"]
    lo, hi = bounds[i], bounds[j]
    row = np.repeat(np.arange(j - i), np.diff(bounds[i : j + 1]))
    start, count = unit[row] + at[lo:hi] // SPAN, at[lo:hi] % SPAN
    step, number = more[lo:hi] // STEPS, more[lo:hi] % STEPS
    full = cache["null"][lo:hi]
    edge = np.zeros(n + 1, np.int64)

    def mark(first: np.ndarray, size: np.ndarray | int, steps: np.ndarray, times: np.ndarray) -> None:
        """Marks `size` units from `first` on, and as often again at the steps."""
        k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        begin = np.repeat(first, times) + k * np.repeat(steps, times)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + (np.repeat(size, times) if isinstance(size, np.ndarray) else size), -1)

    mark(start[full], count[full] + w.length - 1, step[full], number[full])
    each = np.diff(cache["offs"][lo : hi + 1])
    one = np.repeat(start, each) + cache["off"][cache["offs"][lo] : cache["offs"][hi]]
    mark(one, w.length, np.repeat(step, each), np.repeat(number, each))
    return np.cumsum(edge[:n]) > 0
