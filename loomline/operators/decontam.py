"""TF-IDF matching of texts against held-out texts, and embedding matches.

Weights are raw counts times ln((1 + n) / (1 + df)) + 1 over both sides together, rows at unit
length. Norms need all of a text's tokens; for the products, only tokens of the held-out side count.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W



WORD = re.compile("[a-z0-9]+")


def _tf(text: str | None) -> Counter:
    """How often a text has each word and each pair of neighbours."""
    w = WORD.findall((text or "").lower())
    n = Counter(w)
    n.update(map("_".join, zip(w, w[1:], strict=False)))
    return n


#: Tokens that a worker gathers, of more than one text at most, before it gives them on.
MOST_ROWS = 1 << 17


def _rows(b: pa.RecordBatch):
    """The batch's ids and texts, one at a time."""
    return ((i.as_py(), t.as_py()) for i, t in zip(b.column(0), b.column(1), strict=True))


def _text(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tok, tf): how often each text has each token, counted in its task."""

    def of(batches):
        pack = lambda ids, toks, tf: pa.record_batch([pa.array(ids, pa.int64()), pa.array(toks, pa.string()), pa.array(tf, pa.int64())], ["id", "tok", "tf"])
        for b in batches:
            ids, toks, tf = [], [], []
            for i, text in _rows(b):
                n = _tf(text)
                ids += [i] * len(n)
                toks += n.keys()
                tf += n.values()
                if len(ids) >= MOST_ROWS:
                    yield pack(ids, toks, tf)
                    ids, toks, tf = [], [], []
            yield pack(ids, toks, tf)

    return _text(docs, id_col, text_col).mapInArrow(of, "id long, tok string, tf long")


def held_counts(docs: DataFrame, toks: list[str]) -> DataFrame:
    """(k, df): in how many texts the k-th of some tokens occurs, where it does; each task gives its sums."""
    sent = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(toks)})

    def of(batches):
        places = sent.value
        n = np.zeros(len(places), np.int64)
        for b in batches:
            for _, text in _rows(b):
                n[[places[t] for t in _tf(text) if t in places]] += 1
        k = np.flatnonzero(n)
        yield pa.record_batch([pa.array(k), pa.array(n[k])], ["k", "df"])

    return _text(docs).mapInArrow(of, "k long, df long").groupBy("k").agg(F.sum("df").alias("df"))


def norms(docs: DataFrame, held_out: DataFrame, n: int) -> DataFrame:
    """(id, norm): the length of each text's weights, over all of its tokens.

    Tokens are moved once, as 64-bit hashes; those that share a hash share a task, which counts them in place.
    """
    row = lambda df, side: counts(df, "id", "text").select("id", F.xxhash64("tok").alias("h"), F.col("tf").cast("int").alias("tf"), F.lit(side).alias("side"))
    every = row(docs, 0).unionByName(row(held_out, 1)).withColumn("df", F.count("*").over(W.partitionBy("h"))).filter("side = 0")
    return every.groupBy("id").agg(F.sqrt(F.sum(F.pow(F.col("tf") * _idf(n), F.lit(2)))).alias("norm"))


def held_weights(docs: DataFrame, held_out: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(id, tok, weight) of the held-out side: of the texts only the held-out tokens are counted. More than `most` are joined."""
    held = counts(held_out, "id", "text")
    items = held.limit(most + 1).toArrow()
    if items.num_rows > most:
        return weights(docs, held_out).filter("side = 1").drop("side")
    toks = sorted(set(items["tok"].to_pylist()))
    known = docs.sparkSession.createDataFrame(pa.table({"k": pa.array(range(len(toks)), pa.int64()), "tok": pa.array(toks, pa.string())}), "k long, tok string")
    own = held.groupBy("tok").agg(F.count("*").alias("own"))
    df = known.join(held_counts(docs, toks), "k", "left").join(own, "tok").select("tok", (F.coalesce("df", F.lit(0)) + F.col("own")).alias("df"))
    return _unit(held.join(df, "tok").select("id", "tok", (F.col("tf") * _idf(docs.count() + held_out.count())).alias("w")))


def _idf(n: int) -> Column:
    return F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1


def _unit(w: DataFrame) -> DataFrame:
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "id").select("id", "tok", (F.col("w") / F.col("norm")).alias("weight"))


def weights(docs: DataFrame, held_out: DataFrame) -> DataFrame:
    """(side, id, tok, weight) of both sides' (id, text), each text's weights at unit length."""
    both = [counts(x, "id", "text") for x in (docs, held_out)]
    df = both[0].select("tok").unionByName(both[1].select("tok")).groupBy("tok").agg(F.count("*").alias("df"))
    n = docs.count() + held_out.count()
    x, y = (_unit(tf.join(df, "tok").select("id", "tok", (F.col("tf") * _idf(n)).alias("w"))).withColumn("side", F.lit(k)) for k, tf in enumerate(both))
    return x.unionByName(y).select("side", "id", "tok", "weight")


def best_match(docs: DataFrame, held_out: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(id, match_id, similarity): each text's closest held-out text; of equals the least id.

    A text that shares no token with any is matched to the least id at 0. The held-out tokens and their
    weights are broadcast if they are at most `most`; then a text is scored against all of them in its task, and
    only for its length do its counts meet the tokens' document counts. More are joined token by token.
    """
    items = counts(held_out, "id", "text").limit(most + 1).toArrow()
    if items.num_rows > most:
        return _joined(weights(docs, held_out), docs, held_out)
    n = docs.count() + held_out.count()
    near = _scored(docs, items, n).join(norms(docs, held_out, n), "id")
    each = F.transform("near", lambda x: F.struct(F.round(x["sum"] / F.col("norm"), 9).alias("s"), (-x["match_id"]).alias("m")))
    best = near.select("id", F.array_max(each).alias("best"))
    least = held_out.agg(F.min("id").alias("least"))
    out = docs.select("id").join(best, "id", "left").join(F.broadcast(least), how="cross")
    return out.select("id", F.coalesce(-F.col("best.m"), "least").alias("match_id"), F.coalesce("best.s", F.lit(0.0)).alias("similarity"))


def _scored(docs: DataFrame, items: pa.Table, n: int) -> DataFrame:
    """(id, near): for each text that shares a token with an item, the products (match_id, sum) that may be its greatest once they are rounded."""
    toks, at = np.unique(items["tok"].to_numpy(zero_copy_only=False), return_inverse=True)
    ids, item = np.unique(np.asarray(items["id"]), return_inverse=True)
    spark = docs.sparkSession
    found = held_counts(docs, toks.tolist()).toArrow()
    df = np.bincount(at, minlength=len(toks))
    df[np.asarray(found["k"]).astype(np.int64)] += np.asarray(found["df"])
    idf = np.log((1 + n) / (1 + df)) + 1
    w = np.asarray(items["tf"]) * idf[at]
    w = w / np.sqrt(np.bincount(item, w * w))[item]
    order = np.argsort(at, kind="stable")
    places = {t: k for k, t in enumerate(toks.tolist())}
    sent = spark.sparkContext.broadcast((ids, item[order], w[order], np.searchsorted(at[order], np.arange(len(toks) + 1)), places, idf))
    largest = float(np.log(1 + n) + 1)

    def of(batches):
        ids, item, value, bounds, places, idf = sent.value
        for b in batches:
            keys, near = [], []
            for i, text in _rows(b):
                tf = _tf(text)
                mine = [(places[t], c) for t, c in tf.items() if t in places]
                if not mine:
                    continue
                k, c = (np.array(x) for x in zip(*mine, strict=True))
                m = bounds[k + 1] - bounds[k]
                place = np.repeat(bounds[k], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                sums = np.bincount(item[place], np.repeat(c * idf[k], m) * value[place], minlength=len(ids))
                # Sums that round alike differ by less than this, whatever the text's length in the end.
                slack = 2e-9 * largest * np.sqrt(sum(x * x for x in tf.values()))
                top = np.flatnonzero(sums >= sums.max() - slack)
                keys.append(i)
                near.append([{"match_id": int(ids[t]), "sum": float(sums[t])} for t in top])
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(near, pa.list_(pa.struct([("match_id", pa.int64()), ("sum", pa.float64())])))], ["id", "near"])

    return _text(docs).mapInArrow(of, "id long, near array<struct<match_id:long,sum:double>>")


def _joined(w: DataFrame, docs: DataFrame, held_out: DataFrame) -> DataFrame:
    x, y = w.filter("side = 0"), w.filter("side = 1").select(F.col("id").alias("match_id"), "tok", F.col("weight").alias("v"))
    sims = x.join(y, "tok").groupBy("id", "match_id").agg(F.round(F.sum(F.col("weight") * F.col("v")), 9).alias("similarity"))
    best = sims.groupBy("id").agg(F.max_by(F.struct("match_id", "similarity"), F.struct("similarity", -F.col("match_id"))).alias("m"))
    least = held_out.agg(F.min("id").alias("least"))
    out = docs.select("id").join(best, "id", "left").join(F.broadcast(least), how="cross")
    return out.select("id", F.coalesce("m.match_id", "least").alias("match_id"), F.coalesce("m.similarity", F.lit(0.0)).alias("similarity"))


def flags(best: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """The best matches with `flagged`: at least the mean and three population deviations of all.

    The matches, a few numbers a text, are kept for their uses here and in `report`; they would be made anew for each.
    """
    best = best.persist(StorageLevel.DISK_ONLY)
    at = best.agg((F.avg("similarity") + sigmas * F.stddev_pop("similarity")).alias("threshold"))
    return best.join(F.broadcast(at), how="cross").withColumn("flagged", F.col("similarity") >= F.col("threshold") - 1e-9)


def report(flagged: DataFrame) -> DataFrame:
    """(rank, id, match_id, similarity): rank 0 has the threshold as its similarity; then the flagged pairs, the most similar first.

    Ranks follow from counts by rounded similarity, so no task holds all pairs.
    """
    some = flagged.filter("flagged").select("id", "match_id", F.round("similarity", 4).alias("similarity"))
    by = some.groupBy("similarity").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy(F.desc("similarity")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = some.join(by.select("similarity", before.alias("_before")), "similarity")
    rank = F.col("_before") + F.row_number().over(W.partitionBy("similarity").orderBy("id"))
    head = flagged.agg(F.max("threshold").alias("t")).select(F.lit(0).cast("long").alias("rank"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("match_id"), F.round("t", 4).alias("similarity"))
    return head.unionByName(placed.select(rank.alias("rank"), "id", "match_id", "similarity"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def tool_shape(a: Column, b: Column) -> Column:
    """Similarity of two arrays of calls (name, keys): the mean of the names' jaccard and of the shared tools' keys'."""
    names = lambda c: F.array_distinct(F.transform(c, lambda x: x["name"]))
    keys = lambda c, n: F.array_distinct(F.flatten(F.transform(F.filter(c, lambda x: x["name"] == n), lambda x: x["keys"])))
    shared = F.array_intersect(names(a), names(b))
    each = F.transform(shared, lambda n: jaccard(keys(a, n), keys(b, n)))
    mean = F.aggregate(each, F.lit(0.0), lambda s, v: s + v) / F.size(shared)
    return F.when(F.size(shared) > 0, (jaccard(names(a), names(b)) + mean) / 2).otherwise(0.0)


def centroid_match(vectors: DataFrame, most: int = 10_000) -> DataFrame:
    """(vec_id, match_label, similarity): the closest label centroid by cosine.

    Centroids are compared with every row, so their number is checked before they are broadcast.
    """
    cells = vectors.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    cents = cells.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("c"))
    if cents.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} labels")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    every = cents.agg(F.sort_array(F.collect_list(F.struct("label", "c"))).alias("all"))
    e = F.transform("embedding", lambda v: v.cast("double"))
    own = vectors.select("vec_id", e.alias("e")).join(F.broadcast(every), how="cross")
    cosine = lambda x: F.round(dot(F.col("e"), x["c"]) / F.sqrt(dot(F.col("e"), F.col("e")) * dot(x["c"], x["c"])), 6)
    best = own.select("vec_id", F.array_max(F.transform("all", lambda x: F.struct(cosine(x).alias("s"), (-x["label"]).alias("l")))).alias("m"))
    return best.select("vec_id", (-F.col("m.l")).alias("match_label"), F.col("m.s").alias("similarity"))
