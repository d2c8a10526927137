r"""Secret scans: candidate strings judged by a random forest, with DataFrame functions only.

Candidates are what regular expressions find: long tokens with a digit, values assigned to a name
that speaks of a secret, and private key blocks, each to its end. Features of a candidate: its
length, its characters and the transitions between them, how much of it dictionary words cover, the
path, and the text beside it. The forest, trained from labelled findings, removes false positives.
Its trees become one SQL expression, so scanning is native: no Python on the executors, and no
shuffle.

Every place where a candidate stands is judged with the text beside it. A value that is judged a
secret at one place is a finding at all places where it is a candidate.

The dictionary is the `WORDS` words of four letters or more that most documents of the corpus have; the
transitions that count as common are the `PAIRS` most frequent ones of those words. The labelled
findings are a table (value, before, after, path, label); `labelled` makes one of a fixed size by
rule, for which no secret is real, as the tables here hold none. Training reads at most
`MOST_LABELLED` of them, those of the least hashes, on the driver.

A text is cut at its candidates by marks: U+0001, for which U+0002 stands meanwhile where the text
itself has one; the patterns take both alike.

Edge cases: a null or empty text has no findings; null ids are kept; findings that lie within
another are left out, and those that overlap are masked as one; what repeats a found value without
being a candidate there is masked too; repeated rows are scanned alike; an empty table gives no
rows; other columns, whatever their names, are passed through by `redact`. A text with k secrets is
copied k times by `redact`; scanning takes time in proportion to its length.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import unused
from loomline.llm.text_stats import let

TREES, TREE_DEPTH, MOST_LABELLED = 25, 6, 20_000
WORDS, PAIRS = 1_000, 120
MASK = "[SECRET]"

#: What a candidate is.
RUN = r"[A-Za-z0-9+/_\-]{16,}+"
NAMES = r"(?i)(?:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|credential)"
KEY_BEGIN = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
TOKEN = (
    r"(?<![A-Za-z0-9+/_=.\-])(?:eyJ[A-Za-z0-9_\-]{8,}+(?:\.[A-Za-z0-9_\-]{8,}+){1,2}|(?=[A-Za-z+/_\-]*[0-9])" + RUN + r"={0,2})"
)
BEFORE_VALUE = NAMES + r"[\w\-]{0,20}[\"']?\s{0,3}(?::=|=>|=|:)\s{0,3}[\"']?"
VALUE = r"[^\s\"'`,;<>|&#$%*]{8,}+"
KEY_BLOCK = KEY_BEGIN + r"[A-Za-z0-9+/=\s]*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
#: Each kind as what stands before it, and itself.
KINDS = {"key_block": ("", KEY_BLOCK), "assigned": (BEFORE_VALUE, VALUE), "token": ("", TOKEN)}
#: What every candidate has in it, made of its own pattern; without one of these a text isn't scanned.
GATES = (RUN, NAMES, KEY_BEGIN, "eyJ[A-Za-z0-9_-]{8}")

#: Words beside secrets and beside look-alikes.
NEAR_SECRET = "(?i)(passw|passphrase|pwd|secret|token|api.?key|access.?key|auth|bearer|credential|private)"
NEAR_OTHER = "(?i)(?<![a-z])(sha[0-9]*|commit|md5|checksum|digest|revision|uuid|guid|etag|integrity|build|trace|request.?id|order|card|isbn|phone|image|base64,)"
#: Words of code and configuration, which count as dictionary words besides those of the corpus.
CODE_WORDS = (
    "example", "sample", "dummy", "test", "fake", "placeholder", "change", "your", "insert", "replace", "here", "todo", "none", "null",
    "true", "false", "default", "value", "string", "user", "admin", "name", "file", "path", "image", "index", "config", "static", "public",
    "version", "module", "class", "function", "return", "import", "system", "service", "client", "server", "request", "response", "content",
    "header", "page", "data", "base", "time", "date", "token", "secret", "password", "hash", "node", "python", "java", "http",
)

#: Features by SQL over a candidate's value v, the text before b and after a it, and the path p.
FEATURES: dict[str, str] = {
    "size": "cast(length(z.v) as double)",
    "digits": "regexp_count(z.v, '[0-9]') / length(z.v)",
    "uppers": "regexp_count(z.v, '[A-Z]') / length(z.v)",
    "lowers": "regexp_count(z.v, '[a-z]') / length(z.v)",
    "others": "regexp_count(z.v, '[^A-Za-z0-9]') / length(z.v)",
    "distinct": "size(array_distinct(split(z.v, ''))) / length(z.v)",
    "turns": "regexp_count(z.v, '[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|[A-Z](?=[a-z])') / length(z.v)",
    "transitions": "regexp_count(lower(z.v), '(?={pairs})') / length(z.v)",
    "runs": "regexp_count(z.v, '(.)\\\\1\\\\1') / length(z.v)",
    "hex": "cast(z.v rlike '^[0-9a-fA-F]+$' as double)",
    "uuid": "cast(z.v rlike '^[0-9a-fA-F]{{8}}-([0-9a-fA-F]{{4}}-){{3}}[0-9a-fA-F]{{12}}$' as double)",
    "known": "cast(z.v rlike '^(AKIA|ASIA)[A-Z0-9]{{16}}$|^gh[pousr]_[A-Za-z0-9]{{30,}}|^xox[abprs]-|^AIza[A-Za-z0-9_-]{{30,}}|^sk[-_](live|test|proj)?|^eyJ[A-Za-z0-9_-]{{8,}}|^-----BEGIN' as double)",
    "covered": "1 - length(regexp_replace(lower(z.v), '{words}', '')) / length(z.v)",
    "path_test": "cast(lower(z.p) rlike 'test|example|sample|fixture|mock|docs?/' as double)",
    "near_secret": f"cast(z.b rlike '{NEAR_SECRET}' as double)",
    "near_other": f"cast(z.b rlike '{NEAR_OTHER}' as double)",
    "assigned": "cast(z.b rlike '[:=]>?\\\\s{{0,3}}[\"\\']?$' as double)",
    "quoted": "cast(z.b rlike '[\"\\']$' and z.a rlike '^[\"\\']' as double)",
    "in_path": "cast(z.b rlike '[/.@?&]$' or z.a rlike '^[/.@(]' as double)",
}


@dataclass(frozen=True)
class Judge:
    """A trained forest and the dictionary that its features use."""

    words: tuple[str, ...]
    forest: str = "1.0d"

    def features(self, v: str, b: str, a: str, p: str) -> str:
        """A SQL struct of the features of a candidate, of which z has the parts."""
        by = {"words": _any_of(self.words), "pairs": "|".join(_common_pairs(self.words)) or "(?!)"}
        named = ", ".join(f"'{k}', cast({e.format(**by)} as double)" for k, e in FEATURES.items())
        return f"element_at(transform(array(named_struct('v', {v}, 'b', coalesce({b}, ''), 'a', coalesce({a}, ''), 'p', coalesce({p}, ''))), z -> named_struct({named})), 1)"


def _any_of(words: tuple[str, ...]) -> str:
    """A pattern for any of the words, the longest first, told apart by their first letter."""
    by: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (-len(w), w)):
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by.items())) or "(?!)"


def _common_pairs(words: tuple[str, ...]) -> list[str]:
    pairs = Counter(w[k : k + 2] for w in words for k in range(len(w) - 1))
    return sorted(p for p, _ in sorted(pairs.items(), key=lambda x: (-x[1], x[0]))[:PAIRS])


def dictionary(docs: DataFrame, text_col: str = "text", most: int = WORDS) -> tuple[str, ...]:
    """The words of a-z, four letters or more, that most documents have; and words of code."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit("[a-z]{4,16}+"), F.lit(0)))
    top = docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(most)
    return tuple(sorted({r.w for r in top.collect()} | set(CODE_WORDS)))


def labelled(spark: SparkSession, n: int = 4_800) -> DataFrame:
    """Labelled findings made by rule: (value, before, after, path, label), every value derived from a hash."""
    hexed = lambda salt: f"sha2(concat('{salt}', id), 256)"
    mixed = lambda salt: f"translate(base64(unhex({hexed(salt)})), '+/=', 'qZ7')"
    pick = lambda salt, *xs: f"element_at(array({', '.join(repr(x) for x in xs)}), cast(1 + pmod(xxhash64('{salt}', id), {len(xs)}) as int))"
    said = pick("s", "", "", "", "", "as the build said, ", "commit it. ", "order now: ", "the image has ", "see checksum; ")
    key = pick("k", 'token = "', 'secret: "', 'api_key="', "password = '", "access_key = ", "API_TOKEN=", "auth_token: ", 'client_secret => "', "Bearer ")
    key = f"concat({said}, {key})"
    word = pick("w", "thing", "value", "ethere", "nation", "handler", "stion", "wording", "ander", "reading")
    kinds = [
        (1, f"left({hexed('a')}, 40)", key, "'\"'"),
        (1, f"left({hexed('b')}, 32)", key, "'\"'"),
        (1, mixed("c"), key, "'\"'"),
        (1, f"left({mixed('d')}, 24)", key, "'\"'"),
        (1, f"concat('AKIA', upper(left(translate({mixed('e')}, '0189', 'ABCD'), 16)))", pick("ke", "", "key ", "id = ", '"'), "' '"),
        (1, f"concat('ghp_', left({mixed('f')}, 36))", pick("kf", "", "use ", "token ", '"'), "' '"),
        (1, f"concat(left({mixed('g')}, 10), '!', left({mixed('h')}, 3))", pick("kg", 'password = "', "pwd: ", "passwd=", "secret = '"), "'\"'"),
        (1, f"left({hexed('i')}, 64)", key, "'\"'"),
        (1, f"concat('sk_live_', left({mixed('j')}, 24))", pick("kj", "", "key = ", '"'), "' '"),
        (0, f"left({hexed('A')}, 40)", pick("n", "commit ", "sha1 ", "revision: ", "Merge commit ", "sha = "), "' '"),
        (0, f"left({hexed('B')}, 32)", pick("n2", "md5 ", "checksum: ", "etag: ", "md5sum = ", "digest "), "' '"),
        (0, f"{hexed('C')}", pick("n3", "sha256:", "integrity=", "digest: ", "sha256 = "), "' '"),
        (0, f"concat_ws('-', left({hexed('D')}, 8), left({hexed('E')}, 4), left({hexed('F')}, 4), left({hexed('G')}, 4), left({hexed('H')}, 12))", pick("n4", "uuid ", "id: ", "request_id=", "", "guid = "), "' '"),
        (0, pick("n5", "your_api_key_here1", "example_token_value_1", "change_me_please_123", "xxxxxxxxxxxxxxxx1", "test_secret_key_0000", "placeholder-value-01", "dummy-password-1234"), key, "'\"'"),
        (0, f"concat({word}, '_', {pick('w2', 'from', 'with', 'to', 'by')}, '_', {pick('w3', 'request', 'header', 'config', 'client')}, cast(id % 10 as string))", key, "' '"),
        (0, f"translate(left({hexed('I')}, 16), 'abcdef', '024689')", pick("n6", "card ", "call ", "order ", "isbn ", "", "number "), "' '"),
        (0, f"concat({word}, {word}, {pick('w4', 'tion', 'ing', 'ed', 'est')}, cast(id % 7 as string))", pick("n7", "the ", "of ", "and ", "", "with "), "' '"),
        (0, f"concat({pick('w5', 'assets', 'static', 'images', 'lib')}, '/', {word}, '/', {word}, cast(id % 100 as string))", pick("n8", "/", "./", "src=", "file: "), "'.'"),
        (0, f"left({mixed('J')}, 40)", pick("n9", "data:image/png;base64,", "image base64, ", "base64,"), "'/'"),
        (0, f"concat({pick('w6', 'pass', 'get', 'read', 'the')}, {word}, {word})", pick("na", "password: ", "token = ", "secret: ", "password is "), "' '"),
        (1, f"concat('eyJ', left({mixed('p')}, 20), '.eyJ', left(repeat(concat({mixed('q')}, {pick('h1', 'x', '')}, {hexed('r')}, {hexed('r2')}), 6), cast(30 + pmod(xxhash64('l', id), 600) as int)), '.', {mixed('s')})", pick("kp", 'token = "', "Bearer ", "use ", "auth_token: ", ""), "'\"'"),
        (1, f"concat('-----BEGIN PRIVATE KEY-----', repeat(concat(if(id % 2 = 0, {mixed('t')}, {hexed('t')}), if(id % 3 = 0, {mixed('u')}, {hexed('u')}), chr(10)), cast(2 + pmod(xxhash64('m', id), 200) as int)), '-----END PRIVATE KEY-----')", pick("kt", "", "key: ", " "), "' '"),
        (1, f"concat(left({word}, 4), {pick('x1', '!', '.', '?', '@', '+', '-')}, initcap({pick('x2', 'horse', 'river', 'staple', 'winter', 'tiger')}), cast(10 + id % 89 as string))", pick("kx", 'password = "', 'passphrase: "', "pwd: ", "passwd=", "secret = '"), "'\"'"),
    ]
    rows = spark.range(n).withColumn("kind", F.col("id") % len(kinds))
    case = lambda at: F.expr("case " + " ".join(f"when kind = {k} then {x[at]}" for k, x in enumerate(kinds)) + " end")
    return rows.select(
        case(1).alias("value"), case(2).alias("before"), case(3).alias("after"),
        F.when(F.xxhash64("id") % 17 == 0, "tests/data").otherwise("src/main").alias("path"),
        F.expr("case " + " ".join(f"when kind = {k} then {x[0]}" for k, x in enumerate(kinds)) + " end").alias("label"),
    )


# --- the forest -------------------------------------------------------------------------


def _tree(x: np.ndarray, y: np.ndarray, names: list[str], rng: np.random.Generator, depth: int) -> str:
    """A tree as SQL over the fields of f; splits lower the Gini impurity most."""
    share = float(y.mean())
    if depth == 0 or len(y) < 8 or share in (0.0, 1.0):
        return f"{share:.4f}d"
    best, at = 1e-9, None
    base = 2 * share * (1 - share)
    for k in rng.choice(x.shape[1], max(2, x.shape[1] // 3), replace=False):
        order = np.argsort(x[:, k], kind="stable")
        v, t = x[order, k], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(cut):
            continue
        n = len(y)
        p, q = t[cut - 1] / cut, (t[-1] - t[cut - 1]) / (n - cut)
        gain = base - (cut * 2 * p * (1 - p) + (n - cut) * 2 * q * (1 - q)) / n
        if gain.max() > best:
            c = cut[gain.argmax()]
            best, at = gain.max(), (int(k), round(float((v[c] + v[c - 1]) / 2), 6))
    if at is None:
        return f"{share:.4f}d"
    k, bound = at
    low = x[:, k] <= bound
    if low.all() or not low.any():
        return f"{share:.4f}d"
    return f"if(f.{names[k]} <= {bound!r}d, {_tree(x[low], y[low], names, rng, depth - 1)}, {_tree(x[~low], y[~low], names, rng, depth - 1)})"


def forest(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, depth: int = TREE_DEPTH, seed: int = 11) -> str:
    """The mean of trees grown on resamples of the rows, as one SQL expression."""
    rng = np.random.default_rng(seed)
    if not len(y):
        return "1.0d"
    grown = []
    for _ in range(trees):
        at = rng.integers(0, len(y), len(y))
        grown.append(_tree(x[at], y[at], names, rng, depth))
    return "(" + " + ".join(grown) + f") / {float(trees)!r}d"


def train(findings: DataFrame, words: tuple[str, ...] = CODE_WORDS, trees: int = TREES) -> Judge:
    """The forest, from labelled findings."""
    judge = Judge(tuple(sorted(words)))
    rows = findings.filter("value is not null and length(value) > 0 and label is not null")
    rows = rows.orderBy(F.xxhash64("value", "before", "after", "path"), "value", "label").limit(MOST_LABELLED)
    got = rows.withColumn("f", F.expr(judge.features("value", "before", "after", "path"))).select("value", "label", "f.*").collect()
    got = sorted(got, key=lambda r: (r.value, r.label, *r[2:]))
    names = list(FEATURES)
    sql = forest(np.array([r[2:] for r in got], float).reshape(len(got), len(names)), np.array([r.label for r in got], float), names, trees)
    return Judge(judge.words, sql)


def default_judge(docs: DataFrame) -> Judge:
    """The forest of the findings made by rule, with the dictionary of these documents."""
    return train(labelled(docs.sparkSession), dictionary(docs))


# --- scanning ---------------------------------------------------------------------------

CONTEXT, AFTER = 48, 8
MARK, STAND_IN = "\x01", "\x02"
FOUND = "array<struct<kind:string,value:string,start:int,stop:int,score:double>>"
PARTS = "array<struct<kind:string,i:int,size:int,value:string,before:string,after:string>>"


def _parts(text: Column, kind: str) -> Column:
    """A text cut at the candidates of a kind: every second part is a candidate, and has a value and what stands beside it."""
    before, value = KINDS[kind]
    cut = F.split(F.regexp_replace(text, f"({before})({value})", f"$1{MARK}$2{MARK}"), MARK)

    def of(g: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            some = lambda f, k, n: f(F.coalesce(F.get(g, i + k), F.lit("")), F.lit(n))
            odd, own = i % 2 == 1, s
            b = F.right(F.concat(*(some(F.right, k, CONTEXT) for k in (-3, -2, -1))), F.lit(CONTEXT))
            a = F.left(F.concat(*(some(F.left, k, AFTER) for k in (1, 2, 3))), F.lit(AFTER))
            fields = (F.lit(kind), i, F.length(own), F.when(odd, own), F.when(odd, b), F.when(odd, a))
            return F.struct(*(f.alias(n) for f, n in zip(fields, ("kind", "i", "size", "value", "before", "after"), strict=True)))

        return F.transform(g, one)

    return let(cut, of)


def scan(docs: DataFrame, judge: Judge, least: float = 0.5, text_col: str = "text", path_col: str | None = "source", into: str = "secrets") -> DataFrame:
    """The rows with `into`: array of (kind, value, start, stop, score), by their place in the text."""
    if into in docs.columns:
        raise ValueError(f"the table has a column {into} already")
    own, path, parts, judged, good = unused([*docs.columns, into], "own", "path", "parts", "judged", "good")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    at = F.col(path_col).cast("string") if path_col and path_col in docs.columns else F.lit("")
    hint = reduce(Column.__or__, (text.rlike(g) for g in GATES))
    out = docs.withColumns({own: text, path: at})
    cut = F.concat(*(_parts(F.translate(own, MARK, STAND_IN), k) for k in KINDS))
    out = out.withColumn(parts, F.when(hint, cut).otherwise(F.array().cast(PARTS)))
    q = lambda name: f"`{name}`"
    score = f"element_at(transform(array({judge.features('c.value', 'c.before', 'c.after', q(path))}), f -> {judge.forest}), 1)"
    out = out.withColumn(
        judged, F.expr(f"transform({q(parts)}, c -> named_struct('kind', c.kind, 'i', c.i, 'size', c.size, 'value', c.value, 'score', if(c.value is null, -1.0d, {score})))")
    )
    out = out.withColumn(good, F.expr(f"array_distinct(transform(filter({q(judged)}, c -> c.score >= {least}d), c -> c.value))"))
    found = (
        f"aggregate({q(judged)}, named_struct('pos', 0, 'out', cast(array() as array<struct<start:int,stop:int,kind:string,value:string,score:double>>)), "
        "(a, c) -> named_struct('pos', if(c.i = 0, 0, a.pos) + c.size, 'out', "
        f"if(c.value is not null and array_contains({q(good)}, c.value), array_append(a.out, named_struct('start', a.pos, 'stop', a.pos + c.size, 'kind', c.kind, 'value', c.value, 'score', c.score)), a.out)), a -> a.out)"
    )
    # In order of their starts, the longest first; what ends within one before it is left out.
    ordered = f"array_sort({found}, (x, y) -> case when x.start <> y.start then x.start - y.start when x.stop <> y.stop then y.stop - x.stop when x.kind < y.kind then -1 when x.kind > y.kind then 1 else 0 end)"
    outer = (
        f"aggregate({ordered}, cast(array() as array<struct<kind:string,value:string,start:int,stop:int,score:double>>), "
        f"(a, x) -> if(size(a) > 0 and element_at(a, -1).stop >= x.stop, a, array_append(a, named_struct('kind', x.kind, 'value', if(instr(x.value, '\x02') > 0, substring({q(own)}, x.start + 1, x.stop - x.start), x.value), 'start', x.start, 'stop', x.stop, 'score', x.score))))"
    )
    return out.withColumn(into, F.when(F.size(good) > 0, F.expr(outer)).otherwise(F.array().cast(FOUND))).drop(own, path, parts, judged, good)


def findings(docs: DataFrame, judge: Judge, least: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, kind, start, length, score, value_sha256): one row for each place of each secret of each text."""
    (into,) = unused(docs.columns, "secrets")
    s = scan(docs, judge, least, into=into).select(F.col(id_col).alias("doc_id"), F.explode(into).alias("s"))
    return s.select("doc_id", "s.kind", "s.start", F.length("s.value").alias("length"), F.round("s.score", 4).alias("score"), F.sha2("s.value", 256).alias("value_sha256"))


def redact(docs: DataFrame, judge: Judge, least: float = 0.5, text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """The rows with each secret of their texts replaced by a mask; all columns stay."""
    (into,) = unused(docs.columns, "secrets")
    found = scan(docs, judge, least, text_col, path_col, into)
    text = F.col(text_col).cast("string")

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["pos"]
        more = F.when(fresh, F.concat(F.substr(text, a["pos"] + 1, s["start"] - a["pos"]), F.lit(MASK))).otherwise(F.lit(""))
        return F.struct(F.concat(a["out"], more).alias("out"), s["stop"].alias("pos"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"))
    masked = F.aggregate(into, start, step, lambda a: F.concat(a["out"], F.substr(text, a["pos"] + 1)))
    values = F.array_distinct(F.transform(into, lambda s: s["value"]))
    longest = F.array_sort(values, lambda x, y: F.length(y) - F.length(x))
    clean = F.aggregate(longest, masked, lambda t, v: F.replace(t, v, F.lit(MASK)))
    return found.withColumn(text_col, F.when(F.size(into) > 0, clean.cast(docs.schema[text_col].dataType)).otherwise(F.col(text_col))).select(docs.columns)
