"""A positional index of messages: words with the logs and places where they occur, so that a text query reads what it asks for.

Postings (bucket, token, log_id, places) lie in folders by bucket, a hash of a token's first two characters, sorted by
token inside: a term or prefix reads one folder, and of its files the row groups that can hold it. A query is answered
in two steps: postings of its words give the logs that can meet it (phrases by their places), and only these logs are
read and judged by the query itself; so postings of a message that has been replaced since do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import parse_query, terms_of, text_query

BUCKETS = 64


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(token, 1, 2)), F.lit(BUCKETS)).cast("int")


def postings(logs: DataFrame) -> DataFrame:
    """(bucket, token, log_id, places): a row for each word of each message; places from 0."""
    words = logs.select("log_id", F.posexplode(terms_of(F.col("message"))).alias("place", "token"))
    rows = words.groupBy("log_id", "token").agg(F.array_sort(F.collect_list("place")).alias("places"))
    return rows.select(_bucket(F.col("token")).alias("bucket"), "token", "log_id", "places")


def add(logs: DataFrame, path: str, batch: int = 0) -> None:
    """Writes the postings of ``logs`` (log_id, message) as one batch of the index; the same batch again takes its place. Hot buckets are dealt over several files."""
    rows = postings(logs)
    parts = int(logs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "bucket", "token", "log_id").sortWithinPartitions("bucket", "token", "log_id")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path.rstrip('/')}/batch={batch}")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token string, log_id string, places array<int>, batch long, bucket int").parquet(path)


def _leaves(x, out: list) -> list:
    """Terms, prefixes, phrases and fuzzy words that are not below a negation: what postings can tell."""
    if x[0] in ("and", "or"):
        _leaves(x[1], out)
        _leaves(x[2], out)
    elif x[0] in ("term", "phrase", "prefix", "fuzzy") and x not in out:
        out.append(x)
    return out


def _bounds(x, has) -> Column:
    """An upper bound of the query: what is negated may hold."""
    if x[0] in ("all", "not"):
        return F.lit(True)
    if x[0] in ("and", "or"):
        a, b = _bounds(x[1], has), _bounds(x[2], has)
        return a & b if x[0] == "and" else a | b
    return has(x)


def _needs_words(x) -> bool:
    """Whether a log that has none of the asked words can be left out."""
    if x[0] in ("all", "not"):
        return False
    if x[0] in ("and", "or"):
        return (any if x[0] == "and" else all)(_needs_words(y) for y in x[1:])
    return True


def _words(spark: SparkSession, text: str) -> list[str]:
    return spark.range(1).select(terms_of(F.lit(text))).first()[0]


def _is(word: str):
    return lambda f: f.token == word


def _shifted(k: int):
    """Places of a phrase's first word by those of its word number ``k``."""
    return lambda f: F.transform(f.places, lambda p: p - k)


def candidates(index: DataFrame, q: str) -> DataFrame | None:
    """(log_id): logs that can meet ``q`` by their postings; None where postings cannot tell (queries that bare negations can meet)."""
    spark, tree = index.sparkSession, parse_query(q)
    if tree is None:
        return index.select("log_id").limit(0)
    if not _needs_words(tree):
        return None
    leaves, wanted, tests = _leaves(tree, []), F.lit(False), {}
    for x in leaves:
        if x[0] == "prefix":
            low = x[1].lower()
            here = F.col("token").startswith(low) & (F.col("token") >= low)
            wanted = wanted | (here & (F.col("bucket") == _bucket(F.lit(low))) if len(low) > 1 else here)
            tests[x] = ("prefix", low)
        elif x[0] == "fuzzy":
            wanted = wanted | (F.levenshtein(F.col("token"), F.lit(x[1].lower()), x[2]) >= 0)
            tests[x] = ("fuzzy", x[1].lower(), x[2])
        else:
            words = _words(spark, x[1])
            if words:
                buckets = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(_bucket(F.col("w"))).distinct().collect()]
                wanted = wanted | (F.col("bucket").isin(*buckets) & F.col("token").isin(*words))
            tests[x] = (x[0], words)
    found = index.where(wanted).groupBy("log_id").agg(F.collect_list(F.struct("token", "places")).alias("found"))

    def has(x) -> Column:
        kind, *rest = tests[x]
        if kind == "prefix":
            return F.exists("found", lambda f: f.token.startswith(rest[0]))
        if kind == "fuzzy":
            return F.exists("found", lambda f: F.levenshtein(f.token, F.lit(rest[0]), rest[1]) >= 0)
        if not rest[0]:
            return F.lit(kind == "phrase")  # no words in it: left to the query itself
        if kind == "term":
            return F.exists("found", lambda f: f.token.isin(*rest[0]))
        starts = None
        for k, w in enumerate(rest[0]):
            at = F.flatten(F.transform(F.filter("found", _is(w)), _shifted(k)))
            starts = at if starts is None else F.array_intersect(starts, at)
        return F.size(starts) > 0

    return found.where(_bounds(tree, has)).select("log_id")


def search_text(logs: DataFrame, index: DataFrame, q: str) -> DataFrame:
    """The rows of ``logs`` that meet ``q`` (as search(q=...) gives them), by way of the index; only candidates are judged."""
    near = candidates(index, q)
    rows = logs if near is None else logs.join(near, "log_id", "left_semi")
    return rows.where(text_query(q, F.col("message")))
