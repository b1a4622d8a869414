"""Fill-in-the-middle: texts cut at two random units into prefix, middle and suffix, by a parallel automaton scan.

A finite automaton over bytes knows where units start (``[A-Za-z]+|[^A-Za-z]`` over code points) and whether a control
string has been met. Texts are cut into chunks anywhere, and a chunk is scanned for all states at once: it yields the
function from the state before it to the state after it, and for each state before it the number of units that start in
it. Functions compose associatively, so a scan by doubling resolves the state before every chunk and the units up to it,
and only the two chunks that hold the cuts are walked once more. Chunks of usual texts stay in the task that has the
text; a text above ``giant`` bytes is dealt out by pieces, whose functions, composition and selection are Spark's rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
CHUNK = 512


class Automaton:
    """States are what of a control string has been read, and whether the last character is a letter; a met control string is never left."""

    def __init__(self, controls: Sequence[str]):
        words = [c.encode() for c in controls]
        met = b"\x00met"
        heads = {w[:k] for w in words for k in range(len(w))} | {b""}

        def step(state, byte: int):
            head, letter = state
            if 0x80 <= byte < 0xC0:  # the rest of a character
                return state, 0
            now = bytes([byte]).isalpha()
            if head != met:
                read = head + bytes([byte])
                head = met if any(read.endswith(w) for w in words) else next(read[k:] for k in range(len(read) + 1) if read[k:] in heads)
            return (head, now), int(not (now and letter))

        states, at = [(b"", False)], 0
        table = []
        while at < len(states):
            row = [step(states[at], b) for b in range(256)]
            for s, _ in row:
                if s not in states:
                    states.append(s)
            table.append([(states.index(s), n) for s, n in row])
            at += 1
        every = np.array(table)  # state, byte, (next, units)
        columns, self.kind = np.unique(every.transpose(1, 0, 2).reshape(256, -1), axis=0, return_inverse=True)
        columns = columns.reshape(len(columns), len(states), 2)
        self.kind = self.kind.ravel().astype(np.int32)
        self.next, self.units = np.ascontiguousarray(columns[:, :, 0]).ravel().astype(np.int32), np.ascontiguousarray(columns[:, :, 1]).ravel().astype(np.int64)
        self.size, self.met = len(states), np.array([s[0] == met for s in states])

    def functions(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every chunk (start to end in ``data``) and every state before it: the state after it, and the units that start in it."""
        order = np.argsort(start - end, kind="stable")
        first, length = start[order], (end - start)[order]
        state = np.tile(np.arange(self.size, dtype=np.int32), (len(start), 1))
        count = np.zeros((len(start), self.size), np.int64)
        active = len(first)
        for t in range(int(length.max(initial=0))):
            active = int(np.searchsorted(-length[:active], -t))  # those longer than t come first
            place = state[:active] + (self.kind[data[first[:active] + t]] * self.size)[:, None]
            count[:active] += self.units.take(place)
            state[:active] = self.next.take(place)
        out, n = np.empty_like(state), np.empty_like(count)
        out[order], n[order] = state, count
        return out, n

    @staticmethod
    def composed(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.take_along_axis(second[0], first[0], 1), first[1] + np.take_along_axis(second[1], first[0], 1)

    def resolved(self, functions: tuple[np.ndarray, np.ndarray], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each chunk the composition of all from the first of its text to itself; ``index``: its place in its text."""
        state, count = functions
        far = 1
        while far <= index.max(initial=0):
            late = np.flatnonzero(index >= far)
            s, n = self.composed((state[late - far], count[late - far]), (state[late], count[late]))
            state, count = state.copy(), count.copy()
            state[late], count[late] = s, n
            far *= 2
        return state, count

    def place(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Where, in chunks that are entered in ``state``, unit number ``wanted`` (from 0) starts."""
        at, left, state = end.copy(), wanted.copy(), state.astype(np.int32)
        for t in range(int((end - start).max(initial=0))):
            open_ = np.flatnonzero((left >= 0) & (start + t < end))
            if not len(open_):
                break
            place = state[open_] + self.kind[data[start[open_] + t]] * self.size
            state[open_] = self.next[place]
            left[open_] -= self.units[place]
            at[open_[left[open_] < 0]] = (start[open_] + t)[left[open_] < 0]
        return at


@lru_cache(4)
def automaton(controls: tuple[str, ...]) -> Automaton:
    return Automaton(controls)


def chunks(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of texts that lie between ``bounds``: start, end, text, place in the text."""
    many = -(-np.diff(bounds) // size)
    text = np.repeat(np.arange(len(many)), many)
    index = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    start = bounds[:-1][text] + index * size
    return start, np.minimum(start + size, bounds[1:][text]), text, index


def cuts(data: np.ndarray, bounds: np.ndarray, draws: np.ndarray, machine: Automaton, size: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie between ``bounds`` in ``data``: units, whether a control string is in it, and the code points before each cut.

    ``draws`` has two numbers for each text; a cut is before unit ``draw % (units + 1)``, the last one at the end.
    """
    start, end, text, index = chunks(bounds, size)
    state, count = machine.resolved(machine.functions(data, start, end), index)
    units, met = np.zeros(len(bounds) - 1, np.int64), np.zeros(len(bounds) - 1, bool)
    last = np.flatnonzero(np.r_[text[1:] != text[:-1], np.ones(min(1, len(text)), bool)])
    units[text[last]], met[text[last]] = count[last, 0], machine.met[state[last, 0]]
    before = np.where(index > 0, np.r_[0, count[:-1, 0]][: len(text)], 0)
    entry = np.where(index > 0, np.r_[0, state[:-1, 0]][: len(text)], 0)
    wanted = np.sort(draws % (units + 1)[:, None], axis=1)
    place = np.repeat(bounds[1:][:, None], wanted.shape[1], axis=1)
    inner = wanted < units[:, None]
    row = np.nonzero(inner)[0]
    # units before a chunk grow along a text, so one search over all texts finds the chunks
    base = np.cumsum(units) - units
    k = np.searchsorted(before + base[text], wanted[inner] + base[row], side="right") - 1
    place[inner] = machine.place(data, start[k], end[k], entry[k], wanted[inner] - before[k])
    leads = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    return units, met, leads[place] - leads[bounds[:-1]][:, None]


FOUND = "struct<units:long,met:boolean,prefix_chars:long,middle_chars:long>"


def _scanned(controls: tuple[str, ...], limit: int):
    """The scan of usual texts, as a function of columns."""

    @F.pandas_udf(FOUND)
    def scanned(text: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
        raw = [t.encode("utf-8", "surrogatepass") for t in text]
        draws, sizes = np.stack([one.to_numpy(np.int64), two.to_numpy(np.int64)], axis=1), np.cumsum([len(t) for t in raw])
        out, a = [], 0
        while a < len(raw):
            b = max(a + 1, int(np.searchsorted(sizes, limit + (sizes[a - 1] if a else 0), side="right")))
            bounds = np.r_[0, np.cumsum([len(t) for t in raw[a:b]])].astype(np.int64)
            units, met, at = cuts(np.frombuffer(b"".join(raw[a:b]), np.uint8), bounds, draws[a:b], automaton(controls))
            out.append(pd.DataFrame({"units": units, "met": met, "prefix_chars": at[:, 0], "middle_chars": at[:, 1] - at[:, 0]}))
            a = b
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"units": [], "met": [], "prefix_chars": [], "middle_chars": []})

    return scanned


def draw(doc_id: Column, seed: int, k: int) -> Column:
    """Number ``k`` (from 1) of the draws of a document: eight hex digits of the sha256 of "seed:doc_id"; a null doc_id counts as the empty text."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digits, 8 * k - 7, 8), 16, 10).cast("long")


def _giants(rows: DataFrame, controls: tuple[str, ...], piece: int) -> DataFrame:
    """(digest, one, two, found) for texts that are dealt out by pieces; ``rows``: digest, text, one, two."""
    machine = automaton(controls)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text"), strict=True):
                raw = memoryview(text.as_buffer())
                for k in range(-(-len(raw) // piece)):
                    yield pa.RecordBatch.from_arrays([pa.array([digest]), pa.array([k], pa.int32()), pa.array([bytes(raw[k * piece : (k + 1) * piece])])], ["digest", "k", "body"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, k, body in zip(batch.column("digest").to_pylist(), batch.column("k").to_pylist(), batch.column("body"), strict=True):
                data = np.frombuffer(body.as_buffer(), np.uint8)
                start, end, _, index = chunks(np.array([0, len(data)]), CHUNK)
                state, count = machine.resolved(machine.functions(data, start, end), index)
                chars = int(np.count_nonzero((data & 0xC0) != 0x80))
                yield pa.RecordBatch.from_arrays([pa.array([digest]), pa.array([k], pa.int32()), pa.array([chars], pa.int64()), pa.array([state[-1].tolist()], pa.list_(pa.int32())), pa.array([count[-1].tolist()], pa.list_(pa.int64()))], ["digest", "k", "chars", "after", "units"])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for body, state, wanted in zip(batch.column("body"), batch.column("state").to_pylist(), batch.column("rest").to_pylist(), strict=True):
                data = np.frombuffer(body.as_buffer(), np.uint8)
                start, end, _, index = chunks(np.array([0, len(data)]), CHUNK)
                after, count = machine.resolved(machine.functions(data, start, end), index)
                j = int(np.searchsorted(count[:, state], wanted, side="right"))
                entry, done = (after[j - 1, state], count[j - 1, state]) if j else (state, 0)
                at = int(machine.place(data, start[j : j + 1], end[j : j + 1], np.array([entry]), np.array([wanted - done]))[0])
                found.append(int(np.count_nonzero((data[:at] & 0xC0) != 0x80)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("digest", "one", "two", "which")), pa.array(found, pa.int64())], ["digest", "one", "two", "which", "inside"])

    pieces = materialise(rows.select("digest", "text").mapInArrow(cut, "digest string, k int, body binary").dropDuplicates(["digest", "k"]), "pieces")
    spread = pieces.repartition(F.col("digest"), F.col("k"))
    functions = spread.mapInArrow(scan, "digest string, k int, chars long, after array<int>, units array<long>")
    # at most 2 GB / piece entries a text: the composition, as a fold over its functions
    begin = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("units"), F.lit(0).cast("long").alias("chars"), F.array().cast("array<struct<k:int,state:int,units:long,chars:long>>").alias("at"))

    def then(done, p):
        here = F.struct(p.k.alias("k"), done.state.alias("state"), done.units.alias("units"), done.chars.alias("chars"))
        return F.struct(F.element_at(p.after, done.state + 1).alias("state"), (done.units + F.element_at(p.units, done.state + 1)).alias("units"), (done.chars + p.chars).alias("chars"), F.concat(done["at"], F.array(here)).alias("at"))

    whole = functions.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("k", "chars", "after", "units"))).alias("all")).select("digest", F.aggregate("all", begin, then).alias("w"))
    states = F.array(*[F.lit(bool(x)) for x in machine.met])
    asked = rows.select("digest", "one", "two").distinct().join(whole, "digest")
    ordered = F.array_sort(F.array(F.pmod("one", F.col("w.units") + 1), F.pmod("two", F.col("w.units") + 1)))
    asked = materialise(asked.select("digest", "one", "two", F.col("w.units").alias("units"), states[F.col("w.state")].alias("met"), F.col("w.chars").alias("chars"), F.col("w.at").alias("at"), ordered.alias("cuts")), "asked")
    wanted = asked.select("digest", "one", "two", "units", "at", F.posexplode("cuts").alias("which", "unit")).where("unit < units")
    last = F.element_at(F.filter("at", lambda p: p.units <= F.col("unit")), -1)
    wanted = wanted.select("digest", "one", "two", "which", "unit", last.alias("p")).select("digest", "one", "two", "which", (F.col("unit") - F.col("p.units")).alias("rest"), F.col("p.k").alias("k"), F.col("p.state").alias("state"), F.col("p.chars").alias("chars"))
    placed = wanted.join(pieces, ["digest", "k"]).mapInArrow(locate, "digest string, one long, two long, which int, inside long")
    keys = ["digest", "one", "two", "which"]
    placed = wanted.select(*keys, "chars").join(placed, keys).groupBy("digest", "one", "two").agg(*(F.max(F.when(F.col("which") == i, F.col("chars") + F.col("inside"))).alias(f"c{i}") for i in (0, 1)))
    out = asked.join(placed, ["digest", "one", "two"], "left").withColumn("c0", F.coalesce("c0", "chars")).withColumn("c1", F.coalesce("c1", "chars"))
    return out.select("digest", "one", "two", F.struct("units", "met", F.col("c0").alias("prefix_chars"), (F.col("c1") - F.col("c0")).alias("middle_chars")).alias("found"))


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, giant: int = 1 << 20, limit: int = 4 << 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of ``docs``.

    ``n`` units; form ``psm`` (prefix, suffix, middle, each after its mark), ``spm`` (suffix first, for ``spm`` of a hundred)
    or ``plain`` (the text alone: empty, with a mark in it, or not among the ``rate`` of a hundred). The first two draws of
    a document set its cuts, so reruns agree and repeated rows give equal rows. Code points are counted; prefix_chars and
    middle_chars are null if plain. A null text counts as empty, a null doc_id draws as the empty text, texts are whole at
    any length (above ``giant`` bytes they are scanned by pieces in many tasks), an empty table gives no rows, and further
    columns of ``docs`` are ignored, whatever their names.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", *(draw(F.col("doc_id"), seed, k).alias(a) for k, a in ((1, "one"), (2, "two"), (3, "three"), (4, "four"))))
    usual = rows.where(F.octet_length("text") <= giant).withColumn("found", _scanned(MARKS, limit)("text", "one", "two"))
    large = rows.where(F.octet_length("text") > giant).withColumn("digest", F.sha2("text", 256))
    large = large.join(_giants(large, MARKS, giant), ["digest", "one", "two"]).select(usual.columns)
    every = usual.union(large).select("doc_id", "text", "three", "four", "found.*")
    plain = (F.col("text") == "") | F.col("met") | (F.col("three") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("four") % 100 < spm, "spm").otherwise("psm")
    every = every.withColumn("form", form)
    p, m = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix, middle, suffix = F.substring(F.col("text"), F.lit(1), p), F.substring(F.col("text"), p + 1, m), F.substring(F.col("text"), p + m + 1, F.length("text"))
    marks = [F.lit(x) for x in MARKS]
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(marks[0], prefix, marks[1], suffix, marks[2], middle)).otherwise(F.concat(marks[1], suffix, marks[0], prefix, marks[2], middle))
    cut = F.col("form") != "plain"
    return every.select("doc_id", F.col("units").alias("n"), "form", F.when(cut, F.col("prefix_chars")).alias("prefix_chars"), F.when(cut, F.col("middle_chars")).alias("middle_chars"), output.alias("output"))


def restored(form: Column, output: Column) -> Column:
    """The text again, from output and form alone: marks are never inside the parts, so they are found by themselves."""
    part = F.split(output, "|".join(MARKS))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))
