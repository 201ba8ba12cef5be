"""Source divergence audit over a minimal acyclic transducer vocabulary (operator 11).

Each language keeps the terms that enough of its documents hold. From the sorted kept terms a minimal acyclic transducer is built state by
state (Daciuk et al., 2000): equal suffixes share states, and a transition gives the number of terms before it, so that the sum along a
term's path is its ordinal in byte order. Documents are streamed through the transducer to count the kept terms of every (language,
source), now without any term as a string; differences of smoothed shares follow, with ordinals to break ties.

A language's terms are cut into blocks of at most BLOCK, each built in one task. The transducers go out by broadcast, at most PASS_BYTES of them
in one pass over the documents; a larger vocabulary takes more passes, each one's counts written and its broadcast destroyed before the next.
"""

from __future__ import annotations

import sys
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Documents of its language that a term must be in, the unit of shares, what is added to a count, and the ranks that part `term` gives.
LEAST_DOCS, UNIT, ADDED, RANKS = 30, 1_000_000_000, 5, 50
#: Terms of a transducer, its bytes that one pass sends out, terms that a task holds before it gives its counts on.
BLOCK, PASS_BYTES, HELD = 1 << 16, 96_000_000, 200_000
#: Bytes of text that a task streams through a transducer at once (a longer text goes alone): each takes some 15 bytes of arrays.
CHUNK = 2_000_000
#: Cells (sources x terms) compared in one task, and its most terms.
CELLS, WIDTH = 4_000_000, 4096
#: Ways in which the rows of one (language, source) are dealt out.
SALTS = 32
#: Lower-cases A-Z; every byte but letters and those from 0x80 on parts terms.
TERM_BYTES = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(data: bytes) -> list[bytes]:
    return data.translate(TERM_BYTES).split()


class Transducer:
    """Flat tables: for state s and byte class c, cell s * classes + c holds the next state (0: none) and the number of terms before it."""

    def __init__(self, terms: list[bytes]):
        """`terms` are distinct, not empty and in byte order."""
        final, arcs = [False], [{}]  # of minimal states; 0 is none
        register: dict[tuple, int] = {}

        def settled(end: bool, out: dict[int, int]) -> int:
            key = (end, *out.items())
            if key not in register:
                register[key] = len(final)
                final.append(end)
                arcs.append(out)
            return register[key]

        path: list[list] = [[False, {}]]  # states along the last term, not yet minimal
        last = b""
        for term in [*terms, b""]:
            same = 0
            while same < len(term) and same < len(last) and term[same] == last[same]:
                same += 1
            while len(path) > same + 1:  # the rest of the last term can no longer change
                end, out = path.pop()
                path[-1][1][last[len(path) - 1]] = settled(end, out)
            for _ in term[same:]:
                path.append([False, {}])
            if term:
                path[-1][0] = True
            last = term
        self.start = settled(*path[0])
        used = sorted({b for out in arcs for b in out})
        self.classes = len(used) + 1  # class 0: a byte that no term has
        self.of_byte = np.zeros(256, np.uint8 if self.classes <= 256 else np.uint16)
        self.of_byte[used] = np.arange(1, self.classes)
        self.final = np.array(final)
        self.next, self.before = np.zeros(len(final) * self.classes, np.int32), np.zeros(len(final) * self.classes, np.int32)
        below = np.zeros(len(final), np.int64)
        for s in range(1, len(final)):  # arcs lead to states settled earlier
            n = int(final[s])
            for b, to in arcs[s].items():
                at = s * self.classes + int(self.of_byte[b])
                self.next[at], self.before[at] = to, n
                n += int(below[to])
            below[s] = n

    def ordinals(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The ordinal of each stretch of `data` that is a term, else -1; all stretches move on by one byte at a time."""
        found = np.full(len(start), -1, np.int64)
        live, at, left = np.arange(len(start)), start, length
        state, total = np.full(len(start), self.start, np.int32), np.zeros(len(start), np.int32)
        while len(live):
            cell = state.astype(np.int64) * self.classes + self.of_byte[data[at]]
            state, total, left, at = self.next[cell], total + self.before[cell], left - 1, at + 1
            ended = (left == 0) & self.final[state]
            found[live[ended]] = total[ended]
            on = (left > 0) & (state > 0)
            live, at, left, state, total = live[on], at[on], left[on], state[on], total[on]
        return found


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, docs): documents that hold each term, pre-aggregated in the task."""
    held: dict[str, Counter] = defaultdict(Counter)

    def given() -> Iterator[pa.RecordBatch]:
        for lang, found in held.items():
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([t.decode("utf-8", "replace") for t in found], pa.string()), pa.array(list(found.values()), pa.int64())],
                                                 names=["lang", "term", "docs"])
        held.clear()

    for batch in batches:
        for lang, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            held[lang].update(set(terms_of(data.as_py())))
            if sum(map(len, held.values())) > HELD:
                yield from given()
    yield from given()


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, ord): each language's terms in at least `least` of its documents, numbered from 0 in byte order; ranked by range, not in one task."""
    raw = docs.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(_distinct, "lang string, term string, docs long")
    kept = raw.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("lang", "term")
    placed = written(kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").withColumn("at", F.monotonically_increasing_id()))
    # the place of a row is its partition and its number there; partitions and languages are few
    part = F.shiftright("at", 33)
    runs = placed.groupBy("lang", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = runs.select("lang", "part", "first", F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    named = placed.withColumn("part", part).join(F.broadcast(before), ["lang", "part"])
    return named.select("lang", "term", (F.col("before") + F.col("at") - F.col("first")).alias("ord"))


def _built(terms: pd.DataFrame) -> pd.DataFrame:
    terms = terms.sort_values("ord")
    words = [t.encode() for t in terms["term"]]
    machine = Transducer(words)
    return pd.DataFrame({"lang": [terms["lang"].iloc[0]], "base": [int(terms["ord"].iloc[0])], "first": [words[0]], "last": [words[-1]], "tables": [cloudpickle.dumps(vars(machine))]})


def transducers(kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, base, first, last, tables): the transducers of each language's blocks of at most `block` terms; `base` is the first one's ordinal."""
    return kept.withColumn("block", F.floor(F.col("ord") / block)).groupBy("lang", "block").applyInPandas(_built, "lang string, base long, first binary, last binary, tables binary")


def _passes(built: DataFrame, most: int) -> list[list[tuple[str, int]]]:
    """Blocks, by language and base, that go out together: at most `most` bytes, or one block."""
    out, size = [], most + 1
    for r in built.select("lang", "base", F.length("tables").alias("n")).orderBy("lang", "base").collect():
        if size + r.n > most:
            out.append([])
            size = 0
        out[-1].append((r.lang, r.base))
        size += r.n
    return out


def _prefix(words: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(w[:8].ljust(8, b"\0"), "big") for w in words], np.uint64)


def _stream(held):
    """A function over batches of (lang, source, text) that gives (lang, source, ord, n) by the transducers in `held`, pre-aggregated in the task."""

    def machines() -> dict:
        if "machines" not in held.value:
            own = defaultdict(list)
            for lang, base, first, last, tables in held.value["blocks"]:
                machine = object.__new__(Transducer)
                vars(machine).update(cloudpickle.loads(tables))
                own[lang].append((base, *_prefix([first, last]), machine))
            held.value["machines"] = dict(own)
        return held.value["machines"]

    def counted(texts: list[bytes], sources: np.ndarray, blocks: list) -> tuple[np.ndarray, np.ndarray]:
        text = b" ".join(texts)
        data = np.frombuffer(text.translate(TERM_BYTES) + b" " * 9, np.uint8)
        inside = np.diff(np.concatenate([[False], data != 32]).astype(np.int8))
        start = np.flatnonzero(inside == 1)
        length = np.flatnonzero(inside == -1) - start
        ends = np.cumsum([len(t) + 1 for t in texts])
        source = sources[np.searchsorted(ends, start, side="right")]
        if len(blocks) > 1:  # eight bytes of a term say which blocks can hold it
            key = np.zeros(len(start), np.uint64)
            for j in range(8):
                key = (key << np.uint64(8)) | np.where(length > j, data[start + j], 0).astype(np.uint64)
        out = []
        for base, first, last, machine in blocks:
            own = slice(None) if len(blocks) == 1 else (key >= first) & (key <= last)
            number = machine.ordinals(data, start[own], length[own])
            hit = number >= 0
            out.append((source[own][hit].astype(np.int64) << 40) | (number[hit] + base))
        return np.unique(np.concatenate(out), return_counts=True)

    def summed(texts: list[bytes], sources: np.ndarray, blocks: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size, parts, first = 0, [], 0
        for k, text in enumerate(texts):
            if k > first and size + len(text) > CHUNK:
                parts.append(counted(texts[first:k], sources[first:k], blocks))
                first, size = k, 0
            size += len(text)
        parts.append(counted(texts[first:], sources[first:], blocks))
        both, at = np.unique(np.concatenate([both for both, _ in parts]), return_inverse=True)
        n = np.zeros(len(both), np.int64)
        np.add.at(n, at, np.concatenate([n for _, n in parts]))
        return both >> 40, both & ((1 << 40) - 1), n

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machines()
        for frame in batches:
            rows, names = defaultdict(lambda: ([], [])), {}
            for lang, source, text in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), frame.column(2)):
                if lang in own:
                    texts, sources = rows[lang]
                    texts.append(text.as_py())
                    sources.append(names.setdefault(source, len(names)))
            labels = list(names)
            for lang, (texts, sources) in rows.items():
                source, number, n = summed(texts, np.array(sources), own[lang])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([labels[s] for s in source.tolist()], pa.string()), pa.array(number, pa.int64()), pa.array(n, pa.int64())],
                                                 names=["lang", "source", "ord", "n"])

    return batch


def term_counts(docs: DataFrame, built: DataFrame, most: int = PASS_BYTES) -> list[DataFrame]:
    """Tables of (lang, source, ord, n), one a pass over the documents: occurrences of the kept terms, each in one of the tables."""
    spark, out = docs.sparkSession, []
    for block in _passes(built, most):
        chosen = built.join(F.broadcast(spark.createDataFrame(block, "lang string, base long")), ["lang", "base"], "left_semi")
        held = spark.sparkContext.broadcast({"blocks": [(r.lang, r.base, bytes(r["first"]), bytes(r["last"]), bytes(r.tables)) for r in chosen.collect()]})
        rows = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(_stream(held), "lang string, source string, ord long, n long")
        out.append(written(rows.groupBy("lang", "source", "ord").agg(F.sum("n").alias("n"))))
        held.destroy()
    return out


def _share(n: str, total: str, v: str) -> F.Column:
    """1 + floor(UNIT * (n + ADDED) / (total + ADDED * v)), exact for totals under 9e15: a long division, three digits at a time."""
    a, b = f"({n} + {ADDED})", f"({total} + {ADDED} * {v})"
    whole, rest = f"({a} div {b})", f"({a} % {b})"
    for _ in range(3):
        whole, rest = f"({whole} * 1000 + {rest} * 1000 div {b})", f"({rest} * 1000 % {b})"
    return F.expr(f"1 + {whole}")


def _shares(n: np.ndarray, total: np.ndarray, v: int) -> np.ndarray:
    a, b = n + ADDED, total + ADDED * v
    whole, rest = a // b, a % b
    for _ in range(3):
        whole, rest = whole * 1000 + rest * 1000 // b, rest * 1000 % b
    return whole + 1


def _apart(groups: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """Summed differences of all pairs of a language's sources over one stretch of its terms."""
    groups = groups.sort_values("source").reset_index(drop=True)
    first, width, v = int(groups["first"].iloc[0]), int(groups["width"].iloc[0]), int(groups["v"].iloc[0])
    n = np.zeros((len(groups), min(width, v - first)), np.int64)
    n[groups["source"].searchsorted(counts["source"]), counts["ord"] - first] = counts["n"]
    p = _shares(n, groups["total"].to_numpy()[:, None], v) if v else n
    a, b = np.triu_indices(len(groups), 1)
    value = np.concatenate([np.abs(p[k + 1:] - p[k]).sum(axis=1) for k in range(len(groups))]) if len(groups) > 1 else []
    names = groups["source"].to_numpy()
    return pd.DataFrame({"lang": groups["lang"].iloc[0], "a": names[a], "b": names[b], "value": np.array(value, np.int64)})


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """How far each source of a language is from its other sources (part `pair`) and which terms set it apart from its language (part `term`).

    Rows: lang, source, part, item, value, rank. Null text, language and source are read as ''. A language without kept terms has pairs of value 0;
    a source alone in its language has none. Equal values rank by item in byte order. Repeated rows count repeatedly, other columns are not looked
    at, and an empty table gives an empty result. Every pair of a language's sources is a row of the result.
    """
    spark = docs.sparkSession
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang), ("source", source), ("text", text))])
    with scratch(spark) as keep:
        kept = keep(kept_terms(rows, least))
        built = keep(transducers(kept))
        tables = term_counts(rows, built)
        counts = tables[0] if tables else spark.createDataFrame([], "lang string, source string, ord long, n long")
        for more in tables[1:]:
            counts = counts.unionByName(more)
        sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
        sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
        groups = keep(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v")))

        per = groups.groupBy("lang").agg(F.count("*").alias("__s")).select("lang", F.greatest(F.lit(1), F.least(F.lit(WIDTH), F.floor(F.lit(CELLS) / F.col("__s")))).cast("long").alias("width"))
        per = keep(per)
        stretches = groups.join(per, "lang").withColumn("first", F.explode(F.expr("sequence(0L, greatest(v - 1, 0L), width)")))
        dealt = counts.join(per, "lang").select("lang", "source", "ord", "n", F.expr("ord div width * width").alias("first"))
        apart = stretches.groupBy("lang", "first").cogroup(dealt.groupBy("lang", "first")).applyInPandas(_apart, "lang string, a string, b string, value long")
        both = apart.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).select("lang", F.explode(F.array(
            F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("e"), "value")
        own = Window.partitionBy("lang", "source")
        pairs = both.select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value").withColumn("rank", F.row_number().over(own.orderBy(F.desc("value"), "item")))

        whole = counts.groupBy("lang", "ord").agg(F.sum("n").alias("lang_n"))
        totals = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
        salted = groups.join(totals, "lang").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rated = counts.withColumn("salt", F.pmod("ord", F.lit(SALTS)).cast("int")).join(salted, ["lang", "source", "salt"]).join(whole, ["lang", "ord"])
        rated = rated.select("lang", "source", "ord", (_share("n", "total", "v") - _share("lang_n", "lang_total", "v")).alias("value")).where("value > 0")
        # the best of each salt's share first, so that one source's terms don't meet in one task
        by = [F.desc("value"), F.col("ord")]
        best = rated.withColumn("k", F.row_number().over(Window.partitionBy("lang", "source", F.pmod("ord", F.lit(SALTS))).orderBy(*by))).where(F.col("k") <= ranks)
        best = best.withColumn("rank", F.row_number().over(own.orderBy(*by))).where(F.col("rank") <= ranks)
        terms = best.join(kept, ["lang", "ord"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
        return written(pairs.unionByName(terms))
