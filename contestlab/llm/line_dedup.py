"""Fuzzy line deduplication (operator 10), in DataFrame functions only.

Lines are normalised to their lower-cased words, told by 28-bit hashes, and equal ones fold into one by a 64-bit hash before anything
else is made of them. Lines of edit similarity 0.8 or more, over words, are linked, and all such pairs are found: with L words in the
longer line at most E = floor(0.2 L) edits are allowed, each of which touches three runs of three words at most, so the lines share
all but 3 E of these; if each line's runs are put in one order for all, both lines have one in common among their first few (prefix
filter, `_prefixed`). SimHash can't do that: lines at 0.8 differ in about 13 of 64 bits, which no block index finds cheaply. The order
puts runs of rare words first and runs that are often repeated last, as samples count them; it decides the cost and never the
result. Lines under a common run are tested by length and by a sketch (256 bits, of which each edit turns two at most), by the words
that one has and the other lacks, and then by edit distance. So that a crowd of near copies
does not make all its pairs, each line is first linked to the shortest line and its two neighbours in length under each of its runs; then all
lines are compared that are not yet connected. A run that very many lines have (a passage that they share) is split: of these lines,
pairs are found by runs of two words instead, and under crowded ones of these by single words, of which prefixes are shorter and hold rare words only. One occurrence of each connected group stays: the first by document id and line number.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, linked_groups, scratch, written

SIMILARITY = 0.8
#: A line of four words may be near one of five. Shorter lines are compared by equality alone.
LEAST_WORDS = 4
#: Words are counted in so many hash buckets, about so many of them.
BUCKETS, COUNTED = 1 << 16, 2_000_000
#: A word's code: its hash, and in the upper four bits how common its bucket is (-8 to 7), so that rare words have low codes.
HASH = (1 << 28) - 1
#: Runs are counted in a sample of about COUNTED, or of one line in SHARE if that is more: a run that CROWD lines have must be seen there,
#: whatever the size of the input. Those seen at least OFTEN times are marked in a bitmap of 64 bits a word, MARKS words or more.
OFTEN, SHARE, MARKS, MOST_MARKS = 6, 8, 1 << 14, 1 << 18
#: Bits of a run that lines meet by, the lower ones: other runs with the same ones only make candidates. They are moved to the upper end of a
#: long, where they stand beside the bytes of the key that differ from row to row: a shuffled row is then one piece that compresses
#: badly, and not two.
MET = 40
#: Blanks, control characters and ASCII punctuation part the words of a line.
PARTS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _found(line: Column) -> Column:
    """The lower-cased words of a line."""
    return F.array_remove(F.split(F.lower(line), PARTS), "")


def word_levels(docs: DataFrame, text: str) -> Column:
    """How common the words of each hash bucket are, counted in a sample of the texts, as an array: one step for each doubling."""
    body = F.col(f"`{text}`")
    total = docs.agg(F.sum(F.octet_length(body)).alias("n")).first().n or 0
    sample = docs.where(F.pmod(F.xxhash64(body), F.lit(1 + total // (6 * COUNTED))) == 0).select(F.explode(_found(body)).alias("word"))
    levels = [-8] * BUCKETS
    for r in sample.groupBy(F.hash("word").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).count().collect():
        levels[r.bucket] = min(7, int(log2(r["count"])) - 8)
    return F.split(F.lit(",".join(map(str, levels))), ",").cast("array<int>")


def lines_of(docs: DataFrame, levels: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, version, line_no, key, words): a row for each line, with its words' codes (none: a blank line); version tells apart texts under one id."""
    body = F.col(f"`{text}`")

    def code(word: Column) -> Column:
        level = F.get(levels, F.hash(word).bitwiseAND(F.lit(BUCKETS - 1)))
        return F.shiftleft(level, 28).bitwiseOR(F.hash(word).bitwiseAND(F.lit(HASH)))

    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(body).alias("version"), F.posexplode(F.split(body, "\n")).alias("line_no", "line")).select(
        "doc_id", "version", "line_no", _found(F.col("line")).alias("found")).select(
        "doc_id", "version", "line_no", F.xxhash64("found").alias("key"), F.transform("found", code).alias("words"))


def most_edits(n: Column, least: float = SIMILARITY) -> Column:
    """The edits that lines may differ in, the longer of which has n words."""
    return F.floor(n * (1 - least) + 1e-9).cast("int")


def _runs(words: Column, run: int) -> Column:
    """All runs of `run` words, 2 or 3, as 57-bit hashes under the sum of their words' levels (-24 to 21)."""
    n = F.size(words)
    part = lambda k: F.slice(words, F.lit(k), n - run + 1)
    runs = F.zip_with(part(1), part(2), lambda x, y: F.shiftleft(x.cast("long"), 32).bitwiseOR(y.bitwiseAND(F.lit(0xFFFFFFFF))))
    level = lambda xy: F.shiftright(xy, 60) + F.shiftright(F.shiftleft(xy, 32), 60)
    mixed = lambda xy, high: F.shiftleft(high, 57).bitwiseOR(xy.bitwiseXOR(F.shiftright(xy, 15)).bitwiseAND(F.lit((1 << 57) - 1)))
    if run == 3:
        return F.zip_with(runs, part(3), lambda xy, z: mixed(xy.bitwiseXOR(F.shiftleft(z.cast("long"), 14)), level(xy) + F.shiftright(z, 28)))
    return F.transform(runs, lambda xy: mixed(xy, level(xy)))


def _place(gram: Column, marks: Column) -> tuple[Column, Column]:
    """The word of a bitmap of `marks` words (a power of two), and the bit in it, that a run has."""
    return F.shiftrightunsigned(gram, 30).bitwiseAND(marks - 1).cast("int"), F.shiftrightunsigned(gram, 24).bitwiseAND(F.lit(63)).cast("int")


def often_repeated(lines: DataFrame) -> Column:
    """A bitmap of the runs of three words that a sample of the lines has often."""
    total = lines.agg(F.sum(F.size("words")).alias("n")).first().n or 0
    sample = lines.where((F.pmod("key", F.lit(min(SHARE, 1 + total // COUNTED))) == 0) & (F.size("words") > 3)).select(F.explode(F.array_distinct(_runs(F.col("words"), 3))).alias("gram"))
    marks = [0] * max(MARKS, min(MOST_MARKS, 1 << (total >> 12).bit_length()))
    word, bit = _place(F.col("gram"), F.lit(len(marks)))
    found = sample.groupBy("gram").count().where(F.col("count") >= OFTEN).select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit"))
    for r in found.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        marks[r.word] = r.bits & ((1 << 64) - 1)
    return F.split(F.lit(",".join(str(m - (1 << 64) if m >> 63 else m) for m in marks)), ",").cast("array<bigint>")


def _first_runs(words: Column, run: int, often: Column) -> Column:
    """The first runs in order of (often repeated, level, hash); as many as similar lines can't all miss.

    Lines of n and m >= n words share m - run + 1 - run E(m) of them, so n - m + run E(m) + 1 of the shorter line's are enough, which is
    most for m = n or n + 1.
    """
    n, runs = F.size(words), _runs(words, run)
    if run == 3:
        def late(gram: Column) -> Column:
            word, bit = _place(gram, F.size(often))
            marked = F.call_function("shiftrightunsigned", F.get(often, word), bit).bitwiseAND(F.lit(1))
            # the level, halved, and 16 for a marked run; both follow from the run alone
            return F.shiftleft(F.shiftright(gram, 58) + F.shiftleft(marked, 4), 58).bitwiseOR(gram.bitwiseAND(F.lit((1 << 58) - 1)))

        runs = F.transform(runs, late)
    first = F.slice(F.sort_array(runs), F.lit(1), F.greatest(run * most_edits(n), run * most_edits(n + 1) - 1) + 1)
    return F.array_distinct(F.transform(first, lambda gram: F.shiftleft(gram, 64 - MET)))


def _prefixed(lines: DataFrame, often: Column) -> DataFrame:
    """(gram, key): each line once for each of its first runs: of two words in lines up to six, which may have no three left, of three from six on."""
    words, n = F.col("words"), F.size("words")
    first = F.when(n > 6, _first_runs(words, 3, often)).when(n == 6, F.concat(_first_runs(words, 2, often), _first_runs(words, 3, often))).otherwise(_first_runs(words, 2, often))
    return lines.select("key", F.explode(first).alias("gram")).select("gram", "key")


def _pairs_prefixed(lines: DataFrame) -> DataFrame:
    """As `_prefixed`, by runs of two words: fewer of them are enough, so that long lines need not name a passage that many share."""
    return lines.select("key", F.explode(_first_runs(F.col("words"), 2, F.array())).alias("gram"))


def _words_prefixed(lines: DataFrame) -> DataFrame:
    """As `_prefixed`, by single words: lines of n and m >= n words share m - E(m) of them."""
    n = F.size("words")
    first = F.slice(F.sort_array("words"), F.lit(1), F.greatest(most_edits(n), most_edits(n + 1) - 1) + 1)
    return lines.select("key", F.explode(F.array_distinct(first).cast("array<bigint>")).alias("gram"))


def _sketched(members: DataFrame) -> DataFrame:
    """(key, sketch): the number of words, and 256 bits that tell for each hash of a word whether it occurs an odd number of times."""
    w = F.col("w")
    bits = [F.bit_xor(F.when(F.shiftright(w, 6).bitwiseAND(F.lit(3)) == k, F.call_function("shiftleft", F.lit(1).cast("long"), w.bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("long"))).alias(f"b{k}") for k in range(4)]
    return members.select("key", F.explode("words").alias("w")).groupBy("key").agg(F.count("*").cast("int").alias("n"), *bits).select("key", F.struct("n", "b0", "b1", "b2", "b3").alias("sketch"))


def _may(a: Column, b: Column) -> Column:
    """False only for lines that can't be similar: of E edits, n - m only take a word away, and the others turn two bits at most."""
    most = most_edits(F.greatest(a["n"], b["n"]))
    turned = sum((F.bit_count(a[f"b{k}"].bitwiseXOR(b[f"b{k}"])) for k in range(1, 4)), F.bit_count(a["b0"].bitwiseXOR(b["b0"])))
    return (F.abs(a["n"] - b["n"]) <= most) & (turned <= 2 * most - F.abs(a["n"] - b["n"]))


def _within(a: Column, b: Column, alphabet: Callable[[Column], Column], most: Column) -> Column:
    """Whether arrays of words are at most `most` edits apart; `alphabet` gives each word a number under 55,000, for a character below the surrogates."""
    one, two = (F.decode(F.unhex(F.array_join(F.transform(x, lambda w: F.lpad(F.hex(alphabet(w) + 256), 4, "0")), "")), "UTF-16BE") for x in (a, b))
    return F.call_function("levenshtein", one, two, most) >= 0


def may_be_similar(a: Column, b: Column, least: float = SIMILARITY) -> Column:
    """False only for arrays of word codes that can't be similar: every edit gives a line at most one word that the other lacks."""
    most = most_edits(F.greatest(F.size(a), F.size(b)), least)
    return (F.size(F.array_except(a, b)) <= most) & (F.size(F.array_except(b, a)) <= most)


def similar_pairs(near: DataFrame, keep: Callable[..., DataFrame], least: float = SIMILARITY) -> DataFrame:
    """The rows of `near` (a_words, b_words: arrays of word codes) with 1 - edits / longer length of `least` or more.

    The edit distance over words' remainders by 55,000 is a lower bound; where different words of the two lines share a remainder,
    their ranks among the lines' words are compared as well (not where these are more than 55,000).
    """
    a, b = F.col("a_words"), F.col("b_words")
    most = most_edits(F.greatest(F.size(a), F.size(b)), least)
    small, every = lambda w: F.pmod(w, F.lit(55000)), F.array_union(a, b)
    clash = (F.size(F.array_distinct(F.transform(every, small))) < F.size(every)) & (F.size(every) < 55000)
    near = keep(near.where(_within(a, b, small, most)).withColumn("every", F.when(clash, every)), dictionary=False)
    return near.where(F.col("every").isNull() | _within(a, b, lambda w: F.array_position("every", w), most)).drop("every")


def line_groups(lines: DataFrame, keep: Callable[..., DataFrame]) -> DataFrame:
    """(key, component): keys of the lines (key, words; each once) that are linked to others, with the smallest key of their group.

    Lines meet in the order of their keys, which is best that of their lengths (`numbered`).
    """
    lines = lines.where(F.size("words") >= LEAST_WORDS)

    def verified(pairs: DataFrame, members: DataFrame) -> DataFrame:
        one, two = (members.select(F.col("key").alias(k), F.col("words").alias(f"{k}_words")) for k in "ab")
        near = pairs.join(one, "a").join(two, "b").where(may_be_similar(F.col("a_words"), F.col("b_words")))
        return similar_pairs(near, keep).select("a", "b")

    return linked_groups(_prefixed(lines, often_repeated(lines)), lines, _sketched, _may, verified, keep, (_pairs_prefixed, _words_prefixed))


def numbered(n: Column) -> Column:
    """A number for each row of a table that is written with it: the length in its upper bits, then the part and the row; numbers of a part are close."""
    row, part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)), F.shiftright(F.monotonically_increasing_id(), 33)
    number = F.shiftleft(F.least(n, F.lit((1 << 14) - 1)).cast("long"), 49).bitwiseOR(F.shiftleft(part, 29)).bitwiseOR(row)
    return F.when((part < 1 << 20) & (row < 1 << 29), number).otherwise(F.raise_error(F.lit("over 2^20 parts, or 2^29 lines in one")).cast("long"))


def kept_lines(docs: DataFrame, keep: Callable[..., DataFrame], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, version, kept): the numbers of the lines of each text that repeat no earlier line, neither equal nor nearly so."""
    lines = keep(lines_of(docs, word_levels(docs, text), text, doc_id), dictionary=False, codec="zstd")
    folded = lines.select("key", "words").where(F.size("words") >= LEAST_WORDS).dropDuplicates(["key"]).withColumn("number", numbered(F.size("words")))
    folded = keep(folded, dictionary=False, codec="zstd")
    at = ["doc_id", "version", "line_no"]
    placed = keep(lines.select(*at, "key", (F.size("words") == 0).alias("blank")), dictionary=False, codec="zstd")
    # from here on words are needed once for each distinct line
    dropped(lines)
    groups = line_groups(folded.select(F.col("number").alias("key"), "words"), keep).withColumnRenamed("key", "number")
    groups = keep(folded.select("number", "key").join(groups, "number").select("key", "component"))
    # blank lines stay, each by itself
    blank = placed.where("blank").select(*at)
    placed = placed.where("not blank").join(groups, "key", "left").select(*at, F.col("component").isNotNull().alias("linked"), F.coalesce("component", "key").alias("part"))
    first = placed.groupBy("linked", "part").agg(F.min(F.struct(*at)).alias("first")).select("first.*")
    return keep(first.unionByName(blank).groupBy("doc_id", "version").agg(F.collect_set("line_no").alias("kept")))


def drop_repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs` with the text's repeated lines taken out, and n_lines and n_removed (columns of these names are replaced).

    Lines end at line feeds. Lines without words (blank, or punctuation only) always stay and are never compared. A text of which
    every line with words goes keeps its blank ones. Null texts stay null with 0 lines; empty texts have one blank line. Of
    equal or linked lines the first by (doc_id, version, line number) stays, a null id before all others. Repeated rows (same
    id and text) are one document: all of them keep and lose the same lines. An empty table gives an empty result.
    """
    body = F.col(f"`{text}`")
    carried = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    with scratch(docs.sparkSession) as keep:
        kept = written(kept_lines(docs, keep, text, doc_id)).select(F.col("doc_id").alias("k_id"), F.col("version").alias("k_version"), "kept")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"in_{k}") for k, c in enumerate(carried)], F.col(f"`{doc_id}`").alias("r_id"), F.xxhash64(body).alias("r_version"), body.alias("body"))
    rows = rows.join(kept, (F.col("r_version") == F.col("k_version")) & F.col("r_id").eqNullSafe(F.col("k_id")), "left")
    n = F.when(F.col("body").isNull(), 0).otherwise(F.length("body") - F.length(F.replace("body", F.lit("\n"))) + 1)
    left = F.coalesce(F.size("kept"), F.lit(0))
    rows = rows.withColumn("n", n).withColumn("left", F.when(F.col("n") == 0, 0).otherwise(left))
    new = F.when(F.col("n") == F.col("left"), F.col("body")).otherwise(
        F.array_join(F.transform(F.sort_array("kept"), lambda k: F.get(F.split("body", "\n"), k)), "\n"))
    new = F.when(F.col("body").isNotNull(), F.coalesce(new, F.lit("")))
    return rows.select(*[(new if c == text else F.col(f"in_{k}")).alias(c) for k, c in enumerate(carried)], F.col("n").cast("long").alias("n_lines"), (F.col("n") - F.col("left")).cast("long").alias("n_removed"))
