"""Operators 11 to 13 against brute force and against the tokenizers library: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from contestlab.llm import bpe, divergence, html_text, queries, substring, vector_codes

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    stock = ["the", "then", "them", "there", "over", "lover", "Ä", "é", "日本", "x" * 30, "a", "an", "ant"]
    rows = [(k, " ".join(draw.choices(stock, k=draw.randint(0, 30))), draw.choice(["en", "de", None]), draw.choice(["web", "books", None, "日"])) for k in range(60)]
    rows += [(100, None, "en", "web"), (101, "", "fr", "only"), (102, "rare words", "es", "one"), (103, "rare words", "es", "two"), (5, "the then", "en", "web"), (5, "the then", "en", "web"),
             (104, " ".join(f"the{k % 7}there" for k in range(20_000)), "en", "long"), (None, "the\x00over\tTHE_the", "en", "web")]
    return rows


def brute_divergence(rows, least, ranks):
    held, groups, docs = defaultdict(Counter), set(), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in TERM.findall(text or "")]
        groups.add((lang, source))
        held[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((w for w, n in docs[lang].items() if n >= least), key=str.encode)
        own = {s: Counter({w: held[lang, s][w] for w in kept}) for la, s in groups if la == lang}
        p = {s: {w: 1 + 10 ** 9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept} for s, c in own.items()}
        every = Counter()
        for c in own.values():
            every.update(c)
        q = {w: 1 + 10 ** 9 * (every[w] + 5) // (sum(every.values()) + 5 * len(kept)) for w in kept}
        for s in own:
            pairs = sorted(((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in own if o != s))
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)]
            terms = sorted((q[w] - p[s][w], w.encode()) for w in kept if own[s][w] and p[s][w] > q[w])[:ranks]
            out += [(lang, s, "term", w.decode(), -v, k) for k, (v, w) in enumerate(terms, 1)]
    return sorted(out)


def test_divergence_against_brute_force(spark, texts, monkeypatch):
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("x") for c in ("value", "ord", "total", "v", "n", "first")}).repartition(5)
    for least, ranks in ((3, 4), (1, 50), (1000, 50)):
        assert sorted(map(tuple, divergence.source_divergence(df, least=least, ranks=ranks).collect())) == brute_divergence(texts, least, ranks)
    assert divergence.source_divergence(df.limit(0)).isEmpty()


def test_blocks_and_passes_give_the_same_counts(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = divergence.kept_terms(docs, 2).cache()
    whole = divergence.term_counts(docs, divergence.transducers(kept))
    parts = divergence.term_counts(docs, divergence.transducers(kept, block=3), most=3000)
    assert len(whole) == 1 and len(parts) > 2
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, whole[0].collect()))


def test_streaming_memory_does_not_follow_the_batch():
    import tracemalloc

    import pyarrow as pa
    from pyspark import cloudpickle
    terms = [f"the{c}".encode() for c in "abcdefg"]
    block = ("en", 0, terms[0], terms[-1], cloudpickle.dumps(vars(divergence.Transducer(terms))))
    text = " ".join(t.decode() for t in terms) * 60
    frame = pa.RecordBatch.from_arrays([pa.array(["en"] * 9000), pa.array(["a", "b", "c"] * 3000), pa.array([text.encode()] * 9000)], names=["lang", "source", "text"])
    held = type("Held", (), {"value": {"blocks": [block]}})
    tracemalloc.start()
    out = [r for b in divergence._stream(held)(iter([frame])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the end of a repetition and the start of the next are one word
    want = {k: 60 * 3000 if 0 < k < 6 else 3000 for k in range(7)}
    assert {(r["source"], r["ord"], r["n"]) for r in out} == {(s, k, n) for s in "abc" for k, n in want.items()} and len(out) == 21
    assert peak < 90_000_000, peak  # the texts themselves are 19 MB


def test_transducer_is_minimal_and_ordered():
    words = sorted({w.encode() for w in ("tap", "taps", "top", "tops", "stop", "stops", "a", "é", "日本", "日")})
    machine = divergence.Transducer(words)
    data = np.frombuffer(b" ".join([*words, b"to", b"tapsx", b"\xff", b"zzz"]), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in [*words, b"to", b"tapsx", b"\xff", b"zzz"]]) - 1
    start = np.concatenate([[0], ends[:-1] + 1])
    assert machine.ordinals(data, start, ends - start).tolist() == [*range(len(words)), -1, -1, -1, -1]
    # one state for each set of endings that some prefix has
    rests = {frozenset(w[len(p):] for w in words if w.startswith(p)) for w in words for p in (w[:k] for k in range(len(w) + 1))}
    assert len(machine.final) - 1 == len(rests)


@pytest.fixture(scope="module")
def tables():
    return bpe.read_tokenizer(queries.TOKENIZER)


def test_bpe_against_the_library(spark, tables):
    library, draw = Tokenizer.from_file(queries.TOKENIZER), random.Random(3)
    stock = [" ", "a", "the", "é", "日本", "\n", "\t", "  ", "'s", "'ll", "1", "23", ".", "!!", "<|endoftext|>", "<|endo", "ing", " ", " ", "xxxxx", "\x1c", "\x85", "​", "😀", "̀", "\x00"]
    rows = [(k, "".join(draw.choices(stock, k=draw.randint(0, 60)))) for k in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "ab" * 50_000), (1003, "".join(draw.choices("abcdefgh", k=60_000))), (1004, " " * 30_000), (3, rows[3][1]), (None, "<|endoftext|>" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit("other"))
    encoded = bpe.encode_texts(df, tables)
    got = encoded.collect()
    assert len(got) == len(rows) and all(r.n_tokens == "other" for r in got)
    for r in got:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
    for r in bpe.decode_ids(encoded.withColumnRenamed("text", "before"), tables).collect():
        assert r.text == library.decode(r.ids, skip_special_tokens=False) == (r.before or "")
    broken = spark.createDataFrame([([200, 60000, -1],), (None,), ([],)], "ids array<int>")
    assert [r.text for r in bpe.decode_ids(broken, tables).collect()] == [library.decode([200]), None, ""]
    assert bpe.encode_texts(df.limit(0), tables).isEmpty()


def test_bpe_query_against_the_library(spark):
    library = Tokenizer.from_file(queries.TOKENIZER)
    got = {r.doc_id: r for r in queries.op12_bpe(spark, SF).collect()}
    docs = queries.table(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_small_tables_of_pieces_and_pairs_change_nothing(tables, monkeypatch):
    library, draw = Tokenizer.from_file(queries.TOKENIZER), random.Random(4)
    monkeypatch.setattr(bpe, "CACHED", 3)
    encoder = bpe.Encoder(tables)
    for _ in range(50):
        text = "".join(draw.choices("abcdefghijklmno etaoin", k=200))
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def brute_codes(rows, entries, rounds, parts=4):
    kept = [(k, label, [int(np.floor(1024 * float(x))) for x in v]) for k, label, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(kept[0][2]) // parts
    cut = [[r[2][p * w: p * w + w] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, book: min((dist(v, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[near(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(x) for x in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    out, totals = [], Counter()
    for (k, label, _), c in zip(kept, cut):
        best = [near(c[p], books[p]) for p in range(parts)]
        out.append((k, label, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
        totals[label] += out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((k, label, c, e, totals[label], digest) for k, label, c, e in out), key=str)


@pytest.fixture(scope="module")
def vectors():
    draw = random.Random(9)
    rows = [(k, draw.choice([1, 2, None]), [round(draw.gauss(0, 0.2), 3) for _ in range(8)]) for k in range(0, 900, 3)]
    rows += [(1, 1, [0.5] * 8), (4, None, None), (7, 2, [0.1, None] * 4), (10, 2, [float("nan")] * 8), (13, 2, [float("inf")] + [0.0] * 7), (16, 3, [-0.0001] * 8), (1, 1, [0.5] * 8), (None, 3, [0.25] * 8), (901, 1, [0.0] * 8), (902, 1, [0.0] * 8)]
    return rows


def test_vector_codes_against_brute_force(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("x") for c in ("code", "error", "v", "n")}).repartition(3)
    got = vector_codes.label_errors(df)
    cols = ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.select(cols).collect()), key=str) == brute_codes(vectors, 256, 4)
    few = df.where("vec_id < 20")
    assert sorted(map(tuple, vector_codes.label_errors(few).select(cols).collect()), key=str) == brute_codes([r for r in vectors if r[0] is not None and r[0] < 20], 256, 4)
    assert vector_codes.label_errors(df.limit(0)).isEmpty()
    odd = df.unionByName(spark.createDataFrame([(5000, 1, [1.0, 2.0]), (5001, 1, [])], "vec_id long, label int, embedding array<double>"), allowMissingColumns=True)
    assert vector_codes.label_errors(odd).count() == got.count()


def test_cells_give_the_nearest_entry_for_any_side_and_cache():
    draw = np.random.default_rng(1)
    for reach in (40, 3000, 1 << 26):
        entries, parts = draw.integers(-reach, reach, (60, 5)), draw.integers(-reach, reach, (700, 5))
        entries[7] = entries[3]  # a tie goes to the lower index
        parts[:5] = entries[:5]
        d = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
        for shift, cached in ((0, 10), (5, 1 << 15), (12, 3)):
            best, distance = vector_codes.Grid(entries, shift, cached).nearest(parts)
            assert (best == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


def test_large_components_are_held(spark):
    df = spark.createDataFrame([(1, 1, [3e38] * 4), (2, 1, [-3e38] * 4), (3, 1, [0.0] * 4)], "vec_id long, label int, embedding array<float>")
    assert [r.error for r in vector_codes.label_errors(df).collect()] == [0, 0, 0]


def brute_spans(rows, window):
    """Removed words and the kept text of each (id, text), by trying every run of words against all texts of smaller ids."""
    runs = defaultdict(set)
    words = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    for (k, _), own in zip(rows, words):
        if k is not None:
            runs[k] |= {tuple(own[j: j + window]) for j in range(len(own) - window + 1)}
    out = []
    for (k, _), own in zip(rows, words):
        gone = set()
        for j in range(len(own) - window + 1):
            if k is not None and any(tuple(own[j: j + window]) in found for o, found in runs.items() if o < k):
                gone |= set(range(j, j + window))
        out.append((k, len(own), len(gone), " ".join(w for j, w in enumerate(own) if j not in gone)))
    return sorted(out, key=str)


def test_spans_of_one_id_with_different_texts_and_of_text_ids(spark):
    p, q = " ".join(f"p{k}" for k in range(30)), " ".join(f"q{k}" for k in range(60))
    rows = [(1, p), (2, p), (2, q), (3, q), (3, p + " " + q), (3, "x " + q), (None, p), (4, None), (4, ""), (-5, "a " + q[:90]), (2, q)]
    for kind, name in (("long", lambda k: k), ("string", lambda k: None if k is None else f"id {k + 10:03d}"), ("int", lambda k: k), ("long", lambda k: None if k is None else k * (1 << 59))):
        named = [(name(k), t) for k, t in rows]
        df = spark.createDataFrame(named, f"doc_id {kind}, text string").withColumn("key", F.lit("clash"))
        got = substring.drop_repeated_spans(df).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == brute_spans(named, 13)
        refs = {(r.doc_id, f.ref_doc) for r in got for f in r.factors}
        assert all(a > b for a, b in refs) and refs
        assert sum(r.n_removed for r in substring.drop_repeated_spans(df, keep_text=False).collect()) == sum(r.n_removed for r in got)


def test_text_is_located_by_the_window():
    body = "Long text stands here. " * 8
    read = html_text.main_text
    assert read('<p>Text <span class="ad">Buy now</span> more</p>') == "Text more"
    assert read("<p>A <button>Buy</button> b</p>") == read("<p>A <span hidden>secret</span> b</p>") == "A b"
    assert read(f'<p>{body}</p><p>Mid <a class="share">Tell all</a><label class="newsletter">Mail</label> end.</p>') == f"{body.strip()}\nMid end."
    assert read('<main><p class="share">Share price rose.</p><p class=menu>Lunch menu text</p><div class="share">Tell all</div></main>') == "Share price rose.\nLunch menu text"
    linked = '<h2><a href="x">Linked heading</a></h2><ul><li><a href="y">Ref one</a></li><li><a href="z">Ref two</a></li></ul>'
    want = f"{body.strip()}\nLinked heading\nRef one\nRef two\n{body.strip()}"
    menu = "".join(f'<li><a href="{k}">Item {k}</a></li>' for k in range(9))
    assert read(f"<ul>{menu}</ul><p>{body}</p>{linked}<p>{body}</p><ul>{menu}</ul>") == want
    # no bounds: the surge decides, and short far text is left out; with bounds, text outside is light
    assert read(f"<p>Far.</p><ul>{menu}</ul><p>{body}</p>") == body.strip()
    assert read(f"<p>Outside text.</p><article><p>Yes.</p><p>{body}</p></article><p>{body}</p>".replace(f"<p>{body}</p>", "<p>After.</p>", 2).replace("<p>After.</p>", f"<p>{body}</p>", 1)) == f"Yes.\n{body.strip()}"
    assert read("<article></article>") == read("<ul><li><a>only a link</a></li></ul>") == ""


def test_pages_without_article_tags_keep_their_text(spark):
    pages = [r.html for r in queries.table(spark, SF, "pages").collect() if r.html]
    bare = [re.sub(r"</?(article|main)\b[^>]*>", "", x) for x in pages]
    assert sum(a != b for a, b in zip(pages, bare)) == len(pages) > 0
    assert [html_text.main_text(x) for x in bare] == [html_text.main_text(x) for x in pages]


def test_repeated_pages_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "<p>One</p>", "x"), (1, "<p>One</p>", "x"), (None, None, None)], "page_id long, html string, text string").withColumn("n_chars", F.lit("c"))
    assert sorted(map(str, (tuple(r) for r in html_text.extract_main_text(df).select("page_id", "text", "n_chars").collect()))) == ["(1, 'One', 'c')", "(1, 'One', 'c')", "(None, '', 'c')"]
