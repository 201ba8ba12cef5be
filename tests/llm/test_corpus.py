"""The corpus operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from contestlab.llm import common, decontaminate, html_text, language_id, line_dedup, mixing, mpeg_audio, queries, simhash, substring, toxicity, url_filter

SF = "/root/testdata/sf0.001"
#: Columns whose names clash with what the operators make.
EXTRA = {"score": "s", "n_words": "w", "verdict": "v", "taken": "t", "media": "m", "component_id": "c", "fp": "f", "key": "k", "part": "p"}
PASSAGE = " ".join(f"w{k}" for k in range(40))


@pytest.fixture(scope="session")
def docs(spark):
    long = " ".join(f"x{k % 997}" for k in range(30_000))
    rows = [(1, PASSAGE + " tail one\n\nsecond line here", "a"), (2, "head " + PASSAGE, "b"), (3, None, None), (4, "", "b"), (5, long, "a"), (6, long, "a"), (6, long, "a"),
            (7, "a b", None), (8, "ÄÖ é 日本語 " * 20, "c"), (9, PASSAGE.upper(), "c"), (None, "no id at all", "c"), (10, "\x00\t \x0b", "c"), (11, "same same same " * 30, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({k: F.lit(v) for k, v in EXTRA.items()}).withColumns({"lang": F.lit("en"), "n_chars": F.length("text")})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_audio_round_trip_and_resync(spark, docs):
    out = mpeg_audio.audio_digests(mpeg_audio.store_texts(docs)).select("text", "media", "digest.*").collect()
    assert len(out) == 13
    for r in out:
        payload = (r.text or "").encode()
        payload += bytes(-len(payload) % 64 if payload else 64)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(r.media))
    media = mpeg_audio.store(bytes(range(256)) * 20)
    plain = mpeg_audio.parse(media)
    dirty = mpeg_audio.parse(b"junk\xff\xfb\x01" + media[plain["data_from"]:] + b"TAG" + b"title".ljust(125, b"\0"))
    assert len(dirty["frames"]) == len(plain["frames"]) == 6 and dirty["skipped"] == 7 and dirty["tags"]["ID3v1"] == "title" and dirty["table"]["frames"] == 6
    bad = bytearray(media)
    bad[plain["frames"][2][0] + 8] ^= 1  # in the side information that the checksum covers
    assert mpeg_audio.parse(bytes(bad))["crc_bad"] == 1
    assert mpeg_audio.parse(b"")["frames"] == []
    index = mpeg_audio.index_audio(spark.createDataFrame([(media,), (None,), (b"xyz",)], "media binary")).collect()
    assert index[0].audio.samples == 6 * 1152 and index[0].audio.hertz == 48000 and len(index[0].audio.seek_offsets) == 6 and index[1].audio is None and index[2].audio.n_frames == 0


def test_audio_keeps_a_payload_that_reads_like_a_tag():
    for size in (64, 128, 192, 640, 937, 1024, 1920):
        for at in range(max(0, size - 960), size - 2):
            payload = (b"x" * at + b"TAG").ljust(size, b"y")
            media = mpeg_audio.store(payload)
            found = mpeg_audio.parse(media)
            assert mpeg_audio.load(media, found) == payload and (found["skipped"], found["crc_bad"]) == (0, 0)


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[k: k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(nodes, near):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if near(a, b) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_simhash_against_all_pairs(spark, docs):
    small = spark.read.parquet(f"{SF}/documents.parquet")
    for table in (docs.where("doc_id is not null"), small):
        data = {r.doc_id: r.text for r in table.collect()}
        prints = {k: slow_fingerprint(t) for k, t in data.items()}
        label = linked(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
        got = simhash.near_duplicates(table).collect()
        assert len(got) == table.count()
        assert all((r.fp & (1 << 64) - 1, r.component_id) == (prints[r.doc_id], label[r.doc_id]) for r in got)
    assert simhash.near_duplicates(docs).count() == 13 and simhash.near_duplicates(docs.limit(0)).isEmpty()


def test_every_close_pair_of_fingerprints_is_found(spark):
    import random
    rnd = random.Random(7)
    values = []
    for _ in range(60):
        x = rnd.getrandbits(64)
        values.append(x)
        for _ in range(3):
            y = x
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                y ^= 1 << b
            values.append(y)
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    with common.scratch(spark) as keep:
        got = {r.node: r.component for r in simhash.fingerprint_groups(spark.createDataFrame([(v,) for v in signed], "fp long"), keep).collect()}
    m = (1 << 64) - 1
    label = linked(signed, lambda a, b: ((a ^ b) & m).bit_count() <= 3)
    alone = {v for v in signed if sum(label[w] == label[v] for w in signed) == 1}
    assert got == {v: label[v] for v in signed if v not in alone} and alone and got


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (103, 101), (7, 7), (None, 5)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100, 103: 100}


def test_language(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    out = queries.op3_language_id(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in table.collect()}
    held = [r for r in out if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in out)
    model = language_id.fit(table)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    assert got[3] == got[4] == got[10] == "und" and language_id.identify(docs.limit(0), model).isEmpty()
    assert language_id.identify(docs, language_id.fit(table.limit(0))).where("lang_pred <> 'und'").isEmpty()


def test_url_rules_against_brute_force(spark):
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    urls = ["http://a.example.com/en/7x?q", "HTTP://EXAMPLE.net/de/8", "https://example.net/de/9#x", "x://notexample.net/de/8", "net/de/8", None, "", "a://com/en/", "b://xcom/en/", "c://org?/es/", "d://w.org/es/", "e://example.com./en/", "f://.com/en/7", "g://com"]
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls * 30)], "page_id long, url string, host string, rule string")
    for size in (50_000, 7):
        for r in url_filter.judge_urls(pages, rules, sweep_rows=size).collect():
            m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", r.url or "")
            host, path = (m[1].lower(), m[2]) if m else ("", "")
            fits = sorted(((len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), reverse=True)
            assert (r.host, r.path, r.rule, r.verdict) == (host, path, *(fits[0][1:] if fits else (None, "allow"))), r
    assert url_filter.judge_urls(pages, rules.limit(0)).where("verdict = 'allow'").count() == pages.count()
    assert url_filter.judge_urls(pages.limit(0), rules).isEmpty()


def slow_spans(data):
    first = {}
    for k in sorted(data):
        w = words(data[k])
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j: j + 13]), k)
    for k, text in data.items():
        w, gone = words(text), set()
        for j in range(len(w) - 12):
            if first[tuple(w[j: j + 13])] < k:
                gone |= set(range(j, j + 13))
        yield k, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)


@pytest.mark.parametrize("settle", [400_000, 50])
def test_spans_against_brute_force(spark, docs, settle, monkeypatch):
    monkeypatch.setattr(substring, "SETTLE_WORDS", settle)
    monkeypatch.setattr(substring, "BLOCK_SEEDS", 500)
    for table in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        data = {r.doc_id: r.text for r in table.collect() if r.doc_id is not None}
        split = {k: words(t) for k, t in data.items()}
        got = {r.doc_id: r for r in substring.drop_repeated_spans(table.repartition(3)).collect()}
        for k, n, gone, kept in slow_spans(data):
            r = got[k]
            assert (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) == (n, gone, hashlib.sha256(kept.encode()).hexdigest(), kept)
            for f in r.factors:
                assert split[k][f.start: f.start + f.n_words] == split[f.ref_doc][f.ref_start: f.ref_start + f.n_words] and f.ref_doc < k
    assert substring.drop_repeated_spans(docs.limit(0)).isEmpty() and substring.drop_repeated_spans(docs).count() == 13


def test_toxicity_holds_out(spark, docs):
    out = queries.op6_toxicity(spark, "/root/testdata/sf0.01").collect()
    labels = dict(duckdb.sql("select doc_id, toxic from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    held = [(r.predicted, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) >= 0.9 * len(held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    empty = toxicity.fit(docs.limit(0).withColumn("toxic", F.lit(0)))
    assert toxicity.score_toxicity(docs, empty).where("predicted = 1").isEmpty()
    data = [(k, ("you idiot here. fine day." if k % 2 else "fine day here. good work."), k % 2) for k in range(60)]
    model = toxicity.fit(spark.createDataFrame(data, "doc_id long, text string, toxic int"))
    r = toxicity.score_toxicity(spark.createDataFrame([(1, "Good day. The IDIOT came. Bye.")], "doc_id long, text string"), model).first()
    assert r.predicted == 1 and [o.sentence for o in r.offending] == ["The IDIOT came"]


@pytest.mark.parametrize("block", [16_000_000, 40])
def test_benchmark_against_brute_force(spark, docs, block):
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(5, 25))), (2, "same same same"), (3, None), (4, ""), (5, "日本語"), (12, "A, b")], "item_id long, text string")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    patterns = defaultdict(set)
    for i, t in bench.collect():
        w = cut(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            patterns[tuple(w[k: k + 13])].add(str(i))
    bench = bench.unionByName(spark.createDataFrame([(None, "x7 x8")], "item_id long, text string"))
    patterns["x7", "x8"].add(None)  # hits words, but is not listed
    got = decontaminate.find_benchmark(docs, bench, block_bytes=block).collect()
    data = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == 13
    for r in got:
        w, hit, items = cut(data[r.doc_id]), set(), set()
        for p, own in patterns.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k: k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    items |= own
        assert (r.n_words, r.n_hit, r.items, r.contaminated) == (len(w), len(hit), sorted(items - {None}), len(hit) > 0 and 20 * len(hit) >= len(w))
        assert sum(s.end - s.start for s in r.spans) == len(hit)
    assert decontaminate.find_benchmark(docs, bench.limit(0)).where("n_hit > 0").isEmpty() and decontaminate.find_benchmark(docs.limit(0), bench).isEmpty()


def test_html(spark):
    body = "word " * 40
    page = (f"<html><head><title>T</title><script>var x='<p>no</p>';</script></head><body><header>Site</header><nav><a>Home</a></nav><div class='cookie-notice'>Cookies!</div>"
            f"<article><h1>Title &amp; more</h1><p>{body}<br>after</p><aside>Side</aside><form>Form</form><p>Short.</p><div class='ad'>Buy</div><ul><li>one<li>two</ul>"
            f"<section id=comments><p>A reader wrote this.</p></section></article><footer>Foot</footer></body>")
    want = f"Title & more\n{body.strip()} after\nShort.\none\ntwo"
    plain = f"<div><a href=x>Home page</a> <a>About</a></div><div><p>{body}</p><p>Also this.</p></div>"
    df = spark.createDataFrame([(1, page, "old"), (2, None, "old"), (3, "", "old"), (4, plain, "old"), (5, "<p>only &lt;one&gt;", "old"), (6, "<nav>open <article><p>kept</p></article>", "old")], "page_id long, html string, text string")
    assert [r.text for r in html_text.extract_main_text(df).orderBy("page_id").collect()] == [want, "", "", f"{body.strip()}\nAlso this.", "only <one>", "kept"]
    assert html_text.extract_main_text(df.limit(0)).isEmpty()


def test_html_attributes_are_read_as_pairs():
    body = "word " * 40
    for kept in ('style="overflow: hidden"', "style='visibility: hidden; color: red'", 'title="the hidden coast"', 'data-x="a class=ad b"', "title='id=\"ad\"'", 'data-hidden=1',
                 'class="search-results"', 'id=notice-period', 'class="social-history-article"', 'class="has-sidebar"', 'class=a role=main id=ad', 'class="comment-free zone"'):
        assert html_text.main_text(f"<div {kept}><p>{body}</p></div>") == body.strip(), kept
    for gone in ("hidden", 'class=x hidden=""', 'aria-hidden="true"', 'style="overflow: hidden" class="x ad"', 'class="cookie-notice"', "id=comment-list", "class='top-nav'", 'class="nav_bar"', "role=navigation",
                 'class="site-footer-wrapper"', "id=comment-12", 'class="ad-728x90"'):
        assert html_text.main_text(f"<div {gone}><p>Buy this.</p></div><p>{body}</p>") == body.strip(), gone


def test_mixing(spark, docs):
    out = mixing.mix_sources(docs).collect()
    assert len(out) == 13 and {r.part for r in out} == {"p"}
    total, by = sum(r.size for r in out), defaultdict(list)
    for r in out:
        assert r.size == len(words(r.text)) and 0 <= r.taken <= 3 * r.size
        by[r.source].append(r)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5 and own[0].source_size == sum(r.size for r in own) and own[0].target <= 3 * own[0].source_size
    assert abs(sum(own[0].target for own in by.values()) - total) < 1e-6 and mixing.mix_sources(docs.limit(0)).isEmpty()


def test_lines(spark):
    base = "the quick brown fox jumps over the lazy dog while seven wizards brew strange potions under a pale winter moon tonight"
    near = base + " " + base.replace("seven", "eight")
    rows = [(1, f"{base} {base}\n\n- -\nunique line of document one"), (2, f"own line two\n{base} {base}"), (3, f"{near}\nanother line three"), (4, None), (5, ""), (6, f"{base.upper()}  {base}."), (6, f"{base.upper()}  {base}."), (None, "own line two\nx")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in EXTRA.items()})
    got = {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.drop_repeated_lines(df).collect()}
    assert {(1, rows[0][1], 4, 0), (2, "", 2, 2), (4, None, 0, 0), (5, "", 1, 0), (6, "", 1, 1), (None, "own line two\nx", 2, 0)} <= got
    assert line_dedup.drop_repeated_lines(df).count() == 8 and line_dedup.drop_repeated_lines(df.limit(0)).isEmpty()


def slow_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_lines_against_brute_force_edit_similarity(spark):
    import random
    rnd = random.Random(3)
    pick = lambda: rnd.choice([f"c{k}" for k in range(12)]) if rnd.random() < 0.5 else f"r{rnd.randrange(3000)}"
    texts = [["the"] * k for k in (4, 5, 6, 7, 12)]
    for n in (3, 4, 5, 6, 9, 10, 14, 15, 27, 40, 150) * 3:
        base = [pick() for _ in range(n)]
        texts.append(base)
        for e in {1, n // 5, n // 5 + 1}:
            w = list(base)
            for _ in range(e):
                at, how = rnd.randrange(len(w)), rnd.choice("sid")
                w[at: at + (how != "i")] = [] if how == "d" and len(w) > 1 else [pick()]
            texts.append(w)
    near = lambda a, b: 5 * slow_edits(texts[a], texts[b]) <= max(len(texts[a]), len(texts[b]))
    label = linked(range(len(texts)), near)
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in line_dedup.drop_repeated_lines(df).collect()}
    assert got == {k: int(label[k] < k) for k in range(len(texts))} and sum(got.values()) > 40
    # one typo in a line of ten words
    ten = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, ten), (2, ten.replace("four", "fuor"))], "doc_id long, text string")
    assert [r.text for r in line_dedup.drop_repeated_lines(df).orderBy("doc_id").collect()] == [ten, ""]


def test_lines_that_share_a_crowded_passage_against_brute_force(spark, monkeypatch):
    import random
    from contestlab.llm import common
    rnd, seen = random.Random(5), {}
    passage = [f"p{k}" for k in range(30)]
    texts = [[f"o{rnd.randrange(4000)}" for _ in range(n)] + passage for n in (0, 1, 5, 6, 7, 8, 9, 12, 14, 20, 26) * 4]
    for base in texts[:30]:
        w = list(base)
        for at in rnd.sample(range(len(w)), len(w) // 5 + rnd.choice((0, 1))):
            w[at] = f"e{rnd.randrange(4000)}"
        texts.append(w)
    label = linked(range(len(texts)), lambda a, b: 5 * slow_edits(texts[a], texts[b]) <= max(len(texts[a]), len(texts[b])))
    for name in ("_pairs_prefixed", "_words_prefixed"):
        def counted(lines, split=getattr(line_dedup, name), name=name):
            seen[name] = split(lines).count()
            return split(lines)
        monkeypatch.setattr(line_dedup, name, counted)
    monkeypatch.setattr(common, "CROWD", 3)
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in line_dedup.drop_repeated_lines(df).collect()}
    assert got == {k: int(label[k] < k) for k in range(len(texts))} and 20 < sum(got.values()) < len(texts) - 8
    assert seen["_pairs_prefixed"] > 0 and seen["_words_prefixed"] > 0


def test_marks_of_common_runs_keep_up_with_the_input(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "COUNTED", 100)
    rows = [(k, ([1, 2, 3] if k % 3 == 0 else []) + [1000 + 40 * k + j for j in range(20)]) for k in range(600)]
    lines = spark.createDataFrame(rows, "key long, words array<int>")
    marks = spark.range(1).select(line_dedup.often_repeated(lines).alias("marks")).first().marks
    # the run that 200 of 600 lines have, however small a part of the input COUNTED is
    assert sum((m & ((1 << 64) - 1)).bit_count() for m in marks) == 1


def test_queries_with_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE.items():
        cur = con.execute(sql)
        cols = sorted(c[0] for c in cur.description)
        want = sorted(str(tuple(dict(zip([c[0] for c in cur.description], r))[c] for c in cols)) for r in cur.fetchall())
        assert sorted(str(tuple(r[c] for c in cols)) for r in queries.QUERIES[name](spark, SF).collect()) == want


def test_pipeline_keeps_columns_and_drops_copies(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stage(spark, docs, SF)
        if k < 4:
            assert kept.columns == docs.columns
        assert kept.count() <= docs.count()
        docs = common.written(kept)
    assert {"size", "target", "taken"} <= set(docs.columns) and docs.count() > 100


def test_pipeline_rows_without_or_with_repeated_ids_and_clashing_columns(spark):
    import corpus_pipeline

    long = " ".join(f"word{k}" for k in range(60))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").orderBy("item_id").first().text
    rows = [(1, "one text of its own, told once", "en", "a", 5), (1, "another text under the same id", "en", "a", 5), (2, long, None, None, 0), (2, long, None, None, 0), (3, long + " more", "en", "b", 0),
            (None, long + " less", "en", "b", 0), (None, item, "en", "c", 0), (1, item, "en", "c", 0), (4, None, None, None, 0), (5, "", "en", "a", 0), (None, "no id here at all", None, "c", 0)]
    names = {"score": "s", "predicted": "p", "offending": "o", "n_lines": "l", "n_removed": "r", "row": "x", "mark": "m", "key": "k", "version": "v"}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({k: F.lit(v) for k, v in names.items()})
    steps = dict(corpus_pipeline.STAGES)
    clashing = {tuple(names.values())}
    for name, n in (("toxicity", 11), ("line_dedup", 11), ("simhash_near_dedup", 6), ("decontamination", 9)):
        kept = steps[name](spark, df, SF)
        found = kept.collect()
        assert kept.columns == df.columns and len(found) == n and {tuple(r[k] for k in names) for r in found} == clashing, name
        assert steps[name](spark, df.limit(0), SF).isEmpty()
        if name == "simhash_near_dedup":
            # one of the copies, both texts of id 1, one text without words; the benchmark text once, under its id
            assert sorted((r.doc_id or 0, (r.text or "")[:9]) for r in found) == sorted([(1, rows[0][1][:9]), (1, "another t"), (2, long[:9]), (1, item[:9]), (4, ""), (0, "no id her")])
        if name == "decontamination":
            assert item not in {r.text for r in found} and sum(r.doc_id == 1 for r in found) == 2
    # n_chars is no part of what a stage needs
    assert steps["line_dedup"](spark, df.drop("n_chars"), SF).columns == df.drop("n_chars").columns
    mixed = steps["mixing"](spark, df, SF)
    assert mixed.count() == 11 and mixed.where("taken > 3 * size").isEmpty()


def test_pipeline_near_copies_against_brute_force(spark):
    import random

    import corpus_pipeline
    rnd = random.Random(5)
    texts = [None, "", "a b", "A  b", "a b c"]
    for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 200").orderBy("doc_id").limit(60).collect():
        w = r.text.split()
        texts.append(r.text)
        for edits in (1, len(w) // 60, len(w) // 40):
            v = list(w)
            for k in rnd.sample(range(len(v)), edits):
                v[k] = f"new{rnd.randrange(9)}"
            texts.append(" ".join(v))
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))})
    label = linked(range(len(sets)), lambda a, b: 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]))
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, extra string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, SF).collect()}
    assert kept == {k for k in label if label[k] == k} and len(kept) < len(texts) / 2
    assert corpus_pipeline.drop_near_duplicates(spark, df.limit(0), SF).isEmpty()


def test_pipeline_takes_its_pairs_from_simhash(spark):
    """Documents whose fingerprints are within 3 bits meet under a key of SimHash, also if their sets share no first shingle."""
    from contestlab.llm import shingles
    base = 0x0123456789ABCDEF
    prints = [base, base ^ 0b1, base ^ (1 << 63 | 1 << 40 | 1 << 20), base ^ (7 << 30), base ^ (0xF << 8), base ^ (1 << 64) - 1]
    once = spark.createDataFrame([(k, (p + (1 << 63)) % (1 << 64) - (1 << 63), [k]) for k, p in enumerate(prints)], "key long, fp long, first array<long>")
    met = defaultdict(set)
    for r in shingles.grams(once).collect():
        met[r.key].add(r.gram)
    for a in range(len(prints)):
        assert a in met[a]
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                assert met[a] & met[b]
    assert not met[0] & met[5]


def test_pipeline_documents_do_not_meet_under_a_passage_that_many_share(spark, monkeypatch):
    """The share of documents in which shingles are counted does not shrink as the input grows, so few meet under a shared passage."""
    import random

    from contestlab.llm import shingles
    rnd, crowds = random.Random(3), []
    passage = " ".join(f"common{k}" for k in range(12))

    def watched(prefixed, *rest):
        crowds.append(prefixed.groupBy("gram").count().agg(F.max("count").alias("n")).first().n)
        return common.linked_groups(prefixed, *rest)

    monkeypatch.setattr(shingles, "linked_groups", watched)
    monkeypatch.setattr(shingles, "COUNTED", 50)
    texts = []
    for k in range(240):
        own = [f"w{rnd.randrange(10**9)}" for _ in range(40)]
        texts.append(" ".join([*own[:20], passage, *own[20:]]))
    # near copies of three documents are found all the same
    texts += [t.replace("common0", "other", 1) for t in texts[:3]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = {r.doc_id: r.component_id for r in shingles.similar_documents(df).collect()}
    assert groups == {k: k - 240 if k >= 240 else k for k in range(243)}
    assert max(crowds) <= 12


def test_queries_without_the_package_on_the_workers(tmp_path):
    """Workers that can't import the package get all they need with the tasks."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from contestlab.llm import queries
for name in ("op1_mpeg_audio", "op3_language_id", "op6_toxicity", "op7_decontaminate", "op8_html_text"):
    assert queries.QUERIES[name](spark, {SF!r}).count()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=300, capture_output=True)


def test_audio_survives_any_cut_and_reads_tags():
    media = mpeg_audio.store(b"payload " * 200)
    for k in range(len(media)):
        mpeg_audio.load(media[:k], mpeg_audio.parse(media[:k]))
    frame = b"\xff\xf2\x14\xc0" + b"\0\0" + bytes(9) + b"Xing\0\0\0\xff"
    assert mpeg_audio.parse(frame)["crc_bad"] + mpeg_audio.parse(frame)["crc_good"] <= 1
    text = b"\1" + "Grüße".encode("utf-16")
    tag = b"TIT2" + len(text).to_bytes(4) + b"\0\0" + text
    assert mpeg_audio.parse(b"ID3\3\0\0" + bytes([0, 0, 0, len(tag)]) + tag)["tags"] == {"TIT2": "Grüße"}
    assert mpeg_audio.load(b"", {"frames": [], "tags": {"TXXX": "not ours"}}) == b""


def test_audio_checksums_of_layers_one_and_two():
    # Layer II, 44.1 kHz, 64 kbit/s mono: table B.2a; subband 0 has an allocation, and so two bits of scale factor selection
    four = b"\xff\xfc\x40\xc0"
    body = bytes([0x10]) + bytes(300)
    covered = 4 * 11 + 3 * 12 + 2 * 4 + 2
    bits = int.from_bytes(four[2:] + body[:12])
    crc = 0xFFFF
    for k in range(16 + covered):
        crc ^= (bits >> (8 * 14 - 1 - k) & 1) << 15
        crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    length = mpeg_audio.header(four)["length"]
    frame = (four + crc.to_bytes(2) + body)[:length]
    assert len(frame) == length == 208
    found = mpeg_audio.parse(frame * 3)
    assert (len(found["frames"]), found["crc_good"], found["crc_bad"]) == (3, 3, 0)
    assert mpeg_audio.parse((frame[:7] + b"\x01" + frame[8:]) * 2)["crc_bad"] == 2
    one = b"\xff\xfe\x90\xc0"  # Layer I, mono: 32 allocations of four bits
    size = mpeg_audio.header(one)["length"]
    crc = mpeg_audio.crc16(one[2:] + bytes(16))
    assert mpeg_audio.parse(((one + crc.to_bytes(2)).ljust(size, b"\0")) * 2)["crc_good"] == 2


def test_html_is_read_in_linear_time_and_keeps_what_is_text():
    import time
    for page in ("<a " * 350_000, '<a "x ' * 200_000, '<a x="' * 200_000, "<title>" * 150_000, "<!--" * 200_000, '<b x=\'"' * 150_000):
        began = time.time()
        html_text.main_text(page)
        assert time.time() - began < 5
    body = "word " * 40
    assert html_text.main_text("<p title=it's>Hello world") == "Hello world"
    assert html_text.main_text('<p title="a > b">x &lt; y') == "x < y"
    menu = "<nav><ul><li>a<li>b<li>c<li>d</ul></nav>"
    assert html_text.main_text(f"<p>{body}</p>{menu}<p>Closing.</p>") == f"{body.strip()}\nClosing."


def test_grams_of_lines_stand_beside_the_keys_changing_bytes(spark):
    lines = spark.createDataFrame([(k, [(k * 31 + i * i) % 9973 for i in range(4 + k % 40)]) for k in range(400)], "key long, words array<int>")
    grams = [r.gram for r in line_dedup._prefixed(lines, line_dedup.often_repeated(lines)).collect()]
    # the 40 bits that lines meet by are the upper ones, so that a shuffled row has one run of bytes that don't repeat
    assert all(g % (1 << 24) == 0 for g in grams) and len({g >> 24 for g in grams}) > len(grams) // 2
