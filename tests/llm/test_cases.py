"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, operator by operator."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tactus.llm import bpe_count, chat, html_extract, langid, line_dedup, media, mixing, packing, simhash, topk
from tactus.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (None, None, None, None, None),
    (1, "", "en", "a", 0),
    (2, " \t\n", "en", "a", 3),
    (3, "The cat\nsat on the mat\n", "en", None, 23),
    (3, "The cat\nsat on the mat\n", "en", None, 23),
    (4, "été à la plage " * 3000, "fr", "b", 45000),
    (5, "a" * 20000, None, "b", 20000),
    (6, "12 34 !!", "en", "c", 8),
    (7, "<|endoftext|> x<|startoftext|>", "en", "c", 30),
    (2**60 + 1, "\U0001f600 \0 ퟿", "en", "", 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def clashing(odd):
    return odd.withColumns({c: F.lit("x") for c in ("fp", "component_id", "score", "lang_pred", "size", "taken", "target", "n_lines", "n_dropped", "row", "key", "h1", "pos", "epochs")})


OPS = {1: langid.op1, 2: simhash.op2, 5: line_dedup.op5, 6: media.op6, 8: bpe_count.op8, 9: mixing.op9, 10: packing.op10}


@pytest.mark.parametrize("n", OPS)
def test_odd_rows(odd, clashing, n):
    found = OPS[n](odd).collect()
    ids = [r["doc_id"] for r in found]
    assert set(ids) == {r[0] for r in ODD}
    if n != 10:
        assert len(found) == len(ODD)
    assert len(OPS[n](clashing).collect()) == len(found)


@pytest.mark.parametrize("n", OPS)
def test_empty_table(odd, n):
    assert OPS[n](odd.where("false")).count() == 0


def test_pipeline_on_odd_rows(spark, clashing, tmp_path):
    import corpus_pipeline as c
    from tactus.llm.common import written

    for docs in (clashing, clashing.where("false")):
        kept = docs
        for name, stage in c.STAGES:
            kept = written(stage(spark, kept, str(tmp_path)), name)
            if name != "pack":
                assert kept.columns == docs.columns


def test_language_cases(odd):
    found = {r["doc_id"]: r for r in langid.op1(odd).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (None, 1, 2, 6))
    assert langid.op1(odd.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred != 'und'").count() == 0


def test_suffix_automaton_accepts_all_and_only_substrings():
    rnd = random.Random(2)
    codes = [rnd.randint(0, 2) for _ in range(60)]
    a = langid.suffix_automaton(codes)
    inside = {tuple(codes[i:j]) for i in range(60) for j in range(i + 1, min(60, i + 6) + 1)}
    for _ in range(500):
        word = tuple(rnd.randint(0, 2) for _ in range(rnd.randint(1, 6)))
        s = 0
        for c in word:
            s = a[s].get(c, -1) if s >= 0 else -1
        assert (s >= 0) == (word in inside)


def test_edges_find_all_and_only_their_keys():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 5_000, 3_000))
    e = langid.Edges(keys, np.arange(len(keys)))
    every = np.arange(6_000)
    want = np.full(6_000, -1)
    want[keys] = np.arange(len(keys))
    assert (e(every) == want).all()


def longest_match_phrases(text, known):
    i = phrases = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in known:
            k += 1
        i += k if text[i] in known else 1
        phrases += 1
    return phrases


@pytest.mark.parametrize("letters", ["abcdxyz ", "".join(map(chr, range(0x4E00, 0x5200))) + " "])
def test_phrases_by_brute_force(letters):
    rnd = random.Random(4)
    make = lambda n: "".join(rnd.choices(letters, k=n))
    sample = {"x": ["abcab dab", make(400)], "y": ["zzz yxz", make(300)]}
    p = langid.Parser(sample)
    # texts of pieces of the samples, so that phrases are long, and cross the ends of lanes
    pool = sample["x"][1] + sample["y"][1]
    texts = ["".join(pool[(at := rnd.randrange(600)) : at + rnd.randint(1, 40)] + make(1) for _ in range(rnd.randint(1, 12))) for _ in range(40)]
    texts = [langid.normalise(t).strip() or "a" for t in texts]
    for lane, sync in ((langid.LANE, langid.SYNC), (7, 3), (1, 1), (50, 10), (20, 1)):
        counts, size = p.phrases(texts, lane, sync)
        for t, row, n in zip(texts, counts, size, strict=True):
            assert n == len(t)
            assert row.tolist() == [longest_match_phrases(t, " " + " ".join(langid.normalise(x).strip() for x in sample[lang]) + " ") for lang in p.langs]


def test_training_sample_takes_whole_rows(spark):
    long = "x" * (langid.SAMPLE_LONGEST + 1)
    rows = [(i, f"word {i}", "en", "s", 1) for i in range(400)] + [(1000, long, "en", "s", 1), (1001, long + " de", "de", "s", 1), (1002, long, "de", "s", 1), (1003, "12", "fr", "s", 1), (None, "mot", "fr", None, 1), (None, "mot", "fr", None, 1)]
    found = langid.training_sample(spark.createDataFrame(rows, DOCS), F.lit(True))
    assert 20 < len(found["en"]) <= langid.SAMPLE_ROWS and set(found["en"]) <= {f"word {i}" for i in range(400)}
    assert found["de"] == [long] and found["fr"] == ["mot"]


def test_every_pair_within_two_bits_meets():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**63, 300, dtype=np.uint64)
    row, anchor, home = simhash.anchors(fps)
    assert home.sum() == len(fps)
    for x in fps:
        y = int(x)
        for b in rng.choice(64, rng.integers(0, 3), replace=False):
            y ^= 1 << int(b)
        mine = simhash.anchors(np.array([x], dtype=np.uint64), 0)[1]
        theirs = simhash.anchors(np.array([y], dtype=np.uint64))[1]
        assert mine[0] in theirs and len(set(theirs)) == len(theirs)


def test_chains_become_one_component(spark):
    chain = [(1 << i) - 1 for i in range(40)]  # each one bit from the next
    other = [0b1010101 << 50, 0b1010101 << 50 | 1]
    ids = spark.createDataFrame([(x,) for x in chain + other], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(ids)).collect()}
    assert {found[x] for x in chain} == {0} and {found[x] for x in other} == {other[0]}


def test_a_large_group_of_copies(spark):
    rows = [(i, "same words in every copy of it", "en", "s", 30) for i in range(3000)] + [(9000, "quite other words stand in here", "en", "s", 31)]
    docs = spark.createDataFrame(rows, DOCS)
    assert {(r["doc_id"] == 9000, r["component_id"]) for r in simhash.op2(docs).collect()} == {(False, 0), (True, 9000)}
    assert sorted(r["doc_id"] for r in simhash.keep_one_per_group(docs).collect()) == [0, 9000]


def test_unlike_documents_of_one_id_or_none_all_stay(spark):
    texts = ["first words that stand alone here", "second text of quite other words now", "third and last of the unlike ones"]
    rows = [(None, t, "en", "s", 30) for t in texts[:2] * 3] + [(7, texts[2], "en", "s", 30)] * 2 + [(7, "fourth piece, the same id again", "en", "s", 31)]
    found = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_one_per_group(spark.createDataFrame(rows, DOCS)).collect())
    assert found == sorted([(0, texts[0]), (0, texts[1]), (7, texts[2]), (7, "fourth piece, the same id again")])


def test_top_k_with_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(60)] + [(20, [1.0, 2.0]), (61, None), (62, [1.0, None]), (63, [float("nan"), 1.0]), (64, [float("inf"), 1.0]), (None, [1.0, 1.0]), (65, []), (66, [1e307, 1.0]), (80, [1.0, 2.0, 3.0])]
    found = topk.op3(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    for q in (0, 20, 40):
        mine = [(r["rank"], r["vec_id"], r["score"]) for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])]
        want = sorted(((-(64 * 64 + 64 * (q % 3) * 64 * (i % 3)), i) for i in range(60) if i != q))[:20]
        assert mine == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
    assert not [r for r in found if r["query_id"] == 80]
    assert topk.op3(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_of_random_clusters(spark):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(400, 8)) + 4 * rng.integers(-1, 2, size=(400, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.op3(df).collect()}
    whole = np.floor(64 * m).astype(np.int64)
    for q in range(0, 400, 20):
        s = whole @ whole[q]
        want = sorted((-s[i], i) for i in range(400) if i != q)[:20]
        assert [found[q, k + 1] for k in range(20)] == [(i, -x) for x, i in want]


def brute_top_k(m, every, k=20):
    whole = [[int(x) for x in np.floor(64 * v)] for v in m]
    out = {}
    for q in range(0, len(m), every):
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], v, strict=True)))), i) for i, v in enumerate(whole) if i != q)[:k]
        out |= {(q, n + 1): (i, -x) for n, (x, i) in enumerate(scores)}
    return out


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e9, 1e200])
def test_top_k_of_many_groups_and_chunks(spark, scale):
    rng = np.random.default_rng(3)
    m = scale * (0.02 * rng.normal(size=(600, 4)) + rng.integers(-1, 2, size=(600, 4)))
    m[100:300] = m[100]  # one very common vector
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    join = topk.Join(df, F.col("vec_id") % 10 == 0, block=40, chunk=400, least=1)
    assert join.groups[4].count > 5 and join.groups[4].chunks > 5
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in join.solved().collect()} == brute_top_k(m, 10)


def test_top_k_with_several_rows_of_one_id(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(200, 3))
    ids = [i // 4 for i in range(200)]  # four different vectors an id
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, m, strict=True)], "vec_id long, embedding array<double>")
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.op3(df).collect())
    whole = np.floor(64 * m).astype(int)
    want = []
    for q in range(0, 50, 20):
        scores = sorted((-int(whole[a] @ whole[b]), ids[b]) for a in range(200) if ids[a] == q for b in range(200) if ids[b] != q)[:20]
        want += [(q, n + 1, i, -x) for n, (x, i) in enumerate(scores)]
    assert found == want


def test_clusters_save_replicas(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    m = np.repeat(centres, 100, axis=0) + 0.005 * rng.normal(size=(1200, 16))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    join = topk.Join(df, F.col("vec_id") % 20 == 0, block=16 * 10, least=1)
    groups, replicas = join.groups[16].count, join.replicated().count()
    assert groups >= 5 and replicas < 0.5 * groups * 1200
    # where nothing can be pruned, a vector is stored once a block of queries, and one block is all that few queries need
    even = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(1200, 16)))], "vec_id long, embedding array<double>")
    assert topk.Join(even, F.col("vec_id") % 20 == 0).replicated().count() == 1200


PAGES = "page_id long, url string, html string"


def texts(spark, rows, **lists):
    return {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, PAGES), **lists).collect()}


def test_shared_lines_go_and_articles_stay(spark):
    page = lambda x: f"<div>Top menu</div><p>{x} &amp; more</p><div>Bottom</div>"
    rows = [(i, f"http://h.org/a/{i}", page(i)) for i in range(9)] + [(10, "http://alone.org/", page(0)), (11, None, None), (12, "http://h.org/b", "<nav>x</nav><article><h1>T</h1><p>a <b>b</b><p>c<div class='comments'>no</div></article><footer>f</footer>"), (None, "http://h.org/c", "")]
    found = texts(spark, rows)
    assert [found[i] for i in range(9)] == [f"{i} & more" for i in range(9)]
    assert found[10] == "Top menu 0 & more Bottom" and found[11] == "" and found[None] == "" and found[12] == "T a b c"


def test_outside_lines_of_pages_with_an_article_are_differenced(spark):
    page = lambda x: f"<div>Top</div><h1>Head {x}</h1><main><p>Teaser {x}</p></main><div>Middle</div><div>Body {x}</div><article><p>Second</p></article><p>Lead {x}</p><div>Bottom</div>"
    rows = [(i, f"http://h.org/a/{i}", page(i)) for i in range(6)]
    assert texts(spark, rows) == {i: f"Head {i} Teaser {i} Body {i} Second Lead {i}" for i in range(6)}


def test_differencing_alone_gives_the_text(spark):
    # pages that differ from their neighbours in text only, with all word and element lists empty
    page = lambda x: f"<nav><a>Home</a></nav><aside>About us</aside><div class=ad>Buy</div><h1>Head {x}</h1><p class=notice>First {x}<p>Second {x}</p><form>Search</form><footer>End</footer>"
    rows = [(i, f"http://h.org/{i // 4}/{i}", page(i)) for i in range(8)]
    none = frozenset()
    assert texts(spark, rows, dropped=none, names=none, maybe=none) == {i: f"Head {i} First {i} Second {i}" for i in range(8)}


def test_class_words_that_may_name_text(spark):
    # no <article>; real text in notice, share and search, comments in <main>, a share bar that repeats
    page = lambda x: (
        f"<header>Site</header><main><h1>Head {x}</h1><p class='notice'>Notice {x}<div class='share'>Shared by {x}</div><div class=search>Found {x}</div><div class=share>Share this</div>"
        f"<section class='comments'><p>Comment {x}</section><section><h2>Comments</h2><p>More {x}</section><section><h3>{x} comments</h3><p>Third {x}</section></main><p>After {x}</p>"
    )
    rows = [(i, f"http://h.org/{i}", page(i)) for i in range(5)]
    assert texts(spark, rows) == {i: f"Head {i} Notice {i} Shared by {i} Found {i} After {i}" for i in range(5)}
    article = lambda x: f"<article><h1>T {x}</h1><p class=notice>Own {x}<p class=notice>Same<p>Quoted<h2>Comments</h2><p>Of the law {x}</article>" + ("<h2>Comments</h2>" if x else "")
    found = texts(spark, [(0, "http://x.org/0", article(0)), (1, "http://x.org/1", "<article><p class=notice>Same<p>Quoted</article>")])
    assert found == {0: "T 0 Own 0 Quoted Comments Of the law 0", 1: "Quoted"}


def test_runs_of_copies_look_past_themselves(spark):
    page = lambda x: f"<div>Menu</div><p>{x}</p>"
    rows = [(i, f"http://h.org/{i}", page("copy" if 2 <= i < 7 else i)) for i in range(9)]
    assert texts(spark, rows) == {i: "copy" if 2 <= i < 7 else str(i) for i in range(9)}
    hot = [(i, f"http://hot.org/{i}", page("copy" if i % 3 else i)) for i in range(600)]
    assert texts(spark, hot) == {i: "copy" if i % 3 else str(i) for i in range(600)}


def test_forms_inline_names_and_broken_markup():
    own = lambda page: [x for x, k in html_extract.lines(page) if k != html_extract.GONE]
    assert own("<form><article><h1>T</h1><p>a</article><input><label>x</label></form>") == ["T", "a", "x"]
    assert own("<p>a<form><p>Subscribe</p></form><p>b") == ["a", "b"]
    assert own("<p>one <span class='ad'>buy</span> two") == ["one", "two"]
    assert own("<p>a<p>b</i></div>c<a href='x>y") == ["a", "b", "c"]
    for page in ("<div>" * 50_000 + "</span>" * 50_000, "<a '\"" * 200_000, "<p>a" * 50_000, "<span class=ad><div>" * 30_000 + "</span>" * 30_000):
        html_extract.lines(page)


def test_alignment_is_the_longest_common_subsequence(monkeypatch):
    rnd = random.Random(9)
    for table in (1 << 28, 1, 40):
        monkeypatch.setattr(html_extract, "TABLE", table)
        for _ in range(200):
            a, b = ([rnd.choice("abcdef") for _ in range(rnd.randint(0, 20))] for _ in range(2))
            kept = [a[i] for i in sorted(html_extract.shared(a, b))]
            it = iter(b)
            assert all(x in it for x in kept)
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
            assert len(kept) == best[-1][-1]
    # no line is unique: the alignment is exact at any size
    a, b = ([rnd.randrange(300) for _ in range(4000)] for _ in range(2))
    monkeypatch.setattr(html_extract, "TABLE", 1 << 28)
    whole = len(html_extract.shared(a, b))
    monkeypatch.setattr(html_extract, "TABLE", 1 << 16)
    assert whole == len(html_extract.shared(a, b)) > 300


def test_odd_pages(spark):
    pages = spark.createDataFrame([(None, None, None), (1, "", ""), (1, "", ""), (2, "h.org", "<p>" + "long " * 200_000), (3, "http://h.org/x", "plain"), (3, "http://h.org/x", "plain")], PAGES)
    clash = pages.withColumns({c: F.lit("x") for c in ("lines", "kinds", "row", "host", "path", "open", "shared", "whole")})
    for df in (pages, clash):
        found = sorted((r["page_id"] or 0, r["n_chars"]) for r in html_extract.op4(df).collect())
        assert found == [(0, 0), (1, 0), (1, 0), (2, 999_999), (3, 5), (3, 5)]
    assert html_extract.op4(pages.where("false")).count() == 0


def test_line_dedup_modes(spark):
    rows = [(i, f"own {i}\n Shared LINE \n\nshared line", "en", "s", 1) for i in range(10)] + [(50, "ten\n" * 12, "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    gone = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert all(gone[i] == f"own {i}\n" for i in range(10)) and gone[50] == "ten\n" * 12
    first = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, keep_first=True).collect()}
    assert first[0] == "own 0\n Shared LINE \n" and first[9] == "own 9\n"


def test_media_retries_and_errors(spark, odd, tmp_path):
    manifest = media.write_archives(odd.coalesce(1))
    path, size = manifest.first()
    local = path.removeprefix("file://")
    assert os.path.getsize(local) == size
    rows = media.read_archives(manifest, split="500").orderBy("offset").collect()
    folder = spark.read.format("archive_media").load(os.path.dirname(path)).orderBy("offset").collect()
    assert [r["media"] for r in rows] == [r["media"] for r in folder]
    assert len(rows) == len(ODD) and len({r["offset"] for r in rows}) == len(ODD)
    data = bytearray(open(local, "rb").read())
    data[rows[3]["offset"] + 60] ^= 255
    open(local, "wb").write(data)
    found = media.read_archives(manifest, onerror="null").orderBy("offset").collect()
    assert [r["media"] is None for r in found].count(True) == 1 and found[3]["error"]
    with pytest.raises(Exception, match="damaged"):
        media.read_archives(manifest).count()
    for n in (1, 192, 193, 5000):
        raw = bytes(range(256)) * (n // 256 + 1)
        assert media.from_png(media.to_png(media.payload(raw[:n]))) == media.payload(raw[:n])


def test_chat_round_trip(spark):
    rnd = random.Random(11)
    bits = ["<|im_start|>", "<|im_end|>", "\n", "\\", "<", "|", "\\n", "x", "assistant", "<\\|"]
    make = lambda: "".join(rnd.choices(bits, k=rnd.randint(0, 8)))
    rows = [(c, t, rnd.choice(["user", "assistant", make()]), make()) for c in range(60) for t in range(rnd.randint(1, 5))] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.read_conversations(chat.format_conversations(df)).collect():
        want = [(a or "", b or "") for c, t, a, b in sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: x[1] or 0)]
        assert [(t["role"], t["text"]) for t in r["turns"]] == want
    flow = [(1, 0, "system", ""), (1, 1, "user", ""), (1, 2, "assistant", ""), (2, 0, "assistant", ""), (3, 0, "user", ""), (4, 0, "user", ""), (4, 1, "user", "")]
    got = {r["conv_id"]: (r["valid"], r["bad_turn"]) for r in chat.format_conversations(spark.createDataFrame(flow, df.schema)).collect()}
    assert got == {1: (True, None), 2: (False, 0), 3: (False, None), 4: (False, 1)}


def test_packing_cuts_and_fills():
    rnd = random.Random(6)
    for lengths in ([1500] * 40, [rnd.randint(1, 6000) for _ in range(300)], [2048, 4096, 1], [3]):
        p = packing.Packer(7, pool=50)
        for i, n in enumerate(lengths):
            p.add(i, bytes(4 * n))
        p.end()
        per_seq, per_doc = {}, {}
        for doc, _, n, _, whole, seq, offset in p.rows:
            assert offset == per_seq.get(seq, 0) and whole == lengths[doc]
            per_seq[seq] = offset + n
            per_doc[doc] = per_doc.get(doc, 0) + n
        assert [per_doc[i] for i in range(len(lengths))] == lengths
        assert all(n <= 2048 and n & (n - 1) == 0 for n in per_seq.values())


def test_closest_sum_by_brute_force():
    rnd = random.Random(8)
    for _ in range(200):
        counts = {rnd.randint(1, 20): rnd.randint(1, 3) for _ in range(rnd.randint(0, 5))}
        room = rnd.randint(0, 60)
        taken = packing.closest_sum(sorted(counts), counts.__getitem__, room)
        assert all(0 < n <= counts[k] for k, n in taken.items())
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= room)


def test_counts_of_random_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rnd = random.Random(3)
    pool = [chr(i) for i in [*range(0x250), 0x3A3, 0x130, 0x2028, 0x3000, 0x4E00, 0x1F600, 0x301, 0x660]] + ["'s", " the", "<|endoftext|>", "\n\n", "  "]
    texts = ["".join(rnd.choices(pool, k=rnd.randint(0, 60))) for _ in range(400)] + ["", "ab" * 2000, " " * 300]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    c = bpe_count.Counter(path)
    assert [c.count(t) for t in texts] == want
    words = packing.Ids(public_tokenizers.path("word_bpe_49k.json"))
    want = [e.ids for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(words.ids(t), dtype="<u4").tolist() for t in texts] == want


def test_mixing_prefers_quality_and_takes_the_target(spark):
    rows = [(i, " ".join(["word"] * 50), "en", "a" if i % 2 else "b", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    w = F.when(F.col("doc_id") % 4 < 2, 9.0).otherwise(1.0)
    found = mixing.mix(mixing.sized(docs, w)).where("source = 'a'").select("doc_id", "taken", "target").collect()
    assert abs(sum(r["taken"] for r in found) - found[0]["target"]) <= 0.5
    good = sum(r["taken"] for r in found if r["doc_id"] % 4 < 2)
    assert good > 1.4 * sum(r["taken"] for r in found if r["doc_id"] % 4 >= 2)
    again = mixing.mix(mixing.sized(docs.repartition(7), w)).where("source = 'a'").select("doc_id", "taken", "target").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))


def test_table_reads(spark, sf):
    assert table(spark, sf, "documents").count() > 0


def test_caches_are_bounded(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(bpe_count, "KEPT", 10)
    monkeypatch.setattr(packing, "KEPT", 10)
    text = " ".join(f"w{i}x" for i in range(200)) + " " + "z" * 5_000
    c, w = bpe_count.Counter(public_tokenizers.path("byte_bpe_50k.json")), packing.Ids(public_tokenizers.path("word_bpe_49k.json"))
    n, ids = c.count(text), w.ids(text)
    assert max(len(c), len(c.old), len(w), len(w.old)) <= 10 and max(map(len, [*c, *w, *c.old, *w.old])) <= 48
    monkeypatch.setattr(bpe_count, "KEPT", 10**6)
    assert n == bpe_count.Counter(public_tokenizers.path("byte_bpe_50k.json")).count(text) and len(ids) % 4 == 0


def test_hot_keys_by_themselves(spark, monkeypatch):
    rows = [(i, f"own {i}\nall\n" + ("many" if i % 3 else "few"), "en", "s", 1) for i in range(60)] + [(100 + i, "copy of one text here", "en", "s", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    want = [sorted(map(tuple, f(docs).collect())) for f in (line_dedup.op5, simhash.op2)]
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(line_dedup, "HOT_DOCS", 30)
    monkeypatch.setattr(simhash, "HOT", 20)
    assert want == [sorted(map(tuple, f(docs).collect())) for f in (line_dedup.op5, simhash.op2)]


def test_line_sql_on_repeated_rows(spark, odd, tmp_path):
    from tests.oracle import same_tables

    docs = odd.unionByName(odd.where("doc_id = 4"))
    same_tables(line_dedup.op5(docs), line_dedup.SQL, {"documents": docs})


def test_mix_keeps_white_space_and_repeats(spark):
    docs = spark.createDataFrame([(7, " a  b\n\tc " * 5, "en", "a", 1), (7, " x  y\n\tz " * 5, "en", "a", 1), (8, "w " * 3, "en", "b", 1)], DOCS)
    kept = [sorted(r["text"] for r in mixing.take(d).collect()) for d in (docs, docs.orderBy(F.desc("text")).repartition(3))]
    assert kept[0] == kept[1]
    texts = {r["text"] for r in docs.collect()}
    assert all(any(t.startswith(k) for t in texts) for k in kept[0])


def test_chat_ties_and_tables_without_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", None), (1, 0, "user", "a"), (2, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    clash = df.withColumns({c: F.lit("x") for c in ("t", "turns", "segments", "formatted", "valid", "end")})
    for d in (df, clash):
        found = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_conversations(chat.format_conversations(d)).collect()}
        assert found == {1: [("assistant", ""), ("user", "a"), ("user", "a"), ("user", "b")], 2: [("", "")]}
    assert chat.format_conversations(df.where("false")).count() == 0


def test_long_texts_everywhere(spark):
    text = "\n".join(f"line {i} of a very long text, {i * i}" for i in range(6_000))
    docs = spark.createDataFrame([(1, text, "en", "a", len(text)), (2, text, "en", "a", len(text)), (3, "short text of another kind", "de", "b", 1)], DOCS)
    for n, op in OPS.items():
        found = op(docs).collect()
        assert {r["doc_id"] for r in found} == {1, 2, 3}, n
