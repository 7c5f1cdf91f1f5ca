"""Queries of the subpackage against their SQL, or against brute force on the smallest tables."""

import collections
import hashlib
import re
import struct
import zlib
from html import unescape

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tactus.llm.queries import oracle_sql, queries
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, sf, name):
    same(queries()[name](spark, sf), oracle_sql()[name], sf)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas()


def test_language_id(spark, docs, sf):
    found = queries()["op1_language_id"](spark, sf).toPandas().merge(docs, on="doc_id")
    assert len(found) == len(docs)
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i in found["doc_id"]]
    assert held == found["held_out"].tolist()
    ours = found[found["held_out"] & found["lang"].notna()]
    assert (ours["lang"] == ours["lang_pred"]).mean() > 0.95
    assert found["score"].between(0, 1).all()


def _fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, t=2):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= t:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_near_dups(spark, docs, sf):
    found = queries()["op2_simhash_near_dedup"](spark, sf).toPandas().set_index("doc_id").loc[docs["doc_id"]]
    fps = [_fingerprint(t) for t in docs["text"]]
    assert [f"{f:016x}" for f in fps] == found["fingerprint"].tolist()
    least = collections.defaultdict(lambda: 2**63)
    roots = components(fps)
    for r, i in zip(roots, docs["doc_id"], strict=True):
        least[r] = min(least[r], i)
    assert [least[r] for r in roots] == found["component_id"].tolist()


def test_html(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas()
    found = queries()["op4_html_extraction"](spark, sf).toPandas().set_index("page_id")
    for i, page in zip(pages["page_id"], pages["html"], strict=True):
        article = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        text = re.sub(r"<[^>]+>", " ", re.sub(r"</?(b|i|a|em|strong)\b[^>]*>", "", article))
        want = " ".join(unescape(text).split())
        assert found.loc[i, "text"] == want and found.loc[i, "n_chars"] == len(want)


def test_media(spark, docs, sf):
    found = queries()["op6_media_columns"](spark, sf).toPandas().set_index("doc_id")
    assert len(found) == len(docs)
    for i, text in zip(docs["doc_id"], docs["text"], strict=True):
        raw = (text or "").encode()
        padded = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = found.loc[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        # the stored form, chunk by chunk as the PNG specification has it: no filter, rows of 192 grey samples
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        rows = b"".join(b"\0" + padded[k : k + 192] for k in range(0, len(padded), 192))
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 192, len(padded) // 192, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 1)) + chunk(b"IEND", b"")
        assert (r["media_bytes"], r["media_sha256"]) == (len(png), hashlib.sha256(png).hexdigest())
        p = [padded.count(v) / len(padded) for v in set(padded)]
        cuts = [k * len(padded) // 72 for k in range(72)] + [len(padded)]
        means = [sum(padded[a:b]) / (b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
        rise = "".join("1" if means[9 * y + x + 1] > means[9 * y + x] else "0" for y in range(8) for x in range(8))
        mean, entropy, bits = re.fullmatch(r"mean=([\d.]+);entropy=([\d.]+);rise=([0-9a-f]{16})", r["feature"]).groups()
        assert abs(float(mean) - sum(padded) / len(padded)) < 1e-4 and abs(float(entropy) + sum(x * np.log2(x) for x in p)) < 1e-4 and int(bits, 2 * 8) == int(rise, 2)


def test_token_counts(spark, docs, sf):
    found = queries()["op8_token_counts"](spark, sf).toPandas().set_index("doc_id").loc[docs["doc_id"]]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [len(e.ids) for e in t.encode_batch([x or "" for x in docs["text"]], add_special_tokens=False)]
    assert found["n_tokens"].tolist() == want and found["over_limit"].tolist() == [n > 512 for n in want]


def test_mixing_meets_targets(spark, sf):
    found = queries()["op9_source_mixing"](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").toPandas()[["doc_id", "source"]], on="doc_id")
    by = found.groupby("source", dropna=False).agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), own=("size", "sum"))
    assert (by["own"] == by["size"]).all() and ((by["taken"] - by["target"]).abs() <= 0.5).all()
    assert (found["taken"] <= 3 * found["size"]).all() and by["target"].sum() == pytest.approx(by["size"].sum())
    target = targets(by["size"].to_dict())
    assert all(by["target"][s] == pytest.approx(target[s]) for s in target)


def targets(sizes):
    """Targets by resharing, round after round."""
    names = sorted(sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, total = {}, float(sum(sizes.values()))
    left = set(names)
    while left:
        w = sum(weight[s] for s in left)
        over = {s for s in left if total * weight[s] / w > 3 * sizes[s]}
        if not over:
            target |= {s: total * weight[s] / w for s in left}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        total -= sum(target[s] for s in over)
        left -= over
    return target


def check_packing(rows, docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*e.ids, 1] for i, e in zip(docs["doc_id"], t.encode_batch([x or "" for x in docs["text"]], add_special_tokens=False), strict=True)}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows.itertuples(index=False):
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(own) > 0 and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own)) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts, whole in [(pieces[i], len(x)) for i, x in ids.items()] + [(x, None) for x in sequences.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        if whole is None:
            assert at <= 2048 and at & (at - 1) == 0  # full, or a power of two: no padding
        else:
            assert at == whole


def test_packing(spark, docs, sf):
    check_packing(queries()["op10_packing"](spark, sf).toPandas(), docs)


def test_pipeline(spark, docs, sf):
    import corpus_pipeline as c
    from tactus.llm import simhash
    from tactus.llm.common import table, written

    kept = table(spark, sf, "documents")
    before = {}
    for name, stage in c.STAGES:
        kept = written(stage(spark, kept, sf), name)
        before[name] = kept
        if name != "pack":
            assert kept.columns == list(docs.columns)
    language, lines, near, mix = (before[k].toPandas() for k in ("language", "lines", "near_dups", "mix"))
    assert set(language["doc_id"]) == {i for i, t in zip(docs["doc_id"], docs["text"], strict=True) if any(ch.isalpha() for ch in t or "")}
    # a line that ten documents have is left in one
    key = lambda x: x.strip(" \t\n\v\f\r").translate({i: i + 32 for i in range(65, 91)})
    n = collections.Counter(k for t in language["text"] for k in {key(x) for x in t.split("\n")} if k)
    after = collections.Counter(key(x) for t in lines["text"] for x in t.split("\n"))
    assert all(after[k] == 1 for k, v in n.items() if v >= 10)
    assert lines["n_chars"].tolist() == lines["text"].str.len().tolist()
    fps = [simhash.fingerprint(t.encode()) for t in lines["text"]]
    least = collections.defaultdict(lambda: 2**63)
    for r, i in zip(components(fps), lines["doc_id"], strict=True):
        least[r] = min(least[r], i)
    assert sorted(near["doc_id"]) == sorted(least.values())
    # mix: each source's words are its target, documents whole, or one a source with its first words
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    texts, sources = dict(zip(near["doc_id"], near["text"], strict=True)), dict(zip(near["doc_id"], near["source"], strict=True))
    sizes = collections.Counter()
    for t, s in zip(near["text"], near["source"], strict=True):
        sizes[s] += words(t)
    taken, cut, times = collections.Counter(), collections.Counter(), collections.Counter()
    for r in mix.itertuples(index=False):
        assert texts[r.doc_id].startswith(r.text) and r.source == sources[r.doc_id] and r.n_chars == len(r.text)
        taken[r.source] += words(r.text)
        cut[r.source] += r.text != texts[r.doc_id]
        times[r.doc_id] += 1
    want = targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 0.5 and cut[s] <= 1 for s in want)
    assert max(times.values()) <= 3
    # pack: every token of every row once, in sequences without padding
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    left = collections.Counter()
    for i, e in zip(mix["doc_id"], t.encode_batch(list(mix["text"]), add_special_tokens=False), strict=True):
        left.update((i, k, len(e.ids) + 1) for k in range(len(e.ids) + 1))
    sequences = collections.defaultdict(list)
    for r in before["pack"].toPandas().itertuples(index=False):
        left.subtract((r.doc_id, k, r.doc_tokens) for k in range(r.start, r.start + r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert not any(left.values())
    for parts in sequences.values():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0


def test_queries_are_registered():
    import __spark_entry__ as e

    assert set(queries()) <= set(e.queries()) and "pipeline" in e.queries()
    assert {re.match(r"op(\d+)_", k)[1] for k in queries() if k != "pipeline"} == {str(i) for i in range(1, 11)}
    assert np.isin(list(oracle_sql()), list(queries())).all()
    assert F is not None
