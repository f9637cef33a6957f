"""Corpus operators against direct computation, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import functools
import gzip
import hashlib
import io
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from gaugeline.session import scratch_table
from llm import (components, decontaminate, licenses, line_dedup, mixing, quality_classifier, quality_rules, simhash, simple8b, substring_dedup,
                 token_files, warc)
from llm.queries import ORACLE, QUERIES, WORDS

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")
# extra columns named like those the operators make or use inside
CLASHING = "id string, key string, r string, fp string, spans string, score string, mix string, cell string, n_words string, line string, doc string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(("an", "ter", "ion", "the", "so", "ly", "ré")) for _ in range(rng.randint(1, 4))) for _ in range(n))


LONG = prose(1, 30_000)
PASSAGE = prose(2, 60)
CASES = [
    (1, prose(3, 120)), (2, prose(3, 120)), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, PASSAGE + " tail one"),
    (8, "head two\n" + PASSAGE + "\nMixed CASE " + prose(4, 40)), (9, "same same same " * 50), (10, "word"), (11, "two words"),
    (12, prose(3, 119) + " edited"), (13, "ÀÉ é́ ß 'tis <|endoftext|> x<|endoftext|>y 12.5% it's İI"), (13, "repeated id"), (13, "repeated id"),
    (None, prose(5, 80)), (None, None), (14, "Released under the MIT License.\n" + prose(6, 30)), (15, "x" * 50_000), (16, PASSAGE),
]


def frame(spark, rows=CASES, sources=("a", "b", None), langs=("en", None, "de")):
    full = [(i, t, langs[k % len(langs)], sources[k % len(sources)], None if t is None else len(t), *["?"] * 11) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def table_of(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


# ---- 1 ------------------------------------------------------------------------------------

@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, (1 << 64) - 1)), max_size=3000), st.integers(1, 400))
def test_simple8b_round_trip(values, repeat):
    x = np.array(values[:50] * (repeat % 40) + values, np.uint64)
    packed = simple8b.pack(x)
    assert (simple8b.unpack(packed) == x).all()
    assert len(packed.blocks) == -(-len(x) // simple8b.BLOCK) + 1


def test_simple8b_density():
    assert len(simple8b.pack(np.zeros(1024, np.uint64)).words) == 5
    assert len(simple8b.pack(np.full(1024, 1000, np.uint64)).words) == -(-1024 // 6)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, (1 << 32) - 1), max_size=40), max_size=20))
def test_token_group_round_trip(docs):
    ids = [np.array(d, "<u4").tobytes() for d in docs]
    names = [None if k % 5 == 4 else k - 7 for k in range(len(docs))]
    if docs:
        got, lengths, flat = token_files.unpack_group(token_files.pack_group(names, ids))
        assert got == names and lengths.tolist() == [len(d) for d in docs] and flat.tobytes() == b"".join(ids)


def test_token_group_escapes():
    stream = np.concatenate([np.arange(70_000), np.arange(70_000)[::-1]]).astype("<u4").tobytes()
    assert token_files.unpack_group(token_files.pack_group([1], [stream]))[2].tobytes() == stream


def expected_tokens(rows):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((i, len(ids), zlib.crc32(ids.tobytes())))
    return out


@pytest.mark.parametrize("by_word", [True, False])
def test_token_table(spark, by_word):
    got = token_files.token_table(frame(spark), scratch_table(spark, "t"), TOKENIZER, by_word).orderBy("start").collect()
    want = expected_tokens(CASES)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(want)
    assert [r.doc_id for r in got] == [w[0] for w in want]
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]


@functools.cache
def encoder():
    return token_files.Encoder(token_files._spec(TOKENIZER), True)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBzé’'.,-—!?1²٣ \n\t  \x1ćİßΣA<|>endoftx"), max_size=60))
def test_words_encode_like_texts(text):
    want = encoder().known.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder()(text.encode()), np.uint32).tolist() == [*want, 1]


def test_ids_can_be_written_as_they_are(spark, tmp_path):
    ids = frame(spark).select("doc_id", token_files.token_ids(spark, "text", TOKENIZER).alias("ids"))
    token_files.write_ids(ids, str(tmp_path))
    got = token_files.read_tokens(spark, str(tmp_path)).select("doc_id", "n_tokens", F.crc32("ids"))
    assert rows_of(got) == Counter(expected_tokens(CASES))


def test_cut_token_file_is_found(spark, tmp_path):
    token_files.write_tokens(frame(spark), str(tmp_path), TOKENIZER, True)
    part = next(tmp_path.glob("*.s8b"))
    part.write_bytes(part.read_bytes()[:-3])
    with pytest.raises(Exception, match="cut off"):
        token_files.read_tokens(spark, str(tmp_path)).count()


# ---- 2 ------------------------------------------------------------------------------------

PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://a/4", ""), (5, "http://a/\r\nX: y", "é" * 70_000),
         (5, "http://a/5", "<p>x</p>"), (None, "http://a/6", "<p>x</p>"), (None, None, "alone"), (7, "http://b/7", "WARC/1.1\r\n\r\nWARC/1.1\r\n")]


def expected_archive(pages, least=0):
    out = Counter()
    for i, _, html in pages:
        body = (html or "").encode()
        same = [p for p, _, h in pages if (h or "").encode() == body]
        top = max((p for p in same if p is not None), default=None)
        revisit = len(same) > 1 and len(body) >= least and top is not None and i != top
        out[(i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", top if revisit else None)] += 1
    return out


@pytest.mark.parametrize(("least", "compress"), [(0, True), (1, False)])
def test_archive(spark, least, compress):
    pages = table_of(spark, [(*p, "?", "?") for p in PAGES], "page_id long, url string, html string, payload string, digest string")
    got = warc.archive_pages(pages, scratch_table(spark, "w"), least, compress=compress, file_bytes=100).drop("target_uri")
    assert rows_of(got) == expected_archive(PAGES, least)


def test_warc_pushdown_and_foreign_files(spark, tmp_path):
    def record(kind, uri, body, http=True):
        block = b"HTTP/1.1 200 OK\r\nX-Long: a\r\n  b\r\n\r\n" + body if http else body
        return (f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: <urn:{uri}>\r\nWARC-Target-URI: {uri}\r\n"
                f"Content-Type: application/{'http; msgtype=response' if http else 'warc-fields'}\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"

    data = record("warcinfo", "info", b"software: x", False) + record("response", "http://a/1", b"one") + record("response", "http://b/2", b"two\r\n\r\n")
    (tmp_path / "x.warc").write_bytes(data)
    with gzip.open(tmp_path / "y.warc.gz", "wb") as f:
        f.write(data)
    df = warc.read_warc(spark, str(tmp_path))
    assert df.count() == 6
    picked = df.where("record_type = 'response' AND target_uri LIKE 'http://b%'").select("target_uri", "payload", F.col("http_headers")["X-Long"].alias("h"))
    assert [(r.target_uri, bytes(r.payload), r.h) for r in picked.collect()] == [("http://b/2", b"two\r\n\r\n", "a b")] * 2
    assert rows_of(warc.read_warc(spark, str(tmp_path), payload="false").where("record_type IN ('warcinfo')").select("record_id", "payload")) == {("<urn:info>", None): 2}

    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            self.taken += len(out)
            return out

    stream = Counting(data)
    assert [r["target_uri"] for r in warc.parse(stream, lambda row: row["record_type"] == "warcinfo", seekable=True)] == ["info"]
    assert stream.taken == len(b"software: x")   # rejected payloads are never read
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.parse(io.BytesIO(data[:-9])))


# ---- 3 ------------------------------------------------------------------------------------

def brute_fingerprint(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    prints = [(i, brute_fingerprint(t)) for i, t in CASES]
    group = list(range(len(prints)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                x, y = top(a), top(b)
                group[max(x, y)] = min(x, y)
    low = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            low[top(k)] = min(i, low.get(top(k), i))
    want = Counter((i, f"{f:016x}", low.get(top(k))) for k, (i, f) in enumerate(prints))
    assert rows_of(simhash.simhash_components(frame(spark)).drop("n_links")) == want


def test_simhash_links_are_complete(spark):
    rng = random.Random(5)
    points = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(250):
        p = rng.choice(points)
        for _ in range(rng.randint(1, 4)):
            p ^= 1 << rng.randrange(64)
        points.append(p)
    points = sorted({simhash.signed(p) for p in points})
    want = {(a, b) for i, a in enumerate(points) for b in points[i + 1:] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    got = simhash.simhash_links(table_of(spark, [(p,) for p in points], "fp long"))
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)]
    group = {x: x for p in links for x in p}
    for _ in range(400):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    got = {r.node: r.component for r in components.components(table_of(spark, links, "a long, b long")).collect()}
    assert got == {x: c for x, c in group.items() if x in got} and all(group[x] == x for x in group if x not in got)
    assert components.components(table_of(spark, [], "a long, b long")).count() == 0


def jaccard(a, b):
    a, b = (set(simhash.shingles(t.encode().lower().split(), 5)) for t in (a, b))
    return len(a & b) / len(a | b)


def test_keep_one(spark):
    base = prose(9, 300).split()
    edited = [" ".join(base[:50 * k] + [f"new{k}"] + base[50 * k + 1:]) for k in range(1, 5)]
    rows = [(10, " ".join(base)), (11, " ".join(base)), *[(20 + k, t) for k, t in enumerate(edited)], (30, prose(10, 300)), (31, prose(11, 300)), (32, None), (33, ""),
            (30, prose(10, 300)), (None, " ".join(base))]
    assert all(jaccard(rows[0][1], t) > 0.8 for t in edited) and jaccard(rows[0][1], rows[6][1]) < 0.1
    got = simhash.keep_one(frame(spark, rows))
    assert got.columns == frame(spark).columns
    assert sorted(r.doc_id or -1 for r in got.collect()) == [-1, 10, 30, 31, 32]   # 33 repeats the empty text of 32


def spread(words, step, mark):
    """Every ``step``-th word replaced: edits lie evenly over the text."""
    return [f"{mark}{k}" if k % step == step // 2 else w for k, w in enumerate(words)]


def test_evenly_edited_texts_meet():
    met = 0
    for k in range(300):
        base = prose(2000 + k, 460).split()
        other = spread(base, 46, "new")
        assert 0.8 <= jaccard(" ".join(base), " ".join(other)) < 0.85
        a, b = (set(simhash.band_keys(simhash.shingle_hashes(" ".join(t).encode()))) for t in (base, other))
        met += bool(a & b)
    assert met == 300
    apart = [set(simhash.band_keys(simhash.shingle_hashes(prose(3000 + k, 300).encode()))) for k in range(50)]
    assert len(set.union(*apart)) == 50 * simhash.BANDS


def hot_family():
    """Two near copies, all of whose common bands hold unlike texts with lower ids."""
    base = prose(4000, 400).split()
    other = spread(base, 150, "new")
    rows = [(900, " ".join(base)), (901, " ".join(other))]
    for k in range(150):
        gone = random.Random(k).sample(range(0, 400, 20), 4)
        kept = [prose(9000 + 400 * k + i, 20).split() if i in gone else base[i:i + 20] for i in range(0, 400, 20)]
        rows.append((100 + k, " ".join(sum(kept, []))))
    return rows


def test_all_texts_of_a_band_meet(spark):
    rows = hot_family()
    keys = [set(simhash.band_keys(simhash.shingle_hashes(t.encode()))) for _, t in rows]
    assert keys[0] & keys[1] and keys[0] & keys[1] <= set.union(*keys[2:])
    assert jaccard(rows[0][1], rows[1][1]) > 0.9 and max(jaccard(rows[0][1], t) for _, t in rows[2:]) < 0.8
    kept = {r.doc_id for r in simhash.keep_one(frame(spark, rows)).collect()}
    assert 900 in kept and 901 not in kept


def brute_kept(rows):
    """Least ids of the components of exact Jaccard similarity 0.8 over texts with words."""
    sets = {i: set(simhash.shingles((t or "").encode().lower().split(), 5)) for i, t in rows}
    holders, common, parent = {}, Counter(), {i: i for i in sets}
    for i in sorted(sets):
        for g in sets[i]:
            common.update((j, i) for j in holders.setdefault(g, []))
            holders[g].append(i)

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    empty = [i for i in sorted(sets) if not sets[i]]
    links = [(a, b) for (a, b), n in common.items() if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8]
    for a, b in links + [(empty[0], i) for i in empty]:
        low, high = sorted((top(a), top(b)))
        parent[high] = low
    return {i for i in sets if top(i) == i}


def test_keep_one_is_exact_at_the_threshold(spark):
    rows = []
    for k in range(60):   # pairs on both sides of 0.8, edits spread evenly
        base = prose(7000 + k, 460).split()
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(spread(base, (36, 40, 46, 52)[k % 4], "new")))]
    want = brute_kept(rows)
    assert len(want) == 90
    assert {r.doc_id for r in simhash.keep_one(frame(spark, rows)).collect()} == want


def test_large_family_compares_few_pairs(spark, monkeypatch):
    """Near copies of one text, many of them unlike each other: only links leave the comparison of all; op3's anchors are asked."""
    base = prose(5000, 146).split()
    rng, rows, compared, asked = random.Random(5), [], [], []
    for k in range(400):
        text = list(base)
        for at in rng.sample(range(146), rng.choice((1, 2, 3, 4))):
            text[at] = f"w{k}x{at}"
        rows.append((k, " ".join(text)))
    alike, links = simhash.alike, simhash.simhash_links
    monkeypatch.setattr(simhash, "alike", lambda pairs, docs, similarity: compared.append(pairs.count()) or alike(pairs, docs, similarity))
    monkeypatch.setattr(simhash, "simhash_links", lambda points: asked.append(1) or links(points))
    assert {r.doc_id for r in simhash.keep_one(frame(spark, rows)).collect()} == brute_kept(rows)
    assert sum(compared) < 40 * len(rows) and asked


def test_keep_one_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_kept([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + [(-1, "")])
    got = {r.doc_id for r in simhash.keep_one(docs).select("doc_id").collect()}
    assert got == want - {-1} and len(got) < docs.count()


# ---- 4 ------------------------------------------------------------------------------------

def test_mixing_meets_targets(spark):
    rows = [(k, prose(k, 5 + k * 7 % 40)) for k in range(300)]
    docs = frame(spark, rows, ("big", "big", "big", "small", None), ("en", "de"))
    got = mixing.mix(docs, {"source": {"big": 0.5, "small": 0.3, "": 0.2}, "lang": {"en": 0.6, "de": 0.4}}, keep=0.3, topic=F.lit("t")).collect()
    total = sum(r.tokens for r in got)
    for name, goal in (("source", {"big": 0.5, "small": 0.3, "": 0.2}), ("lang", {"en": 0.6, "de": 0.4})):
        for value, share in goal.items():
            assert sum(r.tokens * r.weight for r in got if r[name] == value) == pytest.approx(share * total, rel=1e-4)
    assert sum(r.tokens * r.probability for r in got) == pytest.approx(0.3 * total, rel=1e-4)
    for r in got:
        digest = int(hashlib.md5(f"mix-1{r.doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52)
        assert r.sampled == (digest < r.probability) or abs(digest - r.probability) < 1e-5


def test_mixing_cases(spark):
    got = mixing.mix(frame(spark)).collect()
    assert len(got) == len(CASES) and sum(r.tokens for r in got) == sum(len(WORD.findall(t or "")) for _, t in CASES)
    kept = mixing.keep_mixed(frame(spark))
    assert kept.columns == frame(spark).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.sampled)
    assert mixing.mix(frame(spark), keep=1.0).where("probability < 1 AND tokens > 0").count() == 0


# ---- 5 ------------------------------------------------------------------------------------

def test_license_pruning_loses_nothing(spark):
    rng = random.Random(3)
    known = licenses.templates()
    rows = list(CASES)
    for k in range(300):
        words = re.findall(r"[^\W_]+", rng.choice(licenses.TEMPLATES)[1])
        for _ in range(rng.randint(0, max(1, len(words) // 8))):
            words[rng.randrange(len(words))] = rng.choice(("the", "license", "other"))
        lines = [prose(k, 9)] * rng.randint(0, 2) + ["  ".join(words).upper() if k % 3 else ", ".join(words)]
        rows.append((100 + k, "\n".join(lines)))
    want = {}
    for i, t in rows[len(CASES):]:
        lines = ([t] if "\n" not in t else []) + t.split("\n") if "\n" in t else [t]
        units = ([(0, t)] if "\n" in t else []) + [(n, x) for n, x in enumerate(lines, 1)]
        scores = []
        for n, unit in units:
            a = set(licenses.Template.of("", unit).bigrams)
            for k, tpl in enumerate(known):
                s = round(2 * len(a & set(tpl.bigrams)) / (len(a) + len(tpl.bigrams)), 6)
                if s >= 0.8:
                    scores.append((s, -k, -n, tpl.license))
        want[i] = (max(scores)[3], max(scores)[0]) if scores else (None, 0.0)
    got = licenses.license_scan(frame(spark, rows)).collect()
    assert {r.doc_id: (r.license, r.score) for r in got if (r.doc_id or 0) >= 100} == want
    assert len(got) == len(rows) and {r.license for r in got if r.doc_id == 14} == {"mit"}
    assert sum(r.license is not None for r in got if (r.doc_id or 0) < 100) == 1


# ---- 6 ------------------------------------------------------------------------------------

def brute_align(item, passage):
    h = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a == b else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=15), st.lists(st.integers(0, 4), max_size=30))
def test_alignment(item, passage):
    a, b = np.array(item, np.uint64), np.array(passage, np.uint64)
    score, first, last = decontaminate.aligned_span(a, b)
    assert score == brute_align(item, passage)
    assert not score or brute_align(item, passage[first:last + 1]) == score


def test_contamination(spark):
    rng = random.Random(7)
    items = [(k, prose(1000 + k, 12 + 5 * k)) for k in range(12)] + [(50, None), (51, ""), (52, "tiny item"), (None, prose(77, 20)), (3, prose(1003, 27))]
    rows = list(CASES)
    for k in range(60):
        words = decontaminate.normal_words((items[k % 12][1]).encode())
        for _ in range(int(len(words) * rng.choice((0, 0.1, 0.2, 0.9)))):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(9)}".encode()
        rows.append((200 + k, prose(k, 40) + " " + b" ".join(words).decode().upper() + " " + prose(k + 500, 40)))
    rows += [(300, "A Tiny, ITEM!"), (301, "tiny thing")]
    want = Counter()
    for i, t in rows:
        words = decontaminate.normal_words((t or "").encode())
        if len(words) > 5000:
            continue
        for item, text in items:
            mine = decontaminate.normal_words((text or "").encode())
            whole = b" ".join(mine) in b" ".join(words)   # an item shorter than a seed counts only as a whole
            if mine and brute_align(mine, words) / (2 * len(mine)) >= 0.5 and (whole or len(mine) >= 4):
                want[(i, item)] += 1
    got = decontaminate.contamination(frame(spark, rows), table_of(spark, items, "item_id long, text string"))
    assert rows_of(got.select("doc_id", "item_id")) == want and len(want) > 40
    clean = decontaminate.without_benchmark(frame(spark, rows), table_of(spark, items, "item_id long, text string"))
    assert clean.columns == frame(spark).columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(i for i, t in rows if not any(w[0] == i for w in want))


def test_contamination_by_shared_and_edited_items(spark):
    base = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(base[:39] + [f"last{k}"])) for k in range(3)]   # a template: one word is an item's own
    other = [f"v{k}" for k in range(40)]
    items += [(7, " ".join(other))]
    edits = {1: base[:39], 2: base[10:32],
             11: [f"new{k}" if k % 4 == 3 else w for k, w in enumerate(other)], 12: [f"new{k}" if k % 3 == 2 else w for k, w in enumerate(other)],
             13: [w for k, v in enumerate(other) for w in ([v, f"new{k}"] if k % 2 else [v])], 14: other[:12], 15: other[:20][::-1]}
    rows = [(i, prose(i, 30) + " " + " ".join(t) + " " + prose(i + 50, 30)) for i, t in edits.items()]
    want = {(i, k) for i, t in rows for k, item in items
            if brute_align(decontaminate.normal_words(item.encode()), decontaminate.normal_words(t.encode())) / (2 * len(item.split())) >= 0.5}
    assert {(1, 0), (1, 1), (1, 2), (2, 0), (11, 7), (12, 7), (13, 7)} <= want and not {(14, 7), (15, 7)} & want
    got = decontaminate.contamination(frame(spark, rows), table_of(spark, items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    left = decontaminate.without_benchmark(frame(spark, rows), table_of(spark, items, "item_id long, text string"))
    assert {r.doc_id for r in left.collect()} == set(edits) - {i for i, _ in want}


# ---- 7 ------------------------------------------------------------------------------------

@pytest.mark.parametrize("log2_size", [4, 8])
def test_line_dedup(spark, log2_size):
    rows = [(k, "\n".join([f" spread {n} " for n in range(40) if k % (n + 2) == 0] + ["everywhere", f"own {k}", "", "everywhere"])) for k in range(200)]
    sites = tuple(f"s{k}" for k in range(97)) + (None,)
    spread = {}
    for k, (_, t) in enumerate(rows):
        for line in t.split("\n"):
            if sites[k % 98]:
                spread.setdefault(line.strip(), set()).add(sites[k % 98])
    docs = frame(spark, rows, sites)
    for least in (5, 12):
        gone = {x for x, s in spread.items() if x and len(s) >= least}
        got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in _removed(docs, least, log2_size).collect()}
        for i, t in rows:
            kept = [x for x in t.split("\n") if x.strip() not in gone]
            assert got[i] == (len(t.split("\n")), len(t.split("\n")) - len(kept), "\n".join(kept))
    assert line_dedup.remove_lines(frame(spark), 2).count() == len(CASES)


def _removed(docs, least, log2_size):
    original = line_dedup.boilerplate_lines
    line_dedup.boilerplate_lines = lambda *a, **b: original(*a, **b, log2_size=log2_size)
    try:
        return line_dedup.remove_lines(docs, least)
    finally:
        line_dedup.boilerplate_lines = original


# ---- 8 ------------------------------------------------------------------------------------

def brute_repeats(rows, length):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[p:p + length]) for w in words for p in range(len(w) - length + 1))
    out = Counter()
    for (i, _), w in zip(rows, words, strict=True):
        keep = [True] * len(w)
        for p in range(len(w) - length + 1):
            if seen[tuple(w[p:p + length])] > 1:
                keep[p:p + length] = [False] * length
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        out[(i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept))] += 1
    return out


@pytest.mark.parametrize("unique", [True, False])
def test_substring_dedup(spark, unique):
    rng = random.Random(11)
    base = prose(12, 400).split()
    rows = [] if unique else list(CASES)
    for k in range(60):   # pieces of one text in ever other surroundings, down to exactly the length and one below
        n, at = rng.choice((34, 35, 36, 60, 200)), rng.randrange(200)
        rows.append((1000 + k, " ".join([f"a{k}"] * rng.randint(0, 3) + base[at:at + n] + [f"b{k}"] + base[:rng.choice((0, 35))])))
    rows += [(2000, "loop " * 100), (2001, "x y " * 17 + "x"), (2002, "x y " * 18)]
    got = substring_dedup.remove_repeats(frame(spark, rows))
    assert rows_of(got.drop("repeats")) == brute_repeats(rows, 35)
    for r in got.collect():
        assert sum(s.words for s in r.repeats) >= r.n_removed


def test_substring_dedup_other_length(spark):
    assert rows_of(substring_dedup.remove_repeats(frame(spark), 13).drop("repeats")) == brute_repeats(CASES, 13)
    with pytest.raises(ValueError, match="above"):
        substring_dedup.remove_repeats(frame(spark), 12)


# ---- 9 ------------------------------------------------------------------------------------

def test_quality_classifier(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality_classifier.classify(docs, labels)
    truth = got.join(labels, "doc_id").where("held_out")
    right = {r.quality: r.right for r in truth.groupBy("quality").agg(F.avg((F.col("quality") == F.col("predicted")).cast("double")).alias("right")).collect()}
    assert right[1] > 0.97 and right[0] > 0.95
    for r in got.limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_quality_classifier_cases(spark):
    labels = table_of(spark, [(1, 1, 0), (1, 0, 0), (2, 1, 1), (6, 1, 0), (9, 0, 0), (99, 1, 0), (None, 1, 0), (7, None, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(frame(spark), labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and Counter(r.doc_id for r in got.collect()) == Counter(i for i, _ in CASES)
    none = quality_classifier.classify(frame(spark), labels.where("quality = 0"))
    assert len({r.score for r in none.collect()}) == 1
    assert quality_classifier.keep_quality(frame(spark), labels).columns == frame(spark).columns


def test_held_out_labels_do_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality_classifier.fold() == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (rows_of(quality_classifier.classify(docs, x).select("doc_id", F.round("score", 6))) for x in (labels, turned))
    assert a == b


def test_risk_is_minimal():
    rng = np.random.default_rng(0)
    x = np.hstack([np.ones((4000, 1)), rng.normal(size=(4000, 5))])
    positive = x[:, 1] + 0.3 * rng.normal(size=4000) > -0.5
    prior = positive.mean()
    m_all, m_pos = x.T @ x / len(x), x[positive].T @ x[positive] / positive.sum()

    def risk(w):
        f = x @ w
        p = positive
        return prior * ((1 - f[p]) ** 2).mean() / 4 + max(0, ((1 + f) ** 2).mean() / 4 - prior * ((1 + f[p]) ** 2).mean() / 4) + 1e-3 * (w[1:] ** 2).sum()

    w = quality_classifier.minimise(m_all, m_pos, prior, 1e-3)
    assert all(risk(w) <= risk(w + 0.05 * rng.normal(size=6)) + 1e-9 for _ in range(200))
    assert ((x @ w > 0) == positive).mean() > 0.85


# ---- 10 -----------------------------------------------------------------------------------

def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {p + k for p in range(len(words) - 2) for k in range(3) if windows[tuple(words[p:p + 3])] > 1}
    lines, seen, repeated = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), failed


def test_quality_rules(spark):
    rng = random.Random(8)
    noise = base64.b64encode(rng.randbytes(9000)).decode()
    rows = CASES + [(40, "a b c\na b c\n \n \nd"), (41, " ".join(noise[i:i + 9] for i in range(0, len(noise), 9))), (42, prose(3, 2000) + " ab" * 900), (43, "#a *b $%& |<>")]
    got = quality_rules.quality_rules(frame(spark, rows)).collect()
    assert Counter((r.doc_id, *r[1:7]) for r in got) == Counter((i, *brute_rules(t)) for i, t in rows)
    kept = {r.doc_id: r.kept for r in got}
    assert kept[1] and kept[6] and not kept[41] and not kept[9] and not any(r.kept and r.base_failed for r in got)
    packer = zstandard.ZstdCompressor(level=3)
    assert all(r.ratio == (len(packer.compress(t.encode())) / len(t.encode()) if t else 0) for r in got for i, t in rows if i == r.doc_id and i in (1, 6, 42))


def test_keep_one_with_unlike_texts_of_one_id(spark):
    a, b, c = prose(61, 90), prose(62, 90), prose(63, 90)
    rows = [(1, a), (1, b), (2, c), (2, c), (3, a), (None, a), (4, None), (5, "")]
    kept = Counter((r.doc_id, r.text) for r in simhash.keep_one(frame(spark, rows)).collect())
    left = Counter({(1, a): 1, (1, b): 1, (2, c): 1, (None, a): 1})
    assert {k: v for k, v in kept.items() if k[1]} == left
    assert sum(v for (i, t), v in kept.items() if not t) <= 2
    assert simhash.keep_one(frame(spark, rows)).columns == frame(spark).columns


def test_margins_that_cannot_be_met(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 10)], "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}, "topic": {"t": 1.0}}
    assert mixing.rake(cells, targets)[1] > 1
    docs = [(k, "word " * 10) for k in range(20)]
    tied = frame(spark, docs, ("a", "b"), ("x", "y"))
    topic = F.lit("t")
    with pytest.raises(mixing.UnattainableMargins):
        mixing.mix(tied, targets, topic=topic)
    with pytest.raises(mixing.UnattainableMargins):
        mixing.keep_mixed(tied, targets, topic=topic)
    uneven = frame(spark, [(k, "word " * (10 if k % 2 else 500)) for k in range(20)], ("a", "b"), ("x", "y"))
    with pytest.warns(UserWarning, match="cannot meet"):
        mixing.mix(uneven, topic=topic)


def brute_verdict(text, bands):
    """The verdict by its definition: the whole text's ratio, then the share of chunks outside."""
    body = (text or "").encode()
    words = body.split()
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    repeated = {j for i, w in enumerate(windows) if w in often for j in (i, i + 1, i + 2)}
    if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
        return False
    ratio = [len(zstandard.compress(body, bands.level)) / len(body)]
    low, high = next(b[1:] for b in bands.whole if len(body) <= b[0])
    cuts = [*range(0, len(body) - bands.chunk_bytes + 1, bands.chunk_bytes)] or [0]
    parts = [body[a:b] for a, b in zip(cuts, [*cuts[1:], len(body)])] if len(cuts) > 1 else []
    bad = [not bands.chunk[0] <= len(zstandard.compress(p, bands.level)) / len(p) <= bands.chunk[1] for p in parts]
    return low <= ratio[0] <= high and (not bad or sum(bad) / len(bad) <= bands.chunk_share)


def test_compression_decides(spark):
    """Loops and noise that pass the base rules fall to the whole or the chunk rule; texts of the table agree with the definition."""
    rng = random.Random(9)
    table = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    good = next(t for t in sorted(table, key=len, reverse=True) if brute_verdict(t, quality_rules.Bands()) and len(t.encode()) < 60_000)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    noise = " ".join("".join(rng.choice(letters) for _ in range(9)) for _ in range(300))
    loop = " ".join(f"aaaaaaaaaa{i:03d}aaaaaaaaaa" for i in range(400))
    rows = [(1, noise), (2, loop), (3, good), (4, good + " " + noise * 4), (5, good[:6000] + " " + " ".join(f"zzzzzzzzzzzz{i}z" for i in range(900)))]
    rows += [(100 + k, t) for k, t in enumerate(table)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, rows)).collect()}
    bands = quality_rules.Bands()
    assert all(got[i].kept == brute_verdict(t, bands) for i, t in rows)
    assert [got[i].kept for i in (1, 2, 3, 4, 5)] == [False, False, True, False, False]
    assert not got[1].base_failed and not got[2].base_failed and got[5].chunks_outside > bands.chunk_share
    assert any(not r.base_failed and not r.kept for i, r in got.items() if i >= 100)


# ---- all ----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_twin(spark, db, name):
    df = QUERIES[name](spark, SF)
    want = db.sql(ORACLE[name])
    order = sorted(want.columns)
    assert sorted(df.columns) == order
    assert rows_of(df.select(*order)) == Counter(tuple(r) for r in db.sql(f"SELECT {', '.join(order)} FROM ({ORACLE[name]})").fetchall())


def test_words_in_sql_are_words_in_python(db):
    texts = [r[0] for r in db.sql("SELECT text FROM documents").fetchall()]
    assert [r[0] for r in db.sql(f"SELECT {WORDS} FROM documents").fetchall()] == [WORD.findall(t) for t in texts]


def empty(spark):
    return spark.createDataFrame([], SCHEMA), table_of(spark, [], "doc_id long, quality int, toxic int"), table_of(spark, [], "item_id long, text string")


def test_empty_tables(spark):
    docs, labels, items = empty(spark)
    pages = table_of(spark, [], "page_id long, url string, html string")
    results = [token_files.token_table(docs, scratch_table(spark, "t"), TOKENIZER, True), warc.archive_pages(pages, scratch_table(spark, "w")),
               simhash.simhash_components(docs), simhash.keep_one(docs), mixing.mix(docs), mixing.keep_mixed(docs), licenses.license_scan(docs),
               decontaminate.contamination(docs, items), decontaminate.contamination(frame(spark), items), line_dedup.remove_lines(docs),
               substring_dedup.remove_repeats(docs), quality_classifier.classify(docs, labels), quality_classifier.keep_quality(docs, labels), quality_rules.quality_rules(docs)]
    assert all(r.count() == 0 for r in results)
    assert decontaminate.without_benchmark(frame(spark), items).count() == len(CASES)


def test_pipeline_stages(spark, tmp_path):
    """Every stage keeps the columns and drops what its operator reports, on edge cases and on the small table."""
    spark.createDataFrame([(1, 1, 0), (6, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs, folder in ((frame(spark), str(tmp_path)), (spark.read.parquet(f"{SF}/documents.parquet"), SF), (empty(spark)[0], str(tmp_path))):
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, folder)
            if k < 4:
                path = scratch_table(spark, "stage")
                out.write.parquet(path)
                kept = spark.read.parquet(path)
                assert kept.columns == columns and kept.exceptAll(docs).count() == 0
                docs = kept
            else:
                got = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in out.collect()}
                assert got == set(expected_tokens([(r.doc_id, r.text) for r in docs.collect()]))


def test_pipeline_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.quality(spark, docs, SF)
    scores = quality_classifier.classify(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scores.collect() if r.predicted}
    found = {r.doc_id for r in QUERIES["op6_decontaminate"](spark, SF).collect()}
    clean = {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, SF).collect()}
    assert clean == {r.doc_id for r in docs.select("doc_id").collect()} - found
    texts = {r.doc_id: r.text for r in docs.collect()}
    one = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    left = [texts[i] for i in one]
    assert len(set(left)) == len(left) and set(left) <= set(texts.values()) and len(one) > 0.7 * len(set(texts.values()))


def test_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
