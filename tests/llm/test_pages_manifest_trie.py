"""HTML extraction, Merkle manifest and prefix trie against direct computation on hostile cases."""

import hashlib
import random
import re
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import html_template, merkle, prefix_trie, ranks
from llm.queries import WORDS

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def in_duckdb(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return sorted(con.sql(sql).fetchall(), key=repr)


# ---- ranks ------------------------------------------------------------------------------

def test_ranked_in_a_hot_group(spark):
    rows = [("hot", i * 7 % 401) for i in range(400)] + [("a", 3), ("a", 3), ("b", None), ("b", 1)]
    got = ranks.ranked(spark.createDataFrame(rows, "g string, x long").repartition(7), "g", ["x"]).collect()
    for g in ("hot", "a", "b"):
        mine = sorted((r["idx"], r["x"]) for r in got if r["g"] == g)
        assert [i for i, _ in mine] == list(range(len(mine)))
        assert [x for _, x in mine] == sorted((x for k, x in rows if k == g), key=lambda x: (x is not None, x or 0))


# ---- html -------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T {n}</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/x{n}">one</a></li></ul></nav><div class="side-bar sidebar">links {n}</div>
<div class="ad">buy {n}</div><article><h1>Head &amp; {n}</h1><p>First <b>bo</b>ld   text
of {n}<br>more<p>unclosed &lt;tag&gt; {n} &eacute;<div class="notice">read the terms</div><p>Follow us everywhere</p>
<form><label>Mail</label><input></form><footer>by them</footer></article><div id="comments"><article><p>I disagree {n}</p></article></div>
<footer>&copy; {n}</footer></body></html>"""


class Plain(HTMLParser):
    """The article of the fixture by a parser of its own: a list of blocks."""

    def __init__(self, text):
        super().__init__(convert_charrefs=True)
        self.out, self.now, self.stack = [], "", []
        self.feed(text)
        self.close()
        self.flush()

    def flush(self):
        if self.now.split():
            self.out.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "div", "article", "form", "footer", "label"):
            self.flush()
        if tag == "br":
            self.now += " "
        if tag in ("article", "div", "form", "footer"):
            self.stack.append((tag, dict(attrs).get("class") or dict(attrs).get("id")))

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "div", "article", "form", "footer", "label"):
            self.flush()
        if tag in ("article", "div", "form", "footer"):
            self.stack.pop()

    def handle_data(self, data):
        names = [t for t, _ in self.stack]
        if "article" in names and not {"form", "footer"} & set(names) and not {"notice", "comments"} & {c for _, c in self.stack}:
            self.now += data


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, part string").repartition(3)


def test_article_and_template_text(spark):
    rows = [(n, f"https://user@Site.example:80/{n}", PAGE.format(n=n)) for n in range(12)]
    got = {r["page_id"]: r for r in html_template.extract(pages_of(spark, rows)).collect()}
    for n, _, page in rows:
        blocks = [b for b in Plain(page).out if b != "Follow us everywhere"]     # stands on all pages of the host
        assert got[n]["text"] == "\n".join(blocks) == f"Head & {n}\nFirst bold text of {n} more\nunclosed <tag> {n} é"
        assert got[n]["n_chars"] == len(got[n]["text"]) and got[n]["n_slots"] > 0


def test_slots_of_the_host_decide(spark):
    """No text without a template, and none from a slot beside the article of the host's other pages; a page with more in it keeps its text."""
    rows = [(n, f"http://a/{n}", f"<body><nav>n</nav><p>Posted by {n}</p><article><p>text {n}</p></article></body>") for n in range(30)]
    odd = [(50, "http://a/50", "<body><nav>n</nav><p>Posted by 50</p></body>"), (51, "http://a/51", "<body><nav>n</nav><p>long</p><p>read</p></body>"),
           (52, "http://b/52", "<body><nav>n</nav><p>Posted by 52</p></body>")]
    pages = pages_of(spark, rows + odd)
    got = {r["page_id"]: r["text"] for r in html_template.extract(pages).collect()}
    assert got == {**{n: f"text {n}" for n, _, _ in rows}, 50: "", 51: "long\nread", 52: "Posted by 52"}
    page = html_template.Page(rows[0][2])
    assert html_template._slots(page, html_template._known([])) == ("", 0)
    part = pages.where("page_id < 30").selectExpr("'a' AS part", "html")
    [found] = html_template.article_slots(part, html_template.templates(part)).collect()
    assert html_template._slots(page, html_template._known(found["template"])) == ("text 0", 1)


def test_few_pages_and_copies_keep_their_text(spark):
    same = PAGE.format(n=1)
    rows = [(1, "http://a/1", same), (1, "http://a/1", same), (2, "http://a/2", same)] + [(10 + k, "http://b/1", same.replace("T 1", f"T {k}")) for k in range(30)]
    got = html_template.extract(pages_of(spark, rows)).collect()
    assert len(got) == len(rows) and {r["text"] for r in got} == {"Head & 1\nFirst bold text of 1 more\nunclosed <tag> 1 é\nFollow us everywhere"}


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no host", "plain &amp; text\n\nof one  block"), (4, "http://h", "<div>a</div><nav>n</nav>b &am"),
            (5, "http://h", "<article>kept <scr"), (6, "http://h", "<script>never closed"), (7, "http://h", "a < b <3 <!-- c -- d"),
            (8, "http://h", "<aside>x<article>y</article>"), (None, "http://h", "<p title='>'>q</p>"), (9, "http://h", "<main>" + "<p>w" * 30_000)]
    got = {r["page_id"]: r["text"] for r in html_template.extract(pages_of(spark, rows)).collect()}
    assert got == {1: "", 2: "", 3: "plain & text of one block", 4: "a\nb &am", 5: "kept", 6: "", 7: "a < b <3", 8: "y", None: "q", 9: "\n".join(["w"] * 30_000)}
    assert html_template.extract(pages_of(spark, rows).limit(0)).count() == 0


def test_order_and_nesting():
    assert html_template.out_of_order([0, 1, 5, 2, 3]) == {5}
    assert html_template.out_of_order([]) == set()
    items = [(t, 0, None) for t in (1, 2, 7, 8, 7, 8, 3, 4)]
    template = {1: (10, 0), 2: (10, 1), 3: (10, 2), 4: (10, 3), 7: (20, 0), 8: (20, 1)}
    said = html_template.findings(items, template, {10: 4, 20: 2})
    assert {(c, t) for c, t, s in said if s is None} == set()
    assert len({s for c, _, s in said if c == 20}) == 1
    spread = [(t, 0, None) for t in (1, 7, 8, 2, 3, 7, 8, 4)]
    assert [s for c, t, s in html_template.findings(spread, template, {10: 4, 20: 2}) if c == 20] == [0]
    assert (20, None, None) in html_template.findings([(t, 0, None) for t in (1, 2, 7, 7, 8, 8, 3, 4)], template, {10: 4, 20: 2})


def test_article_on_the_test_table(spark):
    """Every page of the table against a cut between its article tags."""
    con = duckdb.connect()
    pages = con.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    import html as references
    got = {r["page_id"]: r["text"] for r in html_template.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    for page_id, page in pages:
        inside = re.search("<article>(.*?)</article>", page, re.S)[1]
        blocks = [" ".join(references.unescape(re.sub("</?b>|<br>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
        assert got[page_id] == "\n".join(b for b in blocks if b)


# ---- merkle -----------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.integers(1, 600), st.integers(0, 2))
def test_addresses_fill_the_block(n, extra):
    height = merkle.height_of(n) + extra
    places = np.concatenate([merkle.addresses(n, height, depth, np.arange(-(-n // 16 ** (height - depth)))) for depth in range(height + 1)])
    assert sorted(places.tolist()) == list(range(merkle.tree_size(n, height)))


def test_layout_keeps_subtrees_together():
    """A full block of three levels: sixteen tops first, then each lower subtree in one stretch."""
    leaves = merkle.addresses(4096, 3, 3, np.arange(4096)).reshape(256, 16)
    parents = merkle.addresses(4096, 3, 2, np.arange(256))
    assert (leaves == parents[:, None] + 1 + np.arange(16)).all() and sorted(parents.tolist()) == list(range(17, 17 + 256 * 17, 17))


def brute_manifest(rows):
    def digest(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([digest(*levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            k = i // 16
            yield "".join(level[16 * k:i]), "".join(level[i + 1:16 * (k + 1)])
            i = k

    trees = {}
    for r in rows:
        i, text, lang, source, n = r
        leaf = digest(*map(field, (i, source, lang, n, text)))
        low = None if text is None else "".join(c.lower() if c.isascii() else c for c in text)
        changed = digest(*map(field, (i, source, lang, n, low))) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else leaf
        trees.setdefault(source, []).append((i is not None, i or 0, leaf, i, changed))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        trees[s].sort(key=lambda x: x[:3])
    levels = {s: climb([x[2] for x in trees[s]]) for s in names}
    top = climb([levels[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for j, (_, _, leaf, i, changed) in enumerate(trees[s]):
            steps = [*path(levels[s], j), *path(top, k)]
            folded = changed
            for a, b in steps:
                folded = digest(a, folded, b)
            root = top[-1][0]
            yield i, leaf, levels[s][-1][0], root, digest(*(a + b for a, b in steps)), folded, folded == root


DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, idx long, leaf string"


def doc_rows():
    rng = random.Random(3)
    rows = [(i, f"Text {i} É", "en", "hot", i) for i in range(300)] + [(i, None, None, f"s{i}", None) for i in range(400, 440)]
    rows += [(7, "again", "en", "hot", 1), (7, "again", "en", "hot", 1), (None, "no id", "de", "hot", 2), (None, None, None, None, None), (5, "", "", "", 0),
             (6, "A" * 200_000, "é", "ß", 1), (8, "x", "en", None, 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("levels", [3, 1])
def test_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)      # 1: blocks of sixteen leaves, several rounds
    monkeypatch.setattr(merkle, "SPAN", 16 ** levels)
    rows = doc_rows()
    docs = spark.createDataFrame([(*r, "a", 1, "b") for r in rows], DOCS).repartition(5)
    got = rows_of(merkle.manifest(docs))
    assert got == sorted(brute_manifest(rows), key=repr)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)
    assert merkle.manifest(docs.limit(0)).collect() == []


# ---- trie -------------------------------------------------------------------------------

@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=40), st.randoms())
def test_extents(values, rng):
    table = prefix_trie.minima(np.array(values, np.int64))
    at = np.array([rng.randrange(-1, len(values)) for _ in range(20)])
    d = np.array([rng.randrange(0, 8) for _ in range(20)])
    right = prefix_trie.extent_right(table, at, d)
    left = prefix_trie.extent_left(table, at, d)
    for a, x, r, k in zip(at.tolist(), d.tolist(), right.tolist(), left.tolist()):
        assert r == next((j for j in range(a + 1, len(values)) if values[j] < x), len(values))
        assert k == next((j for j in range(a, -1, -1) if values[j] < x), -1)


def test_beyond_a_block(spark, monkeypatch):
    """Extents and totals over several levels of blocks, to both sides."""
    monkeypatch.setattr(prefix_trie, "SPAN", 3)
    rng = random.Random(1)
    n = 70
    low, w = [-1] + [rng.choice([0, 0, 1, 1, 2, 3, 5]) for _ in range(n - 1)], [rng.randrange(5) for _ in range(n)]
    levels = prefix_trie._levels(prefix_trie._level(spark.createDataFrame([(i, low[i], w[i]) for i in range(n)], "idx long, low long, p0 long"), 1), ("sum",))
    assert len(levels) == 4
    asked = [(b, d) for b in range(-(-n // 3)) for d in range(5)]
    for left in (False, True):
        got = {(r.block, r.d): (r.found, r.p0) for r in prefix_trie.beyond(levels, ("sum",), spark.createDataFrame(asked, "block long, d long"), left).collect()}
        for b, d in asked:
            after = min(n, 3 * b + 3)
            if left:
                assert got[b, d][0] == next((j for j in range(3 * b - 1, -1, -1) if low[j] < d), None)
            else:
                stop = next((j for j in range(after, n) if low[j] < d), None)
                assert got[b, d] == (stop, sum(w[after:stop]))


def brute_trie(sequences):
    nodes, out = {}, []
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(conv)
    kids = {p: [q for q in nodes if len(q) == len(p) + 1 and q[:len(p)] == p] for p in nodes}

    def below(p):
        yield p
        for q in kids[p]:
            yield from below(q)

    for p, members in nodes.items():
        sub = list(below(p))
        ends = ",".join(str(c) for c in sorted(c for c in members if len(sequences[c]) == len(p)))
        saved = sum((len(nodes[q]) - 1) * len(re.findall("[^\x20\x09-\x0D]+", q[-1][1])) for q in sub if q)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids[p]), sum(not kids[q] for q in sub), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations():
    rng = random.Random(5)
    rows = []
    for c in [*range(1, 90), 100, 120, -20, -7]:
        for t in range(rng.randrange(1, 6)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(("hello there", "a", "", "b c  d\n"))))
    rows += [(200, t, "user", "same") for t in range(60)] + [(201 + k, t, "user", "same") for k in range(25) for t in range(3)]
    rows += [(300, None, "user", "first"), (300, 1, None, None), (301, 2, "", "x"), (None, 1, "user", "lost"), (302, 1, "a", "bc"), (303, 1, "ab", "c"),
             (304, 1, "user", "tie"), (304, 1, "user", "tie"), (305, 0, "user", "one turn")]
    return rows


def rebuild(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append((t is not None, t or 0, key, (role, text)))
    turns = {c: [x[3] for x in sorted(v)] for c, v in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


@pytest.mark.parametrize("span", [1024, 3])
def test_trie(spark, monkeypatch, span):
    monkeypatch.setattr(prefix_trie, "SPAN", span)       # 3: members spread over blocks of several levels
    monkeypatch.setattr(prefix_trie, "IDS", 4)
    rows = conversations()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, block long, path string").repartition(4)
    got = rows_of(prefix_trie.prefix_trie(prefix_trie.rebuilt(table)))
    assert got == brute_trie(rebuild(rows))
    assert any(len(s) == 0 for s in rebuild(rows).values())    # a rebuilt conversation without turns
    if span == 1024:
        assert prefix_trie.prefix_trie(prefix_trie.rebuilt(table.limit(0))).collect() == []
        assert got == in_duckdb(prefix_trie.oracle_sql(WORDS), conversations=table.toPandas().astype({"turn": "Int64", "conv_id": "Int64"}))
