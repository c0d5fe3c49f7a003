"""Spelling variants, the prefix trie of conversations and the main text of pages against plain versions."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pixelweave.llm import main_text, prefix_trie, spelling

QUERIES = __spark_entry__.queries()

# ------------------------------------------------------------------ 11: spelling variants


def plain_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    near = {w: [v for v in n if v != w and one_edit(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n.get(form[w]), root)
    return out


def told(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


@pytest.mark.parametrize("symbols", [2, 8])
def test_variants_equal_brute_force(spark, symbols):
    rng = random.Random(5)
    words = {"".join(rng.choice("abÀÿ") for _ in range(rng.randint(5, 9))) for _ in range(250)} | {"x" * 70, "x" * 71, "x" * 40 + "y" + "x" * 30, "x" * 200, "x" * 201}
    n = {w: rng.choice([3, 3, 4, 6, 9, 20, 20, 50]) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert told(spelling.spelling_variants(df, symbols=symbols)) == plain_variants(n)


def test_words_of_any_table(spark):
    rng = random.Random(6)
    base = ["straße", "Strasse", "strasse", "ÀÉÎÕÜ", "naïveté", "letter", "latter", "later", "xlatter", "abcd", "École"]
    texts = [" ".join(rng.choice(base) + rng.choice(["", ".", "1", "\n", "-"]) for _ in range(60)) for _ in range(30)]
    rows = [*enumerate(texts), (None, texts[0]), (5, None), (6, ""), (7, texts[7]), (7, texts[7]), (8, "lonelyword"), (9, "q" * 3_000_000 + " " + "letter " * 400_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("word", F.lit("x"))
    assert told(spelling.spelling_variants(spelling.vocabulary(docs))) == plain_variants(plain_words(rows))
    assert spelling.spelling_variants(spelling.vocabulary(docs.where("false"))).count() == 0


def test_stretches_end_between_runs(monkeypatch):
    text = "ab cde fghij é" * 9 + "xyz" * 30
    for size in (1, 2, 7, 1000):
        monkeypatch.setattr(spelling, "_STRETCH", size)
        assert sum(spelling.runs_of(text.encode()), Counter()) == Counter(re.findall("[a-zÀ-ÿ]+", text))


def test_keys_are_one_for_one():
    words = np.array([[a, b, c] for a in range(1, 9) for b in range(1, 9) for c in range(1, 9)], np.uint64)
    assert len(set(spelling.keys_of(words).tolist())) == 512
    found = defaultdict(set)
    for rows, keys in spelling.neighbourhood(words, 8):
        for r, k in zip(rows.tolist(), keys.tolist(), strict=True):
            found[r].add(k)
    assert {len(v) for v in found.values()} <= set(range(40, 1 + 3 + 3 * 7 + 4 * 8 + 1))
    same = {int(spelling.keys_of(np.array([w], np.uint64))[0]) for w in ([1, 2], [1, 3], [2, 3], [1, 2, 3], [8, 2, 3], [1, 2, 3, 4], [4, 1, 2, 3])}
    assert same <= found[0 * 64 + 1 * 8 + 2]


# ------------------------------------------------------------------ 12: prefix trie


def plain_trie(seqs):
    members = defaultdict(list)
    for c, turns in seqs:
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, len(turns)))
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (p[-1][1] if p else 0)
    for p, m in members.items():
        ends = ",".join(str(c) for c, d in sorted(m) if d == len(p))
        parent = min(members[p[:-1]])[0] if p else None
        out.append((min(m)[0], len(p), parent, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def as_frame(spark, seqs):
    rows = [(c, [(hashlib.sha256(repr(t).encode()).hexdigest()[:32], t[1]) for t in turns]) for c, turns in seqs]
    return spark.createDataFrame(rows, "conv_id long, turns array<struct<token: string, chars: int>>")


def nodes(df):
    return sorted(str(tuple(r[c] for c in prefix_trie.RESULT)) for r in df.collect())


@pytest.mark.parametrize("per_block,least_blocks", [(20_000, 1), (3, 1), (1, 40), (10, 7)])
@pytest.mark.parametrize("kind", ["bushy", "copies", "deep"])
def test_trie_equals_brute_force(spark, kind, per_block, least_blocks):
    rng = random.Random(3)
    turn = lambda k: (f"t{k}", k * 3)
    if kind == "bushy":
        seqs = [(c, [turn(rng.randint(0, 1)) for _ in range(rng.randint(0, 5))]) for c in rng.sample(range(-50, 500), 90)]
    elif kind == "copies":
        seqs = [(c, [turn(1), turn(2), turn(3)][: rng.choice([3, 3, 3, 2, 0])]) for c in range(80)] + [(80 + c, [turn(1), turn(c)]) for c in range(9)]
    else:
        seqs = [(c, [turn(1)] * (c % 30) + [turn(2)] * (c % 3)) for c in range(70)]
    assert nodes(prefix_trie.prefix_trie(as_frame(spark, seqs), per_block, least_blocks)) == plain_trie(seqs)


def test_conversations_of_any_kind(spark):
    """Null turns, roles, texts and ids, ties, repeated rows, clashing columns, one very long conversation, an empty table."""
    rows = [(1, 2, "user", "b"), (1, None, "user", "a"), (1, 3, None, None), (1, 3, None, None), (2, 0, "", ""), (100, 0, "user", "x" * 100_000), (101, 1, "a", "b"), (101, 1, "b", "a"), (None, 1, "user", "lost"), (-7, 1, "user", "n")]
    rows += [(3, i, "user", "same") for i in range(3000)] + [(4, i, "user", "same") for i in range(2999)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("token", F.lit(1)).withColumn("chars", F.lit(2))
    seqs = prefix_trie.sequences(chats)
    held = [(r.conv_id, [(t.token, t.chars) for t in r.turns]) for r in seqs.collect()]
    sizes = {c: [t[1] for t in turns] for c, turns in held}
    assert sizes[1] == [1, 1, 0, 0] and len(sizes[3]) == 3000 and sizes[100] == [100_000] and len(sizes) == 7
    found = prefix_trie.prefix_trie(seqs, 2, 1).collect()
    members = defaultdict(set)
    for c, turns in held:
        for d in range(len(turns) + 1):
            members[(d, hashlib.sha256("".join(t[0] for t in turns[:d]).encode()).digest())].add(c)
    assert sorted((r.depth, r.conv_id, r.n_convs) for r in found) == sorted((d, min(m), len(m)) for (d, _), m in members.items())
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(chats.where("false")))).count() == 0


def test_sparse_table():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 64):
        values = rng.integers(0, 4, n)
        table = prefix_trie.Least(values)
        for at in range(n + 1):
            for bound in range(5):
                right, left = at, at
                while right < n and values[right] >= bound:
                    right += 1
                while left > 0 and values[left - 1] >= bound:
                    left -= 1
                assert table.right(np.array([at]), np.array([bound]))[0] == right and table.left(np.array([at]), np.array([bound]))[0] == left
            for end in range(at + 1, n + 1):
                assert table.least(np.array([at]), np.array([end]))[0] == values[at:end].min()


# ------------------------------------------------------------------ 13: main text

ARTICLE = "The quick brown fox jumps over the lazy dog and then it goes on to say a good deal more about it in one long sentence."
PAGES = {
    "marks": (f"<header><a href=/>Site</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><main><h1>Head</h1><p>{ARTICLE}<p>No.</main><footer>&copy; me</footer>", f"Head {ARTICLE} No."),
    "names": (f"<div id=menu>One Two</div><div class='cookie-notice'><p>We use cookies on this page, a great many of them, day by day</div><div class=post><h2>Head</h2><p>{ARTICLE}</p><div class=ad>Buy now and here</div><p>End</p></div><div class=sidebar><p>{ARTICLE}</p></div><section id=comments><p>I read it all, and I liked it very much indeed, thank you</p></section>", f"Head {ARTICLE} End"),
    "none": (f"<div><a href=a>One</a> <a href=b>Two</a></div><p>{ARTICLE}</p><p>{ARTICLE}</p><div><a href=c>Three</a></div>", f"{ARTICLE} {ARTICLE}"),
    "wrapped": (f"<body class=with-sidebar><div class='sidebar-layout'><article class='post has-comments'><header class=entry-header><h1>Head</h1></header><p>{ARTICLE}</p><form><input>Mail <button>Go</button></form></article><div class=comments><article class=comment-body><p>{ARTICLE}</p></article></div></div>", f"Head {ARTICLE}"),
    "references": ("<article><p>a&amp;b &lt;c&gt; &eacute;&#233;&#xe9;&nbsp;x&hellip; &am &copy2</p></article>", "a&b <c> ééé x… &am ©2"),
    "white": ("<article>\n<p>one\t two<br>three<b>four</b>\n five</p> six <ul><li>a<li>b</ul></article>", "one two threefour five six a b"),
    "silent": ("<article><p>in<script>var a='</p><p>x';</script><style>p{}</style><!-- <p>no</p> --><template><p>t</template> it</p><p style='display: none'>no</p><p hidden>no</p></article>", "in it"),
    "ragged": ("<article><p>a < b <3 and <b>bold<p>next</i> end</div></b> on</article><footer>x", "a < b <3 and bold next end on"),
    "cut": ("<article><p>whole <a href='http://x", "whole"),
    "quotes": ("<article><p title=\"a > b\" data-x='<p>'>it's <i class=x>so</i> \"there\"</p></article>", "it's so \"there\""),
    "empty": ("", ""),
    "null": (None, ""),
    "no page": ("just a few words", "just a few words"),
    "only chrome": ("<nav><a href=x>One</a></nav><footer>two</footer>", ""),
}


@pytest.fixture(scope="module")
def tree(spark):
    return main_text.fit(main_text.training_rows(spark))


def test_main_text(spark, tree):
    rows = [(k, v[0]) for k, v in PAGES.items()]
    long = "<article>" + f"<p>{ARTICLE}</p>" * 40_000 + "</article>"
    pages = spark.createDataFrame([*rows, ("long", long), ("empty", "")], "page string, html string").withColumn("text", F.lit("x")).withColumn("__blocks", F.lit(1)).withColumn("row", F.lit(2))
    out = main_text.main_text(pages, tree=tree)
    assert sorted(out.columns) == sorted(["page", "text", "__blocks", "row"])
    found = {r["page"]: r["text"] for r in out.collect()}
    assert found.pop("long") == " ".join([ARTICLE] * 40_000)
    assert found == {k: v[1] for k, v in PAGES.items()}
    assert out.count() == len(PAGES) + 2 and main_text.main_text(pages.where("false"), tree=tree).count() == 0


def test_tree_knows_its_table(spark, tree):
    rows = main_text.training_rows(spark).withColumn("b", F.struct(*main_text.FEATURES))
    assert rows.where(main_text.decided(tree, F.col("b")) != (F.col("label") == 1.0)).count() == 0
    used = str(tree)
    assert "'region'" in used and "'linked'" in used and ("'words_before'" in used or "'words_after'" in used)


def test_given_pages(spark, data, tree):
    """The article of the given pages, read by a pattern."""

    def plain(page):
        inner = re.search("<article>(.*?)(?:</article>|$)", page or "", re.S)
        return " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", inner[1]))).split()) if inner else ""

    want = {r.page_id: plain(r.html) for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    found = QUERIES["op13_main_text"](spark, data).collect()
    assert {r.page_id: r.text for r in found} == want and all(r.n_chars == len(r.text) for r in found)


@pytest.mark.parametrize("page", ["<a b=" * 20_000, "<p title=\"" * 20_000, "<" * 100_000, "<!--" * 50_000, "<div>" * 20_000, "<p>x</b>" * 20_000, "&" * 100_000, "<x = = = " * 20_000])
def test_hostile_pages_end(page):
    assert isinstance(main_text.blocks_of(page), list)
