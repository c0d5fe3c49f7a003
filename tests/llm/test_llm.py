"""The training-data operators against brute force, round trips, SQL and held-out rows."""

import hashlib
import math
import os
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__
import corpus_pipeline
from pixelweave.llm import chat, common, components, decontaminate, langid, mixing, near_dedup, pseudonyms, quality, sharding, tokens, toxicity

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, a clashing extra column."""
    long = "the quick brown fox jumps over the lazy dog and runs away again. " * 3000
    rows = [(1, None, None, None, None), (None, "a b c", "en", "s", 5), (2, "", "en", "", 0), (3, long, "de", "s", len(long)), (3, long, "de", "s", len(long)), (4, " \t\n", "fr", None, 3), (5, "!!! ### |||", "en", "t", 11), (6, "naïve café ☕ 𝒳 words", "fr", "t", 20)]
    return frame(spark, rows).withColumn("bucket", F.lit(7)).withColumn("fp", F.lit("x")).withColumn("id", F.lit(0)).withColumn("__copies", F.lit("y")).withColumn("__q", F.lit(1)).withColumn("__words", F.lit(2)).withColumn("row", F.lit(3))


@pytest.mark.parametrize("name", sorted(n for n in SQL if re.match(r"op\d+_", n)))
def test_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(data, t)}.parquet'")
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    nulls_first = lambda r: tuple((v is not None, v) for v in r)
    mine = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=nulls_first)
    found = con.sql(SQL[name])
    at = [list(found.columns).index(c) for c in cols]
    assert mine == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=nulls_first)


# ------------------------------------------------------------------ 3: near duplicates


def brute_components(ids, fps, radius=4):
    label = {i: k for k, i in enumerate(ids)}
    for a in range(len(ids)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                old, new = label[ids[a]], label[ids[b]]
                for k in label:
                    if label[k] == old:
                        label[k] = new
    least = {}
    for i, c in label.items():
        least[c] = min(least.get(c, i), i)
    return {i: least[c] for i, c in label.items()}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op3_equals_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    found = {r.doc_id: r for r in QUERIES["op3_simhash_dedup"](spark, data).collect()}
    fps = [plain_fingerprint(d.text) for d in docs]
    assert all(int(found[d.doc_id].fingerprint, 16) == f for d, f in zip(docs, fps, strict=True))
    assert {i: r.component_id for i, r in found.items()} == brute_components([d.doc_id for d in docs], fps)


@pytest.mark.parametrize("parts,capacity", [((1, 0, 0, 0), 4), ((4,), 16), ((0, 0, 0, 0, 0), 8), ((1, 2), 4)])
def test_forest_finds_every_link(spark, parts, capacity):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 40)
    fps = {int(b) ^ int(sum(1 << int(k) for k in rng.choice(60, rng.integers(0, 6), replace=False))) for b in base for _ in range(12)}
    fps = sorted(fps)
    df = frame(spark, [(f, f) for f in fps], "node long, fp long")
    links = near_dedup.forest_links(df, near_dedup.searches_of(near_dedup.parts_of(parts)), 4, 1, capacity)
    roots = {r.node: r.root for r in components.components(links).collect()}
    assert {f: roots.get(f, f) for f in fps} == brute_components(fps, fps)


@pytest.mark.parametrize("few", [1, 1024])
@pytest.mark.parametrize("part", [near_dedup.Part(0, 16, 1), near_dedup.Part(0, 16, 0), near_dedup.Part(56, 16, 1), near_dedup.Part(0, 16, 2)])
def test_cell_links_equal_all_pairs(part, few):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (12, 2), dtype=np.uint64)
    fps = base[rng.integers(0, 12, 600)]
    for bits in range(7):  # up to seven flipped bits
        hit = rng.random(600) < 0.6
        at = rng.integers(0, 128, 600)
        fps[hit, at[hit] // 64] ^= np.uint64(1) << (at[hit] % 64).astype(np.uint64)
    values = near_dedup.part_values(fps, part)
    want = (np.bitwise_count(values[:, None] ^ values[None]) <= part.radius) & (near_dedup.distances(fps[:, None], fps[None]) <= 9)
    label = np.arange(600)
    while True:
        new = np.where(want, label[None], 600).min(axis=1)
        if (new == label).all():
            break
        label = new
    got = near_dedup.links_in_cell(fps, part, 9, few)
    # Dense groups may also use links within `total` that the part alone does not show.
    assert (got == label).all() if few == 1024 else all(got[i] == got[label[i]] for i in range(600))
    every = near_dedup.distances(fps[:, None], fps[None]) <= 9
    assert all(every[i, got == got[i]].sum() > 1 for i in range(600) if (got == got[i]).sum() > 1)


def test_dense_links_span_a_large_group():
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 1 << 63, (3000, 1), dtype=np.uint64)
    fps[:2500] = np.uint64(12345)
    fps[:2500, 0] ^= np.uint64(1) << rng.integers(0, 64, 2500, dtype=np.uint64)
    a, b = near_dedup.dense_links(fps, np.arange(3000), 4)
    label = near_dedup.connect(3000, a, b)
    assert len(a) < 20_000 and (label[:2500] == 0).all() and (label[2500:] == np.arange(2500, 3000)).all()


def test_components_of_a_chain(spark):
    edges = frame(spark, [(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
    roots = {r.node: r.root for r in components.components(edges).collect()}
    assert all(roots[i] == 0 for i in range(201)) and roots[501] == 500
    assert components.components(edges.where("false")).count() == 0


def test_near_duplicates_edge_cases(spark):
    docs = edge_docs(spark)
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == 8 and {r.component_id for r in rows if r.fp == 0} == {1}
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 5, 6]
    assert near_dedup.keep_one(docs.where("false")).count() == 0


def test_keep_one_goes_by_text_not_by_id(spark):
    word = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(5)]
    near = word[2] + " more"
    rows = [(None, word[0]), (None, word[1]), (None, word[2]), (None, near), (7, word[3]), (7, word[4]), (7, word[3]), (9, word[1].upper())]
    docs = frame(spark, rows, "doc_id long, text string").withColumn("__th", F.lit(1))
    kept = near_dedup.keep_one(docs)
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == docs.columns and len(found) == 5
    assert {(None, word[0]), (7, word[3]), (7, word[4]), (9, word[1].upper())} < set(found)
    assert ((None, word[2]) in found) != ((None, near) in found)


def jaccard_components(texts, least=0.8, radius=None):
    """Label of each text by all pairs, of those within `radius` bits if it is given."""
    words = [t.split() for t in texts]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    fps = np.array([near_dedup.fingerprint(t.encode(), 5)[0] for t in texts], dtype=np.uint64)
    index = {s: k for k, s in enumerate(sorted(set().union(*sets)))}
    hot = np.zeros((len(texts), len(index)), dtype=np.float32)
    for i, s in enumerate(sets):
        hot[i, [index[x] for x in s]] = 1
    both, n = hot @ hot.T, hot.sum(axis=1)
    edge = both >= least * (n[:, None] + n[None, :] - both)
    if radius is not None:
        edge &= np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = np.arange(len(texts))
    while True:
        new = np.where(edge, label[None, :], len(texts)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def near_copies(sizes, length=120, seed=3):
    """Groups of texts; the members differ from their group's base by few words, so pairs lie around 0.8."""
    rng, out = np.random.default_rng(seed), []
    for g, n in enumerate(sizes):
        base = [f"g{g}w{i}" for i in range(length)]
        for k in range(n):
            words = list(base)
            for at in rng.choice(length, rng.integers(1, 4), replace=False):
                words[at] = f"e{k}x{at}"
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize("sizes,capacity,most", [([2, 2, 100, 3000], near_dedup.CAPACITY, 1024), ([2, 2, 100, 200], 64, 50)])
def test_near_copies_equal_all_pairs(spark, monkeypatch, sizes, capacity, most):
    texts = near_copies(sizes)
    docs = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "MOST_TEXTS", most)
    want = jaccard_components(texts).tolist()
    found = {r.doc_id: r.component_id for r in near_dedup.similar_groups(docs, capacity=capacity).collect()}
    assert [found[i] for i in range(len(texts))] == want


def test_large_group_with_outliers_equals_all_pairs(spark, monkeypatch):
    """One group of several chunks whose parts and outliers meet through a single pair each."""
    monkeypatch.setattr(near_dedup, "MOST_TEXTS", 64)
    rng, base = np.random.default_rng(5), [f"w{i}" for i in range(200)]
    texts = []
    for k in range(300):  # from close copies to texts around the threshold
        words = list(base)
        for at in rng.choice(200, 1 + k // 60, replace=False):
            words[at] = f"e{k}x{at}"
        texts.append(" ".join(words))
    docs = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_dedup.similar_groups(docs).collect()}
    want = jaccard_components(texts)
    assert len(set(want)) > 1 and [found[i] for i in range(300)] == want.tolist()


def test_equal_fingerprints_of_different_texts(spark):
    """One phrase over and over hides the tails from SimHash; the sets tell them apart or link them."""
    phrase, texts = " ".join(f"p{i}" for i in range(9)), []
    for g in range(20):
        tail = [f"t{g}x{i}" for i in range(400)]
        texts += [f"{phrase} " * 120 + f"solo{g} " + " ".join(f"u{g}x{i}" for i in range(300)), f"{phrase} " * 120 + " ".join(tail), f"{phrase} " * 120 + " ".join([*tail[:-1], "z"])]
    docs = frame(spark, [(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    found = {int(r.doc_id): r.component_id for r in near_dedup.similar_groups(docs).collect()}
    label = jaccard_components(texts)
    assert all((found[i] == found[j]) == (label[i] == label[j]) for i in range(60) for j in range(i))
    assert near_dedup.keep_one(docs).count() == len(set(label))


@pytest.mark.parametrize("n", [10**5, 10**6, 10**8, 10**9])
def test_copies_and_cells_are_bounded(n):
    """Copies of a fingerprint with trees fitted as for n texts, on random fingerprints."""
    shape = near_dedup.forest_shape(n, 0.8, 0.97)
    fps = np.random.default_rng(7).integers(0, 1 << 64, (near_dedup.SAMPLE, shape.words), dtype=np.uint64)
    goal = lambda leaf: max(4, round(leaf * len(fps) / n))
    _, routed, copies = near_dedup.fitted(fps, near_dedup.shaped(shape), goal(n >> shape.bits))
    assert copies <= 20 and shape.total <= 16 * shape.words and shape.bits * shape.tables <= 64 * shape.words
    # fitted leaves take few bits more than even ones; a part of 16 bits leaves some ten texts a group in a cell
    assert max(np.bincount(r[1]).max() for r in routed) <= 3 * max(4, len(fps) >> shape.bits) and n >> shape.bits <= 500_000
    plain = near_dedup.fitted(fps[:, :1], near_dedup.searches_of(near_dedup.parts_of(near_dedup.PART_RADII)), goal(near_dedup.CAPACITY))[2]
    equal = near_dedup.fitted(fps[:, :1], near_dedup.equal_parts(4), goal(near_dedup.CAPACITY))[2]
    assert equal == 5 and (plain <= near_dedup.MOST_COPIES or n > 10**6)


def test_equal_parts_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "MOST_COPIES", 0)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 62, 60)
    fps = sorted({int(b) ^ int(sum(1 << int(k) for k in rng.choice(62, rng.integers(0, 6), replace=False))) for b in base for _ in range(12)})
    df = frame(spark, [(f, f) for f in fps], "node long, fp long")
    links = near_dedup.forest_links(df, near_dedup.searches_of(near_dedup.parts_of((1, 0, 0, 0))), 4, 1, 8, instead=near_dedup.equal_parts(4))
    roots = {r.node: r.root for r in components.components(links).collect()}
    assert {f: roots.get(f, f) for f in fps} == brute_components(fps, fps)


def test_forest_recall_at_sizes():
    """Pairs at the very threshold meet in a leaf and differ in one bit at most of an inner part there."""
    rng, p = np.random.default_rng(9), math.acos(1.6 / 1.8) / math.pi
    for n in (10**4, 10**6, 10**8, 10**9):
        shape = near_dedup.forest_shape(n, 0.8, 0.97)
        differ = rng.random((20_000, 64 * shape.words)) < p
        sides = {s.part for s in near_dedup.shaped(shape)}
        met = np.any([~differ[:, s.start : s.start + s.width].any(axis=1) for s in sides], axis=0)
        shown = (differ.reshape(20_000, -1, near_dedup.INNER).sum(axis=2) <= 1).any(axis=1)
        assert (met & shown & (differ.sum(axis=1) <= shape.total)).mean() >= 0.95


def test_recall_around_the_threshold(spark):
    rng, texts = np.random.default_rng(6), []
    for g in range(400):  # pairs: one word of 60 changed keeps 51 of 61 shingles: similarity 0.83
        words = [f"g{g}w{i}" for i in range(60)]
        texts.append(" ".join(words))
        words[int(rng.integers(8, 52))] = "other"
        texts.append(" ".join(words))
    docs = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_dedup.similar_groups(docs).collect()}
    assert sum(found[2 * g] == found[2 * g + 1] for g in range(400)) >= 380


# ------------------------------------------------------------------ 1: decontamination


def test_op1_spans_and_edges(spark):
    bench = frame(spark, [(1, "Alpha beta, gamma! delta epsilon zeta eta theta iota kappa lambda"), (2, "Short ITEM"), (3, None), (None, "alpha beta"), (4, "?!")], "item_id long, text string")
    text = "x ALPHA beta\tgamma-delta epsilon zeta eta theta iota kappa y short item é short items"
    docs = frame(spark, [(1, text), (2, None), (3, ""), (4, "shorts item")], "doc_id long, text string").withColumn("items", F.lit(1))
    rows = {r.doc_id: r for r in decontaminate.find_contamination(docs, bench).collect()}
    assert (rows[1].n_words, rows[1].n_hit, rows[1]["items"]) == (17, 12, ["1", "2"])
    raw = text.encode()
    assert [raw[s.start : s.end].decode() for s in rows[1].spans] == ["ALPHA beta\tgamma-delta epsilon zeta eta theta iota kappa", "short item"]
    assert all(rows[k].n_hit == 0 for k in (2, 3, 4))
    split = {r.doc_id: r for r in decontaminate.find_contamination(docs, bench, most_windows=1).collect()}
    assert {k: (r.n_words, r.n_hit, r["items"], r.spans) for k, r in split.items()} == {k: (r.n_words, r.n_hit, r["items"], r.spans) for k, r in rows.items()}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == [2, 3, 4]
    assert decontaminate.find_contamination(edge_docs(spark), bench).count() == 8
    assert decontaminate.find_contamination(docs.where("false"), bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_op1_blocks_are_bounded(spark):
    words = [f"w{i}".encode() for i in range(500)]
    pieces = list(decontaminate._pieces("x", b" ".join(words), 10, 40))
    assert set().union(*(decontaminate.windows_of(decontaminate.words_of(t)) for _, t, _ in pieces)) == decontaminate.windows_of(words)
    assert all(n <= 40 and decontaminate.Windows([(i, t)]).automaton.get_stats()["nodes_count"] <= 20 * n + 1 for i, t, n in pieces)
    bench = frame(spark, [("x", b" ".join(words).decode()), ("y", "w3 w4"), ("z", "W7")], "item_id string, text string")
    docs = frame(spark, [(k, " ".join(f"w{i}" for i in range(k, k + 12))) for k in range(0, 480, 7)], "doc_id long, text string")
    whole, cut = (sorted(map(str, decontaminate.find_contamination(docs, bench, most_windows=n).collect())) for n in (400_000, 40))
    assert whole == cut and len(whole) == 69


# ------------------------------------------------------------------ 2: chat


def test_op2_roles_are_restored_exactly(spark):
    roles = ["\ue000", "a\\nb", "a\nb", "\\", "\\\\n\n\\", "<|end|>", "[/INST]\\", "", "user"]
    df = frame(spark, [(f"t{i}", 1, None, r, f"{r} </s> <s>", 0.0) for i, r in enumerate(roles)], "tree string, node long, parent long, role string, text string, score double")
    out = chat.format_trees(df).select("tree", chat.read_turns(F.col("formatted")).alias("turns")).collect()
    assert {r.tree: (r.turns[0].role, r.turns[0].text) for r in out} == {f"t{i}": (r, f"{r} </s> <s>") for i, r in enumerate(roles)}


def test_op2_random_trees_with_ties_equal_plain_walks(spark):
    rng, rows = np.random.default_rng(9), []
    for t in range(12):
        for k in range(40):
            rows.append((t, k, int(rng.integers(0, k)) if k else None, "user" if k % 2 else "assistant", f"m{t}.{k}", float(rng.integers(0, 2))))
    parent = {(t, k): p for t, k, p, *_ in rows}
    score = {(t, k): s for t, k, *_, s in rows}
    leaves = [x for x in parent if (x[0], x[1]) not in {(t, p) for (t, _), p in parent.items()}]

    def path(t, k):
        return [*path(t, parent[t, k]), k] if parent[t, k] is not None else [k]

    want = {}
    for t in range(12):
        ranked = sorted((-sum(score[t, k] for k in path(t, leaf)), leaf) for tree, leaf in leaves if tree == t)[:3]
        want.update({(t, leaf): [f"m{t}.{k}" for k in path(t, leaf)] for _, leaf in ranked})
    out = chat.format_trees(frame(spark, rows, "tree long, node long, parent long, role string, text string, score double"), best=3)
    got = {(r.tree, r.leaf): [x.text for x in r.turns] for r in out.select("tree", "leaf", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert got == want


def test_op2_tree_and_round_trip(spark):
    hostile = "<|end|>\n<|start|>user\nhi \\ <\\|x [INST] [\\/INST] </s>"
    rows = [("t", 1, None, "user", "root", 0.0), ("t", 2, 1, "assistant", hostile, 1.0), ("t", 3, 1, "assistant", "worse", 0.5), ("t", 4, 3, "user", None, 0.1), ("t", 5, 2, "we\nird\\n", "end", None), ("u", 1, 9, "assistant", "", 2.0), (None, 1, None, None, None, None)]
    df = frame(spark, rows, "tree string, node long, parent long, role string, text string, score double")
    out = chat.format_trees(df).select("tree", "leaf", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted")
    found = {r.tree: r for r in out.collect()}
    assert found["t"].leaf == 5 and [(t.role, t.text) for t in found["t"].turns] == [("user", "root"), ("assistant", hostile), ("we\nird\\n", "end")]
    assert found["t"].loss == hostile and found["t"].formatted.count("<|end|>") == 3
    assert found["u"].loss == "" and [(t.role, t.text) for t in found[None].turns] == [("", "")]
    assert chat.format_trees(df, best=2).where("tree = 't'").count() == 2
    assert chat.format_trees(df.where("false")).count() == 0


def test_op2_long_chain_and_hostile_row(spark, data):
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t}") for t in range(70)]
    out = chat.format_trees(chat.chained(frame(spark, rows, "conv_id long, turn long, role string, text string"))).first()
    assert out.formatted.count("<|start|>") == 70 and len(out.loss_spans) == 35
    row = QUERIES["op2_format_chats"](spark, data).where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert row.n_turns == 2 and row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and row.loss_chars == len(text)


# ------------------------------------------------------------------ 4: mixing


def test_op4_targets_and_totals(spark, data):
    found = QUERIES["op4_mix_sources"](spark, data).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    sizes = {}
    for r in found:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text or "")) and r.taken in [k * r.size for k in range(4)]
        sizes[docs[r.doc_id].source] = sizes.get(docs[r.doc_id].source, 0) + r.size
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    capped = set()
    while True:
        left, w = sum(sizes.values()) - sum(3 * sizes[s] for s in capped), sum(v for s, v in weight.items() if s not in capped)
        more = {s for s in sizes if s not in capped and left * weight[s] / w > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    want = {s: 3 * sizes[s] if s in capped else left * weight[s] / w for s in sizes}
    assert all(abs(r.target - want[docs[r.doc_id].source]) < 1e-6 * r.target for r in found)
    assert abs(sum(r.taken for r in found) / sum(sizes.values()) - 1) < 0.1


def test_op4_edges(spark):
    docs = edge_docs(spark)
    out = mixing.mix(docs)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(docs.where("false")).count() == 0
    many = frame(spark, [(f"s{i:05d}", 1) for i in range(50)], "source string, source_size long")
    ranked = [r.weight for r in mixing.cyclic_weights(many).orderBy("source").collect()]
    assert ranked[:4] == [5.0, 2.0, 1.0, 5.0]
    one = mixing.targets(frame(spark, [("a", 10, 5.0), ("b", 1000, 1.0)], "source string, source_size long, weight double"))
    assert {r.source: r.target for r in one.collect()} == {"a": 30.0, "b": 980.0}


# ------------------------------------------------------------------ 5: quality


def test_op5_lines_and_edges(spark):
    prose = " ".join(f"Word{i} alpha{i} beta{i} gamma{i} delta{i}." for i in range(20))
    docs = frame(spark, [(1, prose + "\nHome | About | Contact | Login\nAll rights reserved.", "en", "s", 1), (2, "a | b | c | d\n" * 20, "en", "s", 1), (3, prose.upper().replace(" ", "!! "), "en", "s", 1)])
    rows = {r.doc_id: r["__q"] for r in quality.measures(docs).collect()}
    assert rows[1].kept and rows[1].clean_text == prose and rows[1].n_bad_lines == 2 and not rows[2].kept and not rows[3].kept
    assert rows[2].n_dup_lines == 19
    edge = {(r.doc_id, r.text is None): r["__q"] for r in quality.measures(edge_docs(spark).select("doc_id", "text")).collect()}
    assert edge[1, True].n_words == 0 and edge[1, True].base_failed and edge[3, False].n_repeat_words == edge[3, False].n_words
    assert quality.clean_documents(edge_docs(spark)).columns == edge_docs(spark).columns
    assert quality.clean_documents(edge_docs(spark).where("false")).count() == 0


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a a", "x y z", "a b c d a b c e b c d", "q " * 40 + "a b"])
def test_repeated_words(spark, text):
    words = text.split()
    win = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    want = len({i + k for i, w in enumerate(win) if win.count(w) > 1 for k in range(3)})
    got = frame(spark, [(words,)], "w array<string>").select(quality.repeated_words(F.col("w"))).first()[0]
    assert got == want


def test_op5_long_words_and_runs_take_linear_time(spark):
    n = 1_000_000
    texts = ["a" * n + "!! b.", "!" * n + "b", "." * (n // 2) + "!," * (n // 4) + "b", "a |" + " " * n + "b", "#" * n + "b.", "| " * (n // 4), "home " * (n // 4) + "x", "a " * (n // 4) + "!!"]
    began = time.time()
    rows = frame(spark, [(t,) for t in texts], "text string").repartition(8).select("text", quality.line_fails(F.col("text")).alias("bad")).collect()
    assert len(rows) == 8 and time.time() - began < 60
    measured = quality.measures(frame(spark, [(texts[0],), (texts[7],)], "text string")).select("__q.n_words", "__q.n_repeat_words").collect()
    assert sorted(map(tuple, measured)) == [(2, 0), (n // 4 + 1, n // 4)] and time.time() - began < 90


def test_op5_stock_phrases_and_clashing_columns(spark):
    prose = " ".join(f"word{i}" for i in range(80)) + "."
    docs = frame(spark, [(1, f"{prose} We use a cookie. {prose}", "en", "s", 1), (2, prose + "\nClick here to sign in.", "en", "s", 1)]).withColumn("__words", F.lit(5)).withColumn("__parts", F.lit(6))
    rows = {r.doc_id: r for r in quality.measures(docs).collect()}
    assert rows[1]["__q"].n_bad_lines == 0 and rows[2]["__q"].n_bad_lines == 1
    assert rows[1]["__words"] == 5 and rows[1]["__parts"] == 6
    assert {r.doc_id: r["__q"] for r in quality.measures(docs.withColumn("__Q", F.lit(1))).collect()} == {i: r["__q"] for i, r in rows.items()}
    named = quality.measures(docs.withColumn("__q", F.lit(1)), result_col="found").collect()
    assert {r.doc_id: (r["__q"], r.found) for r in named} == {i: (1, r["__q"]) for i, r in rows.items()}


def test_op5_is_computed_once_in_the_pipeline(spark, data):
    plan = quality.clean_documents(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") == 1


# ------------------------------------------------------------------ 6, 8: learned models


def test_op6_held_out(spark, data):
    big = data.replace("sf0.001", "sf0.1")
    found = QUERIES["op6_toxicity"](spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    caught = [r.predicted for r in found if r.toxic]
    assert sum(caught) / len(caught) > 0.6 and sum(r.predicted for r in found if not r.toxic) / len(found) < 0.01


def test_op6_edges(spark):
    docs, labels = edge_docs(spark), frame(spark, [(3, 1), (5, 0), (None, 1), (3, 0)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    assert out.count() == 8 and out.where("score between 0 and 1").count() == 8
    assert toxicity.fit(docs, labels.where("false"))[2] == 0.0


def test_op8_held_out(spark, data):
    big = data.replace("sf0.001", "sf0.01")
    found = QUERIES["op8_language"](spark, big).join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in found) / len(found) > 0.97


def test_op8_numbers_have_no_letter(spark):
    texts = ["½", "²", "Ⅷ", "٣", "12 ☕", "", None, "é", "中"]
    model = langid.fit(frame(spark, [(i, "abc def ghi " * 9, "xx", "s", 1) for i in range(5)]))
    found = {r.id: r.lang_pred for r in langid.predict(frame(spark, list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [found[i] == "und" for i in range(9)] == [True] * 7 + [False] * 2
    assert langid.predict(edge_docs(spark).where("false"), model).count() == 0


def test_op8_filter_equals_plain_sets(spark):
    """The corrected popcounts against counts in plain sets of n-grams."""
    rows = [(i, " ".join(f"{'abcdefgh'[(i * 7 + j) % 8]}{'xyz'[i % 3]}{'mnopq'[j % 5]}" for j in range(40)), "uvw"[i % 3], "s", 1) for i in range(60)]
    model = langid.fit(frame(spark, rows))
    counts = {lang: {} for lang in "uvw"}
    for _, t, lang, _, _ in rows:
        for g in langid.grams(t).tolist():
            counts[lang][g] = counts[lang].get(g, 0) + 1
    rate = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    held = {lang: {g for g, n in counts[lang].items() if n >= 2 and rate[lang][g] >= langid.LEAST_RATE * max(r.get(g, 0) for r in rate.values())} for lang in "uvw"}
    for _, t, _, _, _ in rows:
        found = langid.grams(t)
        plain = [sum(g in held[lang] for g in found.tolist()) for lang in "uvw"]
        fixed = (model.counts(found) - model.false * len(found)) / (1 - model.false)
        assert all(model.counts(found) >= plain) and np.abs(fixed - plain).max() <= 0.15 * len(found)
        assert "uvw"[int(np.argmax(plain))] == model.decide(t)[0]


def test_op6_equals_a_plain_loop():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 60, 12)) for _ in range(80)]
    labels = [int(r.min() < 3) for r in rows]
    w, bias = toxicity.train(rows, labels, bits=6, epochs=2)
    seen = np.bincount(np.concatenate(rows), minlength=64)
    z, n, zb, nb = [0.0] * 64, [0.0] * 64, 0.0, 0.0
    heavier = min(toxicity.MOST_WEIGHT, max(1.0, (80 - sum(labels)) / sum(labels)))

    def weight(i):
        return 0.0 if abs(z[i]) <= toxicity.L1 else -(z[i] - np.sign(z[i]) * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(toxicity.SEED)
    for _ in range(2):
        for k in order.permutation(80):
            at = [int(i) for i in rows[k] if seen[i] >= toxicity.LEAST_SEEN]
            ws, b = [weight(i) for i in at], -zb / ((toxicity.BETA + nb**0.5) / toxicity.ALPHA)
            g = (1 / (1 + np.exp(-(sum(ws) + b))) - labels[k]) * (heavier if labels[k] else 1.0)
            for i, x in zip(at, ws, strict=True):
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * x
                n[i] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / toxicity.ALPHA * b
            nb += g * g
    assert np.allclose(w, [weight(i) for i in range(64)]) and np.isclose(bias, -zb / ((toxicity.BETA + nb**0.5) / toxicity.ALPHA))


def test_op6_clashing_columns_and_empty_table(spark):
    docs = edge_docs(spark).withColumn("y", F.lit(1)).withColumn("known", F.lit(1)).withColumn("h", F.lit(1)).withColumn("__id", F.lit(1))
    labels = frame(spark, [(3, 1), (5, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs, model).count() == 8 and toxicity.score(docs.where("false"), model).count() == 0
    assert toxicity.fit(docs.where("false"), labels)[2] == 0.0


def test_op8_edges_and_many_languages(spark):
    docs = edge_docs(spark)
    found = {r.id: r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert found[1] == found[2] == found[4] == found[5] == "und"
    assert langid.fit(docs.where("false")).languages == []
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}zq " * 30, f"l{i:02d}", "s", 1) for i in range(70)]
    model = langid.fit(frame(spark, rows))
    assert len(model.planes) == 2 and all(model.decide(t)[0] == lang for _, t, lang, _, _ in rows)


# ------------------------------------------------------------------ 7: pseudonyms


def test_op7_round_trip_formats_and_links(spark):
    text = "card 4539578763621486, not 4539578763621487; +1 (017) 555-7713 10.0.0.1 999.1.1.1 2024-02-29 2023-02-29 31.12.1999 123-45-6789 Jo.Doe7@Mail4.example.com"
    docs = frame(spark, [(1, text), (2, "again 4539578763621486 on 2024-02-29"), (3, None), (4, ""), (5, "no digits @ all")], "doc_id long, text string").withColumn("__x", F.lit(1))
    out = pseudonyms.pseudonymise(docs, key="k")
    rows = {r.doc_id: r for r in out.collect()}
    new = rows[1].text
    assert rows[1]["__kinds"] == ["card", "phone", "ip", "date", "date", "ssn", "email"]
    assert "4539578763621487" in new and "999.1.1.1" in new and "2023-02-29" in new
    for old in ("4539578763621486", "(017) 555-7713", "10.0.0.1", "2024-02-29", "31.12.1999", "123-45-6789", "Jo.Doe7"):
        assert old not in new
    card = re.search(r"card (\d{16})", new)[1]
    assert sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(card))) % 10 == 0
    assert card in rows[2].text and re.search(r"[A-Z][a-z]\.[A-Z][a-z]{2}\d@[A-Z][a-z]{3}\d\.[a-z]{7}\.com", new)
    back = {r.doc_id: r.text for r in pseudonyms.pseudonymise(out.drop("__kinds"), key="k", back=True).collect()}
    assert back == {1: text, 2: "again 4539578763621486 on 2024-02-29", 3: None, 4: "", 5: "no digits @ all"}
    assert pseudonyms.pseudonymise(edge_docs(spark), key="k").count() == 8


def test_op7_address_without_digits(spark):
    docs = frame(spark, [(1, "write to jo.doe@mail.example.com"), (2, "7 times jo.doe@mail.example.com")], "doc_id long, text string")
    out = pseudonyms.pseudonymise(docs, key="k")
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1]["__kinds"] == rows[2]["__kinds"] == ["email"] and "jo.doe" not in rows[1].text
    assert rows[1].text.split()[-1] == rows[2].text.split()[-1]
    assert {r.doc_id: r.text for r in pseudonyms.pseudonymise(out.drop("__kinds"), key="k", back=True).collect()} == {r.doc_id: r.text for r in docs.collect()}


def test_op7_layouts_and_clashing_columns(spark):
    same = ["+1 (017) 555-7713", "(017) 555-7713", "017-555-7713", "017.555.7713", "+1-017-555-7713"]
    cards = ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "3782 822463 10005"]
    stay = ["4111 1111-1111 1111", "4111 1111 1111 1112", "000-00-0000", "666-12-3456", "900-12-3456", "1234 5678", "2024-13-01", "10 20 30 40 50 60"]
    rows = list(enumerate([*same, *cards, *stay, "+49 30 1234567", "123-45-6789"]))
    docs = frame(spark, [(i, f"so {t} it is") for i, t in rows], "doc_id long, text string").withColumn("__hits", F.lit(1)).withColumn("__told", F.lit(2)).withColumn("__kinds", F.lit(3))
    out = pseudonyms.pseudonymise(docs, key="k", kinds_col="found")
    assert out.columns == [*docs.columns, "found"] and out.select("__hits", "__told", "__kinds").distinct().collect() == [(1, 2, 3)]
    new = {r.doc_id: r for r in out.collect()}
    text = [new[i].text[3:-6] for i, _ in rows]
    assert all(list(new[i].found) == ["phone"] for i in range(5)) and all(list(new[i].found) == ["card"] for i in range(5, 9))
    assert len({re.sub(r"\D", "", t)[-10:] for t in text[:5]}) == 1 and text[0].startswith("+1 (") and text[:5] != same
    assert [re.sub("[0-9]", "9", t) for t in text[:9]] == [re.sub("[0-9]", "9", t) for t in ["+9 (", *same][1:] + cards]
    assert text[5] == text[6].replace(" ", "") == text[7].replace("-", "") != cards[0]
    assert text[9:17] == stay and all(not new[i].found for i in range(9, 17))
    assert text[17].startswith("+49 ") and text[17] != "+49 30 1234567" and text[18] != "123-45-6789"
    assert pseudonyms.pseudonymise(out.drop("found"), key="k", back=True, kinds_col="found").drop("found").exceptAll(docs).isEmpty()
    assert not pseudonyms.pseudonymise(docs.drop("__kinds"), key="other").select("text").exceptAll(out.select("text")).isEmpty()
    assert pseudonyms.pseudonymise(docs.where("false"), key="k", kinds_col="found").count() == 0
    over = pseudonyms.pseudonymise(docs, key="k")
    assert over.columns == docs.columns and {r.doc_id: r["__kinds"] for r in over.collect()} == {r.doc_id: r.found for r in out.collect()}


def test_op7_equals_a_plain_feistel(spark):
    def plain(d, key, tweak):
        n, u = len(d), len(d) // 2
        a, b = int(d[:u] or 0), int(d[u:])
        for i in range(8):
            digest = lambda x: int(hashlib.sha256(f"{key}|{tweak}{n}|{i}|{x}".encode()).hexdigest()[:14], 16)  # noqa: B023, E731
            a, b = ((a + digest(b)) % 10**u, b) if i % 2 == 0 else (a, (b + digest(a)) % 10 ** (n - u))
        return (f"{a:0{u}d}" if u else "") + f"{b:0{n - u}d}"

    values = ["7", "42", "000", "98765", "0123456789", "123456789012345678"]
    got = [r[0] for r in frame(spark, [(v,) for v in values], "d string").select(pseudonyms.permute_digits(F.col("d"), "t", "k")).collect()]
    assert got == [plain(v, "k", "t") for v in values]


def test_op7_ssn_stays_valid(spark):
    one = frame(spark, [(f"{a:03d}-{g:02d}-{s:04d}",) for a in (1, 665, 667, 899) for g in (1, 50, 99) for s in (1, 5000, 9999)], "s string")
    out = one.select("s", pseudonyms._ssn(F.col("s"), "k", False).alias("t")).withColumn("ok", pseudonyms._is_ssn(F.col("t"))).withColumn("u", pseudonyms._ssn(F.col("t"), "k", True)).collect()
    assert all(r.ok and r.u == r.s and len(r.t) == 11 for r in out) and len({r.t for r in out}) == 36


def test_op7_is_a_permutation(spark):
    three = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d")).select(pseudonyms.permute_digits(F.col("d"), "t", "k"))
    assert three.distinct().count() == 1000


def test_op7_restores_the_corpus(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    back = pseudonyms.pseudonymise(pseudonyms.pseudonymise(docs, key="k").drop("__kinds"), key="k", back=True).select("doc_id", "text")
    assert back.exceptAll(docs).isEmpty()


# ------------------------------------------------------------------ 9: tokens


def library(vocabulary):
    from tokenizers import Tokenizer, models

    fallback = [(f"<0x{i:02X}>", -1e12) for i in range(256)]
    return Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary, *fallback], 0, True))


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")
def test_op9_equals_library(spark, data):
    vocabulary = tokens.load_vocabulary()
    mine, theirs = tokens.Counter32(vocabulary), library(vocabulary)
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()] + ["", "日本語 text ☕", "  two  spaces ", "\n\n", "aaaaaaa"]
    for t in texts:
        want = len(theirs.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).tokens) if t else 0
        assert mine.text(t)[0] == want


def test_op9_ties_and_edges(spark):
    vocabulary = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0), ("ba", -2.0)]
    counter = tokens.Counter32(vocabulary)
    assert counter.segment("ab") == (-2.0, 1) and counter.segment("aba") == (-3.0, 2) and counter.segment("é")[1] == 2
    out = tokens.count_tokens(edge_docs(spark), vocabulary=vocabulary)
    assert out.count() == 8 and {r.doc_id: r.n_tokens for r in out.where("doc_id in (1, 2)").collect()} == {1: 0, 2: 0}
    assert tokens.count_tokens(edge_docs(spark).where("false"), vocabulary=vocabulary).count() == 0


# ------------------------------------------------------------------ 10: sharding


def check_shards(rows, shards=8):
    counts = [sum(r.shard == s for r in rows) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_op10_law_and_groups(spark, data):
    rows = QUERIES["op10_shard"](spark, data).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    check_shards(rows)
    homes = {}
    for r in rows:
        assert r.size == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) and r.law == "rows"
        homes.setdefault(docs[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in homes.values())


def test_op10_hot_group_and_edges(spark):
    rows = [(i, "hot", "en", "s", 3) for i in range(400)] + [(1000 + i, f"t{i // 2}", "en", "s", 3) for i in range(600)]
    out = sharding.shard_documents(frame(spark, rows)).collect()
    check_shards(out)
    hot = [sum(r.shard == s and r.doc_id < 400 for r in out) for s in range(8)]
    assert sum(sorted(hot)[-4:]) >= 380
    edge = sharding.shard_documents(edge_docs(spark)).collect()
    check_shards(edge)
    assert len(edge) == 8 and sharding.shard_documents(edge_docs(spark).where("false")).count() == 0


def test_numbered_has_no_gaps(spark):
    rows = [(g, 1 if k % 3 else k, "x") for g in ("a", "b", None) for k in range(900)]
    for within, per in (([], 50), (["g"], 50), (["g"], 4000)):
        out = common.numbered(frame(spark, rows, "g string, k long, v string"), within, ["k"], "no", per_bucket=per)
        found = {}
        for r in out.collect():
            found.setdefault(r.g if within else 0, []).append(r.no)
        assert out.columns == ["g", "k", "v", "no"] and all(sorted(v) == list(range(len(v))) for v in found.values()) and sum(map(len, found.values())) == 2700


def test_op10_cuts_fewer_links_than_a_plain_deal(spark):
    """Cut edges (pairs of equal text on two shards) against rows dealt round robin, and against none at all."""
    rows = [(i, f"t{i % 90}" if i % 3 else f"s{i}", "en", "s", 3) for i in range(1500)]
    out = sharding.shard_documents(frame(spark, rows)).collect()
    check_shards(out)
    text = {i: t for i, t, *_ in rows}

    def cut_edges(shard):
        groups = {}
        for i, s in shard.items():
            groups.setdefault(text[i], {}).setdefault(s, []).append(i)
        return sum((sum(map(len, g.values())) ** 2 - sum(len(v) ** 2 for v in g.values())) // 2 for g in groups.values())

    assert cut_edges({r.doc_id: r.shard for r in out}) <= 0.05 * cut_edges({i: i % 7 for i, *_ in rows})


# ------------------------------------------------------------------ pipeline


def test_pipeline_equals_a_plain_version(spark, data):
    """Kept ids of each stage against plain Python: SQL for the quality rules, all pairs for near duplicates, plain
    windows for the benchmark, the copies that op4's plan takes, and the law of the shards."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    first = corpus_pipeline.quality_rules(spark, docs, data).cache()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    good = {r[0]: "\n".join(r[1]) for r in con.sql(f"WITH {quality.QUALITY_CTES} SELECT doc_id, good_lines FROM quality WHERE NOT base_failed AND lost_chars <= {quality.MOST_LOST} * word_chars").fetchall()}
    texts = {r.doc_id: r.text for r in first.collect()}
    assert texts == good

    second = corpus_pipeline.near_duplicates(spark, first, data).cache()
    ids = sorted(texts)
    label = jaccard_components([texts[i].lower() for i in ids])
    assert sorted(r.doc_id for r in second.collect()) == [ids[k] for k in sorted(set(label.tolist()))]

    third = corpus_pipeline.benchmark_passages(spark, second, data).cache()
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect() for w in [words(r.text)] if w for i in range(max(1, len(w) - 9))}
    clean = []
    for r in second.collect():
        w = words(r.text)
        if not any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1)):
            clean.append(r.doc_id)
    assert sorted(r.doc_id for r in third.collect()) == sorted(clean)

    fourth = corpus_pipeline.mixed_sources(spark, third, data).cache()
    sizes = {}
    for r in third.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    plan = {r.source: r.target for r in mixing.targets(mixing.cyclic_weights(mixing.source_sizes(third, "source", common.word_count(F.col("text"))))).collect()}
    copies = {}
    for r in fourth.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    for r in third.collect():
        rate = plan[r.source] / sizes[r.source] if sizes[r.source] else 0.0
        assert copies.get(r.doc_id, 0) in (int(rate + 1e-9), int(rate + 1e-9) + (rate - int(rate + 1e-9) > 1e-8))

    last = corpus_pipeline.sharded(spark, fourth, data).collect()
    check_shards(last)
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in fourth.collect())


def test_pipeline_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = docs
    sets = []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, data).cache()
        sets.append({r[0] for r in kept.select("doc_id").collect()})
        if name != "sharded":
            assert kept.columns == docs.columns
    first, second, third, fourth, last = sets
    assert second <= first and third <= second and fourth <= third and last == fourth
    good = QUERIES["op5_quality_rules"](spark, data).where("kept")
    assert first == {r.doc_id for r in good.collect()}
    check_shards(kept.collect())
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, data)
    assert empty.count() == 0 and isinstance(empty.schema, T.StructType)


# ------------------------------------------------------------------ all: empty tables, clashing columns, text ids

CLASHING = ("id", "th", "node", "root", "a", "b", "n", "g", "v", "key", "lang_pred", "score", "shard", "slot", "place", "group", "kinds", "hit", "item", "span", "line", "__kinds", "__hits", "__told", "__parts", "__bucket", "__size", "__source")


@pytest.mark.parametrize("rows", ["none", "edges"])
def test_operators_take_any_table(spark, rows):
    """Empty tables give empty results; edge rows all come back, whatever other columns are called."""
    docs = edge_docs(spark).drop("id").withColumns({c: F.lit(1) for c in CLASHING})
    n = docs.count()
    if rows == "none":
        docs, n = docs.where("false"), 0
    items = frame(spark, [("q1", "the quick brown fox"), ("q2", None), ("q2", "")], "item_id string, text string")
    model = toxicity.fit(docs, frame(spark, [(3, 1), (5, 0)], "doc_id long, toxic int"))
    found = {
        "1": decontaminate.find_contamination(docs, items), "1, no items": decontaminate.find_contamination(docs, items.where("false")),
        "3": near_dedup.near_duplicates(docs), "4": mixing.mix(docs).select("doc_id", "text").distinct(), "5": quality.measures(docs),
        "6": toxicity.score(docs, model), "7": pseudonyms.pseudonymise(docs, key="k"), "8": langid.predict(docs, langid.fit(docs)), "9": tokens.count_tokens(docs), "10": sharding.shard_documents(docs),
    }
    counts = {k: df.count() for k, df in found.items()}
    mixed = counts.pop("4")
    assert counts == dict.fromkeys(counts, n) and (mixed > 0) == (n > 0)
    if n:
        assert set(docs.columns) <= set(found["7"].columns)


def test_pipeline_stages_take_any_table(spark, data):
    docs = edge_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for start in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, start, data)
            assert out.count() <= 3 * start.count()
            if name != "sharded":
                assert set(out.columns) == set(start.columns)
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    assert near_dedup.keep_one(named).where("doc_id = 'd3'").count() == 1
    assert sharding.shard_documents(named).select("shard", "slot").distinct().count() == 8
