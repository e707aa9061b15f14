"""Alignment, ball-tree search and shards against brute force."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliomill.llm import alignment, ball_tree, interleave
from foliomill.llm.tokens import BYTE_CHARACTERS

BYTE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = "item_id bigint, text string, doc_id string, score string, grp string"


@pytest.fixture
def sides():
    """Made inside tasks, which can't import this module: a function that is sent by value."""
    return lambda: alignment.byte_and_piece_sides(BYTE, P.PATTERN, PIECES)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=900, unique=True), st.lists(st.integers(0, 9000), max_size=2000, unique=True), st.integers(1, 40))
def test_gallop_finds_common_ends(a, b, run):
    a, b = np.sort(np.array(a, np.int64)), np.sort(np.array(b, np.int64))
    before, alignment.RUN = alignment.RUN, run
    try:
        in_a, in_b = alignment.common_ends(a, b)
    finally:
        alignment.RUN = before
    want = sorted(set(a.tolist()) & set(b.tolist()))
    assert a[in_a].tolist() == want and b[in_b].tolist() == want


def plain_alignment(rows):
    """From the libraries, offset by offset."""
    tokenizer = Tokenizer.from_file(BYTE)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    byte_of = {c: b for b, c in enumerate(BYTE_CHARACTERS)}
    documents, counts = [], collections.Counter()
    for doc_id, text in rows:
        ends = []
        if text:
            a = tokenizer.encode(" " + text, add_special_tokens=False)
            b = model.encode(text)
            spelled = [bytes(byte_of[c] for c in t) for t in a.tokens]
            pieces = [model.id_to_piece(i) for i in b]
            pieces = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
            if b"".join(spelled) == b"".join(pieces) == (" " + text).encode():
                for ids, parts in ((a.ids, spelled), (b, pieces)):
                    at, own = 0, {}
                    for i, part in zip(ids, parts):
                        at += len(part)
                        own[at] = i
                    ends.append(own)
        a, b = ends or ({}, {})
        links = [(a[e], b[e]) for e in a if e in b]
        counts.update(links)
        groups, held = [], ([], [])
        for e in sorted(set(a) | set(b)):
            for own, x in zip(held, (a, b)):
                own += [str(x[e])] if e in x else []
            if e in a and e in b:
                groups.append("|".join(map(",".join, held)))
                held = ([], [])
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        documents.append((doc_id, len(a), len(b), len(groups), links, digest))
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (d, n_a, n_b, n, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest)
        for d, n_a, n_b, n, links, digest in documents
    ]


def by_text(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("table", ["odd", "sample"])
def test_alignment_equals_brute_force(table, request, sides):
    docs = request.getfixturevalue(table)
    want = plain_alignment([(r.doc_id, r.text) for r in docs.collect()])
    assert by_text(tuple(r) for r in alignment.aligned_documents(docs, sides).collect()) == by_text(want)


def test_alignment_of_hard_texts(make, sides):
    texts = ["a▁b", "▁", " lead", "tab\tnew\nline", "\x00\x01", "<0x41> <s> </s> <unk>", "<|endoftext|>", "é" * 40, "  two  spaces  ", "😀 😀", ""]
    docs = make([(i, t, "s") for i, t in enumerate(texts)] + [(3, "tab\tnew\nline", "s"), (None, None, None)])
    want = plain_alignment([(r.doc_id, r.text) for r in docs.collect()])
    assert by_text(tuple(r) for r in alignment.aligned_documents(docs, sides).collect()) == by_text(want)
    assert {w[0]: w[1] for w in want if w[0] is not None}[0] == 0  # the mark itself reads as a space
    assert alignment.aligned_documents(docs.limit(0), sides).count() == 0


def terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]


def plain_search(items, docs, k):
    rows = [(d, collections.Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(rows), sum(sum(c.values()) for _, c in rows)
    df = collections.Counter(t for _, c in rows for t in c)
    out = []
    for item, text in {(i, t) for i, t in items}:
        scores = []
        for d, c in rows:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            own = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
                for t in set(terms(text))
                if t in c
            )
            if own > 0:
                scores.append((-own, d is None, d or 0, d))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("parts", "group"), [(1, 512), (28, 2)])
@pytest.mark.parametrize("table", ["odd", "sample"])
def test_ball_trees_equal_brute_force(spark, table, parts, group, request, monkeypatch):
    if table == "sample":
        docs = request.getfixturevalue(table)
        items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(12).collect()]
        items.append((99, "one"))
    else:
        docs = request.getfixturevalue(table)
        items = [(1, "word0x0 Word1X1 tail x"), (1, "word0x0 Word1X1 tail x"), (1, "line ONE"), (2, None), (3, ""), (None, "id here, no!"), (4, "é ﬁ 漢字 zz")]
    frame = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in items], ITEMS)
    monkeypatch.setattr(ball_tree, "GROUP_ITEMS", group)
    found = ball_tree.search(docs.repartition(parts), frame, 5)
    got = sorted([tuple(r) for r in found.collect()], key=repr)
    assert got == plain_search(items, [(r.doc_id, r.text) for r in docs.collect()], 5)


def test_ball_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    width, rows = 60, 700
    weights = rng.integers(0, 9000, width)
    weights[3] = 0
    lists = []
    for i in range(rows):
        centre = (i % 7) * 8
        lists.append(np.unique(np.concatenate([rng.integers(centre, centre + 9, 5), rng.integers(0, width, 1)])))
    first = np.cumsum([0, *map(len, lists)])
    column = np.concatenate(lists)
    impact = rng.integers(1, 900_000, len(column))
    tree = ball_tree.Searcher.build(list(range(rows)), first, column, impact, weights)
    dense = np.zeros((rows, width), np.int64)
    dense[np.repeat(np.arange(rows), np.diff(first)), column] = impact
    opened, leaf = [], tree.leaf
    tree.leaf = lambda node, columns: opened.append(node) or leaf(node, columns)
    for _ in range(60):
        columns = np.unique(rng.integers(0, 9, 5) + rng.integers(0, 7) * 8) % width
        columns = np.unique(columns)
        scores = dense[:, columns] @ weights[columns]
        bounds = tree.bounds(columns)
        for node in range(len(tree.radius)):
            ids = tree.ids[tree.start[node] : tree.end[node]]
            assert scores[ids].max() <= bounds[node]
        want = sorted(((int(s), i) for i, s in enumerate(scores) if s > 0), key=lambda f: (-f[0], f[1]))[:10]
        assert tree.search(columns, 10, 0) == want
        assert tree.search(columns, 10, want[-1][0]) == want  # a needed score that is met exactly
    leaves = sum(1 for x in tree.left if x < 0)
    assert len(opened) < 0.6 * 120 * leaves


def test_ball_trees_of_empty_tables(spark, odd):
    items = spark.createDataFrame([(1, "one", "", "", "")], ITEMS)
    assert ball_tree.search(odd.limit(0), items).count() == 0
    assert ball_tree.search(odd, items.limit(0)).count() == 0
    assert ball_tree.search(odd, items.selectExpr("item_id", "'.. ,' AS text")).count() == 0


def checked_shards(rows, found, shards):
    """Counts, slots and mixture of a placement of (doc_id, text, source)."""
    want = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows), key=repr)
    assert sorted([(r.doc_id, r.size, r.text_crc32) for r in found], key=repr) == want
    assert {(r.law, r.grown_shard) for r in found} <= {("rows", None)}
    by_shard = collections.defaultdict(list)
    for r in found:
        by_shard[r.shard].append(r.slot)
    sizes = [len(by_shard[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(by_shard) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())


@pytest.mark.parametrize("slice_rows", [50_000, 37])
def test_shards_have_the_mixture(spark, make, slice_rows):
    rng = np.random.default_rng(5)
    rows = [(i, f"text {i % 40}", "hot" if i % 3 == 0 else f"s{rng.integers(0, 5)}") for i in range(900)]
    rows += [(5000 + i, "lone", f"one-{i}") for i in range(64)]
    rows += [(7, "same", None)] * 100 + [(None, None, "s9")] * 20
    docs = make(rows)
    found = interleave.assign_shards(docs, slice_rows=slice_rows).collect()
    checked_shards(rows, found, 8)
    source = {i: s for i, _, s in rows[:964] if i != 7}
    mixture = collections.Counter((source[r.doc_id], r.shard) for r in found if r.doc_id in source and source[r.doc_id] in {f"s{k}" for k in range(5)} | {"hot"})
    total = collections.Counter(source.values())
    for s in ["hot", *(f"s{k}" for k in range(5))]:
        for shard in range(8):
            assert abs(mixture[s, shard] - total[s] / 8) <= 4
    lone = collections.Counter(r.shard for r in found if (r.doc_id or 0) >= 5000)
    assert max(lone.values()) <= 20
    again = interleave.assign_shards(docs.repartition(5), slice_rows=61).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))  # whatever the partitions and slices


def test_shards_of_odd_and_small_tables(odd, make):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    checked_shards(rows, interleave.assign_shards(odd).collect(), 8)
    few = [(1, "a", "x"), (2, None, None), (2, None, None)]
    checked_shards(few, interleave.assign_shards(make(few)).collect(), 8)
    assert interleave.assign_shards(odd.limit(0)).count() == 0


def test_shards_with_many_slices_equal_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    result = con.execute(interleave.SQL)
    names = [d[0] for d in result.description]
    want = sorted(tuple(dict(zip(names, r))[c] for c in ("doc_id", "shard", "slot")) for r in result.fetchall())
    got = interleave.assign_shards(spark.read.parquet(path), slice_rows=60)
    assert sorted((r.doc_id, r.shard, r.slot) for r in got.collect()) == want
