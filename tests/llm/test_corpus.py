import collections
import math
import os
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from foliomill.llm import gru_lm, host_rules, minhash, repeats, simhash
from foliomill.llm.components import components
from foliomill.session import checkpoint_root


def words(text):
    return (text or "").encode().split()


def lower(text):
    return [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words(text)]


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def fingerprint(text, width):
    w = lower(text)
    shingles = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 300)] + [(7, 7), (500, 501), (501, 500), (-3, 500)]
    df = spark.createDataFrame([*links, (None, 4)], "a bigint, b bigint")
    want = roots({x for p in links for x in p}, links)
    want = {k: v for k, v in want.items() if sum(v == x for x in want.values()) > 1}
    assert {r.node: r.component for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


@pytest.mark.parametrize("table", ["odd", "sample"])
def test_simhash_equals_brute_force(table, request):
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, fingerprint(r.text, 3)) for r in docs.collect()]
    fps = sorted({f for _, f in rows})
    group = roots(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])
    least = {}
    for d, f in rows:
        if d is not None:
            least[group[f]] = min(d, least.get(group[f], d))
    want = sorted((str(d), format(f, "016x"), str(least.get(group[f]))) for d, f in rows)
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def test_hot_bucket_is_split_and_stays_exact(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    fps = {centre}
    while len(fps) < 300:
        fps.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)))
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    monkeypatch.setattr(simhash, "BUCKET", 5)
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp bigint")).collect()
    mask = (1 << 64) - 1
    want = roots(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 3])
    assert roots(signed, [(r.a, r.b) for r in links]) == want


def brute_repeats(texts, window):
    seen = collections.Counter()
    split = [words(t) for t in texts]
    for w in split:
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("window", [1, 2, 5, 35])
@pytest.mark.parametrize("table", ["odd", "sample", "random"])
def test_repeats_equal_brute_force(table, window, request, make):
    if table == "random":
        rng = np.random.default_rng(window)
        docs = make([(i, " ".join(map(str, rng.integers(0, 3, rng.integers(0, 90)))), "a") for i in range(30)])
    else:
        docs = request.getfixturevalue(table)
    rows = docs.collect()
    want = sorted((str(r.doc_id), *w) for r, w in zip(rows, brute_repeats([r.text for r in rows], window), strict=True))
    kept = repeats.remove_repeats(docs, window)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, " ".join(x.decode() for x in words(r.kept))) for r in kept.collect())
    assert got == want
    untouched = {r.text for r in rows}
    assert all(r.kept in untouched for r in kept.collect() if not r.n_removed)


def test_repeats_of_nothing(make):
    assert repeats.digests(repeats.remove_repeats(make([], extra=False))).count() == 0
    with pytest.raises(ValueError, match="kept"):
        repeats.remove_repeats(make([]), columns=("doc_id", "kept"))


def test_host_rules_on_odd_rows(odd, make):
    got = {(r.doc_id, r.n_words): r for r in host_rules.judge(odd).collect()}
    assert host_rules.judge(odd).count() == odd.count()
    assert got[3, 0].base_failed and not got[3, 0].kept
    assert got[8, 120].n_symbols == 240 and not got[8, 120].kept
    assert got[6, 60000].n_repeat_words == 60000 and got[6, 60000].base_failed
    assert got[11, 6].n_dup_lines == 1
    assert host_rules.judge(make([], extra=False)).count() == 0
    passing = {d for (d, _), r in got.items() if not (r.base_failed or r.symbols_failed or (r.host_rejected and 10 * r.n_dup_lines > 3 * r.n_lines))}
    assert {r.doc_id for r in host_rules.keep_documents(odd).collect()} == passing
    assert host_rules.keep_documents(odd).columns == odd.columns


def test_a_bad_host_falls_and_a_small_one_is_shrunk(make):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{good} d{i}", f"h{i % 8}") for i in range(400)]
    rows += [(1000 + i, "short", "bad") for i in range(95)] + [(1100 + i, f"{good} b{i}", "bad") for i in range(5)]
    rows += [(2000, "short", "small"), (2001, f"{good} s", "small")]
    kept = {r.doc_id: r.kept for r in host_rules.judge(make(rows)).collect()}
    assert not any(kept[1100 + i] for i in range(5))
    assert kept[2001] and not kept[2000] and all(kept[i] for i in range(400))


def test_clean_documents_of_a_rejected_host_stay(make):
    good = " ".join(f"w{i}" for i in range(60))
    again = "\n".join([good, "same", "same", "same"])
    rows = [(i, f"{good} d{i}", f"h{i % 8}") for i in range(400)] + [(500, again, "h1")]
    rows += [(1000 + i, "short", "bad") for i in range(95)] + [(1100 + i, f"{good} b{i}", "bad") for i in range(5)] + [(1200, again, "bad")]
    docs = make(rows)
    left = host_rules.keep_documents(docs)
    assert sorted(r.doc_id for r in left.collect()) == [*range(400), 500, *range(1100, 1105)]
    assert left.columns == docs.columns


def test_repeated_words_match_plain_counting():
    rng = np.random.default_rng(0)
    for n in range(60):
        w = [b"%d" % x for x in rng.integers(0, 4, n)]
        windows = [tuple(w[i : i + 3]) for i in range(n - 2)]
        again = {p for i, x in enumerate(windows) if windows.count(x) > 1 for p in (i, i + 1, i + 2)}
        assert host_rules.repeated_words(w) == len(again)


@pytest.mark.parametrize("table", ["odd", "sample"])
def test_language_model_counts_equal_brute_force(table, request):
    docs = request.getfixturevalue(table)
    rows = docs.collect()
    held = [zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 7 == 2 for r in rows]
    counts = collections.Counter()
    for r, h in zip(rows, held, strict=True):
        if not h:
            counts.update([*lower(r.text), None])
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for r, h in zip(rows, held, strict=True):
        tokens = [*lower(r.text), None]
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens)
        want.append((str(r.doc_id), len(tokens), h, sum(counts[t] > 0 for t in tokens), total, base))
    scored = gru_lm.score(docs, share=2).collect()
    got = sorted((str(r.doc_id), r.n_tokens, r.held_out, r.n_known, r.train_tokens, r.base_score) for r in scored)
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)
    if table == "sample":
        out = [r for r in scored if r.held_out]
        assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_language_model_of_nothing(make):
    assert gru_lm.score(make([], extra=False)).count() == 0


def small_model():
    vocabulary = gru_lm.Vocabulary(2000, 300, 10, np.arange(60, dtype=np.uint64) * 7919, np.arange(60, 0, -1))
    rng = np.random.default_rng(0)
    return vocabulary, [(w + rng.normal(0, 0.1, w.shape)).astype(np.float32) for w in vocabulary.start()]


def test_outputs_are_a_distribution_and_start_at_the_counts():
    vocabulary, weights = small_model()
    every = np.arange(len(vocabulary.p))
    h = np.random.default_rng(1).normal(0, 1, (1, gru_lm.STATE)).astype(np.float32)
    assert np.exp(gru_lm.log_probabilities(weights, h.repeat(len(every), 0), every)).sum() == pytest.approx(1, abs=1e-4)
    start = np.exp(gru_lm.log_probabilities(vocabulary.start(), h.repeat(62, 0), every[:62]))
    assert start == pytest.approx(vocabulary.p[:62], rel=1e-3)


def test_gradients_match_differences():
    _, weights = small_model()
    rng = np.random.default_rng(2)
    tokens, h = rng.integers(0, 62, (9, 5)), rng.normal(0, 0.3, (5, gru_lm.STATE)).astype(np.float32)
    _, grads, _ = gru_lm.gradients(weights, tokens, h)
    for i, g in enumerate(grads):
        direction = (g / np.sqrt((g * g).sum())).astype(np.float32)
        step, losses = 0.02, []
        for sign in (1, -1):
            moved = [w + sign * step * direction if k == i else w for k, w in enumerate(weights)]
            losses.append(gru_lm.gradients(moved, tokens, h)[0])
        assert (losses[0] - losses[1]) / (2 * step) == pytest.approx(float((g * direction).sum()), rel=0.02)


def test_state_is_carried_across_windows():
    _, weights = small_model()
    rng = np.random.default_rng(4)
    documents = [rng.integers(2, 62, n).astype(np.uint16) for n in (1, 31, 32, 33, 100, 0)]
    got = gru_lm.document_scores(weights, documents, lanes=4)
    emb, wx, b, u = weights[:4]
    for document, found in zip(documents, got, strict=True):
        h, total, before = np.zeros((1, gru_lm.STATE), np.float32), 0.0, gru_lm.END
        for token in document.tolist():
            h = gru_lm._steps(emb @ wx + b, u, np.array([[before]]), h)[0]
            total += float(gru_lm.log_probabilities(weights, h, np.array([token]))[0])
            before = token
        assert found == pytest.approx(total, rel=1e-4, abs=1e-5)


def test_pipeline_stages(spark, odd, sample):
    for docs in (sample, odd):
        stages = dict(corpus_pipeline.STAGES)
        judged = stages["quality rules"](spark, docs, "")
        one = stages["simhash near-dedup"](spark, judged, "")
        cut = stages["substring dedup"](spark, one, "")
        assert judged.columns == one.columns == cut.columns == docs.columns
        want = sorted((str(r.doc_id), k) for r, (_, _, k) in zip(one.collect(), brute_repeats([r.text for r in one.collect()], 35), strict=True))
        assert sorted((str(r.doc_id), " ".join(x.decode() for x in words(r.text))) for r in cut.collect()) == want
        assert all(r.n_chars == len(r.text or "") for r in cut.collect() if "n_chars" in r)
        pieces = stages["packing"](spark, cut, "")
        assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in cut.collect()}


def test_language_model_trains_on_every_segment_by_default(spark, sample, monkeypatch):
    trained = []
    train = gru_lm.train
    monkeypatch.setattr(gru_lm, "train", lambda segments, *a: trained.append(segments.collect()) or train(segments, *a))
    scored = [r for r in gru_lm.score(sample).collect() if r.held_out]
    assert sum(r.score for r in scored) > sum(r.base_score for r in scored)
    sizes = [len(lower(r.text)) for r in sample.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    assert len(trained[0]) == sum(n // gru_lm.SEGMENT + 1 for n in sizes)


def test_every_segment_is_in_one_round(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "train_locally", lambda weights, segments, rate: [weights[0] + len(segments)])
    rows = [(k, np.full(gru_lm.SEGMENT + 1, k, "<u2").tobytes()) for k in range(90)]
    segments = spark.createDataFrame(rows, "key bigint, ids binary").repartition(1)
    assert gru_lm.train(segments, [np.zeros(2, np.float32)])[0].tolist() == [90, 90]


def test_filler_is_no_target(spark, make):
    _, weights = small_model()
    rng = np.random.default_rng(5)
    tokens, h = rng.integers(0, 62, (9, 5)), rng.normal(0, 0.3, (5, gru_lm.STATE)).astype(np.float32)
    longer = np.vstack([tokens, np.zeros((4, 5), int)])
    real = np.arange(12)[:, None].repeat(5, 1) < 8
    loss, grads, _ = gru_lm.gradients(weights, tokens, h)
    masked, same, _ = gru_lm.gradients(weights, longer, h, real)
    assert masked == pytest.approx(loss, rel=1e-5)
    for a, b in zip(grads, same, strict=True):
        assert a == pytest.approx(b, abs=1e-5)
    chunks = gru_lm.save_chunks(make([(None, "a b", "x"), (3, None, "x")]).select("doc_id", "text"), 1 << 20)
    vocabulary = spark.sparkContext.broadcast(gru_lm.Vocabulary(2, 2, 2, np.zeros(0, "<u8"), np.zeros(0, int)))
    held = [[gru_lm.END, gru_lm.UNK, gru_lm.UNK, gru_lm.END], [gru_lm.END, gru_lm.END]]
    got = sorted((np.frombuffer(r.ids, "<u2").tolist() for r in gru_lm._segments(chunks, vocabulary, 1).collect()), reverse=True)
    filled = [x + [gru_lm.FILLER] * (gru_lm.SEGMENT + 1 - len(x)) for x in held]
    assert got == sorted(filled, reverse=True)


def test_near_dedup_stage_equals_brute_force(spark, make, sample, odd, monkeypatch):
    rng = np.random.default_rng(9)
    rows = []
    for g in range(60):  # copies with 1 to 3 words changed: similarities from 0.7 to 0.95
        base = [f"g{g}w{k}" for k in rng.integers(0, 10_000, 100)]
        rows.append((3 * g, " ".join(base), "a"))
        for c in (1, 2):
            copy = list(base)
            for at in rng.choice(100, rng.integers(1, 4), replace=False):
                copy[at] = f"x{g}-{c}-{at}"
            rows.append((3 * g + c, " ".join(copy), "a"))
    for docs in (make(rows), sample, odd):
        got = docs.collect()
        sets = []
        for r in got:
            w = lower(r.text)
            sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else []))
        every = sorted(set(sets), key=sorted)
        links = [
            (i, j) for i, x in enumerate(every) for j in range(i)
            if min(len(x), len(y := every[j])) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y)
        ]
        group = roots(range(len(every)), links)
        number, least = {s: i for i, s in enumerate(every)}, {}
        for r, s in zip(got, sets, strict=True):
            key = (r.doc_id is None, r.doc_id or 0)
            least[group[number[s]]] = min(key, least.get(group[number[s]], key))
        kept = dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, docs, "").collect()
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(least.values())


def test_near_dedup_covers_all_pairs_of_large_buckets(spark, make):
    """400 pairs of pages on one template: similar in a pair (0.83), not quite across (0.79)."""
    template = [f"t{i}" for i in range(357)]
    rows = []
    for p in range(400):
        both = template + [f"p{p}w{i}" for i in range(10)]
        rows += [(2 * p + c, " ".join(both + [f"o{p}c{c}w{i}" for i in range(37)]), "a") for c in (0, 1)]
    kept = minhash.one_of_each(make(rows))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 800, 2))


def test_near_dedup_of_a_large_group_and_its_neighbours(spark, make):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:i % 150], f"x{i}", *base[i % 150 + 1 :]]), "a") for i in range(1, 1500)]
    rows += [(5000 + i, " ".join(base[:120] + [f"y{i}v{k}" for k in range(80)]), "a") for i in range(90)]
    kept = [r.doc_id for r in minhash.one_of_each(make(rows)).collect()]
    assert sorted(kept) == [1, *range(5000, 5090)]


def test_scratch_tables_of_near_dedup_go(spark, make):
    before = set(os.listdir(checkpoint_root(spark)))
    minhash.one_of_each(make([(i, f"a b c d e f{i}", "s") for i in range(9)])).collect()
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(checkpoint_root(spark))) - before}
    assert left == {"chunks", "chunk-list", "minhash-files", "minhash-winners"}  # what the result reads


def test_near_dedup_files_texts_by_simhash_blocks(spark, make):
    """Near copies within three bits meet in a SimHash block, whatever their MinHash bands; strangers don't."""
    from foliomill.llm.chunks import save_chunks

    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 500, 400)) for _ in range(6)]
    texts += [t + " more" for t in texts]
    fps = [simhash.majority(np.unique(simhash.shingle_hashes(t, 5))) for t in texts]
    near = [(i, i + 6) for i in range(6) if (fps[i] ^ fps[i + 6]).bit_count() <= 3]
    assert near
    rows = minhash.shingled(save_chunks(make([(i, t, "a") for i, t in enumerate(texts)]))).collect()
    keys = {r.doc_id: set(r.bands[minhash.BANDS :]) for r in rows}
    assert all(keys[a] & keys[b] for a, b in near) and not keys[0] & keys[1]


def test_language_model_cuts_texts_into_words_once(make, odd):
    """Chunk files hold hashes and numbers of words, so later steps read no texts."""
    texts = ["A b\x0bÀ\x0cÉ a", "  x\x1cy\x85z\u00a0w\u2003 \t", None, "", " ", "\rB\n\n", "İ ſ K ＡＺ", "x\x00y \x00"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "a " * 3000, "s")]
    for docs in (make(rows).select("doc_id", "text").coalesce(1), odd.select("doc_id", "text")):
        want = [(str(r.doc_id), [xxhash.xxh64_intdigest(w) for w in lower(r.text)]) for r in docs.collect()]
        got = []
        for size in (100, 1 << 20):
            got.append([])
            for r in gru_lm.save_chunks(docs, size).collect():
                chunk = gru_lm.Chunk(r.chunk)
                assert r.n_words == len(chunk.numbers) and (np.diff(chunk.values.astype(object)) > 0).all()
                hashes = chunk.values[chunk.numbers].tolist()
                ends = chunk.ends.tolist()
                got[-1] += [(str(d), hashes[e - s : e]) for d, s, e in zip(chunk.doc_ids, chunk.sizes.tolist(), ends, strict=True)]
        assert sorted(got[0]) == sorted(got[1]) == sorted(want)


def test_training_is_adam_over_windows():
    """Weights, gradients and both averages lie in one array each; steps are those of plain Adam."""
    _, weights = small_model()
    rng = np.random.default_rng(6)
    segments = rng.integers(0, 62, (5, gru_lm.SEGMENT + 1)).astype("<u2")
    segments[1, 40:], segments[3, 3:] = gru_lm.FILLER, gru_lm.FILLER
    want, m, v, step = [w.astype(float) for w in weights], [0] * 8, [0] * 8, 0
    for at in (0, 2, 4):
        batch = segments[at : at + 2].T.astype(int)
        batch = batch[:, np.argsort([(c == gru_lm.FILLER).sum() for c in batch.T], kind="stable")]
        h = np.zeros((batch.shape[1], gru_lm.STATE), np.float32)
        for w0 in range(0, gru_lm.SEGMENT, gru_lm.WINDOW):
            own = batch[w0 : w0 + gru_lm.WINDOW + 1]
            own = own[:, own[1] != gru_lm.FILLER]
            real = own != gru_lm.FILLER
            _, grads, h = gru_lm.gradients([w.astype(np.float32) for w in want], own * real, h[: own.shape[1]], real[1:])
            norm, step = math.sqrt(sum(float((g * g).sum()) for g in grads)), step + 1
            for i, g in enumerate(grads):
                g = g.astype(float) * min(1, 1 / norm)
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
                want[i] -= 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-6)
    before = [w.copy() for w in weights]
    for got, w, old in zip(gru_lm.train_locally(weights, segments, 0.01, lanes=2), want, before, strict=True):
        assert got == pytest.approx(w, abs=2e-3) and got.dtype == np.float32
        assert np.abs(got - old).max() > 0.01
    assert all((a == b).all() for a, b in zip(weights, before, strict=True))


def test_probabilities_of_far_logits_are_finite():
    """Exponentials that single precision can't hold are shifted; others give the same without."""
    for scale in (0.1, 300.0):
        _, weights = small_model()
        weights[4], weights[7] = weights[4] + np.linspace(-scale, scale, weights[4].size, dtype=np.float32).reshape(weights[4].shape), weights[7] * scale
        h = np.random.default_rng(8).uniform(-1, 1, (400, gru_lm.STATE)).astype(np.float32)
        targets = np.random.default_rng(9).integers(0, 62, 400)
        by_class, by_word = (h @ weights[4] + weights[5]).astype(float), (h @ weights[6].T + weights[7]).astype(float)
        want = []
        for c, w, t in zip(by_class, by_word, targets.tolist(), strict=True):
            w = w[t // gru_lm.CLASS * gru_lm.CLASS :][: gru_lm.CLASS]
            logs = [x - x.max() - math.log(np.exp(x - x.max()).sum()) for x in (c, w)]
            want.append(logs[0][t // gru_lm.CLASS] + logs[1][t % gru_lm.CLASS])
        assert gru_lm.log_probabilities(weights, h, targets) == pytest.approx(want, rel=1e-4, abs=1e-3)
        loss, _, _ = gru_lm.gradients(weights, np.vstack([np.zeros((1, 400), int), targets[None]]), h)
        assert math.isfinite(loss)


def test_lanes_run_documents_one_after_another():
    """Every document is in one lane, and no lane is much longer than the others or than it must be."""
    sizes = np.array([900, *range(1, 200), 0, 0])
    dealt = gru_lm._dealt(sizes, 20)
    assert sorted(i for own in dealt for i in own) == list(range(200))
    tokens = [int(sizes[own].sum()) for own in dealt]
    assert tokens == sorted(tokens, reverse=True) and tokens[1] - tokens[-1] <= 30 and tokens[0] <= max(900, tokens[-1] + 200)
    _, weights = small_model()
    documents = [np.random.default_rng(n).integers(0, 62, n).astype(np.uint16) for n in (70, 5, 1, 33, 32, 0, 64, 2)]
    alone = [gru_lm.document_scores(weights, [d])[0] for d in documents]
    for lanes in (1, 2, 3, 64):
        assert gru_lm.document_scores(weights, documents, lanes) == pytest.approx(alone, rel=1e-5, abs=1e-5)


def test_near_dedup_finds_pairs_that_share_no_band_or_block(make):
    """Pairs of 40 common shingles of 50, picked from 6000 for having no MinHash band and no SimHash block in common."""
    rows = []
    for g in (270, 528, 952, 1185, 1627, 1628, 1777, 3021, 3038, 3931, 4862, 5578):
        base = [f"g{g}w{k}" for k in range(49)]
        for c, text in enumerate((base, [*base[:24], f"g{g}x", *base[25:]])):
            rows.append((2 * g + c, " ".join(text), "a"))
        keys = [np.unique(simhash.shingle_hashes(t, 5)) for _, t, _ in rows[-2:]]
        keys = [{*minhash.bands(x).tolist(), *minhash.simhash_keys(x).tolist()} for x in keys]
        assert not keys[0] & keys[1]
    kept = dict(corpus_pipeline.STAGES)["simhash near-dedup"](None, make(rows), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(d for d, _, _ in rows if d % 2 == 0)


@pytest.mark.parametrize("similarity", [0.5, 0.8, 1.0])
def test_rare_keys_equal_brute_force(make, similarity, monkeypatch):
    """Every similar pair shares a key; documents with shingles of their own have none."""
    from foliomill.llm.chunks import save_chunks

    rng = np.random.default_rng(11)
    passages = [[f"p{p}w{k}" for k in range(30)] for p in range(4)]
    texts = []
    for i in range(80):
        words_ = sum((passages[p] for p in rng.choice(4, rng.integers(0, 4), replace=False)), []) + [f"r{k}" for k in rng.integers(0, 3, rng.integers(0, 9))]
        texts.append(" ".join(words_))
    texts += [" ".join(f"own{i}w{k}" for k in range(40)) for i in range(3)]
    monkeypatch.setattr(minhash, "CHUNKS_PER_TASK", 2)
    chunks = save_chunks(make([(i, t, "a") for i, t in enumerate(texts)]).repartition(3), 2000)
    rows = minhash.shingled(chunks).dropDuplicates(["fp"]).filter("fp <> 0").cache()
    sets = {r.fp: set(np.unique(simhash.shingle_hashes(texts[r.doc_id], 5)).tolist()) for r in rows.collect()}
    keys = collections.defaultdict(set)
    for r in minhash.rare_keys(rows, minhash._files(chunks), 5, similarity).collect():
        keys[r.fp].add(r.key & (1 << 64) - 1)
    rows.unpersist()
    held = collections.Counter(h for s in sets.values() for h in s)
    for fp, s in sets.items():
        assert len(keys[fp]) <= minhash.first_shingles(len(s), similarity) and all(h in s and held[h] > 1 for h in keys[fp])
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    assert all(keys[a] & keys[b] for a, b in near) and (near or similarity == 1)
    assert not any(keys[r] for r, s in sets.items() if all(held[h] == 1 for h in s))
