"""Operators on documents against plain loops, and their defined results for odd rows."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadpulse.llm import compression, decontaminate, host_rules, mixing, near_dup, slots, suffix_tree, toxicity
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


def tokens(text):
    return (text or "").encode().lower().split()


def sentence(rng, n, words="abcdefghijklmnopqrstuvwxyz"):
    return " ".join("".join(rng.choices(words, k=rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(documents):
    """Texts with copies, near copies of a hub, short texts and odd rows."""
    rng = random.Random(3)
    rows = [(100 + i, sentence(rng, rng.randint(8, 60)), f"s{i % 3}") for i in range(60)]
    base = sentence(rng, 60).split()
    for i in range(40):
        copy = list(base)
        at = rng.randrange(60)
        copy[at] = f"new{i}"
        rows.append((300 + i, " ".join(copy).upper(), "s0"))
    rows += [(500 + i, rows[0][1], "s1") for i in range(5)]
    return rows + ODD


def sets_of(rows):
    out = {}
    for i, t, _ in rows:
        w = tokens(t)
        out.setdefault(i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    return out


def test_near_duplicates_match_brute_force(documents, corpus, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE", 4)
    sets = {i: s for i, s in sets_of(corpus).items() if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and both * 100 >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    docs = documents(corpus).withColumn("component", F.lit("clash")).withColumn("rep", F.lit(1))
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), r.doc_id == find(r.doc_id))


def test_open_buckets_are_compared_by_tiles(shipped):
    import pyarrow as pa

    sets = pa.array([[1, 2, 3, 4], [1, 2, 3, 4], [2, 3, 4], [2, 3, 4], [9]], pa.list_(pa.int64()))
    group = pa.table({"rep": [1, 2, 3, 3, 5], "component": [1, 1, 3, 3, 5], "outside": [False, False, True, False, True], "shingles": sets})
    assert sorted(map(tuple, (r.values() for r in near_dup._outside_links(75)(group).to_pylist()))) == [(3, 1), (3, 2)]


@pytest.mark.parametrize("limits", [(400, 2000, 1 << 20), (7, 60, 5000)])
def test_an_open_bucket_of_many_components_loses_no_link(documents, monkeypatch, limits):
    for name, value in zip(("TILE", "BLOCK", "WEIGHT"), limits, strict=True):
        monkeypatch.setattr(near_dup, name, value)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(4000)]
    base = [rng.choice(words) for _ in range(150)]

    def edited(n):
        text = list(base)
        for k in rng.sample(range(len(text)), n):
            text[k] = rng.choice(words)
        return " ".join(text)

    # Similarities around the limit: one large component, some small ones and many single texts.
    rows = [(i, edited(rng.choice([1, 2, 3, 4, 5, 6])), "s") for i in range(1000)]
    sets = sets_of(rows)
    ids = sorted(sets)
    column = {s: k for k, s in enumerate(sorted(set().union(*sets.values())))}
    has = np.zeros((len(ids), len(column)), np.float32)
    for i in ids:
        has[i, [column[s] for s in sets[i]]] = 1
    both, size = has @ has.T, has.sum(axis=1)
    linked = 100 * both >= 75 * (size[:, None] + size[None, :] - both)
    least = np.arange(len(ids))
    while True:
        near = np.where(linked, least[None, :], len(ids)).min(axis=1)
        if (near == least).all():
            break
        least = near
    assert 20 < len(set(least)) < 900
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(documents(rows)).collect()}
    assert got == dict(enumerate(least.tolist()))


def test_components_of_a_chain_and_a_hub(shipped):
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)]
    got = {r.u: r.component for r in near_dup.components(shipped.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 31)) and all(got[i] == 100 for i in range(101, 140))


def test_host_rules_match_plain_loops(documents, corpus):
    repeat = [(900, "a b c d e f a b c d e g\nl\nl\nl", "bad"), (901, "%%% ### " * 6, "bad"), (902, "x", "bad")]
    rows = corpus + repeat
    got = host_rules.host_quality(documents(rows).withColumn("failed", F.lit(0))).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t, _ in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        five = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cov = {k + j for k in range(len(w) - 4) if five[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cov), len(w) < 10 or 100 * len(cov) > 20 * len(w)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)


def test_bad_host_is_shrunk_and_judged(shipped):
    rows = [("good", i % 10 == 0) for i in range(400)] + [("bad", True) for _ in range(200)] + [("small", True)] + [("fair", i % 8 == 0) for i in range(300)]
    got = {r.source: r for r in host_rules.host_verdicts(shipped.createDataFrame(rows, "source string, failed boolean")).collect()}
    assert got["bad"].host_bad and not got["good"].host_bad
    assert got["small"].host_rate < 1.0 and got["good"].host_rate == pytest.approx(0.1, abs=0.02)


def test_mixing_targets_and_limits(documents, corpus):
    rows = mixing.mix_sources(documents(corpus).withColumn("target", F.lit("clash"))).collect()
    assert sorted((r.doc_id or 0, r.size) for r in rows) == sorted((i or 0, len(tokens(t))) for i, t, _ in corpus)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    sources, taken = Counter(), Counter()
    for i, t, s in corpus:
        sources[s] += len(tokens(t))
    order = sorted((s for s in sources if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sources.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sources[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sources[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    by_size = {sources[s]: target[s] for s in order}
    for r in rows:
        taken[r.source_size] += r.taken
        assert r.target == pytest.approx(by_size[r.source_size])
    for size, t in by_size.items():
        assert abs(taken[size] - t) <= 2 * mixing.BLOCK
    again = mixing.mix_sources(documents(list(reversed(corpus))).repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))


def test_mixed_documents_hold_the_words_taken(documents, corpus):
    docs = documents(corpus).withColumn("extra", F.lit(1))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    taken = sum(r.taken for r in mixing.mix_sources(docs).collect())
    rows = mixed.collect()
    assert sum(len(tokens(r.text)) for r in rows) == taken
    whole = {i: tokens(t) for i, t, _ in corpus}
    assert all(r.n_chars == len(r.text) and not Counter(tokens(r.text)) - Counter(whole[r.doc_id]) for r in rows)


def test_permutations_are_whole(shipped):
    for n in (1, 2, 7, 64, 1001):
        df = shipped.range(n).select(mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit(1)).alias("p"))
        assert sorted(r.p for r in df.collect()) == list(range(n))


def test_sharding_is_even_gapless_and_grows_into_the_new_shard(documents, corpus):
    rows = slots.shard_rows(documents(corpus).withColumn("size", F.lit("clash")), shards=4, slots=256).collect()
    assert len(rows) == len(corpus)
    fill, places = Counter(), {}
    for r in rows:
        fill[r.shard] += r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    text = {i: t for i, t, _ in corpus if i is not None}
    assert all(r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in rows if r.doc_id is not None)
    sizes = {s: 100 + s % 7 for s in range(256)}
    owner = slots.first_map(sizes, 4, 256)
    grown = slots.grown_map(owner, sizes, 4)
    assert all(b in (a, 4) for a, b in zip(owner, grown, strict=True))
    per = Counter()
    for s, shard in enumerate(grown):
        per[shard] += sizes[s]
    assert max(per.values()) - min(per.values()) < 2 * 107
    docs = documents(corpus).withColumn("shard", F.lit("old"))
    assert slots.sharded_documents(docs).columns == docs.columns


def test_rows_that_repeat_are_spread_and_the_map_grows(documents):
    rng = random.Random(3)
    rows = [(i, sentence(rng, 30), "s") for i in range(3000)] + [(7777, "the same row " * 20, "s")] * 6000
    got = slots.shard_rows(documents(rows), shards=8, slots=2048).collect()
    fill, after, places = Counter(), Counter(), {}
    for r in got:
        fill[r.shard] += r.size
        after[r.next_shard] += r.size
        places.setdefault(r.shard, []).append(r.slot)
        assert r.next_shard in (r.shard, 8)
    assert len(got) == len(rows) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(fill.values()) < 1.1 * min(fill.values())
    assert len(after) == 9 and max(after.values()) < 1.2 * min(after.values())
    whole = Counter()
    for r in slots.sharded_documents(documents(rows), shards=8, slots=2048).collect():
        whole[r.shard] += len(r.text) + 16
    assert max(whole.values()) < 1.1 * min(whole.values())


def test_slot_map_versions(shipped, tmp_path):
    path = str(tmp_path / "map")
    slots.store_map(shipped, path, [0, 1, 0], 1)
    slots.store_map(shipped, path, [0, 1, 2], 2)
    assert {r.slot: r.shard for r in slots.read_map(shipped, path).collect()} == {0: 0, 1: 1, 2: 2}
    assert {r.slot: r.shard for r in slots.read_map(shipped, path, 1).collect()} == {0: 0, 1: 1, 2: 0}


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def suffix_tree_of(rows, depth):
    """Plain loops over the training texts: counts of tokens, kept contexts with their next tokens, and probabilities."""
    end = b"\r"
    alone, after = Counter(), {}
    for _, t, _ in (r for r in rows if not held_out(r[0])):
        ws = [end, *tokens(t), end]
        for i in range(1, len(ws)):
            alone[ws[i]] += 1
            for d in range(1, min(depth, i) + 1):
                after.setdefault(tuple(ws[i - d : i]), Counter())[ws[i]] += 1
    total, distinct = sum(alone.values()), len(alone)
    once, twice = (sum(c == k for c in alone.values()) for k in (1, 2))
    less = once / (once + 2 * twice) if once and twice else 0.5
    kept = {}
    for ctx, nexts in after.items():
        t, short = sum(nexts.values()), after.get(ctx[1:], alone)
        gain = sum(n * math.log(n / t / (short[w] / sum(short.values()))) for w, n in nexts.items())
        if gain > math.log(total) + len(nexts) * math.log(t) / 2:
            kept[ctx] = nexts

    def p(before, w):
        out = (alone[w] - less) / total if alone[w] else less * distinct / total
        for d in range(1, min(depth, len(before)) + 1):
            nexts = kept.get(tuple(before[-d:]))
            if nexts:
                out = (nexts[w] + len(nexts) * out) / (sum(nexts.values()) + len(nexts))
        return out

    return alone, kept, p


def phrases(rng, n):
    """Texts of fixed phrases, so that words tell the next ones; some only by the third word before."""
    known = [sentence(rng, rng.randint(3, 6), "abcde") for _ in range(12)] + [f"first{i} same words last{i}" for i in range(6)]
    return [(1000 + i, " ".join(rng.choices(known, k=rng.randint(1, 30))) + " " + sentence(rng, 2, "xyz"), "p") for i in range(n)]


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_language_model_matches_plain_loops(documents, corpus, monkeypatch, depth):
    # Small chunks, so that totals come from many.
    monkeypatch.setattr(suffix_tree, "CHUNK", 2000)
    rows = corpus + phrases(random.Random(11), 120)
    got = suffix_tree.language_model_scores(documents(rows).withColumn("chunk", F.lit("clash")).repartition(3), depth=depth).collect()
    count, kept, p = suffix_tree_of(rows, depth)
    assert {len(c) for c in kept} == set(range(1, depth + 1))
    total, distinct = sum(count.values()), len(count)
    want = Counter()
    for i, t, _ in rows:
        ws = [b"\r", *tokens(t), b"\r"]
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in ws[1:])
        score = sum(math.log10(p(ws[:k], ws[k])) for k in range(1, len(ws)))
        want[i, held_out(i), len(ws) - 1, sum(count[w] > 0 for w in ws[1:]), total, round(base, 4), round(score, 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in got) == want
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    for before in ([], [b"\r"], tokens(phrases(random.Random(11), 1)[0][1])[:3], [b"never", b"seen"]):
        assert sum(p(before, w) for w in [*count, b"unknown"]) == pytest.approx(1)


def test_language_model_without_training_rows(documents):
    ids = [i for i in range(200) if held_out(i)][:4]
    got = suffix_tree.language_model_scores(documents([(i, t, "s") for i, t in zip(ids, ["a b", "", None, "a a"], strict=True)])).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(i, n, 0, 0, 0.0, 0.0) for i, n in zip(ids, [3, 1, 1, 3], strict=True)}


def test_language_model_grows_with_the_input(documents):
    rng = random.Random(5)
    rows = phrases(rng, 300)
    kept = [len(suffix_tree_of(r, 2)[1]) for r in (rows[:30], rows)]
    assert kept[1] > kept[0]
    # Held-out texts of known phrases only.
    asked = [(i, " ".join(t.split()[:-2]), "q") for i, t, _ in rows if held_out(i)][:5]
    small, large = (
        {r.doc_id: r.score for r in suffix_tree.language_model_scores(documents([x for x in learnt if not held_out(x[0])] + asked)).collect()} for learnt in (rows[:30], rows)
    )
    assert sum(large[i] for i, _, _ in asked) > sum(small[i] for i, _, _ in asked)


def test_leaks_are_found_and_clean_texts_left(documents, shipped):
    rng = random.Random(9)
    items = [(k, sentence(rng, 40)) for k in range(12)]
    rows = [(i, sentence(rng, rng.randint(30, 200)), "s") for i in range(60)]
    for i in range(0, 24, 2):
        w = rows[i][1].split()
        rows[i] = (i, " ".join(w[:20] + items[i // 2][1].upper().split() + w[20:]), "s")
    para = items[3][1].split()
    rows[41] = (41, " ".join(["pre"] * 5 + [x for k, x in enumerate(para) if k % 5 or k > 30] + ["post"]), "s")
    bench = shipped.createDataFrame(items + [(90, None), (91, ""), (92, "zz yy xx")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents(rows + ODD).withColumn("item_id", F.lit(1)), bench).collect()}
    assert got == {(i, i // 2) for i in range(0, 24, 2)} | {(41, 3)}
    kept = decontaminate.clean_documents(documents(rows + ODD[:1] + ODD[3:4]), bench)
    assert kept.count() == len(rows) + 2 - 13
    assert decontaminate.contaminated(documents(rows).limit(0), bench).count() == 0
    assert decontaminate.contaminated(documents(rows), bench.limit(0)).count() == 0


def test_leaks_of_a_large_group_are_found(documents, shipped):
    rng = random.Random(4)
    item = sentence(rng, 36, [f"item{k}" for k in range(40)])
    words = [f"w{k}" for k in range(3000)]
    rows = [(i, " ".join([sentence(rng, 20, words), *[item] * (i % 5 < 2), sentence(rng, 25, words)]), "s") for i in range(1500)]
    assert (decontaminate.inverse_frequency(np.arange(3), np.array([1, 600, 1500]), 1500) > 0).all()
    bench = shipped.createDataFrame([(1, item), (2, "zz")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(documents(rows + [(2000, "a zz b", "s")]), bench).collect())
    assert got == [(i, 1) for i in range(1500) if i % 5 < 2] + [(2000, 2)]


def test_leaks_of_many_more_items_than_directions(documents, shipped):
    rng = random.Random(6)
    words, noise = ([f"{c}{k}" for k in range(6000)] for c in "wx")
    items = [(k, sentence(rng, 40, words)) for k in range(1500)]
    # A foreign word after each leaves no pair.
    rows = [(i, " ".join(f"{w} {rng.choice(noise)}" for w in items[i * 20][1].split()), "s") for i in range(75)]
    bench = shipped.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(documents(rows), bench).collect())
    assert got == [(i, i * 20) for i in range(75)]


def test_pairs_find_what_has_no_weight():
    rng = random.Random(5)
    text = [sentence(rng, n, [f"w{k}" for k in range(500)]) for n in (1, 2, 7, 15, 40, 120)]
    items = decontaminate.Items([(k, t.encode()) for k, t in enumerate(text)], np.zeros((decontaminate.TERMS, 2), np.float32))
    for k, t in enumerate(text):
        ws = t.split()
        # The last words stay, as an answer; every third one before them is another.
        cut = [w if i % 3 or len(ws) < 8 or i >= len(ws) - 6 else "x" for i, w in enumerate(ws)]
        doc = (" ".join(["a b c d"] * 30 + cut + ["e f g"] * 30)).encode()
        h, row, _ = decontaminate.word_hashes(np.frombuffer(doc, np.uint8), np.array([0, len(doc)]))
        assert k in items.places(h, row)[1]


def test_lcs_matches_the_plain_table():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(a, b) == t[-1][-1]


@pytest.mark.parametrize(("score", "column"), [(toxicity.toxicity_scores, "toxic"), (compression.quality_scores, "quality")])
def test_classifiers_hold_out_and_handle_odd_rows(shipped, documents, score, column):
    rng = random.Random(5)
    good = [(i, sentence(rng, 60), "s") for i in range(0, 300)]
    word = {"toxic": "rotter", "quality": None}[column]
    marked = []
    for i, t, s in good:
        if i % 3 == 0:
            w = t.split()
            if word:
                w[rng.randrange(60)] = word + rng.choice(["s", "", "ish"])
            t = " ".join(w) if word else " ".join(x + "%%%" for x in w)
        marked.append((i, t, s))
    truth = lambda i: int((i % 3 == 0) == (column == "toxic"))
    labels = shipped.createDataFrame([(i, truth(i)) for i in range(250)] + [(None, 1), (3, None)], f"doc_id long, {column} int")
    rows = marked + [(1000 + (i or 0), t, s) for i, t, s in ODD]
    got = score(documents(rows).withColumn("label", F.lit("clash")), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    fresh = [r for r in got if 250 <= r.doc_id < 300 or (r.held_out and r.doc_id < 250)]
    assert np.mean([r.predicted == truth(r.doc_id) for r in fresh]) > 0.9
    empty = score(documents(rows), labels.limit(0)).collect()
    assert all(r.score == 0.5 if column == "quality" else r.score < 1e-9 for r in empty)
    assert score(documents(rows).limit(0), labels).count() == 0


def test_negation_and_report_marks():
    grammar = toxicity.Grammar({"^fool": 2.0})
    assert grammar.clause("you fool") == {(False, False, True): 2.0}
    assert grammar.clause("he is not a fool") == {(True, False, True): 2.0}
    assert grammar.clause("she said fools") == {(False, True, True): 2.0}
    assert grammar.features("no match here") == [0.0] * len(grammar.NAMES)


def test_insult_and_threat_marks():
    grammar = toxicity.Grammar({"^fool": 2.0, "^kill$": 1.0})
    marks = lambda text: [m for m, _ in grammar.matches(text)]
    # (negated, reported, targeted, insult, threat)
    assert marks("you fool") == [(False, False, True, True, False)]
    assert marks("a fool came") == [(False, False, False, False, False)]
    assert marks("foolish fools") == [(False, False, False, False, False), (False, False, False, True, False)]
    assert marks("you a b c fool") == [(False, False, True, False, False)]
    assert marks("i will kill you") == [(False, False, True, False, True)]
    assert marks("i will not kill you") == [(True, False, True, False, True)]
    assert marks("he said i will kill you") == [(False, True, True, False, True)]
    assert marks("to kill a process") == [(False, False, False, False, False)]
    assert marks("i will a b c kill") == [(False, False, False, False, False)]
    names = dict(zip(toxicity.Grammar.NAMES, grammar.features("you fool. i will kill you. to kill a process."), strict=True))
    assert names["insults"] == np.log1p(2.0) and names["threats"] == np.log1p(1.0) and names["plain"] == np.log1p(4.0)


def test_composed_automaton_is_its_parts():
    rng = random.Random(9)
    parts = [toxicity.NEGATION, toxicity.REPORT, toxicity.TARGET, toxicity.INSULT, toxicity.THREAT]
    state, own = 0, [0] * len(parts)
    for _ in range(5_000):
        token = rng.choice(toxicity.TOKEN_CLASSES)
        state = toxicity.MOVES[state][token]
        own = [t.step(s, token) for t, s in zip(parts, own, strict=True)]
        assert toxicity.SAYS[state] == (own[0] > 0, own[1] == 1, own[2] == 1, own[3] > toxicity.SCOPE, own[4] > toxicity.SCOPE)


def test_beginnings_of_long_words():
    assert list(toxicity.beginnings("ab")) == ["^ab$"]
    assert list(toxicity.beginnings("abcd")) == ["^abc", "^abcd", "^abcd$"]
    long = list(toxicity.beginnings("x" * 100_000))
    assert [len(p) - 1 for p in long[:12]] == [3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 16, 21] and len(long) < 60


@pytest.mark.parametrize("operator", [near_dup.near_duplicates, host_rules.host_quality, mixing.mix_sources, mixing.mixed_documents, slots.shard_rows, slots.sharded_documents, suffix_tree.language_model_scores])
def test_no_rows_give_no_rows(documents, operator):
    assert operator(documents(ODD).limit(0)).count() == 0
