"""Each operator against a plain version of what it promises."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from fathom.llm import decontaminate, language, line_dedup, linear, minhash, mixing, quality, sharding, simhash, suffix_array, toxicity
from tests.llm.conftest import prose, rows, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(real):
    return {r.doc_id: r.text for r in real.collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# 1 ---------------------------------------------------------------------------------------------------------------


def test_targets_share_everything_and_stop_at_three_times():
    got = mixing.targets({"a": 10, "b": 1000, "c": 50, None: 5})
    assert got["a"] == 30 and abs(sum(got.values()) - 1065) < 1e-6
    assert all(t <= 3 * n + 1e-9 for (s, n), t in zip({"a": 10, "b": 1000, "c": 50, None: 5}.items(), (got[s] for s in ("a", "b", "c", None)), strict=True))
    assert list(mixing.targets({})) == []


def cheapest(distinct, cells, quota, most, levels):
    """Least cost over all flows of a tiny network, by trying every split."""
    def cost(p, n):
        total, left = 0, n
        for level in range(levels + 1):
            step = left if level == levels else min(left, distinct[p])
            total, left = total + step * level, left - step
        return total

    pairs, best = sorted(cells), None

    def go(i, used, into):
        nonlocal best
        if i == len(pairs):
            if into == quota:
                c = sum(cost(p, n) for p, n in used.items())
                best = c if best is None else min(best, c)
            return
        p, s = pairs[i]
        for n in range(min(most * cells[p, s], quota[s] - into[s]) + 1):
            go(i + 1, used | {p: used.get(p, 0) + n}, into | {s: into[s] + n})

    go(0, {}, dict.fromkeys(quota, 0))
    return best, cost


def test_flow_meets_quotas_at_least_cost():
    rng = random.Random(3)
    for _ in range(12):
        cells = {(p, s): rng.randint(1, 3) for p, s in ((1, "a"), (1, "b"), (2, "a"), (3, "b"))}
        distinct = {1: min(cells[1, "a"], cells[1, "b"]), 2: cells[2, "a"], 3: cells[3, "b"]}
        total = sum(cells.values())
        quota = {"a": rng.randint(1, min(total - 1, 3 * (cells[1, "a"] + cells[2, "a"])))}
        quota["b"] = min(total - quota["a"], 3 * (cells[1, "b"] + cells[3, "b"]))
        flow = mixing.route(distinct, cells, quota, 3)
        assert {s: sum(n for (_, x), n in flow.items() if x == s) for s in quota} == quota
        assert all(n <= 3 * cells[k] for k, n in flow.items())
        best, cost = cheapest(distinct, cells, quota, 3, 3)
        assert sum(cost(p, sum(n for (x, _), n in flow.items() if x == p)) for p in distinct) == best


def test_flow_of_many_patterns_leaves_no_cheaper_way():
    rng = random.Random(4)
    sources = [f"s{i}" for i in range(14)]
    found = set()
    while len(found) < 3000:
        found.add(tuple(sorted(rng.sample(sources, rng.randint(1, 5)))))
    cells, distinct = {}, {}
    for p, own in enumerate(sorted(found)):
        distinct[p] = rng.randint(1, 40)
        cells |= {(p, s): distinct[p] * rng.randint(1, 2) for s in own}
    sizes = {s: sum(n for (_, x), n in cells.items() if x == s) for s in sources}
    quota = {s: round(t) for s, t in mixing.targets(sizes).items()}
    flow = mixing.route(distinct, cells, quota, 3)
    assert {s: sum(n for (_, x), n in flow.items() if x == s) for s in sources} == quota
    level = {p: sum(flow[p, s] for s in own) / distinct[p] for p, own in enumerate(sorted(found))}
    # A cheaper flow would move a word from a pattern whose last level is dear to one with room at a cheaper level.
    holders = defaultdict(set)
    for p, s in cells:
        holders[s].add(p)
    for p, own in enumerate(sorted(found)):
        top = min(3, int(np.ceil(level[p])) - 1)
        if top < 1:
            continue
        reach, queue = {p}, [p]
        while queue:
            x = queue.pop()
            for s in (s for s in (own if x == p else sorted(found)[x]) if flow[x, s] > 0):
                for y in holders[s] - reach:
                    if flow[y, s] < 3 * cells[y, s]:
                        assert min(3, int(level[y])) >= top
                        reach.add(y)
                        queue.append(y)
        break


def test_choice_does_not_depend_on_the_number_of_buckets(docs, monkeypatch):
    plain = {tuple(r) for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)
    assert {tuple(r) for r in mixing.mix(docs).collect()} == plain
    by_cell = defaultdict(set)
    for r in mixing.mix(docs).collect():
        if r["size"] and r.taken % r["size"]:
            by_cell[r.pattern, r.h1].add(r.doc_id)
    assert all(len(x) == 1 for x in by_cell.values())  # at most one document of a share is taken in part


def test_too_many_sums_are_an_error(docs, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SUMS", 1)
    with pytest.raises(ValueError, match="membership pattern"):
        mixing.mix(docs)


def test_mix_meets_targets_and_repeats_itself(docs):
    got = mixing.mix(docs).collect()
    source = {r[0]: r[3] for r in rows()}
    taken, target, size = Counter(), {}, Counter()
    for r in got:
        assert r["size"] == len(words(dict((x[0], x[1]) for x in rows())[r.doc_id])) and 0 <= r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
        size[source[r.doc_id]] += r["size"]
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    assert {s: round(t, 6) for s, t in target.items()} == {s: round(t, 6) for s, t in mixing.targets(dict(size)).items()}
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_equal_texts_of_two_sources_stay_apart(spark):
    docs = table(spark, [(1, "one two three", "xx", s) for s in ("a", "b", "b")] + [(i, f"w{i} x y", "xx", "a") for i in range(2, 20)])
    counted = Counter((r.doc_id, r.source) for r in mixing.resample(docs).collect())
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.key[1:]] += -(-r.taken // r["size"])
    assert counted == +want and counted[1, "b"] > 0


# 2 ---------------------------------------------------------------------------------------------------------------


def test_leaks_with_other_numbers_and_names(spark):
    rng = random.Random(8)
    item = "Then Tom bought 12 apples for 30 dollars and gave 12 apples to Ann before walking slowly towards home again"
    twin = "Then Max bought 77 apples for 95 dollars and gave 77 apples to Eve before walking slowly towards home again"
    odd = "Then Max bought 77 apples for 95 dollars and gave 31 apples to Eve before walking slowly towards home again"
    bench = spark.createDataFrame([(1, item), (2, prose(rng, 40)), (3, "too short"), (4, item)], "item_id long, text string")
    made = [(1, f"{prose(rng, 50)} {item} {prose(rng, 9)}"), (2, f"{prose(rng, 50)} {twin}"), (3, f"{prose(rng, 50)} {odd}"), (4, prose(rng, 80)), (5, "too short")]
    docs = table(spark, [(i, t, "xx", "s") for i, t in made])
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(1, 1), (2, 1), (5, 3)}  # 5 is an item as a whole
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()) == [3, 4]


def test_verbatim_leaks_of_items_full_of_numbers(spark):
    rng = random.Random(9)
    item = "Solve 12 + 7 = 19 , 15 - 4 = 11 , 3 * 9 = 27 , 8 + 5 = 13"
    other = "Solve 11 + 6 = 17 , 14 - 3 = 11 , 2 * 8 = 16 , 7 + 4 = 11"
    bench = spark.createDataFrame([(1, item), (2, "5 7 9 11 13 15")], "item_id long, text string")
    made = [(1, f"{prose(rng, 30)} {item} {prose(rng, 9)}"), (2, f"{prose(rng, 30)} {other}"), (3, f"{prose(rng, 9)} 5 7 9 11 13 15"), (4, "5 7 9 11 13 16")]
    got = decontaminate.leaks(table(spark, [(i, t, "xx", "s") for i, t in made]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (3, 2)}


def test_real_leaks_are_those_that_hold_an_item(spark, real, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: words(r.text.lower()) for r in bench.collect()}
    want = {(d, i) for d, t in texts.items() for i, w in items.items() if " ".join(w) in " ".join(words(t.lower()))}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(real, bench).collect()} == want


def test_slots_are_checked_both_ways(spark):
    rng = random.Random(18)
    item = "Then Tom bought 12 apples for 30 dollars and gave a few apples to Ann before walking slowly towards home again"
    both = item.replace("12", "77").replace("30", "77").replace("Tom", "Max").replace("Ann", "Max")
    fine = item.replace("12", "77").replace("30", "95").replace("Tom", "Max").replace("Ann", "Eve")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = table(spark, [(1, f"{prose(rng, 20)} {both}", "xx", "s"), (2, f"{prose(rng, 20)} {fine}", "xx", "s")])
    assert [r.doc_id for r in decontaminate.leaks(docs, bench).collect()] == [2]


def test_names_that_open_sentences(spark):
    rng = random.Random(21)
    item = "Tom has 5 red apples and 3 pears. Tom gives 2 apples to Mary. Tom buys 4 more apples later. How many fruits does Tom have now?"
    swap = {"Tom": "Peter", "Mary": "Ann", "5": "7", "4": "9", "2": "6"}
    twin = re.sub(r"\w+", lambda m: swap.get(m[0], m[0]), item)
    walk = "Tom walks slowly over the old bridge towards home. Tom sings loudly all the way to town. Tom sleeps until noon the next day"
    changed = re.sub("Tom", lambda m, names=iter(["Eve", "Bob", "Ida"]): next(names), walk)
    bench = spark.createDataFrame([(1, item), (2, walk)], "item_id long, text string")
    made = [f"{prose(rng, 30)} . {twin}", twin, f"{prose(rng, 30)}\n{twin}\n{prose(rng, 9)}", f"{prose(rng, 20)} {item}", walk.replace("Tom", "Ann"), changed]
    found = decontaminate.leaks(table(spark, [(i, t, "xx", "s") for i, t in enumerate(made)]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 2)} and min(r.coverage for r in found) > 0.9


def test_short_items_are_met_as_lines(spark):
    bench = spark.createDataFrame([(1, "What is 12 times 30?"), (2, "too short"), (3, "7 8 9")], "item_id long, text string")
    made = [(1, "one line\nWhat is 7 times 45?\nanother"), (2, "Too  short"), (3, "it is too short"), (4, "4 5 6"), (5, "x\n7 8 9"), (6, "What is 7 times 7?"), (7, None)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table(spark, [(i, t, "xx", "s") for i, t in made]), bench).collect()}
    assert got == {(1, 1), (2, 2), (5, 3)}


def test_a_shared_stem_makes_no_candidates(spark):
    rng = random.Random(19)
    stem = "Read the following question with care and answer it in one word only please"
    bench = spark.createDataFrame([(i, f"{stem} {prose(rng, 30)}") for i in range(60)], "item_id long, text string")
    made = [(i, f"{prose(rng, 20)} {stem} {prose(rng, 20)}", "xx", "s") for i in range(60)]
    whole = bench.first().text
    docs = table(spark, [*made, (99, f"{prose(rng, 5)} {whole}", "xx", "s")])
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()] == [(99, 0)]
    windows = decontaminate._with_rare(decontaminate.benchmark_windows(bench), decontaminate.COVERAGE)
    common = windows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    assert common.count() > 3 and windows.where("rare").join(common, "hash").count() == 0


def test_reparameterised_versions_of_the_given_items(spark):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    rng = random.Random(20)
    changed = {}
    for i, t in items.items():
        values = {}
        new = re.sub(r"[0-9]+", lambda m: values.setdefault(m[0], str(100 + len(values) * 7 + rng.randint(0, 6))), t)  # noqa: B023
        changed[i] = re.sub(r"(?<=[a-z,] )[A-Z][a-z]+", lambda m: values.setdefault(m[0], f"Name{chr(97 + len(values) % 26)}"), new)  # noqa: B023
    docs = table(spark, [(i, f"{prose(rng, 30)} {t} {prose(rng, 9)}", "xx", "s") for i, t in changed.items()])
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert sum((i, i) in got for i in items) >= 0.9 * len(items)


# 3 ---------------------------------------------------------------------------------------------------------------


def test_em_recovers_labellers():
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < 0.8
    hit = [0.7, 0.5, 0.6]
    said = [np.where(~good & (rng.random(len(good)) < h), "0", np.where(good & (rng.random(len(good)) < 0.6), "1", "-")) for h in hit]
    patterns = Counter(map("".join, zip(*said, strict=True)))
    names = sorted(patterns)
    post, rates, share = quality.expectation_maximisation(names, np.array([patterns[n] for n in names], float))
    assert abs(share - 0.8) < 0.05 and all(abs(rates[k, 0, 0] - h) < 0.1 for k, h in enumerate(hit))
    assert post[names.index("000")] < 0.05 < 0.9 < post[names.index("111")]


def auc(y, score):
    order = np.argsort(score)
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    y = np.asarray(y, bool)
    return (rank[y].mean() - (y.sum() - 1) / 2) / (~y).sum()


def test_quality_ranks_good_above_bad(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.assess(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert auc(got["quality"], got["score"]) > 0.9
    assert got[got["quality"] == 1]["keep"].mean() > 0.95


def test_fit_is_bounded_in_features(spark):
    rows = spark.createDataFrame([(i, float(i % 2), [i % 2, *range(2, 102)], [1.0] * 101) for i in range(60)], "key long, y double, at array<int>, x array<float>")
    w, bias = linear.fit_on_one(rows, 128, most=101 * 40)
    assert linear.sigmoid(bias + w[1] + w[2:102].sum()) > 0.5 > linear.sigmoid(bias + w[0] + w[2:102].sum())
    few, _ = linear.fit_on_one(rows, 128, most=1)
    assert (few != 0).sum() <= 101
    assert not linear.fit_on_one(rows.limit(0), 128)[0].any()


def test_linear_learns_a_feature():
    rng = random.Random(1)
    data = [(float(i % 2), np.array([i % 2, 2 + rng.randint(0, 5)]), np.ones(2)) for i in range(200)]
    w, bias = linear.fit(data, 8)
    assert linear.sigmoid(bias + w[1]) > 0.7 > 0.3 > linear.sigmoid(bias + w[0])


# 4 ---------------------------------------------------------------------------------------------------------------


def covered(texts, n=50):
    seen, made = defaultdict(set), {}
    for i, t in texts.items():
        w = made[i] = words(t)
        for k in range(len(w) - n + 1):
            seen[tuple(w[k : k + n])].add(i)
    return {i: {j for k in range(len(w) - n + 1) if len(seen[tuple(w[k : k + n])]) > 1 for j in range(k, k + n)} for i, w in made.items()}


def check_passages(docs, texts):
    got = defaultdict(set)
    for r in suffix_array.repeated_passages(docs).collect():
        got[r.doc_id] |= set(range(r.first, r.last))
    assert {i: got[i] for i in texts} == covered(texts)


def test_passages_are_all_that_repeat(spark, real, texts, docs):
    check_passages(real, texts)
    plain = {r[0]: r[1] for r in rows()}
    check_passages(docs, plain)


def test_passages_across_many_partitions(spark):
    rng = random.Random(4)
    passage = prose(rng, 55)
    texts = {i: f"{prose(rng, 20)} {passage} {prose(rng, 25)}" if i % 3 else prose(rng, 90) for i in range(60)}
    check_passages(table(spark, [(i, t, "xx", "s") for i, t in texts.items()]).repartition(9), texts)


def test_repeated_phrases(spark):
    rng = random.Random(7)
    texts = {i: f"{prose(rng, rng.randint(0, 30))} {'is on ' * rng.randint(10, 90)} {prose(rng, rng.randint(0, 30))}" for i in range(8)}
    texts |= {10 + i: f"{prose(rng, 9)} {' '.join(['one two three four five six seven'] * rng.randint(5, 20))} {prose(rng, 9)}" for i in range(5)}
    texts |= {20: "solo " * 300, 21: "solo " * 90, 22: "lone pair " * 100}
    check_passages(table(spark, [(i, t, "xx", "s") for i, t in texts.items()]), texts)


def test_words_whose_hashes_share_low_bits_differ(spark):
    rng = random.Random(14)
    w = [prose(rng, 1) + str(i) for i in range(49)]
    texts = {1: " ".join([*prose(rng, 30).split(), *w, "w128"]), 2: " ".join([*prose(rng, 30).split(), *w, "w500"])}
    check_passages(table(spark, [(i, t, "xx", "s") for i, t in texts.items()]), texts)


def test_extents_of_runs_against_all_partners():
    rng = np.random.default_rng(6)
    tail, reach = suffix_array._TAIL, suffix_array.LEFT
    for _ in range(60):
        n = int(rng.integers(1, 40))
        head = np.sort(rng.integers(0, 3, n)).astype(np.uint64)
        right, left = (rng.choice([1, 2], (n, k), p=[0.97, 0.03]).astype(np.uint64) for k in (tail, reach))
        for a in (right, left):  # some texts end inside the context
            for i in np.flatnonzero(rng.random(n) < 0.1):
                a[i, rng.integers(0, a.shape[1]) :] = 0
        doc, shared = rng.integers(0, 6, n), rng.random(n) < 0.1
        order = np.lexsort((*right.T[::-1], head))
        right, left, doc, shared, head = right[order], left[order], doc[order], shared[order], head[order]
        before, after = suffix_array.extents(head, right, left, doc, shared)

        def common(a, b):
            k = 0
            while k < len(a) and a[k] == b[k] != 0:
                k += 1
            return k

        for i in range(n):
            pairs = [(20 + common(right[i], right[j]), common(left[i], left[j])) for j in range(n) if head[i] == head[j] and (doc[i] != doc[j] or shared[j]) and not shared[i]]
            if shared[i]:
                pairs = [(20 + int((right[i] != 0).sum()), int((left[i] != 0).sum()))]
            long = [(r, x) for r, x in pairs if r + x >= 50]
            assert (before[i], after[i]) == (max((x for _, x in long), default=0), max((r for r, _ in long), default=0))


def test_runs_cut_by_range_borders(spark, monkeypatch):
    rng = random.Random(15)
    passage = prose(rng, 60).split()
    texts = {}
    for i in range(150):  # one passage with edits all over: few contexts are equal, and all share heads
        own = list(passage)
        for at in rng.sample(range(60), rng.randint(0, 2)):
            own[at] = f"x{i}"
        texts[i] = " ".join([*prose(rng, rng.randint(0, 9)).split(), *own, *prose(rng, 5).split()])
    docs = table(spark, [(i, t, "xx", "s") for i, t in texts.items()])
    check_passages(docs, texts)
    monkeypatch.setattr(suffix_array, "RUN", 20)  # on the driver: cut runs of more classes are left to their windows
    check_passages(docs, texts)


# 5 ---------------------------------------------------------------------------------------------------------------


def test_edited_texts_and_likeness(spark, real, texts):
    order = sorted(texts, reverse=True)
    after = {d: order[(i + 1) % len(order)] for i, d in enumerate(order)}
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [words(t.lower())] for i in range(max(1, len(w) - 4)) if w}
    errors = []
    for r in entry.queries()["op5_minhash"](spark, SF).collect():
        text = texts[r.doc_id]
        cut = len(text) // 3
        new = text[: len(text) - cut] + texts[after[r.doc_id]][:cut]
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and r.n_chars == len(text)
        for value, other in ((r.near_edited, new), (r.near_next, texts[after[r.doc_id]])):
            a, b = shingles(text), shingles(other)
            errors.append(value - len(a & b) / max(1, len(a | b)))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04 and np.abs(errors).max() < 0.2


def test_equal_texts_equal_prints_and_neighbours(docs):
    by_text = defaultdict(set)
    plain = {r[0]: r[1] for r in rows()}
    for r in minhash.fingerprints(docs).collect():
        by_text[plain[r.doc_id] or ""].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    ids = sorted((r[0] for r in rows() if r[0] is not None), reverse=True)
    got = {r.doc_id: r.next_text for r in minhash.with_next(docs, n_ranges=7).collect()}
    for a, b in zip(ids, ids[1:], strict=False):
        if a != b:
            assert got[a] == (plain[b] or ""), a
    assert got[0] == "no id at all" and got[None] == plain[307]


def test_neighbours_of_null_repeated_and_least_ids(spark):
    made = [(None, f"text {i} without an id", "xx", "s") for i in range(60)] + [(7, f"text {i} of id seven", "xx", "s") for i in range(60)]
    made += [(-(1 << 63), "the least id", "xx", "s"), ((1 << 63) - 1, "the greatest id", "xx", "s"), (None, None, "xx", "s")]
    docs = table(spark, made)
    got = [(r.doc_id, r.text, r.next_text) for r in minhash.with_next(docs, n_ranges=9).collect()]
    follows = {t: n for _, t, n in got}
    assert sorted(follows) == sorted(t or "" for _, t, *_ in made) and len(set(follows.values())) == len(follows)
    chain, t = [], "the greatest id"
    while t not in chain:
        chain.append(t)
        t = follows[t]
    ids = {t or "": i for i, t, *_ in made}
    assert t == "the greatest id" and [ids[x] for x in chain] == [(1 << 63) - 1] + [7] * 60 + [-(1 << 63)] + [None] * 61


# 6 and 8 ---------------------------------------------------------------------------------------------------------


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in entry.queries()["op6_language_id"](spark, sf).collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_texts_of_no_language_are_ambiguous(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    rng, predict = random.Random(22), language.train(docs).predict
    clean = [r for r in docs.collect() if language.has_letter(r.text)]
    assert sum(predict(r.text)[2] for r in clean) <= 0.005 * len(clean)
    foreign = ["".join(rng.choices("абвгдежзиклмнопрстуфхцчшэюя    ", k=400)) for _ in range(50)]
    assert sum(predict(t)[2] for t in foreign) >= 45
    by = {x: [r.text for r in clean if r.lang == x and len(r.text) > 400] for x in {r.lang for r in clean}}
    mixed = [f"{rng.choice(by[a])[:400]} {rng.choice(by[b])[:400]}" for a, b in (rng.sample(sorted(by), 2) for _ in range(200))]
    assert sum(predict(t)[2] for t in mixed) >= 60


def test_codewords_differ():
    for n in (2, 3, 4, 5, 6, 12, 30):
        code = language.codewords(n)
        assert len({tuple(c) for c in code}) == n and (np.abs(code.sum(axis=0)) < n).all()


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = entry.queries()["op8_toxicity"](spark, sf).join(labels, "doc_id").toPandas()
    assert ((got["score"] >= 0.3) == (got["predicted"] == 1)).all() and got["score"].between(0, 1).all()
    held = got[got["held_out"]]
    assert auc(held["toxic"], held["score"]) > 0.75
    assert docs.count() == 1000


def test_ratios_favour_what_is_toxic():
    r = toxicity.ratios(np.array([100.0, 1.0, 1.0]), np.array([10.0, 30.0, 0.0]), 900, 100)
    assert r[1] > 1 > abs(r[0]) and r[2] == 0


# 7 ---------------------------------------------------------------------------------------------------------------


def brute_lines(texts, least, first=False):
    keys = lambda t: [ascii_lower(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")]
    holders = defaultdict(set)
    for i, t in texts.items():
        for k in keys(t):
            holders[k].add(i)
    seen, out = set(), {}
    for i in sorted(texts):
        kept = []
        for line, k in zip((texts[i] or "").split("\n"), keys(texts[i]), strict=True):
            gone = bool(k) and len(holders[k]) >= least
            if gone and first and k not in seen:
                seen.add(k)
                gone = False
            if not gone:
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


def test_lines(spark):
    rng = random.Random(6)
    pool = [prose(rng, 3) for _ in range(12)] + ["", "  ", "É x", "é X", " Shared "]
    texts = {i: "\n".join(rng.choice(pool).upper() if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randint(0, 9))) for i in range(40)}
    texts[40], texts[41] = None, "\n\n"
    docs = table(spark, [(i, t, "xx", "s") for i, t in texts.items()])
    for first in (False, True):
        got = {r.doc_id: r for r in line_dedup.deduplicate(docs, 8, first).collect()}
        want = brute_lines(texts, 8, first)
        assert {i: r.text for i, r in got.items()} == want
        assert all(r.n_lines == len((texts[i] or "").split("\n")) for i, r in got.items())
    assert any(r.runs for r in got.values())


# 9 ---------------------------------------------------------------------------------------------------------------


def test_fingerprint_bits():
    text = "Ab c d e f g Éa"
    shingle = [" ".join(ascii_lower(text).split()[i : i + 4]) for i in range(4)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingle]
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > 4)
    assert simhash.majority_bits(simhash.shingle_hashes(text)) % (1 << 64) == want
    assert simhash.majority_bits(simhash.shingle_hashes(None)) == 0


def roots(prints, links):
    up = {p: p for p in prints}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {p: top(p) for p in prints}


@pytest.mark.parametrize("block", [2048, 5])
def test_links_connect_all_that_are_near(spark, block):
    rng = random.Random(9)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            prints.add(x - (1 << 64) if x >> 63 else x)
    prints |= {0, -1, 1, 15}
    near = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = [(r.u, r.v) for r in simhash.links(nodes, block).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in got)
    assert roots(prints, got) == roots(prints, near)


def test_stage_keeps_one_of_similar_texts(spark):
    rng = random.Random(12)
    texts = []
    for k in range(40):  # copies with scattered words exchanged: similarities of about 0.5 to 1
        base = prose(rng, 150).split()
        texts.append(" ".join(base))
        for n in (1, 2, 3, 4, 6):
            own = list(base)
            for at in rng.sample(range(150), n):
                own[at] = f"new{k}x{n}x{at}"
            texts.append(" ".join(own))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    pairs = [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in range(len(texts)) for b in range(a + 1, min(len(texts), a + 6))]
    assert sum(0.8 <= s < 0.95 for _, _, s in pairs) > 40
    docs = table(spark, [(i, t, "xx", "s") for i, t in enumerate(texts)])
    near = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs, similar=None).collect() if r.doc_id != r.component_id]
    want = set(roots(range(len(texts)), [(a, b) for a, b, s in pairs if s >= 0.8] + near).values())
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == want
    found = simhash.near_duplicates(docs, similar=None)
    component = {r.doc_id: r.component for r in found.collect()}
    dealt = [(r.u, r.v) for r in simhash.similar_links(docs, found, block=3).collect()]
    joined = roots(set(component.values()), dealt)
    assert all(joined[component[a]] == joined[component[b]] for a, b, s in pairs if s >= 0.8)


def test_components_of_a_long_chain(spark):
    from fathom.llm.components import components

    edges = spark.createDataFrame([(i + 1, i) for i in range(150)] + [(500, 501), (7, 7)], "u long, v long")
    got = {r.u: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 151)} | {501: 500}


# 10 --------------------------------------------------------------------------------------------------------------


def test_shards_are_even_and_places_gapless(spark):
    sf = "/root/testdata/sf0.01"
    got = entry.queries()["op10_sharding"](spark, sf).toPandas()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(texts) and set(got["law"]) == {"bytes"} and got["shard"].between(0, 39).all()
    for r in got.to_dict("records"):
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() <= got["size"].max()


def test_rebalancing_edits_the_map():
    rng = random.Random(1)
    loads = {s: (rng.randint(1, 100), 1) for s in range(400)}
    old = sharding.deal(loads, 8)
    new = sharding.rebalance(old, loads, 9)
    moved = [s for s in loads if old[s] != new[s]]
    assert {new[s] for s in moved} == {8} and len(moved) < 400 / 8
    totals = [sum(loads[s][0] for s in loads if new[s] == k) for k in range(9)]
    assert max(totals) - min(totals) <= 200
    fewer = sharding.rebalance(old, loads, 7)
    assert all(old[s] == 7 for s in loads if old[s] != fewer[s]) and max(fewer.values()) == 6


def test_stored_maps_have_versions(spark, tmp_path):
    folder = str(tmp_path / "map")
    rng = random.Random(22)
    docs = table(spark, [(i, prose(rng, rng.randint(1, 40)), "xx", "s") for i in range(600)])
    old = sharding.shard(docs, 4, folder=folder).collect()
    sharding.rebalance_stored(spark, folder, 5)
    versions = spark.read.parquet(folder)
    assert {tuple(r) for r in versions.groupBy("version").count().collect()} == {(1, 4096), (2, 4096)}
    moved = versions.groupBy("virtual_slot").agg(F.countDistinct("shard").alias("n"), F.max_by("shard", "version").alias("to")).where("n = 2")
    moved = {r.virtual_slot: r.to for r in moved.collect()}
    assert moved and set(moved.values()) == {4}
    same = sharding.place(docs, folder, version=1).collect()
    assert sorted(map(str, same)) == sorted(map(str, old))
    grown = Counter((r.doc_id, r.text_crc32, r.virtual_slot, r.shard) for r in sharding.place(docs, folder).collect())
    assert grown == Counter((r.doc_id, r.text_crc32, r.virtual_slot, moved.get(r.virtual_slot, r.shard)) for r in old)
    later = table(spark, [(i, f"new text {i}", "xx", "s") for i in range(7000, 7300)])
    assert sharding.place(later, folder).count() == 300


def test_equal_records_are_spread(spark):
    made = [(None, "one text that many rows without an id share", "xx", "s")] * 200 + [(i, f"text number {i} of twenty others with words", "xx", "s") for i in range(20)]
    got = sharding.shard(table(spark, made), 4).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(got) == 220 and len(sums) == 4 and sums.max() - sums.min() <= 2 * got["size"].max()
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))


# pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline_against_its_parts(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        if name != "sharding":
            assert docs.columns == before.columns
        if name == "SimHash near-dedup":
            found = simhash.near_duplicates(before).collect()
            assert {r.doc_id for r in docs.collect()} == {r.component_id for r in found}
        if name.startswith("mixing"):
            counted = Counter(r.doc_id for r in docs.collect())
            want = {r.doc_id: -(-r.taken // max(1, r["size"])) for r in mixing.mix(before).collect() if r.taken}
            assert counted == Counter(want)
    assert docs.count() == entry.queries()["pipeline"](spark, SF).count()
