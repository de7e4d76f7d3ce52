"""Phrase mining, the shingle join and the filter audit against brute force."""

import collections
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import AWKWARD, frame

from tejido.llm import filter_audit, phrases, shingle_join
from tejido.llm.common import written

SF = "/root/testdata/sf0.001"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- phrases


def brute_phrases(rows, support, longest, top):
    f = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lowered(text)):
            w = re.findall("[^ \t]+", piece)
            f[lang][()] += len(w)
            f[lang].update(tuple(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    out = []
    for lang, c in f.items():
        found = [p for p, k in c.items() if len(p) > 1 and k >= support]
        gone = {q[i : i + n] for q in found for n in range(2, len(q)) for i in range(len(q) - n + 1) if c[q] == c[q[i : i + n]]}
        own = []
        for p in found:
            if p not in gone:
                score, k = min((1000 * c[p] * c[()] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                own.append((" ".join(p), c[p], c[p[:k]], c[p[k:]], c[()], score))
        own.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i, *x) for i, x in enumerate(own[:top], 1)]
    return sorted(out)


def mined(df, *how):
    return sorted(map(tuple, phrases.collocations(df, *how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("chunk, shards, partitions", [(150, 3, 11), (1 << 20, 40, 5), (1, 1, 2)])
def test_phrases_are_those_of_a_plain_count(spark, monkeypatch, chunk, shards, partitions):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    monkeypatch.setattr(phrases, "SHARDS", shards)
    r = random.Random(3)
    signs = ["a", "B", "b", "c", "d.", "é", "É", "new York", "x,y", "\t", "\n", "\x0b", "\xa0", "\x1c"]
    rows = [(r.choice(["en", "es", None, "und"]), " ".join(r.choice(signs) for _ in range(r.randrange(0, 40)))) for _ in range(300)]
    rows += [("en", None), ("es", ""), (None, " . , "), ("fr", "solo"), ("en", "b c " * 2000)]
    df = written(spark.createDataFrame(rows, "lang string, text string").repartition(partitions), "test")
    want = brute_phrases(rows, 12, 5, 25)
    assert len(want) > 50 and mined(df, 12, 5, 25) == want


def test_phrases_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text")
    want = brute_phrases([tuple(r) for r in docs.collect()], 20, 5, 2000)
    assert want and mined(docs, 20, 5, 2000) == want


def test_phrases_of_awkward_rows(spark):
    df = frame(spark, AWKWARD).withColumn("lang", F.when(F.col("doc_id") < 6, "en"))
    rows = [tuple(r) for r in df.select("lang", "text").collect()]
    assert mined(df, 5, 5, 2000) == brute_phrases(rows, 5, 5, 2000)
    assert mined(df.limit(0), 5, 5, 2000) == []


def test_lift_is_exact_beyond_64_bits(spark):
    r = random.Random(1)
    rows = [(r.randrange(100, 10**12), r.randrange(10**12, 10**14), r.randrange(10**6, 10**13), r.randrange(10**6, 10**13)) for _ in range(200)]
    rows.append((10**12, 10**15, 10**12, 10**12))
    df = spark.createDataFrame(rows, "a long, n long, l long, r long").select("a", "n", "l", "r", phrases.lift(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("x"))
    assert all(x["x"] == 1000 * x["a"] * x["n"] // (x["l"] * x["r"]) for x in df.collect())


def test_what_is_frequent_passes_the_filter_of_any_split(spark, monkeypatch):
    """Uneven shards: a phrase that stands in a single partition, and one that is spread evenly."""
    monkeypatch.setattr(phrases, "SHARDS", 6)
    rows = [("en", f"here and there w{i}") for i in range(60)] + [("en", "only once " * 30)] + [("en", " ".join(f"z{i}{j}" for j in range(50))) for i in range(40)]
    df = written(spark.createDataFrame(rows, "lang string, text string").coalesce(6), "test")
    found = {r["phrase"] for r in phrases.collocations(df, 29, 5).collect()}
    assert found == {p for _, _, p, *_ in brute_phrases(rows, 29, 5, 2000)} and "here and there" in found


# --- shingle join


def brute_join(rows, percent=90, k=3):
    sets = []
    for i, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", lowered(text))
        sets.append((i, {tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, min(1, len(w))))}))
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in itertools.combinations(range(len(sets)), 2):
        a, b = sets[x][1], sets[y][1]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            up[root(x)] = root(y)
    least = collections.defaultdict(list)
    for x, (i, s) in enumerate(sets):
        if i is not None and s:
            least[root(x)].append(i)
    return sorted(((i, len(s), (min(least[root(x)], default=None) if s else i)) for x, (i, s) in enumerate(sets)), key=str)


def joined(df, percent=90):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in shingle_join.linked_documents(df, 3, percent).collect()), key=str)


def edited_texts(seed, groups=12, size=9):
    """Groups of copies of a text with a few words changed, dropped or put in: pairs on both sides of the threshold."""
    r, out = random.Random(seed), []
    word = lambda: f"w{r.randrange(4000)}"
    common = [word() for _ in range(30)]
    for _ in range(groups):
        base = [word() for _ in range(r.choice([4, 11, 12, 30, 60, 150, 400]))] + common * (r.random() < 0.4)
        for _ in range(size):
            own = list(base)
            for _ in range(r.randrange(0, max(2, len(base) // 25))):
                at = r.randrange(len(own))
                own[at : at + r.randrange(0, 2)] = [word()] * r.randrange(0, 2)
            out.append(" ".join(own))
    return list(enumerate(out))


@pytest.mark.parametrize("frequent, low, heads", [(48, 0.16, 4), (2, 0.16, 1), (0, 0.5, 2), (3, 0.02, 1)])
def test_join_finds_every_link(spark, monkeypatch, frequent, low, heads):
    monkeypatch.setattr(shingle_join, "FREQUENT", frequent)
    monkeypatch.setattr(shingle_join, "LOW", low)
    monkeypatch.setattr(shingle_join, "HEADS", heads)
    rows = edited_texts(frequent)
    df = written(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "test")
    want = brute_join(rows)
    assert len({c for _, _, c in want}) < len(rows) - 20
    assert joined(df) == want


@pytest.mark.parametrize("percent", [60, 80, 95, 100])
def test_join_at_other_thresholds(spark, percent):
    rows = edited_texts(percent, 8, 8)
    df = written(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "test")
    assert joined(df, percent) == brute_join(rows, percent)


def test_join_of_awkward_rows(spark):
    df = frame(spark, AWKWARD)
    assert joined(df) == brute_join([tuple(r) for r in df.select("doc_id", "text").collect()])
    assert joined(df.limit(0)) == []


def test_join_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert joined(docs) == brute_join([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_what_two_sets_may_lack_and_differ_in(percent):
    for a in range(1, 120):
        for b in range(a, 100 * a // percent + 1):
            least = next(c for c in range(a + 1) if 100 * c >= percent * (a + b - c))
            assert a + b - 2 * least <= shingle_join.differing(a, b, percent) <= shingle_join.differing(b, 100 * b // percent, percent)
            assert max(a, b) - least <= shingle_join.lacking(max(a, b), percent) and a - least <= shingle_join.lacking(a, percent)


def test_combinations_differ_only_where_the_sets_do():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**63, 300).astype(np.uint64)
    for groups in (1, 2, 8, 64, 512):
        a, b = shingle_join.combinations(x, groups), shingle_join.combinations(x[3:], groups)
        assert len(a) == groups == len(set(a.tolist())) and groups - 3 <= (a == b).sum() < groups
        assert (a == shingle_join.combinations(x[::-1], groups)).all()
    assert len(set(np.concatenate([shingle_join.combinations(x[:0], g) for g in (1, 2, 4)]).tolist())) == 7


def test_a_large_group_of_near_copies_gives_no_square_of_pairs(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(9000)}" for _ in range(150)]
    rows = []
    for i in range(600):
        own = list(base)
        for _ in range(r.randrange(0, 4)):
            own[r.randrange(150)] = f"v{r.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    df = written(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "test")
    asked = []
    sets = shingle_join.marked(df, 3, 90)

    def verify(pairs):
        asked.append(pairs.count())
        return shingle_join.verified(pairs, df, sets, 3, 90)

    shingle_join.linked(shingle_join.indexed(df, sets, 3, 90), verify, 90)
    assert sum(asked) < 20 * len(rows)
    assert joined(df) == brute_join(rows)


# --- filter audit


def brute_audit(masks, names):
    """masks: {mask: (n, good, toxic)} -> rows of all orders, each counted afresh."""
    k, out, removed_in = len(names), [], collections.Counter()
    for order in itertools.permutations(range(k)):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << name
            here = [w for m, w in masks.items() if m & bit and not m & before]
            kept = sum(w[0] for m, w in masks.items() if not m & (before | bit))
            redundant = sum(w[0] for m, w in masks.items() if m & bit and m & before)
            unique = sum(w[0] for m, w in masks.items() if m == bit)
            removed = sum(w[0] for w in here)
            removed_in[name] += removed
            out.append(["".join(names[x] for x in order), step, kept, removed, redundant, unique, sum(w[1] for w in here), sum(w[2] for w in here), name])
            before |= bit
    return sorted((*x[:-1], removed_in[x[-1]]) for x in out)


@pytest.mark.parametrize("seed", range(12))
def test_diagrams_give_the_steps_of_every_order(seed):
    r = random.Random(seed)
    k = r.randrange(1, 6)
    masks = {m: (r.randrange(1, 50), r.randrange(0, 5), r.randrange(0, 3)) for m in r.sample(range(1 << k), r.randrange(1, (1 << k) + 1))}
    assert sorted(filter_audit.orders(masks, "ABCDE"[:k])) == brute_audit(masks, "ABCDE"[:k])


def test_swaps_meet_every_order_and_keep_diagrams_small():
    for k in range(1, 7):
        order, seen = list(range(k)), {tuple(range(k))}
        for level in filter_audit.swaps(k):
            order[level : level + 2] = order[level + 1], order[level]
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(k)))) == sum(1 for _ in filter_audit.swaps(k)) + 1
    d = filter_audit.Diagram({m: (m + 1, 1, 0) for m in range(32)}, 5)
    for level in filter_audit.swaps(5):
        d.swap(level)
        assert len(d.nodes) == len(d.unique) == 31 and d.weights[d.root] == (528, 32, 0)
    # Of filters that nothing fails there is no node, and equal branches are one node.
    assert filter_audit.Diagram({0: (5, 0, 0)}, 5).nodes == {}
    assert len(filter_audit.Diagram({m: (1, 0, 0) for m in range(32)}, 5).nodes) == 5


def brute_masks(rows, labels):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good, toxic = ({i for i, *x in labels if x[j] == 1 and i is not None} for j in (0, 1))
    parts = collections.defaultdict(lambda: collections.defaultdict(lambda: (0, 0, 0)))
    for i, text, source in rows:
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        mask = (len(w) < 200) + 2 * (100 * len(set(w)) < 50 * len(w)) + 4 * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t)) + 8 * bool(re.search("[#$%&*|]", t)) + 16 * (i is not None and i > least[t])
        a = parts[source or ""][mask]
        parts[source or ""][mask] = (a[0] + 1, a[1] + (i in good), a[2] + (i in toxic))
    return parts


def audited(docs, labels):
    found = collections.defaultdict(list)
    for r in filter_audit.audit(*filter_audit.failure_masks(docs, labels)).collect():
        found[r["part"]].append(tuple(r)[1:])
    return {p: sorted(x) for p, x in found.items()}


def test_audit_of_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    want = brute_masks([tuple(r) for r in docs.select("doc_id", "text", "source").collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert audited(docs, labels) == {p: brute_audit(m, "ABCDE") for p, m in want.items()}


def test_audit_of_awkward_rows(spark):
    rows = [(i, t, s) for (i, t), s in zip(AWKWARD, itertools.cycle(["a", None, "", "b"]))]
    rows += [(None, "the of and " * 700, "a"), (20, "one", "b"), (20, "one", "b"), (10, "one", "c"), (21, "ONE & two " * 150, "a"), (21, "other", "a"), (22, "😀É " * 300, "b"), (None, None, "a")]
    labels = [(6, 1, 0), (6, 0, 1), (20, 1, 1), (10, None, 1), (None, 1, 1), (21, 1, None), (99, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("mask", "n", "quality", "toxic", "digest", "part", "first", "words", "good"):
        df = df.withColumn(c, F.lit("clash"))
    of = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit("clash"))
    assert audited(df, of) == {p: brute_audit(m, "ABCDE") for p, m in brute_masks(rows, labels).items()}
    assert audited(df.limit(0), of) == {} and audited(df, of.limit(0)).keys() == {"a", "b", "c", ""}
