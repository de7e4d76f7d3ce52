"""The training-data operators against brute force, libraries and held-out labels, with awkward rows in every one."""

import collections
import hashlib
import math
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tejido.llm import bpe, counting, crf, encoding, hpylm, near_copies, neighbours, packing, quality_pu, quality_rules, sharding, shingle_join, simhash, suffix_dedup
from tejido.llm.common import written
from tejido.llm.components import components

SF = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")
#: null, empty and blank texts, a long one, repeated rows, equal texts, special strings, rarer scripts; columns that clash with inner names
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "Uno dos  tres. don't\n\nUno dos tres " * 40), (5, "x" * 5000), (6, "the of and " * 700), (6, "the of and " * 700), (7, "<|endoftext|> a <|startoftext|>ß É"), (8, "漢字 Σας İx y"),
    (9, "the of and " * 700), (None, "a text without an id, which still has a few words of its own to keep"), (10, "one"),
]
CLASH = ["uid", "extra", "fp", "size", "key", "ids", "shard", "score", "kind", "data"]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return written(df.repartition(3), "test")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def awkward(spark):
    return frame(spark, AWKWARD)


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(name))


def counted(rows):
    return collections.Counter(rows)


# --- BPE


def noise(n, seed):
    r = random.Random(seed)
    signs = "abcdEFGhi  \n\t'strevdl.,!#$%éÉñßµºª²¼漢字😀\x1c\x1f\xa0\x85ΣσİŒœé 　 123 <|endoftext|>"
    return ["".join(r.choice(signs) for _ in range(r.randrange(0, 60))) for _ in range(n)] + ["".join(chr(r.choice([r.randrange(32, 0xD7FF), r.randrange(0xE000, 0x1FFFF)])) for _ in range(100)) for _ in range(40)]


def test_trie_encoding_is_the_librarys(texts):
    rows = [t or "" for _, t in texts] + noise(3000, 1) + [t or "" for _, t in AWKWARD]
    m = bpe.Merges(P.path("byte_bpe_50k.json"))
    want = [e.ids for e in library("byte_bpe_50k.json").encode_batch(rows, add_special_tokens=False)]
    assert list(bpe.Encoder(m).encode_batch(rows)) == want
    assert [t.total for t in bpe.Counter(m).tables(rows)] == list(map(len, want))
    decode = library("byte_bpe_50k.json").decode
    assert all(m.decode(ids) == decode(ids, skip_special_tokens=False) for ids in want)


def test_prefix_counts_are_those_of_every_prefix(monkeypatch):
    m, t = bpe.Merges(P.path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    forms = ["it's we're they'll 're 'v 'l I've  'll", "a  \n\n b   ", "end <|endoftext|><|startoftext|>  <|endoftext|>!<|endoftext|>", "don''re '", " \u00a0\u2003x"]
    for text in noise(60, 2) + forms:
        table = bpe.prefix_counts(m, text)
        want = [len(t.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        with monkeypatch.context() as x:
            x.setattr(bpe.Merges, "step", None)  # nothing is encoded once the table is made
            assert [table.count(i) for i in range(len(text) + 1)] == want, text
            for budget in (0, 1, 5, 9):
                assert table.fit(budget) == max(i for i, n in enumerate(want) if n <= budget)


def test_budget_questions_about_a_text_without_spaces(monkeypatch):
    r = random.Random(3)
    text = "".join(r.choice("abcdefgh") for _ in range(60_000))
    table = bpe.prefix_counts(bpe.Merges(P.path("byte_bpe_50k.json")), text)
    monkeypatch.setattr(bpe.Merges, "step", None)
    began = time.perf_counter()
    best = table.fit(4096)
    assert time.perf_counter() - began < 0.1
    t = library("byte_bpe_50k.json")
    assert len(t.encode(text[:best], add_special_tokens=False).ids) <= 4096 < len(t.encode(text[: best + 1], add_special_tokens=False).ids)


def test_round_trip_query(spark, awkward):
    t = library("byte_bpe_50k.json")
    want = counted((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()) for i, x in AWKWARD for ids in [t.encode(x or "", add_special_tokens=False).ids])
    assert counted(map(tuple, encoding.round_trip(awkward, P.path("byte_bpe_50k.json")).collect())) == want
    coded = encoding.encode(awkward, P.path("byte_bpe_50k.json"))
    assert counted(map(tuple, encoding.decode(coded, P.path("byte_bpe_50k.json")).collect())) == counted((i, x or "") for i, x in AWKWARD)
    assert encoding.round_trip(frame(spark, []), P.path("byte_bpe_50k.json")).count() == 0


def test_count_query(spark, awkward):
    t = library("byte_bpe_50k.json")
    for r in counting.count_tokens(awkward, P.path("byte_bpe_50k.json"), 1024).collect():
        x = dict((i, x) for i, x in AWKWARD)[r["doc_id"]] or ""
        n = len(t.encode(x, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(x.encode()), n > 1024)
        assert len(t.encode(x[: r["fit_chars"]], add_special_tokens=False).ids) <= 1024
    assert counting.count_tokens(frame(spark, []), P.path("byte_bpe_50k.json")).count() == 0


# --- packing


@pytest.mark.parametrize("which", ["plain", "awkward", "empty"])
def test_packing(spark, docs, texts, awkward, which):
    source, rows = {"plain": (docs, texts), "awkward": (awkward, AWKWARD), "empty": (frame(spark, []), [])}[which]
    t = library("word_bpe_49k.json")
    want = counted((i, tuple(t.encode(x or "", add_special_tokens=False).ids + [1])) for i, x in rows)
    pieces = packing.pack(source, P.path("word_bpe_49k.json"), 2048, 1, with_ids=True).collect()
    by_sequence = collections.defaultdict(list)
    by_doc = collections.defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["text_ids"], "<u4").tolist()
        assert len(ids) == p["length"] > 0 and zlib.crc32(p["text_ids"]) == p["ids_crc32"]
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
        by_doc[p["doc_id"]].append((p["start"], ids, p["doc_tokens"]))
    padding = 0
    for s in by_sequence.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    total = sum(p["length"] for p in pieces)
    assert total == sum(len(ids) * n for (_, ids), n in want.items())
    assert padding <= 0.02 * total + 4 * 2048
    for i, x in rows:
        if [r[0] for r in rows].count(i) == 1:
            (ids,) = [k[1] for k in want if k[0] == i]
            assert [b for _, part, n in sorted(by_doc[i]) for b in part] == list(ids)


def test_power_cuts():
    assert packing.powers(13) == [8, 4, 1] and sum(packing.cut(5000, 2048)) == 5000
    assert all(2048 // n * n > 2048 - n for n in packing.cut(5000, 2048))


# --- sharding


def brute_minimax(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, at = (low + high) // 2, 1, 0
        for s in sizes:
            if at + s > mid:
                used, at = used + 1, 0
            at += s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


def test_capacity_is_the_smallest():
    r = random.Random(1)
    for _ in range(200):
        sizes = sorted((r.randrange(1, 50) for _ in range(r.randrange(1, 60))), reverse=True)
        values, counts = np.unique(sizes, return_counts=True)
        shards = r.randrange(1, 12)
        starts, most = sharding.Histogram(values, counts).cuts(shards)
        assert most == brute_minimax(sizes, shards) and starts[-1] == len(sizes)
        assert max(sum(sizes[a:b]) for a, b in zip(starts, starts[1:])) <= most


@pytest.mark.parametrize("which", ["plain", "awkward", "empty"])
def test_sharding(spark, docs, texts, awkward, which):
    source, rows = {"plain": (docs, texts), "awkward": (awkward, AWKWARD), "empty": (frame(spark, []), [])}[which]
    got = sharding.shard(source, 8).collect()
    assert counted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == counted((i, len((x or "").encode()) + 16, zlib.crc32((x or "").encode())) for i, x in rows)
    slots = collections.defaultdict(list)
    homes = collections.defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        homes[r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())
    if rows:
        group = collections.Counter()
        for _, x in rows:
            group[x or ""] += len((x or "").encode()) + 16
        assert max(sum(r["size"] for r in got if r["shard"] == k) for k in slots) <= brute_minimax(sorted(group.values(), reverse=True), 8)


# --- suffix dedup


def brute_dedup(rows, length=50):
    low = {}
    key = lambda i: math.inf if i is None else i
    for i, t in rows:
        d = (t or "").encode()
        for p in range(len(d) - length + 1):
            w = d[p : p + length]
            low[w] = min(low.get(w, math.inf), key(i))
    out = []
    for i, t in rows:
        d = (t or "").encode()
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if low[d[p : p + length]] < key(i):
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((i, len(d), sum(gone), runs, bytes(b for b, g in zip(d, gone) if not g)))
    return counted(out)


def dedup(df):
    return counted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.dedup(df).collect())


def passages(seed=3):
    r = random.Random(seed)
    base = ["".join(r.choice("abc ") for _ in range(r.randrange(0, 400))) for _ in range(30)]
    rows = [(r.randrange(0, 100), "".join(r.choice(base)[r.randrange(0, 100) :][: r.randrange(20, 200)] + r.choice(["é", "ü", " ", ""]) for _ in range(r.randrange(0, 5)))) for _ in range(120)]
    return rows + [(200 + i, "a passage that everybody has in their footer, really all of them do have it"[: r.randrange(52, 77)] + str(i)) for i in range(60)]


@pytest.mark.parametrize("rows", [passages(), AWKWARD, [], [(1, "a"), (2, "b")]], ids=["passages", "awkward", "empty", "short"])
def test_suffix_dedup(spark, rows):
    assert dedup(frame(spark, rows)) == brute_dedup(rows)


def test_suffix_dedup_on_documents(docs, texts):
    assert dedup(docs) == brute_dedup(texts)


def test_suffix_dedup_of_crowded_anchors_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWDED", 3)
    monkeypatch.setattr(suffix_dedup, "FILTER_BYTES", 100)
    rows = passages(4)
    assert dedup(frame(spark, rows)) == brute_dedup(rows)


def test_suffix_dedup_of_long_repetitive_texts(spark, monkeypatch):
    """One character, a period, a repeated line and distinct text, over several pieces."""
    r = random.Random(6)
    words = "".join(r.choice("abcdefgh ") for _ in range(7000))
    line = "the same line again and again, sixty bytes of it or more ...\n"
    rows = [(3, "x" * 20_000), (5, words + "x" * 9000 + words), (4, "ab" * 6000), (9, "x" * 700 + line * 150), (7, line * 200 + "ab" * 100 + words[:6000]), (8, "abc" * 3000), (2, "abc" * 100 + line)]
    assert dedup(frame(spark, rows)) == brute_dedup(rows)


def test_slices_of_a_long_repetitive_text_stay_small():
    import tracemalloc

    import zstandard

    class Known:
        value = suffix_dedup.Filter(12, {}, np.zeros(0, np.uint64))

    Known.value.has = lambda h: np.ones(len(h), bool)
    for text in (b"x" * 4_000_000, b"a line of some length that is there a hundred thousand times\n" * 65_000):
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([zstandard.compress(text)], pa.binary())], ["uid", "doc_id", "data"])
        tracemalloc.start()
        sent = sum(len(d) for b in suffix_dedup._slice_requests(Known, 12, 12)(iter([batch])) for d in b.column("data").to_pylist())
        assert sent < 100_000 and tracemalloc.get_traced_memory()[1] < 400 << 20
        tracemalloc.stop()


def test_columns_go_through_the_passage_stage_unchanged(spark):
    import datetime

    at = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
    rows = [(1, None, at, [1, 2], 0), (2, "a passage that is long enough to be found twice in this table", at, None, 7), (3, "a passage that is long enough to be found twice in this table!", None, [3], 7)]
    source = spark.createDataFrame(rows, "doc_id int, text string, at timestamp, xs array<int>, n_chars int")
    got = suffix_dedup.keep(source)
    assert got.schema == source.schema
    assert sorted(map(tuple, got.collect()), key=lambda x: x[0]) == [(1, None, at, [1, 2], 0), (2, rows[1][1], at, None, len(rows[1][1])), (3, "!", None, [3], 1)]


def test_equal_windows_sorts_like_strings():
    r = random.Random(5)
    text = np.array([r.randrange(97, 99) for _ in range(2000)] + [0] * 200, np.uint8)
    at = np.arange(0, 1900, suffix_dedup.PERIOD)
    order, same = suffix_dedup.equal_windows(text, at, 8)
    word = lambda i: text[at[i] : at[i] + 8].tobytes()
    assert [word(i) for i in order] == sorted(map(word, range(len(at))))
    assert same.tolist() == [False] + [word(a) == word(b) for a, b in zip(order[1:], order[:-1])]


# --- near duplicates


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("crowded", [512, 3])
def test_links_and_components(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(15)] + [0, 2**64 - 1]
    fps = list(dict.fromkeys([*base, *(r.choice(base) ^ sum(1 << x for x in r.sample(range(64), r.randrange(1, 8))) for _ in range(250))]))
    signed = [(f - 2**64 if f >> 63 else f, i) for i, f in enumerate(fps)]
    got = dict(map(tuple, components(simhash.linked(written(spark.createDataFrame(signed, "fp long, id long"), "c"))).collect()))
    assert [got.get(i, i) for i in range(len(fps))] == roots(fps)


def test_near_duplicates(spark, awkward):
    rows = sorted({i: x for i, x in AWKWARD if i is not None}.items())
    fps = [brute_fingerprint(x) for _, x in rows]
    want = {i: (f, rows[k][0]) for (i, _), f, k in zip(rows, fps, roots(fps))}
    got = simhash.near_duplicates(awkward).collect()
    assert len(got) == len(AWKWARD)
    assert all((r["fp"] & (2**64 - 1), r["component_id"]) == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    kept = simhash.keep(awkward)
    assert kept.columns == awkward.columns
    assert counted(r["doc_id"] for r in kept.collect()) == counted({c for _, c in want.values()} | {None})
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_an_id_with_several_texts_joins_their_components(spark):
    said = [" ".join(f"{name}{i}" for i in range(40)) for name in "abc"]
    got = simhash.near_duplicates(frame(spark, [(5, said[0]), (5, said[1]), (7, said[1]), (6, said[0]), (9, said[2])])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(5, 5), (5, 5), (6, 5), (7, 5), (9, 9)]


@pytest.mark.parametrize("keep", [simhash.keep, near_copies.keep])
def test_null_and_repeated_ids_lose_no_text(spark, keep):
    said = [" ".join(f"{name}{i}" for i in range(40)) for name in "abcdefghijkl"]
    rows = [*((None, x) for x in said[:10]), (None, said[0]), (7, said[10]), (7, said[11]), (8, said[11])]
    got = counted((r["doc_id"], r["text"]) for r in keep(frame(spark, rows)).collect())
    assert got == counted([*((None, x) for x in said[:10]), (7, said[10]), (7, said[11])])


def brute_copies(rows):
    """The ids that stay: five-word shingles, every pair of similarity 0.8 or more linked; ids are distinct."""
    sets = []
    for _, x in rows:
        words = (x or "").encode().lower().split()
        sets.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if of[i] != of[j] and (5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                of = [of[j] if o == of[i] else o for o in of]
    least = {}
    for (i, _), o in zip(rows, of):
        least[o] = min(i, least.get(o, i))
    return counted(least.values())


def edited(seed=9):
    """Groups of texts with some words changed, chains among them, and one line that many have."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    out = []
    for g in range(25):
        text = [word() for _ in range(r.choice([3, 5, 12, 60, 64, 300]))]
        for _ in range(r.randrange(1, 14)):
            out.append(" ".join(text + (["all", "rights", "of", "this", "page", "are", "reserved"] if g % 2 else [])))
            for _ in range(r.randrange(0, 3)):
                text[r.randrange(len(text))] = word()
    r.shuffle(out)
    return list(enumerate(out))


def test_pipeline_links_every_pair_as_similar_as_eight_tenths(spark, docs, texts):
    import corpus_pipeline

    words = [f"w{i}" for i in range(64)]
    pair = [(2, " ".join(words)), (56, " ".join([*words[:30], "other", *words[31:]]))]
    assert (brute_fingerprint(pair[0][1]) ^ brute_fingerprint(pair[1][1])).bit_count() > 3
    for rows in (pair, edited(), [r for r in {i: (i, x) for i, x in AWKWARD if i is not None}.values()], []):
        source = frame(spark, rows)
        kept = corpus_pipeline.near_copies(spark, source, SF)
        assert kept.columns == source.columns
        assert counted(r["doc_id"] for r in kept.collect()) == brute_copies(rows)
    assert counted(r["doc_id"] for r in near_copies.keep(docs).collect()) == brute_copies(texts)


def test_a_line_of_many_documents_gives_no_pairs(spark, monkeypatch):
    r, line = random.Random(3), " ".join(f"line{i}" for i in range(20))
    said = [" ".join(f"w{r.randrange(9000)}" for _ in range(70)) for _ in range(500)]
    rows = [(i, f"{x} {line}" if i % 2 else x) for i, x in enumerate(said)] + [(1000, said[1] + " " + line + " more")]
    asked, verified = [], shingle_join.verified

    def counting_(pairs, *rest):
        asked.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(shingle_join, "verified", counting_)
    kept = near_copies.keep(frame(spark, rows)).collect()
    assert counted(x["doc_id"] for x in kept) == counted(range(500))
    assert sum(asked) < 10


# --- neighbours


@pytest.mark.parametrize("chunk", [4096, 3])
def test_neighbours(spark, monkeypatch, chunk):
    monkeypatch.setattr(neighbours, "CHUNK", chunk)
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.standard_normal(20)]) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(60)]  # one hot vector
    rows += [(3000, None), (3100, [0.0] * 20), (3200, [float("nan")] * 20), (3300, [1.0, None] * 10), (3400, [1.0]), (3500, [float("inf")] * 20), (1, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("ids", F.lit(1)).repartition(3)
    good = [(i, v) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows if v and len(v) == 20 and all(x is not None and math.isfinite(x) for x in v) and any(v))]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    got = collections.defaultdict(list)
    for row in neighbours.search(df).orderBy("query_id", "rank").collect():
        got[row["query_id"]].append((row["vec_id"], row["score"]))
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[np.flatnonzero(ids == q)[0]]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        want = np.lexsort((ids, d))[:10]
        hits += len(set(ids[want].tolist()) & {i for i, _ in found})
        assert all(s == pytest.approx(d[ids == i][0]) for i, s in found) and len(found) == 10
    assert hits >= 0.9 * 10 * len(got)
    assert neighbours.search(df.limit(0)).count() == 0


def test_neighbours_of_several_lengths(spark):
    r = np.random.default_rng(4)
    rows = [(100 * i, [float(x) for x in r.standard_normal(3 + i % 2)]) for i in range(8)]
    got = collections.defaultdict(list)
    for row in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).orderBy("query_id", "rank").collect():
        got[row["query_id"]].append(row["vec_id"])
    for i, v in rows:
        d = sorted((math.dist(v, w), j) for j, w in rows if j != i and len(w) == len(v))
        assert got[i] == [j for _, j in d[:3]]


def test_error_bound_holds_nearly_always():
    r = np.random.default_rng(2)
    x, q = r.standard_normal((4000, 64)), r.standard_normal((20, 64))
    codes = neighbours.Codes(x[:1000])
    parts = codes.encode(x)
    assert np.mean([(codes.search(v, *parts)[1] <= ((x - v) ** 2).sum(axis=1) + 1e-9).mean() for v in q]) > 0.98


# --- quality


def test_classifier_on_held_out_labels(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_pu.classify(d, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([s >= 0.3 for s in good]) > 0.97 and np.mean([s < 0.3 for s in bad]) > 0.7
    assert 0.6 < rows[0]["prior"] < 0.95


def test_positive_unlabelled_risk_and_gradient():
    """Against the definition, row by row, and against differences of it."""
    r = np.random.default_rng(7)
    p, u = r.standard_normal((30, 4)) + 1, r.standard_normal((50, 4))
    seen = set()
    for _ in range(60):
        w, prior = r.standard_normal(4) * 2, r.uniform(0.1, 0.95)
        loss = lambda z: math.log1p(math.exp(-z))
        below = sum(loss(-(x @ w)) for x in u) / len(u) - prior * sum(loss(-(x @ w)) for x in p) / len(p)
        assert quality_pu.risk(w, p, u, prior) == pytest.approx(prior * sum(loss(x @ w) for x in p) / len(p) + max(0, below))
        what = (lambda v: quality_pu.risk(v, p, u, prior)) if below >= 0 else (lambda v: -quality_pu.as_negatives(v, p, u, prior))
        slopes = [(what(w + h) - what(w - h)) / 2e-6 for h in np.eye(4) * 1e-6]
        assert quality_pu.risk_gradient(w, p, u, prior) == pytest.approx(slopes, abs=1e-6)
        seen.add(below >= 0)
    assert seen == {True, False}


def test_scores_are_those_of_the_model(spark, docs, texts):
    """Each text's features, counted here, through the trained weights."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_pu.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality_pu.classify(docs, labels).collect()}
    group = lambda b: next((k for k, chars in enumerate(quality_pu._GROUPS, 1) if b in chars), 0)
    for i, x in texts[:60]:
        data = (x or "").encode()
        pairs = collections.Counter((group(a), group(b)) for a, b in zip(data, data[1:]))
        f = quality_pu.features(x or "")
        if data.split():
            assert all(f[a * quality_pu.CLASSES + b] == pytest.approx(math.sqrt(n / (len(data) - 1))) for (a, b), n in pairs.items())
        z = sum(w * min(8, max(-8, (v - m) / s)) for w, v, m, s in zip(model.weights, f, model.mean, model.scale)) + model.weights[-1]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6)


def test_classifier_on_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality_pu.classify(awkward, labels).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert quality_pu.classify(frame(spark, []), labels).count() == 0
    assert quality_pu.keep(awkward, labels.limit(0)).columns == awkward.columns


def brute_counts(text):
    words = (text or "").encode().split()
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = collections.Counter(grams)
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 5)}
    lines, again = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            again += line in lines
            lines.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), again, len(covered), failed


@pytest.mark.parametrize("which", ["plain", "awkward"])
def test_rule_counts(spark, docs, texts, awkward, which):
    source, rows = {"plain": (docs, texts), "awkward": (awkward, AWKWARD)}[which]
    got = counted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules.apply_rules(source).collect())
    assert got == counted((i, *brute_counts(x)) for i, x in rows)
    assert quality_rules.apply_rules(frame(spark, [])).count() == 0
    assert quality_rules.keep(source).columns == source.columns


def test_rules_keep_good_texts_and_drop_junk(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_rules.apply_rules(d).join(labels, "doc_id").where("not base_failed").collect()
    assert np.mean([r["kept"] for r in rows if r["quality"] == 1]) > 0.99
    assert np.mean([not r["kept"] for r in rows if r["quality"] == 0]) > 0.4


def test_rules_on_texts_of_many_lines(spark):
    """Training takes bounded pieces of them, however long they are."""
    import tracemalloc

    line = lambda i: "every{0} sentence{0} has{0} some{0} more{0} words{0}, all{0} its{0} own{0}.".format("".join(chr(97 + int(d)) for d in str(i)))
    many = "\n".join(map(line, range(100_000)))
    rows = [(i, "\n".join(line(i * 10 + j) for j in range(8))) for i in range(50)] + [(100, many), (101, "x" * 4_000_000), (102, "menu | home | about | more\n" * 20_000)]
    source = frame(spark, rows)
    tracemalloc.start()
    model = quality_rules.train(source)
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(source, model).collect()}
    assert got[100]["n_lines"] == 100_000 and got[100]["kept"] and got[1]["kept"] and not got[101]["kept"] and not got[102]["kept"]


def test_crf_gradient_is_that_of_the_likelihood():
    """One small step against differences of the log-likelihood, summed over all labellings."""
    import itertools

    r = np.random.default_rng(5)
    docs_ = [(r.standard_normal((n, 3)), r.integers(0, 2, n)) for n in (1, 4, 3)]

    def likelihood(e, t):
        def score(f, y):
            return sum(e[a] @ x for a, x in zip(y, f)) + sum(t[a, b] for a, b in zip(y, y[1:]))

        return sum(score(f, y) - np.logaddexp.reduce([score(f, z) for z in itertools.product((0, 1), repeat=len(y))]) for f, y in docs_) / sum(len(y) for _, y in docs_)

    zero_e, zero_t, h = np.zeros((2, 3)), np.zeros((2, 2)), 1e-5
    # the first step of the training moves every weight by the step's length in the direction of its gradient
    model = crf.LineCRF.fit(docs_, rounds=1, step=1e-3, shrink=0)
    for name, zero in (("emission", zero_e), ("transition", zero_t)):
        for at in np.ndindex(zero.shape):
            up = {"emission": zero_e.copy(), "transition": zero_t.copy()}
            up[name][at] = h
            slope = (likelihood(up["emission"], up["transition"]) - likelihood(zero_e, zero_t)) / h
            assert getattr(model, name)[at] == pytest.approx(1e-3 * slope / math.sqrt(slope * slope + 1e-8), rel=2e-2, abs=2e-6)


def brute_verdict(text, model):
    """The verdict from every labelling's score."""
    import itertools

    lines, again = quality_rules.lines_of(text or "")
    if brute_counts(text)[-1]:
        return False
    f = crf.line_features(lines, again)
    best = max(itertools.product((0, 1), repeat=len(lines)), key=lambda y: sum(model.emission[a] @ x for a, x in zip(y, f)) + sum(model.transition[a, b] for a, b in zip(y, y[1:])))
    return sum(len(x.split()) for x, y in zip(lines, best) if y) >= 0.5 * len((text or "").encode().split())


def test_verdicts_are_those_of_the_best_labelling(spark, docs, texts):
    model = quality_rules.train(docs)
    got = {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(docs, model).collect()}
    short = [(i, x) for i, x in texts if len(quality_rules.lines_of(x or "")[0]) <= 10]
    assert len(short) > 40 and all(got[i] == brute_verdict(x, model) for i, x in short)


def test_viterbi_is_the_best_of_all_labellings():
    import itertools

    r = np.random.default_rng(3)
    model = crf.LineCRF(r.standard_normal((2, 4)), r.standard_normal((2, 2)))
    for _ in range(20):
        x = r.standard_normal((6, 4))
        total = lambda y: sum(model.emission[a] @ f for a, f in zip(y, x)) + sum(model.transition[a, b] for a, b in zip(y, y[1:]))
        assert total(model.decode(x)) == pytest.approx(max(map(total, itertools.product((0, 1), repeat=6))))


def test_crf_training_learns_a_chain():
    r = np.random.default_rng(4)
    docs_ = []
    for _ in range(60):
        y = np.cumsum(r.random(30) < 0.08) % 2
        docs_.append((np.stack([np.ones(30), y + r.standard_normal(30)], axis=1), y))
    model = crf.LineCRF.fit(docs_)
    alone = np.mean([((f[:, 1] > 0.5) == y).mean() for f, y in docs_])
    assert np.mean([(np.array(model.decode(f)) == y).mean() for f, y in docs_]) > alone + 0.05
    assert model.transition[0, 0] > model.transition[0, 1]


# --- language model


@pytest.mark.parametrize("which", ["plain", "awkward", "empty"])
def test_language_model_base(spark, docs, texts, awkward, which):
    source, rows = {"plain": (docs, texts), "awkward": (awkward, AWKWARD), "empty": (frame(spark, []), [])}[which]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda x: [*(x or "").encode().lower().split(), "end"]
    c = collections.Counter(w for i, x in rows if not held(i) for w in tokens(x))
    n, v = sum(c.values()), len(c)
    got = hpylm.score(source).collect()
    key = lambda i, k, t, h: (str(i), k, t, h)
    assert counted(key(r["doc_id"], r["n_tokens"], r["n_known"], r["held_out"]) for r in got) == counted(key(i, len(tokens(x)), sum(c[w] > 0 for w in tokens(x)), held(i)) for i, x in rows)
    want = sorted(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(x)) for _, x in rows)
    assert np.allclose(sorted(r["base_score"] for r in got), want) and all(r["train_tokens"] == n for r in got)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def brute_model(rows, samples=0, burn_in=0, seed=1):
    """Mean log10 per text by a plain sampler: customers of one dish seated anew one by one, both levels in turn."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda x: [*(x or "").encode().lower().split(), b"\n"]
    words, pairs = collections.Counter(), collections.Counter()
    for i, x in rows:
        if not held(i):
            words.update(tokens(x))
            pairs.update(zip([b"\n", *tokens(x)], tokens(x)))
    (s1, d1), (s2, d2), v = hpylm.PARENT, hpylm.CONTEXT, len(words)
    rng = random.Random(seed)
    t = dict.fromkeys(pairs, 1)
    k, tables = collections.Counter(w for _, w in pairs), collections.Counter(a for a, _ in pairs)
    own = dict.fromkeys(k, 1)

    def lower(w):
        return (k[w] - d1 * own.get(w, 0) + (s1 + d1 * sum(own.values())) / (v + 1)) / (s1 + sum(k.values()))

    def again(c, level, others, p):
        n = seats = 1
        while n < c:
            new = (level[0] + level[1] * (others + seats)) * p
            seats += rng.random() < new / (new + n - level[1] * seats)
            n += 1
        return seats

    kept = collections.defaultdict(list)
    for sweep in range(burn_in + samples or 1):
        if samples:
            for a, w in pairs:
                fresh = again(pairs[a, w], hpylm.CONTEXT, tables[a] - t[a, w], lower(w))
                tables[a] += fresh - t[a, w]
                k[w] += fresh - t[a, w]
                t[a, w] = fresh
            for w in k:
                own[w] = again(k[w], hpylm.PARENT, sum(own.values()) - own[w], 1 / (v + 1))
        if sweep >= burn_in:
            low = {w: lower(w) for w in {w for _, x in rows for w in tokens(x)}}
            for j, (_, x) in enumerate(rows):
                kept[j].append([(pairs[a, w] - d2 * t.get((a, w), 0) + (s2 + d2 * tables[a]) * low[w]) / (s2 + words[a]) for a, w in zip([b"\n", *tokens(x)], tokens(x))])
    return [sum(map(math.log10, np.mean(kept[j], axis=0))) for j in range(len(rows))]


@pytest.mark.parametrize("which", ["plain", "awkward"])
def test_scores_without_sampling_are_exact(spark, docs, texts, awkward, which):
    """Whatever the chunks, also those of pieces of a text, and however the table is split into tasks."""
    source, rows = {"plain": (docs, texts), "awkward": (awkward, AWKWARD)}[which]
    want = sorted(brute_model(rows))
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for chunk, size in ((1 << 20, split), (1000, "64k")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert np.allclose(sorted(r["score"] for r in hpylm.score(source, samples=0, chunk=chunk).collect()), want, rtol=1e-9)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)


def test_sampled_scores_are_near_a_plain_sampler(spark):
    r = random.Random(8)
    rows = [(i, " ".join(f"w{int(r.paretovariate(0.7)) % 60}" for _ in range(50))) for i in range(80)]
    want = brute_model(rows, samples=10, burn_in=10)
    got = {x["doc_id"]: x["score"] for x in hpylm.score(frame(spark, rows), samples=6).collect()}
    assert all(got[i] == pytest.approx(w, rel=0.03) for (i, _), w in zip(rows, want))
    assert sum(got.values()) == pytest.approx(sum(want), rel=0.01)


def test_sampled_scores_are_the_same_each_time(spark, docs):
    """Also when the table is split into other tasks and its texts into other chunks."""
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    one = {r["doc_id"]: r["score"] for r in hpylm.score(docs).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    two = {r["doc_id"]: r["score"] for r in hpylm.score(docs, chunk=50_000).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    assert all(s == pytest.approx(two[i], rel=1e-9) for i, s in one.items())


def test_held_out_texts_are_scored_better_than_the_base(spark):
    rows = hpylm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows) + 0.3 * sum(r["n_tokens"] for r in rows)


def test_pieces_of_a_text_join_up():
    r = random.Random(2)
    for _ in range(50):
        data = "".join(r.choice("ab \n\t") for _ in range(r.randrange(0, 300))).encode()
        words = []
        for piece, skip, end in hpylm.pieces(data, 20):
            own = piece.split()
            assert not skip or own[0] == words[-1]
            words += own[skip:]
        assert words == data.split() and end


@pytest.mark.parametrize("c, strength, d, parent, others", [(300, 2.0, 0.6, 0.3, 0), (4000, 1.0, 0.8, 0.05, 2000), (4000, 1.0, 0.5, 1e-4, 50)])
def test_seating_follows_the_restaurant(c, strength, d, parent, others):
    """Tables of c customers of one dish against the exact recurrence: mean and spread."""
    rng, times = np.random.default_rng(1), 40_000
    drawn = hpylm.seat(rng, np.full(times, c), (strength, d), np.full(times, others), np.full(times, parent))
    p = np.zeros(c + 2)
    p[1] = 1
    for n in range(1, c):
        t = np.minimum(np.arange(c + 2), n)
        new = (strength + d * (others + t)) * parent
        q = new / (new + n - d * t)
        p = p * (1 - q) + np.concatenate([[0], (p * q)[:-1]])
    mean = (p * np.arange(c + 2)).sum()
    spread = math.sqrt((p * (np.arange(c + 2) - mean) ** 2).sum())
    assert abs(drawn.mean() - mean) < 4 * spread / math.sqrt(times) + 0.001 * mean
    assert drawn.std() == pytest.approx(spread, rel=0.05)


# --- pipeline


def test_pipeline_is_its_stages(spark, docs):
    import corpus_pipeline as C

    rows = {r["doc_id"]: r for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    at = docs
    for name, stage in C.STAGES[:-1]:
        at = written(stage(spark, at, SF), f"test-{name}")
        assert at.columns == docs.columns and 0 < at.count() <= len(rows)
    scores = {r["doc_id"]: r["score"] for r in quality_pu.classify(docs, labels).collect()}
    kept = [r for i, r in rows.items() if scores[i] >= 0.3]
    good = spark.createDataFrame(kept, docs.schema)
    verdict = {r["doc_id"] for r in quality_rules.apply_rules(good).where("kept").collect()}
    ids = sorted(verdict)
    firsts = sorted(brute_copies([(i, rows[i]["text"]) for i in ids]))
    left = {i: k.decode("utf-8", "replace") for (i, _, _, _, k) in brute_dedup([(i, rows[i]["text"]) for i in firsts])}
    assert {r["doc_id"]: r["text"] for r in at.collect()} == left
    pieces = C.run(spark, SF)
    t = library("word_bpe_49k.json")
    assert {r["doc_id"]: r["n"] for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in left.items()}


def test_stages_take_awkward_rows(spark, awkward):
    import corpus_pipeline as C

    for name, stage in C.STAGES:
        stage(spark, awkward, SF).collect()
        assert stage(spark, awkward.limit(0), SF).count() == 0
