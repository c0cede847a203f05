"""Each operator against brute force, on small tables with nulls, ties, repeats, empties and extra columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ripple.llm import audio, chat, common, labelled, licenses, linededup, lmscore, perfecthash, pieces, quality, setjoin, toxicity, winnow
from ripple.llm.shingles import shingle_sets

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string"


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", None, None, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


LONG = "the quick brown fox jumps over the lazy dog and runs far away"
MESSY = [None, "", " ", "\n\n", "a", LONG, LONG.upper() + "  ", f"{LONG}\nx", f"y\r\n{LONG}", f"{LONG}\n{LONG}", "é" * 39, "É" * 40 + "\n" + LONG, "word " * 3000, LONG, LONG]


def lowered(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


# ------------------------------------------------------------------ line dedup


def brute_lines(ids, texts, chars=40, least=5):
    key = lambda line: lowered(line).strip(" \t\n\v\f\r")
    holders = defaultdict(list)
    for n, t in enumerate(texts):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= chars:
                holders[k].append(n)
    rank = [-(1 << 63) if i is None else i for i in ids]
    out = []
    for n, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < least or max(rank[m] for m in holders[key(x)]) == rank[n]]
        out.append((ids[n], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [1, 20_000])  # whether shards hold the lines, or every task
@pytest.mark.parametrize("ids", [None, [None, 3, 3, 9, 1, 0, 2, 14, 14, 5, 6, None, 8, 7, 4]])
def test_line_dedup(spark, monkeypatch, ids, hot):
    monkeypatch.setattr(linededup, "HOT_KEYS", hot)
    df = docs(spark, MESSY, ids).withColumnRenamed("row", "a.b").withColumn("n_lines", F.lit("old"))
    got = linededup.dedup_lines(df)
    assert set(df.columns) < set(got.columns)
    ids = ids or list(range(len(MESSY)))
    assert sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()], key=repr) == brute_lines(ids, MESSY)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_of_many_shards(spark, monkeypatch):
    monkeypatch.setattr(linededup, "HOT_KEYS", 3)
    monkeypatch.setattr(linededup, "SHARD_KEYS", 2)
    monkeypatch.setattr(linededup, "STRETCH_BYTES", 500)
    rng = np.random.default_rng(3)
    lines = [f"line {i} that is long enough to be counted as one" for i in range(60)] + ["short"] * 5
    texts = ["\n".join(lines[int(i)] for i in np.minimum(rng.zipf(1.3, rng.integers(0, 12)), 64)) for _ in range(150)]
    got = linededup.dedup_lines(docs(spark, texts).repartition(5))
    assert sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()], key=repr) == brute_lines(list(range(150)), texts)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    lo, hi = (rng.integers(0, 2**63, 5000, dtype=np.int64).view(np.uint64) for _ in range(2))
    lo[:10] = lo[0]  # equal halves
    sizes, levels = perfecthash.build(lo, hi)
    assert sorted(perfecthash.lookup(sizes, levels, lo, hi).tolist()) == list(range(5000))
    assert perfecthash.build(lo[:0], hi[:0])[0] == []


# ------------------------------------------------------------------- set join


def brute_sets(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        out.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def brute_components(texts, k, num, den):
    sets, up = brute_sets(texts, k), list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def near_copies(seed, n=120):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    while len(texts) < n:
        base = rng.choice(words, rng.integers(3, 90)).tolist()
        for _ in range(rng.integers(1, 7)):
            copy = list(base)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(0, len(copy))] = str(rng.choice(words))
            texts.append(" ".join(copy))
    return texts[:n]


@pytest.mark.parametrize("k, num, den", [(3, 90, 100), (5, 80, 100), (1, 60, 100), (2, 99, 100)])
def test_set_join(spark, k, num, den):
    texts = [*MESSY, *near_copies(k)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.similar_components(docs(spark, texts), k=k, num=num, den=den).collect()}
    assert got == brute_components(texts, k, num, den)


def test_set_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", 4)
    texts = near_copies(3, 60)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.similar_components(docs(spark, texts), k=2, num=80, den=100).collect()}
    assert got == brute_components(texts, 2, 80, 100)


def test_set_join_edges(spark):
    df = docs(spark, [LONG, LONG, "", None, LONG + " more", "z"], [None, 4, 5, 6, 4, None])
    got = sorted(map(tuple, setjoin.similar_components(df, k=2, num=80).select("doc_id", "component_id").collect()), key=repr)
    assert got == sorted([(None, 4), (4, 4), (5, 5), (6, 6), (4, 4), (None, None)], key=repr)
    assert setjoin.similar_components(df.limit(0)).count() == 0


def brute_keep(ids, texts, k, num, den):
    """Rows that stay: of each component the least (null keys last, key, then one text, then one row)."""
    members = defaultdict(list)
    for i, (n, c) in brute_components(texts, k, num, den).items():
        members[c if n else ("alone", i)].append(i)
    kept = []
    for rows in members.values():
        least = min((ids[i] is None, ids[i] or 0) for i in rows)
        kept.append((ids[rows[0]] if len(rows) == 1 else None if least[0] else least[1], {texts[i] for i in rows if (ids[i] is None, ids[i] or 0) == least}))
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_keep_one_goes_by_row(spark, seed):
    rng = np.random.default_rng(seed)
    texts = [LONG, LONG, "wholly different words stand here", LONG, "an unrelated text of no key", LONG + " more", LONG.upper(), "", None, "", LONG, LONG, *near_copies(seed, 25)]
    ids = [1, 2, 2, None, None, 0 if seed else 9, 1, 3, 3, None, 1, None, *[None if i == 7 else int(i) for i in rng.integers(0, 8, 25)]]
    df = docs(spark, texts, ids).withColumnsRenamed({"source": "id", "lang": "a.b", "row": "text_hash"})
    kept = setjoin.keep_one(df, k=2)
    assert kept.columns == df.columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    for id_, any_of in brute_keep(ids, texts, 2, 80, 100):
        here = [x for x in left if x[0] == id_ and x[1] in any_of]
        assert here
        left.remove(here[0])
    assert not left
    assert setjoin.keep_one(df.limit(0)).count() == 0


def test_hot_keys_of_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 10**9)
    rows = spark.createDataFrame([(1, i) for i in range(1500)] + [(2, 0), (3, 0), (None, 0)] + [(4, i) for i in range(1200)], "k_ long, v long")
    to = spark.createDataFrame([(1, "a"), (3, "c")], "k_ long, x string")
    got = Counter((r["k_"], r["x"]) for r in common.led(rows, "k_", to, "x", 2702).collect())
    assert got == {(1, "a"): 1500, (2, None): 1, (3, "c"): 1, (4, None): 1200}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([(90, 100), (80, 100), (60, 100)]))
def test_signatures_lose_no_pair(seed, threshold):
    """Any two sets that reach the threshold share a signature, and their sketches do not tell them apart."""
    num, den = threshold
    rng = np.random.default_rng(seed)
    base = np.unique(rng.integers(0, 2**63, rng.integers(1, 600), dtype=np.int64).view(np.uint64))
    drop, add = (int(rng.integers(0, max(1, len(base) * (den - num) // den + 1))) for _ in range(2))
    other = np.unique(np.concatenate([base[rng.permutation(len(base))[drop:]], rng.integers(0, 2**63, add, dtype=np.int64).view(np.uint64)]))
    both = len(np.intersect1d(base, other))
    if not len(other) or den * both < num * (len(base) + len(other) - both) or len(other) == len(base) == both:
        return
    sig, entry, index, facts = setjoin.signatures([base, other], setjoin.Classes(num, den))
    mine, theirs = set(sig[index[entry] == 0].tolist()), set(sig[index[entry] == 1].tolist())
    assert mine & theirs
    a, b = setjoin.compared(sig, entry, index, facts, num, den)
    assert len(a) == 1 or not setjoin.Classes(num, den).sketched


@pytest.mark.parametrize("n", [150, 180, 220, 300, 450, 700, 1200, 3000])
def test_unlike_sets_that_meet_by_chance_stay_apart(n):
    """Sets that share a signature and little else are not linked, else their components grow with the square of the corpus; those that just reach the threshold are."""
    rng = np.random.default_rng(n)
    some = lambda size: rng.integers(0, 2**63, size, dtype=np.int64).view(np.uint64)
    unlike = [np.unique(some(n)) for _ in range(600)]
    like = []
    for _ in range(300):  # n - n // 9 of n tokens are shared, so at least 8 of 10 of the union
        base = some(n)
        like += [np.unique(base), np.unique(np.concatenate([base[n // 9 :], some(n // 9)]))]
    for sets, pairs in ((unlike, 0), (like, 300)):
        _, entry, index, facts = setjoin.signatures(sets, setjoin.Classes(80, 100))
        each = np.unique(index, return_index=True)[1]  # the first entry of each set
        met = np.arange(600, dtype=np.uint64) // 2 if pairs else np.zeros(600, np.uint64)
        assert len(setjoin.compared(met, each, index, facts, 80, 100)[0]) == pairs


@pytest.mark.parametrize("n", [550, 5400])
def test_prefixes_do_not_link_unlike_sets(n):
    """Sets just below a class have many empty parts in it; that they share a token of their prefix does not link them."""
    rng = np.random.default_rng(n)
    sets = [np.unique(np.append(rng.integers(0, 2**63, n, dtype=np.int64).view(np.uint64), np.uint64(7))) for _ in range(40)]
    sig, entry, index, facts = setjoin.signatures(sets, setjoin.Classes(80, 100))
    assert np.unique(sig, return_counts=True)[1].max() > 3
    assert not len(setjoin.compared(sig, entry, index, facts, 80, 100)[0])


def test_stars_of_a_flush_lose_no_link(spark, monkeypatch):
    # Copies of one base: many with ten changed words, and two with one, which are like each other and unlike the many.
    monkeypatch.setattr(setjoin, "WIDE", 8)
    monkeypatch.setattr(setjoin, "FLUSH_ROWS", 1)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(134)]

    def changed(n, tag):
        out = list(base)
        for i in rng.choice(np.arange(9, 125), n, replace=False):
            out[i] = f"{tag}x{i}"
        return out

    def node(words):
        return int.from_bytes(setjoin.set_key(shingle_sets([" ".join(words).encode()], 5, common.Hashes())[0])[:8], "little", signed=True)

    many = [changed(10, f"h{i}") for i in range(200)]
    like, other = changed(1, "x"), max((changed(1, f"y{i}") for i in range(60)), key=node)  # not the smallest of any star
    kind, num, den = "bigint", 80, 100
    schema, linked = (setjoin.to_arrow_schema(setjoin._parse_datatype_string(x.format(kind=kind))) for x in (setjoin.SIGNED, setjoin.LINKED))
    tables, sets = [], {}
    for part, texts in enumerate(([*many, other], [like])):
        lines = [" ".join(t) for t in texts]
        batch = pa.RecordBatch.from_pydict({"id": pa.array(range(part * 100, part * 100 + len(lines)), pa.int64()), "text": lines, "text_hash": pa.array([0] * len(lines), pa.int64()), "h": pa.array([1] * len(lines), pa.int64())})
        for row in setjoin._signed(iter([batch]), 5, num, den, 1, schema):
            tables.append(pa.Table.from_batches([row]))
        for x in shingle_sets([t.encode() for t in lines], 5, common.Hashes()):
            sets[int.from_bytes(setjoin.set_key(x)[:8], "little", signed=True)] = set(x.tolist())
    got = setjoin._bucket_links(pa.concat_tables(tables), linked, num, den)
    names = sorted(sets)
    links = setjoin.Union(len(names))
    for a, b in zip(got.column("a").to_pylist(), got.column("b").to_pylist(), strict=True):
        if a is not None:
            links.join(names.index(a), names.index(b))
    pairs = [(a, b) for a in names for b in names if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    assert (min(node(like), node(other)), max(node(like), node(other))) in pairs
    for a, b in pairs:
        assert links.find(names.index(a)) == links.find(names.index(b))


def test_what_a_signature_sends_does_not_grow_with_shards(spark):
    """However many shards there are, a set's sketch does not go to each of them."""
    rng = np.random.default_rng(3)
    lines = [" ".join(map(str, rng.integers(0, 10**6, 300))) for _ in range(200)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(200), pa.int64()), "text": lines, "text_hash": pa.array([0] * 200, pa.int64()), "h": pa.array([1] * 200, pa.int64())})
    schema = setjoin.to_arrow_schema(setjoin._parse_datatype_string(setjoin.SIGNED.format(kind="bigint")))
    n = len(setjoin.signatures(shingle_sets([t.encode() for t in lines], 5, common.Hashes()), setjoin.Classes(80, 100))[0])
    sent = []
    for shards in (10, 5000):
        rows = pa.Table.from_batches(list(setjoin._signed(iter([batch]), 5, 80, 100, shards, schema)))
        sent.append(sum(len(x or b"") for c in ("sigs", "nodes", "who", "facts") for x in rows.column(c).to_pylist()))
    assert sent[0] == sent[1] < 12 * n


def test_links_do_not_grow_with_shards(spark, monkeypatch):
    """Similar sets meet in many shards, but are linked in few; those that only late parts link are linked too."""
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(40):
        base = [f"w{i}" for i in rng.integers(0, 10**6, 300)]
        for changes in (0, 1, 3, 5):  # the last share a few of some ninety parts
            copy = list(base)
            for i in rng.choice(np.arange(5, 295), changes, replace=False):
                copy[i] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(copy))
    made, written = [], setjoin.written

    def counted(df, name):
        out = written(df, name)
        made[-1] += out.count() if name == "links" else 0
        return out

    monkeypatch.setattr(setjoin, "written", counted)
    df = docs(spark, texts).repartition(2, "doc_id").withColumn("h", F.xxhash64("doc_id")).select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("text_hash"), "h")
    schema = setjoin.to_arrow_schema(setjoin._parse_datatype_string(setjoin.SIGNED.format(kind="bigint")))
    for shards in (2, 150):
        made.append(0)
        signed = df.mapInArrow(lambda it, n=shards: setjoin._signed(it, 5, 80, 100, n, schema), setjoin.SIGNED.format(kind="bigint"))
        each, links = setjoin._sketched(signed, "bigint", len(texts), 80, 100)
        near = common.connected_components(links)
        got = {r["id"]: r["component"] for r in each.join(near, "node").select("id", "component").collect()}
        groups = defaultdict(set)
        for i, (_, c) in brute_components(texts, 5, 80, 100).items():
            groups[c].add(got[i])
        assert all(len(x) == 1 for x in groups.values())
    assert made[1] < 20 * len(texts) and made[1] < 4 * made[0]


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in pairs if a != b for x in (a, b)}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_without(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d")], "k long, v string")
    gone = spark.createDataFrame([(2,), (None,), (9,)], "k long")
    assert [tuple(r) for r in common.without(df, gone, {"k": F.col("k")}).collect()] == [(1, "a")]
    assert common.without(df, gone.limit(0), {"k": F.col("k")}).count() == 4
    pairs = spark.createDataFrame([(2, "b"), (None, "x")], "k long, w string")
    assert sorted(map(str, common.without(df, pairs, {"k": F.col("k"), "w": F.col("v")}).select("v").collect())) == ["Row(v='a')", "Row(v='c')", "Row(v='d')"]


# ---------------------------------------------------------------- decontamination


def brute_hits(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = defaultdict(set)
    for item, t in items:
        w = words(t)
        if w and item is not None:
            n = min(8, len(w))
            for i in range(len(w) - n + 1):
                windows[tuple(w[i : i + n])].add(str(item))
    lengths, out = {len(w) for w in windows}, []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= x
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return out


@pytest.mark.parametrize("size, block", [(16 << 20, 96), (0, 5), (16 << 20, 3)])
def test_decontamination(spark, monkeypatch, size, block):
    monkeypatch.setattr(winnow, "BROADCAST_BYTES", size)
    monkeypatch.setattr(winnow, "BLOCK", block)
    items = [(1, LONG), (2, LONG + " tonight"), (10, "one two three"), (3, "solo"), (4, ""), (5, None), (None, "far away"), (6, "É é one two three four five six seven eight nine"), (1, LONG)]
    texts = [*MESSY, "He said: " + LONG.replace(" ", "--") + "!", "one two THREE four", "solo, one two three; one two three", "É é one two three four five six seven eight nine ten", "e é one two three four five six"]
    known = spark.createDataFrame(items, "item_id long, text string")
    got = winnow.contamination(docs(spark, texts), known).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_hits(texts, items)
    assert winnow.contamination(docs(spark, texts), known.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert winnow.contamination(docs(spark, texts).limit(0), known).count() == 0
    left = winnow.decontaminate(docs(spark, texts), known, min_items=2)
    assert {r["doc_id"] for r in left.collect()} == {i for i, h in enumerate(brute_hits(texts, items)) if not h[4]} and "row" in left.columns


def test_decontamination_of_repeated_keys(spark):
    known = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    got = winnow.contamination(docs(spark, [LONG, "other", LONG, None], [7, 7, None, None]), known, min_items=1)
    assert sorted((str(r["doc_id"]), r["n_hit"] > 0) for r in got.collect()) == [("7", False), ("7", True), ("None", False), ("None", True)]
    left = winnow.decontaminate(docs(spark, [LONG, "other", LONG, None, "other", f"x {LONG}"], [7, 7, None, None, 7, 7]).withColumnRenamed("row", "a.b"), known)
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in left.collect()) == [("7", "other"), ("7", "other"), ("None", "None")] and "a.b" in left.columns


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_every_shared_span_is_found(spark, seed):
    rng = np.random.default_rng(seed)
    texts = [" ".join(rng.choice(["a", "b", "c"], rng.integers(0, 300))) for _ in range(12)]
    items = [(int(i), " ".join(rng.choice(["a", "b", "c"], rng.integers(1, 14)))) for i in range(8)]
    got = winnow.contamination(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_hits(texts, items)


# -------------------------------------------------------------------- licences


def test_licenses(spark):
    texts = [None, "", *[f"some text {t} and more" for t in licenses.TEMPLATES.values()], "RELEASED under the  mit-license", "released under the mit", licenses.TEMPLATES["Apache-2.0"].replace("You", "He")]
    names = list(licenses.TEMPLATES)
    got = licenses.scan(docs(spark, texts), licenses.templates(spark)).collect()
    found = {(r["doc_id"], r["license"]) for r in got}
    assert {(i + 2, n) for i, n in enumerate(names)} <= found
    assert (len(names) + 2, "MIT-notice") in found and not any(d == len(names) + 3 for d, _ in found)
    repeated = licenses.scan(docs(spark, [texts[2]] * 3 + [texts[2]], [None, None, 4, 4]), licenses.templates(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in repeated if r["license"] == names[0]) == ["4", "None"]  # equal rows give one result
    assert licenses.scan(docs(spark, texts).limit(0), licenses.templates(spark)).count() == 0
    assert licenses.scan(docs(spark, texts), licenses.templates(spark).limit(0)).count() == 0


def brute_contained(texts, known, least):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    forms, out = [(n, words(t)) for n, t in known], {}
    held = {n: [" ".join(w[i : i + 5]) for i in range(len(w) - 4)] for n, w in forms}
    for d, t in enumerate(texts):
        w = words(t)
        has = {}
        for i in range(len(w) - 4):
            has.setdefault(" ".join(w[i : i + 5]), sum(len(x) + 1 for x in w[:i]) + 1)
        for n, s in held.items():
            both = set(s) & set(has)
            if s and len(both) >= least * len(set(s)):
                out[d, n] = (len(set(s)), len(both), min(has[x] for x in both))
    return out


@pytest.mark.parametrize("planned", [20_000, 10])
def test_recall_over_a_thousand_templates(spark, monkeypatch, planned):
    """Whole licences of up to 800 words, met as edited copies: of the pairs that are contained, how many are found."""
    monkeypatch.setattr(licenses, "PLAN_BANDS", planned)
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    n = 1000 if planned > 10 else 60
    known = [(f"L{i}", " ".join(rng.choice(vocabulary, int(rng.integers(5, 800 if i % 10 == 0 else 60))))) for i in range(n)]
    texts = []
    for i in rng.integers(0, n, 150):
        w = known[i][1].split()
        for _ in range(rng.integers(0, 1 + len(w) // 40)):
            w[rng.integers(0, len(w))] = "edited"
        texts.append(" ".join([*rng.choice(vocabulary, int(rng.integers(0, 200))), *w, *rng.choice(vocabulary, 20)]))
    want = brute_contained(texts, known, 0.8)
    got = {(r["doc_id"], r["license"]): (r["n_shingles"], r["n_found"], r["first_char"]) for r in licenses.scan(docs(spark, texts), spark.createDataFrame(known, "license string, text string")).collect()}
    assert all(want[k] == v for k, v in got.items())
    assert len(want) > 100 and len(got) >= 0.99 * len(want)


# ------------------------------------------------------------------ language models


def brute_losses(texts, flags):
    from math import log

    tokens = [(t or "").encode().lower().split() for t in texts]
    uni, bi, n = [Counter(), Counter()], [Counter(), Counter()], [0, 0]
    for w, f in zip(tokens, flags, strict=True):
        if w:
            s = ["<b>", *w, "<e>"]
            for m in (0, 1) if f else (0,):
                uni[m].update(s)
                bi[m].update(zip(s, s[1:], strict=False))
                n[m] += len(s) - 1
    out = []
    for w in tokens:
        row = [len(w)]
        for m in (1, 0):
            s, total = ["<b>", *w, "<e>"], 0.0
            for a, b in zip(s, s[1:], strict=False):
                total -= log((bi[m][a, b] + 50 * (uni[m][b] + 1) / (n[m] + 65535)) / (uni[m][a] + 50))
            row.append(total / (len(w) + 1) if w else 0.0)
        out.append(row)
    return out


@pytest.mark.parametrize("flags", [[True] * 15, [i % 2 == 0 for i in range(15)], [False] * 15])
def test_language_models(spark, flags):
    df = docs(spark, MESSY).withColumn("lang", F.element_at(F.array(*map(F.lit, flags)), (F.col("doc_id") + 1).cast("int")))
    got = lmscore.cross_entropy_difference(df, F.col("lang") == "true" if dict(df.dtypes)["lang"] == "string" else F.col("lang")).orderBy("doc_id").collect()
    want = brute_losses(MESSY, flags)
    for r, w in zip(got, want, strict=True):
        assert r["n_tokens"] == w[0]
        assert [r["target_loss"], r["background_loss"], r["ce_difference"]] == pytest.approx([w[1], w[2], w[1] - w[2]], abs=1e-5)
    assert lmscore.cross_entropy_difference(df.limit(0), F.lit(None).cast("boolean")).count() == 0
    assert lmscore.cross_entropy_difference(docs(spark, [None, "", "a b"], [None, None, 1]), F.lit(None).cast("boolean")).count() == 3


@pytest.mark.parametrize("numbered, often", [(0, 4096), (1, 4096), (5, 3), (65_533, 0), (65_533, 4096), (30, 4096)])
def test_rare_words_and_frequent_bigrams(spark, monkeypatch, numbered, often):
    monkeypatch.setattr(lmscore, "HOT_BIGRAMS", max(1, often))
    if not often:
        monkeypatch.setattr(lmscore.Vocabulary, "charge", lambda self, first, last, counts: None)
    monkeypatch.setattr(lmscore, "SHARD_BIGRAMS", 50)
    monkeypatch.setattr(lmscore, "STRETCH_DOCS", 7)
    texts = [*MESSY, *near_copies(6, 40), "rare", "rare rare rare other"]
    flags = [i % 3 == 0 for i in range(len(texts))]
    got = lmscore.cross_entropy_difference(docs(spark, texts), F.col("doc_id") % 3 == 0, vocabulary=numbered).orderBy("doc_id").collect()
    for r, w in zip(got, brute_losses(texts, flags), strict=True):
        assert [r["target_loss"], r["background_loss"], r["ce_difference"]] == pytest.approx([w[1], w[2], w[1] - w[2]], abs=1e-5)


def test_language_models_for_any_batch_size(spark):
    """Long runs of texts without words, and short texts, in one task."""
    n = 150_000
    df = spark.range(n, numPartitions=1).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 90_000, F.when(F.col("id") % 2 == 0, F.lit(" "))).otherwise(F.concat(F.lit("w"), (F.col("id") % 7).cast("string"))).alias("text"))
    found = []
    for size in ("100", "10000", "200000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        spark.conf.set(common.BATCH_CONF, "64m")
        try:
            got = lmscore.cross_entropy_difference(df, F.col("doc_id") % 2 == 0)
            found.append(got.agg(F.count("*"), F.countDistinct("doc_id"), F.sum("n_tokens"), F.sum(F.round(F.col("background_loss") * 1e6).cast("long")), F.count_if(F.col("background_loss") > 0)).first())
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
            spark.conf.unset(common.BATCH_CONF)
    assert found[0] == found[1] == found[2] and found[0][0] == found[0][1] == n and found[0][4] == 60_000


def test_packed_numbers():
    for values in ([], [0, 255], [256], [65_535, 0], [65_536], [2**32 - 1], [2**40, 3]):
        assert lmscore._unpacked(lmscore._packed(np.array(values, dtype=np.int64))).tolist() == values


# ------------------------------------------------------------------------ chat


def test_chat_round_trip(spark):
    nasty = [chat.PROBE, "<|", "<\\|x", "<\\\\|im_end|>", "<<|>>", "plain\n<|im_start|>user\n", "", None, "é<|\\"]
    rows = [(c, t, role, text, "extra") for c in (1, None) for t, (role, text) in enumerate(zip(["system", "user", "assistant", "assistant", None, "ro\nle%0A<|", "user", "assistant", "assistant"], nasty, strict=True))]
    rows += [(2, 0, "user", "same", ""), (2, 0, "user", "same", ""), (2, None, "assistant", "first", ""), (3, 5, "user", "only", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, nth string")
    got = {r["conv_id"]: r for r in chat.digests(chat.render(chat.fold(chat.log(df)))).collect()}
    by = defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append(((-1 if t is None else t), role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = [x for _, role, x in turns if role == "assistant"]
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest())
    assert chat.digests(chat.render(chat.fold(chat.log(df.limit(0))))).count() == 0


@given(st.text(alphabet="<|\\im_endstart>\n %0A", max_size=60))
def test_escaping_reverses(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_events_fold(spark):
    log = [(1, 0, 1, 0, "start", "user", ""), (1, 0, 1, 2, "delta", "", "b"), (1, 0, 1, 1, "delta", "", "a"), (1, 1, 1, 0, "start", "assistant", None), (1, 1, 1, 1, "delta", None, "bad"), (1, 1, 1, 2, "regenerate", None, None), (1, 1, 1, 3, "delta", None, "good"),
           (1, 2, 1, 0, "start", "user", ""), (1, 2, 1, 1, "delete", "", ""), (1, 3, 1, 0, "start", "user", ""), (1, 3, 1, 1, "delta", "", "x"), (1, 3, 1, 2, "edit", "", "y"), (1, 3, 1, 3, "delta", "", "z"), (1, 4, 1, 0, "delta", "", "lost")]
    # One sequence for the conversation: the messages of later turns that the regeneration (at 5) undoes come before it, others after.
    log = [(c, t, n, {(0, 0): 0, (0, 1): 1, (0, 2): 2, (1, 0): 3, (1, 1): 4, (1, 2): 5, (1, 3): 9}.get((t, s), 10 * t + s), e, r, x) for c, t, n, s, e, r, x in log]
    log += [(1, 3, 2, 4, "start", "user", ""), (1, 3, 2, 4, "delta", "", "undone"), (1, 0, 1, 99, "edit", "", "edited last")]
    events = spark.createDataFrame(log, "conv long, turn long, nth int, seq int, event string, role string, text string")
    assert [(r["turn"], r["role"], r["text"]) for r in chat.fold(events).orderBy("turn").collect()] == [(0, "user", "edited last"), (1, "assistant", "good"), (3, "user", "yz")]


def plain_fold(events):
    """Each conversation in sequence, one event after another."""
    out = {}
    for c, t, n, _, event, role, text in sorted(events, key=lambda e: (repr(e[0]), -1 if e[3] is None else e[3], e[4], e[6] or "")):
        at = (c, t, n)
        if event == "start":
            out[at] = [role or "", ""]
        elif at in out and event == "delta":
            out[at][1] += text or ""
        elif at in out and event == "edit":
            out[at][1] = text or ""
        elif event == "delete":
            out.pop(at, None)
        elif event == "regenerate":
            if at in out:
                out[at][1] = ""
            for x in [x for x in out if x[0] == c and (x[1] is None, 0) != (True, 0) and x[1] is not None and (t is None or x[1] > t)]:
                del out[x]
    return {(*k, *v) for k, v in out.items()}


@pytest.mark.parametrize("seed", range(4))
def test_fold_against_a_plain_one(spark, seed):
    rng = np.random.default_rng(seed)
    events = []
    for c in (1, 2, None):
        for seq in range(120):
            t = [None, 0, 1, 2, 3, 4][rng.integers(0, 6)]
            events.append((c, t, int(rng.integers(1, 3)), seq, str(rng.choice(["start", "delta", "edit", "regenerate", "delete"], p=[0.3, 0.45, 0.1, 0.08, 0.07])), str(rng.choice(["user", "assistant"])), str(rng.choice(["a", "b", "c"]))))
    df = spark.createDataFrame([events[i] for i in rng.permutation(len(events))], "conv long, turn long, nth int, seq int, event string, role string, text string")
    assert {tuple(r) for r in chat.fold(df).collect()} == plain_fold(events)


def test_long_conversation(spark):
    said = "x<|im_end|>" * 400_000
    rows = [(1, 0, "user", said), (1, 1, "assistant", said[::-1]), (1, 2, "user", None)]
    got = chat.digests(chat.render(chat.fold(chat.log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))).first()
    assert got["n_turns"] == 3 and got["loss_sha256"] == hashlib.sha256(said[::-1].encode()).hexdigest()


# ----------------------------------------------------------------------- audio


def test_companding_tables():
    mu, a = audio.mulaw_table(), audio.alaw_table()
    # Known values of G.711.
    assert (mu[0xFF], mu[0x7F], mu[0x00], mu[0x80], mu[0xFE]) == (0, 0, -32124, 32124, 8)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def plain_adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(audio.IMA_STEPS[index])
            diff = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
            value = max(-32768, min(32767, value - diff if nibble & 8 else value + diff))
            index = max(0, min(88, index + int(audio.IMA_INDEX[nibble & 7])))
            out.append(value)
    return out


def test_adpcm_blocks():
    blocks = np.random.default_rng(2).integers(0, 256, (7, audio.FRAME), dtype=np.uint8)
    assert audio.adpcm_blocks(blocks).tolist() == [plain_adpcm(b.tobytes()) for b in blocks]


def test_resample():
    pcm = np.array([0, 10, 20, -30000, 30000], dtype=np.int16)
    assert audio.resample(pcm, 8000, 16000).tolist() == [0, 5, 10, 15, 20, -14990, -30000, 0, 30000, 30000]
    assert len(audio.resample(pcm, 8000, 11025)) == 6 and audio.resample(pcm, 8000, 8000).tolist() == pcm.tolist() and len(audio.resample(pcm[:0], 8000, 16000)) == 0


def plain_feature(full):
    """The features of a payload, sample by sample."""
    def stats(pcm, first):
        flips = sum((a < 0) != (b < 0) for i, (a, b) in enumerate(zip(pcm, pcm[1:], strict=False)))
        return f"{first}:rms={np.sqrt(sum(x * x for x in pcm) / len(full) if first != 'adpcm' else sum(x * x for x in pcm) / len(pcm)):.2f},peak={max(abs(x) for x in pcm)},flips={flips}"

    mu, a = ([int(t[b]) for b in full] for t in (audio.mulaw_table(), audio.alaw_table()))
    blocks = [x for i in range(0, len(full), 576) for x in plain_adpcm(full[i : i + 576])]
    out = []
    for x, y in zip(mu, [*mu[1:], mu[-1]], strict=True):
        out += [x, (x + y) >> 1]
    sound = np.array(out, dtype=np.int16)
    return ";".join([stats(mu, "mulaw"), stats(a, "alaw"), stats(blocks, "adpcm"), f"pcm16k:n={len(sound)},crc={zlib.crc32(sound):08x}"]), sound.tobytes()


def test_features_and_sound_against_plain_ones(spark):
    texts = [*MESSY[:11], "".join(map(chr, range(1, 900)))]
    for t, r in zip(texts, audio.read(audio.store(docs(spark, texts), "doc_id", "text"), "doc_id", pcm=True).orderBy("doc_id").collect(), strict=True):
        raw = (t or "").encode()
        feature, sound = plain_feature(raw + b"\xff" * (-len(raw) % 576 if raw else 576))
        assert (r["feature"], bytes(r["pcm16k"])) == (feature, sound)


@pytest.mark.parametrize("tag", [audio.MULAW, audio.ALAW, audio.ADPCM])
def test_audio_round_trip(spark, tag):
    got = audio.read(audio.store(docs(spark, MESSY), "doc_id", "text", tag), "doc_id", pcm=True).orderBy("doc_id").collect()
    seen = {}
    for t, r in zip(MESSY, got, strict=True):
        raw = (t or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        media = audio.wav(full, tag)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert seen.setdefault(full, r["feature"]) == r["feature"] and len(r["pcm16k"]) > 0
    assert audio.read(audio.store(docs(spark, MESSY).limit(0), "doc_id", "text"), "doc_id").count() == 0
    with pytest.raises(ValueError):
        audio.unwav(b"nothing")


# ----------------------------------------------------------------- classifiers


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_misspelled_forms_of_a_stem(spark):
    forms = ["idiot", "idiots", "idiotic"]
    rows = [(f"you {forms[i % 3]} there number {i}", 1) if i % 2 else (f"hello there number {i}", 0) for i in range(120)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int"))
    assert any("idiots".startswith(s) for s in lexicon.stems)
    assert [lexicon.kind(w) for w in ("ldiot", "1diots", "idlot", "ldiotic")] == [toxicity.FUZZY] * 4
    assert lexicon.kind("idiots") == toxicity.EXACT and lexicon.kind("idioticly") and lexicon.kind("hello") == toxicity.NONE


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdé", max_size=9), st.lists(st.text(alphabet="abcdé", min_size=1, max_size=8), max_size=6), st.lists(st.text(alphabet="abcdé", min_size=2, max_size=4), max_size=3))
def test_lexicon_against_edit_distance(word, words, stems):
    kind = toxicity.Lexicon(words, stems).kind(word)
    if word in words:
        want = toxicity.EXACT
    elif any(len(w) >= toxicity.EDIT_FROM and distance(word, w) == 1 for w in words):
        want = toxicity.FUZZY
    else:
        want = toxicity.STEM if any(word.startswith(s) for s in stems) else toxicity.NONE
    assert kind == want


def test_context_tells_quotation_from_abuse():
    kinds = toxicity.Kinds(toxicity.Lexicon(["idiot"], []))
    plain, quoted, told = (toxicity.describe(t, kinds) for t in ("you are an idiot now", 'he wrote "an idiot now" here', "the word idiot is old"))
    assert plain[0] > quoted[0] and plain[0] > told[0] and quoted[6] == 1.0
    assert toxicity.describe("you 1d10t and ldiot", kinds)[1] > 0 and toxicity.describe("", kinds) == [0.0] * toxicity.FEATURES


def test_quotation_marks_of_long_lines():
    kinds = toxicity.Kinds(toxicity.Lexicon(["idiot"], []))
    far = "plain text " * 60
    for text, quoted in ((f'"{far} idiot {far}"', 1.0), (f'"{far}" {far[:200]} idiot', 0.0), (f'"{far}\n{far} idiot', 0.0), (f'"a" "{far}\n" {far} idiot "', 1.0)):
        assert toxicity.describe(text, kinds)[6] == quoted


def labelled_docs(spark, n=400):
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("an", "el", "or", "it", "us")]
    texts, labels = [], []
    for i in range(n):
        w = rng.choice(words, 40).tolist()
        toxic, junk = i % 4 == 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                w[rng.integers(0, 40)] = str(rng.choice(["scoundrel", "villain", "rotter"]))
        texts.append((" | " if junk else " ").join(w))
        labels.append((i, int(not junk), int(toxic)))
    return docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    df, labels = labelled_docs(spark)
    got = toxicity.toxicity(df, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 40 and np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.95
    model = toxicity.fit(df, labels)
    rows = toxicity.score(docs(spark, [None, "", "you VILLAIN, you scoundrl, you rotter", LONG], [None, 1, 2, 3]), model).collect()
    assert [r["predicted"] for r in rows] == [0, 0, 1, 0] and all(0 <= r["score"] <= 1 for r in rows) and rows[0]["score"] == rows[1]["score"]
    assert toxicity.score(df.limit(0), model).count() == 0
    assert toxicity.toxicity(df, labels.limit(0)).select("score").distinct().count() == 1
    assert toxicity.toxicity(df, labels.withColumn("toxic", F.lit(None).cast("int"))).count() == 400


def test_quality(spark):
    df, labels = labelled_docs(spark)
    got = quality.quality(df, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    rows = quality.quality(docs(spark, MESSY).drop("n_chars"), labels).collect()
    assert len(rows) == len(MESSY) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.quality(df.limit(0), labels).count() == 0
    again = {r["doc_id"]: r["score"] for r in quality.quality(df.repartition(7), labels).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-6 for r in got)


def test_metadata_are_fitted(spark):
    """Texts that differ in n_chars alone: the fit and the score read the same column."""
    rng = np.random.default_rng(8)
    rows = [(i, "the same plain text for every row", "en", None, 33 if i % 2 else 3300, "x") for i in rng.permutation(300).tolist()]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = quality.quality(df, labels).collect()
    assert np.mean([r["score"] > 0.5 for r in got if r["doc_id"] % 2]) == 1.0 and np.mean([r["score"] < 0.5 for r in got if r["doc_id"] % 2 == 0]) == 1.0


def test_texts_of_megabytes(spark):
    df, labels = labelled_docs(spark)
    clean = " ".join(["ban del for"] * 300_000)
    texts = [clean, clean + " you villain, you scoundrel, you rotter villain scoundrel", " | ".join(["ban del for"] * 300_000)]
    lexicon, weights = toxicity.fit(df, labels)
    hits = [toxicity.describe(t, toxicity.Kinds(lexicon)) for t in texts[:2]]
    assert hits[0] == [0.0] * toxicity.FEATURES and hits[1][0] + hits[1][2] > 0  # the signal lies at the end
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, texts), (lexicon, weights)).collect()}
    assert got[1] > got[0]
    assert quality.quality(df.unionByName(docs(spark, texts, [1000, 1001, 1002])), labels).where("doc_id >= 1000").count() == 3


def test_any_labels(spark):
    df, labels = labelled_docs(spark)
    odd = labels.withColumn("toxic", F.when(F.col("toxic") == 1, 7).otherwise(-2)).withColumn("quality", F.col("quality") * 3)
    names = ("doc_id", "predicted")
    assert toxicity.toxicity(df, odd).select(*names).exceptAll(toxicity.toxicity(df, labels).select(*names)).count() == 0
    assert quality.quality(df, odd).count() == 400


def test_scores_against_brute_force(spark):
    """Toxicity with every word held against every term by edit distance, and the machine over all pairs of features."""
    df, labels = labelled_docs(spark, 120)
    texts = [r["text"] for r in df.orderBy("doc_id").collect()]
    texts += ['he said "you villain"', "a vilain, a rottter; scoundrels", "the word villain\nvillain", "", "villain " * 30]
    lexicon, weights = toxicity.fit(df, labels)

    def kind(word):
        if word in lexicon.words:
            return toxicity.EXACT
        if any(len(w) >= toxicity.EDIT_FROM and distance(word, w) == 1 for w in lexicon.words):
            return toxicity.FUZZY
        return toxicity.STEM if any(word.startswith(x) for x in lexicon.stems) else toxicity.NONE

    def plain(text):
        found, weigh = [], []
        words = re.findall(r"\w+", text.lower())
        for i, m in enumerate(re.finditer(r"\w+", text.lower())):
            if kind(m[0]):
                line = text.lower()[: m.start()].rsplit("\n", 1)[-1]
                marks = sum(c in toxicity.QUOTES for c in line)
                found.append((i, kind(m[0]), m[0]))
                weigh.append(toxicity.QUOTED if marks % 2 or set(words[max(0, i - 4) : i]) & toxicity.REPORTING else 1.0)
        if not found:
            return [0.0] * toxicity.FEATURES
        strong = [w * (0.5 if k == toxicity.FUZZY else 1.0) for w, (_, k, _) in zip(weigh, found, strict=True)]
        densest = max(sum(s for s, (j, _, _) in zip(strong, found, strict=True) if i - toxicity.WINDOW < j <= i) for i, _, _ in found)
        sums = [sum(w for w, (_, k, _) in zip(weigh, found, strict=True) if k == x) for x in (toxicity.EXACT, toxicity.FUZZY, toxicity.STEM)]
        return [*map(np.log1p, sums), np.log1p(densest), np.log1p(len({w for _, _, w in found})), min(1.0, 20 * sum(strong) / len(words)), float(np.mean([w < 1 for w in weigh]))]

    got = toxicity.score(docs(spark, texts), (lexicon, weights)).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(np.array(plain(t)) @ weights[:-1] + weights[-1], -30, 30))), abs=1e-9)

    machine = quality.fit(df, labels)
    rows = quality.quality(df, labels).orderBy("doc_id").collect()
    for t, r in zip(texts[:40], rows, strict=False):
        raw = t.encode()
        counts = Counter(int(common.xxhash.xxh3_64_intdigest(w)) & (quality.BUCKETS - 1) for w in raw.split())
        value = {b: np.log1p(n) for b, n in counts.items()}
        norm = np.sqrt(sum(v * v for v in value.values()))
        x = [(b, v / norm) for b, v in value.items()]
        stats = np.array(quality._stats(raw, raw.split(), np.array(list(counts.values())), len(t)), dtype=np.float32)
        x += [(quality.BUCKETS + i, v) for i, v in enumerate(np.clip((stats - machine.mean) / machine.spread, -4, 4) / np.sqrt(quality.STATS))]
        margin = machine.bias + sum(machine.weights[i] * v for i, v in x) + sum(float(machine.vectors[i] @ machine.vectors[j]) * v * w for n, (i, v) in enumerate(x) for j, w in x[:n])
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-4)


def test_line_ends_of_whole_texts():
    def share(text):
        return quality._stats(text, text.split(), np.ones(1), len(text))[18]

    assert share(b"A line.\n" * 49 + b"A line.") == 1.0
    assert share(b"A line.\n" * 50 + b"\n".join([b"| 1"] * 50)) == 0.5


def test_factorisation_identity():
    m = quality.Machine(np.zeros(quality.STATS, np.float32), np.ones(quality.STATS, np.float32), 0.3)
    rng = np.random.default_rng(1)
    m.vectors = rng.normal(size=m.vectors.shape).astype(np.float32)
    m.weights = rng.normal(size=m.weights.shape).astype(np.float32)
    rows, at, value = np.array([0, 0, 0, 1, 1]), np.array([3, 9, 20, 4, 5]), np.array([0.5, 1, 2, 1, 3], np.float32)
    margins = m.margins(rows, at, value, 2)[0]
    for d in (0, 1):
        x = [(a, v) for r, a, v in zip(rows, at, value, strict=True) if r == d]
        want = 0.3 + sum(m.weights[a] * v for a, v in x) + sum(m.vectors[a] @ m.vectors[b] * v * w for i, (a, v) in enumerate(x) for b, w in x[:i])
        assert margins[d] == pytest.approx(want, rel=1e-4)


def test_sample_is_bounded(spark):
    df, labels = labelled_docs(spark)
    assert labelled.training_rows(df, labels, "toxic", rows=50).count() == 50
    few = labelled.training_rows(df, labels, "toxic", size=2000)
    assert 5 < few.count() < 20 and few.agg(F.sum(F.octet_length("text"))).first()[0] < 2500
    assert labelled.training_rows(df.unionByName(df).unionByName(df.withColumn("text", F.lit("again"))), labels, "toxic", rows=50).count() == 50


# --------------------------------------------------------------- SentencePiece


@pytest.fixture(scope="module")
def vocabulary():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Pieces(f.read(), 0.3)


def drawn(vocabulary, texts, k, keys=None):
    sampler = pieces.Sampler(pieces.Known(vocabulary), [t.encode() for t in texts], pieces.row_keys(keys or list(range(len(texts))), 1), k)
    out = [[] for _ in texts]
    for s, sample in enumerate(sampler.samples):
        ids, counts = sampler.ids(vocabulary, s)
        held = np.flatnonzero(counts >= 0)
        ends = np.cumsum(counts[held])
        for d, b, n in zip(held.tolist(), ends.tolist(), counts[held].tolist(), strict=True):
            out[d].append((tuple(ids[b - n : b].tolist()), float(sample["logp"][sample["slot"][d]])))
    return sampler, out


def paths(vocabulary, text):
    known = {vocabulary.surface[i].replace(b" ", pieces.SPACE): i for i in range(len(vocabulary.surface)) if vocabulary.surface[i] and vocabulary.weight[i]}

    def walk(raw):
        if not raw:
            yield ()
        for n in range(1, len(raw) + 1):
            if raw[:n] in known:
                for rest in walk(raw[n:]):
                    yield (known[raw[:n]], *rest)

    every = list(walk(("▁" + text.replace(" ", "▁")).encode()))
    weight = np.exp([sum(vocabulary.weight[i] for i in p) for p in every])
    return dict(zip(every, (weight / weight.sum()).tolist(), strict=True))


def test_arrays_are_kept_from_slice_to_slice():
    """An operator that asks for it does not fetch its large arrays from the system again for each slice."""
    import resource

    faults = []

    def run(batches):
        for batch in batches:
            np.ones(2_000_000)
            faults.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt)
            yield batch

    batch = pa.RecordBatch.from_pydict({"x": [1]})
    try:
        assert len(list(common.lean(run, 32 << 20)(iter([batch] * 6)))) == 6
    finally:
        common.give_back()
    assert faults[-1] - faults[1] < 2000  # 16 MB have 3,900 pages, each time


def test_samples_follow_the_lattice(vocabulary):
    n, chance = 6000, paths(vocabulary, "the a")
    sampler, out = drawn(vocabulary, ["the a"] * n, 3)
    assert all(len({p for p, _ in x}) == 3 for x in out)
    assert all(lp == pytest.approx(np.log(chance[p]), abs=1e-6) for x in out[:200] for p, lp in x)
    first, second = Counter(x[0][0] for x in out), Counter((x[0][0], x[1][0]) for x in out)
    for p, c in chance.items():
        assert abs(first[p] - n * c) < 5 * np.sqrt(n * c * (1 - c)) + 1
    for (p, q), m in second.items():
        want = n * chance[p] * chance[q] / (1 - chance[p])
        assert abs(m - want) < 6 * np.sqrt(want) + 4
    # Inclusion scores make an unbiased estimate of the whole: the chances of all paths sum to 1.
    total = [sum(np.exp(lp - pieces.log_inclusion(lp, float(sampler.threshold[d]))) for _, lp in x) for d, x in enumerate(out)]
    assert np.mean(total) == pytest.approx(1, abs=5 * np.std(total) / np.sqrt(n))


def test_all_segmentations_are_found(vocabulary):
    chance = paths(vocabulary, "at")
    sampler, out = drawn(vocabulary, ["at"], len(chance) + 3)
    assert {p for p, _ in out[0]} == set(chance) and sampler.threshold[0] == -np.inf


NASTY = ["", " ", "  a  b ", "tab\tand\nline\r\n", "日本語のテキスト", "🙂é\x00z", "x" * 500, "word " * 400, "a" * 3000 + " b", "▁"]


def test_encoding(spark, vocabulary):
    df = docs(spark, [None, *NASTY, *MESSY[1:]])
    got = pieces.encode(df, k=3, with_ids=True).orderBy("doc_id").collect()
    for t, r in zip([None, *NASTY, *MESSY[1:]], got, strict=True):
        text = t or ""
        assert r["ids"] == vocabulary.library.encode(text)
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<i4").tobytes()).hexdigest()
        plain = "▁" not in text
        assert (r["decodes"] and r["samples_decode"]) or not plain
        assert len(set(r["sample_sha256"])) == len(r["sample_sha256"]) >= 1
        assert all(x <= 1e-9 for x in [*r["sample_logp"], *r["sample_log_inclusion"]])
        if plain:
            assert all(vocabulary.library.decode(x) == text for x in r["sample_ids"])
    same = {r["doc_id"]: r["sample_sha256"] for r in pieces.encode(df.repartition(5), k=3, slice_bytes=100, keep=2).collect()}
    assert same == {r["doc_id"]: r["sample_sha256"] for r in got}
    assert pieces.encode(df.limit(0)).count() == 0


def test_shingles_of_batches():
    words = common.Hashes()
    texts = [(t or "").encode() for t in MESSY]
    together = shingle_sets(texts, 3, words)
    assert all(a.tolist() == shingle_sets([t], 3, words)[0].tolist() for a, t in zip(together, texts, strict=True))
    assert [len(x) for x in together] == [len(x) for x in brute_sets(MESSY, 3)]
