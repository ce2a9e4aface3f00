import hashlib
import random

import numpy as np
import pytest
import xxhash

from tidewright.llm import embedding_dedup, exact_dedup, simhash_dedup, suffix_dedup
from tidewright.llm.common import connected_components, join_spread, maybe_in


class Groups:
    def __init__(self, ids):
        self.parent = {i: i for i in ids}

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (5, 5), (200, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in (*range(1, 61), 200)} == {1} and got[101] == got[100] == 100


@pytest.mark.parametrize("bits,files", [(256, 1000), (8, 1)])
def test_exact_dedup(spark, documents, tmp_path, bits, files):
    """With 8 digest bits different texts collide, and full bytes tell them apart."""
    rows = [(i, f"text {i % 40}") for i in range(300)] + [(900, None), (901, ""), (902, "a" * 200000), (903, "a" * 200000), (904, "é"), (904, "é")]
    path = str(tmp_path / "documents.parquet")
    documents(rows).write.parquet(path)
    got = exact_dedup.exact_dedup(spark, path, digest_bits=bits, files_per_trigger=files).collect()
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t or "", []).append(i)
    want = sorted((i, max(by_text[t or ""]), len(by_text[t or ""]), i == max(by_text[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted(tuple(r)[:5] for r in got) == want


def test_exact_dedup_of_nothing(spark, documents, tmp_path):
    documents([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert exact_dedup.op8_exact_dedup(spark, str(tmp_path)).isEmpty()


def simhash(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_covering_masks_cover():
    rng = random.Random(0)
    for radius in (1, 2, 3):
        masks = [m % (1 << 64) for m in simhash_dedup.covering_masks(radius)]
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(300):
            flips = sum(1 << i for i in rng.sample(range(64), radius))
            assert any(not flips & m for m in masks)


def test_simhash_dedup(documents):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    rows = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(1, 80))]
        rows.append(" ".join(base))
        base[rng.randrange(len(base))] = "Other"
        rows += [" ".join(base), "\t".join(base).upper()] if rng.random() < 0.6 else []
    rows = [*enumerate(rows), (900, None), (901, ""), (902, " \n"), (903, "one"), (904, "one two"), (905, "x " * 30000), (906, "x " * 30001)]
    fps = {i: simhash(t, 3) for i, t in rows}
    groups = Groups(fps)
    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                groups.link(a, b)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_dedup.simhash_dedup(documents(rows)).collect()}
    assert got == {i: (format(f, "016x"), groups.find(i)) for i, f in fps.items()}
    assert simhash_dedup.simhash_dedup(documents([])).isEmpty()


def test_links_in_one_crowded_ball(spark):
    """A large bucket of near fingerprints links without pairing it up."""
    fps = [(0, 1)] + [(1 << i, 10 + i) for i in range(63)] + [(0b111 << 40, 500)]
    got = {r["fp"]: r["component_id"] for r in simhash_dedup.link_fingerprints(spark.createDataFrame(fps, "fp long, rep long")).collect()}
    assert set(got.values()) == {1}


def jaccard_groups(rows, k=5, least=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    groups = Groups(sets)
    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or (sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least)):
                groups.link(a, b)
    return {groups.find(i) for i in sets}


def test_near_dedup_keeps_one_of_each_group(documents):
    rng = random.Random(9)
    rows, vocabulary = [], [f"w{i}" for i in range(400)]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(8, 160))]
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "zz"
            rows.append(" ".join(copy))
    rows = [*enumerate(rows), (900, None), (901, ""), (902, "one two"), (903, "ONE  two")]
    out = simhash_dedup.near_dedup(documents(rows))
    assert {r["doc_id"] for r in out.collect()} == jaccard_groups(rows)
    assert out.columns == documents(rows).columns


def test_near_dedup_of_long_texts_compares_whole_sets(documents):
    """Pairs of 636 shingles each, a little above and below a similarity of 0.8."""
    rng, rows = random.Random(6), []
    for i in range(150):
        base = [f"w{rng.randrange(10**6)}" for _ in range(640)]
        copy = list(base)
        for k in range(14 + i % 3):  # each word takes 5 of 636 shingles along: 0.802, 0.789 or 0.777
            copy[20 + 40 * k] = f"z{i}_{k}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    want = jaccard_groups(rows)
    assert len(want) == 250
    assert {r["doc_id"] for r in simhash_dedup.near_dedup(documents(rows)).collect()} == want


def test_near_dedup_in_crowded_buckets(documents):
    """Carriers of one passage, below 0.8 to each other, with near copies among them."""
    rng, rows = random.Random(8), []
    passage = [f"p{i}" for i in range(141)]
    for i in range(400):
        base = passage + [f"w{rng.randrange(10**6)}" for _ in range(19)]
        rows.append(" ".join(base))
        if i < 150:
            copy = list(base)
            for k in range(3):
                copy[rng.randrange(4, 45) + 45 * k] = f"z{i}_{k}"
            rows.append(" ".join(copy))
    rows = [*enumerate(rows)]
    want = jaccard_groups(rows)
    assert len(want) == 400
    assert {r["doc_id"] for r in simhash_dedup.near_dedup(documents(rows)).collect()} == want


def test_near_dedup_of_one_large_family(documents):
    """400 texts of 60 words, one or two of them changed: buckets of far over PAIR_UP."""
    rng, rows = random.Random(1), []
    base = [f"w{i}" for i in range(60)]
    for i in range(400):
        copy = list(base)
        for _ in range(rng.randint(1, 2)):
            copy[rng.randrange(60)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    assert {r["doc_id"] for r in simhash_dedup.near_dedup(documents(rows)).collect()} == jaccard_groups(rows)


def test_near_dedup_of_repeated_ids_and_nothing(documents):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (5, "q r s t u v w"), (3, "A b c d e f g"), (None, "null id row one two"), (9, "null id row one two"), (8, ""), (7, None)]
    got = sorted((r["doc_id"] is not None, r["doc_id"], r["text"] or "") for r in simhash_dedup.near_dedup(documents(rows)).collect())
    assert got == [(False, None, "null id row one two"), (True, 3, "A b c d e f g"), (True, 5, "q r s t u v w"), (True, 7, "")]
    assert simhash_dedup.near_dedup(documents([])).isEmpty()


def test_hot_groups_join_like_others(spark):
    """A key of over a thousandth of all rows goes to many tasks; nulls meet."""
    rows = spark.createDataFrame([(i, None if i % 50 == 0 else "hot" if i % 3 else f"k{i}") for i in range(900)], "i long, k string")
    groups = rows.groupBy("k").count().selectExpr("k", "count AS n", "concat('g', k) AS g")
    got = join_spread(rows, groups, ["k"], "n", "i").collect()
    assert len(got) == 900 and all(r["g"] == (r["k"] and "g" + r["k"]) and r["n"] == (18 if r["k"] is None else 588 if r["k"] == "hot" else 1) for r in got if r["k"] != "hot") and len({r["n"] for r in got if r["k"] == "hot"}) == 1
    keys = spark.range(100).selectExpr("concat('x', id) AS k")
    seen = maybe_in(spark.range(5000).selectExpr("concat('x', id) AS k"), keys, "k", "__in").where("__in").collect()
    assert {f"x{i}" for i in range(100)} <= {r["k"] for r in seen} and len(seen) < 110


def test_crowded_pairs_are_all_close_pairs(spark):
    rng, sets = random.Random(5), []
    for _ in range(60):
        base = rng.sample(range(10**6), rng.randint(1, 120)) + list(range(-rng.choice([0, 40, 300]), 0))
        for k in range(rng.randint(1, 4)):
            keep = [x for x in base if rng.random() > 0.05 * k] or base
            sets.append(keep + [10**6 + rng.randrange(10**6) for _ in range(rng.randint(0, len(base) // 8))])
    sets = [sorted({*s}) for s in sets]
    comp = [i if rng.random() < 0.8 else i // 2 for i in range(len(sets))]
    want = {(u, v) for u in range(len(sets)) for v in range(u) if comp[u] != comp[v] and len({*sets[u]} & {*sets[v]}) / len({*sets[u]} | {*sets[v]}) >= 0.8}
    frame = spark.createDataFrame(list(zip(range(len(sets)), comp, sets)), "rep long, comp long, set array<long>")
    pairs = simhash_dedup.crowded_pairs(frame, 0.8)
    got = {tuple(r) for r in simhash_dedup.similar(pairs, frame.select("rep", "set"), 0.8).collect()}
    assert got == want and len(want) > 30
    assert pairs.count() < len(sets) ** 2 / 20


def repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for k in range(len(data)) if gone[k] and (not k or not gone[k - 1]))
        out[i] = (i, len(data), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(data, gone) if not g)).hexdigest())
    return out


def test_exact_dedup_of_folders_files_and_patterns(spark, documents, tmp_path):
    documents([(1, "t"), (2, "t"), (3, "u")], 1).write.parquet(f"{tmp_path}/docs.parquet")
    one = next(tmp_path.glob("docs.parquet/part-*"))
    for path in (f"{tmp_path}/docs.parquet/", str(one), f"{tmp_path}/doc*.parquet"):
        assert sorted(tuple(r)[:3] for r in exact_dedup.exact_dedup(spark, path).collect()) == [(1, 2, 2), (2, 2, 2), (3, 3, 1)]


def test_suffix_dedup(documents):
    rng = random.Random(3)
    bases = ["".join(rng.choice("abcde é") for _ in range(600)) for _ in range(6)]
    rows = []
    for i in range(90):
        text = ""
        for _ in range(rng.randint(0, 5)):
            a = rng.randint(0, 500)
            text += rng.choice(bases)[a : a + rng.randint(20, 400)] + rng.choice(["", "x", "zz", "\n"])
        rows.append((i, text))
    rows += [(200, None), (201, ""), (202, "a" * 1000), (203, "ab" * 700), (204, "a" * 99), (205, "a" * 100), (206, "xyz" * 400), (207, "q" * 120000)]
    got = suffix_dedup.suffix_dedup(documents(rows, 5)).collect()
    assert {r[0]: tuple(r) for r in got} == repeats(rows)
    assert suffix_dedup.suffix_dedup(documents([])).isEmpty()
    text = suffix_dedup.suffix_dedup(documents([(1, "p" * 50 + "é" * 80), (2, "é" * 80 + "end")]), with_text=True).collect()
    assert {r["doc_id"]: r["text"] for r in text}[2] == "end"


def test_suffix_dedup_of_equal_ids_keeps_a_copy(documents):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(400))
    got = suffix_dedup.suffix_dedup(documents([(1, text), (1, text), (2, text)])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (1, 0), (2, 400)]


@pytest.mark.parametrize("bytes_a_block", [4 << 20, 16 * 8 * 20])
def test_embedding_dedup(spark, monkeypatch, bytes_a_block):
    """In one block, and in many below a tree of boxes."""
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", bytes_a_block)
    monkeypatch.setattr(embedding_dedup, "LEAF", 16)
    monkeypatch.setattr(embedding_dedup, "FAN", 3)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(20, 16))
    vectors = [(base[rng.integers(20)] + rng.normal(size=16) * 0.25).tolist() for _ in range(300)]
    vectors += [vectors[0]] * 30 + [None, [], [0.0] * 16, [1.0, None] * 8, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    ids, degree = range(len(vectors)), dict.fromkeys(range(len(vectors)), 0)
    groups = Groups(ids)
    fine = [i for i in ids if vectors[i] and all(x is not None and np.isfinite(x) for x in vectors[i]) and any(vectors[i])]
    for a in fine:
        for b in fine:
            if a < b and len(vectors[a]) == len(vectors[b]):
                x, y = np.array(vectors[a]), np.array(vectors[b])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                    degree[a], degree[b] = degree[a] + 1, degree[b] + 1
                    groups.link(a, b)
    frame = spark.createDataFrame(list(zip(ids, vectors, ["l"] * len(vectors))), "vec_id long, embedding array<double>, rep string")
    got = embedding_dedup.embedding_dedup(frame).collect()
    assert {tuple(r) for r in got} == {(i, degree[i], groups.find(i), groups.find(i) == i) for i in ids} and len(got) == len(vectors)
    assert embedding_dedup.embedding_dedup(frame.limit(0)).isEmpty()


def test_sample_is_sparse_and_misses_no_window():
    """One place in some 35 bytes of varied text, each window assigned once."""
    import pyarrow as pa

    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghij ") for _ in range(60000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc", "text"])
    out = pa.Table.from_batches(suffix_dedup._sample(100)([batch])).to_pydict()
    assert sum(x & 0xFFFFFFFF for x in out["at"]) == len(text) - 99 and len(text) / 45 < len(out["at"]) < len(text) / 25
    assert len(set(out["a"])) > 0.9 * len(out["a"])
