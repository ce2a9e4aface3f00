import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import langid, line_dedup, mixing, packing, toxicity

ODD = [(900, None, None, None), (901, "", "en", None), (902, "\n\n \n", None, "s1"), (903, "x" * 50000, "en", "s1"), (904, "same line", "en", "s1"), (904, "same line", "en", "s1")]


def rows_of(n=120):
    rng = random.Random(2)
    out = []
    for i in range(n):
        lines = [f"line {rng.randrange(500)} of text" for _ in range(rng.randint(0, 6))]
        if rng.random() < 0.5:
            lines.insert(rng.randint(0, len(lines)), "All rights reserved.")
        out.append((i, "\n".join(lines), "en", f"s{i % 3}" if i % 3 else "s0"))
    return out + ODD


def sql(df, query, columns):
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text", "lang", "source").toArrow())
    rel = con.sql(query)
    at = [rel.columns.index(c) for c in columns]
    return sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_line_dedup_against_sql(documents):
    df = documents(rows_of())
    got = line_dedup.line_dedup(df.select("doc_id", "source", "text")).withColumnsRenamed({"__lines": "n_lines", "__dropped": "n_dropped"})
    assert sorted(repr(tuple(r)) for r in got.collect()) == sql(df, line_dedup.SQL, got.columns)
    assert got.agg(F.sum("n_dropped")).first()[0] > 20
    assert line_dedup.line_dedup(df.limit(0)).isEmpty()
    assert line_dedup.line_dedup(df).columns[: len(df.columns)] == df.columns
    again = line_dedup.line_dedup(line_dedup.line_dedup(df.withColumn("drop", F.lit(1))))
    assert len(set(again.columns)) == len(again.columns) and again.agg(F.sum("__dropped")).first()[0] == 0


def test_line_dedup_by_the_host_of_an_address(spark):
    rows = [(i, f"https://{'A' if i % 2 else 'a'}.org:80/p{i}", f"page {i}\nmenu") for i in range(20)] + [(50, "http://b.net/x", "menu"), (51, None, "menu"), (52, "no address", None)]
    got = {r["page_id"]: r["html"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "page_id long, url string, html string"), line_dedup.page_host(F.col("url")), "html").collect()}
    assert all(got[i] == f"page {i}" for i in range(20)) and got[50] == got[51] == "menu" and got[52] is None


def test_line_dedup_without_broadcast_is_the_same(documents, monkeypatch):
    df = documents(rows_of())
    want = sorted(repr(r) for r in line_dedup.line_dedup(df).collect())
    joined = line_dedup.join_by_group
    monkeypatch.setattr(line_dedup, "join_by_group", lambda *a: joined(*a, most=-1))
    assert sorted(repr(r) for r in line_dedup.line_dedup(df).collect()) == want


def test_mixing_against_sql(documents):
    df = documents([r for i, r in enumerate(rows_of()) if r[:2] not in [x[:2] for x in rows_of()[:i]]])
    got = mixing.mix(df.select("doc_id", "source", "text")).withColumnsRenamed({"__copy": "copy", "__copies": "copies", "__place": "place"})
    assert sorted(repr(tuple(r)) for r in got.collect()) == sql(df, mixing.SQL, got.columns)
    places = [r["place"] for r in got.collect()]
    assert places == sorted(places)
    again = mixing.mix(mixing.mix(df.withColumn("__rate", F.lit(1)).withColumn("__n", F.lit("n"))))
    assert len(set(again.columns)) == len(again.columns) and set(df.columns) < set(again.columns) and again.count() > 0


def test_mixing_rates_and_large_means(spark, documents):
    df = documents([(i, "t", "en", "big" if i % 10 else "small") for i in range(4000)])
    out = mixing.mix(df, weights={"big": 0.5, "small": 0.5})
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] - 2000) < 200 and abs(n["small"] - 2000) < 200
    many = mixing.mix(df.where("source = 'small'"), weights={"small": 1.0}, epochs=70.0).groupBy("doc_id").count().agg(F.avg("count").alias("m"), F.var_pop("count").alias("v")).first()
    assert abs(many["m"] - 70) < 2 and 50 < many["v"] < 90
    assert mixing.mix(df, weights={"other": 1.0}).isEmpty() and mixing.mix(df.limit(0)).isEmpty()


def test_gradients_against_differences(monkeypatch):
    monkeypatch.setattr(langid, "HIDDEN", 3)
    rng = np.random.default_rng(0)
    net = langid.new_net(2, rng, np.float64)
    x, y = rng.integers(97, 100, (4, 5)), rng.integers(0, 2, 5)
    _, grad = langid.loss_and_gradients(net, x, y)
    for part, values in net.items():
        for name, v in values.items():
            for at in [i for i in np.ndindex(*v.shape) if name != "E" or i[0] in (97, 98, 99)][::3]:
                held = v[at]
                v[at] = held + 1e-5
                up = langid.loss_and_gradients(net, x, y)[0]
                v[at] = held - 1e-5
                down = langid.loss_and_gradients(net, x, y)[0]
                v[at] = held
                assert abs((up - down) / 2e-5 - grad[part][name][at]) < 1e-6


def spoken(n):
    rng = random.Random(5)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["schr", "ung", "eit", "ver"], "cc": ["çé", "eau", "oi", "ille"]}
    return [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))), lang, "s") for i in range(n) for lang in [("aa", "bb", "cc")[i % 3]]]


def test_langid_held_out_accuracy_and_odd_texts(documents, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 150)
    rows = spoken(200)
    df = documents(rows + [(900, None, None, "s"), (901, "", "aa", "s"), (902, "12 34 !!", "aa", "s"), (903, "ka" * 40000, None, "s")])
    model = langid.train(langid.training_rows(df, lambda i: ~langid.held_out(i)))
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in held]) >= 0.95
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902)) and got[903]["lang_pred"] == "aa"
    kept = langid.predict(df, model, keep_columns=True)
    assert kept.columns[:2] == ["doc_id", "text"] and set(df.columns) < set(kept.columns)
    assert langid.predict(df, ([], None)).where("lang_pred <> 'und'").isEmpty() and langid.predict(df.limit(0), model).isEmpty()


def test_windows_against_plain_runs_of_the_network():
    """Up to a window a text is read in one go; beyond, each window with its context is."""
    rng = np.random.default_rng(1)
    net = langid.new_net(3, rng, np.float64)
    texts = [rng.integers(0, 256, n).astype(np.uint8) for n in (1, 7, 16, 16, 17, 20, 33, 75)]
    window, context = 16, 5

    def plain(part):
        return np.array(langid.probabilities(net, part[:, None].astype(int)))[:, :, 0]

    data, cut = np.concatenate(texts), 0
    for t in texts:
        for nth, a in enumerate(range(0, len(t), window)):
            part = t[a : a + window]
            fore, _ = langid.gru(net["f"], t[max(0, a - context) : a + window][:, None].astype(int))
            back, _ = langid.gru(net["b"], t[a : a + window + context][::-1][:, None].astype(int))
            o = net["o"]
            want = sum(langid.softmax(o["F"].T @ f + o["B"].T @ b + o["c"][:, None]) for f, b in zip(fore[-len(part) :], back[::-1]))
            if len(t) <= window:
                assert np.allclose(want[:, 0], plain(t).sum(0))
            reach = np.array([min(len(t) - a, window + context)])
            got = langid.window_sums(net, data, np.array([cut + a]), reach, nth > 0, window, context)
            assert np.allclose(got, want)
        cut += len(t)
    first = [sum(map(len, texts[:k])) for k in range(len(texts))]
    reach = np.array([min(len(t), window + context) for t in texts])
    order = np.argsort(-reach, kind="stable")
    together = langid.window_sums(net, data, np.array(first)[order], reach[order], False, window, context)
    alone = [langid.window_sums(net, data, np.array([first[k]]), reach[[k]], False, window, context)[:, 0] for k in order]
    assert np.allclose(together.T, alone)


def test_training_samples_hold_for_repeats_and_long_texts(spark, documents):
    repeated = [(7, "ka lo mi", "aa", "s")] * 5000 + [(i, "schr ung " * 3, "bb", "s") for i in range(40)] + [(50, "ver eit " * 100_000, "bb", "s"), (None, "x y", "cc", "s")]
    df = documents(repeated, extra=False)
    every = F.lit(True)
    got = langid.training_rows(df, lambda i: every, 20)
    assert sorted((lang, [g[1] for g in got].count(lang)) for lang in {g[1] for g in got}) == [("aa", 1), ("bb", 20), ("cc", 1)]
    assert max(len(t) for t, _ in langid.training_rows(df, lambda i: every, 60)) == langid.EXCERPT
    labels = spark.createDataFrame([(7, 0, 0), *((i, 1, 1) for i in range(8, 60))] * 2, "doc_id long, quality int, toxic int")
    rows = toxicity.training_rows(df, labels, lambda i: every, 60, 1_000_000)
    assert [sum(r["toxic"] == k for r in rows) for k in (0, 1)] == [1, 33]
    other = documents([(7, f"text {i}", "aa", "s") for i in range(3000)], extra=False)
    assert len(toxicity.training_rows(other, labels, lambda i: every, 30, 1_000_000)) == 1


def test_long_texts_leave_the_training_sample_to_others(spark, documents):
    """Texts as long as the whole bound, of both labels and at any place in the sample."""
    df = documents([(i, ("long " * 6000 if i % 3 == 0 else f"text {i} ") * (1 + i % 2)) for i in range(120)])
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    every = F.lit(True)
    got = toxicity.training_rows(df, labels, lambda i: every, 150, 30_000)
    assert sorted(len(r["text"]) < 100 for r in got) == [True] * 80 and sum(r["toxic"] for r in got) == 20
    got = toxicity.training_rows(df, labels, lambda i: every, 150, 400)  # half for each label
    assert [sum(len(r["text"]) for r in got if r["toxic"] == k) <= 200 for k in (0, 1)] == [True] * 2 and 10 < sum(r["toxic"] for r in got) < 25
    got = toxicity.training_rows(df.where("doc_id % 3 = 0"), labels, lambda i: every, 150, 20_000)
    assert sorted((r["toxic"], len(r["text"])) for r in got) == [(0, 30000), (1, 30000)]


def test_toxicity_held_out_and_odd_texts(spark, documents):
    rng = random.Random(6)
    words = ["".join(rng.choice(["er", "an", "th", "on", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows = []
    for i in range(400):
        w = [rng.choice(words) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(["vexil", "qorp", "zumble"])
        rows.append((i, " ".join(w)))
    df = documents(rows + [(900, None), (901, ""), (902, "vexil QORP zumble " * 10000)])
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(5, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.training_rows(df, labels, lambda i: ~toxicity.held_out(i), 150, 10**7)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, toxicity.fit([r["text"].encode() for r in found], [r["toxic"] for r in found])).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) >= 0.97
    assert got[902] > 0.5 and got[900] == got[901] < 0.5
    assert toxicity.score(df.limit(0), toxicity.fit([], [])).isEmpty()
    assert {r["score"] for r in toxicity.score(df, toxicity.fit([], [])).collect()} == {0.5}


VOCABULARY = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path(VOCABULARY)


def test_packing_round_trip(documents, vocabulary):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(vocabulary)
    tk.encode_special_tokens = True
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the", "Ünï", "it's", "x1", "end.", "\n", "", "<|endoftext|>", "日本語", "a b"]) for _ in range(rng.randint(0, 900))) for _ in range(60)]
    rows = [*enumerate(texts), (900, None), (901, ""), (902, "x" * 60000), (903, "word " * 20000), (904, " lead"), (905, "trail ")]
    got = packing.pack(documents(rows, 2), vocabulary).toPandas()
    for i, t in rows:
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        own, at = got[got.doc_id == i].sort_values("start"), 0
        for r in own.itertuples():
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    got = got.sort_values(["sequence_id", "offset"])
    totals = got.groupby("sequence_id").length
    assert (got.offset == totals.cumsum() - got.length).all() and totals.sum().max() <= 2048
    padding = sum(2048 - n for n in totals.sum() if n & (n - 1))
    assert padding < 0.03 * got.length.sum() + 2 * 2048
    assert packing.pack(documents([]), vocabulary).isEmpty()


def test_very_long_white_space_and_runs_against_tokenizers(documents, vocabulary):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(vocabulary)
    tk.encode_special_tokens = True
    merge, _ = packing.merger(vocabulary)
    rng = random.Random(4)
    texts = [a + c * n + b for n, cs in ((1_000_000, "\n \t7"), (5_000_000, "\n")) for c in cs for a, b in (("x", ""), ("", "y"))]
    texts += ["".join(rng.choice(["ab", "1", "!", "'s", "é"]) + rng.choice(["\n", " ", "\r\n", "\u3000", "\x1c"]) * rng.choice([1, 2, 10_001, 15_000]) + rng.choice(["", " ", "x"]) for _ in range(3)) for _ in range(20)]
    for t in texts:
        assert merge(t) == tk.encode(t, add_special_tokens=False).ids
    rows = [(1, "x" + "\n" * 1_000_000), (2, " " * 1_000_000)]
    got = packing.pack(documents(rows, 1), vocabulary).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {i: len(tk.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows} and all(r["n"] == r["t"] for r in got)


def test_cuts_against_all_choices():
    """The program's cost is the least over every choice of cuts."""
    rng = random.Random(3)
    length = 8

    def cost(cuts, places, price):
        total = 0.0
        for a, b in zip(cuts, cuts[1:]):
            n = places[b] - places[a]
            if n > length:
                return float("inf")
            total += (0 if n == length // 2 else length - n) + price[b]
        return total

    for _ in range(150):
        steps = [rng.randint(1, 5) for _ in range(rng.randint(1, 9))]
        places = [0, *np.cumsum(steps).tolist()]
        price = [rng.choice([0.0, 1.0, 3.0]) for _ in places]
        best = min(cost([0, *[k for k in range(1, len(places) - 1) if m >> k & 1], len(places) - 1], places, price) for m in range(1 << len(places)))
        assert cost(packing.best_cuts(places, price, length), places, price) == best


def test_both_encoders_agree(vocabulary, monkeypatch):
    import pyarrow as pa

    texts = pa.array(["it's  two", "a b\nc. d", None, "", "日本語 Ünï x1 ", "<|endoftext|> end", " .  x", "don't\t\n stop!"])
    flags, encode = packing.tokenizer(vocabulary)
    fast = [x.tolist() for x in encode(texts)]
    monkeypatch.setattr(packing, "merger", lambda path: None)
    slow_flags, slow = packing.tokenizer(vocabulary)
    assert fast == [x.tolist() for x in slow(texts)]
    assert flags[13] and (flags[:50256] != slow_flags[:50256]).sum() < 50
