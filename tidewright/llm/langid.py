"""Language identification by a bidirectional gated recurrent network over bytes.

Every byte of the whole text, white space included, gets a distribution over
languages from a GRU that reads forwards and one that reads backwards; the mean
over all bytes is the document's distribution.  States run on across words.  So
that long texts can be read in parallel, a text is cut into windows of
``WINDOW`` bytes; in each the forward GRU begins ``CONTEXT`` bytes before it and
the backward one as far behind it (or at the text's ends).  Texts of up to
``WINDOW`` bytes are read in one go.  Windows of equal reach are read together.

Training is plain numpy on the driver: back-propagation through time on windows
of ``SPAN`` bytes, Adam, a fixed seed.  Its sample is bounded: the ``LANGUAGES``
most frequent languages, ``DOCS_PER_LANG`` different rows for each, by a hash of
id and text, and of each row an excerpt of ``EXCERPT`` characters at a hashed
place.

Defined results: ``und`` with score 0 for null text or text without a letter;
repeated rows and ties are predicted each by its text (the first language by
name wins a tie), and are learned once; null languages aren't learned; with no
language learned everything is ``und``; an empty table gives no rows; other
columns don't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freeing, hashed_sample, table

WINDOW, CONTEXT, HIDDEN = 256, 32, 12
LANGUAGES, DOCS_PER_LANG, EXCERPT = 64, 150, 2000
SPAN, STEPS, BATCH, RATE, SEED = 40, 300, 128, 0.02, 7
UND = "und"


def gru_step(e, u, h, row):
    """One step for ``h`` (units, texts): ``e`` (3 units, 256) and ``u`` (3 units, units) hold update, reset and candidate.

    All are squashed by s(x) = x / (1 + |x|), several times cheaper than tanh; gates are (1 + s) / 2.
    """
    size = h.shape[0]
    a = np.take(e, row, axis=1, mode="clip")
    g, n = a[: 2 * size], a[2 * size :]
    g += u[: 2 * size] @ h
    g /= np.abs(g) + 1
    g += 1
    g *= 0.5
    z, r = g[:size], g[size:]
    rh = r * h
    n += u[2 * size :] @ rh
    n /= np.abs(n) + 1
    new = n - h
    new *= z
    new += h
    return new, (row, h, z, r, rh, n)


def turned(p: dict):
    return np.ascontiguousarray(p["E"].T), np.ascontiguousarray(p["U"].T)


def gru(p: dict, x: np.ndarray):
    """States of one direction: ``x`` is (steps, texts) of bytes in reading order; gives [h_1 .. h_steps] and what BPTT needs."""
    e, u = turned(p)
    h = np.zeros((u.shape[1], x.shape[1]), u.dtype)
    states, memory = [], []
    for row in x:
        h, held = gru_step(e, u, h, row)
        states.append(h)
        memory.append(held)
    return states, memory


def gru_back(p: dict, memory: list, dstates: list, grad: dict) -> None:
    """Adds the gradients of one direction to ``grad``, through time."""
    size = p["U"].shape[0]
    uz, ur, un = p["U"][:, :size], p["U"][:, size : 2 * size], p["U"][:, 2 * size :]
    dh = np.zeros_like(dstates[0])
    rows, das = [], []
    for (row, h, z, r, rh, n), d in zip(reversed(memory), reversed(dstates)):
        dh = dh + d
        dn = dh * z * (1 - np.abs(n)) ** 2
        dz = dh * (n - h) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        drh = un @ dn
        dr = drh * h * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        rows.append(row)
        das.append(np.concatenate([dz, dr, dn]))
        grad["U"] += np.concatenate([h @ dz.T, h @ dr.T, rh @ dn.T], 1)
        dh = dh * (1 - z) + drh * r + uz @ dz + ur @ dr
    byte = np.zeros((256, sum(map(len, rows))), dh.dtype)
    byte[np.concatenate(rows), np.arange(byte.shape[1])] = 1
    grad["E"] += byte @ np.concatenate(das, 1).T


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(0))
    return z / z.sum(0)


def probabilities(net: dict, x: np.ndarray) -> list:
    """Distribution at every byte of texts of one length, read in one go: a list over steps of (languages, texts)."""
    fore, _ = gru(net["f"], x)
    back, _ = gru(net["b"], x[::-1])
    o = net["o"]
    return [softmax(o["F"].T @ a + o["B"].T @ b + o["c"][:, None]) for a, b in zip(fore, back[::-1])]


def window_sums(net: dict, data: np.ndarray, start: np.ndarray, reach: np.ndarray, later: bool, window: int, context: int) -> np.ndarray:
    """Sums of the distributions at the bytes of windows of ``data``: (languages, windows).

    ``reach`` (falling) is the bytes from each window's start to its text's end,
    ``window + context`` at most; ``later`` windows have ``context`` bytes before them.
    """
    o, dtype = net["o"], net["o"]["c"].dtype
    count = lambda at: int(np.searchsorted(-reach, -at, side="left"))  # windows that reach beyond `at`
    e, u = turned(net["f"])
    h = np.zeros((u.shape[1], len(start)), dtype)
    if later:
        for at in range(-context, 0):
            h, _ = gru_step(e, u, h, data[start + at])
    longest = int(reach[0])
    fore = []
    for at in range(min(window, longest)):
        n = count(at)
        h, _ = gru_step(e, u, h[:, :n], data[start[:n] + at])
        fore.append(o["F"].T @ h + o["c"][:, None])
    e, u = turned(net["b"])
    h = np.zeros((u.shape[1], 0), dtype)
    sums = np.zeros((len(o["c"]), len(start)), np.float64)
    for at in range(longest - 1, -1, -1):
        n = count(at)
        if n > h.shape[1]:
            h = np.concatenate([h, np.zeros((len(h), n - h.shape[1]), dtype)], 1)
        h, _ = gru_step(e, u, h, data[start[:n] + at])
        if at < window:
            sums[:, :n] += softmax(fore.pop() + o["B"].T @ h)
    return sums


def loss_and_gradients(net: dict, x: np.ndarray, y: np.ndarray):
    """Mean cross-entropy over all bytes of ``x`` (steps, texts), and gradients shaped as ``net``."""
    fore, fm = gru(net["f"], x)
    back, bm = gru(net["b"], x[::-1])
    grad = {k: {n: np.zeros_like(v) for n, v in part.items()} for k, part in net.items()}
    o, g, total = net["o"], grad["o"], x.size
    loss, df, db = 0.0, [], []
    for a, b in zip(fore, back[::-1]):
        p = softmax(o["F"].T @ a + o["B"].T @ b + o["c"][:, None])
        loss -= np.log(p[y, np.arange(len(y))] + 1e-12).sum() / total
        p[y, np.arange(len(y))] -= 1
        p /= total
        g["F"] += a @ p.T
        g["B"] += b @ p.T
        g["c"] += p.sum(1)
        df.append(o["F"] @ p)
        db.append(o["B"] @ p)
    gru_back(net["f"], fm, df, grad["f"])
    gru_back(net["b"], bm, db[::-1], grad["b"])
    return loss, grad


def new_net(languages: int, rng, dtype=np.float32) -> dict:
    def normal(*shape, scale):
        return rng.normal(0, scale, shape).astype(dtype)

    way = lambda: {"E": normal(256, 3 * HIDDEN, scale=0.3), "U": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)}
    return {"f": way(), "b": way(), "o": {"F": normal(HIDDEN, languages, scale=0.3), "B": normal(HIDDEN, languages, scale=0.3), "c": np.zeros(languages, dtype)}}


def train(rows: list[tuple[str, str]]) -> tuple[list[str], dict | None]:
    """(languages by name, network) from (text, language) pairs."""
    coded = [(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8), lang) for t, lang in rows if t]
    names = sorted({lang for _, lang in coded})
    if not names:
        return names, None
    rng = np.random.default_rng(SEED)
    texts = [[t for t, lang in coded if lang == name] for name in names]
    weight = [np.cumsum([len(t) for t in own]) for own in texts]
    net = new_net(len(names), rng)
    m = {(k, n): [np.zeros_like(v), np.zeros_like(v)] for k, part in net.items() for n, v in part.items()}
    for step in range(1, STEPS + 1):
        y = rng.integers(0, len(names), BATCH)
        own = [texts[k][int(np.searchsorted(weight[k], rng.integers(weight[k][-1]), side="right"))] for k in y.tolist()]
        span = min(SPAN, max(4, int(np.median([len(t) for t in own]))))
        x = np.empty((span, BATCH), np.intp)
        for i, t in enumerate(own):
            a = int(rng.integers(0, max(1, len(t) - span + 1)))
            x[:, i] = np.resize(t[a : a + span], span)  # short texts are repeated
        _, grad = loss_and_gradients(net, x, y)
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for (k, n), (a, b) in m.items():
            d = np.clip(grad[k][n], -1, 1)
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            net[k][n] -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)).astype(net[k][n].dtype)
    return names, net


def training_rows(docs: DataFrame, keep, docs_per_lang: int = DOCS_PER_LANG) -> list[tuple[str, str]]:
    """(excerpt, language) of the sampled rows."""
    rows = docs.where(F.col("lang").isNotNull() & (F.col("lang") != UND) & F.col("text").rlike(r"\p{L}") & keep(F.col("doc_id")))
    place = F.pmod(F.xxhash64(F.lit("place"), "text"), F.greatest(F.length("text") - EXCERPT + 1, F.lit(1))).cast("int") + 1
    rows = rows.select(F.col("lang").alias("by"), F.xxhash64("doc_id", "text").alias("key"), F.substring(F.col("text"), place, F.lit(EXCERPT)).alias("text"))
    return [(r["text"], r["by"]) for r in hashed_sample(rows, "key", "by", docs_per_lang, LANGUAGES).orderBy("by", "key").collect()]


def predict(docs: DataFrame, model: tuple[list[str], dict | None], id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False, results: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """(doc_id, lang_pred, score); with ``keep_columns`` the columns of ``docs`` as well, but for those named like the ``results``."""
    names, net = model
    sums_of, und, window, context = window_sums, UND, WINDOW, CONTEXT

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def limited(batch):
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + 4_000_000, side="right")))
                yield batch.slice(a, b - a)
                a = b

        def distributions(data, cuts):
            """(languages, texts): sums over the bytes of each text, from its windows."""
            size = np.diff(cuts)
            count = -(-size // window)
            own = np.repeat(np.arange(len(size)), count)
            nth = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            start = cuts[own] + nth * window
            reach = np.minimum(size[own] - nth * window, window + context)
            out = np.zeros((len(names), len(size)))
            for later in (False, True):
                some = np.flatnonzero((nth > 0) == later)
                some = some[np.argsort(-reach[some], kind="stable")]
                for at in range(0, len(some), 2048):
                    part = some[at : at + 2048]
                    sums = sums_of(net, data, start[part], reach[part], later, window, context)
                    for k in range(len(names)):
                        out[k] += np.bincount(own[part], sums[k], len(size))
            return out

        for whole in batches:
            for b in limited(whole):
                text = pc.fill_null(b.column(1).cast(pa.large_string()), "")
                letters = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
                best, score = np.full(b.num_rows, und, object), np.zeros(b.num_rows)
                if net is not None and letters.any():
                    read = text.filter(pa.array(letters)).cast(pa.large_binary())
                    cuts = np.frombuffer(read.buffers()[1], np.int64)[read.offset : read.offset + len(read) + 1]
                    p = distributions(np.frombuffer(read.buffers()[2], np.uint8), cuts) / np.diff(cuts)
                    best[letters] = np.array(names, object)[p.argmax(0)]
                    score[letters] = np.minimum(p.max(0), 1.0)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns) if i != 1 or keep_columns), pa.array(best.tolist(), pa.string()), pa.array(score, pa.float64())], out_names)

    rest = [c for c in docs.columns if c not in (id_col, text_col, *results)] if keep_columns else []
    chosen = docs.select(id_col, text_col, *rest)
    kinds = dict(chosen.dtypes)
    fields = [(id_col if keep_columns else "doc_id", kinds[id_col])] + ([(c, kinds[c]) for c in (text_col, *rest)] if keep_columns else [])
    fields += [(results[0], "string"), (results[1], "double")]
    out_names = [n for n, _ in fields]
    return chosen.mapInArrow(freeing(run), ", ".join(f"`{n}` {t}" for n, t in fields))


def held_out(doc_id):
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "utf-8")), F.lit(5)) == 0


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(training_rows(docs, lambda i: ~held_out(i)))
    return predict(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
