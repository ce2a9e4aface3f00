import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidewright.llm import pii

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    found = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = (True, k != 1 or max(map(int, m[0].split("."))) <= 255, k != 2 or (14 <= len(digits) <= 19 and luhn(digits)), k != 3 or 10 <= len(digits) <= 15)
            if all(fine):
                found.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_spans_against_brute_force(spark, documents, tmp_path):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab1.2@-+() 9_é😀\n4") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += [None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8 4111 1111 1111 1111 😀a@b.co +1 (961) 555-6946", "0001.2.3.255 256.1.1.1", "same", "same"]
    documents(list(enumerate(texts)), extra=True).write.parquet(str(tmp_path / "documents.parquet"))
    got = pii.op1_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [want.count(k) for k in ("email", "ip", "card", "phone")]


def test_long_runs_take_linear_time(spark, documents):
    texts = ["x@" + ".a" * 20000, "9" * 100000, "a" * 300000, "(" * 1000 + "+1 " + "(" * 50000]
    got = {r["doc_id"]: r["base"] for r in pii.find_pii(documents(list(enumerate(texts)))).collect()}
    assert all(not got[i] for i in range(4))


def test_disclosing_terms_go_and_common_words_stay(documents):
    rows = [(i, f"the agent zorblax number {i} wrote from mole@secret.org today\nand the rest is plain") for i in range(4)]
    rows += [(i, f"the agent number {i} wrote to nobody today\nand the rest is plain") for i in range(4, 60)]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(documents(rows)).collect()}
    assert "zorblax" not in clean[0] and "mole@" not in clean[0] and "[EMAIL]" in clean[0] and "today" in clean[0] and "plain" in clean[0]
    assert clean[10] == rows[10][1]


def brute_terms(rows, support=2, generalise=0.75, remove=0.9):
    """Added spans by the definition, unit by unit (lines, all short)."""
    units, n_t, n_e, n_te, differ = [], {}, {}, {}, {}
    for i, t in rows:
        at = 0
        for line in (t or "").split("\n"):
            spans = [(int(a), k, int(b)) for k, a, b in (x.split(":") for x in brute(line).split(",") if x)]
            words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{3,}", line)]
            units.append((i, at, line, spans, words))
            at += len(line) + 1
    for _, _, line, spans, words in units:
        for w in {x[2] for x in words}:
            n_t[w] = n_t.get(w, 0) + 1
        for e in {(k, line[a:b].lower()) for a, k, b in spans}:
            n_e[e] = n_e.get(e, 0) + 1
            for w in {x[2] for x in words}:
                n_te[e, w] = n_te.get((e, w), 0) + 1
                differ.setdefault((e, w), set()).add(line)
    out = {i: [] for i, _ in rows}
    for i, at, line, spans, words in units:
        for a, b, w in words:
            if any(x < b and a < y for x, _, y in spans):
                continue
            shares = [math.log2(n_te[e, w] * len(units) / (n_t[w] * n_e[e])) / math.log2(len(units) / n_e[e]) for e in {(k, line[x:y].lower()) for x, k, y in spans} if len(differ[e, w]) >= support]
            if shares and max(shares) >= generalise:
                out[i].append(f"{'term' if max(shares) >= remove else 'general'}:{at + a}:{at + b}")
    return out


def test_disclosing_terms_against_brute_force(documents):
    rng = random.Random(2)
    words = ["zorblax", "Quill", "NATO", "report", "the", "from", "wrote", "garden", "silver", "moon"]
    people = [f"p{k}@x{k}.org" for k in range(4)] + ["+1 (961) 555-6946", "10.2.3.4"]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(people))
            line = [rng.choice(words[4:]) for _ in range(4)] + ([people[k], words[k % 3]] if rng.random() < 0.4 else [])
            rng.shuffle(line)
            lines.append(" ".join(line))
        rows.append((i, "\n".join(lines)))
    rows += [(900, None), (901, "")]
    want = brute_terms(rows)
    assert sum(map(len, want.values())) > 30
    for r in pii.find_pii(documents(rows)).select("doc_id", pii.spans_text(F.col("base")).alias("base"), pii.spans_text(F.col("spans")).alias("spans")).collect():
        assert sorted(filter(None, r["spans"].split(","))) == sorted([*filter(None, r["base"].split(",")), *want[r["doc_id"]]])


def test_a_line_of_many_addresses(documents):
    line = " ".join(f"user{k}@host{k % 50}.org name{k % 7}" for k in range(10_000))
    began = time.time()
    got = pii.find_pii(documents([(1, line), (2, "x " + line), (3, line + " end")])).collect()
    assert all(len(r["base"]) == 10_000 for r in got) and time.time() - began < 120


def test_units_are_the_whole_text(spark):
    texts = ["", "a\n\nb", "x" * 2500, "word " * 1000 + "\nend", "\n", ("y" * 999 + " ") * 3, "é😀 " * 900]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: (r["u"], r["s"]) for r in frame.select("i", pii._units(F.col("t")).alias("u")).select("i", "u", pii._starts(F.transform("u", F.length)).alias("s")).collect()}
    for i, t in enumerate(texts):
        units, starts = got[i]
        assert "".join(units) == t and all(len(u) <= pii.UNIT + 1 for u in units) and starts == [sum(map(len, units[:k])) for k in range(len(units))]


def test_empty_table_and_copies_alone_are_no_evidence(documents):
    assert pii.find_pii(documents([])).isEmpty()
    same = "call zorblax at mole@secret.org now"
    got = pii.find_pii(documents([(1, same), (2, same), (3, None), (None, "x@y.z")])).collect()
    assert len(got) == 4 and all(len(r["spans"]) == len(r["base"]) for r in got)


@pytest.mark.parametrize("text", ["+12345678901234567", "+1 23", "1234 5678 9012 3456"])
def test_failing_matches_are_dropped(documents, text):
    assert not pii.find_pii(documents([(1, text)])).first()["base"]
