"""Packing token sequences by an order-preserving dynamic program.

Documents keep the order in which their partition is read.  Their ids form one
stream; a sequence is a window of at most ``length`` ids.  Cuts may lie at
document ends (free), sentence ends (a small penalty) and, inside runs without
any sentence end, at every ``stride`` ids (a larger one).  With c_j the ids
before cut j and p_j its penalty, the best cost up to j is

    f(j) = p_j + length - c_j + min over i with c_j - c_i <= length of f(i) + c_i

padding plus penalties; the minimum over a sliding window comes from a monotone
queue, so the program is linear in the cuts.  A window whose size is a power of
two needs no padding, which the program uses for halves of ``length``.

Blocks of documents are solved in turn; the ids of a block's last sequence go
to the next block, so only a partition's last sequence can be short, and that
is cut into powers of two where that is cheaper.  Memory is bounded by a block
(or one document).  Sequence ids hold the partition number above bit 32; a
lost task that runs again reads the same split and gives the same pieces.

Defined results: null or empty text is the end id alone; texts and white space
may be of any length; repeated rows are packed each; special-token strings in a text are ordinary text; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freeing, table

LENGTH, END_ID, BLOCK_IDS, STRIDE = 2048, 1, 600_000, 32
SENTENCE_PENALTY, INSIDE_PENALTY = 2.0, 8.0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Pre-tokenizer pattern of byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of the White_Space property (fixed value), and how many in a row are merged apart.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_SPACE = 10_000


def merger(path: str):
    """(text -> ids by a faster merge of the same vocabulary file, bytes of each id), or None where that can't be the same.

    It can where the file is a byte-level BPE with the usual pattern, no prefix
    space or other steps, and ids in the order of its merges.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get(x + y) for x, y in merges]
    if len(ranks) != 256 + len(merges) or made != list(range(256, 256 + len(merges))):
        return None
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _long_space_apart(own.encode_ordinary, own._encode_single_piece), {i: t for t, i in ranks.items()}


def _long_space_apart(merge, single):
    """``merge`` for any text: the pattern engine's stack overflows on very long white space, so that is merged as the one piece that it is.

    By the pattern, white space is one piece, but for its last character where text follows.
    """
    import re

    run = re.compile(f"(?<![{SPACE}])[{SPACE}]{{{LONG_SPACE},}}")

    def ids_of(text: str) -> list:
        if len(text) < LONG_SPACE:
            return merge(text)
        ids, at = [], 0
        for m in run.finditer(text):
            stop = m.end() - (m.end() < len(text))
            ids += merge(text[at : m.start()])
            ids += single(text[m.start() : stop])
            at = stop
        return ids + merge(text[at:])

    return ids_of


def tokenizer(path: str):
    """text -> list of ids, for a whole column: words are encoded once for each batch.

    The vocabulary file is a tokenizers JSON.  A single blank between two
    characters that aren't white space always begins a token of the byte-level
    pre-tokenizer, so the parts between such blanks are encoded apart, each
    distinct one once; texts with other runs of white space at blanks are
    encoded whole.
    """
    import os
    from itertools import chain

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from tokenizers import Tokenizer

    found = merger(path)
    merge, shown = found or (None, None)
    if found is None:
        tk = Tokenizer.from_file(path)
        tk.encode_special_tokens = True
        shown = {i: tk.decode([i], skip_special_tokens=False).encode() for i in range(tk.get_vocab_size())}
    ends_sentence = np.zeros(max(shown) + 2, bool)
    for i, t in shown.items():
        ends_sentence[i] = t.rstrip(b"\"')").endswith((b".", b"!", b"?", b"\n", "。".encode()))

    def pieces(words: list[str]) -> list:
        if merge is not None:
            return list(map(merge, words))
        return [e.ids for at in range(0, len(words), 4096) for e in tk.encode_batch_fast(words[at : at + 4096], add_special_tokens=False)]

    def encode(texts: pa.Array) -> list[np.ndarray]:
        """int32 ids of each text, without an end id."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, r" [\s\p{Z}\x{85}]|[\s\p{Z}\x{85}] | $")
        lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        flat, bounds = lists.flatten(), lists.offsets.to_numpy()
        coded = flat.dictionary_encode()
        index, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        first = np.zeros(len(index), bool)
        first[bounds[:-1]] = True
        lead, rest = np.unique(index[first]), np.unique(index[~first])
        ids = [()] * (2 * len(words))
        for k, v in zip(lead.tolist(), pieces([words[i] for i in lead.tolist()])):
            ids[k] = v
        for k, v in zip((rest + len(words)).tolist(), pieces([" " + words[i] for i in rest.tolist()])):
            ids[k] = v
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        pool = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
        at = np.cumsum(size) - size
        which = index.astype(np.int64) + np.where(first, 0, len(words))
        n = size[which]
        ends = np.cumsum(n)
        spot = np.repeat((at[which] - (ends - n)).astype(np.int32), n)
        spot += np.arange(len(spot), dtype=np.int32)
        stream = pool[spot]
        del spot, which, n, flat, coded, index
        cuts = np.concatenate([[0], ends])[bounds]
        out = [stream[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[k] = np.array(pieces([texts[k].as_py()])[0], np.int32)
        return out

    return ends_sentence, encode


def best_cuts(places, penalties, length: int = LENGTH) -> list[int]:
    """Indices of the chosen cuts among ``places`` (rising, from 0, steps of at most ``length``), ends included."""
    from collections import deque

    n, half = len(places), length // 2
    cost, back = [0.0] * n, [0] * n
    queue: deque = deque([0])
    key = [0.0] * n
    halves: dict[int, int] = {places[0]: 0}
    for j in range(1, n):
        c = places[j]
        while c - places[queue[0]] > length:
            queue.popleft()
        i = queue[0]
        best = key[i] + length - c
        k = halves.get(c - half)
        if k is not None and cost[k] < best:
            best, i = cost[k], k
        best += penalties[j]
        cost[j], back[j] = best, i
        halves[c] = j
        v = key[j] = best + c
        while queue and key[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    out, j = [n - 1], n - 1
    while j:
        j = back[j]
        out.append(j)
    return out[::-1]


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of ``docs`` in packed sequences; columns as in SCHEMA."""
    tokens, cuts_of, block_ids, stride = tokenizer, best_cuts, BLOCK_IDS, STRIDE
    soft, hard, schema = SENTENCE_PENALTY, INSIDE_PENALTY, SCHEMA

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        ends_sentence, encode = tokens(vocabulary)
        sequence = TaskContext.get().partitionId() << 32
        names = [f.split()[0] for f in schema.split(", ")]
        held: list[tuple] = []  # (doc_id, all ids, ids before this rest, rest)
        n_held = 0

        def solve(last: bool):
            """Packs what is held; gives the pieces and keeps the last sequence's, unless ``last``."""
            nonlocal held, n_held, sequence
            stream = np.concatenate([x[3] for x in held])
            doc_ends = np.cumsum([len(x[3]) for x in held])
            price = np.full(len(stream) + 1, np.inf)
            price[1:][ends_sentence[stream]] = soft
            price[doc_ends] = 0
            price[0] = 0
            open_ = np.flatnonzero(np.isfinite(price))
            gaps = np.diff(open_)
            for k in np.flatnonzero(gaps > stride).tolist():
                price[np.arange(open_[k] + stride, open_[k + 1], stride)] = hard
            places = np.flatnonzero(np.isfinite(price))
            chosen = places[cuts_of(places.tolist(), price[places].tolist(), length)].tolist()
            if last:  # the rest in powers of two, where the last window is short
                a, b = chosen[-2], chosen[-1]
                if bin(b - a).count("1") <= 4:
                    for k in range(length.bit_length(), -1, -1):
                        if (b - a) >> k & 1 and a + (1 << k) < b:
                            a += 1 << k
                            chosen.insert(-1, a)
            stop = len(stream) if last else chosen[-2]
            rows = [[] for _ in names]
            begin = k = 0
            rest = []
            while k < len(held) and stop:
                doc, whole, before, ids = held[k]
                end = begin + len(ids)
                if begin >= stop:
                    break
                at = begin
                i = np.searchsorted(chosen, at, side="right")
                while at < min(end, stop):
                    to = min(end, chosen[i])
                    part = ids[at - begin : to - begin]
                    for column, v in zip(rows, (doc, before + at - begin, to - at, zlib.crc32(part.astype("<u4").tobytes()), whole, sequence + int(i) - 1, at - chosen[i - 1])):
                        column.append(v)
                    at = to
                    i += 1
                if end > stop:
                    rest.append((doc, whole, before + stop - begin, ids[stop - begin :]))
                begin = end
                k += 1
            sequence += len(chosen) - (1 if last else 2)
            held = rest + held[k:]
            n_held = sum(len(x[3]) for x in held)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names)

        def limited(batch):
            """Slices of some MB of text each."""
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + 2_500_000, side="right")))
                yield batch.slice(a, b - a)
                a = b

        for whole_batch in batches:
            for batch in limited(whole_batch):
                for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                    ids = np.append(ids, np.int32(end_id))
                    held.append((doc, len(ids), 0, ids))
                    n_held += len(ids)
                    if n_held >= block_ids:
                        yield solve(False)
        if held:
            yield solve(True)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(freeing(run), schema)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
