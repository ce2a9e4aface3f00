"""Personal data: patterned entities, and the terms that give them away.

Everything is DataFrame and SQL functions.  Emails, IP addresses, card and
phone numbers are found by pattern in the whole text.  Their positions come
from the pieces between matches, so nothing is searched twice.

Then the corpus says which other terms disclose an entity.  The unit of
co-occurrence is a line; lines of over ``UNIT`` characters are cut at blanks
into units of that length, so that work grows with a line's length and not with
its square (an entity that such a cut divides counts in neither unit).  With N
units, n(e) units holding entity e, n(t) units holding term t and n(t,e)
holding both, the information that t gives on e is the pointwise mutual
information log2(n(t,e) N / (n(t) n(e))), and e holds log2(N / n(e)).  Their
ratio is the share of e that t discloses.  Where both occur together in at
least ``min_support`` different units, t is removed beside e at a share of
``remove_at`` or more, and generalised from ``generalise_at`` on, to its class
(a name, an acronym or a word).  Counts cover all units; copies count as often
as they occur, but are no support by themselves.

Frequent entities and terms are split over shards in every join.

Defined results: null text is empty; empty text has no spans; texts and lines
of any length are read whole; of several entities beside a term the one that it
discloses most decides; repeated rows each get a row (and equal rows the same
spans, counted once); an empty table gives no rows; other columns don't matter.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_spread, stored, table

KINDS = ("email", "ip", "card", "phone", "term", "general")
#: A run of address characters is tried from its start only (or from the end
#: of a match), and never backed into: same matches, linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"\p{L}[\p{L}\p{M}]{2,}+"

MIN_SUPPORT, GENERALISE_AT, REMOVE_AT = 2, 0.75, 0.9
UNIT, CHUNK = 1000, 256
#: Stretches of a text that are its units, one after another.
UNITS = rf"[^\n]{{0,{UNIT}}}(?:[\n ]|\z)|[^\n]{{1,{UNIT}}}"
SPAN = "struct<start:int,kind:int,end:int>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.length(_digits(m)).between(14, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _let(value: Column, use) -> Column:
    """``use`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(sizes: Column, first: Column) -> Column:
    """What is before each of ``sizes``, from ``first`` on; for short arrays, as it copies its result at each step."""
    start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("all"))
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))
    return F.aggregate(sizes, start, step, lambda acc: acc["all"])


def _starts(sizes: Column) -> Column:
    """The sum of what is before each of ``sizes``, by chunks, so that long arrays take linear time."""
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / CHUNK).cast("int")), lambda i: F.slice(s, i * CHUNK + 1, CHUNK))
    whole = lambda c: _running(F.transform(c, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y)), F.lit(0))
    each = lambda c, before: F.flatten(F.transform(c, lambda x, i: _running(x, F.get(before, i))))
    return _let(sizes, lambda s: _let(cut(s), lambda c: _let(whole(c), lambda before: each(c, before))))


def _positions(text: Column, pattern: str, kind: int, valid) -> Column:
    """array<SPAN> of the valid matches of ``pattern``, by position."""
    none = F.array().cast(f"array<{SPAN}>")

    def spans(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(found), F.lit(1)))
        pairs = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), found.alias("hit"))

        def one(x: Column, before: Column) -> Column:
            start = before + x["gap"]
            return F.when(valid(x["hit"]), F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["hit"])).alias("end")))

        each = lambda p, at: F.filter(F.transform(p, lambda x, i: one(x, F.get(at, i))), lambda x: x.isNotNull())
        return _let(pairs, lambda p: _let(_starts(F.transform(p, lambda x: x["gap"] + F.length(x["hit"]))), lambda at: each(p, at)))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, spans(found)).otherwise(none))


def base_spans(text: Column) -> Column:
    """array<SPAN> of emails, IPs, cards and phones, by start, then kind."""
    none = F.array().cast(f"array<{SPAN}>")
    quick = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.contains("+")}
    found = [F.when(quick[k], _positions(text, p, i, lambda m, k=k: _valid(k, m))).otherwise(none) for i, (k, p) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE)))]
    return F.array_sort(F.concat(*found))


def spans_text(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNITS), F.lit(0))


def _words(unit: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(unit), F.lit(WORD), F.lit(0)))


def entity_units(texts: DataFrame) -> DataFrame:
    """(doc_id, row, at, unit, spans, entities): each unit of ``texts`` (doc_id, row, text) that holds an entity, once."""
    may = lambda c: F.col(c).contains("@") | F.col(c).rlike(r"[0-9][\x20().-]*[0-9]")
    pieces = texts.where(may("text")).select("doc_id", "row", _units(F.col("text")).alias("units"))
    pieces = pieces.select("doc_id", "row", F.explode(F.arrays_zip(_starts(F.transform("units", F.length)).alias("at"), F.col("units").alias("unit"))).alias("x"))
    found = pieces.select("doc_id", "row", "x.*").where(may("unit")).withColumn("spans", base_spans(F.col("unit"))).where(F.size("spans") > 0)
    entity = lambda s: F.concat_ws(":", s["kind"].cast("string"), F.lower(F.substring(F.col("unit"), s["start"] + 1, s["end"] - s["start"])))
    return found.withColumn("entities", F.array_distinct(F.transform("spans", entity))).dropDuplicates(["doc_id", "row", "at"])


def disclosing_terms(texts: DataFrame, units: DataFrame, min_support: int, generalise_at: float) -> DataFrame:
    """(entity, term, share, n_e, n_te) at a share of ``generalise_at`` or more; ``units`` as from ``entity_units``, stored."""
    each = units.select(F.explode("entities").alias("entity"), F.xxhash64("unit").alias("hash"), "unit")
    support = each.groupBy("entity").agg(F.count("*").alias("n_e"), F.count_distinct("hash").alias("different")).where(F.col("different") >= min_support)
    support = stored(support.select("entity", "n_e"))
    near = join_spread(each, support, ["entity"], "n_e", "hash", "inner").select("entity", "n_e", "hash", F.explode(_words(F.col("unit"))).alias("term"))
    pairs = near.groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_te"), F.count_distinct("hash").alias("lines")).where(F.col("lines") >= min_support)
    all_units = texts.select(_units(F.col("text")).alias("units"))
    terms = stored(all_units.select(F.explode("units").alias("unit")).select(F.explode(_words(F.col("unit"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")))
    total = float(all_units.agg(F.sum(F.size("units"))).first()[0] or 1)
    share = F.log2(F.col("n_te") * F.lit(total) / (F.col("n_t") * F.col("n_e"))) / F.log2(F.greatest(F.lit(total) / F.col("n_e"), F.lit(1.0 + 1e-9)))
    return join_spread(pairs, terms, ["term"], "n_t", "entity", "inner").select("entity", "term", share.alias("share"), "n_e", "n_te").where(F.col("share") >= generalise_at)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_support: int = MIN_SUPPORT, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """doc_id, row (hash of the text), base and spans: arrays of (start, kind, end) without and with disclosing terms."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text, F.length(text)).alias("row"), text.alias("text"))
    base = stored(texts.select("doc_id", "row", base_spans(F.col("text")).alias("spans")))
    units = stored(entity_units(texts))
    flagged = stored(disclosing_terms(texts, units, min_support, generalise_at))
    entities = stored(flagged.groupBy("entity").agg(F.first("n_e").alias("n_e")))
    near = units.select("doc_id", "row", "at", "unit", F.explode("entities").alias("entity"))
    near = join_spread(near, entities, ["entity"], "n_e", "row", "inner").select("doc_id", "row", "at", "entity", F.explode(_words(F.col("unit"))).alias("term"))
    hits = join_spread(near, flagged.drop("n_e"), ["entity", "term"], "n_te", "row", "inner")
    hits = hits.groupBy("doc_id", "row", "at").agg(F.collect_list(F.struct("term", "share")).alias("hits"))  # of one unit
    h, u = hits.alias("h"), units.alias("u")
    here = u.join(h.hint("merge"), F.col("u.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("u.row") == F.col("h.row")) & (F.col("u.at") == F.col("h.at")))
    here = here.select("u.doc_id", "u.row", "u.at", "unit", "spans", "hits", _positions(F.col("unit"), WORD, 4, lambda m: F.lit(True)).alias("words"))
    spots = here.select("doc_id", "row", "at", "unit", "spans", "hits", F.explode("words").alias("w"))
    word = F.lower(F.substring(F.col("unit"), F.col("w.start") + 1, F.col("w.end") - F.col("w.start")))
    share = F.array_max(F.transform(F.filter("hits", lambda x: x["term"] == F.col("word")), lambda x: x["share"]))
    outside = ~F.exists("spans", lambda b: (b["start"] < F.col("w.end")) & (F.col("w.start") < b["end"]))
    spots = spots.where(outside).withColumn("word", word).withColumn("share", share).where("share IS NOT NULL")
    kind = F.when(F.col("share") >= remove_at, F.lit(4)).otherwise(F.lit(5))
    span = F.struct((F.col("at") + F.col("w.start")).alias("start"), kind.alias("kind"), (F.col("at") + F.col("w.end")).alias("end"))
    added = spots.groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(F.collect_list(span).alias("more"))
    whole = base.join(added, base["doc_id"].eqNullSafe(added["d"]) & (base["row"] == added["r"]), "left")
    return whole.select("doc_id", "row", F.col("spans").alias("base"), F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast(f"array<{SPAN}>")))).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """``docs`` with its text sanitised: entities become [KIND], generalised terms their class, other disclosing terms go.

    The class of a term is [ACRONYM] (capitals alone), [NAME] (a capital first) or [WORD].
    """
    found = find_pii(docs, id_col, text_col, **thresholds).where(F.size("spans") > 0).select(F.col("doc_id").alias("__d"), F.col("row").alias("__r"), F.col("spans").alias("__spans")).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    mark = F.array(*[F.lit("" if k == "term" else f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = s["start"] >= acc["at"]
        term = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        put = F.when(s["kind"] == 5, F.when(term == F.upper(term), "[ACRONYM]").when(term.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")).otherwise(F.get(mark, s["kind"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["done"], F.array(gap, put))).otherwise(acc["done"]).alias("done"))

    clean = F.aggregate("__spans", start, step, lambda acc: F.concat(F.array_join(acc["done"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    joined = docs.join(found, docs[id_col].eqNullSafe(F.col("__d")) & (F.xxhash64(text, F.length(text)) == F.col("__r")), "left")
    return joined.select(*[F.when(F.col("__spans").isNull(), docs[c]).otherwise(clean).alias(c) if c == text_col else docs[c] for c in docs.columns])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
