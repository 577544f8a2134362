"""Personal data and the terms that give it away.

Base spans are e-mail addresses, IPv4 addresses, card numbers and phone numbers. Each found value is an
entity to protect. Over the corpus, the share of an entity's information that a term reveals is

    PMI(term, entity) / IC(entity) = log(N n_te / (n_t n_e)) / log(N / n_e),

with counts of documents. A term that occurs with an entity in ``MIN_SUPPORT`` different texts or more (copies
of one text are one observation) and reveals ``GENERALISE`` of it is generalised in the texts that name the
entity; one that reveals ``REMOVE`` is removed.

Only texts with an entity hand over their words, and only terms with enough support are counted over the
corpus; that list is measured before it is broadcast and joined by a shuffle beyond the bound.

Defined cases: null and empty texts have no spans; a null key and repeated rows are kept; rows equal in
key and text get the same spans; an empty table gives an empty result; other columns are kept and may have
any name but those that start with an underscore.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import row_keys, slices, written

KINDS = ["email", "ip", "card", "phone"]
TERM = "term"
MIN_SUPPORT = 3
GENERALISE, REMOVE = 0.8, 0.97
BROADCAST_TERMS = 1_000_000

#: The base patterns. A run of digits is tried from its first digit only, which changes no match.
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")
WORDS = re.compile(r"[^\W_]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@``: every address has just one, and its local part ends there."""
    last = 0
    at = text.find("@")
    while at >= 0:
        first = at
        while first > last and text[first - 1] in EMAIL_LOCAL:
            first -= 1
        tail = EMAIL_TAIL.match(text, at) if first < at else None
        if tail:
            last = tail.end()
            yield first, last
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` in code points, by start, then kind as listed."""
    found = [(a, 0, z) for a, z in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(a, KINDS[k], z) for a, k, z in sorted(found)]


def entity(kind: str, value: str) -> str:
    """One form for the ways an entity is written."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else NOT_DIGIT.sub('', value)}"


SPAN = "array<struct<kind:string,start:int,end:int>>"


def find_base(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id, _row, _copy, spans, entities, words``: words (with places) only of texts that name an entity."""
    source = row_keys(docs, key, text)
    kind = source.schema["_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        word = pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in slices(batches, "_text"):
            spans, entities, words = [], [], []
            for t in batch.column("_text").to_pylist():
                found = base_spans(t) if t else []
                spans.append([{"kind": k, "start": a, "end": z} for a, k, z in found])
                entities.append(sorted({entity(k, t[a:z]) for a, k, z in found}))
                inside = [(a, z) for a, _, z in found]
                words.append([
                    {"term": m.group().lower(), "start": m.start(), "end": m.end()} for m in WORDS.finditer(t)
                    if not any(a < m.end() and m.start() < z for a, z in inside)
                ] if found else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_row"), batch.column("_copy"), pa.array(spans, pa.list_(span)),
                 pa.array(entities, pa.list_(pa.string())), pa.array(words, pa.list_(word))],
                ["_id", "_row", "_copy", "spans", "entities", "words"],
            )

    copies = source.withColumn("_copy", F.xxhash64("_text"))
    return copies.mapInArrow(
        find, f"_id {kind}, _row bigint, _copy bigint, spans {SPAN}, entities array<string>, words array<struct<term:string,start:int,end:int>>"
    )


def disclosing_terms(found: DataFrame, docs: DataFrame, text: str = "text", min_support: int = MIN_SUPPORT) -> DataFrame:
    """``entity, term, share``: terms that reveal at least ``GENERALISE`` of an entity's information."""
    named = found.where(F.size("entities") > 0)
    support, copies = F.count(F.lit(1)).alias("support"), F.sum("copies")
    # Entities alone come first: few are named in enough texts, and only their texts hand over words.
    lists = named.groupBy("_copy").agg(F.count(F.lit(1)).alias("copies"), F.first("entities").alias("entities"))
    entities = lists.select("copies", F.explode("entities").alias("entity"))
    known = cut(entities.groupBy("entity").agg(support, copies.alias("n_e")).where(F.col("support") >= min_support).drop("support"))
    few = known.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    terms = F.array_distinct(F.transform("words", lambda w: w["term"]))
    asked = named.select("_copy", "words", F.explode("entities").alias("entity")).join(F.broadcast(known) if few else known, "entity")
    texts = asked.select("entity", "n_e", "_copy", terms.alias("terms")).groupBy("entity", "n_e", "_copy").agg(F.count(F.lit(1)).alias("copies"), F.first("terms").alias("terms"))
    pairs = (
        texts.select("entity", "n_e", "copies", F.explode("terms").alias("term"))
        .groupBy("entity", "n_e", "term").agg(support, copies.alias("n_te")).where(F.col("support") >= min_support)
    )
    pairs = cut(pairs)
    terms = pairs.select("term").distinct()
    small = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    # The same words as in the tasks: runs of letters and digits.
    lower = F.lower(F.col(text).cast("string"))
    seen = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit("[\\p{L}\\p{N}]+"), 0))).alias("term"))
    counted = seen.join(F.broadcast(terms) if small else terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    pmi = F.log(n * F.col("n_te") / (F.greatest("n_t", "n_te") * F.col("n_e")))
    scored = pairs.join(counted, "term").withColumn("share", pmi / F.log(n / F.col("n_e")))
    return scored.where(F.col("share") >= GENERALISE).select("entity", "term", "share")


def all_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id, _row, spans`` of every row; kinds are ``KINDS`` and, for disclosing terms, ``term`` or ``removed_term``."""
    found = written(find_base(docs, key, text), "spans")[0]
    if not found.where(F.size("entities") > 0).limit(1).count():
        return found.select("_id", "_row", "spans")
    terms = disclosing_terms(found, docs, text)
    named = found.where(F.size("entities") > 0)
    asked = named.select("_id", "_row", F.explode("entities").alias("entity")).distinct().join(terms, "entity")
    per_row = (
        asked.groupBy("_id", "_row", "term").agg(F.max("share").alias("share"))
        .groupBy("_id", "_row").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("_terms"))
        .withColumnsRenamed({"_id": "_term_id", "_row": "_term_row"})
    )
    share = lambda w: F.try_element_at(F.col("_terms"), w["term"])
    hit = F.filter("words", lambda w: share(w).isNotNull())
    kind = lambda w: F.when(share(w) >= REMOVE, "removed_" + TERM).otherwise(TERM)
    extra = F.transform(hit, lambda w: F.struct(kind(w).alias("kind"), w["start"].alias("start"), w["end"].alias("end")))
    same = F.col("_id").eqNullSafe(F.col("_term_id")) & (F.col("_row") == F.col("_term_row"))
    joined = found.join(per_row, same, "left")
    both = F.when(F.col("_terms").isNull(), F.col("spans")).otherwise(F.concat("spans", extra.cast(SPAN)))
    return joined.select("_id", "_row", both.alias("spans"))


def span_string(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    order = F.create_map(*[x for i, k in enumerate([*KINDS, TERM, "removed_" + TERM]) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.element_at(order, s["kind"]).alias("k"), s["end"].alias("z"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["a"], s["z"])), ",")


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns with ``text`` sanitised: base values become ``[KIND]``, terms ``[TERM]`` or nothing."""
    spans = all_spans(docs, key, text).where(F.size("spans") > 0).dropDuplicates(["_id", "_row"])
    keyed = docs.withColumn("_row", F.xxhash64(key, F.coalesce(F.col(text), F.lit("\x00"))))
    right = spans.select(F.col("_id").alias("_span_id"), F.col("_row").alias("_span_row"), F.col("spans").alias("_spans"))
    joined = keyed.join(right, F.col(key).eqNullSafe(F.col("_span_id")) & (F.col("_row") == F.col("_span_row")), "left")
    # Spans by start; one that begins inside an earlier span adds nothing of its own but its end.
    ordered = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("z"), s["kind"].alias("k"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        mark = F.when(s["k"] == "removed_" + TERM, "").otherwise(F.concat(F.lit("["), F.upper(s["k"]), F.lit("]")))
        gap = F.substring(F.col(text), acc["at"] + 1, s["a"] - acc["at"])
        new = F.struct(F.concat(acc["out"], gap, mark).alias("out"), s["z"].alias("at"))
        return F.when(s["a"] >= acc["at"], new).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["z"]).alias("at")))

    clean = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, 2_000_000_000)))
    out = F.when(F.col("_spans").isNull(), F.col(text)).otherwise(clean)
    return joined.select(*[out.alias(c) if c == text else F.col(c) for c in docs.columns])
