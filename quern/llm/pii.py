"""Personal data: fixed patterns, and terms that reveal the entities they stand by (operator 7).

The patterns find emails, IPv4 addresses, card and phone numbers in whole texts, in linear time.
Then corpus co-occurrence tells how strongly a term discloses an entity: of the
distinct texts that hold the term, the share in which it stands within ``NEAR`` words of the same
entity (a passage that many texts share counts in each, copies of a text count once), and the pointwise
mutual information of both. Terms with enough such texts (``SUPPORT``), a share
of at least ``DISCLOSURE`` and at least ``BITS`` bits, or where the entity itself is not as rare, ``PART`` of the bits that
tell it (so that small corpora and frequent entities have disclosing terms too) are spans of kind ``term`` wherever they stand. In texts, patterns
are generalised to their kind and terms are removed.

Counts cover all documents. Up to ``SENT`` terms (and ``SENT_BYTES`` of them) are sent to the tasks, which then find
and rewrite spans in one pass without a shuffle. More terms stay a table: a bit filter, sized by
their number, tells the tasks which words may be terms, those words are joined with the terms, and
texts get the places by a join on the text.

Null text is empty: no spans. Null and repeated doc_ids are rows like others, and columns may have any other names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.textual import batches
from quern.storage import scratch, stored

KINDS = ("email", "ip", "card", "phone", "term")
NEAR, SUPPORT, DISCLOSURE, BITS = 5, 3, 0.5, 8.0
PART = 0.5
#: Terms, and their UTF-8 bytes, that are sent to every task; bits of the filter for more: 8 a term, between these powers of two.
SENT, SENT_BYTES, FILTER_BITS = 500_000, 16 << 20, (20, 28)

Span = tuple[str, int, int]

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_dotted = re.compile(r"[0-9.]+")
_part = re.compile(r"[0-9]+")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")
_word = re.compile(r"[^\W_]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _local:
            start -= 1
        m = _domain.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for run in _dotted.finditer(text):
        own: list[tuple[int, int]] = []
        for m in _part.finditer(text, run.start(), run.end()):
            if own and m.start() != own[-1][1] + 1:  # two dots: a match cannot go across
                own = []
            own.append(m.span())
            if len(own) == 4:
                if all(b - a < 20 and int(text[a:b]) <= 255 or b - a >= 20 and int(text[a:b].lstrip("0")[:4] or 0) <= 255 and len(text[a:b].lstrip("0")) <= 3 for a, b in own):
                    yield own[0][0], own[3][1]
                own = []


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start and then kind; code points, end exclusive."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _digit.search(text):
        if "." in text:
            out += [("ip", a, b) for a, b in ips(text)]
        for m in _card.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _phone.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return _order(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sanitised(text: str, spans: list[Span]) -> str:
    """``text`` with overlapping spans as one: patterns become [KIND], terms go."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        kinds = [kind]
        while i + 1 < len(spans) and spans[i + 1][1] < end:
            i += 1
            kinds.append(spans[i][0])
            end = max(end, spans[i][2])
        kind = next((k for k in kinds if k != "term"), "term")
        out += [text[at:start], "" if kind == "term" else f"[{kind.upper()}]"]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


def _key(term: str) -> int:
    return xxhash.xxh64_intdigest(term) - (1 << 63)


def _free_words(text: str, spans: list[Span]) -> list[tuple[str, int, int]]:
    """(word, start, end) of the words, numbers aside, that no span touches."""
    out, k, to = [], 0, 0
    for m in _word.finditer(text):
        while k < len(spans) and spans[k][1] < m.end():
            to = max(to, spans[k][2])
            k += 1
        if to <= m.start() and not m[0].isdecimal():
            out.append((m[0].lower(), *m.span()))
    return out


def _contexts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, entity, text) for the words around each entity."""
    for b in it:
        rows: list[tuple[str, int, int]] = []
        for text in b["text"].to_pylist():
            if not (spans := base_spans(text or "")):
                continue
            whole = _key(text)
            words = _free_words(text, spans)
            starts, ends = [w[1] for w in words], [w[2] for w in words]
            for kind, start, end in spans:
                value = text[start:end].lower()
                entity = _key(f"{kind}:{value if kind in ('email', 'ip') else ''.join(c for c in value if c.isdigit())}")
                before, after = bisect_right(ends, start), bisect_left(starts, end)
                rows += [(w, entity, whole) for w in {x[0] for x in words[max(0, before - NEAR) : before] + words[after : after + NEAR]}]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2))], ["term", "entity", "text"])


class Terms:
    """The set of terms itself, or a bit filter that lets all of them (and few other words) through."""

    def __init__(self, table: DataFrame):
        size = table.agg(F.count("*").alias("n"), F.sum(F.octet_length("term")).alias("size")).first()
        self.exact = size["n"] <= SENT and (size["size"] or 0) <= SENT_BYTES
        if self.exact:
            self.words = frozenset(r.term for r in table.select("term").collect())
            return
        low, high = FILTER_BITS
        bits = min(high, max(low, (8 * size["n"]).bit_length()))
        self.table = np.zeros(1 << bits, bool)
        for r in table.select(F.pmod(F.col("key"), F.lit(1 << bits)).alias("c")).distinct().toLocalIterator():
            self.table[r.c] = True
        self.table = np.packbits(self.table, bitorder="little")

    def has(self, word: str) -> bool:
        if self.exact:
            return word in self.words
        k = _key(word) % (8 * len(self.table))
        return bool(self.table[k >> 3] >> (k & 7) & 1)

    def known(self, text: str) -> set[str]:
        """The distinct words of ``text``, as written, that are (or may be) terms."""
        return {w for w in set(_word.findall(text)) if self.has(w.lower())}

    def places(self, text: str, spans: list[Span]) -> list[tuple[str, int, int]]:
        """(word, start, end) of those words where no span is; places are sought only in texts that have any."""
        known = self.known(text)
        out, k, to = [], 0, 0
        for m in _word.finditer(text) if known else ():
            if m[0] not in known:
                continue
            while k < len(spans) and spans[k][1] < m.end():
                to = max(to, spans[k][2])
                k += 1
            if to <= m.start():
                out.append((m[0].lower(), *m.span()))
        return out


def _disclosing(texts: str, every: int) -> Column:
    """Whether a term discloses an entity: of its ``texts``, it is by it in ``both``; the entity is in ``places`` of all ``every`` texts."""
    share, rarity = F.col("both") / F.col(texts), F.log2(F.lit(float(every)) / F.col("places"))
    bits = F.log2(share) + rarity
    return (share >= DISCLOSURE) & (bits > 0) & (bits >= F.least(F.lit(BITS), rarity * PART))


@scratch()
def disclosing_terms(docs: DataFrame) -> DataFrame | None:
    """Stored (term, key) of the terms that disclose an entity; None if there are none."""
    batches(docs.sparkSession)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    every = texts.select(F.xxhash64("text").alias("h")).agg(F.countDistinct("h").alias("n")).first()["n"] or 1
    near = stored(texts.mapInArrow(_contexts, "term string, entity long, text long").distinct(), "contexts")
    both = near.groupBy("term", "entity").agg(F.count("*").alias("both")).filter(F.col("both") >= SUPPORT)
    entities = near.select("entity", "text").distinct().groupBy("entity").agg(F.count("*").alias("places"))
    # a term is in no fewer texts than stand by entities here, so these bounds let every disclosing pair through
    seen = near.select("term", "text").distinct().groupBy("term").agg(F.count("*").alias("seen"))
    pairs = stored(both.join(seen, "term").join(entities, "entity").filter(_disclosing("seen", every)), "pairs")
    if not pairs.limit(1).count():
        return None

    def keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.record_batch([b["term"], pa.array([_key(t) for t in b["term"].to_pylist()], pa.int64())], ["term", "key"])

    terms = stored(pairs.select("term").distinct().mapInArrow(keyed, "term string, key long"), "terms")
    shared = docs.sparkSession.sparkContext.broadcast(Terms(terms))

    def holding(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [(w, _key(t)) for t in b["text"].to_pylist() if t for w in {x.lower() for x in shared.value.known(t)}]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["term", "text"])

    counts = texts.mapInArrow(holding, "term string, text long").distinct().groupBy("term").agg(F.count("*").alias("texts"))
    found = pairs.join(counts, "term").filter(_disclosing("texts", every)).select("term").distinct().join(terms, "term")
    found = stored(found, "disclosing", outlive=True)
    return found if found.limit(1).count() else None


def _order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _with_terms(base: list[Span], text: str, terms: Terms | None) -> list[Span]:
    """``base`` and the places of terms, where these are known here."""
    return _order(base + [("term", a, z) for _, a, z in terms.places(text, base)]) if terms is not None and terms.exact else base


def _spans_by_text(texts: DataFrame, shared: Broadcast, terms: DataFrame) -> DataFrame:
    """(h, size, places) of the texts of ``texts`` (h, size, text) that hold terms, where these are too many to be sent; equal texts once."""

    def words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for h, n, t in zip(b["h"].to_pylist(), b["size"].to_pylist(), b["text"].to_pylist(), strict=True):
                rows += [(h, n, w, a, z) for w, a, z in shared.value.places(t, base_spans(t))] if t else []
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["h", "size", "term", "start", "end"])

    places = texts.mapInArrow(words, "h long, size long, term string, start long, end long").distinct()
    hits = places.join(terms.select("term"), "term").groupBy("h", "size").agg(F.collect_list(F.struct("start", "end")).alias("places"))
    return stored(hits, "places", outlive=True)


def _identity(text: Column) -> tuple[Column, Column]:
    """(h, size) that tell texts apart."""
    return F.xxhash64(text), F.octet_length(text).cast("long")


FOUND = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS[:4]], ("base_sha256", pa.string()), ("spans", pa.string()), ("h", pa.int64()), ("size", pa.int64())])


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs``."""
    spark = docs.sparkSession
    batches(spark)
    names = FOUND.names[:-2]
    ddl = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    with scratch():
        terms = disclosing_terms(docs)
        shared = None if terms is None else spark.sparkContext.broadcast(Terms(terms))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        h, size = _identity(F.col("text"))
        rows = rows.select("doc_id", "text", h.alias("h"), size.alias("size"))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                out = [[] for _ in FOUND]
                for doc_id, text, h, n in zip(*(b[c].to_pylist() for c in ("doc_id", "text", "h", "size")), strict=True):
                    base = base_spans(text or "")
                    kinds = [s[0] for s in base]
                    sha = hashlib.sha256(joined(base).encode()).hexdigest()
                    spans = joined(_with_terms(base, text or "", shared and shared.value))
                    for c, v in zip(out, (doc_id, *(kinds.count(k) for k in KINDS[:4]), sha, spans, h, n), strict=True):
                        c.append(v)
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(out, FOUND, strict=True)], schema=FOUND)

        found = rows.mapInArrow(run, f"{ddl}, h long, size long")
        if shared is None or shared.value.exact:
            return found.select(*names)
        places = _spans_by_text(rows, shared, terms)

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for base, own in zip(b["spans"].to_pylist(), b["places"].to_pylist(), strict=True):
                spans = [(k, int(a), int(z)) for k, a, z in (x.split(":") for x in base.split(",") if x)]
                out.append(joined(_order(spans + [("term", p["start"], p["end"]) for p in own])) if own else base)
            yield pa.record_batch([*(b[c] for c in names[:-1]), pa.array(out, pa.string())], names)

    return found.join(places, ["h", "size"], "left").select(*names, "places").mapInArrow(merge, ddl)


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with sanitised texts (and n_chars made to fit, if there is such a column); null texts stay null."""
    spark = docs.sparkSession
    batches(spark)
    schema, names = docs.schema, docs.columns
    text, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    with scratch():
        terms = disclosing_terms(docs)
        shared = None if terms is None else spark.sparkContext.broadcast(Terms(terms))
        places = None
        if shared is not None and not shared.value.exact:
            h, size = _identity(F.col("text"))
            places = _spans_by_text(docs.select(h.alias("h"), size.alias("size"), "text"), shared, terms)

    def rewrite(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            own = b.column(text).to_pylist()
            more = b.column(len(names)).to_pylist() if b.num_columns > len(names) else [None] * len(own)
            new = []
            for t, extra in zip(own, more, strict=True):
                spans = _with_terms(base_spans(t or ""), t or "", shared and shared.value)
                spans = _order(spans + [("term", p["start"], p["end"]) for p in extra]) if extra else spans
                new.append(sanitised(t, spans) if spans else t)
            columns = [b.column(k) for k in range(len(names))]
            columns[text] = pa.array(new, b.column(text).type)
            if chars is not None:
                columns[chars] = pa.array([n if a == z else len(z) for n, a, z in zip(b.column(chars).to_pylist(), own, new, strict=True)], b.column(chars).type)
            yield pa.record_batch(columns, names)

    if places is None:
        return docs.mapInArrow(rewrite, schema)
    h, size = _identity(F.col(f"c{text}"))
    own = docs.toDF(*[f"c{k}" for k in range(len(names))]).withColumns({"h": h, "size": size})
    return own.join(places, ["h", "size"], "left").select(*[f"c{k}" for k in range(len(names))], "places").mapInArrow(rewrite, schema)
