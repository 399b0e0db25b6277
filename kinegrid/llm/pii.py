"""Personal data by weak supervision, in DataFrame functions only.

Base spans are pattern matches that pass a check of their kind. Besides, labelers (pattern, gazetteer, context, shape)
vote on all candidates: all matches of the patterns, the check failed or passed, and further wide patterns. Vote patterns
are counted over all documents; expectation-maximisation on these counts (their number is bounded by the labelers, not
by the data) estimates each labeler's reliability and each pattern's probability; with these as soft labels a naive
Bayes classifier is trained on features of the span and its surroundings, and the candidates that it accepts are added.

Rows: a null text is an empty one; texts are searched whole; rows that repeat an id and a text have one result, which
each of them gets, rows without an id alike; an empty table gives an empty result; other columns are ignored by `spans` and stay in `masked`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, unused

#: Kinds in their order: those with base spans, then those that only the method finds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "number")
# A run is entered at its start or where the last match ended, and never left again: no text takes more than linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+",
    "number": r"\([0-9]{3}\)\x20?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: What a text must hold for its pattern to be tried.
HINTS = {"email": "@", "phone": "+", "number": "("}
_WINDOW = 24
# Cue words and the gazetteers of the labelers.
CUES = {
    "email": ["mail", "e-mail", "email", "contact", "write"],
    "ip": ["ip", "host", "address", "server", "login"],
    "card": ["card", "visa", "mastercard", "amex", "payment", "pan"],
    "phone": ["phone", "tel", "call", "mobile", "fax"],
    "secret": ["token", "key", "secret", "password", "passwd", "pwd", "bearer"],
    "number": ["phone", "tel", "call", "mobile", "fax"],
}
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk)$",
    "ip": r"^(?!0|127\.|255\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^\+(?:1|3[0-9]|4[0-9]|8[0-9]|9[0-9])",
    "secret": r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})$",
    "number": r"^\([2-9]",
}
LABELERS = ("pattern", "gazetteer", "context", "shape")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    at = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    n = F.length(digits)
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda total, i: total + F.when((n - i) % 2 == 1, doubled(at(i))).otherwise(at(i))) % 10 == 0


def _passes() -> Column:
    """Whether a match is a base span."""
    value, digits = F.col("value"), F.col("digits")
    ip = ~F.exists(F.split(value, r"\."), lambda part: (F.length(F.regexp_replace(part, "^0+", "")) > 3) | (F.lpad(F.regexp_replace(part, "^0+", ""), 3, "0") > "255"))
    return F.when(F.col("kind") == "email", F.lit(True)).when(F.col("kind") == "ip", ip).when(F.col("kind") == "card", F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)).when(F.col("kind") == "phone", F.length(digits).between(9, 15)).otherwise(False)


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*(F.lit(k) for k in (*BASE, *ADDED))), kind)


def candidates(documents: DataFrame) -> DataFrame:
    """A row for each match: doc_id, source (hash of the text), kind, start, end (code points), value, left, right, base.

    Matches and the texts between them give the starts by a running sum, so that it takes time in proportion to a text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select("doc_id", text.alias("text")).withColumn("source", F.xxhash64("text"))
    docs = docs.withColumn("has_digit", F.col("text").rlike("[0-9]"))
    found = []
    for kind, pattern in PATTERNS.items():
        hint = F.contains("text", F.lit(HINTS[kind])) if kind in HINTS else F.lit(True)
        hint = hint & F.col("has_digit") if kind != "email" else hint
        values = F.when(hint, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
        found.append(F.when(F.size(values) > 0, F.arrays_zip(values.alias("value"), F.split("text", pattern, -1).alias("gap"))).alias(kind))
    docs = docs.select("doc_id", "source", *found).where(F.coalesce(*(F.col(k) for k in PATTERNS)).isNotNull()).distinct()
    kinds = F.explode(F.filter(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("parts")) for k in PATTERNS)), lambda x: x["parts"].isNotNull()))
    rows = docs.select("doc_id", "source", kinds.alias("k")).select("doc_id", "source", "k.kind", F.posexplode("k.parts").alias("at", "part"))
    rows = rows.select("doc_id", "source", "kind", "at", "part.value", F.char_length("part.gap").alias("gap"), F.char_length("part.value").alias("length"), F.right("part.gap", F.lit(_WINDOW)).alias("left"), F.substring("part.gap", 1, 1).alias("first"))
    order = Window.partitionBy("doc_id", "source", "kind").orderBy("at")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.coalesce("length", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("right", F.lead("first").over(order))
    rows = rows.where(F.col("value").isNotNull()).withColumn("digits", _digits(F.col("value")))
    # a short run of digits is no candidate of anything
    rows = rows.where((F.col("kind") != "card") | (F.length("digits") >= 9)).where((F.col("kind") != "secret") | F.col("value").rlike("[0-9]"))
    return rows.select("doc_id", "source", "kind", (F.col("end") - F.col("length")).cast("long").alias("start"), F.col("end").cast("long").alias("end"), "value", F.coalesce("left", F.lit("")).alias("left"), F.coalesce("right", F.lit("")).alias("right"), F.coalesce(_passes(), F.lit(False)).alias("base"))


def votes(found: DataFrame) -> DataFrame:
    """Adds a column for each labeler: 1 private, 0 not, -1 no vote."""
    by_kind = lambda values: F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in values.items()))
    digits = _digits(F.col("value"))
    context = by_kind({k: F.lower("left").rlike(r"\b(?:" + "|".join(words) + r")\b") for k, words in CUES.items()})
    gazetteer = by_kind({k: F.col("value").rlike(p) for k, p in GAZETTEER.items()})
    pattern = F.when(F.col("kind").isin(*BASE), F.col("base")).otherwise(F.col("value").rlike(r"^[0-9a-f]{32,}$|^\([0-9]{3}\) [0-9]{3}-[0-9]{4}$"))
    repeats = F.length(F.regexp_replace(digits, r"(.)\1+", "$1")) * 2 <= F.length(digits)
    shape = F.when((F.length(digits) > 0) & repeats, 0).when((F.col("kind") == "card") & ~F.length(digits).isin(13, 14, 15, 16, 19), 0).when((F.col("kind") == "secret") & ~(F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")), 0).when(F.col("right").rlike("^[A-Za-z0-9]"), 0).otherwise(-1)
    return found.withColumns({"pattern": pattern.cast("int"), "gazetteer": gazetteer.cast("int"), "context": F.when(context, 1).otherwise(-1), "shape": shape})


def features(found: DataFrame) -> DataFrame:
    """Adds features with few values each; `base` is none of them."""
    digits = F.length(_digits(F.col("value")))
    last = F.regexp_extract(F.lower("left"), r"([a-z-]+)[^a-z]*$", 1)
    cue = F.coalesce(*(F.when(last.isin(*words), k) for k, words in CUES.items()), F.lit("none"))
    return found.withColumns({
        "f_digits": F.least(digits, F.lit(20)), "f_length": F.least(F.floor(F.length("value") / 4), F.lit(16)).cast("int"), "f_cue": cue,
        "f_before": F.when(F.col("left").rlike(r"[=:]\s*[\"']?$"), 2).when(F.col("left").rlike(r"\s$"), 1).otherwise(0),
        "f_hex": F.col("value").rlike("^[0-9a-f]+$").cast("int"), "f_pattern": F.col("pattern"), "f_gazetteer": F.col("gazetteer"),
    })


@dataclass
class Reliability:
    """What EM has found for a kind: P(vote | class) for each labeler, and P(private)."""

    prior: float = 0.5
    given: dict[str, dict[int, list[float]]] = field(default_factory=dict)

    def posterior(self, votes: dict[str, int]) -> float:
        score = math.log(self.prior / (1 - self.prior))
        for labeler, vote in votes.items():
            if vote >= 0 and labeler in self.given:
                no, yes = self.given[labeler][vote]
                score += math.log(yes / no)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))


def estimate(patterns: list[dict], rounds: int = 50) -> Reliability:
    """EM over (votes, count) rows of one kind. It starts from the labelers' majority; a weak prior holds that labelers are
    better than chance."""
    out = Reliability()
    soft = [0.5 + 0.4 * (v.count(1) - v.count(0)) / max(1, len(v)) for v in ([p[x] for x in LABELERS if p[x] >= 0] for p in patterns)]
    for _ in range(rounds):
        total = sum(p["n"] for p in patterns)
        out.prior = min(0.99, max(0.01, (1 + sum(s * p["n"] for s, p in zip(soft, patterns, strict=True))) / (2 + total)))
        for x in LABELERS:
            table = {1: [1.0, 4.0], 0: [4.0, 1.0]}
            for s, p in zip(soft, patterns, strict=True):
                if p[x] >= 0:
                    table[p[x]][0] += (1 - s) * p["n"]
                    table[p[x]][1] += s * p["n"]
            sums = [table[0][k] + table[1][k] for k in (0, 1)]
            out.given[x] = {v: [table[v][k] / sums[k] for k in (0, 1)] for v in (0, 1)}
        new = [out.posterior({x: p[x] for x in LABELERS}) for p in patterns]
        if max((abs(a - b) for a, b in zip(soft, new, strict=True)), default=0) < 1e-6:
            break
        soft = new
    return out


def classify(found: DataFrame) -> DataFrame:
    """Adds `private`, the classifier's probability. `found` (with votes and features) must be stored: it is read twice."""
    names = [c for c in found.columns if c.startswith("f_")]
    # a row for each kind, vote pattern, and value of one feature: some thousands at most
    one = F.explode(F.array(*(F.struct(F.lit(x).alias("name"), F.col(x).cast("string").alias("value")) for x in names))).alias("feature")
    counted = found.select("kind", *LABELERS, one).groupBy("kind", *LABELERS, "feature").agg(F.count("*").alias("n")).collect()
    rows = [r.asDict(recursive=True) for r in counted]
    score = F.lit(None).cast("double")
    for kind in PATTERNS:
        own = [r for r in rows if r["kind"] == kind]
        # each candidate counts once for each feature
        patterns: dict[tuple, dict] = {}
        for r in own:
            if r["feature"]["name"] == names[0]:
                patterns.setdefault(tuple(r[x] for x in LABELERS), {x: r[x] for x in LABELERS} | {"n": 0})["n"] += r["n"]
        reliability = estimate([patterns[k] for k in sorted(patterns)])
        soft = {k: reliability.posterior({x: p[x] for x in LABELERS}) for k, p in patterns.items()}
        weight = [1 + sum((soft[key] if k else 1 - soft[key]) * p["n"] for key, p in sorted(patterns.items())) for k in (0, 1)]
        total = F.lit(math.log(weight[1] / weight[0]))
        for name in names:
            table: dict = {}
            for r in sorted((r for r in own if r["feature"]["name"] == name), key=lambda r: (str(r["feature"]["value"]), *(r[x] for x in LABELERS))):
                cell, s = table.setdefault(r["feature"]["value"], [1.0, 1.0]), soft[tuple(r[x] for x in LABELERS)]
                cell[0] += (1 - s) * r["n"]
                cell[1] += s * r["n"]
            sums = [sum(c[k] for c in table.values()) for k in (0, 1)]
            if len(table) > 1:
                for value, cell in table.items():
                    total = total + F.when(F.col(name).cast("string").eqNullSafe(F.lit(value)), F.lit(math.log(cell[1] / sums[1] * sums[0] / cell[0]))).otherwise(F.lit(0.0))
        score = F.coalesce(F.when(F.col("kind") == kind, total), score)
    return found.withColumn("private", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), score)))))


def spans(documents: DataFrame, accept: float = 0.5) -> DataFrame:
    """doc_id, source, kind, start, end, value, base, private: base spans and the accepted others.

    An accepted span that overlaps a base span is left out; of accepted ones that overlap, the first in the order of
    (start, longer, kind) that overlaps none before it is kept."""
    found = classify(materialise(features(votes(candidates(documents))), "candidates"))
    kept = found.where(F.col("base") | (F.col("private") >= accept)).withColumn("rank", F.when(F.col("base"), 0).otherwise(_order(F.col("kind"))))
    doc = Window.partitionBy("doc_id", "source")
    before = doc.orderBy("start", F.desc("end"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = doc.orderBy(F.desc("end"), "start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    base_end = F.max(F.when(F.col("base"), F.col("end"))).over(before)
    base_start = F.min(F.when(F.col("base"), F.col("start"))).over(after)
    clear = kept.withColumns({"base_end": base_end, "base_start": base_start})
    clear = clear.where(F.col("base") | ((F.coalesce("base_end", F.lit(0)) <= F.col("start")) & (F.coalesce("base_start", F.lit(1 << 62)) >= F.col("end"))))
    clear = clear.withColumn("other_end", F.max(F.when(~F.col("base"), F.col("end"))).over(before)).where(F.col("base") | (F.coalesce("other_end", F.lit(0)) <= F.col("start")))
    return clear.select("doc_id", "source", "kind", "start", "end", "value", "base", "private")


def digest(documents: DataFrame, accept: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each document."""
    found = materialise(spans(documents, accept), "spans")
    entry = F.struct(_order(F.col("kind")).alias("k"), "start", F.concat_ws(":", "kind", "start", "end").alias("s"))
    joined = lambda entries: F.array_join(F.transform(F.array_sort(entries), lambda e: e["s"]), ",")
    by_doc = found.groupBy("doc_id", "source").agg(*(F.count_if((F.col("kind") == k) & F.col("base")).alias(f"n_{k}") for k in BASE), joined(F.collect_list(F.when(F.col("base"), entry))).alias("base_spans"), joined(F.collect_list(entry)).alias("spans"))
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("source"))
    by_doc = by_doc.withColumnsRenamed({"doc_id": "_id", "source": "_source"})
    return ids.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("source") == F.col("_source")), "left").select("doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in BASE), F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def masked(documents: DataFrame, accept: float = 0.5) -> DataFrame:
    """All columns of `documents`; each span of the text is replaced by its kind in angle brackets."""
    found = spans(documents, accept)
    # base spans of different kinds may overlap: a span gives its place only if none before it reaches into it
    reach = F.max("end").over(Window.partitionBy("doc_id", "source").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("reach", F.coalesce(reach, F.lit(0))).where(F.col("end") > F.col("reach")).select("doc_id", "source", F.greatest("start", "reach").alias("start"), "end", "kind")
    id_, source, spans_ = (unused(documents, x) for x in ("span_id", "span_source", "spans"))
    marks = found.groupBy(F.col("doc_id").alias(id_), F.col("source").alias(source)).agg(F.array_sort(F.collect_set(F.struct("start", "end", "kind"))).alias(spans_))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    piece = lambda s, i: F.concat(F.substring("text", F.when(i == 0, F.lit(1)).otherwise(F.element_at(spans_, F.greatest(i, F.lit(1)))["end"] + 1).cast("int"), (s["start"] - F.when(i == 0, F.lit(0)).otherwise(F.element_at(spans_, F.greatest(i, F.lit(1)))["end"])).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
    rest = F.substring("text", (F.element_at(spans_, -1)["end"] + 1).cast("int"), F.char_length("text"))
    clean = F.when(F.col(spans_).isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.transform(spans_, piece), ""), rest))
    joined = documents.join(marks, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(source)), "left")
    return joined.select(*(clean.alias("text") if c == "text" else F.col(c) for c in documents.columns))
